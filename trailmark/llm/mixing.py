"""Mixing of sources to target weights: temperature, then budgeted permutations of token blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm._arrow import cut

#: Exponents tried in one pass over the source table; each pass narrows the bracket to one of so many parts.
SECTIONS, PASSES = 32, 7
#: Tokens of a block at least, and blocks at most (larger corpora get larger blocks).
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 1 << 20
#: A source table of at most so many rows is broadcast.
BROADCAST_SOURCES = 50_000
ADDED = ("mix_pass", "mix_block", "mix_key", "mix_place")


def count_tokens(text: Column) -> Column:
    """Words parted by ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


@dataclass
class Mix:
    """plan: source, tokens, weight, epochs (budget share over tokens); exponent; budget in tokens; entropy in nats."""

    plan: DataFrame
    exponent: float
    budget: float
    entropy: float


def temperature_weights(totals: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, cover: bool = False) -> Mix | None:
    """Weights proportional to share ** exponent for a table (source, tokens) of sources with tokens. None for an empty one.

    The exponent lies in 0 (uniform) to 1 (in proportion). It is the largest that reaches `target_entropy` (a fraction of
    the entropy of uniform weights), or the smallest that repeats no source more than `repetition_limit` times; with both,
    the larger one. With neither it is 1. `budget` is in tokens (by default all there are); with `cover` it is the least
    that gives each source one whole pass. Each bisection pass tries SECTIONS exponents in one aggregate over the table.
    """
    whole = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m"), F.min("tokens").alias("l"), F.count(F.lit(1)).alias("n")).first()
    if not whole["t"]:
        return None
    total, sources = float(whole["t"]), whole["n"]
    top, low = math.log(whole["m"] / total), math.log(whole["l"] / total)
    shares = totals.withColumn("p", F.log(F.col("tokens") / F.lit(total)))

    def curve(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, most repetitions) at each exponent."""
        power = [F.sum(F.exp(F.lit(a) * F.col("p"))) for a in exponents]
        inner = [F.sum(F.exp(F.lit(a) * F.col("p")) * F.col("p")) for a in exponents]
        row = shares.agg(F.array(*power).alias("z"), F.array(*inner).alias("s")).first()
        out = []
        for a, z, s in zip(exponents, row["z"], row["s"], strict=True):
            if cover:
                most = math.exp((a - 1) * (low - top))
            else:
                most = (budget or total) / total * math.exp((a - 1) * low) / z
            out.append((math.log(z) - a * s / z, most))
        return out

    def bisect(holds) -> float:
        """The smallest exponent from which on `holds` is true; 1 if it never is."""
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            grid = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
            true = [holds(h, m) for h, m in curve(grid)]
            if true[0]:
                return grid[0]
            first = true.index(True) if True in true else SECTIONS
            lo, hi = grid[first - 1], grid[first]
        return hi

    found = []
    if target_entropy is not None:
        found.append(bisect(lambda h, m: h <= target_entropy * math.log(sources) + 1e-12))
    if repetition_limit is not None:
        found.append(bisect(lambda h, m: m <= repetition_limit + 1e-12))
    exponent = max(found, default=1.0)
    entropy = curve([exponent])[0][0]
    z = shares.agg(F.sum(F.exp(F.lit(exponent) * F.col("p"))).alias("z")).first()["z"]
    size = total * math.exp((1 - exponent) * top) * z if cover else float(budget or total)
    weight = F.exp(F.lit(exponent) * F.col("p")) / F.lit(z)
    epochs = F.lit(size) * weight / F.col("tokens")
    # Rounded, so that a pass isn't lost to the last bit of a product.
    plan = shares.select("source", "tokens", weight.alias("weight"), F.round(epochs, 9).alias("epochs"))
    return Mix(plan, exponent, size, entropy)


def _named(id_col: str, text_col: str | None) -> Column:
    h = F.xxhash64(F.col(text_col)) if text_col else F.lit(0).cast("bigint")
    return F.struct(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), h).alias("h")).alias("id")


def _keys(frame: DataFrame, seed: int) -> DataFrame:
    """Adds block (of `blocks`), block_key and doc_key, the places in the pass after the whole ones. `id` is the row's id, and a
    hash of its text where that is null, so that rows without ids aren't one group."""
    block = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks"))
    frame = frame.withColumn("block", block)
    return frame.withColumn("block_key", F.xxhash64(F.lit(seed), "whole", "source", "block")).withColumn("doc_key", F.xxhash64(F.lit(seed), "whole", "id"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", token_col: str | None = None, seed: int = 0, **goal) -> DataFrame:
    """The input's rows as often as the mix takes them, with mix_pass (0, 1, ...), mix_block, mix_key and mix_place.

    `goal` is passed to temperature_weights. A source of e epochs gives floor(e) whole passes and a part of one more. For
    each pass its rows lie in blocks of about equal numbers of tokens, and blocks and the rows in them are permuted by
    hash; the last pass takes blocks in that order, and of the block where the budget ends the rows that still fit.
    Sorting by mix_pass, mix_key, mix_place gives the permuted order: passes, their permuted blocks, and the permuted rows
    of a block. Null sources are one source named ""; rows of sources without a
    token are taken once; null texts have no tokens; rows that share an id stay together, those without one by their text; an empty table gives no rows.
    Columns of the input with the four added names are replaced.
    Scale: texts are counted once and don't move; only source totals and block sums are shuffled, each after map-side sums.
    """
    names = [c for c in docs.columns if c not in ADDED]
    tokens = F.coalesce(F.col(token_col), F.lit(0)).cast("bigint") if token_col else count_tokens(F.col(text_col))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = cut(docs.select(source.alias("source"), _named(id_col, text_col if text_col in names else None), tokens.alias("tokens")))
    totals = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    mix = temperature_weights(totals.where("tokens > 0"), **goal)
    if mix is None:
        return docs.select(*names, F.lit(0).alias("mix_pass"), *[F.lit(0).cast("bigint").alias(c) for c in ADDED[1:]])
    size = F.greatest(F.lit(BLOCK_TOKENS), F.ceil(F.lit(float(totals.agg(F.sum("tokens")).first()[0]) / MOST_BLOCKS)))
    plan = mix.plan.withColumn("blocks", F.ceil(F.col("tokens") / size).cast("bigint")).withColumn("whole", F.floor("epochs").cast("int"))
    plan = cut(plan.withColumn("quota", (F.col("epochs") - F.col("whole")) * F.col("tokens")).select("source", "blocks", "whole", "quota"))
    small = plan.count() <= BROADCAST_SOURCES
    near = F.broadcast if small else lambda x: x

    placed = _keys(rows.join(near(plan), "source"), seed)
    sums = placed.groupBy("source", "block", "block_key", "quota").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, 0))
    edge = sums.where("quota > 0").withColumn("upto", upto).where("upto > quota").groupBy("source").agg(F.min(F.struct("upto", "block_key", "block", F.expr("quota - (upto - t)").alias("room"))).alias("e"))
    edge = cut(edge.select("source", F.col("e.block").alias("edge_block"), F.col("e.block_key").alias("edge_key"), F.col("e.room").alias("room")))
    inside = placed.join(near(edge), "source").where("block = edge_block")
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", running).where("upto <= room").groupBy("source").agg(F.max("doc_key").alias("last_key"))
    choice = cut(plan.join(edge.drop("room", "edge_block"), "source", "left").join(last, "source", "left").drop("quota"))

    wide = docs.select(names).toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    wide = wide.withColumn("source", F.coalesce(F.col(at[source_col]).cast("string"), F.lit(""))).withColumn("id", _named(at[id_col], at.get(text_col)))
    wide = _keys(wide.join(near(choice), "source", "left").fillna({"blocks": 1, "whole": 1}), seed)
    more = (F.col("block_key") < F.col("edge_key")) | ((F.col("block_key") == F.col("edge_key")) & (F.col("doc_key") <= F.col("last_key")))
    passes = F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")
    wide = wide.where(passes > 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    key = F.xxhash64(F.lit(seed), "mix_pass", "source", "block")
    # The text is in the hash so that rows with a null id don't lie together.
    place = F.xxhash64(F.lit(seed), "mix_pass", "id", *([F.col(at[text_col])] if text_col in at else []))
    return wide.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "mix_pass", F.col("block").alias("mix_block"), key.alias("mix_key"), place.alias("mix_place"))


def mix_report(docs: DataFrame, **goal) -> DataFrame:
    """doc_id, source, mix_pass, mix_block, mix_key, mix_place of every row that the mix takes; nulls and empty tables as in mix_sources."""
    return mix_sources(docs, **goal).select("doc_id", "source", *ADDED)
