"""Rank statistics without pair loops.

All of them start from one table of counts per (metric, value, group): a running sum over the distinct values of a metric
gives mid-ranks and dominance counts, so the work is a sort of the distinct values, and that is done in bins, so one metric
isn't one task. Keys are any columns; `x` is the value column and null values don't count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import effect_label
from trailmark.functions.tails import chi2_p, normal_p
from trailmark.operators.written import written


def value_counts(frame: DataFrame, keys: Sequence[str], group: str, x: str) -> DataFrame:
    """keys, group, x, n: how often each group has each value."""
    return frame.where(F.col(x).isNotNull()).groupBy(*keys, F.col(group).alias("group"), F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))


def value_bin(x: Column) -> Column:
    """A whole number that never falls as x grows: 256 bins for each doubling of |x| above 2^-20, NaN last as in a sort.

    A function of the value alone, so it needs no pass over the data and is the same when a task runs again.
    """
    size = F.floor(F.log2(F.abs(x) * float(2**20) + 1.0) * 256.0)
    return F.when(F.isnan(x), F.lit(2**63 - 1)).when(x < 0, -size).otherwise(size)


def running_sums(frame: DataFrame, keys: Sequence[str], x: str, columns: Sequence[str]) -> DataFrame:
    """Adds, for each column c, c_below (its sum over the key's rows of lesser x) and c_all (over all the key's rows).

    Rows are distinct by (keys, x). Two levels: sums inside a bin of values, and a running sum over the few bins of a key,
    so that no task holds all values of a key, or of the whole table where there are no keys.
    """
    rows = frame.withColumn("_bin", value_bin(F.col(x).cast("double")))
    of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(c) for c in columns])
    parts = [e for c in columns for e in (of(c, earlier).alias(f"_{c}_earlier"), F.sum(c).over(whole).alias(f"{c}_all"))]
    bins = bins.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bin").alias("_of_bin"), *parts)
    inside = Window.partitionBy(*keys, "_bin").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_below": of(c, inside) for c in columns})
    same = F.col("_bin") == F.col("_of_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = rows.join(bins, same).withColumns({f"{c}_below": F.col(f"{c}_below") + F.col(f"_{c}_earlier") for c in columns})
    return out.drop("_bin", "_of_bin", *[f"_of_{k}" for k in keys], *[f"_{c}_earlier" for c in columns])


def quantiles(frame: DataFrame, keys: Sequence[str], x: str, shares: dict[str, float]) -> DataFrame:
    """keys, and for each name in `shares` the value at that share of the key's rows, linear between neighbours as percentile
    has it. Keys without values have no row; without keys there is one row, of nulls where there are no values.

    Read off the running sums of the values' counts, so no task holds all values of a key.
    """
    v = F.col(x).cast("double")
    counts = running_sums(frame.where(v.isNotNull()).groupBy(*keys, v.alias("_x")).agg(F.count(F.lit(1)).alias("_t")), keys, "_x", ["_t"])
    parts = []
    for name, share in shares.items():
        at = share * (F.col("_t_all") - 1)
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            parts.append(F.max(F.when((F.col("_t_below") <= place) & (place < F.col("_t_below") + F.col("_t")), F.col("_x"))).alias(f"_{name}_{side}"))
        parts.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
    low, high, part = (lambda n, e=e: F.col(f"_{n}_{e}") for e in ("low", "high", "part"))
    value = lambda n: F.when(low(n) == high(n), low(n)).otherwise((1.0 - part(n)) * low(n) + part(n) * high(n))
    return counts.groupBy(*keys).agg(*parts).select(*keys, *[value(n).alias(n) for n in shares])


def on_keys(rows: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with the sums of their keys, nulls being keys like others; without keys, `sums` is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(sums))
    sums = sums.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(sums, same, "left").drop(*[f"_of_{k}" for k in keys])


def mid_ranks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x, t (ties at x over all groups), mid_rank, total (rows of the key)."""
    ties = running_sums(counts.groupBy(*keys, "x").agg(F.sum("n").alias("t")), keys, "x", ["t"])
    return ties.select(*keys, "x", "t", (F.col("t_below") + (F.col("t") + 1) / 2.0).alias("mid_rank"), F.col("t_all").alias("total"))


def group_ranks(frame: DataFrame, keys: Sequence[str], group: str, x: str) -> DataFrame:
    """keys, group, n, rank_sum, and the metric's total and tie_sum (sum of t^3 - t)."""
    counts = value_counts(frame, keys, group, x)
    ranks = mid_ranks(counts, keys)
    sums = counts.join(ranks.drop("total"), [*keys, "x"]).groupBy(*keys, "group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mid_rank")).alias("rank_sum"))
    t = F.col("t").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum("t").alias("total"), F.sum(t * t * t - t).alias("tie_sum")) if keys else ranks.agg(F.sum("t").alias("total"), F.sum(t * t * t - t).alias("tie_sum"))
    return sums.join(ties, list(keys)) if keys else sums.crossJoin(F.broadcast(ties))


def rank_sum_z(u: Column, n1: Column, n2: Column, tie_sum: Column) -> Column:
    """Normal deviate of U, corrected for ties and continuity; 0 without spread."""
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - tie_sum / F.greatest(n * (n - 1), F.lit(1.0))))
    return F.when(sd > 0, (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd).otherwise(F.lit(0.0))


def mann_whitney_u(frame: DataFrame, group: str, x: str, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n1, n2, u (of the first group), z (tie-corrected, with continuity correction), p_value (two-sided, normal; 1 without spread)."""
    r = group_ranks(frame.where(F.col(group).isin(first, second)), keys, group, x)
    pick = lambda c, g: F.max(F.when(F.col("group") == g, F.col(c)))
    aggs = [pick("n", first).alias("n1"), pick("n", second).alias("n2"), pick("rank_sum", first).alias("r1"), F.max("total").alias("total"), F.max("tie_sum").alias("tie_sum")]
    wide = r.groupBy(*keys).agg(*aggs).where("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    z = rank_sum_z(u, n1, n2, F.col("tie_sum"))
    # Where u is half a pair from its mean or less, the corrected z is negative and p is 1.
    return wide.select(*keys, "n1", "n2", u.alias("u"), z.alias("z")).withColumn("p_value", normal_p(F.greatest(F.col("z"), F.lit(0.0))))


def dominance(frame: DataFrame, group: str, x: str, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n1, n2, greater, less: pairs in which the first group's value is greater or less than the second's."""
    counts = value_counts(frame.where(F.col(group).isin(first, second)), keys, group, x)
    pair = counts.groupBy(*keys, "x").agg(F.sum(F.when(F.col("group") == first, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("group") == second, F.col("n")).otherwise(0)).alias("b"))
    ranked = running_sums(pair, keys, "x", ["a", "b"])
    out = ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("b_below")).alias("greater"), F.sum(F.col("b") * F.col("a_below")).alias("less"))
    return out.where("n1 > 0 and n2 > 0")


def cliffs_delta_strict(frame: DataFrame, group: str, x: str, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """2 #(x > y) / (n1 n2) - 1: ties count as less. keys, n1, n2, delta, label."""
    d = 2.0 * F.col("greater") / (F.col("n1") * F.col("n2")) - 1
    return dominance(frame, group, x, first, second, keys).withColumn("delta", d).withColumn("label", effect_label(F.col("delta"))).drop("greater", "less")


def cliffs_delta_ties(frame: DataFrame, group: str, x: str, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """(#greater - #less) / (n1 n2), with the second group seen as the greater side. keys, n1, n2, delta, label."""
    d = (F.col("less") - F.col("greater")).cast("double") / (F.col("n1") * F.col("n2"))
    return dominance(frame, group, x, first, second, keys).withColumn("delta", d).withColumn("label", effect_label(F.col("delta"))).drop("greater", "less")


def chi_square_2x2(frame: DataFrame, group: str, flag: Column, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """Yates-corrected chi-square of a yes/no flag against two groups. keys, yes1, no1, yes2, no2, chi2 and p_value
    (null if a margin is 0)."""
    cell = lambda g, f: F.sum(F.when((F.col(group) == g) & f, 1).otherwise(0)).cast("bigint")
    t = frame.where(flag.isNotNull()).groupBy(*keys).agg(cell(first, flag).alias("yes1"), cell(first, ~flag).alias("no1"), cell(second, flag).alias("yes2"), cell(second, ~flag).alias("no2"))
    a, b, c, d = (F.col(k).cast("double") for k in ("yes1", "no1", "yes2", "no2"))
    n, gap = a + b + c + d, F.abs(a * d - b * c)
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    # Yates: the correction is half a unit a cell, and never more than the gap itself.
    return t.withColumn("chi2", F.when(margins > 0, n * F.pow(gap - F.least(n / 2, gap), F.lit(2.0)) / margins)).withColumn("p_value", chi2_p(F.col("chi2"), F.lit(1)))


def chi_square_of_counts(counts: DataFrame, yes: str, no: str, keys: Sequence[str] = ()) -> DataFrame:
    """From a row of yes and no counts for each group of a key: keys, chi2 (Yates-corrected for two groups), df, p_value;
    chi2 and p are null with fewer than two groups or a margin of 0."""
    rows = counts.select(*keys, F.col(yes).cast("double").alias("_y"), F.col(no).cast("double").alias("_n"))
    sums = rows.groupBy(*keys).agg(F.sum("_y").alias("_ys"), F.sum("_n").alias("_ns"), F.count(F.lit(1)).alias("_groups"), F.min(F.col("_y") + F.col("_n")).alias("_least"))
    sums = sums.where((F.col("_groups") > 1) & (F.col("_ys") > 0) & (F.col("_ns") > 0) & (F.col("_least") > 0))
    size, total = F.col("_y") + F.col("_n"), F.col("_ys") + F.col("_ns")

    def part(seen: str, margin: str) -> Column:
        hoped = size * F.col(margin) / total
        gap = F.abs(F.col(seen) - hoped)
        return F.pow(gap - F.when(F.col("_groups") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0), F.lit(2.0)) / hoped

    parts = on_keys(rows, sums, keys).groupBy(*keys).agg(F.sum(part("_y", "_ys") + part("_n", "_ns")).alias("chi2"), F.count(F.lit(1)).alias("df"))
    return parts.select(*keys, "chi2", F.when(F.col("chi2").isNotNull(), F.col("df") - 1).alias("df")).withColumn("p_value", chi2_p(F.col("chi2"), F.col("df")))


def kruskal_wallis(frame: DataFrame, group: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, groups, total, h (tie-corrected), df, p_value (null without spread or with one group)."""
    r = group_ranks(frame, keys, group, x)
    n = F.col("total").cast("double")
    out = r.groupBy(*keys, "total", "tie_sum").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.pow(F.col("rank_sum"), 2) / F.col("n")).alias("s"))
    h = (12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.when(F.col("tie_sum") < n * n * n - n, 1 - F.col("tie_sum") / (n * n * n - n))
    return out.select(*keys, "groups", "total", h.alias("h"), (F.col("groups") - 1).alias("df")).withColumn("p_value", chi2_p(F.col("h"), F.col("df")))


def dunn_posthoc(frame: DataFrame, group: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, group_a, group_b (a before b), z of the difference of mean ranks (a minus b), p_value (two-sided)."""
    r = group_ranks(frame, keys, group, x).withColumn("m", F.col("rank_sum") / F.col("n"))
    side = lambda s: r.select(*keys, F.col("group").alias(f"group_{s}"), F.col("n").alias(f"n_{s}"), F.col("m").alias(f"m_{s}"), *([F.col("total"), F.col("tie_sum")] if s == "a" else []))
    a, b = side("a"), side("b")
    pairs = a.join(b, list(keys)) if keys else a.join(b, F.col("group_a") < F.col("group_b"))
    n = F.col("total").cast("double")
    var = (n * (n + 1) / 12 - F.col("tie_sum") / (12 * (n - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    return pairs.where("group_a < group_b").select(*keys, "group_a", "group_b", ((F.col("m_a") - F.col("m_b")) / F.sqrt(F.when(var > 0, var))).alias("z")).withColumn("p_value", normal_p(F.col("z")))


def rank_buckets(medians: dict[str, float], p_values: dict[tuple[str, str], float], alpha: float = 0.05) -> dict[str, int]:
    """Rank of each group (1: smallest median). Groups join the bucket before them while all pairs across aren't significant.

    Works on the few rows of dunn_posthoc that a caller has collected.
    """
    p = {**p_values, **{(b, a): v for (a, b), v in p_values.items()}}
    buckets: list[list[str]] = []
    for g in sorted(medians, key=lambda g: (medians[g], g)):
        if buckets and all(p.get((g, h), 1.0) >= alpha for h in buckets[-1]):
            buckets[-1].append(g)
        else:
            buckets.append([g])
    return {g: i + 1 for i, b in enumerate(buckets) for g in b}


def quartile_summary(frame: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, n, mean, median, q25, q75, std (sample) of the values, and the text "median [q25-q75]"."""
    v = F.col(x).cast("double")
    out = frame.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    out = on_keys(out, quantiles(frame, keys, x, {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys)
    text = F.format_string("%.3f [%.3f-%.3f]", "median", "q25", "q75")
    return out.select(*keys, "n", "mean", "median", "q25", "q75", "std", text.alias("text"))


def unpivot_metrics(frame: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form: keys, metric, x."""
    return frame.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "x")


def group_compare(long: DataFrame, group: str, first: str, second: str, min_n: int = 1) -> DataFrame:
    """From (metric, group, x): for each metric n, mean, median and std of both groups, u, z, p_value, delta (ties count for
    neither side) and its label, and delta_strict (ties count as less, first over second).

    direction names the group with the larger median (then mean), "equal" if neither. Metrics with fewer than `min_n`
    values in a group are left out. The rows are read once, for the counts of values; their running sums give medians, ranks
    and dominance together.
    """
    counts = value_counts(long.where(F.col(group).isin(first, second)), ["metric"], group, "x")
    of = lambda g: F.sum(F.when(F.col("group") == g, F.col("n")).otherwise(0))
    pair = written(counts.groupBy("metric", "x").agg(of(first).alias("a"), of(second).alias("b")))
    x = F.col("x")
    means = pair.groupBy("metric").agg(*[(F.sum(x * c) / F.when(F.sum(c) > 0, F.sum(c))).alias(f"mean{i}") for i, c in ((1, F.col("a")), (2, F.col("b")))])
    # A row a metric.
    rows = running_sums(pair, ["metric"], "x", ["a", "b"]).join(means, "metric")
    n = {c: F.col(f"{c}_all") for c in "ab"}
    parts = [F.max(n["a"]).alias("n1"), F.max(n["b"]).alias("n2"), F.max("mean1").alias("mean1"), F.max("mean2").alias("mean2")]
    for i, c in ((1, "a"), (2, "b")):
        for side, place in (("low", F.floor((n[c] - 1) / 2)), ("high", F.ceil((n[c] - 1) / 2))):
            parts.append(F.max(F.when((F.col(f"{c}_below") <= place) & (place < F.col(f"{c}_below") + F.col(c)), x)).alias(f"{side}{i}"))
        gap = x - F.col(f"mean{i}")
        parts.append(F.sum(F.col(c) * gap * gap).alias(f"squares{i}"))
    t = (F.col("a") + F.col("b")).cast("double")
    rank = F.col("a_below") + F.col("b_below") + (t + 1) / 2
    parts += [F.sum(F.col("a") * rank).alias("r1"), F.sum(t * t * t - t).alias("tie_sum"), F.sum(F.col("a") * F.col("b_below")).alias("greater"), F.sum(F.col("b") * F.col("a_below")).alias("less")]
    found = rows.groupBy("metric").agg(*parts).where((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    found = found.withColumns({f"median{i}": (F.col(f"low{i}") + F.col(f"high{i}")) / 2 for i in (1, 2)} | {f"std{i}": F.when(m > 1, F.sqrt(F.col(f"squares{i}") / (m - 1))) for i, m in ((1, n1), (2, n2))})
    found = found.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("z", rank_sum_z(F.col("u"), n1, n2, F.col("tie_sum"))).withColumn("p_value", normal_p(F.greatest(F.col("z"), F.lit(0.0))))
    found = found.withColumn("delta", (F.col("less") - F.col("greater")) / (n1 * n2)).withColumn("delta_strict", 2.0 * F.col("greater") / (n1 * n2) - 1)
    larger = F.when(F.col("median1") != F.col("median2"), F.col("median1") > F.col("median2")).when(F.col("mean1") != F.col("mean2"), F.col("mean1") > F.col("mean2"))
    found = found.withColumn("label", effect_label(F.col("delta"))).withColumn("direction", F.when(larger, first).when(~larger, second).otherwise("equal"))
    return found.select("metric", "n1", "n2", "u", "z", "p_value", *[f"{c}{i}" for i in (1, 2) for c in ("mean", "median", "std")], "delta", "delta_strict", "label", "direction")
