"""The core at each step (week or month) from change points, without a row for each person and step.

`held` has a row for each change: keys, person, at, until (excluded), n: from step `at` on, and before `until`, the person
has n commits to date. Steps of a project count from 1 without a gap, up to the project's last; a person's rows follow each
other to the end. A project's people at a step are told by how many have each count, so what is exploded are distinct
counts; the cuts of a project are one array, as long as the project is old, and people's rows are tested against it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a block of cuts, whose least level is kept.
BLOCK = 16


def count_levels(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, at, n, people (who have n commits to date at that step), above (commits of people with more), higher (these
    people), total (commits of all)."""
    ends = F.array(F.struct("at", F.lit(1).alias("d")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("d")))
    change = held.select(*keys, "n", F.explode(ends).alias("e")).groupBy(*keys, "n", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    run = Window.partitionBy(*keys, "n").orderBy("at")
    level = change.withColumn("people", F.sum("d").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(run)).where("people > 0")
    level = level.select(*keys, "n", "people", F.explode(F.sequence("at", F.col("next") - 1)).alias("at"))
    step = Window.partitionBy(*keys, "at")
    more = step.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    commits = F.col("n") * F.col("people")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return level.withColumn("above", zero(F.sum(commits).over(more))).withColumn("higher", zero(F.sum("people").over(more))).withColumn("total", F.sum(commits).over(step))


def core_cuts(levels: DataFrame, keys: Sequence[str], percent: int = 80) -> DataFrame:
    """keys, at, total, people, and the cut: level (least count inside the core), higher (people above it), tied (people at
    it), taken (how many of these the core takes, by id)."""
    inside = F.when(F.col("above") * 100 < F.col("total") * percent, F.struct("n", "above", "higher", "people"))
    cut = levels.groupBy(*keys, "at").agg(F.max("total").alias("total"), F.sum("people").alias("people"), F.min(inside).alias("c"))
    lack = F.col("total") * percent - F.col("c.above") * 100
    taken = F.least(F.ceil(lack / (F.col("c.n") * 100)), F.col("c.people"))
    return cut.select(*keys, "at", "total", "people", F.col("c.n").alias("level"), F.col("c.higher").alias("higher"), F.col("c.people").alias("tied"), taken.alias("taken"))


def with_cuts(held: DataFrame, cuts: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """held with each project's cuts as an array (`parts` of them) and minima: the least level of each block of BLOCK steps."""
    arrays = cuts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "level", *[p for p in parts if p != "level"]))).alias("cuts"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / BLOCK).cast("int"))
    minima = F.transform(blocks, lambda b: F.array_min(F.transform(F.slice("cuts", b * BLOCK + 1, F.lit(BLOCK)), lambda c: c["level"])))
    return held.join(arrays.withColumn("minima", minima), list(keys))


def reached_blocks() -> Column:
    """The blocks of a row's interval in which some cut is no higher than the row's count: in others no step can be core."""
    block = lambda c: F.floor((c - 1) / BLOCK).cast("int")
    return F.filter(F.sequence(block(F.col("at")), block(F.col("until") - 1)), lambda b: F.col("n") >= F.get("minima", b))


def _tested(held: DataFrame, cuts: DataFrame, keys: Sequence[str], parts: Sequence[str], test) -> tuple[DataFrame, Column]:
    """held with each project's cuts, and the steps of a row's interval whose cut passes the test; only steps of blocks that the
    row's count reaches are tested, so a person who never comes near the core costs a look at each BLOCK steps."""
    inside = lambda b: F.sequence(F.greatest(F.col("at"), b * BLOCK + 1), F.least(F.col("until") - 1, (b + 1) * BLOCK).cast("int"))
    steps = F.flatten(F.transform(reached_blocks(), lambda b: F.filter(inside(b), lambda i: test(F.get("cuts", i - 1)))))
    return with_cuts(held, cuts, keys, parts), steps


def with_core_steps(held: DataFrame, cuts: DataFrame, keys: Sequence[str], person: str = "author_email") -> DataFrame:
    """Adds core_steps: the steps of the row's interval at which the person is in the core, the shortest prefix by count
    (more first) and id that reaches the share.

    Only people at a cut's count of which the core takes some, not all, are put in order, to find the last id taken.
    Reads both tables twice: hand in written ones.
    """
    split = cuts.where("taken < tied").select(*keys, "at", "taken")
    level = cuts.withColumn("part", F.col("taken") < F.col("tied"))
    rows, steps = _tested(held, level, keys, ["level", "part"], lambda c: c["part"] & (c["level"] == F.col("n")))
    place = F.row_number().over(Window.partitionBy(*keys, "at").orderBy(person))
    tied = rows.select(*keys, person, F.explode(steps).alias("at")).withColumn("place", place)
    last = tied.join(split, [*keys, "at"]).where("place = taken").select(*keys, "at", F.col(person).alias("last_in"))
    whole = cuts.join(last, [*keys, "at"], "left")
    at_cut = lambda c: (c["level"] == F.col("n")) & (c["last_in"].isNull() | (F.col(person) <= c["last_in"]))
    rows, steps = _tested(held, whole, keys, ["level", "last_in"], lambda c: (F.col("n") > c["level"]) | at_cut(c))
    return rows.withColumn("core_steps", steps).drop("cuts", "minima")
