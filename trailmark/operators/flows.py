"""Flows between milestones: transition counts and probabilities, most probable paths, common sequences.

sequences: keys, project_type, sequence (array of states). The number of states is small and fixed by the milestones, so
the graph is small whatever the number of people; only the counting runs over these.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a graph whose paths are searched at most.
MOST_STATES = 1000


def transition_counts(sequences: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, src, dst, n over adjacent states."""
    s = F.col("sequence")
    steps = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("src"), F.element_at(s, i + 1).alias("dst")))
    return sequences.where(F.size(s) > 1).select(*keys, F.explode(steps).alias("e")).groupBy(*keys, "e.src", "e.dst").agg(F.count(F.lit(1)).alias("n"))


def transition_probabilities(counts: DataFrame, keys: Sequence[str] = (), least: float = 0.05) -> DataFrame:
    """keys, src, dst, p: the share of the source's steps; edges of at most `least` go (None keeps all)."""
    out = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "src"))).drop("n")
    return out if least is None else out.where(F.col("p") > least)


def non_empty(sequences: DataFrame) -> DataFrame:
    """Sequences with a state between START and END."""
    return sequences.where(F.size("sequence") > 2)


def _steps_of(path: Sequence[str]) -> list[tuple[str, str]]:
    return list(zip(path, path[1:], strict=False))


def best_path(graph: dict[str, dict[str, float]], start: str, end: str, shut: frozenset[str] = frozenset(), cut: frozenset[tuple[str, str]] = frozenset()) -> tuple[float, tuple[str, ...]] | None:
    """(cost, path) of the cheapest path, of equal ones the first by its states, that avoids the states `shut` and the edges
    `cut`; graph: state -> next state -> cost of at least 0. Dijkstra's search."""
    # Ordered by rounded costs, so that equal products taken in another order stay equal.
    heap, settled = [(0.0, (start,), 0.0)], set()
    while heap:
        _, path, cost = heapq.heappop(heap)
        last = path[-1]
        if last == end and len(path) > 1:
            return cost, path
        if last in settled:
            continue
        settled.add(last)
        for to, c in graph.get(last, {}).items():
            if to not in settled and to not in shut and (last, to) not in cut:
                heapq.heappush(heap, (round(cost + c, 9), (*path, to), cost + c))
    return None


def cheapest_paths(graph: dict[str, dict[str, float]], k: int, start: str, end: str) -> list[tuple[str, ...]]:
    """The k cheapest simple paths by Yen's method: each further path leaves one that is known at some state, by an edge that no
    known path with the same beginning takes, and goes on by the cheapest way that doesn't return. At most k * states
    searches, however many simple paths there are."""
    found: list[tuple[str, ...]] = []
    first = best_path(graph, start, end)
    waiting = [(round(first[0], 9), first[1])] if first else []
    known = {p for _, p in waiting}
    while waiting and len(found) < k:
        path = heapq.heappop(waiting)[1]
        found.append(path)
        for i in range(len(path) - 1):
            head = path[: i + 1]
            taken = frozenset((p[i], p[i + 1]) for p in found if p[: i + 1] == head and len(p) > i + 1)
            rest = best_path(graph, path[i], end, frozenset(path[:i]), taken)
            if rest and (*head[:-1], *rest[1]) not in known:
                known.add((*head[:-1], *rest[1]))
                heapq.heappush(waiting, (round(sum(graph[x][y] for x, y in _steps_of(head)) + rest[0], 9), (*head[:-1], *rest[1])))
    return found


def top_k_paths(edges: DataFrame, k: int = 1, start: str = "START", end: str = "END") -> DataFrame:
    """rank, path (joined by " > "), probability, cost (-log p) of the k most probable simple paths; equally probable ones in order
    of their states.

    The edges between at most MOST_STATES states go to the driver, which searches among them (see cheapest_paths): the
    counting over people is Spark's, the graph has a row for each pair of milestones. Edges without a probability above 0 are
    no edges; of repeated ones the most probable counts.
    """
    pairs = edges.where("p > 0 AND src <> dst").groupBy("src", "dst").agg(F.max("p").alias("p")).limit(MOST_STATES**2 + 1).collect()
    if len({s for r in pairs for s in (r["src"], r["dst"])}) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    chance: dict[str, dict[str, float]] = {}
    for r in pairs:
        chance.setdefault(r["src"], {})[r["dst"]] = min(1.0, float(r["p"]))
    rows = []
    for rank, path in enumerate(cheapest_paths({a: {b: -math.log(p) for b, p in to.items()} for a, to in chance.items()}, k, start, end), 1):
        p = math.prod(chance[x][y] for x, y in _steps_of(path))
        rows.append((rank, " > ".join(path), p, -math.log(p)))
    return edges.sparkSession.createDataFrame(rows, "rank int, path string, probability double, cost double")


def edges_off_paths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The edges that no given path uses."""
    s = F.split("path", " > ")
    steps = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("src"), F.element_at(s, i + 1).alias("dst")))
    used = paths.select(F.explode(steps).alias("e")).select("e.*").distinct()
    return edges.join(used, ["src", "dst"], "left_anti")


def state_presence(sequences: DataFrame, group: str = "project_type") -> DataFrame:
    """group, state, people: whose sequences hold it."""
    return sequences.select(group, F.explode(F.array_distinct("sequence")).alias("state")).groupBy(group, "state").agg(F.count(F.lit(1)).alias("people"))


def _text() -> Column:
    return F.array_join("sequence", ",")


def common_sequences(sequences: DataFrame, k: int = 10, group: str = "project_type", prefix: Sequence[str] = (), drop_empty: bool = False) -> DataFrame:
    """The k most frequent sequences of each group and of all ("overall"): scope, rank, sequence, n, percent.

    One aggregate with grouping sets counts both. prefix keeps sequences that start with these states.
    """
    rows = non_empty(sequences) if drop_empty else sequences
    if prefix:
        rows = rows.where(F.slice("sequence", 1, len(prefix)) == F.array(*[F.lit(p) for p in prefix]))
    rows = rows.select(F.col(group).alias("g"), _text().alias("sequence"))
    counts = rows.groupingSets([["g", "sequence"], ["sequence"]], "g", "sequence").agg(F.count(F.lit(1)).alias("n"), F.grouping("g").alias("all"))
    counts = counts.withColumn("scope", F.when(F.col("all") == 1, "overall").otherwise(F.col("g")))
    by = Window.partitionBy("scope")
    ranked = counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "sequence")))
    return ranked.where(F.col("rank") <= k).select("scope", "rank", "sequence", "n", "percent")


def sequence_filter_counts(sequences: DataFrame, prefix: Sequence[str]) -> DataFrame:
    """One row: total, empty, kept_by_prefix."""
    starts = F.slice("sequence", 1, len(prefix)) == F.array(*[F.lit(p) for p in prefix])
    return sequences.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.size("sequence") <= 2, 1)).alias("empty"), F.count(F.when(starts, 1)).alias("kept_by_prefix"))


def sequences_with_state(sequences: DataFrame, state: str, person: str | None = None) -> DataFrame:
    """sequence, n of the sequences that hold a state and, with `person`, members (sorted), which lie in one row: leave them
    out where a sequence may be common."""
    rows = sequences.where(F.array_contains("sequence", state)).withColumn("text", _text())
    members = [F.sort_array(F.collect_list(person)).alias("members")] if person else []
    return rows.groupBy(F.col("text").alias("sequence")).agg(F.count(F.lit(1)).alias("n"), *members)
