"""Classifiers on features: folds, training, evaluation, importance, feature tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import correlation
from trailmark.functions.tails import correlation_p
from trailmark.operators import stats
from trailmark.operators.dealing import dealt_counts
from trailmark.operators.numbering import numbered
from trailmark.operators.written import written

def stratified_kfold(frame: DataFrame, label: str, ids: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: rows of each label in hashed order, dealt in turn, so that the folds of a label differ by one row at most. No
    task numbers all rows of a label; see numbered."""
    return numbered(frame, ids, [label], seed, "fold").withColumn("fold", F.pmod(F.col("fold"), F.lit(folds)).cast("int"))


def prepared(features: Sequence[str], estimator) -> Pipeline:
    """Median imputation, assembly, standardising, estimator."""
    inputs, filled = list(features), [f"{c}__filled" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=inputs, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator])


def estimator(name: str, label: str, seed: int = 42, **options):
    """logistic (class weights), forest, boosting, svm."""
    makers = {
        "logistic": lambda: LogisticRegression(labelCol=label, weightCol="weight", **{"maxIter": 50, "regParam": 0.01} | options),
        "forest": lambda: RandomForestClassifier(labelCol=label, weightCol="weight", seed=seed, **{"numTrees": 50, "maxDepth": 6} | options),
        "boosting": lambda: GBTClassifier(labelCol=label, weightCol="weight", seed=seed, **{"maxIter": 20, "maxDepth": 3} | options),
        "svm": lambda: LinearSVC(labelCol=label, weightCol="weight", **{"maxIter": 50} | options),
    }
    return makers[name]()


def with_balance(frame: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows over twice the rows of the label."""
    counts = frame.agg(F.sum(F.col(label)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = float(counts["p"] or 0), float(counts["n"])
    return frame.withColumn("weight", F.when(F.col(label) == 1, F.lit(n / (2 * max(p, 1)))).otherwise(F.lit(n / (2 * max(n - p, 1)))))


def score_column(name: str) -> Column:
    return vector_to_array("rawPrediction")[1] if name == "svm" else vector_to_array("probability")[1]


def cross_validated(frame: DataFrame, features: Sequence[str], label: str, ids: Sequence[str], name: str = "logistic", folds: int = 5) -> DataFrame:
    """ids, label, fold, score: each row scored by the model of the other folds."""
    rows = with_balance(stratified_kfold(frame.withColumn(label, F.col(label).cast("double")), label, ids, folds), label)
    rows = written(rows)
    out = None
    for k in range(folds):
        model = prepared(features, estimator(name, label)).fit(rows.where(F.col("fold") != k))
        part = model.transform(rows.where(F.col("fold") == k)).select(*ids, label, "fold", score_column(name).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def eval_binary(scored: DataFrame, label: str, score: str = "score", keys: Sequence[str] = (), thresholds: int = 19, count: str | None = None) -> DataFrame:
    """keys, n, positives, roc_auc, average_precision, best_f1 and its threshold (of k / (thresholds + 1)), brier.

    All from counts of labels by distinct score, which are written once, so that a model scores each row once. A row stands for
    as many as its `count` says, if that is given.
    """
    on = list(keys) or ["_all"]
    rows = scored if keys else scored.withColumn("_all", F.lit(0))
    y, times = F.col(label).cast("double"), F.col(count) if count else F.lit(1)
    each = written(rows.groupBy(*on, F.col(score).alias("s")).agg(F.sum(y * times).alias("p"), F.sum((1 - y) * times).alias("q")))
    each = stats.running_sums(each, on, "s", ["p", "q"]).withColumnsRenamed({"p_all": "all_p", "q_all": "all_q"})
    each = each.withColumn("tp", F.col("all_p") - F.col("p_below")).withColumn("fp", F.col("all_q") - F.col("q_below"))
    auc = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (F.max("all_p") * F.max("all_q"))
    precision = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("all_p")
    curve = each.groupBy(*on).agg(F.max("all_p").alias("positives"), (F.max("all_p") + F.max("all_q")).alias("n"), auc.alias("roc_auc"), precision.alias("average_precision"), (F.sum(F.col("p") * (F.col("s") - 1) * (F.col("s") - 1) + F.col("q") * F.col("s") * F.col("s")) / (F.max("all_p") + F.max("all_q"))).alias("brier"))
    cuts = F.array(*[F.lit(k / (thresholds + 1)) for k in range(1, thresholds + 1)])
    # Scores are first joined by how many thresholds they reach.
    few = each.groupBy(*on, F.size(F.filter(cuts, lambda t: F.col("s") >= t)).alias("reached")).agg(F.sum("p").alias("p"), F.sum(F.col("p") + F.col("q")).alias("k"), F.max("all_p").alias("all_p"))
    hit = F.col("i") < F.col("reached")
    f1 = few.select("*", F.posexplode(cuts).alias("i", "t")).groupBy(*on, "t").agg(F.sum(F.when(hit, F.col("p")).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, F.col("k")).otherwise(0.0)).alias("k"), F.max("all_p").alias("pos"))
    f1 = f1.withColumn("f1", 2 * F.col("tp") / (F.col("k") + F.col("pos"))).groupBy(*on).agg(F.max("f1").alias("best_f1"), F.max_by("t", F.struct("f1", -F.col("t"))).alias("threshold"))
    out = curve.join(f1, on)
    return out if keys else out.drop("_all")


def tree_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """feature, importance of a fitted forest or boosting pipeline."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double")


def bijections(n: int, repeats: int, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of i -> (a i + b) mod n, one to one as a shares no factor with n, and without a fixed row where n allows it."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < repeats:
        a, b = int(rng.integers(1, max(2, n))), int(rng.integers(0, max(1, n)))
        if math.gcd(a, n) == 1:
            out.append((a, b))
    return out


def permutation_importance(model: PipelineModel, frame: DataFrame, features: Sequence[str], label: str, ids: Sequence[str], name: str = "forest", repeats: int = 10) -> DataFrame:
    """feature, drop, spread: mean and deviation of the loss of ROC AUC when the feature's values are dealt anew.

    Rows are numbered in hashed order, and a repeat gives each row the values of another by a bijection of these numbers, the same
    for all features. Dealt rows are counted by label and vector where they arrive (dealing.dealt_counts), and each vector of a
    table is scored once, so a model sees no more rows than there are different ones.
    """
    rows = numbered(frame.select(*ids, label, *features), ids, name="_i")
    n = frame.count()
    counts = dealt_counts(rows, features, label, "_i", max(n, 1), bijections(n, repeats))
    tables = counts.groupBy("feature", "repeat", label, *features).agg(F.sum("_n").alias("_n"))
    scored = model.transform(tables).select("feature", "repeat", label, "_n", score_column(name).alias("score"))
    found = eval_binary(scored, label, keys=["feature", "repeat"], count="_n").select("feature", "repeat", "roc_auc").orderBy("feature", "repeat").toPandas()  # a row a table
    base = float(found.loc[found["feature"] == -1, "roc_auc"].iloc[0])
    drops = {f: base - found.loc[found["feature"] == k, "roc_auc"] for k, f in enumerate(features)}
    return frame.sparkSession.createDataFrame([(f, float(d.mean()), float(d.std(ddof=0))) for f, d in drops.items()], "feature string, drop double, spread double")


def feature_label_tests(long: DataFrame, label: str, bins: int = 10) -> DataFrame:
    """feature, spearman and spearman_p (Student t; null for a constant feature), u, z, p_value, rank_biserial (1 - 2U / (n1 n2)), mean0, mean1, mutual_information on equal-count bins.

    long: ids, feature as `metric`, value `x`, label 0 or 1. Ranks come from value counts, so no task sorts rows."""
    rows = long.where("x is not null").withColumn("g", F.col(label).cast("int").cast("string"))
    counts = stats.value_counts(rows, ["metric"], "g", "x")
    ranks = stats.mid_ranks(counts, ["metric"])
    both = counts.join(ranks, ["metric", "x"])
    n, y, r = F.col("n"), F.col("group").cast("double"), F.col("mid_rank")
    sums = both.groupBy("metric").agg(F.sum(n).alias("n"), F.sum(n * y).alias("sy"), F.sum(n * r).alias("sr"), F.sum(n * r * y).alias("sry"), F.sum(n * r * r).alias("srr"), F.sum(F.when(y == 0, n * F.col("x"))).alias("x0"), F.sum(F.when(y == 1, n * F.col("x"))).alias("x1"))
    m = F.col("n")
    cov, vy, vr = F.col("sry") - F.col("sr") * F.col("sy") / m, F.col("sy") - F.col("sy") * F.col("sy") / m, F.col("srr") - F.col("sr") * F.col("sr") / m
    head = sums.select("metric", F.when((vy > 0) & (vr > 0), cov / F.sqrt(vy * vr)).alias("spearman"), m.alias("n"), (F.col("x0") / (m - F.col("sy"))).alias("mean0"), (F.col("x1") / F.col("sy")).alias("mean1"))
    u = stats.mann_whitney_u(rows, "g", "x", "1", "0", ["metric"])
    head = head.withColumn("spearman_p", correlation_p(F.col("spearman"), F.col("n"))).drop("n")
    u = u.select("metric", "u", "z", "p_value", (1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))).alias("rank_biserial"))
    bin_of = F.floor((F.col("mid_rank") - 1) * bins / F.col("total"))
    cells = both.groupBy("metric", "group", bin_of.alias("b")).agg(F.sum(n).alias("k"))
    w = lambda *c: F.sum("k").over(Window.partitionBy("metric", *c))
    mi = cells.select("metric", (F.col("k") / w() * F.log(F.col("k") * w() / (w("group") * w("b")))).alias("v")).groupBy("metric").agg(F.sum("v").alias("mutual_information"))
    return head.join(u, "metric").join(mi, "metric").withColumnRenamed("metric", "feature")


def pearson_by_group(long: DataFrame, label: str, group: str, top: int | None = None) -> DataFrame:
    """group, feature, r and p_value (Student t; null if constant or for fewer than 3 rows), n and, with `top`, the strongest so many by |r|."""
    out = long.where("x is not null").groupBy(group, F.col("metric").alias("feature")).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col(label)).alias("r"))
    out = out.withColumn("p_value", correlation_p(F.col("r"), F.col("n")))
    if top:
        place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(F.abs("r")), "feature"))
        out = out.withColumn("place", place).where(F.col("place") <= top)
    return out


def correlation_matrix(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature_a, feature_b, r for all pairs."""
    rows = VectorAssembler(inputCols=list(features), outputCol="v", handleInvalid="skip").transform(frame)
    m = Correlation.corr(rows, "v").first()[0].toArray()
    return frame.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(features) for j, b in enumerate(features)], "feature_a string, feature_b string, r double")


def feature_rank_compare(importances: DataFrame, first: str, second: str, group: str = "project_type", top: int = 10) -> DataFrame:
    """feature, rank_first, rank_second, difference, where: both, only_first, only_second, by each group's top features."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("importance"), "feature"))
    ranked = importances.withColumn("place", place).where(F.col("place") <= top)
    side = lambda g, name: ranked.where(F.col(group) == g).select("feature", F.col("place").alias(name))
    both = side(first, "rank_first").join(side(second, "rank_second"), "feature", "full")
    where = F.when(F.col("rank_first").isNull(), "only_second").when(F.col("rank_second").isNull(), "only_first").otherwise("both")
    return both.withColumn("difference", F.col("rank_first") - F.col("rank_second")).withColumn("found_in", where)
