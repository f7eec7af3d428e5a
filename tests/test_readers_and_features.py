"""Timeline files, the feature matrix, wide rows and cross-validated scores by value."""

import numpy as np
from pyspark.sql import functions as F

from trailmark.operators import features, models, threads, treatment
from trailmark.sources import readers

HEAD = "event_id,event_type,event_timestamp,event_week,event_identifier,event_data,project_name,project_type,contributor_email,username,is_pre_core\n"


def test_identity_comes_from_the_file_name_and_bad_rows_are_skipped(spark, tmp_path):
    (tmp_path / "timeline_org_repo_a_at_b.c.csv").write_text(HEAD + "0,commit,2024-01-01 00:00:00,0,x,,org/repo,A,a@b.c,a,true\n1,commit,no time,0,x,,org/repo,A,a@b.c,a,true\n,,,,,,,,,,\n")
    (tmp_path / "timeline_empty.csv").write_text("")
    (tmp_path / "other.csv").write_text(HEAD + "7,issue,2024-02-01 00:00:00,4,y,,p,B,z,z,false\n")
    (tmp_path / "timeline_broken.csv.gz").write_bytes(b"not a gzip file")
    (tmp_path / "notes.txt").write_text("no timeline")
    got = sorted((r.event_id, r.contributor_id, r.file_name) for r in readers.scan_timeline_csv(spark, str(tmp_path)).collect())
    assert got == [(0, "org_repo_a_at_b.c", "timeline_org_repo_a_at_b.c.csv"), (7, None, "other.csv")]


def test_feature_matrix_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=60), rng.integers(0, 9, 60).astype(float)
    rows = [(i, i % 2, None if i % 7 == 0 else float(x), None if i % 11 == 0 else int(y), 1, None, "t", float(i)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    frame = spark.createDataFrame(rows, "id int, label int, a double, b int, flat int, none double, text string, leak double")
    got = features.feature_matrix(frame, ["id"], "label", ["leak"]).orderBy("id").collect()
    assert got[0].asDict().keys() == {"id", "label", "a", "b"}
    for name, at in (("a", 2), ("b", 3)):
        x = np.array([np.nan if r[at] is None else r[at] for r in rows], float)
        x = np.where(np.isnan(x), np.nanmedian(x), x)
        assert np.allclose([r[name] for r in got], (x - x.mean()) / x.std())
    assert features.feature_matrix(frame.select("id", "label", "text"), ["id"], "label").columns == ["id", "label"]


def test_cross_validated_scores_tell_the_label(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - x[:, 1] + 0.2 * rng.normal(size=300) > 0).astype(int)
    frame = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x, strict=True))], "id int, label int, a double, b double, noise double")
    scored = models.cross_validated(frame, ["a", "b", "noise"], "label", ["id"], "logistic", folds=5)
    rows = scored.collect()
    assert sorted(r.id for r in rows) == list(range(300)) and {r.fold for r in rows} == set(range(5))
    pos, neg = [r.score for r in rows if r.label == 1], [r.score for r in rows if r.label == 0]
    auc = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
    assert auc > 0.95 and abs(models.eval_binary(scored, "label").first().roc_auc - auc) < 1e-9
    shuffled = frame.withColumn("label", (F.xxhash64("id") % 2 == 0).cast("int"))
    assert models.eval_binary(models.cross_validated(shuffled, ["a", "b"], "label", ["id"], "logistic"), "label").first().roc_auc < 0.7


def test_wide_rows_hold_people_without_threads(spark):
    timeline = spark.createDataFrame([("p", 1, "pull_request", '{"comments":[{"user":{"login":"q"},"created_at":"2024-01-02T00:00:00Z","body":"nice"}]}'), ("p", 2, "commit", None), ("p", 3, "issue", "broken {"), ("r", 4, "commit", None)], "person string, event_id int, event_type string, event_data string")
    timeline = timeline.withColumn("event_timestamp", F.lit("2024-01-01").cast("timestamp")).withColumn("is_pre_core", F.col("event_id") != 2)
    items, said = threads.thread_tables(timeline)
    got = {r.person: r for r in treatment.treatment_metrics(items, said, timeline=timeline, types=spark.createDataFrame([("p", "A")], "person string, project_type string")).collect()}
    assert {k: (r.total_pr_events, r.total_issue_events, r.total_commit_events, r.project_type) for k, r in got.items()} == {"p": (1, 1, 1, "A"), "r": (0, 0, 1, "unknown")}
    assert got["p"].recognition_prs == 1 and got["r"].recognition_prs is None
    summary = {r.person: (r.pre_core_events, r.post_core_events) for r in threads.timeline_summary(timeline).collect()}
    assert summary == {"p": (2, 1), "r": (1, 0)}


def test_contributor_texts_as_files_and_as_lines(spark, tmp_path):
    one = '{"project_name": "p", "contributor_email": "a@b", "raw_data": {"pull_requests": [{"number": 3, "createdAt": "2024-01-01T00:00:00Z"}], "issues": []}}'
    for name, text in (("files/a.json", one.replace(", ", ",\n ")), ("files/b.json", "{broken"), ("lines/all.json", f"{one}\n{{broken\n{one}\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files, lines = (readers.scan_contributor_cache_json(spark, str(tmp_path / d), lines=d == "lines").drop("event_data").collect() for d in ("files", "lines"))
    assert len(files) == 1 and lines == files * 2 and files[0].event_identifier == "3"
