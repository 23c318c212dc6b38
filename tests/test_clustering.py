"""Clusterings of points that a task can hold: a few jobs, and what passes over batches give."""

import numpy as np
import pytest

from tunelore.operators import clustering


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(4, 6))
    return spark.createDataFrame([(i * 7, (middles[i % 4 if i % 5 else 0] + 0.15 * rng.normal(size=6)).tolist()) for i in range(90)], "file_id bigint, feature array<double>").repartition(3)


def jobs_of(spark, group, act):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return act(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_best_k_takes_a_few_jobs_and_equals_passes(spark, points, monkeypatch):
    (found, tried), jobs = jobs_of(spark, "held", lambda: clustering.choose_clusters(points, 6))
    assert jobs <= 20
    got = {r["file_id"]: r["label"] for r in found.collect()}
    assert [t["k"] for t in tried] == [2, 3, 4, 5] and len(set(got.values())) > 1
    monkeypatch.setattr(clustering, "MOST_HELD", 0)
    other, history = clustering.choose_clusters(points, 6)
    assert got == {r["file_id"]: r["label"] for r in other.collect()}
    for a, b in zip(tried, history, strict=True):
        assert a["rejected"] == b["rejected"] and a.get("silhouette") == pytest.approx(b.get("silhouette"))


def test_one_k_takes_a_few_jobs_and_equals_passes(spark, points, monkeypatch):
    found, jobs = jobs_of(spark, "one", lambda: clustering.kmeans(points, 3, restarts=10))
    assert jobs <= 10
    monkeypatch.setattr(clustering, "MOST_HELD", 0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, clustering.kmeans(points, 3, restarts=10).collect()))


def test_held_silhouettes(spark, points):
    held = clustering.hold(points)
    labels = [held.ids % 3, np.minimum(held.ids, 1)]
    got = clustering._mean_silhouettes(held, labels)
    for named, mean in zip(labels, got):
        of = spark.createDataFrame([(int(i), int(n)) for i, n in zip(held.ids, named)], "file_id bigint, label int")
        assert clustering.silhouettes(points.join(of, "file_id"), 6).agg({"silhouette": "avg"}).first()[0] == pytest.approx(mean)


def test_points_beyond_the_bound_are_not_held(points):
    assert clustering.hold(points, 90 * 7 * 8 - 1) is None and len(clustering.hold(points, 90 * 7 * 8).ids) == 90
    assert clustering.hold(points.filter("file_id < 0")) is None


def test_refining_reads_events_once_and_equals_the_plain_rounds(spark):
    from tunelore.operators import features, scales, tonic
    from tunelore.operators.phrases import detect_phrases

    rng = np.random.default_rng(11)
    rows, sets = [], ([0, 2, 4, 5, 7, 9, 11], [2, 3, 5, 8, 10, 1])
    for file in range(14):
        end = 0
        for seq in range(1, 31):
            pc, length, gap = int(rng.choice(sets[file % 2])), int(rng.integers(4, 20)), int(rng.choice([0, 0, 0, 0, 20]))
            rows.append((file, seq, pc, (60 + pc) * 100, length, end + gap, end + gap + length))
            end += gap + length
    schema = "file_id bigint, seq int, pc int, midi_cents bigint, frames bigint, start_frame bigint, end_frame bigint"
    events = clustering.stage(detect_phrases(spark.createDataFrame(rows, schema)), "events")
    (found, history), jobs = jobs_of(spark, "refine", lambda: clustering.refine(events, iterations=2))
    assert jobs <= 120

    def with_root(roots):
        return events.join(roots.select("file_id", "root"), "file_id").selectExpr("*", "pmod(pc - root, 12) as degree")

    roots = tonic.root_generic(events)
    labels = clustering.choose_clusters(features.file_features(with_root(roots)), features.DIMS)[0].select("file_id", "label")
    k = labels.agg({"label": "max"}).first()[0] + 1
    for i in range(len(history) - len([h for h in history if "k" in h])):
        known = with_root(roots).join(labels.withColumnRenamed("label", "cluster_id"), "file_id")
        roots = clustering.stage(tonic.root_with_scale(known, scales.core_scale(scales.degree_shares(known))).select("file_id", "root"), "plain")
        points = clustering.stage(features.file_features(with_root(roots)), "plain")
        labels = labels if k == 1 else clustering.stage(clustering.align(labels, clustering.kmeans(points, k, 1479 + 7919 * (i + 1)).select("file_id", "label"), k), "plain")
    assert sorted(map(tuple, found.collect())) == sorted((r["file_id"], r["label"], r["root"]) for r in labels.join(roots, "file_id").collect())
