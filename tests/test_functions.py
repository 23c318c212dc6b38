"""Column functions, pairing and statistics on small hand-made cases."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tunelore.functions import scalars as s
from tunelore.functions.text import decode_any, fold_accents, join_url, title_key
from tunelore.operators import clustering, grammar, matching, monophony, rhythm, scales, segments, tonic, weights


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, s.half_even(lit(x))) for x in (60.5, 61.5, -0.5)] == [60, 62, 0]
    assert one(spark, s.degree(lit(59.0), lit(11))) == 0
    assert [one(spark, s.token_to_midi(lit(t))) for t in ("C4", "c#-1", "E♭4", "Bbb3", "Gx2", "rest", "C11", "H4", None)] == [60, 1, 63, 57, 45, None, None, None, None]
    assert [one(spark, s.duration_value(lit(t))) for t in ("0.5", "1/4", "1/0", "0", "-1", "x", None)] == [0.5, 0.25, None, None, None, None, None]
    assert [one(spark, s.note_name(lit(m))) for m in (60.0, 0.0, 61.4)] == ["C4", "C-1", "C#4"]
    assert [one(spark, s.root_from_name(lit(n))) for n in ("c", "B♭", " f# ", "H")] == [0, 10, 6, None]
    assert [one(spark, s.slug(lit(t))) for t in (" Ab, c-D.e ", "!!!", "Ünder  Wegs")] == ["ab_c_d_e", "song", "ünder_wegs"]
    assert [one(spark, s.yes_no(lit(t))) for t in (" Yes", "off", "maybe", None)] == [True, False, None, None]
    assert one(spark, s.case_and_condition(lit("erika_test_china_1.wav"))).asDict() == {"case": "erika_test", "condition": "china_1"}
    assert one(spark, s.earliest_label(lit("Set/Rast/hijaz 2.mid"), {"hijaz": ["hijaz"], "rast": ["rast"]})) == "rast"
    assert one(spark, s.earliest_label(lit("x"), {"a": ["b"]})) == "unknown"
    assert [one(spark, s.base64_path(lit(t))) for t in ("YS9i", "/w==", "?")] == ["a/b", None, None]
    assert one(spark, s.cents_residual(lit(59.75))) == pytest.approx(-25) and one(spark, s.midi_to_hz(lit(69.0))) == 440.0
    assert one(spark, s.dbfs(lit(0.0))) == -120.0 and one(spark, s.tempo_or(lit(500.0))) == 120.0


def test_text(spark):
    df = spark.createDataFrame([("Ａ b！（c）", "Zǐzhú diào"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(title_key("a")).collect()] == ["abc", ""]
    assert [r[0] for r in df.select(fold_accents("b")).collect()] == ["zizhudiao", None]
    urls = spark.createDataFrame([("http://a/b/c.html", " ../x y.mid#z"), ("http://a/", None)], "a string, b string")
    assert [r[0] for r in urls.select(join_url("a", "b")).collect()] == ["http://a/x%20y.mid", None]
    raw = spark.createDataFrame([(bytearray("歌".encode("shift_jis")),), (bytearray(b"\xef\xbb\xbfx"),)], "c binary")
    assert [r[0] for r in raw.select(decode_any("c")).collect()] == ["歌", "x"]


@pytest.mark.parametrize("seed", range(4))
def test_messages_pair_like_queues(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 2), rng.randint(60, 61), i // 2, bool(rng.getrandbits(1)), i) for i in range(120)]
    queues, expected = {}, []
    for song, pitch, tick, is_on, _ in rows:
        q = queues.setdefault((song, pitch), deque())
        if is_on:
            q.append(tick)
        elif q:
            start = q.popleft()
            if tick > start:
                expected.append((song, pitch, start, tick))
    df = spark.createDataFrame(rows, "song int, pitch int, tick int, is_on boolean, id int")
    got = monophony.pair_messages(df, ["song", "pitch"], ["id"]).collect()
    assert sorted((r["song"], r["pitch"], r["start"], r["end"]) for r in got) == sorted(expected)


def test_lines_and_tempo(spark):
    notes = spark.createDataFrame([(1, 0, 10, 60, 1), (1, 0, 10, 67, 2), (1, 0, 4, 67, 3), (1, 6, 4, 62, 4)], "song int, start int, duration int, pitch int, id int")
    assert sorted((r["start"], r["duration"], r["pitch"]) for r in monophony.monophonize(notes, ["song"]).collect()) == [(0, 6, 67), (6, 4, 62)]
    tempos = spark.createDataFrame([(1, 0, 500_000, 0), (1, 480, 250_000, 1)], "song int, tick int, tempo bigint, id int")
    at = spark.createDataFrame([(1, 960, 9)], "song int, tick int, id int")
    assert monophony.seconds_at(at, tempos).first()["seconds"] == 0.75


def test_quantiles_and_scales(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 1), (1, 3.0, 2), (1, 9.0, 0), (1, None, 5), (1, float("nan"), 5)], "g int, v double, w int")
    assert rhythm.weighted_quantiles(df, ["g"], "v", "w", {"m": 0.5, "top": 1.0}).first()[1:] == (2.0, 3.0)
    clear = spark.createDataFrame([(0, d, f) for d, f in zip((0, 2, 4, 7, 9, 11, 1), (30, 20, 20, 15, 10, 3, 2))] + [(1, 5, 0)], "cluster_id int, degree int, frames int")
    core = {r["cluster_id"]: (list(r["scale"]), round(r["coverage"], 6), r["reason"]) for r in scales.core_scale(scales.degree_shares(clear)).collect()}
    assert core == {0: ([0, 2, 4, 7, 9], 0.95, "coverage_elbow"), 1: ([0, 2, 4, 5, 7], 0.0, "empty_duration_fallback")}
    even = spark.createDataFrame([(0, d, 10) for d in range(12)], "cluster_id int, degree int, frames int")
    assert scales.core_scale(scales.degree_shares(even)).first()["reason"] == "max_notes_fallback"


def _melody(spark, degrees, scale):
    rows = [(0, 1, 0, i, d, d * 100 + 6000, d in scale, 10, d) for i, d in enumerate(degrees)]
    return spark.createDataFrame(rows, "cluster_id int, file_id int, phrase int, seq int, degree int, midi_cents int, in_scale boolean, frames int, pc int")


def test_runs_and_cadences(spark):
    runs = grammar.scale_runs(_melody(spark, [0, 0, 2, 2, 4], {0, 2, 4}))
    assert [r["degree"] for r in runs.orderBy("seq").collect()] == [0, 2, 4] and grammar.interval_steps(runs).count() == 2
    broken = _melody(spark, [0, 2, 1, 2, 4], {0, 2, 4})
    assert {(r["n"], r["ngram"]) for r in grammar.run_ngrams(grammar.scale_runs(broken)).collect()} == {(2, "0>2"), (2, "2>4")}
    assert {(r["n"], r["ngram"]) for r in grammar.cadences(broken, grammar.scale_runs(broken)).collect()} == {(1, "4"), (2, "2>4")}
    ends_out = _melody(spark, [0, 2, 1], {0, 2})
    assert grammar.cadences(ends_out, grammar.scale_runs(ends_out)).count() == 0


def test_roots_and_weights(spark):
    best = tonic.root_generic(_melody(spark, [0, 4, 7, 4, 0], {0})).first()
    assert best["root"] == 0 and best["margin"] > 0
    assert one(spark, weights.positive_weight(F.lit(10.0), 1.0)) == 3.5 and one(spark, weights.positive_weight(F.lit(0.01), 1.0)) is None
    support = spark.createDataFrame([(0, 4, "0>2>4>0", 9, 5), (0, 4, "2>4>0>2", 4, 1)], "cluster_id int, n int, ngram string, count bigint, files bigint")
    degrees = spark.createDataFrame([(0, 0, 30), (0, 2, 30), (0, 4, 30)], "cluster_id int, degree int, n bigint")
    files = spark.createDataFrame([(0, 9)], "cluster_id int, n_files int")
    rows = weights.preferred_phrases(support, degrees, files).collect()
    assert [r["ngram"] for r in rows] == ["0>2>4>0"] and 0 < rows[0]["weight"] <= 3.5


def test_micro_tuning(spark):
    rows = [(0, f, 0, i, 0, 6000 + (12 if f == 1 else 0) + (40 if i == 9 and f == 1 else 0), True) for f in (1, 2, 3) for i in range(10)] + [(0, 1, 0, 20 + i, 5, 6500, False) for i in range(30)]
    df = spark.createDataFrame(rows, "cluster_id int, file_id int, phrase int, seq int, degree int, midi_cents int, in_scale boolean")
    assert [(r["degree"], r["n"], r["cents"]) for r in rhythm.micro_tuning(df.filter("file_id = 1")).collect()] == [(0, 10, 12.0)]


def test_matching(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "x"), (5, None, None), (6, None, "y"), (7, "d", None)]
    df = spark.createDataFrame(rows, "id int, k1 string, k2 string")
    got = {r["id"]: (r["kept"], r["reason"]) for r in matching.keep_by_two_keys(df, "id", "k1", "k2").collect()}
    assert got == {1: (True, None), 2: (False, "first_key"), 3: (True, None), 4: (False, "second_key"), 5: (True, None), 6: (False, "second_key"), 7: (True, None)}
    names = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x 2"), (4, "x")], "id int, name string")
    assert {r["id"]: r["slug"] for r in matching.unique_slugs(names, "name", "id").collect()} == {1: "x", 2: "x_3", 3: "x_2", 4: "x_4"}
    pages = spark.createDataFrame([(1, "river song"), (2, "the river song again"), (3, None), (4, "ab")], "page int, title string")
    wanted = spark.createDataFrame([("river song",), ("song",), ("an old ab cdef river song x",), ("ab",), ("zz",), (None,)], "name string")
    assert {r["name"]: (r["ident"], r["how"]) for r in matching.find_names(wanted, "name", pages, "title", "page").collect()} == {"river song": (1, "exact"), "song": (1, "contains"), "an old ab cdef river song x": (1, "contains"), "ab": (4, "exact")}


def test_silhouettes_and_labels(spark):
    points = spark.createDataFrame([(0, 0, [0.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 1, [5.0, 0.0])], "file_id bigint, label int, feature array<double>")
    got = {r["file_id"]: r["silhouette"] for r in clustering.silhouettes(points, 2, block=2).collect()}
    assert got[2] == 1.0 and got[0] == pytest.approx((5 - 1) / 5)
    assert {r["silhouette"] for r in clustering.silhouettes(points.withColumn("label", F.lit(0)), 2).collect()} == {-1.0}
    labels = spark.createDataFrame([(i, l) for i, l in enumerate([7, 7, 3, 3, 9, 9, 9])], "file_id bigint, label int")
    assert {r["file_id"]: r["label"] for r in clustering.relabel(labels).collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    turned = labels.select("file_id", F.when(F.col("label") == 7, 0).when(F.col("label") == 3, 1).otherwise(2).alias("label"))
    other = turned.withColumn("label", (F.col("label") + 1) % 3)
    assert sorted(map(tuple, clustering.align(turned, other, 3).collect())) == sorted(map(tuple, turned.collect()))


def test_gates_and_windows(spark):
    rows = [("bass", 0.52, 0.2, 0.31, 2), ("lead", 0.52, 0.2, 0.31, 2)]
    got = [(r["accepted"], r["reason"]) for r in segments.gate(spark.createDataFrame(rows, "role string, score double, voiced_ratio double, mean_confidence double, note_count int"), "role").collect()]
    assert got == [(True, ""), (False, "score<0.58;confidence<0.35;notes<3")]
    windows = segments.covering_windows(spark.createDataFrame([(1, 20), (2, 10), (3, 0)], "file_id int, duration int"), 12, 4).collect()
    assert [(r["file_id"], r["start"], r["end"], r["is_last"]) for r in windows] == [(1, 0, 12, False), (1, 8, 20, True), (2, 0, 10, True)]


def test_bend_ranges(spark):
    rows = [(0, None, None), (1, 6, 12), (2, 101, 0), (3, 100, 0), (4, 6, 7), (5, 38, 50), (6, 100, 1), (7, 6, 3)]
    df = spark.createDataFrame([(1, *r) for r in rows], "channel int, seq int, control int, value int")
    assert [r["sensitivity"] for r in monophony.bend_ranges(df, ["channel"], ["seq"]).orderBy("seq").collect()] == [2.0, 2.0, 2.0, 2.0, 7.0, 7.5, 7.5, 7.5]


def test_sinks(spark, tmp_path):
    from tunelore.sources import sinks

    mapped = spark.createDataFrame([("p", 1, 0, 3, 60.2, 62, 0, 5, 0, 5, "base")], "id string, file_id int, phrase int, seq int, source_midi double, target int, root int, frames int, start_frame int, end_frame int, name string")
    report = sinks.event_report(mapped, spark.createDataFrame([("p", 2, -4.0)], "id string, degree int, cents double"))
    assert report.columns == sinks.EVENT_COLUMNS and report.first()["target_note"] == "D4" and report.first()["tuning_cents"] == -4.0
    sinks.write_table(report, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == sinks.EVENT_COLUMNS
    notes = spark.createDataFrame([(1, 0.5, 1.0, 60, 0.9), (1, 0.0, 0.4, 62, 0.8)], "seg int, start_s double, end_s double, pitch int, confidence double")
    docs = sinks.note_documents(notes, "seg")
    sinks.write_documents(docs, str(tmp_path / "json"))
    assert [n["pitch"] for n in docs.first()["notes"]] == [62, 60] and spark.read.json(str(tmp_path / "json")).count() == 1
    read = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", None, "bad")], "path string, x int, error string")
    counts, failures = sinks.corpus_manifest(read, "c")
    assert counts.first()[:4] == ("c", 2, 1, 2) and [tuple(r) for r in failures.collect()] == [("b", "bad")]
    clusters = spark.createDataFrame([(1, 0)], "file_id int, label int")
    roots = spark.createDataFrame([(1, 2, 3.0, 0.5)], "file_id int, root int, score double, margin double")
    assert sinks.assignments(clusters, roots, mapped).first()[1:3] == (1, "D")
