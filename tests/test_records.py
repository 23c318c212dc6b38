"""Choice of records, drums, file sizes, and folders of files."""

import pytest

from tunelore.operators.events import file_sizes, large_enough
from tunelore.operators.matching import choose_records
from tunelore.operators.monophony import without_drums
from tunelore.sources import lists, renderers, scores
from tunelore.staging import shared_folder


def test_choice_by_kind_size_and_path(spark):
    rows = [(1, "MID", 5, "a", 1), (1, "ust", 9, "b", 1), (1, "ust", 9, "c", 1), (2, "zzz", 1, "d", 1), (None, "ust", 1, "e", 1), (None, None, 8, "f", 1), (3, "mid", None, "g", 1), (3, "mid", 2, "h", 1)]
    df = spark.createDataFrame(rows, "grp long, kind string, size long, path string, a int")
    got = choose_records(df, "grp", "kind", "size", "path", {"mid": 1, "ust": 2})
    assert sorted(r["path"] for r in got.filter("chosen").collect()) == ["b", "d", "e", "g"] and got.count() == len(rows)
    assert choose_records(df.limit(0), "grp", "kind", "size", "path", {"mid": 1}).count() == 0


def test_drums_are_left_out_and_unknown_channels_stay(spark):
    df = spark.createDataFrame([(9, 1), (0, 2), (None, 3)], "channel int, note int")
    assert sorted(r["note"] for r in without_drums(df).collect()) == [2, 3]


def test_small_files_are_told_and_left_out(spark):
    rows = [(1, 0), (1, 0), (2, 0), (2, 0), (2, 1), (3, None), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "file_id long, phrase long")
    assert {r["file_id"]: (r["n_events"], r["n_phrases"], r["reason"]) for r in file_sizes(df).collect()} == {1: (2, 1, "few_events"), 2: (3, 2, None), 3: (3, 0, "no_phrase")}
    assert {r["file_id"] for r in large_enough(df).collect()} == {2} and large_enough(df.limit(0)).count() == 0


def test_more_than_99_files_of_a_case(spark):
    df = spark.createDataFrame([("x_test", f"n{i}") for i in range(120)], "case string, name string")
    names = [r["blind_filename"] for r in lists.blind_pack(df, "case", "name", 3).collect()]
    assert len(set(names)) == 120 and "x_test_07.wav" in names and "x_test_120.wav" in names


def test_files_of_every_format_are_written_and_read(spark, tmp_path):
    notes = [(0, 480, 60, "la"), (480, 240, 61, "a & b"), (960, 120, 72, "so")]
    df = spark.createDataFrame([(7, *n) for n in notes], "song long, start long, duration long, pitch int, lyric string")
    for suffix, render in (("vsqx", renderers.vsqx), ("ustx", renderers.ustx), ("ust", renderers.ust)):
        assert scores.write_files(renderers.rendered(df, render, suffix), f"file://{tmp_path}/{suffix}/deep") == 1
        got = scores.read_projects(spark, f"{tmp_path}/{suffix}").orderBy("start").collect()
        assert [(r["start"], r["duration"], r["pitch"], r["lyric"]) for r in got] == notes
        assert {r["tempo"] for r in got} == {None if suffix == "vsqx" else 120.0}
    scores.write_files(renderers.rendered(df, renderers.musicxml, "xml"), f"{tmp_path}/xml")
    assert {r["tempo"] for r in scores.read_musicxml(spark, f"{tmp_path}/xml").collect()} == {100.0}
    assert list(scores.parse_musicxml(b"<score-partwise><part><measure><note><rest/><duration>1</duration></note></measure></part></score-partwise>"))[0][-1] == 120.0
    assert not list(tmp_path.rglob("*.part-*"))
    assert scores.write_files(renderers.rendered(df.limit(0), renderers.midi, "mid"), f"{tmp_path}/none") == 0


def test_a_cluster_without_shared_folder_fails():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_restarts_find_the_blobs_and_reseed(spark):
    import numpy as np

    from tunelore.operators.clustering import kmeans

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6)) * 8
    points = [(i, (centres[i % 4 if i < 80 else 0] + rng.normal(size=6) * 0.1).tolist()) for i in range(120)]
    df = spark.createDataFrame(points, "file_id long, feature array<double>")
    got = {r["file_id"]: r["label"] for r in kmeans(df, 4, restarts=8).collect()}
    assert len({got[i] for i in range(4)}) == 4 and all(got[i] == got[i % 4 if i < 80 else 0] for i in range(120)) and got[0] == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "file_id long, feature array<double>")
    assert kmeans(same, 2, restarts=2).count() == 9
