"""Runs of like events against a plain loop, for any cut into chunks."""

import random

import numpy as np
import pytest

from tunelore.llm.event_runs import collapse_repeats, runs
from tunelore.operators.runs import Likeness

RUNS = "file_id bigint, start_frame bigint, end_frame bigint, source_midi double, event_id bigint, key string, chunk int"
LIKE = Likeness(0.5, 15)


def plain_runs(rows, like=LIKE, least=1):
    events = sorted({r[:5] for r in rows if None not in r[:3]}, key=lambda r: (r[0], r[1], r[4]))
    out = []
    for f, s, e, v, _ in events:
        v = None if v is None or v != v else v
        last = out[-1] if out else None
        near = last and last[0] == f and v is not None and last[5] is not None and (abs(v - last[5]) < like.tolerance if like.tolerance else v == last[5])
        if near and (like.max_gap is None or s - last[4] <= like.max_gap):
            last[2], last[3], last[4], last[5] = max(last[2], e), last[3] + 1, e, v
        else:
            out.append([f, s, e, 1, e, v])
    return sorted((f, s, e, n) for f, s, e, n, _, _ in out if n >= least)


def some_rows(seed, n, files=3, copies=0.2):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        at = 0
        for _ in range(n):
            at += rng.choice([0, 5, 15, 16, 30]) + 1
            end = at + rng.randint(1, 20)
            rows.append((f, at, end, rng.choice([60.0, 60.2, 60.4, 61.0, None, float("nan")]), len(rows), "x", 7))
            if rng.random() < 0.7:
                at = end
    return rows + [r for r in rows if rng.random() < copies]


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, RUNS)
    out = runs(df, "file_id", "start_frame", "end_frame", "source_midi", "event_id", LIKE, **kw).collect()
    return sorted((r["key"], r["start"], r["end"], r["n"]) for r in out)


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_equals_a_loop(spark, partitions, parts):
    partitions(parts)
    rows = some_rows(parts, 60)
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == plain_runs(rows)
    assert found(spark, rows, min_count=2) == plain_runs(rows, least=2)


def test_one_run_over_all_chunks_and_copies_of_one_row(spark, partitions):
    partitions(20)
    long = [(1, i, i + 1, 60.0, i, "x", 0) for i in range(400)]
    copies = [(2, 5, 9, 61.0, 1000, "x", 0)] * 400
    assert found(spark, long + copies) == [(1, 0, 400, 400), (2, 5, 9, 1)]


def test_nulls_and_empty(spark):
    rows = [(None, 1, 2, 60.0, 1, None, None), (1, None, 2, 60.0, 2, None, None), (1, 1, None, 60.0, 3, None, None), (1, 1, 2, None, None, None, None), (1, 3, 4, 60.0, None, None, None)]
    assert found(spark, rows) == [(1, 1, 2, 1), (1, 3, 4, 1)]
    assert found(spark, []) == []


def test_merging_over_several_levels(spark, partitions, monkeypatch):
    monkeypatch.setattr("tunelore.operators.runs.FAN", 3)
    partitions(30)
    rows = some_rows(9, 80, files=2)
    assert found(spark, rows) == plain_runs(rows)


def test_one_partition_of_many_batches(spark, partitions):
    """More rows than a task holds at once, all in one partition, one run over the cut."""
    partitions(1)
    n = 300_000
    rng = np.random.default_rng(1)
    value = np.repeat(rng.integers(0, 50, n // 10), 10).astype(float)
    value[100_000:200_000] = 7.0
    df = spark.range(n).selectExpr("1L as file_id", "id as start_frame", "id + 1 as end_frame", "cast(id as double) as source_midi", "id as event_id").drop("source_midi")
    import pandas as pd

    values = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(n), "source_midi": value}))
    got = sorted((r["start"], r["n"]) for r in runs(df.join(values, "event_id"), "file_id", "start_frame", "end_frame", "source_midi", "event_id", LIKE).collect())
    at = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    assert got == list(zip(at.tolist(), np.diff(np.append(at, n)).tolist()))


SCHEMA = "event_id bigint, file_id bigint, start_frame bigint, end_frame bigint, source_midi double, key int, n int, slot string"


def test_chain_separators_and_copies(spark):
    rows = [
        (1, 1, 0, 10, 60.0), (2, 1, 12, 30, 60.4), (3, 1, 20, 25, 60.8), (4, 1, 40, 50, 60.7), (5, 1, 66, 70, 60.7),
        (6, 1, 70, 71, None), (7, 1, 71, 80, 60.7), (8, 2, 81, 90, 60.7), (9, 2, 91, 95, float("nan")), (10, 2, 96, 99, 60.7),
    ]
    df = spark.createDataFrame([(*r, 1, 1, "x") for r in rows + rows[:3]], SCHEMA)
    got = {(r["file_id"], r["start_frame"], r["end_frame"], r["n_events"], r["frames"]) for r in collapse_repeats(df).collect()}
    assert got == {(1, 0, 50, 4, 50), (1, 66, 70, 1, 4), (1, 70, 71, 1, 1), (1, 71, 80, 1, 9), (2, 81, 90, 1, 9), (2, 91, 95, 1, 4), (2, 96, 99, 1, 3)}
    assert [r["n_events"] for r in collapse_repeats(df, min_count=2).collect()] == [4]
    assert collapse_repeats(df.limit(0)).count() == 0
