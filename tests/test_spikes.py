"""Faulty measurements against a plain computation."""

import math
import random
import statistics

import pytest

from tunelore.operators.spikes import Field, Measured, readings
from tunelore.operators.spikes import spikes as all_spikes

SCHEMA = "note_id bigint, source_id bigint, t double, pitch double, field string, value int, source string"
FIELDS = [Field("pitch", 0, 127, 4)]


def spikes(df, source, order, ident, fields, season=None, sigmas=None):
    return all_spikes([Measured(df, source, order, ident, fields, season)], sigmas=sigmas)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for s in (1, 2, None):
        for i in range(n):
            v = rng.gauss(60, 3)
            if rng.random() < 0.01:
                v = rng.choice([-4.0, 400.0, 95.0, 20.0])
            if rng.random() < 0.05:
                v = rng.choice([None, float("nan")])
            rows.append((len(rows), s, float(i), v, "x", 1, "y"))
        for i in range(100, 105):
            rows[-n + i] = rows[-n + i][:3] + (61.5,) + rows[-n + i][4:]
    return rows + rows[::7]


def plain_cases(rows, sigmas, stuck=4):
    cases = set()
    for s in {r[1] for r in rows}:
        own = sorted({r for r in rows if r[1] == s and r[3] is not None and r[3] == r[3]}, key=lambda r: (r[2], r[0]))
        values = [r[3] for r in own]
        bad, at = set(), 0
        while at < len(values):
            to = at
            while to < len(values) and values[to] == values[at]:
                to += 1
            bad |= set(range(at, to)) if to - at >= stuck else set()
            at = to
        bad |= {i for i, v in enumerate(values) if not 0 <= v <= 127}
        rest = [i for i in range(len(values)) if i not in bad]
        good = [i for i in rest if abs(values[i] - 60) < 18]
        for _ in range(20):
            m, d = statistics.fmean(values[i] for i in good), statistics.pstdev([values[i] for i in good])
            good = [i for i in rest if abs(values[i] - m) <= sigmas * d]
        cases |= {own[i][0] for i in bad | (set(rest) - set(good))}
    return cases


@pytest.mark.parametrize("parts", [2, 40])
def test_equals_a_plain_computation(spark, partitions, parts):
    partitions(parts)
    rows = rows_of(parts)
    out = spikes(spark.createDataFrame(rows, SCHEMA), "source_id", ["t"], "note_id", FIELDS, sigmas=6).collect()
    assert len(out) == len({r["record_id"] for r in out})
    assert {r["record_id"] for r in out} == plain_cases(rows, 6)


def test_stuck_over_many_chunks(spark, partitions):
    partitions(50)
    rows = [(i, 1, float(i), 50.0 if i < 30 else 40.0 + i % 7, "x", 1, "y") for i in range(100)]
    out = spikes(spark.createDataFrame(rows, SCHEMA), "source_id", ["t"], "note_id", [Field("pitch", 0, 127, 30)], sigmas=6).collect()
    assert {(r["record_id"], r["reason"]) for r in out} == {(i, "stuck") for i in range(30)}


def test_tail_cutoffs_flag_what_is_far_out(spark):
    rng = random.Random(3)
    rows = [(i, 1, float(i), rng.gauss(60, 2), "x", 1, "y") for i in range(3000)] + [(5000, 1, 1e6, 85.0, "x", 1, "y")]
    out = spikes(spark.createDataFrame(rows, SCHEMA), "source_id", ["t"], "note_id", FIELDS).collect()
    assert [r["record_id"] for r in out] == [5000] and out[0]["reason"] == "tail"


def test_season_is_taken_out(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, 1, float(i), rng.gauss(20 if i % 2 else 100, 1), "x", 1, "y") for i in range(2000)] + [(5001, 1, 5001.0, 60.0, "x", 1, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = spikes(df, "source_id", ["t"], "note_id", FIELDS, season=F.col("note_id") % 2).collect()
    assert [r["record_id"] for r in out] == [5001]


def test_empty_missing_and_constant(spark):
    assert spikes(spark.createDataFrame([], SCHEMA), "source_id", ["t"], "note_id", FIELDS, sigmas=6).count() == 0
    rows = [(1, 1, None, None, None, None, None), (2, None, 1.0, math.nan, None, None, None), (3, None, 2.0, 50.0, None, None, None)]
    assert spikes(spark.createDataFrame(rows, SCHEMA), "source_id", ["t"], "note_id", FIELDS, sigmas=6).count() == 0


@pytest.mark.parametrize("parts", [6, 40])
def test_copies_over_many_chunks_come_out_once(spark, partitions, parts):
    partitions(parts)
    rng = random.Random(6)
    rows = [(i, 1, float(i), 400.0 if i in (50, 120) else rng.gauss(60, 3), "x", 1, "y") for i in range(200)]
    rows += [rows[50]] * 300 + [rows[60]] * 200 + [rows[120]] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    out = spikes(df, "source_id", ["t"], "note_id", FIELDS, sigmas=6).collect()
    assert sorted((r["record_id"], r["reason"]) for r in out) == [(50, "range+tail"), (120, "range+tail")]
    faulty, counts = readings(Measured(df, "source_id", ["t"], "note_id", FIELDS))
    assert faulty.count() == 2 and sum(r["held"] for r in counts.collect()) == 198
