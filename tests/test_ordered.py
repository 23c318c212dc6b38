"""Neighbours and running values against windows, for any cut into chunks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.ordered import Running, _Walk, ordered

WHAT = Running("n", {"prev": "v", "prev_s": "s"}, {"next": "v"}, {"upto": "w"}, {"top": "v"})


def windows(df):
    w = W.partitionBy("k", "k2").orderBy("t", "id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.lag("v").over(w).alias("prev"), F.lag("s").over(w).alias("prev_s"), F.lead("v").over(w).alias("next"), F.sum(F.coalesce("w", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.max(F.col("v").cast("double")).over(before).alias("top"))


def some(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, None, i]), rng.choice(["a", "b", None]), rng.randint(0, 50), i, rng.choice([None, rng.randint(-9, 9)]), rng.choice([None, rng.randint(0, 5)]), f"s{i}", i) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_equals_windows(spark, partitions, parts):
    partitions(parts)
    df = spark.createDataFrame(some(parts, 300), "k long, k2 string, t int, id long, v int, w long, s string, _before int")
    got = ordered(df, ["k", "k2"], ["t", "id"], WHAT)
    expected = windows(df)
    assert set(got.columns) == set(expected.columns)
    key = lambda r: r["id"]
    assert [r.asDict() for r in sorted(got.select(*expected.columns).collect(), key=key)] == [r.asDict() for r in sorted(expected.collect(), key=key)]
    assert ordered(df.limit(0), ["k", "k2"], ["t", "id"], WHAT).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pieces_carry_on(seed):
    rng = random.Random(seed)
    key = sorted(rng.choice([1, 2, 3]) for _ in range(60))
    v = [rng.randint(-5, 5) for _ in key]
    table = pa.table({"k": key, "v": v})
    what = Running("n", {"prev": "v"}, {}, {"upto": "v"}, {"top": "v"})
    whole, _ = _Walk(["k"], what).take(table)
    walk, parts, at = _Walk(["k"], what), [], 0
    while at < len(key):
        size = rng.randint(1, 9)
        parts.append(walk.take(table.slice(at, size))[0])
        at += size
    assert pa.concat_tables(parts).to_pydict() == whole.to_pydict()
    assert whole.column("n").to_pylist() == [int(x) for k in np.unique(key) for x in range(1, key.count(k) + 1)]
