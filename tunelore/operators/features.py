"""Feature vectors of files: five weighted histograms, of unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.rhythm import GRID, nearest_bin, phrase_ratios

#: The blocks' weights.
BLOCK_WEIGHTS = {"degree": 2.5, "interval": 1.4, "signed": 1.15, "cadence": 1.6, "rhythm": 0.65}
STEPS = [*range(-12, 0), *range(1, 13)]
DIMS = 12 + 12 + len(STEPS) + 12 + len(GRID)


def _histogram(column: str, keys: list[int], weight: Column | None = None) -> Column:
    """Sums by key as an array."""
    one = F.lit(1) if weight is None else weight
    return F.array(*(F.coalesce(F.sum(F.when(F.col(column) == k, one)), F.lit(0)) for k in keys))


def _share(counts: Column, weight: float) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)) * weight)


def file_features(events: DataFrame) -> DataFrame:
    """file_id, feature: of events with phrase, seq, degree, frames and midi_cents.

    A file without any step between different notes has zeros in the interval
    blocks.
    """
    return vectors(file_counts(events))


def file_counts(events: DataFrame, degree: str = "degree") -> DataFrame:
    """file_id and its five histograms. One aggregation over events and one window serve all five blocks."""
    by = W.partitionBy("file_id", "phrase").orderBy("seq")
    delta = F.col("midi_cents") - F.lag("midi_cents").over(by)
    size = F.when(delta.isNotNull(), F.least(F.lit(12), F.rint(F.abs(delta) / 100.0).cast("int")))
    rows = phrase_ratios(events).withColumn("_size", size).withColumn("_signed", F.when(delta > 0, F.col("_size")).otherwise(-F.col("_size"))).withColumn("_bin", nearest_bin(F.col("ratio"))).withColumn("_end", F.when(F.col("is_end"), F.col(degree)))
    return rows.groupBy("file_id").agg(
        _histogram(degree, list(range(12)), F.col("frames")).alias("degree"), _histogram("_size", list(range(1, 13))).alias("interval"), _histogram("_signed", STEPS).alias("signed"), _histogram("_end", list(range(12))).alias("cadence"), _histogram("_bin", list(range(len(GRID)))).alias("rhythm"),
    )


def turned(histogram: str, root: Column) -> Column:
    """A histogram over pitch classes as one over the degrees of ``root``."""
    return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda d: F.element_at(F.col(histogram), (F.pmod(root + d, F.lit(12)) + 1).cast("int")))


def vectors(counts: DataFrame) -> DataFrame:
    """file_id, feature: the weighted shares of ``file_counts``, of unit length."""
    raw = counts.select("file_id", F.concat(*(_share(F.col(b), w) for b, w in BLOCK_WEIGHTS.items())).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("_norm", norm).select("file_id", F.when(F.col("_norm") > 0, F.transform("raw", lambda x: x / F.col("_norm"))).otherwise(F.col("raw")).alias("feature"))
