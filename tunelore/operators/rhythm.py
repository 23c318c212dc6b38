"""Registers, duration ratios and micro-tuning of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The grid of duration ratios.
GRID = [0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0]
QUANTILES = {"p10": 0.10, "q1": 0.25, "median": 0.50, "q3": 0.75, "p90": 0.90}


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """Of each group the least value whose cumulative weight reaches each share of the total.

    Rows are summed by value first, so that the running sums are over distinct
    values; null and NaN values and weights that aren't positive are left out.
    """
    sound = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(weight) > 0))
    sums = sound.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    order = W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    running = sums.select(*by, "_v", F.sum("_w").over(order).alias("_c"), F.sum("_w").over(W.partitionBy(*by)).alias("_t"))
    return running.groupBy(*by).agg(*(F.min(F.when(F.col("_c") >= q * F.col("_t"), F.col("_v"))).alias(name) for name, q in quantiles.items()))


def register_profile(events: DataFrame) -> DataFrame:
    """Of each cluster: duration-weighted quantiles of midi_cents, least and largest, spread, count and weight."""
    q = weighted_quantiles(events, ["cluster_id"], "midi_cents", "frames", QUANTILES)
    ends = events.groupBy("cluster_id").agg(F.min("midi_cents").alias("observed_min"), F.max("midi_cents").alias("observed_max"), F.count("*").alias("event_count"), F.sum("frames").alias("weight"))
    return q.join(ends, "cluster_id").withColumns({"iqr": F.col("q3") - F.col("q1"), "preferred_range": F.col("p90") - F.col("p10")})


def phrase_ratios(events: DataFrame) -> DataFrame:
    """``events`` with ``ratio``: frames over the phrase's median frames, and ``is_end`` of the phrase."""
    medians = events.groupBy("file_id", "phrase").agg(F.percentile("frames", F.lit(0.5)).alias("_m"), F.max("seq").alias("_last"))
    return events.join(medians, ["file_id", "phrase"]).withColumn("ratio", F.col("frames") / F.greatest(F.col("_m"), F.lit(1e-6))).withColumn("is_end", F.col("seq") == F.col("_last")).drop("_m", "_last")


def duration_multipliers(ratios: DataFrame, min_count: int = 4) -> DataFrame:
    """cluster_id, degree, n, multiplier: median in-scale ratio in 0.70..1.50 where it is at least 0.04 from 1."""
    m = ratios.filter("in_scale").groupBy("cluster_id", "degree").agg(F.count("*").alias("n"), F.percentile("ratio", F.lit(0.5)).alias("m")).filter(F.col("n") >= min_count)
    value = F.least(F.lit(1.50), F.greatest(F.lit(0.70), F.col("m")))
    return m.filter(F.abs(value - 1.0) >= 0.04).select("cluster_id", "degree", "n", F.round(value, 4).alias("multiplier"))


def phrase_end_ratio(ratios: DataFrame) -> DataFrame:
    """cluster_id, n, multiplier: median ratio of in-scale phrase ends, in 0.80..1.80."""
    m = ratios.filter("is_end and in_scale").groupBy("cluster_id").agg(F.count("*").alias("n"), F.percentile("ratio", F.lit(0.5)).alias("m"))
    return m.select("cluster_id", "n", F.round(F.least(F.lit(1.80), F.greatest(F.lit(0.80), F.col("m"))), 4).alias("multiplier"))


def nearest_bin(ratio: Column) -> Column:
    """The number (from 0) of the grid's ratio nearest in log, the first of equals; ratios are clipped to 0.20..4.5."""
    clipped = F.log(F.least(F.lit(4.5), F.greatest(F.lit(0.20), ratio)))
    away = F.transform(F.array(*(F.log(F.lit(g)) for g in GRID)), lambda g: F.abs(g - clipped))
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def rhythm_bins(ratios: DataFrame, most: int = 6) -> DataFrame:
    """cluster_id, bin, n of the clusters' most used grid ratios; bin 5 (ratio 1) is always there."""
    counts = ratios.filter("in_scale").groupBy("cluster_id", nearest_bin(F.col("ratio")).alias("bin")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("n"), "bin")))
    one = counts.select("cluster_id").distinct().select("cluster_id", F.lit(GRID.index(1.0)).alias("bin"))
    chosen = ranked.filter(F.col("rank") <= most).select("cluster_id", "bin").unionByName(one).distinct()
    return chosen.join(counts, ["cluster_id", "bin"], "left").select("cluster_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def micro_tuning(events: DataFrame, min_count: int = 4) -> DataFrame:
    """cluster_id, degree, n, cents: median of in-scale residuals against the file's own tuning, without outliers.

    Residuals beyond max(8, 3.5 MAD) of the median are left out where the MAD
    is positive; values under 2 cents and degrees of too few notes come not out.
    """
    least = max(5, 2 * min_count)
    wrap = lambda c: F.pmod(c + 50.0, F.lit(100.0)) - 50.0
    residual = wrap(F.col("midi_cents") - 100.0 * F.rint(F.col("midi_cents") / 100.0))
    own = events.withColumn("_r", residual)
    tuning = own.groupBy("file_id").agg(F.percentile("_r", F.lit(0.5)).alias("_tuning"))
    rows = own.join(tuning, "file_id").filter("in_scale").select("cluster_id", "degree", wrap(F.col("_r") - F.col("_tuning")).alias("c"))
    by = ["cluster_id", "degree"]
    med = rows.groupBy(*by).agg(F.percentile("c", F.lit(0.5)).alias("med"), F.count("*").alias("n0")).filter(F.col("n0") >= least)
    away = rows.join(med, by)
    mad = away.groupBy(*by).agg(F.percentile(F.abs(F.col("c") - F.col("med")), F.lit(0.5)).alias("mad"))
    kept = away.join(mad, by).filter((F.col("mad") <= 0) | (F.abs(F.col("c") - F.col("med")) <= F.greatest(F.lit(8.0), 3.5 * F.col("mad"))))
    out = kept.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("c", F.lit(0.5)).alias("m")).filter(F.col("n") >= least)
    cents = F.least(F.lit(35.0), F.greatest(F.lit(-35.0), F.col("m")))
    return out.filter(F.abs(cents) >= 2.0).select(*by, "n", F.round(cents, 2).alias("cents"))
