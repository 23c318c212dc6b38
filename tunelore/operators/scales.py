"""Core scales of clusters, by the elbow of their degrees' occupancy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScaleRule:
    """Sizes tried, the coverage a size needs, the penalty of each further degree, and the least share of an auxiliary one."""

    least: int = 5
    most: int = 7
    coverage: float = 0.90
    penalty: float = 0.02
    auxiliary: float = 0.015


#: The scale of a cluster without duration.
EMPTY_SCALE = [0, 2, 4, 5, 7]


def degree_shares(events: DataFrame) -> DataFrame:
    """cluster_id, degree 0..11, frames, share of the cluster's duration; every degree of every cluster.

    Needs cluster_id, degree and frames. A cluster without duration has shares of 0.
    """
    sums = events.groupBy("cluster_id").agg(*(F.sum(F.when(F.col("degree") == d, F.col("frames")).otherwise(0)).alias(f"d{d}") for d in range(12)))
    return shares_of(sums)


def shares_of(sums: DataFrame) -> DataFrame:
    """``degree_shares`` from the sums of each cluster's degrees: cluster_id, d0..d11."""
    total = sum((F.col(f"d{d}") for d in range(12)), F.lit(0))
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("degree"), F.col(f"d{d}").alias("frames")) for d in range(12))))
    return sums.withColumn("_total", total).select("cluster_id", "_total", rows.alias("x")).select("cluster_id", "x.degree", "x.frames", F.coalesce(F.try_divide("x.frames", "_total"), F.lit(0.0)).alias("share"))


def scale_candidates(shares: DataFrame, rule: ScaleRule = ScaleRule()) -> DataFrame:
    """cluster_id, notes, scale, coverage, cutoff_share, next_share, gap, score, eligible for each size tried.

    The tonic is always in; the others enter by share, of equal shares the lower degree first.
    """
    tonic = shares.filter("degree = 0").select("cluster_id", F.col("share").alias("tonic"))
    by = W.partitionBy("cluster_id").orderBy(F.desc("share"), "degree")
    ranked = shares.filter("degree > 0").select("cluster_id", "degree", "share", (F.row_number().over(by) + 1).alias("notes"), F.sum("share").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("sum"), F.collect_list("degree").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("degrees"), F.lead("share").over(by).alias("next"))
    out = ranked.filter(F.col("notes").between(rule.least, rule.most)).join(tonic, "cluster_id")
    gap = F.greatest(F.lit(0.0), F.col("share") - F.coalesce("next", F.lit(0.0)))
    coverage = F.col("tonic") + F.col("sum")
    return out.select(
        "cluster_id", "notes", F.sort_array(F.concat(F.array(F.lit(0)), F.col("degrees"))).alias("scale"), coverage.alias("coverage"), F.col("share").alias("cutoff_share"), F.coalesce("next", F.lit(0.0)).alias("next_share"), gap.alias("gap"),
        (gap - rule.penalty * (F.col("notes") - rule.least)).alias("score"), (coverage >= rule.coverage).alias("eligible"),
    )


def core_scale(shares: DataFrame, rule: ScaleRule = ScaleRule()) -> DataFrame:
    """cluster_id, scale, coverage, reason: the eligible size of the best elbow, the smaller of equals, else the largest size."""
    best = F.struct(F.col("eligible").alias("e"), F.when(F.col("eligible"), F.col("score")).otherwise(F.lit(0.0)).alias("s"), F.when(F.col("eligible"), -F.col("notes")).otherwise(F.col("notes")).alias("n"))
    chosen = scale_candidates(shares, rule).groupBy("cluster_id").agg(F.max_by(F.struct("scale", "coverage", "eligible"), best).alias("x"))
    empty = shares.groupBy("cluster_id").agg((F.sum("frames") <= 0).alias("empty"))
    chosen = chosen.join(empty, "cluster_id")
    return chosen.select(
        "cluster_id", F.when(F.col("empty"), F.array(*map(F.lit, EMPTY_SCALE))).otherwise(F.col("x.scale")).alias("scale"), F.when(F.col("empty"), 0.0).otherwise(F.col("x.coverage")).alias("coverage"),
        F.when(F.col("empty"), "empty_duration_fallback").when(F.col("x.eligible"), "coverage_elbow").otherwise("max_notes_fallback").alias("reason"),
    )


def auxiliary_degrees(shares: DataFrame, scales: DataFrame, rule: ScaleRule = ScaleRule()) -> DataFrame:
    """cluster_id, degree, share of degrees outside the core scale with at least the auxiliary share."""
    core = scales.select("cluster_id", F.explode("scale").alias("degree"))
    return shares.filter(F.col("share") >= rule.auxiliary).join(core, ["cluster_id", "degree"], "left_anti").select("cluster_id", "degree", "share")
