"""Tonic (root) estimates of files, without and with a known scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the generic estimate's terms.
GENERIC = {"ending": 2.20, "final": 1.25, "duration": 1.00, "count": 0.30, "fifth": 0.30, "fourth": 0.12}
#: Weights of the scale-aware estimate's terms.
SCALE_AWARE = {"coverage": 4.00, "ending": 1.80, "final": 0.95, "duration": 0.75, "count": 0.18, "fifth": 0.22, "fourth": 0.10}
PCS = list(range(12))


def occupancy(phrased: DataFrame) -> DataFrame:
    """Of each file: duration, count and phrase-ending arrays over the 12 pitch classes, and final_pc.

    A note weighs its frames, at least 1.
    """
    weight = F.greatest(F.lit(1), F.col("frames"))
    by_phrase = phrased.groupBy("file_id", "phrase").agg(
        F.max_by("pc", "seq").alias("end_pc"), F.max("seq").alias("end_seq"), *(F.sum(F.when(F.col("pc") == i, weight).otherwise(0)).alias(f"d{i}") for i in PCS), *(F.count_if(F.col("pc") == i).alias(f"n{i}") for i in PCS)
    )
    return by_phrase.groupBy("file_id").agg(
        F.array(*(F.sum(f"d{i}") for i in PCS)).alias("duration"), F.array(*(F.sum(f"n{i}") for i in PCS)).alias("count"), F.array(*(F.count_if(F.col("end_pc") == i) for i in PCS)).alias("ending"), F.max_by("end_pc", "end_seq").alias("final_pc"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def _at(shares: Column, root: Column, step: int) -> Column:
    return F.element_at(shares, ((root + step) % 12 + 1).cast("int"))


def _best(occ: DataFrame, score) -> DataFrame:
    """The best root with score and margin to the next; of equal roots the higher."""
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda r: F.struct(score(r).alias("score"), r.alias("root"))), asc=False)
    return occ.withColumn("_ranked", ranked).withColumns({"root": F.col("_ranked")[0]["root"], "score": F.col("_ranked")[0]["score"], "margin": F.col("_ranked")[0]["score"] - F.col("_ranked")[1]["score"]}).drop("_ranked")


def root_generic(phrased: DataFrame) -> DataFrame:
    """file_id, root, score, margin: the tonic from phrase endings, the final note and occupancy."""
    return generic_roots_of(occupancy(phrased))


def generic_roots_of(occupied: DataFrame) -> DataFrame:
    """``root_generic`` from the files' ``occupancy``."""
    occ = occupied.withColumns({c: _shares(F.col(c)) for c in ("duration", "count", "ending")})
    w = GENERIC

    def score(r: Column) -> Column:
        return (
            w["ending"] * _at(F.col("ending"), r, 0) + w["final"] * F.when(r == F.col("final_pc"), 1.0).otherwise(0.0) + w["duration"] * _at(F.col("duration"), r, 0) + w["count"] * _at(F.col("count"), r, 0)
            + w["fifth"] * _at(F.col("duration"), r, 7) + w["fourth"] * _at(F.col("duration"), r, 5)
        )

    return _best(occ, score).select("file_id", "root", "score", "margin")


def root_with_scale(phrased: DataFrame, scales: DataFrame) -> DataFrame:
    """file_id, root, score, margin, coverage: the tonic given each file's cluster scale.

    ``phrased`` has cluster_id; ``scales`` has cluster_id and scale (array of degrees).
    """
    clusters = phrased.groupBy("file_id").agg(F.first("cluster_id").alias("cluster_id"))
    return roots_of(occupancy(phrased).join(clusters, "file_id"), scales)


def roots_of(occupied: DataFrame, scales: DataFrame) -> DataFrame:
    """``root_with_scale`` from the files' ``occupancy`` with their cluster_id."""
    occ = occupied.withColumns({c: _shares(F.col(c)) for c in ("duration", "count", "ending")}).join(scales.select("cluster_id", "scale"), "cluster_id")
    w = SCALE_AWARE

    def coverage(r: Column) -> Column:
        return F.aggregate(F.col("scale"), F.lit(0.0), lambda a, d: a + F.element_at(F.col("duration"), ((r + d) % 12 + 1).cast("int")))

    def score(r: Column) -> Column:
        has = lambda d: F.array_contains("scale", d).cast("double")
        return (
            w["coverage"] * coverage(r) + w["ending"] * _at(F.col("ending"), r, 0) + w["final"] * F.when(r == F.col("final_pc"), 1.0).otherwise(0.0) + w["duration"] * _at(F.col("duration"), r, 0) + w["count"] * _at(F.col("count"), r, 0)
            + w["fifth"] * has(7) * _at(F.col("duration"), r, 7) + w["fourth"] * has(5) * _at(F.col("duration"), r, 5)
        )

    best = _best(occ, score)
    return best.select("file_id", "cluster_id", "root", "score", "margin", coverage(F.col("root")).alias("coverage"))
