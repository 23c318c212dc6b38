"""Keys, beat phases, stem roles and nearest scale notes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published key profiles of the major and minor modes.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
#: Words in a stem's name and its role, the first that occurs.
STEM_WORDS = [("vocal", "vocals"), ("drum", "drums"), ("bass", "bass"), ("other", "other"), ("guitar", "guitar"), ("piano", "piano"), ("instrumental", "instrumental"), ("karaoke", "instrumental")]


def detect_keys(events: DataFrame, weight: str = "frames") -> DataFrame:
    """file_id, root, mode, score: the mode and root whose profile correlates best with the file's pitch-class durations.

    Of equal scores the lower root wins, then major. Needs file_id and pc.
    """
    sums = events.groupBy("file_id").agg(F.array(*(F.sum(F.when(F.col("pc") == i, F.col(weight)).otherwise(0)) for i in range(12))).alias("_h"))
    norm = F.sqrt(F.aggregate("_h", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = sums.withColumn("_n", norm)

    def score(profile: list[float], root: int) -> Column:
        size = math.sqrt(sum(p * p for p in profile))
        return sum((F.col("_h")[(root + i) % 12] * (p / size) for i, p in enumerate(profile)), F.lit(0.0)) / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)

    tries = [F.struct(score(p, r).alias("score"), F.lit(-(2 * r + m)).alias("rank"), F.lit(r).alias("root"), F.lit(name).alias("mode")) for r in range(12) for m, (name, p) in enumerate((("major", MAJOR), ("minor", MINOR)))]
    return unit.withColumn("_b", F.array_max(F.array(*tries))).select("file_id", "_b.root", "_b.mode", "_b.score")


def beat_phases(beats: DataFrame, beats_per_bar: int = 4) -> DataFrame:
    """file_id, phase, score: the phase whose beats are strongest, a quarter of their lead over the next beat added.

    beats (file_id, beat, strength), without holes. A phase needs two beats;
    of equal scores the lower phase wins.
    """
    from pyspark.sql import Window as W

    near = beats.withColumn("_next", F.lead("strength").over(W.partitionBy("file_id").orderBy("beat")))
    phases = near.groupBy("file_id", (F.col("beat") % beats_per_bar).alias("phase")).agg(F.avg("strength").alias("_mean"), F.coalesce(F.avg(F.col("strength") - F.col("_next")), F.lit(0.0)).alias("_lead"), F.count("*").alias("_n")).filter("_n >= 2")
    scored = phases.withColumn("score", F.col("_mean") + 0.25 * F.col("_lead"))
    return scored.groupBy("file_id").agg(F.max_by("phase", F.struct("score", -F.col("phase"))).alias("phase"), F.max("score").alias("score"))


def stem_role(name: Column) -> Column:
    """The role that a stem's file name tells, null if none."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for word, role in reversed(STEM_WORDS):
        out = F.when(F.contains(low, F.lit(word)), role).otherwise(out)
    return out


def nearest_scale_notes(pitch: Column, root: Column, scale: list[int], shift: float, most: int) -> Column:
    """Scale notes of 0..127 within ``shift`` of a pitch, the nearest first, the lower of equals, at most ``most``; the nearest one if none is."""
    in_scale = F.filter(F.sequence(F.lit(0), F.lit(127)), lambda n: F.array_contains(F.array(*map(F.lit, scale)), F.pmod(n - root, F.lit(12)).cast("int")))
    ranked = F.array_sort(F.transform(in_scale, lambda n: F.struct(F.abs(n - pitch).alias("away"), n.alias("note"))))
    near = F.slice(F.filter(ranked, lambda x: x["away"] <= shift), 1, most)
    return F.transform(F.when(F.size(near) > 0, near).otherwise(F.slice(ranked, 1, 1)), lambda x: x["note"])
