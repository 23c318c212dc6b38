"""Counts of melodic grammar over in-scale runs: intervals, transitions, n-grams, cadences.

A run is a stretch of a phrase without an out-of-scale note; equal neighbouring
degrees count once in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scale_runs(events: DataFrame) -> DataFrame:
    """In-scale events with ``run`` (numbered in the phrase), without those that repeat the degree before them.

    Needs cluster_id, file_id, phrase, seq, degree, midi_cents, in_scale.
    """
    by = W.partitionBy("file_id", "phrase").orderBy("seq")
    runs = events.withColumn("run", F.count_if(~F.col("in_scale")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    # the event before, in or out of scale, decides: an equal in-scale neighbour is always in the same run
    before = F.struct("in_scale", "degree")
    kept = runs.withColumn("_before", F.lag(before).over(by)).filter(F.col("in_scale") & ~F.coalesce(F.col("_before.in_scale") & (F.col("_before.degree") == F.col("degree")), F.lit(False)))
    return kept.drop("_before")


def _in_run(runs: DataFrame):
    return W.partitionBy("file_id", "phrase").orderBy("seq")


def interval_steps(runs: DataFrame) -> DataFrame:
    """Steps between neighbours of a run: cluster_id, file_id, a, b (degrees), delta (cents), interval 1..12; none of interval 0."""
    by = _in_run(runs)
    steps = runs.select("cluster_id", "file_id", F.lag("run").over(by).alias("_run"), "run", F.lag("degree").over(by).alias("a"), F.col("degree").alias("b"), (F.col("midi_cents") - F.lag("midi_cents").over(by)).alias("delta"))
    steps = steps.filter(F.col("run") == F.col("_run")).withColumn("interval", F.least(F.lit(12), F.rint(F.abs("delta") / 100.0).cast("int")))
    return steps.filter("interval > 0").drop("_run", "run")


def interval_histogram(steps: DataFrame) -> DataFrame:
    return steps.groupBy("cluster_id", "interval").agg(F.count("*").alias("n"))


def transition_counts(steps: DataFrame) -> DataFrame:
    """cluster_id, a, b, n, ascending (more than 35 cents up), descending."""
    return steps.groupBy("cluster_id", "a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 35).alias("ascending"), F.count_if(F.col("delta") < -35).alias("descending"))


def run_ngrams(runs: DataFrame, longest: int = 5) -> DataFrame:
    """All n-grams of 2..``longest`` degrees: cluster_id, file_id, n, ngram. One window serves every length."""
    by = _in_run(runs)
    ahead = runs.select("cluster_id", "file_id", "degree", "run", *(F.lead("run", i).over(by).alias(f"r{i}") for i in range(1, longest)), *(F.lead("degree", i).over(by).alias(f"d{i}") for i in range(1, longest)))
    grams = F.array(*(F.when(F.col(f"r{n - 1}") == F.col("run"), F.struct(F.lit(n).alias("n"), F.concat_ws(">", "degree", *(f"d{i}" for i in range(1, n))).alias("ngram"))) for n in range(2, longest + 1)))
    return ahead.select("cluster_id", "file_id", F.explode(F.filter(grams, lambda x: x.isNotNull())).alias("g")).select("cluster_id", "file_id", "g.n", "g.ngram")


def ngram_support(ngrams: DataFrame) -> DataFrame:
    """cluster_id, n, ngram, count, files: occurrences and distinct files, pre-aggregated by file."""
    by_file = ngrams.groupBy("cluster_id", "n", "ngram", "file_id").agg(F.count("*").alias("c"))
    return by_file.groupBy("cluster_id", "n", "ngram").agg(F.sum("c").alias("count"), F.count("*").alias("files"))


def cadences(events: DataFrame, runs: DataFrame, longest: int = 4) -> DataFrame:
    """Cadence patterns: cluster_id, n (1: the final degree alone), ngram, count, files.

    A phrase has a cadence if its last note is in the scale; patterns are the
    suffixes of its last run, which then ends on that degree.
    """
    ends = events.groupBy("cluster_id", "file_id", "phrase").agg(F.max_by("in_scale", "seq").alias("ends_in"))
    good = ends.filter("ends_in").select("cluster_id", "file_id", "phrase")
    back = W.partitionBy("file_id", "phrase").orderBy(F.desc("seq"))
    last = runs.select("file_id", "phrase", "degree", "run", F.row_number().over(back).alias("back"), F.max("run").over(W.partitionBy("file_id", "phrase")).alias("last_run")).filter((F.col("back") <= longest) & (F.col("run") == F.col("last_run")))
    tails = last.groupBy("file_id", "phrase").agg(*(F.max(F.when(F.col("back") == i, F.col("degree"))).alias(f"b{i}") for i in range(1, longest + 1)))
    suffix = F.array(*(F.when(F.col(f"b{n}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(">", *(f"b{i}" for i in range(n, 0, -1))).alias("ngram"))) for n in range(1, longest + 1)))
    rows = good.join(tails, ["file_id", "phrase"]).select("cluster_id", "file_id", F.explode(F.filter(suffix, lambda x: x.isNotNull())).alias("g")).select("cluster_id", "file_id", "g.n", "g.ngram")
    return ngram_support(rows)
