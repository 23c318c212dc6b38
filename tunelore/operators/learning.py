"""Learned profiles: the weights of all clusters as one JSON document each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.operators import grammar, rhythm, scales, weights
from tunelore.staging import stage


def _map(df: DataFrame, key, name: str) -> DataFrame:
    """cluster_id and a map of at most a list's cap of entries."""
    return df.groupBy("cluster_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.cast("string"), "weight")))).alias(name))


def _patterns(df: DataFrame, name: str) -> DataFrame:
    degrees = F.transform(F.split("ngram", ">"), lambda d: d.cast("int"))
    return df.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct(degrees.alias("degrees"), "weight"))).alias(name))


def learn_profiles(events: DataFrame) -> DataFrame:
    """One row per cluster, in the form of a profile without its defaults, all clusters in one pass.

    events: phrased, rooted events with cluster_id and degree. What a cluster
    has too few notes for is left out of its profile.
    """
    events = stage(events, "learned")
    shares = stage(scales.degree_shares(events), "shares")
    core = stage(scales.core_scale(shares), "scales")
    scaled = stage(events.join(core.select("cluster_id", "scale"), "cluster_id").withColumn("in_scale", F.array_contains("scale", F.col("degree"))).drop("scale"), "scaled")
    runs = stage(grammar.scale_runs(scaled), "runs")
    steps = stage(grammar.interval_steps(runs), "steps")
    support = stage(grammar.ngram_support(grammar.run_ngrams(runs)), "support")
    degrees = stage(scaled.filter("in_scale").groupBy("cluster_id", "degree").agg(F.count("*").alias("n")), "degrees")
    files = scaled.groupBy("cluster_id").agg(F.countDistinct("file_id").alias("n_files"), F.count("*").alias("n_events"))
    transitions = stage(grammar.transition_counts(steps), "transitions")
    cadences = stage(weights.cadence_weights(grammar.cadences(scaled, runs), support, degrees, files), "cadences")
    ratios = stage(rhythm.phrase_ratios(scaled), "ratios")
    pair = F.concat_ws(">", "a", "b")
    parts = [
        _map(weights.degree_weights(scaled.filter("in_scale"), core), F.col("degree"), "degree_weights"), _map(weights.interval_weights(grammar.interval_histogram(steps)), F.col("interval"), "interval_weights"),
        *(_map(weights.transition_weights(transitions, k), pair, n) for k, n in (("transition", "transition_weights"), ("ascending", "ascending_transition_weights"), ("descending", "descending_transition_weights"))),
        _map(weights.trigram_weights(support, degrees), F.col("ngram"), "trigram_weights"), _patterns(weights.preferred_phrases(support, degrees, files), "preferred_phrases"), _map(cadences.filter("n = 1"), F.col("ngram"), "cadence_degrees"), _patterns(cadences.filter("n > 1"), "cadence_patterns"),
        rhythm.duration_multipliers(ratios).groupBy("cluster_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("degree").cast("string"), "multiplier")))).alias("multipliers")), rhythm.phrase_end_ratio(ratios).select("cluster_id", F.col("multiplier").alias("end_multiplier")),
        rhythm.rhythm_bins(ratios).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.round(F.element_at(F.array(*map(F.lit, rhythm.GRID)), F.col("bin") + 1), 4))).alias("ratios")), rhythm.micro_tuning(scaled).groupBy("cluster_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("degree").cast("string"), "cents")))).alias("cents")),
        rhythm.register_profile(events), scales.auxiliary_degrees(shares, core).groupBy("cluster_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("degree").cast("string"), F.round("share", 6))))).alias("auxiliary")),
    ]
    out = core.join(files, "cluster_id")
    for p in parts:
        out = out.join(p, "cluster_id", "left")
    midi = lambda c: F.round(F.col(c) / 100.0, 3)
    names = ["degree_weights", "interval_weights", "transition_weights", "ascending_transition_weights", "descending_transition_weights", "trigram_weights", "preferred_phrases", "cadence_degrees", "cadence_patterns"]
    return out.select(
        F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")).alias("id"), F.transform("scale", lambda d: d.cast("int")).alias("scale"), F.struct(F.least(F.lit(9), F.greatest(F.lit(5), F.size("scale") + 2)).alias("candidate_count"), *names).alias("grammar"),
        F.struct(F.lit(True).alias("enabled"), F.col("ratios").alias("preferred_duration_ratios"), F.col("multipliers").alias("degree_duration_multipliers"), F.coalesce("end_multiplier", F.lit(1.0)).alias("phrase_end_multiplier"), F.lit(0.30).alias("max_duration_change")).alias("rhythm"),
        F.struct(F.col("cents").alias("degree_cents")).alias("tuning"), F.struct(F.lit(True).alias("enabled"), midi("median").alias("median_midi"), midi("q1").alias("q1_midi"), midi("q3").alias("q3_midi"), midi("p10").alias("p10_midi"), midi("p90").alias("p90_midi")).alias("register"),
        F.col("auxiliary").alias("auxiliary_degrees"), F.struct("n_files", "n_events", F.round("coverage", 4).alias("coverage"), F.col("reason").alias("selection_reason")).alias("training"),
    )
