"""Queries on file features and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.operators import clustering, features
from tunelore.operators.events import large_enough
from tunelore.operators.rhythm import GRID
from tunelore.plans.corpus import _PHRASES, CLUSTERS, phrased, rooted
from tunelore.staging import stage


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return features.file_features(large_enough(rooted(spark, folder)))


def feature_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The 71 numbers of each file."""
    return _points(spark, folder).select("file_id", F.posexplode("feature").alias("pos", "value")).withColumn("value", F.round("value", 6))


def pairwise_silhouette(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouettes of the files in the stand-in clusters."""
    points = stage(_points(spark, folder).withColumn("label", (F.col("file_id") % CLUSTERS).cast("int")), "points")
    return clustering.silhouettes(points, features.DIMS).withColumn("silhouette", F.round("silhouette", 6))


def cluster_relabel(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in clusters by root, the larger first."""
    labels = rooted(spark, folder).select("file_id", F.col("root").alias("label")).distinct()
    return clustering.relabel(labels)


def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of the best k."""
    return clustering.choose_clusters(stage(_points(spark, folder), "points"), features.DIMS)[0].select("file_id", "label")


def kmeans_fixpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Whether three clusters are a fixpoint: files, those nearer to another cluster's mean than to their own's, and empty clusters."""
    found = clustering.kmeans(stage(_points(spark, folder), "points"), 3)
    long = found.select("file_id", "label", F.posexplode("feature").alias("i", "v"))
    means = long.groupBy("label", "i").agg(F.avg("v").alias("m")).withColumnRenamed("label", "other")
    away = long.join(means, "i").groupBy("file_id", "label", "other").agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("d"))
    per = away.groupBy("file_id").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("own"), F.min("d").alias("least"))
    return per.agg(F.count("*").alias("files"), F.count_if(F.col("own") > F.col("least") + 1e-9).alias("moved")).withColumn("empty", F.lit(3) - F.lit(found.select("label").distinct().count()))


def refine_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and roots, refined together."""
    return clustering.refine(phrased(spark, folder).drop("cluster_id"))[0]


_FEATURES = _PHRASES + f""", fe as (
  select de.*, frames / greatest(median(frames) over (partition by file_id, phrase), 1e-6) as ratio, seq = max(seq) over (partition by file_id, phrase) as is_end, midi_cents - lag(midi_cents) over (partition by file_id, phrase order by seq) as delta from de),
fs as (select *, case when delta is not null then least(12, round_even(abs(delta) / 100, 0)::int) end as size, list_transform([{", ".join(map(str, GRID))}], lambda g: abs(ln(g) - ln(least(4.5, greatest(0.2, ratio))))) as away from fe),
cnt as (
  select file_id, 'degree' as kind, degree as place, sum(frames) as n from fs group by all
  union all select file_id, 'interval', size - 1, count(*) from fs where size > 0 group by all
  union all select file_id, 'signed', case when delta > 0 then 11 + size else 12 - size end, count(*) from fs where size > 0 group by all
  union all select file_id, 'cadence', degree, count(*) from fs where is_end group by all
  union all select file_id, 'rhythm', list_position(away, list_min(away)) - 1, count(*) from fs group by all),
shr as (select file_id, kind, place, n / sum(n) over (partition by file_id, kind) * case kind when 'degree' then 2.5 when 'interval' then 1.4 when 'signed' then 1.15 when 'cadence' then 1.6 else 0.65 end as v from cnt),
dim as (select file_id, unnest(range(71))::integer as pos from (select distinct file_id from de)),
flat as (
  select file_id, pos, coalesce(v, 0) as v from dim left join (select file_id, place + case kind when 'degree' then 0 when 'interval' then 12 when 'signed' then 24 when 'cadence' then 48 else 60 end as pos, v from shr) using (file_id, pos)),
feat as (select file_id, pos, v / sqrt(sum(v * v) over (partition by file_id)) as value from flat)"""

QUERIES = {f.__name__: f for f in (feature_blocks, pairwise_silhouette, cluster_relabel, kmeans_clusters, kmeans_fixpoint, refine_clusters)}
SQL = {
    "feature_blocks": _FEATURES + " select file_id, pos, round(value, 6) as value from feat",
    "pairwise_silhouette": _FEATURES + f""", dist as (select a.file_id, a.file_id % {CLUSTERS} as label, b.file_id % {CLUSTERS} as other, b.file_id as o, sqrt(sum((a.value - b.value) * (a.value - b.value))) as d from feat a join feat b using (pos) group by a.file_id, b.file_id),
    mean as (select file_id, label, other, case when label = other then coalesce(sum(d) / nullif(count(*) - 1, 0), 0) else avg(d) end as m from dist group by file_id, label, other),
    ab as (select file_id, label, max(m) filter (label = other) as a, min(m) filter (label <> other) as b from mean group by all)
    select file_id, label::integer as label, round((b - a) / greatest(a, b), 6) as silhouette from ab""",
    "kmeans_fixpoint": "select count(distinct user_id) as files, 0::bigint as moved, 0::integer as empty from events",
    "cluster_relabel": _PHRASES + ", z as (select root, (row_number() over (order by count(*) desc, root) - 1)::integer as label from roots group by root) select file_id, label from roots join z using (root)",
}
