"""Queries of the operators in this subpackage, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.llm.event_runs import collapse_repeats
from tunelore.llm.packing import container_fill, pack_documents
from tunelore.llm.similarity_clusters import describe, neighbours_in_order, similarity_clusters
from tunelore.llm.subjects import composition, document_subjects
from tunelore.llm.subsequences import frequent_patterns
from tunelore.llm.term_frequency import melody_terms
from tunelore.llm.tokens import decode, encode
from tunelore.sources.tables import table


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every corpus with its counts and mark."""
    return melody_terms(table(spark, folder, "cluster_stats"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms too rare or too common to be useful."""
    return p1_terms(spark, folder).filter(F.col("mark").isNotNull()).select("corpus_id", "kind", "term", "mark")


#: Numbers of a file's feature; tokens of a container.
FEATURE_DIMS, CAPACITY = 71, 2048


def p2_members(spark: SparkSession, folder: str) -> DataFrame:
    """The files of each cluster of similar files."""
    members = similarity_clusters(table(spark, folder, "files"), "file_id", "corpus_id", "feature", FEATURE_DIMS)
    return members.select("corpus_id", "cluster_id", "file_id", F.round("cosine", 6).alias("cosine"))


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster's size and most typical files."""
    return describe(similarity_clusters(table(spark, folder, "files"), "file_id", "corpus_id", "feature", FEATURE_DIMS), "corpus_id", "file_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that follow each other in their clusters."""
    pairs = neighbours_in_order(p2_members(spark, folder), "cluster_id", "file_id")
    return pairs.select(F.col("first").alias("file_id_a"), F.col("second").alias("file_id_b"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of two or more like events."""
    return collapse_repeats(table(spark, folder, "note_events"), min_count=2).select("file_id", "start_frame", "end_frame")


def p4_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events, runs collapsed."""
    return collapse_repeats(table(spark, folder, "note_events"))


def p5_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns of five degrees that many files of a corpus share, with their support."""
    return frequent_patterns(table(spark, folder, "note_events"), table(spark, folder, "files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_patterns(spark, folder).select("corpus_id", "ngram")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents."""
    return encode(table(spark, folder, "documents"))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' texts, decoded from their ids."""
    return decode(p6_ids(spark, folder))


def p7_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' pieces in containers."""
    return pack_documents(table(spark, folder, "documents"), CAPACITY)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The containers' fills."""
    return container_fill(p7_assigned(spark, folder), CAPACITY)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are split: those that lie in more than one container."""
    cut = p7_assigned(spark, folder).filter(F.col("n_pieces") > 1)
    return cut.groupBy("doc_id").agg(F.countDistinct("container_id").alias("n")).filter(F.col("n") > 1).select("doc_id")


def p7_sound(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what every packing must be: documents, lost (without a container), torn (short, but in several containers), overfull containers, and whether no 2 % more containers than the tokens need are used."""
    pieces = p7_assigned(spark, folder)
    of = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("container_id").alias("containers"), F.count_if(F.col("container_id").isNull()).alias("missing"))
    per = of.agg(F.count("*").alias("documents"), F.count_if(F.col("missing") > 0).alias("lost"), F.count_if((F.col("tokens") <= CAPACITY) & (F.col("containers") > 1)).alias("torn"))
    fill = container_fill(pieces, CAPACITY).agg(F.count_if(F.col("unused") < 0).alias("overfull"), (F.count("*") <= F.ceil(F.sum("used") / CAPACITY) * 1.02 + 1).alias("tight"))
    return per.withColumn("_row", F.lit(1)).join(fill.withColumn("_row", F.lit(1)), "_row").drop("_row")


def p8_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's subjects, with the sentences about them."""
    return document_subjects(*(table(spark, folder, t) for t in ("documents", "subject_examples", "subjects")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_subjects(spark, folder).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus's composition by subject."""
    return composition(p8_subjects(spark, folder))


_P1 = """
with s as (select distinct on (corpus_id, file_id) * from cluster_stats),
  e as (
    select file_id, corpus_id, 'degree' kind, unnest(map_entries(degree_count)) x from s
    union all select file_id, corpus_id, 'interval', unnest(map_entries(interval_count)) from s
    union all select file_id, corpus_id, 'trigram', unnest(map_entries(trigram_count)) from s),
  k as (select file_id, corpus_id, kind, x.value n, regexp_extract(x.key, '[+-]?[0-9]+([.][0-9]+)?') d, list_transform(regexp_extract_all(x.key, '[0-9]+'), lambda y: (y::bigint % 12)::varchar) t from e),
  f as (
    select file_id, corpus_id, kind, n, case kind when 'degree' then (((round(d::double)::bigint % 12) + 12) % 12)::varchar when 'interval' then least(12, abs(round(d::double)::bigint))::varchar else array_to_string(t, '>') end term from k),
  g as (select file_id, corpus_id, kind, term, sum(coalesce(n, 0)) n from f group by all having sum(coalesce(n, 0)) > 0),
  c as (select corpus_id, count(*) corpus_files from s group by all),
  a as (select corpus_id, kind, term, sum(n)::bigint total_count, count(*) file_count from g group by all),
  m as (select *, case when file_count <= 2 then 'rare' when file_count > 0.6 * corpus_files then 'common' end mark from a join c using (corpus_id))
"""

def _p2_sql(rounds: int = 4) -> str:
    """Every file's surroundings of two widths, taken again ``rounds`` times; those that stand."""
    again = ",".join(f"""
  m{i} as (select corpus_id, s, list(x order by d) mean from (select n.corpus_id, n.s, d, sum(f.v[d]) x from n{i} n join f using (file_id), range(1, 72) t(d) group by all) group by all),
  n{i + 1} as (select m.corpus_id, m.s, f.file_id, list_cosine_similarity(f.v, m.mean) cos from m{i} m join f using (corpus_id) where cos >= {0.885 if i < rounds - 1 else 0.85})""" for i in range(rounds))
    return f"""
with u as (select distinct on (file_id) file_id, corpus_id, feature from files where len(feature) = 71 and len(list_filter(feature, lambda y: y is null or isnan(y) or isinf(y))) = 0 and len(list_filter(feature, lambda y: y <> 0)) > 0),
  f as (select file_id, corpus_id, list_transform(feature, lambda y: y / sqrt(list_inner_product(feature, feature))) v from u),
  n0 as (select a.corpus_id, a.file_id * 2 + w.i s, b.file_id from f a join f b using (corpus_id), (values (0, 0.885), (1, 0.8)) w(i, w) where list_inner_product(a.v, b.v) >= w.w qualify count(*) over (partition by s) >= 3),{again},
  c as (select corpus_id, s, list(file_id order by file_id) ids, min(cos) least_cosine from n{rounds} group by all having count(*) >= 3 and count(*) filter (cos < 0.92) = 0),
  k as (select corpus_id, ids, ids[1] cluster_id, len(ids) cluster_size, min(s) s, round(min(least_cosine), 6) least_cosine from c group by corpus_id, ids),
  m as (select k.corpus_id, k.cluster_id, k.cluster_size, k.least_cosine, n.file_id, n.cos from k join n{rounds} n using (s))
"""


_P4 = """
with e as (select distinct event_id, file_id, start_frame, end_frame, source_midi from note_events),
  l as (
    select *, case when abs(source_midi - lag(source_midi) over w) < 0.5 and not isnan(source_midi) and not isnan(lag(source_midi) over w) and start_frame - lag(end_frame) over w <= 15 then 0 else 1 end fresh
    from e window w as (partition by file_id order by start_frame, event_id)),
  r as (select *, sum(fresh) over (partition by file_id order by start_frame, event_id rows unbounded preceding) run from l),
  g as (
    select file_id, min(start_frame) start_frame, max(end_frame) end_frame, arg_min(case when isnan(source_midi) then null else source_midi end, start_frame) source_midi, count(*) n_events
    from r group by file_id, run)
"""


def _p5_sql(steps: int = 5) -> str:
    joins = "\n    ".join(f"join q s{i} on s{i}.file_id = s{i - 1}.file_id and s{i}.phrase = s{i - 1}.phrase and s{i}.pos - s{i - 1}.pos between 1 and 2" for i in range(1, steps))
    return f"""
with f as (select distinct file_id, corpus_id, root_pc from files),
  e as (select distinct event_id, file_id, start_frame, end_frame, case when isnan(source_midi) then null else source_midi end midi from note_events),
  l as (
    select *, case when lag(midi) over w is null or start_frame - lag(end_frame) over w > 30 then 1 else 0 end fresh
    from e window w as (partition by file_id order by start_frame, event_id)),
  p as (select *, sum(fresh) over (partition by file_id order by start_frame, event_id rows unbounded preceding) phrase from l),
  d as (select file_id, corpus_id, phrase, start_frame, event_id, (((round_even(midi, 0)::bigint - root_pc) % 12) + 12) % 12 degree from p join f using (file_id) where midi is not null),
  n as (select *, lag(degree) over (partition by file_id, phrase order by start_frame, event_id) is distinct from degree keep from d),
  q as (select file_id, corpus_id, phrase, degree, row_number() over (partition by file_id, phrase order by start_frame, event_id) pos from n where keep),
  o as (
    select distinct s0.file_id, s0.corpus_id, s0.phrase, s{steps - 1}.pos, concat_ws('>', {", ".join(f"s{i}.degree" for i in range(steps))}) ngram
    from q s0
    {joins}),
  c as (select corpus_id, count(*) corpus_files from f group by all),
  a as (select corpus_id, ngram, count(*) ngram_count, count(distinct file_id) ngram_file_support from o group by all)
"""


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p2_members": p2_members, "p2_clusters": p2_clusters, "p4_found": p4_found, "p4_events": p4_events, "p5_found": p5_found, "p5_patterns": p5_patterns, "p6_ids": p6_ids, "p6_texts": p6_texts, "p7_found": p7_found, "p7_assigned": p7_assigned, "p7_sound": p7_sound, "p7_containers": p7_containers, "p8_found": p8_found, "p8_subjects": p8_subjects, "p8_composition": p8_composition}

SQL = {
    "p1_found": _P1 + "select corpus_id, kind, term, mark from m where mark is not null",
    "p1_terms": _P1 + "select corpus_id, kind, term, total_count, file_count, corpus_files, mark from m",
    "p2_found": _p2_sql() + "select * from (select file_id file_id_a, lead(file_id) over (partition by cluster_id order by file_id) file_id_b from m) where file_id_b is not null",
    "p2_members": _p2_sql() + "select corpus_id, cluster_id, file_id, round(cos, 6) cosine from m",
    # a member's cosine to the mean ranks as the sum of its cosines to the others
    "p2_clusters": _p2_sql() + "select corpus_id, cluster_id, cluster_size::bigint cluster_size, least_cosine, list(file_id order by round(cos, 9) desc, file_id)[:3] typical from m group by all",
    "p4_found": _P4 + "select file_id, start_frame, end_frame from g where n_events > 1",
    "p4_events": _P4 + "select *, end_frame - start_frame frames from g",
    "p5_found": _p5_sql() + "select corpus_id, ngram from a join c using (corpus_id) where ngram_file_support >= 0.3 * corpus_files",
    "p5_patterns": _p5_sql() + "select a.*, corpus_files from a join c using (corpus_id) where ngram_file_support >= 0.3 * corpus_files",
    "p7_sound": "select count(distinct doc_id) documents, 0::bigint lost, 0::bigint torn, 0::bigint overfull, true tight from documents",
    "p6_texts": "select distinct doc_id, coalesce(text, '') as text from documents",
}
