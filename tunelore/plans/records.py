"""Queries on records: tokens, pairs, lookups, duplicates, names and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.functions import scalars as s
from tunelore.functions.text import fold_accents, title_key
from tunelore.operators import matching as m
from tunelore.operators.events import EVENT_SQL, melody_events
from tunelore.operators.keys import stem_role
from tunelore.sources.tables import table

#: Labels of file kinds and the words that show them.
KINDS = {"packed": ["mp3", "ogg"], "plain": ["wav", "flac"], "take": ["take"]}


def note_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Pitch and rest tokens of the documents, with MIDI pitches."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(s.pitch_tokens(F.col("text"))).alias("pos", "token"))
    return docs.withColumn("midi", s.token_to_midi(F.col("token")))


def duration_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Fractions in the documents as quarters."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b\d+/\d+\b"), F.lit(0))).alias("pos", "token"))
    return docs.withColumn("quarters", F.round(s.duration_value(F.col("token")), 6))


def pair_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Files' pitch lists against their duration lists."""
    docs = table(spark, folder, "documents").filter("file_id is not null")
    pitches = docs.select("file_id", F.size(s.pitch_tokens(F.col("text"))).alias("n")).filter("n >= 3")
    durations = docs.select("file_id", F.size(F.regexp_extract_all("text", F.lit(r"\b\d+/\d+\b"), F.lit(0))).alias("n")).filter("n >= 3")
    first = lambda df: df.groupBy("file_id").agg(F.max("n").alias("n"))
    return m.pair_sides(first(pitches), first(durations), "file_id", "n")


def dedupe_digest(spark: SparkSession, folder: str) -> DataFrame:
    return m.first_by_content(table(spark, folder, "documents").select("doc_id", "text").distinct(), "text", "doc_id")


def dedupe_two_key(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "documents").select("doc_id", (F.col("doc_id") % 700).alias("k1"), F.when(F.col("n_chars").isNotNull(), F.concat_ws(":", "source", (F.col("n_chars") % 40).cast("string"))).alias("k2")).distinct()
    return m.keep_by_two_keys(keys, "doc_id", "k1", "k2")


def prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    """The first listed root that each file lies under."""
    corpora = table(spark, folder, "corpora").filter("corpus_id % 3 <> 0").select(F.concat(F.lit("datasets/c"), "corpus_id").alias("root"), F.col("corpus_id").alias("rank"))
    roots = corpora.unionByName(spark.range(1).select(F.lit("datasets").alias("root"), F.lit(1000).cast("bigint").alias("rank")))
    return m.under_first_root(table(spark, folder, "files").select("file_id", "path").distinct(), "path", roots, "root", "rank")


def fuzzy_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Source names without their number, and some whole, looked up among the sources."""
    sources = table(spark, folder, "sources")
    wanted = sources.select(F.when(F.col("source_id") % 4 == 0, F.col("name")).when(F.col("source_id") % 4 == 1, F.concat("name", F.lit(" remix"))).otherwise(F.regexp_replace("name", "_[0-9]+$", "")).alias("name"))
    return m.find_names(wanted, "name", sources, "name", "source_id")


def keep_unknown_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents not known to be in a foreign language; unknown ones stay."""
    foreign = F.when(F.col("lang").isin("de", "es"), True).when(F.col("lang") == "en", False)
    return table(spark, folder, "documents").filter(~foreign.eqNullSafe(F.lit(True))).select("doc_id", "lang").distinct()


def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Files that no document tells of."""
    return table(spark, folder, "files").select("file_id").distinct().join(table(spark, folder, "documents"), "file_id", "left_anti")


def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Files with counters."""
    return table(spark, folder, "files").select("file_id").distinct().join(table(spark, folder, "cluster_stats"), "file_id", "left_semi")


def id_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the union, intersection and difference of two id sets."""
    a, b = (table(spark, folder, t).select("file_id").filter("file_id is not null").distinct() for t in ("files", "documents"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersection")).unionByName(count(a.exceptAll(b), "difference"))


def unique_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered slugs of the documents' source and language."""
    return m.unique_slugs(table(spark, folder, "documents").select("doc_id", F.concat_ws(" - ", "source", "lang").alias("name")).distinct(), "name", "doc_id")


def path_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").select("file_id", s.earliest_label(F.col("path"), KINDS).alias("label")).distinct()


def keyword_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose name holds both keywords."""
    return table(spark, folder, "sources").filter(s.has_all(F.col("name"), ["vocals", "stem"])).select("source_id", "name")


def case_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Case and condition of test file names made of the sources."""
    names = table(spark, folder, "sources").select(F.when(F.col("source_id") % 3 == 0, F.concat("name", F.lit("_test.wav"))).when(F.col("source_id") % 3 == 1, F.concat("name", F.lit("_test_"), "role", F.lit("_v9.wav"))).otherwise(F.concat("name", F.lit(".wav"))).alias("filename"))
    return names.select("filename", s.case_and_condition(F.col("filename")).alias("x")).select("filename", "x.case", "x.condition")


def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The numeric functions over the adapter's events."""
    e = melody_events(spark, folder)
    half = F.col("pitch") + F.when(F.col("seq") % 2 == 0, 0.5).otherwise(F.col("cents") / 100.0)
    r = lambda c: F.round(c, 6)
    return e.select(
        "file_id", "seq", s.half_even(half).alias("rounded"), s.degree(half, F.lit(7)).alias("degree"), r(s.cents_residual(F.col("source_midi"))).alias("residual"), r(s.midi_to_hz(F.col("source_midi"))).alias("hz"), s.note_name(F.col("source_midi")).alias("name"),
        s.root_from_name(F.element_at(F.array(*map(F.lit, ["F#", "gb", "B♭", "H", "c"])), (F.col("seq") % 5 + 1).cast("int"))).alias("root"), s.tempo_or(F.col("frames") * 12.0).alias("tempo"), r(s.dbfs(F.col("frames") / 30.0)).alias("level"),
        r(s.ticks_to_seconds(F.col("start_frame"), F.lit(90.0))).alias("seconds"), r(s.similarity(F.col("frames"))).alias("similarity"), r(s.loudness_amplitude(F.col("frames"), F.lit(20.0))).alias("amplitude"),
    )


#: Kinds of files in order of preference.
PRIORITY = {"wav": 4, "flac": 3, "ogg": 2, "mp3": 1}


def record_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Of each corpus's files with one root, the one to keep: by its kind, its rate, its path."""
    files = table(spark, folder, "files").select("file_id", F.concat_ws("-", "corpus_id", "root_pc").alias("grp"), "path", "sr").distinct()
    kind = F.regexp_extract("path", r"\.([^.]*)$", 1)
    return m.choose_records(files.withColumn("kind", kind), "grp", "kind", "sr", "path", PRIORITY).select("file_id", "grp", "chosen")


def stem_roles(spark: SparkSession, folder: str) -> DataFrame:
    """The role that each source's name tells."""
    return table(spark, folder, "sources").select("source_id", "name", stem_role(F.col("name")).alias("told"))


def title_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpora").select("corpus_id", title_key("name").alias("key"))


def folded_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpora").select("corpus_id", fold_accents("tradition").alias("folded"))


_TOKEN = "(?i)([a-g](##?|bb?|[x♯♭])?-?[0-9]+|rest)"
_FRACTION = r"regexp_extract_all(text, '\b[0-9]+/[0-9]+\b')"
_MIDI = """(select *, regexp_extract(plain, '(?i)^([A-G])(#{1,2}|b{1,2}|x)?(-?[0-9]+)$', 1) as n, lower(regexp_extract(plain, '(?i)^([A-G])(#{1,2}|b{1,2}|x)?(-?[0-9]+)$', 2)) as a, try_cast(regexp_extract(plain, '(?i)^([A-G])(#{1,2}|b{1,2}|x)?(-?[0-9]+)$', 3) as bigint) as o from (select *, replace(replace(token, '♯', '#'), '♭', 'b') as plain from t))"""
_MATCH = "(contains(s.name, w.name) or contains(w.name, s.name))"

QUERIES = {
    f.__name__: f
    for f in (
        note_tokens, duration_tokens, pair_outer, dedupe_digest, dedupe_two_key, prefix_join, fuzzy_lookup, keep_unknown_filter, anti_join, semi_join, id_sets, unique_ids, path_labels, keyword_columns, case_conditions, scalar_functions,
        title_keys, folded_names, stem_roles, record_choice,
    )
}
SQL = {
    "note_tokens": f"""with d as (select doc_id, regexp_extract_all(text, '{_TOKEN}') as l from documents), t as (select doc_id, unnest(l) as token, unnest(range(len(l)))::integer as pos from d),
    m as (select doc_id, pos, token, 12 * (o + 1) + {{'C': 0, 'D': 2, 'E': 4, 'F': 5, 'G': 7, 'A': 9, 'B': 11}}[upper(n)] + case a when '#' then 1 when '##' then 2 when 'x' then 2 when 'b' then -1 when 'bb' then -2 else 0 end as midi from {_MIDI})
    select doc_id, pos, token, case when midi between 0 and 127 then midi end::integer as midi from m""".replace("{'C': 0, 'D': 2, 'E': 4, 'F': 5, 'G': 7, 'A': 9, 'B': 11}[upper(n)]", "case upper(n) when 'C' then 0 when 'D' then 2 when 'E' then 4 when 'F' then 5 when 'G' then 7 when 'A' then 9 when 'B' then 11 end"),
    "duration_tokens": f"with d as (select doc_id, {_FRACTION} as l from documents), t as (select doc_id, unnest(l) as token, unnest(range(len(l)))::integer as pos from d) select doc_id, pos, token, round(case when split_part(token, '/', 1)::double > 0 and split_part(token, '/', 2)::double > 0 then split_part(token, '/', 1)::double / split_part(token, '/', 2)::double end, 6) as quarters from t",
    "pair_outer": f"""with p as (select file_id, max(len(regexp_extract_all(text, '{_TOKEN}')))::integer as left_size from documents where file_id is not null and len(regexp_extract_all(text, '{_TOKEN}')) >= 3 group by all),
    q as (select file_id, max(len({_FRACTION}))::integer as right_size from documents where file_id is not null and len({_FRACTION}) >= 3 group by all)
    select file_id, left_size, right_size, case when left_size is null then 'missing_left' when right_size is null then 'missing_right' when left_size <> right_size then 'length_mismatch' else 'paired' end as status from p full join q using (file_id)""",
    "dedupe_digest": "with d as (select distinct doc_id, text from documents) select doc_id, sha256(text) as digest, case when text is null then doc_id else min(doc_id) over (partition by text) end as first, text is null or doc_id = min(doc_id) over (partition by text) as kept from d",
    "dedupe_two_key": """with recursive k as (select row_number() over (order by doc_id) as n, * from (select distinct doc_id, doc_id % 700 as k1, case when n_chars is not null then concat_ws(':', source, n_chars % 40) end as k2 from documents)),
    w(n, doc_id, kept, reason, s1, s2) as (
      select n, doc_id, true, null::varchar, [k1], case when k2 is null then [] else [k2] end from k where n = 1
      union all
      select k.n, k.doc_id, not list_contains(s1, k1) and (k2 is null or not list_contains(s2, k2)), case when list_contains(s1, k1) then 'first_key' when k2 is not null and list_contains(s2, k2) then 'second_key' end,
        case when list_contains(s1, k1) or (k2 is not null and list_contains(s2, k2)) then s1 else list_append(s1, k1) end,
        case when k2 is null or list_contains(s1, k1) or list_contains(s2, k2) then s2 else list_append(s2, k2) end
      from w join k on k.n = w.n + 1)
    select doc_id, kept, reason from w""",
    "prefix_join": "with r as (select 'datasets/c' || corpus_id as root, corpus_id as rank from corpora where corpus_id % 3 <> 0 union all select 'datasets', 1000), f as (select distinct file_id, path from files) select file_id, path, arg_min(root, rank) as root from f left join r on starts_with(path, root || '/') group by all",
    "fuzzy_lookup": f"""with w as (select distinct case source_id % 4 when 0 then name when 1 then name || ' remix' else regexp_replace(name, '_[0-9]+$', '') end as name from sources),
    e as (select w.name, min(source_id) as ident from w join sources s on s.name = w.name group by all), c as (select w.name, min(source_id) as ident from w join sources s on {_MATCH} where w.name not in (select name from e) group by all)
    select *, 'exact' as how from e union all select *, 'contains' from c""",
    "keep_unknown_filter": "select distinct doc_id, lang from documents where lang is null or lang not in ('de', 'es')",
    "record_choice": f"""with f as (select distinct file_id, corpus_id || '-' || root_pc as grp, path, sr, case lower(regexp_extract(path, '[.]([^.]*)$', 1)) {" ".join(f"when '{k}' then {v}" for k, v in PRIORITY.items())} else 0 end as p from files)
    select file_id, grp, path = first_value(path) over (partition by grp order by p desc, sr desc, path) as chosen from f""",
    "title_keys": "select corpus_id, lower(regexp_replace(nfc_normalize(coalesce(name, '')), '[[:space:]_:!?()\\-]+', '', 'g')) as key from corpora",
    "folded_names": "select corpus_id, lower(regexp_replace(strip_accents(tradition), '[^A-Za-z0-9]+', '', 'g')) as folded from corpora",
    "anti_join": "select distinct file_id from files where file_id not in (select file_id from documents where file_id is not null)",
    "semi_join": "select distinct file_id from files where file_id in (select file_id from cluster_stats)",
    "id_sets": "with a as (select distinct file_id from files where file_id is not null), b as (select distinct file_id from documents where file_id is not null) select count(*) as n, 'union' as part from (select * from a union select * from b) union all select count(*), 'intersection' from (select * from a intersect select * from b) union all select count(*), 'difference' from (select * from a except select * from b)",
    "unique_ids": "with d as (select distinct doc_id, trim(regexp_replace(lower(concat_ws(' - ', source, lang)), '[ _.()-]+', '_', 'g'), '_') as base from documents), n as (select *, row_number() over (partition by base order by doc_id) as n from d) select doc_id, case when n = 1 then base else base || '_' || n end as slug from n",
    "path_labels": """with p as (select distinct file_id, ' ' || trim(regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from files),
    c as (select file_id, unnest([coalesce(nullif(instr(t, ' mp3 '), 0), nullif(instr(t, ' ogg '), 0)), coalesce(nullif(instr(t, ' wav '), 0), nullif(instr(t, ' flac '), 0)), nullif(instr(t, ' take '), 0)]) as place, unnest(['packed', 'plain', 'take']) as label from p)
    select file_id, coalesce(arg_min(label, (place, label)) filter (place is not null), 'unknown') as label from c group by all""",
    "keyword_columns": "select source_id, name from sources where contains(replace(name, '_', ''), 'vocals') and contains(replace(name, '_', ''), 'stem')",
    "stem_roles": "select source_id, name, case when contains(name, 'vocal') then 'vocals' when contains(name, 'drum') then 'drums' when contains(name, 'bass') then 'bass' when contains(name, 'other') then 'other' when contains(name, 'guitar') then 'guitar' when contains(name, 'piano') then 'piano' end as told from sources",
    "case_conditions": """select filename, case when found then split_part(filename, '_test', 1) || '_test' end as "case", case when ends_with(filename, '_test.wav') then 'original' when found then replace(substr(filename, instr(filename, '_test_') + 6), '.wav', '') end as condition
    from (select *, contains(replace(filename, '.wav', '_'), '_test_') as found from (select case source_id % 3 when 0 then name || '_test.wav' when 1 then name || '_test_' || role || '_v9.wav' else name || '.wav' end as filename from sources))""",
    "scalar_functions": f"""with {EVENT_SQL.strip()}, h as (select *, pitch + case when seq % 2 = 0 then 0.5 else cents / 100.0 end as half from ev)
    select file_id, seq, round_even(half, 0)::bigint as rounded, (((round_even(half, 0)::bigint - 7) % 12 + 12) % 12)::integer as degree, round(cents, 6)::double as residual, round(440 * pow(2, (source_midi - 69) / 12), 6) as hz,
      ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pitch % 12 + 1] || (pitch // 12 - 1) as name, [6, 6, 10, null, 0][seq % 5 + 1] as root, case when frames * 12 between 30 and 240 then frames * 12.0 else 120.0 end::double as tempo,
      round(greatest(-120, 20 * log10(frames / 30)), 6) as level, round(start_frame / 480 * 60 / 90, 6) as seconds, round(exp(-frames / 3), 6) as similarity, round(least(0.85, greatest(0.12, 0.12 + 0.62 * frames / 20)), 6) as amplitude from h""",
}
