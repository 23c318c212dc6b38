"""Queries on files: the adapter's notes written in every format and read again, lists, links and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.functions import scalars as s
from tunelore.functions.text import decode_any, join_url
from tunelore.operators import monophony as m
from tunelore.operators import tonic
from tunelore.operators.events import EVENT_SQL, melody_events
from tunelore.plans.corpus import _PHRASES, CLUSTERS, phrased
from tunelore.plans.mapping import _LONG, profiles
from tunelore.plans.mapping import _SNAPPED as SNAPPED_SQL
from tunelore.plans.mapping import _snapped as snapped
from tunelore.sources import lists, renderers, scores, sinks
from tunelore.sources.profiles import profile_weights, read_profiles, write_profiles
from tunelore.sources.tables import table
from tunelore.staging import shared_folder, temporary

#: Ticks of a frame in the rendered files, and the notes' syllables in turn.
FRAME, SYLLABLES = 10, ["la", "do", "mi", "r a", "so"]


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of files beside the staged tables, removed with them."""
    return temporary(f"{shared_folder(spark).rstrip('/')}/tunelore-{name}-{uuid.uuid4().hex}")


def song_notes(spark: SparkSession, folder: str) -> DataFrame:
    """song, start, duration, pitch, lyric of the adapter's events."""
    syllable = F.element_at(F.array(*map(F.lit, SYLLABLES)), (F.col("seq") % len(SYLLABLES) + 1).cast("int"))
    return melody_events(spark, folder).select(F.col("file_id").alias("song"), (F.col("start_frame") * FRAME).alias("start"), (F.col("frames") * FRAME).alias("duration"), "pitch", syllable.alias("lyric"))


def _song() -> F.Column:
    return F.regexp_extract("path", r"song_(\d+)", 1).cast("bigint").alias("song")


def _written(spark: SparkSession, folder: str, render, suffix: str) -> str:
    at = _folder(spark, suffix)
    scores.write_files(renderers.rendered(song_notes(spark, folder), render, suffix), at)
    return at


def midi_files(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of the songs written as MIDI files."""
    return scores.read_midi(spark, _written(spark, folder, renderers.midi, "mid")).filter("type in ('note_on', 'note_off', 'set_tempo')").select(_song(), "tick", "type", "note", "tempo", "ticks_per_beat", "error")


def without_drums(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of messages on all channels but the drums'; the channel is the track's number in its song."""
    notes = song_notes(spark, folder).withColumn("channel", (F.col("pitch") % 12).cast("int"))
    return m.without_drums(notes, "channel").select("song", "start", "duration", "pitch", "channel")


def _project(render, suffix: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return scores.read_projects(spark, _written(spark, folder, render, suffix)).select(_song(), "format", "track", "resolution", "start", "duration", "pitch", "lyric", "tempo", "error")

    query.__doc__ = f"The notes of the songs written as .{suffix} projects."
    return query


def musicxml_files(spark: SparkSession, folder: str) -> DataFrame:
    """The notes of the songs written as scores, in quarters."""
    return scores.read_musicxml(spark, _written(spark, folder, renderers.musicxml, "xml")).select(_song(), F.round("start_q", 6).alias("start_q"), F.round("duration_q", 6).alias("duration_q"), "midi", "tempo", "error")


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """Samples and their sum of the songs written as sound files."""
    read = scores.read_wav(spark, _written(spark, folder, renderers.wav, "wav"))
    return read.groupBy(_song(), "rate", "channels").agg(F.sum(F.size("samples")).alias("samples"), F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The members of the songs' archives, and the notes of the scores in them."""
    members = scores.read_archives(spark, _written(spark, folder, renderers.archive, "zip"))
    return members.select(_song(), "member", (F.length("content") > 0).alias("filled"), (F.size(F.regexp_extract_all(F.col("content").cast("string"), F.lit("<pitch>"), F.lit(0)))).alias("pitches"), "error")


def broken_files(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader says of good files and of broken ones: rows read and whether an error is told."""
    good = renderers.rendered(song_notes(spark, folder), renderers.midi, "mid")
    bad = good.select("path", F.when(F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 3 == 0, F.lit(b"no midi")).otherwise(F.col("content")).alias("content"))
    at = _folder(spark, "broken")
    scores.write_files(bad, at)
    counts, failures = sinks.corpus_manifest(scores.read_midi(spark, at), "broken")
    return counts.select("corpus", "files_found", "files_read", "rows").join(failures.agg(F.count("*").alias("failures"), F.min("error").alias("error")).withColumn("corpus", F.lit("broken")), "corpus")


def decoded_names(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus names from their bytes."""
    return table(spark, folder, "corpora").select("corpus_id", decode_any(F.concat(F.when(F.col("corpus_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.lit(b"")), F.encode("name", "utf-8"))).alias("name"))


def manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a written source list that are switched on and have an address."""
    k = F.col("source_id") % 5
    rows = table(spark, folder, "sources").select(
        F.when(k == 0, "no").when(k == 1, " Yes ").when(k == 2, "0").when(k == 3, "maybe").alias("enabled"), F.when(F.col("source_id") % 7 != 0, F.concat(F.lit(" https://example.org/"), "name")).alias("url"), F.col("source_id").cast("string").alias("id"), F.col("name").alias("title"), F.col("role").alias("creator"), F.lit("CC0").alias("license"),
    )
    at = _folder(spark, "manifest")
    sinks.write_table(rows, at)
    return lists.read_manifest(spark, at)


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    html = F.concat(F.lit('<p>All <a class="x" href=" songs/'), "name", F.lit('.MID?v=1">Song <b>'), "name", F.lit("</b>\n now</a> and <A HREF='"), "role", F.lit(".html'>the role</A></p>"))
    return table(spark, folder, "sources").select("source_id", html.alias("html"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return lists.links(_pages(spark, folder))


def midi_links(spark: SparkSession, folder: str) -> DataFrame:
    return lists.midi_links(_pages(spark, folder))


def joined_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses of the files' paths on a page."""
    files = table(spark, folder, "files").select("file_id", "path").distinct()
    return files.select("file_id", join_url(F.lit("https://example.org/all/index.html"), F.concat("path", F.lit("#top"))).alias("url"))


def packed_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths from their base64 forms, and null of what is none."""
    return table(spark, folder, "files").select("file_id", s.base64_path(F.when(F.col("file_id") % 4 == 0, "*").otherwise(F.base64(F.encode("path", "utf-8")))).alias("path")).distinct()


def yes_or_no(spark: SparkSession, folder: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["Yes", " n ", "ON", "off", "perhaps", "1", "False"])), (F.col("source_id") % 7 + 1).cast("int"))
    return table(spark, folder, "sources").select("source_id", s.yes_no(said).alias("said"))


def profile_files(spark: SparkSession, folder: str) -> DataFrame:
    """The weights of profiles written as files and read again."""
    at = _folder(spark, "profiles")
    write_profiles(profiles(spark), at)
    return profile_weights(read_profiles(spark, f"{at}/*.json"))


def assignment_table(spark: SparkSession, folder: str) -> DataFrame:
    """The files' cluster table, written and read again; labels stand for learned clusters."""
    events = phrased(spark, folder)
    labels = events.select("file_id", (F.col("file_id") % CLUSTERS).cast("int").alias("label")).distinct()
    rows = sinks.assignments(labels, tonic.root_generic(events).select("file_id", "root", "score", "margin"), events)
    at = _folder(spark, "assignments")
    sinks.write_table(rows, at, mark=True)
    return spark.read.schema(rows.schema).csv(at, header=True)


def event_table(spark: SparkSession, folder: str) -> DataFrame:
    """The mapped events in the columns of their report, written and read again."""
    rows = sinks.event_report(snapped(spark, folder).drop("degree"))
    at = _folder(spark, "mapped")
    sinks.write_table(rows, at)
    return spark.read.schema(rows.schema).csv(at, header=True).select("id", "file_id", "phrase", "event", "source_start_frame", "source_end_frame", "source_midi", "target_midi", "target_note", "root", "degree", "modulation", "source_frames", "tuning_cents")


def note_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Each candidate's notes as one document, written and read again, as rows."""
    notes = table(spark, folder, "notes").filter("pitch between 0 and 127 and confidence between 0 and 1").dropDuplicates(["note_id"])
    docs = sinks.note_documents(notes.select("candidate_id", "start_s", "end_s", "pitch", "confidence"), "candidate_id")
    at = _folder(spark, "notes")
    sinks.write_documents(docs, at)
    return spark.read.schema(docs.schema).json(at).select("candidate_id", "note_count", F.explode("notes").alias("n")).select("candidate_id", "note_count", "n.*")


def split_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates accepted and rejected, written apart and read again."""
    rows = table(spark, folder, "candidates").select("candidate_id", "note_count", F.when(F.col("note_count") < 5, "few notes").when(F.col("voiced_ratio") < 0.5, "unvoiced").alias("reason")).distinct()
    at = _folder(spark, "split")
    lists.write_split(rows, "reason", at)
    good, bad = (spark.read.csv(f"{at}/{x}", header=True) for x in ("accepted", "rejected"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select(F.col("candidate_id").cast("bigint").alias("candidate_id"), F.col("note_count").cast("int").alias("note_count"), "reason")


def corpus_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Each corpus's report document, written and read again: how many files and their first."""
    rows = table(spark, folder, "files").select("corpus_id", "file_id", "root_pc").distinct()
    at = _folder(spark, "reports")
    lists.write_report(rows, "corpus_id", at)
    back = spark.read.schema("corpus_id bigint, rows array<struct<file_id: bigint, root_pc: int>>").json(at)
    return back.select("corpus_id", F.size("rows").alias("files"), F.element_at("rows", 1)["file_id"].alias("first_file"), F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, x: a + x["root_pc"]).alias("roots"))


def blind_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Of each blind pack: its files, the last number and name; every original once."""
    items = table(spark, folder, "files").select(F.concat(F.lit("c"), "corpus_id").alias("case"), "path").distinct()
    pack = lists.blind_pack(items, "case", "path", 7)
    return pack.groupBy("case").agg(F.count("*").alias("files"), F.countDistinct("original").alias("originals"), F.countDistinct("blind_filename").alias("names"), F.max("blind_id").alias("last"), F.max_by("blind_filename", "blind_id").alias("last_name"))


def blind_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The members of every blind pack's archive, written and read again; a file's bytes are its path's."""
    items = table(spark, folder, "files").select(F.concat(F.lit("c"), "corpus_id").alias("case"), "path").distinct()
    archives = lists.blind_archives(lists.blind_pack(items, "case", "path", 7), items.select("path", F.encode("path", "utf-8").alias("content")), "path")
    at = _folder(spark, "blind")
    scores.write_files(archives, at)
    members = scores.read_archives(spark, at)
    return members.select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("case"), F.col("content").cast("string").alias("original"), F.regexp_extract("member", r"_(\d+)\.wav$", 1).cast("int").between(1, 100_000).alias("numbered"), "error")


def bend_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The pitch-wheel range in force at each message, of controllers made of the adapter's events."""
    ev = melody_events(spark, folder)
    control = F.element_at(F.array(*map(F.lit, [101, 100, 6, 38, 7])), (F.col("event_id") % 5 + 1).cast("int"))
    value = F.when(F.col("event_id") % 5 < 2, (F.col("event_id") % 3 == 2).cast("int")).otherwise((F.col("event_id") % 24).cast("int"))
    found = m.bend_ranges(ev.select("file_id", "seq", control.alias("control"), value.alias("value")), ["file_id"], ["seq"])
    return found.select("file_id", "seq", F.round("sensitivity", 6).alias("sensitivity"))


_E = f"with {EVENT_SQL.strip()}, n as (select file_id as song, start_frame * {FRAME} as start, frames * {FRAME} as duration, pitch, [{', '.join(repr(x) for x in SYLLABLES)}][seq % {len(SYLLABLES)} + 1] as lyric from ev) "
_NOTES = "(select distinct on (note_id) * from notes where pitch between 0 and 127 and confidence between 0 and 1)"

QUERIES = {
    f.__name__: f
    for f in (
        midi_files, without_drums, musicxml_files, wav_files, archive_files, broken_files, decoded_names, manifest_rows, page_links, midi_links, joined_urls, packed_paths, yes_or_no, profile_files, assignment_table, event_table, note_lists,
        split_candidates, corpus_reports, blind_packs, blind_archives, bend_ranges,
    )
} | {"vsqx_files": _project(renderers.vsqx, "vsqx"), "ustx_files": _project(renderers.ustx, "ustx"), "ust_files": _project(renderers.ust, "ust")}


def _project_sql(kind: str, tempo: str) -> str:
    return _E + f"select song, '{kind}' as format, 0 as track, 480 as resolution, start, duration, pitch, lyric, {tempo} as tempo, null::varchar as error from n"


SQL = {
    "midi_files": _E + """select song, start::bigint as tick, 'note_on' as type, pitch as note, null::integer as tempo, 480 as ticks_per_beat, null::varchar as error from n union all select song, start + duration, 'note_off', pitch, null, 480, null from n
    union all select distinct song, 0, 'set_tempo', null, 500000, 480, null from n""",
    "without_drums": _E + "select song, start, duration, pitch, pitch % 12 as channel from n where pitch % 12 <> 9",
    "vsqx_files": _project_sql("vsqx", "null::double"), "ustx_files": _project_sql("ustx", "120.0::double"), "ust_files": _project_sql("ust", "120.0::double"),
    "musicxml_files": _E + """select song, round(start / 480, 6) as start_q, round(duration / 480, 6) as duration_q, pitch as midi, 100.0::double as tempo, null::varchar as error from n
    union all select song, round(before / 480, 6), round((start - before) / 480, 6), null, 100.0, null from (select *, coalesce(lag(start + duration) over (partition by song order by start), 0) as before from n) where start > before""",
    "wav_files": _E + "select song, 8000 as rate, 1 as channels, count(*) as samples, round(sum(trunc((pitch - 64) / 64 * 32767) / 32768), 6) as total from n group by song",
    "archive_files": _E + ", c as (select song, count(*)::integer as k from n group by song) select song, 'song/line.ust' as member, true as filled, 0 as pitches, null::varchar as error from c union all select song, 'song/line.xml', true, k, null from c",
    "broken_files": _E + """, f as (select song, count(*) as k from n group by song) select 'broken' as corpus, count(*) as files_found, count(*) filter (song % 3 <> 0) as files_read, sum(2 * k + 3) filter (song % 3 <> 0)::bigint as rows, count(*) filter (song % 3 = 0) as failures,
      case when count(*) filter (song % 3 = 0) > 0 then 'ValueError: no MIDI header' end as error from f""",
    "decoded_names": "select corpus_id, name from corpora",
    "manifest_rows": """select 'https://example.org/' || name as url, source_id::varchar as id, name as title, role as creator, 'CC0' as license, null::varchar as filename from sources where source_id % 5 not in (0, 2) and source_id % 7 <> 0""",
    "page_links": "select source_id, 0 as pos, 'songs/' || name || '.MID?v=1' as href, 'Song ' || name || ' now' as text from sources union all select source_id, 1, role || '.html', 'the role' from sources",
    "midi_links": "select source_id, 0 as pos, 'songs/' || name || '.MID?v=1' as href, 'Song ' || name || ' now' as text from sources",
    "joined_urls": "select distinct file_id, 'https://example.org/all/' || replace(path, ' ', '%20') as url from files",
    "packed_paths": "select distinct file_id, case when file_id % 4 <> 0 then path end as path from files",
    "yes_or_no": "select source_id, [true, false, true, false, null, true, false][source_id % 7 + 1] as said from sources",
    "profile_files": _LONG,
    "assignment_table": _PHRASES + f""", z as (select file_id, count(*) as events, count(distinct phrase) as phrases from pe group by all)
    select file_id, (file_id % {CLUSTERS} + 1)::integer as cluster, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][root + 1] as estimated_root, round(score, 6) as root_score, round(margin, 6) as root_margin, events, phrases from roots join z using (file_id)""",
    "event_table": SNAPPED_SQL + """ select 'five' as id, file_id, phrase, seq as event, start_frame as source_start_frame, end_frame as source_end_frame, round(source_midi, 4) as source_midi, target as target_midi,
      ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][target % 12 + 1] || (target // 12 - 1) as target_note, root, ((target - root) % 12 + 12) % 12 as degree, 'base' as modulation, frames as source_frames, 0.0::double as tuning_cents from sn""",
    "note_lists": f'select candidate_id, count(*) over (partition by candidate_id) as note_count, round(start_s, 4) as start, round(end_s, 4) as "end", pitch, round(confidence, 4) as confidence from {_NOTES}',
    "split_candidates": "select distinct candidate_id, note_count, case when note_count < 5 then 'few notes' when voiced_ratio < 0.5 then 'unvoiced' end as reason from candidates",
    "corpus_reports": "select corpus_id, count(*)::integer as files, min(file_id) as first_file, sum(root_pc)::bigint as roots from (select distinct corpus_id, file_id, root_pc from files) group by all",
    "blind_archives": """select distinct 'c' || corpus_id as "case", path as original, true as numbered, null::varchar as error from files""",
    "bend_ranges": _E + """, k as (select file_id, seq, [101, 100, 6, 38, 7][event_id % 5 + 1] as control, case when event_id % 5 < 2 then (event_id % 3 = 2)::int else event_id % 24 end as value from ev),
    o as (select *, coalesce(last_value(case when control = 101 then value end ignore nulls) over w = 0 and last_value(case when control = 100 then value end ignore nulls) over w = 0, false) as opened from k window w as (partition by file_id order by seq rows unbounded preceding))
    select file_id, seq, round(coalesce(last_value(case when opened and control = 6 then value end ignore nulls) over w, 2) + coalesce(last_value(case when opened and control = 38 then value end ignore nulls) over w, 0) / 100, 6) as sensitivity from o window w as (partition by file_id order by seq rows unbounded preceding)""",
    "blind_packs": """select "case", files, files as originals, files as names, files::integer as last, "case" || '_' || case when files < 10 then '0' else '' end || files || '.wav' as last_name from (select 'c' || corpus_id as "case", count(distinct path) as files from files group by all)""",
}
