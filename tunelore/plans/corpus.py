"""Queries on note events: adapter, occupancy, phrases, roots, scales, grammar, weights, rhythm.

The SQL side shares one list of common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators import grammar, keys, rhythm, scales, tonic, weights
from tunelore.operators.events import EVENT_SQL, melody_events
from tunelore.operators.events import file_sizes as sizes_of
from tunelore.operators.ordered import Running, ordered
from tunelore.operators.phrases import PhraseRule, detect_phrases, split_phrases
from tunelore.sources.tables import table
from tunelore.staging import stage, stage_once

#: Makes the note events of a folder.
Events = Callable[[SparkSession, str], DataFrame]
#: Stand-in for learned clusters: files by id.
CLUSTERS = 3
RULE = PhraseRule()


# the timeline, phrases, roots and scales that the queries share


def phrased(spark: SparkSession, folder: str, events: Events = melody_events) -> DataFrame:
    """Note events with their phrase and stand-in cluster."""
    return stage_once(spark, f"{folder}/events.parquet", f"phrased-{events.__name__}", lambda: detect_phrases(events(spark, folder), RULE)).withColumn("cluster_id", F.col("file_id") % CLUSTERS)


def rooted(spark: SparkSession, folder: str, events: Events = melody_events) -> DataFrame:
    """Phrased events with the file's root and each event's degree."""
    told = phrased(spark, folder, events)

    def joined() -> DataFrame:
        roots = tonic.root_generic(told).select("file_id", "root")
        return told.join(roots, "file_id").withColumn("degree", F.pmod(F.col("pc") - F.col("root"), F.lit(12)))

    return stage_once(spark, f"{folder}/events.parquet", f"rooted-{events.__name__}", joined)


def scaled(spark: SparkSession, folder: str, events: Events = melody_events) -> tuple[DataFrame, DataFrame]:
    """Rooted events with in_scale, and the clusters' core scales."""
    told = rooted(spark, folder, events)
    core = stage_once(spark, f"{folder}/events.parquet", f"scales-{events.__name__}", lambda: scales.core_scale(scales.degree_shares(told)))
    return told.join(core.select("cluster_id", "scale"), "cluster_id").withColumn("in_scale", F.array_contains("scale", F.col("degree"))).drop("scale"), core


def runs_of(spark: SparkSession, folder: str, events: Events = melody_events) -> tuple[DataFrame, DataFrame, DataFrame]:
    """In-scale runs, the scaled events and the scales."""
    told, core = scaled(spark, folder, events)
    return grammar.scale_runs(told), told, core


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# queries


def pc_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    """Duration share and count of each degree relative to the file's final note."""
    events = melody_events(spark, folder)
    final = events.groupBy("file_id").agg(F.max_by("pc", "seq").alias("final_pc"))
    degrees = events.join(final, "file_id").groupBy("file_id", F.pmod(F.col("pc") - F.col("final_pc"), F.lit(12)).alias("degree")).agg(F.sum(F.greatest(F.lit(1), "frames")).alias("frames"), F.count("*").alias("n_events"))
    whole = W.partitionBy("file_id")
    return degrees.select("file_id", "degree", "frames", "n_events", F.round(F.col("frames") / F.sum("frames").over(whole), 6).alias("share"))


def note_events(spark: SparkSession, folder: str) -> DataFrame:
    """The adapter's note events."""
    return melody_events(spark, folder).select("file_id", "seq", "channel", "pitch", "cents", "frames", "gap_frames", "start_frame", "end_frame", "pc")


def phrase_gap_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions between gaps of at least the phrase gap."""
    events = ordered(melody_events(spark, folder).select("file_id", "seq", "start_frame", "end_frame"), ["file_id"], ["seq"], Running("_n", lags={"_before": "end_frame"}))
    marked = events.drop("_n").withColumn("_new", F.coalesce((F.col("start_frame") - F.col("_before") >= RULE.gap).cast("int"), F.lit(0)))
    numbered = ordered(marked, ["file_id"], ["seq"], Running("_n", sums={"session": "_new"}))
    return numbered.groupBy("file_id", "session").agg(F.count("*").alias("n_events"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))


def raw_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases before short ones are joined."""
    split = split_phrases(melody_events(spark, folder), RULE)
    return split.groupBy("file_id", "phrase_raw").agg(F.count("*").alias("n_events"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's phrase."""
    return phrased(spark, folder).select("file_id", "seq", "phrase")


def phrase_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each phrase's events, span and last note."""
    return phrased(spark, folder).groupBy("file_id", "phrase").agg(F.count("*").alias("n_events"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.max_by("pc", "seq").alias("end_pc"))


def ending_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each pitch class among a file's phrase endings."""
    ends = phrased(spark, folder).groupBy("file_id", "phrase").agg(F.max_by("pc", "seq").alias("pc")).groupBy("file_id", "pc").agg(F.count("*").alias("n"))
    return ends.select("file_id", "pc", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("file_id")), 6).alias("share"))


def root_generic(spark: SparkSession, folder: str) -> DataFrame:
    return _round(tonic.root_generic(phrased(spark, folder)), "score", "margin")


def root_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Files by root, with the least margin."""
    return tonic.root_generic(phrased(spark, folder)).groupBy("root").agg(F.count("*").alias("files"), F.round(F.min("margin"), 6).alias("least_margin"))


def degree_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scales.degree_shares(rooted(spark, folder)), "share")


def scale_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = scales.scale_candidates(scales.degree_shares(rooted(spark, folder)))
    return _round(found.withColumn("scale", F.concat_ws(",", "scale")), "coverage", "cutoff_share", "next_share", "gap", "score")


def core_scale(spark: SparkSession, folder: str) -> DataFrame:
    found = scales.core_scale(scales.degree_shares(rooted(spark, folder)))
    return _round(found.withColumn("scale", F.concat_ws(",", "scale")), "coverage")


def auxiliary_degrees(spark: SparkSession, folder: str) -> DataFrame:
    shares = stage(scales.degree_shares(rooted(spark, folder)), "shares")
    return _round(scales.auxiliary_degrees(shares, scales.core_scale(shares)), "share")


def root_with_scale(spark: SparkSession, folder: str) -> DataFrame:
    events, core = scaled(spark, folder)
    found = tonic.root_with_scale(events, core)
    return found.withColumns({c: F.round(c, 9) for c in ("score", "margin", "coverage")})


def scale_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs, _, _ = runs_of(spark, folder)
    return runs.select("file_id", "phrase", "seq", "run", "degree")


def interval_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.interval_histogram(grammar.interval_steps(runs_of(spark, folder)[0]))


def transition_counts(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.transition_counts(grammar.interval_steps(runs_of(spark, folder)[0]))


def _support(spark: SparkSession, folder: str, source: Events = melody_events) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    runs, events, _ = runs_of(spark, folder, source)
    degrees = events.filter("in_scale").groupBy("cluster_id", "degree").agg(F.count("*").alias("n"))
    files = events.groupBy("cluster_id").agg(F.countDistinct("file_id").alias("n_files"))
    return grammar.ngram_support(grammar.run_ngrams(runs)), degrees, files, grammar.cadences(events, runs)


def ngram_support(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and file support of the 2- to 5-grams."""
    return _support(spark, folder)[0]


def supported_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """The n-grams with enough occurrences and files."""
    return ngram_support(spark, folder).filter((F.col("count") >= weights.MIN_COUNT) & (F.col("files") >= weights.MIN_FILES))


def cadence_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return _support(spark, folder)[3]


def degree_weights(spark: SparkSession, folder: str) -> DataFrame:
    events, core = scaled(spark, folder)
    return weights.degree_weights(events.filter("in_scale"), core)


def interval_weights(spark: SparkSession, folder: str) -> DataFrame:
    return weights.interval_weights(interval_histogram(spark, folder))


def _transitions(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: weights.transition_weights(transition_counts(spark, folder), kind)


def trigram_weights(spark: SparkSession, folder: str) -> DataFrame:
    support, degrees, _, _ = _support(spark, folder)
    return weights.trigram_weights(support, degrees)


#: A known tune, in C major: its pitches, line by line, each line's last note twice as long as the others.
TUNE = [[60, 60, 67, 67, 69, 69, 67], [65, 65, 64, 64, 62, 62, 60], [67, 67, 65, 65, 64, 64, 62], [67, 67, 65, 65, 64, 64, 62], [60, 60, 67, 67, 69, 69, 67], [65, 65, 64, 64, 62, 62, 60]]
#: Frames of a beat and of the pause after a line, and the cents by which every singer is off on the third degree.
BEAT, PAUSE, OFF = 12, 20, 14


def tune_events(spark: SparkSession, folder: str) -> DataFrame:
    """The tune as sung by every user of the ``events`` table, higher or lower by up to a fourth, in the adapter's columns."""
    notes = [(i * 7 + j + 1, p, BEAT * (2 if j == 6 else 1), PAUSE if i and not j else 0, OFF if p == 64 else 0) for i, line in enumerate(TUNE) for j, p in enumerate(line)]
    sung = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("seq", "pitch", "frames", "gap_frames", "cents"), x))) for x in notes))).alias("n")
    rows = table(spark, folder, "events").select(F.col("user_id").alias("file_id")).distinct().select("file_id", sung).select("file_id", "n.*").withColumn("pitch", (F.col("pitch") + F.col("file_id") % 11 - 5).cast("int"))
    seen = W.partitionBy("file_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("end_frame", F.sum(F.col("frames") + F.col("gap_frames")).over(seen)).select(
        "file_id", (F.col("file_id") * 100 + F.col("seq")).alias("event_id"), "seq", F.lit("sung").alias("channel"), "pitch", "cents", (F.col("pitch") * 100 + F.col("cents")).alias("midi_cents"), (F.col("pitch") + F.col("cents") / 100.0).alias("source_midi"), "frames", "gap_frames",
        (F.col("end_frame") - F.col("frames")).alias("start_frame"), "end_frame", (F.col("pitch") % 12).alias("pc"),
    )


def preferred_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The preferred phrases of the tune's singers."""
    support, degrees, files, _ = _support(spark, folder, tune_events)
    return weights.preferred_phrases(support, degrees, files)


def micro_tuning(spark: SparkSession, folder: str) -> DataFrame:
    """The micro-tuning of the tune's singers."""
    return rhythm.micro_tuning(scaled(spark, folder, tune_events)[0])


def tune_roots(spark: SparkSession, folder: str) -> DataFrame:
    """The roots of the sung tunes."""
    return _round(tonic.root_generic(phrased(spark, folder, tune_events)), "score", "margin")


def tune_cadences(spark: SparkSession, folder: str) -> DataFrame:
    """The cadence weights of the tune's singers."""
    support, degrees, files, found = _support(spark, folder, tune_events)
    return weights.cadence_weights(found, support, degrees, files)


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The files' events and phrases, and the reason to leave out those of few; of every third file two events are kept."""
    events = phrased(spark, folder).filter((F.col("file_id") % 3 > 0) | (F.col("seq") <= 2))
    return sizes_of(events)


def cadence_weights(spark: SparkSession, folder: str) -> DataFrame:
    support, degrees, files, found = _support(spark, folder)
    return weights.cadence_weights(found, support, degrees, files)


def register_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rhythm.register_profile(melody_events(spark, folder).withColumn("cluster_id", F.col("file_id") % CLUSTERS))


def duration_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return rhythm.duration_multipliers(rhythm.phrase_ratios(scaled(spark, folder)[0]))


def phrase_end_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return rhythm.phrase_end_ratio(rhythm.phrase_ratios(scaled(spark, folder)[0]))


def rhythm_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rhythm.rhythm_bins(rhythm.phrase_ratios(scaled(spark, folder)[0]))


def detected_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The key of each file by correlation with the modes' profiles."""
    return _round(keys.detect_keys(melody_events(spark, folder)), "score")


def scale_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The notes of a pentatonic scale nearest to each event."""
    near = keys.nearest_scale_notes(F.col("source_midi"), F.col("file_id") % 12, [0, 2, 4, 7, 9], 4.5, 3)
    return melody_events(spark, folder).select("file_id", "seq", F.posexplode(near).alias("pos", "note"))


def corpus_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, pitch range and duration by cluster, by cluster and channel, and overall."""
    events = melody_events(spark, folder).withColumn("cluster_id", F.col("file_id") % CLUSTERS)
    return events.rollup("cluster_id", "channel").agg(F.count("*").alias("n_events"), F.min("pitch").alias("least_pitch"), F.max("pitch").alias("largest_pitch"), F.sum("frames").alias("frames"))


_PHRASES = f"""
with recursive {EVENT_SQL.strip()},
med as (select file_id, greatest(1.0, median(frames)) as med from ev group by file_id),
near as (
  select ev.*, med, lag(end_frame) over w as p_end, lag(frames) over w as p_frames, lag(midi_cents) over w as p_cents
  from ev join med using (file_id) window w as (partition by file_id order by seq)),
cues as (
  select *, coalesce(start_frame - p_end >= {RULE.gap}, false) as hard,
    coalesce(p_frames >= {RULE.long} * med and (start_frame - p_end > 0 or abs(midi_cents - p_cents) >= {RULE.leap}), false) as soft
  from near),
raw(file_id, seq, held, phrase_raw) as (
  select file_id, seq, 1, 0::bigint from cues where seq = 1
  union all
  select c.file_id, c.seq, case when c.hard or (r.held >= {RULE.least} and c.soft) then 1 else r.held + 1 end,
    r.phrase_raw + case when c.hard or (r.held >= {RULE.least} and c.soft) then 1 else 0 end
  from raw r join cues c on c.file_id = r.file_id and c.seq = r.seq + 1),
sized as (select file_id, phrase_raw, count(*) as size from raw group by all),
final as (
  select file_id, phrase_raw, sum(case when phrase_raw = 0 or size >= {RULE.least} then 1 else 0 end) over (partition by file_id order by phrase_raw rows unbounded preceding)::bigint - 1 as phrase from sized),
pe as (select ev.*, final.phrase, ev.file_id % {CLUSTERS} as cluster_id from ev join raw using (file_id, seq) join final using (file_id, phrase_raw)),
ends as (select file_id, phrase, arg_max(pc, seq) as pc, max(seq) as seq from pe group by all),
occ as (
  select file_id, p.pc, coalesce(d, 0) as d, coalesce(n, 0) as n, coalesce(e, 0) as e
  from (select distinct file_id from pe) cross join (select unnest(range(12))::integer as pc) p
    left join (select file_id, pc, sum(greatest(1, frames)) as d, count(*) as n from pe group by all) using (file_id, pc)
    left join (select file_id, pc, count(*) as e from ends group by all) using (file_id, pc)),
occs as (
  select file_id, pc, d / sum(d) over (partition by file_id) as d, n / sum(n) over (partition by file_id) as n, e / sum(e) over (partition by file_id) as e from occ),
finals as (select file_id, arg_max(pc, seq) as final_pc from ends group by all),
score as (
  select a.file_id, a.pc as root, 2.20 * a.e + 1.25 * (a.pc = final_pc)::int + a.d + 0.30 * a.n + 0.30 * b.d + 0.12 * c.d as score
  from occs a join occs b on b.file_id = a.file_id and b.pc = (a.pc + 7) % 12 join occs c on c.file_id = a.file_id and c.pc = (a.pc + 5) % 12 join finals f on f.file_id = a.file_id),
roots as (
  select file_id, arg_max(root, rank) as root, max(score) as score, max(score) - max(score) filter (rank < 12) as margin
  from (select *, row_number() over (partition by file_id order by score, root) as rank from score) group by all),
de as (select pe.*, root, (((pc - root) % 12) + 12) % 12 as degree from pe join roots using (file_id)),
shares as (
  select cluster_id, g.degree, coalesce(frames, 0)::bigint as frames, coalesce(frames, 0) / sum(coalesce(frames, 0)) over (partition by cluster_id) as share
  from (select distinct cluster_id from de) cross join (select unnest(range(12))::integer as degree) g left join (select cluster_id, degree, sum(frames) as frames from de group by all) using (cluster_id, degree)),
ranked as (
  select cluster_id, (row_number() over w + 1)::integer as notes, share, coalesce(lead(share) over w, 0) as next_share, sum(share) over (partition by cluster_id order by share desc, degree rows unbounded preceding) as upto,
    list(degree) over (partition by cluster_id order by share desc, degree rows unbounded preceding) as degrees
  from shares where degree > 0 window w as (partition by cluster_id order by share desc, degree)),
cand as (
  select r.cluster_id, notes, list_sort(list_append(degrees, 0)) as scale, z.share + upto as coverage, r.share as cutoff_share, next_share, greatest(0, r.share - next_share) as gap,
    greatest(0, r.share - next_share) - 0.02 * (notes - 5) as score, z.share + upto >= 0.9 as eligible
  from ranked r join shares z on z.cluster_id = r.cluster_id and z.degree = 0 where notes between 5 and 7),
core as (
  select cluster_id, scale, coverage, case when eligible then 'coverage_elbow' else 'max_notes_fallback' end as reason
  from (select *, row_number() over (partition by cluster_id order by eligible desc, case when eligible then score else 0 end desc, case when eligible then notes else -notes end) as k from cand) where k = 1),
sc as (select de.*, list_contains(scale, degree) as in_scale from de join core using (cluster_id)),
islands as (select *, count(*) filter (not in_scale) over (partition by file_id, phrase order by seq rows unbounded preceding) as run from sc),
runs as (
  select * from (select *, lag(degree) over (partition by file_id, phrase, run order by seq) as before from islands where in_scale) where before is distinct from degree),
steps as (
  select * from (
    select cluster_id, file_id, lag(degree) over w as a, degree as b, midi_cents - lag(midi_cents) over w as delta, least(12, round_even(abs(midi_cents - lag(midi_cents) over w) / 100, 0)::int) as "interval"
    from runs window w as (partition by file_id, phrase, run order by seq)) where delta is not null and "interval" > 0),
hist as (select cluster_id, "interval", count(*) as n from steps group by all),
trans as (select cluster_id, a, b, count(*) as n, count(*) filter (delta > 35) as ascending, count(*) filter (delta < -35) as descending from steps group by all),
ahead as (
  select cluster_id, file_id, degree d0, lead(degree, 1) over w d1, lead(degree, 2) over w d2, lead(degree, 3) over w d3, lead(degree, 4) over w d4
  from runs window w as (partition by file_id, phrase, run order by seq)),
grams as (
  select cluster_id, file_id, 2 as n, concat_ws('>', d0, d1) as ngram from ahead where d1 is not null
  union all select cluster_id, file_id, 3, concat_ws('>', d0, d1, d2) from ahead where d2 is not null
  union all select cluster_id, file_id, 4, concat_ws('>', d0, d1, d2, d3) from ahead where d3 is not null
  union all select cluster_id, file_id, 5, concat_ws('>', d0, d1, d2, d3, d4) from ahead where d4 is not null),
support as (select cluster_id, n, ngram, count(*) as count, count(distinct file_id) as files from grams group by all),
closing as (select cluster_id, file_id, phrase, arg_max(in_scale, seq) as good from sc group by all),
tails as (
  select r.cluster_id, r.file_id, r.phrase, list(degree order by seq) as l
  from runs r join closing c using (file_id, phrase) where good and run = (select max(run) from runs q where q.file_id = r.file_id and q.phrase = r.phrase) group by all),
cad as (
  select cluster_id, n, ngram, count(*) as count, count(distinct file_id) as files
  from (select cluster_id, file_id, n, array_to_string(l[len(l) - n + 1 : len(l)], '>') as ngram from tails cross join (select unnest([1, 2, 3, 4]) as n) where len(l) >= n) group by all),
degs as (select cluster_id, degree, count(*) as n, sum(frames) as frames from sc where in_scale group by all),
nfiles as (select cluster_id, count(distinct file_id) as n_files from sc group by all),
ratios as (select sc.*, frames / greatest(m, 1e-6) as ratio, sc.seq = last as is_end from sc join (select file_id, phrase, median(frames) as m, max(seq) as last from sc group by all) using (file_id, phrase))
"""

def _weight(raw: str, scale: float) -> str:
    return f"case when least(3.5, greatest(0, {raw}) * {scale}) >= 0.05 then round(least(3.5, greatest(0, {raw}) * {scale}), 4) end"


def _top(source: str, order: str, k: int, columns: str) -> str:
    return f"select {columns}, rank from (select *, row_number() over (partition by cluster_id order by {order})::integer as rank from ({source}) where weight is not null) where rank <= {k}"


def _transition_sql(kind: str, scale: float) -> str:
    lift = "ln((n + 0.5) / (total * (src / total) * (dst / total) + 0.5))"
    source = f"""select cluster_id, a, b, n, {_weight(lift, scale)} as weight from (
      select cluster_id, a, b, {kind} as n, sum({kind}) over (partition by cluster_id) as total, sum(case when a <> b then {kind} else 0 end) over (partition by cluster_id, a) as src,
        sum(case when a <> b then {kind} else 0 end) over (partition by cluster_id, b) as dst from trans where {kind} > 0) where a <> b and n >= 4"""
    return _PHRASES + _top(source, "weight desc, n desc, a, b", 28, "cluster_id, a, b, n, weight")


_EXPECTED = """(select s.*, windows * p as expected from (select *, sum(count) over (partition by cluster_id, n) as windows from support) s join (
      select cluster_id, n, ngram, exp(sum(ln(greatest(coalesce(share, 0), 1e-12)))) as p from (
        select cluster_id, n, ngram, unnest(string_split(ngram, '>'))::bigint as degree, unnest(range(n)) as pos from support)
        left join (select cluster_id, degree, n / sum(n) over (partition by cluster_id) as share from degs) using (cluster_id, degree) group by all) using (cluster_id, n, ngram))"""

QUERIES = {
    f.__name__: f
    for f in (
        pc_occupancy, note_events, phrase_gap_sessions, raw_phrases, phrases, phrase_summary, ending_share, root_generic, root_histogram, degree_shares, scale_candidates, core_scale, auxiliary_degrees, root_with_scale, scale_runs,
        interval_histogram, transition_counts, ngram_support, supported_ngrams, cadence_patterns, degree_weights, interval_weights, trigram_weights, cadence_weights, register_profile, duration_ratios, phrase_end_ratio,
        rhythm_bins, tune_roots, tune_cadences, file_sizes, corpus_rollup, detected_keys, scale_neighbours,
    )
} | {"preferred_phrases": preferred_phrases, "micro_tuning": micro_tuning, "transition_weights": _transitions("transition"), "ascending_weights": _transitions("ascending"), "descending_weights": _transitions("descending")}

_EVENTS = f"with {EVENT_SQL.strip()} "
_QUANTILES = ", ".join(f"min(v) filter (c >= {q} * t) as {n}" for n, q in rhythm.QUANTILES.items())
_SCORE2 = """4.00 * cov + 1.80 * a.e + 0.95 * (a.pc = final_pc)::int + 0.75 * a.d + 0.18 * a.n + 0.22 * list_contains(scale, 7)::int * b.d + 0.10 * list_contains(scale, 5)::int * c.d"""
_GRID = ", ".join(str(g) for g in rhythm.GRID)

SQL = {
    "pc_occupancy": _EVENTS + ", f as (select file_id, arg_max(pc, seq) as final_pc from ev group by 1), d as (select file_id, (((pc - final_pc) % 12) + 12) % 12 as degree, sum(greatest(1, frames))::bigint as frames, count(*) as n_events from ev join f using (file_id) group by all) select *, round(frames / sum(frames) over (partition by file_id), 6) as share from d",
    "note_events": _EVENTS + "select file_id, seq, channel, pitch, cents, frames, gap_frames, start_frame, end_frame, pc from ev",
    "phrase_gap_sessions": _EVENTS + f", s as (select *, case when start_frame - lag(end_frame) over (partition by file_id order by seq) >= {RULE.gap} then 1 else 0 end as fresh from ev), n as (select *, sum(fresh) over (partition by file_id order by seq rows unbounded preceding)::bigint as session from s) select file_id, session, count(*) as n_events, min(start_frame) as start_frame, max(end_frame) as end_frame from n group by all",
    "raw_phrases": _PHRASES + "select file_id, phrase_raw, count(*) as n_events, min(start_frame) as start_frame, max(end_frame) as end_frame from raw join ev using (file_id, seq) group by all",
    "phrases": _PHRASES + "select file_id, seq, phrase from pe",
    "phrase_summary": _PHRASES + "select file_id, phrase, count(*) as n_events, min(start_frame) as start_frame, max(end_frame) as end_frame, arg_max(pc, seq) as end_pc from pe group by all",
    "ending_share": _PHRASES + "select file_id, pc, e as n, round(e / sum(e) over (partition by file_id), 6) as share from occ where e > 0",
    "root_generic": _PHRASES + "select file_id, root, round(score, 6) as score, round(margin, 6) as margin from roots",
    "root_histogram": _PHRASES + "select root, count(*) as files, round(min(margin), 6) as least_margin from roots group by all",
    "degree_shares": _PHRASES + "select cluster_id, degree, frames, round(share, 6) as share from shares",
    "scale_candidates": _PHRASES + "select cluster_id, notes, array_to_string(scale, ',') as scale, round(coverage, 6) as coverage, round(cutoff_share, 6) as cutoff_share, round(next_share, 6) as next_share, round(gap, 6) as gap, round(score, 6) as score, eligible from cand",
    "core_scale": _PHRASES + "select cluster_id, array_to_string(scale, ',') as scale, round(coverage, 6) as coverage, reason from core",
    "auxiliary_degrees": _PHRASES + "select cluster_id, degree, round(share, 6) as share from shares join core using (cluster_id) where share >= 0.015 and not list_contains(scale, degree)",
    "root_with_scale": _PHRASES + f""", cover as (
      select o.file_id, o.cluster_id, scale, r.root, sum(d) as cov
      from (select occs.*, file_id % {CLUSTERS} as cluster_id from occs) o join core using (cluster_id) cross join (select unnest(range(12))::integer as root) r where list_contains(scale, (((pc - r.root) % 12) + 12) % 12) group by all),
    s2 as (select a.file_id, cluster_id, a.pc as root, cov, {_SCORE2} as score from occs a join occs b on b.file_id = a.file_id and b.pc = (a.pc + 7) % 12 join occs c on c.file_id = a.file_id and c.pc = (a.pc + 5) % 12 join finals f on f.file_id = a.file_id join cover on cover.file_id = a.file_id and cover.root = a.pc)
    select file_id, cluster_id, arg_max(root, rank) as root, round(max(score), 9) as score, round(max(score) - max(score) filter (rank < 12), 9) as margin, round(arg_max(cov, rank), 9) as coverage from (select *, row_number() over (partition by file_id order by score, root) as rank from s2) group by all""",
    "scale_runs": _PHRASES + "select file_id, phrase, seq, run, degree from runs",
    "interval_histogram": _PHRASES + 'select cluster_id, "interval", n from hist',
    "transition_counts": _PHRASES + "select * from trans",
    "ngram_support": _PHRASES + "select * from support",
    "supported_ngrams": _PHRASES + "select * from support where count >= 4 and files >= 3",
    "cadence_patterns": _PHRASES + "select * from cad",
    "degree_weights": _PHRASES + f"select * from (select cluster_id, degree, {_weight('ln((p + 1e-6) / (1.0 / len(scale)))', 1.45)} as weight from (select cluster_id, degree, frames / sum(frames) over (partition by cluster_id) as p from degs) join core using (cluster_id) where p > 0) where weight is not null",
    "interval_weights": _PHRASES + _top(f"""select cluster_id, "interval", n, {_weight('ln((n + 0.5) / (total / 12 + 0.5))', 1.25)} as weight from (select *, sum(n) over (partition by cluster_id) as total from hist) where n >= 4""", 'weight desc, n desc, "interval"', 8, 'cluster_id, "interval", n, weight'),
    "transition_weights": _transition_sql("n", 1.10),
    "ascending_weights": _transition_sql("ascending", 1.15),
    "descending_weights": _transition_sql("descending", 1.15),
    "trigram_weights": _PHRASES + _top(f"select cluster_id, ngram, count, {_weight('ln((count + 0.5) / (expected + 0.5))', 0.72)} as weight from {_EXPECTED} where n = 3 and count >= 4", "weight desc, count desc, ngram", 24, "cluster_id, ngram, count, weight"),
    "preferred_phrases": _PHRASES + _top(f"select cluster_id, ngram, count, files, round(least(3.5, w + least(0.45, 0.08 * greatest(0, files - 1))), 4) as weight from (select *, {_weight('ln((count + 0.5) / (expected + 0.5))', 0.62)} as w from {_EXPECTED} join nfiles using (cluster_id) where n in (4, 5) and count >= 4 and files >= least(3, greatest(1, n_files)))", "weight desc, files desc, count desc, ngram", 16, "cluster_id, ngram, count, files, weight"),
    "cadence_weights": _PHRASES + f""", ph as (select cluster_id, sum(count) as phrases from cad where n = 1 group by all), base as (select * from cad join ph using (cluster_id) join nfiles using (cluster_id) where count >= 4 and files >= least(3, greatest(1, n_files))),
    one as (select cluster_id, n, ngram, count, files, {_weight("ln((count / phrases + 1e-6) / (coalesce(p_all, 0) + 1e-6))", 1.15)} as weight from base left join (select cluster_id, degree::varchar as ngram, n / sum(n) over (partition by cluster_id) as p_all from degs) using (cluster_id, ngram) where n = 1),
    more as (select cluster_id, n, ngram, count, files, {_weight("ln((count / phrases + 1e-6) / (p_all + 1e-6))", 0.95)} as weight from base join (select cluster_id, n, ngram, count / sum(count) over (partition by cluster_id, n) as p_all from support) using (cluster_id, n, ngram) where n > 1)
    select * from one where weight is not null union all select * exclude (k) from (select *, row_number() over (partition by cluster_id order by weight desc, files desc, count desc, ngram) as k from more where weight is not null) where k <= 12""",
    "register_profile": _EVENTS + f""", e as (select *, file_id % {CLUSTERS} as cluster_id from ev), s as (select cluster_id, midi_cents as v, sum(frames) as w from e group by all), r as (select *, sum(w) over (partition by cluster_id order by v rows unbounded preceding) as c, sum(w) over (partition by cluster_id) as t from s),
    q as (select cluster_id, {_QUANTILES} from r group by all), x as (select cluster_id, min(midi_cents) as observed_min, max(midi_cents) as observed_max, count(*) as event_count, sum(frames)::bigint as weight from e group by all)
    select *, q3 - q1 as iqr, p90 - p10 as preferred_range from q join x using (cluster_id)""",
    "duration_ratios": _PHRASES + "select cluster_id, degree, n, round(v, 4) as multiplier from (select cluster_id, degree, count(*) as n, least(1.5, greatest(0.7, median(ratio))) as v from ratios where in_scale group by all) where n >= 4 and abs(v - 1) >= 0.04",
    "phrase_end_ratio": _PHRASES + "select cluster_id, count(*) as n, round(least(1.8, greatest(0.8, median(ratio))), 4) as multiplier from ratios where in_scale and is_end group by all",
    "rhythm_bins": _PHRASES + f""", b as (select cluster_id, list_position(away, list_min(away)) - 1 as bin, count(*) as n from (select cluster_id, list_transform([{_GRID}], lambda g: abs(ln(g) - ln(least(4.5, greatest(0.2, ratio))))) as away from ratios where in_scale) group by all),
    k as (select *, row_number() over (partition by cluster_id order by n desc, bin) as rank from b)
    select cluster_id, bin, coalesce(n, 0) as n from (select cluster_id, bin from k where rank <= 6 union select distinct cluster_id, 5 from b) left join b using (cluster_id, bin)""",
    "micro_tuning": _PHRASES + """, own as (select *, cents::double as r from sc), t as (select file_id, median(r) as tuning from own group by all),
    c as (select cluster_id, degree, r - tuning as c from own join t using (file_id) where in_scale),
    m as (select cluster_id, degree, median(c) as med from c group by all having count(*) >= 8),
    a as (select cluster_id, degree, c, med, median(abs(c - med)) over (partition by cluster_id, degree) as mad from c join m using (cluster_id, degree)),
    o as (select cluster_id, degree, count(*) as n, least(35, greatest(-35, median(c))) as v from a where mad <= 0 or abs(c - med) <= greatest(8, 3.5 * mad) group by all having count(*) >= 8)
    select cluster_id, degree, n, round(v, 2) as cents from o where abs(v) >= 2""",
    "detected_keys": _EVENTS + f""", h as (select file_id, pc, sum(frames) as d from ev group by all), u as (select file_id, pc, d / sqrt(sum(d * d) over (partition by file_id)) as d from h),
    p as (select unnest(range(12)) as i, unnest({keys.MAJOR}) as a, unnest({keys.MINOR}) as b), q as (select i, 'major' as mode, a / sqrt((select sum(a * a) from p)) as w from p union all select i, 'minor', b / sqrt((select sum(b * b) from p)) from p),
    s as (select file_id, r.root, mode, sum(d * w) as score from u cross join (select unnest(range(12))::integer as root) r join q on q.i = (pc - r.root + 12) % 12 group by all)
    select file_id, root, mode, round(score, 6) as score from (select *, row_number() over (partition by file_id order by score desc, root, mode) as k from s) where k = 1""",
    "scale_neighbours": _EVENTS + """, c as (select file_id, seq, note, abs(note - source_midi) as away, row_number() over (partition by file_id, seq order by abs(note - source_midi), note) as k from ev cross join (select unnest(range(128))::integer as note) where list_contains([0, 2, 4, 7, 9], ((note - file_id % 12) % 12 + 12) % 12))
    select file_id, seq, (k - 1)::integer as pos, note from c where k <= 3 and (away <= 4.5 or k = 1)""",
    "corpus_rollup": _EVENTS + f"select file_id % {CLUSTERS} as cluster_id, channel, count(*) as n_events, min(pitch) as least_pitch, max(pitch) as largest_pitch, sum(frames)::bigint as frames from ev group by rollup (cluster_id, channel)",
}
_TUNE_SQL = f"""ev as (
  select *, pitch * 100 + cents as midi_cents, pitch + cents / 100.0::double as source_midi, upto - frames as start_frame, upto as end_frame, pitch % 12 as pc
  from (select *, sum(frames + gap_frames) over (partition by file_id order by seq rows unbounded preceding)::bigint as upto
    from (select user_id as file_id, user_id * 100 + i + 1 as event_id, (i + 1)::integer as seq, 'sung' as channel, (p + user_id % 11 - 5)::integer as pitch, case when p = 64 then {OFF} else 0 end as cents,
        case when i % 7 = 6 then {2 * BEAT} else {BEAT} end as frames, case when i % 7 = 0 and i > 0 then {PAUSE} else 0 end as gap_frames
      from (select distinct user_id from events), (select unnest(range(42)) as i, unnest({[p for line in TUNE for p in line]}) as p))))"""
#: The same queries on the adapter's events, whose random pitches have no phrase that is preferred.
ADAPTER_SQL = dict(SQL)
SQL |= {name: SQL[of].replace(EVENT_SQL.strip(), _TUNE_SQL) for name, of in (("preferred_phrases", "preferred_phrases"), ("micro_tuning", "micro_tuning"), ("tune_roots", "root_generic"), ("tune_cadences", "cadence_weights"))}
SQL["file_sizes"] = _PHRASES + "select file_id, count(*) as n_events, count(distinct phrase) as n_phrases, case when count(*) < 3 then 'few_events' end as reason from pe where file_id % 3 > 0 or seq <= 2 group by file_id"
