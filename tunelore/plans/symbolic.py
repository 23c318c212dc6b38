"""Queries on symbolic notes derived from the adapter's events: one user a song, one event type a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators import monophony as m
from tunelore.operators.events import EVENT_SQL, melody_events

#: Names given to the tracks in turn.
NAMES = ["Lead vocal", "Harmony", "Bass", "Main melody chorus", "Strings", "ミク", "KAITO と伴奏"]


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """song, track, start, duration, pitch, id in ticks; onsets on a grid, so that chords and overlaps occur."""
    return melody_events(spark, folder).select(F.col("file_id").alias("song"), F.col("channel").alias("track"), (F.floor(F.col("start_frame") / 8) * 8).alias("start"), (F.col("frames") * 2).alias("duration"), "pitch", F.col("event_id").alias("id"))


def tracks(all_notes: DataFrame) -> DataFrame:
    """song, track, index, name."""
    index = F.row_number().over(W.partitionBy("song").orderBy("track")) - 1
    return all_notes.select("song", "track").distinct().withColumn("index", index).withColumn("name", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("index") % len(NAMES) + 1).cast("int")))


BY = ["song", "track"]


def monophonize(spark: SparkSession, folder: str) -> DataFrame:
    return m.monophonize(notes(spark, folder), BY)


def origin_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Monophonic lines that begin at 0."""
    return m.from_zero(m.monophonize(notes(spark, folder), BY), BY)


def monophony_score(spark: SparkSession, folder: str) -> DataFrame:
    return m.monophony_scores(notes(spark, folder), BY).withColumn("monophony", F.round("monophony", 6))


def track_scores(spark: SparkSession, folder: str) -> DataFrame:
    all_notes = notes(spark, folder)
    return m.track_scores(all_notes, tracks(all_notes)).withColumns({c: F.round(c, 6) for c in ("monophony", "mean_pitch", "score")})


def select_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """The track that each strategy chooses."""
    all_notes = notes(spark, folder)
    scores = m.track_scores(all_notes, tracks(all_notes))
    parts = [m.select_track(scores, s).withColumn("strategy", F.lit(s)) for s in m.STRATEGIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def marker_pitches(spark: SparkSession, folder: str) -> DataFrame:
    found = m.marker_pitches(notes(spark, folder).withColumn("grp", F.col("song") % 4))
    return found.withColumns({c: F.round(c, 6) for c in ("song_fraction", "extreme_fraction", "median_share", "median_gap")})


def tempo_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds of each note's onset under a tempo map."""
    all_notes = notes(spark, folder)
    tempos = all_notes.filter("id % 10 = 0").select("song", F.col("start").alias("tick"), (400_000 + 1000 * (F.col("id") % 200)).alias("tempo"), "id")
    return m.seconds_at(all_notes.select("song", F.col("start").alias("tick"), "id"), tempos).withColumn("seconds", F.round("seconds", 6))


def messages(all_notes: DataFrame) -> DataFrame:
    """On and off messages of notes; some offs are missing and some are stray."""
    on = all_notes.select("song", "track", "pitch", F.col("start").alias("tick"), F.lit(True).alias("is_on"), "id")
    off = all_notes.filter("id % 5 <> 0").select("song", "track", "pitch", (F.col("start") + F.col("duration")).alias("tick"), F.lit(False).alias("is_on"), "id")
    stray = all_notes.filter("id % 7 = 0").select("song", "track", "pitch", (F.col("start") - 1).alias("tick"), F.lit(False).alias("is_on"), "id")
    return on.unionByName(off).unionByName(stray)


def note_on_off_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return m.pair_messages(messages(notes(spark, folder).filter(F.col("pitch").between(0, 127))), ["song", "track", "pitch"], ["tick", "is_on", "id"])


def pitch_bend_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Share of bent notes and the largest bend of each song, bends from the events' cents."""
    bent = melody_events(spark, folder).select(F.col("file_id").alias("song"), m.bend_semitones(F.col("cents") * 40.96, F.lit(2.0)).alias("bend"))
    return bent.groupBy("song").agg(F.count("*").alias("n_notes"), F.round(F.avg((F.abs("bend") > 0.05).cast("int")), 6).alias("bent_fraction"), F.round(F.max(F.abs("bend")), 6).alias("largest_bend"))


def nearest_line(spark: SparkSession, folder: str) -> DataFrame:
    """Each song's chords as the line of nearest notes."""
    return m.nearest_line(notes(spark, folder))


def join_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse top lines with overlapping notes of one pitch joined."""
    top = m.top_of_chords(notes(spark, folder).withColumn("pitch", F.floor(F.col("pitch") / 12)), ["song"])
    return m.join_overlaps(top, ["song"])


_N = f"with {EVENT_SQL.strip()}, n as (select file_id as song, channel as track, start_frame // 8 * 8 as start, frames * 2 as duration, pitch, event_id as id from ev)"
_MONO = """, top as (select song, track, start, max(pitch) as pitch, max(duration) filter (pitch = p) as duration from (select *, max(pitch) over (partition by song, track, start) as p from n) group by all),
mono as (select song, track, start, pitch, case when lead(start) over w < start + duration then greatest(1, lead(start) over w - start) else duration end as duration from top window w as (partition by song, track order by start))"""
_SCORE = """, o as (select *, coalesce(start < max(start + duration) over (partition by song, track order by start, start + duration, id rows between unbounded preceding and 1 preceding), false) as late from n),
s as (select song, track, count(*) as n_notes, 1 - count(*) filter (late) / greatest(1, count(*) - 1) as monophony, avg(pitch) as mean_pitch, count(distinct pitch) as unique_pitches, sum(duration)::bigint as total_duration from o group by all),
t as (select song, track, (row_number() over (partition by song order by track) - 1)::integer as index from (select distinct song, track from n)),
sc as (
  select song, track, index, n_notes, monophony, mean_pitch, unique_pitches, total_duration,
    1.55 * n_notes + 75 * monophony + 0.35 * unique_pitches + greatest(0, least(12, (mean_pitch - 48) * 0.35)) + [45, -35, -35, 10, 45, 45, 10][(index % 7) + 1] + 20 / (1 + index) as score
  from s join t using (song, track))"""
_PICK = {"auto": "score desc, index", "first": "index", "most-notes": "n_notes desc, monophony desc, index", "highest": "mean_pitch desc, monophony desc, score desc, index"}

QUERIES = {f.__name__: f for f in (monophonize, origin_shift, monophony_score, track_scores, select_tracks, marker_pitches, tempo_seconds, note_on_off_pairs, pitch_bend_summary, nearest_line, join_overlaps)}
SQL = {
    "monophonize": _N + _MONO + " select * from mono",
    "origin_shift": _N + _MONO + " select song, track, start - min(start) over (partition by song, track) as start, pitch, duration from mono",
    "monophony_score": _N + _SCORE + " select song, track, n_notes, round(monophony, 6) as monophony from s",
    "track_scores": _N + _SCORE + " select song, track, index, n_notes, round(monophony, 6) as monophony, round(mean_pitch, 6) as mean_pitch, unique_pitches, total_duration, round(score, 6) as score from sc",
    "select_tracks": _N + _SCORE + " union all ".join(f" select song, track, index, '{k}' as strategy from (select *, row_number() over (partition by song order by {o}) as k from sc) where k = 1" for k, o in _PICK.items()),
    "marker_pitches": _N + """, c as (select song % 4 as grp, song, pitch, count(*) as n from n group by all), p as (select *, n / sum(n) over (partition by grp, song) as share, lag(pitch) over w as below, lead(pitch) over w as above from c window w as (partition by grp, song order by pitch)),
    g as (select grp, count(distinct song) as songs from c group by all),
    f as (select grp, pitch, count(*) as songs_containing, count(*) filter (below is null or above is null) as ends, median(share) as median_share, coalesce(median(case when below is null then above - pitch when above is null then pitch - below end), 0) as median_gap, sum(n)::bigint as events_total from p group by all)
    select grp, pitch, songs_containing, round(songs_containing / songs, 6) as song_fraction, round(ends / songs_containing, 6) as extreme_fraction, round(median_share, 6) as median_share, round(median_gap, 6) as median_gap, events_total,
      songs >= 4 and songs_containing / songs >= 0.85 and ends / songs_containing >= 0.9 and median_share <= 0.02 and median_gap >= 9 as marker from f join g using (grp)""",
    "tempo_seconds": _N + """, t as (select song, start as tick, arg_max(400000 + 1000 * (id % 200), id) as tempo from n where id % 10 = 0 group by all), z as (select song, 0 as tick, 500000 as tempo from (select distinct song from n) where (song, 0) not in (select (song, tick) from t) union all select * from t),
    g as (select *, coalesce(sum(len) over (partition by song order by tick rows between unbounded preceding and 1 preceding), 0) as us from (select *, (lead(tick) over (partition by song order by tick) - tick) * tempo as len from z))
    select n.song, n.start as tick, n.id, round((g.us + (n.start - g.tick) * g.tempo) / (480 * 1000000.0), 6) as seconds from n asof join g on n.song = g.song and n.start >= g.tick""",
    "note_on_off_pairs": _N + """, k as (select song, track, pitch, start as tick, 1 as is_on, id from n union all select song, track, pitch, start + duration, 0, id from n where id % 5 <> 0 union all select song, track, pitch, start - 1, 0, id from n where id % 7 = 0),
    a as (select *, sum(1 - 2 * is_on) over (partition by song, track, pitch order by tick, is_on, id rows unbounded preceding) as lead from k),
    b as (select *, max(lead) over (partition by song, track, pitch order by tick, is_on, id rows between unbounded preceding and 1 preceding) as top from a),
    c as (select *, row_number() over (partition by song, track, pitch, is_on order by tick, id) as r from b where is_on = 1 or lead <= greatest(0, coalesce(top, 0)))
    select song, track, pitch, x.tick as start, y.tick as "end" from c x join c y using (song, track, pitch, r) where x.is_on = 1 and y.is_on = 0 and y.tick > x.tick""",
    "nearest_line": _N.replace("with ", "with recursive ", 1) + """, c as (select song, start, list(distinct {'p': pitch, 'd': duration}) as chord, row_number() over (partition by song order by start) as k from n group by song, start),
    w(song, k, start, pick) as (
      select song, k, start, list_last(list_sort(chord)) from c where k = 1
      union all
      select c.song, c.k, c.start, list_last(list_sort(list_transform(chord, lambda x: {'a': -abs(x.p - w.pick.p), 'p': x.p, 'd': x.d}))) from w join c on c.song = w.song and c.k = w.k + 1)
    select song, start, pick.d as duration, pick.p as pitch from w""".replace("list_last(list_sort(chord))", "list_last(list_sort(list_transform(chord, lambda x: {'a': 0, 'p': x.p, 'd': x.d})))"),
    "join_overlaps": _N + """, q as (select song, start, (pitch // 12)::bigint as pitch, duration from n), t as (select song, start, max(pitch) as pitch, max(duration) filter (pitch = p) as duration from (select *, max(pitch) over (partition by song, start) as p from q) group by all),
    a as (select *, start + duration as e, case when pitch = lag(pitch) over w then 0 else 1 end as f from t window w as (partition by song order by start)),
    b as (select *, sum(f) over (partition by song order by start rows unbounded preceding) as g from a),
    c as (select *, case when start < max(e) over (partition by song, g order by start rows between unbounded preceding and 1 preceding) then 0 else 1 end as h from b),
    d as (select *, sum(h) over (partition by song, g order by start rows unbounded preceding) as k from c)
    select song, pitch, min(start) as start, max(e) - min(start) as duration from d group by song, g, k, pitch""",
    "pitch_bend_summary": f"with {EVENT_SQL.strip()} select file_id as song, count(*) as n_notes, round(avg((abs(cents) / 100.0 > 0.05)::int), 6) as bent_fraction, round(max(abs(cents)) / 100.0, 6) as largest_bend from ev group by all",
}
