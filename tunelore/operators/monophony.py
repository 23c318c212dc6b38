"""Symbolic notes: message pairing, tempo maps, track choice and reduction to one line.

Notes have song, track, start, duration, pitch and id (a tie-breaker).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.ordered import Running, ordered

#: Words in a track's name that speak for and against a melody.
LEAD_WORDS = ["main", "melody", "lead", "vocal", "voice", "miku", "rin", "len", "kaito", "meiko", "gumi", "メロ", "メロディ", "ボーカル", "ヴォーカル", "ミク", "歌"]
BACK_WORDS = ["harm", "harmony", "chorus", "back", "backing", "sub", "guide", "bass", "chord", "accomp", "伴奏", "コード", "ベース", "ドラム"]
#: Fixed value: the channel of drums, counted from 0.
DRUM_CHANNEL = 9


def without_drums(messages: DataFrame, channel: str = "channel") -> DataFrame:
    """``messages`` or notes but those on the drum channel; those without channel stay."""
    return messages.filter(~F.col(channel).eqNullSafe(F.lit(DRUM_CHANNEL)))


def pair_messages(messages: DataFrame, by: list[str], order: list[str], on: str = "is_on", tick: str = "tick") -> DataFrame:
    """Notes of note-on and note-off messages: ``by``, start, end.

    In each queue (``by``: song, channel, pitch) the oldest open note ends
    first. An off without an open note is stray: the offs so far then exceed
    the ons by more than ever before, which a running maximum shows, so that
    no queue is walked through. Unended notes and notes of no length are left
    out.
    """
    w = W.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    ahead = messages.withColumn("_ahead", F.sum(F.when(F.col(on), -1).otherwise(1)).over(upto))
    stray = ~F.col(on) & (F.col("_ahead") > F.greatest(F.lit(0), F.coalesce(F.max("_ahead").over(before), F.lit(0))))
    kept = ahead.withColumn("_stray", stray).filter(~F.col("_stray"))
    ranked = kept.withColumn("_k", F.row_number().over(W.partitionBy(*by, on).orderBy(*order)))
    pairs = ranked.groupBy(*by, "_k").agg(F.max(F.when(F.col(on), F.col(tick))).alias("start"), F.max(F.when(~F.col(on), F.col(tick))).alias("end"))
    return pairs.filter(F.col("end") > F.col("start")).drop("_k")


def seconds_at(notes: DataFrame, tempos: DataFrame, ticks_per_beat: int = 480, default: int = 500_000) -> DataFrame:
    """``notes`` (song, tick, id) with ``seconds``: the time elapsed at their tick under the song's tempo map.

    tempos (song, tick, tempo in microseconds a beat, id): the tempo in force
    is the last one at or before a tick, of several at one tick that of the
    largest id; before the first it is ``default``.
    """
    both = tempos.select("song", "tick", F.lit(0).alias("kind"), "id", "tempo").unionByName(notes.select("song", "tick", F.lit(1).alias("kind"), "id", F.lit(None).cast("bigint").alias("tempo")))
    w = W.partitionBy("song").orderBy("tick", "kind", "id")
    force = F.coalesce(F.last("tempo", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(default))
    step = (F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0))) * force
    timed = both.withColumn("_step", step).withColumn("_us", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return timed.filter("kind = 1").select("song", "tick", "id", (F.col("_us") / (ticks_per_beat * 1_000_000.0)).alias("seconds"))


def top_of_chords(notes: DataFrame, by: list[str]) -> DataFrame:
    """Of the notes that begin together the highest, of equals the longest."""
    return notes.groupBy(*by, "start").agg(F.max(F.struct("pitch", "duration")).alias("_n")).select(*by, "start", "_n.duration", "_n.pitch")


def monophonize(notes: DataFrame, by: list[str]) -> DataFrame:
    """One line: the top of each chord, each note cut at the next onset, none shorter than 1."""
    line = ordered(top_of_chords(notes, by), by, ["start"], Running("_n", leads={"_next": "start"})).drop("_n")
    return line.withColumn("duration", F.when(F.col("_next") < F.col("start") + F.col("duration"), F.greatest(F.lit(1), F.col("_next") - F.col("start"))).otherwise(F.col("duration"))).filter("duration > 0").drop("_next")


def from_zero(notes: DataFrame, by: list[str]) -> DataFrame:
    """``notes`` moved so that the first of each group begins at 0."""
    first = notes.groupBy(*by).agg(F.min("start").alias("_first"))
    return notes.join(first, by).withColumn("start", F.col("start") - F.col("_first")).drop("_first")


def monophony_scores(notes: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n_notes, monophony: 1 less the share of notes that begin before the end of any note before them."""
    ends = notes.select(*by, "start", (F.col("start") + F.col("duration")).alias("end"), "id")
    marked = ordered(ends, by, ["start", "end", "id"], Running("_n", maxes={"_latest": "end"})).withColumn("_over", F.coalesce(F.col("start") < F.col("_latest"), F.lit(False)))
    return marked.groupBy(*by).agg(F.count("*").alias("n_notes"), (1 - F.count_if("_over") / F.greatest(F.lit(1), F.count("*") - 1)).alias("monophony"))


def track_scores(notes: DataFrame, tracks: DataFrame) -> DataFrame:
    """song, track, index, n_notes, monophony, mean_pitch, unique_pitches, total_duration, score.

    tracks (song, track, index, name). Many notes, one line, many pitches, a
    high register, an early place and a telling name speak for a melody.
    """
    by = ["song", "track"]
    stats = notes.groupBy(*by).agg(F.avg("pitch").alias("mean_pitch"), F.countDistinct("pitch").alias("unique_pitches"), F.sum("duration").alias("total_duration"))
    out = monophony_scores(notes, by).join(stats, by).join(tracks, by)
    has = lambda words: F.lower("name").rlike("|".join(words))
    register = F.greatest(F.lit(0.0), F.least(F.lit(12.0), (F.col("mean_pitch") - 48.0) * 0.35))
    bonus = F.when(has(LEAD_WORDS), 45.0).otherwise(0.0) - F.when(has(BACK_WORDS), 35.0).otherwise(0.0)
    score = 1.55 * F.col("n_notes") + 75.0 * F.col("monophony") + 0.35 * F.col("unique_pitches") + register + bonus + 20.0 / (1.0 + F.greatest(F.lit(0), F.col("index")))
    return out.select(*by, "index", "n_notes", "monophony", "mean_pitch", "unique_pitches", "total_duration", score.alias("score"))


#: What each strategy prefers, best last in order.
STRATEGIES = {"auto": ["score", "-index"], "first": ["-index"], "most-notes": ["n_notes", "monophony", "-index"], "highest": ["mean_pitch", "monophony", "score", "-index"]}


def select_track(scores: DataFrame, strategy: str = "auto") -> DataFrame:
    """The track of each song that a strategy prefers; ties go to the earlier track."""
    wish = F.struct(*((-F.col(c[1:])).alias(f"w{i}") if c[0] == "-" else F.col(c).alias(f"w{i}") for i, c in enumerate(STRATEGIES[strategy])))
    return scores.groupBy("song").agg(F.max_by(F.struct("track", "index"), wish).alias("x")).select("song", "x.track", "x.index")


def marker_pitches(notes: DataFrame, least_songs: int = 4, in_songs: float = 0.85, extreme: float = 0.90, share: float = 0.02, gap: float = 9.0) -> DataFrame:
    """Pitches that look like markers rather than melody, by group: all pitches' figures and ``marker``.

    notes (grp, song, pitch). A marker is in most songs of its group, nearly
    always their lowest or highest pitch, rare in each, and far from the next
    pitch. Groups of fewer than ``least_songs`` songs have none.
    """
    counts = notes.groupBy("grp", "song", "pitch").agg(F.count("*").alias("n"))
    song = W.partitionBy("grp", "song")
    up = song.orderBy("pitch")
    placed = counts.select("grp", "song", "pitch", "n", (F.col("n") / F.sum("n").over(song)).alias("share"), F.lag("pitch").over(up).alias("below"), F.lead("pitch").over(up).alias("above"))
    # of a song's one pitch there is no gap
    placed = placed.withColumn("extreme", F.col("below").isNull() | F.col("above").isNull()).withColumn("gap", F.when(F.col("below").isNull(), F.col("above") - F.col("pitch")).when(F.col("above").isNull(), F.col("pitch") - F.col("below")))
    songs = notes.groupBy("grp").agg(F.countDistinct("song").alias("songs"))
    found = placed.groupBy("grp", "pitch").agg(F.count("*").alias("songs_containing"), F.count_if("extreme").alias("_extreme"), F.percentile("share", F.lit(0.5)).alias("median_share"), F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(0.0)).alias("median_gap"), F.sum("n").alias("events_total")).join(songs, "grp")
    fraction, ends = F.col("songs_containing") / F.col("songs"), F.col("_extreme") / F.col("songs_containing")
    marker = (F.col("songs") >= least_songs) & (fraction >= in_songs) & (ends >= extreme) & (F.col("median_share") <= share) & (F.col("median_gap") >= gap)
    return found.select("grp", "pitch", "songs_containing", fraction.alias("song_fraction"), ends.alias("extreme_fraction"), "median_share", "median_gap", "events_total", marker.alias("marker"))


def without_markers(notes: DataFrame, markers: DataFrame) -> DataFrame:
    """``notes`` without the pitches marked in their group."""
    return notes.join(markers.filter("marker").select("grp", "pitch"), ["grp", "pitch"], "left_anti")


def bend_semitones(value: Column, sensitivity: Column) -> Column:
    """Pitch-wheel value -8192..8191 in semitones, under a range of ``sensitivity``."""
    return value / 8192.0 * sensitivity


def nearest_line(notes: DataFrame) -> DataFrame:
    """song, start, duration, pitch: of each chord the note nearest to the last choice, of equals the higher; the first chord's highest.

    Each choice depends on the one before, so a song's chords pass in order
    through one task, a batch at a time, with the last pitch as all that is
    kept. Notes without pitch are rests and choose nothing.
    """
    chords = notes.filter(F.col("pitch").isNotNull()).groupBy("song", "start").agg(F.sort_array(F.collect_set(F.struct("pitch", "duration"))).alias("chord"))
    kind = notes.schema["song"].dataType.simpleString()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        song = last = None
        for pdf in batches:
            chosen = []
            for s, chord in zip(pdf["song"], pdf["chord"]):
                if s != song:
                    song, last = s, None
                pick = max(chord, key=lambda n: (0 if last is None else -abs(n["pitch"] - last), n["pitch"], n["duration"]))
                last = pick["pitch"]
                chosen.append((pick["duration"], pick["pitch"]))
            yield pd.DataFrame({"song": pdf["song"], "start": pdf["start"], "duration": [d for d, _ in chosen], "pitch": [p for _, p in chosen]})

    return chords.repartition("song").sortWithinPartitions("song", "start").mapInPandas(local, f"song {kind}, start bigint, duration bigint, pitch int")


def join_overlaps(line: DataFrame, by: list[str]) -> DataFrame:
    """A line whose neighbouring notes of one pitch are one where the later begins before the earlier ends."""
    w = W.partitionBy(*by).orderBy("start")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    pitched = line.withColumn("end", F.col("start") + F.col("duration")).withColumn("_p", F.count_if(F.coalesce(F.col("pitch") != F.lag("pitch").over(w), F.lit(True))).over(upto))
    inner = W.partitionBy(*by, "_p").orderBy("start")
    reach = F.max("end").over(inner.rowsBetween(W.unboundedPreceding, -1))
    runs = pitched.withColumn("_r", F.coalesce(F.col("start") >= reach, F.lit(True)))
    numbered = runs.withColumn("_k", F.count_if("_r").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_p", "_k", "pitch").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("duration")).drop("_p", "_k")


def bend_ranges(messages: DataFrame, by: list[str], order: list[str], default: float = 2.0) -> DataFrame:
    """``messages`` with ``sensitivity``: the pitch-wheel range in semitones in force at each.

    Controllers 101 and 100 choose a parameter; while it is 0/0, controller 6
    sets semitones and controller 38 cents of the range.
    """
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    held = lambda c: F.last(F.when(F.col("control") == c, F.col("value")), ignorenulls=True).over(w)
    chosen = messages.withColumn("_open", (held(101) == 0) & (held(100) == 0))
    coarse = F.last(F.when(F.col("_open") & (F.col("control") == 6), F.col("value")), ignorenulls=True).over(w)
    fine = F.last(F.when(F.col("_open") & (F.col("control") == 38), F.col("value")), ignorenulls=True).over(w)
    return chosen.withColumn("sensitivity", F.coalesce(coarse, F.lit(default)) + F.coalesce(fine, F.lit(0)) / 100.0).drop("_open")
