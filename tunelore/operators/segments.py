"""Bar windows, clipping, segment quality and acceptance, frame paths and posterior grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The state of a frame without a note.
REST = 128
#: Acceptance thresholds by role (score, voiced ratio, confidence, notes).
GATES = {"main": (0.58, 0.18, 0.35, 3), "bass": (0.50, 0.15, 0.30, 2)}
#: The trust in a posterior's source, and that in an unlisted one.
TRUST = {
    "other_harmonic": 1.00, "vocals": 0.94, "guitar": 0.92, "piano": 0.92, "other": 0.84, "instrumental_harmonic": 0.84, "instrumental": 0.76, "mix_harmonic": 0.72, "mix": 0.58, "bass_harmonic": 1.00, "bass": 0.86,
}
OTHER_TRUST = 0.80


def bar_windows(beats: DataFrame, beats_per_bar: int = 4, segment_bars: int = 2, stride_bars: int = 1) -> DataFrame:
    """file_id, segment_index, start_bar, end_bar, start, end: windows of whole bars.

    beats (file_id, beat, time, phase): bars begin at every n-th beat from the
    file's phase; a window needs the bar line that ends it.
    """
    bars = beats.filter((F.col("beat") >= F.col("phase")) & ((F.col("beat") - F.col("phase")) % beats_per_bar == 0)).withColumn("bar", ((F.col("beat") - F.col("phase")) / beats_per_bar).cast("int"))
    ends = bars.withColumn("end", F.lead("time", segment_bars).over(W.partitionBy("file_id").orderBy("bar"))).filter((F.col("bar") % stride_bars == 0) & F.col("end").isNotNull())
    return ends.select("file_id", (F.floor(F.col("bar") / stride_bars) + 1).alias("segment_index"), (F.col("bar") + 1).alias("start_bar"), (F.col("bar") + segment_bars).alias("end_bar"), F.col("time").alias("start"), "end")


def clip_to_windows(notes: DataFrame, windows: DataFrame, bucket: int) -> DataFrame:
    """Rows of ``notes`` (file_id, id, start, end, ..) for each window (file_id, segment_index, start, end) they overlap, clipped to it.

    Both sides meet by file and time bucket; a pair counts in the first bucket
    that both touch, so that it comes out once.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / bucket))))
    n, w = spread(notes).alias("n"), spread(windows).alias("w")
    near = (F.col("n.file_id") == F.col("w.file_id")) & (F.col("n._b") == F.col("w._b")) & (F.col("n.end") > F.col("w.start")) & (F.col("n.start") < F.col("w.end"))
    once = F.col("n._b") == F.greatest(F.floor(F.col("n.start") / bucket), F.floor(F.col("w.start") / bucket))
    rest = [F.col(f"n.{c}") for c in notes.columns if c not in ("start", "end")]
    return n.join(w, near & once).select(*rest, "w.segment_index", F.greatest("n.start", "w.start").alias("start"), F.least("n.end", "w.end").alias("end"))


def segment_quality(notes: DataFrame, by: str) -> DataFrame:
    """Of each segment: voiced_ratio, mean_confidence, large_jump_ratio, octave_jump_ratio, note_count, score.

    notes (``by``, start, end in ticks of time, pitch, confidence in
    ten-thousandths, id); the segment ends with its last note. Sums are of
    integers, so that their order doesn't matter.
    """
    jump = F.abs(F.col("pitch") - F.lag("pitch").over(W.partitionBy(by).orderBy("start", "id")))
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    sums = notes.withColumn("_jump", jump).groupBy(by).agg(
        F.sum(length).alias("voiced"), F.max("end").alias("duration"), F.sum(length * F.col("confidence")).alias("weighted"), F.count("_jump").alias("jumps"), F.count_if(F.col("_jump") >= 8).alias("large"), F.count_if(F.col("_jump").isin(12, 24)).alias("octave"), F.count("*").alias("note_count"),
    )
    ratio = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    out = sums.select(
        by, F.least(F.lit(1.0), ratio(F.col("voiced"), F.col("duration"))).alias("voiced_ratio"), ratio(F.col("weighted"), F.col("voiced") * 10_000).alias("mean_confidence"), ratio(F.col("large"), F.col("jumps")).alias("large_jump_ratio"), ratio(F.col("octave"), F.col("jumps")).alias("octave_jump_ratio"), "note_count",
    )
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = 0.42 * clip(F.col("mean_confidence")) + 0.28 * clip(F.col("voiced_ratio") / 0.55) + 0.15 * clip(F.col("note_count") / 6.0) + 0.10 * (1 - F.col("large_jump_ratio")) + 0.05 * (1 - F.col("octave_jump_ratio"))
    return out.withColumn("score", score)


def gate(segments: DataFrame, role: str) -> DataFrame:
    """``segments`` with ``reason``: the thresholds of the row's role that it misses, and ``accepted``."""

    def reason(role_name: str) -> Column:
        score, voiced, confidence, notes = GATES[role_name]
        return F.concat_ws(
            ";", F.when(F.col("score") < score, f"score<{score:.2f}"), F.when(F.col("voiced_ratio") < voiced, f"voiced<{voiced:.2f}"), F.when(F.col("mean_confidence") < confidence, f"confidence<{confidence:.2f}"), F.when(F.col("note_count") < notes, f"notes<{notes}"),
        )

    out = segments.withColumn("reason", F.when(F.col(role) == "bass", reason("bass")).otherwise(reason("main")))
    return out.withColumn("accepted", F.col("reason") == "")


def bridge_gaps(path: DataFrame, most: int) -> DataFrame:
    """Runs of a path (file_id, start, end, state) with short rests between equal states bridged.

    path: runs of equal state without holes, REST among them; a run with
    ``protected`` true stays. Bridged neighbours become one run.
    """
    w = W.partitionBy("file_id").orderBy("start")
    around = path.withColumn("_left", F.lag("state").over(w)).withColumn("_right", F.lead("state").over(w))
    short = (F.col("state") == REST) & (F.col("end") - F.col("start") <= most) & (F.col("_left") == F.col("_right")) & (F.col("_left") != REST) & ~F.col("protected")
    filled = around.withColumn("_bridged", F.coalesce(short, F.lit(False))).withColumn("state", F.when(F.col("_bridged"), F.col("_left")).otherwise(F.col("state")))
    # a run goes on where it or the one before it was a bridge
    joins = (F.col("state") == F.lag("state").over(w)) & (F.col("_bridged") | F.lag("_bridged").over(w))
    numbered = filled.withColumn("_run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("file_id", "_run", "state").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def path_to_notes(frames: DataFrame, least: int, rescue_least: int, rescue_confidence: float, rescue_onset: float, lookahead: int) -> DataFrame:
    """Notes of a frame path: file_id, start, end, pitch, confidence, onset.

    frames (file_id, frame, state, confidence, onset, boundary): a note is a
    stretch of one state, cut where ``boundary``; it is kept if long enough, or
    if long enough for a rescue and strong in mean positive confidence and in
    its largest onset within ``lookahead`` frames.
    """
    w = W.partitionBy("file_id").orderBy("frame")
    fresh = F.coalesce((F.col("state") != F.lag("state").over(w)) | (F.col("frame") != F.lag("frame").over(w) + 1) | F.col("boundary"), F.lit(True))
    runs = frames.withColumn("_run", F.count_if(fresh).over(w.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("state") != REST)
    runs = runs.withColumn("_first", F.min("frame").over(W.partitionBy("file_id", "_run")))
    notes = runs.groupBy("file_id", "_run").agg(
        F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.first("state").alias("pitch"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.coalesce(F.max(F.when(F.col("frame") < F.col("_first") + lookahead, F.col("onset"))), F.lit(0.0)).alias("onset"),
    )
    length = F.col("end") - F.col("start")
    return notes.filter((length >= least) | ((length >= rescue_least) & (F.col("confidence") >= rescue_confidence) & (F.col("onset") >= rescue_onset))).drop("_run")


def covering_windows(durations: DataFrame, window: int, overlap: int) -> DataFrame:
    """file_id, window, start, end, is_first, is_last: overlapping windows over 0..duration; none of no duration."""
    step = window - min(max(0, overlap), window - 1)
    last = F.greatest(F.lit(0), F.ceil((F.col("duration") - window) / step)).cast("int")
    out = durations.filter("duration > 0").withColumn("_last", last).select("file_id", "duration", "_last", F.explode(F.sequence(F.lit(0), "_last")).alias("window"))
    return out.select("file_id", "window", (F.col("window") * step).alias("start"), F.least("duration", F.col("window") * step + window).alias("end"), (F.col("window") == 0).alias("is_first"), (F.col("window") == F.col("_last")).alias("is_last"))


def edge_weight(offset: Column, length: Column, overlap: int, is_first: Column, is_last: Column) -> Column:
    """A window's weight at an offset: 1 in the middle, squared sine over half the overlap at either edge that meets another window."""
    fade = F.least(F.lit(overlap // 2), F.floor(length / 2))
    ramp = lambda i: F.pow(F.sin(math.pi / 2 * i / (fade - 1)), F.lit(2.0))
    weight = F.when((fade > 1) & ~is_first & (offset < fade), ramp(offset)).otherwise(1.0)
    return F.when((fade > 1) & ~is_last & (offset >= length - fade), ramp(length - 1 - offset)).otherwise(weight)


def overlap_add(values: DataFrame) -> DataFrame:
    """Weighted means (file_id, frame, pitch, value) of windows' values (.., value, weight); 0 where all weights are."""
    total = F.sum("weight")
    return values.groupBy("file_id", "frame", "pitch").agg(F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("weight")), total), F.lit(0.0)).alias("value"))


def fuse_sources(posteriors: DataFrame, bonus: float = 0.15) -> DataFrame:
    """The fused salience of each (file_id, frame, pitch): the most trusted source's, plus a bonus for the second.

    posteriors (file_id, frame, pitch, source, value). Values are weighted by
    the trust in their source and clipped to 0..1, as is the result.
    """
    trust = F.coalesce(F.create_map(*(x for k, v in TRUST.items() for x in (F.lit(k), F.lit(v))))[F.col("source")], F.lit(OTHER_TRUST))
    weighted = posteriors.withColumn("_v", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") * trust)))
    by = ["file_id", "frame", "pitch"]
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_v"), "source"))
    top = weighted.withColumn("_k", rank).filter("_k <= 2").groupBy(*by).agg(F.max("_v").alias("_first"), F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("_v"))), F.lit(0.0)).alias("_second"))
    return top.select(*by, F.least(F.lit(1.0), F.col("_first") + min(0.5, max(0.0, bonus)) * F.col("_second")).alias("value"))


def frame_rises(grid: DataFrame) -> DataFrame:
    """``grid`` (file_id, pitch, frame, value; frames without holes) with ``rise``: the least of the one- and two-step increases, not below 0 and scaled to a largest of 1 in the file."""
    w = W.partitionBy("file_id", "pitch").orderBy("frame")
    rise = F.when(F.lag("value", 2).over(w).isNotNull(), F.greatest(F.lit(0.0), F.least(F.col("value") - F.lag("value", 1).over(w), F.col("value") - F.lag("value", 2).over(w)))).otherwise(0.0)
    raw = grid.withColumn("_rise", rise)
    top = raw.groupBy("file_id").agg(F.max("_rise").alias("_top"))
    return raw.join(top, "file_id").withColumn("rise", F.when(F.col("_top") > 1e-12, F.col("_rise") / F.col("_top")).otherwise(0.0)).drop("_rise", "_top")


def local_peaks(curve: DataFrame, value: str, threshold: float) -> DataFrame:
    """Rows of (file_id, pitch, frame, ..) at least as high as both neighbours and the threshold; ends have no peak."""
    w = W.partitionBy("file_id", "pitch").orderBy("frame")
    near = curve.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    return near.filter((F.col(value) >= threshold) & (F.col(value) >= F.col("_a")) & (F.col(value) >= F.col("_b"))).drop("_a", "_b")


def note_grid(notes: DataFrame, step: int) -> DataFrame:
    """The largest amplitude of each (file_id, pitch, frame) over notes (file_id, pitch, start, end, amplitude), frames of ``step``."""
    cells = notes.select("file_id", "pitch", "amplitude", F.explode(F.sequence(F.floor(F.col("start") / step), F.greatest(F.floor(F.col("start") / step), F.ceil(F.col("end") / step) - 1))).alias("frame"))
    return cells.groupBy("file_id", "pitch", "frame").agg(F.max("amplitude").alias("amplitude"))


def smoothed(track: DataFrame, radius: int) -> DataFrame:
    """``track`` (file_id, frame, midi) with ``smooth``: the centred median, missing frames skipped and left missing."""
    w = W.partitionBy("file_id").orderBy("frame").rowsBetween(-radius, radius)
    return track.withColumn("smooth", F.when(F.col("midi").isNotNull(), F.percentile("midi", F.lit(0.5)).over(w)))


def fill_short_gaps(track: DataFrame, most: int, within: float) -> DataFrame:
    """``track`` with gaps of at most ``most`` missing frames filled linearly where both ends are within ``within`` semitones."""
    w = W.partitionBy("file_id").orderBy("frame")
    back, ahead = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    last = F.last(F.when(F.col("midi").isNotNull(), F.struct("frame", "midi")), ignorenulls=True).over(back)
    following = F.first(F.when(F.col("midi").isNotNull(), F.struct("frame", "midi")), ignorenulls=True).over(ahead)
    t = track.withColumn("_l", last).withColumn("_r", following)
    fits = (F.col("_r.frame") - F.col("_l.frame") - 1 <= most) & (F.abs(F.col("_r.midi") - F.col("_l.midi")) <= within)
    line = F.col("_l.midi") + (F.col("_r.midi") - F.col("_l.midi")) * (F.col("frame") - F.col("_l.frame")) / (F.col("_r.frame") - F.col("_l.frame"))
    return t.withColumn("filled", F.coalesce("midi", F.when(fits, line))).drop("_l", "_r")


def resample_time(grid: DataFrame, targets: DataFrame) -> DataFrame:
    """Values (file_id, pitch, frame, value; frames 0.. without holes) brought linearly to each file's number of frames (file_id, frames).

    First and last frames stay; a grid of one frame is repeated, and one target
    frame is the first of the source.
    """
    sizes = grid.groupBy("file_id").agg((F.max("frame") + 1).alias("_n"))
    w = W.partitionBy("file_id", "pitch").orderBy("frame")
    rows = grid.join(sizes, "file_id").join(targets.select("file_id", F.col("frames").alias("_m")), "file_id").withColumn("_next", F.lead("value").over(w))
    # the target frames j whose place j (n - 1) / (m - 1) lies in [frame, frame + 1)
    n1, m1 = F.col("_n") - 1, F.greatest(F.lit(1), F.col("_m") - 1)
    first = F.ceil(F.try_divide(F.col("frame") * m1, n1))
    last = F.when(F.col("frame") == n1, F.col("_m") - 1).otherwise(F.ceil(F.try_divide((F.col("frame") + 1) * m1, n1)) - 1)
    places = F.when(F.col("_n") == 1, F.sequence(F.lit(0).cast("bigint"), F.col("_m").cast("bigint") - 1)).when(F.col("_m") == 1, F.when(F.col("frame") == 0, F.array(F.lit(0).cast("bigint")))).when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    spread = rows.filter("_m > 0").withColumn("_j", F.explode(places))
    part = F.coalesce(F.try_divide(F.col("_j") * n1, F.col("_m") - 1), F.lit(0.0)) - F.col("frame")
    value = F.when((F.col("_n") == 1) | F.col("_next").isNull() | (F.col("_m") == 1), F.col("value")).otherwise(F.col("value") + (F.col("_next") - F.col("value")) * part)
    return spread.select("file_id", "pitch", F.col("_j").alias("frame"), value.alias("value"))


#: Shares of note, contour and onset posteriors in a salience; of the onset posterior in an onset's evidence; the salience that lets an attack count in full; the largest share of attacks.
SALIENCE_SHARES, ONSET_SHARE, FULL_GATE, MOST_ATTACK = (0.82, 0.18, 0.04), 0.55, 0.18, 0.40


def mixed_posteriors(cells: DataFrame, low: int, high: int, attack_share: float) -> DataFrame:
    """file_id, frame, pitch, salience, onset of posterior cells, of the pitches ``low`` to ``high``.

    cells: note, onset, contour (an array of a semitone's parts, or null), rise
    and attack, in 0..1. Salience mixes notes, contour and onsets; an onset's
    evidence mixes onsets, rises and attacks, these as far as the pitch is salient.
    """
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    share = max(0.0, min(MOST_ATTACK, attack_share))
    parts = (unit(F.coalesce("note", F.lit(0.0))), unit(F.coalesce(F.array_max("contour"), F.lit(0.0))), unit(F.coalesce("onset", F.lit(0.0))))
    mixed = cells.filter(F.col("pitch").between(low, high)).withColumn("_onset", parts[2]).withColumn("salience", unit(sum((s * p for s, p in zip(SALIENCE_SHARES, parts)), F.lit(0.0))))
    evidence = ONSET_SHARE * F.col("_onset") + max(0.0, 1 - ONSET_SHARE - share) * F.coalesce("rise", F.lit(0.0)) + share * F.coalesce("attack", F.lit(0.0)) * unit(F.col("salience") / FULL_GATE)
    return mixed.select("file_id", "frame", "pitch", "salience", unit(evidence).alias("onset"))
