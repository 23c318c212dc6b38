"""The note-event timeline on which the corpus operators work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.operators.ordered import Running, ordered
from tunelore.sources.tables import table
from tunelore.staging import stage_once

#: Columns: file_id, seq, pitch, cents, source_midi, frames, gap_frames, start_frame, end_frame, channel, pc.
EVENT_SQL = """
ev0 as (
  select user_id as file_id, event_id, ts, event_type as channel, cast(regexp_extract(props, '[0-9]+') as integer) as k, cast(floor(value) as bigint) as whole,
    row_number() over (partition by user_id order by ts, event_id)::integer as seq,
    (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) // 2000000000 as gap
  from events),
ev1 as (
  select file_id, event_id, seq, channel, 36 + k % 49 as pitch, event_id % 21 - 10 as cents, 4 + whole % 24 as frames, coalesce(least(60, gap), 0) as gap_frames from ev0),
ev2 as (
  select *, sum(frames + gap_frames) over (partition by file_id order by seq rows unbounded preceding)::bigint as end_frame from ev1),
ev as (
  select file_id, event_id, seq, channel, pitch, cents, pitch * 100 + cents as midi_cents, pitch + cents / 100.0::double as source_midi, frames, gap_frames, end_frame - frames as start_frame, end_frame, pitch % 12 as pc from ev2)"""


def file_sizes(phrased: DataFrame, least_events: int = 3, least_phrases: int = 1) -> DataFrame:
    """file_id, n_events, n_phrases, and the reason to leave the file out: ``few_events``, ``no_phrase`` or null."""
    sizes = phrased.groupBy("file_id").agg(F.count("*").alias("n_events"), F.countDistinct("phrase").alias("n_phrases"))
    return sizes.withColumn("reason", F.when(F.col("n_events") < least_events, "few_events").when(F.col("n_phrases") < least_phrases, "no_phrase"))


def large_enough(phrased: DataFrame, least_events: int = 3, least_phrases: int = 1) -> DataFrame:
    """``phrased`` events of the files that ``file_sizes`` gives no reason to leave out."""
    return phrased.join(file_sizes(phrased, least_events, least_phrases).filter("reason is null").select("file_id"), "file_id", "left_semi")


def melody_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table as note events: one user is one file, integer frames.

    file_id, event_id, seq, channel, pitch, cents, midi_cents (pitch in cents),
    source_midi, frames, gap_frames, start_frame, end_frame, pc.
    """
    return stage_once(spark, f"{folder}/events.parquet", "events", lambda: _melody_events(table(spark, folder, "events")))


def _melody_events(raw: DataFrame) -> DataFrame:
    timed = raw.select(F.col("user_id").alias("file_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("channel"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"), F.floor("value").alias("whole"))
    numbered = ordered(timed, ["file_id"], ["us", "event_id"], Running("seq", lags={"before": "us"}))
    gap = F.floor((F.col("us") - F.col("before")) / F.lit(2_000_000_000))
    events = numbered.select(
        "file_id", "event_id", F.col("seq").cast("int").alias("seq"), "channel", (36 + F.col("k") % 49).alias("pitch"), (F.col("event_id") % 21 - 10).alias("cents"), (4 + F.col("whole") % 24).alias("frames"), F.coalesce(F.least(F.lit(60), gap), F.lit(0)).alias("gap_frames"),
    ).withColumn("_length", F.col("frames") + F.col("gap_frames"))
    return ordered(events, ["file_id"], ["seq"], Running("_n", sums={"end_frame": "_length"})).select(
        "file_id", "event_id", "seq", "channel", "pitch", "cents", (F.col("pitch") * 100 + F.col("cents")).alias("midi_cents"), (F.col("pitch") + F.col("cents") / 100.0).alias("source_midi"), "frames", "gap_frames", (F.col("end_frame") - F.col("frames")).alias("start_frame"), "end_frame", (F.col("pitch") % 12).alias("pc"),
    )
