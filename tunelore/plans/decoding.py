"""Queries on frame tracks, posteriors and raw notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.operators import kernels as k
from tunelore.operators.events import EVENT_SQL, melody_events
from tunelore.sources.tables import table


def frames_to_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a track of the adapter's whole pitches, with an onset at every third event."""
    ev = melody_events(spark, folder)
    frames = ev.select("file_id", "pitch", "start_frame", "event_id", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame"))
    return k.events_of_tracks(frames.select("file_id", "frame", F.col("pitch").cast("double").alias("midi"), ((F.col("frame") == F.col("start_frame")) & (F.col("event_id") % 3 == 0)).alias("onset")))


def frame_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    """The path through posteriors of one pitch a file, sure where the adapter's notes sound, faint three semitones below and absent in the gaps."""
    ev = melody_events(spark, folder)
    cells = ev.select("file_id", F.explode(F.sequence(F.floor(F.col("start_frame") / 4), F.floor((F.col("end_frame") - 1) / 4))).alias("frame")).distinct()
    sounds = F.array(F.struct((F.col("file_id") % 40 + 40).cast("int").alias("pitch"), F.lit(0.9).alias("salience")), F.struct((F.col("file_id") % 40 + 37).cast("int").alias("pitch"), F.lit(0.2).alias("salience")))
    cells = cells.select("file_id", "frame", F.explode(sounds).alias("c")).select("file_id", "frame", "c.*", F.lit(0.0).alias("onset"))
    return k.decode_posteriors(cells).withColumn("confidence", F.round("confidence", 6))


def fragment_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Notes without fragments: of every event, one fragment stands inside a note or ends it."""
    ev = melody_events(spark, folder).select("file_id", "event_id", "seq", (40 + F.col("seq") % 5 * 4).cast("int").alias("p"))
    piece = lambda a, b, p, c: F.struct((F.col("seq") * 4 + a).cast("double").alias("start_s"), (F.col("seq") * 4 + b).cast("double").alias("end_s"), p.cast("int").alias("pitch"), F.lit(c).alias("confidence"))
    inside = F.array(piece(0.0, 1.0, F.col("p"), 0.9), piece(1.0, 1.0625, F.col("p") + 1, 0.3), piece(1.0625, 2.0, F.col("p"), 0.5))
    ended = F.array(piece(0.0, 1.0, F.col("p"), 0.9), piece(1.0, 1.0625, F.col("p"), 0.3))
    notes = ev.select("file_id", F.explode(F.when(F.col("event_id") % 2 == 0, inside).otherwise(ended)).alias("n")).select("file_id", "n.*")
    return k.clean_notes(notes, "file_id").withColumn("confidence", F.round("confidence", 9))


def candidate_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """The extracted notes of each candidate without unsure fragments."""
    notes = table(spark, folder, "notes").filter("pitch between 0 and 127 and confidence between 0 and 1").dropDuplicates(["note_id"])
    return k.clean_notes(notes, "candidate_id", 0.2, 0.75, 4)


_E = f"with {EVENT_SQL.strip()} "
QUERIES = {f.__name__: f for f in (frames_to_events, frame_viterbi, fragment_cleanup, candidate_cleanup)}
SQL = {
    "frames_to_events": _E + """, m as (select *, case when pitch = lag(pitch) over w and start_frame = lag(end_frame) over w and event_id % 3 <> 0 then 0 else 1 end as fresh from ev window w as (partition by file_id order by seq)),
    g as (select *, sum(fresh) over (partition by file_id order by seq rows unbounded preceding) as run from m)
    select file_id, min(start_frame) as start_frame, max(end_frame) as end_frame, any_value(pitch)::double as source_midi from g group by file_id, run""",
    "frame_viterbi": _E + """, s as (select distinct file_id, unnest(range(start_frame // 4, (end_frame - 1) // 4 + 1)) as frame from ev), a as (select file_id, unnest(range(min(frame), max(frame) + 1)) as frame from s group by file_id)
    select a.file_id, a.frame, case when s.frame is null then 128 else a.file_id % 40 + 40 end::integer as state, case when s.frame is null then 0.0 else 0.9 end::double as confidence, false as boundary from a left join s using (file_id, frame)""",
    "fragment_cleanup": _E + """select file_id, seq * 4.0::double as start_s, case when event_id % 2 = 0 then seq * 4 + 2.0 else seq * 4 + 1.0625 end::double as end_s, (40 + seq % 5 * 4)::integer as pitch,
      round(case when event_id % 2 = 0 then (0.9 * 1 + 0.5 * 0.9375) / 1.9375 else (0.9 * 1 + 0.3 * 0.0625) / 1.0625 end, 9)::double as confidence from ev""",
}
