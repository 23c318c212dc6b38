"""Writers of results in the shapes that other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the mapped-event table, in order.
EVENT_COLUMNS = ["id", "file_id", "phrase", "event", "source_start_frame", "source_end_frame", "source_midi", "target_midi", "target_note", "root", "degree", "modulation", "source_frames", "tuning_cents"]


def write_table(df: DataFrame, folder: str, by: str | None = None, mark: bool = False) -> None:
    """A CSV table with a header; one folder per value of ``by``. With ``mark``, files begin with the byte-order mark some spreadsheets want."""
    if mark:
        # the header is a file's first line
        first = next(c for c in df.columns if c != by)
        df = df.withColumnRenamed(first, f"\ufeff{first}")
    writer = df.write.option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(folder)


def write_documents(df: DataFrame, folder: str) -> None:
    """One JSON document a line; nulls are left out."""
    df.write.json(folder)


def assignments(clusters: DataFrame, roots: DataFrame, phrased: DataFrame) -> DataFrame:
    """file_id, cluster (from 1), estimated_root, root_score, root_margin, events, phrases."""
    from tunelore.functions.scalars import NOTE_NAMES

    sizes = phrased.groupBy("file_id").agg(F.count("*").alias("events"), F.countDistinct("phrase").alias("phrases"))
    name = F.element_at(F.array(*map(F.lit, NOTE_NAMES)), (F.col("root") + 1).cast("int"))
    return clusters.select("file_id", (F.col("label") + 1).alias("cluster")).join(roots, "file_id").join(sizes, "file_id").select("file_id", "cluster", name.alias("estimated_root"), F.round("score", 6).alias("root_score"), F.round("margin", 6).alias("root_margin"), "events", "phrases")


def event_report(mapped: DataFrame, cents: DataFrame | None = None) -> DataFrame:
    """Mapped events in the columns of the event table; cents (id, degree, cents) are the profiles' tunings."""
    from tunelore.functions.scalars import note_name

    degree = F.pmod(F.col("target") - F.col("root"), F.lit(12)).cast("int")
    rows = mapped.withColumn("degree", degree)
    rows = rows.join(cents, ["id", "degree"], "left") if cents is not None else rows.withColumn("cents", F.lit(0.0))
    return rows.select(
        "id", "file_id", "phrase", F.col("seq").alias("event"), F.col("start_frame").alias("source_start_frame"), F.col("end_frame").alias("source_end_frame"), F.round("source_midi", 4).alias("source_midi"), F.col("target").alias("target_midi"), note_name(F.col("target")).alias("target_note"), "root", "degree",
        F.col("name").alias("modulation"), F.col("frames").alias("source_frames"), F.coalesce("cents", F.lit(0.0)).alias("tuning_cents"),
    )


def note_documents(notes: DataFrame, by: str) -> DataFrame:
    """One row per value of ``by`` with its notes as a nested, ordered list: a segment's document, bounded by the segment."""
    item = F.struct(F.round("start_s", 4).alias("start"), F.round("end_s", 4).alias("end"), "pitch", F.round("confidence", 4).alias("confidence"))
    return notes.groupBy(by).agg(F.count("*").alias("note_count"), F.sort_array(F.collect_list(item)).alias("notes"))


def corpus_manifest(read: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of files read (path, .., error): one row of counts, and the failures with their errors."""
    files = read.groupBy("path").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("rows"))
    counts = files.agg(F.lit(name).alias("corpus"), F.count("*").alias("files_found"), F.count_if(F.col("error").isNull()).alias("files_read"), F.sum("rows").alias("rows"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated"))
    return counts, files.filter("error is not null").select("path", "error")
