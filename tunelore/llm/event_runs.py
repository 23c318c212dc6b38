"""Repeated consecutive events in sequences, collapsed into one event each.

Range-sorted chunks encode their runs piece by piece and hand on the first and
the last one; a parallel prefix merge joins those across boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.operators.runs import CLOSED, RUN_COLUMNS, RUN_FIELDS, Likeness, OpenRun, chunk_count, chunk_number, column, encode_runs, merge_boundaries, pieces, range_chunks
from tunelore.staging import stage


def runs(df: DataFrame, key: str, start: str, end: str, value: str, ident: str, like: Likeness, min_count: int = 1) -> DataFrame:
    """Each longest chain of like neighbours as one row: key, start, end, n, first_value, last_value.

    start is the first event's, end the largest; events without key, start or
    end have no place in a sequence and come in no run; an event without value
    (null, NaN) is a run of its own. Rows of the same key, start and ident are
    one event. Chains of fewer than ``min_count`` events are left out.
    """
    events = df.select(
        F.col(key).cast("bigint").alias("key"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"), F.col(value).cast("double").alias("value"), F.col(ident).cast("bigint").alias("ident")
    ).dropna(subset=["key", "start", "end"]).withColumn("ident", F.coalesce("ident", F.lit(-1)))
    chunks = chunk_count(events)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, carried = chunk_number(), OpenRun(like)

        def told(found: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            found = found[(found["slot"] != CLOSED) | (found["n"] >= min_count)]
            columns = {c: pa.array(found[c].to_numpy(), from_pandas=True) for c in RUN_COLUMNS} | {"chunk": np.full(len(found), chunk, np.int32), "slot": found["slot"].to_numpy(np.int32)}
            yield from pa.table(columns).to_batches()

        for piece in pieces(batches):
            found, _, _ = encode_runs(like, *(column(piece, c) for c in ("key", "start", "end", "value", "ident")), chunk)
            yield from told(carried.take(found)[0])
        if carried.run:
            yield from told(carried.close().astype({"chunk_from": "int32", "chunk_to": "int32"}))

    encoded = stage(range_chunks(events, ["key", "start"], "ident", chunks).mapInArrow(local, RUN_FIELDS + ", chunk int, slot int"), "runs")
    inner = encoded.filter(F.col("slot") == CLOSED).drop("chunk", "slot")
    crossing = merge_boundaries(encoded.filter(F.col("slot") != CLOSED), like, chunks)
    return inner.unionByName(crossing).filter(F.col("n") >= min_count).select("key", "start", "end", "n", "first_value", "last_value")


def collapse_repeats(events: DataFrame, tolerance: float = 0.5, max_gap: int = 15, min_count: int = 1) -> DataFrame:
    """note_events with each run of (nearly) one pitch as one event.

    file_id, start_frame, end_frame (the largest of the run), source_midi (the
    first event's), n_events, frames (the duration). Two neighbouring events of
    a file belong together if their source_midi differ by less than
    ``tolerance`` and the later one starts at most ``max_gap`` frames after the
    earlier one's end. Repeated rows count once. An event without source_midi
    stands alone; one without file_id, start_frame or end_frame belongs to no
    sequence and comes out nowhere. An empty table gives an empty one; further
    columns are ignored.
    """
    found = runs(events, "file_id", "start_frame", "end_frame", "source_midi", "event_id", Likeness(tolerance, max_gap), min_count)
    return found.select(
        F.col("key").alias("file_id"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.col("first_value").alias("source_midi"), F.col("n").alias("n_events"), (F.col("end") - F.col("start")).alias("frames")
    )
