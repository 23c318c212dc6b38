"""Phrase detection over note events.

Whether an event begins a phrase depends on the gap before it and, after a
long note, on the number of events since the last beginning: an automaton with
the states 1, 2, .. least. Each range-sorted chunk runs it for every state in
which the file that enters the chunk may be; the chunks' ends of each file are
then folded in order, which tells the states that were entered. A task's rows
are read in pieces, each a chunk of its own. So a file of any length needs
neither a group in one task nor an array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.runs import chunk_count, chunk_number, pieces, range_chunks
from tunelore.staging import stage


@dataclass(frozen=True)
class PhraseRule:
    """A phrase ends before a gap of ``gap`` frames; with ``least`` events, also after a note of ``long`` medians if a gap or a leap of ``leap`` cents follows."""

    gap: int = 15
    long: float = 1.65
    leap: int = 700
    least: int = 3


def split_phrases(events: DataFrame, rule: PhraseRule = PhraseRule(), order: str = "seq") -> DataFrame:
    """``events`` with phrase_raw, the phrase's number in its file from 0, before short phrases are joined.

    Needs file_id, ``order`` (distinct in the file), start_frame, end_frame,
    frames and midi_cents, none null in the first two. Other columns stay.
    """
    chunks = chunk_count(events)
    medians = events.groupBy("file_id").agg(F.percentile("frames", F.lit(0.5)).alias("_median"))
    base = events.join(medians, "file_id")
    names = events.columns
    states = list(range(1, rule.least + 1))
    counts = [f"_count_{s}" for s in states]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    ends = "_first_start bigint, _first_cents bigint, _file bigint, _last_file bigint, _last_end bigint, _last_cents bigint, _last_frames bigint, _last_median double, _exits array<int>, _counts array<bigint>, _through boolean, _lead_count bigint"
    schema = f"{kept}, _chunk bigint, _lead boolean, " + ", ".join(f"{c} bigint" for c in counts) + f", {ends}"

    target = _arrow(schema)

    def walk(hard, soft, state: int) -> tuple[np.ndarray, int]:
        """Beginnings after the first event, which leaves ``state``; and the last state."""
        begins = np.zeros(len(hard), np.int64)
        for i in range(1, len(hard)):
            if hard[i] or (state >= rule.least and soft[i]):
                begins[i], state = 1, 1
            elif state < rule.least:
                state += 1
        return begins, state

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, table in enumerate(pieces(batches)):
            yield from scan(table, (chunk_number() << 24) + i)

    def scan(table: pa.Table, chunk: int) -> Iterator[pa.RecordBatch]:
        file, start, end, frames, cents, median = (table.column(c).to_numpy() for c in ("file_id", "start_frame", "end_frame", "frames", "midi_cents", "_median"))
        n = len(file)
        gap = np.zeros(n, np.int64)
        gap[1:] = np.maximum(0, start[1:] - end[:-1])
        soft = np.zeros(n, bool)
        soft[1:] = (frames[:-1] >= rule.long * np.maximum(1.0, median[:-1])) & ((gap[1:] > 0) | (np.abs(cents[1:] - cents[:-1]) >= rule.leap))
        hard = (gap >= rule.gap).tolist()
        soft = soft.tolist()
        first = np.flatnonzero(np.append(True, file[1:] != file[:-1])).tolist()
        out = {c: np.zeros(n, np.int64) for c in counts}
        exits, totals = [], []
        for k, (a, b) in enumerate(zip(first, [*first[1:], n])):
            for s, c in zip(states, counts) if k == 0 else [(1, None)]:
                begins, state = walk(hard[a:b], soft[a:b], s)
                number = np.cumsum(begins)
                if c:
                    out[c][a:b] = number
                    exits.append(state)
                    totals.append(int(number[-1]))
                else:
                    for c2 in counts:
                        out[c2][a:b] = number
                    last = (state, int(number[-1]))
        through = len(first) == 1
        lead = np.zeros(n, bool)
        lead[: first[1] if not through else n] = True
        rows = table.select(names).append_column("_chunk", pa.array(np.full(n, chunk, np.int64))).append_column("_lead", pa.array(lead))
        for c in counts:
            rows = rows.append_column(c, pa.array(out[c]))
        yield from _padded(rows, target).to_batches()
        note = pa.table(
            {
                "_chunk": pa.array([chunk], pa.int64()), "_first_start": [int(start[0])], "_first_cents": [int(cents[0])], "_file": [int(file[0])], "_last_file": [int(file[-1])], "_last_end": [int(end[-1])], "_last_cents": [int(cents[-1])],
                "_last_frames": [int(frames[-1])], "_last_median": [float(median[-1])], "_exits": pa.array([exits if through else [last[0]]], pa.list_(pa.int32())), "_counts": pa.array([totals if through else [last[1]]], pa.list_(pa.int64())), "_through": [through], "_lead_count": [0],
            }
        )
        yield from _padded(note, target).to_batches()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """The states and counts with which one file enters its chunks; ``_begins`` marks the chunk in which it begins after another file."""
        out, before = [], None
        for r in pdf.sort_values("_chunk").to_dict("records"):
            state, base = 1, 0
            if before:
                gap = max(0, r["_first_start"] - before["end"])
                soft = before["frames"] >= rule.long * max(1.0, before["median"]) and (gap > 0 or abs(r["_first_cents"] - before["cents"]) >= rule.leap)
                begins = gap >= rule.gap or (before["state"] >= rule.least and soft)
                state, base = (1, before["count"] + 1) if begins else (min(rule.least, before["state"] + 1), before["count"])
            through = r["_through"]
            if not r["_begins"]:
                out.append({"_chunk": r["_chunk"], "_state": state, "_base": base})
                if not through:
                    break
            at = state - 1 if through else 0
            before = {"end": r["_last_end"], "frames": r["_last_frames"], "cents": r["_last_cents"], "median": r["_last_median"], "state": int(r["_exits"][at]), "count": int(r["_counts"][at]) + (base if through else 0)}
        return pd.DataFrame(out, columns=["_chunk", "_state", "_base"])

    wide = base.withColumns({c: F.col(c).cast("bigint") for c in ("file_id", "start_frame", "end_frame", "frames", "midi_cents")})
    scanned = stage(range_chunks(wide, ["file_id"], order, chunks, copies=False).mapInArrow(local, schema), "scan")
    notes = scanned.filter(F.col("_file").isNotNull()).select("_chunk", *(x.split()[0] for x in ends.split(", ")))
    # of each chunk, the file that enters it and, if another one ends it, that one
    begun = notes.filter(~F.col("_through")).withColumn("_file", F.col("_last_file")).withColumn("_begins", F.lit(True))
    entered = notes.withColumn("_begins", F.lit(False)).unionByName(begun).groupBy("_file").applyInPandas(lambda pdf: fold(pdf), "_chunk bigint, _state int, _base bigint")
    number = F.when(F.col("_lead"), F.col("_base") + F.element_at(F.array(*counts), F.col("_state"))).otherwise(F.col(counts[0]))
    return scanned.filter(F.col("_file").isNull()).join(entered, "_chunk").select(*(F.col(f.name) for f in events.schema), number.alias("phrase_raw"))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _padded(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """``table`` with the columns of ``schema``, those it lacks null."""
    return pa.table([table.column(f.name).cast(f.type) if f.name in table.column_names else pa.chunked_array([pa.nulls(len(table), f.type)]) for f in schema], schema=pa.schema([pa.field(f.name, f.type) for f in schema]))


def join_short(split: DataFrame, rule: PhraseRule = PhraseRule()) -> DataFrame:
    """Rows with ``phrase``: a phrase of fewer than ``rule.least`` events belongs to the one before it; a file's first stays."""
    sizes = split.groupBy("file_id", "phrase_raw").agg(F.count("*").alias("_size"))
    seen = W.partitionBy("file_id").orderBy("phrase_raw").rowsBetween(W.unboundedPreceding, 0)
    own = sizes.withColumn("phrase", F.sum(F.when((F.col("phrase_raw") == 0) | (F.col("_size") >= rule.least), 1).otherwise(0)).over(seen) - 1)
    return split.join(own.select("file_id", "phrase_raw", "phrase"), ["file_id", "phrase_raw"])


def detect_phrases(events: DataFrame, rule: PhraseRule = PhraseRule()) -> DataFrame:
    """``events`` with the final ``phrase`` of each, numbered in the file from 0."""
    return join_short(split_phrases(events, rule), rule).drop("phrase_raw")
