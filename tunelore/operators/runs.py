"""Runs of consecutive like values, as associative summaries of range-sorted chunks.

Rows are range-partitioned by (sequence, position), so that a sequence that
holds a third of all rows spreads over many tasks. Each chunk reads its rows
in pieces of bounded size, carries the run that a piece leaves open into the
next, and summarises its ends by a first and a last run; ``join_runs`` is
associative, so a tree of merges over those summaries (two per chunk) finds
the runs that cross chunk boundaries. A random last sort key lets even the
copies of one row spread; a copy beside its original counts once, in a chunk
as well as across a boundary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.staging import stage

#: Slots of a run in its chunk: complete, the chunk's first, its last, or all of it.
CLOSED, FIRST, LAST, WHOLE = -1, 0, 1, 2
FAN = 512
#: Bytes of input to a chunk, rows of it that a task holds at once, and the size from which an estimate says nothing.
CHUNK_BYTES, PIECE_ROWS, UNKNOWN_BYTES = 128 << 20, 1 << 17, 1 << 50

RUN_FIELDS = "key bigint, start bigint, end bigint, n bigint, first_value double, last_value double, last_start bigint, last_end bigint, first_id bigint, last_id bigint, chunk_from int, chunk_to int"
RUN_COLUMNS = [x.split()[0] for x in RUN_FIELDS.split(", ")]


@dataclass(frozen=True)
class Likeness:
    """When two neighbouring events of a sequence belong to one run.

    tolerance: their values differ by less than this (0: they are equal).
    max_gap: the later starts at most so far after the earlier one's end (None: any distance).
    A missing value is like nothing.
    """

    tolerance: float = 0.0
    max_gap: int | None = None

    def near(self, a, b):
        return (a == b) if self.tolerance == 0 else (np.abs(a - b) < self.tolerance)

    def linked(self, key_a, value_a, end_a, key_b, value_b, start_b):
        with np.errstate(invalid="ignore"):
            out = (key_a == key_b) & self.near(value_a, value_b)
            return out if self.max_gap is None else out & (start_b - end_a <= self.max_gap)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's size, or that of its inputs if less (as of a join); of one it knows nothing about, counted rows times their width."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    guess = min(int(str(plan.stats().sizeInBytes())), sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())))
    return guess if guess < UNKNOWN_BYTES else df.count() * (16 + 16 * len(df.columns))


def chunk_count(df: DataFrame, least: int | None = None) -> int:
    """How many chunks ``df`` is cut into: the session's shuffle partitions, or as many more as CHUNK_BYTES a chunk needs."""
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-estimated_bytes(df) // CHUNK_BYTES))


def range_chunks(df: DataFrame, by: list[str], ident: str, partitions: int | None = None, copies: bool = True) -> DataFrame:
    """``df`` in range partitions, each sorted by ``by`` and ``ident``; with ``copies``, those of a row may spread over neighbours.

    Spreading draws a seeded random number per row, so the rows must come in
    the same order if a task is run again, as they do from files. Rows that
    are distinct need none.
    """
    n = partitions or chunk_count(df)
    if not copies:
        return df.repartitionByRange(n, *by, ident).sortWithinPartitions(*by, ident)
    salted = df.withColumn("_salt", F.rand(7))
    return salted.repartitionByRange(n, *by, ident, "_salt").sortWithinPartitions(*by, ident).drop("_salt")


def pieces(batches: Iterable[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.Table]:
    """A task's rows in order, as tables of PIECE_ROWS rows or little more; no empty ones."""
    rows = rows or PIECE_ROWS
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def chunk_number() -> int:
    """This task's partition number."""
    return TaskContext.get().partitionId()


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column as NumPy numbers; missing floats are NaN."""
    x = table.column(name).combine_chunks()
    if pa.types.is_floating(x.type):
        return x.to_numpy(zero_copy_only=False).astype(float)
    return x.to_numpy(zero_copy_only=False)


def encode_runs(like: Likeness, key, start, end, value, ident, chunk: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Runs of sorted events without copies, with their slots; also each event's run number, and the kept events.

    The arrays are sorted by (key, start, ident); an event that repeats its predecessor is dropped.
    """
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1]) | (ident[1:] != ident[:-1])
    key, start, end, value, ident = (x[keep] for x in (key, start, end, value, ident))
    fresh = np.ones(len(key), bool)
    fresh[1:] = ~like.linked(key[:-1], value[:-1], end[:-1], key[1:], value[1:], start[1:])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(key)) - 1
    slot = np.full(len(at), CLOSED)
    if len(at):
        slot[0], slot[-1] = FIRST, LAST
        if len(at) == 1:
            slot[0] = WHOLE
    runs = pd.DataFrame(
        {
            "key": key[at], "start": start[at], "end": np.maximum.reduceat(end, at) if len(at) else end, "n": last - at + 1,
            "first_value": value[at], "last_value": value[last], "last_start": start[last], "last_end": end[last], "first_id": ident[at], "last_id": ident[last],
            "chunk_from": np.full(len(at), chunk, np.int32), "chunk_to": np.full(len(at), chunk, np.int32), "slot": slot.astype(np.int32),
        }
    )
    return runs, np.cumsum(fresh) - 1, keep


def join_runs(like: Likeness, a: dict, b: dict) -> dict | None:
    """The run that two neighbouring runs form across a chunk boundary, or None."""
    copies = (a["key"], a["last_start"], a["last_id"]) == (b["key"], b["start"], b["first_id"])
    if not copies and not like.linked(a["key"], a["last_value"], a["last_end"], b["key"], b["first_value"], b["start"]):
        return None
    return a | {"end": max(a["end"], b["end"]), "n": a["n"] + b["n"] - copies, "chunk_to": b["chunk_to"]} | {k: b[k] for k in ("last_value", "last_start", "last_end", "last_id")}


class OpenRun:
    """The run that a chunk's pieces leave open, carried from each to the next; tells which run is the chunk's first."""

    def __init__(self, like: Likeness):
        self.like, self.run, self.first = like, None, True

    def take(self, found: pd.DataFrame) -> tuple[pd.DataFrame, bool]:
        """The runs that are complete after a piece whose runs are ``found``, and whether the open run went on in it.

        The last one stays open. Of those returned, only the chunk's first has the slot FIRST.
        """
        joined = join_runs(self.like, self.run, found.iloc[:1].to_dict("records")[0]) if self.run else None
        if joined:
            for c, v in joined.items():
                found.loc[0, c] = v
        elif self.run:
            found = pd.concat([pd.DataFrame([self.run], columns=found.columns).astype(found.dtypes), found], ignore_index=True)
        done, self.run = found.iloc[:-1].copy(), found.iloc[-1:].to_dict("records")[0]
        done["slot"] = np.int32(CLOSED)
        if self.first and len(done):
            done.loc[0, "slot"] = FIRST
            self.first = False
        return done, joined is not None

    def close(self) -> pd.DataFrame:
        """The run left open at the chunk's end, with its slot; no row if the chunk was empty."""
        return pd.DataFrame([self.run | {"slot": WHOLE if self.first else LAST}] if self.run else [])


def merge_ends(like: Likeness, ends: list[dict]) -> list[dict]:
    """Runs of several neighbouring chunks from their first and last ones, in order; slots are those of the whole stretch."""
    out: list[dict] = []
    for run in ends:
        joined = join_runs(like, out[-1], run) if out and run["slot"] != LAST else None
        if joined:
            out[-1] = joined
        else:
            out.append(dict(run))
    for run in out:
        run["slot"] = CLOSED
    if out:
        out[0]["slot"], out[-1]["slot"] = (WHOLE, WHOLE) if len(out) == 1 else (FIRST, LAST)
    return out


def merge_boundaries(ends: DataFrame, like: Likeness, chunks: int, by: list[str] | None = None) -> DataFrame:
    """Runs that touch chunk boundaries, from the chunks' first and last runs.

    ends: RUN_FIELDS with chunk and slot. A tree with FAN children a node: a task holds two rows per child.
    by: further columns of which each value has chunks of its own.
    """
    by = by or []
    schema = ", ".join([f"{c} {ends.schema[c].dataType.simpleString()}" for c in by] + [RUN_FIELDS, "chunk int, slot int"])

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "slot"], kind="stable")
        out = pd.DataFrame(merge_ends(like, pdf.to_dict("records")), columns=[*pdf.columns])
        out["chunk"] = pdf["chunk"].iloc[0] // FAN
        return out

    done: list[DataFrame] = []
    while True:
        level = ends.groupBy(*by, F.floor(F.col("chunk") / FAN).alias("_node")).applyInPandas(lambda pdf: node(pdf.drop(columns="_node", errors="ignore")), schema)
        chunks = -(-chunks // FAN)
        if chunks <= 1:
            done.append(level)
            break
        level = stage(level, "ends")
        done.append(level.filter(F.col("slot") == CLOSED))
        ends = level.filter(F.col("slot") != CLOSED)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("chunk", "slot")
