"""Neighbours and running values in ordered groups of any size.

What a window by group gives, without a task for each group: rows are
range-partitioned by (group, order), every chunk works by itself on pieces of
its rows, and the first and last rows of the groups that touch a chunk's ends
tell what to add across boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.runs import chunk_number, pieces, range_chunks
from tunelore.staging import stage


@dataclass(frozen=True)
class Running:
    """Columns to add, by name: the row's number from 1; the value of a column in the row before and after it; a column's sum up to the row, and its largest value before it (both of numbers)."""

    number: str = "_number"
    lags: dict[str, str] = field(default_factory=dict)
    leads: dict[str, str] = field(default_factory=dict)
    sums: dict[str, str] = field(default_factory=dict)
    maxes: dict[str, str] = field(default_factory=dict)

    @property
    def sources(self) -> list[str]:
        return sorted({*self.lags.values(), *self.leads.values(), *self.sums.values(), *self.maxes.values()})


class _Walk:
    """The state of a chunk between its pieces."""

    def __init__(self, by: list[str], what: Running):
        self.by, self.what, self.key, self.n, self.sums, self.maxes, self.row = by, what, None, 0, {}, {}, None

    def take(self, table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """``table`` with the columns but the leads, and where its groups begin; the first one may go on from before."""
        n = table.num_rows
        codes = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in self.by]
        start = np.append(True, reduce(np.logical_or, ((x[1:] != x[:-1]) for x in (c.indices.to_numpy(zero_copy_only=False) for c in codes)), np.zeros(n - 1, bool)))
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, n))
        key = lambda i: tuple(c.dictionary[c.indices[i].as_py()].as_py() for c in codes)
        on = self.key is not None and self.key == key(0)
        first = slice(0, length[0])
        number = np.arange(n) - np.repeat(at, length) + 1
        number[first] += self.n if on else 0
        out = table.append_column(self.what.number, pa.array(number))
        last = {c: table.column(c)[n - 1] for c in self.what.sources}
        fresh = start.copy()
        fresh[0] = not on
        for name, c in self.what.lags.items():
            held = self.row[c] if self.row else None
            whole = pa.concat_arrays([pa.array([held.as_py() if held is not None else None], table.column(c).type), table.column(c).combine_chunks()])
            out = out.append_column(name, whole.take(pa.array(np.arange(n), mask=fresh)))
        for name, c in self.what.sums.items():
            x = table.column(c).combine_chunks().fill_null(0).to_numpy()
            total = np.cumsum(x)
            total = total - np.repeat(total[at] - x[at], length)
            total[first] += self.sums[name] if on else 0
            self.sums[name] = total[-1]
            out = out.append_column(name, pa.array(total))
        for name, c in self.what.maxes.items():
            x = pd.Series(table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(float))
            group = np.repeat(np.arange(len(at)), length)
            upto = x.fillna(-np.inf).groupby(group).cummax().to_numpy().copy()
            before = np.append(-np.inf, upto[:-1])
            before[at] = -np.inf
            if on:
                before[first] = np.maximum(before[first], self.maxes[name])
                upto[first] = np.maximum(upto[first], self.maxes[name])
            self.maxes[name] = upto[-1]
            out = out.append_column(name, pa.array(before, mask=np.isneginf(before)))
        self.key, self.n, self.row = key(n - 1), int(number[-1]), last
        return out, fresh


def ordered(df: DataFrame, by: list[str], order: list[str], what: Running) -> DataFrame:
    """``df``, staged, with the columns of ``what``; groups ``by`` (nulls are a value), rows in ``order``, distinct in a group.

    The largest value before a row is a double; it and the neighbours are null
    where there are none. Sums take nulls as 0.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    added = {what.number: "bigint"} | {n: kind[c] for n, c in what.lags.items()} | {n: "double" if kind[c] in ("double", "float") else "bigint" for n, c in what.sums.items()} | {n: "double" for n in what.maxes} | {n: kind[c] for n, c in what.leads.items()}
    names = [*df.columns, *added, "_chunk"]
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in df.columns), *(f"`{n}` {t}" for n, t in added.items()), "_chunk int"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, walk, held = chunk_number(), _Walk(by, what), None

        def with_leads(rows: pa.Table, after: pa.Table | None, apart: np.ndarray) -> Iterator[pa.RecordBatch]:
            for name, c in what.leads.items():
                rows = rows.append_column(name, pa.nulls(len(rows), rows.schema.field(c).type) if after is None else after.column(c).combine_chunks().take(pa.array(np.arange(len(rows)), mask=apart)))
            yield from rows.append_column("_chunk", pa.array(np.full(len(rows), chunk, np.int32))).select(names).to_batches()

        for table in pieces(batches):
            rows, fresh = walk.take(table)
            if held is not None:
                rows, fresh = pa.concat_tables([held, rows]), np.append(True, fresh)
            # the last row waits for the one after it
            yield from with_leads(rows.slice(0, len(rows) - 1), rows.slice(1), fresh[1:])
            held = rows.slice(len(rows) - 1)
        if held is not None:
            yield from with_leads(held, None, np.ones(1, bool))

    told = stage(range_chunks(df, [*by, *order[:-1]], order[-1], copies=False).mapInArrow(local, schema), "ordered")
    n = what.number
    last = F.struct(*(F.col(c).alias(f"l_{i}") for i, c in enumerate(what.lags.values())), *(F.col(c).alias(f"s_{i}") for i, c in enumerate(what.sums)), *(F.greatest(F.col(m), F.col(c).cast("double")).alias(f"m_{i}") for i, (m, c) in enumerate(what.maxes.items())), F.lit(1).alias("one"))
    first = F.struct(*(F.col(c).alias(f"f_{i}") for i, c in enumerate(what.leads.values())), F.lit(1).alias("one"))
    parts = told.groupBy(*by, "_chunk").agg(F.max(n).alias("_n"), F.max_by(last, n).alias("_last"), F.min_by(first, n).alias("_first"))
    w = W.partitionBy(*by).orderBy("_chunk")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    joints = parts.select(
        *(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col("_chunk").alias("_at"), F.col("_n").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.lag("_last").over(w).alias("_prev"), F.lead("_first").over(w).alias("_next"),
        *(F.coalesce(F.sum(f"_last.s_{i}").over(before), F.lit(0)).alias(f"_sum_{i}") for i in range(len(what.sums))), *(F.max(f"_last.m_{i}").over(before).alias(f"_max_{i}") for i in range(len(what.maxes))),
    ).filter(F.col("_prev").isNotNull() | F.col("_next").isNotNull())
    joints = stage(joints, "joints")
    same = reduce(lambda x, y: x & y, (F.col(f"t.{c}").eqNullSafe(F.col(f"j._by_{i}")) for i, c in enumerate(by)), F.col("t._chunk") == F.col("j._at"))
    t = lambda c: F.col(f"t.`{c}`")
    return told.alias("t").join(joints.alias("j"), same, "left").select(
        *(t(c) for c in df.columns), (t(n) + F.coalesce("j._before", F.lit(0))).alias(n), *(F.when((t(n) == 1) & F.col("j._prev").isNotNull(), F.col(f"j._prev.l_{i}")).otherwise(t(c)).alias(c) for i, c in enumerate(what.lags)),
        *(F.when((t(n) == F.col("j._own")) & F.col("j._next").isNotNull(), F.col(f"j._next.f_{i}")).otherwise(t(c)).alias(c) for i, c in enumerate(what.leads)), *((t(c) + F.coalesce(f"j._sum_{i}", F.lit(0))).alias(c) for i, c in enumerate(what.sums)),
        *(F.greatest(t(c), F.col(f"j._max_{i}")).alias(c) for i, c in enumerate(what.maxes)),
    )
