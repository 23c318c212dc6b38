"""Filling containers of fixed capacity with documents, sized by their tokens.

Hierarchical residual packing. Each partition packs its items best-fit, largest
first, and emits the bins that are nearly full. What lies in the others goes up
as items. However many these are, they differ in their sizes only, so a node of
the tree needs no more than the number of items of each size, which partial
aggregation adds up on the way: at most ``capacity`` numbers at the root. The
root packs the sizes best-fit, many equal items at a time, and says for each
size which ranks of its items go to which containers; every item finds its
container by its rank among the items of its size. No item is left out, however
many partitions there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.llm.tokens import BYTE_BPE, token_counts
from tunelore.operators.runs import chunk_number, pieces
from tunelore.staging import stage

#: Items of a partition, about. A partition of many more is packed in tables of four times as many; up to so many of them, and bits of a bin's number in its table.
PART_ITEMS, _TABLES, _BIN = 500_000, 1024, 32


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Each item's bin, and the bins' fills; items in the order given, each into the fullest bin that takes it.

    Open bins lie in one stack per residual; a bit set of the residuals in use
    finds the smallest sufficient one.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    where, fills = [], []
    for size in sizes:
        fit = used >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                used &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        where.append(b)
        fills[b] += size
        room -= size
        stacks[room].append(b)
        used |= 1 << room
    return where, fills


@dataclass
class Plan:
    """Which containers the items of each size go to: from rank ``rank`` on, ``per`` items each go to the containers from ``first`` on.

    The arrays are sorted by size and rank.
    """

    size: np.ndarray
    rank: np.ndarray
    per: np.ndarray
    first: np.ndarray

    def containers(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The containers of items by their size and their rank among the items of that size."""
        row = np.empty(len(size), np.int64)
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            low, high = np.searchsorted(self.size, s, "left"), np.searchsorted(self.size, s, "right")
            row[own] = low + np.searchsorted(self.rank[low:high], rank[own], "right") - 1
        return self.first[row] + (rank - self.rank[row]) // self.per[row]


def plan_sizes(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit, largest first, of ``counts[size]`` items of each size, equal ones together."""
    rows: list[tuple[int, int, int, int]] = []
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # residual -> stretches [first container, how many]
    used = after = 0

    def put(room: int, first: int, many: int) -> int:
        rooms[room].append([first, many])
        return 1 << room

    for size in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        while left:
            fit = used >> size
            if fit:
                room = size + (fit & -fit).bit_length() - 1
                first, many = rooms[room].pop()
                if not rooms[room]:
                    used &= ~(1 << room)
            else:
                room, first, many = capacity, after, None
            per = room // size if size else left
            take = min(left // per, many) if many else left // per
            if not take:
                per, take = left, 1
            rows.append((size, rank, per, first))
            used |= put(room - per * size, first, take)
            if many is None:
                after += take
            elif many > take:
                used |= put(room, first + take, many - take)
            rank, left = rank + per * take, left - per * take
    rows.sort()
    return Plan(*(np.array(x, np.int64) for x in zip(*rows))) if rows else Plan(*(np.zeros(0, np.int64),) * 4)


def pack(items: DataFrame, key: str, size: str, capacity: int, slack: float = 0.01) -> DataFrame:
    """Containers of items (``key``, ``size``): key, piece, n_pieces, offset, size, container.

    An item larger than ``capacity`` is cut into full pieces, each a container
    of its own, and a rest; no other item is cut. offset is where a piece
    begins in its item. Items of size 0, null or below are whole items of size
    0 in some container. Keys are expected to be distinct. Bins with at most
    ``slack`` of the capacity unused count as full.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece bigint, n_pieces bigint, offset bigint, size bigint, bin bigint, part bigint, rank bigint"
    full = int(capacity * (1 - slack))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, table in enumerate(pieces(batches, 4 * PART_ITEMS)):
            part = chunk_number() * _TABLES + i
            keys, total = table.column(0).combine_chunks(), table.column(1).to_numpy()
            n = np.maximum(1, -(-total // capacity))
            item = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(capacity, total[item] - piece * capacity)
            order = np.argsort(-size, kind="stable")
            where, fills = best_fit(size[order].tolist(), capacity)
            bins = np.empty(len(item), np.int64)
            bins[order] = where
            up = np.array(fills)[bins] < full
            rank = np.zeros(len(item), np.int64)
            own = order[up[order]][::-1]  # by size
            rank[own] = np.arange(len(own)) - np.searchsorted(size[own], size[own])
            yield from pa.table(
                {
                    key: keys.take(pa.array(item)), "piece": piece, "n_pieces": n[item], "offset": piece * capacity, "size": size,
                    "bin": pa.array((part << _BIN) + bins, mask=up), "part": pa.array(np.full(len(item), part), mask=~up), "rank": pa.array(rank, mask=~up),
                }
            ).to_batches(max_chunksize=50_000)

    sized = items.select(F.col(key), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("total"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // PART_ITEMS))
    packed = stage(sized.repartition(parts, key).sortWithinPartitions(F.desc("total"), key).mapInArrow(local, schema), "packed")
    above = packed.filter(F.col("part").isNotNull())
    counted = stage(above.groupBy("part", "size").agg(F.count("*").alias("n")), "sizes")
    before = counted.select("part", "size", (F.sum("n").over(W.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    # a row for each size, none above the capacity
    plan = plan_sizes({r["size"]: r["n"] for r in counted.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    held = spark.sparkContext.broadcast(plan)
    columns = [key, "piece", "n_pieces", "offset", "size"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            into = held.value.containers(b.column("size").to_numpy(), b.column("rank").to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array((parts * _TABLES << _BIN) + into)], [*columns, "container"])

    moved = above.join(before, ["part", "size"]).select(*columns, (F.col("rank") + F.col("before")).alias("rank"))
    moved = moved.mapInArrow(settle, schema.split(", bin")[0] + ", container bigint")
    return packed.filter(F.col("part").isNull()).select(*columns, F.col("bin").alias("container")).unionByName(moved)


def pack_documents(documents: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """Documents in containers of ``capacity`` tokens: doc_id, piece, n_pieces, first_token, n_tokens, container_id.

    Rows of one doc_id are one document; null and empty texts have no tokens
    and lie in some container.
    """
    sizes = stage(token_counts(documents, key, text, tokenizer), "sizes")
    packed = pack(sizes, key, "n_tokens", capacity)
    return packed.select(key, "piece", "n_pieces", F.col("offset").alias("first_token"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Of each container: container_id, pieces, used, unused."""
    used = F.sum("n_tokens")
    return packed.groupBy("container_id").agg(F.count("*").alias("pieces"), used.alias("used"), (F.lit(capacity) - used).alias("unused"))
