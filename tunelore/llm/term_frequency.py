"""How often each term of counter maps occurs, and in how many records.

Vertical layout: for each term, containers of the records that hold it. A
container covers 65,536 record ids: the low 16 bits of the ids, as a sorted
array or (from 4,096 ids) as a bitset, beside the ids' occurrence counters, in
as few bytes as the largest of them needs.
Records arrive in id ranges, so that partial containers of a term are few and
seldom overlap; they are merged by union, in which the copies of a record fall
together, and a term's record frequency is the cardinality of its containers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.operators.runs import pieces, range_chunks
from tunelore.staging import stage

ARRAY_IDS = 4096
PART = "grp bigint, kind string, term string, high bigint, ids binary, counts binary, held bigint, total bigint"
#: A kind that holds every record of a group once.
RECORDS = ""
#: Records that a task holds at once; stands for the null group.
PIECE_RECORDS, NO_GROUP = 1 << 14, -1 << 62


def pack_ids(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit ids as bytes: an array, or a bitset of 8,192 bytes."""
    if len(low) < ARRAY_IDS:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, bool)
    bits[low] = True
    return np.packbits(bits).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) if len(data) == 2 * ARRAY_IDS else np.frombuffer(data, "<u2").astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Positive counters in 1, 2, 4 or 8 bytes each."""
    top = int(counts.max())
    return counts.astype(f"<u{next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)}").tobytes()


def union(parts: list[tuple[bytes, bytes]]) -> tuple[int, int]:
    """Cardinality and total of the union of containers; a record in several of them counts once."""
    lists = [unpack_ids(i) for i, _ in parts]
    ids = np.concatenate(lists)
    counts = np.concatenate([np.frombuffer(c, f"<u{len(c) // len(i) if len(i) else 1}").astype(np.int64) for i, (_, c) in zip(lists, parts)])
    _, at = np.unique(ids, return_index=True)
    return len(at), int(counts[at].sum())


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    whole = memoryview(np.ascontiguousarray(data)).cast("B")
    width = data.dtype.itemsize
    return [whole[a * width : b * width] for a, b in zip(starts.tolist(), ends.tolist())]


def _counters(counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes | memoryview]:
    """The counters of each stretch, packed."""
    out = _binary(counts.astype(np.uint8), starts, ends)
    for n in np.flatnonzero(np.maximum.reduceat(counts, starts) > 255):
        out[n] = pack_counts(counts[starts[n] : ends[n]])
    return out


def term_containers(df: DataFrame, record: str, group: str, maps: dict[str, str], normalise: dict[str, Callable[[str], str | None]]) -> DataFrame:
    """Partial containers (PART) of every term, and of every record under kind RECORDS. maps: kind -> map column."""
    base = df.select(F.col(record).cast("bigint").alias("record"), F.col(group).cast("bigint").alias("grp"), *(F.col(c).alias(f"map_{i}") for i, c in enumerate(maps.values()))).dropna(subset=["record"])
    kinds = list(maps)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for table in pieces(batches, PIECE_RECORDS):
            record, grp = table.column("record").to_numpy(), table.column("grp").combine_chunks().fill_null(NO_GROUP).to_numpy()
            first = np.append((grp[0], record[0]) != last, (record[1:] != record[:-1]) | (grp[1:] != grp[:-1]))
            last = grp[-1], record[-1]
            if first.any():
                yield from containers(table.filter(pa.array(first)), record[first], grp[first])

    def containers(table: pa.Table, record: np.ndarray, grp: np.ndarray) -> Iterator[pa.RecordBatch]:
        groups, grp = np.unique(grp, return_inverse=True)
        label = [None if g == NO_GROUP else int(g) for g in groups.tolist()]
        for i, kind in enumerate([*kinds, RECORDS]):
            if kind == RECORDS:
                terms, at, code, count = [""], np.arange(len(record)), np.zeros(len(record), np.int64), np.ones(len(record), np.int64)
            else:
                col = table.column(f"map_{i}").combine_chunks()
                size = pa.compute.fill_null(pa.compute.list_value_length(col.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.int64())])))), 0).to_numpy()
                entries = pa.compute.list_flatten(col.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.int64())]))))
                spelled = entries.field("key").dictionary_encode()
                forms = [normalise[kind](x) if x is not None else None for x in spelled.dictionary.to_pylist()]
                terms = sorted({x for x in forms if x is not None})
                place = {x: n for n, x in enumerate(terms)}
                code = np.array([place.get(x, -1) for x in forms] or [-1], np.int64)[spelled.indices.fill_null(0).to_numpy()] if len(entries) else np.zeros(0, np.int64)
                count = entries.field("value").fill_null(0).to_numpy()
                at = np.repeat(np.arange(len(record)), size)
                known = code >= 0
                at, code, count = at[known], code[known], count[known]
                # one term under several spellings in one map is added up
                key, where = np.unique(code * len(record) + at, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, where, count)
                keep = total > 0
                at, code, count = (key % len(record))[keep], (key // len(record))[keep], total[keep]
            if not len(at):
                continue
            high = record[at] >> 16
            order = np.lexsort((record[at], code, grp[at]))
            at, code, count, high = at[order], code[order], count[order], high[order]
            fresh = np.append(True, (grp[at][1:] != grp[at][:-1]) | (code[1:] != code[:-1]) | (high[1:] != high[:-1]))
            start = np.flatnonzero(fresh)
            end = np.append(start[1:], len(at))
            low = (record[at] & 65535).astype("<u2")
            ids = _binary(low, start, end)
            for n in np.flatnonzero(end - start >= ARRAY_IDS):
                ids[n] = pack_ids(low[start[n] : end[n]])
            out = pa.table(
                {
                    "grp": pa.array([label[g] for g in grp[at[start]].tolist()], pa.int64()), "kind": pa.array([kind] * len(start)), "term": pa.array([terms[c] for c in code[start].tolist()]),
                    "high": high[start], "ids": pa.array(ids, pa.binary()), "counts": pa.array(_counters(count, start, end), pa.binary()), "held": end - start, "total": np.add.reduceat(count, start),
                }
            )
            yield from out.to_batches(max_chunksize=10_000)

    return range_chunks(base, ["grp", "record"], "record").mapInArrow(local, PART)


def term_frequencies(df: DataFrame, record: str, group: str, maps: dict[str, str], normalise: dict[str, Callable[[str], str | None]], rare: int = 2, common: float = 0.6) -> DataFrame:
    """Every term's total count and number of records in its group, and its mark.

    Columns grp, kind, term, total_count, n_records, group_records, mark. mark
    is ``rare`` for a term of at most ``rare`` records, else ``common`` for one
    of more than the share ``common`` of the group's records, else null (a term
    that is both is rare). Rows with the same group and record id are one
    record; an id that occurs in two groups is a record of each. Null
    maps, null or non-positive totals and keys in which ``normalise`` finds no
    term (None) add nothing; rows without record id are left out; null groups
    form a group.
    """
    parts = term_containers(df, record, group, maps, normalise)
    held = parts.groupBy("grp", "kind", "term", "high").agg(F.collect_list(F.struct("ids", "counts", "held", "total")).alias("parts"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("parts")
            ends = lists.offsets.to_numpy()
            flat = lists.values
            first = ends[:-1]
            held, total = flat.field("held").to_numpy()[first], flat.field("total").to_numpy()[first]
            several = np.flatnonzero(np.diff(ends) > 1)
            if len(several):
                held, total = held.copy(), total.copy()
                ids, counts = flat.field("ids"), flat.field("counts")
            for i in several.tolist():
                held[i], total[i] = union([(ids[n].as_py(), counts[n].as_py()) for n in range(ends[i], ends[i + 1])])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "kind", "term")), pa.array(held), pa.array(total)], ["grp", "kind", "term", "n_records", "total_count"])

    sized = held.mapInArrow(measure, "grp bigint, kind string, term string, n_records bigint, total_count bigint")
    sized = stage(sized.groupBy("grp", "kind", "term").agg(F.sum("n_records").alias("n_records"), F.sum("total_count").alias("total_count")), "terms")
    terms = sized.filter(F.col("kind") != RECORDS).alias("t")
    records = sized.filter(F.col("kind") == RECORDS).alias("g")
    mark = F.when(F.col("t.n_records") <= rare, "rare").when(F.col("t.n_records") > common * F.col("g.n_records"), "common")
    return terms.join(records, F.col("t.grp").eqNullSafe(F.col("g.grp"))).select("t.grp", "t.kind", "t.term", "t.total_count", "t.n_records", F.col("g.n_records").alias("group_records"), mark.alias("mark"))


def nearest(number: str) -> int:
    """The whole number nearest to one in digits; halves go away from zero."""
    x = float(number)
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def degree(key: str) -> str | None:
    """The number in a key, modulo 12."""
    m = re.search(r"[+-]?\d+(?:\.\d+)?", key)
    return str(nearest(m[0]) % 12) if m else None


def interval(key: str) -> str | None:
    """The size of the number in a key; what is larger than 12 is 12, and 0 is none."""
    m = re.search(r"\d+(?:\.\d+)?", key)
    n = min(12, nearest(m[0])) if m else 0
    return str(n) if n else None


def trigram(key: str) -> str | None:
    """Three degrees, modulo 12, whatever stands around them."""
    numbers = re.findall(r"\d+", key)
    return ">".join(str(int(x) % 12) for x in numbers) if len(numbers) == 3 else None


#: Kinds of melody terms and the forms of their keys.
MELODY_TERMS = {"degree": degree, "interval": interval, "trigram": trigram}


def melody_terms(cluster_stats: DataFrame) -> DataFrame:
    """Of each corpus, every degree, interval and trigram: corpus_id, kind, term, total_count, file_count, corpus_files, mark."""
    found = term_frequencies(cluster_stats, "file_id", "corpus_id", {k: f"{k}_count" for k in MELODY_TERMS}, MELODY_TERMS)
    return found.select(F.col("grp").alias("corpus_id"), "kind", "term", "total_count", F.col("n_records").alias("file_count"), F.col("group_records").alias("corpus_files"), "mark")
