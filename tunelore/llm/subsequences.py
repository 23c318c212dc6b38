"""Ordered patterns that many sequences share, gaps between their steps allowed.

Events are range-sorted and each chunk writes its files' phrases as byte
strings; where a file goes on in the next chunk, a junction piece holds the
last and first steps of both sides. A corpus's files fall into buckets of
bounded size. Each bucket grows frequent prefixes over projected suffix
pointers (the end positions of a prefix's occurrences), a file counting once.
A pattern frequent in a corpus is frequent in one of its buckets at least, so
the buckets' patterns are all candidates; corpora of several buckets count
their candidates again in every bucket. A file too long for a bucket is reduced
to its distinct patterns, piece by piece, and is counted beside the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.operators.runs import chunk_number, column, pieces, range_chunks
from tunelore.staging import stage

#: The alphabet is pitch classes; a byte also says whether a phrase begins there.
ALPHABET, BEGINS = 12, 16


@dataclass(frozen=True)
class Pattern:
    """steps of a pattern, how many others may lie between two of them, the share of a corpus's files it needs."""

    steps: int = 5
    max_skip: int = 1
    share: float = 0.3

    @property
    def halo(self) -> int:
        return (self.steps - 1) * (self.max_skip + 1)


def needed(share: float, files: int) -> int:
    """The least number of files that is at least ``share`` of them, and at least one."""
    return max(1, int(np.ceil(share * files - 1e-9)))


def phrases(events: DataFrame, max_gap: int, halo: int) -> DataFrame:
    """Pieces (file_id, seq, lead, split) of the files' phrases as pitch classes, neighbouring equal ones once.

    In a junction piece, only what begins among the first ``lead`` steps and
    ends at ``split`` or later is in neither chunk's own piece. Elsewhere both
    are -1.
    """
    base = events.select(F.col("file_id").cast("bigint"), F.col("start_frame").cast("bigint"), F.col("end_frame").cast("bigint"), F.col("source_midi").cast("double"), F.coalesce(F.col("event_id").cast("bigint"), F.lit(-1)).alias("event_id")).dropna(subset=["file_id", "start_frame", "end_frame"])
    schema = "file_id bigint, seq binary, edge boolean, chunk bigint, head binary, tail binary, first_start bigint, last_end bigint, first_missing boolean, last_missing boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each piece of a task's rows is a chunk of its own, numbered in order
        last = None
        for i, table in enumerate(pieces(batches)):
            columns = [column(table, c) for c in ("file_id", "start_frame", "event_id", "end_frame", "source_midi")]
            place = np.stack(columns[:3], 1)
            keep = np.append(last is None or (place[0] != last).any(), (place[1:] != place[:-1]).any(1))
            last = place[-1]
            if keep.any():
                yield from encode(*(c[keep] for c in columns), (chunk_number() << 24) + i)

    def encode(file: np.ndarray, start: np.ndarray, _: np.ndarray, end: np.ndarray, midi: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
        other = np.append(True, file[1:] != file[:-1])
        missing = ~np.isfinite(midi)
        fresh = other | missing
        fresh[1:] |= missing[:-1] | (start[1:] - end[:-1] > max_gap)
        pc = np.where(missing, 0, np.rint(np.where(missing, 0, midi)) % ALPHABET).astype(np.uint8)
        begin = np.flatnonzero(other)
        stop = np.append(begin[1:], len(file))
        sound = np.flatnonzero(~missing)
        f, p, b = file[sound], pc[sound], fresh[sound]
        once = np.append(True, b[1:] | (p[1:] != p[:-1]))[: len(sound)]
        data = np.where(b[once], p[once] | BEGINS, p[once]).astype(np.uint8).tobytes()
        at = np.searchsorted(f[once], file[begin], "left").tolist()
        to = np.searchsorted(f[once], file[begin], "right").tolist()
        seq = [data[x:y] for x, y in zip(at, to)]
        edge = np.zeros(len(begin), bool)
        edge[0] = edge[-1] = True
        yield from pa.table(
            {
                "file_id": file[begin], "seq": pa.array(seq, pa.binary()), "edge": edge, "chunk": np.full(len(begin), chunk, np.int64),
                "head": pa.array([s[:halo] if e else b"" for s, e in zip(seq, edge)], pa.binary()), "tail": pa.array([s[-halo:] if e else b"" for s, e in zip(seq, edge)], pa.binary()),
                "first_start": start[begin], "last_end": end[stop - 1], "first_missing": missing[begin], "last_missing": missing[stop - 1],
            }
        ).to_batches(max_chunksize=10_000)

    encoded = stage(range_chunks(base, ["file_id", "start_frame"], "event_id").mapInArrow(local, schema), "phrases")

    def junctions(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("chunk").to_dict("records")
        out, tail, before = [], b"", None
        for row in rows:
            head = row["head"]
            goes_on = before is not None and not before["last_missing"] and not row["first_missing"] and row["first_start"] - before["last_end"] <= max_gap
            if goes_on and tail and head:
                first = head[0] & (BEGINS - 1)
                same = tail[-1] & (BEGINS - 1) == first
                rest = head[1:] if same else bytes([first]) + head[1:]
                if rest:
                    out.append({"file_id": row["file_id"], "seq": tail + rest, "lead": len(tail) - same, "split": len(tail)})
                own = row["tail"]
                # the steps before the next junction; of a short fragment also those of the fragments before it
                tail = own if len(own) >= halo else (tail + (rest if len(own) == len(head) else own))[-halo:]
            else:
                tail = row["tail"]
            before = row
        return pd.DataFrame(out, columns=["file_id", "seq", "lead", "split"]).astype({"lead": "int32", "split": "int32"})

    whole = encoded.filter(F.length("seq") > 0).select("file_id", "seq", F.lit(-1).alias("lead"), F.lit(-1).alias("split"))
    light = encoded.filter("edge").select("file_id", "chunk", "head", "tail", "first_start", "last_end", "first_missing", "last_missing")
    return whole.unionByName(light.groupBy("file_id").applyInPandas(junctions, "file_id bigint, seq binary, lead int, split int"))


def grow(pieces: list[tuple[int, int, bytes, int, int]], pattern: Pattern, need: int, candidates: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of patterns in ``need`` files at least, with their files and occurrences.

    pieces: (file, root, seq, lead, split), those of a file together. An occurrence is
    an end position of the pattern in a phrase. With ``candidates`` (sorted
    codes), these are counted whatever their support.
    """
    none = np.zeros(0, np.int64)
    if not pieces:
        return none, none, none
    lengths = np.array([len(p[2]) for p in pieces])
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    starts = np.cumsum(lengths) - lengths
    degree = ((data & (BEGINS - 1)).astype(np.int64) - np.repeat([p[1] for p in pieces], lengths)) % ALPHABET
    begins = (data & BEGINS) > 0
    begins[starts[lengths > 0]] = True
    phrase = np.cumsum(begins)
    ids = np.array([p[0] for p in pieces])
    file = np.repeat(np.cumsum(np.append(0, ids[1:] != ids[:-1])), lengths)
    lead, split = np.repeat([p[3] for p in pieces], lengths), np.repeat([p[4] for p in pieces], lengths)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    pos = np.flatnonzero((lead < 0) | (place < lead))
    code = degree[pos]
    n = len(data)
    for step in range(1, pattern.steps + 1):
        if step > 1:
            after, longer = [], []
            for skip in range(1, pattern.max_skip + 2):
                to = pos + skip
                ok = to < n
                ok[ok] = phrase[to[ok]] == phrase[pos[ok]]
                after.append(to[ok])
                longer.append(code[ok] * ALPHABET + degree[to[ok]])
            pos, code = np.concatenate(after), np.concatenate(longer)
        if step == pattern.steps:
            final = (split[pos] < 0) | (place[pos] >= split[pos])
            pos, code = pos[final], code[final]
        key = np.unique(code * n + pos)
        code, pos = key // n, key % n
        if candidates is not None:
            alive = np.isin(code, np.unique(candidates // ALPHABET ** (pattern.steps - step)))
            code, pos = code[alive], pos[alive]
        size = int(code[-1]) + 1 if len(code) else 0
        new = np.append(True, (code[1:] != code[:-1]) | (file[pos[1:]] != file[pos[:-1]]))[: len(code)]
        support = np.bincount(code[new], minlength=size)
        if candidates is None and len(code):
            alive = support[code] >= need
            code, pos = code[alive], pos[alive]
    found = np.unique(code)
    return found, support[found], np.bincount(code, minlength=size)[found]


def pattern_text(code: str, steps: int):
    """The column of a code as degrees joined by ``>``."""
    return F.concat_ws(">", *(F.pmod(F.floor(F.col(code) / ALPHABET**i), F.lit(ALPHABET)).cast("string") for i in range(steps - 1, -1, -1)))


def frequent_patterns(note_events: DataFrame, files: DataFrame, pattern: Pattern = Pattern(), max_gap: int = 30, bucket_files: int = 2048, bucket_steps: int = 1_000_000, long_file: int = 200_000) -> DataFrame:
    """Patterns of exactly ``pattern.steps`` degrees in at least ``pattern.share`` of a corpus's files.

    corpus_id, ngram (``0>4>2``), ngram_count (end positions of occurrences),
    ngram_file_support, corpus_files. A degree is the rounded source_midi less
    the file's root_pc, modulo 12. Phrases end where the next event starts more
    than ``max_gap`` frames after the previous one's end and at events without
    source_midi. Repeated rows count once. A file without events or without
    root_pc counts among its corpus's files and holds no pattern; events
    without file, start_frame or end_frame, or of a file that isn't in
    ``files``, are in none; null corpora are a corpus.
    """
    width = f"corpus_id {files.schema['corpus_id'].dataType.simpleString()}"
    # tables by file grow with the data and are never broadcast
    known = files.select(F.col("file_id").cast("bigint"), "corpus_id", F.col("root_pc").cast("int").alias("root")).dropna(subset=["file_id"]).dropDuplicates(["file_id"])
    found = phrases(note_events, max_gap, pattern.halo)
    lengths = found.groupBy("file_id").agg(F.sum(F.length("seq")).alias("steps"))
    known = stage(known.hint("merge").join(lengths, "file_id", "left").select("file_id", "corpus_id", "root", F.coalesce("steps", F.lit(0)).alias("steps")), "files")
    sizes = known.groupBy("corpus_id").agg(F.count("*").alias("corpus_files"), F.sum(F.when(F.col("steps") <= long_file, F.col("steps")).otherwise(0)).alias("corpus_steps"))
    # bucket -1 holds the long files; the others have no more than about so many files and steps each
    many = F.ceil(F.greatest(F.col("corpus_files") / bucket_files, F.col("corpus_steps") / bucket_steps, F.lit(1)))
    bucket = F.when(F.col("k.steps") > long_file, F.lit(-1)).otherwise(F.pmod(F.xxhash64("file_id"), many))
    placed = known.alias("k").join(sizes.alias("s"), F.col("k.corpus_id").eqNullSafe(F.col("s.corpus_id")))
    placed = stage(placed.select("k.file_id", "k.corpus_id", "k.root", "s.corpus_files", bucket.cast("int").alias("bucket")), "placed")
    buckets = stage(placed.groupBy("corpus_id", "bucket").agg(F.count("*").alias("bucket_files"), F.first("corpus_files").alias("corpus_files")), "buckets")
    split = stage(buckets.groupBy("corpus_id").agg(((F.count("*") > 1) | (F.min("bucket") < 0)).alias("split"), F.first("corpus_files").alias("corpus_files")), "corpora")
    table = placed.alias("p").hint("merge").join(found.alias("x"), "file_id").join(buckets.alias("b"), F.col("p.corpus_id").eqNullSafe(F.col("b.corpus_id")) & (F.col("p.bucket") == F.col("b.bucket")))
    table = stage(table.filter(F.col("p.root").isNotNull()).select("file_id", "p.corpus_id", "p.root", "p.bucket", "b.bucket_files", "x.seq", "x.lead", "x.split"), "pieces")
    schema = f"{width}, bucket int, code bigint, support bigint, n bigint"

    def tasks(pdf: pd.DataFrame) -> list[tuple[int, int, bytes, int, int]]:
        pdf = pdf.sort_values("file_id", kind="stable")
        return list(zip(pdf["file_id"].tolist(), pdf["root"].tolist(), pdf["seq"].tolist(), pdf["lead"].tolist(), pdf["split"].tolist()))

    def rows(pdf: pd.DataFrame, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
        code, support, n = found
        return pd.DataFrame({"corpus_id": [pdf["corpus_id"].iloc[0]] * len(code), "bucket": np.full(len(code), pdf["bucket"].iloc[0], np.int32), "code": code, "support": support, "n": n})

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        return rows(pdf, grow(tasks(pdf), pattern, needed(pattern.share, int(pdf["bucket_files"].iloc[0]))))

    usual = table.filter("bucket >= 0")
    mined = usual.groupBy("corpus_id", "bucket").applyInPandas(mine, schema)
    if split.filter("split").limit(1).count():
        mined = _over_buckets(stage(mined, "mined"), table, usual, split, buckets, pattern, schema, tasks, rows)
    total = mined.groupBy("corpus_id", "code").agg(F.sum("support").alias("ngram_file_support"), F.sum("n").alias("ngram_count"))
    whole = total.alias("t").join(split.alias("s"), F.col("t.corpus_id").eqNullSafe(F.col("s.corpus_id")))
    frequent = whole.filter(F.col("ngram_file_support") >= F.greatest(F.lit(1), F.ceil(F.lit(pattern.share) * F.col("s.corpus_files") - 1e-9)))
    return frequent.select("t.corpus_id", pattern_text("code", pattern.steps).alias("ngram"), "ngram_count", "ngram_file_support", "s.corpus_files")


def _over_buckets(mined: DataFrame, table: DataFrame, usual: DataFrame, split: DataFrame, buckets: DataFrame, pattern: Pattern, schema: str, tasks, rows) -> DataFrame:
    """Counts of every bucket's patterns in all buckets of their corpora, and of the long files."""
    several = split.filter("split").select("corpus_id")
    member = lambda df: df.alias("d").join(several.alias("v"), F.col("d.corpus_id").eqNullSafe(F.col("v.corpus_id")), "left_semi")

    def distinct_patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                code, _, n = grow([(row.file_id, row.root, row.seq, row.lead, row.split)], pattern, 1)
                yield pd.DataFrame({"file_id": row.file_id, "corpus_id": [row.corpus_id] * len(code), "bucket_files": row.bucket_files, "code": code, "n": n})

    kind = schema.split(", ")[0]
    long = table.filter("bucket < 0").mapInPandas(distinct_patterns, f"file_id bigint, {kind}, bucket_files bigint, code bigint, n bigint")
    long = long.groupBy("corpus_id", "file_id", "code").agg(F.sum("n").alias("n"), F.first("bucket_files").alias("bucket_files"))
    long = stage(long.groupBy("corpus_id", "code").agg(F.count("*").alias("support"), F.sum("n").alias("n"), F.first("bucket_files").alias("bucket_files")), "long")
    frequent_long = long.filter(F.col("support") >= F.ceil(F.lit(pattern.share) * F.col("bucket_files") - 1e-9)).select("corpus_id", "code")
    candidates = stage(member(mined).select("corpus_id", "code").unionByName(frequent_long).distinct(), "candidates")
    spread = candidates.alias("c").join(buckets.filter("bucket >= 0").alias("b"), F.col("c.corpus_id").eqNullSafe(F.col("b.corpus_id"))).select("c.corpus_id", "b.bucket", "c.code")

    def count(key: tuple, pdf: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(wanted):
            return rows(pdf, (np.zeros(0, np.int64),) * 3) if len(pdf) else pd.DataFrame({"corpus_id": [], "bucket": np.zeros(0, np.int32), "code": [], "support": [], "n": []})
        return rows(pdf, grow(tasks(pdf), pattern, 1, np.sort(wanted["code"].to_numpy())))

    counted = member(usual).groupBy("corpus_id", "bucket").cogroup(spread.groupBy("corpus_id", "bucket")).applyInPandas(count, schema)
    of_long = long.alias("l").join(candidates.alias("c"), F.col("l.corpus_id").eqNullSafe(F.col("c.corpus_id")) & (F.col("l.code") == F.col("c.code")), "left_semi").select("corpus_id", F.lit(-1).alias("bucket"), "code", "support", "n")
    single = mined.alias("d").join(several.alias("v"), F.col("d.corpus_id").eqNullSafe(F.col("v.corpus_id")), "left_anti")
    return single.unionByName(counted).unionByName(of_long)
