"""Encoding and decoding of texts with a public byte-level BPE tokenizer.

The tokenizer file's path is a parameter; nothing of it is kept here. Texts
run through Arrow batches, each cut into slices of bounded length for the
library, so that a batch of very long texts needs no more memory than its
largest text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.staging import stage

#: Where the public tokenizers lie; every operator takes another path.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters given to the library at once.
SLICE_CHARS = 2_000_000
#: Keys of several rows are broadcast up to this many (8 bytes each).
BROADCAST_KEYS = 1_000_000


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text), one for each key; rows without key are told apart by their texts.

    The keys alone are counted. Texts of keys that occur once stay where they
    are; only those of repeated keys, and of none, are shuffled.
    """
    rows = df.select(key, text)
    again = stage(rows.groupBy(key).count().filter((F.col("count") > 1) & F.col(key).isNotNull()).select(key), "repeated")
    few = again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    single = rows.filter(F.col(key).isNotNull()).join(F.broadcast(again) if few else again, key, "left_anti")
    marked = rows.join((F.broadcast(again) if few else again).withColumn("_again", F.lit(True)), key, "left").filter(F.col(key).isNull() | F.col("_again"))
    # texts of 128 equal bits are one text
    told = F.when(F.col(key).isNull(), F.concat_ws("-", F.xxhash64(text), F.md5(F.col(text))))
    return single.unionByName(marked.withColumn("_text_of", told).dropDuplicates([key, "_text_of"]).select(key, text))


@functools.lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per worker; special tokens' strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encodings(path: str, texts: list[str]) -> Iterator:
    """The library's encoding of each text, in order."""
    tokenizer = load(path)
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > SLICE_CHARS:
            yield from tokenizer.encode_batch_fast(part, add_special_tokens=False)
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield from tokenizer.encode_batch_fast(part, add_special_tokens=False)


def _over_texts(df: DataFrame, keep: list[str], text: str, fields: str, fill: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """``keep`` columns and what ``fill`` makes of the texts (null: empty)."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [fields])
    names = [x.split()[0] for x in fields.split(", ")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *fill(texts)], [*keep, *names])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(local, schema)


def _lists(parts: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(parts), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """One row (key, ids) for each distinct key; ids of its text without special tokens.

    Rows of the same key are one document, of which any text counts; a row
    without key is a document of its own, unless its text is that of another
    one. An empty or null text has an empty list, never null.
    """
    once = distinct_texts(df, key, text)
    return _over_texts(once, [key], text, "ids array<int>", lambda texts: [_lists([e.ids for e in encodings(tokenizer, texts)])])


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """One row (key, n_tokens) for each distinct key; a null or empty text has none."""
    once = distinct_texts(df, key, text)
    return _over_texts(once, [key], text, "n_tokens bigint", lambda texts: [pa.array([len(e.ids) for e in encodings(tokenizer, texts)], pa.int64())])


@functools.cache
def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for their own byte; the other bytes,
    in order, are given the characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; a special token's are its own text."""
    table = byte_of_character()
    tokenizer = load(path)
    special = tokenizer.get_added_tokens_decoder()
    words = (tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size()))
    return [w.encode() if i in special else bytes(table[c] for c in w) for i, w in enumerate(words)]


def decode_ids(path: str, ids: list[int]) -> str:
    """The text of ids; bytes that are no whole character come out as U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def byte_spans(path: str, ids: list[int]) -> np.ndarray:
    """Start and end of each token in the text's UTF-8 bytes; a character split over tokens is split here too."""
    ends = np.cumsum([0, *(len(token_bytes(path)[i]) for i in ids)])
    return np.stack([ends[:-1], ends[1:]], 1)


def character_spans(path: str, ids: list[int]) -> np.ndarray:
    """Start and end of each token in characters; every token of a split character covers all of it."""
    table = token_bytes(path)
    data = b"".join(table[i] for i in ids)
    starts = np.frombuffer(data, np.uint8) & 0xC0 != 0x80  # bytes that begin a character
    before = np.append(0, np.cumsum(starts))
    spans = byte_spans(path, ids)
    return np.stack([np.maximum(before[np.minimum(spans[:, 0] + 1, len(data))] - 1, 0), before[spans[:, 1]]], 1)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = BYTE_BPE) -> DataFrame:
    """Rows (key, text) of rows with ids; null ids give an empty text."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(tokenizer, x or []) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, F.col(ids).alias("_ids")).mapInArrow(local, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """Rows (key, ids, starts, ends) for each distinct key: the tokens' places in the text, in characters."""

    def fill(texts: list[str]) -> list[pa.Array]:
        ids = [e.ids for e in encodings(tokenizer, texts)]
        places = [character_spans(tokenizer, x) for x in ids]
        return [_lists(ids), _lists([p[:, 0].tolist() for p in places]), _lists([p[:, 1].tolist() for p in places])]

    once = distinct_texts(df, key, text)
    return _over_texts(once, [key], text, "ids array<int>, starts array<int>, ends array<int>", fill)
