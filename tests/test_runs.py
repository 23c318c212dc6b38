"""Merging the runs of chunks, for any cut into chunks and pieces."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tunelore.operators.runs import CLOSED, FIRST, LAST, WHOLE, Likeness, OpenRun, chunk_count, encode_runs, join_runs, merge_ends, pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=25), st.data())
def test_merge_is_associative(values, data):
    like = Likeness(0.0, None)
    chunks, at = [], 0
    while at < len(values):
        size = data.draw(st.integers(1, 6))
        part = values[at : at + size]
        out = []
        for i, v in enumerate(part):
            if out and out[-1]["last_value"] == v:
                out[-1] |= {"n": out[-1]["n"] + 1, "last_id": at + i}
            else:
                out.append({"key": 1, "start": 0, "end": 0, "n": 1, "first_value": v, "last_value": v, "last_start": 0, "last_end": 0, "first_id": at + i, "last_id": at + i, "chunk_from": len(chunks), "chunk_to": len(chunks), "slot": CLOSED})
        out[0]["slot"], out[-1]["slot"] = (WHOLE, WHOLE) if len(out) == 1 else (FIRST, LAST)
        chunks.append(out)
        at += size
    ends = [[r for r in c if r["slot"] != CLOSED] for c in chunks]
    flat = merge_ends(like, [r for c in ends for r in c])
    cut = data.draw(st.integers(0, len(ends)))
    left, right = (merge_ends(like, [r for c in part for r in c]) for part in (ends[:cut], ends[cut:]))
    tree = merge_ends(like, [r for r in left + right if r["slot"] != CLOSED])
    closed = [r for r in left + right if r["slot"] == CLOSED]
    key = lambda r: (r["first_id"], r["last_id"], r["n"])
    assert sorted(map(key, tree + closed)) == sorted(map(key, flat))
    assert join_runs(like, flat[0], flat[0] | {"key": 2, "first_id": 99, "start": 1}) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 3)), min_size=1, max_size=40), st.data())
def test_pieces_of_a_chunk_give_its_runs(values, data):
    """Runs carried from piece to piece are those of the whole chunk; a copy at a cut counts once."""
    like = Likeness(0.0, None)
    v = np.array([x for x, _ in values], float)
    key, at, ident = np.array([k for _, k in values]), np.arange(len(v)), np.arange(len(v))
    order = np.argsort(key, kind="stable")
    key, v = key[order], v[order]
    whole, _, _ = encode_runs(like, key, at, at, v, ident, 3)
    carried, parts, start = OpenRun(like), [], 0
    while start < len(v):
        end = min(len(v), start + data.draw(st.integers(1, 9)))
        again = max(0, start - data.draw(st.integers(0, 1)))
        found, _, _ = encode_runs(like, *(x[again:end] for x in (key, at, at, v, ident)), 3)
        parts.append(carried.take(found)[0])
        start = end
    parts.append(carried.close())
    got = pd.concat(parts, ignore_index=True)
    columns = ["key", "start", "end", "n", "first_value", "last_id", "slot"]
    assert got[columns].astype(float).to_numpy().tolist() == whole[columns].astype(float).to_numpy().tolist()


def test_chunks_follow_the_size(spark, tmp_path, monkeypatch):
    df = spark.range(1000)
    df.write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert chunk_count(table) == 5
    monkeypatch.setattr("tunelore.operators.runs.CHUNK_BYTES", 500)
    assert chunk_count(table) > 5 and chunk_count(spark.createDataFrame([(i,) for i in range(900)], "a bigint")) > 5
    import pyarrow as pa

    batches = pa.table({"a": list(range(100))}).to_batches(max_chunksize=7)
    cut = list(pieces(batches, 20))
    assert [len(t) for t in cut] == [21] * 4 + [16] and not list(pieces([]))
