import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tunelore.llm.term_frequency import MELODY_TERMS, degree, interval, melody_terms, pack_counts, pack_ids, trigram, union, unpack_ids

SCHEMA = "file_id bigint, corpus_id bigint, degree_count map<string,bigint>, interval_count map<string,bigint>, trigram_count map<string,bigint>, kind string, ids binary, grp int"


def test_forms():
    assert [degree(x) for x in ("03", "15", "-9", "7.0", "x", "2.5", "-2.5")] == ["3", "3", "3", "7", None, "3", "9"]
    assert [interval(x) for x in ("+3", "19", "12.0", "0", "")] == ["3", "12", "12", None, None]
    assert [trigram(x) for x in ("0 > 4 > 7", "(00, 04, 19)", "0-4-7", "1,2")] == ["0>4>7", "0>4>7", "0>4>7", None]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=60), st.sets(st.integers(0, 65535), max_size=60), st.booleans())
def test_union_of_containers(a, b, dense):
    a |= set(range(5000)) if dense else set()
    for count in (2, 300, 70_000, 1 << 40):
        pack = lambda s: (pack_ids(np.array(sorted(s), np.int64)), pack_counts(np.full(len(s), count)) if s else b"")  # noqa: B023, E731
        assert unpack_ids(pack(a)[0]).tolist() == sorted(a)
        assert union([pack(a), pack(b)]) == (len(a | b), count * len(a | b))


def some(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for f in range(n):
        maps = []
        for keys in (["1", "01", "13", "7"], ["+1", "1", "20"], ["0>1>2", "(0, 1, 2)", "5-6-7"]):
            maps.append(None if rng.random() < 0.1 else {k: rng.choice([0, 1, 3, None]) for k in rng.sample(keys, rng.randint(0, len(keys)))})
        rows.append((f * 40_000, rng.choice([1, 2, None]), *maps, "k", b"", 1))
    return rows + [rows[5]] * 200 + rows[::9] + [(None, 1, {"1": 1}, None, None, None, None, None)]


@pytest.mark.parametrize("parts", [1, 6, 50])
def test_equals_plain_counts(spark, partitions, parts):
    partitions(parts)
    rows = some(parts)
    got = {(r["corpus_id"], r["kind"], r["term"]): (r["total_count"], r["file_count"], r["corpus_files"], r["mark"]) for r in melody_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    once = {r[0]: r for r in rows if r[0] is not None}.values()
    total, files, size = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in once:
        size[r[1]] += 1
        for kind, m in zip(MELODY_TERMS, r[2:5]):
            held = defaultdict(int)
            for k, v in (m or {}).items():
                held[MELODY_TERMS[kind](k)] += v or 0
            for t, v in held.items():
                if v:
                    total[r[1], kind, t] += v
                    files[r[1], kind, t] += 1
    mark = lambda k: "rare" if files[k] <= 2 else "common" if files[k] > 0.6 * size[k[0]] else None
    assert got == {k: (total[k], files[k], size[k[0]], mark(k)) for k in total}


def test_empty(spark):
    assert melody_terms(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_one_record_in_two_groups(spark, partitions, parts):
    partitions(parts)
    rows = [(f, g, {"1": n}, None, None, "k", b"", 1) for f, g, n in [(1, 1, 2), (5, 1, 3), (4, 2, 2000), (5, 2, 3), (9, 2, 1), (5, 2, 3), (5, 1, 3)]]
    got = {r["corpus_id"]: (r["total_count"], r["file_count"], r["corpus_files"]) for r in melody_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (5, 2, 2), 2: (2004, 3, 3)}
