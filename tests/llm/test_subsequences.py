import itertools
import random
from collections import defaultdict

import pytest

from tunelore.llm.subsequences import Pattern, frequent_patterns, needed

EVENTS = "event_id bigint, file_id bigint, start_frame bigint, end_frame bigint, source_midi double, seq string, split int"
FILES = "file_id bigint, corpus_id bigint, root_pc int, bucket string, long string"


def some(seed, files=24):
    rng = random.Random(seed)
    events, rows = [], []
    for f in range(files):
        rows.append((f, rng.choice([1, 2, None]), rng.choice([0, 3, None, 11]) if f % 6 == 0 else 4, "b", "l"))
        at = 0
        for _ in range(rng.randint(0, 60)):
            at += rng.choice([0, 3, 30, 31])
            end = at + rng.randint(1, 9)
            events.append((len(events), f, at, end, rng.choice([60.0, 60.4, 61.0, 63.0, 63.0, 65.0, 67.0, None, float("nan")]) if rng.random() < 0.2 else float(60 + rng.choice([0, 3, 5])), "s", 1))
            at = end
    return events + events[::5], rows + rows[::3]


def plain(events, files, pattern, max_gap=30):
    known = {r[0]: r for r in files}
    size = defaultdict(int)
    for r in known.values():
        size[r[1]] += 1
    support, count = defaultdict(int), defaultdict(int)
    for f, (_, corpus, root, *_) in known.items():
        if root is None:
            continue
        phrases, before = [[]], None
        for _, _, s, e, v, *_ in sorted({x[:4] + (None if x[4] is None or x[4] != x[4] else x[4],) for x in events if x[1] == f}, key=lambda x: (x[2], x[0])):
            if v is None or (before is not None and s - before > max_gap):
                phrases.append([])
            before = e
            if v is not None:
                d = (round(v) - root) % 12
                if not phrases[-1] or phrases[-1][-1] != d:
                    phrases[-1].append(d)
            else:
                before = None
        ends = set()
        for i, p in enumerate(phrases):
            for gaps in itertools.product(range(1, pattern.max_skip + 2), repeat=pattern.steps - 1):
                for start in range(len(p)):
                    at = [start + sum(gaps[:k]) for k in range(pattern.steps)]
                    if at[-1] < len(p):
                        ends.add((">".join(str(p[k]) for k in at), i, at[-1]))
        for x in {x[0] for x in ends}:
            support[corpus, x] += 1
        for x in ends:
            count[corpus, x[0]] += 1
    return {k: (count[k], n) for k, n in support.items() if n >= needed(pattern.share, size[k[0]])}


@pytest.mark.parametrize("parts,kw", [(1, {}), (90, {}), (7, {"bucket_files": 5}), (30, {"bucket_files": 4, "long_file": 30})])
def test_equals_brute_force(spark, partitions, parts, kw):
    partitions(parts)
    events, files = some(parts)
    pattern = Pattern(3, 1, 0.3)
    got = frequent_patterns(spark.createDataFrame(events, EVENTS), spark.createDataFrame(files, FILES), pattern, **kw).collect()
    assert {(r["corpus_id"], r["ngram"]): (r["ngram_count"], r["ngram_file_support"]) for r in got} == plain(events, files, pattern)


def test_one_long_file_and_empty(spark, partitions):
    partitions(12)
    events = [(i, 1, i, i + 1, float(60 + i % 5), "s", 1) for i in range(600)]
    files = [(1, 1, 0, "b", "l")]
    df, ff = spark.createDataFrame(events, EVENTS), spark.createDataFrame(files, FILES)
    for long in (200_000, 50):
        got = frequent_patterns(df, ff, Pattern(5, 0, 0.3), long_file=long).collect()
        assert sorted(r["ngram_count"] for r in got) == sorted(sum(1 for i in range(4, 600) if i % 5 == k) for k in range(5))
    assert frequent_patterns(df.limit(0), ff).count() == 0
    assert frequent_patterns(df, ff.limit(0)).count() == 0
