import random

import numpy as np
import pytest

from tunelore.llm.packing import best_fit, container_fill, pack, pack_documents, plan_sizes

SCHEMA = "doc_id bigint, n bigint, bin string, part int, fill string"


def check(rows, capacity):
    """Items whole, pieces cut only where they must be, no container over capacity; the containers' fills."""
    fill, by_item = {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        by_item.setdefault(r["doc_id"], []).append(r)
    assert max(fill.values(), default=0) <= capacity
    for pieces in by_item.values():
        pieces.sort(key=lambda r: r["piece"])
        total = sum(r["size"] for r in pieces)
        assert [r["offset"] for r in pieces] == [i * capacity for i in range(len(pieces))]
        assert {r["n_pieces"] for r in pieces} == {len(pieces)} == {max(1, -(-total // capacity))}
        assert all(r["size"] == capacity for r in pieces[:-1])
    return fill, {k: sum(r["size"] for r in v) for k, v in by_item.items()}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_packs_tightly(spark, partitions, parts):
    partitions(parts)
    rng = random.Random(parts)
    sizes = [(i, rng.choice([0, 1, 5, rng.randint(1, 60), rng.randint(1, 350)]), "x", 1, "y") for i in range(4000)] + [(5000, None, None, None, None), (5001, -4, None, None, None)]
    rows = pack(spark.createDataFrame(sizes, SCHEMA), "doc_id", "n", 100).collect()
    fill, items = check(rows, 100)
    assert items == {i: max(0, n or 0) for i, n, *_ in sizes}
    bound = -(-sum(items.values()) // 100)
    assert len(fill) <= 1.02 * bound + 1


def test_what_cannot_be_combined_stays_apart(spark, partitions):
    partitions(8)
    rows = pack(spark.createDataFrame([(i, 51, "x", 1, "y") for i in range(300)], SCHEMA), "doc_id", "n", 100).collect()
    assert len(check(rows, 100)[0]) == 300
    rows = pack(spark.createDataFrame([(i, 0, "x", 1, "y") for i in range(300)], SCHEMA), "doc_id", "n", 100).collect()
    assert len(check(rows, 100)[0]) == 1
    assert pack(spark.createDataFrame([], SCHEMA), "doc_id", "n", 100).count() == 0


def test_best_fit_takes_the_fullest_bin():
    where, fills = best_fit([60, 50, 40, 10, 40, 0], 100)
    assert where[:5] == [0, 1, 0, 1, 1] and fills == [100, 100]


def test_documents(spark):
    df = spark.createDataFrame([(1, "a b " * 3000, "l"), (2, None, "l"), (3, "", "l"), (3, "", "l"), (4, "x", "l")], "doc_id bigint, text string, size string")
    rows = pack_documents(df, 2048).collect()
    assert sorted({(r["doc_id"], r["n_pieces"]) for r in rows}) == [(1, 3), (2, 1), (3, 1), (4, 1)] and len(rows) == 6
    assert sum(r["used"] for r in container_fill(pack_documents(df, 2048)).collect()) == sum(r["n_tokens"] for r in rows)


@pytest.mark.parametrize("seed", range(8))
def test_a_plan_gives_every_bin_one_container(seed):
    rng = random.Random(seed)
    counts = {rng.randint(0, 99): rng.choice([1, 2, 7, 1000]) for _ in range(30)}
    plan = plan_sizes(counts, 100)
    fill = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    used = np.bincount(plan.containers(fill, rank), fill)
    assert used.max() <= 100 and used.sum() == fill.sum()
    # as full as taking the bins one by one
    assert len(used) <= len(best_fit(sorted(fill.tolist(), reverse=True), 100)[1]) * 1.02 + 1
    assert len(plan_sizes({}, 100).size) == 0


def test_half_full_bins_of_many_partitions_are_all_combined(spark, partitions):
    partitions(64)
    rng = random.Random(1)
    rows = pack(spark.createDataFrame([(i, rng.choice([45, 55]), "x", 1, "y") for i in range(20_000)], SCHEMA), "doc_id", "n", 100).collect()
    fill, items = check(rows, 100)
    assert len(items) == 20_000 and len(fill) <= 1.01 * -(-sum(items.values()) // 100)
