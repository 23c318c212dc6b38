import numpy as np
import pytest

from tunelore.llm.similarity_clusters import Tightness, communities, describe, louvain, neighbour_descent, neighbour_graph, neighbours_in_order, similarity_clusters, tight_sets, unit_vectors

SCHEMA = "file_id bigint, corpus_id bigint, feature array<double>, vec string, block int, id string"
DIMS = 24


def planted(seed, sizes=(12, 5, 3, 2), noise=40, corpora=2):
    rng = np.random.default_rng(seed)
    rows, clusters = [], set()
    for c in range(corpora):
        for n in sizes:
            centre = rng.normal(size=DIMS)
            centre /= np.linalg.norm(centre)
            members = []
            for _ in range(n):
                v = centre + rng.normal(size=DIMS) * 0.03
                rows.append([len(rows), c, (v * rng.uniform(0.5, 9)).tolist(), "x", 1, "y"])
                members.append(rows[-1][0])
            if n >= 3:
                clusters.add(tuple(members))
        for _ in range(noise):
            rows.append([len(rows), c, rng.normal(size=DIMS).tolist(), "x", 1, "y"])
    return rows, clusters


def clusters_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster_id"], []).append(r["file_id"])
    return {tuple(sorted(v)) for v in out.values()}


@pytest.mark.parametrize("block", [2048, 15])
def test_planted_clusters_are_found(spark, block):
    rows, clusters = planted(block)
    bad = [[900, 0, None, None, None, None], [901, 0, [1.0], "", 0, ""], [902, 0, [0.0] * DIMS, "", 0, ""], [903, 1, [float("nan")] + [1.0] * (DIMS - 1), "", 0, ""], [904, 1, [None] + [1.0] * (DIMS - 1), "", 0, ""], [None, 1, [1.0] * DIMS, "", 0, ""]]
    df = spark.createDataFrame(rows + rows[::4] + bad, SCHEMA)
    found = similarity_clusters(df, "file_id", "corpus_id", "feature", DIMS, block=block)
    assert clusters_of(found) == clusters
    pairs = {(r["first"], r["second"]) for r in neighbours_in_order(found, "cluster_id", "file_id").collect()}
    assert pairs == {p for c in clusters for p in zip(c, c[1:])}
    report = {r["cluster_id"]: r for r in describe(found, "corpus_id", "file_id").collect()}
    assert {r["cluster_size"] for r in report.values()} == {12, 5, 3}
    assert all(len(r["typical"]) == 3 and set(r["typical"]) <= set(next(c for c in clusters if c[0] == k)) for k, r in report.items())


def test_copies_and_empty(spark):
    same = [[i, 7, [1.0, 2.0] + [0.0] * (DIMS - 2), "x", 1, "y"] for i in range(500)]
    other = [[1000 + i, None, np.eye(DIMS)[i].tolist(), "x", 1, "y"] for i in range(10)]
    assert clusters_of(similarity_clusters(spark.createDataFrame(same + other, SCHEMA), "file_id", "corpus_id", "feature", DIMS, block=20)) == {tuple(range(500))}
    assert similarity_clusters(spark.createDataFrame([], SCHEMA), "file_id", "corpus_id", "feature", DIMS).count() == 0


def test_neighbour_descent_recall():
    x = np.random.default_rng(1).normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, cos = neighbour_descent(x, 10)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9
    assert (np.diff(cos) <= 1e-12).all()
    assert [len(a) for a in neighbour_descent(x[:1])] == [1, 1]


def test_communities_of_two_cliques():
    edges = [(a, b) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5)]
    label = louvain(11, *np.array(edges).T, np.ones(len(edges)))
    assert len(set(label[:5])) == 1 and len(set(label[5:10])) == 1 and len(set(label)) == 3
    assert communities(np.eye(3), 0.5).tolist() == [0, 1, 2]


def test_two_clusters_that_link_are_both_found(spark):
    # centres at 0.82, members at 0.96 to their own: cross edges make one community of both, whose mean is near all of them
    rng = np.random.default_rng(5)
    rows = []
    for side in (1, -1):
        centre = np.zeros(DIMS)
        centre[:2] = np.sqrt(0.91), side * np.sqrt(0.09)
        for k in range(6):
            off = np.zeros(DIMS)
            off[2 + 2 * (k // 2) + (side < 0)] = (-1) ** k
            rows.append([len(rows), 1, ((0.96 * centre + 0.28 * off) * rng.uniform(1, 5)).tolist(), "x", 1, "y"])
    for k in range(10):
        rows += [[len(rows) + i, 1, (np.eye(DIMS)[8 + k] + 0.01 * rng.normal(size=DIMS)).tolist(), "x", 1, "y"] for i in range(6)]
    assert len(set(communities(np.array([np.array(r[2]) / np.linalg.norm(r[2]) for r in rows]), 0.75)[:12])) == 1
    found = clusters_of(similarity_clusters(spark.createDataFrame(rows, SCHEMA), "file_id", "corpus_id", "feature", DIMS))
    assert found == {tuple(range(at, at + 6)) for at in range(0, 72, 6)}


def large_group(n, dims=71, seed=11):
    """One group: clusters of 3 to 400 records, one of a tenth of all, and noise."""
    rng = np.random.default_rng(seed)
    parts, left = [], n
    for size in [n // 10, *([3, 5, 8, 20, 60, 400] * 99)]:
        if left - size < n // 2:
            break
        parts.append(rng.normal(size=dims) + rng.normal(size=(size, dims)) * rng.uniform(0.1, 0.25))
        left -= size
    # pairs of large clusters near each other: not separate, and without a link between them
    for _ in range(6):
        one, other = (c / np.linalg.norm(c) for c in rng.normal(size=(2, dims)))
        for centre in (one, 0.885 * one + 0.465 * other):
            parts.append(centre * 8 + rng.normal(size=(40, dims)) * 0.15)
            left -= 40
    parts.append(rng.normal(size=(left, dims)))
    x = np.concatenate(parts)
    return x[rng.permutation(n)]


def test_recall_in_a_large_cut_group(spark, partitions):
    partitions(8)
    n = 20_000
    x = large_group(n)
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "file_id bigint, corpus_id bigint, feature array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = clusters_of(similarity_clusters(df, "file_id", "corpus_id", "feature", 71))
    # brute force: every record's surroundings, taken again over the whole group until they stay
    true, seen = set(), np.zeros(n, bool)
    for i in range(n):
        near = np.flatnonzero(x @ x[i] >= 0.8)
        if len(near) < 3 or seen[i]:
            continue
        before = None
        while before is None or len(near) != len(before) or (near != before).any():
            mean = x[near].sum(0)
            before, near = near, np.flatnonzero(x @ mean / np.linalg.norm(mean) >= Tightness().middle)
        cos = x @ mean / np.linalg.norm(mean)
        seen[near] = True
        if len(near) >= 3 and cos[near].min() >= 0.92 and (np.delete(cos, near) < 0.85).all():
            true.add(tuple(near.tolist()))
    assert len(true) > 60 and max(map(len, true)) >= 2000
    assert found <= true and len(found & true) >= 0.98 * len(true)
    # the graph's links over all chunks
    reps = unit_vectors(df.selectExpr("1L as g", "file_id as id", "feature as vec"), 71)
    sides = {}
    for r in neighbour_graph(reps, 71).collect():
        sides.setdefault(r["a"], {})[r["b"]] = r["cos"]
    kept = total = 0
    for i in range(0, n, 10):
        s = x @ x[i]
        s[i] = -2
        best = [j for j in np.argsort(-s, kind="stable")[:12] if s[j] >= 0.75]
        total += len(best)
        kept += sum(j in sides.get(i, {}) for j in best)
    assert total > 5000 and kept >= 0.9 * total


def test_the_graph_decides(spark, monkeypatch):
    rows, clusters = planted(4)
    df = spark.createDataFrame(rows, SCHEMA)
    x = np.array([r[2] for r in rows if r[1] == 0])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert len(list(tight_sets(x, np.ones(len(x)), Tightness()))) == 3
    import tunelore.llm.similarity_clusters as m

    monkeypatch.setattr(m, "links_of", lambda x: (np.zeros(0, int), np.zeros(0, int), np.zeros(0)))
    assert not list(tight_sets(x, np.ones(len(x)), Tightness()))


def test_no_links_at_all_in_a_cut_group(spark):
    rows = [(i, None, v) for i, v in enumerate(np.eye(40).tolist())]
    df = spark.createDataFrame(rows, "file_id bigint, corpus_id bigint, feature array<double>")
    assert similarity_clusters(df, "file_id", "corpus_id", "feature", 40, block=10).count() == 0


def test_null_group_and_groups_of_unusable_vectors(spark):
    v = [1.0] + [0.01] * (DIMS - 1)
    near = [[i, None, [x * (1 + i) + 0.001 * i * (j == 3) for j, x in enumerate(v)], "x", 1, "y"] for i in range(4)]
    bad = [[10, 5, [float("nan")] * DIMS, "x", 1, "y"], [11, 5, [0.0] * DIMS, "x", 1, "y"], [12, 6, [None] * DIMS, "x", 1, "y"], [13, 7, [1e200] * DIMS, "x", 1, "y"], [14, 7, [1e-200] * DIMS, "x", 1, "y"], [15, 7, [-1.0] * DIMS, "x", 1, "y"], [16, 7, [3.0] * DIMS, "x", 1, "y"]]
    found = similarity_clusters(spark.createDataFrame(near + bad, SCHEMA), "file_id", "corpus_id", "feature", DIMS)
    assert clusters_of(found) == {(0, 1, 2, 3), (13, 14, 16)}
    assert {r["corpus_id"] for r in found.collect()} == {None, 7}
