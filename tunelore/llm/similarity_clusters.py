"""Clusters of records with mutually similar feature vectors.

1. Exact copies of a vector become one weighted representative.
2. A nearest-neighbour graph is built by neighbour descent: a group of up to
   ``block`` representatives in one task; a larger one in overlapping leaves
   of several random-hyperplane trees, whose lists are merged and then
   descended over the whole group, neighbours of neighbours being tried until
   few lists change. A link cut in one tree is found in another or by descent.
3. Communities of the graph's links by modularity, for several least cosines
   of a link, since a community of weak links may hold several clusters. In a
   large group, chunks of the graph merge their nodes by modularity, over
   levels of other chunks, until every tree's chunks leave them as they are.
4. Communities of enough files are the candidates. The files near a
   candidate's mean are taken again until they stay, and the set stands only
   if it is as tight and as separate as asked. In a group of one task every
   file of the group is looked at; in a larger one the files linked to the
   set, and once these stay, all files, in blocks.
   A cluster's most typical members have the highest internal weighted degree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators.runs import chunk_number, pieces, range_chunks
from tunelore.staging import drop, stage

#: Neighbours of a record; representatives of a group that one task takes, and of a leaf of a larger group's trees; the trees.
NEIGHBOURS, BLOCK, TREES = 12, 2048, 6
#: Least cosines of links, one for each pass of communities; that of the weakest neighbours that are kept.
LINKS, FLOOR = (0.75, 0.8, 0.85, 0.885), 0.6
#: Means that a pass over the records of large groups takes.
MEANS = 16_000
#: Rows that neighbour descent starts from exactly, and the share of lists that may still change at its end.
LEAF, SETTLED = 64, 0.001


@dataclass(frozen=True)
class Tightness:
    """Members have at least ``inner`` cosine to the cluster's mean direction, all others of the group less than ``outer``."""

    inner: float = 0.92
    outer: float = 0.85
    least: int = 3

    @property
    def middle(self) -> float:
        return (self.inner + self.outer) / 2


def merge_lists(n: int, k: int, a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` rows the ``k`` best of its candidates (a, b, cosine), best first; -1 and -9 where there are fewer."""
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    key = np.unique(a * n + b, return_index=True)[1]
    once = np.zeros(len(a), bool)
    once[key] = True
    a, b, cos = a[once], b[once], cos[once]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    near = rank < k
    ids, out = np.full((n, k), -1), np.full((n, k), -9.0)
    ids[a[near], rank[near]], out[a[near], rank[near]] = b[near], cos[near]
    return ids, out


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = 1 << 15) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[a[i : i + rows]], x[b[i : i + rows]]) for i in range(0, len(a), rows)] or [np.zeros(0)])


def neighbour_descent(x: np.ndarray, k: int = NEIGHBOURS, seed: int = 1, trees: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Approximate k nearest neighbours by cosine of unit rows: ids and cosines, best first.

    Starts from the exact neighbours in the leaves of random trees. Each round
    tries all pairs of a record's neighbours and reverse neighbours of which
    one is new, and keeps the best, until few lists change.
    """
    n = len(x)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros((n, 0), int), np.zeros((n, 0))
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(trees if n > LEAF else 1):
        todo = [np.arange(n)]
        while todo:
            rows = todo.pop()
            if len(rows) > max(LEAF, k + 1):
                side = x[rows] @ (x[rng.choice(rows)] - x[rng.choice(rows)])
                order = np.argsort(side, kind="stable")
                todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
                continue
            s = x[rows] @ x[rows].T
            np.fill_diagonal(s, -9)
            best = np.argsort(-s, 1, kind="stable")[:, :k]
            parts.append((np.repeat(rows, best.shape[1]), rows[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
    ids, cos = merge_lists(n, k, *(np.concatenate(p) for p in zip(*parts)))
    new = ids >= 0
    one, two = np.triu_indices(2 * k, 1)
    while n > LEAF and new.sum() > SETTLED * n * k:
        to, frm, fresh = ids.ravel(), np.repeat(np.arange(n), k), new.ravel()
        order = rng.permutation(n * k)
        order = order[to[order] >= 0]
        order = order[np.argsort(to[order], kind="stable")]
        to, frm, fresh = to[order], frm[order], fresh[order]
        rank = np.arange(len(to)) - np.searchsorted(to, to)
        near = rank < k
        back, back_new = np.full((n, k), -1), np.zeros((n, k), bool)
        back[to[near], rank[near]], back_new[to[near], rank[near]] = frm[near], fresh[near]
        both, flag = np.concatenate([ids, back], 1), np.concatenate([new, back_new], 1)
        pairs = []
        for at in range(0, n, 512):
            a, b = both[at : at + 512, one], both[at : at + 512, two]
            use = (a >= 0) & (b >= 0) & (a != b) & (flag[at : at + 512, one] | flag[at : at + 512, two])
            a, b = a[use], b[use]
            pairs.append(np.unique(np.minimum(a, b) * n + np.maximum(a, b)))
        key = np.unique(np.concatenate(pairs))
        a, b = key // n, key % n
        s = _dots(x, a, b)
        a, b, s = np.append(a, b), np.append(b, a), np.append(s, s)
        better = s > cos[a, -1]
        row = np.repeat(np.arange(n), k)
        held = ids.ravel() >= 0
        before = ids
        ids, cos = merge_lists(n, k, np.append(row[held], a[better]), np.append(ids.ravel()[held], b[better]), np.append(cos.ravel()[held], s[better]))
        new = (ids >= 0) & ~(ids[:, :, None] == before[:, None, :]).any(2)
    return ids, cos


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, outside: np.ndarray | None = None, total: float | None = None) -> np.ndarray:
    """Communities of highest modularity found by local moves and aggregation; edges a-b of weight w, each once.

    outside: weight of a node's edges that are not given, which counts for its
    degree; total: the degree of the whole graph, if these nodes are a part.
    """
    label = np.arange(n)
    outside = np.zeros(n) if outside is None else outside
    while True:
        links: list[dict[int, float]] = [{} for _ in range(n)]
        loops = np.zeros(n)
        for i, j, v in zip(a.tolist(), b.tolist(), w.tolist()):
            if i == j:
                loops[i] += v
            else:
                links[i][j] = links[i].get(j, 0) + v
                links[j][i] = links[j].get(i, 0) + v
        degree = [sum(m.values()) + 2 * loop + o for m, loop, o in zip(links, loops.tolist(), outside.tolist())]
        whole = total or sum(degree)
        if not whole:
            return label
        own = list(range(n))
        volume = list(degree)
        moved_any, moved = False, 1
        while moved:
            moved = 0
            for i in range(n):
                if not links[i]:
                    continue
                to: dict[int, float] = {}
                for j, v in links[i].items():
                    to[own[j]] = to.get(own[j], 0) + v
                old, d = own[i], degree[i]
                volume[old] -= d
                best, gain = old, to.get(old, 0) - d * volume[old] / whole
                for c, v in to.items():
                    g = v - d * volume[c] / whole
                    if g > gain + 1e-9:
                        best, gain = c, g
                volume[best] += d
                if best != old:
                    own[i] = best
                    moved += 1
            moved_any |= moved > 0
        names, new = np.unique(own, return_inverse=True)
        label = new[label]
        if not moved_any:
            return label
        ends = np.sort(np.stack([new[a], new[b]], 1), 1)
        key, where = np.unique(ends[:, 0] * len(names) + ends[:, 1], return_inverse=True)
        outside = np.bincount(new, outside, len(names))
        a, b, w, n = key // len(names), key % len(names), np.bincount(where, w), len(names)


def links_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, cosine) of the unit rows' neighbour graph, each once."""
    ids, cos = neighbour_descent(x)
    n = max(len(x), 1)
    i, j, w = np.repeat(np.arange(len(x)), ids.shape[1]), ids.ravel(), cos.ravel()
    near = (j >= 0) & (w >= FLOOR)
    pairs = np.sort(np.stack([i[near], j[near]], 1), 1)
    key, first = np.unique(pairs[:, 0] * n + pairs[:, 1], return_index=True)
    return key // n, key % n, w[near][first]


def communities(x: np.ndarray, least: float, edges: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Community of each unit row, named by its first row; neighbours below the cosine ``least`` are none."""
    a, b, w = links_of(x) if edges is None else edges
    near = w >= least
    a, b, w = a[near], b[near], w[near]
    # records without any link are alone
    linked = np.unique(np.append(a, b))
    label = np.arange(len(x))
    if len(linked):
        _, first, own = np.unique(louvain(len(linked), np.searchsorted(linked, a), np.searchsorted(linked, b), w), return_index=True, return_inverse=True)
        label[linked] = linked[first][own]
    return label


def settled_sets(x: np.ndarray, wx: np.ndarray, starts: np.ndarray, middle: float) -> np.ndarray:
    """Rows of truth values: the sets, met from ``starts``, that hold exactly the unit rows ``x`` of cosine ``middle`` or more to their mean.

    wx: the rows by their weights. A set's next one has no less cosine to its
    mean in all, and none is met twice, so every start settles.
    """
    found: dict[bytes, np.ndarray] = {}
    seen: set[bytes] = set()
    while len(starts):
        mean = starts.astype(float) @ wx
        near = mean / np.maximum(np.linalg.norm(mean, axis=1), 1e-300)[:, None] @ x.T >= middle
        keys = [r.tobytes() for r in np.packbits(near, 1)]
        same = (near == starts).all(1)
        for key, stays, row in zip(keys, same, near):
            if stays:
                found[key] = row
        starts = near[[i for i, key in enumerate(keys) if not same[i] and not (key in seen or seen.add(key))]]
    return np.array(list(found.values()), bool).reshape(-1, len(x))


def tight_sets(x: np.ndarray, weight: np.ndarray, tight: Tightness) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each cluster of weighted unit rows: its rows, their cosines to the mean, and their internal weighted degrees.

    The degree of a file is the sum of its cosines to all other files of its cluster.
    """
    edges = links_of(x)
    starts: dict[bytes, np.ndarray] = {}
    # passes that keep the same links have the same communities
    for link in dict(zip([int((edges[2] >= x).sum()) for x in reversed(LINKS)], reversed(LINKS))).values():
        label = communities(x, link, edges)
        for name in np.flatnonzero(np.bincount(label, weight, len(x)) >= tight.least):
            row = label == name
            starts[np.packbits(row).tobytes()] = row
    if not starts:
        return
    wx = x * weight[:, None]
    for row in settled_sets(x, wx, np.array(list(starts.values())), tight.middle):
        total = wx[row].sum(0)
        length = np.linalg.norm(total)
        cos = x @ total / max(length, 1e-300)
        if weight[row].sum() >= tight.least and cos[row].min() >= tight.inner and (cos[~row] < tight.outer).all():
            yield np.flatnonzero(row), cos[row], length * cos[row] - 1


def _matrix(col: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def unit_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of the usable rows, and which these are: all finite and not all zero."""
    # divided by the largest first, so that no square overflows or vanishes
    top = np.abs(v).max(1, initial=0.0)
    sound = np.isfinite(v).all(1) & (top > 0)
    v = v[sound] / top[sound, None]
    return v / np.linalg.norm(v, axis=1)[:, None], sound


def unit_vectors(df: DataFrame, dims: int) -> DataFrame:
    """Rows whose ``vec``, of ``dims`` numbers, is usable, with the unit vector in its place."""
    names = df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, sound = unit_rows(_matrix(b.column("vec"), dims).astype(float))
            b = b.filter(pa.array(sound))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([vec if c == "vec" else b.column(c) for c in names], names)

    return df.mapInArrow(local, df.schema)


def similarity_clusters(df: DataFrame, key: str, group: str, vector: str, dims: int, tight: Tightness = Tightness(), block: int = BLOCK) -> DataFrame:
    """Members of all clusters: group, cluster_id (the least key), key, cosine to the mean, degree, cluster_size.

    A cluster is a set of at least ``tight.least`` records of one group whose
    members' cosines to the mean of their unit vectors are at least
    ``tight.inner``, every other record of the group being below
    ``tight.outer``. degree is the sum of a member's cosines to the others.
    Rows of one key are one record; a vector that is null, of another length,
    all zero or holds a null, NaN or infinity is in no cluster, nor is a row
    without key; null groups are a group. Copies and scaled copies of a vector
    are records like others.
    """
    whole_length = F.col(vector).isNotNull() & (F.size(vector) == dims)
    sound = df.filter(whole_length).select(F.col(group).alias("grp"), F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(vector).cast("array<double>")).alias("same"), F.col(vector).cast("array<double>").alias("vec")).dropna(subset=["id"])
    kind = _type(sound, "grp")
    # a key's rows are copies; of contradicting ones the least counts
    files = stage(sound.groupBy("id").agg(F.min(F.struct("grp", "same")).alias("of")).select("id", "of.*"), "files")
    weights = files.groupBy("grp", "same").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("weight"))
    vectors = sound.groupBy("grp", "same").agg(F.first("vec").alias("vec"))
    both = lambda a, b: F.col(f"{a}.grp").eqNullSafe(F.col(f"{b}.grp")) & (F.col(f"{a}.same") == F.col(f"{b}.same"))
    reps = weights.alias("w").join(vectors.alias("v"), both("w", "v")).select("w.grp", "w.same", "w.id", "w.weight", "v.vec")
    large = stage(weights.groupBy("grp").count().filter(F.col("count") > block), "large")
    schema = f"grp {kind}, same bigint, cluster_id bigint, cosine double, degree double, cluster_size bigint"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        x, usable = unit_rows(np.stack(pdf["vec"]).astype(float))
        pdf = pdf[usable]
        order = np.argsort(pdf["id"].to_numpy())
        pdf, x, out = pdf.iloc[order], x[order], []
        weight = pdf["weight"].to_numpy()
        for rows, cos, degree in tight_sets(x, weight, tight):
            size = int(weight[rows].sum())
            out.append(pd.DataFrame({"grp": pdf["grp"].iloc[rows], "same": pdf["same"].iloc[rows], "cluster_id": pdf["id"].iloc[rows[0]], "cosine": cos, "degree": degree, "cluster_size": size}))
        return pd.concat(out) if out else pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])

    within = lambda how: reps.alias("r").join(large.alias("l"), F.col("r.grp").eqNullSafe(F.col("l.grp")), how).select("r.*")
    members = within("left_anti").groupBy("grp").applyInPandas(whole, schema)
    if large.limit(1).count():
        members = members.unionByName(_large_groups(unit_vectors(within("left_semi"), dims), dims, tight, block))
    found = members.alias("m").join(files.alias("w"), both("m", "w"))
    # staged, since what sorts the members reads them twice
    return stage(found.select(F.col("m.grp").alias(group), "m.cluster_id", F.col("w.id").alias(key), "m.cosine", "m.degree", "m.cluster_size"), "clusters")


def _places(reps: DataFrame, dims: int, tree: int, bits: int, keep: list[str]) -> DataFrame:
    """``keep`` columns with the leaf (signs beside random hyperplanes) and the place in it (a projection) of each vector, in a tree."""
    planes = np.random.default_rng(1000 + tree).normal(size=(dims, bits + 1))
    power = 1 << np.arange(bits, dtype=np.int64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _matrix(b.column("vec"), dims) @ planes
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array((s[:, :bits] > 0) @ power), pa.array(s[:, bits])], [*keep, "leaf", "along"])

    return reps.select(*dict.fromkeys([*keep, "vec"])).mapInArrow(local, ", ".join([f"{c} {_type(reps, c)}" for c in keep] + ["leaf bigint, along double"]))


def _with_group(reps: DataFrame) -> DataFrame:
    """``reps`` with g, a number of the group."""
    return reps.withColumn("g", F.xxhash64(F.coalesce(F.col("grp").cast("string"), F.lit("null")), F.col("grp").isNull()))


def _bits(n: int, block: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, n / block)))) + 1)


def _nearest(edges: DataFrame, name: str) -> DataFrame:
    """Staged edges (a, b, cos, new): of each record the best NEIGHBOURS, an edge told twice once."""
    once = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return stage(once.withColumn("_rank", rank).filter(F.col("_rank") <= NEIGHBOURS).drop("_rank"), name)


def neighbour_graph(reps: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b, cos) to the nearest records of cosine FLOOR or more of unit vectors (g, id, vec), within each g, over chunks.

    Every tree's leaves are taken in chunks of about ``block`` rows, however
    unequal the leaves are; the lists of all trees are merged, and neighbour
    descent goes on over all records.
    """
    n = reps.count()
    bits = _bits(n, block)
    placed = reduce(DataFrame.unionByName, (_places(reps, dims, t, bits, ["g", "id", "vec"]).withColumn("tree", F.lit(t)) for t in range(TREES)))
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * TREES * 4 // (block * 3)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, 2 * block):
            x, ids, g, tree = _matrix(table.column("vec"), dims), *(table.column(c).to_numpy() for c in ("id", "g", "tree"))
            cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (tree[1:] != tree[:-1])))
            for start, end in zip(cut, np.append(cut[1:], len(g))):
                a, b, w = links_of(x[start:end])
                own = ids[start:end]
                yield from pa.table({"a": np.append(own[a], own[b]), "b": np.append(own[b], own[a]), "cos": np.append(w, w), "new": np.ones(2 * len(a), bool)}).to_batches()

    leaves = placed.repartitionByRange(parts, "tree", "g", "leaf", "along").sortWithinPartitions("tree", "g", "leaf", "along")
    lists = _nearest(leaves.mapInArrow(local, "a bigint, b bigint, cos double, new boolean"), "neighbours")
    while lists.filter("new").count() > SETTLED * n * NEIGHBOURS:
        both = lists.select(F.col("a").alias("u"), F.col("b").alias("v"), "new").unionByName(lists.select(F.col("b").alias("u"), F.col("a").alias("v"), "new")).groupBy("u", "v").agg(F.max("new").alias("new"))
        some = F.row_number().over(W.partitionBy("u").orderBy(F.xxhash64("v", "u")))
        both = both.withColumn("_rank", some).filter(F.col("_rank") <= 2 * NEIGHBOURS)
        tried = both.alias("x").join(both.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v")) & (F.col("x.new") | F.col("y.new"))).select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct()
        near = dots(tried, reps.select(F.col("id").alias("a"), F.col("vec").alias("x")), reps.select(F.col("id").alias("b"), F.col("vec").alias("y")), dims).filter(F.col("cos") >= FLOOR)
        old = lists.withColumn("new", F.lit(False))
        more = _nearest(reduce(DataFrame.unionByName, [old, *(near.select(F.col(p).alias("a"), F.col(q).alias("b"), "cos", F.lit(True).alias("new")) for p, q in ("ab", "ba"))]), "neighbours")
        drop(lists)
        lists = more
    return lists.drop("new")


def dots(pairs: DataFrame, left: DataFrame, right: DataFrame, dims: int) -> DataFrame:
    """``pairs`` (a, b) with cos, the product of the vectors x of ``left`` (a, x) and y of ``right`` (b, y)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            cos = np.einsum("ij,ij->i", _matrix(t.column("x"), dims), _matrix(t.column("y"), dims))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(cos)], ["a", "b", "cos"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(local, "a bigint, b bigint, cos double")


def graph_communities(reps: DataFrame, edges: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """Rows (link, id, community) of the records with links, for each least cosine of LINKS: modularity over a graph of any size.

    Nodes lie in chunks by their leaves in a tree; each chunk moves its nodes
    by the gain in the whole graph's modularity, what they have in common
    becomes a node, and the next level's chunks follow another tree, until one
    chunk holds all or no tree's chunks join anything.
    """
    bits = _bits(reps.count(), block)
    group = reps.select(F.col("id").alias("a"), "g")
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("w")).join(group, "a")
    now = stage(once.withColumn("link", F.explode(F.array(*map(F.lit, LINKS)))).filter(F.col("w") >= F.col("link")).select("link", "g", "a", "b", "w"), "links")
    ends = lambda e: e.select("link", "g", F.col("a").alias("node")).unionByName(e.select("link", "g", F.col("b").alias("node"))).distinct()
    label = stage(ends(now).select("link", F.col("node").alias("id"), F.col("node").alias("community")), "labels")
    total = stage(now.groupBy("link", "g").agg((2 * F.sum("w")).alias("total")), "totals")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("link"), b.column("node"), pa.array(np.full(b.num_rows, chunk_number(), np.int32))], ["link", "node", "chunk"])

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (link, _), part in pdf.groupby(["link", "g"]):
            names = np.unique(np.append(part["a"], part["b"].dropna().astype("int64")))
            a, inside = np.searchsorted(names, part["a"]), part["b"].notna().to_numpy()
            b, w = np.searchsorted(names, part["b"].fillna(0).astype("int64")), part["w"].to_numpy()
            own = louvain(len(names), a[inside], b[inside], w[inside], np.bincount(a[~inside], w[~inside], len(names)), float(part["total"].iloc[0]))
            first = np.unique(own, return_index=True)[1]
            out.append(pd.DataFrame({"link": link, "node": names, "into": names[first][own]}))
        return pd.concat(out)

    level, quiet = 0, 0
    while quiet < TREES:
        nodes = stage(ends(now), "nodes")
        parts = -(-nodes.count() // (4 * block))
        placed = nodes.join(_places(reps, dims, level % TREES, bits, ["id"]).withColumnRenamed("id", "node"), "node")
        chunks = stage(placed.repartitionByRange(max(1, parts), "link", "g", "leaf", "along").select("link", "node").mapInArrow(number, "link double, node bigint, chunk int"), "chunks")
        named = lambda c: chunks.select("link", F.col("node").alias(c), F.col("chunk").alias(f"chunk_{c}"))
        cut = now.join(named("a"), ["link", "a"]).join(named("b"), ["link", "b"]).join(total, ["link", "g"])
        apart = F.col("chunk_a") != F.col("chunk_b")
        side = lambda p, other, chunk: cut.filter(apart if other is None else ~apart).select(F.col(chunk).alias("chunk"), "link", "g", F.col(p).alias("a"), (F.lit(None).cast("bigint") if other is None else F.col(other)).alias("b"), "w", "total")
        rows = reduce(DataFrame.unionByName, [side("a", "b", "chunk_a"), side("a", None, "chunk_a"), side("b", None, "chunk_b")])
        joined = stage(rows.groupBy("chunk").applyInPandas(move, "link double, node bigint, into bigint").filter(F.col("node") != F.col("into")), "moves")
        quiet = 0 if joined.limit(1).count() else quiet + 1
        if not quiet:
            into = lambda c: joined.select("link", F.col("node").alias(c), F.col("into").alias(f"into_{c}"))
            merged = now.join(into("a"), ["link", "a"], "left").join(into("b"), ["link", "b"], "left").select("link", "g", F.coalesce("into_a", "a").alias("p"), F.coalesce("into_b", "b").alias("q"), "w")
            after = stage(merged.groupBy("link", "g", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("w").alias("w")), "links")
            relabelled = stage(label.join(into("community"), ["link", "community"], "left").select("link", "id", F.coalesce("into_community", "community").alias("community")), "labels")
            for old in (now, label):
                drop(old)
            now, label = after, relabelled
        for old in (nodes, chunks, joined):
            drop(old)
        if parts <= 1:
            break
        level += 1
    return label


def _large_groups(reps: DataFrame, dims: int, tight: Tightness, block: int) -> DataFrame:
    """The members of clusters in groups that no single task takes: grp, same, cluster_id, cosine, degree, cluster_size."""
    reps = stage(_with_group(reps), "vectors")
    edges = neighbour_graph(reps, dims, block)
    label = graph_communities(reps, edges, dims, block)
    linked = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "adjacent")
    weight = reps.select("id", "weight")
    # a set's mark: sets with one mark are one
    mark = [F.sum(F.xxhash64("id").cast("decimal(38,0)")).cast("string").alias("mark"), F.count("*").alias("n"), F.min("id").alias("first")]
    by_mark = ["mark", "n", "first"]

    def distinct_sets(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        """Rows (s, id) of sets of enough files, each once and none of ``seen``; s is new."""
        sets = rows.join(weight, "id").groupBy("s").agg(*mark, F.sum("weight").alias("files")).filter(F.col("files") >= tight.least)
        kept = sets.groupBy(*by_mark).agg(F.min("s").alias("s"))
        kept = kept if seen is None else kept.join(seen, by_mark, "left_anti")
        return rows.join(kept.select("s"), "s")

    alone = reps.filter(F.col("weight") >= tight.least).select(F.xxhash64(F.lit(-1), "id").alias("s"), "id")
    sets = stage(distinct_sets(label.select(F.xxhash64("link", "community").alias("s"), "id").unionByName(alone), None), "sets")
    seen = stage(sets.groupBy("s").agg(*mark).select(*by_mark), "seen")
    done: list[DataFrame] = []

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            mean = _matrix(t.column("mean"), dims)
            cos = np.einsum("ij,ij->i", _matrix(t.column("vec"), dims), mean) / np.maximum(np.linalg.norm(mean, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([t.column("s"), t.column("id"), pa.array(cos)], ["s", "id", "cosine"])

    def means_of(rows: DataFrame) -> DataFrame:
        own = rows.join(reps.select("id", "g", "vec", "weight"), "id")
        return own.groupBy("s", "g").agg(F.array(*(F.sum(F.col("vec")[i] * F.col("weight")) for i in range(dims))).alias("mean"))

    def split(taken: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The s of sets that stay what they were, one for each mark, and of those that changed."""
        new, old = (x.groupBy("s").agg(*mark) for x in (taken, before))
        still = stage(new.join(old, ["s", *by_mark]).groupBy(*by_mark).agg(F.min("s").alias("s")).select("s"), "still")
        return still, new.join(old, ["s", *by_mark], "left_anti").select("s")

    def unmet(rows: DataFrame) -> DataFrame:
        """Staged sets of ``rows`` that were never met before; they are from now on."""
        nonlocal seen
        fresh = stage(distinct_sets(rows, seen), "sets")
        more = stage(seen.unionByName(fresh.groupBy("s").agg(*mark).select(*by_mark)), "seen")
        drop(seen)
        seen = more
        return fresh

    while sets.limit(1).count():
        settled = []
        while sets.limit(1).count():
            # first among the records linked to a set
            pool = sets.select("s", "id").unionByName(sets.join(linked, sets["id"] == linked["a"]).select("s", F.col("b").alias("id"))).distinct()
            scored = pool.join(reps.select("id", "vec"), "id").join(means_of(sets).drop("g"), "s").select("s", "id", "vec", "mean").mapInArrow(dot, "s bigint, id bigint, cosine double")
            taken = stage(scored.filter(F.col("cosine") >= tight.middle).select("s", "id"), "taken")
            still, moved = split(taken, sets)
            settled.append(taken.join(still, "s"))
            old, sets = sets, unmet(taken.join(moved, "s"))
            drop(old)
        # then among all records of the group: what stays there is settled
        before = stage(reduce(DataFrame.unionByName, settled), "settled")
        near = stage(_near(reps, stage(means_of(before), "means"), dims, tight.outer), "near")
        still, moved = split(near.filter(F.col("cosine") >= tight.middle).select("s", "id"), before)
        done.append(near.join(still, "s"))
        sets = unmet(near.filter(F.col("cosine") >= tight.middle).select("s", "id").join(moved, "s"))
    if not done:
        done = [reps.select(F.lit(0).cast("bigint").alias("s"), "id", F.lit(0.0).alias("cosine"), F.lit(0.0).alias("length")).limit(0)]
    close = stage(reduce(DataFrame.unionByName, done).join(reps.select("id", "grp", "same", "weight"), "id"), "close")
    stands = close.groupBy("s").agg(F.count_if(F.col("cosine") < tight.inner).alias("between"), F.min("id").alias("cluster_id"), F.sum("weight").cast("bigint").alias("cluster_size")).filter((F.col("between") == 0) & (F.col("cluster_size") >= tight.least))
    # sets that settled in different rounds may be one
    marks = close.groupBy("s").agg(*mark).join(stands, "s").groupBy(*by_mark).agg(F.min_by(F.struct("s", "cluster_id", "cluster_size"), "s").alias("of")).select("of.*")
    return close.join(marks, "s").select("grp", "same", "cluster_id", "cosine", (F.col("length") * F.col("cosine") - 1).alias("degree"), "cluster_size")


def _near(reps: DataFrame, means: DataFrame, dims: int, outer: float) -> DataFrame:
    """Rows (s, id, cosine, length) of the records of a set's group with the cosine ``outer`` or more to its mean (s, g, mean), ``length`` the mean's.

    The means, a stated set of queries, meet all records in blocks of about
    MEANS of them: each is a pass over the records without a shuffle.
    """
    sc = reps.sparkSession.sparkContext
    blocks = max(1, -(-means.count() // MEANS))
    found = []
    for block in range(blocks):
        rows = means.filter(F.pmod(F.xxhash64("s"), F.lit(blocks)) == block).select("s", "g", "mean").collect()
        groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in {r["g"] for r in rows}:
            m = np.array([r["mean"] for r in rows if r["g"] == g]).reshape(-1, dims)
            length = np.linalg.norm(m, axis=1)
            groups[g] = np.array([r["s"] for r in rows if r["g"] == g]), m / length[:, None], length
        held = sc.broadcast(groups)

        def local(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, g, ids = _matrix(b.column("vec"), dims), b.column("g").to_numpy(), b.column("id").to_numpy()
                for name in np.unique(g):
                    if name not in held.value:
                        continue
                    s, m, length = held.value[name]
                    own = np.flatnonzero(g == name)
                    for at in range(0, len(own), 1024):
                        rows = own[at : at + 1024]
                        cos = x[rows] @ m.T
                        i, j = np.nonzero(cos >= outer)
                        yield pa.RecordBatch.from_arrays([pa.array(s[j]), pa.array(ids[rows[i]]), pa.array(cos[i, j]), pa.array(length[j])], ["s", "id", "cosine", "length"])

        found.append(reps.select("g", "id", "vec").mapInArrow(local, "s bigint, id bigint, cosine double, length double"))
    return reduce(DataFrame.unionByName, found)


def neighbours_in_order(df: DataFrame, cluster: str, key: str) -> DataFrame:
    """Rows (first, second) of keys that follow each other in their cluster, by key; of distinct (cluster, key)."""
    rows = df.select(F.col(cluster).cast("bigint").alias("cluster"), F.col(key).cast("bigint").alias("key"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last = chunk_number(), None
        mark = lambda at, of: pa.table({"first": [at], "second": pa.nulls(1, pa.int64()), "cluster": [of], "chunk": pa.array([chunk], pa.int32())}).to_batches()
        for table in pieces(batches):
            cluster, key = table.column("cluster").to_numpy(), table.column("key").to_numpy()
            if last is None:
                yield from mark(int(key[0]), int(cluster[0]))
            else:
                cluster, key = np.append(last[0], cluster), np.append(last[1], key)
            together = cluster[1:] == cluster[:-1]
            first, second = key[:-1][together], key[1:][together]
            n = len(first)
            yield from pa.table({"first": first, "second": second, "cluster": pa.nulls(n, pa.int64()), "chunk": pa.nulls(n, pa.int32())}).to_batches()
            last = cluster[-1], key[-1]
        if last is not None:
            yield from mark(int(last[1]), int(last[0]))

    local_pairs = stage(range_chunks(rows, ["cluster"], "key", copies=False).mapInArrow(local, "first bigint, second bigint, cluster bigint, chunk int"), "pairs")
    by = W.partitionBy("cluster").orderBy("first", "chunk")
    ends = local_pairs.filter(F.col("chunk").isNotNull()).select("first", F.lead("first").over(by).alias("second"), "chunk", F.lead("chunk").over(by).alias("next"))
    return local_pairs.filter(F.col("chunk").isNull()).select("first", "second").unionByName(ends.filter(F.col("chunk") != F.col("next")).select("first", "second"))


def describe(members: DataFrame, group: str, key: str, typical: int = 3) -> DataFrame:
    """Of each cluster: group, cluster_id, cluster_size, least_cosine, and ``typical``: the keys of highest internal degree, ties by key."""
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc(F.round("degree", 6)), key))
    top = members.select("cluster_id", key, rank.alias("rank"), "degree").filter(F.col("rank") <= typical)
    top = top.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("k")))), lambda x: x["k"]).alias("typical"))
    return members.groupBy(group, "cluster_id", "cluster_size").agg(F.round(F.min("cosine"), 6).alias("least_cosine")).join(top, "cluster_id")
