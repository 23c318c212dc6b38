"""Clustering of files: k-means, exact silhouettes in blocks, choice of k, refinement with roots and scales."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.operators import features, scales, tonic
from tunelore.staging import stage

#: Records of a block of the silhouette's distances.
BLOCK = 2048
#: Bytes of the points that a task may hold whole; more are passed over in batches.
MOST_HELD = 64 << 20
#: Runs of k-means from drawn starts, and rounds of each at most.
RESTARTS, MOST_ROUNDS = 24, 200
#: Restarts that one task runs, and records of a block that its passes and distances take at once.
RUNS, ROWS = 4, 1024
#: The penalty of each further cluster, and the least silhouette that more than one needs.
CLUSTER_PENALTY, LEAST_SILHOUETTE = 0.015, 0.08


def relabel(labels: DataFrame) -> DataFrame:
    """``labels`` (file_id, label) with labels numbered from 0 by size, the larger first, of equals the lower old label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    ranked = sizes.select("label", (F.row_number().over(W.orderBy(F.desc("n"), "label")) - 1).cast("int").alias("_new"))  # one row per label
    return labels.join(ranked, "label").select("file_id", F.col("_new").alias("label"))


def silhouettes(points: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """file_id, label, silhouette of points (file_id, label, feature), by Euclidean distance.

    A cluster of one record has an inner distance of 0. With one cluster, or as
    many as records, all are -1. Distances are summed by cluster block against
    block, so no pair of records ever becomes a row.
    """
    total, labels = points.count(), points.select("label").distinct().count()
    if labels < 2 or labels >= total:
        return points.select("file_id", "label", F.lit(-1.0).alias("silhouette"))
    blocks = -(-total // block)
    placed = points.withColumn("_b", F.pmod(F.xxhash64("file_id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # the other side's columns have names of their own, so that the two are never taken for one
    left, right = placed.withColumn("_o", every), placed.select(F.col("file_id").alias("id2"), F.col("feature").alias("feature2"), F.col("label").alias("label2"), F.col("_b").alias("_o2"), every.alias("_b2"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"file_id": [], "own": [], "label": [], "away": [], "n": []})
        x, y = np.stack(a["feature"]), np.stack(b["feature2"])
        square = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)
        square[a["file_id"].to_numpy()[:, None] == b["id2"].to_numpy()[None]] = 0
        names, where = np.unique(b["label2"], return_inverse=True)
        away = np.sqrt(square) @ np.eye(len(names))[where]
        n = np.bincount(where)
        return pd.DataFrame({"file_id": np.repeat(a["file_id"], len(names)), "own": np.repeat(a["label"], len(names)), "label": np.tile(names, len(a)), "away": away.ravel(), "n": np.tile(n, len(a))})

    parts = left.groupBy("_b", "_o").cogroup(right.groupBy("_b2", "_o2")).applyInPandas(sums, "file_id bigint, own int, label int, away double, n bigint")
    means = parts.groupBy("file_id", "own", "label").agg(F.sum("away").alias("away"), F.sum("n").alias("n"))
    means = means.withColumn("mean", F.when(F.col("own") == F.col("label"), F.coalesce(F.try_divide("away", F.col("n") - 1), F.lit(0.0))).otherwise(F.col("away") / F.col("n")))
    ab = means.groupBy("file_id", F.col("own").alias("label")).agg(F.max(F.when(F.col("own") == F.col("label"), F.col("mean"))).alias("a"), F.min(F.when(F.col("own") != F.col("label"), F.col("mean"))).alias("b"))
    return ab.select("file_id", "label", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def _over_points(points: DataFrame, schema: str, of) -> list:
    """Rows that ``of`` makes of each batch's (file_ids, matrix), gathered: a few for each of the restarts, never one for each point."""
    names = [x.split()[0] for x in schema.split(", ")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("feature").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                columns = of(b.column("file_id").to_numpy(), x)
                yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, list) else pa.array(c, pa.list_(pa.float64())) for c in columns], names)

    return points.select("file_id", "feature").mapInArrow(local, schema)


def _draw(seed: int, restart: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each restart (row) and id (column), the same wherever it is asked for."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64)[None] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) + restart.astype(np.uint64)[:, None] * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-17


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (restart, point, centre) of points to each restart's centres."""
    return np.maximum((x * x).sum(1)[None, :, None] + (centres * centres).sum(2)[:, None, :] - 2 * np.einsum("nd,rkd->rnk", x, centres), 0)


def _starts(points: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """Starting centres (restart, centre, number): each further one drawn with a probability in proportion to the squared distance from those before it."""
    chosen: np.ndarray | None = None
    which = np.arange(restarts)
    for step in range(k):

        def of(ids: np.ndarray, x: np.ndarray, chosen=chosen, step=step) -> tuple:
            away = np.ones((restarts, len(x))) if chosen is None else _squares(x, chosen).min(2)
            # the least of these keys falls on a point with a probability in proportion to its distance
            key = -np.log(_draw(seed + 7919 * step, which, ids)) / np.maximum(away, 1e-12)
            best = key.argmin(1)
            return which, key[which, best], x[best].tolist()

        rows = _over_points(points, "restart bigint, key double, at array<double>", of).groupBy("restart").agg(F.min_by("at", "key").alias("at")).collect()
        new = np.array([r["at"] for r in sorted(rows, key=lambda r: r["restart"])])[:, None]
        chosen = new if chosen is None else np.concatenate([chosen, new], 1)
    return chosen


@dataclass(frozen=True)
class Held:
    """Points that every task may hold: their numbers as rows of a matrix, by file_id, and the same as a broadcast."""

    spark: SparkSession
    ids: np.ndarray
    x: np.ndarray
    sent: Broadcast


def hold(points: DataFrame, most: int | None = None) -> Held | None:
    """``points`` (file_id, feature) as a matrix, if they are no more than ``most`` bytes."""
    most = MOST_HELD if most is None else most
    size = points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("feature")), F.lit(0)).alias("dims")).first()
    if not size["n"] or size["n"] * (size["dims"] + 1) * 8 > most:
        return None
    told = points.select("file_id", "feature").toArrow().combine_chunks()
    ids = told.column("file_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in told.column("feature").chunks]).reshape(len(ids), -1)[order]
    ids = ids[order]
    return Held(points.sparkSession, ids, x, points.sparkSession.sparkContext.broadcast((ids, x)))


def _lloyd(ids: np.ndarray, x: np.ndarray, k: int, which: np.ndarray, seed: int, most_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and centres (restart, centre, number) of the restarts ``which``, from drawn starts: what the passes of ``kmeans`` come to, over one matrix."""
    square = (x * x).sum(1)
    starts = np.empty((len(which), k, x.shape[1]))
    away = np.ones((len(which), len(x)))
    for step in range(k):
        at = (-np.log(_draw(seed + 7919 * step, which, ids)) / np.maximum(away, 1e-12)).argmin(1)
        starts[:, step] = x[at]
        near = np.maximum(square[None] + (starts[:, step] ** 2).sum(1)[:, None] - 2 * starts[:, step] @ x.T, 0)
        away = near if step == 0 else np.minimum(away, near)
    centres, inertia, going = starts, np.full(len(which), np.inf), np.arange(len(which))
    for _ in range(most_rounds):
        now = centres[going]
        flat, runs = now.reshape(-1, x.shape[1]), len(going)
        own = (flat * flat).sum(1)
        sums, n, cost = np.zeros_like(flat), np.zeros(len(flat)), np.zeros(runs)
        furthest, far = np.full(runs, -1.0), np.zeros(runs, np.int64)
        first = np.arange(runs) * k
        for low in range(0, len(x), ROWS):
            some = x[low : low + ROWS]
            d = np.maximum((square[low : low + ROWS, None] + own[None] - 2 * some @ flat.T), 0).reshape(len(some), runs, k)
            at = d.argmin(2)
            least = np.take_along_axis(d, at[:, :, None], 2)[:, :, 0]
            one = np.zeros((len(some), len(flat)))
            np.put_along_axis(one, at + first, 1.0, 1)
            sums += one.T @ some
            n += one.sum(0)
            cost += least.sum(0)
            most = least.argmax(0)
            beyond = least[most, np.arange(runs)] > furthest
            furthest[beyond], far[beyond] = least[most, np.arange(runs)][beyond], low + most[beyond]
        after = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], np.repeat(x[far], k, 0)).reshape(now.shape)
        inertia[going] = cost
        still = np.array([np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(after, now)])
        centres[going] = after
        going = going[~still]
        if not len(going):
            break
    return inertia, centres


def _best_of_held(held: Held, tries: list[tuple[int, int]], restarts: int, most_rounds: int) -> list[np.ndarray]:
    """The centres of the best restart for each (k, seed): a task runs a few restarts to their end, so all take one job."""
    jobs = [(i, which) for i in sorted(range(len(tries)), key=lambda i: -tries[i][0]) for which in np.array_split(np.arange(restarts), -(-restarts // RUNS))]
    sent = held.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        for b in batches:
            for j in b.column("id").to_pylist():
                i, which = jobs[j]
                inertia, centres = _lloyd(ids, x, tries[i][0], which, tries[i][1], most_rounds)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(which), pa.int64()), pa.array(which, pa.int64()), pa.array(inertia), pa.array(centres.reshape(len(which), -1).tolist(), pa.list_(pa.float64()))], ["i", "restart", "squares", "centres"])

    rows = held.spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "i bigint, restart bigint, squares double, centres array<double>").groupBy("i").agg(F.min_by("centres", F.struct("squares", "restart")).alias("centres")).collect()
    return [np.array(r["centres"]).reshape(tries[r["i"]][0], -1) for r in sorted(rows, key=lambda r: r["i"])]


def _labels(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[low : low + ROWS], centres[None])[0].argmin(1) for low in range(0, len(x), ROWS)])


def _ranks(labels: np.ndarray, k: int) -> np.ndarray:
    """New numbers of k labels by size, as ``relabel`` gives them; labels without records come last."""
    out = np.empty(k, np.int64)
    out[np.lexsort((np.arange(k), -np.bincount(labels, minlength=k)))] = np.arange(k)
    return out


def _mean_silhouettes(held: Held, labelings: list[np.ndarray]) -> list[float]:
    """Mean silhouettes of several labelings, whose distances are taken once: blocks of records against all."""
    n = len(held.ids)
    widths = [int(x.max()) + 1 for x in labelings]
    tall = [low for low in range(0, n, ROWS)]
    tasks = min(len(tall), 96)
    sent, labels = held.sent, held.spark.sparkContext.broadcast(np.stack(labelings).astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, named = sent.value[1], labels.value
        square = (x * x).sum(1)
        one = np.concatenate([np.eye(w)[l] for l, w in zip(named, widths)], 1)
        sizes = one.sum(0)
        for b in batches:
            for low in (tall[i] for t in b.column("id").to_pylist() for i in range(t, len(tall), tasks)):
                some = x[low : low + ROWS]
                away = np.zeros((len(some), one.shape[1]))
                for at in range(0, n, ROWS):
                    d = some @ x[at : at + ROWS].T
                    d *= -2
                    d += square[low : low + ROWS, None]
                    d += square[None, at : at + ROWS]
                    np.maximum(d, 0, out=d)
                    if at == low:
                        np.fill_diagonal(d, 0)
                    away += np.sqrt(d, out=d) @ one[at : at + ROWS]
                first = 0
                for i, w in enumerate(widths):
                    total, n_of, own = away[:, first : first + w], sizes[first : first + w], named[i, low : low + ROWS]
                    each = np.arange(len(some))
                    a = np.where(n_of[own] > 1, total[each, own] / np.maximum(n_of[own] - 1, 1), 0)
                    other = total / n_of
                    other[each, own] = np.inf
                    b_ = other.min(1)
                    top = np.maximum(a, b_)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([float(np.where(top > 0, (b_ - a) / np.where(top > 0, top, 1), 0).sum())])], ["i", "total"])
                    first += w

    rows = held.spark.range(0, tasks, 1, tasks).mapInArrow(run, "i bigint, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    labels.destroy()
    return [r["total"] / n for r in sorted(rows, key=lambda r: r["i"])]


def _clustered(points: DataFrame, centres: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """file_id, label, feature: points with the number of their nearest centre."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("feature").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, centres.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(ranks[_labels(x, centres)].astype(np.int32)) if len(x) else pa.array([], pa.int32()), b.column("feature")], ["file_id", "label", "feature"])

    return stage(points.select("file_id", "feature").mapInArrow(labelled, "file_id bigint, label int, feature array<double>"), "clustered")


def kmeans(points: DataFrame, k: int, seed: int = 1479, restarts: int = RESTARTS, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """file_id, label, feature: clusters of points (file_id, feature), larger ones first.

    Of ``restarts`` runs from drawn starts the one of the least sum of squared
    distances. A centre without points moves to the point that is farthest from
    its centre. A run ends when its labels stay, or after ``most_rounds``.
    Points that a task can hold are sent to tasks of a few runs each. Of more
    points all runs take each pass together: a task hands on sums for each run
    and centre.
    """
    if held := hold(points):
        best = _best_of_held(held, [(k, seed)], restarts, most_rounds)[0]
        held.sent.destroy()
        return _clustered(points, best, _ranks(_labels(held.x, best), k))
    centres = _starts(points, k, restarts, seed)
    going = np.arange(restarts)
    inertia = np.full(restarts, np.inf)
    for _ in range(most_rounds):

        def of(ids: np.ndarray, x: np.ndarray, now=centres[going], names=going) -> tuple:
            d = _squares(x, now)
            near, least = d.argmin(2), d.min(2)
            one = near[:, :, None] == np.arange(k)
            sums = np.einsum("rnk,nd->rkd", one.astype(float), x)
            far = least.argmax(1)
            rows = len(names) * k
            return (
                np.repeat(names, k), np.tile(np.arange(k), len(names)), one.sum(1).ravel(), (least[:, :, None] * one).sum(1).ravel(), np.repeat(least[np.arange(len(names)), far], k), sums.reshape(rows, -1).tolist(), np.repeat(x[far], k, 0).tolist(),
            )

        told = _over_points(points, "restart bigint, centre bigint, n bigint, squares double, away double, total array<double>, far array<double>", of)
        dims = centres.shape[2]
        rows = told.groupBy("restart", "centre").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.array(*(F.sum(F.col("total")[i]) for i in range(dims))).alias("total"), F.max_by("far", "away").alias("far")).collect()
        after = centres.copy()
        cost = np.zeros(restarts)
        for r in rows:
            after[r["restart"], r["centre"]] = np.array(r["total"]) / r["n"] if r["n"] else r["far"]
            cost[r["restart"]] += r["squares"]
        inertia[going] = cost[going]
        still = np.array([np.allclose(after[g], centres[g], rtol=1e-9, atol=1e-12) for g in going])
        centres = after
        going = going[~still]
        if not len(going):
            break
    best = centres[int(inertia.argmin())]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("feature").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, best.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(_squares(x, best[None])[0].argmin(1).astype(np.int32))], ["file_id", "label"])

    labels = stage(points.select("file_id", "feature").mapInArrow(labelled, "file_id bigint, label int"), "labels")
    return stage(points.join(relabel(labels), "file_id").select("file_id", "label", "feature"), "clustered")


def choose_clusters(points: DataFrame, dims: int, most: int = 5, least_files: int = 4, seed: int = 1479) -> tuple[DataFrame, list[dict]]:
    """Points with the labels of the best k, and the figures of each k tried.

    k runs from 2 to ``most``, or as many clusters of ``least_files`` as fit; a
    k with a smaller cluster is rejected. The best mean silhouette less a
    penalty per cluster wins; below a least silhouette all files are one
    cluster.
    """
    total = points.count()
    tried, best = [], None
    ks = range(2, min(most, total // max(1, least_files)) + 1)
    if ks and (held := hold(points)):
        return _choose_of_held(points, held, ks, least_files, seed)
    for k in ks:
        found = kmeans(points, k, seed)
        smallest = found.groupBy("label").count().agg(F.min("count")).first()[0]
        if smallest < least_files:
            tried.append({"k": k, "rejected": True})
            continue
        score = silhouettes(found, dims).agg(F.avg("silhouette")).first()[0]
        tried.append({"k": k, "rejected": False, "silhouette": score, "adjusted": score - CLUSTER_PENALTY * (k - 2)})
        if best is None or tried[-1]["adjusted"] > best[0]:
            best = (tried[-1]["adjusted"], score, found)
    if best is None or best[1] < LEAST_SILHOUETTE:
        return points.withColumn("label", F.lit(0)).select("file_id", "label", "feature"), tried
    return best[2], tried


def _choose_of_held(points: DataFrame, held: Held, ks: range, least_files: int, seed: int) -> tuple[DataFrame, list[dict]]:
    """``choose_clusters`` of points that a task can hold: the runs of every k in one job, the silhouettes of every k in another."""
    found = dict(zip(ks, _best_of_held(held, [(k, seed) for k in ks], RESTARTS, MOST_ROUNDS)))
    named = {k: _labels(held.x, c) for k, c in found.items()}
    # clusters without records are none, as where rows are counted
    right = [k for k in ks if min(n for n in np.bincount(named[k]) if n) >= least_files]
    dense = [np.unique(named[k], return_inverse=True)[1] for k in right]
    many = [i for i, x in enumerate(dense) if 1 < x.max() + 1 < len(x)]
    scores = dict.fromkeys(right, -1.0) | ({right[i]: s for i, s in zip(many, _mean_silhouettes(held, [dense[i] for i in many]))} if many else {})
    held.sent.destroy()
    tried = [{"k": k, "rejected": False, "silhouette": scores[k], "adjusted": scores[k] - CLUSTER_PENALTY * (k - 2)} if k in scores else {"k": k, "rejected": True} for k in ks]
    kept = [t for t in tried if not t["rejected"]]
    best = max(kept, key=lambda t: t["adjusted"]) if kept else None
    if best is None or best["silhouette"] < LEAST_SILHOUETTE:
        return points.withColumn("label", F.lit(0)).select("file_id", "label", "feature"), tried
    k = best["k"]
    return _clustered(points, found[k], _ranks(named[k], k)), tried


def align(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """``after`` (file_id, label) renamed so that most files keep their label of ``before``; a k x k table is all that is gathered."""
    table = np.zeros((k, k), int)
    both = before.select("file_id", F.col("label").alias("a")).join(after.select("file_id", F.col("label").alias("b")), "file_id")
    for r in both.groupBy("a", "b").count().collect():
        table[r["a"], r["b"]] = r["count"]
    best = max(permutations(range(k)), key=lambda p: sum(table[p[b], b] for b in range(k)))
    names = F.array(*(F.lit(int(x)) for x in best))
    return after.withColumn("label", F.element_at(names, F.col("label") + 1))


def refine(events: DataFrame, iterations: int = 6, most: int = 5, least_files: int = 4, seed: int = 1479) -> tuple[DataFrame, list[dict]]:
    """file_id, label, root after alternating clusters, scales and roots to a fixpoint; and the history.

    events: phrased events with pc. Roots begin as the generic estimate, the
    number of clusters is chosen once; each iteration infers the clusters'
    scales, estimates roots with them, and clusters the new features. Events
    are read once, for each file's histograms over pitch classes, which a root
    only turns; the state between iterations is one staged row per file.
    """
    counts = features.file_counts(events, "pc").withColumnsRenamed({"degree": "by_pc", "cadence": "ends_by_pc"})
    files = stage(counts.join(tonic.occupancy(events), "file_id"), "counts")

    def with_features(roots: DataFrame) -> DataFrame:
        """file_id, root, feature."""
        known = files.join(roots.select("file_id", "root"), "file_id").withColumns({"degree": features.turned("by_pc", F.col("root")), "cadence": features.turned("ends_by_pc", F.col("root"))})
        return stage(known.select("file_id", "root").join(features.vectors(known), "file_id"), "features")

    state = with_features(tonic.generic_roots_of(files))
    found, history = choose_clusters(state.select("file_id", "feature"), features.DIMS, most, least_files, seed)
    labels = stage(found.select("file_id", "label"), "labels")
    k = labels.agg(F.max("label")).first()[0]
    k = 1 if k is None else k + 1
    for i in range(iterations):
        known = files.join(state.select("file_id", "root"), "file_id").join(labels.withColumnRenamed("label", "cluster_id"), "file_id").withColumn("degree", features.turned("by_pc", F.col("root")))
        sums = known.groupBy("cluster_id").agg(*(F.sum(F.col("degree")[d]).alias(f"d{d}") for d in range(12)))
        core = stage(scales.core_scale(scales.shares_of(stage(sums, "sums"))), "scales")
        new_state = with_features(tonic.roots_of(known, core))
        new = labels if k == 1 else stage(align(labels, kmeans(new_state.select("file_id", "feature"), k, seed + 7919 * (i + 1)).select("file_id", "label"), k), "labels")
        both = new.alias("a").join(labels.alias("b"), "file_id").join(new_state.select("file_id", F.col("root").alias("new_root")), "file_id").join(state.select("file_id", "root"), "file_id")
        moved, turned = both.agg(F.count_if(F.expr("a.label <> b.label")), F.count_if(F.col("new_root") != F.col("root"))).first()
        history.append({"iteration": i + 1, "labels_changed": moved, "roots_changed": turned})
        state, labels = new_state, new
        if not moved and not turned:
            break
    return labels.join(state.select("file_id", "root"), "file_id"), history
