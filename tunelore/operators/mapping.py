"""Mapping melodies onto a profile: targets by dynamic programming, register, rhythm, metrics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunelore.staging import stage

#: Profiles that one mapping takes at most.
MOST_PROFILES = 1000
#: Numbers that a step over several phrases takes at once, and those that its choices keep.
STATES, CHOICES = 1 << 17, 1 << 24

@dataclass
class Grammar:
    """The numbers that the dynamic programme needs, as arrays over degrees; built from a profile's JSON."""

    scale: tuple[int, ...]
    values: dict
    degree: np.ndarray
    interval: np.ndarray
    step: np.ndarray
    up: np.ndarray
    down: np.ndarray
    patterns: dict[int, np.ndarray] = field(default_factory=dict)
    cadences: dict[int, np.ndarray] = field(default_factory=dict)
    options: list[dict] = field(default_factory=list)


@lru_cache(maxsize=64)
def grammar_of(profile_json: str) -> Grammar:
    """The grammar of a profile (as JSON of a row with its defaults filled)."""
    p = json.loads(profile_json)
    g = p["grammar"]

    def vector(name: str, size: int) -> np.ndarray:
        out = np.zeros(size)
        for k, v in (g.get(name) or {}).items():
            if 0 <= int(k) < size:
                out[int(k)] = v
        return out

    def table(keys: dict[str, float], n: int) -> np.ndarray:
        out = np.zeros((12,) * n)
        for k, v in keys.items():
            at = tuple(int(x) % 12 for x in k.split(">"))
            if len(at) == n:
                out[at] += v
        return out

    def lists(name: str) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for x in g.get(name) or []:
            n = len(x["degrees"])
            if 2 <= n <= 5:
                out.setdefault(n, np.zeros((12,) * n))[tuple(d % 12 for d in x["degrees"])] += x["weight"]
        return out

    patterns = lists("preferred_phrases")
    patterns[3] = patterns.get(3, 0) + table(g.get("trigram_weights") or {}, 3)
    cadences = lists("cadence_patterns")
    cadences[1] = vector("cadence_degrees", 12)
    m = p.get("modulation") or {}
    return Grammar(
        tuple(p["scale"]), g, vector("degree_weights", 12), vector("interval_weights", 13), table(g.get("transition_weights") or {}, 2), table(g.get("ascending_transition_weights") or {}, 2), table(g.get("descending_transition_weights") or {}, 2),
        patterns, cadences, list(m.get("options") or []) if m.get("enabled") else [],
    )


def candidates(pitch: float, root: int, scale: tuple[int, ...], shift: float, most: int) -> np.ndarray:
    """Scale notes of 0..127 within ``shift`` of a pitch, the nearest first, the lower of equals; the nearest one if none is."""
    notes = np.array([n for n in range(128) if (n - root) % 12 in scale])
    away = np.abs(notes - pitch)
    order = np.argsort(away, kind="stable")
    near = order[away[order] <= shift][: max(1, most)]
    return notes[near if len(near) else order[:1]]


def map_phrase(pitches: list[float], root: int, scale: tuple[int, ...], g: Grammar, amount: float) -> tuple[list[int], float]:
    """The scale notes of the least cost for a phrase, and that cost.

    The state is the last few targets, as one axis of candidates each; a step
    adds an axis, and the oldest is minimised away once the longest pattern
    and cadence no longer need it.
    """
    v = g.values
    sets = [candidates(x, root, scale, v["candidate_shift_semitones"], v["candidate_count"]) for x in pitches]
    longest = max(3, *(n - 1 for n, t in g.patterns.items() if np.any(t)), 0)
    keep = min(4, longest)
    degrees = [(c - root) % 12 for c in sets]
    own = [v["pitch_deviation_weight"] * np.abs(c - x) - amount * g.degree[d] for c, d, x in zip(sets, degrees, pitches)]

    def spread(table: np.ndarray, axes: list[np.ndarray], rank: int) -> np.ndarray:
        """A pattern table at the last axes, shaped to broadcast over ``rank`` axes."""
        return table[np.ix_(*axes)].reshape((1,) * (rank - len(axes)) + tuple(map(len, axes)))

    cost = own[0]
    choices: list[np.ndarray | None] = [None]
    for t in range(1, len(pitches)):
        before, now, move = sets[t - 1], sets[t], pitches[t] - pitches[t - 1]
        out = now[None, :] - before[:, None].astype(float)
        pair = v["motion_preservation_weight"] * np.abs(out - move)
        pair += v["contour_penalty"] * ((abs(move) >= 0.5) & (np.abs(out) >= 0.5) & (np.sign(out) != np.sign(move)))
        leap = np.abs(out)
        pair += v["leap_penalty"] * np.maximum(0, leap - v["max_preferred_leap"])
        pair -= amount * g.interval[np.minimum(12, np.rint(leap).astype(int))]
        steps = g.step + (g.up if move > 0.35 else g.down if move < -0.35 else 0)
        pair -= amount * steps[np.ix_(degrees[t - 1], degrees[t])]
        rank = cost.ndim + 1
        full = cost[..., None] + own[t] + pair.reshape((1,) * (rank - 2) + pair.shape)
        for n, table in g.patterns.items():
            if n <= rank:
                full = full - amount * spread(table, degrees[t - n + 1 : t + 1], rank)
        if rank > keep:
            choices.append(full.argmin(0))
            cost = full.min(0)
        else:
            choices.append(None)
            cost = full
    end = cost.copy()
    for n, table in g.cadences.items():
        if n <= cost.ndim:
            end = end - amount * spread(table, degrees[len(pitches) - n :], cost.ndim)
    at = np.unravel_index(end.argmin(), end.shape)
    best = float(end[at])
    path = list(at)
    for t in range(len(pitches) - 1, -1, -1):
        if choices[t] is not None:
            path.insert(0, int(choices[t][tuple(path[:keep])]))
    return [int(s[i]) for s, i in zip(sets, path)], best


def _candidate_table(pitches: np.ndarray, roots: np.ndarray, scale: tuple[int, ...], shift: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``candidates`` of many (pitch, root): the notes of each as a row, the rest of it 0, and how many they are."""
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for root in np.unique(roots):
        at = np.flatnonzero(roots == root)
        pitch, back = np.unique(pitches[at], return_inverse=True)
        notes = np.array([n for n in range(128) if (n - root) % 12 in scale])
        width = min(max(1, most), len(notes))
        table, count = np.zeros((len(pitch), width), np.int64), np.zeros(len(pitch), np.int64)
        for low in range(0, len(pitch), 4096):
            away = np.abs(notes[None] - pitch[low : low + 4096, None])
            order = np.argsort(away, axis=1, kind="stable")[:, :width]
            near = np.take_along_axis(away, order, 1) <= shift
            count[low : low + 4096], table[low : low + 4096] = np.maximum(1, near.sum(1)), notes[order]
        found[int(root)] = at, table[back], count[back]
    counts = np.zeros(len(pitches), np.int64)
    out = np.zeros((len(pitches), max((x[1].shape[1] for x in found.values()), default=1)), np.int64)
    for at, table, count in found.values():
        out[at, : table.shape[1]], counts[at] = table, count
    return out, counts


def map_together(pitches: np.ndarray, notes: np.ndarray, counts: np.ndarray, roots: np.ndarray, g: Grammar, amount: float) -> tuple[np.ndarray, np.ndarray]:
    """``map_phrase`` of phrases of one length: targets (phrase, event) and costs.

    pitches (phrase, event); notes (phrase, event, candidate), of which the
    first ``counts`` (phrase, event) are candidates; roots (phrase). The same
    sums in the same order as ``map_phrase``, with the phrases as the last axis
    of every array; what is no candidate costs infinity.
    """
    v = g.values
    many, length = pitches.shape
    width = int(counts.max())
    c, x = np.ascontiguousarray(notes[:, :, :width].transpose(1, 2, 0)), np.ascontiguousarray(pitches.T)  # (event, candidate, phrase), (event, phrase)
    d = (c - roots) % 12
    own = v["pitch_deviation_weight"] * np.abs(c - x[:, None]) - amount * g.degree[d]
    own[np.arange(width)[None, :, None] >= counts.T[:, None]] = np.inf
    keep = min(4, max(3, *(n - 1 for n, t in g.patterns.items() if np.any(t)), 0))
    tables = [(n, amount * t) for n, t in g.patterns.items() if np.any(t)]

    def spread(n: int, table: np.ndarray, last: int, rank: int) -> np.ndarray:
        """A pattern table at the degrees of the last n events, shaped to broadcast over ``rank`` axes and the phrases."""
        at = d[last - n + 1].reshape(-1, *(1,) * (n - 1), many)
        for i in range(1, n):
            at = at * 12 + d[last - n + 1 + i].reshape(*(1,) * i, -1, *(1,) * (n - 1 - i), many)
        return table.ravel()[at].reshape(*(1,) * (rank - n), *at.shape)

    cost = own[0]
    choices: list[np.ndarray | None] = [None]
    for t in range(1, length):
        move = x[t] - x[t - 1]
        out = c[t][None] - c[t - 1][:, None].astype(float)
        leap = np.abs(out)
        pair = v["motion_preservation_weight"] * np.abs(out - move)
        pair += v["contour_penalty"] * ((np.abs(move) >= 0.5) & (leap >= 0.5) & (np.sign(out) != np.sign(move)))
        pair += v["leap_penalty"] * np.maximum(0, leap - v["max_preferred_leap"])
        pair -= amount * g.interval[np.minimum(12, np.rint(leap).astype(int))]
        before, now = d[t - 1][:, None], d[t][None]
        pair -= amount * (g.step[before, now] + np.where(move > 0.35, g.up[before, now], np.where(move < -0.35, g.down[before, now], 0)))
        rank = cost.ndim
        full = cost[..., None, :] + own[t]
        full += pair
        for n, table in tables:
            if n <= rank:
                full -= spread(n, table, t, rank)
        if rank > keep:
            cost, chosen = full[0].copy(), np.zeros(full.shape[1:], np.int8)
            for i in range(1, len(full)):
                chosen[full[i] < cost] = i
                np.minimum(cost, full[i], out=cost)
            choices.append(chosen)
        else:
            cost = full
            choices.append(None)
    end = cost
    for n, table in g.cadences.items():
        if n <= cost.ndim - 1 and np.any(table):
            end = end - spread(n, amount * table, length - 1, cost.ndim - 1)
    flat = end.reshape(-1, many)
    at = flat.argmin(0)
    each = np.arange(many)
    path = list(np.unravel_index(at, end.shape[:-1]))
    for t in range(length - 1, -1, -1):
        if choices[t] is not None:
            path.insert(0, choices[t][(*path[:keep], each)].astype(np.int64))
    return np.stack([c[t, i, each] for t, i in enumerate(path)], 1), flat[at, each]


def _map_all(pitches: np.ndarray, offsets: np.ndarray, roots: np.ndarray, scale: tuple[int, ...], g: Grammar, amount: float) -> tuple[np.ndarray, np.ndarray]:
    """The targets of phrases laid end to end, and each phrase's cost: phrases of one length and number of candidates are mapped together."""
    lengths = np.diff(offsets)
    notes, counts = _candidate_table(pitches, np.repeat(roots, lengths), scale, g.values["candidate_shift_semitones"], g.values["candidate_count"])
    widest = np.maximum.reduceat(counts, offsets[:-1])
    targets, costs = np.empty(len(pitches), np.int32), np.empty(len(lengths))
    order = np.lexsort((widest, lengths))
    changes = np.flatnonzero(np.diff(lengths[order]) | np.diff(widest[order])) + 1
    for like in np.split(order, changes):
        n, width = int(lengths[like[0]]), int(widest[like[0]])
        keep = min(4, max(3, *(m - 1 for m, t in g.patterns.items() if np.any(t)), 0))
        some = max(1, min(STATES // width ** min(n, keep + 1), CHOICES // (n * width ** min(n, keep))))
        for low in range(0, len(like), some):
            these = like[low : low + some]
            at = offsets[these][:, None] + np.arange(n)
            targets[at], costs[these] = map_together(pitches[at], notes[at], counts[at], roots[these], g, amount)
    return targets, costs


def map_phrases(phrased: DataFrame, profiles: DataFrame, amount: float = 1.0) -> DataFrame:
    """Every phrase mapped under every option of every profile: id, file_id, phrase, option (0: the base), name, root, scale, targets, cost.

    phrased: file_id, phrase, seq, source_midi, root. One phrase is one row
    to the kernel, which maps a batch's phrases of one length together;
    modulation's dependence on the phrase before is left to ``choose_options``,
    so all options of all phrases are mapped in parallel. Profiles are a stated
    set of at most MOST_PROFILES documents, which the kernel holds; events are
    not multiplied by them.
    """
    held = [(r["id"], r["profile"]) for r in profiles.select("id", F.to_json(F.struct("scale", "grammar", "modulation")).alias("profile")).orderBy("id").limit(MOST_PROFILES + 1).collect()]
    if len(held) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    schema = "id string, file_id bigint, phrase bigint, first_seq bigint, option int, name string, root int, scale array<int>, targets array<int>, cost double, switch_penalty double, n_events int"
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            notes = b.column("notes")
            pitches = notes.flatten().field("source_midi").cast(pa.float64()).to_numpy(zero_copy_only=False)
            bounds = np.append(0, np.cumsum(notes.value_lengths().to_numpy())).astype(np.int64)
            lengths, roots = np.diff(bounds), b.column("root").to_numpy().astype(np.int64)
            for name_of, document in held:
                g = grammar_of(document)
                tries = [(0, "base", 0, g.scale, 0.0, 0.0, 0)]
                tries += [(i, o["name"], o["root_offset"], tuple(o["scale"]) or g.scale, -amount * o["activation_bonus"], o["switch_penalty"], o["min_phrase_events"]) for i, o in enumerate(g.options, 1)]
                for i, name, offset, scale, extra, penalty, least in tries:
                    rows = np.flatnonzero(lengths >= least)
                    if not len(rows):
                        continue
                    n = lengths[rows]
                    ends = np.append(0, np.cumsum(n)).astype(np.int64)
                    mine = pitches[np.repeat(bounds[:-1][rows] - ends[:-1], n) + np.arange(ends[-1])]
                    r = (roots[rows] + offset) % 12 if i else roots[rows]
                    targets, cost = _map_all(mine, ends, r, scale, g, amount)
                    take = lambda c, rows=rows: b.column(c).take(pa.array(rows))
                    same = lambda x, kind, many=len(rows): pa.repeat(pa.scalar(x, kind), many)
                    scales = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(scale), pa.int32()), pa.array(np.tile(np.array(scale, np.int32), len(rows))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            same(name_of, pa.string()), take("file_id"), take("phrase"), take("first_seq"), same(i, pa.int32()), same(name, pa.string()), pa.array(r.astype(np.int32)), scales,
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(targets)), pa.array(cost + extra), same(float(penalty), pa.float64()), pa.array(n.astype(np.int32)),
                        ], names,
                    )

    notes = F.sort_array(F.collect_list(F.struct("seq", F.col("source_midi").cast("double").alias("source_midi"))))
    grouped = phrased.groupBy("file_id", "phrase").agg(F.min_by("root", "seq").cast("int").alias("root"), F.min("seq").cast("bigint").alias("first_seq"), notes.alias("notes"))
    return grouped.select(F.col("file_id").cast("bigint"), F.col("phrase").cast("bigint"), "root", "first_seq", "notes").mapInArrow(kernel, schema)


def choose_options(mapped: DataFrame) -> DataFrame:
    """The option of each phrase: the cheapest, a switch of root against the phrase before costing its penalty; of equals the first.

    Only options' costs, a few numbers a phrase, are walked through by file.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("options")
            lengths = lists.value_lengths().to_numpy()
            phrases, options, roots, costs, penalties = (lists.flatten().field(c).to_pylist() for c in ("phrase", "option", "root", "cost", "switch_penalty"))
            kept, totals, at = [], [], 0
            for n in lengths.tolist():
                end, before = at + n, roots[at] if n else None
                while at < end:
                    phrase, best, total = phrases[at], at, costs[at]
                    i = at + 1
                    while i < end and phrases[i] == phrase:
                        cost = costs[i] + (penalties[i] if roots[i] != before else 0.0)
                        # as argmin has it, a missing number is the least
                        if cost < total or (cost != cost and total == total):
                            best, total = i, cost
                        i += 1
                    kept.append(best)
                    totals.append(total)
                    before, at = roots[best], i
            whose = np.repeat(np.arange(b.num_rows), lengths)[kept] if kept else np.empty(0, np.int64)
            pick = lambda x, kind: pa.array([x[i] for i in kept], kind)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(whose)), b.column("file_id").take(pa.array(whose)), pick(phrases, pa.int64()), pick(options, pa.int32()), pa.array(totals, pa.float64())], ["id", "file_id", "phrase", "option", "total"])

    slim = mapped.groupBy("id", "file_id").agg(F.sort_array(F.collect_list(F.struct("phrase", "option", "root", "cost", "switch_penalty"))).alias("options"))
    chosen = slim.mapInArrow(walk, "id string, file_id bigint, phrase bigint, option int, total double")
    return mapped.join(chosen, ["id", "file_id", "phrase", "option"]).withColumn("cost", F.col("total")).drop("total", "switch_penalty")


def map_melodies(phrased: DataFrame, profiles: DataFrame, amount: float = 1.0) -> DataFrame:
    """Mapped events: id, file_id, phrase, seq, target, root, option name and scale."""
    chosen = choose_options(stage(map_phrases(phrased, profiles, amount), "mapped"))
    place = F.row_number().over(W.partitionBy("file_id", "phrase").orderBy("seq")) - 1
    notes = phrased.select("file_id", "phrase", "seq", "source_midi", "frames", "start_frame", "end_frame", place.alias("pos"))
    targets = chosen.select("id", "file_id", "phrase", "name", "root", "scale", F.posexplode("targets").alias("pos", "target"))
    return notes.join(targets, ["file_id", "phrase", "pos"]).drop("pos")


def register_shift(mapped: DataFrame, registers: DataFrame) -> DataFrame:
    """id, file_id, shift: the octave shift in -60..60 that brings a melody's register nearest to the profile's.

    mapped (id, file_id, target, frames); registers (id, median, p10, p90, the
    latter two may be null). The distance is that of the medians, plus 0.45 of
    what lies below p10 and above p90; a shift that leaves 0..127 is none, of
    equals the smaller wins. Without a possible shift it is 0.
    """
    from tunelore.operators.rhythm import weighted_quantiles

    by = ["id", "file_id"]
    q = weighted_quantiles(mapped, by, "target", "frames", {"q10": 0.10, "q50": 0.50, "q90": 0.90})
    ends = mapped.groupBy(*by).agg(F.min("target").alias("low"), F.max("target").alias("high"))

    def score(s: Column) -> Column:
        over = F.coalesce(0.45 * F.greatest(F.lit(0.0), F.col("p10") - (F.col("q10") + s)), F.lit(0.0)) + F.coalesce(0.45 * F.greatest(F.lit(0.0), (F.col("q90") + s) - F.col("p90")), F.lit(0.0))
        return F.abs(F.col("q50") + s - F.col("median")) + over + F.abs(s) * 1e-6

    tries = F.filter(F.sequence(F.lit(-60), F.lit(60), F.lit(12)), lambda s: (F.col("low") + s >= 0) & (F.col("high") + s <= 127))
    best = F.array_min(F.transform(tries, lambda s: F.struct(score(s).alias("score"), s.alias("shift"))))
    return q.join(ends, by).join(registers, "id").select(*by, F.coalesce(best["shift"], F.lit(0)).alias("shift"))


@dataclass(frozen=True)
class RhythmRule:
    """A profile's rhythm section, and how much of it is applied."""

    ratios: tuple[float, ...] = (0.5, 1.0, 2.0)
    quantize: float = 0.0
    multipliers: tuple[tuple[int, float], ...] = ()
    end: float = 1.0
    gap: float = 1.0
    max_change: float = 0.35
    preserve: bool = True
    amount: float = 1.0


def rhythm_rewrite(events: DataFrame, rule: RhythmRule) -> DataFrame:
    """file_id, phrase, seq, frames, gap, new_frames, new_gap: durations drawn to the preferred ratios and degree multipliers.

    events: file_id, phrase, seq, frames, start_frame, end_frame, degree (of
    the target). A phrase keeps its total length if the rule says so.
    """
    by = W.partitionBy("file_id", "phrase")
    order = by.orderBy("seq")
    a = rule.amount
    base = F.greatest(F.lit(1e-4), F.percentile("frames", F.lit(0.5)).over(by))
    rows = events.select("file_id", "phrase", "seq", "frames", "degree", F.coalesce(F.greatest(F.lit(0), F.lead("start_frame").over(order) - F.col("end_frame")), F.lit(0)).alias("gap"), base.alias("_base"), (F.lead("seq").over(order).isNull()).alias("_end"))
    ratio = F.col("frames") / F.col("_base")
    q = min(1.0, max(0.0, rule.quantize * a))
    away = F.transform(F.array(*map(F.lit, rule.ratios)), lambda r: F.abs(r - ratio))
    nearest = F.element_at(F.array(*map(F.lit, rule.ratios)), F.array_position(away, F.array_min(away)).cast("int"))
    drawn = F.col("_base") * ((1 - q) * ratio + q * nearest) if rule.ratios else F.col("frames").cast("double")
    factor = F.lit(1.0)
    for d, m in rule.multipliers:
        factor = F.when(F.col("degree") == d, 1 + a * (m - 1)).otherwise(factor)
    change = max(0.0, rule.max_change * a)
    bounded = F.least(F.col("frames") * (1 + change), F.greatest(F.col("frames") * max(0.1, 1 - change), drawn * factor))
    new = rows.withColumn("_new", bounded * F.when(F.col("_end"), 1 + a * (rule.end - 1)).otherwise(1.0)).withColumn("_gap", F.col("gap") * (1 + a * (rule.gap - 1)))
    scale = F.try_divide(F.sum(F.col("frames") + F.col("gap")).over(by), F.sum(F.col("_new") + F.col("_gap")).over(by)) if rule.preserve else F.lit(1.0)
    return new.withColumn("_s", F.coalesce(scale, F.lit(1.0))).select("file_id", "phrase", "seq", "frames", "gap", (F.col("_new") * F.col("_s")).alias("new_frames"), (F.col("_gap") * F.col("_s")).alias("new_gap"))


def mapping_metrics(mapped: DataFrame) -> DataFrame:
    """Of each (id, file_id): events, phrases, displacement, preservation of melody and contour, and scale compliance.

    mapped: id, file_id, phrase, seq, source_midi, target, root, scale, name.
    Compliance is 1 if every target is in its phrase's scale, else 0.
    """
    by = W.partitionBy("id", "file_id", "phrase").orderBy("seq")
    a, b = F.col("source_midi") - F.lag("source_midi").over(by), F.col("target") - F.lag("target").over(by)
    rows = mapped.withColumn("_d", F.abs(F.col("target") - F.col("source_midi"))).withColumn("_moves", (F.abs(a) >= 0.5) & (F.abs(b) >= 0.5)).withColumn("_same", F.signum(a) == F.signum(b)).withColumn("_in", F.array_contains("scale", F.pmod(F.col("target") - F.col("root"), F.lit(12))))
    out = rows.groupBy("id", "file_id").agg(
        F.count("*").alias("events"), F.countDistinct("phrase").alias("phrases"), F.countDistinct(F.when(F.col("name") != "base", F.col("phrase"))).alias("modulated_phrases"), F.avg("_d").alias("mean_displacement"), F.percentile("_d", F.lit(0.5)).alias("median_displacement"), F.max("_d").alias("max_displacement"),
        F.coalesce(F.try_divide(F.count_if(F.col("_moves") & F.col("_same")), F.count_if("_moves")), F.lit(1.0)).alias("contour_preservation"), F.min(F.col("_in").cast("int")).alias("scale_compliance"),
    )
    return out.withColumn("melody_preservation", F.exp(-F.col("mean_displacement") / 3.0))


def grammar_rewards(mapped: DataFrame, weights: DataFrame, longest: int = 8) -> DataFrame:
    """Of each (id, file_id), how well the targets follow the profile's grammar: five scores in 0..1, and phrase_hits.

    interval, transition, trigram and cadence scores are mean rewards over the
    profile's largest of that kind; grammar_score is their mean. Each place at
    which a preferred phrase ends is a hit and counts among the trigrams with
    its weight. A phrase's cadence is its last degree's weight and those of
    the patterns with which it ends. weights: the long form (id, kind, key,
    weight) of profiles, patterns of at most ``longest`` degrees.
    """
    by = W.partitionBy("id", "file_id", "phrase").orderBy("seq")
    whole = W.partitionBy("id", "file_id", "phrase")
    d = F.pmod(F.col("target") - F.col("root"), F.lit(12)).cast("string")
    # the degrees that end at a note: one, two, .. of them
    tails = [F.when(F.col(f"_deg{n - 1}").isNotNull(), F.concat_ws(">", *(f"_deg{i}" for i in range(n - 1, -1, -1)))) for n in range(1, longest + 1)]
    # each earlier degree is looked up once, however many tails it is in
    before = {f"_deg{i}": F.lag("_deg0", i).over(by) for i in range(1, longest)}
    rows = mapped.withColumn("_deg0", d).withColumns(before).select(
        "id", "file_id", F.least(F.lit(12), F.abs(F.col("target") - F.lag("target").over(by))).cast("string").alias("_iv"), F.array(*tails).alias("_tails"), (F.col("source_midi") - F.lag("source_midi").over(by)).alias("_delta"), (F.col("seq") == F.max("seq").over(whole)).alias("_last")
    )
    kinds = ("interval_weights", "transition_weights", "ascending_transition_weights", "descending_transition_weights", "trigram_weights", "preferred_phrases", "cadence_degrees", "cadence_patterns")
    maps = weights.groupBy("id").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("key", "weight")))).alias(k) for k in kinds))
    w = rows.join(maps, "id", "left")
    get = lambda m, k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0))
    one, pair, three = (F.col("_tails")[i] for i in range(3))
    step = get("transition_weights", pair) + F.when(F.col("_delta") > 0.35, get("ascending_transition_weights", pair)).when(F.col("_delta") < -0.35, get("descending_transition_weights", pair)).otherwise(0.0)
    top = lambda *ms: F.greatest(F.lit(0.0), *(F.coalesce(F.array_max(F.map_values(m)), F.lit(0.0)) for m in ms))
    held = lambda m: F.filter(F.transform("_tails", lambda t: F.try_element_at(F.col(m), t)), lambda x: x.isNotNull())
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    w = w.select(
        "id", "file_id", F.when(pair.isNotNull(), get("interval_weights", F.col("_iv"))).alias("i"), F.when(pair.isNotNull(), step).alias("t"), F.when(three.isNotNull(), get("trigram_weights", three)).alias("g"), F.coalesce(held("preferred_phrases"), F.array().cast("array<double>")).alias("_hits"),
        F.when(F.col("_last"), get("cadence_degrees", one) + F.coalesce(total(held("cadence_patterns")), F.lit(0.0))).alias("c"),
        top("interval_weights").alias("mi"), top("transition_weights", "ascending_transition_weights", "descending_transition_weights").alias("mt"), top("trigram_weights", "preferred_phrases").alias("mg"), top("cadence_degrees", "cadence_patterns").alias("mc"),
    )
    share = lambda mean, m: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(mean, F.max(m)), F.lit(0.0))))
    hits = F.sum(F.size("_hits"))
    out = w.groupBy("id", "file_id").agg(
        share(F.avg("i"), "mi").alias("interval_score"), share(F.avg("t"), "mt").alias("transition_score"), share(F.try_divide(F.coalesce(F.sum("g"), F.lit(0.0)) + F.sum(total(F.col("_hits"))), F.count("g") + hits), "mg").alias("trigram_score"), share(F.avg("c"), "mc").alias("cadence_score"), hits.alias("phrase_hits"),
    )
    return out.withColumn("grammar_score", (F.col("interval_score") + F.col("transition_score") + F.col("trigram_score") + F.col("cadence_score")) / 4)


def duration_metrics(rewritten: DataFrame, by: list[str], seconds_per_frame: float = 0.01) -> DataFrame:
    """Of each ``by``: the mean relative change of the notes' durations, and the output's duration in seconds.

    rewritten: frames, new_frames, new_gap of the notes; a gap follows its note.
    """
    change = F.abs(F.col("new_frames") - F.col("frames")) / F.greatest(F.col("frames").cast("double"), F.lit(1e-6))
    return rewritten.groupBy(*by).agg(F.avg(change).alias("mean_relative_duration_change"), (F.sum(F.col("new_frames") + F.col("new_gap")) * seconds_per_frame).alias("output_duration_s"))
