"""Ordered operators over a file's frames or notes that no window expresses.

Each is a plain function on arrays and a grouped form on tables; one recording
is one group. They take pitch tracks, posteriors or notes as tables.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelore.operators.runs import pieces
from tunelore.operators.segments import REST

#: The path decoder's rewards and costs.
ENTER, STAY, STAY_MORE = 2.25, 2.15, 0.025
REST_REWARD = (0.28, 0.055, 0.008)
FIRST_REST_REWARD = (0.28, 0.07, 0.01)
REST_CHANGE, OCTAVE_COST, BEAM = 0.16, 0.55, 16


class RunningMedian:
    """The median of values as they are added."""

    def __init__(self, first: float):
        self.values = [first]

    def add(self, x: float) -> None:
        bisect.insort(self.values, x)

    def __float__(self) -> float:
        n = len(self.values)
        return (self.values[(n - 1) // 2] + self.values[n // 2]) / 2


def frames_to_events(midi: np.ndarray, onsets: set[int], change: float = 0.8, retrigger: int = 1, least: int = 2) -> list[tuple[int, int, float]]:
    """Events (start, end, median pitch) of a pitch track whose missing frames are NaN.

    A new event begins where the pitch leaves the running median of the
    current one by ``change``, or at an onset once the current one is
    ``retrigger`` frames old. Events shorter than ``least`` frames then join
    the neighbour of the nearer pitch, the first such one first.
    """
    events: list[list] = []
    median = None
    for i, x in enumerate(midi.tolist()):
        if x != x or abs(x) == float("inf"):
            median = None
        elif median is None or abs(x - float(median)) >= change or (i in onsets and i - events[-1][0] >= retrigger):
            median = RunningMedian(x)
            events.append([i, i + 1, median])
        else:
            median.add(x)
            events[-1][1] = i + 1
    out = [[s, e, float(m)] for s, e, m in events]
    at = 0
    while at < len(out) and len(out) > 1:
        start, end, pitch = out[at]
        if end - start >= max(1, least):
            at += 1
            continue
        into_next = at == 0 or (at + 1 < len(out) and abs(pitch - out[at - 1][2]) > abs(pitch - out[at + 1][2]))
        if into_next:
            out[at + 1][0] = start
        else:
            out[at - 1][1] = end
        del out[at]
        # only what was just lengthened can have changed; all before it is long enough
        at = max(0, at - 1)
    return [tuple(x) for x in out]


def change_costs(states: np.ndarray) -> np.ndarray:
    """Costs of going from each state (row) to each (column): small steps are cheap, octaves dear."""
    away = np.abs(states[:, None] - states[None, :])
    cost = np.select([away == 0, away <= 2, away <= 5], [0.0, 0.035 * away, 0.09 * away], 0.45 + 0.08 * (away - 5))
    cost = cost + OCTAVE_COST * np.isin(away, (12, 24))
    rest = states == REST
    cost[rest, :] = cost[:, rest] = REST_CHANGE
    cost[np.ix_(rest, rest)] = 0.0
    return cost


def frame_viterbi(grid: np.ndarray, enter: float = 0.08, stay: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best one-line path through a posterior (pitches x frames), and its salience.

    A pitch is entered at ``enter`` and held down to ``stay`` (half of it by
    default). A frame offers its strongest BEAM pitches and rest.
    """
    stay = max(0.0, enter / 2) if stay is None else stay
    pitches, frames = grid.shape
    costs = change_costs(np.append(np.arange(pitches), REST) if pitches < REST else np.arange(pitches + 1))
    rest = pitches
    before_states, before, back = np.zeros(0, int), np.zeros(0), []
    for t in range(frames):
        column = grid[:, t]
        states = np.flatnonzero(column >= stay)
        if len(states) > BEAM:
            states = states[np.argsort(-column[states], kind="stable")[:BEAM]]
        states = np.append(states, rest)
        value = np.append(column[states[:-1]], 0.0)
        peak = column.max() if pitches else 0.0
        level = 0 if peak < stay else 1 if peak < enter else 2
        if t == 0:
            score = np.where(value >= enter, ENTER * value, -np.inf)
            score[-1] = FIRST_REST_REWARD[level]
            back.append((states, np.full(len(states), -1)))
        else:
            same = before_states[:, None] == states[None, :]
            gain = np.where(same, STAY * value + STAY_MORE, np.where(value >= enter, ENTER * value, -np.inf))
            gain[:, -1] = REST_REWARD[level]
            total = before[:, None] + gain - costs[np.ix_(before_states, states)]
            best = total.argmax(0)
            score = total[best, np.arange(len(states))]
            back.append((states, best))
        before_states, before = states, score
    path = np.full(frames, REST)
    at = int(before.argmax()) if frames else 0
    for t in range(frames - 1, -1, -1):
        states, came = back[t]
        path[t] = REST if states[at] == rest else states[at]
        at = int(came[at])
    return path, np.array([0.0 if s == REST else grid[s, t] for t, s in enumerate(path.tolist())])


def spaced_best(places: list[int], gains: list[float], apart: int) -> list[int]:
    """Places at least ``apart`` from each other with the largest sum of positive gains."""
    best, took = [0.0], []
    for k, (p, g) in enumerate(zip(places, gains)):
        before = bisect.bisect_right(places, p - apart, 0, k)
        took.append(before if g > 0 and best[before] + g > best[-1] else None)
        best.append(best[-1] if took[-1] is None else best[before] + g)
    chosen, k = [], len(places)
    while k:
        if took[k - 1] is None:
            k -= 1
        else:
            chosen.append(places[k - 1])
            k = took[k - 1]
    return chosen[::-1]


def retrigger_boundaries(path: np.ndarray, onset: np.ndarray, salience: np.ndarray, apart: int, threshold: float = 0.4, tolerance: int = 0, penalty: float = 0.15, dip_frames: int = 4, least_dip: float = 0.15, strong: float = 0.25) -> list[int]:
    """Frames where a held pitch is struck again.

    Candidates are peaks of the onset curve above the threshold that leave
    ``apart`` frames on both sides; weak ones need a dip of the salience before
    them. Of the candidates of a run the best spaced ones are taken.
    """
    out: list[int] = []
    cuts = np.flatnonzero(np.diff(path)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(path)]):
        if b <= a or path[a] == REST or b - a < 2 * apart + 1:
            continue
        rows = slice(max(0, path[a] - tolerance), min(127, path[a] + tolerance) + 1)
        o, s = onset[rows, a:b].max(0), salience[rows, a:b].max(0)
        places, gains = [], []
        for i in range(max(1, apart), min(b - a - 1, b - a - apart + 1)):
            if o[i] < threshold or o[i] < o[i - 1] or o[i] < o[i + 1]:
                continue
            floor, level = np.percentile(s[max(0, i - dip_frames) : i], [20, 75])
            after = np.percentile(s[i : i + max(2, dip_frames // 2)], 75)
            top = max(1e-6, level, after, s[i])
            dip = min(1.0, max(0.0, (top - floor) / top))
            is_strong = o[i] >= threshold + strong
            if not is_strong and dip < least_dip:
                continue
            gain = (o[i] - threshold) / max(1e-6, 1 - threshold) + 0.24 * min(1.0, max(0.0, (dip - least_dip) / max(1e-6, 1 - least_dip))) + 0.10 * is_strong - penalty
            places.append(a + i)
            gains.append(float(gain))
        out += spaced_best(places, gains, apart)
    return out


def clean_fragments(notes: list[tuple[float, float, int, float]], longest: float = 0.07, confidence: float = 0.5, near: int = 2) -> list[tuple[float, float, int, float]]:
    """Notes (start, end, pitch, confidence) without short, unsure fragments, to a fixpoint.

    First a fragment between two notes of one pitch near it is absorbed, the
    earliest one; only when there is none, the earliest pair of neighbours of
    one pitch is joined of which one is such a fragment.
    """
    work = list(notes)

    def unsure(n) -> bool:
        return n[1] - n[0] <= longest and n[3] <= confidence

    def joined(a, b):
        wa, wb = max(1e-6, a[1] - a[0]), max(1e-6, b[1] - b[0])
        return (a[0], b[1], a[2], (a[3] * wa + b[3] * wb) / (wa + wb))

    while True:
        at = next((i for i in range(1, len(work) - 1) if unsure(work[i]) and work[i - 1][2] == work[i + 1][2] and abs(work[i][2] - work[i - 1][2]) <= near), None)
        if at is not None:
            work[at - 1 : at + 2] = [joined(work[at - 1], work[at + 1])]
            continue
        at = next((i for i in range(len(work) - 1) if work[i][2] == work[i + 1][2] and (unsure(work[i]) or unsure(work[i + 1]))), None)
        if at is None:
            return work
        work[at : at + 2] = [joined(work[at], work[at + 1])]


# the grouped forms


def events_of_tracks(track: DataFrame, change: float = 0.8, retrigger: int = 1, least: int = 2) -> DataFrame:
    """file_id, start_frame, end_frame, source_midi of tracks (file_id, frame, midi, onset); frames that are absent are missing."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["frame"].min())
        midi = np.full(int(pdf["frame"].max()) - first + 1, np.nan)
        midi[pdf["frame"] - first] = pdf["midi"].astype(float)
        found = frames_to_events(midi, set((pdf["frame"][pdf["onset"].fillna(False).astype(bool)] - first).tolist()), change, retrigger, least)
        return pd.DataFrame([(pdf["file_id"].iloc[0], s + first, e + first, m) for s, e, m in found], columns=["file_id", "start_frame", "end_frame", "source_midi"])

    return track.select("file_id", "frame", "midi", "onset").groupBy("file_id").applyInPandas(one, "file_id bigint, start_frame bigint, end_frame bigint, source_midi double")


def _grid(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, int]:
    first = int(pdf["frame"].min())
    out = np.zeros((REST, int(pdf["frame"].max()) - first + 1))
    out[pdf["pitch"], pdf["frame"] - first] = pdf[value]
    return out, first


def decode_posteriors(cells: DataFrame, enter: float = 0.08, apart: int = 8) -> DataFrame:
    """file_id, frame, state, confidence, boundary: the path through sparse cells (file_id, frame, pitch, salience, onset), struck-again frames marked."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[(pdf["pitch"] >= 0) & (pdf["pitch"] < REST)]
        if not len(pdf):
            return pd.DataFrame({"file_id": [], "frame": [], "state": [], "confidence": [], "boundary": []})
        grid, first = _grid(pdf, "salience")
        path, confidence = frame_viterbi(grid, enter)
        boundary = np.zeros(len(path), bool)
        boundary[retrigger_boundaries(path, _grid(pdf, "onset")[0], grid, apart)] = True
        return pd.DataFrame({"file_id": pdf["file_id"].iloc[0], "frame": np.arange(len(path)) + first, "state": path, "confidence": confidence, "boundary": boundary})

    return cells.select("file_id", "frame", "pitch", "salience", "onset").groupBy("file_id").applyInPandas(one, "file_id bigint, frame bigint, state int, confidence double, boundary boolean")


def clean_notes(notes: DataFrame, by: str, longest: float = 0.07, confidence: float = 0.5, near: int = 2) -> DataFrame:
    """Rows (``by``, start_s, end_s, pitch, confidence) cleaned of fragments within each group."""

    kind = notes.schema[by].dataType.simpleString()
    names = [by, "start_s", "end_s", "pitch", "confidence"]

    # groups are small and many: a sorted partition is walked through rather than handed over group by group
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def rows() -> Iterator[tuple]:
            nonlocal types
            for table in pieces(batches):
                types = [table.schema.field(by).type, pa.float64(), pa.float64(), pa.int32(), pa.float64()]
                yield from zip(*(table.column(c).to_pylist() for c in names))

        out: list[tuple] = []
        for group, held in groupby(rows(), key=lambda r: r[0]):
            out += [(group, *r) for r in clean_fragments([r[1:] for r in held], longest, confidence, near)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    sorted_notes = notes.select(by, *(F.col(c).cast("double") for c in names[1:3]), F.col("pitch").cast("int"), F.col("confidence").cast("double")).repartition(by).sortWithinPartitions(*names[:4])
    return sorted_notes.mapInArrow(local, f"{by} {kind}, start_s double, end_s double, pitch int, confidence double")
