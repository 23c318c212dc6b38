"""The ordered kernels against brute force and small cases."""

import itertools
import random

import numpy as np
import pytest

from tunelore.operators import kernels as k
from tunelore.operators.segments import REST


def test_events_of_a_track():
    nan = np.nan
    assert k.frames_to_events(np.array([60, 60.1, 60.2, 62, 62, nan, 62, 62]), set(), 0.8, 1, 2) == [(0, 3, 60.1), (3, 5, 62.0), (6, 8, 62.0)]
    assert k.frames_to_events(np.array([60.0] * 6), {3}, 0.8, 2, 2) == [(0, 3, 60.0), (3, 6, 60.0)]
    assert k.frames_to_events(np.array([60.0] * 6), {1}, 0.8, 2, 2) == [(0, 6, 60.0)]
    # a short event joins the nearer neighbour, a first one the next
    assert k.frames_to_events(np.array([60, 60, 60, 64, 65, 65, 65.0]), set(), 0.8, 1, 3) == [(0, 3, 60.0), (3, 7, 65.0)]
    assert k.frames_to_events(np.array([70, 60, 60, 60.0]), set(), 0.8, 1, 2) == [(0, 4, 60.0)]
    assert k.frames_to_events(np.array([nan, nan]), set()) == [] and k.frames_to_events(np.array([60.0]), set(), least=5) == [(0, 1, 60.0)]


def plain_merge(events, least):
    out = [list(e) for e in events]
    again = True
    while again and len(out) > 1:
        again = False
        for i, (s, e, p) in enumerate(out):
            if e - s < least:
                if i == 0 or (i < len(out) - 1 and abs(p - out[i - 1][2]) > abs(p - out[i + 1][2])):
                    out[i + 1][0] = s
                else:
                    out[i - 1][1] = e
                del out[i]
                again = True
                break
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(8))
def test_merging_equals_rescanning(seed):
    rng = random.Random(seed)
    track = np.repeat([rng.choice([60.0, 62.0, 65.0, 70.0]) for _ in range(60)], 1)
    assert k.frames_to_events(track, set(), 0.8, 1, 4) == plain_merge(k.frames_to_events(track, set(), 0.8, 1, 1), 4)


def path_score(grid, path, enter, stay):
    costs = k.change_costs(np.arange(129))
    total = 0.0
    for t, s in enumerate(path):
        peak = grid[:, t].max()
        level = 0 if peak < stay else 1 if peak < enter else 2
        if s == REST:
            total += (k.FIRST_REST_REWARD if t == 0 else k.REST_REWARD)[level]
        else:
            v, held = grid[s, t], t > 0 and path[t - 1] == s
            if v < (stay if held else enter):
                return -np.inf
            total += k.STAY * v + k.STAY_MORE if held else k.ENTER * v
        total -= costs[path[t - 1], s] if t else 0.0
    return total


@pytest.mark.parametrize("seed", range(6))
def test_path_is_the_best(seed):
    rng = np.random.default_rng(seed)
    grid = np.zeros((128, 5))
    pitches = [60, 61, 72]
    grid[pitches] = rng.uniform(0, 0.3, (3, 5))
    path, confidence = k.frame_viterbi(grid, 0.12, 0.05)
    best = max(path_score(grid, p, 0.12, 0.05) for p in itertools.product([*pitches, REST], repeat=5))
    assert path_score(grid, path.tolist(), 0.12, 0.05) == pytest.approx(best)
    assert confidence.tolist() == [0.0 if s == REST else grid[s, t] for t, s in enumerate(path)]


@pytest.mark.parametrize("seed", range(10))
def test_spaced_choice_is_the_best(seed):
    rng = random.Random(seed)
    places = sorted(rng.sample(range(30), 8))
    gains = [rng.uniform(-0.3, 1) for _ in places]
    value = dict(zip(places, gains))
    best = max(sum(value[p] for p in c) for n in range(9) for c in itertools.combinations(places, n) if all(b - a >= 5 for a, b in zip(c, c[1:])))
    chosen = k.spaced_best(places, gains, 5)
    assert sum(value[p] for p in chosen) == pytest.approx(best) and all(b - a >= 5 for a, b in zip(chosen, chosen[1:]))


def test_struck_again():
    path = np.array([REST] * 2 + [60] * 20)
    onset, salience = np.zeros((128, 22)), np.full((128, 22), 0.8)
    onset[60, 12] = 0.9
    assert k.retrigger_boundaries(path, onset, salience, 5) == [12]
    onset[60, 12] = 0.5
    assert k.retrigger_boundaries(path, onset, salience, 5) == []
    salience[60, 9:12] = 0.2
    assert k.retrigger_boundaries(path, onset, salience, 5) == [12]
    onset[60, 4] = 0.9
    assert k.retrigger_boundaries(path, onset, salience, 5) == [12]


def test_fragments():
    a = (0.0, 1.0, 60, 0.9)
    assert k.clean_fragments([a, (1.0, 1.05, 61, 0.1), (1.05, 2.0, 60, 0.5)]) == [pytest.approx((0.0, 2.0, 60, (0.9 + 0.5 * 0.95) / 1.95))]
    assert len(k.clean_fragments([a, (1.0, 1.05, 61, 0.9), (1.05, 2.0, 60, 0.5)])) == 3
    assert len(k.clean_fragments([a, (1.0, 2.0, 60, 0.9)])) == 2 and len(k.clean_fragments([a, (1.0, 1.05, 60, 0.1)])) == 1
    assert k.clean_fragments([]) == []
