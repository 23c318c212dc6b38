"""The mapping's dynamic programme against trying every target, and its options against a walk."""

import itertools
import json
import random

import numpy as np
import pytest

from tunelore.operators.mapping import candidates, grammar_of, map_phrase
from tunelore.plans.mapping import PROFILES, profiles

BASE = {"pitch_deviation_weight": 0.9, "motion_preservation_weight": 0.25, "contour_penalty": 0.8, "leap_penalty": 0.1, "max_preferred_leap": 3.0, "candidate_shift_semitones": 4.0, "candidate_count": 3}


def plain_cost(path, pitches, root, grammar, amount):
    g = BASE | grammar
    deg = [(t - root) % 12 for t in path]
    cost = sum(g["pitch_deviation_weight"] * abs(t - p) - amount * g.get("degree_weights", {}).get(str(d), 0) for t, p, d in zip(path, pitches, deg))
    for i in range(1, len(path)):
        move, out = pitches[i] - pitches[i - 1], path[i] - path[i - 1]
        cost += g["motion_preservation_weight"] * abs(out - move)
        if abs(move) >= 0.5 and abs(out) >= 0.5 and np.sign(move) != np.sign(out):
            cost += g["contour_penalty"]
        cost += g["leap_penalty"] * max(0, abs(out) - g["max_preferred_leap"])
        key = f"{deg[i - 1]}>{deg[i]}"
        side = "ascending_transition_weights" if move > 0.35 else "descending_transition_weights" if move < -0.35 else None
        cost -= amount * (g.get("interval_weights", {}).get(str(min(12, abs(out))), 0) + g.get("transition_weights", {}).get(key, 0) + (g.get(side, {}).get(key, 0) if side else 0))
        if i >= 2:
            cost -= amount * g.get("trigram_weights", {}).get(">".join(map(str, deg[i - 2 : i + 1])), 0)
        for p in g.get("preferred_phrases", []):
            n = len(p["degrees"])
            if i + 1 >= n and deg[i + 1 - n : i + 1] == p["degrees"]:
                cost -= amount * p["weight"]
    cost -= amount * g.get("cadence_degrees", {}).get(str(deg[-1]), 0)
    for p in g.get("cadence_patterns", []):
        if deg[-len(p["degrees"]) :] == p["degrees"]:
            cost -= amount * p["weight"]
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_finds_the_cheapest_path(seed):
    rng = random.Random(seed)
    grammar = dict(PROFILES[0]["grammar"])
    grammar["preferred_phrases"] = [{"degrees": [0, 2, 4, 7][: rng.randint(2, 4)], "weight": 1.5}, {"degrees": [2, 4, 2, 0, 9] if seed % 2 else [9, 7], "weight": 3.0}]
    doc = {"scale": [0, 2, 4, 7, 9], "grammar": BASE | grammar}
    g = grammar_of(json.dumps(doc))
    root, pitches = rng.randrange(12), [rng.uniform(55, 70) for _ in range(rng.randint(1, 6))]
    path, cost = map_phrase(pitches, root, g.scale, g, 0.8)
    sets = [candidates(p, root, g.scale, 4.0, 3) for p in pitches]
    best = min(plain_cost(list(map(int, c)), pitches, root, grammar, 0.8) for c in itertools.product(*sets))
    assert cost == pytest.approx(best) and plain_cost(path, pitches, root, grammar, 0.8) == pytest.approx(best)


def test_candidates():
    assert candidates(61.0, 0, (0, 2), 1.0, 5).tolist() == [60, 62]
    assert candidates(57.0, 0, (0,), 1.0, 5).tolist() == [60]


def test_profiles(spark):
    rows = {r["id"]: r for r in profiles(spark).collect()}
    assert set(rows) == {"five", "minor"}
    assert rows["minor"]["scale"] == [0, 2, 3, 5, 7, 8, 10] and rows["minor"]["grammar"]["candidate_count"] == 7
    assert len(rows["five"]["grammar"]["preferred_phrases"]) == 1


def test_profiles_written_and_read(spark, tmp_path):
    from tunelore.sources.profiles import profile_weights, read_profiles, write_profiles

    back = write_profiles(profiles(spark), str(tmp_path / "out"))
    assert sorted(map(str, profile_weights(back).collect())) == sorted(map(str, profile_weights(profiles(spark)).collect()))
    (tmp_path / "in").mkdir()
    for i, p in enumerate([PROFILES[0], PROFILES[0] | {"extra": 1}]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(p, indent=1))
    with pytest.raises(ValueError):
        read_profiles(spark, str(tmp_path / "in"))
