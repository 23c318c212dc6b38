"""Phrases mapped together against one by one, and the options of many files against a walk of each."""

import json

import numpy as np
import pytest

from tunelore.operators import mapping
from tunelore.operators.mapping import grammar_of, map_phrase
from tunelore.plans.mapping import PROFILES, profiles


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_phrases_mapped_together_equal_each_by_itself(longest, monkeypatch):
    rng = np.random.default_rng(longest)
    monkeypatch.setattr(mapping, "STATES", 1 << 12)
    grammar = {"pitch_deviation_weight": 1.0, "motion_preservation_weight": 0.35, "contour_penalty": 1.0, "leap_penalty": 0.12, "max_preferred_leap": 7.0, "candidate_shift_semitones": 4.0, "candidate_count": 5} | PROFILES[0]["grammar"]
    grammar["preferred_phrases"] = [{"degrees": [2, 4, 2, 0, 9][:longest], "weight": 1.5}]
    g = grammar_of(json.dumps({"scale": [0, 2, 4, 7, 9], "grammar": grammar}))
    ends = np.append(0, np.cumsum(rng.integers(1, 12, 60)))
    pitches, roots = rng.integers(36, 85, ends[-1]) + rng.integers(-2, 3, ends[-1]) / 4, rng.integers(0, 12, 60)
    pitches[:3], roots[0] = (140.0, -9.0, 60.0), 3
    targets, costs = mapping._map_all(pitches, ends, roots, g.scale, g, 0.8)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        assert (targets[a:b].tolist(), costs[i]) == map_phrase(pitches[a:b].tolist(), int(roots[i]), g.scale, g, 0.8)


def test_a_batch_is_no_call_for_each_phrase(spark, monkeypatch):
    """5,000 phrases of a few lengths take a few steps, not one for each event."""
    calls = []
    real = mapping.map_together
    monkeypatch.setattr(mapping, "map_together", lambda *a: calls.append(1) or real(*a))
    g = grammar_of(json.dumps({"scale": [0, 2, 4, 7, 9], "grammar": {"pitch_deviation_weight": 1.0, "motion_preservation_weight": 0.35, "contour_penalty": 1.0, "leap_penalty": 0.12, "max_preferred_leap": 7.0, "candidate_shift_semitones": 5.0, "candidate_count": 7}}))
    lengths = np.arange(5000) % 4 + 3
    ends = np.append(0, np.cumsum(lengths))
    mapping._map_all(np.arange(ends[-1]) * 7 % 48 + 36.0, ends, np.arange(5000) % 12, g.scale, g, 1.0)
    assert len(calls) < 300


def test_rows_and_options_equal_a_walk(spark):
    rng = np.random.default_rng(2)
    rows = [(f, p, s, float(rng.integers(40, 80)) + float(rng.integers(-10, 11)) / 100, int(f * 5 % 12)) for f in range(12) for p in range(6) for s in range(10 * p, 10 * p + int(rng.integers(1, 9)))]
    phrased = spark.createDataFrame(rows, "file_id bigint, phrase bigint, seq int, source_midi double, root int").repartition(4)
    mapped = mapping.stage(mapping.map_phrases(phrased, profiles(spark)), "mapped")
    got = {(r["id"], r["file_id"], r["phrase"], r["option"]): r for r in mapped.collect()}
    documents = {r["id"]: r["j"] for r in profiles(spark).selectExpr("id", "to_json(struct(scale, grammar, modulation)) as j").collect()}
    expected, walked = {}, {}
    for name, document in documents.items():
        g = grammar_of(document)
        for f in range(12):
            before = None
            for p in range(6):
                notes = [x[3] for x in rows if x[:2] == (f, p)]
                root, costs, roots = f * 5 % 12, [], []
                for i, o in enumerate([None, *g.options]):
                    if o is None or len(notes) >= o["min_phrase_events"]:
                        r = root if o is None else (root + o["root_offset"]) % 12
                        scale = g.scale if o is None else tuple(o["scale"]) or g.scale
                        targets, cost = map_phrase(notes, r, scale, g, 1.0)
                        expected[name, f, p, i] = (r, list(scale), targets, cost - (o["activation_bonus"] if o else 0.0), len(notes), 10 * p)
                        before = r if before is None else before
                        costs.append((expected[name, f, p, i][3] + (o["switch_penalty"] if o and r != before else 0.0), i))
                        roots.append(r)
                total, option = min(costs)
                walked[name, f, p] = (option, total)
                before = roots[option]
    assert {k: (r["root"], r["scale"], r["targets"], r["cost"], r["n_events"], r["first_seq"]) for k, r in got.items()} == expected
    chosen = mapping.choose_options(mapped).collect()
    assert {(r["id"], r["file_id"], r["phrase"]): (r["option"], r["cost"]) for r in chosen} == walked and len(chosen) == len(walked) and len({x[0] for x in walked.values()}) > 1


def test_each_earlier_degree_is_looked_up_once(spark):
    from tunelore.sources.profiles import profile_weights

    mapped = spark.createDataFrame([("five", 1, 0, s, 60 + s, 60.0 + s, 0, [0], "base") for s in range(3)], "id string, file_id bigint, phrase bigint, seq int, target int, source_midi double, root int, scale array<int>, name string")
    plan = mapping.grammar_rewards(mapped, profile_weights(profiles(spark)))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and sum(line.count("lag(") for line in windows) <= 9
