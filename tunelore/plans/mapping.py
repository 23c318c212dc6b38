"""Queries on profiles and on melodies mapped onto them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.operators import mapping as m
from tunelore.operators.learning import learn_profiles
from tunelore.plans.corpus import _PHRASES, rooted
from tunelore.plans.corpus import ADAPTER_SQL as corpus_sql
from tunelore.sources.profiles import SCHEMA, profile_weights, with_defaults
from tunelore.staging import stage

#: Two small profiles of our own.
PROFILES = [
    {
        "id": "five", "scale": [0, 2, 4, 7, 9], "grammar": {
            "interval_weights": {"2": 1.0, "3": 0.7}, "degree_weights": {"0": 0.9, "7": 0.5}, "transition_weights": {"0>2": 0.6, "7>9": 0.4}, "ascending_transition_weights": {"0>2": 0.5}, "descending_transition_weights": {"4>2": 0.8, "2>0": 0.7},
            "trigram_weights": {"4>2>0": 0.9}, "preferred_phrases": [{"degrees": [0, 2, 4, 7], "weight": 1.2}, {"degrees": [7], "weight": 9.0}], "cadence_degrees": {"0": 1.1}, "cadence_patterns": [{"degrees": [2, 0], "weight": 0.8}],
        },
        "modulation": {"enabled": True, "options": [{"name": "up", "root_offset": 5, "min_phrase_events": 5, "switch_penalty": 1.0, "activation_bonus": 0.4}]}, "register": {"enabled": True, "median_midi": 72.0, "p10_midi": 60.0, "p90_midi": 84.0},
    },
    {"id": "minor", "scale": [12, 2, 3, 5, 7, 8, 10, 3], "register": {"enabled": True, "median_midi": 40.0}},
    {"id": None, "scale": [0]}, {"id": "noscale"},
]


def profiles(spark: SparkSession) -> DataFrame:
    return with_defaults(spark.createDataFrame([(json.dumps(p),) for p in PROFILES], "j string").select(F.from_json("j", SCHEMA).alias("p")).select("p.*"))


def profile_json(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles' scalar fields with defaults."""
    return profiles(spark).select("id", "label", F.concat_ws(",", F.transform("scale", lambda d: d.cast("string"))).alias("scale"), "grammar.contour_penalty", "grammar.candidate_count", "rhythm.max_duration_change", F.col("modulation.enabled").alias("modulates"))


def profile_long(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles' weights as rows."""
    return profile_weights(profiles(spark))


def profile_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The weights of profiles written as JSON and read again."""
    docs = profiles(spark).select(F.to_json(F.struct("*")).alias("j"))
    return profile_weights(with_defaults(docs.select(F.from_json("j", SCHEMA).alias("p")).select("p.*")))


def learned_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in clusters' learned profiles, written as JSON, read with the profile schema, as rows of weights."""
    learned = learn_profiles(rooted(spark, folder)).select(F.to_json(F.struct("*")).alias("j"))
    return profile_weights(with_defaults(learned.select(F.from_json("j", SCHEMA).alias("p")).select("p.*")))


def _melodies(spark: SparkSession, folder: str) -> DataFrame:
    return rooted(spark, folder).select("file_id", "phrase", "seq", "source_midi", "root", "frames", "start_frame", "end_frame", "pitch", "pc", "degree")


def map_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Each phrase's cost under each option of each profile."""
    return m.map_phrases(_melodies(spark, folder), profiles(spark)).select("id", "file_id", "phrase", "option", "name", "root", "n_events", F.round("cost", 6).alias("cost"))


def map_melody(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of every event under every profile."""
    return m.map_melodies(_melodies(spark, folder), profiles(spark)).select("id", "file_id", "phrase", "seq", "target", "root", "name")


def learned_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics and grammar rewards of the mapped melodies."""
    mapped = stage(m.map_melodies(_melodies(spark, folder), profiles(spark)), "melodies")
    return m.mapping_metrics(mapped).join(m.grammar_rewards(mapped, profile_weights(profiles(spark))), ["id", "file_id"])


def _snapped(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in targets that SQL can state: pitches lowered to the scale below them."""
    down = F.element_at(F.array(*map(F.lit, SNAP)), (F.col("degree") + 1).cast("int"))
    scale = F.array(*map(F.lit, [0, 2, 4, 7, 9]))
    return _melodies(spark, folder).withColumn("target", F.col("pitch") - down).select(F.lit("five").alias("id"), "*", scale.alias("scale"), F.lit("base").alias("name"))


#: How far each degree lies above the next one of the scale 0 2 4 7 9.
SNAP = [0, 1, 0, 1, 0, 1, 2, 0, 1, 0, 1, 2]
RHYTHM = m.RhythmRule((0.5, 1.0, 1.5, 2.0), 0.4, ((0, 1.2), (7, 0.9)), 1.2, 0.9, 0.3)


def register_shift(spark: SparkSession, folder: str) -> DataFrame:
    registers = profiles(spark).filter("register.enabled").select("id", F.col("register.median_midi").alias("median"), F.col("register.p10_midi").alias("p10"), F.col("register.p90_midi").alias("p90"))
    return m.register_shift(_snapped(spark, folder), registers)


def rhythm_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    new = m.rhythm_rewrite(_snapped(spark, folder).withColumn("degree", F.pmod(F.col("target") - F.col("root"), F.lit(12))), RHYTHM)
    return new.withColumns({"new_frames": F.round("new_frames", 6), "new_gap": F.round("new_gap", 6)})


def grammar_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How well the stand-in targets follow the grammar of their profile."""
    found = m.grammar_rewards(_snapped(spark, folder), profile_weights(profiles(spark)))
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.endswith("_score")})


def duration_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The change of durations under the rhythm rule."""
    new = m.rhythm_rewrite(_snapped(spark, folder).withColumn("degree", F.pmod(F.col("target") - F.col("root"), F.lit(12))), RHYTHM)
    found = m.duration_metrics(new, ["file_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean_relative_duration_change", "output_duration_s")})


def mapping_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = m.mapping_metrics(_snapped(spark, folder))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_displacement", "median_displacement", "max_displacement", "contour_preservation", "melody_preservation")})


_SNAPPED = _PHRASES + f", sn as (select *, pitch - {SNAP}[degree + 1] as target from de)"
QUERIES = {f.__name__: f for f in (profile_json, profile_long, profile_roundtrip, learned_profiles, map_phrases, map_melody, learned_scores, register_shift, rhythm_rewrite, mapping_metrics, grammar_scores, duration_metrics)}
_LONG = " union all ".join(
    f"select '{p['id']}' as id, '{kind}' as kind, '{key}' as key, {w}::double as weight"
    for p in PROFILES[:1] for kind, held in p["grammar"].items() for key, w in (held.items() if isinstance(held, dict) else [(">".join(map(str, x["degrees"])), x["weight"]) for x in held if len(x["degrees"]) > 1])
)
_KINDS = {"degree_weights": ("degree_weights", "degree::varchar"), "interval_weights": ("interval_weights", '"interval"::varchar'), "trigram_weights": ("trigram_weights", "ngram"), "preferred_phrases": ("preferred_phrases", "ngram")}
_KINDS |= {n: (q, "a || '>' || b") for q, n in (("transition_weights", "transition_weights"), ("ascending_weights", "ascending_transition_weights"), ("descending_weights", "descending_transition_weights"))}
_LEARNED = [f"select 'cluster_' || cluster_id as id, '{k}' as kind, {key} as key, weight from ({corpus_sql[q]})" for k, (q, key) in _KINDS.items()]
_LEARNED += [f"select 'cluster_' || cluster_id, case when n = 1 then 'cadence_degrees' else 'cadence_patterns' end, ngram, weight from ({corpus_sql['cadence_weights']})"]
SQL = {
    "learned_profiles": " union all ".join(_LEARNED),
    "profile_json": "select 'five' as id, 'five' as label, '0,2,4,7,9' as scale, 1.0::double as contour_penalty, 7 as candidate_count, 0.35::double as max_duration_change, true as modulates union all select 'minor', 'minor', '0,2,3,5,7,8,10', 1.0, 7, 0.35, false",
    "profile_long": _LONG,
    "profile_roundtrip": _LONG,
    "register_shift": _SNAPPED + """, s as (select file_id, target as v, sum(frames) as w from sn group by all), r as (select *, sum(w) over (partition by file_id order by v rows unbounded preceding) as c, sum(w) over (partition by file_id) as t from s),
    q as (select file_id, min(v) filter (c >= 0.1 * t) as q10, min(v) filter (c >= 0.5 * t) as q50, min(v) filter (c >= 0.9 * t) as q90, min(v) as low, max(v) as high from r group by all),
    k as (select *, abs(q50 + s - 72) + 0.45 * greatest(0, 60 - (q10 + s)) + 0.45 * greatest(0, q90 + s - 84) + abs(s) * 1e-6 as score from q cross join (select unnest(range(-60, 61, 12)) as s) where low + s >= 0 and high + s <= 127)
    select 'five' as id, file_id, arg_min(s, score)::integer as shift from k group by file_id""",
    "rhythm_rewrite": _SNAPPED + """, e as (select file_id, phrase, seq, frames, ((target - root) % 12 + 12) % 12 as deg, coalesce(greatest(0, lead(start_frame) over w - end_frame), 0) as gap, median(frames) over (partition by file_id, phrase) as base, lead(seq) over w is null as is_end from sn window w as (partition by file_id, phrase order by seq)),
    a as (select *, frames / base as ratio, list_transform([0.5, 1.0, 1.5, 2.0], lambda r: abs(r - frames / base)) as away from e),
    b as (select *, base * (0.6 * ratio + 0.4 * [0.5, 1.0, 1.5, 2.0][list_position(away, list_min(away))]) * case deg when 0 then 1.2 when 7 then 0.9 else 1 end as d from a),
    c as (select *, least(frames * 1.3, greatest(frames * 0.7, d)) * case when is_end then 1.2 else 1 end as n, gap * 0.9 as g from b),
    s as (select *, sum(frames + gap) over (partition by file_id, phrase) / sum(n + g) over (partition by file_id, phrase) as k from c)
    select file_id, phrase, seq, frames, gap, round(n * k, 6) as new_frames, round(g * k, 6) as new_gap from s""",
    "mapping_metrics": _SNAPPED + """, x as (select *, abs(target - source_midi) as d, source_midi - lag(source_midi) over w as a, target - lag(target) over w as b from sn window w as (partition by file_id, phrase order by seq))
    select 'five' as id, file_id, count(*) as events, count(distinct phrase) as phrases, 0::bigint as modulated_phrases, round(avg(d), 6) as mean_displacement, round(median(d), 6) as median_displacement, round(max(d), 6) as max_displacement,
      round(coalesce(count(*) filter (abs(a) >= 0.5 and abs(b) >= 0.5 and sign(a) = sign(b)) / nullif(count(*) filter (abs(a) >= 0.5 and abs(b) >= 0.5), 0), 1), 6) as contour_preservation,
      min(list_contains([0, 2, 4, 7, 9], ((target - root) % 12 + 12) % 12)::int) as scale_compliance, round(exp(-avg(d) / 3), 6) as melody_preservation from x group by file_id""",
}
_TAILS = ", ".join(f"case when lag(deg, {n - 1}) over w is not null then concat_ws('>', {', '.join([f'lag(deg, {i}) over w' for i in range(n - 1, 0, -1)] + ['deg'])}) end" for n in range(1, 9))
SQL["grammar_scores"] = _SNAPPED + f""", wt as ({_LONG}), mx as (select coalesce(max(weight) filter (kind = 'interval_weights'), 0) mi, coalesce(max(weight) filter (kind like '%transition_weights'), 0) mt, coalesce(max(weight) filter (kind in ('trigram_weights', 'preferred_phrases')), 0) mg, coalesce(max(weight) filter (kind like 'cadence%'), 0) mc from wt),
    dg as (select *, (((target - root) % 12 + 12) % 12)::varchar as deg from sn),
    x as (select file_id, phrase, seq, [{_TAILS}] as tails, least(12, abs(target - lag(target) over w))::varchar as iv, source_midi - lag(source_midi) over w as delta, seq = max(seq) over (partition by file_id, phrase) as final from dg window w as (partition by file_id, phrase order by seq)),
    h as (select file_id, phrase, seq, kind, sum(weight) as s, count(*) as k from (select file_id, phrase, seq, unnest(tails) as key from x) join wt using (key) where kind in ('preferred_phrases', 'cadence_patterns') group by all),
    y as (select x.*, iw.weight as i, coalesce(tw.weight, 0) + case when delta > 0.35 then coalesce(aw.weight, 0) when delta < -0.35 then coalesce(dw.weight, 0) else 0 end as t, gw.weight as g, p.s as ps, p.k as pk, coalesce(cw.weight, 0) + coalesce(c.s, 0) as c
      from x left join wt iw on iw.kind = 'interval_weights' and iw.key = iv left join wt tw on tw.kind = 'transition_weights' and tw.key = tails[2] left join wt aw on aw.kind = 'ascending_transition_weights' and aw.key = tails[2] left join wt dw on dw.kind = 'descending_transition_weights' and dw.key = tails[2]
      left join wt gw on gw.kind = 'trigram_weights' and gw.key = tails[3] left join wt cw on cw.kind = 'cadence_degrees' and cw.key = tails[1] left join h p on p.file_id = x.file_id and p.phrase = x.phrase and p.seq = x.seq and p.kind = 'preferred_phrases' left join h c on c.file_id = x.file_id and c.phrase = x.phrase and c.seq = x.seq and c.kind = 'cadence_patterns'),
    z as (select file_id, coalesce(avg(coalesce(i, 0)) filter (tails[2] is not null), 0) as i, coalesce(avg(t) filter (tails[2] is not null), 0) as t, coalesce((coalesce(sum(g), 0) + coalesce(sum(ps), 0)) / nullif(count(*) filter (tails[3] is not null) + coalesce(sum(pk), 0), 0), 0) as g, avg(c) filter (final) as c, coalesce(sum(pk), 0)::bigint as phrase_hits from y group by file_id),
    q as (select file_id, phrase_hits, least(1, greatest(0, i / mi)) as i, least(1, greatest(0, t / mt)) as t, least(1, greatest(0, g / mg)) as g, least(1, greatest(0, c / mc)) as c from z cross join mx)
    select 'five' as id, file_id, phrase_hits, round(i, 9) as interval_score, round(t, 9) as transition_score, round(g, 9) as trigram_score, round(c, 9) as cadence_score, round((i + t + g + c) / 4, 9) as grammar_score from q"""
SQL["duration_metrics"] = SQL["rhythm_rewrite"].replace("select file_id, phrase, seq, frames, gap, round(n * k, 6) as new_frames, round(g * k, 6) as new_gap from s", "select file_id, round(avg(abs(n * k - frames) / frames), 6) as mean_relative_duration_change, round(sum(n * k + g * k) * 0.01, 6) as output_duration_s from s group by file_id")
