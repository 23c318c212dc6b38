"""Style profiles: nested JSON documents with defaults, and their long form.

Profiles are read with a fixed schema, weights as maps, so that their keys
become rows rather than columns. Every field but id and scale has a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the sections with their types and defaults (as SQL).
GRAMMAR = {
    "pitch_deviation_weight": ("double", "1.0"), "motion_preservation_weight": ("double", "0.35"), "contour_penalty": ("double", "1.0"), "leap_penalty": ("double", "0.12"), "max_preferred_leap": ("double", "7.0"), "candidate_shift_semitones": ("double", "5.0"),
    "candidate_count": ("int", "7"), "event_pitch_change": ("double", "0.8"), "min_event_frames": ("int", "2"), "phrase_gap_ms": ("double", "140.0"), "phrase_long_note_factor": ("double", "2.2"), "phrase_leap_semitones": ("double", "7.0"), "min_phrase_events": ("int", "3"),
}
WEIGHT_MAPS = ["interval_weights", "degree_weights", "transition_weights", "ascending_transition_weights", "descending_transition_weights", "trigram_weights", "cadence_degrees"]
PATTERN_LISTS = ["preferred_phrases", "cadence_patterns"]
RHYTHM = {
    "enabled": ("boolean", "false"), "preserve_phrase_duration": ("boolean", "true"), "quantize_strength": ("double", "0.0"), "preferred_duration_ratios": ("array<double>", "array(0.5D, 1.0D, 2.0D)"), "degree_duration_multipliers": ("map<string,double>", "map()"),
    "phrase_end_multiplier": ("double", "1.0"), "gap_multiplier": ("double", "1.0"), "max_duration_change": ("double", "0.35"),
}
ORNAMENT = "array<struct<type:string,degrees:array<int>,probability:double,scale_steps:int,fraction:double,max_ms:double,depth_cents:double,rate_hz:double,delay_fraction:double>>"
MODULATION = "struct<enabled:boolean,options:array<struct<name:string,root_offset:int,scale:array<int>,min_phrase_events:int,switch_penalty:double,activation_bonus:double>>>"
REGISTER = "struct<enabled:boolean,median_midi:double,q1_midi:double,q3_midi:double,p10_midi:double,p90_midi:double>"
_GRAMMAR_TYPE = ",".join([f"{k}:{t}" for k, (t, _) in GRAMMAR.items()] + [f"{k}:map<string,double>" for k in WEIGHT_MAPS] + [f"{k}:array<struct<degrees:array<int>,weight:double>>" for k in PATTERN_LISTS])
SCHEMA = (
    f"id string, label string, region string, description string, scale array<int>, grammar struct<{_GRAMMAR_TYPE}>, rhythm struct<{','.join(f'{k}:{t}' for k, (t, _) in RHYTHM.items())}>, tuning struct<degree_cents:map<string,double>>, "
    f"ornaments {ORNAMENT}, modulation {MODULATION}, register {REGISTER}, auxiliary_degrees map<string,double>, notes string"
)


def _section(name: str, fields: dict) -> list[Column]:
    return [F.coalesce(F.col(f"{name}.{k}"), F.expr(f"cast({d} as {t})")).alias(k) for k, (t, d) in fields.items()]


def _degrees(values: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(values, lambda d: F.pmod(d, F.lit(12)))))


def with_defaults(profiles: DataFrame) -> DataFrame:
    """Profiles with every default filled, scales sorted and distinct modulo 12, patterns of fewer than two steps left out.

    Profiles without id or scale, which are no profiles, are left out.
    """
    maps = [F.coalesce(F.col(f"grammar.{k}"), F.expr("cast(map() as map<string,double>)")).alias(k) for k in WEIGHT_MAPS]
    lists = [F.filter(F.coalesce(F.col(f"grammar.{k}"), F.expr("cast(array() as array<struct<degrees:array<int>,weight:double>>)")), lambda x: F.size(x["degrees"]) >= 2).alias(k) for k in PATTERN_LISTS]
    options = F.transform(
        F.coalesce(F.col("modulation.options"), F.expr("cast(array() as array<struct<name:string,root_offset:int,scale:array<int>,min_phrase_events:int,switch_penalty:double,activation_bonus:double>>)")),
        lambda o: F.struct(
            F.coalesce(o["name"], F.lit("modulation")).alias("name"), F.pmod(F.coalesce(o["root_offset"], F.lit(0)), F.lit(12)).alias("root_offset"), F.coalesce(_degrees(o["scale"]), F.expr("cast(array() as array<int>)")).alias("scale"),
            F.coalesce(o["min_phrase_events"], F.lit(4)).alias("min_phrase_events"), F.coalesce(o["switch_penalty"], F.lit(1.5)).alias("switch_penalty"), F.coalesce(o["activation_bonus"], F.lit(0.0)).alias("activation_bonus"),
        ),
    )
    return profiles.filter(F.col("id").isNotNull() & (F.size("scale") > 0)).select(
        "id", F.coalesce("label", "id").alias("label"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("region", "description")), _degrees(F.col("scale")).alias("scale"), F.struct(*_section("grammar", GRAMMAR), *maps, *lists).alias("grammar"), F.struct(*_section("rhythm", RHYTHM)).alias("rhythm"),
        F.struct(F.coalesce("tuning.degree_cents", F.expr("cast(map() as map<string,double>)")).alias("degree_cents")).alias("tuning"), "ornaments", F.struct(F.coalesce("modulation.enabled", F.lit(False)).alias("enabled"), options.alias("options")).alias("modulation"), "register", "auxiliary_degrees", F.coalesce("notes", F.lit("")).alias("notes"),
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profiles of a folder or file; an error where there is none or two have one id."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    profiles = with_defaults(raw)
    twice = profiles.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two profiles have the id {twice[0]['id']}")
    if not profiles.limit(1).count():
        raise ValueError(f"no profiles in {path}")
    return profiles


def write_profiles(profiles: DataFrame, path: str) -> DataFrame:
    """Write profiles as JSON, one a line, and return them as read again; an error if one doesn't come back."""
    profiles.write.json(path)
    back = with_defaults(profiles.sparkSession.read.schema(SCHEMA).json(path))
    lost = profiles.select("id").join(back, "id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"profile {lost[0]['id']} doesn't read back")
    return back


def profile_weights(profiles: DataFrame) -> DataFrame:
    """The long form: id, kind, key, weight of all weights, patterns as ``0>4>7``."""
    parts = [profiles.select("id", F.lit(k).alias("kind"), F.explode(f"grammar.{k}").alias("key", "weight")) for k in WEIGHT_MAPS]
    parts += [profiles.select("id", F.lit(k).alias("kind"), F.explode(f"grammar.{k}").alias("x")).select("id", "kind", F.concat_ws(">", F.transform("x.degrees", lambda d: d.cast("string"))).alias("key"), "x.weight") for k in PATTERN_LISTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
