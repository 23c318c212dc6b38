"""Queries on measurements: implausible spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.operators.spikes import CELLS, Field, Measured, TailRule, spikes
from tunelore.sources.tables import table

NOTE_FIELDS = [Field("pitch", 0, 127, 10), Field("confidence", 0, 1, 10)]
CANDIDATE_FIELDS = [Field("octave_jump_ratio", 0, 1, 6)]
#: Deviations of the exact check.
SIGMAS = 6.0
#: The season of a note is the second of its candidate in a cycle of so many, that of a candidate its segment in one.
CYCLE = 4


def _spikes(spark: SparkSession, folder: str, sigmas: float | None) -> DataFrame:
    second = F.coalesce(F.pmod(F.floor("start_s"), F.lit(CYCLE)), F.lit(0))
    segment = F.coalesce(F.pmod(F.col("segment_index"), F.lit(CYCLE)), F.lit(0))
    notes = Measured(table(spark, folder, "notes"), "source_id", ["candidate_id", "start_s"], "note_id", NOTE_FIELDS, second)
    candidates = Measured(table(spark, folder, "candidates"), "source_id", ["candidate_id"], "candidate_id", CANDIDATE_FIELDS, segment)
    return spikes([notes, candidates], sigmas=sigmas)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty values; those in the tails lie beyond their source's fitted cutoff and six deviations of its faultless values."""
    return _spikes(spark, folder, SIGMAS).select("field", "record_id")


def p3_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty values with their reasons, the tails cut at the sources' peaks-over-threshold cutoffs alone."""
    return _spikes(spark, folder, None)


def _sql_level(n: int) -> str:
    return f"""
  l{n} as (select field, source_id, avg(v) m, stddev_pop(v) s from (select u.* from u {f'join l{n - 1} using (field, source_id) where abs(v - m) <= {SIGMAS} * s' if n else 'join mad using (field, source_id) where d = 0 or abs(v - med) <= 6 * d'}) group by all)"""


_READ = """
with n as (select distinct note_id, candidate_id, source_id, start_s, pitch, confidence from notes),
  c as (select distinct candidate_id, segment_index, source_id, octave_jump_ratio from candidates),
  a as (
    select 'pitch' field, note_id record_id, source_id, candidate_id o1, start_s o2, pitch::double v, 127 hi, 10 k, coalesce(floor(start_s)::bigint % 4, 0) season from n
    union all select 'confidence', note_id, source_id, candidate_id, start_s, confidence, 1, 10, coalesce(floor(start_s)::bigint % 4, 0) from n
    union all select 'octave_jump_ratio', candidate_id, source_id, candidate_id, 0, octave_jump_ratio, 1, 6, coalesce(segment_index % 4, 0) from c),
  p as (select * from a where v is not null and not isnan(v)),
  b as (select *, case when v = lag(v) over w then 0 else 1 end fresh from p window w as (partition by field, source_id order by o1, o2, record_id)),
  r as (select *, sum(fresh) over (partition by field, source_id order by o1, o2, record_id rows unbounded preceding) run from b),
  q as (select *, v < 0 or v > hi wild, count(*) over (partition by field, source_id, run) >= k stuck, wild or stuck as bad from r),
  u as (select * from q where not bad),
"""

P3_SQL = f"""{_READ}
  med as (select field, source_id, median(v) med from u group by all),
  mad as (select field, source_id, med, 1.4826 * median(abs(v - med)) d from u join med using (field, source_id) group by all),
  {",".join(_sql_level(n) for n in range(7))}
select field, record_id from q where bad
union all
select field, record_id from u join l6 using (field, source_id) where abs(v - m) > {SIGMAS} * s
"""


def _sql_reach(sign: int, at: str, rule: TailRule = TailRule()) -> str:
    """The distance of a tail's cutoff from the season's median, from the residuals' three quantiles ``at``1 to 3."""
    u, half, quarter = (f"({sign} * {at}{i})" for i in (1, 2, 3))
    return f"""(select {u} + greatest(0, greatest(({half} - {u}) * k / (2 ^ k - 1), ({quarter} - {u}) * k / (4 ^ k - 1)) * (({rule.share} / {rule.risk}) ^ k - 1) / k)
      from (select case when abs(shape) < 1e-9 then 1e-9 else shape end k from (select case when {half} > {u} and {quarter} > {half} then least(greatest(log2(({quarter} - {half}) / ({half} - {u})), {-rule.shape / 2}), {rule.shape}) else 0.0 end shape)))"""


_AT = [f"quantile_cont(res, {x}) {n}" for n, x in (("h1", 0.9), ("h2", 0.95), ("h3", 0.975), ("l1", 0.1), ("l2", 0.05), ("l3", 0.025))]
TAILS_SQL = f"""{_READ}
  g as (select field, source_id, season, min(v) over (partition by field, source_id, season, least(floor(v * {CELLS} / hi), {CELLS - 1})) v from u),
  med as (select field, source_id, season, median(v) med from g group by all),
  e as (select field, source_id, {", ".join(_AT)} from (select field, source_id, v - med res from g join med using (field, source_id, season)) group by all),
  t as (select field, source_id, {_sql_reach(1, "h")} high, {_sql_reach(-1, "l")} low from e),
  z as (select field, record_id, wild, stuck, coalesce(v > med + high or v < med - low, false) tail from q left join med using (field, source_id, season) left join t using (field, source_id))
select field, record_id, concat_ws('+', case when wild then 'range' end, case when stuck then 'stuck' end, case when tail then 'tail' end) reason from z where wild or stuck or tail
"""

QUERIES = {"p3_found": p3_found, "p3_tails": p3_tails}
SQL = {"p3_found": P3_SQL, "p3_tails": TAILS_SQL}
