"""Queries on windows, segments, frame paths and posterior grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelore.operators import keys
from tunelore.operators import segments as g
from tunelore.operators.events import EVENT_SQL, melody_events
from tunelore.sources.tables import table

WINDOW, OVERLAP = 600, 200


def beats(spark: SparkSession, folder: str) -> DataFrame:
    """Beats of each user, 50 frames apart, from before the first event until two bars of windows lie behind the last one."""
    files = melody_events(spark, folder).groupBy("file_id").agg(F.max("end_frame").alias("last"))
    every = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("last") / 50) + 16).cast("int"))).alias("beat")
    return files.select("file_id", (F.col("file_id") % 4).alias("phase"), every).withColumn("time", (F.col("beat") - 4) * 50 + F.col("file_id") % 11)


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return melody_events(spark, folder).select("file_id", F.col("seq").alias("id"), "pitch", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"), ((F.col("event_id") % 100) / 100.0).alias("amplitude"), "channel")


def bar_windows(spark: SparkSession, folder: str) -> DataFrame:
    return g.bar_windows(beats(spark, folder))


def notes_in_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Notes clipped to windows of two bars, one bar apart."""
    windows = g.bar_windows(beats(spark, folder)).select("file_id", "segment_index", "start", "end")
    return g.clip_to_windows(notes(spark, folder).select("file_id", "id", "pitch", "start", "end"), windows, 128)


def clean_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Each extracted note once, faulty measurements left out, in hundredths of seconds and ten-thousandths of confidence."""
    raw = table(spark, folder, "notes").filter("pitch between 0 and 127 and confidence between 0 and 1").dropDuplicates(["note_id"])
    return raw.select("candidate_id", "source_id", F.col("note_id").alias("id"), "pitch", F.rint(F.col("start_s") * 100).cast("bigint").alias("start"), F.rint(F.col("end_s") * 100).cast("bigint").alias("end"), F.rint(F.col("confidence") * 10_000).cast("bigint").alias("confidence"))


RATIOS = ("voiced_ratio", "mean_confidence", "large_jump_ratio", "octave_jump_ratio", "score")


def segment_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality numbers of each candidate's notes."""
    return g.segment_quality(clean_notes(spark, folder), "candidate_id").withColumns({c: F.round(c, 6) for c in RATIOS})


def segment_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates accepted or rejected by their role's thresholds, with the reasons."""
    quality = segment_quality(spark, folder)
    roles = table(spark, folder, "candidates").select("candidate_id", "source_id").distinct().join(table(spark, folder, "sources").select("source_id", "role"), "source_id")
    return g.gate(quality.join(roles, "candidate_id"), "role").select("candidate_id", "role", "accepted", "reason")


def path_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's notes and the rests between them as runs of coarse states."""
    ev = melody_events(spark, folder)
    sound = ev.select("file_id", F.col("start_frame").alias("start"), F.col("end_frame").alias("end"), F.floor(F.col("pitch") / 12).cast("int").alias("state"), F.lit(False).alias("protected"))
    rest = ev.filter("gap_frames > 0").select("file_id", (F.col("start_frame") - F.col("gap_frames")).alias("start"), F.col("start_frame").alias("end"), F.lit(g.REST).alias("state"), (F.col("event_id") % 5 == 0).alias("protected"))
    return sound.unionByName(rest)


def bridge_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return g.bridge_gaps(path_runs(spark, folder), 20)


def path_to_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of the frame path; short ones only if strong."""
    ev = notes(spark, folder)
    frames = ev.select("file_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("frame"), F.floor(F.col("pitch") / 12).cast("int").alias("state"), F.col("amplitude").alias("confidence"), "amplitude", "start")
    frames = frames.select("file_id", "frame", "state", "confidence", (1 - F.col("amplitude")).alias("onset"), ((F.col("frame") == F.col("start")) & (F.col("amplitude") > 0.7)).alias("boundary"))
    found = g.path_to_notes(frames, 10, 4, 0.4, 0.3, 5)
    return found.withColumns({"confidence": F.round("confidence", 6), "onset": F.round("onset", 6)})


def covering_windows(spark: SparkSession, folder: str) -> DataFrame:
    durations = melody_events(spark, folder).groupBy("file_id").agg(F.max("end_frame").alias("duration"))
    return g.covering_windows(durations, WINDOW, OVERLAP)


def overlap_add(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse note amplitudes analysed window by window, each window a little louder, and added up again."""
    grid = g.note_grid(notes(spark, folder), 10).withColumnRenamed("amplitude", "value")
    windows = covering_windows(spark, folder)
    keyed = grid.withColumn("_last", F.floor(F.col("frame") * 10 / (WINDOW - OVERLAP)))
    # a frame lies in the window that begins last before it and, in the overlap, in the one before
    spread = keyed.withColumn("window", F.explode(F.array("_last", F.col("_last") - 1))).join(windows, ["file_id", "window"]).filter((F.col("frame") * 10 >= F.col("start")) & (F.col("frame") * 10 < F.col("end")))
    weight = g.edge_weight(F.col("frame") * 10 - F.col("start"), F.col("end") - F.col("start"), OVERLAP, F.col("is_first"), F.col("is_last"))
    added = g.overlap_add(spread.select("file_id", "frame", "pitch", (F.col("value") * (1 + F.col("window") / 100.0)).alias("value"), weight.alias("weight")))
    return added.withColumn("value", F.round("value", 6))


def posterior_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Coarse note grids of the event types as sources, fused."""
    sources = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))
    cells = notes(spark, folder).select("file_id", F.floor(F.col("start") / 400).alias("frame"), (F.col("pitch") % 12).alias("pitch"), F.coalesce(sources[F.col("channel")], F.lit("unlisted")).alias("source"), F.col("amplitude").alias("value"))
    best = cells.groupBy("file_id", "frame", "pitch", "source").agg(F.max("value").alias("value"))
    return g.fuse_sources(best).withColumn("value", F.round("value", 6))


#: Event types as posterior sources.
SOURCES = {"click": "vocals", "view": "mix", "purchase": "bass"}


def _dense(spark: SparkSession, folder: str) -> DataFrame:
    """Amplitude of each event by its number, one curve a file."""
    return notes(spark, folder).select("file_id", (F.col("file_id") % 2).alias("pitch"), F.col("id").alias("frame"), F.col("amplitude").alias("value"))


def onset_rises(spark: SparkSession, folder: str) -> DataFrame:
    return g.frame_rises(_dense(spark, folder)).withColumn("rise", F.round("rise", 6))


def onset_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return g.local_peaks(_dense(spark, folder), "value", 0.5)


def note_grid(spark: SparkSession, folder: str) -> DataFrame:
    return g.note_grid(notes(spark, folder), 20)


def _track(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a pitch track with holes."""
    return melody_events(spark, folder).select("file_id", F.col("seq").alias("frame"), F.when(F.col("event_id") % 4 > 0, F.col("midi_cents") / 100.0).alias("midi"))


def smoothed_track(spark: SparkSession, folder: str) -> DataFrame:
    return g.smoothed(_track(spark, folder), 2).withColumn("smooth", F.round("smooth", 6))


def filled_track(spark: SparkSession, folder: str) -> DataFrame:
    return g.fill_short_gaps(_track(spark, folder), 2, 20.0).withColumn("filled", F.round("filled", 6))


def beat_phases(spark: SparkSession, folder: str) -> DataFrame:
    """The bar phase of each file, its events taken as beats."""
    return keys.beat_phases(notes(spark, folder).select("file_id", (F.col("id") - 1).alias("beat"), F.col("amplitude").alias("strength"))).withColumn("score", F.round("score", 6))


def resampled_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's amplitudes brought to a number of frames of its own."""
    curves = _dense(spark, folder).withColumn("frame", F.col("frame") - 1)
    targets = curves.select("file_id", (F.col("file_id") % 90 + 1).alias("frames")).distinct()
    return g.resample_time(curves, targets).withColumn("value", F.round("value", 6))


_E = f"with {EVENT_SQL.strip()}"
_BEATS = "b as (select file_id, file_id % 4 as phase, unnest(range(ceil(max(end_frame) / 50)::bigint + 17)) as beat from ev group by file_id), bt as (select *, (beat - 4) * 50 + file_id % 11 as time from b), bars as (select file_id, (beat - phase) // 4 as bar, time from bt where beat >= phase and (beat - phase) % 4 = 0), w as (select file_id, bar + 1 as segment_index, (bar + 1)::integer as start_bar, (bar + 2)::integer as end_bar, time as start, lead(time, 2) over (partition by file_id order by bar) as \"end\" from bars)"
_QUALITY = """with n as (select distinct on (note_id) * from notes where pitch between 0 and 127 and confidence between 0 and 1 and not isnan(confidence)),
c as (select candidate_id, note_id, pitch, round_even(start_s * 100, 0)::bigint as s, round_even(end_s * 100, 0)::bigint as e, round_even(confidence * 10000, 0)::bigint as k from n),
j as (select *, abs(pitch - lag(pitch) over (partition by candidate_id order by s, note_id)) as jump, greatest(0, e - s) as len from c),
a as (select candidate_id, sum(len) as v, max(e) as d, sum(len * k) as w, count(jump) as jumps, count(*) filter (jump >= 8) as large, count(*) filter (jump in (12, 24)) as octave, count(*) as note_count from j group by all),
q as (select candidate_id, least(1, coalesce(v / nullif(d, 0), 0)) as voiced_ratio, coalesce(w / nullif(v * 10000, 0), 0) as mean_confidence, coalesce(large / nullif(jumps, 0), 0) as large_jump_ratio, coalesce(octave / nullif(jumps, 0), 0) as octave_jump_ratio, note_count from a),
r as (select *, 0.42 * least(1, mean_confidence) + 0.28 * least(1, voiced_ratio / 0.55) + 0.15 * least(1, note_count / 6) + 0.10 * (1 - large_jump_ratio) + 0.05 * (1 - octave_jump_ratio) as score from q),
z as (select candidate_id, note_count, round(voiced_ratio, 6) as voiced_ratio, round(mean_confidence, 6) as mean_confidence, round(large_jump_ratio, 6) as large_jump_ratio, round(octave_jump_ratio, 6) as octave_jump_ratio, round(score, 6) as score from r)"""
_WINDOWS = f"d as (select file_id, max(end_frame)::bigint as duration from ev group by 1), wn as (select file_id, duration, unnest(range(greatest(0, ceil((duration - {WINDOW}) / {WINDOW - OVERLAP}))::bigint + 1)) as win, greatest(0, ceil((duration - {WINDOW}) / {WINDOW - OVERLAP}))::bigint as last from d), cw as (select file_id, win, win * {WINDOW - OVERLAP} as s, least(duration, win * {WINDOW - OVERLAP} + {WINDOW}) as e, win = 0 as is_first, win = last as is_last from wn)"
_FADE = f"least({OVERLAP // 2}, (e - s) // 2)"
_GRID = "gr as (select file_id, pitch, frame, max(amp) as amp from (select file_id, pitch, (event_id % 100) / 100.0::double as amp, unnest(range((start_frame // {0})::bigint, greatest(start_frame // {0}, ceil(end_frame / {0}) - 1)::bigint + 1)) as frame from ev) group by all)"

QUERIES = {
    f.__name__: f
    for f in (bar_windows, notes_in_windows, segment_quality, segment_gate, bridge_gaps, path_to_notes, covering_windows, overlap_add, posterior_fusion, onset_rises, onset_peaks, note_grid, smoothed_track, filled_track, beat_phases, resampled_curves)
}
SQL = {
    "bar_windows": _E + f', {_BEATS} select * from w where "end" is not null',
    "notes_in_windows": _E + f', {_BEATS} select ev.file_id, seq as id, pitch, segment_index, greatest(start_frame, w.start) as start, least(end_frame, w."end") as "end" from ev join w on ev.file_id = w.file_id and end_frame > w.start and start_frame < w."end"',
    "segment_quality": _QUALITY + " select * from z",
    "segment_gate": _QUALITY + """, x as (select z.*, role from z join (select distinct candidate_id, source_id from candidates) using (candidate_id) join sources using (source_id)),
    y as (select *, case when role = 'bass' then concat_ws(';', case when score < 0.5 then 'score<0.50' end, case when voiced_ratio < 0.15 then 'voiced<0.15' end, case when mean_confidence < 0.3 then 'confidence<0.30' end, case when note_count < 2 then 'notes<2' end)
      else concat_ws(';', case when score < 0.58 then 'score<0.58' end, case when voiced_ratio < 0.18 then 'voiced<0.18' end, case when mean_confidence < 0.35 then 'confidence<0.35' end, case when note_count < 3 then 'notes<3' end) end as reason from x)
    select candidate_id, role, reason = '' as accepted, reason from y""",
    "bridge_gaps": _E + """, p as (select file_id, start_frame as s, end_frame as e, pitch // 12 as state, false as prot from ev union all select file_id, start_frame - gap_frames, start_frame, 128, event_id % 5 = 0 from ev where gap_frames > 0),
    q as (select *, lag(state) over w as l, lead(state) over w as r from p window w as (partition by file_id order by s)),
    f as (select file_id, s, e, state = 128 and e - s <= 20 and coalesce(l = r, false) and l <> 128 and not prot as br, l, state from q),
    g as (select *, case when br then l else state end as st from f),
    h as (select *, case when st = lag(st) over w and (br or lag(br) over w) then 0 else 1 end as fresh from g window w as (partition by file_id order by s)),
    k as (select *, sum(fresh) over (partition by file_id order by s rows unbounded preceding) as run from h)
    select file_id, st as state, min(s) as start, max(e) as "end" from k group by file_id, run, st""",
    "path_to_notes": _E + """, f as (select file_id, unnest(range(start_frame::bigint, end_frame::bigint)) as frame, pitch // 12 as state, (event_id % 100) / 100.0::double as amp, start_frame from ev),
    g as (select *, case when state = lag(state) over w and frame = lag(frame) over w + 1 and not (frame = start_frame and amp > 0.7) then 0 else 1 end as fresh from f window w as (partition by file_id order by frame)),
    r as (select *, sum(fresh) over (partition by file_id order by frame rows unbounded preceding) as run from g),
    h as (select *, min(frame) over (partition by file_id, run) as first from r),
    n as (select file_id, min(frame) as start, max(frame) + 1 as "end", first(state) as pitch, coalesce(avg(amp) filter (amp > 0), 0) as confidence, coalesce(max(1 - amp) filter (frame < first + 5), 0) as onset from h group by file_id, run)
    select file_id, start, "end", pitch, round(confidence, 6) as confidence, round(onset, 6) as onset from n where "end" - start >= 10 or ("end" - start >= 4 and confidence >= 0.4 and onset >= 0.3)""",
    "covering_windows": _E + f', {_WINDOWS} select file_id, win::integer as "window", s::integer as start, e as "end", is_first, is_last from cw',
    "overlap_add": _E + f""", {_WINDOWS}, {_GRID.format(10)}, x as (select gr.file_id, frame, pitch, amp * (1 + win / 100) as v, frame * 10 - s as o, e - s as len, {_FADE} as fade, is_first, is_last from gr join cw on gr.file_id = cw.file_id and frame * 10 >= s and frame * 10 < e),
    y as (select *, case when fade > 1 and not is_last and o >= len - fade then pow(sin(pi() / 2 * (len - 1 - o) / (fade - 1)), 2) when fade > 1 and not is_first and o < fade then pow(sin(pi() / 2 * o / (fade - 1)), 2) else 1 end as wt from x)
    select file_id, frame, pitch, round(coalesce(sum(v * wt) / nullif(sum(wt), 0), 0), 6) as value from y group by all""",
    "posterior_fusion": _E + """, c as (select file_id, start_frame // 400 as frame, pitch % 12 as pitch, case channel when 'click' then 0.94 when 'view' then 0.58 when 'purchase' then 0.86 else 0.8 end as trust, case when channel in ('click', 'view', 'purchase') then channel else 'unlisted' end as source, max((event_id % 100) / 100.0::double) as v from ev group by all),
    k as (select *, row_number() over (partition by file_id, frame, pitch order by v * trust desc) as k from c)
    select file_id, frame, pitch, round(least(1, max(v * trust) + 0.15 * coalesce(max(v * trust) filter (k = 2), 0)), 6) as value from k where k <= 2 group by all""",
    "onset_rises": _E + """, c as (select file_id, file_id % 2 as pitch, seq as frame, (event_id % 100) / 100.0::double as value from ev),
    r as (select *, case when lag(value, 2) over w is not null then greatest(0, least(value - lag(value) over w, value - lag(value, 2) over w)) else 0 end as x from c window w as (partition by file_id order by frame))
    select file_id, pitch, frame, value, round(case when max(x) over (partition by file_id) > 1e-12 then x / max(x) over (partition by file_id) else 0 end, 6) as rise from r""",
    "onset_peaks": _E + ", c as (select file_id, file_id % 2 as pitch, seq as frame, (event_id % 100) / 100.0::double as value, lag((event_id % 100) / 100.0::double) over w as a, lead((event_id % 100) / 100.0::double) over w as b from ev window w as (partition by file_id order by seq)) select file_id, pitch, frame, value from c where value >= 0.5 and value >= a and value >= b",
    "beat_phases": _E + """, b as (select file_id, seq - 1 as beat, (event_id % 100) / 100.0::double as s, lead((event_id % 100) / 100.0::double) over (partition by file_id order by seq) as nx from ev),
    p as (select file_id, beat % 4 as phase, avg(s) + 0.25 * coalesce(avg(s - nx), 0) as score from b group by all having count(*) >= 2)
    select file_id, arg_max(phase, (score, -phase))::integer as phase, round(max(score), 6) as score from p group by file_id""",
    "resampled_curves": _E + """, c as (select file_id, file_id % 2 as pitch, seq - 1 as frame, (event_id % 100) / 100.0::double as value from ev), z as (select file_id, max(frame) + 1 as n, file_id % 90 + 1 as m from c group by file_id),
    j as (select *, unnest(range(m)) as j from z), x as (select *, case when m = 1 then 0 else j * (n - 1) / (m - 1) end as x from j),
    k as (select *, floor(x + 1e-9)::bigint as lo from x)
    select k.file_id, a.pitch, j as frame, round(a.value + coalesce(b.value - a.value, 0) * (x - lo), 6) as value from k join c a on a.file_id = k.file_id and a.frame = lo left join c b on b.file_id = k.file_id and b.frame = lo + 1""",
    "note_grid": _E + f", {_GRID.format(20)} select file_id, pitch, frame, amp as amplitude from gr",
    "smoothed_track": _E + ", t as (select file_id, seq as frame, case when event_id % 4 > 0 then midi_cents / 100.0::double end as midi from ev) select *, round(case when midi is not null then median(midi) over (partition by file_id order by frame rows between 2 preceding and 2 following) end, 6) as smooth from t",
    "filled_track": _E + """, t as (select file_id, seq as frame, case when event_id % 4 > 0 then midi_cents / 100.0::double end as midi from ev),
    n as (select *, last_value(case when midi is not null then frame end ignore nulls) over a as lf, last_value(midi ignore nulls) over a as lm, first_value(case when midi is not null then frame end ignore nulls) over b as rf, first_value(midi ignore nulls) over b as rm from t
      window a as (partition by file_id order by frame rows between unbounded preceding and 1 preceding), b as (partition by file_id order by frame rows between 1 following and unbounded following))
    select file_id, frame, midi, round(coalesce(midi, case when rf - lf - 1 <= 2 and abs(rm - lm) <= 20 then lm + (rm - lm) * (frame - lf) / (rf - lf) end), 6) as filled from n""",
}
