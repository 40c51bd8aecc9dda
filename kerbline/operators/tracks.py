"""Track cleaning, two-sided as-of interpolation, chainage and gaps.

Every operator works on one ordered scan per session; sessions larger than a
task's share are cut into chunks by `ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import geometry as G
from kerbline.operators.ordered import (
    KeyProfile,
    exact_quantiles,
    group_count,
    group_first,
    group_max,
    lag,
    last_valid,
    lead,
    next_valid,
    row_number,
    running_max,
    running_sum,
)

SESSION = "session_id"
TRACK_VALUES = ["lat", "lon", "alt_m", "speed_mps", "speed_kmh"]


def lerp(at: Column, lo: Column, hi: Column) -> Column:
    """Value at `at` between the points `lo` and `hi` (struct x, y), clamped at both ends."""
    span = hi["x"] - lo["x"]
    inner = lo["y"] + (hi["y"] - lo["y"]) * ((at - lo["x"]) / F.when(span != 0, span))
    return F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(F.coalesce(inner, lo["y"]))


def point(x: Column | str, y: Column | str) -> Column:
    """Struct (x, y), null where y is null."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when(y.isNotNull() & x.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def finalize_track(rows: DataFrame, source: str, approximate: bool = False, arrival: str = "point_id") -> DataFrame:
    """Relative time, filled and strictly ordered where needed; derived speed and heading.

    `rows`: session_id, arrival order, utc_ms, t, lat, lon, alt_m, speed_mps, heading_deg.
    """
    fixes = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    profile = KeyProfile.of(fixes, [SESSION])
    by_arrival = profile.layout(fixes, [arrival])
    numbered = by_arrival.scan(fixes, _rn=row_number(), _utc0=group_first("utc_ms"))
    known = F.coalesce(F.col("t").cast("double"), (F.col("utc_ms") - F.col("_utc0")) / 1000.0)
    numbered = numbered.withColumn("_i", (F.col("_rn") - 1).cast("double")).withColumn("_t", known)
    filled = by_arrival.scan(numbered, _lo=last_valid(point("_i", "_t")), _hi=next_valid(point("_i", "_t")))
    filled = filled.withColumn("_t", F.coalesce(lerp(F.col("_i"), F.col("_lo"), F.col("_hi")), F.col("_i")))
    # Which sessions stand still in time or repeat a time stamp: counts per time first, so that
    # one long session does not meet in one task.
    times = filled.groupBy(SESSION, F.bround("_t", 6).alias("_r")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_t").alias("lo"), F.max("_t").alias("hi")
    )
    stats = times.groupBy(SESSION).agg(
        (F.max("hi") - F.min("lo") <= 1e-9).alias("_still"), (F.max("n") > 1).alias("_repeats"), F.sum("n").alias("_size")
    )
    filled = filled.join(stats, SESSION)
    nudged = by_arrival.scan(filled, _nudged=running_max(F.col("_t") + F.col("_i") * 1e-6))
    t = (
        F.when(F.col("_size") == 1, F.col("_t"))
        .when(F.col("_still"), F.col("_i"))
        .when(F.col("_repeats"), F.col("_nudged"))
        .otherwise(F.col("_t"))
    )
    timed = nudged.select(SESSION, arrival, "utc_ms", t.alias("t"), "lat", "lon", "alt_m", "speed_mps", "heading_deg")
    kept = [arrival, "utc_ms", "alt_m", "speed_mps", "heading_deg"]
    once = timed.groupBy(SESSION, "t", "lat", "lon").agg(F.min_by(F.struct(*kept), arrival).alias("_r"))
    once = once.select(SESSION, "t", "lat", "lon", "_r.*")
    return _derive_motion(once, profile, arrival).select(
        SESSION,
        arrival,
        "t",
        "utc_ms",
        "lat",
        "lon",
        "alt_m",
        "speed_mps",
        (F.col("speed_mps") * 3.6).alias("speed_kmh"),
        "heading_deg",
        F.lit(source).alias("telemetry_source"),
        F.lit(approximate).alias("route_approximate"),
        F.lit(None).cast("string").alias("warning"),
        F.lit(vocab.MEASURED_ROUTE_NOTICE).alias("notice"),
    )


def _derive_motion(track: DataFrame, profile: KeyProfile, arrival: str) -> DataFrame:
    """Measured values are interpolated by row position; a session without any gets derived ones."""
    layout = profile.layout(track, ["t", arrival])
    here = F.struct("t", "lat", "lon")
    s = layout.scan(
        track, _rn=row_number(), _n=group_count(), _prev=lag(here), _next=lead(here),
        _any_speed=group_first("speed_mps"), _any_heading=group_first("heading_deg"),
    )
    i = F.col("_rn").cast("double")
    s = layout.scan(
        s.withColumn("_i", i),
        _s0=last_valid(point("_i", "speed_mps")), _s1=next_valid(point("_i", "speed_mps")),
        _h0=last_valid(point("_i", "heading_deg")), _h1=next_valid(point("_i", "heading_deg")),
    )

    def step(fn, a: Column, b: Column) -> Column:
        return fn(a["lat"], a["lon"], b["lat"], b["lon"])

    def speed(a: Column, b: Column) -> Column:
        dt = b["t"] - a["t"]
        metres = step(lambda *p: G.haversine_m(*p, vocab.EARTH_RADIUS_TRACK_M), a, b)
        return F.when(dt > 0, metres / dt).otherwise(F.lit(0.0))

    first = F.col("_prev").isNull()
    prev, nxt = F.col("_prev"), F.col("_next")
    derived_speed = F.when(first, speed(here, nxt)).otherwise(speed(prev, here))
    derived_heading = F.when(first, step(G.bearing_deg, here, nxt)).otherwise(step(G.bearing_deg, prev, here))
    single = F.col("_n") == 1
    out_speed = (
        F.when(single, F.coalesce("speed_mps", F.lit(0.0)))
        .when(F.col("_any_speed").isNull(), derived_speed)
        .otherwise(F.coalesce(lerp(F.col("_i"), F.col("_s0"), F.col("_s1")), F.lit(0.0)))
    )
    out_heading = (
        F.when(single, F.col("heading_deg"))
        .when(F.col("_any_heading").isNull(), derived_heading)
        .otherwise(F.pmod(lerp(F.col("_i"), F.col("_h0"), F.col("_h1")), F.lit(360.0)))
    )
    return s.withColumn("speed_mps", out_speed).withColumn("heading_deg", out_heading)


def unwrap_heading(track: DataFrame, order: Sequence[str] = ("t",), profile: KeyProfile | None = None) -> DataFrame:
    """Adds `heading_unwrapped`: headings joined without jumps, null where the heading is null."""
    layout = (profile or KeyProfile.of(track, [SESSION])).layout(track, list(order))
    s = layout.scan(track, _seen=last_valid("heading_deg"))
    s = layout.scan(s, _before=lag("_seen"))
    h, before = F.col("heading_deg"), F.col("_before")
    delta = F.when(h.isNotNull(), F.coalesce(G.fold_degrees(h - before), F.lit(0.0))).otherwise(F.lit(0.0))
    s = layout.scan(s.withColumn("_delta", delta), _turn=running_sum("_delta"), _h0=group_first("heading_deg"))
    return s.withColumn("heading_unwrapped", F.when(h.isNotNull(), F.col("_h0") + F.col("_turn"))).drop(
        "_seen", "_before", "_delta", "_turn", "_h0"
    )


def interpolate_track(
    samples: DataFrame, track: DataFrame, values: Sequence[str] = TRACK_VALUES, heading: bool = True,
    track_order: Sequence[str] = ("t",),
) -> DataFrame:
    """Each sample (session_id, t, ...) with every track column interpolated at its time.

    Samples and track points go through one sort per session; each column ignores
    its own nulls and is clamped outside its first and last point. Track points that
    share a time are told apart by the rest of `track_order`.
    """
    values = list(values)
    if heading:
        track = unwrap_heading(track, track_order)
        values = [*values, "heading_unwrapped"]
    others = [c for c in samples.columns if c not in (SESSION, "t")]
    tie = list(track_order)[1:]
    left = samples.select(
        SESSION, F.col("t").cast("double").alias("t"), F.lit(1).alias("_kind"),
        *[F.lit(None).cast(track.schema[c].dataType).alias(f"_tie_{c}") for c in tie],
        *others, *[F.lit(None).cast("double").alias(f"_v_{c}") for c in values],
    )
    types = dict(samples.dtypes)
    right = track.select(
        SESSION, F.col("t").cast("double").alias("t"), F.lit(0).alias("_kind"),
        *[F.col(c).alias(f"_tie_{c}") for c in tie],
        *[F.lit(None).cast(types[c]).alias(c) for c in others], *[F.col(c).cast("double").alias(f"_v_{c}") for c in values],
    )
    both = left.unionByName(right)
    layout = KeyProfile.of(both, [SESSION]).layout(both, ["t", "_kind", *[f"_tie_{c}" for c in tie]])
    ops = {}
    for c in values:
        ops[f"_lo_{c}"] = last_valid(point("t", f"_v_{c}"))
        ops[f"_hi_{c}"] = next_valid(point("t", f"_v_{c}"))
    found = layout.scan(both, **ops).where(F.col("_kind") == 1)
    cols = [lerp(F.col("t"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")).alias(c) for c in values]
    out = found.select(SESSION, "t", *others, *cols)
    if heading:
        out = out.withColumn("heading_deg", F.pmod(F.col("heading_unwrapped"), F.lit(360.0))).drop("heading_unwrapped")
    return out


def _lerp_nullable(a: Column, b: Column, share: Column) -> Column:
    return F.coalesce(a + (b - a) * share, a, b)


def attach_gps(frames: DataFrame, gps: DataFrame, values: Sequence[str] = ("alt_m", "speed_mps", "heading_deg"), tie: str | None = None) -> DataFrame:
    """Each frame (session_id, frame_index, utc_ms) with its bracketing fixes blended.

    A value missing on one side takes the other side; headings blend without
    unwrapping; at and beyond the last fix, and up to the first, that fix is taken whole.
    Fixes of one moment follow each other in the order of `tie`, a number of the fix.
    """
    whole = ["lat", "lon", *values]
    fix = F.struct("utc_ms", *whole)
    left = frames.select(SESSION, "frame_index", F.col("utc_ms"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_tie"))
    tied = (F.col(tie) if tie else F.lit(None)).cast("bigint").alias("_tie")
    nulls = [F.lit(None).cast("double").alias(c) for c in whole]
    right = gps.select(SESSION, F.lit(None).cast("bigint").alias("frame_index"), "utc_ms", F.lit(1).alias("_kind"), tied,
                       *[F.col(c).cast("double").alias(c) for c in whole])
    both = left.select("*", *nulls).unionByName(right)
    is_fix = F.col("_kind") == 1
    layout = KeyProfile.of(both, [SESSION]).layout(both, ["utc_ms", "_kind", "_tie"])
    s = layout.scan(
        both, _a=last_valid(F.when(is_fix, fix)), _b=next_valid(F.when(is_fix, fix)),
        _last=group_max(F.when(is_fix, F.col("utc_ms"))),
    ).where(~is_fix)
    a, b, now = F.col("_a"), F.col("_b"), F.col("utc_ms")
    only_b = a.isNull()
    only_a = b.isNull()
    at_last = ~only_b & ~only_a & (now >= F.col("_last"))
    span = F.greatest(F.lit(1), b["utc_ms"] - a["utc_ms"])
    share = F.least(F.greatest((now - a["utc_ms"]) / span, F.lit(0.0)), F.lit(1.0))
    cols = [
        F.when(only_b | at_last, b[c]).when(only_a, a[c]).otherwise(_lerp_nullable(a[c], b[c], share)).alias(c)
        for c in whole
    ]
    return s.select(SESSION, "frame_index", "utc_ms", *cols)


def nearest_sample(problems: DataFrame, samples: DataFrame) -> DataFrame:
    """Problem rows mapped to samples: same frame_index, else nearest time (earlier on a tie).

    `problems`: session_id, problem_id (order), frame_index, t, ...; `samples`: session_id,
    sample_order, frame_index, t. Returns `problems` plus `sample_order`.
    """
    exact = samples.where(F.col("frame_index").isNotNull()).groupBy(SESSION, "frame_index").agg(
        F.max("sample_order").alias("_exact")
    )
    tagged = problems.join(exact, [SESSION, "frame_index"], "left")
    lookups = tagged.where(F.col("_exact").isNull() & F.col("t").isNotNull())
    lookups = lookups.select(SESSION, "t", F.lit(0).alias("_kind"), F.col("problem_id").alias("_id"))
    points = samples.select(SESSION, "t", F.lit(1).alias("_kind"), F.col("sample_order").alias("_id"))
    both = lookups.unionByName(points)
    spot = F.when(F.col("_kind") == 1, F.struct(F.col("t").alias("t"), F.col("_id").alias("o")))
    s = KeyProfile.of(both, [SESSION]).layout(both, ["t", "_kind", "_id"]).scan(
        both, _a=last_valid(spot), _b=next_valid(spot)
    ).where(F.col("_kind") == 0)
    a, b = F.col("_a"), F.col("_b")
    closer_a = b.isNull() | (F.abs(a["t"] - F.col("t")) <= F.abs(b["t"] - F.col("t")))
    near = s.select(SESSION, F.col("_id").alias("problem_id"), F.when(a.isNotNull() & closer_a, a["o"]).otherwise(b["o"]).alias("_near"))
    joined = tagged.join(near, [SESSION, "problem_id"], "left")
    return joined.withColumn("sample_order", F.coalesce("_exact", "_near")).drop("_exact", "_near")


def overlay_problems(samples: DataFrame, mapped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample columns replaced by those of the last problem mapped onto it, where present."""
    last = mapped.where(F.col("sample_order").isNotNull()).groupBy(SESSION, "sample_order").agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in columns]), F.struct("t", "problem_id")).alias("_p")
    )
    joined = samples.join(last, [SESSION, "sample_order"], "left")
    kept = [c for c in samples.columns if c not in columns]
    return joined.select(*kept, *[F.coalesce(F.col("_p")[c], F.col(c)).alias(c) for c in columns], F.col("_p").isNotNull().alias("has_problem"))


def pair_measures(samples: DataFrame, order: Sequence[str], profile: KeyProfile | None = None) -> DataFrame:
    """Adds distance, time and speed-distance to the next sample, and the 0-based order."""
    layout = (profile or KeyProfile.of(samples, [SESSION])).layout(samples, list(order))
    here = F.struct("t", "lat", "lon", "speed_mps")
    s = layout.scan(samples, _rn=row_number(), _n=group_count(), _next=lead(here))
    nxt = F.col("_next")
    both = G.valid_fix(F.col("lat"), F.col("lon")) & G.valid_fix(nxt["lat"], nxt["lon"])
    metres = G.haversine_m(F.col("lat"), F.col("lon"), nxt["lat"], nxt["lon"], vocab.EARTH_RADIUS_STRIP_M)
    dt = nxt["t"] - F.col("t")

    def usable(v: Column) -> Column:
        return F.when(v >= 0, v)

    v0, v1 = usable(F.col("speed_mps")), usable(nxt["speed_mps"])
    mean = F.coalesce((v0 + v1) / 2, v0, v1)
    return (
        s.withColumn("sample_order", F.col("_rn") - 1)
        .withColumn("pair_distance_m", F.when(both, metres))
        .withColumn("pair_dt_s", dt)
        .withColumn("speed_distance_m", F.when(dt >= 0, mean * dt))
        .withColumnRenamed("_n", "sample_count")
        .drop("_rn", "_next")
    )


def session_medians(pairs: DataFrame, profile: KeyProfile | None = None) -> DataFrame:
    """Per session the medians behind chainage and gaps, and the chosen distance source."""
    def median(name: str, value: Column) -> DataFrame:
        rows = pairs.select(SESSION, value.alias("_v"))
        return exact_quantiles(rows, [SESSION], "_v", {name: 0.5}, profile)

    far = F.col("pair_distance_m")
    gps = median("gps_median", F.when(far > 0.05, far))
    spd = median("speed_median", F.when(F.col("speed_distance_m") > 0.05, F.col("speed_distance_m")))
    dts = median("dt_median", F.when(F.col("pair_dt_s") > 0, F.col("pair_dt_s")))
    base = pairs.select(SESSION).distinct()
    out = base.join(gps, SESSION, "left").join(spd, SESSION, "left").join(dts, SESSION, "left")
    source = F.when(F.col("gps_median") >= 0.2, "gps").when(F.col("speed_median").isNotNull(), "speed").otherwise("uniform")
    return out.withColumn("distance_source", source)


def chainage(pairs: DataFrame, medians: DataFrame, order: Sequence[str], profile: KeyProfile | None = None) -> DataFrame:
    """Running start and end metres per sample; null where the session has no distance source."""
    rows = pairs.join(medians, SESSION)
    source = F.col("distance_source")
    seg = F.when(source == "gps", F.coalesce("pair_distance_m", "speed_distance_m")).when(source == "speed", F.col("speed_distance_m"))
    rows = rows.withColumn("_seg", F.when(seg >= 0, seg))
    layout = (profile or KeyProfile.of(pairs, [SESSION])).layout(rows, list(order))
    s = layout.scan(rows, _end=running_sum(F.coalesce("_seg", F.lit(0.0))))
    known = source != "uniform"
    end = F.when(known, F.col("_end"))
    return s.withColumn("distance_end_m", end).withColumn(
        "distance_start_m", end - F.coalesce("_seg", F.lit(0.0))
    ).drop("_seg", "_end")


def gap_markers(pairs: DataFrame, medians: DataFrame) -> DataFrame:
    """Pairs that break the track in time or space, with the reason."""
    rows = pairs.where(F.col("sample_order") < F.col("sample_count") - 1).join(medians, SESSION)
    # A zero median counts as missing here, as an empty one does.
    typical = F.coalesce(F.when(F.col("gps_median") != 0, F.col("gps_median")), F.col("speed_median"), F.lit(0.0))
    far = F.col("pair_distance_m") > F.greatest(F.lit(25.0), typical * 5.0)
    typical_dt = F.coalesce(F.when(F.col("dt_median") != 0, F.col("dt_median")), F.lit(1.0))
    late = F.col("pair_dt_s") > F.greatest(F.lit(5.0), typical_dt * 3.0)
    reason = F.concat_ws("+", F.when(late, F.lit("time_gap")), F.when(far, F.lit("gps_gap")))
    return rows.withColumn("reason", reason).where(F.length("reason") > 0)


def sample_boundaries(centers: DataFrame, order: Sequence[str], height: int, profile: KeyProfile | None = None) -> DataFrame:
    """Adds `y0`, `y1`: half-even midpoints, strictly increasing and inside the height.

    Shifting each boundary by its index turns "at least one more than the previous"
    into a running maximum, and the reserve for the remaining samples into a constant cap.
    """
    layout = (profile or KeyProfile.of(centers, [SESSION])).layout(centers, list(order))
    s = layout.scan(centers, _rn=row_number(), _n=group_count(), _prev=lag("center"))
    i = F.col("_rn") - 1
    mid = F.rint((F.col("_prev") + F.col("center")) / 2.0).cast("bigint")
    fits = F.lit(height) >= F.col("_n")
    shift = F.when(fits, i).otherwise(F.lit(0))
    s = layout.scan(s.withColumn("_m", F.when(i == 0, F.lit(0)).otherwise(mid - shift)), _top=running_max("_m"))
    start = F.when(fits, F.least(F.greatest(F.col("_top"), F.lit(0)), height - F.col("_n")) + i).otherwise(F.col("_top"))
    s = layout.scan(s.withColumn("y0", start.cast("bigint")), _y1=lead("y0"))
    return s.withColumn("y1", F.coalesce("_y1", F.lit(max(1, height))).cast("bigint")).drop("_rn", "_n", "_prev", "_m", "_top", "_y1")


def every_nth(rows: DataFrame, order: Sequence[str], target: int = 2000, profile: KeyProfile | None = None) -> DataFrame:
    layout = (profile or KeyProfile.of(rows, [SESSION])).layout(rows, list(order))
    s = layout.scan(rows, _rn=row_number(), _n=group_count())
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return s.where((F.col("_rn") - 1) % step == 0).drop("_rn", "_n")


def evenly_spaced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], picks: int = 4) -> DataFrame:
    """`picks` rows per group at int(i * (n - 1) / (picks - 1)); all rows of smaller groups."""
    s = KeyProfile.of(rows, keys).layout(rows, list(order)).scan(rows, _rn=row_number(), _n=group_count())
    i = F.col("_rn") - 1
    spots = F.array(*[F.floor(F.lit(k) * (F.col("_n") - 1) / (picks - 1)) for k in range(picks)])
    keep = (F.col("_n") < picks) | F.array_contains(spots, i)
    return s.where(keep).drop("_rn", "_n")


def start_points(track: DataFrame) -> DataFrame:
    """First fix of each session by time; null columns for a session without one."""
    ok = G.has_fix(F.col("lat"), F.col("lon"))
    first = F.min_by(F.struct("lat", "lon", "alt_m"), F.when(ok, F.struct("t", "point_id"))).alias("s")
    return track.groupBy(SESSION).agg(first, F.count_if(ok).alias("fixes")).select(
        SESSION, *[F.when(F.col("fixes") > 0, F.col(f"s.{c}")).alias(c) for c in ("lat", "lon", "alt_m")]
    )


def no_fix_timeline(sessions: DataFrame, duration: str = "duration_s") -> DataFrame:
    """1 Hz rows without position, plus a final row at the duration."""
    d = F.greatest(F.col(duration).cast("double"), F.lit(0.0))
    last = F.floor(d + 1e-6)
    grid = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: i.cast("double"))
    times = F.when(last.cast("double") < d, F.concat(grid, F.array(d))).otherwise(grid)
    none = F.lit(None).cast("double")
    return sessions.select(
        SESSION, F.explode(times).alias("t"), none.alias("lat"), none.alias("lon"),
        F.lit(0.0).alias("speed_mps"), F.lit(0.0).alias("speed_kmh"), none.alias("heading_deg"),
        F.lit("no_gps").alias("telemetry_source"), F.lit(False).alias("route_approximate"),
        F.lit(vocab.NO_GPS_NOTICE).alias("notice"),
    )


# --- fixed values: families of position sources, in the order they are tried ---
SOURCE_FAMILIES = {"sidecar": ["sidecar", "track_json", "gpx"], "embedded": ["embedded"], "imu": ["imu"]}
# --- end of fixed values ---


def choose_source(candidates: DataFrame, explicit: DataFrame, keys: Sequence[str], hint: str = "auto") -> DataFrame:
    """The position source of each recording under a hint: `source_type`, `rows`, `problem`.

    `candidates`: keys, source_type, rows. Without a hint the families sidecar, embedded
    and imu are tried in turn; a hint leaves only its own family, `none` leaves nothing.
    `explicit` (keys, source_type, rows; at most one row per recording) names a file that
    replaces the search: it is used under `auto`, under `sidecar`, and always when it is a
    sidecar itself or of the hinted family; otherwise, and where a hinted family is
    missing, `problem` says so and the source is `none`.
    """
    if hint not in ("auto", "none", *SOURCE_FAMILIES):
        raise ValueError(f"unknown source hint {hint}")
    family = {x: f for f, names in SOURCE_FAMILIES.items() for x in names}
    order = [x for f, names in SOURCE_FAMILIES.items() if hint in ("auto", f) for x in names]
    everyone = candidates.select(*keys).unionByName(explicit.select(*keys)).distinct()
    if hint == "none":
        return everyone.select(*keys, F.lit("none").alias("source_type"), F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("string").alias("problem"))
    found = prefer_source(candidates, keys, order).select(*keys, F.col("source_type").alias("_type"), F.col("rows").alias("_rows"))
    named = explicit.select(*keys, F.col("source_type").alias("_own"), F.col("rows").alias("_own_rows"))
    j = everyone.join(found, list(keys), "left").join(named, list(keys), "left")
    fits = F.lit(hint in ("auto", "sidecar")) | F.col("_own").isin([x for x, f in family.items() if f in ("sidecar", hint)])
    own, missing = F.col("_own").isNotNull(), F.coalesce("_type", F.lit("none")) == "none"
    problem = F.when(own & ~fits, F.lit(f"explicit source does not fit {hint}")).when(~own & missing & F.lit(hint != "auto"), F.lit(f"no usable {hint} source"))
    kind = F.when(own, F.when(fits, F.col("_own"))).otherwise(F.col("_type"))
    rows = F.when(own, F.when(fits, F.col("_own_rows"))).otherwise(F.col("_rows"))
    return j.select(*keys, F.coalesce(kind, F.lit("none")).alias("source_type"), F.coalesce(rows, F.lit(0)).cast("bigint").alias("rows"), problem.alias("problem"))


def prefer_source(candidates: DataFrame, keys: Sequence[str], priorities: Sequence[str], hint: str | None = None) -> DataFrame:
    """Best candidate source with at least one row per recording, `none` without any.

    A forced hint keeps only that source and raises where it is missing.
    """
    rank = F.array_position(F.array(*map(F.lit, priorities)), F.col("source_type"))
    usable = (F.col("rows") > 0) & (rank > 0)
    if hint:
        usable = usable & (F.col("source_type") == hint)
    best = candidates.groupBy(*keys).agg(
        F.min_by(F.struct("source_type", "rows"), F.when(usable, rank)).alias("b"), F.count_if(usable).alias("n")
    )
    chosen = F.when(F.col("n") > 0, F.col("b.source_type"))
    if hint and hint != "none":
        chosen = F.coalesce(chosen, F.raise_error(F.lit(f"no usable {hint} source")))
    return best.select(*keys, F.coalesce(chosen, F.lit("none")).alias("source_type"),
                       F.when(F.col("n") > 0, F.col("b.rows")).otherwise(0).alias("rows"))
