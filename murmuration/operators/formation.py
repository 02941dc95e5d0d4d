"""Formations: hub-relative vectors, placing and scaling, motion through a periodic box, nearest-time lookups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import wrap

FILL = -1e30


def valid_craft(rows: DataFrame, position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    for p in position:
        rows = rows.where(F.col(p) > FILL)
    return rows.where(F.col("label") != "N/A")


def hub_relative(rows: DataFrame, key: str, position: Sequence[str] = ("x", "y", "z"), hub: str = "H") -> DataFrame:
    """Each craft's vector from the hub of the same key."""
    h = rows.where(F.col("label") == hub).select(key, *[F.col(p).alias(f"h_{p}") for p in position])
    return rows.join(h, key).select(key, "label", *[(F.col(p) - F.col(f"h_{p}")).alias(f"rel_{p}") for p in position])


def place_in_box(rows: DataFrame, key: str, scale: float, box: Sequence[float], position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Lengths divided by ``scale`` and the centroid of each key moved to the box's centre."""
    if scale <= 0 or any(b <= 0 for b in box):
        raise ValueError("scale and box must be positive")
    w = Window.partitionBy(key)
    return rows.select(key, "label", *[(F.col(p) / scale - F.avg(F.col(p) / scale).over(w) + b / 2).alias(p) for p, b in zip(position, box, strict=True)])


def scale_to_box(rows: DataFrame, key: str, position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Centred, scaled so that the largest coordinate reaches 0.45, moved into the unit box and clipped."""
    w = Window.partitionBy(key)
    rows = rows.select(key, "label", *[(F.col(p) - F.avg(p).over(w)).alias(p) for p in position])
    most = F.max(F.greatest(*[F.abs(p) for p in position])).over(w)
    rows = rows.withColumn("__most", most)
    put = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("__most") > 0, F.col(p) * 0.45 / F.col("__most")).otherwise(0.0) + 0.5))
    return rows.select(key, "label", *[put(p).alias(p) for p in position])


def moving(formation: DataFrame, steps: int, dt: float, velocity_km_s: Sequence[float], rho_km: float, box: Sequence[float]) -> DataFrame:
    """Positions of a formation (label, x, y, z) at each step, unwrapped (u) and in the periodic box (w)."""
    if steps <= 0 or dt <= 0 or rho_km <= 0 or any(b <= 0 for b in box):
        raise ValueError("steps, dt, rho and box must be positive")
    t = formation.sparkSession.range(steps).select(F.col("id").alias("step"), (F.col("id") * F.lit(dt)).alias("time_seconds"))
    rows = t.crossJoin(F.broadcast(formation))
    for p, v in zip("xyz", velocity_km_s, strict=True):
        rows = rows.withColumn(f"u{p}", F.col(p) + F.lit(v / rho_km) * F.col("time_seconds"))
    return wrapped(rows, box).drop("x", "y", "z")


def wrapped(rows: DataFrame, box: Sequence[float]) -> DataFrame:
    for p, b in zip("xyz", box, strict=True):
        rows = rows.withColumn(f"w{p}", wrap(F.col(f"u{p}"), b))
    return rows


def path_breaks(rows: DataFrame, box: Sequence[float]) -> DataFrame:
    """Steps where a wrapped path is more than half the box away, on some axis, from where it was a step before."""
    before = rows.select("label", (F.col("step") + 1).alias("step"), *[F.col(f"w{p}").alias(f"__{p}") for p in "xyz"])
    jump = F.lit(False)
    for p, b in zip("xyz", box, strict=True):
        jump = jump | (F.abs(F.col(f"w{p}") - F.col(f"__{p}")) > b / 2)
    return rows.join(before, ["label", "step"]).where(jump).select("step", "label")


def selected(rows: DataFrame, labels: Sequence[str] | None, hub: str = "H", need_hub: bool = True) -> DataFrame:
    """The rows of some craft; repeated labels, labels that no row has, and a choice without the hub are errors."""
    if labels is None:
        return rows
    if len(set(labels)) != len(labels):
        raise ValueError("labels repeat")
    if need_hub and hub not in labels:
        raise ValueError(f"the subset must include {hub}")
    known = {r[0] for r in rows.where(F.col("label").isin(list(labels))).select("label").distinct().collect()}
    if known != set(labels):
        raise ValueError(f"unknown labels {sorted(set(labels) - known)}")
    return rows.where(F.col("label").isin(list(labels)))


def completeness(rows: DataFrame, value: Sequence[str]) -> DataFrame:
    """One row: rows, steps, labels, missing (step, label) pairs, repeated ones, values that are null or NaN, and whether all is well."""
    bad = F.lit(False)
    for v in value:
        bad = bad | F.col(v).isNull() | F.isnan(F.col(v).cast("double"))
    per = rows.groupBy("step", "label").agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad"))
    sizes = rows.select("step").distinct().agg(F.count(F.lit(1)).alias("steps")).crossJoin(rows.select("label").distinct().agg(F.count(F.lit(1)).alias("labels")))  # a row each
    sums = per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pairs"), F.count_if("bad").alias("bad_values")).crossJoin(sizes)
    missing, repeated = F.col("steps") * F.col("labels") - F.col("pairs"), F.col("rows") - F.col("pairs")
    whole = (missing == 0) & (repeated == 0) & (F.col("bad_values") == 0)
    return sums.select("rows", "steps", "labels", missing.alias("missing"), repeated.alias("repeated"), "bad_values", F.coalesce(whole, F.lit(False)).alias("complete"))


def position_check(rows: DataFrame, origin: DataFrame, velocity: Sequence[float], dt: float, atol: float = 1e-9) -> DataFrame:
    """Per label: steps, steps whose time isn't step * dt, and steps whose position isn't that of ``origin`` moved on."""
    o = F.broadcast(origin.select("label", *[F.col(p).alias(f"o_{p}") for p in "xyz"]))  # one row per craft
    off = F.lit(False)
    for p, v in zip("xyz", velocity, strict=True):
        off = off | (F.abs(F.col(f"u{p}") - (F.col(f"o_{p}") + F.lit(v) * F.col("time_seconds"))) > atol)
    late = F.abs(F.col("time_seconds") - F.col("step") * F.lit(dt)) > atol
    return rows.join(o, "label").groupBy("label").agg(F.count(F.lit(1)).alias("steps"), F.count_if(late).alias("off_time"), F.count_if(off).alias("off_path"))


#: Formats of requested times, with a blank or a T between date and time (fixed values).
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH")


def parse_time(text: Column) -> Column:
    """A requested time from its text: the hour, with minutes and seconds if given; null if it is none of TIME_FORMATS."""
    plain = F.regexp_replace(F.trim(text), "T", " ")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS])


def time_index(steps: int, dt: float, index: int | None = None, seconds: float | None = None) -> int:
    """The step that is asked for, by its number or by the nearest time (the earlier on a tie), not both; the first by default."""
    if index is not None and seconds is not None:
        raise ValueError("ask for a step or for seconds, not both")
    if seconds is not None:
        low = min(max(math.floor(seconds / dt), 0), steps - 1)
        index = low if abs(low * dt - seconds) <= abs(min(low + 1, steps - 1) * dt - seconds) else low + 1
    index = index or 0
    if not 0 <= index < steps:
        raise ValueError(f"step {index} is not among {steps}")
    return index


def nine_craft(formation: DataFrame, hub: str = "H", craft: int = 9) -> DataFrame:
    """The formation, if it has exactly ``craft`` craft, each once, and the hub among them."""
    n, distinct, hubs = formation.agg(F.count(F.lit(1)), F.count_distinct("label"), F.count_if(F.col("label") == hub)).first()
    if (n, distinct, hubs) != (craft, craft, 1):
        raise ValueError(f"a run needs {craft} craft with {hub}; there are {n} rows of {distinct} labels")
    return formation


def nearest_time(rows: DataFrame, time: str, requested) -> DataFrame:
    """The row nearest to a time, the earlier on a tie: a top-1, no full sort."""
    return rows.withColumn("apart", F.abs(F.unix_micros(time) - F.unix_micros(F.lit(requested).cast("timestamp")))).orderBy("apart", time).limit(1)


def asof_nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, bucket: str = "day") -> DataFrame:
    """The nearest right time of each left time, the earlier on a tie.

    Last time before and first time after, by windows within a bucket of time; what lies beyond a bucket's ends comes
    from the buckets' own first and last times, a table of one row per bucket.
    """
    b = lambda c: F.date_trunc(bucket, c)
    right = right.select(F.col(right_time).alias("t")).distinct()
    ends = right.groupBy(b("t").alias("b")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    marks = right.select(F.col("t"), F.lit(None).cast("timestamp").alias("q")).unionByName(left.select(F.col(left_time).alias("q")).distinct().select(F.lit(None).cast("timestamp").alias("t"), "q"))
    marks = marks.withColumn("at", F.coalesce("t", "q")).withColumn("b", b(F.coalesce("t", "q")))
    edge = marks.select("b").distinct().join(ends, "b", "left")
    prior = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("b", F.last("hi", True).over(prior).alias("before"), F.last("lo", True).over(later).alias("after"))
    # both ways from the start of an order: a frame that runs to the end is gone through anew for each row
    past, future = (F.last("t", True).over(Window.partitionBy("b").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.asc("at"), F.desc("at")))
    near = marks.select("b", "q", past.alias("p"), future.alias("f")).where("q IS NOT NULL").join(edge, "b")
    near = near.withColumn("p", F.coalesce("p", "before")).withColumn("f", F.coalesce("f", "after"))
    us = F.unix_micros
    pick = F.when(F.col("f").isNull() | (us("q") - us("p") <= us("f") - us("q")), F.coalesce("p", "f")).otherwise(F.col("f"))
    return near.select(F.col("q").alias(left_time), pick.alias(right_time))
