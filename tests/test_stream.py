"""The series as a stream: equal to the batch, in any order of files, over a restart, with repeated and broken rows."""

import tempfile

import pytest
from pyspark.sql import functions as F

from murmuration.functions.tables import new_path
from murmuration.operators import formation, grid
from murmuration.sources.views import BOX, DT, SHAPE, field_grid, probe_series
from murmuration.streaming import series

D = "/root/testdata/sf0.001"


def _follow(spark, folder, out, state, block=64):
    rows = series.probe_stream(series.event_stream(spark, folder, files=1), BOX)
    series.follow_series(rows, field_grid(spark, D), 9, BOX, SHAPE, DT, out, state, block)
    return series.written(spark, out)


def test_a_stream_that_restarts_gives_what_the_batch_gives(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    events, target = spark.read.parquet(f"{D}/events.parquet"), f"{folder}/events.parquet"
    out, state = new_path(spark, "series"), new_path(spark, "series-state")
    events.where("event_id % 5 IN (1, 4)").coalesce(1).write.mode("append").parquet(target)
    events.where("event_id % 5 = 0 AND event_id >= 300").coalesce(1).write.mode("append").parquet(target)
    some = _follow(spark, folder, out, state).where("kind = 'sample'").count()
    assert some == 0  # each step still lacks craft
    events.where("event_id % 5 = 3").coalesce(1).write.mode("append").parquet(target)
    events.where("event_id % 5 = 2 OR event_id < 300").coalesce(1).write.mode("append").parquet(target)  # ids below 300 come again
    rows = _follow(spark, folder, out, state).cache()
    points = formation.wrapped(probe_series(spark, D), BOX).select("step", "sc", *[F.col(f"w{p}").alias(p) for p in "xyz"])
    want = grid.sample_trilinear(points, field_grid(spark, D), ["step", "sc"], BOX, SHAPE)
    shown = lambda df: sorted((r.step, r.sc, round(r.v1, 4), round(r.v2, 6), round(r.v3, 6)) for r in df.collect())
    assert shown(rows.where("kind = 'sample'")) == shown(want) and want.count() > 900
    breaks = formation.path_breaks(formation.wrapped(probe_series(spark, D), BOX), BOX)
    pairs = lambda df: sorted((r.step, r.label) for r in df.collect())
    assert pairs(rows.where("kind = 'break'")) == pairs(breaks) and breaks.count() > 0
    assert rows.where("kind = 'late'").count() == 0
    events.where("event_id < 700").coalesce(1).write.mode("append").parquet(target)
    assert _follow(spark, folder, out, state).count() == rows.count()  # repeats of blocks that are done and of one that isn't


def test_late_steps_nulls_and_repeats(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    at = lambda step, label, t, x=1.0: (step, 0, label, t, x, 1.0, 1.0)
    rows = [at(s, c, s * 1.0 + (0.5 if s >= 3 else 0)) for s in range(6) for c in "HN"]
    rows += [at(2, "H", 2.0, 7.0), at(None, "H", 0.0), at(7, None, 7.0), at(8, "H", 8.0, None), at(8, "N", 8.0), at(4, "X", 4.5)]
    schema = ", ".join(f"{c} {t}" for c, t in series.COLUMNS.items())
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/rows")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/rows")
    out = f"{folder}/out"
    marked = series.whole_steps(stream, 2, (10.0, 10.0, 10.0), 1.0, block=2)
    marked.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    got = [(r.kind, r.step, r.label, r.wx) for r in spark.read.schema(series.MARKED).parquet(out).collect()]
    assert sorted(g[1:] for g in got if g[0] == "sample" and g[2] != "X") == sorted((s, c, 1.0) for s in range(6) for c in "HN")
    assert sorted(g[1:3] for g in got if g[0] == "late") == [(3, "H"), (3, "N")]
    assert not [g for g in got if g[0] == "break"]


def test_a_method_that_is_unknown(spark):
    with pytest.raises(ValueError, match="nearest, trilinear"):
        grid.sample("cubic", None, None, [], BOX, SHAPE)
