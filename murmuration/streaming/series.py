"""The probe series as a stream: whole steps of a formation, checked against the step before, with the field where each craft is.

Rows may come in any order and over any number of runs. A key of state is a block of steps, not a craft, so keys grow with
the series and a block is small; the last step of a block is copied into the next one, which so judges its own first step.
A block's rows are held until all its steps are whole, then only a mark stays. The field is met by a stateless
stream-static join with a table of the eight corners of each cell. A run that ends, or is lost, goes on from its checkpoint.

Defined results: rows without step, label or a position take no part. A step counts once ``craft`` labels have come; rows
that repeat a label of a step, or come after it is whole, are left out. A step that never becomes whole is never written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stage
from ..operators import formation, grid
from ..sources.views import PROBE_ROWS

AT = ("wx", "wy", "wz")
COLUMNS = {"step": "long", "sc": "long", "label": "string", "time_seconds": "double", **dict.fromkeys(AT, "double")}
MARKED = ", ".join(["kind string", *[f"{c} {t}" for c, t in COLUMNS.items()]])
STATE = ", ".join(["done boolean", *[f"{c} array<{t}>" for c, t in COLUMNS.items()]])
WRITTEN = f"{MARKED}, v1 double, v2 double, v3 double"


def event_stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """``events`` as a stream, at most ``files`` files in a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/{{events.parquet}}")  # a pattern, since a stream's plain path can't be a single file


def probe_stream(events: DataFrame, box: Sequence[float]) -> DataFrame:
    """The rows of the probe series, in the periodic box."""
    rows = events.sparkSession.sql(PROBE_ROWS.replace("FROM events", "FROM {t}"), t=events)
    return formation.wrapped(rows, box).select(*COLUMNS)


def _whole(rows: pd.DataFrame, craft: int) -> set[int]:
    count = rows.groupby("step").size()
    return set(count[count >= craft].index)


def _judged(rows: pd.DataFrame, steps: list[int], box: Sequence[float], dt: float, atol: float) -> Iterator[pd.DataFrame]:
    """Of ``steps``, the craft whose wrapped path breaks after the step before, and those whose time isn't ``dt`` later."""
    before = rows.assign(step=rows["step"] + 1)[["step", "label", "time_seconds", *AT]]
    both = rows[rows["step"].isin(steps)].merge(before, on=["step", "label"], suffixes=("", "_before"))
    far = pd.Series(False, index=both.index)
    for p, b in zip(AT, box, strict=True):
        far |= (both[p] - both[f"{p}_before"]).abs() > b / 2
    late = (both["time_seconds"] - both["time_seconds_before"] - dt).abs() > atol
    yield both[far].assign(kind="break")
    yield both[late].assign(kind="late")


def whole_steps(rows: DataFrame, craft: int, box: Sequence[float], dt: float, block: int = 256, atol: float = 1e-9) -> DataFrame:
    """kind and the columns of ``rows``: 'sample' for each craft of a whole step; 'break' and 'late' where it doesn't follow from the step before."""

    def follow(key: tuple[int], chunks: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        start = key[0] * block
        held = state.get if state.exists else (False, *[[] for _ in COLUMNS])
        if held[0]:
            return
        old = pd.DataFrame(dict(zip(COLUMNS, held[1:], strict=True))).astype({c: {"long": "int64", "double": "float64"}.get(t, "object") for c, t in COLUMNS.items()})
        before, known, new = _whole(old, craft), pd.MultiIndex.from_frame(old[["step", "label"]]), old.iloc[:0]
        for chunk in chunks:
            chunk = chunk[list(COLUMNS)]
            chunk = chunk[~pd.MultiIndex.from_frame(chunk[["step", "label"]]).isin(known) & ~chunk["step"].isin(before)]
            # of rows that repeat a craft of a step, the least, so that their order in the batch doesn't tell
            new = (pd.concat([new, chunk]) if len(new) else chunk).sort_values(list(COLUMNS)).drop_duplicates(["step", "label"])
        every = pd.concat([old, new], ignore_index=True) if len(old) else new.reset_index(drop=True)
        after = _whole(every, craft)
        fresh = after - before
        samples = [every[every["step"].isin({s for s in fresh if s >= start})].assign(kind="sample")]
        ready = [s for s in after if s >= start and s - 1 in after and (s in fresh or s - 1 in fresh)]
        for out in [*samples, *_judged(every, ready, box, dt, atol)]:
            if len(out):
                yield out[["kind", *COLUMNS]]
        if len(after) == block + (start > 0):
            state.update((True, *[[] for _ in COLUMNS]))
        else:
            state.update((False, *[every[c].tolist() for c in COLUMNS]))

    known = rows.dropna(subset=["step", "label", *AT]).select(*COLUMNS)
    own = F.floor(F.col("step") / block)
    blocks = F.when(F.pmod("step", F.lit(block)) == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    return known.withColumn("block", F.explode(blocks)).groupBy("block").applyInPandasWithState(follow, MARKED, STATE, "append", "NoTimeout")


def with_field(marked: DataFrame, cells: DataFrame, box: Sequence[float], shape: Sequence[int]) -> DataFrame:
    """Samples with the field at their place, those without any corner left out; other kinds with nulls."""
    at = grid.at_corners(marked, cells, box, shape, AT)
    return at.where("kind <> 'sample' OR v1 IS NOT NULL OR v2 IS NOT NULL OR v3 IS NOT NULL").select("kind", *COLUMNS, *grid.VALUES)


def follow_series(rows: DataFrame, cells: DataFrame, craft: int, box: Sequence[float], shape: Sequence[int], dt: float, out: str, checkpoint: str, block: int = 256) -> None:
    """Read what is there now, from where ``checkpoint`` stands, and append to the Parquet table ``out``, a folder for each kind."""
    corners = stage(grid.corner_table(cells, shape), "corners")  # once, not for each micro-batch
    marked = with_field(whole_steps(rows, craft, box, dt, block), corners, box, shape)
    sink = marked.writeStream.format("parquet").partitionBy("kind").option("path", out).option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start().awaitTermination()


def written(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(WRITTEN).parquet(out)
