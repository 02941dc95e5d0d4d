"""Power of planes of a regular grid: the two-dimensional transform as lines along one axis, then lines along the other.

A line is one row's array, so a task holds a batch of lines, never a plane.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = 256


def along(rows: DataFrame, keys: Sequence[str], axis: str, length: int, out: str, parts: Sequence[str]) -> DataFrame:
    """(keys, out, parts): the transform of every line along ``axis``; ``parts`` are real and imaginary parts in turn, missing places are 0."""
    lines = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).alias("at"), *parts)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), LINES):
                b = whole.slice(first, LINES)
                line = b.column("line")
                of = np.repeat(np.arange(len(b)), np.diff(line.offsets.to_numpy()))
                cells = line.flatten()
                at = cells.field("at").to_numpy()
                cols = []
                for k in range(0, len(parts), 2):
                    z = np.zeros((len(b), length), complex)
                    z[of, at] = cells.field(parts[k]).to_numpy() + 1j * cells.field(parts[k + 1]).to_numpy()
                    f = np.fft.fft(z, axis=1).ravel()
                    cols += [pa.array(f.real), pa.array(f.imag)]
                keep = [b.column(k).take(pa.array(np.repeat(np.arange(len(b)), length))) for k in keys]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(np.tile(np.arange(length), len(b))), *cols], [*keys, out, *parts])

    return lines.mapInArrow(run, ", ".join([*[f"{k} long" for k in keys], f"{out} long", *[f"{p} double" for p in parts]]))


def plane_power(grid: DataFrame, shape: Sequence[int], values: Sequence[str] = ("v1", "v2")) -> DataFrame:
    """(iz, kx, ky, power): the summed squared moduli of the values' transforms on each z plane, without bins."""
    parts = [f"{v}_{p}" for v in values for p in ("re", "im")]
    start = [c for v in values for c in (F.coalesce(F.col(v), F.lit(0.0)).cast("double").alias(f"{v}_re"), F.lit(0.0).alias(f"{v}_im"))]
    rows = grid.select(*[F.col(c).cast("long").alias(c) for c in ("ix", "iy", "iz")], *start)
    rows = along(rows, ["iy", "iz"], "ix", shape[0], "kx", parts)
    rows = along(rows, ["kx", "iz"], "iy", shape[1], "ky", parts)
    return rows.select("iz", "kx", "ky", sum((F.col(p) * F.col(p) for p in parts), F.lit(0.0)).alias("power"))
