"""Results as files: series as CSV or Parquet, rows as JSON lines, small tables as one JSON document."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite


def without_nan(rows: DataFrame) -> DataFrame:
    """Doubles that JSON can't say (NaN, infinities) become null."""
    return rows.select(*[F.when(finite(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])


def write_series(series: DataFrame, path: str, form: str = "csv", steps: int | None = None) -> None:
    """A series as files; with ``steps``, a folder for each run of so many steps, so a reader of some steps opens few files."""
    if form not in ("csv", "parquet"):
        raise ValueError("form must be csv or parquet")
    if steps:
        writer = series.withColumn("run", F.floor(F.col("step") / steps)).repartition("run").sortWithinPartitions("step").write.partitionBy("run")
    else:
        writer = series.write
    writer.option("header", True).format(form).save(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """JSON lines, one object a row; nulls are written, NaN becomes null."""
    without_nan(rows).write.option("ignoreNullFields", False).json(path)


def document(rows: DataFrame, order: list[str], **about: str | float | int) -> DataFrame:
    """One row, one column ``json``: {"about": {...}, "rows": [...]}, rows by ``order``. For results of a row per bin or metric."""
    cells = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*rows.columns).alias("row"))))
    body = [F.transform(cells, lambda r: r["row"]).alias("rows")]
    if about:
        body.insert(0, F.struct(*[F.lit(v).alias(k) for k, v in about.items()]).alias("about"))
    return without_nan(rows).agg(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("json"))


def sections(parts: dict[str, tuple[DataFrame, list[str]]], **about: str | float | int) -> DataFrame:
    """One row, one column ``json``: {"about": {...}, name: [...], ...}, the rows of each small table by its order."""
    body = F.get_json_object("json", "$.rows")
    each = [document(rows, order).select(F.lit(name).alias("name"), body.alias("body")) for name, (rows, order) in parts.items()]
    whole = reduce(DataFrame.unionByName, each)
    members = F.transform(F.sort_array(F.collect_list(F.struct("name", "body"))), lambda m: F.concat(F.lit('"'), m["name"], F.lit('":'), m["body"]))
    return whole.agg(F.concat(F.lit(f'{{"about":{json.dumps(about)},'), F.array_join(members, ","), F.lit("}")).alias("json"))


def write_result(path: str, parts: dict[str, tuple[DataFrame, list[str]]], arrays: dict[str, DataFrame], **about: str | float | int) -> None:
    """A result as a folder: tables of a bounded size in one JSON document, those that grow with the series as Parquet beside it."""
    for name, rows in arrays.items():
        rows.write.parquet(f"{path}/{name}")
    sections(parts, arrays=", ".join(arrays), **about).write.text(f"{path}/document")
