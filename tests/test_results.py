"""Result documents: valid JSON with every table, NaN as null, empty tables as empty lists, arrays beside it."""

import json

from murmuration.functions.tables import new_path
from murmuration.sinks import tables


def test_a_result_is_a_document_and_arrays(spark):
    rows = spark.createDataFrame([(2, float("nan"), 'a "quoted" one'), (1, 0.1, None)], "k int, v double, t string")
    many, path = spark.range(1000), new_path(spark, "result")
    tables.write_result(path, {"rows": (rows, ["k"]), "none": (rows.where("k > 5"), ["k"])}, {"many": many}, title='of "two" parts', dt=0.5)
    said = [json.loads(r[0]) for r in spark.read.text(f"{path}/document").collect()]
    want = {"about": {"arrays": "many", "title": 'of "two" parts', "dt": 0.5}, "none": [], "rows": [{"k": 1, "v": 0.1, "t": None}, {"k": 2, "v": None, "t": 'a "quoted" one'}]}
    assert said == [want]
    assert spark.read.parquet(f"{path}/many").count() == 1000
