"""Unranked combinations, the stored pair product, running totals and sampling experiments."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from murmuration.functions.order import running_total
from murmuration.operators import cascade, formation, reconstruct


@pytest.mark.parametrize("n", [4, 5, 12, 31])
def test_unranking_gives_every_combination_once(n):
    got = np.stack(cascade.unranked(np.arange(math.comb(n, 4))), 1).tolist()
    assert got == sorted(map(list, itertools.combinations(range(n), 4)), key=lambda c: c[::-1])


def test_unranking_far_out():
    rank = np.array([math.comb(20_000, 4) - 1, math.comb(15_000, 4)])
    assert [c.tolist() for c in cascade.unranked(rank)] == [[19_996, 0], [19_997, 1], [19_998, 2], [19_999, 15_000]]


def test_combinations_need_no_join(spark):
    points = spark.createDataFrame([(3 * p,) for p in range(9)], "pid long")
    rows = cascade.combinations(points)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in rows.collect()) == sorted(itertools.combinations(range(0, 27, 3), 4))
    assert cascade.combinations(points.limit(3)).count() == 0


def test_stored_pairs_are_read_by_their_folders(spark, tmp_path):
    labels = ["H", "N1", "N2", "N3"]
    rows = [(t, i, j, f"{labels[i]}__{labels[j]}", float(t + i)) for t in range(40) for i in range(4) for j in range(i + 1, 4)]
    path = str(tmp_path / "pairs")
    cascade.write_elsasser_pairs(spark.createDataFrame(rows, "step long, i long, j long, pair string, l1 double"), path, run=8)
    some = cascade.read_elsasser_pairs(spark, path, ["H", "N3", "N1"], (6, 20), run=8)
    where = {"H": 0, "N3": 1, "N1": 2}
    want = sorted((t, where[labels[i]], where[labels[j]], p, v) for t, i, j, p, v in rows if labels[i] in where and labels[j] in where and 6 <= t < 20)
    assert sorted(tuple(r) for r in some.collect()) == want
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "pair#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    opened = some.select(F.input_file_name()).distinct().count()
    assert opened == 3 * 3 < spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 6 * 5
    for bad in (["H"], ["H", "H"], ["H", "N9"]):
        with pytest.raises(ValueError):
            cascade.read_elsasser_pairs(spark, path, bad, (0, 4), run=8)


def test_folders_of_stored_pairs_dont_grow_with_the_series(spark, tmp_path):
    rows = spark.range(3 * 3000).selectExpr("id div 3 AS step", "id % 3 AS p").selectExpr("step", "IF(p = 2, 1L, 0L) AS i", "IF(p = 0, 1L, 2L) AS j", "element_at(array('H__N1', 'H__N2', 'N1__N2'), int(p) + 1) AS pair", "double(step * 3 + p) AS l1")
    for name, steps in (("found", None), ("known", (0, 2999))):
        path = str(tmp_path / name)
        cascade.write_elsasser_pairs(rows, path, 4, steps)
        files = [str(f) for f in (tmp_path / name).rglob("*.parquet")]
        assert 3 * cascade.RUNS / 2 <= len(files) <= 3 * cascade.RUNS  # 3 * 750 in runs of 4 steps
        for f in files[:9]:
            at = pq.ParquetFile(f).read()["step"].to_pylist()
            assert at == sorted(at)
        for a, b in ((0, 3000), (127, 129), (2990, 5000), (700, 700)):
            got = sorted(tuple(r) for r in cascade.read_elsasser_pairs(spark, path, ["N1", "N2"], (a, b), 4).collect())
            assert got == [(t, 0, 1, "N1__N2", t * 3.0 + 2) for t in range(a, min(b, 3000))]
        some = cascade.read_elsasser_pairs(spark, path, ["N1", "N2"], (127, 129), 4).select(F.input_file_name()).distinct()
        assert some.count() == 2
    assert cascade.read_elsasser_pairs(spark, path, ["H", "N1", "N2"], (0, 3000), 4).count() == 9000


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(1, 9)) for k in rng.sample(range(5000), 700)]
    got = running_total(spark.createDataFrame(rows, "k long, n long"), "n", "k").orderBy("k").collect()
    assert [(r.k, r.upto) for r in got] == list(zip(sorted(k for k, _ in rows), itertools.accumulate(n for _, n in sorted(rows)), strict=True))
    assert {r.total for r in got} == {sum(n for _, n in rows)}
    assert running_total(spark.createDataFrame([], "k long, n long"), "n", "k").count() == 0


def test_sampling_levels_against_all_samples(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.random(3)), *map(float, rng.normal(size=3))) for i in range(80)]
    cells = spark.createDataFrame(rows, "id long, x double, y double, z double, v1 double, v2 double, v3 double")
    order = sorted(range(80), key=lambda i: (hashlib.md5(f"5,{i}".encode()).hexdigest(), i))  # noqa: S324
    got = {(r.samples, r.id): (r.p1, r.p2, r.p3) for r in reconstruct.sampling_levels(cells, [3, 20, 9], 0.0, seed=5).collect()}
    assert len(got) == 3 * 80
    for (n, i), p in got.items():
        near = min(order[:n], key=lambda j: (sum((rows[i][a] - rows[j][a]) ** 2 for a in (1, 2, 3)), j))
        assert p == tuple(rows[near][4:])
    noisy = reconstruct.sampling_levels(cells, [80], 0.5, seed=5).collect()
    off = [r.p1 - r.v1 for r in noisy]
    assert 0.3 < np.std(off) < 0.7 and abs(np.mean(off)) < 0.25
    score = reconstruct.level_scores(reconstruct.sampling_levels(cells, [80, 4], 0.0, seed=5)).toPandas().set_index("samples")
    assert score.rmse[80] == 0 < score.rmse[4] and set(score.valid_count) == {80}
    with pytest.raises(ValueError):
        reconstruct.sampling_levels(cells, [0, 4], 0.0)


def test_steps_and_formations(spark):
    assert [formation.time_index(10, 0.5, seconds=s) for s in (-1.0, 0.25, 0.26, 4.4, 99.0)] == [0, 0, 1, 9, 9]
    assert formation.time_index(10, 0.5) == 0 and formation.time_index(10, 0.5, index=3) == 3
    for bad in ({"index": 10}, {"index": 1, "seconds": 1.0}):
        with pytest.raises(ValueError):
            formation.time_index(10, 0.5, **bad)
    nine = spark.createDataFrame([("H",), *[(f"N{k}",) for k in range(1, 9)]], "label string")
    assert formation.nine_craft(nine).count() == 9
    for bad in (nine.where("label <> 'N3'"), nine.where("label <> 'H'").union(nine.where("label = 'N1'")), nine.union(nine.limit(1))):
        with pytest.raises(ValueError):
            formation.nine_craft(bad)
