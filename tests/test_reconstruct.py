"""Nearest samples, radial basis patches and their plans, against brute force and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmuration.operators import kdtree, radial, reconstruct


def _frame(spark, x, name, value=True):
    cols = {name: np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}
    return spark.createDataFrame(pd.DataFrame(cols | ({"v": 1.5 * np.arange(len(x))} if value else {})))


def _sets():
    rng = np.random.default_rng(1)
    even = rng.random((20_000, 3))
    cluster, copies = even.copy(), even.copy()
    cluster[:19_800] = 0.5 + 1e-4 * rng.random((19_800, 3))  # 99 % of the samples within a ten-thousandth of the box
    copies[:18_000] = 0.25  # and 90 % at one place
    return {"even": even, "cluster": cluster, "copies": copies}


@pytest.mark.parametrize("name", ["even", "cluster", "copies"])
def test_nearest_samples_anywhere(spark, name):
    x = _sets()[name]
    rng = np.random.default_rng(2)
    q = np.vstack([x[:150] + 3, rng.random((100, 3)), 0.5 + 1e-4 * rng.random((100, 3)), np.full((3, 3), 0.25)])
    samples = _frame(spark, x, "sample_id").cache()
    for k in (1, 5):
        got = kdtree.nearest_samples(_frame(spark, q, "id", False), samples, "id", k).toPandas().sort_values(["id", "rank"])
        assert len(got) == k * len(q)
        d2 = np.zeros((len(q), len(x)))
        for axis in range(3):
            d2 += (q[:, axis, None] - x[None, :, axis]) ** 2
        for i, own in got.groupby("id"):
            want = np.lexsort((np.arange(len(x)), d2[i]))[:k]
            assert own.sample_id.tolist() == want.tolist() and own.d2.tolist() == d2[i, want].tolist() and own.v.tolist() == (1.5 * want).tolist()


def test_tree_skips_most_leaves():
    rng = np.random.default_rng(3)
    x = rng.random((4096, 2))
    tree = kdtree.Tree(x, 6)
    leaf = tree.leaves(x)
    at = np.unique(leaf)
    tree.fill(at, np.bincount(leaf, minlength=64)[at], np.array([x[leaf == k].min(0) for k in at]), np.array([x[leaf == k].max(0) for k in at]))
    assert len(at) == 64 and np.bincount(leaf).max() < 80  # medians halve the samples
    q = rng.random((200, 2))
    least = ((q[:, None] - x[None]) ** 2).sum(-1).min(1)
    point, found = tree.within(q, least)
    assert len(point) < 3 * len(q)
    assert (tree.bound(q, tree.leaves(q), 1) >= least).all()
    nearest = leaf[((q[:, None] - x[None]) ** 2).sum(-1).argmin(1)]
    assert {(i, n) for i, n in enumerate(nearest)} <= set(zip(point.tolist(), found.tolist(), strict=True))


@pytest.mark.parametrize("patch", [16, 4096])
def test_radial_basis_goes_through_samples_and_keeps_affine_fields(spark, patch):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.random((250, 3)), 0.3 + 0.01 * rng.random((50, 3))])
    v = np.sin(5 * x[:, 0]) + x[:, 1] * x[:, 2]
    rows = [(i, *map(float, p), float(a), float(2 * p[0] - p[1] + 1)) for i, (p, a) in enumerate(zip(x, v, strict=True))]
    s = spark.createDataFrame(rows, "sample_id long, x double, y double, z double, v double, w double")
    s = s.unionByName(s.where("sample_id < 3").withColumn("sample_id", F.col("sample_id") + 1000).withColumn("v", F.col("v") + 2))  # shared positions: the mean
    got = {r.sample_id: r for r in reconstruct.radial_basis(s, s, "sample_id", value=("v", "w"), patch=patch).collect()}
    assert len(got) == 303
    for i, *p, a, w in rows:
        assert math.isclose(got[i].v, a + (i < 3), abs_tol=1e-6) and math.isclose(got[i].w, w, abs_tol=1e-6)
    q = np.vstack([rng.random((80, 3)) * 1.4 - 0.2, [[5.0, -7.0, 3.0]]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)] + [(900, None, 0.0, 0.0)], "id long, x double, y double, z double")
    found = {r.id: r for r in reconstruct.radial_basis(points, s, "id", value=("v", "w"), patch=patch).collect()}
    assert len(found) == 82 and math.isnan(found[900].v)
    assert all(math.isclose(found[i].w, 2 * p[0] - p[1] + 1, abs_tol=1e-5) for i, p in enumerate(q))
    off = [abs(found[i].v - (math.sin(5 * p[0]) + p[1] * p[2])) for i, p in enumerate(q) if (p > 0).all() and (p < 1).all()]
    assert np.median(off) < 0.1  # three samples are moved by 1
    assert all(math.isnan(r.v) for r in reconstruct.radial_basis(points, s.limit(0), "id", value=("v", "w")).collect())


def test_patches_blend_without_steps():
    """Weights of a path across all borders change little from one place to the next."""
    rng = np.random.default_rng(5)
    x = rng.random((512, 2))
    tree = kdtree.Tree(x, 4)
    leaf = tree.leaves(x)
    at = np.unique(leaf)
    tree.fill(at, np.bincount(leaf)[at], np.array([x[leaf == k].min(0) for k in at]), np.array([x[leaf == k].max(0) for k in at]))
    path = np.linspace([-0.5, -0.3], [1.4, 1.5], 20_001)
    point, patch, weight = radial.Patches(tree, 2).reached(path)
    table = np.zeros((len(path), 16))
    table[point, patch] = weight
    assert (table.sum(1) > 0.05).all()
    assert np.abs(np.diff(table / table.sum(1, keepdims=True), axis=0)).max() < 0.01


def test_stacks_of_systems_with_samples_on_a_line():
    rng = np.random.default_rng(6)
    x = rng.random((3, 8, 3))
    x[1] = np.linspace(0, 1, 8)[:, None]  # no plane is determined
    y = (x @ np.array([1.0, 2.0, -1.0]))[..., None]
    assert np.allclose(radial.Stack(x, y)(x), y, atol=1e-8)
    with pytest.raises(ValueError):
        radial.Stack(x, y, kernel="other")


def test_a_search_without_an_end_is_an_error():
    search = reconstruct._Search(2)
    search.MOST = 1
    with pytest.raises(ArithmeticError):
        search.solve(np.array([0.4, 0.5]), np.arange(6), np.random.default_rng(0).random((6, 2)))


def test_linear_over_patches_against_one_search_over_all(spark):
    """Lattice positions that samples and points share: patches, and rounds for what is near the hull, give what one search finds."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, [13, 12, 7], (900, 3)) / 12.0
    v = rng.normal(size=900)
    samples = spark.createDataFrame([(i, *map(float, p), float(w)) for i, (p, w) in enumerate(zip(x, v, strict=True))], "sample_id long, x double, y double, z double, v double")
    q = np.r_[rng.integers(0, [13, 12, 7], (150, 3)) / 12.0, rng.random((100, 3)) * 1.2 - 0.1]
    q = np.r_[q, q[:80]]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "id long, x double, y double, z double")
    got = {r.id: r.v for r in reconstruct.linear(points, samples, "id", near=64, chunk=64).collect()}
    assert len(got) == len(q)
    search = reconstruct._Search(3)
    low, scale = x.min(0), np.ptp(x, axis=0).max()
    at, ties = (x - low) / scale, search.ties(np.arange(900))
    members, weight, _ = search.solve_all((q - low) / scale, ties[None], at[None])
    for i, (m, w) in enumerate(zip(members, weight, strict=True)):
        outside = (q[i] < low).any() or (q[i] > x.max(0)).any() or ((m < 0) & (w > 1e-9)).any()
        want = np.nan if outside else sum(v[k] * u for k, u in zip(m, w, strict=True) if k >= 0 and u > 0)
        assert np.isnan(got[i]) if outside else abs(got[i] - want) < 1e-7
    assert 10 < sum(np.isnan(list(got.values()))) < 150
    assert all(np.array_equal(got[i], got[250 + i], equal_nan=True) for i in range(80))


@pytest.mark.parametrize("patch", [16, 512])
def test_samples_at_one_position_keep_their_values(spark, patch):
    rng = np.random.default_rng(6)
    x, v = rng.integers(0, 5, (160, 3)) / 4.0, np.round(rng.normal(size=160) * 1000, 2)
    assert len(np.unique(x, axis=0)) < 100
    rows = [(i, *map(float, p), float(w)) for i, (p, w) in enumerate(zip(x, v, strict=True))]
    samples = reconstruct.numbered(spark.createDataFrame(rows, "sample_id long, x double, y double, z double, v double"), "nth", 1 / 128)
    assert samples.groupBy("x", "y", "z").agg(F.max("nth").alias("m"), F.count("nth").alias("n")).where("round(m * 128) <> n - 1").count() == 0
    got = {r.sample_id: r.v for r in reconstruct.radial_basis(samples, samples, "sample_id", ("x", "y", "z", "nth"), patch=patch).collect()}
    assert len(got) == 160 and max(abs(got[i] - w) for i, w in enumerate(v)) < 1e-5


def test_splits_leave_no_side_empty():
    """Nearly all positions share the least value of the widest axis."""
    x = np.zeros((400, 2))
    x[:, 1], x[-30:, 0] = np.linspace(0, 1, 400), 5.0
    tree = kdtree.Tree(x, 3)
    assert np.bincount(tree.leaves(x), minlength=8).max() <= 100
