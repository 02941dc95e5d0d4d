"""Queries of what figures show, finer maps and level lines, spectra and written results, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import norm, vector
from ..functions.tables import new_path, stage
from ..operators import cascade, grid, maps, spacetime, spectrum, structure
from ..sinks import tables
from ..sources.views import DT, RHO, SHAPE, field_grid, probe_series, scattered_samples, unpacked
from . import catalogue as base
from .catalogue import _r, _rounds, _sql

FINE = (200, 200)
MID = tuple(n // 2 for n in SHAPE)
LEAST = 1e-12


def _size(c: Column) -> Column:
    return F.log10(F.greatest(c, F.lit(LEAST)))


def _fine(spark: SparkSession, d: str) -> tuple[DataFrame, int, list[float]]:
    """The valid cells of the correlation map as a mesh (lag, r bin), refined; its lags and r edges."""
    series, lags, edges = base._moving(spark, d)
    m = spacetime.correlation_map(series, lags, edges).where("valid")
    nodes = m.select(F.col("lag").cast("long").alias("i"), F.col("r_bin").cast("long").alias("j"), F.col("corr").alias("value"))
    return stage(maps.refined(nodes, (lags + 1, base.R_BINS), FINE), "map-fine"), lags, edges


def _contour(spark: SparkSession, d: str) -> DataFrame:
    """The longest level line of the fine map, in seconds and distance."""
    fine, lags, edges = _fine(spark, d)
    first, width = edges[-1] / base.R_BINS / 2, edges[-1] * (base.R_BINS - 1) / base.R_BINS
    line = maps.longest_line(maps.level_segments(fine, spacetime.LEVEL))
    return line.select("at", (F.col("i") * F.lit(lags * DT / (FINE[0] - 1))).alias("tau"), (F.lit(first) + F.col("j") * F.lit(width / (FINE[1] - 1))).alias("r"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = maps.level_segments(_fine(spark, d)[0], spacetime.LEVEL)
    return rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("pieces"))


def _plane(spark: SparkSession, d: str) -> DataFrame:
    """The middle plane along z: arrows and magnitude."""
    return field_grid(spark, d).where(F.col("iz") == MID[2]).select("ix", "iy", "v1", "v2", norm(vector("v1", "v2", "v3")).alias("magnitude"))


def _slices(spark: SparkSession, d: str) -> DataFrame:
    """Three middle planes of the truth, the reconstruction and their difference."""
    t, p = vector("v1", "v2", "v3"), vector("p1", "p2", "p3")
    rows = base._coarse(spark, d).select(*grid.AXES, norm(t).alias("truth"), norm(p).alias("predicted"), norm([a - b for a, b in zip(t, p, strict=True)]).alias("error"))
    planes = F.array(*[F.when(F.col(a) == m, F.struct(F.lit(name).alias("plane"), F.col(u).alias("u"), F.col(v).alias("w"))) for a, m, name, u, v in (("iz", MID[2], "xy", "ix", "iy"), ("iy", MID[1], "xz", "ix", "iz"), ("ix", MID[0], "yz", "iy", "iz"))])
    return rows.select(F.explode(F.filter(planes, lambda s: s.isNotNull())).alias("s"), "truth", "predicted", "error").select("s.*", "truth", "predicted", "error")


def _series(spark: SparkSession, d: str) -> DataFrame:
    long = F.explode(F.array(*[F.struct(F.lit(v).alias("component"), F.col(v).alias("value")) for v in grid.VALUES])).alias("c")
    return probe_series(spark, d).select("time_seconds", "label", long).select("time_seconds", "label", "c.*")


def _geometry(spark: SparkSession, d: str) -> DataFrame:
    """The x-z plane in the middle of y, its third component without its mean."""
    rows = field_grid(spark, d).where(F.col("iy") == MID[1])
    mean = rows.agg(F.avg("v3").alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select("ix", "iz", norm(vector("v1", "v2", "v3")).alias("magnitude"), "v1", "v2", (F.col("v3") - F.col("mean")).alias("v3"))


def _curves(spark: SparkSession, d: str) -> DataFrame:
    """A row per curve and bin: moments and kurtosis over the bin's centre; undersampled and empty bins are left out."""
    table = structure.kurtosis(structure.undersampled(structure.structure_functions(base._pairs(spark, d), base.EDGES)))
    curves = F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), F.col(c).alias("value")) for n, c in (("S1", "s1"), ("S2", "s2"), ("S3", "s3"), ("S4", "s4"), ("kurtosis", "kurtosis"))])).alias("c")
    centre = F.sqrt(F.col("lambda_lo") * F.col("lambda_hi"))
    return table.where("n > 0 AND NOT undersampled").select("bin", centre.alias("centre"), curves).select("bin", "centre", "c.*").where("value IS NOT NULL AND NOT isnan(value)")


def _sampling(spark: SparkSession, d: str) -> DataFrame:
    """Per bin of the cube's random pairs: how many were in range and how many the sample holds."""
    return structure.sampling_bins(base._sample(spark, d), base.CUBE_EDGES, base.TARGET).select("bin", "candidates", "accepted")


def _shown_map(spark: SparkSession, d: str) -> DataFrame:
    """The map's cells by seconds; invalid ones have no value."""
    return base._map(spark, d).select((F.col("lag") * F.lit(DT)).alias("tau"), "r_bin", F.when(F.col("valid"), F.col("corr")).alias("corr"))


def _scatter(spark: SparkSession, d: str) -> DataFrame:
    """Elongation and planarity of every retained tetrahedron, with the logarithms of its size and of its mesocentre's distance in km."""
    rows = base._tetra(spark, d)
    far = sum((norm([F.col(f"{v}_l{k}") - F.col(f"c{k}") for k in (1, 2, 3)]) for v in "abcd"), F.lit(0.0)) / 4
    sized = rows.select(*"abcd", _size(far).alias("log_size"), _size(norm(vector("c1", "c2", "c3")) * RHO).alias("log_centre"))
    return cascade.rates(rows).select(*"abcd", "elongation", "planarity", "d_ep").join(sized, list("abcd"))


def _arrows(spark: SparkSession, d: str, share: float = 0.25) -> DataFrame:
    """Lag points with their flux scaled so that the longest arrow is ``share`` of the lags' greatest extent."""
    points = base._points(spark, d)
    long = [F.max(norm(vector(*[f"{n}{k}" for k in (1, 2, 3)]))).alias(f"most_{n}") for n in ("yp", "ym")]
    span = F.greatest(*[F.max(f"l{k}") - F.min(f"l{k}") for k in (1, 2, 3)]).alias("span")
    rows = points.crossJoin(F.broadcast(points.agg(span, *long)))
    scale = lambda n: F.when(F.col(f"most_{n}") > 0, F.lit(share) * F.greatest("span", F.lit(1.0)) / F.col(f"most_{n}")).otherwise(F.lit(1.0))
    return rows.select("pid", "l1", "l2", "l3", *[(F.col(f"{n}{k}") * scale(n)).alias(f"{n}{k}") for n in ("yp", "ym") for k in (1, 2, 3)])


def _rate_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Rates of valid, passing tetrahedra over the logarithm of the mesocentre's distance, with their mean and deviation."""
    rows = base._tetra(spark, d)
    centre = rows.select(*"abcd", _size(norm(vector("c1", "c2", "c3")) * RHO).alias("log_centre"))
    fine = cascade.flagged(cascade.rates(rows)).where("passes AND reason IS NULL").join(centre, list("abcd"))
    fine = fine.select(*"abcd", "log_centre", *[base._tenths(F.col(c)).alias(c) for c in ("eps_plus", "eps_minus")])
    stats = fine.agg(*[f(c).alias(f"{n}_{c}") for c in ("eps_plus", "eps_minus") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return fine.crossJoin(F.broadcast(stats))


def _baselines(spark: SparkSession, d: str) -> DataFrame:
    """Logarithms of the baselines' components, small ones raised to a floor."""
    even = base._points(spark, d).where("pid % 2 = 0")
    return even.select("pid", *[_size(F.abs(f"l{k}")).alias(f"log{k}") for k in (1, 2, 3)])


def _power(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.plane_power(field_grid(spark, d), SHAPE).select("iz", "kx", "ky", F.round("power", 0).alias("power"))


def _written_series(spark: SparkSession, d: str) -> DataFrame:
    """The series written as CSV in runs of steps, read back."""
    rows = probe_series(spark, d).select("step", "label", "v1", "v2", "v3")
    path = new_path(spark, "series-csv")
    tables.write_series(rows, path, "csv", 1024)
    return spark.read.schema(rows.schema.add("run", "long")).option("header", True).csv(path).drop("run")


def _written_rows(spark: SparkSession, d: str) -> DataFrame:
    """The holed reconstruction as JSON lines, read back: NaN has become null."""
    rows = base._holed(spark, d).select("id", "v2", "p2")
    path = new_path(spark, "rows-json")
    tables.write_rows(rows, path)
    return spark.read.schema(rows.schema).json(path)


def _document(spark: SparkSession, d: str) -> DataFrame:
    """The structure functions as one JSON document, read back."""
    table = structure.structure_functions(base._pairs(spark, d), base.EDGES, 2).select("bin", "n", "s1", "s2")
    doc = tables.document(table, ["bin"], orders=2, bins=len(base.EDGES) - 1)
    rows = doc.select(F.from_json("json", "about struct<orders:int,bins:int>, rows array<struct<bin:int,n:bigint,s1:double,s2:double>>").alias("d"))
    return rows.select(F.col("d.about.bins").alias("bins"), F.explode("d.rows").alias("r")).select("bins", "r.*")


def _correlation_result(spark: SparkSession, d: str) -> DataFrame:
    """Scales and edges in the document, the map, its cuts and the hub's autocorrelation beside it; the scales read back."""
    path = new_path(spark, "correlation")
    series, lags, edges = base._moving(spark, d)
    corr = stage(spacetime.correlation_map(series, lags, edges), "correlation-map")
    cuts = stage(spacetime.axis_cuts(corr, edges, DT), "correlation-cuts")
    bins = spark.range(base.R_BINS).select(F.col("id").alias("r_bin"), *[F.element_at(F.array(*map(F.lit, e)), (F.col("id") + 1).cast("int")).alias(n) for n, e in (("r_lo", edges[:-1]), ("r_hi", edges[1:]))])
    parts = {"scales": (spacetime.first_crossing(cuts), ["axis"]), "r_bins": (bins, ["r_bin"])}
    tables.write_result(path, parts, {"map": corr, "axis_cuts": cuts, "hub_autocorrelation": spacetime.hub_autocorrelation(series, lags)}, lags=lags, dt=DT)
    said = spark.read.text(f"{path}/document").select(F.from_json("value", "scales array<struct<axis:string,scale:double>>").alias("d"))
    return said.select(F.inline("d.scales"))


def _tetra_result(spark: SparkSession, d: str) -> DataFrame:
    """Counts, summaries and first tetrahedra in the document, all rates and lag points beside it; the summaries read back, with the tetrahedra kept."""
    path = new_path(spark, "tetrahedra")
    points = base._points(spark, d)
    rates = stage(base._rates(spark, d, points), "rates")
    parts = {"counts": (base._tetra_counts(spark, d, points), ["raw"]), "summary": (cascade.summaries(rates), ["metric"]), "preview": (cascade.preview(rates), [*"abcd"])}
    tables.write_result(path, parts, {"rates": rates, "lag_points": points}, preview_limit=64)
    summary = "array<struct<metric:string,n:bigint,least:double,most:double,mean:double,std:double>>"
    said = spark.read.text(f"{path}/document").select(F.from_json("value", f"summary {summary}, counts array<struct<retained:bigint>>").alias("d"))
    return said.select(F.col("d.counts").getItem(0)["retained"].alias("retained"), F.explode("d.summary").alias("s")).select("retained", "s.*")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """Components of a cell packed in one array by place, and the first two of them picked by name."""
    cells = field_grid(spark, d).select(*grid.AXES, F.array(*grid.VALUES).alias("packed"))
    return unpacked(cells, "packed", grid.VALUES, ["v1", "v2"])


QUERIES = {
    "st_map_fine": lambda s, d: _r(_fine(s, d)[0], 5),
    "st_level_squares": _segments,
    "st_longest_contour": lambda s, d: _r(_contour(s, d), 5),
    "plot_plane": lambda s, d: _r(_plane(s, d), 4),
    "plot_reconstruction_slices": lambda s, d: _r(_slices(s, d), 4),
    "plot_point_cloud": lambda s, d: _r(scattered_samples(s, d).select("sample_id", "x", "y", "z", F.abs("v").alias("magnitude"))),
    "plot_series": lambda s, d: _r(_series(s, d)),
    "plot_geometry": lambda s, d: _r(_geometry(s, d), 4),
    "plot_structure_functions": lambda s, d: _r(_curves(s, d), 4),
    "plot_sampling": _sampling,
    "plot_corr_map": lambda s, d: _r(_shown_map(s, d)),
    "plot_tetra_scatter": lambda s, d: _r(_scatter(s, d), 5),
    "plot_flux_arrows": lambda s, d: _r(_arrows(s, d), 4),
    "plot_rate_scatter": lambda s, d: _r(_rate_scatter(s, d), 2),
    "plot_baselines": lambda s, d: _r(_baselines(s, d), 5),
    "power_spectrum": _power,
    "series_written": lambda s, d: _r(_written_series(s, d)),
    "rows_written": lambda s, d: _r(_written_rows(s, d), 4),
    "st_document": lambda s, d: _r(_correlation_result(s, d), 5),
    "tetra_document": lambda s, d: _r(_tetra_result(s, d), 3),
    "sf_document": lambda s, d: _r(_document(s, d), 4),
    "packed_components": lambda s, d: _r(_packed(s, d)),
}

# ---- DuckDB texts -------------------------------------------------------------------------------------------------

_M, _N, _B = FINE[0] - 1, FINE[1] - 1, base.R_BINS - 1
_FINE = f"""WITH nodes AS (SELECT lag AS i, r_bin AS j, corr AS value FROM corr WHERE valid),
  m AS (SELECT top AS last FROM lagmax),
  fp AS (SELECT p, CAST(least(floor(p * last / {_M}.0), last - 1) AS BIGINT) AS i, last FROM range({_M + 1}) t(p), m),
  fq AS (SELECT q, CAST(least(floor(q * {_B} / {_N}.0), {_B - 1}) AS BIGINT) AS j FROM range({_N + 1}) t(q)),
  fine AS MATERIALIZED (SELECT p, q, (a.value * (1 - w) + b.value * w) * (1 - u) + (c.value * (1 - w) + e.value * w) * u AS value FROM (
    SELECT *, (p * last - i * {_M}) / {_M}.0 AS u, (q * {_B} - j * {_N}) / {_N}.0 AS w FROM fp, fq) f
    JOIN nodes a ON a.i = f.i AND a.j = f.j JOIN nodes b ON b.i = f.i AND b.j = f.j + 1
    JOIN nodes c ON c.i = f.i + 1 AND c.j = f.j JOIN nodes e ON e.i = f.i + 1 AND e.j = f.j + 1)"""
_L = repr(spacetime.LEVEL)
_len = lambda a: "sqrt(" + " + ".join(f"({x}) * ({x})" for x in a) + ")"
_log = lambda x: f"log10(greatest({x}, {LEAST!r}))"
_centre = _log(f"sqrt(c1 * c1 + c2 * c2 + c3 * c3) * {RHO}")
_vertex = " + ".join(_len([f"{v}_l{k} - c{k}" for k in (1, 2, 3)]) for v in "abcd")
_wave = lambda f, k, x, n: f"{f}(2 * pi() * {k} * {x} / {n})"
_AT = lambda i, j, o: f"(({i}) * 268435456 + {j}) * 2 + {o}"
#: Squares by sending each node to those that it is a corner of: joins of the mesh with itself may be planned as products.
_SQ = """sq AS (SELECT i, j, max(value) FILTER (WHERE c = 0) AS v00, max(value) FILTER (WHERE c = 1) AS v01, max(value) FILTER (WHERE c = 2) AS v10, max(value) FILTER (WHERE c = 3) AS v11
    FROM (SELECT p - a AS i, q - b AS j, 2 * a + b AS c, value FROM fine, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b)) GROUP BY i, j HAVING count(value) = 4)"""
#: Pieces by the numbers of the sides they join; lines walked from their ends, then rings from each of their vertices both ways.
_CONTOUR = f"""{_FINE},
  {_SQ},
  sides AS MATERIALIZED (SELECT *, CASE WHEN (v00 >= {_L}) <> (v01 >= {_L}) THEN {_AT("i", "j", 0)} END AS li, CASE WHEN (v10 >= {_L}) <> (v11 >= {_L}) THEN {_AT("i + 1", "j", 0)} END AS hi,
    CASE WHEN (v00 >= {_L}) <> (v10 >= {_L}) THEN {_AT("i", "j", 1)} END AS lj, CASE WHEN (v01 >= {_L}) <> (v11 >= {_L}) THEN {_AT("i", "j + 1", 1)} END AS hj, ((v00 + v01 + v10 + v11) / 4 >= {_L}) = (v00 >= {_L}) AS same FROM sq),
  two AS (SELECT list_filter([li, hi, lj, hj], lambda x: x IS NOT NULL) AS f FROM sides WHERE li IS NULL OR hi IS NULL OR lj IS NULL),
  piece AS (SELECT f[1] AS a, f[2] AS b FROM two WHERE len(f) = 2 UNION ALL SELECT li, CASE WHEN same THEN hj ELSE lj END FROM sides WHERE li + hi + lj IS NOT NULL UNION ALL SELECT hi, CASE WHEN same THEN lj ELSE hj END FROM sides WHERE li + hi + lj IS NOT NULL),
  adj AS MATERIALIZED (SELECT a AS u, b AS v FROM piece UNION SELECT b, a FROM piece),
  place AS (SELECT vertex, min(y) AS i, min(x) AS j FROM (SELECT li AS vertex, i AS y, j + ({_L} - v00) / (v01 - v00) AS x FROM sides WHERE li IS NOT NULL UNION ALL SELECT hi, i + 1, j + ({_L} - v10) / (v11 - v10) FROM sides WHERE hi IS NOT NULL
    UNION ALL SELECT lj, i + ({_L} - v00) / (v10 - v00), j FROM sides WHERE lj IS NOT NULL UNION ALL SELECT hj, i + ({_L} - v01) / (v11 - v01), j + 1 FROM sides WHERE hj IS NOT NULL) GROUP BY vertex),
  walk AS (SELECT u AS start, NULL::BIGINT AS first, 0 AS nth, NULL::BIGINT AS prev, u AS cur FROM adj GROUP BY u HAVING count(*) = 1
    UNION ALL SELECT start, coalesce(first, v), nth + 1, cur, v FROM walk JOIN adj ON u = cur WHERE v IS DISTINCT FROM prev),
  ring AS (SELECT u AS start, v AS first, 1 AS nth, u AS prev, v AS cur FROM adj WHERE u NOT IN (SELECT cur FROM walk) UNION ALL SELECT start, first, nth + 1, cur, v FROM ring JOIN adj ON u = cur WHERE v <> prev AND v <> start),
  ways AS (SELECT start, first, count(*) AS size, min(cur) AS least, arg_max(cur, nth) AS last, false AS closed FROM walk GROUP BY start, first UNION ALL SELECT start, first, count(*) + 1, min(cur), arg_max(cur, nth), true FROM ring GROUP BY start, first),
  best AS (SELECT start, first, closed FROM ways WHERE CASE WHEN closed THEN start < least AND first < last ELSE start < last END ORDER BY size DESC, least(start, least) LIMIT 1),
  line AS (SELECT nth, cur FROM walk JOIN best USING (start) WHERE NOT closed UNION ALL SELECT nth, cur FROM ring JOIN best USING (start, first) WHERE closed UNION ALL SELECT 0, start FROM best WHERE closed)
  SELECT CAST(nth AS INTEGER) AS "at", round(i * last * CAST({DT} AS DOUBLE) / {_M}, 5) + 0.0 AS tau, round(far / {base.R_BINS} / 2 + j * (far * {base.R_BINS - 1} / {base.R_BINS}) / {_N}, 5) + 0.0 AS r FROM line JOIN place ON vertex = cur, lagmax, far, m"""

ORACLE_SQL = {
    "st_map_fine": _sql(["corr", "lagmax"], f"{_FINE} SELECT p AS i, q AS j, round(value, 5) + 0.0 AS value FROM fine"),
    "st_longest_contour": _sql(["corr", "lagmax", "far"], _CONTOUR).replace("WITH ", "WITH RECURSIVE ", 1),
    "st_level_squares": _sql(["corr", "lagmax"], f"""{_FINE}, {_SQ} SELECT i, j, CAST(cuts / 2 AS BIGINT) AS pieces FROM (SELECT i, j,
      CAST((v00 >= {_L}) <> (v01 >= {_L}) AS INTEGER) + CAST((v10 >= {_L}) <> (v11 >= {_L}) AS INTEGER) + CAST((v00 >= {_L}) <> (v10 >= {_L}) AS INTEGER) + CAST((v01 >= {_L}) <> (v11 >= {_L}) AS INTEGER) AS cuts FROM sq) WHERE cuts > 0"""),
    "plot_plane": _sql("grid", f"SELECT ix, iy, {_rounds('v1 v2', 4)}, round({_len(grid.VALUES)}, 4) AS magnitude FROM grid WHERE iz = {MID[2]}"),
    "plot_reconstruction_slices": _sql("coarse", "SELECT plane, u, w, round(truth, 4) AS truth, round(predicted, 4) AS predicted, round(error, 4) AS error FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS plane, {u} AS u, {w} AS w, {_len(grid.VALUES)} AS truth, {_len(('p1', 'p2', 'p3'))} AS predicted, {_len([f'v{k} - p{k}' for k in (1, 2, 3)])} AS error FROM coarse WHERE {a} = {m}"
        for n, u, w, a, m in (("xy", "ix", "iy", "iz", MID[2]), ("xz", "ix", "iz", "iy", MID[1]), ("yz", "iy", "iz", "ix", MID[0]))) + ")"),
    "plot_point_cloud": _sql("samples", f"SELECT sample_id, {_rounds('x y z')}, round(abs(v), 6) AS magnitude FROM samples"),
    "plot_series": _sql("probe", "SELECT time_seconds, label, component, round(value, 6) + 0.0 AS value FROM (" + " UNION ALL ".join(f"SELECT time_seconds, label, '{v}' AS component, {v} AS value FROM probe" for v in grid.VALUES) + ")"),
    "plot_geometry": _sql("grid", f"SELECT ix, iz, round({_len(grid.VALUES)}, 4) AS magnitude, {_rounds('v1 v2', 4)}, round(v3 - avg(v3) OVER (), 4) + 0.0 AS v3 FROM grid WHERE iy = {MID[1]}"),
    "plot_structure_functions": _sql("sf", f"""SELECT bin, round(sqrt(lo * hi), 4) AS centre, curve, round(value, 4) AS value FROM (
      SELECT *, {base._list(base.EDGES)}[bin + 1] AS lo, {base._list(base.EDGES)}[bin + 2] AS hi, max(n) OVER () AS most FROM (SELECT *, CASE WHEN s2 <> 0 THEN s4 / (s2 * s2) END AS k FROM sf)) b,
      LATERAL (SELECT unnest(['S1', 'S2', 'S3', 'S4', 'kurtosis']) AS curve, unnest([s1, s2, s3, s4, k]) AS value) c WHERE n > 0 AND n >= 0.05 * most AND value IS NOT NULL"""),
    "plot_sampling": _sql("cube_bins", "SELECT bin, candidates, accepted FROM cube_bins"),
    "plot_corr_map": _sql("corr", f"SELECT round(lag * CAST({DT} AS DOUBLE), 6) AS tau, r_bin, CASE WHEN valid THEN round(corr, 6) + 0.0 END AS corr FROM corr"),
    "plot_tetra_scatter": _sql("shaped", f"SELECT a, b, c, d, round(elongation, 5) + 0.0 AS elongation, round(planarity, 5) + 0.0 AS planarity, round(d_ep, 5) + 0.0 AS d_ep, round({_log(f'({_vertex}) / 4')}, 5) + 0.0 AS log_size, round({_centre}, 5) + 0.0 AS log_centre FROM shaped"),
    "plot_flux_arrows": _sql("lagp", f"""SELECT pid, {_rounds('l1 l2 l3', 4)}, {', '.join(f'round({n}{k} * CASE WHEN most_{n} > 0 THEN 0.25 * greatest(span, 1.0) / most_{n} ELSE 1 END, 4) + 0.0 AS {n}{k}' for n in ('yp', 'ym') for k in (1, 2, 3))}
      FROM lagp, (SELECT greatest(max(l1) - min(l1), max(l2) - min(l2), max(l3) - min(l3)) AS span, {', '.join(f"max({_len([f'{n}{k}' for k in (1, 2, 3)])}) AS most_{n}" for n in ('yp', 'ym'))} FROM lagp)"""),
    "plot_baselines": _sql("lagp", f"SELECT pid, {', '.join(f'round({_log(f"abs(l{k})")}, 5) + 0.0 AS log{k}' for k in (1, 2, 3))} FROM lagp WHERE pid % 2 = 0"),
    "plot_rate_scatter": _sql(["rated", "tetra"], f"""WITH f AS (SELECT a, b, c, d, {_centre} AS log_centre, floor(eps_plus * 10 + 0.5) / 10 AS eps_plus, floor(eps_minus * 10 + 0.5) / 10 AS eps_minus FROM rated JOIN tetra USING (a, b, c, d) WHERE passes AND reason IS NULL)
      SELECT a, b, c, d, round(log_centre, 2) + 0.0 AS log_centre, {_rounds('eps_plus eps_minus', 2)}, {', '.join(f'round({f}({c}) OVER (), 2) + 0.0 AS {n}_{c}' for c in ('eps_plus', 'eps_minus') for n, f in (('mean', 'avg'), ('std', 'stddev_pop')))} FROM f"""),
    "power_spectrum": _sql("grid", f"""WITH one AS (SELECT iz, iy, kx, {', '.join(f"sum({v} * {_wave('cos', 'kx', 'ix', SHAPE[0])}) AS {v}c, -sum({v} * {_wave('sin', 'kx', 'ix', SHAPE[0])}) AS {v}s" for v in ('v1', 'v2'))} FROM grid, range({SHAPE[0]}) t(kx) GROUP BY iz, iy, kx),
      two AS (SELECT iz, kx, ky, {', '.join(f"sum({v}c * {_wave('cos', 'ky', 'iy', SHAPE[1])} + {v}s * {_wave('sin', 'ky', 'iy', SHAPE[1])}) AS {v}c, sum({v}s * {_wave('cos', 'ky', 'iy', SHAPE[1])} - {v}c * {_wave('sin', 'ky', 'iy', SHAPE[1])}) AS {v}s" for v in ('v1', 'v2'))} FROM one, range({SHAPE[1]}) t(ky) GROUP BY iz, kx, ky)
      SELECT iz, kx, ky, round(v1c * v1c + v1s * v1s + v2c * v2c + v2s * v2s, 0) AS power FROM two"""),
    "series_written": _sql("probe", f"SELECT step, label, {_rounds('v1 v2 v3')} FROM probe"),
    "rows_written": _sql("coarse", "SELECT id, round(v2, 4) + 0.0 AS v2, CASE WHEN id % 7 <> 3 THEN round(p2, 4) + 0.0 END AS p2 FROM coarse"),
    "sf_document": _sql("sf", f"SELECT {len(base.EDGES) - 1} AS bins, bin, n, round(s1, 4) AS s1, round(s2, 4) AS s2 FROM sf"),
    "packed_components": _sql("grid", f"SELECT ix, iy, iz, {_rounds('v1 v2')} FROM grid"),
}
ORACLE_SQL["st_document"] = base.ORACLE_SQL["st_decorrelation_scales"]
ORACLE_SQL["tetra_document"] = f"SELECT s.*, (SELECT retained FROM ({base.ORACLE_SQL['tetra_counts']})) AS retained FROM ({base.ORACLE_SQL['tetra_summary']}) s"
