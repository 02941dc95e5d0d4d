"""Finer maps by bilinear interpolation, and level lines of a map.

A map is a table (i, j, value): whole-numbered nodes of a rectangular mesh, of which some may be missing. Squares come
from one shuffle in which every node sends its value to the squares that it is a corner of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stage

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))
EDGES = 1 << 28  # more than a map has nodes along j


def squares(nodes: DataFrame) -> DataFrame:
    """(i, j, v00, v01, v10, v11) of the squares whose four corners are there; i and j are those of the lower corner."""
    sent = F.explode(F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(2 * a + b).alias("c"), F.col("value").alias("v")) for a, b in CORNERS])).alias("s")
    at = [F.max(F.when(F.col("c") == 2 * a + b, F.col("v"))).alias(f"v{a}{b}") for a, b in CORNERS]
    rows = nodes.where(F.col("value").isNotNull() & ~F.isnan("value")).select(sent).select("s.*")
    return rows.groupBy("i", "j").agg(*at, F.count(F.lit(1)).alias("n")).where("n = 4").drop("n")


def refined(nodes: DataFrame, shape: Sequence[int], fine: Sequence[int]) -> DataFrame:
    """The map of ``shape`` nodes on a mesh of ``fine`` nodes over the same rectangle; a row only where the square is whole.

    A fine node on the border of two squares belongs to the upper one; those on the last border, to the last square.
    """
    if min(shape) < 2 or min(fine) < 2:
        raise ValueError("a map needs two nodes on each axis")

    def inside(at: str, m: int, n: int) -> tuple[Column, Column]:
        first = F.ceil(F.col(at) * F.lit(n - 1) / F.lit(m - 1))
        after = F.when(F.col(at) == m - 2, F.lit(n)).otherwise(F.ceil((F.col(at) + 1) * F.lit(n - 1) / F.lit(m - 1)))
        return first.cast("long"), after.cast("long") - 1

    rows = squares(nodes)
    for at, name, m, n in zip("ij", ("p", "q"), shape, fine, strict=True):
        lo, hi = inside(at, m, n)
        rows = rows.where(lo <= hi).withColumn(name, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    u = (F.col("p") * (shape[0] - 1) - F.col("i") * (fine[0] - 1)) / F.lit(fine[0] - 1)
    w = (F.col("q") * (shape[1] - 1) - F.col("j") * (fine[1] - 1)) / F.lit(fine[1] - 1)
    value = (F.col("v00") * (1 - w) + F.col("v01") * w) * (1 - u) + (F.col("v10") * (1 - w) + F.col("v11") * w) * u
    return rows.select(F.col("p").alias("i"), F.col("q").alias("j"), value.alias("value"))


def level_segments(nodes: DataFrame, level: float) -> DataFrame:
    """(i, j, part, from_i, from_j, from_edge, to_i, to_j, to_edge): straight pieces of the level line in each square, in node units.

    A square whose corners alternate has two pieces, joined as the mean of its corners says. A piece goes from one side of the
    square to another; the number of a side is the same for both squares that it bounds, so a side has two pieces at most.
    """
    high = {c: F.col(f"v{c}") >= F.lit(level) for c in ("00", "01", "10", "11")}

    def cut(a: str, b: str) -> Column:
        share = (F.lit(level) - F.col(f"v{a}")) / (F.col(f"v{b}") - F.col(f"v{a}"))
        at = [F.col(x) + int(a[k]) + (share if a[k] != b[k] else F.lit(0.0)) for k, x in enumerate("ij")]
        edge = ((F.col("i") + int(a[0])) * EDGES + F.col("j") + int(a[1])) * 2 + int(a[0] != b[0])
        return F.when(high[a] != high[b], F.struct(at[0].alias("i"), at[1].alias("j"), edge.alias("edge")))

    low_i, high_i, low_j, high_j = cut("00", "01"), cut("10", "11"), cut("00", "10"), cut("01", "11")
    four = (high["00"] == high["11"]) & (high["01"] == high["10"]) & (high["00"] != high["01"])
    same = ((F.col("v00") + F.col("v01") + F.col("v10") + F.col("v11")) / 4 >= F.lit(level)) == high["00"]
    piece = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    around_11 = F.array(piece(low_i, high_j), piece(low_j, high_i))  # 00 and 11 hang together: the pieces cut off 01 and 10
    around_00 = F.array(piece(low_i, low_j), piece(high_i, high_j))
    found = F.filter(F.array(low_i, high_i, low_j, high_j), lambda p: p.isNotNull())
    pieces = F.when(four & same, around_11).when(four, around_00).when(F.size(found) == 2, F.array(piece(F.get(found, F.lit(0)), F.get(found, F.lit(1)))))
    rows = squares(nodes).select("i", "j", F.posexplode(pieces).alias("part", "s"))
    return rows.select("i", "j", "part", F.col("s.a.i").alias("from_i"), F.col("s.a.j").alias("from_j"), F.col("s.a.edge").alias("from_edge"), F.col("s.b.i").alias("to_i"), F.col("s.b.j").alias("to_j"), F.col("s.b.edge").alias("to_edge"))


def followed(arcs: DataFrame) -> DataFrame:
    """(u, v, nu, nv, lu, lv, n, least) for arcs (u, v, nu, nv) with the arc that each leads to: list ranking by pointer doubling.

    In every round an arc takes over what lies ahead of the arc it points to, so the stretch it knows doubles. An arc on an
    open line ends knowing its line's last arc (lu, lv), how many arcs it takes to the end (n, its own included) and the least
    vertex ahead. An arc on a closed line never ends (nu stays) and knows the line's least vertex once no arc learns more.
    """
    open_ = F.col("nu").isNotNull()
    known = arcs.select("u", "v", "nu", "nv", F.when(~open_, F.col("u")).alias("lu"), F.when(~open_, F.col("v")).alias("lv"), F.lit(1).cast("long").alias("n"), F.least("u", "v").alias("least"))
    known = stage(known, "lines-arcs")
    while True:
        ahead = known.select(*[F.col(c).alias(f"a_{c}") for c in known.columns])
        rows = known.join(ahead, (F.col("nu") == F.col("a_u")) & (F.col("nv") == F.col("a_v")), "left")
        news = open_ & (F.col("a_nu").isNull() | (F.col("a_least") < F.col("least")))
        rows = rows.select(
            "u", "v", F.col("a_nu").alias("nu"), F.col("a_nv").alias("nv"), F.coalesce("lu", "a_lu").alias("lu"), F.coalesce("lv", "a_lv").alias("lv"),
            (F.col("n") + F.coalesce("a_n", F.lit(0))).alias("n"), F.least("least", F.coalesce("a_least", "least")).alias("least"), news.alias("news"),
        )
        rows = stage(rows, "lines-arcs")
        known = rows.drop("news")
        if not rows.where("news").limit(1).count():
            return known


def lines(pieces: DataFrame) -> DataFrame:
    """(line, closed, size, at, vertex) of all lines that the pieces (a, b) make, where a vertex has two pieces at most.

    An open line begins at the smaller of its ends, a closed one at its least vertex and towards the smaller neighbour; each
    is known by its least vertex. A closed line's first vertex isn't repeated.
    """
    both = stage(pieces.select("a", "b").union(pieces.select("b", "a")).distinct().toDF("u", "v"), "lines-both")
    onward = both.select(F.col("u").alias("nu"), F.col("v").alias("nv"))
    arcs = both.join(onward, (F.col("v") == F.col("nu")) & (F.col("u") != F.col("nv")), "left")
    known = followed(arcs)
    open_ = known.where("nu IS NULL").withColumn("closed", F.lit(False))
    rings = known.where("nu IS NOT NULL").select("u", "v", F.col("least").alias("ring"))
    if rings.limit(1).count():  # a closed line is cut where it comes back to its least vertex
        cut = rings.join(arcs, ["u", "v"]).select("u", "v", *[F.when(F.col("v") != F.col("ring"), F.col(c)).alias(c) for c in ("nu", "nv")])
        open_ = open_.unionByName(followed(cut).withColumn("closed", F.lit(True)))
    open_ = stage(open_, "lines-open")
    # of the two ways along a line one is taken; its first arc has all others ahead of it
    way = open_.groupBy("lu", "lv").agg(F.max("n").alias("arcs"), F.max_by(F.struct("u", "v"), "n").alias("first"), F.min("least").alias("line"), F.first("closed").alias("closed"))
    taken = way.where(F.when(F.col("closed"), F.col("first.v") < F.col("lu")).otherwise(F.col("first.u") < F.col("lv")))
    taken = stage(taken.select("lu", "lv", "arcs", "line", "closed", (F.col("arcs") + F.when(F.col("closed"), 0).otherwise(1)).alias("size")), "lines-ways")
    steps = open_.drop("closed").join(taken, ["lu", "lv"]).select("line", "closed", "size", (F.col("arcs") - F.col("n")).alias("at"), F.col("u").alias("vertex"))
    ends = taken.where("NOT closed").select("line", "closed", "size", F.col("arcs").alias("at"), F.col("lv").alias("vertex"))
    return steps.unionByName(ends)


def longest_line(segments: DataFrame) -> DataFrame:
    """(at, i, j): the level line with the most vertices in order, ties to the one with the least vertex; none for no segments."""
    segments = stage(segments, "lines-pieces")
    found = stage(lines(segments.select(F.col("from_edge").alias("a"), F.col("to_edge").alias("b"))), "lines")
    best = found.where("at = 0").orderBy(F.desc("size"), "line").limit(1).select("line")
    places = segments.select(F.col("from_edge").alias("vertex"), F.col("from_i").alias("i"), F.col("from_j").alias("j")).union(segments.select("to_edge", "to_i", "to_j"))
    places = places.groupBy("vertex").agg(F.min("i").alias("i"), F.min("j").alias("j"))
    return found.join(best, "line", "left_semi").join(places, "vertex").select(F.col("at").cast("int").alias("at"), "i", "j")
