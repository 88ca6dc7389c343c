"""Measures of cells and nodes from coordinates and connectivity.

Lengths, areas and volumes are sums over simplices.  A face's area is half the
length of its summed cross products, which is exact for plane polygons; a
volume is the absolute value of the signed sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.units import power
from fieldloom.sources.manifest import Slot
from fieldloom.sources.study import Study, StudyError

# Codes of cells, with their names and node counts (polygon: 3 or more).
CELL_NODES = {1: 1, 3: 2, 5: 3, 7: None, 9: 4, 10: 4, 12: 8, 13: 6, 14: 5, 21: 3, 22: 6, 23: 8, 24: 10, 25: 20, 26: 15, 27: 13}
CELL_NAMES = {1: "vertex", 3: "line", 5: "triangle", 7: "polygon", 9: "quadrilateral", 10: "tetrahedron", 12: "hexahedron", 13: "wedge", 14: "pyramid", 21: "quadratic line", 22: "quadratic triangle", 23: "quadratic quadrilateral", 24: "quadratic tetrahedron", 25: "quadratic hexahedron", 26: "quadratic wedge", 27: "quadratic pyramid"}
DIMENSION = {1: 0, 3: 1, 5: 2, 7: 2, 9: 2, 10: 3, 12: 3, 13: 3, 14: 3}
# Tetrahedra that fill each solid cell, by local node.
TETRAHEDRA = {10: ((0, 1, 2, 3),), 12: ((0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6)), 13: ((0, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, 5)), 14: ((0, 1, 2, 4), (0, 2, 3, 4))}

# Most cells, on average, whose corners meet in one task.
CELLS = 1 << 16


def corner_points(cells: DataFrame, points: DataFrame) -> DataFrame:
    """cells (cell, cell_type, nodes) with ``pts``, one (x, y, z) per corner, in order.

    ``points``: [instance,] node, x, y, z.  Each corner is joined to its node;
    the corners of a cell meet again by its number.  The cells are dealt to tasks
    by their count first: a small file can hold many, and each has many corners.
    The nodes are never broadcast, as they grow with the mesh.
    """
    keys = ["instance"] if "instance" in points.columns else []
    dealt = cells.repartition(max(1, -(-cells.count() // CELLS)), "cell")
    corners = dealt.select("cell", "cell_type", F.size("nodes").alias("k"), F.posexplode("nodes").alias("at", "node"))
    met = corners.join(points.withColumnRenamed("node", "__node").hint("merge"), F.col("node") == F.col("__node"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y", "z"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z")))
    return met.groupBy(*keys, "cell").agg(F.first("cell_type").alias("cell_type"), F.first("k").alias("k"), packed.alias("pts"))


def _minus(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]


def _cross(u, v):
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def _norm(v) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def cell_measure(pts: Column, cell_type: Column) -> Column:
    """Length, area or volume of a cell; 1 for a vertex."""
    line = _norm(_minus(pts[1], pts[0]))
    turns = F.transform(F.sequence(F.lit(1), F.size(pts) - 2), lambda i: F.struct(*(c.alias(n) for c, n in zip(_cross(_minus(F.get(pts, i), pts[0]), _minus(F.get(pts, i + 1), pts[0])), "xyz", strict=True))))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in "xyz"))
    total = F.aggregate(turns, zero, lambda s, t: F.struct(*((s[n] + t[n]).alias(n) for n in "xyz")))
    face = _norm([total[n] for n in "xyz"]) / 2
    out = F.when(cell_type == 1, F.lit(1.0)).when(cell_type == 3, line).when(cell_type.isin(5, 7, 9), face)
    for code, solids in TETRAHEDRA.items():
        volume = F.lit(0.0)
        for a, b, c, d in solids:
            u, v, w = (_minus(pts[i], pts[a]) for i in (b, c, d))
            n = _cross(u, v)
            volume = volume + (n[0] * w[0] + n[1] * w[1] + n[2] * w[2])
        out = out.when(cell_type == code, F.abs(volume) / 6)
    return out


def points_of(study: Study, support: str) -> DataFrame:
    """(instance, node, x, y, z) of a support's coordinates; missing axes are 0."""
    slot = next(s for s in study.manifest.arrays() if s.support == support and s.role == "coordinates")
    width = slot.components or 1
    flat = study.payload(slot).select("instance", F.posexplode(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / width).cast("int"))).alias("node", "__n"), "values")
    pick = lambda i: F.get("values", F.col("node") * width + i) if i < width else F.lit(0.0)
    return flat.select("instance", F.col("node").cast("bigint").alias("node"), *(pick(i).alias(n) for i, n in enumerate("xyz")))


def dimension_of(study: Study, support: str) -> int:
    """The one dimension of a support's cells; mixed and quadratic ones are refused."""
    types = [r.cell_type for r in study.cells.where(F.col("support") == support).select("cell_type").distinct().collect()]
    for t in types:
        if t not in CELL_NODES:
            raise StudyError("E21", f"unknown cell type {t}")
        if t not in DIMENSION:
            raise StudyError("E21", f"no measure for a {CELL_NAMES[t]} cell")
    dims = {DIMENSION[t] for t in types}
    if len(dims) > 1:
        raise StudyError("E22", f"cells of dimensions {sorted(dims)} in {support}")
    return dims.pop() if dims else 0


def cell_measures(study: Study, support: str) -> DataFrame:
    """(instance, cell, measure): an instance for each of the coordinates'."""
    dimension_of(study, support)
    cells = study.cells.where(F.col("support") == support).select("cell", "cell_type", "nodes")
    return corner_points(cells, points_of(study, support)).select("instance", "cell", cell_measure(F.col("pts"), F.col("cell_type")).alias("measure"))


def lump(measures: DataFrame, cells: DataFrame) -> DataFrame:
    """(instance, node, weight): each cell's measure shared equally by its nodes."""
    own = cells.select(F.col("cell").alias("__cell"), F.size("nodes").alias("__k"), F.explode("nodes").alias("node"))
    return measures.join(own, F.col("cell") == F.col("__cell")).groupBy("instance", "node").agg(F.sum(F.col("measure") / F.col("__k")).alias("weight"))


def axis_weights(points: DataFrame) -> DataFrame:
    """(instance, node, weight): half the gap to either neighbour, in node order."""
    order = Window.partitionBy("instance").orderBy("node")
    back, ahead = F.abs(F.col("x") - F.lag("x").over(order)), F.abs(F.lead("x").over(order) - F.col("x"))
    return points.select("instance", "node", ((F.coalesce(back, F.lit(0.0)) + F.coalesce(ahead, F.lit(0.0))) / 2).alias("weight"))


def computed_weights(study: Study, support: str, location: str = "node") -> DataFrame:
    """(instance, site, weight) from the support's coordinates."""
    kind = study.manifest.support(support).kind
    if kind == "axis":
        return axis_weights(points_of(study, support)).withColumnRenamed("node", "site")
    measures = cell_measures(study, support)
    if location == "cell":
        return measures.select("instance", F.col("cell").alias("site"), F.col("measure").alias("weight"))
    cells = study.cells.where(F.col("support") == support)
    return lump(measures, cells).withColumnRenamed("node", "site")


def with_weights(study: Study, support: str, location: str = "node", name: str = "weight") -> Study:
    """The study with computed weights stored in place of any it has."""
    import dataclasses

    coords = next(s for s in study.manifest.arrays() if s.support == support and s.role == "coordinates")
    kind = study.manifest.support(support).kind
    dim = 1 if kind == "axis" else dimension_of(study, support)
    slot = Slot(name, location, support, "weight", power(coords.units or "1", dim) if dim else "1", coords.varies, 1, recomputed=True)
    weights = computed_weights(study, support, location)
    values = F.transform(F.array_sort(F.collect_list(F.struct("site", "weight"))), lambda s: s["weight"])
    packed = weights.groupBy("instance").agg(values.alias("values")).select(F.lit(support).alias("support"), F.lit(location).alias("location"), F.lit(name).alias("slot"), "instance", F.lit(None).cast("int").alias("draw"), "values", F.lit(None).cast("array<bigint>").alias("labels"))
    old = [s for s in study.manifest.slots if s.role == "weight" and (s.support, s.location) == (support, location)]
    drop = F.lit(False)
    for s in old:
        drop = drop | ((F.col("support") == support) & (F.col("location") == location) & (F.col("slot") == s.name))
    manifest = dataclasses.replace(study.manifest, slots=[s for s in study.manifest.slots if s not in old] + [slot])
    return study.replace(manifest=manifest, slot_values=study.slot_values.where(~drop).unionByName(packed))
