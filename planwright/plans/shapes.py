"""Scalar geometry, text, arrays, nested blocks, graphs, clustering and region finding as queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.functions import entities
from planwright.functions import geometry as G
from planwright.functions import text as T
from planwright.functions import vectors as V
from planwright.operators import blocks, faces, finders, graph, hierarchy, kernels, nearby, occupancy
from planwright.operators.chunking import chunk_layouts
from planwright.operators.community import block_communities
from planwright.operators.islands import stacked_texts
from planwright.operators.occupancy import cell_components, dilated
from planwright.operators.ordering import with_row_number
from planwright.operators.spatial import box_join, merged_boxes
from planwright.plans.joins import region_graph
from planwright.plans.layouts import ring
from planwright.plans.registry import query
from planwright.sources.drawings import drawing, drawing_sql
from planwright.sources.tables import table
from planwright.staging import staged

# ---------------------------------------------------------------- geometry

_PAIRS = drawing_sql("regions") + """, p AS (SELECT a.region_id, a.x0 AS a1, a.y0 AS b1, a.x0 + a.w AS c1, a.y0 + a.h AS d1, a.x0 + a.w / 3 AS a2, a.y0 - 1 AS b2, a.x0 + 9 AS c2, a.y0 + 4 AS d2 FROM regions a),
o AS (SELECT *, greatest(least(c1, c2) - greatest(a1, a2), 0) AS ow, greatest(least(d1, d2) - greatest(b1, b2), 0) AS oh, (c1 - a1) * (d1 - b1) AS s1, greatest(c2 - a2, 0) * greatest(d2 - b2, 0) AS s2 FROM p)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x0"), F.col("y0")
    return drawing(spark, sf_dir, "regions").select("region_id", "w", "h", G.ring_box(ring()).alias("a"), G.box(x + F.col("w") / 3, y - 1, x + 9, y + 4).alias("b"))


@query(drawing_sql("regions") + " SELECT region_id, w * h / 2 AS area FROM regions")
def m1_shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a triangle in each region."""
    x, y = F.col("x0"), F.col("y0")
    tri = F.array(G.point(x, y), G.point(x + F.col("w"), y), G.point(x, y + F.col("h")))
    return drawing(spark, sf_dir, "regions").select("region_id", G.ring_area(tri).alias("area"))


@query(drawing_sql("regions") + " SELECT region_id, round(x0 + w / 3, 6) AS cx, round(y0 + h / 3, 6) AS cy FROM regions")
def m2_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x0"), F.col("y0")
    c = G.ring_centroid(F.array(G.point(x, y), G.point(x + F.col("w"), y), G.point(x, y + F.col("h"))))
    return drawing(spark, sf_dir, "regions").select("region_id", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(_PAIRS + " SELECT region_id, round(CASE WHEN s1 + s2 - ow * oh > 0 THEN ow * oh / (s1 + s2 - ow * oh) ELSE 0 END, 9) AS iou FROM o")
def m4_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).select("region_id", F.round(G.iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query(_PAIRS + """ SELECT region_id, CASE WHEN c2 > a2 THEN ow * oh ELSE 0 END AS intersection_area, round(CASE WHEN c2 > a2 THEN ow * oh / least(s1, s2) ELSE 0 END, 9) AS smaller_area_ratio,
round(CASE WHEN c2 > a2 THEN ow / least(c1 - a1, c2 - a2) ELSE 0 END, 9) AS width_ratio, round(CASE WHEN c2 > a2 THEN oh / least(d1 - b1, d2 - b2) ELSE 0 END, 9) AS height_ratio FROM o""")
def m5_overlap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.overlap_metrics(F.col("a"), F.col("b"))
    return _two(spark, sf_dir).select("region_id", m["intersection_area"].alias("intersection_area"), *(F.round(m[k], 9).alias(k) for k in ("smaller_area_ratio", "width_ratio", "height_ratio")))


@query(drawing_sql("regions") + " SELECT region_id, round(sqrt(pow(greatest(x0 - 500, 0, 500 - x0 - w), 2) + pow(greatest(y0 - 500, 0, 500 - y0 - h), 2)), 6) AS distance FROM regions")
def m6_box_point_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "regions").select("region_id", F.round(G.box_distance(G.ring_box(ring()), 500.0, 500.0), 6).alias("distance"))


_ROT = "CASE WHEN abs(CAST(p_size AS DOUBLE)) > 2 * pi() + 1e-6 THEN radians(p_size) ELSE CAST(p_size AS DOUBLE) END"


@query(f"SELECT p_partkey, round(10 + 2 * cos({_ROT}) * 3 - 0.5 * sin({_ROT}) * 4, 6) AS x, round(20 + 2 * sin({_ROT}) * 3 + 0.5 * cos({_ROT}) * 4, 6) AS y, round(10 + 2 * cos(radians(p_size)) * 3 - 0.5 * sin(radians(p_size)) * 4, 6) AS x_degrees FROM part")
def m7_m9_insert_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radians unless over a full turn, or always degrees."""
    r = F.col("p_size").cast("double")
    p = G.apply_matrix(G.insert_matrix(10.0, 20.0, 2.0, 0.5, r), 3.0, 4.0)
    d = G.apply_matrix(G.insert_matrix(10.0, 20.0, 2.0, 0.5, r, degrees=True), 3.0, 4.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), F.round(d["x"], 6).alias("x_degrees"))


_ARC = "(CASE WHEN (p_partkey * 7) % 360 < p_partkey % 360 THEN (p_partkey * 7) % 360 + 360 ELSE (p_partkey * 7) % 360 END)"


@query(f"SELECT p_partkey, i, round(p_size * cos(radians(p_partkey % 360 + ({_ARC} - p_partkey % 360) * i / 36.0)), 5) + 0.0 AS x, round(p_size * sin(radians(p_partkey % 360 + ({_ARC} - p_partkey % 360) * i / 36.0)), 5) + 0.0 AS y FROM part, range(37) t(i)")
def m10_m11_arc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """37 points of an arc; an end before the start wraps."""
    p = table(spark, sf_dir, "part")
    points = G.arc_points(0.0, 0.0, F.col("p_size").cast("double"), F.col("p_partkey") % 360, F.col("p_partkey") * 7 % 360)
    out = p.select("p_partkey", F.posexplode(points).alias("i", "p"))
    return out.select("p_partkey", F.col("i").cast("long").alias("i"), (F.round("p.x", 5) + 0.0).alias("x"), (F.round("p.y", 5) + 0.0).alias("y"))


@query(drawing_sql("entities") + """ SELECT entity_id, CASE type WHEN 'CIRCLE' THEN x - radius ELSE x END AS min_x, CASE type WHEN 'CIRCLE' THEN y - radius ELSE y END AS min_y,
CASE type WHEN 'CIRCLE' THEN x + radius WHEN 'TEXT' THEN x + length(text) * radius * 0.7 WHEN 'LINE' THEN x + radius ELSE x END AS max_x, CASE type WHEN 'CIRCLE' THEN y + radius WHEN 'TEXT' THEN y + radius ELSE y END AS max_y FROM entities""")
def m12_m14_entity_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative points by type, then their box; a text is about 0.7 of its height wide for each letter."""
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    points = (
        F.when(F.col("type") == "CIRCLE", F.array(G.point(x - r, y - r), G.point(x + r, y + r)))
        .when(F.col("type") == "TEXT", F.array(G.point(x, y), G.point(x + F.char_length("text") * r * 0.7, y + r)))
        .when(F.col("type") == "LINE", F.array(G.point(x, y), G.point(x + r, y)))
        .otherwise(F.array(G.point(x, y)))
    )
    return drawing(spark, sf_dir, "entities").select("entity_id", G.ring_box(points).alias("b")).select("entity_id", "b.*")


#: Entities of fourteen kinds from the rows of ``part``.
_SHAPES = """WITH p AS (SELECT p_partkey AS k, CAST((p_partkey * 13) % 4000 AS DOUBLE) AS x, CAST((p_partkey * 29) % 4000 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS r, p_name AS text,
['LINE', 'LWPOLYLINE', 'POLYLINE', 'INSERT', 'CIRCLE', 'ARC', 'ATTRIB', 'POINT', 'SOLID', 'ELLIPSE', 'SPLINE', 'HATCH', 'DIMENSION', 'TEXT'][p_partkey % 14 + 1] AS type, CASE WHEN p_partkey % 97 = 0 THEN 200000 ELSE 0 END AS far FROM part)"""
_KINDS = ["LINE", "LWPOLYLINE", "POLYLINE", "INSERT", "CIRCLE", "ARC", "ATTRIB", "POINT", "SOLID", "ELLIPSE", "SPLINE", "HATCH", "DIMENSION", "TEXT"]


def _sql_points(**lists: str) -> str:
    out = " ".join(f"WHEN '{kind}' THEN [{', '.join(f'[{x}, {y}]' for x, y in (p.split(',') for p in text.split()))}]" for kind, text in lists.items())
    return f", l AS (SELECT k, type, x, y, r, text, unnest(CASE type {out} ELSE [[x, y]] END) AS p FROM p)"


_CORNERS = "x,y x+r,y x,y+r x+r,y+r"
_HATCHED = "x,y x+r,y x,y+r x-1,y x,y-2 x+3,y+3 x+r,y+9"
_SPLINED = "x,y x+r,y+5 x+2*r,y x+1,y+1"
_MARKS = "x,y x,y+r x+r,y+r"
_SPARSE = _sql_points(LINE="x,y x+r+far,y+2", LWPOLYLINE="x,y x+r,y x+r,y+r", POLYLINE="x,y x-r,y+1", SOLID=_CORNERS, ELLIPSE="x,y x+r,y+1 x-r,y-1 x-0.5,y+r/2 x+0.5,y-r/2", SPLINE=_SPLINED, HATCH=_HATCHED, DIMENSION=_MARKS)


def shapes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, e): entities of all kinds, with some far too long."""
    k, r = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y = (k * 13 % 4000).cast("double"), (k * 29 % 4000).cast("double")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 14 + 1).cast("int"))
    is_ = lambda *names: kind.isin(*names)
    p = G.point
    far = F.when(k % 97 == 0, 200000.0).otherwise(0.0)
    edge = F.struct(p(x - 1, y).alias("start"), p(x, y - 2).alias("end"), p(x + 3, y + 3).alias("center"), F.array(p(x + r, y + 9)).alias("control"))
    values = {
        "type": kind, "start": F.when(is_("LINE"), p(x, y)), "end": F.when(is_("LINE"), p(x + r + far, y + 2)),
        "vertices": F.when(is_("LWPOLYLINE"), F.array(p(x, y), p(x + r, y), p(x + r, y + r))).when(is_("POLYLINE"), F.array(p(x, y), p(x - r, y + 1))), "closed": k % 2 == 0,
        "position": F.when(is_("INSERT", "ATTRIB", "POINT", "TEXT"), p(x, y)), "center": F.when(is_("CIRCLE", "ARC", "ELLIPSE"), p(x, y)), "radius": F.when(is_("CIRCLE", "ARC", "TEXT"), r),
        "major": F.when(is_("ELLIPSE"), p(r, F.lit(1.0))), "ratio": F.lit(0.5), "corners": F.when(is_("SOLID"), F.array(p(x, y), p(x + r, y), p(x, y + r), p(x + r, y + r))),
        "control": F.when(is_("SPLINE"), F.array(p(x, y), p(x + r, y + 5), p(x + 2 * r, y))), "fit": F.when(is_("SPLINE"), F.array(p(x + 1, y + 1))),
        "loops": F.when(is_("HATCH"), F.array(F.struct(F.array(p(x, y), p(x + r, y), p(x, y + r)).alias("polyline"), F.array(edge).alias("edges")))),
        "marks": F.when(is_("DIMENSION"), F.array(p(x, y), p(x, y + r), p(x + r, y + r))), "text": F.when(is_("TEXT"), F.col("p_name")), "width": F.lit(0.0),
    }
    return table(spark, sf_dir, "part").select(k.alias("k"), F.struct(*(v.alias(n) for n, v in values.items())).cast(entities.SHAPE).alias("e"))


def _spread(rows: DataFrame, points: Column) -> DataFrame:
    return rows.select("k", F.explode(points).alias("p")).select("k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(_SHAPES + _SPARSE + " SELECT k, round(p[1], 6) AS x, round(p[2], 6) AS y FROM l QUALIFY max(p[1]) OVER (PARTITION BY k) - min(p[1]) OVER (PARTITION BY k) <= 100000")
def m12_entity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative points of all kinds; entities that are far too long have none."""
    return _spread(shapes_of_parts(spark, sf_dir), entities.points(F.col("e")))


#: The middle of the last piece of a line is there where the line is closed.
_CLOSED = "CASE WHEN k % 2 = 0 THEN {} END"
_DENSE = _sql_points(LINE="x,y x+r+far,y+2 x+(r+far)/2,y+1", LWPOLYLINE="x,y x+r,y x+r,y+r x+r/2,y x+r,y+r/2 LAST,y+r/2", POLYLINE="x,y x-r,y+1 x-r/2,y+0.5 BACK,y+0.5", CIRCLE="x,y x+r,y x-r,y x,y+r x,y-r", ELLIPSE="x,y x+r,y+1 x-r,y-1", SOLID=_CORNERS, SPLINE=_SPLINED, HATCH=_HATCHED, DIMENSION=_MARKS)


@query(_SHAPES + _DENSE.replace("LAST", _CLOSED.format("x + r / 2")).replace("BACK", _CLOSED.format("x - r / 2")) + " SELECT k, round(p[1], 6) AS x, round(p[2], 6) AS y FROM l WHERE p[1] IS NOT NULL")
def m13_dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the middles of straight pieces, of closed lines of the last one too, and the ends of a circle's axes."""
    return _spread(shapes_of_parts(spark, sf_dir), entities.dense_points(F.col("e")))


@query(_SHAPES + _SPARSE + """, b AS (SELECT k, any_value(type) AS type, any_value(x) AS x, any_value(y) AS y, any_value(r) AS r, any_value(text) AS text, min(p[1]) AS a, min(p[2]) AS b, max(p[1]) AS c, max(p[2]) AS d FROM l GROUP BY k)
SELECT k, type, round(CASE type WHEN 'CIRCLE' THEN x - r ELSE a END, 6) AS min_x, round(CASE type WHEN 'CIRCLE' THEN y - r ELSE b END, 6) AS min_y,
round(CASE type WHEN 'CIRCLE' THEN x + r WHEN 'TEXT' THEN x + length(text) * r * 0.7 ELSE c END, 6) AS max_x, round(CASE type WHEN 'CIRCLE' THEN y + r WHEN 'TEXT' THEN y + r ELSE d END, 6) AS max_y FROM b""")
def m14_boxes_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = shapes_of_parts(spark, sf_dir).select("k", "e.type", entities.box(F.col("e")).alias("b"))
    return b.select("k", "type", *(F.round(F.col("b")[c], 6).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four edges of each region: file_id, region_id, side, x1, y1, x2, y2."""
    r = drawing(spark, sf_dir, "regions").withColumn("ring", ring())
    e = r.select("file_id", "region_id", "layer", "ring", F.posexplode("ring").alias("side", "p"))
    q = F.element_at("ring", (F.col("side") + 1) % 4 + 1)
    return e.select("file_id", "region_id", "layer", F.col("side").cast("long").alias("side"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


_SEG = drawing_sql("regions") + """, seg AS (
SELECT file_id, region_id, layer, 0 AS side, x0 AS x1, y0 AS y1, x0 + w AS x2, y0 AS y2 FROM regions UNION ALL SELECT file_id, region_id, layer, 1, x0 + w, y0, x0 + w, y0 + h FROM regions
UNION ALL SELECT file_id, region_id, layer, 2, x0 + w, y0 + h, x0, y0 + h FROM regions UNION ALL SELECT file_id, region_id, layer, 3, x0, y0 + h, x0, y0 FROM regions)"""


@query(_SEG + " SELECT region_id, side, x1, y1, x2, y2 FROM seg")
def m15_world_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("region_id", "side", "x1", "y1", "x2", "y2")


@query("SELECT p_partkey, round(least(abs(atan2(p_size - 25, p_partkey % 40 - 20)), pi() - abs(atan2(p_size - 25, p_partkey % 40 - 20))), 6) AS angle FROM part")
def m16_segment_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = G.segment_angle(0.0, 0.0, (F.col("p_partkey") % 40 - 20).cast("double"), (F.col("p_size") - 25).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(a, 6).alias("angle"))


@query(drawing_sql("regions") + ", c AS (SELECT file_id, layout_id, var_pop(x0) AS a, covar_pop(x0, y0) AS b, var_pop(y0) AS d FROM regions GROUP BY ALL) SELECT file_id, layout_id, round((a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b), 1) AS major, round((a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b), 1) AS minor FROM c")
def m19_principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues of the 2 x 2 covariance in closed form."""
    c = drawing(spark, sf_dir, "regions").groupBy("file_id", "layout_id").agg(F.var_pop("x0").alias("a"), F.covar_pop("x0", "y0").alias("b"), F.var_pop("y0").alias("d"))
    mid, off = (F.col("a") + F.col("d")) / 2, F.sqrt(((F.col("a") - F.col("d")) / 2) ** 2 + F.col("b") ** 2)
    return c.select("file_id", "layout_id", F.round(mid + off, 1).alias("major"), F.round(mid - off, 1).alias("minor"))


@query(drawing_sql("regions") + " SELECT region_id, round_even(x0 / 7, 2) AS x, round_even(y0 / 7, 2) AS y FROM regions WHERE region_id % 2 = 0")
def m20_clean_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(G.point(F.when(F.col("region_id") % 2 == 0, F.col("x0") / 7).otherwise(float("nan")), F.col("y0") / 7))
    return drawing(spark, sf_dir, "regions").select("region_id", F.explode(G.clean_ring(raw)).alias("p")).select("region_id", "p.x", "p.y")


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def m21_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(drawing_sql("regions") + " SELECT region_id, round(x0 + w * 0.25, 6) AS min_x, round(y0 + h - h * 0.9, 6) AS min_y, round(x0 + w * 0.75, 6) AS max_x, round(y0 + h - h * 0.1, 6) AS max_y FROM regions")
def m23_sub_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.sub_box(G.ring_box(ring()), 0.25, 0.1, 0.75, 0.9)
    return drawing(spark, sf_dir, "regions").select("region_id", *(F.round(b[k], 6).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")))


@query(drawing_sql("regions") + ", k AS (SELECT file_id, region_id, row_number() OVER (PARTITION BY file_id ORDER BY region_id) - 1 AS i, CAST(ceil(sqrt(count(*) OVER (PARTITION BY file_id))) AS BIGINT) AS cols FROM regions) SELECT region_id, i % cols AS gx, i // cols AS gy FROM k")
def m24_gallery_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("file_id")
    k = drawing(spark, sf_dir, "regions").withColumns({"i": F.row_number().over(by.orderBy("region_id")) - 1, "cols": F.ceil(F.sqrt(F.count("*").over(by)))})
    return k.select("region_id", (F.col("i") % F.col("cols")).alias("gx"), F.expr("i div cols").alias("gy"))


@query(drawing_sql("regions") + " SELECT region_id, greatest(x0 - 30, 0) AS min_x, greatest(y0 - 30, 0) AS min_y, least(x0 + w + 30, 9000) AS max_x, least(y0 + h + 30, 4000) AS max_y FROM regions")
def m25_crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "regions").select("region_id", G.clamp(G.grow(G.ring_box(ring()), 30.0), 9000.0, 4000.0).alias("b")).select("region_id", "b.*")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN length(p_brand) % 2 = 0 THEN 256 END, 7) AS color FROM part")
def m27_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the entity, else of its layer, else the default."""
    own, layer = F.when(F.col("p_size") % 3 == 0, F.col("p_size")), F.when(F.char_length("p_brand") % 2 == 0, 256)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(own, layer, F.lit(7)).alias("color"))


# ---------------------------------------------------------------- text

_MTEXT = [r"\A1;{hi}\Pthere", r"\S1^2; in", r"\fArial|b0;\LUnder\l \~x", r"\U+4E2D\U+6587 \U+00e9", r"plain", r"\H2.5x;{\C1;red}\Pend", ""]


@query()
def t1_t2_mtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both decoders on hand-made codes, one for each document."""
    codes = F.array(*map(F.lit, _MTEXT))
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(codes, (F.col("doc_id") % len(_MTEXT) + 1).cast("int")).alias("t"))
    return d.select("doc_id", T.decode_mtext(F.col("t")).alias("long_form"), T.decode_mtext_short(F.col("t")).alias("short_form"))


_PLAIN, _WIDE = "0123456789ABCDEFGHIJ", "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪ"


@query(f"SELECT doc_id, '{_PLAIN}' || replace(text, 'fi', 'fi') || ' 1/2 ffi' AS normal, trim(regexp_replace(lower('{_PLAIN}' || replace(text, 'ß', 'ss') || ' 1/2 ffi'), '[ \\t\\n\\r]+', ' ', 'g')) AS match FROM documents".replace("1/2", "1⁄2"))
def t3_t4_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose digits and capitals are written wide, with a ligature and a fraction: the compatibility form, and that form folded for matching."""
    wide = F.concat(F.translate(F.lit(_PLAIN), _PLAIN, _WIDE), F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("　½\u00a0ﬃ"))
    return table(spark, sf_dir, "documents").select("doc_id", T.nfkc(wide).alias("normal"), T.match_form(wide).alias("match"))


@query(drawing_sql("annotations") + " SELECT id, regexp_replace(translate(replace(lower(text), 'ß', 'ss'), '～∼〜至到－—', '~~~~~--'), '[\\s\\-_~]', '', 'g') AS loose FROM annotations")
def t5_loose_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "annotations").select("id", T.loose_form(F.col("text")).alias("loose"))


@query(drawing_sql("annotations") + " SELECT id, regexp_extract(text, 'the.*on') AS hit FROM annotations WHERE regexp_matches(text, 'the.*on')")
def t6_t9_keyword_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a keyword in order with gaps; the match itself is returned."""
    p = T.keyword_pattern("the on")
    return drawing(spark, sf_dir, "annotations").where(F.col("text").rlike(p)).select("id", F.regexp_extract("text", p, 0).alias("hit"))


@query(drawing_sql("annotations") + ", q(q) AS (VALUES ('ing'), ('der'), ('zzz')) SELECT id, string_agg(q, ',' ORDER BY q) AS queries FROM annotations JOIN q ON contains(lower(text), q) GROUP BY 1")
def t7_multi_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.array_sort(T.matched(F.col("text"), ["ing", "der", "zzz"]))
    return drawing(spark, sf_dir, "annotations").withColumn("hit", hit).where(F.size("hit") > 0).select("id", F.array_join("hit", ",").alias("queries"))


@query(drawing_sql("annotations") + """, l AS (SELECT layer, id, text, y / 4 AS y, CAST(floor(x / 20 / 300 + 0.5) AS BIGINT) AS band FROM annotations),
c AS (SELECT *, CASE WHEN lag(y) OVER w - y > 250 THEN 1 ELSE 0 END AS cut FROM l WINDOW w AS (PARTITION BY layer, band ORDER BY y DESC, id)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY layer, band ORDER BY y DESC, id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT layer, arg_min(id, (-y, id)) AS first_id, CAST(count(*) AS INTEGER) AS size, trim(string_agg(text, ' ' ORDER BY y DESC, id) FILTER (trim(text) <> '')) AS text FROM i
GROUP BY layer, band, island HAVING count(*) > 1 AND count(*) FILTER (trim(text) <> '') > 0""")
def t8_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several lines in each layer, by bands and gaps."""
    a = drawing(spark, sf_dir, "annotations").select("layer", "id", "text", (F.col("x") / 20).alias("x"), (F.col("y") / 4).alias("y"), F.lit(None).cast("double").alias("height"))
    return stacked_texts(a, "layer")


@query(drawing_sql("annotations") + f""", t AS (SELECT id, layer, x, y, CASE WHEN id % 3 = 0 THEN left(text, CAST(id % 60 AS INTEGER)) ELSE left(text, CAST(id % 60 AS INTEGER)) || [{", ".join(f"'{w}'" for w in T.TITLES)}, '平面'][id % {len(T.TITLES) + 1} + 1] END AS title FROM annotations),
a AS (SELECT * FROM t WHERE length(title) <= 48 AND regexp_matches(title, '{"|".join(T.TITLES)}')) SELECT id, title, row_number() OVER (ORDER BY round_even(x / 10000, 0), y DESC, id) AS k FROM a""")
def t10_title_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts with a title word, in reading order; the words are put behind beginnings of the annotations."""
    words = F.array(*map(F.lit, [*T.TITLES, "平面"]))
    begin = F.left("text", (F.col("id") % 60).cast("int"))
    title = F.when(F.col("id") % 3 == 0, begin).otherwise(F.concat(begin, F.element_at(words, (F.col("id") % (len(T.TITLES) + 1) + 1).cast("int"))))
    found = drawing(spark, sf_dir, "annotations").withColumn("title", title).where(T.is_title(F.col("title")))
    placed = found.select("id", "title", F.bround(F.col("x") / 10000, 0).alias("column"), (-F.col("y")).alias("down"))
    return with_row_number(placed, ["column", "down", "id"], "k").select("id", "title", (F.col("k") + 1).cast("long").alias("k"))


@query("SELECT conv_id, turn, regexp_replace(text, '(?i)the', '@ref', 'g') AS said FROM conversations WHERE regexp_matches(text, '(?i)the')")
def t11_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by name, case aside, become ids."""
    return table(spark, sf_dir, "conversations").where(F.col("text").rlike("(?i)the")).select("conv_id", "turn", F.regexp_replace("text", "(?i)the", "@ref").alias("said"))


@query("SELECT doc_id, regexp_matches(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]') AS cjk, length(text) = octet_length(encode(text)) AS ascii FROM documents")
def t12_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.has_cjk(F.col("text")).alias("cjk"), T.is_ascii(F.col("text")).alias("ascii"))


@query("SELECT doc_id, text AS clean FROM documents")
def t13_valid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no text are replaced."""
    return table(spark, sf_dir, "documents").select("doc_id", F.make_valid_utf8("text").alias("clean"))


@query("SELECT event_id, CASE WHEN v < 60 THEN printf('%.1fs', v) ELSE printf('%dm%04.1fs', CAST(floor(v / 60) AS BIGINT), v - floor(v / 60) * 60) END AS took FROM (SELECT event_id, floor(value * 10) / 10 AS v FROM events WHERE value >= 1)")
def t14_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value >= 1").select("event_id", T.duration(F.floor(F.col("value") * 10) / 10).alias("took"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...[truncated]' ELSE text END AS short FROM conversations")
def t15_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.shorten(F.col("text"), 100).alias("short"))


@query("SELECT doc_id, regexp_matches(md5(CAST(doc_id AS VARCHAR)), '^[0-9a-fA-F]{16,}$') AS is_id, regexp_extract('/x/' || doc_id || '.geojson', '([^/]+)\\.geojson$', 1) AS file_id FROM documents")
def t16_t17_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".geojson"))
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_like_id(F.md5(F.col("doc_id").cast("string"))).alias("is_id"), F.regexp_extract(path, r"([^/]+)\.geojson$", 1).alias("file_id"))


@query("SELECT conv_id, turn, replace('see {{task_1_result}}.', '{{task_1_result}}', substr(text, 1, 20)) AS filled FROM conversations WHERE turn = 1")
def t18_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a placeholder names the turn whose text takes its place."""
    args = spark.createDataFrame([("see {{task_1_result}}.",)], "arg string").select("arg", F.explode(F.regexp_extract_all("arg", F.lit(r"\{\{task_(\d+)_result\}\}"), 1)).alias("n")).select("arg", F.col("n").cast("long").alias("turn"))
    c = table(spark, sf_dir, "conversations").join(F.broadcast(args), "turn")
    mark = F.concat(F.lit("{{task_"), F.col("turn").cast("string"), F.lit("_result}}"))
    return c.select("conv_id", "turn", F.replace("arg", mark, F.left("text", F.lit(20))).alias("filled"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'plan|elevation|section|whole|general') THEN 'general drawing' ELSE 'sub-region' END AS class FROM conversations WHERE role = 'user'")
def t19_query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword rule in the place of a model's answer."""
    general = F.lower("text").rlike("plan|elevation|section|whole|general")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(general, "general drawing").otherwise("sub-region").alias("class"))


# ---------------------------------------------------------------- arrays, maps, JSON


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a2_a7_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value under any of its names."""
    v = F.try_parse_json("props")
    names = [F.try_variant_get(v, f"$.{n}", "long") for n in ("key", "k", "K")]
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(*names).alias("k"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS children FROM part")
def a3_block_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block is a list of entities or an object that holds one."""
    j = F.try_parse_json(F.when(F.col("p_partkey") % 2 == 0, '[{"a":1},{"a":2}]').otherwise('{"entities":[{"a":1}]}'))
    kids = F.coalesce(F.try_variant_get(j, "$", "array<variant>"), F.try_variant_get(j, "$.entities", "array<variant>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(kids).alias("children"))


@query(drawing_sql("entities") + ", c AS (SELECT layer, type, count(*) AS n FROM entities GROUP BY ALL) SELECT layer, '{' || string_agg('\"' || type || '\":' || n, ',' ORDER BY type) || '}' AS counts FROM c GROUP BY 1")
def a1_a4_count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = drawing(spark, sf_dir, "entities").groupBy("layer", "type").agg(F.count("*").alias("n"))
    return c.groupBy("layer").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n"))))).alias("counts"))


@query("SELECT user_id, max(event_id) AS status, arg_max(event_type, event_id) AS message FROM events GROUP BY 1")
def a5_shallow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later status details win, key by key."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("status"), F.max_by("event_type", "event_id").alias("message"))
    merged = F.map_from_entries(F.map_entries(F.map_filter(F.create_map(F.lit("message"), F.col("message")), lambda k, v: v.isNotNull())))
    return e.select("user_id", "status", F.element_at(merged, "message").alias("message"))


@query("WITH k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role FROM conversations) SELECT conv_id, 'thought_' || i AS name, role AS value FROM k")
def a6_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("steps"))
    return c.select("conv_id", F.posexplode("steps").alias("i", "s")).select("conv_id", F.concat(F.lit("thought_"), F.col("i").cast("string")).alias("name"), F.col("s.role").alias("value"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def a8_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the characters, in place of a model's tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.char_length("text") / 4.0).alias("tokens"))


# ---------------------------------------------------------------- nested blocks

_BLOCKS = [("B0", "LINE", None, 1.0, 0.0, None, None, None), ("B0", "INSERT", "B1", 5.0, 5.0, 2.0, 2.0, 0.5), ("B1", "CIRCLE", None, 2.0, 3.0, None, None, None), ("B1", "INSERT", "B2", 1.0, 1.0, 1.0, 0.0, 90.0), ("B2", "TEXT", None, 0.0, 1.0, None, None, None), ("B2", "INSERT", "B0", 0.0, 0.0, 1.0, 1.0, 0.0)]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in r) + ")" for r in _BLOCKS)


def _expanded(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    root = F.col("p_partkey").alias("root_id")
    top = table(spark, sf_dir, "part").select(root, F.lit("INSERT").alias("type"), F.concat(F.lit("B"), (F.col("p_partkey") % 3).cast("string")).alias("name"), (F.col("p_partkey") % 100).cast("double").alias("x"), F.lit(7.0).alias("y"), F.lit(2.0).alias("x_scale"), F.lit(1.0).alias("y_scale"), (F.col("p_size") / 10.0).alias("rotation"))
    defs = spark.createDataFrame(_BLOCKS, "block string, type string, name string, x double, y double, x_scale double, y_scale double, rotation double")
    return blocks.expand_blocks(top, defs, **how)


_R = "(CASE WHEN abs(coalesce({p}.rotation, 0)) > 2 * pi() + 1e-6 THEN radians({p}.rotation) ELSE coalesce({p}.rotation, 0) END)"
_SX, _SY = "(CASE WHEN coalesce({p}.x_scale, 0) <> 0 THEN {p}.x_scale ELSE 1 END)", "(CASE WHEN coalesce({p}.y_scale, 0) <> 0 THEN {p}.y_scale ELSE 1 END)"
_TREE = f"""WITH RECURSIVE b(block, type, name, x, y, x_scale, y_scale, rotation) AS (VALUES {_VALUES}),
t AS (SELECT p_partkey AS root_id, 'INSERT' AS type, 'B' || p_partkey % 3 AS name, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(7 AS DOUBLE) AS y, CAST(2 AS DOUBLE) AS x_scale, CAST(1 AS DOUBLE) AS y_scale, p_size / 10.0 AS rotation,
  CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS bb, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d, CAST(0 AS DOUBLE) AS tx, CAST(0 AS DOUBLE) AS ty, 0 AS depth FROM part
UNION ALL SELECT t.root_id, b.type, b.name, b.x, b.y, b.x_scale, b.y_scale, b.rotation,
  t.a * sx * cos(r) + t.bb * sx * sin(r), -t.a * sy * sin(r) + t.bb * sy * cos(r), t.c * sx * cos(r) + t.d * sx * sin(r), -t.c * sy * sin(r) + t.d * sy * cos(r), t.a * t.x + t.bb * t.y + t.tx, t.c * t.x + t.d * t.y + t.ty, t.depth + 1
  FROM (SELECT *, {_SX.format(p="t")} AS sx, {_SY.format(p="t")} AS sy, {_R.format(p="t")} AS r FROM t WHERE type = 'INSERT' AND depth < 3) t JOIN b ON b.block = t.name)"""


@query(_TREE + " SELECT root_id, type, depth, round(a * x + bb * y + tx, 5) AS x, round(c * x + d * y + ty, 5) AS y FROM t WHERE type <> 'INSERT'")
def j14_j15_nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with world positions, three levels deep; a cycle of blocks ends there."""
    return _expanded(spark, sf_dir).select("root_id", "type", "depth", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(_TREE + " SELECT type, count(*) AS n, sum(x) AS sx FROM t WHERE type <> 'INSERT' GROUP BY 1")
def j16_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without placement: positions stay local."""
    return _expanded(spark, sf_dir, transform=False).groupBy("type").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


# ---------------------------------------------------------------- graphs


@query(drawing_sql("edges").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), n AS (SELECT DISTINCT src AS node FROM e),
w(node, m) AS (SELECT node, node FROM n UNION SELECT e.dst, w.m FROM w JOIN e ON e.src = w.node), c AS (SELECT node, min(m) AS component FROM w GROUP BY 1)
SELECT node, component FROM c WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING count(*) >= 3)""")
def r2_layout_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of at least three nodes."""
    c = graph.connected_components(drawing(spark, sf_dir, "edges"))
    return c.join(c.groupBy("component").count().where("count >= 3").select("component"), "component", "left_semi").select("node", "component")


@query(drawing_sql("edges") + ", e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT DISTINCT dst AS n FROM e WHERE src % 100 = 1 UNION SELECT DISTINCT src FROM e WHERE src % 100 = 1), h2 AS (SELECT n FROM h1 UNION SELECT dst FROM e JOIN h1 ON src = n) SELECT n AS node FROM h2")
def r5_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within two steps of some nodes: one join a step."""
    e = drawing(spark, sf_dir, "edges")
    both = e.union(e.select("dst", "src")).distinct()
    found = both.where("src % 100 = 1").select(F.col("src").alias("node")).distinct()
    for _ in range(2):
        found = found.union(both.join(found, both["src"] == found["node"]).select("dst")).distinct()
    return found


@query(drawing_sql("edges") + """, e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT src AS n, count(*) AS degree FROM e GROUP BY 1),
t AS (SELECT a.src AS n, count(*) / 2 AS tri FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.dst AND c.src = a.src GROUP BY 1)
SELECT count(*) AS nodes, round(avg(degree), 6) AS avg_degree, round(avg(CASE WHEN degree > 1 THEN coalesce(tri, 0) * 2.0 / (degree * (degree - 1)) ELSE 0 END), 6) AS clustering FROM d LEFT JOIN t USING (n)""")
def g16_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees by a group, triangles by self-joins of ordered edges."""
    e = drawing(spark, sf_dir, "edges")
    both = e.union(e.select("dst", "src"))
    degree = both.groupBy(F.col("src").alias("n")).agg(F.count("*").alias("degree"))
    # each triangle once: a < b < c
    a, b, c = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("src").alias("b"), F.col("dst").alias("c")), e.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    tri = a.join(b, "b").join(c, ["a", "c"]).select(F.explode(F.array("a", "b", "c")).alias("n")).groupBy("n").agg(F.count("*").alias("tri"))
    share = F.when(F.col("degree") > 1, F.coalesce("tri", F.lit(0)) * 2.0 / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return degree.join(tri, "n", "left").agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.round(F.avg(share), 6).alias("clustering"))


def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drawing(spark, sf_dir, "edges")
    c = graph.connected_components(e)
    return e.join(c, e["src"] == c["node"]).select("component", "src", "dst")


@query()
def g16_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, diameter and articulation points of each component."""
    e = drawing(spark, sf_dir, "edges")
    wide = graph.diameters(e)
    cut = graph.articulation_points(e).join(graph.unsent(graph.connected_components(e)), "node").groupBy("component").agg(F.count("*").alias("articulation_points"))
    return wide.join(graph.unsent(cut), "component", "left").select("component", "nodes", "diameter", F.coalesce("articulation_points", F.lit(0).cast("long")).alias("articulation_points"))


@query()
def r1_polygonise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of the edges of the regions of each layer in a file."""
    keys = ["file_id", "layer"]
    found = faces.all_faces(segments(spark, sf_dir), keys, 20.0)
    return found.select(F.concat_ws("/", F.col("file_id").cast("string"), "layer").alias("group_id"), "area", "cx", "cy", "points")


@query()
def q13_region_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that the lines of a drawing enclose, all layers together; each takes the layer of most lines at it."""
    s = segments(spark, sf_dir).withColumn("line", F.col("region_id") * 4 + F.col("side"))
    found = faces.build_regions(s.select("file_id", "line", "layer", "x1", "y1", "x2", "y2"), ["file_id"], 20.0)
    return found.select("file_id", F.round("area", 4).alias("area"), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "points", "layer", "votes")


def region_layouts(spark: SparkSession, sf_dir: str, reach: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the layouts of all drawings: regions at most ``reach`` apart hang together, and three or more make a layout, named by the least."""
    regions = drawing(spark, sf_dir, "regions")
    edges = staged(region_graph(regions, reach), "region-graph")
    found = graph.connected_components(edges).withColumnsRenamed({"node": "region_id", "component": "layout"})
    found = staged(found.withColumn("n", F.count("*").over(Window.partitionBy("layout"))).where("n >= 3").drop("n"), "layouts")
    closed = F.concat(ring(), F.slice(ring(), 1, 1))
    nodes = regions.join(found, "region_id").select("layout", F.col("region_id").alias("node"), (F.col("w") * F.col("h")).alias("area"), (2 * (F.col("w") + F.col("h"))).alias("perimeter"), (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"), closed.alias("ring"))
    return nodes, edges.join(found.withColumnRenamed("region_id", "src").hint("merge"), "src").select("layout", "src", "dst", F.col("weight").cast("long").alias("weight"))


@query()
def r3_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louvain communities of each layout at a resolution of 1.5."""
    nodes, edges = region_layouts(spark, sf_dir)
    found = block_communities(nodes.select(F.col("layout").alias("block"), "node", F.lit(3).alias("twice_resolution")), edges.withColumnRenamed("layout", "block"))
    return found.select(F.col("block").alias("layout"), "node", "community")


@query()
def r3_recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each layout with the nodes next to them."""
    return chunk_layouts(*region_layouts(spark, sf_dir), overlap=1)


@query()
def r4_kmeans_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About one cluster for each 30 nodes of a layout of a file; nodes that an edge of the region graph joins to a cluster's are in it too, as non-core."""
    regions = drawing(spark, sf_dir, "regions").withColumn("layout", F.col("file_id") * 8 + F.col("layout_id"))
    core = staged(kernels.kmeans_chunks(regions.select("layout", F.col("region_id").alias("node"), F.col("x0").alias("x"), F.col("y0").alias("y")), "layout"), "clusters")
    edges = region_graph(regions, 250.0)
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("dst", "src"))
    there = core.select(F.col("layout").alias("there"), F.col("node").alias("next"))
    beside = core.join(both, "node").join(there, "next").where("layout = there").select("layout", F.col("next").alias("node"), "chunk").distinct()
    return beside.join(core, ["layout", "node", "chunk"], "left_anti").withColumn("is_core", F.lit(False)).unionByName(core.withColumn("is_core", F.lit(True)))


@query()
def r7_laplacian_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.laplacian_encodings(component_edges(spark, sf_dir), "component").select("component", "node", F.transform("encoding", lambda x: F.round(x, 6) + 0.0).alias("encoding"))


@query(drawing_sql("regions") + ", l AS (SELECT DISTINCT layout_id, file_id FROM regions), k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY md5(CAST(layout_id * 42 + file_id AS VARCHAR)), layout_id) AS k FROM l) SELECT file_id, layout_id, CASE WHEN k <= 2 THEN 'val' ELSE 'train' END AS fold FROM k")
def r8_layout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole layouts go to one fold, by a hash."""
    w = Window.partitionBy("file_id").orderBy(F.md5((F.col("layout_id") * 42 + F.col("file_id")).cast("string")), "layout_id")
    split = drawing(spark, sf_dir, "regions").select("layout_id", "file_id").distinct().withColumn("k", F.row_number().over(w))
    return split.select("file_id", "layout_id", F.when(F.col("k") <= 2, "val").otherwise("train").alias("fold"))


@query(drawing_sql("edges") + " SELECT src, dst FROM edges WHERE (src * 31 + dst * 17 + 42) % 10 >= 2")
def r9_edge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the edges go; by a seeded hash, so the same ones each time."""
    return drawing(spark, sf_dir, "edges").where((F.col("src") * 31 + F.col("dst") * 17 + 42) % 10 >= 2)


_CELLS = drawing_sql("regions") + ", cell AS (SELECT DISTINCT file_id, CAST(floor(x0 / 40) AS BIGINT) AS cx, CAST(floor(y0 / 20) AS BIGINT) AS cy FROM regions)"


def occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions")
    return r.select("file_id", F.floor(F.col("x0") / 40).alias("cx"), F.floor(F.col("y0") / 20).alias("cy")).distinct()


@query(_CELLS + " SELECT file_id, cx, cy FROM cell")
def q9_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupied(spark, sf_dir)


@query(_CELLS.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT file_id, cx, cy FROM cell QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY (cx - 25) * (cx - 25) + (cy - 20) * (cy - 20), cx, cy) = 1),
f(file_id, cx, cy) AS (SELECT * FROM s UNION SELECT c.file_id, c.cx, c.cy FROM f JOIN cell c ON c.file_id = f.file_id AND abs(c.cx - f.cx) <= 1 AND abs(c.cy - f.cy) <= 1)
SELECT file_id, CAST(min(cx) * 40 AS DOUBLE) AS min_x, CAST(min(cy) * 20 AS DOUBLE) AS min_y, CAST((max(cx) + 1) * 40 AS DOUBLE) AS max_x, CAST((max(cy) + 1) * 20 AS DOUBLE) AS max_y, count(*) AS cells FROM f GROUP BY 1""")
def r10_q10_flood_from_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each drawing the seed is moved to the nearest occupied cell; that cell's 8-connected component's box."""
    cells = occupied(spark, sf_dir)
    seed = cells.groupBy("file_id").agg(F.min_by(F.struct("cx", "cy"), F.struct((F.col("cx") - 25) ** 2 + (F.col("cy") - 20) ** 2, "cx", "cy")).alias("s"))
    found = cell_components(cells, ["file_id"], diagonal=True)
    mine = found.join(seed.select("file_id", "s.cx", "s.cy"), ["file_id", "cx", "cy"]).select("file_id", "component")
    box = found.join(mine, ["file_id", "component"]).groupBy("file_id")
    return box.agg((F.min("cx") * 40.0).alias("min_x"), (F.min("cy") * 20.0).alias("min_y"), ((F.max("cx") + 1) * 40.0).alias("max_x"), ((F.max("cy") + 1) * 20.0).alias("max_y"), F.count("*").alias("cells"))


@query(_CELLS + """, d(a) AS (VALUES (-1), (0), (1)), g AS (SELECT DISTINCT file_id, cx + p.a AS cx, cy + q.a AS cy FROM cell, d p, d q)
SELECT file_id, count(*) AS dilated, (SELECT count(*) FROM cell WHERE cell.file_id = g.file_id) AS cells FROM g GROUP BY 1""")
def r12_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = occupied(spark, sf_dir)
    grown = dilated(cells, ["file_id"]).groupBy("file_id").agg(F.count("*").alias("dilated"))
    return grown.join(cells.groupBy("file_id").agg(F.count("*").alias("cells")), "file_id")


_POINTS = drawing_sql("regions").replace("WITH ", "WITH RECURSIVE ", 1) + """, pt AS (SELECT file_id, x0 AS x, y0 AS y FROM regions UNION ALL SELECT file_id, x0 + w, y0 + h FROM regions),
fine AS (SELECT file_id, CAST(floor(x / 20) AS BIGINT) AS cx, CAST(floor(y / 20) AS BIGINT) AS cy, count(*) AS n FROM pt GROUP BY ALL), k(scale) AS (VALUES (20), (40), (80)),
cell AS (SELECT file_id, scale, CAST(floor(cx * 20 / scale) AS BIGINT) AS cx, CAST(floor(cy * 20 / scale) AS BIGINT) AS cy, CAST(sum(n) AS BIGINT) AS n FROM fine, k GROUP BY ALL)"""


def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the regions counted in cells of 20, and these in cells twice and four times as large."""
    r = drawing(spark, sf_dir, "regions").select("file_id", F.explode(F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x0") + F.col("w"), F.col("y0") + F.col("h")))).alias("p"))
    return occupancy.pyramid(r.select("file_id", "p.x", "p.y"), ["file_id"], 20, 3)


@query(_POINTS + " SELECT file_id, CAST(scale AS INTEGER) AS scale, cx, cy, n FROM cell")
def r12_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid(spark, sf_dir)


@query(_POINTS + """, d(a) AS (VALUES (-1), (0), (1)), g AS (SELECT DISTINCT file_id, scale, cx + p.a AS cx, cy + q.a AS cy FROM cell, d p, d q),
e AS (SELECT file_id, scale, g.cx + p.a AS cx, g.cy + q.a AS cy FROM g, d p, d q GROUP BY ALL HAVING count(*) = 9), o AS (SELECT file_id, scale, cell.cx + p.a AS cx, cell.cy + q.a AS cy FROM cell, d p, d q GROUP BY ALL HAVING count(*) = 9),
gn AS (SELECT file_id, scale, count(*) AS dilated FROM g GROUP BY ALL), en AS (SELECT file_id, scale, count(*) AS closed FROM e GROUP BY ALL), ons AS (SELECT file_id, scale, count(*) AS eroded FROM o GROUP BY ALL)
SELECT file_id, CAST(scale AS INTEGER) AS scale, dilated, closed, coalesce(eroded, 0) AS eroded FROM gn JOIN en USING (file_id, scale) LEFT JOIN ons USING (file_id, scale)""")
def r12_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each scale after dilation, after dilation and erosion, and after erosion alone."""
    return occupancy.closing_counts(pyramid(spark, sf_dir).drop("n"), ["file_id", "scale"])


@query()
def r12_seed_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label and scale the component of dilated cells nearest to it, its box, and the share of the box that is occupied (floods in SQL are too slow on whole tables)."""
    return seeded_boxes(spark, sf_dir).withColumn("fill", F.round("fill", 6))


def label_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of all drawings."""
    return drawing(spark, sf_dir, "entities").where("type = 'TEXT'").select("file_id", F.col("entity_id").alias("seed_id"), "text", "x", "y")


def seeded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.boxes_at_seeds(pyramid(spark, sf_dir).drop("n"), label_seeds(spark, sf_dir).select("seed_id", "file_id", "x", "y"), "seed_id", ["file_id"])


@query(_SEG + """, s AS (SELECT *, CAST(greatest(1, floor(greatest(abs(x2 - x1), abs(y2 - y1)) / 4)) AS BIGINT) AS n FROM seg), p AS (SELECT file_id, x1 + (x2 - x1) * i / n AS x, y1 + (y2 - y1) * i / n AS y FROM s, range(0, 8) t(i) WHERE i <= n)
SELECT DISTINCT file_id, CAST(floor(x / 16) AS BIGINT) AS cx, CAST(floor(y / 16) AS BIGINT) AS cy FROM p""")
def r11_r13_sampled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that segments pass, by samples along them."""
    return occupancy.sampled_cells(segments(spark, sf_dir), ["file_id"], 16, 4)


@query()
def r11_component_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and sizes of the 4-connected components of each drawing's sampled cells, smallest first."""
    c = cell_components(r11_r13_sampled_segments(spark, sf_dir), ["file_id"], diagonal=False)
    boxes = c.groupBy("file_id", "component").agg(F.count("*").alias("cells"), F.min("cx").alias("x1"), F.min("cy").alias("y1"), F.max("cx").alias("x2"), F.max("cy").alias("y2"))
    area = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    return boxes.where("cells >= 3").withColumn("area", area).orderBy("file_id", "area", "component")


@query(_SEG + """, r AS (SELECT i AS ray, cos(i * 2 * pi() / 360) AS dx, sin(i * 2 * pi() / 360) AS dy FROM range(360) t(i)), s AS (SELECT file_id, x1 - 5000 AS ax, y1 - 2500 AS ay, x2 - x1 AS ex, y2 - y1 AS ey FROM seg),
d AS (SELECT file_id, ray, (ax * ey - ay * ex) / (dx * ey - dy * ex) AS t, (ax * dy - ay * dx) / (dx * ey - dy * ex) AS u FROM r, s WHERE abs(dx * ey - dy * ex) > 1e-12),
h AS (SELECT file_id, ray, min(t) AS t FROM d WHERE t BETWEEN 0 AND 30000 AND u BETWEEN 0 AND 1 GROUP BY ALL), n AS (SELECT f.file_id, r.ray, coalesce(t, 30000) AS d FROM (SELECT DISTINCT file_id FROM seg) f CROSS JOIN r LEFT JOIN h ON h.file_id = f.file_id AND h.ray = r.ray),
w AS (SELECT a.file_id, a.ray, median(b.d) AS distance FROM n a JOIN n b ON a.file_id = b.file_id AND least(abs(a.ray - b.ray), 360 - abs(a.ray - b.ray)) <= 5 GROUP BY ALL) SELECT file_id, CAST(ray AS INTEGER) AS ray, round(distance, 4) AS distance FROM w""")
def r14_w4_isovist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen from one place in every drawing."""
    s = segments(spark, sf_dir)
    seeds = s.select("file_id").distinct().select(F.col("file_id").alias("seed_id"), "file_id", F.lit(5000.0).alias("x"), F.lit(2500.0).alias("y"))
    return finders.isovists(s, seeds, ["file_id"], 30000.0).select(F.col("seed_id").alias("file_id"), "ray", F.round("distance", 4).alias("distance"))


# ---------------------------------------------------------------- clustering and region finding


@query("""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS s, b.vec_id AS t FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 0.9),
w(n, m) AS (SELECT DISTINCT s, s FROM p UNION SELECT p.t, w.m FROM w JOIN p ON p.s = w.n), c AS (SELECT n, min(m) AS cluster_id FROM w GROUP BY 1) SELECT vec_id, coalesce(cluster_id, -1) AS cluster_id FROM v LEFT JOIN c ON n = vec_id""")
def c1_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(table(spark, sf_dir, "embeddings"), 0.9)


def dbscan(vectors: DataFrame, eps: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster_id) for at least two points in a neighbourhood: components of the pairs within ``eps``; -1 for the rest.

    Fewer than three rows are all cluster 0. Blocks of vectors meet in numpy, so all pairs are looked at where nothing keeps blocks apart.
    """
    if vectors.limit(3).count() < 3:
        return vectors.select(id_col, F.lit(0).cast("long").alias("cluster_id"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    c = graph.connected_components(nearby.near_links(v, eps))
    return v.select("id").join(c, v["id"] == c["node"], "left").select(F.col("id").alias(id_col), F.coalesce("component", F.lit(-1).cast("long")).alias("cluster_id"))


@query()
def c1_hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical density clusters of the vectors on their three main axes."""
    p = nearby.reduced(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hierarchy.density_clusters(p).withColumnRenamed("id", "vec_id")


@query()
def c1_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward's linkage of the vectors on their three main axes."""
    p = nearby.reduced(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hierarchy.ward_clusters(p, 1.0).withColumnRenamed("id", "vec_id")


_BIN = "least(greatest(CAST(trunc((x - lo) / ((hi - lo) / 50)) AS BIGINT), 0), 49)"


@query(_SEG + f""", e AS (SELECT x1 AS x, file_id FROM seg UNION ALL SELECT x2, file_id FROM seg), r AS (SELECT file_id, min(x) AS lo, max(x) AS hi FROM e GROUP BY 1)
SELECT file_id, {_BIN} AS bin, count(*) AS n FROM e JOIN r USING (file_id) GROUP BY ALL""")
def c2_endpoint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    lim = s.groupBy("file_id").agg(F.least(F.min("x1"), F.min("x2")).alias("lo"), F.greatest(F.max("x1"), F.max("x2")).alias("hi"))
    h = kernels.histogram(s.join(F.broadcast(lim), "file_id"), ["x1", "x2"], F.col("lo"), F.col("hi"), 50, ["file_id"])
    return h.select("file_id", F.posexplode("hist").alias("bin", "n")).where("n > 0").select("file_id", F.col("bin").cast("long").alias("bin"), "n")


def drawing_slot(segs: DataFrame, seed: tuple[float, float], bins: int = 400) -> DataFrame:
    """(file_id, min_x, min_y, max_x, max_y): the slot around the seed, of the sweeps y-x-y and x-y-x the larger (the first, if alike)."""
    find = kernels.slot_udf(max(3, bins // 40))
    lim = segs.groupBy("file_id").agg(*(f(g(f"{k}1"), g(f"{k}2")).alias(f"{n}_{k}") for k in "xy" for n, f, g in (("lo", F.least, F.min), ("hi", F.greatest, F.max))))
    base = segs.join(F.broadcast(lim), "file_id")

    def sweep(axes: str) -> DataFrame:
        rows, slots = base, {}
        for i, k in enumerate(axes):
            h = kernels.histogram(rows, [f"{k}1", f"{k}2"], F.col(f"lo_{k}"), F.col(f"hi_{k}"), bins, ["file_id"])
            s = h.select("file_id", find("hist", F.lit(float(seed["xy".index(k)])), "low", "width").alias(f"s{i}"))
            slots[k] = (i, s)
            if i < len(axes) - 1:
                rows = rows.join(F.broadcast(s), "file_id").where((F.greatest(f"{k}1", f"{k}2") >= F.col(f"s{i}.low")) & (F.least(f"{k}1", f"{k}2") <= F.col(f"s{i}.high"))).drop(f"s{i}")
        (i, sx), (j, sy) = slots["x"], slots["y"]
        return sx.join(sy, "file_id").select("file_id", G.box(F.col(f"s{i}.low"), F.col(f"s{j}.low"), F.col(f"s{i}.high"), F.col(f"s{j}.high")).alias(axes))

    both = sweep("yxy").join(sweep("xyx"), "file_id")
    return both.select("file_id", F.when(G.box_area(F.col("xyx")) > G.box_area(F.col("yxy")), F.col("xyx")).otherwise(F.col("yxy")).alias("b")).select("file_id", "b.*")


@query()
def c3_drawing_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing_slot(segments(spark, sf_dir), (5000.0, 2500.0))


@query()
def c4_tight_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot drawn in to the geometry inside it."""
    s = segments(spark, sf_dir)
    slot = drawing_slot(s, (5000.0, 2500.0))
    p = s.select("file_id", F.explode(F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")))).alias("p"))
    inside = p.join(F.broadcast(slot), "file_id").where("p.x between min_x and max_x and p.y between min_y and max_y")
    tight = inside.groupBy("file_id").agg(F.min("p.x").alias("a"), F.min("p.y").alias("b"), F.max("p.x").alias("c"), F.max("p.y").alias("d"))
    return slot.join(tight, "file_id", "left").select("file_id", F.coalesce("a", "min_x").alias("min_x"), F.coalesce("b", "min_y").alias("min_y"), F.coalesce("c", "max_x").alias("max_x"), F.coalesce("d", "max_y").alias("max_y"))


@query(_SEG + """, s AS (SELECT sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len, least(abs(atan2(y2 - y1, x2 - x1)), pi() - abs(atan2(y2 - y1, x2 - x1))) AS a, file_id FROM seg),
b AS (SELECT file_id, least(CAST(floor(a / (pi() / 18)) AS BIGINT), 8) AS bin, sum(len) AS l FROM s GROUP BY ALL), t AS (SELECT file_id, l / sum(l) OVER (PARTITION BY file_id) AS p FROM b),
e AS (SELECT file_id, -sum(p * ln(p)) AS entropy FROM t GROUP BY 1)
SELECT s.file_id, round(sum(CASE WHEN a <= radians(12) OR a >= radians(78) THEN len ELSE 0 END) / sum(len), 6) AS orthogonal, round(median(len), 6) AS median_length, round(any_value(entropy), 6) AS entropy FROM s JOIN e USING (file_id) GROUP BY 1""")
def g26_line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-weighted share of orthogonal lines, median length, entropy of nine angle bins."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    s = segments(spark, sf_dir).select("file_id", F.hypot(x2 - x1, y2 - y1).alias("len"), G.segment_angle(x1, y1, x2, y2).alias("a"))
    bins = s.groupBy("file_id", F.least(F.floor(F.col("a") / (math.pi / 18)), F.lit(8)).alias("bin")).agg(F.sum("len").alias("l"))
    p = bins.withColumn("p", F.col("l") / F.sum("l").over(Window.partitionBy("file_id")))
    entropy = p.groupBy("file_id").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))
    lines = s.groupBy("file_id").agg(F.round(F.sum(F.when(G.is_orthogonal(F.col("a")), F.col("len")).otherwise(0.0)) / F.sum("len"), 6).alias("orthogonal"), F.round(F.median("len"), 6).alias("median_length"))
    return lines.join(entropy, "file_id").withColumn("entropy", F.round("entropy", 6))


def suppressed(boxes: DataFrame, most: float, cell: float) -> DataFrame:
    """Greedy by ``order``, within equal ``file_id``: the ids (region_id) of boxes (column box) whose IoU with all kept before is under ``most``.

    Boxes only bear on each other through pairs that reach ``most``, so each component of these pairs is dealt with by itself.
    """
    b = boxes.select("file_id", "region_id", "order", "box")
    other = b.select("file_id", F.col("region_id").alias("other_id"), F.col("box").alias("other"))
    pairs = box_join(b.select("file_id", "region_id", "box"), other, "box", "other", cell, on=(F.col("region_id") < F.col("other_id")) & (G.iou(F.col("box"), F.col("other")) >= most), keys=("file_id",))
    part = graph.connected_components(pairs.select("region_id", "other_id"), "region_id", "other_id").withColumnRenamed("node", "region_id")
    grouped = b.join(part, "region_id", "left").select("file_id", F.coalesce("component", "region_id").alias("part"), F.struct("order", "region_id", "box.*").alias("b"))
    kept = grouped.groupBy("file_id", "part").agg(F.sort_array(F.collect_list("b")).alias("boxes")).select("file_id", kernels.suppress(F.col("boxes"), most).alias("kept"))
    return kept.select("file_id", F.explode("kept.region_id").alias("region_id"))


@query()
def k10_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file's regions by area, those under IoU 0.3 with all kept before."""
    r = drawing(spark, sf_dir, "regions").withColumn("box", G.ring_box(ring()))
    return suppressed(r.withColumn("order", -F.col("w") * F.col("h")), 0.3, 32.0)


@query()
def u5_merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each layout of a file."""
    layout = (F.col("file_id") * 8 + F.col("layout_id")).alias("layout")
    r = drawing(spark, sf_dir, "regions").select(layout, F.col("region_id").alias("id"), G.grow(G.ring_box(ring()), 25.0).alias("box"))
    return merged_boxes(r, ["layout"], 480.0).select("layout", "box.*")


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions")
    return r.select("file_id", (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))


def first_seeds(spark: SparkSession, sf_dir: str, most: int = 10, keyword: str = "^[a-c]") -> DataFrame:
    """The first labels of each drawing that ``keyword`` finds, in reading order."""
    order = Window.partitionBy("file_id").orderBy(F.bround(F.col("x") / 10000, 0), F.desc("y"), "seed_id")
    return label_seeds(spark, sf_dir).where(F.col("text").rlike(keyword)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


@query()
def q1_region_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels -> slot -> component of its linework -> extent of its geometry -> filter, order and suppression; else a box about the label.

    The first ten labels of a drawing, as a search reports them.
    """
    seeds, s, p, keys = staged(first_seeds(spark, sf_dir), "seeds"), segments(spark, sf_dir), centres(spark, sf_dir), ["file_id"]
    slot = seeds.join(finders.slots(s, seeds, keys), "seed_id")
    inner = finders.refined(s, slot, keys, 60.0, least_cells=3, least_side=240.0)
    found = finders.counted(finders.tightened(inner, p, keys, 500.0), p, keys, 500.0)
    good = finders.sound(found, 100, 0.25, 5.0, relax=False)
    best = finders.kept_best(good.select("seed_id", *finders.EDGES, "n", "area"), [F.desc("n"), F.desc("area")], 0.95, 5)
    around = {c: F.col(c[-1]) + (-1000.0 if c.startswith("min") else 1000.0) for c in finders.EDGES}
    out = seeds.join(best, "seed_id", "left")
    return out.select("seed_id", "file_id", "text", F.coalesce("rank", F.lit(1)).alias("rank"), F.col("rank").isNotNull().alias("found"), *(F.round(F.coalesce(F.col(c), around[c]), 4).alias(c) for c in finders.EDGES))


@query()
def q5_isovist_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels -> what is seen from them -> three boxes of growing size -> those with enough geometry and a sound shape; their union and mean."""
    seeds, s, keys = staged(first_seeds(spark, sf_dir), "seeds"), segments(spark, sf_dir), ["file_id"]
    boxes = finders.isovist_boxes(finders.isovists(s, seeds, keys, 3000.0), seeds, 3000.0, 100.0)
    good = finders.sound(finders.counted(boxes, centres(spark, sf_dir), keys, 500.0), 20, 0.35, 5.0, relax=False)
    ends = [f(c).alias(f"{n}{c}") for n, fs in (("union_", (F.min, F.min, F.max, F.max)), ("mean_", (F.avg,) * 4)) for f, c in zip(fs, finders.EDGES, strict=True)]
    told = good.groupBy("seed_id").agg(F.count("*").alias("boxes"), *ends)
    named = seeds.join(told, "seed_id", "left")
    return named.select("seed_id", "file_id", "text", F.coalesce("boxes", F.lit(0).cast("long")).alias("boxes"), *(F.round(f"{n}{c}", 4).alias(f"{n}{c}") for n in ("union_", "mean_") for c in finders.EDGES))


@query(drawing_sql("edges").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w(node, m) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, w.m FROM w JOIN e ON e.src = w.node),
c AS (SELECT node, min(m) AS component FROM w GROUP BY 1), n AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY node) - 1 AS pos, (SELECT count(*) FROM e WHERE src = node) AS degree FROM c)
SELECT a.component, string_agg(a.pos, ',' ORDER BY a.pos, b.pos) AS sources, string_agg(b.pos, ',' ORDER BY a.pos, b.pos) AS targets, (SELECT string_agg(degree, ',' ORDER BY pos) FROM n WHERE n.component = a.component) AS features
FROM e JOIN n a ON a.node = e.src JOIN n b ON b.node = e.dst GROUP BY a.component""")
def r6_edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component as a graph sample: its edges both ways as two arrays of places, and a feature for each place (here the degree)."""
    e = drawing(spark, sf_dir, "edges")
    both = e.union(e.select("dst", "src"))
    place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    nodes = staged(graph.connected_components(e).withColumn("at", place).join(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "node"), "nodes")
    end = lambda c, n: nodes.select(F.col("node").alias(c), F.col("at").alias(n))
    index = both.join(nodes.select(F.col("node").alias("src"), "component", F.col("at").alias("a")), "src").join(end("dst", "b"), "dst")
    arrays = index.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("e"))
    features = nodes.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "degree"))).alias("f"))
    return arrays.join(features, "component").select("component", F.array_join("e.a", ",").alias("sources"), F.array_join("e.b", ",").alias("targets"), F.array_join("f.degree", ",").alias("features"))


@query(drawing_sql("regions") + " SELECT DISTINCT layout_id, chunk_id FROM regions ORDER BY 1, 2")
def q19_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "regions").select("layout_id", "chunk_id").distinct().orderBy("layout_id", "chunk_id")


@query(drawing_sql("regions") + " SELECT file_id * 10000 + layout_id AS global_layout_id, string_agg(region_id, ',' ORDER BY region_id) AS samples FROM regions GROUP BY 1")
def q17_q18_grouped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions")
    return r.groupBy((F.col("file_id") * 10000 + F.col("layout_id")).alias("global_layout_id")).agg(F.array_join(F.sort_array(F.collect_list("region_id")), ",").alias("samples"))


@query(drawing_sql("regions") + ", k AS (SELECT layer AS id FROM regions UNION SELECT CAST(layout_id AS VARCHAR) FROM regions) SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS DOUBLE) NULLS LAST, id) AS k FROM k")
def q20_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by value, then the rest by name."""
    r = drawing(spark, sf_dir, "regions")
    ids = r.select(F.col("layer").alias("id")).union(r.select(F.col("layout_id").cast("string"))).distinct()
    return ids.select("id", F.row_number().over(Window.orderBy(F.expr("try_cast(id as double)").asc_nulls_last(), "id")).cast("long").alias("k"))


@query(drawing_sql("entities") + " SELECT file_id, min(x) - 0.05 * (max(x) - min(x)) AS min_x, max(x) + 0.05 * (max(x) - min(x)) AS max_x FROM entities WHERE type = 'TEXT' GROUP BY 1")
def q14_text_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drawing(spark, sf_dir, "entities").where("type = 'TEXT'").groupBy("file_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    pad = 0.05 * (F.col("b") - F.col("a"))
    return e.select("file_id", (F.col("a") - pad).alias("min_x"), (F.col("b") + pad).alias("max_x"))


@query(_SHAPES + _SPARSE + " SELECT k, type, round(p[1], 6) AS x, round(p[2], 6) AS y FROM l WHERE type IN ('SOLID', 'HATCH') OR (type IN ('LWPOLYLINE', 'POLYLINE') AND k % 2 = 0)")
def q8_structural_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of solids, hatches and closed polylines."""
    e = shapes_of_parts(spark, sf_dir).where("e.type in ('SOLID', 'HATCH') or (e.type in ('LWPOLYLINE', 'POLYLINE') and e.closed)")
    return e.select("k", "e.type", F.explode(entities.points(F.col("e"))).alias("p")).select("k", "type", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(drawing_sql("regions") + ", g AS (SELECT layout_id, chunk_id, min(x0) AS a, min(y0) AS b, max(x0 + w) AS c, max(y0 + h) AS d FROM regions WHERE layout_id IN (1, 2) GROUP BY ALL) SELECT layout_id, chunk_id, greatest(a - 20, 0) AS min_x, greatest(b - 20, 0) AS min_y, least(c + 20, 9000) AS max_x, least(d + 20, 4000) AS max_y FROM g")
def q15_chunk_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = drawing(spark, sf_dir, "regions").where(F.col("layout_id").isin(1, 2)).withColumn("b", G.ring_box(ring()))
    u = b.groupBy("layout_id", "chunk_id").agg(F.struct(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y")).alias("u"))
    return u.select("layout_id", "chunk_id", G.clamp(G.grow(F.col("u"), 20.0), 9000.0, 4000.0).alias("c")).select("layout_id", "chunk_id", "c.*")


@query(drawing_sql("memory") + """, w AS (SELECT file_path AS owner, query_keyword AS key, id, CASE WHEN id % 11 = 0 THEN NULL ELSE min_x END AS value FROM memory),
k AS (SELECT owner, key, arg_max(id, id) AS id, max(id) AS last, count(*) AS writes FROM w GROUP BY ALL) SELECT k.owner, k.key, w.id, w.value, k.writes FROM k JOIN w ON w.owner = k.owner AND w.key = k.key AND w.id = k.last WHERE w.value IS NOT NULL""")
def q21_scratchpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's keys with the value that was written last; a null value takes a key away."""
    writes = drawing(spark, sf_dir, "memory").select(F.col("file_path").alias("owner"), F.col("query_keyword").alias("key"), "id", F.when(F.col("id") % 11 != 0, F.col("min_x")).alias("value"))
    last = writes.groupBy("owner", "key").agg(F.max(F.struct("id", "value")).alias("m"), F.count("*").alias("writes"))
    return last.where("m.value is not null").select("owner", "key", "m.id", "m.value", "writes")
