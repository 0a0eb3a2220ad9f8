"""Filters, joins, set operations, windows and top-k over drawing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.functions import vectors as V
from planwright.operators.spatial import box_join, box_semi_join, nearest_points, points_in_boxes
from planwright.plans.layouts import ring, with_boxes
from planwright.plans.registry import query
from planwright.sources.drawings import drawing, drawing_sql
from planwright.sources.tables import table

# ---------------------------------------------------------------- filters


@query(drawing_sql("regions") + " SELECT region_id, CAST(trunc((x0 - 3000.3) * 0.5) AS BIGINT) AS px, CAST(trunc((100 - y0) * 0.5) AS BIGINT) AS py FROM regions")
def f1_world_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions below zero are cut off toward zero too."""
    p = G.to_pixels(F.array(G.point(F.col("x0"), F.col("y0"))), 3000.3, 100.0, 0.5)[0]
    return drawing(spark, sf_dir, "regions").select("region_id", p["x"].cast("long").alias("px"), p["y"].cast("long").alias("py"))


def in_lists(rows: DataFrame, **wanted: list | None) -> DataFrame:
    """Keep rows whose columns are in the lists; None is no filter."""
    for c, values in wanted.items():
        if values is not None:
            rows = rows.where(F.col(c).isin(values))
    return rows


@query(drawing_sql("regions") + " SELECT region_id FROM regions WHERE layout_id IN (1, 3, 5)")
def f2_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_lists(drawing(spark, sf_dir, "regions"), layout_id=[1, 3, 5], chunk_id=None).select("region_id")


@query(drawing_sql("regions") + " SELECT region_id FROM regions WHERE layout_id = 2 AND chunk_id IN (0, 7)")
def f3_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a user interface filters: an empty selection is all."""
    picked: dict[str, list] = {"layout_id": [2], "chunk_id": [0, 7], "file_id": []}
    return in_lists(drawing(spark, sf_dir, "regions"), **{k: v or None for k, v in picked.items()}).select("region_id")


@query(drawing_sql("regions") + " SELECT region_id FROM regions WHERE layout_id = 4")
def f4_loose_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id given as text or number is brought to one type first."""
    return drawing(spark, sf_dir, "regions").where(F.col("layout_id") == F.lit("4").cast("long")).select("region_id")


_QBOX = (2000.0, 1000.0, 2600.0, 1500.0)


@query(drawing_sql("regions") + " SELECT region_id FROM regions WHERE x0 <= 2600 AND x0 + w >= 2000 AND y0 <= 1500 AND y0 + h >= 1000")
def f5_box_meets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "regions").where(G.boxes_meet(G.ring_box(ring()), G.box(*_QBOX))).select("region_id")


@query(drawing_sql("regions") + " SELECT region_id FROM regions WHERE x0 >= 2000 AND x0 + w <= 2600 AND y0 >= 1000 AND y0 + h <= 1500")
def f7_box_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "regions").where(G.box_contains(G.box(*_QBOX), G.ring_box(ring()))).select("region_id")


@query(drawing_sql("regions") + " SELECT region_id FROM regions WHERE 2300 BETWEEN x0 - 40 AND x0 + w + 40 AND 1200 BETWEEN y0 - 40 AND y0 + h + 40")
def f8_box_has_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "regions").where(G.box_has_point(G.ring_box(ring()), 2300.0, 1200.0, 40.0)).select("region_id")


@query(drawing_sql("entities") + " SELECT entity_id FROM entities WHERE type NOT IN ('HATCH', 'SOLID', 'SPLINE', 'POINT', 'INSERT') AND NOT (type = 'TEXT' AND trim(text) = '')")
def f9_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drawing(spark, sf_dir, "entities").where(~F.col("type").isin("HATCH", "SOLID", "SPLINE", "POINT", "INSERT"))
    return e.where((F.col("type") != "TEXT") | (F.trim("text") != "")).select("entity_id")


@query(drawing_sql("regions") + " SELECT region_id FROM regions WHERE NOT (greatest(x0 * 8 + w, x0) - x0 > 100000 OR h > 100000)")
def f10_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that span over 100000 on an axis go (the far corner is pushed out here to have some)."""
    b = G.ring_box(F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x0") * 8 + F.col("w"), F.col("y0") + F.col("h"))))
    return drawing(spark, sf_dir, "regions").where((b["max_x"] - b["min_x"] <= 100000) & (b["max_y"] - b["min_y"] <= 100000)).select("region_id")


def counted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate boxes (regions, grown by 60) with the number of entities inside."""
    boxes = drawing(spark, sf_dir, "regions").select("region_id", G.grow(G.ring_box(ring()), 60.0).alias("box"))
    hits = points_in_boxes(drawing(spark, sf_dir, "entities").select("x", "y"), boxes, "x", "y", "box", 150.0).groupBy("region_id").agg(F.count("*").alias("n"))
    return boxes.join(hits, "region_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


_COUNTED = drawing_sql("regions", "entities") + """, c AS (SELECT region_id, x0 - 60 AS a, y0 - 60 AS b, x0 + w + 60 AS c, y0 + h + 60 AS d FROM regions),
n AS (SELECT region_id, any_value(c.c - c.a) AS bw, any_value(c.d - c.b) AS bh, count(e.entity_id) AS n FROM c LEFT JOIN entities e ON e.x BETWEEN c.a AND c.c AND e.y BETWEEN c.b AND c.d GROUP BY region_id)"""


@query(_COUNTED + " SELECT region_id, n FROM n WHERE n >= 2 AND bw / bh BETWEEN 0.95 AND 1.05")
def f11_candidate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = counted_boxes(spark, sf_dir)
    aspect = (F.col("box.max_x") - F.col("box.min_x")) / (F.col("box.max_y") - F.col("box.min_y"))
    return b.where((F.col("n") >= 2) & aspect.between(0.95, 1.05)).select("region_id", "n")


@query(_COUNTED + """, t AS (SELECT region_id, n, n / (bw * bh) AS density, CASE WHEN n >= 4 AND bw / bh BETWEEN 0.95 AND 1.05 THEN 1 WHEN n >= 2 AND bw / bh BETWEEN 0.9 AND 1.1 THEN 2 ELSE 3 END AS tier FROM n)
SELECT region_id, n, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def f12_relaxation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest filter that leaves anything."""
    b, w, h = counted_boxes(spark, sf_dir), F.col("box.max_x") - F.col("box.min_x"), F.col("box.max_y") - F.col("box.min_y")
    tier = F.when((F.col("n") >= 4) & (w / h).between(0.95, 1.05), 1).when((F.col("n") >= 2) & (w / h).between(0.9, 1.1), 2).otherwise(3)
    t = b.withColumn("tier", tier)
    return t.join(F.broadcast(t.agg(F.min("tier").alias("tier"))), "tier").select("region_id", "n", "tier")


@query(drawing_sql("regions") + " SELECT region_id, h > 2 AND w > 2 AS valid FROM regions")
def f13_valid_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x0"), F.col("y0")
    return drawing(spark, sf_dir, "regions").select("region_id", G.box_valid(G.box(x + 2, y + 2, x + F.col("w"), y + F.col("h"))).alias("valid"))


@query(drawing_sql("regions") + """, l AS (SELECT file_id, layout_id, (max(x0 + w) - min(x0)) * (max(y0 + h) - min(y0)) AS whole FROM regions GROUP BY ALL)
SELECT region_id, round(w * h / whole, 9) AS ratio FROM regions JOIN l USING (file_id, layout_id) WHERE w * h / whole < 0.85 AND w * h >= 25""")
def f15_f16_coverage_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are most of their layout or tiny are skipped."""
    b = with_boxes(drawing(spark, sf_dir, "regions"))
    whole = b.groupBy("file_id", "layout_id").agg(((F.max("dxf.max_x") - F.min("dxf.min_x")) * (F.max("dxf.max_y") - F.min("dxf.min_y"))).alias("whole"))
    return b.join(whole, ["file_id", "layout_id"]).where("area / whole < 0.85 and area >= 25").select("region_id", F.round(F.col("area") / F.col("whole"), 9).alias("ratio"))


@query(drawing_sql("annotations") + " SELECT id, list_extract(string_split(layer || '$0$' || layer, '$0$'), -1) AS layer, round_even(x / 7, 2) AS x FROM annotations")
def f17_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes up to ``$0$`` go, keys are renamed, coordinates rounded half to even."""
    a = drawing(spark, sf_dir, "annotations").withColumn("layer", F.concat("layer", F.lit("$0$"), "layer"))
    return a.select("id", F.element_at(F.split("layer", r"\$0\$"), -1).alias("layer"), F.bround(F.col("x") / 7, 2).alias("x"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS s FROM embeddings v, q),
t AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 20) SELECT vec_id, label FROM t WHERE label IN (1, 4)""")
def f19_filter_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope is applied to what was retrieved, so fewer than k may be left."""
    return scored(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(20).where(F.col("label").isin(1, 4)).select("vec_id", "label")


# ---------------------------------------------------------------- joins


@query(drawing_sql("regions") + """, k AS (SELECT CAST(label AS VARCHAR) AS l, CAST(vec_id % 16 AS VARCHAR) AS c, min(vec_id) AS vec_id FROM embeddings GROUP BY ALL)
SELECT region_id, vec_id FROM regions LEFT JOIN k ON CAST(layout_id AS VARCHAR) = l AND CAST(chunk_id AS VARCHAR) = c""")
def j1_regions_left_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("layout_id"), (F.col("vec_id") % 16).cast("string").alias("chunk_id")).agg(F.min("vec_id").alias("vec_id"))
    r = drawing(spark, sf_dir, "regions").select("region_id", F.col("layout_id").cast("string").alias("layout_id"), F.col("chunk_id").cast("string").alias("chunk_id"))
    return r.join(k, ["layout_id", "chunk_id"], "left").select("region_id", "vec_id")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of all old rows of their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


@query(drawing_sql("regions") + " SELECT region_id, layer FROM regions WHERE file_id <> 2 UNION ALL SELECT region_id, 'new' FROM regions WHERE file_id = 2 AND layout_id < 3")
def j2_replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions").select("file_id", "region_id", "layout_id", "layer")
    new = r.where("file_id = 2 and layout_id < 3").withColumn("layer", F.lit("new"))
    return replace_by_key(r, new, "file_id").select("region_id", "layer")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer")
def j3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return replace_by_key(c, c.where("c_custkey % 3 = 0").withColumn("segment", F.lit("changed")), "c_custkey")


@query("SELECT vec_id FROM embeddings WHERE label <> 3")
def j4_delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label <> 3").select("vec_id")


@query(drawing_sql("regions") + ", m AS (SELECT layout_id, min(layout_id) * 10 AS cluster_id FROM regions WHERE layout_id % 2 = 0 GROUP BY 1) SELECT region_id, coalesce(cluster_id, -1) AS cluster_id FROM regions LEFT JOIN m USING (layout_id)")
def j5_lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions")
    m = r.where("layout_id % 2 = 0").select("layout_id", (F.col("layout_id") * 10).alias("cluster_id")).distinct()
    return r.join(m, "layout_id", "left").select("region_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query(drawing_sql("regions", "entities") + """, roi AS (SELECT region_id, x0 - 20 AS a, y0 - 20 AS b, x0 + w + 20 AS c, y0 + h + 20 AS d FROM regions)
SELECT entity_id, count(*) AS n FROM entities JOIN roi ON x > a AND x < c AND y > b AND y < d GROUP BY 1""")
def j6_entities_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by box on a grid, then the exact test of the polygon."""
    roi = drawing(spark, sf_dir, "regions").select("region_id", G.rectangle(F.col("x0") - 20, F.col("y0") - 20, F.col("w") + 40, F.col("h") + 40).alias("ring"))
    pairs = points_in_boxes(drawing(spark, sf_dir, "entities").select("entity_id", "x", "y"), roi.withColumn("box", G.ring_box(F.col("ring"))), "x", "y", "box", 100.0)
    inside = G.has_point(F.col("ring"), F.col("x"), F.col("y")) & (F.col("x") > F.col("box.min_x")) & (F.col("y") > F.col("box.min_y"))
    return pairs.where(inside).groupBy("entity_id").agg(F.count("*").alias("n"))


@query(drawing_sql("regions") + """, a AS (SELECT * FROM regions WHERE layer <> '1-URGENT'), b AS (SELECT * FROM regions WHERE layer = '1-URGENT')
SELECT a.region_id AS left_id, b.region_id AS right_id FROM a JOIN b ON a.x0 <= b.x0 + b.w AND a.x0 + a.w >= b.x0 AND a.y0 <= b.y0 + b.h AND a.y0 + a.h >= b.y0""")
def j7_box_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions").withColumn("box", G.ring_box(ring()))
    a, b = r.where("layer <> '1-URGENT'").select(F.col("region_id").alias("left_id"), F.col("box").alias("l")), r.where("layer = '1-URGENT'").select(F.col("region_id").alias("right_id"), F.col("box").alias("r"))
    return box_join(a, b, "l", "r", 32.0).select("left_id", "right_id")


@query(_COUNTED + " SELECT region_id, n FROM n")
def j8_geometry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_boxes(spark, sf_dir).select("region_id", "n")


_GAP = "greatest(a.x0 - b.x0 - b.w, b.x0 - a.x0 - a.w, 0)"


@query(drawing_sql("regions") + """ SELECT a.region_id AS src, b.region_id AS dst, CASE WHEN a.layer = b.layer THEN 10 ELSE 1 END AS weight FROM regions a JOIN regions b ON a.file_id = b.file_id AND a.region_id < b.region_id
AND sqrt(pow(greatest(a.x0 - b.x0 - b.w, b.x0 - a.x0 - a.w, 0), 2) + pow(greatest(a.y0 - b.y0 - b.h, b.y0 - a.y0 - a.h, 0), 2)) <= 10""")
def j9_region_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_graph(drawing(spark, sf_dir, "regions"))


def region_graph(regions: DataFrame, distance: float = 10.0) -> DataFrame:
    """Edges between regions of a file at most ``distance`` apart; weight 10 within a layer, else 1."""
    r = regions.withColumn("box", G.ring_box(ring()))
    a = r.select("file_id", F.col("region_id").alias("src"), F.col("layer").alias("src_layer"), F.col("box").alias("l"))
    b = r.select("file_id", F.col("region_id").alias("dst"), F.col("layer").alias("dst_layer"), F.col("box").alias("r"))
    gap = [F.greatest(F.col(f"l.min_{k}") - F.col(f"r.max_{k}"), F.col(f"r.min_{k}") - F.col(f"l.max_{k}"), F.lit(0.0)) for k in "xy"]
    near = (F.col("src") < F.col("dst")) & (F.sqrt(gap[0] ** 2 + gap[1] ** 2) <= distance)
    # cells about as wide as the reach: smaller ones would take many copies of each region
    return box_join(a, b, "l", "r", max(48.0, 2 * distance), near, distance, ("file_id",)).select("src", "dst", F.when(F.col("src_layer") == F.col("dst_layer"), 10).otherwise(1).alias("weight"))


@query(drawing_sql("regions") + """ SELECT a.layer, count(*) AS pairs FROM regions a JOIN regions b ON a.file_id = b.file_id AND a.layer = b.layer AND a.region_id < b.region_id
AND sqrt(pow(greatest(a.x0 - b.x0 - b.w, b.x0 - a.x0 - a.w, 0), 2) + pow(greatest(a.y0 - b.y0 - b.h, b.y0 - a.y0 - a.h, 0), 2)) < 0.2 GROUP BY 1""")
def j10_mergeable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions").withColumn("box", G.ring_box(ring()))
    a, b = r.select("file_id", "layer", F.col("region_id").alias("src"), F.col("box").alias("l")), r.select("file_id", "layer", F.col("region_id").alias("dst"), F.col("box").alias("r"))
    gap = [F.greatest(F.col(f"l.min_{k}") - F.col(f"r.max_{k}"), F.col(f"r.min_{k}") - F.col(f"l.max_{k}"), F.lit(0.0)) for k in "xy"]
    near = (F.col("src") < F.col("dst")) & (F.sqrt(gap[0] ** 2 + gap[1] ** 2) < 0.2)
    return box_join(a, b, "l", "r", 32.0, near, 0.2, ("file_id", "layer")).groupBy("layer").agg(F.count("*").alias("pairs"))


@query(drawing_sql("regions", "entities") + """, t AS (SELECT * FROM entities WHERE type = 'TEXT')
SELECT region_id, coalesce(string_agg(DISTINCT t.layer, ',' ORDER BY t.layer), 'UNKNOWN') AS labels FROM regions r LEFT JOIN t ON t.x BETWEEN r.x0 - 0.5 AND r.x0 + r.w + 0.5 AND t.y BETWEEN r.y0 - 0.5 AND r.y0 + r.h + 0.5 GROUP BY 1""")
def j12_labels_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label points in regions grown by 0.5; none: UNKNOWN."""
    r = drawing(spark, sf_dir, "regions").select("region_id", G.ring_box(ring()).alias("box"))
    t = drawing(spark, sf_dir, "entities").where("type = 'TEXT'").select("layer", "x", "y")
    found = points_in_boxes(t, r, "x", "y", "box", 32.0, 0.5).groupBy("region_id").agg(F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("labels"))
    return r.select("region_id").join(found, "region_id", "left").select("region_id", F.coalesce("labels", F.lit("UNKNOWN")).alias("labels"))


@query(drawing_sql("regions") + """, v AS (SELECT layout_id, layer, count(*) AS n FROM regions GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY layout_id ORDER BY n DESC, layer) AS k FROM v)
SELECT layout_id, layer, n FROM k WHERE k = 1""")
def j13_majority_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties go to the first layer by name."""
    v = drawing(spark, sf_dir, "regions").groupBy("layout_id", "layer").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("layer"), F.col("n")))
    return v.groupBy("layout_id").agg(best.alias("b")).select("layout_id", "b.layer", "b.n")


@query(drawing_sql("regions") + """ SELECT a.region_id FROM regions a WHERE a.layer <> '1-URGENT' AND EXISTS (SELECT 1 FROM regions b WHERE b.layer = '1-URGENT' AND a.x0 <= b.x0 + b.w AND a.x0 + a.w >= b.x0 AND a.y0 <= b.y0 + b.h AND a.y0 + a.h >= b.y0)""")
def j17_overlapping_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions").withColumn("box", G.ring_box(ring()))
    return box_semi_join(r.where("layer <> '1-URGENT'").select("region_id", "box"), r.where("layer = '1-URGENT'").select(F.col("box").alias("parent")), "region_id", "box", "parent", 32.0).select("region_id")


@query(drawing_sql("regions") + """, p AS (SELECT a.region_id, b.region_id AS parent_id, b.layer, row_number() OVER (PARTITION BY a.region_id ORDER BY b.region_id) AS k FROM regions a JOIN regions b ON NOT contains(a.layer, 'H') AND contains(b.layer, 'H')
AND a.x0 <= b.x0 + b.w AND a.x0 + a.w >= b.x0 AND a.y0 <= b.y0 + b.h AND a.y0 + a.h >= b.y0) SELECT region_id, parent_id, layer FROM p WHERE k = 1""")
def j18_first_parent_with_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions").withColumn("box", G.ring_box(ring()))
    parents = r.where(F.contains("layer", F.lit("H"))).select(F.col("region_id").alias("parent_id"), "layer", F.col("box").alias("p"))
    return box_join(r.where(~F.contains("layer", F.lit("H"))).select("region_id", "box"), parents, "box", "p", 32.0).groupBy("region_id").agg(F.min(F.struct("parent_id", "layer")).alias("f")).select("region_id", "f.*")


@query(drawing_sql("entities") + """, a AS (SELECT file_id, entity_id AS anchor, x AS ax, y AS ay FROM entities WHERE type = 'TEXT'),
d AS (SELECT entity_id, anchor, row_number() OVER (PARTITION BY entity_id ORDER BY (x - ax) * (x - ax) + (y - ay) * (y - ay), anchor) AS k FROM entities LEFT JOIN a USING (file_id))
SELECT entity_id, anchor FROM d WHERE k = 1""")
def j19_nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the texts of the same drawing."""
    e = drawing(spark, sf_dir, "entities").select("file_id", "entity_id", "type", "x", "y")
    return nearest_points(e.drop("type"), e.where("type = 'TEXT'").select("file_id", F.col("entity_id").alias("anchor"), "x", "y"), "entity_id", "anchor", 64.0, keys=("file_id",)).select("entity_id", "anchor")


@query(drawing_sql("entities") + """, k AS (SELECT sqrt(pow(x - 2000, 2) + pow(y - 2000, 2)) AS d FROM entities ORDER BY d LIMIT 25), p AS (SELECT d FROM k WHERE d > 0 ORDER BY d LIMIT 15) SELECT round(median(d), 6) AS scale FROM p""")
def j20_local_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the 15 least positive distances among the 25 nearest."""
    d = F.sqrt((F.col("x") - 2000) ** 2 + (F.col("y") - 2000) ** 2).alias("d")
    return drawing(spark, sf_dir, "entities").select(d).orderBy("d").limit(25).where("d > 0").orderBy("d").limit(15).agg(F.round(F.median("d"), 6).alias("scale"))


@query(drawing_sql("edges") + ", b AS (SELECT src AS n, dst AS m FROM edges UNION ALL SELECT dst, src FROM edges), a AS (SELECT n, list(m) AS neighbours FROM b GROUP BY 1), u AS (SELECT n, unnest(neighbours) AS m FROM a) SELECT n AS node, m AS neighbour FROM u WHERE m > n")
def j21_adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency lists back to edges; each edge once."""
    e = drawing(spark, sf_dir, "edges")
    lists = e.union(e.select("dst", "src")).groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("neighbours"))
    return lists.select("node", F.explode("neighbours").alias("neighbour")).where("neighbour > node")


@query(drawing_sql("regions", "defects") + " SELECT region_id FROM regions WHERE layout_id || ':' || chunk_id IN (SELECT layout_id || ':' || chunk_id FROM defects WHERE severity = 'High' AND id % 500 = 0)")
def j22_masks_with_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawing(spark, sf_dir, "defects").where("severity = 'High' and id % 500 = 0").select("layout_id", "chunk_id")
    return drawing(spark, sf_dir, "regions").join(d, ["layout_id", "chunk_id"], "left_semi").select("region_id")


@query(drawing_sql("regions") + " SELECT DISTINCT a.layout_id, b.chunk_id FROM (SELECT DISTINCT layout_id FROM regions) a, (SELECT DISTINCT chunk_id FROM regions) b")
def j23_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts times chunks: every pair is a work item, so the product is the result."""
    r = drawing(spark, sf_dir, "regions")
    return r.select("layout_id").distinct().crossJoin(r.select("chunk_id").distinct())


@query("WITH i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings), w(i) AS (VALUES (0), (7), (99), (99999999)) SELECT w.i AS i, vec_id FROM w JOIN i ON w.i = i.i")
def j24_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by position; positions out of range give none."""
    from planwright.operators.ordering import with_row_number

    rows = with_row_number(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], "i")
    return rows.where(F.col("i").isin(0, 7, 99, 99999999)).select(F.col("i").cast("int").alias("i"), "vec_id")


@query("SELECT c_mktsegment AS source, CASE count(DISTINCT c_nationkey) WHEN 0 THEN '404' WHEN 1 THEN 'ok' ELSE '409' END AS status FROM customer GROUP BY 1")
def j25_resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct("c_nationkey")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg(F.when(n == 0, "404").when(n == 1, "ok").otherwise("409").alias("status"))


# ---------------------------------------------------------------- sets and dedup


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def u1_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query(drawing_sql("regions") + " SELECT DISTINCT layout_id, layer FROM regions")
def u2_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "regions").select("layout_id", "layer").dropDuplicates()


@query(drawing_sql("annotations") + ", k AS (SELECT id, layer, row_number() OVER (PARTITION BY layer, substr(text, 1, 3), floor(round(x / 900, 3)) ORDER BY id) AS k FROM annotations) SELECT id, layer FROM k WHERE k = 1")
def u3_first_of_each_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first by scan order of each (file, text, rounded place)."""
    a = drawing(spark, sf_dir, "annotations")
    return a.groupBy("layer", F.substring("text", 1, 3).alias("t"), F.floor(F.round(F.col("x") / 900, 3)).alias("p")).agg(F.min("id").alias("id")).select("id", "layer")


@query(drawing_sql("entities") + " SELECT DISTINCT round(x / 3, 3) AS x, round(y / 1000, 0) AS y FROM entities")
def u4_rounded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "entities").select(F.round(F.col("x") / 3, 3).alias("x"), F.round(F.col("y") / 1000, 0).alias("y")).distinct()


@query(drawing_sql("memory") + ", k AS (SELECT *, row_number() OVER (PARTITION BY file_path, query_keyword ORDER BY created_at DESC, id DESC) AS k FROM memory) SELECT file_path, query_keyword, id FROM k WHERE k = 1")
def u7_merge_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, current and active references as one map: the last writer of a key wins."""
    m = drawing(spark, sf_dir, "memory")
    return m.groupBy("file_path", "query_keyword").agg(F.max(F.struct("created_at", "id")).alias("l")).select("file_path", "query_keyword", "l.id")


# ---------------------------------------------------------------- windows


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its inner product with that of vec_id 0."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return v.crossJoin(F.broadcast(q)).select("vec_id", "label", V.dot(F.col("embedding"), F.col("q")).alias("score"))


_SCORED = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS s FROM embeddings v, q)"""


def nucleus(top: DataFrame, top_p: float) -> DataFrame:
    """Of retrieved rows (few) those whose cumulated softmax stays within ``top_p``; at least the first. Ties: the later row first."""
    w = Window.orderBy(F.desc("p"), F.desc("vec_id")).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.exp(F.col("score") - F.max("score").over(Window.partitionBy()))
    p = top.withColumn("_e", weight).withColumn("p", F.col("_e") / F.sum("_e").over(Window.partitionBy()))
    c = p.withColumns({"c": F.sum("p").over(w), "k": F.row_number().over(w)})
    return c.where((F.col("c") <= top_p) | (F.col("k") == 1)).drop("_e", "p", "c", "k")


@query(_SCORED + """, t AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 40), p AS (SELECT vec_id, exp(s - max(s) OVER ()) / sum(exp(s - (SELECT max(s) FROM t))) OVER () AS p FROM t),
c AS (SELECT vec_id, sum(p) OVER w AS c, row_number() OVER w AS k FROM p WINDOW w AS (ORDER BY p DESC, vec_id DESC ROWS UNBOUNDED PRECEDING)) SELECT vec_id FROM c WHERE c <= 0.61 OR k = 1""")
def w1_nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus(scored(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(40), 0.61).select("vec_id")


@query(drawing_sql("regions") + """, k AS (SELECT region_id, layout_id, row_number() OVER (PARTITION BY layout_id ORDER BY region_id) - 1 AS i, count(*) OVER (PARTITION BY layout_id) AS n FROM regions)
SELECT layout_id, region_id FROM k WHERE i IN (0, (n - 1) // 4, (n - 1) // 2, 3 * (n - 1) // 4, n - 1)""")
def w5_quantile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at quartile positions of each layout."""
    by = Window.partitionBy("layout_id")
    k = drawing(spark, sf_dir, "regions").withColumns({"i": F.row_number().over(by.orderBy("region_id")) - 1, "n": F.count("*").over(by)})
    at = [F.expr(f"{q} * (n - 1) div 4") for q in range(5)]
    return k.where(F.array_contains(F.array(*at), F.col("i").cast("long"))).select("layout_id", "region_id")


@query(drawing_sql("defects") + " SELECT id, layout_id, row_number() OVER (PARTITION BY layout_id ORDER BY id) AS seq FROM defects WHERE severity = 'High'")
def w6_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "defects").where("severity = 'High'").select("id", "layout_id", F.row_number().over(Window.partitionBy("layout_id").orderBy("id")).cast("long").alias("seq"))


@query(drawing_sql("regions") + ", l AS (SELECT file_id, layout_id, count(*) AS n FROM regions GROUP BY ALL) SELECT file_id, layout_id, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, layout_id) - 1 AS dense_id FROM l")
def w7_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts by size; ties by id."""
    n = drawing(spark, sf_dir, "regions").groupBy("file_id", "layout_id").agg(F.count("*").alias("n"))
    return n.select("file_id", "layout_id", (F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "layout_id")) - 1).cast("long").alias("dense_id"))


@query(drawing_sql("entities") + ", k AS (SELECT text, max(entity_id) AS entity_id FROM entities GROUP BY 1) SELECT * FROM k")
def w8_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "entities").groupBy("text").agg(F.max("entity_id").alias("entity_id"))


@query("""WITH k AS (SELECT conv_id, turn, role || ': ' || substr(text, 1, 500) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations)
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn, k DESC) AS history FROM k WHERE k <= 6 GROUP BY 1""")
def w10_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six turns of a conversation, 500 characters of each."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    c = table(spark, sf_dir, "conversations").withColumn("k", k).where("k <= 6")
    said = F.struct("turn", (-F.col("k")).alias("k"), F.concat("role", F.lit(": "), F.left("text", F.lit(500))).alias("t"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["t"]), "\n").alias("history"))


# ---------------------------------------------------------------- sort and top-k


@query(_SCORED + " SELECT vec_id, label, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 10")
def k1_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(10).withColumn("score", F.round("score", 6))


@query(_SCORED + ", t AS (SELECT vec_id FROM s ORDER BY s DESC, vec_id LIMIT 10) SELECT string_agg(vec_id, ',' ORDER BY vec_id) AS indices FROM t")
def k2_sorted_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scored(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(10)
    return top.agg(F.array_join(F.sort_array(F.collect_list("vec_id")), ",").alias("indices"))


@query(_SCORED + ", t AS (SELECT label, row_number() OVER (ORDER BY s DESC, vec_id) AS k FROM s ORDER BY s DESC, vec_id LIMIT 30) SELECT label AS pdf_id, min(k) AS first_rank, count(*) AS pages FROM t GROUP BY 1")
def k3_documents_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the best pages in the order of their first page."""
    top = scored(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(30).withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return top.groupBy(F.col("label").alias("pdf_id")).agg(F.min("k").cast("long").alias("first_rank"), F.count("*").alias("pages"))


@query(_SCORED + """, k AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS k FROM s) SELECT label AS layout_id, string_agg(vec_id, ',' ORDER BY s DESC, vec_id) AS chunks FROM k WHERE k <= 5 OR s >= 0.25 GROUP BY 1""")
def k4_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least five, and every score from the threshold on; grouped by layout."""
    s = scored(spark, sf_dir)
    top = s.orderBy(F.desc("score"), "vec_id").limit(5).union(s.where("score >= 0.25")).distinct()
    hit = F.struct((-F.col("score")).alias("s"), F.col("vec_id"))
    return top.groupBy(F.col("label").alias("layout_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(hit)), lambda x: x["vec_id"]), ",").alias("chunks"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS distance FROM embeddings v, q ORDER BY list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), vec_id LIMIT 10""")
def k5_euclidean_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    d = v.crossJoin(F.broadcast(q)).select("vec_id", F.sqrt(V.squared_distance(F.col("embedding"), F.col("q"))).alias("d"))
    return d.orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 6).alias("distance"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS cosine FROM embeddings v, q WHERE vec_id <> 0""")
def k6_cosine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return v.where("vec_id <> 0").crossJoin(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query(drawing_sql("annotations") + " SELECT id, round_even(x / 10000, 0) AS col_band, y FROM annotations ORDER BY 2, y DESC, id LIMIT 50")
def k7_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = drawing(spark, sf_dir, "annotations").select("id", F.bround(F.col("x") / 10000, 0).alias("col_band"), "y")
    return a.orderBy("col_band", F.desc("y"), "id").limit(50)


@query(_COUNTED + " SELECT region_id, n, bw * bh AS area FROM n ORDER BY n DESC, area DESC, region_id LIMIT 20")
def k8_rerank_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_boxes(spark, sf_dir).select("region_id", "n", G.box_area(F.col("box")).alias("area")).orderBy(F.desc("n"), F.desc("area"), "region_id").limit(20)


@query(_COUNTED + " SELECT region_id FROM n ORDER BY n / (bw * bh) DESC, n DESC, -abs(bw / bh - 1.6) DESC, -(bw * bh) DESC, region_id LIMIT 20")
def k9_rerank_by_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = counted_boxes(spark, sf_dir)
    w, h = F.col("box.max_x") - F.col("box.min_x"), F.col("box.max_y") - F.col("box.min_y")
    return b.orderBy(F.desc(F.col("n") / (w * h)), F.desc("n"), F.desc(-F.abs(w / h - 1.6)), F.desc(-(w * h)), "region_id").limit(20).select("region_id")


@query(drawing_sql("regions") + " SELECT file_id, arg_max(layout_id, n * 1000 - layout_id) AS layout_id FROM (SELECT file_id, layout_id, count(DISTINCT chunk_id) AS n FROM regions GROUP BY ALL) GROUP BY 1")
def k14_largest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = drawing(spark, sf_dir, "regions").groupBy("file_id", "layout_id").agg(F.count_distinct("chunk_id").alias("n"))
    return n.groupBy("file_id").agg(F.max_by("layout_id", F.struct("n", -F.col("layout_id"))).alias("layout_id"))


@query("SELECT arg_max(event_id, ts) AS file_id FROM events WHERE event_type = 'purchase'")
def k15_latest_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").agg(F.max_by("event_id", "ts").alias("file_id"))
