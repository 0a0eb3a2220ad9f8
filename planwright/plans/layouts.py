"""Layout, chunk and metadata roll-ups, defect reports and memory reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators.ordering import exact_percentiles
from planwright.plans.registry import query
from planwright.sources.drawings import drawing, drawing_sql
from planwright.sources.tables import table

#: World-to-pixel transform of the fixture drawings.
MIN_X, MAX_Y, PER_UNIT = 0.0, 5020.0, 0.5
#: Words of layer names that carry meaning for a reader of the drawing (a sample list; a parameter).
SEMANTIC = ("BRAND#1", "BRAND#33", "WALL", "DOOR", "ROOM")


def ring() -> Column:
    return G.rectangle(F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))


def with_boxes(regions: DataFrame) -> DataFrame:
    """The ring of each region, its world and pixel boxes and its area."""
    out = regions.withColumn("ring", ring())
    out = out.withColumns({"dxf": G.ring_box(F.col("ring")), "area": G.ring_area(F.col("ring")), "pixels": G.to_pixels(F.col("ring"), MIN_X, MAX_Y, PER_UNIT)})
    return out.withColumn("px", F.struct(*(f(G.coordinates(F.col("pixels"), k)).alias(n) for n, f, k in (("min_x", F.array_min, "x"), ("min_y", F.array_min, "y"), ("max_x", F.array_max, "x"), ("max_y", F.array_max, "y")))))


def _extent(prefix: str, source: str) -> list[Column]:
    return [f(f"{source}.{n}").alias(f"{prefix}_{n}") for n, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))]


_BOXED = drawing_sql("regions") + """, boxed AS (
  SELECT *, CAST(trunc(x0 * 0.5) AS BIGINT) AS px1, CAST(trunc((x0 + w) * 0.5) AS BIGINT) AS px2,
         CAST(trunc((5020 - y0 - h) * 0.5) AS BIGINT) AS py1, CAST(trunc((5020 - y0) * 0.5) AS BIGINT) AS py2 FROM regions)
"""
_EXTENTS = """min(px1) AS px_min_x, min(py1) AS px_min_y, max(px2) AS px_max_x, max(py2) AS px_max_y,
  min(x0) AS dxf_min_x, min(y0) AS dxf_min_y, max(x0 + w) AS dxf_max_x, max(y0 + h) AS dxf_max_y"""


def layouts(regions: DataFrame, most: int = 5) -> DataFrame:
    """Per layout: distinct chunks, pixel and world boxes and areas, the first chunk ids."""
    b = with_boxes(regions).where("layout_id is not null")
    out = b.groupBy("file_id", "layout_id").agg(F.count_distinct("chunk_id").alias("chunk_count"), *_extent("px", "px"), *_extent("dxf", "dxf"), F.sort_array(F.collect_set("chunk_id")).alias("ids"))
    # sides are multiplied as doubles: the pixels of a large drawing are more than an integer holds
    side = lambda p, k: (F.col(f"{p}_max_{k}") - F.col(f"{p}_min_{k}")).cast("double")
    area = lambda p: (side(p, "x") * side(p, "y")).alias(f"{p}_area")
    return out.select("file_id", "layout_id", "chunk_count", *(f"{p}_{n}" for p in ("px", "dxf") for n in ("min_x", "min_y", "max_x", "max_y")), area("px"), area("dxf"), F.array_join(F.slice("ids", 1, most), ",").alias("chunk_ids"), (F.size("ids") > most).alias("truncated"))


_G1 = _BOXED + f""", g AS (SELECT file_id, layout_id, count(DISTINCT chunk_id) AS chunk_count, {_EXTENTS}, list_sort(list(DISTINCT chunk_id)) AS ids FROM boxed GROUP BY ALL)
SELECT * EXCLUDE (ids), CAST((px_max_x - px_min_x) * (px_max_y - px_min_y) AS DOUBLE) AS px_area, (dxf_max_x - dxf_min_x) * (dxf_max_y - dxf_min_y) AS dxf_area,
  array_to_string(ids[1:5], ',') AS chunk_ids, len(ids) > 5 AS truncated FROM g"""


@query(_G1)
def g1_list_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts(drawing(spark, sf_dir, "regions"))


@query(_BOXED + f""", g AS (SELECT chunk_id, count(*) AS n_regions, {_EXTENTS} FROM boxed WHERE file_id = 1 AND layout_id = 3 GROUP BY chunk_id),
n AS (SELECT *, count(*) OVER () > 10 AS truncated FROM g) SELECT * FROM n ORDER BY chunk_id LIMIT 10""")
def g2_list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = with_boxes(drawing(spark, sf_dir, "regions").where("file_id = 1 and layout_id = 3")).groupBy("chunk_id").agg(F.count("*").alias("n_regions"), *_extent("px", "px"), *_extent("dxf", "dxf"))
    total = chunks.agg((F.count("*") > 10).alias("truncated"))
    return chunks.orderBy("chunk_id").limit(10).crossJoin(F.broadcast(total))


@query(drawing_sql("regions") + """, g AS (
  SELECT layout_id, chunk_id, sum(w * h) AS area, count(*) AS polygon_count, min(x0) AS min_x, min(y0) AS min_y, max(x0 + w) AS max_x, max(y0 + h) AS max_y FROM regions GROUP BY ALL)
SELECT *, area / ((max_x - min_x) * (max_y - min_y)) AS coverage FROM g""")
def g3_geometry_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = with_boxes(drawing(spark, sf_dir, "regions").withColumn("ring", G.clean_ring(ring())))
    out = b.groupBy("layout_id", "chunk_id").agg(F.sum("area").alias("area"), F.count("*").alias("polygon_count"), *(c.alias(n) for c, n in zip(_extent("d", "dxf"), ("min_x", "min_y", "max_x", "max_y"), strict=True)))
    whole = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return out.withColumn("coverage", F.when(whole > 0, F.col("area") / whole).otherwise(0.0))


@query(drawing_sql("regions") + """, r AS (SELECT *, row_number() OVER (PARTITION BY layout_id, chunk_id ORDER BY region_id) AS k, count(*) OVER (PARTITION BY layout_id, chunk_id) AS n FROM regions)
SELECT layout_id, chunk_id, region_id, 3 AS points, n > 2 AS polygons_truncated FROM r WHERE k <= 2""")
def g4_truncated_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two polygons of a chunk, three points of each."""
    by = Window.partitionBy("layout_id", "chunk_id")
    r = drawing(spark, sf_dir, "regions").withColumn("k", F.row_number().over(by.orderBy("region_id"))).withColumn("n", F.count("*").over(by)).where("k <= 2")
    return r.select("layout_id", "chunk_id", "region_id", F.size(F.slice(ring(), 1, 3)).alias("points"), (F.col("n") > 2).alias("polygons_truncated"))


@query(drawing_sql("entities") + """, layers AS (SELECT DISTINCT layer FROM entities UNION SELECT 'EMPTY' )
SELECT l.layer, e.type, count(e.entity_id) AS n FROM layers l LEFT JOIN entities e USING (layer) GROUP BY ALL""")
def g5_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by layer and type; a layer without entities stays with 0."""
    e = drawing(spark, sf_dir, "entities")
    layers = e.select("layer").union(spark.createDataFrame([("EMPTY",)], "layer string")).distinct()
    counts = e.groupBy("layer", "type").agg(F.count("*").alias("n"))
    return layers.join(counts, "layer", "left").select("layer", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(drawing_sql("entities") + ", c AS (SELECT layer, count(*) AS n FROM entities GROUP BY 1) SELECT layer, n FROM c ORDER BY n DESC, layer LIMIT 10")
def g6_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "entities").groupBy("layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer").limit(10)


@query(drawing_sql("entities") + """, d AS (SELECT layer, count(*) AS density FROM entities GROUP BY 1),
t AS (SELECT type, row_number() OVER (ORDER BY count(*) DESC, type) AS tr FROM entities GROUP BY type),
r AS (SELECT e.type, e.layer, e.entity_id, row_number() OVER (PARTITION BY e.type ORDER BY d.density DESC, e.layer, e.entity_id) AS k FROM entities e JOIN d USING (layer) JOIN t USING (type) WHERE t.tr <= 3)
SELECT type, layer, entity_id, k FROM r WHERE k <= 4""")
def g7_trimmed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three commonest types four examples each, from the densest layers first."""
    e = drawing(spark, sf_dir, "entities")
    density = e.groupBy("layer").agg(F.count("*").alias("density"))
    types = e.groupBy("type").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "type").limit(3).select("type")
    k = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("density"), "layer", "entity_id"))
    return e.join(F.broadcast(types), "type").join(density, "layer").withColumn("k", k).where("k <= 4").select("type", "layer", "entity_id", F.col("k").cast("long").alias("k"))


@query(drawing_sql("entities") + """, d AS (SELECT layer, count(*) AS n FROM entities WHERE contains(upper(layer), 'BRAND#1') OR contains(upper(layer), 'BRAND#33') OR contains(upper(layer), 'WALL') OR contains(upper(layer), 'DOOR') OR contains(upper(layer), 'ROOM') GROUP BY 1)
SELECT layer, n FROM d""")
def g7b_semantic_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, SEMANTIC))
    return drawing(spark, sf_dir, "entities").where(F.exists(words, lambda k: F.contains(F.upper("layer"), k))).groupBy("layer").agg(F.count("*").alias("n"))


@query(drawing_sql("entities", "regions") + """, roi AS (SELECT DISTINCT x0, y0, w, h FROM regions WHERE layer = '5-LOW'),
hit AS (SELECT DISTINCT e.entity_id, e.type, e.layer FROM entities e JOIN roi r ON e.x + e.radius >= r.x0 AND e.x - e.radius <= r.x0 + r.w AND e.y + e.radius >= r.y0 AND e.y - e.radius <= r.y0 + r.h)
SELECT layer, type, count(*) AS n FROM hit GROUP BY ALL""")
def g8_roi_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the entities whose boxes meet the union of some regions."""
    from planwright.operators.spatial import box_join

    e = drawing(spark, sf_dir, "entities").withColumn("box", G.box(F.col("x") - F.col("radius"), F.col("y") - F.col("radius"), F.col("x") + F.col("radius"), F.col("y") + F.col("radius")))
    roi = drawing(spark, sf_dir, "regions").where("layer = '5-LOW'").select(G.ring_box(ring()).alias("roi")).distinct()
    return box_join(e, roi, "box", "roi", cell=200.0).select("entity_id", "type", "layer").distinct().groupBy("layer", "type").agg(F.count("*").alias("n"))


@query(drawing_sql("defects") + """ SELECT lower(severity) AS severity, NULL AS type, count(*) AS n FROM defects GROUP BY 1
UNION ALL SELECT NULL, type, count(*) FROM defects GROUP BY 2""")
def g9_defect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groupings of one scan."""
    d = drawing(spark, sf_dir, "defects").withColumn("severity", F.lower("severity"))
    return d.groupingSets([["severity"], ["type"]], "severity", "type").agg(F.count("*").alias("n")).select("severity", "type", "n")


def severity(c: str = "severity") -> Column:
    """high, medium or low; whatever else is low."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("high", "medium"), s).otherwise("low")


_SEV = "CASE WHEN lower(severity) IN ('high', 'medium') THEN lower(severity) ELSE 'low' END"


@query(drawing_sql("defects") + f""", s AS (SELECT {_SEV} AS s FROM defects) SELECT count(*) AS total, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low,
round(100.0 * count(*) FILTER (s = 'high') / count(*), 4) AS high_pct FROM s""")
def g10_severity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawing(spark, sf_dir, "defects").select(severity().alias("s"))
    n = {k: F.count_if(F.col("s") == k) for k in ("high", "medium", "low")}
    return d.agg(F.count("*").alias("total"), *(v.alias(k) for k, v in n.items()), F.round(100.0 * n["high"] / F.count("*"), 4).alias("high_pct"))


@query(drawing_sql("defects") + f""" SELECT layout_id, chunk_id, max(CASE {_SEV} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS risk FROM defects GROUP BY ALL""")
def g11_risk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(severity() == "high", 3).when(severity() == "medium", 2).otherwise(1)
    return drawing(spark, sf_dir, "defects").groupBy("layout_id", "chunk_id").agg(F.max(rank).alias("risk"))


@query(drawing_sql("annotations") + """, q(q) AS (VALUES ('the'), ('que'), ('der')), h AS (SELECT layer, q, count(*) AS n FROM annotations JOIN q ON contains(lower(text), q) GROUP BY ALL)
SELECT layer AS file, q AS keyword, n, CAST(sum(n) OVER (PARTITION BY layer) AS BIGINT) AS total FROM h""")
def g12_text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planwright.functions.text import matched

    a = drawing(spark, sf_dir, "annotations")
    hits = a.select(F.col("layer").alias("file"), F.explode(matched(F.col("text"), ["the", "que", "der"])).alias("keyword")).groupBy("file", "keyword").agg(F.count("*").alias("n"))
    return hits.withColumn("total", F.sum("n").over(Window.partitionBy("file")))


@query("""WITH c AS (SELECT CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_id FROM embeddings)
SELECT count(*) FILTER (cluster_id = -1) AS noise, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters, count(*) AS points FROM c""")
def g13_cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster_id"))
    return c.agg(F.count_if(F.col("cluster_id") == -1).alias("noise"), F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters"), F.count("*").alias("points"))


@query("""WITH c AS (SELECT label AS cluster_id, vec_id % 8 AS layout_id, vec_id AS chunk_id FROM embeddings WHERE label <> 9),
l AS (SELECT cluster_id, layout_id, array_to_string(list(chunk_id ORDER BY chunk_id), ',') AS chunks FROM c GROUP BY ALL)
SELECT cluster_id, string_agg(layout_id || ':' || chunks, ';' ORDER BY layout_id) AS layouts FROM l GROUP BY 1""")
def g14_cluster_layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster -> layout -> sorted chunk ids; noise is left out."""
    c = table(spark, sf_dir, "embeddings").where("label <> 9").select(F.col("label").alias("cluster_id"), (F.col("vec_id") % 8).alias("layout_id"), F.col("vec_id").alias("chunk_id"))
    inner = c.groupBy("cluster_id", "layout_id").agg(F.array_join(F.sort_array(F.collect_list("chunk_id")), ",").alias("chunks"))
    return inner.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layout_id", "chunks"))), lambda x: F.concat_ws(":", x["layout_id"], x["chunks"])), ";").alias("layouts"))


@query(drawing_sql("regions") + """, l AS (SELECT file_id, layout_id, count(*) AS nodes, max(x0 + w) - min(x0) AS width, max(y0 + h) - min(y0) AS height FROM regions GROUP BY ALL)
SELECT count(*) AS layouts, CAST(sum(nodes) AS BIGINT) AS nodes, min(nodes) AS min_nodes, max(nodes) AS max_nodes, round(avg(nodes), 6) AS avg_nodes, round(avg(width), 6) AS avg_width, max(width) AS max_width, round(avg(height), 6) AS avg_height, max(height) AS max_height FROM l""")
def g15_basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    per = drawing(spark, sf_dir, "regions").groupBy("file_id", "layout_id").agg(F.count("*").alias("nodes"), (F.max(w) - F.min("x0")).alias("width"), (F.max(h) - F.min("y0")).alias("height"))
    return per.agg(F.count("*").alias("layouts"), F.sum("nodes").alias("nodes"), F.min("nodes").alias("min_nodes"), F.max("nodes").alias("max_nodes"), F.round(F.avg("nodes"), 6).alias("avg_nodes"), F.round(F.avg("width"), 6).alias("avg_width"), F.max("width").alias("max_width"), F.round(F.avg("height"), 6).alias("avg_height"), F.max("height").alias("max_height"))


@query(drawing_sql("entities") + """, c AS (SELECT text, count(*) AS n FROM entities GROUP BY 1)
SELECT count(*) AS distinct_types, min(text) FILTER (n = (SELECT max(n) FROM c)) AS mode, count(*) FILTER (n = 1) AS singletons, round(1 - count(*) / sum(n), 6) AS repetition FROM c""")
def g17_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = drawing(spark, sf_dir, "entities").groupBy("text").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("text")))
    return c.agg(F.count("*").alias("distinct_types"), best["text"].alias("mode"), F.count_if(F.col("n") == 1).alias("singletons"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("repetition"))


@query(drawing_sql("entities") + " SELECT file_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM entities GROUP BY 1")
def g19_drawing_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drawing(spark, sf_dir, "entities").groupBy("file_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    return e.withColumn("area", G.box_area(F.struct("min_x", "min_y", "max_x", "max_y")))


def latest_batch(memory: DataFrame, keys: list[str], seconds: float = 60) -> DataFrame:
    """Of each key the rows of the newest burst: not older than the newest by more than ``seconds``."""
    newest = memory.groupBy(*keys).agg(F.max("created_at").alias("newest"))
    age = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return memory.join(newest, keys).where(age <= seconds)


@query(drawing_sql("memory") + """, n AS (SELECT *, max(created_at) OVER (PARTITION BY file_path, query_keyword) AS newest FROM memory)
SELECT id, file_path, query_keyword FROM n WHERE epoch(newest) - epoch(created_at) <= 3600""")
def g20_latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_batch(drawing(spark, sf_dir, "memory"), ["file_path", "query_keyword"], 3600).select("id", "file_path", "query_keyword")


@query(drawing_sql("memory") + " SELECT file_path, count(*) AS n, min(min_x) AS min_x FROM memory WHERE classification = 'general drawing' GROUP BY 1")
def g21_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing(spark, sf_dir, "memory").where("classification = 'general drawing'").groupBy("file_path").agg(F.count("*").alias("n"), F.min("min_x").alias("min_x"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def g22_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", p / 100), 6).alias(f"p{p}") for p in (25, 50, 95)))


def high_outliers(rows: DataFrame, key: str, value: str, z: float = 3.5, ratio: float = 8.0) -> DataFrame:
    """``is_outlier``: robust z of log10 values (0.6745 |v - median| / MAD) or ratio to the median too high; none below three positive values."""
    w = Window.partitionBy(key)
    log = F.log10(F.greatest(F.col(value), F.lit(1e-12)))
    out = rows.withColumn("_log", log).withColumns({"_mid": F.median("_log").over(w), "_med": F.median(value).over(w), "_pos": F.count_if(F.col(value) > 0).over(w)})
    out = out.withColumn("_dev", F.abs(F.col("_log") - F.col("_mid"))).withColumn("_mad", F.median("_dev").over(w))
    robust = F.when(F.col("_mad") > 1e-9, 0.6745 * F.col("_dev") / F.col("_mad")).otherwise(0.0)
    far = (F.col("_med") == 0) | (F.col(value) / F.when(F.col("_med") != 0, F.col("_med")) >= ratio)
    return out.withColumn("is_outlier", (F.col("_pos") >= 3) & ((robust >= z) | F.coalesce(far, F.lit(True)))).drop("_log", "_mid", "_med", "_pos", "_dev", "_mad")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, log10(greatest(o_totalprice, 1e-12)) AS l FROM orders),
a AS (SELECT *, median(l) OVER p AS m, median(v) OVER p AS mv, count(*) FILTER (v > 0) OVER p AS n FROM v WINDOW p AS (PARTITION BY o_custkey)),
b AS (SELECT *, abs(l - m) AS d FROM a), c AS (SELECT *, median(d) OVER (PARTITION BY o_custkey) AS mad FROM b)
SELECT o_orderkey FROM c WHERE n >= 3 AND (CASE WHEN mad > 1e-9 THEN 0.6745 * d / mad ELSE 0 END >= 3.5 OR v / mv >= 8)""")
def g23_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_outliers(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").where("is_outlier").select("o_orderkey")


def prune_iqr(rows: DataFrame, value: str, factor: float = 3.0) -> DataFrame:
    """Rows within ``factor`` interquartile ranges of the quartiles; zero range: within 3 deviations of the median. Below 10 rows all stay."""
    q = exact_percentiles(rows, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).crossJoin(rows.agg(F.stddev_pop(value).alias("sd"), F.count("*").alias("n")))
    iqr, v = F.col("q3") - F.col("q1"), F.col(value)
    inside = F.when(iqr > 0, v.between(F.col("q1") - factor * iqr, F.col("q3") + factor * iqr)).otherwise(F.abs(v - F.col("q2")) <= 3 * F.col("sd"))
    return rows.crossJoin(F.broadcast(q)).where((F.col("n") < 10) | inside).drop("q1", "q2", "q3", "sd", "n")


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem, q WHERE l_extendedprice BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a)""")
def g25_prune_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune_iqr(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", 0.3).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(drawing_sql("regions") + """ SELECT region_id, w * h AS area, 2 * (w + h) AS perimeter, x0 + w / 2 AS cx, y0 + h / 2 AS cy, round(greatest(w, h) / least(w, h), 6) AS aspect, round(4 * pi() * w * h / (4 * (w + h) * (w + h)), 6) AS compactness FROM regions""")
def g27_region_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_boxes(drawing(spark, sf_dir, "regions")).withColumns({"perimeter": G.ring_perimeter(F.col("ring")), "centre": G.ring_centroid(F.col("ring"))})
    w, h = F.col("dxf.max_x") - F.col("dxf.min_x"), F.col("dxf.max_y") - F.col("dxf.min_y")
    return r.select("region_id", "area", "perimeter", F.round("centre.x", 6).alias("cx"), F.round("centre.y", 6).alias("cy"), F.round(F.greatest(w, h) / F.least(w, h), 6).alias("aspect"), F.round(G.compactness(F.col("area"), F.col("perimeter")), 6).alias("compactness"))


@query(drawing_sql("defects") + " SELECT layout_id, string_agg(type || '#' || id, '; ' ORDER BY id) AS summary, count(*) AS n FROM defects WHERE severity = 'High' GROUP BY 1")
def g29_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawing(spark, sf_dir, "defects").where("severity = 'High'")
    return d.groupBy("layout_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "type"))), lambda x: F.concat(x["type"], F.lit("#"), x["id"].cast("string"))), "; ").alias("summary"), F.count("*").alias("n"))


@query(drawing_sql("defects") + " SELECT layout_id, max(id) AS id, arg_max(type, id) AS type FROM defects GROUP BY 1")
def g30_latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last report of a layout replaces earlier ones."""
    return drawing(spark, sf_dir, "defects").groupBy("layout_id").agg(F.max("id").alias("id"), F.max_by("type", "id").alias("type"))
