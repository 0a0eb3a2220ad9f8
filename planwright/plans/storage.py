"""Scans, listings and round trips of sources and sinks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.plans.layouts import ring
from planwright.plans.registry import query
from planwright.sources import dxf, files, vector_index
from planwright.sources.drawings import drawing, drawing_sql
from planwright.sources.tables import table
from planwright.staging import shared_dir


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/planwright/{name}-{uuid.uuid4().hex}"


@query(drawing_sql("regions") + " SELECT layout_id, chunk_id, count(*) AS n, sum(x0) AS sx FROM regions GROUP BY ALL")
def s7_s8_geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drawing(spark, sf_dir, "regions")
    path = _path(spark, "geojson") + "/a.geojson"
    files.write_geojson(r.select("file_id", F.col("layout_id").cast("int").alias("layout_id"), F.col("chunk_id").cast("int").alias("chunk_id"), F.col("region_id").cast("int").alias("node_id"), F.array().cast("array<int>").alias("neighbors"), ring().alias("ring")), path)
    raw = spark.read.schema(files.FEATURES).json(path)
    back = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates")[0][0][0].alias("x"))
    return back.groupBy(F.col("layout_id").cast("long").alias("layout_id"), F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


@query(drawing_sql("regions") + " SELECT layout_id, chunk_id, string_agg(region_id, ',' ORDER BY region_id) AS nodes FROM regions GROUP BY ALL")
def s9_s10_grouped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of each layout and chunk, sorted by node."""
    return drawing(spark, sf_dir, "regions").groupBy("layout_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_list("region_id")), ",").alias("nodes"))


def _one_file_each(rows: DataFrame, path: str) -> None:
    """A JSON file for each row of (file_id, value)."""
    rows.repartition("file_id").write.partitionBy("file_id").text(path)


@query(drawing_sql("entities") + " SELECT type, layer, count(*) AS n, sum(x) AS sx, count(CASE WHEN type = 'TEXT' THEN 1 END) AS texts, count(CASE WHEN entity_id % 7 = 0 THEN 1 END) AS in_blocks FROM entities GROUP BY ALL")
def s11_cad_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings written as CAD JSON, positions under names that change, a seventh of the entities in blocks; read from all folders below and laid flat."""
    e = drawing(spark, sf_dir, "entities")
    names = ("position", "insertionPoint", "center")
    at = F.struct("x", "y")
    place = [F.when(F.col("entity_id") % len(names) == k, at).alias(n) for k, n in enumerate(names)]
    told = F.to_json(F.struct("type", "layer", F.when(F.col("type") == "TEXT", F.col("text")).alias("text"), *place))
    kept = lambda inside: F.array_join(F.collect_list(F.when((F.col("entity_id") % 7 == 0) == F.lit(inside), told)), ",")
    whole = e.groupBy("file_id").agg(F.concat(F.lit('{"entities":['), kept(False), F.lit('],"blocks":{"A":['), kept(True), F.lit("]}}")).alias("value"))
    path = _path(spark, "cad")
    _one_file_each(whole, path)
    found = files.canonical_entities(files.read_cad_json(spark, path, "*.txt"))
    return found.groupBy("type", "layer").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.count("text").alias("texts"), F.count("block").alias("in_blocks"))


@query(drawing_sql("entities") + """, t AS (SELECT file_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM entities GROUP BY 1) SELECT round(a, 4) AS min_x, round(b, 4) AS max_x, round(c, 4) AS min_y, round(d, 4) AS max_y, CAST(2 AS DOUBLE) AS pixel_per_unit, CAST(ceil(2 * (b - a)) AS INTEGER) AS image_width FROM t""")
def s17_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawing's transform written as JSON and read again."""
    e = drawing(spark, sf_dir, "entities").groupBy("file_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    wide = F.ceil(2 * (F.col("max_x") - F.col("min_x"))).cast("int").alias("image_width")
    path = _path(spark, "transforms")
    _one_file_each(e.select("file_id", F.to_json(F.struct("min_x", "max_x", "min_y", "max_y", F.lit(2.0).alias("pixel_per_unit"), wide)).alias("value")), path)
    t = files.read_transforms(spark, path, "*.txt")
    return t.select(*(F.round(c, 4).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")), "pixel_per_unit", "image_width")


@query("SELECT vec_id, label FROM embeddings")
def s12_projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.required(table(spark, sf_dir, "embeddings"), "vec_id", "label")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: abs(x))) / sqrt(list_inner_product(e, e)), 3) AS spread FROM v")
def s13_s14_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors written and read again: the sum of their components' sizes."""
    path = _path(spark, "index")
    files.write_vectors(table(spark, sf_dir, "embeddings"), path)
    back = spark.read.parquet(path)
    return back.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 3).alias("spread"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), n AS (SELECT vec_id, label, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS s FROM embeddings v, q)
SELECT vec_id, label, round(s, 6) AS score FROM n ORDER BY s DESC, vec_id LIMIT 10""")
def s14_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written, then searched cell by cell; the ten vectors most like that of vec_id 0."""
    path, rows = _path(spark, "cells"), table(spark, sf_dir, "embeddings")
    vector_index.write_index(rows, path, keep=("label",))
    asked = rows.where("vec_id = 0").select("embedding").first()
    found, _ = vector_index.search_index(spark, path, list(asked[0]) if asked else [], 10)
    return found.select(F.col("id").alias("vec_id"), "label", F.round("score", 6).alias("score"))


@query(drawing_sql("regions") + " SELECT layout_id, chunk_id, x0 AS x, y0 AS y, w, h FROM regions")
def s15_flat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.masks(drawing(spark, sf_dir, "regions").withColumn("ring", ring()))
    return m.select("layout_id", "chunk_id", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x", "y", "w", "h"))))


@query(drawing_sql("regions") + " SELECT layout_id, chunk_id, count(*) AS polygons, min(x0) - 5 AS min_x, max(y0 + h) + 5 AS max_y FROM regions GROUP BY ALL")
def s16_s30_nested_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested and taken apart again; a chunk's polygons come in several rows."""
    flat = files.masks(drawing(spark, sf_dir, "regions").withColumn("ring", ring()))
    n = files.nested_masks(flat, 5.0).select(F.explode("layouts").alias("layout_id", "l")).select("layout_id", F.explode("l.chunks").alias("chunk_id", "c"))
    whole = n.groupBy(F.col("layout_id").cast("long").alias("layout_id"), F.col("chunk_id").cast("long").alias("chunk_id"))
    return whole.agg(F.sum(F.size("c.polygons").cast("long")).alias("polygons"), F.min("c.bounding_box.min_x").alias("min_x"), F.max("c.bounding_box.max_y").alias("max_y"))


@query(drawing_sql("memory") + " SELECT file_path, count(*) AS n FROM memory WHERE query_keyword <> 'view' GROUP BY 1")
def s20_memory_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, then delete by filter and overwrite."""
    path = _path(spark, "memory")
    drawing(spark, sf_dir, "memory").write.mode("append").parquet(path)
    spark.read.parquet(path).where("query_keyword <> 'view'").write.mode("overwrite").parquet(path + "-2")
    return spark.read.parquet(path + "-2").groupBy("file_path").agg(F.count("*").alias("n"))


@query("SELECT event_id AS \"e.id\", CAST(json_extract(props, '$.k') AS BIGINT) AS \"e.p.k\" FROM events")
def s21_s22_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results as flat columns with dotted names."""
    e = table(spark, sf_dir, "events").select(F.struct(F.col("event_id").alias("id"), F.from_json("props", "k long").alias("p")).alias("e"))
    return files.flatten(e)


@query("WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_partkey, CASE WHEN k > 0 THEN p_brand || '_' || k ELSE p_brand END AS p_brand FROM k")
def s23_s26_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("SELECT c_custkey, coalesce(o.status, 'new') AS status, coalesce(o.source, c_name) AS source FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS source FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def s24_s25_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first, with the status row's source before the metadata's."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("source"))
    out = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("source", "c_name").alias("source")).orderBy(F.desc("c_custkey"))


@query("SELECT o_custkey AS pdf_id, arg_min(o_orderpriority, o_orderkey) AS pdf_source, count(*) AS pages FROM orders GROUP BY 1")
def s27_first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pdf_id")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("pdf_source"), F.count("*").alias("pages"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS file_id FROM documents), k AS (SELECT file_id, min(doc_id) AS doc_id FROM h GROUP BY 1) SELECT doc_id, file_id FROM k WHERE doc_id % 2 = 1")
def s28_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New uploads by content: what completed before is a cache hit."""
    h = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("file_id")).agg(F.min("doc_id").alias("doc_id"))
    done = h.where("doc_id % 2 = 0").select("file_id")
    return h.join(done, "file_id", "left_anti").select("doc_id", "file_id")


@query("SELECT user_id, arg_max(event_id, ts) AS latest FROM events GROUP BY 1")
def s29_latest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("latest"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders")
def s19_corpus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order over a whole table, without one task for all rows."""
    from planwright.operators.ordering import with_row_number

    rows = with_row_number(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "k")
    return rows.select("o_orderkey", (F.col("k") + 1).alias("k"))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DXF text of the fixture entities, one drawing for each file_id: header, tables, a block and the entities.

    After every tenth entity one whose coordinate is no number and a line that is no code, and in every text a sign that some take for the end of a line.
    """
    e = drawing(spark, sf_dir, "entities")
    tag = lambda code, v: F.concat(F.lit(f"{code}\n"), v.cast("string"), F.lit("\n"))
    text = F.when(F.col("type") == "TEXT", tag(1, F.concat(F.col("text"), F.lit("\u0085 \u2028.")))).when(F.col("type") == "INSERT", tag(2, F.lit("B1"))).when(F.col("type") == "LINE", F.concat(tag(11, F.col("x") + F.col("radius")), tag(21, F.col("y")))).otherwise("")
    body = F.concat(tag(0, F.col("type")), tag(5, F.hex("entity_id")), tag(8, F.col("layer")), tag(10, F.col("x")), tag(20, F.col("y")), tag(40, F.col("radius")), text)
    broken = F.when(F.col("entity_id") % 10 == 0, F.lit("0\nLINE\n8\nbad\n10\nnowhere\n20\n1\nno code here\n")).otherwise("")
    layer = F.concat(F.lit("0\nLAYER\n2\n"), F.col("layer"), F.lit("\n62\n"), F.when(F.substring("layer", -1, 1) == "1", "-3").otherwise("5"), F.lit("\n70\n"), F.when(F.substring("layer", -1, 1) == "2", "5").otherwise("0"), F.lit("\n6\nDASHED\n"))
    tables = F.concat(F.lit("0\nSECTION\n2\nTABLES\n"), F.array_join(F.array_sort(F.collect_set(layer)), ""), F.lit("0\nLTYPE\n2\nDASHED\n3\nlong _ _\n0\nSTYLE\n2\nNOTES\n40\n2.5\n0\nDIMSTYLE\n2\nISO\n0\nENDSEC\n0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB1\n0\nENDBLK\n0\nENDSEC\n"))
    top = F.concat(F.lit("0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1027\n9\n$EXTMAX\n10\n"), F.max("x").cast("string"), F.lit("\n20\n"), F.max("y").cast("string"), F.lit("\n0\nENDSEC\n"))
    head, tail = F.lit("0\nSECTION\n2\nENTITIES\n"), F.lit("0\nENDSEC\n0\nEOF\n")
    all_ = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entity_id", F.concat(body, broken).alias("b")))), lambda x: x["b"]), "")
    return e.groupBy("file_id").agg(F.encode(F.concat(top, tables, head, all_, tail), "UTF-8").alias("content")).select("content")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dxf.parse_drawings(drawings(spark, sf_dir))


@query(drawing_sql("entities") + " SELECT type, count(*) AS n, sum(x) AS sx FROM entities GROUP BY 1")
def s2_raster_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of encodings for drawings that are to be rasterised."""
    e = dxf.entities(dxf.parse_drawings(drawings(spark, sf_dir), dxf.RASTER_ENCODINGS))
    return e.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("points")[0]["x"]).alias("sx"))


@query(drawing_sql("entities") + """ SELECT CASE k WHEN 0 THEN 'LINE' END AS type, CASE k WHEN 0 THEN '10: nowhere' ELSE 'no code here' END AS corrupt, count(*) AS n FROM entities, range(2) t(k) WHERE entity_id % 10 = 0 GROUP BY ALL""")
def s3_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What couldn't be read; the entities after it are there all the same (s1_s4_dxf_entities)."""
    return dxf.corrupt(_records(spark, sf_dir)).groupBy("type", "corrupt").agg(F.count("*").alias("n"))


@query(drawing_sql("entities") + """ SELECT layer AS name, CASE WHEN layer LIKE '%1' THEN 3 ELSE 5 END AS color, 'DASHED' AS linetype, layer LIKE '%2' AS is_frozen, layer LIKE '%2' AS is_locked, layer LIKE '%1' AS is_off, count(DISTINCT file_id) AS files FROM entities GROUP BY layer""")
def s5_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dxf.layers(_records(spark, sf_dir))
    return r.groupBy("name", "color", "linetype", "is_frozen", "is_locked", "is_off").agg(F.count_distinct("file_id").alias("files"))


@query(drawing_sql("entities") + """, f AS (SELECT count(DISTINCT file_id) AS files FROM entities), t(kind, name, detail) AS (VALUES ('block', 'B1', NULL), ('dimstyle', 'ISO', NULL), ('linetype', 'DASHED', 'long _ _'), ('style', 'NOTES', '2.5')) SELECT kind, name, detail, files FROM t, f""")
def s5_named_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dxf.all_named(_records(spark, sf_dir)).groupBy("kind", "name", "detail").agg(F.count_distinct("file_id").alias("files"))


@query(drawing_sql("entities") + """, m AS (SELECT file_id, max(x) AS x, max(y) AS y FROM entities GROUP BY 1), v AS (SELECT '$ACADVER' AS variable, 'AC1027' AS value FROM m UNION ALL SELECT '$EXTMAX', x || ',' || y FROM m) SELECT variable, value, count(*) AS files FROM v GROUP BY ALL""")
def s5_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dxf.header(_records(spark, sf_dir)).groupBy("variable", "value").agg(F.count("*").alias("files"))


@query(drawing_sql("entities") + " SELECT type, layer, count(*) AS n, sum(x) AS sx, count(CASE WHEN type = 'TEXT' THEN text END) AS texts FROM entities GROUP BY ALL")
def s1_s4_dxf_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings written as DXF text and parsed again."""
    e = dxf.entities(dxf.parse_drawings(drawings(spark, sf_dir)))
    return e.groupBy("type", "layer").agg(F.count("*").alias("n"), F.sum(F.col("points")[0]["x"]).alias("sx"), F.count("text").alias("texts"))


@query(drawing_sql("entities") + " SELECT layer, count(*) AS n, round(sum(radius), 4) AS length FROM entities WHERE type = 'LINE' AND radius > 0.1 GROUP BY 1")
def s6_dxf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dxf.lines(dxf.parse_drawings(drawings(spark, sf_dir)).where("type <> 'CIRCLE'"))
    return lines.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 4).alias("length"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def p1_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain aggregation over the largest table, for the bench."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY 1")
def p2_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(li, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order of ``order``."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")
