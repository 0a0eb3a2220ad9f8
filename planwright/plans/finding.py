"""Candidate scores, region routing, graph variants and request rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwright.functions import geometry as G
from planwright.operators import finders, occupancy
from planwright.operators.kernels import suppress
from planwright.operators.ordering import runs_of_groups, sorted_runs
from planwright.operators.spatial import box_join, nearest_points
from planwright.plans import shapes
from planwright.plans.joins import counted_boxes
from planwright.plans.layouts import high_outliers, ring
from planwright.plans.registry import query
from planwright.sources.drawings import drawing, drawing_sql
from planwright.sources.tables import table
from planwright.staging import staged


def priors(elongation: Column, orthogonal: Column, hatch: Column, entropy: Column, dimensions: Column, length_ratio: Column) -> tuple[Column, Column]:
    """How much a place looks like a plan and like a strip, 0 to 1, by fixed weights."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    round_ = clip(1 - F.least(F.lit(1.0), (elongation - 1) / 7))
    grid = orthogonal * (0.55 + 0.45 * (1 - entropy))
    # fixed values: weights of elongation, grid, hatching, dimensions and length balance
    plan = 0.38 * round_ + 0.28 * grid + 0.18 * F.least(F.lit(1.0), hatch * 2) + 0.10 * F.least(F.lit(1.0), dimensions / 25) + 0.06 * F.greatest(F.lit(0.0), 1 - F.abs(length_ratio - 1) / 3)
    strip = 0.72 * clip((elongation - 1) / 11) + 0.18 * (1 - orthogonal) + 0.10 * F.least(F.lit(1.0), entropy)
    return clip(plan), clip(strip)


def aspect_bonus(aspect: Column, plan: Column, strip: Column, strength: float = 0.32) -> Column:
    """A small bonus for a box whose shape fits what the place looks like."""
    long = strength * strip * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (aspect - 1) / 14)) - F.when(aspect < 2, 0.12 * strength * strip * (2 - aspect) / 2).otherwise(0.0)
    wide = strength * plan * F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), aspect - 5) / 15)
    return F.when(strip >= plan, long).otherwise(wide)


_PRIOR = """WITH f AS (SELECT p_partkey, 1 + p_size / 5.0 AS e, (p_partkey % 10) / 10.0 AS o, (p_partkey % 7) / 10.0 AS h, (p_partkey % 3) / 3.0 AS n, p_size AS d, (p_partkey % 5) / 2.0 AS r FROM part),
p AS (SELECT *, least(1.0, greatest(0.0, 0.38 * greatest(0.0, least(1.0, 1 - least(1.0, (e - 1) / 7))) + 0.28 * o * (0.55 + 0.45 * (1 - n)) + 0.18 * least(1.0, h * 2) + 0.1 * least(1.0, d / 25.0) + 0.06 * greatest(0.0, 1 - abs(r - 1) / 3))) AS plan,
  least(1.0, greatest(0.0, 0.72 * least(1.0, greatest(0.0, (e - 1) / 11)) + 0.18 * (1 - o) + 0.1 * least(1.0, n))) AS strip FROM f)"""


def _priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    plan, strip = priors(1 + size / 5, k % 10 / 10, k % 7 / 10, k % 3 / 3, size, k % 5 / 2)
    return table(spark, sf_dir, "part").select("p_partkey", (1 + size / 5).alias("e"), plan.alias("plan"), strip.alias("strip"))


@query(_PRIOR + " SELECT p_partkey, round(plan, 6) AS plan, round(strip, 6) AS strip FROM p")
def m18_plan_strip_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priors(spark, sf_dir).select("p_partkey", F.round("plan", 6).alias("plan"), F.round("strip", 6).alias("strip"))


@query(_PRIOR + """ SELECT p_partkey, round(CASE WHEN strip >= plan THEN 0.32 * strip * least(1.0, greatest(0.0, (e - 1) / 14)) - CASE WHEN e < 2 THEN 0.12 * 0.32 * strip * (2 - e) / 2 ELSE 0 END
ELSE 0.32 * plan * greatest(0.0, 1 - greatest(0.0, e - 5) / 15) END, 6) AS bonus FROM p""")
def q11_aspect_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priors(spark, sf_dir).select("p_partkey", F.round(aspect_bonus(F.col("e"), F.col("plan"), F.col("strip")), 6).alias("bonus"))


_COUNTED = drawing_sql("regions", "entities") + """, c AS (SELECT region_id, x0 - 60 AS a, y0 - 60 AS b, x0 + w + 60 AS c, y0 + h + 60 AS d FROM regions),
n AS (SELECT region_id, any_value(c.c - c.a) AS bw, any_value(c.d - c.b) AS bh, count(e.entity_id) AS n FROM c LEFT JOIN entities e ON e.x BETWEEN c.a AND c.c AND e.y BETWEEN c.b AND c.d GROUP BY region_id)"""


@query(_COUNTED + " SELECT region_id, n, round(n / (bw * bh), 9) AS density, round(bw / bh, 6) AS aspect FROM n")
def q12_candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("box.max_x") - F.col("box.min_x"), F.col("box.max_y") - F.col("box.min_y")
    return counted_boxes(spark, sf_dir).select("region_id", "n", F.round(F.col("n") / (w * h), 9).alias("density"), F.round(w / h, 6).alias("aspect"))


@query()
def k11_k12_frame_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 120 best of each file by fill, squareness and area, then suppressed at IoU 0.85; scored with the aspect bonus."""
    r = drawing(spark, sf_dir, "regions").withColumn("b", G.ring_box(ring()))
    w, h = F.col("b.max_x") - F.col("b.min_x"), F.col("b.max_y") - F.col("b.min_y")
    fill = G.ring_area(ring()) / G.box_area(F.col("b"))
    plan, strip = priors(F.greatest(w, h) / F.least(w, h), fill, F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(1.0))
    score = fill + aspect_bonus(F.greatest(w / h, h / w), plan, strip)
    ranked = r.withColumn("score", F.round(score, 9)).withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), F.desc(w * h), "region_id"))).where("k <= 120")
    boxes = ranked.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("k", "region_id", "score", "b.min_x", "b.min_y", "b.max_x", "b.max_y"))).alias("boxes"))
    return boxes.select("file_id", F.explode(suppress(F.col("boxes"), 0.85)).alias("c")).select("file_id", "c.region_id", "c.score")


@query(_COUNTED + " SELECT region_id, bw > bh AS wide FROM n WHERE n > 0")
def f11b_nonempty_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = counted_boxes(spark, sf_dir).where("n > 0")
    return b.select("region_id", ((F.col("box.max_x") - F.col("box.min_x")) > (F.col("box.max_y") - F.col("box.min_y"))).alias("wide"))


@query("""WITH h AS (SELECT p_partkey AS id, p_partkey % 4 AS file_id, p_partkey % 3 = 0 AS in_block, p_size % 4 = 2 OR p_size % 7 = 2 AS arc FROM part WHERE p_partkey % 5 < 2)
SELECT file_id, arg_min(id, (in_block, id)) AS id, arg_min(in_block, (in_block, id)) AS in_block FROM h WHERE arc GROUP BY 1""")
def f20_hatch_with_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawing's first hatch with an edge that is an arc (type 2) in any loop: of the model space, else of the blocks."""
    p = table(spark, sf_dir, "part").where("p_partkey % 5 < 2")
    edge = lambda c: F.struct((F.col("p_size") % c).alias("type"))
    loops = F.array(F.struct(F.array(F.struct(F.lit(1).alias("type")), edge(4)).alias("edges")), F.struct(F.array(edge(7)).alias("edges")))
    hatches = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("file_id"), (F.col("p_partkey") % 3 == 0).alias("in_block"), loops.alias("loops"))
    found = hatches.where(F.exists("loops", lambda x: F.exists(x["edges"], lambda e: e["type"] == 2)))
    return found.groupBy("file_id").agg(F.min(F.struct("in_block", "id")).alias("m")).select("file_id", "m.id", "m.in_block")


def check_request(request: dict) -> None:
    """Cross-field rules of an analysis request; raises ValueError."""
    single = request.get("layout_id") is not None and request.get("chunk_id") is not None
    many = bool(request.get("layout_ids")) or bool(request.get("chunk_ids"))
    if request.get("padding", 50) < 0:
        raise ValueError("padding must not be negative")
    if request.get("chunk_image_path"):
        if not single:
            raise ValueError("a chunk image needs layout_id and chunk_id")
    elif not (all(request.get(k) for k in ("full_image_path", "geojson_path", "transform_path")) and (single or many)):
        raise ValueError("give a chunk image, or a full image with geometry, transform and targets")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 AND user_id % 2 = 1 THEN 'target missing' WHEN event_id % 7 - 2 < 0 THEN 'negative padding' ELSE 'ok' END AS verdict FROM events")
def f21_request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as a column, for requests in bulk."""
    has_image, has_target, padding = F.col("event_id") % 4 == 0, F.col("user_id") % 2 == 0, F.col("event_id") % 7 - 2
    verdict = F.when(has_image & ~has_target, "target missing").when(padding < 0, "negative padding").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


@query(drawing_sql("regions") + """, d AS (SELECT file_id, greatest(0.5, least(5.0, (max(x0 + w) - min(x0)) * 0.01)) AS d FROM regions GROUP BY 1)
SELECT a.region_id AS src, b.region_id AS dst FROM regions a JOIN regions b ON a.file_id = b.file_id AND a.region_id < b.region_id JOIN d ON d.file_id = a.file_id
WHERE sqrt(pow(greatest(a.x0 - b.x0 - b.w, b.x0 - a.x0 - a.w, 0), 2) + pow(greatest(a.y0 - b.y0 - b.h, b.y0 - a.y0 - a.h, 0), 2)) < d""")
def j11_adaptive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance is 1 % of each drawing's width, within 0.5 and 5."""
    r = drawing(spark, sf_dir, "regions").withColumn("box", G.ring_box(ring()))
    width = r.groupBy("file_id").agg(F.greatest(F.lit(0.5), F.least(F.lit(5.0), (F.max("box.max_x") - F.min("box.min_x")) * 0.01)).alias("d"))
    a = r.join(width, "file_id").select("file_id", F.col("region_id").alias("src"), F.col("box").alias("l"), "d")
    b = r.select("file_id", F.col("region_id").alias("dst"), F.col("box").alias("r"))
    gap = [F.greatest(F.col(f"l.min_{k}") - F.col(f"r.max_{k}"), F.col(f"r.min_{k}") - F.col(f"l.max_{k}"), F.lit(0.0)) for k in "xy"]
    return box_join(a, b, "l", "r", 32.0, (F.col("src") < F.col("dst")) & (F.sqrt(gap[0] ** 2 + gap[1] ** 2) < F.col("d")), 5.0, ("file_id",)).select("src", "dst")


@query(drawing_sql("regions") + " SELECT region_id, greatest(0, w - 9) * greatest(0, h - 5) AS area FROM regions")
def m3_box_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted box has no area."""
    b = G.box(F.col("x0") + 9, F.col("y0") + 5, F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return drawing(spark, sf_dir, "regions").select("region_id", G.box_area(b).alias("area"))


_RINGS = drawing_sql("regions") + """, g AS (SELECT region_id, w, h, sqrt(w * w + h * h) AS d, CASE WHEN degrees(atan2(h, w)) <= 12 OR degrees(atan2(h, w)) >= 78 THEN 1 ELSE 0 END AS straight, region_id % 2 = 0 AS whole FROM regions)"""


@query(_RINGS + " SELECT region_id, CAST(CASE WHEN whole THEN 1 ELSE 0.5 END AS DOUBLE) AS rectangularity, round(CASE WHEN whole THEN 1 ELSE (w + h + straight * d) / (w + h + d) END, 9) AS orthogonal FROM g")
def m17_rectangularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of its box that a ring fills, and of its length that runs along the axes; every other region is a triangle."""
    own = F.when(F.col("region_id") % 2 == 0, ring()).otherwise(F.filter(ring(), lambda p, i: i != 2))
    r = drawing(spark, sf_dir, "regions").withColumn("ring", own)
    n = F.size("ring")
    sides = F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.element_at("ring", (i + 1) % n + 1).alias("q")))
    long = lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])
    flat = lambda s: F.when(G.is_orthogonal(G.segment_angle(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])), long(s)).otherwise(0.0)
    total = lambda f: F.aggregate(sides, F.lit(0.0), lambda a, s: a + f(s))
    fill = G.ring_area(F.col("ring")) / G.box_area(G.ring_box(F.col("ring")))
    return r.select("region_id", fill.alias("rectangularity"), F.round(total(flat) / total(long), 9).alias("orthogonal"))


@query(drawing_sql("regions") + " SELECT region_id, round(x0 - w * 0.1, 6) AS min_x, round(y0 - h * 0.2, 6) AS min_y, round(x0 + w + w * 0.3, 6) AS max_x, round(y0 + h + h * 0.4, 6) AS max_y FROM regions")
def m22_padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding by multiples of width and height, given for each side."""
    w, h = F.col("w"), F.col("h")
    b = G.box(F.col("x0") - w * 0.1, F.col("y0") - h * 0.2, F.col("x0") + w + w * 0.3, F.col("y0") + h + h * 0.4)
    return drawing(spark, sf_dir, "regions").select("region_id", *(F.round(b[k], 6).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")))


def spline_points(curves: DataFrame, fit: str, control: str, most: int = 180) -> DataFrame:
    """``curves``, without ``fit`` and ``control``, with i and p: the fit points if there are two; else samples along the control polygon, eight for each point.

    Numbers are dealt out first, and each point is worked out in a row of its own: functions over arrays are not compiled, and would make the control points anew for each sample.
    """
    n, i = F.size(control), F.col("i")
    samples = F.least(F.lit(most), n * 8)
    count = F.when(F.size(fit) >= 2, F.size(fit)).when(n < 2, n).otherwise(samples)
    rows = curves.where(count > 0).withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    t = i * (n - 1) / (samples - 1)
    k = F.least(F.floor(t), n - 2).cast("int")
    p, q, u = F.get(control, k), F.get(control, k + 1), t - k
    sample = G.point(p["x"] + (q["x"] - p["x"]) * u, p["y"] + (q["y"] - p["y"]) * u)
    at = F.when(F.size(fit) >= 2, F.get(fit, i)).when(n < 2, F.get(control, i)).otherwise(sample)
    return rows.withColumn("p", at).drop(fit, control)


@query("SELECT p_partkey, i, round(CASE WHEN i * 2 / 23.0 <= 1 THEN i * 2 / 23.0 * p_size ELSE p_size + (i * 2 / 23.0 - 1) * 10 END, 5) AS x FROM part, range(24) t(i)")
def m26_spline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    control = F.array(G.point(0.0, 0.0), G.point(F.col("p_size").cast("double"), 1.0), G.point(F.col("p_size") + 10.0, 2.0))
    curves = p.select("p_partkey", F.slice(control, 1, 0).alias("fit"), control.alias("control"))
    return spline_points(curves, "fit", "control").select("p_partkey", F.col("i").cast("long").alias("i"), F.round("p.x", 5).alias("x"))


@query(drawing_sql("regions") + " SELECT file_id, min(x0) AS min_x, min(y0) AS min_y, max(x0 + w) AS max_x, max(y0 + h) AS max_y FROM regions GROUP BY 1")
def u6_box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = drawing(spark, sf_dir, "regions").select("file_id", G.ring_box(ring()).alias("b"))
    return b.groupBy("file_id").agg(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y"))


@query(drawing_sql("entities") + " SELECT entity_id, text, x, y, radius AS height FROM entities WHERE type = 'TEXT' AND regexp_matches(text, 'a.e')")
def q2_q3_text_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of sub-regions: the pattern heeds case; the text's height comes along."""
    return drawing(spark, sf_dir, "entities").where((F.col("type") == "TEXT") & F.col("text").rlike("a.e")).select("entity_id", "text", "x", "y", F.col("radius").alias("height"))


@query(drawing_sql("entities") + " SELECT entity_id, x, y FROM entities WHERE type IN ('TEXT', 'MTEXT') AND contains(lower(text), 'an') ORDER BY round_even(x / 10000, 0), y DESC, entity_id LIMIT 30")
def q6_label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drawing(spark, sf_dir, "entities").where(F.col("type").isin("TEXT", "MTEXT") & F.contains(F.lower("text"), F.lit("an")))
    return e.orderBy(F.bround(F.col("x") / 10000, 0), F.desc("y"), "entity_id").limit(30).select("entity_id", "x", "y")


@query()
def g24_dominant_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box goes if it is an outlier by area and holds another box."""
    r = drawing(spark, sf_dir, "regions")
    by = F.when(F.col("region_id") % 500 == 0, 400.0).otherwise(0.0)
    b = r.select("file_id", "region_id", G.grow(G.ring_box(ring()), by).alias("b")).withColumn("area", G.box_area(F.col("b")))
    marked = high_outliers(b, "file_id", "area")
    inner = b.select("file_id", F.col("region_id").alias("inner_id"), F.col("b").alias("i"))
    holds = box_join(marked.where("is_outlier").select("file_id", "region_id", "b"), inner, "b", "i", 200.0, (F.col("inner_id") != F.col("region_id")) & G.box_contains(F.col("b"), F.col("i")), keys=("file_id",))
    return marked.join(holds.select("region_id").distinct(), "region_id", "left_anti").select("region_id")


@query(drawing_sql("regions") + """, p AS (SELECT * FROM regions WHERE layer = '1-URGENT' AND layout_id = 1), s AS (SELECT * FROM regions WHERE layer <> '1-URGENT')
SELECT s.region_id, 'sub-region' AS class FROM s WHERE EXISTS (SELECT 1 FROM p WHERE s.x0 <= p.x0 + p.w AND s.x0 + s.w >= p.x0 AND s.y0 <= p.y0 + p.h AND s.y0 + s.h >= p.y0)
UNION ALL SELECT region_id, 'general drawing' FROM p""")
def q7_routed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General drawings as they are; sub-regions only within a known parent."""
    from planwright.operators.spatial import box_semi_join

    r = drawing(spark, sf_dir, "regions").withColumn("box", G.ring_box(ring()))
    parents = r.where("layer = '1-URGENT' and layout_id = 1")
    subs = box_semi_join(r.where("layer <> '1-URGENT'").select("region_id", "box"), parents.select(F.col("box").alias("p")), "region_id", "box", "p", 32.0)
    return subs.select("region_id", F.lit("sub-region").alias("class")).unionByName(parents.select("region_id", F.lit("general drawing").alias("class")))


_ITEMS = drawing_sql("regions", "defects") + """, e AS (SELECT layout_id, max(x0) + 1 AS far FROM regions GROUP BY 1),
i AS (SELECT layout_id, CAST(floor(16 * x0 / far) AS BIGINT) AS chunk_id, min(x0) AS a, min(y0) AS b, max(x0 + w) AS c, max(y0 + h) AS d FROM regions JOIN e USING (layout_id) GROUP BY ALL),
l AS (SELECT layout_id, (max(c) - min(a)) * (max(d) - min(b)) AS whole FROM i GROUP BY 1), t AS (SELECT layout_id, chunk_id, (c - a) * (d - b) / whole >= 0.85 OR (c - a) * (d - b) < 25 AS skipped FROM i JOIN l USING (layout_id)),
f AS (SELECT d.id, d.layout_id, d.chunk_id, d.type, CASE WHEN lower(severity) IN ('low', 'medium', 'high') THEN lower(severity) ELSE 'low' END AS severity FROM defects d JOIN t USING (layout_id, chunk_id) WHERE NOT skipped)"""


def defect_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(work items with ``skipped``, the defects that were found in those that are looked at); sixteen strips of a layout are its chunks."""
    box = G.box(F.min("b.min_x"), F.min("b.min_y"), F.max("b.max_x"), F.max("b.max_y"))
    regions = drawing(spark, sf_dir, "regions")
    far = regions.groupBy("layout_id").agg((F.max("x0") + 1).alias("far"))
    strip = F.floor(16 * F.col("x0") / F.col("far")).alias("chunk_id")
    chunks = regions.join(far, "layout_id").select("layout_id", strip, G.ring_box(ring()).alias("b")).groupBy("layout_id", "chunk_id").agg(box.alias("b"))
    whole = chunks.groupBy("layout_id").agg(G.box_area(box).alias("whole"))
    area = G.box_area(F.col("b"))
    # fixed values: a crop of nearly the whole layout, and one of hardly any pixel, are not looked at
    items = chunks.join(whole, "layout_id").select("layout_id", "chunk_id", ((area / F.col("whole") >= 0.85) | (area < 25)).alias("skipped"))
    severity = F.when(F.lower("severity").isin("low", "medium", "high"), F.lower("severity")).otherwise("low")
    found = drawing(spark, sf_dir, "defects").join(items.where("not skipped"), ["layout_id", "chunk_id"]).select("id", "layout_id", "chunk_id", "type", severity.alias("severity"))
    return items, found


@query(_ITEMS + """ SELECT layout_id, chunk_id, id, type, severity, 'D' || row_number() OVER (PARTITION BY layout_id ORDER BY chunk_id, id) AS defect_id FROM f""")
def q22_defects_of_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defects of the items that are looked at, numbered through each layout."""
    items, found = defect_items(spark, sf_dir)
    runs = sorted_runs(found, ["layout_id", "chunk_id", "id"], "defects")
    spans = runs_of_groups(runs, ["layout_id"]).select("_run", "layout_id", "_shift")
    number = (F.col("_place") + F.col("_shift") + 1).cast("string")
    return runs.join(spans, ["_run", "layout_id"]).select("layout_id", "chunk_id", "id", "type", "severity", F.concat(F.lit("D"), number).alias("defect_id"))


@query(_ITEMS + """, g AS (SELECT layout_id, count(*) AS items, count(*) FILTER (skipped) AS skipped FROM t GROUP BY 1), h AS (SELECT layout_id, count(*) AS defects, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(DISTINCT chunk_id) AS chunks,
max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS worst FROM f GROUP BY 1) SELECT layout_id, items, skipped, coalesce(defects, 0) AS defects, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(chunks, 0) AS chunks, worst FROM g LEFT JOIN h USING (layout_id)""")
def q22_q23_defect_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A defect run's report for each layout: work items, those skipped, defects by severity, chunks with any."""
    items, found = defect_items(spark, sf_dir)
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    told = found.groupBy("layout_id").agg(F.count("*").alias("defects"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.count_distinct("chunk_id").alias("chunks"), F.max(rank).alias("worst"))
    done = items.groupBy("layout_id").agg(F.count("*").alias("items"), F.count_if("skipped").alias("skipped"))
    none = F.lit(0).cast("long")
    return done.join(told, "layout_id", "left").select("layout_id", "items", "skipped", *(F.coalesce(c, none).alias(c) for c in ("defects", "high", "medium", "chunks")), "worst")


@query(drawing_sql("entities") + ", h AS (SELECT file_id, CAST(floor(x / 50) AS BIGINT) AS bin, count(*) AS n FROM entities GROUP BY ALL) SELECT file_id, round(median(n), 6) AS mid, round(quantile_cont(n, 0.95), 6) AS p95 FROM h GROUP BY 1")
def g28_w3_histogram_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of occupied bins, from which slots take their thresholds."""
    h = drawing(spark, sf_dir, "entities").groupBy("file_id", F.floor(F.col("x") / 50).alias("bin")).agg(F.count("*").alias("n"))
    return h.groupBy("file_id").agg(F.round(F.percentile("n", 0.5), 6).alias("mid"), F.round(F.percentile("n", 0.95), 6).alias("p95"))


def line_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, whole, plan, strip): each drawing's area, and how much its lines look like a plan and like a strip."""
    s = shapes.segments(spark, sf_dir)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ends = s.groupBy("file_id").agg(F.least(F.min("x1"), F.min("x2")).alias("a"), F.least(F.min("y1"), F.min("y2")).alias("b"), F.greatest(F.max("x1"), F.max("x2")).alias("c"), F.greatest(F.max("y1"), F.max("y2")).alias("d"))
    told = ends.join(shapes.g26_line_statistics(spark, sf_dir), "file_id")
    w, h = F.col("c") - F.col("a"), F.col("d") - F.col("b")
    plan, strip = priors(F.greatest(w, h) / F.greatest(F.lit(1e-9), F.least(w, h)), F.col("orthogonal"), F.lit(0.0), F.col("entropy") / F.ln(F.lit(9.0)), F.lit(0.0), F.lit(1.0))
    return told.select("file_id", (w * h).alias("whole"), plan.alias("plan"), strip.alias("strip"))


def scale_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's components at three scales the score; of all labels."""
    seeds = shapes.label_seeds(spark, sf_dir)
    boxes = occupancy.boxes_at_seeds(shapes.pyramid(spark, sf_dir).drop("n"), seeds.select("seed_id", "file_id", "x", "y"), "seed_id", ["file_id"]).join(line_priors(spark, sf_dir), "file_id")
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    boxes = boxes.withColumn("bonus", aspect_bonus(F.greatest(w / h, h / w), F.col("plan"), F.col("strip"))).drop("plan", "strip", "cells")
    lines = drawing(spark, sf_dir, "entities").where("type = 'LWPOLYLINE'").select("file_id", "x", "y")
    return finders.scored(boxes, seeds, lines, ["file_id"], 500.0)


@query()
def k12_scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores of the candidates of all labels of each drawing."""
    return scale_candidates(spark, sf_dir).select("seed_id", "scale", "labels", "structured", F.round("score", 6).alias("score"))


@query()
def q4_scaled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels -> components at three scales -> composite rank -> what is nearest to the label -> suppression -> filter with relaxation -> order by density."""
    found = staged(scale_candidates(spark, sf_dir), "candidates")
    seeds, p = shapes.label_seeds(spark, sf_dir), staged(shapes.centres(spark, sf_dir).withColumn("id", F.monotonically_increasing_id()), "points")
    anchors = seeds.select("file_id", F.col("seed_id").alias("anchor"), "x", "y")
    near = nearest_points(p, anchors, "id", "anchor", 256.0, keys=("file_id",)).where("anchor is not null").select("id", F.col("anchor").alias("seed_id"))
    drawn = finders.partitioned(found, p.join(near.hint("merge"), "id").select("seed_id", "x", "y"), 20.0)
    kept = finders.kept_best(drawn.select("seed_id", "file_id", "scale", "score", "structured", "fill", *finders.EDGES), [F.desc("score"), F.desc("structured"), F.desc("fill")], 0.6, 3)
    good = finders.sound(finders.counted(kept, p, ["file_id"], 500.0), 60, 0.35, 5.0, relax=True)
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("density"), F.desc("n"), F.abs(F.col("aspect") - 1.6), "area", "rank"))
    return good.withColumn("place", place).select("seed_id", "file_id", "place", "scale", "n", F.round("score", 6).alias("score"), *(F.round(c, 4).alias(c) for c in finders.EDGES))
