"""Drawing tables derived from the warehouse tables by integer arithmetic, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planwright.sources.tables import table

#: name -> (table, filter, columns). ``//`` is integer division.
DERIVED: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "regions": ("orders", None, {
        "region_id": "o_orderkey", "file_id": "o_orderkey % 4", "layout_id": "(o_orderkey // 4) % 8", "chunk_id": "(o_orderkey // 32) % 16",
        "x0": "CAST(o_custkey * 10 AS DOUBLE)", "y0": "CAST((o_orderkey * 37) % 5000 AS DOUBLE)",
        "w": "CAST(1 + o_orderkey % 17 AS DOUBLE)", "h": "CAST(1 + o_orderkey % 13 AS DOUBLE)", "layer": "o_orderpriority",
    }),
    "entities": ("part", None, {
        "entity_id": "p_partkey", "file_id": "p_partkey % 4",
        "type": "CASE p_size % 5 WHEN 0 THEN 'LINE' WHEN 1 THEN 'LWPOLYLINE' WHEN 2 THEN 'CIRCLE' WHEN 3 THEN 'TEXT' ELSE 'INSERT' END",
        "layer": "p_brand", "text": "p_name", "x": "CAST((p_partkey * 13) % 4000 AS DOUBLE)", "y": "CAST((p_partkey * 29) % 4000 AS DOUBLE)", "radius": "CAST(p_size AS DOUBLE)",
    }),
    "edges": ("orders", "o_orderkey % 5 = 0 AND o_custkey <> (o_custkey // 10) * 10 + (o_custkey + 1 + o_orderkey % 3) % 10", {
        "src": "least(o_custkey, (o_custkey // 10) * 10 + (o_custkey + 1 + o_orderkey % 3) % 10)",
        "dst": "greatest(o_custkey, (o_custkey // 10) * 10 + (o_custkey + 1 + o_orderkey % 3) % 10)",
    }),
    "chunk_vectors": ("embeddings", None, {"layout_id": "CAST(label AS BIGINT)", "chunk_id": "vec_id", "embedding": "embedding"}),
    "defects": ("events", None, {
        "id": "event_id", "type": "event_type", "severity": "CASE event_type WHEN 'error' THEN 'High' WHEN 'purchase' THEN 'Medium' WHEN 'view' THEN 'low' ELSE 'Unknown' END",
        "layout_id": "user_id % 8", "chunk_id": "event_id % 16", "description": "props",
    }),
    "memory": ("events", None, {
        "id": "event_id", "file_path": "user_id", "query_keyword": "event_type", "classification": "CASE WHEN event_id % 3 = 0 THEN 'general drawing' ELSE 'sub-region' END",
        "min_x": "CAST(event_id % 500 AS DOUBLE)", "created_at": "ts",
    }),
    "annotations": ("documents", None, {
        "id": "doc_id", "text": "text", "x": "CAST((doc_id * 17) % 40000 AS DOUBLE)", "y": "CAST((doc_id * 31) % 9000 AS DOUBLE)", "layer": "source",
    }),
    "agent_events": ("events", None, {"id": "event_id", "type": "event_type", "run_id": "user_id % 2", "layout_id": "user_id % 8", "data": "props", "ts": "ts"}),
}


def drawing(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name``; ``edges`` are distinct."""
    source, where, columns = DERIVED[name]
    rows = table(spark, sf_dir, source)
    if where:
        rows = rows.where(where.replace("//", "div"))
    out = rows.selectExpr(*(f"{e.replace('//', 'div')} AS `{c}`" for c, e in columns.items()))
    return out.distinct() if name == "edges" else out


def drawing_sql(*names: str) -> str:
    """``WITH`` and the derived tables of these names, for an engine with ``//``."""
    out = []
    for n in names:
        source, where, columns = DERIVED[n]
        distinct = "DISTINCT " if n == "edges" else ""
        out.append(f"{n} AS (SELECT {distinct}" + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}" + (f" WHERE {where}" if where else "") + ")")
    return "WITH " + ", ".join(out)
