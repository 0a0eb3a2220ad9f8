"""One query for each operator of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm import bpe, clustering, langid, manifest, media, packing, quality, resharding, simhash, suffixdedup, topk, toxicity, urlfilter
from planwright.sources.tables import table

#: The rules of op2: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_copies(media.render_vectors(table(spark, sf_dir, "embeddings")), "vec_id", "media")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs).select("doc_id", "quality_posterior", "quality_score", "quality_keep")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixdedup.remove_repeats(docs, with_text=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout: sixteen shards by the source, so the largest source makes one shard large; eight shards are added."""
    old = F.crc32(F.coalesce("source", F.lit(""))) % 16
    return resharding.reshard(table(spark, sf_dir, "documents"), old, shards=24)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_toxicity, op4_top_k, op5_byte_bpe, op6_image_copies, op7_quality, op8_packing, op9_suffix_dedup, op10_simhash, op11_manifest, op12_resharding, op13_clustering)}


_OP2 = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


_OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _manifest_sql(levels: int = 6) -> str:
    """``levels`` of 16 children for each tree (a tree that ends sooner stays as it is)."""
    digest = lambda text: "sha256(" + " || ".join(f"(CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END)" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, {bit})), 4294967295)"
    out = [
        f"read AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small, {crc} % 5 = 0 AS hit FROM documents)",
        f"leaf AS (SELECT doc_id, source, {digest('text')} AS leaf, CASE WHEN hit AND text IS NOT NULL THEN {digest('small')} ELSE {digest('text')} END AS shown FROM read)",
        "a0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM leaf)",
    ]

    def tree(a: str) -> None:
        for k in range(levels):
            near = "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN "
            out.append(f"{a}s{k} AS (SELECT tree, i, n = 1 AS alone, coalesce(string_agg(node, '') {near}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') {near}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{k})")
            out.append(f"{a}{k + 1} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node FROM {a}{k} GROUP BY tree, i // 16, n)")

    tree("a")
    out.append(f"b0 AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, node FROM a{levels})")
    tree("b")
    side = lambda a, k: f"CASE WHEN {a}s{k}.alone THEN '' ELSE {a}s{k}.l || {a}s{k}.r END"
    steps = [(a, k) for a in "ab" for k in range(levels)]
    joins = " ".join(f"JOIN {a}s{k} ON " + (f"{a}s{k}.tree = a0.tree AND {a}s{k}.i = a0.i // {16**k}" if a == "a" else f"{a}s{k}.i = a0.tree // {16**k}") for a, k in steps)
    sides = ", ".join(f"{a}s{k}.alone AS z{a}{k}, {a}s{k}.l AS l{a}{k}, {a}s{k}.r AS r{a}{k}" for a, k in steps)
    out.append(f"f0 AS (SELECT a0.doc_id, a0.source, a0.tree, a0.leaf, a0.shown AS f, sha256({' || '.join(side(a, k) for a, k in steps)}) AS proof, {sides} FROM a0 {joins})")
    for step, (a, k) in enumerate(steps):
        out.append(f"f{step + 1} AS (SELECT * REPLACE (CASE WHEN z{a}{k} THEN f ELSE sha256(l{a}{k} || f || r{a}{k}) END AS f) FROM f{step})")
    return f"""WITH {", ".join(out)}
SELECT f.doc_id, f.source, f.leaf, a{levels}.node AS subroot, b{levels}.node AS root, f.proof AS proof_sha256, f.f AS folded_root, f.f = b{levels}.node AS verified
FROM f{len(steps)} f JOIN a{levels} ON a{levels}.tree = f.tree CROSS JOIN b{levels}"""


def _clusters_sql(rounds: int = 3) -> str:
    out = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, e FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for k in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        out.append(f"d{k} AS (SELECT vec_id, v.e, cluster, CAST({far} AS BIGINT) AS distance FROM v CROSS JOIN c{k} c)")
        out.append(f"a{k} AS (SELECT vec_id, e, cluster, distance FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if k < rounds:
            out.append(f"u{k} AS (SELECT cluster, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM a{k})")
            out.append(f"m{k} AS (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{k} GROUP BY ALL)")
            out.append(f"n{k} AS (SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY pos) AS e FROM m{k} GROUP BY cluster)")
            out.append(f"c{k + 1} AS (SELECT c.cluster, coalesce(n.e, c.e) AS e FROM c{k} c LEFT JOIN n{k} n USING (cluster))")
    return f"""WITH {", ".join(out)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _OP2, "op4_top_k": _OP4, "op11_manifest": _manifest_sql(), "op13_clustering": _clusters_sql()}
