"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. ``sf_dir`` gives the labels that the toxicity stage learns from.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm import packing, quality, simhash, suffixdedup, toxicity
from planwright.sources.tables import table
from planwright.staging import discard, staged


#: Fifty words of three letters and the space after each: repeats that are shorter are no passage.
PASSAGE_BYTES = 200


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: null, empty and wordless texts with them. Texts are judged whole, equal ones alike."""
    return quality.judge_quality(docs).where("quality_keep").select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go. Null and empty texts stay; texts are scored whole, equal ones alike; ids may be null or repeat."""
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one row stays: the one with the least id (null last), then the least hash of its text (null last).

    Ids and texts may repeat or be null: of rows equal in both, one with the least hash of all its columns stays, so what stays doesn't
    depend on how rows are dealt to tasks. Null, empty and wordless texts are near-duplicates of each other. Very long texts count whole.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    whole = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in of.items())).alias("row"))
    rows = staged(whole.withColumn("number", F.monotonically_increasing_id()), "rows")
    text, doc = F.col("row")[of["text"]], F.col("row")[of["doc_id"]]
    found = staged(simhash.near_duplicates(rows.select("number", text.alias("text")), "number").select("number", F.col("component_id").alias("group")), "groups")
    first = F.struct(doc.isNull(), doc, text.isNull(), F.xxhash64(text), F.xxhash64(F.to_json("row")), "number")
    order = rows.select("number", first.alias("first"))
    stays = staged(order.join(found, "number").groupBy("group").agg(F.min("first")["number"].alias("number")), "stays")
    discard(found)
    return rows.join(stays, "number", "left_semi").select(*(F.col("row")[n].alias(c) for c, n in of.items()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go; documents of which nothing is left go too. Null texts come back empty, empty ones as they are; of a repeated long text nothing is left."""
    left = suffixdedup.remove_repeats(docs, length=PASSAGE_BYTES, with_text=True)
    changed = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
    return changed.where("n_removed = 0 or n_removed < n_bytes").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each row's text (null: empty) and its end mark. Rows may repeat; a very long text has as many pieces as it takes."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("toxicity", keep_clean), ("near-dedup", keep_one_of_each), ("suffix-dedup", cut_repeats), ("packing", pack)]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
