"""Merkle dataset manifest: hash trees of 16 children over the rows of each source, and one over the sources.

The nodes are kept outside memory. Leaves are sorted into runs; every level is a Parquet folder of nodes with their
coordinates (tree, level, place) and their children's digests, made by reading the level below. Proofs are put together from
the top down: each level is merged by coordinate with the paths of the level above it, so a path is made once for
all that is below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwright.operators.ordering import runs_of_groups, sorted_runs, with_row_number
from planwright.staging import new_folder, staged, written

FAN = 16
SIDES = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def joined(children: Column) -> Column:
    return F.array_join(children, "")


class Tree:
    """The levels of many trees in one folder; a node's coordinates are ``tree``, level and ``place``, ``total`` is its level's count."""

    def __init__(self, leaves: DataFrame, path: str) -> None:
        """``leaves``: tree, place (gapless from 0 in each tree), total, node and whatever else; they become level 0."""
        self.levels = [written(leaves, f"{path}/level=0")]
        most = self.levels[0].agg(F.max("total")).first()[0] or 0
        while most > 1:
            low = self.levels[-1].where("total > 1")
            up = F.floor(F.col("place") / FAN)
            child = F.struct((F.col("place") % FAN).alias("at"), "node")
            groups = low.groupBy("tree", up.alias("place"), F.ceil(F.col("total") / FAN).alias("total")).agg(F.sort_array(F.collect_list(child)).alias("c"))
            nodes = groups.select("tree", "place", "total", F.transform("c", lambda x: x["node"]).alias("children"))
            self.levels.append(written(nodes.withColumn("node", F.sha2(joined(F.col("children")), 256)), f"{path}/level={len(self.levels)}"))
            most = -(-most // FAN)

    def tops(self) -> DataFrame:
        """(tree, level, node) of each tree's one highest node."""
        found = [n.where("total = 1").select("tree", F.lit(k).alias("level"), "node") for k, n in enumerate(self.levels)]
        out = found[0]
        for x in found[1:]:
            out = out.union(x)
        return out

    def families(self, above: DataFrame) -> DataFrame:
        """(tree, family, children, path, the rest of ``above``): the lowest nodes over leaves, each with the path from it up.

        ``above``: tree, level (of the tree's highest node), path (from there upwards) and whatever else. A lone leaf has null
        children and family 0. A leaf's family is its place divided by the fan.
        """
        rest = [c for c in above.columns if c not in ("tree", "level", "path")]
        here = None
        for k in range(len(self.levels) - 1, 0, -1):
            top = above.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("place"), "path", *rest)
            here = top if here is None else here.unionByName(top)
            here = self.levels[k].select("tree", "place", "children").hint("merge").join(here, ["tree", "place"])
            if k > 1:
                down = here.select("tree", "place", "children", "path", *rest, F.posexplode("children").alias("at", "own"))
                here = down.select("tree", (F.col("place") * FAN + F.col("at")).alias("place"), longer(F.col("children"), F.col("at"), F.col("path")).alias("path"), *rest)
        lone = above.where("level = 0").select("tree", F.lit(0).cast("long").alias("place"), F.lit(None).cast("array<string>").alias("children"), "path", *rest)
        out = lone if here is None else here.unionByName(lone)
        return out.withColumnRenamed("place", "family")


def longer(children: Column, at: Column, path: Column) -> Column:
    """``path`` with the siblings of child ``at`` before it."""
    sides = F.struct(joined(F.slice(children, F.lit(1), at)).alias("left"), joined(F.slice(children, at + 2, F.lit(FAN))).alias("right"))
    return F.concat(F.array(sides), path)


def leaf_paths(tree: Tree, above: DataFrame, columns: list[str]) -> DataFrame:
    """The leaves' tree, place and ``columns`` with their path and what else ``above`` has."""
    leaves = tree.levels[0].select("tree", "place", F.floor(F.col("place") / FAN).alias("family"), *columns)
    out = leaves.hint("merge").join(tree.families(above), ["tree", "family"])
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(longer(F.col("children"), (F.col("place") % FAN).cast("int"), F.col("path")))
    return out.withColumn("path", path).drop("children", "family")


def fold(start: Column, path: Column) -> Column:
    """The digest that ``start`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, start, lambda a, x: F.sha2(F.concat(x["left"], a, x["right"]), 256))


def tampered_leaf(docs: DataFrame) -> Column:
    """What a reader would find: where 5 divides the id's crc32, the text with A-Z in lower case."""
    own = {c: F.col(c) for c in FIELDS}
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)) & F.col("text").isNotNull()
    return F.when(hit, leaf_digest(own | {"text": small}))


def build(docs: DataFrame, presented: Column | None = None, path: str | None = None) -> tuple[Tree, Tree, DataFrame]:
    """(trees of the sources' leaves, tree of the sources, table of sources); its nodes are written under ``path``.

    ``presented``: the digest of each leaf as it is presented for proof, null where it is the original.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "manifest")
    leaf = leaf_digest({c: F.col(c) for c in FIELDS})
    shown = F.lit(None).cast("string") if presented is None else presented
    digests = staged(docs.select("doc_id", "source", leaf.alias("leaf"), shown.alias("presented")), "leaves")
    runs = sorted_runs(digests, ["source", "doc_id", "leaf"], "leaf-runs")
    spans = staged(runs_of_groups(runs, ["source"]), "spans")
    sources = with_row_number(spans.groupBy("source").agg(F.max("_total").alias("total")), ["source"], "tree")
    sources = staged(sources.select(F.col("source").alias("_source"), F.col("tree").cast("long").alias("tree")), "sources")
    spans = spans.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("_run").alias("_r"), "_source", "tree", F.col("_total").alias("total"), "_shift")
    placed = runs.join(spans, (F.col("_run") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_source")))
    leaves = Tree(placed.select("tree", (F.col("_place") + F.col("_shift")).alias("place"), "total", F.col("leaf").alias("node"), "doc_id", "presented"), f"{path}/leaves")
    count = sources.count()
    over = Tree(leaves.tops().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("total"), "node"), f"{path}/sources")
    return leaves, over, sources


def manifest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source.

    A leaf is the digest of doc_id, source, lang, n_chars and text (nulls count as ``-``, other columns don't). Leaves ascend within their
    source by doc_id (null first) and then by digest, so repeated rows are leaves of their own beside each other. A null source is
    a source. Empty tables give no rows. Texts of any length are hashed whole. The only things that reach the driver are counts and the root.
    """
    leaves, over, sources = build(docs, tampered_leaf(docs), path)
    top = over.tops().first()
    if top is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string")
    nothing = F.array().cast(SIDES)
    ends = over.tops().select("tree", "level", nothing.alias("path"))
    up = leaf_paths(over, ends, ["node"]).select(F.col("place").alias("tree"), "path", F.col("node").alias("subroot"))
    above = staged(leaves.tops().select("tree", "level").join(up, "tree").join(sources.withColumnRenamed("_source", "source"), "tree"), "paths-of-sources")
    found = leaf_paths(leaves, above, ["node", "doc_id", "presented"])
    sides = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = fold(F.coalesce("presented", "node"), F.col("path"))
    out = found.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(top["node"]).alias("root"), F.sha2(sides, 256).alias("proof_sha256"), folded.alias("folded_root"), "source")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source")
