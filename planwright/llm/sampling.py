"""The held-out fold, and bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a longer text a sample has a passage of at most so many bytes, from a place that its hash gives; it is scored whole like any other.
SAMPLE_TEXT_BYTES = 65_536
#: The classes that a model learns, the most frequent first, so that its size is bounded.
MOST_CLASSES = 512


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learnable(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def passage(text_col: str, most_bytes: int) -> Column:
    """The text, or of one of over ``most_bytes`` bytes a passage within them."""
    wide = max(1, most_bytes // 4)
    spare = F.greatest(F.char_length(text_col) - wide, F.lit(1))
    cut = F.substring(F.col(text_col), F.pmod(F.xxhash64(text_col), spare).cast("int") + 1, F.lit(wide))
    return F.when(F.octet_length(text_col) <= most_bytes, F.col(text_col)).otherwise(cut)


def bounded_sample(rows: DataFrame, class_col: str, per_class: int, text_col: str, most_bytes: int = SAMPLE_TEXT_BYTES, most_classes: int = MOST_CLASSES) -> dict[object, list[str]]:
    """About ``per_class`` different texts of each class (never over half as many again), chosen by a hash of the text.

    One pass counts each class's different texts (by a sketch, within a few hundredths), one collects the drawn ones. Copies are drawn
    together and sent once, so neither a text that is repeated ever so often nor the size of the table adds to the sample.
    Null texts and classes aren't drawn. Of over ``most_classes`` classes those with the most texts are learned.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(class_col).isNotNull()).select(F.col(class_col).alias("class"), F.col(text_col).alias("text"))
    rows = rows.withColumn("draw", F.xxhash64("text"))
    counted = rows.groupBy("class").agg(F.approx_count_distinct("draw", 0.02).alias("n"))
    counts = {r[0]: r[1] for r in counted.orderBy(F.desc("n"), "class").limit(most_classes).collect()}
    if not counts:
        return {}
    scale = float(1 << 30)
    share = F.coalesce(*[F.when(F.col("class") == F.lit(c), F.lit(min(1.0, per_class / max(1, n)) * scale)) for c, n in counts.items()], F.lit(0.0))
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < share).groupBy("class", "draw").agg(F.min(passage("text", most_bytes)).alias("text"))
    found: dict[object, list[tuple[int, str]]] = {}
    for c, order, text in drawn.collect():
        found.setdefault(c, []).append((order % (1 << 30), text))
    return {c: [t for _, t in sorted(x)[: per_class + per_class // 2]] for c, x in sorted(found.items(), key=lambda x: str(x[0]))}
