from pyspark.sql import functions as F

from planwright.plans import registry, shapes

SF = "/root/testdata/sf0.001"


def test_all_labels_have_candidates(spark):
    """Drawings with more than ten labels too."""
    want = {r.seed_id for r in registry.QUERIES["r12_seed_fill"](spark, SF).collect()}
    got = {r.seed_id for r in registry.QUERIES["q4_scaled_matches"](spark, SF).collect()}
    per = shapes.label_seeds(spark, SF).groupBy("file_id").count().agg(F.max("count")).first()[0]
    assert got == want and per > 10
