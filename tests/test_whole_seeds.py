from planwright.plans import registry, shapes
from planwright.sources.drawings import drawing

SF = "/root/testdata/sf0.001"


def test_seeds_are_all_labels(spark):
    labels = {r.entity_id for r in drawing(spark, SF, "entities").where("type = 'TEXT'").collect()}
    assert {r.seed_id for r in shapes.label_seeds(spark, SF).collect()} == labels
    # a coarse cell is near every label here, so each has a row
    found = registry.QUERIES["r12_seed_fill"](spark, SF).collect()
    assert {r.seed_id for r in found} <= labels and len({r.seed_id for r in found}) > len(labels) / 2
