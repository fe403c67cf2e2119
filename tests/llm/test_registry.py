import pytest

from specloom.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", ["op4_near_dedup", "op8_suffix_dedup", "mixing_targets", "class_lm_base"])
def test_query_equals_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)
