"""Every registered query against its SQL, or against what it must keep to."""

import pytest
from helpers import SF, same_rows

from lawframe.plans import registry

WITHOUT_SQL = {"synthesize_laws", "render_literal", "render_story", "backparse_story"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_few_lack_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == WITHOUT_SQL


def test_stories_read_back(spark):
    rows = registry.QUERIES["backparse_story"](spark, SF).collect()
    assert rows and all(r["agrees"] for r in rows)


def test_no_cross_join(spark):
    for name in ("sample_pairs", "sample_stratified", "sample_balanced", "complexity_pair_join", "pending_tasks"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
