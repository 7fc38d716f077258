"""Made-up pages are parsed by all cores and once each, however small the table of keys."""

import pytest

from tests.conftest import SF_DIR
from websift.plans import madeup


@pytest.mark.parametrize("name", ["rule_cases", "passage_cases", "contact_cases", "shared_descriptions"])
def test_keys_are_dealt_over_the_cores(spark, name):
    plan = getattr(madeup, name)(spark, SF_DIR)
    assert "RoundRobinPartitioning" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["rule_cases", "contact_verdicts"])
def test_pages_are_parsed_once(spark, name):
    tracker = madeup.rule_cases(spark, SF_DIR) if name == "rule_cases" else madeup.contact_verdicts(spark, SF_DIR)
    assert tracker._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == (1 if name == "rule_cases" else 0)  # verdicts read a written table
