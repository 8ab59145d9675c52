"""Queries of two signals make their pairs once: one join on the tag, and no join of pairs with pairs."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["combine_scores", "corroborated_score", "corroboration_sweep"])
def test_one_join_on_the_tag(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert sum("<> " in line or "NOT (q" in line for line in joins) == 1 and not [line for line in joins if "(c#" in line and "(q#" in line and "NOT" not in line]
