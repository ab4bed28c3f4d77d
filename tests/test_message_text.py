"""Messages made from the events: their text is made once, however often later steps use it."""

import pytest

from builders import SF
from tidemark.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["s3_p14_envelopes", "p1_parse_user_events", "p3_parse_transactions", "p5_parse_generic_envelope"])
def test_text_is_made_below_all_that_uses_it(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made = [line.lstrip(" :+-")[:8] for line in plan.splitlines() if "StructsToJson" in line]
    assert made and set(made) == {"Generate"}, plan
