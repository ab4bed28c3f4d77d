"""How often an operator reads its source, counted over all jobs it runs."""

import pytest
from builders import SF
from pyspark.sql import functions as F
from tidemark.operators import alerts, enrich, joins, keyed, metrics, patterns, search, windows
from tidemark.sources import adapters


def scans_since(spark, first):
    """Executed reads of the events table: a scan that never ran has no metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    total, runs = 0, store.executionsList()
    for i in range(first, runs.size()):
        run = runs.apply(i)
        values = store.executionMetrics(run.executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if node.name().startswith("Scan parquet") and "events.parquet" in node.desc():
                ids = [node.metrics().apply(m) for m in range(node.metrics().size())]
                ran = [m for m in ids if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
                total += bool(ran)
    return total


def executed(spark):
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsList().size()


OPERATORS = {
    "sessions": (1, lambda s: keyed.sessions(adapters.user_events(s, SF))),
    "gap_sessions": (1, lambda s: keyed.gap_sessions(adapters.user_events(s, SF), "userId")),
    "rapid_change": (1, lambda s: keyed.rapid_change(adapters.sensors(s, SF))),
    "data_gaps": (1, lambda s: keyed.data_gaps(adapters.sensors(s, SF), "8 hours")),
    "offline": (1, lambda s: keyed.offline(adapters.sensors(s, SF), "8 hours")),
    "velocity_count": (1, lambda s: keyed.velocity_count(adapters.transactions(s, SF))),
    "running_stats": (1, lambda s: keyed.running_stats(adapters.user_events(s, SF), "eventType")),
    "zscore": (1, lambda s: keyed.zscore_alerts(adapters.sensors(s, SF))),
    "count_batches": (1, lambda s: keyed.count_batches(adapters.sensors(s, SF))[1]),
    "asof": (2, lambda s: joins.asof_join(adapters.transactions(s, SF), adapters.user_events(s, SF), "userId", "event", "eventId")),
    "instant_rate": (1, lambda s: metrics.instant_rate(adapters.sensors(s, SF), ["sensorId"], "ts", "value")),
    "sustained": (1, lambda s: metrics.sustained(adapters.sensors(s, SF), ["sensorId"], "ts", F.col("value") > 10, "1 hour", "readingId")),
    "trend": (1, lambda s: windows.sensor_trend(adapters.sensors(s, SF))),
    "velocity": (1, lambda s: patterns.velocity(adapters.transactions(s, SF))),
    "structuring": (1, lambda s: patterns.structuring(adapters.transactions(s, SF))),
    "country_change": (1, lambda s: patterns.country_change(adapters.transactions(s, SF))),
    "fraud_alerts": (1, lambda s: alerts.fraud_alerts(adapters.transactions(s, SF))),
    "risk_score": (1, lambda s: enrich.risk_score(adapters.transactions(s, SF))),
    "order_violations": (1, lambda s: search.order_violations(adapters.sensors(s, SF), "sensorId", "readingId", "readingId")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_two_reads_of_each_input(spark, both, name):
    """Once to count rows per key, once to place or to work on them; sliced or not."""
    inputs, build = OPERATORS[name]
    before = executed(spark)
    build(spark).collect()
    assert scans_since(spark, before) == 2 * inputs


def test_the_counting_reads_two_columns(spark, both):
    """The count per key takes the key and the time from the files, and nothing else."""
    before = executed(spark)
    keyed.data_gaps(adapters.sensors(spark, SF), "8 hours").collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    plan = store.executionsList().apply(before).physicalPlanDescription()
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas and not [s for s in schemas if "value" in s]
