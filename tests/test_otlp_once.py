"""An envelope is parsed once and its attributes are merged once, whatever the query reads of them."""

from galena import catalog


def test_each_envelope_is_parsed_and_merged_once(spark):
    for name in ("otlp_scalar_metrics", "otlp_aggregate_metrics", "otlp_logs", "otlp_spans"):
        plan = catalog.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, name
        assert plan.count("map_from_entries(") == 1, name
