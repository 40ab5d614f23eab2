"""Views that Spark builds by itself, against their SQL; keys of large tables."""

import re

from pyspark.sql import functions as F

from sheetmill.plans import fixtures


def by_sql(spark, sf, name):
    return fixtures.run_sql(spark, sf, fixtures.VIEWS[name])


def test_built_views_hold_the_rows_of_their_sql(spark, sf):
    for name in fixtures.BUILT:
        built, plain = fixtures.read(spark, sf, name), by_sql(spark, sf, name)
        assert [(f.name, f.dataType) for f in built.schema] == [(f.name, f.dataType) for f in plain.schema]
        assert built.exceptAll(plain).isEmpty() and plain.exceptAll(built).isEmpty()


def test_device_parameters_send_no_parts_to_all_tasks_and_read_lines_once(spark, sf):
    plan = fixtures.read(spark, sf, "fx_device_params").groupBy("group_id", "device").agg(F.max("value"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert len(re.findall(r"FileScan parquet", plan)) == 2
