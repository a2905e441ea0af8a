"""Pages are written and parsed once a row, in as many tasks as there are cores."""

import pytest

from hexalane.queries import QUERIES


@pytest.mark.parametrize("name, mark", [("parse_racelist", "title16_x"), ("parse_beforeinfo", "table1_boatImage1Number is-type"), ("parse_resultdetail", "<th>レースタイム</th>"), ("series_year_infer", '<ul class="tab2 is-type1">')])
def test_page_is_written_once(spark, data, name, mark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count(mark) == 1


def test_pages_are_read_in_many_tasks(spark, data):
    """A shuffle of few bytes is not drawn together before the costly step."""
    assert QUERIES["parse_resultdetail"](spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
