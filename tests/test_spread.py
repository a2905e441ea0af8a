"""Tasks that derive tables keep their size as the table grows."""

from hexalane.sources import fixtures


def test_more_rows_are_more_partitions(spark, data, monkeypatch):
    table = spark.read.parquet(f"{data}/orders.parquet")
    monkeypatch.setattr(fixtures, "ROWS", 100)
    assert fixtures._spread(table).rdd.getNumPartitions() == -(-table.count() // 100)
    assert fixtures._spread(table).count() == table.count()


def test_tasks_grow_with_the_rows_and_not_with_the_session(spark, data, monkeypatch):
    """Audits, children of races and ticks meet in tasks of so many rows, however few bytes they are."""
    from hexalane.operators import spread
    from hexalane.queries import QUERIES

    monkeypatch.setattr(spread, "ROWS", 400)
    n = -(-6 * spark.read.parquet(f"{data}/orders.parquet").count() // 400)
    assert spread.tasks(spark, 400 * 50) == 50 and spread.dealt(spark.range(9), None, "id").rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    for name, kind in (("audit_b", "REPARTITION_BY_NUM"), ("normalize_children", "REPARTITION_BY_NUM"), ("integrity_check", "REPARTITION_BY_NUM"), ("race_structure", "REPARTITION_BY_NUM")):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert any(f", {n}), {kind}" in line for line in plan.splitlines()), name


def test_what_is_derived_from_a_row_is_aggregated_where_it_is(spark, data):
    """The boats of a race come from one row, dealt by its key: they become a wide row without another shuffle."""
    from hexalane.functions import kernels
    from hexalane.sources.fixtures import fixture

    wide = kernels.wide(fixture(spark, data, "race_entry").select("race_id", "boat_number", "avg_st", "grade_class"))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(o_orderkey" in plan
    assert wide.count() == spark.read.parquet(f"{data}/orders.parquet").count()
