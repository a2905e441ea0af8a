"""The analysis of races stores between its stages only what a later one reads."""

import glob

from hexalane.queries.analysis import _analysed, _store


def test_stored_rows_are_narrow(spark, data):
    root = _store(spark).replace("file:", "").rstrip("/")
    before = set(glob.glob(f"{root}/rebuilt-*"))
    _analysed(spark, data)
    fields = [{f.name: [x.name for x in f.dataType.fields] for f in spark.read.parquet(path).schema if f.name in ("b1", "b2", "b6")} for path in set(glob.glob(f"{root}/rebuilt-*")) - before]
    assert sorted(len(f) for f in fields) == [1, 3]
    for own in fields:
        assert not any(c.startswith(("term_", "series_")) for names in own.values() for c in names)
        assert len(own.get("b6", [])) <= 4
