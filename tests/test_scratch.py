"""Intermediate tables go when a scope ends; mixed and half-written artefacts are refused."""

import pytest

from casemesh.session import materialize, path_exists, scratch_path, scratch_scope
from casemesh.sources.index import check_stamp, stamp_index, stamp_of


def test_scope_removes_what_was_made_in_it(spark):
    before = scratch_path(spark, "kept")
    spark.range(3).write.parquet(before)
    with scratch_scope(spark):
        table = materialize(spark.range(5), "inside")
        inside = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.count() == 5
    assert path_exists(spark, before) and not path_exists(spark, inside)


def test_an_index_of_another_model_is_refused(spark, tmp_path):
    path = str(tmp_path / "index")
    check_stamp(spark, path, "a")
    stamp_index(spark, path, "a")
    assert stamp_of(spark, path) == "a"
    check_stamp(spark, path, "a")
    with pytest.raises(ValueError):
        check_stamp(spark, path, "b")
