"""Staged tables and checkpoints."""

from webobs import runtime


def test_stages_are_written_and_dropped(spark):
    runtime.drop_stages(spark)
    x = runtime.stage(spark.range(5))
    assert x.count() == 5 and runtime.cut(x).count() == 5
    assert runtime.drop_stages(spark) == 1 and runtime.drop_stages(spark) == 0
