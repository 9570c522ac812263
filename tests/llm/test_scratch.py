import os

from quarry.llm import scratch


def test_land_and_clear(spark):
    df = scratch.land(spark.range(5), "x")
    path = scratch._made[-1]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    scratch.clear(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not scratch._made
