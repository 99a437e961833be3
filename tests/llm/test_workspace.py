"""The driver's memory between writes."""

from lodestone.llm import workspace


def heap(spark):
    runtime = spark._jvm.Runtime.getRuntime()
    return runtime.totalMemory() - runtime.freeMemory()


def test_a_write_gives_the_drivers_garbage_back(spark, monkeypatch):
    space = workspace.Workspace(spark, "tidy")
    monkeypatch.setattr(workspace, "_tidied", 0.0)
    spark._jvm.java.util.ArrayList(spark._jvm.java.util.Collections.nCopies(30_000_000, None))
    full = heap(spark)
    written = space.write(spark.range(10).toDF("x"), "numbers")
    assert heap(spark) < full - 50_000_000 and written.count() == 10
    # not after each of many short writes
    before = workspace._tidied
    space.write(spark.range(10).toDF("x"), "again")
    assert workspace._tidied == before or workspace._tidied - before >= workspace.TIDY_S
