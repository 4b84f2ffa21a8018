"""What a query costs, as Spark counts it."""

from __future__ import annotations


def shuffled(spark, run) -> int:
    """Rows that are written to shuffles while ``run`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()
    empty = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def rows() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, empty, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    run()
    return rows() - before
