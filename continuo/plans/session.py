"""Session settings that the plans need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A union that claims its children's partitioning fails at run time where the adaptive planner coalesces them
#: differently ("Can't zip RDDs with unequal numbers of partitions"); without the claim it is dealt anew.
_SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}


def steady(spark: SparkSession) -> SparkSession:
    for name, value in _SETTINGS.items():
        if spark.conf.get(name, value) != value:
            spark.conf.set(name, value)
    return spark
