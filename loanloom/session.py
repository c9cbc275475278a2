"""Session settings the jobs are written for.

On a cluster these go into ``spark-defaults`` or ``spark-submit --conf``; ``local_session`` applies them for tests,
benchmarks and small runs on one machine.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: merges small shuffle partitions, splits skewed join partitions, switches to broadcast joins
    # by the measured size of a shuffled side.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Without this every column function first sends its Python call site to the JVM, which takes longer than building
    # the whole plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "16g",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = (SparkSession.builder
               .master(f"local[{cores}]")
               .appName("loanloom")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores)))
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
