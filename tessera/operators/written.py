"""Tables written between the steps of an operator, where all machines can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.files import scratch


class Steps:
    """A folder of numbered tables; ``keep`` writes one and reads it back, ``drop`` deletes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.made = spark, scratch(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        context = self.spark.sparkContext
        for t in tables:
            path = context._jvm.org.apache.hadoop.fs.Path(t._step)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
