"""Connected components of a graph given by links, without gathering it anywhere."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Spark removes the shuffle files of a query when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: HotSpot never compiles a larger method; beyond this size Spark makes several, see session.tune.
METHODS = "spark.sql.codegen.hugeMethodLimit"


class Scratch:
    """Tables written to the shared folder; drop() removes those that are no longer read.

    A table's shuffle files go once it is written, so the disk holds those of one step at a time.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/llm-{uuid.uuid4().hex}"
        settings = {CLEANUP: "true", METHODS: "8000"}
        before = {name: self.spark.conf.get(name) for name in settings}
        for name, value in settings.items():
            self.spark.conf.set(name, value)
        try:
            df.write.parquet(path)
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def write_result(self, build: Callable[[Scratch], DataFrame]) -> DataFrame:
        """The table that build(scratch) makes; what it wrote on the way is removed again."""
        own = Scratch(self.spark)
        result = self.write(build(own))
        for path in list(own.paths.values()):
            own._delete(path)
        return result

    def drop(self, table: DataFrame) -> None:
        self._delete(self.paths.pop(id(table)))

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component, the smallest id reachable, of every id in links(u, v).

    Alternates between the two star steps: every node hands its larger neighbours to its
    smallest one, then every node and its smaller neighbours go to the smallest.  The number of
    rounds grows with the logarithm of the longest path.  A node with very many links is
    aggregated before it is shuffled, and its join is one that Spark splits.  Each round is
    written to the shared folder, and the one before it removed.
    """
    links = scratch.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = scratch.write(small.where("u <> v").distinct())
        scratch.drop(links)
        links, before, state = after, state, _state(after)
        if state == before:
            break
    # stars now: every link leads to the smallest id of its component
    ends = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
