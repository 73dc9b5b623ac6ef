"""Resumable runs: items that are asked one after the other, answers that are checked, and a log in which no key is settled twice.

Answers are an input table (key, attempt, response); asking is not done here.
A batch of items is a part of the log of its own, written whole or not at all,
so a run that is killed goes on with the batches that are missing, and a batch
that runs again writes the same part again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Times that an item is asked.
ATTEMPTS = 3
LOG = "key string, attempt int, response string, problems array<string>, feedback array<string>, accepted boolean"


def answered(items: DataFrame, answers: DataFrame, problems: Callable[[Column], Column], attempts: int = ATTEMPTS) -> DataFrame:
    """A row for each attempt at each key of ``items``: attempts end with the first accepted one, and with ``attempts``.

    ``problems`` gives an array of what is wrong with a response, empty if it is
    accepted. feedback is what was wrong with the attempt before. A missing
    answer has the problem ``no answer`` and ends the item for this run.
    """
    asked = items.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
    each = asked.select("key", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    one = answers.select(F.col("key").cast("string").alias("key"), F.col("attempt").cast("int").alias("attempt"), F.col("response").cast("string").alias("response"))
    one = one.groupBy("key", "attempt").agg(F.min("response").alias("response"))  # an answer given twice counts once
    told = each.join(one, ["key", "attempt"], "left")
    found = F.when(F.col("response").isNull(), F.array(F.lit("no answer"))).otherwise(problems(F.col("response")))
    own = Window.partitionBy("key").orderBy("attempt")  # ``attempts`` rows
    told = told.withColumn("problems", found).withColumns({"accepted": F.size("problems") == 0, "feedback": F.lag("problems").over(own)})
    over = F.max((F.col("accepted") | F.col("response").isNull()).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return told.withColumn("over", F.coalesce(over, F.lit(0))).where("over = 0").select("key", "attempt", "response", "problems", "feedback", "accepted")


class Run:
    """A log folder with a part for each batch."""

    def __init__(self, spark: SparkSession, folder: str, answers: DataFrame, problems: Callable[[Column], Column], attempts: int = ATTEMPTS):
        self.spark, self.folder, self.answers, self.problems, self.attempts = spark, folder, answers, problems, attempts

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def log(self) -> DataFrame:
        """All attempts with their batch."""
        if not self._there(f"{self.folder}/log"):
            return self.spark.createDataFrame([], f"{LOG}, batch long")
        return self.spark.read.schema(f"{LOG}, batch long").option("basePath", f"{self.folder}/log").parquet(f"{self.folder}/log")

    def settled(self) -> DataFrame:
        """(key, response) of the accepted attempts."""
        return self.log().where("accepted").select("key", "response")

    def process(self, items: DataFrame, batch: int) -> None:
        """One batch; keys that another batch has settled are left out."""
        done = self.log().where((F.col("batch") != batch) & F.col("accepted")).select("key")
        left = items.select(F.col("key").cast("string").alias("key")).join(done, "key", "left_anti")
        answered(left, self.answers, self.problems, self.attempts).write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")

    def start(self, items: DataFrame) -> StreamingQuery:
        """The stream of items (key), batch by batch, from where the last run stopped."""
        out = items.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return out.trigger(availableNow=True).start()
