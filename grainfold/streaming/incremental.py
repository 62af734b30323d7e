"""Incremental tagging: every micro-batch of new rows is judged once; the tag store takes the
tags when the stream has caught up, and rows it already holds are not judged again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.plans.cascade import CascadePlan, one_plan
from grainfold.plans.judges import WordQuestions
from grainfold.plans.tags import TagStore
from grainfold.session import shared_dir

TAGS = T.StructType([
    T.StructField("parent_asin", T.StringType()),
    T.StructField("predicate_canon", T.StringType()),
    T.StructField("tag_value", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("settled_tier", T.IntegerType()),
    T.StructField("batch", T.LongType()),
])


def tag_stream(spark: SparkSession, path: str, plan: CascadePlan, source: WordQuestions, predicate: str, folder: str | None = None, key: str = "parent_asin", text: str = "review_text", store: TagStore | None = None) -> DataFrame:
    """Judge all rows of a growing parquet table as a stream; returns the stored tags.

    Each batch writes one folder named by its number, and overwrites it if it is run again,
    so a restart neither loses nor repeats a tag. Runs over what is there and stops.
    """
    folder = folder or f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path.rsplit("/", 1)[0], pathGlobFilter=path.rsplit("/", 1)[1]) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)

    def judge(batch: DataFrame, number: int) -> None:
        todo = batch.select(key, text)
        if store is not None:
            done = store.read().where((F.col("predicate_canon") == predicate) & F.col("tag_value").isNotNull())
            todo = todo.join(done.select(F.col("parent_asin").alias(key)), key, "left_anti")
        c = one_plan(todo, plan, source)
        out = c.select(F.col(key).alias("parent_asin"), F.lit(predicate).alias("predicate_canon"), F.col("answer").alias("tag_value"), F.col(f"conf_{predicate}").alias("confidence"), F.col(f"tier_{predicate}").alias("settled_tier"), F.lit(number).cast("long").alias("batch"))
        out.write.mode("overwrite").parquet(f"{folder}/tags/batch_no={number}")

    q = rows.writeStream.foreachBatch(judge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    new = spark.read.schema(TAGS).parquet(f"{folder}/tags").drop("batch_no")
    if store is None:
        return new
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy("parent_asin").orderBy(F.col("batch").desc()))).where("__n = 1").drop("__n")
    store.upsert(last, ["parent_asin", "predicate_canon"])
    return store.read()


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
