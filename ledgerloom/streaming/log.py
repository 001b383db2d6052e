"""Index deltas as a stream: micro-batches fold into the winners table; order and repetition of deltas don't matter."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.catalog import last_wins

ORDER = ["generation", "writer_id", "sequence", "arrival", "blob_id"]
#: Parts of the state; a batch rewrites those that its objects fall into.
BUCKETS = 64


def _versions(spark: SparkSession, state_dir: str) -> dict[int, dict[int, str]]:
    """Of each bucket, the epochs that wrote it, with their folders."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/epoch=*/bucket=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    out: dict[int, dict[int, str]] = defaultdict(dict)
    for status in found or ():
        path = status.getPath().toString()
        epoch, bucket = map(int, re.search(r"epoch=(\d+)/bucket=(\d+)$", path).groups())
        out[bucket][epoch] = path
    return out


def fold_winners(state_dir: str, buckets: int = BUCKETS):
    """A foreachBatch function that keeps each object's winner in ``state_dir``, in buckets by object.

    A batch reads the last version of the buckets that it touches, from epochs before its own, and writes theirs anew, so a batch that is run
    again writes the same. The version before the last stays, for such a run; older ones are deleted. The state may begin at any epoch.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        bucket = F.pmod(F.xxhash64("object_id"), F.lit(buckets)).cast("int").alias("bucket")
        touched = {r["bucket"] for r in batch.select(bucket).distinct().collect()}
        known = {b: {e: p for e, p in of.items() if e < epoch} for b, of in _versions(spark, state_dir).items() if b in touched}
        old = [of[max(of)] for of in known.values() if of]
        rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch) if old else batch
        last_wins(rows, ["object_id"], ORDER).select(*columns, bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{state_dir}/epoch={epoch}")
        for of in known.values():
            for e in sorted(of)[:-1]:
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(of[e])
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return fold


def winners(spark: SparkSession, state_dir: str, schema) -> DataFrame:
    """The folded winners: the last version of every bucket."""
    paths = [of[max(of)] for of in _versions(spark, state_dir).values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_winners(deltas: DataFrame, state_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Start folding a stream of deltas; takes all that is there and stops."""
    return deltas.writeStream.foreachBatch(fold_winners(state_dir)).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
