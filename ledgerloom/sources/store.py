"""Objects of a store as rows: listing, ranges, conditional puts, and ledgers in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def list_objects(spark: SparkSession, root: str, prefix: str = "", resume_after: str | None = None) -> DataFrame:
    """key, length, modified of the objects under a prefix (which may end within a component), in byte order of keys, after ``resume_after``.

    Folders that the prefix names whole are where the listing starts; contents aren't read.
    """
    root = root.rstrip("/")
    folder = prefix.rpartition("/")[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{folder}" if folder else root)
    key = F.substring_index(F.col("path"), root.partition("://")[2] or root, -1)
    rows = files.select(F.ltrim(key, F.lit("/")).alias("key"), "length", F.col("modificationTime").alias("modified"))
    rows = rows.where(F.col("key").startswith(prefix))
    if resume_after is not None:
        rows = rows.where(F.col("key") > resume_after)
    return rows.orderBy("key")


def read_ranges(objects: DataFrame, ranges: DataFrame) -> DataFrame:
    """key, offset, length, bytes: exactly the range asked for, or null if the object is missing or too short."""
    rows = ranges.join(objects.select("key", "data"), "key", "left")
    cut = F.expr("if(octet_length(data) >= offset + length, substring(data, cast(offset as int) + 1, cast(length as int)), null)")
    return rows.select("key", "offset", "length", cut.alias("bytes"))


def put_if_absent(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` with outcome: ``stored`` for the first of each new key, else ``already-exists``. The stored ones are what to append."""
    first = batch.groupBy("key").agg(F.min("seq").alias("first"))
    new = first.join(table.select("key").distinct(), "key", "left_anti")
    return batch.join(new, "key", "left").withColumn("outcome", F.when(F.col("seq") == F.col("first"), "stored").otherwise("already-exists")).drop("first")


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a ledger of JSON lines; lines that don't parse are quarantined as they stand."""
    own = StructType([*schema.fields]).add("_corrupt_record", "string")
    rows = spark.read.schema(own).option("mode", "PERMISSIVE").json(path)
    lines = spark.read.text(path)
    bad = lines.where(F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull())
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), bad.select(F.col("value").alias("line"))
