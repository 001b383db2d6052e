"""What comes in: listings and ranges of stores, scans of file systems, logs and journals in JSON, archives of other kinds, and metrics.

Nothing that can't be read is dropped: it becomes a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ledgerloom.operators.catalog import first_wins

#: What a store declares of itself.
CAPABILITIES = (
    "conditional-create", "conditional-replace", "ranged-reads", "multipart-upload", "batch-delete", "object-versioning", "object-lock", "server-side-checksums", "listing-consistency",
    "minimum-storage-duration", "archival-tiers", "maximum-object-size", "maximum-metadata-bytes",
)

# Stores


def object_metadata(objects: DataFrame, asked: DataFrame) -> DataFrame:
    """key, length, outcome of each asked key: ``found``, or ``not-found`` without a length. Contents aren't read."""
    return asked.select("key").distinct().join(objects.select("key", "length"), "key", "left").withColumn("outcome", F.when(F.col("length").isNull(), "not-found").otherwise("found"))


def deleted_objects(objects: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects that stay, key and outcome of each asked key): ``deleted`` or ``not-found``; an outcome is a value, not an error."""
    keys = asked.select("key").distinct()
    outcome = keys.join(objects.select("key", F.lit(True).alias("here")), "key", "left").select("key", F.when(F.col("here"), "deleted").otherwise("not-found").alias("outcome"))
    return objects.join(keys, "key", "left_anti"), outcome


def listed(objects: DataFrame, prefix: str, resume_after: str | None = None) -> DataFrame:
    """key, length of the objects under a prefix, which may end within a component, in byte order of keys, after ``resume_after``."""
    rows = objects.select("key", "length").where(F.col("key").startswith(prefix))
    return (rows.where(F.col("key") > resume_after) if resume_after is not None else rows).orderBy("key")


def capabilities(stores: DataFrame) -> DataFrame:
    """store, capability, value: one row for each of ``CAPABILITIES``, ``unknown`` where a store's map (declared) doesn't name it."""
    all_ = F.array(*map(F.lit, CAPABILITIES))
    return stores.select("store", "declared", F.explode(all_).alias("capability")).select("store", "capability", F.coalesce(F.try_element_at("declared", F.col("capability")), F.lit("unknown")).alias("value"))


# File systems


def scan_events(nodes: DataFrame, cross_mounts: bool = False) -> DataFrame:
    """path, event, position of a scan: ``enter`` and ``leave`` of each directory, ``leaf`` of each other entry, ``failure`` of what can't be read or named.

    nodes: path (bytes, components parted by slashes), kind ('directory' or other), device, error. ``position`` sorts events depth first,
    entries of a directory by the bytes of their names, and a directory's leave behind all that is in it. A directory on another device
    than its parent is put out empty unless ``cross_mounts``; a name whose bytes aren't UTF-8 is a failure, and nothing below it is put out.
    """
    directory = F.col("kind") == "directory"
    text = F.try_validate_utf8(F.col("path").cast("string"))
    rows = nodes.withColumn("bad", F.col("error").isNotNull() | text.isNull()).withColumn("folder", directory)
    # Hex digits keep the order of bytes, and pairs of them that are set apart can be split at slashes alone.
    rows = rows.withColumn("hex", F.hex("path"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length("path"), F.lit(1))), lambda i: F.substring(F.col("hex"), i * 2 - 1, F.lit(2)))
    parts = F.split(F.array_join(bytes_, " "), "(?: |^)2F(?: |$)")
    rows = rows.withColumn("parts", F.transform(parts, lambda p: F.replace(p, F.lit(" "), F.lit(""))))
    folders = rows.where("folder").select(F.col("hex").alias("above"), F.col("device").alias("above_device"), F.col("bad").alias("above_bad"))
    above = F.transform(F.sequence(F.lit(0), F.size("parts") - 2), lambda n: F.array_join(F.slice("parts", 1, n + 1), "2F"))
    links = rows.where(F.size("parts") > 1).select("hex", F.explode(above).alias("above")).join(folders, "above")
    # A directory is cut off where it stands on another device than the one above it; what is below a cut or bad directory isn't put out.
    parent = rows.where(F.size("parts") > 1).select("hex", "device", F.array_join(F.slice("parts", 1, F.size("parts") - 1), "2F").alias("above")).join(folders, "above")
    cut = rows.join(parent.where(F.lit(not cross_mounts) & (F.col("device") != F.col("above_device"))).select("hex"), "hex", "left_semi").where("folder").select(F.col("hex").alias("above"))
    stop = cut.unionByName(folders.where("above_bad").select("above")).distinct()
    hidden = links.join(stop, "above", "left_semi").select("hex").distinct()
    seen = rows.join(hidden, "hex", "left_anti")
    place = F.array_join("parts", "/")
    event = lambda name, end: F.struct(F.lit(name).alias("event"), F.concat(place, F.lit(end)).alias("position"))
    events = F.when(F.col("bad"), F.array(event("failure", "/"))).when(F.col("folder"), F.array(event("enter", "/"), event("leave", "/~"))).otherwise(F.array(event("leaf", "/")))
    return seen.select("path", F.inline(events))


def holes(extents: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, offset, length of the parts of each file (file_id, length) that no extent (file_id, offset, length) holds; extents may overlap."""
    end = F.col("offset") + F.col("length")
    before = F.coalesce(F.max(end).over(Window.partitionBy("file_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = files.select("file_id", F.col("length").alias("size"))
    all_ = extents.select("file_id", "offset", "length").unionByName(sizes.select("file_id", F.col("size").alias("offset"), F.lit(0).cast("long").alias("length")))
    gaps = all_.withColumn("from", before).where("offset > `from`").join(sizes, "file_id")
    return gaps.select("file_id", F.col("from").alias("offset"), (F.least("offset", "size") - F.col("from")).alias("length")).where("length > 0")


# Logs


def decoded(lines: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of lines of JSON (line): each is read once; those that aren't an object of the schema are put aside as they stand."""
    own = StructType([*schema.fields]).add("_corrupt", "string")
    rows = lines.withColumn("_record", F.from_json("line", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("_record").isNotNull() & F.col("_record._corrupt").isNull()
    return rows.where(good).select(*lines.columns, *[F.col(f"_record.{f.name}") for f in schema.fields]).drop("line"), rows.where(~F.coalesce(good, F.lit(False))).select(*lines.columns)


def log_findings(lines: DataFrame, schema: StructType) -> DataFrame:
    """source, decoded, undecodable: how many lines of each source could be read; one undecodable line is a finding, not an end."""
    own = StructType([*schema.fields]).add("_corrupt", "string")
    record = F.from_json("line", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good = F.coalesce(record.isNotNull() & record["_corrupt"].isNull(), F.lit(False))
    return lines.groupBy("source").agg(F.count_if(good).alias("decoded"), F.count_if(~good).alias("undecodable"))


def surveyed(objects: DataFrame, schema: StructType) -> DataFrame:
    """key, the schema's columns, undecodable: every snapshot object as a fact, newest (captured_ms) first and then by key; those that can't be read come last, as rows."""
    good, bad = decoded(objects, schema)
    out = good.withColumn("undecodable", F.lit(False)).unionByName(bad.select("key").withColumn("undecodable", F.lit(True)), allowMissingColumns=True)
    return out.orderBy(F.col("captured_ms").desc_nulls_last(), "key")


def imported(own: DataFrame, legacy: DataFrame, origin: str) -> DataFrame:
    """version_id, path, at_ms, content_id, provenance: an older archive's versions beside one's own, first of each (path, content_id) by time; a version that both have is one's own."""
    both = own.withColumn("provenance", F.lit("own")).unionByName(legacy.withColumn("provenance", F.lit(origin))).withColumn("rank", F.when(F.col("provenance") == "own", 0).otherwise(1))
    return first_wins(both, ["path", "content_id"], ["rank", "at_ms", "version_id"]).select("version_id", "path", "at_ms", "content_id", "provenance")


# Metrics


def metric_counters(points: DataFrame) -> DataFrame:
    """name, tags, total: sums of points (name, tags: map, value) by name and tags, whatever the tags' order; tags as ``key=value`` in order of keys."""
    return points.groupBy("name", tag_text(F.col("tags")).alias("tags")).agg(F.sum("value").alias("total"))


def tag_text(tags: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")


def metric_histograms(points: DataFrame, bounds: list[float]) -> DataFrame:
    """name, tags, bucket (number of bounds below the value), n, least, most; bounds are upper ends, included."""
    bucket = sum((F.when(F.col("value") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    return points.where("value IS NOT NULL").groupBy("name", tag_text(F.col("tags")).alias("tags"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
