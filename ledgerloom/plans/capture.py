"""Queries over stores, scans, logs, imports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import capture as K
from ledgerloom.plans.registry import query
from ledgerloom.sources import store
from ledgerloom.sources.tables import Tables

OBJECTS = """objects AS (SELECT path AS key, length FROM files)"""


def _objects(t: Tables) -> DataFrame:
    return t.files.select(F.col("path").alias("key"), "length")


def _asked(t: Tables) -> DataFrame:
    return t.files.where("file_id % 4 = 0").select(F.col("path").alias("key")).union(t.files.where("file_id % 6 = 0").select(F.concat("path", F.lit(".gone"))))


ASKED = OBJECTS + """, asked AS (SELECT path AS key FROM files WHERE file_id % 4 = 0 UNION SELECT path || '.gone' FROM files WHERE file_id % 6 = 0)"""


@query(ASKED + " SELECT a.key, o.length, CASE WHEN o.key IS NULL THEN 'not-found' ELSE 'found' END AS outcome FROM asked a LEFT JOIN objects o USING (key)")
def object_metadata(t: Tables) -> DataFrame:
    return K.object_metadata(_objects(t), _asked(t))


@query(ASKED + " SELECT a.key, CASE WHEN o.key IS NULL THEN 'not-found' ELSE 'deleted' END AS outcome FROM asked a LEFT JOIN objects o USING (key)")
def object_deletes(t: Tables) -> DataFrame:
    return K.deleted_objects(_objects(t), _asked(t))[1]


@query(OBJECTS + " SELECT key, length FROM objects WHERE starts_with(key, 'src1') AND key > 'src1/de/2'")
def prefix_listing(t: Tables) -> DataFrame:
    return K.listed(_objects(t), "src1", "src1/de/2")


@query("""d AS (SELECT doc_id, encode(text) AS data, doc_id % 50 * 20 AS pos, doc_id % 7 * 30 AS n FROM documents)
  SELECT doc_id AS key, pos AS "offset", n AS length, CASE WHEN octet_length(data) >= pos + n THEN lower(hex(data[pos + 1 : pos + n])) END AS bytes FROM d""")
def range_reads(t: Tables) -> DataFrame:
    data = t.documents.select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("data"))
    ranges = data.select("key", (F.col("key") % 50 * 20).alias("offset"), (F.col("key") % 7 * 30).alias("length"))
    return store.read_ranges(data, ranges).withColumn("bytes", F.lower(F.hex("bytes")))


@query("""b AS (SELECT l_orderkey AS key, min(l_partkey) AS first FROM lineitem GROUP BY 1)
  SELECT DISTINCT l_orderkey AS key, l_partkey AS seq, CASE WHEN l_partkey = first AND l_orderkey % 3 > 0 THEN 'stored' ELSE 'already-exists' END AS outcome FROM lineitem JOIN b ON b.key = l_orderkey""")
def conditional_puts(t: Tables) -> DataFrame:
    batch = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("seq")).distinct()
    return store.put_if_absent(t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key")), batch)


@query("""c AS (SELECT unnest(['conditional-create', 'conditional-replace', 'ranged-reads', 'multipart-upload', 'batch-delete', 'object-versioning', 'object-lock', 'server-side-checksums', 'listing-consistency',
    'minimum-storage-duration', 'archival-tiers', 'maximum-object-size', 'maximum-metadata-bytes']) AS capability)
  SELECT s_suppkey AS store, capability, CASE WHEN capability = 'ranged-reads' THEN CAST(s_suppkey % 2 = 0 AS VARCHAR) WHEN capability = 'listing-consistency' AND s_suppkey % 3 = 0 THEN 'strong' ELSE 'unknown' END AS value FROM supplier, c""")
def store_capabilities(t: Tables) -> DataFrame:
    n = F.col("s_suppkey")
    consistency = F.when(n % 3 == 0, F.create_map(F.lit("listing-consistency"), F.lit("strong"))).otherwise(F.create_map().cast("map<string,string>"))
    return K.capabilities(t.supplier.select(n.alias("store"), F.map_concat(F.create_map(F.lit("ranged-reads"), (n % 2 == 0).cast("string")), consistency).alias("declared")))


# A tree of directories and files: one name in thirteen isn't UTF-8, one language is a mount of its own, one directory can't be read.
NODES = """leaves AS (SELECT source, lang, encode(source || '/' || lang || '/' || doc_id || '.txt') || CASE WHEN doc_id % 13 = 0 THEN unhex('FF') ELSE ''::BLOB END AS path, doc_id % 13 = 0 AS bad FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
  dirs AS (SELECT DISTINCT source, lang FROM leaves)"""


def _nodes(t: Tables) -> DataFrame:
    docs = t.documents.where("source IS NOT NULL AND lang IS NOT NULL")
    device = F.when(F.col("lang") == "fr", 2).otherwise(1)
    error = F.when(F.concat_ws("/", "source", "lang").endswith("0/de"), "EACCES")
    name = F.concat(F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")).cast("binary"), F.when(F.col("doc_id") % 13 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    files = docs.select(name.alias("path"), F.lit("file").alias("kind"), device.alias("device"), F.lit(None).cast("string").alias("error"))
    low = docs.select(F.concat_ws("/", "source", "lang").cast("binary"), F.lit("directory"), device, error).distinct()
    return files.union(low).union(docs.select(F.col("source").cast("binary"), F.lit("directory"), F.lit(1), F.lit(None).cast("string")).distinct())


@query(NODES + """, e AS (SELECT encode(source) AS path, unnest(['enter', 'leave']) AS event FROM dirs UNION SELECT encode(source || '/' || lang), unnest(CASE WHEN suffix(source || '/' || lang, '0/de') THEN ['failure'] ELSE ['enter', 'leave'] END) FROM dirs
    UNION ALL SELECT path, CASE WHEN bad THEN 'failure' ELSE 'leaf' END FROM leaves WHERE lang <> 'fr' AND NOT suffix(source || '/' || lang, '0/de')) SELECT lower(hex(path)) AS path, event FROM e""")
def filesystem_scan(t: Tables) -> DataFrame:
    return K.scan_events(_nodes(t)).orderBy("position").select(F.lower(F.hex("path")).alias("path"), "event")


@query(NODES + """, e AS (SELECT encode(source || '/' || lang) AS path, unnest(['enter', 'leave']) AS event FROM dirs WHERE lang = 'fr' UNION ALL SELECT path, CASE WHEN bad THEN 'failure' ELSE 'leaf' END FROM leaves WHERE lang = 'fr') SELECT lower(hex(path)) AS path, event FROM e""")
def filesystem_scan_across_mounts(t: Tables) -> DataFrame:
    out = K.scan_events(_nodes(t), cross_mounts=True)
    return out.where(F.hex("path").contains("2F6672")).select(F.lower(F.hex("path")).alias("path"), "event")


@query("""x AS (SELECT l_orderkey AS file_id, l_partkey % 1000 AS a, CAST(l_quantity AS BIGINT) AS n FROM lineitem), f AS (SELECT o_orderkey AS file_id, o_orderkey % 2000 AS size FROM orders),
  u AS (SELECT file_id, a, n FROM x WHERE file_id IN (SELECT file_id FROM f) UNION ALL SELECT file_id, size, 0 FROM f),
  w AS (SELECT file_id, a, coalesce(max(a + n) OVER (PARTITION BY file_id ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM u)
  SELECT w.file_id, b AS "offset", least(a, size) - b AS length FROM w JOIN f USING (file_id) WHERE least(a, size) > b""")
def sparse_holes(t: Tables) -> DataFrame:
    extents = t.lineitem.select(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") % 1000).alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    return K.holes(extents, t.orders.select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 2000).alias("length")))


LINES = """lines AS (SELECT user_id % 20 AS source, event_id AS n, CASE WHEN event_id % 37 = 0 THEN substr(props, 1, 5) WHEN event_id % 41 = 0 THEN 'no' WHEN event_id % 43 > 0 THEN props END AS line FROM events),
  parsed AS (SELECT *, coalesce(TRY(CAST(json_extract_string(CASE WHEN json_valid(line) THEN line END, '$.k') AS BIGINT)), -1) AS k FROM lines)"""
RECORD = StructType().add("k", "long")


def _lines(t: Tables) -> DataFrame:
    n = F.col("event_id")
    line = F.when(n % 37 == 0, F.substring("props", 1, 5)).when(n % 41 == 0, "no").when(n % 43 > 0, F.col("props"))
    return t.events.select((F.col("user_id") % 20).alias("source"), n.alias("n"), line.alias("line"))


@query(LINES + " SELECT source, n, k FROM parsed WHERE k >= 0")
def decoded_log(t: Tables) -> DataFrame:
    return K.decoded(_lines(t), RECORD)[0]


@query(LINES + " SELECT source, n, line FROM parsed WHERE k < 0")
def quarantined_log(t: Tables) -> DataFrame:
    return K.decoded(_lines(t), RECORD)[1]


@query(LINES + " SELECT source, count(*) FILTER (k >= 0) AS decoded, count(*) FILTER (k < 0) AS undecodable FROM parsed GROUP BY source")
def log_findings(t: Tables) -> DataFrame:
    return K.log_findings(_lines(t), RECORD)


@query("""SELECT snapshot_id AS key, CASE WHEN snapshot_id % 29 > 0 THEN captured_ms END AS captured_ms, snapshot_id % 29 = 0 AS undecodable FROM snapshots""")
def snapshot_survey(t: Tables) -> DataFrame:
    line = F.when(F.col("snapshot_id") % 29 == 0, "{").otherwise(F.format_string('{"captured_ms": %d}', "captured_ms"))
    return K.surveyed(t.snapshots.select(F.col("snapshot_id").alias("key"), line.alias("line")), StructType().add("captured_ms", "long"))


@query("""v AS (SELECT 'own' AS provenance, 0 AS rank, version_id, path, modified AS at_ms, content_id FROM prior_files UNION ALL
    SELECT 'older', 1, 'old-' || file_id, CASE WHEN file_id % 3 = 0 THEN 'old/' || path ELSE replace(path, '.txt', '') END, modified, content_id FROM files)
  SELECT version_id, path, at_ms, content_id, provenance FROM (SELECT *, row_number() OVER (PARTITION BY path, content_id ORDER BY rank, at_ms, version_id) AS r FROM v) WHERE r = 1""")
def legacy_import(t: Tables) -> DataFrame:
    own = t.prior_files.select("version_id", "path", F.col("modified").alias("at_ms"), "content_id")
    path = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.replace("path", F.lit(".txt"), F.lit("")))
    return K.imported(own, t.files.select(F.concat(F.lit("old-"), F.col("file_id").cast("string")).alias("version_id"), path.alias("path"), F.col("modified").alias("at_ms"), "content_id"), "older")


POINTS = """points AS (SELECT 'segments' AS name, 'class=' || CASE WHEN l_linenumber % 2 = 0 THEN 'data' ELSE 'meta' END || CASE WHEN l_returnflag = 'N' THEN '' ELSE ',reused=' || l_returnflag END AS tags, CAST(l_quantity AS BIGINT) AS value FROM lineitem)"""


def _points(t: Tables) -> DataFrame:
    """Tags come in either order."""
    kind, reused = F.when(F.col("l_linenumber") % 2 == 0, "data").otherwise("meta"), F.create_map(F.lit("reused"), F.col("l_returnflag"))
    own = F.create_map(F.lit("class"), kind)
    tags = F.when(F.col("l_returnflag") == "N", own).when(F.col("l_partkey") % 2 == 0, F.map_concat(own, reused)).otherwise(F.map_concat(reused, own))
    return t.lineitem.select(F.lit("segments").alias("name"), tags.alias("tags"), F.col("l_quantity").cast("long").alias("value"))


@query(POINTS + " SELECT name, tags, CAST(sum(value) AS BIGINT) AS total FROM points GROUP BY ALL")
def metric_counters(t: Tables) -> DataFrame:
    return K.metric_counters(_points(t))


@query(POINTS + " SELECT name, tags, CAST(value > 10 AS INTEGER) + CAST(value > 25 AS INTEGER) + CAST(value > 45 AS INTEGER) AS bucket, count(*) AS n, min(value) AS least, max(value) AS most FROM points GROUP BY ALL")
def metric_histograms(t: Tables) -> DataFrame:
    return K.metric_histograms(_points(t), [10, 25, 45])
