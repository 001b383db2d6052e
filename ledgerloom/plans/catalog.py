"""Queries over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import catalog as C
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import Tables

ORDER = "generation DESC, writer_id DESC, sequence DESC, arrival DESC, blob_id DESC, physical_offset DESC, stored_length DESC"


@query(f"""ranked AS (SELECT l.*, coalesce(b.state, 1) <> 3 AS live, row_number() OVER (PARTITION BY object_id ORDER BY {ORDER}) AS r,
    row_number() OVER (PARTITION BY object_id, coalesce(b.state, 1) <> 3 ORDER BY {ORDER}) AS rl FROM locations l LEFT JOIN blobs b USING (blob_id))
  SELECT a.object_id, w.blob_id, w.generation, w.writer_id, w.sequence, w.physical_offset, w.stored_length, NOT a.live AS superseded
  FROM ranked a LEFT JOIN ranked w ON w.object_id = a.object_id AND w.live AND w.rl = 1 WHERE a.r = 1""")
def index_winner(t: Tables) -> DataFrame:
    return C.index_winners(t.locations, t.blobs)


@query("""SELECT object_id, blob_id, generation, writer_id, sequence, arrival FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY generation DESC, writer_id DESC, sequence DESC, arrival DESC, blob_id DESC) AS r FROM locations) WHERE r = 1""")
def winners_of_repeated_deltas(t: Tables) -> DataFrame:
    """Deltas that come late, in any order and several times give the winners of all."""
    rows = t.locations.select("object_id", "blob_id", "generation", "writer_id", "sequence", "arrival")
    return C.last_wins(rows.where("sequence % 2 = 0").unionByName(rows).unionByName(rows.where("sequence % 3 = 0")), ["object_id"], ["generation", "writer_id", "sequence", "arrival", "blob_id"])


@query("""SELECT object_id, blob_id, physical_offset, stored_length FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY blob_id, physical_offset, stored_length) AS r
  FROM locations) WHERE r = 1""")
def footer_winner(t: Tables) -> DataFrame:
    return C.footer_winners(t.locations)


@query("""SELECT object_id, l.blob_id, sequence FROM locations l LEFT JOIN blobs b ON b.blob_id = l.blob_id WHERE coalesce(b.state, 1) <> 3""")
def live_locations(t: Tables) -> DataFrame:
    return C.live_locations(t.locations, t.blobs).select("object_id", "blob_id", "sequence")


@query("""SELECT writer_id, sequence, object_id FROM locations l WHERE generation <= 1998 OR sequence > coalesce((SELECT max(sequence) FROM locations c
  WHERE c.generation <= 1998 AND c.writer_id = l.writer_id), -1)""")
def checkpoint_merge(t: Tables) -> DataFrame:
    rows = t.locations.select("writer_id", "sequence", "object_id", "generation")
    return C.merged_checkpoints(rows.where("generation <= 1998"), rows.where("generation > 1998")).drop("generation")


@query("SELECT writer_id, max(sequence) AS watermark, max(generation) AS newest_generation FROM locations GROUP BY writer_id")
def writer_watermarks(t: Tables) -> DataFrame:
    return t.locations.groupBy("writer_id").agg(F.max("sequence").alias("watermark"), F.max("generation").alias("newest_generation"))


@query("""seen AS (SELECT DISTINCT l_suppkey AS writer_id, l_orderkey AS sequence FROM lineitem WHERE l_linenumber > 1),
  marks AS (SELECT writer_id, min(sequence) + 100 AS watermark FROM seen GROUP BY writer_id),
  known AS (SELECT * FROM seen UNION SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber = 1),
  spans AS (SELECT s.writer_id, sequence, coalesce(lag(sequence) OVER (PARTITION BY s.writer_id ORDER BY sequence), watermark) AS before FROM known s JOIN marks m USING (writer_id) WHERE sequence > watermark)
  SELECT writer_id, before + 1 AS low, sequence - 1 AS high, CASE WHEN writer_id % 5 >= 3 THEN 'damage' ELSE 'unresolved' END AS verdict FROM spans
  WHERE sequence > before + 1 AND before < (SELECT max(sequence) FROM seen x WHERE x.writer_id = spans.writer_id)""")
def sequence_gaps(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_suppkey").alias("writer_id"), F.col("l_orderkey").alias("sequence"), "l_linenumber")
    seen = lines.where("l_linenumber > 1").drop("l_linenumber")
    ages = seen.select("writer_id").distinct().withColumn("age", F.col("writer_id") % 5)
    return C.sequence_gaps(seen, seen.groupBy("writer_id").agg((F.min("sequence") + 100).alias("watermark")), lines.where("l_linenumber = 1"), ages)


@query("""SELECT blob_id, state FROM (SELECT DISTINCT l_orderkey AS blob_id, 3 AS state FROM lineitem) WHERE blob_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def blob_lifecycle(t: Tables) -> DataFrame:
    return C.blob_states(t.lineitem.select(F.col("l_orderkey").alias("blob_id")), t.blobs.where("state = 1"), complete=True)


def _table_and_batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A table of one row per blob, and a batch that has most keys several times."""
    table = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("blob_id"), F.lit(-1).cast("long").alias("state"))
    return table, t.lineitem.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("blob_id"), F.col("l_partkey").alias("state"), F.struct("l_linenumber", "l_shipdate", "l_suppkey").alias("arrival"))


BATCH = """k AS (SELECT o_orderkey AS blob_id, -1 AS state FROM orders WHERE o_orderkey % 2 = 0),
  b AS (SELECT l_orderkey AS blob_id, l_partkey AS state, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_suppkey, l_partkey) AS r,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_suppkey DESC, l_partkey DESC) AS d FROM lineitem WHERE l_orderkey % 3 = 0)"""


@query(BATCH + " SELECT blob_id, state FROM b WHERE d = 1 UNION ALL SELECT * FROM k WHERE blob_id NOT IN (SELECT blob_id FROM b)")
def catalogue_upsert(t: Tables) -> DataFrame:
    table, batch = _table_and_batch(t)
    return C.upsert(table, batch, ["blob_id"], "arrival")


@query(BATCH + " SELECT * FROM k UNION ALL SELECT blob_id, state FROM b WHERE r = 1 AND blob_id NOT IN (SELECT blob_id FROM k)")
def catalogue_insert_or_ignore(t: Tables) -> DataFrame:
    table, batch = _table_and_batch(t)
    return C.insert_or_ignore(table, batch, ["blob_id"], "arrival")


@query("""SELECT blob_id, object_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY sequence DESC, object_id DESC) AS r FROM locations) WHERE r = 1""")
def catalogue_insert_or_replace(t: Tables) -> DataFrame:
    return C.last_wins(t.locations.select("blob_id", "object_id", "sequence"), ["blob_id"], ["sequence"])


@query("""SELECT writer_id, sequence, object_id FROM locations l WHERE NOT EXISTS (SELECT 1 FROM locations d WHERE d.generation < 1998 AND d.writer_id = l.writer_id AND d.sequence = l.sequence)""")
def log_apply(t: Tables) -> DataFrame:
    rows = t.locations.select("writer_id", "sequence", "object_id", "generation")
    return C.apply_log(rows, rows.where("generation < 1998")).drop("generation")


@query("SELECT count(*) AS applied FROM (SELECT DISTINCT writer_id, sequence FROM locations)")
def applied_deltas(t: Tables) -> DataFrame:
    return t.locations.select("writer_id", "sequence").distinct().agg(F.count("*").alias("applied"))


@query("""SELECT q.asked, f.file_id, f.length FROM (SELECT path AS asked FROM files WHERE file_id % 5 = 0 UNION ALL SELECT path || '?' FROM files WHERE file_id % 50 = 0) q
  LEFT JOIN files f ON f.path = q.asked""")
def path_lookup(t: Tables) -> DataFrame:
    asked = t.files.where("file_id % 5 = 0").select(F.col("path").alias("asked")).unionByName(t.files.where("file_id % 50 = 0").select(F.concat("path", F.lit("?")).alias("asked")))
    return C.lookup_paths(t.files.select("path", "file_id", "length"), asked)


TREE = """tree AS (SELECT CASE WHEN file_id % 3 = 0 THEN upper(path) ELSE path END AS path, file_id FROM files UNION ALL SELECT upper(path), file_id + 1000000 FROM files WHERE file_id % 2 = 0
    UNION ALL SELECT path || '/cafe' || chr(769), file_id + 2000000 FROM files WHERE file_id % 10 = 0)"""


def _tree(t: Tables) -> DataFrame:
    """Paths in small and capital letters, and names written with a combining accent."""
    files = t.files.select("path", "file_id")
    tree = files.select(F.when(F.col("file_id") % 3 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"), "file_id")
    tree = tree.unionByName(files.where("file_id % 2 = 0").select(F.upper("path").alias("path"), (F.col("file_id") + 1000000).alias("file_id")))
    return tree.unionByName(files.where("file_id % 10 = 0").select(F.concat("path", F.lit("/cafe\u0301")).alias("path"), (F.col("file_id") + 2000000).alias("file_id")))


@query(TREE + """, q AS (SELECT DISTINCT path AS asked FROM files WHERE file_id % 5 = 0 UNION SELECT path || '/CAF' || chr(201) FROM files WHERE file_id % 20 = 0)
  SELECT asked, path, file_id FROM (SELECT asked, path, file_id, row_number() OVER (PARTITION BY asked ORDER BY path <> asked, path, file_id) AS r FROM q LEFT JOIN tree ON lower(nfc_normalize(path)) = lower(nfc_normalize(asked))) WHERE r = 1""")
def path_lookup_ignoring_case(t: Tables) -> DataFrame:
    asked = t.files.where("file_id % 5 = 0").select(F.col("path").alias("asked")).union(t.files.where("file_id % 20 = 0").select(F.concat("path", F.lit("/CAF\u00c9"))))
    return C.lookup_paths(_tree(t), asked.distinct(), ignore_case=True)


@query("""asked AS (SELECT content_id FROM files WHERE file_id % 3 = 0 UNION SELECT content_id || 'x' FROM files WHERE file_id % 9 = 1)
  SELECT a.content_id, o.object_id FROM asked a LEFT JOIN (SELECT content_id, min(file_id) AS object_id FROM files GROUP BY content_id) o USING (content_id)""")
def content_lookup(t: Tables) -> DataFrame:
    objects = t.files.select("content_id", F.col("file_id").alias("object_id"))
    asked = objects.where("object_id % 3 = 0").select("content_id").union(objects.where("object_id % 9 = 1").select(F.concat("content_id", F.lit("x"))))
    return C.lookup_content(objects, asked)


@query("""SELECT q.device, q.inode, q.asked_by, f.path FROM (SELECT device, inode, file_id AS asked_by FROM files WHERE file_id % 4 = 1) q
  JOIN (SELECT device, inode, min(path) AS path FROM files GROUP BY device, inode) f ON f.device = q.device AND f.inode = q.inode""")
def identity_lookup(t: Tables) -> DataFrame:
    asked = t.files.where("file_id % 4 = 1").select("device", "inode", F.col("file_id").alias("asked_by"))
    return C.lookup_identity(t.files.select("device", "inode", "path"), asked)


@query("SELECT parent, count(*) > 0 AS has_identity FROM files WHERE inode IS NOT NULL GROUP BY parent")
def has_identity(t: Tables) -> DataFrame:
    return t.files.where("inode IS NOT NULL").select("parent").distinct().withColumn("has_identity", F.lit(True))


@query("""SELECT f.file_id, f.parent, f.path, v.version_id, v.length AS version_length FROM files f LEFT JOIN prior_files v ON v.file_id = f.file_id
  WHERE f.parent = (SELECT min(parent) FROM files)""")
def directory_listing(t: Tables) -> DataFrame:
    first = t.files.agg(F.min("parent").alias("parent"))
    tree = t.files.select("file_id", "parent", "path").join(first, "parent", "left_semi")
    return tree.join(t.prior_files.select("file_id", "version_id", F.col("length").alias("version_length")), "file_id", "left").orderBy("path")


@query("""SELECT DISTINCT object_id, EXISTS (SELECT 1 FROM locations v WHERE v.object_id = l.object_id AND v.stored_length > 45) AS verified FROM locations l""")
def dedup_candidates(t: Tables) -> DataFrame:
    return C.candidates_with_proof(t.locations.select("object_id").distinct(), t.locations.where("stored_length > 45"))


@query(TREE + """, all_paths AS (SELECT path FROM tree UNION ALL SELECT path || '/caf' || chr(233) FROM files WHERE file_id % 30 = 0),
  n AS (SELECT path, lower(nfc_normalize(path)) AS fold, count(*) OVER (PARTITION BY lower(nfc_normalize(path))) AS n FROM all_paths) SELECT path, fold, n - 1 AS peers FROM n WHERE n > 1""")
def case_collisions(t: Tables) -> DataFrame:
    composed = t.files.where("file_id % 30 = 0").select(F.concat("path", F.lit("/caf\u00e9")).alias("path"))
    return C.case_collisions(_tree(t).select("path").unionByName(composed))


@query("""sub AS (SELECT substr(content_id, 1, 3) AS sub, count(*) AS n, sha256(string_agg(content_id, chr(10) ORDER BY content_id)) AS d FROM (SELECT DISTINCT content_id FROM files) GROUP BY 1)
  SELECT substr(sub, 1, 2) AS shard, CAST(sum(n) AS BIGINT) AS n_entries, sha256(string_agg(d, chr(10) ORDER BY sub)) AS digest FROM sub GROUP BY 1""")
def shard_digests(t: Tables) -> DataFrame:
    return C.shard_digests(t.files)


@query("""SELECT content_id, CAST('0x' || substr(content_id, 1, 4) AS BIGINT) AS shard, (device << 16) | (inode % 65536) AS profiles, regexp_replace(path, '/?[^/]*$', '') AS parent,
  regexp_extract(path, '[^/]*$') AS name, lpad(CAST(file_id AS VARCHAR), 16, '0') AS fixed_key, length <= 1000 AS within_limit, device AS compression, inode % 65536 AS encryption FROM files""")
def projections(t: Tables) -> DataFrame:
    packed = C.packed_profile(F.col("device"), F.col("inode"))
    compression, encryption = C.unpacked_profile(packed)
    return t.files.select(
        "content_id", C.shard(F.col("content_id")).alias("shard"), packed.alias("profiles"), C.parent_path(F.col("path")).alias("parent"),
        C.base_name(F.col("path")).alias("name"), F.lpad(F.col("file_id").cast("string"), 16, "0").alias("fixed_key"), (F.col("length") <= 1000).alias("within_limit"), compression.alias("compression"), encryption.alias("encryption"),
    )


@query("""rows AS (SELECT l_partkey * 10 + l_linenumber AS source_key, l_suppkey % 3 AS object FROM lineitem)
  SELECT source_key, min(object) AS object FROM rows GROUP BY source_key HAVING count(DISTINCT object) = 1""")
def unambiguous_sources(t: Tables) -> DataFrame:
    return C.unique_sources(t.lineitem.select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("source_key"), (F.col("l_suppkey") % 3).alias("object")))


@query("""bounds AS (SELECT l_orderkey * 100 + l_linenumber AS bound_id, l_suppkey % 50 AS key, epoch_ms(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'A')
  SELECT b.bound_id, b.key, b.at, max(s.captured_ms) AS captured_ms, arg_max(s.snapshot_id, struct_pack(a := s.captured_ms, b := s.snapshot_id)) AS snapshot_id
  FROM (SELECT DISTINCT * FROM bounds) b LEFT JOIN snapshots s ON s.set_id = b.key AND s.captured_ms <= b.at GROUP BY 1, 2, 3""")
def as_of_snapshots(t: Tables) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)")
    bounds = t.lineitem.where("l_returnflag = 'A'").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("bound_id"), (F.col("l_suppkey") % 50).alias("key"), ms.alias("at")).distinct()
    return C.as_of(t.snapshots.select(F.col("set_id").alias("key"), "captured_ms", "snapshot_id"), bounds)


@query("SELECT snapshot_id, set_id, captured_at FROM snapshots")
def snapshot_listing(t: Tables) -> DataFrame:
    return t.snapshots.select("snapshot_id", "set_id", "captured_at").orderBy(F.desc("captured_at"), "snapshot_id")


@query("""SELECT set_id, snapshot_id, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY captured_at DESC, snapshot_id) AS r FROM snapshots) WHERE r = 1""")
def latest_per_set(t: Tables) -> DataFrame:
    return t.snapshots.groupBy("set_id").agg(F.max(F.struct("captured_at", -F.col("snapshot_id"))).alias("w")).select("set_id", (-F.col("w.col2")).alias("snapshot_id"), "w.captured_at")


@query("SELECT q.asked, s.captured_ms FROM (SELECT o_orderkey * 2 AS asked FROM orders) q LEFT JOIN snapshots s ON s.snapshot_id = q.asked")
def capture_time_lookup(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_orderkey") * 2).alias("asked")).join(t.snapshots.select(F.col("snapshot_id").alias("asked"), "captured_ms"), "asked", "left")
