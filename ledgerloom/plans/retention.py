"""Queries over retention, collection and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators import retention as R
from ledgerloom.operators import status as S
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import Tables

NOW = "TIMESTAMP '2001-08-02 00:00:00'"
NOW_MS = 996_710_400_000

KEPT = f"""o AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY captured_at DESC, snapshot_id) AS rn,
    sum(CASE WHEN capture_status = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY captured_at DESC, snapshot_id ROWS UNBOUNDED PRECEDING) AS cc FROM snapshots),
  w AS (SELECT set_id, coalesce(max(CASE WHEN capture_status = 1 AND cc <= 3 THEN rn END), 3) AS win FROM o GROUP BY set_id),
  b AS (SELECT *, 0 AS ord, 'daily' AS rule, strftime(captured_at, '%Y-%m-%d') AS bucket FROM o WHERE captured_at >= {NOW} - INTERVAL 90 DAY
    UNION ALL SELECT *, 1, 'weekly', CAST(isoyear(captured_at) AS VARCHAR) || '-W' || lpad(CAST(week(captured_at) AS VARCHAR), 2, '0') FROM o WHERE captured_at >= {NOW} - INTERVAL 182 DAY
    UNION ALL SELECT *, 2, 'monthly', strftime(captured_at, '%Y-%m') FROM o WHERE captured_at >= {NOW} - INTERVAL 12 MONTH),
  k AS (SELECT *, row_number() OVER (PARTITION BY set_id, rule, bucket ORDER BY captured_at DESC, snapshot_id) AS rb,
    row_number() OVER (PARTITION BY set_id, rule, bucket, capture_status = 1 ORDER BY captured_at DESC, snapshot_id) AS rc FROM b),
  reasons AS (SELECT set_id, snapshot_id, ord, rule AS reason FROM k WHERE rb = 1 UNION SELECT set_id, snapshot_id, ord, rule || ' (complete)' FROM k WHERE capture_status = 1 AND rc = 1 AND rb <> 1
    UNION SELECT o.set_id, snapshot_id, 3, 'min-generations' FROM o JOIN w ON w.set_id = o.set_id WHERE rn <= win),
  kept AS (SELECT set_id, snapshot_id, string_agg(reason, ',' ORDER BY ord, reason) AS reasons FROM reasons GROUP BY set_id, snapshot_id)"""


def _kept(t: Tables) -> DataFrame:
    return R.kept_snapshots(t.snapshots, F.expr("TIMESTAMP_NTZ'2001-08-02 00:00:00'"), 90, 26, 12, 3)


@query(KEPT + " SELECT * FROM kept")
def retention_keep(t: Tables) -> DataFrame:
    return _kept(t)


@query(KEPT + """, expired AS (SELECT * FROM snapshots s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.snapshot_id = s.snapshot_id)),
  lag AS (SELECT s.snapshot_id, d.destination, 996710400000 - greatest(d.last_success_ms, s.captured_ms) > 2592000000 AS over FROM expired s JOIN destinations d ON d.set_id = s.set_id
    WHERE NOT coalesce(d.synced_sequence >= s.publication_sequence, false))
  SELECT s.set_id, s.snapshot_id, count(l.destination) > 0 AS held, coalesce(string_agg(CAST(l.destination AS VARCHAR), ',' ORDER BY l.destination), '') AS laggards, coalesce(bool_or(l.over), false) AS exceeded
  FROM expired s LEFT JOIN lag l ON l.snapshot_id = s.snapshot_id GROUP BY s.set_id, s.snapshot_id""")
def replication_gate(t: Tables) -> DataFrame:
    expired = t.snapshots.join(_kept(t).select("snapshot_id"), "snapshot_id", "left_anti")
    return R.replication_gate(expired, t.destinations, NOW_MS)


INTENTS = """live AS (SELECT i.writer_id, i.ref, i.issued_ms + greatest(i.amount, x.extended) * 3600000 + 300000 AS expires_ms
    FROM (SELECT writer_id, ref, max(at_ms) AS issued_ms, max(amount) AS amount FROM journal WHERE kind = 'intent' GROUP BY 1, 2) i
    LEFT JOIN (SELECT writer_id, ref, max(amount) AS extended FROM journal WHERE kind = 'extension' GROUP BY 1, 2) x ON x.writer_id = i.writer_id AND x.ref = i.ref
    WHERE NOT EXISTS (SELECT 1 FROM journal r WHERE r.kind = 'retirement' AND r.writer_id = i.writer_id AND r.ref = i.ref)),
  survey AS (SELECT * FROM live WHERE NOT coalesce(1706659200000 >= expires_ms, false))"""


def _live(t: Tables) -> DataFrame:
    return R.live_intents(t.journal, 1_706_659_200_000)


@query(INTENTS + " SELECT * FROM survey")
def live_intents(t: Tables) -> DataFrame:
    return _live(t)


SURVEY = """ SELECT DISTINCT ref * 10 + at_ms % 10 AS blob_id FROM journal j WHERE kind IN ('intent', 'extension') AND record_id % 6 <> 0 AND EXISTS (SELECT 1 FROM survey s WHERE s.writer_id = j.writer_id AND s.ref = j.ref)"""


def _survey(t: Tables, audits_unreadable: bool) -> DataFrame:
    """Each record names a blob, one in six none; audits stand in for records that can't be read."""
    kind = F.when(F.col("kind") == "audit", "unparseable").otherwise(F.col("kind")) if audits_unreadable else F.col("kind")
    journal = t.journal.withColumn("kind", kind).withColumn("blob_id", F.when(F.col("record_id") % 6 != 0, F.col("ref") * 10 + F.col("at_ms") % 10))
    return R.intent_survey(journal, t.blobs, 1_706_659_200_000)


@query(INTENTS + SURVEY)
def intent_survey(t: Tables) -> DataFrame:
    return _survey(t, False)


@query(INTENTS + SURVEY + " UNION SELECT blob_id FROM blobs WHERE EXISTS (SELECT 1 FROM journal WHERE kind = 'audit')")
def intent_survey_unreadable(t: Tables) -> DataFrame:
    return _survey(t, True)


PLAN = INTENTS + """, plan AS (SELECT blob_id, n_records, n_reachable, CASE WHEN n_reachable = n_records THEN 'live' WHEN n_reachable > 0 THEN 'partly live'
    WHEN blob_id IN (SELECT ref FROM survey) THEN 'covered' ELSE 'deletable' END AS verdict
  FROM (SELECT blob_id, count(*) AS n_records, count(*) FILTER (object_id % 5 < 2) AS n_reachable FROM locations GROUP BY blob_id))"""


@query(KEPT + PLAN.replace(INTENTS, ", " + INTENTS) + """, expired AS (SELECT * FROM snapshots s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.snapshot_id = s.snapshot_id)),
  lag AS (SELECT s.snapshot_id, d.destination, 996710400000 - greatest(d.last_success_ms, s.captured_ms) > 2592000000 AS over FROM expired s JOIN destinations d ON d.set_id = s.set_id
    WHERE NOT coalesce(d.synced_sequence >= s.publication_sequence, false)),
  held AS (SELECT snapshot_id, string_agg(CAST(destination AS VARCHAR), ',' ORDER BY destination) AS laggards, coalesce(bool_or(over), false) AS exceeded FROM lag GROUP BY 1)
  SELECT 0 AS section, 'protected: ' || count(*) || ' snapshots' AS line FROM kept UNION ALL SELECT 1, '  keep ' || snapshot_id || ': ' || reasons FROM kept
  UNION ALL SELECT 2, '  held ' || snapshot_id || ': awaiting ' || laggards || CASE WHEN exceeded THEN ' (deferral bound exceeded)' ELSE '' END FROM held
  UNION ALL SELECT 3, 'would delete: ' || count(*) FILTER (verdict = 'deletable') || ' blobs' FROM plan UNION ALL SELECT 4, 'kept whole for a live part: ' || count(*) FILTER (verdict = 'partly live') || ' blobs' FROM plan
  UNION ALL SELECT DISTINCT 5, 'NO DELETION: unreadable set ' || set_id FROM snapshots WHERE set_id % 20 = 7""")
def collection_report(t: Tables) -> DataFrame:
    vetoes = t.snapshots.where("set_id % 20 = 7").select(F.concat(F.lit("unreadable set "), F.col("set_id").cast("string")).alias("reason")).distinct()
    return S.report_lines(_plan(t), _kept(t), replication_gate(t).where("held"), vetoes)


def _plan(t: Tables) -> DataFrame:
    return R.collection_plan(t.locations, t.locations.where("object_id % 5 < 2"), _live(t).select(F.col("ref").alias("blob_id")))


@query(PLAN + " SELECT * FROM plan")
def collection_plan(t: Tables) -> DataFrame:
    return _plan(t)


@query(PLAN + """ SELECT b.blob_id, CASE WHEN 2 < b.sequence + 1 THEN 'waiting' WHEN NOT here AND 2 >= b.sequence + 2 THEN 'clear' WHEN NOT here THEN 'absent'
  WHEN p.verdict IN ('live', 'partly live') THEN 'damage' WHEN p.verdict = 'deletable' THEN 'delete' ELSE 'keep' END AS verdict
  FROM (SELECT o_orderkey AS blob_id, o_orderkey % 3 AS sequence, o_orderstatus <> 'P' AS here FROM orders WHERE o_orderkey % 4 = 0) b LEFT JOIN plan p ON p.blob_id = b.blob_id""")
def tombstone_sweep(t: Tables) -> DataFrame:
    tombs = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("blob_id"), (F.col("o_orderkey") % 3).alias("sequence"))
    return R.sweep(tombs, _plan(t), t.blobs.where("state = 1"), 2)


@query("""proofs AS (SELECT l_suppkey AS destination, count(*) AS verified_objects, max(l_orderkey) - 200 AS verified_sequence, max(l_shipdate) AS verified_at,
    max(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END) AS success_at FROM lineitem GROUP BY 1),
  pairs AS (SELECT l_orderkey AS blob_id, l_suppkey AS destination, bool_or(l_returnflag <> 'R') AS holds FROM lineitem GROUP BY 1, 2),
  ok AS (SELECT b.o_orderkey AS blob_id, count(p.destination) AS n_entitled, bool_and(coalesce(p.holds AND r.verified_objects > 0 AND r.verified_sequence >= b.o_orderkey AND r.verified_at >= r.success_at, false)) AS ok
    FROM orders b LEFT JOIN pairs p ON p.blob_id = b.o_orderkey LEFT JOIN proofs r ON r.destination = p.destination GROUP BY 1)
  SELECT blob_id, n_entitled, ok AND n_entitled > 0 AND blob_id % 10 <> 0 AND blob_id % 9 <> 0 AS trim FROM ok""")
def staging_trim(t: Tables) -> DataFrame:
    ms = lambda c: F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    history = t.orders.select(F.col("o_orderkey").alias("blob_id"), F.col("o_orderkey").alias("max_sequence"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("blob_id"), F.col("l_suppkey").alias("destination"), "l_returnflag", ms("l_shipdate").alias("ms"))
    proofs = lines.groupBy("destination").agg(F.count("*").alias("verified_objects"), (F.max("blob_id") - 200).alias("verified_sequence"), F.max("ms").alias("verified_ms"), F.max(F.when(F.col("l_returnflag") != "N", F.col("ms"))).alias("last_success_ms"))
    return R.staging_trim(history, history.where("blob_id % 10 = 0"), history.where("blob_id % 9 = 0"), lines.select("blob_id", "destination").distinct(), proofs, lines.where("l_returnflag <> 'R'"))


@query("""SELECT destination, set_id, coalesce(CASE WHEN region = 1 THEN 'own' END, CASE WHEN set_id % 2 = 0 THEN 'set' END, 'everything') AS policy FROM destinations""")
def destination_entitlement(t: Tables) -> DataFrame:
    sets = t.snapshots.select("set_id").distinct().where("set_id % 2 = 0").withColumn("set_policy", F.lit("set"))
    return R.entitled(t.destinations.withColumn("policy", F.when(F.col("region") == 1, "own")), sets, sets)


@query(KEPT + """ SELECT s.set_id, coalesce(k.n, 0) AS remaining, coalesce(k.n, 0) >= 28 AS accepted FROM (SELECT DISTINCT set_id FROM snapshots) s
  LEFT JOIN (SELECT set_id, count(*) AS n FROM kept GROUP BY set_id) k ON k.set_id = s.set_id""")
def retention_floor(t: Tables) -> DataFrame:
    return R.above_floor(t.snapshots.select("set_id").distinct(), _kept(t).groupBy("set_id").agg(F.count("*").alias("remaining")), 28)


@query("""r AS (SELECT DISTINCT 'c:' || CAST(c_custkey AS VARCHAR) AS node, 0 AS depth FROM customer WHERE c_custkey % 100 = 0
  UNION SELECT e.child, r.depth + 1 FROM r JOIN edges e ON e.parent = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def reachability(t: Tables) -> DataFrame:
    roots = t.customer.where("c_custkey % 100 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"))
    return G.reachable(roots, t.edges)


@query("""asked AS (SELECT DISTINCT source AS prefix FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT parent || '/none' FROM files UNION SELECT path FROM files WHERE file_id % 50 = 0)
  SELECT a.prefix, f.path, f.file_id, f.length, CASE WHEN f.path IS NULL THEN 'missing-prefix' END AS conflict FROM asked a LEFT JOIN files f ON f.path = a.prefix OR starts_with(f.path, a.prefix || '/')""")
def restore_subtree(t: Tables) -> DataFrame:
    asked = t.documents.where("source IS NOT NULL").select(F.col("source").alias("prefix")).union(t.files.select(F.concat("parent", F.lit("/none")))).union(t.files.where("file_id % 50 = 0").select("path"))
    return G.restore_plan(t.files.select("path", "file_id", "length"), asked)


@query("""r AS (SELECT DISTINCT 'c:' || CAST(c_custkey AS VARCHAR) AS node, 0 AS depth FROM customer WHERE c_custkey % 100 = 0
  UNION SELECT e.child, r.depth + 1 FROM r JOIN edges e ON e.parent = r.node), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
  SELECT node, depth FROM m WHERE node NOT IN (SELECT 'c:' || CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'o:' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 8 <> 3 UNION ALL SELECT 'p:' || CAST(p_partkey AS VARCHAR) FROM part)""")
def unreadable_nodes(t: Tables) -> DataFrame:
    named = lambda df, letter, key: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("node"))
    readable = named(t.customer, "c:", "c_custkey").union(named(t.orders.where("o_orderkey % 8 <> 3"), "o:", "o_orderkey")).union(named(t.part, "p:", "p_partkey"))
    return G.unreadable_nodes(reachability(t), readable)


@query("""entries AS (SELECT DISTINCT * FROM (SELECT 'c:' || CAST(o_custkey AS VARCHAR) AS parent, 'order ' || CAST(o_orderkey AS VARCHAR) AS name, 'o:' || CAST(o_orderkey AS VARCHAR) AS child, 'tree' AS kind FROM orders
    UNION ALL SELECT 'o:' || CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR), 'p:' || CAST(l_partkey AS VARCHAR), 'file' FROM lineitem)),
  walk AS (SELECT c_custkey AS snapshot_id, 'c:' || CAST(c_custkey AS VARCHAR) AS node, '' AS path, 'tree' AS kind, 0 AS depth FROM customer WHERE c_custkey % 10 = 0
    UNION ALL SELECT w.snapshot_id, e.child, CASE WHEN w.path = '' THEN e.name ELSE w.path || '/' || e.name END, e.kind, w.depth + 1 FROM walk w JOIN entries e ON e.parent = w.node WHERE w.kind = 'tree')
  SELECT snapshot_id, path, node, kind, depth FROM walk WHERE depth > 0""")
def projected_paths(t: Tables) -> DataFrame:
    text = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    trees = t.orders.select(text("c:", "o_custkey").alias("parent"), text("order ", "o_orderkey").alias("name"), text("o:", "o_orderkey").alias("child"), F.lit("tree").alias("kind"))
    files = t.lineitem.select(text("o:", "l_orderkey").alias("parent"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("name"), text("p:", "l_partkey").alias("child"), F.lit("file").alias("kind"))
    return G.projected_paths(t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("snapshot_id"), text("c:", "c_custkey").alias("root")), trees.union(files))


@query("""r AS (SELECT version_id, version_id AS root, 0 AS depth FROM lineage WHERE parent_version IS NULL
  UNION ALL SELECT l.version_id, r.root, r.depth + 1 FROM r JOIN lineage l ON l.parent_version = r.version_id) SELECT * FROM r""")
def version_lineage(t: Tables) -> DataFrame:
    return G.lineage(t.lineage)


@query("""s AS (SELECT parent AS directory, file_id // 100 AS shard, min(path) AS first_name, max(path) AS last_name, file_id // 100 % 4 <> 1 AS continued, file_id // 100 % 3 = 0 AS has_metadata FROM files GROUP BY ALL),
  w AS (SELECT *, lag(last_name) OVER d AS before, lead(shard) OVER d AS next, row_number() OVER d AS n FROM s WINDOW d AS (PARTITION BY directory ORDER BY shard))
  SELECT directory, shard, 'no continuation' AS defect FROM w WHERE next IS NOT NULL AND NOT continued UNION ALL SELECT directory, shard, 'dangling continuation' FROM w WHERE next IS NULL AND continued
  UNION ALL SELECT directory, shard, 'metadata beyond the first' FROM w WHERE n > 1 AND has_metadata UNION ALL SELECT directory, shard, 'names not ascending' FROM w WHERE before >= first_name""")
def tree_chain_validation(t: Tables) -> DataFrame:
    shards = t.files.withColumn("shard", F.floor(F.col("file_id") / 100)).groupBy(F.col("parent").alias("directory"), "shard").agg(F.min("path").alias("first_name"), F.max("path").alias("last_name"))
    return G.tree_chain_defects(shards.withColumn("continued", F.col("shard") % 4 != 1).withColumn("has_metadata", F.col("shard") % 3 == 0))
