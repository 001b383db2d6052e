"""Queries over copies between stores and status rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.letters import capitals
from ledgerloom.operators import status as S
from ledgerloom.operators import sync as Y
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import Tables

NOW = 996_710_400_000
KINDS = ("snapshots/", "blobs/", "tombstones/", "index/delta/", "other/", "journal/", "keys/", "index/checkpoint/", "leases/", "trees/")
KEYS = """named AS (SELECT CASE WHEN o_orderkey = 1 THEN 'repository-format' ELSE CASE o_orderkey % 10 WHEN 0 THEN 'snapshots/' WHEN 1 THEN 'blobs/' WHEN 2 THEN 'tombstones/' WHEN 3 THEN 'index/delta/' WHEN 4 THEN 'other/'
      WHEN 5 THEN 'journal/' WHEN 6 THEN 'keys/' WHEN 7 THEN 'index/checkpoint/' WHEN 8 THEN 'leases/' ELSE 'trees/' END || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS key, o_orderkey AS n FROM orders),
  keys AS (SELECT key, n, CASE WHEN starts_with(key, 'repository-format') THEN 0 WHEN starts_with(key, 'keys/') THEN 1 WHEN starts_with(key, 'blobs/') THEN 2 WHEN starts_with(key, 'journal/') THEN 3
      WHEN starts_with(key, 'index/delta/') THEN 4 WHEN starts_with(key, 'index/checkpoint/') THEN 5 WHEN starts_with(key, 'snapshots/') THEN 7 ELSE 6 END AS phase FROM named)"""


def _keys(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, KINDS)), (n % 10).cast("int") + 1), F.lpad(n.cast("string"), 10, "0"))
    return t.orders.select(F.when(n == 1, "repository-format").otherwise(name).alias("key"), n.alias("n"))


@query(KEYS + " SELECT key, phase FROM keys WHERE n % 3 <> 0 AND NOT starts_with(key, 'tombstones/') AND NOT starts_with(key, 'leases/')")
def inventory_diff(t: Tables) -> DataFrame:
    keys = _keys(t)
    return Y.missing_keys(keys.select("key"), keys.where("n % 3 = 0").select("key"))


@query(KEYS + " SELECT key, phase FROM keys WHERE (n % 3 = 0 OR n < 20) AND n % 4 <> 0 AND key <> 'repository-format' AND NOT starts_with(key, 'keys/')")
def convergence_difference(t: Tables) -> DataFrame:
    keys = _keys(t)
    return Y.droppable_keys(keys, keys.where("n % 3 = 0 OR n < 20"), keys.where("n % 4 = 0"))


@query(KEYS + " SELECT key FROM keys WHERE CASE WHEN n = 1 THEN true WHEN n % 10 = 1 THEN n % 3 = 0 OR n % 7 = 0 WHEN n % 10 = 0 THEN n % 4 = 0 ELSE true END")
def convergence_keep(t: Tables) -> DataFrame:
    keys = _keys(t)
    ids = lambda where, name: keys.where(where).select(F.lpad(F.col("n").cast("string"), 10, "0").alias(name))
    return Y.kept_keys(keys, ids("n % 3 = 0", "blob_id"), ids("n % 7 = 0", "blob_id"), ids("n % 4 = 0", "snapshot_id"))


@query(KEYS + ", r AS (SELECT key FROM keys WHERE key > 'index/delta/0000000500' ORDER BY key LIMIT 16) SELECT key, false AS wrapped, max(key) OVER () AS next_cursor FROM r")
def rotation_after_cursor(t: Tables) -> DataFrame:
    return Y.rotation(_keys(t), "index/delta/0000000500", 16)


@query(KEYS + ", r AS (SELECT key FROM keys ORDER BY key LIMIT 16) SELECT key, true AS wrapped, max(key) OVER () AS next_cursor FROM r")
def rotation_wrapped(t: Tables) -> DataFrame:
    return Y.rotation(_keys(t), "zzz", 16)


@query(KEYS + " SELECT key, false AS wrapped, CAST(NULL AS VARCHAR) AS next_cursor FROM keys WHERE key > 'trees/'")
def rotation_closing(t: Tables) -> DataFrame:
    """More slots than keys are left: the circuit closes, so there is no next cursor."""
    keys = _keys(t)
    return Y.rotation(keys, "trees/", keys.count() + 1)


@query()
def verification_sample(t: Tables) -> DataFrame:
    keys = _keys(t)
    newest = keys.where("key LIKE 'snapshots/%'").agg(F.max("key").alias("key"))
    turns, drawn = Y.sample_slots(16, peer=True, forced=True)
    round_ = Y.rotation(keys.join(newest, "key", "left_anti"), None, turns).select("key")
    out = Y.reservoir(keys, drawn, 7, forced=newest, drop=round_).unionByName(round_.withColumn("forced", F.lit(False)))
    offset, length = Y.challenged_range(F.lit(100_000), F.col("key"), 7, 65_536)
    return out.withColumn("offset", offset).withColumn("length", length)


@query(KEYS + ", r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS total FROM keys) SELECT key, i // 250 AS page, (i // 250 + 1) * 250 < total AS more FROM r")
def key_pages(t: Tables) -> DataFrame:
    return Y.pages(_keys(t), 250)


@query("SELECT job_event, set_id, user_initiated, at_ms FROM jobs WHERE state = 'queued'")
def job_queue(t: Tables) -> DataFrame:
    return t.jobs.where("state = 'queued'").select("job_event", "set_id", "user_initiated", "at_ms").orderBy("set_id", F.desc("user_initiated"), "at_ms", "job_event")


@query("""d AS (SELECT doc_id, encode(text) AS mine, encode(CASE WHEN doc_id % 9 = 0 THEN upper(text) ELSE text END) AS theirs FROM documents),
  r AS (SELECT doc_id, unnest(range(0, greatest(octet_length(mine), 1), 4096)) AS pos, mine, theirs FROM d WHERE mine IS NOT NULL UNION ALL SELECT doc_id, 0, mine, theirs FROM d WHERE mine IS NULL),
  c AS (SELECT doc_id, pos, CASE WHEN mine IS NULL THEN 4096 ELSE least(4096, octet_length(mine) - pos) END AS n, mine, theirs FROM r)
  SELECT CAST(doc_id AS VARCHAR) AS key, CAST(pos AS BIGINT) AS "offset", CAST(n AS BIGINT) AS length, CASE WHEN mine IS NULL THEN 'skipped' WHEN doc_id % 6 = 0 THEN 'failed' WHEN octet_length(theirs) >= pos + n AND mine[pos + 1 : pos + n] = theirs[pos + 1 : pos + n] THEN 'verified' ELSE 'failed' END AS verdict FROM c""")
def replica_verification(t: Tables) -> DataFrame:
    """Every range of 4 KiB of every document, in both stores."""
    # Each row is an object of its own, whether its doc_id is null or another's too.
    row = F.struct(F.col("doc_id").cast("string").alias("id"), "_metadata.file_path", "_metadata.row_index")
    docs = t.documents.select(row.alias("key"), "doc_id", "text", F.octet_length("text").cast("long").alias("n"))
    theirs = docs.where("doc_id IS NULL OR doc_id % 6 <> 0").select("key", F.when(F.col("doc_id") % 9 == 0, capitals(F.col("text"))).otherwise(F.col("text")).cast("binary").alias("data"))
    at = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    ranges = docs.select("key", "n", F.explode(at).alias("offset")).select("key", "offset", F.coalesce(F.least(F.lit(4096), F.col("n") - F.col("offset")), F.lit(4096)).alias("length"))
    return Y.replica_verdicts(ranges, docs.select("key", F.col("text").cast("binary").alias("data")), theirs).withColumn("key", F.col("key.id"))


@query("""SELECT doc_id AS blob_id, CASE WHEN doc_id % 5 = 0 THEN 'footer' WHEN doc_id % 7 = 0 THEN 'digest' WHEN doc_id % 11 = 0 THEN 'record' ELSE 'sound' END AS verdict FROM documents""")
def blob_verification(t: Tables) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    half = F.floor(F.octet_length("data") / 2).cast("int")
    rows = t.documents.select(F.col("doc_id").alias("blob_id"), data.alias("data")).withColumn("half", half)
    record = lambda a, n, spoil: F.struct(a.cast("int").alias("offset"), n.cast("int").alias("length"), F.concat(F.sha2(F.substring(F.col("data"), a + 1, n), 256), F.when(spoil, "x").otherwise("")).alias("content_id"))
    records = F.array(record(F.lit(0), F.col("half"), F.col("blob_id") % 11 == 0), record(F.col("half"), F.octet_length("data") - F.col("half"), F.lit(False)))
    rows = rows.withColumn("records", records).withColumn("footer_records", F.when(F.col("blob_id") % 5 == 0, 3).otherwise(2)).withColumn("digest", F.when(F.col("blob_id") % 7 == 0, "x").otherwise(F.sha2("data", 256)))
    return Y.blob_verdicts(rows, 3)


@query("""o AS (SELECT c_custkey AS pair, ['a', 'b', 'c'][1 : 1 + c_custkey % 3] AS ao, ['c', 'b', 'a'][1 : 1 + c_custkey % 2] AS bo, c_custkey % 4 AS al, c_custkey % 4 + 2 AS ah, c_custkey % 7 AS bl, c_custkey % 7 + 1 AS bh FROM customer)
  SELECT pair, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(list_intersect(ao, bo)) AS x)), '') AS features, list_contains(bo, 'b') AS accepted,
    CASE WHEN greatest(al, bl) <= least(ah, bh) THEN least(ah, bh) END AS version FROM o""")
def negotiation(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    letters = lambda names, k: F.slice(F.array(*map(F.lit, names)), F.lit(1), (1 + n % k).cast("int"))
    rows = t.customer.select(n.alias("pair"), letters("abc", 3).alias("a_offered"), letters("cba", 2).alias("b_offered"), F.array(F.lit("b")).alias("a_required"), F.array().cast("array<string>").alias("b_required"), (n % 4).alias("a_low"), (n % 4 + 2).alias("a_high"), (n % 7).alias("b_low"), (n % 7 + 1).alias("b_high"))
    return Y.negotiated(rows)


@query("SELECT DISTINCT blob_id FROM locations WHERE object_id % 7 = 0")
def travelling_blobs(t: Tables) -> DataFrame:
    return Y.travelling_blobs(t.locations, t.locations.where("object_id % 7 = 0"))


@query("""needs AS (SELECT o_orderkey AS path, o_orderkey % 997 AS blob FROM orders UNION ALL SELECT l_orderkey, l_partkey FROM lineitem)
  SELECT DISTINCT path FROM needs WHERE blob NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def missing_objects(t: Tables) -> DataFrame:
    files = t.orders.select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 997).alias("manifest_blob"))
    return Y.missing_objects(files, t.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("blob_id")), t.part.where("p_size < 40").select(F.col("p_partkey").alias("blob_id")))


@query("""u AS (SELECT o_custkey % 20 AS owner, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)
  SELECT owner, seq, size, CAST(sum(size) OVER (PARTITION BY owner ORDER BY seq) AS BIGINT) AS used, sum(size) OVER (PARTITION BY owner ORDER BY seq) <= 50000000 AS accepted FROM u""")
def quota_usage(t: Tables) -> DataFrame:
    return Y.within_quota(t.orders.select((F.col("o_custkey") % 20).alias("owner"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").alias("size")), 50_000_000)


LEDGER = """l AS (SELECT writer_id AS destination, record_id AS seq, ref AS sequence, at_ms, amount AS objects, record_id % 7 = 0 AS circuit,
    CASE kind WHEN 'intent' THEN 'success' WHEN 'extension' THEN 'verification' WHEN 'retirement' THEN 'sweep' ELSE 'failure' END AS kind FROM journal),
  m AS (SELECT destination, max(seq) FILTER (kind = 'success') AS ok, max(seq) FILTER (kind = 'sweep' AND circuit) AS closed, max(sequence) FILTER (kind = 'success') AS synced_sequence, max(sequence) FILTER (kind = 'verification') AS verified_sequence,
    arg_max(at_ms, seq) FILTER (kind = 'verification') AS verified_ms, arg_max(objects, seq) FILTER (kind = 'verification') AS verified_objects, arg_max(at_ms, seq) FILTER (kind IN ('success', 'failure')) AS last_attempt_ms,
    arg_max(at_ms, seq) FILTER (kind = 'success') AS last_success_ms, arg_max(kind, seq) FILTER (kind IN ('success', 'failure')) AS last_kind, arg_max(at_ms, seq) FILTER (kind = 'sweep') AS swept_ms, arg_max(at_ms, seq) FILTER (kind = 'sweep' AND circuit) AS sweep_completed_ms FROM l GROUP BY 1),
  ledger AS (SELECT m.* EXCLUDE (ok, closed), (SELECT count(*) FROM l WHERE l.destination = m.destination AND kind = 'failure' AND (m.ok IS NULL OR seq > m.ok)) AS failures,
    CAST(coalesce((SELECT sum(objects) FROM l WHERE l.destination = m.destination AND kind = 'sweep' AND (m.closed IS NULL OR seq > m.closed)), 0) AS BIGINT) AS swept FROM m)"""


def _ledger(t: Tables) -> DataFrame:
    kind = F.when(F.col("kind") == "intent", "success").when(F.col("kind") == "extension", "verification").when(F.col("kind") == "retirement", "sweep").otherwise("failure")
    return Y.sync_states(t.journal.select(F.col("writer_id").alias("destination"), F.col("record_id").alias("seq"), F.col("ref").alias("sequence"), "at_ms", F.col("amount").alias("objects"), (F.col("record_id") % 7 == 0).alias("circuit"), kind.alias("kind")))


@query(LEDGER + " SELECT * FROM ledger")
def sync_ledger(t: Tables) -> DataFrame:
    return _ledger(t)


@query(LEDGER + """ SELECT destination, failures, CASE WHEN last_kind IS NULL THEN true WHEN last_kind = 'success' THEN coalesce(synced_sequence < 95, true)
    ELSE coalesce(1706659200000 >= last_attempt_ms + least(60 * (1 << least(failures, 6)), 3600) * 1000, true) END AS due FROM ledger""")
def sync_backoff(t: Tables) -> DataFrame:
    state = F.when(F.col("last_kind") == "success", "in-sync").when(F.col("last_kind") == "failure", "failing")
    rows = _ledger(t).withColumn("state", state).withColumn("latest_sequence", F.lit(95)).withColumn("attempted_sequence", F.lit(None).cast("long"))
    return Y.should_sync(rows, 1_706_659_200_000).select("destination", "failures", "due")


@query(LEDGER + """ SELECT destination, destination % 3 <> 0 AND last_success_ms IS NOT NULL AND (swept_ms IS NULL OR 1706659200000 >= swept_ms + CASE WHEN destination % 5 = 0 THEN 14 ELSE 7 END * 86400000) AS due FROM ledger""")
def sweep_due(t: Tables) -> DataFrame:
    interval = F.when(F.col("destination") % 5 == 0, 14)
    return _ledger(t).select("destination", S.should_sweep(F.col("destination") % 3 != 0, F.col("last_success_ms"), F.col("swept_ms"), 1_706_659_200_000, interval).alias("due"))


@query("""SELECT destination, set_id, objects * 1000000 AS quota, free_bytes, CASE WHEN destination % 7 > 0 THEN free_bytes * 20000 END AS volume_free,
    objects > 0 AND free_bytes * 20000 <= objects * 1000000 // 10 AS headroom_warning, coalesce(destination % 7 > 0 AND free_bytes * 20000 < 67108864, false) AS below_floor FROM destinations WHERE objects IS NOT NULL""")
def destination_headroom(t: Tables) -> DataFrame:
    rows = t.destinations.where("objects IS NOT NULL").select("destination", "set_id", (F.col("objects") * 1_000_000).alias("quota"), F.col("free_bytes").alias("own"), (F.col("free_bytes") * 20_000).alias("free_bytes"), F.when(F.col("destination") % 7 > 0, F.col("free_bytes") * 20_000).alias("volume_free"))
    return Y.headroom(rows).drop("free_bytes").withColumnRenamed("own", "free_bytes")


@query("""p AS (SELECT set_id, destination, destination % 4 > 0 AS prior, CASE WHEN destination % 3 = 0 THEN 0 WHEN destination % 5 > 0 THEN objects END AS held, destination % 6 = 1 AS missing, coalesce(objects, 0) % 11 AS copied FROM destinations)
  SELECT set_id, destination, CASE WHEN missing THEN 'root-missing' ELSE 'held-nothing' END AS cause, copied FROM p WHERE prior AND (coalesce(held, 0) <= 0 OR missing) AND copied > 0""")
def destination_shortfalls(t: Tables) -> DataFrame:
    d = F.col("destination")
    held = F.when(d % 3 == 0, 0).when(d % 5 > 0, F.col("objects"))
    return S.shortfalls(t.destinations.select("set_id", "destination", (d % 4 > 0).alias("prior_success"), held.alias("held_at_start"), (d % 6 == 1).alias("root_missing"), (F.coalesce("objects", F.lit(0)) % 11).alias("copied")))


# Status


@query("""s AS (SELECT set_id, job_event AS seq, CASE WHEN set_id % 6 = 0 AND state = 'queued' THEN 'unrecoverable' WHEN set_id % 4 = 0 AND state = 'queued' THEN 'never-backed-up' WHEN state = 'queued' THEN 'captured' WHEN set_id % 3 > 0 AND state = 'failed-recoverable' THEN 'degraded'
      WHEN state = 'running' THEN 'replicated' WHEN state = 'complete' THEN 'protected' WHEN set_id % 5 = 0 AND state = 'completed-with-failures' THEN 'odd' WHEN set_id % 5 = 1 THEN 'verified' ELSE 'policy-compliant' END AS state FROM jobs),
  v AS (SELECT *, CASE state WHEN 'unrecoverable' THEN 100 WHEN 'never-backed-up' THEN 90 WHEN 'degraded' THEN 80 WHEN 'captured' THEN 40 WHEN 'protected' THEN 30 WHEN 'replicated' THEN 20 WHEN 'verified' THEN 10 WHEN 'policy-compliant' THEN 0 ELSE 50 END AS severity FROM s)
  SELECT set_id, state, severity FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY severity DESC, seq) AS r FROM v) WHERE r = 1""")
def status_rollup(t: Tables) -> DataFrame:
    state = F.expr("""CASE WHEN set_id % 6 = 0 AND state = 'queued' THEN 'unrecoverable' WHEN set_id % 4 = 0 AND state = 'queued' THEN 'never-backed-up' WHEN state = 'queued' THEN 'captured' WHEN set_id % 3 > 0 AND state = 'failed-recoverable' THEN 'degraded'
      WHEN state = 'running' THEN 'replicated' WHEN state = 'complete' THEN 'protected' WHEN set_id % 5 = 0 AND state = 'completed-with-failures' THEN 'odd' WHEN set_id % 5 = 1 THEN 'verified' ELSE 'policy-compliant' END""")
    return S.rollup(t.jobs.select("set_id", F.col("job_event").alias("seq"), state.alias("state")), "set_id")


@query("""SELECT destination, CASE WHEN region = 4 THEN 'degraded' WHEN verified_sequence >= 14900 THEN 'verified' WHEN synced_sequence >= 14900 AND synced_sequence > 0 THEN 'durable' WHEN destination % 2 = 0 THEN 'replicating'
    WHEN region = 3 THEN 'degraded' ELSE 'pending' END AS state, CASE region WHEN 0 THEN 'offsite' WHEN 1 THEN CASE WHEN destination % 3 = 0 THEN 'same-machine' ELSE 'same-volume' END WHEN 2 THEN 'same-site' ELSE 'independent' END AS domain,
    CASE WHEN destination % 4 = 0 THEN greatest(0, 996710400000 - last_success_ms) END AS stale_ms, coalesce(1e0 * objects / nullif(destination, 0), 0) AS coverage,
    coalesce(region <> 2 AND (996710400000 - last_success_ms) // 86400000 > CASE WHEN region = 1 THEN 7 ELSE 30 END, false) AS overdue FROM destinations""")
def destination_status(t: Tables) -> DataFrame:
    d, region = F.col("destination"), F.col("region")
    state = F.when(region == 4, "failed").when(region == 3, "unavailable").otherwise("idle")
    kind = F.when(region == 1, "path").when(region == 2, "peer").otherwise("remote")
    return t.destinations.select(
        "destination", S.replication_state(state, d % 2 == 0, F.col("verified_sequence"), F.col("synced_sequence"), F.lit(14900)).alias("state"), S.failure_domain(F.when(region == 0, "offsite"), kind, F.when(d % 3 == 0, F.lit(False))).alias("domain"),
        S.stale_for(d % 4 != 0, NOW, F.col("last_success_ms")).alias("stale_ms"), S.coverage(F.col("objects"), d).alias("coverage"), S.overdue(region != 2, F.col("last_success_ms"), NOW, region == 1).alias("overdue"),
    )


# Facts of destinations, six to a set: how they sync, where they are, and what was proven of them.
PROTECTION = """d AS (SELECT c_custkey AS destination, c_custkey // 6 AS set_id, CASE WHEN c_custkey % 11 < 4 THEN 'in-sync' WHEN c_custkey % 11 < 9 AND c_custkey // 6 % 4 > 0 THEN 'unsupported' WHEN c_custkey % 13 > 0 AND c_custkey // 6 % 3 > 0 THEN NULL WHEN c_custkey // 6 % 5 = 0 THEN 'unsupported' ELSE 'failed' END AS sync,
      CASE c_nationkey % 5 WHEN 0 THEN 'same-volume' WHEN 1 THEN 'same-machine' WHEN 2 THEN 'same-site' WHEN 3 THEN 'independent' END AS domain, c_custkey % 3 = 0 AS proven, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 > 1 END AS provable,
      c_custkey % 9 = 0 AS overdue, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 1000 END AS verified_ms, CASE WHEN c_custkey % 8 < 6 THEN c_custkey % 3 END AS verified_objects FROM customer),
  s AS (SELECT set_id, CASE WHEN set_id % 9 > 0 THEN set_id END AS latest_ms, set_id % 10 = 1 AS missing, CASE set_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS capture_status, CASE WHEN set_id % 8 = 3 THEN set_id END AS damage FROM (SELECT DISTINCT c_custkey // 6 AS set_id FROM customer UNION SELECT -4 UNION SELECT -1))"""


def _protection(t: Tables) -> tuple[DataFrame, DataFrame]:
    n, set_id = F.col("c_custkey"), F.floor(F.col("c_custkey") / 6)
    sync = F.when(n % 11 < 4, "in-sync").when((n % 11 < 9) & (set_id % 4 > 0), "unsupported").when((n % 13 > 0) & (set_id % 3 > 0), None).when(set_id % 5 == 0, "unsupported").otherwise("failed")
    domain = F.element_at(F.array(*[F.lit(x) for x in ("same-volume", "same-machine", "same-site", "independent", None)]), F.col("c_nationkey").cast("int") % 5 + 1)
    rows = t.customer.select(
        n.alias("destination"), set_id.alias("set_id"), sync.alias("sync"), domain.alias("domain"), (n % 3 == 0).alias("proven"), F.when(n % 7 > 0, n % 7 > 1).alias("provable"), (n % 9 == 0).alias("overdue"),
        F.when(n % 4 > 0, n * 1000).alias("verified_ms"), F.when(n % 8 < 6, n % 3).alias("verified_objects"),
    )
    sets = rows.select("set_id").distinct().union(t.spark.createDataFrame([(-4,), (-1,)], "set_id long"))
    k = F.col("set_id")
    return sets.select("set_id", F.when(k % 9 != 0, k).alias("latest_ms"), (k % 10 == 1).alias("missing"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).alias("capture_status"), F.when(k % 8 == 3, k).alias("damage")), rows


@query(PROTECTION.replace("set_id % 9 > 0", "set_id % 9 <> 0") + """, w AS (SELECT *, coalesce(sync = 'in-sync', false) AS ok, coalesce(domain IN ('same-site', 'independent'), false) AS off_machine, coalesce(sync = 'unsupported', false) AS unsup FROM d),
  codes AS (SELECT set_id, 'overdue:' || destination AS code FROM w WHERE overdue UNION ALL SELECT set_id, CASE WHEN NOT ok THEN CASE WHEN unsup THEN 'unsupported' ELSE 'not-in-sync' END WHEN NOT off_machine THEN 'same-domain' WHEN coalesce(provable, true) THEN 'unproven' ELSE 'unprovable' END || ':' || destination FROM w
    WHERE NOT (ok AND off_machine AND proven)),
  p AS (SELECT set_id, bool_or(ok AND off_machine) AS protects, bool_or(ok AND coalesce(domain = 'independent', false)) AS independent, bool_or(ok AND NOT off_machine) AS captures, bool_or(NOT ok AND NOT unsup) AS lags,
    max(CASE WHEN ok AND off_machine AND proven THEN coalesce(verified_ms, 0) END) AS verified, max(CASE WHEN verified_objects > 0 THEN verified_ms END) AS claim, (SELECT string_agg(code, ',' ORDER BY code) FROM codes c WHERE c.set_id = w.set_id) AS codes FROM w GROUP BY set_id)
  SELECT s.set_id, CASE WHEN latest_ms IS NULL THEN 'never-backed-up' WHEN missing THEN 'unrecoverable' WHEN damage > 0 THEN 'degraded' WHEN protects AND verified IS NOT NULL THEN 'verified' WHEN protects THEN 'protected' WHEN lags THEN 'degraded' ELSE 'captured' END AS state,
    CASE WHEN latest_ms IS NULL THEN NULL WHEN NOT missing AND coalesce(damage <= 0, true) AND protects THEN verified ELSE claim END AS claim_ms,
    CASE WHEN latest_ms IS NULL THEN 'no-snapshot' WHEN missing THEN 'objects-missing' ELSE concat_ws(',', CASE WHEN capture_status = 2 THEN 'partial-capture' END, CASE WHEN damage > 0 THEN 'damage' ELSE
      nullif(concat_ws(',', codes, CASE WHEN protects THEN CASE WHEN NOT independent THEN 'same-site-only' END WHEN NOT coalesce(lags, false) AND NOT coalesce(captures, false) THEN 'no-copy' END), '') END) END AS warnings
  FROM s LEFT JOIN p ON p.set_id = s.set_id""")
def protection_status(t: Tables) -> DataFrame:
    return S.protection_state(*_protection(t))


@query(PROTECTION + " SELECT set_id, arg_min(destination, struct_pack(m := -verified_ms, d := destination)) AS destination, max(verified_ms) AS verified_ms FROM d WHERE verified_ms IS NOT NULL AND verified_objects > 0 GROUP BY set_id")
def latest_claims(t: Tables) -> DataFrame:
    return S.latest_claims(_protection(t)[1])


@query("""i AS (SELECT l_orderkey AS plan_id, CASE WHEN l_partkey % 40 = 0 THEN 'failed' WHEN l_partkey % 9 = 0 THEN 'skipped' WHEN l_partkey % 11 = 0 THEN 'degraded' ELSE 'restored' END AS result, CAST(round(l_quantity) AS BIGINT) AS size FROM lineitem),
  g AS (SELECT plan_id, count(*) FILTER (result = 'restored') AS restored, count(*) FILTER (result = 'degraded') AS degraded, count(*) FILTER (result = 'failed') AS failed, count(*) FILTER (result = 'skipped') AS skipped, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM i GROUP BY 1)
  SELECT o_orderkey AS plan_id, coalesce(restored, 0) AS restored, coalesce(degraded, 0) AS degraded, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, coalesce(bytes, 0) AS bytes,
    CASE WHEN failed > 0 THEN 'failed' WHEN coalesce(items, 0) <> o_orderkey % 8 THEN 'cancelled' WHEN skipped + degraded > 0 THEN 'partial' ELSE 'complete' END AS outcome FROM orders LEFT JOIN g ON g.plan_id = o_orderkey""")
def restore_outcomes(t: Tables) -> DataFrame:
    p = F.col("l_partkey")
    result = F.when(p % 40 == 0, "failed").when(p % 9 == 0, "skipped").when(p % 11 == 0, "degraded").otherwise("restored")
    items = t.lineitem.select(F.col("l_orderkey").alias("plan_id"), result.alias("result"), F.round("l_quantity").cast("long").alias("size"))
    return S.restore_outcomes(items, t.orders.select(F.col("o_orderkey").alias("plan_id"), (F.col("o_orderkey") % 8).alias("planned")))


@query("SELECT path, CAST(strlen(path) AS INTEGER) AS n_bytes FROM files WHERE strlen(path) > 13")
def path_limit_conflicts(t: Tables) -> DataFrame:
    return S.path_conflicts(t.files.select("path"), 13)


@query("""SELECT parent AS set_id, concat_ws(',', CASE WHEN bool_or(file_id % 5 = 0) THEN 'posix' END, CASE WHEN bool_or(file_id % 7 = 0) THEN 'symlink' END, CASE WHEN bool_or(file_id % 11 = 0) THEN 'special' END, CASE WHEN bool_or(file_id % 23 = 0) THEN 'alternate-streams' END) AS losses FROM files GROUP BY parent""")
def restore_degradations(t: Tables) -> DataFrame:
    flag = lambda n, name: (F.col("file_id") % n == 0).alias(name)
    return S.degradations(t.files.select(F.col("parent").alias("set_id"), flag(5, "posix"), flag(7, "symlink"), flag(11, "special"), flag(23, "alternate-streams")))


@query("""e AS (SELECT ref AS key, record_id AS seq, at_ms, kind, writer_id AS message FROM journal WHERE kind IN ('intent', 'retirement'))
  SELECT key, min(at_ms) AS raised_at, arg_max(message, seq) AS message FROM e WHERE kind = 'intent' AND seq > coalesce((SELECT max(seq) FROM e c WHERE c.key = e.key AND c.kind = 'retirement'), -1) GROUP BY key""")
def open_notices(t: Tables) -> DataFrame:
    kind = F.when(F.col("kind") == "intent", "raise").otherwise("resolve")
    return S.notices(t.journal.where("kind IN ('intent', 'retirement')").select(F.col("ref").alias("key"), F.col("record_id").alias("seq"), "at_ms", kind.alias("kind"), F.col("writer_id").alias("message")))


@query("SELECT ref AS repository, writer_id AS peer, record_id AS seq, writer_id = first_value(writer_id) OVER (PARTITION BY ref ORDER BY record_id) AS accepted FROM journal")
def first_claims(t: Tables) -> DataFrame:
    return S.owners(t.journal.select(F.col("ref").alias("repository"), F.col("writer_id").alias("peer"), F.col("record_id").alias("seq")))


SCHEDULE = """s AS (SELECT c_custkey AS set_id, CASE c_custkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'every' ELSE 'daily' END AS kind, (c_custkey % 50 + 1) * 3600000 AS every_ms, CAST(c_custkey % 1440 AS INTEGER) AS at_minute,
    CASE WHEN c_custkey % 10 <> 9 THEN 1711843200000 - (c_custkey % 72) * 1800000 END AS last_ms FROM customer),
  d AS (SELECT *, CASE WHEN at_minute <= 0 THEN 0 ELSE -86400000 END + 1711843200000 + at_minute * 60000 AS slot FROM s),
  due AS (SELECT *, CASE WHEN kind = 'manual' THEN false WHEN last_ms IS NULL THEN true WHEN kind = 'every' THEN 1711843200000 >= last_ms + every_ms ELSE last_ms < slot END AS due FROM d)"""


def _schedule(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    kind = F.when(n % 3 == 0, "manual").when(n % 3 == 1, "every").otherwise("daily")
    rows = t.customer.select(n.alias("set_id"), kind.alias("kind"), ((n % 50 + 1) * 3_600_000).alias("every_ms"), (n % 1440).cast("int").alias("at_minute"), F.when(n % 10 != 9, F.lit(1_711_843_200_000) - (n % 72) * 1_800_000).alias("last_ms"))
    return S.schedule_due(rows, 1_711_843_200_000)


@query(SCHEDULE + """ SELECT set_id, due, CASE kind WHEN 'every' THEN coalesce(last_ms + every_ms, 1711843200000) WHEN 'daily' THEN CASE WHEN due THEN 1711843200000 ELSE slot + 86400000 END END AS next_ms FROM due""")
def schedule_due(t: Tables) -> DataFrame:
    return _schedule(t).select("set_id", "due", "next_ms")


@query(SCHEDULE + """ SELECT CASE WHEN kind = 'manual' THEN 'manual-only' WHEN set_id % 17 = 0 THEN 'failed' WHEN NOT due THEN 'not-due' ELSE 'ran' END AS outcome, count(*) AS n FROM due GROUP BY 1""")
def schedule_pass(t: Tables) -> DataFrame:
    return S.pass_report(_schedule(t).withColumn("failed", F.col("set_id") % 17 == 0))


@query("""SELECT file_id, CASE WHEN file_id % 13 = 0 THEN 'captured-identity-changed' WHEN file_id % 7 = 0 OR file_id % 5 = 0 THEN 'captured-inconsistent: 3' ELSE 'captured' END AS verdict,
  CASE file_id % 4 WHEN 0 THEN 'permission' WHEN 1 THEN 'not-found' ELSE 'io-error' END AS failure, length > 1000 AS too_large FROM files""")
def read_outcomes(t: Tables) -> DataFrame:
    n = F.col("file_id")
    rows = t.files.select("file_id", "length", n.alias("identity_before"), F.when(n % 13 == 0, -n - 1).otherwise(n).alias("identity_after"), F.col("length").alias("length_before"), F.when(n % 7 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length_after"), F.col("modified").alias("modified_before"), F.when(n % 5 == 0, None).otherwise(F.col("modified")).alias("modified_after"), F.lit(3).alias("tries"))
    error = F.when(n % 4 == 0, "EACCES").when(n % 4 == 1, "ENOENT").when(n % 4 == 2, "EIO")
    return S.read_stability(rows).select("file_id", "verdict", S.failure_kind(error).alias("failure"), S.too_large(F.col("length"), 1000).alias("too_large"))


@query("""SELECT object_id, sequence, CASE WHEN blob_id % 9 = 0 THEN 'no' WHEN writer_id % 5 = 0 THEN 'reuse' WHEN object_id % 4 = 0 THEN 'no' WHEN object_id % 4 = 1 THEN 'reuse' WHEN object_id % 4 = 2 THEN CASE WHEN generation > 1998 THEN 'reuse' ELSE 'verify' END ELSE 'no' END AS verdict FROM locations""")
def reuse_trust(t: Tables) -> DataFrame:
    domain = F.element_at(F.array(*map(F.lit, ("device", "repository-unverified", "repository", "elsewhere"))), (F.col("object_id") % 4).cast("int") + 1)
    return t.locations.select("object_id", "sequence", S.trusts_reuse(F.col("writer_id") % 5 == 0, domain, F.col("generation") > 1998, F.col("blob_id") % 9 != 0).alias("verdict"))


@query("""f AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY CASE WHEN blob_id % 4 = 0 THEN 0 ELSE 1 END, blob_id, physical_offset) AS r FROM locations WHERE blob_id % 3 <> 0) SELECT object_id, blob_id, physical_offset AS offset_in_blob FROM f WHERE r = 1""")
def forensic_index(t: Tables) -> DataFrame:
    footers = t.locations.select("object_id", "blob_id", F.col("physical_offset").alias("offset"), (F.col("blob_id") % 3 != 0).alias("sound"), (F.col("blob_id") % 4 == 0).alias("is_metadata"))
    return S.forensic_index(footers, t.locations)[0].withColumnRenamed("offset", "offset_in_blob")


@query("SELECT DISTINCT object_id FROM locations WHERE object_id NOT IN (SELECT object_id FROM locations WHERE blob_id % 3 = 1 AND stored_length > 40)")
def forensic_missing(t: Tables) -> DataFrame:
    footers = t.locations.select("object_id", "blob_id", F.col("physical_offset").alias("offset"), ((F.col("blob_id") % 3 == 1) & (F.col("stored_length") > 40)).alias("sound"), F.lit(False).alias("is_metadata"))
    return S.forensic_index(footers, t.locations)[1]


@query("""f AS (SELECT object_id, blob_id, physical_offset, blob_id % 4 = 0 AS metadata FROM locations WHERE blob_id % 3 <> 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY NOT metadata, blob_id, physical_offset) AS r FROM f),
  last AS (SELECT max(blob_id) AS last FROM r WHERE r = 1 AND NOT metadata AND object_id % 50 = 0)
  SELECT DISTINCT blob_id, metadata AS is_metadata FROM f WHERE metadata OR blob_id <= (SELECT last FROM last)""")
def forensic_reads(t: Tables) -> DataFrame:
    footers = t.locations.select("object_id", "blob_id", F.col("physical_offset").alias("offset"), (F.col("blob_id") % 3 != 0).alias("sound"), (F.col("blob_id") % 4 == 0).alias("is_metadata"))
    return S.forensic_reads(footers, t.locations.where("object_id % 50 = 0"))


@query("""e AS (SELECT job_id, job_event AS sequence, row_number() OVER (PARTITION BY job_id ORDER BY job_event DESC) AS r FROM jobs)
  SELECT job_id, sequence, coalesce(sequence <> lag(sequence) OVER (PARTITION BY job_id ORDER BY sequence) + 1, sequence > 1) AS gap FROM e WHERE r <= 4""")
def progress_buffer(t: Tables) -> DataFrame:
    return S.progress_buffer(t.jobs.select("job_id", F.col("job_event").alias("sequence")), 4)


@query("""SELECT job_event, '{"job_id":' || job_id || ',"at_ms":' || at_ms || ',"state":"' || state || '"' || CASE WHEN job_event % 5 > 0 THEN ',"user_initiated":' || user_initiated ELSE '' END || '}' AS receipt FROM jobs""")
def job_receipts(t: Tables) -> DataFrame:
    return S.receipts(t.jobs.select("job_event", "job_id", "at_ms", "state", F.when(F.col("job_event") % 5 > 0, F.col("user_initiated")).alias("user_initiated")), "job_event")


@query("SELECT job_id, arg_max(state, job_event) AS state, max(at_ms) AS at_ms FROM jobs GROUP BY job_id")
def job_states(t: Tables) -> DataFrame:
    return S.job_states(t.jobs)


@query("""s AS (SELECT job_id, arg_max(state, job_event) AS state, max(at_ms) AS at_ms FROM jobs GROUP BY job_id)
  SELECT job_id // 10 AS set_id, count(*) FILTER (state = 'failed-recoverable') AS recoverable, count(*) FILTER (state IN ('complete', 'completed-with-failures')) AS committed FROM s GROUP BY 1""")
def recoverable_jobs(t: Tables) -> DataFrame:
    done = F.col("state").isin("complete", "completed-with-failures")
    return S.job_states(t.jobs).groupBy(F.floor(F.col("job_id") / 10).alias("set_id")).agg(F.count_if(F.col("state") == "failed-recoverable").alias("recoverable"), F.count_if(done).alias("committed"))
