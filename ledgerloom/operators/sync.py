"""Copies between stores: what is missing, what to drop, what to verify, and what has room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.shared import written

#: Key classes in the order in which a copy depends on them; the empty one takes whatever no other claims, snapshots come last.
PHASES = ("repository-format", "keys/", "blobs/", "journal/", "index/delta/", "index/checkpoint/", "", "snapshots/")
#: Keys that never leave the staging store; keys that no convergence drops.
EXCLUDED = ("tombstones/", "leases/")
IDENTITY_KEY, IDENTITY_PREFIX = "repository-format", "keys/"


def replicable(key: Column) -> Column:
    out = F.lit(True)
    for p in EXCLUDED:
        out = out & ~key.startswith(p)
    return out


def phase(key: Column) -> Column:
    """Rank of a key's class among ``PHASES``."""
    out = F.lit(PHASES.index(""))
    for i, p in enumerate(PHASES):
        if p:
            out = F.when(key.startswith(p), i).otherwise(out)
    return out


def missing_keys(source: DataFrame, held: DataFrame) -> DataFrame:
    """Replicable keys of the source that the copy doesn't hold, with their phase; copy them in this order."""
    return source.where(replicable(F.col("key"))).join(held.select("key").distinct(), "key", "left_anti").withColumn("phase", phase(F.col("key")))


def droppable_keys(source: DataFrame, held: DataFrame, keep: DataFrame) -> DataFrame:
    """Keys that both have, that nobody keeps, and that aren't the repository's identity; drop them by falling phase, so snapshots go first."""
    own = F.col("key") == IDENTITY_KEY
    both = held.select("key").distinct().where(~own & ~F.col("key").startswith(IDENTITY_PREFIX))
    both = both.join(source.select("key").distinct(), "key", "left_semi").join(keep.select("key").distinct(), "key", "left_anti")
    return both.withColumn("phase", phase(F.col("key")))


def kept_keys(keys: DataFrame, reachable_blobs: DataFrame, skipped_blobs: DataFrame, kept_snapshots: DataFrame) -> DataFrame:
    """Keys that a destination keeps: blobs with a reachable record or that were skipped, kept snapshots, and every other class whole."""
    wanted = reachable_blobs.select(F.concat(F.lit("blobs/"), F.col("blob_id")).alias("key")).unionByName(skipped_blobs.select(F.concat(F.lit("blobs/"), F.col("blob_id")).alias("key")))
    wanted = wanted.unionByName(kept_snapshots.select(F.concat(F.lit("snapshots/"), F.col("snapshot_id")).alias("key"))).distinct()
    decided = F.col("key").startswith("blobs/") | F.col("key").startswith("snapshots/")
    return keys.where(~decided).select("key").unionByName(keys.where(decided).select("key").join(wanted, "key", "left_semi"))


def rotation(keys: DataFrame, cursor: str | None, k: int) -> DataFrame:
    """The k smallest keys after the cursor, from the start again when there are none: key, wrapped and next_cursor.

    next_cursor is the last key taken, null where the circuit closes: no key is left after it. k + 1 keys on either side tell that, so
    there is never a full sort.
    """
    after = keys.select("key").where(F.col("key") > cursor) if cursor is not None else keys.select("key")
    first = after.orderBy("key").limit(k + 1).withColumn("wrapped", F.lit(False))
    again = keys.select("key").orderBy("key").limit(k + 1).withColumn("wrapped", F.lit(True))
    both, all_ = first.unionByName(again), Window.partitionBy(F.lit(1))
    chosen = both.withColumn("any", F.max(~F.col("wrapped")).over(all_)).where(F.col("wrapped") != F.col("any")).drop("any")
    chosen = chosen.withColumn("n", F.count("*").over(all_)).withColumn("r", F.row_number().over(all_.orderBy("key"))).where(F.col("r") <= k)
    return chosen.withColumn("next_cursor", F.when(F.col("n") > k, F.max("key").over(all_))).select("key", "wrapped", "next_cursor")


def sample_slots(budget: int, peer: bool, forced: bool, peer_share: int = 4) -> tuple[int, int]:
    """(rotation, reservoir) slots of a verification: a peer's budget lends up to ``peer_share`` to the reservoir; the forced key takes one."""
    left = max(0, budget - forced)
    reservoir = min(peer_share if peer else 0, left)
    return left - reservoir, reservoir


def reservoir(keys: DataFrame, k: int, seed: int, forced: DataFrame | None = None, drop: DataFrame | None = None) -> DataFrame:
    """A uniform sample of k keys by a keyed hash over all that aren't forced, less those that the rotation took; forced keys come on top and don't count."""
    eligible = keys.select("key").distinct()
    if forced is not None:
        eligible = eligible.join(forced.select("key").distinct(), "key", "left_anti")
    out = eligible.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(k)
    if drop is not None:
        out = out.join(drop.select("key").distinct(), "key", "left_anti")
    out = out.withColumn("forced", F.lit(False))
    return out if forced is None else out.unionByName(forced.select("key").distinct().withColumn("forced", F.lit(True)))


def challenged_range(length: Column, key: Column, seed: int, most: int, page: int = 4096) -> tuple[Column, Column]:
    """(offset, length) of the range to prove: at most a page, anywhere within the object."""
    n = F.least(length, F.lit(page), F.lit(most))
    return F.pmod(F.xxhash64(F.lit(seed), key), length - n + 1), n


def pages(keys: DataFrame, size: int) -> DataFrame:
    """key, page, more: pages of ``size`` keys in key order. Positions are added up over key ranges, so no task sees all keys."""
    ranged = written(keys.select("key").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "pages")
    heads = ranged.groupBy("part").agg(F.count("*").alias("n"))
    heads = heads.withColumn("head", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1)))).drop("n")
    at = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.col("head")
    page = F.floor(at / size)
    return ranged.join(F.broadcast(heads), "part").select("key", page.alias("page"), ((page + 1) * size < F.col("total")).alias("more"))


def replica_verdicts(sampled: DataFrame, source: DataFrame, replica: DataFrame) -> DataFrame:
    """key, verdict of sampled ranges (key, offset, length): ``skipped`` if the source can't give the range, else whether the replica's bytes are equal."""
    cut = lambda c: F.expr(f"if(octet_length({c}) >= offset + length, substring({c}, cast(offset as int) + 1, cast(length as int)), null)")
    rows = sampled.join(source.select("key", F.col("data").alias("mine")), "key", "left").join(replica.select("key", F.col("data").alias("theirs")), "key", "left")
    rows = rows.withColumn("mine", cut("mine")).withColumn("theirs", cut("theirs"))
    return rows.select("key", "offset", "length", F.when(F.col("mine").isNull(), "skipped").when(F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False)), "verified").otherwise("failed").alias("verdict"))


def blob_verdicts(blobs: DataFrame, level: int) -> DataFrame:
    """blob_id, verdict at a level: 1 footer, 2 the whole digest too, 3 every record too."""
    footer = F.coalesce(F.col("footer_records") == F.size("records"), F.lit(False))
    whole = F.coalesce(F.sha2("data", 256) == F.col("digest"), F.lit(False)) if level >= 2 else F.lit(True)
    each = F.forall("records", lambda r: F.coalesce(F.sha2(F.substring(F.col("data"), r["offset"].cast("int") + 1, r["length"].cast("int")), 256) == r["content_id"], F.lit(False))) if level >= 3 else F.lit(True)
    return blobs.select("blob_id", F.when(~footer, "footer").when(~whole, "digest").when(~each, "record").otherwise("sound").alias("verdict"))


def negotiated(offers: DataFrame) -> DataFrame:
    """Pairs of offers side by side: common features, whether each side's required ones are offered, and the protocol range both speak."""
    common = F.array_sort(F.array_intersect("a_offered", "b_offered"))
    low, high = F.greatest("a_low", "b_low"), F.least("a_high", "b_high")
    ok = (F.size(F.array_except("a_required", "b_offered")) == 0) & (F.size(F.array_except("b_required", "a_offered")) == 0)
    return offers.select("pair", F.array_join(common, ",").alias("features"), ok.alias("accepted"), F.when(low <= high, high).alias("version"))


def travelling_blobs(records: DataFrame, reachable: DataFrame) -> DataFrame:
    """Blobs with a reachable record."""
    return records.join(reachable.select("object_id").distinct(), "object_id", "left_semi").select("blob_id").distinct()


def missing_objects(files: DataFrame, refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """path of each file that can't be restored: its manifest's blob or a segment's blob isn't there. One row a path."""
    needs = files.select("path", F.col("manifest_blob").alias("blob_id")).unionByName(refs.select("path", "blob_id"))
    return needs.join(blobs.select("blob_id").distinct(), "blob_id", "left_anti").select("path").distinct()


def within_quota(objects: DataFrame, quota: int) -> DataFrame:
    """owner, seq, size, used, accepted: objects in arrival order until one would pass the owner's quota; it and later ones are refused.

    Sums run within runs of a thousand arrivals and over runs, so one owner's objects are many tasks.
    """
    rows = objects.withColumn("run", F.floor(F.col("seq") / 1000))
    heads = rows.groupBy("owner", "run").agg(F.sum("size").alias("n"))
    heads = heads.select("owner", "run", F.coalesce(F.sum("n").over(Window.partitionBy("owner").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("head"))
    used = F.sum("size").over(Window.partitionBy("owner", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) + F.col("head")
    return rows.join(heads, ["owner", "run"]).withColumn("used", used).select("owner", "seq", "size", "used", (F.col("used") <= quota).alias("accepted"))


#: Share of a quota under which a warning is due, in percent; bytes that a copy leaves free on a volume.
HEADROOM_PERCENT, FREE_SPACE_FLOOR = 10, 64 * 1024 * 1024


def headroom(destinations: DataFrame) -> DataFrame:
    """``destinations`` (quota, free_bytes, volume_free) with headroom_warning, from a tenth of the quota downwards, and below_floor, where no copy may start. No quota, or nothing known: neither."""
    low = F.col("free_bytes") <= F.floor(F.col("quota") * HEADROOM_PERCENT / 100)
    floor = F.coalesce(F.col("volume_free") < FREE_SPACE_FLOOR, F.lit(False))
    return destinations.withColumn("headroom_warning", F.coalesce((F.col("quota") > 0) & low, F.lit(False))).withColumn("below_floor", floor)


def sync_states(events: DataFrame) -> DataFrame:
    """Ledger per destination after its events (kind: success, failure, verification, sweep) in order of seq.

    Columns of events: destination, seq, at_ms, kind, sequence, objects, circuit (a sweep that closes it). Sequences only grow; failures
    count since the last success; the latest verification gives verified_ms and verified_objects; swept counts what sweeps read since the
    last closed circuit. Verifications and sweeps leave state and attempt alone. The fold is sums and maxima around a few last events, so it
    combines before the shuffle and takes events in any order.
    """
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    tries = F.col("kind").isin("success", "failure")
    latest = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seq")))
    closes = (F.col("kind") == "sweep") & F.coalesce("circuit", F.lit(False))
    last = events.groupBy("destination").agg(
        F.max(of("success", "seq")).alias("last_ok"), F.max(F.when(closes, F.col("seq"))).alias("last_circuit"), F.max(of("success", "sequence")).alias("synced_sequence"), F.max(of("verification", "sequence")).alias("verified_sequence"),
        latest("at_ms", F.col("kind") == "verification").alias("verified_ms"), latest("objects", F.col("kind") == "verification").alias("verified_objects"),
        latest("at_ms", tries).alias("last_attempt_ms"), latest("at_ms", F.col("kind") == "success").alias("last_success_ms"), latest("kind", tries).alias("last_kind"),
        latest("at_ms", F.col("kind") == "sweep").alias("swept_ms"), latest("at_ms", closes).alias("sweep_completed_ms"),
    )
    since = events.where("kind IN ('failure', 'sweep')").join(last.select("destination", "last_ok", "last_circuit"), "destination")
    failed = (F.col("kind") == "failure") & F.coalesce(F.col("seq") > F.col("last_ok"), F.lit(True))
    read = (F.col("kind") == "sweep") & F.coalesce(F.col("seq") > F.col("last_circuit"), F.lit(True))
    since = since.groupBy("destination").agg(F.count_if(failed).alias("failures"), F.sum(F.when(read, F.col("objects"))).alias("swept"))
    out = last.join(since, "destination", "left").drop("last_ok", "last_circuit")
    return out.withColumn("failures", F.coalesce("failures", F.lit(0))).withColumn("swept", F.coalesce("swept", F.lit(0)))


def should_sync(rows: DataFrame, now_ms: int, poll_s: int = 60) -> DataFrame:
    """Rows with due: no ledger: yes; in sync: if behind; unsupported: once a snapshot; else after a wait that doubles with failures, an hour at most."""
    wait = F.least(F.lit(poll_s) * F.expr("shiftleft(1, cast(least(failures, 6) as int))"), F.lit(3600)) * 1000
    due = (
        F.when(F.col("state").isNull(), True).when(F.col("state") == "in-sync", F.coalesce(F.col("synced_sequence") < F.col("latest_sequence"), F.lit(True)))
        .when(F.col("state") == "unsupported", F.coalesce(F.col("attempted_sequence") < F.col("latest_sequence"), F.lit(True))).otherwise(F.coalesce(F.lit(now_ms) >= F.col("last_attempt_ms") + wait, F.lit(True)))
    )
    return rows.withColumn("due", due)
