"""Status rules: what state a set, a destination, a job or a restore is in. All are expressions over facts; null facts never improve a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_MS = 86_400_000
#: How bad a state is; unknown ones count as 50.
SEVERITY = {"unrecoverable": 100, "never-backed-up": 90, "degraded": 80, "captured": 40, "protected": 30, "replicated": 20, "verified": 10, "policy-compliant": 0}
#: Domains whose copies outlive the source's machine.
OFF_MACHINE = ("same-site", "independent")


def severity(state: Column) -> Column:
    out = F.lit(50)
    for name, n in SEVERITY.items():
        out = F.when(state == name, n).otherwise(out)
    return out


def rollup(states: DataFrame, by: str) -> DataFrame:
    """The worst state per ``by``; ties go to the earlier row (seq), nulls are left out."""
    rank = F.struct(severity(F.col("state")), -F.col("seq"))
    return states.where("state IS NOT NULL").groupBy(by).agg(F.max_by("state", rank).alias("state"), F.max(severity(F.col("state"))).alias("severity"))


def replication_state(state: Column, active: Column, verified: Column, synced: Column, sequence: Column) -> Column:
    return (
        F.when(state == "failed", "degraded").when(verified >= sequence, "verified").when((synced >= sequence) & (synced > 0), "durable").when(active, "replicating")
        .when(state.isin("unavailable", "unsupported"), "degraded").otherwise("pending")
    )


def failure_domain(declared: Column, kind: Column, same_device: Column) -> Column:
    """Declared, else by kind: a path on another device is on the same machine, else (same or unknown) on the same volume; a peer is on the same site."""
    return F.coalesce(declared, F.when(kind == "path", F.when(~same_device, "same-machine").otherwise("same-volume")).when(kind == "peer", "same-site").otherwise("independent"))


def protection_state(sets: DataFrame, destinations: DataFrame) -> DataFrame:
    """set_id, state, claim, warnings: a set's protection from its own facts and those of each of its destinations.

    sets: set_id, latest_ms (null: nothing ever committed), missing (required objects gone), capture_status (2: partial), damage (findings).
    destinations: set_id, destination, sync (in-sync, unsupported or any other), domain, proven (the proof covers what was sent),
    provable (proofs are asked for), overdue, verified_ms, verified_objects.

    Nothing committed, then data gone, then damage come first. A copy in sync off the machine protects; the newest one proven verifies. Any
    supported destination that isn't in sync degrades a set that nothing protects; else it is only captured. claim: the time of the proof
    that verifies, else of the latest proof at any destination, none for a protected set. warnings: codes with the destination, in order.
    Null facts of a destination count as not in sync, not proven and without objects.
    """
    d = destinations
    ok, off = F.coalesce(d["sync"] == "in-sync", F.lit(False)), F.coalesce(d["domain"].isin(*OFF_MACHINE), F.lit(False))
    unsupported = F.coalesce(d["sync"] == "unsupported", F.lit(False))
    proven, provable = F.coalesce(d["proven"], F.lit(False)), F.coalesce(d["provable"], F.lit(True))
    own = (
        F.when(ok & off & ~proven & ~provable, "unprovable").when(ok & off & ~proven, "unproven").when(ok & off, None).when(ok, "same-domain").when(unsupported, "unsupported").otherwise("not-in-sync")
    )
    named = lambda code: F.concat(code, F.lit(":"), d["destination"].cast("string"))
    codes = F.array_compact(F.array(F.when(F.coalesce(d["overdue"], F.lit(False)), named(F.lit("overdue"))), named(own)))
    claim = F.when(F.coalesce(d["verified_objects"] > 0, F.lit(False)), d["verified_ms"])
    per = d.groupBy("set_id").agg(
        F.bool_or(ok & off).alias("protects"), F.bool_or(ok & off & (d["domain"] == "independent")).alias("independent"), F.bool_or(ok & ~off).alias("captures"), F.bool_or(~ok & ~unsupported).alias("lags"),
        F.max(F.when(ok & off & proven, F.coalesce(d["verified_ms"], F.lit(0)))).alias("verified"), F.max(claim).alias("claim"), F.array_sort(F.flatten(F.collect_list(codes))).alias("codes"),
    )
    rows = sets.join(per, "set_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    early = F.when(F.col("latest_ms").isNull(), "never-backed-up").when(no("missing"), "unrecoverable").when(F.coalesce(F.col("damage") > 0, F.lit(False)), "degraded")
    late = F.when(no("protects"), F.when(F.col("verified").isNotNull(), "verified").otherwise("protected")).when(no("lags"), "degraded").otherwise("captured")
    state = F.coalesce(early, late)
    partial = F.when(F.coalesce(F.col("capture_status") == 2, F.lit(False)), F.lit("partial-capture"))
    rest = F.when(no("protects"), F.when(~no("independent"), F.lit("same-site-only"))).when(~no("lags") & ~no("captures"), F.lit("no-copy"))
    warnings = (
        F.when(F.col("latest_ms").isNull(), F.array(F.lit("no-snapshot"))).when(no("missing"), F.array(F.lit("objects-missing")))
        .when(F.coalesce(F.col("damage") > 0, F.lit(False)), F.array_compact(F.array(partial, F.lit("damage"))))
        .otherwise(F.concat(F.array_compact(F.array(partial)), F.coalesce("codes", F.array().cast("array<string>")), F.array_compact(F.array(rest))))
    )
    claim = F.when(F.col("latest_ms").isNull(), None).when(early.isNull() & no("protects"), F.col("verified")).otherwise(F.col("claim"))
    return rows.select("set_id", state.alias("state"), claim.alias("claim_ms"), F.array_join(warnings, ",").alias("warnings"))


def latest_claims(destinations: DataFrame) -> DataFrame:
    """set_id, destination, verified_ms of the newest proof of any bytes, whatever state its destination is in now; ties to the smaller destination."""
    proofs = destinations.where("verified_ms IS NOT NULL AND verified_objects > 0")
    return proofs.groupBy("set_id").agg(F.min(F.struct((-F.col("verified_ms")).alias("m"), "destination")).alias("w")).select("set_id", "w.destination", (-F.col("w.m")).alias("verified_ms"))


def should_sweep(local: Column, last_success_ms: Column, swept_ms: Column, now_ms: int, interval_days: Column | None = None) -> Column:
    """Whether a local replica is due to be read again as a whole: something was copied there, and it was never swept or not for the interval (7 days)."""
    days = F.coalesce(interval_days, F.lit(7)) if interval_days is not None else F.lit(7)
    again = swept_ms.isNull() | (F.lit(now_ms) >= swept_ms + days * DAY_MS)
    return F.coalesce(local, F.lit(False)) & last_success_ms.isNotNull() & again


def shortfalls(passes: DataFrame) -> DataFrame:
    """set_id, destination, cause, copied of passes that had to copy back what an earlier success had delivered: the root was missing, or nothing was held."""
    gone, none = F.coalesce("root_missing", F.lit(False)), F.coalesce("held_at_start", F.lit(0)) <= 0
    lost = F.coalesce("prior_success", F.lit(False)) & (none | gone) & F.coalesce(F.col("copied") > 0, F.lit(False))
    return passes.where(lost).select("set_id", "destination", F.when(gone, "root-missing").otherwise("held-nothing").alias("cause"), "copied")


def report_lines(plan: DataFrame, kept: DataFrame, held: DataFrame, vetoes: DataFrame) -> DataFrame:
    """section, line: a collection plan as text, to be put out in order of both. plan: verdict; kept: snapshot_id, reasons; held: snapshot_id, laggards, exceeded; vetoes: reason."""
    n = lambda df: df.agg(F.count("*").alias("n"))
    late = F.when(F.coalesce("exceeded", F.lit(False)), " (deferral bound exceeded)").otherwise("")
    totals = plan.agg(F.count_if(F.col("verdict") == "deletable").alias("gone"), F.count_if(F.col("verdict") == "partly live").alias("partial"))
    parts = [
        n(kept).select(F.lit(0).alias("section"), F.format_string("protected: %d snapshots", "n").alias("line")),
        kept.select(F.lit(1), F.concat(F.lit("  keep "), F.col("snapshot_id").cast("string"), F.lit(": "), "reasons")),
        held.select(F.lit(2), F.concat(F.lit("  held "), F.col("snapshot_id").cast("string"), F.lit(": awaiting "), "laggards", late)),
        totals.select(F.inline(F.array(*[F.struct(F.lit(i), F.format_string(text, n)) for i, text, n in ((3, "would delete: %d blobs", "gone"), (4, "kept whole for a live part: %d blobs", "partial"))]))),
        vetoes.select(F.lit(5), F.concat(F.lit("NO DELETION: "), "reason")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def receipts(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and receipt: the other columns as JSON, in their order; null fields are left out."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("receipt"))


def progress_buffer(events: DataFrame, most: int = 256) -> DataFrame:
    """Per job the last ``most`` events by sequence, each with gap: its predecessor was dropped or never seen."""
    by = Window.partitionBy("job_id")
    kept = events.withColumn("r", F.row_number().over(by.orderBy(F.desc("sequence")))).where(F.col("r") <= most).drop("r")
    return kept.withColumn("gap", F.coalesce(F.col("sequence") != F.lag("sequence").over(by.orderBy("sequence")) + 1, F.col("sequence") > 1))


def too_large(size: Column, segment_size: int) -> Column:
    """Whether a named stream of a file is a failure, as it is larger than one segment: it is never cut short."""
    return F.coalesce(size > segment_size, F.lit(False))


def stale_for(reachable: Column, now_ms: int, last_contact_ms: Column) -> Column:
    return F.when(~F.coalesce(reachable, F.lit(False)), F.greatest(F.lit(0), F.lit(now_ms) - last_contact_ms))


def coverage(objects: Column, population: Column) -> Column:
    """Share of verified objects; 0 without a population."""
    return F.coalesce(F.try_divide(objects, population), F.lit(0.0))


def overdue(required: Column, proven_ms: Column, now_ms: int, local: Column) -> Column:
    """Whether a required proof is older than 7 days (local) or 30 (peers), in whole days; what was never proven isn't overdue but missing."""
    days = F.floor((F.lit(now_ms) - proven_ms) / DAY_MS)
    return F.coalesce(required & (days > F.when(local, 7).otherwise(30)), F.lit(False))


def restore_outcomes(items: DataFrame, planned: DataFrame) -> DataFrame:
    """plan_id, counts by result, bytes and the outcome: any failure: failed; fewer or more items than planned: cancelled; any skipped or degraded: partial."""
    n = lambda r: F.count_if(F.col("result") == r).alias(r)
    done = items.groupBy("plan_id").agg(n("restored"), n("degraded"), n("failed"), n("skipped"), F.count("*").alias("items"), F.sum("size").alias("bytes"))
    outcome = F.when(F.col("failed") > 0, "failed").when(F.coalesce("items", F.lit(0)) != F.col("planned"), "cancelled").when(F.col("skipped") + F.col("degraded") > 0, "partial").otherwise("complete")
    return planned.join(done, "plan_id", "left").select("plan_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("restored", "degraded", "failed", "skipped", "bytes")], outcome.alias("outcome"))


def path_conflicts(paths: DataFrame, limit: int) -> DataFrame:
    """Paths longer than a target's limit, in UTF-8 bytes."""
    return paths.withColumn("n_bytes", F.octet_length("path")).where(F.col("n_bytes") > limit)


def degradations(features: DataFrame) -> DataFrame:
    """set_id and what a target without the features would lose: each is named if any entry has it."""
    names = ("posix", "symlink", "special", "alternate-streams")
    some = features.groupBy("set_id").agg(*[F.bool_or(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names])
    return some.select("set_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(f"`{n}`"), F.lit(n)) for n in names])), ",").alias("losses"))


def notices(events: DataFrame) -> DataFrame:
    """key, raised_at, message of open notices: a notice is open if it was raised after its last resolution; raising again keeps the first time and takes the new message."""
    closed = events.where("kind = 'resolve'").groupBy("key").agg(F.max("seq").alias("closed"))
    open_ = events.where("kind = 'raise'").join(closed, "key", "left").where("closed IS NULL OR seq > closed")
    return open_.groupBy("key").agg(F.min_by("at_ms", "seq").alias("raised_at"), F.max_by("message", "seq").alias("message"))


def owners(claims: DataFrame) -> DataFrame:
    """Claims with accepted: a repository belongs to the first that claims it."""
    first = claims.groupBy("repository").agg(F.min_by("peer", F.struct("seq", "peer")).alias("owner"))
    return claims.join(first, "repository").select("repository", "peer", "seq", (F.col("peer") == F.col("owner")).alias("accepted"))


def schedule_due(rows: DataFrame, now_ms: int, zone: str = "UTC") -> DataFrame:
    """Rows (kind, every_ms, at_minute, last_ms) with due and next_ms.

    ``every``: counted from the last completion. ``daily``: compares wall clocks of the zone, so an hour that comes twice fires once. Missed
    runs coalesce into one; what never ran is due; manual sets never are.
    """
    wall = lambda ms: F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    today = F.date_trunc("day", wall(F.lit(now_ms))) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("at_minute"))
    slot = F.when(today <= wall(F.lit(now_ms)), today).otherwise(today - F.make_dt_interval(F.lit(1)))
    never = F.col("last_ms").isNull()
    due = F.when(F.col("kind") == "manual", False).when(never, True).when(F.col("kind") == "every", F.lit(now_ms) >= F.col("last_ms") + F.col("every_ms")).otherwise(wall(F.col("last_ms")) < slot)
    nxt = F.when(F.col("kind") == "every", F.coalesce(F.col("last_ms") + F.col("every_ms"), F.lit(now_ms))).when(F.col("kind") == "daily", F.when(due, F.lit(now_ms)).otherwise(F.unix_millis(F.to_utc_timestamp(slot + F.make_dt_interval(F.lit(1)), zone))))
    return rows.withColumn("due", due).withColumn("next_ms", nxt)


def pass_report(rows: DataFrame) -> DataFrame:
    """outcome and number of sets of one scheduler pass."""
    outcome = F.when(F.col("kind") == "manual", "manual-only").when(F.col("failed"), "failed").when(~F.col("due"), "not-due").otherwise("ran")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def read_stability(rows: DataFrame) -> DataFrame:
    """Rows with how a file was read: identity changed, never stable in so many tries, or stable."""
    stable = (F.col("length_before") == F.col("length_after")) & (F.col("modified_before") == F.col("modified_after"))
    verdict = F.when(~(F.col("identity_before") == F.col("identity_after")), "captured-identity-changed").when(~F.coalesce(stable, F.lit(False)), F.concat(F.lit("captured-inconsistent: "), F.col("tries").cast("string"))).otherwise("captured")
    return rows.withColumn("verdict", verdict)


def failure_kind(error: Column) -> Column:
    return F.when(error.isin("EACCES", "EPERM"), "permission").when(error.isin("ENOENT", "ENOTDIR"), "not-found").otherwise("io-error")


def trusts_reuse(own_writer: Column, domain: Column, verified: Column, has_blob: Column) -> Column:
    """Whether a segment that another writer stored may be reused: reuse, verify (now, then reuse), or no."""
    return (
        F.when(~F.coalesce(has_blob, F.lit(False)), "no").when(own_writer, "reuse").when(domain == "device", "no").when(domain == "repository-unverified", "reuse")
        .when(domain == "repository", F.when(verified, "reuse").otherwise("verify")).otherwise("no")
    )


def forensic_index(footers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, missing): every footer record of sound blobs, metadata blobs before data blobs, first place wins; wanted objects that none holds."""
    from ledgerloom.operators.catalog import first_wins

    index = first_wins(footers.where("sound").withColumn("rank", F.when(F.col("is_metadata"), 0).otherwise(1)).select("object_id", "rank", "blob_id", "offset"), ["object_id"], ["rank", "blob_id", "offset"])
    return index.drop("rank"), wanted.select("object_id").distinct().join(index, "object_id", "left_anti")


def forensic_reads(footers: DataFrame, wanted: DataFrame) -> DataFrame:
    """blob_id, is_metadata of the blobs that a rebuild reads: all sound metadata blobs, and sound data blobs in order up to the last that the wanted objects need.

    The last one needed is where the first places of wanted objects end, so no scan goes blob by blob.
    """
    index, _ = forensic_index(footers, wanted)
    data = footers.where("sound AND NOT is_metadata").select("blob_id").distinct()
    metadata = footers.where("sound AND is_metadata").select("blob_id").distinct()
    needed = index.join(wanted.select("object_id").distinct(), "object_id", "left_semi").join(data, "blob_id", "left_semi").agg(F.max("blob_id").alias("last"))
    read = data.join(needed, F.col("blob_id") <= F.col("last")).select("blob_id", F.lit(False).alias("is_metadata"))
    return metadata.select("blob_id", F.lit(True).alias("is_metadata")).unionByName(read)


def job_states(events: DataFrame) -> DataFrame:
    """Each job's latest state and when it was reached."""
    return events.groupBy("job_id").agg(F.max(F.struct("at_ms", "job_event", "state")).alias("w")).select("job_id", "w.state", "w.at_ms")
