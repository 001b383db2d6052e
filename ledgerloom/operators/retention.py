"""Retention: which snapshots stay and why, what may leave, and what must wait for destinations.

Unknown, missing and unreadable facts widen protection: nulls count as "not proven" and "still needed". The clock is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMPLETE = 1
CLOCK_SKEW_MS = 300_000
DAY_MS = 86_400_000
GATE_BOUND_MS = 30 * DAY_MS
SNAPSHOT_BLOCK = 1 << 16
RULES = ("daily", "weekly", "monthly")


def iso_week(at: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), at), F.weekofyear(at))


def starts(now: Column, daily_days: int | None, weekly_weeks: int | None, monthly_months: int | None) -> dict[int, Column]:
    """Where the window of each given rule begins, by its place in RULES; months go back by the calendar and keep the time of day."""
    out = {}
    if daily_days is not None:
        out[0] = now - F.make_dt_interval(F.lit(daily_days))
    if weekly_weeks is not None:
        out[1] = now - F.make_dt_interval(F.lit(7 * weekly_weeks))
    if monthly_months is not None:
        out[2] = now - F.make_ym_interval(F.lit(0), F.lit(monthly_months))
    return out


def buckets(at: Column, begin: dict[int, Column]) -> Column:
    """Array of (ord, rule, bucket) that a capture time falls in, by the windows' ``starts``."""
    names = (F.date_format(at, "yyyy-MM-dd"), iso_week(at), F.date_format(at, "yyyy-MM"))
    return F.array_compact(F.array(*[F.when(at >= start, F.struct(F.lit(i).alias("ord"), names[i].alias("bucket"))) for i, start in begin.items()]))


def kept_snapshots(snapshots: DataFrame, now: Column, daily_days: int | None = None, weekly_weeks: int | None = None, monthly_months: int | None = None, min_generations: int | None = None) -> DataFrame:
    """set_id, snapshot_id, reasons: snapshots that any rule keeps, with the rules' names in order.

    The newest snapshot of each calendar bucket inside a rule's window stays (ties: the smaller id), and the bucket's newest complete one
    too if that isn't it. The floor keeps everything down to a set's Nth complete snapshot; down to the last complete one if there are fewer;
    the newest N if none is complete. Without rules all stay.

    Snapshots are counted by set and day first, those inside a window by their time; these sums and least ids need no sort. Buckets are
    made of them, and only snapshots from the day on in which a set's floor lies are put in order, N rows a set, so a set with most of the
    snapshots is no hot task.
    """
    if daily_days is weekly_weeks is monthly_months is min_generations is None:
        return snapshots.select("set_id", "snapshot_id", F.lit("no rule configured").alias("reasons"))
    complete = F.coalesce(F.col("capture_status") == COMPLETE, F.lit(False))
    day = F.coalesce(F.unix_date(F.to_date("captured_at")), F.lit(-(1 << 31)))  # unknown times are the oldest
    begin = starts(now, daily_days, weekly_weeks, monthly_months)
    recent = [F.when(F.col("captured_at") >= F.array_min(F.array(*begin.values())), F.col("captured_at")).alias("captured_at")] if begin else []
    counts = F.count("*").alias("n"), F.count_if(complete).alias("n_whole")
    days = snapshots.groupBy("set_id", day.alias("day"), *recent).agg(F.min("snapshot_id").alias("id"), F.min(F.when(complete, F.col("snapshot_id"))).alias("whole_id"), *counts)
    parts = []
    if begin:
        top = lambda key: F.struct("captured_at", (-F.col(key)).alias("minus_id"))
        rows = days.withColumn("b", F.explode(buckets(F.col("captured_at"), begin)))
        tops = rows.groupBy("set_id", "b").agg(F.max(top("id")).alias("any"), F.max(F.when(F.col("n_whole") > 0, top("whole_id"))).alias("whole"))
        name = F.element_at(F.array(*map(F.lit, RULES)), F.col("b.ord") + 1)
        pick = F.array(F.struct(F.col("any.minus_id").alias("m"), name.alias("reason")), F.when(F.col("whole.minus_id") != F.col("any.minus_id"), F.struct(F.col("whole.minus_id").alias("m"), F.concat(name, F.lit(" (complete)")).alias("reason"))))
        parts.append(tops.select("set_id", F.col("b.ord").alias("ord"), F.explode(F.array_compact(pick)).alias("p")).select("set_id", (-F.col("p.m")).alias("snapshot_id"), "ord", "p.reason"))
    if min_generations is not None:
        newer = Window.partitionBy("set_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
        sums = days.groupBy("set_id", "day").agg(F.sum("n").alias("n"), F.sum("n_whole").alias("n_whole"))
        sums = sums.select("set_id", "day", "n_whole", F.sum("n").over(newer).alias("all"), F.sum("n_whole").over(newer).alias("whole"))
        reached = lambda total: F.max(F.when(F.col(total) >= min_generations, F.col("day")))
        since = F.coalesce(reached("whole"), F.min(F.when(F.col("n_whole") > 0, F.col("day"))), reached("all"), F.min("day"))
        near = snapshots.join(F.broadcast(sums.groupBy("set_id").agg(since.alias("since"))), "set_id").where(day >= F.col("since"))

        newest = F.struct("captured_at", (-F.col("snapshot_id")).alias("minus_id"))
        by = Window.partitionBy("set_id", "whole").orderBy(F.desc("captured_at"), "snapshot_id")
        top = near.withColumn("whole", complete).withColumn("r", F.row_number().over(by)).where(F.col("r") <= min_generations)
        last = top.groupBy("set_id").agg(F.min(F.when(F.col("whole"), newest)).alias("whole"))
        plain = near.withColumn("r", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("captured_at"), "snapshot_id"))).where(F.col("r") <= min_generations)
        last = last.join(plain.groupBy("set_id").agg(F.min(newest).alias("plain")), "set_id").select("set_id", F.coalesce("whole", "plain").alias("last"))
        floor = near.join(last, "set_id").where(newest >= F.col("last"))
        parts.append(floor.select("set_id", "snapshot_id", F.lit(3).alias("ord"), F.lit("min-generations").alias("reason")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    reasons = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "reason"))), lambda x: x["reason"]), ",")
    return rows.groupBy("set_id", "snapshot_id").agg(reasons.alias("reasons"))


def replication_gate(expired: DataFrame, destinations: DataFrame, now_ms: int, bound_ms: int = GATE_BOUND_MS) -> DataFrame:
    """What holds each expired snapshot: destinations of its set that haven't synced it (null: never).

    held: some lag; exceeded: the longest a laggard has been silent (since its last success, at least since the capture) is over the
    bound. A set without destinations holds nothing. A set's destinations are a configured list, one row that is broadcast. Who lags
    depends only on the least synced sequence of the set that is not below the snapshot's, so lists of laggards are made once for all
    snapshots between two such sequences (in blocks of ids, so that no group grows without bound), not once for each.
    """
    columns = F.struct("destination", F.col("destination").cast("string").alias("name"), "synced_sequence", "last_success_ms")
    seen = destinations.groupBy("set_id").agg(F.array_sort(F.collect_list(columns)).alias("all"))
    marks = F.array_sort(F.array_distinct(F.filter(F.transform("all", lambda d: d["synced_sequence"]), lambda x: x.isNotNull())))
    rows = expired.join(F.broadcast(seen.select("set_id", marks.alias("marks"))), "set_id", "left").withColumn("below", F.lit(0))
    for k in range(30, -1, -1):  # marks below the sequence, by halves; plain steps, as a lambda over them would have each row carry all marks
        n = F.col("below") + (1 << k)
        rows = rows.withColumn("below", F.when(F.get("marks", n - 1) < F.col("publication_sequence"), n).otherwise(F.col("below")))
    upto = F.when(F.col("publication_sequence").isNotNull(), F.get("marks", F.col("below")))
    rows = rows.select("set_id", "snapshot_id", "captured_ms", upto.alias("upto"), F.floor(F.col("snapshot_id") / SNAPSHOT_BLOCK).alias("block"))
    groups = rows.groupBy("set_id", "upto", "block").agg(F.collect_list(F.struct("snapshot_id", "captured_ms")).alias("snapshots"))

    lag = F.filter(F.coalesce("all", F.array()), lambda d: ~F.coalesce(d["synced_sequence"] >= F.col("upto"), F.lit(False)))
    last = F.transform("lag", lambda d: d["last_success_ms"])
    groups = groups.join(F.broadcast(seen), "set_id", "left").select("set_id", "snapshots", lag.alias("lag"))
    groups = groups.select("set_id", "snapshots", (F.size("lag") > 0).alias("held"), F.array_join(F.transform("lag", lambda d: d["name"]), ",").alias("laggards"), F.array_min(last).alias("oldest"), F.exists(last, lambda x: x.isNull()).alias("never"))
    out = groups.select("set_id", "held", "laggards", "oldest", "never", F.explode("snapshots").alias("s"))
    since = F.when(F.col("never") & F.col("s.captured_ms").isNotNull(), F.col("s.captured_ms")).otherwise(F.greatest("oldest", "s.captured_ms"))
    silent = F.col("held") & F.coalesce(F.lit(now_ms) - since > bound_ms, F.lit(False))
    return out.select("set_id", "s.snapshot_id", "held", "laggards", silent.alias("exceeded"))


def intents(journal: DataFrame) -> DataFrame:
    """journal's intents with the duration that their extensions leave them: the largest of all."""
    base = journal.where("kind = 'intent'").groupBy("writer_id", "ref").agg(F.max("at_ms").alias("issued_ms"), F.max("amount").alias("amount"))
    more = journal.where("kind = 'extension'").groupBy("writer_id", "ref").agg(F.max("amount").alias("extended"))
    return base.join(more, ["writer_id", "ref"], "left").withColumn("duration_ms", F.greatest("amount", "extended") * 3_600_000)


def live_intents(journal: DataFrame, now_ms: int, generation_passed: bool = True, skew_ms: int = CLOCK_SKEW_MS) -> DataFrame:
    """writer_id, ref, expires_ms of intents neither retired nor expired. One whose end is unknown never expires."""
    gone = journal.where("kind = 'retirement'").select("writer_id", "ref").distinct()
    ends = F.col("issued_ms") + F.col("duration_ms") + skew_ms
    expired = F.coalesce(F.lit(now_ms) >= ends, F.lit(False)) & F.lit(generation_passed)
    return intents(journal).join(gone, ["writer_id", "ref"], "left_anti").where(~expired).select("writer_id", "ref", ends.alias("expires_ms"))


def intent_survey(journal: DataFrame, blobs: DataFrame, now_ms: int, generation_passed: bool = True, skew_ms: int = CLOCK_SKEW_MS) -> DataFrame:
    """blob_id of every blob that a live intent covers: what it and its extensions name; every one of ``blobs`` if any record can't be parsed.

    journal: as for ``live_intents``, with blob_id (what an intent or extension names, null for none) and kind ``unparseable`` for records
    that can't be read. Failing to collect wastes space; collecting wrongly loses data.
    """
    live = live_intents(journal, now_ms, generation_passed, skew_ms).select("writer_id", "ref")
    named = journal.where("kind IN ('intent', 'extension') AND blob_id IS NOT NULL").join(live, ["writer_id", "ref"], "left_semi").select("blob_id")
    unread = journal.where("kind = 'unparseable'").select(F.lit(1).alias("unread")).limit(1)
    return named.unionByName(blobs.select("blob_id").join(unread, F.lit(True), "left_semi")).distinct()


def collection_plan(records: DataFrame, reachable: DataFrame, covered: DataFrame, vetoed: bool = False) -> DataFrame:
    """blob_id, n_records, n_reachable, verdict of each blob: deletable only without a reachable record and an intent; a veto stops all."""
    marks = reachable.select("object_id").distinct().withColumn("mark", F.lit(1))
    blobs = records.join(marks, "object_id", "left").groupBy("blob_id").agg(F.count("*").alias("n_records"), F.count("mark").alias("n_reachable"))
    blobs = blobs.join(covered.select("blob_id").distinct().withColumn("covered", F.lit(True)), "blob_id", "left")
    verdict = F.when(F.col("n_reachable") == F.col("n_records"), "live").when(F.col("n_reachable") > 0, "partly live").when(F.col("covered"), "covered").when(F.lit(vetoed), "vetoed").otherwise("deletable")
    return blobs.select("blob_id", "n_records", "n_reachable", verdict.alias("verdict"))


def sweep(tombstones: DataFrame, plan: DataFrame, present: DataFrame, sequence: int) -> DataFrame:
    """blob_id and verdict of each tombstone against a fresh plan: waiting until the sequence after it; absent blobs clear a generation later."""
    rows = tombstones.join(plan.select("blob_id", F.col("verdict").alias("fresh")), "blob_id", "left").join(present.select("blob_id").distinct().withColumn("here", F.lit(True)), "blob_id", "left")
    verdict = (
        F.when(F.lit(sequence) < F.col("sequence") + 1, "waiting").when(F.col("here").isNull() & (F.lit(sequence) >= F.col("sequence") + 2), "clear").when(F.col("here").isNull(), "absent")
        .when(F.col("fresh").isin("live", "partly live"), "damage").when(F.col("fresh") == "deletable", "delete").otherwise("keep")
    )
    return rows.select("blob_id", verdict.alias("verdict"))


def entitled(destinations: DataFrame, set_policy: DataFrame, kept: DataFrame) -> DataFrame:
    """destination, set_id, policy: the destination's own policy, else its set's, else everything."""
    return destinations.join(set_policy.select("set_id", "set_policy"), "set_id", "left").select("destination", "set_id", F.coalesce("policy", "set_policy", F.lit("everything")).alias("policy"))


def staging_trim(history: DataFrame, newest: DataFrame, covered: DataFrame, entitled_to: DataFrame, proofs: DataFrame, held: DataFrame) -> DataFrame:
    """blob_id, n_entitled, trim: blobs of the whole history that may leave the staging store.

    A blob may go if the newest snapshot and no intent needs it, some destination is entitled to it, and every one of these is proven
    (verified_objects > 0, verified_sequence >= the blob's, verified_ms >= last_success_ms) and holds it.
    """
    proven = (F.col("verified_objects") > 0) & (F.col("verified_sequence") >= F.col("max_sequence")) & (F.col("verified_ms") >= F.col("last_success_ms"))
    rows = history.join(entitled_to, "blob_id", "left").join(proofs, "destination", "left").join(held.select("blob_id", "destination").distinct().withColumn("holds", F.lit(True)), ["blob_id", "destination"], "left")
    ok = rows.groupBy("blob_id").agg(F.count("destination").alias("n_entitled"), F.bool_and(F.coalesce(proven & F.col("holds"), F.lit(False))).alias("ok"))
    needed = newest.select("blob_id").unionByName(covered.select("blob_id")).distinct().withColumn("needed", F.lit(True))
    return ok.join(needed, "blob_id", "left").select("blob_id", "n_entitled", (F.col("ok") & (F.col("n_entitled") > 0) & F.col("needed").isNull()).alias("trim"))


def above_floor(instructions: DataFrame, remaining: DataFrame, floor: int) -> DataFrame:
    """set_id, remaining, accepted: an instruction is refused as a whole if it leaves fewer snapshots than the peer's floor."""
    return instructions.join(remaining, "set_id", "left").select("set_id", F.coalesce("remaining", F.lit(0)).alias("remaining"), (F.coalesce("remaining", F.lit(0)) >= floor).alias("accepted"))
