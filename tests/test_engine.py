"""Operators on small frames, and every query with SQL against DuckDB."""

import base64
import hashlib
import hmac
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hashing, pathrules
from ledgerloom.functions.letters import capitals
from ledgerloom.operators import capture, catalog, dedup, graph, retention, status, sync
from ledgerloom.plans import ORACLES, QUERIES
from ledgerloom.sources import store
from ledgerloom.sources.tables import TABLES
from ledgerloom.streaming import log

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(repr([_plain(r[c]) for c in names]) for r in df.collect())
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    theirs = sorted(repr([_plain(r[columns.index(c)]) for c in names]) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize(
    ("rule", "path", "want"),
    [
        ("*.txt", "a/b/c.txt", True), ("*.txt", "a/b/c.txt\n", False), ("a/*", "a/b", True), ("a/*", "a/b/c", False), ("a/**", "a/b/c", True), ("a/**", "a", False), ("**/x", "x", True), ("**/x", "a/b/x", True),
        ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("re:a.b", "a\nb", True), ("re:[^/]+", "a/b", False), ("a.c", "abc", False), ("*", "a/b\nc", True),
    ],
)
def test_path_rules(spark, rule, path, want):
    assert spark.range(1).select(pathrules.matches(F.lit(path), rule)).first()[0] is want


def test_bad_rules():
    bad = ["", "a//b", "a**b", "re:", "re:^a", "re:a$", "re:(?i)a", r"re:\d", "re:a{", "re:a}", "re:[a", "re:(a", "re:a//b", "re:/a", "re:a/", "re:a\\", r"re:[\d]", "/a", "a/"]
    assert len(pathrules.validate(bad)) == len(bad) and pathrules.validate(["a", "re:a{2,3}[$^]", r"re:\.", "re:[/]a", "re:[]a]/b", r"re:[a\]]b"]) == []


def test_rule_sets(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("a/x/c.txt",), ("d",), (None,)], "path string")
    got = {r["path"]: (r["captured"], r["descend"]) for r in pathrules.evaluate(df, ["a"], ["a/x"]).collect()}
    assert got == {"a/b/c.txt": (True, True), "a/x/c.txt": (False, False), "d": (False, True), None: (False, False)}
    with pytest.raises(pathrules.RuleError):
        pathrules.evaluate(df, ["re:^"], ["a//b"])


def _cuts(data):
    h = dedup.rabin(np.frombuffer(data, np.uint8))
    ends = dedup.greedy_cuts(np.flatnonzero((h & np.uint64(65535)) == 0) + 1, len(data), 8192, 524288)
    return [b - a for a, b in zip([0, *ends[:-1]], ends)]


def test_cdc_vectors():
    stream = b"".join(hashlib.sha256(i.to_bytes(8, "big")).digest() for i in range(16384))
    assert _cuts(b"") == [] and _cuts(bytes(262144)) == [8192] * 32
    assert _cuts(stream)[:3] == [11012, 125580, 31046] and len(_cuts(stream)) == 9 and _cuts(b"\xa5" + stream)[:3] == [11013, 125580, 31046]
    assert _cuts(bytes([1, 2, 3, 4]) * 327680) == [524288, 524288, 262144]
    with pytest.raises(ValueError):
        dedup.check_cdc(512, 128, 4096)


def test_cdc_does_not_depend_on_pieces(spark):
    data = np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    want = _cuts(data)
    for size in (17, 50_000, 300_000):
        rows = [("s", i, data[a : a + size]) for i, a in enumerate(range(0, len(data), size))] + [("s", 1 << 40, b""), ("s", -1, None)]
        got = dedup.cdc_segments(spark.createDataFrame(rows, "stream_id string, seq long, data binary")).orderBy("index").collect()
        assert [r["length"] for r in got] == want and [r["offset"] for r in got] == [sum(want[:i]) for i in range(len(want))]


def test_cdc_pieces_come_in_small_batches(spark, monkeypatch):
    pieces = spark.range(1000).coalesce(1).select(F.lit("s").alias("stream_id"), F.col("id").alias("seq"), F.lit(b"x" * 100).alias("data"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = []
    write = dedup.Scratch.write
    count = lambda batches: (b.from_pylist([{"rows": b.num_rows}]) for b in batches)
    monkeypatch.setattr(dedup.Scratch, "write", lambda self, df, name, rows=None: sizes.extend(r["rows"] for r in write(self, pieces.mapInArrow(count, "rows long"), "n", rows).collect()) or write(self, df, name, rows))
    assert sum(r["length"] for r in dedup.cdc_segments(pieces).collect()) == 100_000
    assert sum(sizes) == 1000 and max(sizes) <= dedup.PIECES and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_hashing(spark):
    for data in (b"", b"a", b"hello", bytes(range(33))):
        want = base64.b32encode(data).decode().rstrip("=").lower()
        row = spark.createDataFrame([(bytearray(data), want)], "d binary, t string").select(hashing.base32(F.col("d")), hashing.unbase32(F.col("t")), hashing.hmac_sha256(b"k" * 70, F.col("d"))).first()
        assert tuple(row) == (want, data.hex(), hmac.new(b"k" * 70, data, "sha256").hexdigest())
    for bad in ("a1", "A", "a", "ab1", "ac3", "zz"):
        assert spark.range(1).select(hashing.unbase32(F.lit(bad))).first()[0] is None


def test_winner_of_deleted_blobs(spark):
    rows = [("x", 1, 5, 1, 1, 0, 0, 1), ("x", 2, 6, 1, 1, 0, 0, 1), ("y", 2, 1, 1, 1, 0, 0, 1), ("z", 3, 1, 1, 1, 0, 0, 1)]
    df = spark.createDataFrame(rows, "object_id string, blob_id long, generation long, writer_id long, sequence long, arrival long, physical_offset long, stored_length long")
    got = {r["object_id"]: (r["blob_id"], r["superseded"]) for r in catalog.index_winners(df, spark.createDataFrame([(2, 3)], "blob_id long, state int")).collect()}
    assert got == {"x": (1, True), "y": (None, True), "z": (3, False)}


def test_winners_in_any_order(spark, tmp_path):
    rows = [(i % 7, i % 5, i % 3, i % 11, i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "object_id long, generation long, writer_id long, sequence long, arrival long, blob_id long")
    src = str(tmp_path / "src")
    df.repartition(4, F.rand(3)).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = log.stream_winners(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
    query.awaitTermination()
    state, columns = str(tmp_path / "state"), sorted(df.columns)
    want = sorted(map(tuple, catalog.last_wins(df, ["object_id"], log.ORDER).select(columns).collect()))
    got = lambda: sorted(map(tuple, log.winners(spark, state, df.schema).select(columns).collect()))
    assert got() == want and max(max(of) for of in log._versions(spark, state).values()) > 0
    assert all(len(of) <= 2 for of in log._versions(spark, state).values())
    fold = log.fold_winners(state)
    fold(df.where("object_id < 3"), 900)  # a batch again, at a later epoch and twice
    fold(df.where("object_id < 3"), 900)
    assert got() == want
    log.fold_winners(str(tmp_path / "new"))(df, 7)  # a state that begins late
    assert log.winners(spark, str(tmp_path / "new"), df.schema).count() == 7


def test_retention_rules(spark):
    at = lambda s: F.expr(f"TIMESTAMP_NTZ'{s}'")
    rows = [(1, 1, "2026-12-31 10:00:00", 2), (2, 1, "2027-01-01 09:00:00", 2), (3, 1, "2027-01-01 09:00:00", 2), (4, 1, "2026-12-30 00:00:00", 1), (5, 1, "2020-01-01 00:00:00", 3)]
    df = spark.createDataFrame(rows, "snapshot_id long, set_id long, t string, capture_status int").withColumn("captured_at", F.col("t").cast("timestamp_ntz"))
    keep = lambda **k: {r["snapshot_id"]: r["reasons"] for r in retention.kept_snapshots(df, at("2027-01-02 00:00:00"), **k).collect()}
    assert keep(weekly_weeks=1) == {2: "weekly", 4: "weekly (complete)"}
    assert keep(min_generations=1) == {1: "min-generations", 2: "min-generations", 3: "min-generations", 4: "min-generations"}
    assert keep() == dict.fromkeys(range(1, 6), "no rule configured")
    assert spark.range(1).select(retention.iso_week(at("2027-01-01 00:00:00"))).first()[0] == "2026-W53"


def test_retention_floor_days(spark):
    rng = np.random.default_rng(5)
    rows, hours = [], 0
    for i in range(600):  # sets: often complete, never complete, rarely complete, all on one day, times unknown, with ties
        of = int(rng.integers(0, 6))
        hours = int(rng.integers(0, 4000)) if of != 3 else int(rng.integers(0, 20))
        rows.append((i, of if of < 5 else None, None if of == 4 and i % 5 else hours // 3 * 3, 2 if of == 1 or of == 2 and i % 50 else 1 + i % 2))
    df = spark.createDataFrame(rows, "snapshot_id long, set_id long, h int, capture_status int")
    df = df.selectExpr("*", "TIMESTAMP_NTZ'2027-01-01 00:00:00' - make_dt_interval(0, h) AS captured_at")
    for most in (1, 3, 40):
        want = set()
        for of in range(5):
            order = sorted((r for r in rows if r[1] == of), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
            whole = [n for n, r in enumerate(order) if r[3] == 1]
            end = whole[min(most, len(whole)) - 1] + 1 if whole else most
            want |= {(of, r[0]) for r in order[:end]}
        kept = retention.kept_snapshots(df, F.expr("TIMESTAMP_NTZ'2027-01-01 00:00:00'"), min_generations=most)
        assert {(r["set_id"], r["snapshot_id"]) for r in kept.collect()} == want
    daily = {(r["set_id"], r["snapshot_id"]): r["reasons"] for r in retention.kept_snapshots(df, F.expr("TIMESTAMP_NTZ'2027-01-01 00:00:00'"), daily_days=30).collect()}
    want = {}
    for of in (0, 1, 2, 3, 4, None):
        for day in range(32):
            order = sorted((r[2], r[0], r[3]) for r in rows if r[1] == of and r[2] is not None and r[2] <= 720 and -(-r[2] // 24) == day)
            whole = [r for r in order if r[2] == 1]
            want |= {(of, r[1]): "daily (complete)" for r in whole[:1]} | {(of, r[1]): "daily" for r in order[:1]}
    assert daily == want


def test_retention_orders_few(spark, tmp_path):
    """Only snapshots from the floor's day on are put in order, by the metrics of what ran."""
    path = str(tmp_path / "snapshots")
    spark.range(50_000).selectExpr("id AS snapshot_id", "id % 5 AS set_id", "TIMESTAMP_NTZ'2027-01-01 00:00:00' - make_dt_interval(0, CAST(id AS INT)) AS captured_at", "1 AS capture_status").write.parquet(path)
    below = lambda node: [node.children().apply(i) for i in range(node.children().size())]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan that ran is then a plain tree
    try:
        kept = retention.kept_snapshots(spark.read.parquet(path), F.expr("TIMESTAMP_NTZ'2027-01-01 00:00:00'"), 90, 26, 12, 3)
        plan = kept._jdf.queryExecution().executedPlan()
        assert len(kept.collect()) > 5 * 90
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    seen, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += below(node)
        if node.nodeName() == "WindowGroupLimit":
            first = below(node)
            while first and not first[0].metrics().contains("numOutputRows"):
                first = below(first[0])
            seen += [first[0].metrics().apply("numOutputRows").value()] if first else []
    assert seen and 0 < max(seen) < 1_000


def test_report_reads_plan_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def verdict(i):
        reads.add(1)
        return ("deletable", "partly live", "live")[i % 3]

    plan = spark.range(10).select(F.udf(verdict, "string")("id").alias("verdict"))
    rows = lambda schema, *of: spark.createDataFrame(list(of), schema)
    held = rows("snapshot_id long, laggards string, exceeded boolean", (7, "1,2", True), (8, "3", None))
    lines = status.report_lines(plan, rows("snapshot_id long, reasons string", (5, "daily")), held, rows("reason string", ("unreadable set 7",)))
    assert lines.columns == ["section", "line"]
    assert sorted(map(tuple, lines.collect())) == [
        (0, "protected: 1 snapshots"), (1, "  keep 5: daily"), (2, "  held 7: awaiting 1,2 (deferral bound exceeded)"), (2, "  held 8: awaiting 3"),
        (3, "would delete: 4 blobs"), (4, "kept whole for a live part: 3 blobs"), (5, "NO DELETION: unreadable set 7"),
    ]
    assert reads.value == 10


def test_replication_gate(spark):
    stops = [(10, 1, 5, 900), (9, 1, 5, None), (8, 1, None, 100), (7, 1, 2, 50), (6, 1, 70_000, 10), (5, 3, 4, None)]
    ids = [(i, i % 3 + 1, c, p) for i, c, p in [(0, 100, 1), (3, 100, 2), (6, 100, 3), (9, 100, 5), (12, None, 6), (150_000, 100, 70_000), (150_003, 990, 70_001), (150_006, 100, None), (1, 1, 1), (2, None, 9), (5, 7, 4)]]
    expired = spark.createDataFrame(ids, "snapshot_id long, set_id long, captured_ms long, publication_sequence long")
    gate = retention.replication_gate(expired, spark.createDataFrame(stops, "destination long, set_id long, synced_sequence long, last_success_ms long"), 1000, 500)
    want = set()
    for i, of, captured, at in ids:
        lag = sorted((d, last) for d, s, synced, last in stops if s == of and not (synced is not None and at is not None and synced >= at))
        known = [[x for x in (last, captured) if x is not None] for _, last in lag]
        want.add((of, i, bool(lag), ",".join(str(d) for d, _ in lag), any(x and 1000 - max(x) > 500 for x in known)))
    rows = gate.collect()
    assert len(rows) == len(ids) and {tuple(r) for r in rows} == want
    assert {r["exceeded"] for r in rows} == {True, False}  # never null, also where no time is known


def test_graphs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 0), (5, None)], "parent long, child long")
    assert {r["node"]: r["depth"] for r in graph.reachable(spark.createDataFrame([(3,)], "node long"), edges).collect()} == {(3 + d) % 21: d for d in range(21)}
    versions = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)] + [(100, 101), (101, 100), (200, 999)], "version_id long, parent_version long")
    assert {r["version_id"]: (r["root"], r["depth"]) for r in graph.lineage(versions).collect()} == {i: (0, i) for i in range(30)} | {200: (200, 0)}


def test_unreadable_nodes(spark):
    marked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "node string, depth int")
    found = graph.unreadable_nodes(marked, spark.createDataFrame([("b",), ("b",), (None,), ("z",)], "node string"))
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("c", 2)]
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not merged, however small names are in a shuffle


def test_tiling_and_bins(spark):
    parts = spark.createDataFrame([(1, 0, 5), (1, 5, 5), (2, 1, 4), (3, 0, 4), (3, 3, 4)], "file_id long, offset long, length long")
    assert {(r["file_id"], r["offset"], r["want"]) for r in dedup.tiling_defects(parts).collect()} == {(2, 1, 0), (3, 3, 4)}
    records = spark.createDataFrame([("s", i, n) for i, n in enumerate([50, 50, 200, 10, 10, 10, 10])], "stream_id string, seq long, size long")
    got = dedup.bin_packs(records, 150, 120, 3, header=0, footer=0).orderBy("seq").collect()
    assert [r["bin"] for r in got] == [0, 0, 1, 2, 2, 2, 3]


def test_sync(spark):
    keys = spark.createDataFrame([(k,) for k in "abcde"], "key string")
    assert [tuple(r) for r in sync.rotation(keys, "e", 2).orderBy("key").collect()] == [("a", True, "b"), ("b", True, "b")]
    assert [tuple(r) for r in sync.rotation(keys, None, 2).orderBy("key").collect()] == [("a", False, "b"), ("b", False, "b")]
    assert [tuple(r) for r in sync.rotation(keys, "c", 2).orderBy("key").collect()] == [("d", False, None), ("e", False, None)]
    assert [sync.sample_slots(16, peer, forced) for peer, forced in ((True, True), (False, True), (True, False))] == [(11, 4), (15, 0), (12, 4)] and sync.sample_slots(3, True, True) == (0, 2)
    drawn = [r["key"] for r in sync.reservoir(keys, 2, 5, forced=keys.where("key = 'a'"), drop=keys.where("key = 'b'")).where("NOT forced").collect()]
    assert len(drawn) <= 2 and not {"a", "b"} & set(drawn)
    at, n = sync.challenged_range(F.col("length"), F.col("key"), 3, 100)
    spans = keys.withColumn("length", F.lit(1000)).select(at.alias("at"), n.alias("n")).union(keys.withColumn("length", F.lit(7)).select(at, n)).collect()
    assert all(0 <= r["at"] and r["at"] + r["n"] <= 1000 and r["n"] in (100, 7) for r in spans)
    assert sync.PHASES[-1] == "snapshots/" and [r["phase"] for r in spark.createDataFrame([(k,) for k in ("repository-format", "index/delta/x", "index/y", "snapshots/1")], "key string").select(sync.phase(F.col("key")).alias("phase")).collect()] == [0, 4, 6, 7]
    quota = sync.within_quota(spark.createDataFrame([(1, i, 10) for i in range(2500)], "owner long, seq long, size long"), 12_005)
    assert quota.where("accepted").count() == 1200 and quota.agg(F.max("used")).first()[0] == 25_000
    assert sorted(status.SEVERITY, key=status.SEVERITY.get) == ["policy-compliant", "verified", "replicated", "protected", "captured", "degraded", "never-backed-up", "unrecoverable"]


def test_replica_verification_of_odd_rows(spark, tmp_path):
    sharp = "ß" + "A" * 4094 + "1" * 4095 + "."  # the last range holds no letter, but where it stands depends on the letters before
    texts = [(9, sharp), (9, "ﬁﬀ ŉ" + sharp), (27, "ᾀΐẗ\n" * 2000 + "..."), (45, "É" * 5000), (12, sharp), (1, ""), (9, ""), (3, None), (None, sharp), (None, None), (63, "no ẞ AND NO MORE " * 500)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["replica_verification"](spark, str(tmp_path)).select("key", "offset", "length", "verdict")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(ORACLES["replica_verification"]).fetchall()))


def test_capitals(spark):
    text = "".join(chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000)
    texts = [text, text[::-1], "aßb\nß", "ß", "", "plain"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(capitals(F.col("t"))).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]
    assert spark.range(1).select(capitals(F.lit(None).cast("string"))).first()[0] is None


def test_store(spark, tmp_path):
    for k in ("blobs/ab", "blobs/ac", "blobs/b", "config/x"):
        (tmp_path / k).parent.mkdir(exist_ok=True)
        (tmp_path / k).write_bytes(k.encode())
    assert [r["key"] for r in store.list_objects(spark, str(tmp_path), "blobs/a").collect()] == ["blobs/ab", "blobs/ac"]
    assert [r["key"] for r in store.list_objects(spark, str(tmp_path), "", "blobs/ac").collect()] == ["blobs/b", "config/x"]
    data = spark.createDataFrame([("k", bytearray(b"0123456789"))], "key string, data binary")
    ranges = spark.createDataFrame([("k", 2, 3), ("k", 8, 3), ("n", 0, 1)], "key string, offset long, length long")
    assert {(r["key"], r["offset"]): r["bytes"] for r in store.read_ranges(data, ranges).collect()} == {("k", 2): b"234", ("k", 8): None, ("n", 0): None}
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("k", 3)], "key string, seq long")
    assert sorted((r["key"], r["seq"], r["outcome"]) for r in store.put_if_absent(data, batch).collect()) == [("a", 1, "stored"), ("a", 2, "already-exists"), ("k", 3, "already-exists")]
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps({"a": 1}) + "\n{broken\n")
    rows, bad = store.read_ledger(spark, str(path), spark.createDataFrame([], "a long").schema)
    assert [r["a"] for r in rows.collect()] == [1] and [r["line"] for r in bad.collect()] == ["{broken"]


def test_repeated_keys(spark):
    table = spark.createDataFrame([(1, "a"), (9, "z")], "k long, v string")
    batch = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 2), (2, "e", 1)], "k long, v string, at long")
    assert sorted(map(tuple, catalog.upsert(table, batch, ["k"], "at").collect())) == [(1, "c"), (2, "d"), (9, "z")]
    assert sorted(map(tuple, catalog.insert_or_ignore(table, batch, ["k"], "at").collect())) == [(1, "a"), (2, "e"), (9, "z")]


def test_metadata_of_nulls(spark):
    columns = "path string, device long, inode long, length long, modified long, mode string, content_id string"
    now = spark.createDataFrame([("new", 1, 1, 1, None, None, "x"), ("a", 1, 2, 1, None, "5", "x"), ("b", 1, 3, 1, None, None, "x")], columns)
    was = spark.createDataFrame([("a", 1, 2, 1, 5, None, "x"), ("b", 1, 3, 1, None, None, "x")], columns)
    got = {r["path"]: (r["matched_by"], r["content_unchanged"], r["metadata_unchanged"]) for r in dedup.changes(now, was).collect()}
    assert got == {"new": ("none", False, False), "a": ("path", False, False), "b": ("path", False, True)}


def test_composed_names(spark):
    paths = spark.createDataFrame([("Cafe\u0301",), ("caf\u00e9",), ("other",), (None,)], "path string")
    assert {r["path"]: r["peers"] for r in catalog.case_collisions(paths.where("path IS NOT NULL")).collect()} == {"Cafe\u0301": 1, "caf\u00e9": 1}
    assert [r[0] for r in paths.select(catalog.casefold(F.col("path"))).collect()] == ["caf\u00e9", "caf\u00e9", "other", None]


def test_gap_verdicts(spark):
    seen = spark.createDataFrame([(1, 3), (1, 9), (2, 1)], "writer_id long, sequence long")
    voids = spark.createDataFrame([(1, 5), (1, 20), (2, 7)], "writer_id long, sequence long")
    marks = spark.createDataFrame([(1, 1)], "writer_id long, watermark long")
    for run in (2, 1 << 16):
        got = sorted(map(tuple, catalog.sequence_gaps(seen, marks, voids, spark.createDataFrame([(1, 4)], "writer_id long, age long"), run=run).collect()))
        assert got == [(1, 2, 2, "damage"), (1, 4, 4, "damage"), (1, 6, 8, "damage")]
    assert [tuple(r) for r in catalog.sequence_gaps(seen, marks).where("low > 3").collect()] == [(1, 4, 8, "unresolved")]


def test_projection_of_circles(spark):
    entries = spark.createDataFrame([("r", "a", "t", "tree"), ("r", "f", "x", "file"), ("t", "g", "y", "file"), ("t", None, "z", "file")], "parent string, name string, child string, kind string")
    got = graph.projected_paths(spark.createDataFrame([(1, "r"), (2, "t")], "snapshot_id long, root string"), entries).collect()
    assert {(r["snapshot_id"], r["path"], r["node"]) for r in got} == {(1, "a", "t"), (1, "f", "x"), (1, "a/g", "y"), (2, "g", "y")}
    plan = graph.restore_plan(spark.createDataFrame([("a/b",), ("a/bc",), ("d",)], "path string"), spark.createDataFrame([("a",), ("a/b",), ("x",), ("",)], "prefix string"))
    assert {(r["prefix"], r["path"], r["conflict"]) for r in plan.collect()} == {("a", "a/b", None), ("a", "a/bc", None), ("a/b", "a/b", None), ("x", None, "missing-prefix"), ("", "a/b", None), ("", "a/bc", None), ("", "d", None)}


def test_projection_stores_what_is_reached(spark, monkeypatch):
    tables, write = [], graph.Scratch.write
    monkeypatch.setattr(graph.Scratch, "write", lambda self, df, name: tables.append(write(self, df, name)) or tables[-1])
    rows = [("r", "a", "t", "tree"), ("r", "a", "t", "tree"), ("t", "f", "x", "file"), ("t", "f", "x", "file"), (None, "f", "x", "file")] + [(f"u{i}", "f", "x", "file") for i in range(50)]
    got = graph.projected_paths(spark.createDataFrame([(1, "r"), (2, "none")], "snapshot_id long, root string"), spark.createDataFrame(rows, "parent string, name string, child string, kind string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "t", "tree", 1), (1, "a/f", "x", "file", 2)]
    assert [t.count() for t in tables] == [2, 1, 1]  # neither trees that no snapshot reaches nor a level below the last


def test_file_digests(spark):
    parts = [(1, 5, 3, None), (1, 0, 5, bytearray(b"hello")), (1, 8, 2, bytearray(b"xy")), (2, 0, 3_000_000, None), (3, 0, 0, None)]
    got = {r["file_id"]: (r["length"], r["content_id"]) for r in dedup.file_digests(spark.createDataFrame(parts, "file_id long, offset long, length long, data binary")).collect()}
    assert got == {1: (10, hashlib.sha256(b"hello\0\0\0xy").hexdigest()), 2: (3_000_000, hashlib.sha256(bytes(3_000_000)).hexdigest())}


def test_scan_order(spark):
    nodes = [(b"a", "directory", 1, None), (b"a/b", "file", 1, None), (b"a.txt", "file", 1, None), (b"a/c", "directory", 2, None), (b"a/c/d", "file", 2, None), (b"e\xff", "directory", 1, None), (b"e\xff/x", "file", 1, None), (b"f", "directory", 1, "EACCES")]
    df = spark.createDataFrame([(bytearray(p), k, d, e) for p, k, d, e in nodes], "path binary, kind string, device long, error string")
    scan = lambda **k: [(bytes(r["path"]), r["event"]) for r in capture.scan_events(df, **k).orderBy("position").collect()]
    want = [(b"a", "enter"), (b"a/b", "leaf"), (b"a/c", "enter"), (b"a/c", "leave"), (b"a", "leave"), (b"a.txt", "leaf"), (b"e\xff", "failure"), (b"f", "failure")]
    assert scan() == want and scan(cross_mounts=True) == want[:3] + [(b"a/c/d", "leaf")] + want[3:]


def test_tree_shards(spark):
    df = spark.createDataFrame([("d", i, "n" * 10) for i in range(7)], "directory string, seq long, name string")
    assert [r["bin"] for r in dedup.tree_shards(df, budget=30, overhead=0).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 2]
