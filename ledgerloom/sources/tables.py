"""Row sets of a versioned archive, as fixed projections of the star-schema tables.

Each projection is one SQL text. ``SHA(x)``, ``BYTES(x)`` and ``MS(x)`` stand for what the dialects spell differently: SHA-256 in hex,
UTF-8 length, and milliseconds since 1970 of a time without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BINDINGS = {
    "snapshots": """SELECT o_orderkey AS snapshot_id, o_custkey % 50 AS set_id, o_orderdate AS captured_at, MS(o_orderdate) AS captured_ms,
        o_orderkey AS publication_sequence, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS capture_status FROM {orders}""",
    "locations": """SELECT l_partkey AS object_id, l_orderkey AS blob_id, CAST(year(l_shipdate) AS BIGINT) AS generation, l_suppkey AS writer_id,
        l_orderkey * 10 + l_linenumber AS sequence, MS(l_shipdate) AS arrival, CAST(round(l_extendedprice * 100) AS BIGINT) AS physical_offset,
        CAST(round(l_quantity) AS BIGINT) AS stored_length FROM {lineitem}""",
    "blobs": "SELECT o_orderkey AS blob_id, CASE o_orderstatus WHEN 'P' THEN 3 ELSE 1 END AS state FROM {orders}",
    "files": """SELECT doc_id AS file_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS parent,
        coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(doc_id AS STRING) || '.txt' AS path, SHA(coalesce(text, '')) AS content_id,
        BYTES(coalesce(text, '')) AS length, n_chars AS modified, doc_id % 4 AS device, doc_id % 97 AS inode FROM {documents}""",
    "prior_files": """SELECT doc_id AS file_id, coalesce(source, 'none') || '/' || CAST(doc_id AS STRING) AS path, SHA(coalesce(text, '')) AS content_id,
        BYTES(coalesce(text, '')) AS length, n_chars AS modified, 1 AS device, doc_id AS inode, 'v' || CAST(doc_id AS STRING) AS version_id,
        coalesce(lang, 'none') AS mode FROM {documents} WHERE doc_id % 10 <> 0""",
    "current_files": """SELECT coalesce(source, 'none') || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 11 = 0 THEN '.moved' ELSE '' END AS path,
        SHA(coalesce(text, '')) AS content_id, BYTES(coalesce(text, '')) AS length, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS modified,
        1 AS device, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id END AS inode, coalesce(lang, 'none') || CASE WHEN doc_id % 17 = 0 THEN '+x' ELSE '' END AS mode FROM {documents}""",
    "lineage": "SELECT conv_id * 1000 + turn AS version_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_version FROM {conversations}",
    "journal": """SELECT user_id AS writer_id, event_id AS record_id, MS(ts) AS at_ms, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS ref,
        CASE event_type WHEN 'signup' THEN 'intent' WHEN 'click' THEN 'extension' WHEN 'purchase' THEN 'retirement' ELSE 'audit' END AS kind,
        CAST(floor(value) AS BIGINT) AS amount FROM {events}""",
    "destinations": """SELECT s.s_suppkey AS destination, s.s_suppkey % 50 AS set_id, n.n_regionkey AS region, CAST(floor(s.s_acctbal) AS BIGINT) AS free_bytes,
        m.synced AS synced_sequence, m.objects AS objects, m.last_success AS last_success_ms, CASE WHEN n.n_regionkey = 0 THEN NULL ELSE m.verified END AS verified_sequence
        FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
        LEFT JOIN (SELECT l_suppkey, max(l_orderkey) AS synced, count(*) AS objects, max(MS(l_shipdate)) AS last_success,
          max(CASE WHEN l_returnflag = 'N' THEN l_orderkey END) AS verified FROM {lineitem} GROUP BY l_suppkey) m ON m.l_suppkey = s.s_suppkey""",
    "edges": """SELECT 'c:' || CAST(o_custkey AS STRING) AS parent, 'o:' || CAST(o_orderkey AS STRING) AS child FROM {orders}
        UNION ALL SELECT 'o:' || CAST(l_orderkey AS STRING), 'p:' || CAST(l_partkey AS STRING) FROM {lineitem}""",
    "jobs": """SELECT event_id AS job_event, user_id AS set_id, user_id * 10 + event_id % 10 AS job_id, MS(ts) AS at_ms,
        CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'completed-with-failures' ELSE 'failed-recoverable' END AS state,
        CAST(floor(value) AS BIGINT) % 2 = 0 AS user_initiated FROM {events}""",
}

_SPARK = {"SHA": r"sha2(\1, 256)", "BYTES": r"CAST(octet_length(\1) AS BIGINT)", "MS": r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)"}
_DUCKDB = {"SHA": r"sha256(\1)", "BYTES": r"CAST(strlen(\1) AS BIGINT)", "MS": r"(epoch_us(\1) // 1000)"}


def _spelt(text: str, dialect: dict[str, str]) -> str:
    for name, form in dialect.items():
        text = re.sub(rf"\b{name}\(((?:[^()]|\([^()]*\))*)\)", form, text)
    return text


class Tables:
    """Tables and row sets of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BINDINGS:
            text = BINDINGS[name]
            return self.spark.sql(_spelt(text, _SPARK), **{t: getattr(self, t) for t in TABLES if "{" + t + "}" in text})
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_bindings(sql: str) -> str:
    """DuckDB SQL with the row sets it names put in front. ``sql`` is a SELECT, or common table expressions and a SELECT."""
    used = [f"{b} AS ({_spelt(text, _DUCKDB).format(**{t: t for t in TABLES})})" for b, text in BINDINGS.items() if re.search(rf"\b{b}\b", sql)]
    body, own = sql.strip(), not sql.strip().upper().startswith("SELECT")
    if not used and not own:
        return body
    return "WITH RECURSIVE " + ", ".join(used) + (", " if used and own else " ") + body
