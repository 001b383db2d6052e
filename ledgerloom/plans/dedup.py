"""Queries over path rules, change detection, segmentation and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.functions import pathrules as P
from ledgerloom.operators import dedup as D
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import Tables

INCLUDES, EXCLUDES = ["src?/**", "s*0", "**/en/*", "re:[a-z]+[0-9]*/(de|fr)"], ["*7.txt", "re:.*/es/[0-9]+3[.]txt"]


@query(r"""SELECT path, captured, descend FROM (SELECT path,
  NOT (regexp_full_match(path, '(?:[^/]+/)*[^/]*7\.txt') OR regexp_full_match(path, '.*/es/[0-9]+3[.]txt')) AS descend,
  NOT (regexp_full_match(path, '(?:[^/]+/)*[^/]*7\.txt') OR regexp_full_match(path, '.*/es/[0-9]+3[.]txt')) AND (regexp_full_match(path, 'src[^/]/.+') OR regexp_full_match(path, '(?:[^/]+/)*[^/]*\.md')
    OR regexp_full_match(split_part(path, '/', 1), 's[^/]*0') OR regexp_full_match(path, '(?:[^/]+/)*en/[^/]*') OR regexp_full_match(split_part(path, '/', 1) || '/' || split_part(path, '/', 2), '[a-z]+[0-9]*/(de|fr)')) AS captured FROM files)""")
def path_rules(t: Tables) -> DataFrame:
    return P.evaluate(t.files.select("path"), INCLUDES, EXCLUDES)


@query("""SELECT url, regexp_full_match(p, '(?:[^/]*/)*[^/]*\\.HTML', 'i') AS html, regexp_full_match(p, 'm\\..*') AS mobile FROM (SELECT url, regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def url_rules(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return t.pages.select("url", P.matches(path, "re:([^/]*/)*[^/]*\\.HTML", case_sensitive=False).alias("html"), P.matches(path, "re:m\\..*").alias("mobile"))


RULES = ["src?/**", "a//b", "/a", "a/", "", "a**b", "**", "re:[a-z]+/x", "re:^a", "re:a$", "re:(?i)a", r"re:\d", r"re:\.", "re:a{", "re:a}", "re:a{2,3}", "re:[a", "re:[/]", "re:a//b", "re:/a", "re:a/", "re:"]


@query("""r AS (SELECT unnest(['src?/**', 'a//b', '/a', 'a/', '', 'a**b', '**', 're:[a-z]+/x', 're:^a', 're:a$', 're:(?i)a', 're:\\d', 're:\\.', 're:a{', 're:a}', 're:a{2,3}', 're:[a', 're:[/]', 're:a//b', 're:/a', 're:a/', 're:']) AS rule)
  SELECT rule, rule IN ('src?/**', '**', 're:[a-z]+/x', 're:\\.', 're:a{2,3}', 're:[/]') AS valid FROM r""")
def rule_validation(t: Tables) -> DataFrame:
    """All rules are judged, so a set's defects come out together."""
    return t.spark.createDataFrame([(r, not P.validate([r])) for r in RULES], "rule string, valid boolean")


@query("""now AS (SELECT * REPLACE (CASE WHEN length % 19 = 3 THEN NULL ELSE modified END AS modified, CASE WHEN length % 23 = 5 THEN NULL ELSE mode END AS mode),
    CASE WHEN length % 2 = 0 THEN replace(path, '.moved', '') END AS hint FROM current_files),
  was AS (SELECT * REPLACE (CASE WHEN length % 19 = 3 AND length % 2 = 0 THEN NULL ELSE modified END AS modified, CASE WHEN length % 23 = 5 AND length % 3 > 0 THEN NULL ELSE mode END AS mode) FROM prior_files),
  p AS (SELECT device, inode, min(path) AS path FROM was GROUP BY 1, 2),
  m AS (SELECT c.*, coalesce(a.path, p.path, h.path) AS prior_path, CASE WHEN a.path IS NOT NULL THEN 'path' WHEN p.path IS NOT NULL THEN 'identity' WHEN h.path IS NOT NULL THEN 'hint' ELSE 'none' END AS matched_by
    FROM now c LEFT JOIN was a ON a.path = c.path LEFT JOIN p ON p.device = c.device AND p.inode = c.inode LEFT JOIN was h ON h.path = c.hint)
  SELECT m.path, m.prior_path, m.matched_by, coalesce(m.modified = f.modified AND m.length = f.length AND m.device = f.device AND m.inode = f.inode, false) AS content_unchanged,
    f.path IS NOT NULL AND m.mode IS NOT DISTINCT FROM f.mode AND m.modified IS NOT DISTINCT FROM f.modified AS metadata_unchanged FROM m LEFT JOIN was f ON f.path = m.prior_path""")
def change_detection(t: Tables) -> DataFrame:
    """Times and modes are null here and there, on both sides and on one; a hint names where half of the moved files were."""
    some = lambda df, more_time, more_mode: df.withColumn("modified", F.when(F.expr(f"length % 19 = 3 {more_time}"), None).otherwise(F.col("modified"))).withColumn("mode", F.when(F.expr(f"length % 23 = 5 {more_mode}"), None).otherwise(F.col("mode")))
    now = some(t.current_files, "", "").withColumn("hint", F.when(F.col("length") % 2 == 0, F.replace("path", F.lit(".moved"), F.lit(""))))
    return D.changes(now, some(t.prior_files, "AND length % 2 = 0", "AND length % 3 > 0"))


@query("SELECT file_id, length // 2 * 1000 <= length * 950 AS half, (length - length // 25) * 1000 <= length * 950 AS little FROM files")
def compression_decision(t: Tables) -> DataFrame:
    return t.files.select("file_id", D.stores_compressed(F.floor(F.col("length") / 2), F.col("length")).alias("half"), D.stores_compressed(F.col("length") - F.floor(F.col("length") / 25), F.col("length")).alias("little"))


SEGMENTS = """raw AS (SELECT doc_id AS file_id, coalesce(source, 'none') AS source, encode(coalesce(text, '')) AS data FROM documents),
  segments AS (SELECT file_id, source, i AS index, i * 512 AS offset, CAST(octet_length(data[i * 512 + 1 : i * 512 + 512]) AS BIGINT) AS length, sha256(data[i * 512 + 1 : i * 512 + 512]) AS content_id
    FROM raw, range(0, (octet_length(data) + 511) // 512) AS r(i))"""


def _segments(t: Tables) -> DataFrame:
    return D.fixed_segments(t.documents.select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")), 512, strict=False)


@query(SEGMENTS + ' SELECT file_id, index, "offset", length, content_id FROM segments')
def fixed_segments(t: Tables) -> DataFrame:
    return _segments(t)


@query(SEGMENTS + """, f AS (SELECT *, file_id % 11 AS version, row_number() OVER (PARTITION BY content_id ORDER BY file_id % 11, file_id, index) = 1 AS stored FROM segments),
  g AS (SELECT *, version > min(version) OVER (PARTITION BY source) AS later FROM f)
  SELECT source, CAST(sum(length) AS BIGINT) AS logical, CAST(sum(CASE WHEN stored THEN length ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN later THEN length ELSE 0 END) AS BIGINT) AS later_logical,
    CAST(sum(CASE WHEN later AND stored THEN length ELSE 0 END) AS BIGINT) AS later_kept FROM g GROUP BY source""")
def dedup_ratio(t: Tables) -> DataFrame:
    sources = t.documents.select(F.col("doc_id").alias("file_id"), F.coalesce("source", F.lit("none")).alias("source"), (F.col("doc_id") % 11).alias("version"))
    return D.dedup_ratio(_segments(t).join(sources, "file_id"), "source", ["version", "file_id", "index"], "version")


@query("""raw AS (SELECT doc_id AS file_id, encode(coalesce(text, '')) AS data, octet_length(encode(coalesce(text, ''))) // 2 AS half FROM documents)
  SELECT file_id, CAST(octet_length(data) + file_id % 7 * 1000 AS BIGINT) AS length, sha256(data[1 : half] || unhex(repeat('00', CAST(file_id % 7 * 1000 AS INTEGER))) || data[half + 1 : octet_length(data)]) AS content_id
  FROM raw WHERE octet_length(data) + file_id % 7 > 0""")
def file_digests(t: Tables) -> DataFrame:
    """Each text in two segments with a hole of up to 6,000 zeros between them."""
    raw = t.documents.select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data")).withColumn("half", F.floor(F.octet_length("data") / 2)).withColumn("hole", F.col("file_id") % 7 * 1000)
    piece = lambda at, n, data: F.struct(at.cast("long").alias("offset"), n.cast("long").alias("length"), data.alias("data"))
    rest = F.octet_length("data") - F.col("half")
    parts = F.array(piece(F.col("half") + F.col("hole"), rest, F.expr("substring(data, cast(half as int) + 1)")), piece(F.col("half"), F.col("hole"), F.lit(None).cast("binary")), piece(F.lit(0), F.col("half"), F.expr("substring(data, 1, cast(half as int))")))
    return D.file_digests(raw.select("file_id", F.inline(parts)))


@query(SEGMENTS + """ SELECT c.file_id, c.index, c.length, c.content_id, p.content_id IS NOT NULL AS reused FROM segments c
  LEFT JOIN (SELECT file_id + 1 AS file_id, index, length, content_id FROM segments) p ON p.file_id = c.file_id AND p.index = c.index AND p.length = c.length AND p.content_id = c.content_id""")
def segments_reused_by_position(t: Tables) -> DataFrame:
    now = _segments(t).select("file_id", "index", "length", "content_id")
    return D.reused_by_position(now, now.withColumn("file_id", F.col("file_id") + 1))


@query(SEGMENTS + """, p AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY file_id, "offset") AS r FROM segments WHERE file_id % 3 = 0)
  SELECT c.content_id, c.length, c.file_id, c."offset", p.file_id AS prior_file, p."offset" AS prior_offset FROM segments c
  LEFT JOIN p ON p.content_id = c.content_id AND p.length = c.length AND p.r = 1 WHERE c.file_id % 3 <> 0""")
def segments_reused_by_content(t: Tables) -> DataFrame:
    s = _segments(t).select("content_id", "length", "file_id", "offset")
    return D.reused_by_content(s.where("file_id % 3 <> 0"), s.where("file_id % 3 = 0"))


@query(SEGMENTS + """, parts AS (SELECT file_id, "offset", length FROM segments WHERE (file_id + index) % 20 <> 3),
  w AS (SELECT file_id, "offset", coalesce(lag("offset" + length) OVER (PARTITION BY file_id ORDER BY "offset", length), 0) AS want FROM parts) SELECT * FROM w WHERE "offset" <> want""")
def tiling_defects(t: Tables) -> DataFrame:
    return D.tiling_defects(_segments(t).where("(file_id + index) % 20 <> 3"))


@query("""SELECT file_id, group_id, links FROM (SELECT file_id, min(file_id) OVER (PARTITION BY device, inode) AS group_id, count(*) OVER (PARTITION BY device, inode) AS links FROM files) WHERE links > 1""")
def hard_links(t: Tables) -> DataFrame:
    return D.hard_links(t.files)


@query("SELECT file_id, content_id, substr(sha256('=' || path || chr(10) || CASE WHEN file_id % 9 = 0 THEN '-' ELSE '=' || CAST(modified AS VARCHAR) END), 1, 32) AS metadata_digest FROM files")
def content_ids(t: Tables) -> DataFrame:
    files = t.files.withColumn("modified", F.when(F.col("file_id") % 9 != 0, F.col("modified")))
    return files.select("file_id", "content_id", D.metadata_digest("path", "modified").alias("metadata_digest"))


KEY = b"demonstration key"
_PAD = [bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]
_HMAC = f"sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || %s)))"
_WIDE = "unhex(printf('%%016x', CAST(%s AS BIGINT)))"


@query(f"""i AS (SELECT file_id, content_id, CAST(unhex(content_id) AS BIT)::VARCHAR || '0000' AS bits, substr({_HMAC % ("encode('file') || " + _WIDE % "device" + " || " + _WIDE % "inode")}, 1, 32) AS keyed_id,
    {_HMAC % ("encode('nonce') || encode(path) || " + _WIDE % "0" + " || " + _WIDE % "32" + " || unhex(content_id)")} AS proof FROM files)
  SELECT file_id, keyed_id, proof, array_to_string(list_transform(range(52), lambda k: substr('abcdefghijklmnopqrstuvwxyz234567', CAST('0b' || substr(bits, k * 5 + 1, 5) AS INTEGER) + 1, 1)), '') AS content_base32, true AS round_trip FROM i""")
def keyed_ids(t: Tables) -> DataFrame:
    ids = t.files.select("file_id", H.keyed_id(KEY, "file", F.col("device"), F.col("inode")).alias("keyed_id"), H.range_proof(KEY, F.lit("nonce"), F.col("path"), F.lit(0), F.unhex("content_id")).alias("proof"), "content_id")
    return ids.select("file_id", "keyed_id", "proof", H.base32(F.unhex("content_id")).alias("content_base32"), (H.unbase32(H.base32(F.unhex("content_id"))) == F.col("content_id")).alias("round_trip"))


@query()
def cdc_segments(t: Tables) -> DataFrame:
    return D.cdc_segments(D.stream_pieces(t.documents))


@query()
def cdc_segments_small(t: Tables) -> DataFrame:
    return D.cdc_segments(D.stream_pieces(t.documents), 512, 128, 4096, strict=False)


@query()
def bin_packs(t: Tables) -> DataFrame:
    return D.bin_packs(t.lineitem.select(F.col("l_suppkey").alias("stream_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("size")), 400_000, 300_000, 16)


@query()
def tree_shards(t: Tables) -> DataFrame:
    return D.tree_shards(t.files.select(F.col("parent").alias("directory"), F.col("file_id").alias("seq"), F.col("path").alias("name")), budget=400)
