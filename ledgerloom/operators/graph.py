"""Reachability, subtrees and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.shared import Scratch


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node and depth (fewest steps) of everything that ``roots`` (node) lead to over ``edges`` (parent, child).

    A frontier is joined with the edges and freed of what was seen in one anti-join; each round is written to the shared folder, so plans
    stay short and a lost executor costs one round. Edges are read as they stand: a repeated one adds nothing once children are distinct.
    Null nodes lead nowhere.
    """
    scratch = Scratch(roots.sparkSession, "mark")
    edges = edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL")
    frontier = scratch.write(roots.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "round")
    rounds, depth = [frontier], 0
    while True:
        depth += 1
        nxt = frontier.join(edges, frontier["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        nxt = nxt.join(_all(rounds).select("node"), "node", "left_anti")
        frontier = scratch.write(nxt.withColumn("depth", F.lit(depth)), "round")
        if frontier.isEmpty():
            return _all(rounds)
        rounds.append(frontier)
        if len(rounds) > 32:  # few tables, however long the paths
            seen = scratch.write(_all(rounds), "seen")
            scratch.drop(*rounds[:-1])
            rounds = [seen]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unreadable_nodes(marked: DataFrame, readable: DataFrame) -> DataFrame:
    """node, depth of marked nodes that can't be read: what hangs below them is unknown, so whoever collects must stop at them, not skip them.

    Readable nodes may be all there are, so both sides meet in one aggregation. Its number of partitions is fixed: names shrink to a few
    bytes in a shuffle, and merging partitions by such sizes would put millions of them in one task.
    """
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = marked.select("node", "depth", F.lit(False).alias("readable"))
    rows = rows.unionByName(readable.where("node IS NOT NULL").select("node", F.lit(None).cast(marked.schema["depth"].dataType).alias("depth"), F.lit(True).alias("readable")))
    met = rows.repartition(parts, "node").groupBy("node").agg(F.min("depth").alias("depth"), F.bool_and("readable").alias("unmarked"), F.bool_or("readable").alias("readable"))
    return met.where("NOT unmarked AND NOT readable").select("node", "depth")


def projected_paths(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """snapshot_id, path, node, kind, depth of every entry of every snapshot: names joined with slashes from the snapshot's root down.

    snapshots: snapshot_id, root. entries: parent, name, child, kind ('tree' leads on). Each level is one join of what the level above
    reached; a tree that several snapshots share has a path in each. Entries are cut down to those of trees just reached before they are
    made distinct, so what no snapshot reaches is neither shuffled twice nor stored. An entry of null name or child, and a path of more
    than 1,024 levels (a circle), ends there.
    """
    scratch = Scratch(snapshots.sparkSession, "paths")
    entries = entries.select("parent", "name", "child", "kind").where("parent IS NOT NULL AND name IS NOT NULL AND child IS NOT NULL")
    level = scratch.write(snapshots.select("snapshot_id", F.col("root").alias("node"), F.lit("").alias("path"), F.lit("tree").alias("kind"), F.lit(0).alias("depth")).distinct(), "level")
    rounds: list[DataFrame] = []
    for depth in range(1, 1025):
        trees = level.where("kind = 'tree'").select("snapshot_id", F.col("node").alias("parent"), F.col("path").alias("above"))
        if trees.isEmpty():
            break
        path = F.when(F.col("above") == "", F.col("name")).otherwise(F.concat("above", F.lit("/"), "name"))
        near = entries.join(trees.select("parent"), "parent", "left_semi").distinct()
        level = scratch.write(trees.join(near, "parent").select("snapshot_id", F.col("child").alias("node"), path.alias("path"), "kind", F.lit(depth).alias("depth")), "level")
        rounds.append(level)
    out = _all(rounds or [level])
    return out.select("snapshot_id", "path", "node", "kind", "depth")


def subtree(tree: DataFrame, prefix: str) -> DataFrame:
    """Entries at or below a path (all for the empty one); no recursion, as paths carry their ancestors."""
    return tree.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/") | F.lit(prefix == ""))


def restore_plan(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """prefix, path and tree's other columns, conflict: the entries at or below each asked prefix in path order; one row with a conflict for a prefix that nothing stands at or below.

    Each entry meets the asked prefixes among its own ancestors, so there is an equi-join and no pairing of all with all.
    """
    rest = [c for c in tree.columns if c != "path"]
    parts = F.split("path", "/")
    above = tree.withColumn("prefix", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))))
    found = asked.select("prefix").distinct().join(above, "prefix", "left")
    return found.select("prefix", "path", *rest, F.when(F.col("path").isNull(), "missing-prefix").alias("conflict"))


def lineage(versions: DataFrame) -> DataFrame:
    """version_id, root and depth: each version's oldest ancestor and its distance, by pointer doubling.

    The number of rounds is the logarithm of the longest chain. A parent that isn't a row is an end; versions on a circle are left out.
    """
    ids = versions.select(F.col("version_id").alias("parent_version"))
    at = versions.join(ids.withColumn("known", F.lit(True)), "parent_version", "left").select("version_id", F.when(F.col("known"), F.col("parent_version")).alias("up"))
    scratch = Scratch(versions.sparkSession, "lineage")
    at = scratch.write(at.select("version_id", F.coalesce("up", "version_id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")), "lineage")
    many = versions.count()
    for _ in range(max(1, many.bit_length() + 1)):
        if at.where("NOT done").isEmpty():
            break
        there = at.select(F.col("version_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("done").alias("there_done"))
        at, before = scratch.write(at.join(there, "up").select("version_id", F.col("further").alias("up"), (F.col("depth") + F.when(F.col("done"), 0).otherwise(F.col("more"))).alias("depth"), (F.col("done") | F.col("there_done")).alias("done")), "lineage"), at
        scratch.drop(before)
    return at.where("done").select("version_id", F.col("up").alias("root"), "depth")


def tree_chain_defects(shards: DataFrame) -> DataFrame:
    """directory, shard, defect: continuation missing before the last shard or set on it, metadata beyond the first, names not ascending across shards."""
    w = Window.partitionBy("directory").orderBy("shard")
    rows = shards.withColumn("before", F.lag("last_name").over(w)).withColumn("next", F.lead("shard").over(w)).withColumn("n", F.row_number().over(w))
    checks = [
        (F.col("next").isNotNull() & ~F.col("continued"), "no continuation"), (F.col("next").isNull() & F.col("continued"), "dangling continuation"),
        ((F.col("n") > 1) & F.col("has_metadata"), "metadata beyond the first"), (F.col("before") >= F.col("first_name"), "names not ascending"),
    ]
    return rows.select("directory", "shard", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(d)) for c, d in checks]))).alias("defect"))
