"""Bounded walks, personalised PageRank, degrees and link neighbourhoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallspark.functions.rank import top_k
from recallspark.schema import (
    AUTHORED_WEIGHT,
    DERIVED_WEIGHT,
    MAX_ITERATIONS,
    RESTART,
    TOLERANCE,
    WALK_DEPTH,
    WALK_FRONTIER,
    WALK_MAX_NODES,
    RecallError,
)
from recallspark.session import cut_lineage, settle

EDGE_ORDER = ("kind", "src", "dst")


def edge_weight() -> Column:
    return F.when(F.col("kind") == "derived", DERIVED_WEIGHT).otherwise(AUTHORED_WEIGHT)


def out_degree(edges: DataFrame) -> DataFrame:
    """Links out of each record, similarity edges included."""
    return edges.groupBy("project_id", F.col("src").alias("memory_id")).agg(F.count("*").alias("degree"))


def orientation(edges: DataFrame, records: DataFrame, limit: int) -> DataFrame:
    """The best connected live records of each project; unlinked ones never appear."""
    live = records.where(F.col("archived_at").isNull()).select("project_id", "memory_id", "slug")
    degrees = out_degree(edges).join(live, ["project_id", "memory_id"])
    return top_k(degrees, ["project_id"], [F.col("degree").desc(), F.col("slug")], limit, spread_on="memory_id")


def _ends() -> Column:
    return F.inline(F.array(F.struct(F.col("src").alias("node")), F.struct(F.col("dst").alias("node"))))


def _level(edges: DataFrame, frontier: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` edges touching each query's frontier, in edge order.

    Each node contributes at most ``cap`` of its own edges, which is all a query
    could take, so a hub is cut down before it meets the queries.
    """
    asked = frontier.select("project_id", "node").distinct()
    touching = (
        edges.select("project_id", *EDGE_ORDER, _ends())
        .join(asked, ["project_id", "node"], "left_semi")
    )
    order = [F.col(c) for c in EDGE_ORDER]
    near = top_k(touching, ["project_id", "node"], order, cap, spread_on="dst").drop("rn")
    rows = near.join(frontier, ["project_id", "node"]).select("query_id", "project_id", *EDGE_ORDER).distinct()
    return top_k(rows, ["query_id"], order, cap)


def _fresh(rows: DataFrame, seen: DataFrame, max_nodes: int) -> DataFrame:
    """Nodes a level reached for the first time, numbered as the edges name them."""
    named = rows.select(
        "query_id", "project_id",
        F.inline(F.array(
            F.struct(F.col("dst").alias("node"), (F.col("rn") * 2).alias("at")),
            F.struct(F.col("src").alias("node"), (F.col("rn") * 2 + 1).alias("at")))))
    named = named.groupBy("query_id", "project_id", "node").agg(F.min("at").alias("at"))
    before = seen.groupBy("query_id").agg(F.count("*").alias("n_seen"))
    by_query = Window.partitionBy("query_id")
    return (
        named.join(seen, ["query_id", "project_id", "node"], "left_anti").join(before, "query_id")
        .withColumn("place", F.row_number().over(by_query.orderBy("at")))
        .withColumn("total", F.count("*").over(by_query) + F.col("n_seen"))
        .where(F.col("place") <= max_nodes - F.col("n_seen"))
    )


def walk(
    edges: DataFrame,
    seeds: DataFrame,
    depth: int = WALK_DEPTH,
    max_nodes: int = WALK_MAX_NODES,
    frontier: int = WALK_FRONTIER,
) -> DataFrame:
    """Edges ``(query_id, project_id, kind, src, dst)`` around each query's seeds.

    Breadth first over links in both directions. A level fetches at most four
    times ``max_nodes`` edges, opens at most ``frontier`` new nodes, and the walk
    stops once ``max_nodes`` have been seen. ``seeds`` is ``(query_id,
    project_id, node, ...)``. Each level is bounded per query by those caps and
    read by the next ones, so it is settled.
    """
    if depth < 1:
        raise RecallError("depth must be >= 1.")
    seen = seeds.select("query_id", "project_id", "node").distinct()
    rows = settle(_level(edges, seen, max_nodes * 4))
    walked = rows.drop("rn")
    for _ in range(depth - 1):
        fresh = settle(_fresh(rows, seen, max_nodes))
        opened = fresh.where((F.col("place") <= frontier) & (F.col("total") < max_nodes))
        rows = settle(_level(edges, opened.select("query_id", "project_id", "node"), max_nodes * 4))
        walked = walked.unionByName(rows.drop("rn"))
        seen = seen.unionByName(fresh.select("query_id", "project_id", "node"))
    return walked.distinct()


def both_ways(walked: DataFrame) -> DataFrame:
    """Undirected weighted pairs ``(query_id, a, b, w)``; parallel links keep the heaviest."""
    pair = F.inline(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return (
        walked.select("query_id", edge_weight().alias("w"), pair)
        .groupBy("query_id", "a", "b").agg(F.max("w").alias("w"))
    )


def rank_nodes(pairs: pd.DataFrame, tolerance: float, iterations: int) -> pd.DataFrame:
    """Random walk with restart over one bounded subgraph.

    Rows with a ``b`` are links; rows without are seeds whose ``w`` is their
    restart weight. No positive seed means a uniform restart.
    """
    links = pairs[pairs["b"].notna()]
    seeds = pairs[pairs["b"].isna()]
    names, codes = np.unique(np.concatenate([pairs["a"], links["b"]]), return_inverse=True)
    a = codes[: len(pairs)][pairs["b"].notna().to_numpy()]
    b = codes[len(pairs):]
    size = len(names)
    weight = links["w"].to_numpy(dtype=float)
    wanted = np.bincount(np.searchsorted(names, seeds["a"]), seeds["w"].clip(lower=0), size)
    start = wanted / wanted.sum() if wanted.sum() > 0 else np.full(size, 1.0 / size)
    out = np.bincount(a, weight, size)
    step = weight / out[a] if len(a) else weight
    stuck = out <= 0
    rank = start.copy()
    for _ in range(iterations):
        moved = np.bincount(b, rank[a] * step, size) + rank[stuck].sum() * start
        fresh = RESTART * start + (1 - RESTART) * moved
        change = np.abs(fresh - rank).sum()
        rank = fresh
        if change < tolerance:
            break
    return pd.DataFrame({"node": names, "rank": rank})


def personalized_pagerank(
    pairs: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, iterations: int = MAX_ITERATIONS
) -> DataFrame:
    """``(query_id, memory_id, rank)`` over each query's own bounded subgraph.

    The walk caps a group at a few thousand rows, so one task per query is safe.
    """
    rows = pairs.select("query_id", "a", "b", "w").unionByName(
        seeds.select("query_id", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"),
                     F.col("weight").alias("w")))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        done = rank_nodes(frame, tolerance, iterations)
        done.insert(0, "query_id", key[0])
        return done

    kind = pairs.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(one, f"query_id {kind}, node string, rank double").select(
        "query_id", F.col("node").alias("memory_id"), "rank")


# Links one task takes of a single node; a node with more is split over several.
HUB_LINKS = 100_000
# Up to so many projects, one row of each is sent to every task.
BROADCAST_PROJECTS = 100_000


def pagerank(
    nodes: DataFrame, edges: DataFrame, iterations: int = 30, tolerance: float = 0.0, keep_lineage: int = 3,
    hub_links: int = HUB_LINKS,
) -> DataFrame:
    """Whole-graph centrality per project: ``(project_id, memory_id, rank)``.

    Links count both ways. Nodes are numbered once, and links hold numbers, sorted by source
    so that they pack well (a checkpoint made under adaptive execution does not tell its
    layout, so each round shuffles them). A hub's links are dealt over as many slots as it
    needs, and only a hub's rank is repeated per slot: no task holds a whole hub.
    Contributions combine map-side. The ranks of a round are cut off on
    shared storage, since three things read them; convergence is tested every
    ``keep_lineage`` rounds.
    """
    key = ["project_id", "memory_id"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = settle(nodes.groupBy("project_id").agg(F.count("*").alias("size")))
    small = F.broadcast if sizes.count() <= BROADCAST_PROJECTS else lambda df: df
    names = settle(nodes.select(*key).withColumn("node", F.monotonically_increasing_id()))

    def number(end: str) -> DataFrame:
        return names.select("project_id", F.col("memory_id").alias(end), F.col("node").alias(f"{end}_node"))

    numbered = (
        edges.select("project_id", "src", "dst", edge_weight().alias("w"))
        .join(number("src"), ["project_id", "src"], "left").join(number("dst"), ["project_id", "dst"], "left"))
    # A link to what is no node takes its share of the source's rank along: its far end goes by name.
    pair = F.inline(F.array(*(
        F.struct(F.col(f"{x}_node").alias("a"), F.col(f"{y}_node").alias("b"), F.when(F.col(f"{y}_node").isNull(), F.col(y)).alias("beyond"))
        for x, y in (("src", "dst"), ("dst", "src")))))
    links = settle(
        numbered.select("w", pair).where("a is not null").groupBy("a", "b", "beyond").agg(F.max("w").alias("w")))
    out = settle(links.groupBy("a").agg(F.sum("w").alias("out"), F.ceil(F.count("*") / hub_links).cast("int").alias("slots")))
    steps = cut_lineage(
        links.where("b is not null").join(out, "a").select(
            "a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), "b", (F.col("w") / F.col("out")).alias("step"))
        .repartition(parts, "a", "slot").sortWithinPartitions("a", "slot"))
    base = (
        names.join(small(sizes), "project_id").join(out.select(F.col("a").alias("node"), "slots"), "node", "left")
        .select("node", "project_id", (1.0 / F.col("size")).alias("start"), F.coalesce("slots", F.lit(0)).alias("slots")))
    ranks = cut_lineage(base.withColumn("rank", F.col("start")).repartition(parts, "node").sortWithinPartitions("node"))
    for done in range(1, iterations + 1):
        sent = ranks.where(F.col("slots") > 0).select(
            F.col("node").alias("a"), "rank", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        moved = (
            steps.join(sent.hint("merge"), ["a", "slot"])
            .groupBy(F.col("b").alias("node"))
            .agg(F.sum(F.col("rank") * F.col("step")).alias("moved"))
        )
        spilt = ranks.groupBy("project_id").agg(
            F.sum(F.when(F.col("slots") == 0, F.col("rank")).otherwise(0.0)).alias("spilt"))
        fresh = cut_lineage(
            ranks.withColumnRenamed("rank", "was").join(moved.hint("merge"), "node", "left").join(small(spilt), "project_id")
            .withColumn("rank", RESTART * F.col("start") + (1 - RESTART) * (
                F.coalesce("moved", F.lit(0.0)) + F.col("spilt") * F.col("start")))
            .select("node", "project_id", "start", "slots", "rank", "was")
        )
        last = done == iterations
        if tolerance > 0 and done % keep_lineage == 0 and not last:
            change = fresh.groupBy("project_id").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change"))
            last = change.where(F.col("change") >= tolerance).isEmpty()
        ranks = fresh.drop("was")
        if last:
            break
    return names.join(ranks.select("node", "rank"), "node").select(*key, "rank")


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 1, max_nodes: int = 25) -> tuple[DataFrame, DataFrame]:
    """Authored links out of each root: ``(nodes, links)``.

    Nodes are ``(root, project_id, memory_id, level)``, at most ``max_nodes`` per
    root in link order; links are every authored link out of an opened node.
    ``roots`` is ``(project_id, memory_id)``.
    """
    if depth < 0 or max_nodes < 1:
        raise RecallError("depth must be >= 0 and max_nodes >= 1.")
    authored = edges.where(F.col("kind") != "derived")
    # A source's targets of one kind differ, and those passed over are taken already; so the
    # first max_nodes of each kind always hold every target a root can add. Every step reads them.
    heads = settle(top_k(authored, ["project_id", "src", "kind"], [F.col("dst")], max_nodes, spread_on="dst").select(
        "project_id", "src", "kind", "dst"))
    level = roots.select(
        F.col("memory_id").alias("root"), "project_id", "memory_id", F.lit(0).alias("level"), F.lit(1).cast("bigint").alias("taken"))
    nodes, opened = level.drop("taken"), []
    by_root = Window.partitionBy("root", "project_id")
    for step in range(depth):
        if max_nodes <= 1:
            break
        level = level.where(F.col("taken") < max_nodes).drop("taken")
        opened.append(level)
        reach = level.select("root", "project_id", F.col("memory_id").alias("src")).join(heads, ["project_id", "src"]).select(
            "root", "project_id", F.col("dst").alias("memory_id"), F.struct("kind", "src").alias("via"))
        # What a root has is told apart from what it reaches in the same grouping, so links move to their root once.
        had = nodes.select("root", "project_id", "memory_id", F.lit(None).cast(reach.schema["via"].dataType).alias("via"), F.lit(True).alias("had"))
        met = reach.withColumn("had", F.lit(False)).unionByName(had).repartition("root", "project_id").groupBy(
            "root", "project_id", "memory_id").agg(F.min("via").alias("via"), F.max("had").alias("had"))
        fresh = met.withColumn("taken", F.count_if("had").over(by_root)).where(~F.col("had"))
        place = F.row_number().over(by_root.orderBy("via", "memory_id"))
        fresh = fresh.withColumn("place", place).where(F.col("place") <= max_nodes - F.col("taken"))
        level = settle(fresh.select(
            "root", "project_id", "memory_id", F.lit(step + 1).alias("level"), (F.col("taken") + F.count("*").over(by_root)).alias("taken")))
        nodes = nodes.unionByName(level.drop("taken"))
    if not opened:
        return nodes, authored.limit(0).select(
            F.col("src").alias("root"), "project_id", "kind", "src", "dst")
    sources = opened[0]
    for more in opened[1:]:
        sources = sources.unionByName(more)
    links = sources.select("root", "project_id", F.col("memory_id").alias("src")).join(
        authored, ["project_id", "src"]).select("root", "project_id", "kind", "src", "dst")
    return nodes, links
