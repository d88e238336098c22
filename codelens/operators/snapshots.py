"""Snapshot version forest: lineage, descendants, branches, statistics.

Lineage uses pointer doubling: each node knows an ancestor and how far it is;
a join with all nodes doubles that distance, so a forest of depth D needs about
log2(D) joins (a root-down walk needs D). Each written round does two of them.
A round is a table in the session's shared checkpoint folder
(``spark.checkpoint.dir``), so the plan stays short, a lost executor recomputes
one round, and the rounds of a finished lineage are removed when they are no
longer read (the last one stays, the result reads it).

A node on a cycle of parents, or below one, has no root: it is given out with
``cyclic`` true and without depth, root and path.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions.windows import prefix_sum
from codelens.session import ensure_checkpoint_dir


def forest_edges(snapshots: DataFrame, node: str = "snapshot_id", parent: str = "parent_id") -> DataFrame:
    """(node, parent) with a parent that is not a known node set to NULL (a missing parent ends a path)."""
    known = snapshots.select(F.col(node).alias("_p"))
    return (snapshots.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
            .join(known, F.col("parent") == F.col("_p"), "left")
            .select("node", F.when(F.col("_p").isNotNull(), F.col("parent")).alias("parent")))


class _Rounds:
    """Written rounds of one lineage; each replaces the one before."""

    def __init__(self, like: DataFrame):
        self.spark = like.sparkSession
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/lineage-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.n - 1}")
        if self.n:
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.n += 1
        return self.spark.read.parquet(path)

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """A table beside the rounds that stays, in folders by the columns ``by``."""
        path = f"{self.folder}/kept-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _doubled(nodes: DataFrame, with_path: bool) -> DataFrame:
    """Every unfinished node's ancestor replaced by that one's own ancestor."""
    there = nodes.select(F.col("node").alias("_n"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"),
                         F.col("top").alias("_top"), F.col("cyclic").alias("_cyclic"), *([F.col("seg").alias("_seg")] if with_path else []))
    joined = nodes.join(there, F.when(~F.col("cyclic"), F.col("jump")) == F.col("_n"), "left")
    met = F.col("_n").isNotNull()
    # the parent of a finished jump is missing from the table: the path ends at the node itself
    jump = F.when(met, F.col("_jump")).when(F.col("cyclic"), F.col("jump"))
    steps = F.when(met, F.col("steps") + F.col("_steps")).otherwise(F.col("steps"))
    top = F.when(met, F.col("_top")).otherwise(F.col("top"))
    if not with_path:
        return joined.select("node", jump.alias("jump"), steps.alias("steps"), top.alias("top"),
                             (F.col("cyclic") | F.coalesce("_cyclic", F.lit(False))).alias("cyclic"))
    seg = F.when(met & ~F.col("_cyclic"), F.concat("_seg", "seg")).otherwise(F.col("seg"))
    out = joined.select("node", jump.alias("jump"), steps.alias("steps"), top.alias("top"), seg.alias("seg"),
                        (F.col("cyclic") | F.coalesce("_cyclic", F.lit(False))).alias("cyclic"))
    # an ancestor that the path holds already closes a cycle, which keeps every path under twice the cycle's length
    return out.withColumn("cyclic", F.col("cyclic") | F.coalesce(F.array_contains("seg", F.col("jump")), F.lit(False)))


def lineage(snapshots: DataFrame, node: str = "snapshot_id", parent: str = "parent_id", with_path: bool = True) -> DataFrame:
    """JOIN_LINEAGE: per node depth, root and cyclic, and with ``with_path`` its root-to-node path (array of ids).

    ``with_path=False`` moves four numbers for each node and round, whatever the depth.
    """
    start = snapshots.select(
        F.col(node).alias("node"), F.col(parent).alias("jump"), F.lit(1).cast("bigint").alias("steps"), F.col(node).alias("top"),
        *([F.array(F.col(node)).alias("seg")] if with_path else []), (F.col(node) == F.col(parent)).alias("cyclic"))
    rounds = _Rounds(snapshots)
    nodes = rounds.write(start.withColumn("cyclic", F.coalesce("cyclic", F.lit(False))))
    total = nodes.count()
    limit = math.ceil(math.log2(max(2, total))) + 1  # doublings that reach the root of any path
    done = 0
    while done < limit and not nodes.where(F.col("jump").isNotNull() & ~F.col("cyclic")).isEmpty():
        nodes = rounds.write(_doubled(_doubled(nodes, with_path), with_path))
        done += 2
    cyclic = F.col("cyclic") | F.col("jump").isNotNull()
    own = lambda c: F.when(~cyclic, c)
    path = [own(F.col("seg")).alias("path")] if with_path else []
    return nodes.select(F.col("node").alias(node), *path, own(F.col("steps")).alias("depth"), own(F.col("top")).alias("root_id"), cyclic.alias("cyclic"))


def _climbed(core: DataFrame) -> DataFrame:
    """One doubling of (node, jump, steps, top, size): jumps twice as long, ``size`` with the nodes below that jump to the node."""
    reach = F.col("jump").isNotNull()
    there = core.select(F.col("node").alias("_n"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"), F.col("top").alias("_top"))
    below = core.where(reach).groupBy(F.col("jump").alias("_b")).agg(F.sum("size").alias("_more"))
    joined = core.join(there, F.col("jump") == F.col("_n"), "left").join(below, F.col("node") == F.col("_b"), "left")
    return joined.select("node", F.col("_jump").alias("jump"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                         F.coalesce("_top", "top").alias("top"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))


def _summed(core: DataFrame) -> DataFrame:
    """One doubling of (node, jump, after): the sum of ``after`` over twice as many ancestors."""
    there = core.select(F.col("node").alias("_n"), F.col("jump").alias("_jump"), F.col("after").alias("_after"))
    return core.join(there, F.col("jump") == F.col("_n"), "left").select(
        "node", F.col("_jump").alias("jump"), (F.col("after") + F.coalesce("_after", F.lit(0))).alias("after"))


def _doubled_until_done(start: DataFrame, step, total: int) -> DataFrame:
    rounds = _Rounds(start)
    ranked = rounds.write(start)
    limit = math.ceil(math.log2(max(2, total))) + 1
    done = 0
    while done < limit and not ranked.where(F.col("jump").isNotNull()).isEmpty():
        ranked = rounds.write(step(step(ranked)))
        done += 2
    return ranked


#: So many layers of leaves are taken off at most, while each takes at least this share of the nodes.
LAYERS, LAYER_SHARE = 3, 0.25


def _layers(edges: DataFrame, folder: _Rounds) -> tuple[list[DataFrame], DataFrame, int]:
    """The leaves of (node, parent, size), then those of what is left (``LAYERS`` times), and the core that stays, with its number of nodes.

    A leaf's ``size`` is added to its parent's, so sizes of leaves are those of
    their subtrees. Each layer is a table and costs what the layers above left.
    """
    layers, left = [], folder.keep(edges)
    n = left.count()
    while n and len(layers) < LAYERS:
        own = F.col("parent") != F.col("node")
        inner = left.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("_kids"))
        flagged = folder.keep(left.join(inner, F.col("node") == F.col("_p"), "left").select("node", "parent", "size", F.col("_p").isNull().alias("leaf")))
        leaves = flagged.where("leaf").count()
        if leaves < LAYER_SHARE * n:
            break
        layers.append(flagged.where("leaf").drop("leaf"))
        more = layers[-1].where(F.col("parent").isNotNull() & own).groupBy(F.col("parent").alias("_p")).agg(F.sum("size").alias("_more"))
        left = folder.keep(flagged.where("NOT leaf").join(more, F.col("node") == F.col("_p"), "left")
                           .select("node", "parent", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
        n -= leaves
    return layers, left, n


def euler_tour(snapshots: DataFrame, node: str = "snapshot_id", parent: str = "parent_id") -> DataFrame:
    """(node, root_id, after, within, depth, cyclic): every subtree as an interval of places of a tour, without paths.

    The tour enters a node, tours its children by id and leaves it. ``after``
    nodes are entered after the subtree of a node is left, and ``within`` more in
    it (itself included), so d lies below a where both have one root and
    ``a.after < d.after + d.within < a.after + a.within``.

    ``within`` is counted upwards and ``after`` downwards (its parent's, and the
    subtrees of its later siblings). Layers of leaves go first, so that bushy
    trees shrink by a factor with each; what is left, long chains, is done by
    pointer doubling, and the layers then take their parents' values. Ids are
    unique integers; a node on a cycle of parents or below one is ``cyclic``,
    without root and places.
    """
    folder = _Rounds(snapshots)
    one = F.lit(1).cast("long")
    edges = forest_edges(snapshots, node, parent).select(F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), one.alias("size"))
    layers, core, n = _layers(edges, folder)
    climbed = _doubled_until_done(core.select("node", F.col("parent").alias("jump"), one.alias("steps"), F.col("node").alias("top"), "size"), _climbed, n)
    sized = [folder.keep(core.select("node", "parent").join(climbed.select("node", "size"), "node")), *layers]
    # the subtrees of later siblings: a prefix by falling id
    sizes = reduce(DataFrame.unionByName, [x.select("node", "parent", "size", F.lit(k).alias("layer")) for k, x in enumerate(sized)])
    sibling = sizes.where(F.col("parent").isNotNull()).withColumn("_at", -F.col("node"))
    later = folder.keep(prefix_sum(sibling, ["parent"], "_at", "size", "after", inclusive=False).select("node", "after", "layer"), "layer")
    follow = lambda k, x: x.join(later.where(F.col("layer") == k).select("node", "after"), "node", "left").fillna(0, ["after"])
    placed = _doubled_until_done(follow(0, sized[0]).select("node", F.col("parent").alias("jump"), "after"), _summed, n)
    known = folder.keep(climbed.select("node", F.col("top").alias("root_id"), F.col("size").alias("within"), F.col("steps").alias("depth"), F.col("jump").isNotNull().alias("cyclic"))
                        .join(placed.select("node", "after"), "node"))
    done = [known]
    for k in range(len(layers), 0, -1):
        above = reduce(DataFrame.unionByName, done).select(
            F.col("node").alias("parent"), "root_id", "depth", "cyclic", F.col("after").alias("_after"))
        leaf = follow(k, layers[k - 1]).join(above, "parent", "left")
        done.append(folder.keep(leaf.select(
            "node", F.coalesce("root_id", "node").alias("root_id"), F.col("size").alias("within"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth"),
            F.coalesce("cyclic", F.lit(False)).alias("cyclic"), (F.col("after") + F.coalesce("_after", F.lit(0))).alias("after"))))
    sure = lambda c: F.when(~F.col("cyclic"), F.col(c)).alias(c)
    return reduce(DataFrame.unionByName, done).select(F.col("node").alias(node), sure("root_id"), sure("after"), sure("within"), sure("depth"), "cyclic")


#: Each size of block is so many of the size before, as a power of two.
BLOCK_BITS = 4


def descendants(tour: DataFrame, chosen: DataFrame | None = None, node: str = "snapshot_id") -> DataFrame:
    """JOIN_DESCENDANTS: (ancestor_id, descendant_id, levels_below, preorder) for the ``chosen`` ids (all without them).

    An interval join on equal keys: an ancestor's interval of places is cut into
    blocks whose sizes are powers of 16, at most 30 of each size, and every node
    names the block of each size that its place lies in, so each pair meets
    once and no others are compared. ``preorder`` counts from 1, children by id.
    """
    known = tour.where("NOT cyclic").withColumn("place", F.col("after") + F.col("within"))
    ancestors = known if chosen is None else known.join(chosen.select(node).distinct(), node, "left_semi")
    most = ancestors.where("within > 1").agg(F.max("within")).first()[0] or 1
    sizes = F.sequence(F.lit(0), F.lit(int(most).bit_length() // BLOCK_BITS))
    lo, hi = F.col("after") + 1, F.col("place")  # places of the nodes below: lo .. hi - 1
    width = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k * BLOCK_BITS)
    none = F.array().cast("array<bigint>")

    def blocks(k: Column) -> Column:
        first, end = F.ceil(lo / width(k)).cast("long"), F.floor(hi / width(k)).cast("long")
        # what blocks of the next size hold is theirs
        upper, until = (F.ceil(lo / width(k + 1)) * (1 << BLOCK_BITS)).cast("long"), (F.floor(hi / width(k + 1)) * (1 << BLOCK_BITS)).cast("long")
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
        cut = F.when(upper < until, F.concat(run(first, upper), run(until, end))).otherwise(run(first, end))
        return F.transform(cut, lambda x: F.struct(k.alias("size"), x.alias("block")))

    a = ancestors.where("within > 1").select(
        "root_id", F.col(node).alias("ancestor_id"), F.col("depth").alias("_depth"), F.col("place").alias("_place"),
        F.explode(F.flatten(F.transform(sizes, blocks))).alias("b")).select("root_id", "ancestor_id", "_depth", "_place", "b.*")
    d = known.where("depth > 1").select("root_id", F.col(node).alias("descendant_id"), "depth", "place", F.explode(sizes).alias("size"))
    d = d.withColumn("block", F.floor(F.col("place") / width(F.col("size"))).cast("long"))
    return a.join(d, ["root_id", "size", "block"]).select(
        "ancestor_id", "descendant_id", (F.col("depth") - F.col("_depth")).alias("levels_below"), (F.col("_place") - F.col("place")).alias("preorder"))


def investigation_diff(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """JOIN_SNAPSHOT_DIFF (investigation): entries added, answered, tested and resolved from parent to child, by entry id.

    docs: stored snapshots; edges: (node, parent). Only ids and states are joined.
    """
    kinds = {"questions": "answered", "hypotheses": "tested", "findings": None, "blockers": "resolved"}

    def states(k):
        status = (lambda e: F.lit("")) if k == "findings" else (lambda e: e["status"])
        return F.transform(F.col(f"investigation.{k}"), lambda e: F.struct(e["id"].alias("id"), status(e).alias("status"))).alias(k)

    slim = docs.select(F.col("id"), *[states(k) for k in kinds])
    child = slim.select(F.col("id").alias("_c"), *[F.col(k).alias(f"c_{k}") for k in kinds])
    parent = slim.select(F.col("id").alias("_p"), *[F.col(k).alias(f"p_{k}") for k in kinds])
    pairs = edges.join(child, F.col("node").cast("string") == F.col("_c")).join(parent, F.col("parent").cast("string") == F.col("_p"))
    closed = {"questions": ("answered",), "hypotheses": ("confirmed", "refuted"), "blockers": ("resolved",)}

    def added(k):
        known = F.transform(F.col(f"p_{k}"), lambda e: e["id"])
        return F.size(F.filter(F.col(f"c_{k}"), lambda e: ~F.array_contains(known, e["id"]))).cast("bigint").alias(f"{k}_added")

    def finished(k, name):
        still = F.transform(F.filter(F.col(f"p_{k}"), lambda e: ~e["status"].isin(*closed[k])), lambda e: e["id"])
        now = F.filter(F.col(f"c_{k}"), lambda e: e["status"].isin(*closed[k]) & F.array_contains(still, e["id"]))
        return F.size(now).cast("bigint").alias(f"{k}_{name}")

    return pairs.select(F.col("node").alias("snapshot_id"), *[added(k) for k in kinds], *[finished(k, n) for k, n in kinds.items() if n])


def branches(snapshots: DataFrame, node: str = "snapshot_id", parent: str = "parent_id") -> DataFrame:
    """AGG_BRANCHES: child count per node, branch point (> 1 child) and leaf flags."""
    edges = forest_edges(snapshots, node, parent)
    kids = edges.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).cast("bigint").alias("children"))
    return (edges.select("node").join(kids, "node", "left").fillna(0, ["children"])
            .select(F.col("node").alias(node), "children", (F.col("children") > 1).alias("is_branch_point"),
                    (F.col("children") == 0).alias("is_leaf")))


def version_stats(lineage_df: DataFrame, branch_df: DataFrame, keys=()) -> DataFrame:
    """AGG_VERSION_STATS: snapshots, roots, branch points, max and average depth."""
    keys = list(keys)
    j = lineage_df.join(branch_df, lineage_df.columns[0])
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_snapshots"),
        F.count_if(F.col("depth") == 1).cast("bigint").alias("root_snapshots"),
        F.count_if("is_branch_point").cast("bigint").alias("branch_points"),
        F.max("depth").cast("bigint").alias("max_depth"),
        F.avg("depth").alias("average_depth"),
    )


def recent_stats(snapshots: DataFrame, as_of, keys=("project_id",), ts: str = "created_at") -> DataFrame:
    """AGG_SNAPSHOT_STATS: total, created in the last 7 days before ``as_of``, total size."""
    return snapshots.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(F.col(ts) > as_of - F.expr("INTERVAL 7 DAYS")).cast("bigint").alias("last_7_days"),
        F.sum("size").cast("bigint").alias("total_size"),
    )


def format_size(b) -> F.Column:
    """PRJ_FORMAT_SIZE: bytes -> '1.2 MB' (1024 steps, one decimal; 0 -> '0 Bytes')."""
    units = F.array(*[F.lit(u) for u in ["Bytes", "KB", "MB", "GB"]])
    i = F.least(F.floor(F.log(1024.0, b.cast("double"))), F.lit(3)).cast("int")
    val = F.round(b / F.pow(F.lit(1024.0), i), 1)
    txt = F.regexp_replace(F.format_number(val, 1), ",", "")
    txt = F.regexp_replace(txt, r"\.0$", "")
    return F.when(b == 0, F.lit("0 Bytes")).otherwise(F.concat_ws(" ", txt, F.element_at(units, i + 1)))
