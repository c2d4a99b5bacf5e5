"""WITH RECURSIVE: UNION (distinct), UNION ALL, SEARCH and CYCLE as loops over distributed steps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds after which a loop gives up with an error (it never cuts a result short).
MAX_ROUNDS = 10_000
#: Rounds that stay tables by themselves before they are put together.
ROUNDS_APART = 16
#: Rows (of fixed-width columns) up to which a round, or all that was seen, is sent to the other side of its join.
BROADCAST_ROWS = 1_000_000


def _cut(df: DataFrame) -> DataFrame:
    """Lineage ends here, in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return df.checkpoint()


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if df, known to have `rows` rows, is small; else its joins shuffle both sides."""
    narrow = not any("<" in kind or kind in ("string", "binary", "variant") for _, kind in df.dtypes)
    return F.broadcast(df) if narrow and rows <= BROADCAST_ROWS else df


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True) -> DataFrame:
    """seed UNION [ALL] step(new rows), until a round brings none.

    With `distinct`, a round keeps only rows not seen before, so cycles end; the rounds are as
    many as the longest shortest path. What `step` joins to is read in each round, but shuffled
    only in rounds of over BROADCAST_ROWS rows.
    """
    columns = seed.columns
    new = _cut(seed.distinct() if distinct else seed)
    rounds, n = [new], new.count()
    n_seen = n
    for _ in range(MAX_ROUNDS):
        seen = reduce(DataFrame.unionByName, rounds)
        more = step(_sent(new, n)).toDF(*columns)
        if distinct:
            more = more.distinct()
            same = [more[c].eqNullSafe(seen[c]) for c in columns]
            more = more.join(_sent(seen, n_seen), same, "left_anti")
        new = _cut(more)
        n = new.count()
        if not n:
            return seen
        n_seen += n
        rounds.append(new)
        if len(rounds) > ROUNDS_APART:  # what was seen is written again only now and then
            rounds = [_cut(reduce(DataFrame.unionByName, rounds))]
    raise RuntimeError(f"recursion has not ended after {MAX_ROUNDS} rounds")


def walk(edges: DataFrame, roots: DataFrame, parent: str, child: str) -> DataFrame:
    """Paths from roots(node): node, depth, path (nodes, root first) and is_cycle; a path ends where it would repeat a node.

    `path` orders the rows depth first (SEARCH DEPTH FIRST BY child), (depth, node) breadth
    first; is_cycle and path are those of CYCLE child SET is_cycle USING path.
    """
    new = _cut(roots.select(F.col("node"), F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("is_cycle")))
    out = new
    for _ in range(MAX_ROUNDS):
        step = new.where("not is_cycle").join(edges.select(F.col(parent).alias("node"), F.col(child).alias("__next__")), "node")
        new = _cut(step.select(F.col("__next__").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("__next__")).alias("path"), F.array_contains("path", F.col("__next__")).alias("is_cycle")))
        if new.isEmpty():
            return out
        out = out.unionByName(new)
    raise RuntimeError(f"recursion has not ended after {MAX_ROUNDS} rounds")


def depth_first(path: Column) -> Column:
    """Sort key of SEARCH DEPTH FIRST."""
    return path


def breadth_first(depth: Column, node: Column) -> Column:
    """Sort key of SEARCH BREADTH FIRST."""
    return F.struct(depth.alias("depth"), node.alias("node"))
