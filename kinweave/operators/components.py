"""Connected components over an edge table, by star contraction.

Each round makes two joins: the *small star* step links the smaller neighbours of a node, and the node, to the
smallest of them, the *large star* step links the larger ones. In this order the stars of identifier groups settle in one round.
Nodes with one smaller neighbour and no larger one are set aside before the rounds and take their neighbour's
component after them: of a star only the centre takes part. Both keep components intact and
the number of rounds grows with the logarithm of the component size, so long chains do not need as
many rounds as they have links. A hub is never gathered in one task: minima are partial aggregates
and the join back is a plain equi-join, which adaptive execution may split.
"""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names. Only a session without executors of its own gets a local one (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="kinweave-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)


@contextmanager
def scratch(spark: SparkSession):
    """Checkpoints made inside go to a folder of their own, which is deleted at the end: read what they hold before."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext._jsc.sc()
    before = context.checkpointDir()
    spark.sparkContext.setCheckpointDir(f"{spark.sparkContext.getCheckpointDir()}/scratch")
    own = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    try:
        yield
    finally:
        getattr(context, "checkpointDir_$eq")(before)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


#: Rows of a small table that go into one checkpoint file.
ROWS_PER_FILE = 50_000
FILES = 8


def files_for(rows: int) -> int:
    return max(FILES, -(-rows // ROWS_PER_FILE))


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder; ``files``: for a table of few rows,
    how many files it is worth, instead of one for each shuffle partition."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if files is None else df.coalesce(files)).checkpoint()


def rekeyed(df: DataFrame, *keys: str) -> DataFrame:
    """Hide that ``df``, an aggregate, is already partitioned by ``keys``.

    A join of rows with their aggregate would else run on the aggregate's own exchange, and adaptive execution only
    splits a hot partition if both sides of a join come straight from an exchange.
    """
    return df.withColumns({k: F.greatest(F.col(k), F.col(k)) for k in keys})


def _state(links: DataFrame) -> tuple[int, int]:
    """Links (u, v), and nodes that are not yet in place: with two links upwards, or links both up and down."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = per.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("bad")).first()
    return row["n"] or 0, row["bad"]


def _star_round(links: DataFrame) -> DataFrame:
    """One small-star and one large-star step over (u, v), u > v."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(rekeyed(smallest, "u"), "u")
    small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
    both = small.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(rekeyed(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return large.distinct()


def connected_components(edges: DataFrame, left: str = "left", right: str = "right", max_rounds: int = 60, files: int | None = None) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; component = smallest node of it.

    Nulls and self loops are ignored as links (a node that only has a self loop is still returned). Each round is
    checkpointed, in as many files as its rows are worth (``files`` for the first, whose rows are not known). Raises
    ``RuntimeError`` if ``max_rounds`` is not enough.
    """
    return contracted(edges, left, right, max_rounds, files)[0]


def contracted(edges: DataFrame, left: str = "left", right: str = "right", max_rounds: int = 60, files: int | None = None) -> tuple[DataFrame, int]:
    """``connected_components`` and the number of its rounds."""
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    labels, tops, rounds = _contract(pairs, max_rounds, files)
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    rest = tops.unionAll(loops).distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionAll(rest.select("node", F.col("node").alias("component"))), rounds


def _contract(pairs: DataFrame, max_rounds: int, files: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(node, component) of the nodes but their components' smallest, nodes among which these are, and the number of rounds."""
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), files)
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all")).select("x", ((F.col("up") == 1) & (F.col("all") == 1)).alias("leaf"))
    marked = cut(links.join(rekeyed(per, "x"), F.col("u") == F.col("x")).select("u", "v", "leaf"), files)
    leaves, links = marked.where("leaf").select("u", "v"), marked.where("not leaf").select("u", "v")
    n = links.count()
    rounds, bad = 0, n
    while bad:
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
        links = cut(_star_round(links), files_for(n))
        n, bad = _state(links)
        rounds += 1
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    far = labels.withColumnsRenamed({"node": "v", "component": "top"})
    return labels.unionAll(leaves.join(far, "v", "left").select(F.col("u").alias("node"), F.coalesce("top", "v").alias("component"))), marked.select(F.col("v").alias("node")), rounds


def propagation_step(labels: DataFrame, links: DataFrame) -> DataFrame:
    """One synchronous round over (entity_key, label) and (src, dst): least of own and neighbours' labels, and whether
    it changed. The old label rides along, so convergence is a sum and not a self-join."""
    near = links.join(labels.select(F.col("entity_key").alias("dst"), F.col("label").alias("seen")), "dst").groupBy("src").agg(F.min("seen").alias("seen"))
    joined = labels.join(near.withColumnRenamed("src", "entity_key"), "entity_key", "left")
    best = F.least("label", F.coalesce("seen", "label"))
    return joined.select("entity_key", best.alias("label"), (best < F.col("label")).alias("changed"))


def label_propagation(nodes: DataFrame, links: DataFrame, max_rounds: int = 30) -> tuple[DataFrame, int, bool]:
    """(labels, rounds, settled): the classic loop, one checkpoint a round; rounds include the last, idle one."""
    labels = nodes.select("entity_key", F.col("entity_key").alias("label")).distinct()
    for n in range(1, max_rounds + 1):
        step = cut(propagation_step(labels, links))
        labels = step.select("entity_key", "label")
        if not step.where("changed").take(1):
            return labels, n, True
    return labels, max_rounds, False


def resolve(nodes: DataFrame, edges: DataFrame, left: str = "left_entity_key", right: str = "right_entity_key", max_rounds: int = 60) -> DataFrame:
    """(entity_key, resolved_id) for every node; nodes without edges keep their own key."""
    return resolved(nodes, edges, left, right, max_rounds)[0]


def resolved(nodes: DataFrame, edges: DataFrame, left: str = "left_entity_key", right: str = "right_entity_key", max_rounds: int = 60) -> tuple[DataFrame, int]:
    """``resolve`` and the number of rounds."""
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    found, _, rounds = _contract(pairs, max_rounds, None)  # a smallest node that is left out keeps its own key below
    found = found.select(F.col("node").alias("entity_key"), F.col("component").alias("resolved_id"))
    return nodes.select("entity_key").distinct().join(found, "entity_key", "left").select("entity_key", F.coalesce("resolved_id", "entity_key").alias("resolved_id")), rounds
