"""Cutting lineage and finding connected groups on a cluster that may lose executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 300_000  # rows of a few numbers that one task takes at most


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a local session, as in tests, gets a temporary folder; on a cluster
    there is no folder to guess, so it is an error. What is written there stays until whoever
    set it clears it, as results are read lazily.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, most: int | None = None) -> DataFrame:
    """A checkpointed ``df``; if it has ``most`` rows (``FEW``) or less, in one partition, so that no step on it alone shuffles.

    The limit is the number of rows there are: it drops none, and tells the planner how few they are.
    """
    n = df.count()
    return checkpointed(df.coalesce(1).limit(max(n, 1))) if n <= (FEW if most is None else most) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read from there."""
    at = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def forgotten(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote and nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets the cleaner delete shuffle and checkpoint files of finished rounds now: it waits for the driver's garbage collector, which has little else to do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ..., so that no name of a caller's clashes with one of ours, and each name's new one (the first, if a name is repeated)."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(reversed(list(zip(df.columns, new, strict=True))))


def _either_way(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; by explode, as a union would forget how the rows are dealt."""
    return edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _either_way(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    up = F.struct("a", F.col("m").alias("b"))
    kept = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.join(least, "a").select(F.inline(F.when(F.col("b") != F.col("m"), F.array(up, kept)).otherwise(F.array(up)))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent and a child: then the components are not all stars yet."""
    up, down = (F.struct(F.col(c).alias("v"), F.lit(int(c == "a")).alias("up"), F.lit(int(c == "b")).alias("down")) for c in "ab")
    ends = edges.select(F.inline(F.array(up, down)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").limit(1).count() > 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns ``node``, ``root``.

    ``edges`` has two columns of one ordered type, in either direction, repeats allowed.
    Alternates large-star and small-star steps until every component is a star on its
    smallest node. Each step is a grouped minimum (combined before its shuffle) and an
    equi join, so a node with very many links is never gathered in one task; each round
    is checkpointed, so lineage stays short. Up to ``FEW`` edges lie in one partition, and
    then no step shuffles; many edges may be few after a round.
    """
    a, b = edges.columns[:2]
    edges = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        edges = gathered(edges)
        if not _unsettled(edges):
            break
        edges = checkpointed(_small_star(gathered(checkpointed(_large_star(edges)))))
        swept(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
