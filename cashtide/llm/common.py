"""Reading the given tables, staging in the shared folder, and connected components."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package, wherever the session was started.

    A cluster whose workers do not see it gets the package by ``--py-files``, as usual.
    """
    root, workers = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in workers.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        workers["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; in local mode, where that is unset, a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return folder or spark.conf.get("spark.sql.warehouse.dir") + "/staged"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that lost executors cost no recomputation of it."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, made longer until ``df`` has no column that is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (long columns a, b), as (node, root).

    Large and small stars in turn: every node points its larger, then its smaller neighbours to the
    smallest one it knows, until nothing changes. A hot node's neighbours are reduced to their
    minimum by partial sums, and the joins on it are ones that adaptive execution splits. Each
    round is written to the shared folder; only two sums come to the driver. An empty input gives
    no rows; edges from a node to itself are nodes without neighbours.
    """
    at = staged(edges.selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = at.union(at.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: neighbours above a node go to its smallest neighbour.
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b")
        # Written, as both the minima and the join below read it.
        down = staged(large.union(at.where("a = b")), "stars")
        # Small star: what is left below a node, and the node itself, go to the smallest of them.
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").selectExpr("b a", "m b").union(floor.selectExpr("a", "m b")).where("a > b or a = b")
        at = staged(small.distinct(), "edges")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    mins = at.groupBy("a").agg(F.min("b").alias("root"))
    return mins.selectExpr("a node", "root")
