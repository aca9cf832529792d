"""Helpers shared by the corpus operators: tables, row keys, lineage cuts, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = 2**63 - 1  # stands for a null id: sorts after every real one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own only where none is set and
    driver and executors are one process; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="vaultmill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unused(names: Iterable[str], *frames: DataFrame) -> dict[str, str]:
    """For each wanted name one that no table has and that no other wanted name got."""
    taken = {c.lower() for f in frames for c in f.columns}
    out: dict[str, str] = {}
    for wanted in names:
        name = wanted
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out[wanted] = name
    return out


def integer_id(df: DataFrame, name: str) -> Column:
    """The id column as bigint. Ids are whole numbers; a table with other ids is refused at once."""
    kind = next(t for c, t in df.dtypes if c == name)
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{name} must hold whole numbers, not {kind}")
    return df[f"`{name}`"].cast("long")


def row_id(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(LAST_ID))


def text_hash(c: Column) -> Column:
    """64-bit content hash; null and empty texts differ."""
    return F.xxhash64(c.isNull(), F.coalesce(c.cast("string"), F.lit("")))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SKETCH = 4096  # counters of the sketch that finds crowded keys
CROWD = 65_536  # rows of a key for one task


def salted(many: DataFrame, few: DataFrame, keys: list[str], spread: list[str], crowd: int | None = None) -> DataFrame:
    """Inner join on keys of which some may have very many rows on the left.

    The rows of each key are counted first; a sketch of ``SKETCH`` maxima (keys share one by hash) says
    into how many parts of about ``crowd`` rows a key is cut, four for a task at most. Left rows take a part by the hash of the
    columns ``spread``; right rows are repeated for each part of their key.
    """
    n = unused(("slot", "parts", "part"), many, few)
    slot = F.pmod(F.xxhash64(*keys), F.lit(SKETCH)).alias(n["slot"])
    counts = many.groupBy(*keys).agg(F.count("*").alias(n["parts"]))
    sketch = counts.groupBy(slot).agg(F.least(F.ceil(F.max(n["parts"]) / (crowd or CROWD)), F.lit(4 * shuffle_width(many.sparkSession))).cast("int").alias(n["parts"]))
    sketch = F.broadcast(cut(sketch))  # SKETCH rows at most
    left = many.select("*", slot).join(sketch, n["slot"]).withColumn(n["part"], F.pmod(F.xxhash64(*spread), F.col(n["parts"])).cast("int"))
    right = few.select("*", slot).join(sketch, n["slot"]).withColumn(n["part"], F.explode(F.sequence(F.lit(0), F.col(n["parts"]) - 1)))
    return left.drop(n["slot"], n["parts"]).join(right.drop(n["slot"], n["parts"]), [*keys, n["part"]]).drop(n["part"])


HUBS = 8192  # nodes of the highest degrees that are handled apart, at most
LEAF = 32  # edges that any node may have without being a hub


def star(pairs: DataFrame, most: int) -> DataFrame:
    """pairs(u, v) -> (u, v, m), m being the smallest v of u.

    A node with more than ``most`` rows is a hub. There are at most ``HUBS`` of them (most is at
    least the number of rows divided by that), so they are broadcast, and a hub's rows stay where
    they are; all other rows meet their minimum in an ordinary join, few for a key.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.col("m").alias("hub")))
    met = pairs.join(hubs, "u", "left")
    rest = met.where("hub is null").select("u", "v").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return met.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest)


def smallest(named: DataFrame) -> DataFrame:
    """(node, root, rep) -> (node, best): the smallest rep of each root, for all its nodes."""
    named = cut(named.select(F.col("root").alias("u"), F.struct("rep", "node").alias("v")))
    met = star(named, max(LEAF, named.count() // HUBS))
    return met.select(F.col("v.node").alias("node"), F.col("m.rep").alias("best"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` holds pairs of bigint node ids; self pairs and repeats are ignored. Returns one row
    ``(node, root)`` for every node that has an edge to another one; root is the component's
    smallest node. The number of edges never grows, hubs meet their minimum without a shuffle of
    their edges, and each round ends in a checkpoint so that a lost executor costs one round at
    most. Raises if the edges still change after ``max_rounds``, so that no component is ever
    returned split.
    """
    e = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.sum(F.col("hi").cast("decimal(38,0)") - F.col("lo")).alias("s")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        most = max(LEAF, 2 * state["n"] // HUBS)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = star(both, most).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = star(large, most)
        tied = small.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        e = cut(tied.unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
