"""Left joins whose keys may be null, or shared by very many rows of the left side.

A shuffle sends all rows of a key, and all null keys, to one task. Here rows without a key are scattered
under values that no key has, and crowded keys are cut into parts on both sides. Which keys are crowded is
counted beforehand, for all joins of a chain in one pass, and kept by hash: ``SLOTS`` numbers for a join
at most, whatever the number of keys. Small right sides are broadcast by the optimizer from
their statistics all the same; nothing is shuffled then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, CROWD = 1024, 65_536  # counters for a join; rows of a key for one task


def crowded(rows: DataFrame, keys: dict[str, Column], crowd: int | None = None) -> dict[str, dict[int, int]]:
    """For each kind of key the slots with a key of over ``crowd`` rows, and into how many parts its rows go."""
    crowd = crowd or CROWD
    most = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()])).alias("x")).where("x.key is not null")
    counts = each.groupBy("x.kind", "x.key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    parts = F.least(F.ceil(F.max("n") / crowd), F.lit(most)).cast("int")
    out: dict[str, dict[int, int]] = {k: {} for k in keys}
    for kind, slot, n in counts.groupBy("kind", F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot")).agg(parts).collect():
        out[kind][slot] = n
    return out


def left_join(left: DataFrame, right: DataFrame, key: str, slots: dict[int, int], spread: list[str]) -> DataFrame:
    """The left rows with the columns of the right row of the same key, or nulls. ``key`` is in both and stays
    from the left, ``spread`` names what tells left rows apart, ``slots`` is what ``crowded`` found for the key."""
    apart = F.xxhash64(*spread)
    given, on = left.withColumnRenamed(key, "__given"), F.coalesce(F.col("__given"), F.concat(F.lit("\0"), apart.cast("string")))
    if not slots:
        return given.withColumn(key, on).join(right, key, "left").drop(key).withColumnRenamed("__given", key)
    parts = F.map_from_arrays(F.array(*map(F.lit, slots)), F.array(*map(F.lit, slots.values())))
    n = F.coalesce(F.try_element_at(parts, F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")), F.lit(1))
    cut = given.withColumn(key, on).withColumn("__part", F.pmod(apart, n).cast("int"))
    many = right.withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.join(many, [key, "__part"], "left").drop(key, "__part").withColumnRenamed("__given", key)
