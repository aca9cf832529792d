"""Typed links and their resolution within a scope of documents."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.functions.text import BLANK, doc_id, fold, parent, stem, strip
from vaultmill.operators import skew

# fixed value: what a link looks like
LINK = rf"\[\[([^\[\]]+?)\]\](?:{BLANK}*\(([^)]+)\))?"


def file_name(label: Column) -> Column:
    """The label as a path: stripped, with the suffix .md."""
    label = strip(label)
    return F.when(label.endswith(".md"), label).otherwise(F.concat(label, F.lit(".md")))


def extract(docs: DataFrame, text: str = "truth", *more: str) -> DataFrame:
    """docs(id, path, text) -> (source_id, source_path, n, label, relationship_type), one row per link in order.

    ``more`` names columns of the documents that stay with their links."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), 1).alias("label"), F.regexp_extract_all(text, F.lit(LINK), 2).alias("rel"))
    rows = docs.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"), *more, F.posexplode(found).alias("n", "m"))
    rel = F.col("m.rel")
    return rows.select("source_id", "source_path", "n", F.col("m.label").alias("label"), F.when(rel != "", strip(rel)).alias("relationship_type"), *more)


def _unique(scope: DataFrame, key: Column, name: str) -> DataFrame:
    """Keys that exactly one path has."""
    return scope.select(key.alias(name), "path").groupBy(name).agg(F.min("path").alias(f"{name}_path"), F.max("path").alias("__most")).where(F.col(f"{name}_path") == F.col("__most")).drop("__most")


# how a link was resolved, and the keys under which it is found again when documents arrive that may change
# that: nothing precedes an exact path, only that precedes a sibling, and so on
PATH, STEM, TITLE = "path", "stem", "title"
EXACT, SIBLING, BY_STEM, BY_TITLE, DANGLING = "exact", "sibling", "stem", "title", "none"
KEYS = ("name_key", "next_key", "stem_key", "title_key")
ASKED = 200_000  # labels, each with the folder that it stands in, whose answers are broadcast


def keyed(links: DataFrame) -> DataFrame:
    """Adds the four keys of a label, in the order in which they are tried; a label with a folder has only two."""
    name = file_name(F.col("label"))
    bare = ~F.contains(name, F.lit("/"))
    return links.withColumns({
        "name_key": name,
        "next_key": F.when(bare, F.concat(parent(F.col("source_path")), name)),
        "stem_key": F.when(bare, fold(stem(name))),
        "title_key": fold(F.col("label")),
    })


def asked(links: DataFrame) -> DataFrame:
    """(label, source_path): what there is to resolve. Where a link leads depends on its label and folder only, so
    a label is taken once in each folder, which stands for all paths in it."""
    return links.select("label", parent(F.col("source_path")).alias("source_path")).distinct()


def asked_in(docs: DataFrame, text: str = "truth") -> DataFrame:
    """``asked`` of all links in docs(path, text), from their labels alone."""
    labels = F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), 1))
    return docs.select(parent(F.col("path")).alias("source_path"), F.explode(labels).alias("label")).select("label", "source_path").distinct()


def answers(questions: DataFrame, scope: DataFrame) -> DataFrame:
    """A bounded number of labels (see ``asked``), resolved. The scope is passed once and not shuffled: only what a
    key of theirs fits is counted, by key."""
    q = keyed(questions)
    tried = [F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.col(k).alias("key")) for i, (k, kind) in enumerate(zip(KEYS, (PATH, PATH, STEM, TITLE)))]
    tries = q.select("label", "source_path", F.explode(F.array(*tried)).alias("k")).where("k.key is not null").select("label", "source_path", "k.*")
    named = scope.select("path", F.col("path").alias(PATH + "_"), fold(stem(F.col("path"))).alias(STEM + "_"), fold(F.col("title")).alias(TITLE + "_"))  # each key is made once
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_").alias("key")) for kind in (PATH, STEM, TITLE)])
    had = named.select("path", F.explode(each).alias("k")).select("path", "k.kind", "k.key").join(F.broadcast(tries.select("kind", "key").distinct()), ["kind", "key"], "left_semi")
    one = had.groupBy("kind", "key").agg(F.min("path").alias("at"), F.max("path").alias("__most")).where(F.col("at") == F.col("__most"))
    hits = tries.join(F.broadcast(one), ["kind", "key"]).groupBy(F.col("label").alias("__l"), F.col("source_path").alias("__p")).agg(*[F.max(F.when(F.col("i") == i, F.col("at"))).alias(c) for i, c in enumerate(FOUND)])
    return led(q.join(F.broadcast(hits), F.col("label").eqNullSafe(F.col("__l")) & F.col("source_path").eqNullSafe(F.col("__p")), "left").drop("__l", "__p"))


FOUND = ("__exact", "__sibling", "__stem", "__title")  # paths by the keys, in their order


def led(rows: DataFrame) -> DataFrame:
    """Adds target_path, target_id and how, by what the keys found."""
    exact, sibling, by_stem, by_title = (F.col(c).isNotNull() for c in FOUND)
    how = F.when(exact, EXACT).when(sibling, SIBLING).when(by_stem, BY_STEM).when(by_title, BY_TITLE).otherwise(DANGLING)
    rows = rows.withColumn("target_path", F.coalesce(*FOUND)).withColumn("how", how)
    return rows.withColumn("target_id", doc_id(F.coalesce("target_path", "name_key"))).drop(*FOUND)


def resolve_keyed(links: DataFrame, scope: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """links with their keys -> the same with target_path (null if dangling), target_id and how.

    Labels repeat: up to ``ASKED`` different ones are resolved by themselves and their answers are broadcast,
    so no link is shuffled. More of them are joined link by link. ``questions`` is ``asked`` of the links, if that is at hand.
    """
    questions = asked(links) if questions is None else questions
    if questions.limit(ASKED + 1).count() <= ASKED:
        known = answers(questions, scope).withColumnsRenamed({"label": "__label", "source_path": "__folder"})
        rows = links.drop(*KEYS).join(F.broadcast(known), F.col("label").eqNullSafe(F.col("__label")) & parent(F.col("source_path")).eqNullSafe(F.col("__folder")), "left")
        return rows.select(*links.columns, "target_path", "target_id", "how")
    paths = scope.select("path").distinct()
    sides = {
        "name_key": paths.select(F.col("path").alias("name_key"), F.col("path").alias("__exact")),
        "next_key": paths.select(F.col("path").alias("next_key"), F.col("path").alias("__sibling")),
        "stem_key": _unique(scope, fold(stem(F.col("path"))), "stem_key").withColumnRenamed("stem_key_path", "__stem"),
        "title_key": _unique(scope, fold(F.col("title")), "title_key").withColumnRenamed("title_key_path", "__title"),
    }
    slots = skew.crowded(links, {k: F.col(k) for k in KEYS})
    rows = links
    for k in KEYS:
        rows = skew.left_join(rows, sides[k], k, slots[k], ["source_id", "source_path", "n"])
    return led(rows).select(*links.columns, "target_path", "target_id", "how")


def resolve(links: DataFrame, scope: DataFrame) -> DataFrame:
    """Adds target_path (null if dangling) and target_id. scope(path, title) names all documents.

    Order: the exact path; a file next to the source; the only file of that name; the only document
    of that title. Ambiguous names fall through. See ``resolve_keyed``; where links are joined one by one, those without
    a key and those that share a label are spread over tasks.
    """
    return resolve_keyed(keyed(links), scope).select(*links.columns, "target_path", "target_id")


def watches(resolved: DataFrame, *more: str) -> DataFrame:
    """(source_id, kind, key): the keys that a new document or title must have to change how a link resolves. ``more`` names
    columns that a source has one value of."""
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    name, near, by_stem, by_title = key(PATH, "name_key"), key(PATH, "next_key"), key(STEM, "stem_key"), key(TITLE, "title_key")
    none = F.array().cast("array<struct<kind:string,key:string>>")
    how = F.col("how")
    kept = F.when(how == EXACT, none).when(how == SIBLING, F.array(name)).when(how == BY_STEM, F.array(name, near, by_stem)).otherwise(F.array(name, near, by_stem, by_title))
    return resolved.select("source_id", *more, F.explode(kept).alias("k")).where("k.key is not null").select("source_id", *more, "k.kind", "k.key").distinct()


def announced(docs: DataFrame) -> DataFrame:
    """docs(path, title, old_title) that are new or have another title -> (kind, key), what links they may change."""
    old = F.when(F.col("old_title").isNotNull(), fold(F.col("old_title")))
    each = [(PATH, F.col("path")), (STEM, fold(stem(F.col("path")))), (TITLE, fold(F.col("title"))), (TITLE, old)]
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), c.alias("key")) for kind, c in each])
    return docs.select(F.explode(keys).alias("k")).where("k.key is not null").select("k.kind", "k.key").distinct()


def digests(resolved: DataFrame, *more: str) -> DataFrame:
    """(source_id, digest): of a source's resolved links, in any order, repeats included. ``more`` names columns that a
    source has one value of."""
    one = F.xxhash64("target_id", "relationship_type", F.col("relationship_type").isNull(), "how")
    two = F.xxhash64(F.lit(1), F.col("relationship_type").isNull(), "how", "relationship_type", "target_id")

    def total(h: Column) -> Column:  # exact: halves of 32 bits are added as longs
        high, low = F.sum(F.shiftright(h, 32)).cast("decimal(20,0)"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(20,0)")
        return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)").cast("string")

    return resolved.groupBy("source_id", *more).agg(F.concat_ws(" ", F.count("*").cast("string"), total(one), total(two)).alias("digest"))


def edges(docs: DataFrame, scope: DataFrame, text: str = "truth") -> DataFrame:
    """(source_id, target_id, relationship_type). Equal typed edges are one; untyped ones all stay."""
    e = resolve(extract(docs, text), scope).select("source_id", "target_id", "relationship_type")
    return once(e)


def once(e: DataFrame) -> DataFrame:
    typed = e.where("relationship_type is not null").dropDuplicates()
    return typed.unionByName(e.where("relationship_type is null"))


def resolve_with(links: DataFrame, resolver: Callable[[str, str], str | None]) -> DataFrame:
    """The same with a function (label, source path) -> path or None in place of a scope."""

    @F.arrow_udf(T.StringType())
    def call(labels: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array([resolver(a, b) for a, b in zip(labels.to_pylist(), sources.to_pylist())], pa.string())

    rows = links.withColumn("target_path", call("label", "source_path"))
    return rows.withColumn("target_id", doc_id(F.coalesce("target_path", file_name(F.col("label")))))
