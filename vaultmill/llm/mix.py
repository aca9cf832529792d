"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

The mix gives every document a rate r >= 0. Among all rates that meet the token constraint of each
source (sum of size * r = target) and stay at or below the cap, entropy balancing takes those
closest in relative entropy to leaving the corpus as it is. The minimiser is an exponential tilt,
``r = min(cap, exp(lambda_source * x))``, and lambda solves a smooth convex dual per source. The
dual needs only the token mass at each (source, x), so documents are pre-aggregated once and the
Newton iterations run over that histogram, distributed by source, with a bracket that falls back
to bisection; a source that has met its tolerance takes one last step, which leaves its lambda exact
to the arithmetic, and sources that do not settle raise. ``base`` names the reference measure:
"documents", the default, weighs all documents alike, so that x is the document's size over its
source's mean size and every size has a rate of its own: sources that grow repeat long documents more,
sources that shrink drop them first. "tokens" weighs a document by its size; x is 1 then, all documents
of a source share one rate, and the source keeps its inner composition.

Rates become whole copies by systematic rounding: within a source, sizes in descending order share
one running sum of fractional copies, and each size gets as many extra copies as the sum passes
whole numbers; a few repairs then add or take away the one document that brings the source
closest to its target. All of that runs on the histogram. Which documents of one size get the
extra copy is settled by rank, built from salted counts and ranks within a salt, so a hot source or
a hot group of copies is never in one task.

Null text: size 0. Null source: a source of its own, last in order. Repeated ids: rows
are dealt separately, ties are between equal keys only. Null ids: rows are spread and ordered by their texts. Empty input: empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultmill.llm.common import cut, fresh, table, text_hash, unused

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000  # rates are kept in millionths, so that running sums are exact integers
SALTS = 251
REPAIRS = 3
WEIGHTS, CAP = (1, 2, 3), 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_fill(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Adds ``target``: shares of the total by weight, none above cap * total of its source.

    The level c with sum(min(cap * S, c * w)) = T is the largest of the levels reached when the
    sources are capped one by one in the order of cap * S / w. One row per source, so the
    unpartitioned windows here see as many rows as there are sources.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sources.withColumn("w", w.cast("long")).withColumn("most", F.col("total") * F.lit(cap).cast("long"))
    before = W.orderBy(F.col("most").cast("double") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("total").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    heavy = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / heavy.cast("double"))
    s = s.withColumn("level", F.max("level").over(every))
    return s.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("w"))).drop("level", "most", "w")


def solve_dual(mass: DataFrame, targets: DataFrame, cap: float, tol: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """Newton on the dual. mass(key, x, mass), targets(key, target) -> (key, lam), one row per key.

    Per source the gradient is sum(mass * min(cap, e^(lam x))) - target and the curvature is
    sum(mass * x * e^(lam x)) over what is below the cap. A step that leaves the bracket (or has no
    curvature) becomes a bisection.
    """
    at_cap = F.log(F.lit(float(cap)))
    first = mass.groupBy("key").agg(F.min(F.when(F.col("mass") > 0, F.col("x"))).alias("least_x"))
    state = targets.join(first, "key", "left").select(
        "key", "target", F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"),
        F.coalesce(F.greatest(at_cap / F.col("least_x"), F.lit(1.0)) + 1.0, F.lit(1.0)).alias("hi"), F.lit(False).alias("done"),
    )
    state = cut(state)
    for k in range(max_rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        tilt = F.col("lam") * F.col("x")
        sums = (
            mass.join(state.where(~F.col("done")).select("key", "lam"), "key")
            .select("key", F.col("mass").cast("double").alias("m"), "x", F.least(F.exp(F.least(tilt, at_cap)), F.lit(float(cap))).alias("r"), (tilt < at_cap).alias("free"))
            .groupBy("key")
            .agg(F.sum(F.col("m") * F.col("r")).alias("got"), F.sum(F.when(F.col("free"), F.col("m") * F.col("x") * F.col("r")).otherwise(0.0)).alias("curve"))
        )
        s = state.join(sums, "key", "left")
        gap = F.coalesce(F.col("got"), F.lit(0.0)) - F.col("target")
        s = s.withColumn("gap", gap)
        s = s.withColumn("lo2", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi2", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - F.try_divide(F.col("gap"), F.col("curve"))
        middle = (F.col("lo2") + F.col("hi2")) / 2
        inside = F.col("curve").isNotNull() & (F.col("curve") > 0) & (step > F.col("lo2")) & (step < F.col("hi2"))
        met = F.abs("gap") <= F.col("target") * tol
        over = F.col("done") | F.col("got").isNull() | met | (F.col("hi2") - F.col("lo2") < 1e-15)
        if k > 20 and k % 2:  # steps that stall at the kinks of the cap: halve the bracket in between
            inside = F.lit(False)
        lam = F.when(F.col("done") | F.col("got").isNull(), F.col("lam")).when(inside, step).when(over, F.col("lam")).otherwise(middle)
        state = cut(s.select("key", "target", lam.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), over.alias("done")))
    else:
        raise RuntimeError(f"rates have not settled in {max_rounds} rounds")
    return state.select("key", "lam")


def round_copies(rated: DataFrame, cap: int) -> DataFrame:
    """(key, size, n, q, target) -> adds whole and extra: of the n documents each gets ``whole``
    copies and the first ``extra`` of them one more.

    Systematic rounding first, then ``REPAIRS`` times the one document is added or taken away that
    brings the source's words closest to its target.
    """
    larger = W.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    part = F.col("n") * (F.col("q") % UNIT)
    r = rated.withColumn("start", F.coalesce(F.sum(part).over(larger), F.lit(0)) + UNIT // 2)
    # integer division: no sum is rounded
    r = r.withColumn("whole", F.expr(f"q div {UNIT}")).withColumn("end", F.col("start") + part)
    r = r.withColumn("extra", F.expr(f"end div {UNIT} - start div {UNIT}")).drop("end")
    for _ in range(REPAIRS):
        r = r.withColumn("gap", F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("extra"))).over(W.partitionBy("key")))
        off = F.abs(F.abs(F.col("gap")) - F.col("size"))
        r = r.withColumn("off", F.when((F.col("gap") > 0) & (F.col("extra") < F.col("n")) & (F.col("whole") < cap), off).when((F.col("gap") < 0) & (F.col("extra") > 0), off))
        best = F.row_number().over(W.partitionBy("key").orderBy(F.col("off").asc_nulls_last(), "size")) == 1
        better = best & (F.col("off") < F.abs(F.col("gap")))
        r = r.withColumn("extra", F.when(better, F.col("extra") + F.signum("gap").cast("long")).otherwise(F.col("extra"))).drop("gap", "off")
    return r.drop("start", "q")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, cap: int = CAP, base: str = "documents") -> tuple[DataFrame, dict[str, str]]:
    """All rows of docs with the columns size, source_size, target, rate and copies added.

    Returns the table and the names that the added columns got (they evade names already there).
    """
    if base not in ("tokens", "documents"):
        raise ValueError("base is tokens or documents")
    n = unused(("size", "source_size", "target", "rate", "copies", "key", "salt", "start", "whole", "extra", "rank", "on_key", "on_size", "on_salt", "tie"), docs)
    sid, src = docs[f"`{id_col}`"], docs[f"`{source_col}`"]
    spread = sid if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else F.when(sid.isNotNull(), F.xxhash64(sid))
    # the words are counted once: a column used twice is not computed again above this projection; rows without an id
    # are spread and ordered by a hash of their texts, which stay behind
    tie = F.when(sid.isNull(), text_hash(docs[f"`{text_col}`"])).alias(n["tie"])
    d = docs.select("*", word_count(docs[f"`{text_col}`"]).alias(n["size"]), F.when(src.isNull(), "n").otherwise(F.concat(F.lit("s"), src.cast("string"))).alias(n["key"]), tie)
    d = d.withColumn(n["salt"], F.pmod(F.pmod(F.coalesce(spread, F.col(n["tie"])), F.lit(SALTS)) + F.col(n["size"]), F.lit(SALTS)).cast("int"))
    cells = cut(d.groupBy(F.col(n["key"]).alias("key"), F.col(n["size"]).alias("size"), F.col(n["salt"]).alias("salt")).agg(F.count("*").alias("n")))
    sizes = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    totals = sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs"))
    totals = totals.withColumn("source", F.when(F.col("key") == "n", None).otherwise(F.expr("substring(key, 2)")))
    targets = cut(water_fill(totals, weights, cap))
    x = F.lit(1.0) if base == "tokens" else F.col("size") * F.col("docs") / F.col("total")
    tilted = sizes.join(targets.select("key", "docs", "total"), "key").where("total > 0").withColumn("x", x)
    mass = cut(tilted.groupBy("key", "x").agg(F.sum(F.col("n") * F.col("size")).alias("mass")))
    dual = solve_dual(mass, targets.select("key", "target"), cap)
    rate = F.when(F.col("total") > 0, F.least(F.exp(F.least(F.col("lam") * x, F.lit(50.0))), F.lit(float(cap)))).otherwise(0.0)
    rated = sizes.join(targets.join(dual, "key"), "key").withColumn("rate", rate)
    rated = rated.withColumn("q", F.least(F.round(F.col("rate") * UNIT).cast("long"), F.lit(cap * UNIT).cast("long")))
    rated = round_copies(rated.withColumnRenamed("total", "source_size"), cap)
    earlier = W.partitionBy("key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.join(rated.select("key", "size", "whole", "extra", "rate", "target", "source_size"), ["key", "size"])
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    for c in ("key", "size", "salt"):
        starts = starts.withColumnRenamed(c, n[f"on_{c}"])
    for c in ("start", "whole", "extra", "rate", "target", "source_size"):
        starts = starts.withColumnRenamed(c, n[c])
    on = [d[n[c]] == starts[n[f"on_{c}"]] for c in ("key", "size", "salt")]
    j = d.join(starts, on)
    order = W.partitionBy(n["key"], n["size"], n["salt"]).orderBy(F.col(f"`{id_col}`").asc_nulls_last(), n["tie"])
    j = j.withColumn(n["rank"], F.row_number().over(order).cast("long"))
    more = F.col(n["start"]) + F.col(n["rank"]) <= F.col(n["extra"])
    j = j.withColumn(n["copies"], F.col(n["whole"]) + more.cast("long"))
    return j.drop(*[n[c] for c in ("key", "salt", "start", "whole", "extra", "rank", "on_key", "on_size", "on_salt", "tie")]), n


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each document repeated as often as it has copies, with the columns of docs."""
    j, n = mix(docs)
    i = fresh(j, "copy")
    j = j.where(F.col(n["copies"]) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n["copies"]).cast("int"))))
    return j.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, n = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return j.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS total, count(*)::BIGINT AS docs FROM d GROUP BY k),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, total * 3 AS most FROM s),
o AS (SELECT *, (sum(total) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, total, docs, least(most::DOUBLE, (max(level) OVER ()) * w) AS target FROM o),
m AS (SELECT d.k, size, count(*)::BIGINT AS n, any_value(t.total) AS total, any_value(t.target) AS target, any_value(t.docs) AS docs
  FROM d JOIN t ON d.k = t.k GROUP BY d.k, size),
x AS (SELECT *, CASE WHEN total > 0 THEN (size * docs)::DOUBLE / total END AS x FROM m),
b AS (
  SELECT k, -700.0::DOUBLE AS lo, greatest(ln(3.0::DOUBLE) / min(x), 1.0::DOUBLE) + 1 AS hi, 0 AS i FROM x WHERE x > 0 GROUP BY k
  UNION ALL
  SELECT b.k, CASE WHEN sum(n * size * least(exp(least((lo + hi) / 2 * x, ln(3.0::DOUBLE))), 3.0::DOUBLE)) < any_value(target) THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN sum(n * size * least(exp(least((lo + hi) / 2 * x, ln(3.0::DOUBLE))), 3.0::DOUBLE)) < any_value(target) THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM b JOIN x ON b.k = x.k WHERE i < 100 GROUP BY b.k, lo, hi, i),
h AS (SELECT x.k, size, n, total, target,
    CASE WHEN total > 0 THEN least(round(least(exp(least((lo + hi) / 2 * x, 50.0)), 3.0::DOUBLE) * 1000000)::BIGINT, 3000000) ELSE 0 END AS q
  FROM x LEFT JOIN (SELECT * FROM b WHERE i = 100) e ON e.k = x.k),
c AS (SELECT *, coalesce(sum(n * (q % 1000000)) OVER (PARTITION BY k ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 500000 AS start FROM h),
e0 AS (SELECT k, size, n, total, target, q // 1000000 AS whole, (start + n * (q % 1000000)) // 1000000 - start // 1000000 AS extra FROM c),
g1 AS (SELECT *, target - sum(size * (n * whole + extra)) OVER (PARTITION BY k)::BIGINT AS gap FROM e0),
o1 AS (SELECT *, CASE WHEN gap > 0 AND extra < n AND whole < 3 OR gap < 0 AND extra > 0 THEN abs(abs(gap) - size) END AS dist FROM g1),
e1 AS (SELECT k, size, n, total, target, whole,
  CASE WHEN row_number() OVER (PARTITION BY k ORDER BY dist NULLS LAST, size) = 1 AND dist < abs(gap) THEN extra + sign(gap)::BIGINT ELSE extra END AS extra FROM o1),
g2 AS (SELECT *, target - sum(size * (n * whole + extra)) OVER (PARTITION BY k)::BIGINT AS gap FROM e1),
o2 AS (SELECT *, CASE WHEN gap > 0 AND extra < n AND whole < 3 OR gap < 0 AND extra > 0 THEN abs(abs(gap) - size) END AS dist FROM g2),
e2 AS (SELECT k, size, n, total, target, whole,
  CASE WHEN row_number() OVER (PARTITION BY k ORDER BY dist NULLS LAST, size) = 1 AND dist < abs(gap) THEN extra + sign(gap)::BIGINT ELSE extra END AS extra FROM o2),
g3 AS (SELECT *, target - sum(size * (n * whole + extra)) OVER (PARTITION BY k)::BIGINT AS gap FROM e2),
o3 AS (SELECT *, CASE WHEN gap > 0 AND extra < n AND whole < 3 OR gap < 0 AND extra > 0 THEN abs(abs(gap) - size) END AS dist FROM g3),
e3 AS (SELECT k, size, n, total, target, whole,
  CASE WHEN row_number() OVER (PARTITION BY k ORDER BY dist NULLS LAST, size) = 1 AND dist < abs(gap) THEN extra + sign(gap)::BIGINT ELSE extra END AS extra FROM o3),
r AS (SELECT d.doc_id, d.size, e.total, e.target, e.whole, e.extra,
  row_number() OVER (PARTITION BY d.k, d.size ORDER BY (d.doc_id % 251 + d.size) % 251, d.doc_id) AS rn
  FROM d JOIN e3 e ON d.k = e.k AND d.size = e.size)
SELECT doc_id, size, total AS source_size, target, size * (whole + (rn <= extra)::BIGINT) AS taken, (whole + (rn <= extra)::BIGINT)::BIGINT AS copies FROM r
"""
