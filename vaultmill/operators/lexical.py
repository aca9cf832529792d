"""BM25 over documents: postings, corpus statistics and ranking.

score = sum over query phrases of idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * |D| / average |D|)),
idf = ln((N - n + 0.5) / (n + 0.5)), replaced by 1e-6 where it is not positive. Ranks are by score,
higher first, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultmill.functions.text import REFUSED, query_tokens, terms, terms_of

# fixed values of the ranking function
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(docs: DataFrame, *columns: str, id_col: str = "id") -> DataFrame:
    """(doc_id, terms): the terms of the columns, one after the other."""
    parts = [terms(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    return docs.select(F.col(id_col).alias("doc_id"), (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("terms"))


def postings(docs: DataFrame, *columns: str, id_col: str = "id") -> DataFrame:
    """(doc_id, term, tf, positions, n_tokens). Positions of different columns never adjoin.

    Each row carries its document's length, so a stored index ranks without a join.
    """

    def placed(k: int, c: str) -> Column:
        return F.transform(terms(F.coalesce(F.col(c), F.lit(""))), lambda t, p: F.struct(t.alias("term"), (p + k * (1 << 29)).alias("p")))

    parts = [placed(k, c) for k, c in enumerate(columns)]
    d = docs.select(F.col(id_col).alias("doc_id"), F.sort_array(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("x"))
    # a document's terms are grouped in its row: each begins where the sorted terms change, so nothing is shuffled
    d = d.withColumn("n_tokens", F.size("x"))
    begins = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n_tokens") - 1, F.lit(0))), lambda i: (i == 0) | (F.get("x", i)["term"] != F.get("x", i - 1)["term"]))
    d = d.withColumn("begin", begins)

    def group(begin, k):
        first, tf = F.get("x", begin), F.coalesce(F.get("begin", k + 1), "n_tokens") - begin
        return F.struct(first["term"].alias("term"), tf.alias("tf"), F.when(tf == 1, F.array(first["p"])).otherwise(F.transform(F.slice("x", begin + 1, tf), lambda e: e["p"])).alias("positions"))

    rows = d.select("doc_id", "n_tokens", F.explode(F.when(F.col("n_tokens") > 0, F.transform("begin", group))).alias("g"))
    return rows.select("doc_id", "g.term", "g.tf", "g.positions", "n_tokens")


def postings_of(tokens: DataFrame, query: list[list[str]]) -> DataFrame:
    """The same for the terms of a query alone, from tokens: only what matches is shuffled."""
    wanted = sorted({t for p in query for t in p})
    places = F.filter(F.transform("terms", lambda t, p: F.struct(p.alias("p"), t.alias("term"))), lambda x: x["term"].isin(wanted))
    found = tokens.select("doc_id", F.size("terms").alias("n_tokens"), F.explode(places).alias("x"))
    rows = found.groupBy("doc_id", "n_tokens", F.col("x.term").alias("term")).agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("x.p")).alias("positions"))
    return rows.select("doc_id", "term", "tf", "positions", "n_tokens")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(term, df, cf) from tokens: one scan and one shuffle, of partial sums by term."""
    once = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    x = tokens.select(F.explode(F.concat(once, each)).alias("x"))
    return x.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df"), F.sum("x.cf").alias("cf"))


def lengths(docs: DataFrame, *columns: str, id_col: str = "id") -> DataFrame:
    return tokens(docs, *columns, id_col=id_col).select("doc_id", F.size("terms").alias("n_tokens"))


def stats(doc_lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return doc_lengths.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avgdl"))


def phrases(text: str, strict: bool = True) -> list[list[str]]:
    """The query as a disjunction of phrases, one for each token.

    strict: a token with one of the marks that the query language refuses makes the query fail, so
    nothing matches. Otherwise such tokens are split like text.
    """
    if refused(text, strict):
        return []
    return [p for p in map(terms_of, query_tokens(text)) if p]


def refused(text: str, strict: bool = True) -> bool:
    """Whether the query language takes a token of the text amiss."""
    return strict and any(m in t for t in query_tokens(text) for m in REFUSED)


# -- pruned ranking -------------------------------------------------------------------------------

FIRST = 64  # blocks that set the score to beat, besides those that top_k documents need


def blocks(posts: DataFrame) -> DataFrame:
    """(block, term, n, most_tf, least_tokens): what bounds the scores of a block's documents, for each term."""
    return posts.groupBy("block", "term").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("n_tokens").alias("least_tokens"))


def norm_of(length, avgdl):
    return F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / avgdl)


def bounds(stored: DataFrame, found: DataFrame, corpus: DataFrame, query: list[list[str]]) -> DataFrame:
    """(block, n, bound): no document of a block scores higher. found gives the phrases' numbers of documents."""
    spark = stored.sparkSession
    wanted = spark.createDataFrame([(i, p[0]) for i, p in enumerate(query)], "q int, term string")
    rows = stored.where(F.col("term").isin(*{p[0] for p in query})).join(F.broadcast(wanted), "term").join(weights(found, corpus), "q")
    most = F.col("idf") * (F.col("most_tf") * (K1 + 1)) / (F.col("most_tf") + norm_of(F.col("least_tokens"), F.col("avgdl")))
    return rows.groupBy("block").agg(F.max("n").alias("n"), F.sum(most).alias("bound"))


def pruned(posts: DataFrame, stored: DataFrame, corpus: DataFrame, text: str, top_k: int = 20, strict: bool = True) -> DataFrame:
    """The same as ``search``, for postings in blocks. The blocks with the highest bounds are scored first; blocks whose
    bound is below the score of the last place then cannot change the ranks, and their postings are not
    shuffled. Queries with phrases, and those that few documents match, are searched whole.
    """
    query = phrases(text, strict) if top_k > 0 else []
    if not query or any(len(p) > 1 for p in query):
        return search(posts, corpus, text, top_k, strict)
    found = matches(posts, query)
    bound = bounds(stored, found, corpus, query)
    top = bound.orderBy(F.col("bound").desc()).limit(FIRST + top_k).collect()
    first, n = [], 0
    for r in top:
        if len(first) >= FIRST and n >= top_k:
            break
        first.append(r["block"])
        n += r["n"]
    idf = weights(found, corpus)
    scored = score(matches(posts.where(F.col("block").isin(first)), query), idf)
    best = [r["score"] for r in ranked(scored, top_k).select("score").collect()]
    if len(best) < top_k:
        return search(posts, corpus, text, top_k, strict)
    # scores that are equal to 12 digits are ties
    left = bound.where(F.col("bound") >= min(best) - 1e-9).select("block")
    return ranked(score(matches(posts.join(F.broadcast(left) if left.limit(SOME + 1).count() <= SOME else left, "block", "left_semi"), query), idf), top_k)


SOME = 100_000  # names of blocks that are broadcast


def shifted(k: int):
    return F.transform("positions", lambda x: x - k)


def matches(posts: DataFrame, query: list[list[str]]) -> DataFrame:
    """(q, doc_id, tf, n_tokens): how often each phrase occurs in each document."""
    spark, more = posts.sparkSession, ["n_tokens"]
    single = {t for p in query if len(p) == 1 for t in p}
    out = None
    if single:
        wanted = spark.createDataFrame([(i, p[0]) for i, p in enumerate(query) if len(p) == 1], "q int, term string")
        # the terms also stand in a filter, which reaches the scan of the postings
        out = posts.where(F.col("term").isin(*single)).join(F.broadcast(wanted), "term").select("q", "doc_id", "tf", *more)
    for i, p in enumerate(query):
        if len(p) == 1:
            continue
        docs = None
        for k, t in enumerate(p):
            part = posts.where(F.col("term") == t).select("doc_id", shifted(k).alias(f"p{k}"), *(more if k == 0 else []))
            docs = part if docs is None else docs.join(part, "doc_id")
        starts = F.col("p0")
        for k in range(1, len(p)):
            starts = F.array_intersect(starts, F.col(f"p{k}"))
        rows = docs.select(F.lit(i).alias("q"), "doc_id", F.size(starts).alias("tf"), *more).where("tf > 0")
        out = rows if out is None else out.unionByName(rows)
    return out


def weights(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(q, avgdl, idf): one row for each phrase of the query, to be broadcast."""
    n = found.groupBy("q").agg(F.count("*").alias("n"))
    ratio = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return F.broadcast(n.crossJoin(F.broadcast(corpus)).select("q", "avgdl", F.when(ratio <= 0, F.lit(LEAST_IDF)).otherwise(ratio).alias("idf")))


def score(found: DataFrame, idf: DataFrame) -> DataFrame:
    """found(q, doc_id, tf, n_tokens) -> (doc_id, score)."""
    norm = norm_of(F.col("n_tokens"), F.col("avgdl"))
    return found.join(idf, "q").groupBy("doc_id").agg(F.sum(F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + norm)).alias("score"))


def bm25(found: DataFrame, corpus: DataFrame) -> DataFrame:
    return score(found, weights(found, corpus))


def ranked(scores: DataFrame, top_k: int) -> DataFrame:
    """(doc_id, lexical_rank, score). Scores equal to 12 digits are ties, broken by id."""
    order = [F.col("__tie").desc(), F.col("doc_id")]
    # rounded once a row: a sort makes its expressions anew for each comparison
    top = scores.withColumn("__tie", F.round("score", 12)).orderBy(*order).limit(top_k)
    return top.select("doc_id", F.row_number().over(W.orderBy(*order)).alias("lexical_rank"), "score")  # over top_k rows at most


def search(posts: DataFrame, corpus: DataFrame, text: str, top_k: int = 20, strict: bool = True) -> DataFrame:
    query = phrases(text, strict) if top_k > 0 else []
    if not query:
        return posts.sparkSession.createDataFrame([], "doc_id string, lexical_rank int, score double")
    return ranked(bm25(matches(posts, query), corpus), top_k)
