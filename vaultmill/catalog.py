"""The engine's queries on the driver's tables, with their SQL.

The tables hold no linked notes, so inputs are rendered from them (rows become notes, keys become
links); operators are the engine's own. Every query runs over its whole tables.
"""

from __future__ import annotations

import contextlib
import io
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultmill import cli
from vaultmill.errors import VaultError
from vaultmill.functions.text import content_hash, doc_id, excerpt, sanitized
from vaultmill.operators import cells, chunk, embed, fuse, graph, lexical, links, semantic
from vaultmill.operators.parse import parse, split_page
from vaultmill.plans import render
from vaultmill.plans.ingest import Stats, detect_changes, ingest_files
from vaultmill.plans.query import Engine
from vaultmill.plans.store import Store
from vaultmill.plans.tools import Tools
from vaultmill.schema import DOCUMENT, DOCUMENTS, RESULT
from vaultmill.sources.vault import scan
from vaultmill.streaming.ingest import watch

TEXT = "the nicht pour ciónes"
TOP = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- lexical ------------------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def scores(spark: SparkSession, sf_dir: str, text: str = TEXT) -> DataFrame:
    """BM25 of all documents straight from the texts."""
    tokens, query = lexical.tokens(corpus(spark, sf_dir), "text"), lexical.phrases(text)
    stats = lexical.stats(tokens.select(F.size("terms").alias("n_tokens")))
    return lexical.bm25(lexical.matches(lexical.postings_of(tokens, query), query), stats)


def lexical_top(spark: SparkSession, sf_dir: str, text: str = TEXT, top_k: int = TOP) -> DataFrame:
    return lexical.ranked(scores(spark, sf_dir, text), top_k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_top(spark, sf_dir).select("doc_id", "lexical_rank", F.round("score", 9).alias("score"))


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("doc_id", F.round("score", 9).alias("score"))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.stats(lexical.lengths(corpus(spark, sf_dir), "text")).select("n_docs", F.round("avgdl", 9).alias("avgdl"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lengths(corpus(spark, sf_dir), "text")


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.vocabulary(lexical.tokens(corpus(spark, sf_dir), "text"))


def phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose one token is a phrase of two terms, matched on positions."""
    top = lexical_top(spark, sf_dir, "of–the")
    return top.select("doc_id", "lexical_rank", F.round("score", 9).alias("score"))


_TOKENS = r"""t AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}\p{Co}\p{M}]+'), lambda x: x <> '') AS terms FROM documents),
l AS (SELECT doc_id, len(terms) AS n FROM t),
s AS (SELECT count(*) AS n_docs, avg(n) AS avgdl FROM l)"""
_BM25 = f"""{_TOKENS},
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) WHERE term IN ('the', 'nicht', 'pour', 'ciones') GROUP BY ALL),
i AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf
  FROM (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term), s),
b AS (SELECT p.doc_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.n / s.avgdl))) AS score
  FROM p JOIN i USING (term) JOIN l ON l.doc_id = p.doc_id, s GROUP BY p.doc_id)"""
_LEX = f"{_BM25}, lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id)::INTEGER AS lexical_rank, score FROM b QUALIFY lexical_rank <= {TOP})"

# -- semantic and fusion ------------------------------------------------------------------------


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector serves as query."""
    return [float(x) for x in read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(F.floor(v / 2).alias("doc_id"), (v % 2).cast("int").alias("chunk_index"), "embedding")


def knn_topk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = semantic.nearest(chunk_vectors(spark, sf_dir), probe(spark, sf_dir), TOP)
    return near.select("doc_id", "chunk_index", "rank", F.round("distance", 9).alias("distance"))


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = semantic.nearest(chunk_vectors(spark, sf_dir), probe(spark, sf_dir), TOP, "cosine")
    return near.select("doc_id", "chunk_index", "rank", F.round("distance", 9).alias("distance"))


def knn_cells(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same by an index of cells over all vectors, of which a search skips those that are too far."""
        index = cells.CellIndex.build(chunk_vectors(spark, sf_dir), shared_folder(spark, "cells"), metric)
        return index.nearest(probe(spark, sf_dir), TOP).select("doc_id", "chunk_index", "rank", F.round("distance", 9).alias("distance"))

    return run


def knn_best_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.search(chunk_vectors(spark, sf_dir), probe(spark, sf_dir), TOP)


def fused(spark: SparkSession, sf_dir: str, top_k: int) -> DataFrame:
    c = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    return fuse.fuse(lexical_top(spark, sf_dir), semantic.search(c, probe(spark, sf_dir), TOP), top_k)


def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, 30).select("doc_id", "chunk_index", F.round("rrf_score", 9).alias("rrf_score"), "lexical_rank", "semantic_rank", "signal")


def signal_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, 2 * TOP).groupBy("signal").agg(F.count("*").alias("n"))


_KNN = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
d AS (SELECT vec_id // 2 AS doc_id, (vec_id % 2)::INTEGER AS chunk_index, list_distance(embedding::DOUBLE[], q) AS distance FROM embeddings, q),
k AS (SELECT *, row_number() OVER (ORDER BY round(distance, 12), doc_id, chunk_index)::INTEGER AS rank FROM d QUALIFY rank <= 20)"""
_FUSE = f"""WITH {_LEX}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
d AS (SELECT vec_id AS doc_id, list_distance(embedding::DOUBLE[], q) AS distance FROM embeddings, q),
sem AS (SELECT doc_id, row_number() OVER (ORDER BY round(distance, 12), doc_id)::INTEGER AS semantic_rank FROM d QUALIFY semantic_rank <= {TOP}),
f AS (SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, CASE WHEN sem.doc_id IS NOT NULL THEN 0 END AS chunk_index,
  coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) AS rrf_score, lexical_rank, semantic_rank,
  CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 'fused' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS signal
  FROM lex FULL JOIN sem ON lex.doc_id = sem.doc_id)"""

# -- documents, chunks --------------------------------------------------------------------------


def doc_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", doc_id(F.col("url")).alias("id"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files with front matter and a timeline."""
    d = read(spark, sf_dir, "documents")
    body = F.concat(F.lit("---\ntitle: Note "), F.col("doc_id").cast("string"), F.lit("\ndomain: "), F.col("lang"), F.lit("\n---\n\n"), F.col("text"), F.lit("\n\n---\n\n## Timeline\n\n- from "), F.col("source"), F.lit("\n"))
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.cast("binary").alias("content"))


def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(files(spark, sf_dir)).select("id", "path", "title", "domain", "content_hash", "timeline_text", "metadata_json", "truth", F.coalesce("error", F.lit("")).alias("error"))


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, timeline = split_page(F.col("page"))
    page = F.concat("text", F.lit("\n---\n\n## TimeLine \n\n"), "source")
    return read(spark, sf_dir, "documents").withColumn("page", page).select("doc_id", truth.alias("truth"), timeline.alias("timeline"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    return read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(turns, "\n\n").alias("truth"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_rows(dialogues(spark, sf_dir))


VOCABULARY = ("the", "nicht", "pour", "una", "region", "lies", "lives", "buys", "asia")


def vocabulary() -> embed.Embedder:
    return embed.VocabularyEmbedder(VOCABULARY)


def shown(vector: str):
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",")


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embed.embedded(chunk_pack(spark, sf_dir), vocabulary)
    return v.select("doc_id", "chunk_index", shown("embedding").alias("vector"))


def sanitize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", sanitized(F.concat("url", F.lit(" AND NOT or_x"))).alias("match"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))


def changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored documents, and a batch in which German ones are edited and Spanish ones are new."""
    d = read(spark, sf_dir, "documents")
    stored = d.where("lang <> 'es'").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("at "), "source").alias("created_at"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return stored, d.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("content_hash"))


def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = changed(spark, sf_dir)
    return detect_changes(batch, stored).select("id", "status", F.coalesce("kept_created_at", F.lit("")).alias("created_at"))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to a store; the rows of the second stand in place of those of the same id."""
    store = fresh_store(spark)
    for rows in changed(spark, sf_dir):
        rows = rows.select(F.col("id").cast("string").alias("id"), "content_hash")
        gone = rows.select("id", F.lit("document").alias("what"))
        store.append({"documents": rows.select("*", *[F.lit("").alias(f.name) for f in DOCUMENTS if f.name not in rows.columns])}, gone)
    return store.table("documents").select("id", "content_hash")


# -- links and graph ----------------------------------------------------------------------------


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers as notes that link each other by name."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    link = lambda label, rel="": F.concat(F.lit("[["), label, F.lit("]]"), F.lit(f" ({rel})" if rel else ""))
    name = lambda folder, col: F.concat(F.lit(f"{folder}/"), F.col(col), F.lit(".md"))
    nation = n.select(F.col("n_nationkey").alias("k"), "n_name")
    rows = r.select(name("region", "r_name").alias("path"), F.col("r_name").alias("title"), F.lit("A region.").alias("truth"))
    rows = rows.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(name("nation", "n_name").alias("path"), F.col("n_name").alias("title"), F.concat(F.lit("Lies in "), link(F.concat(F.lit("region/"), "r_name"), "in"), F.lit(".")).alias("truth")))
    rows = rows.unionByName(s.join(nation, F.col("s_nationkey") == F.col("k")).select(name("supplier", "s_name").alias("path"), F.lit("Supplier").alias("title"), F.concat(F.lit("From "), link(F.col("n_name"), "from"), F.lit(", again "), link(F.col("n_name"), "from"), F.lit(", see [[Supplier]].")).alias("truth")))
    rows = rows.unionByName(c.join(nation, F.col("c_nationkey") == F.col("k")).select(name("customer", "c_name").alias("path"), F.col("c_name").alias("title"), F.concat(F.lit("Lives in "), link(F.lower("n_name"), "in"), F.lit(", buys "), link(F.concat(F.lit("segment/"), "c_mktsegment")), F.lit(" and "), link(F.concat(F.lit("segment/"), "c_mktsegment"))).alias("truth")))
    return rows.select(doc_id(F.col("path")).alias("id"), "path", "title", "truth")


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract(notes(spark, sf_dir)).select("source_path", "n", "label", "relationship_type")


def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    return links.resolve(links.extract(n), n).select("source_path", "n", "target_path", "target_id")


def resolve_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved by a function of label and source in place of a scope."""
    found = links.extract(notes(spark, sf_dir))
    place = lambda label, source: f"nation/{label}.md" if label.isupper() and not source.startswith("region/") else None
    return links.resolve_with(found, place).select("source_path", "n", "target_path", "target_id")


CASES = ("[[%]] (x)", "[[%]](y z)", "[[%]]\n (n)", "[[%]] ()", "[[ % ]] ( s )", "[[%", "[[a[%]]]", "[[]] (%)", "[[a]] [[%]](r)[[%]]", "[[%.md]] (x) (y)", "[[a\nb%]]", "[%]")


def link_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(list(enumerate(CASES)), "k int, form string")
    rows = read(spark, sf_dir, "region").crossJoin(F.broadcast(cases))  # a dozen forms of a link for each region
    docs = rows.select(F.concat(F.col("k").cast("string"), "r_name").alias("path"), F.replace("form", F.lit("%"), F.col("r_name")).alias("truth")).withColumn("id", doc_id(F.col("path")))
    return links.extract(docs).select("source_path", "n", "label", "relationship_type")


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    return links.edges(n, n)


def neighbors_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    return graph.neighbors(links.edges(n, n), n)


def hops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges order -> customer -> nation -> region (and one dangling from each order), the documents, and urgent orders as seeds."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    key = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    e = o.select(key("o", "o_orderkey").alias("source_id"), key("c", "o_custkey").alias("target_id"))
    e = e.unionByName(o.select(key("o", "o_orderkey").alias("source_id"), key("x", "o_orderkey").alias("target_id")))
    e = e.unionByName(c.select(key("c", "c_custkey").alias("source_id"), key("n", "c_nationkey").alias("target_id")))
    e = e.unionByName(n.select(key("n", "n_nationkey").alias("source_id"), key("r", "n_regionkey").alias("target_id")))
    d = o.select(key("o", "o_orderkey").alias("id")).unionByName(c.select(key("c", "c_custkey").alias("id"))).unionByName(n.select(key("n", "n_nationkey").alias("id"))).unionByName(r.select(key("r", "r_regionkey").alias("id")))
    seeds = o.where("o_orderpriority = '1-URGENT'").select(key("o", "o_orderkey").alias("doc_id"))
    return e, d, seeds


def expand_depth(depth: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, d, seeds = hops(spark, sf_dir)
        return graph.walk(seeds, e, d, depth)

    return run


def expand_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, seeds = hops(spark, sf_dir)
    return graph.expand(seeds, e, d, 3, 50)


_NOTES = """notes AS (
  SELECT 'region/' || r_name || '.md' AS path, r_name AS title, 'A region.' AS truth FROM region
  UNION ALL SELECT 'nation/' || n_name || '.md', n_name, 'Lies in [[region/' || r_name || ']] (in).' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier/' || s_name || '.md', 'Supplier', 'From [[' || n_name || ']] (from), again [[' || n_name || ']] (from), see [[Supplier]].' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer/' || c_name || '.md', c_name, 'Lives in [[' || lower(n_name) || ']] (in), buys [[segment/' || c_mktsegment || ']] and [[segment/' || c_mktsegment || ']]' FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT path AS source_path, unnest(range(len(labels))) AS n, unnest(labels) AS label, nullif(unnest(rels), '') AS relationship_type
  FROM (SELECT path, regexp_extract_all(truth, '\\[\\[([^\\[\\]]+?)\\]\\](?:\\s*\\(([^)]+)\\))?', 1) AS labels, regexp_extract_all(truth, '\\[\\[([^\\[\\]]+?)\\]\\](?:\\s*\\(([^)]+)\\))?', 2) AS rels FROM notes))"""
_RESOLVE = f"""{_NOTES},
st AS (SELECT lower(regexp_extract(path, '([^/]*)\\.[^./]*$', 1)) AS k, min(path) AS p FROM notes GROUP BY 1 HAVING count(DISTINCT path) = 1),
ti AS (SELECT lower(title) AS k, min(path) AS p FROM notes GROUP BY 1 HAVING count(DISTINCT path) = 1),
r AS (SELECT m.*, CASE WHEN ends_with(label, '.md') THEN label ELSE label || '.md' END AS name FROM m),
z AS (SELECT r.source_path, r.n, r.relationship_type, r.name,
    coalesce(e.path, CASE WHEN NOT contains(name, '/') THEN s.path END, CASE WHEN NOT contains(name, '/') THEN st.p END, ti.p) AS target_path
  FROM r LEFT JOIN notes e ON e.path = name
  LEFT JOIN notes s ON s.path = regexp_extract(r.source_path, '^(.*/)', 1) || name
  LEFT JOIN st ON st.k = lower(label) LEFT JOIN ti ON ti.k = lower(label)),
x AS (SELECT *, left(sha256(source_path), 16) AS source_id, left(sha256(coalesce(target_path, name)), 16) AS target_id FROM z),
edges AS (SELECT DISTINCT source_id, target_id, relationship_type FROM x WHERE relationship_type IS NOT NULL
  UNION ALL SELECT source_id, target_id, relationship_type FROM x WHERE relationship_type IS NULL)"""
_HOPS = """e AS (SELECT 'o' || o_orderkey AS s, 'c' || o_custkey AS t FROM orders UNION ALL SELECT 'o' || o_orderkey, 'x' || o_orderkey FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
d AS (SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
seeds AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
w(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT e.t, depth + 1 FROM w JOIN e ON e.s = w.id JOIN d ON d.id = e.t WHERE depth < {depth}),
b AS (SELECT id AS doc_id, min(depth)::INTEGER AS expansion_depth FROM w GROUP BY id HAVING min(depth) > 0)"""

# -- the engine end to end ----------------------------------------------------------------------

QUESTION = "lies in region ASIA"
SOME_NOTE = "customer/Customer#000000001.md"


def shared_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="vaultmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """Notes over all cores: small tables come in few partitions, and what is made of their rows is far larger."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def as_files(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("truth").cast("binary").alias("content"))


def fresh_store(spark: SparkSession) -> Store:
    return Store.create(spark, shared_folder(spark, "store"))


def ingested(spark: SparkSession, sf_dir: str) -> Store:
    store = fresh_store(spark)
    ingest_files(as_files(notes(spark, sf_dir)), store, vocabulary)
    return store


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' notes with a word more."""
    return notes(spark, sf_dir).where(F.col("path").startswith("nation/")).withColumn("truth", F.concat("truth", F.lit(" Edited.")))


def engine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest of the notes into a fresh store, then a fused query with expansion."""
    return Engine(spark, ingested(spark, sf_dir), vocabulary()).query(QUESTION, expand=True, expand_depth=2)


def engine_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ingested(spark, sf_dir)
    i = store.table("documents").where(F.col("path") == SOME_NOTE).first()["id"]
    return Engine(spark, store, vocabulary()).neighbors(i)


def stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking by the stored postings."""
    top = Engine(spark, ingested(spark, sf_dir), vocabulary()).lexical(QUESTION)
    return top.select("doc_id", "lexical_rank", F.round("score", 9).alias("score"))


def pruned_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by the blocks of postings that can still matter; some of the notes were replaced by themselves."""
    store = ingested(spark, sf_dir)
    ingest_files(as_files(edited(spark, sf_dir)), store, vocabulary)
    ingest_files(as_files(notes(spark, sf_dir)), store, vocabulary)
    top = Engine(spark, store, vocabulary(), prune_from=0).lexical(QUESTION)
    return top.select("doc_id", "lexical_rank", F.round("score", 9).alias("score"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with front matter and timeline, and their chunks, as a store has them."""
    store = fresh_store(spark)
    ingest_files(files(spark, sf_dir), store, vocabulary)
    return store.table("documents").select("id", "path", "title", "domain", "content_hash", "timeline_text", "metadata_json")


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen by a number and a date of their front matter, read by path and type."""
    day = F.concat(F.lit("2020-01-0"), (F.col("doc_id") % 9 + 1).cast("string"))
    head = F.concat(F.lit("---\nsize:\n  chars: "), F.coalesce(F.col("n_chars").cast("string"), F.lit("none")), F.lit("\nmade: "), day, F.lit("\nlangs: ["), F.col("lang"), F.lit("]\n---\n"))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(head, "text").cast("binary").alias("content"))
    store = fresh_store(spark)
    ingest_files(rows, store, vocabulary, keep_dates=True)
    engine = Engine(spark, store, vocabulary())
    long, late = engine.having("$.size.chars", "int", lambda v: v > 2000), engine.having("$.made", "date", lambda v: v >= F.lit("2020-01-04").cast("date"))
    lang = engine.having("$.langs[0]", "string", lambda v: v.isin("de", "en"))
    j = long.select("path", F.col("value").alias("chars")).join(late.select("path", F.col("value").cast("string").alias("made")), "path")
    return j.join(lang.select("path", F.col("value").alias("lang")), "path")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir).table("chunks").select("doc_id", "chunk_index", "text", shown("embedding").alias("vector"))


def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ingest replaces what changed: documents, chunks and lengths after it."""
    store = ingested(spark, sf_dir)
    ingest_files(as_files(edited(spark, sf_dir)), store, vocabulary)
    chunks, lengths = store.table("chunks"), store.table("lengths")
    terms = store.table("postings").groupBy("doc_id").agg(F.count("*").alias("terms"))
    d = store.table("documents").select(F.col("id").alias("doc_id"), "content_hash")
    return d.join(chunks, "doc_id").join(lengths, "doc_id").join(terms, "doc_id").select("doc_id", "content_hash", "text", "n_tokens", "terms")


def late_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that dangled at first, after their targets came."""
    store, all_notes = fresh_store(spark), notes(spark, sf_dir)
    ingest_files(as_files(all_notes.where(F.col("path").startswith("customer/"))), store, vocabulary)
    ingest_files(as_files(all_notes), store, vocabulary)
    store.compact()
    return store.table("edges")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of three runs: all notes, the same with some edited, and files that are no text."""
    store = fresh_store(spark)
    rest = notes(spark, sf_dir).where(~F.col("path").startswith("nation/"))
    bad = read(spark, sf_dir, "region").select("r_name", F.expr("X'C328'").alias("content"))
    runs: list[Callable[[], Stats]] = [
        lambda: ingest_files(as_files(notes(spark, sf_dir)), store, vocabulary),
        lambda: ingest_files(as_files(rest.unionByName(edited(spark, sf_dir))), store, vocabulary),
        lambda: ingest_files(bad.select(F.concat("r_name", F.lit(".md")).alias("path"), "content"), store, vocabulary),
    ]
    rows = [(k, s.total, s.ingested, s.skipped, s.failed) for k, s in enumerate(r() for r in runs)]
    return spark.createDataFrame(rows, "run int, total long, ingested long, skipped long, failed long")


def tool_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool's answer, read back from its JSON."""
    tools = Tools(spark, ingested(spark, sf_dir).root, vocabulary())
    rows = tools.query(QUESTION, expand=True, expand_depth=2).rows
    return spark.createDataFrame([tuple(r[f.name] for f in RESULT) for r in rows], RESULT)


def tool_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ingested(spark, sf_dir)
    i = store.table("documents").where(F.col("path") == SOME_NOTE).first()["id"]
    rows = Tools(spark, store.root, vocabulary()).graph_neighbors(i).rows
    return spark.createDataFrame([(r["target_id"], r["relationship_type"], r["target_path"]) for r in rows], "target_id string, relationship_type string, target_path string")


def rendered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = render.results_text(engine_query(spark, sf_dir))
    blocks = [f"#{b}".rstrip("\n") for b in f"\n{text}".split("\n#")[1:]]
    return spark.createDataFrame(list(enumerate(blocks, 1)), "position int, block string")


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows come back where there is nothing to ask or to return."""
    engine = Engine(spark, ingested(spark, sf_dir), vocabulary())
    runs = {
        "operators only": lambda: engine.lexical("AND OR NOT"), "blank": lambda: engine.lexical("  "), "refused": lambda: engine.lexical("it's"), "lexical 0": lambda: engine.lexical(QUESTION, 0),
        "semantic 0": lambda: engine.semantic(QUESTION, 0), "final 0": lambda: engine.query(QUESTION, final_top_k=0), "depth 0": lambda: engine.query(QUESTION, expand=True, expand_depth=0),
        "expanded 0": lambda: engine.query(QUESTION, expand=True, expand_top_k=0), "unknown id": lambda: engine.neighbors("none"),
        "lexical all": lambda: engine.lexical(QUESTION, 1_000_000), "semantic all": lambda: engine.semantic(QUESTION, 1_000_000), "depth 3": lambda: engine.query(QUESTION, expand=True, expand_depth=3, expand_top_k=1_000_000),
    }
    return spark.createDataFrame([(k, r().count()) for k, r in runs.items()], "asked string, n long")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which error each wrong use gives, and how many documents the store has after it."""
    store, nowhere = ingested(spark, sf_dir), shared_folder(spark, "none")
    engine = Engine(spark, store, vocabulary())
    bad = spark.createDataFrame([("x.md", bytearray(b"---\na: [\n---\n"))], "path string, content binary")
    wrong = {
        "open": lambda: Store.open(spark, nowhere), "tools": lambda: Tools(spark, nowhere, vocabulary()), "unknown": lambda: engine.require("none"), "depth": lambda: engine.query("x", expand=True, expand_depth=4),
        "negative": lambda: engine.query("x", expand=True, expand_top_k=-1), "strict": lambda: ingest_files(bad, store, vocabulary, strict=True), "lost": lambda: lose(store, engine),
    }
    rows = []
    for name, run in wrong.items():
        try:
            run()
            rows.append((name, "none", store.table("documents").count()))
        except VaultError as e:
            rows.append((name, type(e).__name__, store.table("documents").count()))
    return spark.createDataFrame(rows, "used string, error string, documents long")


def lose(store: Store, engine: Engine) -> None:
    """A hit whose document is gone."""
    gone = store.table("documents").select("id", F.lit("document").alias("what"))
    kept = {t: store.table(t) for t in ("postings", "lengths", "chunks")}
    store.append(kept, gone)
    engine.query(QUESTION)


def write_files(rows: DataFrame, folder: str) -> int:
    """rows(path, truth) as files below a folder, written by tasks. Returns how many."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for b in batches:
            for path, text in zip(*(c.to_pylist() for c in b.columns)):
                at = f"{base}/{path}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(at) as out:
                    out.write(text.encode())
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    return spread(rows.select("path", "truth")).mapInArrow(put, "n long").agg(F.sum("n")).first()[0]


def written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with all notes as files."""
    folder = shared_folder(spark, "notes")
    write_files(notes(spark, sf_dir), folder)
    return folder


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, written(spark, sf_dir))
    return found.select("path", F.sha2("content", 256).alias("content_hash"), doc_id(F.col("path")).alias("id"))


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commands return and print, over all notes."""
    folder, root = written(spark, sf_dir), shared_folder(spark, "store")
    known = spark.range(1).select(doc_id(F.lit(SOME_NOTE))).first()[0]
    runs = [
        ("early", ["query", "x"]), ("init", ["init"]), ("ingest", ["ingest", folder]), ("again", ["ingest", folder]), ("hits", ["query", QUESTION, "--top-k", "3", "--expand", "--expand-top-k", "2"]),
        ("nothing", ["query", "x", "--semantic-top-k", "0"]), ("neighbors", ["neighbors", known]), ("unknown", ["neighbors", "none"]), ("json", ["neighbors", "none", "--json"]),
    ]
    rows = []
    for name, args in runs:
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(io.StringIO()):
            code = cli.main([*args, "--store", root], spark, vocabulary)
        rows.append((name, code, said.getvalue().strip().replace(root, "STORE")))
    return spark.createDataFrame(rows, "command string, code int, said string")


def snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query on a state of the store that later writes have left behind: notes edited, and the regions gone."""
    store = ingested(spark, sf_dir)
    with store.snapshot() as held:
        ingest_files(as_files(edited(spark, sf_dir)), store, vocabulary)
        store.append({}, notes(spark, sf_dir).where(F.col("path").startswith("region/")).select("id", F.lit(DOCUMENT).alias("what")))
        store.compact()
        store.vacuum(grace=0)
        return Engine(spark, store, vocabulary()).query(QUESTION, expand=True, expand_depth=2, at=held)


def streamed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a folder: first customers and nations, then the rest, and the nations edited. Documents with their edges."""
    folder, all_notes, store = shared_folder(spark, "notes"), notes(spark, sf_dir), fresh_store(spark)
    first = F.col("path").startswith("customer/") | F.col("path").startswith("nation/")
    for rows in (all_notes.where(first), all_notes.where(~first).unionByName(edited(spark, sf_dir))):
        write_files(rows, folder)
        watch(spark, folder, store, vocabulary, shared_folder(spark, "stream"), once=True, most=1_000_000).awaitTermination()
    edges = store.table("edges").withColumnRenamed("source_id", "id")
    return store.table("documents").select("id", "path", "content_hash").join(edges, "id", "left")


def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second ingest of all notes writes, a few of them edited and a link target new: rows of each table."""
    store, all_notes = fresh_store(spark), notes(spark, sf_dir)
    late = F.col("path") == "region/ASIA.md"
    ingest_files(as_files(all_notes.where(~late)), store, vocabulary)
    after = all_notes.where(~F.col("path").startswith("supplier/")).unionByName(all_notes.where(F.col("path").startswith("supplier/")).withColumn("truth", F.concat("truth", F.lit(" Edited."))))
    ingest_files(as_files(after), store, vocabulary)
    last = f"{store.root}/{store.segments()[-1]}"
    counts = [spark.read.parquet(f"{last}/{t}").select(F.lit(t).alias("written")) for t in ("documents", "chunks", "links", "edges", "digests")]
    gone = spark.read.parquet(f"{last}/gone").select(F.concat(F.lit("gone "), "what").alias("written"))
    return reduce(DataFrame.unionByName, counts, gone).groupBy("written").agg(F.count("*").alias("n"))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus statistics that the list of a store carries, after an upsert and a merge."""
    store = ingested(spark, sf_dir)
    ingest_files(as_files(edited(spark, sf_dir)), store, vocabulary)
    ingest_files(as_files(edited(spark, sf_dir).withColumn("truth", F.concat("truth", F.lit(" Again.")))), store, vocabulary)
    store.compact(2)
    return store.snapshot().corpus().select("n_docs", F.round("avgdl", 9).alias("avgdl"))


def rendered_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of all neighbours of the first note in each folder."""
    engine = Engine(spark, ingested(spark, sf_dir), vocabulary())
    first = engine.store.table("documents").groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.min_by("id", "path").alias("id")).orderBy("folder").collect()
    return spark.createDataFrame([(r["folder"], render.neighbors_text(engine.neighbors(r["id"]))) for r in first], "folder string, said string")


def tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tools answer to each nation's id, as it is and reversed: neighbours, or an error that names the id."""
    store = ingested(spark, sf_dir)
    tools, ids = Tools(spark, store.root, vocabulary()), store.table("documents").where(F.col("path").startswith("nation/")).orderBy("path").select("id").collect()
    asked = [i for r in ids for i in (r["id"], r["id"][::-1])]
    got = [(i, tools.graph_neighbors(i)) for i in asked]
    return spark.createDataFrame([(i, r.is_error, r.text if r.is_error else str(len(r.rows))) for i, r in got], "id string, is_error boolean, said string")


def stored_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that a store keeps: made by the first ingest, changed by the second, for the notes that were edited."""
    store = fresh_store(spark)
    ingest_files(as_files(notes(spark, sf_dir)), store, vocabulary, now="2020-01-01T00:00:00+00:00")
    ingest_files(as_files(edited(spark, sf_dir)), store, vocabulary)
    form = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?\+00:00"
    return store.table("documents").select("path", "created_at", (F.col("updated_at") > F.col("created_at")).alias("updated"), F.col("updated_at").rlike(f"^{form}$").alias("dated"))


# the notes as a store has them: titles are file names, and every note is one chunk
_STORED = _RESOLVE.replace("lower(title)", "lower(regexp_extract(path, '([^/]*)\\.[^./]*$', 1))") + r""",
sd AS (SELECT left(sha256(path), 16) AS id, path, regexp_extract(path, '([^/]*)\.[^./]*$', 1) AS title, truth, sha256(truth) AS content_hash FROM notes),
st_tokens AS (SELECT id, list_filter(string_split_regex(strip_accents(lower(title || ' ' || truth)), '[^\p{L}\p{N}\p{Co}\p{M}]+'), lambda x: x <> '') AS terms FROM sd),
sl AS (SELECT id, len(terms) AS n FROM st_tokens),
ss AS (SELECT count(*) AS n_docs, avg(n) AS avgdl FROM sl),
sp AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM st_tokens) GROUP BY ALL),
sq AS (SELECT * FROM sp WHERE term IN ('lies', 'in', 'region', 'asia')),
si AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf
  FROM (SELECT term, count(*)::DOUBLE AS df FROM sq GROUP BY term), ss),
sb AS (SELECT sq.id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * sl.n / ss.avgdl))) AS score
  FROM sq JOIN si USING (term) JOIN sl ON sl.id = sq.id, ss GROUP BY sq.id),
slex AS (SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id)::INTEGER AS lexical_rank, score FROM sb QUALIFY lexical_rank <= 20),
sv AS (SELECT id, list_transform({VOCABULARY}, lambda v: len(list_filter(terms, lambda t: t = v))) AS vector
  FROM (SELECT id, list_filter(string_split_regex(strip_accents(lower(truth)), '[^\p{L}\p{N}\p{Co}\p{M}]+'), lambda x: x <> '') AS terms FROM sd)),
sk AS (SELECT id, row_number() OVER (ORDER BY round(list_distance(vector::DOUBLE[], {QUERY}::DOUBLE[]), 12), id)::INTEGER AS semantic_rank FROM sv QUALIFY semantic_rank <= 20),
sf AS (SELECT coalesce(slex.id, sk.id) AS id, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) AS s, lexical_rank, semantic_rank,
  CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 'fused' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS signal
  FROM slex FULL JOIN sk ON slex.id = sk.id ORDER BY s DESC, coalesce(slex.id, sk.id) LIMIT 10),
sw(id, depth) AS (SELECT id, 0 FROM sf UNION SELECT e.target_id, depth + 1 FROM sw JOIN edges e ON e.source_id = sw.id JOIN sd ON sd.id = e.target_id WHERE depth < 2),
sx AS (SELECT id, min(depth) AS depth FROM sw GROUP BY id HAVING min(depth) > 0 ORDER BY depth, id LIMIT 20),
result AS (
  SELECT id AS doc_id, 0 AS chunk_index, path, title, signal, round(s, 6) AS rrf_score, lexical_rank, semantic_rank, truth AS chunk_text, 0 AS expansion_depth FROM sf JOIN sd USING (id)
  UNION ALL SELECT id, 0, path, title, 'expanded', 0.0::DOUBLE, NULL, NULL, truth, depth::INTEGER FROM sx JOIN sd USING (id))
""".replace("{VOCABULARY}", str(list(VOCABULARY))).replace("{QUERY}", str([int(v in ("lies", "in", "region", "asia")) for v in VOCABULARY]))
_ENGINE = f"WITH RECURSIVE {_STORED} SELECT * FROM result"
_BLOCKS = """o AS (SELECT *, row_number() OVER (ORDER BY expansion_depth, rrf_score DESC, doc_id)::INTEGER AS position, replace(regexp_replace(chunk_text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS x FROM result),
blocks AS (SELECT position, '#' || position || '  signal=' || signal || '  rrf_score=' || printf('%.6f', rrf_score) || '  lex_rank=' || coalesce(lexical_rank::VARCHAR, '-') || '  sem_rank=' || coalesce(semantic_rank::VARCHAR, '-')
  || CASE WHEN expansion_depth > 0 THEN '  depth=' || expansion_depth ELSE '' END || chr(10) || '    path: ' || path || chr(10) || '    title: ' || title || chr(10) || '    chunk_index: ' || chunk_index
  || chr(10) || '    excerpt: ' || CASE WHEN length(x) > 280 THEN left(x, 277) || '...' ELSE x END AS block FROM o)"""
_NEAR = """near AS (SELECT path, position, '#' || position || '  -> ' || target_id || '  rel=' || coalesce(relationship_type, '(no relationship)') || chr(10) || '    target_path: ' || coalesce(target_path, '(dangling)') AS block
  FROM (SELECT s.path, e.*, t.path AS target_path, row_number() OVER (PARTITION BY s.path ORDER BY target_id, relationship_type NULLS FIRST) AS position
    FROM edges e JOIN sd s ON s.id = e.source_id LEFT JOIN sd t ON t.id = e.target_id))"""
_VECTOR = "array_to_string(vector, ',')"

QUERIES = {
    "bm25_topk": bm25_topk, "bm25_all": bm25_all, "bm25_stats": bm25_stats, "doc_lengths": doc_lengths, "term_df": term_df, "phrase_topk": phrase_topk,
    "knn_topk_chunks": knn_topk_chunks, "knn_cosine": knn_cosine, "knn_cells": knn_cells("l2"), "knn_cells_cosine": knn_cells("cosine"), "knn_best_per_doc": knn_best_per_doc,
    "rrf_fused": rrf_fused, "signal_attribution": signal_attribution,
    "doc_id_hash": doc_id_hash, "content_hash": content_hashes, "parse_documents": parse_documents, "page_split": page_split,
    "chunk_pack": chunk_pack, "embed_chunks": embed_chunks, "sanitize_query": sanitize_query, "excerpt": excerpts,
    "change_detect": change_detect, "upsert_merge": upsert_merge,
    "link_extract": link_extract, "resolve_links": resolve_links, "link_edges": link_edges, "neighbors_dangling": neighbors_dangling,
    "expand_depth1": expand_depth(1), "expand_depth2": expand_depth(2), "expand_depth3": expand_depth(3), "expand_topk": expand_topk,
    "resolve_function": resolve_function, "link_cases": link_cases,
    "engine_query": engine_query, "engine_neighbors": engine_neighbors, "stored_bm25": stored_bm25, "pruned_bm25": pruned_bm25, "stored_documents": stored_documents, "metadata_filter": metadata_filter, "stored_chunks": stored_chunks,
    "stored_upsert": stored_upsert, "late_targets": late_targets, "ingest_counts": ingest_counts, "tool_query": tool_query, "tool_neighbors": tool_neighbors,
    "rendered_results": rendered_results, "guards": guards, "errors": errors, "scan_files": scan_files, "command_line": command_line,
    "snapshot_query": snapshot_query, "streamed_notes": streamed_notes, "edge_changes": edge_changes, "corpus_totals": corpus_totals,
    "rendered_neighbors": rendered_neighbors, "tool_errors": tool_errors, "stored_dates": stored_dates,
}

# fixed values in the SQL, equal to those of the operators: what a link looks like, the operator characters and
# keywords of the query language, the rule and heading before a timeline, and the numbers of BM25 and RRF
SQL = {
    "bm25_topk": f"WITH {_LEX} SELECT doc_id, lexical_rank, round(score, 9) AS score FROM lex",
    "bm25_all": f"WITH {_BM25} SELECT doc_id, round(score, 9) AS score FROM b",
    "bm25_stats": f"WITH {_TOKENS} SELECT n_docs, round(avgdl, 9) AS avgdl FROM s",
    "doc_lengths": f"WITH {_TOKENS} SELECT doc_id, n::INTEGER AS n_tokens FROM l",
    "term_df": f"WITH {_TOKENS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "phrase_topk": f"""WITH {_TOKENS}, p AS (SELECT doc_id, len(list_filter(range(1, len(terms)), lambda i: terms[i] = 'of' AND terms[i + 1] = 'the')) AS tf FROM t),
h AS (SELECT * FROM p WHERE tf > 0), c AS (SELECT count(*)::DOUBLE AS df FROM h),
b AS (SELECT h.doc_id, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.n / avgdl)) AS score
  FROM h JOIN l ON l.doc_id = h.doc_id, c, s)
SELECT doc_id, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id)::INTEGER AS lexical_rank, round(score, 9) AS score FROM b QUALIFY lexical_rank <= 20""",
    "knn_topk_chunks": f"WITH {_KNN} SELECT doc_id, chunk_index, rank, round(distance, 9) AS distance FROM k",
    "knn_cosine": f"WITH {_KNN.replace('list_distance(', '1 - list_cosine_similarity(')} SELECT doc_id, chunk_index, rank, round(distance, 9) AS distance FROM k",
    "knn_cells": f"WITH {_KNN} SELECT doc_id, chunk_index, rank, round(distance, 9) AS distance FROM k",
    "knn_cells_cosine": f"WITH {_KNN.replace('list_distance(', '1 - list_cosine_similarity(')} SELECT doc_id, chunk_index, rank, round(distance, 9) AS distance FROM k",
    "knn_best_per_doc": f"WITH {_KNN} SELECT doc_id, arg_min(chunk_index, rank) AS chunk_index, min(rank) AS semantic_rank FROM k GROUP BY doc_id",
    "rrf_fused": f"{_FUSE} SELECT doc_id, chunk_index, round(rrf_score, 9) AS rrf_score, lexical_rank, semantic_rank, signal FROM f ORDER BY f.rrf_score DESC, doc_id LIMIT 30",
    "signal_attribution": f"{_FUSE} SELECT signal, count(*) AS n FROM f GROUP BY signal",
    "doc_id_hash": "SELECT page_id, left(sha256(url), 16) AS id FROM pages",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "parse_documents": """SELECT left(sha256(path), 16) AS id, path, 'Note ' || doc_id AS title, lang AS domain, sha256(body) AS content_hash, '- from ' || source AS timeline_text,
  '{"title": "Note ' || doc_id || '", "domain": "' || lang || '"}' AS metadata_json,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS truth, '' AS error
FROM (SELECT *, source || '/' || doc_id || '.md' AS path,
  '---' || chr(10) || 'title: Note ' || doc_id || chr(10) || 'domain: ' || lang || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Timeline' || chr(10) || chr(10) || '- from ' || source || chr(10) AS body
  FROM documents)""",
    "page_split": "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS truth, source AS timeline FROM documents",
    "chunk_pack": """WITH RECURSIVE c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM c),
f(conv_id, i, k, cur) AS (
  SELECT conv_id, 1, 0, ps[1] FROM p WHERE len(ps) > 0
  UNION ALL
  SELECT f.conv_id, i + 1, CASE WHEN length(cur) + 2 + length(ps[i + 1]) <= 1000 THEN k ELSE k + 1 END,
    CASE WHEN length(cur) + 2 + length(ps[i + 1]) <= 1000 THEN cur || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END
  FROM f JOIN p ON p.conv_id = f.conv_id WHERE i < len(ps))
SELECT conv_id AS doc_id, k::INTEGER AS chunk_index, arg_max(cur, i) AS text FROM f GROUP BY conv_id, k""",
    "engine_query": _ENGINE,
    "tool_query": _ENGINE,
    "engine_neighbors": f"""WITH RECURSIVE {_STORED} SELECT e.*, s.path AS source_path, t.path AS target_path FROM edges e JOIN sd s ON s.id = e.source_id LEFT JOIN sd t ON t.id = e.target_id
WHERE s.path = '{SOME_NOTE}'""",
    "tool_neighbors": f"""WITH RECURSIVE {_STORED} SELECT e.target_id, e.relationship_type, t.path AS target_path FROM edges e JOIN sd s ON s.id = e.source_id LEFT JOIN sd t ON t.id = e.target_id
WHERE s.path = '{SOME_NOTE}'""",
    "stored_bm25": f"WITH RECURSIVE {_STORED} SELECT id AS doc_id, lexical_rank, round(score, 9) AS score FROM slex",
    "pruned_bm25": f"WITH RECURSIVE {_STORED} SELECT id AS doc_id, lexical_rank, round(score, 9) AS score FROM slex",
    "stored_chunks": f"WITH RECURSIVE {_STORED} SELECT id AS doc_id, 0 AS chunk_index, truth AS text, {_VECTOR} AS vector FROM sd JOIN sv USING (id)",
    "stored_upsert": f"""WITH RECURSIVE {_STORED},
d AS (SELECT id, title, CASE WHEN path LIKE 'nation/%' THEN truth || ' Edited.' ELSE truth END AS text FROM sd),
t AS (SELECT id, list_filter(string_split_regex(strip_accents(lower(title || ' ' || text)), '[^\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{M}}]+'), lambda x: x <> '') AS terms FROM d)
SELECT d.id AS doc_id, sha256(text) AS content_hash, text, len(terms)::INTEGER AS n_tokens, len(list_distinct(terms))::BIGINT AS terms FROM d JOIN t USING (id)""",
    "late_targets": f"WITH RECURSIVE {_STORED} SELECT * FROM edges",
    "ingest_counts": f"""WITH {_NOTES}, n AS (SELECT count(*) AS n, count(*) FILTER (path LIKE 'nation/%') AS e FROM notes)
SELECT 0 AS run, n AS total, n AS ingested, 0::BIGINT AS skipped, 0::BIGINT AS failed FROM n UNION ALL SELECT 1, n, e, n - e, 0 FROM n UNION ALL SELECT 2, c, 0, 0, c FROM (SELECT count(*) AS c FROM region)""",
    "stored_documents": """SELECT left(sha256(path), 16) AS id, path, 'Note ' || doc_id AS title, lang AS domain, sha256(body) AS content_hash, '- from ' || source AS timeline_text,
  '{"title": "Note ' || doc_id || '", "domain": "' || lang || '"}' AS metadata_json
FROM (SELECT *, source || '/' || doc_id || '.md' AS path,
  '---' || chr(10) || 'title: Note ' || doc_id || chr(10) || 'domain: ' || lang || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Timeline' || chr(10) || chr(10) || '- from ' || source || chr(10) AS body
  FROM documents)""",
    "metadata_filter": """SELECT doc_id || '.md' AS path, n_chars::INTEGER AS chars, '2020-01-0' || (doc_id % 9 + 1) AS made, lang FROM documents
WHERE n_chars > 2000 AND doc_id % 9 + 1 >= 4 AND lang IN ('de', 'en')""",
    "rendered_results": f"WITH RECURSIVE {_STORED}, {_BLOCKS} SELECT position, block FROM blocks",
    "guards": f"""WITH RECURSIVE {_STORED.replace("depth < 2", "depth < 3").replace("ORDER BY depth, id LIMIT 20", "")}, c AS (SELECT (SELECT count(*) FROM sf) AS f, (SELECT count(*) FROM sx) AS x, (SELECT count(*) FROM sb) AS b, (SELECT count(*) FROM sd) AS d, (SELECT count(*) FROM edges WHERE source_id = 'none') AS u)
SELECT unnest(['operators only', 'blank', 'refused', 'lexical 0', 'semantic 0', 'final 0', 'depth 0', 'expanded 0', 'unknown id', 'lexical all', 'semantic all', 'depth 3']) AS asked, unnest([0, 0, 0, 0, 0, 0, f, f, u, b, d, f + x]) AS n FROM c""",
    "errors": f"""WITH {_NOTES}, n AS (SELECT count(*) AS n FROM notes)
SELECT unnest(['open', 'tools', 'unknown', 'depth', 'negative', 'strict', 'lost']) AS used, unnest(['StoreError', 'ToolStartError', 'QueryError', 'QueryError', 'QueryError', 'ParseError', 'QueryError']) AS error, unnest([n, n, n, n, n, n, 0]) AS documents FROM n""",
    "scan_files": f"WITH {_NOTES} SELECT path, sha256(truth) AS content_hash, left(sha256(path), 16) AS id FROM notes",
    "command_line": f"""WITH RECURSIVE {_STORED.replace("LIMIT 10", "LIMIT 3").replace("depth < 2", "depth < 1").replace("LIMIT 20),\nresult", "LIMIT 2),\nresult")}, {_BLOCKS}, {_NEAR}, n AS (SELECT count(*) AS n FROM sd)
SELECT 'early' AS command, 1 AS code, '' AS said UNION ALL SELECT 'init', 0, 'store ready at STORE' UNION ALL SELECT 'ingest', 0, 'total=' || n || ' ingested=' || n || ' skipped=0 failed=0' FROM n
UNION ALL SELECT 'again', 0, 'total=' || n || ' ingested=0 skipped=' || n || ' failed=0' FROM n UNION ALL SELECT 'hits', 0, string_agg(block, chr(10) ORDER BY position) FROM blocks
UNION ALL SELECT 'nothing', 0, '(no candidate found)' UNION ALL SELECT 'neighbors', 0, string_agg(block, chr(10) ORDER BY position) FROM near WHERE path = '{SOME_NOTE}'
UNION ALL SELECT 'unknown', 0, '(no outbound edges)' UNION ALL SELECT 'json', 0, '[]'""",
    "snapshot_query": _ENGINE,
    "streamed_notes": f"""WITH RECURSIVE {_STORED}
SELECT sd.id, path, CASE WHEN path LIKE 'nation/%' THEN sha256(truth || ' Edited.') ELSE content_hash END AS content_hash, target_id, relationship_type FROM sd LEFT JOIN edges ON source_id = sd.id""",
    "edge_changes": f"""WITH RECURSIVE {_STORED},
new AS (SELECT id, truth FROM sd WHERE path LIKE 'supplier/%' OR path = 'region/ASIA.md'),
-- links that dangled until the region came, by its path; nations and customers of other sources stay as they are
moved AS (SELECT DISTINCT source_id AS id FROM x WHERE target_path = 'region/ASIA.md' AND source_id NOT IN (SELECT id FROM new)),
fresh AS (SELECT id FROM new UNION ALL SELECT id FROM moved)
SELECT 'documents' AS written, count(*) AS n FROM new UNION ALL SELECT 'chunks', count(*) FROM new UNION ALL SELECT 'gone document', count(*) FROM new
UNION ALL SELECT 'gone resolution', count(*) FROM moved UNION ALL SELECT 'links', count(*) FROM x WHERE source_id IN (SELECT id FROM new)
UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id IN (SELECT id FROM fresh)
UNION ALL SELECT 'digests', count(DISTINCT source_id) FROM edges WHERE source_id IN (SELECT id FROM fresh)""",
    "corpus_totals": f"WITH RECURSIVE {_STORED} SELECT count(*) AS n_docs, round(avg(n + CASE WHEN path LIKE 'nation/%' THEN 2 ELSE 0 END), 9) AS avgdl FROM sl JOIN sd USING (id)",
    "rendered_neighbors": f"""WITH RECURSIVE {_STORED}, {_NEAR}, f AS (SELECT split_part(path, '/', 1) AS folder, min(path) AS path FROM sd GROUP BY 1)
SELECT folder, coalesce(string_agg(block, chr(10) ORDER BY position), '(no outbound edges)') AS said FROM f LEFT JOIN near USING (path) GROUP BY folder""",
    "tool_errors": f"""WITH RECURSIVE {_STORED}, a AS (SELECT id FROM sd WHERE path LIKE 'nation/%'), b AS (SELECT id FROM a UNION ALL SELECT reverse(id) FROM a)
SELECT b.id, sd.id IS NULL AS is_error, CASE WHEN sd.id IS NULL THEN 'unknown document ' || b.id ELSE (SELECT count(*) FROM edges WHERE source_id = b.id)::VARCHAR END AS said FROM b LEFT JOIN sd ON sd.id = b.id""",
    "stored_dates": f"WITH {_NOTES} SELECT path, '2020-01-01T00:00:00+00:00' AS created_at, path LIKE 'nation/%' AS updated, true AS dated FROM notes",
    "resolve_function": f"""WITH {_NOTES}, p AS (SELECT *, CASE WHEN label = upper(label) AND label <> lower(label) AND NOT starts_with(source_path, 'region/') THEN 'nation/' || label || '.md' END AS target_path FROM m)
SELECT source_path, n::INTEGER AS n, target_path, left(sha256(coalesce(target_path, CASE WHEN ends_with(label, '.md') THEN label ELSE label || '.md' END)), 16) AS target_id FROM p""",
    "link_cases": "WITH c AS (SELECT unnest(range({n})) AS k, unnest([{forms}]) AS form), d AS (SELECT k || r_name AS path, replace(form, '%', r_name) AS t FROM c, region), "
    "f AS (SELECT path, regexp_extract_all(t, '\\[\\[([^\\[\\]]+?)\\]\\](?:\\s*\\(([^)]+)\\))?', 1) AS labels, regexp_extract_all(t, '\\[\\[([^\\[\\]]+?)\\]\\](?:\\s*\\(([^)]+)\\))?', 2) AS rels FROM d), "
    "u AS (SELECT path, unnest(range(len(labels))) AS n, unnest(labels) AS label, unnest(rels) AS rel FROM f) "
    "SELECT path AS source_path, n::INTEGER AS n, label, CASE WHEN rel <> '' THEN trim(rel) END AS relationship_type FROM u".format(n=len(CASES), forms=", ".join("'" + c.replace("\n", "' || chr(10) || '") + "'" for c in CASES)),
    "sanitize_query": """SELECT page_id, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(url || ' AND NOT or_x', '["*():^\\-=\\[\\]{}<>~+|?,/;!@#$%&_]', ' ', 'g'), '\\b(?:AND|OR|NOT|NEAR)\\b', ' ', 'g'), '\\s+'), lambda x: x <> ''), ' OR ') AS match FROM pages""",
    "excerpt": "SELECT doc_id, CASE WHEN length(e) > 280 THEN left(e, 277) || '...' ELSE e END AS excerpt FROM (SELECT doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS e FROM documents)",
    "change_detect": """SELECT b.doc_id AS id, CASE WHEN lang = 'es' THEN 'new' WHEN lang = 'de' THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN lang = 'es' THEN '' ELSE 'at ' || source END AS created_at FROM documents b WHERE lang <> 'fr'""",
    "upsert_merge": "SELECT doc_id::VARCHAR AS id, sha256(CASE WHEN lang = 'de' THEN text || ' edited' ELSE text END) AS content_hash FROM documents",
    "link_extract": f"WITH {_NOTES} SELECT source_path, n::INTEGER AS n, label, relationship_type FROM m",
    "resolve_links": f"WITH {_RESOLVE} SELECT source_path, n::INTEGER AS n, target_path, target_id FROM x",
    "link_edges": f"WITH {_RESOLVE} SELECT * FROM edges",
    "neighbors_dangling": f"""WITH {_RESOLVE} SELECT e.*, s.path AS source_path, t.path AS target_path FROM edges e
LEFT JOIN notes s ON left(sha256(s.path), 16) = e.source_id LEFT JOIN notes t ON left(sha256(t.path), 16) = e.target_id""",
    **{f"expand_depth{k}": f"WITH RECURSIVE {_HOPS.replace('{depth}', str(k))} SELECT * FROM b" for k in (1, 2, 3)},
    "expand_topk": f"WITH RECURSIVE {_HOPS.replace('{depth}', '3')} SELECT * FROM b ORDER BY expansion_depth, doc_id LIMIT 50",
}
SQL["embed_chunks"] = f"""WITH c AS ({SQL["chunk_pack"]}),
t AS (SELECT doc_id, chunk_index, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}\\p{{Co}}\\p{{M}}]+'), lambda x: x <> '') AS terms FROM c)
SELECT doc_id, chunk_index, array_to_string(list_transform({list(VOCABULARY)}, lambda v: len(list_filter(terms, lambda x: x = v))), ',') AS vector FROM t"""
