"""Schemas of the stored tables and of results."""

from pyspark.sql import types as T

_s, _i = T.StringType(), T.IntegerType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3) for f in fields])


DOCUMENTS = _struct(("id", _s, "key"), ("title", _s), ("path", _s), ("domain", _s), ("content_hash", _s, "key"), ("timeline_text", _s), ("metadata_json", _s), ("created_at", _s), ("updated_at", _s))
TRUTHS = _struct(("id", _s), ("title", _s), ("content", _s))
CHUNKS = _struct(("doc_id", _s), ("chunk_index", _i), ("text", _s), ("embedding", T.ArrayType(T.FloatType())))
POSTINGS = _struct(("doc_id", _s), ("term", _s), ("tf", _i), ("positions", T.ArrayType(_i)), ("n_tokens", _i), ("block", _s))
BLOCKS = _struct(("block", _s), ("term", _s), ("n", T.LongType()), ("most_tf", _i), ("least_tokens", _i))
LENGTHS = _struct(("doc_id", _s), ("n_tokens", _i))
EDGES = _struct(("source_id", _s), ("target_id", _s), ("relationship_type", _s))
LINKS = _struct(("source_id", _s), ("source_path", _s), ("n", _i), ("label", _s), ("relationship_type", _s))
WATCHES = _struct(("source_id", _s), ("kind", _s), ("key", _s))
DIGESTS = _struct(("source_id", _s), ("digest", _s))
VERSIONS = _struct(("id", _s), ("path", _s), ("modified", T.LongType()), ("size", T.LongType()))
TABLES = {
    "documents": DOCUMENTS, "truths": TRUTHS, "chunks": CHUNKS, "postings": POSTINGS, "blocks": BLOCKS, "lengths": LENGTHS,
    "links": LINKS, "edges": EDGES, "watches": WATCHES, "digests": DIGESTS, "versions": VERSIONS,
}
OWNER = {"documents": "id", "truths": "id", "versions": "id"} | dict.fromkeys(("chunks", "postings", "lengths"), "doc_id") | dict.fromkeys(("links", "edges", "watches", "digests"), "source_id")

# what of a document a write replaces: all that its text gives, how its links resolve, or the version of its file
DOCUMENT, RESOLUTION, VERSION = "document", "resolution", "version"
# (the bounds of a block of postings still hold when some of its documents are replaced, so nothing replaces them)
REPLACED_BY = dict.fromkeys(TABLES, (DOCUMENT,)) | {"blocks": ()} | dict.fromkeys(("edges", "watches", "digests"), (DOCUMENT, RESOLUTION)) | {"versions": (VERSION,)}
GONE = _struct(("id", _s), ("what", _s))

RESULT = _struct(
    ("doc_id", _s), ("chunk_index", _i), ("path", _s), ("title", _s), ("signal", _s), ("rrf_score", T.DoubleType()),
    ("lexical_rank", _i), ("semantic_rank", _i), ("chunk_text", _s), ("expansion_depth", _i),
)
NEIGHBOR = _struct(("source_id", _s), ("target_id", _s), ("relationship_type", _s), ("source_path", _s), ("target_path", _s))
