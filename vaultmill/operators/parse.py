"""Documents from bytes: encoding, front matter, stable body and timeline."""

from __future__ import annotations

import json
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.errors import ParseError
from vaultmill.functions.text import BLANK, content_hash, doc_id, stem, strip

# fixed values: what front matter and the start of a timeline look like
FRONT = rf"(?s)\A---{BLANK}*\n(.*?)\n---{BLANK}*\n(.*)\z"
TIMELINE = r"(?imd)^[ \t]*---[ \t]*\n(?:[ \t]*\n)*[ \t]*##[ \t]+Timeline[ \t]*$"
LATE = "front matter where none was expected"
META = T.StructType([T.StructField(c, T.StringType()) for c in ("error", "title", "domain", "json")])


def read_front_matter(raw: str | None, keep_dates: bool = False) -> tuple[str | None, str | None, str | None, str]:
    """(error, title, domain, metadata as JSON) of one YAML block. Dates are refused, or kept in ISO form."""
    import yaml

    if raw is None:
        return None, None, None, "{}"
    try:
        data = yaml.safe_load(raw) or {}
    except yaml.YAMLError as e:
        return f"malformed front matter: {e}", None, None, "{}"
    if not isinstance(data, dict):
        return f"front matter must be a mapping, not {type(data).__name__}", None, None, "{}"
    try:
        text = json.dumps(data, default=iso if keep_dates else None)
    except TypeError as e:
        return f"front matter cannot be stored: {e}", None, None, "{}"
    domain = data.get("domain")
    if isinstance(domain, list | dict):
        return f"domain must be a single value, not {type(domain).__name__}", None, None, "{}"
    domain = int(domain) if isinstance(domain, bool) else domain
    title = data.get("title")
    return None, str(title) if title else None, None if domain is None else str(domain), text


def iso(value: object) -> str:
    if isinstance(value, date):  # a time of day included
        return value.isoformat()
    raise TypeError(f"no form for {type(value).__name__}")


def front_matter(block: Column, keep_dates: bool = False) -> Column:
    @F.arrow_udf(META)
    def run(blocks: pa.Array) -> pa.Array:
        blocks = pc.dictionary_encode(blocks)  # notes without front matter, and those with the same, are read once
        rows = [read_front_matter(None), *(read_front_matter(b, keep_dates) for b in blocks.dictionary.to_pylist())]
        at = pc.fill_null(pc.add(pc.cast(blocks.indices, pa.int32()), 1), 0)
        return pa.StructArray.from_arrays([pa.array(c, pa.string()).take(at) for c in zip(*rows)], META.names)

    return run(block)


def typed(documents: DataFrame, path: str, kind: str) -> Column:
    """A value of the front matter by its path ($.key, $.key[0]) and type; null where it is missing or of another kind.

    The metadata is read as a variant, so a filter on it needs no schema of the keys that documents have."""
    return F.try_variant_get(F.try_parse_json(documents["metadata_json"]), path, kind)


def split_page(body: Column) -> tuple[Column, Column]:
    """(stable body, timeline or null): split at a rule that a Timeline heading follows."""
    parts = F.when(F.contains(body, F.lit("---")), F.split(body, TIMELINE, 2)).otherwise(F.array(body))  # texts without a rule are not searched
    timeline = strip(F.get(parts, F.lit(1)))
    return strip(F.get(parts, F.lit(0))), F.when(timeline != "", timeline)


def refuse_bad(parsed: DataFrame, shown: int = 20) -> None:
    """Raises a ParseError if documents could not be parsed, naming the first few."""
    bad = parsed.where("error is not null").select("path", "error")
    first = {r["path"]: r["error"] for r in bad.orderBy("path").limit(shown).collect()}
    if first:
        raise ParseError(first, bad.count())


def fronted(files: DataFrame) -> bool:
    """Whether a file may have front matter. Each task stops at the first one that may."""
    return files.where(F.startswith(F.col("content").cast("string"), F.lit("---"))).limit(1).count() > 0


def parse(files: DataFrame, keep_dates: bool = False, plain: bool = False) -> DataFrame:
    """files(path, content) -> id, path, title, domain, content_hash, metadata_json, truth, timeline_text, error.

    A document that cannot be parsed has an error and null fields; it never fails the batch. With plain, where no file is
    expected to have front matter, no Python runs and the rows keep the partitioning of the files; one that has it
    all the same gets the error LATE.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "utf-8"))
    d = files.select("path", doc_id(F.col("path")).alias("id"), content_hash(F.col("content")).alias("content_hash"), text.alias("text"))
    has = F.startswith("text", F.lit("---")) & F.col("text").rlike(FRONT)
    d = d.withColumn("front", F.when(has, F.regexp_extract("text", FRONT, 1))).withColumn("body", F.when(has, F.regexp_extract("text", FRONT, 2)).otherwise(F.col("text")))
    none = [F.when(F.col("front").isNotNull(), F.lit(LATE)), *[F.lit(None).cast("string")] * 2, F.lit("{}")]
    d = d.withColumn("meta", F.struct(*[c.alias(n) for c, n in zip(none, META.names)]) if plain else front_matter(F.col("front"), keep_dates))
    error = F.when(F.col("text").isNull(), "not valid UTF-8").otherwise(F.col("meta.error"))
    truth, timeline = split_page(F.col("body"))
    return d.select(
        "id", "path", F.coalesce("meta.title", stem(F.col("path"))).alias("title"), F.col("meta.domain").alias("domain"), "content_hash",
        F.col("meta.json").alias("metadata_json"), truth.alias("truth"), timeline.alias("timeline_text"), error.alias("error"),
    )
