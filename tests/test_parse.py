import hashlib

import pytest
from pyspark.sql import functions as F

from vaultmill.functions.text import doc_id, excerpt, query_tokens, sanitize, sanitized, stem, terms, terms_of
from vaultmill.operators.chunk import chunks
from vaultmill.operators.parse import LATE, fronted, parse, split_page, typed


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def parsed(spark, text, path="dir/note.md"):
    body = text.encode() if isinstance(text, str) else text
    return parse(spark.createDataFrame([(path, bytearray(body))], "path string, content binary")).first()


def test_ids(spark):
    path = "systems-archetypes.md"
    assert one(spark, doc_id(F.col("p")), p=path) == hashlib.sha256(path.encode()).hexdigest()[:16] == "c8a1be119b7ad0c3"


@pytest.mark.parametrize("path, want", [("a/b.c.md", "b.c"), ("x.md", "x"), (".md", ".md"), ("d/plain", "plain")])
def test_stem(spark, path, want):
    assert one(spark, stem(F.col("p")), p=path) == want


def test_front_matter(spark):
    r = parsed(spark, "---\ntitle: Hello\ndomain: x\nn: 3\n---\n\nBody\n")
    assert (r.title, r.domain, r.truth, r.error, r.metadata_json) == ("Hello", "x", "Body", None, '{"title": "Hello", "domain": "x", "n": 3}')


@pytest.mark.parametrize("text, truth", [("plain", "plain"), ("---\n---\nx", "---\n---\nx"), ("---\n\n---\nx\n", "x"), ("﻿---\na: 1\n---\nx", "﻿---\na: 1\n---\nx"), ("---\r\na: 1\r\n---\r\nx", "x")])
def test_front_matter_absent_or_empty(spark, text, truth):
    r = parsed(spark, text)
    assert r.truth == truth and r.title == "note" and r.error is None


@pytest.mark.parametrize("block", ["a: [", "- 1\n- 2", "created: 2026-01-01", "domain: [a, b]"])
def test_front_matter_refused(spark, block):
    assert parsed(spark, f"---\n{block}\n---\nx\n").error


def test_bytes_that_are_no_text(spark):
    assert parsed(spark, b"\xff\xfe").error == "not valid UTF-8"


@pytest.mark.parametrize(
    "body, truth, timeline",
    [
        ("a\n", "a", None),
        ("a\n---\n## Timeline\nb\n", "a", "b"),
        ("a\n\n---\n\n\n## TIMELINE\n\nb", "a", "b"),
        ("a\n---\nb\n---\n## Timeline\nc", "a\n---\nb", "c"),
        ("a\n---\nb", "a\n---\nb", None),
        ("a\n---\n### Timeline\nb", "a\n---\n### Timeline\nb", None),
        ("a\n---\n## Timeline of x\nb", "a\n---\n## Timeline of x\nb", None),
        ("a\r\n---\r\n## Timeline\r\nb", "a\r\n---\r\n## Timeline\r\nb", None),
        ("a\n---\n## Timeline", "a", None),
    ],
)
def test_page(spark, body, truth, timeline):
    t, l = split_page(F.col("b"))
    r = spark.createDataFrame([(body,)], "b string").select(t.alias("t"), l.alias("l")).first()
    assert (r.t, r.l) == (truth, timeline)


@pytest.mark.parametrize(
    "paragraphs, sizes",
    [(["  "], []), (["x"], [1]), (["a" * 600, "b" * 600], [600, 600]), (["a" * 400, "b" * 400, "c" * 400], [802, 400]), (["a" * 2000], [2000]), (["a" * 998, "b"], [998, 1]), (["a" * 997, "b"], [1000])],
)
def test_chunks(spark, paragraphs, sizes):
    assert [len(c) for c in one(spark, chunks(F.col("t")), t="\n \n".join(paragraphs))] == sizes


def test_terms(spark):
    text = "Ünïcode don't STOP_here ét naïve 3.14 日本 ẞ"
    assert one(spark, terms(F.col("t")), t=text) == terms_of(text)
    assert terms_of("Déjà-vu, 2nd") == ["deja", "vu", "2nd"]


@pytest.mark.parametrize("text, want", [("red fox", "red OR fox"), ("red AND fox NOT dog", "red OR fox OR dog"), ("and or not", "and OR or OR not"), ('"a*b" (c)', "a OR b OR c"), ("AND OR", ""), ("  ", ""), ("snake_case", "snake OR case"), ("don't", "don't")])
def test_sanitize(spark, text, want):
    assert sanitize(text) == want == one(spark, sanitized(F.col("t")), t=text)
    assert query_tokens(text) == [x for x in want.split(" OR ") if x]


def test_excerpt(spark):
    assert one(spark, excerpt(F.col("t")), t=" a\nb ") == "a b"
    assert one(spark, excerpt(F.col("t")), t="x" * 281) == "x" * 277 + "..."


def test_metadata_by_path_and_type(spark):
    notes = {"a": "n: 3\nd: 2020-01-05\nt: [x, 7]", "b": "n: three\nd: 2020-01-04T10:00:00\no:\n  k: true", "c": "", "d": "n: 4.5"}
    files = spark.createDataFrame([(f"{k}.md", bytearray(f"---\n{v}\n---\nbody\n".encode())) for k, v in notes.items()], "path string, content binary")
    kept, refused = parse(files, keep_dates=True), parse(files)
    assert {r.path for r in refused.where("error is not null").collect()} == {"a.md", "b.md"} and kept.where("error is not null").count() == 0
    get = lambda path, kind: {r.path[0]: r.v for r in kept.select("path", typed(kept, path, kind).alias("v")).collect()}
    assert get("$.n", "int") == {"a": 3, "b": None, "c": None, "d": 5} or get("$.n", "int") == {"a": 3, "b": None, "c": None, "d": 4}
    assert get("$.d", "string") == {"a": "2020-01-05", "b": "2020-01-04T10:00:00", "c": None, "d": None}
    assert get("$.t[1]", "int")["a"] == 7 and get("$.o.k", "boolean")["b"] is True and str(get("$.d", "date")["a"]) == "2020-01-05"


def test_plain_texts_take_the_short_way(spark):
    """ASCII is split by a plain class, ends without blanks are not searched, folders and stems need no search: same results."""
    from vaultmill.functions import text as functions

    texts = ["", " ", "Plain words, 2 of_them", "a\tb\n", "\u2003x\u2003", "x\x1c", "Gr\u00fc\u00dfe e\u0301t\u00e9", "\u212a mixed", "---", "a" * 50, "\x00b\x7fc", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.translate(F.lower("t"), functions._from, functions._to)
    long = F.filter(F.split(low, functions.NOT_TERM), lambda t: t != "")
    whole = F.regexp_replace("t", rf"\A{functions.BLANK}+|{functions.BLANK}+\z", "")
    for r in df.select("t", functions.terms(F.col("t")).alias("terms"), long.alias("long"), functions.strip(F.col("t")).alias("strip"), whole.alias("whole")).collect():
        assert r.terms == r.long and r.strip == r.whole
        assert r.t is None or functions.terms_of(r.t) == r.terms
    paths = ["a/b/c.x.md", "c.md", "a/.md", "/x", "a/", "", "n\nl/\u00e9.md", None]
    d = spark.createDataFrame([(p,) for p in paths], "p string")
    folder, name = F.regexp_extract("p", r"(?s)^(.*/)?[^/]*$", 1), F.regexp_replace(F.regexp_replace("p", r"(?s)^.*/", ""), r"(?s)^(.+)\.[^.]+$", "$1")
    for r in d.select("p", functions.parent(F.col("p")).alias("a"), folder.alias("b"), functions.stem(F.col("p")).alias("c"), name.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
    assert "NOT_PLAIN" in dir(functions) and functions.NOT_PLAIN in functions.terms(F.col("t"))._jc.toString()


def test_files_known_to_be_plain_run_no_python(spark):
    """Their rows keep the partitioning of the files; front matter that comes all the same is an error, not text."""
    rows = [("a.md", b"one\n\n---\n## Timeline\nthen"), ("b.md", b"--- no rule"), ("c.md", b"\xc3("), ("d/e.md", "é [[x]]".encode()), ("f.md", b"")]
    files = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    both = [sorted(map(tuple, parse(files, plain=plain).collect()), key=str) for plain in (True, False)]
    assert both[0] == both[1] and not fronted(files.where("path = 'a.md'")) and fronted(files)
    plan = parse(files.repartition(doc_id(F.col("path"))), plain=True).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("Exchange ") == 1
    late = spark.createDataFrame([("g.md", bytearray(b"---\ntitle: T\n---\ntext"))], "path string, content binary")
    assert parse(late, plain=True).first()["error"] == LATE and parse(late).first()["title"] == "T"


def test_equal_front_matter_and_none(spark):
    texts = ["---\ntitle: T\n---\na", "b", "---\ntitle: T\n---\nc", "---\n[1]\n---\nd", "e"]
    files = spark.createDataFrame([(f"{k}.md", bytearray(t.encode())) for k, t in enumerate(texts)], "path string, content binary").coalesce(1)
    got = [(r["title"], r["metadata_json"], (r["error"] or "")[:25]) for r in parse(files).orderBy("path").collect()]
    assert got == [("T", '{"title": "T"}', ""), ("1", "{}", ""), ("T", '{"title": "T"}', ""), ("3", "{}", "front matter must be a map"[:25]), ("4", "{}", "")]
