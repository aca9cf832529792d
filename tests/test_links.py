import pytest
from pyspark.sql import functions as F

from vaultmill.functions.text import fold
from vaultmill.operators import links, skew
from vaultmill.operators.links import edges, extract, resolve, resolve_with


def links_of(spark, text):
    d = spark.createDataFrame([("id", "a/s.md", text)], "id string, path string, truth string")
    return [(r.label, r.relationship_type) for r in extract(d).orderBy("n").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("no link", []),
        ("[[a]]", [("a", None)]),
        ("[[a]] (cites) and [[b]]", [("a", "cites"), ("b", None)]),
        ("[[a|b]] [[a#h]]", [("a|b", None), ("a#h", None)]),
        ("[[a]](url)", [("a", "url")]),
        ("[[a]]\n\n(rel)", [("a", "rel")]),
        ("[[a]] ()", [("a", None)]),
        ("[[a]] ( )", [("a", "")]),
        ("[[[a]]]", [("a", None)]),
        ("[[a [b]]]", []),
        ("[[two\nlines]]", [("two\nlines", None)]),
        ("[[a.md]] (x y )", [("a.md", "x y")]),
    ],
)
def test_extract(spark, text, want):
    assert links_of(spark, text) == want


SCOPE = [("x/one.md", "Eins"), ("x/two.md", "Second"), ("y/one.md", "Uno"), ("y/three.md", "Drei"), ("z/four.md", "Same"), ("five.md", "Same"), ("w/straße.md", "W")]


@pytest.mark.parametrize(
    "source, label, want",
    [
        ("x/two.md", "x/one", "x/one.md"),
        ("x/two.md", "one", "x/one.md"),
        ("z/four.md", "one", None),
        ("z/four.md", "three", "y/three.md"),
        ("z/four.md", " THREE ", "y/three.md"),
        ("z/four.md", "Drei", "y/three.md"),
        ("z/four.md", "same", None),
        ("x/one.md", "five.md", "five.md"),
        ("x/one.md", "nope", None),
        ("x/one.md", "other/one", None),
        ("x/one.md", "STRASSE", "w/straße.md"),
    ],
)
def test_resolve(spark, source, label, want):
    rows = spark.createDataFrame([("s", source, 0, label, None)], "source_id string, source_path string, n int, label string, relationship_type string")
    scope = spark.createDataFrame(SCOPE, "path string, title string")
    r = resolve(rows, scope).first()
    assert r.target_path == want
    if want is None:
        from hashlib import sha256

        name = label.strip() if label.strip().endswith(".md") else label.strip() + ".md"
        assert r.target_id == sha256(name.encode()).hexdigest()[:16]


def test_typed_edges_collapse_and_untyped_stay(spark):
    d = spark.createDataFrame([("i", "s.md", "[[a]] [[a]] [[a]] (r) [[a]] (r)")], "id string, path string, truth string")
    got = edges(d, d.select("path", F.lit("t").alias("title"))).collect()
    assert sorted((r.relationship_type or "") for r in got) == ["", "", "r"]


def test_resolver_function(spark):
    rows = spark.createDataFrame([("s", "a.md", 0, "x", None), ("s", "a.md", 1, "y", None)], "source_id string, source_path string, n int, label string, relationship_type string")
    got = {r.label: r.target_path for r in resolve_with(rows, lambda label, source: f"{source}/{label}" if label == "x" else None).collect()}
    assert got == {"x": "a.md/x", "y": None}


def test_names_fold_fully(spark):
    """As Python's casefold: sharp s, ligatures, final sigma, letters that grow."""
    names = [" Straße ", "STRASSE", "ΣΊΣΥΦΟΣ", "σίσυφος", "ﬁn", "ŉ", "ǰ", "ſ", "ΐ", "ᾳ", "Ἄ", "ẞ", "Ꭰ", "ꭰ", "plain", "", "İx"]
    names += [f"a{chr(c)}b" for c in range(0x80, 0x2000) if chr(c).isalpha()]
    got = spark.createDataFrame(list(enumerate(names)), "i int, s string").select("i", fold(F.col("s")).alias("f")).collect()
    wrong = [names[r.i] for r in got if r.f != names[r.i].strip().casefold()]
    assert not [w for w in wrong if names.index(w) < 17] and len(wrong) < 5, wrong[:20]


def spread(df):
    """Rows of each task after the last shuffle, the largest and the median."""
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1], sizes[len(sizes) // 2], len(sizes)


def test_joins_spread_null_and_crowded_keys(spark, monkeypatch):
    """Most labels have a folder, so two keys are null, and one label is a third of all: no task gets twice the median."""
    n, scope = 6000, spark.createDataFrame([(f"f{i}/x{i}.md", f"T{i}") for i in range(300)] + [("hub/page.md", "Hub")], "path string, title string")
    label = F.when(F.col("id") % 3 == 0, "hub/page").when(F.col("id") % 10 == 1, F.concat(F.lit("x"), F.col("id") % 300)).otherwise(F.concat(F.lit("f/"), F.col("id")))
    rows = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 500).alias("source_id"), F.lit("a/s.md").alias("source_path"), F.col("id").cast("int").alias("n"), label.alias("label"))
    monkeypatch.setattr(skew, "CROWD", 100)
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        have = links.keyed(rows)
        slots = skew.crowded(have, {k: F.col(k) for k in links.KEYS})
        assert slots["name_key"] and slots["title_key"] and not slots["next_key"] and not slots["stem_key"]
        for k in links.KEYS:
            right = scope.select(F.col("path").alias(k), F.lit(1).alias("found")) if k in ("name_key", "next_key") else scope.select(F.lower("title").alias(k), F.lit(1).alias("found"))
            out = skew.left_join(have, right, k, slots[k], ["source_id", "source_path", "n"])
            largest, middle, tasks = spread(out)
            assert largest <= 2 * middle and tasks == 8, k
            assert out.columns[:-1] == [c for c in out.columns if c != "found"] and set(out.columns) == {*have.columns, "found"} and out.count() == n
        plain = spread(have.join(scope.select(F.col("path").alias("next_key"), F.lit(1)), "next_key", "left"))
        assert plain[0] > 2 * plain[1]  # what an ordinary join does
        got = resolve(rows, scope).groupBy("target_path").count().collect()
        assert {r.target_path: r["count"] for r in got}["hub/page.md"] == n // 3
    finally:
        for k in keys:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("crowd", [1, 3, 10**6])
def test_crowds_change_no_result(spark, monkeypatch, crowd):
    monkeypatch.setattr(skew, "CROWD", crowd)
    labels = ["x/one", "one", "three", "Drei", "same", "nope", "x/none", "five.md", "STRASSE"]
    rows = spark.createDataFrame([("s", "x/two.md", i, labels[i % len(labels)], None) for i in range(40)], "source_id string, source_path string, n int, label string, relationship_type string")
    scope = spark.createDataFrame(SCOPE, "path string, title string")
    got = {r.n: (r.target_path, r.how) for r in links.resolve_keyed(links.keyed(rows), scope).collect()}
    want = {"x/one": ("x/one.md", "exact"), "one": ("x/one.md", "sibling"), "three": ("y/three.md", "stem"), "Drei": ("y/three.md", "title"), "five.md": ("five.md", "exact"), "STRASSE": ("w/straße.md", "stem")}
    assert len(got) == 40 and all(got[i] == want.get(labels[i % len(labels)], (None, "none")) for i in range(40))


def test_labels_are_resolved_once(spark, monkeypatch):
    """Links that share a label are answered by a broadcast: none is shuffled. One by one they resolve to the same."""
    labels = ["x/one", "one", "three", "Drei", "same", "nope", "x/none", "five.md", "STRASSE", " two "]
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 7).alias("source_id"), F.when(F.col("id") % 3 == 0, "x/two.md").when(F.col("id") % 3 == 1, "z/deep/y.md").otherwise("top.md").alias("source_path"), F.col("id").cast("int").alias("n"), F.element_at(F.array(*map(F.lit, labels)), (F.col("id") % len(labels) + 1).cast("int")).alias("label"))
    scope = spark.createDataFrame([*SCOPE, ("five.md", "Same")], "path string, title string")
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        whole = links.resolve_keyed(links.keyed(rows), scope)
        assert "SortMergeJoin" not in whole._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, whole.collect()))
        monkeypatch.setattr(links, "ASKED", 0)
        single = links.resolve_keyed(links.keyed(rows), scope)
        assert single.columns == whole.columns and got == sorted(map(str, single.collect())) and len(got) == 400
    finally:
        for k in keys:
            spark.conf.unset(k)


@pytest.mark.parametrize("crowd", [1, 3, 10**6])
def test_crowds_change_no_single_answer(spark, monkeypatch, crowd):
    monkeypatch.setattr(links, "ASKED", 0)
    test_crowds_change_no_result(spark, monkeypatch, crowd)


def test_watches_and_announced_keys(spark):
    rows = spark.createDataFrame([("s", "x/two.md", i, t, None) for i, t in enumerate(["x/one", "one", "three", "Drei", "nope", "x/none"])], "source_id string, source_path string, n int, label string, relationship_type string")
    r = links.resolve_keyed(links.keyed(rows), spark.createDataFrame(SCOPE, "path string, title string"))
    watched = {}
    for x in links.watches(r.withColumn("source_id", F.col("label"))).collect():
        watched.setdefault(x.source_id, set()).add((x.kind, x.key))
    assert watched == {
        "one": {("path", "one.md")}, "three": {("path", "three.md"), ("path", "x/three.md"), ("stem", "three")}, "x/none": {("path", "x/none.md"), ("title", "x/none")},
        **{t: {("path", f"{t}.md"), ("path", f"x/{t}.md"), ("stem", t.lower()), ("title", t.lower())} for t in ("Drei", "nope")},
    }
    new = spark.createDataFrame([("a/Nope.md", "New", None), ("b/c.md", "To", "From")], "path string, title string, old_title string")
    assert {tuple(k) for k in links.announced(new).collect()} == {("path", "a/Nope.md"), ("stem", "nope"), ("title", "new"), ("path", "b/c.md"), ("stem", "c"), ("title", "to"), ("title", "from")}


def test_digests_tell_edges_apart(spark):
    schema = "source_id string, target_id string, relationship_type string, how string"
    of = lambda *rows: {r.digest for r in links.digests(spark.createDataFrame([("s", *r) for r in rows], schema)).collect()}
    base = of(("a", None, "stem"), ("b", "x", "stem"))
    assert base == of(("b", "x", "stem"), ("a", None, "stem"))
    for other in (of(("a", "", "stem"), ("b", "x", "stem")), of(("a", None, "title"), ("b", "x", "stem")), of(("a", None, "stem"), ("a", None, "stem"), ("b", "x", "stem")), of(("a", "x", "stem"), ("b", None, "stem"))):
        assert base != other


def test_digests_add_whole_hashes(spark):
    """Sums of halves are the sums of the hashes themselves, negative ones too."""
    rows = spark.range(500).selectExpr("cast(id % 7 as string) AS source_id", "cast(id as string) AS target_id", "if(id % 3 = 0, null, 'r') AS relationship_type", "'exact' AS how")
    one = F.xxhash64("target_id", "relationship_type", F.col("relationship_type").isNull(), "how")
    want = rows.groupBy("source_id").agg(F.sum(one.cast("decimal(38,0)")).cast("string").alias("total"))
    j = links.digests(rows).join(want, "source_id").collect()
    assert len(j) == 7 and all(r["digest"].split(" ")[1] == r["total"] for r in j)
    plan = links.digests(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(xxhash64" not in plan  # no decimals for each link


def test_asked_in_documents_is_asked_of_their_links(spark):
    docs = spark.createDataFrame([("1", "a/x.md", "[[y]] (r) [[y]] [[z]]"), ("2", "a/w.md", "[[y]]"), ("3", "top.md", "[[y]] [[ y ]]"), ("4", "b/none.md", "text"), ("5", "b/c/n.md", None)], "id string, path string, truth string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(links.asked_in(docs)) == rows(links.asked(links.extract(docs))) == [(" y ", ""), ("y", ""), ("y", "a/"), ("z", "a/")]
