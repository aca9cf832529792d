import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from tests import vaults
from vaultmill import cli
from vaultmill.errors import IngestError, ParseError, QueryError, StoreError, ToolStartError
from vaultmill.operators import graph
from vaultmill.operators.embed import HashingEmbedder, VocabularyEmbedder, encoder, named
from vaultmill.plans import render
from vaultmill.plans import store as store_module
from vaultmill.plans.ingest import Stats, ingest, ingest_files
from vaultmill.plans.query import Engine
from vaultmill.plans.store import Store
from vaultmill.plans.tools import Tools
from vaultmill.schema import TABLES
from vaultmill.streaming.ingest import watch


def build(spark, tmp_path_factory, files, concepts=()):
    base = tmp_path_factory.mktemp("vault")
    folder = vaults.write(base / "notes", files)
    store = Store.create(spark, str(base / "store"))
    make = partial(vaults.Concepts, *concepts)
    stats = ingest(spark, folder, store, make)
    return folder, store, make, stats


def ids(store):
    return {r.path: r.id for r in store.table("documents").select("path", "id").collect()}


@pytest.fixture(scope="module")
def query_engine(spark, tmp_path_factory):
    _, store, make, _ = build(spark, tmp_path_factory, vaults.QUERY, vaults.QUERY_CONCEPTS)
    return Engine(spark, store, make())


@pytest.fixture(scope="module")
def expand_engine(spark, tmp_path_factory):
    _, store, make, _ = build(spark, tmp_path_factory, vaults.EXPAND, vaults.EXPAND_CONCEPTS)
    return Engine(spark, store, make())


def test_signals(query_engine):
    rows = {r.path: r for r in query_engine.query("zebra").collect()}
    assert rows["by_sense.md"].signal == "semantic" and rows["by_sense.md"].lexical_rank is None
    assert rows["by_both.md"].signal == rows["by_word.md"].signal == "fused"
    scores = [r.rrf_score for r in query_engine.query("zebra").collect()]
    assert scores == sorted(scores, reverse=True)
    assert all(r.chunk_text and r.expansion_depth == 0 for r in rows.values())


def test_operators_only_is_semantic(query_engine):
    assert {r.signal for r in query_engine.query("AND OR NOT").collect()} == {"semantic"}


def test_lexical_only(query_engine):
    rows = query_engine.query("zebra", semantic_top_k=0).collect()
    assert {r.path for r in rows} == {"by_word.md", "by_both.md"} and {r.signal for r in rows} == {"lexical"}
    assert query_engine.query("zebra", final_top_k=0).count() == 0


def depths(engine, text="alpha", top=1, **options):
    rows = engine.query(text, lexical_top_k=top, semantic_top_k=top, final_top_k=top, expand=True, **options).collect()
    return [(r.path, r.expansion_depth) for r in rows if r.signal == "expanded"], rows


def test_expansion(expand_engine):
    got, rows = depths(expand_engine)
    assert rows[0].path == "A.md" and sorted(got) == [("B.md", 1), ("E.md", 1)]
    got, rows = depths(expand_engine, expand_depth=2)
    assert sorted(got) == [("B.md", 1), ("C.md", 2), ("E.md", 1)]
    expanded = [r for r in rows if r.signal == "expanded"]
    assert [(r.expansion_depth, r.doc_id) for r in expanded] == sorted((r.expansion_depth, r.doc_id) for r in expanded)
    assert all(r.rrf_score == 0.0 and r.lexical_rank is None and r.semantic_rank is None and r.chunk_text for r in expanded)


def test_expansion_limits(expand_engine):
    assert depths(expand_engine, expand_depth=0)[0] == []
    assert len(depths(expand_engine, expand_top_k=1)[0]) == 1
    assert depths(expand_engine, expand_top_k=0)[0] == []
    got, rows = depths(expand_engine, "beta", 2, expand_depth=1)
    assert [r.path for r in rows].count("B.md") == 1
    with pytest.raises(QueryError):
        depths(expand_engine, expand_depth=4)
    with pytest.raises(QueryError):
        depths(expand_engine, expand_top_k=-1)


def test_neighbors(spark, tmp_path_factory):
    _, store, make, _ = build(spark, tmp_path_factory, vaults.NEIGHBORS)
    engine, by = Engine(spark, store, make()), ids(store)
    rows = engine.neighbors(by["here.md"]).collect()
    assert [r.target_id for r in rows] == sorted(r.target_id for r in rows)
    assert {(r.target_path, r.relationship_type) for r in rows} == {("there.md", "cites"), ("yonder.md", None), (None, "refers")}
    assert engine.neighbors(by["alone.md"]).count() == engine.neighbors("unknown").count() == 0
    assert [r.source_path for r in engine.backlinks(by["there.md"]).collect()] == ["here.md"]
    text = render.neighbors_text(engine.neighbors(by["here.md"]))
    assert "#1  -> " in text and "(no relationship)" in text and "(dangling)" in text
    assert render.neighbors_text(engine.neighbors("unknown")) == "(no outbound edges)"


def test_ingest_and_reingest(spark, tmp_path_factory):
    folder, store, make, stats = build(spark, tmp_path_factory, vaults.INGEST)
    assert stats == Stats(3, 3, 0, 0)
    docs = {r.path: r for r in store.table("documents").collect()}
    assert docs["dated.md"].timeline_text == "- first entry" and docs["dated.md"].title == "Long Note" and docs["dated.md"].domain == "work"
    assert docs["plain.md"].timeline_text is None and docs["plain.md"].title == "plain"
    edges = store.table("edges").collect()
    assert len(edges) == 2 and sum(e.target_id in {d.id for d in docs.values()} for e in edges) == 1
    assert ingest(spark, folder, store, make) == Stats(3, 0, 3, 0)
    (__import__("pathlib").Path(folder) / "plain.md").write_text("Another line.\n")
    assert ingest(spark, folder, store, make) == Stats(3, 1, 2, 0)
    again = {r.path: r for r in store.table("documents").collect()}
    assert again["plain.md"].created_at == docs["plain.md"].created_at and again["plain.md"].updated_at > docs["plain.md"].updated_at
    assert again["dated.md"].updated_at == docs["dated.md"].updated_at
    assert {t: store.table(t).count() for t in ("documents", "chunks", "edges", "truths", "lengths")} == {"documents": 3, "chunks": 3, "edges": 2, "truths": 3, "lengths": 3}
    postings = lambda: sorted(map(str, store.table("postings").drop("block").collect()))
    before = postings()
    store.compact()
    assert len(store.segments()) == 1 and postings() == before


def test_late_target_refreshes_edges(spark, tmp_path_factory):
    folder, store, make, _ = build(spark, tmp_path_factory, {"s/source.md": "See [[t/target]] (relates) and [[Late Title]].\n"})
    engine = Engine(spark, store, make())
    sid = ids(store)["s/source.md"]
    assert {r.target_path for r in engine.neighbors(sid).collect()} == {None}
    vaults.write(__import__("pathlib").Path(folder), {"t/target.md": "---\ntitle: Late Title\n---\nhere\n"})
    assert ingest(spark, folder, store, make) == Stats(2, 1, 1, 0)
    assert {r.target_path for r in engine.neighbors(sid).collect()} == {"t/target.md"}


def test_bad_files_keep_what_is_stored(spark, tmp_path_factory):
    folder, store, make, _ = build(spark, tmp_path_factory, {"a.md": "good\n", "b.md": b"\xff", ".hidden/c.md": "seen\n"})
    assert sorted(ids(store)) == [".hidden/c.md", "a.md"]
    vaults.write(__import__("pathlib").Path(folder), {"a.md": "---\nx: [\n---\nbad\n"})
    stats = ingest(spark, folder, store, make)
    assert (stats.failed, stats.skipped) == (2, 1) and store.table("truths").where("title = 'a'").first().content == "good"


def test_empty_folder(spark, tmp_path_factory):
    assert build(spark, tmp_path_factory, {})[3] == Stats()


def test_store_errors(spark, tmp_path):
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "none"))
    with pytest.raises(ToolStartError):
        Tools(spark, str(tmp_path / "none"), vaults.Concepts())
    assert not (tmp_path / "none").exists()
    Store.create(spark, str(tmp_path / "s"))
    assert Store.create(spark, str(tmp_path / "s")).table("documents").count() == 0


def test_example_and_tools(spark, tmp_path_factory):
    _, store, make, _ = build(spark, tmp_path_factory, vaults.SHORE, vaults.SHORE_CONCEPTS)
    engine, tools = Engine(spark, store, make()), Tools(spark, store.root, make())
    assert engine.query("anemone").first().path == "walks.md"
    row = {r.path: r for r in engine.query("estuary").collect()}["marsh.md"]
    assert row.signal == "semantic" and row.semantic_rank == 1
    assert {r.path: r.signal for r in engine.query("urchin").collect()}["grazers.md"] == "fused"
    options = {"lexical_top_k": 1, "semantic_top_k": 1, "final_top_k": 1, "expand": True, "expand_depth": 2}
    rows = engine.query("intertidal", **options).collect()
    assert [(r.path, r.expansion_depth) for r in rows][0] == ("pools.md", 0)
    assert sorted((r.path, r.expansion_depth) for r in rows[1:]) == [("grazers.md", 1), ("kelp.md", 1), ("otters.md", 2)]
    assert tools.query("intertidal", **options).rows == [r.asDict() for r in rows]
    by = ids(store)
    assert len(tools.graph_neighbors(by["pools.md"]).rows) == 2
    assert tools.graph_neighbors("unknown").is_error
    assert tools.query("intertidal", expand=True, expand_depth=9).is_error
    text = render.results_text(engine.query("intertidal", **options))
    assert text.startswith("#1  signal=fused  rrf_score=0.032787  lex_rank=1  sem_rank=1\n    path: pools.md") and "depth=2" in text
    assert render.results_text(engine.query("intertidal", final_top_k=0)) == "(no candidate found)"
    assert json.loads(render.as_json(engine.query("intertidal", **options))) == [r.asDict() for r in rows]


def test_command_line(spark, tmp_path, capsys):
    folder, root = vaults.write(tmp_path / "n", vaults.EXPAND), str(tmp_path / "s")
    make = partial(vaults.Concepts, *vaults.EXPAND_CONCEPTS)
    run = lambda *a: cli.main([*a, "--store", root], spark, make)
    assert run("query", "alpha") == 1
    assert run("init") == 0 and run("ingest", folder) == 0
    assert "ingested=5" in capsys.readouterr().out
    assert run("query", "alpha", "--expand", "--depth", "2", "--json", "--top-k", "1", "--lexical-top-k", "1", "--semantic-top-k", "1") == 0
    assert any(r["expansion_depth"] == 2 for r in json.loads(capsys.readouterr().out))
    with pytest.raises(SystemExit):
        run("query", "alpha", "--depth", "4")
    assert run("neighbors", "unknown") == 0 and "(no outbound edges)" in capsys.readouterr().out


def test_ingest_of_a_folder_lists_nothing_on_the_driver(spark, tmp_path, monkeypatch, capsys):
    from vaultmill.sources import vault

    for name in ("binary", "hidden_files"):
        monkeypatch.setattr(vault, name, lambda *_, **__: pytest.fail("listed on the driver"))
    folder, root = vaults.write(tmp_path / "n", {"a.md": "one [[b]]\n", ".h/b.md": "two\n"}), str(tmp_path / "s")
    assert [cli.main([*a, "--store", root], spark, vaults.Concepts) for a in (["init"], ["ingest", folder])] == [0, 0]
    assert "total=2 ingested=2" in capsys.readouterr().out


@pytest.fixture
def stream(spark, tmp_path):
    """(folder, store, go): go writes files, lets a streaming query catch up, and returns the store's paths."""
    folder, store = tmp_path / "n", Store.create(spark, str(tmp_path / "s"))
    folder.mkdir()

    def go(files, most=1000):
        vaults.write(folder, files)
        watch(spark, str(folder), store, vaults.Concepts, str(tmp_path / "c"), once=True, most=most).awaitTermination()
        return sorted(ids(store))

    return folder, store, go


def targets(spark, store):
    """{(source path, target path or None, relationship)} of all edges."""
    return sorted((r.source_path, r.target_path or "", r.relationship_type or "") for r in graph.neighbors(store.table("edges"), store.table("documents")).collect())


def test_stream_takes_in_new_edited_and_hidden_files(spark, stream):
    folder, store, go = stream
    assert go({"a.md": "first [[b]] (x)\n", "bad.md": b"\xff"}) == ["a.md"]
    segments = store.segments()
    assert go({}) == ["a.md"] and store.segments() == segments  # nothing new, nothing written; the bad file is not read again
    assert go({"b.md": "second [[a]]\n", ".h/c.md": "hidden\n", "_d.md": "also\n", "odd [1], {x}*.md": "odd\n"}) == [".h/c.md", "_d.md", "a.md", "b.md", "odd [1], {x}*.md"]
    assert targets(spark, store) == [("a.md", "b.md", "x"), ("b.md", "a.md", "")]
    assert go({"a.md": "first, edited [[_d]] (y)\n", "bad.md": "now good, and longer\n", "_d.md": "also edited\n"})[-2:] == ["bad.md", "odd [1], {x}*.md"]
    assert {r.title: r.content for r in store.table("truths").collect()} == {"a": "first, edited [[_d]] (y)", "b": "second [[a]]", "c": "hidden", "_d": "also edited", "odd [1], {x}*": "odd", "bad": "now good, and longer"}
    assert targets(spark, store) == [("a.md", "_d.md", "y"), ("b.md", "a.md", "")]
    segments = store.segments()
    assert go({}) and store.segments() == segments


def test_listing_of_hidden_files_asks_little_of_the_driver(spark, tmp_path, monkeypatch):
    """Plain notes are passed over by the file system: calls to the JVM do not grow with them."""
    from vaultmill.sources.vault import hidden_files

    hidden = [".a.md", "_b.md", "s/.c.md", ".h/d.md", ".h/deep/e.md", "x.md/_f.md", "x.md/_g/h.md", "md/_i.md", "o [1], {x}/.j.md", "k/.l.md/m.md"]
    folder, client = vaults.write(tmp_path / "n", dict.fromkeys([*hidden, "x.md/y.md", ".h/no.txt", "s/no.txt"], "x")), spark.sparkContext._gateway._gateway_client
    calls, real = [0], client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: (calls.__setitem__(0, calls[0] + 1), real(*a, **k))[1])

    def look():
        calls[0] = 0
        assert sorted(p for _, p, *_ in hidden_files(spark, folder)) == sorted(hidden)
        return calls[0]

    few = look()
    vaults.write(tmp_path / "n", {f"s/{k}.md": "x" for k in range(500)})
    assert look() < few + 500


ODD = ["a.md", ".h/b.md", "_c.md", "s/.d.md", "x.md/e.md", "x.md/_g/f.md", "deep/er/and/deeper/g.md", "odd [1], {x}*.md", "Customer#1.md", "é.md", "50%.md"]


def test_scan_keeps_no_file_on_the_driver(spark, tmp_path):
    """Neither the plan nor the driver has a name of a file; hidden and odd names, links, and folders whose name is a pattern are read."""
    from vaultmill.sources.vault import listing, scan

    top = tmp_path / "o [1] {x}"
    folder = vaults.write(top, dict.fromkeys([*ODD, "no.txt", "x.md/no.MD"], "x") | {"empty.md": ""})
    (top / "self.md").symlink_to("self.md")
    (top / "none.md").symlink_to("nowhere")
    (top / "link.md").symlink_to("a.md")
    (tmp_path / "apart").mkdir()
    (tmp_path / "apart" / "far.md").write_text("far")
    (top / "linked").symlink_to(tmp_path / "apart")
    with open(bytes(top) + b"/\xff.md", "wb") as f:
        f.write(b"no name")
    want = dict.fromkeys(ODD, b"x") | {"empty.md": b"", "link.md": b"x", "linked/far.md": b"far", "\ufffd.md": b"no name"}
    for at in (folder, f"{folder}/", f"file:{folder}"):
        found = scan(spark, at)
        assert found.inputFiles() == []
        assert {r.path: bytes(r.content) for r in found.collect()} == want and found.count() == len(want)
    listed = listing(spark, folder)
    assert listed.inputFiles() == []
    there = top / "a.md"
    assert {r.path: r.size for r in listed.collect()} == {p: len(c) for p, c in want.items()}
    assert listed.where("path = 'a.md'").first()["modified"] == there.stat().st_mtime_ns // 1_000_000
    assert scan(spark, f"{folder}/none").count() == 0 and scan(spark, f"{folder}/deep").first()["path"] == "er/and/deeper/g.md"


def test_scan_files_has_no_file_in_its_plan(spark):
    from vaultmill import catalog

    found = catalog.scan_files(spark, "/root/testdata/sf0.001")
    assert found.inputFiles() == [] and found.count() == catalog.notes(spark, "/root/testdata/sf0.001").count()


def test_tasks_hold_files_of_a_bounded_size(monkeypatch):
    import pyarrow as pa

    from vaultmill.sources import vault

    monkeypatch.setattr(vault, "PAGE", 3)
    monkeypatch.setattr(vault, "BYTES", 10)
    sizes = [4, 4, 4, 11, 0, 0, 0, 0, 2]
    out = list(vault.paged(((b"x" * n,) for n in sizes), ["content"], [pa.binary()]))
    assert [[len(c) for c in b.column(0).to_pylist()] for b in out] == [[4, 4], [4], [11], [0, 0, 0], [0, 2]]


@pytest.mark.parametrize("by_tasks", [True, False])
def test_files_by_tasks_are_those_of_the_reader(spark, stream, monkeypatch, by_tasks):
    """Where tasks cannot open files themselves, Spark's reader finds the same ones."""
    from vaultmill.sources import vault
    from vaultmill.streaming import ingest as module

    folder, store, go = stream
    for m in (vault, module) if not by_tasks else ():
        monkeypatch.setattr(m, "on_disk", lambda *_: None)
    if by_tasks:
        for name in ("binary", "hidden_files"):
            monkeypatch.setattr(vault, name, lambda *_, **__: pytest.fail("listed on the driver"))
    assert go(dict.fromkeys(ODD, "x\n")) == sorted(ODD)
    segments = store.segments()
    assert go({}) == sorted(ODD) and store.segments() == segments
    assert go({"a.md": "edited\n"}) == sorted(ODD) and len(store.segments()) == len(segments) + 1
    assert {r.path: bytes(r.content) for r in vault.scan(spark, str(folder)).collect()} == dict.fromkeys(ODD, b"x\n") | {"a.md": b"edited\n"}


def test_stream_reads_many_files_with_the_folder(spark, stream, monkeypatch):
    """Batches too large to be named on the driver: no name of theirs comes there, and what was seen before is not read."""
    from vaultmill.streaming import ingest as module

    folder, store, go = stream
    monkeypatch.setattr(module, "NAMED", 2)
    monkeypatch.setattr(module, "read_listed", lambda *_: pytest.fail("named on the driver"))
    first = {"a.md": "one [[b]]\n", "b.md": "two\n", ".h/c.md": "hidden\n", "_d.md": "also\n", "odd [1], {x}*.md": "odd\n"}
    assert go(first) == sorted(first)
    segments = store.segments()
    assert go({}) == sorted(first) and store.segments() == segments
    assert go({"a.md": "one, edited [[e]]\n", "e.md": "three\n", "_d.md": "edited\n"}) == sorted([*first, "e.md"])
    assert {r.title: r.content for r in store.table("truths").collect()} == {"a": "one, edited [[e]]", "b": "two", "c": "hidden", "_d": "edited", "odd [1], {x}*": "odd", "e": "three"}
    assert targets(spark, store) == [("a.md", "e.md", "")]


def test_repeated_batch_changes_nothing(spark, stream, monkeypatch):
    """The stream fails after its commit; the batch that is repeated finds nothing to do."""
    from vaultmill.streaming import ingest as module

    folder, store, go = stream
    real = module.ingest_files

    def fails(*a, **k):
        real(*a, **k)
        raise RuntimeError("lost")

    monkeypatch.setattr(module, "ingest_files", fails)
    with pytest.raises(Exception, match="lost"):
        go({"a.md": "one [[b]]\n", "b.md": "two\n"})
    monkeypatch.setattr(module, "ingest_files", real)
    segments, rows = store.segments(), sorted(map(str, store.table("chunks").collect()))
    assert len(segments) == 1 and go({}) == ["a.md", "b.md"]
    assert store.segments() == segments and sorted(map(str, store.table("chunks").collect())) == rows


def test_late_targets_in_a_stream(spark, stream):
    """Stored links follow what arrives later: dangling ones, better matches, names that become ambiguous, new titles."""
    folder, store, go = stream
    go({"x/a.md": "[[b]] (1) [[deep/c]] (2) [[The Title]] (3)\n", "y/b.md": "only b\n"})
    assert targets(spark, store) == [("x/a.md", "", "2"), ("x/a.md", "", "3"), ("x/a.md", "y/b.md", "1")]
    go({"deep/c.md": "---\ntitle: The Title\n---\nc\n"})
    assert targets(spark, store) == [("x/a.md", "deep/c.md", "2"), ("x/a.md", "deep/c.md", "3"), ("x/a.md", "y/b.md", "1")]
    go({"z/b.md": "another b\n"})  # two of that name
    assert ("x/a.md", "", "1") in targets(spark, store)
    go({"x/b.md": "next to the source\n"})
    assert ("x/a.md", "x/b.md", "1") in targets(spark, store)
    go({"b.md": "the exact path\n", "deep/c.md": "---\ntitle: Another\n---\nc\n", "q.md": "---\ntitle: the title\n---\n"})
    assert targets(spark, store) == [("x/a.md", "b.md", "1"), ("x/a.md", "deep/c.md", "2"), ("x/a.md", "q.md", "3")]


@pytest.mark.parametrize("seed", [1])
def test_streamed_edges_are_those_of_one_ingest(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    folders, names, titles = ["", "x/", "y/", "x/z/"], ["a", "b", "c", "d"], ["One", "Two", "b", "C"]
    paths = [f + n + ".md" for f in folders for n in names]

    def text():
        links = "".join(f"[[{rng.choice([rng.choice(names), rng.choice(titles), rng.choice(folders) + rng.choice(names), 'none'])}]]{rng.choice(['', ' (r)'])} " for _ in range(3))
        head = f"---\ntitle: {rng.choice(titles)}\n---\n" if rng.random() < 0.5 else ""
        return f"{head}{links}{rng.random()}\n"

    files = spark.createDataFrame([], "path string, content binary")
    streamed, whole, now = Store.create(spark, str(tmp_path / "s")), Store.create(spark, str(tmp_path / "w")), {}
    for _ in range(4):
        batch = {p: text() for p in rng.sample(paths, 5)}
        now |= batch
        frame = lambda d: files.unionByName(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in d.items()], files.schema))
        ingest_files(frame(batch), streamed, vaults.Concepts, whole_store_scope=True)
    ingest_files(frame(now), whole, vaults.Concepts)
    assert targets(spark, streamed) == targets(spark, whole)
    assert sorted(map(str, streamed.table("edges").collect())) == sorted(map(str, whole.table("edges").collect()))
    assert sorted(map(str, streamed.table("watches").collect())) == sorted(map(str, whole.table("watches").collect()))
    assert sorted(map(str, streamed.table("digests").collect())) == sorted(map(str, whole.table("digests").collect()))


def test_only_edges_that_differ_are_written(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    vault = {f"d{i}.md": f"[[d{i + 1}]] (next) [[d{i + 1}]] [[d{i + 1}]] [[late]]\n" for i in range(6)}
    rows = lambda files: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")
    ingest_files(rows(vault), store, vaults.Concepts)
    last = lambda t: spark.read.parquet(f"{store.root}/{store.segments()[-1]}/{t}")
    assert last("edges").count() == 6 * 4
    edit = vault | {"d2.md": "now [[d5]]\n"}
    assert ingest_files(rows(edit), store, vaults.Concepts) == Stats(6, 1, 5, 0)
    own = {r.id for r in store.table("documents").where("path = 'd2.md'").collect()}
    assert {r.source_id for r in last("edges").collect()} == own and last("edges").count() == 1 and {r.id for r in last("gone").collect()} == own
    assert ingest_files(rows(edit), store, vaults.Concepts) == Stats(6, 0, 6, 0) and len(store.segments()) == 2  # nothing at all
    assert ingest_files(rows(edit | {"late.md": "x\n"}), store, vaults.Concepts) == Stats(7, 1, 6, 0)
    assert {r.what for r in last("gone").collect()} == {"document", "resolution"} and last("links").count() == 0
    assert {r.source_path for r in graph.neighbors(last("edges"), store.table("documents")).collect()} == {f"d{i}.md" for i in (0, 1, 3, 4, 5)}
    assert sum(t == "late.md" for _, t, _ in targets(spark, store)) == 5


def test_queries_read_one_state(spark, tmp_path, monkeypatch):
    """A commit between the halves of a query does not tear it."""
    store = Store.create(spark, str(tmp_path / "s"))
    make = partial(vaults.Concepts, *vaults.QUERY_CONCEPTS)
    rows = lambda files: spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")
    ingest_files(rows(vaults.QUERY), store, make)
    engine = Engine(spark, store, make())
    want = engine.query("zebra", expand=True).collect()
    real = engine.semantic

    def late(*a, **k):  # every document is replaced, and ones that would rank first are added
        gone = store.table("documents").select("id", F.lit("document").alias("what"))
        store.append({}, gone)
        ingest_files(rows({f"new{i}.md": "zebra zebra zebra\n" for i in range(5)}), store, make)
        return real(*a, **k)

    monkeypatch.setattr(engine, "semantic", late)
    assert engine.query("zebra", expand=True).collect() == want
    monkeypatch.setattr(engine, "semantic", real)
    assert {r.path[:3] for r in engine.query("zebra").collect()} == {"new"}


def test_vacuum_spares_what_a_snapshot_holds(spark, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path / "s"))
    rows = lambda k: spark.createDataFrame([("a.md", bytearray(f"text {k}".encode()))], "path string, content binary")
    ingest_files(rows(0), store, vaults.Concepts)
    with store.snapshot() as held:
        ingest_files(rows(1), store, vaults.Concepts)
        store.compact()
        assert store.vacuum(grace=0) == 1  # the second segment; the first is held
        assert held.table("truths").first().content == "text 0" and store.table("truths").first().content == "text 1"
    assert store.vacuum(grace=0) == 1 and not store.held()
    lost = store.snapshot()
    ingest_files(rows(2), store, vaults.Concepts)
    store.compact()
    store.vacuum(grace=0)
    with pytest.raises(StoreError), lost:
        pass
    store.snapshot().__enter__()  # a reader that never lets go
    assert store.held()
    monkeypatch.setattr(store_module, "GRACE", 0)
    assert not store.held() and not store.held()


def test_statistics_need_no_lengths(spark, tmp_path, monkeypatch):
    """The list's counts are those of the lengths, after upserts, bad files, merges and two writers at once."""
    from vaultmill.operators import lexical

    monkeypatch.setattr(store_module, "MOST", 2)
    store = Store.create(spark, str(tmp_path / "s"))
    rows = lambda files: spark.createDataFrame([(p, bytearray(t)) for p, t in files.items()], "path string, content binary")
    assert tuple(store.snapshot().corpus().first()) == (0, None)
    for batch in ({"a.md": b"one two", "b.md": b"three"}, {"a.md": b"one two three four"}, {"c.md": b"\xff", "b.md": b"---\nx: [\n---\n"}, {"c.md": b"", "d.md": b"five six"}, {"a.md": b"x"}):
        ingest_files(rows(batch), store, vaults.Concepts, whole_store_scope=True)
        assert tuple(store.snapshot().corpus().first()) == tuple(lexical.stats(store.table("lengths")).first())
    one, two = Store.open(spark, store.root), Store.open(spark, store.root)
    state = two._state

    def late():
        got = state()
        two._state = state
        ingest_files(rows({"a.md": b"y y y", "e.md": b"z"}), one, vaults.Concepts)
        return got

    ingest_files(rows({"f.md": b"one"}), two, vaults.Concepts)
    two._state = late
    ingest_files(rows({"a.md": b"both write this", "f.md": b"q r"}), two, vaults.Concepts)
    assert tuple(store.snapshot().corpus().first()) == tuple(lexical.stats(store.table("lengths")).first())
    assert store.compact() and tuple(store.snapshot().corpus().first()) == tuple(lexical.stats(store.table("lengths")).first())


def test_stored_blocks_prune_without_changing_ranks(spark, tmp_path, monkeypatch):
    """Over several segments, with replaced documents whose bounds stay, and after merges."""
    import random

    from vaultmill.operators import lexical

    monkeypatch.setattr(lexical, "FIRST", 2)
    rng, store = random.Random(4), Store.create(spark, str(tmp_path / "s"))
    words = [f"w{i}" for i in range(25)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(25)], k=rng.randint(1, 40)))
    for _ in range(3):
        batch = [(f"d{i}.md", bytearray(text().encode())) for i in rng.sample(range(120), 60)]
        ingest_files(spark.createDataFrame(batch, "path string, content binary"), store, vaults.Concepts, whole_store_scope=True)

    def same():
        whole, pruned = Engine(spark, store, vaults.Concepts()), Engine(spark, store, vaults.Concepts(), prune_from=0)
        for q in ("w20 w21", "w0 w24", "w1 w2 w3 w4"):
            rows = lambda e: [(r.doc_id, r.lexical_rank, round(r.score, 9)) for r in e.lexical(q, 5).orderBy("lexical_rank").collect()]  # noqa: B023, E731
            assert rows(whole) == rows(pruned)

    same()
    stored = store.table("blocks").groupBy("block").agg(F.max("n").alias("n"))
    assert stored.count() > 16 and store.table("postings").select("block").distinct().join(stored, "block", "left_anti").count() == 0
    store.compact()
    same()
    posts = store.table("postings")
    assert {tuple(r) for r in lexical.blocks(posts).collect()} == {tuple(r) for r in store.table("blocks").collect()}


def test_rows_are_made_once_for_a_write(spark):
    """Postings and watched keys are sorted in their partitions: no range asks for a first pass over them, or sends a frequent key to one task."""
    for name in ("postings", "blocks", "watches"):
        df = spark.createDataFrame([], store_module.TABLES[name])
        plan = store_module.laid_out(name, df, 2 * store_module.FILE)._jdf.queryExecution().analyzed().toString()
        assert "RepartitionByExpression" not in plan and "Sort" in plan


def test_merges_rewrite_new_segments_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST", 3)
    store = Store.create(spark, str(tmp_path / "s"))
    rows = lambda k, n: spark.createDataFrame([(f"{k}/{i}.md", bytearray(f"text {k} {i}".encode())) for i in range(n)], "path string, content binary")
    ingest_files(rows("big", 60), store, vaults.Concepts)
    first = store.segments()[0]
    for k in range(6):
        ingest_files(rows(k, 1).unionByName(rows("big", 1)), store, vaults.Concepts, now=str(k))
    assert store.segments()[0] == first and len(store.segments()) <= 3
    assert store.table("documents").count() == 66 and store.table("truths").count() == 66
    assert store_module.newest({"segments": ["a", "b", "c", "d"], "sizes": {"a": 1000, "b": 9, "c": 2, "d": 1}}) == 3


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both read the same list; the second to commit builds on the first one's."""
    store = Store.create(spark, str(tmp_path / "s"))
    one, two = Store.open(spark, store.root), Store.open(spark, store.root)
    row = lambda i: {"documents": spark.createDataFrame([(i, i, f"{i}.md", None, "h", None, "{}", "t", "t")], TABLES["documents"])}
    gone = lambda i: spark.createDataFrame([(i, "document")], "id string, what string")
    state = two._state

    def late():  # another write comes between reading the list and committing
        got = state()
        two._state = state
        one.append(row("a"), gone("a"))
        return got

    two._state = late
    two.append(row("b"), gone("b"))
    assert sorted(r.id for r in store.table("documents").collect()) == ["a", "b"] and len(store.segments()) == 2


def test_compaction_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST", 3)
    monkeypatch.setattr(store_module, "KEPT", 2)
    store = Store.create(spark, str(tmp_path / "s"))
    for k in range(6):
        files = spark.createDataFrame([("same.md", bytearray(f"text {k}".encode())), (f"{k}.md", bytearray(b"x"))], "path string, content binary")
        ingest_files(files, store, vaults.Concepts)
    assert len(store.segments()) <= 4 and len(store.numbers()) <= 2
    docs = store.table("documents").select("path").collect()
    assert sorted(r.path for r in docs) == [f"{k}.md" for k in range(6)] + ["same.md"]
    assert store.table("truths").where("title = 'same'").first().content == "text 5"
    folders = lambda: {p.name for p in (tmp_path / "s").glob("segment-*")}
    assert store.vacuum() == 0 and len(folders()) > len(store.segments())  # readers may still hold the old ones
    assert store.vacuum(grace=0) > 0 and folders() == set(store.segments())
    old = store.segments()
    two = Store.open(spark, store.root)
    assert store.compact() and len(store.segments()) == 1
    two.segments = lambda: old  # a compaction that started before the other one ended gives way
    assert not two.compact() and len(Store.open(spark, store.root).segments()) == 1


def scans(df):
    """The file scans of a plan, and whether each has a filter on ids."""
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return [line for line in plan.splitlines() if "FileScan" in line], plan


def test_lookups_filter_their_scans(spark, expand_engine):
    """Without broadcasts by size no table is read whole or shuffled for a few ids."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, edges = expand_engine.store.table("documents"), expand_engine.store.table("edges")
        i = docs.where("path = 'A.md'").first().id
        got, plan = scans(graph.neighbors(edges, docs, i))
        assert len(got) == 3 and all("PushedFilters: [" in x and "PushedFilters: []" not in x for x in got) and "SortMergeJoin" not in plan
        rows, few = graph.matching(docs, "id", edges.select("target_id"))
        assert few and "SortMergeJoin" not in scans(rows)[1] and all("PushedFilters: []" not in x for x in scans(rows)[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expansion_by_lookup_is_the_walk(spark, monkeypatch):
    import random

    rng = random.Random(8)
    name = lambda i: f"d{i:03}"
    links = [(name(rng.randrange(120)), name(rng.randrange(160))) for _ in range(400)]
    edges = spark.createDataFrame(links, "source_id string, target_id string")
    docs = spark.createDataFrame([(name(i),) for i in range(120)], "id string")
    for few in (1000, 5):
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(graph, "SOME", 40)
        for seeds, depth, top in [(["d000"], 1, 20), (["d001", "d002", "none"], 2, 20), (["d003"], 3, 7), (["d004"], 3, 500), ([], 2, 20), (["d005"], 2, 0)]:
            s = spark.createDataFrame([(x,) for x in seeds], "doc_id string")
            want = [tuple(r) for r in graph.expand(s, edges, docs, depth, top).collect()]
            assert graph.expand_from(seeds, edges, docs, depth, top) == want


def test_embedders(spark, tmp_path, capsys):
    assert encoder(VocabularyEmbedder(["zebra", "the"]))(["The zebra, the Zébra", ""]).tolist() == [[2, 2], [0, 0]]
    assert isinstance(named("vaultmill.operators.embed:HashingEmbedder"), HashingEmbedder)
    with pytest.raises(TypeError):
        named("builtins:list")

    class Quiet:
        def encode(self, texts, show_progress_bar=True):
            assert show_progress_bar is False
            return [[1.0]] * len(texts)

    assert encoder(Quiet())(["a"]).tolist() == [[1.0]]
    folder, root = vaults.write(tmp_path / "n", {"a.md": "one\n", "b.md": b"\xff"}), str(tmp_path / "s")
    run = lambda *a: cli.main([*a, "--store", root], spark)
    model = ("--embedder", "vaultmill.operators.embed:HashingEmbedder")
    assert run("init") == 0 and run("ingest", folder, "--strict", *model) == 1
    assert "b.md: not valid UTF-8" in capsys.readouterr().err and Store.open(spark, root).table("documents").count() == 0
    assert run("ingest", folder, *model) == 1 and run("query", "one", *model) == 0
    assert "path: a.md" in capsys.readouterr().out


def test_errors_name_documents(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    bad = spark.createDataFrame([(f"{k}.md", bytearray(b"---\na: [\n---\n")) for k in range(30)] + [("ok.md", bytearray(b"x"))], "path string, content binary")
    with pytest.raises(ParseError) as e:
        ingest_files(bad, store, vaults.Concepts, strict=True)
    assert e.value.total == 30 and len(e.value.failures) == 20 and "0.md: malformed front matter" in str(e.value)
    assert isinstance(e.value, IngestError)


def test_refused_query_warns(query_engine, caplog):
    with caplog.at_level("WARNING"):
        assert {r.signal for r in query_engine.query("it's a zebra").collect()} == {"semantic"}
    assert "refused" in caplog.text


def test_hit_without_document(spark, tmp_path_factory):
    _, store, make, _ = build(spark, tmp_path_factory, vaults.QUERY, vaults.QUERY_CONCEPTS)
    gone = store.table("documents").select("id", F.lit("document").alias("what"))
    store.append({t: store.table(t) for t in ("postings", "lengths", "chunks")}, gone)
    with pytest.raises(QueryError):
        Engine(spark, store, make()).query("zebra")
    assert Tools(spark, store.root, make()).query("zebra").is_error


def test_front_matter_that_comes_between_two_looks_is_read(spark, tmp_path, monkeypatch):
    """Files looked plain when they were first read; the rows are made again with their front matter."""
    import vaultmill.plans.ingest as module

    monkeypatch.setattr(module, "fronted", lambda files: False)
    store = Store.create(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("a.md", bytearray(b"---\ntitle: T\n---\nsee [[b]]")), ("b.md", bytearray(b"text"))], "path string, content binary")
    assert ingest_files(files, store, HashingEmbedder) == Stats(2, 2, 0, 0)
    assert {(r["path"], r["title"]) for r in store.table("documents").collect()} == {("a.md", "T"), ("b.md", "b")}


def test_links_of_plain_notes_are_grouped_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Watches, edges and digests of a source are made in the partition that its note is in."""
    plans = {}
    real = Store.append
    look = lambda t: {k: t[k]._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0] for k in ("watches", "edges", "digests")}
    # (the links are made first: plans on top of them are final then)
    monkeypatch.setattr(Store, "append", lambda self, tables, gone: (tables["links"].count(), plans.update(look(tables)), real(self, tables, gone))[-1])
    store = Store.create(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([(f"{k}.md", bytearray(f"[[{k + 1}]] (r) [[{k + 1}]] (r) [[x]]".encode())) for k in range(50)], "path string, content binary")
    ingest_files(files, store, HashingEmbedder)
    assert not any("Exchange hashpartitioning(source_id" in p for p in plans.values()) and len(plans) == 3
    assert store.table("edges").count() == 100 and store.table("digests").count() == 50
    assert store.table("watches").count() == store.table("watches").distinct().count()
