"""The index end to end: extraction, snapshots, reconcile, search, readers, ignore rules and the stream."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import strings as S
from quarry.index import CodeIndex, NoCallers, UnknownSymbol, as_json
from quarry.operators import extract, ignore, lines, relate, search
from quarry.operators.store import Conflict, NoIndex
from quarry.sources import tree
from quarry.sources.watch import TreeChanges, changes
from quarry.streaming import feed

GO = """package pay

// Charge takes a payment for a customer.

type Ledger interface {
}

func (s *Service) ProcessPayment(q int) error {
	if (q > 0) {
		record(q)
	}
}

func Outer() {
	type body struct {
	}
	ProcessPayment(1)
}
"""
PY = "class Job:\n    def run(self):\n        return work(1)\n"


@pytest.fixture()
def root(tmp_path):
    for name, text in {"src/pay.go": GO, "lib/job.py": PY, "vendor/x.go": GO, "notes.md": "x", "gen/skip.go": GO, ".git/HEAD": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def frame(spark, *rows):
    return spark.createDataFrame(rows, "file_path string, text string")


def test_extraction(spark):
    files = frame(spark, ("src/pay.go", GO))
    every = lines.lines(files)
    symbols = extract.end_lines(extract.symbols(every), lines.line_counts(files))
    got = [(r.name, r.kind, r.scope, r.start_line, r.end_line) for r in symbols.orderBy("start_line").collect()]
    # the comment sticks to the next symbol over blank lines; a nested type takes the rest of its function
    assert got == [
        ("Ledger", "interface", "Charge takes a payment for a customer.", 5, 7), ("ProcessPayment", "function", "", 8, 13), ("Outer", "function", "", 14, 14), ("body", "type", "", 15, 18),
    ]
    calls = relate.enclose(extract.call_sites(every), symbols)
    assert sorted(map(str, calls.collect())) == sorted(map(str, extract.enclosed_calls(every).select(*calls.columns).collect()))
    assert sorted(map(str, symbols.collect())) == sorted(map(str, extract.symbols_with_ends(every).select(*symbols.columns).collect()))
    found = {(r.callee_name, r.line, r.col): r.enclosing_name for r in calls.collect()}
    assert found[("record", 10, 3)] == "ProcessPayment" and found[("ProcessPayment", 17, 2)] == "body"
    assert ("if", 9, 2) in found  # keywords count in regex mode


def test_call_columns_are_bytes(spark):
    got = extract.call_sites(spark.createDataFrame([("a.go", 1, "éfoo(1) bar (2)")], "file_path string, line int, text string"))
    assert sorted((r.callee_name, r.col) for r in got.collect()) == [("bar", 10), ("foo", 3)]


def test_like_folds_ascii_only(spark):
    df = spark.createDataFrame([("ProcessPayment",), ("ÀB",)], "name string")
    assert df.where(S.contains_folded(F.col("name"), "payMENT")).count() == 1
    assert df.where(S.contains_folded(F.col("name"), "àb")).count() == 0
    paths = spark.createDataFrame([("src",), ("SRC/a",), ("srcx/a",), ("Src",)], "p string")
    assert {r.p for r in paths.where(S.under_dir(F.col("p"), " /src/ ")).collect()} == {"src", "SRC/a"}


def test_symbol_ids(spark):
    ids = ["a#b/c.go#function#F#12", "x#y", "a#k#n#x", "#k#n#1", "p#k##1"]
    got = [r.p for r in spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, i string").orderBy("k").select(S.parse_symbol_id(F.col("i")).alias("p")).collect()]
    assert tuple(got[0]) == ("a#b/c.go", "function", "F", 12) and got[1:] == [None] * 4


def test_ignore_rules(spark):
    rules = ignore.parse("# c\n\\#x.go\n*.gen.go\n!keep.gen.go\n/top.go\nbuildx/\n") + ignore.parse("local.go\n", "a", 50)
    paths = ["#x.go", "a/b.gen.go", "a/keep.gen.go", "top.go", "a/top.go", "buildx/m.go", "a/buildx/m.go", "local.go", "a/local.go", "node_modules/q.go", "p.png", "r.txt", "ok.TS"]
    kept = ignore.kept_paths(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    assert {r.path for r in kept.collect()} == {"a/keep.gen.go", "a/top.go", "local.go", "ok.TS"}


def test_readers(spark):
    files = frame(spark, ("a", "one\ntwo\r\nthree\n"), ("b", ""), ("c", "x"))
    got = {r.file_path: r.content for r in lines.read_lines(files, 2, 9).collect()}
    assert got == {"a": "2\ttwo\n3\tthree", "b": "", "c": ""}
    with pytest.raises(lines.ReadError):
        lines.read_lines(files, 1, 501)
    cut = files.where("file_path = 'a'").select(lines.byte_slice(F.col("text"), F.lit(4), F.lit(7)).cast("string").alias("m"), lines.byte_slice(F.col("text"), F.lit(90), F.lit(99)).cast("string").alias("e"), lines.line_at_byte(F.col("text"), F.lit(5)).alias("n")).first()
    assert (cut.m, cut.e, cut.n) == ("two", "", 2)


def test_limits_of_reads(spark):
    many = "x\n" * 700
    wide = ("y" * 900 + "\n") * 600
    files = frame(spark, ("many", many), ("wide", wide), ("long", "a\n" + "z" * lines.MAX_LINE + "\nb\n"), ("é", "aé\nb\r\n\nc"))
    one = lambda p: files.where(F.col("file_path") == p)
    assert lines.read_lines(one("many"), 201, 700).first().content.startswith("201\tx\n202\tx")
    assert lines.read_lines(one("many"), 700, 900).first().content == "700\tx" and lines.read_lines(one("many"), 701, 702).first().content == ""
    with pytest.raises(lines.SpanTooLarge):
        lines.read_lines(files, 1, 501)
    for start, end in ((0, 1), (3, 2)):
        with pytest.raises(lines.InvalidRange):
            lines.read_lines(files, start, end)
    for start, end in ((-1, 4), (4, 4)):
        with pytest.raises(lines.InvalidRange):
            lines.read_bytes(files, start, end)
    with pytest.raises(lines.ResponseTooLarge):
        lines.read_bytes(files, 0, lines.MAX_BYTES + 1)
    for read, what in ((lambda: lines.read_lines(one("long"), 1, 3), "line too long: long"), (lambda: lines.read_bytes(one("many"), 0, 1400), "span too large: many"), (lambda: lines.read_bytes(one("wide"), 0, lines.MAX_BYTES), "span too large: wide")):
        with pytest.raises(Exception, match=what):
            read().collect()
    assert lines.read_lines(one("long"), 1, 1).first().content == "1\ta"  # a long line further down does no harm
    got = lines.read_bytes(one("é"), 1, 7).first().content
    assert got == "1\té\n2\tb\r" and lines.read_bytes(one("é"), 90, 99).first().content == ""
    symbols = spark.createDataFrame([("many", "k", "n", 1, 600, None, None)], "file_path string, kind string, name string, start_line int, end_line int, start_byte long, end_byte long")
    with pytest.raises(Exception, match="span too large"):
        lines.read_symbols(symbols, files).collect()
    some = spark.createDataFrame([("é", "k", f"n{k}", 1, 2, a, b) for k, (a, b) in enumerate(((0, 3), (3, 3), (40, 50), (None, 9), (-1, 4), (3, 4)))], symbols.schema)
    assert [r.content for r in lines.read_symbols(some, files).orderBy("symbol_id").collect()] == ["1\taé", *["1\taé\n2\tb"] * 4, "1\t"]


def names(df):
    return sorted(r.name for r in df.collect())


def test_reconcile_and_queries(spark, root, tmp_path):
    (root / ".gitignore").write_text("gen/\n!gen/\n*.tmp.go\n")
    (root / "lib/.gitignore").write_text("private_*\n!private_ok.py\n")
    (root / "lib/private_no.py").write_text(PY)
    (root / "lib/private_ok.py").write_text("def ok():\n    pass\n")
    (root / "lib/__init__.py").write_text("")
    (root / "x.tmp.go").write_text(GO)
    index = CodeIndex(spark, f"{tmp_path}/.index", str(root))
    assert index.reconcile()["new"] == 5  # ignored files, vendor and other endings stay out
    assert {r.path: r.n_symbols for r in index.store.read("files").collect()} == {"src/pay.go": 4, "lib/job.py": 2, "gen/skip.go": 4, "lib/private_ok.py": 1, "lib/__init__.py": 0}
    assert index.reconcile() == {"unchanged": 5}
    assert [r.file_path for r in index.search("ProcessPayment").collect()] == ["gen/skip.go", "src/pay.go"]
    assert {r.matched_in for r in index.search("customer").collect()} == {"scope"}
    assert {r.name for r in index.search("essPay").collect()} == {"ProcessPayment"}  # no such token: words in names
    assert index.search("").collect() == index.search("  ").collect() == []
    assert [r.name for r in index.outline("src/pay.go").collect()] == ["Ledger", "ProcessPayment", "Outer", "body"]
    callers = index.find_callers("ProcessPayment", "src").collect()
    assert [(r.line, r.enclosing_name, r.enclosing_id) for r in callers][-1] == (17, "body", "src/pay.go#type#body#15")
    assert index.find_callers(symbol_id="any#k#ProcessPayment#1").count() == 4
    with pytest.raises(NoCallers):
        index.find_callers("nobody")
    with pytest.raises(UnknownSymbol):
        index.symbol("src/pay.go#function#Gone#1")
    for bad in (lambda: index.outline(" "), lambda: index.find_callers(" "), lambda: index.map_directory(" / "), lambda: index.search("x", name_match="like"), lambda: index.read_symbol("")):
        with pytest.raises(search.BadQuery):
            bad()
    assert index.read_lines("src/pay.go", 14, 15) == "14\tfunc Outer() {\n15\t\ttype body struct {"
    assert index.read_bytes("/src/../src/pay.go", 0, 11) == "1\tpackage pay"
    assert index.read_symbol("lib/job.py#function#run#2") == "2\t    def run(self):\n3\t        return work(1)"
    assert index.check_file("lib/job.py").first().ok
    row = index.map_directory("src").first()
    assert row.n_definitions == 4 and row.definitions[0].name == "Ledger"
    assert as_json(index.search("nothing_like_it")) == "[]" and as_json(index.outline("lib/job.py")).startswith('[{"symbol_id":"lib/job.py#class#Job#1"')
    version, postings = index.store.manifest()["version"], index.store.live_postings().count()
    os.remove(root / "gen/skip.go")
    (root / "lib/job.py").write_text(PY + "\ndef more():\n    pass\n")
    old = index.symbols
    assert index.reconcile() == {"deleted": 1, "stale": 1, "unchanged": 3}
    assert index.store.manifest()["version"] == version + 1  # one version for the whole difference
    assert names(index.outline("lib/job.py")) == ["Job", "more", "run"] and len(names(old)) == 11  # who reads an old version goes on with it
    status = index.status().first()
    assert (status.n_files, status.n_symbols, status.n_call_sites) == (4, index.symbols.count(), index.call_sites.count()) and status.bytes == index.store.size_bytes() > 0
    assert status.last_sync_at.endswith("Z") and not status.reconcile_needed
    assert {r.file_path for r in index.search("ProcessPayment").collect()} == {"src/pay.go"}
    assert index.store.live_postings().count() < postings < index.store.read("postings").count() + postings
    live = sorted(map(str, index.store.live_postings().drop("generation").collect()))
    assert live == sorted(map(str, search.postings(index.symbols).collect()))
    index.store.compact()
    assert sorted(map(str, index.store.read("postings").drop("generation").collect())) == live


def test_writers_conflict(spark, tmp_path):
    store, other = (CodeIndex(spark, f"{tmp_path}/i").store for _ in range(2))
    index = CodeIndex(spark, f"{tmp_path}/i")
    with pytest.raises(NoIndex):
        store.read("symbols")
    files = lambda *names: spark.createDataFrame([(n, 1, 1, f"func F{n[0]}() {{}}") for n in names], "path string, mtime_ns long, size long, text string")
    index.apply(files("a.go", "b.go"))
    base = store.manifest()
    other.set_meta(k="theirs")
    with pytest.raises(Conflict):
        store._publish({"base": base["version"], "tables": base["tables"], "stats": base["stats"], "meta": {"k": "mine"}})
    assert store.get_meta("k") == "theirs" and store.get_meta("none") is None
    (tmp_path / "i/manifest/7.json").write_text("{")  # a writer that died
    assert store.manifest()["version"] == 2 and names(index.symbols) == ["Fa", "Fb"]
    index.apply(files("c.go"), files("a.go").select("path"))
    assert store.manifest()["version"] == 8 and names(index.symbols) == ["Fb", "Fc"]
    untouched = {b for b, f in base["tables"]["symbols"].items()} & {b for b, f in store.manifest()["tables"]["symbols"].items() if f == base["tables"]["symbols"].get(b)}
    assert untouched  # b.go's bucket was not written again
    store.destroy()
    assert not store.exists()


def test_refresh_beside_queries(spark, root, tmp_path):
    index = CodeIndex(spark, f"{tmp_path}/.index", str(root))
    assert not index.ensure_fresh()  # nothing to refresh
    assert index.hydrate() > 0 and int(index.store.get_meta("last_hydration_ms")) > 0
    assert not index.ensure_fresh()
    (root / "src/pay.go").write_text("func Changed() {}\n")
    os.remove(root / "lib/job.py")
    (root / "src/added.go").write_text("func Added() {}\n")
    assert {(r.path, r.state) for r in index.stale().collect()} == {("src/pay.go", "stale"), ("lib/job.py", "deleted")}
    assert index.ensure_fresh()
    index.close()
    assert index.refresh_error is None
    assert set(names(index.symbols)) == {"Changed", "Ledger", "ProcessPayment", "Outer", "body"}  # new files aren't looked for
    index.reconcile_needed = True
    assert index.ensure_fresh()
    index.close()
    assert "Added" in names(index.symbols) and not index.reconcile_needed


def test_batches_of_the_feed_are_applied(spark, root, tmp_path):
    index = CodeIndex(spark, f"{tmp_path}/.index", str(root))
    index.reconcile()
    (root / "src/pay.go").write_text("func Now() {}\n")
    (root / "src/new.go").write_text("func New() {}\n")
    (root / "notes.md").write_text("func No() {}\n")
    os.remove(root / "lib/job.py")
    batch = spark.createDataFrame([("src/pay.go", "sync"), ("src/new.go", "sync"), ("notes.md", "sync"), ("lib/job.py", "sync"), ("gen/skip.go", "remove")], "path string, action string")
    assert feed.applied(index, batch) == {"synced": 2, "removed": 3}
    assert names(index.symbols) == ["New", "Now"]
    feed.applied(index, spark.createDataFrame([("", "reconcile")], "path string, action string"))
    assert "ProcessPayment" in names(index.symbols)  # gen/skip.go is there again


def test_stream_keeps_the_index(spark, root, tmp_path):
    index = CodeIndex(spark, f"{tmp_path}/.index", str(root))
    index.reconcile()
    (root / "src/pay.go").write_text("func Now() {}\n")
    os.remove(root / "lib/job.py")
    t = datetime.datetime(2024, 1, 1)
    later = t + datetime.timedelta(minutes=1)
    rows = [("src/pay.go", "write", t), ("lib/job.py", "remove", t), ("gen/skip.go", "chmod", t), ("z.go", "write", later)]
    spark.createDataFrame(rows, "path string, op string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("path string, op string, ts timestamp").parquet(f"{tmp_path}/in")
    feed.follow(index, events, f"{tmp_path}/cp").awaitTermination(120)
    assert set(names(index.symbols)) == {"Now", "Ledger", "ProcessPayment", "Outer", "body"}


def test_tree_changes_stream(spark, root, tmp_path_factory):
    spark.dataSource.register(TreeChanges)
    events = spark.readStream.format("quarry_tree").option("root", str(root)).load()
    got = []
    q = events.writeStream.trigger(processingTime="300 milliseconds").option("checkpointLocation", str(tmp_path_factory.mktemp("cp"))).foreachBatch(lambda df, _: got.extend((r.path, r.op) for r in df.collect())).start()

    def until(n):
        end = time.monotonic() + 60
        while len(got) < n and time.monotonic() < end:
            time.sleep(0.2)

    until(1)
    (root / "src/pay.go").write_text("func Now() {}\n")
    (root / "vendor/y.go").write_text("x")
    until(2)
    os.remove(root / "lib/job.py")
    (root / "new.go").write_text("x")
    until(4)
    q.stop()
    assert got[:2] == [("", "error"), ("src/pay.go", "write")] and sorted(got[2:]) == [("lib/job.py", "remove"), ("new.go", "create")]
    assert changes({"a": (1, 1), "b": (1, 1), "c": (1, 1)}, {"a": (1, 1), "b": (2, 1), "d": (1, 1)}) == [("b", "write"), ("c", "remove"), ("d", "create")]


def test_root_and_paths(root):
    assert tree.find_root(str(root / "src")) == str(root)
    assert tree.safe_path(str(root), "src/pay.go").endswith("pay.go") == tree.safe_path(str(root), "/../src/pay.go").endswith("pay.go")
    os.symlink("/etc/hostname", root / "src/out.go")
    for path, error in (("../x", FileNotFoundError), ("src", IsADirectoryError), ("src/out.go", tree.OutsideRoot)):
        with pytest.raises(error):
            tree.safe_path(str(root), path)


def test_odd_roots(spark, tmp_path):
    root = tmp_path / "a+b (c)[d].e"
    (root / "deep/er").mkdir(parents=True)
    (root / "deep/er/_x.py").write_text(PY)
    (root / ".hidden").mkdir()
    (root / ".hidden/y.py").write_text(PY)
    assert [r.path for r in tree.crawl(spark, str(root)).collect()] == [".hidden/y.py", "deep/er/_x.py"]


def test_modes():
    assert search.match_mode(" OR ") == "or" and search.match_mode("x") == "and"
    assert search.quoted_query('a"b c', "or") == '"a""b" OR "c"' and search.quoted_query(" ") == '""'
    assert search.phrases_of("foo_bar É *") == [["foo", "bar"], ["e"]]


def test_stream_debounces(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    ms = lambda n: t + datetime.timedelta(milliseconds=n)
    rows = [("a", "write", ms(0)), ("a", "write", ms(100)), ("a", "remove", ms(200)), ("b", "create", ms(50)), ("b", "chmod", ms(60)), ("a", "write", ms(5000)), ("z", "write", ms(60_000))]
    spark.createDataFrame(rows, "path string, op string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("path string, op string, ts timestamp").parquet(f"{tmp_path}/in")
    got = []
    q = feed.stream(events, lambda df, _: got.extend((r.path, r.action, r.n_events) for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(got) == [("a", "remove", 3), ("a", "sync", 1), ("b", "sync", 1)]


def test_a_build_tells_lines_apart_once(spark, tmp_path, monkeypatch):
    calls, own = [], extract.annotated
    monkeypatch.setattr(extract, "annotated", lambda df: calls.append(1) or own(df))
    text = "// a note of a b a\nfunc Some(q int) {\n\tcall(q)\n}\n// " + "w x " * 60 + "\nfunc Long() {}\n"
    index = CodeIndex(spark, str(tmp_path / "once"))
    index.apply(frame(spark, ("p/a.go", text)).select(F.col("file_path").alias("path"), F.lit(0).alias("mtime_ns"), F.lit(1).alias("size"), "text"))
    assert len(calls) == 1
    want = {tuple(r) for r in search.postings(index.symbols).selectExpr("token", "name", "col", "cast(positions as string)", "dl").collect()}
    got = [tuple(r) for r in index.store.read("postings").selectExpr("token", "name", "col", "cast(positions as string)", "dl").collect()]
    assert len(got) == len(want) and set(got) == want
    assert sorted(r[0] for r in index.call_sites.select("callee_name").collect()) == ["Long", "Some", "call"]
