"""History, git, source trees, index build, streaming, documents."""

import subprocess

import pytest
from pyspark.sql import functions as F

from strataline.operators import documents as D
from strataline.operators.history import cache_key, churn, co_changes, commit_log, last_touch, ranked_co_changes, read_through, with_shallow
from strataline.plans.index_build import build_index, current, diff_files, drop_old_builds, read_index
from strataline.session import dropping, materialize
from strataline.sources import git as G
from strataline.sources import trees as T
from strataline.sources.documents import context_log, markdown_files, slice_text
from strataline.sources.trees import extract, source_files
from strataline.streaming.watch import start_watch, stop_watch, stream_counts, watch_status

T_DDL = "repo string, sha string, ts long, path string, added long, deleted long"


def touches(spark, rows):
    return spark.createDataFrame(rows, T_DDL)


ROWS = [("r", "c1", 10, "a", 1, 0), ("r", "c1", 10, "b", 2, 1), ("r", "c2", 20, "a", 1, 1), ("r", "c2", 20, "b", 0, 0), ("r", "c3", 30, "a", 5, 0), ("q", "c1", 5, "a", 1, 1), ("r", "c3", 30, "a", 5, 0)]


def test_history(spark):
    t = touches(spark, ROWS)
    assert [tuple(r) for r in co_changes(t).collect()] == [("r", "a", "b", 2)]
    assert co_changes(t, min_support=3).count() == 0 and co_changes(t, since=15).first()["count"] == 1
    assert {(r.repo, r.path): r.commits for r in churn(t).collect()} == {("r", "a"): 3, ("r", "b"): 2, ("q", "a"): 1}
    assert {r.path: (r.sha, r.ts) for r in last_touch(t).filter("repo = 'r'").collect()} == {"a": ("c3", 30), "b": ("c2", 20)}
    assert commit_log(t.limit(0)).count() == 0
    log = {r.sha: (r.added, r.deleted) for r in commit_log(t.filter("repo = 'r'"), since=10, until=30).collect()}
    assert log == {"c1": (3, 1), "c2": (1, 1)}


def test_ranked_pairs(spark):
    pairs = spark.createDataFrame([("r", "a", "b", 2), ("r", "a", "c", 5), ("q", "x", "y", 2), ("r", "b", "c", 2)], "repo string, a string, b string, count long")
    assert [tuple(r)[:3] for r in ranked_co_changes(pairs).collect()] == [("r", "a", "c"), ("q", "x", "y"), ("r", "a", "b"), ("r", "b", "c")]
    assert sorted(tuple(r) for r in ranked_co_changes(pairs, 1, ["repo"]).collect()) == [("q", "x", "y", 2, 1), ("r", "a", "c", 5, 1)]
    assert [r.shallow for r in with_shallow(pairs, None).collect()] == [None] * 4


def test_language_of_a_plug_in(spark, monkeypatch):
    monkeypatch.setattr(T, "EXTENSIONS", dict(T.EXTENSIONS))
    monkeypatch.setattr(T, "EXTRACTORS", dict(T.EXTRACTORS))
    T.register_language("words", ("wrd",), lambda text: ([], [(w, "call", 1, None) for w in text.split()]))
    files = spark.createDataFrame([("a.wrd", "h", "one two"), ("b.xyz", "h", "one")], "path string, hash string, text string")
    found = T.extract_files(files.withColumn("lang", T.lang_for_path("path"))).collect()
    assert {r.path: [x.name for x in r.refs] for r in found} == {"a.wrd": ["one", "two"], "b.xyz": []}


def test_tables_are_dropped(spark):
    with dropping(spark):
        t = materialize(spark.range(5))
        path = t.inputFiles()[0]
        assert t.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path.rpartition("/")[0]).count()


def test_validation_in_one_row(spark):
    ddl = "capability string, file string, text string"
    new = spark.createDataFrame([("core", "a.md", "### Requirement: x\nIt MUST.\n#### Scenario: s\n"), ("cord", "b.md", None), ("other", "c.md", "plain")], ddl)
    old = spark.createDataFrame([("core", "a.md", "### Requirement: x\n### Requirement: y\n"), ("care", "d.md", "")], ddl)
    got = {r.capability: (len(r.issues), r.dropped, r.near) for r in D.validation(new, old).collect()}
    assert got == {"core": (0, ["y"], []), "cord": (0, [], ["core", "care"]), "other": (3, [], [])}


def test_cache_is_read_while_the_head_stays(spark, tmp_path):
    t = touches(spark, ROWS)
    key = cache_key("churn", since=None)
    first = read_through(t, key, lambda: churn(t), str(tmp_path)).count()
    assert first == 3
    # the second call must not compute: it would fail
    assert read_through(t, key, lambda: 1 / 0, str(tmp_path)).count() == 3
    more = t.union(touches(spark, [("q", "c9", 9, "z", 1, 1)]))
    assert read_through(more, key, lambda: churn(more), str(tmp_path)).count() == 4
    assert read_through(t.limit(0), key, lambda: churn(t.limit(0)), str(tmp_path)).count() == 0


def test_git_log(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for text in ("1\n", "1\n2\n"):
        for name in ("with space.txt", "año.txt"):
            (tmp_path / name).write_text(text)
        run("add", ".")
        run("commit", "-qm", "m")
    (tmp_path / "bin").write_bytes(b"\x00\x01\x02")
    run("add", ".")
    run("commit", "-qm", "b")
    log = G.read_log(spark, str(tmp_path), "r")
    assert {r.path: r.commits for r in churn(log).collect()} == {"with space.txt": 2, "año.txt": 2, "bin": 1}
    assert [(r.added, r.deleted) for r in log.filter("path = 'bin'").collect()] == [(0, 0)]
    assert G.is_git_repo(str(tmp_path)) and not G.is_shallow(str(tmp_path)) and len(G.head_sha(str(tmp_path))) == 40
    assert set(G.tracked_paths(str(tmp_path))) == {"with space.txt", "año.txt", "bin"}
    assert G.changed_files(str(tmp_path), "HEAD~1") == ["bin"] and G.changed_files(str(tmp_path), "nope") == []
    assert G.head_sha(str(tmp_path / "none")) is None and G.read_log(spark, str(tmp_path / "none"), "r").count() == 0


SOURCES = {
    "src/util.ts": "export function helper(x: number) {\n  return x;\n}\n",
    "src/main.ts": 'import { helper } from "./util.js";\n\nfunction gamma() { return 1; }\nfunction beta() { return gamma(); }\nexport function alpha() {\n  // gamma(): not a call\n  return beta() + helper(2);\n}\nexport class Widget {\n  render() { return alpha(); }\n}\ninterface Shape { area(): number; }\ntype Id = string;\n',
    "src/calc.py": "import os\n\ndef compute(x):\n    return len(x)\n\nclass Calculator:\n    def run(self):\n        return compute([1])\n",
    "src/greet.js": "function greet(n) { return `hi ${n}`; }\n",
    "node_modules/x/index.js": "function hidden() {}\n",
    "notes.txt": "no source",
}


def test_extract():
    syms, refs = extract(SOURCES["src/main.ts"], "typescript")
    assert [(s[0], s[1]) for s in syms] == [("gamma", "function"), ("beta", "function"), ("alpha", "function"), ("Widget", "class"), ("render", "method"), ("Shape", "interface"), ("Id", "type")]
    calls = [(r[0], syms[r[3]][0]) for r in refs if r[1] == "call"]
    assert calls == [("gamma", "beta"), ("beta", "alpha"), ("helper", "alpha"), ("alpha", "render")]
    assert [r[0] for r in refs if r[1] == "import"] == ['import { helper } from "./util.js"']
    syms, refs = extract(SOURCES["src/calc.py"], "python")
    assert [(s[0], s[1], s[2], s[3], s[6]) for s in syms] == [("compute", "function", 3, 4, None), ("Calculator", "class", 6, 8, None), ("run", "function", 7, 8, 1)]
    assert [(r[0], r[1], r[3]) for r in refs] == [("import os", "import", None), ("len", "call", 0), ("compute", "call", 2)]
    assert extract("def broken(:", "python") == ([], []) and extract(None, "python") == ([], []) and extract("x", None) == ([], [])
    text = "# é\ndef f():\n    return 'é'\n"
    (s,), _ = extract(text, "python")
    assert slice_text(text, s[4], s[5]) == "def f():\n    return 'é'" and slice_text(text, 5, 2) == ""


def write(root, sources):
    for p, t in sources.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def test_build_refresh_and_remove(spark, tmp_path):
    root, store = tmp_path / "tree", f"file://{tmp_path}/store"
    write(root, SOURCES)
    assert current(spark, store) is None
    first = build_index(spark, store, source_files(spark, str(root)))
    assert (first["indexed"], first["unchanged"], first["removed"]) == (4, 0, 0)
    index = read_index(spark, store)
    by_name = {r.name: r.id for r in index["nodes"].collect()}
    resolved = {(r.dst_name, r.dst_node_id) for r in index["edges"].filter("kind = 'call'").collect()}
    assert ("alpha", by_name["alpha"]) in resolved and ("len", None) in resolved
    assert index["edges"].filter("kind = 'import' and dst_node_id is not null").count() == 0
    assert index["node_embeddings"].count() == index["nodes"].count()
    assert build_index(spark, store, source_files(spark, str(root)))["indexed"] == 0
    (root / "src/greet.js").unlink()
    (root / "src/util.ts").write_text("export function helper2() {}\n")
    third = build_index(spark, store, source_files(spark, str(root)))
    assert (third["changed"], third["unchanged"], third["removed"]) == (1, 2, 1)
    index = read_index(spark, store)
    assert {r.name for r in index["nodes"].collect()} >= {"helper2", "alpha"} and "greet" not in {r.name for r in index["nodes"].collect()}
    assert index["edges"].filter("dst_name = 'helper' and dst_node_id is not null").count() == 0
    assert drop_old_builds(spark, store) >= 1 and read_index(spark, store)["files"].count() > 0 and drop_old_builds(spark, store) == 0


def test_diff_keeps_what_was_only_seen(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    old, new = f([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)]), f([("a", "1"), ("b", "2"), ("e", "1"), ("d", None)])
    seen = f([("c", "x")])
    got = {r.path: r.state for r in diff_files(old, new, ["path"], seen).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "unchanged", "e": "new"}
    assert {r.path: r.state for r in diff_files(old, new, ["path"]).collect()}["c"] == "removed"


def test_stream_counts_continue(spark, tmp_path):
    src, args = tmp_path / "in", (f"{tmp_path}/out", f"{tmp_path}/state")
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    df.coalesce(1).write.parquet(str(src))
    run = lambda: {r.k: r.n for r in stream_counts(spark, str(src), "k string", ["k"], *args).collect()}
    assert run() == {"a": 2, "b": 1}
    df.coalesce(1).write.mode("append").parquet(str(src))
    assert run() == {"a": 4, "b": 2}


def test_watch_refreshes(spark, tmp_path):
    root, calls = tmp_path / "tree", []
    write(root, {"a.py": "x = 1\n"})
    q = start_watch(spark, str(root), lambda: calls.append(1), f"{tmp_path}/cp", "watch-test", once=True)
    q.awaitTermination(60)
    assert calls and watch_status(q)["refreshes"] >= 1
    assert stop_watch(spark, "watch-test") is False


def test_documents(spark, tmp_path):
    good = "### Requirement: One thing \r\nIt SHALL work.\n#### Scenario: x\n"
    write(tmp_path, {"specs/a/spec.md": good, "specs/a/note.txt": "x", "specs/b/spec.md": "text\n - [ ] open\n* [x] done\n"})
    docs = {r.path: r for r in markdown_files(spark, str(tmp_path)).select("path", D.issues(F.col("text")).alias("i"), D.requirement_names(F.col("text")).alias("r"), D.open_tasks(F.col("text")).alias("t")).collect()}
    assert docs["specs/a/spec.md"].i == [] and docs["specs/a/spec.md"].r == ["One thing"]
    assert len(docs["specs/b/spec.md"].i) == 3 and docs["specs/b/spec.md"].t == 1 and len(docs) == 2
    side = lambda rows: spark.createDataFrame(rows, "capability string, text string")
    canonical = side([("a", good), ("b", "x"), ("serch", None)])
    delta = side([("a", "### Requirement: Other\n"), ("b", "x"), ("search", "y")])
    assert [(r.capability, r.dropped) for r in D.dropped_requirements(delta, canonical, ["capability"]).collect()] == [("a", ["One thing"])]
    assert {r.capability: r.action for r in D.sync_plan(delta, canonical, ["capability"]).collect()} == {"a": "updated", "b": "same", "search": "created"}
    assert [tuple(r) for r in D.near_capabilities(delta, canonical).collect()] == [("search", "serch", 1)]
    log = tmp_path / "log.jsonl"
    log.write_text('{"at":"t","file":"f","ruleIds":["a","b"]}\nbroken\n{"ruleIds":["b"]}\n')
    assert context_log(spark, str(log)).select(F.explode("ruleIds").alias("r")).distinct().count() == 2
