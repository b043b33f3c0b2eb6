import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions.paths import GlobError, glob_error, glob_regex, in_scope, is_newer, relative_uri, target_path, under
from strataline.functions.text import LexicalEmbedder, embed_sparse, embed_texts, signature, tokenize
from strataline.functions.vectors import from_blob, to_blob
from strataline.operators.near_names import near_names
from strataline.operators.policy import check_actions, cite
from strataline.operators.rules import with_groups
from strataline.plans.verify import Report, exit_code, json_rows, markdown_rows, parse_fail_on, sarif_results, to_json, to_markdown, to_sarif, verify
from strataline.sources.rules import ManifestError, check_manifest, merge_rules, read_manifest, write_manifest


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


GLOBS = [
    ("src/**", "src/a/b.ts", True), ("src/**", "lib/a.ts", False), ("**/*.ts", "a.ts", True), ("**/*.ts", "x/y/a.ts", True), ("*.ts", "x/a.ts", False),
    ("a/?.js", "a/b.js", True), ("a/?.js", "a/bc.js", False), ("a/{b,c}/*.py", "a/c/x.py", True), ("a/[!b].py", "a/b.py", False), ("a/[bc].py", "a/b.py", True),
    ("a.b", "axb", False), ("a+(b)", "a+(b)", True), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("a\\b", "a\\b", True), ("a.ts", "a.ts\n", False),
]


def test_globs(spark):
    df = spark.createDataFrame([(p,) for _, p, _ in GLOBS], "p string")
    for pattern, path, want in GLOBS:
        assert df.filter(F.col("p") == path).select(F.col("p").rlike(glob_regex(pattern))).first()[0] is want, (pattern, path)
    for bad in ("a/{b", "a}", "a/[b"):
        assert glob_error(bad)
        with pytest.raises(GlobError):
            glob_regex(bad)


def test_scope_and_under(spark):
    f = lambda scope, p: one(spark, in_scope(F.lit(p), scope))
    assert f([], "x") and f(["!a/**"], "b/x") and not f(["!a/**"], "a/x") and f(["a/**", "!a/b/**"], "a/c") and not f(["a/**", "!a/b/**"], "a/b/c") and f(["a/{", "b"], "b")
    u = lambda roots, p: one(spark, under(F.lit(p), roots))
    assert u(None, "x") and u(["a/"], "a/b") and u(["a"], "a") and not u(["a"], "ab")


def test_scalars(spark):
    assert one(spark, tokenize(F.lit("parseHTTPServer_v2 x fooBar9Baz"))) == ["parse", "httpserver", "v2", "foo", "bar9", "baz"]
    assert one(spark, tokenize(F.lit(""))) == [] and one(spark, tokenize(F.lit(None).cast("string"))) is None
    assert one(spark, signature(F.lit("  def x():  \n  pass"))) == "def x():"
    assert len(one(spark, signature(F.lit("y" * 500)))) == 200
    assert one(spark, relative_uri(F.lit("C:\\a\\b"))) == "a/b" and one(spark, relative_uri(F.lit("//x/y"))) == "x/y"
    assert [one(spark, is_newer(F.lit(a), F.lit(b))) for a, b in (("1.10.0", "1.9.9"), ("1.0.0", "1.0.0"), ("2.0.0-rc.1", "1.9.0"), ("1.0", "1.0.1"))] == [True, False, True, False]
    assert one(spark, target_path(F.lit('{"tool_input":{"filePath":"./a"}}'))) == "a"
    assert one(spark, target_path(F.lit('{"path":"/p/q/x.ts"}'), "/p/q")) == "x.ts"
    assert one(spark, target_path(F.lit("not json"))) is None


def test_embedding_agrees_with_sparse(spark):
    texts = ["function mergeTokenBudget", "", "a b c", None, "x1 x1 yy"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    dense = {r.id: np.array(r.vec) for r in embed_texts(df, "id", "text").collect()}
    assert not dense[1].any() and not dense[3].any() and abs(np.linalg.norm(dense[0]) - 1) < 1e-6
    sparse = {i: np.zeros(256) for i in range(5)}
    for r in embed_sparse(df, "id", "text").collect():
        sparse[r.id][r.bucket] = r.weight
    for i in range(5):
        assert np.allclose(sparse[i], dense[i], atol=1e-6)
    assert np.allclose(LexicalEmbedder().embed("function mergeTokenBudget"), dense[0])


def test_blob_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>")
    rows = df.select("v", from_blob(to_blob("v")).alias("w"), F.octet_length(to_blob("v")).alias("n")).collect()
    assert [(r.v, r.w, r.n) for r in rows] == [([1.5, -2.0], [1.5, -2.0], 8), (None, None, None), ([], [], 0)]


def test_near_names(spark):
    a = spark.createDataFrame([("search",), ("serach",), ("serch",), (None,), ("",)], "n string")
    b = spark.createDataFrame([("search",), ("find",), ("ab",)], "n string")
    assert sorted(tuple(r) for r in near_names(a, b, "n").collect()) == [("", "ab", 2), ("serach", "search", 2), ("serch", "search", 1)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_near_names_of_any_length_and_script(spark, most, monkeypatch):
    monkeypatch.setattr("strataline.operators.near_names.SHORT", 9)
    r = random.Random(most)
    letters = "abéñ日𝒳_"
    goal = {"".join(r.choice(letters) for _ in range(n)) for n in range(1, 45) for _ in range(3)}
    lone = set()
    for s in goal:
        for _ in range(4):
            t = list(s)
            for _ in range(r.randint(1, most + 1)):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randint(0, 1)] = [r.choice(letters)] * r.randint(0, 1)
            lone.add("".join(t))
    want = sorted((a, b, d) for a in lone - goal for b in goal if abs(len(a) - len(b)) <= most and (d := edits(a, b)) <= most)
    a, b = (spark.createDataFrame([(s,) for s in sorted(x)], "n string") for x in (lone, goal))
    assert sorted(tuple(x) for x in near_names(a, b, "n", most).collect()) == want and max(len(a) for a, *_ in want) > 40


def test_near_names_of_a_very_long_name(spark):
    name = "ab" * 4_000
    a, b = spark.createDataFrame([(name[:10] + "é" + name[10:-1],)], "n string"), spark.createDataFrame([(name,)], "n string")
    assert [(r.distance, len(r.near)) for r in near_names(a, b, "n").collect()] == [(2, 8_000)]


def test_near_names_query_leaves_no_name_out(spark, tmp_path):
    from strataline.queries.text import j16_near_names_all

    node = [(1, "größenänderungsereignis_behandeln"), (2, "findAllOpenTransactionsOfCustomer"), (3, "load")]
    spark.createDataFrame(node, "id long, name string").write.parquet(str(tmp_path / "nodes.parquet"))
    edge = [(1, "größenänderungsereignis_behandel", "call"), (2, "findAllOpenTransactionOfCustomers", "call"), (3, "laod", "call"), (4, "lod", "import")]
    spark.createDataFrame(edge, "id long, dst_name string, kind string").write.parquet(str(tmp_path / "edges.parquet"))
    assert sorted((r.name[:4], r.distance) for r in j16_near_names_all(spark, str(tmp_path)).collect()) == [("find", 2), ("größ", 1), ("laod", 2)]


def law(kind="deps", severity="error", **rule):
    return {"id": f"{kind}-{len(rule)}-{severity}", "severity": severity, "scope": ["src/**"], "prose": "text", "enforcement": "block", "source": {"file": "R.md", "line": 4}, "verification": {"kind": kind, "rule": rule}}


def graph(spark, pairs, extra=()):
    paths = sorted({p for e in pairs for p in e} | set(extra))
    ids = {p: i for i, p in enumerate(paths)}
    files = spark.createDataFrame([(i, p, "h", "x", "r") for p, i in ids.items()], "id long, path string, hash string, lang string, repo string")
    nodes = spark.createDataFrame([(i, i, f"n{i}", "function", 1, 1, 0, 1, None, None) for i in ids.values()], "id long, file_id long, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, parent_id long, signature string")
    rows = [(k, ids[a], ids[a], f"n{ids[b]}", ids[b], "call", k + 1) for k, (a, b) in enumerate(pairs)]
    return files, nodes, spark.createDataFrame(rows, "id long, src_node_id long, src_file_id long, dst_name string, dst_node_id long, kind string, line int")


def test_groups_in_patterns(spark):
    assert one(spark, with_groups("^x/$1/$2/$0$", "^src/([^/]+)/", F.lit("src/a/b"))) == "^x/a//src/a/$"


def test_forbidden_required_verify(spark):
    files, nodes, edges = graph(spark, [("src/features/a/x.ts", "src/features/b/y.ts"), ("src/features/a/x.ts", "src/features/a/z.ts"), ("src/features/b/y.ts", "lib/q.ts")], ["src/features/c/lone.ts"])
    forbid = law(**{"from": "^src/features/([^/]+)/", "to": "^src/features/", "toNot": "^src/features/$1/"})
    need = law(severity="warn", **{"from": "^src/features/", "to": "^lib/", "type": "required"})
    fine = law(severity="info", **{"from": "^lib/", "to": "^src/"})
    bad = law(kind="graph", severity="info", circular=True)
    other = law(kind="path")
    report = verify(spark, [forbid, need, fine, bad, other], files, nodes, edges)
    assert {r.rule_id: r.status for r in report.statuses.collect()} == {forbid["id"]: "failed", need["id"]: "failed", fine["id"]: "passed", bad["id"]: "passed"}
    assert [(r.file, r.line, r.detail) for r in report.findings.filter("severity = 'error'").collect()] == [("src/features/a/x.ts", 1, "→ src/features/b/y.ts")]
    assert sorted(r.file for r in report.findings.filter("severity = 'warn'").collect()) == ["src/features/a/x.ts", "src/features/a/z.ts", "src/features/c/lone.ts"]
    assert report.summary().first().asDict() == {"evaluated": 4, "passed": 2, "failed": 2, "unknown": 0, "skipped": 0}
    assert exit_code(report) == 1 and exit_code(report, "error", True) == 1
    sarif = to_sarif(report, [forbid, need, fine, bad])
    assert len(sarif["runs"][0]["results"]) == 4 and sarif["runs"][0]["results"][0]["level"] == "error"
    assert "### Findings" in to_markdown(report)


def test_unknown_skipped_and_cycle(spark):
    files, nodes, edges = graph(spark, [("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts")])
    imports = edges.selectExpr("id + 100 as id", "src_node_id", "src_file_id", "'import x' as dst_name", "cast(null as long) as dst_node_id", "'import' as kind", "line")
    rule = law(**{"from": "^src/", "to": "^lib/", "edgeKinds": ["import"]})
    cycle = law(kind="graph", severity="warn", circular=True)
    report = verify(spark, [rule, cycle], files, nodes, edges.unionByName(imports))
    assert {r.rule_id: r.status for r in report.statuses.collect()} == {rule["id"]: "unknown", cycle["id"]: "failed"}
    assert [r.detail for r in report.findings.collect()] == ["cycle: src/a.ts → src/b.ts → src/a.ts (SCC size 2)"]
    none = verify(spark, [rule], None, None, None)
    assert [r.status for r in none.statuses.collect()] == ["skipped"] and exit_code(none, "error", True) == 4 and exit_code(none) == 0
    broken = verify(spark, [law(**{"from": "^(", "to": "x"})], files, nodes, edges)
    assert [r.status for r in broken.statuses.collect()] == ["skipped"]


def test_sarif_cap_keeps_errors(spark):
    rows = [("r", "info" if i < 10 else "error", "deps", "x", f"f{i}", i, "m", None) for i in range(15)]
    df = spark.createDataFrame(rows, "rule_id string, severity string, engine string, repo string, file string, line int, message string, detail string")
    kept = sarif_results(df, 7).collect()
    assert sum(r.level == "error" for r in kept) == 5 and len(kept) == 7
    assert Report(df, spark.createDataFrame([], "rule_id string, status string, detail string")).summary().first().evaluated == 0


def test_reports_hold_all_findings(spark):
    name = "rule_id string, severity string, engine string, repo string, file string, line int, message string, detail string"
    df = spark.range(5_010).selectExpr("'r' as rule_id", "if(id < 5005, 'info', 'error') as severity", "'deps' as engine", "'x' as repo", "concat('f', id) as file", "nullif(cast(id as int), 0) as line", "'m' as message", "cast(null as string) as detail")
    report = Report(df, spark.createDataFrame([("r", "failed", None)], "rule_id string, status string, detail string"))
    found = json.loads(to_json(report))["findings"]
    assert len({f["file"] for f in found}) == 5_010 and [f["severity"] for f in found[:6]] == ["error"] * 5 + ["info"] and set(found[0]) == {c.split()[0] for c in name.split(", ")}
    assert to_markdown(report).count("\n| `r` |") == 5_010 and "| `r` | info | `f0` |" in to_markdown(report)
    assert "5003 more findings are left out" in to_markdown(report, 7) and to_markdown(report, 7).count("| error |") == 5
    assert markdown_rows(df).count() == json_rows(df).count() == 5_010


def test_manifest(tmp_path):
    good = [law()]
    write_manifest(str(tmp_path / "m.json"), good)
    assert read_manifest(str(tmp_path / "m.json")) == good
    assert read_manifest(str(tmp_path / "none.json"), good) == good
    assert [r["id"] for r in merge_rules(good, [law(), {**law(), "id": "new"}])] == [good[0]["id"], "new"]
    for wrong in ({**law(), "severity": "x"}, {**law(), "scope": ["a{"]}, law(**{"from": "("}), law(**{"from": "(?=a)"})):
        with pytest.raises(ManifestError):
            check_manifest([wrong])
    assert [parse_fail_on(x) for x in (None, True, "warn", "bad")] == ["error", "error", "warn", None]


def test_actions(spark):
    rule = law(kind="path")
    df = spark.createDataFrame([("src/a", "PreToolUse"), ("src/a", "PostToolUse"), ("lib/a", "PreToolUse"), (None, "Stop")], "path string, event string")
    assert [r.verdict for r in check_actions(df, [rule]).collect()] == ["deny", "allow", "allow", "allow"]
    assert [r.diagnostic is None for r in check_actions(df, None).collect()] == [False] * 4
    assert cite(rule) == f"{rule['id']} (R.md:4): «text»"
