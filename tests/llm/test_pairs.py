"""Co-occurrence, neighbours, spans and file kinds against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from strataline.llm import neighbours as N
from strataline.llm import spans as S
from strataline.llm.cooccurrence import associated_pairs
from strataline.llm.handwritten import classify_files, edited_copies
from strataline.llm.neighbours import VectorIndex, p2_found
from strataline.llm.quantiser import BOOKS, Quantiser, may_reach
from strataline.operators.references import salted_join
from strataline.session import table


@pytest.mark.parametrize("chunk", [3, 128])
def test_pairs_of_huge_and_small_baskets(spark, chunk):
    r = random.Random(1)
    rows = [("r", "huge", f"i{k:02}") for k in range(40)] + [("r", f"b{r.randint(0, 30)}", f"i{r.randint(0, 50):02}") for _ in range(300)] + [("q", "huge", "i01"), (None, "x", "i01"), ("r", None, "i01"), ("r", "x", None)]
    df = spark.createDataFrame([(*t, "j") for t in rows], "s string, k string, i string, a string")
    baskets = {}
    for s, k, i in rows:
        if None not in (s, k, i):
            baskets.setdefault((s, k), set()).add(i)
    n, ab = Counter(), Counter()
    for (s, _), items in baskets.items():
        n.update((s, i) for i in items)
        ab.update((s, *p) for p in combinations(sorted(items), 2))
    total = Counter(s for s, _ in baskets)
    for least, lift in ((1, None), (2, 1.5)):
        got = {(x.s, x.a, x.b): (x.n_ab, x.n_a, x.n_b, x.n_baskets) for x in associated_pairs(df, "s", "k", "i", least, lift, chunk).collect()}
        want = {(s, a, b): (c, n[s, a], n[s, b], total[s]) for (s, a, b), c in ab.items() if c >= least and (lift is None or c * total[s] >= lift * n[s, a] * n[s, b])}
        assert got == want
    assert associated_pairs(df.limit(0), "s", "k", "i").count() == 0


def test_pairs_with_all_keys_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("strataline.llm.cooccurrence.salted_join", lambda *a: salted_join(*a, rows_per_task=3))
    rows = [("r" if i % 3 else "q", i % 37, f"i{i % k:02}") for i in range(400) for k in (1, 5, 11)]
    df = spark.createDataFrame(rows, "s string, k long, i string")
    got = {(x.s, x.a, x.b): (x.n_ab, x.n_a, x.n_b, x.n_baskets) for x in associated_pairs(df, "s", "k", "i").collect()}
    monkeypatch.undo()
    assert got == {(x.s, x.a, x.b): (x.n_ab, x.n_a, x.n_b, x.n_baskets) for x in associated_pairs(df, "s", "k", "i").collect()} and len(got) > 50


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_quantiser_scores_are_sums_of_words():
    r = np.random.default_rng(3)
    x = unit(r.normal(size=(600, 16))).astype(np.float32)
    q = Quantiser.train(x, 8)
    cell, codes, norms = q.encode(x)
    near = q.coarse[cell] + sum(q.books[b][codes[:, b]] for b in range(BOOKS))
    assert np.allclose(np.linalg.norm(near, axis=1), norms, atol=1e-4)
    got = q.scores(q.tables(x[:5]), q.coarse[cell] @ x[:5].T, codes, norms)
    assert np.allclose(got.T, x[:5] @ near.T / norms, atol=1e-4)
    assert np.linalg.norm(x - near, axis=1).mean() < 0.6


def vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(150, 8))
    close = base[:40] + r.normal(size=(40, 8)) * 0.1
    rows = [(i, "m", 8, v.tolist()) for i, v in enumerate(np.concatenate([base, close]))]
    rows += [(500 + i, "m", 8, base[0].tolist()) for i in range(9)]  # more equal ones than k
    rows += [(600, "m", 8, (base[1] * 7).tolist()), (3, "m", 8, rows[3][3]), (3, "n", 8, rows[4][3]), (7, "n", 8, rows[4][3])]
    rows += [(700, "m", 8, None), (701, "m", 8, [1.0] * 7), (702, "m", 8, [0.0] * 8), (703, "m", 8, [float("nan")] * 8), (704, "m", 8, [float("inf")] + [0.0] * 7), (None, "m", 8, [1.0] * 8)]
    return rows, spark.createDataFrame([(*t, "c") for t in rows], "node_id long, model string, dim int, vec array<float>, cls string")


def test_neighbours_against_brute_force(spark):
    rows, df = vectors(spark)
    good = {(m, i): np.array(v, np.float32).astype(float) for i, m, d, v in rows if i is not None and v is not None and len(v) == d and np.isfinite(v).all() and any(v)}
    want, lists = set(), {}
    for m in ("m", "n"):
        ids = sorted(i for g, i in good if g == m)
        x = unit(np.stack([good[m, i] for i in ids]))
        sim = np.round(x @ x.T, 9)
        for a, i in enumerate(ids):
            best = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-sim[a, b], ids[b]))[:5]
            lists[m, i] = [round(sim[a, b], 5) for b in best]
            want |= {(m, min(i, ids[b]), max(i, ids[b])) for b in best if sim[a, b] >= 0.9}
    index = VectorIndex(df)
    got = {(r.model, min(r.node_id, r.other_id), max(r.node_id, r.other_id)) for r in index.neighbours(5, 0.9).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)
    found = {}
    for r in index.neighbours(5, everywhere=True).orderBy("node_id", "rank").collect():
        found.setdefault((r.model, r.node_id), []).append(round(r.cosine, 5))
    hits = sum(sum((Counter(found.get(k, [])) & Counter(v)).values()) for k, v in lists.items())
    assert hits / sum(map(len, lists.values())) >= 0.95
    assert index.neighbours(5, every=50).select("node_id").distinct().filter("node_id % 50 <> 0").count() == 0
    assert VectorIndex(df.limit(0)).neighbours(5).count() == 0


def test_neighbours_in_a_hot_group_of_near_copies(spark):
    r = np.random.default_rng(9)
    centre = unit(r.normal(size=(1, 32)))
    x = np.concatenate([unit(r.normal(size=(4000, 32))), unit(centre + 0.2 * r.normal(size=(2000, 32)) / np.sqrt(32))]).astype(np.float32)
    sim = unit(x.astype(float)) @ unit(x.astype(float)).T
    np.fill_diagonal(sim, -2)
    want = {(i, j) for i, row in enumerate(sim) for j in np.argsort(-row)[:5].tolist() if row[j] >= 0.9}
    df = spark.createDataFrame([(i, "m", 32, v.tolist()) for i, v in enumerate(x)], "node_id long, model string, dim int, vec array<float>")
    got = {(n.node_id, n.other_id) for n in VectorIndex(df).neighbours(5, 0.9).collect()}
    assert len(want) >= 10_000 and len(got & want) >= 0.99 * len(want)


def test_bound_leaves_no_near_member_out():
    r = np.random.default_rng(5)
    x = unit(np.concatenate([r.normal(size=(500, 16)), r.normal(size=16) + 0.2 * r.normal(size=(500, 16))]))
    q = Quantiser.train(x.astype(np.float32), 4)
    cell, codes, norms = q.encode(x.astype(np.float32))
    small = x[::7].astype(np.float32)
    scores = q.scores(q.tables(small), q.coarse[cell] @ small.T, codes, norms)
    for goal in (-0.9, -0.2, 0.3, 0.9, 0.99):
        kept = may_reach(scores, norms, q.fits(x, cell, codes), np.full(len(small), goal))
        assert kept[x @ x[::7].T >= goal].all() and (goal < 0.9 or not kept.all())


@pytest.mark.parametrize("deep", [1, 2])
def test_deep_cells_split_coarse_ones(deep):
    r = np.random.default_rng(6)
    x = unit(r.normal(size=(900, 12))).astype(np.float32)
    q = Quantiser.train(x, 4, deep)
    cell, codes, norms = q.encode(x)
    assert (q.centre_of(cell) == Quantiser(q.coarse, q.books).encode(x)[0]).all() and len(np.unique(cell)) > 100
    probes = q.probes(x[:50], 24)
    assert all(len(set(p)) == 24 for p in probes.tolist()) and np.mean([c in p for c, p in zip(cell, probes.tolist())]) > 0.95


def test_index_of_deep_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_COARSE", 2)
    monkeypatch.setattr(N, "CELL", 40)
    monkeypatch.setattr(N, "SENT_CELLS", 0)  # the table of cells is joined, not sent
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(500, 16)), r.normal(size=(100, 16)).repeat(15, axis=0) + 0.3 * r.normal(size=(1500, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, "m", 16, v.tolist()) for i, v in enumerate(x)], "node_id long, model string, dim int, vec array<float>")
    got = N.recall(N.VectorIndex(df), 5, 1).collect()
    assert got[0].n_wanted == 10_000 and got[0].recall >= 0.9


def test_recall_on_the_data(spark, sf_dir):
    groups = {}
    for r in table(spark, sf_dir, "node_embeddings").collect():
        if r.vec is not None and len(r.vec) == r.dim and np.isfinite(r.vec).all() and any(r.vec):
            groups.setdefault((r.model, r.dim), {})[r.node_id] = np.array(r.vec)
    want = set()
    for g in groups.values():
        ids = sorted(g)
        x = unit(np.stack([g[i] for i in ids]))
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        for a, i in enumerate(ids):
            want |= {(min(i, ids[b]), max(i, ids[b])) for b in np.argsort(-sim[a], kind="stable")[:5] if sim[a, b] >= 0.9}
    got = {tuple(r) for r in p2_found(spark, sf_dir).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got) + 1


def texts():
    r = random.Random(9)
    words = lambda n: "".join(r.choice("abcdefgh ,.\nxyzé漢") for _ in range(n))
    shared = words(260)
    docs = [words(r.randint(0, 900)) for _ in range(30)]
    docs += [words(150) + shared + words(100), shared, words(10) + shared[:200], shared[60:260] + words(50), words(40) + shared[:199] + words(40)]
    docs += ["-" * 700, words(50) + "-" * 230 + words(50), "ab" * 300, words(30) + "ab" * 120 + words(20), docs[3] * 1, docs[30], None, "", " " * 400, shared[:100] * 4, words(20) + shared[:100] * 3]
    return docs


def brute_pairs(docs, k):
    where = {}
    for i, t in enumerate(docs):
        for p in range(len(t or "") - k + 1):
            where.setdefault(t[p : p + k], {}).setdefault(i, []).append(p)
    pairs, covered = set(), {}
    for at in where.values():
        pairs |= set(combinations(sorted(at), 2))
        if len(at) > 1:
            for i, places in at.items():
                covered.setdefault(i, set()).update(c for p in places for c in range(p, p + k))
    return pairs, {i: len(c) for i, c in covered.items()}


@pytest.mark.parametrize("few", [64, 1])
def test_spans_against_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(S, "FEW", few)
    docs = texts()
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)] + [(2, docs[2], "c")], "doc_id long, text string, cls string")
    pairs, covered = brute_pairs(docs, 200)
    spans = S.SharedSpans(df.dropDuplicates(["doc_id"]), "doc_id", "text")
    assert {tuple(r) for r in spans.pairs().collect()} == pairs
    got = {r.doc_id: r for r in spans.report().collect()}
    assert {i: r.shared_chars for i, r in got.items() if r.shared_chars} == covered and len(got) == len(docs)
    assert got[docs.index(None)].n_chars == 0 and got[docs.index(None)].shared == 0
    classes = {r.doc_id: (r["class"], r.n_copies, r.n_links) for r in spans.classes().collect()}
    assert classes[40][:2] == (30, 2)
    assert S.SharedSpans(df.limit(0), "doc_id", "text").pairs().count() == 0
    later = {}
    for i, t in enumerate(docs):
        for p in range(len(t or "") - 199):
            if any(t[p : p + 200] in (u or "") for u in docs[:i]):
                later.setdefault(i, set()).update(range(p, p + 200))
    kept = {x.doc_id: x.kept for x in S.remove_repeated(df.dropDuplicates(["doc_id"]), "doc_id", "text").collect()}
    assert kept == {i: t if t is None else "".join(c for k, c in enumerate(t) if k not in later.get(i, ())) for i, t in enumerate(docs)}


def test_spans_when_hashes_of_passages_clash(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 1)
    monkeypatch.setattr(S, "_passages", clashing)
    docs = texts()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {tuple(r) for r in S.SharedSpans(df, "doc_id", "text").pairs().collect()} == brute_pairs(docs, 200)[0]


PASSAGES = S._passages


def clashing(n):
    """As _passages, but with hashes of two bits."""
    plain = PASSAGES(n)

    def work(batches):
        for b in plain(batches):
            yield b.set_column(b.schema.get_field_index("passage"), "passage", S.pa.array(b["passage"].to_numpy() & 3))

    return work


def test_long_text_in_stretches(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("abcdef \n") for _ in range(30_000))
    whole = S.runs_of(S._chars(text), 200)
    monkeypatch.setattr(S, "STRETCH", 1_000)
    parts = S.runs_of(S._chars(text), 200)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_removal_keeps_the_first(spark):
    r = random.Random(8)
    body = "".join(r.choice("abcdefgh .") for _ in range(3000))
    df = spark.createDataFrame([(1, body), (2, "x" + body), (3, None), (4, "short")], "doc_id long, text string")
    kept = {x.doc_id: x.kept for x in S.remove_repeated(df, "doc_id", "text").collect()}
    assert kept[1] == body and len(kept[2]) < 300 and kept[3] is None and kept[4] == "short"


HAND = "import { a } from './b.js';\nexport function walkTree(node, depth) {\n  if (depth > 4) return null;\n  for (const child of node.children) visit(child, depth + 1);\n}\n"


def kinds(spark, rows, third=()):
    files = spark.createDataFrame([(i, p, h, rp, "x") for i, p, h, rp, *_ in rows], "id long, path string, hash string, repo string, label string")
    heads = spark.createDataFrame([(r[0], r[5] if len(r) > 5 else 900, r[6] if len(r) > 6 else 30, r[4]) for r in rows if r[4] is not None], "file_id long, n_bytes long, n_lines int, head string")
    tp = spark.createDataFrame(list(third), "package string, version string, file_name string, hash string")
    return {r.file_id: r.label for r in classify_files(files, heads, tp).collect()}


def test_file_kinds(spark):
    packed = "!function(a,b){c=a||{},b.d=!0}(a,b);" * 15
    numbers = "X = [\n" + "  12345, 2345, 99, 4567, 31111, 8,\n" * 20
    rows = [
        (1, "src/a.ts", "h1", "r", HAND), (2, "src/b.ts", "h2", "r", "// Code generated by toolx. DO NOT EDIT.\n" + HAND), (3, "src/c.ts", "h3", "r", "// Drives the code generator; not itself generated.\n" + HAND),
        (4, "src/d.js", "h4", "r", packed, 90_000, 2), (5, "src/e.py", "h5", "r", numbers, 90_000, 900), (6, "x/y/util.js", "tp", "r", HAND), (7, "deps/known/util.js", "h7", "r", HAND),
        (8, "src/vendors/other.ts", "h8", "r", HAND), (9, "src/f.js", "h9", "r", "/* lib-x v1.2.3\n * Released under the Z Terms */\n" + HAND), (10, "src/g.ts", None, "r", None), (11, "lib/h.min.js", "h11", "r", None),
        (12, "src/i.ts", "h12", "r", "/* Copyright (c) 2024 the tree team. All rights reserved. */\n" + HAND), (13, "src/j.pb2.py", "h13", "r", HAND), (14, "src/k.ts", "h14", "r", "".join(f"  getA{i:03}() {{ return this.f[{i}]; }}\n" for i in range(12))),
        (15, "src\\l.ts", "h15", "r", "const T = [1, 2, 3, 4];\n" + HAND), (1, "src/a.ts", "h1", "r", None), (16, "src/m.ts", "h16", "r", "", None, None), (17, None, None, None, None),
    ]
    got = kinds(spark, rows, [("known", "1", "util.js", "tp")])
    assert got == {1: "handwritten", 2: "generated", 3: "handwritten", 4: "minified", 5: "data", 6: "vendored", 7: "vendored", 8: "handwritten", 9: "vendored", 10: "handwritten", 11: "minified", 12: "handwritten", 13: "generated", 14: "generated", 15: "handwritten", 16: "handwritten", 17: "handwritten"}
    assert kinds(spark, rows[:1]) == {1: "handwritten"}


def test_notes_of_known_copies(spark):
    third = [("lib-x", "1.2", "util.js", "tp"), ("quux", "3.4.5", "a.js", "none")]
    note = "/*\n * lib-x, as we got it {}\n */\n"
    rows = [
        (1, "deps/x/u.js", "tp", "r", note.format("in May") + HAND), (2, "src/own.js", "e1", "q", "// lib-x, as we got it in May\n" + HAND + "foo(bar, baz, 1);\n"),
        (3, "src/same.js", "e2", "r", "// lib-x, as we got it in May\n" + HAND), (4, "src/other.js", "e3", "q", note.format("in June") + HAND), (5, "src/c.js", "e4", "q", "# built on quux 3.4.5 and changed\n" + HAND),
        (6, "src/d.js", "e5", "q", "# quux 3.4.6 would be needed here\n" + HAND), (7, "src/e.js", "e6", None, note.format("in May") + HAND),
    ]
    for i, r in enumerate(rows):  # no two bodies are alike
        rows[i] = (*r[:4], r[4].replace("node", f"node{i}").replace("child", f"c{i}").replace("b.js", f"b{i}.js"))
    assert kinds(spark, rows, third) == {1: "vendored", 2: "vendored", 3: "handwritten", 4: "handwritten", 5: "vendored", 6: "handwritten", 7: "handwritten"}


def test_very_long_heads(spark):
    rows = [(1, "a.py", "1", "r", "# word\n" * 30_000 + HAND), (2, "b.js", "2", "r", "/* x */\n" * 30_000), (3, "c.js", "3", "r", "[" * 100_000), (4, "d.js", "4", "r", "/* open " * 20_000), (5, "e.py", "5", "r", "\n" * 50_000)]
    assert kinds(spark, rows)[1] == "handwritten" and len(kinds(spark, rows)) == 5


def test_edited_copy_in_another_repository(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9)))
    lines = [f"const {word()} = {word()}({word()}, {word()});" for _ in range(12)]
    edited = lines[:5] + ["const inserted = patched(here, now);"] + lines[6:]
    own = [f"let {word()} = {word()}({word()});" for _ in range(12)]
    rows = [(1, "a/x.js", "1", "r1", "\n".join(lines)), (2, "b/y.js", "2", "r2", "\n".join(edited)), (3, "c/z.js", "3", "r3", "\n".join(own)), (4, "d/w.js", "4", "r3", "\n".join(own[:6] + lines[:1] + own[7:]))]
    assert kinds(spark, rows) == {1: "vendored", 2: "vendored", 3: "handwritten", 4: "handwritten"}


def test_edited_copy_whose_lines_stand_in_other_files(spark):
    lines = [f"const shared{i:02} = compute(alpha, beta{i:02});" for i in range(8)]
    rows = [(1, "m", lines), (2, "n", lines[:4] + ["let inserted = patched(here);"] + lines[4:])]
    rows += [(10 + i, "a", [line, *(f"let aaa{i}{k} = own();" for k in range(9))]) for i, line in enumerate(lines)]
    rows += [(30 + i, "z", [line, *(f"let zzz{i}{k} = own();" for k in range(9))]) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "id long, repo string, lines array<string>")
    assert {r.id: r.copied_from for r in edited_copies(df).collect()} == {1: 2, 2: 1}


@pytest.mark.parametrize("block", [2_048, 3])
def test_edited_copies_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr("strataline.llm.handwritten.HOLDERS", block)
    r = random.Random(12)
    bags = [sorted(r.sample(range(30), r.randint(4, 14)), key=lambda k: r.random()) for _ in range(60)]
    rows = [(i, r.choice(["a", "b", "c", None]), [f"line number {k}" for k in r.choice(bags)]) for i in range(150)]
    held = {i: (repo, set(lines)) for i, repo, lines in rows if repo}
    want = {}
    for i, (repo, bag) in held.items():
        found = [len(bag & other) for k, (at, other) in held.items() if at != repo and len(bag & other) >= max(4, len(bag) / 2)]
        if found:
            want[i] = max(found)
    got = {x.id: x.copied_from for x in edited_copies(spark.createDataFrame(rows, "id long, repo string, lines array<string>")).collect()}
    assert {i: len(held[i][1] & held[k][1]) for i, k in got.items()} == want and all(held[i][0] != held[k][0] for i, k in got.items())
