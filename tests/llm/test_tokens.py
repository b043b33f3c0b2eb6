import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm.bpe import SPLIT, Decoder, Encoder, byte_chars, model_bytes, read_ranks
from strataline.llm.packing import fit, pack, pack_corpus, patterns
from strataline.llm.tokens import VOCABULARY, decode_corpus, encode_corpus, token_counts
from strataline.session import table, tokenizer_path

TOKENS = read_ranks(tokenizer_path(VOCABULARY))
MODEL = model_bytes(TOKENS)
OWN = Encoder(MODEL)
PUBLIC = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\r\n'sdtab1=-_.<|>é漢🚀​ "), st.characters(max_codepoint=0x24FF, exclude_categories=["Cs", "Cn"])), max_size=60))
def test_same_ids_as_the_public_encoder(text):
    assert OWN.encode(text).tolist() == PUBLIC.encode_ordinary(text)
    assert Decoder(MODEL).decode(OWN.encode(text).tolist()) == text


def test_odd_texts():
    for text in ("<|endoftext|>", "a" * 20_000, " " * 5_000 + "x", "ab" * 3_000 + "\n\n\n"):
        assert OWN.encode(text).tolist() == PUBLIC.encode_ordinary(text)
        assert OWN.count(text) == len(PUBLIC.encode_ordinary(text))
    assert OWN.encode(None).tolist() == [] == OWN.encode("").tolist() and OWN.count(None) == 0
    assert len(set(byte_chars())) == 256


def test_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {r.doc_id: r.ids for r in encode_corpus(docs, "doc_id", "text").collect()}
    assert {k: list(v) for k, v in ids.items()} == {k: PUBLIC.encode_ordinary(t or "") for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, "doc_id", "text").collect()} == {k: len(v) for k, v in ids.items()}
    back = decode_corpus(encode_corpus(docs, "doc_id", "text"), "doc_id")
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in texts.items()}


def test_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a", "x"), ("k", None, "x"), ("k", "", "x"), ("k", "a", "x")], "k string, text string, ids string")
    assert sorted(map(str, encode_corpus(df, "k", "text").toDF("k", "v").collect())) == sorted(["Row(k=None, v=[64])", "Row(k='k', v=[])", "Row(k='k', v=[])", "Row(k='k', v=[64])"])
    assert encode_corpus(df.limit(0), "k", "text").count() == 0
    with pytest.raises(ValueError):
        encode_corpus(df, "ids", "text")


def brute_fill(plan, hist, capacity):
    room, seen = {}, {}
    for length, a, b, base, each in plan.runs:
        for k in range(a, b):
            assert (length, k) not in seen
            seen[length, k] = 1
            c = base + (k - a) // each
            room[c] = room.get(c, 0) + length
    assert len(seen) == sum(hist) and all(hist[n] for n, _ in seen)
    assert max(room.values(), default=0) <= capacity and sorted(room) == list(range(plan.containers))
    return sum(i * h for i, h in enumerate(hist)), plan.containers


@pytest.mark.parametrize("capacity", [7, 64, 700])
def test_pack_is_whole_and_tight(capacity):
    import numpy as np

    r = np.random.default_rng(capacity)
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, np.minimum(1 + (r.exponential(capacity / 5, 4000)).astype(int), capacity), 1)
    used, n = brute_fill(pack(hist, capacity), hist, capacity)
    assert used / (n * capacity) > 0.97


def test_pack_hard_cases():
    import numpy as np

    for lengths, capacity in (([], 5), ([5] * 3, 5), ([3] * 4, 5), ([1] * 11, 4), ([4, 4, 2, 2, 1], 6), ([1], 1)):
        hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64) if lengths else np.zeros(capacity + 1, np.int64)
        brute_fill(pack(hist, capacity), hist, capacity)


def test_patterns_and_fit():
    import numpy as np

    has = np.ones(13, bool)
    pats = patterns(12, has)
    assert ((pats[:, :3] * pats[:, 3:]).sum(1) == 12).all() and len(pats) > 15
    hist = np.zeros(13)
    hist[[4, 8]] = 30, 30
    pats = patterns(12, hist > 0)
    x = fit(pats, hist)
    assert (x >= 0).all()
    total = sum(x[i] * np.bincount(p[:3], p[3:], minlength=13) for i, p in enumerate(pats))
    assert abs(total[8] - 30) < 0.5 and abs(total[4] - 30) < 0.5


def test_pack_corpus(spark):
    sizes = [(i, n, "c") for i, n in enumerate([0, None, 3, 10, 10, 11, 25, 30, 1, 1, 9])] + [(4, 10, "c")]
    kinds = spark.createDataFrame([("s", 10, 1), ("s", 10, 1), ("l", 16, 1), ("none", None, 1), ("zero", 0, 1), (None, 12, 1)], "container_kind string, capacity long, n_tokens int")
    rows = pack_corpus(spark.createDataFrame(sizes, "doc long, n_tokens long, container_no string"), kinds, "doc").collect()
    for kind, cap in (("s", 10), ("l", 16), (None, 12)):
        mine = [r for r in rows if r.container_kind == kind]
        fill, pieces = {}, {}
        for r in mine:
            fill[r.container_no] = fill.get(r.container_no, 0) + r.n_tokens
            pieces.setdefault(r.doc, []).append((r.piece_no, r.start_token, r.n_tokens))
        assert max(fill.values()) <= cap
        for i, n, _ in sizes:
            got = sorted(pieces[i])
            if i == 4:
                assert sum(p[2] for p in got) == 20
                continue
            assert sum(p[2] for p in got) == (n or 0)
            assert len(got) == 1 if (n or 0) <= cap else [p[1] for p in got] == [cap * k for k in range(len(got))]
        assert sorted(fill) == list(range(len(fill)))
    assert {r.container_kind for r in rows} == {"s", "l", None}
    assert pack_corpus(spark.createDataFrame([], "doc long, n_tokens long"), kinds, "doc").count() == 0
