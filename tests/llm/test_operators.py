"""Odd rows (null, empty, repeated, extra columns, no rows) and brute-force comparisons on small fixtures."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from veritrace.llm import bpe, pii, registry, simhash, suffix_array

LONG = "the quick brown fox jumps over the lazy dog and runs far away from here while rain falls on old grey stones near water " * 3
ROWS = [
    (0, LONG + "mail a.b@c.de or +39 055 1234567 now", "en", "s", 1), (0, LONG + "mail a.b@c.de or +39 055 1234567 now", "en", "s", 1),
    (1, None, "en", None, None), (2, "", None, "s", 0), (None, LONG + "x", "fr", "s", 3), (3, "Ünï <|endoftext|> 日本 \n\n a", "xx", "s", 9),
    (4, " ".join(f"word{i}" for i in range(400)) + "\nReleased under the MIT License.", "en", "s", 9), (5, "a" * 5000, "en", "s", 5000),
]


@pytest.fixture(scope="module", params=["odd", "none"])
def folder(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(request.param))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS shard", "'x' AS fp", "2 AS n_words")
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(5, 25))), (2, None), (3, "日本")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (2, None), (2, None), (3, "x")], "page_id long, url string").selectExpr("*", "'h' AS html", "'y' AS host")
    for name, df in (("documents", docs), ("benchmark", bench), ("pages", pages)):
        (df.limit(0) if request.param == "none" else df).write.parquet(f"{d}/{name}.parquet")
    return request.param, d


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows(spark, folder, name):
    kind, d = folder
    rows = registry.QUERIES[name](spark, d).collect()
    assert len(rows) == (0 if kind == "none" else 4 if "url" in name else len(ROWS))


def test_pipeline(spark, folder):
    import corpus_pipeline

    kind, d = folder
    rows = corpus_pipeline.run(spark, d).collect()
    assert [r["doc_id"] for r in rows] == []  # null, short, repeating and contaminated texts all go


def test_bpe_is_the_librarys():
    from tokenizers import Tokenizer

    ours, theirs = bpe.Bpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    texts = [r[1] or "" for r in ROWS] + ["It's  a\ttest\n\n 12ab <|endoftext|><|endoftext|>!", "\x1c\x85 é　x"]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode(t, add_special_tokens=False).ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == t


@pytest.mark.parametrize("together", [7, 1 << 16])
def test_trie_pairs(monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    r = np.random.default_rng(5)
    a = np.unique(np.concatenate([r.integers(0, 2**64, 300, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    i, j = simhash.trie_pairs(a, a, 2, True)
    near = np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2, 1)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_suffix_array_and_shards(monkeypatch):
    data = np.frombuffer(b"banana\xffbandana\xff\x00\x00", np.uint8)
    raw = data.tobytes()
    order = suffix_array.suffix_array(data)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    monkeypatch.setattr(suffix_array, "SHARD", 700)
    r = np.random.default_rng(1)
    common = bytes(r.integers(97, 123, 260, dtype=np.uint8))
    bodies = [bytes(r.integers(97, 123, k, dtype=np.uint8)) + common + bytes(r.integers(97, 123, 9, dtype=np.uint8)) for k in (5, 50, 130, 70)]
    windows = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    got = {(row, s) for row, a, z, _ in suffix_array.shard_repeats(iter([(1, False, b) for b in bodies])) for s in range(a, z + 1)}
    assert got == {(k, i) for k, b in enumerate(bodies) for i in range(len(b) - 199) if windows[b[i : i + 200]] > 1}


def test_slices_hold_every_start_once(monkeypatch):
    r = np.random.default_rng(2)
    raw = [bytes(r.integers(97, 99, n, dtype=np.uint8)) for n in (0, 199, 200, 1499, 1699, 1700, 5000)] + [b"=" * 4000]
    whole = [(o, a + k, n) for o, a, c, n, *_ in suffix_array._described(list(range(8)), raw) for o, a, c, n in zip(o, a, c, n, strict=True) for k in range(c)]
    monkeypatch.setattr(suffix_array, "SLICE", 1500)
    parts = list(suffix_array._described(list(range(8)), raw))
    sliced = [(o, a + k, n) for o, a, c, n, *_ in parts for o, a, c, n in zip(o, a, c, n, strict=True) for k in range(c)]
    assert sorted(whole) == sorted(sliced) and len(parts) > 3
    for owner, start, count, *_, cut in parts:
        assert all(cut(k) == raw[owner[k]][start[k] : start[k] + count[k] + 199] for k in range(len(owner)))


def removed(raw):
    """(bytes, bytes removed, digest of the rest) of each byte string, by counting all its 200-byte strings."""
    windows = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if windows[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        want.append((len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(want)


def test_removal_by_brute_force(spark, folder):
    kind, d = folder
    if kind == "none":
        return
    got = registry.QUERIES["op9_suffix_array"](spark, d).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == removed([(r[1] or "").encode() for r in ROWS])


@pytest.mark.parametrize("shard", [2000, 60_000])
def test_names_of_many_shards(spark, monkeypatch, tmp_path, shard):
    """One passage in many different texts, some of which have a neighbour in common, and texts longer than a slice."""
    monkeypatch.setattr(suffix_array, "SHARD", shard)
    r = np.random.default_rng(4)

    def some(n):
        return bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()

    passage, ends = some(150), [some(60) for _ in range(6)]
    texts = [some(int(r.integers(0, 90))) + passage + ends[int(r.integers(0, 6))][: int(r.integers(0, 60))] + some(30) for _ in range(150)]
    texts += ["=" * 5000, "ab" * 2500, some(4000) + texts[0] + some(700), "é" * 99, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_array.op9_suffix_array(spark, str(tmp_path)).collect()
    want = removed([(t or "").encode() for t in texts])
    assert sum(w[1] for w in want) > 10_000
    assert sorted((x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in got) == want


def test_personal_data():
    model = pii.trained()
    x, y = pii.examples(800, 99)
    chosen = model.probability(x) >= np.array([model.threshold[k] for k in pii.KINDS])[x[:, 0].astype(int)]
    assert y[chosen].mean() > 0.97
    text = 'write a.b@c.de, 10.0.0.1 or token = "7c72db563d7f6e50cec00950f7bab1f2223b6afd"'
    assert [s[0] for s in pii.all_spans(text, model)] == ["email", "ip", "secret"]
    assert "[EMAIL]" in pii.redact(text, pii.all_spans(text, model))


def test_bpe_query(spark, folder):
    from tokenizers import Tokenizer

    kind, d = folder
    if kind == "none":
        return
    theirs = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in ROWS:
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = registry.QUERIES["op4_bpe"](spark, d).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_bpe_forgets(spark):
    docs = spark.createDataFrame([(i, f"some words {i} and more, again") for i in range(40)] + [(99, None)], "doc_id long, text string").repartition(8)
    kept, gone = (sorted(map(tuple, bpe.encode(docs, decoded=True, forget=f).collect())) for f in (False, True))
    assert kept == gone and len(gone) == 41


def test_decontaminate_query(spark, folder):
    kind, d = folder
    if kind == "none":
        return
    got = {r["doc_id"]: r for r in registry.QUERIES["op5_decontaminate"](spark, d).collect()}
    one = hashlib.sha256(b"1").hexdigest()
    assert (got[4]["n_hit"], got[4]["n_items"], got[4]["items_sha256"], got[4]["contaminated"]) == (20, 1, one, True)
    assert (got[3]["n_hit"], got[3]["n_items"], got[3]["items_sha256"]) == (1, 1, hashlib.sha256(b"3").hexdigest())
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items_sha256"], got[1]["contaminated"]) == (0, 0, hashlib.sha256(b"").hexdigest(), False)
