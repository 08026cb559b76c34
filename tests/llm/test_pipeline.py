"""The pipeline's rows against a plain Python run over the same documents."""

import random
import re

from tokenizers import Tokenizer

from veritrace.llm import bpe

LETTERS = "etaoinshrdlu"


def fixture(seed=21):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(LETTERS, k=r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    bench = [(i, text(14)) for i in range(4)] + [(9, None), (10, "et tu")]
    good = [text(r.randint(60, 200)) for _ in range(50)]
    near = []
    for t in good[:12]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        near += [" ".join(w), t]
    far = [" ".join(x if r.random() > 0.25 else "other" + str(r.randrange(99)) for x in t.split()) for t in good[12:16]]
    dirty = [text(40) + " " + bench[k][1].upper() + " " + text(40) for k in range(3)]
    private = [text(50) + f" mail {x} now " + text(20) for x in ("a.b@c.de", "10.1.2.3")]
    bad = [text(20), "", None, "ab cd ef " * 40, " ".join("".join(r.choices("#%&|$qxzwvkjyQXZWVKJY", k=25)) for _ in range(70))]
    texts = good + near + far + dirty + private + bad
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts)) + [(ids[0], texts[0])], bench, {ids[len(texts) - 1]}


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]


def survivors(docs, bench, noise):
    kept = []
    for i, t in docs:
        w = (t or "").split()
        windows = list(zip(w, w[1:], w[2:]))
        hit = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
        if len(w) >= 50 and 2 * len(hit) <= len(w) and i not in noise:
            kept.append((i, t))
    kept = sorted(set(kept))
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
    kept = [kept[k] for k in sorted(set(root))]  # rows are in order of doc_id, so a root is its group's smallest
    grams = set()
    for _, t in bench:
        w = words(t or "")
        grams |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    clean = []
    for i, t in kept:
        w = words(t)
        if not any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1)):
            clean.append((i, t))
    return {i: t.replace("a.b@c.de", "[EMAIL]").replace("10.1.2.3", "[IP]") for i, t in clean}


def test_rows(spark, tmp_path):
    import corpus_pipeline

    docs, bench, noise = fixture()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'q' AS _row_a", "2 AS sig", "'z' AS _id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = survivors(docs, bench, noise)
    theirs = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(want) > 40 and sorted(got) == sorted(want)
    assert any("[EMAIL]" in t for t in want.values()) and any("[IP]" in t for t in want.values())
    for i, t in want.items():
        assert got[i]["decoded"] == t and list(got[i]["ids"]) == theirs.encode(t, add_special_tokens=False).ids and got[i]["n_tokens"] == len(got[i]["ids"])


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    docs, bench, _ = fixture(5)
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'q' AS _row_a", "map('k', doc_id) AS sig")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns and 0 < out.count() <= rows.count(), name
        assert out.where("_row_a <> 'q' OR sig['k'] <> doc_id").count() == 0
