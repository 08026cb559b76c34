"""Shards by the definition of rendezvous hashing, one key at a time."""

import hashlib
import math
import zlib
from collections import Counter

from veritrace.llm import sharding


def best(key, weights):
    scores = []
    for i, w in enumerate(weights):
        if w > 0:
            u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            scores.append((w / -math.log(u), -i))
    return -max(scores)[1]


def test_query(spark, tmp_path):
    rows = [(i, f"text {i % 40}" * (i % 7)) for i in range(600)] + [(None, "x"), (None, None), (5, "text 5"), (5, "text 5"), (700, "é日"), (701, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'a' AS slot", "0 AS law").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in sharding.op1_sharding(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in raw)
    for r in got:
        key = "\0null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["law"], r["shard"], r["grown_shard"]) == ("key", best(key, [1.0] * 8), best(key, [1.0] * 9))
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weights(spark):
    df = spark.range(6000).selectExpr("id AS k")
    got = Counter()
    for r in sharding.assign(df, "k", [1.0, 0.0, 2.0, 3.0]).collect():
        assert r["shard"] == best(r["k"], [1.0, 0.0, 2.0, 3.0])
        got[r["shard"]] += 1
    assert got[1] == 0 and abs(got[2] / 6000 - 1 / 3) < 0.03 and abs(got[3] / 6000 - 1 / 2) < 0.03
