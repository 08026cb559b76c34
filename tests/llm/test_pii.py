"""Base spans by the rules' own patterns, and that chosen spans only add to them."""

import hashlib
import random
import re

from veritrace.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def plain(text):
    out = []
    for order, (kind, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{a}:{z}" for a, _, kind, z in sorted(out)]


def test_query(spark, tmp_path):
    r = random.Random(11)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "+39 (055) 123-4567", "+1 2", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", " ", "  ", "é", "日", "-", ".", "+", "(", ")", "0", "77", "token=", "\n", "00000000000000", "a@b.c.d-e", "+4915112345678", "٣", "555-0100"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(400)] + [None, "", "9" * 3000, "+" + "1 " * 2000]
    rows = list(enumerate(texts)) + [(None, "a@b.cc"), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS kinds", "1 AS n_ip").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op10_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    seen = 0
    for i, t in rows:
        base = plain(t or "")
        seen += len(base)
        x = by[i]
        assert x["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (t, base, x["spans"])
        assert [x[f"n_{k}"] for k in RULES] == [sum(b.startswith(k + ":") for b in base) for k in RULES]
        every = x["spans"].split(",") if x["spans"] else []
        assert set(base) <= set(every)
    assert seen > 200


def test_redaction_keeps_all_else():
    model = pii.trained()
    text = "write to a.b@c.de or 10.0.0.1 today"
    assert pii.redact(text, pii.all_spans(text, model)) == "write to [EMAIL] or [IP] today"
    assert pii.all_spans("", model) == [] and pii.redact("x", []) == "x"
