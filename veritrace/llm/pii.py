"""Personal data: rules give the base spans, boosted trees choose more from high-recall candidates."""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import map_rows, read

KINDS = ("email", "ip", "card", "phone", "secret")
#: Labelled examples that the trees are fitted and calibrated on; they are made, not read from the corpus.
EXAMPLES, SEED = 6000, 7
#: A kind's threshold is the lowest calibrated probability at which held-out precision reaches this.
PRECISION = 0.99
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[+0-9][0-9 ().+-]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOOSE_EMAIL = re.compile(r"[\w.+%-]{1,64} ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}){1,5}")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_VALUE = re.compile(r"[:=][ \t]*[\"']?([^\s\"']{6,})")
_NAMED = re.compile(r"(?:token|secret|passwo?r?d|passwd|pwd|api[_-]?key|access[_-]?key|key)[\"']?[ \t]*$")
_PARTS = re.compile(r" {2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by start, then kind as in KINDS. Per kind leftmost and not overlapping; a match that fails its check is dropped."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            found.append(("email", lo, end))
        at = text.find("@", at + 1)
    for part in _DIGITS.finditer(text):
        seg, off = part[0], part.start()
        if len(seg) < 7:
            continue
        if seg.count(".") >= 3:
            found += [("ip", off + m.start(), off + m.end()) for m in _IP.finditer(seg) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(seg):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", off + m.start(), off + m.end()))
        if "+" in seg:
            for m in _PHONE.finditer(seg):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", off + m.start(), off + m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that might be personal data, of high recall: they may overlap, and one place may have several kinds."""
    found = set()
    if "@" in text or "(at)" in text or "[at]" in text:
        found |= {("email", *m.span()) for m in _LOOSE_EMAIL.finditer(text)}
    if text.count(":") >= 4:
        found |= {("ip", *m.span()) for m in _IP6.finditer(text)}
    for part in _DIGITS.finditer(text):
        if len(part[0]) < 7:
            continue
        at = part.start()
        pieces = [(part[0], at)]
        if "  " in part[0]:
            lo = 0
            for gap in [*_PARTS.finditer(part[0]), None]:
                hi = gap.start() if gap else len(part[0])
                pieces.append((part[0][lo:hi], at + lo))
                lo = gap.end() if gap else hi
        for seg, off in pieces:
            hi = len(seg.rstrip(" ().+-"))
            n = sum(c.isdigit() for c in seg[:hi])
            if seg.count(".", 0, hi) == 3 and 4 <= n <= 12:
                found.add(("ip", off, off + hi))
            if 7 <= n <= 15:
                found.add(("phone", off, off + hi))
            if 12 <= n <= 19:
                found.add(("card", off, off + hi))
    at = 0
    for word in [w for w in text.split() if len(w) >= 20]:
        at = text.index(word, at)
        found |= {("secret", at + m.start(), at + m.end()) for m in _RUN.finditer(word)}
        at += len(word)
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            if _NAMED.search(text[max(0, m.start() - 24) : m.start()].lower()):
                found.add(("secret", *m.span(1)))
    return sorted(found, key=lambda s: (s[1], s[2], KINDS.index(s[0])))


_CUES = {
    "secret": ("token", "secret", "passw", "pwd", "key", "auth"), "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "card": ("card", "visa", "master", "amex", "credit", "pan"), "email": ("mail", "contact", "write", "from", "to"), "ip": ("ip", "host", "addr", "server", "from"),
}
_OTHER_CUES = ("order", "invoice", "isbn", "version", "commit", "sha", "uuid", "http", "ref", "no.", "id", "page", "date")


def features(text: str, kind: str, lo: int, hi: int) -> list[float]:
    """Format of the span and what stands around it."""
    s = text[lo:hi]
    n = hi - lo
    digits = "".join([c for c in s if "0" <= c <= "9"])
    before, after = text[max(0, lo - 24) : lo].lower(), text[hi : hi + 12].lower()
    counts: dict[str, int] = {}
    for c in s[:256]:
        counts[c] = counts.get(c, 0) + 1
    m = min(n, 256)
    entropy = -sum(v / m * math.log2(v / m) for v in counts.values())
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    return [
        float(KINDS.index(kind)), float(n), float(len(digits)), len(digits) / n, sum(c.isalpha() for c in s) / n, sum(c.isupper() for c in s) / n,
        sum(c in "0123456789abcdefABCDEF" for c in s) / n, entropy, float(bool(digits) and luhn(digits)), float(s.count(".")), float(s.count("-")),
        float(s.count(" ")), float(s.count("(")), float(s.startswith("+")), float(s.startswith("0")), float("@" in s), float(len(groups)),
        float(max(groups, default=0)), float(min(groups, default=0)), float(any(c in before for c in _CUES[kind])),
        float(any(c in before for c in _OTHER_CUES)), float(before[-1:] in "\"'=:"), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(after[:1] in "\"'"), float("=" in before[-4:] or ":" in before[-4:]), float(sum(len(g) == 4 for g in re.split(r"[ -]", s))),
        float(sum(len(p) <= 3 and p.isdigit() and int(p) <= 255 for p in s.split("."))), float(sum(a.isdigit() != b.isdigit() for a, b in zip(s[:64], s[1:64], strict=False))),
    ]


@dataclass
class Trees:
    """Gradient-boosted trees for a logistic loss, with a Platt scale and a threshold by kind."""

    trees: list[list[tuple[int, float, float]]]
    start: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: dict[str, float] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                column = np.array([n[0] for n in tree])[at]
                at = 2 * at + 1 + (x[np.arange(len(x)), column] > np.array([n[1] for n in tree])[at])
            out += np.array([n[2] for n in tree])[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Depth-limited trees on binned features, Newton leaf values, in full binary layout (feature, cut, value)."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rate = y.mean()
    model = Trees([], math.log(rate / (1 - rate)))
    f = np.full(len(y), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        tree: list[tuple[int, float, float]] = [(0, math.inf, 0.0)] * (2 ** (DEPTH + 1) - 1)
        rows = {0: np.arange(len(y))}
        for node in range(2**DEPTH - 1):
            r = rows[node]
            best = (1e-6, 0, math.inf)
            whole = g[r].sum() ** 2 / (h[r].sum() + 1)
            for j, cs in enumerate(cuts):
                if not len(cs):
                    continue
                k = np.searchsorted(cs, x[r, j], side="left")
                gl, hl = (np.cumsum(np.bincount(k, v[r], len(cs) + 1))[:-1] for v in (g, h))
                gain = gl**2 / (hl + 1) + (g[r].sum() - gl) ** 2 / (h[r].sum() - hl + 1) - whole
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float(cs[i]))
            tree[node] = (best[1], best[2], 0.0)
            right = x[r, best[1]] > best[2]
            rows[2 * node + 1], rows[2 * node + 2] = r[~right], r[right]
        for node in range(2**DEPTH - 1, len(tree)):
            r = rows[node]
            value = RATE * g[r].sum() / (h[r].sum() + 1)
            tree[node] = (0, math.inf, value)
            f[r] += value
        model.trees.append(tree)
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's scale by Newton steps on rows that the trees have not seen, then the thresholds."""
    m, a, b = model.margin(x), 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, np.array([((y - p) * m).sum(), (y - p).sum()]))
        a, b = a + da, b + db
    model.scale = (float(a), float(b))
    p = model.probability(x)
    model.threshold = {}
    for k, kind in enumerate(KINDS):
        rows = x[:, 0] == k
        order = np.argsort(-p[rows])
        hit, at = y[rows][order], p[rows][order]
        good = np.flatnonzero(np.cumsum(hit) / np.arange(1, len(hit) + 1) >= PRECISION) if len(hit) else []
        model.threshold[kind] = max(0.8, float(at[good[-1]])) if len(good) else 1.1


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _with_check(r: random.Random, n: int) -> str:
    head = r.choice("3456") + _number(r, n - 2)
    return next(head + d for d in "0123456789" if luhn(head + d))


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Made texts with one true span or one look-alike each, as features of every candidate and whether it is the true span.

    True: addresses, numbers with country code or in national form, cards with a valid check digit, named or
    bare keys. Look-alikes: order, article and page numbers, cards with a wrong check digit, dates, versions,
    file hashes after "commit" or in links, long words, underscored names, ranges of numbers.
    """
    r = random.Random(seed)
    syllables = ("an", "the", "re", "er", "in", "on", "de", "la", "ou", "st", "ti", "en", "es")
    word = lambda k=4: "".join(r.choice(syllables) for _ in range(r.randint(1, k)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789") for _ in range(k))
    parts = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    four = lambda top: ".".join(str(r.randint(0, top)) for _ in range(4))
    true = {
        "email": [lambda: f"{word()}{r.choice(['.', '_', ''])}{word()} @ {word()}.{r.choice(['com', 'org', 'net'])}", lambda: f"{word()}(at){word()}.{r.choice(['com', 'de'])}", lambda: f"{word()}.{word()} [at] {word()} [dot] com", lambda: f"{word()}.{_number(r, 2)}@{word()}.example.com"],
        "ip": [lambda: ":".join(hexes(4) for _ in range(8)), lambda: four(255)],
        "card": [lambda: _with_check(r, 16), lambda: parts(_with_check(r, 16), r.choice(" -")), lambda: _with_check(r, 15)],
        "phone": [lambda: f"+{r.randint(1, 99)} ({_number(r, 3)}) {_number(r, 3)}-{_number(r, 4)}", lambda: f"({_number(r, 3)}) {_number(r, 3)}-{_number(r, 4)}", lambda: f"0{_number(r, 2)} {_number(r, 3)} {_number(r, 4)}", lambda: f"{_number(r, 3)}-{_number(r, 3)}-{_number(r, 4)}"],
        "secret": [lambda: hexes(r.choice((32, 40, 64))), lambda: mixed(r.choice((24, 32, 40))), lambda: mixed(r.randint(8, 16))],
    }
    cues = {
        "email": ["mail ", "contact: ", "write to ", ""], "ip": ["ip ", "host ", ""], "card": ["card ", "visa: ", "", ""],
        "phone": ["phone ", "tel. ", "call ", "mobile: "], "secret": ['token = "', "api_key=", "password: ", 'secret = "'],
    }
    false = [
        lambda: ("order ", _number(r, r.randint(7, 19))), lambda: ("isbn ", f"978-{_number(r, 1)}-{_number(r, 4)}-{_number(r, 4)}-{_number(r, 1)}"), lambda: ("", _number(r, 16)),
        lambda: ("date ", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)} "), lambda: ("", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"), lambda: ("version ", f"{four(12)}.{r.randint(0, 9)}"),
        lambda: ("", f"{four(999)}"), lambda: ("commit ", hexes(40)), lambda: ("sha256:", hexes(64)), lambda: ("https://" + word() + ".com/", word(8) + "-" + word(8) + "-" + word(8)), lambda: ("", word(14) + word(14)),
        lambda: ("", "_".join(word() for _ in range(6))), lambda: ("", "-" * 30), lambda: ("", "=" * 24), lambda: ("pages ", f"{_number(r, 4)} - {_number(r, 4)}"), lambda: ("", parts(_number(r, 16), " ")),
        lambda: ("invoice ", _number(r, 10)), lambda: ("", " ".join(_number(r, r.randint(1, 5)) for _ in range(5))), lambda: ("id ", f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"), lambda: ("", f"{word()} @ {word()}"),
        lambda: ("key: ", word(3)), lambda: ("note: ", word(5)), lambda: ("sum ", ".".join(_number(r, 3) for _ in range(4))), lambda: ("key = ", word(6)),
    ]
    x, y = [], []
    while len(y) < n:
        kind = r.choice(KINDS) if r.random() < 0.5 else None
        if kind:
            cue, span = r.choice(cues[kind]), r.choice(true[kind])()
            if kind == "secret" and len(span) < 20 and not cue:
                continue
        else:
            cue, span = r.choice(false)()
        head = " ".join(word() for _ in range(4)) + " " + cue
        text = head + span + ('"' if cue.endswith('"') else "") + " " + " ".join(word() for _ in range(4))
        for k, lo, hi in candidates(text):
            luhn_fails = kind == "card" and not luhn(_NOT_DIGIT.sub("", text[lo:hi]))
            x.append(features(text, k, lo, hi))
            y.append(float(k == kind and lo == len(head) and hi == len(head) + len(span) and not luhn_fails))
    return np.array(x), np.array(y)


@lru_cache(maxsize=1)
def trained() -> Trees:
    """The model: trees from one half of the made examples, calibrated on the other half."""
    x, y = examples(EXAMPLES, SEED)
    half = len(y) // 2
    model = fit(x[:half], y[:half])
    calibrate(model, x[half:], y[half:])
    return model


def all_spans(text: str, model: Trees) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, from the rules) by start, then kind. Rule spans stay; chosen ones overlap no other span."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    taken = [(lo, hi) for _, lo, hi in base]
    some = [c for c in candidates(text) if not any(lo < c[2] and c[1] < hi for lo, hi in taken)] if len(taken) < 50 else _free(candidates(text), taken)
    if some:
        p = model.probability(np.array([features(text, *c) for c in some]))
        order = sorted((-float(q), c[1], -c[2], c) for q, c in zip(p, some, strict=True) if q >= model.threshold[c[0]])
        chosen: dict[int, int] = {}
        for _, lo, _, c in order:
            if not any(i in chosen for i in range(lo, c[2])):
                chosen.update(dict.fromkeys(range(lo, c[2]), 1))
                out.append((*c, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _free(some: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap none of many spans."""
    covered = np.zeros(max(hi for _, hi in taken) + 1, np.int64)
    for lo, hi in taken:
        covered[lo:hi] = 1
    total = np.concatenate(([0], np.cumsum(covered)))
    top = len(total) - 1
    return [c for c in some if total[min(c[2], top)] == total[min(c[1], top)]]


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, lo, hi, _ in spans:
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def find_spans(df: DataFrame, key: str = "doc_id", redacted: bool = False, carry: dict[str, str] | None = None) -> DataFrame:
    """(key, kinds, starts, ends, by_rule) of every whole text, in code points, with ``redacted`` the ``clean`` text, and what carry names.

    A null or empty text has no spans; its clean text is itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained())  # some kilobytes

    def work(groups):
        for keys, texts in groups:
            found = [all_spans(t, shared.value) if t else [] for t in texts]
            out = {key: keys}
            out |= {name: [[s[j] for s in f] for f in found] for j, name in enumerate(("kinds", "starts", "ends", "by_rule"))}
            if redacted:
                out["clean"] = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            yield out

    schema = f"{key} {df.schema[key].dataType.simpleString()}, kinds array<string>, starts array<int>, ends array<int>, by_rule array<boolean>" + ", clean string" * redacted
    return map_rows(df, [key, "text"], schema, work, carry)


def redact_documents(df: DataFrame) -> DataFrame:
    """df with every span replaced by its kind in the text, and n_chars, if there, set anew; all other columns stay."""
    others = [c for c in df.columns if c not in ("doc_id", "text")]
    carry = {c: f"_carried_{i}" for i, c in enumerate(others)}
    found = find_spans(df, redacted=True, carry=carry)
    columns = {c: F.col(carry[c]) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("clean")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("kinds") > 0, F.char_length("clean").cast(df.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in df.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base spans by kind and digests of all spans.

    Null and empty texts have none (the digest of the empty string); spans that begin at one place come by kind; repeated
    rows are judged each; extra columns are not read; an empty table gives no rows.
    """
    found = find_spans(read(spark, sf_dir, "documents")).withColumn("s", F.arrays_zip("kinds", "starts", "ends", "by_rule"))
    base = F.filter("s", lambda s: s["by_rule"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")

    def counted(kind):
        return F.size(F.filter(base, lambda s: s["kinds"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
ORACLE_SQL: dict[str, str] = {}
