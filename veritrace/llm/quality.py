"""Quality rules: word counts of every text, and the perplexity of its letters under a Kneser-Ney model.

The model is an interpolated, modified Kneser-Ney model of runs of ORDER letters, one for each value of lang and one of
all texts that it leans on, the more so the less text it has itself. Spark counts n-grams over every text and fits the
models by joins, order by order, so they are as large as the corpus makes them. Each n-gram's cost leaves the occurrence
that is scored out of the counts: a text cannot vouch for itself. Perplexity is that of a word, so that signs between
words weigh on it. Texts read costs from sorted arrays of n-gram hashes: those of whole models in all tasks while they
have at most MODEL_ROWS n-grams together, else, to the same result, a block of texts gets the arrays of its own n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import BROADCAST_ROWS, map_rows, read, stored

#: Letters of an n-gram.
ORDER = 5
#: Letters of its own text that the model of all texts weighs as much as in a language's model.
SHARED_LETTERS = 100_000
#: n-grams of all models that tasks hold as arrays (12 bytes each); of more, a block of texts gets those that it has.
MODEL_ROWS = 8_000_000
#: Letters of a block, unless one text is longer.
BLOCK_LETTERS = 8_000_000
#: Counts that a task gathers before it adds up those of equal n-grams; if half remain, it passes them on.
AT_ONCE = 1_000_000
#: A text is kept if its log2 perplexity is within the middle half of its language's texts, widened by so many times that
#: half's width below and above. With n texts that pass the base rules it is 1 + UNSURE / n times as wide.
BELOW, ABOVE, UNSURE = 2.25, 5.0, 30
#: Steps of one bit in which perplexities are ranked.
STEPS = 1000
_SPACES, _SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of ORDER code points, which stand at the same place of as many arrays."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = out * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lettered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts end to end, ORDER - 1 spaces before each and at the end, and the letters by text.

    Runs of white space are one space.
    """
    plain = [" ".join(t.replace("\0", "\ufffd").split()) for t in texts]  # numpy drops zeros at the end
    pad = " " * (ORDER - 1)
    return _points(pad + pad.join(plain) + pad), np.array([len(t) for t in plain], np.int64)


def _shifted(points: np.ndarray) -> list[np.ndarray]:
    return [points[k : len(points) - ORDER + 1 + k] for k in range(ORDER)]


def _inside(n: np.ndarray) -> np.ndarray:
    """Which of the n-grams of code points as _lettered gives them end in a text."""
    out = np.ones(int(n.sum()) + (ORDER - 1) * len(n), bool)
    ends = np.cumsum(n + ORDER - 1)
    for k in range(1, ORDER):
        out[ends - k] = False
    return out


def distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of texts, a row of ORDER code points each, and how often they occur."""
    points, n = _lettered(texts)
    alphabet, code = np.unique(points, return_inverse=True)
    if len(alphabet) ** ORDER >= 1 << 64:  # some 7,000 letters
        rows = np.stack(_shifted(points), axis=1)[_inside(n)]
        return np.unique(rows, axis=0, return_counts=True)
    key = np.zeros(len(points) - ORDER + 1, np.uint64)
    for c in _shifted(code.astype(np.uint64)):
        key = key * np.uint64(len(alphabet)) + c
    key = np.sort(key[_inside(n)])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count, key = np.diff(np.append(first, len(key))), key[first]
    out = np.empty((len(key), ORDER), np.uint32)
    for k in range(ORDER - 1, -1, -1):
        out[:, k] = alphabet[key % np.uint64(len(alphabet))]
        key = key // np.uint64(len(alphabet))
    return out, count


def _names(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"<U{ORDER}").ravel()


def _modelled(df: DataFrame) -> DataFrame:
    """df with ``_model``, the name of each row's model: its lang, or "und" where that is null."""
    return df.withColumn("_model", F.coalesce(F.col("lang").cast("string"), F.lit("und")))


def _grams(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """(keys, gram, n): the n-grams of the texts of each key, added up while a task has room."""

    def merged(parts):
        rows, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        _, first, where = np.unique(_hash(list(rows.T)), return_index=True, return_inverse=True)
        return rows[first], np.bincount(where, n).astype(np.int64)

    names = [x.split()[0] for x in schema.split(", ")]

    def work(groups):
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}

        def told():
            for key, parts in held.items():
                rows, n = merged(parts)
                for at in range(0, len(n), 100_000):
                    some = n[at : at + 100_000]
                    out = {name: [k] * len(some) for name, k in zip(names, key, strict=True)}
                    yield out | {"gram": pa.array(_names(rows[at : at + 100_000])), "n": some}
            held.clear()

        for *found, texts in groups:
            by: dict[tuple, list[str]] = {}
            for *key, text in zip(*found, texts, strict=True):
                if text and not text.isspace():
                    by.setdefault(tuple(key), []).append(text)
            for key, some in by.items():
                held.setdefault(key, []).append(distinct(some))
            if sum(len(n) for parts in held.values() for _, n in parts) >= AT_ONCE:
                for key, parts in held.items():
                    held[key] = [merged(parts)]
                if sum(len(n) for ((_, n),) in held.values()) >= AT_ONCE // 2:
                    yield from told()
        yield from told()

    return map_rows(df, [*keys, "text"], f"{schema}, gram string, n bigint", work)


def count_grams(df: DataFrame) -> DataFrame:
    """(model, gram, n): how often each n-gram occurs in the texts of each model, over the whole of df."""
    parts = _grams(_modelled(df), ["_model"], "model string")
    return parts.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def _by_model(rows: DataFrame) -> DataFrame:
    """rows, one a model, stored, to be sent to all tasks unless there are very many."""
    rows = stored(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _discount(n: Column) -> Column:
    """The discount of a count by the columns d1 to d3 of its order."""
    return F.when(n <= 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def fit(counts: DataFrame) -> DataFrame:
    """(model, gram, cost): -log2 of the probability of each n-gram's last letter after the others, without one of its occurrences.

    The probability is that of the language's own model and that of all texts, weighed by the language's letters and SHARED_LETTERS.
    """
    counts = stored(counts)
    every = _fitted(counts.groupBy(F.lit("").alias("model"), "gram").agg(F.sum("n").alias("n")))
    size = _by_model(counts.groupBy("model").agg(F.sum("n").alias("letters")))
    both = _fitted(counts).join(every.select("gram", F.col("p1").alias("shared")), "gram").join(size, "model")
    own = F.col("letters") - 1
    p = (own * F.col("p1") + SHARED_LETTERS * F.col("shared")) / (own + SHARED_LETTERS)
    return stored(both.select("model", "gram", (-F.log2(p)).cast("float").alias("cost")))


def _fitted(counts: DataFrame) -> DataFrame:
    """(model, gram, p, p1), stored: the probability of each n-gram's last letter after the others in its model, and without one of its occurrences.

    From letters on their own to ORDER of them: the discounted share of an n-gram among those with its first letters,
    and what the discounts leave, dealt out by the next lower order. Lower orders count in how many n-grams of the
    next order a run of letters ends. An n-gram seen once is not there without its occurrence, nor is its part of the count below.
    """
    tables = {ORDER: stored(counts)}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = stored(tables[order + 1].groupBy("model", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")))
    letters = _by_model(tables[1].groupBy("model").agg((1 / (F.count("*") + 1)).alias("even")))
    below = None
    for order in range(1, ORDER + 1):
        rows = tables[order]
        c = [F.greatest(F.count_if(F.col("n") == k), F.lit(0)).alias(f"c{k}") for k in (1, 2, 3, 4)]
        y = F.when(F.col("c1") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.5)
        d = [F.when(F.col(f"c{k}") > 0, F.greatest(F.lit(0.01), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")))).otherwise(y).alias(f"d{k}") for k in (1, 2, 3)]
        rows = rows.join(_by_model(rows.groupBy("model").agg(*c).select("model", *d)), "model")
        head = F.expr(f"left(gram, {order - 1})")
        rows = rows.withColumns({"head": head, "cut": _discount(F.col("n")), "less": _discount(F.col("n") - 1)})
        heads = Window.partitionBy("model", "head")  # as many rows as there are letters at most
        rows = rows.withColumns({"whole": F.sum("n").over(heads), "left": F.sum("cut").over(heads)})
        one = F.col("whole") > 1
        rows = rows.select(
            "model", "gram", (F.col("n") == 1).alias("lone"), ((F.col("n") - F.col("cut")) / F.col("whole")).alias("share"), (F.col("left") / F.col("whole")).alias("rest"),
            F.when(one, (F.col("n") - 1 - F.col("less")) / (F.col("whole") - 1)).otherwise(0.0).alias("share1"),
            F.when(one, (F.col("left") - F.col("cut") + F.col("less")) / (F.col("whole") - 1)).otherwise(1.0).alias("rest1"),
        )
        if below is None:
            rows = rows.join(letters, "model").withColumns({"p": F.col("even"), "p1": F.col("even")})
        else:
            rows = rows.withColumn("tail", F.expr("substring(gram, 2)")).join(below.withColumnRenamed("gram", "tail"), ["model", "tail"])
        below = rows.select(
            "model", "gram", (F.col("share") + F.col("rest") * F.col("p")).alias("p"),
            (F.col("share1") + F.col("rest1") * F.when(F.col("lone"), F.col("p1")).otherwise(F.col("p"))).alias("p1"),
        )
    return stored(below)


class Costs:
    """Costs of one model's n-grams beside their sorted hashes, with the place where each run of leading bits begins."""

    def __init__(self, h: np.ndarray, cost: np.ndarray):
        by = np.argsort(h)
        self.h, self.cost = h[by], cost[by]
        self.bits = max(1, len(h).bit_length())
        self.begin = np.searchsorted(self.h, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The costs of n-grams that the model has."""
        at = self.begin[h >> np.uint64(64 - self.bits)]
        left = np.flatnonzero(self.h[at] != h)
        while len(left):
            at[left] += 1
            left = left[self.h[at[left]] != h[left]]
        return self.cost[at]


def arrays(model: DataFrame | pa.Table) -> dict[str, Costs]:
    """The sorted arrays of each model's n-grams: of a whole table on the driver, MODEL_ROWS at most, or of a block's."""
    out: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in (model if isinstance(model, pa.Table) else model.toArrow()).to_batches():
        names = b.column(0).dictionary_encode()
        at = names.indices.to_numpy(zero_copy_only=False)
        h = _hash(list(_points("".join(b.column(1).to_pylist())).reshape(-1, ORDER).T))
        for k, name in enumerate(names.dictionary.to_pylist()):
            out.setdefault(name, []).append((h[at == k], b.column(2).to_numpy(zero_copy_only=False)[at == k]))
    return {name: Costs(*(np.concatenate([p[k] for p in parts]) for k in (0, 1))) for name, parts in out.items()}


def _base(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum([text.count(c) for c in _SPACES])
    symbols = sum([text.count(c) for c in _SYMBOLS])
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        hit = bytearray(len(words))
        for i, w in enumerate(windows):
            k = first.setdefault(w, i)
            if k != i:
                hit[k : k + 3] = hit[i : i + 3] = b"\x01\x01\x01"
        repeated = sum(hit)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bits(texts: list[str], n_words: list[int], costs: Costs) -> list[float]:
    """The log2 perplexity of texts with letters: the cost of all their letters over their words."""
    points, n = _lettered(texts)
    cost = costs.of(_hash(_shifted(points))[_inside(n)])
    return (np.add.reduceat(cost, np.cumsum(n) - n, dtype=np.float64) / np.array(n_words)).tolist()


def measure(df: DataFrame, model: DataFrame, carry: dict[str, str] | None = None) -> DataFrame:
    """Per row of df, stored: doc_id, the base counts, base_failed, model (its language's) and bits, and what carry names.

    bits is the log2 of the perplexity, the cost of all letters of the whole text over its words; null where it has none.
    """
    small = model.count() <= MODEL_ROWS
    shared = df.sparkSession.sparkContext.broadcast(arrays(model)) if small else None

    def work(groups):
        first = TaskContext.get().partitionId() << 32
        block, filled, place = 0, 0, 0
        for ids, keys, texts in groups:
            base = [_base(t or "") for t in texts]
            bits: list[float | None] = [None] * len(texts)
            for key in set(keys) if small else ():
                rows = [i for i, k in enumerate(keys) if k == key and texts[i] and not texts[i].isspace()]
                if rows:
                    for i, v in zip(rows, _bits([texts[i] for i in rows], [base[i][0] for i in rows], shared.value[key]), strict=True):
                        bits[i] = v
            size = sum(len(t or "") for t in texts)
            if filled and filled + size > BLOCK_LETTERS:
                block, filled, place = block + 1, 0, 0
            out = {"doc_id": ids, "model": keys, "bits": bits, "block": [first + block] * len(texts), "place": list(range(place, place + len(texts)))}
            filled, place = filled + size, place + len(texts)
            out |= {k: [b[j] for b in base] for j, k in enumerate(_COUNTS)}
            out["base_failed"] = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in base]
            yield out

    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in _COUNTS) + ", base_failed boolean, model string, bits double, block bigint, place bigint"
    carry = dict(carry or {})
    text = carry.get("text", "_text")
    made = map_rows(_modelled(df), ["doc_id", "_model", "text"], schema, work, carry if small else carry | {"text": text})
    if small:
        return stored(made.drop("block", "place"))
    rows = stored(made)
    found = stored(rows.drop("bits").join(_scored(rows, text, model), ["block", "place"], "left").drop("block", "place"))
    return found if "text" in carry else found.drop(text)


def _scored(rows: DataFrame, text: str, model: DataFrame) -> DataFrame:
    """(block, place, bits) of rows: each block of texts meets the costs of the n-grams that occur in it, an n-gram once."""
    texts = rows.select("block", "place", "model", "n_words", F.col(text).alias("text"))
    costs = _grams(texts, ["block", "model"], "block bigint, model string").join(model, ["model", "gram"]).select("block", "model", "gram", "cost")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known, place, bits = arrays(right.select(["model", "gram", "cost"])), [], []
        names = left.column("model").to_pylist()
        for key in set(names):
            some = left.filter(pa.array([x == key for x in names])).to_pylist()
            some = [r for r in some if r["text"] and not r["text"].isspace()]
            if some:
                place += [r["place"] for r in some]
                bits += _bits([r["text"] for r in some], [r["n_words"] for r in some], known[key])
        block = pa.repeat(left.column("block")[0], len(place)) if place else pa.array([], pa.int64())
        return pa.table({"block": block, "place": pa.array(place, pa.int64()), "bits": pa.array(bits, pa.float64())})

    with_words = texts.where("n_words > 0")
    return with_words.groupBy("block").cogroup(costs.groupBy("block")).applyInArrow(score, "block bigint, place bigint, bits double")


def bands(measured: DataFrame) -> DataFrame:
    """(model, low, high): the perplexity band of each language, in bits, from the texts that pass the base rules.

    Quartiles are of bits rounded to 1 / STEPS, of which a language has some ten thousand values whatever the
    corpus holds, so they do not hang on how rows are dealt out.
    """
    step = F.round(F.col("bits") * STEPS).cast("bigint")
    n = measured.where(~F.col("base_failed") & F.col("bits").isNotNull()).groupBy("model", step.alias("step")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("model").orderBy("step")
    ranked = n.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("model"))})
    q = [F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("step"))).alias(name) for share, name in ((0.25, "q1"), (0.75, "q3"))]
    found = ranked.groupBy("model").agg(*q, F.first("all").alias("all"))
    wide = (F.col("q3") - F.col("q1") + 1) * (1 + UNSURE / F.col("all"))
    return found.select("model", ((F.col("q1") - BELOW * wide) / STEPS).alias("low"), ((F.col("q3") + ABOVE * wide) / STEPS).alias("high"))


def _judged(df: DataFrame, carry: dict[str, str] | None = None) -> DataFrame:
    measured = measure(df, fit(count_grams(df)), carry)
    inside = F.col("bits").between(F.col("low"), F.col("high"))
    found = measured.join(_by_model(bands(measured)), "model", "left")
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def judge(df: DataFrame) -> DataFrame:
    """Measured rows of df with low, high and ``kept``.

    A row fails by the base rules (under 50 words, or over half of them in repeated 3-word windows) or by a
    perplexity outside its language's band. Rows repeated in df are judged alike.
    """
    return _judged(df)


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of df that ``judge`` keeps, with all their columns. Texts are stored once beside their counts, not joined."""
    carry = {c: f"_carried_{i}" for i, c in enumerate(df.columns)}
    return _judged(df, carry).where("kept").select(*[F.col(new).alias(old) for old, new in carry.items()])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict on every whole text of documents.

    A null or empty text has no words, fails the base rules and has no perplexity; a null lang takes the
    model "und"; repeated rows are judged each; extra columns are not read; an empty table gives no rows.
    """
    found = judge(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), "low").alias("perplexity_low"), F.pow(F.lit(2.0), "high").alias("perplexity_high"),
    )


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
