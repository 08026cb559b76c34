"""Language identification: known words by their frequency in each language, unseen ones by ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import map_rows, read, stored

#: The model is fitted on so many labelled rows of each language (all, where there are fewer): those of the least hashes.
ROWS_A_LANGUAGE = 2500
LONGEST = 5
#: Words of evidence that the score counts at most: over them a text's words agree so well that every score would be 1.
EVIDENCE = 12
#: Words that a task remembers the scores of.
REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of learning: crc32 of its doc_id as text leaves 1 by 3. No doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams, with a mark at its start and end."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def sample(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of the rows to learn from, and how many labelled rows each language has.

    Rows need text and lang and are not held out. Of a language come those with the ROWS_A_LANGUAGE least hashes of
    doc_id and text, however many it has; rows that are equal in both are learnt from once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("_h"))
    hashes = stored(rows.groupBy("lang", "_h").agg(F.count("*").alias("_n")))
    counted = hashes.groupBy("lang").agg(F.sum("_n").alias("n"), F.count("*").alias("k")).collect()  # a row a language
    sizes = {r["lang"]: r["n"] for r in counted}
    if not sizes:
        return rows.select("lang", "text"), sizes
    # hashes that about twice as many different rows are below, so that few are put in order
    near = [(r["lang"], (1 << 63) - 1 if r["k"] <= 4 * ROWS_A_LANGUAGE else (2 * ROWS_A_LANGUAGE + 1000) * (1 << 64) // r["k"] - (1 << 63)) for r in counted]
    near = F.broadcast(docs.sparkSession.createDataFrame(near, "lang string, _near long"))
    first = Window.partitionBy("lang").orderBy("_h")
    few = hashes.join(near, "lang").where("_h <= _near").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= ROWS_A_LANGUAGE)
    last = few.groupBy("lang").agg(F.max("_h").alias("_last"))
    return rows.join(F.broadcast(last), "lang").where("_h <= _last").dropDuplicates(["lang", "_h"]).select("lang", "text"), sizes


def count(df: DataFrame) -> DataFrame:
    """(lang, size, h, n) of the texts of df: words by how often they occur have size 0, n-grams by the different words that they are in their length; h is an XXH64 of the text."""

    def work(groups):
        for langs, texts in groups:
            by: dict[str, Counter] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            for lang, words in by.items():
                yield {"lang": [lang] * len(words), "word": list(words), "n": list(words.values())}

    words = stored(map_rows(df, ["lang", "text"], "lang string, word string, n bigint", work).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    size = F.char_length("word") + 2

    def parts(n: int):
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(F.lit(n).alias("size"), F.substring(marked, i, F.lit(n)).alias("g"))))

    every = F.flatten(F.array_compact(F.array(*[parts(n) for n in range(1, LONGEST + 1)])))
    found = words.select("lang", F.inline(every)).groupBy("lang", "size", F.xxhash64("g").alias("h")).agg(F.count("*").alias("n"))
    return words.select("lang", F.lit(0).alias("size"), F.xxhash64("word").alias("h"), "n").union(found)


@dataclass
class Model:
    """Natural logs of relative frequencies beside the sorted hashes of words and n-grams: a row for each, a column for each language."""

    langs: list[str]
    names: dict[int, np.ndarray]
    table: dict[int, np.ndarray]
    usual: int

    def rows(self, size: int, words: list[str]) -> np.ndarray:
        """The place of each word or n-gram in the table; -1 if it is not there."""
        names = self.names[size]
        if not len(words) or not len(names):
            return np.full(len(words), -1)
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        return np.where(names[at] == h, at, -1)


def fit(docs: DataFrame) -> Model:
    """Learn from ``sample``. What the driver gets are the words and n-grams of those rows, as many as they have."""
    some, sizes = sample(docs)
    if not sizes:
        return Model([], {}, {}, 0)
    langs = sorted(sizes)
    found = count(some).toArrow()
    of = np.searchsorted(np.array(langs, object), np.array(found["lang"].to_pylist(), object)) if found.num_rows else np.zeros(0, np.int64)
    size, h, n = (found[c].to_numpy() for c in ("size", "h", "n"))
    names, table = {}, {}
    for k in range(LONGEST + 1):
        rows = size == k
        names[k], at = np.unique(h[rows], return_inverse=True)
        seen = np.full((len(names[k]), len(langs)), 0.5)
        np.add.at(seen, (at, of[rows]), n[rows])
        table[k] = np.log(seen / (np.bincount(of[rows], n[rows], len(langs)) + 1.0)).astype(np.float32)
    usual = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i))
    return Model(langs, names, table, usual)


class Scorer:
    """A model with a bounded memory of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)

    def learn(self, words: list[str]) -> None:
        """A known word's row; of others the mean over their known n-grams of the longest size that has any, all zero if none has."""
        model = self.model
        new = np.zeros((len(words), len(model.langs)), np.float32)
        place = model.rows(0, words)
        new[place >= 0] = model.table[0][place[place >= 0]]
        left = np.flatnonzero(place < 0).tolist()
        for n in range(LONGEST, 0, -1):
            parts = [grams(words[i], n) for i in left]
            owner = np.repeat(np.array(left, np.int64), [len(p) for p in parts])
            place = model.rows(n, [g for p in parts for g in p])
            own, hits = owner[place >= 0], place[place >= 0]
            np.add.at(new, own, model.table[n][hits])
            some, size = np.unique(own, return_counts=True)
            new[some] /= size[:, None]
            left = np.setdiff1d(left, some, assume_unique=True).tolist()
        self.at.update({w: len(self.table) + i for i, w in enumerate(words)})
        self.table = np.concatenate([self.table, new])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        counts = [Counter(_WORD.findall(t.lower())) if t else Counter() for t in texts]
        if model.langs:
            unseen = set().union(*counts).difference(self.at)
            if unseen and len(self.at) > REMEMBERED:
                self.forget()
                unseen = set().union(*counts)
            self.learn(sorted(unseen))
        langs, scores = [], []
        for text, words in zip(texts, counts, strict=True):
            if not model.langs or not text or not any(c.isalpha() for c in text):
                langs.append("und")
                scores.append(0.0)
                continue
            n = np.fromiter(words.values(), float, len(words))
            rows = self.table[[self.at[w] for w in words]].astype(np.float64)
            used = n[(rows != 0).any(axis=1)].sum() if len(rows) else 0.0
            if not used:
                langs.append(model.langs[model.usual])
                scores.append(1 / len(model.langs))
                continue
            mean = n @ rows / used
            p = np.exp(np.minimum(used, EVIDENCE) * (mean - mean.max()))
            best = int(p.argmax())
            langs.append(model.langs[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


def predict(df: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every whole text; nothing but the text is looked at.

    "und" with score 0 if a text is null or has no letter, or nothing was learned; the most frequent language
    of the labelled rows if a text has letters but none that the model knows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(groups):
        scorer = Scorer(shared.value)
        for keys, texts in groups:
            langs, scores = scorer.predict(texts)
            yield {key: keys, "lang_pred": langs, "score": scores}

    return map_rows(df, [key, "text"], f"{key} {df.schema[key].dataType.simpleString()}, lang_pred string, score double", work)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learned from those that are not held out.

    A null or empty text, or one without a letter, is "und" with score 0, and so is all where no row has a lang to learn
    from. Rows without lang are judged, not learned from. Of languages that fit alike the first by name is told. Repeated
    rows are judged each; extra columns are not read; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLE_SQL: dict[str, str] = {}
