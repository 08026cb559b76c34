"""Full-text search: an inverted index in tables, ranking by BM25, fuzzy terms by deletion neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.operators.components import BROADCAST_ROWS, stored
from veritrace.operators.graph import top_per_key

#: BM25's saturation of repeats and its share of length.
K1, B = 1.2, 0.75
#: Parts in which a question's best documents are found first, so that none sorts all that match.
PARTS = 64


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order and with repeats."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass
class Index:
    """postings (term, id, n), documents (id, length), terms (term, df), and how many documents there are and their mean length."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    n: int
    mean: float


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term): all different words of all whole texts."""
    return docs.select(F.explode(words(F.col(text))).alias("term")).distinct()


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> Index:
    """The index of every whole text, stored once; postings are sorted by term, so that a question reads only its terms' part.

    With ``only`` (term), for questions that are asked once, just the postings of these terms are kept. Null and empty texts count as documents of no words. Rows of one id are one document; rows without id are left out. Terms
    are counted in each task before they are dealt out, so frequent words do not gather.
    """
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    documents = stored(rows.groupBy("id").agg(F.sum(F.size("w")).alias("length")))
    postings = rows.select("id", F.explode("w").alias("term"))
    if only is not None:
        only = stored(only.select("term").distinct())
        postings = postings.join(F.broadcast(only) if only.count() <= BROADCAST_ROWS else only, "term")
    postings = postings.groupBy("term", "id").agg(F.count("*").alias("n"))
    postings = stored(postings if only is not None else postings.sort("term", "id"))
    terms = stored(postings.groupBy("term").agg(F.count("*").alias("df")))
    size = documents.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return Index(postings, documents, terms, size["n"], size["mean"] or 0.0)


def deletions(term: Column, edits: int) -> Column:
    """The term and all that is left of it without up to ``edits`` of its letters."""
    found = F.array(term)
    for _ in range(edits):
        shorter = F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
        found = F.array_distinct(F.concat(found, F.flatten(shorter)))
    return found


def fuzzy(terms: DataFrame, asked: DataFrame, edits: int = 2) -> DataFrame:
    """(asked, term, distance): the terms (term) within so many edits of each of asked (asked); Levenshtein's insertions, deletions and replacements.

    Two words within k edits share a word that up to k deletions make of both, so only terms that share one are compared.
    """
    a = stored(asked.select("asked").where("asked IS NOT NULL").distinct())
    left = stored(a.select("asked", F.length("asked").alias("size"), F.explode(deletions(F.col("asked"), edits)).alias("key")))
    left = F.broadcast(left) if left.count() <= BROADCAST_ROWS else left
    size = F.length("term")
    span = a.agg(F.min(F.length("asked")).alias("lo"), F.max(F.length("asked")).alias("hi")).first()
    near = terms.select("term").where(size.between((span["lo"] or 0) - edits, (span["hi"] or 0) + edits))
    right = near.select("term", F.explode(deletions(F.col("term"), edits)).alias("key"))
    pairs = right.join(left, "key").where(F.abs(F.length("term") - F.col("size")) <= edits).select("asked", "term").distinct()
    return pairs.withColumn("distance", F.levenshtein("asked", "term")).where(F.col("distance") <= edits)


def search(index: Index, questions: DataFrame, edits: int = 0, limit: int | None = 15) -> DataFrame:
    """(question, id, score, terms): the first documents of each question (question, text) by BM25, and how many different terms they matched.

    With ``edits``, every term within so many edits counts too, times 1 - distance / the longer length; a term that several
    words of a question lead to counts for the nearest. Words that a question repeats count once. Equal scores go by id. A question without
    words or matches gives no rows; without a limit all matches are returned.
    """
    asked = questions.select("question", F.explode(F.array_distinct(words(F.col("text")))).alias("asked"))
    if edits:
        found = fuzzy(index.terms, asked, edits)
        weight = 1 - F.col("distance") / F.greatest(F.length("asked"), F.length("term"))
        asked = asked.join(found, "asked").select("question", "term", weight.alias("weight")).where("weight > 0")
    else:
        asked = asked.select("question", F.col("asked").alias("term"), F.lit(1.0).alias("weight"))
    asked = asked.groupBy("question", "term").agg(F.max("weight").alias("weight")).join(index.terms, "term")
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = stored(asked.select("question", "term", (F.col("weight") * idf).alias("idf")))
    few = asked.count() <= BROADCAST_ROWS
    hits = index.postings.join(F.broadcast(asked) if few else asked, "term").join(index.documents, "id")
    n = F.col("n").cast("double")
    score = F.col("idf") * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("length") / F.lit(index.mean)))
    rows = hits.groupBy("question", "id").agg(F.round(F.sum(score), 6).alias("score"), F.count("*").alias("terms"))
    if limit is None:
        return rows
    rows = top_per_key(rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS))), ["question", "_part"], limit, F.desc("score"), "id").drop("_part")
    return top_per_key(rows, "question", limit, F.desc("score"), "id")
