"""Keyword search over all documents as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.operators import search
from veritrace.plans.base import query
from veritrace.sources.tables import Tables

#: Each question as it is typed; a fuzzy one allows for two edits a word.
QUESTIONS = ((1, "license agreement"), (2, "token secret mail"), (3, "lizense"), (4, "the report of the market"))

_TOKENS = r"""d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents), p AS (SELECT term, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2), t AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  l AS (SELECT doc_id, coalesce(len(w), 0) AS length FROM d), s AS (SELECT count(*) AS docs, avg(length) AS mean FROM l), q AS (SELECT * FROM (VALUES """ + ", ".join(f"({n}, '{w}')" for n, text in QUESTIONS for w in dict.fromkeys(text.split())) + ") AS q(question, asked))"
#: Only words of ASCII are asked for, so a letter beyond it differs from all of theirs, whichever it is.
_FUZZY = r"f AS (SELECT question, asked, term, df, levenshtein(asked, regexp_replace(term, '[^\x00-\x7F]', '?', 'g')) AS distance FROM q JOIN t ON abs(length(term) - length(asked)) <= 2 WHERE levenshtein(asked, regexp_replace(term, '[^\x00-\x7F]', '?', 'g')) <= 2)"
_RANK = """k AS (SELECT question, p.doc_id, round(sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS terms FROM a JOIN p ON a.term = p.term JOIN l ON p.doc_id = l.doc_id, s GROUP BY 1, 2)
  SELECT CAST(question AS BIGINT) AS question, doc_id, score, terms FROM k QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) <= 15"""


def _questions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(QUESTIONS, "question long, text string")


@query("text_search", f"WITH {_TOKENS}, a AS (SELECT question, t.term, df, 1.0 AS weight FROM q JOIN t ON q.asked = t.term), {_RANK}")
def text_search(t: Tables, edits: int = 0, limit: int = 15) -> DataFrame:
    """The first documents of each question by BM25 over every whole text."""
    docs, asked = t.raw("documents"), _questions(t).select(F.explode(search.words(F.col("text"))).alias("asked"))
    terms = search.fuzzy(search.vocabulary(docs), asked, edits).select("term") if edits else asked.toDF("term")
    found = search.search(search.build(docs, only=terms), _questions(t), edits, limit)
    return found.select("question", F.col("id").alias("doc_id"), "score", "terms")


@query("fuzzy_search", f"WITH {_TOKENS}, {_FUZZY}, a AS (SELECT question, term, df, max(1 - distance / greatest(length(asked), length(term))) AS weight FROM f GROUP BY 1, 2, 3 HAVING weight > 0), {_RANK}", edits=2)
def fuzzy_search(t: Tables, edits: int = 2, limit: int = 15) -> DataFrame:
    """The same with every term of the corpus within two edits of a word asked for."""
    return text_search(t, edits, limit)


@query("fuzzy_terms", f"WITH {_TOKENS}, {_FUZZY} SELECT DISTINCT asked, term, CAST(distance AS INTEGER) AS distance FROM f")
def fuzzy_terms(t: Tables, edits: int = 2) -> DataFrame:
    """The terms of all documents within two edits of each word of the questions."""
    asked = _questions(t).select(F.explode(search.words(F.col("text"))).alias("asked"))
    return search.fuzzy(search.vocabulary(t.raw("documents")), asked, edits)
