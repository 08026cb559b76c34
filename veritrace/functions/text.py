"""Names, identifiers and similarities as Spark expressions; scores that Spark lacks as Arrow UDFs."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that company names end with, written out and shortened.
LEGAL_FORMS = (
    "SOCIETA' A RESPONSABILITA' LIMITATA SEMPLIFICATA", "SOCIETA' A RESPONSABILITA' LIMITATA", "SOCIETA' PER AZIONI", "SOCIETA' COOPERATIVA", "SOCIETA' CONSORTILE", "SOCIETA' SEMPLICE",
    "S.C.A.R.L.S.", "S.C.A.R.L.", "S.R.L.S.", "S.P.A.", "S.R.L.", "S.N.C.", "S.A.S.", "SCARLS", "SCARL", "SRLS", "SRL", "SNC", "SAS", "S.S.", "S R L",
)
#: Forms that end a name once its punctuation is gone.
PLAIN_FORMS = ("SRL", "SPA", "SNC", "SAS", "SCARL", "SCARLS", "SRLS", "SOCIETA COOPERATIVA")
#: Words that the looser normal form leaves out wherever they stand, how it shortens others, and small words.
LOOSE_FORMS = r"\b(?:SRL?S?|SPA?|SNC?|SAS?|SS?|SOC?\s+COOP?|COOPERATIVA|CONSORZIO|ASSOCIAZIONE|FONDAZIONE)\b"
SHORTENED = (
    ("COSTRUZIONI", "COSTR"), ("INGEGNERIA", "ING"), ("SERVIZI", "SERV"), ("GENERALE", "GEN"), ("ITALIANA", "ITAL"), ("NAZIONALE", "NAZ"), ("INTERNAZIONALE", "INTERN"), ("TECNOLOGIE", "TECN"), ("INFORMATICA", "INFO"),
)
SMALL_WORDS = ("DI", "E", "IL", "LA", "DEL", "DELLA", "PER")
_ACCENTS = ("ÀÈÉÌÒÙ", "AEEIOU")


def _ends(forms: tuple[str, ...], dot: str) -> str:
    return r"(?:\s*\b(?:" + "|".join(re.escape(f).replace("\\ ", " ").replace("'", "['’]") for f in sorted(forms, key=len, reverse=True)) + f"){dot})+\\s*$"


def normalize_name(name: Column) -> Column:
    """Upper case without trailing legal forms, accents and punctuation. Accents fold only after the written forms are gone. Null stays null."""
    out = F.upper(F.trim(name))
    # "Società" and "Societa'" are one word to a reader
    out = F.regexp_replace(F.regexp_replace(out, r"\bSOCIETÀ(?=\s)", "SOCIETA'"), r"\bRESPONSABILITÀ(?=\s)", "RESPONSABILITA'")
    out = F.translate(F.regexp_replace(out, _ends(LEGAL_FORMS, r"\.?"), ""), *_ACCENTS)
    out = F.regexp_replace(out, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, _ends(PLAIN_FORMS, ""), ""), r"\s+", " "))


def loose_name(name: Column, aggressive: bool = False) -> Column:
    """Upper case without dots, legal forms anywhere and punctuation; ``aggressive`` also shortens common words and drops small ones."""
    out = F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), r"\.", ""), "(?i)" + LOOSE_FORMS, " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", " "), r"\s+", " "))
    if aggressive:
        for word, short in SHORTENED:
            out = F.replace(out, F.lit(word), F.lit(short))
        out = F.array_join(F.filter(F.split(out, " "), lambda w: ~w.isin(*SMALL_WORDS)), " ")
    return out


def first_words(name: Column, n: int = 3) -> Column:
    """The first words of the looser normal form."""
    return F.array_join(F.slice(F.split(loose_name(name), " "), 1, n), " ")


def core_name(name: Column) -> Column:
    """The normalized name's letters A-Z and digits only."""
    return F.regexp_replace(normalize_name(name), "[^A-Z0-9]", "")


def phonetic_key(name: Column, length: int = 8) -> Column:
    """GN as N, GLI as L, C, G and Q as K, PH as F, no vowels, no doubled letters; the first letters."""
    out = normalize_name(name)
    for pattern, to in (("GN", "N"), ("GLI", "L"), (r"[C|GQK]", "K"), ("PH", "F"), ("[AEIOU]", ""), (r"(.)\1+", "$1")):
        out = F.regexp_replace(out, pattern, to)
    return F.substring(out, 1, length)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def tokens(text: Column, longer_than: int = 3) -> Column:
    """Distinct upper-case words of more than so many letters."""
    return F.array_distinct(F.filter(F.split(F.upper(text), r"\s+"), lambda w: F.char_length(w) > longer_than))


def _lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = at.get(c, 0)
        low = row & match
        row = ((row + low) | (row - low)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths."""
    return 1.0 if not a and not b else 2 * _lcs(a, b) / (len(a) + len(b))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel ratio of the names with their words sorted."""
    return pd.Series([None if x is None or y is None else indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in zip(a, b, strict=True)])


def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best ratio among the shared words and the shared words with each side's rest."""

    def one(x: str, y: str) -> float:
        p, q = set(x.split()), set(y.split())
        both = " ".join(sorted(p & q))
        left, right = ((both + " " + " ".join(sorted(s))).strip() for s in (p - q, q - p))
        return max(indel_ratio(left, right), *((indel_ratio(both, left), indel_ratio(both, right)) if both else (0.0, 0.0)))

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])


def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best ratio of the shorter string with a stretch of the longer one of the same length."""

    def one(x: str, y: str) -> float:
        s, long = sorted((x, y), key=len)
        return max((indel_ratio(s, long[i : i + len(s)]) for i in range(len(long) - len(s) + 1)), default=1.0)

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])


def ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratio, "double")(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_token_sort, "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_token_set, "double")(a, b)


def _weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    """The plain ratio, or the best of the others at a discount: words sorted or as sets 0.95, stretches 0.9, 0.6 if one is over 8 times as long."""

    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        s, t = pd.Series([x]), pd.Series([y])
        best = indel_ratio(x, y)
        size = max(len(x), len(y)) / min(len(x), len(y))
        words = max(_token_sort(s, t)[0], _token_set(s, t)[0])
        if size < 1.5:
            return max(best, 0.95 * words)
        scale = 0.9 if size < 8 else 0.6
        return max(best, scale * _partial(s, t)[0], 0.95 * scale * words)

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])


def weighted_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_weighted, "double")(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_partial, "double")(a, b)


#: Forms of Italian identifiers: persons' tax codes, VAT numbers, project and tender codes (these last by context only).
IDENTIFIERS = {
    "cf_person": r"(?i)\b[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]\b", "piva": r"\b(?:IT)?\d{11}\b",
    "cup": r"\b[A-Z]\d{2}[A-Z]\d{10,14}\b", "cig": r"\b[A-Z0-9]{8,15}\b",
}


def identifier(text: Column, kind: str) -> Column:
    """The first identifier of a kind in a text; null if none."""
    found = F.regexp_extract(text, f"({IDENTIFIERS[kind]})", 1)
    return F.when(found != "", found)


def mentions(text: Column, kinds: tuple[str, ...] = ("Company", "Tender", "Person", "Project", "Buyer")) -> Column:
    """Distinct ids of ``@Type:id`` mentions of known types."""
    pattern = r"@(?:" + "|".join(kinds) + r"):([A-Za-z0-9_-]+)"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def funding_type(name: Column) -> Column:
    n = F.upper(name)
    rules = (("PNRR", "PNRR"), ("FESR", "FESR"), ("FEDER", "FESR"), ("FSE", "FSE"), ("PON", "PON"))
    return reduce(lambda acc, r: acc.when(n.contains(r[0]), r[1]), rules, F.when(F.lit(False), "")).otherwise("Altro")


def parse_int(text: Column) -> Column:
    """Digits with dots or commas as separators; null for anything else."""
    return F.regexp_replace(F.trim(text), "[.,]", "").try_cast("long")


def vat_number(text: Column) -> Column:
    """IT and 11 digits, from 11 digits or from the full form; null for anything else."""
    t = F.upper(F.regexp_replace(text, r"\s", ""))
    return F.when(t.rlike("^[0-9]{11}$"), F.concat(F.lit("IT"), t)).when(t.rlike("^IT[0-9]{11}$"), t)


def parse_amount(text: Column) -> Column:
    """A number as written in Italy (1.234.567,89) or with a point; signs of currency and spaces go; null for anything else."""
    t = F.regexp_replace(text, r"(?U)[\s€]|EUR", "")
    italian = t.rlike(r"^-?\d{1,3}(\.\d{3})*,\d+$") | t.rlike(r"^-?\d{1,3}(\.\d{3}){2,}$") | t.rlike(r"^-?\d+,\d+$")
    return F.when(italian, F.replace(F.regexp_replace(t, r"\.", ""), F.lit(","), F.lit(".")).try_cast("double")).otherwise(t.try_cast("double"))


def sector(ateco: Column) -> Column:
    """The two digits that an ATECO code begins with; null if it does not."""
    found = F.regexp_extract(ateco, r"^\s*(\d{2})", 1)
    return F.when(found != "", found)


def masked_ip(ip: Column) -> Column:
    """The address with its last part zeroed."""
    return F.regexp_replace(ip, r"^(\d+\.\d+\.\d+)\.\d+$", "$1.0")


def pseudonym(value: Column, salt: str = "") -> Column:
    """The first 16 hex digits of a salted SHA-256; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16)


def row_digest(*columns: Column) -> Column:
    """MD5 of several values as text, nulls marked, in order."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]))


def iso_date(text: Column) -> Column:
    return F.substring(text, 1, 10).try_cast("date")


def chunks(text: Column, size: int = 12_000, overlap: int = 400) -> Column:
    """Pieces of at most ``size`` characters, cut at the last newline or else space of their second half, that overlap."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            out, at = [], 0
            while t and at < len(t):
                end = min(len(t), at + size)
                if end < len(t):
                    best = t.rfind("\n", at + size // 2, end)
                    best = best if best > 0 else t.rfind(" ", at + size // 2, end)
                    end = best if best > 0 else end
                out.append(t[at:end])
                if end >= len(t):
                    break
                at = max(end - overlap, at + 1)
            return out

        return texts.map(one)

    return cut(text)
