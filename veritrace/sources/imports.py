"""Imports of tables whose headers are not known: fields found by header, by an explicit map, rows checked before they load."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node type and field, and the headers that are known for it, without spaces, dots and dashes.
HEADERS = (
    ("Company", "cf", ("cfazienda", "companycf", "codicefiscaleazienda", "cf", "aziendacf", "partitaiva", "piva", "vatnumber", "codicefiscale")),
    ("Company", "nome", ("nome", "nomeazienda", "ragionesociale", "denominazione", "companyname", "name", "ditta")),
    ("Company", "ateco", ("ateco", "codiceateco", "sectorcode", "sector", "settore")),
    ("Company", "regione", ("regione", "region", "provincia", "province")),
    ("Tender", "cig", ("cig", "codicecig", "tenderid", "tendercode")),
    ("Tender", "oggetto", ("oggetto", "oggettoappalto", "description", "descrizione", "titolo", "title")),
    ("Tender", "importo", ("importo", "valore", "amount", "value", "importoaggiudicazione", "importobase")),
    ("Tender", "buyer_name", ("stazione", "stazioneappaltante", "buyername", "buyer", "amministrazione", "ente", "enteappaltante")),
)
#: The key of each node type, and its fields.
KEYS = {"Company": "cf", "Tender": "cig"}


@dataclass(frozen=True)
class Match:
    """A column, the field that it holds, the field's node type, and 1.0 for a known header or 0.7 for a part of one."""

    column: str
    field: str
    node_type: str
    confidence: float


def plain(header: str) -> str:
    return re.sub(r"[\s_.-]+", "", header.lower())


def match_headers(columns: list[str], given: dict[str, str] | None = None) -> list[Match]:
    """The field of each column: as given, by a known header, or by a header that begins or ends with a known one, or begins one.

    A field goes to the first column that has it. Known headers are tried over all columns before parts of them.
    """
    given = given or {}
    types = {field: node for node, field, _ in HEADERS}
    found = {c: Match(c, given[c], types.get(given[c], "CustomRecord"), 1.0) for c in columns if c in given}
    taken = {m.field for m in found.values()}

    def whole(p: str, known: str) -> bool:
        return p == known

    def part(p: str, known: str) -> bool:
        return bool(p) and (p.startswith(known) or p.endswith(known) or known.startswith(p))

    for fits, sure in ((whole, 1.0), (part, 0.7)):
        for c in columns:
            if c in found:
                continue
            for node, field, known in HEADERS:
                if field not in taken and any(fits(plain(c), k) for k in known):
                    found[c] = Match(c, field, node, sure)
                    taken.add(field)
                    break
    return [found[c] for c in columns if c in found]


def node_type(matches: list[Match]) -> str:
    """The type with a key among the matches, Company first; else the one with most fields; else CustomRecord."""
    fields = {m.field for m in matches}
    for node, key in KEYS.items():
        if key in fields:
            return node
    counts = {node: sum(m.node_type == node for m in matches) for node in KEYS}
    best = max(counts, key=counts.get)
    return best if counts[best] else "CustomRecord"


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text. The delimiter is the one of ; , tab and | that the header has most of."""
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    line = (head[0][0] if head else "").lstrip("\ufeff")
    sep = max(";,\t|", key=lambda d: (line.count(d), d == ","))
    df = spark.read.csv(path, sep=sep, header=True, encoding=encoding, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def import_rows(df: DataFrame, given: dict[str, str] | None = None, node: str | None = None) -> tuple[str, DataFrame]:
    """(node type, rows): one row a key with the fields found, and all other columns in a map ``extra``.

    Of rows with the same key each field has the value that comes last in order; rows of a known type without a key, and
    all of a CustomRecord, stay rows of their own with a null key.
    """
    matches = match_headers(df.columns, given)
    node = node or node_type(matches)
    key = KEYS.get(node)
    fields = {m.field: m.column for m in matches}
    rest = [c for c in df.columns if c not in fields.values()]

    def clean(c: str) -> Column:
        t = F.trim(F.col(f"`{c}`").cast("string"))
        return F.when(t != "", t)

    pairs = [x for c in rest for x in (F.lit(c), clean(c))]
    rows = df.select(*[clean(c).alias(f) for f, c in fields.items()], (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("extra"))
    if key not in fields:
        return node, rows.withColumn("key", F.lit(None).cast("string"))
    rows = rows.withColumn("key", F.upper(key))
    some = rows.where("key IS NOT NULL")
    merged = some.groupBy("key").agg(*[F.max(f).alias(f) for f in fields], F.max_by("extra", F.to_json("extra")).alias("extra"))
    return node, merged.unionByName(rows.where("key IS NULL"))


#: Checks of bulk rows by node type: field, pattern that a value must have, and whether it must be there.
CHECKS = {
    "Company": (("cf", r"^(IT)?[0-9]{11}$|^[A-Z0-9]{16}$", True), ("nome", r"\S", True), ("ateco", r"^[0-9]{2}", False)),
    "Tender": (("cig", r"^[A-Z0-9]{8,15}$", True), ("importo", r"^-?[0-9.]+(,[0-9]+)?$", False), ("oggetto", r"\S", False)),
}


def check_rows(rows: DataFrame, node: str) -> DataFrame:
    """rows with ``errors``, an array of field: problem; empty for rows that may load."""
    found = []
    for field, pattern, needed in CHECKS.get(node, ()):
        value = F.upper(F.col(field)) if field in rows.columns else F.lit(None).cast("string")
        missing = F.when(value.isNull() | (F.trim(value) == ""), F.lit(f"{field}: missing" if needed else None))
        found.append(F.coalesce(missing, F.when(value.isNotNull() & (F.trim(value) != "") & ~F.trim(value).rlike(pattern), F.lit(f"{field}: invalid"))))
    return rows.withColumn("errors", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of what an import would do: rows read, with a key, without one."""
    return rows.agg(F.count("*").alias("rows_read"), F.count("key").alias("rows_merged"), F.count_if(F.col("key").isNull()).alias("rows_created"))


def route(path: str) -> str:
    """What a source is read as, by the name of its file or its address."""
    p = path.lower().split("?")[0]
    if re.match(r"^https?://", p) and not re.search(r"\.(csv|json|parquet|pdf|txt|xlsx?)$", p):
        return "web"
    for kind, ends in {"csv": ("csv", "tsv"), "json": ("json", "jsonl"), "parquet": ("parquet",), "text": ("txt", "md", "log"), "web": ("html", "htm"), "pdf": ("pdf",), "audio": ("mp3", "wav", "m4a", "ogg", "flac"), "sheet": ("xlsx", "xls")}.items():
        if p.rsplit(".", 1)[-1] in ends:
            return kind
    return "unknown"
