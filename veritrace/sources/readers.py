"""Readers of landed open-data files: procurement releases as JSON, projects as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veritrace.functions.text import chunks, funding_type, iso_date, normalize_name, parse_amount, parse_int, vat_number
from veritrace.sources.imports import plain

_RELEASE = (
    "struct<ocid:string,tender:struct<id:string,title:string,description:string,value:struct<amount:double>,procurementMethod:string>,"
    "parties:array<struct<id:string,name:string,roles:array<string>>>,"
    "awards:array<struct<id:string,date:string,value:struct<amount:double>,suppliers:array<struct<id:string,name:string>>>>>"
)


def releases(spark: SparkSession, path: str) -> DataFrame:
    """One row a release, from release packages or from the first release of each record of record packages."""
    files = spark.read.schema(f"releases array<{_RELEASE}>, records array<struct<releases:array<{_RELEASE}>>>").json(path, multiLine=True)
    firsts = F.transform("records", lambda r: F.get(r["releases"], F.lit(0)))
    return files.select(F.explode(F.coalesce("releases", firsts)).alias("r")).select("r.*")


def tenders(rel: DataFrame) -> DataFrame:
    """(cig, ocid, oggetto, importo, procedura, cup); releases without code or amount are left out."""
    cig = F.split_part(F.element_at(F.split("ocid", "-"), -1), F.lit("/"), F.lit(1))
    cup = F.regexp_extract(F.concat_ws(" ", "tender.title", "tender.description"), r"([A-Z]\d{2}[A-Z]\d{11})", 1)
    out = rel.select(cig.alias("cig"), "ocid", F.col("tender.title").alias("oggetto"), F.col("tender.value.amount").alias("importo"), F.col("tender.procurementMethod").alias("procedura"), F.when(cup != "", cup).alias("cup"))
    return out.where("cig <> '' AND importo <> 0")


def wins(rel: DataFrame) -> DataFrame:
    """(cf, cig, data, importo, nome) for each supplier of each award."""
    cig = F.split_part(F.element_at(F.split("ocid", "-"), -1), F.lit("/"), F.lit(1))
    award = rel.select(cig.alias("cig"), F.explode("awards").alias("a"))
    rows = award.select("cig", iso_date(F.col("a.date")).alias("data"), F.col("a.value.amount").alias("importo"), F.explode("a.suppliers").alias("s"))
    return rows.select(F.col("s.id").alias("cf"), "cig", "data", "importo", F.col("s.name").alias("nome"))


def _first(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """One row a key: that which comes first by ``at``."""
    return rows.where(f"{key} IS NOT NULL AND {key} <> ''").groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(at, *columns)).alias("f")).select(key, "f.*")


def companies(rel: DataFrame) -> DataFrame:
    """(cf, piva, nome_originale, nome_normalizzato), one row a tax code: the name of its first award by tender and date. piva where the code is one."""
    rows = wins(rel).withColumn("_at", F.concat_ws("|", "cig", F.col("data").cast("string")))
    rows = _first(rows, "cf", "_at", "nome").withColumnRenamed("nome", "nome_originale")
    return rows.select("cf", vat_number(F.col("cf")).alias("piva"), "nome_originale", normalize_name(F.col("nome_originale")).alias("nome_normalizzato"))


def buyers(rel: DataFrame) -> DataFrame:
    """(cf, nome) of the parties that buy, by their first release."""
    rows = rel.select("ocid", F.explode("parties").alias("p")).where(F.array_contains("p.roles", "buyer"))
    return _first(rows.select(F.col("p.id").alias("cf"), F.col("p.name").alias("nome"), "ocid"), "cf", "ocid", "nome")


def csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ";", bad: str | None = None) -> DataFrame:
    """A file with a header, all columns as text; empty, NULL and N/A (any case, blanks around) are null. A byte order mark goes.

    Rows with too many or too few fields are left out, and told in a column named ``bad`` where one is asked for, which
    hangs on another column too, as Spark answers no query on bad rows alone.
    """
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    names = [c.strip().strip('"') for c in (head[0][0] if head else "").lstrip("\ufeff").split(sep)]
    schema = StructType([StructField(f"_{i}", StringType()) for i in range(len(names))] + [StructField("_bad", StringType())])
    reader = spark.read.schema(schema).option("columnPruning", "false")  # a row is bad by all its fields, whichever are asked for
    df = reader.csv(path, sep=sep, header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    if not bad:
        df = df.where("_bad IS NULL")
    values = [F.when(~F.upper(F.trim(f"_{i}")).isin("", "NULL", "N/A"), F.trim(f"_{i}")).alias(n) for i, n in enumerate(names)]
    return df.select(*values, *([F.concat("_bad", F.substring(F.coalesce("_0", F.lit("")), 1, 0)).alias(bad)] if bad else []))


#: Headers of project files and the columns that they are read into.
PROJECT_HEADERS = (
    ("cup", ("CUP",)), ("titolo", ("DESCRIZIONE_SINTETICA_CUP", "TITOLO_PROGETTO", "TITOLO")), ("descrizione", ("DESCRIZIONE_PROGETTO", "DESCRIZIONE")), ("importo_previsto", ("COSTO_PROGETTO", "IMPORTO_PREVISTO")),
    ("importo_finanziato", ("FINANZIAMENTO_PROGETTO", "IMPORTO_FINANZIATO")), ("stato", ("STATO_PROGETTO",)), ("settore", ("SETTORE_INTERVENTO", "SETTORE")), ("sottosettore", ("SOTTOSETTORE_INTERVENTO",)),
    ("categoria", ("NATURA_INTERVENTO",)), ("fondi", ("STRUMENTO_PROGRAMMAZIONE", "FONDI_UE")), ("data_inizio", ("DATA_INIZIO",)), ("data_fine", ("DATA_FINE",)), ("regione", ("REGIONE",)), ("provincia", ("PROVINCIA",)),
    ("comune", ("COMUNE",)), ("soggetto", ("SOGGETTO_TITOLARE", "SOGGETTO")), ("soggetto_cf", ("CF_SOGGETTO_TITOLARE", "PIVA_CODFISCALE_SOG_TITOLARE")),
)


def project_columns(df: DataFrame) -> DataFrame:
    """df with its columns under the names of PROJECT_HEADERS, the first known header of each; columns that a file lacks are null."""
    have = {c.upper(): c for c in df.columns}
    out = []
    for name, headers in PROJECT_HEADERS:
        found = [F.col(f"`{have[h]}`") for h in headers if h in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def projects(df: DataFrame) -> DataFrame:
    """Project rows with a code: amounts as numbers (0 where there is none), defaults for what is missing, funds split at , ; or /."""
    rows = project_columns(df).where("cup IS NOT NULL AND cup <> ''")
    funds = F.filter(F.transform(F.split(F.coalesce("fondi", F.lit("")), "[,;/]"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(
        "cup", *[F.coalesce(c, F.lit("")).alias(c) for c in ("titolo", "descrizione", "provincia")], *[F.coalesce(parse_amount(F.col(c)), F.lit(0.0)).alias(c) for c in ("importo_previsto", "importo_finanziato")],
        F.coalesce("stato", F.lit("Unknown")).alias("stato"), F.coalesce("settore", F.lit("N/A")).alias("settore"), "sottosettore", "categoria", *[iso_date(F.col(c)).alias(c) for c in ("data_inizio", "data_fine")],
        F.coalesce("regione", F.lit("Unknown")).alias("regione"), funds.alias("fondi"),
    )


def localisations(df: DataFrame) -> DataFrame:
    """(cup, regione, provincia, comune): where projects are; rows without any place are left out."""
    rows = project_columns(df).where("cup IS NOT NULL AND cup <> ''").select("cup", "regione", "provincia", "comune")
    return rows.where("coalesce(regione, provincia, comune) IS NOT NULL").distinct()


def subjects(df: DataFrame) -> DataFrame:
    """(cup, cf, nome): who holds a project, by tax code or name."""
    rows = project_columns(df).where("cup IS NOT NULL AND cup <> ''").select("cup", F.upper("soggetto_cf").alias("cf"), F.col("soggetto").alias("nome"))
    return rows.where("coalesce(cf, nome) IS NOT NULL").distinct()


def funding_sources(projects_: DataFrame) -> DataFrame:
    """(nome, tipo) of all funds that projects name."""
    return projects_.select(F.explode("fondi").alias("nome")).distinct().withColumn("tipo", funding_type(F.col("nome")))


# -- places


def find_column(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate that is a column, or else the first column that has it as a part, case aside; candidates in order."""
    for c in candidates:
        if c in df.columns:
            return c
        for name in df.columns:
            if c.lower() in name.lower():
                return name
    return None


def _need(df: DataFrame, *candidates: str) -> Column:
    name = find_column(df, *candidates)
    if name is None:
        raise ValueError(f"none of {', '.join(candidates)} is among the columns {', '.join(df.columns)}")
    return F.trim(F.col(f"`{name}`"))


def municipalities(df: DataFrame) -> DataFrame:
    """(cod_istat, nome, sigla_provincia, cod_regione, popolazione); rows without a code are left out, a code that repeats is one row."""
    people = find_column(df, "Popolazione", "POPOLAZIONE")
    rows = df.select(
        _need(df, "Codice Comune formato alfanumerico", "COD_ISTAT").alias("cod_istat"), _need(df, "Denominazione in italiano", "DENOMINAZIONE").alias("nome"),
        _need(df, "Sigla automobilistica", "SIGLA_PROVINCIA").alias("sigla_provincia"), _need(df, "Codice Regione", "COD_REGIONE").alias("cod_regione"),
        (parse_int(F.col(f"`{people}`")) if people else F.lit(None).cast("long")).alias("popolazione"),
    )
    return _one_each(rows, "cod_istat")


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.where(f"{key} IS NOT NULL AND {key} <> ''").groupBy(key).agg(F.min(F.struct(*others)).alias("f")).select(key, "f.*")


def provinces(df: DataFrame) -> DataFrame:
    """(cod_provincia, nome, sigla, cod_regione), one row a code: the first by name."""
    rows = df.select(
        _need(df, "territoriale sovracomunale", "COD_PROVINCIA").alias("cod_provincia"), _need(df, "territoriale sovracomunale (valida a fini statistici)", "Denominazione dell'Unità", "DENOMINAZIONE").alias("nome"),
        _need(df, "Sigla automobilistica", "SIGLA").alias("sigla"), _need(df, "Codice Regione", "COD_REGIONE").alias("cod_regione"),
    )
    return _one_each(rows, "cod_provincia")


def regions(df: DataFrame) -> DataFrame:
    """(cod_regione, nome), one row a code: the first by name."""
    rows = df.select(_need(df, "Codice Regione", "COD_REGIONE").alias("cod_regione"), _need(df, "Denominazione Regione", "Denominazione regione", "DENOMINAZIONE").alias("nome"))
    return _one_each(rows, "cod_regione")


# -- recovery plan


def _text(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def plan_companies(df: DataFrame, subcontractors: bool = False) -> DataFrame:
    """(cf, nome_originale, nome_normalizzato, forma_giuridica, ateco) of the plan's subjects, or of its subcontractors; one row a tax code, the first by name."""
    end = " Sub-Appaltatore" if subcontractors else ""
    cf = _text(df, "Codice Fiscale/P.IVA Sub-Appaltatore" if subcontractors else "Codice Fiscale Soggetto")
    rows = df.select(F.trim(cf).alias("cf"), _text(df, f"Denominazione{end}").alias("nome_originale"), _text(df, f"Descrizione Forma Giuridica{end}").alias("forma_giuridica"), _text(df, f"Codice ATECO{end}").alias("ateco"))
    return _one_each(rows, "cf").withColumn("nome_normalizzato", F.upper("nome_originale"))


def involvement(df: DataFrame) -> DataFrame:
    """(company_cf, project_cup, role, submisura_code, submisura_desc): subjects of the plan's projects."""
    rows = df.select(F.trim(_text(df, "Codice Fiscale Soggetto")).alias("company_cf"), _text(df, "CUP").alias("project_cup"), _text(df, "Descrizione del Ruolo del Soggetto").alias("role"), _text(df, "Codice Univoco Submisura").alias("submisura_code"), _text(df, "Descrizione Submisura").alias("submisura_desc"))
    return rows.where("company_cf IS NOT NULL AND company_cf <> ''")


def sub_contracts(df: DataFrame) -> DataFrame:
    """(sub_cf, tender_cig, project_cup, role, ateco, data_estrazione): subcontractors of the plan's tenders."""
    rows = df.select(
        F.trim(_text(df, "Codice Fiscale/P.IVA Sub-Appaltatore")).alias("sub_cf"), _text(df, "CIG").alias("tender_cig"), _text(df, "CUP").alias("project_cup"),
        _text(df, "Descrizione Ruolo Soggetto Correlato").alias("role"), _text(df, "Codice ATECO Sub-Appaltatore").alias("ateco"), _text(df, "Data di Estrazione").alias("data_estrazione"),
    )
    return rows.where("sub_cf IS NOT NULL AND sub_cf <> '' AND tender_cig IS NOT NULL AND tender_cig <> ''")


# -- corporate structure


#: Headers of corporate files, without spaces, dots and dashes, by what they hold.
CORPORATE_HEADERS = {
    "company": ("cfazienda", "companycf", "codicefiscaleazienda", "cf", "aziendacf", "partitaiva", "piva", "vatnumber"),
    "person": ("cfpersona", "personcf", "codicefiscalepersona", "cfamministratore", "cfdirettore", "cfsocio", "personalcf"),
    "shareholder": ("cfazionista", "shareholdercf", "cfsocio", "cfpartner", "cfpersona", "personcf", "codicefiscalepersona", "cfamministratore", "cfdirettore", "personalcf"),
    "role": ("ruolo", "role", "carica", "incarico", "tipocarica"),
    "quota": ("quota", "percentuale", "share", "ownership", "quotasociale"),
    "first_name": ("nome",), "last_name": ("cognome",), "start": ("datainizio", "datastart", "inizio"), "end": ("datafine", "dataend", "fine"), "seen": ("datarilevazione", "data", "date"),
}


def corporate_columns(df: DataFrame) -> dict[str, str]:
    """The column of df for each of CORPORATE_HEADERS that it has."""
    out = {}
    for what, known in CORPORATE_HEADERS.items():
        for c in df.columns:
            if plain(c) in known:
                out.setdefault(what, c)
    return out


def corporate_kind(df: DataFrame) -> str:
    """directors (company, person, role), shareholders (company, shareholder, quota), generic (company and either) or unknown."""
    have = corporate_columns(df).keys()
    if {"company", "person", "role"} <= have:
        return "directors"
    if {"company", "shareholder", "quota"} <= have:
        return "shareholders"
    return "generic" if "company" in have and ("person" in have or "shareholder" in have) else "unknown"


def _clean(df: DataFrame, at: dict[str, str], what: str, code: bool = False) -> Column:
    if what not in at:
        return F.lit(None).cast("string")
    t = F.trim(F.col(f"`{at[what]}`").cast("string"))
    return F.upper(t) if code else t


def corporate(files: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, represents, shareholdings) of all files, by their headers; files of an unknown kind give nothing.

    persons (cf, nome, cognome), one row a tax code; represents (person_cf, company_cf, ruolo, data_inizio, data_fine);
    shareholdings (source_cf, company_cf, quota in 0 to 100, data_rilevazione). Rows without a needed code are left out.
    """
    spark = files[0].sparkSession
    persons = spark.createDataFrame([], "cf string, nome string, cognome string")
    seats = spark.createDataFrame([], "person_cf string, company_cf string, ruolo string, data_inizio string, data_fine string")
    shares = spark.createDataFrame([], "source_cf string, company_cf string, quota double, data_rilevazione string")
    for df in files:
        at, kind = corporate_columns(df), corporate_kind(df)
        if kind == "directors" or (kind == "generic" and "role" in at and "person" in at):
            rows = df.select(_clean(df, at, "person", True).alias("cf"), F.coalesce(_clean(df, at, "first_name"), F.lit("")).alias("nome"), F.coalesce(_clean(df, at, "last_name"), F.lit("")).alias("cognome"), _clean(df, at, "company", True).alias("company_cf"), _clean(df, at, "role").alias("ruolo"), _clean(df, at, "start").alias("data_inizio"), _clean(df, at, "end").alias("data_fine")).where("cf IS NOT NULL AND cf <> ''")
            persons = persons.union(rows.select("cf", "nome", "cognome"))
            seats = seats.union(rows.where("company_cf IS NOT NULL AND company_cf <> ''").select(F.col("cf").alias("person_cf"), "company_cf", "ruolo", "data_inizio", "data_fine"))
        if kind == "shareholders" or (kind == "generic" and "quota" in at and "shareholder" in at):
            quota = F.least(F.lit(100.0), F.greatest(F.lit(0.0), parse_amount(_clean(df, at, "quota"))))
            rows = df.select(_clean(df, at, "shareholder", True).alias("source_cf"), _clean(df, at, "company", True).alias("company_cf"), quota.alias("quota"), _clean(df, at, "seen").alias("data_rilevazione"))
            shares = shares.union(rows.where("source_cf IS NOT NULL AND source_cf <> '' AND company_cf IS NOT NULL AND company_cf <> ''"))
    return _one_each(persons, "cf"), seats.distinct(), shares.distinct()


# -- texts


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, pieces): whole text or HTML files with tags, scripts and styles taken out, and their overlapping pieces."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    html = F.col("path").rlike(r"(?i)\.html?$")
    bare = F.regexp_replace(F.regexp_replace("value", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    plain_text = F.trim(F.regexp_replace(bare, r"[ \t]+", " "))
    rows = rows.select("path", F.when(html, plain_text).otherwise(F.col("value")).alias("text"))
    return rows.withColumn("pieces", chunks(F.col("text")))
