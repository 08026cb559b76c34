"""Readers on small files with known rows."""

import json

import pytest
from pyspark.sql import functions as F

from veritrace.functions import text
from veritrace.sources import imports, readers


def test_releases(spark, tmp_path):
    first = {"ocid": "ocds-zz-4471/2", "tender": {"title": "Ponte J11B20000990003", "value": {"amount": 81500.5}, "procurementMethod": "open"}, "parties": [{"id": "B7", "name": "Comune Uno", "roles": ["buyer"]}, {"id": "X", "roles": ["tenderer"]}],
             "awards": [{"id": "k", "date": "2023-05-06T10:00:00Z", "value": {"amount": 80000}, "suppliers": [{"id": "00112233445", "name": "Alfa Ponti S.p.A."}, {"id": "Q9", "name": "Beta"}]}, {"id": "l", "suppliers": [{"id": "", "name": "none"}]}]}
    second = {"ocid": "ocds-zz-4472", "tender": {"title": "Scuola", "value": {}}, "awards": [{"date": "oggi", "suppliers": [{"id": "00112233445", "name": "ALFA (nuova)"}]}]}
    (tmp_path / "p.json").write_text(json.dumps({"releases": [first]}))
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"releases": [second, first]}, {"releases": []}]}))
    rel = readers.releases(spark, f"{tmp_path}/*.json")
    assert [(r["cig"], r["importo"], r["procedura"], r["cup"]) for r in readers.tenders(rel).collect()] == [("4471", 81500.5, "open", "J11B20000990003")]
    assert sorted((r["cf"], r["cig"], str(r["data"])) for r in readers.wins(rel).collect()) == [("", "4471", "None"), ("00112233445", "4471", "2023-05-06"), ("00112233445", "4472", "None"), ("Q9", "4471", "2023-05-06")]
    assert {(r["cf"], r["piva"], r["nome_normalizzato"]) for r in readers.companies(rel).collect()} == {("00112233445", "IT00112233445", "ALFA PONTI"), ("Q9", None, "BETA")}
    assert [(r["cf"], r["nome"]) for r in readers.buyers(rel).collect()] == [("B7", "Comune Uno")]


def test_projects(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Cup;FONDI_UE;Titolo;COSTO_PROGETTO;DATA_INIZIO;COMUNE;CF_SOGGETTO_TITOLARE\nK1;PNRR;Uno;1.250,75;2022-03-04T00;Bari;ab1\nK2; FESR , PON ; null ;x;;n/a;\n;PNRR;x;1;;;\nK3;too;few\nK4;a;b;1;;;;;many\n")
    df = readers.csv(spark, str(tmp_path / "p.csv"))
    p = {r["cup"]: r for r in readers.projects(df).collect()}
    assert sorted(p) == ["K1", "K2"]
    assert (p["K1"]["importo_previsto"], str(p["K1"]["data_inizio"]), p["K2"]["importo_previsto"], p["K2"]["titolo"], p["K2"]["regione"], p["K2"]["fondi"]) == (1250.75, "2022-03-04", 0.0, "", "Unknown", ["FESR", "PON"])
    assert {(r["nome"], r["tipo"]) for r in readers.funding_sources(readers.projects(df)).collect()} == {("PNRR", "PNRR"), ("FESR", "FESR"), ("PON", "PON")}
    assert [(r["cup"], r["comune"]) for r in readers.localisations(df).collect()] == [("K1", "Bari")]
    assert [(r["cup"], r["cf"]) for r in readers.subjects(df).collect()] == [("K1", "AB1")]
    assert readers.csv(spark, str(tmp_path / "p.csv"), bad="bad").where("bad IS NOT NULL").count() == 2


def test_places(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("Codice Comune formato alfanumerico;Denominazione in italiano;Sigla automobilistica;Codice Regione;Denominazione Regione;Codice Unità territoriale sovracomunale;Popolazione\n072006;Forlì;FC;08;Emilia;240;118.359\n;x;y;z;w;v;\n072006;Forlì;FC;08;Emilia;240;118.359\n099;Òra;BZ;04;;;\n".encode("latin-1"))
    df = readers.csv(spark, str(tmp_path / "c.csv"), encoding="ISO-8859-1")
    assert sorted((r["cod_istat"], r["nome"], r["popolazione"]) for r in readers.municipalities(df).collect()) == [("072006", "Forlì", 118359), ("099", "Òra", None)]
    assert sorted((r["cod_regione"], r["nome"]) for r in readers.regions(df).collect()) == [("04", None), ("08", "Emilia"), ("z", "w")]
    assert sorted((r["cod_provincia"], r["sigla"]) for r in readers.provinces(df).collect()) == [("240", "FC"), ("v", "y")]
    with pytest.raises(ValueError):
        readers.municipalities(df.select("Popolazione"))


def test_plan(spark):
    s = spark.createDataFrame([(" 77 ", "Gamma", "SRL", "41", "C1", "Attuatore", "M1", "d"), ("77", "Gamma bis", "SRL", "42", "C2", None, None, None), (None, "no", None, None, "C3", None, None, None)], ["Codice Fiscale Soggetto", "Denominazione", "Descrizione Forma Giuridica", "Codice ATECO", "CUP", "Descrizione del Ruolo del Soggetto", "Codice Univoco Submisura", "Descrizione Submisura"])
    assert [(r["cf"], r["nome_normalizzato"]) for r in readers.plan_companies(s).collect()] == [("77", "GAMMA")]
    assert sorted(r["project_cup"] for r in readers.involvement(s).collect()) == ["C1", "C2"]
    sub = spark.createDataFrame([("8", "Delta", "G1"), ("", "x", "G2"), ("9", "Eta", None)], ["Codice Fiscale/P.IVA Sub-Appaltatore", "Denominazione Sub-Appaltatore", "CIG"])
    assert [(r["sub_cf"], r["tender_cig"], r["role"]) for r in readers.sub_contracts(sub).collect()] == [("8", "G1", None)]
    assert sorted(r["cf"] for r in readers.plan_companies(sub, True).collect()) == ["8", "9"]


def test_corporate(spark):
    d = spark.createDataFrame([("c1", " p1 ", "Presidente", "Ada", "Verdi"), ("c1", "P1", "Socia", "Ada", "Verdi"), ("", "p2", "x", "B", "C"), ("c2", None, "x", "", "")], ["CF Azienda", "CF_Persona", "Carica", "Nome", "Cognome"])
    h = spark.createDataFrame([("c1", "c9", "120"), ("c2", "p1", "33,5"), ("c3", "p1", "-1"), (None, "p1", "3")], ["cf-azienda", "CF_Azionista", "Quota"])
    assert [readers.corporate_kind(x) for x in (d, h, d.select("Carica"), d.select("CF Azienda", "CF_Persona"))] == ["directors", "shareholders", "unknown", "generic"]
    persons, seats, shares = readers.corporate([d, h, d.select("Carica")])
    assert sorted(r["cf"] for r in persons.collect()) == ["P1", "P2"]
    assert sorted((r["person_cf"], r["company_cf"], r["ruolo"]) for r in seats.collect()) == [("P1", "C1", "Presidente"), ("P1", "C1", "Socia")]
    assert sorted((r["source_cf"], r["company_cf"], r["quota"]) for r in shares.collect()) == [("C9", "C1", 100.0), ("P1", "C2", 33.5), ("P1", "C3", 0.0)]


def test_headers():
    m = {x.column: (x.field, x.confidence) for x in imports.match_headers(["Partita IVA", "Ragione Sociale", "CIG", "note", "Importo (EUR)", "Denominazione"])}
    assert m == {"Partita IVA": ("cf", 1.0), "Ragione Sociale": ("nome", 1.0), "CIG": ("cig", 1.0), "Importo (EUR)": ("importo", 0.7)}
    assert imports.node_type(imports.match_headers(["Oggetto gara", "stazione appaltante"])) == "Tender"
    assert imports.match_headers(["a"], {"a": "cf"})[0].node_type == "Company" and imports.node_type([]) == "CustomRecord"


def test_import(spark, tmp_path):
    (tmp_path / "x.csv").write_text('P. IVA,Ditta,Nota\n123,"Uno, due",x\n 123 ,Zeta,y\n,Senza,z\n')
    node, rows = imports.import_rows(imports.read_csv(spark, str(tmp_path / "x.csv")))
    got = {r["key"]: r for r in rows.collect()}
    assert node == "Company" and got["123"]["nome"] == "Zeta" and got[None]["extra"] == {"Nota": "z"} and len(got) == 2
    assert imports.summary(rows).first().asDict() == {"rows_read": 2, "rows_merged": 1, "rows_created": 1}
    checked = imports.check_rows(rows, node)
    assert sorted(map(tuple, (r["errors"] for r in checked.collect()))) == [("cf: invalid",), ("cf: missing",)]
    assert imports.check_rows(spark.createDataFrame([("AB12345678", "1.200,50", None)], "cig string, importo string, oggetto string"), "Tender").first()["errors"] == []
    assert [imports.route(p) for p in ("a/B.CSV", "https://x.it/page?a=1", "https://x.it/f.pdf", "n.docx")] == ["csv", "web", "pdf", "unknown"]


def test_texts(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><style>b{}</style><p>Ciao <b>a</b> tutti</p><script>x<y</script></html>")
    assert readers.texts(spark, str(tmp_path / "a.html")).first()["text"] == "Ciao a tutti"


@pytest.mark.parametrize("raw,want", [("Officine Neri S.r.l.", "OFFICINE NERI"), ("Blu Mare Societa' per Azioni", "BLU MARE"), ("Casa Verdi Società Semplice", "CASA VERDI"), ("Gialli s.s.", "GIALLI"), ("Viola S R L", "VIOLA"), ("Latte Cooperativa", "LATTE COOPERATIVA"), ("Latte Società Cooperativa", "LATTE"), ("L'Orto Così SPA srl", "L ORTO COSI"), ("SNC Marroni", "SNC MARRONI"), (None, None)])
def test_names(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(text.normalize_name(F.col("n"))).first()[0] == want


def test_other_name_forms(spark):
    row = spark.createDataFrame([("Nuove Costruzioni e Servizi della Nazionale S.r.l.s.", "Coop. Ortaggi & C. s.p.a.")], "a string, b string")
    got = row.select(text.loose_name(F.col("a")), text.loose_name(F.col("a"), True), text.first_words(F.col("a")), text.loose_name(F.col("b")), text.core_name(F.col("b")), text.phonetic_key(F.col("a"))).first()
    assert tuple(got) == ("NUOVE COSTRUZIONI E SERVIZI DELLA NAZIONALE", "NUOVE COSTR SERV NAZ", "NUOVE COSTRUZIONI E", "COOP ORTAGGI C", "COOPORTAGGIC", "NV KSTRZ")


def test_values(spark):
    row = spark.createDataFrame([("1.234.567,8", "€ 12,50", "77.5", "1.250", "abc", "62.01", " 1.2.3.4")], "a string, b string, c string, d string, e string, f string, g string")
    got = row.select(*[text.parse_amount(F.col(c)) for c in "abcde"], text.sector(F.col("f")), text.masked_ip(F.trim("g")), text.pseudonym(F.col("a")), text.row_digest(F.col("a"), F.lit(None))).first()
    assert tuple(got)[:7] == (1234567.8, 12.5, 77.5, 1.25, None, "62", "1.2.3.0") and len(got[7]) == 16 and len(got[8]) == 32
    ids = spark.createDataFrame([("cf rssmra85t10a562s, piva IT01234567890, cup J51B21004500001 cig Z9A2B3C4D5",)], "t string").select(*[text.identifier(F.col("t"), k) for k in text.IDENTIFIERS]).first()
    assert tuple(ids) == ("rssmra85t10a562s", "IT01234567890", "J51B21004500001", "IT01234567890")
    pairs = spark.createDataFrame([("ponti alfa", "alfa ponti"), ("abc", "abc"), ("", "x"), ("a", None)], "a string, b string")
    assert [None if r[0] is None else round(r[0], 4) for r in pairs.select(text.weighted_ratio(F.col("a"), F.col("b"))).collect()] == [0.95, 1.0, 0.0, None]
