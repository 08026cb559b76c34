"""Codes of municipalities and provinces by their names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes that hold where no table of places is given.
CITIES = {
    "MILANO": "015146", "ROMA": "058091", "TORINO": "001272", "NAPOLI": "063049", "PALERMO": "082053",
    "GENOVA": "010025", "BOLOGNA": "037006", "FIRENZE": "048017", "BARI": "072006", "CATANIA": "087015",
}
PROVINCES = {"MILANO": "MI", "ROMA": "RM", "TORINO": "TO", "NAPOLI": "NA"}


def _plain(name: Column) -> Column:
    return F.upper(F.trim(name))


def _one(values: dict[str, str], name: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), name)


def with_city_code(rows: DataFrame, city: str, places: DataFrame | None = None, out: str = "cod_istat") -> DataFrame:
    """rows with the code of the municipality that a column names, case and outer blanks aside; null where there is none.

    places has nome and cod_istat, of which a name's least code counts; without it CITIES are known.
    """
    if places is None:
        return rows.withColumn(out, _one(CITIES, _plain(F.col(city))))
    codes = places.where("nome IS NOT NULL").groupBy(_plain(F.col("nome")).alias("_name")).agg(F.min("cod_istat").alias("_code"))
    return rows.join(codes, _plain(rows[city]) == codes["_name"], "left").withColumn(out, F.col("_code")).drop("_name", "_code")


def with_province_code(rows: DataFrame, province: str, places: DataFrame | None = None, out: str = "sigla") -> DataFrame:
    """rows with the two letters of a province: those of its name in places (nome, sigla) or PROVINCES, else the name's first two; empty for none."""
    name = _plain(F.col(province))
    rest = F.coalesce(F.substring(name, 1, 2), F.lit(""))
    if places is None:
        return rows.withColumn(out, F.coalesce(_one(PROVINCES, name), rest))
    codes = places.where("nome IS NOT NULL").groupBy(_plain(F.col("nome")).alias("_name")).agg(F.min("sigla").alias("_code"))
    return rows.join(codes, _plain(rows[province]) == codes["_name"], "left").withColumn(out, F.coalesce("_code", rest)).drop("_name", "_code")
