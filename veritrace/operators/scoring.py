"""Risk tiers and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(score: str, high: float = 0.7, medium: float = 0.4) -> Column:
    c = F.col(score)
    return F.when(c >= high, "HIGH").when(c >= medium, "MEDIUM").otherwise("LOW")


def _n(x: str) -> Column:
    return F.coalesce(F.col(x).cast("double"), F.lit(0.0))


def base_risk(features: DataFrame) -> DataFrame:
    """features (wins, single_wins, top_buyer_wins, centrality) -> score in 0..1 and flags.

    Over 2 wins: 0.4 times the share of single-bidder wins, and its flag even at a share of 0. Centrality over
    0.5: 0.3. Over 3 wins with more than 0.8 of them from one buyer: 0.3.
    """
    single = F.when(_n("wins") > 2, 0.4 * _n("single_wins") / _n("wins")).otherwise(0.0)
    central = F.when(_n("centrality") > 0.5, 0.3).otherwise(0.0)
    loyal = (_n("wins") > 3) & (_n("top_buyer_wins") / F.greatest(_n("wins"), F.lit(1.0)) > 0.8)
    flags = F.array_compact(F.array(
        F.when(_n("wins") > 2, F.lit("single_bidder")), F.when(_n("centrality") > 0.5, F.lit("high_centrality")), F.when(loyal, F.lit("buyer_concentration"))))
    return features.withColumn("score", F.least(F.lit(1.0), single + central + F.when(loyal, 0.3).otherwise(0.0))).withColumn("flags", flags)


def enrich(features: DataFrame) -> DataFrame:
    """features (total, avg_value, single, top_buyer) -> score: single share over 0.5: 0.3, top buyer's share over 0.7: 0.2, mean over 5 million: 0.1."""
    total = F.greatest(_n("total"), F.lit(1.0))
    score = F.when(_n("single") / total > 0.5, 0.3).otherwise(0.0) + F.when(_n("top_buyer") / total > 0.7, 0.2).otherwise(0.0) + F.when(_n("avg_value") > 5e6, 0.1).otherwise(0.0)
    return features.withColumn("score", F.round(F.least(F.lit(1.0), score), 2))


def legacy_shell(features: DataFrame) -> DataFrame:
    """features (wins, employees, depth) -> score: mean of wins / 100 (not capped), few employees (unknown: half) and ownership depth; rounded to 3 places."""
    few = F.when(F.col("employees") == -1, 0.5).when(F.col("employees") <= 5, 1.0).otherwise(0.0)
    deep = F.when(F.col("depth") >= 3, 1.0).when(F.col("depth") >= 1, 0.5).otherwise(0.0)
    return features.withColumn("shell_score", F.round((F.col("wins") / 100 + few + deep) / 3, 3))


def enhanced_shell(features: DataFrame, year: int) -> DataFrame:
    """features (wins, employees, depth, vat_active, last_filing_year, boards, sub_only, shared_address) -> weighted shell score, its tier.

    Weights: 0.30 legacy, 0.15 VAT, 0.15 dormancy, 0.15 boards, 0.10 subcontracts only, 0.10 address, 0.05 depth.
    """
    cap = lambda c: F.least(c, F.lit(1.0))
    w, d, b = _n("wins"), _n("depth"), _n("boards")
    legacy = (cap(w / 3) + (1 - cap(_n("employees") / 5)) + cap(d / 10)) / 3
    inactive = ~F.coalesce(F.col("vat_active"), F.lit(True))
    vat = F.when(inactive & (w >= 3), 1.0).when(inactive & (w > 0), 0.5).otherwise(0.0)
    silent = F.lit(year) - F.col("last_filing_year")
    dormant = F.when(silent >= 2, cap(silent / 4)).otherwise(0.0)
    boards = F.when(b >= 20, cap(b / 40)).when(b > 10, 0.4).otherwise(0.0)
    sub = F.when(F.coalesce(F.col("sub_only"), F.lit(False)), 1.0).otherwise(0.0)
    deep = F.when(d > 5, cap(d / 8)).otherwise(0.0)
    score = 0.30 * legacy + 0.15 * vat + 0.15 * dormant + 0.15 * boards + 0.10 * sub + 0.10 * cap(_n("shared_address") / 3) + 0.05 * deep
    out = features.withColumn("shell_score", score)
    return out.withColumn("risk_tier", F.when(score >= 0.5, "HIGH_RISK").when(score >= 0.35, "MEDIUM_RISK").otherwise("LOW_RISK"))
