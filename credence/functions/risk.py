"""Year-on-year change and risk-flag expressions over the wide company row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.config import RISK_FLAG_TO_CODE, RiskSettings


def drop_pct(base: Column, target: Column) -> Column:
    """Percentage lost from base to target; NULL unless base is positive."""
    return F.when(base > 0, (base - target) / base * 100)


def holds(condition: Column) -> Column:
    """The condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def change_columns(columns: Iterable[str], settings: RiskSettings) -> dict[str, Column]:
    have = set(columns)
    out = {}
    for measure in ("revenue", "assets"):
        base, target = f"{measure}_{settings.base_year}", f"{measure}_{settings.target_year}"
        if {base, target} <= have:
            out[f"{measure}_drop_{settings.target_year}_pct"] = drop_pct(F.col(base), F.col(target))
    return out


def flag_columns(columns: Iterable[str], settings: RiskSettings) -> dict[str, Column]:
    """The risk flags whose inputs exist; the data-quality flag is always there.

    The limits are inclusive although two of the names say "gt".
    """
    have, year = set(columns), settings.target_year
    rules = {
        "risk_revenue_drop_gt_30": (f"revenue_drop_{year}_pct", lambda c: c >= settings.revenue_drop_pct),
        "risk_negative_profit": (f"net_profit_{year}", lambda c: c < 0),
        "risk_assets_drop_gt_25": (f"assets_drop_{year}_pct", lambda c: c >= settings.assets_drop_pct),
        "risk_negative_equity": (f"equity_{year}", lambda c: c < 0),
    }
    out = {name: holds(test(F.col(source))) for name, (source, test) in rules.items() if source in have}
    quality = F.lit(False)
    for source, bad in (("filed", 0.0), ("imputed", 1.0), ("outlier", 1.0)):
        if f"{source}_{year}" in have:
            quality = quality | holds(F.col(f"{source}_{year}") == bad)
    out["risk_data_quality_issue"] = quality
    return out


def risk_count(flags: Iterable[str]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + F.col(flag).cast("int")
    return total


def risk_codes(flags: Iterable[str]) -> Column:
    """Codes of the raised flags, in the fixed order."""
    codes = [F.when(F.col(f), F.lit(RISK_FLAG_TO_CODE[f])) for f in flags]
    return F.filter(F.array(*codes), lambda code: code.isNotNull())
