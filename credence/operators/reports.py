"""Report table, two-year filter, company dimension, wide features and risk flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import (
    COMPANY_COLUMNS,
    COMPANY_LABEL_PREFIX,
    FLAG_COLUMNS,
    MEASURE_COLUMNS,
    REPORT_COLUMNS,
    RISK_COLUMNS,
    RiskSettings,
)
from credence.functions.risk import change_columns, flag_columns, risk_count
from credence.operators.grouping import first_by
from credence.sources.yearly import ROW_ORDER


def financial_reports(raw: DataFrame, order: Sequence[str] = tuple(ROW_ORDER)) -> DataFrame:
    """Report columns in their fixed order, one row per (inn, year): the first in `order`."""
    columns = [c for c in REPORT_COLUMNS if c in raw.columns]
    extra = [c for c in order if c not in columns]
    kept = first_by(raw.select(*columns, *extra), ["inn", "year"], list(order), drop_order=False)
    return kept.select(*columns)


def _has_year(year: int) -> Column:
    return F.max(F.col("year") == year)


def companies_with_years(reports: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """Keys of the companies that reported in every required year."""
    marks = {f"_y{y}": _has_year(y) for y in settings.years}
    marked = reports.filter(F.col("year").isin(*settings.years)).groupBy("inn")
    return marked.agg(*[m.alias(n) for n, m in marks.items()]).filter(" AND ".join(marks)).select("inn")


def two_year_reports(reports: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """Reports of the required years, for companies that have them all."""
    keys = companies_with_years(reports, settings)
    return reports.filter(F.col("year").isin(*settings.years)).join(keys, "inn", "left_semi")


def _latest(columns: Sequence[str]) -> list[Column]:
    """Per column the value of the last year in which it is not NULL."""
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("year"))).alias(c) for c in columns]


def _wide(columns: Sequence[str], settings: RiskSettings) -> list[Column]:
    """{column}_{year}; (inn, year) is unique, so max() is just the one value."""
    return [
        F.max(F.when(F.col("year") == year, F.col(c))).alias(f"{c}_{year}")
        for year in settings.years
        for c in MEASURE_COLUMNS + FLAG_COLUMNS
        if c in columns
    ]


def _label() -> Column:
    return F.concat(F.lit(COMPANY_LABEL_PREFIX), F.col("inn"))


def _attributes(reports: DataFrame) -> list[str]:
    return [c for c in COMPANY_COLUMNS if c != "inn" and c in reports.columns]


def company_dim(reports_2y: DataFrame) -> DataFrame:
    dim = reports_2y.groupBy("inn").agg(*_latest(_attributes(reports_2y)))
    return dim.withColumn("company_label", _label())


def wide_values(reports_2y: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    return reports_2y.groupBy("inn").agg(*_wide(reports_2y.columns, settings))


def with_risk_flags(wide: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """Adds the year-on-year changes, the risk flags and their count."""
    changed = wide.withColumns(change_columns(wide.columns, settings))
    flagged = changed.withColumns(flag_columns(changed.columns, settings))
    present = [c for c in RISK_COLUMNS if c in flagged.columns]
    return flagged.withColumn("risk_count", risk_count(present))


def company_features(reports: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """Company dimension, wide values and risk flags of the companies with every required year.

    The year test, the dimension and the pivot are one aggregate by inn, so the reports
    shuffle once and neither the semi-join nor the dimension join is needed.
    """
    years = reports.filter(F.col("year").isin(*settings.years))
    marks = [f"_y{y}" for y in settings.years]
    wide = (
        years.groupBy("inn")
        .agg(
            *[_has_year(y).alias(m) for y, m in zip(settings.years, marks)],
            *_latest(_attributes(reports)),
            *_wide(reports.columns, settings),
        )
        .filter(" AND ".join(marks))
        .drop(*marks)
        .withColumn("company_label", _label())
    )
    return with_risk_flags(wide, settings)


def feature_columns(settings: RiskSettings) -> list[str]:
    base, target = settings.years
    both = lambda name: [f"{name}_{base}", f"{name}_{target}"]
    return [
        "inn", "ogrn", "sample_bucket",
        *both("revenue"), f"revenue_drop_{target}_pct", *both("net_profit"),
        *both("assets"), f"assets_drop_{target}_pct", *both("equity"),
        *both("filed"), *both("imputed"), *both("outlier"),
        *RISK_COLUMNS, "risk_count",
    ]


def output_tables(
    sample: DataFrame, reports_2y: DataFrame, settings: RiskSettings = RiskSettings()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Company, report and feature tables of the sampled companies, in their fixed column orders."""
    company = sample.select(
        *[c for c in [*COMPANY_COLUMNS, "company_label", "sample_bucket"] if c in sample.columns]
    )
    # The sample has at most sum(bucket_sizes) keys.
    keys = F.broadcast(sample.select("inn"))
    report = reports_2y.join(keys, "inn", "left_semi").select(
        *[c for c in REPORT_COLUMNS if c in reports_2y.columns]
    )
    features = sample.select(*[c for c in feature_columns(settings) if c in sample.columns])
    return company, report, features
