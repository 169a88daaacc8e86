"""From yearly report files to the prepared, validated and exported tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.config import RiskSettings
from credence.operators import checks
from credence.operators.reports import company_features, financial_reports, output_tables, two_year_reports
from credence.operators.sampling import sample_keys
from credence.session import settle
from credence.sources.export import export_tables
from credence.sources.seeds import DEMO_COMPANY_NAME, demo_bundle
from credence.sources.yearly import ROW_ORDER, load_years


def transform_reports(
    raw: DataFrame, settings: RiskSettings = RiskSettings(), order: tuple[str, ...] = tuple(ROW_ORDER)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Company, report and feature tables of the stratified sample, from cleaned yearly rows.

    Features are computed for every company once to draw the sample (flags only survive
    column pruning), then again for the at most 100 sampled companies with all columns.
    """
    reports = settle(financial_reports(raw, order))
    keys = settle(sample_keys(company_features(reports, settings), settings))
    chosen = reports.join(F.broadcast(keys.select("inn")), "inn", "left_semi")
    sample = company_features(chosen, settings).join(F.broadcast(keys), "inn")
    return output_tables(sample, two_year_reports(chosen, settings), settings)


def prepare(
    spark: SparkSession,
    root: str,
    settings: RiskSettings = RiskSettings(),
    export_to: tuple[str, ...] = (),
    company_name: str = DEMO_COMPANY_NAME,
) -> dict[str, DataFrame]:
    """Runs the whole preparation over the files below `root`; optionally exports to the given folders."""
    company, report, features = transform_reports(load_years(spark, root, settings), settings)
    tables = {"company": settle(company), "financial_report": settle(report), "company_features": settle(features)}
    inn = tables["company"].agg(F.min("inn")).first()[0]
    if inn is None:
        raise checks.DataValidationError("the company table is empty")
    tables |= demo_bundle(spark, inn, company_name)
    for folder in export_to:
        export_tables(tables, folder)
    return tables
