import math

import pytest
from pyspark.sql import functions as F

from credence.config import COMPANY_LABEL_PREFIX, REPORT_COLUMNS, RiskSettings
from credence.operators.reports import (
    company_dim,
    company_features,
    financial_reports,
    two_year_reports,
    wide_values,
    with_risk_flags,
)
from credence.operators.sampling import bounded_sample, sample_keys, stratified_sample
from credence.plans.prepare import transform_reports
from credence.sources.yearly import clean_year, discover_years, load_years, schema_groups

KEYS = "inn string, ogrn string, region string, region_taxcode string, okved_section string"


@pytest.fixture()
def yearly(spark, tmp_path):
    """Three yearly folders whose files differ in columns and types."""
    root = str(tmp_path / "reports")
    spark.createDataFrame(
        [("1", "11", "A", "7700", "C", 5, "100")], KEYS + ", age int, line_2110 string"
    ).write.parquet(f"{root}/year=2022")
    spark.createDataFrame(
        [
            (" 1\t", "11", "A", " 7700", "C", 6.0, 100.0, 50.0, 1.0),
            ("1", "11", "second", "7700", "C", 6.0, 999.0, 50.0, 1.0),
            ("2", "12", "B", "9999", "C", 1.0, 10.0, 1.0, 1.0),
            ("3", None, "B", "7700", "C", 1.0, 10.0, 1.0, 1.0),
            ("4", "14", "B", "7700", "Z", 1.0, 10.0, 1.0, 1.0),
            ("5", "15", "B", "5000", "G", 1.0, 10.0, 1.0, 1.0),
            ("6", "16", "B", None, "G", 1.0, 10.0, 1.0, 1.0),
        ],
        KEYS + ", age double, line_2110 double, line_1600 double, filed double",
    ).coalesce(1).write.parquet(f"{root}/year=2023")
    spark.createDataFrame(
        [("1", "11", None, "7700", "C", 7, "65", "40.0", "-1", 1)],
        KEYS + ", age int, line_2110 string, line_1600 string, line_2400 string, filed int",
    ).write.parquet(f"{root}/year=2024")
    return root


def test_discovery_and_schema_adaptive_union(spark, yearly):
    assert list(discover_years(spark, yearly)) == [2022, 2023, 2024]
    raw = load_years(spark, yearly)
    assert {(r.inn, r.year) for r in raw.collect()} == {("1", 2022), ("1", 2023), ("5", 2023), ("1", 2024)}
    assert dict(raw.dtypes)["revenue"] == "double" and dict(raw.dtypes)["year"] == "int"
    with pytest.raises(FileNotFoundError):
        discover_years(spark, yearly + "/year=2022")


def test_every_folder_of_a_year_is_read(spark, tmp_path):
    """Several folders of one year, at several depths, with columns of different types."""
    root = tmp_path / "deep.er (1)"
    for inn, place, kind in (("1", "a/year=2023", "int"), ("2", "a/year=2024", "double"), ("3", "b/year=2024", "string"), ("4", "c/d/year=2022", "int")):
        rows = spark.createDataFrame([(inn, "11", "A", "7700", "C", 5)], KEYS + ", line_2110 int")
        rows.withColumn("line_2110", F.col("line_2110").cast(kind)).write.parquet(f"{root}/{place}")
    assert {y: len(f) for y, f in discover_years(spark, str(root)).items()} == {2022: 1, 2023: 1, 2024: 2}
    rows = load_years(spark, f"file://{root}").select("inn", "year", "revenue").collect()
    assert sorted(map(tuple, rows)) == [("1", 2023, 5.0), ("2", 2024, 5.0), ("3", 2024, 5.0), ("4", 2022, 5.0)]


def test_first_report_of_a_year_wins_by_file_order(spark, yearly):
    reports = financial_reports(load_years(spark, yearly))
    assert [c for c in REPORT_COLUMNS if c in reports.columns] == reports.columns
    assert reports.filter("inn = '1' AND year = 2023").collect()[0].region == "A"


def test_two_years_dimension_and_features(spark, yearly):
    reports = financial_reports(load_years(spark, yearly))
    both = two_year_reports(reports)
    assert {(r.inn, r.year) for r in both.collect()} == {("1", 2023), ("1", 2024)}
    dim = company_dim(both).first()
    # The last year has no region, so the one before counts; other columns come from the last year.
    assert (dim.region, dim.age, dim.company_label) == ("A", 7, COMPANY_LABEL_PREFIX + "1")
    row = company_features(reports).first()
    assert row.revenue_drop_2024_pct == 35.0 and row.risk_revenue_drop_gt_30
    assert row.assets_drop_2024_pct == 20.0 and not row.risk_assets_drop_gt_25
    assert row.risk_negative_profit and not row.risk_data_quality_issue
    assert "risk_negative_equity" not in row.asDict() and row.risk_count == 2
    assert wide_values(both).first().revenue_2023 == 100.0


def flags(spark, **values):
    columns = {
        "revenue_2023": 100.0, "revenue_2024": 100.0, "assets_2023": 100.0, "assets_2024": 100.0,
        "net_profit_2024": 1.0, "equity_2024": 1.0, "filed_2024": 1.0, "imputed_2024": 0.0, "outlier_2024": 0.0,
    } | values
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} double" for c in columns))
    return with_risk_flags(df).first()


def test_limits_are_inclusive(spark):
    row = flags(spark, revenue_2024=70.0, assets_2024=75.0)
    assert row.risk_revenue_drop_gt_30 and row.risk_assets_drop_gt_25 and row.risk_count == 2


def test_base_of_zero_gives_no_percentage(spark):
    row = flags(spark, revenue_2023=0.0, assets_2023=None)
    assert row.revenue_drop_2024_pct is None and row.assets_drop_2024_pct is None and row.risk_count == 0


def test_nan_counts_as_larger_than_any_limit(spark):
    row = flags(spark, revenue_2024=float("nan"))
    assert math.isnan(row.revenue_drop_2024_pct) and row.risk_revenue_drop_gt_30


def test_quality_flag_reads_null_as_fine(spark):
    assert not flags(spark, filed_2024=None, imputed_2024=None).risk_data_quality_issue
    assert flags(spark, filed_2024=0.0).risk_data_quality_issue
    assert flags(spark, outlier_2024=1.0).risk_data_quality_issue


def test_filters_are_skipped_without_a_list(spark):
    df = spark.createDataFrame([("1", "2", "A", "1", "Z")], KEYS)
    open_settings = RiskSettings(region_taxcodes=(), okved_sections=())
    assert clean_year(df, 2023, open_settings).count() == 1
    assert clean_year(df, 2023).count() == 0


def many(spark, n=400):
    return spark.range(n).select(
        F.format_string("%05d", "id").alias("inn"),
        F.lit(10.0).alias("revenue_2024"),
        F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("net_profit_2024"),
        (F.col("id") % 4 == 1).alias("risk_revenue_drop_gt_30"),
        (F.col("id") % 3 == 0).alias("risk_negative_profit"),
        (F.col("id") % 5 == 2).alias("risk_assets_drop_gt_25"),
        F.lit(False).alias("risk_negative_equity"),
        (F.col("id") < 5).alias("risk_data_quality_issue"),
    )


def test_sample_is_exclusive_sized_and_repeatable(spark):
    features = many(spark)
    rows = stratified_sample(features).collect()
    assert len({r.inn for r in rows}) == len(rows)
    counts = {}
    for r in rows:
        counts[r.sample_bucket] = counts.get(r.sample_bucket, 0) + 1
        if r.sample_bucket == "normal":
            assert r.net_profit_2024 > 0 and not r.risk_revenue_drop_gt_30 and not r.risk_assets_drop_gt_25
    assert counts["normal"] == 30 and counts["revenue_drop_gt_30"] == 20 and counts["negative_profit"] == 20
    assert counts["assets_drop_gt_25"] == 15 and counts["data_quality_issue"] <= 5
    again = {(r.inn, r.sample_bucket) for r in sample_keys(features.repartition(9)).collect()}
    assert again == {(r.inn, r.sample_bucket) for r in rows}


def test_sample_equals_the_step_by_step_draw(spark):
    import hashlib

    rows = [r.asDict() for r in many(spark).collect()]
    taken = {}
    draws = [("normal", 30), ("risk_revenue_drop_gt_30", 20), ("risk_negative_profit", 20),
             ("risk_assets_drop_gt_25", 15), ("risk_data_quality_issue", 15)]
    for i, (flag, n) in enumerate(draws):
        if flag == "normal":
            pool = [r for r in rows if r["revenue_2024"] > 0 and r["net_profit_2024"] > 0
                    and not any(v for k, v in r.items() if k.startswith("risk_"))]
        else:
            pool = [r for r in rows if r[flag] and r["inn"] not in taken]
        pool.sort(key=lambda r: hashlib.md5(f"{r['inn']}:{42 + i}".encode()).hexdigest())
        taken |= {r["inn"]: flag.removeprefix("risk_") for r in pool[:n]}
    assert {(r.inn, r.sample_bucket) for r in sample_keys(many(spark)).collect()} == set(taken.items())


def test_bounded_sample(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("inn"))
    assert bounded_sample(df, 5, 1).count() == 5
    assert bounded_sample(df, 50, 1).count() == 20
    assert bounded_sample(df.limit(0), 5, 1).count() == 0


def test_empty_bucket_columns_still_sample(spark):
    features = many(spark).drop("risk_assets_drop_gt_25", "risk_data_quality_issue")
    assert {r.sample_bucket for r in sample_keys(features).collect()} == {"normal", "revenue_drop_gt_30", "negative_profit"}


def test_transform_gives_three_tables(spark, yearly):
    company, report, features = transform_reports(load_years(spark, yearly))
    assert company.first().sample_bucket == "revenue_drop_gt_30"
    assert report.count() == 2 and features.first().risk_count == 2
    assert features.columns[:3] == ["inn", "ogrn", "sample_bucket"]


def test_files_of_one_folder_may_type_a_column_differently(spark, tmp_path):
    folder = f"{tmp_path}/year=2023"
    base = spark.createDataFrame([(f"{i:010d}", "1", "7700", "C") for i in range(8)], "inn string, ogrn string, region_taxcode string, okved_section string")
    texts = base.withColumn("line_2110", F.concat("inn", F.lit(".5")))
    numbers = base.withColumn("line_2110", F.col("inn").cast("double"))
    for rows in (texts.filter("inn < '0000000002'"), numbers.filter("inn between '0000000002' and '0000000004'"), texts.filter("inn > '0000000004'"), base.limit(1).withColumn("inn", F.lit("9"))):
        rows.coalesce(1).write.mode("append").parquet(folder)
    groups = schema_groups(spark, folder)
    assert sorted(len(g) for g in groups) in ([1, 3], [2, 2], [1, 1, 2]) and sum(map(len, groups)) == 4
    found = {r.inn: r.revenue for r in load_years(spark, str(tmp_path)).collect()}
    expected = {f"{i:010d}": i + (0.0 if 2 <= i <= 4 else 0.5) for i in range(8)} | {"9": None}
    assert found == expected
    assert schema_groups(spark, folder + "/") != [[folder]]
