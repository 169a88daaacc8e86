"""Registered queries of the batch preparation, loading and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.config import RISK_COLUMNS
from credence.functions.columns import (
    date_prefix,
    is_json_list,
    is_json_object,
    json_text,
    parse_metadata,
    parse_roles,
    with_external_id,
)
from credence.functions.risk import risk_codes
from credence.operators import checks, loading
from credence.operators.graph import belongs_to_edges, build_nodes
from credence.operators.grouping import dense_ids
from credence.operators.reports import (
    company_dim,
    company_features,
    financial_reports,
    output_tables,
    two_year_reports,
    wide_values,
)
from credence.operators.sampling import bounded_sample, stratified_sample
from credence.session import ensure_checkpoint_dir
from credence.sources import seeds
from credence.sources.export import SORTED_BY, manifest, reread, write_csv, write_sorted
from credence.sources.yearly import clean_year, load_years, union_years
from credence.testbed.registry import SQL_STEPS, query
from credence.testbed.tables import CLEANING, SETTINGS, Tables

QUALITY = "coalesce(filed_2000 = 0, false) or coalesce(imputed_2000 = 1, false) or coalesce(outlier_2000 = 1, false)"


def _pivot_sql(columns: list[str]) -> str:
    return ",\n".join(
        f"max(case when year = {y} then {c} end) as {c}_{y}" for y in SETTINGS.years for c in columns
    )


SQL_STEPS["two_years"] = (
    ["reports"],
    "select inn from {reports} where year in (1999, 2000) group by inn having count(distinct year) = 2",
)
SQL_STEPS["reports_2y"] = (
    ["reports", "two_years"],
    "select r.* from {reports} r where year in (1999, 2000) and inn in (select inn from {two_years})",
)
SQL_STEPS["dim"] = (
    ["reports_2y"],
    """
select inn, """
    + ", ".join(
        f"arg_max({c}, year) filter (where {c} is not null) as {c}"
        for c in ("ogrn", "region", "region_taxcode", "okved", "okved_section")
    )
    + """, concat('Компания ИНН ', inn) as company_label
from {reports_2y} group by inn""",
)
SQL_STEPS["wide"] = (
    ["reports_2y"],
    "select inn, "
    + _pivot_sql(["revenue", "net_profit", "assets", "equity", "filed", "imputed", "outlier"])
    + " from {reports_2y} group by inn",
)
SQL_STEPS["changes"] = (
    ["wide"],
    """
select *, case when revenue_1999 > 0 then (revenue_1999 - revenue_2000) / revenue_1999 * 100 end as revenue_drop_2000_pct,
       case when assets_1999 > 0 then (assets_1999 - assets_2000) / assets_1999 * 100 end as assets_drop_2000_pct
from {wide}""",
)
SQL_STEPS["features"] = (
    ["changes"],
    f"""
select *, cast(risk_revenue_drop_gt_30 as int) + cast(risk_negative_profit as int) + cast(risk_assets_drop_gt_25 as int)
          + cast(risk_negative_equity as int) + cast(risk_data_quality_issue as int) as risk_count
from (select *, coalesce(revenue_drop_2000_pct >= 30, false) as risk_revenue_drop_gt_30,
             coalesce(net_profit_2000 < 0, false) as risk_negative_profit,
             coalesce(assets_drop_2000_pct >= 25, false) as risk_assets_drop_gt_25,
             coalesce(equity_2000 < 0, false) as risk_negative_equity,
             ({QUALITY}) as risk_data_quality_issue
      from {{changes}}) f""",
)


def _features(t: Tables) -> DataFrame:
    return company_features(t.reports, SETTINGS)


def _reports_2y(t: Tables) -> DataFrame:
    return two_year_reports(t.reports, SETTINGS)


@query(
    "clean_reports",
    ["raw_reports"],
    """
select inn, ogrn, year, region, region_taxcode, okved, okved_section, filed, imputed, outlier,
       revenue, net_profit, assets, equity
from (select trim(inn) as inn, trim(ogrn) as ogrn, cast(report_year as int) as year, region, trim(region_taxcode) as region_taxcode,
             okved, okved_section, try_cast(filed as double) as filed, try_cast(imputed as double) as imputed,
             try_cast(outlier as double) as outlier, try_cast(line_2110 as double) as revenue,
             try_cast(line_2400 as double) as net_profit, try_cast(line_1600 as double) as assets,
             case when report_year = (select min(report_year) from raw_reports) then null else line_1300 end as equity,
             row_number() over (partition by trim(inn), report_year order by _file, _row) as rn
      from raw_reports
      where inn is not null and ogrn is not null and okved_section in ('A', 'B', 'F', 'H')
        and cast(trim(region_taxcode) as int) % 500 <> 400) x
where rn = 1""",
)
def clean_reports(t: Tables) -> DataFrame:
    raw = union_years([clean_year(df, year, CLEANING) for year, df in t.raw_years()])
    return financial_reports(raw)


@query("two_year_reports", ["reports_2y"], "select inn, year, region, revenue, net_profit, assets, equity from reports_2y")
def two_years(t: Tables) -> DataFrame:
    return _reports_2y(t).select("inn", "year", "region", "revenue", "net_profit", "assets", "equity")


@query("company_dim", ["dim"], "select * from dim")
def dim(t: Tables) -> DataFrame:
    return company_dim(_reports_2y(t))


@query("wide_values", ["wide"], "select * from wide")
def wide(t: Tables) -> DataFrame:
    return wide_values(_reports_2y(t), SETTINGS)


FEATURE_LIST = (
    "inn, region, okved, revenue_1999, revenue_2000, net_profit_2000, assets_1999, assets_2000, equity_2000, "
    "round(revenue_drop_2000_pct, 6) as revenue_drop_2000_pct, round(assets_drop_2000_pct, 6) as assets_drop_2000_pct, "
    + ", ".join(RISK_COLUMNS)
    + ", risk_count"
)


@query("company_features", ["features", "dim"], f"select {FEATURE_LIST} from features join dim using (inn)")
def features(t: Tables) -> DataFrame:
    return _features(t).selectExpr(*FEATURE_LIST.split(", ")[:9], *_tail())


def _tail() -> list[str]:
    return [
        "round(revenue_drop_2000_pct, 6) as revenue_drop_2000_pct",
        "round(assets_drop_2000_pct, 6) as assets_drop_2000_pct",
        *RISK_COLUMNS,
        "risk_count",
    ]


@query(
    "risk_flag_list",
    ["features"],
    """
select inn, concat_ws(', ', case when risk_revenue_drop_gt_30 then 'revenue_drop_gt_30' end,
       case when risk_negative_profit then 'negative_profit' end,
       case when risk_assets_drop_gt_25 then 'assets_drop_gt_25' end,
       case when risk_negative_equity then 'negative_equity' end,
       case when risk_data_quality_issue then 'data_quality_issue' end) as risk_flags
from features""",
)
def risk_flag_list(t: Tables) -> DataFrame:
    return _features(t).select("inn", F.array_join(risk_codes(RISK_COLUMNS), ", ").alias("risk_flags"))


@query(
    "bounded_sample",
    ["reports"],
    "select inn from (select concat(inn, '/', cast(year as varchar)) as inn from reports) x order by md5(concat(inn, ':42')), inn limit 50",
)
def sample_50(t: Tables) -> DataFrame:
    return bounded_sample(t.reports.select(F.concat("inn", F.lit("/"), F.col("year").cast("string")).alias("inn")), 50, 42)


SQL_STEPS["sample"] = (
    ["features", "b0", "b1", "b2", "b3", "b4"],
    " union all ".join(
        f"select inn, '{name}' as sample_bucket from {{b{i}}}"
        for i, name in enumerate(
            ["normal", "revenue_drop_gt_30", "negative_profit", "assets_drop_gt_25", "data_quality_issue"]
        )
    ),
)
SQL_STEPS["b0"] = (
    ["features"],
    """select inn from {features} where revenue_2000 > 0 and net_profit_2000 > 0 and risk_count = 0
order by md5(concat(inn, ':42')), inn limit 30""",
)
for _i, (_flag, _n) in enumerate(
    [("risk_revenue_drop_gt_30", 20), ("risk_negative_profit", 20), ("risk_assets_drop_gt_25", 15),
     ("risk_data_quality_issue", 15)], start=1,
):
    _earlier = " union all ".join(f"select inn from {{b{j}}}" for j in range(_i))
    SQL_STEPS[f"b{_i}"] = (
        ["features", *[f"b{j}" for j in range(_i)]],
        f"select inn from {{features}} where {_flag} and inn not in ({_earlier}) "
        f"order by md5(concat(inn, ':{42 + _i}')), inn limit {_n}",
    )


@query("stratified_sample", ["sample"], "select inn, sample_bucket from sample")
def sample(t: Tables) -> DataFrame:
    return stratified_sample(_features(t), SETTINGS).select("inn", "sample_bucket")


@query(
    "sampled_reports",
    ["sample", "reports_2y"],
    """select inn, ogrn, year, region, region_taxcode, okved, okved_section, filed, imputed, outlier,
revenue, net_profit, assets, equity from reports_2y where inn in (select inn from sample)""",
)
def sampled_reports(t: Tables) -> DataFrame:
    return output_tables(stratified_sample(_features(t), SETTINGS), _reports_2y(t), SETTINGS)[1]


@query(
    "sampled_features",
    ["sample", "features"],
    """select inn, sample_bucket, round(revenue_drop_2000_pct, 6) as revenue_drop_2000_pct, equity_1999, filed_2000,
risk_negative_profit, risk_count from features join sample using (inn)""",
)
def sampled_features(t: Tables) -> DataFrame:
    return output_tables(stratified_sample(_features(t), SETTINGS), _reports_2y(t), SETTINGS)[2].select(
        "inn", "sample_bucket", F.round("revenue_drop_2000_pct", 6).alias("revenue_drop_2000_pct"),
        "equity_1999", "filed_2000", "risk_negative_profit", "risk_count",
    )


@query(
    "company_keys",
    ["dim", "orders"],
    """
select row_number() over (order by inn) as company_id, inn, ogrn, company_label as name, region,
       cast(cast(first_order as date) as varchar) as creation_date, cast(null as varchar) as dissolution_date
from dim join (select lpad(cast(o_custkey as varchar), 10, '0') as inn, min(o_orderdate) as first_order from orders group by 1) o
using (inn)""",
)
def company_keys(t: Tables) -> DataFrame:
    started = t.orders.groupBy(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("inn")).agg(
        F.min("o_orderdate").cast("string").alias("creation_date")
    )
    company = company_dim(_reports_2y(t)).join(started, "inn").withColumn("dissolution_date", F.lit(""))
    return loading.company_rows(company).select(
        "company_id", "inn", "ogrn", "name", "region",
        F.col("creation_date").cast("string").alias("creation_date"),
        F.col("dissolution_date").cast("string").alias("dissolution_date"),
    )


@query(
    "stored_reports",
    ["reports_2y"],
    """
select company_id, year as report_year, revenue, net_profit as profit, assets, filed <> 0 as filed, imputed <> 0 as imputed, outlier <> 0 as outlier
from reports_2y join (select inn, row_number() over (order by inn) as company_id from (select distinct inn from reports_2y) k) using (inn)""",
)
def stored_reports(t: Tables) -> DataFrame:
    reports = _reports_2y(t)
    return loading.report_rows(reports, loading.company_rows(company_dim(reports)))


@query(
    "company_risk_rows",
    ["features"],
    "select company_id, code, severity, confidence, explanation from (select row_number() over (order by inn) as company_id, * from features) f join ("
    + " union all ".join(
        f"select inn, '{flag}' as flag from features where {flag}" for flag in RISK_COLUMNS
    )
    + """) r using (inn) join (values ('revenue_drop_gt_30', 'high'), ('negative_profit', 'high'), ('assets_drop_gt_25', 'medium'),
('negative_equity', 'high'), ('data_quality_issue', 'medium')) v(code, severity) on concat('risk_', code) = flag,
lateral (select cast(1.0 as double) as confidence, concat('Detected from RFSD features: ', flag) as explanation) e""",
)
def company_risk(t: Tables) -> DataFrame:
    found = _features(t)
    company = dense_ids(found.select("inn"), "inn", "company_id")
    factors = dense_ids(seeds.risk_factors(t.spark), "code", "risk_factor_id")
    rows = loading.company_risk_rows(found, company, factors)
    return rows.join(F.broadcast(factors.select("code", "severity")), "code").select(
        "company_id", "code", "severity", "confidence", "explanation"
    )


SQL_STEPS["arriving"] = (
    ["raw_reports"],
    """select trim(inn) as inn, cast(report_year as int) as year, try_cast(line_2110 as double) as revenue,
try_cast(line_1600 as double) as assets, _file from {raw_reports} where try_cast(line_2110 as double) is not null""",
)


@query(
    "report_upsert",
    ["reports", "arriving"],
    """
select inn, year, revenue, assets from (select *, row_number() over (partition by inn, year order by _file desc) as rn from arriving) n where rn = 1
union all
select inn, year, revenue, assets from reports r where not exists (select 1 from arriving n where n.inn = r.inn and n.year = r.year)""",
)
def report_upsert(t: Tables) -> DataFrame:
    # Reports whose revenue cannot be read do not arrive; the stored ones stay for them.
    old = t.reports.select("inn", "year", "revenue", "assets")
    new = t.raw_reports.selectExpr(
        "trim(inn) as inn", "cast(report_year as int) as year", "try_cast(line_2110 as double) as revenue",
        "try_cast(line_1600 as double) as assets", "_file",
    ).filter("revenue is not null")
    return loading.upsert(old, new, ["inn", "year"], ["_file"])


@query(
    "insert_or_ignore",
    ["documents"],
    """
select source, title from (select source, 'stored' as title, 0 as k from documents where source in ('src0', 'src1', 'src2') group by source
union all
select source, concat('first ', cast(min(doc_id) as varchar)), 1 from documents where source not in ('src0', 'src1', 'src2') group by source) x""",
)
def insert_or_ignore(t: Tables) -> DataFrame:
    old = t.documents.filter(F.col("source").isin("src0", "src1", "src2")).select(
        "source", F.lit("stored").alias("title")
    ).distinct()
    new = t.documents.select("source", F.concat(F.lit("first "), F.col("doc_id").cast("string")).alias("title"), "doc_id")
    return loading.insert_or_ignore(old, new, ["source"], ["doc_id"])


@query(
    "node_partial_upsert",
    ["node_ref"],
    """
select node_id, node_type, case when node_type in ('Document', 'Company') then concat('twice ', label)
       when node_type = 'LegalAct' then label else concat('once ', label) end as label, ref_id,
       case when node_type in ('Document', 'Company') then '2' when node_type = 'LegalAct' then '0' else '1' end as version
from node_ref""",
)
def node_partial_upsert(t: Tables) -> DataFrame:
    version = lambda v: F.create_map(F.lit("v"), F.lit(v)).alias("metadata")
    nodes, cols = t.node_ref, ["node_id", "node_type", "ref_table", "ref_id"]
    old = nodes.filter(F.col("node_type").isin("Document", "LegalAct")).select(*cols, "label", version("0"))
    once = nodes.filter("node_type <> 'LegalAct'").select(
        *cols, F.concat(F.lit("once "), F.col("label")).alias("label"), version("1"), F.lit(1).alias("pos")
    )
    twice = nodes.filter(F.col("node_type").isin("Document", "Company")).select(
        "node_id", F.lit("Ignored").alias("node_type"), "ref_table", F.lit("x").alias("ref_id"),
        F.concat(F.lit("twice "), F.col("label")).alias("label"), version("2"), F.lit(2).alias("pos"),
    )
    merged = loading.merge_nodes(old, once.unionByName(twice), ["pos"])
    return merged.select("node_id", "node_type", "label", "ref_id", F.col("metadata")["v"].alias("version"))


@query(
    "manifest",
    ["dim", "reports_2y", "doc_ref", "chunk_ref", "node_ref", "edge_ref"],
    """
select (select min(inn) from dim) as demo_inn, (select count(*) from dim) as companies, (select count(*) from reports_2y) as reports,
       (select count(*) from doc_ref) as documents, (select count(*) from chunk_ref) as chunks,
       (select count(*) from node_ref) as graph_nodes, (select count(*) from edge_ref) as graph_edges""",
)
def manifest_row(t: Tables) -> DataFrame:
    reports = _reports_2y(t)
    return manifest(
        {"company": company_dim(reports), "financial_report": reports, "documents": t.doc_ref,
         "chunks": t.chunk_ref, "graph_nodes": t.node_ref, "graph_edges": t.edge_ref}
    )


@query(
    "year_violations",
    ["reports"],
    "select inn, count(distinct year) as years_count from reports group by inn having count(distinct year) <> 2",
)
def year_violations(t: Tables) -> DataFrame:
    return checks.year_violations(t.reports, SETTINGS)


SQL_STEPS["restricted_chunk"] = (
    ["chunk_ref", "doc_ref"],
    """
select external_id, allowed_roles from chunk_ref where external_id = (
  select min(c.external_id) from chunk_ref c join doc_ref d on d.document_id = c.document_id where d.security_level = 'secret')""",
)


@query(
    "check_results",
    ["dim", "reports", "restricted_chunk", "node_ref", "edge_ref"],
    """
select 'company_rows_missing' as rule, cast(count(*) = 0 as bigint) as violations from dim
union all select 'report_rows_missing', cast(count(*) = 0 as bigint) from reports
union all select 'target_year_missing', cast(count(*) filter (where year = 2000) = 0 as bigint) from reports
union all select 'company_years', count(*) from (select inn from reports group by inn having count(distinct year) <> 2) y
union all select 'restricted_chunk_count', abs(count(*) - 1) from restricted_chunk
union all select 'restricted_chunk_readers', count(*) from restricted_chunk where array_to_string(allowed_roles, ',') <> 'risk_manager'
union all select 'nodes_missing', greatest(0, 5 - count(*)) from node_ref where node_type <> 'LegalAct'
union all select 'edges_missing', greatest(0, 4 - count(*)) from edge_ref
union all select 'unknown_edge_ends', count(*) from (select source_node_id as node_id from edge_ref union select target_node_id from edge_ref) e where node_id not in (select node_id from node_ref where node_type <> 'LegalAct')""",
)
def check_results(t: Tables) -> DataFrame:
    secret = t.chunk_ref.join(t.doc_ref.filter("security_level = 'secret'").select("document_id"), "document_id", "left_semi")
    restricted = secret.agg(F.min("external_id")).first()[0] or ""
    tables = {
        "company": company_dim(t.reports), "financial_report": t.reports, "chunks": t.chunk_ref,
        "graph_nodes": t.node_ref.filter("node_type <> 'LegalAct'"), "graph_edges": t.edge_ref,
    }
    return checks.check_results(tables, SETTINGS, restricted)


@query(
    "unknown_edge_ends",
    ["edge_ref", "node_ref"],
    """
select node_id, count(*) as edge_ends from (select source_node_id as node_id from edge_ref union all select target_node_id from edge_ref) e
where node_id not in (select node_id from node_ref where node_type <> 'LegalAct') group by node_id""",
)
def unknown_edge_ends(t: Tables) -> DataFrame:
    return checks.unknown_edge_ends(t.node_ref.filter("node_type <> 'LegalAct'"), t.edge_ref)


@query(
    "acl_violations",
    ["chunk_ref", "doc_ref"],
    """
select c.document_id, c.external_id, 'analyst,risk_manager' as roles from chunk_ref c join doc_ref d on d.document_id = c.document_id
where d.security_level = 'secret' and c.chunk_order = 1""",
)
def acl_violations(t: Tables) -> DataFrame:
    # Second chunks are opened to everyone, which restricted documents do not allow.
    opened = F.when(F.col("chunk_order") == 1, F.array(F.lit("analyst"), F.lit("risk_manager"))).otherwise(
        F.col("allowed_roles")
    )
    found = checks.acl_violations(t.doc_ref, t.chunk_ref.withColumn("allowed_roles", opened))
    return found.select("document_id", "external_id", F.array_join("allowed_roles", ",").alias("roles"))


@query(
    "json_type_checks",
    ["events"],
    """
select event_id, json_type(props) = 'OBJECT' as props_is_object, json_type(concat('[', props, ']')) = 'ARRAY' as list_is_list, false as props_is_list
from events""",
)
def json_type_checks(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        is_json_object(F.col("props")).alias("props_is_object"),
        is_json_list(F.concat(F.lit("["), F.col("props"), F.lit("]"))).alias("list_is_list"),
        is_json_list(F.col("props")).alias("props_is_list"),
    )


@query(
    "csv_json_text",
    ["chunk_ref"],
    """select external_id, case when len(allowed_roles) = 1 then '["risk_manager"]' else '["analyst","risk_manager"]' end as allowed_roles,
concat('{"linked":"', cast(document_id as varchar), '"}') as metadata from chunk_ref""",
)
def csv_json_text(t: Tables) -> DataFrame:
    linked = F.create_map(F.lit("linked"), F.col("document_id").cast("string"))
    return json_text(t.chunk_ref.select("external_id", "allowed_roles", linked.alias("metadata")))


@query(
    "metadata_merge",
    ["doc_ref"],
    """select document_id, security_level as level, external_id as external_id, 2 as entries from doc_ref""",
)
def metadata_merge(t: Tables) -> DataFrame:
    before = F.create_map(
        F.lit("level"), F.col("security_level"), F.lit("external_id"), F.lit("replaced")
    )
    merged = t.doc_ref.select(
        "document_id", with_external_id(before, F.col("external_id")).alias("m")
    )
    return merged.select(
        "document_id", F.col("m")["level"].alias("level"), F.col("m")["external_id"].alias("external_id"),
        F.size("m").alias("entries"),
    )


@query(
    "graph_nodes",
    ["doc_ref", "chunk_ref", "customer"],
    """
select concat('document:', external_id) as node_id, 'Document' as node_type, title as label, 'document' as ref_table, external_id as ref_id, security_level from doc_ref
union all select concat('chunk:', external_id), 'Chunk', external_id, 'chunk', external_id, null from chunk_ref
union all select concat('company:', lpad(cast(c_custkey as varchar), 10, '0')), 'Company', c_name, 'company', lpad(cast(c_custkey as varchar), 10, '0'), null from customer""",
)
def graph_nodes(t: Tables) -> DataFrame:
    companies = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("inn"), F.col("c_name").alias("name"))
    nodes = build_nodes(t.doc_ref, t.chunk_ref, companies)
    return nodes.select(
        "node_id", "node_type", "label", "ref_table", "ref_id", F.col("metadata")["security_level"].alias("security_level")
    )


@query(
    "belongs_to_edges",
    ["chunk_ref"],
    """select concat('chunk:', external_id) as source_node_id, concat('document:d', cast(document_id as varchar)) as target_node_id,
'BELONGS_TO' as edge_type, cast(1.0 as double) as weight, cast(1.0 as double) as confidence, external_id as source_chunk_external_id from chunk_ref""",
)
def belongs_to(t: Tables) -> DataFrame:
    keyed = t.chunk_ref.withColumn("document_external_id", F.concat(F.lit("d"), F.col("document_id").cast("string")))
    return belongs_to_edges(keyed)


SQL_STEPS["numbered_chunks"] = (
    ["chunk_ref"],
    "select row_number() over (order by external_id) as chunk_no, external_id from {chunk_ref}",
)


@query(
    "stored_documents",
    ["doc_ref"],
    """select row_number() over (order by external_id) as document_id, title, security_level, external_id from doc_ref""",
)
def stored_documents(t: Tables) -> DataFrame:
    docs = t.doc_ref.drop("document_id").withColumn("metadata", F.create_map().cast("map<string,string>"))
    return loading.document_rows(docs).select(
        "document_id", "title", "security_level", F.col("metadata")["external_id"].alias("external_id")
    )


def _stored_chunks(t: Tables) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    docs = t.doc_ref.drop("document_id").withColumn("metadata", none)
    chunks = t.chunk_ref.select(
        "external_id", "chunk_text", "chunk_order", "allowed_roles",
        F.concat(F.lit("d"), F.col("document_id").cast("string")).alias("document_external_id"), none.alias("metadata"),
    )
    return loading.chunk_rows(chunks, loading.document_rows(docs))


@query(
    "stored_chunks",
    ["chunk_ref", "doc_ref"],
    """
select row_number() over (order by c.external_id) as chunk_id, n.document_id, c.external_id, c.chunk_order, length(c.chunk_text) as chars
from chunk_ref c join (select document_id as doc, row_number() over (order by external_id) as document_id from doc_ref) n on n.doc = c.document_id""",
)
def stored_chunks(t: Tables) -> DataFrame:
    return _stored_chunks(t).select(
        "chunk_id", "document_id", F.col("metadata")["external_id"].alias("external_id"), "chunk_order",
        F.char_length("chunk_text").cast("long").alias("chars"),
    )


@query(
    "stored_edges",
    ["edge_ref", "numbered_chunks"],
    """
select e.source_node_id, e.target_node_id, e.edge_type, cast(e.weight as double) as weight, c.chunk_no as source_chunk_id
from edge_ref e left join numbered_chunks c on e.source_node_id = concat('chunk:', c.external_id)""",
)
def stored_edges(t: Tables) -> DataFrame:
    from_chunk = F.when(F.col("source_node_id").startswith("chunk:"), F.expr("substring(source_node_id, 7)"))
    edges = t.edge_ref.select(
        "source_node_id", "target_node_id", "edge_type", "weight", F.lit(1.0).alias("confidence"),
        from_chunk.alias("source_chunk_external_id"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    chunk = dense_ids(t.chunk_ref.select("external_id"), "external_id", "chunk_id").select(
        "chunk_id", F.create_map(F.lit("external_id"), F.col("external_id")).alias("metadata")
    )
    return loading.edge_rows(edges, chunk).select(
        "source_node_id", "target_node_id", "edge_type", "weight", "source_chunk_id"
    )


@query(
    "date_prefixes",
    ["events"],
    "select event_id, cast(cast(ts as date) as varchar) as day from events",
)
def date_prefixes(t: Tables) -> DataFrame:
    return t.events.select("event_id", date_prefix(F.col("ts")).cast("string").alias("day"))


def _scratch(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query(
    "yearly_files",
    ["raw_reports"],
    """
select trim(inn) as inn, cast(report_year as int) as year, region, trim(region_taxcode) as region_taxcode,
       try_cast(line_2110 as double) as revenue, try_cast(line_1600 as double) as assets,
       case when report_year = (select min(report_year) from raw_reports) then null else line_1300 end as equity
from raw_reports where inn is not null and ogrn is not null and okved_section in ('A', 'B', 'F', 'H')
  and cast(trim(region_taxcode) as int) % 500 <> 400""",
)
def yearly_files(t: Tables) -> DataFrame:
    """Raw rows written as year folders, two for each year at different depths, and read back."""
    root = _scratch(t)
    for year, rows in t.raw_years():
        plain = rows.drop("_file", "_row")
        first = rows["_file"] == "a"
        plain.filter(first).write.parquet(f"{root}/first/year={year}")
        plain.filter(~first).write.parquet(f"{root}/second/part/year={year}")
    found = load_years(t.spark, root, CLEANING)
    return found.select("inn", "year", "region", "region_taxcode", "revenue", "assets", "equity")


@query(
    "first_reports",
    ["raw_reports"],
    """
select trim(inn) as inn, cast(report_year as int) as year, try_cast(line_2110 as double) as revenue, try_cast(line_2400 as double) as net_profit,
       try_cast(outlier as double) as outlier, line_1300 as equity
from raw_reports where _file = 'a' and inn is not null and ogrn is not null and okved_section in ('A', 'B', 'F', 'H')
  and cast(trim(region_taxcode) as int) % 500 <> 400""",
)
def first_reports(t: Tables) -> DataFrame:
    """One year folder holds files that type a column differently; of two reports the one in the first file stays."""
    root = _scratch(t)
    rows = t.raw_reports.withColumn("year", F.col("report_year")).drop("report_year", "_row")
    first = F.col("_file") == "a"
    even = F.pmod(F.xxhash64("inn"), F.lit(2)) == 0
    numbers = {c: F.col(c).try_cast("double") for c in ("line_2400", "filed")} | {"outlier": F.col("outlier").try_cast("int")}
    for kind, some, types in (("a", first & even, {}), ("a", first & ~even, numbers), ("b", ~first, {})):
        part = rows.filter(some).drop("_file").withColumns(types)
        part.write.mode("append").partitionBy("year").parquet(f"{root}/{kind}")
    reports = financial_reports(load_years(t.spark, root, CLEANING))
    return reports.select("inn", "year", "revenue", "net_profit", "outlier", "equity")


@query(
    "exported_csv",
    ["dim", "reports_2y", "chunk_ref"],
    """
select 'company' as name, count(*) as n, min(inn) as least, max(inn) as most, cast(count(region) as bigint) as filled from dim
union all select 'financial_report', count(*), min(inn), max(inn), count(region) from reports_2y
union all select 'chunks', count(*), min(external_id), max(external_id), count(allowed_roles) from chunk_ref""",
)
def exported_csv(t: Tables) -> DataFrame:
    """Tables written as CSV with a header and read back; what was sorted must come back sorted."""
    root, reports = _scratch(t), _reports_2y(t)
    chunks = t.chunk_ref.select("external_id", "allowed_roles")
    parts = []
    for name, rows, key, filled in (
        ("company", company_dim(reports).orderBy(*SORTED_BY["company"]), "inn", "region"),
        ("financial_report", reports.orderBy(*SORTED_BY["financial_report"]), "inn", "region"),
        ("chunks", chunks, "external_id", "allowed_roles"),
    ):
        write_csv(rows, f"{root}/{name}.csv")
        back = t.spark.read.option("header", True).csv(f"{root}/{name}.csv")
        parts.append(
            back.agg(
                F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.min(key).alias("least"),
                F.max(key).alias("most"), F.count(filled).alias("filled"),
            )
        )
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "exported_order",
    ["reports"],
    """select row_number() over (order by inn, year) as place, inn, year, region, revenue, net_profit, filed from reports""",
)
def exported_order(t: Tables) -> DataFrame:
    """A sorted export re-read: every row with its place over all files."""
    path = f"{_scratch(t)}/reports.csv"
    write_sorted(t.reports, path, SORTED_BY["financial_report"])
    rows = reread(t.spark, path)
    # One row per file.
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows")).select("file", before.alias("before"))
    return rows.join(starts, "file").select(
        (F.col("place") + F.col("before")).alias("place"), "inn", F.col("year").cast("int").alias("year"), "region",
        *[F.col(c).cast("double").alias(c) for c in ("revenue", "net_profit", "filed")],
    )


@query(
    "decoded_json",
    ["chunk_ref"],
    """
select external_id, case when document_id % 5 = 0 then 0 else 1 end as entries,
       case when document_id % 5 = 0 then null else cast(document_id as varchar) end as linked,
       case when document_id % 7 = 0 then '' else array_to_string(allowed_roles, ',') end as roles from chunk_ref""",
)
def decoded_json(t: Tables) -> DataFrame:
    """Texts of maps and lists, some blank or missing, back to maps and lists."""
    linked = F.create_map(F.lit("linked"), F.col("document_id").cast("string"))
    texts = json_text(t.chunk_ref.select("external_id", "document_id", "allowed_roles", linked.alias("metadata")))
    blank = texts.select(
        "external_id",
        F.when(F.col("document_id") % 5 == 0, F.when(F.col("document_id") % 2 == 0, F.lit(" "))).otherwise(F.col("metadata")).alias("metadata"),
        F.when(F.col("document_id") % 7 == 0, F.lit("")).otherwise(F.col("allowed_roles")).alias("allowed_roles"),
    )
    decoded = blank.select("external_id", parse_metadata(F.col("metadata")).alias("m"), parse_roles(F.col("allowed_roles")).alias("r"))
    return decoded.select(
        "external_id", F.size("m").alias("entries"), F.col("m")["linked"].alias("linked"), F.array_join("r", ",").alias("roles")
    )
