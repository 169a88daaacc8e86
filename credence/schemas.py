"""Declared schemas of the stored tables."""

from __future__ import annotations

METADATA = "map<string,string>"

DOCUMENT_SEED = (
    "external_id string, source string, doc_type string, title string, "
    f"security_level string, metadata {METADATA}"
)
CHUNK_SEED = (
    "external_id string, document_external_id string, chunk_text string, chunk_order int, "
    f"allowed_roles array<string>, metadata {METADATA}"
)
GRAPH_NODE = (
    f"node_id string, node_type string, label string, ref_table string, ref_id string, metadata {METADATA}"
)
GRAPH_EDGE_SEED = (
    "source_node_id string, target_node_id string, edge_type string, weight double, "
    f"confidence double, source_chunk_external_id string, metadata {METADATA}"
)
RISK_FACTOR = "code string, title string, description string, severity string"

STORED_TABLES = {
    "company": (
        "company_id long, inn string, ogrn string, name string, region string, okved string, "
        "okved_section string, creation_date date, dissolution_date date"
    ),
    "financial_report": (
        "report_id long, company_id long, report_year int, revenue double, profit double, "
        "assets double, filed boolean, imputed boolean, outlier boolean"
    ),
    # Declared and emptied with the rest, but nothing fills it.
    "financial_fact": (
        "fact_id long, company_id long, fact_type string, report_year int, value double, "
        "unit string, description string, source_report_id long"
    ),
    "risk_factor": f"risk_factor_id long, {RISK_FACTOR}",
    "company_risk": (
        "company_risk_id long, company_id long, risk_factor_id long, fact_id long, "
        "confidence double, explanation string"
    ),
    "document": (
        f"document_id long, source string, doc_type string, title string, security_level string, metadata {METADATA}"
    ),
    "chunk": (
        "chunk_id long, document_id long, chunk_text string, chunk_order int, "
        f"allowed_roles array<string>, metadata {METADATA}"
    ),
    "graph_node": GRAPH_NODE,
    "graph_edge": (
        "edge_id long, source_node_id string, target_node_id string, edge_type string, "
        f"weight double, confidence double, source_chunk_id long, metadata {METADATA}"
    ),
    "chunk_embedding": "chunk_id long, embedding array<float>, model_name string, updated_at timestamp, content_hash string",
}

# The column whose ranges (of node_id: whose hash) cut a table into partitions, and the id a table numbers itself.
PARTITIONED_BY = {
    "company": "company_id", "financial_report": "company_id", "financial_fact": "company_id", "risk_factor": "risk_factor_id",
    "company_risk": "company_id", "document": "document_id", "chunk": "chunk_id", "graph_node": "node_id", "graph_edge": "edge_id",
    "chunk_embedding": "chunk_id",
}
IDS = {
    "company": "company_id", "financial_report": "report_id", "risk_factor": "risk_factor_id", "company_risk": "company_risk_id",
    "document": "document_id", "chunk": "chunk_id", "graph_edge": "edge_id",
}
