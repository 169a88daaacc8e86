"""Small reference tables that ship with the package: risk factors and the demonstration corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence import schemas
from credence.config import RISK_FACTORS

# ---------------------------------------------------------------------------
# The demonstration company, documents, chunks and links.
# ---------------------------------------------------------------------------

DEMO_COMPANY_NAME = "ООО Ромашка"

# external_id, source, doc_type, title, security_level
DEMO_DOCUMENTS = [
    ("law_001", "RusLawOD_sample", "legal_act", "Закон о банковской деятельности", "public"),
    ("policy_001", "synthetic_bank_policy", "internal_policy", "Внутренняя политика оценки контрагентов", "internal"),
    ("risk_001", "synthetic_bank_policy", "risk_methodology", "Методика оценки финансового риска", "secret"),
]

# external_id, document, text, roles, mentioned risk factor
DEMO_CHUNKS = [
    (
        "ch_001", "law_001",
        "Кредитная организация обязана идентифицировать клиента и оценивать риски операций.",
        ["analyst", "risk_manager"], None,
    ),
    (
        "ch_002", "policy_001",
        "При снижении выручки более чем на 30% аналитик обязан запросить дополнительные документы.",
        ["analyst", "risk_manager"], "revenue_drop",
    ),
    (
        "ch_003", "risk_001",
        "Секретная методика внутреннего скоринга использует закрытые коэффициенты риска.",
        ["risk_manager"], None,
    ),
]

LEGAL_ACT_NODE = ("legal_act:banking_law", "LegalAct", "Закон о банковской деятельности", "document", "law_001")
RISK_NODE = (
    "risk_factor:revenue_drop", "RiskFactor", "Снижение выручки > 30%", "risk_factor", "revenue_drop_gt_30",
)

# source, target ({inn} = the demonstration company), type, weight, confidence, source chunk
DEMO_LINKS = [
    ("chunk:ch_002", "document:policy_001", "BELONGS_TO", 1.0, 1.0, "ch_002"),
    ("chunk:ch_002", "risk_factor:revenue_drop", "MENTIONS", 1.0, 1.0, "ch_002"),
    ("chunk:ch_002", "company:{inn}", "MENTIONS", 1.0, 1.0, "ch_002"),
    ("chunk:ch_001", "legal_act:banking_law", "LINKED_TO", 1.0, 1.0, "ch_001"),
    ("document:policy_001", "document:law_001", "LINKED_TO", 0.8, 0.9, None),
    ("chunk:ch_003", "document:risk_001", "BELONGS_TO", 1.0, 1.0, "ch_003"),
]


def risk_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RISK_FACTORS, schemas.RISK_FACTOR)


def demo_documents(spark: SparkSession, inn: str, company_name: str = DEMO_COMPANY_NAME) -> DataFrame:
    named = {"demo_company_inn": inn, "demo_company_name": company_name}
    rows = [
        (*doc, named if doc[0] == "law_001" else {"demo_company_inn": inn}) for doc in DEMO_DOCUMENTS
    ]
    return spark.createDataFrame(rows, schemas.DOCUMENT_SEED)


def demo_chunks(spark: SparkSession, inn: str) -> DataFrame:
    rows = [
        (ext, doc, text, 1, roles, {"linked_inn": inn} | ({"risk_factor": factor} if factor else {}))
        for ext, doc, text, roles, factor in DEMO_CHUNKS
    ]
    return spark.createDataFrame(rows, schemas.CHUNK_SEED)


def demo_companies(spark: SparkSession, inn: str, name: str = DEMO_COMPANY_NAME) -> DataFrame:
    return spark.createDataFrame([(inn, name)], "inn string, name string")


def demo_legal_acts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*LEGAL_ACT_NODE, {})], schemas.GRAPH_NODE)


def demo_risk_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*RISK_NODE, {})], schemas.GRAPH_NODE)


def demo_edges(spark: SparkSession, inn: str) -> DataFrame:
    rows = [(s, t.format(inn=inn), kind, w, c, chunk, {}) for s, t, kind, w, c, chunk in DEMO_LINKS]
    return spark.createDataFrame(rows, schemas.GRAPH_EDGE_SEED)


def demo_bundle(spark: SparkSession, inn: str, name: str = DEMO_COMPANY_NAME) -> dict[str, DataFrame]:
    """Documents, chunks, nodes and edges of the demonstration corpus."""
    from credence.operators.graph import build_nodes

    documents, chunks = demo_documents(spark, inn, name), demo_chunks(spark, inn)
    nodes = build_nodes(
        documents, chunks, demo_companies(spark, inn, name), demo_legal_acts(spark), demo_risk_nodes(spark)
    )
    return {
        "documents": documents,
        "chunks": chunks,
        "graph_nodes": nodes,
        "graph_edges": demo_edges(spark, inn),
    }
