"""Settings of the batch and retrieval jobs, and the fixed values they share."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Input column names, output column orders, risk factors.
# ---------------------------------------------------------------------------

META_COLUMNS = [
    "year", "inn", "ogrn", "region", "region_taxcode", "creation_date", "dissolution_date",
    "age", "eligible", "filed", "imputed", "outlier", "okved", "okved_section",
]

FINANCIAL_RENAMES = {
    "line_2110": "revenue",
    "line_2400": "net_profit",
    "line_1600": "assets",
    "line_1300": "equity",
    "line_1400": "longterm_liab",
    "line_1500": "shortterm_liab",
    "line_1520": "payables",
    "line_1250": "cash",
}

TEXT_COLUMNS = ["inn", "ogrn", "region", "region_taxcode", "okved", "okved_section"]
FLAG_COLUMNS = ["eligible", "filed", "imputed", "outlier"]
MEASURE_COLUMNS = list(FINANCIAL_RENAMES.values())

COMPANY_COLUMNS = [
    "inn", "ogrn", "region", "region_taxcode", "okved", "okved_section",
    "creation_date", "dissolution_date", "age",
]
REPORT_COLUMNS = [
    "inn", "ogrn", "year", "region", "region_taxcode", "okved", "okved_section",
    "creation_date", "dissolution_date", "age", *FLAG_COLUMNS, *MEASURE_COLUMNS,
]

COMPANY_LABEL_PREFIX = "Компания ИНН "

RISK_FLAG_TO_CODE = {
    "risk_revenue_drop_gt_30": "revenue_drop_gt_30",
    "risk_negative_profit": "negative_profit",
    "risk_assets_drop_gt_25": "assets_drop_gt_25",
    "risk_negative_equity": "negative_equity",
    "risk_data_quality_issue": "data_quality_issue",
}
RISK_COLUMNS = list(RISK_FLAG_TO_CODE)

# code, title, description, severity
RISK_FACTORS = [
    ("revenue_drop_gt_30", "Снижение выручки > 30%", "Выручка снизилась на 30% и более", "high"),
    ("negative_profit", "Отрицательная прибыль", "Чистая прибыль отрицательна", "high"),
    ("assets_drop_gt_25", "Падение активов > 25%", "Активы снизились на 25% и более", "medium"),
    ("negative_equity", "Отрицательный капитал", "Собственный капитал отрицательный", "high"),
    ("data_quality_issue", "Проблема качества данных", "Отчёт не подан, imputed или outlier", "medium"),
]

RISK_EXPLANATION_PREFIX = "Detected from RFSD features: "

ROLES = ["analyst", "risk_manager"]
EDGE_TYPES = ["BELONGS_TO", "MENTIONS", "LINKED_TO"]
CITED_NODE_TYPES = ["Document", "LegalAct", "RiskFactor", "Company"]


@dataclass(frozen=True)
class RiskSettings:
    """Years, filters, thresholds and sample sizes of the batch preparation."""

    base_year: int = 2023
    target_year: int = 2024
    region_taxcodes: tuple[str, ...] = ("7700", "7800", "5000")
    okved_sections: tuple[str, ...] = ("C", "F", "G", "J", "M")
    revenue_drop_pct: float = 30.0
    assets_drop_pct: float = 25.0
    bucket_sizes: dict[str, int] = field(
        default_factory=lambda: {
            "normal": 30,
            "revenue_drop_gt_30": 20,
            "negative_profit": 20,
            "assets_drop_gt_25": 15,
            "data_quality_issue": 15,
        }
    )
    seed: int = 42

    @property
    def years(self) -> tuple[int, int]:
        return (self.base_year, self.target_year)


@dataclass(frozen=True)
class RetrievalSettings:
    """Top-k, graph depth and vector size of the retrieval jobs."""

    top_k: int = 3
    hops: int = 1
    edge_types: tuple[str, ...] = tuple(EDGE_TYPES)
    embedding_dim: int = 384
    encoder_name: str = "hashing-tf-l2"
    # Query vectors up to this many bytes travel to the tasks as one broadcast;
    # more than that and the search switches to the cell-partitioned join.
    broadcast_bytes: int = 64 * 1024 * 1024
    # One response row folds at most this many sources (and citations).
    page_size: int = 1000
    # Company whose figures answer requests that name none; none by default.
    default_inn: str | None = None
    answer_title: str = "Ответ по базе знаний"
