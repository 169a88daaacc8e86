"""Request checks: validation, input patterns, intent and the output check, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import ROLES
from credence.functions.columns import stripped

# ---------------------------------------------------------------------------
# Patterns are tried in this order, the first hit names the reason.
# ---------------------------------------------------------------------------

BLOCKED_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|above)\s+instructions",
    r"disregard\s+(your\s+)?(system\s+)?prompt",
    r"you\s+are\s+now\s+(in\s+)?(\w+\s+)?mode",
    r"system\s*:\s*",
    r"<\s*/?\s*system\s*>",
    r"jailbreak",
    r"выведи\s+системный\s+промпт",
    r"игнорируй\s+предыдущ",
    r"\bpassword\b",
    r"\bsecret\s*key\b",
]
RISK_STEMS = ["риск", "risk", "выручк", "revenue", "ромашк"]
COMPLIANCE_STEMS = ["закон", "норм", "политик", "policy"]

MAX_QUERY_CHARS = 4000


def request_error(query: Column, role: Column) -> Column:
    """Reason a request is malformed, NULL if it is fine. Length counts before stripping."""
    size = F.char_length(F.coalesce(query, F.lit("")))
    return (
        F.when(size < 1, "query_missing")
        .when(size > MAX_QUERY_CHARS, "query_too_long")
        .when(~F.coalesce(role.isin(ROLES), F.lit(False)), "unknown_role")
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed requests (a missing role becomes analyst) and the rejected rest with its error."""
    marked = requests.withColumn("role", F.coalesce("role", F.lit("analyst"))).withColumn(
        "error", request_error(F.col("query"), F.col("role"))
    )
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")


def block_reason(query: Column) -> Column:
    """NULL when the query may pass, else why it may not. Patterns search, ignore case, know Cyrillic.

    Surrounding white space never decides a pattern, so only the length test strips it.
    """
    text = F.coalesce(query, F.lit(""))
    too_long = (F.char_length(text) > MAX_QUERY_CHARS) & (F.char_length(stripped(text)) > MAX_QUERY_CHARS)
    reason = F.when(~text.rlike(r"(?U)\S"), "empty_query").when(too_long, "query_too_long")
    for pattern in BLOCKED_PATTERNS:
        reason = reason.when(text.rlike("(?iU)" + pattern), f"blocked_pattern:{pattern}")
    return reason


def intent(query: Column) -> Column:
    text = F.lower(F.coalesce(query, F.lit("")))

    def mentions(stems: list[str]) -> Column:
        found = F.lit(False)
        for stem in stems:
            found = found | text.contains(stem)
        return found

    return (
        F.when(mentions(RISK_STEMS), "risk_analysis")
        .when(mentions(COMPLIANCE_STEMS), "compliance")
        .otherwise("general")
    )


def search_scope(intent_col: Column) -> Column:
    """Recorded for the audit; retrieval does not read it."""
    return F.when(intent_col == "compliance", "compliance")


def answer_error(answer: Column, chunk_citations: Column, node_citations: Column) -> Column:
    """Reason an answer may not leave, from its text and how many usable citations it has."""
    return F.when(stripped(F.coalesce(answer, F.lit(""))) == "", "empty_answer").when(
        (chunk_citations + node_citations) == 0, "no_citations"
    )


def citation_counts(citations: Column) -> tuple[Column, Column]:
    """How many entries of a citation array name a chunk, and how many name a node."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    chunks = F.filter(citations, lambda c: c["chunk_id"].isNotNull() | filled(c["external_id"]))
    nodes = F.filter(citations, lambda c: filled(c["node_id"]))
    return F.size(chunks), F.size(nodes)
