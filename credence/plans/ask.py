"""Answering a table of requests: screen, look up, retrieve, expand, filter, rank, cite, check, audit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import CITED_NODE_TYPES, RISK_COLUMNS, RetrievalSettings, RiskSettings
from credence.functions import guard
from credence.functions.risk import risk_codes
from credence.operators.adjacency import Adjacency, store_adjacency
from credence.operators.graph import expand, graph_chunks, seed_nodes
from credence.operators.grouping import grouped_rank, spread_join
from credence.operators.ranking import accessible, merge_context, rerank
from credence.operators.vectors import vector_search
from credence.session import settle, settle_counted

# ---------------------------------------------------------------------------
# Answer texts.
# ---------------------------------------------------------------------------

INPUT_BLOCKED = "Запрос отклонён политикой безопасности (input guardrail)."
OUTPUT_BLOCKED = "Ответ заблокирован: отсутствуют обязательные ссылки на источники."
NOTHING_FOUND = (
    "По запросу не найдено фрагментов, доступных для вашей роли. "
    "Уточните запрос или обратитесь к риск-менеджеру."
)
HEADER = "**%s** — роль `%s`, intent `%s`."
QUERY_LINE = "Запрос: %s"
FACTS_HEADING = "**Финансовые показатели:**"
FACTS_LINE = (
    "По финансовым данным компании %s выручка %s на %s%%, "
    "прибыль за последний год %s: %s руб."
)
REVENUE_FELL, REVENUE_GREW, REVENUE_UNKNOWN = "снизилась", "выросла", "изменилась"
PROFIT_NEGATIVE, PROFIT_OTHER, PROFIT_UNKNOWN = "отрицательная", "неотрицательная", "неизвестна"
FLAGS_LINE = "Флаги риска: %s."
CONCLUSION = (
    "**Вывод:** на основании доступных фрагментов и связей графа знаний "
    "предварительный анализ возможен с учётом нормативных и политических оснований."
)
FACTS_ONLY = (
    "**Вывод:** анализ основан на структурированных финансовых показателях; "
    "документные фрагменты для роли не найдены."
)
SOURCES_HEADING = "**Источники:**"
SOURCE_LINE = "%s. [%s] %s: %s…"
MISSING = "—"
SNIPPET_CHARS = 120

# Node ids are ranked in runs that share this many leading characters.
NODE_PREFIX = 16


@dataclass(frozen=True)
class Corpus:
    """The stored tables a request is answered from."""

    chunk: DataFrame  # chunk_id, document_id, external_id, chunk_text, allowed_roles
    document: DataFrame  # document_id, external_id, title
    embedding: DataFrame  # chunk_id, embedding
    nodes: DataFrame
    edges: DataFrame | Adjacency  # stored once as an adjacency, edges serve many tables of requests
    features: DataFrame | None = None
    chunk_rows: int | None = None  # counted once, it serves many tables of requests

    @staticmethod
    def from_store(store, features: DataFrame | None = None, edge_types=RetrievalSettings.edge_types) -> Corpus:
        external = F.col("metadata")["external_id"].alias("external_id")
        chunk = store.read("chunk")
        return Corpus(
            chunk.select("chunk_id", "document_id", external, "chunk_text", "allowed_roles"),
            store.read("document").select("document_id", external, "title"),
            store.read("chunk_embedding").select("chunk_id", "embedding"),
            store.read("graph_node"),
            store_adjacency(store.read("graph_edge"), edge_types),
            features,
            chunk.count(),
        )


@dataclass(frozen=True)
class Answers:
    """Everything a request table leads to. `status` has one row per request."""

    status: DataFrame
    context: DataFrame
    nodes: DataFrame
    citations: DataFrame
    responses: DataFrame

    def audit_log(self) -> DataFrame:
        return audit_log(self.status)

    def step_metrics(self) -> DataFrame:
        return step_metrics(self.status)


def screen(requests: DataFrame) -> DataFrame:
    """Adds trace_id (unless the caller gave one), the input check's reason, and for passing requests intent and scope."""
    own = F.md5(F.col("query_id").cast("string"))
    given = F.nullif(F.col("trace_id"), F.lit("")) if "trace_id" in requests.columns else F.lit(None)
    return (
        requests.withColumn("trace_id", F.coalesce(given, own))
        .withColumn("input_reason", guard.block_reason(F.col("query")))
        .withColumn("intent", F.when(F.col("input_reason").isNull(), guard.intent(F.col("query"))))
        .withColumn("search_scope", guard.search_scope(F.col("intent")))
    )


def company_facts(features: DataFrame, settings: RiskSettings = RiskSettings()) -> DataFrame:
    """(inn, financial_facts): key figures and raised risk codes of every company."""
    base, target = settings.years
    flags = [c for c in RISK_COLUMNS if c in features.columns]
    return features.select(
        "inn",
        F.struct(
            "inn",
            F.col("company_label").alias("company_name"),
            f"revenue_{base}",
            f"revenue_{target}",
            F.col(f"revenue_drop_{target}_pct").alias("revenue_drop_pct"),
            F.col(f"net_profit_{target}").alias(f"profit_{target}"),
            risk_codes(flags).alias("risk_flags"),
        ).alias("financial_facts"),
    )


def facts_type(settings: RiskSettings) -> str:
    base, target = settings.years
    return (
        f"struct<inn:string,company_name:string,revenue_{base}:double,revenue_{target}:double,"
        f"revenue_drop_pct:double,profit_{target}:double,risk_flags:array<string>>"
    )


def financial_lookup(
    requests: DataFrame, features: DataFrame, settings: RiskSettings = RiskSettings(), default_inn: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Requests with the facts of their company, or of `default_inn` if they name none. One company may be asked about very often."""
    asked = requests.withColumn("inn", F.coalesce("inn", F.lit(default_inn))) if default_inn else requests
    return spread_join(
        asked, company_facts(features, settings), "inn", ["query_id"], "left", rows=asked.count() if rows is None else rows
    )


def retrieved_chunks(hits: DataFrame, chunk: DataFrame, document: DataFrame) -> DataFrame:
    """Vector hits in the shape of context rows, with text and document title."""
    hits, rows = settle_counted(hits)
    found = spread_join(
        hits, chunk.select("chunk_id", "document_id", "external_id", "chunk_text", "allowed_roles"),
        "chunk_id", ["query_id"], rows=rows,
    )
    of_hits = hits.join(chunk.select("chunk_id", "document_id"), "chunk_id")
    titles = document.select("document_id", F.col("title").alias("document_title"))
    titled = spread_join(found, titles, "document_id", ["query_id", "chunk_id"], weigh=of_hits, rows=rows)
    return titled.select(
        "query_id", "rank", "chunk_id", "external_id", "chunk_text", "document_title", "document_id",
        F.coalesce("allowed_roles", F.array().cast("array<string>")).alias("allowed_roles"),
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.lit(0.0).alias("graph_score"),
        F.lit("vector").alias("source"),
    )


def node_citations(reached: DataFrame) -> DataFrame:
    """Cited nodes of each query, ranked by node id."""
    cited = reached.filter(F.col("node_type").isin(CITED_NODE_TYPES))
    return grouped_rank(
        cited, ["query_id"], [F.col("node_id")], [F.substring("node_id", 1, NODE_PREFIX)], "node_rank"
    ).select("query_id", "node_rank", "node_id", "node_type", "label", "ref_id")


def source_line(rank: Column, external_id: Column, chunk_id: Column, title: Column, snippet: Column) -> Column:
    name = F.coalesce(F.nullif(external_id, F.lit("")), chunk_id.cast("string"))
    return F.format_string(
        SOURCE_LINE, rank.cast("string"), name,
        F.coalesce(F.nullif(title, F.lit("")), F.lit(MISSING)), F.coalesce(snippet, F.lit("")),
    )


def _direction(drop: Column) -> Column:
    return F.when(drop >= 0, REVENUE_FELL).when(drop < 0, REVENUE_GREW).otherwise(REVENUE_UNKNOWN)


def _sign(profit: Column) -> Column:
    return F.when(profit < 0, PROFIT_NEGATIVE).when(profit >= 0, PROFIT_OTHER).otherwise(PROFIT_UNKNOWN)


def opening(title: str, facts: Column, has_chunks: Column, target_year: int) -> Column:
    """The answer up to its source list, from request-level columns role, intent and query."""
    money = lambda c: F.coalesce(c.cast("decimal(38,2)").cast("string"), F.lit(MISSING))
    has_facts = facts.isNotNull()
    drop, profit = facts["revenue_drop_pct"], facts[f"profit_{target_year}"]
    lines = [
        F.format_string(HEADER, F.lit(title), F.col("role"), F.col("intent")),
        F.format_string(QUERY_LINE, F.coalesce("query", F.lit(""))),
        F.lit(""),
        F.when(has_facts, F.lit(FACTS_HEADING)),
        F.when(
            has_facts,
            F.format_string(
                FACTS_LINE, facts["company_name"], _direction(drop), money(F.abs(drop)), _sign(profit), money(profit),
            ),
        ),
        F.when(has_facts, F.format_string(FLAGS_LINE, F.array_join(facts["risk_flags"], ", "))),
        F.when(has_facts, F.lit("")),
        F.when(has_chunks, F.lit(CONCLUSION)).when(has_facts, F.lit(FACTS_ONLY)),
        F.when(has_chunks, F.lit("")),
        F.when(has_chunks, F.lit(SOURCES_HEADING)),
    ]
    return F.when(~has_chunks & ~has_facts, F.lit(NOTHING_FOUND)).otherwise(F.concat_ws("\n", *lines))


COUNTS = ["retrieved", "reached", "from_graph", "merged", "allowed", "node_cites"]


def step_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per query with a count per step, in one aggregate over all of them."""
    stacked = reduce(
        DataFrame.unionAll, [frames[kind].select("query_id", F.lit(kind).alias("kind")) for kind in COUNTS]
    )
    return stacked.groupBy("query_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in COUNTS])


def audit_steps() -> Column:
    """The steps a request went through, with their details, in order."""
    passed = F.col("input_reason").isNull()
    note = lambda step, *detail: F.concat(F.lit(step + ": "), *detail)
    number = lambda c: F.col(c).cast("string")
    flags = F.size(F.col("financial_facts")["risk_flags"]).cast("string")
    steps = [
        note("input_guardrails", F.coalesce("input_reason", F.lit("ok"))),
        F.when(~passed, F.lit("blocked_end")),
        F.when(passed, note("classify_intent", F.col("intent"))),
        F.when(
            F.col("intent") == "risk_analysis",
            note("financial_lookup", F.when(F.col("financial_facts").isNull(), "0").otherwise(flags), F.lit(" risk flags")),
        ),
        F.when(passed, note("vector_retrieve", number("retrieved"), F.lit(" chunks"))),
        F.when(
            passed,
            note("graph_expand", number("reached"), F.lit(" nodes, "), number("from_graph"), F.lit(" graph chunks")),
        ),
        F.when(passed, note("rbac_filter", number("allowed"), F.lit("/"), number("merged"), F.lit(" allowed"))),
        F.when(passed, note("rerank", number("allowed"), F.lit(" ranked"))),
        F.when(passed, F.lit("generate_answer")),
        F.when(passed, note("output_guardrails", F.coalesce("output_reason", F.lit("ok")))),
    ]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def audit_log(status: DataFrame) -> DataFrame:
    """One row per request and step, for an append-only log."""
    rows = status.select("query_id", "trace_id", F.posexplode("audit_steps").alias("seq", "entry"))
    return rows.select(
        "query_id",
        "trace_id",
        (F.col("seq") + 1).alias("seq"),
        F.substring_index("entry", ": ", 1).alias("step"),
        F.when(F.col("entry").contains(": "), F.expr("substring(entry, instr(entry, ': ') + 2)")).alias("detail"),
    )


def step_metrics(status: DataFrame) -> DataFrame:
    """One row per passing request and retrieval step: rows going in and coming out."""
    entry = lambda step, before, after: F.struct(
        F.lit(step).alias("step"), F.col(before).alias("rows_in"), F.col(after).alias("rows_out")
    )
    steps = F.array(
        entry("graph_expand", "retrieved", "merged"),
        entry("rbac_filter", "merged", "allowed"),
        entry("generate_answer", "allowed", "citations"),
    )
    return status.filter("input_reason IS NULL").select("query_id", "trace_id", F.explode(steps).alias("m")).select(
        "query_id", "trace_id", "m.*"
    )


def append_audit(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def ask(
    requests: DataFrame,
    query_vectors: DataFrame,
    corpus: Corpus,
    settings: RetrievalSettings = RetrievalSettings(),
    risk: RiskSettings = RiskSettings(),
    strict_nodes: bool = False,
    filter_first: bool = False,
) -> Answers:
    """Answers requests (query_id, query, role, inn, vector_id).

    Rows carry ids and scores only until they are ranked; texts and titles join the
    rows that survive. Steps read several times are written once (`settle`).
    `strict_nodes` cites a document node only if the role may read one of its chunks;
    `filter_first` applies the role before the top k instead of after the expansion.
    """
    screened, asked_rows = settle_counted(screen(requests))
    passing = screened.filter("input_reason IS NULL")
    thin_chunk = corpus.chunk.select("chunk_id", "document_id", "external_id")
    roles = corpus.chunk.select("chunk_id", "allowed_roles")

    hits, hit_rows = settle_counted(
        vector_search(
            passing.select("query_id", "role", "vector_id"), query_vectors, corpus.embedding, settings,
            readable_by_role=roles if filter_first else None, rows=asked_rows,
        )
    )
    named_hits = spread_join(
        hits, thin_chunk.select("chunk_id", "external_id"), "chunk_id", ["query_id"], rows=hit_rows
    )
    reached, reached_rows = settle_counted(
        expand(seed_nodes(named_hits), corpus.nodes, corpus.edges, settings.hops, settings.edge_types)
    )
    graph = settle(graph_chunks(reached, thin_chunk, corpus.document, reached_rows, corpus.chunk_rows))
    merged, merged_rows = settle_counted(merge_context(hits, graph))

    with_role = spread_join(
        merged, passing.select("query_id", "role"), "query_id", ["chunk_id"], rows=merged_rows
    )
    about = corpus.chunk.select(
        "chunk_id", "document_id", "external_id", "allowed_roles",
        F.substring("chunk_text", 1, SNIPPET_CHARS).alias("snippet"),
    )
    named = spread_join(with_role, about, "chunk_id", ["query_id"], weigh=merged, rows=merged_rows)
    allowed, allowed_rows = settle_counted(accessible(named).drop("allowed_roles", "role"))
    titles = corpus.document.select("document_id", F.col("title").alias("document_title"))
    context, context_rows = settle_counted(
        spread_join(
            rerank(allowed), titles, "document_id", ["query_id", "chunk_id"], "left",
            weigh=allowed, rows=allowed_rows,
        )
    )

    cited = reached
    if strict_nodes:
        readable = allowed.select("query_id", "document_id").distinct()
        open_documents = spread_join(
            readable, corpus.document.select("document_id", F.col("external_id").alias("ref_id")),
            "document_id", ["query_id"], rows=allowed_rows,
        ).select("query_id", "ref_id")
        is_document = F.col("node_type") == "Document"
        cited = reached.filter(~is_document).unionByName(
            reached.filter(is_document).join(open_documents, ["query_id", "ref_id"], "left_semi").select(*reached.columns)
        )
    nodes, node_rows = settle_counted(node_citations(cited))

    counts = step_counts(
        {"retrieved": hits, "reached": reached, "from_graph": graph, "merged": merged, "allowed": allowed,
         "node_cites": nodes}
    )
    status = screened.join(counts, "query_id", "left").fillna(0, COUNTS)
    if corpus.features is not None:
        facts = financial_lookup(
            passing.filter(F.col("intent") == "risk_analysis").select("query_id", "inn"), corpus.features, risk,
            settings.default_inn, asked_rows,
        ).select("query_id", "financial_facts")
        status = status.join(facts, "query_id", "left")
    else:
        status = status.withColumn("financial_facts", F.lit(None).cast(facts_type(risk)))
    passed = F.col("input_reason").isNull()
    text = opening(settings.answer_title, F.col("financial_facts"), F.col("allowed") > 0, risk.target_year)
    status = (
        status.withColumn("_opening", F.when(passed, text))
        .withColumn(
            "output_reason",
            F.when(passed, guard.answer_error(F.col("_opening"), F.col("allowed"), F.col("node_cites"))),
        )
        .withColumn("block_reason", F.coalesce("input_reason", "output_reason"))
        .withColumn("blocked", F.col("block_reason").isNotNull())
        .withColumn("citations", F.when(F.col("blocked"), F.lit(0)).otherwise(F.col("allowed") + F.col("node_cites")))
        .withColumn("audit_steps", audit_steps())
    )
    status = settle(status)
    citations = _citations(context, nodes, status, context_rows + node_rows)
    return Answers(status.drop("_opening"), context, reached, citations, _responses(status, citations, settings))


def _citations(context: DataFrame, nodes: DataFrame, status: DataFrame, rows: int) -> DataFrame:
    """Flat citation list of the unblocked requests: ranked chunks first, then nodes by id."""
    text = lambda c: F.lit(None).cast("string").alias(c)
    chunks = context.select(
        "query_id", F.col("rank").alias("_rank"), F.lit(0).alias("_kind"),
        "chunk_id", "external_id", "document_title", text("node_id"), text("node_type"), text("label"),
        source_line(F.col("rank"), F.col("external_id"), F.col("chunk_id"), F.col("document_title"), F.col("snippet")).alias("line"),
    )
    about_nodes = nodes.select(
        "query_id", F.col("node_rank").alias("_rank"), F.lit(1).alias("_kind"),
        F.lit(None).cast("long").alias("chunk_id"), text("external_id"), text("document_title"),
        "node_id", "node_type", "label", text("line"),
    )
    open_requests = status.filter(~F.col("blocked")).select("query_id", "allowed")
    asked = context.select("query_id").unionByName(nodes.select("query_id"))
    both = spread_join(
        chunks.unionByName(about_nodes), open_requests, "query_id", ["_kind", "_rank"], weigh=asked, rows=rows
    )
    return both.withColumn("pos", F.col("_rank") + F.when(F.col("_kind") == 1, F.col("allowed")).otherwise(0)).drop(
        "_rank", "_kind", "allowed"
    )


def _responses(status: DataFrame, citations: DataFrame, settings: RetrievalSettings) -> DataFrame:
    """Requests with answer text and citation list.

    One row per request, as long as it has no more than `page_size` citations; a longer
    list continues in rows with part 1, 2, ... so no row gathers an unbounded group.
    """
    part = F.floor((F.col("pos") - 1) / F.lit(settings.page_size)).cast("int")
    fields = ["pos", "chunk_id", "external_id", "document_title", "node_id", "node_type", "label", "line"]
    pages = citations.groupBy("query_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("items")
    )
    shown = status.select(
        "query_id", "trace_id", "blocked", "block_reason", "audit_steps", "intent", "financial_facts",
        "input_reason", "_opening",
    )
    joined = shown.join(pages, "query_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    lines = F.array_join(
        F.transform(F.filter("items", lambda c: c["line"].isNotNull()), lambda c: c["line"]), "\n"
    )
    body = F.concat_ws(
        "\n", F.when(F.col("part") == 0, F.col("_opening")), F.when(lines != "", lines)
    )
    cited = F.transform("items", lambda c: F.struct(*[c[f].alias(f) for f in fields[1:-1]]))
    return joined.select(
        "query_id", "part",
        F.when(F.col("input_reason").isNotNull(), INPUT_BLOCKED).when(F.col("blocked"), OUTPUT_BLOCKED).otherwise(body).alias("answer"),
        F.coalesce(cited, F.array().cast(
            "array<struct<chunk_id:bigint,external_id:string,document_title:string,"
            "node_id:string,node_type:string,label:string>>"
        )).alias("citations"),
        "trace_id", "blocked", F.col("block_reason").alias("reason"), "audit_steps", "intent", "financial_facts",
    )
