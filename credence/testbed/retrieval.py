"""Registered queries of the retrieval side: screening, search, graph, access, ranking, answers."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.config import RetrievalSettings
from credence.functions import guard
from credence.operators import checks, loading
from credence.operators.documents import split_documents
from credence.operators.evaluation import compare_runs, poisson_steps
from credence.operators.graph import expand, graph_chunks, seed_nodes
from credence.operators.grouping import grouped_rank, spread_join
from credence.operators.ranking import accessible, dedupe_chunks, merge_context, rerank, rrf
from credence.operators.reports import company_features
from credence.operators.vectors import hashing_encoder, nearest, nearest_probed, recall, store_vectors, vector_search
from credence.plans.ask import (
    CONCLUSION,
    FACTS_HEADING,
    FACTS_LINE,
    FACTS_ONLY,
    INPUT_BLOCKED,
    NOTHING_FOUND,
    OUTPUT_BLOCKED,
    PROFIT_NEGATIVE,
    PROFIT_OTHER,
    PROFIT_UNKNOWN,
    REVENUE_FELL,
    REVENUE_GREW,
    REVENUE_UNKNOWN,
    SOURCES_HEADING,
    ask,
    financial_lookup,
    node_citations,
    retrieved_chunks,
    screen,
)
from credence.session import settle
from credence.testbed import batch  # noqa: F401  (its SQL steps are read here)
from credence.testbed.registry import SQL_STEPS, query
from credence.testbed.tables import SETTINGS, Tables

RETRIEVAL = RetrievalSettings(embedding_dim=64)

# --- SQL steps ---------------------------------------------------------------------

_reason = "case when text = '' then 'empty_query' when length(text) > 4000 then 'query_too_long'\n" + "\n".join(
    f"when regexp_matches(text, '(?i){p}') then 'blocked_pattern:{p}'" for p in guard.BLOCKED_PATTERNS
) + " end"
_any = lambda stems: " or ".join(f"contains(lower(query), '{s}')" for s in stems)

SQL_STEPS["screened"] = (
    ["ask_ref"],
    f"""
select *, case when input_reason is null then case when {_any(guard.RISK_STEMS)} then 'risk_analysis'
       when {_any(guard.COMPLIANCE_STEMS)} then 'compliance' else 'general' end end as intent
from (select *, {_reason} as input_reason
      from (select *, trim(query, ' ' || chr(9) || chr(10) || chr(13)) as text from ask_ref) a) b""",
)
SQL_STEPS["passing"] = (["screened"], "select * from screened where input_reason is null")
SQL_STEPS["top"] = (
    ["query_vectors", "chunk_embedding_ref"],
    """
select * from (
  select vector_id, chunk_id, s as vector_score, row_number() over (partition by vector_id order by round(s, 9) desc, chunk_id) as rank
  from (select v.vector_id, e.chunk_id,
               list_cosine_similarity(cast(v.embedding as double[]), cast(e.embedding as double[])) as s
        from query_vectors v cross join chunk_embedding_ref e) p) r
where rank <= 3""",
)
SQL_STEPS["hits"] = (
    ["passing", "top"],
    "select p.query_id, p.role, t.chunk_id, t.vector_score, t.rank from passing p join top t on t.vector_id = p.vector_id",
)
SQL_STEPS["both_ways"] = (
    ["edge_ref"],
    """
select source_node_id as node_id, target_node_id as neighbour from edge_ref where edge_type in ('BELONGS_TO', 'MENTIONS', 'LINKED_TO')
union select target_node_id, source_node_id from edge_ref where edge_type in ('BELONGS_TO', 'MENTIONS', 'LINKED_TO')""",
)
SQL_STEPS["asked_seeds"] = (
    ["ask_ref"],
    "select query_id, concat('chunk:c', cast(vector_id as varchar), '_0') as node_id from ask_ref",
)


def _walk_sql(seeds: str, hops: int) -> str:
    return f"""
select query_id, node_id, 0 as depth from {seeds}
union
select w.query_id, b.neighbour, w.depth + 1 from {{walk}} w join both_ways b on b.node_id = w.node_id where w.depth < {hops}"""


for _name, _seeds, _hops in (("walk_1", "asked_seeds", 1), ("walk_2", "asked_seeds", 2), ("walk_3", "asked_seeds", 3), ("walk_hits", "hit_seeds", 1)):
    SQL_STEPS[_name] = ([_seeds, "both_ways"], _walk_sql(_seeds, _hops).replace("{walk}", _name))

SQL_STEPS["hit_seeds"] = (
    ["hits", "chunk_ref"],
    "select distinct h.query_id, concat('chunk:', c.external_id) as node_id from hits h join chunk_ref c on c.chunk_id = h.chunk_id",
)


def _reached_sql(walk: str) -> str:
    return f"""
select w.query_id, n.node_id, n.node_type, n.label, n.ref_id, w.depth
from (select query_id, node_id, min(depth) as depth from {walk} group by query_id, node_id) w join node_ref n on n.node_id = w.node_id"""


def _found_sql(reached: str) -> str:
    return f"""
select r.query_id, c.chunk_id, 1 as stage, cast(1.0 as double) as graph_score from {reached} r join chunk_ref c on c.external_id = r.ref_id where r.node_type = 'Chunk'
union all
select r.query_id, c.chunk_id, 2, cast(0.8 as double) from {reached} r join doc_ref d on d.external_id = r.ref_id
join chunk_ref c on c.document_id = d.document_id where r.node_type = 'Document'"""


for _walk in ("walk_1", "walk_2", "walk_3", "walk_hits"):
    SQL_STEPS["reached_" + _walk[5:]] = ([_walk, "node_ref"], _reached_sql(_walk))
    SQL_STEPS["found_" + _walk[5:]] = (["reached_" + _walk[5:], "chunk_ref", "doc_ref"], _found_sql("reached_" + _walk[5:]))

SQL_STEPS["merged"] = (
    ["hits", "found_hits"],
    """
select query_id, chunk_id, stage, place, vector_score, graph_score, source from (
  select *, row_number() over (partition by query_id, chunk_id order by stage, place) as rn from (
    select query_id, chunk_id, 0 as stage, rank as place, vector_score, cast(0.0 as double) as graph_score, 'vector' as source from hits
    union all
    select query_id, chunk_id, stage, chunk_id, cast(0.0 as double), graph_score, 'graph' from found_hits) u) x
where rn = 1""",
)
SQL_STEPS["allowed"] = (
    ["merged", "passing", "chunk_ref"],
    """
select m.*, c.document_id, c.external_id, substring(c.chunk_text, 1, 120) as snippet
from merged m join passing p on p.query_id = m.query_id join chunk_ref c on c.chunk_id = m.chunk_id
where list_contains(c.allowed_roles, p.role)""",
)
SQL_STEPS["ranked"] = (
    ["allowed"],
    """
select *, row_number() over (partition by query_id order by final_score desc, stage, place) as rank
from (select *, round_even(vector_score + 0.5 * graph_score, 6) as final_score from allowed) a""",
)
SQL_STEPS["cited_nodes"] = (
    ["reached_hits"],
    """
select query_id, node_id, node_type, label, row_number() over (partition by query_id order by node_id) as node_rank
from reached_hits where node_type in ('Document', 'LegalAct', 'RiskFactor', 'Company')""",
)


def _count_sql(table: str, name: str) -> str:
    return f"left join (select query_id, count(*) as {name} from {table} group by query_id) using (query_id)"


SQL_STEPS["counted"] = (
    ["screened", "hits", "reached_hits", "found_hits", "merged", "allowed", "cited_nodes"],
    "select s.* exclude (text), coalesce(retrieved, 0) as retrieved, coalesce(reached, 0) as reached, coalesce(from_graph, 0) as from_graph, "
    "coalesce(merged, 0) as merged, coalesce(allowed, 0) as allowed, coalesce(node_cites, 0) as node_cites from screened s "
    + " ".join(
        _count_sql(table, name)
        for table, name in (
            ("hits", "retrieved"), ("reached_hits", "reached"), ("found_hits", "from_graph"),
            ("merged", "merged"), ("allowed", "allowed"), ("cited_nodes", "node_cites"),
        )
    ),
)
SQL_STEPS["status"] = (
    ["counted", "features", "dim"],
    """
select c.*, f.inn is not null as has_facts, f.company_label, f.revenue_drop_2000_pct, f.net_profit_2000, f.risk_count, f.flags,
       case when input_reason is null and allowed + node_cites = 0 then 'no_citations' end as output_reason
from counted c left join (
  select inn, company_label, revenue_drop_2000_pct, net_profit_2000, risk_count,
         concat_ws(', ', case when risk_revenue_drop_gt_30 then 'revenue_drop_gt_30' end,
                   case when risk_negative_profit then 'negative_profit' end, case when risk_assets_drop_gt_25 then 'assets_drop_gt_25' end,
                   case when risk_negative_equity then 'negative_equity' end, case when risk_data_quality_issue then 'data_quality_issue' end) as flags
  from features join dim using (inn)) f on f.inn = c.inn and c.intent = 'risk_analysis'""",
)
SQL_STEPS["audited"] = (
    ["status"],
    """
select *, list_filter([concat('input_guardrails: ', coalesce(input_reason, 'ok')),
  case when input_reason is not null then 'blocked_end' end,
  case when input_reason is null then concat('classify_intent: ', intent) end,
  case when intent = 'risk_analysis' then concat('financial_lookup: ', coalesce(risk_count, 0), ' risk flags') end,
  case when input_reason is null then concat('vector_retrieve: ', retrieved, ' chunks') end,
  case when input_reason is null then concat('graph_expand: ', reached, ' nodes, ', from_graph, ' graph chunks') end,
  case when input_reason is null then concat('rbac_filter: ', allowed, '/', merged, ' allowed') end,
  case when input_reason is null then concat('rerank: ', allowed, ' ranked') end,
  case when input_reason is null then 'generate_answer' end,
  case when input_reason is null then concat('output_guardrails: ', coalesce(output_reason, 'ok')) end], lambda x: x is not null) as audit_steps
from status""",
)
SQL_STEPS["cited"] = (
    ["ranked", "doc_ref", "cited_nodes", "status"],
    """
select r.query_id, rank as pos, chunk_id, r.external_id, d.title as document_title, cast(null as varchar) as node_id, cast(null as varchar) as node_type, cast(null as varchar) as label,
       concat(rank, '. [', r.external_id, '] ', d.title, ': ', snippet, '…') as line
from ranked r join doc_ref d on d.document_id = r.document_id
union all
select n.query_id, s.allowed + node_rank, null, null, null, n.node_id, n.node_type, n.label, null
from cited_nodes n join status s on s.query_id = n.query_id""",
)


# --- screening ------------------------------------------------------------------------


@query("input_guard", ["screened"], "select query_id, input_reason from screened")
def input_guard(t: Tables) -> DataFrame:
    return screen(t.ask_ref).select("query_id", "input_reason")


@query(
    "intent",
    ["screened"],
    "select query_id, md5(cast(query_id as varchar)) as trace_id, intent, case when intent = 'compliance' then 'compliance' end as search_scope from screened",
)
def intents(t: Tables) -> DataFrame:
    return screen(t.ask_ref).select("query_id", "trace_id", "intent", "search_scope")


@query(
    "request_errors",
    ["ask_ref"],
    """select query_id, case when length(query) > 4000 then 'query_too_long' when query_id % 3 = 1 then 'unknown_role' end as error
from ask_ref where length(query) > 4000 or query_id % 3 = 1""",
)
def request_errors(t: Tables) -> DataFrame:
    odd = F.when(F.col("query_id") % 3 == 1, "auditor").when(F.col("query_id") % 3 == 0, F.col("role"))
    return guard.split_requests(t.ask_ref.withColumn("role", odd))[1].select("query_id", "error")


# --- documents, vectors -------------------------------------------------------------------


@query(
    "split_documents",
    ["chunk_ref"],
    "select document_id, chunk_order, length(chunk_text) as chars, md5(chunk_text) as digest from chunk_ref",
)
def split_plain(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("document_id"), "text")
    return split_documents(rows, 1000).select(
        "document_id", "chunk_order", F.char_length("chunk_text").cast("long").alias("chars"), F.md5("chunk_text").alias("digest")
    )


@query(
    "split_overlapping",
    ["documents"],
    """
select doc_id as document_id, cast(o as int) as chunk_order, md5(substring(text, cast(o * 400 + 1 as int), 500)) as digest
from (select doc_id, text, unnest(range(0, greatest(1, (length(text) - 100 + 399) // 400))) as o from documents where length(text) > 0) x""",
)
def split_overlapping(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("document_id"), "text")
    return split_documents(rows, 500, 100).select("document_id", "chunk_order", F.md5("chunk_text").alias("digest"))


@query("encode_chunks")
def encode_chunks(t: Tables) -> DataFrame:
    encoded = hashing_encoder()(t.chunk_ref.select("chunk_id", "chunk_text"), "chunk_text", "embedding")
    return encoded.select("chunk_id", "embedding")


@query("wrong_dimension", ["embeddings"], "select count(*) filter (where len(embedding) <> 64) as wrong, count(*) as total from embeddings")
def wrong_dimension(t: Tables) -> DataFrame:
    return checks.wrong_dimension(t.embeddings, 64)


@query(
    "embedding_upsert",
    ["chunk_embedding_ref", "documents"],
    """
select chunk_id, case when d.lang = 'en' then 'new' else 'old' end as model_name, round(cast(embedding[1] as double), 6) as head
from chunk_embedding_ref e join documents d on d.doc_id = e.chunk_id // 1000""",
)
def embedding_upsert(t: Tables) -> DataFrame:
    """All vectors are stored; those of English documents arrive again from another model."""
    vectors = t.chunk_embedding_ref.join(t.chunk_ref.select("chunk_id", "document_id"), "chunk_id")
    english = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("document_id"))
    old = vectors.withColumn("model_name", F.lit("old"))
    new = vectors.join(english, "document_id", "left_semi").select(
        "chunk_id", "embedding", F.lit("new").alias("model_name"), F.lit(1).alias("pos")
    )
    merged = loading.upsert(old.drop("document_id"), new, ["chunk_id"], ["pos"])
    return merged.select("chunk_id", "model_name", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))


def _passing(t: Tables) -> DataFrame:
    return settle(screen(t.ask_ref)).filter("input_reason IS NULL")


def _hits(t: Tables, filter_first: bool = False) -> DataFrame:
    roles = t.chunk_ref.select("chunk_id", "allowed_roles") if filter_first else None
    return vector_search(_passing(t), t.query_vectors, t.chunk_embedding_ref, RETRIEVAL, roles)


@query("vector_topk", ["hits"], "select query_id, chunk_id, round(vector_score, 6) as vector_score, rank from hits")
def vector_topk(t: Tables) -> DataFrame:
    return _hits(t).select("query_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "rank")


@query(
    "vector_topk_by_cells",
    ["top"],
    "select vector_id, chunk_id, round(vector_score, 6) as vector_score, rank from top",
)
def vector_topk_by_cells(t: Tables) -> DataFrame:
    """The same exact search over the stored leaves."""
    hits = nearest(t.query_vectors, store_vectors(t.chunk_embedding_ref), 3)
    return hits.select("vector_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "rank")


@query(
    "vector_topk_filter_first",
    ["passing", "query_vectors", "chunk_embedding_ref", "chunk_ref"],
    """
select query_id, chunk_id, rank from (
  select p.query_id, e.chunk_id, row_number() over (partition by p.query_id order by round(e.s, 9) desc, e.chunk_id) as rank
  from passing p join (
    select v.vector_id, e.chunk_id, c.allowed_roles,
           list_cosine_similarity(cast(v.embedding as double[]), cast(e.embedding as double[])) as s
    from query_vectors v cross join chunk_embedding_ref e join chunk_ref c on c.chunk_id = e.chunk_id) e
  on e.vector_id = p.vector_id and list_contains(e.allowed_roles, p.role)) r
where rank <= 3""",
)
def vector_topk_filter_first(t: Tables) -> DataFrame:
    return _hits(t, filter_first=True).select("query_id", "chunk_id", "rank")


@query("ann_topk")
def ann_topk(t: Tables) -> DataFrame:
    return nearest_probed(t.query_vectors, t.chunk_embedding_ref, 3, probes=16)


@query("ann_recall")
def ann_recall(t: Tables) -> DataFrame:
    exact = nearest(t.query_vectors, t.chunk_embedding_ref, 3)
    return recall(nearest_probed(t.query_vectors, t.chunk_embedding_ref, 3, probes=16), exact)


_draw = "cast('0x' || substr(md5(concat(vector_id, ':', draw, ':0')), 1, 8) as bigint) / 4294967296.0::double"
_weight = " + ".join(f"case when u >= {step!r}::double then 1 else 0 end" for step in poisson_steps())


@query(
    "compared_runs",
    ["top", "query_vectors", "chunk_embedding_ref"],
    f"""
select queries, round(recall_one, 6) as recall_one, round(recall_two, 6) as recall_two, round(overlap, 6) as overlap,
       round(gain, 6) as gain, round(low, 6) as low, round(high, 6) as high, round(ahead, 6) as ahead
from (with other as (
  select vector_id, chunk_id from (
    select v.vector_id, e.chunk_id, row_number() over (partition by v.vector_id order by
             round(list_cosine_similarity(cast(v.embedding as double[]), cast(e.embedding as double[])), 9) desc, e.chunk_id) as rank
    from query_vectors v cross join chunk_embedding_ref e where (e.chunk_id // 1000) % 3 <> 0) r where rank <= 3),
judged as (
  select t.vector_id, count(*) filter (t.rank <= 2) / count(*) as one, count(o.chunk_id) / count(*) as two,
         count(o.chunk_id) filter (t.rank <= 2) / 3 as overlap
  from top t left join other o on o.vector_id = t.vector_id and o.chunk_id = t.chunk_id group by t.vector_id),
drawn as (
  select draw, sum(w * (one - two)) / nullif(sum(w), 0) as gain
  from (select *, {_weight} as w from (select *, {_draw} as u from judged, (select unnest(range(1, 101)) as draw))) group by draw)
select (select count(*) from judged) as queries, (select avg(one) from judged) as recall_one, (select avg(two) from judged) as recall_two,
       (select avg(overlap) from judged) as overlap, (select avg(one - two) from judged) as gain, quantile_cont(gain, 0.025) as low,
       quantile_cont(gain, 0.975) as high, avg(case when gain > 0 then 1.0 else 0.0 end) as ahead from drawn)""",
)
def compared_runs(t: Tables) -> DataFrame:
    """The two best hits against a search of two thirds of the documents; the exact three best are the judgements."""
    golden = settle(nearest(t.query_vectors, t.chunk_embedding_ref, 3))
    fewer = t.chunk_embedding_ref.filter(F.floor(F.col("chunk_id") / 1000) % 3 != 0)
    runs = [df.withColumnRenamed("vector_id", "query_id") for df in (golden, golden.filter("rank <= 2"), nearest(t.query_vectors, fewer, 3))]
    found = compare_runs(*runs, k=3, draws=100)
    return found.select("queries", *[F.round(c, 6).alias(c) for c in found.columns if c != "queries"])


@query(
    "retrieved_chunks",
    ["hits", "chunk_ref", "doc_ref"],
    """
select h.query_id, h.rank, h.chunk_id, c.external_id, d.title as document_title, d.document_id, length(c.chunk_text) as chars,
       array_to_string(c.allowed_roles, ',') as roles, round(h.vector_score, 6) as vector_score, cast(0.0 as double) as graph_score, 'vector' as source
from hits h join chunk_ref c on c.chunk_id = h.chunk_id join doc_ref d on d.document_id = c.document_id""",
)
def retrieved(t: Tables) -> DataFrame:
    rows = retrieved_chunks(_hits(t), t.chunk_ref, t.doc_ref)
    return rows.select(
        "query_id", "rank", "chunk_id", "external_id", "document_title", "document_id",
        F.char_length("chunk_text").cast("long").alias("chars"), F.array_join("allowed_roles", ",").alias("roles"),
        F.round("vector_score", 6).alias("vector_score"), "graph_score", "source",
    )


# --- graph ------------------------------------------------------------------------------------


def _asked_reach(t: Tables, hops: int) -> DataFrame:
    seeds = t.ask_ref.select("query_id", F.concat(F.lit("c"), F.col("vector_id").cast("string"), F.lit("_0")).alias("external_id"))
    return expand(seed_nodes(seeds), t.node_ref, t.adjacency, hops)


REACHED = ["query_id", "node_id", "node_type", "label", "depth"]


@query("graph_expand_1", ["reached_1"], f"select {', '.join(REACHED)} from reached_1")
def graph_expand_1(t: Tables) -> DataFrame:
    return _asked_reach(t, 1).select(*REACHED)


@query("graph_expand_2", ["reached_2"], f"select {', '.join(REACHED)} from reached_2")
def graph_expand_2(t: Tables) -> DataFrame:
    return _asked_reach(t, 2).select(*REACHED)


@query("graph_expand_3", ["reached_3"], f"select {', '.join(REACHED)} from reached_3")
def graph_expand_3(t: Tables) -> DataFrame:
    return _asked_reach(t, 3).select(*REACHED)


@query("graph_chunks", ["found_1"], "select query_id, chunk_id, stage, graph_score from found_1")
def found_chunks(t: Tables) -> DataFrame:
    return graph_chunks(_asked_reach(t, 1), t.chunk_ref.select("chunk_id", "document_id", "external_id"), t.doc_ref)


# --- merging, access, ranking ---------------------------------------------------------------------


def _merged(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits = settle(_hits(t))
    thin = t.chunk_ref.select("chunk_id", "document_id", "external_id")
    named = spread_join(hits, thin.select("chunk_id", "external_id"), "chunk_id", ["query_id"])
    reached = settle(expand(seed_nodes(named), t.node_ref, t.adjacency, 1))
    return hits, reached, merge_context(hits, graph_chunks(reached, thin, t.doc_ref))


def _allowed(t: Tables) -> DataFrame:
    merged = settle(_merged(t)[2])
    with_role = spread_join(merged, t.ask_ref.select("query_id", "role"), "query_id", ["chunk_id"])
    return accessible(spread_join(with_role, t.chunk_ref.select("chunk_id", "allowed_roles"), "chunk_id", ["query_id"]))


@query(
    "merged_context",
    ["merged"],
    "select query_id, chunk_id, stage, place, round(vector_score, 6) as vector_score, graph_score, source from merged",
)
def merged_context(t: Tables) -> DataFrame:
    return _merged(t)[2].withColumn("vector_score", F.round("vector_score", 6)).select(
        "query_id", "chunk_id", "stage", "place", "vector_score", "graph_score", "source"
    )


@query(
    "chunk_dedupe",
    ["conversations"],
    """select conv_id as query_id, length(text) % 5 as chunk_id, min(turn) as place from conversations
where length(text) % 5 <> 4 group by 1, 2""",
)
def chunk_dedupe(t: Tables) -> DataFrame:
    """Turns stand in for context rows; text length modulo five for the (sometimes missing) chunk id."""
    number = F.char_length("text") % 5
    rows = t.conversations.select(
        F.col("conv_id").alias("query_id"), F.when(number != 4, number.cast("long")).alias("chunk_id"),
        F.lit(0).alias("stage"), F.col("turn").alias("place"),
    )
    return dedupe_chunks(rows).select("query_id", "chunk_id", "place")


@query("role_filter", ["allowed"], "select query_id, chunk_id, source from allowed")
def role_filter(t: Tables) -> DataFrame:
    return _allowed(t).select("query_id", "chunk_id", "source")


@query("rerank", ["ranked"], "select query_id, chunk_id, final_score, rank from ranked")
def reranked(t: Tables) -> DataFrame:
    return rerank(settle(_allowed(t))).select("query_id", "chunk_id", "final_score", "rank")


@query(
    "rerank_trace",
    ["ranked"],
    "select query_id, chunk_id, round_even(vector_score + 0.5 * graph_score, 4) as final_score, rank from ranked where rank <= 5",
)
def rerank_trace(t: Tables) -> DataFrame:
    top = rerank(settle(_allowed(t))).filter("rank <= 5")
    score = F.bround(F.col("vector_score") + 0.5 * F.col("graph_score"), 4)
    return top.select("query_id", "chunk_id", score.alias("final_score"), "rank")


@query(
    "rrf",
    ["allowed"],
    """
select query_id, chunk_id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, chunk_id) as rank
from (select query_id, chunk_id, round_even(sum(1.0::double / (60 + rank)), 9) as rrf_score
      from (select query_id, chunk_id, place as rank from allowed where stage = 0
            union all
            select query_id, chunk_id, row_number() over (partition by query_id order by stage, chunk_id) from allowed where stage > 0) l
      group by query_id, chunk_id) f""",
)
def fused(t: Tables) -> DataFrame:
    allowed = settle(_allowed(t))
    dense = allowed.filter("stage = 0").withColumn("rank", F.col("place"))
    graph = grouped_rank(
        allowed.filter("stage > 0"), ["query_id"], [F.col("stage"), F.col("chunk_id")],
        [F.col("stage"), F.floor(F.col("chunk_id") / 65_536)], "rank",
    )
    return rrf(dense, graph).select("query_id", "chunk_id", "rrf_score", "rank")


# --- facts and answers --------------------------------------------------------------------------------


@query(
    "financial_lookup",
    ["passing", "features", "dim"],
    """
select p.query_id, company_label as company_name, revenue_2000, round(revenue_drop_2000_pct, 6) as revenue_drop_pct, net_profit_2000 as profit_2000, risk_count as flags
from passing p left join (select * from features join dim using (inn)) f on f.inn = p.inn where p.intent = 'risk_analysis'""",
)
def facts(t: Tables) -> DataFrame:
    asked = _passing(t).filter("intent = 'risk_analysis'").select("query_id", "inn")
    found = financial_lookup(asked, company_features(t.reports, SETTINGS), SETTINGS)
    f = "financial_facts."
    return found.select(
        "query_id", f + "company_name", f + "revenue_2000", F.round(f + "revenue_drop_pct", 6).alias("revenue_drop_pct"),
        f + "profit_2000", F.when(F.col("financial_facts").isNotNull(), F.size(f + "risk_flags")).alias("flags"),
    )


def _answers(t: Tables, **options):
    return ask(
        t.ask_ref, t.query_vectors, t.corpus(company_features(t.reports, SETTINGS)), RETRIEVAL, SETTINGS, **options
    )


@query(
    "node_citations",
    ["cited_nodes"],
    "select query_id, node_id, node_type, label, node_rank from cited_nodes",
)
def cited_nodes(t: Tables) -> DataFrame:
    return node_citations(_merged(t)[1]).select("query_id", "node_id", "node_type", "label", "node_rank")


@query(
    "ask_citations",
    ["cited"],
    "select query_id, pos, chunk_id, external_id, document_title, node_id, node_type, label from cited",
)
def ask_citations(t: Tables) -> DataFrame:
    return _answers(t).citations.drop("line")


@query(
    "ask_audit",
    ["audited"],
    """
select query_id, md5(cast(query_id as varchar)) as trace_id, cast(seq as int) as seq, split_part(entry, ': ', 1) as step,
       case when contains(entry, ': ') then substring(entry, instr(entry, ': ') + 2) end as detail
from (select query_id, unnest(audit_steps) as entry, generate_subscripts(audit_steps, 1) as seq from audited) a""",
)
def ask_audit(t: Tables) -> DataFrame:
    return _answers(t).audit_log()


@query(
    "ask_metrics",
    ["status"],
    """
select query_id, md5(cast(query_id as varchar)) as trace_id, unnest(['graph_expand', 'rbac_filter', 'generate_answer']) as step,
       unnest([retrieved, merged, allowed]) as rows_in, unnest([merged, allowed, allowed + node_cites]) as rows_out
from status where input_reason is null""",
)
def ask_metrics(t: Tables) -> DataFrame:
    return _answers(t).step_metrics()


_money = lambda c: f"coalesce(cast(cast({c} as decimal(38, 2)) as varchar), '—')"


@query(
    "ask_responses",
    ["audited", "cited"],
    f"""
select a.query_id, 0 as part,
  case when input_reason is not null then '{INPUT_BLOCKED}' when output_reason is not null then '{OUTPUT_BLOCKED}'
  when allowed = 0 and not has_facts then '{NOTHING_FOUND}'
  else concat_ws(chr(10), concat('**', '{RETRIEVAL.answer_title}', '** — роль `', role, '`, intent `', intent, '`.'), concat('Запрос: ', query), '',
    case when has_facts then concat_ws(chr(10), '{FACTS_HEADING}', printf('{FACTS_LINE}', company_label,
      case when revenue_drop_2000_pct >= 0 then '{REVENUE_FELL}' when revenue_drop_2000_pct < 0 then '{REVENUE_GREW}' else '{REVENUE_UNKNOWN}' end,
      {_money('abs(revenue_drop_2000_pct)')},
      case when net_profit_2000 < 0 then '{PROFIT_NEGATIVE}' when net_profit_2000 >= 0 then '{PROFIT_OTHER}' else '{PROFIT_UNKNOWN}' end,
      {_money('net_profit_2000')}),
      concat('Флаги риска: ', flags, '.'), '') end,
    case when allowed > 0 then concat_ws(chr(10), '{CONCLUSION}', '', '{SOURCES_HEADING}') when has_facts then '{FACTS_ONLY}' end,
    lines) end as answer,
  coalesce(cites, '') as citations, coalesce(input_reason, output_reason) as reason,
  input_reason is not null or output_reason is not null as blocked, array_to_string(audit_steps, ' | ') as audit_steps, intent
from audited a left join (
  select query_id, string_agg(line, chr(10) order by pos) as lines,
         string_agg(coalesce(external_id, node_id), ',' order by pos) as cites
  from cited group by query_id) c using (query_id)""",
)
def ask_responses(t: Tables) -> DataFrame:
    names = F.transform("citations", lambda c: F.coalesce(c["external_id"], c["node_id"]))
    return _answers(t).responses.select(
        "query_id", "part", "answer", F.array_join(names, ",").alias("citations"), "reason", "blocked",
        F.array_join("audit_steps", " | ").alias("audit_steps"), "intent",
    )


SQL_STEPS["strict_nodes"] = (
    ["reached_hits", "allowed", "doc_ref"],
    """
select query_id, node_id, node_type, label, row_number() over (partition by query_id order by node_id) as node_rank
from reached_hits r where node_type in ('LegalAct', 'RiskFactor', 'Company') or node_type = 'Document' and (query_id, ref_id) in (
  select a.query_id, d.external_id from allowed a join doc_ref d on d.document_id = a.document_id)""",
)


@query(
    "ask_strict_nodes",
    ["ranked", "doc_ref", "strict_nodes", "counted"],
    """
select r.query_id, rank as pos, chunk_id, r.external_id, d.title as document_title, cast(null as varchar) as node_id,
       cast(null as varchar) as node_type, cast(null as varchar) as label
from ranked r join doc_ref d on d.document_id = r.document_id
union all
select n.query_id, c.allowed + node_rank, null, null, null, n.node_id, n.node_type, n.label
from strict_nodes n join counted c on c.query_id = n.query_id""",
)
def ask_strict_nodes(t: Tables) -> DataFrame:
    """Citations when a document is cited only to roles that may read one of its chunks."""
    return _answers(t, strict_nodes=True).citations.drop("line")
