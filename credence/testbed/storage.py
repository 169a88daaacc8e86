"""Registered queries of the store: loads in two batches, and indexing of changed chunks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.config import RetrievalSettings
from credence.operators.graph import belongs_to_edges
from credence.plans.load import embed_changed_chunks, load_tables
from credence.session import ensure_checkpoint_dir
from credence.sources.store import TableStore
from credence.testbed.registry import SQL_STEPS, query
from credence.testbed.tables import Tables

# Every third company and document comes with the second load.
SECOND = 3


def _store(t: Tables) -> TableStore:
    root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    return TableStore(t.spark, root, ids_per_part=20_000, hash_parts=4)


def _batch(t: Tables, second: bool) -> dict[str, DataFrame]:
    """What one load brings. Some reports and nodes come twice; then the second file counts."""
    own = lambda key: (F.col(key) % SECOND == 0) == F.lit(second)
    none = F.create_map().cast("map<string,string>").alias("metadata")
    inn = F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("inn")
    customers = t.customer.filter(own("c_custkey"))
    number = F.col("inn").cast("long")
    reports = t.reports.withColumn("number", number).filter(own("number")).withColumns({"_file": F.lit("a"), "_row": F.col("number")})
    corrected = reports.filter("number % 7 = 0").withColumns({"_file": F.lit("b"), "revenue": F.col("revenue") + 1})
    documents = t.doc_ref.filter(own("document_id"))
    chunks = t.chunk_ref.filter(own("document_id")).select(
        "external_id", "chunk_text", "chunk_order", "allowed_roles", none, F.concat(F.lit("d"), F.col("document_id").cast("string")).alias("document_external_id")
    )
    nodes = t.node_ref.filter("node_type = 'Document'").withColumn("number", F.substring("ref_id", 2, 20).cast("long"))
    named = lambda df, file, label, kind="Document": df.select(
        "node_id", F.lit(kind).alias("node_type"), label.alias("label"), "ref_table", "ref_id", none, F.lit(file).alias("_file"), F.col("number").alias("_row")
    )
    arriving = nodes.filter(own("number"))
    rows = named(arriving, "a", F.col("label")).unionByName(named(arriving.filter("number % 2 = 0"), "b", F.concat(F.lit("again "), F.col("label"))))
    if second:
        known = nodes.filter(~own("number")).filter("number % 5 = 0")
        rows = rows.unionByName(named(known, "c", F.concat(F.lit("later "), F.col("label")), "Other"))
    return {
        "company": customers.select(inn, F.col("c_name").alias("name")),
        "financial_report": reports.unionByName(corrected).drop("number"),
        "company_features": customers.select(inn, (F.col("c_custkey") % 4 == 0).alias("risk_negative_profit")),
        "documents": documents.drop("document_id").withColumn("metadata", none),
        "chunks": chunks,
        "graph_nodes": rows,
        "graph_edges": belongs_to_edges(chunks).withColumn("metadata", none),
    }


SQL_STEPS["loaded_companies"] = (
    ["customer"],
    f"""select lpad(cast(c_custkey as varchar), 10, '0') as inn, c_custkey, c_name,
       row_number() over (order by c_custkey % {SECOND} = 0, lpad(cast(c_custkey as varchar), 10, '0')) as company_id from customer""",
)
SQL_STEPS["loaded_documents"] = (
    ["doc_ref"],
    f"""select external_id, document_id as number, title, document_id % {SECOND} = 0 as second,
       row_number() over (order by document_id % {SECOND} = 0, external_id) as document_id from doc_ref""",
)
SQL_STEPS["loaded_chunks"] = (
    ["chunk_ref", "loaded_documents"],
    """select c.external_id, d.document_id, d.external_id as document, row_number() over (order by d.second, c.external_id) as chunk_id
from chunk_ref c join loaded_documents d on d.number = c.document_id""",
)
SQL_STEPS["loaded_reports"] = (
    ["loaded_companies", "reports"],
    """select 'financial_report' as name, concat(c.inn, '/', r.year) as key, row_number() over (order by c.company_id, r.year) as id, c.company_id as refers_to,
       cast(cast(r.revenue + case when c.c_custkey % 7 = 0 then 1 else 0 end as decimal(18, 2)) as varchar) as detail
from reports r join loaded_companies c on c.inn = r.inn""",
)


def _loaded(t: Tables) -> TableStore:
    """Two loads, the second beside the first."""
    store = _store(t)
    load_tables(store, _batch(t, False))
    load_tables(store, _batch(t, True), truncate=False)
    return store


@query(
    "loaded_tables",
    ["loaded_companies", "loaded_reports", "loaded_chunks"],
    """
select * from loaded_reports
union all select 'company_risk', c_name, row_number() over (order by company_id), company_id, 'negative_profit' from loaded_companies where c_custkey % 4 = 0
union all select 'chunk', external_id, chunk_id, document_id, document from loaded_chunks
union all select 'graph_edge', concat('chunk:', external_id), chunk_id, chunk_id, concat('document:', document) from loaded_chunks""",
)
def loaded_tables(t: Tables) -> DataFrame:
    """Rows of four stored tables with their own ids and those of the rows they refer to."""
    store = _loaded(t)
    company, document = store.read("company").select("company_id", "inn", "name"), store.read("document")
    rows = lambda df, name, key, own, other, detail: df.select(
        F.lit(name).alias("name"), key.alias("key"), F.col(own).alias("id"), F.col(other).alias("refers_to"), detail.alias("detail")
    )
    external = F.col("metadata")["external_id"]
    revenue = F.col("revenue").cast("decimal(18,2)").cast("string")
    titles = document.select("document_id", external.alias("document"))
    parts = [
        rows(store.read("financial_report").join(company, "company_id"), "financial_report", F.concat_ws("/", "inn", "report_year"), "report_id", "company_id", revenue),
        rows(
            store.read("company_risk").join(company, "company_id").join(store.read("risk_factor"), "risk_factor_id"),
            "company_risk", F.col("name"), "company_risk_id", "company_id", F.col("code"),
        ),
        rows(store.read("chunk").join(titles, "document_id"), "chunk", external, "chunk_id", "document_id", F.col("document")),
        rows(store.read("graph_edge"), "graph_edge", F.col("source_node_id"), "edge_id", "source_chunk_id", F.col("target_node_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "loaded_twice",
    ["loaded_documents"],
    """select concat('document:', external_id) as node_id, 'Document' as node_type, external_id as ref_id,
       concat(case when not second and number % 5 = 0 then 'later ' when number % 2 = 0 then 'again ' else '' end, title) as label from loaded_documents""",
)
def loaded_twice(t: Tables) -> DataFrame:
    """Nodes that come twice in one load, and again with the next."""
    return _loaded(t).read("graph_node").select("node_id", "node_type", "ref_id", "label")


# --- indexing -----------------------------------------------------------------------------------


def _digits(run: int):
    """An encoder that SQL can follow: eight digits of the text's MD5, and the number of the run behind them."""

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        digest = F.md5(F.col(text).cast("binary"))
        digits = [F.conv(F.substring(digest, i, 1), 16, 10).cast("float") for i in range(1, 9)]
        return df.withColumn(out, F.array(*digits, F.lit(float(run))))

    return encode


@query(
    "embedded_chunks",
    ["chunk_ref"],
    """
select chunk_id, case when document_id % 11 = 0 or document_id % 5 = 0 then 2 else 1 end as run,
       cast(list_sum(list_transform(range(1, 9), lambda i: i * (instr('0123456789abcdef', substr(md5(case when document_id % 5 = 0 then concat('new ', chunk_text) else chunk_text end), i, 1)) - 1))) as bigint) as digits
from chunk_ref where document_id % 7 <> 0""",
)
def embedded_chunks(t: Tables) -> DataFrame:
    """Chunks are indexed, then some change, some go and some are new; only those are encoded again."""
    store, settings = _store(t), RetrievalSettings(embedding_dim=9)
    chunks = t.chunk_ref.drop("external_id")
    store.replace("chunk", chunks.filter("document_id % 11 <> 0"))
    embed_changed_chunks(store, _digits(1), settings)
    text = F.when(F.col("document_id") % 5 == 0, F.concat(F.lit("new "), F.col("chunk_text"))).otherwise(F.col("chunk_text"))
    store.replace("chunk", chunks.filter("document_id % 7 <> 0").withColumn("chunk_text", text))
    embed_changed_chunks(store, _digits(2), settings)
    places = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda total, i: total + i * F.element_at("embedding", i))
    return store.read("chunk_embedding").select("chunk_id", F.element_at("embedding", 9).cast("int").alias("run"), places.cast("long").alias("digits"))
