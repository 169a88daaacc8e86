"""Loading the prepared tables into the store, and indexing chunk embeddings."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import RetrievalSettings
from credence.operators import loading
from credence.operators.grouping import dense_ids, last_by
from credence.operators.vectors import Encoder, hashing_encoder
from credence.schemas import STORED_TABLES
from credence.session import settle, settled_scope
from credence.sources import seeds
from credence.sources.store import Change, TableStore

logger = logging.getLogger(__name__)


def load_tables(store: TableStore, tables: dict[str, DataFrame], truncate: bool = True) -> None:
    """Fills the stored tables. With truncate=False rows join what is stored, under its upsert rules.

    All tables change at once, at the end, and only in the partitions that rows fall into; after a failure
    the store is as before. Of rows with one key the last to arrive wins: by the columns `_file` and `_row`
    where a table has them (see `sources.store.arrivals`), else by content.
    """
    try:
        with settled_scope(store.spark), store.change() as change:
            _load_tables(change, tables, truncate)
    except (PySparkException, Py4JJavaError) as error:
        missing = loading.missing_key(error)
        if missing is None:
            raise
        raise KeyError(missing) from error


def _load_tables(change: Change, tables: dict[str, DataFrame], truncate: bool) -> None:
    spark = change.store.spark
    if truncate:
        for name in STORED_TABLES:
            change.clear(name)

    factors = dense_ids(seeds.risk_factors(spark), "code", "risk_factor_id", change.next_id("risk_factor"))
    known = change.read("risk_factor").select("code")
    change.append("risk_factor", factors.join(known, "code", "left_anti"))

    company = settle(loading.company_rows(tables["company"], change.next_id("company")))
    clash = company.join(change.read("company").select("inn"), "inn", "left_semi").take(1)
    if clash:
        raise ValueError(f"company already stored: {clash[0]['inn']}")
    change.append("company", company)

    arrived = loading.with_arrival(tables["financial_report"])
    latest = last_by(loading.report_rows(arrived, company, strict=True), ["company_id", "report_year"], ["pos"], drop_order=True)
    key = F.format_string("%020d/%010d", "company_id", "report_year")
    numbered = settle(dense_ids(latest.withColumn("_key", key), "_key", "report_id", change.next_id("financial_report")).drop("_key"))
    change.merge("financial_report", numbered, lambda old, new: loading.update_or_insert(old, new, ["company_id", "report_year"], ["report_id"]))

    risks = loading.company_risk_rows(tables["company_features"], company, change.read("risk_factor"))
    risks = risks.withColumn("_key", F.format_string("%020d/%010d", "company_id", "risk_factor_id"))
    change.append("company_risk", dense_ids(risks, "_key", "company_risk_id", change.next_id("company_risk")))

    document = settle(loading.document_rows(tables["documents"], change.next_id("document")))
    change.append("document", document)
    chunk = settle(loading.chunk_rows(tables["chunks"], document, change.next_id("chunk"), strict=True))
    change.append("chunk", chunk)

    none = F.create_map().cast("map<string,string>")
    nodes = tables["graph_nodes"].withColumn("metadata", F.coalesce("metadata", none))
    change.merge("graph_node", loading.with_arrival(nodes), lambda old, new: loading.merge_nodes(old, new, ["pos"]))
    edges = tables["graph_edges"].withColumn("metadata", F.coalesce("metadata", none))
    change.append("graph_edge", loading.edge_rows(edges, chunk, change.next_id("graph_edge")))


def embed_all_chunks(
    store: TableStore,
    encoder: Encoder | None = None,
    settings: RetrievalSettings = RetrievalSettings(),
) -> int:
    """Encodes every stored chunk and upserts its vector; returns how many. A wrong dimension only warns."""
    with settled_scope(store.spark):
        return _embed_all_chunks(store, encoder, settings)


def _embed_all_chunks(store: TableStore, encoder: Encoder | None, settings: RetrievalSettings) -> int:
    chunks = store.read("chunk").select("chunk_id", "chunk_text")
    if chunks.isEmpty():
        logger.warning("no chunks to encode; load the tables first")
        return 0
    rows = _encoded(chunks, encoder, settings)
    counts = _checked(rows, settings)
    with store.change() as change:
        change.merge("chunk_embedding", rows, lambda old, new: loading.update_or_insert(old, new, ["chunk_id"], []))
    return counts


def _encoded(chunks: DataFrame, encoder: Encoder | None, settings: RetrievalSettings) -> DataFrame:
    encode = encoder or hashing_encoder(settings.embedding_dim)
    vectors = encode(chunks, "chunk_text", "embedding")
    return settle(
        vectors.select(
            "chunk_id",
            F.col("embedding").cast("array<float>").alias("embedding"),
            F.lit(settings.encoder_name).alias("model_name"),
            F.current_timestamp().alias("updated_at"),
            content_hash(F.col("chunk_text")).alias("content_hash"),
        )
    )


def _checked(rows: DataFrame, settings: RetrievalSettings) -> int:
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != settings.embedding_dim).alias("odd")
    ).first()
    if counts["odd"]:
        logger.warning("%s of %s vectors differ from dimension %s", counts["odd"], counts["n"], settings.embedding_dim)
    return counts["n"]


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def changed_chunks(chunk: DataFrame, embedding: DataFrame, model: str) -> DataFrame:
    """chunk_id and what became of it: `inserted`, `changed` (its text, or the model), `removed`. The rest is left out.

    Only ids and hashes are compared.
    """
    now = chunk.select("chunk_id", content_hash(F.col("chunk_text")).alias("now"))
    then = embedding.select("chunk_id", F.struct("content_hash", "model_name").alias("then"))
    same = (F.col("then.content_hash") == F.col("now")) & (F.col("then.model_name") == model)
    state = F.when(F.col("then").isNull(), "inserted").when(F.col("now").isNull(), "removed").when(~F.coalesce(same, F.lit(False)), "changed")
    return now.join(then, "chunk_id", "full_outer").select("chunk_id", state.alias("state")).filter("state is not null")


def embed_changed_chunks(
    store: TableStore,
    encoder: Encoder | None = None,
    settings: RetrievalSettings = RetrievalSettings(),
) -> dict[str, int]:
    """Encodes new and changed chunks and deletes vectors whose chunk is gone; returns how many of each.

    Vectors of other chunks are neither computed nor, unless they share a partition with a change, rewritten.
    """
    with settled_scope(store.spark):
        states = settle(changed_chunks(store.read("chunk"), store.read("chunk_embedding"), settings.encoder_name))
        counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}  # three states
        found = {state: counts.get(state, 0) for state in ("inserted", "changed", "removed")}
        if not any(found.values()):
            return found
        wanted = states.filter("state <> 'removed'").select("chunk_id")
        rows = _encoded(store.read("chunk").join(wanted, "chunk_id", "left_semi"), encoder, settings)
        _checked(rows, settings)
        touched = rows.select("*", F.lit(False).alias("gone")).unionByName(
            states.filter("state = 'removed'").select("chunk_id", F.lit(True).alias("gone")), allowMissingColumns=True
        )

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = old.join(new.select("chunk_id"), "chunk_id", "left_anti")
            return kept.unionByName(new.filter("not gone").drop("gone"))

        with store.change() as change:
            change.merge("chunk_embedding", settle(touched), combine)
        return found
