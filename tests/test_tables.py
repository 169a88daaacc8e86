import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from credence import schemas
from credence.config import RISK_FACTORS, RetrievalSettings
from credence.operators import checks, loading
from credence.plans.load import embed_all_chunks, embed_changed_chunks, load_tables
from credence.plans.prepare import prepare
from credence.sources.export import export_tables, manifest, order_violations, reread, write_sorted
from credence.sources.seeds import demo_bundle
from credence.sources.store import TableStore, arrivals

INN = "7700000001"


@pytest.fixture(scope="module")
def bundle(spark):
    company = spark.createDataFrame(
        [(INN, "123", "Компания", "normal", "1999-05-06T00:00:00", ""), ("7700000002", "124", "Вторая", "normal", None, None)],
        "inn string, ogrn string, company_label string, sample_bucket string, creation_date string, dissolution_date string",
    )
    report = spark.createDataFrame(
        [(inn, y, r, p, 50.0, 1.0, f) for inn in (INN, "7700000002") for y, r, p, f in ((2023, 100.0, 10.0, 0.0), (2024, 60.0, -1.0, None))],
        "inn string, year int, revenue double, net_profit double, assets double, filed double, imputed double",
    )
    features = spark.createDataFrame(
        [(INN, "normal", True, True), ("7700000002", "normal", False, True)],
        "inn string, sample_bucket string, risk_revenue_drop_gt_30 boolean, risk_negative_profit boolean",
    )
    return {"company": company, "financial_report": report, "company_features": features, **demo_bundle(spark, INN)}


def test_validation_passes(bundle):
    checks.validate(bundle)


def broken(tables):
    return {r.rule: r.violations for r in checks.check_results(tables).filter("violations > 0").collect()}


def test_restricted_chunk_must_stay_restricted(bundle):
    chunks = bundle["chunks"]
    assert broken({"chunks": chunks}) == {}
    open_to_all = chunks.withColumn("allowed_roles", F.array(F.lit("analyst")))
    assert broken({"chunks": open_to_all}) == {"restricted_chunk_readers": 1}
    assert broken({"chunks": chunks.filter("external_id <> 'ch_003'")}) == {"restricted_chunk_count": 1}
    assert broken({"chunks": chunks.unionAll(chunks)}) == {"restricted_chunk_count": 1}
    with pytest.raises(checks.DataValidationError, match="restricted_chunk_readers: 1"):
        checks.validate({"chunks": open_to_all})


def test_year_checks(bundle):
    company, report = bundle["company"], bundle["financial_report"]
    both = lambda c, r: broken({"company": c, "financial_report": r})
    assert both(company, report) == {}
    assert both(company, report.filter("year <> 2024")) == {"company_years": 2, "target_year_missing": 1}
    assert both(company, report.withColumn("year", F.col("year") - 1)) == {"target_year_missing": 1}
    assert both(company.limit(0), report) == {"company_rows_missing": 1}
    assert both(company, report.limit(0)) == {"report_rows_missing": 1, "target_year_missing": 1}


def test_graph_checks(bundle):
    nodes, edges = bundle["graph_nodes"], bundle["graph_edges"]
    both = lambda n, e: broken({"graph_nodes": n, "graph_edges": e})
    assert both(nodes, edges) == {}
    assert both(nodes.limit(4), edges)["nodes_missing"] == 1
    assert both(nodes, edges.limit(3)) == {"edges_missing": 1}
    assert both(nodes.filter("node_type <> 'RiskFactor'"), edges)["unknown_edge_ends"] >= 1


def test_export_and_manifest(spark, bundle, tmp_path):
    export_tables(bundle, str(tmp_path))
    rows = []
    for part in glob.glob(f"{tmp_path}/chunks.csv/part-*.csv"):
        with open(part, newline="") as f:
            rows += list(csv.DictReader(f, escapechar="\\"))
    roles = {r["external_id"]: json.loads(r["allowed_roles"]) for r in rows}
    assert roles["ch_003"] == ["risk_manager"] and len(rows) == 3
    assert json.loads(next(r for r in rows if r["external_id"] == "ch_002")["metadata"])["risk_factor"] == "revenue_drop"
    [part] = glob.glob(f"{tmp_path}/manifest.json/part-*.json")
    with open(part) as f:
        assert json.load(f) == {
            "demo_inn": INN, "companies": 2, "reports": 4, "documents": 3, "chunks": 3, "graph_nodes": 9, "graph_edges": 6,
        }
    assert len(glob.glob(f"{tmp_path}/*.csv")) == 7
    assert manifest(bundle).first()["reports"] == 4


def test_a_changed_export_is_noticed(spark, tmp_path):
    rows = spark.range(500).selectExpr("lpad(cast(id * 7 % 500 as string), 5, '0') as inn", "cast(id % 2 as int) + 2023 as year", "if(id % 3 = 0, null, id) as n").repartition(5)
    path = f"{tmp_path}/r.csv"
    write_sorted(rows, path, ["inn", "year"])
    assert order_violations(spark, path, ["inn", "year"]).collect() == []
    back = reread(spark, path).orderBy("file", "place").collect()
    assert [r.inn for r in back] == sorted(r.inn for r in back) and len(back) == 500 and sum(r.n is None for r in back) == 167
    name = sorted(glob.glob(f"{path}/part-*.csv"))[-1]
    with open(name) as f:
        lines = f.read().splitlines()
    crc = os.path.join(path, f".{os.path.basename(name)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with open(name, "w") as f:
        f.write("\n".join([lines[0], lines[2], lines[1], *lines[3:]]) + "\n")
    assert {r.problem for r in order_violations(spark, path, ["inn", "year"]).collect()} == {"order", "contents"}


@pytest.fixture(scope="module")
def store(spark, bundle, tmp_path_factory):
    stored = TableStore(spark, str(tmp_path_factory.mktemp("store")), hash_parts=4)
    load_tables(stored, bundle)
    return stored


def test_loaded_tables(store):
    company = {r.inn: r for r in store.read("company").collect()}
    assert company[INN].company_id == 1 and company[INN].name == "Компания"
    assert str(company[INN].creation_date) == "1999-05-06" and company[INN].dissolution_date is None
    reports = {(r.company_id, r.report_year): r for r in store.read("financial_report").collect()}
    assert len(reports) == 4 and reports[(1, 2024)].profit == -1.0
    assert reports[(1, 2023)].filed is True and reports[(1, 2023)].imputed is False
    assert reports[(1, 2024)].imputed is None and reports[(1, 2024)].outlier is None
    factors = {r.risk_factor_id: r.code for r in store.read("risk_factor").collect()}
    assert sorted(factors) == [1, 2, 3, 4, 5] and set(factors.values()) == {f[0] for f in RISK_FACTORS}
    risks = {(r.company_id, factors[r.risk_factor_id], r.explanation) for r in store.read("company_risk").collect()}
    assert (1, "revenue_drop_gt_30", "Detected from RFSD features: risk_revenue_drop_gt_30") in risks and len(risks) == 3
    assert store.read("financial_fact").count() == 0
    documents = {r.metadata["external_id"]: r.document_id for r in store.read("document").collect()}
    chunks = store.read("chunk").collect()
    assert {(c.metadata["external_id"], c.document_id) for c in chunks} == {
        ("ch_001", documents["law_001"]), ("ch_002", documents["policy_001"]), ("ch_003", documents["risk_001"]),
    }
    assert {c.metadata["linked_inn"] for c in chunks} == {INN}
    chunk_id = {c.metadata["external_id"]: c.chunk_id for c in chunks}
    edges = store.read("graph_edge").collect()
    assert len({e.edge_id for e in edges}) == 6
    by_ends = {(e.source_node_id, e.target_node_id): e for e in edges}
    assert by_ends[("chunk:ch_003", "document:risk_001")].source_chunk_id == chunk_id["ch_003"]
    linked = by_ends[("document:policy_001", "document:law_001")]
    assert linked.source_chunk_id is None and (linked.weight, linked.confidence) == (0.8, 0.9)
    assert store.read("graph_node").count() == 9


def test_embedding_index_is_an_upsert(spark, store):
    settings = RetrievalSettings(embedding_dim=32)
    assert embed_all_chunks(store, settings=settings) == 3
    first = {r.chunk_id: r for r in store.read("chunk_embedding").collect()}
    assert embed_all_chunks(store, settings=settings) == 3
    second = {r.chunk_id: r for r in store.read("chunk_embedding").collect()}
    assert set(first) == set(second) and all(len(r.embedding) == 32 for r in second.values())
    assert all(second[c].updated_at > first[c].updated_at for c in first)
    assert checks.wrong_dimension(store.read("chunk_embedding"), 32).first()["wrong"] == 0


def test_loading_again_without_truncate(spark, store, bundle, tmp_path):
    again = TableStore(spark, str(tmp_path), hash_parts=4)
    load_tables(again, bundle)
    with pytest.raises(ValueError, match="already stored"):
        load_tables(again, bundle, truncate=False)
    other = dict(bundle)
    other["company"] = bundle["company"].filter(f"inn = '{INN}'").withColumn("inn", F.lit("9"))
    other["financial_report"] = bundle["financial_report"].filter(f"inn = '{INN}'").withColumn("inn", F.lit("9"))
    other["company_features"] = bundle["company_features"].filter(f"inn = '{INN}'").withColumn("inn", F.lit("9"))
    load_tables(again, other, truncate=False)
    assert {r.company_id for r in again.read("company").collect()} == {1, 2, 3}
    assert again.read("risk_factor").count() == 5 and again.read("graph_node").count() == 9
    assert again.read("financial_report").count() == 6 and again.read("chunk").agg(F.max("chunk_id")).first()[0] == 6
    load_tables(again, bundle)
    assert again.read("company").count() == 2 and again.read("chunk").count() == 3


def test_missing_keys_are_errors(spark, bundle, tmp_path):
    """A load that fails half-way, after companies were written, leaves every table as it was."""
    store = TableStore(spark, str(tmp_path), hash_parts=4)
    broken = dict(bundle)
    broken["financial_report"] = bundle["financial_report"].withColumn("inn", F.lit("unknown"))
    with pytest.raises(KeyError, match="report inn without a match, for example 'unknown'"):
        load_tables(store, broken)
    with pytest.raises(KeyError, match="chunk document without a match, for example 'lost'"):
        load_tables(store, {**bundle, "chunks": bundle["chunks"].withColumn("document_external_id", F.lit("lost"))})
    assert store.read("company").count() == 0 and store.state()[0] == 0
    load_tables(store, bundle)
    for truncate in (True, False):
        with pytest.raises((KeyError, ValueError)):
            load_tables(store, broken, truncate)
    for reader in (store, TableStore(spark, str(tmp_path))):
        assert reader.state()[0] == 1 and reader.read("company").count() == 2 and reader.read("financial_report").count() == 4
    left = store.vacuum()
    assert {"company", "risk_factor"} <= {f.split("/")[1] for f in left}
    assert store.read("company").count() == 2 and store.vacuum() == []


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


def test_a_change_touches_its_partitions_only(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), ids_per_part=10)
    vectors = lambda ids, model: spark.createDataFrame([(i, [1.0], model, None, None) for i in ids], schemas.STORED_TABLES["chunk_embedding"])
    store.replace("chunk_embedding", vectors(range(50), "a"))
    before, listed = files(tmp_path), store.state()[1]["chunk_embedding"]
    assert sorted(listed) == [0, 1, 2, 3, 4]
    with store.change() as change:
        touched = change.merge("chunk_embedding", vectors([11, 47, 63], "b"), lambda old, new: loading.update_or_insert(old, new, ["chunk_id"], []))
        assert touched == [1, 4, 6]
        # Readers still see the version before, and the files it consists of are not touched.
        assert TableStore(spark, str(tmp_path)).read("chunk_embedding").count() == 50
    after, now = files(tmp_path), store.state()[1]["chunk_embedding"]
    assert {f: t for f, t in after.items() if f in before} == before
    assert sorted(f.split("part_no=")[1].split("/")[0] for f in set(after) - set(before)) == ["1", "4", "6"]
    assert {p for p in now if now[p] == listed.get(p)} == {0, 2, 3}
    models = {r.chunk_id: r.model_name for r in TableStore(spark, str(tmp_path)).read("chunk_embedding").collect()}
    assert models == {**dict.fromkeys(range(50), "a"), 11: "b", 47: "b", 63: "b"}
    with store.change() as change:
        change.append("chunk_embedding", vectors([64], "c"))
    assert len(store.state()[1]["chunk_embedding"][6]) == 2 and store.read("chunk_embedding").count() == 52


def test_sparse_ids_make_few_partitions(spark, tmp_path):
    """Ids far apart do not get a folder each; ranges double as rows join, and merges still replace the right rows."""
    store = TableStore(spark, str(tmp_path), ids_per_part=10)
    vectors = lambda ids, model: spark.createDataFrame([(i, [1.0], model, None, None) for i in ids], schemas.STORED_TABLES["chunk_embedding"])
    update = lambda old, new: loading.update_or_insert(old, new, ["chunk_id"], [])
    first, more = range(-40_000, 60_000, 1000), range(60_000, 600_000, 1000)
    store.replace("chunk_embedding", vectors(first, "a"))
    assert len(store.state()[1]["chunk_embedding"]) == 100 and store.levels["chunk_embedding"] == 0
    with store.change() as change:
        change.append("chunk_embedding", vectors(more, "b"))
    changed = [-40_000, 7000, 59_000, 60_000, 599_000, 5]
    again = TableStore(spark, str(tmp_path), ids_per_part=10)
    with again.change() as change:
        touched = change.merge("chunk_embedding", vectors(changed, "c"), update)
    parts = again.state()[1]["chunk_embedding"]
    assert len(touched) <= 6 and len(parts) <= 256 and again.levels["chunk_embedding"] > 0
    want = {**dict.fromkeys(first, "a"), **dict.fromkeys(more, "b"), **dict.fromkeys(changed, "c")}
    rows = TableStore(spark, str(tmp_path), ids_per_part=10).read("chunk_embedding").collect()
    assert {r.chunk_id: r.model_name for r in rows} == want and len(rows) == len(want)


def test_the_last_of_a_batch_wins(spark, bundle, tmp_path):
    """By file and row, whatever the partitions; without them by content, so that loads agree."""
    def batch(rows, name):
        spark.createDataFrame(rows, "node_id string, node_type string, label string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    batch([("n", "Document", f"l{i}") for i in range(6)] + [("m", "Chunk", "only")], "a")
    batch([("n", "LegalAct", f"k{i}") for i in range(4)], "b")
    arrived = arrivals(spark, f"{tmp_path}/in/*").select("*", *[F.lit(None).cast("string").alias(c) for c in ("ref_table", "ref_id")], F.create_map().cast("map<string,string>").alias("metadata"))
    for shuffled in (arrived.repartition(4), arrived.orderBy(F.desc("_row"))):
        store = TableStore(spark, str(tmp_path / "s"), hash_parts=2)
        load_tables(store, {**bundle, "graph_nodes": shuffled})
        assert {(r.node_id, r.node_type, r.label) for r in store.read("graph_node").collect()} == {("n", "Document", "k3"), ("m", "Chunk", "only")}
    labels = set()
    for parts in (1, 3, 5):
        load_tables(store, {**bundle, "graph_nodes": arrived.drop("_file", "_row").repartition(parts)})
        labels.add(store.read("graph_node").filter("node_id = 'n'").first().label)
    assert len(labels) == 1


def test_reports_keep_their_id(spark):
    kinds = "company_id long, report_year int, report_id long, revenue double"
    old, new = spark.createDataFrame([(1, 2023, 7, 1.0), (1, 2024, 8, 2.0)], kinds), spark.createDataFrame([(1, 2024, 9, None), (2, 2024, 10, 4.0)], kinds)
    merged = loading.update_or_insert(old, new, ["company_id", "report_year"], ["report_id"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 2023, 7, 1.0), (1, 2024, 8, None), (2, 2024, 10, 4.0)]


def test_only_changed_chunks_are_encoded(spark, bundle, tmp_path):
    settings = RetrievalSettings(embedding_dim=2)
    store = TableStore(spark, str(tmp_path), ids_per_part=2, hash_parts=2)
    seen = []

    def encoder(df, text, out):
        seen.append(df.count())
        return df.withColumn(out, F.array(F.length(text).cast("float"), F.lit(float(len(seen)))))

    load_tables(store, bundle)
    assert embed_changed_chunks(store, encoder, settings) == {"inserted": 3, "changed": 0, "removed": 0}
    assert embed_changed_chunks(store, encoder, settings) == {"inserted": 0, "changed": 0, "removed": 0} and seen == [3]
    chunk = store.read("chunk")
    text = F.when(F.col("chunk_id") == 2, "other").otherwise(F.col("chunk_text"))
    more = chunk.filter("chunk_id = 1").withColumn("chunk_id", F.lit(9).cast("long"))
    store.replace("chunk", chunk.filter("chunk_id <> 3").withColumn("chunk_text", text).unionByName(more))
    before = files(tmp_path)
    assert embed_changed_chunks(store, encoder, settings) == {"inserted": 1, "changed": 1, "removed": 1} and seen == [3, 2]
    found = {r.chunk_id: r.embedding[1] for r in store.read("chunk_embedding").collect()}
    assert found == {1: 1.0, 2: 2.0, 9: 2.0}
    assert {f.split("part_no=")[1][0] for f in set(files(tmp_path)) - set(before)} == {"1", "4"}
    # Another model makes every vector old.
    assert embed_changed_chunks(store, encoder, RetrievalSettings(embedding_dim=2, encoder_name="new"))["changed"] == 3


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "first", 1), (2, "last", 2), (3, "first", 1), (3, "last", 2)], "k int, v string, pos int")
    assert {tuple(r) for r in loading.upsert(old, new, ["k"], ["pos"]).collect()} == {(1, "old"), (2, "last"), (3, "last")}
    assert {tuple(r) for r in loading.insert_or_ignore(old, new, ["k"], ["pos"]).collect()} == {(1, "old"), (2, "old"), (3, "first")}


def test_prepare_from_files(spark, tmp_path):
    root = f"{tmp_path}/raw"
    for year, revenue in ((2023, 100.0), (2024, 50.0)):
        spark.range(40).select(
            F.format_string("77%08d", "id").alias("inn"), F.lit("1").alias("ogrn"), F.lit("7700").alias("region_taxcode"),
            F.lit("C").alias("okved_section"), F.when(F.col("id") % 2 == 0, revenue).otherwise(100.0).alias("line_2110"),
            F.lit(5.0).alias("line_2400"), F.lit(1.0).alias("filed"),
        ).write.parquet(f"{root}/reports/year={year}")
    tables = prepare(spark, root, export_to=(f"{tmp_path}/out",))
    checks.validate(tables)
    assert tables["company"].count() == 40 and tables["financial_report"].count() == 80
    assert tables["graph_nodes"].filter("node_id = 'company:7700000000'").count() == 1
    assert len(glob.glob(f"{tmp_path}/out/*.csv")) == 7


def test_settled_scope_cleans_up(spark, tmp_path):
    from credence.session import ensure_checkpoint_dir, settle, settled_scope

    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/settled-*"))
    kept = settle(spark.range(3))
    with settled_scope(spark):
        inside = settle(spark.range(5))
        assert inside.count() == 5
    left = set(glob.glob(f"{root}/settled-*")) - before
    assert len(left) == 1 and kept.count() == 3
