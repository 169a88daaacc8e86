"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is the hash of the words a fixed mask shows (1) of successive words, so words it ignores
(0) may differ. The masks are lossless: in any 13 aligned words of which at most two differ, one
of them finds a place where it shows equal words only. Training seeds are joined with
the benchmark's; around each hit document and item are laid side by side at the hit's offset, and
the pair counts if some 13 successive places agree in at least 11 words.

Words are runs of letters and digits of the lower-cased text. Items of fewer than 13 words are too
short to tell a leak from chance and match nothing, nor do null or empty texts. A pair is
reported once, however many rows or offsets show it. Extra columns are left out. Empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ("11101011", "110100111")
WINDOW, DIFFERENCES = 13, 2
# Seeds of the benchmark that may travel to every task, at about 50 bytes each; more of them are dealt by seed.
BROADCAST_SEEDS = 400_000


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: str, number: int, mask: str) -> Column:
    """The seed of every place of a word list where the whole mask fits."""
    shown = [k for k, sign in enumerate(mask) if sign == "1"]
    last = F.size(words) - F.lit(len(mask))

    def seed(at: Column) -> Column:
        return F.xxhash64(F.lit(number), *[F.get(F.col(words), at + F.lit(k)) for k in shown])

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seed)).otherwise(F.array().cast("array<bigint>"))


def _placed_seeds(table: DataFrame, words: str, kept: list[str], masks=MASKS) -> DataFrame:
    """One row per seed and place: the kept columns, place and seed."""
    lists = table.withColumn("_seeds", F.array(*[_seeds(words, k, m) for k, m in enumerate(masks)]))
    # All masks' seeds lie in one list; a place follows from the length of the lists before.
    flat = lists.select(*kept, F.flatten("_seeds").alias("_all"), F.transform("_seeds", F.size).alias("_sizes"))
    # The outer form: Spark would else test the lists for emptiness first, splitting each text once per use.
    placed = flat.select(*kept, "_sizes", F.posexplode_outer("_all").alias("_at", "seed"))
    before, found = F.lit(0), F.lit(0)
    for k in range(len(masks)):
        found = F.when(F.col("_at") >= before, F.col("_at") - before).otherwise(found)
        before = before + F.get("_sizes", F.lit(k))
    return placed.select(*kept, found.alias("place"), "seed")


def _agreement(equal: str, window: int) -> Column:
    """The most equal words in any window of a list of booleans."""
    starts = F.sequence(F.lit(1), F.size(equal) - F.lit(window - 1))
    return F.array_max(F.transform(starts, lambda s: F.size(F.filter(F.slice(equal, s, window), lambda same: same))))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    window: int = WINDOW,
    differences: int = DIFFERENCES,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """doc_id, item_id, best (most equal words in a window) and equal_words (at the best offset) of every leak."""
    texts = docs.select("doc_id", words_of("text").alias("words"))
    items = benchmark.select("item_id", words_of("text").alias("item_words")).distinct().filter(F.size("item_words") >= window)
    seeds = _placed_seeds(items.withColumn("length", F.size("item_words")), "item_words", ["item_id", "length"], masks).withColumnRenamed("place", "item_place")
    few = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    if few:
        seeds, items = F.broadcast(seeds), F.broadcast(items)
    offset = (F.col("place") - F.col("item_place")).alias("offset")
    met = _placed_seeds(texts, "words", ["doc_id"], masks).join(seeds, "seed").select("doc_id", "item_id", "length", offset).distinct()
    # A document's list is bounded by its words and the items that share seeds with it.
    sides = met.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "length", "offset")).alias("sides"))
    beside = F.transform(
        "sides",
        lambda s: F.struct(
            s["item_id"].alias("item_id"),
            F.transform(F.sequence(F.lit(0), s["length"] - 1), lambda k: F.get("words", s["offset"] + k)).alias("beside"),
        ),
    )
    laid = docs.select("doc_id", "text").join(sides, "doc_id").select("doc_id", words_of("text").alias("words"), "sides")
    pairs = laid.select("doc_id", F.explode_outer(beside).alias("pair")).select("doc_id", "pair.item_id", "pair.beside").join(items, "item_id")
    equal = F.zip_with("beside", "item_words", lambda x, y: F.coalesce(x == y, F.lit(False)))
    aligned = pairs.filter(F.size("beside") == F.size("item_words")).select("doc_id", "item_id", equal.alias("equal"))
    best, total = _agreement("equal", window), F.size(F.filter("equal", lambda same: same))
    judged = aligned.select("doc_id", "item_id", best.alias("best"), total.alias("equal_words"))
    found = judged.filter(F.col("best") >= F.lit(window - differences))
    return found.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"), F.max("equal_words").alias("equal_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that leak no item, as they are."""
    return docs.join(leaks(docs, benchmark, **how).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


LEAKS_SQL = """
with doc_words as (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place
    from (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents)
),
item_lists as (
    select item_id, w from (
        select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark
    ) where len(w) >= 13
),
item_words as (select item_id, unnest(w) as word, generate_subscripts(w, 1) as place from item_lists),
windows as (select item_id, unnest(range(1, len(w) - 11)) as first from item_lists),
equal as (
    select d.doc_id, i.item_id, d.place - i.place as distance, i.place
    from doc_words d join item_words i using (word)
),
likely as (
    select doc_id, item_id, distance, count(*) as equal_words
    from equal group by all having count(*) >= 11
),
judged as (
    select e.doc_id, e.item_id, e.distance, l.equal_words, s.first, count(*) as best
    from equal e
    join likely l using (doc_id, item_id, distance)
    join windows s on s.item_id = e.item_id and e.place between s.first and s.first + 12
    group by all having count(*) >= 11
)
select doc_id, item_id, cast(max(best) as integer) as best, cast(max(equal_words) as integer) as equal_words
from judged group by doc_id, item_id
"""
