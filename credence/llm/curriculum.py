"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule. Weights share the words of the whole mix; a source that
would have to repeat more than `most` times stops there, and the excess is shared out again by
weight until no source is above. A schedule gives the source's rate over the training, piecewise
linear in the progress from 0 to 1. Its integral, scaled to the source's target, is the source's
cumulative demand of words.

Documents of a source stand in a fixed order drawn from a digest of doc_id, repeated up to `most` times.
The copy that fills the words a to b of its source's demand belongs where that demand reaches
(a + b) / 2: the inverse of the integral there is its position. Copies are dealt by ranges of the
position, and a running total of their words gives each its place in the training order. The copy
at which a source reaches its target is cut, so every source gives its target to the word.

Only doc_id, source, word counts and places are shuffled, never texts. Sizes count the words
`[^\\x20\\x09-\\x0D]+`, null text has none. Null sources are one source, the last. A document without
words is never taken; a source without words has a target of 0. Rows that repeat a doc_id, null
included, are documents of their own; equal rows may swap what is taken of them. Extra columns are
left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.numbering import numbered_within
from credence.llm.running import attached, running_totals
from credence.llm.textkit import word_count
from credence.session import settle

WEIGHTS = (5, 2, 1)
MOST = 3
# (progress, rate) of the schedules that sources take in turn: fading, steady, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
# Sorts behind every source that is not null.
NO_SOURCE = "t"


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source_key, size, draw (place of the document in its source's order) and row (a number of its own)."""
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(NO_SOURCE))
    return settle(docs.select("doc_id", key.alias("source_key"), word_count(F.col("text")).alias("size"), drawn.alias("draw"), F.monotonically_increasing_id().alias("row")))


def in_turn(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """source_key, source_size, weight and schedule of every source: weights and schedules repeat in code point order."""
    totals = settle(sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")).withColumn("all", F.lit(0)))
    numbered = numbered_within(totals, "all", ["source_key"], "number")[0]

    def nodes(schedule):
        return F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(float(rate)).alias("rate")) for at, rate in schedule])

    def turn(values: Sequence[Column]) -> Column:
        return F.element_at(F.array(*values), (F.col("number") % len(values) + 1).cast("int"))

    return numbered.select("source_key", "source_size", turn([F.lit(w) for w in weights]).cast("long").alias("weight"), turn([nodes(s) for s in schedules]).alias("schedule"))


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Sources with `target`: shares of all words by weight, none above `most` times its source.

    The shares of the sources that stay below are a common level times their weight. Each round
    finds who reaches the limit at the present level and raises the level; what travels are three sums.
    """
    sources = settle(sources)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    limit = whole("source_size") * most
    words, shares = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, left, full = words or 0, shares or 1, F.lit(False)
    while True:
        full = limit * F.lit(left).cast("decimal(19,0)") < whole("weight") * F.lit(rest).cast("decimal(19,0)")
        taken, others = sources.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if ((words or 0) - most * taken, others or 1) == (rest, left):
            break
        rest, left = (words or 0) - most * taken, others or 1
    share = (whole("weight") * F.lit(rest).cast("decimal(19,0)")).cast("double") / F.lit(left).cast("double")
    return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(share))


def with_demand(sources: DataFrame) -> DataFrame:
    """Sources with `demand`: the stretches between the schedule's nodes and the integral up to each."""
    node = lambda i: F.element_at("schedule", i)
    stretches = F.transform(
        F.sequence(F.lit(1), F.size("schedule") - 1),
        lambda i: F.struct(
            node(i)["at"].alias("at"), (node(i + 1)["at"] - node(i)["at"]).alias("length"), node(i)["rate"].alias("rate"),
            (node(i + 1)["rate"] - node(i)["rate"]).alias("rise"),
            F.aggregate(
                F.sequence(F.lit(1), i), F.lit(0.0),
                lambda total, j: total + F.when(j < i, (node(j + 1)["at"] - node(j)["at"]) * (node(j + 1)["rate"] + node(j)["rate"]) / 2).otherwise(0.0),
            ).alias("before"),
        ),
    )
    last = F.element_at("demand", -1)
    return sources.withColumn("demand", stretches).withColumn("area", last["before"] + last["length"] * (last["rate"] + last["rate"] + last["rise"]) / 2)


def inverse_demand(share: Column) -> Column:
    """The progress at which a source's demand reaches `share` of its target."""
    reached = share * F.col("area")
    stretch = F.element_at(F.filter("demand", lambda s: s["before"] <= reached), -1)
    ahead = F.greatest(reached - stretch["before"], F.lit(0.0))
    root = F.sqrt(stretch["rate"] * stretch["rate"] + F.lit(2.0) * (stretch["rise"] / stretch["length"]) * ahead)
    step = F.when(ahead > 0, F.lit(2.0) * ahead / (stretch["rate"] + root)).otherwise(0.0)
    return stretch["at"] + F.least(step, stretch["length"])


def planned(sizes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """One row per document with `copies`: number, words taken and position of each time it is used."""
    placed = running_totals(sizes, ["source_key"], ["draw", "doc_id", "size", "row"], {"size": "ahead"})
    known = attached(placed, sources.select("source_key", "source_size", "target", "demand", "area"), "source_key")
    end = F.floor(F.col("target") + 0.5)

    def copy(k: int) -> Column:
        start = F.col("source_size") * k + F.col("ahead")
        words = F.greatest(F.lit(0), F.least(F.col("size"), end - start))
        return F.struct(F.lit(k).alias("copy"), words.alias("words"), ((start + words / 2) / F.greatest(end, F.lit(1))).alias("share"))

    used = F.filter(F.array(*[copy(k) for k in range(most)]), lambda c: c["words"] > 0)
    return known.withColumn("copies", F.transform(used, lambda c: F.struct(c["copy"].alias("copy"), c["words"].alias("words"), inverse_demand(c["share"]).alias("position"))))


def training_order(plan: DataFrame) -> DataFrame:
    """Every copy that is used, with `first_word`: the words of the mix before it in order of position."""
    fields = [F.col("c")[f].alias(f) for f in ("copy", "words", "position")]
    copies = plan.select("doc_id", "source_key", "draw", "row", F.explode("copies").alias("c")).select("doc_id", "source_key", "draw", "row", *fields)
    return running_totals(copies, [], ["position", "draw", "doc_id", "copy", "row"], {"words": "first_word"}).drop("_part")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The plan, one row per document, and the training order, one row per copy used."""
    if any(len(s) < 2 or s[0][0] != 0 or s[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(s, s[1:])) or min(r for _, r in s) < 0 or not any(r for _, r in s) for s in schedules):
        raise ValueError("a schedule goes from progress 0 to 1 in rising steps, with rates of 0 or more, not all 0")
    sizes = document_sizes(docs)
    plan = settle(planned(sizes, with_demand(with_targets(in_turn(sizes, weights, schedules), most)), most))
    return plan, training_order(plan)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, words taken, copies, and where the first copy begins in the training order."""
    plan, ordered = mix(docs, weights, schedules, most)
    # Every row number occurs at most `most` times.
    used = ordered.groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("copies"), F.min("first_word").alias("first_word"))
    counted = plan.drop("copies").join(used, "row", "left")
    return counted.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"), "first_word")


def training_texts(docs: DataFrame, ordered: DataFrame) -> DataFrame:
    """The mix itself: first_word, doc_id, copy and text, in order; a copy that is cut keeps its first words.

    Texts are joined by doc_id, so each must be one document's. Ranges of the order are sorted, not
    the whole in one task.
    """
    word = r"[^\x20\x09-\x0D]+"
    texts = docs.select("doc_id", F.col("text").alias("whole"), word_count(F.col("text")).alias("size")).filter("doc_id is not null")
    joined = ordered.filter("doc_id is not null").join(texts, "doc_id")
    cut = F.array_join(F.slice(F.regexp_extract_all("whole", F.lit(word), F.lit(0)), 1, F.greatest(F.col("words"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("whole"))
    return joined.select("first_word", "doc_id", "copy", "words", text.alias("text")).repartitionByRange("first_word").sortWithinPartitions("first_word")


MIX_SQL = r"""
with sizes as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                      cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as draw from documents),
per_source as (select source, cast(sum(size) as bigint) as source_size from sizes group by source),
numbered as (select *, row_number() over (order by source nulls last) - 1 as number from per_source),
weighted as (select *, ([5, 2, 1])[1 + number % 3] as weight, ([1.5, 1.0, 0.5])[1 + number % 3]::double as rate,
                    ([-1.0, 0.0, 1.0])[1 + number % 3]::double as rise, sum(source_size) over () as words from numbered),
by_limit as (
    select *, coalesce(sum(3 * source_size) over (order by source_size / weight, number rows between unbounded preceding and 1 preceding), 0) as full_before,
           sum(weight) over (order by source_size / weight, number rows between current row and unbounded following) as weights_left
    from weighted
),
level as (
    select words - full_before as rest, weights_left from by_limit
    where 3 * source_size * weights_left >= weight * (words - full_before) order by source_size / weight, number limit 1
),
targets as (
    select w.*, case when 3 * source_size * weights_left < weight * rest then cast(3 * source_size as double)
                     else cast(weight * rest as double) / cast(weights_left as double) end as target
    from weighted w, level
),
placed as (
    select s.*, t.source_size, t.target, t.rate, t.rise, cast(floor(t.target + 0.5) as bigint) as stop,
           coalesce(sum(s.size) over (partition by s.source order by s.draw, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as ahead
    from sizes s join targets t on s.source is not distinct from t.source
),
copies as (
    select *, copy * source_size + ahead as start, greatest(0, least(size, stop - (copy * source_size + ahead))) as words
    from placed, (select unnest([0, 1, 2]) as copy)
),
shares as (select *, (cast(start as double) + cast(words as double) / 2) / cast(stop as double) as share from copies where words > 0),
positions as (select *, least(2.0 * share / (rate + sqrt(rate * rate + 2.0 * (rise / 1.0) * share)), 1.0) as position from shares),
ordered as (
    select doc_id, words, coalesce(sum(words) over (order by position, draw, doc_id, copy rows between unbounded preceding and 1 preceding), 0) as first_word
    from positions
),
used as (select doc_id, sum(words) as taken, count(*) as copies, min(first_word) as first_word from ordered group by doc_id)
select p.doc_id, p.size, cast(p.source_size as bigint) as source_size, p.target, cast(coalesce(u.taken, 0) as bigint) as taken,
       cast(coalesce(u.copies, 0) as bigint) as copies, cast(u.first_word as bigint) as first_word
from placed p left join used u using (doc_id)
"""
