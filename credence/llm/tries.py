"""The trie of all prefixes of conversations, by ROLLUP over columns of turn ids.

A turn's id is 128 bits of the SHA-256 of its role and text. A conversation is cut into blocks of
`block` turns, and a block is a row with one column per position. One `GROUP BY node, ROLLUP(turn
columns)` over all blocks aggregates every prefix at once; `grouping_id` tells how long it is, and
`node` is the node at which the block before ended, so long conversations go on in further rows.
A node's key is its depth and four running sums of 32 bits each, taken from the SHA-256 of (place,
turn id) along the prefix: it needs no pass over the blocks one by one.

Sums over subtrees are a second ROLLUP, now over the nodes. What lies below the last column of a block
is added to the node there; for that the block roots pass their sums to ancestors at distances
1, 2, 4, …, so rounds grow with the logarithm of the longest conversation.

Prefixes are aggregated before they are shuffled, so a first turn that all share costs a row per
task. No conversation is gathered: turns are numbered by ranges, blocks are grouped by (conversation,
block). The ids of a node's ending conversations are joined into pieces of bounded length in order,
and one task per node feeds the pieces to SHA-256, which has to read them one after the other.

Rows without a conv_id are left out. Null roles and texts are empty. Turns come by number, null
first, turns of equal number by turn id; equal rows are turns of their own. Extra columns are left
out. An empty table has no members, hence no root, and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.running import attached, running_totals
from credence.llm.textkit import lists, text_crc, word_count
from credence.operators.grouping import spread_join
from credence.session import settle

BLOCK = 8
# Ids joined into one piece of text on the way to a node's digest.
IDS_PER_PIECE = 4096
LIMBS = 4
ROOT = ":".join(["0"] * (LIMBS + 1))


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 as hex; the role's length keeps it apart from the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_id, words and place (from 0) of every turn."""
    turns = conversations.filter("conv_id is not null").select(
        "conv_id", "turn", turn_id(F.col("role"), F.col("text")).alias("turn_id"), word_count(F.col("text")).alias("words"), F.lit(1).alias("one")
    )
    return settle(running_totals(settle(turns), ["conv_id"], ["turn", "turn_id"], {"one": "place"}).drop("turn", "one"))


def grafted(turns: DataFrame, donor: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first `head` turns are those of conversation `donor`.

    `turns` comes from `numbered_turns`; `donor` and `head` are expressions of conv_id, and no head is over
    `most`. Gives conversations (conv_id, length) and their turns (conv_id, place, turn_id, words, length).
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({"donor": donor, "head": head})
    begin = F.array_sort(F.collect_list(F.struct("place", "turn_id", "words")))
    begins = turns.filter(F.col("place") < most).groupBy(F.col("conv_id").alias("donor")).agg(begin.alias("begin"))  # at most `most` turns each
    given = F.when(F.col("head") > 0, F.slice(F.coalesce("begin", F.array().cast("array<struct<place:bigint,turn_id:string,words:bigint>>")), 1, F.greatest("head", F.lit(1)).cast("int")))
    given = F.coalesce(given, F.array().cast("array<struct<place:bigint,turn_id:string,words:bigint>>"))
    facts = own.join(begins, "donor", "left").withColumn("given", given).withColumn("kept", F.greatest(F.col("own") - F.col("head"), F.lit(0)))
    facts = settle(facts.select("conv_id", "head", "given", F.size("given").alias("shift"), (F.size("given") + F.col("kept")).alias("length")))
    first = facts.select("conv_id", "length", F.explode("given").alias("g")).select("conv_id", F.col("g.place").alias("place"), "g.turn_id", "g.words", "length")
    # Copies of a turn that every conversation lacks would be the only rows; the join is by (conversation, partition).
    rest = attached(turns, facts.select("conv_id", "head", "shift", "length"), "conv_id").filter(F.col("place") >= F.col("head"))
    moved = rest.select("conv_id", (F.col("place") - F.col("head") + F.col("shift")).alias("place"), "turn_id", "words", "length")
    return facts.select("conv_id", "length"), first.unionByName(moved)


def _limbs(place: Column, own_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(place.cast("string"), F.lit(":"), own_id).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LIMBS)]


def _key(depth: Column, limbs: list[Column]) -> Column:
    return F.concat_ws(":", depth.cast("string"), *[x.cast("string") for x in limbs])


def blocks_of(members: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per conversation and block: node before it, end node in its last block, turn ids t0, t1, … and words w0, w1, …"""
    limbs = [f"l{i}" for i in range(LIMBS)]
    slot = F.col("place") % block
    summed = turns.withColumns(dict(zip(limbs, _limbs(F.col("place"), F.col("turn_id")))))
    rows = summed.groupBy("conv_id", F.floor(F.col("place") / block).alias("block")).agg(
        F.max("length").alias("length"),
        *[F.max(F.when(slot == i, F.col("turn_id"))).alias(f"t{i}") for i in range(block)],
        *[F.max(F.when(slot == i, F.col("words"))).alias(f"w{i}") for i in range(block)],
        *[F.sum(x).alias(x) for x in limbs],
    )
    empty = members.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), "length", *[F.lit(0).cast("long").alias(x) for x in limbs])
    every = settle(rows.unionByName(empty, allowMissingColumns=True))
    before = running_totals(every, ["conv_id"], ["block"], {x: f"before_{x}" for x in limbs})
    prior = [F.col(f"before_{x}") for x in limbs]
    is_last = (F.col("block") + 1) * block >= F.col("length")
    end = F.when(is_last, _key(F.col("length"), [p + F.col(x) for p, x in zip(prior, limbs)]))
    return settle(
        before.select(
            "conv_id", "block", "length", *[f"{c}{i}" for c in "tw" for i in range(block)],
            _key(F.col("block") * block, prior).alias("node"), F.array(*prior).alias("limbs"), end.alias("end_key"),
        )
    )


def _level(block: int) -> str:
    return f"{block} - bit_count(grouping_id())"


def prefix_nodes(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every prefix once: key, parent_key, depth, turn ids within its block, smallest member, members, last turn's words."""
    turn_columns = ", ".join(f"t{i}" for i in range(block))
    rolled = blocks.sparkSession.sql(
        f"""select block, node, {turn_columns}, cast({_level(block)} as int) as level, count(*) as n_convs, min(conv_id) as conv_id,
                   max(length) as longest, any_value(limbs) as limbs, {', '.join(f'max(w{i}) as w{i}' for i in range(block))}
            from {{blocks}} group by block, node, rollup({turn_columns})""",
        blocks=blocks,
    )
    at = F.col("level")
    ids, words = F.array(*[f"t{i}" for i in range(block)]), F.array(*[f"w{i}" for i in range(block)])
    depth = F.col("block") * block + at
    # Shorter conversations have no turn at this level; a block's own root is a node of the block before.
    real = F.when(at == 0, F.col("block") == 0).otherwise(F.get(ids, at - 1).isNotNull())
    own = F.transform(F.slice(ids, 1, at), lambda t, i: F.array(*_limbs(F.col("block") * block + i, t)))
    found = rolled.filter(real).withColumns({"depth": depth, "own": own})

    def up_to(j: int) -> Column:
        return F.col("limbs")[j] + F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x[j])

    last = F.element_at("own", -1)
    found = found.withColumns({f"sum{j}": up_to(j) for j in range(LIMBS)})
    parent = F.when(at > 0, _key(F.col("depth") - 1, [F.col(f"sum{j}") - last[j] for j in range(LIMBS)]))
    return settle(
        found.select(
            "block", "node", *[f"t{i}" for i in range(block)], "level", "depth", "n_convs", "conv_id",
            F.coalesce(F.get(words, at - 1), F.lit(0)).alias("words"), (F.col("longest") == F.col("depth")).alias("is_leaf"),
            _key(F.col("depth"), [F.col(f"sum{j}") for j in range(LIMBS)]).alias("key"), parent.alias("parent_key"),
        )
    )


def _below_blocks(nodes: DataFrame) -> DataFrame:
    """For every node that later blocks start from: children, and leaves and saved words below it at any depth."""
    inner = nodes.filter("block > 0").groupBy(F.col("node").alias("key")).agg(
        F.count_if(F.col("level") == 1).alias("children"), F.count_if("is_leaf").alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    # The root of a block ends the block before, whose own root is the next one up; the trie's root needs no sums.
    up = nodes.join(inner.select("key"), "key", "left_semi").select("key", F.when(F.col("block") > 0, F.col("node")).alias("up"))
    state = settle(inner.join(up, "key"))
    while not state.filter("up is not null").isEmpty():
        passed = state.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = state.filter("up is not null").select(F.col("key").alias("up"), F.col("up").alias("next"))
        jumped = spread_join(state, further, "up", ["key"], "left").drop("up").withColumnRenamed("next", "up")
        state = settle(
            jumped.join(passed, "key", "left").select(
                "key", "children", "up", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
            )
        )
    return state.select("key", "children", "leaves", "saved")


def subtree_sums(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes with n_children, n_leaves and saved_tokens."""
    turn_columns = [f"t{i}" for i in range(block)]
    place = ["block", "node", *turn_columns]
    own = nodes.select(
        *place, "level", "depth", "key", "parent_key", "conv_id", "n_convs", F.col("is_leaf").cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    later = nodes.select(*place, "key").join(_below_blocks(nodes), "key").drop("key")
    rows = own.unionByName(later, allowMissingColumns=True)
    listed = ", ".join(turn_columns)
    rolled = nodes.sparkSession.sql(
        f"""select block, {listed}, cast({_level(block)} as int) as at, min(depth) as depth, min_by(key, depth) as key, min_by(parent_key, depth) as parent_key,
                   min(conv_id) as conv_id, max(n_convs) as n_convs, sum(leaves) as n_leaves, sum(saved) as saved_tokens, sum(children) as later_children,
                   {', '.join(f'count_if(level = {i}) as c{i}' for i in range(1, block + 1))}
            from {{rows}} group by block, node, rollup({listed})""",
        rows=rows,
    )
    at = F.col("at")
    real = F.when(at == 0, F.col("block") == 0).otherwise(F.get(F.array(*turn_columns), at - 1).isNotNull())
    children = F.when(at < block, F.get(F.array(*[f"c{i}" for i in range(1, block + 1)]), at)).otherwise(F.coalesce("later_children", F.lit(0)))
    return rolled.filter(real).select("key", "parent_key", "depth", "conv_id", "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens")


def end_digests(ends: DataFrame, per_piece: int = IDS_PER_PIECE) -> DataFrame:
    """SHA-256 of the ids per key in rising order, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode().indices.to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(heads, keys.size))
            cuts = np.concatenate([np.arange(a, a + n, per_piece) for a, n in zip(heads.tolist(), sizes.tolist(), strict=True)])
            joined = pc.binary_join(lists(batch.column(1).cast(pa.string()), np.diff(np.append(cuts, keys.size)), pa.string()), ",")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts)), batch.column(1).take(pa.array(cuts)), joined], names=["key", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for own, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if own != key:
                    if running is not None:
                        done[0].append(key)
                        done[1].append(running.hexdigest())
                    key, running = own, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(piece.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], names=["key", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    ordered = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = ordered.mapInArrow(pieces, "key string, first long, piece string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key string, ends_sha256 string")


def prefix_trie(members: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all prefixes. `members` has conv_id and length, `turns` conv_id, place from 0 on, turn_id, words, length."""
    blocks = blocks_of(members, turns, block)
    nodes = prefix_nodes(blocks, block)
    summed = settle(subtree_sums(nodes, block))
    ends = blocks.filter("end_key is not null").select(F.col("end_key").alias("key"), "conv_id")
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    linked = spread_join(summed, parents, "parent_key", ["key"], "left").join(end_digests(ends), "key", "left")
    return linked.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "key", "parent_key",
    )


def rebuilt_trie(conversations: DataFrame, every: int = 20, heads: int = 4, block: int = BLOCK) -> DataFrame:
    """The trie of conversations that begin like the one whose id is the next lower multiple of `every`."""
    head = text_crc("conv_id") % heads
    return prefix_trie(*grafted(numbered_turns(conversations), F.col("conv_id") - F.col("conv_id") % every, head, heads - 1), block)


TRIE_SQL = r"""
with turns as (
    select conv_id, list([coalesce(role, ''), coalesce(text, '')] order by turn nulls first) as own from conversations where conv_id is not null group by conv_id
),
crcs as (
    select conv_id, own, xor(list_reduce(
        list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ord(s) as bigint))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), cast([0, 0, 0, 0, 0, 0, 0, 0] as bigint[])), lambda x, i: xor(x >> 1, cast(3988292384 as bigint) * (x & 1)))
    ), cast(4294967295 as bigint)) % 4 as h
    from turns
),
rebuilt as (
    select c.conv_id, list_concat(coalesce(d.own, [])[1:c.h], c.own[c.h + 1:]) as seq
    from crcs c left join turns d on d.conv_id = c.conv_id - c.conv_id % 20
),
prefixes as (
    select conv_id, len(seq) as length, unnest(range(0, len(seq) + 1)) as depth, seq from rebuilt
),
members as (select conv_id, length, depth, seq[1:depth] as prefix from prefixes),
nodes as (
    select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, max(length) = depth as leaf,
           coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (length = depth), '') as ends,
           (count(*) - 1) * case when depth = 0 then 0 else len(regexp_extract_all(coalesce(prefix[depth][2], ''), '[^\x20\x09-\x0D]+')) end as saved
    from members group by prefix, depth
),
above as (select prefix, leaf, saved, unnest(range(0, depth + 1)) as up from nodes),
sums as (select prefix[1:up] as prefix, sum(cast(leaf as bigint)) as n_leaves, sum(saved) as saved_tokens from above group by prefix[1:up]),
children as (select prefix[1:depth - 1] as prefix, count(*) as n_children from nodes where depth > 0 group by prefix[1:depth - 1])
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children,
       cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join sums s on s.prefix = n.prefix left join children c on c.prefix = n.prefix
     left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]
"""
