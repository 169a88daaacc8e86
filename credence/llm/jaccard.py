"""Exact Jaccard join of word-shingle sets by signature trees.

Equal sets shrink to one member first, those of a task and then those of all tasks. Every set lists its prefix: the first
n - ceil(t n) + l(n) shingles in one order over all shingles, l(n) = 1 + n // 20. Two sets with
similarity t or more share at least as many prefix shingles as the smaller l of the two, so a set
that shares fewer with all others together is linked with nothing. Shingles that are frequent, by
a histogram over all sets, come last in the order. The sets that share a prefix shingle make a
group (one of those with the very same sets is enough), and a group a signature tree: each node
holds the OR of its members' token bitmaps, the range of their sizes, and the most tokens any
member has beyond its bits. Two nodes are traversed together, and a pair is pruned

* if its size ranges exclude the similarity,
* if the maximum possible overlap (surplus tokens plus common bits) is too small,
* or if all their members are in one component already.

What survives at the leaves joins sets into candidate blocks. Each block's texts meet once, in a
second signature tree whose leaf pairs are compared exactly. Groups and blocks beyond a fixed
size are cut into parts by a hash, and all pairs of parts are tasks of their own, so nothing
is left out and no task holds more than two parts.

Texts are lower-cased in A-Z. Null texts and texts without words have empty sets, are linked with
nothing and are their own component. Rows without a doc_id are left out. Repeated rows are equal sets. Rows that repeat a doc_id with
another text count as one node, linked with whatever any of its texts is. Columns beyond doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from credence.llm.components import Forest, components
from credence.llm.repeats import repeated_rows, short_keys
from credence.llm.textkit import PLACE, U64, lists, mix, shingle_hashes, slices_by_bytes, text_bytes, words_and_hashes
from credence.session import settle

WORDS, NUM, DEN = 5, 80, 100
HISTOGRAM_BITS = 16
GROUP_ROWS, BLOCK_SHINGLES = 4096, 2_000_000
LEAF = 32
SHARED = 20
BUFFER_ROWS, TEXT_BYTES = 60_000, 8 << 20


# Sets of shingles -------------------------------------------------------------------------------


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; fewer words make one shingle, none an empty set."""
    _, _, _, _, firsts, hashes = words_and_hashes(column, lower=True)
    shingles = shingle_hashes(hashes, words)
    found = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        count = b - a
        if count >= words:
            found.append(np.unique(shingles[a : b - words + 1]))
        elif count:
            found.append(mix((hashes[a:b] * PLACE[:count]).sum(dtype=U64, keepdims=True) + PLACE[32 + count : 33 + count]))
        else:
            found.append(np.zeros(0, U64))
    return found


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of the tokens, a power of two of at least one bit per token wide, in 64-bit words."""
    words = 1
    while words * 64 < tokens.size:
        words *= 2
    bits = (mix(tokens + PLACE[60]) & U64(words * 64 - 1)).astype(np.int64)
    out = np.zeros(words * 64, np.uint8)
    out[bits] = 1
    return np.packbits(out).view(U64)


def shingle_histogram(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sets having a shingle, by a slot of its hash, over all documents; of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << HISTOGRAM_BITS, np.int64)
        for batch in slices_by_bytes(batches, "text"):
            tokens = np.concatenate(shingle_sets(batch.column(0), words))
            totals += np.bincount((tokens >> U64(64 - HISTOGRAM_BITS)).astype(np.int64), minlength=totals.size)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], names=["slot", "rows"])

    counted = docs.select("text").mapInArrow(count, "slot int, rows long").groupBy("slot").agg(F.sum("rows").alias("rows"))
    histogram = np.zeros(1 << HISTOGRAM_BITS, np.int64)
    for row in counted.toLocalIterator():
        histogram[row["slot"]] = row["rows"]
    return histogram


def frequency_levels(histogram: np.ndarray) -> np.ndarray:
    """0 for slots up to half above the mean, then one more for each doubling."""
    mean = max(1.0, float(histogram.mean()))
    return np.maximum(0, np.ceil(np.log2(np.maximum(histogram, 1) / (1.5 * mean)))).astype(U64)


def described_sets(docs: DataFrame, levels: np.ndarray, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, task, n, identity of the set (low, high), prefix and bitmap of every document.

    Of equal sets within a task, only those of a smaller doc_id than any before have the last two.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int, int], int] = {}
        task = TaskContext.get().partitionId()
        for batch in slices_by_bytes(batches, "text"):
            sets = shingle_sets(batch.column(1), words)
            sizes = np.array([s.size for s in sets], np.int64)
            flat = np.concatenate(sets)
            ends = np.cumsum(sizes)
            low, high = (np.concatenate([[U64(0)], np.cumsum(mix(flat + PLACE[k]), dtype=U64)]) for k in (61, 62))
            low, high = (x[ends] - x[ends - sizes] for x in (low, high))
            order = (levels[(flat >> U64(64 - HISTOGRAM_BITS)).astype(np.int64)] << U64(58)) | (flat >> U64(6))
            prefixes, maps = [], []
            identities = zip(sizes.tolist(), low.tolist(), high.tolist(), strict=True)
            for tokens, end, doc_id, identity in zip(sets, ends.tolist(), batch.column(0).to_pylist(), identities, strict=True):
                size = tokens.size
                if not size or least.get(identity, doc_id + 1) <= doc_id:
                    prefixes.append(tokens[:0])
                    maps.append(None)
                    continue
                least[identity] = doc_id
                take = size - (num * size + den - 1) // den + 1 + size // SHARED
                own = order[end - size : end]
                prefixes.append(tokens[np.argpartition(own, take - 1)[:take]] if 0 < take < size else tokens[:take])
                maps.append(bitmap(tokens).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, task, np.int32)),
                    pa.array(sizes),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                    lists(short_keys(np.concatenate(prefixes)), [p.size for p in prefixes], pa.int64()),
                    pa.array(maps, pa.binary()),
                ],
                names=["doc_id", "task", "n", "low", "high", "prefix", "bitmap"],
            )

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, task int, n long, low long, high long, prefix array<long>, bitmap binary")


# Signature trees --------------------------------------------------------------------------------


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one per row) ORed down to fewer words. A token's bit is its hash modulo the width, so folding keeps it."""
    if maps.shape[1] == words:
        return maps
    return np.bitwise_or.reduce(maps.reshape(maps.shape[0], -1, words), axis=1)


def _bits(maps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps).sum(axis=-1, dtype=np.int64)


class Members:
    """Sizes and bitmaps of sets, bitmaps of one width together."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes]):
        self.sizes = sizes
        self.widths = np.array([len(m) // 8 for m in maps], np.int64)
        self.place = np.zeros(sizes.size, np.int64)
        self.by_width: dict[int, np.ndarray] = {}
        for width in np.unique(self.widths).tolist():
            own = np.flatnonzero(self.widths == width)
            self.place[own] = np.arange(own.size)
            self.by_width[width] = np.frombuffer(b"".join(maps[i] for i in own), U64).reshape(own.size, width)

    def maps(self, rows: np.ndarray, words: int) -> np.ndarray:
        """Bitmaps of the rows, each at least `words` wide, folded to that width."""
        out = np.empty((rows.size, words), U64)
        for width in np.unique(self.widths[rows]).tolist():
            own = np.flatnonzero(self.widths[rows] == width)
            out[own] = folded(self.by_width[width][self.place[rows[own]]], words)
        return out

    def possible(self, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which pairs of rows may reach the similarity."""
        a, b = self.sizes[left], self.sizes[right]
        fits = np.flatnonzero((den * np.minimum(a, b) >= num * np.maximum(a, b)) & (a > 0))
        result = np.zeros(left.size, bool)
        narrow = np.minimum(self.widths[left], self.widths[right])
        for words in np.unique(narrow[fits]).tolist():
            own = fits[narrow[fits] == words]
            for at in range(0, own.size, max(1, (1 << 21) // words)):
                some = own[at : at + max(1, (1 << 21) // words)]
                one, two = self.maps(left[some], words), self.maps(right[some], words)
                surplus = np.minimum(a[some] - _bits(one), b[some] - _bits(two))
                most = surplus + _bits(one & two)
                result[some] = (num + den) * most >= num * (a[some] + b[some])
        return result


class Node:
    """rows lo … hi of the tree's order, the OR of their bitmaps, size range, and greatest surplus."""

    __slots__ = ("children", "high", "low", "map", "rows", "surplus")

    def __init__(self, rows, low, high, bits, surplus, children=()):
        self.rows, self.low, self.high, self.map, self.surplus, self.children = rows, low, high, bits, surplus, children


def build_tree(members: Members, rows: np.ndarray) -> Node | None:
    """A binary tree over rows with tokens, in order of size and then of their bitmaps' first word."""
    rows = rows[members.sizes[rows] > 0]
    if not rows.size:
        return None
    rows = rows[np.lexsort((rows, members.sizes[rows]))]
    level = []
    for at in range(0, rows.size, LEAF):
        own = rows[at : at + LEAF]
        words = int(members.widths[own].min())
        maps = members.maps(own, words)
        sizes = members.sizes[own]
        level.append(Node(own, int(sizes[0]), int(sizes[-1]), np.bitwise_or.reduce(maps, axis=0), int((sizes - _bits(maps)).max())))
    while len(level) > 1:
        above = []
        for at in range(0, len(level) - 1, 2):
            a, b = level[at], level[at + 1]
            words = min(a.map.size, b.map.size)
            bits = folded(a.map[None], words)[0] | folded(b.map[None], words)[0]
            # Folding by a factor can only merge bits, which adds to the surplus at most what bits are lost.
            surplus = max(_folded_surplus(members, a, words), _folded_surplus(members, b, words))
            above.append(Node(np.concatenate([a.rows, b.rows]), min(a.low, b.low), max(a.high, b.high), bits, surplus, (a, b)))
        level = above + level[len(level) // 2 * 2 :]
    return level[0]


def _folded_surplus(members: Members, node: Node, words: int) -> int:
    if node.map.size == words:
        return node.surplus
    return int((members.sizes[node.rows] - _bits(members.maps(node.rows, words))).max())


def traverse(members: Members, tree: Node, forest: Forest, matches, num: int = NUM, den: int = DEN) -> None:
    """Unites in the forest what `matches` finds among the pairs of rows the tree cannot rule out."""

    def united(node: Node) -> int:
        first = forest.root(int(node.rows[0]))
        roots = forest.parent[node.rows]
        if (roots == first).all():
            return first
        return first if all(forest.root(int(r)) == first for r in node.rows[roots != first]) else -1

    stack = [(tree, tree)]
    while stack:
        one, two = stack.pop()
        if one is two:
            if one.children:
                left, right = one.children
                stack += [(left, right), (right, right), (left, left)]
                continue
        else:
            if den * one.high < num * two.low or den * two.high < num * one.low:
                continue
            words = min(one.map.size, two.map.size)
            common = int(_bits(folded(one.map[None], words)[0] & folded(two.map[None], words)[0]))
            most = common + min(_folded_surplus(members, one, words), _folded_surplus(members, two, words))
            if (num + den) * most < num * (one.low + two.low):
                continue
            root = united(one)
            if root >= 0 and root == united(two):
                continue
            if one.children or two.children:
                if two.children and (not one.children or two.rows.size >= one.rows.size):
                    stack += [(one, child) for child in two.children]
                else:
                    stack += [(child, two) for child in one.children]
                continue
        left, right = np.repeat(one.rows, two.rows.size), np.tile(two.rows, one.rows.size)
        apart = left < right if one is two else np.ones(left.size, bool)
        left, right = left[apart], right[apart]
        likely = members.possible(left, right, num, den)
        left, right = left[likely], right[likely]
        while left.size:
            # One partner of each row at a time, so that rows united meanwhile are not compared again.
            apart = np.fromiter((forest.root(a) != forest.root(b) for a, b in zip(left.tolist(), right.tolist(), strict=True)), bool, left.size)
            left, right = left[apart], right[apart]
            if not left.size:
                break
            now = np.zeros(left.size, bool)
            now[np.unique(left, return_index=True)[1]] = True
            for a, b in zip(left[now][hit := matches(left[now], right[now])].tolist(), right[now][hit].tolist(), strict=True):
                forest.unite(a, b)
            left, right = left[~now], right[~now]


# The join ---------------------------------------------------------------------------------------


def _parts(rows: DataFrame, sizes: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Adds part_a, part_b: rows of a key whose `size` exceeds the limit go to every pair of parts that holds theirs."""
    large = sizes.filter(F.col("size") > limit).select(key, F.ceil(F.col("size") / F.lit(limit)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(member), F.col("parts")).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = rows.join(large, key, "left").withColumn("own", F.coalesce(part, F.lit(0))).withColumn("other", F.explode(others))
    return spread.select(*rows.columns, F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"))


def _stars(ids: np.ndarray, forest: Forest) -> pa.RecordBatch:
    """An edge from each united member to its root."""
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(roots.size))
    return pa.RecordBatch.from_arrays([pa.array(ids[roots[moved]], pa.int64()), pa.array(ids[moved], pa.int64())], names=["a", "b"])


def grouped_candidates(groups: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Edges a, b that join the sets (set_id) of groups (key, part_a, part_b) into what may be similar."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, BUFFER_ROWS):
            ids, first, rows = np.unique(whole.column("set_id").to_numpy(), return_index=True, return_inverse=True)
            chosen = whole.select(["n", "bitmap"]).take(pa.array(first)).combine_chunks()
            members = Members(chosen.column("n").to_numpy(), chosen.column("bitmap").to_pylist())
            forest = Forest(ids.size)
            edges = _group_edges(whole)
            counts = np.diff(edges)
            # Groups of one leaf: their pairs in one go, equal pairs of several groups once.
            pairs = []
            for size in np.unique(counts[(counts > 1) & (counts <= LEAF)]).tolist():
                block = rows[edges[:-1][counts == size][:, None] + np.arange(size)]
                i, j = np.triu_indices(size, 1)
                codes = np.minimum(block[:, i], block[:, j]) * ids.size + np.maximum(block[:, i], block[:, j])
                pairs.append(np.unique(codes))
            if pairs:
                codes = np.unique(np.concatenate(pairs))
                left, right = codes // ids.size, codes % ids.size
                likely = (left != right) & members.possible(left, right, num, den)
                for a, b in zip(left[likely].tolist(), right[likely].tolist(), strict=True):
                    forest.unite(a, b)
            for k in np.flatnonzero(counts > LEAF):
                tree = build_tree(members, np.unique(rows[edges[k] : edges[k + 1]]))
                if tree is not None:
                    traverse(members, tree, forest, lambda left, right: np.ones(left.size, bool), num, den)
            yield _stars(ids, forest)

    dealt = groups.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b")
    return dealt.mapInArrow(links, "a long, b long")


def _group_edges(whole: pa.Table) -> np.ndarray:
    """Where groups begin in a table sorted by key and parts, and its end."""
    changed = np.ones(whole.num_rows, bool)
    columns = [whole.column(c).to_numpy() for c in ("key", "part_a", "part_b")]
    changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(changed), whole.num_rows)


def _whole_groups(batches, rows: int, weight=None) -> Iterator[pa.Table]:
    """Tables of whole groups, each closed once it holds that many rows (or that much of a weight)."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _group_edges(pa.Table.from_batches([batch]))
        weights = np.ones(batch.num_rows, np.int64) if weight is None else weight(batch)
        sums = np.concatenate([[0], np.cumsum(weights)])
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "part_a", "part_b")]
        begun = 0
        for e in edges[:-1].tolist():
            head = tuple(int(c[e]) for c in columns) if e == 0 else None
            if size + sums[e] - sums[begun] >= rows and (e > 0 or head != last):
                if e > begun:
                    held.append(batch.slice(begun, e - begun))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, size, begun = [], 0, e
        held.append(batch.slice(begun))
        size += int(sums[-1] - sums[begun])
        last = tuple(int(c[-1]) for c in columns)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def verified_links(blocks: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Edges a, b that join the texts of blocks (key, part_a, part_b) by exact similarity."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, TEXT_BYTES, lambda b: np.diff(text_bytes(b.column(b.schema.get_field_index("text")))[1])):
            edges = _group_edges(whole)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                own = whole.slice(a, b - a).combine_chunks()
                sets = shingle_sets(own.column("text").combine_chunks(), words)
                members = Members(np.array([s.size for s in sets], np.int64), [bitmap(s).tobytes() if s.size else bytes(8) for s in sets])

                def same(left: np.ndarray, right: np.ndarray, sets=sets, members=members) -> np.ndarray:
                    common = np.array([_overlap(sets[i], sets[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
                    return den * common >= num * (members.sizes[left] + members.sizes[right] - common)

                forest = Forest(len(sets))
                tree = build_tree(members, np.arange(len(sets)))
                if tree is not None:
                    traverse(members, tree, forest, same, num, den)
                yield _stars(own.column("doc_id").to_numpy(), forest)

    dealt = blocks.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b")
    return dealt.mapInArrow(links, "a long, b long")


def _overlap(one: np.ndarray, two: np.ndarray) -> int:
    at = np.searchsorted(one, two)
    at[at == one.size] = 0
    return int((one[at] == two).sum())


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (least document with the very same set) of every document."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    levels = frequency_levels(shingle_histogram(docs, words))
    described = settle(described_sets(docs, levels, words, num, den))
    identity = ["n", "low", "high"]
    least_row = [F.min("doc_id").alias("rep"), F.min_by("task", "doc_id").alias("task")]
    classes = settle(described.filter("n > 0").groupBy(*identity).agg(*least_row).withColumn("set_id", F.xxhash64(*identity)))
    # One row of every set, however many rows and tasks repeat it: the groups count and hash sets, not rows.
    standing_row = classes.withColumnRenamed("rep", "doc_id")
    chosen = described.filter("bitmap is not null").join(standing_row, [*identity, "doc_id", "task"]).select("set_id", "n", "prefix", "bitmap")
    postings = chosen.select(F.explode("prefix").alias("key"), "set_id")
    shared = settle(repeated_rows(postings))
    least = F.ceil(F.lit(num) * F.col("n") / F.lit(den))
    needed = (F.lit(1) + F.floor(least / F.lit(SHARED))).alias("needed")
    enough = shared.groupBy("set_id").agg(F.count(F.lit(1)).alias("have")).join(classes.select("set_id", needed), "set_id").filter("have >= needed").select("set_id")
    kept = settle(shared.join(enough, "set_id"))
    # Shingles with the very same sets give the same group: the least of them stands for all.
    same = [F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"sets{k}") for k in (0, 1)]
    lists = kept.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *same).filter("size > 1")
    standing = lists.groupBy("size", "sets0", "sets1").agg(F.min("key").alias("key")).select("key", "size")
    groups = _parts(kept.join(standing.select("key"), "key"), standing, "key", "set_id", GROUP_ROWS).join(chosen.select("set_id", "n", "bitmap"), "set_id")
    block_of = components(grouped_candidates(groups, num, den))
    in_block = block_of.select(F.col("node").alias("set_id"), F.col("root").alias("key")).unionByName(block_of.select(F.col("root").alias("set_id"), F.col("root").alias("key")).distinct())
    blocks = settle(in_block.join(classes.select("set_id", F.col("rep").alias("doc_id")), "set_id").select("doc_id", "key").distinct())

    weights = blocks.join(described.select("doc_id", "n").distinct(), "doc_id").groupBy("key").agg(F.sum("n").alias("size"))
    # Always dealt, whatever the sizes: the tables of block members grow with the documents.
    texts = docs.select("doc_id", "text").hint("merge").join(blocks, "doc_id")
    links = verified_links(_parts(texts, weights, "key", "doc_id", BLOCK_SHINGLES), words, num, den)
    # A doc_id with several sets is one node: it is linked with the class of each.
    differ = " or ".join(f"min({c}) <> max({c})" for c in identity)
    several = described.filter("n > 0").groupBy("doc_id").agg(F.expr(differ).alias("several")).filter("several").select("doc_id")
    own_classes = described.filter("n > 0").select("doc_id", *identity).join(several, "doc_id").join(classes, identity)
    roots = components(links.unionByName(own_classes.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))

    of_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*identity, F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("root"))
    joined = described.select("doc_id", *identity).join(of_class, identity, "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each_group(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents, as they are, that are the least of their component.

    Of several rows with one doc_id the one whose columns hash least stays, so equal tables give equal results.
    """
    rest = jaccard_components(docs, words, num, den).filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").hint("merge").join(rest, "doc_id", "left_anti").select(*docs.columns)
    hashed = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))])
    return kept.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), hashed).alias("row")).select("row.*")
