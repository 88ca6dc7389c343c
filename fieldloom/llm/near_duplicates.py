"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct word shingles.  Two sets are linked if their
Jaccard similarity reaches the threshold; documents in a chain of links form a
component.

1. Equal sets are one node, however many documents have them.
2. How many documents hold a shingle is counted over the whole corpus in a
   table of fixed size (``SKETCH_BITS``).  Shingles are ordered from rare to
   frequent by that count; those above a cutoff are the frequent class.
3. With ``o`` the least overlap a set of ``n`` needs, two linked sets share ``k``
   of their first ``n - o + k`` shingles.  Rare shingles of the first prefix
   (``k`` = 1) are indexed singly.  If the first that two sets share is frequent,
   so are all others: a hash deals them to ``m`` groups, and of ``k = m + 1``
   shared ones two are in one group, so the pairs within groups are indexed.
   Small sets have one group; larger ones have more by size class, so that the
   pairs of a set grow in proportion to it.
4. Each node is first compared with the leader of its buckets (the node with
   the fewest rarer shingles) and the neighbour that it meets most often.  The
   links found join most nodes.  Of the pairs of a bucket's nodes still in
   different components, first each node's likeliest and then all are compared.
   So no link that matters is lost, and a large group of copies isn't expanded
   into all its pairs.
5. Candidates are verified: first by a lower bound of the symmetric difference
   (parities of hashed shingles), then by the exact sizes.

Edge cases: a text with fewer words than a shingle is one shingle; a null text
or one without words has an empty set, is linked with nothing and forms its own
component; a component's id is its smallest doc_id that isn't null; repeated
rows belong to one component, unless empty; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.components import connected_components
from fieldloom.llm.key_filter import may_contain, member_masks
from fieldloom.llm.words import SPACED_LOWER, Chunk, chunks, mix, run_starts, runs
from fieldloom.sources.staging import stored

SKETCH_BITS = 22
BLOCK_BITS = 16
#: A shingle is frequent above this count, or above what chance puts in a cell.
FREQUENT = 48
#: Sets with prefixes up to this length index all pairs of frequent shingles.
PAIR_PREFIX = 40
#: Frequent shingles of a group of longer sets, on average; pairs are taken within groups.
GROUP = 10
PARITY_BITS = 1024
#: Larger buckets are compared block by block.
BLOCK_ROWS = 4096
#: Bytes of text whose shingles are held at once.
CHUNK_BYTES = 1 << 19
_SALT = np.uint64(0xA0761D6478BD642F)


def text_key() -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def pieces(column: pa.Array) -> Iterator[Chunk]:
    return chunks(column, SPACED_LOWER, size=CHUNK_BYTES)


def shingle_sets(c: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) without repeats, sorted by row and shingle."""
    at = run_starts(c.first, width)
    values = runs(c.hashes, width)[at]
    rows = np.searchsorted(c.first, at, side="right") - 1
    counts = c.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.array([runs(c.hashes[c.first[i] : c.first[i + 1]], int(counts[i]))[0] for i in short], dtype=np.uint64)
        rows, values = np.concatenate([rows, short]), np.concatenate([values, mix(whole ^ _SALT)])
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order].astype(np.uint16 if c.n < 65536 else np.uint32), kind="stable")]
    rows, values = rows[order], values[order]
    if len(rows):
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[fresh], values[fresh]
    return rows, values


@dataclass(frozen=True)
class KeyRule:
    """How sets are named: by ``bits`` of their first key, and by both keys where that clashes."""

    bits: int = 64
    clashes: tuple[int, ...] = ()

    def node(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        one = one >> np.uint64(64 - self.bits)
        return np.where(np.isin(one.view(np.int64), self.clashes), one ^ two, one) if self.clashes else one

    def column(self) -> Column:
        node = F.col("node")
        return F.when(node.isin(*self.clashes), node.bitwiseXOR(F.col("check"))).otherwise(node) if self.clashes else node


def _set_keys(n_rows: int, rows: np.ndarray, values: np.ndarray, rule: KeyRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, names and second keys (both free of order) of the sets; empty sets have 0."""
    sizes = np.bincount(rows, minlength=n_rows)
    out = [np.zeros(n_rows, dtype=np.uint64) for _ in range(2)]
    filled = np.flatnonzero(sizes)
    if len(filled):
        begin = (np.cumsum(sizes) - sizes)[filled]
        for k, salt in enumerate((_SALT, np.uint64(0xE7037ED1A0B428DB))):
            out[k][filled] = mix(np.add.reduceat(mix(values ^ salt), begin) + sizes[filled].astype(np.uint64))
    return sizes, rule.node(*out), out[1]


def describe_and_count(docs: DataFrame, width: int, rule: KeyRule = KeyRule()) -> DataFrame:
    """One pass: a row for each document, and the task's shingle counts by block."""
    names = ["doc_id", "text_key", "n_shingles", "node", "check", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for c in pieces(batch.column(2)):
                rows, values = shingle_sets(c, width)
                sizes, one, two = _set_keys(c.n, rows, values, rule)
                np.add.at(cells, (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.row, c.n), batch.column(1).slice(c.row, c.n), pa.array(sizes.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.nulls(c.n, pa.int32()), pa.nulls(c.n, pa.binary())], names)
        if cells.any():
            blocks = cells.reshape(-1, 1 << BLOCK_BITS)
            packed = [zlib.compress(b.tobytes(), 1) for b in blocks]
            k = len(packed)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), *[pa.nulls(k, pa.int64()) for _ in range(4)], pa.array(range(k), pa.int32()), pa.array(packed, pa.binary())], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", text_key(), F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, node long, check long, block int, counts binary")


def frequency_classes(described: DataFrame) -> tuple[np.ndarray, int]:
    """A class for each cell that grows with its count; the largest rare class."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint32)
                total[block] = total[block] + part if block in total else part.astype(np.uint64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], ["block", "counts"])

    parts = described.where(F.col("block").isNotNull()).select("block", "counts")
    counts = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), dtype=np.uint64)
    for row in parts.repartition(16, "block").mapInArrow(add, "block int, counts binary").toLocalIterator():
        counts[row.block] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint64)
    mean = float(counts.mean())
    level = lambda x: np.minimum(255, np.floor(4 * np.log2(np.asarray(x, dtype=np.float64) + 1))).astype(np.uint8)
    return level(counts.ravel()), int(level(max(FREQUENT, mean + 6 * mean**0.5)))


def _pairs_in_groups(tokens: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (earlier, later) of all pairs of tokens that a hash puts in one group."""
    if groups == 1:
        return np.triu_indices(len(tokens), 1)
    of = (tokens & np.uint64(0xFFFFFFFF)) % np.uint64(groups)
    order = np.argsort(of, kind="stable")
    fresh = np.flatnonzero(np.diff(of[order], prepend=np.uint64(groups)))
    start = np.repeat(fresh, np.diff(np.append(fresh, len(order))))
    earlier = np.arange(len(order)) - start  # how many of its group come before
    later = np.repeat(np.arange(len(order)), earlier)
    first = np.arange(len(later)) - np.repeat(np.cumsum(earlier) - earlier, earlier) + start[later]
    return order[first], order[later]


def prefix_postings(docs: DataFrame, width: int, threshold: Fraction, classes, rare: int, rule: KeyRule) -> DataFrame:
    """(key, rank, n, node): the index of rare shingles and of frequent pairs."""
    names = ["key", "rank", "n", "node"]
    num, den = threshold.numerator, threshold.denominator
    border = max(1, int((PAIR_PREFIX - 2) * den // (den - num))) if den > num else 1

    def groups_for(n: int) -> Iterator[tuple[int, int]]:
        """The size classes of a pair's larger set, if the other has ``n``, and their groups."""
        for k in range(max(0, -(-n // border) - 1).bit_length(), max(0, -(-(n * den // num) // border) - 1).bit_length() + 1):
            yield k, 1 if k == 0 else -(-(((border << k) * (den - num)) // den + 1) // GROUP)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = classes.value
        for batch in batches:
            for c in pieces(batch.column(0)):
                rows, values = shingle_sets(c, width)
                sizes, node, _ = _set_keys(c.n, rows, values, rule)
                begin = np.cumsum(sizes) - sizes
                token = (level[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(values) >> np.uint64(8))
                # fewer shingles than this can't be linked with a different set
                linkable = np.flatnonzero(sizes * (den - num) >= num)
                _, own = np.unique(node[linkable], return_index=True)
                keys, ranks, owners = [], [], []
                for i in linkable[own].tolist():
                    n = int(sizes[i])
                    prefix = n - -(-num * n // den) + 1
                    ways = list(groups_for(n))
                    reach = min(n, prefix + max(m for _, m in ways))
                    tokens = np.partition(token[begin[i] : begin[i] + n], reach - 1)[:reach]
                    tokens.sort()
                    first_often = int(np.searchsorted(tokens >> np.uint64(56), rare, side="right"))
                    single = tokens[: min(prefix, first_often)]
                    found, rank = [single], [np.arange(len(single))]
                    for k, m in ways:
                        often = tokens[first_often : prefix + m]
                        if len(often) > 1:
                            a, b = _pairs_in_groups(often, m)
                            found.append(mix(often[a] * np.uint64(3) ^ mix(often[b] ^ np.uint64(k))))
                            rank.append(a + (first_often - (m - 1)))
                    keys += found
                    ranks += rank
                    owners.append((i, sum(map(len, found))))
                if keys:
                    owner = np.repeat([i for i, _ in owners], [k for _, k in owners]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ranks).astype(np.int32)), pa.array(sizes[owner].astype(np.int32)), pa.array(node[owner].view(np.int64))], names)

    return docs.select(F.col("text").cast("string")).mapInArrow(post, "key long, rank int, n int, node long")


def _can_link(n_a, n_b, rank_a, rank_b, num: int, den: int):
    """Whether sizes and ranks of the first shared shingle leave enough overlap."""
    need = -(-(n_a + n_b) * num // (num + den))
    return (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num) & (np.minimum(n_a - rank_a, n_b - rank_b) >= need)


def shared_buckets(postings: DataFrame, threshold: Fraction, partitions: int) -> DataFrame:
    """Buckets with two nodes or more: (key, rank, n, node, leader, before).

    ``leader`` and ``before`` are the nodes to compare with first, or null.
    """
    num, den = threshold.numerator, threshold.denominator
    names = ["key", "rank", "n", "node", "leader", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), dtype=np.int64)  # the last row, which may be alone
        lead = np.zeros((4, 1), dtype=np.int64)  # leader of the bucket that the held row is in
        prior = np.zeros((4, 0), dtype=np.int64)  # the row before the held one
        source = iter(batches)
        while True:
            batch = next(source, None)
            if batch is None:
                rows, final = held, True
            else:
                rows, final = np.concatenate([held, np.array([x.to_numpy(zero_copy_only=False) for x in batch.columns], dtype=np.int64)], axis=1), False
            if rows.shape[1]:
                both = np.concatenate([prior, rows], axis=1)
                skip = prior.shape[1]
                repeat = np.zeros(both.shape[1], dtype=bool)
                repeat[1:] = (both[0, 1:] == both[0, :-1]) & (both[3, 1:] == both[3, :-1])
                repeat[:skip] = False
                both = both[:, ~repeat]
                fresh = np.ones(both.shape[1], dtype=bool)
                fresh[1:] = both[0, 1:] != both[0, :-1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
                leaders = both[:, first]
                if skip:
                    run_on = np.cumsum(fresh) == 1  # still the bucket of the prior row
                    leaders[:, run_on] = lead
                alone = fresh.copy()
                alone[:-1] &= fresh[1:]
                if skip:
                    alone[0] = False
                last = len(fresh) if final else len(fresh) - 1
                keep = np.zeros(len(fresh), dtype=bool)
                keep[skip:last] = ~alone[skip:last]
                at = np.flatnonzero(keep)
                if len(at):
                    x, ld, pv = both[:, at], leaders[:, at], both[:, np.maximum(at - 1, 0)]
                    good = (ld[3] != x[3]) & _can_link(x[2], ld[2], x[1], ld[1], num, den)
                    near = ~fresh[at] & (pv[3] != ld[3]) & _can_link(x[2], pv[2], x[1], pv[1], num, den)
                    yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1].astype(np.int32)), pa.array(x[2].astype(np.int32)), pa.array(x[3]), pa.array(ld[3], mask=~good), pa.array(pv[3], mask=~near)], names)
                if not final:
                    held = both[:, -1:]
                    lead = leaders[:, -1:]
                    prior = both[:, -2:-1] if len(fresh) > 1 and not fresh[-1] else held[:, :0]
            if final:
                return

    dealt = postings.repartition(partitions, "key").sortWithinPartitions("key", "rank", "n", "node")
    return dealt.mapInArrow(run, "key long, rank int, n int, node long, leader long, before long")


def first_partners(buckets: DataFrame) -> DataFrame:
    """(a, b): each node with the leader, and with the neighbour, that it meets most often."""
    out = None
    for column in ("leader", "before"):
        met = buckets.where(F.col(column).isNotNull()).groupBy("node", F.col(column).alias("other")).agg(F.count("*").alias("times"))
        best = met.groupBy("node").agg(F.max(F.struct("times", "other")).alias("best")).select("node", F.col("best.other").alias("other"))
        out = best if out is None else out.unionByName(best)
    return out.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are in more than one component so far, and each bucket's ``members``."""
    labelled = buckets.select("key", "rank", "n", "node").join(labels.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left").select("key", "rank", "n", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").select(F.col("key").alias("mixed"), "members")
    return labelled.join(mixed, F.col("key") == F.col("mixed")).drop("mixed")


def in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Buckets of over ``block_rows`` members cut into blocks: each two of them are a group of their own.

    ``side`` is 0 or 1 in a group of two blocks, and -1 in a group of one.
    """
    blocks = F.ceil(F.col("members") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    group = F.when(F.col("members") <= block_rows, F.col("key")).otherwise(F.xxhash64("key", low, high))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    # a block meets itself in the group of its own rows only
    return dealt.select(group.alias("key"), "rank", "n", "node", "component", side.cast("int").alias("side"))


def cross_pairs(rows: DataFrame, parities: DataFrame, threshold: Fraction, partitions: int, every: bool, block_rows: int = 0) -> DataFrame:
    """Pairs of a bucket's nodes in different components that may be linked.

    ``rows``: open_buckets.  The parities are compared inside the bucket, so that
    pairs which differ too much never leave it.  Without ``every`` a node gives
    its likeliest pair only.
    """
    num, den = threshold.numerator, threshold.denominator
    dealt = in_blocks(rows, block_rows or BLOCK_ROWS)
    described = dealt.join(parities.select(F.col("node").alias("of"), F.col("value").alias("parity")), F.col("node") == F.col("of")).select("key", "rank", "n", "node", "component", "side", "parity")
    words = PARITY_BITS // 64

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(rows: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
            bounds = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] - 1))
            left, right = [], []
            for a, b in zip(bounds, [*bounds[1:], rows.shape[1]], strict=True):
                _, rank, n, node, component, side = rows[:, a:b]
                own = parity[a:b]
                names, members = np.unique(component, return_counts=True)
                if len(names) < 2:
                    continue
                # pairs inside the largest component need no look
                for i in np.flatnonzero(component != names[members.argmax()]):
                    ok = (component != component[i]) & _can_link(n[i], n, rank[i], rank, num, den)
                    if side[i] >= 0:
                        ok &= side != side[i]
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    differ = np.bitwise_count(own[at] ^ own[i]).sum(axis=1)
                    good = differ * (num + den) <= (den - num) * (n[at] + n[i])
                    if not good.any():
                        continue
                    other = node[at[good]] if every else node[at[good]][differ[good].argmin()][None]
                    left.append(np.minimum(node[i], other))
                    right.append(np.maximum(node[i], other))
            if left:
                found = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        rest, rest_parity = np.zeros((6, 0), dtype=np.int64), np.zeros((0, words), dtype=np.uint64)
        for batch in batches:
            rows = np.concatenate([rest, np.array([x.to_numpy(zero_copy_only=False) for x in batch.columns[:6]], dtype=np.int64)], axis=1)
            parity = np.concatenate([rest_parity, np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint64).reshape(-1, words)])
            if rows.shape[1]:
                whole = int(np.argmax(rows[0] == rows[0, -1]))
                if whole:
                    yield from cut(rows[:, :whole], parity[:whole])
                rest, rest_parity = rows[:, whole:], parity[whole:]
        if rest.shape[1]:
            yield from cut(rest, rest_parity)

    return described.repartition(partitions, "key").sortWithinPartitions("key", "n", "node").mapInArrow(pairs, "a long, b long").distinct()


def described_nodes(docs: DataFrame, width: int, nodes: DataFrame, whole: bool, rule: KeyRule = KeyRule()) -> DataFrame:
    """(node, n, value) of the nodes; ``nodes``: node, text_key of a text that has it.

    ``value`` is the shingles, or the parities of their hashes.  Only the texts
    that the filter lets through are cut into words.
    """
    maybe = member_masks(nodes.select("text_key"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_contain(maybe.value, batch.column(0).to_numpy(zero_copy_only=False))))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for c in pieces(batch.column(1)):
                rows, values = shingle_sets(c, width)
                sizes, node, _ = _set_keys(c.n, rows, values, rule)
                begin = np.cumsum(sizes) - sizes
                # copies of a text have one set; other texts with that set stay, as the join may want any of them
                _, own = np.unique(np.stack([keys[c.row : c.row + c.n].view(np.uint64), node]), axis=1, return_index=True)
                take = own[sizes[own] > 0]
                sets = [values[begin[i] : begin[i] + sizes[i]] for i in take]
                if not whole:
                    sets = [np.packbits(np.bincount((s % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys[c.row + take]), pa.array(node[take].view(np.int64)), pa.array(sizes[take].astype(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "node", "n", "value"])

    keyed = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text"))
    read = keyed.mapInArrow(gather, "key long, node long, n long, value binary")
    return read.join(nodes.select(F.col("node").alias("of"), "text_key"), (F.col("node") == F.col("of")) & (F.col("key") == F.col("text_key")), "left_semi").select("node", "n", "value").dropDuplicates(["node"])


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text_key) for the distinct nodes of a one-column frame."""
    nodes = wanted.select(F.col(wanted.columns[0]).alias("want")).distinct()
    return stored(rows.join(nodes, F.col("node") == F.col("want"), "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _with_values(frame: DataFrame, values: DataFrame) -> DataFrame:
    for column in ("a", "b"):
        side = values.select(F.col("node").alias(f"of_{column}"), F.col("n").alias(f"n_{column}"), F.col("value").alias(f"set_{column}"))
        frame = frame.join(side, F.col(column) == F.col(f"of_{column}")).drop(f"of_{column}")
    return frame.select("a", "b", "n_a", "n_b", "set_a", "set_b")


def near_enough(pairs: DataFrame, parities: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs whose parities don't rule them out."""
    num, den = threshold.numerator, threshold.denominator

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, n_a, n_b in zip(batch.column(4), batch.column(5), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                differ = int(np.bitwise_count(np.frombuffer(a.as_py(), dtype=np.uint64) ^ np.frombuffer(b.as_py(), dtype=np.uint64)).sum())
                keep.append(differ * (num + den) <= (den - num) * (n_a + n_b))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return _with_values(pairs, parities).mapInArrow(bound, "a long, b long").distinct()


def linked(docs: DataFrame, width: int, near: DataFrame, rows: DataFrame, threshold: Fraction, rule: KeyRule) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold, by their whole sets."""
    num, den = threshold.numerator, threshold.denominator

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    sets = described_nodes(docs, width, texts_of(rows, _ends(near)), True, rule)
    return _with_values(near, sets).mapInArrow(exact, "a long, b long").distinct()


def labelled_rows(docs: DataFrame, width: int, threshold: str, key_bits: int = 64) -> DataFrame:
    """(doc_id, text_key, n_shingles, component) of every row; see near_duplicate_components.

    ``component`` is a node of the component, and null for empty sets.
    """
    limit = Fraction(threshold)
    if not Fraction(1, 2) < limit <= 1:
        raise ValueError("threshold must be above 0.5 and at most 1")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = stored(describe_and_count(docs, width, KeyRule(key_bits)))
    keyed = described.where(F.col("block").isNull()).select("doc_id", "text_key", "n_shingles", "node", "check")
    # n sets are expected to give n**2 / 2**65 of these: 270 for 10**11 sets
    clashes = keyed.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high").select("node").toLocalIterator()
    rule = KeyRule(key_bits, tuple(sorted(r.node for r in clashes)))
    rows = keyed.select("doc_id", "text_key", "n_shingles", rule.column().alias("node"))
    classes, rare = frequency_classes(described)
    postings = prefix_postings(docs, width, limit, spark.sparkContext.broadcast(classes), rare, rule)
    buckets = stored(shared_buckets(postings, limit, partitions))
    first = stored(first_partners(buckets))
    parities = stored(described_nodes(docs, width, texts_of(rows, _ends(first)), False, rule))
    near = stored(near_enough(first, parities, limit))
    links = stored(linked(docs, width, near, rows, limit, rule))
    labels = connected_components(links)
    tried = near
    for every in (False, True):
        open_rows = stored(open_buckets(buckets, labels))
        lacking = open_rows.select("node").distinct().join(parities.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
        more = texts_of(rows, lacking)
        if more.limit(1).count():
            parities = parities.unionByName(stored(described_nodes(docs, width, more, False, rule)))
        near = stored(cross_pairs(open_rows, parities, limit, partitions, every).join(tried, ["a", "b"], "left_anti"))
        if near.limit(1).count():
            links = links.unionByName(stored(linked(docs, width, near, rows, limit, rule)))
            labels = connected_components(links)
            tried = tried.unionByName(near)
    own = (F.col("node") == F.col("of")) & (F.col("n_shingles") > 0)
    label = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))
    return rows.join(labels.select(F.col("node").alias("of"), "component"), own, "left").select("doc_id", "text_key", "n_shingles", label.alias("component"))


def near_duplicate_components(docs: DataFrame, width: int = 5, threshold: str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    ``threshold`` is written as a decimal, is above 0.5, and is compared exactly.
    """
    rows = labelled_rows(docs, width, threshold)
    smallest = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = rows.where("component IS NOT NULL").join(smallest, "component").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.where("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: str = "0.8") -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns.

    Null ids come last; rows that repeat the id are ordered by a hash of their
    text.  Rows without words are all kept.
    """
    rows = stored(labelled_rows(docs, width, threshold))
    full = rows.where("component IS NOT NULL")
    chosen = full.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")).select("first.doc_id", "first.text_key")
    times = full.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    same = F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.text_key") == F.col("t.text_key"))
    kept = chosen.alias("c").join(times.alias("t"), same).select(F.col("c.doc_id").alias("__id"), F.col("c.text_key").alias("__of"), "times")
    empty = rows.where("component IS NULL").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__of")).distinct()
    keyed = docs.withColumn("__key", text_key())
    match = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of"))
    single = keyed.join(kept.where("times = 1").drop("times").unionByName(empty), match, "left_semi")
    several = kept.where("times > 1")
    if several.limit(1).count():
        repeated = keyed.join(several, match).dropDuplicates(["__id", "__of"]).select(single.columns)
        single = single.unionByName(repeated)
    return single.drop("__key")
