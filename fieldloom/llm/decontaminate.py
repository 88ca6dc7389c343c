"""Benchmark decontamination with a distributed positional inverted index.

Training tokens that can matter are stored as postings ``(term, document,
position)``.  Each benchmark window is searched from its rarest terms: the
posting lists of its two rarest places are shifted by the term's offset and
intersected on (document, start).  What remains is compared with the window
word for word through the neighbourhood that the rarest posting carries.

Edge cases: a null or empty text has no words, is never hit and never
contaminated; an item without words has no window; equal items count as
separate items; rows that repeat a doc_id each get a row of their own, judged
on their own text; a null doc_id is kept as it is; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.words import ALNUM_LOWER, chunks, runs
from fieldloom.sources.staging import checkpointed

#: Bits of the filter that says whether a word can be a benchmark term.
FILTER_BITS = 22
#: Benchmark-side tables of up to so many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def text_key() -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def item_windows(items: DataFrame, id_column: str, window: int) -> DataFrame:
    """One row per window and item: the window's key, its terms and its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), ALNUM_LOWER):
                ids, keys, terms = [], [], []
                for i in range(c.n):
                    words = c.hashes[c.first[i] : c.first[i + 1]]
                    width = min(window, len(words))
                    for s in range(len(words) - width + 1 if width else 0):
                        run = words[s : s + width]
                        ids.append(batch.column(0)[c.row + i].as_py())
                        keys.append(int(runs(run, width)[0].astype(np.int64)))
                        terms.append(run.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["item", "window_key", "terms"])

    return items.select(F.col(id_column).cast("string"), F.col("text").cast("string")).mapInArrow(cut, "item string, window_key long, terms array<long>")


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit set of fixed size that holds every term (and some words besides)."""
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    cells = terms.selectExpr(f"term & {(1 << FILTER_BITS) - 1} AS cell").selectExpr("cell >> 3 AS byte", "cell & 7 AS bit")
    for row in cells.groupBy("byte").agg(F.expr("bit_or(shiftleft(1, CAST(bit AS INT)))").alias("mask")).toLocalIterator():
        for k in range(8):
            bits[row.byte * 8 + k] = row.mask >> k & 1
    return bits


def term_counts(docs: DataFrame, terms: DataFrame, bits) -> DataFrame:
    """How often each test term occurs in the training text."""
    low = np.uint64((1 << FILTER_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0), ALNUM_LOWER):
                seen, n = np.unique(c.hashes[bits.value[(c.hashes & low).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def positional_index(docs: DataFrame, bits, reach: int) -> DataFrame:
    """Postings of the terms in ``bits`` and, with a null term, each row's length.

    ``around`` holds the hashes of the words from ``reach`` before to ``reach``
    after the posting; places beyond the text are zero.
    """
    low = np.uint64((1 << FILTER_BITS) - 1)
    span = 2 * reach + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "term", "position", "around"]
        for batch in batches:
            ids, prints = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(2), ALNUM_LOWER):
                kept = np.flatnonzero(bits.value[(c.hashes & low).astype(np.int64)])
                rows = np.searchsorted(c.first, kept, side="right") - 1
                lengths = c.counts()
                yield pa.RecordBatch.from_arrays([ids.slice(c.row, c.n), pa.array(prints[c.row : c.row + c.n]), pa.nulls(c.n, pa.int64()), pa.array(lengths.astype(np.int64)), pa.nulls(c.n, pa.binary())], names)
                for at in range(0, len(kept), 50_000):
                    k, r = kept[at : at + 50_000], rows[at : at + 50_000]
                    places = k[:, None] + np.arange(-reach, reach + 1)[None, :]
                    own = (places >= c.first[r][:, None]) & (places < c.first[r + 1][:, None])
                    around = np.where(own, c.hashes[np.clip(places, 0, len(c.hashes) - 1)], np.uint64(0))
                    offsets = np.arange(len(k) + 1, dtype=np.int32) * (8 * span)
                    packed = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(around).tobytes())])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + c.row)), pa.array(prints[r + c.row]), pa.array(c.hashes[k].view(np.int64)), pa.array((k - c.first[r]).astype(np.int64)), packed], names)

    return docs.select("doc_id", text_key(), F.col("text").cast("string")).mapInArrow(post, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, term long, position long, around binary")


def search(index: DataFrame, anchors: DataFrame, n_anchors: int, reach: int, slop: int = 0) -> DataFrame:
    """Occurrences of windows: (doc_id, text_key, start, length, window_key).

    ``anchors``: window_key, terms, and the two rarest places (term1, offset1,
    term2, offset2).  With ``slop`` 0 the phrase is exact.  With a larger slop
    the two rarest terms may be that much nearer or farther than in the window
    (a proximity match), and nothing else is compared.
    """
    postings = index.where(F.col("term").isNotNull())
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.window_key") == F.col("b.window_key"))
    lists = []
    for k in (1, 2):
        side = anchors.select("window_key", F.col(f"term{k}").alias("term"), F.col(f"offset{k}").alias("offset"), "terms")
        found = postings.join(_small(side, n_anchors), "term")
        lists.append(found.select("doc_id", "text_key", "window_key", (F.col("position") - F.col("offset")).alias("start"), *(["terms", "offset", "around"] if k == 1 else [])))
    near = F.abs(F.col("a.start") - F.col("b.start")) <= slop if slop else F.col("a.start") == F.col("b.start")
    both = lists[0].alias("a").join(lists[1].alias("b"), same & near, "left_semi")
    if slop:
        return both.select("doc_id", "text_key", "start", F.size("terms").cast("long").alias("length"), "window_key").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for terms, offset, around in zip(batch.column("terms"), batch.column("offset"), batch.column("around"), strict=True):
                want, have = np.array(terms.as_py(), dtype=np.int64), np.frombuffer(around.as_py(), dtype=np.int64)
                begin = reach - offset.as_py()
                keep.append(bool((have[begin : begin + len(want)] == want).all()))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["doc_id", "text_key", "start", "length", "window_key"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "text_key", "start", F.size("terms").cast("long").alias("length"), "window_key", "terms", "offset", "around").mapInArrow(compare, f"doc_id {kind}, text_key long, start long, length long, window_key long")


def rarest_places(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The two rarest places of each distinct window; none if a term never occurs."""
    distinct = windows.groupBy("window_key").agg(F.first("terms").alias("terms"))
    placed = distinct.select("window_key", "terms", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    ranked = placed.groupBy("window_key").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("places"))
    one, two = F.col("places")[0], F.col("places")[F.least(F.lit(1), F.size("places") - 1)]
    return ranked.where(one["n"] > 0).select("window_key", "terms", one["term"].alias("term1"), one["offset"].alias("offset1"), two["term"].alias("term2"), two["offset"].alias("offset2"))


def covered_words(hits: DataFrame) -> DataFrame:
    """Words inside any occurrence, by row of the documents."""
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "length")
    reached = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce(reached, F.lit(0))))
    return hits.select("doc_id", "text_key", "start", "length").distinct().withColumn("fresh", fresh).groupBy("doc_id", "text_key").agg(F.sum("fresh").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, item_id: str = "item_id") -> DataFrame:
    """Each document's overlap with the benchmark.

    A word is hit if it lies in an occurrence of a window; a document is
    contaminated if ``n_hit > 0 and share * n_hit >= n_words``.  Returns doc_id,
    text_key (a fingerprint that tells rows with one doc_id apart), n_words,
    n_hit, n_items, items_sha256, contaminated.
    """
    spark = docs.sparkSession
    windows = checkpointed(item_windows(items, item_id, window))
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    counts = term_counts(docs, terms, spark.sparkContext.broadcast(term_filter(terms)))
    anchors = checkpointed(rarest_places(windows, counts))
    n_anchors = anchors.count()
    wanted = anchors.select(F.explode(F.array("term1", "term2")).alias("term")).distinct()
    index = checkpointed(positional_index(docs, spark.sparkContext.broadcast(term_filter(wanted)), window - 1))
    hits = checkpointed(search(index, anchors, n_anchors, window - 1).distinct())
    members = windows.select("window_key", "item").distinct()
    named = hits.select("doc_id", "text_key", "window_key").distinct().join(_small(members, members.count()), "window_key").select("doc_id", "text_key", "item").distinct()
    named = named.groupBy("doc_id", "text_key").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("listed"))
    rows = index.where(F.col("term").isNull()).select("doc_id", "text_key", F.col("position").alias("n_words"))
    same = lambda side: F.col("r.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.col("r.text_key") == F.col(f"{side}.text_key"))
    out = rows.alias("r").join(covered_words(hits).alias("c"), same("c"), "left").join(named.alias("i"), same("i"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("r.doc_id", "r.text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    found = decontaminate(docs, items, **options).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_text")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (text_key() == F.col("__bad_text")), "left_anti")
