"""Removing repeated word runs with fixed-block anchors.

A word is removed if it lies in a window of ``window`` words whose sequence
also starts earlier: in a document with a smaller doc_id, or earlier in the same
one.

1. Every document is cut into non-overlapping reference blocks of ``window //
   2`` words; any window holds one whole block.  All rolling windows of that
   length probe the blocks.  A place whose words equal a reference block
   elsewhere is an anchor.
2. Each anchor is extended to all windows that hold it, and these windows are
   matched over the whole corpus by 128 bits: the earliest one of each word
   sequence stays, the others are repeats.  Overlapping repeats merge into maximal ones.
3. The words of the repeats are cut out.

Places travel between tasks in packed runs (sorted hashes as differences, one
byte plane after another), because every word of the corpus is a probe.  A run
sends each sequence once, however often the run holds it, so a passage that a
third of all documents share gives one entry per run and no group of its
occurrences is ever gathered.  The number of buckets grows with the text.

Edge cases: a null or empty text has no words; texts shorter than a window are
kept whole; a null doc_id counts as larger than all others; rows that share a
doc_id count as one document, so that a window of one repeats a window of the
other only if it starts later; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from fieldloom.llm.key_filter import may_contain, member_masks, passing
from fieldloom.llm.words import SPACED, chunks, mix, run_starts, runs
from fieldloom.sources.staging import checkpointed

RUN_BYTES = 1 << 21
BUCKET_BYTES = 1 << 23
_LAST = np.iinfo(np.int64).max
_PACKED = "bucket long, run long, n int, places binary, ids binary"
_NAMES = ["bucket", "run", "n", "places", "ids"]
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


def _planes(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, all first bytes, then all second ones, and so on."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)


def _unplanes(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        part = np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
        out.append(np.ascontiguousarray(part.T).view(kind).ravel())
        at += n * size
    return out


def row_key() -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64("doc_id", "text")


def _pack_run(keys: np.ndarray, more: np.ndarray | None, docs: np.ndarray, places: np.ndarray, local: np.ndarray, ids: np.ndarray | None, row_keys: np.ndarray, buckets: int, bits: int) -> pa.RecordBatch:
    """One row per bucket with the run's places (sorted by key), and one with the rest.

    ``more``: the keys' second halves, if they have one.  ``local``: (document,
    place) pairs that are decided without the others.  The rest has a number
    below 0 of its own, so that it is in no other run's group.
    """
    run = xxhash.xxh3_64_intdigest(np.ascontiguousarray(row_keys).tobytes()) >> 1
    width = np.uint64((1 << bits) // buckets + 1) if bits < 64 else np.uint64((1 << 64) // buckets + 1)
    of = (keys // width).astype(np.int64)
    bounds = np.flatnonzero(np.diff(of, prepend=-1))
    ends = np.append(bounds[1:], len(keys))
    packed_ids = _planes(np.diff(ids, prepend=np.int64(0))) if ids is not None else None
    halves = [] if more is None else [more]
    rows = [(int(of[a]), run, int(b - a), _planes(np.diff(keys[a:b], prepend=np.uint64(0)), docs[a:b].astype(np.uint32), places[a:b].astype(np.uint32), *(h[a:b] for h in halves)), packed_ids) for a, b in zip(bounds, ends, strict=True)]
    rows.append((-1 - run, run, local.shape[1], _planes(local[0].astype(np.uint32), local[1].astype(np.uint32)), np.ascontiguousarray(row_keys).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _sort_run(keys: np.ndarray, *by: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and then ``by``, and where a new key begins in it."""
    halves = [keys] if more is None else [keys, more]
    order = np.lexsort((*by[::-1], *halves[::-1])) if by else np.argsort(keys, kind="stable")
    fresh = np.zeros(len(keys), dtype=bool)
    fresh[:1] = True
    for half in halves:
        fresh[1:] |= half[order][1:] != half[order][:-1]
    return order, fresh


def _later(keys: np.ndarray, more: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, document and place; which of it starts after its key's first."""
    order, fresh = _sort_run(keys, ids, places, more=more)
    if not len(order):
        return order, fresh
    first = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return order, (ids[order] != ids[first]) | (places[order] != places[first])


def block_probes(docs: DataFrame, block: int, buckets: int, bits: int) -> DataFrame:
    """All rolling places of ``block`` words, packed; places divisible by it are references."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_keys = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1), SPACED, size=RUN_BYTES):
                at = run_starts(c.first, block)
                if not len(at):
                    continue
                keys = runs(c.hashes, block)[at] >> np.uint64(64 - bits)
                doc = np.searchsorted(c.first, at, side="right") - 1
                place = at - c.first[doc]
                # a reference comes first among the run's equal places, so that it stands for them
                order, fresh = _sort_run(keys, place % block != 0)
                again = ~fresh
                again[:-1] |= ~fresh[1:]
                repeated = order[again]
                sent = order[fresh]
                yield _pack_run(keys[sent], None, doc[sent], place[sent], np.array([doc[repeated], place[repeated]]), None, row_keys[c.row : c.row + c.n], buckets, bits)

    return docs.select(row_key(), F.col("text").cast("string")).mapInArrow(probe, _PACKED)


def _bucket(table: pa.Table, whole: bool) -> tuple[np.ndarray, ...]:
    """Keys, documents, places and rows of the table of a bucket's entries.

    ``whole``: with the keys' second halves and the doc_ids.
    """
    counts = table["n"].to_pylist()
    ends = np.cumsum(counts)
    keys, docs, places = np.empty(ends[-1], dtype=np.uint64), np.empty(ends[-1], dtype=np.uint32), np.empty(ends[-1], dtype=np.uint32)
    more, ids = (np.empty(ends[-1], dtype=np.uint64), np.empty(ends[-1], dtype=np.int64)) if whole else (keys[:0], keys[:0])
    for i, (n, end, data) in enumerate(zip(counts, ends, table["places"], strict=True)):
        at = slice(end - n, end)
        k, docs[at], places[at], *half = _unplanes(data.as_py(), n, np.uint64, np.uint32, np.uint32, *([np.uint64] if whole else []))
        np.cumsum(k, dtype=np.uint64, out=keys[at])
        if whole:
            more[at] = half[0]
            raw = table["ids"][i].as_py()
            ids[at] = np.cumsum(_unplanes(raw, len(raw) // 8, np.int64)[0])[docs[at]]
    return keys, docs, places, np.repeat(np.arange(len(counts), dtype=np.int32), counts), more, ids


def _answer(table: pa.Table, rows: np.ndarray, docs: np.ndarray, places: np.ndarray, chosen: np.ndarray) -> pa.Table:
    """The chosen entries, packed for each run."""
    chosen = chosen[np.argsort(rows[chosen], kind="stable")]
    bounds = np.searchsorted(rows[chosen], np.arange(table.num_rows + 1))
    run = table["run"].to_pylist()
    out = [(0, run[i], int(b - a), _planes(docs[chosen[a:b]], places[chosen[a:b]]), None) for i, (a, b) in enumerate(itertools.pairwise(bounds)) if b > a]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(_KINDS)], _NAMES)


def _match(packed: DataFrame, decide, merge, schema: str) -> DataFrame:
    """Buckets decide on their entries; runs merge the answers by document.

    ``merge(documents, places)`` gives one binary value a document.
    """

    def in_bucket(table: pa.Table) -> pa.Table:
        return table if table["bucket"][0].as_py() < 0 else decide(table)

    def in_run(table: pa.Table) -> pa.Table:
        own = [i for i, b in enumerate(table["bucket"].to_pylist()) if b < 0]
        row_keys = np.frombuffer(table["ids"][own[0]].as_py(), dtype=np.int64)
        parts = [_unplanes(data.as_py(), n, np.uint32, np.uint32) for n, data in zip(table["n"].to_pylist(), table["places"], strict=True)]
        doc, place = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        if not len(doc):
            return pa.table({"row_key": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        spans = [merge(place[a:b]) for a, b in zip(begin, np.append(begin[1:], len(doc)), strict=True)]
        return pa.table({"row_key": pa.array(row_keys[doc[begin]]), "spans": pa.array(spans, pa.binary())})

    answered = packed.groupBy("bucket").applyInArrow(in_bucket, _PACKED)
    return answered.groupBy("run").applyInArrow(in_run, schema).dropDuplicates(["row_key"])


def _merged(begin: np.ndarray, end: np.ndarray) -> bytes:
    """Sorted spans with overlapping and touching ones joined, as pairs of uint32."""
    reach = np.maximum.accumulate(end)
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(begin)) - 1
    return np.stack([begin[first], reach[last]], axis=1).astype(np.uint32).tobytes()


def anchored_windows(docs: DataFrame, window: int, buckets: int, bits: int) -> DataFrame:
    """(row_key, spans): spans of starts of windows that hold an anchor."""
    block = window // 2

    def decide(table: pa.Table) -> pa.Table:
        keys, docs_, places, rows, _, _ = _bucket(table, False)
        order, fresh = _sort_run(keys)
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(order)))
        anchored = np.maximum.reduceat((places[order] % block == 0).astype(np.int8), begin) > 0
        return _answer(table, rows, docs_, places, order[np.repeat(anchored & (size > 1), size)])

    def merge(places: np.ndarray) -> bytes:
        return _merged(np.maximum(places - (window - block), 0), places + 1)

    return _match(block_probes(docs, block, buckets, bits), decide, merge, "row_key long, spans binary")


def repeated_words(matched: DataFrame, window: int, buckets: int) -> DataFrame:
    """(row_key, spans): word spans that repeat an earlier window.

    ``matched``: row_key, doc_id, text and the spans of window starts to look at.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            row_keys = batch.column(0).to_numpy(zero_copy_only=False)
            by_id = np.lexsort((row_keys, ids))  # documents in a run are in order of doc_id
            ids, row_keys = ids[by_id], row_keys[by_id]
            texts, spans = batch.column(2).take(pa.array(by_id)), batch.column(3).take(pa.array(by_id))
            for c in chunks(texts, SPACED, size=RUN_BYTES):
                starts, doc = [], []
                counts = c.counts()
                for i in range(c.n):
                    last = int(counts[i]) - window + 1
                    for a, b in np.frombuffer(spans[c.row + i].as_py(), dtype=np.uint32).reshape(-1, 2).tolist():
                        if a < min(b, last):
                            starts.append(np.arange(a, min(b, last)))
                            doc.append(np.full(len(starts[-1]), i))
                if not starts:
                    continue
                place, doc_of = np.concatenate(starts), np.concatenate(doc)
                at = c.first[doc_of] + place
                keys, more = runs(c.hashes, window)[at], runs(mix(c.hashes ^ _SALT), window)[at]
                id_of = ids[c.row + doc_of]
                order, again = _later(keys, more, id_of, place)
                sent, again = order[~again], order[again]
                yield _pack_run(keys[sent], more[sent], doc_of[sent], place[sent], np.array([doc_of[again], place[again]]), ids[c.row : c.row + c.n], row_keys[c.row : c.row + c.n], buckets, 64)

    def decide(table: pa.Table) -> pa.Table:
        keys, docs_, places, rows, more, ids = _bucket(table, True)
        order, later = _later(keys, more, ids, places)
        return _answer(table, rows, docs_, places, order[later])

    def merge(places: np.ndarray) -> bytes:
        return _merged(places, places + window)

    return _match(matched.mapInArrow(extend, _PACKED), decide, merge, "row_key long, spans binary")


def substring_dedup(docs: DataFrame, window: int = 20, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    ``keep`` names more columns of ``docs`` to return.  With ``with_text`` the
    results are named __words, __removed, __digest, and __kept is the text: as
    it is if nothing is removed, else the kept words joined by one space.
    """
    block = window // 2
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first().b
    buckets = max(32, -(-size // BUCKET_BYTES))
    bits = min(63, max(24, int(max(1, size // (6 * block))).bit_length() + 14))
    anchored = checkpointed(anchored_windows(docs, window, buckets, bits))
    texts = docs.select(row_key().alias("row_key"), "doc_id", F.col("text").cast("string").alias("text"))
    matched = passing(texts, member_masks(anchored.select("row_key")), "row_key").join(anchored.withColumnRenamed("row_key", "of"), F.col("row_key") == F.col("of")).select("row_key", F.col("doc_id").cast("long"), "text", "spans")
    repeats = checkpointed(repeated_words(matched, window, buckets))
    maybe = member_masks(repeats.select("row_key"))
    names = [*dict.fromkeys(["doc_id", *keep])]
    columns = [F.col("`" + name.replace("`", "``") + "`") for name in names]
    plain = docs.select(row_key().alias("__key"), F.col("text").cast("string").alias("__text"), *columns)
    spans = repeats.select(F.col("row_key").alias("__of"), F.col("spans").alias("__spans"))
    touched = passing(plain, maybe, "__key").join(spans, F.col("__key") == F.col("__of"), "left").select("__text", "__spans", *columns)
    results = ["__words", "__removed", "__digest", "__kept"] if with_text else ["n_words", "n_removed", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept_texts = [], [], [], []
            for text, spans in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                words = (raw or "").encode().split()  # bytes.split() splits at exactly these separators
                counts.append(len(words))
                kept = words
                if spans.is_valid:
                    kept, at = [], 0
                    for a, b in np.frombuffer(spans.as_py(), dtype=np.uint32).reshape(-1, 2).tolist():
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_texts.append(raw if len(kept) == len(words) else joined.decode())
            made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made, *([pa.array(kept_texts, pa.string())] if with_text else [])], [*names, *results])

    schema = StructType([docs.schema[n] for n in names])
    for name, of in zip(results, (LongType(), LongType(), StringType(), StringType()), strict=False):
        schema = schema.add(name, of)
    def cut_untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~may_contain(maybe.value, batch["__key"].to_numpy(zero_copy_only=False))))
            spans = pa.nulls(rest.num_rows, pa.binary())
            yield from cut(iter([pa.RecordBatch.from_arrays([rest.column(1), spans, *rest.columns[2:]], ["__text", "__spans", *names])]))

    return touched.mapInArrow(cut, schema).unionByName(plain.mapInArrow(cut_untouched, schema))


def cut_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` without its repeats, with all its columns.

    Texts that lose nothing stay as they are; the others become their kept words
    joined by one space, with n_chars (if there) to match.  Documents that lose
    every word are dropped.
    """
    found = substring_dedup(docs, window, keep=tuple(docs.columns), with_text=True).where("__removed = 0 OR __removed < __words")
    out = []
    for name in docs.columns:
        column = F.col("`" + name.replace("`", "``") + "`")
        if name == "text":
            column = F.col("__kept").cast(docs.schema["text"].dataType)
        elif name == "n_chars":
            column = F.when(F.col("__removed") > 0, F.length("__kept")).otherwise(column).cast(docs.schema["n_chars"].dataType)
        out.append(column.alias(name))
    return found.select(*out)
