"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of byte contexts up to ``order`` bytes long.
A byte's code length in a language is that of its longest known context, with
an escape (method C: distinct / (total + distinct)) to the next shorter one for
every context that has not seen it, and a uniform code at the end.  Statistics
are frozen after training.  The language with the shortest code for the whole
text wins; the score is 2**-bits of the winner over the sum for all languages.

The trees are fitted on at most ``docs_per_language`` labelled documents of each
language (those with the smallest hash of their id; whole texts).  The union of
their contexts, at most ``max_cells`` code lengths in all with the most frequent
contexts first, is the model that tasks receive, so its size is bounded.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if no language was learned; equal code lengths go to the language
first in byte order; a null id trains as the empty string does not (it never
trains) and is predicted as any other; repeated rows are predicted alike and
train as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.words import string_buffers

ORDER = 3
UNKNOWN = "und"
MAX_LANGUAGES = 256
#: Bytes of text whose contexts are looked up at once.
CHUNK_BYTES = 1 << 19
#: Symbols whose code lengths are held at once, also of one long text.
SLICE = 1 << 18
#: Parts in which each language's smallest draws are chosen before they meet.
DRAW_PARTS = 64


def byte_symbols() -> np.ndarray:
    """Letters without case; all ASCII that is no letter is one symbol, 32."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    other = np.ones(128, dtype=bool)
    other[65:91] = other[97:123] = False
    table[:128][other] = 32
    return table


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _shifted(symbols: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """The symbol ``back`` places before each; a space before a text's start."""
    out = np.empty_like(symbols)
    out[:back] = 32
    out[back:] = symbols[:-back] if back else symbols
    for j in range(back):
        at = starts + j
        out[at[(at >= 0) & (at < len(out))]] = 32
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, symbols, offsets) of some rows at a time.

    Between letters there is one space symbol, however much stands there.
    """
    at, raw = string_buffers(column)
    table, n, row = byte_symbols(), len(at) - 1, 0
    while row < n:
        stop = min(n, max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, side="right")) - 1))
        symbols, bounds = table[raw[at[row] : at[stop]]], at[row : stop + 1] - at[row]
        kept = (symbols != 32) | (_shifted(symbols, bounds[:-1], 1) != 32)
        upto = np.zeros(len(symbols) + 1, dtype=np.int64)
        np.cumsum(kept, out=upto[1:])
        yield row, stop, symbols[kept], upto[bounds]
        row = stop


def sample_counts(labelled: DataFrame, docs_per_language: int, order: int) -> DataFrame:
    """(lang, gram, n): the byte grams of the sampled texts; labelled: id, lang, text."""
    draw = F.xxhash64(F.col("id").cast("string"))
    chosen = labelled.select("id", "lang", draw.alias("draw"), F.pmod(F.xxhash64("id", "lang", "text"), F.lit(DRAW_PARTS)).alias("part"))
    for group in (("lang", "part"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("draw", "id"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= docs_per_language).drop("place")
    chosen = chosen.select("id", F.col("lang").alias("of")).distinct()
    texts = labelled.join(F.broadcast(chosen), (F.col("lang") == F.col("of")) & (labelled["id"] == chosen["id"]), "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for first, stop, symbols, bounds in _pieces(batch.column(1)):
                grams = symbols.astype(np.int64)
                starts = bounds[:-1]
                for back in range(1, order + 1):
                    grams |= _shifted(symbols, starts, back).astype(np.int64) << (8 * back)
                owner = np.repeat(np.arange(stop - first), np.diff(bounds))
                own = langs[first:stop]
                for lang in sorted(set(own)):
                    seen, n = np.unique(grams[(own == lang)[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class ContextModel:
    """All languages' trees over one set of contexts; context 1 is the empty one."""

    languages: list[str]
    order: int
    index: np.ndarray  # byte -> dense symbol
    children: np.ndarray  # (context, symbol before it) -> longer context, 0 if none
    bits: np.ndarray  # (context * symbols + symbol, language) code length

    def code_lengths(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        width = self.children.shape[1]
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        if len(symbols) == 0:
            return out
        flat = self.children.ravel()
        for a in range(0, len(symbols), SLICE):
            low, b = max(0, a - self.order), min(len(symbols), a + SLICE)
            part = symbols[low:b]
            starts = bounds[np.searchsorted(bounds, low - self.order) : np.searchsorted(bounds, b)] - low
            best = here = np.ones(len(part), dtype=np.int32)
            for back in range(1, self.order + 1):
                here = flat[here * width + self.index[_shifted(part, starts, back)]]
                best = np.where(here > 0, here, best)
            costs = self.bits[(best * width + self.index[part])[a - low :]]
            first, last = np.searchsorted(bounds, [a, b - 1], side="right") - 1
            begin = np.append(np.maximum(bounds[first : last + 1], a), b) - a
            filled = np.flatnonzero(np.diff(begin))
            out[first + filled] += np.add.reduceat(costs, begin[filled], axis=0, dtype=np.float64)
        return out


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, max_cells: int = 1 << 23) -> ContextModel:
    """``counts``: language -> (grams of order + 1 bytes, how often)."""
    languages = sorted(counts, key=lambda s: s.encode())
    seen = np.zeros(256, dtype=bool)
    seen[32] = True
    for grams, _ in counts.values():
        seen[np.unique(grams & 255)] = True
    symbols = np.flatnonzero(seen)
    width = len(symbols) + 1  # the last one stands for bytes never seen
    index = np.full(256, width - 1, dtype=np.int32)
    index[symbols] = np.arange(len(symbols))
    room = max(1, max_cells // (width * max(1, len(languages))) - 2)
    ranked: dict[tuple[int, int], float] = {}
    for grams, n in counts.values():
        total = n.sum()
        for length in range(1, order + 1):
            keys, where = np.unique((grams >> 8) & ((1 << (8 * length)) - 1), return_inverse=True)
            for key, share in zip(keys.tolist(), (np.bincount(where, n) / total).tolist(), strict=True):
                ranked[length, key] = max(ranked.get((length, key), 0.0), share)
    chosen = sorted(ranked, key=lambda c: (-ranked[c], c))[:room]
    number = {(0, 0): 1}
    for length, key in sorted(chosen):
        if (length - 1, key & ((1 << (8 * (length - 1))) - 1)) in number:
            number[length, key] = len(number) + 1
    size = len(number) + 1
    children = np.zeros((size, width), dtype=np.int32)
    parent = np.zeros(size, dtype=np.int64)
    for (length, key), node in number.items():
        if length:
            parent[node] = number[length - 1, key & ((1 << (8 * (length - 1))) - 1)]
            children[parent[node], index[key >> (8 * (length - 1))]] = node
    bits = np.zeros((size, width, len(languages)), dtype=np.float32)
    for k, lang in enumerate(languages):
        grams, n = counts[lang]
        probability = np.zeros((size, width))
        probability[0] = 1 / 256
        for length in range(order + 1):
            table = np.zeros((size, width))
            keys = (grams >> 8) & ((1 << (8 * length)) - 1)
            unique, where = np.unique(keys, return_inverse=True)
            nodes = np.array([number.get((length, key), 0) for key in unique.tolist()], dtype=np.int64)[where]
            np.add.at(table, (nodes, index[grams & 255]), n)
            at = np.array([node for (size_of, _), node in number.items() if size_of == length], dtype=np.int64)
            if not len(at):
                continue
            own = table[at]
            total, distinct = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
            below = probability[parent[at]]
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(own > 0, own / (total + distinct), distinct / (total + distinct) * below)
            probability[at] = np.where(total > 0, p, below)
        bits[:, :, k] = -np.log2(probability)
    return ContextModel(languages, order, index, children, bits.reshape(size * width, len(languages)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", folds: int = 4, fold: int = 2, docs_per_language: int = 400, order: int = ORDER) -> ContextModel:
    """A model from the documents that are not held out and have a language."""
    labelled = docs.where(F.col(id_column).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_column, folds, fold))
    labelled = labelled.select(F.col(id_column).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = sample_counts(labelled, docs_per_language, order).toArrow().to_pandas()
    if rows["lang"].nunique() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would not stay small")
    return fit({name: (part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for name, part in rows.groupby("lang")}, order)


def identify(docs: DataFrame, model: ContextModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its score to the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col("`" + name.replace("`", "``") + "`") for name in keep]
    kept = docs.select(*columns).schema
    names = [*kept.names, *out]

    width = len(kept)
    at = kept.names.index(text) if text in kept.names and kept[text].dataType.simpleString() == "string" else width + 1

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            letters = batch.column(width).to_pylist()
            for first, stop, symbols, bounds in _pieces(batch.column(at)):
                lengths = known.code_lengths(symbols, bounds)
                langs, scores = [], []
                for i in range(stop - first):
                    if not letters[first + i] or not known.languages:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        k = int(lengths[i].argmin())
                        langs.append(known.languages[k])
                        scores.append(float(1 / np.exp2(np.maximum(lengths[i][k] - lengths[i], -1000.0)).sum()))
                own = [c.slice(first, stop - first) for c in batch.columns[:width]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*kept.fields]).add(out[0], StringType()).add(out[1], DoubleType())
    has_letter = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    more = [has_letter.alias("__letter"), *([F.col(text).cast("string").alias("__text")] if at > width else [])]
    return docs.select(*columns, *more).mapInArrow(predict, schema)


def identify_languages(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on and applied to ``docs``."""
    found = identify(docs, train(docs, folds=folds, fold=fold))
    return found.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all their columns."""
    found = identify(docs, train(docs, **options), keep=tuple(docs.columns), out=("__lang_pred", "__score"))
    return found.where(F.col("__lang_pred") != UNKNOWN).drop("__lang_pred", "__score")
