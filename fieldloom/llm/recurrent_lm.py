"""A gated recurrent language model that scores whole documents.

Counting: every training word is counted with Spark.  The ``TABLE_WORDS`` most
frequent words go to all tasks as a table of fixed size; the rarer ones, whose
number grows with the corpus, are joined.

Model: a gated recurrent unit over the ``MODEL_WORDS`` most frequent words, the
end token and a token for all other words.  The output is factored: words are
put in classes of equal size by frequency, and a word's probability is that of
its class times its own within the class.  Any other word has the probability
of the shared token times its share of the counts (plus one) of those words;
unseen words have one share in all.

Training: truncated backpropagation through ``STEPS`` words with the state
carried on from window to window and cleared at each document's start.  A first
model learns from a few documents (about ``SEED_DOCS`` at most, however large
the corpus); then all trainers continue from it, each on its part of all
training documents, and their parameters are averaged by the number of words
seen.  Their number goes by that of the words, so that the scores don't change
with the number of partitions.

Scoring: documents of a batch run in step, longest first, with the state
carried across windows to the end of each document.

Edge cases: a null or empty text is its end token alone; a null id is not held
out; without training documents N and V are 0 and the model is the untrained
one; rows that repeat an id and text are scored alike and count as often as
they occur in training; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.words import SPACED_LOWER, chunks
from fieldloom.sources.staging import checkpointed

TABLE_WORDS = 1 << 19
MODEL_WORDS = 4094  # with the end token and the token for other words, 64 classes of 64
HIDDEN = 24
CLASS_SIZE = 64
STEPS = 16
STREAMS = (32, 512)  # as many as leave a chunk WINDOWS windows
WINDOWS = 64
SCORE_ROWS = 1 << 16
BLOCK = 1024  # rows of logits at a time, to stay in the processor's cache
SEED_DOCS = 512
TRAINER_WORDS = 1 << 21
MOST_TRAINERS = 4096
#: Words that a trainer's streams share out at a time.
LEARN_WORDS = 1 << 19
PIECES = 16
CHUNK = 1 << 22
#: Bytes of text that are scored in step: the more documents, the fewer steps.
SCORE_CHUNK = 1 << 24
#: Places of the table in which most words are found at once.
SLOTS = 1 << 20
#: The end token's place among word hashes: no word is hashed to it but by chance.
END = np.uint64(0x9D39247E33776D41)
LN10 = float(np.log(10.0))


def held_out(id_column: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Parameters:
    """Weights by name; 32-bit floats."""

    values: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(words: int, hidden: int = HIDDEN, seed: int = 5) -> Parameters:
        rng = np.random.default_rng(seed)
        classes = words // CLASS_SIZE
        scale = 1 / np.sqrt(hidden)
        draw = lambda *shape: rng.normal(0, scale, shape).astype(np.float32)
        return Parameters({"X": draw(words, 3 * hidden), "U": draw(hidden, 3 * hidden), "C": draw(hidden, classes), "c": np.zeros(classes, np.float32), "V": draw(words, hidden), "v": np.zeros(words, np.float32)})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.values[k].ravel() for k in sorted(self.values)])

    def like(self, flat: np.ndarray) -> Parameters:
        out, at = {}, 0
        for k in sorted(self.values):
            n = self.values[k].size
            out[k] = flat[at : at + n].reshape(self.values[k].shape).astype(np.float32)
            at += n
        return Parameters(out)


def _step(p: dict, h: np.ndarray, x: np.ndarray):
    n = h.shape[1]
    u = h @ p["U"]
    gates = x[:, : 2 * n] + u[:, : 2 * n]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r, u = (np.ascontiguousarray(a) for a in (gates[:, :n], gates[:, n:], u[:, 2 * n :]))
    new = r * u
    new += x[:, 2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= z
    out += new
    return out, z, r, new, u


def _softmax(a: np.ndarray) -> np.ndarray:
    """The softmax of each row; overwrites ``a``."""
    if len(a) and max(a.max(), -a.min()) > 60:
        a -= a.max(axis=1, keepdims=True)
    np.exp(a, out=a)
    a *= np.reciprocal(a @ np.ones(a.shape[1], a.dtype))[:, None]
    return a


def _errors(logits: np.ndarray, at: np.ndarray, share: int) -> np.ndarray:
    """The softmax of each row less one at its place, over ``share``; overwrites ``logits``."""
    q = _softmax(logits)
    q[np.arange(len(at)), at] -= 1
    q /= share
    return q


def _picked_log_softmax(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of one place of each row; overwrites ``a``."""
    if len(a) and a.max() > 60:
        a -= a.max(axis=1, keepdims=True)
    picked = a[np.arange(len(a)), at]
    np.exp(a, out=a)
    return picked - np.log(a @ np.ones(a.shape[1], a.dtype))


def log_probabilities(p: dict, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log probability of each id after its state."""
    of = (ids // CLASS_SIZE).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    h, words = h.take(order, axis=0), ids[order]
    bounds = np.searchsorted(of[order], np.arange(len(p["c"]) + 1))
    of = of[order]
    found = np.empty(len(ids), dtype=h.dtype)
    for a in range(0, len(ids), BLOCK):
        logits = h[a : a + BLOCK] @ p["C"]
        logits += p["c"]
        found[a : a + BLOCK] = _picked_log_softmax(logits, of[a : a + BLOCK])
    for k in np.flatnonzero(np.diff(bounds)):
        rows = slice(k * CLASS_SIZE, (k + 1) * CLASS_SIZE)
        for a in range(bounds[k], bounds[k + 1], BLOCK):
            at = slice(a, min(a + BLOCK, bounds[k + 1]))
            logits = h[at] @ p["V"][rows].T
            logits += p["v"][rows]
            found[at] += _picked_log_softmax(logits, words[at] - k * CLASS_SIZE)
    out = np.empty(len(ids))
    out[order] = found
    return out


def score_documents(p: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each document; ids ``first[i] : first[i + 1]``, each with its end."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    total = np.zeros(len(order))
    h = np.zeros((len(order), p["U"].shape[0]), dtype=np.float32)
    longest = int(lengths[0]) if len(lengths) else 0
    live_at = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()  # documents longer than t
    t = 0
    while t < longest:
        states, words, owners = [], [], []
        rows = 0
        while t < longest and rows < SCORE_ROWS:
            live = live_at[t]
            word = ids.take(begin[:live] + t)
            h = h[:live]
            states.append(h)
            words.append(word)
            owners.append(live)
            h = _step(p, h, p["X"].take(word, axis=0))[0]
            rows, t = rows + live, t + 1
        log_p = log_probabilities(p, np.concatenate(states), np.concatenate(words))
        at = 0
        for live in owners:
            total[:live] += log_p[at : at + live]
            at += live
    out = np.zeros(len(order))
    out[order] = total
    return out


class Trainer:
    """Truncated backpropagation with Adagrad over parallel streams of documents."""

    def __init__(self, parameters: Parameters, rate: float = 0.15):
        self.p = {k: v.copy() for k, v in parameters.values.items()}
        self.sums = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        self.rate, self.seen = rate, 0

    def learn(self, ids: np.ndarray, starts: np.ndarray, share: int | None = None) -> None:
        """One pass over ``ids``, to the last; ``starts`` says where documents begin.

        What the streams leave over weighs no more than it would as part of
        ``share`` streams.
        """
        if not len(ids):
            return
        low, high = STREAMS
        streams = max(1, min(low, len(ids) // (STEPS + 1)), min(high, len(ids) // (STEPS * WINDOWS)))
        length = len(ids) // streams
        words = ids[: streams * length].reshape(streams, length).T
        opens = np.zeros(len(ids), dtype=bool)
        opens[starts] = True
        opens = opens[: streams * length].reshape(streams, length).T.copy()
        opens[0] = True
        h = np.zeros((streams, self.p["U"].shape[0]), dtype=np.float32)
        last = None
        for t in range(0, length, STEPS):
            h, last = self.window(h, last, words[t : t + STEPS], opens[t : t + STEPS], share)
        self.seen += streams * length
        self.learn(ids[streams * length :], starts[starts >= streams * length] - streams * length, share or streams)

    def window(self, h: np.ndarray, last, words: np.ndarray, opens: np.ndarray, share: int | None = None):
        """Predict ``words`` in turn; ``last`` holds the words before the first."""
        p, n, (steps, streams) = self.p, h.shape[1], words.shape
        kept, states = [], []
        for t in range(steps):
            before = words[t - 1] if t else last
            clear = (~opens[t])[:, None].astype(np.float32)
            if before is None:
                kept.append((clear, None))
                h = h * clear
            else:
                old = h
                h, z, r, new, u = _step(p, old, p["X"].take(before, axis=0))
                kept.append((clear, (before, old, z, r, new, u)))
                h = h * clear
            states.append(h)
        flat_h, flat_w = np.concatenate(states), words.ravel()
        grads = {k: np.zeros_like(p[k]) for k in ("C", "c", "U", "V", "v")}
        of = (flat_w // CLASS_SIZE).astype(np.uint16)
        d_h, ones = np.empty_like(flat_h), np.ones(BLOCK, flat_h.dtype)
        for a in range(0, len(of), BLOCK):
            own = flat_h[a : a + BLOCK]
            q = _errors(own @ p["C"] + p["c"], of[a : a + BLOCK], share or streams)
            grads["C"] += own.T @ q
            grads["c"] += ones[: len(q)] @ q
            d_h[a : a + BLOCK] = q @ p["C"].T
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(len(p["c"]) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            rows = slice(k * CLASS_SIZE, (k + 1) * CLASS_SIZE)
            out, bias, d_out, d_bias = p["V"][rows], p["v"][rows], grads["V"][rows], grads["v"][rows]
            for a in range(bounds[k], bounds[k + 1], BLOCK):
                at = order[a : min(a + BLOCK, bounds[k + 1])]
                own = flat_h.take(at, axis=0)
                q = _errors(own @ out.T + bias, flat_w[at] - k * CLASS_SIZE, share or streams)
                d_h[at] += q @ out
                d_out += q.T @ own
                d_bias += ones[: len(q)] @ q
        d_h = d_h.reshape(steps, streams, n)
        carry = np.zeros_like(h)
        inputs, deltas = [], []
        for t in range(steps - 1, -1, -1):
            clear, cell = kept[t]
            d = (d_h[t] + carry) * clear
            if cell is None:
                carry = np.zeros_like(h)
                continue
            before, old, z, r, new, u = cell
            keep = d * z
            d_new = (d - keep) * (1 - new * new)
            d_z = keep * (old - new)
            d_z *= 1 - z
            d_ur = d_new * r
            d_r = d_ur * u
            d_r *= 1 - r
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            inputs.append(before)
            deltas.append(d_x)
            d_u = d_x.copy()
            d_u[:, 2 * n :] = d_ur
            grads["U"] += old.T @ d_u
            carry = d_u @ p["U"].T
            carry += keep
        if inputs:
            met, stacked = np.concatenate(inputs).astype(np.uint16), np.concatenate(deltas)
            by = np.argsort(met, kind="stable")
            begin = np.flatnonzero(np.diff(met[by].astype(np.int32), prepend=-1))
            self._move("X", np.add.reduceat(stacked.take(by, axis=0), begin, axis=0), met[by[begin]])
        for k in grads:
            self._move(k, grads[k], slice(None))
        return h, words[-1]

    def _move(self, name: str, grad: np.ndarray, rows) -> None:
        grad = np.minimum(np.maximum(grad, -1), 1)
        sums = self.sums[name][rows] + grad * grad
        self.sums[name][rows] = sums
        grad *= self.rate
        grad /= np.sqrt(sums)
        self.p[name][rows] -= grad


@dataclass
class Lexicon:
    """The most frequent words by hash, with counts and model ids."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    ids: np.ndarray
    tokens: int  # N
    types: int  # V
    other: int  # id of the token for all other words
    end: int
    other_mass: int  # counts plus one of the words outside the model, plus one share for unseen ones
    slots: np.ndarray | None = None  # made by each task's own copy

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and whether the words are there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        if self.slots is None:  # the most frequent of the words with equal last bits has the slot
            by_count = np.argsort(-self.counts, kind="stable")
            slots, first = np.unique(self.hashes[by_count] & np.uint64(SLOTS - 1), return_index=True)
            self.slots = np.zeros(SLOTS, dtype=np.int32)
            self.slots[slots.astype(np.int64)] = by_count[first]
        at = self.slots.take((hashes & np.uint64(SLOTS - 1)).astype(np.int64))
        known = self.hashes.take(at) == hashes
        rest = np.flatnonzero(~known)
        if len(rest):
            wanted = hashes[rest]
            place = np.searchsorted(self.hashes, wanted)
            place[place == len(self.hashes)] = 0
            at[rest], known[rest] = place, self.hashes[place] == wanted
        return at, known


def with_ends(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words, each followed by the end token."""
    n = len(first) - 1
    out = np.full(len(hashes) + n, END, dtype=np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(first))] = hashes
    return out, first + np.arange(n + 1)


def count_words(texts: DataFrame) -> DataFrame:
    """(token, n) over a table with one text column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0), SPACED_LOWER, size=CHUNK):
                seen, n = np.unique(with_ends(c.hashes, c.first)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return texts.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def build_lexicon(counts: DataFrame) -> Lexicon:
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(TABLE_WORDS).toArrow()
    hashes, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    rank = np.lexsort((hashes, -n))
    hashes, n = hashes[rank], n[rank]
    chosen = np.flatnonzero(hashes != END)[:MODEL_WORDS]
    end, other = MODEL_WORDS, MODEL_WORDS + 1
    ids = np.full(len(hashes), other, dtype=np.int32)
    ids[chosen] = np.arange(len(chosen))
    ids[hashes == END] = end
    inside = ids != other
    mass = int(totals.tokens - n[inside].sum()) + int(totals.types - inside.sum()) + 1
    order = np.argsort(hashes)
    # the model's ids go by frequency, and so do its classes; the end and the shared token are in the last one
    return Lexicon(hashes[order], n[order], ids[order], int(totals.tokens), int(totals.types), other, end, mass)


def _ids(lexicon: Lexicon, hashes: np.ndarray) -> np.ndarray:
    at, known = lexicon.find(hashes)
    ids = np.full(len(hashes), lexicon.other, dtype=np.int32)
    ids[known] = lexicon.ids[at[known]]
    ids[hashes == END] = lexicon.end
    return ids


def _in_chunks(documents: Iterator[tuple[np.ndarray, np.ndarray]], words: int = LEARN_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The documents (ids, starts and end) in pieces of ``words`` or just more, however they came."""
    held, ends, size = [], [0], 0
    for ids, first in documents:
        at = 0  # the first document not yet taken
        while at < len(first) - 1:
            stop = min(len(first) - 1, at + 1 + int(np.searchsorted(first[at + 1 :], first[at] + words - size)))
            held.append(ids[first[at] : first[stop]])
            ends += (first[at + 1 : stop + 1] - first[at] + size).tolist()
            size, at = ends[-1], stop
            if size >= words:
                yield np.concatenate(held), np.array(ends)
                held, ends, size = [], [0], 0
    if size:
        yield np.concatenate(held), np.array(ends)


def train(texts: DataFrame, lexicon, start: Parameters, parts: int) -> Parameters:
    """One pass from ``start`` by each trainer, averaged by words seen.

    There is one trainer for ``TRAINER_WORDS`` of the corpus (``MOST_TRAINERS``
    at most), or one in all if ``parts`` is 1.  What a trainer learns from, and
    in which order, goes by the rows' hash alone: so does the result, whatever
    the number of ``parts`` that the trainers are dealt to.
    """
    begin = texts.sparkSession.sparkContext.broadcast(start)
    trainers = 1 if parts == 1 else min(MOST_TRAINERS, max(1, -(-lexicon.value.tokens // TRAINER_WORDS)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[tuple[int, pa.Array]]:
            for batch in batches:
                of = batch.column(0).to_numpy()
                bounds = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
                for a, b in itertools.pairwise(bounds):
                    yield int(of[a]), batch.column(1).slice(a, b - a)

        def documents(group) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for _, rows in group:
                for c in chunks(rows, SPACED_LOWER, size=CHUNK):
                    hashes, first = with_ends(c.hashes, c.first)
                    yield _ids(lexicon.value, hashes), first

        for of, group in itertools.groupby(slices(), key=lambda x: x[0]):
            trainer = Trainer(begin.value)
            for ids, first in _in_chunks(documents(group)):
                trainer.learn(ids, first[:-1])
            pieces = np.array_split(Parameters(trainer.p).flat(), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([of] * PIECES, pa.int32()), pa.array([trainer.seen] * PIECES, pa.int64()), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "trainer", "seen", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, seen, weights in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                value = np.frombuffer(weights, dtype=np.float32).astype(np.float64) * seen
                old = sums.get(piece)
                sums[piece] = [old[0] + seen, old[1] + value] if old else [seen, value]
        if sums:
            k = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.nulls(k, pa.int32()), pa.array([s for s, _ in sums.values()], pa.int64()), pa.array([(v / s).astype(np.float32).tobytes() for s, v in sums.values()], pa.binary())], ["piece", "trainer", "seen", "weights"])

    shape = "piece int, trainer int, seen long, weights binary"
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(trainers)).cast("int").alias("trainer"), F.xxhash64("text", "doc_id").alias("place"), "text")
    learned = dealt.repartition(parts, "trainer").sortWithinPartitions("trainer", "place", "text").select("trainer", "text").mapInArrow(learn, shape)
    rows = learned.repartition(PIECES, "piece").sortWithinPartitions("piece", "trainer").mapInArrow(average, shape).toArrow().to_pydict()
    if not rows["piece"]:
        return start
    return start.like(np.concatenate([np.frombuffer(w, dtype=np.float32) for _, w in sorted(zip(rows["piece"], rows["weights"], strict=True))]))


def score_corpus(docs: DataFrame, folds: int = 7, fold: int = 2, share: float = 1.0, seed_docs_share: float = 0.002) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = held_out("doc_id", folds, fold)
    training = docs.where(~out).select("doc_id", F.col("text").cast("string").alias("text"))
    counts = checkpointed(count_words(training.select("text")))
    lexicon = build_lexicon(counts)
    shared = spark.sparkContext.broadcast(lexicon)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lm"), "text"), F.lit(1 << 40)) / (1 << 40)
    documents = int(lexicon.counts[lexicon.hashes == END].sum())  # each has one end
    start = train(training.where(draw < min(seed_docs_share, SEED_DOCS / max(1, documents))), shared, Parameters.fresh(MODEL_WORDS + 2), 1)
    model = train(training.where(draw < share), shared, start, parts)
    weights = spark.sparkContext.broadcast(model)
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("row_key"), F.col("text").cast("string").alias("text"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1), SPACED_LOWER, size=CHUNK):
                _, known = shared.value.find(c.hashes)
                at = np.flatnonzero(~known)
                owner = keys[c.row + np.searchsorted(c.first, at, side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(c.hashes[at].view(np.int64))], ["row_key", "token"])

    times = keyed.groupBy("row_key").agg(F.count("*").alias("times"))  # equal rows repeat their words
    rows = keyed.mapInArrow(rare, "row_key long, token long")
    met = rows.join(counts, "token", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    rare_sums = met.groupBy("row_key").agg(F.sum(F.log10((n + 1) / F.lit(float(lexicon.tokens + lexicon.types + 1)))).alias("rare_base"), F.sum(F.log10((n + 1) / F.lit(float(lexicon.other_mass)))).alias("rare_share"), F.sum((n > 0).cast("long")).alias("rare_known"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, lex = weights.value.values, shared.value
        scale = float(lex.tokens + lex.types + 1)
        for batch in batches:
            for c in chunks(batch.column(3), SPACED_LOWER, size=SCORE_CHUNK):
                hashes, first = with_ends(c.hashes, c.first)
                at, known = lex.find(hashes)
                ids = np.full(len(hashes), lex.other, dtype=np.int32)
                ids[known] = lex.ids[at[known]]
                ids[hashes == END] = lex.end
                count = np.where(known, lex.counts[at] if len(lex.counts) else 0, 0).astype(np.float64)
                here = known | (hashes == END)  # the others are joined
                base = np.where(here, np.log10((count + 1) / scale), 0.0)
                share_of = np.where(known & (ids == lex.other), np.log10((count + 1) / lex.other_mass), 0.0)
                add = lambda x, f=first: np.add.reduceat(x, f[:-1])
                value = score_documents(p, ids, first) / LN10 + add(share_of)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(c.row, c.n) for k in range(3)), pa.array(np.diff(first).astype(np.int64)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(value)], ["row_key", "doc_id", "held_out", "n_tokens", "known", "base", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select(key.alias("row_key"), "doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(score, f"row_key long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, value double")
    joined = scored.join(rare_sums.join(times, "row_key"), "row_key", "left")
    each = lambda name: F.coalesce(F.col(name) / F.col("times"), F.lit(0.0))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.round(each("rare_known")).cast("long")).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"), (F.col("base") + each("rare_base")).alias("base_score"), (F.col("value") + each("rare_share")).alias("score"))
