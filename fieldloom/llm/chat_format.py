"""Chat formatting: recovering the turns of a transcript.

A hidden Markov model reads a conversation's lines.  Its states are the three
roles, each beginning or going on; what it sees of a line is a speaker marker
(``User:``, ``### Assistant:``, ``Q:``, ``> ``, ...), a blank line or neither,
whether a question or a long line follows, and whether a quotation just ended.
The most likely states (Viterbi) give the turns, which are rendered alike.

The model is counted from lines whose states are known (``fit``): how often a
conversation starts in a state, a state follows another, and a state shows each
thing seen, all with one added.  Without such
lines the model is that of the tables below.

A long conversation is cut into blocks of ``BLOCK_LINES`` lines.  A block is
summed up by the best score from each state before it to each state at its end;
the blocks' tables are chained, and then every block is decoded between the
states that the chain went through.  The result is that of one pass over the
whole conversation.  A Python task holds one block of lines, or one small table
for each block; numbering the lines streams through a sort.

Edge cases: a null line is blank; a conversation of blank lines has one turn;
lines with one number are ordered by their text; a null conversation id is a
conversation; an empty table gives no turns; other columns are ignored.  Of
``as_transcript``: rows with a null turn come last; rows with one conversation
and turn follow each other whole, in the order of a hash of role and text, and
equal rows as often as they occur; a null or unknown role is the user's.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
BLOCK_LINES = 1024
# Words that name a speaker.
SPEAKERS = {"system": ("system", "instruction", "instructions", "context"), "user": ("user", "human", "q", "question", "prompt", "customer", "student", "me"), "assistant": ("assistant", "ai", "bot", "a", "answer", "response", "model", "agent", "tutor")}
MARKER = r"(?is)^\s*(?:#{1,6}\s*|\*\*|\[|<\|?)?\s*(" + "|".join(w for words in SPEAKERS.values() for w in words) + r")\s*(?:\|?>|\]|\*\*)?\s*:(?:\*\*)?[ \t]*"
QUOTE = r"^>[ \t]?"

# What is seen of a line: nothing, a role's marker, a quotation, a blank line, plain text after a quotation.
PLAIN, SYSTEM, USER, ASSISTANT, QUOTED, BLANK, AFTER_QUOTE = range(7)
# States: a role begins (0, 1, 2) or goes on (3, 4, 5).  Fixed values: the model without counts.
START = (0.15, 0.70, 0.13, 0.006, 0.007, 0.007)
MOVES = (
    (0.01, 0.44, 0.05, 0.50, 0.0, 0.0),
    (0.01, 0.04, 0.45, 0.0, 0.50, 0.0),
    (0.01, 0.36, 0.03, 0.0, 0.0, 0.60),
    (0.01, 0.44, 0.05, 0.50, 0.0, 0.0),
    (0.01, 0.04, 0.45, 0.0, 0.50, 0.0),
    (0.01, 0.36, 0.03, 0.0, 0.0, 0.60),
)
SEEN = (
    (0.050, 0.900, 0.002, 0.002, 0.020, 0.005, 0.021),
    (0.040, 0.002, 0.850, 0.002, 0.080, 0.005, 0.021),
    (0.040, 0.002, 0.002, 0.850, 0.010, 0.005, 0.091),
    (0.840, 0.004, 0.004, 0.004, 0.020, 0.120, 0.008),
    (0.700, 0.004, 0.004, 0.004, 0.160, 0.120, 0.008),
    (0.840, 0.004, 0.004, 0.004, 0.020, 0.120, 0.008),
)
QUESTION = (0.10, 0.35, 0.10, 0.10, 0.30, 0.12)
LONG = (0.40, 0.25, 0.55, 0.45, 0.30, 0.55)


def _logs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and move scores, and the score of each state for what is seen."""
    with np.errstate(divide="ignore"):
        start, moves, seen = (np.log(np.array(x)) for x in (START, MOVES, SEEN))
        extra = np.zeros((4, 6))
        for question, long in itertools.product((0, 1), (0, 1)):
            q, w = np.array(QUESTION), np.array(LONG)
            extra[question * 2 + long] = np.log(q if question else 1 - q) + np.log(w if long else 1 - w)
    return start, moves, (seen.T[:, None, :] + extra[None, :, :]).reshape(28, 6)


@dataclass(frozen=True)
class Model:
    """Log probabilities: of states at the start, of moves, and of what is seen in each state."""

    start: np.ndarray
    moves: np.ndarray
    scores: np.ndarray  # (seen, state)

    @staticmethod
    def of(starts: np.ndarray, moves: np.ndarray, seen: np.ndarray) -> Model:
        """From counts, to each of which one is added if it can occur."""
        before, after = np.arange(6)[:, None], np.arange(6)[None, :]
        able = (after < len(ROLES)) | (after % len(ROLES) == before % len(ROLES))  # only the same role goes on
        with np.errstate(divide="ignore"):
            share = lambda counts, axis: np.log(counts / counts.sum(axis=axis, keepdims=True))
            return Model(share(starts + 1.0, 0), share((moves + 1.0) * able, 1), share(seen + 1.0, 0))


def observed(lines: DataFrame, order: Window) -> DataFrame:
    """Adds ``seen`` (0 to 27) and ``body``, the line without its marker."""
    line = F.coalesce(F.col("line"), F.lit(""))
    word = F.lower(F.regexp_extract(line, MARKER, 1))
    quoted = line.rlike(QUOTE)
    role = F.when(word.isin(*SPEAKERS["system"]), SYSTEM).when(word.isin(*SPEAKERS["user"]), USER).when(word.isin(*SPEAKERS["assistant"]), ASSISTANT)
    kind = F.coalesce(role, F.when(quoted, QUOTED).when(F.trim(line) == "", BLANK))
    body = F.when(role.isNotNull(), F.regexp_replace(line, MARKER, "")).when(quoted, F.regexp_replace(line, QUOTE, "")).otherwise(line)
    kinds = lines.withColumn("kind", kind).withColumn("body", body).withColumn("__before", F.lag("kind").over(order))
    full = F.coalesce("kind", F.when(F.col("__before") == QUOTED, AFTER_QUOTE).otherwise(PLAIN))
    seen = full * 4 + F.col("body").rlike(r"\?\s*$").cast("int") * 2 + (F.length("body") > 80).cast("int")
    return kinds.withColumn("seen", seen.cast("int")).drop("kind", "__before")


def _through(seen: np.ndarray, moves: np.ndarray, scores: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """Best score from each state before the lines to each state at their end.

    With ``first`` (start scores) there is one state before: the conversation's begin.
    """
    table = first[None, :] + scores[seen[0]] if first is not None else moves + scores[seen[0]]
    for s in seen[1:]:
        table = (table[:, :, None] + moves[None, :, :]).max(axis=1) + scores[s]
    return table


def decode(seen: np.ndarray, before: int | None = None, last: int | None = None, model: Model | None = None) -> np.ndarray:
    """The most likely states of some lines, between given states."""
    start, moves, scores = (model.start, model.moves, model.scores) if model else _logs()
    best = (start if before is None else moves[before]) + scores[seen[0]]
    back = np.zeros((len(seen), 6), dtype=np.int8)
    for t, s in enumerate(seen[1:], 1):
        ways = best[:, None] + moves
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[s]
    out = np.zeros(len(seen), dtype=np.int32)
    out[-1] = int(best.argmax()) if last is None else last
    for t in range(len(seen) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def fit(labelled: DataFrame) -> Model:
    """The model of ``labelled``: conv_id, line_no, line, state.  Only its counts leave the tasks."""
    conversation = Window.partitionBy("conv_id").orderBy("line_no", "line")
    known = observed(labelled.select("conv_id", "line_no", F.col("line").cast("string").alias("line"), "state"), conversation).select(F.lag("state").over(conversation).alias("before"), "state", "seen")
    starts, moves, seen = np.zeros(6), np.zeros((6, 6)), np.zeros((28, 6))
    counted = known.groupBy("before", "state", "seen").agg(F.count("*").alias("n"))
    for r in counted.toLocalIterator():  # at most 7 * 6 * 28 rows
        if r.before is None:
            starts[r.state] += r.n
        else:
            moves[r.before, r.state] += r.n
        seen[r.seen, r.state] += r.n
    return Model.of(starts, moves, seen)


def parse_transcripts(lines: DataFrame, model: Model | None = None) -> DataFrame:
    """``lines``: conv_id, line_no, line.  Returns conv_id, turn, role, text, n_lines, rendered."""
    model = model or Model(*_logs())
    conversation = Window.partitionBy("conv_id").orderBy("line_no", "line")
    kind = lines.schema["conv_id"].dataType.simpleString()
    numbered = observed(lines.select("conv_id", "line_no", F.col("line").cast("string").alias("line")), conversation).withColumn("at", F.row_number().over(conversation) - 1).withColumn("block", F.floor(F.col("at") / BLOCK_LINES).cast("int"))

    def in_order(table: pa.Table, *columns: str) -> pa.Table:
        return table.sort_by([(c, "ascending") for c in columns])

    def sum_up(table: pa.Table) -> pa.Table:
        table = in_order(table, "at")
        block = table["block"][0].as_py()
        through = _through(table["seen"].to_numpy(), model.moves, model.scores, model.start if block == 0 else None)
        return pa.table({"conv_id": table["conv_id"].slice(0, 1), "block": pa.array([block], pa.int32()), "through": pa.array([through.tobytes()], pa.binary())})

    def chain(table: pa.Table) -> pa.Table:
        table = in_order(table, "block")
        tables = [np.frombuffer(x.as_py()).reshape(-1, 6) for x in table["through"]]
        best, back = tables[0][0], []
        for t in tables[1:]:
            ways = best[:, None] + t
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0)
        ends = [int(best.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pa.table({"conv_id": table["conv_id"], "block": table["block"], "before": pa.array([None, *ends[:-1]], pa.int32()), "last": pa.array(ends, pa.int32())})

    def in_block(table: pa.Table) -> pa.Table:
        table = in_order(table, "at")
        states = decode(table["seen"].to_numpy(), table["before"][0].as_py(), table["last"][0].as_py(), model)
        return pa.table({"conv_id": table["conv_id"], "at": table["at"], "body": table["body"], "state": pa.array(states, pa.int32())})

    summed = numbered.select("conv_id", "block", "at", "seen").groupBy("conv_id", "block").applyInArrow(sum_up, f"conv_id {kind}, block int, through binary")
    chained = summed.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, block int, before int, last int")
    met = numbered.alias("l").join(chained.alias("c"), F.col("l.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("l.block") == F.col("c.block"))).select("l.conv_id", "l.block", "l.at", "l.seen", "l.body", "c.before", "c.last")
    decoded = met.groupBy("conv_id", "block").applyInArrow(in_block, f"conv_id {kind}, at int, body string, state int")
    begins = (F.col("state") < len(ROLES)) | (F.col("at") == 0)
    turns = decoded.withColumn("turn", F.sum(begins.cast("int")).over(Window.partitionBy("conv_id").orderBy("at")) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.min_by("state", "at") % len(ROLES) + 1).cast("int"))
    whole = turns.groupBy("conv_id", "turn").agg(role.alias("role"), F.trim(text, F.lit(" \n\t\r")).alias("text"), F.count("*").alias("n_lines"))
    return whole.select("conv_id", "turn", "role", "text", "n_lines", render(F.col("role"), F.col("text")).alias("rendered"))


def render(role: Column, text: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def labelled_lines(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) written as the lines of a transcript, with the state of each.

    The way speakers are marked goes by a hash of the conversation: names,
    headings, letters, or quotation for the user and nothing for the assistant.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    name = F.initcap(role)
    letter = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("Context")
    text = F.coalesce("text", F.lit(""))
    quoted = F.when(role == "user", F.regexp_replace(text, r"(?m)^", "> ")).when(role == "assistant", text).otherwise(F.concat(F.lit("System: "), text))
    written = F.when(style == 0, F.concat(name, F.lit(": "), text)).when(style == 1, F.concat(F.lit("### "), name, F.lit(":\n"), text)).when(style == 2, F.concat(letter, F.lit(": "), text)).otherwise(quoted)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    number = F.create_map(*[F.lit(x) for pair in zip(ROLES, range(len(ROLES)), strict=True) for x in pair])[role]
    each = counted.select("conv_id", "turn", number.alias("role_no"), F.xxhash64("role", "text").alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"), F.split(written, "\n").alias("lines"))
    split = each.select("conv_id", "turn", "role_no", "row", "copy", F.posexplode("lines").alias("k", "line"))
    place = F.struct(F.col("turn").isNull().alias("unset"), "turn", "row", "copy", "k")
    return split.select("conv_id", place.alias("line_no"), "line", (F.col("role_no") + F.when(F.col("k") > 0, len(ROLES)).otherwise(0)).cast("int").alias("state"))


def as_transcript(conversations: DataFrame) -> DataFrame:
    """As ``labelled_lines``, without the states."""
    return labelled_lines(conversations).drop("state")


def format_conversations(conversations: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Writes all conversations as transcripts and recovers their turns.

    The model is counted from the conversations whose crc32(conv_id as text)
    doesn't leave ``fold``; adds held_out for the others.
    """
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    model = fit(labelled_lines(conversations.where(~held_out)))
    return parse_transcripts(as_transcript(conversations), model).withColumn("held_out", held_out)
