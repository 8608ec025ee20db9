"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers for insults, threats, targets, negation and reported speech
are composed into one machine.  It reads a clause word by word and tells, for
each insult or threat, the circumstances it stands in; what counts is that
label, with the weight its words learned, and not the word alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import received, send, tidy

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)

# Words of the grammar's closed classes, in English, German, French and Spanish.
THREATS = "kill hurt destroy shoot burn stab beat crush töten verletzen schlagen tuer tuer blesser frapper detruire matar herir golpear"
TARGETS = "you your yours he she him her they them this that these those du dich dir ihr euch sie diese dieser tu te toi vous ils elles ce cette usted ustedes ellos ellas este esta"
NEGATIONS = "not no never none neither nor cannot nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún"
REPORTS = "said says say told claims claimed wrote writes quoted alleged sagte sagt behauptet schrieb dit disait écrit prétend dijo dice escribió afirma"
CLOSED = {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws.split()}

LABELS = ("plain insult", "insult at a target", "negated insult", "reported insult", "threat at a target", "negated or reported threat")
MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
QUOTES, STOPS = frozenset("\"“”«»„"), frozenset(".!?;:\n")
#: A word is a letter and the letters and combining marks after it, the same where weights are learned and where texts are scored.
TOKEN = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*|[.!?;:\n]|[\"“”«»„]")
STEM = 5
FEATURES = 2 + len(LABELS)
BROADCAST_LABELS = 2_000_000
BROADCAST_UNITS = 200_000
HELD_UNITS = 200_000
UNITS = "__units"
RARE = -3.0


class Transducer:
    """A deterministic machine: ``step(state, word class) -> (state, output)``, from state 0."""

    def __init__(self, states: int, step) -> None:
        self.states = states
        self.table = [[step(s, c) for c in range(7)] for s in range(states)]


def window_after(word_class: int, words: int) -> Transducer:
    """Outputs 1 on the ``words`` words after one of ``word_class``."""
    return Transducer(words + 1, lambda s, c: (words if c == word_class else max(0, s - 1), int(s > 0)))


def rest_of_clause(word_class: int, toggle: int) -> Transducer:
    """Outputs 1 from a word of ``word_class`` to the clause's end, and between two marks of class ``toggle``."""
    def step(s, c):
        said, quoted = divmod(s, 2)
        if c == toggle:
            quoted = 1 - quoted
        elif c == word_class:
            said = 1
        return 2 * said + quoted, int(bool(said or quoted))

    return Transducer(4, step)


def accept(word_class: int) -> Transducer:
    """Outputs 1 on each word of ``word_class``."""
    return Transducer(1, lambda s, c: (0, int(c == word_class)))


def compose(*machines: Transducer):
    """The machine that runs all at once: transitions and joint outputs by (state, class), reachable states only."""
    start = (0,) * len(machines)
    number, queue = {start: 0}, [start]
    move, out = [], []
    for state in queue:
        row, outputs = [], []
        for c in range(7):
            each = [m.table[s][c] for m, s in zip(machines, state)]
            to = tuple(e[0] for e in each)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
            outputs.append(tuple(e[1] for e in each))
        move.append(row)
        out.append(outputs)
    return move, out


def label_of(insult: int, threat: int, near_target: int, negated: int, reported: int) -> int:
    """The grammar's rule for one word: its label, or -1."""
    if threat:
        return 5 if negated or reported else (4 if near_target else -1)
    if insult:
        return 3 if reported else 2 if negated else 1 if near_target else 0
    return -1


def grammar():
    """Transitions and labels of insult, threat, target, negation and reported speech composed.

    A target counts up to three words before an insult; a threat is scored at
    the target that follows it within four words, unless it is denied or told.
    """
    move, out = compose(
        accept(INSULT), window_after(THREAT, 4), window_after(TARGET, 3), window_after(NEGATION, 3), rest_of_clause(REPORT, QUOTE)
    )
    label = []
    for outputs in out:
        row = []
        for c, (insult, threatened, near, denied, told) in enumerate(outputs):
            row.append(label_of(insult, int(threatened and c == TARGET), near or c == TARGET, denied, told))
        label.append(row)
    return move, label


class Lexicon:
    """Documents per word and stem, toxic and clean, for units seen in toxic training documents."""

    def __init__(self, toxic: int, clean: int, counts: dict[str, tuple[int, int]], least: float) -> None:
        self.toxic, self.clean, self.counts, self.least = toxic, clean, counts, least

    def weight(self, unit: str, own: int | None = None) -> float:
        """Log-odds of a unit; with ``own``, the label of a training document, as if that document were not counted."""
        got = self.counts.get(unit)
        if got is None:
            return 0.0
        pos, neg = got
        toxic, clean = self.toxic, self.clean
        if own is not None:
            pos, neg, toxic, clean = pos - own, neg - (1 - own), toxic - own, clean - (1 - own)
        if pos < 1:
            return 0.0
        odds = float(np.log((pos + 0.1) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1)))
        return odds if odds >= self.least else 0.0

    def insult(self, word: str, own: int | None = None) -> float:
        return max(self.weight(word, own), self.weight(word[:STEM] + "*", own) if len(word) > STEM else 0.0)


def plain(text: str | None) -> str:
    """The text in composed form and lower case; null is empty."""
    return unicodedata.normalize("NFC", text or "").lower()


def units_of(text: str | None) -> set[str]:
    """The distinct words and stems of a text."""
    words = set(TOKEN.findall(plain(text))) - QUOTES - STOPS
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def matches(text: str, lexicon: Lexicon, move, label, own: int | None = None):
    """Clauses with something in them, as lists of (word, label, weight)."""
    known: dict[str, float] = {}
    state, clause, found = 0, [], []
    for token in TOKEN.findall(text):
        if token in QUOTES:
            state = move[state][QUOTE]
            continue
        if token in STOPS:
            state = 0
            if clause:
                found.append(clause)
                clause = []
            continue
        weight = known.get(token)
        if weight is None:
            weight = known[token] = lexicon.insult(token, own)
        c = INSULT if weight else CLOSED.get(token, OTHER)
        which = label[state][c]
        if which >= 0:
            clause.append((token, which, weight or 3.0))
        state = move[state][c]
    return [*found, clause] if clause else found


def features(text: str | None, lexicon: Lexicon, move, label, own: int | None = None) -> list[float]:
    """Weight of matched words per label (damped), strongest clause, and distinct matched words."""
    clauses = matches(plain(text), lexicon, move, label, own)
    sums, distinct, most = [0.0] * len(LABELS), {}, 0.0
    for clause in clauses:
        total = 0.0
        for word, which, weight in clause:
            sums[which] += weight
            total += weight if which in (0, 1, 4) else 0.3 * weight
            distinct[word] = weight
        most = max(most, total)
    return [*np.log1p(sums).tolist(), float(np.log1p(most)), float(np.log1p(sum(distinct.values())))]


class ToxicityModel:
    """Lexicon and coefficients; a lexicon too large to broadcast has its units in the table ``units`` instead."""

    def __init__(self, lexicon: Lexicon, coefficients: np.ndarray, units: DataFrame | None = None) -> None:
        self.lexicon, self.coefficients, self.units = lexicon, coefficients, units


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first coefficient, the intercept, is drawn to ``RARE``."""
    x = np.c_[np.ones(len(x)), x]
    rest = np.r_[RARE, np.zeros(x.shape[1] - 1)]
    beta, keep = rest.copy(), ridge * np.eye(x.shape[1])

    def loss(b):
        z = x @ b
        return np.logaddexp(0, z).sum() - y @ z + (b - rest) @ keep @ (b - rest) / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ (beta - rest))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return beta


@tidy
def _count_units(batches):
    """Toxic and clean documents per unit; the empty unit counts documents."""
    counts = Counter(), Counter()

    def held():
        units = list(counts[0] | counts[1])
        sums = [pa.array([count[u] for u in units], type=pa.int64()) for count in (counts[1], counts[0])]
        for count in counts:
            count.clear()
        return pa.RecordBatch.from_arrays([pa.array(units, type=pa.string()), *sums], names=["unit", "pos", "neg"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(units_of(text))
            counts[toxic][""] += 1
            if len(counts[0]) + len(counts[1]) > HELD_UNITS:
                yield held()
    yield held()


def _list_units(batches):
    for batch in batches:
        units = [list(units_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(units, type=pa.list_(pa.string()))], names=["_key", "units"])


def _with_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``rows`` with the entries of ``units`` that stand in their text, in column ``UNITS``.

    Texts meet their entries by a hash; should two texts share one, each has
    entries it never looks up.
    """
    key = F.xxhash64("text")
    each = rows.where("text IS NOT NULL").select(key.alias("_key"), "text").mapInArrow(_list_units, "_key long, units array<string>")
    entries = each.select("_key", F.explode("units").alias("unit")).distinct().join(units, "unit").groupBy("_key").agg(F.collect_list(F.struct("unit", "pos", "neg")).alias(UNITS))
    out = rows.select(F.struct("*").alias("_row"), key.alias("_text")).join(entries, F.col("_text") == F.col("_key"), "left")
    return out.select("_row.*", UNITS)


def _lexicons(lexicon: Lexicon, batch: pa.RecordBatch):
    """The lexicon of each row: that of all, or one of the row's own entries."""
    if UNITS not in batch.schema.names:
        return [lexicon] * batch.num_rows
    own = ({u["unit"]: (u["pos"], u["neg"]) for u in row or ()} for row in batch.column(UNITS).to_pylist())
    return [Lexicon(lexicon.toxic, lexicon.clean, counts, lexicon.least) for counts in own]


def _training_features(sent):
    def run(batches):
        lexicon = received(sent)
        move, label = grammar()
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            each = zip(batch.column("text").to_pylist(), _lexicons(lexicon, batch), toxic)
            rows = [features(t, lex, move, label, own) for t, lex, own in each]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, type=pa.list_(pa.float64())), pa.array(toxic, type=pa.int32())], names=["x", "toxic"]
            )

    return tidy(run)


def train(docs: DataFrame, labels: DataFrame, least: float = 3.0, fit_rows: int = 50_000) -> ToxicityModel:
    """Learn word weights and label coefficients from ``docs`` (doc_id, text) joined to ``labels`` (doc_id, toxic).

    Weights: documents per word and five-letter stem, over all labelled rows;
    all units of two toxic documents or more with log-odds of ``least`` or more
    are kept.  Up to ``BROADCAST_UNITS`` units are broadcast; beyond that, they
    stay in a table that texts are joined to.  Coefficients: a
    logistic regression on about ``fit_rows`` labelled rows, or all if there are
    fewer, chosen by a hash of the id; each is scored as if it had not been
    counted.
    Rows without text or label, or with a label other than 0 and 1, teach
    nothing; a document with both labels counts as toxic.  Up to
    ``BROADCAST_LABELS`` labels are broadcast, so no text is shuffled; beyond
    that, the labelled texts are shuffled and written once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:
        known = rows.join(F.broadcast(marks), "doc_id").where("text IS NOT NULL")
    else:
        known = cut(rows.join(marks, "doc_id").where("text IS NOT NULL"))
    partial = known.select("text", "toxic").mapInArrow(_count_units, "unit string, pos long, neg long")
    counts = partial.groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = cut(counts.where("unit = '' OR pos >= 2"))
    total = counts.where("unit = ''").first()
    total = (total["pos"], total["neg"]) if total else (0, 0)
    odds = F.log((F.col("pos") + 0.1) / F.lit(total[0] + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(total[1] + 1.0))
    counts = counts.where(F.col("unit") != "").where(odds >= least - 1e-9)  # a rounding wider than the test of Lexicon.weight
    joined = counts if counts.count() > BROADCAST_UNITS else None
    lexicon = Lexicon(*total, {} if joined is not None else {r["unit"]: (r["pos"], r["neg"]) for r in counts.collect()}, least)
    lexicon.counts = {u: c for u, c in lexicon.counts.items() if lexicon.weight(u)}
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sum(total)))) < fit_rows)
    sent = send(docs.sparkSession, lexicon)
    some = some.select("text", "toxic")
    got = (_with_units(some, joined) if joined is not None else some).mapInArrow(_training_features(sent), "x array<double>, toxic int").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, FEATURES)
    y = np.array(got.column("toxic").to_pylist(), dtype=float)
    return ToxicityModel(lexicon, _fit(x, y) if len(y) else np.r_[RARE, np.zeros(FEATURES)], joined)


def _probabilities(batch: pa.RecordBatch, model: ToxicityModel, move, label) -> np.ndarray:
    each = zip(batch.column("text").to_pylist(), _lexicons(model.lexicon, batch))
    x = np.array([features(t, lex, move, label) for t, lex in each], dtype=float).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ model.coefficients[1:] + model.coefficients[0], -30, 30)))


def _score(sent, column: str):
    def run(batches):
        model = received(sent)
        move, label = grammar()
        for batch in batches:
            scores = _probabilities(batch, model, move, label)
            if UNITS in batch.schema.names:
                batch = batch.drop_columns([UNITS])
            yield batch.append_column(pa.field(column, pa.float64()), pa.array(scores))

    return tidy(run)


def with_score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` (text and any other columns) with the probability that the text is toxic in ``column``.

    Null and empty texts match nothing and get the score of an empty match.
    One row per input row, repeated rows and null ids included.
    """
    sent = send(docs.sparkSession, ToxicityModel(model.lexicon, model.coefficients))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    rows = docs if model.units is None else _with_units(docs, model.units)
    return rows.mapInArrow(_score(sent, column), schema)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text), as in ``with_score``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(rows, model).select("doc_id", "score")
