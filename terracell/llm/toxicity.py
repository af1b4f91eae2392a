"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause become labels (abuse, harm, target, negation, report, other).  Six
transducers rewrite the label sequence and weigh it: one marks what follows somebody who is
addressed, one makes threats of harmful verbs that meet a target, one makes insults of abusive words, which count for little
until a target comes before or after them, and three weaken what stands in reported speech, after a negation, or
in a series.  They are composed into one automaton that runs over a clause once; the score
of a document comes from its matched clauses.

The abusive entries (whole words, stems that productive endings follow, and stems that count
where two different words of a document have them) and their weights are learned from labelled documents, as is the logistic curve that turns clause
scores into a probability.  Entries are counted and features are computed by Spark; the driver gets
counts and features.
"""

from __future__ import annotations

import logging
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..store import cut
from .vectext import chunks, tidy

log = logging.getLogger(__name__)

#: Labelled rows used for fitting, per class at most (a documented bound; the rows are those with the smallest hashes of their ids).
MAX_TOXIC_ROWS, MAX_CLEAN_ROWS = 3000, 5000
#: Bytes of text used for fitting, per class at most: rows are taken in the order of those hashes while they fit.
MAX_BYTES = 64 << 20
#: Seed of the hash that picks labelled rows; its lowest bit is the half of a row.
_PICK = 11
#: Distinct harmless words that a worker remembers.
PLAIN_WORDS = 200_000
#: score at which a document is toxic (fixed value of the contract).
THRESHOLD = 0.3

#: Seed vocabulary of the grammar (fixed values; English, German, French, Spanish).
THREATS = "kill murder hurt destroy beat burn shoot stab hang töten umbringen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yourself he she him her they them these those people du dich ihr euch sie tu toi vous ils elles tú usted ellos ellas".split()
NEGATIONS = "not never isn aren don doesn nicht kein keine niemals jamais aucun nunca tampoco jamás".split()
REPORTS = "said says called wrote claimed quoted sagte schrieb nannte dit écrit disait dijo escribió llamó".split()
#: Weight of a harmful verb, and of the abuse that a later target completes (fixed value).
THREAT_WEIGHT = 2.0
INSULTS = "idiot moron stupid scum trash pathetic worthless disgusting loser clown".split()

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:,\n|]+")
_STEM = range(3, 9)


@dataclass(frozen=True)
class Transducer:
    """``arcs[state, label] = (next state, label written, factor)``; a missing arc copies the label with factor 1 to ``fallback[state]``."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    fallback: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, label: str) -> tuple[int, str, float]:
        return self.arcs.get((state, label)) or (self.fallback.get(state, state), label, 1.0)


def target() -> Transducer:
    """From somebody addressed to the end of the clause, abuse and harm are aimed at somebody."""
    return Transducer({(0, "target"): (1, "target", 1.0), (1, "abuse"): (1, "aimed abuse", 1.0), (1, "harm"): (1, "aimed harm", 1.0)})


def threat() -> Transducer:
    """A harmful verb hardly counts until somebody is addressed, before it or after."""
    return Transducer({(0, "harm"): (1, "threat", 0.1), (1, "harm"): (1, "threat", 0.1), (0, "aimed harm"): (0, "threat", 1.0), (1, "aimed harm"): (1, "threat", 1.0), (1, "target"): (0, "threat", 0.9)})


def insult() -> Transducer:
    """An abusive word alone is half an insult; the target that it is said of, before it or after, makes it a whole one and more."""
    return Transducer({(0, "abuse"): (1, "insult", 0.5), (1, "abuse"): (1, "insult", 0.5), (0, "aimed abuse"): (0, "insult", 1.2), (1, "aimed abuse"): (1, "insult", 1.2), (1, "target"): (0, "insult", 0.7)})


def reported_speech() -> Transducer:
    """From a verb of saying to the end of the clause, insults and threats are somebody else's."""
    return Transducer({(0, "report"): (1, "other", 1.0), (1, "insult"): (1, "insult", 0.6), (1, "threat"): (1, "threat", 0.4)})


def negation(reach: int = 2) -> Transducer:
    """A negation weakens what follows within ``reach`` words."""
    arcs = {(s, "negation"): (reach, "other", 1.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs[s, "insult"] = (s - 1, "insult", 0.7)
        arcs[s, "threat"] = (s - 1, "threat", 0.3)
    return Transducer(arcs, {s: s - 1 for s in range(1, reach + 1)})


def series() -> Transducer:
    """Further insults of one clause add less."""
    return Transducer({(0, "insult"): (1, "insult", 1.0), (1, "insult"): (1, "insult", 0.8)})


LABELS = ("abuse", "harm", "target", "negation", "report", "other")


def compose(parts: list[Transducer]) -> dict[tuple[int, str], tuple[int, float]]:
    """One automaton from transducers in sequence: each reads what the one before wrote; factors multiply."""
    start = (0,) * len(parts)
    number, todo, table = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for label in LABELS:
            out, weight, after = label, 1.0, []
            for t, s in zip(parts, state):
                s, out, f = t.step(s, out)
                after.append(s)
                weight *= f
            after = tuple(after)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            table[number[state], label] = (number[after], weight if out in ("insult", "threat") else 0.0)
    return table


PARTS = [target(), threat(), insult(), reported_speech(), negation(), series()]
GRAMMAR = compose(PARTS)


#: Marks of entries: a whole word, and a stem that two different words of a document must have (fixed values).
_WHOLE, _TWICE = "$", "+"


def entries(word: str) -> list[str]:
    """Lexicon entries that a word can match by itself: the word, and its proper stems."""
    return [word + _WHOLE, *(word[:k] for k in _STEM if k < len(word))]


@dataclass
class Model:
    """Entries with weights, and the logistic curve over :meth:`features`."""

    lexicon: dict[str, float]
    curve: list[float]

    def __post_init__(self):
        self.known: dict[str, tuple[str, float]] = {}
        self.plain: set[str] = set()
        self.twice = {e[:-1]: w for e, w in self.lexicon.items() if e.endswith(_TWICE)}
        for label, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
            for w in ws:
                self.known[w] = (label, 0.0)
        self.threats = dict.fromkeys(THREATS, THREAT_WEIGHT)

    def label(self, word: str) -> tuple[str, float]:
        """Label and weight of one word."""
        if word in self.known:
            return self.known[word]
        weight = max((self.lexicon[e] for e in entries(word) if e in self.lexicon), default=0.0)
        found = ("abuse", weight) if weight else ("harm", self.threats[word]) if word in self.threats else ("other", 0.0)
        if weight or word in self.threats:
            self.known[word] = found
        return found

    def triggers(self, words: list[str]) -> tuple[set[str], dict[str, float]]:
        """(abuse and harm among the words, weights of those that are abuse in this document); plain words are remembered by a worker, within a bound."""
        if len(self.plain) > PLAIN_WORDS:
            self.plain.clear()
        out, stems = set(), {}
        for w in set(words).difference(self.plain):
            held = [w[:k] for k in _STEM if k < len(w) and w[:k] in self.twice] if self.twice else ()
            if held:
                stems[w] = held
            if self.label(w)[0] in ("abuse", "harm"):
                out.add(w)
            elif not held:
                self.plain.add(w)
        count = Counter(x for held in stems.values() for x in held)
        here = {w: best for w, held in stems.items() if self.label(w)[0] in ("abuse", "other") and (best := max((self.twice[x] for x in held if count[x] > 1), default=0.0))}
        return out | here.keys(), here

    def clause_scores(self, text: str) -> tuple[list[float], int]:
        """(scores of matched clauses, words of the document)."""
        lower = text.lower()
        words = _WORD.findall(lower)
        triggers, here = self.triggers(words)
        scores = []
        if triggers:
            for clause in _CLAUSE.split(lower):
                ws = _WORD.findall(clause)
                if triggers.isdisjoint(ws):
                    continue
                state, total = 0, 0.0
                for w in ws:
                    label, weight = self.label(w)
                    if w in here:
                        label, weight = "abuse", max(weight, here[w])
                    state, factor = GRAMMAR[state, label]
                    # A target that completes a threat or insult has no weight of its own.
                    total += factor * (weight or THREAT_WEIGHT)
                if total:
                    scores.append(total)
        return scores, len(words)

    def features(self, text: str) -> list[float]:
        scores, n = self.clause_scores(text)
        s = sum(scores)
        return [1.0, min(s, 30.0) / 10, max(scores, default=0.0) / 5, math.log1p(len(scores)), min(s / math.sqrt(n + 20), 5.0)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.features(text or "")))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def doc_entries(text: str) -> set[str]:
    """Entries that a document matches."""
    words = set(_WORD.findall(text.lower()))
    stems = Counter(w[:k] for w in words for k in _STEM if k < len(w))
    return {w + _WHOLE for w in words} | stems.keys() | {e + _TWICE for e, n in stems.items() if n > 1}


#: Toxic documents that an entry must be in.
LEAST_DOCS = 3


def odds(p, n, toxic: int, clean: int, spreads: float = 1.0):
    """Lower bound of the log-odds of an entry in ``p`` of the toxic and ``n`` of the clean documents (numbers or arrays)."""
    p, n = np.asarray(p, float) + 0.5, np.asarray(n, float) + 0.5
    return np.log(p / (toxic + 1.0)) - np.log(n / (clean + 1.0)) - spreads * np.sqrt(1 / p + 1 / n)


def candidates(entry: list[str], p: np.ndarray, n: np.ndarray, toxic: int, clean: int, least_odds: float = 1.5) -> dict[str, tuple[float, int, int]]:
    """``{entry: (lower bound of its log-odds, p, n)}`` of the entries that mark toxic documents."""
    if not toxic or not clean:
        return {}
    low = odds(p, n, toxic, clean)
    return {entry[i]: (float(low[i]), int(p[i]), int(n[i])) for i in np.flatnonzero((p >= LEAST_DOCS) & (low >= least_odds))}


def choose(found: dict[str, tuple[float, int, int]], held: dict[str, list[int]], toxic: int, clean: int, rest_odds: float = 0.5) -> dict[str, float]:
    """Entries with weights, chosen one after another; ``held`` has the toxic documents of each candidate.

    The next entry is the one with the most evidence in the toxic documents (lower bound of its log-odds times the root of its count) that no
    chosen stem covers; it must hold in LEAST_DOCS documents with fewer than two chosen entries, and have ``rest_odds`` in those it adds.
    """
    seen, out, longer = Counter(), {}, {}
    # Of entries with the same evidence the longest is the most specific.
    for e in sorted(found, key=lambda e: (-found[e][0] * math.sqrt(found[e][1]), -len(e), e)):
        stem = e.rstrip(_WHOLE + _TWICE)
        if any(stem[:k] in out or stem[:k] + _TWICE in out for k in _STEM if k < len(stem)) or e.endswith(_TWICE) and stem in out:
            continue
        # A stem of chosen entries is judged by the documents that they leave out.
        rest = [i for i in held[e] if i not in longer.get(stem if e.endswith(_TWICE) else e, ())]
        if sum(seen[i] < 2 for i in rest) >= LEAST_DOCS and (w := float(odds(len(rest), found[e][2], toxic, clean))) >= rest_odds:
            out[e] = min(w, 5.0)
            seen.update(held[e])
            for k in _STEM:
                if k <= len(stem) and stem[:k] != e:
                    longer.setdefault(stem[:k], set()).update(held[e])
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> list[float]:
    """Logistic regression by Newton steps; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


SEED = {w + "$": 2.5 for w in INSULTS}


def held_out(doc_id):
    """The rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_bytes: int) -> DataFrame:
    """``h, text, toxic``: distinct labelled texts that are not held out, within the bounds, with the hash that picked them."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashed = usable.withColumn("h", F.xxhash64(F.lit(_PICK), "doc_id"))
    chosen = hashed.where("toxic = 1").orderBy("h", "doc_id").limit(max_toxic).unionByName(hashed.where("toxic = 0").orderBy("h", "doc_id").limit(max_clean))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat an id one text counts, and copies of a text are one witness.
    one = texts.groupBy("doc_id", "toxic", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text")).groupBy("text", "toxic").agg(F.min("h").alias("h"))
    one = cut(one.withColumn("size", F.octet_length("text")))
    # The driver gets the sizes of the bounded sample and says which of its texts fit; one that does not is passed over.
    kept, held = [], {0: 0, 1: 0}
    rows = sorted(one.select("toxic", "h", "size").collect(), key=lambda r: (r["toxic"], r["h"]))
    for r in rows:
        if held[r["toxic"]] + r["size"] <= max_bytes:
            held[r["toxic"]] += r["size"]
            kept.append((r["toxic"], r["h"]))
    if len(kept) < len(rows):
        log.warning("%d of %d labelled texts are not learned from, as their class has more than %d bytes", len(rows) - len(kept), len(rows), max_bytes)
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "toxic int, h long")), ["toxic", "h"], "left_semi")
    return one.select("h", "text", "toxic")


def _count_entries(sample: DataFrame) -> DataFrame:
    """``entry, p0, p1, n0, n1``: toxic and clean documents with the entry, by half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                parts = [Counter() for _ in range(4)]
                for h, text, toxic in zip(*(c.column(k).to_pylist() for k in ("h", "text", "toxic"))):
                    parts[(0 if toxic else 2) + (h & 1)].update(doc_entries(text))
                names = list(set().union(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([p[e] for e in names], pa.int64()) for p in parts)], ["entry", "p0", "p1", "n0", "n1"])

    counted = sample.mapInArrow(tidy(run), "entry string, p0 long, p1 long, n0 long, n1 long")
    return counted.groupBy("entry").agg(*(F.sum(k).alias(k) for k in ("p0", "p1", "n0", "n1"))).where(F.col("p0") + F.col("p1") >= LEAST_DOCS)


def _holders(sample: DataFrame, names: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Toxic documents of each entry, as (half, hash)."""
    wanted = set(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                held = [(e, h) for h, text in zip(c.column("h").to_pylist(), c.column("text").to_pylist()) for e in doc_entries(text) & wanted]
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in held], pa.string()), pa.array([h for _, h in held], pa.int64())], ["entry", "h"])

    held = sample.where("toxic = 1").mapInArrow(tidy(run), "entry string, h long").toArrow()
    out: dict[str, list[tuple[int, int]]] = {e: [] for e in names}
    for e, h in zip(held.column("entry").to_pylist(), held.column("h").to_pylist()):
        out[e].append((h & 1, h))
    return out


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC_ROWS, max_clean: int = MAX_CLEAN_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on labelled rows that are not held out: at most ``max_toxic`` and ``max_clean`` of them, and ``max_bytes`` of text per class.

    labels: ``doc_id, toxic``; null ids and labels are left out, and of several labels of one id the largest counts.  Of rows that
    repeat an id one text counts.  A text that does not fit beside those with smaller hashes is passed over, and the next that fits is taken.  Entries are learned on each half of the rows for the curve on the other half, and then on all.
    Without labelled rows of both classes the seed vocabulary and a fixed curve serve.
    """
    sample = labelled_sample(docs, labels, max_toxic, max_clean, max_bytes)
    size = np.zeros(4, int)
    for r in sample.groupBy("toxic", F.col("h").bitwiseAND(F.lit(1)).alias("half")).count().collect():
        size[(0 if r["toxic"] else 2) + r["half"]] = r["count"]
    if not size[:2].sum() or not size[2:].sum():
        log.warning("no labelled texts of both classes: the seed vocabulary and a fixed curve serve")
        return Model(dict(SEED), [-2.5, 3.0, 1.0, 0.5, 0.5])
    t = _count_entries(sample).toArrow()
    entry, p0, p1, n0, n1 = (t.column(k).to_pylist() if k == "entry" else t.column(k).to_numpy() for k in t.schema.names)
    # For all rows, for the first half and for the second.
    counts = [(p0 + p1, n0 + n1, size[0] + size[1], size[2] + size[3]), (p0, n0, size[0], size[2]), (p1, n1, size[1], size[3])]
    found = [candidates(entry, *c) for c in counts]
    held = _holders(sample, list(set().union(*found)))
    lexicons = []
    for half, f, (_, _, toxic, clean) in zip((None, 0, 1), found, counts):
        lexicons.append(SEED | choose(f, {e: [h for at, h in held[e] if half is None or at == half] for e in f}, toxic, clean))
    x = _features(sample, Model(lexicons[1], []), Model(lexicons[2], [])).toArrow()
    return Model(lexicons[0], fit_curve(np.array(x.column("x").to_pylist()), x.column("y").to_numpy().astype(float)))


def _features(sample: DataFrame, first: Model, second: Model) -> DataFrame:
    """``x, y``: features of each row by the model of the other half, and its label."""
    lexicons = (first.lexicon, second.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(lexicon, []) for lexicon in lexicons]
        for b in batches:
            for c in chunks(b, "text"):
                x = [models[1 - (h & 1)].features(text) for h, text in zip(c.column("h").to_pylist(), c.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), c.column("toxic")], ["x", "y"])

    return sample.mapInArrow(tidy(run), "x array<double>, y int")


def score_documents(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """The rows of ``docs`` with a column ``into``; a column of that name is replaced.

    Null and empty texts get the score of a document without matched clauses.  Repeated rows repeat; nothing but
    the text enters the score; nothing is shuffled.
    """
    base = docs.drop(into)
    names = base.columns
    lexicon, curve = model.lexicon, model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(lexicon, curve)
        for b in batches:
            for c in chunks(b, "text"):
                scores = [m.score(x.as_py()) for x in c.column("text")]
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(scores, pa.float64())], [*names, into])

    return base.mapInArrow(tidy(run), StructType([*base.schema.fields, StructField(into, DoubleType())]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: a score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
