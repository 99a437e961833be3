"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols (insult, threat, target, negation, verb of saying). The composed transducers of
grammar.py read each clause and label what it says: insults and threats, aimed or not, as they stand, negated or
reported. A colon after a verb of saying doesn't end its clause, and a quotation that such a clause opens is reported
to its end, over all its clauses. A word that several events concern counts once, under the last (an insult is aimed
when its target follows). A document's score is a logistic function of the weights of its matched clauses by label.

The lexicon has a few seed words and learned entries: whole words and word beginnings that training documents
labelled toxic have significantly more often than others (a likelihood ratio beyond 2 ln of the number of candidates,
so that chance finds are unlikely however many words there are). An entry's weight is its smoothed log odds; how high
it must be is chosen by cross-validation within the training documents. An entry is a threat if toxic training
documents have a target after it far more often than before it, as verbs stand ("I'll ... you"), else an insult.
Label weights are fitted by ridge-penalised logistic regression on features from lexicons learned on the other half of
the training documents, so that they don't trust a lexicon more than unseen text bears out.

Training is on up to TRAINING_ROWS labelled documents, those with the lowest hashes of their ids; counting is
distributed, and what reaches the driver is bounded by ENTRIES and TRAINING_ROWS. All documents are scored whole.

Defined results. Null and empty texts have no clauses and get the score of a document without matches. Labels that
are null are left out; of several labels of a document the largest counts. Without labels of both kinds the seed
words alone score. Rows without doc_id are scored, never learned from and held out. Rows that repeat score alike. Very
long texts are read whole. Input columns stay as they are, but for any called held_out, score or predicted. Of an
empty table nothing comes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grammar
from .arrow import map_slices
from .workspace import Workspace, documents

TRAINING_ROWS, ENTRIES, FOLDS = 20_000, 5_000, 5
#: Log odds that an entry must have: the one of these that cross-validation in the training documents prefers.
LEAST_WEIGHTS = (1.0, 2.0, 3.0)
REACH = 3
SHORTEST, LONGEST, LEAST_DOCS = 3, 8, 3
SEED_WEIGHT, RIDGE = 2.0, 1.0
KEPT_WORDS = 150_000
#: Texts counted at once, in bytes; their word beginnings take many times as much.
COUNTED_BYTES = 1 << 20
_NOTHING = (grammar.OTHER, 0.0)
# Seed words in four languages.
SEEDS = {
    grammar.INSULT: "idiot moron stupid imbecile scum worthless loser pathetic dumb trottel dummkopf abschaum idiota estúpido imbécil escoria connard crétin ordure",
    grammar.THREAT: "kill hurt destroy punch shoot töten umbringen verletzen matar golpear destruir tuer frapper détruire",
    grammar.TARGET: "you your you're yourself du dich dir dein ihr euch tú te ti tu usted ustedes vous toi ton votre",
    grammar.NEGATION: "not no never nobody isn't aren't wasn't don't doesn't didn't nicht kein keine nie niemals nunca jamás ne pas jamais aucun",
    grammar.REPORT: "said says say saying wrote claimed called reported alleged quoted sagte schrieb behauptete nannte dijo escribió llamó afirmó dit écrit appelé déclaré",
}
_WORD = regex.compile(r"""\p{L}+(?:'\p{L}+)?|[.!?;:\n"\u201c\u201d\u201e\u00ab\u00bb]""")
_STOPS, _QUOTES = set(".!?;:\n"), set('"\u201c\u201d\u201e\u00ab\u00bb')
_MARKS = _STOPS | _QUOTES


def held_out(doc_id: int | None, folds: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def beginnings(word: str) -> list[str]:
    """The lexicon keys of a word: its beginnings, open at the end, and the whole word."""
    return [word[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word]


def tokens(text: str) -> list[str]:
    """Lower-cased words, with straight apostrophes, and the marks that end clauses or quote."""
    return _WORD.findall(text.lower().replace("\u2019", "'"))


def clauses(found: list[str]) -> Iterator[tuple[list[str], bool]]:
    """(words, told) of each clause; told: it stands in a quotation that a verb of saying introduced."""
    clause: list[str] = []
    verbs = set(SEEDS[grammar.REPORT].split())
    quoted = told = says = False
    for token in (*found, "\n"):
        if token not in _MARKS:
            clause.append(token)
            says = says or token in verbs
        elif token in _QUOTES:
            if quoted:
                if clause:
                    yield clause, told
                clause, says, told, quoted = [], False, False, False
            else:
                quoted, told = True, says
        elif token != ":" or not says:
            if clause:
                yield clause, told and quoted
            clause, says = [], False
            if token == "\n":
                quoted = told = False


class Lexicon:
    """Words to symbols and weights; learned: entries with their weights; threats: which of them are threats."""

    def __init__(self, learned: dict[str, float], threats: frozenset[str] = frozenset()):
        self.learned, self.threats = learned, threats
        self.seeds = {w: s for s, words in SEEDS.items() for w in words.split()}
        self.known: dict[str, tuple[str, float]] = {}
        self.hot: set[str] = set()

    def look_up(self, word: str) -> tuple[str, float]:
        if (found := self.known.get(word)) is None:
            weight, entry = max(((self.learned[k], k) for k in beginnings(word) if k in self.learned), default=(0.0, ""))
            seed = self.seeds.get(word)
            if seed in (grammar.INSULT, grammar.THREAT):
                weight = max(weight, SEED_WEIGHT)
            kind = seed or (grammar.THREAT if entry in self.threats else grammar.INSULT)
            found = (kind, weight) if seed or weight else _NOTHING
            self.known[word] = found
            if found[1] > 0:
                self.hot.add(word)
        return found

    def features(self, found: list[str]) -> np.ndarray:
        """By label, the log of one plus the weights of the words that tokens() gives, under their last events."""
        total = np.zeros(len(grammar.LABELS))
        words = set(found) - _MARKS
        if len(self.known) >= KEPT_WORDS:
            # only between texts, so that a text's words are known together
            self.known.clear()
            self.hot.clear()
        for word in words:
            if word not in self.known:
                self.look_up(word)
        # most texts have no word with a weight
        if self.hot.isdisjoint(words):
            return total
        for clause, told in clauses(found):
            if self.hot.isdisjoint(clause):
                continue
            read = [self.look_up(w) for w in clause]
            events: dict[int, int] = {}
            for at, label in grammar.GRAMMAR.labels((s for s, _ in read), told):
                if read[at][0] == grammar.TARGET:
                    wanted = grammar.THREAT if grammar.LABELS[label][0] == grammar.AIMED_THREAT else grammar.INSULT
                    at = next(i for i in range(at - 1, -1, -1) if read[i][0] == wanted)
                events[at] = label if at not in events or grammar.LABELS[events[at]][0] in (grammar.BARE_INSULT, grammar.BARE_THREAT) else events[at]
            for at, label in events.items():
                total[label] += read[at][1]
        return np.log1p(total)


def _count_words(docs: DataFrame) -> DataFrame:
    """(entry, half, toxic, clean): documents of each kind that have the entry; docs: doc_id, text, toxic."""

    def run(batch: pa.RecordBatch) -> dict:
        counts: dict[tuple[str, int], Counter] = {(kind, half): Counter() for kind in ("toxic", "clean") for half in (0, 1)}
        for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))):
            words = set(tokens(text or "")) - _MARKS
            counts["toxic" if toxic else "clean", _half(doc_id)].update({k for w in words for k in beginnings(w)})
        found = [(half, list(counts["toxic", half].keys() | counts["clean", half].keys())) for half in (0, 1)]
        return {
            "entry": [k for _, keys in found for k in keys],
            "half": [half for half, keys in found for _ in keys],
            "toxic": [counts["toxic", half][k] for half, keys in found for k in keys],
            "clean": [counts["clean", half][k] for half, keys in found for k in keys],
        }

    return map_slices(docs, run, "entry string, half int, toxic long, clean long", COUNTED_BYTES)


def _half(doc_id: int) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) & 1


Entries = dict[str, tuple[float, float]]


def _entries(counts: DataFrame, toxic: int, clean: int) -> Entries:
    """The significant entries, with weight and likelihood ratio; counts: entry, toxic, clean."""
    if not toxic or not clean:
        return {}
    counts = counts.filter(F.col("toxic") >= LEAST_DOCS)
    a, b, n, m = F.col("toxic"), F.col("clean"), F.lit(float(toxic)), F.lit(float(clean))
    weight = F.log((a + 0.5) / (n + 1)) - F.log((b + 0.5) / (m + 1))
    share = (a + b) / (n + m)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (term(a, n * share) + term(b, m * share) + term(n - a, n * (1 - share)) + term(m - b, m * (1 - share)))
    scored = counts.select("entry", weight.alias("weight"), ratio.alias("ratio"))
    bar = 2 * math.log(max(2, scored.count()))
    best = scored.filter((F.col("ratio") > bar) & (F.col("weight") > min(LEAST_WEIGHTS))).orderBy(F.desc("ratio"), "entry").limit(len(LEAST_WEIGHTS) * ENTRIES)
    return {r.entry: (r.weight, r.ratio) for r in best.collect()}


def _above(entries: Entries, least: float) -> dict[str, float]:
    """The ENTRIES most significant entries whose weight is over `least`."""
    best = sorted((k for k, (weight, _) in entries.items() if weight > least), key=lambda k: (-entries[k][1], k))
    return {k: entries[k][0] for k in best[:ENTRIES]}


def _threats(chosen: DataFrame, entries: list[str]) -> frozenset[str]:
    """The entries that stand before targets of toxic documents at least three times as often as after them."""

    def run(batch: pa.RecordBatch) -> dict:
        wanted, targets = set(entries), set(SEEDS[grammar.TARGET].split())
        before, after = Counter(), Counter()
        for text in batch.column("text").to_pylist():
            for clause, _ in clauses(tokens(text or "")):
                places = [i for i, w in enumerate(clause) if w in targets]
                if not places:
                    continue
                for i, w in enumerate(clause):
                    keys = [k for k in beginnings(w) if k in wanted]
                    before.update(keys if any(0 < p - i <= REACH for p in places) else ())
                    after.update(keys if any(0 < i - p <= REACH for p in places) else ())
        keys = list(before.keys() | after.keys())
        return {"entry": keys, "before": [before[k] for k in keys], "after": [after[k] for k in keys]}

    counted = map_slices(chosen.filter("toxic > 0").select("text"), run, "entry string, before long, after long").groupBy("entry").agg(F.sum("before").alias("b"), F.sum("after").alias("a"))
    return frozenset(r.entry for r in counted.collect() if r.b >= LEAST_DOCS and r.b >= 3 * r.a)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights with the intercept first, by Newton's method; only the intercept isn't penalised."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def loss(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> float:
    """The mean log loss of each part under the weights that the others give."""
    total = 0.0
    for k in np.unique(part):
        own = part == k
        w = fit_logistic(x[~own], y[~own])
        z = np.clip(w[0] + x[own] @ w[1:], -30, 30) * np.where(y[own] > 0, 1, -1)
        total += np.log1p(np.exp(-z)).sum()
    return total / len(y)


class Model:
    def __init__(self, entries: dict[str, float], threats: frozenset[str], weights: np.ndarray):
        self.entries, self.threats, self.weights = entries, threats, weights

    def scores(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        x = np.array([lexicon.features(tokens(t)) for t in texts]).reshape(-1, len(grammar.LABELS))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, rows: int = TRAINING_ROWS) -> Model:
    """Learns from the labelled documents (doc_id, text; doc_id, toxic) that aren't held out."""
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers: a proven bound for a broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    chosen = space.write(chosen.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "chosen")
    counts = space.write(_count_words(chosen).groupBy("entry", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "counts")
    sizes: Counter = Counter()
    for r in chosen.select("doc_id", "toxic").collect():
        sizes[_half(r.doc_id), r.toxic > 0] += 1
    halves = [_entries(counts.filter(F.col("half") == h).select("entry", "toxic", "clean"), sizes[h, True], sizes[h, False]) for h in (0, 1)]
    both = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    entries = _entries(both, sizes[0, True] + sizes[1, True], sizes[0, False] + sizes[1, False])
    # where an entry stands is no label of a document, so all training documents tell it for both halves
    threats = _threats(chosen, sorted({*entries, *halves[0], *halves[1]}))
    candidates = [[_above(half, least) for half in halves] for least in LEAST_WEIGHTS]

    def run(batch: pa.RecordBatch) -> dict:
        lexicons = [[Lexicon(learned, threats) for learned in pair] for pair in candidates]
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        x = []
        for doc_id, text in zip(ids, texts):
            found = tokens(text or "")
            x.append(np.concatenate([pair[1 - _half(doc_id)].features(found) for pair in lexicons]))
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "x": x}

    data = map_slices(chosen, run, "doc_id long, toxic int, x array<double>").collect()
    space.drop("chosen", "counts")
    data.sort(key=lambda r: r.doc_id)
    y = np.array([r.toxic > 0 for r in data], float)
    if not 0 < y.sum() < len(y):
        # nothing to learn from: a bare insult is a little above even odds
        return Model({}, frozenset(), np.r_[-1.0, np.ones(len(grammar.LABELS))])
    x = np.array([r.x for r in data]).reshape(len(data), len(LEAST_WEIGHTS), -1)
    part = np.array([zlib.crc32(f"part {r.doc_id}".encode()) % 5 for r in data])
    best = min(range(len(LEAST_WEIGHTS)), key=lambda i: (loss(x[:, i], y, part), i))
    return Model(_above(entries, LEAST_WEIGHTS[best]), threats, fit_logistic(x[:, best], y))


_lexicons: dict[int, Lexicon] = {}


def _lexicon(model: Model) -> Lexicon:
    """One for each process and set of entries."""
    key = hash((frozenset(model.entries.items()), model.threats))
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(model.entries, model.threats)
    return _lexicons[key]


def score(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """docs with held_out, score and predicted."""
    entries, threats, weights = model.entries, model.threats, model.weights
    columns = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    kept = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batch: pa.RecordBatch) -> dict:
        own = Model(entries, threats, weights)
        scores = own.scores([t or "" for t in batch.column("text").to_pylist()], _lexicon(own))
        same = {c: batch.column(c) for c in columns}
        return same | {"held_out": [held_out(d, folds) for d in batch.column("doc_id").to_pylist()], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    return map_slices(kept, run, f"{schema}, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, train(docs, labels)).drop("text")
