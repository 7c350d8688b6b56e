"""Toxicity scores from a learned lexicon, Levenshtein automata over its trie, and context windows.

The lexicon is learned from labelled rows: whole words and word beginnings that stand in toxic
texts far more often than in others. Its trie is intersected with the Levenshtein automaton of
each term, determinized while it reads (a state is the set of trie nodes with the edits spent),
so a word costs one table step a letter and most words leave after two or three. Hits are scored
in windows of words around them: a hit inside quotation marks counts apart from a plain one, a
misspelled one apart from an exact one, and hits close together strengthen each other. A logistic
regression over those few sums gives the score.

Learning reads a bounded sample: at most ``FIT_ROWS`` labelled rows, those of least id hash;
one half of them makes the lexicon, the other fits the regression. Scoring reads every text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keyed, out_id, ready
from .words import Flat, Words, distinct, flat, hashes, slices, words

FIT_ROWS = 20_000
MOST_TERMS = 500
STEM = (4, 8)
LEAST_TEXTS, LEAST_ODDS = 5, 2.0
FUZZY_FROM = 6
WINDOW = 10
MOST_KNOWN = 700_000
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’…¡¿"
FEATURES = 8


def fold(raw: bytes) -> str:
    return raw.decode().lower().strip(EDGES)


@dataclass
class Lexicon:
    """Terms with weights; ``beginning`` terms match any word that begins with them."""

    terms: list[tuple[str, bool, float]]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])

    def __post_init__(self):
        for k, (term, _, _) in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(k)
        self.letters = {c for x in self.children for c in x}
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.begun: list[tuple[int, int]] = []
        self.whole: list[tuple[int, int]] = []
        self.start = self.state({(0, 0)})

    def state(self, nodes: set[tuple[int, int]]) -> int:
        """The number of a set of (node, edits): closed under left-out letters, and what it accepts."""
        todo = list(nodes)
        while todo:
            node, spent = todo.pop()
            if spent < 1:
                for child in self.children[node].values():
                    if (child, spent + 1) not in nodes:
                        nodes.add((child, spent + 1))
                        todo.append((child, spent + 1))
        key = frozenset(nodes)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            hit = [(spent, k) for node, spent in key for k in self.ends[node] if spent == 0 or len(self.terms[k][0]) >= FUZZY_FROM]
            self.begun.append(self.best(x for x in hit if self.terms[x[1]][1]))
            self.whole.append(self.best(hit))
        return self.number[key]

    def best(self, hits) -> tuple[int, int]:
        return min(hits, key=lambda x: (x[0], -self.terms[x[1]][2], x[1]), default=(9, -1))

    def step(self, state: int, letter: str) -> int:
        letter = letter if letter in self.letters else ""
        got = self.steps.get((state, letter))
        if got is None:
            nodes = set()
            for node, spent in self.states[state]:
                if letter in self.children[node]:
                    nodes.add((self.children[node][letter], spent))
                if spent < 1:
                    nodes.add((node, spent + 1))
                    nodes.update((child, spent + 1) for child in self.children[node].values())
            got = self.steps[state, letter] = self.state(nodes) if nodes else -1
        return got

    def match(self, word: str) -> tuple[int, int]:
        """``(edits, term)`` of the closest term, or ``(9, -1)``."""
        state, found = self.start, (9, -1)
        for c in word:
            state = self.step(state, c)
            if state < 0:
                return found
            if self.begun[state] < found:
                found = self.begun[state]
        return min(found, self.whole[state])


class Scorer:
    """Features of whole texts; keeps the matches of words it has met, as a cache."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.lexicon = Lexicon(terms)
        self.known: dict[int, int] = {}

    def matched(self, w: Words) -> np.ndarray:
        """For each word 0, or 1 + 2 * term + (1 if misspelled)."""
        value, first, back = distinct(hashes(w))
        if len(self.known) + len(value) > MOST_KNOWN:
            self.known = {}
        keys = value.tolist()
        known = list(map(self.known.get, keys))
        for i in [i for i, k in enumerate(known) if k is None]:
            edits, term = self.lexicon.match(fold(w.data[w.start[first[i]]:w.end[first[i]]].tobytes()))
            known[i] = self.known[keys[i]] = 0 if term < 0 else 1 + 2 * term + (edits > 0)
        return np.array(known, np.int64)[back]

    def features(self, texts: Flat) -> np.ndarray:
        """One row a text: a constant and the window sums. A text without hits has zeros."""
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1
        w = words(texts, lower=True)
        got = self.matched(w)
        hits = np.flatnonzero(got)
        if not len(hits):
            return out
        docs = np.searchsorted(w.bounds, hits, "right") - 1
        for d in np.unique(docs).tolist():
            own = hits[docs == d] if len(hits) < 1000 else hits[np.searchsorted(docs, d):np.searchsorted(docs, d, "right")]
            weight = np.array([self.lexicon.terms[(k - 1) // 2][2] for k in got[own].tolist()])
            wrong = (got[own] - 1) % 2 == 1
            quoted = self.quoted(texts, w, d, own)
            total = np.append(0, np.cumsum(weight))
            near = total[np.searchsorted(own, own + WINDOW, "left")] - total[np.searchsorted(own, own - WINDOW, "right")]
            plain = ~wrong & ~quoted
            out[d, 1:] = [math.log1p(weight[plain].sum()), plain.any(), math.log1p(weight[~wrong & quoted].sum()), (~wrong & quoted).any(),
                          math.log1p(weight[wrong & ~quoted].sum()), math.log1p(weight[wrong & quoted].sum()), math.log1p(near.max())]
        return out

    @staticmethod
    def quoted(texts: Flat, w: Words, d: int, own: np.ndarray) -> np.ndarray:
        """Whether each hit stands between quotation marks, with one of them at most WINDOW words away.

        The marks of the text are found once; each hit looks its neighbours up among them.
        """
        raw, begin = texts.text(d), texts.offsets[d]
        at = {mark: np.array([m.start() for m in re.finditer(re.escape(mark.encode()), raw)], np.int64) for mark in '"«»“”„'}
        if not sum(map(len, at.values())):
            return np.zeros(len(own), bool)
        here = w.start[own] - begin
        low = w.start[np.maximum(w.bounds[d], own - WINDOW)] - begin
        high = w.end[np.minimum(w.bounds[d + 1], own + WINDOW + 1) - 1] - begin

        def last(mark):
            """Where the mark stands last in the window up to the first byte of the hit, -1 if nowhere."""
            known = np.append(at[mark], -1)
            k = np.searchsorted(at[mark], here + 1 - len(mark.encode()), "right") - 1
            return np.where(known[k] >= low, known[k], -1)

        def follows(mark):
            known = np.append(at[mark], len(raw) + WINDOW)
            return known[np.searchsorted(at[mark], here)] + len(mark.encode()) <= high

        odd = np.searchsorted(at['"'], here, "right") % 2 == 1
        out = odd & ((last('"') >= 0) | follows('"'))
        for a, b in ("«»", "“”", "„“"):
            out |= (last(a) > last(b)) & follows(b)
        return out


def held_out(identity: Column) -> Column:
    """Whether crc32 of the id's text leaves no remainder by 5; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(identity.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def choose(counts: list[tuple[str, bool, int, int]], n_toxic: int, n_other: int) -> list[tuple[str, bool, float]]:
    """The lexicon: terms by weight of evidence, the longer of nearly equal ones first.

    Left out are terms that a chosen beginning covers, and beginnings that say hardly more than a
    chosen longer term.
    """
    rated = []
    for term, beginning, toxic, other in counts:
        odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
        if toxic >= LEAST_TEXTS and odds >= LEAST_ODDS:
            rated.append((-round(20 * math.log(toxic * odds)), -len(term), beginning, term, toxic, odds))
    out: list[tuple[str, bool, float]] = []
    taken: set[str] = set()
    longer: dict[str, int] = {}
    for _, _, beginning, term, toxic, odds in sorted(rated):
        if len(out) == MOST_TERMS:
            break
        if any(term[:k] in taken for k in range(1, len(term) + 1)) or longer.get(term, 0) > 0.7 * toxic:
            continue
        out.append((term, beginning, odds))
        if beginning:
            taken.add(term)
        for k in range(STEM[0], len(term) + 1):
            longer[term[:k]] = max(longer.get(term[:k], 0), toxic)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on at most FIT_ROWS rows of FEATURES columns."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        keep = ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * beta)
        beta += change
        if np.abs(change).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[tuple[str, bool, float]], np.ndarray]:
    """Lexicon and regression from at most ``rows`` labelled rows that are not held out."""
    ready(docs.sparkSession)
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    sample = (keyed(docs).join(F.broadcast(chosen), "_id")  # at most ``rows`` pairs of numbers
              .withColumn("half", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2))).checkpoint())
    least, most = STEM

    def terms(batches):
        for batch in batches:
            count: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {fold(x) for x in text.encode().split()}
                own = {(x, False) for x in own if len(x) >= 3} | {(x[:k], True) for x in own for k in range(least, most + 1) if len(x) >= k}
                for t in own:
                    count.setdefault(t, [0, 0])[1 - toxic] += 1
            rows = [(t, b, x, y) for (t, b), (x, y) in count.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)],
                                                 ["term", "beginning", "toxic", "other"])

    first = sample.where("half = 0")
    totals = first.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_other = totals[0] or 0, totals[1] or 0
    counts = (first.select("text", "toxic").mapInArrow(terms, "term string, beginning boolean, toxic long, other long")
              .groupBy("term", "beginning").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
              .where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") * n_other > 5 * F.col("other") * n_toxic)))
    # Of the bounded sample, and only terms far commoner in its toxic texts.
    lexicon = choose([tuple(r) for r in counts.collect()], n_toxic, n_other)

    def describe(batches):
        scorer = Scorer(lexicon)
        for batch in batches:
            for part in slices(batch):
                x = scorer.features(flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    other = sample.where("half = 1").select("text", "toxic").mapInArrow(describe, "toxic int, x array<double>").collect()
    if not other:
        return lexicon, np.r_[-4.0, np.ones(FEATURES - 1)]
    return lexicon, logistic(np.array([r.x for r in other]), np.array([r.toxic for r in other], float))


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null or empty text has no hits and gets the score of such texts; without labelled rows the
    regression falls back to fixed weights over an empty lexicon; a null doc_id stays null and is
    not held out; repeated rows score alike; other columns are not read.
    """
    lexicon, beta = fit(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((lexicon, beta)))

    def rate(batches):
        terms, weights = cloudpickle.loads(sent.value)
        scorer = Scorer(terms)
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                x = scorer.features(flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], ["_id", "score"])

    got = keyed(docs).mapInArrow(rate, "_id long, score double")
    return got.select(out_id(), held_out(out_id()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
