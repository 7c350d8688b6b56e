"""Language-model scores from a hierarchical Pitman-Yor model.

Three levels of Chinese restaurants: a root over words; under it a restaurant for each of CLASSES
hashes of a word's last two letters (one more is the start of a text); under each class SLOTS
restaurants, one by the hash of the whole word before, that share the class as their parent. So a word
never seen before still has a context, the restaurants' totals stay a vector of bounded size, and the
dishes, their counts and their tables grow with the corpus.

Words are dealt to buckets by hash; a bucket holds all counts of its words. Seatings are sampled
there by Gibbs: a customer drawn at random leaves, and sits down again at a new table or an old
one in proportion to what the model gives each (table indicators: only customers and tables are
kept, weighed by generalized Stirling numbers). Dishes of more than EXACT customers are seated
again in growing blocks. Tables of a restaurant are customers of its parent.
Restaurant totals, CONTEXTS numbers and some more, are shared between buckets after each round and held fixed
within one. In the last round each kept sample gets the totals of its own seating; seeds are fixed, so
the same seatings come back when scores are asked for, and each sample's probabilities add up to 1 in
every context. Predictive probabilities are averaged over the kept samples.

Scores travel without the words: a unit of documents asks each bucket for its distinct (word,
context) pairs in sorted order and gets numbers back in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keyed, out_id, parts, ready, text_bytes
from .words import Flat, distinct, flat, hashes, mix, slices, words

CLASSES, SLOTS = 255, 256
PARENTS, CONTEXTS = CLASSES + 1, (CLASSES + 1) * SLOTS
START = CLASSES * SLOTS
UNIT_BYTES, BUCKET_BYTES = 12 << 20, 16 << 20
EXACT = 96
ROUNDS, BURN, KEPT, STEPS = 1, 2, 3, 3
STRENGTH = 1.0
END = np.uint64(0x656E64206F662074)


def tokens(texts: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(token hash, context, first token of each text)``; every text ends with the end token."""
    w = words(texts, lower=True)
    h = hashes(w)
    last = w.data[w.end - 1].astype(np.uint64) + (w.data[np.maximum(w.end - 2, w.start)].astype(np.uint64) << np.uint64(8))
    own = mix(last + np.uint64(99)) % np.uint64(CLASSES) * np.uint64(SLOTS) + mix(h + np.uint64(98)) % np.uint64(SLOTS)
    n = w.counts()
    first = np.append(0, np.cumsum(n + 1))
    at = np.arange(len(h)) + w.doc()
    token = np.full(first[-1], END, np.uint64)
    token[at] = h
    context = np.full(first[-1], START, np.uint16)
    context[at + 1] = own.astype(np.uint16)
    return token, context, first


def pair_table(token: np.ndarray, context: np.ndarray, n: np.ndarray | None = None):
    """Distinct words, and the distinct (word, context) pairs: word index, context, count, and each token's pair."""
    value, _, back = distinct(token)
    code = back * CONTEXTS + context
    pair, _, where = distinct(code)
    count = np.bincount(where, None if n is None else n, len(pair)).astype(np.int64)
    return value, pair // CONTEXTS, (pair % CONTEXTS).astype(np.uint16), count, where


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(token ^ np.uint64(0x5DEECE66D)) % np.uint64(buckets)).astype(np.int64)


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S[c, t]: generalized Stirling numbers, S[c + 1, t] = S[c, t - 1] + (c - t * discount) * S[c, t]."""
    out = np.full((most + 2, most + 2), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 2)
    for c in range(most + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + out[c]
        out[c + 1] = np.logaddexp(np.append(-np.inf, out[c, :-1]), stay)
    return out


def reseat(rng, c: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes after all their customers sat down anew, ever larger blocks at once."""
    t, i = np.ones(len(c)), np.ones(len(c))
    while (i < c).any():
        step = np.where(i < c, np.minimum(np.maximum(1, np.floor(i * 0.1)), c - i), 0)
        new = rng.poisson(step * weight / (weight + np.maximum(i - discount * t, 1e-9)))
        t += np.minimum(new, step)
        i += step
    return t.astype(np.int64)


def gibbs(rng, c: np.ndarray, t: np.ndarray, weight: np.ndarray, discount: float, table: np.ndarray) -> np.ndarray:
    """One sweep: STEPS customers of each dish leave and sit down again. ``weight``: of a new table."""
    t = t.copy()
    big = np.flatnonzero(c > EXACT)
    if len(big):
        t[big] = reseat(rng, c[big].astype(float), weight[big], discount)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    own, now, log_weight = c[some], t[some], np.log(weight[some])
    for _ in range(STEPS):
        # Who opened the only table leaves none behind, and so opens it again: S[c, 0] = 0.
        left = now - (rng.random(len(own)) * own < now)
        new = log_weight + table[own, left + 1] + np.log(left + 1)
        old = table[own, left] + np.log(own - left)
        chance = 1 / (1 + np.exp(np.clip(old - new, -50, 50)))
        now = left + ((rng.random(len(own)) < chance) & (left < own))
    t[some] = now
    return t


class Bucket:
    """Seatings of one bucket's words, given the totals of all restaurants."""

    def __init__(self, at: np.ndarray, context: np.ndarray, n: np.ndarray, n_words: int, totals: dict, seed: int):
        self.at, self.context, self.n, self.n_words, self.totals = at, context.astype(np.int64), n, n_words, totals
        self.rng = np.random.default_rng([seed, 17])
        self.tables = np.minimum(n, 1 + np.floor(np.log2(np.maximum(n, 1))).astype(np.int64))
        self.stirling = [stirling(totals[x]) for x in ("discount", "class_discount", "root_discount")]
        # Pairs come by word and context, so those of one word and class stand together: a dish of the class.
        code = at * PARENTS + self.context // SLOTS
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        self.dish = np.cumsum(new) - 1
        self.dish_code = code[new]
        self.dish_at, self.parent = self.dish_code // PARENTS, self.dish_code % PARENTS
        self.class_tables = np.ones(len(self.dish_code), np.int64)
        self.root_tables = np.ones(n_words, np.int64)

    def class_customers(self) -> np.ndarray:
        return np.bincount(self.dish, self.tables, len(self.dish_code)).astype(np.int64)

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.dish_at, self.class_tables, self.n_words).astype(np.int64)

    def root(self, t: dict) -> np.ndarray:
        """The root's probability of each word."""
        return (self.root_customers() - t["root_discount"] * self.root_tables + t["root_new"] * t["known"]) / t["root_n"]

    def middle(self, t: dict) -> np.ndarray:
        """The classes' probability of each of their dishes."""
        seated = self.class_customers() - t["class_discount"] * self.class_tables
        return (seated + t["class_new"][self.parent] * self.root(t)[self.dish_at]) / t["class_n"][self.parent]

    def sweep(self) -> None:
        t = self.totals
        self.tables = gibbs(self.rng, self.n, self.tables, t["new"][self.context] * self.middle(t)[self.dish], t["discount"], self.stirling[0])
        sent = self.class_customers()
        self.class_tables = gibbs(self.rng, sent, np.minimum(self.class_tables, sent), t["class_new"][self.parent] * self.root(t)[self.dish_at],
                                  t["class_discount"], self.stirling[1])
        sent = self.root_customers()
        self.root_tables = gibbs(self.rng, sent, np.minimum(self.root_tables, sent), np.full(self.n_words, t["root_new"] * t["known"]),
                                 t["root_discount"], self.stirling[2])

    def sums(self) -> np.ndarray:
        """Tables of each context's restaurant, customers and tables of each class, customers and tables of the root."""
        return np.concatenate([np.bincount(self.context, self.tables, CONTEXTS), np.bincount(self.parent, self.class_customers(), PARENTS),
                               np.bincount(self.parent, self.class_tables, PARENTS), [self.class_tables.sum(), self.root_tables.sum()]])

    def kept(self):
        """The place of each kept sample, while the bucket's seating is that sample."""
        for k in range(BURN + KEPT):
            self.sweep()
            if k >= BURN:
                yield k - BURN


def probabilities(samples: list, word: np.ndarray, dish: np.ndarray, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Averaged predictive probability of requests; ``word``, ``dish`` and ``pair`` are indexes, -1 where unknown.

    A sample: its totals, the tables of the pairs, the probabilities of words at the root and of dishes in their
    classes, and the counts of the pairs.
    """
    total, parent = np.zeros(len(word)), context // SLOTS
    for t, tables, root, middle, n in samples:
        base = np.where(word >= 0, root[word] if len(root) else 0, t["root_new"] * t["known"] / t["root_n"])
        above = np.where(dish >= 0, middle[dish] if len(middle) else 0, t["class_new"][parent] * base / t["class_n"][parent])
        seated = np.where(pair >= 0, np.maximum(n[pair] - t["discount"] * tables[pair], 0) if len(n) else 0, 0)
        total += (seated + t["new"][context] * above) / (t["n"][context] + STRENGTH)
    return total / len(samples)


def found(codes: np.ndarray, word: np.ndarray, width: int, own: np.ndarray) -> np.ndarray:
    """Where ``word * width + own`` stands among sorted codes, -1 where it does not or the word is unknown."""
    if not len(codes):
        return np.full(len(word), -1)
    wanted = word * width + own
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where((word >= 0) & (codes[at] == wanted), at, -1)


SUMS = CONTEXTS + 2 * PARENTS + 2


def learned(totals: dict, sums: np.ndarray) -> dict:
    """The restaurants' totals that follow from their table counts (``Bucket.sums``)."""
    tables, class_n, class_tables, (root_n, root_tables) = np.split(sums, [CONTEXTS, CONTEXTS + PARENTS, CONTEXTS + 2 * PARENTS])
    return totals | {"new": STRENGTH + totals["discount"] * tables, "class_n": STRENGTH + class_n,
                     "class_new": STRENGTH + totals["class_discount"] * class_tables, "root_n": STRENGTH + root_n,
                     "root_new": STRENGTH + totals["root_discount"] * root_tables}


def training(identity: Column) -> Column:
    """Whether crc32 of the id's text leaves another remainder than 2 by 7; a null id trains."""
    return F.coalesce(F.pmod(F.crc32(identity.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


MODEL = "bucket long, words binary, pairs binary, context binary, n binary"


def pairs_of(at: np.ndarray, n_words: int) -> np.ndarray:
    """How many pairs each word has: pairs come in the order of their words, so that tells the word of each."""
    return np.bincount(at, minlength=n_words).astype(np.uint32)


def counts(own: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: its training words, sorted, and their counts in each context."""

    def rows(bucket: int, value, at, context, n):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in (
            value, pairs_of(at, len(value)), context, n.astype(np.uint32))], ["bucket", "words", "pairs", "context", "n"])

    def count(batches):
        for batch in batches:
            for part in slices(batch, most=UNIT_BYTES):
                token, context, _ = tokens(flat(part.column("text")))
                value, at, context, n, _ = pair_table(token, context)
                bucket = bucket_of(value, buckets)
                for b in np.unique(bucket).tolist():
                    own = bucket == b
                    keep = own[at]
                    yield rows(b, value[own], (np.cumsum(own) - 1)[at[keep]], context[keep], n[keep])

    def merge(table: pa.Table) -> pa.Table:
        got = [[np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in (("words", np.uint64), ("pairs", np.uint32), ("context", np.uint16), ("n", np.uint32))]
        token = np.concatenate([np.repeat(w, k) for w, k in zip(got[0], got[1], strict=True)])
        value, at, context, n, _ = pair_table(token, np.concatenate(got[2]), np.concatenate(got[3]))
        return pa.Table.from_batches([rows(table.column("bucket")[0].as_py(), value, at, context, n)])

    return own.where("train").select("text").mapInArrow(count, MODEL).groupBy("bucket").applyInArrow(merge, MODEL)


def _model(table: pa.Table) -> tuple:
    value, pairs, context, n = (np.frombuffer(table.column(c)[0].as_buffer(), t) if table.num_rows else np.zeros(0, t)
                                for c, t in (("words", np.uint64), ("pairs", np.uint32), ("context", np.uint16), ("n", np.uint32)))
    return value, np.repeat(np.arange(len(value)), pairs), context, n


def added(numbers: DataFrame, n: int) -> np.ndarray:
    """The sums of ``x`` by place ``k`` as a vector of ``n`` numbers, a number fixed by CONTEXTS."""
    got = numbers.groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(n)
    out[got.column("k").to_numpy()] = got.column("x").to_numpy()
    return out


def _numbers(out: np.ndarray) -> pa.RecordBatch:
    k = np.flatnonzero(out)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(out[k].astype(float))], ["k", "x"])


def first_totals(model: DataFrame) -> dict:
    """Customers of each restaurant, counts of counts for the discounts, and N and V."""

    def tally(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                value, at, context, n = _model(pa.Table.from_batches([batch.slice(k, 1)]))
                word = np.bincount(at, n, len(value))
                code = at * PARENTS + context // SLOTS
                dish = np.diff(np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])) if len(code) else code
                out = np.concatenate([np.bincount(context, n, CONTEXTS), [len(value)], *([(x == 1).sum(), (x == 2).sum()] for x in (n, dish, word))])
                yield _numbers(out)

    got = added(model.mapInArrow(tally, "k long, x double"), CONTEXTS + 7)
    n, v = got[:CONTEXTS], got[CONTEXTS]
    discounts = [float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95)) for one, two in got[CONTEXTS + 1:].reshape(3, 2)]
    totals = {"n": n, "N": int(n.sum()), "V": int(v), "known": 1 / (v + 1),
              **dict(zip(("discount", "class_discount", "root_discount"), discounts, strict=True))}
    in_class = n.reshape(PARENTS, SLOTS).sum(axis=1)
    return learned(totals, np.concatenate([n * 0.5, in_class * 0.5, in_class * 0.25, [n.sum() * 0.25, v]]))


def next_totals(model: DataFrame, totals: dict) -> dict:
    """Totals after each bucket's Gibbs sweeps under the totals before."""

    def sweep(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                value, at, context, n = _model(pa.Table.from_batches([batch.slice(k, 1)]))
                seats = Bucket(at, context, n.astype(np.int64), len(value), totals, batch.column("bucket")[k].as_py())
                for _ in range(BURN):
                    seats.sweep()
                out = seats.sums()
                yield _numbers(out)

    return learned(totals, added(model.mapInArrow(sweep, "k long, x double"), SUMS))


def kept_totals(model: DataFrame, totals: dict) -> list[dict]:
    """Totals of each kept sample, of the seatings that every bucket has in it under ``totals``."""

    def sweep(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                value, at, context, n = _model(pa.Table.from_batches([batch.slice(k, 1)]))
                seats = Bucket(at, context, n.astype(np.int64), len(value), totals, batch.column("bucket")[k].as_py())
                yield _numbers(np.concatenate([seats.sums() for _ in seats.kept()]))

    got = added(model.mapInArrow(sweep, "k long, x double"), KEPT * SUMS)
    return [learned(totals, x) for x in got.reshape(KEPT, -1)]


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A null or empty text is its end token alone; a null doc_id stays null and trains; repeated rows
    count and score each; where nothing trains, the base scores 0 and every token is unknown; other
    columns are not read.
    """
    spark = ready(docs.sparkSession)
    size = text_bytes(docs)
    buckets, units = (max(1, -(-size // k)) for k in (BUCKET_BYTES, UNIT_BYTES))
    identity = F.when(F.col("_id") != -(2**63), F.col("_id"))
    own = keyed(docs).withColumn("train", training(identity))
    model = counts(own, buckets).checkpoint()
    totals = first_totals(model)
    for _ in range(ROUNDS):
        totals = next_totals(model, totals)
    kept = kept_totals(model, totals)

    def ask(batches_of_unit: pa.Table) -> pa.Table:
        token, context, _ = tokens(flat(batches_of_unit.column("text")))
        value, at, context, _, _ = pair_table(token, context)
        bucket = bucket_of(value, buckets)
        out = []
        for b in np.unique(bucket).tolist():
            mine = bucket == b
            out.append((b, value[mine].tobytes(), pairs_of(at, len(value))[mine].tobytes(), context[mine[at]].tobytes()))
        unit = batches_of_unit.column("unit")[0].as_py()
        columns = list(zip(*out, strict=True))
        return pa.table({"bucket": pa.array(columns[0], pa.int64()), "unit": pa.array([unit] * len(out), pa.int64()), "words": pa.array(columns[1], pa.binary()),
                         "pairs": pa.array(columns[2], pa.binary()), "context": pa.array(columns[3], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        empty = pa.table({"unit": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "c": pa.array([], pa.binary()), "p": pa.array([], pa.binary())})
        if not asked.num_rows:
            return empty
        value, at, context, n = _model(known)
        n, code = n.astype(np.int64), at * CONTEXTS + context
        word_count = np.bincount(at, n, len(value)).astype(np.int64)
        seats = Bucket(at, context, n, len(value), totals, asked.column("bucket")[0].as_py())
        samples = [(kept[k], seats.tables, seats.root(kept[k]), seats.middle(kept[k]), n) for k in seats.kept()]
        out = []
        for k in range(asked.num_rows):
            word, pairs, ctx = (np.frombuffer(asked.column(c)[k].as_buffer(), t) for c, t in (("words", np.uint64), ("pairs", np.uint32), ("context", np.uint16)))
            where = np.repeat(np.arange(len(word)), pairs)
            place = np.minimum(np.searchsorted(value, word), max(len(value) - 1, 0))
            place = np.where(value[place] == word, place, -1) if len(value) else np.full(len(word), -1)
            ctx = ctx.astype(np.int64)
            dish = found(seats.dish_code, place[where], PARENTS, ctx // SLOTS)
            pair = found(code, place[where], CONTEXTS, ctx)
            c = np.where(place >= 0, word_count[place] if len(value) else 0, 0)
            p = probabilities(samples, place[where], dish, pair, ctx)
            out.append((c.astype(np.uint32).tobytes(), np.log10(p).astype(np.float32).tobytes()))
        return pa.table({"unit": asked.column("unit"), "bucket": asked.column("bucket"), "c": pa.array([x for x, _ in out], pa.binary()), "p": pa.array([x for _, x in out], pa.binary())})

    def rate(unit: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["_id", "train", "n_tokens", "n_known", "base_score", "score"]
        if not unit.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        token, context, first = tokens(flat(unit.column("text")))
        value, at, context, _, where = pair_table(token, context)
        bucket = bucket_of(value, buckets)
        c, p = np.zeros(len(value), np.int64), np.zeros(len(at))
        for b, own_c, own_p in zip(*(answers.column(k) for k in ("bucket", "c", "p")), strict=True):
            mine = bucket == b.as_py()
            c[mine] = np.frombuffer(own_c.as_buffer(), np.uint32)
            p[mine[at]] = np.frombuffer(own_p.as_buffer(), np.float32)
        token_c = c[at][where]
        n = np.diff(first)
        total = np.log10(totals["N"] + totals["V"] + 1)
        return pa.table({"_id": unit.column("_id"), "train": unit.column("train"), "n_tokens": pa.array(n), "n_known": pa.array(np.add.reduceat((token_c > 0).astype(np.int64), first[:-1])),
                         "base_score": pa.array(np.add.reduceat(np.log10(token_c + 1.0), first[:-1]) - n * total),
                         "score": pa.array(np.add.reduceat(p[where], first[:-1]))})

    # The same exchange of the texts serves the questions and, with the answers, the scores.
    placed = own.withColumn("unit", F.pmod(F.xxhash64("_id", "_fp"), F.lit(units))).repartition(parts(spark), "unit")
    asked = placed.groupBy("unit").applyInArrow(ask, "bucket long, unit long, words binary, pairs binary, context binary")
    answers = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, "unit long, bucket long, c binary, p binary")
    got = placed.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        rate, "_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return got.select(out_id(), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(totals["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_pitman_yor(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return score(documents(spark, sf_dir))
