"""Phrase collocations by Misra-Gries summaries and an exact second pass.

Pass 1 goes level by level, one word to five. Each task counts the hashes of its n-grams and deals
the counts to hash partitions; an owner merges the summaries of its partition. A merged summary
holds more counters than the partition's mass divided by the threshold; when more are there, the
largest count that finds no room is taken off all counters, and what was taken off bounds the
error. A counter that may still reach the threshold is a survivor, so no frequent n-gram is lost.
Both parts of a frequent n-gram (without its last, without its first word) are frequent, so a
level only counts n-grams whose two parts survived the level before.

Pass 2 counts the survivors exactly, by language and words. Scores, containment and ranks are
joins and windows over that table.

Survivors go to tasks as sorted 64-bit hashes, at most ``BLOCK`` at once; where there are more, a
level or the second pass is run once for each block of them, and each n-gram belongs to one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.util import broadcast_if_small

from .frames import parts, ready, text_bytes
from .words import Flat, Words, flat, hashes, mix, slices, words

#: 64 MB of hashes in a broadcast
BLOCK = 8 << 20
#: counters of a task before it hands its summary on, and of a hash partition when all are full
TASK_COUNTERS = 1 << 21
OWNER_COUNTERS = 1 << 22
#: different phrases that a task holds before it hands its counts on
TASK_PHRASES = 1 << 20
SLICE = 8 << 20
JOIN = np.uint64(0x9E3779B97F4A7C15)
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True


def pieces(texts: Flat) -> tuple[Words, np.ndarray]:
    """The lower-cased words of all texts, and a number of the piece each is in; no piece crosses texts."""
    breaks = BREAKS[texts.data]
    w = words(Flat(np.where(breaks, 32, texts.data).astype(np.uint8), texts.offsets), lower=True)
    return w, np.cumsum(breaks)[w.start] + w.doc() if len(w.start) else np.zeros(0, np.int64)


def seeds(langs: Flat) -> np.ndarray:
    known: dict[bytes, int] = {}
    out = np.empty(len(langs), np.uint64)
    for i in range(len(langs)):
        lang = langs.text(i)
        if lang not in known:
            known[lang] = int.from_bytes(hashlib.blake2b(lang, digest_size=8).digest(), "little")
        out[i] = known[lang]
    return out


class Survivors:
    """Sorted hashes behind a bitmap that answers most misses."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.bits = max(int(8 * len(h)).bit_length(), 10)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.slot(h)] = True

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def hold(self, h: np.ndarray) -> np.ndarray:
        out = self.map[self.slot(h)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.searchsorted(self.h, h[maybe])
            at[at == len(self.h)] = 0
            out[maybe] = self.h[at] == h[maybe]
        return out


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return mix(h ^ JOIN) % np.uint64(blocks)


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each word on; the last ``n - 1`` places have none."""
    h = word
    for k in range(1, n):
        h = mix(h[:-1] * JOIN + word[k:])
    return h


def counted_grams(word: np.ndarray, piece: np.ndarray, n: int, below: Survivors | None, block: int, blocks: int) -> np.ndarray:
    """Hashes of the ``n``-grams whose parts survived (the second part is only asked where its block is at hand)."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    if n == 1:
        return word
    part = grams(word, n - 1)
    held = below.hold(part)
    first = np.flatnonzero(held[:-1] & (piece[:len(part) - 1] == piece[n - 1:]))
    second = held[first + 1]
    if blocks > 1:
        second |= block_of(part[first + 1], blocks) != np.uint64(block)
    first = first[second]
    return mix(part[first] * JOIN + word[first + n - 1])


def added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with the sum of their counts."""
    if not len(h):
        return h, n
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n[order], first)


class Summary:
    """Misra-Gries counters of one hash partition: no count is too high, none is low by more than ``off``."""

    def __init__(self, capacity: int):
        self.capacity, self.off = capacity, 0
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((h, n))
        self.held += len(h)
        if self.held > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        self.h, self.n = added(np.concatenate([self.h, *(x for x, _ in self.waiting)]), np.concatenate([self.n, *(x for _, x in self.waiting)]))
        self.waiting, self.held = [], 0
        if len(self.h) > self.capacity:
            place = len(self.n) - self.capacity - 1
            cut = int(np.partition(self.n, place)[place])
            left = self.n > cut
            self.off += cut
            self.h, self.n = self.h[left], self.n[left] - cut

    def reach(self, least: int) -> np.ndarray:
        """Hashes whose true count may be ``least`` or more."""
        self.merge()
        return self.h[self.n + self.off >= least]


def summary_row(p: int, kind: int, mass: int, h: bytes, n: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([kind], pa.int32()), pa.array([mass], pa.int64()),
                                       pa.array([h], pa.binary()), pa.array([n], pa.binary())], ["p", "kind", "mass", "h", "n"])


def task_summaries(n: int, sent, block: int, blocks: int, n_parts: int):
    """Texts to rows ``(p, kind, mass, h, n)``: kind 0 tells the mass that a partition gets, kind 1 holds its counters."""

    def flush(held):
        h, count = added(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        p = (h % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        edges = np.searchsorted(p[order], np.arange(n_parts + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[k]:edges[k + 1]]
            yield summary_row(k, 0, int(count[own].sum()), b"", b"")
            yield summary_row(k, 1, 0, h[own].tobytes(), count[own].astype(np.uint32).tobytes())

    def run(batches):
        below = Survivors(sent.value[0]) if n > 1 else None
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, most=SLICE):
                w, piece = pieces(flat(part.column("text")))
                if not len(w.start):
                    continue
                word = mix(hashes(w) ^ seeds(flat(part.column("lang")))[w.doc()])
                own, count = np.unique(counted_grams(word, piece, n, below, block, blocks), return_counts=True)
                if len(own):
                    held.append((own, count))
                    size += len(own)
                if size > TASK_COUNTERS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def merged_summaries(least: int):
    """Rows sorted by ``(p, kind)`` to the survivors of each partition; the masses come first and give the capacity."""

    def ended(summary):
        return pa.RecordBatch.from_arrays([pa.array(summary.reach(least).view(np.int64))], ["h"])

    def run(batches):
        now, mass, summary = None, 0, None
        for batch in batches:
            for p, kind, m, h, n in zip(*(batch.column(c).to_pylist() for c in ("p", "kind", "mass", "h", "n")), strict=True):
                if p != now:
                    if summary is not None:
                        yield ended(summary)
                    now, mass, summary = p, 0, None
                mass += m
                if kind:
                    summary = summary or Summary(mass // least + 1)
                    summary.add(np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64))
        if summary is not None:
            yield ended(summary)

    return run


class PhraseCounts:
    """Counts of one level's survivors in a task: by the survivor's place, and its words once."""

    def __init__(self, survivors: Survivors):
        self.of = survivors
        n = len(survivors.h)
        self.n, self.second = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        self.said: dict[int, tuple[str, str]] = {}
        # Other words under the 64 bits of a survivor.
        self.other: dict[tuple[int, int], tuple[str, str]] = {}
        self.other_n: dict[tuple[int, int], int] = {}

    def add(self, h: np.ndarray, second: np.ndarray, words_at) -> None:
        place = np.searchsorted(self.of.h, h)
        new, at = np.unique(place, return_index=True)
        fresh = self.n[new] == 0
        for k, i in zip(new[fresh].tolist(), at[fresh].tolist(), strict=True):
            self.said[k] = words_at(i)
            self.second[k] = second[i]
        same = self.second[place] == second
        self.n += np.bincount(place[same], minlength=len(self.n))
        for i in np.flatnonzero(~same).tolist():
            key = (int(place[i]), int(second[i]))
            self.other.setdefault(key, words_at(i))
            self.other_n[key] = self.other_n.get(key, 0) + 1

    def rows(self):
        """``(hash, language, phrase, count)`` of all that were met."""
        for k, (lang, phrase) in self.said.items():
            yield int(self.of.h[k]), lang, phrase, int(self.n[k])
        for key, (lang, phrase) in self.other.items():
            yield int(self.of.h[key[0]]), lang, phrase, self.other_n[key]


PHRASES = "p int, lang array<string>, m array<int>, phrase array<string>, f array<long>"


def exact_counts(longest: int, sent, first_block: bool, n_parts: int):
    """Texts to rows of surviving phrases and their counts in a task, one for each hash partition; ``m = 0`` has all words of a language."""

    def flush(counts, totals):
        found: dict[int, list] = {}
        for lang, n in totals.items():
            found.setdefault(0, []).append((lang, 0, "", n))
        for m, level in enumerate(counts, 1):
            for h, lang, phrase, n in level.rows():
                found.setdefault(h % n_parts, []).append((lang, m, phrase, n))
        for p, rows in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([list(x)], pa.list_(t)) for x, t in zip(
                zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True))], ["p", "lang", "m", "phrase", "f"])

    def run(batches):
        levels = [Survivors(h) for h in sent.value]
        counts, totals = [PhraseCounts(x) for x in levels], {}
        for batch in batches:
            for part in slices(batch, most=SLICE):
                w, piece = pieces(flat(part.column("text")))
                langs = part.column("lang").to_pylist()
                doc = w.doc()
                if not len(doc):
                    continue
                if first_block:
                    for lang, n in zip(langs, w.counts().tolist(), strict=True):
                        totals[lang] = totals.get(lang, 0) + n
                seed = seeds(flat(part.column("lang")))[doc]
                one, two = mix(hashes(w) ^ seed), mix(hashes(w, seed=2) ^ seed)
                for m in range(1, longest + 1):
                    if len(one) < m:
                        break
                    h = grams(one, m)
                    at = np.flatnonzero(levels[m - 1].hold(h) & (piece[:len(h)] == piece[m - 1:]))

                    def words_at(i, at=at, m=m, w=w, doc=doc, langs=langs):
                        j = int(at[i])
                        return langs[doc[j]], b" ".join([w.data[w.start[k]:w.end[k]].tobytes() for k in range(j, j + m)]).decode()

                    counts[m - 1].add(h[at], grams(two, m)[at], words_at)
                if sum(len(x.said) for x in counts) > TASK_PHRASES:
                    yield from flush(counts, totals)
                    counts, totals = [PhraseCounts(x) for x in levels], {}
        yield from flush(counts, totals)

    return run


def summed_counts(least: int):
    """Rows of ``exact_counts`` sorted by hash partition to the sums that reach ``least``, a partition at a time."""

    def ended(total):
        rows = [(*key, n) for key, n in total.items() if n >= least or not key[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                          ["lang", "m", "phrase", "f"])

    def run(batches):
        now, total = None, {}
        for batch in batches:
            for i, p in enumerate(batch.column("p").to_pylist()):
                if p != now:
                    if total:
                        yield ended(total)
                    now, total = p, {}
                for key in zip(*(batch.column(c)[i].as_py() for c in ("lang", "m", "phrase", "f")), strict=True):
                    total[key[:3]] = total.get(key[:3], 0) + key[3]
        if total:
            yield ended(total)

    return run


def send(spark: SparkSession, levels: list[DataFrame], block: int, blocks: int):
    """One block of the survivors of each level, sorted, as a broadcast."""
    got = []
    for level in levels:
        h = level.toArrow().column("h").to_numpy().view(np.uint64) if blocks == 1 else _of_block(level, block, blocks)
        got.append(np.sort(h))
    return spark.sparkContext.broadcast(got)


def _of_block(level: DataFrame, block: int, blocks: int) -> np.ndarray:
    def own(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h[block_of(h, blocks) == np.uint64(block)].view(np.int64))], ["h"])

    return level.mapInArrow(own, "h long").toArrow().column("h").to_numpy().view(np.uint64)


def done(got: DataFrame, sent, before: DataFrame | None) -> DataFrame:
    """``before`` and the rows of a block, written to the shared folder, so that the block's broadcast can go."""
    got = got.checkpoint()
    sent.destroy()
    return got if before is None else before.unionByName(got)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, block: int = BLOCK) -> DataFrame:
    """``lang, m, phrase, f``: phrases of 1 to ``longest`` words with at least ``least`` occurrences, words joined by one space.

    Rows with ``m = 0`` hold the number of all words of a language. A null text is empty, a null ``lang`` is ``und``;
    an empty table gives no rows; repeated rows count as often as they are there; other columns are not read.
    """
    spark = ready(docs.sparkSession)
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    # A word takes two bytes or more, so this many partitions keep every full summary within OWNER_COUNTERS on average.
    n_parts = max(parts(spark), text_bytes(own) // 2 // (least * OWNER_COUNTERS) + 1)
    levels: list[DataFrame] = []
    sizes: list[int] = []
    for m in range(1, longest + 1):
        blocks = max(1, -(-sizes[-1] // block)) if sizes else 1
        level = None
        for b in range(blocks):
            sent = send(spark, levels[-1:], b, blocks)
            got = (own.mapInArrow(task_summaries(m, sent, b, blocks, n_parts), "p int, kind int, mass long, h binary, n binary")
                   .repartition(parts(spark), "p").sortWithinPartitions("p", "kind").mapInArrow(merged_summaries(least), "h long"))
            level = done(got, sent, level)
        levels.append(level.distinct().checkpoint() if blocks > 1 else level)
        sizes.append(levels[-1].count())
    counts = None
    blocks = max(1, -(-sum(sizes) // block))
    for b in range(blocks):
        sent = send(spark, levels, b, blocks)
        counts = done(own.mapInArrow(exact_counts(longest, sent, b == 0, n_parts), PHRASES).repartition(parts(spark), "p").sortWithinPartitions("p")
                      .mapInArrow(summed_counts(least), "lang string, m int, phrase string, f long"), sent, counts)
    return counts


def scored_cuts(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, m, a, l, r, n, score`` of every phrase of two words or more, by its lowest-scoring cut.

    ``score`` is ``floor(1000 * a * n / (l * r))`` in exact decimals; of cuts with the same score the first counts.
    """
    parts_of = frequent.where("m > 0").select("lang", "phrase", "f")
    totals = broadcast_if_small(frequent.where("m = 0").select("lang", F.col("f").alias("n")))
    cuts = (frequent.where("m > 1").withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - m)")))
    both = (cuts.join(parts_of.toDF("lang", "left", "l"), ["lang", "left"]).join(parts_of.toDF("lang", "right", "r"), ["lang", "right"])
            .join(totals, "lang"))
    product = F.expr("cast(1000 * a as decimal(20, 0)) * cast(n as decimal(18, 0))")
    score = F.expr("cast(product as decimal(38, 0)) div cast(cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)) as decimal(38, 0))")
    cut = both.withColumn("product", product).withColumn("score", score.cast("long"))
    return (cut.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
            .select("lang", "phrase", "m", "a", "best.l", "best.r", "n", "best.score"))


def uncontained(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases ``(lang, phrase, m, a, ...)`` that lie in no longer one with at least ``percent`` of their occurrences."""
    word = F.split("phrase", " ")
    inner = (phrases.where("m > 2").select("lang", "a", "m", word.alias("w"))
             .select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
             .select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("at"))
             .select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "a"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    joined = phrases.join(around, ["lang", "phrase"], "left")
    return joined.where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(percent) * F.col("a"))).drop("around")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, block: int = BLOCK) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Ranked by score and occurrences from the highest down, then by phrase in byte order, so no two rows tie.
    Nulls, empty tables, repeated rows and other columns as in ``frequent_phrases``.
    """
    frequent = frequent_phrases(docs, least, longest, block)
    found = uncontained(scored_cuts(frequent), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each share of a language, then of the language: no task ranks all phrases of a large one.
    share = F.pmod(F.xxhash64("phrase"), F.lit(parts(docs.sparkSession)))
    some = found.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .frames import documents

    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
gram AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS m))),
often AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM gram GROUP BY lang, phrase HAVING count(*) >= 100),
cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM often WHERE m > 1),
cut AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
    JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
    JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrase AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS f
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_phrase i USING (lang, phrase) WHERE i.f IS NULL OR i.f < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
