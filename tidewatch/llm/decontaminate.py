"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit verification.

A CGK walk reads a word sequence through a pointer: at each step it writes the word under the
pointer and moves on, or stays, by a random bit that depends on step and word only. Sequences a
few edits apart fall into step again, so edit distance becomes Hamming distance of what was
written. A table samples SAMPLED of a walk's STEPS written words; windows that agree with an item
in all of them, in any of the WALKS tables, are candidates. Every place of an item's window is
embedded (an edit then spoils only the places close before it), every place of every text is
looked up, and each candidate is settled by the exact word edit distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import keyed, out_id, ready
from .words import Flat, flat, hashes, mix, odd, slices, windows, words

WALKS, STEPS, SAMPLED = 4, 8, (0, 3, 5, 7)
MIN_WORDS = 8
HITS = 2
BLOCK_BYTES = 8 << 20
FILTER = 1 << 22


def walk_keys(h: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """For the window at every word: a hash of the sampled words of one CGK walk, and the last word read."""
    padded = np.concatenate([h, np.zeros(STEPS + 1, np.uint64)])
    pointer = np.arange(len(h))
    key = np.zeros(len(h), np.uint64)
    for step in range(STEPS):
        symbol = padded[pointer]
        if step in SAMPLED:
            key = key * np.uint64(odd(60 + step)) + symbol
        if step < STEPS - 1:
            pointer = pointer + (((symbol * np.uint64(odd(1000 * walk + step))) >> np.uint64(63)).astype(np.int64))
    return mix(key), pointer


@dataclass
class Item:
    item_id: int | None
    n: int
    allowed: int
    masks: dict[int, int]


class Matcher:
    """The items of one block: at most BLOCK_BYTES of text, so its tables are bounded too."""

    def __init__(self, rows: list[tuple], percent: int):
        self.items: list[Item] = []
        keys, owner, offset = ([[] for _ in range(WALKS)] for _ in range(3))
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in rows:
            w = words(flat(pa.array([text or ""])), lower=True)
            h = hashes(w)
            n = len(h)
            if not n:
                continue
            masks: dict[int, int] = {}
            for k, x in enumerate(h.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            number = len(self.items)
            self.items.append(Item(item_id, n, n * (100 - percent) // 100 if n >= MIN_WORDS else 0, masks))
            if n < MIN_WORDS:
                value, _ = windows(h, np.array([0, n]), n)
                self.short.setdefault(n, {}).setdefault(int(value[0]), []).append(number)
                continue
            for walk in range(WALKS):
                key, last = walk_keys(h, walk)
                inside = np.flatnonzero(last < n)
                keys[walk].append(key[inside])
                owner[walk].append(np.full(len(inside), number))
                offset[walk].append(inside)
        self.tables = []
        for k, o, f in zip(keys, owner, offset, strict=True):
            if not k:
                continue
            key, own, off = np.concatenate(k), np.concatenate(o), np.concatenate(f)
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(FILTER, bool)
            maybe[(key & np.uint64(FILTER - 1)).astype(np.int64)] = True
            self.tables.append((key[order], own[order], off[order], np.packbits(maybe)))

    def distance(self, item: Item, region: list[int]) -> tuple[int, int]:
        """Least word edit distance of the item to any stretch of the region, and where that ends (bit-parallel)."""
        full, top = (1 << item.n) - 1, 1 << (item.n - 1)
        up, down, score, best, end = full, 0, item.n, item.n, 0
        for at, x in enumerate(region):
            eq = item.masks.get(x, 0)
            cross = (((eq & up) + up) ^ up) | eq
            more, less = down | ~(cross | up) & full, up & cross
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            more, less = more << 1 & full, less << 1 & full
            eq |= down
            up, down = less | ~(eq | more) & full, more & eq
            if score < best:
                best, end = score, at + 1
        return best, end

    @staticmethod
    def enough(pairs: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Slots of (text, item, slot) that agree in HITS samples at least, those of the next slot included."""
        next_ = np.zeros(len(hits), bool)
        next_[:-1] = (np.diff(pairs[0]) == 0) & (np.diff(pairs[1]) == 0) & (np.diff(pairs[2]) == 1)
        both = hits + np.where(next_, np.append(hits[1:], 0), 0)
        return pairs[:, both >= HITS]

    def find(self, texts: Flat) -> list[tuple[int, int, int, int]]:
        """``(text, item, distance, end word)``, the best match of each text and item within the item's allowance."""
        w = words(texts, lower=True)
        h = hashes(w)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        places = []
        for walk, (keys, own, off, maybe) in enumerate(self.tables):
            key, _ = walk_keys(h, walk)
            low = (key & np.uint64(FILTER - 1)).astype(np.int64)
            at = np.flatnonzero(maybe[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            first, last = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            count = last - first
            row = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            places.append(np.stack([np.repeat(at, count), own[row], off[row]]))
        if places:
            at, own, off = np.concatenate(places, axis=1)
            doc = np.searchsorted(w.bounds, at, "right") - 1
            start = at - off - w.bounds[doc]
            allowed = np.array([i.allowed for i in self.items])[own]
            slot = start // (allowed + 1)
            pairs, hits = np.unique(np.stack([doc, own, slot]), axis=1, return_counts=True)
            for d, o, s in self.enough(pairs, hits).T.tolist():
                item = self.items[o]
                best = found.get((d, o), (item.allowed + 1, 0))
                if best[0] == 0:
                    continue
                begin = s * (item.allowed + 1)
                low = max(0, begin - 2 * item.allowed)
                high = begin + 3 * item.allowed + item.n + 1
                region = h[w.bounds[d] + low:min(w.bounds[d + 1], w.bounds[d] + max(high, 0))].tolist()
                if sum(map(item.masks.__contains__, region)) < item.n - item.allowed:
                    continue
                got, end = self.distance(item, region)
                if got < best[0]:
                    found[d, o] = (got, low + end)
        for n, items in self.short.items():
            value, first = windows(h, w.bounds, n)
            wanted = np.array(sorted(items), np.uint64)
            for k in np.flatnonzero(np.isin(value, wanted)).tolist():
                d = int(np.searchsorted(w.bounds, first[k], "right") - 1)
                for o in items[int(value[k])]:
                    found.setdefault((d, o), (0, int(first[k] - w.bounds[d]) + n))
        return [(d, o, distance, end) for (d, o), (distance, end) in sorted(found.items())]


def matchers(benchmark: DataFrame, percent: int):
    """Matchers of the benchmark's items, block by block: each block's size is checked before it is collected."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        matcher = Matcher([tuple(r) for r in sorted(rows, key=str)], percent)
        if matcher.items:
            yield matcher


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, distance, end_word, item_words``: items that a text holds with few enough word edits.

    A text holds an item of ``n`` words when some stretch of it is within ``n * (100 - percent) // 100``
    word edits (ASCII letters lower-cased); items of fewer than MIN_WORDS words must stand there
    exactly, and items without words match nothing. One row, the closest match, for each row and
    item. Null and empty texts hold nothing; null ids stay null; repeated rows and repeated items
    each give their rows; other columns are not read.
    """
    spark = ready(docs.sparkSession)
    own = keyed(docs)
    out = spark.createDataFrame([], "doc_id long, item_id long, distance long, end_word long, item_words long")
    for matcher in matchers(benchmark, percent):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(matcher))

        def search(batches, sent=sent):
            m = cloudpickle.loads(sent.value)
            for batch in batches:
                for part in slices(batch):
                    got = m.find(flat(part.column("text")))
                    ids = part.column("_id").to_pylist()
                    rows = [(ids[d], m.items[o].item_id, distance, end, m.items[o].n) for d, o, distance, end in got]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                         ["_id", "item_id", "distance", "end_word", "item_words"])

        got = own.mapInArrow(search, "_id long, item_id long, distance long, end_word long, item_words long")

        out = out.unionByName(got.select(out_id(), "item_id", "distance", "end_word", "item_words"))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The input's rows, unchanged, that hold no item; a filter inside the scan, without a shuffle."""
    spark = ready(docs.sparkSession)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce("text", F.lit("")).alias("_t"))
    for matcher in matchers(benchmark, percent):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(matcher))

        def clean(batches, sent=sent):
            m = cloudpickle.loads(sent.value)
            for batch in batches:
                for part in slices(batch, "_t"):
                    stay = np.ones(part.num_rows, bool)
                    stay[[d for d, *_ in m.find(flat(part.column("_t")))]] = False
                    yield part.filter(pa.array(stay))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.select("row.*")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
