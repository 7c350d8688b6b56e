"""N-gram Jaccard join with signature trees.

1. Every text becomes the set of its word shingles (64-bit hashes); texts with equal sets are one
   class from here on, so exact copies never meet each other.
2. Sets that are similar enough share a token among their first few in any fixed order (prefix
   filter). The order puts tokens that a bounded count-min sketch finds frequent last, so that a
   passage of a third of all documents makes no block.
3. In the block of a shared token, a signature tree holds the classes' bitmaps: a node has the OR
   of its members' bitmaps, the range of their set sizes and the most tokens that fell on taken
   bits. A dual traversal drops node pairs whose greatest possible overlap is too small, and pairs
   already connected. Its output, a spanning forest of the pairs that bitmaps can't rule out, is
   linear in the block.
4. Connected blocks form clusters. The sets of a cluster meet once, and the same traversal with
   the exact overlap at its leaves finds the links; their components are the result.

Blocks and clusters of more than ``BLOCK`` classes are dealt to pairs of parts, one pair a group:
nothing is dropped, and no task holds more than two parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import keyed, out_id, parts, ready, row_id
from .words import Words, flat, hashes, mix, odd, slices, windows, words

BLOCK = 4096
FAN = 16
SETS_BYTES = 64 << 20
SKETCH = 1 << 22
MOST_BITS = 1 << 15


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle of all its words."""
    h = hashes(w)
    value, first = windows(h, w.bounds, n)
    cut = np.searchsorted(first, w.bounds)
    count = w.counts()
    out = []
    for i in range(len(count)):
        if count[i] >= n:
            out.append(np.unique(value[cut[i]:cut[i + 1]]))
        elif count[i]:
            own = h[w.bounds[i]:w.bounds[i + 1]]
            out.append(mix(np.array([(own * np.array([odd(k + 5000) for k in range(len(own))], np.uint64)).sum() + np.uint64(len(own))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set, whatever its order."""
    total = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(mix(np.array([total ^ np.bitwise_xor.reduce(s)], np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def size_classes(n: int, percent: int) -> list[int]:
    """Size classes in which a set of ``n`` meets its partners: its own, and the next where a partner may be larger."""
    own = n.bit_length()
    return [own, own + 1] if 100 * n >= percent << own else [own]


def bitmap(s: np.ndarray, size_class: int) -> tuple[bytes, int]:
    """One bit a token (1 to 2 bits' room a token), and how many tokens fell on taken bits."""
    bits = min(max(64, 1 << size_class), MOST_BITS)
    flags = np.zeros(bits, bool)
    flags[(s >> np.uint64(13)) & np.uint64(bits - 1)] = True
    return np.packbits(flags).tobytes(), len(s) - int(flags.sum())


def frequent_levels(docs: DataFrame, n: int) -> np.ndarray:
    """Frequency level of each sketch cell: 0 for cells near the median, then doublings of what stands out.

    The sketch has SKETCH cells at any input size (4 MB of levels); it only orders tokens, and every order is right.
    """
    segment = 1 << 16

    def count(batches):
        total = np.zeros(SKETCH, np.int32)
        for batch in batches:
            for part in slices(batch):
                w = words(flat(part.column("text")), lower=True)
                value, _ = windows(hashes(w), w.bounds, n)
                np.add.at(total, (value & np.uint64(SKETCH - 1)).astype(np.int64), np.int32(1))
        rows = np.minimum(total, 255).astype(np.uint8).reshape(-1, segment)  # a task's cell counts on to 255
        for k in np.flatnonzero(rows.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.array([rows[k].tobytes()], pa.binary())], ["k", "cells"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("k").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(cells, np.uint8).astype(np.int64)
        for k, cells in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([cells.astype("<u4").tobytes()], pa.binary())], ["k", "cells"])

    merged = (docs.select("text").mapInArrow(count, "k long, cells binary")
              .repartition(min(64, parts(docs.sparkSession)), "k").mapInArrow(merge, "k long, cells binary"))
    total = np.zeros(SKETCH, np.uint32)
    for k, cells in merged.collect():  # SKETCH cells, whatever the input
        total[k * segment:(k + 1) * segment] = np.frombuffer(cells, "<u4")
    usual = max(1.0, float(np.median(total)))
    levels = np.zeros(SKETCH, np.uint8)
    for at in range(0, SKETCH, segment):
        above = np.maximum(total[at:at + segment] - usual - 4 * np.sqrt(usual), 0) / np.sqrt(usual)
        levels[at:at + segment] = np.floor(np.log2(1 + above))
    return levels


class Tree:
    """A signature tree over rows of bitmaps: level 0 the rows, each level above FAN nodes to one."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, excess: np.ndarray):
        self.levels = [(bits, size, size, excess)]
        while len(self.levels[-1][1]) > FAN:
            b, low, high, x = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(x, at)))


def _most_overlap(level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest possible overlap of members of nodes a and b, and the least sum of their sizes."""
    bits, low, high, excess = level
    both = np.empty(len(a), np.int64)
    step = max(1, (1 << 20) // max(1, bits.shape[1]))
    for at in range(0, len(a), step):
        both[at:at + step] = np.bitwise_count(bits[a[at:at + step]] & bits[b[at:at + step]]).sum(axis=1)
    most = np.minimum(np.minimum(high[a], high[b]), both + np.minimum(excess[a], excess[b]))
    return most, low[a] + low[b]


def traverse(tree: Tree, percent: int, link, side: np.ndarray | None = None) -> np.ndarray:
    """Roots of the rows after joining all row pairs that ``link(a, b)`` accepts and bounds allow.

    ``link`` is asked in batches, and only for pairs not yet connected. With ``side``, pairs within
    one side are left out (another group has them).
    """
    n = len(tree.levels[0][1])
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    top = len(tree.levels) - 1
    m = len(tree.levels[top][1])
    a, b = np.triu_indices(m)
    stack = [(top, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 4096:
            stack.append((level, a[4096:], b[4096:]))
            a, b = a[:4096], b[:4096]
        if level == 0:
            keep = a < b
            keep &= root[a] != root[b]
            if side is not None:
                keep &= side[a] != side[b]
            a, b = a[keep], b[keep]
        else:
            span = FAN ** level
            first = np.arange(0, n, span)
            low, high = np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)
            keep = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        most, sizes = _most_overlap(tree.levels[level], a, b)
        keep = (100 + percent) * most >= percent * sizes
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            for at in range(0, len(a), 256):
                x, y = a[at:at + 256], b[at:at + 256]
                open_ = np.array([find(p) != find(q) for p, q in zip(x.tolist(), y.tolist(), strict=True)])
                x, y = x[open_], y[open_]
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    p_root, q_root = find(p), find(q)
                    if p_root != q_root and link(p, q):
                        root[max(p_root, q_root)] = min(p_root, q_root)
            while (root[root] != root).any():
                root[:] = root[root]
        else:
            below = len(tree.levels[level - 1][1])
            i = (a[:, None] * FAN + np.arange(FAN))[:, :, None]
            j = (b[:, None] * FAN + np.arange(FAN))[:, None, :]
            i, j = (x.reshape(-1) for x in np.broadcast_arrays(i, j))
            keep = (i <= j) & (i < below) & (j < below)
            i, j = i[keep], j[keep]
            near = np.argsort((j - i) > FAN, kind="stable")
            stack.append((level - 1, i[near], j[near]))
    return np.array([find(i) for i in range(n)])


def by_key(batches, keys: list[str], least: int = 20_000):
    """Tables of whole key groups, at least ``least`` rows each, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    rows, usual = 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = _starts(table, keys)
        if len(new) > 1:
            yield table.slice(0, int(new[-1]))
            held, rows = table.slice(int(new[-1])).to_batches(), table.num_rows - int(new[-1])
            least = max(usual, 2 * rows)
        else:
            least = 2 * rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    if len(new):
        new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words."""
    data = flat(column.cast(pa.large_binary()))
    return data.data.view(np.uint64).reshape(len(data), -1) if len(data) else np.zeros((0, 1), np.uint64)


def block_edges(percent: int):
    """Spanning edges, block by block, of the pairs that bitmaps can't rule out."""
    keys = ["token", "size_class", "part_a", "part_b"]

    def edges(batches):
        for table in by_key(batches, keys):
            starts = np.append(_starts(table, keys), table.num_rows)
            count = np.diff(starts)
            cls, size, excess = (table.column(c).to_numpy() for c in ("cls", "n", "excess"))
            part, first, second = (table.column(c).to_numpy() for c in ("part", "part_a", "part_b"))
            size_class, bits = table.column("size_class").to_numpy(), table.column("bits")
            found_a, found_b = [], []
            for width in np.unique(size_class[starts[:-1]]):
                small = np.flatnonzero((count > 1) & (count <= FAN) & (size_class[starts[:-1]] == width))
                if not len(small):
                    continue
                rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in small])
                own = Tree(_matrix(bits.take(pa.array(rows))), size[rows], excess[rows]).levels[0]
                at = np.cumsum(count[small]) - count[small]
                for g in np.unique(count[small]):
                    i, j = np.triu_indices(g, 1)
                    some = at[count[small] == g]
                    for k in range(0, len(some), 4096):
                        a, b = (some[k:k + 4096, None] + i).reshape(-1), (some[k:k + 4096, None] + j).reshape(-1)
                        most, sizes = _most_overlap(own, a, b)
                        keep = (100 + percent) * most >= percent * sizes
                        found_a.append(cls[rows[a[keep]]])
                        found_b.append(cls[rows[b[keep]]])
            for k in np.flatnonzero(count > FAN):
                own = slice(int(starts[k]), int(starts[k + 1]))
                order = np.argsort(size[own], kind="stable")
                tree = Tree(_matrix(bits.slice(own.start, own.stop - own.start))[order], size[own][order], excess[own][order])
                crossed = first[own.start] != second[own.start]
                root = traverse(tree, percent, lambda p, q: True, part[own][order] if crossed else None)
                member = cls[own][order]
                away = root != np.arange(len(root))
                found_a.append(member[away])
                found_b.append(member[root[away]])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return edges


def exact_links(percent: int, n: int):
    """Links of a cluster: the traversal with the exact overlap of two sets at its leaves."""
    keys = ["cluster", "part_a", "part_b"]

    def links(batches):
        for table in by_key(batches, keys, 500):
            starts = np.append(_starts(table, keys), table.num_rows)
            cls, part = table.column("cls").to_numpy(), table.column("part").to_numpy()
            first, second = table.column("part_a").to_numpy(), table.column("part_b").to_numpy()
            found = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").slice(lo, hi - lo)]
                order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
                sets = [sets[k] for k in order]
                made = [bitmap(s, 12) for s in sets]
                tree = Tree(np.array([np.frombuffer(b, np.uint64) for b, _ in made]), np.array([len(s) for s in sets]), np.array([x for _, x in made]))

                def link(p, q, sets=sets):
                    both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    return 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both)

                root = traverse(tree, percent, link, part[lo:hi][order] if first[lo] != second[lo] else None)
                member = cls[lo:hi][order]
                away = np.flatnonzero(root != np.arange(len(root)))
                found.append(np.stack([member[away], member[root[away]]]))
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links


def dealt(rows: DataFrame, keys: list[str], share=None) -> DataFrame:
    """Rows with ``part, part_a, part_b``: a key with more rows than one group holds is dealt to pairs of parts.

    ``share`` is a row's share of what one group holds, ``1 / BLOCK`` unless it says more.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows_of_key"), F.ceil(F.sum(share if share is not None else F.lit(1 / BLOCK))).cast("int").alias("k"))
    rows = rows.join(counts.where("rows_of_key > 1"), keys)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("k")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(
        F.least(x, F.col("part")).alias("part_a"), F.greatest(x, F.col("part")).alias("part_b"))))
    return rows.withColumn("pair", other).select("*", "pair.part_a", "pair.part_b").drop("k", "pair", "rows_of_key")


def similarity_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``_id, _fp, n_shingles, component``: component is the least ``_id`` linked to a row, itself included.

    Two texts link when 100 * |A and B| >= percent * |A or B| over their sets of ``n``-word shingles
    (ASCII letters lower-cased). A text of fewer words is one shingle; a null or empty text has the
    empty set and links with nothing; rows of one id are separate documents; a null id is the least.
    """
    spark = ready(docs.sparkSession)
    own = keyed(docs)
    level = spark.sparkContext.broadcast(frequent_levels(own, n))

    def describe(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(words(flat(part.column("text")), lower=True), n)
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), part.column("_fp"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], ["_id", "_fp", "n_shingles", "cls"])

    def prefixes(batches):
        for batch in batches:
            for part in slices(batch):
                token, cls, size_class, seen = [], [], [], set()
                for s in shingle_sets(words(flat(part.column("text")), lower=True), n):
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    rank = level.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    first = s[np.lexsort((s, rank))[:length]] if rank.any() else s[:length]
                    for c in size_classes(len(s), percent):
                        token.append(first)
                        cls.append(np.full(length, key, np.int64))
                        size_class.append(np.full(length, c, np.int8))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(cls)),
                                                      pa.array(np.concatenate(size_class), pa.int8())], ["token", "cls", "size_class"])

    def signatures(batches):
        for batch in batches:
            for part in slices(batch):
                rows, seen = [], set()
                for s in shingle_sets(words(flat(part.column("text")), lower=True), n):
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)
                        rows += [(key, c, len(s), x, b) for c in size_classes(len(s), percent) for b, x in [bitmap(s, c)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                        zip(*rows, strict=True), (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                        ["cls", "size_class", "n", "excess", "bits"])

    def gather(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(words(flat(part.column("text")), lower=True), n)
                yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 ["cluster", "cls", "shingles"])

    about = own.mapInArrow(describe, "_id long, _fp long, n_shingles long, cls long").checkpoint()
    # One shuffle: the distinct and the sums below keep to the partitions of the token. Copies with
    # small changes share dozens of tokens; tokens shared by the same classes are one block.
    rows = own.mapInArrow(prefixes, "token long, cls long, size_class byte").repartition(parts(spark), "token", "size_class").distinct()
    same = Window.partitionBy("token", "size_class")
    rows = rows.select("size_class", "cls", F.count("*").over(same).alias("members"),
                       F.bit_xor(F.xxhash64("cls")).over(same).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).over(same).alias("y"))
    shared = (rows.where("members > 1").select(F.xxhash64("members", "x", "y").alias("token"), "size_class", "cls").distinct().checkpoint())
    some = shared.select("cls", "size_class").distinct()
    marks = own.mapInArrow(signatures, "cls long, size_class byte, n long, excess long, bits binary").dropDuplicates(["cls", "size_class"])
    blocks = dealt(shared, ["token", "size_class"]).join(marks.join(some, ["cls", "size_class"]), ["cls", "size_class"])
    keys = ["token", "size_class", "part_a", "part_b"]
    blocks = blocks.repartition(parts(spark), *keys).sortWithinPartitions(*keys, "cls")
    clusters = components(blocks.mapInArrow(block_edges(percent), "a long, b long"))
    clusters = clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    reps = about.where("cls is not null").groupBy("cls").agg(F.min(F.struct("_id", "_fp")).alias("r")).select("cls", "r._id", "r._fp")
    texts = own.join(reps.join(clusters, "cls"), ["_id", "_fp"]).dropDuplicates(["_id", "_fp"])
    sets = dealt(texts.mapInArrow(gather, "cluster long, cls long, shingles binary"), ["cluster"],
                 F.greatest(F.lit(1 / BLOCK), F.octet_length("shingles") / F.lit(SETS_BYTES)))
    keys = ["cluster", "part_a", "part_b"]
    sets = sets.repartition(parts(spark), *keys).sortWithinPartitions(*keys, "cls")
    linked = components(sets.mapInArrow(exact_links(percent, n), "a long, b long"))
    groups = about.where("cls is not null").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = groups.groupBy("root").agg(F.min("_id").alias("component"))
    full = groups.join(least, "root").select("_id", "_fp", "n_shingles", "component")
    return full.unionByName(about.where("cls is null").select("_id", "_fp", "n_shingles", F.col("_id").alias("component")))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows, unchanged, less all but one of each group of linked texts: the least id stays.

    Of repeated rows one stays. Texts without words are linked with nothing and stay.
    """
    names = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"])
    rows = docs.select(row_id().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_fp"), others.alias("row"), F.col("text").alias("_text"))
    found = similarity_classes(docs, n, percent)
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("_id", "_fp")).alias("k"), F.lit(True).alias("one"))
    empty = found.where("n_shingles = 0").select("_id", "_fp", F.lit(False).alias("one")).distinct()
    stay = first.select("k._id", "k._fp", "one").unionByName(empty)
    order = Window.partitionBy("_id", "_fp").orderBy(F.xxhash64("row"))
    kept = rows.join(stay, ["_id", "_fp"]).withColumn("copy", F.row_number().over(order)).where("copy = 1 or not one")
    return kept.select(*[F.col("_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    from .frames import NULL_ID, documents

    got = similarity_classes(documents(spark, sf_dir), 3, 90)
    return got.select(out_id(), "n_shingles", F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
