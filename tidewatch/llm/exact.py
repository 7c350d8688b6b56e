"""Exact dedup on an extendible-hash index in shared files.

The index holds one record ``(bucket, h, places)`` for each 64-bit key of a normalised text. Its
directory has ``2 ** bits`` slots, found by a key's first bits; each slot knows how many of them its
bucket really uses (the local depth). A bucket with more than ``CAPACITY`` keys is split by further
bits, and the directory doubles as often as the deepest bucket needs. Buckets are dealt, in key
order, to owners, which write them as files to the shared folder.

Only texts whose key stands in two places or more move. Each task first joins equal texts of one
batch, byte by byte; the rest goes to the owner of its key range, which streams its buckets in key
order and keeps, for the key at hand, a chain of its different texts. So two texts that share a key
by chance stay two groups. A key of very many places is dealt to ``places / FAN`` chains first, and
only one text of each goes on, until a single chain is left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.util import broadcast_if_small

from .frames import NULL_ID, out_id, parts, ready, row_id, shared_folder
from .words import flat

CAPACITY = 1 << 18
FAN = 256
#: Slots of the directory: 16 MB as the array that goes to executors. Buckets grow beyond 2 ** 42 keys only.
MOST_BITS = 24


class Directory:
    """Which bucket a key belongs to: ``depth[first bits of the key]`` is the bucket's local depth."""

    def __init__(self, depth: np.ndarray | None = None):
        self.depth = np.zeros(1, np.uint8) if depth is None else depth

    @property
    def bits(self) -> int:
        return len(self.depth).bit_length() - 1

    def bucket(self, h: np.ndarray) -> np.ndarray:
        """First slot of the bucket of each key (a long, as Spark has it)."""
        if not self.bits:
            return np.zeros(len(h), np.int64)
        slot = (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        return slot >> (self.bits - self.depth[slot]) << (self.bits - self.depth[slot])

    def grow(self, loads: dict[int, int], capacity: int) -> bool:
        """Split every bucket of more than ``capacity`` keys, doubling the directory where it must; False if none was."""
        over = {b: int(np.ceil(np.log2(n / capacity))) for b, n in loads.items() if n > capacity and self.depth[b] < MOST_BITS}
        if not over:
            return False
        most = min(max(int(self.depth[b]) + k for b, k in over.items()), MOST_BITS)
        doublings = max(most - self.bits, 0)
        self.depth = np.repeat(self.depth, 1 << doublings)
        for b, k in over.items():
            first, now = b << doublings, int(self.depth[b << doublings])
            self.depth[first:first + (1 << (self.bits - now))] = min(now + k, MOST_BITS)
        return True

    def owners(self, loads: dict[int, int], n: int) -> np.ndarray:
        """The owner of each slot: neighbouring buckets, about as many keys for each of ``n`` owners."""
        keys = np.zeros(len(self.depth), np.int64)
        for b, x in loads.items():
            keys[b] = x
        before = np.cumsum(keys) - keys
        return (before * n // max(int(keys.sum()), 1)).clip(0, n - 1).astype(np.int32)


def build_index(keys: DataFrame, folder: str, capacity: int = CAPACITY) -> Directory:
    """Write the index of ``keys (h long, places long)``, distinct in ``h``, to ``folder``; returns its directory.

    Index files have ``owner, bucket, h, places``, sorted by key within an owner.
    """
    spark = keys.sparkSession
    directory = Directory()

    def loads() -> dict[int, int]:
        sent = spark.sparkContext.broadcast(directory.depth)

        def count(batches):
            total: dict[int, int] = {}
            at = Directory(sent.value)
            for batch in batches:
                found, n = np.unique(at.bucket(batch.column("h").to_numpy()), return_counts=True)
                for b, x in zip(found.tolist(), n.tolist(), strict=True):
                    total[b] = total.get(b, 0) + x
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

        got = keys.select("h").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        return {r.bucket: r.n for r in got}

    load = loads()
    # Buckets are the owners' shares of work: some for each owner, however few keys there are.
    capacity = max(1, min(capacity, sum(load.values()) // (8 * parts(spark))))
    while directory.grow(load, capacity):
        load = loads()
    sent = spark.sparkContext.broadcast((directory.depth, directory.owners(load, 4 * parts(spark))))

    def place(batches):
        depth, owner = sent.value
        at = Directory(depth)
        for batch in batches:
            bucket = at.bucket(batch.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(owner[bucket]), pa.array(bucket), batch.column("h"), batch.column("places")],
                                             ["owner", "bucket", "h", "places"])

    placed = keys.select("h", "places").mapInArrow(place, "owner int, bucket long, h long, places long")
    placed.repartition(parts(spark), "owner").sortWithinPartitions("bucket", "h").write.parquet(folder)
    return directory


def joined_in_batch(batches):
    """Equal texts of one batch become one entry, with the ids of its rows from the largest down."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = flat(batch.column("text"))
        h, ids = (batch.column(c).to_numpy() for c in ("h", "_id"))
        order = np.lexsort((-1 - ids, h))
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        first, group = order.copy(), np.empty(len(order), np.int64)
        chain: list[tuple[bytes, int]] = []
        count = 0
        for k, i in enumerate(order.tolist()):
            if new[k]:
                chain = []
            if k + 1 < len(order) and not new[k + 1] or not new[k]:
                own = texts.text(i)
                g = next((g for x, g in chain if x == own), None)
                if g is None:
                    chain.append((own, count))
            else:
                g = None
            if g is None:
                first[count], g = i, count
                count += 1
            group[k] = g
        by_group = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[by_group], np.arange(count + 1))
        some = pa.array(first[:count])
        members = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids[order][by_group]))
        uid = (np.int64(task) << np.int64(33)) + np.arange(made, made + count)
        made += count
        yield pa.RecordBatch.from_arrays([pa.array(uid), members, *[batch.column(c).take(some) for c in ("h", "owner", "bucket", "places", "sha", "text")]],
                                         ["uid", "ids", "h", "owner", "bucket", "places", "sha", "text"])


def chained(batches):
    """``(uid, leader)`` of entries sorted by key and chain: the first entry of its chain with the same bytes."""
    key, chain = None, []
    for batch in batches:
        texts = flat(batch.column("text"))
        leader = []
        for i, (h, salt, uid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h", "salt", "uid")), strict=True)):
            if (h, salt) != key:
                key, chain = (h, salt), []
            own = texts.text(i)
            found = next((u for x, u in chain if x == own), None)
            if found is None:
                chain.append((own, uid))
                found = uid
            leader.append(found)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(leader, pa.int64())], ["uid", "leader"])


def leaders(entries: DataFrame, most_places: int, fan: int = FAN) -> DataFrame:
    """``(uid, leader)``: all entries of one text have the same leader."""
    spark = entries.sparkSession
    known, level, left = None, entries.withColumn("left", F.col("places")), most_places
    while True:
        salted = level.withColumn("salt", F.pmod(F.xxhash64("uid"), F.ceil(F.col("left") / F.lit(fan)).cast("long")))
        linked = (salted.select("owner", "bucket", "h", "salt", "uid", "text").repartition(parts(spark), "owner", "salt")
                  .sortWithinPartitions("bucket", "h", "salt", "uid").mapInArrow(chained, "uid long, leader long").checkpoint())
        known = linked if known is None else (known.join(linked.toDF("leader", "further"), "leader", "left")
                                              .select("uid", F.coalesce("further", "leader").alias("leader")).checkpoint())
        if left <= fan:
            return known
        # One text of each chain goes on; only keys that had several chains.
        firsts = linked.where("uid = leader").select("uid")
        level = (level.where(F.col("left") > fan).join(firsts, "uid")
                 .withColumn("left", F.ceil(F.col("left") / F.lit(fan)).cast("long")))
        left = -(-left // fan)


def mark_copies(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each input row.

    Texts are equal when ``normalise(text)`` is the same, byte for byte; without ``normalise`` the text
    itself counts. Of equal texts the row with the largest doc_id stays. A null text is an empty one,
    and empty texts are equal to each other; a null doc_id is less than all others (``keep_id`` is null
    where only such rows share the text); of rows that have the largest doc_id twice exactly one is
    ``kept``. An empty table gives an empty result; other columns are not read, whatever their names.
    Texts of any length are compared whole.
    """
    spark = ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(row_id().alias("_id"), (normalise(text) if normalise else text).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    folder = shared_folder(spark, "exact-dedup")
    keys = own.groupBy("h").agg(F.count(F.lit(1)).alias("places")).checkpoint()
    build_index(keys, f"{folder}/index", capacity)
    shared = spark.read.parquet(f"{folder}/index").where("places > 1")
    most = shared.agg(F.max("places")).first()[0] or 1
    shared = broadcast_if_small(shared)
    sha = F.unhex(F.sha2("text", 256)).alias("sha")

    (own.join(shared, "h").select("_id", "h", "owner", "bucket", "places", sha, "text")
     .mapInArrow(joined_in_batch, "uid long, ids array<long>, h long, owner int, bucket long, places long, sha binary, text string")
     .write.parquet(f"{folder}/entries"))
    entries = spark.read.parquet(f"{folder}/entries")
    group = leaders(entries.drop("ids", "sha"), most, fan)
    counted = entries.select("uid", F.col("ids")[0].alias("top"), F.size("ids").cast("long").alias("n")).join(group, "uid")
    best = F.max(F.struct("top", "uid"))
    totals = counted.groupBy("leader").agg(best.alias("best"), F.sum("n").alias("group_size"))
    whose = group.join(totals, "leader").select("uid", F.col("best.top").alias("keep"), (F.col("best.uid") == F.col("uid")).alias("first"), "group_size")
    several = (entries.select("uid", "ids", "sha").join(whose, "uid")
               .select(F.posexplode("ids").alias("pos", "_id"), "keep", "group_size", (F.col("first")).alias("first"), "sha")
               .select("_id", "keep", "group_size", (F.col("first") & (F.col("pos") == 0)).alias("kept"), "sha"))
    alone = own.join(shared.select("h"), "h", "left_anti").select(
        "_id", F.col("_id").alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return alone.unionByName(several).select(
        out_id(), F.when(F.col("keep") != NULL_ID, F.col("keep")).alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Doc ids of the rows that stay: ``doc_id, text_sha256, group_size``; nulls and ties as in ``mark_copies``."""
    return mark_copies(docs, normalise).where("kept").select("doc_id", "text_sha256", "group_size")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .frames import documents

    return mark_copies(documents(spark, sf_dir).select("doc_id", "text"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
