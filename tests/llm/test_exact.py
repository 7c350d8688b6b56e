"""Exact dedup: the index's directory, chains of one key, and whole results against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row, sorted; of equal largest ids one is kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i), reverse=True)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_directory_doubles_and_splits():
    rng = np.random.default_rng(3)
    keys = rng.integers(-2**63, 2**63, 5000)
    keys[:3000] = keys[:3000] >> 6  # crowded around zero: the buckets there are deeper
    keys = np.unique(keys)
    d = exact.Directory()

    def loads():
        found, n = np.unique(d.bucket(keys), return_counts=True)
        return dict(zip(found.tolist(), n.tolist()))

    while d.grow(loads(), 64):
        pass
    load = loads()
    assert max(load.values()) <= 64 and len(set(d.depth[list(load)].tolist())) > 1
    for b in load:  # all slots of a bucket know the same depth
        own = d.depth[b:b + (1 << (d.bits - int(d.depth[b])))]
        assert (own == own[0]).all()
    owner = d.owners(load, 7)
    assert (np.diff(owner) >= 0).all() and owner.min() == 0 and owner.max() == 6
    order = np.argsort(keys.view(np.uint64))
    assert (np.diff(d.bucket(keys[order])) >= 0).all()


def test_chains_tell_texts_of_one_key_apart(spark):
    """All entries share one key: five texts, many copies, chains of at most three entries at first."""
    rng = random.Random(5)
    rows = [(k, 0, 0, 77, 60, f"text {rng.randrange(5)}") for k in range(60)]
    entries = spark.createDataFrame(rows, "uid long, owner int, bucket long, h long, places long, text string").repartition(5)
    got = {r.uid: r.leader for r in exact.leaders(entries, 60, fan=3).collect()}
    text = {r[0]: r[5] for r in rows}
    assert len(got) == 60 and len(set(got.values())) == 5
    assert all(text[u] == text[v] for u, v in got.items())


def test_joined_in_batch_tells_texts_of_one_key_apart(spark):
    rows = [(k, 77, 0, 0, 9, b"", f"text {k % 3}") for k in range(9)] + [(20, 78, 0, 0, 2, b"", "alone")]
    docs = spark.createDataFrame(rows, "_id long, h long, owner int, bucket long, places long, sha binary, text string").coalesce(1)
    got = docs.mapInArrow(exact.joined_in_batch, "uid long, ids array<long>, h long, owner int, bucket long, places long, sha binary, text string")
    assert sorted((r.text, r.ids) for r in got.collect()) == [
        ("alone", [20]), ("text 0", [6, 3, 0]), ("text 1", [7, 4, 1]), ("text 2", [8, 5, 2])]


def test_hot_copies_nulls_and_ties(spark):
    """A third of the rows is one text, a fifth null; small buckets and chains."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, "hot" if r.doc_id % 3 == 0 else None if r.doc_id % 5 == 0 else r.text) for r in docs.collect()]
    rows += [(None, "hot"), (None, "lone"), (None, "lone"), (7, "x"), (7, "x"), (8, ""), (9, " "), (9, "é" * 300_000), (10, "é" * 300_000)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(exact.mark_copies(made, capacity=20, fan=3)) == brute(rows)
    kept = exact.keep_one_of_each(made)
    assert kept.count() == len({t or "" for _, t in rows})


def test_normalised(spark):
    rows = [(1, "A b"), (2, "a  b"), (3, "a c"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.mark_copies(docs, lambda t: F.regexp_replace(F.lower(t), r"\s+", " "))
    assert result(got) == brute([(1, "a b"), (2, "a b"), (3, "a c"), (4, "")])


def test_empty_table_and_clashing_names(spark):
    rows = [(1, "a", 5, "x", None), (2, "a", 5, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, _id string, uid int")
    assert result(exact.mark_copies(docs)) == brute([(1, "a"), (2, "a")])
    assert exact.mark_copies(docs.where("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), rng.choice(["", "a", "b", "a" * 40, "a" * 41, None, f"u{k}"])) for k in range(120)]
    assert result(exact.mark_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), capacity=4, fan=2)) == brute(rows)
