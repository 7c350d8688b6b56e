"""Phrase collocations: summaries lose no frequent hash, blocks change nothing, results by brute force."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import collocations as c

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000, percent=100):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        found = []
        for p, a in cand.items():
            longer = [q for q in cand if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * cand[q] >= percent * a for q in longer):
                continue
            cuts = [(Fraction(1000 * a * n[lang], count[p[:k]] * count[p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=8), st.integers(2, 9))
def test_summary_keeps_what_is_frequent(lists, least):
    mass = sum(map(len, lists))
    summary = c.Summary(mass // least + 1)
    for x in lists:
        h, n = np.unique(np.array(x, np.uint64), return_counts=True)
        summary.add(h, n)
        summary.merge()
    true = Counter(v for x in lists for v in x)
    assert {v for v, n in true.items() if n >= least} <= set(summary.reach(least).tolist())
    assert all(n <= true[int(h)] for h, n in zip(summary.h, summary.n)) and summary.off < least
    assert len(summary.h) <= summary.capacity


@pytest.mark.parametrize("block", [c.BLOCK, 40])
def test_documents(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    want = brute(rows, 12)
    assert len(want) > 100 and result(c.collocations(docs.repartition(5), least=12, block=block)) == want


def test_small_summaries_and_slices(spark, monkeypatch):
    """Task summaries handed on early and merges at a full capacity lose nothing."""
    monkeypatch.setattr(c, "TASK_COUNTERS", 50)
    monkeypatch.setattr(c, "SLICE", 2000)
    monkeypatch.setattr(c, "TASK_PHRASES", 40)
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(300)) + ".", rng.choice(["x", "y"])) for _ in range(12)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert result(c.collocations(docs, least=6, top=30)) == brute(rows, 6, top=30)
    assert result(c.collocations(docs, least=6, longest=3, percent=60)) == brute(rows, 6, longest=3, percent=60)


def test_phrases_that_share_a_hash_are_told_apart():
    counts = c.PhraseCounts(c.Survivors(np.array([5, 9], np.uint64)))
    said = ["a", "b", "a", "c", "b", "b"]
    h, second = np.array([5, 5, 5, 9, 5, 5], np.uint64), np.array([1, 2, 1, 1, 2, 2], np.uint64)
    for part in (slice(0, 3), slice(3, 6)):
        counts.add(h[part], second[part], lambda i, part=part: ("en", said[part][i]))
    assert sorted(counts.rows()) == [(5, "en", "a", 2), (5, "en", "b", 3), (9, "en", "c", 1)]


def test_nulls_ties_long_texts_and_clashing_names(spark):
    said = "New York, new york. NEW\tYORK! É É é new york\nnew  york"
    rows = [(said, None), (said, "und"), (None, "en"), ("", "en"), (" .,\n", None), ("a b " * 40_000, "en"), ("a b a", ""), ("a b", ""), ("a b", "")]
    docs = spark.createDataFrame([(t, g, 1, "x", 2.0) for t, g in rows], "text string, lang string, m int, phrase string, f double").repartition(4)
    got = result(c.collocations(docs, least=3))
    assert got == brute(rows, 3) and any(r[0] == "und" and r[2] == "new york" and r[3] == 10 for r in got)
    assert c.collocations(docs.where("false"), least=3).count() == 0


def test_scores_beyond_64_bits(spark):
    n, a, l, r = 10**17, 10**15 + 7, 10**16 + 1, 10**15 + 9
    rows = [("en", 0, "", n), ("en", 1, "p", l), ("en", 1, "q", r), ("en", 2, "p q", a)]
    got = c.scored_cuts(spark.createDataFrame(rows, "lang string, m int, phrase string, f long")).first()
    assert got.score == 1000 * a * n // (l * r) and (got.l, got.r) == (l, r)
