"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import decontaminate, jaccard, lines, packing, pitman_yor, quality, substring, suffixes, token_files, toxicity

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
SAID = " ".join(f"t{k}" for k in range(120)) + "\nsecond line here\nthird line here"
ROWS = [(1, SAID), (2, SAID), (2, SAID), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one"), (8, LONG), (None, SAID), (9, "two words"),
        (9, "two words but other text under the same id"), (10, "é ü\x00   𝔘nicode")]


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns carry the names that the operators use inside."""
    rows = [(i, t, "a", 1.5, None, "k", i, "x", -1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, _id string, row double, _fp string, kept string, n_words long, _text string, failed int").repartition(4)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, " ".join(f"t{k}" for k in range(40, 60))), (1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words")], "item_id long, text string")


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_jaccard(odd, empty):
    got = result(jaccard.similarity_classes(odd, 3, 90), "_id", "n_shingles", "component")
    least = min(r[0] for r in got)
    by_id = {}
    for i, n, c in got:
        by_id.setdefault(i, set()).add((n, c))
    assert len(got) == len(ROWS)
    assert {c for i in (1, 2, least) for _, c in by_id[i]} == {least}
    assert by_id[3] == {(0, 3)} and by_id[4] == {(0, 4)} and by_id[7] == {(1, 6)} and {c for _, c in by_id[9]} == {9}
    assert jaccard.similarity_classes(empty, 3, 90).count() == 0
    kept = jaccard.keep_one_of_each(odd, 3, 90)
    assert kept.columns == odd.columns
    assert result(kept, F.coalesce("doc_id", F.lit(0))) == sorted([(0,), (3,), (4,), (5,), (6,), (8,), (9,), (10,)], key=str)
    assert jaccard.keep_one_of_each(empty, 3, 90).count() == 0


def test_suffixes(odd, empty):
    got = result(suffixes.remove_repeated_bytes(odd), "doc_id", "n_bytes", "n_removed")
    size = len(SAID.encode())
    assert got.count((2, size, size)) == 2 and (None, size, 0) in got and (1, size, size) in got
    assert (3, 0, 0) in got and (4, 0, 0) in got and len(got) == len(ROWS)
    plain = [(i, t) for i, t in ROWS if i in (3, 4, 5, 6, 7, 8, 10)]
    assert {r[0]: r[2] for r in got if r[0] in (8, 10)} == {i: x[1] for i, x in brute.repeated_bytes(plain).items() if i in (8, 10)}
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_decontamination(odd, empty, bench):
    got = result(decontaminate.matches(odd, bench), "doc_id", "item_id", "distance")
    assert got == sorted([(1, 0, 0), (2, 0, 0), (2, 0, 0), (None, 0, 0), (6, 3, 0), (6, 3, 0), (7, 3, 0), (7, 3, 0), (9, None, 0), (9, None, 0)], key=str)
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and result(kept, "doc_id") == sorted([(3,), (4,), (5,), (8,), (10,)], key=str)
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.keep_clean(empty, bench).count() == 0
    assert decontaminate.matches(odd, bench.where("false")).count() == 0 and decontaminate.keep_clean(odd, bench.where("false")).count() == len(ROWS)


def test_pitman_yor(odd, empty):
    got = result(pitman_yor.score(odd), "doc_id", "n_tokens", "n_known", "score", "base_score")
    assert len(got) == len(ROWS) and {r[1] for r in got if r[0] in (3, 4, 5)} == {1}
    assert all(r[3] < 0 and r[4] < 0 for r in got)
    assert pitman_yor.score(empty).count() == 0
    # 4 is held out (crc32 of "4" leaves 2 by 7 or not): a table in which nothing trains
    import zlib

    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = pitman_yor.score(odd.where("doc_id = 6").withColumn("doc_id", F.lit(alone).cast("long"))).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 2, 0, 0, 0.0)


def test_token_files(spark, odd, empty):
    folder = token_files.shared_folder(spark, "test-edge")
    got = token_files.token_file_digest(spark, folder, token_files.write_token_files(odd, folder, n_parts=3)).orderBy("start").collect()
    assert len(got) == len(ROWS) and got[0].doc_id is None and got[0].start == 0
    assert [r.doc_id for r in got[1:]] == sorted(i for i, _ in ROWS if i is not None)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    folder = token_files.shared_folder(spark, "test-none")
    assert token_files.token_file_digest(spark, folder, token_files.write_token_files(empty, folder)).count() == 0


def test_lines(odd, empty):
    got = lines.remove_repeated_lines(odd)
    assert got.columns[:len(odd.columns)] == odd.columns
    rows = result(got, "doc_id", "_n_lines", "_n_removed", "text")
    assert rows.count((2, 3, 3, "")) == 2 and (1, 3, 3, "") in rows and (None, 3, 0, SAID) in rows
    assert (3, 0, 0, None) in rows and (4, 0, 0, "") in rows and (5, 0, 0, " \n\t ") in rows and (7, 1, 0, "one") in rows
    assert lines.remove_repeated_lines(empty).count() == 0


def test_one_long_line_is_a_run(spark):
    """Copies of a line of 50 words go, those of 49 words stay; columns named as the measures pass through."""
    long, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(49))
    rows = [(1, long), (2, long), (3, f"own start\n{long}\nown end"), (4, short), (5, short), (6, f"{long}  "), (7, f"{short}\n{long}"), (8, f"{long}\n{long}")]
    docs = spark.createDataFrame([(*r, "a", "b", 7) for r in rows], "doc_id long, text string, _n_lines string, _n_removed string, _n_runs int")
    got = lines.remove_repeated_lines(docs)
    assert got.columns == [*docs.columns, "__n_lines", "__n_removed", "__n_runs"]
    want = brute.lines(rows, 2)
    assert {r[0]: (r[5], r[6], r[1]) for r in got.collect()} == want
    assert [want[i][1] for i in range(1, 9)] == [0, 1, 1, 0, 0, 0, 1, 2]


def test_quality(odd, empty):
    got = result(quality.ledger(odd), "row.doc_id", "n_words", "n_lines", "n_repeat_words")
    assert len(got) == len(ROWS) and (3, 0, 0, 0) in got and (5, 0, 0, 0) in got and (8, 30_000, 1, 0) in got
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and result(kept, "doc_id") == sorted([(1,), (2,), (2,), (8,), (None,)], key=str)
    assert quality.ledger(empty).count() == 0 and quality.ablations(quality.ledger(empty)).count() == 0


def test_toxicity(odd, empty, labels):
    got = result(toxicity.score(odd, labels), "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(ROWS) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in got)
    assert not [r for r in got if r[0] is None and r[1]]
    assert toxicity.score(empty, labels).count() == 0 and toxicity.score(odd, labels.where("false")).count() == len(ROWS)


def test_substring(odd, empty):
    got = result(substring.remove_repeated_windows(odd), "doc_id", "n_words", "n_removed")
    n = len(SAID.split())
    assert got.count((2, n, n)) == 2 and (1, n, n) in got and (None, n, 0) in got and (3, 0, 0) in got and (8, 30_000, 0) in got
    assert len(got) == len(ROWS) and substring.remove_repeated_windows(empty).count() == 0


def test_packing(odd, empty):
    got = packing.pack_documents(odd).toPandas()
    assert got[got.piece == 0].shape[0] == len(ROWS) and got.groupby("sequence_id").length.sum().max() <= 2048
    assert (got[got.doc_id == 8].sort_values("piece").start.diff().dropna() == 2048).all()
    assert got.doc_id.isna().sum() >= 1 and packing.pack_documents(empty).count() == 0
