"""Every stage of the corpus pipeline on the output of the one before, against brute force."""

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text.encode().lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            kept = {r.doc_id for r in quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).where(quality.passes()).select("row.doc_id").collect()}
            assert after == {i: t for i, t in before.items() if i in kept}
        elif name == "line_dedup":
            want = brute.lines(list(before.items()), 2)
            assert after == {i: t for i, (n, gone, t) in want.items() if gone < n or n == 0}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_duplicates":
            found = brute.components(list(before.items()), 5, 80)
            assert after == {i: t for i, t in before.items() if found[i][1] == i}
        else:
            def holds(text):
                w = text.encode().lower().split()
                return any(len(w) + len(b) // 5 >= len(b) and brute.infix_distance(b, w) <= len(b) // 5 for b in bench if len(set(b) & set(w)) >= 0.8 * len(set(b)) - 1)
            assert after == {i: t for i, t in before.items() if not holds(t)}


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_stages_on_odd_tables(spark):
    """Nulls, empty, repeated and one-line texts, columns named as inner ones, and no rows at all."""
    said = " ".join(f"some{k} words" for k in range(60))
    rows = [(1, said), (2, said), (2, said), (3, None), (4, ""), (None, said + " more"), (5, "a b\nc d\na b\nc d"), (6, "one")]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3, "x") for i, t in rows], "doc_id long, text string, lang string, _n_lines int, _n_removed int, _n_runs int, _id string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        ids = [r.doc_id for r in got.collect()]
        if name == "line_dedup":
            # The copies of the one long line are gone but for the first, whose id is not null.
            assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6] and ids.count(None) == 1
        if name == "near_duplicates":
            assert ids.count(2) + ids.count(1) <= 1 and {3, 4, 5, 6} <= set(ids)
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == 7 and corpus_pipeline.packing(spark, docs.where("false"), SF).count() == 0
