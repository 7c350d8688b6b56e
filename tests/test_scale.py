"""Steps that must not grow with repeated evaluation, shared keywords or shuffled occurrences."""

from pyspark.sql import functions as F

from tidewatch.functions import patterns as P
from tidewatch.functions import text as T
from tidewatch.operators import models as M
from tidewatch.operators import prepare as Pp
from tidewatch.operators import sampling as S
from tidewatch.operators import techniques as Tq


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _counted(spark, n=40):
    """``(rows, calls)``: an input that counts how often its rows are made."""
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    return rows.mapInArrow(seen, "doc_id bigint, label int"), calls


def test_dedup_drops_unread_columns_and_keeps_order(spark):
    d = spark.createDataFrame([(2, "b", "x"), (1, None, "x"), (None, "n", "y"), (3, "c", "y"), (4, "d", "")],
                              "doc_id INT, text STRING, clean_text STRING")
    got = Pp.dedup_first_wins(d, drop_empty=True)
    assert {(r["clean_text"], r["doc_id"], r["text"]) for r in got.collect()} == {("x", 1, None), ("y", None, "n")}
    assert "min_by" not in _plan(got.select("doc_id", "clean_text"))   # the text is not shuffled


def test_balanced_rows_are_made_once(spark):
    for balance in (S.undersample, S.oversample):
        d, calls = _counted(spark)
        got = balance(d).collect()
        assert calls.value == 40 and len(got) == (20 if balance is S.undersample else 60)


def test_tags_of_shared_keywords_and_batches(spark, monkeypatch):
    rows = [(i, f"T{i}", "n", f"{'red' if i % 2 else 'blue'};k{i % 3}", f"t{i % 2}") for i in range(3000)]
    raw = spark.createDataFrame(rows, "pos INT, technique_id STRING, technique_name STRING, keywords STRING, tactic STRING")
    d = Tq.technique_dictionary(raw)
    texts = ["red", "blue k0", "none", None, "red blue", "k2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, clean_text STRING")
    want = {i: [r[1] for r in rows if t and any(k in t for k in r[3].split(";"))] for i, t in enumerate(texts)}
    monkeypatch.setattr(Tq, "TAGS_PER_BATCH", 100)
    for shard in (Tq.SHARD_BYTES, 5000):
        got = Tq.tag_techniques(docs, d, strategy="automaton", shard_bytes=shard)
        assert {r["doc_id"]: r["mitre_matches"] for r in got.collect()} == want


def test_tactics_need_no_tag_for_every_technique(spark):
    rows = [(i, f"T{i % 900}", "n", f"w{i % 7}", None if i % 5 == 0 else f"t{i % 5}") for i in range(1800)]
    raw = spark.createDataFrame(rows, "pos INT, technique_id STRING, technique_name STRING, keywords STRING, tactic STRING")
    d = Tq.technique_dictionary(raw)
    short = Tq.by_tactic(d)
    docs = spark.createDataFrame([(1, "w3"), (2, "x"), (3, "w1 w2")], "doc_id INT, clean_text STRING")
    rows_of = [{tuple(r) for r in Tq.technique_tactics(Tq.tag_techniques(docs, x), x).collect()} for x in (d, short)]
    assert rows_of[0] == rows_of[1] and (1, None) in rows_of[0] and short.count() == 5


def test_naive_bayes_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta beta w{i % 5}", i % 2) for i in range(30)], "doc_id INT, clean_text STRING, label INT")
    small = {r["doc_id"]: r["score"] for r in M.naive_bayes_scores(docs, docs).collect()}
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    large = {r["doc_id"]: r["score"] for r in M.naive_bayes_scores(docs, docs).collect()}
    assert set(small) == set(large) and all(abs(small[k] - large[k]) < 1e-9 for k in small)


def test_frequent_terms_of_few_buckets(spark, monkeypatch):
    """However few and full the buckets are, the terms are those of a full count, and ties go by term."""
    import random
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(5000)]
    counts = {w: words.count(w) for w in set(words)}
    g = spark.createDataFrame([(w,) for w in words], "term STRING")
    for buckets, per_term, n in ((1 << 21, 8, 20), (64, 1, 20), (64, 1, 40), (3, 1, 2), (64, 1, 1000), (1 << 21, 1, 1)):
        monkeypatch.setattr(M, "BUCKETS", buckets)
        monkeypatch.setattr(M, "BUCKETS_PER_TERM", per_term)
        got = {r["term"]: r["cf"] for r in M.frequent_terms(g, n).collect()}
        assert got == dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n])
    assert M.frequent_terms(g.limit(0), 5).count() == 0


def test_tfidf_deals_texts_by_size(spark, monkeypatch):
    """Parts of the long table follow the bytes of text, and no term is sorted for the norms."""
    rows = [(i % 40 if i % 7 else None, f"alpha beta w{i % 5} alpha x{i}") for i in range(60)]
    docs = spark.createDataFrame([*rows, (1, None), (2, "")], "doc_id INT, clean_text STRING")
    whole = {(r["doc_id"], r["term"]): (r["tf"], round(r["tfidf"], 9)) for r in M.tfidf_long(docs, max_features=30).collect()}
    monkeypatch.setattr(M, "TEXT_BYTES", 100)
    d = M.tfidf_long(docs, max_features=30)
    assert {(r["doc_id"], r["term"]): (r["tf"], round(r["tfidf"], 9)) for r in d.collect()} == whole
    assert d.rdd.getNumPartitions() >= 10
    window = _plan(d)[_plan(d).index("Window "):].splitlines()[1]
    assert "term" not in window


def test_weights_too_large_for_one_table(spark, monkeypatch):
    """The frequent terms' weights go to every task; only other occurrences are joined by key."""
    docs = spark.createDataFrame([(i, f"alpha beta beta w{i % 20} only{i}", i % 2, i % 3) for i in range(60)],
                                 "doc_id INT, clean_text STRING, label INT, fold INT")
    one = {r["doc_id"]: r["score"] for r in M.naive_bayes_scores(docs, docs).collect()}
    folds = {r["doc_id"]: r["score"] for r in M.naive_bayes_by_fold(docs).collect()}
    monkeypatch.setattr(M, "BROADCAST_BYTES", 400)
    g = docs.select("doc_id", F.explode(F.split("clean_text", " ")).alias("term"))
    weight = g.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("w"))
    assert {r["term"] for r in weight.filter(M._frequent(weight)).collect()} == {"alpha", "beta"}
    for want, got in ((one, M.naive_bayes_scores(docs, docs)), (folds, M.naive_bayes_by_fold(docs))):
        got = {r["doc_id"]: r["score"] for r in got.collect()}
        assert set(got) == set(want) and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_ranks_shuffle_rows_once(spark):
    d = spark.createDataFrame([(i, "t", None if i % 5 == 0 else i % 2) for i in range(50)], "doc_id INT, text STRING, label INT")
    got = S.rank_within_group(d, ["label"], 42)
    assert _plan(got).count("strategy=broadcast") == 1
    assert sorted((r["label"] or 0, r["label"] is None, r["_rank"]) for r in got.collect()) == sorted((l or 0, l is None, k) for l in (None, 0, 1) for k in range({None: 10}.get(l, 20)))


def test_vocabularies(spark):
    docs = spark.createDataFrame([(["b", "a", "c", "a"], ["x y"]), (["c", "b"], [])], "u ARRAY<STRING>, v ARRAY<STRING>")
    assert M.vocabularies(docs, ["u", "v"], 2) == [["a", "b"], ["x y"]]


def test_fit_with_counted_vocabulary(spark):
    """Where no tie is cut, the model is that of the estimators."""
    df = spark.createDataFrame([(i, f"alpha w{i % 3} beta w{i % 4} {'red' if i % 2 else 'blue'} gamma", float(i % 2), 1.0) for i in range(24)],
                               "doc_id INT, clean_text STRING, label DOUBLE, weight DOUBLE")
    probs = [{r["doc_id"]: r["prob"] for r in M.score_documents(df, M.text_pipeline(max_iter=20, train=t).fit(df)).collect()} for t in (None, df)]
    assert all(abs(probs[0][k] - probs[1][k]) < 1e-6 for k in probs[0])


def test_java_forms_of_the_patterns(spark):
    import random
    rng = random.Random(5)
    parts = ["http", "www", "h", "w", "ww", " ", "  ", "\t", "\u00a0", "\u2003", "\U0001F600", "é", "#", "@", ".", "-", "_", "'", "/", ",", "[", "com", "co", "io",
             "a.b", "10.0.2.6", "1", "CVE-2024-1234", "cve-", "Evil.com", "ips", "IDS", "red team", "\u212a", "\n", "é10.1.1.1", "f" * 33]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + [None, ""]
    d = spark.createDataFrame([(t,) for t in texts], "text STRING")
    c = F.coalesce("text", F.lit(""))
    assert d.filter(F.regexp_replace(c, P.URL_PATTERN, " ") != F.regexp_replace(c, P.URL_PATTERN_JAVA, " ")).count() == 0
    assert d.filter(F.regexp_replace(c, P.SCRUB_PATTERN_RANGES, " ") != F.regexp_replace(c, P.SCRUB_RUNS_JAVA, " ")).count() == 0
    for kind, found in T.extract_iocs("text").items():
        assert d.filter(found != F.regexp_extract_all(c, F.lit(P.IOC_PATTERNS[kind]), F.lit(0))).count() == 0
    words = P.keyword_alternation(P.CYBER_KEYWORDS)
    assert "(?=" in words
    plain = words.replace(words[words.index("(?="):words.index(")", 4) + 1], "", 1)
    assert d.filter(T.keyword_hits("text") != F.transform(F.regexp_extract_all(c, F.lit(plain), F.lit(0)), F.lower)).count() == 0


def test_fit_makes_its_vectors_once(spark):
    """Estimators read stored vectors: their steps do not hold the vocabularies, and the stored model is whole."""
    rows = [(i, f"alpha w{i % 3} beta w{i % 4} {'red' if i % 2 else 'blue'} gamma", i % 2, float(i % 5), "test" if i % 6 == 0 else "train") for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id INT, clean_text STRING, label INT, n DOUBLE, split STRING")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    model, metrics = M.fit_text_classifier(df.mapInArrow(seen, df.schema), extra_numeric=["n"], scale=True)
    assert calls.value == 48 and metrics.first()["accuracy"] == 1.0
    whole = M.text_pipeline(extra_numeric=["n"], scale=True, train=df).fit(df.filter("split = 'train'").withColumn("weight", F.lit(1.0)).withColumn("label", F.col("label").cast("double")))
    assert [type(s) for s in whole.stages] == [type(s) for s in model.stages]
    probs = [{r["doc_id"]: r["prob"] for r in M.score_documents(df, m).collect()} for m in (model, whole)]
    assert all(abs(probs[0][k] - probs[1][k]) < 1e-2 for k in probs[0])


def test_entities_take_tokens_once(spark):
    from tidewatch.operators.entities import extract_entities
    gaz = spark.createDataFrame([("a", "ORG"), ("a b", "ORG"), ("b c d", "LOC"), ("d  e", "GPE"), ("x y", "MISC")], "phrase STRING, label STRING")
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, "d  e a x y"), (4, ""), (5, None), (None, "b c d")], "doc_id INT, clean_text STRING")
    got = extract_entities(docs, gaz)
    assert {tuple(r) for r in got.collect()} == {(1, 0, "a b", "ORG"), (1, 1, "b c d", "LOC"), (2, 0, "a", "ORG"), (3, 0, "d  e", "GPE"), (3, 3, "a", "ORG"),
                                                 (None, 0, "b c d", "LOC")}
    assert _plan(got).count("posexplode") == 1


def test_naive_bayes_counts_are_made_once(spark):
    """Metrics, scores and the store read the fit's counts and test scores; none makes the rows again."""
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = [(i, f"alpha w{i % 3} {'red' if i % 2 else 'blue'}", i % 2, "test" if i % 6 < 2 else "train") for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id INT, clean_text STRING, label INT, split STRING")
    (table, documents), metrics = M.fit_naive_bayes(df.mapInArrow(seen, df.schema))
    made = calls.value
    assert metrics.first()["accuracy"] == 1.0 and {r["term"]: (r["c0"], r["c1"]) for r in table.collect()}["alpha"] == (16, 16)
    assert documents.first().asDict() == {"k0": 16, "k1": 16} and metrics.count() == 1 and calls.value == made


def test_words_by_buffer(spark, monkeypatch):
    """Words, pairs, vectors and sums from Arrow buffers are those of the tokenizer, however the texts are sliced."""
    import random
    import re

    from pyspark.ml import PipelineModel
    from tidewatch.operators import tokens as W
    rng = random.Random(7)
    parts = ["a", "ab", "AB", "b_", "9", " ", "  ", ".", "é", "\n", "ß", "\U0001F600", "xyz", "K", "alpha "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300)] + [""]
    words = [re.findall(r"[A-Za-z0-9_]{2,}", t.lower()) for t in texts]
    df = spark.createDataFrame([(i, t, float(i % 2), [i], 1.0) for i, t in enumerate(texts)], "doc_id INT, clean_text STRING, label DOUBLE, more ARRAY<INT>, weight DOUBLE")
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(W, "SLICE_BYTES", most)
        monkeypatch.setattr(W, "COUNT_BYTES", most)
        want = {}
        for ws in words:
            for k, t in [*((0, w) for w in ws), *((1, f"{a} {b}") for a, b in zip(ws, ws[1:]))]:
                want[k, t] = want.get((k, t), 0) + 1
        for buckets, per_term, n in ((1 << 20, 8, 5), (16, 1, 5), (3, 1, 2), (3, 1, 1000), (1 << 20, 8, 1000)):
            monkeypatch.setattr(W, "PAIR_BUCKETS", buckets)
            monkeypatch.setattr(M, "BUCKETS_PER_TERM", per_term)
            tops = [[t for (k, t), _ in sorted(want.items(), key=lambda x: (-x[1], x[0][1])) if k == which][:n] for which in (0, 1)]
            assert M.text_vocabularies(df, "clean_text", n) == tops
        model = M.text_pipeline(max_iter=5, vocab_size=20, train=df).fit(df)
        got = M.score_documents(df, model)
        assert "MapInArrow" in _plan(got) and got.columns == [*df.columns, "prob", "pred", "model"]
        slow = {r["doc_id"]: r["probability"][1] for r in model.transform(df).collect()}
        assert {r["doc_id"]: r["prob"] for r in got.collect()} == slow
    stages = model.stages
    stages[2].setBinary(True)   # other vectors than those of plain counts
    assert "MapInArrow" not in _plan(M.score_documents(df, PipelineModel(stages)))
