"""Technique dictionary loading and substring tagging (DIC1 / JOIN1 / SRC5 / SRC6)."""

from pyspark.sql import functions as F

from tidewatch.operators import techniques as Tq


def _dict(spark, rows):
    raw = spark.createDataFrame(rows, "pos INT, technique_id STRING, technique_name STRING, keywords STRING")
    return Tq.technique_dictionary(raw)


def test_keyword_parsing(spark):
    d = _dict(spark, [(0, "T1", "n", " Phishing ; ;SpearPhishing Link;"), (1, "T2", "n", None)])
    got = {r["technique_id"]: r["keywords"] for r in d.collect()}
    assert got == {"T1": ["phishing", "spearphishing link"], "T2": []}


def test_missing_file_and_columns(spark, tmp_path):
    assert Tq.load_technique_dictionary(spark, str(tmp_path / "nope.csv")).count() == 0
    p = tmp_path / "bad.csv"
    p.write_text("technique_id,name\nT1,x\n")
    assert Tq.load_technique_dictionary(spark, str(p)).count() == 0
    q = tmp_path / "ok.csv"
    q.write_text('technique_id,technique_name,keywords\nT9,"Name, quoted","a b;c"\nT1,x,rat\n')
    d = Tq.load_technique_dictionary(spark, str(q))
    assert [r["technique_id"] for r in d.orderBy("pos").collect()] == ["T9", "T1"]


def _tag_both(spark, texts, rows):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, clean_text STRING")
    d = _dict(spark, rows)
    a = {r["doc_id"]: r["mitre_matches"] for r in Tq.tag_techniques(docs, d, strategy="inline").collect()}
    b = {r["doc_id"]: r["mitre_matches"] for r in Tq.tag_techniques(docs, d, strategy="vocabulary").collect()}
    return a, b


def test_substring_semantics_and_order(spark):
    texts = ["strategy rat", "c2 beacon and cmd.exe", "nothing here", "", "x spearphishing linkage",
             "a  b double", "phishing then rat"]
    rows = [(0, "T1566", "p", "phishing;spearphishing link"), (1, "T1059", "s", "powershell;cmd.exe"),
            (2, "T1071", "c", "c2;beacon"), (3, "T1219", "r", "rat"), (4, "T1566", "dup", "phish"),
            (5, "TX", "x", "a  b")]
    a, b = _tag_both(spark, texts, rows)
    assert a == b
    assert a[0] == ["T1219"]                      # substring, once per technique
    assert a[1] == ["T1059", "T1071"]             # dictionary order
    assert a[2] == [] and a[3] == []
    assert a[4] == ["T1566", "T1566"]             # duplicated id -> listed per dictionary row
    assert a[5] == ["TX"]                         # double space keyword on non-normalised text
    assert a[6] == ["T1566", "T1219", "T1566"]


def test_vocabulary_equals_inline_on_corpus(spark):
    from tidewatch.plans import corpus as C
    f = C.features(spark, "/root/testdata/sf0.001")
    d = C.tech_dict(spark)
    a = Tq.tag_techniques(f, d, strategy="inline").select("doc_id", F.col("mitre_matches").alias("a"))
    b = Tq.tag_techniques(f, d, strategy="vocabulary").select("doc_id", F.col("mitre_matches").alias("b"))
    j = a.join(b, "doc_id")
    assert j.count() == f.count()
    assert j.filter("a != b").count() == 0
    assert j.filter("size(a) > 0").count() > 0


def test_automaton_equals_inline(spark):
    texts = ["strategy rat", "c2 beacon and cmd.exe", "nothing here", "", None, "x spearphishing linkage", "a  b double", "phishing then rat", "ÉCLAIR rat"]
    rows = [(0, "T1566", "p", "phishing;spearphishing link"), (1, "T1059", "s", "powershell;cmd.exe"), (2, "T1071", "c", "c2;beacon"),
            (3, "T1219", "r", "rat;rat"), (4, "T1566", "dup", "phish"), (5, "TX", "x", "a  b"), (6, "TE", "e", "éclair"), (7, "TN", "n", None)]
    docs = spark.createDataFrame([(i, t, [1, 2], {"k": i}) for i, t in enumerate(texts)], "doc_id INT, clean_text STRING, more ARRAY<INT>, named MAP<STRING, INT>")
    d = _dict(spark, rows)
    want = {r["doc_id"]: r["mitre_matches"] for r in Tq.tag_techniques(docs, d, strategy="inline").collect()}
    one = Tq.tag_techniques(docs, d, strategy="automaton")
    assert one.columns == [*docs.columns, "mitre_matches"]
    assert {r["doc_id"]: r["mitre_matches"] for r in one.collect()} == want
    some = Tq.tag_techniques(docs, d, strategy="automaton", shard_bytes=60)   # several automata
    assert some.columns == one.columns and {r["doc_id"]: r["mitre_matches"] for r in some.collect()} == want
    assert Tq.tag_techniques(docs, d.where("false"), strategy="automaton").where("size(mitre_matches) > 0").count() == 0
    assert Tq.tag_techniques(docs.where("false"), d, strategy="automaton").count() == 0


def test_large_dictionary_and_one_long_token(spark):
    """A token of a megabyte and more keywords than the inline limit: every tag, by plain substring search."""
    import random
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    rows = [(i, f"T{i}", "n", f"{w};{w}x y") for i, w in enumerate(words)]
    texts = ["".join(rng.choice("abcdz") for _ in range(1_000_000)), " ".join(words[::7]), "z" * 50, "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, clean_text STRING")
    got = {r["doc_id"]: r["mitre_matches"] for r in Tq.tag_techniques(docs, _dict(spark, rows)).collect()}
    assert got == {i: [f"T{k}" for k, w in enumerate(words) if w in t or f"{w}x y" in t] for i, t in enumerate(texts)}


def test_dictionary_that_breaks_half_way(spark, tmp_path):
    import gzip
    whole = gzip.compress(("technique_id,technique_name,keywords\n" + "".join(f"T{i},name {i},word{i * 7919}\n" for i in range(20_000))).encode())
    p = tmp_path / "cut.csv.gz"
    p.write_bytes(whole[:len(whole) // 2])
    assert Tq.load_technique_dictionary(spark, str(p)).count() == 0


def test_only_a_missing_or_broken_file_is_an_empty_dictionary(spark, tmp_path, monkeypatch):
    """A full disk or a lost executor is no dictionary without rows; a required dictionary is never empty by failure."""
    import gzip

    import pytest
    from pyspark.errors import PySparkException

    p = tmp_path / "ok.csv"
    p.write_text("technique_id,technique_name,keywords\nT1,x,rat\n")
    bad, cut = tmp_path / "bad.csv", tmp_path / "cut.csv.gz"
    bad.write_text("technique_id,name\nT1,x\n")
    whole = gzip.compress(("technique_id,technique_name,keywords\n" + "".join(f"T{i},n {i},word{i * 7919}\n" for i in range(20_000))).encode())
    cut.write_bytes(whole[:len(whole) // 2])
    assert Tq.load_technique_dictionary(spark, str(p), required=True).count() == 1
    for path in (tmp_path / "nope.csv", bad, cut):
        assert Tq.load_technique_dictionary(spark, str(path)).count() == 0
        with pytest.raises(Exception, match=path.name):
            Tq.load_technique_dictionary(spark, str(path), required=True)

    def full(self, eager=True):
        raise PySparkException("java.io.IOException: No space left on device")

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", full)
    with pytest.raises(PySparkException, match="No space left"):
        Tq.load_technique_dictionary(spark, str(p))


def test_dictionary_queries_fail_where_their_file_does(spark, monkeypatch):
    import pytest
    from tidewatch.plans import catalog_io

    monkeypatch.setattr(catalog_io, "_to_csv", lambda df, spark, name: "/tmp/no-such-dictionary")
    for query in (catalog_io.adv10_tactics_from_file, catalog_io.dic1_large_dictionary, catalog_io.src5_dictionary_file):
        with pytest.raises(Exception, match="no-such-dictionary"):
            query(spark, "/root/testdata/sf0.001")


def test_shards_write_no_tags_to_disk(spark):
    """Several shards tag in place: no shuffle, no row a tag in a checkpoint; rows that go on in the next shard have one tag."""
    rows = [(i // 2, f"T{i % 50}", "n", f"w{i % 9};v{i % 5};u{i}") for i in range(400)]
    rows += [(250, "TL", "n", ";".join(f"k{j}" for j in range(60))), (250, None, "n", "w3")]
    d = _dict(spark, rows)
    texts = ["w3 k7 k59", "v1 u17", "k0 k30 k31", "none", None, "w3 k7 k59", "k1 k2 k3 k4 k58 u399"]
    docs = spark.createDataFrame([(1 if i in (0, 3) else i, t) for i, t in enumerate(texts)], "doc_id INT, clean_text STRING")   # ids may repeat

    def want(t):
        own = {(p, i) for p, i, _, ks in rows if t and any(k in t for k in ks.split(";"))}
        return [i for _, i in sorted(own, key=lambda x: (x[0], x[1] is not None, x[1] or ""))]

    for shard in (Tq.SHARD_BYTES, 2000, 500):
        got = Tq.tag_techniques(docs, d, strategy="automaton", shard_bytes=shard)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" in plan
        assert sorted((r["clean_text"] or "", r["doc_id"], r["mitre_matches"]) for r in got.collect()) == sorted((t or "", 1 if i in (0, 3) else i, want(t)) for i, t in enumerate(texts))


def test_dictionary_order_of_several_files(spark, tmp_path):
    """Files follow each other by name, however large they are; a column ``pos`` of the file is not its order."""
    n = 0
    for name, rows in (("part-0", 2), ("part-1", 500), ("part-2", 40)):
        lines = [f"T{n + i},n,word{n + i},{-i}" for i in range(rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["technique_id,technique_name,keywords,pos", *lines]) + "\n")
        n += rows
    d = Tq.load_technique_dictionary(spark, str(tmp_path))
    assert [(r["pos"], r["technique_id"]) for r in d.orderBy("pos").collect()] == [(i, f"T{i}") for i in range(n)]
