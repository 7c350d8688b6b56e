"""Cleaning, weak label, keyword count and IOC counts on the edge-case table."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as T

# (input, cleaned, label, distinct keywords, (ips, domains, hashes, cves)); None = row dropped
EDGE = [
    ("a#b #é x", "ab x", 0, 0, (0, 0, 0, 0)),
    ("http://x.com y z", "y z", 0, 0, (0, 0, 0, 0)),
    ("foo@evil.com hit", "foo .com hit", 0, 0, (0, 0, 0, 0)),
    ("CVE-2021-44228 cve-2020-1 cve-2020-12345678", "cve-2021-44228 cve-2020-1 cve-2020-12345678", 1, 1, (0, 0, 0, 1)),
    ("x\u001cy", "x y", 0, 0, (0, 0, 0, 0)),
    ("İẞ Ab", "ab", 0, 0, (0, 0, 0, 0)),
    ("HTTP://keep.com wwwfoo awwwx", "http //keep.com a", 0, 0, (0, 1, 0, 0)),
    ("1.2.3.4.5 999.1.1.1:80", "1.2.3.4.5 999.1.1.1 80", 0, 0, (2, 0, 0, 0)),
    ("evil[.]com a.com.cn foo_bar.com setup.info x.co y.community",
     "evil . com a.com.cn foo_bar.com setup.info x.co y.community", 0, 0, (0, 3, 0, 0)),
    ("d" * 33 + " " + "a" * 65, "d" * 33 + " " + "a" * 65, 0, 0, (0, 0, 1, 0)),
    ("#tag@men", "tag", 0, 0, (0, 0, 0, 0)),
    ("é@áb", None, None, None, None),
    ("'zero-day' sql injection ips", "'zero-day' sql injection ips", 1, 3, (0, 0, 0, 0)),
    ("phishing phishing threats", "phishing phishing threats", 1, 1, (0, 0, 0, 0)),
    ("strategy rat", "strategy rat", 0, 0, (0, 0, 0, 0)),
    ("", None, None, None, None),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def edge_df(spark):
    rows = [(i, e[0]) for i, e in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id INT, text STRING")


def test_edge_cases(edge_df):
    from tidewatch.operators import prepare as Pp
    d = edge_df.transform(Pp.add_clean_text)
    got = {r["doc_id"]: r for r in d.transform(Pp.add_label_and_features).collect()}
    for i, (_, cleaned, label, kw, iocs) in enumerate(EDGE):
        r = got[i]
        if cleaned is None:
            assert r["clean_text"] == "", (i, r["clean_text"])
            continue
        assert r["clean_text"] == cleaned, (i, r["clean_text"])
        assert r["label"] == label, (i, r["label"])
        assert r["cyber_keyword_count"] == kw, (i, r["cyber_keyword_count"])
        assert (r["num_ips"], r["num_domains"], r["num_hashes"], r["num_cves"]) == iocs, i


def test_empty_rows_dropped(edge_df):
    from tidewatch.operators import prepare as Pp
    d = Pp.dedup_first_wins(edge_df.transform(Pp.add_clean_text), drop_empty=True)
    assert d.filter(F.col("clean_text") == "").count() == 0
    assert d.count() == sum(1 for e in EDGE if e[1] is not None)


def test_label_matches_separate_label_function(edge_df):
    from tidewatch.operators import prepare as Pp
    d = edge_df.transform(Pp.add_clean_text).filter("clean_text != ''")
    a = d.select("doc_id", T.weak_label("clean_text").alias("l1"))
    b = d.transform(Pp.add_label_and_features).select("doc_id", F.col("label").alias("l2"))
    assert a.join(b, "doc_id").filter("l1 != l2").count() == 0


def test_hashtag_drop_mode(spark):
    df = spark.createDataFrame([("a #tag b",)], "text STRING")
    assert df.select(T.clean_text("text", keep_hashtag_word=False)).first()[0] == "a b"
    assert df.select(T.clean_text("text")).first()[0] == "a tag b"


def test_custom_keyword_count_is_per_keyword(spark):
    # overlapping keywords: a single alternation scan would miss one of them
    df = spark.createDataFrame([("red team blue",)], "t STRING")
    n = df.select(T.keyword_count("t", ["red team", "team blue"])).first()[0]
    assert n == 2


def test_first_row_wins(spark):
    from tidewatch.operators import prepare as Pp
    df = spark.createDataFrame([(3, "Same text"), (1, "same   TEXT"), (2, "other")], "doc_id INT, text STRING")
    d = Pp.dedup_first_wins(df.transform(Pp.add_clean_text), drop_empty=True)
    got = {r["clean_text"]: r["doc_id"] for r in d.collect()}
    assert got == {"same text": 1, "other": 2}
