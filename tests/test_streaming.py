"""The stateless stages give the same rows on a stream as in batch."""

from tidewatch.operators import prepare as Pp
from tidewatch.streaming import start_feature_stream


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/documents.parquet").schema
    q = start_feature_stream(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                             path_glob="documents.parquet")
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = (spark.read.parquet(f"{src}/documents.parquet").transform(Pp.add_clean_text)
             .transform(Pp.drop_empty).transform(Pp.add_label_and_features))
    cols = ["doc_id", "clean_text", "label", "cyber_keyword_count", "num_ips", "num_domains", "num_hashes", "num_cves"]
    assert got.count() == batch.count()
    assert got.select(cols).exceptAll(batch.select(cols)).count() == 0
