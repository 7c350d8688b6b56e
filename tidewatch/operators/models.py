"""Features and trainable scorers on ``pyspark.ml``.

* ``tfidf_long`` (ADV1): ``(doc_id, term, tf, tfidf)`` with scikit-learn's
  documented defaults — tokens ``\\w\\w+`` on lower-case text, (1,2)-grams,
  the ``max_features`` most frequent terms (ties by term), smooth idf
  ``ln((1+n)/(1+df)) + 1``, L2 row norm.
* ``fit_text_classifier`` (MDL1, MDL3, ADV2, ADV4): tokenizer -> n-grams ->
  count vectors -> IDF -> (+ indicator counts) -> LogisticRegression with a
  class-weight column; evaluated on the test split (JOIN8).
* ``score_documents`` (MDL2): P(label=1) for every row.
* ``fit_embedding_classifier`` (ADV3): LogisticRegression on ``embeddings``.

The deep models of the reference are not rebuilt (see README); anything
that yields ``(doc_id, prob)`` can feed scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TOKEN_PATTERN = r"[A-Za-z0-9_]{2,}"
ROWS_PER_FIT_PARTITION = 50_000
#: of a weight table that goes to every task
BROADCAST_BYTES = 64 << 20
#: of text that one task turns into occurrences
TEXT_BYTES = 8 << 20
#: hash buckets that terms are counted into before they are counted themselves; so many a wanted term are opened at first
BUCKETS = 1 << 21
BUCKETS_PER_TERM = 8


def _grams(docs: DataFrame, text_col: str, id_col: str, ngram_range=(1, 2)) -> DataFrame:
    lo, hi = ngram_range
    t = docs.select(id_col, F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))),
                                                 F.lit(TOKEN_PATTERN), F.lit(0)).alias("_t"))
    def joined(n):
        if n == 1:
            return F.col("_t")
        parts = [F.slice("_t", k + 1, F.greatest(F.size("_t") - n + 1, F.lit(0))) for k in range(n)]
        out = parts[0]
        for p in parts[1:]:
            out = F.zip_with(out, p, lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    # one row generator for all lengths: a union would forget how the documents are dealt
    return t.select(id_col, F.explode(F.concat(*[joined(n) for n in range(lo, hi + 1)])).alias("term"))


def top_terms(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms with the largest corpus frequency ``cf`` (ties: term asc), as a top-n per task and over tasks."""
    return stats.orderBy(F.col("cf").desc(), "term").limit(n)


def frequent_terms(grams: DataFrame, n: int) -> DataFrame:
    """``(term, cf)`` of the ``n`` most frequent terms (ties: term asc), without a shuffle of all distinct terms.

    All occurrences are counted into hash buckets: a task holds and sends ``BUCKETS`` numbers at most. No term occurs
    more often than its bucket, so a bucket below the ``n``-th term's count holds none of the ``n``. The terms of the
    fullest buckets are counted; where that leaves a closed bucket in question, all that reach the ``n``-th count found
    are opened, which settles it.
    """
    grams = grams.withColumn("_bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
    loads = grams.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_load")).checkpoint()
    first = BUCKETS_PER_TERM * n
    seen = loads.orderBy(F.col("_load").desc()).limit(first).agg(F.count(F.lit(1)).alias("n"), F.min("_load").alias("least")).first()
    least = seen["least"] if seen["n"] == first else 1
    while True:
        # at most ``BUCKETS`` numbers by construction
        opened = F.broadcast(loads.filter(F.col("_load") >= least).select("_bucket"))
        top = top_terms(grams.join(opened, "_bucket").groupBy("term").agg(F.count(F.lit(1)).alias("cf")), n).checkpoint()
        last = top.agg(F.count(F.lit(1)).alias("n"), F.min("cf").alias("cf")).first()
        enough = last["cf"] if last["n"] == n else 1
        if least <= max(enough, 1):
            return top
        least = enough


def tfidf_long(docs: DataFrame, text_col: str = "clean_text", id_col: str = "doc_id",
               max_features: int = 20000, ngram_range=(1, 2)) -> DataFrame:
    """ADV1: long TF-IDF table over the top ``max_features`` terms.

    Terms are counted and cut first (``frequent_terms``). The texts are read once, then dealt by
    document, ``TEXT_BYTES`` a task: occurrences, term counts and norms of a document are made where
    its text is, with a number for each term, and no row of theirs is shuffled.
    """
    docs = docs.select(id_col, text_col).checkpoint()
    # ``top`` has at most ``max_features`` rows by construction
    top = frequent_terms(_grams(docs, text_col, id_col, ngram_range), max_features)
    top = F.broadcast(top.select("term", F.monotonically_increasing_id().alias("_t")).checkpoint())
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    dealt = docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES)), id_col)
    tf = _grams(dealt, text_col, id_col, ngram_range).join(top, "term").groupBy(id_col, "_t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("_t").agg(F.count(F.lit(1)).alias("df"))
    ndocs = docs.agg(F.count(F.lit(1)).cast("double")).scalar()   # scalar subquery
    w = tf.join(F.broadcast(df), "_t").withColumn("_n", ndocs)
    w = w.select(id_col, "_t", "tf", (F.col("tf") * (F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df")))
                                                     + F.lit(1.0))).alias("_v"))
    w = w.withColumn("_norm", F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(id_col))))
    return w.join(top, "_t").select(id_col, "term", F.col("tf").cast("bigint").alias("tf"), (F.col("_v") / F.col("_norm")).alias("tfidf"))


def vocabularies(docs: DataFrame, columns: list[str], size: int) -> list[list[str]]:
    """The ``size`` most frequent terms (ties by term) of each token column, all counted by one aggregate with map-side combine."""
    per_column = docs.select(F.posexplode(F.array(*columns)).alias("k", "_terms"))
    counts = per_column.select("k", F.explode("_terms").alias("term")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("cf"))
    counts = counts.persist()
    found = [[r["term"] for r in top_terms(counts.filter(F.col("k") == k), size).collect()] for k in range(len(columns))]
    counts.unpersist()
    if not all(found):
        raise ValueError("The vocabulary size should be > 0.")
    return found


def text_vocabularies(docs: DataFrame, text_col: str, size: int) -> list[list[str]]:
    """The ``size`` most frequent words and pairs of words (ties by term) of the texts.

    As in ``frequent_terms``, pairs are counted into buckets first, together with the words. No pair occurs more often than
    its bucket, so a second pass counts only pairs of the fullest buckets, and a third where these leave one in question.
    """
    import numpy as np

    from tidewatch.operators import tokens

    words, loads = tokens.word_counts(docs, text_col)
    single = [r["term"] for r in top_terms(words, size).collect()]
    held = loads.toArrow()   # ``PAIR_BUCKETS`` rows at most
    load = np.zeros(tokens.PAIR_BUCKETS, np.int64)
    load[np.asarray(held.column("bucket").combine_chunks())] = np.asarray(held.column("load").combine_chunks())
    first = BUCKETS_PER_TERM * size
    least = max(1, int(np.partition(load, -first)[-first])) if first < len(load) else 1
    while True:
        top = top_terms(tokens.pair_counts(docs, text_col, load >= least), size).collect()
        enough = max(1, top[-1]["cf"]) if len(top) == size else 1
        if least <= enough:
            break
        least = enough
    found = [single, [r["term"] for r in top]]
    if not all(found):
        raise ValueError("The vocabulary size should be > 0.")
    return found


def text_pipeline(text_col: str = "clean_text", label_col: str = "label", weight_col: str | None = "weight",
                  extra_numeric=(), vocab_size: int = 20000, max_iter: int = 50, scale: bool = False,
                  train: DataFrame | None = None):
    """MDL1/ADV2/ADV4 estimator: unigram + bigram TF-IDF (+ numeric features) -> LR.

    One IDF weighs both vectors. With ``train``, the vocabularies are made at once by ``text_vocabularies``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import (IDF, CountVectorizer, CountVectorizerModel, NGram, RegexTokenizer, StandardScaler,
                                    VectorAssembler)

    words = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True)
    pairs = NGram(n=2, inputCol="_tok", outputCol="_bi")
    ends = (("_tok", "_tf1"), ("_bi", "_tf2"))
    if train is None:
        vectors = [CountVectorizer(inputCol=i, outputCol=o, vocabSize=vocab_size) for i, o in ends]
    else:
        found = text_vocabularies(train, text_col, vocab_size)
        vectors = [CountVectorizerModel.from_vocabulary(v, inputCol=i, outputCol=o) for v, (i, o) in zip(found, ends, strict=True)]
    stages = [
        words, pairs, *vectors,
        VectorAssembler(inputCols=["_tf1", "_tf2"], outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_idf"),
        VectorAssembler(inputCols=["_idf", *extra_numeric], outputCol="_raw"),
    ]
    feat = "_raw"
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=False, withStd=True))
        feat = "_scaled"
    lr = LogisticRegression(featuresCol=feat, labelCol=label_col, maxIter=max_iter, regParam=1e-3)
    if weight_col:
        lr.setWeightCol(weight_col)
    stages.append(lr)
    return Pipeline(stages=stages)


def _counting(stages) -> tuple[str, list[list[str]]] | None:
    """Text column and vocabularies of stages that begin as those of ``text_pipeline``; None for any others."""
    from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer, VectorAssembler

    kinds = (RegexTokenizer, NGram, CountVectorizerModel, CountVectorizerModel, VectorAssembler)
    if len(stages) < len(kinds) or any(type(s) is not k for s, k in zip(stages, kinds)):
        return None
    words, pairs, one, two, both = stages[:len(kinds)]
    tokens = (words.getPattern(), words.getGaps(), words.getToLowercase(), words.getMinTokenLength(), pairs.getN()) == (TOKEN_PATTERN, False, True, 1, 2)
    wired = (pairs.getInputCol(), one.getInputCol(), two.getInputCol()) == (words.getOutputCol(), words.getOutputCol(), pairs.getOutputCol())
    plain = all((v.getMinTF(), v.getBinary()) == (1.0, False) for v in (one, two))
    if not (tokens and wired and plain and both.getInputCols() == [one.getOutputCol(), two.getOutputCol()]):
        return None
    return words.getInputCol(), [one.vocabulary, two.vocabulary]


def _unnamed(df: DataFrame, vector: str) -> DataFrame:
    """Without the name of every place of a vector column: each task of a fit would carry tens of thousands of them."""
    return df.withMetadata(vector, {"names": False})


def fit_text_classifier(df: DataFrame, text_col: str = "clean_text", label_col: str = "label",
                        split_col: str = "split", extra_numeric=(), scale: bool = False,
                        model_name: str = "text_lr"):
    """MDL1 + MDL3 + JOIN8: fit on ``split='train'`` with class weights, evaluate on ``'test'``.

    Returns ``(PipelineModel, metrics DataFrame)``; metrics as in ``metrics.evaluate``.
    The class weight uses **all** labels (reference behaviour).
    """
    from tidewatch.operators.metrics import evaluate
    from tidewatch.operators.sampling import with_class_weights

    from tidewatch.operators.tokens import count_vectors

    from pyspark import StorageLevel
    from pyspark.ml import Estimator, PipelineModel

    # The rows are read for weights, vocabularies and vectors: made once.
    cols = ["doc_id", text_col, label_col, split_col, *extra_numeric]
    rows = df.select(*cols).withColumn(label_col, F.col(label_col).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.count()
    d = with_class_weights(rows, label_col)
    # Iterative fitting pays a per-task cost every iteration: size partitions to
    # the data (~50k rows each, no shuffle), and never fewer tasks than cores.
    cores = df.sparkSession.sparkContext.defaultParallelism
    stages = text_pipeline(text_col, label_col, "weight", extra_numeric, scale=scale, train=d.filter(F.col(split_col) == "train")).getStages()
    # Texts become count vectors once. The estimators read these from a checkpoint, so that
    # their passes cut no texts and the tasks of their iterations carry no vocabulary.
    made = 1 + next(i for i, s in enumerate(stages) if s.hasParam("outputCol") and s.getOutputCol() == "_tf")
    own = ["doc_id", label_col, split_col, "weight", *extra_numeric]
    vectors = count_vectors(d.select(*own, text_col), text_col, _counting(stages)[1], "_tf", (text_col,)).select(*own, "_tf").checkpoint()
    rows.unpersist()
    vectors = vectors.coalesce(max(1, min(vectors.rdd.getNumPartitions(), max(cores, -(-n // ROWS_PER_FIT_PARTITION)))))
    train, rest = vectors.filter(F.col(split_col) == "train"), []
    for stage in stages[made:]:
        rest.append(stage.fit(train) if isinstance(stage, Estimator) else stage)
        train = rest[-1].transform(train)
        if stage.hasParam("outputCol"):
            train = _unnamed(train, stage.getOutputCol())
    fitted = PipelineModel(rest)
    model = PipelineModel([*stages[:made], *rest])
    test = score_documents(vectors.filter(F.col(split_col) == "test"), fitted, model_name)
    pred = test.select(F.lit(model_name).alias("model"), "doc_id",
                       F.col(label_col).cast("int").alias("y_true"), F.col("pred").alias("y_pred"),
                       F.col("prob").alias("y_score")).checkpoint()
    return model, evaluate(pred)


def score_documents(df: DataFrame, model, model_name: str = "text_lr") -> DataFrame:
    """MDL2 + SCR6 + FLT5: ``prob`` = P(label=1), ``pred`` = prob > 0.5, for all rows."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.linalg import VectorUDT

    from tidewatch.operators.scoring import binary_decision, vector_prob
    from tidewatch.operators.tokens import count_vectors

    counting = _counting(model.stages) if isinstance(model, PipelineModel) else None
    # texts become count vectors as in the fit, whose further stages read these; Arrow takes no other vectors beside them
    if counting and not any(isinstance(f.dataType, VectorUDT) for f in df.schema.fields):
        out = PipelineModel(model.stages[5:]).transform(count_vectors(df, *counting, model.stages[4].getOutputCol()))
    else:
        out = model.transform(df)
    keep = [c for c in df.columns]
    return (out.select(*keep, vector_prob("probability").alias("prob"))
               .withColumn("pred", binary_decision("prob"))
               .withColumn("model", F.lit(model_name)))


def fit_embedding_classifier(emb: DataFrame, label_col: str = "label", max_iter: int = 50,
                             seed: int = 42):
    """ADV3: multinomial LogisticRegression on ``array_to_vector(embedding)``;
    stratified 80/20 split by key. Returns (model, ``vec_id, label, prediction, split`` of every row)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from tidewatch.operators.sampling import stratified_split

    d = emb.select("vec_id", F.col(label_col).cast("double").alias("label"),
                   array_to_vector(F.col("embedding")).alias("features"))
    d = stratified_split(d, "label", 0.2, seed, "vec_id").persist()
    n = d.count()
    d = d.coalesce(max(1, min(d.rdd.getNumPartitions(), -(-n // ROWS_PER_FIT_PARTITION))))
    lr = LogisticRegression(maxIter=max_iter, regParam=1e-3, family="multinomial")
    m = lr.fit(d.filter(F.col("split") == "train"))
    p = m.transform(d).select("vec_id", "label", "prediction", "split").checkpoint()
    d.unpersist()
    return m, p


def evaluate_embedding_classifier(emb: DataFrame, label_col: str = "label"):
    """ADV3 as a result row: accuracy on the held-out fifth (precision, recall, F1 averaged over classes)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    model, p = fit_embedding_classifier(emb, label_col)
    p = p.filter(F.col("split") == "test")
    value = {m: MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=m).evaluate(p)
             for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
    row = [("embeddings_lr", value["accuracy"], value["weightedPrecision"], value["weightedRecall"], value["f1"], None, None)]
    return model, emb.sparkSession.createDataFrame(
        row, "model STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, roc_auc DOUBLE, error STRING")


def naive_bayes_table(train: DataFrame, text_col: str = "clean_text", label_col: str = "label",
                      id_col: str = "doc_id") -> DataFrame:
    """ADV2: token counts of both classes, ``(term, c0, c1)``: one aggregate over counts of slices."""
    from tidewatch.operators.tokens import class_term_counts

    return class_term_counts(train, text_col, label_col)


def label_counts(train: DataFrame, label_col: str = "label") -> DataFrame:
    """``(k0, k1)``: documents of both classes, one row."""
    return train.agg(F.count(F.when(F.col(label_col) == 0, 1)).alias("k0"), F.count(F.when(F.col(label_col) == 1, 1)).alias("k1"))


def naive_bayes_scores(docs: DataFrame, train: DataFrame, text_col: str = "clean_text", label_col: str = "label",
                       id_col: str = "doc_id") -> DataFrame:
    """ADV2: ``(doc_id, score, pred)`` of a multinomial naive Bayes (a linear model with counted weights).

    ``score`` is the log odds of label 1 with add-one smoothing; tokens that training never saw say
    nothing. The table is joined by term: broadcast after a check of its bytes; beyond it, the frequent terms are.
    """
    return naive_bayes_apply(docs, naive_bayes_table(train, text_col, label_col, id_col), label_counts(train, label_col), text_col, id_col)


def _frequent(weight: DataFrame):
    """The condition for the rows of most occurrences ``n`` that take up to ``BROADCAST_BYTES``: whole quarters of a power of two."""
    from tidewatch.operators.util import row_bytes

    level = F.floor(4 * F.log2(F.col("n") + 1))
    held, cut = 0, None
    for r in sorted(weight.groupBy(level.alias("level")).agg(F.sum(row_bytes(weight)).alias("bytes")).collect(), reverse=True):
        held += r["bytes"]
        if held > BROADCAST_BYTES:
            break
        cut = r["level"]
    return F.lit(False) if cut is None else level >= cut


def _summed(occurrences: DataFrame, weight: DataFrame, on: list[str], of: list[str], id_col: str) -> DataFrame:
    """``(id, s)``: weights ``w`` of a document's occurrences. A table of checked size goes to every task, which sums a
    document's occurrences where they are made, so one row a document is shuffled. Of a larger table its rows of most
    occurrences ``n`` do; only occurrences of other terms are counted a document and joined by key."""
    from tidewatch.operators.util import side_bytes

    weight = weight.checkpoint()
    if side_bytes(weight) <= BROADCAST_BYTES:
        hits = occurrences.join(F.broadcast(weight), on).select(id_col, F.col("w").alias("_w"))
    else:
        often = _frequent(weight)
        near = F.broadcast(weight.filter(often).select(*on, "w"))
        hits = occurrences.join(near, on).select(id_col, F.col("w").alias("_w"))
        rest = occurrences.join(near, on, "left_anti").groupBy(*of, "term").agg(F.count(F.lit(1)).alias("_n"))
        hits = hits.unionByName(rest.join(weight.filter(~often).select(*on, "w"), on).select(id_col, (F.col("_n") * F.col("w")).alias("_w")))
    return hits.groupBy(id_col).agg(F.sum("_w").alias("s"))


def _word_sums(docs: DataFrame, weight: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(id, s)``: weights ``w`` of a document's words, from one pass over the texts. A table of checked size goes to every
    task; of a larger table its rows of most occurrences ``n`` do, and counts of a document's other words are joined by key."""
    from tidewatch.operators.tokens import word_sums
    from tidewatch.operators.util import side_bytes

    weight = weight.checkpoint()
    if side_bytes(weight) <= BROADCAST_BYTES:
        hits = word_sums(docs, text_col, id_col, weight.select("term", "w").toArrow(), False).select(id_col, "s")
    else:
        often = _frequent(weight)
        rows = word_sums(docs, text_col, id_col, weight.filter(often).select("term", "w").toArrow(), True).checkpoint()
        rest = rows.filter(F.col("term").isNotNull()).select(id_col, "term", F.col("n").alias("_n"))
        rest = rest.join(weight.filter(~often).select("term", "w"), "term").select(id_col, (F.col("_n") * F.col("w")).alias("s"))
        hits = rows.filter(F.col("term").isNull()).select(id_col, "s").unionByName(rest)
    return hits.groupBy(id_col).agg(F.sum("s").alias("s"))


def naive_bayes_apply(docs: DataFrame, table: DataFrame, documents: DataFrame, text_col: str = "clean_text",
                      id_col: str = "doc_id") -> DataFrame:
    """``naive_bayes_scores`` from the counts of an earlier fit: its term table and its ``label_counts``."""
    t = table.agg(F.sum("c0"), F.sum("c1"), F.count(F.lit(1))).first()
    n0, n1, v = (int(x or 0) for x in t)
    k = documents.first()
    weight = table.select("term", (F.col("c0") + F.col("c1")).alias("n"), (F.log((F.col("c1") + 1.0) / F.lit(n1 + v + 0.0)) - F.log((F.col("c0") + 1.0) / F.lit(n0 + v + 0.0))).alias("w"))
    per = _word_sums(docs, weight, text_col, id_col)
    prior = F.log(F.lit((k["k1"] + 1.0) / (k["k0"] + 1.0)))
    return (docs.select(id_col).join(per, id_col, "left").withColumn("score", prior + F.coalesce("s", F.lit(0.0)))
            .select(id_col, "score", (F.col("score") > 0).cast("int").alias("pred")))


def naive_bayes_by_fold(folded: DataFrame, fold_col: str = "fold", text_col: str = "clean_text", label_col: str = "label",
                        id_col: str = "doc_id") -> DataFrame:
    """ADV7: ``(doc_id, fold, label, score, pred)``, every document scored by a fit on the other folds.

    All folds come from one count of ``(term, fold)``: what the other folds hold is the total less the fold's own, and
    a document only needs terms that its own fold has. ``folded`` is read several times: checkpoint it first.
    """
    g = folded.select(id_col, fold_col, label_col, F.explode(
        F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))).alias("term"))
    one = F.col(label_col) == 1
    zero = F.col(label_col) == 0
    own = g.groupBy("term", fold_col).agg(F.count(F.when(zero, 1)).alias("c0"), F.count(F.when(one, 1)).alias("c1")).checkpoint()
    total = own.groupBy("term").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    other = own.join(total, "term").select("term", fold_col, (F.col("t0") - F.col("c0")).alias("c0"), (F.col("t1") - F.col("c1")).alias("c1")).checkpoint()
    all_ = total.agg(F.sum("t0").alias("a0"), F.sum("t1").alias("a1"), F.count(F.lit(1)).alias("av"))
    lost = other.groupBy(fold_col).agg(F.count(F.when(F.col("c0") + F.col("c1") == 0, 1)).alias("gone"))
    docs = folded.groupBy(fold_col).agg(F.count(F.when(zero, 1)).alias("d0"), F.count(F.when(one, 1)).alias("d1"))
    sums = own.groupBy(fold_col).agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"))
    every = folded.agg(F.count(F.when(zero, 1)).alias("k0"), F.count(F.when(one, 1)).alias("k1"))
    # One row a fold, and tables of one row.
    fits = (docs.join(sums, fold_col, "left").join(lost, fold_col, "left").crossJoin(all_).crossJoin(every).na.fill(0)
            .select(fold_col, (F.col("a0") - F.col("s0")).alias("n0"), (F.col("a1") - F.col("s1")).alias("n1"), (F.col("av") - F.col("gone")).alias("v"),
                    F.log((F.col("k1") - F.col("d1") + 1.0) / (F.col("k0") - F.col("d0") + 1.0)).alias("prior"))).checkpoint()
    fits = F.broadcast(fits)
    weight = (other.filter("c0 + c1 > 0").join(fits, fold_col)
              .select("term", fold_col, (F.col("c0") + F.col("c1")).alias("n"), (F.log((F.col("c1") + 1.0) / (F.col("n1") + F.col("v"))) - F.log((F.col("c0") + 1.0) / (F.col("n0") + F.col("v")))).alias("w")))
    per = _summed(g, weight, ["term", fold_col], [id_col, fold_col], id_col)
    return (folded.select(id_col, fold_col, label_col).join(fits.select(fold_col, "prior"), fold_col).join(per, id_col, "left")
            .withColumn("score", F.col("prior") + F.coalesce("s", F.lit(0.0)))
            .select(id_col, fold_col, label_col, "score", (F.col("score") > 0).cast("int").alias("pred")))


def fold_metrics(folded: DataFrame, fold_col: str = "fold", label_col: str = "label") -> DataFrame:
    """ADV7: ``fold, accuracy, precision, recall, f1`` of a naive Bayes for each fold, and their means as fold ``mean``."""
    from tidewatch.operators.metrics import classification_metrics

    got = naive_bayes_by_fold(folded, fold_col, label_col=label_col)
    each = classification_metrics(got.select(F.col(fold_col).cast("string").alias("fold"), F.col(label_col).cast("int").alias("y_true"),
                                             F.col("pred").alias("y_pred")), "fold").checkpoint()
    names = ["accuracy", "precision", "recall", "f1"]
    return each.unionByName(each.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("mean").alias("fold"), *names))


def fit_naive_bayes(df: DataFrame, text_col: str = "clean_text", label_col: str = "label", split_col: str = "split",
                    model_name: str = "naive_bayes"):
    """ADV2 with the split of the other classifiers: ``((count table, label counts), metrics on the test rows)``."""
    from tidewatch.operators.metrics import evaluate
    from tidewatch.operators.scoring import sigmoid

    train, test = (df.filter(F.col(split_col) == s) for s in ("train", "test"))
    # whoever scores by them or stores them reads these counts: made once
    fitted = naive_bayes_table(train, text_col, label_col).checkpoint(), label_counts(train, label_col).checkpoint()
    got = naive_bayes_apply(test, *fitted, text_col).join(test.select("doc_id", label_col), "doc_id")
    return fitted, evaluate(got.select(
        F.lit(model_name).alias("model"), "doc_id", F.col(label_col).cast("int").alias("y_true"), F.col("pred").alias("y_pred"),
        sigmoid(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("score")))).alias("y_score")).checkpoint())
