"""Technique tagging (DIC1 / JOIN1): substring match of dictionary keywords.

A technique id is emitted for a document when **any** of its keywords is a
substring of the lower-cased text (no word boundary), once per dictionary
row, in dictionary order; no match gives ``[]``.

Three exact strategies:

* ``inline`` — small dictionaries (at most ``INLINE_KEYWORD_LIMIT``
  keywords, checked with a count) are folded into one literal array and
  tested per row with ``filter``/``exists``/``contains``: a pure projection,
  no join and no shuffle.
* ``automaton`` — any dictionary size, linear in the text and in the tags. The dictionary is cut, in its order, into
  shards of at most some ``SHARD_BYTES`` of distinct keywords (checked by one aggregate). Each has an Aho-Corasick
  automaton, which goes to the workers with the rows that list each keyword, as arrays. A worker runs the automata of all
  shards over a batch of texts, one in memory at a time, and keeps the numbers of the keywords found; then it
  makes the tags, in dictionary order, for as many documents as have ``TAGS_PER_BATCH``. Nothing is shuffled and no tag
  is on disk before the result is.
* ``vocabulary`` — any dictionary size, for workers without ``ahocorasick``. A keyword of *m* space-separated
  tokens that occurs in whitespace-normalised text lies inside *m*
  consecutive tokens, so it is a substring of some *m*-token shingle. The
  distinct shingles of the corpus (a map-side-combined aggregate that grows
  sub-linearly) are cut into substrings of exactly the keyword lengths and
  equi-joined with the keywords; the matching shingles are equi-joined back
  to the documents' shingles. Every step is an equi-join or aggregate;
  cost is linear in text, independent of the number of keywords.
"""

from __future__ import annotations

import logging
import sys
from importlib.util import find_spec

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, LongType, StringType, StructField,
                               StructType)

# Functions of this module that run in workers go there by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

log = logging.getLogger("tidewatch")

INLINE_KEYWORD_LIMIT = 64   # each of them is a scan of the text
#: keyword bytes of one automaton (its nodes take some 50 times as many)
SHARD_BYTES = 4 << 20
#: listing rows' bytes of one automaton, as a multiple of its keyword bytes; tags of one Arrow batch
LISTED_TIMES, TAGS_PER_BATCH = 16, 1 << 20

DICT_SCHEMA = StructType([
    StructField("pos", LongType()),
    StructField("technique_id", StringType()),
    StructField("technique_name", StringType()),
    StructField("keywords", ArrayType(StringType())),
])


def parse_keywords(col) -> F.Column:
    """SRC6: ``;``-split, trim, lower-case, drop blanks; NULL -> ``[]``."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def technique_dictionary(raw: DataFrame, pos_col: str | None = "pos") -> DataFrame:
    """Raw ``(technique_id, technique_name, keywords STRING)`` -> DICT_SCHEMA.

    ``pos`` keeps dictionary order; when the source has none, the scan order
    (``monotonically_increasing_id``) is used.
    """
    pos = (F.col(pos_col) if pos_col and pos_col in raw.columns
           else F.monotonically_increasing_id())
    more = [F.col("tactic").cast("string")] if "tactic" in raw.columns else []
    return raw.select(pos.cast("bigint").alias("pos"),
                      F.col("technique_id").cast("string"),
                      F.col("technique_name").cast("string"),
                      parse_keywords("keywords").alias("keywords"), *more)


def _broken_file(error: BaseException) -> bool:
    """Whether a read failed because the file itself ends too early or is damaged."""
    said = f"{error}{getattr(error, 'java_exception', None) or ''}"
    return any(f"java.{name}" in said for name in ("io.EOFException", "util.zip.ZipException", "util.zip.DataFormatException"))


def load_technique_dictionary(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """SRC5: CSV dictionary; a missing file, missing columns or a file that breaks half way give an empty table and a warning.

    Nothing else does: a lost executor, a full disk or any other failure is raised. With ``required`` these
    three are raised too, so that documents without tags mean that no keyword was found.
    A folder's files follow each other by name. The rows are read into a checkpoint: later uses see the rows that were checked.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException, PySparkException

    from tidewatch.session import ensure_checkpoint_dir
    from tidewatch.sources.text_sources import number_rows

    ensure_checkpoint_dir(spark)

    def empty(why: str) -> DataFrame:
        log.warning("technique dictionary %s: %s", path, why)
        return spark.createDataFrame([], DICT_SCHEMA)

    try:
        raw = (spark.read.option("header", True).option("multiLine", True)
               .option("escape", '"').csv(path))
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty("no such file")
    except (PySparkException, Py4JJavaError) as e:   # the header's file is read at once
        if required or not _broken_file(e):
            raise
        return empty("the file is broken")
    missing = {"technique_id", "technique_name", "keywords"} - set(raw.columns)
    if missing:
        why = f"no column {', '.join(sorted(missing))}"
        if required:
            raise ValueError(f"{path}: {why}")
        return empty(why)
    try:
        # the rows' order is that of the files' names; a scan takes the largest file first
        own = [c for c in ("technique_id", "technique_name", "keywords", "tactic") if c in raw.columns]
        return technique_dictionary(number_rows(raw.select(*own), "pos")).checkpoint()
    except (PySparkException, Py4JJavaError) as e:
        if required or not _broken_file(e):
            raise
        return empty("the file is broken")


def _keywords_long(dictionary: DataFrame) -> DataFrame:
    return (dictionary.select("pos", "technique_id", F.explode("keywords").alias("kw"))
            .filter(F.col("kw") != ""))


def tag_techniques(docs: DataFrame, dictionary: DataFrame, text_col: str = "clean_text",
                   id_col: str = "doc_id", out_col: str = "mitre_matches",
                   strategy: str = "auto", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``out_col ARRAY<STRING>`` of technique ids in dictionary order."""
    n_kw = None
    if strategy == "auto":
        n_kw = _keywords_long(dictionary).limit(INLINE_KEYWORD_LIMIT + 1).count()
    if strategy == "inline" or (strategy == "auto" and n_kw <= INLINE_KEYWORD_LIMIT):
        return _tag_inline(docs, dictionary, text_col, out_col)
    if strategy == "automaton" or (strategy == "auto" and find_spec("ahocorasick")):
        return _tag_automaton(docs, dictionary, text_col, out_col, shard_bytes)
    return _tag_vocabulary(docs, dictionary, text_col, id_col, out_col)


def _tag_inline(docs, dictionary, text_col, out_col):
    # the dictionary becomes part of the plan: right at any size, meant for up to some thousand keywords
    rows = dictionary.orderBy("pos").select("technique_id", "keywords").collect()
    rows = [r for r in rows if r["keywords"]]
    if not rows:
        return docs.withColumn(out_col, F.array().cast("array<string>"))
    # lower-case once into a column; every test below reads it
    d = docs.withColumn("_lt", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    text = F.col("_lt")
    # one CASE per dictionary row, in dictionary order; array_compact drops misses.
    # Plain expressions (no lambdas) so the whole test is code-generated.
    tests = []
    for r in rows:
        cond = None
        for k in r["keywords"]:
            c = text.contains(F.lit(k))
            cond = c if cond is None else (cond | c)
        tests.append(F.when(cond, F.lit(r["technique_id"])))
    return d.withColumn(out_col, F.array_compact(F.array(*tests))).drop("_lt")


def _matcher(keywords: list[str]):
    """The automaton of distinct keywords; each of its words holds its number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, keyword in enumerate(keywords):
        found.add_word(keyword, number)
    if keywords:
        found.make_automaton()
    return found


def _hit_rows(hit, listed, n_rows: int):
    """Sorted rows that list a keyword of the numbers ``hit``; ``listed``: by keyword, the sorted rows that list it."""
    import numpy as np

    if len(hit) < 2:
        return listed[hit[0]] if len(hit) else np.empty(0, np.int32)
    own = [listed[number] for number in hit]
    if 8 * sum(map(len, own)) < n_rows:
        return np.unique(np.concatenate(own))
    marked = np.zeros(n_rows, bool)
    for rows in own:
        marked[rows] = True
    return np.flatnonzero(marked).astype(np.int32)


def _listed(kw: DataFrame):
    """``(keywords, rows of each, pos of each row, id of each row)`` of the distinct rows of a shard of checked size; rows in dictionary order."""
    import numpy as np

    t = kw.toArrow()
    t = t.sort_by([(c, "ascending") for c in ("pos", "technique_id", "kw")], null_placement="at_start").combine_chunks()
    pos, ids, words = (t.column(c).combine_chunks() if t.num_rows else t.column(c) for c in ("pos", "technique_id", "kw"))
    if not t.num_rows:
        return [], [], [], []

    def codes(column):
        own = column.dictionary_encode(null_encoding="encode")
        return np.asarray(own.indices), own.dictionary

    p, i = codes(pos)[0], codes(ids)[0]
    first = np.r_[True, (p[1:] != p[:-1]) | (i[1:] != i[:-1])]
    row = (np.cumsum(first) - 1).astype(np.int32)
    number, keywords = codes(words)
    order = np.argsort(number, kind="stable")
    cuts = np.cumsum(np.bincount(number, minlength=len(keywords)))[:-1]
    places = np.flatnonzero(first)
    return keywords.to_pylist(), np.split(row[order], cuts), pos.take(places), ids.take(places)


def _shards(kw: DataFrame, shard_bytes: int) -> list[DataFrame]:
    """The dictionary's rows in parts of its order, of some ``shard_bytes`` of distinct keywords and ``LISTED_TIMES`` that of rows.

    A row with many keywords may lie in several.
    """
    kw = kw.select("pos", "technique_id", "kw").distinct()
    own = F.octet_length("kw") + 16
    listing = kw.agg(F.sum(own + F.coalesce(F.octet_length("technique_id"), F.lit(0))).alias("all"), F.count(F.lit(1)).alias("n")).first()
    size = kw.select("kw").distinct().agg(F.sum(own)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes), -(-(listing["all"] or 0) // (LISTED_TIMES * shard_bytes)))
    while shards > 1:
        dealt = kw.repartitionByRange(shards, "pos", "technique_id", "kw")
        dealt = dealt.withColumn("_shard", F.spark_partition_id()).checkpoint()
        per_word = dealt.groupBy("_shard", "kw").agg(F.count(F.lit(1)).alias("n"), F.sum(own + F.coalesce(F.octet_length("technique_id"), F.lit(0))).alias("all"))
        most = per_word.groupBy("_shard").agg(F.sum(own).alias("words"), F.sum("all").alias("all")).agg(F.max("words").alias("words"), F.max("all").alias("all")).first()
        # ranges are dealt by a sample of the rows, not by bytes
        if most["words"] <= 2 * shard_bytes and most["all"] <= 2 * LISTED_TIMES * shard_bytes or shards >= listing["n"]:
            return [dealt.filter(F.col("_shard") == k).drop("_shard") for k in range(shards)]
        shards = min(2 * shards, listing["n"])
    return [kw]


def _tag_automaton(docs, dictionary, text_col, out_col, shard_bytes=SHARD_BYTES):
    kw = _keywords_long(dictionary).checkpoint()
    sc, sent, last = docs.sparkSession.sparkContext, [], None
    for shard in _shards(kw, shard_bytes):   # the driver holds one
        keywords, listed, pos, ids = _listed(shard)
        if not len(ids) and sent:
            continue
        # a row of the shard before that goes on here has one tag, not two
        goes_on = last is not None and last == (pos[0].as_py(), ids[0].as_py())
        last = (pos[-1].as_py(), ids[-1].as_py()) if len(ids) else last
        sent.append((sc.broadcast((keywords, [len(rows) for rows in listed])), sc.broadcast((listed, ids)), goes_on))
    return _tag_in_place(docs, sent, text_col, out_col)


def _read(sent, keep: bool):
    """A broadcast value; without ``keep`` the worker's copy in memory goes with the caller's, and is read again from its file."""
    value = sent.value
    if not keep and getattr(sent, "_path", None):
        del sent._value
    return value


def _tag_in_place(docs, sent, text_col, out_col):
    """Tags by the automata of all shards ``sent``, in a map over the documents."""
    import pyarrow as pa

    import numpy as np

    one = len(sent) == 1
    arrow = pa.list_(pa.string())

    def found(words, texts):
        """By text, the numbers of the shard's keywords in it, and an upper bound of its tags."""
        keywords, automaton, lengths = words
        hits, bound = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            hit = np.array(sorted({number for _, number in automaton.iter(text)}) if text and keywords else [], np.int32)
            hits.append(hit)
            bound[k] = lengths[hit].sum()
        return hits, bound

    def words_of(shard):
        keywords, lengths = _read(shard[0], one)
        return keywords, _matcher(keywords), np.array(lengths, np.int64)

    def tags_of(hits, begin, end):
        """The tags of texts ``begin`` to ``end``, shard after shard, as one array of lists."""
        each, before = [], [False] * (end - begin)
        for (_, rows, goes_on), own in zip(sent, hits):
            listed, ids = _read(rows, one)
            each.append([])
            for k in range(begin, end):
                r = _hit_rows(own[k], listed, len(ids))
                again = goes_on and before[k - begin]
                if again and len(r) and r[0] == 0:
                    r = r[1:]
                before[k - begin] = bool(len(r)) and r[-1] == len(ids) - 1 or again and len(ids) == 1
                each[-1].append(r)
            if not one:   # tags instead of the rows of a shard that goes
                each[-1] = [ids.take(pa.array(r)) if len(r) else pa.array([], pa.string()) for r in each[-1]]
        per_text = [sum(len(shard[k]) for shard in each) for k in range(end - begin)]
        ends = pa.array(np.cumsum([0, *per_text]).astype(np.int32))
        if one:
            rows = np.concatenate(each[0])
            values = ids.take(pa.array(rows)) if len(rows) else pa.array([], pa.string())
        else:
            values = pa.concat_arrays([shard[k] for k in range(end - begin) for shard in each])
        return pa.ListArray.from_arrays(ends, values.cast(pa.string())).cast(arrow)

    def tag(batches):
        words = words_of(sent[0]) if one else None
        for batch in batches:
            at = batch.schema.get_field_index("_lt")
            keep = [i for i in range(batch.num_columns) if i != at]
            texts = batch.column(at).to_pylist()
            per_shard = [found(words if one else words_of(shard), texts) for shard in sent]
            hits, bound = [x for x, _ in per_shard], np.sum([x for _, x in per_shard], axis=0)
            begin = 0
            while begin < len(texts):   # a text may have as many tags as the dictionary has rows
                end, n = begin + 1, bound[begin]
                while end < len(texts) and n + bound[end] <= TAGS_PER_BATCH:
                    n += bound[end]
                    end += 1
                own = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in keep], tags_of(hits, begin, end)], [*[batch.schema.names[i] for i in keep], out_col])
                begin = end

    lowered = docs.drop(out_col).withColumn("_lt", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    schema = docs.drop(out_col).withColumn(out_col, F.lit(None).cast("array<string>")).schema
    return lowered.mapInArrow(tag, schema)


def _tag_vocabulary(docs, dictionary, text_col, id_col, out_col):
    kw = (_keywords_long(dictionary)
          .withColumn("m", F.size(F.split("kw", " ")))
          .withColumn("len", F.length("kw")))
    # (m, len) shapes of the keywords: at most (#tokens x #lengths) rows
    shapes = kw.select("m", "len").distinct().collect()
    lens_by_m: dict[int, list[int]] = {}
    for r in shapes:
        lens_by_m.setdefault(int(r["m"]), []).append(int(r["len"]))
    if not lens_by_m:
        return docs.withColumn(out_col, F.array().cast("array<string>"))

    # read for the vocabulary of each length and again for the documents' shingles: made once
    slim = docs.select(id_col, text_col).checkpoint()
    if set(docs.columns) == {id_col, text_col}:
        docs = slim.select(*docs.columns)
    toks = slim.select(F.col(id_col).alias("_id"),
                       F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), " ").alias("_t"))
    if set(lens_by_m) == {1}:   # single tokens only: a token of a document meets the vocabulary once
        toks = toks.withColumn("_t", F.array_distinct("_t"))
    from tidewatch.functions.ngrams import ngram_union
    # repeated shingles of one document only repeat hits, which the distinct on
    # (doc, technique) below collapses; no shuffle of all shingles here
    doc_sh = (ngram_union(toks, "_t", sorted(lens_by_m), keep=("_id",), out="sh", n_col="m")
              .filter(F.col("sh") != "").select("_id", "m", "sh"))

    vocab = doc_sh.select("m", "sh").distinct()
    subs = []
    for m, lens in lens_by_m.items():
        lens_arr = F.array(*[F.lit(x) for x in sorted(lens)])
        cut = F.flatten(F.transform(lens_arr, lambda L: F.when(
            F.length("sh") >= L,
            F.transform(F.sequence(F.lit(1), F.length("sh") - L + 1),
                        lambda s: F.substring(F.col("sh"), s, L))
        ).otherwise(F.array().cast("array<string>"))))
        subs.append(vocab.filter(F.col("m") == m)
                    .select("m", "sh", F.explode(F.array_distinct(cut)).alias("kw")))
    vsub = subs[0]
    for s in subs[1:]:
        vsub = vsub.unionByName(s)
    from tidewatch.operators.util import broadcast_if_small
    vocab_hits = vsub.join(broadcast_if_small(kw.select("m", "kw", "pos", "technique_id")), ["m", "kw"]) \
                     .select("m", "sh", "pos", "technique_id").distinct().checkpoint()
    # of checked size, the matching shingles go to the documents, whose shingles are not shuffled
    doc_hits = (doc_sh.join(broadcast_if_small(vocab_hits), ["m", "sh"])
                .select("_id", "pos", "technique_id").distinct())
    per_doc = doc_hits.groupBy("_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "technique_id"))),
                    lambda e: e["technique_id"]).alias("_tags"))
    out = docs.join(per_doc, docs[id_col] == per_doc["_id"], "left")
    return (out.withColumn(out_col, F.coalesce(F.col("_tags"), F.array().cast("array<string>")))
            .drop("_id", "_tags"))


def by_tactic(dictionary: DataFrame) -> DataFrame:
    """The dictionary with one row a tactic (NULL is one), which lists the keywords of all its techniques.

    ``technique_tactics`` of documents tagged with it gives the same tactics, without a tag for every technique.
    """
    if "tactic" not in dictionary.columns:
        return dictionary
    tactics = dictionary.select("technique_id", "tactic").distinct()
    kw = dictionary.select("technique_id", F.explode("keywords").alias("kw")).distinct().join(tactics, "technique_id")
    rows = kw.groupBy("tactic").agg(F.collect_set("kw").alias("keywords")).withColumn("pos", F.monotonically_increasing_id())
    # checkpointed: the numbers are made once
    return rows.select("pos", F.col("pos").cast("string").alias("technique_id"), F.col("tactic").alias("technique_name"),
                       "keywords", "tactic").checkpoint()


def technique_tactics(tagged: DataFrame, dictionary: DataFrame, id_col: str = "doc_id",
                      tags_col: str = "mitre_matches") -> DataFrame:
    """ADV10: distinct tactic per document via the dictionary's optional ``tactic``.

    Absent column -> empty result with the same schema.
    """
    if "tactic" not in dictionary.columns:
        return tagged.sparkSession.createDataFrame([], f"{id_col} BIGINT, tactic STRING")
    ex = tagged.select(id_col, F.explode(tags_col).alias("technique_id"))
    return (ex.join(dictionary.select("technique_id", "tactic"), "technique_id")
            .select(id_col, "tactic").distinct())
