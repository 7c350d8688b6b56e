"""Words and pairs of words of many texts at once, over Arrow buffers.

A word is a run of ``[A-Za-z0-9_]{2,}`` of the lower-cased text, a pair two words in a row of one text, joined by a
blank: what ``RegexTokenizer`` and ``NGram(2)`` give. Texts are cut in slices of ``SLICE_BYTES``, so that a worker
holds the words of one slice, however large its batch is.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions of this module that run in workers go there by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: of text whose words a worker holds at once; where it only counts them, as it sends fewer rows of more text
SLICE_BYTES, COUNT_BYTES = 4 << 20, 16 << 20
#: buckets that pairs are counted into before they are counted themselves
PAIR_BUCKETS = 1 << 20


def lowered(docs: DataFrame, text_col: str, name: str = "_lt") -> DataFrame:
    return docs.withColumn(name, F.lower(F.coalesce(F.col(text_col), F.lit(""))))


def slices(batch, at: int, most_bytes: int = SLICE_BYTES):
    """``(first row, texts)`` of parts of a batch with some ``most_bytes`` of text, a row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(at)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield begin, texts.slice(begin, end - begin).cast(pa.string())
        begin = end


def words(texts):
    """``(words, the place of each word's text)`` of lower-cased texts without null, in their order."""
    import numpy as np
    import pyarrow as pa

    _, places, held = texts.buffers()
    offsets = np.frombuffer(places, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    of_word = np.zeros(256, bool)
    of_word[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)] = True
    inside = of_word[data]
    # a run ends where its text does
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | breaks[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | breaks[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    single = end - begin < 2
    inside[begin[single]] = False
    begin, end = begin[~single], end[~single]
    ends = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=ends[1:])
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return found, np.searchsorted(offsets, begin, side="right") - 1


def _counted_pairs(texts):
    """``(words, occurrences of each, a, b, n)``: distinct words of the texts, and their distinct pairs as numbers of two words."""
    import numpy as np

    found, of = words(texts)
    own = found.dictionary_encode()
    code, size = np.asarray(own.indices).astype(np.int64), max(1, len(own.dictionary))
    left = np.flatnonzero(of[1:] == of[:-1])
    pair, n = np.unique(code[left] * size + code[left + 1], return_counts=True)
    a, b = np.divmod(pair, size)
    return own.dictionary, np.bincount(code, minlength=len(own.dictionary)), a, b, n.astype(np.int64)


def _pair_buckets(found, a, b):
    """The bucket of each pair, by its words alone: the same in every slice and task."""
    import numpy as np

    if not len(a):
        return np.empty(0, np.int64)
    _, places, held = found.buffers()
    offsets = np.frombuffer(places, np.int32)[found.offset:found.offset + len(found) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    begin, long = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.cumprod(np.full(long.max(), 0x100000001B3, np.uint64))
    own = np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(begin, long)], begin)   # a word has bytes
    mixed = (own[a] * np.uint64(0x9E3779B97F4A7C15) + own[b]) * np.uint64(0xC2B2AE3D27D4EB4F)   # modulo 2 ** 64
    return ((mixed >> np.uint64(32)) % np.uint64(PAIR_BUCKETS)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(term, cf)`` of every word, and ``(bucket, load)``: occurrences of the pairs of each bucket; from one pass over the texts.

    A task sends its distinct words by slice, and at most ``PAIR_BUCKETS`` loads, however many pairs it has.
    """
    def counted(batches):
        import numpy as np
        import pyarrow as pa

        loads = np.zeros(PAIR_BUCKETS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, 0, COUNT_BYTES):
                found, each, a, b, n = _counted_pairs(texts)
                np.add.at(loads, _pair_buckets(found, a, b), n)
                yield pa.RecordBatch.from_arrays([found, pa.nulls(len(found), pa.int64()), pa.array(each.astype(np.int64))], ["term", "bucket", "n"])
        full = np.flatnonzero(loads)
        for begin in range(0, len(full), 1 << 16):
            part = full[begin:begin + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(part), pa.array(loads[part])], ["term", "bucket", "n"])

    per_task = lowered(docs, text_col).select("_lt").mapInArrow(counted, "term STRING, bucket BIGINT, n BIGINT")
    both = per_task.groupBy("term", "bucket").agg(F.sum("n").alias("n")).checkpoint()
    return (both.filter(F.col("term").isNotNull()).select("term", F.col("n").alias("cf")),
            both.filter(F.col("term").isNull()).select("bucket", F.col("n").alias("load")))


def pair_counts(docs: DataFrame, text_col: str, opened) -> DataFrame:
    """``(term, cf)`` of every pair in the buckets ``opened``, an array of a flag for each bucket."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(opened))   # an eighth of ``PAIR_BUCKETS`` bytes

    def counted(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        wanted = np.unpackbits(sent.value, count=PAIR_BUCKETS).astype(bool)
        for batch in batches:
            for _, texts in slices(batch, 0, COUNT_BYTES):
                found, _, a, b, n = _counted_pairs(texts)
                own = wanted[_pair_buckets(found, a, b)]
                pairs = pc.binary_join_element_wise(found.take(pa.array(a[own])), found.take(pa.array(b[own])), " ")
                yield pa.RecordBatch.from_arrays([pairs, pa.array(n[own])], ["term", "n"])

    per_slice = lowered(docs, text_col).select("_lt").mapInArrow(counted, "term STRING, n BIGINT")
    return per_slice.groupBy("term").agg(F.sum("n").alias("cf"))


def count_vectors(docs: DataFrame, text_col: str, vocabularies: list[list[str]], out_col: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without ``drop``, with the sparse vector of the counts of the words, then of the pairs, of two vocabularies."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    kept = docs.drop(out_col)
    fields = [f for f in kept.schema.fields if f.name not in drop]
    sent = docs.sparkSession.sparkContext.broadcast(vocabularies)   # two lists of the vocabularies' size

    def vectors(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        single, double = sent.value
        size = len(single) + len(double)
        wanted = pa.array(single, pa.string())
        # a pair is the numbers of its two words
        halves = [x.split(" ") for x in double]
        parts = {w: i for i, w in enumerate(dict.fromkeys(w for x in halves for w in x))}
        part_words = pa.array(list(parts), pa.string())
        wanted_pairs = pa.array([parts[a] * len(parts) + parts[b] for a, b in halves], pa.int64())

        def places(values, among):
            return pc.index_in(values, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False)

        def vector(texts):
            found, of = words(texts)
            own = found.dictionary_encode()
            code = np.asarray(own.indices)
            one = places(own.dictionary, wanted)[code]
            hit = np.flatnonzero(one >= 0)
            keys = [of[hit] * size + one[hit]]
            part = places(own.dictionary, part_words)[code]
            left = np.flatnonzero((of[1:] == of[:-1]) & (part[1:] >= 0) & (part[:-1] >= 0))
            two = places(pa.array(part[left].astype(np.int64) * len(parts) + part[left + 1]), wanted_pairs)
            hit = np.flatnonzero(two >= 0)
            keys.append(of[left[hit]] * size + len(single) + two[hit])
            key, n = np.unique(np.concatenate(keys).astype(np.int64), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) * size).astype(np.int32))
            return pa.StructArray.from_arrays(
                [pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), size, np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array((key % size if size else key).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.float64)))],
                names=["type", "size", "indices", "values"])

        for batch in batches:
            at = batch.schema.get_field_index("_lt")
            names = [f.name for f in fields]
            for begin, texts in slices(batch, at):
                own = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*[own.column(batch.schema.get_field_index(x)) for x in names], vector(texts)], [*names, out_col])

    return lowered(kept, text_col).drop(*drop).mapInArrow(vectors, StructType([*fields, StructField(out_col, VectorUDT())]))


def class_term_counts(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``(term, c0, c1)``: occurrences of every word in texts labelled 0 and 1; words of other texts alone have 0 and 0."""
    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            label = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            for begin, texts in slices(batch, 1, COUNT_BYTES):
                found, of = words(texts)
                own = found.dictionary_encode()
                code, kind = np.asarray(own.indices), label[begin + of]
                n = [pa.array(np.bincount(code[kind == k], minlength=len(own.dictionary)).astype(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([own.dictionary, *n], ["term", "c0", "c1"])

    kind = F.when(F.col(label_col) == 0, 0).when(F.col(label_col) == 1, 1).cast("int").alias("_kind")
    per_slice = lowered(docs, text_col).select(kind, "_lt").mapInArrow(counted, "term STRING, c0 BIGINT, c1 BIGINT")
    return per_slice.groupBy("term").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def word_sums(docs: DataFrame, text_col: str, id_col: str, near, rest: bool) -> DataFrame:
    """``(id, term, n, s)``: a row a document, without ``term``, with the sum ``s`` of its words' weights in the Arrow table
    ``near`` (``term``, ``w``), of checked size; with ``rest``, also a row with its count ``n`` for each other word of the document."""
    sent = docs.sparkSession.sparkContext.broadcast((near.column("term").combine_chunks(), near.column("w").combine_chunks()))
    slim = lowered(docs, text_col).select(F.col(id_col).alias("_id"), "_lt")

    def summed(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, weights = sent.value
        weights = np.asarray(weights)
        names = ["_id", "term", "n", "s"]
        for batch in batches:
            for begin, texts in slices(batch, 1):
                found, of = words(texts)
                held = found.dictionary_encode()
                at = pc.index_in(held.dictionary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)[np.asarray(held.indices)]
                hit = at >= 0
                s = np.bincount(of[hit], weights=weights[at[hit]], minlength=len(texts)) if hit.any() else np.zeros(len(texts))
                ids = batch.column(0).slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int64()), pa.array(s)], names)
                if rest and not hit.all():
                    own = found.filter(pa.array(~hit)).dictionary_encode()
                    key, n = np.unique(of[~hit] * len(own.dictionary) + np.asarray(own.indices), return_counts=True)
                    row, code = np.divmod(key, len(own.dictionary))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), own.dictionary.take(pa.array(code)), pa.array(n.astype(np.int64)),
                                                      pa.nulls(len(key), pa.float64())], names)

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(summed, f"_id {kind}, term STRING, n BIGINT, s DOUBLE").withColumnRenamed("_id", id_col)
