"""Substring dedup with a count-min prefilter.

Pass 1 sketches, per partition, the minimizer of every window of ``n`` words and merges the
partition sketches cell by cell. Equal windows have equal minimizers, so a cell never
underestimates in how many places a window of that minimizer starts. Pass 2 groups, by a 128-bit
hash of the words, only windows that the merged sketch puts at two or more, and loses none.
A window is then repeated when a document with a smaller id has it too.

The width of the sketch follows the input without a bound, so its load is the same at any size.
No task holds it whole: partition sketches are sparse rows ``(cell, count)``, dealt by cell and
added up, and the cells that count two or more go back to the documents they came from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import keyed, out_id, parts, ready, text_bytes
from .words import Flat, flat, hashes, mix, slices, windows, words

GRAM = 8
SEGMENT = 1 << 16
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 27
DEPTH = 2
HOT_SEGMENTS = 64


def rolling_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours, by doubling."""
    span, out = 1, x
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == n else np.minimum(out[:len(out) - (n - span)], out[n - span:])


def window_minimizers(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of every window of ``n`` words, and the first word of each."""
    gram = min(GRAM, n)
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, at = windows(h, bounds, gram, seed=11)
    full = np.full(len(h) - gram + 1, np.iinfo(np.uint64).max, np.uint64)
    full[at] = value
    least = rolling_min(full, n - gram + 1)
    last = np.repeat(bounds[1:], np.diff(bounds)) - n
    first = np.flatnonzero(np.arange(len(least)) <= last[:len(least)])
    return least[first], first


def cells(value: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(value ^ np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) & np.uint64(width - 1)).astype(np.int64)


def run_values(n: int):
    """The minimizers of a slice's windows and their texts, once for each run of windows of one text that share it."""

    def values(texts: Flat) -> tuple[np.ndarray, np.ndarray]:
        w = words(texts)
        value, first = window_minimizers(hashes(w), w.bounds, n)
        doc = w.doc()[first]
        new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])][:len(value)]
        return value[new], doc[new]

    return values


def sketch_width(places: int) -> int:
    """Cells of a dealt sketch for so many places: 64 or more a place."""
    return 1 << min(max(64 * places, LEAST_CELLS).bit_length(), 62)


def with_repeated_cells(docs: DataFrame, values, width: int, hot: int | None = None) -> DataFrame:
    """``docs`` with ``cells``: of each text, the cells that count two or more of ``values(texts)`` over all texts.

    ``values`` gives values and the texts they stand in. With ``hot``, a column ``hot`` holds those of the cells that
    count more than that. A cell is one row a text, and one row a task once counts are combined; a cell of very many
    texts is dealt anew by the join's skew handling. Texts without such cells have null.
    """
    def sketch(batches):
        for batch in batches:
            for part in slices(batch):
                value, doc = values(flat(part.column("text")))
                if not len(value):
                    continue
                cell = cells(value, 0, width)
                by = np.lexsort((cell, doc))
                cell, doc = cell[by], doc[by]
                new = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(doc) != 0)])
                ids, fps = (part.column(c).to_numpy(zero_copy_only=False)[doc[new]] for c in ("_id", "_fp"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, fps, cell[new], np.diff(np.append(new, len(cell))))], ["_id", "_fp", "cell", "times"])

    places = docs.select("_id", "_fp", "text").mapInArrow(sketch, "_id long, _fp long, cell long, times long").checkpoint()
    merged = places.groupBy("cell").agg(F.sum("times").alias("n")).where("n > 1")
    found = [F.collect_list("cell").alias("cells")]
    if hot is not None:
        found.append(F.collect_list(F.when(F.col("n") > hot, F.col("cell"))).alias("hot"))
    return docs.join(places.join(merged, "cell").groupBy("_id", "_fp").agg(*found), ["_id", "_fp"], "left")


def among(value: np.ndarray, width: int, listed: pa.Array) -> np.ndarray:
    """Which values are in the cells listed for the texts of a slice."""
    return np.isin(cells(value, 0, width), listed.flatten().to_numpy())


def repeated_and_hot(docs: DataFrame, values, width: int, hot: int, share: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Bitmaps of the cells that count two or more of ``values(texts)``, a row of the sketch each, and sorted the values that stand in more than ``hot`` places (none if ``hot`` is 0).

    Each slice counts the values that make up ``share`` of it, two at least; so a value with twice ``hot`` places is
    never missed if ``share`` is at most ``hot`` of all places.
    """
    spark = docs.sparkSession

    def sketch(batches):
        count = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            for part in slices(batch):
                value, _ = values(flat(part.column("text")))
                if hot and len(value):
                    own, times = np.unique(value, return_counts=True)
                    often = times >= max(2, share * len(value))
                    own, times = own[often], times[often]
                    for k in np.unique(own % np.uint64(HOT_SEGMENTS)).tolist():
                        some = own % np.uint64(HOT_SEGMENTS) == k
                        yield pa.RecordBatch.from_arrays([pa.array([-1 - k], pa.int64()), pa.array([own[some].tobytes()], pa.binary()),
                                                          pa.array([times[some].astype(np.int64).tobytes()], pa.binary())], ["segment", "cells", "counts"])
                for row in range(DEPTH):
                    at, times = np.unique(cells(value, row, width), return_counts=True)
                    count[row, at] = np.minimum(count[row, at] + np.minimum(times, 2), 2)
        for row in range(DEPTH):
            at = np.flatnonzero(count[row])
            edges = np.searchsorted(at, np.arange(0, width + 1, SEGMENT))
            for k in np.flatnonzero(np.diff(edges)):
                own = at[edges[k]:edges[k + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row * (width // SEGMENT) + int(k)], pa.int64()),
                    pa.array([(own - k * SEGMENT).astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([count[row, own].tobytes()], pa.binary())], ["segment", "cells", "counts"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        often: dict[int, int] = {}
        for batch in batches:
            for k, at, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k < 0:
                    for value, n in zip(np.frombuffer(at, np.uint64).tolist(), np.frombuffer(times, np.int64).tolist(), strict=True):
                        often[value] = often.get(value, 0) + n
                    continue
                count = total.setdefault(k, np.zeros(SEGMENT, np.uint8))
                at = np.frombuffer(at, np.uint16)
                count[at] = np.minimum(count[at] + np.frombuffer(times, np.uint8), 2)
        for k, count in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], ["segment", "bits"])
        found = np.array([value for value, n in often.items() if n > hot], np.uint64)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["segment", "bits"])

    merged = (docs.select("text").mapInArrow(sketch, "segment long, cells binary, counts binary")
              .repartition(parts(spark), "segment").mapInArrow(merge, "segment long, bits binary"))
    bits = np.zeros((DEPTH * width // SEGMENT, SEGMENT // 8), np.uint8)
    found = [np.zeros(0, np.uint64)]
    for k, b in merged.collect():
        if k < 0:
            found.append(np.frombuffer(b, np.uint64))
        else:
            bits[k] = np.frombuffer(b, np.uint8)
    return list(bits.reshape(DEPTH, width // 8)), np.sort(np.concatenate(found))


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def settled(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows whose window also stands, in these rows, under a smaller id."""
    order = np.lexsort((h2, h1))
    new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    out = np.empty(len(ids), bool)
    out[order] = ids[order] > least[np.cumsum(new) - 1]
    return out


def candidate_windows(docs: DataFrame, n: int, width: int) -> DataFrame:
    """``(h1, h2, _id, _fp, pos, run, sure)`` of the windows that the sketch puts at two or more.

    Windows that stand under a smaller id in the same slice of a task are settled there: they are
    ``sure``, come as runs of ``run`` windows, and have keys of their own, so a passage of a third
    of all documents sends one row a slice to its group and not one a document.
    """
    def find(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(flat(part.column("text")))
                h = hashes(w)
                value, first = window_minimizers(h, w.bounds, n)
                maybe = among(value, width, part.column("cells"))
                if not maybe.any():
                    continue
                h1, at = windows(h, w.bounds, n, seed=21)
                h2, _ = windows(h ^ np.uint64(0x5851F42D4C957F2D), w.bounds, n, seed=22)
                h1, h2, at = h1[maybe].view(np.int64), h2[maybe].view(np.int64), at[maybe]
                doc = w.doc()[at]
                ids, fps = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_fp"))
                pos = (at - w.bounds[doc]).astype(np.int32)
                sure = settled(h1, h2, ids[doc])
                for known, rows in ((False, np.flatnonzero(~sure)), (True, np.flatnonzero(sure))):
                    if not len(rows):
                        continue
                    run = np.ones(len(rows), np.int32)
                    if known:
                        starts = np.flatnonzero(np.r_[True, (np.diff(at[rows]) != 1) | (np.diff(doc[rows]) != 0)])
                        run = np.diff(np.append(starts, len(rows))).astype(np.int32)
                        rows = rows[starts]
                    d = doc[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        mix(at[rows].astype(np.uint64) + fps[d].view(np.uint64)).view(np.int64) if known else h1[rows], h2[rows],
                        ids[d], fps[d], pos[rows], run, np.full(len(rows), known))], ["h1", "h2", "_id", "_fp", "pos", "run", "sure"])

    return (with_repeated_cells(docs, run_values(n), width).where("cells is not null")
            .mapInArrow(find, "h1 long, h2 long, _id long, _fp long, pos int, run int, sure boolean"))


def remove_repeated_windows(docs: DataFrame, n: int = 50) -> DataFrame:
    """Delete every word covered by an ``n``-word window that also starts in a document of smaller id.

    Returns ``doc_id, n_words, n_removed, kept`` (kept words joined by one space), one row for each
    input row. A null or empty text has no words; a text of fewer than ``n`` words keeps all; a null
    doc_id counts as smaller than all others; rows of the same id never count against each other;
    repeated rows come out as often as they came in; other columns are not read.
    """
    spark = ready(docs.sparkSession)
    own = keyed(docs)
    anchors = text_bytes(own) // 6 * 2 // (max(n - GRAM, 1) + 2)
    found = candidate_windows(own, n, sketch_width(anchors))
    same = Window.partitionBy("h1", "h2", "sure")
    marks = (found.withColumn("first", F.min("_id").over(same)).where("sure or _id > first")
             .groupBy("_id", "_fp").agg(F.collect_list(F.struct("pos", "run")).alias("marks")))

    def delete(batches):
        for batch in batches:
            total, removed, kept = [], [], []
            for text, marked in zip(batch.column("text"), batch.column("marks"), strict=True):
                got = text.as_py().encode().split()
                total.append(len(got))
                if marked.is_valid:
                    edge = np.zeros(len(got) + 1, np.int64)
                    at, run = (marked.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + run + (n - 1), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    got = [got[i] for i in np.flatnonzero(stay)]
                removed.append(total[-1] - len(got))
                kept.append(b" ".join(got))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], ["_id", "n_words", "n_removed", "kept"])

    return (own.join(marks, ["_id", "_fp"], "left").select("_id", "text", "marks")
            .mapInArrow(delete, "_id long, n_words long, n_removed long, kept string")
            .select(out_id(), "n_words", "n_removed", "kept"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return remove_repeated_windows(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(50)) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p
    WHERE gone.doc_id IS NULL GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
