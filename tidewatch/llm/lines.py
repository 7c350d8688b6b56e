"""Line dedup: repeated runs of lines by prefix doubling over line ids.

The lines with a word in them, document after document, are a sequence of line ids. A suffix of
that sequence has a rank at depth h: the first place (document, line) where its first h lines
stand. Depth 1 comes from one grouping of line hashes; ranks at depth 2h come from the pairs
(rank at i, rank at i + h). Only suffixes whose rank is shared go on, so unique text leaves after
the first grouping. Suffixes of one rank at depth ``min_lines`` are an interval of the suffix array
whose common prefix is at least that long: its first member stays, and the lines under the others
are later copies. A single line of ``min_words`` words or more is a run too, by its rank at depth 1.
Neighbouring later copies make one maximal repeated run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import NULL_ID, ready

SPACES = " \t\n\x0b\f\r"


def line_ids(own: DataFrame, min_words: int) -> DataFrame:
    """``_id, _fp, pos, h1, h2, long`` of the lines with a word; ``pos`` counts these lines only.

    ``long``: the line has ``min_words`` words or more (words and what parts them take two bytes each, at least).
    """
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    long = (F.octet_length("line") >= 2 * min_words - 1) & (F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= min_words)
    return own.select("_id", "_fp", F.posexplode(lines).alias("pos", "line")).select(
        "_id", "_fp", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line", F.octet_length("line")).alias("h2"), long.alias("long"))


def ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """``_id, _fp, pos, long, rank`` of the suffixes whose keys are shared; rank is the first place of the keys.

    The grouping is combined before the shuffle, and its result joined back (a skewed join that
    Spark can split), so a line of a third of all documents makes no hot task.
    """
    place = F.struct("_id", "_fp", "pos")
    groups = suffixes.groupBy(*keys).agg(F.min(place).alias("rank"), F.max(place).alias("last")).where("rank < last").drop("last")
    return suffixes.join(groups, keys).select("_id", "_fp", "pos", "long", "rank")


def deeper(ranks: DataFrame, step: int) -> DataFrame:
    """Suffixes with the rank ``step`` lines on (``ahead``), where that one is shared too."""
    here = Window.partitionBy("_id", "_fp").orderBy("pos").rangeBetween(step, step)
    return ranks.withColumn("ahead", F.first("rank").over(here)).where("ahead is not null")


def repeated_starts(own: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """``_id, _fp, pos, run`` where a run of ``run`` lines starts that also starts earlier: ``min_lines``, or one long line."""
    later = F.col("rank") < F.struct("_id", "_fp", "pos")
    ranks, depth = ranked(line_ids(own, min_words), ["h1", "h2"]), 1
    found = ranks.where(later & F.col("long")).select("_id", "_fp", "pos", F.lit(1).alias("run"))
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        pairs = deeper(ranks, step).withColumnRenamed("rank", "here")
        ranks, depth = ranked(pairs, ["here", "ahead"]), depth + step
    return found.unionByName(ranks.where(later).select("_id", "_fp", "pos", F.lit(min_lines).alias("run")))


def measures(docs: DataFrame) -> list[str]:
    """Names of the three columns that are added: ``_n_lines, _n_removed, _n_runs``, with more underscores where taken."""
    out = []
    for name in ("_n_lines", "_n_removed", "_n_runs"):
        while name in docs.columns:
            name = "_" + name
        out.append(name)
    return out


def remove_repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """Delete later copies of runs of at least ``min_lines`` lines, or of one line with at least ``min_words`` words.

    Returns the input's columns with ``text`` replaced, and the three of ``measures(docs)`` last: lines, removed lines and
    runs of them. An empty table gives an empty one. Lines are what
    ``\\n`` parts; a line without a word is never counted nor removed. "Earlier" is a smaller
    doc_id, or the same document further up; copies are judged on the input. A null text stays null, an
    empty one empty (no lines); a null doc_id comes before all others; repeated rows are one
    document and come out alike; other columns pass through whatever their names.
    """
    ready(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"))
    inner = inner.withColumn("text", F.coalesce("_text", F.lit(""))).withColumn("_fp", F.xxhash64("text"))
    starts = repeated_starts(inner.select("_id", "_fp", "text"), min_lines, min_words)
    marks = starts.distinct().groupBy("_id", "_fp").agg(F.collect_list(F.struct("pos", "run")).alias("marks"))
    names = measures(docs)

    def delete(batches):
        for batch in batches:
            kept, counts = [], []
            for text, marked in zip(batch.column("_text"), batch.column("marks"), strict=True):
                text = text.as_py()
                lines = (text or "").split("\n")
                word = np.fromiter((bool(x.encode().split()) for x in lines), bool, len(lines))
                n = int(word.sum())
                if not marked.is_valid:
                    kept.append(text)
                    counts.append((n, 0, 0))
                    continue
                edge = np.zeros(n + 1, np.int64)
                at, run = (marked.values.field(k).to_numpy() for k in (0, 1))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + run, -1)
                gone = np.cumsum(edge[:-1]) > 0
                stay = np.ones(len(lines), bool)
                stay[np.flatnonzero(word)[gone]] = False
                kept.append("\n".join([lines[k] for k in np.flatnonzero(stay)]))
                counts.append((n, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
            total = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())] + [pa.array(total[:, k]) for k in range(3)],
                                             ["row", "_text", *names])

    # The text moves once, with what to delete from it.
    whole = inner.join(marks, ["_id", "_fp"], "left").select("row", "_text", "marks")
    schema = whole.select("row", "_text").withColumns({c: F.lit(0).cast("long") for c in names}).schema
    done = whole.mapInArrow(delete, schema)
    return done.select(*[F.col("_text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], *names)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
own AS (SELECT doc_id, ln, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos
    FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
one AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM own)
    WHERE k > 1 AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
two AS (SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM own),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k
    FROM two WHERE run IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest(range(2)) AS k) UNION SELECT doc_id, pos FROM one),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < pos - 1) AS n_runs
    FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.ln) AS t FROM raw
    LEFT JOIN own ON own.doc_id = raw.doc_id AND own.ln = raw.ln
    LEFT JOIN gone ON gone.doc_id = own.doc_id AND gone.pos = own.pos WHERE gone.doc_id IS NULL GROUP BY raw.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM own GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
