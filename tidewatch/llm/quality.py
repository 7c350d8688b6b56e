"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and stores what it measured and one failure bit a rule.
A policy is a named, versioned mask over those bits: applying one, comparing two, or asking what
a rule alone rejects (``ablations``) reads bits and never a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ready

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; the rule's place in RULES is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "100 * n_upper > 40 * word_chars"),
    Rule("word_length", "word_chars > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << i for i, r in enumerate(rules) if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = (BASE, Policy("default", 1, ("few_words", "repeated_words", "symbols", "repeated_lines", "shouting")),
            Policy("default", 2, tuple(r.name for r in RULES)))
CURRENT = POLICIES[-1]

MEASURES = ("n_words", "n_lines", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input row as a struct) and the measurements as longs.

    Repeated three-word windows are found inside the row: each window is one long whose high bits
    are its hash and whose low bits, as many as the text's word count needs, its place; in the
    sorted array equal hashes are neighbours, and a second hash confirms them. No row is exploded
    or shuffled, so neither a long text nor a hot source makes a hot task.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    body = F.btrim("t", F.lit(SPACES))
    rows = rows.select("row", "t", F.when(body == "", F.array().cast("array<string>"))
                       .otherwise(F.split(body, r"[\x20\x09-\x0D]+")).alias("w"),
                       F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    rows = rows.select(
        "row", "w", F.coalesce(F.size("w"), F.lit(0)).alias("n"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _without(F.col("t"), SPACES).cast("long").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"))
    three = lambda h, at: h(F.get("w", at), F.get("w", at + 1), F.get("w", at + 2))
    rows = rows.withColumn("bits", F.length(F.bin("n")))
    packed = F.transform("w", lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)), F.col("bits"))
                         .bitwiseOR(i.cast("long")))
    rows = rows.withColumn("s", F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.col("n") - 2, F.lit(0)))))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))

    def same(x: Column, y: Column) -> Column:
        return (high(x) == high(y)) & (three(F.hash, place(x)) == three(F.hash, place(y)))

    hits = F.filter("s", lambda x, i: F.coalesce(same(x, F.get("s", i + 1)), F.lit(False)) | F.coalesce(same(x, F.get("s", i - 1)), F.lit(False)))
    rows = rows.withColumn("hits", hits).withColumn("p", F.sort_array(F.transform("hits", place)))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1), x + 3) - x)),
                          F.lit(0), lambda a, b: a + b)
    return rows.select("row", F.col("n").cast("long").alias("n_words"), "n_lines", "word_chars", "n_symbols", "n_upper", "n_dup_lines",
                       covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row``, the measurements, and ``failed``: bit ``i`` is set where rule ``i`` fails.

    A null or empty text has no words and no lines and fails ``few_words``. Every input row gives
    one row, repeated rows and null ids too; the input's other columns stay inside ``row``.
    """
    ready(docs.sparkSession)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    # A filter on ``failed`` must not be pushed below the measurements: it would evaluate their nested
    # expressions once for each mention. A nondeterministic term, always true, keeps it above them.
    return measured(docs).withColumn("failed", F.when(F.monotonically_increasing_id() >= 0, bits))


def passes(policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a row of the ledger fails none of the policy's rules."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule of it: documents that fail it, and those that only it rejects.

    Rows are first counted by their failure bits (at most ``2 ** len(rules)`` groups, combined
    before the shuffle); the rest is bitwise arithmetic on those few rows.
    """
    grid = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
                              F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"))
                     for p in policies for i, r in enumerate(rules) if r.name in p.rules])
    each = entries.groupBy("failed").agg(F.count("*").alias("n")).select("failed", "n", F.inline(grid))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return each.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"))


def keep_good(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The input's rows, unchanged, that the policy keeps."""
    return ledger(docs).where(passes(policy)).select("row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return ledger(documents(spark, sf_dir).select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes().alias("kept"), "failed")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (100 * n_upper > 40 * word_chars)::INT
    + 32 * (word_chars > 25 * n_words)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
