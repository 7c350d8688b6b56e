"""Column expressions for cleaning, weak labelling and indicator extraction.

All of them are built-in Spark expressions (regexp_replace,
regexp_extract_all, rlike, size), so they stay inside whole-stage codegen
and run unchanged on batch or streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col, keep_hashtag_word: bool = True) -> Column:
    """STR1-STR8: URL strip, mention strip, hashtag unwrap/drop, scrub, collapse, lower.

    Order matters and follows the reference: URLs, mentions, hashtags, then
    the character scrub. A NULL input yields "" (STR8).
    """
    t = F.coalesce(_c(col).cast("string"), F.lit(""))
    t = F.regexp_replace(t, P.URL_PATTERN_JAVA, " ")
    t = F.regexp_replace(t, P.MENTION_PATTERN, " ")
    t = F.regexp_replace(t, P.HASHTAG_PATTERN, "$1" if keep_hashtag_word else " ")
    t = F.regexp_replace(t, P.SCRUB_RUNS_JAVA, " ")
    return F.lower(F.trim(t))


def keyword_hits(col, keywords=None) -> Column:
    """All keyword occurrences (lower-cased) found by one alternation scan."""
    kws = P.CYBER_KEYWORDS if keywords is None else list(keywords)
    c = F.coalesce(_c(col), F.lit(""))
    hits = F.regexp_extract_all(c, F.lit(P.keyword_alternation(kws)), F.lit(0))
    return F.transform(hits, lambda x: F.lower(x))


def weak_label(col, keywords=None) -> Column:
    """TXT1: 1 when any keyword occurs with word boundaries (case-insensitive)."""
    kws = P.CYBER_KEYWORDS if keywords is None else list(keywords)
    if not [k for k in kws if k]:
        return F.lit(0)
    c = F.coalesce(_c(col), F.lit(""))
    return c.rlike(P.keyword_alternation(kws)).cast("int")


def keyword_count(col, keywords=None) -> Column:
    """TXT2: number of distinct keywords present (not occurrences).

    For the built-in lexicon no two keywords can match overlapping spans at
    word boundaries, so one alternation scan plus ``array_distinct`` is
    exact. A caller-supplied list gets one ``rlike`` per keyword, which is
    exact for any list.
    """
    kws = P.CYBER_KEYWORDS if keywords is None else list(keywords)
    kws = [k for k in dict.fromkeys(kws) if k]
    if not kws:
        return F.lit(0)
    c = F.coalesce(_c(col), F.lit(""))
    if keywords is None:
        return F.size(F.array_distinct(keyword_hits(c)))
    terms = [c.rlike(r"(?i)\b" + P.regex_quote(k) + r"\b").cast("int") for k in kws]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def extract_iocs(col) -> dict[str, Column]:
    """IOC1-IOC5: all matches per type, in text order, duplicates kept."""
    c = F.coalesce(_c(col), F.lit(""))
    found = {k: F.regexp_extract_all(c, F.lit(P.IOC_PATTERNS_JAVA[k]), F.lit(0)) for k in P.IOC_TYPES}
    # a text without the end of a domain is not searched for its start
    found["domains"] = F.when(c.rlike(P.DOMAIN_END), found["domains"]).otherwise(F.array().cast("array<string>"))
    return found


def ioc_counts(col) -> dict[str, Column]:
    """IOC6: ``num_ips, num_domains, num_hashes, num_cves`` (duplicates count)."""
    return {f"num_{k}": F.size(v) for k, v in extract_iocs(col).items()}
