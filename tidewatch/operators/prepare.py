"""Cleaning, filtering, deduplication, exact sampling and weak labelling.

Shuffles: deduplication is one hash aggregate keyed by the cleaned text.
Partial aggregation runs map-side, so a text copied into a third of all
rows collapses to one row per map task before the exchange; no window
ever holds a whole copy group. Sampling is in ``sampling.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import Config, DEFAULT_CONFIG
from tidewatch.functions import text as T



def add_clean_text(df: DataFrame, text_col: str = "text", out_col: str = "clean_text",
                   keep_hashtag_word: bool = True) -> DataFrame:
    """STR1-STR8 (+PRJ3): add the cleaned text column."""
    return df.withColumn(out_col, T.clean_text(text_col, keep_hashtag_word))


def drop_empty(df: DataFrame, col: str = "clean_text") -> DataFrame:
    """FLT1: keep rows whose cleaned text is non-empty."""
    return df.filter(F.col(col) != "")


def dedup_first_wins(df: DataFrame, key: str = "clean_text",
                     order_cols=("doc_id",), drop_empty: bool = False) -> DataFrame:
    """AGG6 (+FLT1): one row per distinct ``key``; the row smallest in ``order_cols`` wins.

    A hash-partitioned aggregate with one ``min_by`` a column: one exchange, map-side combine, no
    per-group window, and columns that a caller does not read are never shuffled. A single order
    column is its own minimum (NULL first, as in ``min_by``), so ids alone need no sort.
    With ``drop_empty`` the empty key is removed through an aggregate output
    (``max(length(key)) > 0``). Catalyst cannot push that below the
    aggregate, so the (regex-heavy) key expression is evaluated once per row
    instead of once in a pushed-down filter and again in the projection.
    """
    others = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_cols])
    own = order_cols[0] if len(order_cols) == 1 and order_cols[0] in others else None
    aggs = [F.min_by(F.col(c), order).alias(f"_r_{c}") for c in others if c != own]
    if own:
        aggs += [F.min(own).alias(f"_r_{own}"), F.max(F.col(own).isNull()).alias("_null")]
    if drop_empty:
        aggs.append(F.max(F.length(key)).alias("_klen"))
    agg = df.groupBy(key).agg(*aggs)
    if drop_empty:
        agg = agg.filter(F.col("_klen") > 0)
    first = {c: F.col(f"_r_{c}") for c in others}
    if own:
        first[own] = F.when(~F.col("_null"), first[own])
    return agg.select(*[first[c].alias(c) if c != key else F.col(key) for c in df.columns])


def exact_sample(df: DataFrame, n: int | None, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """SMP1 (see ``tidewatch.operators.sampling.exact_sample``)."""
    from tidewatch.operators.sampling import exact_sample as _s
    return _s(df, n, seed, id_col)


def add_weak_label(df: DataFrame, col: str = "clean_text", out_col: str = "label",
                   keywords=None) -> DataFrame:
    """TXT1: weak label, overwriting any loaded label (reference behaviour)."""
    return df.withColumn(out_col, T.weak_label(col, keywords))


def add_ioc_features(df: DataFrame, col: str = "clean_text", keywords=None) -> DataFrame:
    """IOC6 + TXT2: four indicator counts and the distinct keyword count."""
    cols = {k: v for k, v in T.ioc_counts(col).items()}
    cols["cyber_keyword_count"] = T.keyword_count(col, keywords)
    return df.withColumns(cols)


def add_label_and_features(df: DataFrame, col: str = "clean_text", with_iocs: bool = True,
                           out_col: str = "label") -> DataFrame:
    """TXT1 + TXT2 (+IOC6) from a single keyword scan: label = distinct count > 0.

    Exact for the built-in lexicon (see ``keyword_count``).
    """
    hits = df.withColumn("_kw", T.keyword_hits(col))
    cols = {out_col: (F.size("_kw") > 0).cast("int"),
            "cyber_keyword_count": F.size(F.array_distinct("_kw"))}
    if with_iocs:
        cols.update(T.ioc_counts(col))
    return hits.withColumns(cols).drop("_kw")


def prepare_documents(df: DataFrame, cfg: Config = DEFAULT_CONFIG, text_col: str = "text",
                      id_col: str = "doc_id", order_cols=None,
                      technique_dict: DataFrame | None = None) -> DataFrame:
    """Stages 2-7 of the reference pipeline as one lazy plan.

    clean -> drop empty -> dedup (first wins) -> exact sample -> weak label
    -> IOC counts + keyword count -> technique tags.
    """
    order_cols = tuple(order_cols or (id_col,))
    d = add_clean_text(df, text_col, keep_hashtag_word=cfg.keep_hashtag_word)
    d = dedup_first_wins(d, "clean_text", order_cols, drop_empty=True)
    d = exact_sample(d, cfg.sample_n, cfg.random_seed, id_col)
    weak = cfg.label_source == "weak" or "label" not in d.columns
    if weak and cfg.do_ioc_features:
        d = add_label_and_features(d)
    elif weak:
        d = add_weak_label(d)
    elif cfg.do_ioc_features:
        d = add_ioc_features(d)
    if cfg.do_mitre_mapping and technique_dict is not None:
        from tidewatch.operators.techniques import tag_techniques
        d = tag_techniques(d, technique_dict, id_col=id_col)
    return d


def label_totals(df: DataFrame, label_col: str = "label") -> DataFrame:
    """AGG3: positive and negative totals."""
    pos = F.coalesce(F.sum(F.col(label_col)), F.lit(0)).cast("bigint")
    return df.agg(pos.alias("positives"), (F.count(F.lit(1)) - pos).cast("bigint").alias("negatives"))


def stage_counts(raw: DataFrame, clean_col: str = "clean_text") -> DataFrame:
    """AGG5: rows loaded, non-empty after cleaning, distinct after dedup (one pass)."""
    c = F.col(clean_col)
    return raw.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count(F.when(c != "", True)).alias("non_empty"),
        F.count_distinct(F.when(c != "", c)).alias("deduplicated"),
    )
