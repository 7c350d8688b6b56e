"""Class counts, exact seeded sampling, balancing, stratified split, folds.

Randomness is a key, not a generator: ``md5('{seed}:{id}')`` orders rows the
same way in every engine and on every partitioning, so each choice is
repeatable and checkable.

One primitive serves every quota operator: a histogram of the first four
hex digits of the key (65,536 buckets per group, a fixed-size aggregate)
with a running sum per group finds, for every group, the bucket where its
quota is reached; the last row taken is found in that bucket alone. Its
(key, id) is the group's cut, and rows are flagged against the cut in place.
No window ever spans a whole class, so a class holding most rows does not
land in one task. Rows without a label are a group of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_K, _B = "_skey", "_sbucket"


def sample_key(seed: int, id_col: str = "doc_id") -> F.Column:
    """md5 of ``'{seed}:{id}'`` — identical in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _keyed(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    return (df.withColumn(_K, sample_key(seed, id_col))
              .withColumn(_B, F.conv(F.substring(_K, 1, 4), 16, 10).cast("int")))


#: Groups up to this many make a table that is broadcast; more are joined as they are.
BROADCAST_GROUPS = 10_000


def _histogram(keyed: DataFrame, groups: list[str]) -> DataFrame:
    """(groups.., bucket, cnt, before): rows per bucket and rows in earlier buckets."""
    h = keyed.groupBy(*groups, _B).agg(F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))) \
        .orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))


def _join_groups(left: DataFrame, right: DataFrame, groups: list[str], how: str = "inner",
                 extra: list[str] = ()) -> DataFrame:
    """Join on group columns where NULL equals NULL, so unlabelled rows are a group too."""
    names = [*groups, *extra]
    if not names:
        return left.crossJoin(right)   # ``right`` is one row
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in names],
                     *[c for c in right.columns if c not in names])
    cond = None
    for c in names:
        one = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = one if cond is None else cond & one
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in names])


def _small(table: DataFrame, groups: list[str]) -> DataFrame:
    """Broadcast a table of one row per group after counting it."""
    if not groups or table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return F.broadcast(table)
    return table


def quota_cuts(keyed: DataFrame, groups: list[str], quotas: DataFrame | None, id_col: str,
               quota: int | None) -> DataFrame:
    """One row per group: its size ``_n``, its ``quota`` and the ``(_ckey, _cid)`` of the last row taken.

    Only ids and keys are read. The histogram gives the bucket in which the quota is reached;
    only that bucket's rows (about one in 65,536) are ranked.
    """
    h = _histogram(keyed, groups)
    h = _join_groups(h, quotas, groups, "left") if quotas is not None else h.withColumn("quota", F.lit(quota))
    h = h.withColumn("quota", F.coalesce("quota", F.lit(0)).cast("bigint"))
    size = h.groupBy(*groups).agg(F.sum("_cnt").alias("_n"), F.max("quota").alias("quota"))
    cut = h.filter((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_cnt"))) \
           .select(*groups, _B, (F.col("quota") - F.col("_before")).alias("_take"))
    edge = _join_groups(keyed, _small(cut, groups), groups, extra=[_B])
    w = Window.partitionBy(*groups, _B).orderBy(_K, id_col)
    last = (edge.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == F.col("_take"))
            .select(*groups, F.col(_K).alias("_ckey"), F.col(id_col).alias("_cid")))
    return _join_groups(size, last, groups, "left") if groups else size.join(last, F.lit(True), "left")


def flag_smallest(df: DataFrame, groups: list[str], quotas: DataFrame | None, seed: int,
                  id_col: str = "doc_id", flag: str = "_sel", quota: int | None = None,
                  narrow: DataFrame | None = None) -> DataFrame:
    """Add boolean ``flag``: row is among the ``quota`` smallest (key, id) of its group.

    ``quotas`` has ``groups + ['quota']``; or pass one ``quota`` for all. Ids must be unique.
    The cut of each group is a (key, id) pair in a table of one row per group, so the rows
    themselves are flagged by a comparison in place: no shuffle carries their other columns.
    ``narrow``: the groups and ids of ``df``, where a caller has them at hand.
    """
    narrow = _keyed(df.select(*groups, id_col) if narrow is None else narrow, seed, id_col)
    cuts = _small(quota_cuts(narrow, groups, quotas, id_col, quota), groups)
    j = _join_groups(df.withColumn(_K, sample_key(seed, id_col)), cuts, groups, "left")
    below = (F.col(_K) < F.col("_ckey")) | ((F.col(_K) == F.col("_ckey")) & (F.col(id_col) <= F.col("_cid")))
    sel = F.coalesce((F.col("quota") >= F.col("_n")) | below, F.lit(False))
    return j.withColumn(flag, sel).drop(_K, "_n", "quota", "_ckey", "_cid")


def rank_within_group(df: DataFrame, groups: list[str], seed: int, id_col: str = "doc_id",
                      rank_col: str = "_rank", narrow: DataFrame | None = None) -> DataFrame:
    """Dense 0-based rank by (key, id) inside each group (NULL labels are a group), without a whole-group window.

    The histogram goes to every task after a check of its bytes, so the rows are shuffled once, for their ranks.
    ``narrow``: the groups and ids of ``df``, where a caller has them at hand.
    """
    from tidewatch.operators.util import broadcast_if_small

    keyed = _keyed(df, seed, id_col)
    own = df.select(*groups, id_col) if narrow is None else narrow
    h = _histogram(_keyed(own, seed, id_col), groups).select(*groups, _B, "_before").checkpoint()
    j = _join_groups(keyed, broadcast_if_small(h), groups, extra=[_B])
    w = Window.partitionBy(*groups, _B).orderBy(_K, id_col)
    return j.withColumn(rank_col, F.col("_before") + F.row_number().over(w) - 1).drop(_K, _B, "_before")


def dense_positions(df: DataFrame, out_col: str = "position") -> DataFrame:
    """Number the rows of ``df`` in its own order (partition after partition), from 0.

    The input is checkpointed, so numbering and rows come from one evaluation; the driver sees
    one count a partition.
    """
    d = df.withColumn("_pid", F.spark_partition_id()) \
          .withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    before, total = [], 0
    for pid, n in sorted(d.groupBy("_pid").count().collect()):
        before.append((pid, total))
        total += n
    offs = d.sparkSession.createDataFrame(before, "_pid INT, _off BIGINT")
    return d.join(F.broadcast(offs), "_pid").withColumn(out_col, F.col("_off") + F.col("_k")).drop("_pid", "_k", "_off")


# --- AGG1, AGG2, AGG3, AGG4 ---------------------------------------------------
def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """AGG1."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))


def class_count_range(df: DataFrame, label_col: str = "label") -> DataFrame:
    """AGG2: smallest and largest class size."""
    c = class_counts(df, label_col)
    return c.agg(F.min("count").alias("min_count"), F.max("count").alias("max_count"))


def class_weight(df: DataFrame, label_col: str = "label") -> DataFrame:
    """AGG4: ``max(1, neg) / max(1, pos)`` over all labels (the positive-class weight)."""
    pos = F.sum((F.col(label_col) == 1).cast("bigint"))
    neg = F.sum((F.col(label_col) == 0).cast("bigint"))
    return df.agg((F.greatest(F.lit(1), neg) / F.greatest(F.lit(1), pos)).cast("double").alias("pos_weight"))


def with_class_weights(df: DataFrame, label_col: str = "label", out_col: str = "weight") -> DataFrame:
    """MDL3 helper: per-row ``weightCol`` (positives weighted by AGG4, negatives 1)."""
    w = class_weight(df, label_col).scalar()   # scalar subquery, evaluated once
    return df.withColumn(out_col, F.when(F.col(label_col) == 1, w).otherwise(F.lit(1.0)))


# --- SMP1 ---------------------------------------------------------------------
def exact_sample(df: DataFrame, n: int | None, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """SMP1: the ``n`` rows with the smallest key; all rows when there are fewer."""
    if not n:
        return df
    return flag_smallest(df, [], None, seed, id_col, quota=n).filter("_sel").drop("_sel")


def _narrow(df: DataFrame, label_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Labels and ids of ``df``, checkpointed once for counts, quotas and cuts; and ``df``, which is the same where it has no more."""
    narrow = df.select(label_col, id_col).checkpoint()
    return narrow, narrow.select(*df.columns) if set(df.columns) == {label_col, id_col} else df


# --- SMP2, SMP3, SMP4, SMP6 ------------------------------------------------------
def undersample(df: DataFrame, label_col: str = "label", seed: int = 42,
                id_col: str = "doc_id") -> DataFrame:
    """SMP2: every class cut to the smallest class size; one class -> unchanged."""
    narrow, df = _narrow(df, label_col, id_col)
    c = class_counts(narrow, label_col)
    # unlabelled rows are no class: they set no size and all stay
    q = c.select(label_col, F.when(F.col(label_col).isNull(), F.col("count"))
                 .otherwise(c.filter(F.col(label_col).isNotNull()).agg(F.min("count")).scalar()).alias("quota"))
    return flag_smallest(df, [label_col], q, seed, id_col, narrow=narrow).filter("_sel").drop("_sel")


def oversample(df: DataFrame, label_col: str = "label", seed: int = 42,
               id_col: str = "doc_id") -> DataFrame:
    """SMP3: each class smaller than the largest is **replaced** by ``max_n`` draws
    with replacement; the largest class is kept as is.

    Draw ``d`` of class ``l`` picks the row of dense rank
    ``md5('{seed}:{l}:{d}')[0:15] mod n_l`` (60 bits, so every rank can be drawn);
    rows without a label stay as they are. Draw ids come from a distributed
    ``range``; the per-class counts (one row per class) are read on the driver.
    """
    narrow, df = _narrow(df, label_col, id_col)
    counts = {r[label_col]: r["count"] for r in class_counts(narrow, label_col).collect() if r[label_col] is not None}
    if len(counts) < 2:
        return df
    max_n = max(counts.values())
    spark = df.sparkSession
    keep = [l for l, n in counts.items() if n == max_n]
    parts = [df.filter(F.col(label_col).isin(keep) | F.col(label_col).isNull())]
    less = F.col(label_col).isNotNull() & ~F.col(label_col).isin(keep)
    ranked = rank_within_group(df.filter(less), [label_col], seed, id_col, narrow=narrow.filter(less))
    for l, n in counts.items():
        if n == max_n:
            continue
        slot = F.pmod(F.conv(F.substring(F.md5(F.concat(
            F.lit(f"{seed}:{l}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint"), F.lit(n))
        draws = spark.range(max_n).select(F.lit(l).cast(df.schema[label_col].dataType).alias(label_col),
                                          slot.alias("_rank"))
        rows = ranked.filter(F.col(label_col) == l)   # AQE broadcasts it when small
        parts.append(draws.join(rows, [label_col, "_rank"]).drop("_rank").select(*df.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffle_rows(df: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """SMP6: a repeatable row order (global range-partitioned sort by key)."""
    return df.orderBy(sample_key(seed, id_col), id_col)


def balance(df: DataFrame, method: str | None = "undersample", label_col: str = "label",
            seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """SMP2/SMP3/SMP4 dispatch; unknown method or None -> unchanged."""
    if method == "undersample":
        return undersample(df, label_col, seed, id_col)
    if method == "oversample":
        return oversample(df, label_col, seed, id_col)
    return df


# --- SMP5, ADV7 -------------------------------------------------------------------
def split_quotas(counts: dict, test_size: float) -> dict:
    """Per-class test quota: ``n_test = ceil(test_size * n)`` shared by floor +
    largest remainder (ties: smaller label first). Integer arithmetic only."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    base = {l: (c * n_test) // n for l, c in counts.items()}
    rem = {l: (c * n_test) % n for l, c in counts.items()}
    extra = n_test - sum(base.values())
    for l in sorted(counts, key=lambda l: (-rem[l], l is None, 0 if l is None else l))[:extra]:
        base[l] += 1
    return base


def stratified_split(df: DataFrame, label_col: str = "label", test_size: float = 0.2,
                     seed: int = 42, id_col: str = "doc_id", out_col: str = "split") -> DataFrame:
    """SMP5: add ``split`` in ('train','test'); class shares preserved exactly.

    The class-count table (one row per class) is read on the driver to
    compute the quotas; rows never leave the executors. Labels and ids are checkpointed once, for
    counts, quotas and cuts all read them; ``df`` itself is evaluated for its other columns only.
    """
    narrow, df = _narrow(df, label_col, id_col)
    counts = {r[label_col]: r["count"] for r in class_counts(narrow, label_col).collect()}
    q = split_quotas(counts, test_size)
    spark = df.sparkSession
    qdf = spark.createDataFrame([(k, v) for k, v in q.items()],
                                f"{label_col} {df.schema[label_col].dataType.simpleString()}, quota BIGINT")
    f = flag_smallest(df, [label_col], qdf, seed, id_col, flag="_sel", narrow=narrow)
    return f.withColumn(out_col, F.when(F.col("_sel"), F.lit("test")).otherwise(F.lit("train"))).drop("_sel")


def cv_folds(df: DataFrame, k: int = 5, label_col: str = "label", seed: int = 42,
             id_col: str = "doc_id", out_col: str = "fold") -> DataFrame:
    """ADV7: stratified folds, fold = (rank in class by key) mod k."""
    r = rank_within_group(df, [label_col], seed, id_col)
    return r.withColumn(out_col, (F.col("_rank") % k).cast("int")).drop("_rank")
