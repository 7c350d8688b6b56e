"""Token n-grams without lambdas.

Higher-order functions with lambdas (``transform``/``filter``) are evaluated
interpreted, element by element. Shifted ``slice``s zipped with
``arrays_zip`` and exploded with ``posexplode`` produce the same n-grams with
code-generated expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngram_rows(df: DataFrame, tokens_col: str, n: int, keep=(), out: str = "gram",
               pos: str = "pos") -> DataFrame:
    """One row per n-gram: ``keep.. , pos (0-based start), out = tokens joined by ' '``.

    Documents shorter than ``n`` tokens yield no rows.
    """
    t = F.col(tokens_col)
    if n == 1:
        return df.select(*keep, F.posexplode(t).alias(pos, out))
    m = F.size(t) - n + 1
    parts = [F.slice(t, k + 1, F.greatest(m, F.lit(0))).alias(f"_g{k}") for k in range(n)]
    z = df.select(*keep, F.posexplode(F.when(m > 0, F.arrays_zip(*parts))).alias(pos, "_z"))
    return z.select(*keep, pos, F.concat_ws(" ", *[F.col(f"_z._g{k}") for k in range(n)]).alias(out))


def ngram_union(df: DataFrame, tokens_col: str, ns, keep=(), out: str = "gram",
                pos: str = "pos", n_col: str | None = "n") -> DataFrame:
    """Rows for every n in ``ns`` (with an ``n`` column when ``n_col`` is given)."""
    res = None
    for n in ns:
        r = ngram_rows(df, tokens_col, n, keep, out, pos)
        if n_col:
            r = r.withColumn(n_col, F.lit(n))
        res = r if res is None else res.unionByName(r)
    return res
