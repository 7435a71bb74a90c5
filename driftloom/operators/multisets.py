"""Tables as multisets: what was sent against what has landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _content(df: DataFrame) -> list[Column]:
    """Two unlike hashes of a row; nulls and empty strings differ."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*(F.when(c.isNull(), "0").otherwise("1") for c in columns))
    return [F.xxhash64(nulls, *columns).alias("h1"), F.xxhash64(F.lit(7), *columns, nulls).alias("h2")]


def reconcile(sent: DataFrame, landed: DataFrame) -> DataFrame:
    """How often each row is on both sides: the columns of ``sent``, sent, landed, state.

    One exchange of counted rows, grouped by 128 bits of their content: payloads are never
    sorted or compared, and equal rows are one before the exchange.  ``state`` is "ok",
    "lost" (fewer have landed), "repeated" (more have) or "foreign" (it was never sent).
    Columns go by place and need equal types; nulls equal nulls.
    """
    if [t for _, t in sent.dtypes] != [t for _, t in landed.dtypes]:
        raise ValueError("the sides' columns have different types")
    names, keep = sent.columns, [f"c{k}" for k in range(len(sent.columns))]
    rows = []
    for df, ours in ((sent, 1), (landed, 0)):
        one = df.toDF(*keep)
        rows.append(one.select(*_content(one), *keep, F.lit(ours).alias("ours")))
    counted = (
        rows[0].unionByName(rows[1]).groupBy("h1", "h2")
        .agg(*(F.first(c).alias(c) for c in keep), F.sum("ours").alias("sent"), F.sum(1 - F.col("ours")).alias("landed"))
    )
    state = (
        F.when(F.col("sent") == F.col("landed"), "ok").when(F.col("sent") == 0, "foreign").when(F.col("landed") < F.col("sent"), "lost").otherwise("repeated")
    )
    return counted.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), "sent", "landed", state.alias("state"))


def _times(counted: DataFrame, n: Column) -> DataFrame:
    columns = [c for c in counted.columns if c not in ("sent", "landed", "state")]
    return counted.filter(n > 0).select(*columns, F.explode(F.array_repeat(F.lit(1), n.cast("int"))).alias("copy")).select(*columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` beyond as many equal ones of ``right``."""
    return _times(reconcile(left, right), F.col("sent") - F.col("landed"))


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both sides have, as often as both have them."""
    return _times(reconcile(left, right), F.least("sent", "landed"))
