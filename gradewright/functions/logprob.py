"""Confidence of an emitted label from its token log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_label_probability(rows: DataFrame, tokens: str, value: str, key: str | None = None,
                           out: str = "logprob_confidence") -> DataFrame:
    """Probability of the label text, as the product over the tokens it touches.

    The label is searched after the last occurrence of its quoted key, so an
    echoed list of permitted values earlier in the reply is not measured. NULL
    when the key or the label cannot be located or no token overlaps it.

    ``tokens`` is ARRAY<STRUCT<token, logprob>>. The text is rebuilt once and the
    label located once, as projections of their own; the fold over the tokens
    then only compares offsets. Nothing is exploded.
    """
    token, text, start = F.col(tokens), F.col("_text"), F.col("_start")
    staged = rows.withColumn("_text", F.array_join(F.transform(token, lambda t: t["token"]), ""))
    if key is None:
        staged = staged.withColumn("_start", F.call_function("locate", F.col(value), text) - 1)
    else:
        quoted = f'"{key}"'
        after = F.length(text) - F.length(F.substring_index(text, quoted, -1))
        staged = staged.withColumn("_start", F.when(
            F.contains(text, F.lit(quoted)),
            F.call_function("locate", F.col(value), text, after + F.lit(1)) - 1))
    staged = staged.withColumn("_end", start + F.length(value))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("logsum"), F.lit(0).alias("hit"))

    def step(acc: Column, t: Column) -> Column:
        stop = acc["at"] + F.length(t["token"])
        touches = (acc["at"] < F.col("_end")) & (start < stop)
        return F.struct(
            stop.alias("at"),
            F.when(touches, acc["logsum"] + t["logprob"]).otherwise(acc["logsum"]).alias("logsum"),
            F.when(touches, acc["hit"] + 1).otherwise(acc["hit"]).alias("hit"))

    staged = staged.withColumn("_fold", F.when(start >= 0, F.aggregate(token, zero, step)))
    return staged.withColumn(out, F.when(
        F.col("_fold.hit") > 0, F.least(F.exp("_fold.logsum"), F.lit(1.0)))
    ).drop("_text", "_start", "_end", "_fold")
