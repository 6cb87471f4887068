"""Bring texts that look the same to one form, as Spark columns.

The kernel is :mod:`lodegraph.llm.lookalikes`.  Only texts with a character
outside printable ASCII reach Python; in each Arrow batch every distinct text is
worked on once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.lookalikes import clean, confusables, kinds, use

UNPLAIN = r"[^ -~]"


def _each_distinct(x: pa.Array, f, kind: pa.DataType) -> pa.Array:
    coded = x.dictionary_encode()
    return pa.array([None if v is None else f(v) for v in coded.dictionary.to_pylist()], kind).take(coded.indices)


def _udf(f: Callable, kind: T.DataType, arrow_kind: pa.DataType) -> Callable:
    """A column function of a kernel, with the driver's table of look-alikes sent along (a few thousand letters)."""
    table = confusables()

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        use(table)
        return _each_distinct(x, f, arrow_kind)

    return run


def _clean(c: Column | str) -> Column:
    return _udf(clean, T.StringType(), pa.string())(c)


def _kinds(c: Column | str) -> Column:
    return _udf(kinds, T.ArrayType(T.StringType()), pa.list_(pa.string()))(c)


def consistent(c: Column) -> Column:
    """The consistent form of a text; null for null. Plain texts stay in the JVM."""
    return F.coalesce(_clean(F.when(c.rlike(UNPLAIN), c)), c)


def inconsistent_texts(
    df: DataFrame, key: str, fields: Sequence[str] = (), list_fields: Sequence[str] = (), table_name: str = ""
) -> DataFrame:
    """One row for each text that isn't in its consistent form.

    Result: table_name, record_key, field_name, item_pos (place in a list field
    from 1, else 1), text, clean_text.  Null texts and null elements have no
    form and give no row; an empty text is consistent; a text of invisible
    characters alone has the empty form.  Rows sent again under the same key
    count once.
    """
    cells = [F.struct(F.lit(f).alias("field_name"), F.lit(1).alias("item_pos"), F.col(f).alias("text")) for f in fields]
    parts = []
    if cells:
        parts.append(df.select(F.col(key).alias("record_key"), F.inline(F.array(*cells))))
    for f in list_fields:
        parts.append(
            df.select(F.col(key).alias("record_key"), F.lit(f).alias("field_name"), F.posexplode(f).alias("item_pos", "text"))
            .withColumn("item_pos", F.col("item_pos") + 1)
        )
    out = None
    for part in parts:
        part = part.filter(F.col("text").rlike(UNPLAIN))
        out = part if out is None else out.unionByName(part)
    return (
        out.withColumn("clean_text", _clean("text"))
        .filter(F.col("clean_text") != F.col("text"))
        .dropDuplicates(["record_key", "field_name", "item_pos"])
        .select(F.lit(table_name).alias("table_name"), "record_key", "field_name", F.col("item_pos").cast("long").alias("item_pos"), "text", "clean_text")
    )


def token_kinds(df: DataFrame, fields: Sequence[str] = (), list_fields: Sequence[str] = ()) -> DataFrame:
    """How many tokens of the unplain texts of some fields are of one script, mixed, or wholly confusable."""
    texts = F.flatten(F.array(*[F.array(f) for f in fields], *[F.coalesce(F.col(f), F.array().cast("array<string>")) for f in list_fields]))
    each = df.select(F.explode(texts).alias("text")).filter(F.col("text").rlike(UNPLAIN))
    return each.select(F.explode(_kinds("text")).alias("token_kind")).groupBy("token_kind").agg(F.count("*").alias("n_tokens"))
