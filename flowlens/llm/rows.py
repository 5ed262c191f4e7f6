"""Carrying whole rows through an operator, whatever their other columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id``, ``text`` and ``rest``, a struct of everything but the text, so no name can clash."""
    rest = [col(c) for c in df.columns if c != text_col]
    return df.select(
        col(id_col).alias("id"), col(text_col).cast("string").alias("text"), F.struct(*rest).alias("rest"))


def unpack(packed: DataFrame, like: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``like`` again, in their order."""
    return packed.select(*[
        F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in like.columns])
