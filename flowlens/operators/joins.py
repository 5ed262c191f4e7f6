"""Flow and sequence alignment, and file parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.ordering import sliced_row_number
from flowlens.schema import FILE_KEY, SESSION_KEY


def with_row_index(df: DataFrame, order: Sequence[str], group: Sequence[str] = FILE_KEY) -> DataFrame:
    """0-based ``row_idx`` per file in a declared order; the leading two order columns slice hot files."""
    ranked = sliced_row_number(df, "_rank", group, list(order), list(order[:2]))
    return ranked.withColumn("row_idx", F.col("_rank") - 1).drop("_rank")


def positional_join(flows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pair flow and sequence rows of a file by position; clashing names get ``_seq``.

    The two tables have different grains, so a pair need not describe the same
    session; :func:`session_join` does.
    """
    key = [*FILE_KEY, "row_idx"]
    clashes = {c: f"{c}_seq" for c in sequences.columns if c in flows.columns and c not in key}
    return flows.join(sequences.withColumnsRenamed(clashes), key)


def session_join(flows: DataFrame, sequence_scores: DataFrame, score: str = "t_score") -> DataFrame:
    """Give every flow the highest window score of its session in its capture; NULL where it has none."""
    key = [*FILE_KEY, *SESSION_KEY]
    return flows.join(sequence_scores.groupBy(*key).agg(F.max(score).alias(score)), key, "left")


def matching_sequences(sequences: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Sequences whose (file, position) is among the test rows."""
    return sequences.join(test_rows, [*FILE_KEY, "row_idx"], "left_semi")


def unprocessed(inputs: DataFrame, outputs: DataFrame, key: Sequence[str] = FILE_KEY) -> DataFrame:
    """Inputs without an output."""
    return inputs.select(*key).distinct().join(outputs.select(*key).distinct(), list(key), "left_anti")
