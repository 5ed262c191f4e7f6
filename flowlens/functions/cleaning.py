"""Typed packet columns from raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from flowlens.schema import (
    BENIGN, LEGACY_FLOW_COLUMNS, NUMERIC_PACKET_COLUMNS, PROTOCOL_NAMES, RAW_PACKET_COLUMNS,
)


def packet_time(epoch_text: Column | str) -> Column:
    """Epoch seconds as text to TIMESTAMP_NTZ, cut to microseconds; bad text is NULL.

    DECIMAL keeps the sub-microsecond digits a double would round.
    """
    col = F.col(epoch_text) if isinstance(epoch_text, str) else epoch_text
    micros = F.floor(col.try_cast("decimal(20,9)") * F.lit(1_000_000)).cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def number_or_zero(df: DataFrame, name: str) -> Column:
    """Absent, NULL or unreadable values become 0; typed columns keep their type."""
    if name not in df.columns:
        return F.lit(0)
    if isinstance(df.schema[name].dataType, T.StringType):
        parsed = F.col(name).try_cast("double")
        return F.when(parsed.isNull() | F.isnan(parsed), F.lit(0.0)).otherwise(parsed)
    return F.coalesce(F.col(name), F.lit(0).cast(df.schema[name].dataType))


def flags_value(flags: Column | str) -> Column:
    """``0x..`` hex or plain digits to int, everything else 0."""
    col = (F.col(flags) if isinstance(flags, str) else flags).cast("string")
    hexed = F.conv(F.substring(col, 3, 16), 16, 10).try_cast("int")
    return F.coalesce(
        F.when(col.startswith("0x"), hexed).when(col.rlike("^[0-9]+$"), col.try_cast("int")),
        F.lit(0),
    )


def payload_ratio(length: Column | str) -> Column:
    col = F.col(length) if isinstance(length, str) else length
    return F.when(col > 40, (col - 40) / col.cast("double")).otherwise(F.lit(0.0))


def rename_raw(df: DataFrame) -> DataFrame:
    """Dotted capture names to plain ones, once, at ingest."""
    return df.withColumnsRenamed({k: v for k, v in RAW_PACKET_COLUMNS.items() if k in df.columns})


def normalize_flow_names(df: DataFrame) -> DataFrame:
    """Older flow exports to current column names, the label column included."""
    return df.withColumnsRenamed({k: v for k, v in LEGACY_FLOW_COLUMNS.items() if k in df.columns})


def clean_packets(df: DataFrame) -> DataFrame:
    """Typed, NULL-free packet columns plus ``payload_ratio``; rows without a time are dropped."""
    if "packet_ts" not in df.columns:
        df = df.withColumn("packet_ts", packet_time("frame_time_epoch"))
    flags = flags_value("tcp_flags") if "tcp_flags" in df.columns else F.lit(0)
    typed = df.filter(F.col("packet_ts").isNotNull()).withColumns(
        {c: number_or_zero(df, c) for c in NUMERIC_PACKET_COLUMNS} | {"tcp_flags": flags}
    )
    return typed.withColumn("payload_ratio", payload_ratio("frame_len"))


def with_packet_id(packets: DataFrame) -> DataFrame:
    """Add ``packet_id`` from the row's content, to order packets of equal time repeatably.

    Equal rows share an id; they are interchangeable.
    """
    return packets.withColumn("packet_id", F.xxhash64(*[F.col(c) for c in packets.columns]))


def protocol_name(proto: Column | str) -> Column:
    col = F.col(proto) if isinstance(proto, str) else proto
    chain = None
    for number, name in PROTOCOL_NAMES.items():
        chain = F.when(col == number, name) if chain is None else chain.when(col == number, name)
    return chain.otherwise(F.concat(F.lit("Other("), col.cast("string"), F.lit(")")))


def is_attack(label: Column | str = "label") -> Column:
    col = F.col(label) if isinstance(label, str) else label
    return (col != BENIGN).cast("int")


def is_internal(ip: Column | str, prefix: str = "172.31.") -> Column:
    col = F.col(ip) if isinstance(ip, str) else ip
    return col.startswith(prefix)


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and infinities to 0 (NaN sorts above every number, so it fails the test too)."""
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))


def clamp_scaled(name: str, bound: float = 10.0) -> Column:
    """Scaled column: NaN and NULL to 0, infinities to +-bound, the rest untouched."""
    return F.expr(
        f"case when abs(`{name}`) < double('inf') then `{name}` when `{name}` = double('inf') then {float(bound)}d "
        f"when `{name}` = double('-inf') then {-float(bound)}d else 0d end"
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
