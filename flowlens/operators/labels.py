"""Packet labels from a log of attack windows, and the tables around that log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from flowlens.functions.ordering import epoch_us
from flowlens.schema import BENIGN
from flowlens.session import materialize

# A log this short becomes one CASE expression inside the packet scan.
MAX_INLINE_WINDOWS = 256


def sql_text(value: str) -> str:
    """A string literal for :func:`pyspark.sql.functions.expr`."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(ip: str, target: str, match: str) -> str:
    """SQL text: does the address match the target?"""
    if match == "prefix":
        return f"startswith({ip}, {target})"
    if match == "octet":
        stem = f"rtrim('.', {target})"
        return f"({ip} = {stem} or startswith({ip}, concat({stem}, '.')))"
    raise ValueError(f"unknown match rule {match!r}")


def _window_branch(window: Row, ts: str, match: str) -> str:
    inside = f"{ts} between timestamp_ntz'{window['start_text']}' and timestamp_ntz'{window['end_text']}'"
    if window["target_ip"] is not None:
        target = sql_text(window["target_ip"])
        inside += f" and ({_hits('ip_src', target, match)} or {_hits('ip_dst', target, match)})"
    attack = BENIGN if window["attack_type"] is None else window["attack_type"]
    return f"when {inside} then {sql_text(attack)}"


def apply_labels(
    packets: DataFrame,
    attack_log: DataFrame,
    match: str = "prefix",
    ts: str = "packet_ts",
    max_inline: int = MAX_INLINE_WINDOWS,
) -> DataFrame:
    """Add ``label``: the last log row whose window and target fit, else Benign.

    A log row without attack type labels its packets Benign. The log is read up to
    ``max_inline + 1`` rows. A short one becomes a CASE expression, newest row first,
    so labelling costs no shuffle and no join. A longer one goes through
    :func:`join_labels`, which gives the same labels.
    """
    head = attack_log.select(
        "log_id", "target_ip", "attack_type",
        F.col("start_ts").cast("string").alias("start_text"),
        F.col("end_ts").cast("string").alias("end_text"),
    ).limit(max_inline + 1).collect()
    if len(head) > max_inline:
        return join_labels(packets, attack_log, match, ts)
    if not head:
        return packets.withColumn("label", F.lit(BENIGN))
    newest_first = sorted(head, key=lambda w: w["log_id"], reverse=True)
    branches = " ".join(_window_branch(w, ts, match) for w in newest_first)
    return packets.withColumn("label", F.expr(f"case {branches} else '{BENIGN}' end"))


#: Widths of the index's time buckets in microseconds; a bucket too full at one width is cut at the next.
BUCKET_WIDTHS = (3_600_000_000, 60_000_000, 1_000_000, 20_000, 500, 20, 1)
MOST_WINDOWS = 64


#: The index's name for an empty target: as a text prefix it fits every address, but not a missing one.
ANY_ADDRESS = "*"


def _stems(ip: str, match: str) -> str:
    """SQL text: the targets that an address matches."""
    if match == "prefix":
        return f"array_append(transform(sequence(1, greatest(1, length({ip}))), n -> left({ip}, n)), '{ANY_ADDRESS}')"
    if match == "octet":
        return f"transform(sequence(1, size(split({ip}, '[.]'))), n -> substring_index({ip}, '.', n))"
    raise ValueError(f"unknown match rule {match!r}")


def window_index(attack_log: DataFrame, match: str = "prefix", most: int = MOST_WINDOWS) -> list[tuple[int, DataFrame]]:
    """The log as (bucket width, rows of _bucket, _target, _windows), ``_target`` '' for all hosts.

    ``_windows`` are those of a target that a packet in the bucket can meet, in log order. Of windows that
    cover a bucket only the last counts, and windows before it in the log count no more; a
    bucket with more than ``most`` others is cut into narrower ones, so no array is longer than
    ``most`` + 1. Only the log is read; the widths bound the number of rounds.
    """
    stem = F.col("target_ip") if match == "prefix" else F.rtrim("target_ip", F.lit("."))
    target = F.when(F.col("target_ip").isNull(), "").when(stem == "", ANY_ADDRESS).otherwise(stem)
    log = attack_log.filter(F.col("start_ts") <= F.col("end_ts")).select(
        target.alias("_target"), F.struct("log_id", "start_ts", "end_ts", "attack_type").alias("w"),
        epoch_us("start_ts").alias("_from"), epoch_us("end_ts").alias("_to"))
    open_, index = log, []
    for place, width in enumerate(BUCKET_WIDTHS):
        start = F.col("_bucket") * width
        placed = open_.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))
        covers = (F.col("_from") <= start) & (F.col("_to") >= start + width - 1)
        placed = placed.withColumn("_covers", covers)
        last = placed.filter("_covers").groupBy("_bucket", "_target").agg(F.max("w.log_id").alias("_last"))
        placed = placed.join(last, ["_bucket", "_target"], "left").filter(
            F.col("_last").isNull() | (F.col("w.log_id") >= F.col("_last"))).drop("_last")
        counts = placed.groupBy("_bucket", "_target").agg(F.count_if(~F.col("_covers")).alias("_n"))
        full = counts.filter(F.col("_n") > most).drop("_n") if place + 1 < len(BUCKET_WIDTHS) else counts.limit(0).drop("_n")
        full = materialize(full, "full-buckets")
        some = full.limit(1).count() > 0
        done = placed.join(full, ["_bucket", "_target"], "left_anti") if some else placed
        index.append((width, materialize(
            done.groupBy("_bucket", "_target").agg(F.sort_array(F.collect_list("w")).alias("_windows")), "window-index")))
        if not some:
            break
        # the part of a window inside its full bucket goes on
        open_ = materialize(placed.join(full, ["_bucket", "_target"], "left_semi").select(
            "_target", "w", F.greatest("_from", start).alias("_from"), F.least("_to", start + width - 1).alias("_to")), "full-windows")
    return index


def join_labels(
    packets: DataFrame, attack_log: DataFrame, match: str = "prefix", ts: str = "packet_ts", most: int = MOST_WINDOWS,
) -> DataFrame:
    """Labels for a log of any length, the same as the short form gives.

    The log is indexed by time bucket and target. The addresses seen in each bucket are few beside the
    packets; they look up the targets they match, so a packet meets only windows that its
    own addresses can match, by two joins on (bucket, address) and one on the bucket for windows
    of all hosts. Spark broadcasts those tables where they are small.
    """
    fits = f"w -> {ts} between w.start_ts and w.end_ts"
    rows, found = packets, []
    for width, index in window_index(attack_log, match, most):
        name = f"_bucket_{width}"
        rows = rows.withColumn(name, F.floor(epoch_us(ts) / width))
        seen = packets.select(F.floor(epoch_us(ts) / width).alias("_bucket"), F.explode(F.array("ip_src", "ip_dst")).alias("_ip"))
        seen = seen.filter("_ip is not null").distinct()
        stems = seen.withColumn("_target", F.explode(F.expr(_stems("_ip", match))))
        hosts = materialize(stems.join(index, ["_bucket", "_target"]).groupBy("_bucket", "_ip").agg(
            F.flatten(F.collect_list("_windows")).alias("_windows")), "host-windows")
        everywhere = index.filter("_target = ''")
        for table, key in ((hosts, "ip_src"), (hosts, "ip_dst"), (everywhere, None)):
            out = f"_windows_{len(found)}"
            found.append(out)
            picked = table.select(F.col("_bucket").alias(name), *([F.col("_ip").alias(key)] if key else []), F.col("_windows").alias(out))
            rows = rows.join(picked, [name, key] if key else name, "left")
    last = " , ".join(f"array_max(filter({w}, {fits}))" for w in found)
    best = F.expr(f"array_max(array({last}))")
    labelled = rows.withColumn("label", F.coalesce(best["attack_type"], F.lit(BENIGN)))
    return labelled.select(*[F.col(f"`{c}`") for c in packets.columns if c != "label"], "label")


def label_domain(attack_log: DataFrame, max_inline: int = MAX_INLINE_WINDOWS) -> list[str] | None:
    """Benign plus the log's attack types, sorted; None when there are very many types."""
    head = attack_log.select("attack_type").filter("attack_type is not null").distinct().limit(max_inline + 1).collect()
    if len(head) > max_inline:
        return None
    return sorted({BENIGN, *(r["attack_type"] for r in head)})


def shift_log(attack_log: DataFrame, hours: int) -> DataFrame:
    """Move the log from capture-site time to UTC."""
    step = F.expr(f"interval {int(hours)} hours")
    return attack_log.withColumns(
        {"start_ts": F.col("start_ts") + step, "end_ts": F.col("end_ts") + step}
    )


def remap_targets(attack_log: DataFrame, remap: DataFrame) -> DataFrame:
    """Replace target addresses by ``remap(target_ip, new_target_ip)`` where listed."""
    return (
        attack_log.join(remap, "target_ip", "left")
        .withColumn("target_ip", F.coalesce("new_target_ip", "target_ip"))
        .select(*attack_log.columns)
    )


def canonical_labels(df: DataFrame, spelling: DataFrame, label: str = "label") -> DataFrame:
    """Variant spellings to canonical labels through ``spelling(variant, canonical)``."""
    return (
        df.join(spelling.withColumnRenamed("variant", label), label, "left")
        .withColumn(label, F.coalesce("canonical", label))
        .select(*df.columns)
    )


def capture_gaps(packets: DataFrame, attack_log: DataFrame, ts: str = "packet_ts") -> DataFrame:
    """Each attack window against the captures of its days.

    A window is covered when some day's capture range overlaps it; otherwise it
    is a gap.
    """
    days = packets.groupBy(F.col(ts).cast("date").alias("day")).agg(
        F.min(ts).alias("capture_start"), F.max(ts).alias("capture_end")
    )
    windows = attack_log.withColumn(
        "day", F.explode(F.sequence(F.col("start_ts").cast("date"), F.col("end_ts").cast("date")))
    )
    overlap = (F.col("start_ts") <= F.col("capture_end")) & (F.col("end_ts") >= F.col("capture_start"))
    return (
        windows.join(days, "day", "left")
        .groupBy("log_id", "attack_type", "start_ts", "end_ts")
        .agg(
            F.sum(F.when(overlap, 1).otherwise(0)).alias("days_covered"),
            F.min("capture_start").alias("capture_start"),
            F.max("capture_end").alias("capture_end"),
        )
        .withColumn("status", F.when(F.col("days_covered") > 0, "covered").otherwise("gap"))
    )
