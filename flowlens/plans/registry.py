"""Registration of queries with their check SQL, and the base tables they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.cleaning import clean_packets
from flowlens.operators.flows import build_flows
from flowlens.operators.joins import with_row_index
from flowlens.operators.labels import apply_labels, label_domain
from flowlens.operators.sequences import session_windows
from flowlens.operators.split import stratified_split
from flowlens.operators.triage import batch_triage
from flowlens.plans import fixtures
from flowlens.plans.oracle import with_base
from flowlens.schema import FLOW_KEY
from flowlens.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Base tables of one run, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def packets(self) -> DataFrame:
        return fixtures.packets(self.spark, self.sf_dir)

    @cached_property
    def log(self) -> DataFrame:
        return fixtures.attack_log(self.spark)

    @cached_property
    def domain(self) -> list[str] | None:
        return label_domain(self.log)

    @cached_property
    def labelled(self) -> DataFrame:
        return apply_labels(self.packets, self.log)

    @cached_property
    def clean(self) -> DataFrame:
        return clean_packets(self.labelled)

    @cached_property
    def flows(self) -> DataFrame:
        return build_flows(self.clean, label_domain=self.domain)

    @cached_property
    def file_flows(self) -> DataFrame:
        ids = fixtures.packet_ids()
        del ids["last_packet_id"]
        return build_flows(self.clean, per_file=True, label_domain=self.domain, extra=ids)

    @cached_property
    def file_windows(self) -> DataFrame:
        return session_windows(self.clean, 20, 5, per_file=True, label_domain=self.domain)

    @cached_property
    def seqs(self) -> DataFrame:
        return with_row_index(
            self.file_windows.select("capture_day", "capture_file", "ip_src", "ip_dst", "win", "label"),
            ["ip_src", "ip_dst", "win"],
        )

    @cached_property
    def indexed_flows(self) -> DataFrame:
        return with_row_index(self.file_flows, FLOW_KEY)

    @cached_property
    def scored(self) -> DataFrame:
        return fixtures.with_scores(build_flows(self.clean, label_domain=self.domain, extra=fixtures.packet_ids()))

    @cached_property
    def file_scored(self) -> DataFrame:
        return fixtures.with_scores(
            build_flows(self.clean, per_file=True, label_domain=self.domain, extra=fixtures.packet_ids())
        )

    @cached_property
    def triaged(self) -> DataFrame:
        return batch_triage(self.scored)

    @cached_property
    def file_triaged(self) -> DataFrame:
        return batch_triage(self.file_scored)

    @cached_property
    def split_rows(self) -> DataFrame:
        return stratified_split(self.file_flows, ["first_packet_id"], ROW_KEY())

    def store(self, *names: str) -> "Tables":
        """Write the named tables once; everything built on them afterwards reads the copy.

        For queries that use a table on several branches, which would otherwise
        go back to the packets each time.
        """
        for name in names:
            self.__dict__[name] = materialize(getattr(self, name), name)
        return self

    @cached_property
    def files(self) -> DataFrame:
        return self.file_flows.groupBy("capture_day", "capture_file").agg(F.count(F.lit(1)).alias("n"))


def ROW_KEY() -> Column:
    """Arithmetic sampling key, so an SQL engine draws the same rows."""
    return F.expr("(first_packet_id * 7919 + 104729) % 1000003")


def FILE_ORDER_KEY() -> Column:
    return F.expr(
        "(cast(substr(capture_day, 2, 2) as int) * 5 + cast(substr(capture_file, 5, 1) as int) + 1) * 245489 % 1000003"
    )


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(tables)`` as a query; ``sql`` is its check over the same base tables."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_base(sql, extra)
        return fn

    return register


def r6(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Round double columns so engines that add in another order agree."""
    names = columns or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in names})
