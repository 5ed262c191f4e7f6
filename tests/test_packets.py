"""Cleaning, labels and flows on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlens.functions import cleaning as C
from flowlens.operators.flows import build_flows
from flowlens.operators.labels import apply_labels, join_labels, label_domain, window_index
from flowlens.schema import ATTACK_LOG_SCHEMA

PACKET = (
    "packet_id long, capture_day string, capture_file string, packet_ts timestamp_ntz, ip_src string, ip_dst string, "
    "ip_proto int, tcp_srcport int, tcp_dstport int, udp_srcport int, udp_dstport int, tcp_flags int, frame_len long, "
    "ip_ttl int, tcp_window int, label string"
)


def at(seconds):
    return datetime.fromtimestamp(1_704_067_200 + seconds).replace(microsecond=0)


def packet(i, ts, src="a", dst="b", length=100, label="Benign", file="f0", sport=1, dport=2):
    return (i, "D0", file, ts, src, dst, 6, sport, dport, None, None, 0, length, 64, 10, label)


def values(df, name):
    return [r[name] for r in df.collect()]


def test_flags(spark):
    df = spark.createDataFrame([(x,) for x in ["0x0012", "18", "2.0", "bad", None, "0xzz"]], "f string")
    assert values(df.select(C.flags_value("f").alias("v")), "v") == [18, 18, 0, 0, 0, 0]


def test_payload_ratio(spark):
    df = spark.createDataFrame([(x,) for x in [0, 40, 41, 100]], "n long")
    assert values(df.select(C.payload_ratio("n").alias("v")), "v") == pytest.approx([0, 0, 1 / 41, 0.6])


def test_packet_time(spark):
    df = spark.createDataFrame([("1519862400.1234569",), ("x",), (None,), ("NaN",)], "t string")
    assert values(df.select(C.packet_time("t").alias("v")), "v") == [datetime(2018, 3, 1, 0, 0, 0, 123456), None, None, None]


def test_clean_adds_absent_columns_and_drops_untimed_rows(spark):
    df = spark.createDataFrame(
        [("1.5", "a", "b", "60", "x"), ("bad", "a", "b", "60", "1")],
        "frame_time_epoch string, ip_src string, ip_dst string, frame_len string, ip_ttl string",
    )
    row = C.clean_packets(df).collect()
    assert len(row) == 1
    assert (row[0]["frame_len"], row[0]["ip_ttl"], row[0]["tcp_window"], row[0]["tcp_flags"]) == (60.0, 0.0, 0, 0)


def log_of(spark, rows):
    return spark.createDataFrame(rows, ATTACK_LOG_SCHEMA)


@pytest.fixture(scope="module")
def labelled_cases(spark):
    log = log_of(spark, [
        (0, at(0), at(100), "10.0.0.1", "First"),
        (1, at(50), at(60), None, "Any"),
        (2, at(90), at(200), "it's", "Quote's"),
        (3, at(300), at(250), None, "Backwards"),
    ])
    rows = [
        packet(0, at(0), "10.0.0.1"), packet(1, at(100), "x", "10.0.0.10"), packet(2, at(55), "10.0.0.1"),
        packet(3, at(55), None, "z"), packet(4, at(101), "10.0.0.1"), packet(5, at(150), "it's"),
        packet(6, at(20), None, "10.0.0.1"), packet(7, at(20), None, None), packet(8, at(275), "x"),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], ", ".join(PACKET.split(", ")[:-1]))
    return df, log


EXPECTED = ["First", "First", "Any", "Any", "Benign", "Quote's", "First", "Benign", "Benign"]


def test_labels_last_match_wins(labelled_cases):
    df, log = labelled_cases
    assert values(apply_labels(df, log).orderBy("packet_id"), "label") == EXPECTED


def test_labels_long_log(labelled_cases):
    df, log = labelled_cases
    assert values(join_labels(df, log, most=1).orderBy("packet_id"), "label") == EXPECTED
    assert values(apply_labels(df, log, max_inline=2).orderBy("packet_id"), "label") == EXPECTED


def test_octet_match_stops_at_dots(labelled_cases):
    df, log = labelled_cases
    for found in (apply_labels(df, log, match="octet"), join_labels(df, log, match="octet")):
        assert values(found.orderBy("packet_id"), "label")[:2] == ["First", "Benign"]


def test_empty_log(spark, labelled_cases):
    df, log = labelled_cases
    assert set(values(apply_labels(df, log.filter("false")), "label")) == {"Benign"}


def test_label_domain(labelled_cases):
    assert label_domain(labelled_cases[1]) == ["Any", "Backwards", "Benign", "First", "Quote's"]
    assert label_domain(labelled_cases[1], max_inline=2) is None


@pytest.mark.parametrize("domain", [None, ["a", "b", "c"]])
def test_mode_ties_take_the_lowest(spark, domain):
    rows = [packet(i, at(i), label=x) for i, x in enumerate("baba")]
    flows = build_flows(spark.createDataFrame(rows, PACKET), label_domain=domain)
    assert values(flows, "label") == ["a"]


def test_label_outside_domain_is_an_error(spark):
    df = spark.createDataFrame([packet(0, at(0), label="z")], PACKET)
    with pytest.raises(Exception, match="label domain"):
        build_flows(df, label_domain=["a"]).collect()


def test_single_packet_flow(spark):
    row = build_flows(spark.createDataFrame([packet(0, at(0))], PACKET)).first()
    assert row["frame_len_std"] is None
    assert (row["flow_duration_sec"], row["packet_rate"]) == (0.0, 1000.0)


def test_flow_statistics_and_null_addresses(spark):
    rows = [packet(i, at(10 * i), length=n) for i, n in enumerate([100, 200, 300])]
    rows += [packet(9, at(0), src=None), packet(10, at(5), file="f1")]
    df = spark.createDataFrame(rows, PACKET)
    row = build_flows(df.filter("capture_file = 'f0'")).first()
    assert (row["frame_len_count"], row["frame_len_sum"], row["frame_len_mean"], row["frame_len_std"]) == (3, 600, 200.0, 100.0)
    assert (row["flow_duration_sec"], row["packet_rate"]) == (20.0, 3 / 20)
    assert build_flows(df).count() == 1
    assert build_flows(df, per_file=True).count() == 2


def test_flow_counts_add_up(tables):
    total = tables.flows.agg(F.sum("frame_len_count")).first()[0]
    assert total == tables.packets.filter("ip_src is not null").count()


def test_an_attack_without_name_is_benign_in_both_forms(labelled_cases):
    df, log = labelled_cases
    unnamed = log.withColumn("attack_type", F.when(F.col("log_id") != 1, F.col("attack_type")))
    short, long = (f(df.withColumnRenamed("packet_id", "n"), unnamed).orderBy("n") for f in (apply_labels, join_labels))
    assert values(short, "label") == values(long, "label")
    assert None not in values(short, "label")


def long_log(n, seed=1):
    """Windows of very different lengths, crowded into one second on one host and spread over others, and a few hundred addresses."""
    import random

    rng, base = random.Random(seed), 1_700_000_000_000_000
    targets = ["10.0.0.1", "10.0.0.", "10.0", "10.0.0.12", None, "", "172.31.69.25", "10.1.2."]
    rows = []
    for i in range(n):
        crowded = rng.random() < 0.7
        start = base + (rng.randrange(1_000_000) if crowded else rng.randrange(7_200_000_000))
        length = rng.choice([0, 5, 300, 40_000, 900_000]) if crowded or rng.random() < 0.5 else rng.randrange(3_000_000_000)
        target = "10.0.0.1" if crowded else rng.choice(targets) if rng.random() < 0.02 else f"10.{rng.randrange(4)}.{rng.randrange(3)}.{rng.randrange(200)}"
        rows.append((i, start, start + length, target, None if rng.random() < 0.05 else f"A{i % 50}"))
    packets = [(k, base + (rng.randrange(1_100_000) if k % 2 else rng.randrange(7_300_000_000)),
                rng.choice(["10.0.0.1", "10.0.0.12", f"10.{rng.randrange(4)}.{rng.randrange(3)}.{rng.randrange(200)}", None]),
                rng.choice(["10.0.0.13", "172.31.69.25", "8.8.8.8"])) for k in range(600)]
    return rows, packets


@pytest.mark.parametrize("n, most, match", [(1500, 8, "prefix"), (1500, 8, "octet"), (20_000, 64, "prefix")])
def test_long_logs_label_like_a_walk_through_them(spark, n, most, match):
    rows, packets = long_log(n)
    times = lambda df, *names: df.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in names})
    log = times(spark.createDataFrame(rows, "log_id int, start_ts long, end_ts long, target_ip string, attack_type string"), "start_ts", "end_ts")
    df = times(spark.createDataFrame(packets, "packet_id int, packet_ts long, ip_src string, ip_dst string"), "packet_ts")
    index = window_index(log, match, most)
    assert len(index) > 2  # one host's second is cut further
    assert max(t.agg(F.max(F.size("_windows"))).first()[0] or 0 for _, t in index) <= most + 1

    def hits(ip, target):
        stem = target.rstrip(".")
        return ip is not None and (ip.startswith(target) if match == "prefix" else ip == stem or ip.startswith(stem + ".") and stem != "")

    expected = {}
    for k, at, src, dst in packets:
        fits = [w for w in rows if w[1] <= at <= w[2] and (w[3] is None or hits(src, w[3]) or hits(dst, w[3]))]
        expected[k] = (fits[-1][4] or "Benign") if fits else "Benign"
    found = {r["packet_id"]: r["label"] for r in join_labels(df, log, match, most=most).collect()}
    assert found == expected and len(set(found.values())) > 10
