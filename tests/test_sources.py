"""Files in, files out."""

import codecs
import os
from datetime import datetime

from pyspark.sql import functions as F

from flowlens.operators.joins import unprocessed
from flowlens.plans.dataset_build import build_dataset, build_folder
from flowlens.schema import FLOW_SCHEMA
from flowlens.sources import datasets as D
from flowlens.sources import packets as PK
from flowlens.sources.attack_log import read_attack_log
from flowlens.sources.footers import footer_rows, schema_drift
from flowlens.sources.ingest import ingest, inspect_files

HEADER = '"frame.time_epoch","ip.src","ip.dst","frame.len","tcp.flags"'
BODY = '"1.5","10.0.0.1","10.0.0.2","60","0x0012"\n"2.5","10.0.0.1",,"70","bad"\n'


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_encodings_give_the_same_rows(spark, tmp_path):
    text = HEADER + "\n" + BODY
    forms = {
        "bom8": codecs.BOM_UTF8 + text.encode("utf-8"), "plain": text.encode("utf-8"), "utf16": text.encode("utf-16"),
        "utf16be": codecs.BOM_UTF16_BE + text.encode("utf-16-be"),
    }
    seen = []
    for name, data in forms.items():
        write(f"{tmp_path}/{name}/a.csv", data)
        seen.append(sorted(map(str, PK.read_packets(spark, f"{tmp_path}/{name}").collect())))
    assert len(seen[0]) == 2 and all(s == seen[0] for s in seen)
    assert PK.detect_encoding(spark, f"{tmp_path}/utf16") == "UTF-16"


def records(n, host):
    return "".join(f'"{i}.5","10.0.0.{host}",{"" if i % 3 == 0 else chr(34) + "10.0.0.2" + chr(34)},"{60 + i}","0x0012"\n' for i in range(n))


def mixed_folder(root):
    """Files of every kind in one folder; what ``ingest`` should make of each: encoding, status, reason, records."""
    whole = lambda host, n=50: HEADER + "\n" + records(n, host)
    shorter = HEADER.replace(',"tcp.flags"', "")
    files = {
        "plain": (whole(1).encode(), "UTF-8", "success", None, 50),
        "mark 8+%": (codecs.BOM_UTF8 + whole(2).encode(), "UTF-8", "success", None, 50),
        "wide": (whole(3, 4000).replace("\n", "\r\n").encode("utf-16"), "UTF-16LE", "success", None, 4000),
        "wide-be": (codecs.BOM_UTF16_BE + whole(4).encode("utf-16-be"), "UTF-16BE", "success", None, 50),
        "wide-unmarked": (('"ip.src","frame.time_epoch"\n' + '"10.0.0.5","1.25"\n' * 5).encode("utf-16-le"), "UTF-16LE", "success", None, 5),
        "only-header": ((HEADER + "\n").encode(), "UTF-8", "success", None, 0),
        "no-line-end": (whole(6).encode()[:-1], "UTF-8", "success", None, 50),
        "untimed": (b"frame.number,ip.src\n1,10.0.0.1\n", "UTF-8", "skipped", "no frame.time_epoch column", None),
        "cut-off": (whole(7).encode()[:-4], "UTF-8", "error", "the last record is cut off", None),
        "shifted": ((shorter + "\n" + records(50, 8)).encode(), "UTF-8", "error", "the last record has 5 fields, the header 4", None),
        "hole": ((whole(9, 20) + '"1.5","10.0.0.1"\n' + records(20, 9)).encode(), "UTF-8", "error", "1 of 41 records do not fit the header", 41),
        "blank": (b"\n\n", "UTF-8", "error", "no header", None),
        "noise": (b"\xc3\x28\xa0\xa1,\n" * 9, None, "error", "not utf-8 text", None),
        "twice": (b"frame.time_epoch,ip.src,ip.src\n1,2,3\n", "UTF-8", "error", "a column is named twice", None),
    }
    for k, (name, (data, *_)) in enumerate(files.items()):
        write(f"{root}/capture_day=D{k % 2}/capture_file={name.replace('%', '%25')}/x.csv", data)
    return {name: tuple(rest) for name, (_, *rest) in files.items()}


def test_every_file_is_judged_on_its_own(spark, tmp_path):
    expected = mixed_folder(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1000)
    try:
        read = ingest(spark, str(tmp_path))
        scan = spark.read.option("encoding", "UTF-16LE").option("lineSep", "\n").csv(f"{tmp_path}/capture_day=D0/capture_file=wide")
        assert scan.rdd.getNumPartitions() > 5  # one wide file, many tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {r["capture_file"]: (r["encoding"], r["status"], r["reason"], r["records"]) for r in read.manifest.collect()}
    assert found == expected
    rows = read.packets.groupBy("capture_file").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["capture_file"]: r["n"] for r in rows} == {n: e[3] for n, e in expected.items() if e[1] == "success" and e[3]}
    wide = read.packets.filter("capture_file = 'wide'")
    lines = sorted(tuple(r) for r in wide.select("frame_time_epoch", "ip_src", "ip_dst", "frame_len", "tcp_flags").collect())
    assert lines == sorted((f"{i}.5", "10.0.0.3", None if i % 3 == 0 else "10.0.0.2", str(60 + i), "0x0012") for i in range(4000))


def test_separate_reads_give_the_same_packets(spark, tmp_path):
    good = [n for n, e in mixed_folder(tmp_path / "all").items() if e[1] == "success" and e[3]]
    together = ingest(spark, str(tmp_path / "all")).packets
    columns = ["frame_time_epoch", "ip_src", "frame_len"]
    for name in good[:4]:
        path = next((tmp_path / "all").glob(f"capture_day=*/capture_file={name.replace('%', '%25')}"))
        alone = PK.read_packets(spark, str(path)).select([c for c in columns])
        assert sorted(map(tuple, alone.collect())) == sorted(
            map(tuple, together.filter(F.col("capture_file") == name).select(*columns).collect()))


def test_long_lines_and_no_good_file(spark, tmp_path):
    columns = ",".join(['"frame.time_epoch"', *(f'"c{i}"' for i in range(20_000))])
    row = ",".join(["1.5", *("x" * 9 for _ in range(20_000))])
    write(f"{tmp_path}/a/capture_day=D0/capture_file=a/x.csv", f"{columns}\n{row}\n{row}\n".encode())
    looked = inspect_files(spark, f"{tmp_path}/a").first()
    assert looked["status"] == "success" and len(looked["columns"]) == 20_001
    write(f"{tmp_path}/b/capture_day=D0/capture_file=a/x.csv", b"a,b\n1,2\n")
    read = ingest(spark, f"{tmp_path}/b")
    assert read.packets.count() == 0 and [r["status"] for r in read.manifest.collect()] == ["skipped"]


def test_folder_build_leaves_out_what_cannot_be_read(spark, tables, tmp_path):
    from flowlens.plans.io_queries import capture_text

    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    text = capture_text(tables).filter("capture_day < 'D02'")
    broken = F.expr("capture_day = 'D00' and capture_file = 'cap-1'")
    text = text.withColumn("tcp_flags", F.when(broken, F.lit("0x\n02")).otherwise(F.col("tcp_flags")))
    PK.write_packets(text, root, partitions=["capture_day", "capture_file"])
    status = {(r["capture_day"], r["capture_file"]): r for r in build_folder(spark, root, tables.log, out, size=20, stride=5).collect()}
    assert len(status) == 10 and {k for k, r in status.items() if r["status"] != "success"} == {("D00", "cap-1")}
    assert "header" in status["D00", "cap-1"]["reason"]
    built = spark.read.parquet(f"{out}/flows")
    expected = tables.packets.filter("capture_day < 'D02' and not (capture_day = 'D00' and capture_file = 'cap-1') and ip_src is not null").count()
    assert built.agg(F.sum("frame_len_count")).first()[0] == expected
    again = build_folder(spark, root, tables.log, out, size=20, stride=5).collect()
    assert sorted(r["status"] for r in again) == ["error"] + ["skipped"] * 9


def test_attack_log_keeps_file_order(spark, tmp_path):
    lines = ["Date,Start_Time,End_Time,Target_IP,Attack_Type"]
    lines += [f"2018-03-{i + 1:02d},10:0{i}:00,11:00:00,{'' if i == 2 else '172.31.69.25'},T{i}" for i in range(5)]
    write(f"{tmp_path}/log.csv", "\n".join(lines).encode())
    rows = read_attack_log(spark, f"{tmp_path}/log.csv").orderBy("log_id").collect()
    assert [r["attack_type"] for r in rows] == [f"T{i}" for i in range(5)]
    assert str(rows[1]["start_ts"]) == "2018-03-02 10:01:00"
    assert rows[2]["target_ip"] is None


def test_build_is_incremental(spark, tables, tmp_path):
    out = str(tmp_path / "build")
    status = build_dataset(tables.packets, tables.log, out, size=20, stride=5)
    assert {r["status"] for r in status.collect()} == {"success"}
    flows = spark.read.parquet(f"{out}/flows")
    assert flows.agg(F.sum("frame_len_count")).first()[0] == tables.packets.filter("ip_src is not null").count()
    built = status.select("capture_day", "capture_file")
    assert D.pending_inputs(tables.packets, built).count() == 0
    assert D.pending_inputs(tables.packets, built, force=True).count() == built.count()
    assert unprocessed(tables.packets, flows).count() == 0
    again = build_dataset(tables.packets, tables.log, out, size=20, stride=5)
    assert {r["status"] for r in again.collect()} == {"skipped"}


def test_day_overwrite_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("D0", 1), ("D1", 2), ("D1", 3)], "capture_day string, v int")
    D.write_by_day(df, path)
    D.write_by_day(df.filter("v = 3"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_build_from_capture_text(spark, tables, tmp_path):
    from flowlens.plans.io_queries import capture_text

    path, out = str(tmp_path / "csv"), str(tmp_path / "out")
    PK.write_packets(capture_text(tables), path, partitions=["capture_day", "capture_file"])
    build_dataset(PK.read_packets(spark, path), tables.log, out, size=20, stride=5)
    built = spark.read.parquet(f"{out}/flows")
    key = ["capture_day", "capture_file", "ip_src", "ip_dst", "ip_proto", "tcp_srcport", "tcp_dstport", "frame_len_count", "frame_len_sum", "label"]
    whole = lambda df: sorted(tuple(map(str, r)) for r in df.select(*key).collect())
    assert {f.name: f.dataType for f in built.schema}.items() >= {f.name: f.dataType for f in FLOW_SCHEMA}.items()
    assert whole(built) == whole(tables.file_flows)
    vectors = spark.read.parquet(f"{out}/sequences")
    assert vectors.groupBy("capture_day", "capture_file").count().count() == 50
    assert vectors.filter(F.size("sequence_features") != 180).count() == 0


def test_schema_drift_is_read_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    full = spark.createDataFrame([(1, "a", 2.0, datetime(2024, 1, 1))], "n bigint, s string, x double, at timestamp_ntz")
    parts = {"D 0+%": full, "D1": full.drop("x"), "D2": full.withColumn("n", F.lit("1")), "D3": full.withColumn("x", F.lit(None).cast("double")),
             "D4": full.withColumn("extra", F.lit(1))}
    for day, df in parts.items():
        df.withColumn("day", F.lit(day)).write.mode("append").partitionBy("day").parquet(path)
    os.makedirs(f"{path}/day=D5")
    with open(f"{path}/day=D5/bad.parquet", "wb") as f:
        f.write(b"PAR1 no footer")
    footers = footer_rows(spark, path, "day")
    assert {r["folder"] for r in footers.collect()} == {*parts, "D5"} and footers.filter("rows = 1 and column_name = 'at' and type = 'timestamp_ntz'").count() == 5
    found = {(r["folder"], r["column_name"], r["problem"], r["found"], r["files"]) for r in schema_drift(footers, full.schema).collect()}
    assert found == {("D1", "x", "missing", None, 1), ("D2", "n", "type", "string", 1), ("D5", None, "unreadable", None, 1)}
