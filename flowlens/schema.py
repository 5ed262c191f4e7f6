"""Table schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, windows, ports and thresholds that results depend on.
BENIGN = "Benign"

FLOW_KEY = ["ip_src", "ip_dst", "ip_proto", "tcp_srcport", "tcp_dstport"]
SESSION_KEY = ["ip_src", "ip_dst"]
# A capture is a file of a day folder; names repeat over the days.
FILE_KEY = ["capture_day", "capture_file"]

NUMERIC_PACKET_COLUMNS = [
    "frame_len", "ip_proto", "tcp_srcport", "tcp_dstport", "ip_ttl", "tcp_window",
]

SEQUENCE_FEATURES = [
    "frame_len", "ip_proto", "tcp_srcport", "tcp_dstport", "tcp_flags",
    "ip_ttl", "tcp_window", "packet_direction", "payload_ratio",
]
WINDOW_SIZE = 200
WINDOW_STRIDE = 50
MAX_SEQUENCES_PER_FILE = 50_000

FLOW_FEATURES = [
    "frame_len_count", "frame_len_sum", "frame_len_mean", "frame_len_std",
    "ip_ttl_mean", "tcp_window_mean", "flow_duration_sec", "packet_rate",
]
FLOW_METADATA = [
    "ip_src", "ip_dst", "ip_proto", "tcp_srcport", "tcp_dstport",
    "timestamp_min", "timestamp_max", "label",
]
FLOW_COLUMNS = [
    "ip_src", "ip_dst", "ip_proto", "tcp_srcport", "tcp_dstport",
    "frame_len_count", "frame_len_sum", "frame_len_mean", "frame_len_std",
    "timestamp_min", "timestamp_max", "ip_ttl_mean", "tcp_window_mean",
    "label", "flow_duration_sec", "packet_rate",
]

LABELS = [
    "Benign", "Botnet", "DDoS-HOIC", "DDoS-LOIC-HTTP", "FTP-BruteForce",
    "Infiltration", "SSH-BruteForce", "Web-Attacks", "Web-XSS",
]

SERVICE_PORTS = {
    "http": [80, 8080, 8000, 8888],
    "https": [443, 8443],
    "ssh": [22],
    "ftp": [21, 20],
    "dns": [53],
    "smtp": [25, 587],
    "mysql": [3306],
    "rdp": [3389],
    "smb": [445, 139],
}
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}
USUAL_TTLS = [32, 64, 128, 255]

RAW_PACKET_COLUMNS = {
    "frame.time_epoch": "frame_time_epoch",
    "ip.src": "ip_src",
    "ip.dst": "ip_dst",
    "tcp.srcport": "tcp_srcport",
    "tcp.dstport": "tcp_dstport",
    "frame.len": "frame_len",
    "ip.proto": "ip_proto",
    "tcp.flags": "tcp_flags",
    "udp.srcport": "udp_srcport",
    "udp.dstport": "udp_dstport",
    "ip.ttl": "ip_ttl",
    "tcp.window_size_value": "tcp_window",
}

# Column names of older flow exports, mapped to the current ones.
LEGACY_FLOW_COLUMNS = {
    "ip.src": "ip_src",
    "ip.dst": "ip_dst",
    "ip.proto": "ip_proto",
    "tcp.srcport": "tcp_srcport",
    "tcp.dstport": "tcp_dstport",
    "frame.len_count": "frame_len_count",
    "frame.len_sum": "frame_len_sum",
    "frame.len_mean": "frame_len_mean",
    "frame.len_std": "frame_len_std",
    "ip.ttl_mean": "ip_ttl_mean",
    "tcp.window_size_value_mean": "tcp_window_mean",
    "label_<lambda>": "label",
}

ATTACK_LOG_SCHEMA = T.StructType([
    T.StructField("log_id", T.IntegerType()),
    T.StructField("start_ts", T.TimestampNTZType()),
    T.StructField("end_ts", T.TimestampNTZType()),
    T.StructField("target_ip", T.StringType()),
    T.StructField("attack_type", T.StringType()),
])

FLOW_SCHEMA = T.StructType([
    T.StructField("ip_src", T.StringType()),
    T.StructField("ip_dst", T.StringType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("tcp_srcport", T.IntegerType()),
    T.StructField("tcp_dstport", T.IntegerType()),
    T.StructField("frame_len_count", T.LongType()),
    T.StructField("frame_len_sum", T.LongType()),
    T.StructField("frame_len_mean", T.DoubleType()),
    T.StructField("frame_len_std", T.DoubleType()),
    T.StructField("timestamp_min", T.TimestampNTZType()),
    T.StructField("timestamp_max", T.TimestampNTZType()),
    T.StructField("ip_ttl_mean", T.DoubleType()),
    T.StructField("tcp_window_mean", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("flow_duration_sec", T.DoubleType()),
    T.StructField("packet_rate", T.DoubleType()),
])
