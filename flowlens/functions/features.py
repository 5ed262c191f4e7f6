"""The 43 flow features, in model order, as SQL expressions over two projections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowlens.schema import SERVICE_PORTS, USUAL_TTLS

# NULL-free inputs of the features
BASE = {
    "packet_count": "coalesce(double(frame_len_count), 0d)",
    "total_bytes": "coalesce(double(frame_len_sum), 0d)",
    "avg_packet_size": "coalesce(double(frame_len_mean), 0d)",
    "packet_size_std": "coalesce(double(frame_len_std), 0d)",
    "ttl_mean": "coalesce(double(ip_ttl_mean), 0d)",
    "window_size_mean": "coalesce(double(tcp_window_mean), 0d)",
    "flow_duration": "coalesce(double(flow_duration_sec), 0d)",
    "packet_rate": "coalesce(double(packet_rate), 0d)",
}
PORTS = {
    "_proto": "coalesce(int(ip_proto), 0)",
    "_sport": "coalesce(int(tcp_srcport), 0)",
    "_dport": "coalesce(int(tcp_dstport), 0)",
}
THROUGHPUT = "total_bytes / if(flow_duration = 0, 0.001d, flow_duration)"
FLAGS = {
    "is_single_packet": "packet_count = 1",
    "is_micro_flow": "packet_count <= 5",
    "is_large_flow": "packet_count > 100",
    "is_small_payload": "avg_packet_size < 100",
    "proto_tcp": "_proto = 6",
    "proto_udp": "_proto = 17",
    "proto_icmp": "_proto = 1",
    "proto_other": "_proto not in (6, 17, 1)",
    **{f"dst_is_{service}": f"_dport in ({', '.join(map(str, ports))})" for service, ports in SERVICE_PORTS.items()},
    "src_ephemeral": "_sport > 1024",
    "dst_ephemeral": "_dport > 1024",
    "both_ephemeral": "_sport > 1024 and _dport > 1024",
    "low_ttl": "ttl_mean < 32",
    # bround is half-even, which decides 63.5 and 64.5
    "unusual_ttl": f"bround(ttl_mean, 0) not in ({', '.join(f'{t}d' for t in USUAL_TTLS)})",
    "zero_window": "window_size_mean = 0",
    "large_window": "window_size_mean > 60000",
}
VALUES = {
    "log_packet_count": "log1p(packet_count)",
    "log_total_bytes": "log1p(total_bytes)",
    "log_packet_rate": "log1p(packet_rate)",
    "log_duration": "log1p(flow_duration)",
    "bytes_per_sec": THROUGHPUT,
    "log_bytes_per_sec": f"log1p(least({THROUGHPUT}, 1e9d))",
    "packet_size_cv": "least(packet_size_std / if(avg_packet_size = 0, 0.001d, avg_packet_size), 100d)",
    "dstport_value": "double(least(_dport, 65535))",
    "srcport_value": "double(least(_sport, 65535))",
    "bytes_x_packets": "log1p(total_bytes * packet_count)",
    "rate_x_size": "packet_rate * avg_packet_size / 1e6d",
}
# The model's feature order.
ORDER = [
    *BASE,
    "log_packet_count", "log_total_bytes", "log_packet_rate", "log_duration",
    "bytes_per_sec", "log_bytes_per_sec", "packet_size_cv",
    "is_single_packet", "is_micro_flow", "is_large_flow", "is_small_payload",
    "proto_tcp", "proto_udp", "proto_icmp", "proto_other",
    *[f"dst_is_{service}" for service in SERVICE_PORTS],
    "src_ephemeral", "dst_ephemeral", "both_ephemeral", "dstport_value", "srcport_value",
    "low_ttl", "unusual_ttl", "zero_window", "large_window", "bytes_x_packets", "rate_x_size",
]


def feature_names() -> list[str]:
    return list(ORDER)


def _feature(name: str) -> str:
    """NULL, NaN and infinities end as 0; flags never need the test."""
    if name in FLAGS:
        return f"double({FLAGS[name]}) as {name}"
    value = VALUES.get(name, name)
    return f"if(abs({value}) < double('inf'), {value}, 0d) as {name}"


def engineer_features(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns followed by the 43 features; projections only, no shuffle.

    ``packet_rate`` exists on both sides and is replaced by its feature.
    """
    keep = [c for c in (keep or []) if c != "packet_rate"]
    inputs = [f"{expr} as {name}" for name, expr in (BASE | PORTS).items()]
    return flows.selectExpr(*keep, *inputs).selectExpr(*keep, *map(_feature, ORDER))
