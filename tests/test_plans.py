"""Plan shapes the scale claims rest on."""

from flowlens.operators import sequences as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labelling_is_a_projection(tables):
    text = plan(tables.labelled)
    assert "Exchange" not in text and "Join" not in text


def test_flows_take_one_shuffle_in_hash_aggregates(tables):
    text = plan(tables.flows)
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("HashAggregate") == 2
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text


def test_scan_reads_only_needed_columns(tables):
    text = plan(tables.packets.groupBy("ip_dst").count())
    assert "ReadSchema: struct<event_id:bigint>" in text


def test_sessions_are_not_windowed_whole(tables):
    text = plan(S.number_packets(tables.clean))
    for line in text.splitlines():
        if "Window [row_number()" in line:
            assert "_slice" in line
