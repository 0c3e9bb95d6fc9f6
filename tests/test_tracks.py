"""Mean values of a day do not depend on the order in which rows arrive."""

from tracewright.sources import tracks

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_mean_is_summed_in_order_of_ids(spark, tmp_path):
    from datetime import datetime

    values = [0.1, 0.2, 0.3, 7.7, 1e-9, 1e9]
    rows = [(i, datetime(2024, 1, 1 + i // 9, 5), 1, "view", v, None) for i, v in [*enumerate(values), (9, None), (10, 4.0), (18, None)]]
    rows += [(100 + i, datetime(2024, 1, 1, 5), 2, "view", float("nan") if i else 1.0, None) for i in range(2)]
    total = 0.0
    for v in values:
        total += v
    for name, order in (("a", rows[::-1]), ("b", rows)):
        spark.createDataFrame(order, EVENTS).repartition(3 if name == "a" else 1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = {(r.user_id, r.d): r.v for r in tracks(spark, f"{tmp_path}/{name}").collect()}
        assert got[1, 0] == total / 6 and got[1, 1] == 4.0 and got[1, 2] is None
        assert got[2, 0] != got[2, 0]
