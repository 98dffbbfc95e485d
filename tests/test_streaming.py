"""Streaming results equal their batch counterparts."""

import math

import pandas as pd

from faultline.streaming import jobs as J
from faultline.sources.fixtures import event_inspections

from conftest import SF_SMALL


def test_tumbling_stream_equals_batch_minus_open_windows(spark):
    out = J.run_to_parquet(J.tumbling_rate(J.event_stream(spark, SF_SMALL)), "t-st1").toPandas()
    ev = event_inspections(spark, SF_SMALL).toPandas()
    ev["day"] = pd.to_datetime(ev["timestamp"]).dt.floor("D")
    wm = pd.to_datetime(ev["timestamp"]).max() - pd.Timedelta(hours=1)
    b = ev.groupby(["day", "machine_id"]).agg(units=("units_inspected", "sum"), defects=("defect_count", "sum"))
    b = b.reset_index()
    b = b[b["day"] + pd.Timedelta(days=1) <= wm]
    assert len(out) == len(b)
    assert int(out["defects"].sum()) == int(b["defects"].sum())


def test_online_cusum_equals_batch_recurrence(spark):
    out = J.run_to_parquet(J.online_cusum(J.event_stream(spark, SF_SMALL)), "t-st4").toPandas()
    ev = event_inspections(spark, SF_SMALL).toPandas()
    ev["day"] = pd.to_datetime(ev["timestamp"]).dt.date
    for m, g in ev.groupby("machine_id"):
        daily = g.groupby("day")[["units_inspected", "defect_count"]].sum().sort_index()
        rates = (daily["defect_count"] / daily["units_inspected"]).tolist()[:-1]   # last day still open
        sp = sm = 0.0
        exp = []
        for i, r in enumerate(rates):
            z = None
            if i >= J.Z_WINDOW:
                w = rates[i - J.Z_WINDOW:i]
                mu = sum(w) / len(w)
                sd = math.sqrt(sum((x - mu) ** 2 for x in w) / (len(w) - 1))
                z = (r - mu) / sd if sd > 0 else 0.0
                sp, sm = max(0.0, sp + z - 0.5), max(0.0, sm - z - 0.5)
            exp.append((r, z, sp, sm))
        got = out[out["machine_id"] == m].sort_values("day")
        assert len(got) == len(exp)
        for (r, z, a, b), (_, row) in zip(exp, got.iterrows()):
            assert abs(row["defect_rate"] - r) < 1e-12
            assert abs(row["cusum_pos"] - a) < 1e-9 and abs(row["cusum_neg"] - b) < 1e-9


def test_late_days_count_until_the_watermark(spark, tmp_path, monkeypatch):
    """Files in shuffled order: days that come late, but before the watermark, are part of the result."""
    monkeypatch.setattr(J, "WATERMARK", "10 days")
    start = pd.Timestamp("2026-01-01")
    rows = [(f"M{m}", start + pd.Timedelta(days=d, hours=3 * h + m), 100 + h, (d * 7 + h * 3 + m) % 11 + (20 if d > 25 else 0))
            for m in range(2) for d in range(40) for h in range(4)]
    cols = ["machine_id", "timestamp", "units_inspected", "defect_count"]
    ev = pd.DataFrame(rows, columns=cols)
    chunk = (ev["timestamp"] - start).dt.days // 5
    last = pd.DataFrame([("M0", start + pd.Timedelta(days=80), 1, 0)], columns=cols)
    schema = "machine_id string, timestamp timestamp, units_inspected long, defect_count long"
    for part in [*(ev[chunk == c].sample(frac=1, random_state=c) for c in (1, 0, 3, 2, 5, 4, 7, 6)), last]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = J.run_to_parquet(J.online_cusum(stream), "t-late").toPandas()
    for m, g in ev.groupby("machine_id"):
        daily = g.groupby(g["timestamp"].dt.date)[["units_inspected", "defect_count"]].sum().sort_index()
        hist, sp, sm, want = [], 0.0, 0.0, []
        for day, r in daily.iterrows():
            rate = r["defect_count"] / r["units_inspected"]
            _, hist, sp, sm = J._step(rate, hist, sp, sm)
            want.append((day, rate, sp, sm))
        got = out[out["machine_id"] == m].sort_values("day")
        assert list(zip(got["day"], got["defect_rate"], got["cusum_pos"], got["cusum_neg"])) == want
    assert out["alert"].sum() > 0
