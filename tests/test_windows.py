"""Stream counts over files in no order of time."""

import datetime
import os
from collections import Counter

from millrace.plans import registry


def test_old_rows_of_later_batches_count(spark, tmp_path):
    """Nine files, newest first, over 160 days: the stream takes four a batch, so whole files come long after newer rows."""
    day = datetime.datetime(2024, 6, 1, 12)
    rows = [(i, day - datetime.timedelta(days=20 * f), "view", 1.25) for f in range(9) for i in range(3)] + [(99, None, "view", None)]
    for f in range(9):
        part = [r for k, r in enumerate(rows) if k // 3 == f or (f == 8 and k == 27)]
        frame = spark.createDataFrame(part, "event_id long, ts timestamp_ntz, event_type string, value double")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        for name in os.listdir(f"{tmp_path}/events.parquet"):
            file = f"{tmp_path}/events.parquet/{name}"
            if os.path.getmtime(file) > 2_000_000 * 500:
                os.utime(file, (1000 * (f + 1), 1000 * (f + 1)))
    got = {(r.start, r.event_type): (r.n, r.cents) for r in registry.QUERIES["stream_counts"](spark, str(tmp_path)).collect()}
    days = Counter(None if r[1] is None else r[1].replace(hour=0) for r in rows)
    assert got == {(d, "view"): (n, None if d is None else 125 * n) for d, n in days.items()}
