"""Structured Streaming jobs: bounded chat history and catalog registration."""

import json
import os
import tempfile

from tablelens.streaming import catalog as scat
from tablelens.streaming import chatlog


def _write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


def test_history_window_keeps_last_n(spark):
    root = tempfile.mkdtemp(prefix="tablelens-stream-")
    inbox = f"{root}/inbox"
    _write(inbox, "a.json", [{"conv_id": 1, "id": i, "role": "user", "content": f"m{i}",
                              "timestamp": f"2024-01-01T00:00:{i:02d}"} for i in range(5)]
           + [{"conv_id": 2, "id": 0, "role": "assistant", "content": "x", "timestamp": "2024-01-01T00:00:00"}])
    q1, q2 = chatlog.run_history(spark, inbox, f"{root}/log", f"{root}/win", f"{root}/ck", n=3)
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    _write(inbox, "b.json", [{"conv_id": 1, "id": 5, "role": "assistant", "content": "m5",
                              "timestamp": "2024-01-01T00:00:05"}])
    q1, q2 = chatlog.run_history(spark, inbox, f"{root}/log", f"{root}/win", f"{root}/ck", n=3)
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    win = chatlog.latest_windows(spark, f"{root}/win")
    got = sorted((r["conv_id"], r["position"], r["id"]) for r in win.collect())
    assert got == [(1, 1, 3), (1, 2, 4), (1, 3, 5), (2, 1, 0)]
    assert spark.read.parquet(f"{root}/log").count() == 7


def test_catalog_registration_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="tablelens-stream-")
    inbox = f"{root}/inbox"
    _write(inbox, "1.json", [{"file_name": "b.csv", "rows": 5, "columns": 2, "description": "",
                              "upload_time": "2024-01-01T00:00:00"},
                             {"file_name": "a.csv", "rows": 3, "columns": 1, "description": "",
                              "upload_time": "2024-01-01T00:00:00"}])
    scat.run_registration(spark, inbox, f"{root}/catalog", f"{root}/ck").awaitTermination(120)
    _write(inbox, "2.json", [{"file_name": "a.csv", "rows": 9, "columns": 9, "description": "",
                              "upload_time": "2024-01-02T00:00:00"},
                             {"file_name": "c.xlsx", "rows": 1, "columns": 1, "description": "sales",
                              "upload_time": "2024-01-02T00:00:00"}])
    scat.run_registration(spark, inbox, f"{root}/catalog", f"{root}/ck").awaitTermination(120)
    cat = {r["file_name"]: (r["dataset_id"], r["rows"]) for r in scat.read_catalog(spark, f"{root}/catalog").collect()}
    assert cat == {"a.csv": (1, 3), "b.csv": (2, 5), "c.xlsx": (3, 1)}


def test_history_window_holds_one_batch_at_a_time(monkeypatch):
    """A conversation with most of a micro-batch is folded batch by batch into its last n messages."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    sizes, concat = [], pd.concat
    monkeypatch.setattr(chatlog.pd, "concat", lambda frames, **kw: sizes.append(sum(map(len, frames))) or concat(frames, **kw))
    order = [(i * 7919) % 5000 for i in range(5000)]
    rows = pd.DataFrame({"id": order, "role": "user", "content": [f"m{i}" for i in order], "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(order, "s")})
    state, update = State(), chatlog._last_n(4)
    (first,) = update((9,), (rows[i:i + 100].copy() for i in range(0, 2500, 100)), state)
    (second,) = update((9,), (rows[i:i + 100].copy() for i in range(2500, 5000, 100)), state)
    assert first["id"].tolist() == sorted(order[:2500])[-4:] and second["id"].tolist() == [4996, 4997, 4998, 4999]
    assert second["conv_id"].tolist() == [9] * 4 and second["position"].tolist() == [1, 2, 3, 4]
    assert max(sizes) <= 104
