"""What a step holds at a time stays small, whatever the table's size."""

import struct

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from culvert.operators import analysis
from culvert.plans import standins
from culvert.sources import splits

SF = "/root/testdata/sf0.001"


def test_stored_windows_of_a_capture_are_few_to_a_file(spark, tmp_path, monkeypatch):
    """a reader or writer of Parquet holds many rows of a file, and a row is a window of megabytes."""
    stored, plain = [], splits.materialise

    def materialise(df, purpose, *rest):
        out = plain(df, purpose, *rest)
        stored.extend([out] if purpose == "capture-windows" else [])
        return out

    monkeypatch.setattr(splits, "materialise", materialise)
    records = [(k, 40 + k % 90) for k in range(900)]
    body = b"".join(struct.pack("<IIII", k, 7, n, n) + bytes([k % 251]) * n for k, n in records)
    (tmp_path / "one.pcap").write_bytes(bytes.fromhex("d4c3b2a1020004000000000000000000ffff000001000000") + body)
    found = splits.read_captures(spark, str(tmp_path), window=2048, beyond=1024)
    assert [(r["frame"], r["t_us"], r["n"]) for r in found.select("frame", "t_us", F.length("data").alias("n")).orderBy("frame").collect()] == [(k + 1, k * 1_000_000 + 7, n) for k, n in records]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows for f in stored[0].inputFiles()]
    assert sum(files) == -(-(len(body) + 24) // 2048) and max(files) <= 4
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= splits.WINDOW


def test_facts_of_associations_are_stored_one_after_another(spark, monkeypatch):
    """the messages dealt out for one kind of fact don't wait on disk for the others."""
    stored, plain = [], analysis.materialise

    def materialise(df, purpose, *rest):
        stored.append(purpose)
        return plain(df, purpose, *rest)

    monkeypatch.setattr(analysis, "materialise", materialise)
    sessions = analysis.session_table(standins.ike_messages(spark, SF), standins.esp_packets(spark, SF), 0)
    assert {"proof", "certificates", "parameters", "retransmit"} <= set(stored)
    assert any("/retransmit-" in f for f in sessions.inputFiles()) and not any("lineitem" in f for f in sessions.inputFiles())
