import os

import wire as w
from pyspark.sql import functions as F

from culvert.operators import analysis, associations, parameters
from culvert.sources import headers, ike, pcap

A, B, C = "10.0.0.1", "10.0.0.2", "10.0.0.3"
STRONG = [(1, 20, 256), (2, 7), (4, 21)]
WEAK = [(1, 3), (2, 2), (3, 2), (4, 2)]
AUTH = 0x2E


def init(src, dst, spi, offer, group, reply=0, port=500, extra=()):
    parts = [(33, w.sa(offer)), (34, w.struct.pack(">HH", group, 0) + b"k" * 64), (40, b"n" * 32), *extra]
    msg = w.ike(spi, reply, 34, 0x20 if reply else 0x08, 0, parts)
    body = (b"\x00" * 4 if port == 4500 else b"") + msg
    return w.ether(w.ip(src, dst, 17, w.udp(port, port, body)))


def esp(src, dst, spi, seq, size=100, proto=50):
    head = b"\x32\x04\x00\x00" if proto == 51 else b""
    return w.ether(w.ip(src, dst, proto, head + w.struct.pack(">II", spi, seq) + b"x" * size))


def frames():
    out = [init(A, B, 0x11, STRONG, 21), init(B, A, 0x11, STRONG, 21, reply=0x22)]
    out += [init(A, C, 0x33, WEAK, 2), init(C, A, 0x33, WEAK, 2, reply=0x44)]
    out += [esp(A, B, 0x1000, i + 1) for i in range(40)]
    return out


def load(spark, tmp_path, content, name="t.pcap"):
    folder = tmp_path / "caps"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)
    raw = pcap.read_captures(spark, str(folder))
    packets, datagrams = headers.split_packets(headers.decode_headers(raw))
    return packets, ike.decode_messages(datagrams)


def test_two_tunnels_end_to_end(spark, tmp_path):
    packets, messages = load(spark, tmp_path, w.pcap(frames()))
    rows = {r["session_id"]: r for r in analysis.analyse(messages, packets, 0).collect()}
    strong, weak = rows[f"{0x11:016x}-{0x22:016x}"], rows[f"{0x33:016x}-{0x44:016x}"]
    assert strong["ike"]["encryption"] == "AES-256-GCM" and strong["ike"]["dh_group"] == "ECP521"
    assert strong["ike"]["integrity"] == "implicit" and strong["ike"]["capture_complete"]
    assert strong["flow"]["pkt_total"] == 40 and strong["has_esp"] and not weak["has_esp"]
    assert weak["traffic"]["model_version"] == "no-esp-observed"
    assert {"R02", "R04"} <= set(weak["triggered_rules"]) and weak["overall_severity"] == "CRITICAL"
    stats = associations.capture_stats(messages, packets).first()
    assert (stats["packets"], stats["ike_packets"], stats["esp_packets"], stats["sessions"]) == (44, 4, 40, 2)
    evidence = associations.evidence_frames(messages).filter(F.col("init_spi") == f"{0x33:016x}").orderBy("frame").collect()
    assert [r["frame"] for r in evidence] == [3, 4]


def test_formats_agree(spark, tmp_path):
    counts = []
    for i, content in enumerate([w.pcap(frames()), w.pcap(frames(), nano=True), w.pcapng(frames())]):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "c.pcap").write_bytes(content)
        raw = pcap.read_captures(spark, str(folder))
        counts.append(sorted((r["frame"], r["t_us"], bytes(r["data"])) for r in raw.collect()))
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) == 44
    spark.dataSource.register(pcap.PcapSource)
    direct = spark.read.format("pcap").load(str(tmp_path / "0"))
    assert sorted((r["frame"], r["t_us"], bytes(r["data"])) for r in direct.collect()) == counts[0]


def test_sniff_and_truncated_file(spark, tmp_path):
    folder = tmp_path / "mix"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(w.pcap(frames())[:-7])
    (folder / "b.txt").write_bytes(b"hello world")
    assert pcap.read_captures(spark, str(folder)).count() == 43
    bad = pcap.rejected_captures(spark, str(folder)).collect()
    assert [(os.path.basename(r["path"]), r["verdict"]) for r in bad] == [("b.txt", "not a capture")]
    assert {r["verdict"] for r in pcap.rejected_captures(spark, str(folder), cap=5).collect()} == {"too large"}


def test_packet_classes(spark, tmp_path):
    v6a, v6b = "2001:db8::1", "fe80::2:0:0:3"
    content = w.pcap(
        [
            esp(A, B, 7, 9, proto=51),
            w.ether(w.ip(v6a, v6b, 50, w.struct.pack(">II", 8, 10) + b"x" * 20), vlan=True),
            w.ether(w.ip(A, B, 17, w.udp(4500, 4500, b"\xff"))),
            w.ether(w.ip(A, B, 17, w.udp(4500, 4500, w.struct.pack(">II", 12, 13) + b"y" * 9))),
            w.ether(w.ip(A, B, 50, b"\x00\x00\x00\x05")),
            w.ether(w.ip(A, B, 6, b"z" * 20)),
            w.ether((b"\x08\x06", b"arp" * 10)),
            init(A, B, 0x55, STRONG, 21, port=4500),
        ]
    )
    packets, messages = load(spark, tmp_path, content)
    got = {r["frame"]: (r["src"], r["dst"], r["spi"], r["seq"]) for r in packets.collect()}
    assert got == {1: (A, B, 7, 9), 2: (v6a, v6b, 8, 10), 4: (A, B, 12, 13), 5: (A, B, 5, None)}
    only = messages.collect()
    assert [(r["udp_port"], r["init_spi"]) for r in only] == [(4500, f"{0x55:016x}")]


def test_ipv6_extension_headers(spark, tmp_path):
    a, b = "2001:db8::1", "2001:db8::2"
    msg = w.udp(500, 500, w.ike(0x77, 0, 34, 8, 0, [(33, w.sa(STRONG))]))
    hop = lambda following: w.struct.pack(">BBHI", following, 0, 0, 0)
    part = lambda following, offset: w.struct.pack(">BBHI", following, 0, offset << 3, 1)
    bodies = [(17, msg), (0, hop(17) + msg), (0, hop(60) + w.struct.pack(">BB", 17, 1) + b"\0" * 14 + msg), (44, part(17, 0) + msg), (44, part(17, 5) + msg), (0, hop(50) + w.struct.pack(">II", 9, 1)), (0, b"\x11")]
    packets, messages = load(spark, tmp_path, w.pcap([w.ether(w.ip(a, b, proto, body)) for proto, body in bodies]))
    assert sorted(r["frame"] for r in messages.collect()) == [1, 2, 3, 4]
    assert [(r["frame"], r["spi"]) for r in packets.collect()] == [(6, 9)]


def params(spark, tmp_path, msgs, name):
    content = w.pcap([w.ether(w.ip(s, d, 17, w.udp(500, 500, m))) for s, d, m in msgs])
    _, messages = load(spark, tmp_path, content, name)
    return messages, parameters.parameters(messages).first()


def test_readable_auth_and_rekey(spark, tmp_path):
    offer = [(33, w.sa(STRONG)), (34, w.struct.pack(">HH", 21, 0) + b"k" * 8)]
    _, inner = w.chain([(39, b"\x02\x00\x00\x00sig"), (33, w.sa([(1, 20, 256)], protocol=3)), (41, w.struct.pack(">BBH", 0, 0, 16391))])
    sk = w.payload(39, inner)
    auth = w.ike(1, 2, 35, 0x08, 1, [], raw=sk, first=46)
    opaque = w.ike(1, 2, 36, 0x08, 2, [], raw=w.payload(33, os.urandom(90)), first=46)
    m, p = params(spark, tmp_path, [(A, B, w.ike(1, 0, 34, 8, 0, offer)), (B, A, w.ike(1, 2, 34, 0x20, 0, offer)), (A, B, auth), (A, B, opaque)], "auth.pcap")
    assert (p["auth_method"], p["mode"], p["pfs_status"]) == ("PSK", "transport", "disabled")
    rows = {r["exchange"]: r for r in m.collect()}
    assert rows[35]["payload_types"] == [46, 39, 33, 41] and rows[36]["payload_types"] == [46]
    assert parameters.v2_parameters(m).count() == 1


def test_ikev1_quick_mode_overrides(spark, tmp_path):
    p1 = w.v1_sa(1, [(1, 5), (2, 1), (3, 1), (4, 2), (11, 1), (12, 90000)])
    dpd = bytes.fromhex("afcad71368a1f1c96b8696fc77570100")
    q = w.v1_sa(12, [(4, 1), (5, 2), (6, 256), (3, 14), (1, 1), (2, 3600)])
    msgs = [
        (A, B, w.ike(5, 0, 4, 0, 0, [(1, p1), (4, b"k" * 16), (5, b"\x01\x00\x00\x00id"), (13, dpd)], version=0x10)),
        (B, A, w.ike(5, 6, 4, 0, 0, [(1, p1)], version=0x10)),
        (A, B, w.ike(5, 6, 32, 1, 99, [(8, b"h" * 16), (1, q)], version=0x10)),
    ]
    m, p = params(spark, tmp_path, msgs, "v1.pcap")
    assert p["version"] == "IKEv1" and p["aggressive_mode"] and p["auth_method"] == "PSK"
    assert (p["encryption"], p["integrity"], p["dh_group"], p["mode"]) == ("AES-256-CBC", "HMAC-SHA1", "MODP2048", "tunnel")
    assert (p["pfs_status"], p["sa_lifetime_sec"], p["dpd_status"], p["prf"]) == ("enabled", 3600, "enabled", "PRF_HMAC_MD5")
    encrypted = w.ike(5, 6, 32, 1, 98, [], version=0x10, raw=os.urandom(64), first=8)
    _, datagram_messages = load(spark, tmp_path, w.pcap([w.ether(w.ip(A, B, 17, w.udp(500, 500, encrypted)))]), "enc.pcap")
    row = datagram_messages.filter("capture_id = 'enc.pcap'").first()
    assert row["encrypted"] and row["payload_types"] == []


def test_bad_lengths_keep_the_message(spark, tmp_path):
    good = w.payload(33, w.sa(STRONG))
    cut = w.ike(9, 0, 34, 8, 0, [], raw=good + b"\x00\x00\xff\xff", first=33)
    short = b"\x01" * 20
    m, _ = params(spark, tmp_path, [(A, B, cut), (A, B, short)], "bad.pcap")
    rows = m.filter("capture_id = 'bad.pcap'").collect()
    assert len(rows) == 1 and rows[0]["payload_types"] == [33] and rows[0]["encr_id"] == 20
    broken_sa = w.ike(10, 0, 34, 8, 0, [(33, b"\x00\x00\xff\xff\x01\x01\x00\x01")])
    m2, p2 = params(spark, tmp_path, [(A, B, broken_sa)], "sa.pcap")
    assert m2.filter("capture_id = 'sa.pcap'").first()["encr_id"] is None
