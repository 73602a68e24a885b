"""Operators against brute force and hand-computed rows."""

import random
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from culvert.functions import numeric
from culvert.functions.ids import uuid5
from culvert.functions.net import V4_PATTERN, V6_PATTERN, is_public
from culvert.operators import associations, corpus, fleet, flows, gateway, learn, ledger, parameters, rules
from culvert.plans import skew, standins, wire
from culvert.sources import store
from culvert.streaming import incremental, live


def brute_bursts(times, sizes, w, k):
    spans = []
    for i, t in enumerate(times):
        inside = [x for x in times[i:] if x - t <= w]
        if len(inside) > k:
            if spans and t <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], inside[-1])
            else:
                spans.append([t, inside[-1]])
    return spans, [s for t, s in zip(times, sizes) if any(a <= t <= b for a, b in spans)]


@pytest.mark.parametrize("slice_us", [200, 1_000, 10_000_000])
def test_bursts_match_brute_force(spark, slice_us):
    rng = random.Random(slice_us)
    rows, want = [], {}
    for flow in "abc":
        t, times = 0, []
        for _ in range(250):
            t += rng.choice([0, 3, 5, 40, 400])
            times.append(t)
        sizes = [rng.randint(60, 1500) for _ in times]
        rows += [(flow, i, x, s, "u") for i, (x, s) in enumerate(zip(times, sizes))]
        want[flow] = brute_bursts(times, sizes, 100, 10)
    df = spark.createDataFrame(rows, "flow string, frame bigint, t_us bigint, size bigint, src string").repartition(7)
    got = {r["flow"]: r for r in flows._timing(df, ["flow"], window_us=100, slice_us=slice_us).collect()}
    for flow, (spans, inside) in want.items():
        r = got[flow]
        assert r["bursts"] == len(spans) > 1
        assert r["ends"] - r["starts"] == sum(b - a for a, b in spans)
        assert (r["burst_n"], r["burst_bytes"]) == (len(inside), sum(inside))
        times = [x[2] for x in rows if x[0] == flow]
        assert int(r["gap2"]) == sum((b - a) ** 2 for a, b in zip(times, times[1:]))


def test_single_packet_flow(spark):
    df = spark.createDataFrame([("x", 1, 5, 100, "u")], "flow string, frame bigint, t_us bigint, size bigint, src string")
    r = flows.flow_features(df, ["flow"]).first()
    assert (r["pkt_total"], r["iat_mean_ms"], r["burst_count"], r["dir_ratio"], r["rate_pps"]) == (1, 0.0, 0, 1.0, 0.0)


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(f"f{rng.randint(0, 2)}", i, rng.randint(0, 3_000_000), rng.randint(60, 1500), rng.choice("ab")) for i in range(600)]
    out = set()
    for parts in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "flow string, frame bigint, t_us bigint, size bigint, src string").repartition(int(parts))
        out.add(tuple(sorted(map(tuple, flows.flow_features(df, ["flow"], slice_us=500_000).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == 1


def test_skew_helpers(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.randint(0, 5_000)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    by_key = {}
    for k, i, v in sorted(rows, key=lambda r: (r[2], r[1])):
        by_key.setdefault(k, []).append((i, v))
    lagged = {r["i"]: r["p"] for r in skew.sliced_lag(df, ["k"], "v", {"i": "p"}, 97, tie="i").collect()}
    ranks = {r["i"]: r["rank"] for r in skew.sliced_rank(df, ["k"], "v", 97, tie=["i"]).collect()}
    for items in by_key.values():
        for n, (i, _) in enumerate(items):
            assert lagged[i] == (items[n - 1][0] if n else None) and ranks[i] == n
    medians = {r["k"]: r["median"] for r in skew.exact_median(df, ["k"], "v", 100).collect()}
    for k, items in by_key.items():
        vs = [v for _, v in items]
        assert medians[k] == (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.attach(df, facts, ["k"], "n", "inner", share=20)
    assert joined.count() == 800 and {(r["k"], r["n"]) for r in joined.collect()} == {(k, len(v)) for k, v in by_key.items()}


@pytest.mark.parametrize("seed", range(4))
def test_pair_owners_match_the_loop(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{i}" for i in range(7)]
    sas = [(1, f"{i:016x}", rng.choice(hosts), rng.choice(hosts)) for i in range(4)]
    packets = [(1, rng.choice(hosts), rng.choice(hosts)) for _ in range(60)]
    sa = spark.createDataFrame(sas, "capture_id int, init_spi string, initiator_ip string, responder_ip string")
    pk = spark.createDataFrame(packets, "capture_id int, src string, dst string")
    got = {r["peers"]: r["owner"] for r in associations.pair_owners(associations.packet_pairs(pk), associations.sa_pairs(sa)).collect()}

    def name(s):
        return "|".join((min(s), max(s)))

    pairs = {frozenset(x[2:]) for x in sas}
    for _, a, b in packets:
        mine = frozenset((a, b))
        near = [p for p in pairs if p & mine]
        want = mine if mine in pairs else near[0] if len(near) == 1 else None
        assert got[name(mine)] == (name(want) if want else None)


def test_ids_and_addresses(spark):
    names = ["a|b", "é", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_OID, r["n"])) for r in got)
    public = {"8.8.8.8", "100.64.0.1", "2a00:1450::5", "172.32.0.1", "192.0.0.9", "::ffff:8.8.8.8", "::ffff:808:808", "2001:3::1", "2001:4:112::9", "::2"}
    other = {"10.1.2.3", "172.16.0.1", "x", "", "1.2.3", "fd00::1", "::1", "2001:db8::2", "300.1.1.1", "1:2:3"}
    other |= {"192.0.0.8", "100::1", "64:ff9b:1::1", "2001:5::1", "2002::1", "::", "::ffff:10.0.0.1", "fe80::1", "::ffff:300.1.1.1"}
    df = spark.createDataFrame([(a,) for a in public | other], "a string").filter(is_public(F.col("a")))
    assert {r["a"] for r in df.collect()} == public


def test_gaps_of_messages_need_no_join_with_them_again(spark):
    rng = random.Random(8)
    rows = [(1, f"{rng.randint(0, 3):016x}", rng.choice(["IKEv1", "IKEv2"]), 34, 0, False, i, None if rng.random() < 0.1 else rng.randint(0, 40) * 100_000, rng.choice("ab")) for i in range(200)]
    columns = "capture_id int, init_spi string, version string, exchange int, message_id int, is_response boolean, frame int, t_us long, src string"
    found = parameters.retransmit_interval(spark.createDataFrame(rows, columns), v1_by_direction=True, slice_us=1_000_000)
    want = {}
    for spi in {r[1] for r in rows}:
        gaps = []
        for side in (None, "a", "b"):
            times = sorted({r[7] for r in rows if r[1] == spi and r[7] is not None and (r[8] if r[2] == "IKEv1" else None) == side})
            gaps += [b - a for a, b in zip(times, times[1:])]
        gaps.sort()
        want[spi] = round((gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2000) if len(gaps) > 1 else None
    assert {r["init_spi"]: r["retransmit_interval_ms"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and plan.count("Join ") == 2


def test_messages_are_built_a_batch_at_a_time(spark):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    messages = standins.ike_messages(spark, "/root/testdata/sf0.001")
    assert "lambdafunction" not in plan(wire.with_messages(messages).select("ike"))
    odd = messages.limit(50).withColumns({"addke_ids": F.array(F.lit(None).cast("int"), F.lit(70000)), "auth_id": F.lit(None).cast("int"), "version": F.lit("IKEv2"), "payload_types": F.array(F.lit(39), F.lit(33))})
    got = {len(r["ike"]) - (28 + 4 + 8 + r["n"]) for r in wire.with_messages(odd).select("ike", F.expr("8 * (1 + int(encr_id is not null) + int(integ_id is not null) + int(prf_id is not null) + int(dh_id is not null)) + if(encr_id is not null and key_length is not null, 4, 0)").alias("n")).collect()}
    assert got == {0}


def test_an_address_is_read_once_however_many_ranges_it_is_compared_with(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("a")).select(is_public(F.col("a")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(V4_PATTERN) == 2 and plan.count(V6_PATTERN) == 1


def one_session(spark, **ike):
    base = dict(version="IKEv2", mode="tunnel", aggressive_mode=False, encryption="AES-256-GCM", integrity="implicit", dh_group="ECP256",
                pfs_status="enabled", auth_method="RSA", ip_version="IPv4", sa_lifetime_sec=None, vendor="unknown", nat_traversal=False,
                fragmented_ike=False, capture_complete=True, anti_replay=True, dpd_status="enabled", pqc_status="hybrid", inferred_fields=[],
                gateway_fields=[], gateway_mismatches=[], cert=None)
    base.update(ike)
    ddl = ("version string, mode string, aggressive_mode boolean, encryption string, integrity string, dh_group string, pfs_status string, auth_method string,"
           " ip_version string, sa_lifetime_sec bigint, vendor string, nat_traversal boolean, fragmented_ike boolean, capture_complete boolean, anti_replay boolean,"
           " dpd_status string, pqc_status string, inferred_fields array<string>, gateway_fields array<string>, gateway_mismatches array<string>,"
           " cert struct<subject:string,expired:boolean>")  # fmt: skip
    fields = [tuple(base.values())]
    df = spark.createDataFrame(fields, ddl)
    return df.select(
        F.struct("*").alias("ike"), F.lit("s").alias("session_id"), F.lit("10.0.0.1").alias("initiator_ip"), F.lit("10.0.0.2").alias("responder_ip"),
        F.struct(F.lit(500).alias("pkt_total"), F.lit(30.0).alias("flow_duration_sec"), F.lit(16.7).alias("rate_pps")).alias("flow"),
        F.struct(F.lit("VoIP").alias("predicted_type"), F.lit(0.95).alias("confidence"), F.lit(False).alias("abstained"), F.lit("m").alias("model_version")).alias("traffic"),
    )


TRIGGERS = {
    "R01": dict(encryption="DES-CBC"), "R02": dict(encryption="3DES-CBC"), "R03": dict(dh_group="MODP768"), "R04": dict(dh_group="MODP1024"),
    "R05": dict(dh_group="MODP1536"), "R08": dict(integrity="HMAC-MD5"), "R09": dict(integrity="HMAC-SHA1"), "R10": dict(pfs_status="disabled"),
    "R12": dict(sa_lifetime_sec=28801), "R14": dict(fragmented_ike=True, vendor="Cisco ASA"), "R15": dict(anti_replay=False),
    "R16": dict(cert=("CN=x", True)), "R17": dict(dpd_status="disabled"), "R20": dict(pqc_status="classical"), "R21": dict(gateway_mismatches=["m"]),
}


def test_rules_fire_alone(spark):
    df, names = None, []
    for rule, change in TRIGGERS.items():
        row = one_session(spark, **change).withColumn("want", F.lit(rule))
        df = row if df is None else df.unionByName(row)
        names.append(rule)
    for r in rules.assess(df).collect():
        assert r["triggered_rules"] == [r["want"]], r["want"]
    clean = rules.exposure(rules.assess(one_session(spark))).first()
    assert (clean["risk_score"], clean["overall_severity"], clean["exposure_score"], clean["exposure_level"]) == (100, "SAFE", 45, "High")
    v1 = rules.assess(one_session(spark, version="IKEv1", aggressive_mode=True, auth_method="PSK", dh_group="MODP1024")).first()
    assert v1["triggered_rules"] == ["R04", "R06", "R07", "R13", "R19"] and v1["risk_score"] == 0
    lifetime = rules.assess(one_session(spark, version="IKEv2", sa_lifetime_sec=90000)).first()
    assert lifetime["triggered_rules"] == ["R11", "R12"] and lifetime["risk_score"] == 85
    hidden = rules.compliance(rules.assess(one_session(spark, encryption="unknown", dh_group="unknown", pqc_status="unknown")), ["session_id"])
    by_id = {r["baseline_id"]: r for r in hidden.collect()}
    assert by_id["BSI-TR-02102-3"]["status"] == "not_assessed" and by_id["CNSA-2.0"]["unassessed"] == ["AES-256"]
    with pytest.raises(ValueError):
        rules.check_rules([*rules.R.RULES, rules.R.RULES[0]])
    with pytest.raises(ValueError):
        rules.check_baselines([{"id": "x", "violated_by": ["R99"], "requires": []}])
    assert rules.rule_listing(spark).count() == 21


GATEWAY = """net: #1, ESTABLISHED, IKEv2, 1122334455667788_i* 99aabbccddeeff00_r
  local  'moon' @ 192.0.2.1[4500]
  remote 'sun' @ 192.0.2.2[4500]
  child: #2, reqid 1, INSTALLED, TRANSPORT, ESP:AES_GCM_16-256/ECP_256
"""
CONNS = """home: IKEv1, no reauthentication, rekeying every 14400s
  local:  192.0.2.1
  remote: 192.0.2.9
  local pre-shared key authentication:
  remote pre-shared key authentication:
  child: TUNNEL, rekeying every 3600s
"""
CONF = """connections {
  a {
    version = 2
    local_addrs = 10.1.0.1
    remote_addrs = 10.1.0.2, 10.1.0.3  # two
    remote {
      auth = psk
    }
    children {
      net {
        esp_proposals = aes256-ecp256,aes128-modp2048
      }
    }
  }
}
"""
XFRM = """src 10.2.0.1 dst 10.2.0.2
\tproto esp spi 0xc0000001 reqid 1 mode transport
\treplay-window 0
src 10.2.0.2 dst 10.2.0.1
\tproto esp spi 0xc0000002 reqid 1 mode transport
\treplay-window 32
"""


def test_gateway_formats(spark, tmp_path):
    for name, text in (("sas", GATEWAY), ("conns", CONNS), ("conf", CONF), ("xfrm", XFRM), ("both", GATEWAY + XFRM), ("none", "hello\n")):
        (tmp_path / f"{name}.txt").write_text(text)
    lines = gateway.read_lines(spark, str(tmp_path))
    recs = {}
    for r in gateway.parse_gateway_state(lines).orderBy("path", "rec_ix").collect():
        recs.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    sas = recs["sas.txt"][0]
    assert (sas["ike_spi_i"], sas["local"], sas["remote"], sas["mode"], sas["version"]) == ("1122334455667788", "192.0.2.1", "192.0.2.2", "transport", "IKEv2")
    conns = recs["conns.txt"][0]
    assert (conns["remote"], conns["auth_method"], conns["mode"], conns["version"]) == ("192.0.2.9", "PSK", "tunnel", "IKEv1")
    conf = recs["conf.txt"][0]
    assert (conf["local"], conf["remote"], conf["auth_method"], conf["mode"], conf["pfs_status"], conf["version"]) == ("10.1.0.1", "10.1.0.2", "PSK", "tunnel", "enabled", "IKEv2")
    assert [(r["local"], r["mode"], r["anti_replay"]) for r in recs["xfrm.txt"]] == [("10.2.0.1", "transport", True)]
    assert [r["source"] for r in recs["both.txt"]] == ["list-sas", "xfrm"]
    assert [r["path"].rsplit("/", 1)[1] for r in gateway.unparsed_texts(lines).collect()] == ["none.txt"]


def test_gateway_text_in_byte_ranges(spark, tmp_path):
    """A dump of many gateways gives the same records however it is cut, also where a record or its head straddles a cut."""
    def numbered(i):
        return GATEWAY.replace("1122334455667788", f"{i:016x}") + CONF.replace("10.1.0.", f"10.1.{i}.").replace("children {", "children\n\n{") + CONNS + XFRM.replace("10.2.0.", f"10.2.{i}.")

    (tmp_path / "fleet.txt").write_bytes("".join(map(numbered, range(60))).replace("\n", "\r\n").encode())
    got, before = {}, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64m", "1013", "401"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = gateway.read_lines(spark, str(tmp_path))
            parts = lines.select("part").distinct().count()
            got[size] = (parts, gateway.parse_gateway_state(lines).orderBy("rec_ix").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = got["64m"][1]
    assert got["64m"][0] == 1 and got["1013"][0] > 30 and got["401"][0] > 70
    assert got["1013"][1] == whole and got["401"][1] == whole
    by = {}
    for r in whole:
        by.setdefault(r["source"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"list-sas": 60, "list-conns": 60, "conf": 60, "xfrm": 60}
    assert [r["ike_spi_i"] for r in by["list-sas"]] == [f"{i:016x}" for i in range(60)]
    assert [(r["local"], r["remote"], r["mode"], r["pfs_status"], r["version"]) for r in by["conf"]] == [(f"10.1.{i}.1", f"10.1.{i}.2", "tunnel", "enabled", "IKEv2") for i in range(60)]
    assert [(r["local"], r["mode"], r["anti_replay"]) for r in by["xfrm"]] == [(f"10.2.{i}.1", "transport", True) for i in range(60)]


def test_page_index(spark):
    """A third of the rows share one sort value; pages of any size and depth are the slices of the full order."""
    df = spark.range(2000).select(F.col("id").alias("row_no"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.xxhash64("id") % 90).alias("score"))
    order = [F.col("score").asc(), F.col("row_no").desc()]
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    for parts in (1, 7):
        index = fleet.PageIndex(df, order, parts)
        for at, size in ((0, 10), (150, 13), (4, 499), (2000, 1), (0, 5000)):
            got = index.page(at, size).orderBy("place").collect()
            assert [(r["row_no"], r["score"]) for r in got] == whole[at * size : (at + 1) * size]
        assert index.pages(25).filter("page = 79").count() == 25
    assert fleet.PageIndex(df.limit(0), order).page(0, 10).count() == 0


def test_search_index(spark):
    """The answers of a scan for needles of any length, with hits in one field, across two, and nowhere."""
    made = [(i, f"AA{i:04x}", f"10.0.{i % 7}.1", "192.168.0.9", "AES-GCM" if i % 3 else None, "X25519", "Cisco" if i % 5 == 0 else None, "VoIP") for i in range(300)]
    made += [(900, None, None, None, None, None, None, None), (901, *made[7][1:])]
    raw = spark.createDataFrame(made, "row_no long, session_id string, initiator_ip string, responder_ip string, e string, d string, v string, p string")
    rows = raw.select("row_no", "session_id", "initiator_ip", "responder_ip", F.struct(F.col("e").alias("encryption"), F.col("d").alias("dh_group"), F.col("v").alias("vendor")).alias("ike"), F.struct(F.col("p").alias("predicted_type")).alias("traffic"))
    needles = ["", None, "  ", "c", "1f", "aa0", " CISCO ", "cisco voip", ".1 192", "10.0.3.1", "zzz", "q", "aes-gcm x25519 v", "aa0007", "gcmq"]
    texts = {r[0]: " ".join(x for x in r[1:] if x is not None).lower() for r in made}
    want = {(n, i) for n in needles for i, t in texts.items() if (n or "").strip().lower() in t}
    got = fleet.SearchIndex(rows, "row_no").find(spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_labels_and_manifest(spark, tmp_path):
    import hashlib
    import json

    good = {"pcap": "tunnel_a__voip.pcap", "traffic_class": "VoIP", "substitution": False, "generator": "g", "duration_sec": 30, "harness_notes": [], "captured_at": "t", "testbed_commit": "c",
            "config": dict(version="IKEv2", mode="tunnel", encryption="e", integrity="i", dh_group="d", pfs_status="enabled", auth_method="PSK", ip_version="IPv4", ike_version="IKEv2")}
    bad = {**good, "pcap": "x", "traffic_class": "Chat", "config": {**good["config"], "mode": "odd"}}
    del bad["generator"]
    labels, caps = tmp_path / "labels", tmp_path / "caps"
    labels.mkdir(), caps.mkdir()
    (labels / "tunnel_a__voip.json").write_text(json.dumps(good))
    (labels / "tunnel_b__chat.json").write_text(json.dumps(bad))
    (labels / "broken.json").write_text("{nope")
    (caps / "tunnel_a__voip.pcap").write_bytes(b"abc")
    df = corpus.read_labels(spark, str(labels))
    problems = {}
    for r in corpus.label_errors(df).collect():
        problems.setdefault(r["name"], []).append(r["problem"])
    assert problems["broken"] == ["not JSON"] and "tunnel_a__voip" not in problems
    assert problems["tunnel_b__chat"] == ["missing keys: generator", "capture name differs from file name", "substitution must be set for Chat only", "config value not allowed: mode", "file name does not start with its mode"]
    digests = corpus.file_digests(spark, str(caps))
    assert digests.first()["digest"] == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(ValueError):
        corpus.write_manifest(df, digests, str(tmp_path / "m"))
    corpus.write_manifest(df.filter("name = 'tunnel_a__voip'"), digests, str(tmp_path / "m"))
    manifest = corpus.read_manifest(spark, str(tmp_path / "m"))
    assert manifest.count() == 1 and corpus.digest_mismatches(digests, manifest).isEmpty()
    usable = corpus.usable_labels(df, digests.select(F.regexp_replace("name", ".pcap$", "").alias("name")))
    assert [r["name"] for r in usable.collect()] == ["tunnel_a__voip"]


def test_store_replaces_by_job(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([("j1", "a", 1), ("j1", "a", 2), ("j1", "b", 1)], "job_id string, session_id string, n int")
    store.save_job(root, "j1", {"sessions": store.last_rows(one, ["job_id", "session_id"], "n")})
    store.save_job(root, "j2", {"sessions": spark.createDataFrame([("j2", "z", 9)], one.schema)})
    rows = sorted((r["job_id"], r["session_id"], r["n"]) for r in store.read_table(spark, root, "sessions").collect())
    assert rows == [("j1", "a", 2), ("j1", "b", 1), ("j2", "z", 9)]
    for job in ("007", "1e3", "a/b=c%20"):
        store.save_job(root, job, {"sessions": spark.createDataFrame([(job, "s", 1)], one.schema)})
        assert store.read_table(spark, root, "sessions").filter(F.col("job_id") == job).count() == 1
    assert all(store.delete_job(spark, root, job, ["sessions"]) for job in ("007", "1e3", "a/b=c%20"))
    store.save_job(root, "j1", {"sessions": one.limit(0)})
    assert {r["job_id"] for r in store.read_table(spark, root, "sessions").collect()} == {"j2"}
    assert store.delete_job(spark, root, "j2", ["sessions"]) and not store.delete_job(spark, root, "j2", ["sessions"])


def test_audit_appends_and_detects(spark):
    empty = spark.createDataFrame([], ledger.LOG_SCHEMA)
    ddl = "job_id string, order_no bigint, recorded_at string, analysis_sha256 string, capture_sha256 string"
    saves = spark.createDataFrame([("j1", 1, "t1", "a", None), ("j2", 2, "t2", "b", "c"), ("j2", 3, "t3", "b", "c")], ddl)
    first = ledger.append_entries(empty, saves).collect()
    assert [(r["seq"], r["job_id"]) for r in first] == [(1, "j1"), (2, "j2")]
    log = spark.createDataFrame(first, ledger.LOG_SCHEMA)
    more = ledger.append_entries(log, spark.createDataFrame([("j1", 4, "t4", "a", None), ("j1", 5, "t5", "x", None)], ddl)).collect()
    assert [(r["seq"], r["analysis_sha256"]) for r in more] == [(3, "x")] and more[0]["prev_hash"] == first[1]["entry_hash"]
    log = spark.createDataFrame([*first, *more], ledger.LOG_SCHEMA)
    assert ledger.chain_breaks(log, width=2).isEmpty()
    current = spark.createDataFrame([("j1", "x"), ("j2", "zzz")], "job_id string, analysis_sha256 string")
    verdict = ledger.verify_chain(log, current).first()
    assert (verdict["ok"], verdict["tampered"], verdict["chain_broken_at_seq"]) == (False, 1, None)
    edited = log.withColumn("recorded_at", F.when(F.col("seq") == 1, "later").otherwise(F.col("recorded_at")))
    assert [r["seq"] for r in ledger.chain_breaks(edited, width=2).collect()] == [1]


def test_first_record_is_the_first_of_the_first_text(spark):
    rows = [("b.txt", 0, "tunnel"), ("a.txt", 0, "transport"), ("a.txt", 1, "tunnel")]
    kinds = ", ".join(f"{f} {'boolean' if f == 'anti_replay' else 'string'}" for f in gateway.VALUE_FIELDS if f != "mode")
    df = spark.createDataFrame([(*r, "k", "conf", *[None] * (len(gateway.VALUE_FIELDS) - 1)) for r in rows], f"path string, rec_ix bigint, mode string, k string, source string, {kinds}")
    for parts in (1, 3):
        assert gateway.record_facts(df.repartition(parts), F.col("k")).first()["mode"]["value"] == "transport"


def test_moments_do_not_cancel(spark):
    base = 10**9
    row = spark.range(1_000).select((F.col("id") % 2 + base).alias("x")).agg(F.count("*").alias("n"), F.sum("x").alias("t"), F.sum(F.col("x").cast("decimal(38,0)") * F.col("x")).alias("s"))
    assert row.select(numeric.pop_var(F.col("n"), F.col("t"), F.col("s")).alias("v")).first()["v"] == 0.25


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    cols = [F.expr(e).alias(c) for c, e in standins.esp_columns(standins.Dialect(False)).items()]
    stream = live.packet_stream(spark, str(tmp_path / "in"), source.schema, files_per_tick=1).select(*cols)
    run = live.LiveRun(str(tmp_path / "run"), flows.capture_vector)
    run.start(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = {tuple(r[c] for c in flows.FEATURES) for r in run.results(spark).collect()}
    want = {tuple(r[c] for c in flows.FEATURES) for r in flows.capture_vector(source.select(*cols)).collect()}
    assert got == want and run.packets_seen == source.count()


def test_transitions_of_many_ticks(spark):
    """Against a plain walk from tick to tick, with gaps, returns, unchanged and nulled values and an empty last tick."""
    rows = [(1, "a", 5), (2, "a", 5), (3, "a", 6), (1, "b", 1), (3, "b", 1), (2, "c", None), (3, "c", None), (3, "d", None), (4, "d", 2)]
    history = spark.createDataFrame(rows, "tick bigint, key string, v int")
    ticks = spark.range(1, 6).select(F.col("id").alias("tick"))
    got = {tuple(r) for r in live.transitions(history, ticks, "key", ("v",)).select("tick", "key", "removed", "v").collect()}
    want, before = set(), {}
    for t in range(1, 6):
        now = {k: v for at, k, v in rows if at == t}
        want |= {(t, k, False, v) for k, v in now.items() if k not in before or before[k] != v}
        want |= {(t, k, True, None) for k in before if k not in now}
        before = now
    assert got == want
    events = spark.createDataFrame([(1, "e", "LOW"), (3, "e", "LOW")], "tick bigint, anomaly_id string, severity string")
    log = live.history_feed(history.withColumnRenamed("key", "session_id"), events, ticks, ("v",))
    alive = {(r["type"], r["key"]): r["tick"] for r in live.current_state(log).collect()}
    assert alive == {("live", "status"): 5} and log.filter("type = 'live'").count() == 5
    assert live.transitions(history.limit(0), ticks, "key", ("v",)).isEmpty()


def _features(df, keys):
    return {tuple(r[c] for c in (*keys, *flows.FEATURES)) for r in df.collect()}


def test_incremental_flows(spark, tmp_path):
    """Late, bursty and null packets over more batches than an epoch holds; a batch that runs again changes nothing."""
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.choice("xy"), rng.randrange(0, 40_000_000) if i % 3 else 5_000_000 + i * 997, rng.randrange(60, 1500), f"10.0.0.{rng.randrange(3)}", i) for i in range(3_000)]
    rows += [(None, "x", 1, 60, "10.0.0.1", 3_000), ("a", "x", None, 60, "10.0.0.1", 3_001)]
    df = spark.createDataFrame(rows, "cap string, cls string, t_us bigint, size bigint, src string, frame bigint")
    run = incremental.LiveFlows(str(tmp_path / "run"), ["cap", "cls"], ["cap"], epoch=2, period_us=20_000_000)
    for i in range(5):
        run.on_batch(df.filter(F.col("frame") % 5 == i), i)
    run.on_batch(df.filter(F.col("frame") % 5 == 4), 4)
    run.on_batch(df.limit(0), 5)
    whole = df.dropna(subset=["cap", "t_us"])
    want = _features(flows.flow_features(whole, ["cap", "cls"], ["cap"]), ["cap", "cls"])
    assert _features(run.results(spark), ["cap", "cls"]) == want and run.packets_seen == len(rows)
    assert _features(run.changed(spark, 4), ["cap", "cls"]) <= want
    with pytest.raises(ValueError):
        run.on_batch(df.withColumn("period", F.lit(1)), 6)


def test_a_tick_reads_its_own_slices(spark, tmp_path):
    """In a stream that is in order, a tick uses its packets and those of the slice at its border, however many lie before."""
    df = spark.range(4_000).select(F.lit("a").alias("cap"), (F.col("id") * 100_000).alias("t_us"), F.lit(100).cast("bigint").alias("size"), F.lit("s").alias("src"), F.col("id").alias("frame"))
    df.repartitionByRange(8, "frame").write.parquet(str(tmp_path / "in"))
    run = incremental.LiveFlows(str(tmp_path / "run"), ["cap"], epoch=3, period_us=50_000_000)
    stream = live.packet_stream(spark, str(tmp_path / "in"), df.schema, files_per_tick=1)
    run.start(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()
    ticks = run.ticks(spark).collect()
    assert len(ticks) == 8 and sum(t["packets"] for t in ticks) == 4_000
    if all(t["packets"] == 500 for t in ticks):
        assert max(t["used"] for t in ticks) <= 500 + 4 * 100 and max(t["scanned"] for t in ticks) <= 500 + 3 * 500
    assert _features(run.results(spark), ["cap"]) == _features(flows.capture_vector(df, "cap"), ["cap"])


def test_folds_are_fitted_together_and_predict_every_row(spark, monkeypatch, tmp_path):
    """Each row once, by the model of its own fold, which has not learned from it; three fits wait for each other."""
    rng = random.Random(3)
    rows = [(i, "up" if i % 2 else "down", float(i % 2) * 3 + rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, label string, x double, y double")
    path = str(tmp_path / "folds")
    learn.stratified_folds(df, "label", ["id"], 3).write.parquet(path)
    table, met, plain = spark.read.parquet(path), threading.Barrier(3, timeout=120), learn.fit

    def fit(train, *args, **kw):
        met.wait()
        return plain(train, *args, **kw)

    monkeypatch.setattr(learn, "fit", fit)
    models = learn.fit_folds(table, "label", "fold", ("x", "y"), numTrees=5, maxDepth=3)
    out = learn.out_of_fold(table, models, "fold").select("id", "fold", "label", "traffic.predicted_type").collect()
    assert sorted(r["id"] for r in out) == list(range(120)) and [v for v, _ in models] == [0, 1, 2]
    assert sum(r["label"] == r["predicted_type"] for r in out) >= 115
    for value, model in models:
        mean = table.filter(F.col("fold") != value).agg(F.avg("x")).first()[0]
        assert abs(model.means["x"] - mean) < 1e-4
    why = learn.explain_out_of_fold(table, models, "fold", ["id"], top=1)
    # the mean of x lies with one of the classes, so putting it in place of x costs the other class's rows their label
    assert 55 <= why.filter("feature = 'x'").count() <= 65 and why.groupBy("id").count().filter("count > 1").isEmpty()
    monkeypatch.setattr(learn, "fit", plain)
    assert learn.fit_folds(table.filter("fold = 0"), "label", "fold", ("x", "y")) == []
    with pytest.raises(ValueError):
        learn.out_of_fold(table, [], "fold")


@pytest.mark.parametrize("run", [1, 7, 1 << 15])
def test_gateway_lines_are_numbered_in_runs(spark, monkeypatch, run):
    """Numbers and heads count through the whole file, whatever the length of a run; no window spans a byte range."""
    monkeypatch.setattr(gateway, "RUN_LINES", run)
    rows = [("f", part * 1000, (part << 33) + k, f"gw{part}: IKEv2, x" if k % 4 == 0 else " " if k % 4 == 1 else f"  {part} {k}") for part in range(3) for k in range(40)]
    lines = spark.createDataFrame(rows, "path string, part long, seq long, line string")
    out = gateway.number_lines(lines)
    got = sorted((r["n"], r["line"], r[f"h{gateway.FORMATS.index('list-conns')}"]) for r in out.collect())
    shown = [r[3] for r in rows if r[3].strip()]
    assert got == [(i, line, sum(x.startswith("gw") for x in shown[:i])) for i, line in enumerate(shown, 1)]
    assert any(x.startswith("Window") and "run" in x for x in (y.strip(" +-:*()0123456789") for y in out._jdf.queryExecution().optimizedPlan().toString().splitlines()))


def test_forests_are_fitted_by_few_tasks(spark):
    df = spark.range(1000).repartition(9)
    for rows, parts in ((1000, 1), (400, 3), (10, 9)):
        few = learn.few_parts(df, rows)
        assert few.rdd.getNumPartitions() == parts and few.agg(F.sum("id")).first()[0] == 499500
    assert learn.few_parts(df.limit(0)).count() == 0


def test_search_index_numbers_its_texts(spark):
    rows = [(i, f"S{i // 2:02d}", None if i % 3 else "10.0.0.1") for i in range(40)]
    df = spark.createDataFrame(rows, "row_no long, session_id string, initiator_ip string").selectExpr(
        "*", "cast(null as string) AS responder_ip", "named_struct('encryption', 'AES', 'dh_group', cast(null as string), 'vendor', 'Acme') AS ike", "named_struct('predicted_type', 'Web') AS traffic")
    index = fleet.SearchIndex(df, "row_no")
    assert dict(index.postings.dtypes)["text_id"] == "bigint" and index.texts.count() == index.texts.select("text_id").distinct().count()
    asked = spark.createDataFrame([("s0",), (" ACME ",), ("s1",), ("10.0.0.1 aes",), ("",), ("nothing",), ("s19",)], "needle string")
    got = {}
    for r in index.find(asked).collect():
        got.setdefault(r["needle"], []).append(r["row_no"] if "row_no" in r else r["row_id"])
    text = {r["row_no"]: r["t"] for r in df.select("row_no", fleet.search_text().alias("t")).collect()}
    want = {n: sorted(i for i, t in text.items() if n.strip().lower() in t) for n in ("s0", " ACME ", "s1", "10.0.0.1 aes", "", "nothing", "s19")}
    assert {n: sorted(v) for n, v in got.items()} == {n: v for n, v in want.items() if v}
