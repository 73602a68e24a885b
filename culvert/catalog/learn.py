"""Model and metric queries. All models have their default sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.catalog.flows import BASE, ESP, flow_cte, packets, r4
from culvert.catalog.rules import SESS
from culvert.operators import flows as FL
from culvert.operators import learn as O
from culvert.operators import parameters as P
from culvert.plans import standins as S
from culvert.session import materialise

PREDS = S.duck_cte("preds")
KEYS = ["capture_id", "peers", "flow_class"]
#: rows of a stored table's file, so that scoring spreads over tasks
FILE_ROWS = 1 << 13
CLASSES = ["click", "error", "purchase", "signup", "view"]


def flows(s, d):
    """One flow per (capture, pair, class), labelled with its class."""
    return FL.flow_features(packets(s, d), KEYS, KEYS[:2]).withColumn("label", F.col("flow_class"))


def stored_flows(s, d):
    return materialise(flows(s, d), "flows", FILE_ROWS)


FEAT = f"{ESP}, {BASE}, {flow_cte(KEYS, KEYS[:2])}"
add(
    "feature_means",
    lambda s, d: O.mean_row(flows(s, d)),
    f"WITH {FEAT} SELECT " + ", ".join(f"round_even(sum(round_even({c} * 10000.0::DOUBLE, 0)::HUGEINT)::DOUBLE / count(*)::DOUBLE / 10000.0::DOUBLE * 1000000.0::DOUBLE, 0)::DOUBLE / 1000000.0::DOUBLE AS {c}" for c in FL.FEATURES) + " FROM feat",
)


def _table(s, d):
    busiest = FL.busiest_flow(FL.flow_features(packets(s, d), KEYS, KEYS[:2]), KEYS[:2])
    labels = packets(s, d).groupBy("peers").agg(F.min("flow_class").alias("label"))
    return O.training_table(busiest, labels, "peers").select("capture_id", "peers", "label", "pkt_total", "pkt_size_mean")


add(
    "training_table",
    _table,
    f"""WITH {FEAT}, b AS (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY capture_id, peers ORDER BY pkt_total DESC, first_frame) = 1),
l AS (SELECT peers, min(flow_class) AS label FROM base GROUP BY 1) SELECT capture_id, b.peers, label, pkt_total, pkt_size_mean FROM b JOIN l USING (peers) WHERE pkt_total > 0""",
)
add(
    "class_metrics",
    lambda s, d: O.class_metrics(S.predictions(s, d)),
    f"""WITH {PREDS}, k AS (SELECT label AS class FROM preds UNION SELECT prediction FROM preds),
m AS (SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp, count(*) FILTER (label = class) AS a, count(*) FILTER (prediction = class) AS p FROM k, preds GROUP BY class)
SELECT class, a AS support, {r4('CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END')} AS precision, {r4('CASE WHEN a > 0 THEN tp::DOUBLE / a ELSE 0 END')} AS recall, {r4('CASE WHEN a + p > 0 THEN (2 * tp)::DOUBLE / (a + p) ELSE 0 END')} AS f1 FROM m""",
)
add(
    "overall_metrics",
    lambda s, d: O.overall_metrics(S.predictions(s, d)),
    f"""WITH {PREDS}, k AS (SELECT DISTINCT label AS class FROM preds), m AS (SELECT class, {r4('(2 * count(*) FILTER (label = class AND prediction = class))::DOUBLE / (count(*) FILTER (label = class) + count(*) FILTER (prediction = class))')} AS f1 FROM k, preds GROUP BY class)
SELECT (SELECT count(*) FROM preds) AS n, (SELECT {r4('count(*) FILTER (label = prediction)::DOUBLE / count(*)')} FROM preds) AS accuracy, (SELECT {r4('sum(f1::DECIMAL(12,4))::DOUBLE / count(*)')} FROM m) AS f1_macro""",
)
add(
    "confusion_matrix",
    lambda s, d: O.confusion_matrix(S.predictions(s, d), CLASSES),
    f"WITH {PREDS} SELECT label, " + ", ".join(f"count(*) FILTER (prediction = '{c}') AS {c}" for c in CLASSES) + ", count(*) FILTER (prediction IS NULL OR prediction NOT IN (" + ", ".join(f"'{c}'" for c in CLASSES) + ")) AS other FROM preds GROUP BY label",
)
add("confusion_pairs", lambda s, d: O.confusion_pairs(S.predictions(s, d)), f"WITH {PREDS} SELECT label, prediction, count(*) AS n FROM preds WHERE label <> prediction GROUP BY ALL")


def _mode_features(s, d):
    return O.mode_features(S.sessions(s, d)).select("row_no", "is_ipv6", "is_aead", "block_8")


add(
    "mode_features",
    _mode_features,
    f"WITH {SESS} SELECT row_no, (ip_version = 'IPv6')::INT::DOUBLE AS is_ipv6, (contains(encryption, 'GCM') OR contains(encryption, 'CCM'))::INT::DOUBLE AS is_aead, contains(encryption, 'DES')::INT::DOUBLE AS block_8 FROM sess",
)
GUESS = {"g_mode": "CASE row_no % 2 WHEN 0 THEN 'tunnel' ELSE 'transport' END", "g_conf": "cast(row_no % 100 as double) / cast(100 as double)"}


def _fill_mode(s, d):
    g = S.sessions(s, d).withColumns({k: F.expr(v) for k, v in GUESS.items()})
    out = O.fill_mode(g, F.col("g_mode"), F.col("g_conf"), F.col("flow.pkt_total") > 0)
    return out.select("row_no", "ike.mode", "ike.mode_confidence", F.array_join("ike.inferred_fields", ",").alias("inferred_fields"))


TAKE = f"(pkt_total > 0 AND mode = 'unknown' AND {GUESS['g_conf']} >= 0.7)"
add(
    "mode_fill",
    _fill_mode,
    f"WITH {SESS} SELECT row_no, CASE WHEN {TAKE} THEN {GUESS['g_mode']} ELSE mode END AS mode, CASE WHEN {TAKE} THEN {GUESS['g_conf']} END AS mode_confidence, array_to_string(CASE WHEN {TAKE} THEN list_sort(list_distinct(list_append(inferred_fields, 'mode'))) ELSE inferred_fields END, ',') AS inferred_fields FROM sess",
)


def _fill_structure(s, d):
    g = S.sessions(s, d).withColumns({k: F.expr(v) for k, v in GUESS.items()})
    out = O.fill_from_structure(g, F.lit("AES-128-CBC"), F.lit("MODP2048"), F.col("g_conf"), F.col("ike.version") == "IKEv2")
    return out.select("row_no", "ike.encryption", "ike.dh_group", "ike.confidence_source", F.array_join("ike.inferred_fields", ",").alias("inferred_fields"))


SURE = f"(version = 'IKEv2' AND {GUESS['g_conf']} >= 0.6)"
E, DH = f"({SURE} AND encryption = 'unknown')", f"({SURE} AND dh_group = 'unknown')"
add(
    "structure_fill",
    _fill_structure,
    f"""WITH {SESS} SELECT row_no, CASE WHEN {E} THEN 'AES-128-CBC' ELSE encryption END AS encryption, CASE WHEN {DH} THEN 'MODP2048' ELSE dh_group END AS dh_group,
 CASE WHEN {E} OR {DH} THEN 'classifier' ELSE 'parser' END AS confidence_source, array_to_string(CASE WHEN {E} OR {DH} THEN list_sort(list_distinct(list_concat(inferred_fields, CASE WHEN {E} THEN ['encryption'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN {DH} THEN ['dh_group'] ELSE CAST([] AS VARCHAR[]) END))) ELSE inferred_fields END, ',') AS inferred_fields FROM sess""",
)
add(
    "split_sizes",
    lambda s, d: O.stratified_split(flows(s, d), "label", KEYS).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {FEAT}, r AS (SELECT flow_class AS label, (row_number() OVER (PARTITION BY flow_class ORDER BY first_frame) - 0.5) / count(*) OVER (PARTITION BY flow_class) AS x FROM feat)
SELECT label, CASE WHEN x < 0.70 THEN 'train' WHEN x < 0.85 THEN 'val' ELSE 'test' END AS part, count(*) AS n FROM r GROUP BY ALL""",
)


def _fitted(s, d):
    """Stored flows dealt into folds, and the model of each fold."""
    table = materialise(O.stratified_folds(stored_flows(s, d), "label", KEYS), "folds", FILE_ROWS)
    return table, O.fit_folds(table, "label", "fold")


def _predictions(s, d):
    table, models = _fitted(s, d)
    return O.out_of_fold(table, models, "fold").select(*KEYS, "label", "traffic.*")


def _explanations(s, d):
    table, models = _fitted(s, d)
    return O.explain_out_of_fold(table, models, "fold", KEYS)


def _selection(s, d):
    parts = materialise(O.stratified_split(stored_flows(s, d), "label", KEYS), "parts", FILE_ROWS)
    model, f1 = O.select_model(parts.filter("part = 'train'"), parts.filter("part = 'val'"), "label")
    rows = [(model.algo, model.version, float(f1), n, w) for n, w in (model.importances or {"none": 0.0}).items()]
    return s.createDataFrame(rows, "algo string, model_version string, selection_macro_f1 double, feature string, importance double")


def _folds(s, d, features=FL.FEATURES):
    table = materialise(O.stratified_folds(stored_flows(s, d), "label", KEYS), "folds", FILE_ROWS)
    pred = O.cross_validate(table, "label", "fold", features)
    return O.overall_metrics(pred)


def _held_out(s, d):
    table = stored_flows(s, d).withColumn("grp", F.col("capture_id").cast("string"))
    return O.confusion_counts(O.cross_validate(table, "label", "grp"))


def _group_folds(s, d):
    cfg = F.concat_ws("_", (F.hash("peers") % 12).cast("string"), F.col("capture_id").cast("string"))
    table = materialise(O.group_folds(stored_flows(s, d).withColumn("cfg", cfg), "cfg"), "folds", FILE_ROWS)
    return O.overall_metrics(O.cross_validate(table, "label", "fold"))


def _protocol(s, d):
    m = S.ike_messages(s, d)
    known = P.parameters(m).filter("encryption <> 'unknown' AND dh_group <> 'unknown'").select(*P.SA, "encryption", "dh_group")
    table = materialise(P.structural_features(m).join(known, P.SA), "structure")
    models = O.fit_protocol(table)
    return O.predict_protocol(table, models).select(*P.SA, "guess_encryption", "guess_dh_group", "guess_confidence")


add("traffic_predictions", _predictions)
add("prediction_explanations", _explanations)
add("model_selection", _selection)
add("stratified_cross_validation", _folds)
add("ablation_without_volume", lambda s, d: _folds(s, d, O.without_volume()))
add("leave_one_group_out", _held_out)
add("group_cross_validation", _group_folds)
add("protocol_guesses", _protocol)
