"""Flow queries over the packet stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from culvert.catalog import add
from culvert.functions.net import peer_pair
from culvert.operators import flows as O
from culvert.plans import standins as S

PEERS_SQL = "least(src, dst) || '|' || greatest(src, dst)"
SPI_SQL = "coalesce(lpad(lower(to_hex(spi)), 8, '0'), 'unknown')"


def r4(expr: str) -> str:
    return f"round_even(({expr}) * 10000.0::DOUBLE, 0)::DOUBLE / 10000.0::DOUBLE"


def flow_cte(keys: list[str], list_keys: list[str], source: str = "base") -> str:
    """Feature CTEs named ``feat`` over a CTE with the key columns, t_us, size, src and frame."""
    k = ", ".join(keys)
    lk = ", ".join(list_keys)
    on = " AND ".join(f"p.{c} = i.{c}" for c in keys)
    return f"""
lead_src AS (SELECT {lk}, arg_min(src, frame) AS up_src FROM {source} GROUP BY {lk}),
gaps AS (SELECT {k}, size, src, frame, t_us, t_us - lag(t_us) OVER (PARTITION BY {k} ORDER BY t_us, frame) AS gap,
   count(*) OVER w AS n_in, max(t_us) OVER w AS win_end FROM {source}
   WINDOW w AS (PARTITION BY {k} ORDER BY t_us RANGE BETWEEN CURRENT ROW AND 100000 FOLLOWING)),
opened AS (SELECT DISTINCT {k}, t_us AS s, win_end AS e FROM gaps WHERE n_in > 10),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {k} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM opened),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY s ROWS UNBOUNDED PRECEDING) AS isl FROM marked),
islands AS (SELECT {k}, isl, min(s) AS s, max(e) AS e FROM numbered GROUP BY {k}, isl),
island_gaps AS (SELECT *, s - lag(e) OVER (PARTITION BY {k} ORDER BY s) AS g FROM islands),
bursts AS (SELECT {k}, count(*) AS bursts, sum(e - s)::BIGINT AS dur, count(g) AS ng, sum(g)::BIGINT AS gapsum FROM island_gaps GROUP BY {k}),
inside AS (SELECT {', '.join('p.' + c for c in keys)}, count(*) AS bn, sum(p.size)::HUGEINT AS bs, sum(p.size * p.size)::HUGEINT AS bs2
   FROM {source} p JOIN islands i ON {on} AND p.t_us BETWEEN i.s AND i.e GROUP BY ALL),
sums AS (SELECT {k}, count(*) AS n, sum(size)::HUGEINT AS sz, sum(size * size)::HUGEINT AS sz2, quantile_cont(size, 0.1) AS p10,
   quantile_cont(size, 0.9) AS p90, max(t_us) - min(t_us) AS span, sum(gap::HUGEINT * gap)::HUGEINT AS gap2, min(frame) AS first_frame
   FROM gaps GROUP BY {k}),
dirs AS (SELECT {k}, coalesce(sum(size) FILTER (src = up_src), 0)::BIGINT AS up, coalesce(sum(size) FILTER (src <> up_src), 0)::BIGINT AS down
   FROM {source} JOIN lead_src USING ({lk}) GROUP BY {k}),
feat AS (SELECT {k}, first_frame,
   {r4('sz::DOUBLE / n::DOUBLE')} AS pkt_size_mean,
   {r4('CASE WHEN n > 1 THEN sqrt((n * sz2 - sz * sz)::DOUBLE) / n::DOUBLE ELSE 0 END')} AS pkt_size_std,
   {r4('p10')} AS pkt_size_p10, {r4('p90')} AS pkt_size_p90,
   {r4('CASE WHEN n > 1 THEN span::DOUBLE / (n - 1)::DOUBLE / 1000.0::DOUBLE ELSE 0 END')} AS iat_mean_ms,
   {r4('CASE WHEN n > 2 THEN sqrt(((n - 1) * gap2 - span::HUGEINT * span)::DOUBLE) / (n - 1)::DOUBLE / 1000.0::DOUBLE ELSE 0 END')} AS iat_std_ms,
   {r4('CASE WHEN down > 0 THEN up::DOUBLE / down::DOUBLE WHEN up > 0 THEN n::DOUBLE ELSE 0 END')} AS dir_ratio,
   coalesce(bursts, 0)::BIGINT AS burst_count,
   {r4('CASE WHEN bursts IS NULL THEN 0 WHEN ng > 0 AND gapsum > 0 THEN (dur::DOUBLE / bursts::DOUBLE) / (gapsum::DOUBLE / ng::DOUBLE) ELSE bursts::DOUBLE END')} AS burst_gap_ratio,
   {r4('CASE WHEN coalesce(bn, 0) > 1 THEN (bn * bs2 - bs * bs)::DOUBLE / (bn::DOUBLE * bn::DOUBLE) ELSE 0 END')} AS payload_size_var_burst,
   {r4('span::DOUBLE / 1000000.0::DOUBLE')} AS flow_duration_sec, n AS pkt_total,
   {r4('CASE WHEN span > 0 THEN n::DOUBLE / (span::DOUBLE / 1000000.0::DOUBLE) ELSE 0 END')} AS rate_pps
   FROM sums JOIN dirs USING ({k}) LEFT JOIN bursts USING ({k}) LEFT JOIN inside USING ({k}))"""


def packets(spark, sf_dir):
    """Packets with their unordered peers and SPI key."""
    df = S.esp_packets(spark, sf_dir)
    return df.withColumn("peers", peer_pair(F.col("src"), F.col("dst"))).withColumn("spi_hex", O.spi_key(F.col("spi")))


ESP = S.duck_cte("esp")
BASE = f"base AS (SELECT *, {PEERS_SQL} AS peers, {SPI_SQL} AS spi_hex FROM esp)"
BY_SPI = ["capture_id", "peers", "spi_hex"]


def _features(keys, list_keys=None):
    return lambda spark, d: O.flow_features(packets(spark, d), keys, list_keys)


add(
    "flow_features_by_class",
    _features(["flow_class"]),
    f"WITH {ESP}, {BASE}, {flow_cte(['flow_class'], ['flow_class'])} SELECT * FROM feat",
)
add(
    "flow_features_by_spi",
    _features(BY_SPI, BY_SPI[:2]),
    f"WITH {ESP}, {BASE}, {flow_cte(BY_SPI, BY_SPI[:2])} SELECT * FROM feat",
)
add(
    "capture_vector",
    lambda spark, d: O.capture_vector(packets(spark, d)),
    f"WITH {ESP}, {BASE}, {flow_cte(['capture_id'], ['capture_id'])} SELECT * FROM feat",
)
add(
    "busiest_flow_per_pair",
    lambda spark, d: O.busiest_flow(O.flow_features(packets(spark, d), BY_SPI, BY_SPI[:2]), BY_SPI[:2]),
    f"WITH {ESP}, {BASE}, {flow_cte(BY_SPI, BY_SPI[:2])} SELECT * FROM feat QUALIFY row_number() OVER "
    "(PARTITION BY capture_id, peers ORDER BY pkt_total DESC, first_frame) = 1",
)


def _burst_packets(spark, d):
    rows = O.packet_positions(packets(spark, d), ["flow_class"])
    return rows.filter("in_burst").select("flow_class", "frame", "t_us", "size")


add(
    "burst_packets",
    _burst_packets,
    f"WITH {ESP}, {BASE}, {flow_cte(['flow_class'], ['flow_class'])} SELECT p.flow_class, p.frame, p.t_us, p.size "
    "FROM base p JOIN islands i ON p.flow_class = i.flow_class AND p.t_us BETWEEN i.s AND i.e",
)
add(
    "direction_totals",
    lambda spark, d: O.direction_bytes(packets(spark, d), BY_SPI, BY_SPI[:2]),
    f"WITH {ESP}, {BASE}, {flow_cte(BY_SPI, BY_SPI[:2])} SELECT {', '.join(BY_SPI)}, up AS up_bytes, down AS down_bytes FROM dirs",
)
