"""DuckDB forms of the registered queries."""

from __future__ import annotations

from fieldloom.functions.hashing import FIRST_FACTOR, GAMMA, SECOND_FACTOR
from fieldloom.plans.bind import MODEL

ORACLE: dict[str, str] = {}


def _stats(v: str) -> str:
    """Statistics over finite values of ``v``."""
    nan = "'NaN'::DOUBLE"
    ok = f"FILTER (WHERE isfinite({v}))"
    return f"count({v}) {ok} AS count, count(*) - count({v}) {ok} AS n_missing, round(coalesce(min({v}) {ok}, {nan}), 6) AS min, round(coalesce(max({v}) {ok}, {nan}), 6) AS max, round(coalesce(avg({v}) {ok}, {nan}), 6) AS mean, round(coalesce(stddev_pop({v}) {ok}, {nan}), 6) AS std"


FIELD = "(SELECT vec_id AS row, i - 1 AS site, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))"
WEIGHT = "CASE WHEN site IN (0, 63) THEN 0.5 ELSE 1.0 END"

ORACLE["scalar_stats_by_category"] = f"SELECT event_type, {_stats('value')} FROM events GROUP BY event_type"
ORACLE["scalar_stats_all"] = f"SELECT {_stats('l_extendedprice')} FROM lineitem"
ORACLE["field_stats_row"] = f"SELECT row, {_stats('v')} FROM {FIELD} GROUP BY row"
ORACLE["field_stats_label"] = f"SELECT row, 'q' || (site // 16)::VARCHAR AS quarter, {_stats('v')} FROM {FIELD} GROUP BY ALL"
ORACLE["field_stats_pooled"] = f"SELECT 'q' || (site // 16)::VARCHAR AS quarter, {_stats('v')} FROM {FIELD} GROUP BY ALL"
ORACLE["field_stats_by_instance"] = f"SELECT nation, {_stats('v')} FROM (SELECT n_nationkey::BIGINT AS nation, n_nationkey * 10.0::DOUBLE + i AS v FROM nation, range(0, 4) t(i)) GROUP BY nation"
ORACLE["draw_summaries"] = f"""
WITH d AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS draw FROM embeddings)
SELECT d.label::BIGINT AS label, f.site, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.9), 6) AS quantile
FROM d JOIN {FIELD} f ON f.row = d.vec_id GROUP BY ALL"""
ORACLE["bounds_observed"] = "SELECT 'discount' AS key, min(l_discount) + 0.0::DOUBLE AS lower, max(l_discount) + 0.0::DOUBLE AS upper FROM lineitem UNION ALL SELECT 'quantity', min(l_quantity) + 0.0::DOUBLE, max(l_quantity) + 0.0::DOUBLE FROM lineitem"
_WIDTH = "SELECT 'discount' AS key, 2000.0::DOUBLE / (max(l_discount) - min(l_discount)) AS ratio FROM lineitem UNION ALL SELECT 'quantity', 60.0::DOUBLE / (max(l_quantity) - min(l_quantity)) FROM lineitem"
ORACLE["bounds_stale"] = f"SELECT key, round(ratio, 6) AS ratio, ratio > 4 AS stale FROM ({_WIDTH})"
ORACLE["rows_per_support"] = "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'long' ELSE 'short' END AS support, count(*) AS n FROM orders GROUP BY ALL"
ORACLE["integrate_axis"] = f"SELECT row, round(sum(v * {WEIGHT}), 6) AS integral, 0::BIGINT AS n_missing FROM {FIELD} GROUP BY row"
ORACLE["integrate_region"] = f"SELECT row, round(sum(v * {WEIGHT}), 6) AS integral FROM {FIELD} WHERE site // 16 = 1 GROUP BY row"

_POINTS = "pts AS (SELECT p_partkey AS node, p_partkey % 20 + p_size * 0.001::DOUBLE AS x, (p_partkey // 20)::DOUBLE AS y, p_retailprice AS price, p_type AS kind FROM part)"
_CELLS = "cells AS (SELECT (a // 20) * 19 + a % 20 AS cell, [a, a + 1, a + 21, a + 20] AS nodes FROM (SELECT p_partkey - 20 AS a FROM part WHERE p_partkey % 20 < 19 AND p_partkey >= 20))"
_AREAS = """areas AS (
  SELECT cell, abs((a.x * b.y - b.x * a.y) + (b.x * c.y - c.x * b.y) + (c.x * d.y - d.x * c.y) + (d.x * a.y - a.x * d.y)) / 2 AS area
  FROM cells JOIN pts a ON a.node = nodes[1] JOIN pts b ON b.node = nodes[2] JOIN pts c ON c.node = nodes[3] JOIN pts d ON d.node = nodes[4])"""
_LUMPED = "lumped AS (SELECT node, sum(area / 4) AS weight FROM (SELECT cell, unnest(nodes) AS node FROM cells) JOIN areas USING (cell) GROUP BY node)"
ORACLE["cell_measure"] = f"WITH {_POINTS}, {_CELLS}, {_AREAS} SELECT cell, round(area, 9) AS area FROM areas"
ORACLE["node_weights"] = f"WITH {_POINTS}, {_CELLS}, {_AREAS}, {_LUMPED} SELECT node, round(weight, 9) AS weight FROM lumped"
ORACLE["integrate_mesh"] = f"WITH {_POINTS}, {_CELLS}, {_AREAS}, {_LUMPED} SELECT kind, round(sum(price * weight), 4) AS integral, round(sum(weight), 6) AS area FROM pts JOIN lumped USING (node) GROUP BY kind"
ORACLE["offsets_running"] = f"WITH {_CELLS} SELECT cell, (sum(len(nodes)) OVER (ORDER BY cell))::BIGINT AS \"offset\" FROM cells"
ORACLE["derived_displacement"] = "SELECT n_nationkey::BIGINT AS instance, i AS node, (n_nationkey * 10.0::DOUBLE + i) - (3 * 10.0::DOUBLE + i) AS value FROM nation, range(0, 4) t(i)"

ORACLE["gather_group_varying"] = """
SELECT c_custkey AS row, n_name AS nation_name, r_name AS region_name, i AS node, n_nationkey * 10.0::DOUBLE + i AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, range(0, 4) t(i)"""
ORACLE["group_parents"] = "SELECT DISTINCT c_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region FROM customer JOIN nation ON c_nationkey = n_nationkey"
_ORDINAL = "SELECT o_orderkey AS row, o_orderkey % 2 AS s, o_totalprice AS p, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 AS instance FROM orders"
ORACLE["unaligned_ordinal"] = f"SELECT row, CASE s WHEN 0 THEN 'long' ELSE 'short' END AS support, instance, i AS node, round(p + i, 6) AS value FROM ({_ORDINAL}), range(0, 7) t(i) WHERE s = 0 OR i < 4"
ORACLE["rows_on_support"] = f"SELECT row, instance AS ordinal FROM ({_ORDINAL}) WHERE s = 1"
ORACLE["at_probe"] = "SELECT vec_id AS row, embedding[18]::DOUBLE AS value FROM embeddings"
ORACLE["row_range"] = f"SELECT row, site AS node, v AS value FROM {FIELD} WHERE row >= 100 AND row < 200"
ORACLE["transpose_named"] = f"SELECT site AS node, 0::BIGINT AS component, row, v AS value FROM {FIELD}"
ORACLE["permute_added_axis"] = "SELECT 0::BIGINT AS draw, i AS node, n_nationkey::BIGINT AS instance, n_nationkey * 10.0::DOUBLE + i AS value FROM nation, range(0, 4) t(i)"
ORACLE["time_series_scalar"] = "SELECT event_id AS row, epoch_us(ts) / 1e6::DOUBLE AS t, value AS v FROM events WHERE user_id = 3"
ORACLE["time_series_node"] = "SELECT c_custkey AS row, c_custkey::DOUBLE AS t, n_nationkey * 10.0::DOUBLE + 1 AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"
ORACLE["scalar_range"] = "SELECT event_id AS row, value FROM events WHERE event_id >= 50 AND event_id < 150"

ORACLE["category_encode"] = "SELECT id, count(*) AS n FROM lineitem JOIN (SELECT l_returnflag AS e, row_number() OVER (ORDER BY l_returnflag) - 1 AS id FROM (SELECT DISTINCT l_returnflag FROM lineitem)) ON e = l_returnflag GROUP BY id"
ORACLE["category_decode"] = "SELECT CASE WHEN l_returnflag = 'N' THEN id::VARCHAR ELSE l_returnflag END AS entry, count(*) AS n FROM lineitem JOIN (SELECT l_returnflag AS e, row_number() OVER (ORDER BY l_returnflag) - 1 AS id FROM (SELECT DISTINCT l_returnflag FROM lineitem)) ON e = l_returnflag GROUP BY ALL"
ORACLE["category_map"] = "SELECT id * 10 AS from_id, id AS to_id, event_type AS entry FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)) WHERE event_type <> 'click'"
ORACLE["status_filter"] = "SELECT event_id AS row, value FROM events WHERE event_type <> 'error'"
ORACLE["bounds_filter"] = "SELECT id AS returnflag, count(*) AS n FROM lineitem JOIN (SELECT l_returnflag AS e, row_number() OVER (ORDER BY l_returnflag) - 1 AS id FROM (SELECT DISTINCT l_returnflag FROM lineitem)) ON e = l_returnflag WHERE l_quantity BETWEEN 10 AND 20 GROUP BY id"
ORACLE["bounds_intersection"] = """
WITH b AS (SELECT l_linestatus, min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) p0, max(l_extendedprice) p1 FROM lineitem GROUP BY 1)
SELECT 'quantity' AS key, max(q0) AS lower, min(q1) AS upper, max(q0) > min(q1) AS empty FROM b
UNION ALL SELECT 'price', max(p0), min(p1), max(p0) > min(p1) FROM b"""


def _dealt(units: str, seed: int, parts: str) -> str:
    m = "18446744073709551616::UHUGEINT"
    return f"""
u AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS place FROM ({units})),
z0 AS (SELECT *, (({seed}::UHUGEINT + (place + 1)::UHUGEINT * {GAMMA}::UHUGEINT) % {m}) AS z FROM u),
z1 AS (SELECT * EXCLUDE z, (xor(z, z // {1 << 30}::UHUGEINT) * {FIRST_FACTOR}::UHUGEINT) % {m} AS z FROM z0),
z2 AS (SELECT * EXCLUDE z, (xor(z, z // {1 << 27}::UHUGEINT) * {SECOND_FACTOR}::UHUGEINT) % {m} AS z FROM z1),
dealt AS (SELECT unit_id, unit, row_number() OVER (ORDER BY xor(z, z // {1 << 31}::UHUGEINT), unit) - 1 AS turn, count(*) OVER () AS n FROM z2),
parted AS (SELECT unit_id, unit, {parts} AS part FROM dealt)"""


# largest remainders: of 0.8 and 0.2, and of 0.7, 0.2 and 0.1
_TWO = "CASE WHEN turn < floor(0.2::DOUBLE * n) + CASE WHEN n - floor(0.2::DOUBLE * n) - floor(0.8::DOUBLE * n) > 0 AND 0.2::DOUBLE * n - floor(0.2::DOUBLE * n) >= 0.8::DOUBLE * n - floor(0.8::DOUBLE * n) THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END"
ORACLE["grouped_split"] = f"""
WITH {_dealt("SELECT s_suppkey AS unit_id, s_name AS unit FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)", 0, _TWO)}
SELECT unit, part, count(*) AS n_rows FROM parted JOIN lineitem ON l_suppkey = unit_id GROUP BY ALL"""
_THREE = """CASE WHEN turn < (SELECT size FROM sizes WHERE part = 'test') THEN 'test'
WHEN turn < (SELECT sum(size) FROM sizes WHERE part <> 'validation') THEN 'train' ELSE 'validation' END"""
ORACLE["split_rows"] = f"""
WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events),
shares AS (SELECT part, f / (0.2::DOUBLE + 0.7::DOUBLE + 0.1::DOUBLE) * n AS share FROM n, (VALUES ('test', 0.2::DOUBLE), ('train', 0.7::DOUBLE), ('validation', 0.1::DOUBLE)) t(part, f)),
sizes AS (
  SELECT part, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, part) <= (SELECT any_value(n) FROM n) - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS size FROM shares),
{_dealt("SELECT DISTINCT user_id AS unit_id, 'u' || lpad(user_id::VARCHAR, 9, '0') AS unit FROM events", 7, _THREE)}
SELECT event_id AS row, part FROM events JOIN parted ON unit_id = user_id"""
ORACLE["split_leaks"] = """
SELECT 'u' || lpad(user_id::VARCHAR, 9, '0') AS unit, string_agg(DISTINCT part, ',' ORDER BY part) AS parts
FROM (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM events) GROUP BY user_id HAVING count(DISTINCT part) > 1"""


def _affine(row: list[float], b: float, keys: tuple[str, ...]) -> str:
    """The same sums in the same order."""
    total = "0.0::DOUBLE"
    for a, k in zip(row, keys, strict=True):
        total = f"({total} + {a!r}::DOUBLE * {k})"
    return f"({total} + {b!r}::DOUBLE)"


_P = MODEL["pressure"]
_PS = ", ".join(f"{_affine(_P['A'][i], _P['b'][i], ('l_discount', 'l_quantity'))} AS p{i}" for i in range(6))
ORACLE["affine_evaluate"] = f"SELECT l_orderkey * 8 + l_linenumber AS row, {_affine(MODEL['cl']['A'][0], MODEL['cl']['b'][0], ('l_discount', 'l_quantity'))} AS cl, {_PS} FROM lineitem"
ORACLE["affine_band"] = "SELECT 0.02::DOUBLE AS band, 0.95::DOUBLE AS level, 'constant band' AS method, count(*) AS n FROM lineitem"
ORACLE["registered_model"] = "SELECT l_orderkey * 8 + l_linenumber AS row, round(l_quantity / (1 + l_discount), 9) AS value FROM lineitem"
_CASES = " ".join(f"WHEN {i} THEN {_affine(_P['A'][i], _P['b'][i], ('d', 'q'))}" for i in range(6))
ORACLE["evaluate_slots"] = f"SELECT row, i AS node, CASE i {_CASES} END AS value FROM (SELECT o_orderkey AS row, (o_orderkey % 11) / 100::DOUBLE AS d, (o_orderkey % 50)::DOUBLE AS q FROM orders), range(0, 6) t(i)"
ORACLE["distill_grid"] = f"""
WITH b AS (SELECT min(l_discount) d0, max(l_discount) d1, min(l_quantity) q0, max(l_quantity) q1 FROM lineitem)
SELECT i AS row, round({_affine(MODEL['cl']['A'][0], MODEL['cl']['b'][0], ('(d0 + (d1 - d0) * (i // 7) / 4)', '(q0 + (q1 - q0) * (i % 7) / 6)'))}, 9) AS value FROM b, range(0, 35) t(i)"""
ORACLE["prediction_band"] = f"SELECT row, site, round(v, 9) AS mean, round(v - abs(v) * 0.1::DOUBLE, 9) AS lower, round(v + abs(v) * 0.1::DOUBLE, 9) AS upper FROM {FIELD}"

ORACLE["append_upsert"] = """
WITH n AS (SELECT count(*) AS n FROM orders),
batch AS (SELECT o_orderkey AS k, o_orderkey % 7 AS day, o_totalprice + 1000 AS price, row_number() OVER (PARTITION BY o_orderkey % 20 = 0 ORDER BY o_orderkey) - 1 AS ord FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_orderkey AS row, o_orderkey AS id, (o_orderkey % 7)::DOUBLE AS day, round(CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice + 1000 ELSE o_totalprice END, 6) AS price FROM orders
UNION ALL SELECT ord + n, k + n, day::DOUBLE, round(price, 6) FROM batch, n WHERE k % 20 <> 0"""
ORACLE["structural_diff"] = """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 50 = 1 THEN 'only left' WHEN c_custkey % 40 = 0 THEN 'differs' END AS kind FROM customer) WHERE kind IS NOT NULL GROUP BY kind"""
ORACLE["units_dims"] = """
SELECT u[1] AS units, count(*) AS n, any_value(u[2]) AS dims FROM (
  SELECT [['W m-2', 'kg:1,s:-3'], ['kg/(m s', NULL], ['m s-1', 'm:1,s:-1'], ['Pa', 'kg:1,m:-1,s:-2'], ['furlong', NULL], ['kg/(m s)', 'kg:1,m:-1,s:-1'], ['1', '']][p_size % 7 + 1] AS u FROM part) GROUP BY u[1]"""
ORACLE["path_columns"] = "SELECT 's' || (c_nationkey % 3)::VARCHAR AS support, CASE WHEN c_nationkey % 2 = 0 THEN 'node' ELSE 'cell' END AS location, c_mktsegment AS name, count(*) AS n FROM customer GROUP BY ALL"
ORACLE["chunk_default"] = "SELECT p_size * 8 * p_partkey AS bytes_per_row, p_partkey * 3 AS n_rows, CASE WHEN p_partkey = 0 THEN 1 ELSE greatest(1, least(p_partkey * 3, 1048576 // greatest(1, p_size * 8 * p_partkey))) END::BIGINT AS chunk FROM part"


def _rule(rule: str, path: str, source: str, index: str) -> str:
    return f"SELECT '{rule}' AS rule, '{path}' AS path, count(*) AS n_bad, min({index})::BIGINT AS first_row FROM {source}"


ORACLE["rule_e05"] = _rule("E05", "axis/node_arrays/embedding", "embeddings WHERE vec_id % 97 = 5", "vec_id")
ORACLE["rule_e06"] = _rule("E06", "row_support", "orders WHERE o_orderkey % 1000 = 7", "o_orderkey")
ORACLE["rule_e09"] = _rule(
    "E09",
    "keys/t",
    "(SELECT event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT event_id, user_id, CASE WHEN event_id % 100 = 99 THEN epoch_us(ts) / 1e6 - 1e9 WHEN event_id % 100 = 50 THEN NULL ELSE epoch_us(ts) / 1e6 END AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) ) WHERE event_id NOT IN (SELECT min(event_id) FROM events GROUP BY user_id) AND (t IS NULL OR p IS NULL OR t <= p)",
    "event_id",
)
ORACLE["rule_e10"] = _rule("E10", "keys/event_type", "events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 OFFSET 3)", "event_id")
ORACLE["rule_e16"] = "SELECT 'E16' AS rule, 'long/node_arrays/load' AS path, count(*) FILTER (WHERE i % 100 = 3) AS n_bad, count(*) FILTER (WHERE i % 100 <> 3) AS first_row FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderkey % 2 = 0) HAVING count(*) FILTER (WHERE i % 100 = 3) > 0"
for _r, _p, _c in (("E21", "mesh/cell_types", "9"), ("E22", "mesh/cells", "10"), ("E24", "mesh/cells", "11")):
    # cells of an unknown type have no node count to differ from
    ORACLE[f"rule_{_r.lower()}"] = f"WITH {_CELLS} " + _rule(_r, _p, f"cells WHERE cell % 50 = {_c}", "cell")
ORACLE["rule_e23"] = f"""WITH {_CELLS},
o AS (SELECT cell + 1 AS k, CASE WHEN cell % 500 = 250 THEN 1 ELSE 4 * (cell + 1) END AS v FROM cells UNION ALL SELECT 0, 0),
w AS (SELECT k, v, lag(v) OVER (ORDER BY k) AS b, k = max(k) OVER () AS last FROM o)
""" + _rule("E23", "mesh/cell_offsets", "w WHERE (b IS NULL AND v <> 0) OR v < b OR (last AND v <> 4 * (SELECT count(*) FROM cells))", "k")
ORACLE["rule_e34"] = _rule("E34", "line/node_arrays/profile", "nation WHERE n_nationkey = 4", "n_nationkey")
ORACLE["rule_w01"] = _rule("W01", "keys/split", "(SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_id % 5 = 0) > 1)", "user_id")
ORACLE["rule_w02"] = _rule("W02", "keys/status", "events WHERE event_type = 'error'", "event_id")
ORACLE["rule_w03"] = _rule("W03", "scalars/value", "events WHERE event_id % 333 IN (12, 13)", "event_id")
ORACLE["rule_w03_field"] = _rule("W03", "axis/node_arrays/embedding", "embeddings WHERE vec_id % 41 = 3 AND len(list_filter(embedding, lambda x: x <= 0)) > 0", "vec_id")
ORACLE["rule_w04"] = _rule("W04", "keys/quantity", "lineitem WHERE l_quantity < 5 OR l_quantity > 45", "l_orderkey * 8 + l_linenumber")
ORACLE["rule_w07"] = _rule("W07", "keys/nation", "nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 6 <> 5)", "n_nationkey")
ORACLE["rule_w08"] = f"SELECT 'W08' AS rule, 'keys/discount' AS path, count(*) AS n_bad, min(0)::BIGINT AS first_row FROM ({_WIDTH}) WHERE ratio > 4"
ORACLE["rule_w15"] = "SELECT 'W15' AS rule, 'supports' AS path, 1::BIGINT AS n_bad, 1::BIGINT AS first_row FROM (SELECT count(*) FROM orders)"
ORACLE["rule_w16"] = _rule("W16", "axis/node_arrays/embedding_band", "embeddings WHERE vec_id % 60 = 59", "vec_id")
ORACLE["nonfinite_first_three"] = "SELECT count(*) AS n_bad, array_to_string(list(event_id ORDER BY event_id)[1:3], ',') AS first_three FROM events WHERE event_id % 271 = 31"

ORACLE["rows_of_part"] = f"SELECT row FROM ({ORACLE['split_rows']}) WHERE part = 'test'"
ORACLE["legal_names"] = """
SELECT name, regexp_full_match(name, '[A-Za-z0-9_.+-]+') AND NOT starts_with(name, 'fieldloom_') AS legal, starts_with(name, 'fieldloom_') AS reserved, count(*) AS n
FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'fieldloom_' ELSE '' END || CASE p_size % 3 WHEN 0 THEN replace(p_type, ' ', '_') ELSE p_type END AS name FROM part) GROUP BY ALL"""
ORACLE["dimension_names"] = """
SELECT stored, CASE WHEN starts_with(stored, 'group_') AND len(stored) > 6 THEN 'group:' || stored[7:] WHEN regexp_full_match(stored, '(draw|component)_[0-9]+') THEN regexp_extract(stored, '^[a-z]+') ELSE stored END AS logical, count(*) AS n
FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'group_' || c_mktsegment WHEN 1 THEN 'draw_' || (c_custkey % 9)::VARCHAR WHEN 2 THEN 'component_' || (c_custkey % 5)::VARCHAR ELSE c_mktsegment END AS stored FROM customer) GROUP BY ALL"""
ORACLE["source_kinds"] = """
SELECT source, CASE WHEN source = 'data' THEN 'data' WHEN starts_with(source, 'callable:') AND len(source) > 9 THEN 'callable' END AS kind, CASE WHEN starts_with(source, 'callable:') AND len(source) > 9 THEN source[10:] END AS id, count(*) AS n
FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'callable:m' || (o_orderkey % 7)::VARCHAR WHEN 2 THEN 'callable:' ELSE 'file' END AS source FROM orders) GROUP BY ALL"""
ORACLE["utc_stamps"] = """
SELECT kind, count(*) FILTER (WHERE kind IN (0, 1)) AS n_utc, count(*) AS n FROM (SELECT event_id % 6 AS kind FROM events) GROUP BY kind"""
ORACLE["exact_texts"] = "SELECT l_orderkey * 8 + l_linenumber AS row, printf('%.17e', l_extendedprice::DOUBLE) AS text FROM lineitem"
_LIFTED = "pts AS (SELECT p_partkey AS node, p_partkey % 20 + p_size * 0.001::DOUBLE AS x, (p_partkey // 20)::DOUBLE AS y, p_size * 0.01::DOUBLE AS z FROM part)"
_SIDES = ", ".join(f"{q}.{c} - a.{c} AS {n}{c}" for q, n in (("b", "u"), ("c", "v"), ("d", "w")) for c in "xyz")
ORACLE["cell_measure_kinds"] = f"""
WITH {_LIFTED}, {_CELLS},
e AS (SELECT cell, {_SIDES} FROM cells JOIN pts a ON a.node = nodes[1] JOIN pts b ON b.node = nodes[2] JOIN pts c ON c.node = nodes[3] JOIN pts d ON d.node = nodes[4]),
x AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM e)
SELECT cell, 3 AS cell_type, round(sqrt(ux * ux + uy * uy + uz * uz), 9) AS measure FROM x
UNION ALL SELECT cell, 5, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 9) FROM x
UNION ALL SELECT cell, 10, round(abs(nx * wx + ny * wy + nz * wz) / 6, 9) FROM x"""


def _le(x: str, n: int) -> str:
    """Hexadecimal digits of a whole number's ``n`` bytes, the last one first."""
    return " || ".join(f"printf('%02x', ({x}) // {1 << 8 * k} % 256)" for k in range(n))


ORACLE["support_digest"] = f"""
WITH {_CELLS},
o AS (SELECT string_agg('09', '' ORDER BY cell) AS codes, '{"00" * 8}' || string_agg({_le("4 * place", 8)}, '' ORDER BY cell) AS offsets FROM (SELECT cell, row_number() OVER (ORDER BY cell) AS place FROM cells)),
c AS (SELECT string_agg({_le("node", 8)}, '' ORDER BY cell, corner) AS corners FROM (SELECT cell, unnest(nodes) AS node, unnest(range(1, 5)) AS corner FROM cells)),
n AS (SELECT {_le("n", 8)} AS nodes FROM (SELECT count(*) AS n FROM part))
SELECT 'mesh' AS support, sha256(unhex(nodes || codes || offsets || corners)) AS digest FROM n, o, c"""
