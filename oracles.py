"""DuckDB oracle SQL for the registered queries (see workloads.py).

Written independently of the Spark code path: plain SQL over the parquet views, with the
iterative queries unrolled into one CTE per iteration. Arithmetic is spelled in the same
order as the library's expressions so that doubles agree bit for bit before rounding.
"""

from __future__ import annotations

from workloads import (
    CONVERGE_EPSILON, HICARD_WEIGHTS, INIT_2D, IP_STRETCH, ITERATIONS, JOB_ITERATIONS, JOB_K, JOB_WEIGHTS, LINE_COLS, LOCAL_INIT_POSITIONS, CUSTOM_K, MANY_K, ORDERS_WEIGHTS,
    PART_K, PART_WEIGHTS, R,
)

SQRT2 = "sqrt(2.0)"


def dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# --- features: (name, kind, columns) in the order of workloads.PART_FEATURES --------------
PART = [("size", "numeric", ["p_size"]), ("price", "numeric", ["p_retailprice"]),
        ("type", "categorical", ["p_type"]), ("name", "categorical", ["p_name"])]
ORDERS = [("price", "numeric", ["o_totalprice"]), ("cust", "numeric", ["o_custkey"])]


def feature_dist(kind: str, columns: list[str], a: str, b: str) -> str:
    if kind == "numeric":
        sq = " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in columns)
        return f"(sqrt({sq}) / {SQRT2})"
    c = columns[0]
    return (f"(CAST(levenshtein({a}{c}, {b}{c}) AS DOUBLE) / "
            f"CAST(greatest(length({a}{c}), length({b}{c}), 1) AS DOUBLE))")


def element_dist(features, weights: dict, m: int, a: str, b: str) -> str:
    active = [f for f in features if f[1] == "numeric" or m != 0]
    terms = [f"({dbl(weights[n])} * {feature_dist(k, cs, a, b)})" for n, k, cs in active]
    total = terms[0]
    for t in terms[1:]:
        total = f"({total} + {t})"
    return f"({total} / {dbl(len(active))})"


def scaled(col: str, src: str, lim: str) -> str:
    return (f"CASE WHEN {lim}.mx_{col} = {lim}.mn_{col} THEN 0.0 "
            f"ELSE ({src}.{col} - {lim}.mn_{col}) / ({lim}.mx_{col} - {lim}.mn_{col}) END")


def limits_cte(name: str, src: str, columns: list[str]) -> str:
    aggs = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in columns)
    return f"{name} AS (SELECT {aggs} FROM {src})"


PART_EL = ("part_el AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_type, p_name "
           "FROM part)")


def part_pts_ctes() -> list[str]:
    return [PART_EL, limits_cte("part_lim", "part_el", ["p_size", "p_retailprice"]),
            "pts AS (SELECT e.id, " + ", ".join(f"{scaled(c, 'e', 'l')} AS {c}" for c in ["p_size", "p_retailprice"])
            + ", e.p_type, e.p_name FROM part_el e, part_lim l)"]


def orders_pts_ctes() -> list[str]:
    return ["ord_el AS (SELECT o_orderkey AS id, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders)",
            limits_cte("ord_lim", "ord_el", ["o_totalprice", "o_custkey"]),
            "pts AS (SELECT e.id, " + ", ".join(f"{scaled(c, 'e', 'l')} AS {c}" for c in ["o_totalprice", "o_custkey"])
            + " FROM ord_el e, ord_lim l)"]


def seeds_cte(name: str, k: int, src: str = "pts") -> str:
    h = "md5(CAST(id AS VARCHAR) || ':42')"
    return (f"{name} AS (SELECT * EXCLUDE (id, __rn) FROM (SELECT *, row_number() OVER (ORDER BY {h}, id) AS __rn, "
            f"CAST(row_number() OVER (ORDER BY {h}, id) - 1 AS INTEGER) AS cluster_id FROM {src}) WHERE __rn <= {k})")


def assign_cte(name: str, cents: str, dist: str, src: str = "pts") -> str:
    return (f"{name} AS (SELECT * EXCLUDE (__rn) FROM (SELECT p.*, c.cluster_id, {dist} AS dist, "
            f"row_number() OVER (PARTITION BY p.id ORDER BY {dist} ASC NULLS LAST, c.cluster_id DESC) AS __rn "
            f"FROM {src} p CROSS JOIN {cents} c) WHERE __rn = 1)")


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def mean_cte(name: str, assigned: str, numeric_cols: list[str]) -> str:
    means = ", ".join(f"sum({c}) / count(*) AS {c}" for c in numeric_cols)
    return f"{name} AS (SELECT cluster_id, {means} FROM {assigned} GROUP BY cluster_id)"


def medoid_ctes(i: int, assigned: str, col: str, m: int) -> tuple[list[str], str]:
    s, md = f"s_{col}{i}", f"md_{col}{i}"
    d = feature_dist("categorical", ["t"], "b.", "a.")
    return [
        f"{s} AS (SELECT cluster_id, {col} AS t, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS rn "
        f"FROM {assigned} QUALIFY rn <= {m})",
        f"{md} AS (SELECT cluster_id, t AS {col} FROM (SELECT a.cluster_id, a.rn, a.t, avg({d}) AS mu "
        f"FROM {s} a JOIN {s} b USING (cluster_id) GROUP BY a.cluster_id, a.rn, a.t) "
        f"QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(mu, 12), rn DESC) = 1)",
    ], md


def bytemean_ctes(i: int, assigned: str, col: str) -> tuple[list[str], str]:
    """ASCII terms: byte = ascii(char)."""
    tc, lim, by, bm = (f"{p}_{col}{i}" for p in ("tc", "lim", "by", "bm"))
    return [
        f"{tc} AS (SELECT cluster_id, {col} AS term, count(*) AS cnt FROM {assigned} GROUP BY cluster_id, {col})",
        f"{lim} AS (SELECT cluster_id, min(strlen(term)) AS L, sum(cnt) AS N FROM {tc} GROUP BY cluster_id)",
        f"{by} AS (SELECT cluster_id, pos, sum(ascii(substr(term, pos, 1)) * cnt) AS s, max(N) AS N FROM "
        f"(SELECT t.cluster_id, t.term, t.cnt, l.N, unnest(range(1, l.L + 1)) AS pos FROM {tc} t JOIN {lim} l "
        f"USING (cluster_id)) GROUP BY cluster_id, pos)",
        f"{bm} AS (SELECT l.cluster_id, coalesce(string_agg(chr(CAST(b.s // b.N AS INTEGER)), '' ORDER BY b.pos), '') "
        f"AS {col} FROM {lim} l LEFT JOIN {by} b USING (cluster_id) GROUP BY l.cluster_id)",
    ], bm


def kmeans_mixed_ctes(pts_ctes, features, weights, m: int, mode: str, k: int, iterations: int, first: list[str] | None = None,
                      keep: bool = False) -> list[str]:
    """CTEs up to c<iterations>; `first`: those that make c0; `keep`: an empty cluster keeps its centroid."""
    numeric_cols = [c for _, kind, cs in features if kind == "numeric" for c in cs]
    cat_cols = [cs[0] for _, kind, cs in features if kind == "categorical"] if m != 0 else []
    dist = element_dist(features, weights, m, "p.", "c.")
    ctes = list(pts_ctes) + (first or [seeds_cte("c0", k)])
    for i in range(1, iterations + 1):
        ctes.append(assign_cte(f"a{i}", f"c{i - 1}", dist))
        ctes.append(mean_cte(f"mean{i}", f"a{i}", numeric_cols))
        joins, picks = "", []
        for col in cat_cols:
            extra, name = (medoid_ctes(i, f"a{i}", col, m) if mode == "Standard" else bytemean_ctes(i, f"a{i}", col))
            ctes += extra
            joins += f" LEFT JOIN {name} USING (cluster_id)"
            picks.append(f"{name}.{col}")
        sel = ", ".join(["mean.cluster_id"] + [f"mean.{c}" for c in numeric_cols] + picks).replace("mean.", f"mean{i}.")
        if keep:
            cols = ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in numeric_cols)
            ctes.append(f"c{i} AS (SELECT o.cluster_id, {cols} FROM c{i - 1} o LEFT JOIN mean{i} n USING (cluster_id))")
        else:
            ctes.append(f"c{i} AS (SELECT {sel} FROM mean{i}{joins})")
    return ctes


def kmeans_mixed_sql(pts_ctes, features, weights, m: int, mode: str, k: int, iterations: int, first=None, keep=False) -> str:
    numeric_cols = [c for _, kind, cs in features if kind == "numeric" for c in cs]
    cat_cols = [cs[0] for _, kind, cs in features if kind == "categorical"] if m != 0 else []
    ctes = kmeans_mixed_ctes(pts_ctes, features, weights, m, mode, k, iterations, first, keep)
    out = ", ".join(["cluster_id"] + [f"round({c}, {R}) AS {c}" for c in numeric_cols] + cat_cols)
    return with_(ctes, f"SELECT {out} FROM c{iterations}")


def quality_ctes(features, weights, m: int, cents: str) -> list[str]:
    """fin: points assigned to the final centroids; st: size and radius; qr: the quality row."""
    return [assign_cte("fin", cents, element_dist(features, weights, m, "p.", "c.")),
            "st AS (SELECT cluster_id, count(*) AS n, avg(dist) AS radius FROM fin GROUP BY cluster_id)",
            f"qr AS (SELECT (SELECT count(*) FROM {cents}) AS num_centroids, (SELECT sum(n) FROM st)::BIGINT AS num_points, "
            f"(SELECT avg({element_dist(features, weights, m, 'a.', 'b.')}) FROM {cents} a JOIN {cents} b "
            "ON a.cluster_id < b.cluster_id) AS inter, (SELECT sum(radius * n) / sum(n) FROM st) AS intra)"]


def kmeans_2d_sql(pts_ctes, init_cte: str, iterations: int, src: str = "pts") -> str:
    dist = "sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y))"
    ctes = list(pts_ctes) + [init_cte]
    for i in range(1, iterations + 1):
        ctes.append(assign_cte(f"a{i}", f"c{i - 1}", dist, src))
        ctes.append(f"m{i} AS (SELECT cluster_id, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY cluster_id)")
        ctes.append(f"c{i} AS (SELECT o.cluster_id, coalesce(n.x, o.x) AS x, coalesce(n.y, o.y) AS y "
                    f"FROM c{i - 1} o LEFT JOIN m{i} n USING (cluster_id))")
    return with_(ctes, f"SELECT cluster_id, round(x, {R}) AS x, round(y, {R}) AS y FROM c{iterations}")


def line_2d_ctes() -> list[str]:
    return ["l_el AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)",
            limits_cte("l_lim", "l_el", ["x", "y"]),
            "pts AS (SELECT row_number() OVER () AS id, " + scaled("x", "e", "l") + " AS x, "
            + scaled("y", "e", "l") + " AS y FROM l_el e, l_lim l)"]


def orders_2d_ctes() -> list[str]:
    return orders_pts_ctes() + ["pts2 AS (SELECT id, o_totalprice AS x, o_custkey AS y FROM pts)"]


def fixed_init(points) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS cluster_id, {dbl(x)} AS x, {dbl(y)} AS y" for i, (x, y) in enumerate(points))
    return f"c0 AS ({rows})"


# --- IPv4 ------------------------------------------------------------------------------
def orders_ip(a: str, b: str) -> str:
    return (f"concat_ws('.', CAST({a} % 256 AS VARCHAR), CAST({b} % 256 AS VARCHAR), "
            f"CAST(({a} // 256) % 256 AS VARCHAR), CAST(({b} // 7) % 256 AS VARCHAR))")


def ip_sim(x: str, y: str) -> str:
    o = lambda s, i: f"CAST(split_part({s}, '.', {i}) AS INTEGER)"
    branches = " ".join(
        f"WHEN {o(x, i + 1)} <> {o(y, i + 1)} THEN {dbl(i)} + (1.0 - CAST(abs({o(x, i + 1)} - {o(y, i + 1)}) AS DOUBLE) / 256.0)"
        for i in range(4))
    return f"((CASE {branches} ELSE 4.0 END) / 4.0)"


def _list_sum(expr_of_i: str, n: str) -> str:
    return f"list_sum(list_transform(range(1, {n} + 1), lambda i: {expr_of_i}))"


EMB = ("e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
       "pr AS (SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)")
N = "least(len(v), len(w))"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["coord_limits"] = "SELECT " + ", ".join(f"min({c}) + 0.0 AS min_{c}, max({c}) + 0.0 AS max_{c}" for c in LINE_COLS) + " FROM lineitem"
    lim = limits_cte("lim", "lineitem", LINE_COLS)
    q["minmax_scale"] = with_([lim], "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round({scaled(c, 'lineitem', 'lim')}, 9) AS {c}" for c in LINE_COLS) + " FROM lineitem, lim")
    q["unscale_roundtrip"] = with_([lim], "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({scaled(c, 'lineitem', 'lim')}) * (lim.mx_{c} - lim.mn_{c}) + lim.mn_{c}, {R}) AS {c}"
        for c in LINE_COLS) + " FROM lineitem, lim")

    ip_num = ("CAST((user_id % 256) * 16777216 + (event_id % 256) * 65536 + ((event_id // 256) % 256) * 256 + 7 "
              "AS DOUBLE)")
    feat = {
        "id": "CAST(event_id AS VARCHAR)",
        "time": "CAST(epoch_us(ts) // 1000 AS DOUBLE)",
        "size": "CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END",
        "long": "CAST(user_id AS DOUBLE)",
        "lat": "CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value * 2 END",
        "ip": f"CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE {ip_num} END",
        "bot": "CASE WHEN event_type = 'error' THEN '0.0' WHEN event_type = 'view' THEN '_' ELSE event_type END",
        "uri": ("CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN '_' "
                "ELSE 'http://h' || CAST(user_id AS VARCHAR) || '.example/a' END"),
    }
    q["json_featurize"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in feat.items()) + " FROM events"
    q["json_featurize_reduced"] = "SELECT " + ", ".join(f"{feat[k]} AS {k}" for k in ("id", "time", "long", "lat")) + " FROM events"
    q["json_defaults"] = (
        "SELECT CASE WHEN event_id % 3 = 0 THEN '0' ELSE json_extract_string(props, '$.k') END AS id_text, "
        "CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS time, "
        "CAST(0.0 AS DOUBLE) AS long, CAST(0.0 AS DOUBLE) AS lat FROM events")

    ipa = orders_ip("o_orderkey", "o_custkey")
    q["ip_to_long"] = (
        f"WITH t AS (SELECT o_orderkey, {ipa} AS ip FROM orders) SELECT o_orderkey, "
        "CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + "
        "CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS ip_num FROM t")
    n = "((o_orderkey * 2654435761 + o_custkey) % 4294967296)"
    q["long_to_ip"] = ("SELECT o_orderkey, concat_ws('.', " + ", ".join(
        f"CAST(({n} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0)) + ") AS ip_text FROM orders")
    ipb, ipc = orders_ip("o_custkey", "o_orderkey"), orders_ip("o_orderkey", "o_orderkey")
    q["ip_set_similarity"] = with_([
        f"base AS (SELECT o_orderkey, {ipa} AS ia, {ipb} AS ib, {ipc} AS ic FROM orders)",
        "sets AS (SELECT o_orderkey, ia, ib, list_distinct(CASE WHEN o_orderkey % 3 = 0 THEN [ia] ELSE [ia, ib] END) AS s1, "
        "list_distinct([ib, ic]) AS s2 FROM base)",
        "p1 AS (SELECT o_orderkey, s2, unnest(s1) AS x FROM sets)",
        "p2 AS (SELECT o_orderkey, x, unnest(s2) AS y FROM p1)",
        f"acc AS (SELECT o_orderkey, sum({ip_sim('x', 'y')}) AS acc FROM p2 GROUP BY o_orderkey)",
    ], f"SELECT s.o_orderkey, round({ip_sim('s.ia', 's.ib')}, 9) AS ip_sim, "
       "round((a.acc / len(s.s1) + a.acc / len(s.s2)) / 2.0, 9) AS set_sim, "
       "round(a.acc / (len(s.s1) * len(s.s2)), 9) AS set_sim_norm FROM sets s JOIN acc a USING (o_orderkey)")

    q["ip_set_similarity_large"] = with_([
        f"base AS (SELECT CAST(floor(o_orderkey / {IP_STRETCH}) AS BIGINT) AS stretch, {ipa} AS ia, {ipb} AS ib FROM orders)",
        "s1 AS (SELECT DISTINCT stretch, ia FROM base)", "s2 AS (SELECT DISTINCT stretch, ib FROM base)",
        f"acc AS (SELECT stretch, sum({ip_sim('ia', 'ib')}) AS acc, count(DISTINCT ia) AS na, count(DISTINCT ib) AS nb FROM s1 JOIN s2 USING (stretch) GROUP BY stretch)",
    ], "SELECT stretch, round((acc / na + acc / nb) / 2.0, 6) AS set_sim, round(acc / (na * nb), 9) AS set_sim_norm FROM acc")

    dot = _list_sum("v[i] * w[i]", N)
    norm = lambda a: f"sqrt({_list_sum(f'{a}[i] * {a}[i]', f'len({a})')})"
    q["vec_algebra"] = (f"WITH {EMB} SELECT vec_id, "
                        f"round({_list_sum('v[i] + w[i]', N)}, {R}) AS sum_add, "
                        f"round({_list_sum('v[i] - w[i]', N)}, {R}) AS sum_sub, "
                        f"round(list_sum(list_transform(v, lambda x: x / 2.0)), {R}) AS sum_half, "
                        f"round({dot}, {R}) AS dot, round({norm('v')}, {R}) AS norm, "
                        f"round(list_sum(list_transform(v, lambda x: abs(x))), {R}) AS sum_abs, CAST(len(v) AS INTEGER) AS dim, "
                        f"round({_list_sum('CASE WHEN v[i] > w[i] THEN v[i] ELSE w[i] END', N)}, {R}) AS sum_max, "
                        f"round({_list_sum('CASE WHEN v[i] < w[i] THEN v[i] ELSE w[i] END', N)}, {R}) AS sum_min, "
                        f"CAST({N} AS INTEGER) AS zip_len FROM pr")
    q["vec_weighted_dot"] = (f"WITH {EMB} SELECT vec_id, "
                             f"round({_list_sum('v[i] * CAST((i - 1) % 2 AS DOUBLE) * w[i]', N)}, {R}) AS wdot FROM pr")
    diff2 = _list_sum("(v[i] - w[i]) * (v[i] - w[i])", N)
    q["dist_euclidean"] = f"WITH {EMB} SELECT vec_id, round(sqrt({diff2}), {R}) AS dist FROM pr"
    q["dist_manhattan"] = f"WITH {EMB} SELECT vec_id, round({_list_sum('abs(v[i] - w[i])', N)}, {R}) AS dist FROM pr"
    q["dist_cosine"] = (f"WITH {EMB} SELECT vec_id, round(CASE WHEN {norm('v')} * {norm('w')} <> 0 "
                        f"THEN 1.0 - {dot} / ({norm('v')} * {norm('w')}) END, {R}) AS dist FROM pr")
    q["point_algebra"] = with_([
        "o AS (SELECT o_orderkey, o_totalprice / 1000 AS x, CAST(o_custkey AS DOUBLE) AS y, o_totalprice FROM orders)",
        "p AS (SELECT a.*, b.x AS b_x, b.y AS b_y FROM o a JOIN o b ON b.o_orderkey = a.o_orderkey + 1)",
    ], f"SELECT o_orderkey, round(x + b_x, {R}) AS add_x, round(y + b_y, {R}) AS add_y, round(x - b_x, {R}) AS sub_x, "
       f"round(y - b_y, {R}) AS sub_y, round(-x + 0.0, {R}) AS neg_x, round(-y + 0.0, {R}) AS neg_y, round(x / 4.0, 9) AS div_x, "
       f"round(y / 4.0, 9) AS div_y, round(sqrt(x * x + y * y), {R}) AS magnitude, "
       f"round(sqrt((b_x - x) * (b_x - x) + (b_y - y) * (b_y - y)), {R}) AS distance, "
       "printf('(%.2f - %.2f)', o_totalprice, y) AS text FROM p")

    q["lev"] = "SELECT p_partkey, CAST(levenshtein(p_type, p_name) AS INTEGER) AS lev FROM part"
    q["lev_norm"] = (f"SELECT p_partkey, round({feature_dist('categorical', ['x'], 'p_type_', 'p_name_')}, 9) "
                     "AS lev_norm FROM (SELECT p_partkey, p_type AS p_type_x, p_name AS p_name_x FROM part)")
    q["longest_term"] = (
        "WITH t AS (SELECT p_brand, CASE WHEN length(p_type) > length(p_name) THEN p_type ELSE p_name END AS longer, "
        "CASE WHEN length(p_type) < length(p_name) THEN p_type ELSE p_name END AS shorter FROM part) "
        "SELECT p_brand, first(longer ORDER BY length(longer) DESC, longer DESC) AS longest, "
        "first(shorter ORDER BY length(shorter) ASC, shorter ASC) AS shortest FROM t GROUP BY p_brand")
    q["utf8_bytes"] = (
        "WITH t AS (SELECT p_partkey, p_name || ' ' || p_brand AS s FROM part) SELECT p_partkey, "
        "array_to_string(list_transform(range(1, strlen(s) + 1), lambda i: ascii(substr(s, i, 1))), ',') AS bytes, "
        "CAST(strlen(s) AS INTEGER) AS n_bytes FROM t")

    pairs = part_pts_ctes() + ["pp AS (SELECT a.id AS a_id, a.p_size AS a_p_size, a.p_retailprice AS a_p_retailprice, "
                               "a.p_type AS a_p_type, a.p_name AS a_p_name, b.p_size AS b_p_size, "
                               "b.p_retailprice AS b_p_retailprice, b.p_type AS b_p_type, b.p_name AS b_p_name "
                               "FROM pts a JOIN pts b ON b.id = a.id + 1)"]
    q["feature_distance"] = with_(pairs, "SELECT a_id AS id, " + ", ".join(
        f"round({feature_dist(k, cs, 'a_', 'b_')}, 9) AS d_{n}" for n, k, cs in PART) + " FROM pp")
    q["element_distance"] = with_(pairs, f"SELECT a_id AS id, round({element_dist(PART, PART_WEIGHTS, 1, 'a_', 'b_')}, 9) "
                                         f"AS dist_mixed, round({element_dist(PART, PART_WEIGHTS, 0, 'a_', 'b_')}, 9) "
                                         "AS dist_numeric FROM pp")
    q["render_elements"] = with_(part_pts_ctes(), (
        "SELECT id, chr(10) || '[ID: ' || CAST(id AS VARCHAR) || chr(10) || chr(9) || 'Numeric: List(size: ' || "
        "printf('%.4f  ', p_size) || ', price: ' || printf('%.4f  ', p_retailprice) || ')' || chr(10) || chr(9) || "
        "'Categs: List(type:' || p_type || ', name:' || p_name || ')]' AS text FROM pts"))

    q["seed_sample"] = with_(part_pts_ctes() + [
        "s AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS rn FROM pts)"],
        f"SELECT CAST(rn - 1 AS INTEGER) AS cluster_id, id FROM s WHERE rn <= {PART_K}")
    q["suggest_k"] = ("SELECT count(*) AS n, CAST(greatest(floor(sqrt(count(*) / 2.0)), 1) AS BIGINT) AS k FROM part")
    mixed = element_dist(PART, PART_WEIGHTS, 1, "p.", "c.")
    q["assign_nearest"] = with_(part_pts_ctes() + [seeds_cte("c0", PART_K), assign_cte("a", "c0", mixed)],
                                "SELECT id, cluster_id, round(dist, 9) AS distance FROM a")
    d2 = "sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y))"
    q["assign_nearest_2d"] = with_(orders_2d_ctes() + [seeds_cte("c0", 5, "pts2"), assign_cte("a", "c0", d2, "pts2")],
                                   "SELECT id, cluster_id FROM a")

    q["kmeans_standard"] = kmeans_mixed_sql(part_pts_ctes(), PART, PART_WEIGHTS, 3, "Standard", PART_K, ITERATIONS)
    q["kmeans_standard_first"] = kmeans_mixed_sql(part_pts_ctes(), PART, PART_WEIGHTS, 1, "Standard", PART_K, ITERATIONS)
    q["kmeans_partialsums"] = kmeans_mixed_sql(part_pts_ctes(), PART, PART_WEIGHTS, 1, "PartialSums", PART_K, ITERATIONS)
    q["kmeans_numeric_only"] = kmeans_mixed_sql(orders_pts_ctes(), ORDERS, ORDERS_WEIGHTS, 0, "Standard", 5, ITERATIONS)
    q["kmeans2d_step"] = kmeans_2d_sql(line_2d_ctes(), fixed_init(INIT_2D), 1)
    q["kmeans2d_run"] = q["kmeans2d_cells"] = kmeans_2d_sql(line_2d_ctes(), fixed_init(INIT_2D), ITERATIONS)
    pos = ", ".join(str(p) for p in LOCAL_INIT_POSITIONS)
    init = ("c0 AS (SELECT CAST(list_position([" + pos + "], CAST(rn - 1 AS INTEGER)) - 1 AS INTEGER) AS cluster_id, x, y "
            "FROM (SELECT x, y, row_number() OVER (ORDER BY id) AS rn FROM pts2) WHERE rn - 1 IN (" + pos + "))")
    q["kmeans2d_local_init"] = kmeans_2d_sql(orders_2d_ctes(), init, ITERATIONS, "pts2")

    ev = part_pts_ctes() + [seeds_cte("c0", PART_K), assign_cte("a", "c0", mixed),
                            "st AS (SELECT cluster_id, count(*) AS n, avg(dist) AS radius FROM a GROUP BY cluster_id)",
                            "pairs AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, "
                            + element_dist(PART, PART_WEIGHTS, 1, "a.", "b.")
                            + " AS distance FROM c0 a JOIN c0 b ON a.cluster_id < b.cluster_id)"]
    q["cluster_radius"] = with_(ev, "SELECT cluster_id, n, round(radius, 9) AS radius FROM st")
    q["inter_distance"] = with_(ev, "SELECT cluster_a, cluster_b, round(distance, 9) AS distance FROM pairs "
                                    "UNION ALL SELECT -1, -1, round(avg(distance), 9) FROM pairs")
    q["cluster_quality"] = with_(ev, f"SELECT CAST({PART_K} AS INTEGER) AS num_centroids, "
                                     "CAST((SELECT sum(n) FROM st) AS BIGINT) AS num_points, CAST(0 AS INTEGER) AS num_iterations, "
                                     "round((SELECT avg(distance) FROM pairs), 9) AS inter_avg_distance, "
                                     "round((SELECT sum(radius * n) / sum(n) FROM st), 9) AS intra_avg_distance")

    u = lambda s: (f"CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':{s}:42'), 1, 8)) AS BIGINT)"  # noqa: E731
                   " / 4294967296.0 * 10.0")
    # --- ingest with faults
    late = {**feat, "ip": f"CASE WHEN event_id % 31 = 4 THEN 0.0 ELSE {feat['ip']} END"}
    kept = "event_id % 17 <> 0 AND event_id % 19 <> 1"
    odd = "(event_id % 23 = 2 OR event_id % 29 = 3)"
    q["json_lines_scan"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in late.items()) + f" FROM events WHERE {kept} AND NOT {odd}"
    q["json_rejects"] = (
        "SELECT 'line' AS kind, 'not json ' || CAST(event_id AS VARCHAR) AS text FROM events WHERE event_id % 17 <> 0 AND event_id % 19 = 1 "
        f"UNION ALL SELECT 'values', CAST(event_id AS VARCHAR) FROM events WHERE {kept} AND {odd}")

    # --- addresses that are short or none
    start = "CAST(o_orderkey % 256 AS VARCHAR) || '.' || CAST(o_custkey % 3 AS VARCHAR)"
    nums = lambda s: f"list_transform(string_split(regexp_replace({s}, '\\.+$', ''), '.'), lambda p: TRY_CAST(p AS INTEGER))"
    n2 = "least(len(a), len(b))"
    sim = (f"CASE WHEN len(list_filter(range(1, {n2} + 1), lambda i: a[i] IS NULL OR b[i] IS NULL)) > 0 THEN NULL "
           f"ELSE (coalesce(list_min(list_transform(list_filter(range(1, {n2} + 1), lambda i: a[i] <> b[i]), lambda i: i - 1)), {n2}) "
           f"+ CASE WHEN len(list_filter(range(1, {n2} + 1), lambda i: a[i] <> b[i])) > 0 THEN 1.0 - CAST(abs("
           f"a[list_filter(range(1, {n2} + 1), lambda i: a[i] <> b[i])[1]] - b[list_filter(range(1, {n2} + 1), lambda i: a[i] <> b[i])[1]]) "
           "AS DOUBLE) / 256.0 ELSE 0.0 END) / 4.0 END")
    q["ip_similarity_edges"] = with_([
        f"t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {start} WHEN 1 THEN '_' WHEN 2 THEN {start} || '.' "
        f"WHEN 3 THEN {start} || '.x.1' ELSE {ipa} END AS x, CASE WHEN o_custkey % 4 = 0 THEN {ipa} ELSE {ipc} END AS y FROM orders)",
        f"one AS (SELECT o_orderkey, {sim} AS s FROM (SELECT o_orderkey, {nums('x')} AS a, {nums('y')} AS b FROM t))",
        "member AS (SELECT o_orderkey, y, unnest(list_distinct([x, y])) AS m FROM t)",
        f"each AS (SELECT o_orderkey, {sim} AS s FROM (SELECT o_orderkey, {nums('m')} AS a, {nums('y')} AS b FROM member))",
        "total AS (SELECT o_orderkey, CASE WHEN count(*) = count(s) THEN sum(s) END AS acc, count(*) AS n FROM each GROUP BY o_orderkey)",
    ], "SELECT o_orderkey, round(one.s, 9) AS ip_sim, round((acc / n + acc / 1.0) / 2.0, 9) AS set_sim FROM one JOIN total USING (o_orderkey)")

    # --- many centroids; distances that are NULL
    q["assign_k300"] = with_(part_pts_ctes() + [seeds_cte("c0", MANY_K), assign_cte("a", "c0", mixed)],
                             "SELECT id, cluster_id, round(dist, 9) AS distance FROM a")
    share = "(CAST(abs(length(p.p_name) - length(c.p_name)) AS DOUBLE) / CAST(greatest(length(p.p_name), length(c.p_name), 1) AS DOUBLE))"
    own = f"(((0.5 * {feature_dist('numeric', ['p_size'], 'p.', 'c.')}) + (0.5 * {share})) / 2.0)"
    q["assign_custom_distance"] = with_(part_pts_ctes() + [seeds_cte("c0", CUSTOM_K), assign_cte("a", "c0", own)],
                                        "SELECT id, cluster_id, round(dist, 9) AS distance FROM a")
    ctes = [*orders_pts_ctes(), seeds_cte("c0", 5)]
    for i in range(1, ITERATIONS + 1):
        ctes += [assign_cte(f"a{i}", f"c{i - 1}", element_dist(ORDERS, ORDERS_WEIGHTS, 0, "p.", "c.")),
                 f"c{i} AS (SELECT cluster_id, (min(o_totalprice) + max(o_totalprice)) / 2 AS o_totalprice, (min(o_custkey) + max(o_custkey)) / 2 AS o_custkey FROM a{i} GROUP BY cluster_id)"]
    q["kmeans_custom_update"] = with_(ctes, f"SELECT cluster_id, round(o_totalprice, 6) AS o_totalprice, round(o_custkey, 6) AS o_custkey FROM c{ITERATIONS}")
    q["coord_reducers"] = "SELECT " + ", ".join(f"min({c}) AS min_{c}, max({c}) - min({c}) AS spread_{c}, count({c}) AS known_{c}" for c in ("o_totalprice", "o_custkey")) + " FROM orders"
    q["run_trials"] = ("SELECT 't' || CAST(o_custkey % 5 AS VARCHAR) AS trial, count(*) FILTER (o_orderkey % 3 <> 0) AS jobs, "
                       "sum(floor(o_totalprice)) FILTER (o_orderkey % 3 <> 0) AS total_seconds "
                       "FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
    den = "(sqrt(p.x * p.x + p.y * p.y) * sqrt(c.x * c.x + c.y * c.y))"
    pair = [*orders_pts_ctes(), seeds_cte("s4", 4),
            "c0 AS (SELECT cluster_id, o_totalprice AS x, o_custkey AS y FROM s4 UNION ALL SELECT 4, 0.0, 0.0)",
            "pp AS (SELECT id, o_totalprice AS x, CASE WHEN id % 97 <> 0 THEN o_custkey END AS y FROM pts)"]
    for name, d in (("cosine", f"CASE WHEN {den} <> 0 THEN 1.0 - (p.x * c.x + p.y * c.y) / {den} END"),
                    ("manhattan", "(abs(p.x - c.x) + abs(p.y - c.y))")):
        q[f"assign_{name}"] = with_(pair + [assign_cte("a", "c0", f"((1.0 * (({d}) / {SQRT2})) / 1.0)", "pp")],
                                    "SELECT id, CASE WHEN dist IS NOT NULL THEN cluster_id END AS cluster_id, round(dist, 9) + 0.0 AS distance FROM a")

    hicard = orders_pts_ctes()[:2] + ["pts AS (SELECT e.id, " + scaled("o_totalprice", "e", "l") + " AS o_totalprice, 'o' || CAST(e.id * 7919 % 1000003 "
                                      "AS VARCHAR) || '-' || CAST(e.id AS VARCHAR) AS tag FROM ord_el e, ord_lim l)"]
    q["kmeans_partialsums_hicard"] = kmeans_mixed_sql(hicard, [("price", "numeric", ["o_totalprice"]), ("tag", "categorical", ["tag"])],
                                                      HICARD_WEIGHTS, 1, "PartialSums", 5, 2)
    twice = [seeds_cte("s5", 5), "c0 AS (SELECT cluster_id, o_totalprice, o_custkey FROM s5 UNION ALL SELECT 5, o_totalprice, o_custkey FROM s5 WHERE cluster_id = 0)"]
    q["kmeans_keep_empty"] = kmeans_mixed_sql(orders_pts_ctes(), ORDERS, ORDERS_WEIGHTS, 0, "Standard", 5, ITERATIONS, twice, keep=True)

    most = 25  # iterations spelled out; the run must stop before
    conv = orders_2d_ctes() + [fixed_init(INIT_2D)]
    for i in range(1, most + 1):
        conv += [assign_cte(f"a{i}", f"c{i - 1}", d2, "pts2"),
                 f"m{i} AS (SELECT cluster_id, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY cluster_id)",
                 f"c{i} AS MATERIALIZED (SELECT o.cluster_id, coalesce(n.x, o.x) AS x, coalesce(n.y, o.y) AS y, "
                 f"sqrt((coalesce(n.x, o.x) - o.x) * (coalesce(n.x, o.x) - o.x) + (coalesce(n.y, o.y) - o.y) * (coalesce(n.y, o.y) - o.y)) AS mv "
                 f"FROM c{i - 1} o LEFT JOIN m{i} n USING (cluster_id))"]
    conv.append("steps AS (" + " UNION ALL ".join(f"SELECT {i} AS it, cluster_id, x, y, mv FROM c{i}" for i in range(1, most + 1)) + ")")
    conv.append(f"last AS (SELECT min(it) AS it FROM (SELECT it, max(mv) AS mv FROM steps GROUP BY it) WHERE mv <= {dbl(CONVERGE_EPSILON)})")
    q["kmeans2d_converge"] = with_(conv, f"SELECT it AS iterations, cluster_id, round(x, {R}) AS x, round(y, {R}) AS y, round(mv, {R}) AS movement "
                                         "FROM steps JOIN last USING (it)")

    # --- the full job
    spam = [("time", "numeric", ["time"]), ("size", "numeric", ["size"]), ("space", "numeric", ["long", "lat"]),
            ("IP", "numeric", ["ip"]), ("bot", "categorical", ["bot"]), ("uri", "categorical", ["uri"])]
    weights = {**{k: v for k, v in JOB_WEIGHTS.items() if k != "botname"}, "bot": JOB_WEIGHTS["botname"]}
    numbers = ["time", "size", "long", "lat", "ip"]
    job_pts = ["el AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in feat.items()) + " FROM events)", limits_cte("lim", "el", numbers),
               "pts AS (SELECT e.id, " + ", ".join(f"{scaled(c, 'e', 'l')} AS {c}" for c in numbers) + ", e.bot, e.uri FROM el e, lim l)"]
    back = lambda c, t="c": f"({t}.{c} * (l.mx_{c} - l.mn_{c}) + l.mn_{c})"
    shown = f"round({back('time')} / 1000, 1) AS time, " + ", ".join(f"round({back(c)}, 2) AS {c}" for c in numbers[1:])
    for name, mode, m in (("standard", "Standard", 3), ("partialsums", "PartialSums", 1)):
        q[f"full_job_{name}"] = with_(kmeans_mixed_ctes(job_pts, spam, weights, m, mode, JOB_K, JOB_ITERATIONS),
                                      f"SELECT cluster_id, {shown}, bot, uri FROM c{JOB_ITERATIONS} c, lim l")
    job = kmeans_mixed_ctes(job_pts, spam, weights, 1, "Standard", JOB_K, JOB_ITERATIONS) + quality_ctes(spam, weights, 1, f"c{JOB_ITERATIONS}")
    q["full_job_resumed"] = q["full_job_standard"]
    q["full_job_quality"] = with_(job, "SELECT 'inter' AS item, num_centroids AS n, round(inter, 9) AS value FROM qr "
                                       "UNION ALL SELECT 'intra', num_points, round(intra, 9) FROM qr "
                                       "UNION ALL SELECT 'radius ' || CAST(cluster_id AS VARCHAR), n, round(radius, 9) FROM st "
                                       "UNION ALL SELECT 'assigned ' || CAST(cluster_id AS VARCHAR), n, NULL FROM st")

    # --- run logs
    def run(mode: str) -> list[str]:
        return (kmeans_mixed_ctes(part_pts_ctes(), PART, PART_WEIGHTS, 1, mode, PART_K, JOB_ITERATIONS)
                + quality_ctes(PART, PART_WEIGHTS, 1, f"c{JOB_ITERATIONS}"))

    text = (f"SELECT c.cluster_id, unnest(['', '[ID: centroid', chr(9) || 'Numeric: List(size: ' || printf('%.4f  ', {back('p_size')}) || ', price: ' || "
            f"printf('%.4f  ', {back('p_retailprice')}) || ')', chr(9) || 'Categs: List(type:' || p_type || ', name:' || p_name || ')]']) AS value "
            f"FROM c{JOB_ITERATIONS} c, part_lim l")
    lines = [("qr", "'Num of centroids:' || chr(9) || CAST(num_centroids AS VARCHAR)"), ("qr", "'Num of points:' || chr(9) || chr(9) || CAST(num_points AS VARCHAR)"),
             ("qr", f"'Num of Iteration:' || chr(9) || '{JOB_ITERATIONS}'"), ("qr", f"'Num of Iteration:' || chr(9) || '{JOB_ITERATIONS}'"),
             ("qr", "'Inter Avg Distance' || chr(9) || printf('%3f', inter)"), ("qr", "'Intra Avg Distance:' || chr(9) || printf('%3f', intra)"),
             ("qr", "'Num' || chr(9) || '->' || chr(9) || 'Avg Radius'"), ("qr", "'Begin QUALITY ' || repeat('-', 100)"), ("qr", "'End QUALITY ' || repeat('-', 100)"),
             ("cl", "value"), ("cl JOIN st USING (cluster_id)", "value"), ("st", "CAST(n AS VARCHAR) || chr(9) || '->' || chr(9) || printf('%3f', radius)")]
    q["run_report"] = with_(run("PartialSums") + [f"cl AS ({text})"], " UNION ALL ".join(f"SELECT {v} AS value FROM {t}" for t, v in lines))
    one_run = lambda mode: "(" + with_(run(mode), f"SELECT '{mode.lower()}' AS trial, * FROM qr") + ")"
    q["run_compare"] = (f"SELECT trial, num_centroids, num_points, CAST({JOB_ITERATIONS} AS INTEGER) AS num_iterations, round(inter, 6) AS inter_avg_distance, "
                        f"round(intra, 6) AS intra_avg_distance FROM ({one_run('PartialSums')} UNION ALL {one_run('Standard')})")
    q["random_points"] = f"SELECT o_orderkey, round({u('x')}, 9) AS x, round({u('y')}, 9) AS y FROM orders"
    q["points_text_scan"] = "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem"
    return q

