"""Boosted trees of a few rounds as DuckDB text: every level is one histogram and one choice of split per node."""


def boosted(rows: str, features: int, rounds: int, depth: int, rate: float | str) -> str:
    """CTEs over ``rows(product, r, y, x)``: ``code``, ``base``, ``fitted(product, r, yhat)``, ``splits``, ``leaves``.

    Nodes are numbered as in a heap (1, then 2 and 3, ...).  Gains are rounded as the fit rounds them, so that
    equal ones are equal; the first feature and the lowest value win.  ``rate`` is a number, or the name of a
    relation ``(product, rate)``.
    """
    rate = rate if isinstance(rate, str) else f"(SELECT DISTINCT product, CAST({rate} AS DOUBLE) AS rate FROM {rows})"
    out = [
        f"""x_long AS MATERIALIZED (SELECT product, r, unnest(range(0, {features})) AS j, unnest(x) AS v FROM {rows}),
code AS MATERIALIZED (SELECT product, r, j, v, dense_rank() OVER (PARTITION BY product, j ORDER BY v) - 1 AS b FROM x_long),
edge AS MATERIALIZED (SELECT product, j, b, (v + lead(v) OVER (PARTITION BY product, j ORDER BY b)) / 2 AS cut FROM (SELECT DISTINCT product, j, b, v FROM code)),
base AS MATERIALIZED (SELECT product, avg(y) AS base, greatest(sum(y * y) - sum(y) * sum(y) / count(*), 1e-300) AS ss FROM {rows} GROUP BY 1),
e_0 AS MATERIALIZED (SELECT product, r, y - base AS e FROM {rows} JOIN base USING (product))"""
    ]
    splits, leaves = [], []
    for t in range(rounds):
        out.append(f"n_{t}_0 AS (SELECT product, r, e, 1 AS node FROM e_{t})")
        for level in range(depth):
            n, s = f"n_{t}_{level}", f"s_{t}_{level}"
            out.append(
                f"""{s} AS MATERIALIZED (
 WITH h AS (SELECT n.product, node, j, b, count(*) AS c, sum(e) AS g FROM {n} n JOIN code ON code.product = n.product AND code.r = n.r WHERE node >= {2**level} GROUP BY ALL),
 u AS (SELECT *, sum(c) OVER w AS cl, sum(g) OVER w AS gl, sum(c) OVER a AS ca, sum(g) OVER a AS ga FROM h
       WINDOW w AS (PARTITION BY product, node, j ORDER BY b), a AS (PARTITION BY product, node, j)),
 k AS (SELECT u.*, round((gl * gl / (cl + 1) + (ga - gl) * (ga - gl) / (ca - cl + 1) - ga * ga / (ca + 1)) / ss, 9) AS gain FROM u JOIN base USING (product) WHERE cl < ca)
 SELECT {t} AS t, k.product, node, k.j, k.b, edge.cut, gain, cl, ca FROM k JOIN edge USING (product, j, b) WHERE gain > 0
 QUALIFY row_number() OVER (PARTITION BY k.product, node ORDER BY gain DESC, k.j, k.b) = 1)"""
            )
            splits.append(f"SELECT * FROM {s}")
            out.append(
                f"""n_{t}_{level + 1} AS MATERIALIZED (SELECT n.product, n.r, e, CASE WHEN s.j IS NULL THEN n.node WHEN code.b <= s.b THEN 2 * n.node ELSE 2 * n.node + 1 END AS node
 FROM {n} n LEFT JOIN {s} s ON s.product = n.product AND s.node = n.node LEFT JOIN code ON code.product = n.product AND code.r = n.r AND code.j = s.j)"""
            )
        out.append(f"v_{t} AS MATERIALIZED (SELECT {t} AS t, n.product, node, count(*) AS cover, any_value(q.rate) * sum(e) / (count(*) + 1) AS value FROM n_{t}_{depth} n JOIN {rate} q ON q.product = n.product GROUP BY 2, 3)")
        leaves.append(f"SELECT * FROM v_{t}")
        out.append(f"e_{t + 1} AS MATERIALIZED (SELECT n.product, n.r, e - value AS e FROM n_{t}_{depth} n JOIN v_{t} v ON v.product = n.product AND v.node = n.node)")
    out.append(f"fitted AS (SELECT o.product, o.r, o.y - e AS yhat FROM {rows} o JOIN e_{rounds} USING (product, r))")
    out.append("splits AS (" + " UNION ALL ".join(splits) + ")")
    out.append("leaves AS (" + " UNION ALL ".join(leaves) + ")")
    return ",\n".join(out)


#: Trees of depth 2 as one struct per round, in a list per product; ``leaf_of`` scores one of them.
DEEP_TWO = """nodes AS (SELECT product, t, max(CASE node WHEN 1 THEN j END) AS j1, max(CASE node WHEN 2 THEN j END) AS j2, max(CASE node WHEN 3 THEN j END) AS j3,
  max(CASE node WHEN 1 THEN cut END) AS a1, max(CASE node WHEN 2 THEN cut END) AS a2, max(CASE node WHEN 3 THEN cut END) AS a3 FROM splits GROUP BY ALL),
ends AS (SELECT product, t, list(value ORDER BY node) AS vs, list(node ORDER BY node) AS ns FROM leaves GROUP BY ALL),
forest AS (SELECT product, list({'j1': j1, 'j2': j2, 'j3': j3, 'a1': a1, 'a2': a2, 'a3': a3, 'vs': vs, 'ns': ns} ORDER BY t) AS trees FROM ends LEFT JOIN nodes USING (product, t) GROUP BY 1)"""


def leaf_of(t: str, x: str) -> str:
    node = (
        f"CASE WHEN {t}.j1 IS NULL THEN 1 WHEN {x}[{t}.j1 + 1] <= {t}.a1 THEN CASE WHEN {t}.j2 IS NULL THEN 2 WHEN {x}[{t}.j2 + 1] <= {t}.a2 THEN 4 ELSE 5 END"
        f" ELSE CASE WHEN {t}.j3 IS NULL THEN 3 WHEN {x}[{t}.j3 + 1] <= {t}.a3 THEN 6 ELSE 7 END END"
    )
    return f"{t}.vs[list_position({t}.ns, {node})]"
