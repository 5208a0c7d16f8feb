"""DuckDB building blocks.  Order-dependent steps are written as recursion over the months,
independently of the closed forms and kernels they are compared with."""


def classified(src: str, out: str, keep: bool = True) -> str:
    return f"""
{out}_share AS (SELECT product, avg(CASE WHEN y IS NULL OR y <> 0 THEN 1.0 ELSE 0.0 END) AS share FROM
  (SELECT product, y, row_number() OVER (PARTITION BY product ORDER BY ds DESC) AS rn FROM {src}) WHERE rn <= 24 GROUP BY 1),
{out} AS (SELECT s.* FROM {src} s JOIN {out}_share h ON h.product = s.product WHERE {'' if keep else 'NOT '}(share >= 0.5))"""


def windowed(src: str, out: str, n: int = 60) -> str:
    return f"""
{out} AS (SELECT product, ds, y FROM (SELECT product, ds, y, row_number() OVER (PARTITION BY product ORDER BY ds DESC) AS rn FROM {src}) WHERE rn <= {n})"""


def indexed(src: str, out: str) -> str:
    return f"""
{out} AS (SELECT product, ds, y, row_number() OVER (PARTITION BY product ORDER BY ds) - 1 AS i,
                 count(*) OVER (PARTITION BY product) AS n FROM {src})"""


def nm(a: str, b: str) -> str:
    p, q = f"(CASE WHEN {a} >= 0 THEN {a} END)", f"(CASE WHEN {b} >= 0 THEN {b} END)"
    return f"coalesce(({p} + {q}) / 2, {p}, {q}, 0.0)"


def _pass(src: str, col: str, bad: str, out: str) -> str:
    """Repair ``col`` of ``src(product, i, ...)`` left to right into ``out.v``."""
    return f"""
{out}_x AS (SELECT product, i, {col} AS raw, lead({col}) OVER (PARTITION BY product ORDER BY i) AS nxt FROM {src}),
{out} AS (
  SELECT product, i, CASE WHEN {bad.format('raw')} THEN {nm('NULL', 'nxt')} ELSE raw END AS v FROM {out}_x WHERE i = 0
  UNION ALL
  SELECT x.product, x.i, CASE WHEN {bad.format('x.raw')} THEN {nm('r.v', 'x.nxt')} ELSE x.raw END
  FROM {out} r JOIN {out}_x x ON x.product = r.product AND x.i = r.i + 1)"""


def negatives(src: str, out: str) -> str:
    return _pass(src, "y", "coalesce({} < 0, false)", out)


def gaps(src: str, out: str) -> str:
    return _pass(src, "v", "{} IS NULL", out)


def cleaned(src: str, out: str) -> str:
    """``out(product, i, n, ds, y, c2, clean, reason, lower, upper)`` from indexed ``src``."""
    return f"""{negatives(src, out + '_1')},{gaps(out + '_1', out + '_2')},
{out}_d AS (SELECT product, i, v, v - lag(v) OVER (PARTITION BY product ORDER BY i) AS d FROM {out}_2),
{out}_q AS (SELECT product, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3, count(d) AS c FROM {out}_d GROUP BY 1),
{out}_b AS (SELECT product, CASE WHEN c > 3 THEN q1 - 3.0 * (q3 - q1) END AS lower, CASE WHEN c > 3 THEN q3 + 3.0 * (q3 - q1) END AS upper FROM {out}_q),
{out}_x AS (SELECT s.product, s.i, s.n, s.ds, s.y, coalesce(s.y < 0, false) AS neg, b.v IS NULL AS mis, c.v AS c2,
                   lead(c.v) OVER (PARTITION BY s.product ORDER BY s.i) AS nxt, lower, upper
            FROM {src} s JOIN {out}_1 b ON b.product = s.product AND b.i = s.i JOIN {out}_2 c ON c.product = s.product AND c.i = s.i
            JOIN {out}_b q ON q.product = s.product),
{out}_3 AS (
  SELECT product, i, c2 AS clean, false AS hit FROM {out}_x WHERE i = 0
  UNION ALL
  SELECT x.product, x.i,
         CASE WHEN NOT (x.neg OR x.mis) AND (x.c2 - r.clean < lower OR x.c2 - r.clean > upper) THEN {nm('r.clean', 'x.nxt')} ELSE x.c2 END,
         coalesce(NOT (x.neg OR x.mis) AND (x.c2 - r.clean < lower OR x.c2 - r.clean > upper), false)
  FROM {out}_3 r JOIN {out}_x x ON x.product = r.product AND x.i = r.i + 1),
{out} AS (SELECT x.product, x.i, x.n, x.ds, x.y, x.c2, f.clean, x.lower, x.upper,
                 CASE WHEN x.neg THEN 'negative' WHEN x.mis THEN 'missing' WHEN f.hit THEN 'outlier' END AS reason
          FROM {out}_x x JOIN {out}_3 f ON f.product = x.product AND f.i = x.i)"""


def split(src: str, out: str, val: int = 12, test: int = 12) -> str:
    """``src`` must carry i and n; adds nv, nt and split."""
    short = f"n < {val + test + 12}"
    return f"""
{out} AS (SELECT *, CASE WHEN i >= n - nt THEN 'test' WHEN i >= n - nt - nv THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, CASE WHEN {short} THEN least({val}, n // 3) ELSE {val} END AS nv,
            CASE WHEN {short} THEN least({test}, n // 3) ELSE {test} END AS nt FROM {src}))"""


def ar_fit(src: str, out: str, d: int) -> str:
    """Least-squares AR(1) on ``src(product, i, y)``: ``out(product, phi, c, w0, y0)``."""
    w = "y - lag(y) OVER (PARTITION BY product ORDER BY i)" if d else "y"
    return f"""
{out}_w AS (SELECT product, i, y, {w} AS w FROM {src}),
{out}_l AS (SELECT *, lag(w) OVER (PARTITION BY product ORDER BY i) AS x FROM {out}_w),
{out} AS (SELECT product, coalesce(regr_slope(w, x), 0.0) AS phi, regr_intercept(w, x) AS c,
                 arg_max(w, i) AS w0, arg_max(y, i) AS y0 FROM {out}_l GROUP BY 1)"""


def ar_path(fit: str, out: str, d: int, h: int = 12) -> str:
    nxt = "y0 + c + phi * w0" if d else "c + phi * w0"
    rec = "p.y + f.c + f.phi * p.w" if d else "f.c + f.phi * p.w"
    return f"""
{out} AS (
  SELECT product, 1 AS step, c + phi * w0 AS w, {nxt} AS y FROM {fit}
  UNION ALL
  SELECT p.product, p.step + 1, f.c + f.phi * p.w, {rec} FROM {out} p JOIN {fit} f ON f.product = p.product WHERE p.step < {h})"""


GRID = """
hw_v AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS v),
hw_grid AS (SELECT a.v::DOUBLE AS alpha, b.v::DOUBLE AS beta, g.v::DOUBLE AS gamma FROM hw_v a, hw_v b, hw_v g)"""


def hw_run(src: str, grid: str, out: str) -> str:
    """Additive smoothing of ``src(product, i, y)`` (n >= 24) for every candidate row of ``grid``;
    ``out`` holds every state.  ``grid`` may have a product column."""
    return f"""
{out}_y AS (SELECT product, list(y ORDER BY i) AS ys FROM {src} GROUP BY 1),
{out}_0 AS (SELECT product, ys, list_avg(ys[1:12]) AS l0, list_avg(ys[13:24]) AS l1 FROM {out}_y),
{out} AS (
  SELECT s.product, g.alpha, g.beta, g.gamma, 12 AS i, len(ys) AS n, l0 AS level, (l1 - l0) / 12 AS trend,
         list_transform(ys[1:12], lambda v: v - l0) AS season, CAST(0.0 AS DOUBLE) AS sse
  FROM {out}_0 s JOIN {grid} g ON {'g.product = s.product' if grid.startswith('own') else 'true'}
  UNION ALL
  SELECT product, alpha, beta, gamma, i + 1, n, lv, beta * (lv - level) + (1 - beta) * trend,
         list_append(season[2:12], gamma * (y - level - trend) + (1 - gamma) * season[1]), sse + (y - level - trend - season[1]) ** 2
  FROM (SELECT r.*, o.ys[r.i + 1] AS y, r.alpha * (o.ys[r.i + 1] - r.season[1]) + (1 - r.alpha) * (r.level + r.trend) AS lv
        FROM {out} r JOIN {out}_0 o ON o.product = r.product WHERE r.i < r.n))"""


def hw_best(run: str, out: str) -> str:
    return f"""
{out} AS (SELECT * FROM {run} WHERE i = n QUALIFY row_number() OVER (PARTITION BY product ORDER BY sse, alpha, beta, gamma) = 1)"""


def hw_path(fit: str, out: str, h: str = "12") -> str:
    return f"""
{out} AS (SELECT product, step, level + step * trend + season[(step - 1) % 12 + 1] AS y
  FROM {fit}, (SELECT unnest(generate_series(1, {h})) AS step) k)"""


def metrics(pairs: str, out: str) -> str:
    return f"""
{out} AS (SELECT product, model, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
   coalesce(avg(abs((y - yhat) / nullif(y, 0))), 0.0) AS mape, avg(abs(y - yhat)) AS mae FROM {pairs} GROUP BY 1, 2)"""


def weights(src: str, out: str, order: str = "model", threshold: float = 0.5, cap: int = 3) -> str:
    return f"""
{out}_a AS (SELECT *, (mape > 0 AND mape < {threshold}) AS ok FROM {src}),
{out}_b AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY product) AS n_ok,
                   row_number() OVER (PARTITION BY product ORDER BY ok DESC, mape, model) AS rk FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN n_ok > 0 THEN CASE WHEN ok AND rk <= {cap} THEN 1 / mape END WHEN mape > 0 THEN 1.0 END AS raw FROM {out}_b),
{out} AS (SELECT product, model, mape, raw / sum(raw) OVER (PARTITION BY product) AS weight,
   row_number() OVER (PARTITION BY product ORDER BY CASE WHEN n_ok > {cap} THEN mape END, {order}, model) AS used
   FROM {out}_c WHERE raw IS NOT NULL)"""


def combine(forecasts: str, w: str, out: str) -> str:
    return f"""
{out}_n AS (SELECT product, model, count(*) AS c FROM {forecasts} GROUP BY 1, 2),
{out}_r AS (SELECT product, arg_min(c, used) AS want FROM {w} JOIN {out}_n USING (product, model) GROUP BY 1),
{out} AS (SELECT f.product, f.step, f.ds, sum(CASE WHEN c = want THEN weight * yhat ELSE 0 END) AS yhat
  FROM {forecasts} f JOIN {w} w ON w.product = f.product AND w.model = f.model
  JOIN {out}_n n ON n.product = f.product AND n.model = f.model JOIN {out}_r r ON r.product = f.product
  WHERE f.step <= want GROUP BY 1, 2, 3)"""


def prepared(src: str, out: str = "cl") -> str:
    """classify -> window -> index -> clean."""
    return ",".join([classified(src, out + "_k"), windowed(out + "_k", out + "_w"), indexed(out + "_w", out + "_i"), cleaned(out + "_i", out)])


def outlook(src: str, hw: bool = True) -> str:
    """The whole run for AR1, ARI1 and (optionally) HoltWinters; ends in pairs, fc, met, wt, ens."""
    models = [("AR1", "a0"), ("ARI1", "a1")] + ([("HoltWinters", "hw")] if hw else [])
    order = "CASE model " + " ".join(f"WHEN '{m}' THEN {k}" for k, (m, _) in enumerate(models)) + " END"
    parts = [
        prepared(src),
        split("cl", "sp"),
        "\nhead AS (SELECT product, i, clean AS y FROM sp WHERE split <> 'test')",
        "\nwhole AS (SELECT product, i, clean AS y FROM sp)",
    ]
    if hw:
        parts.append(GRID)
    for tag, rows in (("b", "head"), ("f", "whole")):
        for d in (0, 1):
            parts += [ar_fit(rows, f"a{d}{tag}_fit", d), ar_path(f"a{d}{tag}_fit", f"a{d}{tag}", d)]
        if hw:
            parts += [hw_run(rows, "hw_grid", f"hw{tag}_run"), hw_best(f"hw{tag}_run", f"hw{tag}_fit"), hw_path(f"hw{tag}_fit", f"hw{tag}")]

    def union(tag):
        return " UNION ALL ".join(f"SELECT product, '{m}' AS model, step, y AS yhat FROM {t}{tag}" for m, t in models)

    parts += [
        "\ntest_rows AS (SELECT product, i - (n - nt) + 1 AS step, ds, clean AS y FROM sp WHERE split = 'test')",
        f"\npairs AS (SELECT p.product, p.model, p.step, t.ds, t.y, p.yhat FROM ({union('b')}) p JOIN test_rows t ON t.product = p.product AND t.step = p.step)",
        "\nlast_row AS (SELECT product, max(ds) AS last FROM sp GROUP BY 1)",
        f"\nfc AS (SELECT p.product, p.model, p.step, CAST(l.last + to_months(CAST(p.step AS INTEGER)) AS DATE) AS ds, p.yhat FROM ({union('f')}) p JOIN last_row l ON l.product = p.product)",
        metrics("pairs", "met"),
        weights("met", "wt", order),
        combine("fc", "wt", "ens"),
    ]
    return ",".join(parts)
