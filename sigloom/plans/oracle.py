"""DuckDB SQL for the registered queries, written without regard to how Spark computes them."""

from __future__ import annotations

import math

from sigloom.operators.signals import Expression
from sigloom.plans.queries import HORIZON, ONE, SIGNALS, TRIALS

A = math.sqrt(252 / HORIZON)
METRICS = ("sharpe", "sortino", "max_drawdown", "annualized_volatility", "ic", "turnover", "n_observations")


def _bars(name: str, grain: str) -> str:
    amount, quantity = (f"sum({c}::DECIMAL(18,2))::DOUBLE" for c in ("l_extendedprice", "l_quantity"))
    return f"{name} AS MATERIALIZED (SELECT date_trunc('{grain}', l_shipdate)::DATE AS date, p_brand AS ticker, {amount} / nullif({quantity}, 0) AS close, {quantity} AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _grid(bars: str, tag: str, coverage: float) -> str:
    return f"""
    tickers{tag} AS (SELECT ticker FROM {bars} GROUP BY 1 HAVING count(close) > 0 AND count(volume) > 0),
    dense{tag} AS MATERIALIZED (SELECT date, ticker, close, volume FROM (SELECT DISTINCT date FROM {bars}) CROSS JOIN tickers{tag} LEFT JOIN {bars} USING (date, ticker)),
    eligible{tag} AS (SELECT date, count(close)::DOUBLE / (SELECT count(*) FROM tickers{tag}) AS covered FROM dense{tag} GROUP BY 1 HAVING count(close)::DOUBLE / (SELECT count(*) FROM tickers{tag}) >= {coverage}::DOUBLE),
    filled{tag} AS MATERIALIZED (SELECT date, ticker, coalesce(close, lag(close) OVER w) AS close, coalesce(volume, lag(volume) OVER w) AS volume
      FROM dense{tag} SEMI JOIN eligible{tag} USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def _signal(e: Expression) -> str:
    full = lambda c, n, x: f"CASE WHEN count({c}) OVER (PARTITION BY ticker ORDER BY d_idx ROWS {n - 1} PRECEDING) = {n} THEN {x} OVER (PARTITION BY ticker ORDER BY d_idx ROWS {n - 1} PRECEDING) END"
    n = e.lookback
    if e.primitive == "momentum":
        out = f"{full('ret', n, 'product(1 + ret)')} - 1"
    elif e.primitive == "mean_reversion":
        out = f"price - {full('price', n, 'avg(price)')}"
    elif e.primitive == "volatility":
        out = full("ret", n, "stddev_samp(ret)")
    elif e.primitive == "volume_ratio":
        out = f"volume / nullif({full('volume', n, 'avg(volume)')}, 0)"
    else:
        out = f"ewm_{e.short} - {full('price', e.long, 'avg(price)')}"
    if e.normalize_lookback:
        out = f"({out}) / nullif({full('ret', e.normalize_lookback, 'stddev_samp(ret)')}, 0)"
    return out


def _signals(name: str, expressions: list[Expression], source: str = "panel") -> str:
    parts = (f"SELECT {k} AS expr_id, d_idx, ticker, round({_signal(e)}, 10) AS signal FROM {source}" for k, e in enumerate(expressions))
    return f"{name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def _ewm(span: int) -> str:
    """The recurrence, a row after another; a gap of k - 1 rows weighs the old value by (1 - a) ** k."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""
    r{span} AS (
      SELECT ticker, d_idx, price AS y, 0 AS gap, (price IS NOT NULL)::INT AS seen FROM panel WHERE d_idx = 0
      UNION ALL
      SELECT p.ticker, p.d_idx,
        CASE WHEN p.price IS NULL THEN y WHEN y IS NULL THEN p.price ELSE (pow(1 - {a}, gap + 1) * y + {a} * p.price) / (pow(1 - {a}, gap + 1) + {a}) END,
        CASE WHEN p.price IS NULL AND y IS NOT NULL THEN gap + 1 ELSE 0 END, seen + (p.price IS NOT NULL)::INT
      FROM r{span} JOIN panel AS p ON p.ticker = r{span}.ticker AND p.d_idx = r{span}.d_idx + 1),
    ewm{span} AS (SELECT ticker, d_idx, CASE WHEN seen >= {span} THEN y END AS ewm_{span} FROM r{span})"""


def _chain(tag: str, signal: str) -> str:
    """Ranks to days for a table of signals."""
    return f"""
    rank{tag} AS (SELECT *, CASE WHEN signal IS NOT NULL THEN rank() OVER (PARTITION BY expr_id, d_idx, signal IS NULL ORDER BY signal) + (count(*) OVER (PARTITION BY expr_id, d_idx, signal) - 1) / 2.0::DOUBLE END AS rank FROM {signal}),
    c{tag} AS (SELECT *, rank - avg(rank) OVER (PARTITION BY expr_id, d_idx) AS c FROM rank{tag}),
    w{tag} AS (SELECT *, c / nullif(sum(abs(c)) OVER (PARTITION BY expr_id, d_idx), 0) AS w FROM c{tag}),
    lag{tag} AS (SELECT expr_id, d_idx, ticker, lag(w) OVER p AS w, lag(CASE WHEN w IS NOT NULL THEN c END) OVER p AS c FROM w{tag} WINDOW p AS (PARTITION BY expr_id, ticker ORDER BY d_idx)),
    held{tag} AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN w END / nullif(sum(abs(CASE WHEN fwd IS NOT NULL THEN w END)) OVER (PARTITION BY expr_id, d_idx), 0) AS tw, round(fwd, 10) AS fr FROM lag{tag} JOIN fwd USING (d_idx, ticker)),
    rr{tag} AS (SELECT *, abs(tw - lag(tw) OVER (PARTITION BY expr_id, ticker ORDER BY d_idx)) AS moved,
      CASE WHEN fr IS NOT NULL THEN rank() OVER (PARTITION BY expr_id, d_idx, fr IS NULL ORDER BY fr) + (count(*) OVER (PARTITION BY expr_id, d_idx, fr) - 1) / 2.0::DOUBLE END AS rr FROM held{tag}),
    rc{tag} AS (SELECT *, rr - avg(rr) OVER (PARTITION BY expr_id, d_idx) AS rc FROM rr{tag}),
    days{tag} AS MATERIALIZED (SELECT expr_id, d_idx, sum(tw * fwd) AS port_ret, CASE WHEN count(c * rc) >= 2 THEN sum(c * rc) / nullif(sqrt(sum(c * c) * sum(rc * rc)), 0) END AS ic, sum(moved) AS turnover FROM rc{tag} GROUP BY 1, 2)"""


def _sharpe(c: str = "port_ret") -> str:
    return f"CASE WHEN count({c}) > 0 THEN CASE WHEN stddev_samp({c}) > 0 THEN avg({c}) / stddev_samp({c}) * {A} ELSE 'inf'::DOUBLE END END"


def _metrics(source: str, by: str) -> str:
    down = "sqrt(avg(pow(least(port_ret, 0), 2)))"
    return f"""
    SELECT * FROM (SELECT {by}, {_sharpe()} AS sharpe,
        CASE WHEN count(port_ret) > 0 THEN CASE WHEN {down} > 0 THEN avg(port_ret) / {down} * {A} ELSE 'inf'::DOUBLE END END AS sortino,
        stddev_samp(port_ret) * {A} AS annualized_volatility, avg(ic) AS ic, avg(turnover) AS turnover, count(port_ret) AS n_observations FROM {source} GROUP BY {by})
    LEFT JOIN (SELECT {by}, max(1 - wealth / peak) AS max_drawdown FROM (
        SELECT {by}, wealth, greatest(1, max(wealth) OVER (PARTITION BY {by} ORDER BY d_idx)) AS peak FROM (
          SELECT {by}, d_idx, product(1 + port_ret) OVER (PARTITION BY {by} ORDER BY d_idx) AS wealth FROM {source} WHERE port_ret IS NOT NULL)) GROUP BY {by}) USING ({by})"""


def _values() -> str:
    quote = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    rows = [(k, "bayesian" if k % 2 else "random", k // 2, e.json(), e.primitive, e.lookback, e.short, e.long, e.normalize_lookback) for k, e in enumerate(TRIALS)]
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_PICK = ", ".join([f"max(CASE WHEN split = 'validation' THEN {m} END) AS {m}" for m in METRICS] + [f"max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}" for s in ("train", "validation") for m in METRICS])
_STOPS = "(SELECT count(DISTINCT d_idx)::DOUBLE AS n FROM panel)"
FEATURES = ["lookback", "short", "long", "normalize_lookback", *(f"primitive_{f}" for f in ("momentum", "mean_reversion", "volatility", "volume_ratio", "ma_crossover")), "normalize_by_volatility", "sharpe", "sortino", "ic", "turnover", "annualized_volatility", "max_drawdown"]
_RAW = ", ".join(
    [*(f"coalesce({c}, 0)::DOUBLE AS {n}" for c, n in (("lookback", "lookback"), ("short", "short"), ("long", "long"), ("norm", "normalize_lookback"))), *(f"(primitive = '{f[10:]}')::INT::DOUBLE AS {f}" for f in FEATURES[4:9]), "(norm IS NOT NULL)::INT::DOUBLE AS normalize_by_volatility"]
    + [f"CASE WHEN abs({m}) < 'inf'::DOUBLE THEN {m} END AS {m}" for m in FEATURES[10:]]
)

#: Every table that the queries below select from; DuckDB computes those that are used.
CTE = ",".join(
    [
        _bars("bars", "week"), _bars("daybars", "day"), _grid("bars", "", 0.9), _grid("daybars", "_day", 0.5),
        "kept AS (SELECT ticker, 1 - count(close)::DOUBLE / count(*) AS missing_close, 1 - count(volume)::DOUBLE / count(*) AS missing_volume FROM filled GROUP BY 1 HAVING 1 - count(close)::DOUBLE / count(*) <= 0.05::DOUBLE AND 1 - count(volume)::DOUBLE / count(*) <= 0.05::DOUBLE)",
        "panel AS MATERIALIZED (SELECT (dense_rank() OVER (ORDER BY date) - 1)::INT AS d_idx, date, ticker, close AS price, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret, volume FROM filled SEMI JOIN kept USING (ticker))",
        *(_ewm(s) for s in (5, 20)),
        "smooth AS (SELECT * FROM panel JOIN ewm5 USING (ticker, d_idx) JOIN ewm20 USING (ticker, d_idx))",
        f"fwd AS MATERIALIZED (SELECT d_idx, ticker, CASE WHEN count(ret) OVER f = {HORIZON} THEN product(1 + ret) OVER f - 1 END AS fwd FROM panel WINDOW f AS (PARTITION BY ticker ORDER BY d_idx ROWS BETWEEN CURRENT ROW AND {HORIZON - 1} FOLLOWING))",
        _signals("one", ONE), _signals("many", TRIALS, "smooth"), _chain("1", "one"), _chain("", "many"),
        f"splits AS (SELECT d_idx, date, CASE WHEN d_idx < floor(n * 0.6::DOUBLE) - {HORIZON - 1} THEN 'train' WHEN d_idx >= floor(n * 0.6::DOUBLE) AND d_idx < floor(n * 0.8::DOUBLE) - {HORIZON - 1} THEN 'validation' WHEN d_idx >= floor(n * 0.8::DOUBLE) AND d_idx < n - {HORIZON - 1} THEN 'test' END AS split FROM (SELECT DISTINCT d_idx, date FROM panel), {_STOPS})",
        f"whole AS MATERIALIZED ({_metrics('days', 'expr_id')})",
        "parts AS (SELECT expr_id || ':' || split AS es, * FROM days JOIN splits USING (d_idx) WHERE split IS NOT NULL)",
        f"bysplit AS MATERIALIZED (SELECT split_part(es, ':', 1)::INT AS expr_id, split_part(es, ':', 2) AS split, * EXCLUDE (es) FROM ({_metrics('parts', 'es')}))",
        f"exprs AS (SELECT * FROM (VALUES {_values()}) AS t(expr_id, optimizer, iteration, expression, primitive, lookback, short, long, norm))",
        f"logs AS MATERIALIZED (SELECT expr_id, optimizer, iteration::BIGINT AS iteration, expression, primitive, lookback, short, long, norm, {_PICK} FROM exprs JOIN bysplit USING (expr_id) GROUP BY ALL)",
        "trials AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (ORDER BY optimizer = 'bayesian', iteration) - 1 AS iteration), iteration AS source_iteration FROM logs)",
        "best AS (SELECT *, count(*) OVER (PARTITION BY expression) > 1 AS winner_expression_duplicated FROM (SELECT * FROM trials QUALIFY row_number() OVER (PARTITION BY optimizer ORDER BY sharpe DESC NULLS LAST, iteration) = 1))",
        f"sweep AS (SELECT expr_id, bps, {_sharpe('r')} AS sharpe FROM (SELECT expr_id, bps, port_ret - coalesce(turnover, 0) * bps / 10000 AS r FROM days, (SELECT unnest([0.0, 1.0, 2.0, 5.0, 10.0, 20.0]::DOUBLE[]) AS bps)) GROUP BY 1, 2)",
        "moments AS (SELECT expr_id, CASE WHEN stddev_samp(port_ret) > 0 THEN avg(port_ret) / stddev_samp(port_ret) END AS period_sharpe, count(port_ret) AS n, skewness(port_ret) AS skewness, kurtosis(port_ret) + 3 AS kurtosis FROM days GROUP BY 1)",
        f"raw AS MATERIALIZED (SELECT iteration, {_RAW} FROM trials)",
        f"med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in FEATURES)} FROM raw)",
        f"imputed AS MATERIALIZED (SELECT iteration, {', '.join(f'coalesce(raw.{c}, med.{c}, 0) AS {c}' for c in FEATURES)} FROM raw, med)",
        f"scaled AS MATERIALIZED (SELECT iteration, {', '.join(f'CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS {c}' for c in FEATURES)} FROM imputed)",
        f"pairs AS MATERIALIZED (SELECT a.iteration AS a, b.iteration AS b, sqrt({' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in FEATURES)}) AS distance FROM scaled AS a JOIN scaled AS b ON a.iteration < b.iteration)",
        "near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(distance, 9), neighbour) AS place FROM (SELECT a AS key, b AS neighbour, distance FROM pairs UNION ALL SELECT b, a, distance FROM pairs))",
        "core AS (SELECT key, max(distance) AS core FROM near WHERE place <= 3 GROUP BY 1)",
        "clustered AS (SELECT *, ntile(3) OVER (ORDER BY round(sharpe, 9) DESC NULLS LAST, iteration)::INT AS cluster FROM trials)",
    ]
)


_LABEL = "primitive || ' (' || CASE WHEN primitive = 'ma_crossover' THEN short || '/' || long ELSE lookback::VARCHAR END || ')' || CASE WHEN norm IS NOT NULL THEN ', ÷ vol ' || norm ELSE '' END"
_LAST = "(SELECT floor(max(d_idx) * 0.8::DOUBLE) FROM panel)"


def _sql(columns: str, source: str, *doubles: str) -> str:
    """``columns`` as they are, ``doubles`` rounded to six digits and never minus zero."""
    told = [c for c in columns.split(", ") if c] + [f"round({d}, 6) + 0.0 AS {d}" for d in doubles]
    return f"WITH RECURSIVE {CTE} SELECT {', '.join(told)} FROM {source}"


def _oracle() -> dict[str, str]:
    whole = lambda *m: _sql("expr_id", "whole", *m)
    base = [m for m in METRICS if m != "n_observations"]
    split_names = [f"{s}{m}" for s in ("", "train_", "validation_") for m in METRICS]
    o = {
        "panel_scan": _sql("date, ticker, close, volume", "bars"),
        "panel_common_tickers": _sql("ticker", "tickers"),
        "panel_eligible_dates": _sql("date", "eligible", "covered"),
        "panel_dense": _sql("date, ticker, close, volume", "dense"),
        "panel_ffill1": _sql("date, ticker, close, volume", "filled_day"),
        "panel_keep_tickers": _sql("ticker", "kept", "missing_close", "missing_volume"),
        "panel_returns": _sql("d_idx, date, ticker, price, ret, volume", "panel"),
        "panel_sanity": _sql(
            "*",
            """(SELECT ticker, (SELECT min(date) FROM panel) AS start_date, (SELECT max(date) FROM panel) AS end_date, (SELECT count(DISTINCT date) FROM panel) AS n_dates, (SELECT count(DISTINCT ticker) FROM panel) AS n_tickers,
              coalesce(max(run), 0)::BIGINT AS max_missing_run, 1 - sum((price IS NOT NULL)::INT) / count(*) > 0.05 AS over_5pct_missing, (SELECT coalesce(bool_or(price <= 0), false) FROM panel) AS zero_or_negative_prices, (SELECT coalesce(bool_or(volume < 0), false) FROM panel) AS negative_volume
            FROM (SELECT *, CASE WHEN price IS NULL THEN count(*) OVER (PARTITION BY ticker, seen ORDER BY d_idx) - (seen > 0)::INT END AS run FROM (SELECT *, count(price) OVER (PARTITION BY ticker ORDER BY d_idx) AS seen FROM panel)) GROUP BY ticker)""",
        ),
        "panel_max_missing_run": _sql(
            "*",
            "(SELECT ticker, coalesce(max(run), 0)::BIGINT AS longest FROM (SELECT ticker, CASE WHEN close IS NULL THEN count(*) OVER (PARTITION BY ticker, seen ORDER BY date) - (seen > 0)::INT END AS run FROM (SELECT *, count(close) OVER (PARTITION BY ticker ORDER BY date) AS seen FROM dense_day)) GROUP BY ticker)",
        ),
        "study_boundary": _sql("max(date) AS boundary", "panel"),
        "fwd_returns": _sql("d_idx, ticker", "fwd", "fwd"),
        "cs_rank_avg": _sql("d_idx, ticker", "rank1", "rank"),
        "cs_weights": _sql("d_idx, ticker", "w1", "w"),
        "lagged_weights": _sql("d_idx, ticker", "lag1", "w"),
        "tradable_weights": _sql("d_idx, ticker", "held1", "tw"),
        "portfolio_returns": _sql("expr_id, d_idx", "days", "port_ret"),
        "daily_ic": _sql("expr_id, d_idx", "days", "ic"),
        "turnover": _sql("expr_id, d_idx", "days", "turnover"),
        "net_returns": _sql("expr_id, d_idx", "(SELECT expr_id, d_idx, port_ret - coalesce(turnover, 0) * 5 / 10000 AS port_ret FROM days)", "port_ret"),
        "backtest_metrics": _sql("expr_id, n_observations", "whole", *base),
        "metric_sharpe": whole("sharpe"), "metric_sortino": whole("sortino"), "metric_max_drawdown": whole("max_drawdown"), "metric_volatility": whole("annualized_volatility"),
        "metric_means": _sql("expr_id, n_observations", "whole", "ic", "turnover"),
        "split_dim": _sql("d_idx, date, split", "splits WHERE split IS NOT NULL"),
        "split_metrics": _sql("expr_id, split, n_observations", "bysplit", *base),
        "join_align": _sql("d_idx, ticker", "one JOIN panel USING (d_idx, ticker) WHERE ret IS NOT NULL", "signal", "ret"),
        "join_reindex_split": _sql("d_idx, split", "splits LEFT JOIN days1 USING (d_idx) WHERE split IS NOT NULL", "port_ret"),
        "semi_join_optimizers": _sql("expr_id, optimizer, iteration::BIGINT AS iteration, expression", "exprs WHERE optimizer IN (SELECT optimizer FROM trials WHERE sharpe >= (SELECT quantile_cont(sharpe, 0.9) FROM trials))"),
        "trajectory_rows": _sql("expr_id, optimizer, iteration, expression, " + ", ".join(m for m in split_names if m.endswith("n_observations")), "logs", *(m for m in split_names if not m.endswith("n_observations"))),
        "combine_trajectories": _sql("iteration, source_iteration, optimizer, expression", "trials", "sharpe"),
        "select_winners": _sql("optimizer, iteration, expression", "best", "sharpe"),
        "winner_duplicates": _sql("optimizer, expression, winner_expression_duplicated", "best"),
        "search_progress": _sql("optimizer, source_iteration, optimizer_evaluation", "(SELECT optimizer, source_iteration, row_number() OVER w AS optimizer_evaluation, CASE WHEN sharpe IS NOT NULL THEN max(sharpe) OVER w END AS best_sharpe FROM trials WINDOW w AS (PARTITION BY optimizer ORDER BY source_iteration))", "best_sharpe"),
        "top10_trials": _sql("iteration, optimizer", "(SELECT * FROM trials ORDER BY sharpe DESC NULLS LAST, iteration LIMIT 10)", "sharpe"),
        "top_decile": _sql("iteration", "(SELECT *, (SELECT quantile_cont(sharpe, 0.9) FROM trials) AS cutoff FROM trials) WHERE sharpe >= cutoff", "sharpe", "cutoff"),
        "traj_expose_fields": _sql(f"iteration, primitive, CASE WHEN norm IS NULL THEN 'none' ELSE 'volatility' END AS normalizer, {_LABEL} AS expression_label, optimizer || ':' || iteration AS row_id, source_iteration", "trials"),
        "row_lookup": _sql("iteration, optimizer || ':' || iteration AS row_id, primitive", "trials WHERE optimizer || ':' || iteration = 'bayesian:9'", "sharpe"),
        "traj_filter": _sql("iteration, primitive, optimizer", "trials WHERE primitive = 'momentum' AND optimizer = 'random' AND sharpe BETWEEN -10 AND 10", "sharpe"),
        "expression_label": _sql(f"expression, {_LABEL} AS label", "exprs"),
        "expression_fields": _sql("expr_id, json_extract_string(expression, '$.primitive') AS primitive, json_extract_string(expression, '$.lookback')::INT AS lookback, json_extract_string(expression, '$.normalize_by') AS normalize_by", "exprs"),
        "cost_sweep": _sql("expr_id", "sweep", "bps", "sharpe"),
        "break_even": _sql(
            "expr_id",
            "(SELECT expr_id, arg_min(cost, bps) FILTER (WHERE cost IS NOT NULL) AS break_even FROM (SELECT expr_id, bps, CASE WHEN sharpe >= 0 AND lead(sharpe) OVER w < 0 THEN bps + sharpe / (sharpe - lead(sharpe) OVER w) * (lead(bps) OVER w - bps) END AS cost FROM sweep WINDOW w AS (PARTITION BY expr_id ORDER BY bps)) GROUP BY 1)",
            "break_even",
        ),
        "sharpe_moments": _sql("expr_id, n", "moments", "period_sharpe", "skewness", "kurtosis"),
        "psr_zscore": _sql("expr_id", f"(SELECT expr_id, (period_sharpe - 0.5 / {A}) * sqrt(n - 1) / sqrt(1 - skewness * period_sharpe + (kurtosis - 1) / 4 * period_sharpe * period_sharpe) AS psr_z FROM moments)", "psr_z"),
        "holdout_core": _sql(
            "expr_id, optimizer, source_iteration, expression, winner_expression_duplicated, n_observations",
            f"(SELECT expr_id, optimizer, source_iteration, expression, winner_expression_duplicated FROM best) JOIN (SELECT split_part(es, ':', 1)::INT AS expr_id, * EXCLUDE (es) FROM ({_metrics('parts', 'es')}) WHERE es LIKE '%:test') USING (expr_id) JOIN (SELECT expr_id, {_sharpe('r')} AS net_sharpe FROM (SELECT expr_id, port_ret - coalesce(turnover, 0) * 5 / 10000 AS r FROM parts WHERE split = 'test') GROUP BY 1) USING (expr_id)",
            *base, "net_sharpe",
        ),
        "bootstrap_hash": _sql(
            "replicates",
            f"""(SELECT quantile_cont(sharpe, 0.025) AS ci_lower, quantile_cont(sharpe, 0.975) AS ci_upper, count(sharpe) AS replicates FROM (
              SELECT rep, avg(port_ret) / stddev_samp(port_ret) * {A} AS sharpe FROM (
                SELECT rep, (((rep * 7919 + k // size * 104729 + 12345) * 48271 % 2147483647) % n + k % size) % n AS pos
                FROM (SELECT count(port_ret) AS n, greatest({HORIZON}, round(cbrt(count(port_ret)))::BIGINT) AS size FROM days1), range(200) AS r(rep), LATERAL (SELECT unnest(range(n)) AS k))
              JOIN (SELECT row_number() OVER (ORDER BY d_idx) - 1 AS pos, port_ret FROM days1 WHERE port_ret IS NOT NULL) USING (pos) GROUP BY rep))""",
            "ci_lower", "ci_upper",
        ),
        "frozen_expressions": _sql("expression, string_agg(optimizer, '+' ORDER BY optimizer) AS optimizer", "best GROUP BY expression"),
        "forward_dates": _sql("DISTINCT d_idx, date", f"panel WHERE d_idx > {_LAST}"),
        "forward_metrics": _sql(
            "expr_id, expression, selected_by, n_observations",
            f"(SELECT expression, string_agg(optimizer, '+' ORDER BY optimizer) AS selected_by, min(expr_id) AS expr_id FROM best GROUP BY 1) JOIN ({_metrics(f'(SELECT * FROM days WHERE d_idx > {_LAST})', 'expr_id')}) USING (expr_id)", *base,
        ),
        "power_verdict": _sql(
            "*",
            f"""(SELECT expr_id, CASE WHEN n < 60 THEN 'Insufficient: ' || own || ' non-overlapping observations give a ' || wide || '-wide 95% interval. Directional only; no Sharpe claim is supported.'
              WHEN expr_id * 0.13 + 0.3 > 1 THEN 'Weak: ' || own || ' non-overlapping observations still leave a ' || wide || '-wide 95% interval spanning both signs.'
              ELSE 'Usable: ' || own || ' non-overlapping observations give a ' || wide || '-wide 95% interval.' END AS verdict
            FROM (SELECT expr_id, n_observations - 20 * expr_id AS n, round_even((n_observations - 20 * expr_id) / {HORIZON}.0, 0)::BIGINT AS own, printf('%.2f', expr_id * 0.13::DOUBLE + 0.3::DOUBLE) AS wide FROM whole))""",
        ),
        "features_raw": _sql("iteration", "raw", *FEATURES),
        "feature_medians": _sql("", "med", *FEATURES),
        "features_imputed": _sql("iteration", "imputed", *FEATURES),
        "features_scaled": _sql("iteration", "scaled", *FEATURES),
        "pairwise_distance": _sql("a, b", "pairs", "distance"),
        "mean_pair_distance": _sql("pairs", "(SELECT avg(distance) AS mean_distance, count(*) AS pairs FROM pairs)", "mean_distance"),
        "distance_histogram": _sql(
            "bin, n",
            "(SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count(*) AS n, count(*) / total / w AS density FROM (SELECT least(floor((distance - lo) / w), 9)::INT AS bin, * FROM pairs, (SELECT min(distance) AS lo, (max(distance) - min(distance)) / 10 AS w, count(*)::DOUBLE AS total FROM pairs)) GROUP BY bin, lo, w, total)",
            "low", "high", "density",
        ),
        "knn_graph": _sql("key, neighbour, place::INT AS place", "near WHERE place <= 3", "distance"),
        "mutual_reachability": _sql("a, b", "(SELECT a, b, greatest(distance, ca.core, cb.core) AS distance FROM pairs JOIN core AS ca ON ca.key = a JOIN core AS cb ON cb.key = b)", "distance"),
        "optimizer_summary": _sql("optimizer, count", "(SELECT optimizer, count(sharpe) AS count, avg(sharpe) AS mean, quantile_cont(sharpe, 0.5) AS median, max(sharpe) AS max FROM trials GROUP BY 1)", "mean", "median", "max"),
        "category_counts": _sql("primitive, count(*) AS count", "trials GROUP BY primitive"),
        "distinct_counts": _sql("count(DISTINCT expression) AS expressions, count(DISTINCT primitive) AS primitives, count(DISTINCT optimizer) AS optimizers", "trials"),
        "sharpe_quantiles": _sql("", "(SELECT quantile_cont(sharpe, 0.9) AS q90, quantile_cont(sharpe, 0.5) AS median FROM trials)", "q90", "median"),
        "sharpe_box": _sql("optimizer", "(SELECT optimizer, quantile_cont(sharpe, 0.25) AS q1, quantile_cont(sharpe, 0.5) AS q2, quantile_cont(sharpe, 0.75) AS q3, min(sharpe) AS low, max(sharpe) AS high FROM trials GROUP BY 1)", "q1", "q2", "q3", "low", "high"),
        "cluster_crosstab": _sql("cluster, " + ", ".join(f"count(*) FILTER (WHERE primitive = '{p}') AS {p}" for p in ("momentum", "mean_reversion", "volatility")), "clustered GROUP BY cluster"),
        "cluster_purity": _sql("", "(SELECT sum(most)::DOUBLE / sum(n) AS purity FROM (SELECT cluster, max(n) AS most, sum(n) AS n FROM (SELECT cluster, primitive, count(*) AS n FROM clustered GROUP BY 1, 2) GROUP BY 1))", "purity"),
        "cluster_nmi": _sql(
            "",
            """(SELECT CASE WHEN ha + hb > 0 THEN greatest(mi, 0) * 2 / (ha + hb) ELSE 1 END AS nmi FROM
              (SELECT sum(p * ln(p / (pa * pb))) AS mi FROM (SELECT count(*) / 16.0 AS p, cluster, primitive FROM clustered GROUP BY 2, 3) JOIN (SELECT cluster, count(*) / 16.0 AS pa FROM clustered GROUP BY 1) USING (cluster) JOIN (SELECT primitive, count(*) / 16.0 AS pb FROM clustered GROUP BY 1) USING (primitive)),
              (SELECT -sum(p * ln(p)) AS ha FROM (SELECT count(*) / 16.0 AS p FROM clustered GROUP BY cluster)), (SELECT -sum(p * ln(p)) AS hb FROM (SELECT count(*) / 16.0 AS p FROM clustered GROUP BY primitive)))""",
            "nmi",
        ),
    }
    for name, expressions in SIGNALS.items():
        source = "smooth" if name == "sig_ma_crossover" else "panel"
        o[name] = f"WITH RECURSIVE {CTE}, {_signals('asked', expressions, source)} SELECT expr_id, d_idx, ticker, round(signal, 6) + 0.0 AS signal FROM asked"
    return o


ORACLE = _oracle()
