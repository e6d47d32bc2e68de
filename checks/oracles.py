"""Independent SQL for the registered queries."""

from __future__ import annotations

from checks.views import with_views

SHIFT = "1.37e-10"


def r(expression: str, name: str | None = None, places: int = 8) -> str:
    """A rounded double, named after its column unless told otherwise."""
    return f"round(({expression}) + {SHIFT}, {places}) + 0.0 as {name or expression.split('.')[-1]}"


def rs(*columns: str, places: int = 8) -> str:
    return ", ".join(r(c, places=places) for c in columns)


LIQUID = """
(volume > 0 or open_interest > 0) and best_bid > 0 and best_offer > 0 and best_offer >= best_bid
and (best_offer - best_bid) / ((best_bid + best_offer) / 2) < cast(0.5 as double)
and abs(delta) between cast(0.05 as double) and cast(0.95 as double)"""
TRADABLE = f"select *, exdate - date as dte from quotes where {LIQUID} and exdate - date between 25 and 90"

# Row of a (date, ticker) at the least distance, by row_number: ties by symbol, then strike.
NEAREST = """
ranked as (
    select *,
        row_number() over (partition by date, ticker order by
            abs(abs(delta) - cast(0.5 as double)), symbol, strike_price) as r_atm,
        row_number() over (partition by date, ticker, cp_flag order by
            abs(delta + case when cp_flag = 'P' then cast(0.25 as double)
                else cast(-0.25 as double) end), symbol, strike_price) as r_wing
    from base),
smile as (
    select date, ticker, max(case when r_atm = 1 then impl_volatility end) as atm_iv,
        max(case when r_wing = 1 and cp_flag = 'P' then impl_volatility end) as put25_iv,
        max(case when r_wing = 1 and cp_flag = 'C' then impl_volatility end) as call25_iv,
        stddev_samp(impl_volatility) as iv_std, avg(delta) as avg_delta, avg(vega) as avg_vega,
        avg(theta) as avg_theta
    from ranked group by date, ticker)"""

NEAREST_Q = """
thresholds as (
    select ticker, {column} as threshold from (
        select ticker, {column}, row_number() over (partition by ticker order by {column}) as rn,
            count(*) over (partition by ticker) as n
        from {table} where {column} is not null)
    where rn = cast(round((n - 1) * cast({q} as double)) as bigint) + 1)"""

QUOTE_ORDER = "partition by secid order by date, strike_price, symbol"
LAGS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]


def _windows(W: int, H: int, table: str = "daily", cols: str = "atm_iv skew curvature") -> str:
    names = cols.split()
    back = f"partition by ticker order by date rows between {W - 1} preceding and current row"
    ahead = f"partition by ticker order by date rows between 1 following and {H} following"
    missing = " or ".join(f"{c} is null" for c in names)
    total = " + ".join(names)
    return f"""
flagged as (select *, case when {missing} then 1 else 0 end as gap, {total} as total_row
            from {table}),
framed as (
    select ticker, date as end_date, {', '.join(names)},
        count(*) over b as n_rows, sum(gap) over b as n_gaps,
        first_value(atm_iv) over b as first_iv, sum(total_row) over b as total,
        list(atm_iv) over b as ivs, list(atm_iv) over a as ys, count(atm_iv) over a as n_y
    from flagged window b as ({back}), a as ({ahead})),
windows as (select * from framed where n_rows = {W} and n_gaps = 0 and n_y = {H})"""


EWMA = """list_reduce(ivs, lambda state, v: cast(0.3 as double) * v + cast(0.7 as double) * state)"""
PAIRS = f"""
{_windows(60, 3)},
forecasts as (select ticker, end_date, ys, {EWMA} as yhat from windows),
pairs as (select ticker, end_date, cast(h as int) as horizon, ys[h] as y, yhat
          from forecasts, (select unnest([1, 2, 3]) as h))"""
WINDOW_COLUMNS = ", ".join([
    "ticker", "end_date", "cast(n_rows as int) as steps", r("first_iv", places=6),
    r("skew", "last_skew", 6), r("total", places=6), r("ys[1]", "next_iv", 6),
])

# The whole extract: cap, forward target, then lags over the rows that are left.
EXTRACT = f"""
traded as (select * from quotes where volume > 0 and date between date '1990-01-01'
           and date '2010-12-31'),
joined as (select traded.*, stock.prc from traded left join stock using (ticker, date)),
{NEAREST_Q.format(column='volume', table='joined', q='0.95')},
capped as (select joined.*, threshold from joined join thresholds using (ticker)
           where volume <= threshold),
led as (select *, lead(impl_volatility, 30) over ({QUOTE_ORDER}) as iv_30d from capped),
kept as (select * from led where iv_30d is not null),
lagged as (select *, prc - lag(prc, 1) over ({QUOTE_ORDER}) as price_diff_1d,
           prc - lag(prc, 233) over ({QUOTE_ORDER}) as price_diff_233d from kept),
cleaned as (select * from lagged where price_diff_233d is not null),
counted as (select ticker, count(*) as n_raw from joined group by 1),
written as (select ticker, count(*) as n_written,
            string_agg(distinct cast(year(date) as varchar), ',' order by
                       cast(year(date) as varchar)) as years from cleaned group by 1)"""

QUANTILE_BOX = """
quartiles as (
    select ticker, quantile_cont(strike_price, 0.25) as q1, quantile_cont(strike_price, 0.5) as med,
        quantile_cont(strike_price, 0.75) as q3 from quotes group by 1)"""

ORACLES: dict[str, str] = {}


def add(name: str, query: str, *views: str) -> None:
    ORACLES[name] = with_views(query, *views) if views else query


add("scan_quotes", f"""
select date, secid, symbol, cp_flag, exdate,
    {rs('strike_price', 'best_bid', 'best_offer', 'volume', 'open_interest', 'impl_volatility',
        'delta', 'vega', 'theta')}
from quotes where secid in (1, 3) and volume > 0
  and date between date '1994-01-01' and date '1996-12-31'""", "quotes")
add("scan_stock", f"""
select n.ticker, s.date, {rs('s.prc', 's.vol')} from stock_raw s join names n using (cusip)
where n.ticker in ('T1', 'T2') and s.date between date '1993-01-01' and date '1997-12-31'
""", "stock_raw", "names")
add("secid_lookup", "select distinct secid, ticker from master where ticker in ('T1', 'T2', 'T9')",
    "master")
add("yearly_union", f"""
select m.ticker, q.date, q.symbol, {rs('q.volume', 'q.impl_volatility')}
from quotes q join (select distinct secid, ticker from master) m using (secid)
where m.ticker in ('T0', 'T2')""", "quotes", "master")
add("sample_rows", """
select symbol, ticker from quotes order by md5(concat(symbol, '|42')), symbol limit 20""", "quotes")
add("head_rows", """
select symbol, ticker from quotes order by symbol limit 5""", "quotes")
add("regime_discovery_days", f"""
select date, ticker, {rs('atm_iv', 'skew', 'curvature')}, true as labelled from daily
where atm_iv is not null and skew is not null and curvature is not null""", "daily")
add("scan_rates", f"""
select date, {r('treasury_2y')} from rates
where date between date '1994-01-01' and date '1995-12-31'""", "rates")
add("slice_rows", f"""
select date, ticker, {rs('atm_iv', 'skew', 'curvature')}, regime, cast(year(date) as int) as year,
    cast(month(date) as int) as month, cast(day(date) as int) as day
from daily where ticker = 'T1' and year(date) in (1994, 1995)""", "daily")
add("slice_missing", """
select ticker, cast(y as int) as year
from (select unnest(['T0', 'T1', 'T9']) as ticker), (select unnest(range(1990, 2004)) as y)
where (ticker, y) not in (select (ticker, year(date)) from daily)""", "daily")
add("apply_schema", f"""
select secid, date, symbol, exdate, cp_flag,
    {rs('strike_price', 'best_bid', 'best_offer', 'volume', 'open_interest', 'impl_volatility',
        'delta', 'vega')},
    {r("case when cp_flag = 'P' then null else theta end", 'theta')} from quotes""", "quotes")
add("column_projection", f"""
select symbol, date, {r('strike_price')}, {r('strike_price', 'strike_copy')}, 60 as w
from quotes""", "quotes")
add("date_parts", """
select symbol, date, cast(year(date) as int) as year, cast(month(date) as int) as month,
    cast(day(date) as int) as day from quotes""", "quotes")
add("feature_selection", f"""
select date, ticker, {rs('atm_iv', 'skew', 'curvature')}, {r('skew', 'price_diff_1d')}
from daily""", "daily")
add("days_to_expiry", "select symbol, cast(exdate - date as int) as dte from quotes", "quotes")
add("predicates", f"""
select symbol, ticker, {rs('volume', 'impl_volatility')} from quotes
where ticker in ('T0', 'T3') and volume between 5 and 25 and impl_volatility is not null""",
    "quotes")
add("liquidity_filter", f"""
select symbol, {rs('best_bid', 'best_offer', 'delta')} from quotes where {LIQUID}""", "quotes")
add("tenor_filter", """
select symbol, date, exdate, cast(exdate - date as int) as dte from quotes
where exdate - date between 25 and 90""", "quotes")
add("volume_cap", f"""
with {NEAREST_Q.format(column='volume', table='quotes', q='0.95')}
select symbol, ticker, {r('volume')} from quotes join thresholds using (ticker)
where volume <= threshold""", "quotes")
add("winsorise_iv", f"""
with caps as (select ticker, quantile_cont(impl_volatility, 0.95) as cap from quotes group by 1)
select symbol, ticker,
    {r('case when impl_volatility > cap then cap else impl_volatility end', 'impl_volatility')}
from quotes left join caps using (ticker)""", "quotes")
add("one_hot", """
select ticker, date, cast(regime = 0 as int) as regime_0, cast(regime = 1 as int) as regime_1,
    cast(regime = 2 as int) as regime_2 from daily""", "daily")
add("master_join", """
select symbol, secid, m.ticker from quotes join (select distinct secid, ticker from master) m
using (secid) where m.ticker in ('T1', 'T2')""", "quotes", "master")
add("names_join", f"""
select cusip, date, {rs('prc', 'vol')}, ticker from stock_raw join names using (cusip)""",
    "stock_raw", "names")
add("names_join_deduped", f"""
select cusip, date, {rs('prc', 'vol')}, ticker
from stock_raw join (select distinct cusip, ticker from names) using (cusip)""",
    "stock_raw", "names")
add("quotes_join_stock", f"""
select q.symbol, q.ticker, q.date, {rs('q.volume', 's.prc')}, {r('s.vol', 'volume_stock')}
from quotes q left join stock s using (ticker, date)""", "quotes", "stock")
add("rates_join", f"""
select date, ticker, {rs('atm_iv', 'skew', 'curvature')}, regime, {r('treasury_2y')}
from daily left join rates using (date)""", "daily", "rates")
add("label_join", f"""
select ticker, date, {rs('atm_iv', 'skew', 'curvature')},
    case when skew > 0.5 then regime end as regime from daily""", "daily")
add("model_union", f"""
with best as (select *, row_number() over (partition by ticker order by mae, model) as rn
              from model_results where w > 60)
select model, ticker, {r('min(mae)', 'mae')} from model_results where w = 60
group by model, ticker
union all
select 'Traditional (' || model || ')', ticker, {r('mae')} from best where rn = 1""",
    "model_results")
add("result_union", f"""
select model, ticker, w, run_id, {r('mae')} from model_results where w = 60
union all select model, ticker, w, null, {r('mae')} from model_results where w >= 60""",
    "model_results")
add("distinct_values", "select distinct ticker, cp_flag from quotes", "quotes")
add("value_counts", "select ticker, count(*) as count from quotes group by 1", "quotes")
_quote_columns = ["secid", "ticker", "date", "symbol", "cp_flag", "exdate", "strike_price",
                  "best_bid", "best_offer", "volume", "open_interest", "impl_volatility", "delta",
                  "vega", "theta"]
add("null_counts", " union all ".join(
    f"select '{c}' as column_name, count(*) filter ({c} is null) as n_missing from quotes"
    for c in _quote_columns), "quotes")
add("profile", " union all ".join(
    f"select '{c}' as column_name, '{t}' as data_type, count(*) as n_rows, "
    f"count({c}) as n_present from daily"
    for c, t in [("date", "date"), ("ticker", "string"), ("atm_iv", "double"), ("skew", "double"),
                 ("curvature", "double"), ("regime", "int")]), "daily")
add("retention", f"""
select ticker, count(*) as n_raw, count(*) filter ({LIQUID}) as n_kept,
    {r(f'count(*) filter ({LIQUID}) / cast(count(*) as double)', 'retention_rate')}
from quotes group by 1""", "quotes")
add("quantile_nearest", f"""
with {NEAREST_Q.format(column='strike_price', table='quotes', q='0.9')}
select ticker, {r('threshold', 'quantile')} from thresholds""", "quotes")
add("quantile_linear", f"""
select ticker, {r('quantile_cont(strike_price, 0.999)', 'quantile')} from quotes group by 1""",
    "quotes")
add("daily_iv_features", f"""
with base as ({TRADABLE}), {NEAREST}
select date, ticker, {r('atm_iv')}, {r('put25_iv - call25_iv', 'skew')},
    {r('(put25_iv + call25_iv) / 2 - atm_iv', 'curvature')},
    {rs('iv_std', 'avg_delta', 'avg_vega', 'avg_theta')} from smile""", "quotes")
add("atm_iv", f"with base as (select * from quotes), {NEAREST} "
    f"select date, ticker, {r('atm_iv')} from smile", "quotes")
add("wing_iv", f"with base as (select * from quotes), {NEAREST} "
    f"select date, ticker, {rs('put25_iv', 'call25_iv')} from smile", "quotes")
add("iv_std", f"select date, ticker, {r('stddev_samp(impl_volatility)', 'iv_std')} "
    "from quotes group by 1, 2", "quotes")
add("regime_profile", f"""
select regime, {r('avg(atm_iv)', 'atm_iv')}, {r('avg(skew)', 'skew')},
    {r('avg(curvature)', 'curvature')} from daily group by 1""", "daily")
_PIVOT = """wide as (select date, max(case when ticker = 'T0' then atm_iv end) as T0,
    max(case when ticker = 'T1' then atm_iv end) as T1 from daily group by 1)"""
add("metric_pivot", f"with {_PIVOT} select date, {r('T0')}, {r('T1')} from wide", "daily")
add("metric_corr", f"""
with {_PIVOT}
select 'T0' as column_a, 'T0' as column_b, {r('corr(T0, T0)', 'correlation')} from wide union all
select 'T0', 'T1', {r('corr(T0, T1)', 'correlation')} from wide union all
select 'T1', 'T0', {r('corr(T1, T0)', 'correlation')} from wide union all
select 'T1', 'T1', {r('corr(T1, T1)', 'correlation')} from wide""", "daily")
add("lead_target", f"""
select symbol, secid, date, {r('iv_30d')} from (
    select *, lead(impl_volatility, 30) over ({QUOTE_ORDER}) as iv_30d from quotes)
where iv_30d is not null""", "quotes")
add("price_differences", f"""
with joined as (select q.*, s.prc from quotes q left join stock s using (ticker, date)),
lagged as (select symbol, secid, date, {', '.join(
    f'prc - lag(prc, {d}) over w as price_diff_{d}d' for d in LAGS)} from joined
    window w as ({QUOTE_ORDER}))
select symbol, secid, date, {rs(*[f'price_diff_{d}d' for d in LAGS])} from lagged
where price_diff_233d is not null""", "quotes", "stock")
add("process_tickers", f"""
with {EXTRACT}
select ticker, secid, date, symbol,
    {rs('volume', 'prc', 'iv_30d', 'price_diff_1d', 'price_diff_233d')},
    cast(year(date) as int) as year, cast(month(date) as int) as month,
    cast(day(date) as int) as day from cleaned""", "quotes", "stock")
add("run_metadata", f"""
with {EXTRACT}
select c.ticker, {r('t.threshold', 'volume_threshold')}, n_raw as total_records_raw,
    coalesce(n_written, 0) as total_records_written,
    {r('coalesce(n_written, 0) / cast(n_raw as double)', 'filter_retention_rate')},
    coalesce(years, '') as years
from counted c left join written using (ticker) left join thresholds t using (ticker)""",
    "quotes", "stock")
add("run_summary", f"""
with {EXTRACT}
select a.ticker,
    case when n_raw is null then 'failed' when coalesce(n_written, 0) = 0 then 'empty'
         else 'success' end as status,
    case when n_raw is null then 'no quotes found' when coalesce(n_written, 0) = 0
         then 'no rows after filtering' end as reason,
    cast(0 as int) as files_created, coalesce(n_raw, 0) as records_processed,
    coalesce(n_written, 0) as records_written, {r('t.threshold', 'volume_threshold')}
from (select unnest(['T0', 'T1', 'T2', 'T3', 'T9']) as ticker) a
left join counted using (ticker) left join written using (ticker)
left join thresholds t using (ticker)""", "quotes", "stock")
add("write_read_quotes", f"""
select ticker, cast(year(date) as int) as year, date, symbol, {rs('volume', 'impl_volatility')}
from quotes where ticker in ('T1', 'T2') and year(date) between 1994 and 1996""", "quotes")
add("write_read_features", f"""
select ticker, cast(year(date) as int) as year, date, {rs('atm_iv', 'skew', 'curvature')}, regime
from daily""", "daily")
add("extract_to_files", f"""
with {EXTRACT}
select ticker, cast(year(date) as int) as year, count(*) as n_rows,
    {r('sum(iv_30d)', 'sum_iv', 6)}, 'success' as status,
    any_value(n_written) as records_written
from cleaned join written using (ticker) group by 1, 2""", "quotes", "stock")
add("write_read_metadata", f"""
select ticker, count(*) as total_records_raw, count(*) filter ({LIQUID}) as total_records_written,
    {len(_quote_columns)} as n_columns, 50000 as batch_size from quotes group by 1""", "quotes")
add("sorted_models", f"select model, ticker, w, run_id, {r('mae')} from model_results",
    "model_results")
add("first_dates", f"""
select date, ticker, {rs('atm_iv', 'skew', 'curvature')}, regime from (
    select *, row_number() over (partition by ticker, regime order by date) as rn from daily)
where rn <= 3""", "daily")
add("top_models", f"""
select model, ticker, w, run_id, {r('mae')} from (
    select *, row_number() over (partition by ticker order by mae, model, w, run_id) as rn
    from model_results) where rn <= 5""", "model_results")
add("best_model", f"""
select model, ticker, w, run_id, {r('mae')} from (
    select *, row_number() over (order by mae, run_id) as rn from model_results)
where rn = 1""", "model_results")
add("scalar_functions", f"""
select symbol, {r('(best_bid + best_offer) / 2', 'mid')},
    {r('''case when best_bid + best_offer > 0 then
        (best_offer - best_bid) / ((best_bid + best_offer) / 2) end''', 'spread')},
    {r('abs(abs(delta) - cast(0.5 as double))', 'distance')},
    {r('case when impl_volatility > cast(0.25 as double) then 0.25 else impl_volatility end',
       'capped')},
    cast(exdate - date as int) as days, lower(ticker) || '_' || lower(cp_flag) as label,
    lower(cp_flag) as part,
    'Traditional (' || lower(ticker) || '_' || lower(cp_flag) || ')' as named
from quotes""", "quotes")
add("json_round_trip", "select symbol, ticker, volume, cp_flag from quotes", "quotes")
_STATS = ", ".join(f"avg({c}) as {c}_m, stddev_pop({c}) as {c}_s"
                   for c in ("atm_iv", "skew", "curvature"))
add("standardise", f"""
with stats as (select {_STATS} from daily)
select date, ticker, {', '.join(r(f'({c} - {c}_m) / case when {c}_s = 0 then 1 else {c}_s end', c, 6)
                                for c in ('atm_iv', 'skew', 'curvature'))}, regime
from daily, stats""", "daily")
add("fit_scaler", f"""
select ticker, {', '.join(r(f'avg({c})', f'{c}__mean') + ', ' + r(f'stddev_pop({c})', f'{c}__std')
                          for c in ('atm_iv', 'skew', 'curvature'))} from daily group by 1""",
    "daily")
add("inverse_scale", f"select ticker, date, {r('atm_iv')} from daily", "daily")
add("sequences", f"with {_windows(60, 3)} select {WINDOW_COLUMNS}, {r('ys[3]', 'last_iv', 6)} "
    "from windows", "daily")
add("sequences_short", f"with {_windows(5, 2, 'short_series', 'atm_iv skew')} "
    f"select {WINDOW_COLUMNS}, {r('ys[2]', 'last_iv', 6)} from windows", "short_series")
add("sequences_too_long", f"with {_windows(60, 3, 'short_series', 'atm_iv skew')} "
    f"select {WINDOW_COLUMNS}, {r('ys[3]', 'last_iv', 6)} from windows", "short_series")
add("lookback_lookahead", f"""
select ticker, date, cast(count(*) over b as int) as n_back,
    cast(count(curvature) over a as int) as n_ahead,
    {r('sum(curvature) over b', 'sum_back', 6)}
from daily
window b as (partition by ticker order by date rows between 9 preceding and current row),
       a as (partition by ticker order by date rows between 1 following and 4 following)""",
    "daily")
add("ewma", f"with {_windows(60, 3)} select ticker, end_date, {r(EWMA, 'yhat')} from windows",
    "daily")
add("window_target", f"""
with {_windows(60, 3)}
select ticker, end_date, {r('(ys[1] + ys[2] + ys[3]) / 3', 'mean_target')},
    {r('ys[1]', 'first_target')}, 60 as width from windows""", "daily")
_ERRORS = (r("sqrt(avg((y - yhat) * (y - yhat)))", "rmse") + ", "
           + r("avg(abs(y - yhat))", "mae"))
add("ewma_eval", f"with {PAIRS} select ticker, {_ERRORS} from pairs group by 1", "daily")
add("eval_by_horizon", f"with {PAIRS} select ticker, horizon, {_ERRORS} from pairs group by 1, 2",
    "daily")
add("mean_path", f"with {PAIRS} select ticker, horizon, {r('avg(y)', 'mean_actual')}, "
    f"{r('avg(yhat)', 'mean_forecast')} from pairs group by 1, 2", "daily")
add("prediction_pairs", f"with {PAIRS} select ticker, end_date, horizon, {rs('y', 'yhat')} "
    "from pairs", "daily")
add("forecast_path", f"""
with {PAIRS}, last as (select ticker, max(end_date) as end_date from pairs group by 1)
select ticker, end_date, horizon, {rs('y', 'yhat')} from pairs join last using (ticker, end_date)
""", "daily")
_SPLIT = """
select ticker, end_date, pos as position,
    case when pos < floor(n * cast(0.6 as double)) then 'train'
         when pos < floor(n * cast(0.8 as double)) then 'validation' else 'test' end as part
from (select ticker, end_date, row_number() over ({0} order by {1}) - 1 as pos,
             count(*) over ({0}) as n from windows)"""
add("time_split", f"with {_windows(60, 3)} " + _SPLIT.format("partition by ticker", "end_date"),
    "daily")
add("time_split_global", f"with {_windows(60, 3)} " + _SPLIT.format("", "ticker, end_date"),
    "daily")
add("row_positions", f"""
select secid, date, {r('strike_price')}, symbol, row_number() over ({QUOTE_ORDER}) - 1 as position
from quotes""", "quotes")
add("regression_metrics", f"""
with {PAIRS}
select ticker, {r('avg(abs(y - yhat))', 'mae')}, {r('avg((y - yhat) * (y - yhat))', 'mse')},
    {r('sqrt(avg((y - yhat) * (y - yhat)))', 'rmse')},
    {r('1 - avg((y - yhat) * (y - yhat)) / var_pop(y)', 'r2')},
    {r('sqrt(avg((ln(1 + y) - ln(1 + yhat)) * (ln(1 + y) - ln(1 + yhat))))', 'rmsle')},
    {r('avg(abs(y - yhat) / abs(y))', 'mape')} from pairs group by 1""", "daily")
add("setup_means", f"""
select ticker, method, pca, {r('coalesce(avg(silhouette), 0)', 'mean_silhouettes')}
from setup_runs group by 1, 2, 3""", "setup_runs")
_DIMS = range(1, 65)
_CENTRES = f"""
wide as (select vec_id, label, {', '.join(f'cast(embedding[{i}] as double) as e{i}' for i in _DIMS)}
         from points),
centres as (select label as cl, count(*) as n, {', '.join(f'avg(e{i}) as c{i}' for i in _DIMS)}
            from wide group by 1),
gaps as (select label, {' + '.join(f'(e{i} - c{i}) * (e{i} - c{i})' for i in _DIMS)} as d2
         from wide join centres on label = cl)"""
add("calinski_harabasz", f"""
with {_CENTRES},
middle as (select count(*) as total, {', '.join(f'avg(e{i}) as m{i}' for i in _DIMS)} from wide),
between_groups as (select sum(n * ({' + '.join(f'(c{i} - m{i}) * (c{i} - m{i})' for i in _DIMS)})) as b,
    count(*) as k, max(total) as total from centres, middle),
within_groups as (select sum(d2) as w from gaps)
select {r('(b / (k - 1)) / (w / (total - k))', 'calinski_harabasz', 6)}
from between_groups, within_groups""", "points")
add("davies_bouldin", f"""
with {_CENTRES},
spread as (select label, avg(sqrt(d2)) as s from gaps group by 1),
scored as (select centres.*, s from centres join spread on cl = label),
ratios as (select a.cl, max((a.s + b.s) / sqrt({' + '.join(
    f'(a.c{i} - b.c{i}) * (a.c{i} - b.c{i})' for i in _DIMS)})) as worst
    from scored a join scored b on a.cl <> b.cl group by 1)
select {r('avg(worst)', 'davies_bouldin', 6)} from ratios""", "points")


def _silhouette(label: str) -> str:
    return f"""
with p as (select vec_id, {label} as label, cast(embedding as double[]) as x from points),
sizes as (select label, count(*) as n from p group by 1),
sums as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.x, b.x)) as total
         from p a, p b group by 1, 2, 3),
ab as (select vec_id, max(case when label = other then n end) as n,
        max(case when label = other and n > 1 then total / (n - 1) end) as a,
        min(case when label <> other then total / n end) as b
       from (select s.*, z.n from sums s join sizes z on s.other = z.label) group by 1)
select {{}} {r('avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end)', 'silhouette', 6)}
from ab"""


add("silhouette", _silhouette("label").format(""), "points")
add("silhouettes", " union all ".join(
    f"(select * from ({_silhouette(c).format(f'{chr(39)}{c}{chr(39)} as labeling,')}))" for c in ("label", "other")), "points")
add("silhouette_sq", f"""
with p as (select vec_id, label, cast(embedding as double[]) as x from points),
sizes as (select label, count(*) as n from p group by 1),
sums as (select a.vec_id, a.label, b.label as other,
            sum(list_distance(a.x, b.x) * list_distance(a.x, b.x)) as total
         from p a, p b group by 1, 2, 3),
ab as (select vec_id, max(case when label = other then n end) as n,
        max(case when label = other and n > 1 then total / (n - 1) end) as a,
        min(case when label <> other then total / n end) as b
       from (select s.*, z.n from sums s join sizes z on s.other = z.label) group by 1)
select {r('avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end)', 'silhouette_sq', 6)}
from ab""", "points")
add("adjusted_rand", f"""
with cells as (select label, other, cast(count(*) as double) as n from points group by 1, 2),
j as (select sum(n * (n - 1) / 2) as joint, sum(n) as total from cells),
a as (select sum(n * (n - 1) / 2) as rows_ from (select sum(n) as n from cells group by label)),
b as (select sum(n * (n - 1) / 2) as cols_ from (select sum(n) as n from cells group by other)),
e as (select joint, (rows_ + cols_) / 2 as lim, rows_ * cols_ / (total * (total - 1) / 2) as expected
      from j, a, b)
select {r('(joint - expected) / (lim - expected)', 'adjusted_rand')} from e""", "points")


def _centre_distance(centre: list[float]) -> str:
    return " + ".join(f"({c} - cast({v} as double)) * ({c} - cast({v} as double))"
                      for c, v in zip(("atm_iv", "skew", "curvature"), centre, strict=True))


_D = [_centre_distance(c) for c in ([0.12, 0.5, 0.02], [0.15, 0.9, 0.08], [0.2, 0.7, 0.05])]
add("kmeans_assign", f"""
with d as (select *, {_D[0]} as d0, {_D[1]} as d1, {_D[2]} as d2 from daily
           where atm_iv is not null and skew is not null and curvature is not null)
select date, ticker, {rs('atm_iv', 'skew', 'curvature')},
    case when d0 <= d1 and d0 <= d2 then 0 when d1 <= d2 then 1 else 2 end as regime
from d""", "daily")
add("adf_lag0", f"""
with series as (select ticker, atm_iv as y, lag(atm_iv) over (partition by ticker order by date) as level
                from daily where atm_iv is not null),
fit as (select ticker, regr_slope(y - level, level) as b, regr_sxx(y - level, level) as sxx,
            regr_syy(y - level, level) as syy, regr_sxy(y - level, level) as sxy, count(*) as n
        from series where level is not null group by 1)
select ticker, {r('b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)', 'adf_stat', 6)}, n as n_obs
from fit""", "daily")
add("histogram", f"""
with limits as (select ticker, min(strike_price) as lo, max(strike_price) as hi from quotes group by 1),
binned as (select q.ticker, lo, hi,
    cast(least(floor((strike_price - lo) / (hi - lo) * 50), 49) as int) as bin
    from quotes q join limits using (ticker) where strike_price is not null)
select ticker, bin, {r('lo + bin * (hi - lo) / 50', 'left_edge', 6)},
    {r('lo + (bin + 1) * (hi - lo) / 50', 'right_edge', 6)}, count(*) as n
from binned group by ticker, bin, lo, hi""", "quotes")
add("kde", f"""
with limits as (
    select ticker, min(strike_price) as lo, max(strike_price) as hi, count(strike_price) as n,
        stddev_samp(strike_price) * pow(cast(count(strike_price) as double), -0.2) as bandwidth
    from quotes group by 1),
binned as (
    select ticker, cast(least(floor((strike_price - lo) / (hi - lo) * 1000), 999) as int) as bin, count(*) as held
    from quotes join limits using (ticker) where strike_price is not null group by 1, 2),
placed as (
    select ticker, held, n, bandwidth, lo, hi,
        (lo + bin * ((hi - lo) / 1000) + (lo + (bin + 1) * ((hi - lo) / 1000))) / 2 as centre
    from binned join limits using (ticker)),
spread as (
    select *, cast(step as int) as grid_step, lo + step * (hi - lo) / 199 as x
    from placed, (select unnest(range(200)) as step) where bandwidth > 0)
select ticker, grid_step as step, round(min(x) + {SHIFT}, 9) + 0.0 as x,
    round(sum(exp(-((x - centre) / bandwidth) * ((x - centre) / bandwidth) / 2)
        / (bandwidth * sqrt(2 * pi())) * held / n) + {SHIFT}, 9) + 0.0 as density
from spread group by ticker, grid_step""", "quotes")
add("box_stats", f"""
with {QUANTILE_BOX}
select ticker, {r('any_value(q1)', 'q1')}, {r('any_value(med)', 'median')},
    {r('any_value(q3)', 'q3')},
    {r('min(strike_price) filter (strike_price >= q1 - 1.5 * (q3 - q1))', 'whisker_low')},
    {r('max(strike_price) filter (strike_price <= q3 + 1.5 * (q3 - q1))', 'whisker_high')},
    count(*) filter (strike_price < q1 - 1.5 * (q3 - q1) or strike_price > q3 + 1.5 * (q3 - q1))
        as n_outliers
from quotes join quartiles using (ticker) group by 1""", "quotes")
add("line_points", f"""
with g as (select date, ticker, avg(impl_volatility) as m, count(impl_volatility) as n,
           stddev_samp(impl_volatility) as s from quotes group by 1, 2)
select date, ticker, {r('m', 'mean_y')}, n,
    {r('case when n > 0 then m - 1.96 * s / sqrt(n) end', 'low')},
    {r('case when n > 0 then m + 1.96 * s / sqrt(n) end', 'high')} from g""", "quotes")
_PAIR = """
select '{a}' as column_a, '{b}' as column_b, regime,
    cast(least(floor(({a} - min_{a}) / (max_{a} - min_{a}) * 20), 19) as int) as bin_a,
    cast(least(floor(({b} - min_{b}) / (max_{b} - min_{b}) * 20), 19) as int) as bin_b,
    count(*) as n
from daily, limits where {a} is not null and {b} is not null group by 1, 2, 3, 4, 5"""
add("pair_bins", "with limits as (select "
    + ", ".join(f"min({c}) as min_{c}, max({c}) as max_{c}"
                for c in ("atm_iv", "skew", "curvature")) + " from daily) "
    + " union all ".join(_PAIR.format(a=a, b=b) for a, b in (
        ("atm_iv", "skew"), ("atm_iv", "curvature"), ("skew", "curvature"))), "daily")
add("regime_timeline", f"select ticker, date, {r('atm_iv')}, regime from daily", "daily")
add("regime_runs", """
with marked as (select ticker, date, regime, case when regime <> lag(regime) over
        (partition by ticker order by date) then 1 else 0 end as changed from daily),
runs as (select *, sum(changed) over (partition by ticker order by date) as run from marked)
select ticker, any_value(regime) as regime, min(date) as first_date, max(date) as last_date,
    count(*) as days from runs group by ticker, run""", "daily")
add("feature_extraction", f"""
with d as (select date, ticker, atm_iv, skew, curvature, regime,
           coalesce(treasury_2y, 1.0) as rate from daily left join rates using (date)),
stats as (select ticker, {_STATS}, avg(rate) as rate_m, stddev_pop(rate) as rate_s
          from d group by 1),
z as (select ticker, date, regime, (atm_iv - atm_iv_m) / atm_iv_s as atm_iv,
      (skew - skew_m) / skew_s as skew, (curvature - curvature_m) / curvature_s as curvature,
      (rate - rate_m) / rate_s as rate from d join stats using (ticker)),
{_windows(20, 5, 'z', 'atm_iv skew curvature rate')}
select w.ticker, w.end_date, 7 as width, {r('w.atm_iv', 'last_iv', 6)}, {r('w.rate', 'last_rate', 6)},
    {r('cast(case when z.regime = 0 then 1 else 0 end as double)', 'is_regime_0', 6)},
    {r('ys[5]', 'last_target', 6)}
from windows w join z on w.ticker = z.ticker and w.end_date = z.date""", "daily", "rates")
add("ewma_baseline_row", f"""
with {_windows(60, 3)},
placed as (select ticker, ys[1] as y, {EWMA} as yhat,
    row_number() over (partition by ticker order by end_date) - 1 as pos,
    count(*) over (partition by ticker) as n from windows),
pairs as (select * from placed where pos >= floor(n * cast(0.8 as double)))
select 'EWMA' as model, cast(null as double) as cv_mae, {r('avg(abs(y - yhat))', 'mae')},
    {r('avg((y - yhat) * (y - yhat))', 'mse')}, {r('sqrt(avg((y - yhat) * (y - yhat)))', 'rmse')},
    {r('1 - avg((y - yhat) * (y - yhat)) / var_pop(y)', 'r2')},
    {r('sqrt(avg((ln(1 + y) - ln(1 + yhat)) * (ln(1 + y) - ln(1 + yhat))))', 'rmsle')},
    {r('avg(abs(y - yhat) / abs(y))', 'mape')} from pairs""", "daily")
_RIDGE_PENALTY = 0.1
add("grouped_ridge", f"""
with steps as (select ticker, date, atm_iv as x1, skew as x2,
    lead(atm_iv, 1) over t as y1, lead(atm_iv, 2) over t as y2 from daily window t as (partition by ticker order by date)),
placed as (select *, row_number() over (partition by ticker order by date) - 1 as pos, count(*) over (partition by ticker) as n
    from steps where x1 is not null and x2 is not null and y1 is not null and y2 is not null),
long as (select ticker, 1 as horizon, x1, x2, y1 as y, pos >= floor(n * cast(0.8 as double)) as test from placed
    union all select ticker, 2, x1, x2, y2, pos >= floor(n * cast(0.8 as double)) from placed),
moments as (select ticker, horizon, avg(x1) as m1, avg(x2) as m2, avg(y) as my, stddev_pop(x1) as s1, stddev_pop(x2) as s2,
    stddev_pop(y) as sy, corr(x1, x2) as c, corr(x1, y) as c1, corr(x2, y) as c2 from long where not test group by 1, 2),
slopes as (select *, ((1 + {_RIDGE_PENALTY}) * c1 - c * c2) / ((1 + {_RIDGE_PENALTY}) * (1 + {_RIDGE_PENALTY}) - c * c) * sy / s1 as b1,
    ((1 + {_RIDGE_PENALTY}) * c2 - c * c1) / ((1 + {_RIDGE_PENALTY}) * (1 + {_RIDGE_PENALTY}) - c * c) * sy / s2 as b2 from moments),
gaps as (select l.ticker, l.horizon, y - (my + b1 * (x1 - m1) + b2 * (x2 - m2)) as e
    from long l join slopes s on l.ticker = s.ticker and l.horizon = s.horizon where test)
select ticker, horizon, {r('avg(abs(e))', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')} from gaps group by 1, 2""", "daily")
_WINDOW_SET = """
select ticker, date as end_date, {w} as w, {w} as steps, first_iv, skew as last_skew, y3 as last_target from (
    select *, lag(atm_iv, {w} - 1) over t as first_iv, lead(atm_iv, 1) over t as y1, lead(atm_iv, 2) over t as y2,
        lead(atm_iv, 3) over t as y3, row_number() over t as pos,
        count(case when atm_iv is not null and skew is not null and curvature is not null then 1 end)
            over (partition by ticker order by date rows between {w} - 1 preceding and current row) as whole
    from daily window t as (partition by ticker order by date))
where pos >= {w} and whole = {w} and y1 is not null and y2 is not null and y3 is not null"""
add("window_sets", f"""
select ticker, end_date, w, steps, {r('first_iv')}, {r('last_skew')}, {r('last_target')}
from ({_WINDOW_SET.format(w=5)} union all {_WINDOW_SET.format(w=20)})""", "daily")
add("lead_target_by_day", f"""
with days as (select secid, date, avg(impl_volatility) as v from quotes group by 1, 2),
known as (select * from days where v is not null),
ends as (select secid, max(date) as final from days group by 1),
ahead as (select d.secid, d.date, k.date as seen, k.v, final from days d join ends using (secid)
    asof left join known k on d.secid = k.secid and d.date + 30 >= k.date)
select symbol, q.secid, q.date, {r('v', 'iv_30d')} from quotes q join ahead a on q.secid = a.secid and q.date = a.date
where seen > q.date and final >= q.date + 30""", "quotes")


def _as_of(lag: int) -> str:
    return f"asof left join priced p{lag} on j.secid = p{lag}.secid and j.date - {lag} >= p{lag}.date"


add("price_differences_by_day", f"""
with joined as (select q.*, s.prc from quotes q left join stock s using (ticker, date)),
priced as (select secid, date, max(prc) as v from joined where prc is not null group by 1, 2),
lagged as (select symbol, j.secid, j.date, {', '.join(f'j.prc - p{d}.v as price_diff_{d}d' for d in LAGS)}
    from joined j {' '.join(map(_as_of, LAGS))})
select symbol, secid, date, {rs(*[f'price_diff_{d}d' for d in LAGS])} from lagged
where price_diff_233d is not null""", "quotes", "stock")
add("pca_two_columns", f"""
with c as (select corr(atm_iv, skew) as rho from daily
    where atm_iv is not null and skew is not null and curvature is not null)
select 1 as component, {r('(1 + abs(rho)) / 2', 'ratio')}, {r('sign(rho) / 2', 'product')} from c
union all select 2, {r('(1 - abs(rho)) / 2', 'ratio')}, {r('-sign(rho) / 2', 'product')} from c""", "daily")
add("top_loadings_of_table", f"""
select component, feature, {r('loading')}, rank from (
    select cast(s_nationkey % 5 as int) as component, s_name as feature, cast(s_acctbal as double) as loading,
        row_number() over (partition by s_nationkey % 5 order by abs(s_acctbal) desc, s_name) as rank from supplier)
where rank <= 5""")
