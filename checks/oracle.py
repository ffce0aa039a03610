"""DuckDB SQL with the same meaning as the registered queries.

Written from the operator definitions over the sample tables, not from the
Spark code: windows where Spark folds, row numbers where Spark cuts ranges.
"""

from __future__ import annotations

from checks.queries import (
    FACETS,
    FIXED_MOBILE_MODEL,
    FIXED_MODEL,
    HISTORY_FROM,
    HISTORY_TO,
    LATE_DAYS,
    LATE_EVERY,
    REGISTRY,
    SEARCH_TERM,
)
from checks.shape import shape_sql
from pricewake.operators.features import MOBILE_FEATURES, TABLET_FEATURES
from pricewake.operators.model import LinearModel
from pricewake.operators.signals import SIGNAL_TEXT, TREND_TEXT
from pricewake.sources.sample_tables import (
    PRICES_FROM_EVENTS,
    PRICES_FROM_LINEITEM,
    PRODUCTS_FROM_PART,
)

W = "(partition by category, product_key order by date)"
ALL = (
    "(partition by category, product_key order by date "
    "rows between unbounded preceding and unbounded following)"
)


def _over(expr: str, frame: str = "") -> str:
    return f"{expr} over (partition by category, product_key order by date {frame})"


def _last(n: int) -> str:
    return f"rows between {n - 1} preceding and current row"


ROLLING = {
    "rolling_avg_3": _over("avg(price)", _last(3)),
    "rolling_avg_7": _over("avg(price)", _last(7)),
    "rolling_std_3": f"coalesce({_over('stddev_samp(price)', _last(3))}, 0)",
}
LAGS = {
    f"price_lag_{k}": f"coalesce({_over(f'lag(price, {k})')}, {_over('first_value(price)')})"
    for k in (1, 3, 7)
}
CHANGES = {
    f"pct_change_{k}": f"coalesce(price / {_over(f'lag(price, {k})')} - 1, 0)" for k in (1, 3)
}
CALENDAR = {
    "dayofweek": "isodow(date) - 1",
    "day_of_month": "day(date)",
    "month": "month(date)",
}
SPECS = {
    "ram_normalized": "ram_gb / 16.0",
    "storage_normalized": "storage_gb / 1024.0",
    "specs_score": "ram_gb / 4.0 + storage_gb / 128.0",
}
OWN_INDEX = {"day_index": f"date_diff('day', min(date) over {ALL}, date)"}
MOBILE_INDEX = {
    "day_index": "date_diff('day', (select min(date) from daily where category = 'mobile'), date)"
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns.items())


def _bands(rows: str, counted: str) -> str:
    """1% and 99% price quantiles per product by linear interpolation from the nearer end."""

    def quantile(q: str) -> str:
        position = f"((len(p) - 1) * {q}::double)"
        low = f"cast(floor({position}) as bigint)"
        below, above = f"p[{low} + 1]", f"p[least({low} + 2, len(p))]"
        share = f"({position} - {low})"
        return (
            f"case when {share} < 0.5 then {below} + ({above} - {below}) * {share} "
            f"else {above} - ({above} - {below}) * (1 - {share}) end"
        )

    return f"""
select category, product_key, {quantile("0.01")} as q_low, {quantile("0.99")} as q_high
from (select category, product_key, list(price order by price) as p
      from {rows} where {counted} group by category, product_key)"""


TABLET_COLUMNS = {**OWN_INDEX, **CALENDAR, **ROLLING, **LAGS, **CHANGES, **SPECS}
MOBILE_COLUMNS = {**MOBILE_INDEX, **CALENDAR, **ROLLING, **LAGS, **SPECS}

BASE = {
    "products": PRODUCTS_FROM_PART.format(part="part"),
    "prices": PRICES_FROM_LINEITEM.format(lineitem="lineitem", part="part"),
    "typed": """
select id as product_id, category, name, brand, website,
       coalesce(cast(trunc(try_cast(ram_gb as double)) as integer), 0) as ram_gb,
       coalesce(cast(trunc(try_cast(storage_gb as double)) as integer), 0) as storage_gb,
       url as "URL"
from products where is_active and category in ('tablet', 'mobile')""",
    "tracked": """
select *, trim(lower(name)) || ' ' || lower(website) || ' ' || cast(ram_gb as varchar)
          || ' ' || cast(storage_gb as varchar) as product_key
from typed""",
    "observations": """
select t.*, p.id as obs_id, p.price, p.timestamp, p.date
from prices p join tracked t using (product_id)
where p.timestamp is not null and p.date is not null""",
    "daily": """
select category, product_key, date, avg(price) as price,
       first(name order by timestamp, product_id) filter (where name is not null) as name,
       first(brand order by timestamp, product_id) filter (where brand is not null) as brand,
       first(website order by timestamp, product_id) filter (where website is not null) as website,
       first(ram_gb order by timestamp, product_id) as ram_gb,
       first(storage_gb order by timestamp, product_id) as storage_gb,
       last("URL" order by timestamp, product_id) filter (where "URL" is not null) as "URL",
       min(timestamp) as timestamp
from observations where price is not null and product_key is not null
group by category, product_key, date""",
    "catalogue": """
select category, product_key,
       first(name order by date, timestamp, obs_id) filter (where name is not null) as name,
       first(brand order by date, timestamp, obs_id) filter (where brand is not null) as brand,
       first(website order by date, timestamp, obs_id) filter (where website is not null) as website,
       first(ram_gb order by date, timestamp, obs_id) as ram_gb,
       first(storage_gb order by date, timestamp, obs_id) as storage_gb,
       count(price) as n_obs
from observations where product_key is not null
group by category, product_key""",
    "movers": """
select category, product_key, name as product, upper(website) as website, first_price,
       price as last_price, (price - first_price) / first_price * 100 as change_pct,
       trunc(price) as current_price
from (
  select *, first_value(price) over o as first_price, count(*) over k as n,
         row_number() over (partition by category, product_key
                            order by date desc, timestamp desc, obs_id desc) as from_end
  from observations where product_key is not null
  window o as (partition by category, product_key order by date, timestamp, obs_id),
         k as (partition by category, product_key)
)
where from_end = 1 and n >= 2 and first_price > 0 and price is not null""",
    "trimmed": f"""
select d.* from daily d join ({_bands("daily", "true")}) b using (category, product_key)
where d.price between b.q_low and b.q_high""",
    "tablet_rows": f"""
select *, price as target, {_select(TABLET_COLUMNS)}
from (select *, count(*) over (partition by category, product_key) as n
      from trimmed where category = 'tablet')
where n >= 10""",
    "tablet_set": """
select *, row_number() over (order by product_key, category, date)
          <= floor(count(*) over () * 0.8::double) as is_train
from tablet_rows""",
    "mobile_numbered": f"""
select *, row_number() over {W} as r, count(*) over (partition by category, product_key) as n,
       lead(price) over {W} as target, {_select(MOBILE_COLUMNS)}
from daily where category = 'mobile'""",
    "mobile_bands": _bands("mobile_numbered", "r <= floor(n * 0.8::double)"),
    "mobile_gate": """
select category, product_key, n,
       count(*) filter (where r <= floor(n * 0.8::double) and inside) >= 10
       and count(*) filter (where r > floor(n * 0.8::double) and inside) >= 1
       and n - 1 >= 10 as open
from (select m.*, coalesce(m.price between b.q_low and b.q_high, false) as inside
      from mobile_numbered m left join mobile_bands b using (category, product_key))
group by category, product_key, n""",
    "mobile_set": """
select m.*, m.r <= floor((m.n - 1) * 0.8::double) as is_train
from mobile_numbered m join mobile_gate g using (category, product_key)
where g.open and m.target is not null""",
    "lag_scored": f"""
select *, row_number() over {W} <= floor(count(*) over {ALL} * 0.8::double) as is_train,
       {LAGS["price_lag_1"]} as prediction
from daily""",
    "baseline": f"""
select category, product_key, max(date) as last_date, last(price order by date) as last_price,
       last(level order by date) as forecast_price, avg(abs(price - previous)) as mae,
       count(*) as n_days
from (select *, {ROLLING["rolling_avg_7"]} as level, {LAGS["price_lag_1"]} as previous from daily)
group by category, product_key""",
    "signals": """
select *, (forecast_price - last_price) / last_price * 100 as change_pct,
       mae / last_price * 100 as volatility_pct,
       case when mae / last_price * 100 > 10 then 'volatile'
            when (forecast_price - last_price) / last_price * 100 < -2 then 'buy'
            when (forecast_price - last_price) / last_price * 100 > 2 then 'wait'
            else 'hold' end as signal,
       case when n_days >= 30 then 'High' when n_days >= 15 then 'Medium' else 'Low' end
         as confidence
from baseline""",
    "bands": """
select category, product_key, step, last_date + cast(step as integer) as date,
       forecast_price as price, greatest(forecast_price - mae, 0) as lower,
       forecast_price + mae as upper
from baseline, (select unnest(range(1, 8)) as step)""",
    "points": f"""
select category, product_key, 'history' as series, date, price as value from daily
union all
select category, product_key, 'rolling_avg_7', date, {ROLLING["rolling_avg_7"]} from daily
union all select category, product_key, 'bridge', last_date, last_price from baseline
union all select category, product_key, 'bridge', date, price from bands where step = 1
union all select category, product_key, 'forecast', date, price from bands
union all select category, product_key, 'lower', date, lower from bands
union all select category, product_key, 'upper', date, upper from bands""",
}


def _metrics(actual: str) -> str:
    error = f"(prediction - {actual})"
    residual, spread = f"sum({error} * {error})", f"(var_pop({actual}) * count({actual}))"
    return f"""count({actual}) as n_rows, avg(abs({error})) as mae,
       sqrt(avg({error} * {error})) as rmse,
       case when count({actual}) < 2 then null
            when {spread} = 0 then case when {residual} = 0 then 1 else 0 end
            else 1 - {residual} / {spread} end as r2"""


def _case(signal: str, texts: dict[str, tuple[str, ...]], part: int) -> str:
    branches = " ".join(f"when '{k}' then '{row[part]}'" for k, row in texts.items())
    return f"case {signal} {branches} end"


def _moments(rows: str, columns: list[str]) -> str:
    means = [f"select '1' as x, '{c}' as y, avg({c}) as mean_product, count(*) as n from {rows}"
             for c in columns]
    pairs = [
        f"select '{a}', '{b}', avg({a}::double * {b}::double), count(*) from {rows}"
        for i, a in enumerate(columns)
        for b in columns[i:]
    ]
    return " union all ".join(means + pairs)


# --- Least squares in SQL -------------------------------------------------
# The spec score is 4 times the scaled RAM plus 8 times the scaled storage, so
# it is left out of the elimination and the result then moved along that one
# direction to the coefficients of least norm.


def _fit_ctes(rows: str, features: tuple[str, ...], tag: str) -> dict[str, str]:
    solved = [f for f in features if f != "specs_score"]
    k = len(solved)
    columns = [*solved, "target"]
    means = ", ".join(f"avg({c}::double) as {c}" for c in columns)
    spread = ", ".join(f"stddev_pop({c}::double) as {c}" for c in columns)
    scaled = ", ".join(f"(r.{c} - m.{c}) / s.{c} as {c}" for c in columns)
    matrix = ", ".join(
        "[" + ", ".join(f"avg({a} * {b})" for b in columns) + "]" for a in solved
    )
    ram, storage = solved.index("ram_normalized") + 1, solved.index("storage_normalized") + 1
    raw = ", ".join(
        f"m[{i}][{k + 1}] * s.target / s.{c}" for i, c in enumerate(solved, start=1)
    )
    along = f"((4 * b[{ram}] + 8 * b[{storage}]) / 81)"
    final = []
    for name in features:
        if name == "specs_score":
            final.append(along)
        elif name == "ram_normalized":
            final.append(f"b[{ram}] - 4 * {along}")
        elif name == "storage_normalized":
            final.append(f"b[{storage}] - 8 * {along}")
        else:
            final.append(f"b[{solved.index(name) + 1}]")
    centred = " - ".join(f"c[{i}] * m.{f}" for i, f in enumerate(features, start=1))
    return {
        f"{tag}_train": f"select * from {rows} where is_train",
        f"{tag}_means": f"select {means}, avg(specs_score) as specs_score from {tag}_train",
        f"{tag}_spread": f"select {spread} from {tag}_train",
        f"{tag}_scaled": f"select {scaled} from {tag}_train r, {tag}_means m, {tag}_spread s",
        # Gauss-Jordan elimination, one pivot per step.
        f"{tag}_steps(k, m)": f"""
select 0, [{matrix}] from {tag}_scaled
union all
select k + 1,
  list_transform(m, lambda line, i: list_transform(line, lambda x, j:
    case when i = k + 1 then x / m[k + 1][k + 1]
         else x - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] end))
from {tag}_steps where k < {k}""",
        f"{tag}_raw": f"""
select [{raw}] as b from {tag}_steps, {tag}_spread s where k = {k}""",
        f"{tag}_weights": f"select [{', '.join(final)}] as c from {tag}_raw",
        f"{tag}_model": f"""
select c, m.target - {centred} as intercept from {tag}_weights, {tag}_means m""",
    }


def _predict(features: tuple[str, ...], alias: str = "") -> str:
    return "w.intercept + " + " + ".join(
        f"w.c[{i}] * {alias}{f}" for i, f in enumerate(features, start=1)
    )


def _coefficients(tag: str, category: str, features: tuple[str, ...], anchor: str) -> str:
    names = ", ".join(f"'{f}'" for f in features)
    return f"""
select '{category}' as category, unnest(range(0, {len(features) + 1})) as position,
       unnest([null, {names}]) as feature,
       unnest(list_concat([intercept], c)) as coefficient, {anchor} as anchor
from {tag}_model"""


_MOBILE_ANCHOR = "(select min(date) from daily where category = 'mobile')"


def _tablet_serving() -> dict[str, str]:
    return {
        "day_index": "(p.day_index + p.step + 1)",
        "dayofweek": "(isodow(p.last_date + cast(p.step + 1 as integer)) - 1)",
        "day_of_month": "day(p.last_date + cast(p.step + 1 as integer))",
        "month": "month(p.last_date + cast(p.step + 1 as integer))",
        "rolling_avg_3": "list_avg(p.recent[-3:])",
        "rolling_avg_7": "list_avg(p.recent)",
        "rolling_std_3": "list_stddev_pop(p.recent[-3:])",
        "price_lag_1": "p.recent[-1]",
        "price_lag_3": "case when len(p.recent) >= 3 then p.recent[-3] else p.recent[1] end",
        "price_lag_7": "p.recent[1]",
        "pct_change_1": "0",
        "pct_change_3": "0",
        "ram_normalized": "p.ram_normalized",
        "storage_normalized": "p.storage_normalized",
        "specs_score": "p.specs_score",
    }


def _mobile_serving() -> dict[str, str]:
    """Features of the row that the newest price belongs to."""
    row = "(p.last_date + cast(p.step as integer))"
    return {
        "day_index": "(p.day_index + p.step)",
        "dayofweek": f"(isodow({row}) - 1)",
        "day_of_month": f"day({row})",
        "month": f"month({row})",
        "rolling_avg_3": "list_avg(p.recent[-3:])",
        "rolling_avg_7": "list_avg(p.recent[-7:])",
        "rolling_std_3": "coalesce(list_stddev_samp(p.recent[-3:]), 0)",
        **{
            f"price_lag_{k}": f"case when len(p.recent) > {k} then p.recent[-{k + 1}] else p.recent[1] end"
            for k in (1, 3, 7)
        },
        **{c: f"p.{c}" for c in SPECS},
    }


def _forecast_ctes(weights: str, category: str) -> dict[str, str]:
    """Seven recursive days per product; ``weights`` has columns c and intercept."""
    mobile = category == "mobile"
    names, columns = (
        (MOBILE_FEATURES, MOBILE_COLUMNS) if mobile else (TABLET_FEATURES, TABLET_COLUMNS)
    )
    serving = _mobile_serving() if mobile else _tablet_serving()
    held = 8 if mobile else 7
    actual = f"lead(price) over {W}" if mobile else "price"
    daily = f"(select * from daily where category = '{category}')"
    recent = _over("list(price)", _last(held))
    prediction = "w.intercept + " + " + ".join(
        f"w.c[{i}] * ({serving[f]})" for i, f in enumerate(names, start=1)
    )
    scored = _predict(names, "f.")
    return {
        "fc_weights": weights,
        "fc_rows": f"""
select category, product_key, date, price, {_select(columns)}, {recent} as recent,
       {actual} as actual
from {daily}""",
        "fc_scored": f"select f.*, {scored} as prediction from fc_rows f, fc_weights w",
        "fc_state": f"""
select category, product_key, max(date) as last_date, last(price order by date) as last_price,
       last(day_index order by date) as day_index, last(recent order by date) as recent,
       last(ram_normalized order by date) as ram_normalized,
       last(storage_normalized order by date) as storage_normalized,
       last(specs_score order by date) as specs_score,
       {_metrics("actual")}, avg(price) as avg_price, min(price) as min_price,
       max(price) as max_price, count(*) as n_days
from fc_scored group by category, product_key""",
        "fc_path(category, product_key, step, last_date, day_index, ram_normalized, "
        "storage_normalized, specs_score, recent, forecast)": f"""
select category, product_key, 0, last_date, day_index, ram_normalized, storage_normalized,
       specs_score, recent, 0::double from fc_state
union all
select category, product_key, step + 1, last_date, day_index, ram_normalized,
       storage_normalized, specs_score, list_append(recent, pred)[-{held}:], pred
from (select p.*, {prediction} as pred from fc_path p, fc_weights w where p.step < 7)""",
    }


_FORECAST_DAYS = """
select s.*, p.step, s.last_date + cast(p.step as integer) as date, p.forecast,
       case when n_days >= 30 then 'High' when n_days >= 15 then 'Medium' else 'Low' end
         as confidence,
       (e.forecast - last_price) / last_price * 100 as trend_pct,
       case when (e.forecast - last_price) / last_price * 100 < -3 then 'buy'
            when (e.forecast - last_price) / last_price * 100 > 3 then 'wait'
            else 'neutral' end as trend
from fc_state s
join fc_path p on p.category = s.category and p.product_key = s.product_key and p.step >= 1
join fc_path e on e.category = s.category and e.product_key = s.product_key and e.step = 7"""

_TABLET_FIT = _fit_ctes("tablet_set", TABLET_FEATURES, "tablet")
_MOBILE_FIT = _fit_ctes("mobile_set", MOBILE_FEATURES, "mobile")
_TABLET_FORECAST = {
    **_TABLET_FIT,
    **_forecast_ctes("select c, intercept from tablet_model", "tablet"),
}
_MOBILE_FORECAST = {
    **_MOBILE_FIT,
    **_forecast_ctes("select c, intercept from mobile_model", "mobile"),
}


def _fixed_forecast(model: LinearModel) -> dict[str, str]:
    coefficients = "[" + ", ".join(map(repr, model.coefficients)) + "]"
    return _forecast_ctes(
        f"select {coefficients}::double[] as c, {model.intercept!r}::double as intercept",
        model.category,
    )


_TABLET_SCORED = f"""
select r.*, {_predict(TABLET_FEATURES, "r.")} as prediction
from tablet_set r, tablet_model w"""
_MOBILE_SCORED = f"""
select r.*, {_predict(MOBILE_FEATURES, "r.")} as prediction
from mobile_set r, mobile_model w"""

_FITTED = {"category": "category", "is_train": "is_train", "target": "target", "prediction": "prediction"}
_BOTH_SCORED = {
    **_TABLET_FIT,
    **_MOBILE_FIT,
    "both_scored": f"""
select {_select(_FITTED)} from ({_TABLET_SCORED})
union all select {_select(_FITTED)} from ({_MOBILE_SCORED})""",
}

_IN_FACETS = " and ".join(
    f"{column} in ({', '.join(repr(v) for v in FACETS[facet])})"
    for column, facet in (
        ("brand", "brands"),
        ("website", "websites"),
        ("ram_gb", "rams"),
        ("storage_gb", "storages"),
    )
)
_EGP = "'EGP ' || format('{{:,.0f}}', {0})"
_PCT = "format('{{:.1f}}', {0}) || '%'"


def _egp(expr: str) -> str:
    return _EGP.format(expr)


def _pct(expr: str) -> str:
    return _PCT.format(expr)


def _plus(text: str) -> str:
    """The text with a plus in front unless it has a minus."""
    return f"case when starts_with({text}, '-') then '' else '+' end || {text}"


_SEARCH = f"regexp_matches(name, '{SEARCH_TERM}', 'i')"
_LONG_DATE = "strftime({0}, '%A, %B %d')"
_CARDS = """
select s.*, c.name, c.ram_gb, c.storage_gb, upper(c.website) as website,
       upper(c.brand[1]) || lower(c.brand[2:]) as brand, forecast_price - last_price as change
from signals s join catalogue c using (category, product_key)"""

# name -> (extra CTEs, body)
BODIES: dict[str, tuple[dict[str, str], str]] = {
    "scan_counts": (
        {},
        """select 'products' as table_name, count(*) as n_rows from products
           union all select 'price_history', count(*) from prices""",
    ),
    "active_products": ({}, "select * from products where is_active"),
    "clean_observations": ({}, "select * from observations"),
    "product_key": ({}, "select * from tracked"),
    "semi_join_prices": (
        {},
        "select * from prices where product_id in (select id from products where is_active)",
    ),
    "search_products": ({}, f"select * from observations where {_SEARCH}"),
    "facet_filter": ({}, f"select * from observations where {_IN_FACETS}"),
    "facet_values": (
        {"found": f"select * from observations where {_SEARCH}"},
        " union ".join(
            f"select category, '{c}' as facet, cast({c} as varchar) as value from found"
            for c in ("brand", "website", "ram_gb", "storage_gb")
        ),
    ),
    "product_history": (
        {},
        """select * from observations where (category, product_key) in (
             select (category, product_key) from catalogue
             order by n_obs desc, product_key, category limit 3)""",
    ),
    "history_range": (
        {},
        f"select * from daily where date between date '{HISTORY_FROM}' and date '{HISTORY_TO}'",
    ),
    "daily_prices": ({}, "select * from daily"),
    "daily_means": (
        {"event_prices": PRICES_FROM_EVENTS.format(events="events")},
        """select product_id, date, avg(price) as price, count(price) as n_obs,
                  min(timestamp) as timestamp
           from event_prices where price is not null group by product_id, date""",
    ),
    "catalogue": ({}, "select * from catalogue"),
    "distinct_keys": (
        {},
        "select distinct category, product_key from observations where product_key is not null",
    ),
    "latest_url": (
        {},
        """select category, product_key, "URL" from (
             select *, row_number() over (partition by category, product_key
                       order by date desc, timestamp desc, obs_id desc) as from_end
             from observations where product_key is not null)
           where from_end = 1 and "URL" is not null and "URL" not in ('', 'nan')""",
    ),
    "price_stats": (
        {},
        """select category, product_key, last(price order by date) as last_price,
                  avg(price) as avg_price, min(price) as min_price, max(price) as max_price,
                  count(*) as n_days
           from daily group by category, product_key""",
    ),
    "date_bounds": (
        {},
        """select distinct category, product_key,
                  min(date) over p as first_day, max(date) over p as last_day,
                  min(date) over c as category_first_day, max(date) over c as category_last_day
           from daily window p as (partition by category, product_key),
                             c as (partition by category)""",
    ),
    "price_quantiles": (
        {},
        """select category, product_key, quantile_cont(price, 0.01) as q_low,
                  quantile_cont(price, 0.99) as q_high
           from daily group by category, product_key""",
    ),
    "eligible_products": (
        {},
        """select category, product_key, count(*) as n_obs from daily
           group by category, product_key having count(*) >= 10""",
    ),
    "trim_outliers": ({}, "select * from trimmed"),
    "market_movers": ({}, "select * from movers"),
    "top_drops": (
        {},
        """select * from movers qualify row_number() over (
             partition by category order by change_pct, product_key) <= 5""",
    ),
    "top_rises": (
        {},
        """select * from movers qualify row_number() over (
             partition by category order by change_pct desc, product_key) <= 5""",
    ),
    "top_changes": (
        {},
        """select * from movers qualify row_number() over (
             partition by category order by change_pct desc, product_key) <= 15""",
    ),
    "mover_lists": (
        {},
        """
select *, 'drop' as side, row_number() over (partition by category order by change_pct, product_key) as place
from movers qualify place <= 15
union all
select *, 'rise' as side, row_number() over (partition by category order by change_pct desc, product_key) as place
from movers qualify place <= 15""",
    ),
    "late_roll_up": (
        {
            "arrived": f"""
select * from ({PRICES_FROM_EVENTS.format(events="events")})
where price is not null and timestamp is not null
  and not (id % {LATE_EVERY} = 0
           and timestamp < (select max(ts) from events) - interval '{2 * LATE_DAYS} days')"""
        },
        """select product_id, cast(timestamp as date) as date, avg(price) as price, count(price) as n_obs,
                  min(timestamp) as timestamp
           from arrived group by all""",
    ),
    "appended_features": (
        {},
        f"""select * from (select *, {_select(TABLET_COLUMNS)} from daily where category = 'tablet')
            where date in (select distinct date from daily where category = 'tablet' order by date desc limit 3)""",
    ),
    "refit_appended": (
        {
            "whole_rows": f"""
select *, price as target, {_select(TABLET_COLUMNS)}, true as is_train from daily where category = 'tablet'""",
            **_fit_ctes("whole_rows", TABLET_FEATURES, "whole"),
        },
        _coefficients("whole", "tablet", TABLET_FEATURES, "null::date"),
    ),
    "stored_range": (
        {},
        f"select * from daily where date between date '{HISTORY_FROM}' and date '{HISTORY_TO}'",
    ),
    "stored_selection": (
        {"busiest": "select * from catalogue order by n_obs desc, category, product_key limit 3"},
        f"""select d.* from daily d join busiest using (category, product_key)
            where date between date '{HISTORY_FROM}' and date '{HISTORY_TO}'""",
    ),
    "memoised_daily": ({}, "select * from daily"),
    "stored_movers": ({}, "select * from movers"),
    "stored_catalogue": ({}, "select * from catalogue"),
    "mover_text": (
        {},
        f"""select product, website, {_pct("change_pct")} as change,
                   {_egp("current_price")} as current from movers""",
    ),
    "rolling_features": ({}, f"select *, {_select(ROLLING)} from daily"),
    "lag_features": ({}, f"select *, {_select(LAGS)} from daily"),
    "pct_change_features": ({}, f"select *, {_select(CHANGES)} from daily"),
    "calendar_features": ({}, f"select *, {_select({**OWN_INDEX, **CALENDAR})} from daily"),
    "spec_features": ({}, f"select *, {_select(SPECS)} from daily"),
    "tablet_features": (
        {},
        f"select *, {_select(TABLET_COLUMNS)} from daily where category = 'tablet'",
    ),
    "mobile_features": ({}, "select * from mobile_numbered"),
    "latest_features": ({}, "select * from mobile_numbered where r = n"),
    "next_price_target": (
        {},
        f"""select * from (select *, lead(price) over {W} as target from daily)
            where target is not null""",
    ),
    "per_product_split": ({}, "select * from lag_scored"),
    "global_split": (
        {},
        """select *, row_number() over (order by product_key, category, date)
                     <= floor(count(*) over () * 0.8::double) as is_train from daily""",
    ),
    "tablet_training_set": ({}, "select * from tablet_set"),
    "mobile_training_set": ({}, "select * from mobile_set"),
    "training_report": (
        {},
        """select 'mobile' as category, sum(n) as n_daily_rows, count(*) as n_products,
                  count(*) filter (where open) as n_eligible,
                  count(*) filter (where not open) as n_skipped,
                  sum(case when open then floor((n - 1) * 0.8::double) else 0 end) as n_train_rows,
                  sum(case when open then n - 1 - floor((n - 1) * 0.8::double) else 0 end)
                    as n_test_rows
           from mobile_gate
           union all
           select 'tablet', sum(n_days), count(*), count(*) filter (where n_kept >= 10),
                  count(*) filter (where n_kept < 10),
                  floor(sum(n_kept) filter (where n_kept >= 10) * 0.8::double),
                  sum(n_kept) filter (where n_kept >= 10)
                    - floor(sum(n_kept) filter (where n_kept >= 10) * 0.8::double)
           from (select d.category, d.product_key, count(*) as n_days, count(t.date) as n_kept
                 from daily d left join trimmed t using (category, product_key, date)
                 where d.category = 'tablet' group by all)""",
    ),
    "ols_moments": ({}, _moments("tablet_rows", [*TABLET_FEATURES, "target"])),
    "fit_tablet": (
        _TABLET_FIT,
        _coefficients("tablet", "tablet", TABLET_FEATURES, "null::date"),
    ),
    "fit_mobile": (
        _MOBILE_FIT,
        _coefficients("mobile", "mobile", MOBILE_FEATURES, _MOBILE_ANCHOR),
    ),
    "model_roundtrip": (
        _MOBILE_FIT,
        _coefficients("mobile", "mobile", MOBILE_FEATURES, _MOBILE_ANCHOR),
    ),
    "score_in_sample": (_MOBILE_FIT, _MOBILE_SCORED),
    "fit_metrics": (
        _BOTH_SCORED,
        f"select category, is_train, {_metrics('target')} from both_scored group by all",
    ),
    "fit_gap": (
        _BOTH_SCORED,
        """select *, test_mae / train_mae as gap_ratio,
                  case when test_mae / train_mae > 3 then 'large_gap' else 'healthy' end as gap
           from (select category, avg(abs(prediction - target)) filter (where is_train) as train_mae,
                        avg(abs(prediction - target)) filter (where not is_train) as test_mae
                 from both_scored group by category)""",
    ),
    "regression_metrics": (
        {},
        f"""select category, is_train, {_metrics("price")} from lag_scored
            group by category, is_train""",
    ),
    "product_metrics": (
        {},
        f"""select category, product_key, {_metrics("price")} from lag_scored
            group by category, product_key""",
    ),
    "mae_gap": (
        {},
        """select *, test_mae / train_mae as gap_ratio,
                  case when test_mae / train_mae > 3 then 'large_gap' else 'healthy' end as gap
           from (select avg(abs(prediction - price)) filter (where is_train) as train_mae,
                        avg(abs(prediction - price)) filter (where not is_train) as test_mae
                 from lag_scored)""",
    ),
    "recursive_forecast": (_TABLET_FORECAST, _FORECAST_DAYS),
    "recursive_forecast_fixed": (_fixed_forecast(FIXED_MODEL), _FORECAST_DAYS),
    "mobile_forecast": (_MOBILE_FORECAST, _FORECAST_DAYS),
    "mobile_forecast_fixed": (_fixed_forecast(FIXED_MOBILE_MODEL), _FORECAST_DAYS),
    "next_price": (
        _MOBILE_FIT,
        f"""select r.*, {_predict(MOBILE_FEATURES, "r.")} as next_price
            from mobile_numbered r, mobile_model w where r.r = r.n""",
    ),
    "forecast_calendar": (
        {},
        f"""select *, {_select(CALENDAR)}, strftime(date, '%Y-%m-%d') as iso_text,
                   {_LONG_DATE.format("date")} as long_text from bands""",
    ),
    "forecast_bands": ({}, "select * from bands"),
    "forecast_breakdown": (
        {},
        f"""select category, product_key, step, {_LONG_DATE.format("date")} as date,
                   {_egp("price")} as price, {_egp("lower")} as lower, {_egp("upper")} as upper
            from bands""",
    ),
    "forecast_export": (
        _TABLET_FORECAST,
        """select p.category, p.product_key,
                  strftime(s.last_date + cast(p.step as integer), '%Y-%m-%d') as "Date",
                  p.forecast as "Forecasted Price (EGP)",
                  greatest(p.forecast - s.mae, 0) as "Lower Bound (EGP)",
                  p.forecast + s.mae as "Upper Bound (EGP)"
           from fc_state s join fc_path p
             on p.category = s.category and p.product_key = s.product_key and p.step >= 1""",
    ),
    "chart_series": ({}, "select * from points"),
    "compare_series": ({}, "select * from points where series in ('history', 'forecast')"),
    "confidence_tier": ({}, "select * from signals"),
    "trend_signal": (
        {
            "trends": """
select *, case when change_pct < -3 then 'buy' when change_pct > 3 then 'wait'
          else 'neutral' end as trend from signals"""
        },
        f"""select *, change_pct as trend_pct, {_case("trend", TREND_TEXT, 0)} as trend_text,
                   {_case("trend", TREND_TEXT, 1)} as trend_desc from trends""",
    ),
    "buy_signal": (
        {},
        f"""select *, {_case("signal", SIGNAL_TEXT, 0)} as signal_icon,
                   {_case("signal", SIGNAL_TEXT, 1)} as signal_title,
                   case signal
                     when 'volatile' then 'Price fluctuations detected (±'
                                          || {_pct("volatility_pct")} || ')'
                     when 'buy' then 'AI model predicts a ' || {_pct("abs(change_pct)")}
                                     || ' price drop'
                     when 'wait' then 'Price expected to increase by '
                                      || {_pct("abs(change_pct)")} || ' in next 7 days'
                     else 'Price expected to remain steady (±' || {_pct("abs(change_pct)")}
                          || ')' end as signal_desc,
                   case signal
                     when 'volatile'
                       then '💡 Monitor for a few more days before making a decision'
                     when 'buy' then '✓ Best time to buy - Expected savings: '
                                     || {_egp("abs(forecast_price - last_price)")}
                     when 'wait'
                       then '⚠️ Wait for price to stabilize - Expected cost increase: '
                            || {_egp("abs(forecast_price - last_price)")}
                     else '✓ Safe to purchase now - Low volatility (±'
                          || format('{{:,.0f}}', mae) || ' EGP)' end as signal_detail
            from signals""",
    ),
    "product_summary": ({}, _CARDS),
    "compare_products": (
        {"cards": _CARDS},
        f"""select *, name as product, {_egp("last_price")} as current_text,
                   {_egp("forecast_price")} as forecast_text,
                   {_plus(_pct("change_pct"))} as change_text,
                   {_plus("format('{:,.0f}', change)")} || ' EGP' as amount_text from cards""",
    ),
}


def statement(name: str) -> str:
    extra, body = BODIES[name]
    ctes = {**BASE, **extra}
    prelude = ",\n".join(f"{n} as ({text})" for n, text in ctes.items())
    return f"with recursive {prelude}\n{shape_sql(body, REGISTRY[name][1])}"


def statements() -> dict[str, str]:
    return {name: statement(name) for name in BODIES}
