"""DuckDB SQL equivalent of every registered query."""

from __future__ import annotations

import re

_ORDER_TS = "o_orderdate + interval '1' minute * cast(o_orderkey % 1440 as int)"


def _id(prefix: str, number: str, width: int = 8) -> str:
    text = f"cast({number} as varchar)"
    return f"'{prefix}'||lpad({text}, greatest(length({text}), {width})::int, '0')"


def _uuid(text: str) -> str:
    h = f"md5({text})"
    return "||'-'||".join(f"substr({h},{a},{n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _bucket(width: str, ts: str = '"timestamp"') -> str:
    return f"time_bucket(interval '{width}', {ts}, timestamp '1970-01-01')"


def _money(x: str) -> str:
    return f"sum({x}::decimal(18,2))::double"


def _mavg(x: str) -> str:
    return f"(sum({x}::decimal(18,2))::double / nullif(count({x}),0))"


def _line(q: str = "quantity", p: str = "unit_price") -> str:
    return f"sum({q} * {p}::decimal(18,2))::double"


def _eavg(x: str) -> str:
    return f"(sum(({x})::decimal(24,6))::double / nullif(count({x}),0))"


def _pct(part: str, whole: str, digits: int) -> str:
    unit = 10 ** digits
    return (f"((({part})::bigint * {200 * unit} + ({whole})::bigint) // nullif(({whole})::bigint * 2, 0))::double"
            f" / {float(unit)}")


def _count(kind: str) -> str:
    return f"count(*) filter (event_type = '{kind}')"


def _win(width: str, keys: str, measures: str, source: str, where: str = "true", having: str = "true",
         ts: str = '"timestamp"') -> str:
    group = f", {keys}" if keys else ""
    return (f"select {_bucket(width, ts)} as window_start, {_bucket(width, ts)} + interval '{width}' as window_end"
            f"{group}, {measures} from {source} where {where} group by {_bucket(width, ts)}{group} having {having}")


_SALES = (f'count(transaction_id) as total_transactions, {_money("total_amount")} as total_revenue, '
          f'{_mavg("total_amount")} as avg_order_value')

_SEVERITY = "case when {v} >= {hi} then 'critical' when {v} >= {mid} then 'high' else 'medium' end"


def _customer_dim(source: str) -> str:
    return f"""select user_id, min("timestamp")::date as first_transaction_date,
      max("timestamp")::date as last_transaction_date, count(transaction_id) as total_transactions,
      {_money('total_amount')} as total_spent,
      {_money('total_amount')} / count(transaction_id) as avg_order_value,
      case when {_money('total_amount')} >= 1200000 then 'High Value'
           when {_money('total_amount')} >= 900000 then 'Medium Value'
           when {_money('total_amount')} >= 600000 then 'Low Value' else 'New' end as customer_segment,
      count(transaction_id) > 0 as is_active from {source} group by user_id"""


_ATTRS = ("first_transaction_date", "last_transaction_date", "total_transactions", "total_spent",
          "avg_order_value", "customer_segment", "is_active")
_DIFF = " or ".join(f"o.{a} is distinct from n.{a}" for a in _ATTRS)
_COLS = "user_id, " + ", ".join(_ATTRS)
_NCOLS = "n.user_id, " + ", ".join(f"n.{a}" for a in _ATTRS)
_OCOLS = "o.user_id, " + ", ".join(f"o.{a}" for a in _ATTRS)
_END = "timestamp '9999-12-31 23:59:59'"
_T0, _T1 = "timestamp '2000-01-01 00:00:00'", "timestamp '2001-08-02 00:00:00'"
_RANGE = "window_end between timestamp '1996-01-01' and timestamp '2000-12-31'"


def _errors(checks: list[tuple[str, str]]) -> str:
    return "concat_ws(';', " + ", ".join(f"case when {cond} then '{name}' end" for cond, name in checks) + ")"


def _lag(table: str, counter: str, job: str) -> str:
    return f"""select window_end as time, '{job}' as job,
      {_eavg(f'({counter} % 7 + 5)::double')} as latency from {table} group by window_end"""


_TREND_MEASURES = (f"count(*) as total_sales, {_money('total_amount')} as total_revenue, "
                   f"{_mavg('total_amount')} as avg_order_value, sum(quantity)::bigint as total_quantity")


def _trend(kind: str, label: str, order: str) -> str:
    return f"""select '{kind}' as period_type, ({label})::varchar as period_value, category, {_TREND_MEASURES},
      lag({_money('total_amount')}) over (partition by category order by {order}) as previous
      from fx_sales group by {label}, category"""


_DAY = "transaction_timestamp"
_TREND_OUT = """period_type, period_value, category, total_sales, total_revenue, avg_order_value, total_quantity,
  (total_revenue - previous) / nullif(previous, 0) * 100 as growth_rate, date '2001-08-02' as analysis_date"""

#: Named pieces; a query pulls in the ones it mentions.
PIECES: dict[str, str] = {
    "fx_users": f"""select c_custkey, {_id('USER_', 'c_custkey')} as user_id, r_name as country
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "fx_products": f"""select p_partkey, {_id('PROD_', 'p_partkey')} as product_id, p_name as name,
      p_type as category, p_retailprice as price from part""",
    "fx_tx": f"""select o_orderkey, cast(o_orderkey as varchar) as transaction_id, u.user_id,
      {_ORDER_TS} as "timestamp", o_totalprice as total_amount, o_orderpriority as payment_method, u.country
      from orders join fx_users u on o_custkey = c_custkey""",
    "fx_lines": """select t.transaction_id, t.user_id, t."timestamp", t.total_amount, t.payment_method, t.country,
      p.product_id, p.category, cast(l_quantity as int) as quantity, p.price as unit_price, l_linenumber, l_suppkey,
      t.o_orderkey from lineitem join fx_tx t on l_orderkey = o_orderkey join fx_products p on l_partkey = p_partkey""",
    "fx_sales": """select transaction_id,
      sha256(concat_ws('|', transaction_id, l_linenumber, product_id, l_suppkey, quantity)) as line_item_id,
      user_id, product_id, category, quantity, unit_price,
      (quantity * unit_price::decimal(18,2))::double as total_amount, 0.0::double as discount_amount,
      payment_method, country, "timestamp" as transaction_timestamp from fx_lines""",
    "fx_clicks": f"""select {_id('EVT_', 'event_id', 10)} as event_id, ts as "timestamp", u.user_id,
      u.user_id||'-'||substr(cast(ts as varchar),1,10) as session_id,
      cast(regexp_extract(props,'([0-9]+)',1) as int) as k, event_type as raw_type, value, u.country
      from events e join fx_users u on e.user_id = c_custkey""",
    "fx_views": """select event_id, case raw_type when 'view' then 'view' when 'click' then 'search'
        when 'signup' then 'filter' else 'compare' end as event_type, "timestamp", user_id, session_id,
      case when raw_type='view' then p.product_id end as product_id,
      case when raw_type='view' then p.name end as product_name,
      case when raw_type='view' then p.category end as category,
      case when raw_type='view' then p.price end as price,
      case when raw_type='view' then 5 + k end as view_duration,
      case when raw_type='click' then 'term'||cast(k % 16 as varchar) end as search_query,
      case when raw_type in ('click','signup') then k end as results_count, country, k
      from fx_clicks join fx_products p on p_partkey = k where raw_type in ('view','click','signup','error')""",
    "fx_carts": f"""select event_id, case raw_type when 'click' then 'add_to_cart' when 'error' then 'remove_from_cart'
        when 'signup' then 'update_quantity' else 'checkout' end as event_type, "timestamp", user_id, session_id,
      case when raw_type<>'purchase' then {_id('PROD_', 'k')} end as product_id,
      case when raw_type in ('click','error') then 1 + k % 3 end as quantity, value as cart_value, country, k
      from fx_clicks where raw_type in ('click','error','signup','purchase')""",
    # --- real-time tables
    "t_sales": _win("30 days", "", _SALES, "fx_tx"),
    "t_country": _win("30 days", "country", _SALES, "fx_tx"),
    "t_cart": _win("1 day", "country", f"""count(*) as total_cart_events, {_count('add_to_cart')} as adds,
      {_count('remove_from_cart')} as removes, {_count('update_quantity')} as updates,
      {_count('checkout')} as checkouts, {_mavg('cart_value')} as avg_cart_value, max(cart_value) as max_cart_value,
      case when {_count('add_to_cart')} > 0 then ({_count('add_to_cart')} - {_count('checkout')})::double
        / {_count('add_to_cart')} * 100 else 0.0::double end as abandonment_rate_pct""", "fx_carts"),
    "t_abandoned": f"""select w as window_start, w + interval '24 hours' as window_end, user_id, session_id, country,
      {_count('add_to_cart')} as items_added, max(cart_value) as abandoned_cart_value,
      max("timestamp") as last_activity, count(*) as total_events
      from (select *, {_bucket('8 hours')} - interval '8 hours' * i as w from fx_carts cross join range(3) r(i))
      group by w, user_id, session_id, country
      having {_count('add_to_cart')} > 0 and {_count('checkout')} = 0""",
    "t_sessions": _win("1 day", "user_id, session_id, country", f"""{_count('add_to_cart')} as add_count,
      {_count('remove_from_cart')} as remove_count, {_count('update_quantity')} as update_count,
      {_count('checkout')} as checkout_count, max(cart_value) as max_cart_value,
      max("timestamp") as last_activity, count(*) as total_events,
      {_count('checkout')} > 0 as session_completed""", "fx_carts"),
    "t_trending": _win("30 days", "product_id, product_name, category", """count(*) as view_count,
      count(distinct user_id) as unique_viewers, avg(view_duration) as avg_view_duration,
      max(price) as product_price""", "fx_views", "event_type='view'", "count(*) >= 10"),
    "t_category": _win("1 day", "category, country", f"""count(*) as total_views,
      count(distinct user_id) as unique_users, count(distinct product_id) as unique_products,
      avg(view_duration) as avg_view_duration, {_mavg('price')} as avg_product_price""", "fx_views",
                       "event_type='view'"),
    "t_high_value": f"""select transaction_id, user_id, "timestamp", total_amount, payment_method, country,
      'high_value' as anomaly_type, 'Transaction amount $'||cast(cast(total_amount as decimal(18,2)) as varchar)
      ||' exceeds threshold $300000' as anomaly_reason,
      {_SEVERITY.format(v='total_amount', hi=450000, mid=375000)} as severity from fx_tx where total_amount >= 300000""",
    "t_high_quantity": f"""select transaction_id, user_id, "timestamp", total_amount, payment_method, country,
      product_id, quantity, 'high_quantity' as anomaly_type,
      'Product quantity '||quantity||' exceeds threshold 40' as anomaly_reason,
      {_SEVERITY.format(v='quantity', hi=50, mid=45)} as severity from fx_lines where quantity >= 40""",
    "t_anomalies": """select "timestamp", country, anomaly_type, severity from t_high_value
      union all select "timestamp", country, anomaly_type, severity from t_high_quantity""",
    "t_stats": _win("30 days", "country", """count(*) as total_anomalies,
      count(*) filter (anomaly_type='high_value') as high_value_count,
      count(*) filter (anomaly_type='high_quantity') as high_quantity_count,
      count(*) filter (severity='critical') as critical_count,
      count(*) filter (severity='high') as high_severity_count,
      count(*) filter (severity='medium') as medium_severity_count""", "t_anomalies"),
    "t_inventory": _win("30 days", "country", f"""sum(quantity)::bigint as total_units_sold,
      count(distinct product_id) as unique_products_sold, {_line()} as total_revenue,
      count(*) filter (quantity >= 10) as fast_moving_products""", "fx_lines"),
    # --- warehouse
    "d_incoming": _customer_dim("fx_tx"),
    "d_before": _customer_dim("(select * from fx_tx where \"timestamp\" < timestamp '2000-01-01')"),
    "d_history": f"""select {_OCOLS}, {_T0} as effective_start_date,
        case when n.user_id is not null and ({_DIFF}) then {_T1} else {_END} end as effective_end_date,
        not (n.user_id is not null and ({_DIFF})) as is_current
      from d_before o left join d_incoming n on o.user_id = n.user_id
      union all select {_NCOLS}, {_T1}, {_END}, true from d_incoming n left join d_before o on o.user_id = n.user_id
      where o.user_id is null or ({_DIFF})""",
    "d_dates": """select strftime(d, '%Y%m%d')::int as date_id, d::date as date, year(d)::int as year,
      quarter(d)::int as quarter, month(d)::int as month, weekofyear(d)::int as week, day(d)::int as day,
      (dayofweek(d) + 1)::int as day_of_week, dayname(d) as day_name, monthname(d) as month_name,
      dayofweek(d) in (0, 6) as is_weekend, false as is_holiday
      from (select unnest(generate_series(date_trunc('year', min(o_orderdate)),
        date_trunc('year', max(o_orderdate)) + interval '1 year' - interval '1 day', interval '1 day')) as d
        from orders)""",
    "d_geo": """select country, region, continent, currency, timezone from (select distinct country from fx_users)
      left join (values ('AFRICA','Sub-Saharan Africa','Africa','ZAR','Africa/Johannesburg'),
        ('AMERICA','North America','Americas','USD','America/New_York'),
        ('ASIA','East Asia','Asia','JPY','Asia/Tokyo'),
        ('EUROPE','Western Europe','Europe','EUR','Europe/Berlin')) g(country, region, continent, currency, timezone)
      using (country)""",
    "a_metrics": f"""select user_id, (date '2001-08-02' - max(transaction_timestamp)::date)::int as recency_days,
      count(transaction_id) as frequency_count, {_money('total_amount')} as monetary_value,
      date '2001-08-02' as analysis_date from fx_sales group by user_id""",
    "a_scores": """select *, recency_score * 100 + frequency_score * 10 + monetary_score as rfm_score from (
      select *, case when recency_days <= 30 then 5 when recency_days <= 60 then 4 when recency_days <= 90 then 3
          when recency_days <= 180 then 2 else 1 end as recency_score,
        case when frequency_count >= 50 then 5 when frequency_count >= 40 then 4 when frequency_count >= 30 then 3
          when frequency_count >= 15 then 2 else 1 end as frequency_score,
        case when monetary_value >= 1200000 then 5 when monetary_value >= 950000 then 4
          when monetary_value >= 700000 then 3 when monetary_value >= 400000 then 2 else 1 end as monetary_score
      from a_metrics)""",
    "a_rfm": """select *, case
      when recency_score >= 4 and frequency_score >= 4 and monetary_score >= 4 then 'Champions'
      when recency_score >= 3 and frequency_score >= 3 then 'Loyal Customers'
      when recency_score >= 4 and frequency_score <= 2 then 'Promising'
      when recency_score >= 3 and monetary_score >= 4 then 'Big Spenders'
      when recency_score <= 2 and frequency_score >= 3 then 'At Risk'
      when recency_score <= 2 and frequency_score <= 2 then 'Lost' else 'Regular' end as rfm_segment from a_scores""",
    "a_segments": f"""select rfm_segment as segment_name, case rfm_segment
        when 'Champions' then 'Best customers with high recency, frequency, and monetary value'
        when 'Loyal Customers' then 'Consistent customers with good recency and frequency'
        when 'Big Spenders' then 'Customers with high monetary value'
        when 'Promising' then 'Recent customers with low frequency'
        when 'At Risk' then 'Customers who haven''t purchased recently but had good frequency'
        when 'Lost' then 'Inactive customers with low recency and frequency'
        when 'Regular' then 'Average customers who don''t fit other segments'
        else 'Unknown segment' end as segment_description,
      min(rfm_score) as min_rfm_score, max(rfm_score) as max_rfm_score, count(user_id) as customer_count,
      {_money('monetary_value')} as total_revenue, {_mavg('monetary_value')} as avg_customer_value,
      {_money('monetary_value')} / sum(frequency_count)::double as avg_order_value from a_rfm group by rfm_segment""",
    "a_performance": f"""select s.product_id, category, total_sales, total_revenue, total_quantity, avg_price,
      coalesce(v, 0) as total_views, case when v > 0 then total_sales::double / v * 100.0 end as conversion_rate
      from (select product_id, category, count(*) as total_sales, {_money('total_amount')} as total_revenue,
        sum(quantity)::bigint as total_quantity, {_mavg('unit_price')} as avg_price
        from fx_sales group by product_id, category) s
      left join (select product_id, count(*) as v from fx_views where product_id is not null group by product_id) w
      on s.product_id = w.product_id""",
    "a_ranks": """select *, total_revenue / 1000.0::double + total_sales / 10.0::double as performance_score,
      case when overall_rank <= 10 then 'Top Seller' when overall_rank <= 50 then 'High Performer'
        when overall_rank <= 200 then 'Moderate' else 'Low Performer' end as performance_tier,
      date '2001-08-02' as analysis_date from (select *,
        (dense_rank() over (partition by category order by total_revenue desc))::int as category_rank,
        (dense_rank() over (order by total_revenue desc))::int as overall_rank from a_performance)""",
    "a_trends": f"""select {_TREND_OUT} from (
      {_trend('monthly', f"strftime({_DAY}, '%Y-%m')", f"strftime({_DAY}, '%Y-%m')")} union all
      {_trend('weekly', f"isoyear({_DAY})||'-W'||lpad(weekofyear({_DAY})::varchar, 2, '0')",
              f"isoyear({_DAY})||'-W'||lpad(weekofyear({_DAY})::varchar, 2, '0')")} union all
      {_trend('quarterly', f"year({_DAY})||'-Q'||quarter({_DAY})", f"year({_DAY})||'-Q'||quarter({_DAY})")})""",
    "m_baskets": f"""select *, l_linenumber - 1 as n, ((o_orderkey + l_linenumber) % 12)::int as d,
      case when o_orderkey % 2 = 0 then (quantity * unit_price::decimal(18,2) * (l_linenumber - 1))::double
        else total_amount end as reported,
      {_uuid("transaction_id||'-'||l_linenumber||'-'||l_suppkey")} as message_id from fx_lines""",
    "m_tx": "select message_id, 'transaction' as kind, case when d = 7 then 'malformed' else " + _errors([
        ("d = 1", "required:country"),
        ("d = 0", "pattern:transaction_id"),
        ("d = 3", "pattern:user_id"),
        ("d = 4", "format:timestamp"),
        ("n < 1", "min_items:products"),
        ("n > 5", "max_items:products"),
        ("d = 6 and n > 0", "item:products[].quantity"),
        ("d = 2", "type:total_amount"),
        ("d <> 2 and reported > 50000", "maximum:total_amount"),
        ("d = 5", "enum:payment_method"),
        ("d <> 1 and country = 'MIDDLE EAST'", "enum:country"),
        ("n > 0 and abs(case when d = 6 then 0 else quantity * unit_price::decimal(18,2) * n end"
         " - reported::decimal(18,2)) > 0.01", "rule:total_mismatch"),
    ]) + " end as errors from m_baskets",
    "m_cart": f"select {_uuid('event_id')} as message_id, 'cart_event' as kind, " + _errors([
        ("k = 7", "enum:event_type"),
        ("k = 11", "pattern:session_id"),
        ("event_type <> 'checkout' and p.category = 'PROMO'", "enum:category"),
        ("event_type <> 'checkout' and k = 19", "minimum:cart_value"),
        ("c.country = 'MIDDLE EAST'", "enum:country"),
        ("k <> 7 and event_type = 'checkout' and k % 4 = 0", "rule:checkout_without_items"),
        ("k <> 7 and event_type = 'checkout' and k % 4 > 0 and k % 2 = 1", "rule:checkout_total_mismatch"),
        ("k <> 7 and event_type = 'update_quantity' and k % 3 = k % 2 + 1", "rule:quantity_unchanged"),
    ]) + " as errors from fx_carts c join fx_products p on p_partkey = k",
    "m_view": f"select {_uuid('event_id')} as message_id, 'product_view' as kind, " + _errors([
        ("event_type = 'view' and k = 3 or k = 3", "pattern:product_id"),
        ("event_type = 'view' and k = 23", "min_length:product_name"),
        ("event_type = 'view' and k = 29", "minimum:price"),
        ("event_type = 'view' and k = 31", "maximum:view_duration"),
        ("event_type = 'view' and k % 20 = 0", "type:from_search"),
        ("country = 'MIDDLE EAST'", "enum:country"),
        ("event_type = 'search' and k % 10 = 0", "rule:search_without_query"),
        ("event_type = 'compare' and k % 4 < 2", "rule:compare_too_few"),
        ("event_type = 'filter' and k * 10 > 500", "rule:price_range_inverted"),
    ]) + " as errors from fx_views",
    "m_all": "select * from m_tx union all select * from m_cart union all select * from m_view",
}

_RESOLVED_SALES = """select s.line_item_id as event_id, s.transaction_id, d.date_id, s.transaction_timestamp, s.quantity,
  s.unit_price, s.total_amount, s.discount_amount, s.payment_method, c.user_id, s.product_id, s.country
  from fx_sales s left join d_before c on s.user_id = c.user_id
  left join d_dates d on d.date = s.transaction_timestamp::date"""

_ORDERS = (f"count(distinct transaction_id) as num_orders, {_money('total_amount')} as revenue, "
           f"{_mavg('total_amount')} as avg_order_value")


BODIES: dict[str, str] = {
    "src_table": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderdate >= timestamp '1998-01-01'",
    "src_query": """select o_orderpriority as payment_method, count(*) as orders, max(o_totalprice) as largest
      from orders where o_totalprice >= 100000 group by o_orderpriority""",
    "src_stream_files": "select event_id, event_type, value from events",
    "decode_events": """select case when k <> 13 then event_id end as event_id,
      case when k <> 13 then event_type end as event_type, case when k <> 13 then "timestamp" end as "timestamp",
      case when k <> 13 then user_id end as user_id, case when k <> 13 then session_id end as session_id,
      case when k <> 13 then product_id end as product_id, case when k <> 13 then quantity end as quantity,
      case when k not in (13, 17) then cart_value end as cart_value, case when k <> 13 then country end as country,
      k = 13 as is_corrupt from fx_carts""",
    "decode_quarantine": "select '{'||event_id as value from fx_carts where k = 13",
    "cart_projection": f"""select {_uuid('event_id')} as event_id, case when k = 7 then 'wish' else event_type end as event_type,
      case when event_type = 'update_quantity' then k % 2 + 1 else quantity end as quantity,
      case when event_type = 'checkout' then ((k % 3 + 1) * (k % 4) * p.price::decimal(18,2))::double + k % 2
           when k = 19 then -1.0 else cart_value end as cart_value, c.country
      from fx_carts c join fx_products p on p_partkey = k""",
    "line_items": """select transaction_id, sha256(transaction_id||'|'||i) as line_item_id, user_id, product_id,
      quantity, unit_price, (quantity * unit_price::decimal(18,2))::double as total_amount,
      0.0::double as discount_amount, payment_method, country, "timestamp" as transaction_timestamp
      from fx_lines, unnest(range(l_linenumber - 1)) r(i)""",
    "view_events": """select event_id, event_type, user_id, session_id, product_id, "timestamp" as event_timestamp,
      view_duration, search_query, country from fx_views""",
    "cart_events": """select event_id, event_type, user_id, session_id, product_id, "timestamp" as event_timestamp,
      quantity, cart_value, country from fx_carts""",
    "ingest_rate": f"""select {_bucket('1 day', 'ts')} as window_start,
      {_bucket('1 day', 'ts')} + interval '1 day' as window_end,
      case event_type when 'purchase' then 'transactions' when 'view' then 'product_views'
        else 'cart_events' end as topic, (user_id % 3)::int as partition, count(*) as messages,
      count(*) / 86400.0::double as per_second, max(event_id) as latest_offset from events group by all""",
    "sales_per_window": "select * from t_sales",
    "sales_by_country": "select * from t_country",
    "cart_sessions": "select * from t_sessions",
    "abandoned_carts": "select * from t_abandoned",
    "cart_metrics": "select * from t_cart",
    "trending_products": "select * from t_trending",
    "category_performance": "select * from t_category",
    "search_behavior": _win("1 day", "search_query, country", """count(*) as search_count,
      count(distinct user_id) as unique_searchers, avg(results_count) as avg_results""", "fx_views",
                            "event_type='search'", "count(*) >= 2"),
    "browsing_sessions": _win("1 day", "user_id, session_id, country", f"""{_count('view')} as views,
      {_count('search')} as searches, {_count('filter')} as filters, {_count('compare')} as compares,
      count(distinct product_id) as unique_products_viewed, avg(view_duration) as avg_view_duration,
      min("timestamp") as first_activity, max("timestamp") as last_activity, count(*) as total_events,
      (floor(epoch(max("timestamp"))) - floor(epoch(min("timestamp"))))::bigint as session_duration_sec""",
                              "fx_views"),
    "activity_sessions": """with gaps as (select *, "timestamp" - lag("timestamp") over u > interval '12 hours' as fresh
        from fx_views window u as (partition by user_id order by "timestamp")),
      islands as (select *, count(*) filter (fresh) over (partition by user_id order by "timestamp") as n from gaps)
      select user_id, min("timestamp") as session_start, max("timestamp") + interval '12 hours' as session_end,
        count(*) as events, max("timestamp") as last_event from islands group by user_id, n""",
    "high_value_anomalies": "select * from t_high_value",
    "high_quantity_anomalies": "select * from t_high_quantity",
    "suspicious_patterns": f"""select *, 'suspicious_pattern' as anomaly_type,
      transaction_count||' high-value transactions totaling $'||cast(cast(total_spent as decimal(18,2)) as varchar)
      ||' in 7 days' as anomaly_reason, 'high' as severity from ({_win("7 days", "user_id, country",
      f'''count(transaction_id) as transaction_count, {_money('total_amount')} as total_spent,
      {_mavg('total_amount')} as avg_transaction, max(total_amount) as max_transaction,
      min("timestamp") as first_transaction, max("timestamp") as last_transaction''',
      "fx_tx", "total_amount >= 1000", "count(transaction_id) >= 2")})""",
    "anomaly_stats": "select * from t_stats",
    "anomaly_stats_nested": "with a as (" + f"""
      select "timestamp", country, 'high_value' as anomaly_type,
        {_SEVERITY.format(v='total_amount', hi=450000, mid=375000)} as severity from fx_lines where total_amount >= 300000
      union all select "timestamp", country, 'high_quantity',
        {_SEVERITY.format(v='quantity', hi=50, mid=45)} from fx_lines, unnest(range(l_linenumber - 1)) r(i)
        where quantity >= 40) """ + _win("30 days", "country", """count(*) as total_anomalies,
      count(*) filter (anomaly_type='high_value') as high_value_count,
      count(*) filter (anomaly_type='high_quantity') as high_quantity_count,
      count(*) filter (severity='critical') as critical_count,
      count(*) filter (severity='high') as high_severity_count,
      count(*) filter (severity='medium') as medium_severity_count""", "a"),
    "alerts_critical": """select sha256(transaction_id||'|'||anomaly_type) as alert_id, 'anomaly' as alert_type,
      severity, 'Critical anomaly detected: '||anomaly_reason as title, anomaly_reason as message,
      'AnomalyDetector' as source, false as resolved, transaction_id, user_id, total_amount, country, anomaly_type
      from t_high_value where severity = 'critical'""",
    "alerts_critical_quantity": """select sha256(concat_ws('|', transaction_id, 'high_quantity', product_id, quantity, l_linenumber))
        as alert_id, 'critical' as severity, 'Critical anomaly detected: Product quantity '||quantity||' exceeds threshold 40' as title,
      'Product quantity '||quantity||' exceeds threshold 40' as message, transaction_id, user_id, total_amount, country,
      'high_quantity' as anomaly_type from fx_lines where quantity >= 50""",
    "product_sales_velocity": _win("30 days", "product_id", f"""sum(quantity)::bigint as units_sold,
      {_line()} as total_revenue, {_mavg('unit_price')} as avg_price""", "fx_lines"),
    "inventory_by_country": _win("30 days", "product_id, country", f"""sum(quantity)::bigint as units_sold,
      {_line()} as total_revenue""", "fx_lines"),
    "high_demand_alerts": _win("30 days", "product_id", f"""sum(quantity)::bigint as units_sold,
      {_line()} as total_revenue, case when sum(quantity) >= 90 then 'critical' when sum(quantity) >= 70 then 'high'
      else 'medium' end as demand_level""", "fx_lines", having="sum(quantity) >= 50"),
    "restock_alerts": _win("30 days", "product_id, country", """sum(quantity)::bigint as units_sold,
      sum(quantity)::double / 30.0::double as sales_rate_per_day, case when sum(quantity) / 30.0::double >= 3 then 'high'
      when sum(quantity) / 30.0::double >= 2 then 'medium' else 'low' end as urgency""", "fx_lines",
                           having="sum(quantity) / 30.0::double >= 1"),
    "inventory_metrics": "select * from t_inventory",
    "stream_sales_by_country": "select * from t_country",
    "stream_dedup_sales": "select * from t_country",
    "stream_progress": """select 'sales_by_country' as job, 1::bigint as batches, count(*) as input_rows, 0::bigint as late_rows from orders
      union all select 'cart_sessions', 1, count(*), 0 from events""",
    "sink_manifest": """select event_id, event_type, user_id, session_id, product_id, "timestamp" as event_timestamp,
      quantity, cart_value, country from fx_carts""",
    "customers_incremental": "select * from d_incoming",
    "rfm_incremental": "select * from a_metrics",
    "performance_incremental": "select * from a_performance",
    "scd2_delta": "select * from d_history",
    "distinct_rollup": f"""select date_trunc('month', "timestamp") as period, category, count(*) as total_views,
      count(distinct user_id) as unique_users, count(distinct product_id) as unique_products, {_mavg('price')} as avg_product_price
      from fx_views where event_type = 'view' group by 1, 2""",
    "stream_abandoned_carts": "select * from t_abandoned",
    "stream_cart_sessions": "select * from t_sessions",
    "stream_product_velocity": _win(
        "30 days", "product_id", f"""sum(quantity)::bigint as units_sold, {_line()} as total_revenue,
      {_mavg('unit_price')} as avg_price""", "fx_lines"),
    "validate_transactions": "select message_id, errors from m_tx",
    "validate_carts": "select message_id, errors from m_cart",
    "validate_views": "select message_id, errors from m_view",
    "validation_stats": """select kind, count(*) as total_validated, count(*) filter (errors = '') as total_passed,
      count(*) filter (errors <> '') as total_failed,
      round((count(*) filter (errors = '')::double / count(*) * 100)::decimal(18,6), 4)::double as pass_rate
      from m_all group by kind""",
    "validation_errors": """select kind, nullif(string_split(errors, ';')[1], '') as error, count(*) as events
      from m_all group by 1, 2""",
    "duplicate_events": """select transaction_id||'-'||l_linenumber as event_id, count(*) as copies from fx_lines
      group by 1 having count(*) > 1""",
    "dim_date": "select * from d_dates",
    "dim_geography": "select * from d_geo",
    "dim_customers": "select * from d_incoming",
    "dim_products": """select product_id, name as product_name, category, price as base_price,
      price * 0.6::double as cost, price * 0.4::double as margin, true as is_active from fx_products""",
    "dim_current": "select * from d_history where is_current",
    "scd2_initial": f"""select *, {_T0} as effective_start_date, {_END} as effective_end_date, true as is_current
      from d_before""",
    "scd2_new": "select * from d_incoming n where not exists (select 1 from d_before o where o.user_id = n.user_id)",
    "scd2_changed": f"select {_NCOLS} from d_incoming n join d_before o on o.user_id = n.user_id where {_DIFF}",
    "scd2_as_of": """select transaction_id, t.user_id, "timestamp", customer_segment, total_transactions
      from fx_tx t left join d_history h on h.user_id = t.user_id and "timestamp" >= effective_start_date
        and "timestamp" < effective_end_date""",
    "scd2_merge": "select * from d_history",
    "fact_sales": _RESOLVED_SALES,
    "fact_sales_batch_date": _RESOLVED_SALES + " where s.transaction_timestamp::date = date '1998-10-03'",
    "fact_product_views": """select v.event_id, d.date_id, v.session_id, v.event_type,
      v."timestamp" as event_timestamp, v.view_duration, v.search_query, c.user_id, v.product_id, v.country
      from fx_views v left join d_before c on v.user_id = c.user_id
      left join d_dates d on d.date = v."timestamp"::date""",
    "fact_cart_events": """select v.event_id, d.date_id, v.session_id, v.event_type,
      v."timestamp" as event_timestamp, v.quantity, v.cart_value, c.user_id, p.product_id, v.country
      from fx_carts v left join d_before c on v.user_id = c.user_id
      left join fx_products p on p.product_id = v.product_id
      left join d_dates d on d.date = v."timestamp"::date""",
    "fact_repair": _RESOLVED_SALES.replace("d_before", "d_incoming"),
    "incremental_load": """select distinct line_item_id as event_id, transaction_id, user_id, product_id, quantity,
      total_amount, transaction_timestamp from fx_sales s where not exists (select 1 from fx_sales e
        where e.line_item_id = s.line_item_id and e.transaction_timestamp < timestamp '2000-01-01')""",
    "batch_two_days": """select line_item_id as event_id, strftime(transaction_timestamp, '%Y%m%d')::int as date_id, transaction_id,
      quantity, total_amount, transaction_timestamp from fx_sales
      where transaction_timestamp::date in (date '1998-10-03', date '2000-02-29') group by all""",
    "rfm_metrics": "select * from a_metrics",
    "rfm_scores": "select * from a_scores",
    "rfm_segments": "select * from a_rfm",
    "rfm_distribution": "select rfm_segment, count(*) as rows from a_rfm group by 1",
    "customer_segments": "select * from a_segments",
    "product_performance": "select * from a_performance",
    "product_ranks": "select * from a_ranks",
    "tier_distribution": "select performance_tier, count(*) as rows from a_ranks group by 1",
    "sales_trends": "select * from a_trends",
    "sales_trends_legacy": f"""select {_TREND_OUT} from (
      {_trend('monthly', f"strftime({_DAY}, '%Y-%m')", f"strftime({_DAY}, '%Y-%m')")} union all
      {_trend('weekly', f"weekofyear({_DAY})", f"weekofyear({_DAY})")} union all
      {_trend('quarterly', f"quarter({_DAY})", f"quarter({_DAY})")})""",
    "trends_top10": "select * from a_trends order by total_revenue desc, period_type, period_value, category limit 10",
    "category_revenue": f"""select category, {_money('total_amount')} as revenue, avg(quantity) as avg_quantity
      from fx_sales group by category""",
    "kpi_sales": f"""select {_money('total_revenue')} as total_revenue,
      sum(total_transactions)::bigint as total_transactions, {_eavg('avg_order_value')} as avg_order_value
      from t_sales where {_RANGE}""",
    "kpi_cart_conversion": f"select {_pct('sum(checkouts)', 'sum(adds)', 1)} as conversion_rate from t_cart",
    "ts_sales": f"""select window_end as time, {_money('total_revenue')} as revenue,
      sum(total_transactions)::bigint as transactions from t_sales where {_RANGE} group by 1""",
    "top_countries": f"""select country, {_money('total_revenue')} as revenue from t_country group by 1
      order by 2 desc, 1 limit 10""",
    "top_trending": """select product_name, category, view_count from (select product_id, product_name, category,
      sum(view_count)::bigint as view_count from t_trending group by all
      order by view_count desc, product_id, product_name, category limit 10)""",
    "ts_cart": """select window_end as time, sum(adds)::bigint as cart_adds, sum(checkouts)::bigint as checkouts
      from t_cart group by 1""",
    "top_abandonment": f"""select country, count(*) as abandoned_sessions, {_money('abandoned_cart_value')} as lost_revenue
      from t_abandoned group by 1 order by 3 desc, 1 limit 10""",
    "top_categories": """select category, sum(total_views)::bigint as total_views from t_category group by 1
      order by 2 desc, 1 limit 10""",
    "recent_anomalies": """select transaction_id, user_id, "timestamp", total_amount, country, severity, anomaly_reason
      from t_high_value order by "timestamp" desc, transaction_id limit 20""",
    "latency_avg": f"select {_eavg('(total_transactions % 7 + 5)::double')} as avg_latency from t_sales",
    "stream_kpis": """select 'total_windows' as metric, count(*) as value from t_sales
      union all select 'total_checkouts', sum(checkouts)::bigint from t_cart
      union all select 'anomaly_count', sum(total_anomalies)::bigint from t_stats""",
    "ts_latency": " union all ".join([
        _lag("t_sales", "total_transactions", "sales_aggregator"),
        _lag("t_cart", "total_cart_events", "cart_analyzer"),
        _lag("t_category", "total_views", "product_view_analyzer"),
        _lag("t_inventory", "total_units_sold", "inventory_tracker")]),
    "events_per_job": " union all ".join(
        f"select '{job}' as job, sum({column})::bigint as events_processed from {table}" for job, column, table in (
            ("Sales Aggregator", "total_transactions", "t_sales"),
            ("Cart Analyzer", "total_cart_events", "t_cart"),
            ("Product View Analyzer", "total_views", "t_category"),
            ("Anomaly Detector", "total_anomalies", "t_stats"),
            ("Inventory Tracker", "total_units_sold", "t_inventory"))),
    "ts_throughput": " union all ".join(
        f"select window_end as time, '{job}' as job, sum({column})::bigint as events from {table} group by 1"
        for job, column, table in (
            ("Sales Aggregator", "total_transactions", "t_sales"),
            ("Cart Analyzer", "total_cart_events", "t_cart"),
            ("Product View Analyzer", "total_views", "t_category"),
            ("Inventory Tracker", "total_units_sold", "t_inventory"))),
    "ts_severity": """select window_end as time, sum(critical_count)::bigint as critical,
      sum(high_severity_count)::bigint as high, sum(medium_severity_count)::bigint as medium from t_stats group by 1""",
    "wh_top_products": """select product_id, category, total_sales, total_revenue, conversion_rate from a_ranks
      where analysis_date = (select max(analysis_date) from a_ranks) order by total_revenue desc, product_id limit 10""",
    "wh_segment_share": f"""select segment_name, customer_count, total_revenue, avg_order_value,
      {_pct('customer_count', 'sum(customer_count) over ()', 2)} as pct_customers from a_segments""",
    "wh_daily_trend": f"""select transaction_timestamp::date as date, {_ORDERS} from fx_sales
      join d_dates d on d.date = transaction_timestamp::date group by 1 order by 1 desc limit 30""",
    "wh_conversion": f"""select category, coalesce(v, 0) as total_views, coalesce(s, 0) as total_sales,
      {_pct('coalesce(s, 0)', 'coalesce(v, 0)', 2)} as conversion_rate
      from (select distinct category from fx_products)
      left join (select category, count(distinct event_id) as v from fx_views where event_type='view' group by 1)
        using (category)
      left join (select category, count(distinct transaction_id) as s from fx_sales group by 1) using (category)""",
    "wh_clv_top": """select user_id, customer_segment, total_transactions, total_spent, avg_order_value,
      first_transaction_date, last_transaction_date from d_history where is_current
      order by total_spent desc, user_id limit 20""",
    "wh_sales_country": f"select country, {_ORDERS} from fx_sales group by 1",
    "wh_champions": """select user_id, recency_days, frequency_count, monetary_value, rfm_segment from a_rfm
      where rfm_segment = 'Champions' order by monetary_value desc, user_id limit 50""",
    "wh_hourly": f"""select date_trunc('hour', transaction_timestamp) as time, {_money('total_amount')} as revenue
      from fx_sales where transaction_timestamp between timestamp '1996-01-01' and timestamp '2000-12-31' group by 1""",
    "critical_anomalies": """select 'high_value' as anomaly_source, transaction_id, user_id, "timestamp",
      total_amount as metric_value, severity from t_high_value where severity = 'critical'
      union all select 'high_quantity', transaction_id, user_id, "timestamp", quantity::double, severity
      from t_high_quantity where severity = 'critical'""",
    "v_clv": """select user_id, customer_segment, total_transactions, total_spent as lifetime_value, avg_order_value,
      (last_transaction_date - first_transaction_date)::int as customer_lifetime_days, is_active
      from d_history where is_current and total_transactions > 0""",
    "v_top_products": """select product_id, category, total_sales, total_revenue, total_quantity, conversion_rate,
      performance_tier, analysis_date from a_ranks order by total_revenue desc, product_id limit 100""",
    "traffic_bands": """select case when hour("timestamp") in (10,11,12,13,14,19,20,21) then 'peak'
      when hour("timestamp") in (8,9,15,16,17,18,22) then 'normal' else 'low' end as band, count(*) as events
      from fx_views group by 1""",
    "category_types": """select category, count(*) as products, case
      when category like '%bolt%' or category like '%nut%' or category like '%gear%' then 'hardware'
      when category like '%ring%' then 'jewelry' else 'other' end as category_type
      from (select string_split(p_name, ' ')[-1] as category from part) group by category""",
    "search_recall": """select q as search_query, (select count(*) from fx_products
        where contains(lower(name), q) or contains(lower(category), q)) as results_count
      from (select distinct lower(case k % 3 when 0 then string_split(p_name, ' ')[-1]
        when 1 then substr(p_type, 1, 2) else 'term'||k end) as q
        from fx_clicks join part on p_partkey = k where raw_type = 'click')""",
    "price_band_counts": """with b as (select category, lo, hi from fx_products
        join (values (900.0::double, 920.0::double), (920, 950), (950, 1000)) v(lo, hi) on price between lo and hi)
      select category as filter_category, null::double as min_price, null::double as max_price,
        count(*) as results_count from fx_products group by 1
      union all select category, lo, hi, count(*) from b group by all
      union all select null, lo, hi, count(*) from b group by lo, hi""",
}


def _needed(text: str, seen: dict[str, None]) -> dict[str, None]:
    for name in PIECES:
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(PIECES[name], seen)
            seen[name] = None
    return seen


def sql(key: str) -> str:
    body = BODIES[key]
    pieces = ", ".join(f"{name} as ({PIECES[name]})" for name in _needed(body, {}))
    if not pieces:
        return body
    if body.startswith("with "):
        return f"with {pieces}, {body[5:]}"
    return f"with {pieces} {body}"
