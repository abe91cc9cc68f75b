"""DuckDB SQL for the queries of :mod:`verification.star_queries`, written apart from them."""

from __future__ import annotations

FACT = """
fact0 AS (
  SELECT concat('C', cast(l_partkey AS varchar)) AS campaign_id,
         concat('Campaign ', cast(l_partkey AS varchar)) AS campaign_name,
         concat(c_mktsegment, ' / ', o_orderpriority) AS journey_name,
         CASE l_suppkey % 6 WHEN 0 THEN 'Email' WHEN 1 THEN 'Push' WHEN 2 THEN 'SMS'
              WHEN 3 THEN 'WhatsApp' WHEN 4 THEN 'InApp' ELSE 'RCS' END AS channel,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Running'
              ELSE 'Paused' END AS status,
         cast(o_orderdate AS date) AS day,
         cast(l_shipdate AS date) AS start_date,
         l_linenumber AS source_seq,
         CASE WHEN l_linenumber = 7 THEN 0 ELSE cast(l_quantity AS bigint) * 100 END AS sent,
         CASE WHEN l_linenumber = 7 THEN 0
              ELSE cast(l_quantity AS bigint) * (100 - l_partkey % 30) END AS delivered,
         CASE WHEN l_linenumber = 7 THEN 0
              ELSE cast(l_quantity AS bigint) * (l_partkey % 50) END AS unique_impressions,
         CASE WHEN l_linenumber = 7 THEN 0
              ELSE cast(l_quantity AS bigint) * (l_suppkey % 11) END AS unique_clicks,
         CASE WHEN l_linenumber = 7 THEN 0
              ELSE cast(l_quantity AS bigint) * (l_partkey % 3) END AS unique_conversions,
         CASE WHEN l_linenumber = 7 OR l_suppkey % 11 = 0 THEN 0
              ELSE cast(l_quantity AS bigint) * (l_partkey % 2) END AS ct_conversions,
         cast(l_extendedprice AS decimal(18,2)) AS revenue_inr,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
fact AS (
  SELECT *,
         cast(sent AS decimal(18,4)) * CASE channel
           WHEN 'Email' THEN cast(0.02 AS decimal(9,4)) WHEN 'Push' THEN cast(0.01 AS decimal(9,4))
           WHEN 'SMS' THEN cast(0.11 AS decimal(9,4)) WHEN 'WhatsApp' THEN cast(0.11 AS decimal(9,4))
           ELSE cast(0 AS decimal(9,4)) END AS cost_d,
         CASE WHEN starts_with(journey_name, 'AUTOMOBILE') THEN 'NU'
              WHEN starts_with(journey_name, 'BUILDING') THEN 'RU'
              WHEN starts_with(journey_name, 'FURNITURE') THEN 'RU'
              WHEN starts_with(journey_name, 'HOUSEHOLD') THEN 'ALL' ELSE 'Unknown' END AS user_type,
         CASE WHEN starts_with(journey_name, 'AUTOMOBILE') THEN 'ALL'
              WHEN starts_with(journey_name, 'BUILDING') THEN 'OM'
              WHEN starts_with(journey_name, 'FURNITURE') THEN 'OA'
              WHEN starts_with(journey_name, 'HOUSEHOLD') THEN 'ALL' ELSE 'Unknown' END AS user_channel
  FROM fact0
)"""

RAW = "raw"


def _rint(value: str, places: int | str) -> str:
    if places == RAW:
        return value
    scaled = f"(({value}) * {float(10**places)}::double)"
    whole = (
        f"(CASE WHEN abs({scaled} - floor({scaled})) = 0.5 THEN 2 * round({scaled} / 2) "
        f"ELSE round({scaled}) END)"
    )
    return whole if places == 0 else f"{whole} / {float(10**places)}::double"


def _ratio(top: str, bottom: str, places: int | str, percent: bool) -> str:
    value = f"cast({top} AS double) / nullif(cast({bottom} AS double), 0)"
    if percent:
        value += " * 100.0::double"
    return f"CASE WHEN {bottom} > 0 THEN {_rint(value, places)} ELSE 0.0::double END"


_RATES = {
    "delivery_rate": ("delivered", "sent", True),
    "ctr": ("clicks", "delivered", True),
    "conversion_rate": ("orders", "clicks", True),
    "orders_per_sent": ("orders", "sent", True),
    "roi": ("gtv", "cost", False),
    "roi_take_rate": ("(gtv * 0.92::double)", "cost", False),
    "cost_per_order": ("cost", "orders", False),
}


def _rates(**places: int | str) -> str:
    """Rate columns with their decimal places."""
    parts = []
    for name, digits in places.items():
        top, bottom, percent = _RATES[name]
        parts.append(f"{_ratio(top, bottom, digits, percent)} AS {name}")
    return ", ".join(parts)


_CORE_SUMS = """
  cast(sum(sent) AS double) AS sent, cast(sum(delivered) AS double) AS delivered,
  cast(sum(unique_clicks) AS double) AS clicks, cast(sum(ct_conversions) AS double) AS orders,
  cast(sum(cost_d) AS double) AS cost, cast(sum(ct_conversions) AS double) * 1500.0::double AS gtv"""
_ALL_SUMS = """
  cast(count(*) AS bigint) AS campaigns,
  cast(sum(unique_impressions) AS double) AS impressions,
  cast(sum(unique_conversions) AS double) AS conversions,
  cast(sum(revenue_inr) AS double) AS revenue,""" + _CORE_SUMS

_SUMMARY_RATES = _rates(
    delivery_rate=1, ctr=2, conversion_rate=2, orders_per_sent=3,
    roi=2, roi_take_rate=2, cost_per_order=2,
)
_WEEKLY_RATES = _rates(delivery_rate=2, ctr=2, conversion_rate=2, roi=2, cost_per_order=2)
_RAW_RATES = _rates(delivery_rate=RAW, ctr=RAW, conversion_rate=RAW, roi=RAW, cost_per_order=RAW)

SUMMARY = f""",
totals AS (SELECT journey_name, {_ALL_SUMS} FROM fact GROUP BY journey_name),
summary AS (SELECT *, {_SUMMARY_RATES} FROM totals),
raw_roi AS (SELECT * EXCLUDE (revenue), {_rates(delivery_rate=1, ctr=2, conversion_rate=2, roi=RAW)} FROM totals),
legacy AS (SELECT * EXCLUDE (revenue, delivery_rate, ctr, conversion_rate, orders_per_sent),
                  delivery_rate AS v_dr, ctr AS v_ctr, conversion_rate AS v_cr,
                  orders_per_sent AS v_ord_per_sent
           FROM (SELECT *, {_rates(delivery_rate=0, ctr=1, conversion_rate=1, orders_per_sent=2, roi=2)} FROM totals))"""

KPI = f""",
kpi AS (
  SELECT *, {_RAW_RATES}
  FROM (SELECT count(DISTINCT journey_name) AS journeys,
               cast(sum(sent) AS bigint) AS sent, cast(sum(delivered) AS bigint) AS delivered,
               cast(sum(unique_clicks) AS bigint) AS clicks,
               cast(sum(ct_conversions) AS bigint) AS orders,
               cast(sum(cost_d) AS double) AS cost,
               cast(sum(ct_conversions) AS double) * 1500.0::double AS gtv
        FROM fact))"""

_ROW_RATES = ", ".join(
    f"{_ratio(top, bottom, places, percent)} AS {name}"
    for name, top, bottom, places, percent in (
        ("delivery_rate", "delivered", "sent", 2, True),
        ("ctr", "unique_clicks", "delivered", 4, True),
        ("conversion_rate", "ct_conversions", "unique_clicks", 4, True),
        ("orders_per_sent", "ct_conversions", "sent", 4, True),
        ("roi", "gtv", "cost", 2, False),
        ("roi_take_rate", "(gtv * 0.92::double)", "cost", 2, False),
        ("cost_per_order", "cost", "ct_conversions", 2, False),
    )
)
_FACT_COLUMNS = """campaign_id, campaign_name, journey_name, channel, status,
  cast(day AS varchar) AS day, cast(start_date AS varchar) AS start_date, source_seq,
  sent, delivered, unique_impressions, unique_clicks, unique_conversions, ct_conversions,
  cast(revenue_inr AS double) AS revenue_inr"""
ROWS = f""",
valued AS (
  SELECT {_FACT_COLUMNS}, user_type, user_channel, cast(cost_d AS double) AS cost,
         cast(ct_conversions AS double) * 1500.0::double AS gtv
  FROM fact),
metrics AS (SELECT *, {_ROW_RATES} FROM valued)"""
_DETAILS = """day, campaign_name, journey_name, channel, status, sent, delivered, unique_clicks,
  ct_conversions, cost, gtv, roi, user_type, user_channel"""


def _count_text(value: str) -> str:
    return f"format('{{:,}}', cast(trunc({value}) AS bigint))"


def _fixed(value: str, places: int) -> str:
    return f"format('{{:.{places}f}}', cast({value} AS double))"


def _grouped(value: str, places: int) -> str:
    return f"format('{{:,.{places}f}}', cast({value} AS double))"


def _texts(**columns: str) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


_COUNTS = {name: _count_text(name) for name in ("sent", "delivered", "clicks", "orders")}
SUMMARY_DISPLAY = "SELECT journey_name, campaigns, " + _texts(
    **_COUNTS,
    impressions=_count_text("impressions"),
    conversions=_count_text("conversions"),
    delivery_rate=_fixed("delivery_rate", 2) + " || '%'",
    ctr=_fixed("ctr", 2) + " || '%'",
    conversion_rate=_fixed("conversion_rate", 2) + " || '%'",
    orders_per_sent=_fixed("orders_per_sent", 2) + " || '%'",
    cost="'₹' || " + _grouped("cost", 2),
    gtv="'₹' || " + _grouped("gtv", 0),
    revenue="'₹' || " + _grouped("revenue", 0),
    roi=_fixed("roi", 2) + " || 'x'",
    roi_take_rate=_fixed("roi_take_rate", 2) + " || 'x'",
    cost_per_order="'₹' || " + _fixed("cost_per_order", 2),
) + " FROM summary"
COMPACT_DISPLAY = "SELECT journey_name, campaigns, " + _texts(
    **_COUNTS,
    delivery_rate=_fixed("delivery_rate", 1) + " || '%'",
    ctr=_fixed("ctr", 1) + " || '%'",
    conversion_rate=_fixed("conversion_rate", 1) + " || '%'",
    cost="'₹' || " + _grouped("cost", 0),
    gtv="'₹' || " + _grouped("gtv", 0),
    roi=_fixed("roi", 1) + " || 'x'",
) + " FROM raw_roi"
_PERIOD_TEXTS = _texts(
    **_COUNTS,
    delivery_rate=_fixed("delivery_rate", 1) + " || '%'",
    ctr=_fixed("ctr", 2) + " || '%'",
    conversion_rate=_fixed("conversion_rate", 2) + " || '%'",
    cost="'₹' || " + _grouped("cost", 0),
    gtv="'₹' || " + _grouped("gtv", 0),
    roi=_fixed("roi", 2) + " || 'x'",
    cost_per_order="'₹' || " + _fixed("cost_per_order", 0),
)
LEGACY_DISPLAY = f"""
SELECT journey_name AS "Row Labels", campaigns AS "Count of Campaign ID",
  {_count_text('sent')} AS "Sum of Sent", {_count_text('delivered')} AS "Sum of Delivered",
  {_count_text('impressions')} AS "Sum of Unique Impressions",
  {_count_text('clicks')} AS "Sum of Unique Clicks",
  {_count_text('orders')} AS "Sum of Unique Click-Through Conversions",
  cast(cast(v_dr AS bigint) AS varchar) || '%' AS v_dr, cast(v_ctr AS varchar) || '%' AS v_ctr,
  cast(v_cr AS varchar) || '%' AS v_cr, cast(v_ord_per_sent AS varchar) || '%' AS v_ord_per_sent,
  '₹ ' || {_grouped('cost', 2)} AS "Cost", {_count_text('gtv')} AS "GTV",
  '₹ ' || {_fixed('roi', 2)} AS "ROI"
FROM legacy"""
DETAILS_DISPLAY = "SELECT day, campaign_name, journey_name, channel, status, " + _texts(
    sent=_count_text("sent"),
    delivered=_count_text("delivered"),
    unique_clicks=_count_text("unique_clicks"),
    ct_conversions=_count_text("ct_conversions"),
    cost="'₹' || " + _fixed("cost", 2),
    gtv="'₹' || " + _grouped("gtv", 0),
    roi=_fixed("roi", 2) + " || 'x'",
) + ", user_type, user_channel FROM metrics"


def _grouped_by(keys: str, rates: str, groups: str | None = None) -> str:
    return f"SELECT *, {rates} FROM (SELECT {keys}, {_CORE_SUMS} FROM fact GROUP BY {groups or 'ALL'})"


_CHANNEL_RATES = _rates(delivery_rate=2, ctr=4, conversion_rate=4, roi=2, cost_per_order=2)
_FLAG = "CASE WHEN roi > 1 THEN 'good' ELSE 'bad' END AS flag"
_DAILY = _grouped_by("journey_name, cast(day AS varchar) AS day", _WEEKLY_RATES)
_WEEKLY = _grouped_by(
    "journey_name, strftime(day, '%Y-W%U') AS week, "
    "strftime(date_trunc('week', day), '%Y-%m-%d') AS week_start",
    _WEEKLY_RATES,
)

_SELECTED = """journey_name IN ('AUTOMOBILE / 1-URGENT', 'BUILDING / 2-HIGH', 'BUILDING / 5-LOW',
    'FURNITURE / 3-MEDIUM', 'MACHINERY / 1-URGENT', 'MACHINERY / 5-LOW')
  AND channel IN ('Email', 'SMS', 'WhatsApp', 'InApp') AND status IN ('Completed', 'Running')
  AND user_type IN ('RU', 'Unknown')
  AND day >= DATE '1996-03-01' AND day <= DATE '2000-06-30'"""

_CHANNELS = ("Email", "Push", "SMS", "WhatsApp", "InApp", "RCS")
_FOUR = ("Email", "Push", "SMS", "WhatsApp")


def _pivot(metric: str, total: str = "Total") -> str:
    cells = ", ".join(
        f"""cast(coalesce(sum({metric}) FILTER (WHERE channel = '{c}'), 0) AS double) AS "{c}\""""
        for c in _CHANNELS
    )
    return f"SELECT journey_name, {cells}, cast(sum({metric}) AS double) AS {total} FROM fact GROUP BY ALL"


# A cell for each channel of a block in which the journey has rows.
_PIVOT_CELLS = """
SELECT * EXCLUDE (n) FROM (
  SELECT j.journey_name, c.channel, c.block,
         cast(coalesce(sum(f.sent), 0) AS double) AS sent,
         cast(coalesce(sum(f.delivered), 0) AS double) AS delivered,
         cast(coalesce(sum(f.unique_clicks), 0) AS double) AS clicks,
         cast(coalesce(sum(f.ct_conversions), 0) AS double) AS orders,
         cast(coalesce(sum(f.cost_d), 0) AS double) AS cost,
         cast(coalesce(sum(f.ct_conversions), 0) * 1500 AS double) AS gtv,
         count(f.channel) AS n
  FROM (SELECT DISTINCT journey_name FROM fact) j
  CROSS JOIN (SELECT channel, cast((row_number() OVER (ORDER BY channel) - 1) // 4 AS integer) AS block
              FROM (SELECT DISTINCT channel FROM fact)) c
  LEFT JOIN fact f ON f.journey_name = j.journey_name AND f.channel = c.channel
  GROUP BY j.journey_name, c.channel, c.block)
QUALIFY sum(n) OVER (PARTITION BY journey_name, block) > 0"""


_BREAKDOWN = (("sent", "Sent"), ("delivered", "Delivered"), ("ct_conversions", "Conversions"))


def _four(metric: str, channel: str) -> str:
    return f"coalesce(sum({metric}) FILTER (WHERE channel = '{channel}'), 0)"


def _breakdown(text: bool, over_four: bool) -> str:
    columns = ["journey_name AS row_labels" if text else "journey_name"]
    for metric, suffix in _BREAKDOWN:
        for channel in _FOUR:
            cell = _four(metric, channel)
            if text:
                cell = f"CASE WHEN {cell} > 0 THEN format('{{:,}}', cast({cell} AS bigint)) ELSE '' END"
            else:
                cell = f"cast({cell} AS double)"
            columns.append(f"{cell} AS {channel}_{suffix}")
        total = f"sum({metric})"
        if over_four:
            total = " + ".join(_four(metric, channel) for channel in _FOUR)
        total = f"format('{{:,}}', cast({total} AS bigint))" if text else f"cast({total} AS double)"
        columns.append(f"{total} AS Total_{suffix}")
    return f"SELECT {', '.join(columns)} FROM fact GROUP BY journey_name"


def _tier(name: str) -> str:
    return f"""CASE WHEN {name} >= quantile_cont({name}, 0.9) OVER () THEN 'excellent'
      WHEN {name} >= quantile_cont({name}, 0.75) OVER () THEN 'good'
      WHEN {name} <= quantile_cont({name}, 0.1) OVER () THEN 'very_poor'
      WHEN {name} <= quantile_cont({name}, 0.25) OVER () THEN 'poor' ELSE 'none' END AS {name}_tier"""


_TIERS = ("roi", "ctr", "conversion_rate", "orders_per_sent", "delivery_rate")
_VOLUMES = ("sent", "delivered", "clicks", "orders")

_MESSY_SENT = """CASE source_seq WHEN 1 THEN format('{:,}', cast(sent AS bigint)) WHEN 2 THEN 'nan'
  WHEN 3 THEN NULL WHEN 4 THEN 'abc' WHEN 5 THEN '1d'
  WHEN 6 THEN ' ' || cast(sent AS varchar) || '.5 ' ELSE cast(sent AS varchar) END"""


def _number(text: str) -> str:
    plain = f"trim(replace(replace(coalesce({text}, '0'), ',', ''), 'nan', '0'))"
    return (
        f"CASE WHEN regexp_full_match({plain}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
        f"THEN cast({plain} AS double) ELSE 0.0::double END"
    )


REPORTED = """,
reported AS (
  SELECT * REPLACE (CASE WHEN source_seq = 3 THEN NULL ELSE start_date END AS start_date),
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS source_rank
  FROM fact),
"""
_ROW_KEY_DESC = """l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
  l_quantity DESC, l_extendedprice DESC, l_shipdate DESC"""
# The third report has no start date, so its rows sort after all dated ones.
COMBINED = REPORTED + f"""
merged AS (
  SELECT campaign_id, day, CASE WHEN source_rank = 3 THEN NULL ELSE start_date END AS start_date,
         journey_name, sent, CASE WHEN source_rank = 2 THEN NULL ELSE delivered END AS delivered,
         CASE WHEN source_rank = 2 THEN unique_clicks END AS unique_clicks,
         CASE WHEN source_rank = 3 THEN status END AS status, source_rank,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
  FROM reported),
combined AS (
  SELECT campaign_id, cast(day AS varchar) AS day, cast(start_date AS varchar) AS start_date,
         journey_name, sent, delivered, unique_clicks, status
  FROM merged
  QUALIFY row_number() OVER (PARTITION BY campaign_id, day
    ORDER BY start_date DESC NULLS FIRST, source_rank DESC, {_ROW_KEY_DESC}) = 1)"""
_COMBINED_TEXT = """SELECT campaign_id, day, start_date, journey_name, cast(sent AS varchar) AS sent,
  cast(delivered AS varchar) AS delivered, cast(unique_clicks AS varchar) AS unique_clicks, status
  FROM combined"""

_FUNNEL = " UNION ALL ".join(
    f"""SELECT {i} AS stage, '{label}' AS label, cast({name} AS double) AS value,
      {_ratio(name, 'sent', RAW, True)} AS pct_of_first,
      {_ratio(name, before, RAW, True)} AS pct_of_previous FROM kpi"""
    for i, (label, name, before) in enumerate(
        (
            ("Messages Sent", "sent", "sent"),
            ("Messages Delivered", "delivered", "sent"),
            ("Clicks Generated", "clicks", "delivered"),
            ("Orders Converted", "orders", "clicks"),
        ),
        start=1,
    )
)
_CARDS = " UNION ALL ".join(
    f"SELECT '{label}' AS label, {value} AS value, {note} AS subtitle FROM kpi"
    for label, value, note in (
        ("Messages Sent", _count_text("sent"), "cast(journeys AS varchar) || ' journeys'"),
        ("Delivered", _count_text("delivered"), _fixed("delivery_rate", 0) + " || '% delivery rate'"),
        ("Clicks", _count_text("clicks"), _fixed("ctr", 2) + " || '% CTR'"),
        ("Conversions", _count_text("orders"), _fixed("conversion_rate", 1) + " || '% conv rate'"),
        ("Total Cost", "'₹' || " + _grouped("cost", 0), "'₹' || " + _fixed("cost_per_order", 0) + " || ' per order'"),
        ("ROI", _fixed("roi", 1) + " || 'x'", "'₹' || " + _grouped("gtv", 0) + " || ' GTV'"),
    )
)

_LONG_GROUPS = {
    "sent": "volume", "delivered": "volume", "clicks": "volume", "orders": "volume",
    "delivery_rate": "performance", "ctr": "performance", "conversion_rate": "performance",
    "cost": "financial", "gtv": "financial", "roi": "financial",
}
_LONG = " UNION ALL ".join(
    f"SELECT journey_name, day, '{name}' AS metric, {name} AS value, '{group}' AS metric_group FROM daily"
    for name, group in _LONG_GROUPS.items()
)
_DATES = "cast(min(day) AS varchar) AS min_date, cast(max(day) AS varchar) AS max_date"
_REPORT_COLUMNS = "journey_name, roi, orders, cost, gtv"


def _with(*ctes: str) -> str:
    return "WITH " + FACT + "".join(ctes) + "\n"


_BODIES: dict[str, tuple[tuple[str, ...], str]] = {
    "campaign_fact": ((), f"SELECT {_FACT_COLUMNS} FROM fact"),
    "clean_numeric": (
        (),
        f"""SELECT campaign_id, cast(day AS varchar) AS day, channel, source_seq,
          {_number(_MESSY_SENT)} AS sent, cast(revenue_inr AS double) AS revenue_inr FROM fact""",
    ),
    "clean_strings": (
        (),
        """SELECT CASE WHEN source_seq = 2 THEN '0' ELSE journey_name END AS journey_name,
             CASE WHEN source_seq = 2 THEN 'Unknown' ELSE user_type END AS user_type,
             count(*) AS rows FROM fact GROUP BY ALL""",
    ),
    "parse_day": (
        (),
        """SELECT campaign_id, source_seq,
             CASE WHEN source_seq IN (1, 3, 4) THEN cast(day AS varchar)
                  WHEN source_seq = 2 THEN cast(day AS varchar) || ' 10:30:00' END AS day
           FROM fact""",
    ),
    "render_dates": (
        (),
        """SELECT campaign_id, source_seq, CASE WHEN source_seq = 2
             THEN cast(day AS varchar) || ' 10:30:00' ELSE cast(day AS varchar) END AS day,
             cast(start_date AS varchar) AS start_date FROM fact""",
    ),
    "dedupe_latest": (
        (REPORTED.rstrip().rstrip(","),),
        f"""SELECT {_FACT_COLUMNS} FROM reported
          QUALIFY row_number() OVER (PARTITION BY campaign_id, reported.day
            ORDER BY reported.start_date DESC NULLS FIRST, source_rank DESC, {_ROW_KEY_DESC}) = 1""",
    ),
    "combine_reports": ((COMBINED,), "SELECT * FROM combined"),
    "write_combined": ((COMBINED,), _COMBINED_TEXT),
    "incremental_combine": ((COMBINED,), _COMBINED_TEXT),
    "versioned_combine": ((COMBINED,), _COMBINED_TEXT),
    "combine_sound_files": ((COMBINED,), _COMBINED_TEXT),
    "load_profile": (
        (),
        f"""SELECT count(*) AS records, {_DATES}, count(DISTINCT journey_name) AS journeys,
             count(DISTINCT channel) AS channels FROM fact""",
    ),
    "user_segments": (
        (),
        """SELECT campaign_id, journey_name, user_type, user_channel,
             cast(day AS varchar) AS day, source_seq FROM fact""",
    ),
    "row_metrics": ((ROWS,), "SELECT * EXCLUDE (user_type, user_channel) FROM metrics"),
    "campaign_details": ((ROWS,), f"SELECT {_DETAILS} FROM metrics"),
    "campaign_details_legacy": (
        (),
        """SELECT campaign_name, journey_name, channel, status, sent, delivered, ct_conversions
           FROM fact""",
    ),
    "details_display": ((ROWS,), DETAILS_DISPLAY),
    **dict.fromkeys(
        ("details_page", "details_page_by_cursor"),
        (
            (ROWS,),
            f"""SELECT {_DETAILS} FROM metrics WHERE roi > 100 AND status = 'Running'
              ORDER BY {_DETAILS} LIMIT 25 OFFSET 50""",
        ),
    ),
    "table_filter": (
        (ROWS,),
        f"""SELECT * FROM (SELECT {_DETAILS} FROM metrics)
          WHERE contains(journey_name, 'URGENT') AND status IS DISTINCT FROM 'Running'
            AND sent >= 10 AND roi > 100 AND cast(day AS date) < DATE '1997-01-01'""",
    ),
    "filter_spec": (
        (),
        f"""SELECT journey_name, channel, status, count(*) AS rows, cast(sum(sent) AS double) AS sent,
             cast(min(day) AS varchar) AS first_day, cast(max(day) AS varchar) AS last_day
           FROM fact WHERE {_SELECTED} GROUP BY ALL""",
    ),
    "filter_domains": (
        (),
        " UNION ".join(
            f"SELECT '{name}' AS domain, {name} AS value FROM fact"
            for name in ("journey_name", "channel", "status", "user_type", "user_channel")
        ),
    ),
    "date_bounds": ((), f"SELECT {_DATES} FROM fact"),
    "selection_counts": (
        (),
        f"""SELECT count(DISTINCT CASE WHEN {_SELECTED} THEN journey_name END) AS journeys_shown,
             count(DISTINCT journey_name) AS journeys_total,
             cast(count(*) FILTER (WHERE {_SELECTED}) AS bigint) AS campaigns_shown,
             count(*) AS campaigns_total FROM fact""",
    ),
    "single_channel_summary": (
        (),
        f"""SELECT *, {_SUMMARY_RATES} FROM (SELECT journey_name, {_ALL_SUMS} FROM fact
          WHERE channel = 'Email' GROUP BY journey_name)""",
    ),
    "perf_filter_high_roi": ((SUMMARY,), "SELECT * FROM summary WHERE roi > 10"),
    "perf_filter_high_ctr": ((SUMMARY,), "SELECT * FROM summary WHERE ctr > 2"),
    "perf_filter_high_conv": ((SUMMARY,), "SELECT * FROM summary WHERE conversion_rate > 1"),
    "perf_filter_high_conv_per_sent": (
        (SUMMARY,),
        "SELECT * FROM summary WHERE orders_per_sent > 1",
    ),
    "perf_filter_low": ((SUMMARY,), "SELECT * FROM summary WHERE roi < 5"),
    "high_value_journeys": (
        (SUMMARY,),
        "SELECT journey_name, gtv FROM summary WHERE gtv > (SELECT quantile_cont(gtv, 0.5) FROM summary)",
    ),
    "journey_summary": ((SUMMARY,), "SELECT * FROM summary"),
    "journey_summary_from_cube": ((SUMMARY,), "SELECT * FROM summary"),
    "loaded_report": ((SUMMARY,), "SELECT * FROM summary"),
    "journey_summary_raw_roi": ((SUMMARY,), "SELECT * FROM raw_roi"),
    "legacy_summary": ((SUMMARY,), "SELECT * FROM legacy"),
    "summary_with_financials": ((SUMMARY,), "SELECT * FROM legacy"),
    "journey_financials": (
        (),
        f"""SELECT t.*, channels, {_rates(roi=2)} FROM (
              SELECT journey_name, cast(sum(sent) AS double) AS sent,
                     cast(sum(ct_conversions) AS double) AS orders,
                     cast(sum(cost_d) AS double) AS cost,
                     cast(sum(ct_conversions) AS double) * 1500.0::double AS gtv
              FROM fact GROUP BY journey_name) t
            JOIN (SELECT journey_name, string_agg(channel || ':' || cast(n AS varchar), ','
                         ORDER BY channel) AS channels
                  FROM (SELECT journey_name, channel, count(*) AS n FROM fact GROUP BY ALL)
                  GROUP BY journey_name) c USING (journey_name)""",
    ),
    "channel_performance": ((), _grouped_by("channel", _CHANNEL_RATES)),
    "daily_trends": (
        (),
        _grouped_by(
            "cast(day AS varchar) AS day",
            _rates(delivery_rate=2, ctr=4, conversion_rate=4, roi=2),
        ),
    ),
    "journey_daily": ((), _DAILY),
    "journey_weekly": ((), _WEEKLY),
    "weekly_view": (
        (),
        _WEEKLY.replace(
            "FROM fact",
            "FROM fact WHERE journey_name = 'BUILDING / 2-HIGH' AND status IN ('Completed', 'Paused')",
        ),
    ),
    "journey_weekly_iso": (
        (),
        _grouped_by(
            "journey_name, strftime(date_trunc('week', day), '%Y-%m-%d') AS week_start",
            _WEEKLY_RATES,
        ),
    ),
    "journey_daily_long": ((f",\ndaily AS ({_DAILY})",), _LONG),
    "kpi_totals": ((KPI,), "SELECT * FROM kpi"),
    "kpi_cards": ((KPI,), _CARDS),
    "portfolio_insights": (
        (KPI,),
        f"""SELECT sent AS total_sent, delivered AS total_delivered, orders AS total_orders,
             cost AS total_cost, gtv AS total_gtv, {_ratio('gtv', 'cost', RAW, False)} AS overall_roi,
             {_ratio('delivered', 'sent', RAW, True)} AS overall_delivery_rate,
             {_ratio('orders', 'delivered', RAW, True)} AS overall_conversion_rate FROM kpi""",
    ),
    "channel_volume": (
        (),
        """SELECT channel, cast(sum(sent) AS double) AS sent,
             cast(sum(delivered) AS double) AS delivered,
             cast(sum(unique_clicks) AS double) AS clicks,
             cast(sum(ct_conversions) AS double) AS orders FROM fact GROUP BY channel""",
    ),
    "channel_sent_totals": (
        (),
        """SELECT channel, cast(sum(sent) AS double) AS sent FROM fact
           WHERE channel IN ('Email', 'Push', 'SMS', 'WhatsApp') GROUP BY channel""",
    ),
    "journey_channel_totals": (
        (),
        f"SELECT journey_name, channel, {_CORE_SUMS} FROM fact GROUP BY journey_name, channel",
    ),
    "journey_totals": ((), _grouped_by("journey_name", _RAW_RATES)),
    "pivot_sent": ((), _pivot("sent")),
    "pivot_delivered": ((), _pivot("delivered")),
    "pivot_clicks": ((), _pivot("unique_clicks")),
    "pivot_orders": ((), _pivot("ct_conversions")),
    "pivot_cost": ((), _pivot("cost_d")),
    "pivot_gtv": ((), _pivot("(ct_conversions * 1500)")),
    "pivot_blocks": ((), _PIVOT_CELLS),
    "pivot_fixed": ((), _pivot("sent", "Total_Sent")),
    "channel_breakdown": ((), _breakdown(text=True, over_four=False)),
    "channel_breakdown_four": ((), _breakdown(text=True, over_four=True)),
    "channel_breakdown_wide": ((), _breakdown(text=False, over_four=False)),
    "top_roi_5": ((SUMMARY,), "SELECT * FROM summary ORDER BY roi DESC, journey_name LIMIT 5"),
    "top_roi_10": ((SUMMARY,), "SELECT * FROM summary ORDER BY roi DESC, journey_name LIMIT 10"),
    "top_roi_15": ((SUMMARY,), "SELECT * FROM summary ORDER BY roi DESC, journey_name LIMIT 15"),
    "top_roi_positive": (
        (SUMMARY,),
        "SELECT * FROM summary WHERE roi > 0 ORDER BY roi DESC, journey_name LIMIT 10",
    ),
    "bottom_roi_5": ((SUMMARY,), "SELECT * FROM summary ORDER BY roi, journey_name LIMIT 5"),
    "top_volume": ((SUMMARY,), "SELECT * FROM summary ORDER BY sent DESC, journey_name LIMIT 8"),
    "sort_performance": (
        (SUMMARY,),
        "SELECT * FROM summary ORDER BY orders_per_sent DESC, ctr DESC, journey_name",
    ),
    "sort_roi": ((SUMMARY,), "SELECT * FROM summary ORDER BY roi DESC, journey_name"),
    "sort_volume": ((SUMMARY,), "SELECT * FROM summary ORDER BY sent DESC, orders DESC, journey_name"),
    "sort_custom": ((SUMMARY,), "SELECT * FROM summary ORDER BY ctr, cost DESC, journey_name"),
    "default_journeys": (
        (),
        "SELECT DISTINCT journey_name FROM fact ORDER BY journey_name LIMIT 10",
    ),
    "first_journey_rows": ((SUMMARY,), "SELECT * FROM summary ORDER BY journey_name LIMIT 15"),
    "performance_tiers": (
        (SUMMARY,),
        f"""SELECT journey_name, {', '.join(_TIERS)}, {', '.join(_tier(n) for n in _TIERS)}
           FROM summary""",
    ),
    "high_volume_flags": (
        (SUMMARY,),
        f"""SELECT journey_name, {', '.join(_VOLUMES)}, {', '.join(
            f'{n} >= quantile_cont({n}, 0.95) OVER () AS {n}_high' for n in _VOLUMES)}
           FROM summary""",
    ),
    "conversion_funnel": ((KPI,), _FUNNEL),
    "volume_share": (
        (SUMMARY,),
        """SELECT journey_name, sent, sent / sum(sent) OVER () AS share
           FROM (SELECT * FROM summary ORDER BY sent DESC, journey_name LIMIT 8)""",
    ),
    "break_even": (
        (SUMMARY,),
        """SELECT journey_name, cost, gtv, roi, roi >= 1 AS roi_above_break_even,
             gtv >= cost AS gtv_covers_cost FROM summary""",
    ),
    "cost_vs_gtv": (
        (SUMMARY,),
        """SELECT journey_name, cost, gtv, orders, roi FROM summary
           WHERE (SELECT count(*) FROM summary) > 1 ORDER BY roi DESC, journey_name LIMIT 15""",
    ),
    "cost_vs_gtv_all": (
        (SUMMARY,),
        "SELECT journey_name, cost, gtv, orders, roi FROM summary WHERE cost > 0 AND gtv > 0",
    ),
    "sent_vs_orders": ((SUMMARY,), "SELECT journey_name, sent, orders, roi FROM raw_roi"),
    "summary_display": ((SUMMARY,), SUMMARY_DISPLAY),
    "compact_summary_display": ((SUMMARY,), COMPACT_DISPLAY),
    "legacy_display": ((SUMMARY,), LEGACY_DISPLAY),
    "daily_display": (
        (f",\ndaily AS ({_DAILY})",),
        f"SELECT journey_name, day, {_PERIOD_TEXTS} FROM daily",
    ),
    "weekly_display": (
        (f",\nweekly AS ({_WEEKLY})",),
        f"SELECT journey_name, week, week_start, {_PERIOD_TEXTS} FROM weekly",
    ),
    "journey_totals_display": (
        (f",\njourneys AS ({_grouped_by('journey_name', _RAW_RATES)})",),
        f"SELECT journey_name, {_PERIOD_TEXTS} FROM journeys",
    ),
    "report_header": (
        (),
        f"""SELECT {_DATES}, count(DISTINCT journey_name) AS journeys,
             (SELECT string_agg(channel, ', ' ORDER BY channel)
              FROM (SELECT DISTINCT channel FROM fact)) AS channels FROM fact""",
    ),
    "report_executive": ((KPI,), "SELECT * EXCLUDE (journeys, cost_per_order) FROM kpi"),
    "report_channel": (
        (),
        f"SELECT *, {_FLAG} FROM ({_grouped_by('channel', _rates(delivery_rate=1, ctr=2, conversion_rate=2, roi=1))})",
    ),
    "report_journeys": ((SUMMARY,), f"SELECT *, {_FLAG} FROM summary"),
    "report_performers": (
        (SUMMARY,),
        f"""SELECT * FROM (SELECT {_REPORT_COLUMNS}, 'top' AS side FROM summary
             ORDER BY roi DESC, journey_name LIMIT 5)
           UNION ALL SELECT * FROM (SELECT {_REPORT_COLUMNS}, 'bottom' AS side FROM summary
             ORDER BY roi, journey_name LIMIT 5)""",
    ),
    "report_volume": (
        (),
        """SELECT channel, cast(sum(sent) AS double) AS sent,
             cast(sum(delivered) AS double) AS delivered,
             cast(sum(unique_clicks) AS double) AS clicks,
             cast(sum(ct_conversions) AS double) AS orders FROM fact GROUP BY channel""",
    ),
    "report_config": (
        (),
        f"""SELECT {_DATES}, 1500.0::double AS aov, 0.08::double AS take_rate,
             'Email ₹0.02, Push ₹0.01, SMS ₹0.11, WhatsApp ₹0.11' AS unit_costs FROM fact""",
    ),
}

_BODIES["weekly_view_from_cube"] = _BODIES["weekly_view"]

ORACLE_SQL = {name: _with(*ctes) + body for name, (ctes, body) in _BODIES.items()}
