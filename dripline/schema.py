"""Report headers, engine column names and fixed word lists of the report format."""

from __future__ import annotations

# Report header -> engine column.
HEADER_TO_COLUMN = {
    "Campaign ID": "campaign_id",
    "Campaign Name": "campaign_name",
    "Journey Name": "journey_name",
    "Channel": "channel",
    "Status": "status",
    "Day": "day",
    "Start Date": "start_date",
    "Sent": "sent",
    "Delivered": "delivered",
    "Unique Impressions": "unique_impressions",
    "Unique Clicks": "unique_clicks",
    "Unique Conversions": "unique_conversions",
    "Unique Click-Through Conversions": "ct_conversions",
    "Revenue (INR)": "revenue_inr",
}
COLUMN_TO_HEADER = {column: header for header, column in HEADER_TO_COLUMN.items()}

NUMERIC_COLUMNS = (
    "sent",
    "delivered",
    "unique_clicks",
    "ct_conversions",
    "unique_impressions",
    "unique_conversions",
    "revenue_inr",
)
STRING_COLUMNS = ("journey_name", "channel", "status", "campaign_name", "day")
DATE_COLUMNS = ("day", "start_date")

# Cell texts that pandas' CSV reader takes as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Text that stands in for a missing string value.
MISSING_LABEL = "0"

# Provenance columns of the combine step. The first two are public; the rest only order rows
# that are otherwise equal.
SOURCE_TS = "_source_ts"
SOURCE_FILE = "_source_file"
SOURCE_RANK = "_source_rank"
SOURCE_BLOCK = "_source_block"
SOURCE_ROW = "_source_row"
PROVENANCE_COLUMNS = (SOURCE_TS, SOURCE_FILE, SOURCE_RANK, SOURCE_BLOCK, SOURCE_ROW)

# Volume measures: source column -> name in results.
VOLUME_NAMES = {
    "sent": "sent",
    "delivered": "delivered",
    "unique_impressions": "impressions",
    "unique_clicks": "clicks",
    "unique_conversions": "conversions",
    "ct_conversions": "orders",
    "revenue_inr": "revenue",
}
CORE_VOLUMES = ("sent", "delivered", "unique_clicks", "ct_conversions")

DETAIL_COLUMNS = (
    "day", "campaign_name", "journey_name", "channel", "status", "sent", "delivered",
    "unique_clicks", "ct_conversions", "cost", "gtv", "roi", "user_type", "user_channel",
)
LEGACY_DETAIL_COLUMNS = (
    "campaign_name", "journey_name", "channel", "status", "sent", "delivered", "ct_conversions",
)

# Partition column of a stored analytic table.
MONTH = "report_month"
