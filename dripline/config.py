"""Business constants, decimal-place profiles and the session settings they assume."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

# Average order value, take rate, and price per message by channel.
AVERAGE_ORDER_VALUE = 1500
TAKE_RATE = 0.08
UNIT_COSTS = {
    "Email": "0.02",
    "Push": "0.01",
    "SMS": "0.11",
    "WhatsApp": "0.11",
}

# The four channels every legacy breakdown shows, in display order.
FIXED_CHANNELS = ("Email", "Push", "SMS", "WhatsApp")

# Journey name | user type | user channel. One line per mapped journey; the
# trailing space of the fourth line is part of the name.
_SEGMENT_TABLE = """\
Product Viewed No Plan Selected (Pan Not Given)|ALL|ALL
Wishlist Done|ALL|ALL
NU ALL Signup but No Product View|NU|ALL
NU ALL Signup but No Product View |NU|ALL
NU ALL CC but no DP|NU|ALL
NU ALL App Download but No Signup|NU|ALL
Online Mobile_NLA_OC2 to OC=<3|RU|OM
Online Mobile_NLA_OC2 to OC=&lt;3|RU|OM
Online Mobile_NLA_OC2 to OC<=3|RU|OM
Online mobile_Voucher Eligible_5th June|RU|OM
Online Apparel_AIA Eligible_28th May|RU|OA
Online Mobile_PL Eligible_27th May|RU|OM
Online Mobile_NLA_OC1 to OC2_5th_Dec_2024(V2)|RU|OM
OM_CC_But_No_DP_EMI_(Updated)|RU|OM
Online Apparel_PL Eligible_27th May(v2)|RU|OA
OA CC but no DP|RU|OA
Online Apparel_Voucher Eligible_8th June|RU|OA
Online Apparel - NLA 1 - Order 1 --> 2|RU|OA
Online Mobile_AIA Eligible_22nd_April(Updated)|RU|OM
Online Apparel - NLA 1 - Order 2 --> 3|RU|OA
Ixigo app download|RU|ixigo
AC (CK2MP)|RU|OA
"""

UNKNOWN_SEGMENT = "Unknown"


def _parse_segments(table: str) -> dict[str, tuple[str, str]]:
    rows = (line.split("|") for line in table.splitlines())
    return {name: (user_type, user_channel) for name, user_type, user_channel in rows}


DEFAULT_SEGMENTS: Mapping[str, tuple[str, str]] = MappingProxyType(_parse_segments(_SEGMENT_TABLE))


@dataclass(frozen=True)
class MetricConfig:
    """Parameters of cost, value and segment attribution.

    ``unit_costs`` maps channel to a decimal string, so that cost sums stay exact.
    ``segments`` maps journey name to (user type, user channel).
    """

    aov: float = AVERAGE_ORDER_VALUE
    take_rate: float = TAKE_RATE
    unit_costs: Mapping[str, str] = field(default_factory=lambda: dict(UNIT_COSTS))
    segments: Mapping[str, tuple[str, str]] = field(default_factory=lambda: DEFAULT_SEGMENTS)


UNROUNDED = None
OMIT = "omit"


@dataclass(frozen=True)
class RateProfile:
    """Decimal places per metric; ``None`` keeps full precision, ``"omit"`` drops the column."""

    delivery_rate: int | str | None = OMIT
    ctr: int | str | None = OMIT
    conversion_rate: int | str | None = OMIT
    orders_per_sent: int | str | None = OMIT
    roi: int | str | None = OMIT
    roi_take_rate: int | str | None = OMIT
    cost_per_order: int | str | None = OMIT


# The decimal places each report form uses.
ROW_PROFILE = RateProfile(2, 4, 4, 4, 2, 2, 2)
SUMMARY_PROFILE = RateProfile(1, 2, 2, 3, 2, 2, 2)
CHANNEL_PROFILE = RateProfile(2, 4, 4, roi=2, cost_per_order=2)
DAILY_PROFILE = RateProfile(2, 4, 4, roi=2)
WEEKLY_PROFILE = RateProfile(2, 2, 2, roi=2, cost_per_order=2)
REPORT_CHANNEL_PROFILE = RateProfile(1, 2, 2, roi=1)
LEGACY_PROFILE = RateProfile(0, 1, 1, 2, roi=2)
RAW_ROI_PROFILE = RateProfile(1, 2, 2, roi=UNROUNDED)
UNROUNDED_PROFILE = RateProfile(
    UNROUNDED, UNROUNDED, UNROUNDED, roi=UNROUNDED, cost_per_order=UNROUNDED
)
