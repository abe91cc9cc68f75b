"""Campaign delivery analytics as Spark DataFrame transformations."""

from dripline.config import MetricConfig, RateProfile
from dripline.operators.filters import FilterSpec

__all__ = ["FilterSpec", "MetricConfig", "RateProfile"]
