"""Column expressions; all built from native functions, none needs Python workers."""

from .categories import normalize_categories, normalize_enum
from .conversions import convert_units
from .sets import in_list
from .text import contains_any, lowered
from .times import days, elapsed_seconds, hours, true_or_zero, within_days

__all__ = [
    "contains_any",
    "convert_units",
    "days",
    "elapsed_seconds",
    "hours",
    "in_list",
    "lowered",
    "normalize_categories",
    "normalize_enum",
    "true_or_zero",
    "within_days",
]
