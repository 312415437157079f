"""Generic DataFrame operators; column names are parameters, nothing clinical inside."""

from .anchored import Anchor, attach, exists_flag, first_value, within_anchor
from .bounded import bounded
from .criteria import attrition_report, criteria_masks, excluded_rows, kept_rows
from .keyed import first_with_next, next_in_key
from .keys import key_audit, one_per_key, repeated_keys
from .members import members_of
from .sizing import BROADCAST_ROWS, DEFAULT_LIMITS, LOOKUP_ROWS, PlanLimits, small_side
from .staging import remove_folder, shared_folder, staged

__all__ = [
    "Anchor",
    "BROADCAST_ROWS",
    "DEFAULT_LIMITS",
    "LOOKUP_ROWS",
    "PlanLimits",
    "attach",
    "attrition_report",
    "bounded",
    "criteria_masks",
    "excluded_rows",
    "exists_flag",
    "first_value",
    "first_with_next",
    "kept_rows",
    "key_audit",
    "members_of",
    "next_in_key",
    "one_per_key",
    "repeated_keys",
    "remove_folder",
    "shared_folder",
    "small_side",
    "staged",
    "within_anchor",
]
