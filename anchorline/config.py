"""Parameters of an extraction run."""

from __future__ import annotations

from dataclasses import dataclass

from . import fixed_values as fv


@dataclass(frozen=True)
class ExtractionParams:
    """Thresholds of one extraction; the defaults are the published study design.

    The shortest stay that qualifies is the window and the gap after it, unless
    it is given.
    """

    window_hours: int = fv.WINDOW_HOURS
    gap_hours: int = fv.GAP_HOURS
    min_los_hours: int | None = None
    min_age: int = fv.MIN_AGE
    max_age: int = fv.MAX_AGE
    prolonged_los_days: int = fv.PROLONGED_LOS_DAYS
    readmission_days: int = fv.READMISSION_DAYS
    mortality_days: int = fv.MORTALITY_DAYS

    def __post_init__(self) -> None:
        if self.min_los_hours is None:
            object.__setattr__(self, "min_los_hours", self.window_hours + self.gap_hours)


DEFAULT_PARAMS = ExtractionParams()
