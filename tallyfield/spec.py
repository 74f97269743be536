"""Column naming for the fact table every operator works on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FactSpec:
    """Names the columns of a fact table of counts by day and place.

    ``parts`` are the per-group counts of a row and ``total`` is their sum.
    ``measure`` names what is counted; it only shapes output column names
    such as ``avg_daily_<measure>``.
    """

    date: str = "date"
    state: str = "state"
    district: str = "district"
    pincode: str = "pincode"
    parts: tuple[str, str, str] = ("age_0_5", "age_5_17", "age_18_greater")
    part_labels: tuple[str, str, str] = ("age_0_5", "age_5_17", "age_18_plus")
    share_names: tuple[str, str, str] = ("pct_children", "pct_youth", "pct_adults")
    total: str = "total_enrollments"
    measure: str = "enrollments"

    @property
    def measures(self) -> tuple[str, ...]:
        """The three parts followed by their total."""
        return (*self.parts, self.total)

    @property
    def raw_columns(self) -> tuple[str, ...]:
        """Columns of the uncleaned table, in file order."""
        return (self.date, self.state, self.district, self.pincode, *self.parts)

    def geo_keys(self, level: str) -> list[str]:
        """Grouping columns of a geographic level: state, district or pincode."""
        keys = {
            "state": [self.state],
            "district": [self.state, self.district],
            "pincode": [self.pincode, self.state, self.district],
        }
        if level not in keys:
            raise ValueError(f"level must be one of {sorted(keys)}, not {level!r}")
        return keys[level]


DEFAULT = FactSpec()
