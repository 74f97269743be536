"""Activity analytics on Spark: daily counts by place and population group."""

from .spec import DEFAULT, FactSpec

__all__ = ["DEFAULT", "FactSpec"]
