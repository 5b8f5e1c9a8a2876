"""Everything that is registered."""

from . import (  # noqa: F401
    aggregates,
    detection,
    filters,
    jobs,
    joins,
    maintenance,
    scalars,
    sources,
    streams,
    windows,
)
from .registry import ORACLES, QUERIES  # noqa: F401
