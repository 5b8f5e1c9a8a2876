"""Every query of this subpackage."""

from . import queries_pairs, queries_records, queries_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
