"""lonja: DataFrame analytics over one table of brokered buyer/seller operations."""

from lonja.operators.filters import OpsFilter, apply_filter
from lonja.schema import OPERATIONS_SCHEMA, SOURCE_COLUMNS

__all__ = ["OPERATIONS_SCHEMA", "SOURCE_COLUMNS", "OpsFilter", "apply_filter"]
