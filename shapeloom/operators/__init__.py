"""Record operators: each takes DataFrames and returns one."""

from .filters import element_at, number_test, where_all, where_numbers
from .nested import aggregate_children, nest
from .ordering import order_by
from .projection import project, range_rows, root

__all__ = ["aggregate_children", "element_at", "nest", "number_test", "order_by", "project", "range_rows", "root", "where_all", "where_numbers"]
