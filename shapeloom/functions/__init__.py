"""Column functions with JSON semantics: no UDFs, everything is a Catalyst expression.

Three rules for missing values: nothing counts as 0 where a number is wanted, as "" where text is wanted, and
stays NULL where it is only passed on.
"""

from .arrays import append, array_map, average_of, contained_in, count_of, distinct, filter_array, literal_array, max_of, min_of, number_range, reduce_array, reverse, shuffle, sort, sum_of, zip_arrays
from .coerce import boolean, exists, not_, number, string, truthy, type_of
from .combine import chain, compose, partial
from .numbers import abs_, add, ceil, divide, floor, modulo, multiply, negate, power, random, round_, sqrt, subtract
from .objects import document_keys, document_type, document_values, each_value, extract, filter_object, keys, lookup, merge, spread, values, wildcard
from .strings import concat, contains, join, length, lowercase, pad, split, substring, substring_after, substring_before, trim, uppercase
from .times import from_millis, millis, now, to_millis

__all__ = [
    "abs_", "add", "append", "array_map", "average_of", "boolean", "ceil", "chain", "compose", "concat", "contained_in", "contains", "count_of", "distinct",
    "divide", "document_keys", "document_type", "document_values", "each_value", "exists", "extract", "filter_array", "filter_object", "floor", "from_millis", "join", "keys", "length", "literal_array", "lookup", "lowercase", "max_of", "merge",
    "millis", "min_of", "modulo", "multiply", "negate", "not_", "now", "number", "number_range", "pad", "partial", "power", "random", "reduce_array", "reverse", "round_",
    "shuffle", "sort", "split", "spread", "sqrt", "string", "substring", "substring_after", "substring_before", "subtract", "sum_of", "to_millis", "trim",
    "truthy", "type_of", "uppercase", "values", "wildcard", "zip_arrays",
]
