"""The map functions under names for SQL text, as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_M = "MAP<BIGINT, BIGINT>"

# name: (parameters, result, body)
DEFINITIONS = {
    "pv_negate_keys": (f"m {_M}", _M, "transform_keys(m, (k, v) -> -k)"),
    "pv_clip": (f"m {_M}, low BIGINT, high BIGINT", _M, "map_filter(m, (k, v) -> k BETWEEN low AND high)"),
    "pv_clip_left": (f"m {_M}, low BIGINT", _M, "map_filter(m, (k, v) -> k >= low)"),
    "pv_clip_right": (f"m {_M}, high BIGINT", _M, "map_filter(m, (k, v) -> k <= high)"),
    "pv_nonzero": (f"m {_M}", _M, "map_filter(m, (k, v) -> v <> 0)"),
    "pv_positive": (f"m {_M}", _M, "map_filter(m, (k, v) -> v > 0)"),
    "pv_negative": (f"m {_M}", _M, "map_filter(m, (k, v) -> v < 0)"),
    "pv_negate": (f"m {_M}", _M, f"transform_values(coalesce(m, CAST(map() AS {_M})), (k, v) -> -v)"),
    "pv_add": (f"a {_M}, b {_M}", _M, f"map_zip_with(coalesce(a, CAST(map() AS {_M})), coalesce(b, CAST(map() AS {_M})), (k, x, y) -> coalesce(x, 0L) + coalesce(y, 0L))"),
    "pv_subtract": (f"a {_M}, b {_M}", _M, f"map_zip_with(coalesce(a, CAST(map() AS {_M})), coalesce(b, CAST(map() AS {_M})), (k, x, y) -> coalesce(x, 0L) - coalesce(y, 0L))"),
    "pv_total": (f"m {_M}", "BIGINT", "aggregate(map_values(m), 0L, (s, v) -> s + v)"),
    "pv_turnover": (f"m {_M}", "BIGINT", "aggregate(map_entries(m), 0L, (s, e) -> s + e.key * e.value)"),
    "pv_at": (f"m {_M}, price BIGINT", "BIGINT", "coalesce(try_element_at(m, price), 0L)"),
    "dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers those that the session lacks; returns their names."""
    added = [n for n in DEFINITIONS if not spark.catalog.functionExists(n)]
    for name in added:
        parameters, result, body = DEFINITIONS[name]
        spark.sql(f"CREATE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return added
