"""One output shape per query, applied alike to the Spark and the SQL result.

Kinds: ``=`` as is, ``i`` INT, ``l`` BIGINT, ``d`` day as text, ``t`` time as
text, ``r`` DOUBLE to 4 decimals, ``f`` single precision, ``s`` DOUBLE to 5
significant digits, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = dict[str, str]

# Means of prices often end exactly on a 5 in the fifth decimal. There one unit
# in the last place, from another order of summation, would decide the digit; a
# shift far below the fourth decimal moves such values off the edge.
_OFF_EDGE = 1e-7


def shape(**kinds: str) -> Shape:
    return kinds


def _digits(column: Column) -> Column:
    """Power of ten that brings five digits of the value before its point."""
    return F.pow(F.lit(10.0), 4 - F.floor(F.log10(F.abs(column))))


def _spark(name: str, kind: str) -> Column:
    column = F.col(f"`{name}`")
    forms = {
        "=": lambda: column,
        "i": lambda: column.cast("int"),
        "l": lambda: column.cast("bigint"),
        "d": lambda: F.date_format(column, "yyyy-MM-dd"),
        "t": lambda: F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        # Adding 0 turns a negative zero into zero.
        "r": lambda: F.round(column + _OFF_EDGE, 4) + F.lit(0.0),
        "f": lambda: column.cast("float"),
        "s": lambda: F.when(column == 0, F.lit(0.0)).otherwise(
            F.round(column * _digits(column)) / _digits(column)
        ),
    }
    return forms[kind]().alias(name)


def _sql(name: str, kind: str) -> str:
    forms = {
        "=": '"{0}"',
        "i": 'cast("{0}" as integer)',
        "l": 'cast("{0}" as bigint)',
        "d": """strftime("{0}", '%Y-%m-%d')""",
        "t": """strftime("{0}", '%Y-%m-%d %H:%M:%S.%f')""",
        "r": f'round("{{0}}" + {_OFF_EDGE}, 4) + 0e0',
        "f": 'cast("{0}" as float)',
        "s": """case when "{0}" = 0 then 0e0 else round("{0}"
            * pow(10e0, 4 - floor(log10(abs("{0}"))))) / pow(10e0, 4 - floor(log10(abs("{0}")))) end""",
    }
    return forms[kind].format(name) + f' as "{name}"'


def shape_frame(frame: DataFrame, kinds: Shape) -> DataFrame:
    return frame.select(*[_spark(n, k) for n, k in kinds.items()])


def shape_sql(body: str, kinds: Shape) -> str:
    columns = ", ".join(_sql(n, k) for n, k in kinds.items())
    return f"select {columns} from (\n{body}\n) as result"
