"""Order-free comparison of two result sets by column name."""

from __future__ import annotations

import datetime
import decimal


def cell(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda t: tuple((x is None, str(x)) for x in t))


def spark_table(df):
    return table(df.columns, df.collect())
