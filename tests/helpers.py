"""Helpers that test modules import; fixtures are in conftest."""

from __future__ import annotations

import datetime as dt

SF = "/root/testdata/sf0.001"


def month(i: int, start: tuple[int, int] = (2020, 1)) -> dt.date:
    k = start[0] * 12 + start[1] - 1 + i
    return dt.date(k // 12, k % 12 + 1, 1)


def series_frame(spark, series: dict[str, list[float]]):
    rows = [(p, month(i), float(v)) for p, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "product_id string, month date, demand double")
