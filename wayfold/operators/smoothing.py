"""Grouped line kernels: smoothing and simplifying each line on its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .kernels import simplify, smooth_line
from .lines import measured

LINE = "line_id long, seq long, x double, y double"


def simplified(v: DataFrame, tolerance: float) -> DataFrame:
    """Lines with only the vertices that simplify() keeps, numbered anew."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = pdf[simplify(pdf.x.to_numpy(float), pdf.y.to_numpy(float), tolerance)]
        return out.assign(seq=np.arange(1, len(out) + 1))[["line_id", "seq", "x", "y"]]

    return v.select("line_id", "seq", "x", "y").groupBy("line_id").applyInPandas(run, LINE)


def smoothed(v: DataFrame, strength: float = 50.0, outlier: float = 10.0) -> DataFrame:
    """Lines smoothed over their length; see smooth_line()."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        stay, x, y = smooth_line(pdf.m.to_numpy(float), pdf.x.to_numpy(float), pdf.y.to_numpy(float), strength, outlier)
        return pd.DataFrame({"line_id": key[0], "seq": np.arange(1, stay.sum() + 1), "x": x, "y": y})

    return measured(v).select("line_id", "seq", "m", "x", "y").groupBy("line_id").applyInPandas(run, LINE)
