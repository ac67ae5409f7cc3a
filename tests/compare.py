"""Rows of a frame and of a DuckDB relation in one comparable form."""

import datetime

import numpy as np
import pandas as pd


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, (np.ndarray, list, tuple)):
            return "[" + ",".join(map(str, v)) + "]"
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return str(round(float(v), 6))
        if isinstance(v, datetime.datetime):
            return str(v)[:26]
        if isinstance(v, datetime.date):
            return f"{v} 00:00:00"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None))
