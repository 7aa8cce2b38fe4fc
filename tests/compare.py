"""Rows of a result as sorted tuples, whatever engine they come from."""

import datetime

import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if v != v else float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(v)
    return v


def rows(df: pd.DataFrame):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df[columns].astype(object).values.tolist()), key=repr)
