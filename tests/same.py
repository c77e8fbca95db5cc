"""Comparison of a query's rows with those of its SQL."""

import datetime

import numpy as np
import pandas as pd


def plain(v):
    if v is None or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v).tz_localize(None))
    return v


def same_rows(df, con, sql):
    rows, found = df.collect(), con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    order = [df.columns.index(c) for c in found.columns]
    got = sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert got == want
    return len(got)
