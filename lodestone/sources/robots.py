"""Robots rules as a table (origin, status, body, expires_at) and the decision per URL."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators.joins import small

LARGEST_BODY = 512_000
TTL_S = 3600
MOST_HOPS = 3


def may_fetch(url: str, agent: str, status: int | None, body: str | None, hops: int = 0) -> bool:
    """No answer, 5xx, too many hops and too large bodies forbid all; 4xx allows all."""
    if status is None or status >= 500 or 300 <= status < 400 or hops > MOST_HOPS:
        return False
    if 400 <= status < 500:
        return True
    if len((body or "").encode()) > LARGEST_BODY:
        return False
    p = RobotFileParser()
    p.parse((body or "").splitlines())
    return p.can_fetch(agent, url)


def robots_decisions(urls: DataFrame, robots: DataFrame, agent: str, now: Column) -> DataFrame:
    """Adds `robots_ok` to rows with a url; rules that have expired count as missing."""

    @F.pandas_udf("boolean")
    def decide(url: pd.Series, status: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([may_fetch(u, agent, None if pd.isna(s) else int(s), b) for u, s, b in zip(url, status, body)])

    o = U.origin(F.col("url"))
    key = F.concat_ws("|", o.scheme, o.host, o.port.cast("string"))
    live = robots.filter(F.col("expires_at") > now).select(F.col("origin").alias("__o"), F.col("status").alias("__s"), F.col("body").alias("__b"))
    joined = urls.withColumn("__k", key).join(small(live), F.col("__k") == F.col("__o"), "left")
    return joined.withColumn("robots_ok", decide("url", "__s", "__b")).drop("__k", "__o", "__s", "__b")
