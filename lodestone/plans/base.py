"""Tables, and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENS = r"(?:_|\p{L}(?:[.'':]\p{L})*|\p{N}(?:[.,]\p{N})*)+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '{TOKENS}')"


def sql_collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def sql_approx_tokens(c: str) -> str:
    latin = rf"length(regexp_replace({c}, '[^\x{{0000}}-\x{{024F}}]', '', 'g'))"
    return f"(CASE WHEN coalesce(length({c}), 0) = 0 THEN 0 ELSE greatest(1, ({latin} + 2) // 3 + length({c}) - {latin}) END)"


def sql_compact(c: str, limit: int = 600) -> str:
    t = sql_collapse(f"coalesce({c}, '')")
    return f"(CASE WHEN length({t}) <= {limit} THEN {t} ELSE rtrim(substring({t}, 1, {limit - 2})) || ' …' END)"
