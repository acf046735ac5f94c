"""The scalar functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Functions that SQL can state by itself, as temporary functions of the session.
_STATEMENTS = {
    "clean_isbn(s STRING)": "nullif(upper(regexp_replace(s, '[^0-9Xx]', '')), '')",
    "normalize_ws(s STRING)": "nullif(trim(regexp_replace(s, '(?U)\\\\s+', ' ')), '')",
    "parse_price(s STRING)": "try_cast(regexp_replace(replace(s, ',', '.'), '[^0-9.\\\\-]', '') AS DOUBLE)",
    "year_or_minus_one(s STRING)": "coalesce(try_cast(regexp_extract(s, '^(\\\\d{4})', 1) AS INT), -1)",
}


def register(spark: SparkSession) -> None:
    for head, body in _STATEMENTS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
