"""Registration of named queries, and the SQL fragments that their counterparts share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quellwerk.functions import constants as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of table readers under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases(rules, holds: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {holds.format(quoted(p))} THEN {quoted(label)}" for p, label in rules) + f" ELSE {quoted(otherwise)} END"


def all_of(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)})"


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
DOMAIN = f"replace({HOST}, 'www.', '')"
TOKENS = lambda t: all_of(f"lower({t})", K.TOKEN)
DOMAIN_TYPE = cases(K.DOMAIN_RULES, f"contains({DOMAIN}, {{}})", "commercial")
PAIR_SQL = "SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"
GRAMS = lambda t, n: f"list_transform(range(1, greatest(len({t}) - {n - 1}, 0) + 1), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"
