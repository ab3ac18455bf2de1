"""Shared pieces of the registered queries and of their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.functions.text import PUNCTUATION, STOPWORDS
from folioscope.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: Unicode white space as a RE2 class, as the JVM's (?U)\s reads it.
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tokens(c: str) -> str:
    stop = ", ".join(sql_text(w) for w in STOPWORDS)
    plain = f"translate(lower(coalesce({c}, '')), {sql_text(PUNCTUATION)}, {sql_text(' ' * len(PUNCTUATION))})"
    return f"list_filter(regexp_split_to_array({plain}, '{SPACE}+'), lambda x: x <> '' AND x NOT IN ({stop}))"


def sql_ascii_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def sql_squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def sql_match(c: str) -> str:
    return f"array_to_string({sql_tokens(f'replace({c}, chr(45), chr(32))')}, ' ')"


__all__ = ["Query", "SPACE", "sql_ascii_tokens", "sql_match", "sql_squash", "sql_text", "sql_tokens", "table"]
