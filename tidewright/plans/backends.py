"""Named transformations of a hop, and the adapter that calls a client from the executors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import patterns as P
from ..functions import text as T

_MADE: dict[str, Callable] = {}


def register(name: str, make: Callable) -> None:
    """Adds a transformation: ``make(**options)`` gives a column function, or a function of a DataFrame for hops through the cache."""
    _MADE[name] = make


def get(name: str, **options) -> Callable:
    """The transformation of a name; an unknown one is an error that names those there are."""
    if name not in _MADE:
        raise KeyError(f"no transformation {name!r}; there are {', '.join(available())}")
    return _MADE[name](**options)


def available() -> list[str]:
    return sorted(_MADE)


def mock(lose_marks: bool = False) -> Callable[[Column], Column]:
    """The stand-in that moves words by one place, placeholders staying; with ``lose_marks`` the first placeholder gets lost."""
    return lambda text: F.regexp_replace(T.rotate_words(text), rf"(?s)\A(.*?){P.SENTINEL} ?", "$1") if lose_marks else T.rotate_words(text)


def client(connect: Callable[[], Callable[[str, str, float], str]]) -> Callable[[DataFrame], DataFrame]:
    """Calls a client in the executors: ``connect()`` runs once a task and gives generate(system, text, temperature).

    Rows come in Arrow batches and get the column ``out``; the caller cuts the result from its lineage, so that no call is made twice."""

    def call(rows: DataFrame) -> DataFrame:
        def run(batches):
            generate = None
            for b in batches:
                generate = generate or connect()
                yield b.assign(out=pd.Series([generate(s, t, x) for s, t, x in zip(b["system"], b["text"], b["temperature"])], index=b.index, dtype=object))

        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("out", StringType())]))

    return call


register("mock", mock)
register("client", client)
