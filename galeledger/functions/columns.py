"""Small helpers shared by the column functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row and use it any number of times in ``body``.

    The optimizer may merge projections and so repeat a costly expression; a
    lambda variable is evaluated once whatever the surrounding plan looks like.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column, name: str) -> Column:
    """``value`` as a generated column called ``name``, for use in a ``select``.

    Filters and explodes on a plain column are copied below the projection that
    computes it and repeat the work there, on rows not yet filtered. They stay
    above a generator.
    """
    return F.inline(F.array(F.struct(value.alias(name))))


def python_round2(value: Column) -> Column:
    """Round to two places on the exact binary value, ties to even.

    ``round`` and ``bround`` work on the printed decimal; ``format_number``
    rounds what the double really holds, as Python does.
    """
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit("")).cast("double")


def column_function(build: Callable[..., Column]) -> Callable[..., Column]:
    """Let ``build``, a function of a text column, also take a column name.

    A large expression costs a second of driver round trips. Expressions do not
    change, so one built for a name and hashable arguments is kept for the next
    query of the same application.
    """

    @lru_cache(maxsize=64)
    def built(application: str, name: str, args: tuple, options: tuple) -> Column:
        return build(F.col(name), *args, **dict(options))

    @wraps(build)
    def call(text: Column | str, *args, **options) -> Column:
        if not isinstance(text, str):
            return build(text, *args, **options)
        key = (args, tuple(options.items()))
        try:
            hash(key)
        except TypeError:
            return build(F.col(text), *args, **options)
        return built(SparkContext.getOrCreate().applicationId, text, *key)

    return call


def constant(value, ddl: str) -> Column:
    """A nested literal of the given type.

    The optimizer folds the parsing away; building the same value from single
    literals would take a driver round trip for each of them.
    """
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def strings(values: Iterable[str] = ()) -> Column:
    return constant(list(values), "array<string>")
