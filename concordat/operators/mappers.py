"""Where a mapping of references plugs in.

A mapper is a function from a DataFrame with a ``ref`` column to the same rows with ``mapped``
and ``error``, exactly one of the two set in every row.  The built-in ones are native columns
and joins; ``batch_mapper`` makes one of a Python function that maps a list of references, as a
client of an identity service does.  ``register`` gives mappers names, so that a plan can be
configured with one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators.joins import keyed_join
from concordat.operators.principals import distinct_references, map_to_ids, map_to_names
from concordat.sources.stores import carried

Mapper = Callable[[DataFrame], DataFrame]

_MAPPERS: dict[str, Callable[..., Mapper]] = {}


def register(name: str, make: Callable[..., Mapper]) -> None:
    """Make a kind of mapper known by name; ``make`` takes its options."""
    if name in _MAPPERS:
        raise ValueError(f"a mapper {name} is registered already")
    _MAPPERS[name] = make


def mapper(name: str, **options) -> Mapper:
    """A mapper of a registered kind."""
    if name not in _MAPPERS:
        raise ValueError(f"no mapper {name}; there are {sorted(_MAPPERS)}")
    return _MAPPERS[name](**options)


def names_in(groups: DataFrame, salts: int = 1) -> Mapper:
    """Users to mail addresses, groups to the one spelling the directory has."""
    return lambda refs: map_to_names(refs, groups, salts)


def ids_in(users: DataFrame, groups: DataFrame, order: Sequence[str] = ("id",), salts: int = 1) -> Mapper:
    """Users and groups to their object ids."""
    return lambda refs: map_to_ids(refs, users, groups, order, salts)


def batch_mapper(
    of_batch: Callable[[list[str]], Mapping[str, str | Exception]], batch: int = 500, calls: int = 8, salts: int = 1
) -> Mapper:
    """A mapper of a function that takes a list of references and answers for each.

    An answer is the mapped text, or an exception, whose text becomes the error; no answer and
    an empty one are NOT_MAPPED, and an exception from the call is the error of its whole list.
    A reference is asked for once, however many rows use it: distinct references are dealt to
    ``calls`` tasks and asked in lists of up to ``batch``.  A task that is run again asks again,
    so the function must answer the same.  Null references are NOT_A_REFERENCE and never asked.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs = b.column(0).to_pylist()
            for at in range(0, len(refs), batch):
                part = refs[at : at + batch]
                try:
                    answers = of_batch(part)
                except Exception as problem:  # the error of every row of the list
                    answers = dict.fromkeys(part, problem)
                texts, errors = [], []
                for ref in part:
                    answer = answers.get(ref)
                    failed = isinstance(answer, Exception)
                    texts.append(None if failed or not answer else answer)
                    errors.append((str(answer) or type(answer).__name__) if failed else None if answer else "NOT_MAPPED")
                yield pa.record_batch([pa.array(part, pa.string()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["ref", "__mapped", "__error"])

    def apply(refs: DataFrame) -> DataFrame:
        carried(__name__)
        asked = distinct_references(refs.where("ref IS NOT NULL")).repartition(calls, "ref")
        answers = asked.mapInArrow(ask, "ref string, __mapped string, __error string")
        error = F.when(F.col("ref").isNull(), "NOT_A_REFERENCE").otherwise(F.col("__error"))
        return keyed_join(refs, answers, ["ref"], "left", salts).select(
            *refs.columns, F.col("__mapped").alias("mapped"), error.alias("error")
        )

    return apply


register("names", names_in)
register("ids", ids_in)
register("batches", batch_mapper)
