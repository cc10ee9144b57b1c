"""A normal form of nested definitions, and their comparison by one hash.

A definition is any nested value: JSON text, VARIANT, or a struct, map or array.  As VARIANT
its objects have their fields in order of name, whatever wrote them, and decimals have no
trailing zeros; what a comparison must not see is taken out by path.  The text of that is the
normal form and its SHA-256 the digest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.names import is_empty
from concordat.operators.access import DEVELOPMENT
from concordat.operators.joins import keyed_join

_EACH = "[*]"


def comparable(value: Column, dtype: T.DataType) -> Column:
    """The value in a type that can be compared and ordered: maps become their entries, sorted."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(comparable(e["key"], dtype.keyType).alias("key"), comparable(e["value"], dtype.valueType).alias("value")),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType) and _has_map(dtype):
        return F.transform(value, lambda x: comparable(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and _has_map(dtype):
        fields = [comparable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    return value


def _has_map(dtype: T.DataType) -> bool:
    return any(kind in dtype.simpleString() for kind in ("map<", "variant"))


def _tree(paths: Sequence[str]) -> dict:
    """``a.b`` and ``a[*].c`` as nested names; a name that leads nowhere further is taken out."""
    tree: dict = {}
    for path in paths:
        steps = path.replace(_EACH, f".{_EACH}").split(".")
        if not all(steps) or steps[-1] == _EACH:
            raise ValueError(f"a path names fields and {_EACH}, and ends with a field: {path}")
        here = tree
        for step in steps[:-1]:
            here = here.setdefault(step, {})
            if here is None:
                break
        else:
            here[steps[-1]] = None
    return tree


def _without(value: Column, tree: Mapping[str, Mapping | None]) -> Column:
    """A VARIANT without the fields that the tree takes out; other values stay as they are."""
    out, fields = value, {k: v for k, v in tree.items() if k != _EACH}
    if fields:
        object_ = F.try_variant_get(value, "$", "map<string,variant>")
        gone = [k for k, v in fields.items() if v is None]
        kept = F.map_filter(object_, lambda k, _: ~k.isin(gone)) if gone else object_

        def changed(k: Column, v: Column) -> Column:
            cases = None
            for name, below in fields.items():
                if below is not None:
                    cases = (F if cases is None else cases).when(k == name, _without(v, below))
            return v if cases is None else cases.otherwise(v)

        out = F.when(object_.isNotNull(), F.to_variant_object(F.transform_values(kept, changed))).otherwise(out)
    if _EACH in tree:
        array = F.try_variant_get(value, "$", "array<variant>")
        out = F.when(array.isNotNull(), F.to_variant_object(F.transform(array, lambda x: _without(x, tree[_EACH])))).otherwise(out)
    return out


def normal_form(definition: Column, dtype: T.DataType, ignored: Sequence[str] = ()) -> Column:
    """The text of a definition in normal form; null for null and for text that is no JSON.

    ``ignored`` names what is taken out: ``a.b`` a field in an object, ``a[*].b`` a field of
    every element of an array.  A path that leads nowhere changes nothing.
    """
    if isinstance(dtype, T.StringType):
        value = F.try_parse_json(definition)
    elif isinstance(dtype, T.VariantType):
        value = definition
    else:
        value = F.to_variant_object(definition)
    return F.to_json(_without(value, _tree(ignored)) if ignored else value)


def with_digest(table: DataFrame, definition: str, ignored: Sequence[str] = ()) -> DataFrame:
    """Adds ``normal_form`` and ``digest`` of the ``definition`` column."""
    form = normal_form(F.col(f"`{definition}`"), table.schema[definition].dataType, ignored)
    return table.withColumn("normal_form", form).withColumn("digest", F.sha2("normal_form", 256))


def compare_nested(
    requested: DataFrame, existing: DataFrame, definition: str = "definition", ignored: Sequence[str] = (),
    development: str = DEVELOPMENT, salts: int = 1,
) -> DataFrame:
    """Verdict on deploying each requested definition over what has its name, by digests.

    ``requested`` has ``name``, ``override``, ``environment`` and the definition, ``existing``
    ``name``, ``id`` and a definition in any form, not necessarily the same.  Per name one row
    of ``existing`` is kept before the join, with the digest and length of its normal form,
    never the definition: only these travel.  Equal digests and lengths count as equal.
    Verdicts are those of ``compare_definitions``, and ERROR_UNREADABLE for a requested or
    existing definition that has no normal form.
    """
    columns = requested.columns
    mine = with_digest(requested, definition, ignored).withColumn("__length", F.length("normal_form")).drop("normal_form")
    theirs = with_digest(existing, definition, ignored).select(
        "name", F.struct("id", F.col("digest"), F.length("normal_form").alias("length")).alias("body")
    )
    found = theirs.groupBy("name").agg(F.count(F.lit(1)).alias("__count"), F.min("body").alias("__existing"))
    joined = keyed_join(mine, found, ["name"], "left", salts)
    count, other = F.coalesce("__count", F.lit(0)), F.col("__existing")
    same = (F.col("digest") == other["digest"]) & (F.col("__length") == other["length"])
    verdict = (
        F.when(is_empty("name"), "ERROR_NO_NAME")
        .when(F.col("digest").isNull(), "ERROR_UNREADABLE")
        .when(count == 0, "OK_NEW")
        .when(count > 1, "ERROR_NOT_UNIQUE")
        .when(is_empty(other["id"].cast("string")), "ERROR_EMPTY_ID")
        .when(other["digest"].isNull(), "ERROR_UNREADABLE")
        .when(same, "OK_SAME")
        .when(F.coalesce(F.col("override"), F.lit(False)), "OK_OVERRIDE")
        .when(F.lower("environment") == development.lower(), "ERROR_DIFFERS")
        .otherwise("OK_CHANGED")
    )
    return joined.select(
        *[f"`{c}`" for c in columns], "digest", count.alias("existing_count"),
        F.when(count == 1, other["id"]).alias("existing_id"), verdict.alias("verdict"),
    )
