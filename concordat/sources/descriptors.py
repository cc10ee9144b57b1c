"""YAML descriptors as typed rows.

Only the YAML to JSON step runs in Python, on the text column alone; typing, rules and
everything later are native.  Text that cannot be read gives a row with errors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.names import canonical_member
from concordat.operators.component_rules import component_problems, product_problems, with_tag_defaults
from concordat.operators.components import CONNECTION_TYPES
from concordat.schemas import DESCRIPTOR

# The kinds of a product and of a request's descriptor.
PRODUCT_KIND = "dataproduct"
DESCRIPTOR_KIND = "COMPONENT_DESCRIPTOR"


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """One row per descriptor file: ``source`` and ``descriptor``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("descriptor")
    )


def _reader():
    """A pandas UDF from YAML to JSON; it carries all it needs, so workers import nothing of ours."""

    def convert(texts: pd.Series) -> pd.DataFrame:
        import datetime
        import json

        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def plain(value):
            if isinstance(value, (datetime.date, datetime.datetime)):
                return value.isoformat()
            return str(value)

        def read(value):
            try:
                document = yaml.load(value or "", Loader=loader)
                if not isinstance(document, dict):
                    return None, "descriptor is not a mapping"
                return json.dumps(document, default=plain, allow_nan=False), None
            except yaml.YAMLError as problem:
                return None, "unreadable YAML: " + " ".join(str(problem).split())
            except (TypeError, ValueError, RecursionError) as problem:
                return None, f"descriptor has no JSON form: {problem}"

        return pd.DataFrame([read(value) for value in texts], columns=["document", "parse_error"], dtype=object)

    return F.pandas_udf(convert, "document string, parse_error string")


def to_json(texts: DataFrame, text: str = "descriptor") -> DataFrame:
    """Replaces the YAML column by ``document`` (JSON) and ``parse_error``; no other column leaves the JVM."""
    kept = [F.col(f"`{c}`") for c in texts.columns if c != text]
    read = texts.withColumn("__read", _reader()(F.col(text)))
    return read.select(*kept, F.col("__read.document").alias("document"), F.col("__read.parse_error").alias("parse_error"))


def _with_numbers_as(dtype: T.DataType, number: T.DataType) -> T.DataType:
    """The type with every integer in it replaced."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _with_numbers_as(f.dataType, number)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_with_numbers_as(dtype.elementType, number))
    return number if isinstance(dtype, T.IntegerType) else dtype


def _typed(document: Column) -> Column:
    """The document in its schema; numbers may be written as texts, as in ``dataLength: '10'``."""
    read = F.from_json(document, _with_numbers_as(DESCRIPTOR, T.StringType()))
    return read.try_cast(_with_numbers_as(DESCRIPTOR, T.DoubleType())).try_cast(DESCRIPTOR)


def _with_defaults(product: Column) -> Column:
    """Tags and connection types as the model has them: canonical case, defaults filled in."""

    def of_column(column: Column) -> Column:
        return column.withField("tags", with_tag_defaults(column["tags"]))

    def of_component(component: Column) -> Column:
        contract = component["dataContract"]
        filled = contract.withField("schema", F.transform(contract["schema"], of_column))
        return (
            component.withField("tags", with_tag_defaults(component["tags"]))
            .withField("connectionType", canonical_member(component["connectionType"], CONNECTION_TYPES))
            .withField("dataContract", F.when(contract.isNotNull(), filled))
        )

    return product.withField("tags", with_tag_defaults(product["tags"])).withField(
        "components", F.transform(product["components"], of_component)
    )


def _document_problems(document: str) -> Column:
    """Problems of a readable document: of the product, of the wanted component, of each component with its place."""
    product = f"try_variant_get({document}, '$.dataProduct', 'variant')"
    components = f"try_variant_get({document}, '$.dataProduct.components', 'array<variant>')"
    kind = f"try_variant_get({document}, '$.dataProduct.kind', 'string')"
    wanted = f"try_variant_get({document}, '$.componentIdToProvision', 'string')"
    listed = f"exists({components}, one -> coalesce(try_variant_get(one, '$.id', 'string') = {wanted}, false))"
    return F.expr(f"""CASE WHEN {product} IS NULL OR is_variant_null({product}) THEN array('missing dataProduct')
        WHEN try_variant_get({product}, '$', 'map<string,variant>') IS NULL THEN array('wrong type of dataProduct')
        ELSE concat(
            {product_problems(product)},
            array_compact(array(
                CASE WHEN {kind} <> '{PRODUCT_KIND}' THEN 'product kind is not dataproduct' END,
                CASE WHEN {wanted} IS NULL THEN 'missing componentIdToProvision'
                     WHEN NOT coalesce({listed}, false)
                     THEN 'componentIdToProvision is not a component of the product' END)),
            coalesce(flatten(transform({components}, (component, place) ->
                transform({component_problems("component")},
                          problem -> concat('component ', place, ': ', problem)))),
                CAST(array() AS array<string>))) END""")


def parse_descriptors(
    texts: DataFrame, text: str = "descriptor", partitions: int | None = None
) -> DataFrame:
    """Typed descriptors: ``product``, ``component_id`` and ``errors``.

    ``product`` is null where ``errors`` is not empty.  A ``descriptor_kind``
    column, when there is one, must name a component descriptor.  Reading YAML
    takes far longer than moving it: ``partitions`` spreads texts that come in
    few partitions over so many tasks.
    """
    spread = texts.repartition(partitions) if partitions else texts
    kept = [F.col(f"`{c}`") for c in texts.columns if c != text]
    # Generated columns are computed once: a filter on the result would otherwise
    # repeat the JSON parsing for every field it looks at.
    parsed = to_json(spread, text).select(
        *kept, "parse_error",
        F.explode(F.array(F.struct(
            _typed(F.col("document")).alias("d"), F.try_parse_json("document").alias("v")
        ))).alias("read"),
    )
    unreadable = F.coalesce("parse_error", F.when(F.col("read.v").isNull(), "descriptor has no JSON form"))
    of_request = []
    if "descriptor_kind" in texts.columns:
        fits = F.coalesce(F.col("descriptor_kind") == DESCRIPTOR_KIND, F.lit(False))
        named = F.concat(F.lit("unexpected descriptor kind "), F.coalesce("descriptor_kind", F.lit("none")))
        of_request.append(F.when(~fits, named))
    errors = F.concat(
        F.array_compact(F.array(unreadable, *of_request)),
        F.when(unreadable.isNull(), _document_problems("read.v")).otherwise(F.array().cast("array<string>")),
    )
    judged = parsed.select(*kept, "read.d", F.explode(F.array(errors)).alias("errors"))
    product = F.when(F.size("errors") == 0, _with_defaults(F.col("d.dataProduct")))
    typed = F.struct(product.alias("product"), F.col("d.componentIdToProvision").alias("component_id"), "errors")
    return judged.select(*kept, F.explode(F.array(typed)).alias("typed")).select(*kept, "typed.*")
