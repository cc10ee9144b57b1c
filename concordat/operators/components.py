"""Components of data products: selection, parsing rules and routing.

Components are rows with ``product_id`` and ``pos`` beside their own fields.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import canonical_member, col, template_base_id
from concordat.operators.joins import keyed_join

# Component kinds and the fields each of them must have.
BASE_FIELDS = ["id", "name", "description", "useCaseTemplateId", "infrastructureTemplateId"]
REQUIRED_FIELDS = {
    "outputport": ["version", "dependsOn", "outputPortType", "dataContract", "tags", "semanticLinking"],
    "workload": ["version", "dependsOn", "connectionType", "tags"],
    "storage": ["dependsOn", "tags"],
    "observability": [
        "endpoint", "completeness", "dataProfiling", "freshness", "availability", "dataQuality",
    ],
}
CONNECTION_TYPES = ["HOUSEKEEPING", "DATAPIPELINE"]

# Modes in which a pipeline cluster scales by itself.
AUTOSCALE_MODES = ["ENHANCED", "LEGACY"]

# Kind of component that each template route belongs to.
ROUTE_KINDS = {"job": "workload", "workflow": "workload", "dlt": "workload", "outputport": "outputport"}


def explode_components(products: DataFrame, product_id: str = "id") -> DataFrame:
    """One row per component of each product, in descriptor order."""
    return products.select(
        F.col(product_id).alias("product_id"), F.posexplode("components").alias("pos", "component")
    ).select("product_id", "pos", "component.*")


def components_of_kind(components: DataFrame, kind: str) -> DataFrame:
    return components.where(F.col("kind") == kind)


def component_by_id(components: DataFrame) -> DataFrame:
    """The first component with each id of a product."""
    fields = [c for c in components.columns if c not in ("product_id", "id")]
    first = F.min(F.struct("pos", *[f for f in fields if f != "pos"]))
    return (
        components.groupBy("product_id", "id")
        .agg(first.alias("first"))
        .select("product_id", "id", *[F.col("first")[f].alias(f) for f in fields])
    )


def component_errors(available: Sequence[str], component: Column | None = None) -> Column:
    """Problems of a component as an array: an unknown kind, or the fields its kind lacks.

    ``available`` are the fields at hand; any other field counts as lacking.  The
    fields are columns of the row, or of the struct ``component``.
    """

    def field_of(name: str) -> Column:
        return F.col(name) if component is None else component[name]

    def lacking(name: str) -> Column:
        absent = field_of(name).isNull() if name in available else F.lit(True)
        return F.when(absent, F.lit(f"missing {name}"))

    kind = field_of("kind")
    known = F.coalesce(kind.isin(list(REQUIRED_FIELDS)), F.lit(False))
    checks = [F.when(~known, F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("none"))))]
    checks += [F.when(known, lacking(name)) for name in BASE_FIELDS]
    for owner, names in REQUIRED_FIELDS.items():
        checks += [F.when(kind == owner, lacking(name)) for name in names]
    if "connectionType" in available:
        given = field_of("connectionType")
        unknown = given.isNotNull() & canonical_member(given, CONNECTION_TYPES).isNull()
        checks.append(F.when((kind == "workload") & unknown, F.lit("invalid connectionType")))
    return F.array_compact(F.array(*checks))


def specific_shape(specific: str | Column) -> Column:
    """Shape of a component's own part: ``workload``, else ``base``, else null.

    A workload part names a workspace, a repository URL and a path in it; the
    base part only a workspace.
    """
    document = col(specific)

    def has(path: str) -> Column:
        return F.get_json_object(document, path).isNotNull()

    base = has("$.workspace")
    workload = base & has("$.git.gitRepoUrl") & has("$.repoPath")
    return F.when(workload, "workload").when(base, "base")


def template_route(template_id: str | Column, routes: Mapping[str, Sequence[str]]) -> Column:
    """Name of the route that lists the template id (without version), else null.

    ``routes`` is tried in its order.
    """
    base = template_base_id(template_id)
    route = F.lit(None).cast("string")
    for name, ids in reversed(list(routes.items())):
        route = F.when(base.isin(list(ids)), name).otherwise(route)
    return route


def route_components(components: DataFrame, routes: Mapping[str, Sequence[str]],
                     template: str = "template_id") -> DataFrame:
    """Adds ``route`` and ``error``: only workloads and output ports of their own templates pass."""
    route = template_route(template, routes)
    belongs = F.create_map(*[F.lit(x) for pair in ROUTE_KINDS.items() for x in pair])
    error = (
        F.when(~F.coalesce(F.col("kind").isin("workload", "outputport"), F.lit(False)), "UNSUPPORTED_KIND")
        .when(route.isNull(), "UNSUPPORTED_TEMPLATE")
        .when(F.try_element_at(belongs, route) != F.col("kind"), "KIND_MISMATCH")
    )
    return components.withColumns(
        {"route": F.when(error.isNull(), route), "error": error}
    )


def reverse_route(template_id: str | Column, routes: Mapping[str, Sequence[str]]) -> Column:
    """Route of a reverse-provisioning request: only workflows and output ports have one."""
    offered = {name: ids for name, ids in routes.items() if name in ("workflow", "outputport")}
    return template_route(template_id, offered)


def min_length(column: str | Column, length: int = 1) -> Column:
    c = col(column)
    name = column if isinstance(column, str) else "value"
    return F.when(c.isNull() | (F.length(c) < length), F.lit(f"{name} shorter than {length}"))


def at_least(column: str, limit: int) -> Column:
    c = F.col(column)
    return F.when(c.isNull() | (c < limit), F.lit(f"{column} below {limit}"))


def not_empty_list(column: str) -> Column:
    c = F.col(column)
    return F.when(c.isNull() | (F.size(c) < 1), F.lit(f"{column} is empty"))


def cluster_sizing(mode: str = "mode", fewest: str = "min_workers", most: str = "max_workers",
                   fixed: str = "num_workers") -> Column:
    """Problem of a cluster size: a scaling mode needs a range, any other mode a number."""
    scales = F.coalesce(F.col(mode).isin(AUTOSCALE_MODES), F.lit(False))
    low, high, number = F.col(fewest), F.col(most), F.col(fixed)
    scaled = F.when(low.isNull() | high.isNull(), "autoscale needs min and max workers").when(
        number.isNotNull(), "autoscale excludes a fixed number"
    )
    steady = F.when(number.isNull(), "fixed size needs a number of workers").when(
        low.isNotNull() | high.isNotNull(), "fixed size excludes min and max workers"
    )
    return F.when(scales, scaled).otherwise(steady)


def with_violations(rows: DataFrame, rules: Sequence[Column], name: str = "violations") -> DataFrame:
    """Adds the problems of each row as an array, empty when all rules hold."""
    return rows.withColumn(name, F.array_compact(F.array(*rules)))


def dependency_edges(components: DataFrame) -> DataFrame:
    """One row per component and component it depends on."""
    return components.select(
        "product_id", "id", F.explode("depends_on").alias("depends_on")
    )


def dangling_dependencies(components: DataFrame) -> DataFrame:
    """Edges to ids that no component has."""
    known = components.select(F.col("id").alias("depends_on")).distinct()
    return keyed_join(dependency_edges(components), known, ["depends_on"], "left_anti")


def tagged_columns(contract: DataFrame, tag: str) -> DataFrame:
    """Contract columns that carry a tag."""
    return contract.where(F.exists("tags", lambda t: t["tagFQN"] == tag))
