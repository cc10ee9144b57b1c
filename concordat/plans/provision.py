"""May a view be published?  One verdict per publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.names import WORKSPACE_URL, record, workspace_reference
from concordat.operators.access import DEVELOPMENT, READ, configured_privilege, usage_rows
from concordat.operators.joins import keyed_join
from concordat.operators.principals import map_to_names
from concordat.sources.product_tables import contract_columns


def find_workspaces(
    publications: DataFrame,
    workspaces: DataFrame,
    workspace: str = "workspace",
    url_pattern: str = WORKSPACE_URL,
    salts: int = 1,
) -> DataFrame:
    """Adds ``workspace_known`` and ``is_managed``.

    An identifier that is a URL is an unmanaged workspace and always known; a
    name is managed and known when ``workspaces`` lists it.  Publishing looks at
    the workspace of the source, an access update at that of the view: the column
    ``workspace`` says which.
    """
    listed = workspaces.select(F.col("name").alias(workspace)).distinct().withColumn(
        "__listed", F.lit(True)
    )
    managed = workspace_reference(workspace, url_pattern)["is_managed"]
    return (
        keyed_join(publications, listed, [workspace], "left", salts)
        .withColumn("is_managed", managed)
        .withColumn("workspace_known", F.coalesce(~managed, F.lit(False)) | F.coalesce("__listed", F.lit(False)))
        .drop("__listed")
    )


def _named(name: Column) -> Column:
    """A column of a table as a key beside the table itself, which is ``_TABLE``."""
    return F.concat(F.lit("c"), name)


_TABLE = "t"


def source_findings(publications: DataFrame, contract: DataFrame, inventory: DataFrame, salts: int = 1) -> DataFrame:
    """Per view whose source lacks anything: ``missing_columns`` of its contract, and ``table_missing``.

    Publications ask for their table and contract columns for theirs, by one key; what the
    inventory has of these keys drops out in a single anti join, so the inventory is shuffled
    once, never made distinct, and only what is missing goes on.  Names compare as data, with
    case; a contract column without name is missing.
    """
    asked = contract.select("target_view", "source_table", _named(F.col("name")).alias("__name")).unionByName(
        publications.select("target_view", "source_table", F.lit(_TABLE).alias("__name"))
    )
    has = F.array(_named(F.col("column_name")), F.lit(_TABLE))
    present = inventory.select(F.col("table_name").alias("source_table"), F.explode(has).alias("__name"))
    missing = keyed_join(asked, present, ["source_table", "__name"], "left_anti", salts)
    is_table = F.coalesce(F.col("__name") == _TABLE, F.lit(False))
    return missing.groupBy("target_view").agg(
        F.count_if(~is_table).alias("missing_columns"), F.bool_or(is_table).alias("table_missing")
    )


def repeated_names(contract: DataFrame) -> DataFrame:
    """The views whose contract has a name twice."""
    twice = contract.groupBy("target_view", "name").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return twice.select("target_view").distinct().withColumn("repeated", F.lit(True))


def publish_verdicts(
    publications: DataFrame,
    contract: DataFrame,
    inventory: DataFrame,
    development: str = DEVELOPMENT,
    reject_duplicates: bool = True,
    salts: int = 1,
) -> DataFrame:
    """Verdict and reason per publication.

    ``publications`` has one row per ``target_view`` with ``source_table``,
    ``environment``, ``workspace_known``, ``metastore_attached`` and
    ``is_managed``; ``contract`` has ``target_view``, ``source_table`` and
    ``name``.  Column types are not compared.  Duplicate contract columns are
    rejected because no view can have them; ``reject_duplicates=False`` leaves
    that to the view's creation.
    """
    findings = source_findings(publications, contract, inventory, salts)
    checked = keyed_join(publications, findings, ["target_view"], "left", unique_facts=True)
    repeated = F.lit(False)
    if reject_duplicates:
        checked = keyed_join(checked, repeated_names(contract), ["target_view"], "left", unique_facts=True)
        repeated = F.coalesce("repeated", F.lit(False))
    table_missing = F.coalesce("table_missing", F.lit(False))
    missing_count = F.coalesce("missing_columns", F.lit(0))
    no_metastore = ~F.coalesce("metastore_attached", F.lit(False))
    in_development = F.lower("environment") == development.lower()
    reason = (
        F.when(~F.col("workspace_known"), "WORKSPACE_UNKNOWN")
        .when(no_metastore & F.col("is_managed"), "METASTORE_NOT_ATTACHED_YET")
        .when(no_metastore, "METASTORE_MISSING")
        .when(table_missing,
              F.when(in_development, "TABLE_NOT_CREATED_YET").otherwise("TABLE_NOT_DEPLOYED"))
        .when(missing_count > 0, "COLUMNS_MISSING")
        .when(repeated, "COLUMNS_REPEATED")
    )
    verdict = (
        F.when(reason.isNull(), "OK")
        .when(reason.isin("WORKSPACE_UNKNOWN", "METASTORE_NOT_ATTACHED_YET"), "OK_WARN")
        .otherwise("ERROR")
    )
    return checked.select(
        *publications.columns,
        F.when(reason == "COLUMNS_MISSING", missing_count).otherwise(F.lit(0)).alias("missing_columns"),
        reason.alias("reason"),
        verdict.alias("verdict"),
    )


def port_verdicts(
    ports: DataFrame,
    inventory: DataFrame,
    workspaces: DataFrame,
    groups: DataFrame,
    development: str = DEVELOPMENT,
    salts: int = 1,
) -> DataFrame:
    """Verdict and reason per requested port, with the principals its owner and developers map to.

    ``ports`` are rows of ``requested_ports``, one per view; ``workspaces`` has one row per
    ``name`` with ``metastore_attached``.  Faults of the port's own part come first, then those
    of ``publish_verdicts``, then references that cannot be mapped, which matter in development only.
    """
    attached = workspaces.select(F.col("name").alias("workspace"), "metastore_attached")
    known = find_workspaces(keyed_join(ports, attached, ["workspace"], "left", salts), workspaces, salts=salts)
    contract = contract_columns(ports.where("target_view IS NOT NULL"))
    mapped = publish_verdicts(known.drop("schema"), contract, inventory, development, salts=salts)
    for role in ("owner", "dev_group"):
        mapped = map_to_names(mapped.withColumn("ref", F.col(role)), groups, salts).withColumnsRenamed(
            {"mapped": f"{role}_name", "error": f"{role}_error"}
        ).drop("ref")
    in_development = F.coalesce(F.lower("environment") == development.lower(), F.lit(False))
    unmapped = in_development & (F.col("owner_error").isNotNull() | F.col("dev_group_error").isNotNull())
    own = F.when(F.size("errors") > 0, "INVALID_FIELDS").when(
        unmapped & (F.col("verdict") != "ERROR"), "PRINCIPAL_UNKNOWN"
    )
    return mapped.select(
        "product_id", "component_id", "target_view", "source_table", "environment", "workspace", "errors",
        F.coalesce(own, "reason").alias("reason"),
        F.when(own.isNotNull(), "ERROR").otherwise(F.col("verdict")).alias("verdict"),
        "owner_name", "dev_group_name",
    )


def provision_plan(
    verdicts: DataFrame, owner_privilege: str = READ, developer_privilege: str = READ, development: str = DEVELOPMENT
) -> DataFrame:
    """The steps that publish every port without an error, in the order of ``step``.

    A workspace or metastore that is not there yet comes first, then catalog, schema and view;
    grants to owner and developers follow in development.  Each row names an ``action`` on an
    object of the port; grants have a ``principal`` and a ``privilege``.
    """
    view, none = F.col("target_view"), F.lit(None).cast("string")

    def step(number: int, action: str, kind: str, name: Column, principal: Column = none, privilege: Column = none) -> Column:
        return record(step=F.lit(number), action=F.lit(action), object_type=F.lit(kind), object_name=name,
                      principal=principal, privilege=privilege)

    def grants(principal: str, privilege: str) -> Column:
        given = configured_privilege(principal, privilege, development)
        return F.transform(
            F.when(given.isNotNull(), usage_rows(given, view)),
            lambda g: record(step=F.lit(5), action=g["action"], object_type=g["object_type"],
                             object_name=g["object_name"], principal=F.col(principal), privilege=g["privilege"]),
        )

    before = F.when(F.col("reason") == "WORKSPACE_UNKNOWN", step(1, "CREATE", "WORKSPACE", F.col("workspace"))).when(
        F.col("reason") == "METASTORE_NOT_ATTACHED_YET", step(1, "ATTACH_METASTORE", "WORKSPACE", F.col("workspace"))
    )
    steps = F.array(
        before,
        step(2, "CREATE_IF_ABSENT", "CATALOG", F.substring_index(view, ".", 1)),
        step(3, "CREATE_IF_ABSENT", "SCHEMA", F.substring_index(view, ".", 2)),
        step(4, "PUBLISH", "VIEW", view),
    )
    given = [F.coalesce(grants(*pair), F.filter(steps, lambda one: F.lit(False))) for pair in (
        ("owner_name", owner_privilege), ("dev_group_name", developer_privilege))]
    every = F.array_distinct(F.array_compact(F.concat(steps, *given)))
    return (
        verdicts.where(F.col("verdict") != "ERROR")
        .select("target_view", F.explode(every).alias("s"))
        .select("target_view", "s.*")
    )


def provision_statuses(products: DataFrame, verdicts: DataFrame, salts: int = 1) -> DataFrame:
    """How each request ends: ``COMPLETED``, or ``FAILED`` with its problems.

    ``products`` is what ``parse_descriptors`` gives; a request for a port is known by product and component.
    """
    key = ["product_id", "component_id"]
    found = verdicts.select(*key, "verdict", "reason", F.col("errors").alias("__fields"))
    requests = products.withColumn("product_id", F.col("product.id")).drop("product")
    joined = keyed_join(requests, found, key, "left", salts)
    reasons = F.when(F.col("verdict") == "ERROR", F.concat(F.array("reason"), F.col("__fields"))).when(
        F.col("verdict").isNull() & (F.size("errors") == 0), F.array(F.lit("NOT_AN_OUTPUT_PORT"))
    )
    problems = F.concat("errors", F.coalesce(reasons, F.array().cast("array<string>")))
    return joined.select(
        *[c for c in requests.columns if c not in ("errors", *key)], *key,
        F.when(F.size(problems) > 0, "FAILED").otherwise("COMPLETED").alias("status"),
        problems.alias("problems"),
    )
