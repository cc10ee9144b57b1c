"""From YAML text to the steps that publish views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.inputs import derived, table
from checks.registry import query
from concordat.plans import provision
from concordat.session import shared_folder
from concordat.sources.descriptors import parse_descriptors
from concordat.sources.product_tables import contract_columns, requested_ports

_PRODUCT = """dataProduct:
  id: product-@
  name: Product @
  description: the product
  kind: dataproduct
  domain: sales
  version: '1'
  environment: #environment
  dataProductOwner: user:owner.@_example.com
  ownerGroup: group:owners
  devGroup: #group
  tags: []
  specific: {}
  components:
    - kind: outputport
      id: view-@
      name: View @
      description: a view
      useCaseTemplateId: urn:template:view:1
      infrastructureTemplateId: urn:infra:1
      specific: {workspace: ws_@, catalogName: cat, schemaName: raw, tableName: c@, sqlWarehouseName: wh,
                 workspaceOP: ws_@, catalogNameOP: pub, schemaNameOP: s#nation, viewNameOP: #view}
      version: '1'
      dependsOn: []
      outputPortType: SQL
      tags: []
      semanticLinking: []
      dataContract:
        schema:
          - {name: key, dataType: BIGINT, constraint: PRIMARY_KEY}
          - {name: note, dataType: varchar, dataLength: 20, tags: [{tagFQN: PII}]}
    - kind: storage
      id: store-@
      name: Store @
      description: a store
      useCaseTemplateId: urn:template:store:1
      infrastructureTemplateId: urn:infra:1
      specific: {}
      dependsOn: []
      tags: []
componentIdToProvision: #wanted
"""


def _requests(spark, sf_dir):
    """A descriptor per customer: some unreadable, of another component, without a view name."""
    key = F.col("c_custkey")
    values = {
        "#environment": F.when(key % 2 == 0, "development").otherwise("production"),
        "#group": F.lower("n_name"),
        "#nation": F.col("c_nationkey").cast("string"),
        "#view": F.when(key % 17 == 0, "''").otherwise(F.concat(F.lit("v"), key.cast("string"))),
        "#wanted": F.when(key % 19 == 0, "store-@").otherwise("view-@"),
        "@": key.cast("string"),
    }
    text = F.lit(_PRODUCT)
    for name, value in values.items():
        text = F.replace(text, F.lit(name), value)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    return customers.select("c_custkey", F.when(key % 13 == 0, "dataProduct: [").otherwise(text).alias("descriptor"))


def _products(spark, sf_dir):
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = parse_descriptors(_requests(spark, sf_dir), partitions=spread)
    # Ports, contracts and statuses all read the products; the texts are parsed once for them.
    folder = f"{shared_folder(spark)}/products-{uuid.uuid4().hex}"
    parsed.write.parquet(folder)
    return spark.read.schema(parsed.schema).parquet(folder)


def _verdicts(spark, sf_dir, products):
    return provision.port_verdicts(
        requested_ports(products),
        derived(spark, sf_dir, "product_inventory"),
        derived(spark, sf_dir, "product_workspaces"),
        derived(spark, sf_dir, "groups"),
    )


# The requests and their verdicts by arithmetic on the customer's key.
_JUDGED = """canon AS (SELECT lower(display_name) AS g, count(*) AS n, min(display_name) AS display FROM {groups} GROUP BY 1),
  asked AS (SELECT *, CASE WHEN n = 1 THEN display END AS dev_name, c_custkey % 2 = 0 AS in_dev,
                   concat('pub.s', CAST(c_nationkey AS STRING), '.v', CAST(c_custkey AS STRING)) AS view_name
            FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN canon ON g = lower(n_name)),
  found AS (SELECT *, CASE WHEN c_custkey % 17 = 0 THEN 'INVALID_FIELDS'
                WHEN c_custkey % 10 = 3 THEN 'WORKSPACE_UNKNOWN'
                WHEN c_custkey % 8 = 0 THEN 'METASTORE_NOT_ATTACHED_YET'
                WHEN c_custkey % 9 = 0 THEN CASE WHEN in_dev THEN 'TABLE_NOT_CREATED_YET' ELSE 'TABLE_NOT_DEPLOYED' END
                WHEN c_custkey % 5 = 0 THEN 'COLUMNS_MISSING' END AS first_reason FROM asked),
  judged AS (SELECT *, CASE WHEN in_dev AND dev_name IS NULL AND coalesce(first_reason, 'WORKSPACE_UNKNOWN')
                              IN ('WORKSPACE_UNKNOWN', 'METASTORE_NOT_ATTACHED_YET') THEN 'PRINCIPAL_UNKNOWN'
                            ELSE first_reason END AS reason FROM found),
  ports AS (SELECT *, coalesce(reason, 'WORKSPACE_UNKNOWN') IN ('WORKSPACE_UNKNOWN', 'METASTORE_NOT_ATTACHED_YET') AS passes
            FROM judged WHERE c_custkey % 13 <> 0 AND c_custkey % 19 <> 0)"""


@query(
    "contract_from_descriptors",
    """SELECT concat('pub.s', CAST(c_nationkey AS STRING), '.v', CAST(c_custkey AS STRING)) AS target_view,
              concat('cat.raw.c', CAST(c_custkey AS STRING)) AS source_table, pos, name, data_type, data_length, tag
       FROM customer, (VALUES (0, 'key', 'BIGINT', NULL, NULL), (1, 'note', 'varchar', 20, 'PII/Classification'))
                      c(pos, name, data_type, data_length, tag)
       WHERE c_custkey % 13 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 17 <> 0""",
)
def contract_from_descriptors(spark, sf_dir):
    ports = requested_ports(_products(spark, sf_dir)).where(F.size("errors") == 0)
    tag = F.get("tags", F.lit(0))
    return contract_columns(ports).select(
        "target_view", "source_table", "pos", "name", "data_type", "data_length",
        F.concat(tag["tagFQN"], F.lit("/"), tag["source"]).alias("tag"),
    )


@query(
    "provision_plan",
    f"""AS_WITH {_JUDGED},
      grants AS (SELECT view_name, principal, kind, name, privilege
                 FROM (SELECT view_name, unnest([concat('owner.', CAST(c_custkey AS VARCHAR), '@example.com'), dev_name]) AS principal
                       FROM ports WHERE passes AND in_dev),
                      LATERAL (VALUES ('TABLE', view_name, 'SELECT'),
                                      ('CATALOG', split_part(view_name, '.', 1), 'USE_CATALOG'),
                                      ('SCHEMA', split_part(view_name, '.', 1) || '.' || split_part(view_name, '.', 2),
                                       'USE_SCHEMA')) o(kind, name, privilege))
      SELECT view_name AS target_view, 1 AS step,
             CASE reason WHEN 'WORKSPACE_UNKNOWN' THEN 'CREATE' ELSE 'ATTACH_METASTORE' END AS action,
             'WORKSPACE' AS object_type, concat('ws_', CAST(c_custkey AS STRING)) AS object_name,
             CAST(NULL AS VARCHAR) AS principal, CAST(NULL AS VARCHAR) AS privilege
      FROM ports WHERE passes AND reason IS NOT NULL
      UNION ALL SELECT view_name, 2, 'CREATE_IF_ABSENT', 'CATALOG', 'pub', NULL, NULL FROM ports WHERE passes
      UNION ALL SELECT view_name, 3, 'CREATE_IF_ABSENT', 'SCHEMA', concat('pub.s', CAST(c_nationkey AS STRING)), NULL, NULL
      FROM ports WHERE passes
      UNION ALL SELECT view_name, 4, 'PUBLISH', 'VIEW', view_name, NULL, NULL FROM ports WHERE passes
      UNION ALL SELECT view_name, 5, 'GRANT', kind, name, principal, privilege FROM grants""",
)
def plan_from_descriptors(spark, sf_dir):
    """The steps of every port that may be published, from YAML text on."""
    return provision.provision_plan(_verdicts(spark, sf_dir, _products(spark, sf_dir)))


@query(
    "provision_statuses",
    f"""AS_WITH {_JUDGED}
      SELECT c_custkey, CASE WHEN problems = '' THEN 'COMPLETED' ELSE 'FAILED' END AS status, problems
      FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'unreadable YAML'
                   WHEN c_custkey % 19 = 0 THEN 'NOT_AN_OUTPUT_PORT'
                   WHEN reason = 'INVALID_FIELDS' THEN 'INVALID_FIELDS;missing viewNameOP'
                   WHEN reason IN ('WORKSPACE_UNKNOWN', 'METASTORE_NOT_ATTACHED_YET') OR reason IS NULL THEN ''
                   ELSE reason END AS problems FROM judged)""",
)
def statuses(spark, sf_dir):
    """One row per request, however it ended."""
    products = _products(spark, sf_dir)
    shown = F.transform("problems", lambda p: F.regexp_replace(p, "^(unreadable YAML):(?s).*", "$1"))
    return provision.provision_statuses(products, _verdicts(spark, sf_dir, products)).select(
        "c_custkey", "status", F.array_join(shown, ";").alias("problems")
    )
