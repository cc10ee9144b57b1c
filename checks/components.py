"""Descriptors, components, field rules and routing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.inputs import derived, table
from checks.registry import query
from concordat.functions.names import template_base_id
from concordat.operators import components as c
from concordat.operators.component_rules import component_problems
from concordat.operators.workload_rules import with_workload_problems
from concordat.session import shared_folder
from concordat.sources.descriptors import parse_descriptors
from concordat.sources.documents import follow_documents

ROUTES = {
    "job": ["urn:template:batch-job"],
    "workflow": ["urn:template:task-graph"],
    "outputport": ["urn:template:view"],
    "dlt": ["urn:template:live-tables"],
}

_BASE_SQL = "trim(replace(regexp_replace(template_id, ':[^:]*$', ''), '\"', ''))"
_ROUTE_SQL = f"""CASE {_BASE_SQL} WHEN 'urn:template:batch-job' THEN 'job' WHEN 'urn:template:task-graph' THEN 'workflow'
    WHEN 'urn:template:view' THEN 'outputport' WHEN 'urn:template:live-tables' THEN 'dlt' END"""

_YAML = """dataProduct:
  id: product-{key}
  name: Product {key}
  description: "made from {name}"
  kind: {kind}
  domain: sales
  version: '1'
  environment: development
  dataProductOwner: user:owner.{key}_example.com
  ownerGroup: group:owners
  devGroup: dev-{nation}
  tags: []
  specific: {{}}
  components:
    - kind: outputport
      id: view-{key}
      name: View {key}
      description: a view
      useCaseTemplateId: urn:template:view:1
      infrastructureTemplateId: urn:infra:1
      specific: {{workspace: ws, viewName: v{key}}}
      version: '1'
      dependsOn: [load-{key}]
      outputPortType: SQL
      tags: []
      semanticLinking: []
      dataContract:
        schema:
          - {{name: key, dataType: BIGINT, constraint: PRIMARY_KEY}}
          - {{name: note, dataType: STRING, tags: [{{tagFQN: PII}}]}}
    - kind: {second}
      id: load-{key}
      name: Load {key}
      description: a job
      useCaseTemplateId: urn:template:batch-job:1
      infrastructureTemplateId: urn:infra:1
      specific: {{workspace: ws}}
      version: '1'
      dependsOn: []
      connectionType: DataPipeline
      tags: []
componentIdToProvision: view-{key}
"""


def _descriptors(spark, sf_dir):
    """A YAML descriptor per customer: some unreadable, some of a wrong kind or with an unknown component."""
    key = F.col("c_custkey")
    values = {
        "key": key.cast("string"),
        "name": F.col("c_name"),
        "nation": F.col("c_nationkey").cast("string"),
        "kind": F.when(key % 11 == 0, "datalake").otherwise("dataproduct"),
        "second": F.when(key % 7 == 0, "daemon").otherwise("workload"),
    }
    pieces = []
    for part in _split_template(_YAML):
        pieces.append(values[part[1]] if part[0] else F.lit(part[1]))
    text = F.when(key % 13 == 0, F.lit("dataProduct: [unclosed")).otherwise(F.concat(*pieces))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("descriptor"))


def _split_template(template):
    import string

    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            yield False, literal
        if field:
            yield True, field


def _parsed(spark, sf_dir):
    return parse_descriptors(
        _descriptors(spark, sf_dir), partitions=int(spark.conf.get("spark.sql.shuffle.partitions"))
    )


_DESCRIPTORS_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 7 <> 0
                             THEN concat('product-', CAST(c_custkey AS STRING)) END AS product_id,
              CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 7 <> 0
                   THEN concat('made from ', c_name) END AS description,
              CASE WHEN c_custkey % 13 <> 0 THEN concat('view-', CAST(c_custkey AS STRING)) END AS component_id,
              CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 7 <> 0
                   THEN 'key BIGINT,note STRING' END AS contract,
              CASE WHEN c_custkey % 13 = 0 THEN 'unreadable YAML'
                   ELSE concat_ws(';', CASE WHEN c_custkey % 11 = 0 THEN 'product kind is not dataproduct' END,
                                  CASE WHEN c_custkey % 7 = 0 THEN 'component 1: unknown kind daemon' END)
              END AS errors
       FROM customer"""


@query("s6_parsed_descriptors", _DESCRIPTORS_SQL)
def parsed_descriptors(spark, sf_dir):
    return _described(_parsed(spark, sf_dir))


@query("s6_followed_descriptors", _DESCRIPTORS_SQL)
def followed_descriptors(spark, sf_dir):
    """The same descriptors in files of many documents, read and parsed by a stream in two runs."""
    folder = f"{shared_folder(spark)}/descriptors-{uuid.uuid4().hex}"
    texts = _descriptors(spark, sf_dir)
    document = F.concat(F.lit("--- # customer "), F.col("c_custkey").cast("string"), F.lit("\n"), F.col("descriptor"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = "c_custkey bigint, product_id string, description string, component_id string, contract string, errors string"
    for run in (0, 1):
        coming = texts.where(F.pmod(F.xxhash64("c_custkey"), F.lit(2)) == run)
        coming.repartition(tasks, "c_custkey").select(document).write.mode("append").text(f"{folder}/in")
        stream = follow_documents(spark, f"{folder}/in", f"{folder}/log", range_bytes=1 << 20)
        key = F.regexp_extract("descriptor", r"^ # customer (\d+)", 1).cast("bigint")
        described = _described(parse_descriptors(stream.withColumn("c_custkey", key)))
        query = described.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        query.start(f"{folder}/out").awaitTermination()
    return spark.read.schema(columns).parquet(f"{folder}/out")


def _described(parsed):
    contract = F.transform(
        F.get(F.col("product.components"), F.lit(0))["dataContract"]["schema"],
        lambda column: F.concat(column["name"], F.lit(" "), column["dataType"]),
    )
    return parsed.select(
        "c_custkey",
        F.col("product.id").alias("product_id"),
        F.col("product.description").alias("description"),
        "component_id",
        F.array_join(contract, ",").alias("contract"),
        # The reader's own wording after the colon is not compared.
        F.array_join(
            F.transform("errors", lambda e: F.regexp_replace(e, "^(unreadable YAML):(?s).*", "$1")), ";"
        ).alias("errors"),
    )


@query(
    "s6_components_to_provision",
    """SELECT concat('product-', CAST(c_custkey AS STRING)) AS product_id, 0 AS pos,
              concat('view-', CAST(c_custkey AS STRING)) AS id, 'outputport' AS kind, 'base' AS shape
       FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 7 <> 0""",
)
def components_to_provision(spark, sf_dir):
    """The component each readable descriptor asks for."""
    parsed = _parsed(spark, sf_dir).where("product IS NOT NULL")
    nested = parsed.select("product.id", "product.components", "component_id")
    wanted = nested.withColumn(
        "components", F.filter("components", lambda one: one["id"] == F.col("component_id"))
    )
    return c.component_by_id(c.explode_components(wanted)).select(
        "product_id", "pos", "id", "kind", c.specific_shape("specific").alias("shape")
    )


@query("p3_components_of_kind", "SELECT product_id, pos, id FROM {components} WHERE kind = 'workload'")
def components_of_kind(spark, sf_dir):
    return c.components_of_kind(derived(spark, sf_dir, "components"), "workload").select(
        "product_id", "pos", "id"
    )


@query(
    "p4_component_by_id",
    """SELECT product_id, id, min(pos) AS pos, arg_min(kind, pos) AS kind, arg_min(template_id, pos) AS template_id
       FROM {components} GROUP BY product_id, id""",
)
def component_by_id(spark, sf_dir):
    rows = derived(spark, sf_dir, "components").drop("depends_list")
    return c.component_by_id(rows).select("product_id", "id", "pos", "kind", "template_id")


@query("k7_template_base_id", f"SELECT id, pos, product_id, {_BASE_SQL} AS base_id FROM {{components}}")
def base_id(spark, sf_dir):
    rows = derived(spark, sf_dir, "components")
    return rows.select("id", "pos", "product_id", template_base_id("template_id").alias("base_id"))


@query(
    "v1_component_errors",
    """SELECT product_id, pos, CASE kind
           WHEN 'outputport' THEN 'missing version,missing dependsOn,missing outputPortType,missing dataContract,missing tags,missing semanticLinking'
           WHEN 'workload' THEN 'missing version,missing dependsOn,missing tags'
           WHEN 'storage' THEN 'missing tags'
           WHEN 'observability' THEN 'missing endpoint,missing completeness,missing dataProfiling,missing freshness,missing availability,missing dataQuality'
           ELSE 'unknown kind other' END AS errors
       FROM {components}""",
)
def component_errors(spark, sf_dir):
    """The kinds read the same JSON text with their own required fields."""
    rows = derived(spark, sf_dir, "components").select(
        "product_id", "pos",
        F.to_json(
            F.struct(
                "id", "kind", F.col("id").alias("name"), F.lit("text").alias("description"),
                F.col("template_id").alias("useCaseTemplateId"),
                F.lit("infra").alias("infrastructureTemplateId"),
                F.when(F.col("kind") == "storage", F.split("depends_list", ",")).alias("dependsOn"),
                F.when(F.col("kind") == "workload", F.lit("housekeeping")).alias("connectionType"),
            )
        ).alias("document"),
    )
    from concordat.schemas import COMPONENT

    parsed = rows.withColumn("component", F.from_json("document", COMPONENT))
    names = [f.name for f in COMPONENT.fields]
    return parsed.select(
        "product_id", "pos",
        F.array_join(c.component_errors(names, F.col("component")), ",").alias("errors"),
    )


@query(
    "v1_specific_shape",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'workload' WHEN p_partkey % 3 = 1 THEN 'base' END AS shape
       FROM part""",
)
def specific_shape(spark, sf_dir):
    key = F.col("p_partkey")
    document = F.when(
        key % 3 == 0,
        F.concat(F.lit('{"workspace": "w", "repoPath": "/r", "git": {"gitRepoUrl": "u'), key, F.lit('"}}')),
    ).when(key % 3 == 1, F.concat(F.lit('{"workspace": "w", "repoPath": "/'), key, F.lit('"}')))
    return table(spark, sf_dir, "part").select(
        "p_partkey", c.specific_shape(document).alias("shape")
    )


@query(
    "v2_template_routes",
    f"""SELECT product_id, pos, kind, CASE WHEN error IS NULL THEN route END AS route, error
        FROM (SELECT *, CASE WHEN kind NOT IN ('workload', 'outputport') THEN 'UNSUPPORTED_KIND'
                     WHEN route IS NULL THEN 'UNSUPPORTED_TEMPLATE'
                     WHEN (route = 'outputport') <> (kind = 'outputport') THEN 'KIND_MISMATCH' END AS error
              FROM (SELECT *, {_ROUTE_SQL} AS route FROM {{components}}))""",
)
def template_routes(spark, sf_dir):
    return c.route_components(derived(spark, sf_dir, "components"), ROUTES).select(
        "product_id", "pos", "kind", "route", "error"
    )


@query(
    "v2_reverse_routes",
    f"""SELECT product_id, pos, CASE WHEN route IN ('workflow', 'outputport') THEN route END AS route
        FROM (SELECT *, {_ROUTE_SQL} AS route FROM {{components}})""",
)
def reverse_routes(spark, sf_dir):
    rows = derived(spark, sf_dir, "components")
    return rows.select("product_id", "pos", c.reverse_route("template_id", ROUTES).alias("route"))


@query(
    "v3_field_rules",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN length(o_orderpriority) < 6 THEN 'o_orderpriority shorter than 6' END,
              CASE WHEN o_custkey < 100 THEN 'o_custkey below 100' END,
              CASE WHEN o_orderstatus = 'P' THEN 'notebooks is empty' END) AS violations
       FROM orders""",
)
def field_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn(
        "notebooks",
        F.when(F.col("o_orderstatus") != "P", F.array("o_orderpriority")).otherwise(
            F.array().cast("array<string>")
        ),
    )
    rules = [c.min_length("o_orderpriority", 6), c.at_least("o_custkey", 100), c.not_empty_list("notebooks")]
    return c.with_violations(rows, rules).select(
        "o_orderkey", F.array_join("violations", ",").alias("violations")
    )


@query(
    "v4_cluster_sizing",
    """SELECT cluster_id, CASE WHEN mode IN ('ENHANCED', 'LEGACY') THEN
             CASE WHEN min_workers IS NULL OR max_workers IS NULL THEN 'autoscale needs min and max workers'
                  WHEN num_workers IS NOT NULL THEN 'autoscale excludes a fixed number' END
           ELSE CASE WHEN num_workers IS NULL THEN 'fixed size needs a number of workers'
                  WHEN min_workers IS NOT NULL OR max_workers IS NOT NULL
                  THEN 'fixed size excludes min and max workers' END END AS problem
       FROM {clusters}""",
)
def cluster_sizing(spark, sf_dir):
    return derived(spark, sf_dir, "clusters").select("cluster_id", c.cluster_sizing().alias("problem"))


@query(
    "e8_dangling_dependencies",
    """SELECT product_id, id, depends_on FROM (
           SELECT product_id, id, unnest(split(depends_list, ',')) AS depends_on FROM {components})
       WHERE depends_on NOT IN (SELECT id FROM {components})""",
)
def dangling_dependencies(spark, sf_dir):
    return c.dangling_dependencies(derived(spark, sf_dir, "component_rows")).select(
        "product_id", "id", "depends_on"
    )


@query(
    "e9_tagged_columns",
    "SELECT target_view, name FROM {contract_columns} WHERE tag = 'PII.Sensitive'",
)
def tagged_columns(spark, sf_dir):
    contract = derived(spark, sf_dir, "contract_columns").withColumn(
        "tags",
        F.when(
            F.col("tag").isNotNull(),
            F.array(F.struct(F.col("tag").alias("tagFQN"), F.lit("Classification").alias("source"))),
        ),
    )
    return c.tagged_columns(contract, "PII.Sensitive").select("target_view", "name")


_TAG = {"tagFQN": "Tier.Gold", "source": "glossary", "labelType": "DERIVED", "state": "suggested"}
_COLUMN = {"name": "amount", "dataType": "decimal", "dataLength": "12", "precision": 10, "scale": 2.0, "tags": [_TAG]}
_COMMON = {
    "id": "cmp-@", "name": "Component @", "description": "text", "useCaseTemplateId": "urn:t:1",
    "infrastructureTemplateId": "urn:i:1", "specific": None,
}
_VALID = {
    "outputport": {
        **_COMMON, "version": "1", "dependsOn": ["cmp-1"], "outputPortType": "SQL", "tags": [_TAG],
        "creationDate": "2024-05-01T10:00:00Z", "dataContract": {"schema": [_COLUMN, {"name": "n", "dataType": "STRING"}]},
        "dataSharingAgreement": {"purpose": "reports"}, "semanticLinking": [{"of": "amount"}],
    },
    "workload": {
        **_COMMON, "version": "1", "dependsOn": [], "connectionType": "housekeeping", "tags": [], "readsFrom": ["x"],
    },
    "storage": {**_COMMON, "dependsOn": [], "tags": [_TAG], "storageType": "files"},
    "observability": {
        **_COMMON, "endpoint": "https://look.example.com/@", "completeness": {}, "dataProfiling": {"rows": 1},
        "freshness": {}, "availability": {}, "dataQuality": {},
    },
}
_ABSENT = object()


def _schema(**changes):
    return {"dataContract": {"schema": [_COLUMN, {**_COLUMN, **changes}]}}


# Kind, what differs from the valid document, and the problems that makes.
_BREAKS = [
    *[(kind, {}, "") for kind in _VALID],
    ("outputport", {"version": 1}, "wrong type of version"),
    ("outputport", {"version": None}, "missing version"),
    ("outputport", {"specific": _ABSENT, "dependsOn": "cmp-1"}, "missing specific;wrong type of dependsOn"),
    ("outputport", {"dependsOn": ["a", None, 3]}, "wrong type of dependsOn[1];wrong type of dependsOn[2]"),
    ("outputport", {"outputPortType": _ABSENT}, "missing outputPortType"),
    ("outputport", {"creationDate": "soon", "startDate": 1714557600}, "wrong type of creationDate"),
    ("outputport", {"dataContract": _ABSENT}, "missing dataContract"),
    ("outputport", {"dataContract": {}}, ""),
    ("outputport", {"dataContract": {"schema": {"name": "a"}}}, "wrong type of dataContract.schema"),
    ("outputport", {"dataContract": {"schema": ["a"]}}, "wrong type of dataContract.schema[0]"),
    ("outputport", _schema(dataType="NUMBERS"), "invalid dataContract.schema[1].dataType"),
    ("outputport", _schema(name=None, scale=2.5), "missing dataContract.schema[1].name;wrong type of dataContract.schema[1].scale"),
    ("outputport", _schema(dataLength="abc", precision=True),
     "wrong type of dataContract.schema[1].dataLength;wrong type of dataContract.schema[1].precision"),
    ("outputport", _schema(tags=[{}]), "missing dataContract.schema[1].tags[0].tagFQN"),
    ("outputport", _schema(tags=[_TAG, {**_TAG, "source": "Nope"}]), "invalid dataContract.schema[1].tags[1].source"),
    ("outputport", _schema(tags=[{**_TAG, "labelType": None}]), "wrong type of dataContract.schema[1].tags[0].labelType"),
    ("outputport", {"dataSharingAgreement": {"billing": 3}}, "wrong type of dataSharingAgreement.billing"),
    ("outputport", {"sampleData": [], "semanticLinking": ["x"]}, "wrong type of sampleData;wrong type of semanticLinking[0]"),
    ("workload", {"connectionType": "rope"}, "invalid connectionType"),
    ("workload", {"connectionType": _ABSENT}, "missing connectionType"),
    ("workload", {"readsFrom": [1], "tags": [{"tagFQN": 5, "state": "late"}]},
     "wrong type of tags[0].tagFQN;invalid tags[0].state;wrong type of readsFrom[0]"),
    ("storage", {"tags": None, "storageType": {}}, "wrong type of storageType;missing tags"),
    ("storage", {"description": _ABSENT, "fullyQualifiedName": False}, "missing description;wrong type of fullyQualifiedName"),
    ("observability", {"endpoint": "look"}, "invalid endpoint"),
    ("observability", {"endpoint": 3, "freshness": "daily"}, "wrong type of endpoint;wrong type of freshness"),
    ("observability", {"availability": _ABSENT, "dataQuality": None}, "missing availability;missing dataQuality"),
    ("daemon", {}, "unknown kind daemon"),
]


def _by_case(texts):
    whens = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(texts))
    return f"CASE p_partkey % {len(texts)} {whens} END"


def _documents():
    import json

    for kind, changes, _ in _BREAKS:
        whole = {"kind": kind, **_VALID.get(kind, _COMMON), **changes}
        yield json.dumps({name: value for name, value in whole.items() if value is not _ABSENT})


@query(
    "v1_component_documents",
    f"""SELECT p_partkey, concat('cmp-', CAST(p_partkey AS VARCHAR)) AS id,
               {_by_case([problems for _, _, problems in _BREAKS])} AS problems FROM part""",
)
def component_documents(spark, sf_dir):
    """Components as JSON, each kind valid and with every kind of fault, checked down to their tags."""
    text = F.replace(F.expr(_by_case(list(_documents()))), F.lit("@"), F.col("p_partkey").cast("string"))
    read = table(spark, sf_dir, "part").select("p_partkey", F.parse_json(text).alias("component"))
    return read.select(
        "p_partkey",
        F.expr("try_variant_get(component, '$.id', 'string')").alias("id"),
        F.array_join(F.expr(component_problems("component")), ";").alias("problems"),
    )


# Parts of workloads, each with the one problem it has; the first of each route is sound.
_GIT = '"git": {"gitRepoUrl": "u", "gitReference": "main", "gitReferenceType": "branch", "gitPath": "/p"}'
_JOB = (
    '{"workspace": "w", "repoPath": "/r", ' + _GIT + ', "jobName": "j", "scheduling": {"cronExpression": "c", "javaTimezoneId": "UTC"}, '
    '"cluster": {"clusterSparkVersion": "15", "nodeTypeId": "n", "numWorkers": 2, "availability": "SPOT_AZURE", "sparkConf": [{"name": "a", "value": "b"}]}}'
)
_FLOW = (
    '{"workspace": "w", "repoPath": "/r", "git": {"gitRepoUrl": "u"}, "workflow": {"name": "f"}, "override": true, '
    '"workflowTasksInfoList": [{"taskKey": "a"}, {"task_key": "b"}]}'
)
_PIPELINE = (
    '{"workspace": "w", "repoPath": "/r", "git": {"gitRepoUrl": "u"}, "pipelineName": "p", "catalog": "c", "productEdition": "PRO", '
    '"continuous": false, "photon": "yes", "channel": "Current", "notebooks": ["n"], "target": "t", "notifications": [{"mail": "m", "alert": []}], '
    '"cluster": {"mode": "ENHANCED", "minWorkers": 1, "maxWorkers": "3", "workerType": "x", "driver_type": "y", "tags": {"k": "v"}}}'
)


def _broken(text, *changes):
    """The part with each change made, and its problem."""
    return [(text, "")] + [(text.replace(old, new, 1), problem) for old, new, problem in changes]


_PARTS = {
    "job": _broken(
        _JOB, ('"repoPath": "/r", ', "", "missing repoPath"), ('"workspace": "w"', '"workspace": 5', "wrong type of workspace"),
        (_GIT + ", ", "", "missing git"), ('"branch"', '"commit"', "invalid git.gitReferenceType"),
        ('"gitPath"', '"gitProvider": "github", "gitPath"', "invalid git.gitProvider"), ('"numWorkers": 2', '"numWorkers": 0', "invalid cluster.numWorkers"),
        ('"numWorkers": 2', '"numWorkers": "2.5"', "wrong type of cluster.numWorkers"), (', "value": "b"', "", "missing cluster.sparkConf[0].value"),
        ('"SPOT_AZURE"', '"spot_azure"', "invalid cluster.availability"), (', "javaTimezoneId": "UTC"', "", "missing scheduling.javaTimezoneId"),
        ('"jobName": "j"', '"jobName": null', "missing jobName"), ('"numWorkers": 2', '"numWorkers": " 7 ", "spotBidMaxPrice": "0.5"', ""),
        ('"numWorkers": 2', '"numWorkers": 2, "spotInstances": "maybe"', "wrong type of cluster.spotInstances"),
    ),
    "workflow": _broken(
        _FLOW, ('"workflow": {"name": "f"}, ', "", "missing workflow"), ('"workflow": {"name": "f"}', '"workflow": []', "wrong type of workflow"),
        ('"override": true', '"override": null', "missing override"), ('"override": true', '"override": 0', ""),
        ('"taskKey": "a"', '"taskKey": 3', "wrong type of workflowTasksInfoList[0].taskKey"),
        ('"task_key": "b"', '"task_key": 3', "wrong type of workflowTasksInfoList[1].taskKey"),
        ('"workflowTasksInfoList": [{"taskKey": "a"}', '"workflow_tasks_info": ["x"', "wrong type of workflowTasksInfoList[0]"),
        ('"gitRepoUrl": "u"', "", "missing git.gitRepoUrl"), (_FLOW, "[]", "wrong type of specific"), (_FLOW, "{unclosed", "wrong type of specific"),
    ),
    "dlt": _broken(
        _PIPELINE, ('"pipelineName": "p"', '"pipelineName": ""', "invalid pipelineName"), ('"pipelineName"', '"pipeline_name"', ""),
        ('"notebooks": ["n"]', '"notebooks": []', "invalid notebooks"), ('["n"]', '["n", 1]', "wrong type of notebooks[1]"),
        ('"PRO"', '"gold"', "invalid productEdition"), ('"continuous": false', '"continuous": "maybe"', "wrong type of continuous"),
        ('"workerType": "x"', '"workerType": ""', "invalid cluster.workerType"), ('"minWorkers": 1, ', "", "cluster: autoscale needs min and max workers"),
        ('"minWorkers": 1', '"min_workers": 1', ""), ('"minWorkers": 1', '"minWorkers": 1, "num_workers": 2', "cluster: autoscale excludes a fixed number"),
        ('"mode": "ENHANCED", ', "", "cluster: fixed size needs a number of workers"),
        ('"mode": "ENHANCED"', '"mode": null, "numWorkers": 2', "cluster: fixed size excludes min and max workers"),
        ('"mode": "ENHANCED"', '"mode": "enhanced"', "invalid cluster.mode"), ('"alert": []', '"alert": "x"', "wrong type of notifications[0].alert"),
        ('{"k": "v"}', '{"k": 1}', "invalid cluster.tags"), ('"cluster": {', '"cluster": [{}], "other": {', "wrong type of cluster"),
    ),
}


def _chosen(at):
    """SQL of the part or the problem of an order: its route by its customer, its variant by its key."""
    cases = []
    for number, variants in enumerate(_PARTS.values()):
        inner = " ".join(f"WHEN {i} THEN '{v[at]}'" for i, v in enumerate(variants))
        cases.append(f"WHEN {number} THEN CASE o_orderkey % {len(variants)} {inner} END")
    return f"CASE o_custkey % 4 {' '.join(cases)} ELSE '{('{}', 'no rules for this template')[at]}' END"


@query(
    "v3_workload_rules",
    f"""SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'job' WHEN 1 THEN 'workflow' WHEN 2 THEN 'dlt' ELSE 'outputport' END AS route,
               {_chosen(1)} AS problems FROM orders""",
)
def workload_rules(spark, sf_dir):
    """The own part of a workload per order, by the rules of its template; every rule is broken somewhere."""
    template = "CASE o_custkey % 4 WHEN 0 THEN 'urn:template:batch-job:1' WHEN 1 THEN 'urn:template:task-graph:2' WHEN 2 THEN 'urn:template:live-tables:1' ELSE 'urn:template:view:1' END"
    parts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(template).alias("template_id"), F.expr(_chosen(0)).alias("specific"))
    return with_workload_problems(parts, ROUTES).select("o_orderkey", "route", F.array_join("problems", ";").alias("problems"))
