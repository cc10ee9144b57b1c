import pytest
from helpers import rows
from pyspark.sql import functions as F

from concordat.functions import names
from concordat.operators import components as c
from concordat.operators.existence import catalog_exists, schema_exists, table_exists
from concordat.sources.descriptors import parse_descriptors, read_descriptors

HEAD = """dataProduct:
  id: p1
  name: Product
  description: text
  kind: dataproduct
  domain: health
  version: 1.0.0
  environment: development
  dataProductOwner: user:ann_x.com
  ownerGroup: group:o
  devGroup: dev
  tags: []
  billing: {policy: free}
  specific: {cost: 3}
  components:
"""
COMMON = """      name: N
      description: D
      useCaseTemplateId: '"urn:t:view":1.0'
      infrastructureTemplateId: i
      specific: {workspace: ws, inner: [1, 2]}
"""
PORT = "    - kind: outputport\n      id: %s\n" + COMMON + """      version: 1.0.0
      dependsOn: [load]
      outputPortType: SQL
      creationDate: 2023-06-12T12:52:11.737Z
      tags: [{tagFQN: Gold}]
      semanticLinking: []
      dataContract:
        schema:
          - {name: date, dataType: DATE, constraint: PRIMARY_KEY, tags: [{tagFQN: PII, labelType: Manual}]}
        SLA: {upTime: 99}
"""
WORKLOAD = "    - kind: workload\n      id: load\n" + COMMON + """      version: 1.0.0
      dependsOn: []
      connectionType: datapipeline
      tags: []
"""
STORAGE = "    - kind: storage\n      id: store\n" + COMMON + "      dependsOn: []\n      tags: []\n"
OBSERVE = "    - kind: observability\n      id: look\n" + COMMON + """      endpoint: http://x
      completeness: {}
      dataProfiling: {}
      freshness: {}
      availability: {}
      dataQuality: {}
"""
ALL_KINDS = HEAD + PORT % "port1" + PORT % "port2" + WORKLOAD + STORAGE + OBSERVE + "componentIdToProvision: port2\n"


def parsed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, descriptor string")
    return parse_descriptors(df)


def test_product_with_all_kinds(spark):
    result = parsed(spark, ALL_KINDS)
    row = result.first()
    assert row["errors"] == [] and row["component_id"] == "port2"
    components = c.explode_components(result.select("product.*"))
    assert rows(components, "pos", "kind", "id") == [
        (0, "outputport", "port1"), (1, "outputport", "port2"), (2, "workload", "load"),
        (3, "storage", "store"), (4, "observability", "look"),
    ]
    assert rows(c.components_of_kind(components, "outputport"), "id") == [("port1",), ("port2",)]
    port = c.component_by_id(components).where("id = 'port2'").first()
    assert port["creationDate"].startswith("2023-06-12T12:52:11")
    assert port["dataContract"]["schema"][0]["tags"][0]["tagFQN"] == "PII"
    assert port["specific"] == '{"workspace":"ws","inner":[1,2]}'


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a: [1", "unreadable YAML"),
        ("just text", "descriptor is not a mapping"),
        ("", "descriptor is not a mapping"),
        (None, "descriptor is not a mapping"),
        ("componentIdToProvision: x", "missing dataProduct"),
        (ALL_KINDS.replace("kind: dataproduct", "kind: other"), "product kind is not dataproduct"),
        (ALL_KINDS.replace("  domain: health\n", ""), "missing domain"),
        (ALL_KINDS.replace("kind: storage", "kind: disk"), "component 3: unknown kind disk"),
        (ALL_KINDS.replace("connectionType: datapipeline", "connectionType: rope"), "component 2: invalid connectionType"),
        (ALL_KINDS.replace("      endpoint: http://x\n", ""), "component 4: missing endpoint"),
    ],
)
def test_bad_descriptors_are_rows(spark, text, expected):
    row = parsed(spark, text, ALL_KINDS).where("n = 0").first()
    assert row["product"] is None
    assert len(row["errors"]) == 1 and row["errors"][0].startswith(expected)


def test_every_problem_is_listed(spark):
    text = ALL_KINDS.replace("  domain: health\n", "").replace("      endpoint: http://x\n", "")
    assert parsed(spark, text).first()["errors"] == ["missing domain", "component 4: missing endpoint"]


def test_descriptor_kind(spark):
    df = spark.createDataFrame([(ALL_KINDS, "COMPONENT_DESCRIPTOR"), (ALL_KINDS, "OTHER"), (ALL_KINDS, None)],
                               "descriptor string, descriptor_kind string")
    assert rows(parse_descriptors(df), "descriptor_kind", F.size("errors")) == sorted(
        [("COMPONENT_DESCRIPTOR", 0), ("OTHER", 1), (None, 1)], key=repr)


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(ALL_KINDS)
    (tmp_path / "b.yaml").write_text("x: [")
    result = parse_descriptors(read_descriptors(spark, str(tmp_path)))
    assert rows(result.select(F.substring_index("source", "/", -1), F.size("errors"))) == [("a.yaml", 0), ("b.yaml", 1)]


def test_first_component_with_an_id(spark):
    df = spark.createDataFrame([("p", 2, "a", "late"), ("p", 1, "a", "early"), ("q", 0, "a", "x")],
                               "product_id string, pos int, id string, name string")
    assert rows(c.component_by_id(df), "product_id", "name") == [("p", "early"), ("q", "x")]


ROUTES = {"job": ["urn:job"], "workflow": ["urn:wf"], "outputport": ["urn:op"], "dlt": ["urn:dlt"]}


def test_routes(spark):
    df = spark.createDataFrame(
        [("workload", "urn:job:1"), ("workload", "urn:op:1"), ("outputport", '"urn:op":2'), ("outputport", "urn:dlt:1"),
         ("workload", "urn:none:1"), ("storage", "urn:job:1"), (None, "urn:job:1")], "kind string, template_id string")
    got = {(r["kind"], r["template_id"]): (r["route"], r["error"]) for r in c.route_components(df, ROUTES).collect()}
    assert got == {
        ("workload", "urn:job:1"): ("job", None), ("workload", "urn:op:1"): (None, "KIND_MISMATCH"),
        ("outputport", '"urn:op":2'): ("outputport", None), ("outputport", "urn:dlt:1"): (None, "KIND_MISMATCH"),
        ("workload", "urn:none:1"): (None, "UNSUPPORTED_TEMPLATE"), ("storage", "urn:job:1"): (None, "UNSUPPORTED_KIND"),
        (None, "urn:job:1"): (None, "UNSUPPORTED_KIND"),
    }
    reverse = df.select("template_id", c.reverse_route("template_id", ROUTES).alias("r")).distinct()
    assert rows(reverse.where("r IS NOT NULL")) == [('"urn:op":2', "outputport"), ("urn:op:1", "outputport")]


def test_template_ids(spark):
    cases = {'"urn:a:b":0.0.1': "urn:a:b", " x:1 ": "x", "plain": "plain", "a:b\nc": "a", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", names.template_base_id("t")).collect()} == cases


def test_shapes(spark):
    df = spark.createDataFrame(
        [(0, '{"workspace":"w","repoPath":"/","git":{"gitRepoUrl":"u"}}'), (1, '{"workspace":"w"}'), (2, "{}"), (3, None)],
        "n int, d string")
    assert rows(df.select("n", c.specific_shape("d"))) == [(0, "workload"), (1, "base"), (2, None), (3, None)]


def test_cluster_sizing(spark):
    df = spark.createDataFrame(
        [("ENHANCED", 1, 2, None), ("LEGACY", 1, None, None), ("LEGACY", 1, 2, 3), (None, None, None, 3),
         (None, None, None, None), ("OTHER", 1, None, 3)],
        "mode string, min_workers int, max_workers int, num_workers int")
    assert [r[0] for r in df.select(c.cluster_sizing()).collect()] == [
        None, "autoscale needs min and max workers", "autoscale excludes a fixed number", None,
        "fixed size needs a number of workers", "fixed size excludes min and max workers",
    ]


def test_field_rules(spark):
    df = spark.createDataFrame([("", 0, []), (None, None, None), ("x", 1, ["n"])], "name string, n int, notebooks array<string>")
    rules = [c.min_length("name"), c.at_least("n", 1), c.not_empty_list("notebooks")]
    assert [len(r["violations"]) for r in c.with_violations(df, rules).collect()] == [3, 3, 0]


def test_dependencies_and_tags(spark):
    df = spark.createDataFrame([("p", "a", ["b", "zz"]), ("p", "b", [])], "product_id string, id string, depends_on array<string>")
    assert rows(c.dependency_edges(df)) == [("p", "a", "b"), ("p", "a", "zz")]
    assert rows(c.dangling_dependencies(df), "depends_on") == [("zz",)]
    tags = spark.createDataFrame([("x", [("PII",)]), ("y", None), ("z", [("Gold",)])], "name string, tags array<struct<tagFQN:string>>")
    assert rows(c.tagged_columns(tags, "PII"), "name") == [("x",)]


def test_existence(spark):
    catalogs = spark.createDataFrame([("Prod",)], "catalog string")
    schemas = spark.createDataFrame([("PROD", "Sales")], "catalog string, schema string")
    wanted = spark.createDataFrame([("prod", "SALES"), ("prod", "x"), ("none", "sales")], "catalog string, schema string")
    assert rows(catalog_exists(wanted, catalogs), "catalog", "catalog_exists") == [("none", False), ("prod", True), ("prod", True)]
    assert rows(schema_exists(wanted, catalogs, schemas)) == [
        ("none", "sales", None, "CATALOG_NOT_FOUND"), ("prod", "SALES", True, None), ("prod", "x", False, None),
    ]
    tables = spark.createDataFrame([("a.b.c",)], "table_name string")
    assert rows(table_exists(spark.createDataFrame([("a.b.c",), ("A.b.c",)], "table_name string"), tables)) == [
        ("A.b.c", False), ("a.b.c", True),
    ]


def test_names(spark):
    df = spark.sql("SELECT 'c' AS c, 's`x' AS s, CAST(NULL AS STRING) AS n, TIMESTAMP_NTZ'2024-01-02 03:04:05.678901' AS ts")
    row = df.select(
        names.qualified_name("c", "s"), names.quoted_name("c", "s"), names.qualified_name("c", "n"), names.iso_millis_utc("ts")
    ).first()
    assert tuple(row) == ("c.s`x", "`c`.`s``x`", None, "2024-01-02T03:04:05.678Z")


@pytest.mark.parametrize(
    "identifier, expected",
    [
        ("https://adb-123.45.azuredatabricks.net", (False, "123", None)),
        ("adb-9.1.azuredatabricks.net/path", (False, "9", None)),
        ("my-workspace", (True, None, "my-workspace")),
        ("x https://adb-123.45.azuredatabricks.net", (True, None, "x https://adb-123.45.azuredatabricks.net")),
    ],
)
def test_workspace_reference(spark, identifier, expected):
    df = spark.createDataFrame([(identifier,)], "w string").select(names.workspace_reference("w").alias("r"))
    assert tuple(df.first()["r"]) == expected


def test_canonical_member(spark):
    df = spark.createDataFrame([("MANUAL",), ("derived",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(names.canonical_member("v", ["Manual", "Derived"])).collect()]
    assert got == ["Manual", "Derived", None, None]


def test_other_columns_do_not_pass_through_python(spark):
    df = spark.createDataFrame([(9007199254740993, ALL_KINDS), (None, ALL_KINDS)], "key bigint, descriptor string")
    assert rows(parse_descriptors(df), "key") == sorted([(9007199254740993,), (None,)], key=repr)


@pytest.mark.parametrize(
    "old, new, expected",
    [
        ("componentIdToProvision: port2\n", "", "missing componentIdToProvision"),
        ("Provision: port2", "Provision: port9", "componentIdToProvision is not a component of the product"),
        ("constraint: PRIMARY_KEY", "dataLength: abc", "component 0: wrong type of dataContract.schema[0].dataLength"),
        ("dataType: DATE", "dataType: NUMBERS", "component 0: invalid dataContract.schema[0].dataType"),
        ("tags: [{tagFQN: Gold}]", "tags: [{}]", "component 0: missing tags[0].tagFQN"),
        ("  domain: health", "  domain: 5", "wrong type of domain"),
    ],
)
def test_nested_rules(spark, old, new, expected):
    errors = parsed(spark, ALL_KINDS.replace(old, new)).first()["errors"]
    # The port comes twice in the text, so its faults do as well.
    assert errors == [expected, *([expected.replace("component 0", "component 1")] if "component 0" in expected else [])]


def test_defaults_and_numbers_of_the_model(spark):
    text = ALL_KINDS.replace("constraint: PRIMARY_KEY", "dataLength: '10', precision: 5.0")
    product = parsed(spark, text).first()["product"]
    column = product["components"][0]["dataContract"]["schema"][0]
    assert (column["dataLength"], column["precision"]) == (10, 5)
    tag = product["components"][0]["tags"][0]
    assert (tag["source"], tag["labelType"], tag["state"]) == ("Classification", "Manual", "Confirmed")
    assert product["components"][2]["connectionType"] == "DATAPIPELINE"
