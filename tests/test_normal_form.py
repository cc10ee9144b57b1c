import json
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from concordat.operators.definitions import compare_definitions
from concordat.operators.normal_form import compare_nested, with_digest


def without(value, paths):
    """The value without what the paths name, written as plain Python."""
    for path in paths:
        steps, here = path.replace("[*]", ".[*]").split("."), [value]
        for step in steps[:-1]:
            here = [y for x in here for y in (x if step == "[*]" and isinstance(x, list) else [x[step]] if isinstance(x, dict) and step in x else [])]
        for x in here:
            if isinstance(x, dict):
                x.pop(steps[-1], None)
    return value


def made(rng, depth=3):
    kind = rng.randrange(6 if depth else 4)
    if kind < 4:
        return [None, True, rng.randrange(100), rng.choice(["", "é", "x\ny", '"'])][kind]
    if kind == 4:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample(["a", "b", "c", "B", "é", "a.b"], rng.randrange(5))
    return {k: made(rng, depth - 1) for k in keys}


def shuffled(rng, value):
    if isinstance(value, dict):
        keys = list(value)
        rng.shuffle(keys)
        return {k: shuffled(rng, value[k]) for k in keys}
    return [shuffled(rng, x) for x in value] if isinstance(value, list) else value


def test_normal_form_against_plain_json(spark):
    rng = random.Random(5)
    values = [{"a": made(rng), "b": made(rng), "c": [made(rng) for _ in range(3)]} for _ in range(120)]
    paths = ["a.b", "c[*].a", "b[*].c.a", "B", "a[*][*].b"]
    texts = [(i, json.dumps(shuffled(rng, v), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)]
    table = with_digest(spark.createDataFrame(texts, "i int, definition string"), "definition", paths)
    found = {r["i"]: r["normal_form"] for r in table.collect()}
    for i, value in enumerate(values):
        assert json.loads(found[i]) == without(json.loads(json.dumps(value)), paths), texts[i]
    again = [(i, json.dumps(shuffled(rng, v))) for i, v in enumerate(values)]
    digests = rows(with_digest(spark.createDataFrame(again, "i int, definition string"), "definition", paths), "i", "digest")
    assert digests == rows(table, "i", "digest")


def test_forms_of_one_definition_are_equal(spark):
    made_of = [
        "named_struct('tasks', array(named_struct('key', 'a', 'n', 1)), 'labels', map('y', 1.50BD, 'x', 2BD))",
        "parse_json('{\"labels\": {\"x\": 2.0, \"y\": 1.5}, \"tasks\": [{\"n\": 1, \"key\": \"a\"}]}')",
        "'{\"tasks\": [{\"n\": 1, \"key\": \"a\"}], \"labels\": {\"y\": 1.5, \"x\": 2}}'",
        "map('labels', parse_json('{\"y\": 1.500, \"x\": 2}'), 'tasks', parse_json('[{\"key\": \"a\", \"n\": 1}]'))",
    ]
    digests = {with_digest(spark.sql(f"SELECT {one} AS d"), "d").first()["digest"] for one in made_of}
    assert len(digests) == 1 and None not in digests


def test_odd_definitions(spark):
    table = spark.createDataFrame([(1, None), (2, "{"), (3, ""), (4, "null"), (5, "[]"), (6, '{"a": 1, "a": 2}')], "i int, d string")
    found = {r["i"]: r["normal_form"] for r in with_digest(table, "d", ["a"]).collect()}
    assert found == {1: None, 2: None, 3: None, 4: "null", 5: "[]", 6: None}
    for path in ("", "a..b", "a[*]"):
        with pytest.raises(ValueError):
            with_digest(table, "d", [path])


def test_verdicts_of_nested_definitions(spark):
    requested = spark.sql("""SELECT * FROM VALUES ('same', false, 'prod', '{"a": 1, "t": 5}'), ('new', false, 'prod', '{}'),
        ('twice', false, 'prod', '{}'), ('', false, 'prod', '{}'), (null, true, 'prod', '{}'), ('bad', false, 'prod', 'x'), ('worse', true, 'prod', '{}'),
        ('other', false, 'prod', '{}'), ('other', false, 'Development', '{}'), ('other', true, 'Development', '{}'), ('noid', null, null, '{}')
        AS t(name, override, environment, definition)""")
    existing = spark.sql("""SELECT * FROM VALUES ('same', '1', map('t', 9, 'a', 1)), ('twice', '2', map()), ('twice', '3', map()),
        ('bad', '4', map()), ('worse', '5', null), ('other', '6', map('z', 1)), ('noid', '', map()) AS t(name, id, definition)""")
    got = rows(compare_nested(requested, existing, ignored=["t"]), "name", "environment", "override", "verdict")
    assert {(n, v) for n, _, _, v in got if n != "other"} == {
        ("same", "OK_SAME"), ("new", "OK_NEW"), ("twice", "ERROR_NOT_UNIQUE"), ("", "ERROR_NO_NAME"), (None, "ERROR_NO_NAME"),
        ("bad", "ERROR_UNREADABLE"), ("worse", "ERROR_UNREADABLE"), ("noid", "ERROR_EMPTY_ID"),
    }
    assert [v for n, _, _, v in got if n == "other"] == ["ERROR_DIFFERS", "OK_OVERRIDE", "OK_CHANGED"]


def test_settings_that_hold_maps(spark):
    requested = spark.sql("""SELECT * FROM VALUES ('a', false, 'prod', map('x', 1, 'y', 2), struct(map('k', array(1)) AS m)),
        ('b', false, 'prod', map('x', 1), struct(map('k', array(1)) AS m)), ('c', false, 'prod', map(), struct(null AS m))
        AS t(name, override, environment, tags, spec)""")
    existing = spark.sql("""SELECT * FROM VALUES ('a', '1', map('y', 2, 'x', 1), struct(map('k', array(1)) AS m)),
        ('b', '2', map('x', 1), struct(map('k', array(2)) AS m)), ('c', '3', map('x', 1), struct(null AS m)) AS t(name, id, tags, spec)""")
    empty = {"tags": F.create_map(), "spec": F.col("existing.spec")}
    got = rows(compare_definitions(requested, existing, ["tags", "spec"], empty), "name", "verdict")
    assert got == [("a", "OK_SAME"), ("b", "OK_CHANGED"), ("c", "ERROR_EMPTY_REQUEST")]
