import random
import re

import pytest
from helpers import rows

from concordat.operators.patterns import match_patterns, matching_pairs, pattern_verdicts


def as_regex(pattern):
    out, escaped = "", False
    for c in pattern:
        if escaped or c not in "%_\\":
            out, escaped = out + re.escape(c), False
        elif c == "\\":
            escaped = True
        else:
            out += {"%": ".*", "_": "."}[c]
    return re.compile(out, re.S)


def tables(spark, names, patterns):
    return (
        spark.createDataFrame(list(enumerate(names)), "name_id int, name string"),
        spark.createDataFrame(list(enumerate(patterns)), "request int, pattern string"),
    )


@pytest.mark.parametrize("gram", [1, 2, 3])
def test_pairs_against_brute_force(spark, gram):
    rng = random.Random(gram)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    names = [text("ab_%\\é\n", 9) for _ in range(120)] + ["", None, "same", "same", "\u0002a", "a\u0003"]
    patterns = [text("ab_%é\n", 7) for _ in range(80)] + ["\\%a%", "%\\_", "a\\\\%", "", "same", "same", "s%e", "_a%", "%b_"]
    found = rows(match_patterns(*tables(spark, names, patterns), gram=gram))
    expected = []
    for i, p in enumerate(patterns):
        if p and not p.strip("%_"):
            continue
        expected += [(i, p, j, n) for j, n in enumerate(names) if n is not None and as_regex(p).fullmatch(n)]
    assert found == sorted(expected, key=repr) and len(expected) > 100


def test_verdicts(spark):
    patterns = ["a%", "", "%", "_%_", None, "\\", "a\\b", "\\%", "\\\\", "a\\\\\\", "%\n%"]
    _, table = tables(spark, [], patterns)
    verdicts = [v for _, v in sorted((r["request"], r["verdict"]) for r in pattern_verdicts(table).collect())]
    ok, bad = "OK", "MALFORMED"
    assert verdicts == [ok, ok, "NO_LITERAL", "NO_LITERAL", "EMPTY", bad, bad, ok, ok, bad, ok]


def test_no_rows_and_clashing_columns(spark):
    names, patterns = tables(spark, ["a"], ["a"])
    assert match_patterns(names.limit(0), patterns).count() == 0 == match_patterns(names, patterns.limit(0)).count()
    with pytest.raises(ValueError):
        match_patterns(names.withColumnRenamed("name_id", "request"), patterns)


def test_plan_has_no_all_pairs_join(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    names, patterns = tables(spark, ["abc", "abd"] * 50, ["ab%", "%c"])
    plan = matching_pairs(names.select("name"), patterns.select("pattern"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_common_gram_is_passed_over_for_a_rare_one(spark):
    """Every name shares a beginning; the candidates of a pattern are the names with its rarest gram."""
    names, patterns = tables(spark, [f"common_{i:04d}_x" for i in range(500)], [f"common_{i:04d}%" for i in range(0, 500, 7)])
    found = matching_pairs(names.select("name"), patterns.select("pattern"))
    assert found.count() == len(range(0, 500, 7))


def test_no_side_is_broadcast_by_the_size_of_its_files(spark, tmp_path):
    """Postings are many times the file of their names, which is what Spark estimates them by."""
    names, patterns = tables(spark, [f"name_{i:06d}" for i in range(200)], [f"%{i:04d}" for i in range(20)])
    names.write.parquet(f"{tmp_path}/names")
    found = match_patterns(spark.read.parquet(f"{tmp_path}/names"), patterns)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20


@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_wildcards_alone_match_every_name_of_a_fitting_length(spark, monkeypatch, tile):
    """In tiles of any size, with rows that come twice, code points beyond 16 bits, and names of no character."""
    monkeypatch.setattr("concordat.operators.patterns._TILE", tile)
    names = ["", None, "a", "é", "ab", "ab", "\U0001f600", "x%", "a\nb", "abcd", "\u0002", "a\u0003b"]
    patterns = ["%", "_", "%_", "_%_", "__", "%%", "", "a%", "%b", "_____", "%\u0002%", "_\u0003_", "\\%", None, "a\\b", "%_", "_"]
    found = rows(match_patterns(*tables(spark, names, patterns), wildcards=True))
    judged = [(i, p) for i, p in enumerate(patterns) if p is not None and p != "a\\b"]
    expected = [(i, p, j, n) for i, p in judged for j, n in enumerate(names) if n is not None and as_regex(p).fullmatch(n)]
    assert found == sorted(expected, key=repr)
    table = tables(spark, names, patterns)
    pairs = matching_pairs(table[0].select("name"), table[1].select("pattern"))
    assert rows(pairs, "pattern", "name") == sorted({(p, n) for _, p, _, n in expected}, key=repr)
    alike = match_patterns(table[0].select("name"), table[1].select("pattern"), wildcards=True)  # rows without a number
    assert rows(alike, "pattern", "name") == sorted([(p, n) for _, p, _, n in expected], key=repr)


def test_wildcards_alone_with_no_rows(spark):
    names, patterns = tables(spark, ["a"], ["%"])
    for some, others in ((names.limit(0), patterns), (names, patterns.limit(0)), (names.where("name = 'b'"), patterns)):
        assert match_patterns(some, others, wildcards=True).count() == 0


def test_wildcards_alone_are_dealt_over_tiles(spark, conf, monkeypatch):
    """Pairs of one pattern come from many tasks, though the rows that meet are few and small."""
    monkeypatch.setattr("concordat.operators.patterns._TILE", 10)
    conf(spark__sql__shuffle__partitions="16")
    found = match_patterns(*tables(spark, [f"name_{i:03d}" for i in range(100)], ["%_"] * 80), wildcards=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
    sizes = found.rdd.glom().map(len).filter(bool).collect()
    assert sum(sizes) == 8000 and len(sizes) >= 8 and max(sizes) < 3000
