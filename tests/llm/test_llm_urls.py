import random
import re
import time

import pytest
from concordat.llm import url_filters
from concordat.llm.queries import URL_RULES

HOSTS = ["net", "example.net", "a.example.net", "xexample.net", "example.com", "org", "ex.org", "network.org", "EXAMPLE.Net", ".net", "", "net:80"]
PATHS = ["", "/", "/en/", "/en", "/en/x", "/de/1", "/fr/ü", "/fr?x=/fr/", "#/de/", "?a/en/"]


def brute(url, rules=URL_RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.encode().lower().decode()
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=(default, None, None))
    return host, path, best[1] + best[2] if fit else None, best[0]


def as_regex(rule):
    def part(text, any_char):
        out, escaped = "", False
        for c in text:
            if escaped or c not in "*?\\":
                out, escaped = out + re.escape(c), False
            elif c == "\\":
                escaped = True
            else:
                out += any_char + ("*" if c == "*" else "")
        return out

    return re.compile(rf"(?s)(?:.*\.)?{part(rule[1], '.')}"), re.compile(f"(?s){part(rule[2], '.')}")


def judged(spark, urls, rules=URL_RULES, **options):
    table = spark.createDataFrame([(i, u, "kept", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, note int")
    got = url_filters.judged(table, rules, **options)
    assert got.columns == ["page_id", "url", "note", "host", "path", "rule", "verdict"]
    rows = sorted(got.collect())
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_rules_against_brute_force(spark):
    urls = [f"http://{h}{p}" for h in HOSTS for p in PATHS] + [None, "", "net/", "a://b://net/", "://net/x", "http://é.net/\n/?", "x://net/"] * 2
    assert judged(spark, urls) == [brute(u) for u in urls]
    assert judged(spark, urls, held_chars=20) == [brute(u) for u in urls]
    assert judged(spark, []) == []
    assert {r[2:] for r in judged(spark, urls, [], default="block")} == {(None, "block")}


@pytest.mark.parametrize("seed", range(3))
def test_globs_over_several_words(spark, seed):
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    rules = [(rng.choice(["allow", "block"]), pick("ab.*?", 6), pick("/a*?\\", 6)) for _ in range(60)]
    urls = [f"s://{pick('ab.', 9)}/{pick('/a*?', 9)}" for _ in range(300)]
    patterns = [(r, *as_regex(r)) for r in rules]
    expected = []
    for u in urls:
        host, path, *_ = brute(u)
        fit = [r for r, h, p in patterns if h.fullmatch(host) and p.match(path)]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        expected.append((host, path, best and best[1] + best[2], best[0] if best else "allow"))
    assert url_filters.Automaton([url_filters.Rule(*r) for r in rules]).words > 3
    assert judged(spark, urls, rules) == expected


def test_very_long_addresses(spark):
    urls = ["http://" + "a." * 500_000 + "net/x", "http://b.net/" + "y" * 1_000_000, "http://b.org/" + "z" * 1_000_000 + "/end"]
    started = time.time()
    got = judged(spark, urls, [*URL_RULES, ("block", "org", "/*/end")])
    assert [g[2] for g in got] == ["net/", "net/", "org/*/end"] and time.time() - started < 30


def test_masks_are_bounded():
    with pytest.raises(ValueError):
        url_filters.Automaton([url_filters.Rule("block", f"{i:05d}{chr(1000 + i)}", "/") for i in range(10_000)])
