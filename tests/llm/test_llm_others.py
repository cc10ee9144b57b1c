"""Toxicity, fingerprints, exact search, archive records, page text and the pipeline."""

import hashlib
import json
import math
import os
import random
import subprocess
import sys
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from concordat.llm import fingerprints, html_extract, scores, topk, toxicity, warc
from concordat.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def labelled(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ba de fi go lu mo".split() for b in "ran tel sim pok vur".split()]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(1, 9))]
        if toxic:
            parts[rng.randrange(len(parts))] += " scoundrel" if i % 8 else " villainy"
        rows.append((i, ". ".join(parts) + ".", int(toxic)))
    return rows


def test_toxicity_is_learned_from_documents_and_found_in_sentences():
    rows = labelled(900)
    model = toxicity.fit([t for _, t, _ in rows[:600]], [y for *_, y in rows[:600]])
    scores = [(model.score(t), y) for _, t, y in rows[600:]]
    good = np.mean([a > b for a, x in scores for b, y in scores if x and not y])
    assert good > 0.98
    text = "baran detel fisim. mopok villainy. gopok luvur."
    assert max(model.sentence_scores(text), key=lambda s: s[1])[0] == "mopok villainy."
    assert 0 <= model.score("") <= 0.1 and toxicity.offending("", model) == []


def test_scores_of_a_table(spark, corpus):
    rows = labelled(400)
    documents = corpus(*[(i, t) for i, t, _ in rows], (9001, None), (9002, ""), (9002, ""), extra=["score"])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents, labels, F.col("doc_id") % 3 != 1)
    got = toxicity.with_score(documents, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    scores = got.collect()
    assert len(scores) == 403 and all(0 <= r["score"] <= 1 for r in scores)
    held = [(r["score"], rows[r["doc_id"]][2]) for r in scores if r["doc_id"] < 400 and r["doc_id"] % 3 == 1]
    assert np.mean([a > b for a, x in held for b, y in held if x and not y]) > 0.95
    none = toxicity.train(documents, labels.limit(0), F.lit(True))
    assert toxicity.with_score(corpus(), none).count() == 0


def test_digest_text_round_trip_and_bounds():
    rng = random.Random(2)
    texts = ["", "a", "ab cd", *("".join(rng.choices("abcde fgh", k=n)) for n in (50, 500, 5000))]
    digests = [fingerprints.digest(t.encode()) for t in texts]
    for d in digests:
        assert (fingerprints.from_text(fingerprints.as_text(d)) == d).all() and fingerprints.difference(d, d) == 0
    assert all(0 <= fingerprints.difference(a, b) <= 1 for a in digests for b in digests)
    assert len({len(fingerprints.as_text(d)) for d in digests}) == 1


@pytest.mark.parametrize("rows", [
    [(5, "é" * 9), (1, "abcdefg"), (3, None), (4, ""), (2, "word " * 700), (None, "no id at all")],
    [(7, "alone in here")], [],
    [(i * 7 % 101, f"text {i} " * (i % 13)) for i in range(101)],
])
def test_neighbours(spark, corpus, rows):
    got = {r["doc_id"]: r for r in fingerprints.against_neighbours(corpus(*rows, extra=["own", "at"])).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(order):
        text, other = text or "", order[(at + 1) % len(order)][1] or ""
        n = len(text) // 2
        changed = (text[: len(text) - n] + other[:n]).encode()
        mine, r = fingerprints.digest(text.encode()), got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed).hexdigest()
        assert fingerprints.as_text(mine) == r["fingerprint"] and fingerprints.as_text(fingerprints.digest(changed)) == r["edited_fingerprint"]
        assert np.isclose(r["near_edited"], fingerprints.likeness(mine, fingerprints.digest(changed)))
        assert np.isclose(r["near_next"], fingerprints.likeness(mine, fingerprints.digest(other.encode())))


@pytest.mark.parametrize("shard, tile, fan", [(8192, 1024, 16), (7, 3, 2)])
def test_search_is_exact(spark, shard, tile, fan):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 0.003]) for _ in range(4)]) for i in range(90)]
    rows += [(90, None), (91, [None, 1.0, 0.0, 0.0]), (92, [float("nan")] * 4), (93, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(94, [1.0, 2.0]), (100, [3.0, 0.0]), (110, []), (None, [1.0] * 4), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.search(table, F.col("vec_id") % 10 == 0, 5, shard=shard, tile=tile, fan=fan).collect()
    assert sorted(map(tuple, got)) == sorted(best_by_brute_force(rows, np.float32))
    assert topk.search(table.limit(0), F.lit(True), 5).count() == 0


def best_by_brute_force(rows, number=float):
    usable = [(at, i, [math.floor(256 * float(number(x))) for x in v]) for at, (i, v) in enumerate(rows)
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, q, own in usable:
        if q % 10 == 0:
            found = [(-sum(a * b for a, b in zip(own, v)), i) for n, i, v in usable if n != at and len(v) == len(own)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:5])]
    return out


def test_rows_that_share_an_id_are_all_candidates(spark):
    rows = [(7, [1.0, 1.0]), (7, [5.0, 5.0]), (10, [1.0, 0.0]), (10, [2.0, 0.0]), (10, [2.0, 0.0]), (3, [1.0, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, got)) == sorted(best_by_brute_force(rows)) and len(got) == 15


def test_scores_beyond_64_bits_keep_their_order(spark):
    rows = [(10, [3e17, 1.0]), (1, [3e17, 1.0]), (2, [1e37, 0.0]), (3, [-1e37, 0.0]), (4, [3e17, 2.0]), (5, [1e-3, 4.0])]
    for number, kind in ((float, "double"), (np.float32, "float")):
        got = topk.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), F.col("vec_id") % 10 == 0, 5).collect()
        expected = best_by_brute_force(rows, number)
        assert sorted(map(tuple, got)) == [(*r[:3], r[3] if abs(r[3]) < 1 << 63 else None) for r in sorted(expected)]
        assert [r[2] for r in sorted(expected)][0] == 2 and None in [r["score"] for r in got]


def test_products_beyond_doubles():
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**40, 0.0]])
    assert scores.products(a, b).tolist() == [[2**60 + 1, 2**70]]


PAGE = """<html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><nav><a href="/x?a=1&amp;b=2">x</a></nav>
<!-- no --><article><h1>Head</h1><p>One <b>two</b><br>three &copy; <p>Four</article></body>"""


def test_archive_records_round_trip_and_link(spark):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "u\r\nX: 1", ""), (1, "http://a/", PAGE), (None, "http://b/", "x < y & z")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, warc string")
    got = warc.derived(warc.responses(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        source, meta, text = (next(warc.records(bytes(r[k]))) for k in ("source", "metadata", "conversion"))
        for made in (meta, text):
            assert made.get("WARC-Refers-To") == source.get("WARC-Record-ID") != made.get("WARC-Record-ID")
            assert made.get("WARC-Refers-To-Payload-Digest") == source.get("WARC-Payload-Digest") == warc.digest(warc.payload_of(source.block)[2])
            assert made.get("WARC-Block-Digest") == warc.digest(made.block) and made.get("WARC-Date") == source.get("WARC-Date")
        about = json.loads(meta.block)["Envelope"]
        assert about["WARC-Header-Metadata"]["WARC-Record-ID"] == source.get("WARC-Record-ID")
        if r["page_id"] == 1:
            html = about["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
            assert html == {"Title": "A & B", "Links": ["/x?a=1&b=2"]}
            assert text.block.decode() == "A & B\nx\nHead\nOne two\nthree ©\nFour"
    joint = b"".join(bytes(r["source"]) for r in got)
    assert [warc.to_bytes(x) for x in warc.records(joint)] == [bytes(r["source"]) for r in got]
    with pytest.raises(ValueError):
        list(warc.records(joint[:-9]))
    assert warc.linked(warc.derived(warc.responses(pages.limit(0)))).count() == 0


def test_repeated_headers_are_preserved(spark):
    page = warc.response(1, "http://a/", '<a href="/x">x</a><a href="/y">y</a>')
    fields = [*page.fields, ("WARC-Concurrent-To", "<urn:b>"), ("WARC-Concurrent-To", "<urn:c>")]
    block = page.block.replace(b"\r\n\r\n", b"\r\nSet-Cookie: a=1\r\nLink: </l>\r\nset-cookie: b=2\r\n\r\n", 1)
    data = warc.to_bytes(warc.Record(fields, block))
    sources = spark.createDataFrame([(1, bytearray(data))], "page_id long, warc binary")
    (row,) = warc.linked(warc.derived(sources)).collect()
    record, http = json.loads(row["record_headers"]), json.loads(row["http_headers"])
    assert record["WARC-Concurrent-To"] == ["<urn:b>", "<urn:c>"] and record["WARC-Target-URI"] == "http://a/"
    assert http["Set-Cookie"] == ["a=1", "b=2"] and http["Link"] == "</l>" and "Content-Type" in http
    assert json.loads(row["links"]) == ["/x", "/y"] and row["n_links"] == 2


@pytest.fixture(scope="module")
def extractor():
    return html_extract.fit(["Some plain words make up a sentence. Then comes another one, longer than before.", "Short text. " * 9], pages=500)


def test_extraction_on_fresh_layouts(extractor):
    rng, hits, total = np.random.default_rng(77), 0, 0
    for _ in range(80):
        page = html_extract.layout(rng, ["A quite different text, of many words. It has two sentences."])
        blocks, roles = html_extract._labelled(page)
        want = html_extract.kept_text(blocks, [r == 1 for r in roles]).split()
        have = extractor.extract([html_extract._ROLE.sub("", page)])[0].split()
        hits += 2 * len(set(want) & set(have)) if sorted(want) == sorted(have) else 0
        total += 2 * len(set(want))
    assert hits / total > 0.9


def test_extraction_of_a_page(extractor):
    assert extractor.extract([PAGE]) == ["Head\nOne two three ©\nFour"]
    odd = ["", "   ", "<", "plain words only", "<p", "</div></div>", "<div>" * 3000 + "deep", "<script>never closed", "a<!-- open"]
    assert len(extractor.extract(odd)) == len(odd)


def test_choices_never_contradict(extractor):
    rng = np.random.default_rng(5)
    for _ in range(40):
        blocks = html_extract.parse(html_extract._ROLE.sub("", html_extract.layout(rng, ["Words and more words."])))
        x = html_extract.features(blocks, extractor.names)
        kept = html_extract.decode(blocks, extractor.trees.log_odds(x) + rng.normal(0, 3, len(x)))
        assert not any(k for k, b in zip(kept, blocks) if b.name in html_extract.HIDDEN)


def test_pages_of_a_table(spark, extractor):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_extract.main_text(pages, extractor).collect()))
    assert [(r[0], r[3]) for r in got] == [(1, 25), (1, 25), (2, 0)]
    assert html_extract.main_text(pages.limit(0), html_extract.train(pages.limit(0), layouts=30)).count() == 0


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for name in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF_DIR)
        expected = con.execute(sql)
        columns = [d[0] for d in expected.description]
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_every_operator_is_registered():
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in entry.queries())
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_toxicity_query(spark):
    rows = QUERIES["op4_toxicity"](spark, SF_DIR).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)


class ArticleText(HTMLParser):
    """The blocks of the article of a given page; its comments and adverts are marked by their classes."""

    def __init__(self):
        super().__init__()
        self.stack, self.lines, self.skipped = [], [[]], 0

    def handle_starttag(self, tag, attributes):
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            self.handle_data(" ")
            return
        if tag in ("p", "h1", "h2", "h3", "li", "div", "ul", "td", "tr", "table", "blockquote", "article", "section", "aside"):
            self.lines.append([])
        self.stack.append((tag, set(dict(attributes).get("class", "").split())))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
            if tag not in ("b", "i", "a", "span", "em", "strong"):
                self.lines.append([])

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack):
            self.lines[-1].append(data)


def test_given_pages_give_their_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op10_html"](spark, SF_DIR).collect()}
    for page_id, page in pages.items():
        reader = ArticleText()
        reader.feed(page)
        lines = [" ".join("".join(parts).split()) for parts in reader.lines]
        assert got[page_id] == "\n".join(filter(None, lines)), page_id


def test_formulas_and_fallback_texts_stay_in_their_line(extractor):
    tail = "<p>Some plain words make up a sentence. Then comes another one, longer than before.</p>" * 3
    page = f"<body><article><p>Let a<math><mi>x</mi><mo>=</mo></math> b, and <svg><text>one</text></svg> <object>two</object> follow it here.</p>{tail}</article></body>"
    first = html_extract.kept_text(*(lambda b: (b, [True] * len(b)))(html_extract.parse(page))).split("\n")[0]
    assert first == "Let ax= b, and one two follow it here."
    assert extractor.extract([page])[0].split("\n")[0].startswith("Let ax= b, and")


@pytest.mark.parametrize("piece", ["<a ", "<h1>", "<p><td><h1>", '<a ""', "<a", "<ul><li>", "<!--", "<x></y>", "<a '\"' ", "</p "])
def test_hostile_pages_take_time_in_proportion(piece):
    took = []
    for n in (20_000, 80_000):
        started = time.process_time()
        html_extract.parse(piece * n + '">"')
        took.append(time.process_time() - started)
    assert took[1] < 12 * took[0] + 0.5


def test_training_takes_bounded_paragraphs(spark, monkeypatch):
    rows = [(i % 7, "u", "".join(f"<p>Paragraph {i} {j} has some words in it.</p>" for j in range(30)) + f"<p>{'long ' * 500}</p>") for i in range(40)]
    seen = []
    monkeypatch.setattr(html_extract, "fit", lambda texts, layouts: seen.append(texts))
    pages = spark.createDataFrame(rows + rows[:20] + [(1, "u", None)], "page_id long, url string, html string")
    html_extract.train(pages.repartition(5), sample=6, per_page=4, longest=100)
    html_extract.train(pages.repartition(3), sample=6, per_page=4, longest=100)
    assert len(seen[0]) == 24 and seen[0] == seen[1] and max(map(len, seen[0])) <= 100


def test_pipeline_stages_on_odd_documents(spark, corpus):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    docs = corpus((1, text), (2, text), (3, None), (4, ""), (5, f"{text} and something else that differs at the end"), (5, "twice"), (None, "no id"))
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "5", "None"]
    cut = corpus_pipeline.without_repeated_passages(spark, docs, SF_DIR)
    left = {(r["doc_id"], len(r["text"]), r["n_chars"]) for r in cut.collect()}
    assert cut.columns == docs.columns and (1, len(text), len(text)) in left and (2, 0, 0) in left
    assert all(stage(spark, docs.limit(0), SF_DIR).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_one_row_of_each_group_of_near_duplicates_stays(spark, corpus):
    x, y, z = (" ".join(f"{w}{i}" for i in range(40)) for w in "xyz")
    rows = [(1, x), (1, y), (2, y), (None, z), (None, z), (None, x), (7, "alone"), (7, "other words"), (None, "lost"), (9, None), (9, None)]
    parts = [corpus(*rows), corpus((8, z.upper()), *[(None, "many copies")] * 50), corpus((9, None)).withColumn("lang", F.lit("de"))]
    kept = corpus_pipeline.without_near_duplicates(spark, parts[0].union(parts[1]).union(parts[2]), SF_DIR).collect()
    # (1, x) and (1, y) are of two groups; z has the row with an id; null texts are one group
    expected = [(1, x), (1, y), (7, "alone"), (7, "other words"), (8, z.upper()), (9, None), (None, "lost"), (None, "many copies")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, expected))
    assert [r["lang"] for r in kept if r["doc_id"] == 9] == ["de"]


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 0 < len({r["doc_id"] for r in rows}) < documents.count()
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


def test_entry_works_without_this_subpackage(tmp_path):
    code = (
        "import sys; sys.modules['concordat.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "assert e.queries() and not any(q.startswith('op1_') for q in e.queries()) and 'pipeline' not in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
