"""Chat formatting, url filters, licence scans and the pipeline."""

import json
import re
import shutil

import pytest


def call(i, name="search", arguments=None, after=()):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': arguments if arguments is not None else {'query': 'x'}, 'after': list(after)})}</tool_call>"


def result(i):
    return f'<tool_result>{{"id": "{i}", "content": {{"b": 1, "a": [2.0, "é"]}}}}</tool_result>'


def test_chat_format(spark):
    from billweave.llm.chat_format import formatted

    rows = [
        (1, 0, "user", "find it"), (1, 1, "assistant", "ok " + call("c2", after=["c1"]) + call("c1")), (1, 2, "tool", result("c1") + result("c2")),
        (2, 0, "tool", result("z")), (2, 1, "assistant", call("a", after=["b"]) + call("b", after=["a"]) + call("z")), (2, 2, "assistant", call("d", "fetch", {"url": 5, "format": "xml", "more": 1}, ["gone"])),
        (3, 0, None, None), (3, 1, "assistant", "<tool_call>no json</tool_call>" + call("e") + call("e")),
    ]
    got = {(r.conv_id, r.turn, r.place): r for r in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1, 1].level, got[1, 1, 2].level) == (1, 0)
    assert got[1, 1, 1].linked and got[1, 2, 1].linked and not got[1, 1, 1].problems
    assert got[1, 2, 1].json == '{"result":{"content":{"a":[2.0,"é"],"b":1},"id":"c1"}}'
    assert got[2, 0, 1].problems == ["no call before it"] and not got[2, 1, 3].linked
    assert got[2, 1, 1].problems == ["waits for itself"] and got[2, 1, 1].level is None
    assert got[2, 2, 1].problems == ["format is not allowed", "url is no string", "more is unknown", "waits for a call that is not there"]
    assert got[3, 0, 0].json == '{"content":"","role":null}'
    assert got[3, 1, 1].problems == ["no object with an id"] and got[3, 1, 3].problems == ["id is taken"]


def test_url_rules(spark):
    from billweave.llm.url_filter import judged, rule

    rules = [rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"), rule("block", "net/es/"), rule("block", "net/fr/")]
    urls = ["https://a.Example.com/en/1?x", "https://www.example.com/en/1", "http://b.example.com/fr/#t", "x.com/en", None, "http://n.example.net/es/2", "http://n.example.net/en/2", "http://o.example.org/q", "http://com", "http://xcom/"]
    html = ["", "", "", "", None, "", '<a href="http://o.example.org/">', '<a HREF="//n.example.net/x">n</a>', "", ""]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages, rules).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("b.example.com", "/fr/", "com/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "block")
    assert got[7] == ("o.example.org", "/q", None, "block")  # it links to the bad host
    assert got[8] == ("com", "", None, "allow") and got[9][2] is None


def test_page_rank_against_matrix(spark):
    import numpy as np

    from billweave.llm.url_filter import propagated

    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("d", "b", 1)]
    got = {r.host: (r.trust, r.distrust) for r in propagated(spark.createDataFrame(edges, "src string, dst string, pages long"), spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.0, 2.0)], "host string, good double, bad double"), tolerance=1e-4).collect()}
    names = "abcd"
    forward = np.zeros((4, 4))
    for s, d, w in edges:
        forward[names.index(s), names.index(d)] = w
    for k, (m, seed) in enumerate(((forward, 0), (forward.T, 3))):
        p = m / m.sum(1, keepdims=True).clip(1e-9)
        x = np.eye(4)[seed]
        for _ in range(200):
            x = 0.15 * np.eye(4)[seed] + 0.85 * x @ p
        assert [got[n][k] for n in names] == pytest.approx(x.tolist(), abs=1e-4)


def test_ranks_reach_their_limit_and_every_host(spark):
    from billweave.llm.url_filter import propagated

    schema = "host string, good double, bad double"
    circle = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, pages long").coalesce(1)
    got = {r.host: r.trust for r in propagated(circle, spark.createDataFrame([("a", 1.0, 0.0)], schema).coalesce(1), tolerance=0.05).collect()}
    assert abs(got["a"] - 1 / 1.85) < 0.05 and abs(got["b"] - 0.85 / 1.85) < 0.05
    chain = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(12)], "src string, dst string, pages long").coalesce(1)
    got = propagated(chain, spark.createDataFrame([("h0", 1.0, 0.0), ("h12", 0.0, 1.0)], schema).coalesce(1), tolerance=100.0).collect()
    assert len(got) == 13 and all(r.trust > 0 and r.distrust > 0 for r in got)


def test_written_hosts_in_any_case(spark):
    from billweave.llm.url_filter import host_edges

    pages = spark.createDataFrame([("a.org", "see Bad.Example.NET now"), ("bad.example.net", None), ("a.org", "")], "host string, html string")
    assert [(r.src, r.dst, r.pages) for r in host_edges(pages).collect()] == [("a.org", "bad.example.net", 1)]
    assert host_edges(pages.limit(0)).count() == 0


def test_urls_without_pages_or_with_clashing_columns(spark):
    from billweave.llm.url_filter import judged, rule

    rules = [rule("block", "net/")]
    pages = spark.createDataFrame([(1, "http://a.net/", "", "x", 1.0), (1, "http://a.net/", "", "x", 1.0)], "page_id long, url string, html string, host string, trust double")
    assert [(r.host, r.verdict) for r in judged(pages, rules).collect()] == [("a.net", "block")] * 2
    assert judged(pages.limit(0), rules).count() == 0


def test_licence_words_needed(spark):
    """The gate is a bound: a paragraph that the gate drops is unknown without it, too."""
    from billweave.llm.license_scan import NOTICES, least_words, licences, train

    assert least_words({"a bb ccc": [0.0, 0.8], "bb": [0.0, 0.4], "x": [1.0, 0.0]}, [0.0, -1.0]) == (["bb", "ccc"], 2)
    model = train(spark)
    rows = [x for notices in NOTICES.values() for x in notices] + ["public work", "the mit", "license", "no part", "free software version 2", "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    gated = {r.doc_id: (r.families, r.doubtful) for r in licences(docs, model).collect()}
    model.needed = 0
    assert gated == {r.doc_id: (r.families, r.doubtful) for r in licences(docs, model).collect()}


def test_licences_of_empty_and_clashing_tables(spark):
    from billweave.llm.license_scan import licences, train

    model = train(spark)
    docs = spark.createDataFrame([(1, "x\n" * 3000 + "Released under the MIT License.", "y", 2)] * 2, "doc_id long, text string, doc string, paragraph int")
    assert [(r.doc_id, r.families) for r in licences(docs, model).collect()] == [(1, ["MIT"])] * 2
    assert licences(docs.limit(0), model).count() == 0


def test_licences(spark):
    from billweave.llm.license_scan import licences, train

    rows = [(1, "some text\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (3, None), (4, "the license of the driver is under review"), (5, "This file is available under the Apache License, Version 2.0"), (5, "plain")]
    got = sorted(((r.doc_id, r.families) for r in licences(spark.createDataFrame(rows, "doc_id long, text string"), train(spark)).collect()), key=str)
    assert got == [(1, ["MIT"]), (2, ["CC-BY-NC-4.0", "all-rights-reserved"]), (3, []), (4, []), (5, ["Apache-2.0"]), (5, [])]


def test_licences_keep_neighbours_apart(spark):
    from billweave.llm.license_scan import licence_paragraphs, licences, train

    model = train(spark)
    named = {
        "Released under the GNU General Public License, version 2.": ["GPL-2.0"],
        "Released under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "Licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"],
        "Licensed under the BSD 2-Clause License.": ["BSD-2-Clause"],
        "Released under the BSD license.": ["BSD"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Licensed under CC BY-SA 3.0.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "Licensed under the Artistic License 1.0.": [],
        "Released under the Q Public License 1.0.": [],
    }
    docs = spark.createDataFrame(list(enumerate(named)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences(docs, model).collect()}
    assert {x: got[k] for k, x in enumerate(named)} == named
    assert 0 < model.least < 1
    found = licence_paragraphs(docs, model)[1].collect()
    assert found and min(r.probability for r in found) >= model.least
    model.least = 1.1  # the threshold decides
    assert not licence_paragraphs(docs, model)[1].count()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    for name in ("documents", "labels", "benchmark"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", path / f"{name}.parquet")
    return str(path)


def test_pipeline(spark, small):
    """Each stage keeps rows and columns as its contract says, and run() gives the same as the stages by hand."""
    import corpus_pipeline
    from billweave.llm.common import saved

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = saved(stage(spark, before, small), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "privacy":
            for r in after.collect():
                assert not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r.text or "")
                assert r.n_chars == len(r.text)
        before = after
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).select("doc_id").collect()) == sorted(r.doc_id for r in before.select("doc_id").collect())
