"""Branches that the given tables don't reach, on inline rows."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import rows_of
from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.operators import metering as M
from textloom.operators import pages as P
from textloom.operators import retrieval as R
from textloom.operators import structure as S
from textloom.operators import traces as A
from textloom.plans import registry
from textloom.plans.corpus import corpus_vs_live, front_matter


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("question, kind", [
    ("How many students can I add to my class?", "general"), ("How do I add students to my class?", "how_to"), ("What causes a Tower Alert and what is its purpose?", "report"),
    ("What is LEAP?", "research"), ("Give a list of accessibility features — feature names only.", "list_features"), ("It won't load on my iPad", "troubleshooting"), (None, "general"), (" ", "general"),
])
def test_classify_question(spark, question, kind):
    assert one(spark, question, T.classify_question) == kind
    assert one(spark, question, lambda c: T.classify_question(c, "policy")) == "policy" and one(spark, question, lambda c: T.classify_question(c, enabled=False)) == "general"


@pytest.mark.parametrize("f, value, want", [
    (T.normalize_pdf_url, "http://Drive.google.com/uc?export=download&id=ABC", "https://drive.google.com/file/d/ABC/view"),
    (T.normalize_pdf_url, "https://drive.google.com/file/d/x-1/view?usp=s", "https://drive.google.com/file/d/x-1/view"),
    (T.normalize_pdf_url, "http://A.org", "https://a.org/"), (T.normalize_pdf_url, "http://a.org/B.pdf?x#y", "https://a.org/B.pdf"),
    (T.pdf_basename, "https://a.org/d/My%20File+1.pdf?x", "My File+1.pdf"), (T.pdf_basename, "https://drive.google.com/open?id=Q", "Q.pdf"), (T.pdf_basename, "a/b.pdf", "b.pdf"),
    (T.normalize_block, "‪It’s⁩  NEW", "it's new"), (T.clean_title, " A  b - c | d ", "A b - c"), (T.clean_title, "A — b", "A"),
    (T.humanize_id, "GuideforTeachers_6_8", "Guide for Teachers 6 8"), (T.humanize_id, "K8withMath", "K8 with Math"), (T.humanize_id, "G05M01_Rubric", "G05M01 Rubric"),
    (T.article_slug, "https://h.org/hc/articles/123-Add-A-Thing/", "add-a-thing"), (T.url_section, "https://h.org/", "home"), (T.url_section, "https://h.org/a/b", "a"),
    (T.strip_duplicate_sources, "x\n\nSources:\n- [a](b)\n\n---\nSource: a", "x\n\nSources:\n- [a](b)"), (T.strip_duplicate_sources, "x\nSource: a", "x\nSource: a"), (T.strip_duplicate_sources, None, ""),
    (T.clean_markdown, "**a** _b_ [c](d)\n##\nGet Started\n\n\n\ne  ", "a b c\n\ne"), (T.normalize_list_indent, "x\n   - a\n     - b\ny\n - c", "x\n- a\n  - b\ny\n- c"),
    (T.parse_json_tolerant, '["a", " b ", ""]', ["a", "b"]), (T.parse_json_tolerant, "[broken", ["[broken"]), (T.parse_json_tolerant, " x ", ["x"]), (T.parse_json_tolerant, None, []),
    (T.strip_citations, "a [b](c)\n\n[1]\n**d**", "a b\nd"), (T.response_errors, None, ["too short"]), (T.response_errors, "x" * 6000, ["too long"]),
])
def test_text_functions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_titles_scope_and_quantities(spark):
    row = spark.createDataFrame([("", "intro\n# \n# Top\n", "doc_1")], "t string, b string, d string")
    assert row.select(T.resolve_title(F.col("t"), F.col("b"), F.col("d"))).first()[0] == "Top"
    assert row.select(T.resolve_title(F.col("t"), F.lit("none"), F.col("d"))).first()[0] == "doc 1"
    assert row.select(T.pdf_title(F.lit("My[CoreSet]"), F.lit(None).cast("string")), T.pdf_title(F.lit("x"), F.lit("Known")), T.pdf_title(F.lit(""), F.lit(None).cast("string"))).first()[:] == ("My [Core Set] (PDF)", "Known (PDF)", "")
    asks = spark.createDataFrame([("How do teachers log in", "admin"), ("teachers", "parent"), ("Help for Teacher", "teacher"), ("x", "other")], "q string, r string")
    got = [r[0] for r in asks.select(T.scope_query(F.col("q"), T.role_phrase(F.col("r")))).collect()]
    assert got == ["How do log in for administrator", "teachers for parent", "Help for for teacher", "x"]
    assert row.select(T.format_quantity(F.lit(1.234), F.lit("USD"), F.lit(10.0))).first()[0] == "$1.23 of $10.00"
    assert row.select(T.classify_answer(F.lit(" No. It"), F.lit(True), "No.", "Web:"), T.classify_answer(F.lit("Web: x"), F.lit(None).cast("boolean"), "No.", "Web:"), T.classify_answer(F.lit(None).cast("string"), F.lit(False), "No.", "Web:")).first()[:] == ("refuse", "web", "answer")


def test_routing_words(spark):
    def plan(name):
        return registry.PLANS[name]

    rows = spark.createDataFrame([(0, i, "user", t) for i, t in enumerate(["there is a bug, it is not working", "my payment was declined, wrong charge", "hi? there", None])], "conv_id int, turn int, role string, text string")
    assert [r.team for r in spark.sql(plan("classify_ticket"), conversations=rows).orderBy("turn").collect()] == ["technical", "billing", "general", "general"]
    assert [(r.n_words, r.is_question) for r in spark.sql(plan("query_analysis"), conversations=rows).orderBy("turn").collect()][2] == (2, True)


def test_blocks(spark):
    text = "A\n\n a \n\nTeachers\n\nB\n\nb\n\nB c"
    found = spark.createDataFrame([(text,)], "t string").select(*B.dedupe_consecutive_blocks(B.blocks_of(F.col("t")))).first()
    assert (found[0], found[1]) == (["A", "B", "B c"], 3)
    page = ["# T", "short", "w " * 90, "## Notes", "## At a glance", "## Related articles", "w " * 90]
    arr = lambda items: F.array(*map(F.lit, items))
    row = spark.range(1)
    assert row.select(B.article_body(arr(page), F.lit("/research/x"))).first()[0] == ["# T", "w " * 90, "## Notes"][:2]
    assert row.select(B.article_body(arr(page), F.lit("/press-releases/x"))).first()[0] == ["# T", "short", "w " * 90, "## At a glance"]
    assert row.select(B.article_body(arr(page), F.lit("/x"))).first()[0] == page
    pair = ["## Let's do this", "now learn more about it today", "x", "learn more about it", "## Let's do this", "other"]
    assert row.select(B.strip_heading_pairs(arr(pair), "let's do this", "learn more about it")).first()[0] == ["x", "## Let's do this", "other"]
    marked = ["Table of contents", "table of contents a b", "table of contents " + "w " * 12, "spring and to get access", "y"]
    assert row.select(B.strip_marked_blocks(arr(marked), (("spring", "access"),))).first()[0] == [marked[2], "y"]


def test_sections_and_headers(spark):
    docs = spark.createDataFrame([(1, "p1\n\np2\n# One\na\n## Two\nb\n# Three\nc"), (2, "x\n\ny"), (3, None)], "d int, text string")
    assert [(r.d, r.pos, r.unit) for r in B.heading_sections(docs, "d").orderBy("d", "pos").collect()] == [(1, 0, "p1"), (1, 1, "p2"), (1, 2, "# One\na"), (1, 3, "## Two\nb"), (1, 4, "# Three\nc"), (2, 0, "x"), (2, 1, "y")]
    assert [(r.title, r.section) for r in B.header_chunk(docs, "d").where("d = 1").orderBy("pos").collect()] == [(None, None), (None, None), ("One", None), ("One", "Two"), ("Three", None)]
    units = spark.createDataFrame([(1, 0, "Grade 4 Learning progression"), (1, 1, "Topic 1: a"), (1, 2, "plain"), (1, 3, "grade 4 learning progression Topic 2: b")], "d int, pos int, unit string")
    got = [r.labelled for r in B.carry_section_label(units, "d", "pos", "unit", r"Grade \d+ Learning progression", r"Topic \d+:").orderBy("pos").collect()]
    assert got == ["Grade 4 Learning progression", "Grade 4 Learning progression | Topic 1: a", "plain", "grade 4 learning progression Topic 2: b"]


def test_standards(spark):
    text = "before\n3.oa.5\nApply\nSTANDARDS page\nproperties\nMission 1 x\nlate\nMission 2\n3.OA.7\nFluently\n3.OA.5\nAgain\nMission 9"
    entries = B.parse_standard_entries(spark.createDataFrame([("Kansas", text)], "state string, text string"), "state")
    assert {(r.code, r.description, tuple(r.mappings)) for r in entries.collect()} == {("3.OA.5", "Again", ("Mission 9",)), ("3.OA.7", "Fluently", ())}
    asked = spark.createDataFrame([(" kansas", "3.OA. 5"), ("Kansas", "3.OA.A.5"), ("Atlantis", "3.OA.5")], "state string, code string")
    got = {(r.state, r.requested): (r.found, r.similar, r.error is None) for r in B.standard_lookup(asked, entries).collect()}
    assert got == {(" kansas", "3.OA.5"): (True, [], True), ("Kansas", "3.OA.A.5"): (False, ["3.OA.5", "3.OA.7"], True), ("Atlantis", "3.OA.5"): (False, [], False)}


def test_pack_units():
    assert all(len(c) <= 120 for c in S.pack_units(["alpha " * 20, "beta " * 20, "gamma " * 20, "x" * 500], 120, 20))
    chunks = S.pack_units(["a" * 50, "b" * 50, "c" * 90], 100, 30)
    assert all(len(c) <= 100 for c in chunks) and "".join(chunks).count("c") == 90
    assert S.pack_units(["aa", "bb", "cc"], 5, 2) == ["aa bb", "bb cc"]
    rng = random.Random(2)
    for _ in range(200):
        units = ["w" * rng.randint(1, 40) for _ in range(rng.randint(0, 12))]
        size = rng.randint(10, 60)
        assert all(len(c) <= size for c in S.pack_units(units, size, rng.randint(0, 9)))


def test_structure_chunk(spark):
    schema = "doc_id string, source string, page_number int, text string"
    rows = [("a", "x.pdf", 1, "Grade 4 Learning progression\nTopic 5: Multiply\nCore Mission 3 helps"), ("a", "x.pdf", 2, "Short tail."), ("b", "y.md", None, "One short sentence."), ("c", "z", None, None), ("d", "z", None, "word " * 600)]
    got = {}
    for r in S.structure_chunk(spark.createDataFrame(rows, schema), 500, 50, "Series", "Core").collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.text))
    assert sorted(got) == ["a", "b", "d"] and got["b"] == [(0, "One short sentence.")] and [i for i, _ in sorted(got["a"])] == [0, 1]
    assert "Series Grade 4 Topic 5 Core Mission 3" in sorted(got["a"])[0][1] and all(len(t) <= 500 for _, t in got["d"])
    units = S.split_rows("Grade 4 Learning progression\nTopic 1: a\nTopic 2: b")
    assert any(u.startswith("Topic 1:") for u in units) and any(u.startswith("Topic 2:") for u in units)


def test_neighbours_and_context(spark):
    chunks = spark.createDataFrame([("d", i, f"d__chunk_{i}", t) for i, t in enumerate(["a", "b", " ", "c", "c", "e"])], "document_id string, chunk_index int, chunk_id string, text string")
    hits = spark.createDataFrame([(1, 1, "d", 4), (1, 2, "d", 3), (2, 1, "d", 0)], "query_id int, rank int, document_id string, chunk_index int")
    assert R.neighbor_join(hits, chunks, 0).count() == 0 and R.neighbor_join(hits, chunks, -1).count() == 0
    assert [(r.chunk_index, r.place) for r in R.expand_neighbors(hits, chunks).where("query_id = 1").orderBy("place").collect()] == [(4, 1), (3, 2), (5, 3)]
    blocks = R.merge_hits(hits, chunks, 1, ("query_id", "rank"))
    assert {(r.query_id, r.rank): (r.first_index, r.block, r.chunk_ids) for r in blocks.collect()}[(1, 1)] == (3, "c\n\ne", ["d__chunk_3", "d__chunk_4", "d__chunk_5"])
    assert R.context_cap(blocks, 0).count() == 3 and R.context_cap(blocks, 1).count() == 2
    assert spark.range(1).select(R.source_label(F.lit(" "), F.lit("t"), F.lit("s"), F.lit("d"))).first()[0] == "t"


def test_dense_and_keyword_edges(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [2.0, 0.1], 0), (4, [1.0], 0), (5, None, 0), (6, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    for most in (1 << 20, 2):  # one lot, and several
        got = [(r.query_id, r.vec_id, r.rank) for r in R.dense_topk(vectors, vectors.where("vec_id in (1, 3, 5)"), 2, most=most).orderBy("query_id", "rank").collect()]
        assert got == [(1, 6, 1), (1, 3, 2), (3, 1, 1), (3, 6, 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red dog runs", "blue fox fox", None, "x y z"])], "k long, text string")
    asks = spark.createDataFrame([(1, "fox fox red"), (2, "none"), (3, None), (4, "!!")], "q long, text string")
    fast, slow = ([(r.q, r.k, r["rank"], round(r.score, 9)) for r in R.bm25_topk(docs, "k", asks, "q", 3, most).orderBy("q", "rank").collect()] for most in (1 << 20, 0))
    assert fast == slow and fast and {q for q, *_ in fast} == {1}


def test_traces(spark):
    step = "struct<phase:string,tool:string,result:string>"
    steps = [("Act", "search_doc", None), ("Observe", "search_doc", '{"chunk_count": 2, "document_ids": ["a", " b", "a", ""]}'), ("Observe", "search_doc", "broken"), ("Act", "web_search", None), ("Observe", "web_search", '{"chunk_count": 9}')]
    rows = spark.createDataFrame([("t", "q", None, " Web: x ", steps), ("u", "q", "refuse", "No. sorry", None)], f"id string, question string, expected_outcome string, answer string, steps array<{step}>")
    got = {r.id: r for r in A.trace_records(rows, "No.", "Web:").collect()}
    assert (got["t"].tool_calls, got["t"].retrieved_document_ids, got["t"].corpus_chunks, got["t"].actual_outcome) == (["search_doc", "web_search"], ["a", "b"], 2, "web")
    assert (got["u"].tool_calls, got["u"].actual_outcome, got["u"].is_refusal) == ([], "refuse", True)
    raw = [("f", '{"a": 1}', "g", "r", "t"), (None, None, "g", "r" * 900, "t"), (None, None, None, None, " think "), (None, None, None, None, " ")]
    found = A.step_classify(spark.createDataFrame(raw, "call_name string, call_args string, response_name string, response string, text string")).collect()
    assert [(r.phase, r.tool, len(r.result or ""), r.content) for r in found] == [("Act", "f", 0, None), ("Observe", "g", 800, None), ("Think", None, 0, "think")]
    schema = "trace_id int, answer string, tool_calls array<string>, is_refusal boolean, used_web boolean, n_chunks int, expected string, actual string, document_ids array<string>"
    checked = M.trace_checks(spark.createDataFrame([(1, "no link", ["search_doc"], False, False, 0, "answer", "answer", ["a"]), (2, "\n Web: [a](b)", ["web_search"], False, True, 0, "web", "web", None)], schema), "Web:").orderBy("trace_id").collect()
    assert not checked[0].citation_present and checked[1].passed
    payload = lambda p: spark.range(1).select(*A.answer_schema_check(F.lit(p))).first()[:]
    assert payload('{"answer": "x", "confidence": 0.5, "needs_human": false}') == (True, [])
    assert payload('{"answer": "", "confidence": "very high", "needs_human": "maybe"}')[1] == ["answer must not be empty", "confidence is no number: very high", "needs_human must be true or false"]
    report = spark.createDataFrame([("i", "q", "r", "**a** [b](c)", ["x", "x", " "], True, False)], "id string, question string, reference string, answer string, document_ids array<string>, c1 boolean, c2 boolean")
    assert A.qa_report_rows(report, ("c1", "c2")).first()[3:] == ("a b", "x", "c2")


PAGE = """<html><head><title>Home | Site</title></head><body><nav>menu</nav><main><h1>One</h1><img src=x><h1>Two</h1>
<div class="tab-menu"><a class="tab-link">first</a></div><div class="tab-pane"><p>inside <b>bold</b> <a href="/d/x.pdf">link</a></p></div>
<p style="display: none">secret</p><p class="mobile-hide">hidden</p><ul><li>item<li>other</ul><p>inside bold link</p><div class="cta">Buy</div><script>var x</script><p>unclosed"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, "https://a.org/p", PAGE), (2, "https://a.org/sitemap", PAGE), (3, "https://a.org/q", None), (4, "https://a.org/b", "<<broken <p>x")], "page_id int, url string, html string")
    got = {r.page_id: r for r in P.extract_pages(rows).collect()}
    assert sorted(got) == [1, 3, 4] and got[1].title == "Home" and got[3].status == "static_failed" and got[3].body == ""
    assert got[1].body == "# One Two\n\n## Tab: FIRST\n\ninside bold link\n\n* item\n\n* other\n\ninside bold link\n\nunclosed" and got[1].tabs == 1
    assert {(r.page_id, r.link) for r in P.discover_links(rows, "page_id", "url", "html", "a.org").collect()} == {(1, "https://a.org/d/x.pdf"), (2, "https://a.org/d/x.pdf")}
    status = lambda path, text, **k: spark.range(1).select(*P.body_length_validation(F.lit(path), F.lit(text), **k)).first()[:]
    assert status("/x", "a b") == ("static_failed", "body too short (2 words)") and status("/research/x", "a b c d e")[0] == "ok"
    assert status("/x", "w " * 30, keywords=("need",)) == ("incomplete", "missing expected keywords: need")


def test_comparisons(spark):
    local = spark.createDataFrame([(1, "u1", "a b c"), (2, "u2", "a"), (3, "", "x"), (4, "u4", "w " * 30), (5, "u5", "a")], "page_id int, url string, body string")
    live = spark.createDataFrame([("u1", "a b d"), ("u4", "w"), ("u5", " ")], "url string, body string")
    assert {r.page_id: (r.status, r.word_delta) for r in corpus_vs_live(local, live).collect()} == {1: ("ok", 0), 2: ("fetch_failed", None), 3: ("no_source_url", None), 4: ("mismatch", 29), 5: ("no_live_body", None)}
    pairs = spark.createDataFrame([("a  b c", "a b\nc"), ("a b c", "a x c d"), (None, "x")], "a string, b string")
    found = P.text_similarity(F.col("a"), F.col("b"))
    got = [tuple(r) for r in pairs.select(*[found[c] for c in ("ratio", "word_delta", "identical")]).collect()]
    assert got[0] == (1.0, 0, True) and got[1][1:] == (-1, False) and 0 < got[1][0] < 1
    issues = spark.range(1).select(P.text_issues(F.lit("rolePromoted 1​"), F.lit("role Promoted. This whole long sentence is nowhere in the stored text at all."))).first()[0]
    assert issues[0] == "glued:rolePromoted" and "invisible_char" in issues and issues[-1].startswith("missing:This whole")
    assert spark.range(1).select(front_matter({"a": F.lit("1"), "b": F.lit(None).cast("string"), "c": F.lit("")}, F.lit("body"))).first()[0] == "---\na: 1\n---\n\nbody"
    chunks = spark.createDataFrame([("d", 0, "abcab"), ("d", 1, "cabx"), ("d", 2, "y")], "document_id string, chunk_index int, text string")
    assert [r.overlap for r in B.overlap_text(chunks).orderBy("chunk_index").collect()] == ["cab", "", ""]
    memory = spark.createDataFrame([("Teacher ", ["Grade 1"], True), ("x", ["Grade 1"], True), ("admin", ["Grade 9"], True), ("admin", [], True), ("admin", ["Grade 1"], None)], "role string, grade_bands array<string>, confirmed boolean")
    assert [r.reason for r in A.memory_validation(memory).collect()] == [None, "unknown role", "unknown grade band", "unknown grade band", "not confirmed"]


def test_dense_topk_sends_k_rows_a_query_over_all_batches(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(300, 4)).astype(float) + 0.5  # many ties
    frame = lambda lo, hi: pd.DataFrame({"id": np.arange(lo, hi), "vec": list(x[lo:hi]), "group": None})
    monkeypatch.setattr(R, "_SIDE", 16)
    asks = frame(0, 40).drop(columns="group").assign(only=None, never=None)
    found = pd.concat(R._nearest(R._by_length(asks, R._LIMITS), [frame(0, 130), frame(130, 140), frame(140, 300)], 5))
    assert len(found) == 40 * 5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(40):
        want = sorted((-round(float(unit[q] @ unit[j]), 9), j) for j in range(300) if j != q)[:5]
        assert sorted(found.loc[found["query"] == q, "key"]) == sorted(j for _, j in want)


def test_bm25_topk_sends_k_rows_a_query_from_a_task():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 30, 12)) for _ in range(900)]
    part = pd.DataFrame({"key": [f"d{i}" for i in range(900)], "group": None, "text": texts})
    row, term = np.divmod(np.arange(90), 30)
    held = R._Weights({f"w{j}": j for j in range(30)}, np.arange(3), row, term, rng.random(90))
    at = [part.iloc[lo : lo + 256] for lo in range(0, 900, 256)]
    found, whole = (pd.concat(held.best(parts, 12.0, 5)) for parts in (at, [part]))
    assert len(found) == 15 and found.reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_golden_questions_by_lookup_and_by_join(spark, tmp_path):
    from textloom.plans import corpus

    asked = [(1, " ".join(f"a{i}" for i in range(12))), (2, "one two x " + " ".join(f"b{i}" for i in range(10))), (3, " ".join(["c"] * 11)), (4, None)]
    docs = [(1, "x " + asked[0][1] + " y"), (2, asked[1][1]), (3, " ".join(["c"] * 30)), (4, asked[0][1].replace("a11", "z")), (5, None), (6, f"{asked[0][1]}\n{asked[2][1]}")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for most in (1 << 20, 0):
        got = {r.item_id: r.expected for r in corpus._golden(spark, str(tmp_path), most).collect()}
        assert got == {1: ["1", "6"], 2: ["2"], 3: ["3", "6"], 4: None}


def test_first_keyword_match_moves_no_text(spark):
    texts = spark.createDataFrame([(1, "A Red hat"), (2, "blueish red"), (3, None), (4, "x"), (None, "GREEN"), (2, "blueish red"), (5, "é"), (6, "tin")], "id long, text string")
    words = spark.createDataFrame([("red", "r", 2), ("Blue ", "b", 1), ("green", "g2", None), ("green", "g1", None), ("é", "e", 3), (" ", "blank", 0), (None, "null", 0), ("ti", "t", 1)], "keyword string, name string, priority int")
    found = R.first_keyword_match(texts, words, ("id",))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id or 0, r["match"]) for r in found.collect())
    assert got == [(0, "g1"), (1, "r"), (2, "b"), (2, "b"), (3, "none"), (4, "none"), (5, "e"), (6, "t")]
    assert got == sorted((r.id or 0, r["match"]) for r in R.first_keyword_match(texts, words, ("id",), most=0).collect())


def test_blocks_are_worked_out_once_a_text(spark):
    """Before, the blocks were cut anew for each block: at the square of their number."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") * 0 + 7999), lambda i: F.concat(F.lit("line "), (i / 2).cast("int"))), "\n")
    long = spark.range(1).select(text.alias("t"))
    began = time.time()
    for c in (F.size(B.dedupe_consecutive_blocks(B.blocks_of(F.col("t"), "\n"))[0]), F.size(B.strip_heading_pairs(B.blocks_of(F.col("t"), "\n"), "line 1", "line 2"))):
        long.select(c).first()
    assert time.time() - began < 30  # 8000 lines


def test_compared_texts_are_made_once(spark):
    """Before, each use of the texts worked out anew what they are made from."""
    pairs = spark.createDataFrame([("a b c", "a x c d"), ("a", "a"), (None, "x"), ("", "a")], "a string, b string")
    found = P.text_similarity(F.col("a"), F.col("b"))
    got = [tuple(r) for r in pairs.select(*[found[c] for c in ("ratio", "word_delta", "identical", "excerpt")]).collect()]
    assert got[0][1:3] == (-1, False) and got[1:3] == [(1.0, 0, True, None), (None, None, None, None)] and got[3][1:3] == (-1, False)
    found = P.text_similarity(F.col("a"), F.upper("b"))
    plan = pairs.select(*[found[c] for c in ("ratio", "word_delta", "identical")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("upper(") < 6  # 12 before


def test_pages_are_parsed_once_for_all_roots(monkeypatch):
    """Before, a page was parsed anew for each root, and an end tag without a start looked through all open tags."""
    fed, feed = [], P._Reader.feed
    monkeypatch.setattr(P._Reader, "feed", lambda self, html: (fed.append(html), feed(self, html))[1])
    assert P.read_page("<body><p>out</p><article><h1>In</h1><h1>side<br></h1><li>x", P.PAGES) == (["# In side", "* x"], 0)
    assert len(fed) == 1  # 2 before
    assert P.read_page("<body>a<span>b<body>c</span>d<p>e", P.Layout(roots=("main", "span"))) == (["b"], 0)
    began = time.time()
    assert P.read_page("<body>" + "<p>a" * 20_000 + "</x>" * 20_000, P.PAGES)[0] == ["a"] * 20_000
    assert time.time() - began < 10


def test_guards_of_cleaned_blocks_lose_nothing(spark):
    """Patterns that are skipped by what a text begins with or holds give what they gave."""
    texts = [" TEXT\tlink ", "text link x", "loK in", "K", "a\ndonate\n\n\n\nb\n", "##", "a_b_ _c_ __d__ **e** [f](g) [ ]", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(T.clean_markdown(F.col("t"))).collect()] == ["", "text link x", "loK in", "K", "a\n\nb", "", "a_b_ c d e f", "", None]
    assert [r[0] for r in rows.select(T.clean_markdown(F.col("t"), ("k", "ȧ"))).collect()][3] == ""
    blocks = F.array(*map(F.lit, ["Table  OF contents", "\ttable of contents a", "table of contents " + "w " * 12, "a table of contents", "x"]))
    assert spark.range(1).select(F.size(B.strip_marked_blocks(blocks)), F.size(B.strip_marked_blocks(blocks, (("x",), ("a ", "of"))))).first()[:] == (3, 1)
    share = lambda t: spark.range(1).select(T.language_share(F.lit(t))).first()[0]
    assert share("the www " * 10) == 0 and share("www " * 20) is None and share("the " * 19) is None and share("the x " * 10) == 0.5


@pytest.fixture(scope="module")
def mostly_unasked(spark, tmp_path_factory):
    """Tables whose documents come in four files; nobody asks for a word of the last three."""
    folder, rng = tmp_path_factory.mktemp("mostly_unasked"), random.Random(3)
    words = lambda letter, n: " ".join(f"{letter}{rng.randrange(60)}" for _ in range(n))
    texts = [words("a" if i < 10 else "b", 20 * (1 + i % 15)) for i in range(40)]
    docs = [(i, text, f"src{i % 4}") for i, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    asked = [(i, " ".join(texts[i % 10].split()[3:15])) for i in range(12)]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    assert spark.read.parquet(f"{folder}/documents.parquet").rdd.getNumPartitions() == 4
    return str(folder)


@pytest.mark.parametrize("name", ["context_cap", "context_chunk_ids", "evaluation_grid", "expand_neighbors", "format_context", "retrieval_scores", "retrieve_context", "retrieve_context_lite", "scoped_keyword"])
def test_tasks_without_a_hit(spark, mostly_unasked, name):
    """Before, a task that found nothing for string keys failed: it sent a column of floats for them."""
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{mostly_unasked}/{t}.parquet/*.parquet')")
    df, ref = registry.queries()[name](spark, mostly_unasked), db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in ref.description]
    want = rows_of(columns, ref.fetchall())
    assert want and sorted(df.columns) == sorted(columns) and rows_of(df.columns, df.collect()) == want


@pytest.mark.parametrize("kind", ["string", "int", "long", "double", "date", "timestamp", "binary", "decimal(9,2)", "boolean"])
def test_best_of_nothing_fits_every_kind_of_key(spark, kind):
    found = spark.range(1).mapInPandas(lambda batches: [R._Best(np.arange(2), 3, 0.0).rows()], f"query long, key {kind}, score double")
    assert found.collect() == []


def test_chunks_take_columns_of_their_document_along(spark):
    from textloom.plans import corpus

    few = [(1, "x" * 1100, "s1"), (2, "y" * 500, None), (None, "z", "s3"), (None, "z", "s4"), (4, None, "s5"), (5, "", "s6")]
    for rows, kind, shuffled in ((few, "long", False), ([*few, (1, "w" * 600, "s7")], "long", True), ([(str(i), *r) for i, *r in few if i] + [("a/b", "x", "s8"), ("a_b", "y", "s9")], "string", True)):
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string")
        joined = R.fixed_chunk(docs).join(docs.select(F.col("doc_id").cast("string").alias("document_id"), "source"), "document_id")
        found = corpus._chunks_with(docs, "source")
        assert found.schema == joined.schema and sorted(map(str, found.collect())) == sorted(map(str, joined.collect())) != []
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == shuffled
