"""Evaluation grid, sessions, costs and failures on small made rows."""

from textloom.operators import evaluation as V
from textloom.operators import metering as M
from textloom.operators import sessions as O
from textloom.operators.chunking import recursive_chunk


def test_scores_by_hand(spark):
    ranked = spark.createDataFrame([(1, "q", "a", 1), (1, "q", "b", 2), (1, "q", "a", 3), (2, "q", "c", 1), (1, "r", "z", 2)], "config int, ask string, doc string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "b"), ("s", "a")], "ask string, doc string")
    asks = spark.createDataFrame([("q",), ("r",), ("s",), ("q",)], "ask string")
    got = {(r.config, r.ask): (r.n_retrieved, r.n_relevant, r.n_found, r.hit, r.precision, r.recall, r.first_rank) for r in V.retrieval_scores(ranked, relevant, asks, "ask", "doc", "config", (1, 2)).collect()}
    assert got == {
        (1, "q"): (2, 2, 1, True, 0.5, 0.5, 2), (2, "q"): (1, 2, 1, True, 1.0, 0.5, 1), (1, "r"): (1, 0, 0, False, 0.0, None, None), (2, "r"): (0, 0, 0, False, 0.0, None, None),
        (1, "s"): (0, 1, 0, False, 0.0, 0.0, None), (2, "s"): (0, 1, 0, False, 0.0, 0.0, None),
    }
    total = {r.config: (r.questions, r.hits, r.precision, r.recall, r.reciprocal_rank) for r in V.score_summary(V.retrieval_scores(ranked, relevant, asks, "ask", "doc", "config", (1, 2)), "config").collect()}
    assert total == {1: (3, 1, 0.166667, 0.25, 0.166667), 2: (3, 1, 0.333333, 0.25, 0.333333)}
    one = V.retrieval_scores(ranked.where("config = 1"), relevant, asks, "ask", "doc").collect()
    assert sorted(r.ask for r in one) == ["q", "r", "s"]


def test_grid_over_recursive_chunks(spark):
    """Small chunks find the rare words alone; the rankings of sizes don't mix."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j} common" for j in range(40))) for i in range(12)] + [(90, None), (91, " ")], "doc_id long, text string")
    asks = spark.createDataFrame([(i, f"w{i}x3 w{i}x4") for i in range(12)] + [(50, "nowhere")], "item_id long, text string")
    chunk = lambda d, n: recursive_chunk(d, n, 0)
    ranked = V.grid_ranking(docs, asks, "item_id", (60, 300), 3, chunk)
    chunks = {n: {r.chunk_id: r.text.split() for r in chunk(docs, n).collect()} for n in (60, 300)}
    rows = ranked.collect()
    for r in rows:
        assert any(w in chunks[r.config_id][r.chunk_id] for w in (f"w{r.item_id}x3", f"w{r.item_id}x4")) and r.document_id == str(r.item_id)
    held = {(n, i) for n in chunks for i in range(12)}
    assert {(r.config_id, r.item_id) for r in rows} == held and all(r.rank <= 3 for r in rows)
    relevant = docs.selectExpr("doc_id as item_id", "cast(doc_id as string) as document_id").where("item_id < 12")
    total = V.score_summary(V.retrieval_scores(ranked, relevant, asks, "item_id", "document_id", "config_id", (60, 300)), "config_id").collect()
    assert {(r.config_id, r.questions, r.hits, r.recall) for r in total} == {(60, 13, 12, 1.0), (300, 13, 12, 1.0)}


def _talks(spark):
    sessions = spark.createDataFrame([("me", 1, 5), ("me", 2, 9), ("you", 3, 9), (None, 4, 1), ("me", 5, 9)], "install string, session long, updated long")
    messages = spark.createDataFrame([(1, 20, "b"), (1, 10, "a"), (3, 1, "c"), (4, 1, "d"), (2, 1, "e")], "session long, message long, text string")
    asked = spark.createDataFrame([("me", 1), ("me", 1), ("me", 3), (None, 4), ("me", 77), ("you", 3)], "install string, session long")
    return sessions, messages, asked


def test_only_owners_read(spark):
    sessions, messages, asked = _talks(spark)
    got = sorted((r.install, r.session, r.place, r.text) for r in O.session_messages(asked, sessions, messages).collect())
    assert got == [("me", 1, 1, "a"), ("me", 1, 2, "b"), ("you", 3, 1, "c")]
    assert sorted((r.install, r.session, r.place) for r in O.select_session_list(sessions, 2).collect()) == [("me", 2, 1), ("me", 5, 2), ("you", 3, 1)]


def test_only_owners_delete(spark):
    sessions, messages, asked = _talks(spark)
    answered, kept, left = O.delete_session(asked, sessions, messages)
    assert sorted((str(r.install), r.session, r.removed) for r in answered.collect()) == [("None", 4, False), ("me", 1, True), ("me", 3, False), ("me", 77, False), ("you", 3, True)]
    assert sorted(r.session for r in kept.collect()) == [2, 4, 5] and sorted(r.session for r in left.collect()) == [2, 4]


def test_prices_and_failures(spark):
    calls = spark.createDataFrame([(1, "big", 1000, 500), (2, "new", 1000, None), (3, None, None, None)], "id int, model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("big", 0.01, 0.03), ("small", 0.002, 0.004), ("small", 0.002, 0.004)], "model string, prompt_price double, completion_price double")
    assert {r.id: r.usd for r in M.token_cost(calls, prices, "small").collect()} == {1: 0.025, 2: 0.002, 3: 0.0}
    assert {r.id: r.usd for r in M.token_cost(calls, prices, "none").collect()} == {1: 0.025, 2: None, 3: None}
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, "c")], "id int, why string")
    assert sorted((r.id, r.why, r.n, r.place) for r in M.failure_ids(rows, "why", "id").collect()) == [(1, "b", 2, 2), (2, "a", 2, 1), (3, "b", 2, 2), (4, "a", 2, 1), (5, "c", 1, 3)]
