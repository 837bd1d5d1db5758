"""Agent steps, traces and evaluation reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import classify_answer, strip_citations

WEB_TOOLS, DOC_TOOL, RESULT_LENGTH = ("web_search", "web_search_agent"), "search_doc", 800
BANDS = ("Kindergarten", *(f"Grade {i}" for i in range(1, 9)))
ROLES = ("student", "teacher", "parent", "admin")
_OBSERVED = "struct<chunk_count:int,document_ids:array<string>>"


def step_classify(events: DataFrame) -> DataFrame:
    """``phase, tool, args, result, content`` of raw events; a call wins over a response, that over text.

    Columns read: ``call_name, call_args, response_name, response, text``; results are cut at
    ``RESULT_LENGTH`` characters; events without any of them are dropped.
    """
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    phase = F.when(F.col("call_name").isNotNull(), "Act").when(F.col("response_name").isNotNull(), "Observe").when(filled("text").isNotNull(), "Think")
    act, observe, think = (F.col("phase") == p for p in ("Act", "Observe", "Think"))
    rows = events.withColumn("phase", phase).where("phase is not null")
    added = {
        "tool": F.when(act, F.col("call_name")).when(observe, F.col("response_name")),
        "args": F.when(act, F.coalesce("call_args", F.lit("{}"))),
        "result": F.when(observe, F.substring(F.coalesce("response", F.lit("")), 1, RESULT_LENGTH)),
        "content": F.when(think, F.trim("text")),
    }
    return rows.withColumns(added).drop("call_name", "call_args", "response_name", "response", "text")


def trace_summary(steps: Column, doc_tool: str = DOC_TOOL, web_tools: tuple[str, ...] = WEB_TOOLS) -> dict[str, Column]:
    """``tool_calls, retrieved_document_ids, used_web_fallback, corpus_chunks`` of an array of steps.

    Steps are structs of ``phase, tool, result``; only results of the document tool count, broken JSON counts as empty.
    """
    none = F.array().cast("array<string>")
    tool = lambda s: F.coalesce(s["tool"], F.lit(""))
    calls = F.transform(F.filter(steps, lambda s: (s["phase"] == "Act") & (tool(s) != "")), lambda s: s["tool"])
    seen = F.transform(F.filter(steps, lambda s: (s["phase"] == "Observe") & (tool(s) == doc_tool)), lambda s: F.from_json(s["result"], _OBSERVED))
    ids = F.flatten(F.transform(seen, lambda o: F.coalesce(o["document_ids"], none)))
    ids = F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda i: i.isNotNull() & (i != "")))
    return {
        "tool_calls": F.coalesce(calls, none),
        "retrieved_document_ids": F.coalesce(ids, none),
        "used_web_fallback": F.coalesce(F.exists(calls, lambda c: c.isin(*web_tools)), F.lit(False)),
        "corpus_chunks": F.coalesce(F.aggregate(seen, F.lit(0), lambda n, o: n + F.coalesce(o["chunk_count"], F.lit(0))), F.lit(0)),
    }


def trace_records(answers: DataFrame, refusal: str, banner: str) -> DataFrame:
    """Traces from ``id, question, expected_outcome, answer, steps``: the summary of steps and the outcome."""
    rows = answers.withColumn("answer", F.trim(F.coalesce("answer", F.lit("")))).withColumns(trace_summary(F.col("steps")))
    rows = rows.withColumn("actual_outcome", classify_answer(F.col("answer"), F.col("used_web_fallback"), refusal, banner))
    linked = F.col("answer").rlike(r"\[[^\]]+\]\([^)]+\)")
    return rows.withColumns({"expected_outcome": F.coalesce("expected_outcome", F.lit("answer")), "is_refusal": F.col("actual_outcome") == "refuse", "has_markdown_link": linked})


def qa_report_rows(traces: DataFrame, checks: tuple[str, ...]) -> DataFrame:
    """``id, question, reference, shown, ids, failed``: display answers, ids once each, failed checks by comma."""
    failed = F.concat_ws(", ", *[F.when(~F.coalesce(F.col(c), F.lit(False)), c) for c in checks])
    ids = F.array_distinct(F.filter(F.coalesce("document_ids", F.array().cast("array<string>")), lambda i: F.trim(i) != ""))
    return traces.select("id", "question", "reference", strip_citations(F.coalesce("answer", F.lit(""))).alias("shown"), F.array_join(ids, ", ").alias("ids"), failed.alias("failed"))


def answer_schema_check(payload: Column) -> tuple[Column, Column]:
    """Whether a JSON answer has text, a confidence within 0 and 1 and a truth value; and what is wrong with it."""
    got = F.from_json(payload, "answer string, confidence string, needs_human string")
    number = got["confidence"].try_cast("double")
    wrong = F.array_compact(F.array(
        F.when(got.isNull() | F.coalesce(F.length(got["answer"]) < 1, F.lit(True)), "answer must not be empty"),
        F.when(number.isNull(), F.concat(F.lit("confidence is no number: "), F.coalesce(got["confidence"], F.lit("missing")))).when(~number.between(0, 1), "confidence must be from 0 to 1"),
        F.when(~F.coalesce(F.lower(got["needs_human"]).isin("true", "false"), F.lit(False)), "needs_human must be true or false"),
    ))
    return F.size(wrong) == 0, wrong


def memory_validation(rows: DataFrame, roles: tuple[str, ...] = ROLES, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """``rows`` (``role, grade_bands, confirmed``) with ``accepted`` and the first ``reason`` against.

    The role counts in lower case, every band must be allowed and there must be one.
    """
    allowed = F.size("grade_bands") > 0
    allowed = F.coalesce(allowed & F.forall("grade_bands", lambda b: F.coalesce(F.trim(b).isin(*bands), F.lit(False))), F.lit(False))
    reason = F.when(~F.coalesce("confirmed", F.lit(False)), "not confirmed")
    reason = reason.when(~F.coalesce(F.lower(F.trim("role")).isin(*roles), F.lit(False)), "unknown role").when(~allowed, "unknown grade band")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def request_rate(events: DataFrame, key: str, ts: str, tie: str, seconds: int = 60) -> DataFrame:
    """``tie, key, requests``: how many events of the key lie in the window that ends with each, itself included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.select(tie, key, F.count("*").over(window).alias("requests"))
