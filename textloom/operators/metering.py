"""Rate limiting, where each acceptance depends on those before it, and checks of answers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accepted requests in a window, its seconds, and the longest answer.
LIMIT, WINDOW_SECONDS, LENGTH_BUDGET = 20, 60, 2500
TOOLS = ("search_doc", "web_search")


def accept(times: list[int], held: deque, limit: int, micros: int) -> list[bool]:
    """Which of the ascending times are accepted; ``held`` has the accepted times still in the window.

    A time leaves the window when it is older than ``micros``, not when just as old.
    """
    out = []
    for t in times:
        while held and t - held[0] > micros:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def client_key(install_id: Column, forwarded: Column, host: Column | None = None) -> Column:
    """The install id; else ``ip:`` and the first forwarded address, the host, or ``unknown``.  Blanks count as missing."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    host = F.lit(None).cast("string") if host is None else host
    address = F.coalesce(filled(F.get(F.split(forwarded, ","), 0)), filled(host), F.lit("unknown"))
    return F.coalesce(filled(install_id), F.concat(F.lit("ip:"), address))


def islands(events: DataFrame, key: str, t: str, span: int) -> DataFrame:
    """``events`` with ``island``: numbers a key's stretches between gaps of more than ``span``; null where ``t`` is.

    Events are first summed up by key and slot of length ``span``: within a slot no gap is that
    long, so the window over a key sees its slots, however many events a slot holds.
    """
    slotted = events.withColumn("slot", F.col(t) - F.pmod(F.col(t), F.lit(span)))
    slots = slotted.where("slot is not null").groupBy(key, "slot").agg(F.min(t).alias("low"), F.max(t).alias("high"))
    order = Window.partitionBy(key).orderBy("slot")
    begins = F.coalesce(F.col("low") - F.lag("high").over(order) > span, F.lit(False))
    numbered = slots.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("long")).over(order))
    numbered = numbered.select(F.col(key).alias("its_key"), F.col("slot").alias("its_slot"), "island")
    joined = slotted.join(numbered, F.col(key).eqNullSafe(F.col("its_key")) & (F.col("slot") == F.col("its_slot")), "left")
    return joined.drop("slot", "its_key", "its_slot")


def rate_limit(events: DataFrame, key: str, ts: str, tie: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``tie, key, accepted``: a sliding window over each key's accepted events, in order of ``ts, tie``.

    A gap longer than the window empties the state, so a key is cut at its gaps and the parts go
    to different tasks.  Rows reach a task sorted (the sort spills), and the fold holds only the
    last ``limit`` times, so a part of any size passes in bounded memory.  Null keys are one
    key; rows without a time are refused and count for nothing.
    """
    rows = events.select(F.col(tie).alias("tie"), F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    micros = seconds * 1_000_000

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), deque()
        for batch in batches:
            accepted = []
            for k, part, t in zip(batch["key"], batch["island"], batch["t"]):
                if (k, part) != current:
                    current, held = (k, part), deque()
                accepted += accept([int(t)], held, limit, micros)
            yield pd.DataFrame({"tie": batch["tie"], "key": batch["key"], "accepted": accepted})

    kind = events.schema[tie].dataType.simpleString()
    cut = islands(rows.where("t is not null"), "key", "t", micros)
    done = cut.repartition("key", "island").sortWithinPartitions("key", "island", "t", "tie").mapInPandas(folded, f"tie {kind}, key string, accepted boolean")
    done = done.unionByName(rows.where("t is null").select("tie", "key", F.lit(False).alias("accepted")))
    return done.select(F.col("tie").alias(tie), F.col("key").alias(key), "accepted")


def trace_checks(traces: DataFrame, banner: str, budget: int = LENGTH_BUDGET) -> DataFrame:
    """``trace_id``, five checks as booleans, and ``passed`` where all hold.

    Columns read: answer, tool_calls, is_refusal, used_web, n_chunks, expected, actual and, if there,
    document_ids; nulls count as empty, false, 0 and ``answer``; answers are trimmed first.
    """
    answer = F.trim(F.regexp_replace(F.coalesce("answer", F.lit("")), r"^\s+|\s+$", ""))
    refusal, web = F.coalesce("is_refusal", F.lit(False)), F.coalesce("used_web", F.lit(False))
    outcome = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("answer"))))
    linked = answer.rlike(r"\[[^\]]+\]\([^)]+\)")
    calls = F.coalesce("tool_calls", F.array().cast("array<string>"))
    no_ids = F.size(F.coalesce("document_ids", F.array().cast("array<string>"))) == 0 if "document_ids" in traces.columns else F.lit(True)
    no_source = ~web & (outcome("actual") != "web") & (F.coalesce("n_chunks", F.lit(0)) <= 0) & no_ids
    checks: dict[str, Column] = {
        "used_tool": F.arrays_overlap(calls, F.array(*map(F.lit, TOOLS))) | refusal,
        "citation_present": refusal | no_source | linked,
        "fallback_banner": web == answer.startswith(banner),
        "outcome_appropriate": outcome("expected") == outcome("actual"),
        "length_budget": F.length(answer) <= budget,
    }
    found = traces.select("trace_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return found.withColumn("passed", F.expr(" and ".join(checks)))


def token_cost(calls: DataFrame, prices: DataFrame, default: str, digits: int = 6) -> DataFrame:
    """``calls`` with ``usd``, rounded: tokens at the prices per thousand of their model, else of the ``default`` model.

    ``calls`` has ``model, prompt_tokens, completion_tokens``, ``prices`` a row a model with ``prompt_price,
    completion_price``.  Missing tokens count as 0; without a price for the default, unknown models cost null.
    """
    price = F.struct("prompt_price", "completion_price")
    usual = prices.where(F.col("model") == default).select(F.first(price)).scalar()
    rows = calls.join(prices.select("model", price.alias("price")).dropDuplicates(["model"]), "model", "left").withColumn("price", F.coalesce("price", usual))
    n = lambda c: F.coalesce(c, F.lit(0))
    usd = (n("prompt_tokens") * F.col("price.prompt_price") + n("completion_tokens") * F.col("price.completion_price")) / 1000
    return rows.withColumn("usd", F.round(usd, digits)).drop("price")


def failure_ids(rows: DataFrame, failure: str, key: str) -> DataFrame:
    """``key, failure, n, place``: failed rows with the number of their failure and its place, most first, ties by name.

    Ids stay rows, so a failure of a third of all rows makes no group in one task.
    """
    counts = rows.groupBy(failure).agg(F.count("*").alias("n"))
    places = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), failure)))  # one row a kind of failure
    return rows.select(key, failure).join(places, failure)
