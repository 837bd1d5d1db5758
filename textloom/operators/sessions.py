"""Sessions that belong to an install: only the owner lists, reads or deletes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def owned(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """``requests`` (``install, session``) of the sessions' owners, each once; null installs own nothing."""
    return requests.select("install", "session").distinct().join(sessions.select("install", "session").distinct(), ["install", "session"], "left_semi")


def select_session_list(sessions: DataFrame, limit: int = 100) -> DataFrame:
    """``install, session, updated, place`` of the newest ``limit`` sessions of every install; ties by session."""
    order = Window.partitionBy("install").orderBy(F.desc_nulls_last("updated"), "session")
    rows = sessions.where("install is not null").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= limit).select("install", "session", "updated", "place")


def session_messages(requests: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """``install, session, message, place`` and the messages' other columns, by message, for owners only.

    A request of another install finds nothing, whether or not the session exists.
    """
    rows = messages.join(owned(requests, sessions), "session")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("install", "session").orderBy("message")))


def delete_session(requests: DataFrame, sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests with ``removed``, the sessions that stay, and their messages: those of a removed session go with it."""
    gone = owned(requests, sessions)
    answered = requests.select("install", "session").distinct().join(gone.withColumn("owner", F.lit(True)), ["install", "session"], "left")
    answered = answered.select("install", "session", F.coalesce("owner", F.lit(False)).alias("removed"))
    keys = gone.select("session").distinct()
    return answered, sessions.join(keys, "session", "left_anti"), messages.join(keys, "session", "left_anti")


def persist_turns(sessions: DataFrame, messages: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after ``turns``: two messages appended for each, counters of its session updated.

    ``sessions`` have ``session, install, title, token_count, status, ended_reason, updated``, ``messages``
    ``session, message, role, content, total_tokens`` (``message`` counts within the session), ``turns``
    ``session, install, at, question, answer, total_tokens``.  Turns without session or install are not kept.
    A new session belongs to its first turn's install.  Title: of the first turn where there is none yet, its
    question cut at 100 characters, else ``New chat``; token count: the last turn's (null: 0), no sum; status
    becomes active; owner and reason of the end stay.  Turns go by ``at``, ties by question and answer; sessions
    without turns stay as they are.
    """
    turns = turns.where("session is not null and install is not null")
    order = F.struct("at", "question", "answer", "install")
    title = F.substring(F.regexp_replace(F.coalesce("question", F.lit("")), r"^\s+|\s+$", ""), 1, 100)
    new = turns.groupBy("session").agg(
        F.min_by("install", order).alias("new_install"), F.min_by(F.coalesce(F.nullif(title, F.lit("")), F.lit("New chat")), order).alias("new_title"),
        F.max_by(F.coalesce("total_tokens", F.lit(0)), order).alias("new_count"), F.max("at").alias("new_updated"),
    )
    both = sessions.withColumn("stored", F.lit(True)).join(new, "session", "full")
    touched = F.col("new_install").isNotNull()
    after = both.select(
        "session", F.when(F.col("stored"), F.col("install")).otherwise(F.col("new_install")).alias("install"),
        F.when(touched, F.coalesce(F.nullif("title", F.lit("")), "new_title")).otherwise(F.col("title")).alias("title"),
        F.coalesce("new_count", "token_count").alias("token_count"), F.when(touched, "active").otherwise(F.col("status")).alias("status"), "ended_reason",
        F.coalesce("new_updated", "updated").alias("updated"),
    )
    place = F.row_number().over(Window.partitionBy("session").orderBy("at", "question", "answer", "install"))
    last = messages.groupBy("session").agg(F.max("message").alias("last"))
    said = lambda role, content, tokens: F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"), tokens.alias("total_tokens"))
    pair = F.array(said("user", F.col("question"), F.lit(None).cast("long")), said("assistant", F.col("answer"), F.col("total_tokens").cast("long")))
    rows = turns.withColumn("place", place).join(last, "session", "left").select("session", "last", "place", F.posexplode(pair).alias("second", "said"))
    number = F.coalesce("last", F.lit(0)) + 2 * F.col("place") - 1 + F.col("second")
    added = rows.select("session", number.cast("long").alias("message"), "said.role", "said.content", "said.total_tokens")
    return after, messages.select(*added.columns).unionByName(added)
