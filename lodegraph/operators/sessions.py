"""Sessions, question history, repository listings, row visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS, LATEST = 5, 50


def rollup(questions: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """first_at, last_at, n, first_question (the smallest text) and opening_question (the earliest)."""
    return questions.groupBy(session).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("n"), F.min(text).alias("first_question"), F.min_by(text, F.struct(order, text)).alias("opening_question"))


def last_messages(messages: DataFrame, session: str, order: str, pairs: int = PAIRS) -> DataFrame:
    """The last messages of each session: two for each pair."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.col(order).desc()))).where(F.col("_n") <= 2 * pairs).drop("_n")


def context(messages: DataFrame, session: str, order: str, role: str, text: str, pairs: int = PAIRS) -> DataFrame:
    line = F.concat(F.when(F.col(role) == "user", "You: ").otherwise("Assistant: "), F.col(text))
    rows = last_messages(messages, session, order, pairs).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    return rows.select(session, F.concat(F.lit("Previous conversation:\n"), body, F.lit("\n---")).alias("context"))


def latest_child(parents: DataFrame, children: DataFrame, key: str, child_key: str, value: str, *order: str) -> DataFrame:
    """parents with the value of their latest child, or null."""
    last = children.groupBy(F.col(child_key).alias(key)).agg(F.max_by(value, F.struct(*order)).alias("latest"))
    return parents.join(last, key, "left")


def visible(rows: DataFrame, owner: str, user: str | None) -> DataFrame:
    """Rows that have no owner, or this one."""
    own = F.col(owner).isNull()
    return rows.where(own if user is None else own | (F.col(owner) == user))


def status_rank(status: Column, first: str, second: str) -> Column:
    return F.when(status == first, 0).when(status == second, 1).otherwise(2)


def latest(rows: DataFrame, at: str, *ties: str, limit: int = LATEST) -> DataFrame:
    """The rows with the greatest at, ties by the given columns."""
    return rows.orderBy(F.col(at).desc(), *ties).limit(limit)


def belonging(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose key one of the owners has."""
    return rows.join(owners.select(key), key, "left_semi")


def questions_of(rows: DataFrame, repo: object, user: str | None = None, session: object = None, limit: int = LATEST) -> DataFrame:
    """The latest questions of a repository that a user may see; of one session only if a session is given. rows: repo_id,
    user_id, session_id, created_at, id."""
    shown = visible(rows.where(F.col("repo_id") == repo), "user_id", user)
    shown = shown if session is None else shown.where(F.col("session_id") == session)
    return latest(shown, "created_at", "id", limit=limit)
