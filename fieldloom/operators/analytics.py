"""Dashboard, history and chat queries over analysis documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import scalars, text

RECENT = ["id", "type", "severity", "confidence", "cropName", "createdAt"]


def stats(analyses: DataFrame) -> DataFrame:
    """KPI row per user: all analyses, critical or high ones, and those marked helpful."""
    count_if = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return analyses.groupBy("userId").agg(
        F.count(F.lit(1)).alias("total_analyses"),
        count_if(F.col("severity").isin("critical", "high")).alias("critical_issues"),
        count_if(F.col("helpful").eqNullSafe(F.lit(True))).alias("resolved_issues"),
    )


def by_type(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("userId", text.first_underscore(F.col("type")).alias("name")).agg(F.count(F.lit(1)).alias("value"))


def by_severity(analyses: DataFrame) -> DataFrame:
    name = F.coalesce(text.given(F.col("severity")), F.lit("unknown"))
    return analyses.groupBy("userId", name.alias("name")).agg(F.count(F.lit(1)).alias("value"))


def monthly(rows: DataFrame, now: DataFrame, key: str, ts: str, months: int = 6) -> DataFrame:
    """Rows after the same time ``months`` ago, by short month name, with the first row's time as an order.

    ``now`` is a single row with column ``now``; it is broadcast.
    """
    recent = rows.join(F.broadcast(now.select(scalars.months_back(F.col("now"), months).alias("since"))), F.col(ts) > F.col("since"))
    return recent.groupBy(key, F.date_format(ts, "MMM").alias("month")).agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("first_at"))


def recent(analyses: DataFrame, n: int = 10) -> DataFrame:
    """The n latest analyses of each user, ties by id; only n rows a user leave a task."""
    order = [F.col("createdAt").desc(), F.col("id").desc()]
    ranked = analyses.withColumn("rank", F.row_number().over(W.partitionBy("userId").orderBy(*order)))
    return ranked.where(F.col("rank") <= n).select("userId", "rank", *RECENT)


def history_page(analyses: DataFrame, user_id, kind: str = "all", severity: str = "all", page: int = 1, limit: int = 20) -> DataFrame:
    """A page of one user's history, newest first; filters that say "all" or nothing don't filter."""
    return matching(analyses, user_id, kind, severity).orderBy(F.col("createdAt").desc(), F.col("id").desc()).offset((max(page, 1) - 1) * max(limit, 1)).limit(max(limit, 1)).select(*RECENT)


HISTORY = ["id", "type", "query", "diagnosis", "severity", "confidence", "treatment", "prevention", "expertAdvice", "cropName", "aiProvider", "customMl", "providerMetadata", "secondaryOpinion", "resultVersion", "createdAt"]


def history_projection(analyses: DataFrame) -> DataFrame:
    """The sixteen fields of a history entry: the result's fields beside it, nested documents passed through as they are.

    An analysis without a result, or without one of the nested documents, has nulls there.
    """
    lifted = {f: F.col(f"result.{f}") for f in ("diagnosis", "severity", "confidence", "treatment", "prevention", "expertAdvice")}
    return analyses.select(*[lifted.get(c, F.col(c)).alias(c) for c in HISTORY])


def with_user(analyses: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's dashboard figures with the stored count and the first name; users without analyses keep theirs."""
    counts = analyses.groupBy("userId").agg(F.count(F.lit(1)).alias("analyses"))
    first = F.get(F.split("name", " "), F.lit(0))
    joined = users.drop("password").join(counts, users["id"] == counts["userId"], "left")
    return joined.select("id", first.alias("first_name"), "email", F.coalesce("analysisCount", F.lit(0)).alias("analysisCount"), F.coalesce("analyses", F.lit(0)).alias("analyses"))


def matching(analyses: DataFrame, user_id, kind: str = "all", severity: str = "all") -> DataFrame:
    df = analyses.where(F.col("userId") == F.lit(user_id))
    for column, value in (("type", kind), ("severity", severity)):
        if value and value != "all":
            df = df.where(F.col(column) == value)
    return df


def pagination(analyses: DataFrame, limit: int = 20) -> DataFrame:
    """Total and pages of each user's history."""
    return analyses.groupBy("userId").agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / max(limit, 1)))


def chat_context(messages: DataFrame, most: int = 5) -> DataFrame:
    """The last messages of each conversation as one text, in order."""
    w = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return last.groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def ages(analyses: DataFrame, now: Column) -> DataFrame:
    """How many analyses have each age in words."""
    return analyses.groupBy(scalars.time_ago(F.col("createdAt"), now).alias("age")).agg(F.count(F.lit(1)).alias("n"))


def rollup_counts(analyses: DataFrame) -> DataFrame:
    """All dashboard counts of a user in one scan: by type, by severity and in all, as grouping sets."""
    return analyses.groupingSets([["userId", "type"], ["userId", "severity"], ["userId"]], "userId", "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
