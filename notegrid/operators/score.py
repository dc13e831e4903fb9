"""Trust of collected knowledge, from its sources and their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import text as tx

DEFAULT_TRUST = 0.45


def source_trust(url: Column, content: Column, domains: dict[str, float], boost: list[str] = (), penalty: list[str] = ()) -> Column:
    """Trust of the first known domain contained in the address's, 0.05 more for each
    boosting word up to 1, 0.1 less for each penalised one down to 0.1."""
    host, text = tx.domain(url), F.lower(content)
    score = F.coalesce(*[F.when(F.contains(host, F.lit(d)), F.lit(t)) for d, t in domains.items()], F.lit(DEFAULT_TRUST))
    for word in boost:
        score = F.when(F.contains(text, F.lit(word.lower())), F.least(score + 0.05, F.lit(1.0))).otherwise(score)
    for word in penalty:
        score = F.when(F.contains(text, F.lit(word.lower())), F.greatest(score - 0.1, F.lit(0.1))).otherwise(score)
    return score


def freshness(results: DataFrame, day: str) -> DataFrame:
    """(topic, freshness): share of dated results (column date) of the last 90 days
    before `day`, or worded in days or weeks; 0.5 without any date."""
    text = F.lower("date")
    typed = F.try_to_date(F.regexp_extract("date", r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
    worded = F.contains(text, F.lit("day")) | F.contains(text, F.lit("week"))
    dated = worded | F.contains(text, F.lit("month")) | F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}")
    recent = worded | (F.datediff(F.lit(day).cast("date"), typed) < 90)
    n, k = F.count_if(dated), F.count_if(dated & F.coalesce(recent, F.lit(False)))
    return results.groupBy("topic").agg(F.when(n == 0, 0.5).otherwise(k / n).alias("freshness"))


def specificity(results: DataFrame) -> DataFrame:
    """(topic, specificity): numbers, versions and comparisons in title and snippet (column content)."""
    c = F.col("content")
    hits = sum((c.rlike(p).cast("int") for p in (r"(?i)\d+\.?\d*\s*(%|percent|배|times|x)", r"(v?\d+\.\d+|20\d{2})", r"(?i)(vs|compared|benchmark|outperform|대비|비교)")), F.lit(0))
    return results.groupBy("topic").agg(F.least(F.sum(hits) / (F.count(F.lit(1)) * 2), F.lit(1.0)).alias("specificity"))


def agreement(results: DataFrame, words: Column) -> DataFrame:
    """(topic, cross_check) from the number of domains and the mean share of common
    words of two results of a topic; 0.3 for a single result. A topic's results are
    few by nature, they come from one search."""
    rows = results.select("topic", "result_id", "url", F.array_distinct(words).alias("words"))
    many = rows.groupBy("topic").agg(F.countDistinct(tx.domain(F.col("url"))).alias("domains"), F.count(F.lit(1)).alias("n"))
    a, b = rows.select("topic", F.col("result_id").alias("i"), F.col("words").alias("x")), rows.select("topic", F.col("result_id").alias("j"), F.col("words").alias("y"))
    pairs = a.join(b, "topic").where((F.col("i") < F.col("j")) & (F.size("x") > 0) & (F.size("y") > 0))
    share = F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))
    mean = pairs.groupBy("topic").agg(F.avg(share).alias("overlap"))
    score = 0.5 * F.least(F.col("domains") / 3.0, F.lit(1.0)) + 0.5 * F.coalesce("overlap", F.lit(0.0))
    return many.join(mean, "topic", "left").select("topic", F.when(F.col("n") < 2, 0.3).otherwise(score).alias("cross_check"))


def grade(overall: Column) -> Column:
    return F.when(overall >= 0.8, "A").when(overall >= 0.6, "B").when(overall >= 0.4, "C").otherwise("D")


def overall(source: Column, cross: Column, consistency: Column, fresh: Column, specific: Column) -> Column:
    return 0.30 * source + 0.25 * cross + 0.15 * consistency + 0.15 * fresh + 0.15 * specific


def hit_share(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(config, relevance): mean share of a query's expected texts found in the names
    of its first five results. results: (config, query_id, place, name), expected: (query_id, expected)."""
    top = results.where(F.col("place") <= 5).groupBy("config", "query_id").agg(F.collect_list(F.lower("name")).alias("names"))
    both = top.join(expected, "query_id").withColumn("hit", F.exists("names", lambda n: F.contains(n, F.lower("expected"))).cast("int"))
    return both.groupBy("config", "query_id").agg(F.avg("hit").alias("share")).groupBy("config").agg(F.avg("share").alias("relevance"))
