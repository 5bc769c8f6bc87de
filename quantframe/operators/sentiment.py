"""Lexicon sentiment of news texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / (positive + negative) words, 0 if there are none."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*words)))

    p, n = hits(positive), hits(negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def daily_sentiment(news: DataFrame, day: str, score: str) -> DataFrame:
    return news.groupBy(day).agg(F.round(F.avg(score), 3).alias("mean"), F.round(F.stddev_samp(score), 3).alias("std"), F.count(F.lit(1)).alias("n"))


def market_sentiment(vix: Column, put_call: Column) -> Column:
    fear = F.when(vix < 20, 1).when(vix > 30, -1).otherwise(0)
    return (fear + F.when(put_call < 0.8, 1).when(put_call > 1.2, -1).otherwise(0)) / 2


def fear_class(value: Column) -> Column:
    return F.when(value <= 25, "extreme fear").when(value <= 45, "fear").when(value <= 55, "neutral").when(value <= 75, "greed").otherwise("extreme greed")


#: The words that count as positive and as negative.
POSITIVE = ["good", "great", "excellent", "positive", "up", "rise", "gain", "profit", "bullish", "optimistic", "strong", "growth", "increase", "rally", "surge"]
NEGATIVE = ["bad", "terrible", "negative", "down", "fall", "loss", "decline", "bearish", "pessimistic", "weak", "decrease", "crash", "plunge", "drop"]


def sentiment_summary(scores: DataFrame, source: str, day: str, score: str, days: int) -> DataFrame:
    """Mean and latest score of each source over the last days before the newest row; of one day's rows, the mean is the latest."""
    newest = scores.agg(F.max(day)).first()[0]
    recent = scores.filter(F.datediff(F.lit(newest), F.col(day)) < days) if newest is not None else scores
    daily = recent.groupBy(source, day).agg(F.avg(score).alias("mean_day"), F.sum(score).alias("sum"), F.count(score).alias("n"))
    return daily.groupBy(source).agg((F.sum("sum") / F.sum("n")).alias("mean"), F.max_by("mean_day", day).alias("latest"), F.sum("n").alias("n"))
