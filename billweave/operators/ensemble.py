"""Combining several readings of one image: results(image_id, model, text, confidence, seconds, ord)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.functions.scores import text_quality
from billweave.operators.resolve import levenshtein_ratio

Ratio = Callable[[Column, Column], Column]


def weights(results: DataFrame, by_model: dict[str, float] | None = None) -> DataFrame:
    """results with weight: the model's weight times confidence, normalised by image; equal if all are zero."""
    own = F.lit(1.0)
    for model, w in (by_model or {}).items():
        own = F.when(F.col("model") == model, float(w)).otherwise(own)
    image = Window.partitionBy("image_id")
    raw = own * F.coalesce("confidence", F.lit(0.0))
    total = F.sum(raw).over(image)
    return results.withColumn("weight", F.when(total > 0, raw / total).otherwise(1.0 / F.count("*").over(image)))


def consensus(results: DataFrame, ratio: Ratio = levenshtein_ratio, by_model: dict[str, float] | None = None) -> DataFrame:
    """image_id, model, text, score, confidence and seconds: the reading most like all others by weight, first on a tie."""
    w = weights(results, by_model)
    x, y = w.alias("x"), w.alias("y")
    scored = x.join(y, "image_id").groupBy("image_id", F.col("x.ord").alias("ord"), F.col("x.model").alias("model"), F.col("x.text").alias("text")).agg(F.round(F.sum(ratio(F.col("x.text"), F.col("y.text")) * F.col("y.weight")), 6).alias("score"))
    pick = Window.partitionBy("image_id").orderBy(F.desc("score"), "ord")
    best = scored.withColumn("rank", F.row_number().over(pick)).where("rank = 1").drop("rank", "ord")
    overall = w.groupBy("image_id").agg(F.round(F.sum(F.col("confidence") * F.col("weight")), 4).alias("confidence"), F.round(F.avg("seconds"), 4).alias("seconds"))
    return best.join(overall, "image_id")


def consistency(results: DataFrame, ratio: Ratio = levenshtein_ratio) -> DataFrame:
    """results with consistency: the mean likeness of a reading to the others of its image; 0 if it is alone."""
    x, y = results.alias("x"), results.select("image_id", F.col("ord").alias("o"), F.col("text").alias("t")).alias("y")
    mean = x.join(y, "image_id").where(F.col("ord") != F.col("o")).groupBy("image_id", "ord").agg(F.avg(ratio(F.col("text"), F.col("t"))).alias("consistency"))
    return results.join(mean, ["image_id", "ord"], "left").withColumn("consistency", F.coalesce("consistency", F.lit(0.0)))


def scored(results: DataFrame, ratio: Ratio = levenshtein_ratio) -> DataFrame:
    """results with consistency and quality, a struct with total."""
    return consistency(results, ratio).withColumn("quality", text_quality(F.col("text"), F.col("confidence"), F.col("consistency")))


def passed(scores: DataFrame, least: float = 0.6, enough: int = 2) -> DataFrame:
    """Readings whose total reaches `least`, with needs_retry: fewer than `enough` of the image do."""
    kept = scores.where(F.col("quality.total") >= least)
    return kept.withColumn("needs_retry", F.count("*").over(Window.partitionBy("image_id")) < enough)


def best_reading(results: DataFrame, by: str = "confidence") -> DataFrame:
    """One reading of each image by confidence, length or vote (the text with the best mean confidence); first on a tie."""
    image = Window.partitionBy("image_id")
    if by == "vote":
        results = results.withColumn("key", F.avg("confidence").over(Window.partitionBy("image_id", "text")))
    else:
        results = results.withColumn("key", F.col("confidence") if by == "confidence" else F.length("text").cast("double"))
    return results.withColumn("rank", F.row_number().over(image.orderBy(F.desc("key"), "ord"))).where("rank = 1").drop("rank", "key")


def combined(results: DataFrame) -> DataFrame:
    """The most confident reading of each image under the name of the combination; the first on a tie."""
    order = F.struct(-F.col("confidence"), F.col("ord"))
    return results.groupBy("image_id").agg(F.min_by("text", order).alias("text"), F.max("confidence").alias("confidence")).withColumn("model", F.lit("weighted_combination"))


def with_minimum(results: DataFrame, least: int = 2) -> DataFrame:
    """image_id, n and status of every image: consensus, best, or ensemble_failed without readings of any text."""
    n = results.groupBy("image_id").agg(F.count_if(F.length(F.coalesce("text", F.lit(""))) > 0).alias("n"))
    return n.withColumn("status", F.when(F.col("n") >= least, "consensus").when(F.col("n") > 0, "best").otherwise("ensemble_failed"))


def available(engines: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the engines(model, loaded) whose models are loaded."""
    return results.join(engines.where("loaded").select("model").distinct(), "model", "left_semi").select(*results.columns)
