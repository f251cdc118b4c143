"""Batch sentiment scoring with a pluggable model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.operators.predicates import with_route
from venuelens.operators.rollups import with_irony, with_sentiment
from venuelens.session import scratch_path

# A scorer maps whole texts to an (n, 5) array of star probabilities.
Scorer = Callable[[list[str]], np.ndarray]
RAW_SCHEMA = ("review_id long, locationId long, rating double, language string, p_1star double, "
              "p_2star double, p_3star double, p_4star double, p_5star double, error string")
COLUMNS = ["review_id", "locationId", "rating", "language", "sent_stars_expected", "sent_class", "sent_confidence",
           "p_1star", "p_2star", "p_3star", "p_4star", "p_5star", "is_ironic", "sent_stars_corrected",
           "sent_class_corrected"]


def lexicon_scorer() -> Scorer:
    """A small deterministic scorer by word lists, for tests and demonstrations."""
    positive, negative = set(L.POSITIVE_TERMS), set(L.NEGATIVE_TERMS)

    def score(texts: list[str]) -> np.ndarray:
        out = np.full((len(texts), 5), 0.1)
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            balance = sum(w in positive for w in words) - sum(w in negative for w in words)
            star = 3 + (balance > 0) + (balance > 2) - (balance < 0) - (balance < -2)
            out[i, star - 1] = 0.6
        return out

    return score


def _score_batches(batches: Iterator[pd.DataFrame], factories: dict[str, Callable[[], Scorer]],
                   batch_size: int) -> Iterator[pd.DataFrame]:
    """Score each Arrow batch per route; models are built once per task, on first use.

    A batch whose scorer fails is scored text by text; a text that fails again has no probabilities but an error.
    """
    built: dict[str, Scorer] = {}
    for pdf in batches:
        for route, rows in pdf.groupby("route"):
            if route not in built:
                built[route] = factories[route]()
            for start in range(0, len(rows), batch_size):
                part = rows.iloc[start:start + batch_size]
                probs, errors = _probabilities(built[route], part["text"].astype(str).tolist())
                out = part[["review_id", "locationId", "rating", "language"]].copy()
                for k in range(5):
                    out[f"p_{k + 1}star"] = probs[:, k]
                out["error"] = errors
                yield out


def _probabilities(scorer: Scorer, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
    try:
        return np.asarray(scorer(texts), dtype=float).reshape(len(texts), 5), [None] * len(texts)
    except Exception as e:  # noqa: BLE001
        if len(texts) == 1:
            return np.full((1, 5), np.nan), [f"{type(e).__name__}: {e}"]
    single = [_probabilities(scorer, [t]) for t in texts]
    return np.concatenate([p for p, _ in single]), [e for _, es in single for e in es]


def raw_scores(reviews: DataFrame, primary: Callable[[], Scorer] = lexicon_scorer,
                  fallback: Callable[[], Scorer] | None = None, batch_size: int = 32) -> DataFrame:
    """Star probabilities, or an error, of every review.

    With a fallback, reviews in other languages go to it. Only the model call runs in Python; score,
    class, confidence and irony are native expressions on its output.
    """
    factories = {"primary": primary, "fallback": fallback or primary}
    df = with_route(reviews)
    for name, kind in (("rating", "double"), ("language", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    df = df.select(F.col("review_id").cast("long"), F.col("locationId").cast("long"), F.col("rating").cast("double"),
                   "language", "text", "route")
    return df.mapInPandas(lambda it: _score_batches(it, factories, batch_size), RAW_SCHEMA)


def scored_columns(raw: DataFrame) -> DataFrame:
    return with_irony(with_sentiment(raw.filter("error IS NULL"))).select(*COLUMNS)


def score_reviews(reviews: DataFrame, primary: Callable[[], Scorer] = lexicon_scorer,
                  fallback: Callable[[], Scorer] | None = None, batch_size: int = 32) -> DataFrame:
    """The 15 columns of the reviews that could be scored."""
    return scored_columns(raw_scores(reviews, primary, fallback, batch_size))


def scored_and_failed(reviews: DataFrame, primary: Callable[[], Scorer] = lexicon_scorer,
                      fallback: Callable[[], Scorer] | None = None, path: str | None = None,
                      batch_size: int = 32) -> tuple[DataFrame, DataFrame]:
    """Scored reviews, and (review_id, error) of the others. The model runs once: its output is stored at ``path``."""
    spark = reviews.sparkSession
    path = path or scratch_path(spark, "raw-scores")
    raw = raw_scores(reviews, primary, fallback, batch_size)
    raw.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(raw.schema).parquet(path)
    return scored_columns(stored), stored.filter("error IS NOT NULL").select("review_id", "error")
