"""The table builds: raw documents to published tables, and the views a dashboard asks for.

Every step publishes its table and reads it back, which is also where lineage ends. A published table
is kept when ``skip_if_exists`` is set, so an interrupted build goes on where it stopped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens import schemas
from venuelens.functions import scalars as S
from venuelens.operators import joins as J
from venuelens.operators import menu as M
from venuelens.operators import predicates as P
from venuelens.operators import rollups as R
from venuelens.operators import sampling, spatial
from venuelens.operators.ordering import assign_chunks
from venuelens.operators.scoring import Scorer, lexicon_scorer, scored_and_failed
from venuelens.sources import documents as D
from venuelens.sources import files, sinks, tables


def _publish(spark: SparkSession, df: DataFrame, path: str, skip_if_exists: bool) -> DataFrame:
    sinks.write_table(df, path, skip_if_exists)
    return tables.read_table(spark, path)


def build_venues(spark: SparkSession, raw: str, out: str, skip_if_exists: bool = False) -> dict[str, DataFrame]:
    """restaurants, menu_items, menu_diversity and restaurants_enriched from venue documents."""
    # The text is parsed once; the tables below read only their fields of the stored structure.
    read = D.parsed_venues(D.read_documents(spark, raw))
    errors = F.when(F.col("r").isNull(), F.coalesce("error", F.when(F.try_parse_json("value").isNotNull(), "no venue in the document").otherwise("not JSON")))
    docs = _publish(spark, read.withColumn("error", errors).drop("value"), f"{out}/venue_documents", skip_if_exists)
    t = {"rejected": _publish(spark, D.document_errors(docs), f"{out}/rejected_documents", skip_if_exists)}
    t["restaurants"] = _publish(spark, D.parse_venues(docs), f"{out}/restaurants", skip_if_exists)
    t["menu_items"] = _publish(spark, M.menu_items(D.parse_menu(docs)), f"{out}/menu_items", skip_if_exists)
    t["menu_diversity"] = _publish(spark, M.menu_diversity(t["menu_items"]), f"{out}/menu_diversity", skip_if_exists)
    texts = t["menu_items"].select("locationId", S.item_text("item_title", "item_description").alias("text"))
    enriched = J.enrich_venues(
        t["restaurants"].withColumn("arrondissement", S.district_number("neighborhoods")),
        t["menu_diversity"], M.seasonality(texts), spatial.competition(t["restaurants"]))
    t["restaurants_enriched"] = _publish(spark, enriched, f"{out}/restaurants_enriched", skip_if_exists)
    return t


def build_reviews(spark: SparkSession, raw: str, out: str, min_text_length: int = 20, max_venues: int | None = None,
                  venues: DataFrame | None = None, skip_if_exists: bool = False) -> DataFrame:
    """all_reviews from review documents; at most ``max_venues`` venues, by district when given ``venues``."""
    reviews = D.parse_reviews(D.read_documents(spark, raw), min_text_length)
    if max_venues and venues is not None:
        known = venues.select("locationId", "arrondissement")
        reviews = P.keep_matching(reviews, known, "locationId")
        strata = J.with_group_value(reviews.select("locationId"), known, "locationId")
        chosen = sampling.stratified_venues(strata, "locationId", "arrondissement", max_venues)
        reviews = P.keep_matching(reviews, chosen, "locationId")
    elif max_venues:
        reviews = D.first_venues(reviews, "locationId", max_venues)
    return _publish(spark, reviews, f"{out}/all_reviews", skip_if_exists)


def build_sentiment(spark: SparkSession, reviews: DataFrame, out: str, primary: Callable[[], Scorer] = lexicon_scorer,
                    fallback: Callable[[], Scorer] | None = None, chunk: tuple[int, int] | None = None,
                    parts: int = 1, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Score the reviews that no shard holds yet as new shards, then merge and roll up all shards.

    With ``sample`` only so many of the open reviews are scored, drawn uniformly. Files of shards that cannot be read are left out
    of the merge and listed, with their errors, in ``unreadable_shards``.

    ``chunk`` (i, n) takes the i-th of n chunks in id order; ``parts`` shards are stored one after the other. Reviews
    whose scorer fails go to a table of failed reviews with the error; as no shard holds them, the next run tries again.
    """
    glob = f"{out}/sentiment_reviews*"
    todo = P.long_enough(reviews)
    if fallback is None:
        todo = P.supported_languages(todo)
    shard_no = _next_shard(spark, out)
    if tables.path_exists(spark, glob):
        done = tables.read_shards(spark, glob, schemas.SENTIMENT_REVIEWS)
        todo = P.drop_matching(todo, done.select("review_id").distinct(), "review_id")
    if chunk is not None:
        todo = assign_chunks(todo, "review_id", chunk[1]).filter(F.col("chunk_id") == chunk[0]).drop("chunk_id")
    if sample is not None:
        todo = sampling.uniform_sample(todo, "review_id", sample)
    # Each part is stored before the next is scored: a failed job loses one part at most.
    for part in range(parts):
        own = todo if parts == 1 else todo.filter(F.pmod(F.xxhash64("review_id"), F.lit(parts)) == part)
        scored, failed = scored_and_failed(own, primary, fallback, f"{out}/raw_scores_part{shard_no + part:05d}")
        scored.write.mode("errorifexists").parquet(f"{out}/sentiment_reviews_part{shard_no + part:05d}")
        failed.write.mode("errorifexists").parquet(f"{out}/failed_reviews_part{shard_no + part:05d}")
    merged = J.keep_one(tables.read_shards(spark, glob, schemas.SENTIMENT_REVIEWS), "review_id", F.asc("shard")).drop("shard")
    merged = _publish(spark, merged, f"{out}/merged_reviews", False)
    _publish(spark, files.unreadable_shards(files.check_shards(spark, glob)), f"{out}/unreadable_shards", False)
    rollup = _publish(spark, R.sentiment_rollup(merged), f"{out}/sentiment_restaurant_v2", False)
    return merged, rollup


def _next_shard(spark: SparkSession, out: str) -> int:
    """One more than the largest number in use; shards that were merged away leave gaps."""
    used = [re.search(r"_part(\d+)$", p) for p in tables.list_paths(spark, f"{out}/*_part*")]
    return max((int(m[1]) + 1 for m in used if m), default=0)


def load_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables a dashboard reads; absent sentiment tables are empty, older ones get their irony columns."""
    venues = tables.with_derived(tables.read_table(spark, f"{out}/restaurants_enriched"))
    items = tables.read_table(spark, f"{out}/menu_items")
    glob = f"{out}/sentiment_reviews*"
    if tables.path_exists(spark, f"{out}/merged_reviews"):
        scored = tables.read_table(spark, f"{out}/merged_reviews")
    elif tables.path_exists(spark, glob):
        scored = J.keep_one(tables.read_shards(spark, glob, schemas.SENTIMENT_REVIEWS), "review_id", F.asc("shard")).drop("shard")
    else:
        scored = spark.createDataFrame([], schemas.SENTIMENT_REVIEWS)
    scored = R.backfill_irony(scored)
    path = f"{out}/sentiment_restaurant_v2"
    rollup = tables.read_table(spark, path) if tables.path_exists(spark, path) else R.sentiment_rollup(scored)
    if "sent_mean_corrected" not in rollup.columns:
        rollup = R.sentiment_rollup(scored)
    unreadable = tables.read_optional(spark, f"{out}/unreadable_shards", T.StructType.fromDDL("path string, shard string, length long, error string"))
    return {"enriched": venues, "menu_items": items, "sentiment_reviews": scored, "sentiment_v2": rollup, "unreadable_shards": unreadable}


def select_view(t: dict[str, DataFrame], **filters) -> dict[str, DataFrame]:
    """All tables restricted to the venues that pass the filter, venues joined to their sentiment."""
    venues = t["enriched"].filter(P.venue_filter(**filters))
    merged = venues.join(t["sentiment_v2"], "locationId")
    return {"venues": venues, "merged": merged, "menu_items": P.keep_matching(t["menu_items"], venues, "locationId"),
            "reviews": P.keep_matching(t["sentiment_reviews"], merged, "locationId")}
