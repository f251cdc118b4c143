"""Incremental scoring and rollups with Structured Streaming over files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuelens.operators.joins import keep_one
from venuelens.operators.rollups import with_irony
from venuelens.operators.scoring import score_reviews
from venuelens.schemas import SENTIMENT_REVIEWS
from venuelens.sources.tables import path_exists
from venuelens.streaming import ids

Step = Callable[[DataFrame], DataFrame]

#: Venues in one part of the running table: a part is what a batch rewrites for a changed venue.
VENUES_PER_PART = 10_000
#: Size parameter of the quantile sketches and the rank error it stands for (as a share of a venue's reviews).
SKETCH_SIZE = 400
RANK_ERROR = 0.01
SKETCHED = {"sent_stars_expected": "stars_sketch", "sent_stars_corrected": "corrected_sketch"}


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def _store(fresh: DataFrame, sink: str, key: str, batch_id: int, score: Step) -> None:
    """Scores of a batch, their ids, and the input rows that got none."""
    score(fresh).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    stored = fresh.sparkSession.read.schema(SENTIMENT_REVIEWS).parquet(f"{sink}/batch_id={batch_id}").select(key)
    ids.remember(stored, f"{sink}_ids", key, batch_id)
    fresh.join(stored, key, "left_anti").write.mode("overwrite").parquet(f"{sink}_rejected/batch_id={batch_id}")


def retry_rejected(spark: SparkSession, sink: str, key: str = "review_id", score: Step = score_reviews) -> None:
    """Score what earlier runs rejected and no batch has scored since."""
    if not path_exists(spark, f"{sink}_rejected/batch_id=*"):
        return
    rejected = spark.read.parquet(f"{sink}_rejected")
    number = min(rejected.agg(F.min("batch_id")).first()[0] or 0, 0) - 1
    fresh = ids.without_known(keep_one(rejected, key, F.desc("batch_id")).drop("batch_id"), f"{sink}_ids", key, number)
    if not fresh.isEmpty():
        _store(fresh, sink, key, number, score)


def score_stream(reviews: DataFrame, sink: str, checkpoint: str, key: str = "review_id",
                 score: Step = score_reviews) -> None:
    """Score the reviews that are not in the sink yet, for all files available now.

    Each batch drops repeated ids, leaves out the ids of earlier batches, and replaces its own folder
    when it is run again after a failure. No id is held as stream state: the ids of the sink lie beside it, and a batch reads
    only the ranges its own ids fall in. Reviews that come back without a
    score are kept in ``{sink}_rejected`` and tried again, under a negative batch number, when the next run starts.
    """
    retry_rejected(reviews.sparkSession, sink, key, score)

    def write(batch: DataFrame, batch_id: int) -> None:
        own = keep_one(batch.filter(F.col(key).isNotNull()), key, F.xxhash64(*batch.columns).asc())
        fresh = ids.without_known(own, f"{sink}_ids", key, batch_id).persist()
        _store(fresh, sink, key, batch_id, score)
        fresh.unpersist()

    q = (reviews.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def sums() -> dict[str, Column]:
    """Sums of a venue that can be added up, so that a batch is merged into what is there."""
    stars = "sent_stars_expected"
    return {"n": F.count("*"), "stars": F.sum(stars), "stars_n": F.count(stars),
            "spread": F.coalesce(F.var_pop(stars) * F.count(stars), F.lit(0.0)), "negative": F.count_if(F.col("sent_class") <= 2),
            "positive": F.count_if(F.col("sent_class") >= 4), "ironic": F.count_if("is_ironic"), "rating": F.sum("rating"), "rating_n": F.count("rating")}


def rollup_stream(scored: DataFrame, out: str, checkpoint: str, key: str = "locationId", id_key: str = "review_id",
                  sketch_size: int = SKETCH_SIZE) -> None:
    """Running sentiment per venue while shards arrive, with sketches for its quantiles.

    No stream state is kept. A review that several files hold counts once: its id is looked up in, and added to, the ids beside the
    table. A batch is reduced to one row per venue, merged with the last version of those venues' parts only, and
    published as new versions of these parts; a version counts from the moment its list of parts is
    there, so readers and a repeated batch never see half of one. See ``running_totals`` and ``latest_version``.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = keep_one(batch.filter(F.col(key).isNotNull() & F.col(id_key).isNotNull()), id_key, F.xxhash64(*batch.columns).asc())
        fresh = with_irony(ids.without_known(own, f"{out}/ids", id_key, batch_id)).persist()
        new = fresh.groupBy(key).agg(*[v.alias(n) for n, v in sums().items()],
                                     *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(sketch_size)).alias(s) for c, s in SKETCHED.items()])
        changed = new.select(ids.range_of(new, key, VENUES_PER_PART).alias("part")).distinct()
        parts = [r["part"] for r in changed.collect()]
        before = running_totals(spark, out, batch_id, parts)
        rows = new if before is None else merged(before, new, key)
        if parts:
            (rows.withColumn("part", ids.range_of(new, key, VENUES_PER_PART)).withColumn("version", F.lit(batch_id)).repartition("part").write
             .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(f"{out}/parts"))
        ids.remember(fresh, f"{out}/ids", id_key, batch_id)
        spark.createDataFrame([(p,) for p in parts], "part long").coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/version={batch_id}")
        fresh.unpersist()

    q = scored.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def merged(before: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Sums and sketches of venues of either table added up; squared deviations by the gap of the two means."""
    a, b = ({c: F.col(f"{side}.{c}") for c in new.columns} for side in ("a", "b"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    mean_gap = a["stars"] / F.nullif(a["stars_n"], F.lit(0)) - b["stars"] / F.nullif(b["stars_n"], F.lit(0))
    between = F.coalesce(a["stars_n"] * b["stars_n"] / F.nullif(a["stars_n"] + b["stars_n"], F.lit(0)) * mean_gap * mean_gap, F.lit(0.0))
    added = {n: zero(a[n]) + zero(b[n]) + (between if n == "spread" else 0) for n in sums()}
    joined = {s: F.coalesce(F.kll_sketch_merge_double(a[s], b[s]), a[s], b[s]) for s in SKETCHED.values()}
    return before.alias("a").join(new.alias("b"), a[key] == b[key], "full").select(
        F.coalesce(a[key], b[key]).alias(key), *[v.alias(n) for n, v in {**added, **joined}.items()])


def running_totals(spark: SparkSession, out: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """The sums and sketches of all venues, or of those in ``parts``, as published before version ``before``.

    Only the newest version of a part is opened. The list of parts, a number for every ``VENUES_PER_PART`` venues, passes
    through the driver. None if nothing is there.
    """
    if not path_exists(spark, f"{out}/versions/version=*/_SUCCESS"):
        return None
    lists = spark.read.schema("part long, version long").parquet(f"{out}/versions")
    if before is not None:
        lists = lists.filter(F.col("version") < before)
    newest = lists.groupBy("part").agg(F.max("version").alias("version")).collect()
    wanted = None if parts is None else set(parts)
    paths = [f"{out}/parts/part={r['part']}/version={r['version']}" for r in newest if wanted is None or r["part"] in wanted]
    return spark.read.parquet(*paths) if paths else None


def latest_version(spark: SparkSession, out: str, key: str = "locationId") -> DataFrame:
    """The running table: means, deviations, shares, and quantiles within ``RANK_ERROR`` of the asked rank.

    A median of the sketch stands at a rank between 0.5 - ``RANK_ERROR`` and 0.5 + ``RANK_ERROR`` of the venue's reviews with
    high probability (99 %); the batch rollup gives the exact one.
    """
    t = running_totals(spark, out)
    if t is None:
        raise ValueError(f"no running table at {out}")
    share = lambda x: 100.0 * F.col(x) / F.nullif(F.col("n"), F.lit(0))
    return t.select(
        key, F.col("n").alias("n_reviews_scored"), (F.col("stars") / F.nullif(F.col("stars_n"), F.lit(0))).alias("sent_mean"),
        F.sqrt(F.col("spread") / F.nullif(F.col("stars_n") - 1, F.lit(0))).alias("sent_std"),
        share("negative").alias("pct_negative"), share("positive").alias("pct_positive"), share("ironic").alias("pct_ironic"),
        (F.col("rating") / F.nullif(F.col("rating_n"), F.lit(0))).alias("rating_mean_reviews"),
        *[F.kll_sketch_get_quantile_double(s, F.lit(q)).alias(f"{n}_{c.removeprefix('sent_stars_')}")
          for c, s in SKETCHED.items() for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])
