"""Queries over batch scoring and incremental processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens import lexicons as L
from venuelens.operators import joins as J
from venuelens.operators import rollups as R
from venuelens.operators import scoring as M
from venuelens.operators.quantiles import grouped_stats
from venuelens.plans import bindings as B
from venuelens.plans.q_sources import write_shards
from venuelens.plans.registry import query
from venuelens.schemas import SENTIMENT_REVIEWS
from venuelens.session import scratch_path
from venuelens.sources import tables
from venuelens.streaming import incremental as I


def _terms(ts: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in ts) + ")"


def model_sql(where: str = "true", fallback: bool = False) -> str:
    star = "3 + CAST(b > 0 AS INTEGER) + CAST(b > 2 AS INTEGER) - CAST(b < 0 AS INTEGER) - CAST(b < -2 AS INTEGER)"
    if fallback:
        star = f"CASE WHEN language IN ('fr','en','it','es','pt','de','nl') THEN {star} ELSE 3 END"
    return rf"""WITH {B.REVIEWS_SQL}, r AS (SELECT * FROM reviews WHERE {where}), w AS (SELECT review_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM r),
  c AS (SELECT review_id, count(*) FILTER (word IN {_terms(L.POSITIVE_TERMS)}) - count(*) FILTER (word IN {_terms(L.NEGATIVE_TERMS)}) AS b FROM w GROUP BY 1),
  s AS (SELECT r.review_id, r."locationId", r.rating, CAST({star.replace('b >', 'coalesce(b, 0) >').replace('b <', 'coalesce(b, 0) <')} AS INTEGER) AS sent_class FROM r LEFT JOIN c USING (review_id)),
  f AS (SELECT *, 0.1e0 * 15 + 0.5e0 * sent_class AS sent_stars_expected, coalesce(sent_class >= 4 AND rating <= 2, false) AS is_ironic FROM s)
  SELECT review_id, "locationId", rating, sent_class, sent_stars_expected, is_ironic, CASE WHEN is_ironic THEN rating ELSE sent_stars_expected END AS sent_stars_corrected FROM f"""


SHOWN = ["review_id", "locationId", "rating", "sent_class", "sent_stars_expected", "is_ironic", "sent_stars_corrected"]
MODEL_D = "rating sent_stars_expected sent_stars_corrected"


@query("i1_batch_scoring", model_sql(), doubles=MODEL_D)
def _(spark, sf):
    return M.score_reviews(B.reviews(spark, sf, spread=True)).select(*SHOWN)


def neutral_scorer():
    """A stand-in for a second model: every text gets three stars."""
    import numpy as np
    return lambda texts: np.tile([0.1, 0.1, 0.6, 0.1, 0.1], (len(texts), 1))


@query("i4_routed_scoring", model_sql(fallback=True), doubles=MODEL_D)
def _(spark, sf):
    return M.score_reviews(B.reviews(spark, sf, spread=True), fallback=neutral_scorer).select(*SHOWN)


def _arriving(df) -> int:
    """How many files arrive: four at least, and one for every split that is read, so that a file does not grow with the tables."""
    return max(4, df.rdd.getNumPartitions())


def _landed_reviews(spark, sf, copies: bool):
    """The reviews as several files in a landing folder, and how many; with ``copies``, every fifth twice."""
    path = scratch_path(spark, "landing")
    r = B.reviews(spark, sf)
    if copies:
        r = r.unionByName(r.filter("review_id % 5 = 0"))
    n = _arriving(r)
    r.repartition(n, "review_id").write.parquet(path)
    return path, r.schema, n


@query("i2_resumed_scoring", model_sql(), doubles=MODEL_D)
def _(spark, sf):
    path, schema, n = _landed_reviews(spark, sf, copies=True)
    sink, state = scratch_path(spark, "scores"), scratch_path(spark, "state")
    # The second run finds nothing new.
    for _run in range(2):
        I.score_stream(I.file_stream(spark, path, schema, files_per_batch=n // 2), sink, state)
    return spark.read.parquet(sink).select(*SHOWN)


@query("i2_batch_resume", model_sql(), doubles=MODEL_D)
def _(spark, sf):
    r = B.reviews(spark, sf, spread=True)
    path = scratch_path(spark, "done")
    M.score_reviews(r.filter("review_id % 2 = 0")).write.parquet(path)
    done = spark.read.parquet(path)
    fresh = M.score_reviews(r.join(done.select("review_id"), "review_id", "left_anti"))
    return J.upsert(done, fresh).select(*SHOWN)


def picky_scorer():
    """A model that fails on texts that start with T."""
    def score(texts):
        if any(t.startswith("T") for t in texts):
            raise ValueError("starts with T")
        return M.lexicon_scorer()(texts)
    return score


@query("i1_failed_scoring", f"""WITH {B.REVIEWS_SQL} SELECT review_id, NOT starts_with(text, 'T') AS scored,
  CASE WHEN starts_with(text, 'T') THEN 'ValueError: starts with T' END AS error FROM reviews""")
def _(spark, sf):
    scored, failed = M.scored_and_failed(B.reviews(spark, sf, spread=True), picky_scorer)
    good = scored.select("review_id", F.lit(True).alias("scored"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(failed.select("review_id", F.lit(False).alias("scored"), "error"))


@query("i3_merged_shards", f"""WITH {B.SCORED_SQL} {B.rollup_sql('"locationId"')}""", doubles=B.ROLLUP_COLUMNS)
def _(spark, sf):
    shards = tables.read_shards(spark, write_shards(spark, sf, "merge") + "/sentiment_reviews*", SENTIMENT_REVIEWS)
    return R.sentiment_rollup(J.keep_one(shards, "review_id", F.asc("shard")))


def _running(spark, sf):
    """The running table of the scored reviews, which arrive in four files or more, half of them a batch; every fifth review lies in two files."""
    path, out, state = (scratch_path(spark, n) for n in ("scored", "running", "state"))
    s = B.scored(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in SENTIMENT_REVIEWS.fields])
    s = s.unionByName(s.filter("review_id % 5 = 0"))
    n = _arriving(s)
    s.repartition(n).write.parquet(path)
    I.rollup_stream(I.file_stream(spark, path, SENTIMENT_REVIEWS, files_per_batch=n // 2), out, state)
    return I.latest_version(spark, out)


@query("i5_running_rollup", f"""WITH {B.SCORED_SQL}, r AS ({B.rollup_sql('"locationId"')}) SELECT "locationId", n_reviews_scored, sent_mean, sent_std, pct_negative, pct_positive, pct_ironic, rating_mean_reviews FROM r""",
       doubles="sent_mean sent_std pct_negative pct_positive pct_ironic rating_mean_reviews")
def _(spark, sf):
    return _running(spark, sf).select("locationId", "n_reviews_scored", "sent_mean", "sent_std", "pct_negative", "pct_positive", "pct_ironic",
                                      "rating_mean_reviews")


@query("i5_running_quantiles", f"""WITH {B.SCORED_SQL} SELECT "locationId", count(*) AS n, true AS median_in_bound, true AS q75_in_bound, median(sent_stars_expected) AS median
  FROM scored GROUP BY 1""", doubles="median")
def _(spark, sf):
    # the sketched quantiles against the ranks they have among the venue's reviews, besides the exact median of the batch
    running = _running(spark, sf).select("locationId", "median_expected", "q75_expected")
    s = B.scored(spark, sf).select("locationId", "sent_stars_expected").join(running, "locationId")
    x, n = F.col("sent_stars_expected"), F.count("*")
    slack = I.RANK_ERROR * n + 1

    def inside(q: str, share: float):
        # the quantile's possible ranks reach from the smaller values to those with its ties
        return (F.count_if(x < F.col(q)) <= share * n + slack) & (F.count_if(x <= F.col(q)) >= share * n - slack)

    exact = grouped_stats(B.scored(spark, sf), ["locationId"], [F.count("*").alias("n")], {"median": ("sent_stars_expected", 0.5)})
    checked = s.groupBy("locationId").agg(inside("median_expected", 0.5).alias("median_in_bound"), inside("q75_expected", 0.75).alias("q75_in_bound"))
    return exact.join(checked, "locationId")
