"""Queries over scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from venuelens.operators import joins as J
from venuelens.operators import menu as M
from venuelens.plans import bindings as B
from venuelens.plans.registry import query
from venuelens.session import cut_lineage, scratch_path
from venuelens.sources import documents as D
from venuelens.sources import files, sinks, tables
from venuelens.schemas import SENTIMENT_REVIEWS
from pyspark.sql import types as T


def venue_documents(spark, sf):
    """One JSON document per venue; some are broken."""
    v = B.venues(spark, sf)
    labels = F.split("cuisines", "[|]")
    doc = F.array(F.struct(
        "locationId", "name",
        F.struct(F.struct("latitude", "longitude").alias("geoPoint"), F.struct(F.struct(F.struct(
            F.lit("Paris").alias("cityName"), F.lit("Île-de-France").alias("regionName")).alias("locationData"))
            .alias("gtmData")).alias("details")).alias("location"),
        F.struct(F.transform(labels, lambda x: F.struct(F.struct(x.alias("localizedName")).alias("tag"))).alias("items"))
         .alias("cuisines"),
        F.when(F.col("neighborhoods").isNotNull(), F.array(F.struct(F.struct(F.col("neighborhoods").alias("name"))
               .alias("neighborhood")))).alias("neighborhoods"),
        F.struct(F.when(F.col("priceLevel").isNotNull(), F.array(F.struct(F.col("priceLevel").alias("secondaryName"))))
                 .alias("items")).alias("priceTypes"),
        F.array(F.struct(F.array(F.struct(F.when(F.col("hasMichelin"), "MICHELIN").otherwise("OTHER")
                                          .alias("award_title"))).alias("awards"))).alias("restaurantAwards"),
        F.struct("rating", F.col("reviewCount").alias("count")).alias("reviewSummary"),
        F.struct(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.when(
            F.col("nb_items_total") > 0, F.array(F.struct(F.lit("x").alias("title_unobsfuscated")))).alias("items")))
            .alias("sections"))).alias("menu")).alias("providerMenu")).alias("providerContent")).alias("menu")))
    value = F.when(F.col("locationId") % 47 == 46, "[{broken").otherwise(F.to_json(doc))
    return v.select(F.concat(F.col("locationId").cast("string"), F.lit(".json")).alias("file_name"), value.alias("value"))


@query("a1_venue_documents", f"""WITH {B.VENUES_SQL} SELECT "locationId", name, rating, "reviewCount", latitude, longitude, cuisines,
  neighborhoods, "priceLevel", "hasMichelin", nb_items_total > 0 AS "hasMenu", 'Paris' AS city, 'Île-de-France' AS region
  FROM venues WHERE "locationId" % 47 <> 46""", doubles="rating latitude longitude")
def _(spark, sf):
    return D.parse_venues(venue_documents(spark, sf))


@query("a1_rejected_documents", f"""WITH {B.VENUES_SQL} SELECT CAST("locationId" AS VARCHAR) || '.json' AS file_name
  FROM venues WHERE "locationId" % 47 = 46""")
def _(spark, sf):
    return D.rejected_documents(venue_documents(spark, sf))


def supplier_files(spark, sf):
    """One file per supplier in the shared folder: a venue document, broken JSON, or JSON that is no venue.

    A file costs much more than a row, so the rows are dealt out over the cores, and each task moves its own files to their place.
    """
    path = scratch_path(spark, "documents")
    k = F.col("s_suppkey")
    doc = F.to_json(F.array(F.struct(k.alias("locationId"), F.col("s_name").alias("name"), F.struct(F.col("s_acctbal").alias("rating")).alias("reviewSummary"))))
    value = F.when(k % 47 == 46, "[{broken").when(k % 31 == 30, '{"data": [1]}').when(k % 37 == 36, F.repeat(F.lit(" "), 5000)).otherwise(doc)
    rows = tables.spread_input(B.table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"]), spark.sparkContext.defaultParallelism, "s_suppkey")
    (rows.select(k.alias("id"), value.alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .partitionBy("id").text(path))
    return path


@query("a1_file_scan", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 47 = 46 OR s_suppkey % 31 = 30 OR s_suppkey % 37 = 36 THEN NULL ELSE s_name END AS name,
  CASE WHEN s_suppkey % 47 = 46 THEN 'not JSON' WHEN s_suppkey % 31 = 30 THEN 'no venue in the document' WHEN s_suppkey % 37 = 36 THEN 'longer than 4096 bytes: 5001' END AS error FROM supplier""")
def _(spark, sf):
    docs = D.parsed_venues(D.read_documents(spark, supplier_files(spark, sf), "*.txt", 4096)).withColumn(
        "file_name", F.regexp_extract("path", "id=([0-9]+)", 1).cast("long"))
    good = D.parse_venues(docs.select("file_name", "r")).select(F.col("locationId").alias("id"), "name")
    bad = D.document_errors(docs).select(F.col("file_name").alias("id"), "error")
    return good.join(bad, "id", "full").select("id", "name", "error")


@query("a7_corrupt_shard", f"""WITH {B.SCORED_SQL} SELECT 'sentiment_reviews_part' || CAST(i AS VARCHAR) AS shard, n_rows, i = 3 AS damaged, n_rows AS n_scanned FROM (
  SELECT 0 AS i, count(*) AS n_rows FROM scored WHERE review_id % 3 = 0 UNION ALL SELECT 1, count(*) FROM scored WHERE review_id % 3 <> 2
  UNION ALL SELECT 2, count(*) FROM scored WHERE review_id % 3 <> 0 UNION ALL SELECT 3, 0)""")
def _(spark, sf):
    glob = write_shards(spark, sf, "damaged") + "/sentiment_reviews*"
    # text where a Parquet file is expected
    spark.range(1).select(F.lit("no parquet").alias("value")).write.text(glob.replace("*", "_part3"))
    checked = files.check_shards(spark, glob).groupBy("shard").agg(
        F.sum(F.coalesce("n_rows", F.lit(0))).alias("n_rows"), (F.count("error") > 0).alias("damaged"))
    scanned = tables.shard_counts(tables.read_shards(spark, glob, SENTIMENT_REVIEWS)).withColumnRenamed("n", "n_scanned")
    return checked.join(scanned, "shard", "left").fillna(0, ["n_scanned"])


def menu_documents(spark, sf):
    p = B.parsed_items(spark, sf)
    item = F.struct(F.col("item_title").alias("title_unobsfuscated"), F.col("item_description").alias("description_unobsfuscated"),
                    F.transform("price_texts", lambda t: F.struct(t.alias("priceText_unobsfuscated"))).alias("prices"))
    section = F.struct(F.col("section_title").alias("title_unobsfuscated"), F.array(item).alias("items"))
    menu = F.struct(F.col("menu_title").alias("title_unobsfuscated"), F.array(section).alias("sections"))
    doc = F.array(F.struct("locationId", F.struct(F.struct(F.struct(F.array(menu).alias("menu")).alias("providerMenu"))
                                                  .alias("providerContent")).alias("menu")))
    return p.select(F.concat(F.col("item_id").cast("string"), F.lit(".json")).alias("file_name"), F.to_json(doc).alias("value"))


@query("a2_menu_documents", f"""WITH {B.ITEMS_SQL} SELECT "locationId", menu_title, section_title, item_title, item_description,
  item_price, category FROM items""", doubles="item_price")
def _(spark, sf):
    # parsed once: calibration and classification pass over the items several times
    return M.menu_items(cut_lineage(D.parse_menu(menu_documents(spark, sf))))


def review_documents(spark, sf):
    r = B.reviews(spark, sf, spread=True)
    rev = F.struct(F.col("review_id").alias("id"), "text", F.coalesce(F.col("rating"), F.lit(0)).cast("int").alias("rating"),
                   F.coalesce(F.date_format("publishedDate", "yyyy-MM-dd"), F.lit("not a date")).alias("publishedDate"),
                   "language", "title")
    loc = F.struct("locationId", F.concat(F.lit("V"), F.col("locationId").cast("string")).alias("name"),
                   F.struct(F.array(rev).alias("reviews")).alias("reviewListPage"))
    locations = F.when(F.col("review_id") % 41 != 0, F.array(loc))
    return r.select(F.col("review_id").cast("string").alias("file_name"),
                    F.to_json(F.struct(F.struct(locations.alias("locations")).alias("data"))).alias("value"))


@query("a3_review_documents", f"""WITH {B.REVIEWS_SQL}, stripped AS (
  SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM reviews WHERE review_id % 41 <> 0)
  SELECT "locationId", 'V' || CAST("locationId" AS VARCHAR) AS name, md5(t) AS text_md5, CAST(rating AS INTEGER) AS rating,
  strftime("publishedDate", '%Y-%m-%d') AS published, coalesce(language, 'unknown') AS language, title, review_id
  FROM stripped WHERE length(t) >= 20""")
def _(spark, sf):
    out = D.parse_reviews(review_documents(spark, sf))
    return out.select("locationId", "name", F.md5("text").alias("text_md5"), "rating",
                      F.date_format("publishedDate", "yyyy-MM-dd").alias("published"), "language", "title", "review_id")


@query("a4_first_venues", f"""WITH {B.REVIEWS_SQL} SELECT "locationId", count(*) AS n FROM reviews WHERE "locationId" IN
  (SELECT DISTINCT "locationId" FROM reviews ORDER BY 1 LIMIT 10) GROUP BY 1""")
def _(spark, sf):
    return D.first_venues(B.reviews(spark, sf), "locationId", 10).groupBy("locationId").agg(F.count("*").alias("n"))


@query("a5_table_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", doubles="c_acctbal")
def _(spark, sf):
    return B.table(spark, sf, "customer")


@query("a6_projected_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000", doubles="o_totalprice")
def _(spark, sf):
    return B.table(spark, sf, "orders", ["o_orderkey", "o_totalprice"], F.col("o_totalprice") > 250000)


def write_shards(spark, sf, name):
    """Three overlapping shards of scored reviews in the shared folder.

    A copy in a later shard has another rating, so that it matters which copy is kept.
    """
    base = scratch_path(spark, name)
    s = B.scored(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in SENTIMENT_REVIEWS.fields])
    for i, part in enumerate([s.filter("review_id % 3 = 0"), s.filter("review_id % 3 <> 2"), s.filter("review_id % 3 <> 0")]):
        # review i lies in shard i % 3 first
        part = part.withColumn("rating", F.when(F.col("review_id") % 3 == i, F.col("rating")).otherwise(F.lit(99.0)))
        part.write.parquet(f"{base}/sentiment_reviews_part{i}")
    return base


@query("a7_shard_scan", f"""WITH {B.SCORED_SQL} SELECT review_id, "locationId", rating, sent_stars_expected, is_ironic FROM scored""",
       doubles="rating sent_stars_expected")
def _(spark, sf):
    glob = write_shards(spark, sf, "shards") + "/sentiment_reviews*"
    shards = tables.read_shards(spark, glob, SENTIMENT_REVIEWS)
    return J.keep_one(shards, "review_id", F.asc("shard")).select(
        "review_id", "locationId", "rating", "sent_stars_expected", "is_ironic")


@query("a8_optional_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    there = tables.read_optional(spark, f"{sf}/nation.parquet", T.StructType())
    return there.unionByName(tables.read_optional(spark, f"{sf}/no_such_table.parquet", there.schema))


@query("a9_json_artifact", """SELECT o_orderpriority AS name, avg(o_totalprice) AS value FROM orders GROUP BY 1""", doubles="value")
def _(spark, sf):
    path = scratch_path(spark, "artifact")
    B.table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"]).groupBy(F.col("o_orderpriority").alias("name")) \
        .agg(F.avg("o_totalprice").alias("value")).write.json(path)
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
    return tables.read_json_artifact(spark, path, schema, lines=True)


@query("a10_table_sink", f"""WITH {B.VENUES_SQL} SELECT "locationId", name, rating FROM venues""", doubles="rating")
def _(spark, sf):
    path = scratch_path(spark, "table")
    v = B.venues(spark, sf).select("locationId", "name", "rating")
    sinks.write_table(v, path)
    sinks.write_table(v.limit(0), path, skip_if_exists=True)
    return tables.read_table(spark, path)


@query("a11_csv_sink", f"""WITH {B.VENUES_SQL} SELECT "locationId", name, rating, "reviewCount", "priceLevel", arrondissement, cuisines,
  nb_items_total, shannon_entropy, "hasMichelin", latitude, longitude FROM venues""", doubles="rating shannon_entropy latitude longitude")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    v = B.venues(spark, sf)
    sinks.write_csv(v, path)
    return spark.read.schema(sinks.export_columns(v).schema).option("header", "true").option("escape", '"').csv(path)


DISC = ["name", "rating", "sent_mean", "discordance", "pct_negative", "pct_positive", "n_reviews_scored"]


@query("a12_discordance_export", f"""WITH {B.MERGED_SQL} SELECT name, round(rating,3) AS rating, round(sent_mean,3) AS sent_mean,
  round(discordance,3) AS discordance, round(pct_negative,3) AS pct_negative, round(pct_positive,3) AS pct_positive, n_reviews_scored
  FROM merged WHERE n_reviews_scored >= 2 AND discordance IS NOT NULL""", doubles="rating sent_mean discordance pct_negative pct_positive")
def _(spark, sf):
    path = scratch_path(spark, "discordance")
    export = sinks.discordance_export(B.venue_sentiment(spark, sf), DISC, min_reviews=2)
    sinks.write_csv(export, path, DISC)
    return spark.read.schema(export.schema).option("header", "true").option("escape", '"').csv(path)


@query("a13_preview", f"""WITH {B.VENUES_SQL} SELECT "locationId" AS "ID", name AS "Nom", rating AS "Note" FROM venues
  ORDER BY "locationId" LIMIT 50""", doubles="Note")
def _(spark, sf):
    return sinks.preview(B.venues(spark, sf).select("locationId", "name", "rating"), "locationId", 50,
                         {"locationId": "ID", "name": "Nom", "rating": "Note"})


@query("a14_shard_counts", f"""WITH {B.SCORED_SQL} SELECT 'sentiment_reviews_part' || CAST(i AS VARCHAR) AS shard, n FROM (
  SELECT 0 AS i, count(*) AS n FROM scored WHERE review_id % 3 = 0 UNION ALL SELECT 1, count(*) FROM scored WHERE review_id % 3 <> 2
  UNION ALL SELECT 2, count(*) FROM scored WHERE review_id % 3 <> 0)""")
def _(spark, sf):
    base = write_shards(spark, sf, "counted")
    return tables.shard_counts(tables.read_shards(spark, base + "/sentiment_reviews*", SENTIMENT_REVIEWS))
