"""Nested JSON documents (one file per venue) to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens import schemas
from venuelens.functions import scalars as S
from venuelens.sources import files


def read_documents(spark: SparkSession, directory: str, pattern: str = "*.json", max_bytes: int = files.MAX_BYTES) -> DataFrame:
    """One row per file: its path and name, its whole text, and why there is none where it is too long or no text."""
    return files.read_texts(spark, directory, pattern, max_bytes)


def parsed_venues(docs: DataFrame) -> DataFrame:
    """Element 0 of the top-level array as ``r``; NULL for unreadable documents and for a top-level object."""
    first = F.get(F.from_json("value", schemas.VENUE_DOCUMENT), F.lit(0))
    return docs if "r" in docs.columns else docs.withColumn("r", F.when(F.col("value").rlike(r"^\s*\["), first))


def rejected_documents(docs: DataFrame) -> DataFrame:
    return parsed_venues(docs).filter(F.col("r").isNull()).select("file_name")


def document_errors(docs: DataFrame) -> DataFrame:
    """Name of every document without a venue, and why: the file's own error, no JSON, or JSON without a venue in it."""
    parsed = parsed_venues(docs)
    known = F.col("error") if "error" in parsed.columns else F.lit(None).cast("string")
    # a document that was stored parsed has lost its text
    sound = F.try_parse_json("value").isNotNull() if "value" in parsed.columns else F.lit(True)
    return parsed.filter(F.col("r").isNull()).select(
        "file_name", F.coalesce(known, F.when(sound, "no venue in the document").otherwise("not JSON")).alias("error"))


def parse_venues(docs: DataFrame) -> DataFrame:
    """The 13 venue fields of every readable document."""
    r = "r."
    cuisines = F.transform("r.cuisines.items", lambda i: i["tag"]["localizedName"])
    quarters = F.transform("r.neighborhoods", lambda n: n["neighborhood"]["name"])
    michelin = F.exists("r.restaurantAwards", lambda a: F.coalesce(
        F.get(a["awards"], F.lit(0))["award_title"] == "MICHELIN", F.lit(False)))
    menu = F.col("r.menu.providerContent.providerMenu.menu")
    has_menu = F.exists(menu, lambda m: F.coalesce(
        F.exists(m["sections"], lambda s: F.coalesce(F.size(s["items"]) > 0, F.lit(False))), F.lit(False)))
    return parsed_venues(docs).filter(F.col("r").isNotNull()).select(
        F.col(r + "locationId").alias("locationId"), F.col(r + "name").alias("name"),
        F.col("r.reviewSummary.rating").alias("rating"),
        F.coalesce("r.reviewSummary.count", F.lit(0)).alias("reviewCount"),
        F.col("r.location.geoPoint.latitude").alias("latitude"),
        F.col("r.location.geoPoint.longitude").alias("longitude"),
        S.join_labels(cuisines).alias("cuisines"), S.join_labels(quarters).alias("neighborhoods"),
        F.get("r.priceTypes.items", F.lit(0))["secondaryName"].alias("priceLevel"),
        F.coalesce(michelin, F.lit(False)).alias("hasMichelin"),
        F.coalesce(has_menu, F.lit(False)).alias("hasMenu"),
        F.col("r.location.details.gtmData.locationData.cityName").alias("city"),
        F.col("r.location.details.gtmData.locationData.regionName").alias("region"))


def parse_menu(docs: DataFrame) -> DataFrame:
    """One row per menu item with all its price texts; empty levels give no rows."""
    item = F.col("i")
    # outer, as Spark tests what a plain explode reads for emptiness as early as it can: there all documents would be parsed
    # once more, before they are dealt out. Levels without elements have no place.
    menus = parsed_venues(docs).select(F.col("r.locationId").alias("locationId"),
                                       F.posexplode_outer("r.menu.providerContent.providerMenu.menu").alias("p", "m")).filter("p IS NOT NULL")
    sections = menus.select("locationId", F.coalesce("m.title_unobsfuscated", F.lit("")).alias("menu_title"),
                            F.posexplode_outer("m.sections").alias("p", "s")).filter("p IS NOT NULL")
    return (sections.select("locationId", "menu_title", F.nullif("s.title_unobsfuscated", F.lit("")).alias("section_title"),
                            F.posexplode_outer("s.items").alias("p", "i")).filter("p IS NOT NULL")
            .select("locationId", "menu_title", "section_title",
                    F.coalesce(item["title_unobsfuscated"], F.lit("")).alias("item_title"),
                    F.coalesce(item["description_unobsfuscated"], F.lit("")).alias("item_description"),
                    F.transform(item["prices"], lambda p: p["priceText_unobsfuscated"]).alias("price_texts")))


def parse_reviews(docs: DataFrame, min_text_length: int = 20) -> DataFrame:
    """Reviews of the first location of every document whose stripped text is long enough."""
    loc = F.get(F.from_json("value", schemas.REVIEW_DOCUMENT)["data"]["locations"], F.lit(0))
    rev = F.col("v")
    rows = (docs.select(loc.alias("l")).filter(F.col("l").isNotNull())
            .select(F.col("l.locationId").alias("locationId"), F.col("l.name").alias("name"),
                    F.explode("l.reviewListPage.reviews").alias("v")))
    return (rows.select("locationId", "name", strip(rev["text"]).alias("text"),
                        F.nullif(rev["rating"], F.lit(0)).alias("rating"),
                        F.try_to_timestamp(rev["publishedDate"]).alias("publishedDate"),
                        F.coalesce(rev["language"], F.lit("unknown")).alias("language"),
                        rev["title"].alias("title"), rev["id"].alias("review_id"))
            .filter(F.length("text") >= min_text_length))


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_venues(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first n venues in key order."""
    chosen = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(chosen, key, "left_semi")
