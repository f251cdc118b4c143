"""Declared schemas of the tables and of the nested source documents."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(fields: str) -> T.StructType:
    """Schema from ``name type, name type``; needs no running session."""
    pairs = (f.split() for f in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


VENUE_DOCUMENT = (
    "array<struct<locationId:bigint,name:string,"
    "location:struct<geoPoint:struct<latitude:double,longitude:double>,"
    "details:struct<gtmData:struct<locationData:struct<cityName:string,regionName:string>>>>,"
    "cuisines:struct<items:array<struct<tag:struct<localizedName:string>>>>,"
    "neighborhoods:array<struct<neighborhood:struct<name:string>>>,"
    "priceTypes:struct<items:array<struct<secondaryName:string>>>,"
    "restaurantAwards:array<struct<awards:array<struct<award_title:string>>>>,"
    "reviewSummary:struct<rating:double,count:int>,"
    "menu:struct<providerContent:struct<providerMenu:struct<menu:array<struct<"
    "title_unobsfuscated:string,sections:array<struct<title_unobsfuscated:string,"
    "items:array<struct<title_unobsfuscated:string,description_unobsfuscated:string,"
    "prices:array<struct<priceText_unobsfuscated:string>>>>>>>>>>>>>"
)

REVIEW_DOCUMENT = (
    "struct<data:struct<locations:array<struct<locationId:bigint,name:string,"
    "reviewListPage:struct<reviews:array<struct<id:bigint,text:string,rating:int,"
    "publishedDate:string,language:string,title:string>>>>>>>"
)

RESTAURANTS = _struct(
    "locationId long, name string, rating double, reviewCount int, latitude double, "
    "longitude double, cuisines string, neighborhoods string, priceLevel string, "
    "hasMichelin boolean, hasMenu boolean, city string, region string"
)
MENU_ITEMS = _struct(
    "locationId long, menu_title string, section_title string, item_title string, "
    "item_description string, item_price double, category string"
)
ALL_REVIEWS = _struct(
    "locationId long, name string, text string, rating int, publishedDate timestamp, "
    "language string, title string, review_id long"
)
SENTIMENT_REVIEWS = _struct(
    "review_id long, locationId long, rating double, language string, "
    "sent_stars_expected double, sent_class int, sent_confidence double, p_1star double, "
    "p_2star double, p_3star double, p_4star double, p_5star double, is_ironic boolean, "
    "sent_stars_corrected double, sent_class_corrected int"
)
