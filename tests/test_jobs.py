"""Table builds and incremental jobs end to end on files."""

import json

import numpy as np
from pyspark.sql import functions as F

from venuelens.plans import build
from venuelens.schemas import SENTIMENT_REVIEWS
from venuelens.streaming import incremental as I


def venue(i):
    items = [{"title_unobsfuscated": t, "description_unobsfuscated": None, "prices": [{"priceText_unobsfuscated": p}]}
             for t, p in (("Tarte citron", "7,00€"), ("Steak", f"{10 + i},50€"), ("Plateau", "30€"), ("Eau", None))]
    return [{"locationId": i, "name": f"V{i}", "reviewSummary": {"rating": 3.5 + i % 2, "count": 10 * i},
             "location": {"geoPoint": {"latitude": 48.85 + i / 1000, "longitude": 2.35}},
             "cuisines": {"items": [{"tag": {"localizedName": "Bistro"}}]},
             "neighborhoods": [{"neighborhood": {"name": f"{i % 3 + 1}e Arr. - X"}}],
             "priceTypes": {"items": [{"secondaryName": "€€"}]},
             "menu": {"providerContent": {"providerMenu": {"menu": [{"title_unobsfuscated": "Carte", "sections": [{"items": items}]}]}}} if i else None}]


def reviews(i):
    rows = [{"id": 100 * i + k, "text": f"the food was great and the place good {k} " * 2, "rating": 1 + k % 5,
             "publishedDate": f"2024-0{1 + k % 9}-01", "language": "en" if k % 4 else "ja", "title": "t"} for k in range(8)]
    return {"data": {"locations": [{"locationId": i, "name": f"V{i}", "reviewListPage": {"reviews": rows}}]}}


def dump(folder, make, n=6):
    folder.mkdir()
    for i in range(n):
        (folder / f"{i}.json").write_text(json.dumps(make(i)), encoding="utf-8")
    return str(folder)


def test_whole_build(spark, tmp_path):
    out = str(tmp_path / "out")
    t = build.build_venues(spark, dump(tmp_path / "v", venue), out)
    e = {r["locationId"]: r for r in t["restaurants_enriched"].collect()}
    assert len(e) == 6 and t["menu_items"].count() == 20 and t["rejected"].count() == 0
    assert e[0]["nb_items_total"] == 0 and e[1]["nb_items_total"] == 4 and e[1]["arrondissement"] == 2
    assert e[1]["seasonal_hiver"] == 1 and e[1]["nb_restos_500m"] == 5
    got = {(r["item_title"], r["category"]) for r in t["menu_items"].filter("locationId = 1").collect()}
    assert got == {("Tarte citron", "dessert"), ("Steak", "autre"), ("Plateau", "boisson"), ("Eau", "boisson")}

    r = build.build_reviews(spark, dump(tmp_path / "r", reviews), out)
    assert r.count() == 48
    scored, rollup = build.build_sentiment(spark, r, out)
    assert scored.count() == 36 and rollup.count() == 6
    again, _ = build.build_sentiment(spark, r, out)
    assert again.count() == 36
    view = build.select_view(build.load_tables(spark, out), districts=[2])
    assert {x["locationId"] for x in view["merged"].collect()} == {1, 4}
    assert {x["locationId"] for x in view["reviews"].collect()} == {1, 4}
    assert view["menu_items"].count() == 8


def test_build_keeps_finished_tables_and_limits_venues(spark, tmp_path):
    out = str(tmp_path / "out")
    raw = dump(tmp_path / "v", venue)
    first = build.build_venues(spark, raw, out)["restaurants_enriched"].count()
    assert build.build_venues(spark, dump(tmp_path / "v2", venue, 2), out, skip_if_exists=True)["restaurants"].count() == first
    rr = dump(tmp_path / "r", reviews)
    assert build.build_reviews(spark, rr, out + "1", max_venues=2).select("locationId").distinct().count() == 2
    venues = spark.read.parquet(out + "/restaurants_enriched")
    assert build.build_reviews(spark, rr, out + "2", max_venues=4, venues=venues).select("locationId").distinct().count() == 4


def test_sentiment_tables_may_be_absent(spark, tmp_path):
    out = str(tmp_path / "out")
    build.build_venues(spark, dump(tmp_path / "v", venue), out)
    t = build.load_tables(spark, out)
    assert t["sentiment_reviews"].count() == 0 and t["sentiment_v2"].count() == 0


def landed(spark, path, ids):
    spark.createDataFrame([(i, i % 3, f"text number {i}", 2.0, "fr") for i in ids],
                          "review_id long, locationId long, text string, rating double, language string").coalesce(1).write.mode("append").parquet(path)


def test_stream_scores_each_review_once(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    landed(spark, src, range(10))
    schema = spark.read.parquet(src).schema
    run = lambda: I.score_stream(I.file_stream(spark, src, schema, 1), sink, state)
    run()
    assert spark.read.parquet(sink).count() == 10
    run()
    landed(spark, src, [*range(5, 15), 14])
    run()
    ids = sorted(r["review_id"] for r in spark.read.parquet(sink).collect())
    assert ids == list(range(15))


def test_failed_batch_is_repeated_cleanly(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    landed(spark, src, range(6))
    stream = lambda: I.file_stream(spark, src, spark.read.parquet(src).schema)
    calls = []

    def failing(df):
        calls.append(1)
        from venuelens.operators.scoring import score_reviews
        out = score_reviews(df)
        if len(calls) == 1:
            # The batch leaves rows behind and then fails.
            out.limit(3).write.mode("overwrite").parquet(f"{sink}/batch_id=0")
            raise RuntimeError("lost")
        return out

    try:
        I.score_stream(stream(), sink, state, score=failing)
        raise AssertionError("should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    I.score_stream(stream(), sink, state, score=failing)
    assert sorted(r["review_id"] for r in spark.read.parquet(sink).collect()) == list(range(6))


def test_running_rollup(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = [(i, i % 2, 1.0 + i % 5, "fr", 1.0 + i % 4, 1 + i % 5, 0.5, .2, .2, .2, .2, .2, None, None, None) for i in range(20)]
    df = spark.createDataFrame(rows, SENTIMENT_REVIEWS)
    df.filter("review_id < 12").write.parquet(src)
    run = lambda: I.rollup_stream(I.file_stream(spark, src, SENTIMENT_REVIEWS), out, state)
    run()
    assert I.latest_version(spark, out).agg(F.sum("n_reviews_scored")).first()[0] == 12
    df.filter("review_id >= 12").write.mode("append").parquet(src)
    run()
    got = {r["locationId"]: r for r in I.latest_version(spark, out).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("locationId"):
        assert got[k]["n_reviews_scored"] == len(g) and np.isclose(got[k]["sent_std"], g["sent_stars_expected"].std())
