"""Files as rows, and streams whose state and reads stay bounded."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from venuelens.plans import build, q_incremental, q_sources
from venuelens.schemas import SENTIMENT_REVIEWS
from venuelens.sources import documents, files, tables
from venuelens.streaming import ids, incremental


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_listing_and_texts_with_reasons(spark, tmp_path):
    put(tmp_path / "d" / "a.json", b'[{"locationId": 1, "name": "A"}]')
    put(tmp_path / "d" / "b.json", b"[{broken")
    put(tmp_path / "d" / "c.json", b"[]")
    put(tmp_path / "d" / "d.json", b"\xff\xfe[1]")
    put(tmp_path / "d" / "e.json", b"[" + b" " * 500 + b"]")
    put(tmp_path / "d" / "f.json", b'{"locationId": 3}')
    put(tmp_path / "d" / "g.txt", b"not asked for")
    listed = {os.path.basename(r.path): r.length for r in files.list_files(spark, str(tmp_path / "d")).collect()}
    assert listed["a.json"] == 32 and len(listed) == 7
    docs = documents.read_documents(spark, str(tmp_path / "d"), max_bytes=100)
    errors = {r.file_name: r.error for r in documents.document_errors(docs).collect()}
    assert errors == {"b.json": "not JSON", "c.json": "no venue in the document", "d.json": "not UTF-8", "e.json": "longer than 100 bytes: 502",
                      "f.json": "no venue in the document"}
    assert [r.name for r in documents.parse_venues(docs).collect()] == ["A"]
    assert files.list_files(spark, str(tmp_path / "absent*")).collect() == []
    assert documents.read_documents(spark, str(tmp_path / "absent")).collect() == []


def test_files_of_one_split_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(60).selectExpr("id AS s_suppkey", "'S' || id AS s_name", "CAST(id AS DOUBLE) AS s_acctbal")
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    written = glob.glob(q_sources.supplier_files(spark, str(tmp_path)) + "/id=*/part-*.txt")
    assert len(written) == 60
    assert len({os.path.basename(w).split("-")[1] for w in written}) > 1


def test_damaged_pages_and_texts_are_reported_per_file(spark, tmp_path):
    base = str(tmp_path / "sentiment_reviews")
    for part in range(3):
        spark.range(2000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(f"{base}_{part}")
    broken = glob.glob(f"{base}_1/*.parquet")[0]
    data = bytearray(open(broken, "rb").read())
    data[len(data) // 3:len(data) // 3 + 2000] = b"\0" * 2000  # the footer stays sound
    open(broken, "wb").write(data)
    assert [r.error for r in files.unreadable_shards(files.check_shards(spark, base + "_1")).collect()] == ["cannot be read"]
    # without the file system's own checksums the page itself is found broken
    for crc in glob.glob(f"{base}_1/.*.crc"):
        os.remove(crc)
    put(tmp_path / "sentiment_reviews_2" / "part-9.parquet", b"no parquet")
    checked = files.check_shards(spark, base + "*")
    assert {(r.shard, r.n_rows) for r in checked.filter("error is null").collect()} == {("sentiment_reviews_0", 2000), ("sentiment_reviews_2", 2000)}
    bad = files.unreadable_shards(checked).collect()
    assert sorted(r.shard for r in bad) == ["sentiment_reviews_1", "sentiment_reviews_2"] and all(r.error for r in bad)
    long = files.check_shards(spark, base + "_0", max_bytes=10).collect()
    assert [(r.n_rows, r.error.startswith("longer than 10 bytes")) for r in long] == [(None, True)]


def test_build_publishes_unreadable_shards_and_samples(spark, tmp_path):
    out = str(tmp_path / "out")
    reviews = spark.createDataFrame([(i, i % 3, f"a long enough text number {i}", 2.0, "fr") for i in range(40)],
                                    "review_id long, locationId long, text string, rating double, language string")
    merged, _ = build.build_sentiment(spark, reviews, out, sample=15)
    assert merged.count() == 15
    put(tmp_path / "out" / "sentiment_reviews_part00007" / "x.parquet", b"no parquet")
    merged, _ = build.build_sentiment(spark, reviews, out)
    assert merged.count() == 40
    assert [r.shard for r in spark.read.parquet(f"{out}/unreadable_shards").collect()] == ["sentiment_reviews_part00007"]


def test_ids_are_read_from_their_own_ranges_only(spark, tmp_path):
    index = str(tmp_path / "ids")
    for batch in range(6):
        ids.remember(spark.range(batch * 100, batch * 100 + 100), index, "id", batch, width=100)
    new = spark.range(250, 350)
    left = ids.without_known(new, index, "id", 9, width=100)
    assert left.count() == 0
    read = [f for f in left.inputFiles() if index in f]
    # two ranges of six, whatever the number of batches
    assert {f.split("range=")[1].split("/")[0] for f in read} == {"2", "3"}
    # a batch does not see its own earlier attempt
    assert ids.without_known(new, index, "id", 3, width=100).count() == 50
    text = spark.createDataFrame([("a",), ("b",)], "k string")
    ids.remember(text.limit(1), str(tmp_path / "names"), "k", 0)
    assert [r.k for r in ids.without_known(text, str(tmp_path / "names"), "k", 1).collect()] == ["b"]
    assert ids.without_known(text.limit(0), str(tmp_path / "names"), "k", 1).count() == 0


def scores(spark, rows):
    full = [(i, venue, rating, "fr", stars, cls, 0.5, .2, .2, .2, .2, .2, None, None, None) for i, venue, stars, rating, cls in rows]
    return spark.createDataFrame(full, SENTIMENT_REVIEWS)


def test_running_rollup_merges_changed_parts_and_keeps_no_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "VENUES_PER_PART", 10)
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rng = np.random.default_rng(1)
    rows = [(i, int(v), float(s), None if i % 7 == 0 else float(i % 5 + 1), int(c))
            for i, (v, s, c) in enumerate(zip(rng.integers(0, 40, 600), rng.uniform(1, 5, 600), rng.integers(1, 6, 600)))]
    batches = [rows[:300], rows[250:400] + rows[250:260], [r for r in rows[400:] if r[1] < 10], rows[400:]]
    for b in batches:
        scores(spark, b).coalesce(1).write.mode("append").parquet(src)
        before = {v: set(glob.glob(f"{out}/parts/part={v}/version=*")) for v in range(4)}
        incremental.rollup_stream(incremental.file_stream(spark, src, SENTIMENT_REVIEWS), out, state)
    got = {r.locationId: r for r in incremental.latest_version(spark, out).collect()}
    pdf = scores(spark, rows).toPandas()
    for venue, g in pdf.groupby("locationId"):
        r = got[venue]
        assert r.n_reviews_scored == len(g) and np.isclose(r.sent_mean, g.sent_stars_expected.mean())
        assert np.isclose(r.sent_std, g.sent_stars_expected.std()) and np.isclose(r.pct_positive, 100 * (g.sent_class >= 4).mean())
        assert np.isclose(r.rating_mean_reviews, g.rating.mean())
        below = (g.sent_stars_expected < r.median_expected).mean()
        assert abs(below - 0.5) <= 0.01 + 1 / len(g)
    # the last batch held nothing new of venues below 10: their part stays as it was
    after = {v: set(glob.glob(f"{out}/parts/part={v}/version=*")) for v in range(4)}
    assert [len(after[v] - before[v]) for v in range(4)] == [0, 1, 1, 1]
    assert not glob.glob(f"{state}/state/*")
    assert tables.path_exists(spark, f"{out}/ids/range=0")


def test_a_repeated_batch_replaces_its_first_attempt(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    scores(spark, [(i, i % 3, 2.0, 3.0, 2) for i in range(30)]).coalesce(1).write.parquet(src)
    run = lambda state: incremental.rollup_stream(incremental.file_stream(spark, src, SENTIMENT_REVIEWS), out, str(tmp_path / state))
    run("a")
    # a lost checkpoint: batch 0 arrives again and must not count twice
    run("b")
    assert incremental.latest_version(spark, out).agg(F.sum("n_reviews_scored")).first()[0] == 30


def test_running_table_needs_a_version(spark, tmp_path):
    with pytest.raises(ValueError):
        incremental.latest_version(spark, str(tmp_path / "none"))


def test_more_files_land_where_more_splits_are_read(spark, tmp_path):
    docs = spark.range(200).selectExpr("id AS doc_id", "'a good text ' || id AS text", "'en' AS lang", "'web' AS source")
    docs.repartition(40).write.parquet(str(tmp_path / "documents.parquet"))
    path, _, n = q_incremental._landed_reviews(spark, str(tmp_path), copies=True)
    landed = glob.glob(path + "/part-*.parquet")
    assert len(landed) == n > 4
    rows = spark.read.parquet(path).groupBy("review_id").count().collect()
    assert {r["review_id"]: r["count"] for r in rows} == {i: 1 + (i % 5 == 0) for i in range(200)}


def test_menus_are_parsed_after_they_are_dealt_out(spark):
    texts = ["""[{"locationId": 1, "menu": {"providerContent": {"providerMenu": {"menu": [null, {"title_unobsfuscated": "M", "sections": [
               {"items": []}, null, {"title_unobsfuscated": "S", "items": [null, {"title_unobsfuscated": "I", "prices": []}]}]}, {"sections": null}]}}}}]""",
             """[{"locationId": 2, "menu": {"providerContent": {"providerMenu": {"menu": []}}}}]""", "[{broken"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, value string")
    found = documents.parse_menu(docs)
    assert [(r.locationId, r.menu_title, r.section_title, r.item_title) for r in found.orderBy("item_title").collect()] == [
        (1, "M", "S", ""), (1, "M", "S", "I")]
    dealt = spark.createDataFrame(docs.collect(), docs.schema).repartition(4, "id")
    plan = documents.parse_menu(dealt)._jdf.queryExecution().optimizedPlan().toString()
    before, after = plan.split("RepartitionByExpression")
    assert "from_json" in before and "from_json" not in after
