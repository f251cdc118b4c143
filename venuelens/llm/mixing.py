"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, each of at most one block of words. A source has as many slots as its target has blocks, a begun
one included. Slot i lies at the i-th van der Corput point in [0, 1); the source whose share of the cumulative slots holds
that point fills it, until it has all its slots: later points are left out. A source's documents lie in shuffled order, end
to end and once more from the start, and are cut into blocks; its r-th slot takes its r-th block, the last one up to the
target, so that every source meets its target to the word whatever the length of a block.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import chunks_for, map_batches, running, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
REPEATS = 2
#: A source gets about this many slots on average; no block is longer than MAX_BLOCK.
SLOTS_PER_SOURCE = 256
MAX_BLOCK = 1024
POINT_BITS = 53
#: Points a slot: a span of n of the N slots holds n aligned intervals of a length above 1/4N, and 4N points meet each of them.
POINTS = 4
SPACES = r"[^\x20\x09-\x0D]+"
WORD = re.compile(SPACES)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def source_order(sources: DataFrame) -> DataFrame:
    """Sources with their place by code point, NULL last, found part by part without one sorted task."""
    parts = written(sources.repartitionByRange(F.col("source").asc_nulls_last())
                    .withColumn("_part", F.spark_partition_id()), "sources")
    return written(running(parts, [], "_part", [F.col("source").asc_nulls_last()], F.lit(1), "place"), "places")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
            repeats: int = REPEATS) -> DataFrame:
    """Per source (``source``, ``source_size``) its place, weight and target.

    A target stops at ``repeats`` times the size; what exceeds it is shared again by weight among the others
    until none exceeds. Each round is one sum over the sources, and fixes at least one source or ends.
    """
    placed = source_order(sizes)
    # weights repeat over the sorted sources
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    goal = total * share_percent / 100
    level = 0.0
    while True:
        # sources whose cap lies at or below the last level stay at their caps
        fixed = F.col("cap") < level * F.col("weight")
        row = placed.agg(F.sum(F.when(fixed, F.col("cap")).otherwise(0.0)).alias("capped"),
                         F.sum(F.when(fixed, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        fresh = (goal - row.capped) / row.free if row.free else level
        if fresh <= level:
            break
        level = fresh
    return placed.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight")))


def shuffled(docs: DataFrame, seed: int) -> DataFrame:
    """Documents with a start in their source's shuffled order and a number there; hot sources lie in many chunks."""
    chunks = chunks_for(docs.count())
    bits = chunks.bit_length() - 1
    hashed = docs.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))) \
                 .withColumn("_chunk", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    order = [F.col("_h").bitwiseXOR(F.lit(-1 << 63)), F.col("doc_id"), F.col("size"), F.col("text_hash")]
    starts = running(hashed, ["source"], "_chunk", order, F.col("size"), "start")
    return starts.drop("_h", "_chunk")


def schedule(goals: DataFrame) -> DataFrame:
    """Every slot with its source's place and its rank there; a source has ``slots`` of them.

    Points meet the sources by cells of [0, 1), of which a wide source covers many, and then by value.
    """
    spark = goals.sparkSession
    bits = max(8, (2 * goals.count() - 1).bit_length())
    cells = 1 << bits
    summed = running(goals.withColumn("_w", F.col("slots")).withColumn("_part2", (F.col("place") / 4096).cast("int")),
                     [], "_part2", [F.col("place")], F.col("_w"), "_from")
    whole = summed.agg(F.sum("_w")).first()[0]
    n_points = POINTS * whole
    spans = summed.filter("_w > 0").select(
        "place", "slots", F.col("_from"), (F.col("_from") + F.col("_w")).alias("_to"))
    width = -(-whole // cells)
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    # the bits of i in reverse order, as a fraction
    mirrored = F.reverse(F.lpad(F.bin("id"), POINT_BITS, "0"))
    unit = F.conv(mirrored, 2, 10).cast("double") / F.lit(float(1 << POINT_BITS))
    points = (spark.range(n_points).withColumn("_at", F.least(F.floor(unit * F.lit(float(whole))), F.lit(whole - 1)))
              .withColumn("_cell", F.floor(F.col("_at") / width)))
    drawn = (points.join(spans, "_cell").filter((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
             .select(F.col("id").alias("slot"), "place", "slots"))
    chunk = max(64, n_points // chunks_for(n_points))
    return running(drawn.withColumn("_chunk", F.floor(F.col("slot") / chunk)), ["place"], "_chunk", [F.col("slot")],
                   F.lit(1), "block").filter(F.col("block") < F.col("slots")).drop("_chunk", "slots")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None,
        weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS,
        block: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents with size, target and number; pieces of the mix).

    Documents: ``doc_id, source, size, text_hash, source_size, target, place, start``. Pieces, one per document, block and pass that
    overlap: ``slot, place, start, pass, from_word, words``: ``words`` words of the document that starts at ``start``
    in source number ``place``, from its word ``from_word``. The last slot of a source is cut at its target,
    rounded to a word (to one at least). A null or empty text has size 0 and no pieces; a null source is a source of its own, last in order; equal
    rows are documents of their own, told apart by ``start``; an empty table gives two empty ones.
    """
    count = word_count(F.col(f"`{text}`")) if size is None else size
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), count.alias("size"),
                        F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    plain = written(plain, "sizes")
    sums = plain.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sums, weights, share_percent, repeats), "targets")
    keyed = goals.withColumnRenamed("source", "_source")
    placed = written(shuffled(plain, seed).join(keyed, F.col("source").eqNullSafe(F.col("_source")))
                     .select("doc_id", "source", "size", "text_hash", "source_size", "target", "place", "start", "cap"), "placed")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    if block is None:
        block = int(min(MAX_BLOCK, max(1, total / (SLOTS_PER_SOURCE * max(goals.count(), 1)))))
    quota = F.when(F.col("target") > 0, F.greatest(F.round("target"), F.lit(1.0))).otherwise(0.0).cast("long")
    pieces = placed.withColumn("_quota", quota).filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    pieces = pieces.withColumn("_a", F.col("pass") * F.col("source_size") + F.col("start"))
    pieces = pieces.withColumn("_end", F.least(F.col("_a") + F.col("size"), F.col("_quota"))).filter("_a < _end").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_end") - 1) / block))))
    if not total:
        return placed.drop("cap"), pieces.filter(F.lit(False)).select(
            F.col("block").alias("slot"), "place", "start", "pass", F.col("_a").alias("from_word"), F.col("size").alias("words"))
    begin = F.greatest(F.col("block") * block, F.col("_a"))
    end = F.least((F.col("block") + 1) * block, F.col("_end"))
    slots = goals.withColumn("slots", F.ceil(quota / block))
    joined = pieces.join(schedule(slots), ["place", "block"])
    return placed.drop("cap"), joined.select(
        "slot", "place", "start", "pass", (begin - F.col("_a")).alias("from_word"), (end - begin).alias("words"))


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The documents of a mix with ``taken``, the words that it takes of each (repeats counted), and where: ``first_slot``, the first
    slot of the schedule that takes some, and ``n_slots``. A document that no slot takes has no first slot."""
    sums = pieces.groupBy("place", "start").agg(F.sum("words").alias("_taken"), F.min("slot").alias("_first"), F.countDistinct("slot").alias("_slots"))
    # of documents with one start all but one have no words
    words = placed.join(sums, ["place", "start"], "left")
    held = F.col("size") > 0
    return words.withColumns({"taken": F.when(held, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long"), "first_slot": F.when(held, F.col("_first")),
                              "n_slots": F.when(held, F.coalesce("_slots", F.lit(0))).otherwise(0).cast("long")}).drop("_taken", "_first", "_slots")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    last = next(itertools.islice(WORD.finditer(text), n - 1, None))
    return text[:last.end()]


def mixed_documents(docs: DataFrame, placed: DataFrame, pieces: DataFrame, doc_id: str = "doc_id", source: str = "source",
                    text: str = "text") -> DataFrame:
    """The documents of a mix as often as it takes them, with the columns of ``docs``; ``text`` ends behind the last word taken.

    What a pass takes of a document is its beginning. A document of which nothing is taken, or without a word, is left out.
    """
    takes = pieces.groupBy("place", "start", "pass").agg(F.sum("words").alias("_words"))
    keyed = placed.filter("size > 0").join(takes, ["place", "start"]).select(
        F.col("doc_id").alias("__mix_d"), F.col("source").alias("__mix_s"), F.col("text_hash").alias("__mix_h"), F.col("size").alias("__mix_size"), F.col("_words"))
    # rows equal in id, source and text are one row here and bring their takes together
    each = written(keyed.groupBy("__mix_d", "__mix_s", "__mix_h", "__mix_size").agg(F.collect_list("_words").alias("__mix_takes")), "takes")
    own = docs.withColumn("__mix_hash", F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([doc_id, source, "__mix_hash"])
    on = (F.col(f"`{doc_id}`").eqNullSafe(F.col("__mix_d")) & F.col(f"`{source}`").eqNullSafe(F.col("__mix_s"))
          & F.col("__mix_hash").eqNullSafe(F.col("__mix_h")))
    taken = own.join(each, on).withColumn("__mix_take", F.explode("__mix_takes"))
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            own = list(batch.columns)
            size, take = own.pop().to_pylist(), own.pop().to_pylist()
            own[at] = pa.array([t if n == m else first_words(t, m) for t, n, m in zip(own[at].to_pylist(), size, take)], own[at].type)
            yield pa.RecordBatch.from_arrays(own, names=batch.schema.names[:-2])

    return map_batches(taken.select(*[own[f"`{c}`"] for c in docs.columns], "__mix_take", "__mix_size"), run, docs)
