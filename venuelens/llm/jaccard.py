"""N-gram Jaccard join over count vectors.

The shingles of a document are hashed into groups; the counts per group are a point, and the summed coordinate minima of
two points bound the overlap of their sets from above. Points lie in leaves of bounded size; the largest coordinates of a
leaf bound all its points at once. What a bound cannot rule out is verified on the sets.

Which leaves can meet at all follows from prefixes: of two sets with a Jaccard of at least 0.8, ordered alike, the
first fifths share a shingle, and prefixes longer by some shingles share that many. So a document that shares few of its
prefix with any other, and leaves that share few with each other, are ruled out. The order puts frequent shingles
last, by a sketch of fixed size, so that passages many documents share bring no leaves together. Nodes share leaves by their
most frequent prefix shingle, so that a family of near copies fills few leaves whatever its members have changed. Documents of
one set are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import dropped, map_rows, narrow, written
from venuelens.llm.components import components
from venuelens.llm.shingles import lowered_words, shingle_hashes, signed

PERCENT = 80
SKETCH_BITS = 20
SKETCH_ROW = 12
GROUPS = 32
LEAF_NODES = 64
#: Prefixes are longer than needed by this part of the set, three at least, and partners share as many shingles.
EXTRA_PERCENT = 5
EXTRA_LEAST = 3
#: Up to so many documents or nodes (at most 32 bytes each) are broadcast to fetch texts, sets and shingles; beyond, Spark joins them.
BROADCAST_IDS = 1_000_000
PRUNINGS = 2
LEAF_SHINGLES = 50_000


def few(rows: DataFrame) -> DataFrame:
    """Stored narrow rows, broadcast if they are few, so that what is joined with them is not shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(lowered_words(text)))


def node_of(own: np.ndarray) -> int:
    """A 64-bit signature of a set: equal sets are one node."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)))


def fact_rows(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(doc_id, text_hash, node, n_shingles, sketch row, sketch counts): a row per document, then the task's sketch."""
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    shift = np.uint64(64 - SKETCH_BITS)
    for doc_id, text, text_hash in rows:
        own = shingle_set(text)
        np.add.at(counts, (own >> shift).astype(np.int64), 1)
        yield doc_id, text_hash, node_of(own) if len(own) else None, len(own), None, None
    for i, part in enumerate(counts.reshape(1 << SKETCH_ROW, -1)):
        if part.any():
            yield None, None, None, None, i, part.tobytes()


def sketch_ranks(facts: DataFrame) -> np.ndarray:
    """How frequent a shingle's cell is, in powers of two over the mean: one byte per cell, whatever the corpus."""
    parts = facts.filter("cell_row IS NOT NULL").select("cell_row", "cells")
    width = 1 << (SKETCH_BITS - SKETCH_ROW)

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for b in part["cells"]:
            total += np.frombuffer(b.as_py(), np.int32)
        return pa.table({"cell_row": part["cell_row"][:1], "cells": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((1 << SKETCH_ROW, width), np.int64)
    for r in parts.groupBy("cell_row").applyInArrow(add, "cell_row int, cells binary").collect():
        counts[r.cell_row] = np.frombuffer(r.cells, np.int64)
    mean = max(counts.mean(), 1.0)
    return np.clip(np.floor(2 * np.log2(np.maximum(counts.ravel(), 1) / mean)), 0, 255).astype(np.uint8)


def extra(n: int, percent: int = PERCENT) -> int:
    """No more than the overlap that a set of n needs, or its prefix would be longer than the set."""
    return min(-(-percent * n // 100), max(EXTRA_LEAST, -(-EXTRA_PERCENT * n // 100)))


def least_shared(n: str, percent: int):
    """Prefix shingles that a set of ``n`` shares with any partner at least: ``extra`` of the smallest partner."""
    smallest = F.ceil(F.lit(percent) * F.col(n) / 100)
    return F.least(F.ceil(F.lit(percent) * smallest / 100),
                   F.greatest(F.lit(EXTRA_LEAST), F.ceil(F.lit(EXTRA_PERCENT) * smallest / 100)))


def prefix(own: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles, rare ones first, of which a partner shares ``extra`` of the smaller of both sets.

    Of two prefixes one ends first. All shingles of it that the other set holds lie in the other prefix, and
    beyond it the set has too few shingles left to reach the overlap without ``extra`` of them.
    """
    n = len(own) - -(-percent * len(own) // 100) + extra(len(own), percent)
    rank = ranks[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return own[np.argsort(rank, kind="stable")[:n]]


def counts_of(own: np.ndarray) -> np.ndarray:
    return np.bincount((own >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS)


def set_row(node: int, own: np.ndarray) -> tuple:
    return node, len(own), own.tobytes(), counts_of(own).tolist()


def leaf_tables(nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, leaf, root, family) and the leaves of nodes that have a ``home``: leaves hold a bounded number of nodes and shingles.

    A crowded home is dealt out by a hash over as many leaves as it needs. All leaves of a home have its ``family``.
    """
    known = nodes.join(sets.select("node", "n").distinct(), "node")
    load = written(known.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / LEAF_NODES), F.ceil(F.sum("n") / LEAF_SHINGLES))
                                             .alias("_m")), "homes")
    placed = written(known.join(load, "home").select(
        "node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("_m"))).alias("leaf"), "root", "family"), "placed")
    members = sets.join(few(placed), "node").groupBy("leaf").agg(
        F.collect_set(F.struct("node", "root", "hashes")).alias("members"), F.min("n").alias("low_n"), F.max("n").alias("high_n"),
        F.min("family").alias("family"), F.min("root").alias("low_root"), F.max("root").alias("high_root"),
        F.array(*[F.max(F.col("counts")[g]) for g in range(GROUPS)]).alias("high"))
    leaves = written(members, "leaves")
    dropped(load)
    return placed, leaves


def meeting_leaves(shared: DataFrame, placed: DataFrame, leaves: DataFrame, star: bool, percent: int) -> DataFrame:
    """Pairs of leaves that share prefix shingles or a family and pass the bounds; with ``star`` only the first leaf of each shingle.

    The leaves of a family share many shingles, so they meet once by their family and not once by every shingle.
    """
    keyed = written(shared.join(few(placed.select("node", "leaf", "family")), "node").select("key", "leaf", "family").distinct(), "key-leaf")
    if star:
        first = written(keyed.groupBy("key").agg(F.min("leaf").alias("x")), "first")
        pairs = keyed.join(first, "key").select("x", F.col("leaf").alias("y")).filter("x <> y")
    else:
        pairs = (keyed.select("key", F.col("leaf").alias("x"), F.col("family").alias("x_family"))
                 .join(keyed.select("key", F.col("leaf").alias("y"), F.col("family").alias("y_family")), "key")
                 .filter((F.col("x") < F.col("y")) & (F.col("x_family") != F.col("y_family"))).select("x", "y"))
    # every pair with the number of shingles that it shares
    pairs = pairs.groupBy("x", "y").agg(F.count("*").alias("_s"))
    narrow_info = ["leaf", "family", "low_n", "high_n", "low_root", "high_root"]
    sides = [leaves.select(*[F.col(c).alias(side if c == "leaf" else f"{side}_{c}") for c in narrow_info]) for side in "xy"]
    sizes = (100 * F.col("x_high_n") >= percent * F.col("y_low_n")) & (100 * F.col("y_high_n") >= percent * F.col("x_low_n"))
    apart = (F.col("x_low_root") != F.col("x_high_root")) | (F.col("y_low_root") != F.col("y_high_root")) \
        | (F.col("x_low_root") != F.col("y_low_root"))
    enough = F.lit(True) if star else F.col("_s") >= F.greatest(least_shared("x_low_n", percent), least_shared("y_low_n", percent))
    across = pairs.join(sides[0], "x").join(sides[1], "y").filter(enough & sizes & apart)
    # a leaf meets itself, and without ``star`` the others of its family
    of_family = (F.col("x") == F.col("y")) if star else (F.col("x_family") == F.col("y_family")) & (F.col("x") <= F.col("y"))
    inside = sides[0].join(sides[1], of_family & sizes & apart)
    met = across.select("x", "y", "x_low_n", "y_low_n").unionByName(inside.select("x", "y", "x_low_n", "y_low_n"))
    # the wide bounds last, for the pairs that are left
    for side in "xy":
        met = met.join(leaves.select(F.col("leaf").alias(side), F.col("high").alias(f"{side}_high")), side)
    most = F.aggregate(F.zip_with("x_high", "y_high", lambda a, b: F.least(a, b).cast("long")), F.lit(0).cast("long"),
                       lambda s, v: s + v)
    need = F.lit(percent) * (F.col("x_low_n") + F.col("y_low_n"))
    return met.filter((100 + percent) * most >= need).select("x", "y")


class Leaf:
    def __init__(self, members: list[dict]):
        self.nodes = [m["node"] for m in members]
        self.roots = np.array([m["root"] for m in members])
        sets = [np.frombuffer(m["hashes"], np.uint64) for m in members]
        self.n = np.array(list(map(len, sets)))
        self.hashes = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.n)
        self.counts = np.array([counts_of(s) for s in sets])

    def columns(self, common: np.ndarray) -> np.ndarray:
        """Which member holds which of the ``common`` shingles."""
        at = np.searchsorted(common, self.hashes)
        at[at == len(common)] = 0
        hit = common[at] == self.hashes
        out = np.zeros((len(self.nodes), len(common)), np.float32)
        out[self.owner[hit], at[hit]] = 1
        return out


def linked(x: Leaf, y: Leaf, percent: int) -> list[tuple[int, int]]:
    """Index pairs of members in different components whose sets are similar enough."""
    total = x.n[:, None] + y.n[None, :]
    bound = np.minimum(x.counts[:, None, :], y.counts[None, :, :]).sum(2)
    maybe = ((100 + percent) * bound >= percent * total) & (x.roots[:, None] != y.roots[None, :])
    if not maybe.any():
        return []
    common = np.intersect1d(x.hashes, y.hashes)
    if not len(common):
        return []
    overlap = (x.columns(common) @ y.columns(common).T).round().astype(np.int64)
    return list(zip(*np.nonzero(maybe & (100 * overlap >= percent * (total - overlap)))))


def pair_rows(rows: Iterable[tuple], percent: int) -> Iterator[tuple]:
    """Links between the members of two leaves: of each two components that meet there only one."""
    for first, second in rows:
        x = Leaf(first)
        y = Leaf(second)
        above: dict[int, int] = {}

        def top(v):
            while v in above:
                v = above[v]
            return v

        for i, j in linked(x, y, percent):
            a, b = top(int(x.roots[i])), top(int(y.roots[j]))
            if a != b:
                above[max(a, b)] = min(a, b)
                yield x.nodes[i], y.nodes[j]


def leaf_links(pairs: DataFrame, leaves: DataFrame, percent: int) -> DataFrame:
    sides = [leaves.select(F.col("leaf").alias(s), F.col("members").alias(f"{s}_members")) for s in "xy"]
    both = pairs.join(sides[0], "x").join(sides[1], "y").select("x_members", "y_members")

    def run(rows):
        return pair_rows(rows, percent)

    return map_rows(both, run, "a long, b long")


def similar_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document row: the smallest id reachable over sets with a Jaccard of at least
    ``percent`` / 100.

    A null or empty text, or one without a word, has no shingle and is linked with nothing; fewer than five words are one
    shingle. Rows of equal texts are linked whatever their ids; a null id is linked with nothing and its component is
    null. An empty table gives no rows. Other columns are not read. Sets are compared by 64-bit hashes.
    """
    return grouped_rows(docs, doc_id, text, percent).select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def grouped_rows(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Every row with a hash of its text, its shingles, its component's ``root`` (a set) and that component's ``lowest`` id."""
    plain = narrow(docs, doc_id=doc_id, text=text)
    facts = written(map_rows(plain.withColumn("text_hash", F.xxhash64("text")), fact_rows,
                             "doc_id long, text_hash long, node long, n_shingles long, cell_row int, cells binary"), "facts")
    ranks = sketch_ranks(facts)
    own = facts.filter("cell_row IS NULL").select("doc_id", "text_hash", "node", "n_shingles")
    labels = components(set_links(plain, own, ranks, percent))
    rooted = written(own.join(labels, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("root")), "rooted")
    lowest = written(rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("lowest")), "lowest")
    return rooted.join(lowest, "root", "left")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the smallest id, then of the smallest text hash, stays.

    Rows go, not ids: a row that is like no other stays whatever other rows have its id, and of equal rows one stays. Rows without a
    word or without an id are like no other. All columns stay as they are; an empty table gives no rows.
    """
    rows = written(grouped_rows(docs, doc_id, text, percent).filter("root IS NOT NULL").groupBy("root", "doc_id", "text_hash")
                   .agg(F.count("*").alias("n")), "groups")
    best = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    judged = written(rows.join(best, "root").select(F.col("doc_id").alias("__near_d"), F.col("text_hash").alias("__near_h"), "n",
                                                    (F.struct("doc_id", "text_hash") == F.col("best")).alias("stays")), "judged")
    hashed = docs.withColumn("__near_hash", F.xxhash64(F.col(f"`{text}`")))
    on = (F.col(f"`{doc_id}`") == F.col("__near_d")) & (F.col("__near_hash") == F.col("__near_h"))
    left = hashed.join(judged.filter("NOT stays"), on, "left_anti")
    repeated = judged.filter("stays AND n > 1")
    if not repeated.isEmpty():
        # rare: the texts of repeated rows only are shuffled
        left = left.join(repeated, on, "left_anti").unionByName(left.join(repeated, on, "left_semi").dropDuplicates([doc_id, "__near_hash"]))
    return left.drop("__near_hash")


def set_links(plain: DataFrame, own: DataFrame, ranks: np.ndarray, percent: int) -> DataFrame:
    """Links (a, b) between nodes that together give the components of all links."""
    spark = plain.sparkSession
    broadcast = spark.sparkContext.broadcast(ranks)  # 2 ** SKETCH_BITS bytes

    def prefixes(rows):
        done: set[int] = set()
        for doc_id, text in rows:
            one = shingle_set(text)
            if doc_id is not None and len(one) and (node := node_of(one)) not in done:
                done.add(node)
                for key in signed(prefix(one, broadcast.value, percent)).tolist():
                    yield key, node

    keys = written(map_rows(plain, prefixes, "key long, node long"), "prefixes")
    # copies in several tasks make a key look shared; the prunings below tell
    several = written(keys.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"), "several")
    shared = written(keys.join(several, "key", "left_semi").distinct(), "shared")
    dropped(keys, several)
    sizes = written(own.filter("node IS NOT NULL").select("node", "n_shingles").distinct(), "sizes")
    for _ in range(PRUNINGS):
        good = written(shared.groupBy("node").agg(F.count("*").alias("_s")).join(sizes, "node")
                       .filter(F.col("_s") >= least_shared("n_shingles", percent)).select("node"), "good")
        left = written(shared.join(few(good), "node", "left_semi"), "left")
        dropped(shared, good)
        several = written(left.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b"), F.count("*").alias("often"))
                          .filter("_a < _b").select("key", "often"), "several")
        shared = written(left.select("key", "node").join(several, "key"), "shared")
        dropped(left, several)
    # the home is the shingle of the most nodes: a family of near copies fills leaves, whichever shingles its members have changed
    nodes = written(shared.groupBy("node").agg(F.max(F.struct("often", "key")).alias("top")).select("node", F.col("top.key").alias("home")),
                    "nodes")
    stored, shared = shared, shared.select("key", "node")
    # one document per node gives its set; the ids are broadcast if they are few enough
    wanted = few(written(own.join(nodes.select("node"), "node", "left_semi").filter("doc_id IS NOT NULL").groupBy("node")
                     .agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "wanted"))

    def sets_of(rows):
        for _, text in rows:
            one = shingle_set(text)
            if len(one):
                yield set_row(node_of(one), one)

    sets = map_rows(plain.join(wanted, "doc_id", "left_semi"), sets_of, "node long, n int, hashes binary, counts array<int>")
    # repeated rows give a set twice, and rows that repeat an id other sets: the leaves fold the ones and join none of the others
    sets = written(sets, "sets")
    # large families first: of their leaves each meets itself and the first of a shingle, so that most members are linked
    crowded = shared.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > LEAF_NODES).select("key")
    dense = written(shared.join(crowded, "key", "left_semi"), "dense")
    inside = dense.select("node").distinct()
    alone = nodes.join(inside, "node", "left_semi").withColumn("root", F.col("node")).withColumn("family", F.col("home"))
    placed, leaves = leaf_tables(alone, sets)
    first = written(leaf_links(meeting_leaves(dense, placed, leaves, True, percent), leaves, percent), "links")
    dropped(dense, placed, leaves)
    roots = components(first)
    # members of a component found so far are a family with leaves of its own, which meet only others; single nodes share leaves
    by_root = nodes.join(roots, "node", "left").select(
        "node", F.when(F.col("root").isNull(), F.col("home")).otherwise(F.xxhash64("home", "root")).alias("home"),
        F.coalesce("root", "node").alias("root"), F.coalesce("root", "home").alias("family"))
    placed, leaves = leaf_tables(by_root, sets)
    second = written(leaf_links(meeting_leaves(shared, placed, leaves, False, percent), leaves, percent), "links")
    dropped(stored, sizes, nodes, sets, placed, leaves)
    return first.unionByName(second)
