"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt into shards of bounded size. A shard's graph has layers, each a sixteenth of the one below; in a layer
every vector is linked to diverse near vectors among those before it, and back. All vectors search all shards in blocks:
from the small top layer down, with a beam of ``ef`` vectors, many queries in step. A beam that is full of links widens until
it is not. Audits compare a bounded set of queries with brute force and widen ``ef`` until enough links are found. Found
pairs are verified by their cosine in double precision, and components are united. Equal vectors are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from venuelens.llm.common import map_rows, schema_of, written
from venuelens.llm.components import components

COSINE = 0.95
SHARDS = 8
SHARD_ROWS = 16_384
BLOCK_ROWS = 256
PART_ROWS = 8_192
LINKS = 8
CANDIDATES = 48
TOP_ROWS = 64
FIRST_EF = 64
AUDIT_ROWS = 512
AUDIT_RECALL = 0.99
SLACK = 1e-4


def top_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of every row, largest first."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)


def diverse(near: np.ndarray, sims: np.ndarray, x: np.ndarray, links: int) -> np.ndarray:
    """Of candidates (nearest first, -1 for none) those not nearer to a chosen one than to the vector; then the nearest rest."""
    vectors = x[np.maximum(near, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    rows, width = near.shape
    chosen = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -2.0)
    for c in range(width):
        take = (near[:, c] >= 0) & (closest[:, c] < sims[:, c]) & (chosen.sum(1) < links)
        chosen[:, c] = take
        closest[take] = np.maximum(closest[take], between[take, c])
    rank = np.where(near < 0, 2, np.where(chosen, 0, 1)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :links]
    return np.take_along_axis(near, order, 1)


def link_layer(x: np.ndarray) -> np.ndarray:
    """Neighbours (-1 padded) of the vectors of one layer, linked in their order."""
    n = len(x)
    forward = np.full((n, LINKS), -1, np.int32)
    for start in range(1, n, 512):
        stop = min(start + 512, n)
        sims = x[start:stop] @ x[:stop].T
        sims[np.arange(stop) >= np.arange(start, stop)[:, None]] = -2
        near = top_k(sims, CANDIDATES)
        value = np.take_along_axis(sims, near, 1)
        near = np.where(value > -2, near, -1)
        chosen = diverse(near, value, x, LINKS)
        forward[start:stop, :chosen.shape[1]] = chosen
    # links back: the nearest of those that chose a vector, and the diverse ones among them
    source, slot = np.nonzero(forward >= 0)
    target = forward[source, slot]
    sims = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-sims, target))
    source, target, sims = source[order], target[order], sims[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    near = np.full((n, CANDIDATES), -1, np.int32)
    value = np.full((n, CANDIDATES), -2.0)
    ok = place < CANDIDATES
    near[target[ok], place[ok]], value[target[ok], place[ok]] = source[ok], sims[ok]
    back = np.concatenate([diverse(near[i:i + 512], value[i:i + 512], x, LINKS) for i in range(0, n, 512)]) if n else near
    return np.concatenate([forward, back.astype(np.int32)], axis=1)


class Graph:
    """The layers of one shard. ``x`` are unit vectors in double precision, in the order of linking."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.ids, self.x, self.small = ids, x, x.astype(np.float32)
        self.layers = layers if layers is not None else self.build()

    def build(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(members, neighbours) from the lowest layer up; the top one is small enough to be compared whole."""
        members = np.arange(len(self.ids), dtype=np.int32)
        layers = []
        while True:
            local = link_layer(self.small[members])
            layers.append((members, np.where(local >= 0, members[np.maximum(local, 0)], -1).astype(np.int32)))
            if len(members) <= TOP_ROWS:
                return layers
            members = members[::16]

    def search(self, q: np.ndarray, ef: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query number, vector number) of all pairs found with a similarity of ``least`` or more."""
        small = q.astype(np.float32)
        members = self.layers[-1][0]
        sims = small @ self.small[members].T
        beam = members[top_k(sims, 8)]
        for level in range(len(self.layers) - 2, -1, -1):
            members, near = self.layers[level]
            place = np.full(len(self.x), -1, np.int32)
            place[members] = np.arange(len(members))
            beam, value = self.beam(small, beam, place, near, ef if level == 0 else 16, least if level == 0 else None)
        if len(self.layers) == 1:
            rows, at = np.nonzero(sims >= least)
            return rows, members[at]
        return np.concatenate(beam), np.concatenate(value)

    def beam(self, q, entry, place, near, ef, least):
        """Beam search of all queries in step. Without ``least`` the 8 best per query; with it lists of pairs."""
        n = len(q)
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, ef), -1, np.int32)
        sims = np.full((n, ef), -2, np.float32)
        width = min(entry.shape[1], ef)
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.einsum("ijk,ik->ij", self.small[ids[:, :width]], q)
        np.put_along_axis(seen, entry, True, 1)
        open_ = sims > -2
        seen_flat = seen.reshape(-1)
        mark = np.empty(seen.size, np.int32)
        found_q, found_v = [], []
        rows = np.arange(n)
        while len(rows):
            score = np.where(open_, sims, -3)
            pick = top_k(score, 4)
            good = np.take_along_axis(score, pick, 1) > -3
            live = good.any(1)
            if not live.all():
                # finished queries leave; beams full of links stay and widen
                full = np.zeros(len(rows), bool) if least is None else ~live & (sims.min(1) >= least)
                done = ~live & ~full
                if least is None:
                    if done.any():
                        found_q.append((rows[done], np.take_along_axis(ids[done], top_k(sims[done], 8), 1)))
                elif done.any():
                    r, c = np.nonzero(sims[done] >= least)
                    found_q.append(rows[done][r])
                    found_v.append(ids[done][r, c])
                keep = ~done
                rows, ids, sims, open_, q = rows[keep], ids[keep], sims[keep], open_[keep], q[keep]
                pick, good, full = pick[keep], good[keep], full[keep]
                if full.any() and ids.shape[1] < len(self.x) + 4:
                    more = ids.shape[1]
                    ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
                    sims = np.pad(sims, ((0, 0), (0, more)), constant_values=-2)
                    open_ = np.pad(open_, ((0, 0), (0, more)))
                    # what the narrow beam dropped may hold links: all members expand again over unseen vectors only
                    open_[full, :more] = True
                    seen[rows[full]] = False
                    wide, at = np.nonzero(ids[full] >= 0)
                    seen[rows[full][wide], ids[full][wide, at]] = True
                    continue
                if not len(rows):
                    break
            np.put_along_axis(open_, pick, np.take_along_axis(open_, pick, 1) & ~good, 1)
            at = np.where(good, place[np.maximum(np.take_along_axis(ids, pick, 1), 0)], -1)
            around = np.where((at >= 0)[:, :, None], near[np.maximum(at, 0)], -1).reshape(len(rows), -1)
            r, c = np.nonzero(around >= 0)
            v = around[r, c]
            flat = rows[r] * len(self.x) + v
            fresh = ~seen_flat[flat]
            r, v, flat = r[fresh], v[fresh], flat[fresh]
            # of equal entries the last one written stays
            mark[flat] = np.arange(len(flat), dtype=np.int32)
            once = mark[flat] == np.arange(len(flat))
            r, v, flat = r[once], v[once], flat[once]
            seen_flat[flat] = True
            value = np.einsum("ij,ij->i", self.small[v], q[r])
            size = np.bincount(r, minlength=len(rows))
            slot = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
            extra = int(size.max(initial=0))
            if not extra:
                continue
            new_ids = np.full((len(rows), extra), -1, np.int32)
            new_sims = np.full((len(rows), extra), -2, np.float32)
            new_ids[r, slot], new_sims[r, slot] = v, value
            ids = np.concatenate([ids, new_ids], 1)
            sims = np.concatenate([sims, new_sims], 1)
            open_ = np.concatenate([open_, new_sims > -2], 1)
            k = ids.shape[1] - extra
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            ids, sims, open_ = (np.take_along_axis(a, best, 1) for a in (ids, sims, open_))
        if least is None:
            out = np.zeros((n, min(8, ef)), np.int32)
            for r, v in found_q:
                out[r] = v
            return out, None
        return (found_q or [np.zeros(0, np.int64)]), (found_v or [np.zeros(0, np.int32)])


def pairs_above(graph: Graph, q_ids: np.ndarray, q: np.ndarray, ef: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of verified pairs (query, vector), without a vector and itself."""
    rows, at = graph.search(q, ef, cosine - SLACK)
    exact = np.einsum("ij,ij->i", q[rows], graph.x[at])
    ok = (exact >= cosine) & (q_ids[rows] != graph.ids[at])
    return q_ids[rows[ok]], graph.ids[at[ok]]


def audit(graph: Graph, q_ids: np.ndarray, q: np.ndarray, cosine: float) -> tuple[int, int, int]:
    """(``ef`` that finds enough of the links brute force finds, links there are, links found)."""
    true = np.nonzero((q @ graph.x.T >= cosine) & (q_ids[:, None] != graph.ids[None, :]))[0].size
    ef = FIRST_EF
    while True:
        found = len(pairs_above(graph, q_ids, q, ef, cosine)[0])
        if found >= AUDIT_RECALL * true or ef >= len(graph.ids):
            return ef, true, found
        ef += ef // 2


def unit(raw: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Stored doubles as unit vectors."""
    x = np.array([np.frombuffer(b.as_py(), np.float64) for b in raw]).reshape(len(raw), dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def vector_rows(rows) -> Iterator[tuple]:
    """(vec_id, node, dim, doubles) of usable vectors; equal directions are found by the search, equal vectors are a node."""
    import xxhash
    for vec_id, values in rows:
        raw = None
        if values is not None and len(values) and None not in values:
            x = np.array(values, np.float64)
            if np.isfinite(x).all() and x.any():
                raw = (x + 0.0).tobytes()
        node = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw)).view(np.int64))) if raw and vec_id is not None else None
        yield vec_id, node, len(values) if node is not None else None, raw if node is not None else None


def shard_graphs(nodes: DataFrame, shards: int) -> DataFrame:
    """One graph per dimension and shard: a group is a shard, of bounded size."""
    def build(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        part = part.sort_by("node")
        ids = part["node"].to_numpy()
        g = Graph(ids, unit(part["raw"], dim))
        return pa.table({"dim": part["dim"][:1], "shard": part["shard"][:1], "ids": pa.array([ids.tobytes()], pa.binary()),
                         "x": pa.array([g.x.tobytes()], pa.binary()),
                         "layers": pa.array([[a.tobytes() for layer in g.layers for a in layer]], pa.list_(pa.binary()))})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInArrow(
        build, "dim int, shard int, ids binary, x binary, layers array<binary>"), "graphs")


def stored_graph(row: pa.Table) -> Graph:
    dim = row["dim"][0].as_py()
    parts = [np.frombuffer(b, np.int32) for b in row["layers"][0].as_py()]
    layers = [(m, near.reshape(len(m), -1)) for m, near in zip(parts[::2], parts[1::2])]
    return Graph(np.frombuffer(row["ids"][0].as_py(), np.int64), np.frombuffer(row["x"][0].as_py(), np.float64).reshape(-1, dim), layers)


def search_shards(graphs: DataFrame, queries: DataFrame, shards: int, parts: int, work, schema: str) -> DataFrame:
    """``work(graph, ids, vectors)`` for every shard and every part of the queries.

    A task holds one graph and one part, both of bounded size; queries are sent to every shard, graphs to every part.
    """
    target = to_arrow_schema(schema_of(schema))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        graph = stored_graph(left)
        ids, q = right["node"].to_numpy(), unit(right["raw"], left["dim"][0].as_py())
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(work(graph, ids, q), target)], schema=target)

    sent = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = (queries.withColumn("part", F.pmod(F.xxhash64("node", F.lit(8)), F.lit(parts)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    keys = ["dim", "shard", "part"]
    return sent.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, schema)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                 shards: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    A vector that is null, empty, zero or has a null or non-finite component, or no id, links with nothing. Vectors of
    different lengths are not compared. Equal vectors are linked with each other and share all links; rows count each.
    A null id has a null component and is kept. An empty table gives no rows. Other columns are not read.
    """
    plain = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("values"))
    rows = written(map_rows(plain, vector_rows, "vec_id long, node long, dim int, raw binary"), "vectors")
    used = rows.filter("node IS NOT NULL")
    nodes = written(used.groupBy("node").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count("*").alias("copies")),
                    "nodes")
    count = nodes.count()
    shards = shards or max(SHARDS, -(-count // SHARD_ROWS))
    parts = max(1, -(-count // PART_ROWS))
    graphs = shard_graphs(nodes.select("node", "dim", "raw"), shards)
    ef = FIRST_EF
    asked = nodes.select("node", "dim", "raw")
    sample = asked.orderBy(F.xxhash64("node", F.lit(9)), "node").limit(AUDIT_ROWS)

    def check(graph, ids, q):
        return [[v] for v in audit(graph, ids, q, cosine)]

    audits = search_shards(graphs, sample, shards, 1, check, "ef int, links int, found int").collect()
    ef = max([FIRST_EF, *(a.ef for a in audits)])

    def find(graph, ids, q):
        found = [pairs_above(graph, ids[i:i + BLOCK_ROWS], q[i:i + BLOCK_ROWS], ef, cosine) for i in range(0, len(ids), BLOCK_ROWS)]
        a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        return np.minimum(a, b), np.maximum(a, b)

    links = written(search_shards(graphs, asked, shards, parts, find, "a long, b long").distinct(), "links")
    copies = nodes.select("node", "copies")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = (ends.join(copies.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
              .withColumnRenamed("a", "node"))
    roots = components(links)
    known = written(copies.join(linked, "node", "left").join(roots, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    member = written(rows.select("vec_id", "node").join(known, "node", "left"), "members")
    lowest = written(member.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("lowest")), "lowest")
    out = member.join(lowest, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("lowest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
