"""Operators on pairs and groups: Jaccard join, embeddings, repeated passages, mixing, components, and the pipeline."""

import itertools
import pathlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import EDGES, frame, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from venuelens.llm import common, compact_windows, hnsw, jaccard, mixing
from venuelens.llm.components import components
from venuelens.llm.shingles import lowered_words
from venuelens.session import shared_dir


def reachable(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    w = lowered_words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def similar(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def edited(text, seed, edits):
    rng, own = random.Random(seed), text.split(" ")
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.fixture(scope="module")
def copies():
    """Near copies of some bases, a passage that many share, exact copies, short texts."""
    rng, rows = random.Random(8), []
    shared = prose(500, 70)
    for base in range(4):
        text = prose(base, 120)
        rows += [edited(text, 100 * base + k, rng.randrange(0, 6)) for k in range(20)]
    rows += [prose(1000 + k, 60) + " " + shared + " " + prose(2000 + k, 50 + k) for k in range(25)]
    rows += [prose(3000, 90)] * 6 + [prose(3000, 90).upper()] + ["one two three"] * 3 + ["One  two\tthree", "one two", "", None]
    rng.shuffle(rows)
    return [(i, t, f"s{i % 3}") for i, t in enumerate(rows)]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7)]
    want = reachable({n for link in links for n in link if link[0] != link[1]}, [x for x in links if x[0] != x[1]])
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similar_sets_match_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF_NODES", 4)  # several leaves for every group
    sets = {i: shingles(t) for i, t, _ in copies}
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if similar(sets[i], sets[j])]
    want = reachable(sets, links)
    got = {r.doc_id: r for r in jaccard.similar_sets(frame(spark, copies).repartition(3)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(links) > 100 and len(set(want.values())) > 30


def test_similar_sets_on_edges(edges, nothing):
    rows = jaccard.similar_sets(edges).collect()
    assert len(rows) == len(EDGES)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert [got[i, 0] for i in (1, 2, 3)] == [1, 2, 3] and got[4, 1] == 4 and got[5, 1] == 5
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert jaccard.similar_sets(nothing).collect() == []


def test_the_join_keeps_no_intermediate_tables_on_disk(spark, copies):
    jaccard.similar_sets(frame(spark, copies)).collect()
    at = pathlib.Path(shared_dir(spark).removeprefix("file://")) / "venuelens"
    before = set(at.iterdir())
    jaccard.similar_sets(frame(spark, copies)).collect()
    left = {p.name.rsplit("-", 1)[0] for p in set(at.iterdir()) - before}
    assert left and not left & {"prefixes", "several", "shared", "good", "left", "sets", "homes", "dense", "placed", "leaves"}


def test_a_family_of_near_copies_fills_few_leaves_and_meets_once(spark, monkeypatch):
    # changes that two or three copies have in common, so that the smallest shared shingle differs from copy to copy
    rng, rows = random.Random(5), []
    for i in range(150):
        own = prose(7, 300).split(" ")
        for _ in range(6):
            own[rng.randrange(300)] = f"new{rng.randrange(3)}"
        rows.append((i, " ".join(own), "a"))
    stored = {}

    def kept(df, name, written=jaccard.written):
        stored[name] = written(df, name)
        if name == "key-leaf":
            stored["most"] = max(r["count"] for r in stored[name].groupBy("key").count().collect())
        if name == "leaves":
            stored["n_leaves"] = stored[name].count()
        return stored[name]

    monkeypatch.setattr(jaccard, "written", kept)
    sets = {i: shingles(t) for i, t, _ in rows}
    want = reachable(sets, [(i, j) for i, j in itertools.combinations(sets, 2) if similar(sets[i], sets[j])])
    docs = frame(spark, rows)
    got = {r.doc_id: r.component_id for r in jaccard.similar_sets(docs).collect()}
    assert got == want
    # a leaf a shingle for each 64 nodes of each of a few homes; by the smallest shingles a leaf for nearly every copy
    assert stored["n_leaves"] <= 20 and stored["most"] <= 20
    # large tables are joined and not broadcast, with the same result
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert {r.doc_id: r.component_id for r in jaccard.similar_sets(docs).collect()} == want


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(4)
    ranks = rng.integers(0, 3, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    for n in (1, 3, 10, 40, 200, 1000):
        for _ in range(40):
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            kept = base[rng.random(len(base)) < rng.uniform(0.8, 1)]
            other = np.unique(np.append(kept, rng.integers(0, 2**63, rng.integers(0, n // 5 + 1), dtype=np.uint64)))
            both = len(np.intersect1d(base, other))
            if 100 * both >= 80 * (len(base) + len(other) - both) and both:
                a, b = (jaccard.prefix(x, ranks, 80) for x in (base, other))
                assert len(np.intersect1d(a, b)) >= min(jaccard.extra(len(base)), jaccard.extra(len(other)))


def vectors(seed):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=16) for _ in range(300)]
    for c in range(6):
        center = rng.normal(size=16)
        x += [center + rng.normal(scale=0.05, size=16) for _ in range(3 + 12 * c)]
    return [v.tolist() for v in x]


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "TOP_ROWS", 8)  # layered graphs for few vectors
    rows = [(i, v, 0) for i, v in enumerate(vectors(3))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [1.0, None], 0),
             (n + 5, rows[3][1], 0), (n + 6, rows[3][1], 0), (n + 7, [1.0, 2.0], 0), (None, rows[3][1], 0), (n + 8, [1e308] * 16, 0)]
    good = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == 16 and np.isfinite(np.array(r[1], float)).all() and any(r[1])]
    x = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= hnsw.COSINE
    np.fill_diagonal(near, False)
    ids = [r[0] for r in good]
    want = reachable([r[0] for r in rows if r[0] is not None], [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, root int").repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    links = dict(zip(ids, near.sum(1)))
    found = sum(by_id[i].n_links for i in ids)
    assert found >= 0.98 * near.sum() and all(by_id[i].n_links <= links[i] for i in ids)
    assert np.mean([by_id[i].component_id == want[i] for i in want]) >= 0.99
    for i in (n, n + 1, n + 2, n + 3, n + 4):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[n + 6].component_id == by_id[3].component_id and not by_id[n + 6].kept
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.near_vectors(empty).collect() == []


def test_compact_windows_cover_every_passage_once():
    rng = np.random.default_rng(6)
    for n in (0, 4, 5, 30, 80):
        for high in (3, 10**9):
            h = rng.integers(0, high, n, dtype=np.uint64)
            spans = compact_windows.compact_windows(h, 5)
            for i in range(n):
                for j in range(i + 4, n):
                    own = [c for lo, c, hi in spans if lo <= i <= c <= j <= hi]
                    assert len(own) == 1 and h[own[0]] == h[i:j + 1].min()
    same = compact_windows.compact_windows(np.zeros(200_000, np.uint64), 46)
    assert len(same) < 10_000


def repeated_words(rows, n=50):
    """Word places of documents that lie in a run of n words which a smaller id has."""
    texts = {i: lowered_words(t) for i, t, _ in rows if i is not None}
    first, out = {}, {}
    for i in sorted(texts):
        for j in range(len(texts[i]) - n + 1):
            key = tuple(texts[i][j:j + n])
            if first.setdefault(key, i) != i:
                out.setdefault(i, set()).update(range(j, j + n))
    return out


def test_repeated_passages_are_found_and_verified(spark, copies):
    rows = copies + [(10_000, prose(1, 3000) + " " + prose(500, 70), "s"), (10_001, prose(4000, 500), "s")]
    found = compact_windows.repeated_passages(frame(spark, rows).repartition(3)).collect()
    texts = {i: lowered_words(t) for i, t, _ in rows}
    got: dict[int, set] = {}
    for r in found:
        assert r.other_id < r.doc_id and r.end - r.start >= 50 and r.other_end - r.other_start >= 50
        a, b = (shingles(b" ".join(texts[d][s:e]).decode()) for d, s, e in
                ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)))
        assert similar(a, b)
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = repeated_words(rows)
    # a passage repeated as it is in unlike documents is always found; of runs that single members of a family of near
    # copies share, some have no partner that was compared
    unlike = repeated_words([r for r in rows if r[1] and lowered_words(prose(500, 70))[0] in lowered_words(r[1])])
    assert len(unlike) > 20 and all(places <= got.get(i, set()) for i, places in unlike.items())
    missed = sum(len(places - got.get(i, set())) for i, places in want.items())
    assert len(want) > 50 and missed <= 0.1 * sum(map(len, want.values()))
    assert 10_001 not in got


def uncovered(rows, found):
    """Word places in repeated runs of 50 words that no found passage covers."""
    got: dict[int, set] = {}
    for r in found:
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return {i: left for i, places in repeated_words(rows).items() if (left := places - got.get(i, set()))}


@pytest.mark.parametrize("common", [2, 256])
def test_every_copy_of_a_passage_in_a_later_document_is_found(spark, monkeypatch, common):
    monkeypatch.setattr(compact_windows, "COMMON", common, raising=False)
    rows = []
    for k in range(30):
        passage = prose(6000 + k, 50)
        rows += [(100 * k + 1, prose(7000 + k, 40) + " " + passage, "s"),
                 (100 * k + 2, passage + " " + prose(8000 + k, 30) + " " + passage + " " + prose(9000 + k, 20) + " " + passage, "s")]
    found = compact_windows.repeated_passages(frame(spark, rows).repartition(3)).collect()
    assert len(repeated_words(rows)) == 30 and uncovered(rows, found) == {}


def test_later_copies_meet_by_windows_alone(spark, monkeypatch):
    monkeypatch.setattr(compact_windows, "run_windows", lambda tokens, least, maps: np.zeros((3, 0), np.int64), raising=False)
    rows = []
    for k in range(30):
        passage = prose(6000 + k, 70)
        rows += [(100 * k + 1, passage, "s"), (100 * k + 2, passage + " " + prose(8000 + k, 30) + " " + passage, "s")]
    windows = compact_windows.candidates(frame(spark, rows).select("doc_id", "text"), 46, 4, 2).collect()
    assert len(windows) == 30
    for r in windows:
        # the minimum of the passage under every function, at both copies
        for k in range(4):
            assert len({a.center for a in r.anchors if a.k == k}) >= 2


def test_passages_of_frequent_lines_are_found(spark):
    rng = random.Random(12)
    lines = [" ".join(words(20_000 + k, 8)) for k in range(60)]
    text = lambda n: " ".join(rng.choice(lines) for _ in range(n))
    rows = [(i, text(60), "s") for i in range(60)]
    for k in range(40):
        passage = text(7)
        for _ in range(2):
            rows.append((len(rows), text(20) + " " + passage + " " + text(20), "s"))
    order = [r[0] for r in rows]
    rng.shuffle(order)
    rows = [(i, t, s) for i, (_, t, s) in zip(order, rows)]
    found = compact_windows.repeated_passages(frame(spark, rows).repartition(3)).collect()
    assert len(repeated_words(rows)) >= 40 and uncovered(rows, found) == {}
    texts = {i: lowered_words(t) for i, t, _ in rows}
    for r in found:
        a, b = texts[r.doc_id][r.start:r.end], texts[r.other_id][r.other_start:r.other_end]
        assert min(len(a), len(b)) >= 50 and (a == b or similar(shingles(b" ".join(a).decode()), shingles(b" ".join(b).decode())))


def near_pairs(changed, n=70):
    """Pairs of copies of one passage of n words, each with one word changed, that share a similar part of 50 words or more."""
    out = set()
    for i, p in enumerate(changed):
        for j, q in enumerate(changed[:i]):
            for size in range(50, n + 1):
                for s in range(n - size + 1):
                    lost = {k for c in (p, q) for k in range(max(s, c - 4), min(c, s + size - 5) + 1) if s <= c < s + size} if p != q else set(range(max(s, p - 4), min(p, s + size - 5) + 1)) if s <= p < s + size else set()
                    every = size - 4
                    if 100 * (every - len(lost)) >= 80 * (every + len(lost)):
                        out.add((i, j))
                        break
                else:
                    continue
                break
    return out


def hidden_passage(seed):
    """Texts 1 to 7 around one line of 30 words; in 3 and 6 the same 50 words are around it. Where 6 meets 3 by its windows as first or previous."""
    rng = random.Random(seed)
    some = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    line, before, after = some(30), some(10), some(10)
    texts = {i: some(60) + (before + line + after if i in (3, 6) else line) + some(60) for i in range(1, 8)}
    tokens = [compact_windows.shingle_hashes(lowered_words(" ".join(t))) for t in texts.values()]
    rows = compact_windows.windows_of(list(texts), tokens, 46, 4, np.zeros(0, np.int64))
    docs_of = {}
    for key, doc, place in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()):
        docs_of.setdefault((key, (place >> 12 & 15) - 1), set()).add(doc)
    met = {k for (_, k), docs in docs_of.items() if {3, 6} <= docs and 3 in (min(docs), max(d for d in docs if d < 6))}
    return {i: " ".join(t) for i, t in texts.items()}, met


def test_a_passage_around_a_line_of_many_documents_is_found(spark):
    texts, _ = next(found for found in map(hidden_passage, range(3000)) if -1 not in found[1] and len(found[1]) < 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = compact_windows.repeated_passages(docs).collect()
    assert [(r.doc_id, r.other_id, r.start, r.end, r.other_start) for r in rows] == [(6, 3, 60, 110, 60)]


def test_a_passage_around_a_line_that_one_document_repeats_is_found(spark):
    some = lambda rng, n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    rows = []
    for k in range(150):
        rng = random.Random(k)
        line, sides = some(rng, 40), [(some(rng, 5), some(rng, 5)) for _ in range(5)]
        around = [[*a, *line, *b] for a, b in sides]
        rows.append((2 * k, " ".join(w for p in around for w in [*p, *some(rng, 60)]), "s"))
        rows.append((2 * k + 1, " ".join([*some(rng, 60), *around[2], *some(rng, 60)]), "s"))
    found = compact_windows.repeated_passages(frame(spark, rows).repartition(3)).collect()
    assert len(repeated_words(rows)) == 150 and uncovered(rows, found) == {}


def test_three_documents_all_meet_though_the_first_one_has_the_surroundings(spark):
    rows = []
    for k in range(150):
        own = prose(40_000 + k, 105).replace(".", "").split()
        rows += [(3 * k, " ".join(own[20:75]), "s"), (3 * k + 1, " ".join(own[30:81]), "s"), (3 * k + 2, " ".join(own), "s")]
    pairs = compact_windows.candidates(frame(spark, rows).select("doc_id", "text"), 46, 4, 2).collect()
    met = {(r.doc_id, r.other_id): {a.k for a in r.anchors} for r in pairs}
    assert all(-1 in met.get((3 * k + 2, 3 * k + 1), ()) for k in range(150))


@pytest.mark.parametrize("hot", [2, 256])
def test_near_passages_of_a_family_are_found(spark, monkeypatch, hot):
    monkeypatch.setattr(compact_windows, "HOT_WINDOWS", hot)
    monkeypatch.setattr(compact_windows, "SAMPLED", 1)
    rng = random.Random(17)
    passage = prose(777, 70).split()
    changed, rows = [], []
    for i in range(120):
        at = rng.randrange(70)
        changed.append(at)
        own = [*passage[:at], f"other{i}", *passage[at + 1:]]
        rows.append((i, prose(5000 + i, rng.randint(30, 90)) + " " + " ".join(own) + " " + prose(6000 + i, rng.randint(30, 90)), "s"))
    want = {i for i, _ in near_pairs(changed)}
    found = compact_windows.repeated_passages(frame(spark, rows).repartition(3)).collect()
    texts = {i: lowered_words(t) for i, t, _ in rows}
    for r in found:
        a, b = (shingles(b" ".join(texts[d][s:e]).decode()) for d, s, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)))
        assert similar(a, b) and min(r.end - r.start, r.other_end - r.other_start) >= 50
    got = {r.doc_id for r in found}
    assert len(want) > 100 and len(want & got) >= 0.95 * len(want)


def test_near_passages_of_two_documents_are_found(spark):
    rng, rows = random.Random(4), []
    for k in range(150):
        own = prose(30_000 + k, 60).split()
        rows.append((2 * k, prose(31_000 + k, 40) + " " + " ".join(own) + " " + prose(32_000 + k, 40), "s"))
        own[rng.randrange(60)] = "changed"
        rows.append((2 * k + 1, prose(33_000 + k, 50) + " " + " ".join(own), "s"))
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(frame(spark, rows).repartition(3)).collect()}
    assert got <= {(2 * k + 1, 2 * k) for k in range(150)} and len(got) >= 147


def test_windows_by_sliding_minima_are_the_cut_nodes_of_the_tree():
    rng = np.random.default_rng(8)
    for n in (0, 3, 5, 40, 300):
        h = rng.permutation(10 * n + 1)[:n].astype(np.uint64)
        for span in (5, 17):
            want = sorted((max(lo, c - span + 1), c, min(hi, c + span - 1)) for lo, c, hi in compact_windows.compact_windows(h, span))
            assert sorted(zip(*[x.tolist() for x in compact_windows.span_windows(h, span)])) == want


def test_runs_of_many_documents_are_told_by_half_run_windows_alone(spark, copies, monkeypatch):
    tokens = [compact_windows.shingle_hashes(lowered_words(prose(s, 900))) for s in (1, 2)]
    full, half = (compact_windows.windows_of([4, 5], tokens, 46, n, np.zeros(0, np.int64)).to_pylist() for n in (4, 0))
    assert half and half == [r for r in full if not r["place"] >> 12 & 15]
    plans = {}

    def kept(df, name, written=compact_windows.written):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(compact_windows, "written", kept)
    compact_windows.repeated_passages(frame(spark, copies))
    # not the windows of all functions are shuffled, and of the others the centers
    assert "collect_set(center" in plans["crowded-passages"]


def test_half_run_centers_agree_in_every_copy():
    rng = np.random.default_rng(2)
    for _ in range(200):
        passage = rng.integers(0, rng.choice([2, 50, 10**9]), 46, dtype=np.uint64)
        places = []
        for before in (0, int(rng.integers(0, 40))):
            tokens = np.concatenate([rng.integers(0, 50, before, dtype=np.uint64), passage, rng.integers(0, 50, 9, dtype=np.uint64)])
            key, at = compact_windows.half_run_windows(tokens, 46)
            places.append({(int(p) - before, int(k)) for k, p in zip(key, at) if before <= p <= before + 23})
        assert places[0] & places[1]


def test_passages_on_edges_and_cutting(spark, edges, nothing):
    found = compact_windows.repeated_passages(edges)
    assert {(r.doc_id, r.other_id) for r in found.collect()} == {(7, 6), (9, 8)}
    cut = compact_windows.cut_passages(edges, found)
    assert cut.columns == edges.columns
    left = sorted((r.doc_id or -1, r.text or "") for r in cut.collect())
    assert left == sorted((i or -1, t or "") for i, t, _ in EDGES if i not in (7, 9))
    assert compact_windows.repeated_passages(nothing).collect() == []
    assert compact_windows.cut_passages(nothing, found).collect() == []
    assert compact_windows.without_spans("a  b\nc d", [(1, 3), (2, 3)]) == "a  d"
    assert compact_windows.without_spans(" a b", [(0, 2)]) == " "
    assert compact_windows.without_spans("a b c", [(2, 9)]) == "a b "


def by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (goal - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= new


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(i, rng.randrange(0, 400))), rng.choice(["b", "a", None, "c", "ä", "b", "b"])) for i in range(400)]
    rows += [(3, rows[3][1], rows[3][2])] * 2 + [(1000, None, "a"), (None, "x y z", "b"), (1001, " ".join(words(5, 20_000)), "c")]
    placed, pieces = mixing.mix(frame(spark, rows).repartition(3))
    taken = mixing.taken_words(placed, pieces).collect()
    assert len(taken) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goals = by_hand(sizes)
    sums: dict = {}
    for r in taken:
        assert r.source_size == sizes[r.source] and abs(r.target - goals[r.source]) < 1e-6 * goals[r.source]
        assert 0 <= r.taken <= 2 * r.size
        sums[r.source] = sums.get(r.source, 0) + r.taken
    for s in goals:
        assert abs(sums[s] - goals[s]) <= 0.03 * goals[s] + 20
    again = mixing.taken_words(*mixing.mix(frame(spark, rows).repartition(5))).collect()
    key = [(r.doc_id or -1, r.source or "", r.size, r.taken) for r in taken]
    assert sorted(key) == sorted((r.doc_id or -1, r.source or "", r.size, r.taken) for r in again)
    fillers = pieces.select("slot", "place").distinct().collect()
    assert len(fillers) == len({r.slot for r in fillers})
    docs = mixing.mixed_documents(frame(spark, rows), placed, pieces)
    words_out = sum(len(r.text.split()) for r in docs.select("text").collect())
    assert words_out == sum(sums.values()) and len(docs.columns) == 13


def test_small_sources_meet_their_targets_in_long_blocks(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(i, 2000)), "hot") for i in range(40)]
    rows += [(100 + k, " ".join(words(100 + k, rng.choice([1, 40, 150, 750, 1500]))), f"s{k % 60}") for k in range(90)]
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goals = by_hand(sizes)
    for block in (1024, 10**9):
        placed, pieces = mixing.mix(frame(spark, rows).repartition(3), block=block)
        sums: dict = {}
        for r in mixing.taken_words(placed, pieces).collect():
            assert 0 <= r.taken <= 2 * r.size
            sums[r.source] = sums.get(r.source, 0) + r.taken
        assert all(abs(sums[s] - goal) <= 0.5 + 1e-6 for s, goal in goals.items())
        fillers = pieces.select("slot", "place").distinct().collect()
        assert len(fillers) == len({r.slot for r in fillers})


def test_mix_on_edges(edges, nothing):
    placed, pieces = mixing.mix(edges)
    rows = mixing.taken_words(placed, pieces).collect()
    assert len(rows) == len(EDGES) and {r.taken for r in rows if not r.size} == {0}
    placed, pieces = mixing.mix(nothing)
    assert mixing.taken_words(placed, pieces).collect() == [] and mixing.mixed_documents(nothing, placed, pieces).collect() == []


def test_pipeline_stages_hold_brute_force(spark, copies):
    docs = frame(spark, copies + [(5000, "same " * 90, "s1"), (5001, prose(9, 300), "s2"), (None, prose(10, 40), "s0")])
    by_stage, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = corpus_pipeline.written(stage(spark, before, ""), "stage")
        by_stage[name] = before.collect()
        assert name == "packing" or before.columns == corpus_pipeline.COLUMNS
    kept = [r for r in docs.collect() if r.text and len(r.text.split()) >= 20 and r.doc_id != 5000]
    assert sorted((r.doc_id or -1, r.text) for r in by_stage["quality rules"]) == sorted((r.doc_id or -1, r.text) for r in kept)
    sets = {r.doc_id: shingles(r.text) for r in kept if r.doc_id is not None}
    groups = reachable(sets, [(i, j) for i, j in itertools.combinations(sets, 2) if similar(sets[i], sets[j])])
    stay = {i for i in sets if groups[i] == i}
    assert {r.doc_id for r in by_stage["n-gram Jaccard join"]} == stay | {None}
    cut = [(r.doc_id, r.text, r.source) for r in by_stage["substring dedup"]]
    before = repeated_words([(r.doc_id, r.text, "") for r in by_stage["n-gram Jaccard join"]])
    left, there = (sum(map(len, w.values())) for w in (repeated_words(cut), before))
    assert there > 1000 and left <= 0.1 * there and all(r.n_chars == len(r.text) for r in by_stage["substring dedup"])
    mixed = by_stage["mixing"]
    size = {i: len(t.split()) for i, t, _ in cut}
    texts = {i: t for i, t, _ in cut}
    assert all(texts[r.doc_id].startswith(r.text) for r in mixed)
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r.length for r in by_stage["packing"]) == total


def test_pipeline_on_no_documents(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "stage")
    assert docs.filter(F.lit(True)).count() == 0


def test_near_duplicates_drop_rows_and_not_ids(spark, nothing):
    near = prose(60, 90)
    rows = [(1, near, "s"), (2, edited(near, 1, 1), "s"), (2, prose(61, 70), "s"), (1, near, "s"), (1, prose(62, 70), "s"), (None, near, "s"), (None, near, "s"),
            (3, None, "s"), (3, "", "s"), (3, "", "s"), (0, prose(63, 50), "s"), (4, prose(63, 50).upper(), "s"), (4, prose(63, 50).upper(), "s")]
    kept = jaccard.kept_documents(frame(spark, rows).repartition(3))
    assert kept.columns == nothing.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(1, near), (2, rows[2][1]), (1, rows[4][1]), (None, near), (None, near), (3, None), (3, ""), (3, ""), (0, rows[10][1])]
    assert got == sorted(want, key=repr)
    assert jaccard.kept_documents(nothing).collect() == []


def test_slots_follow_the_van_der_corput_points(spark):
    rng = random.Random(5)
    docs = [(i, prose(40_000 + i, rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    placed, pieces = mixing.mix(frame(spark, docs), block=16)
    slots = {r.slot: r.place for r in pieces.select("slot", "place").distinct().collect()}
    goals = {r.place: r.target for r in placed.select("place", "target").distinct().collect()}
    quota = {p: -(-max(1, round(t)) // 16) for p, t in goals.items()}
    whole = sum(quota.values())
    # every point in order goes to the source under it until that has all its slots
    bounds = np.cumsum([0] + [quota[p] for p in sorted(quota)])
    used, want = Counter(), {}
    for i in range(mixing.POINTS * whole):
        point = int(min(int(f"{i:053b}"[::-1], 2) / 2.0 ** 53 * whole, whole - 1))
        place = sorted(quota)[int(np.searchsorted(bounds, point, side="right")) - 1]
        if used[place] < quota[place]:
            used[place] += 1
            want[i] = place
    assert slots == want and used == quota
    # the points are even: in any prefix a source has about its share of the slots
    seen = Counter()
    for n, i in enumerate(range(whole), 1):
        if i in want:
            seen[want[i]] += 1
        for p in quota:
            share = n * quota[p] / whole
            assert seen[p] <= share + 2 + np.log2(whole) and (seen[p] >= share - 2 - np.log2(whole) or seen[p] == quota[p])
    rows = mixing.taken_words(placed, pieces).collect()
    own = {}
    for r in pieces.collect():
        own.setdefault((r.place, r.start), set()).add(r.slot)
    for r in rows:
        mine = own.get((r.place, r.start), set()) if r.size else set()
        assert (r.first_slot, r.n_slots) == (min(mine, default=None), len(mine))


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    kept = spark.conf.get(common.FREE_SHUFFLES)
    frames = [spark.range(1000).repartition(3 + k, "id").groupBy((F.col("id") % 7).alias("k")).count() for k in range(3)]
    before = files()
    out = [common.written(f, "step") for f in frames]
    assert files() <= before and [o.count() for o in out] == [7, 7, 7]
    assert spark.conf.get(common.FREE_SHUFFLES) == kept


def test_passages_store_no_texts_and_free_what_was_crowded(spark, copies, monkeypatch):
    stored = {}

    def kept(df, name, written=compact_windows.written):
        stored[name] = written(df, name)
        return stored[name]

    monkeypatch.setattr(compact_windows, "written", kept)
    found = compact_windows.repeated_passages(frame(spark, copies)).collect()
    assert found and set(stored) == {"crowded-passages", "pairs", "involved"}
    path = spark._jvm.org.apache.hadoop.fs.Path(stored["crowded-passages"].stored_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_anchors_keep_their_fields_as_numbers(spark):
    rows = [(1, prose(1, 90), "s"), (2, prose(2, 700) + " " + prose(1, 90) + " " + prose(3, 30), "s")]
    pairs = compact_windows.candidates(frame(spark, rows).select("doc_id", "text"), 46, 4, 2).collect()
    assert [(r.doc_id, r.other_id) for r in pairs] == [(2, 1)]
    anchors = pairs[0].anchors
    assert {a.k for a in anchors} == {-1, 0, 1, 2, 3}
    for a in anchors:
        assert a.center - a.other_center == 700 and 0 <= a.before <= 63 and 0 <= a.after <= 63
        assert a.k < 0 or a.before + a.after + 1 >= 46


def test_best_part_and_equal_runs_hold_to_their_definition():
    rng = np.random.default_rng(5)
    sizes = []
    argmax, kept = np.argmax, []

    def size_of(table, *rest):
        kept.append(table.size)
        return argmax(table, *rest)

    for k in range(200):
        a = rng.integers(0, 1 << 60, 260, dtype=np.uint64)
        b = np.concatenate([rng.integers(0, 1 << 60, 30, dtype=np.uint64), a])
        b[30 + rng.choice(260, 3 * (k % 9), replace=False)] += np.uint64(1)
        x = next(i for i in range(60 + k % 100, 260) if b[i + 30] == a[i])
        with pytest.MonkeyPatch.context() as m:
            m.setattr(compact_windows.np, "argmax", size_of)
            got = compact_windows.best_part(a, b, x, x + 30, 46, 80)
        p = np.flatnonzero(a[max(0, x - 150):x + 150] == b[30:][max(0, x - 150):x + 150]) + max(0, x - 150)
        sizes.append(len(p) ** 2)
        fits = [(j - i + 1, -i, -j) for i in range(len(p)) for j in range(i, len(p)) if p[i] <= x <= p[j] and p[j] - p[i] + 1 >= 46
                and 100 * (j - i + 1) >= 80 * (2 * (p[j] - p[i] + 1) - (j - i + 1))]
        n, i, j = max(fits) if fits else (0, 0, 0)
        assert got == ((p[-i], p[-j], p[-i] + 30, p[-j] + 30) if fits else None)
        anchors = {"k": np.array([-1]), "center": np.array([x]), "other_center": np.array([x + 30])}
        same = np.flatnonzero(np.diff(np.concatenate([[0], a == b[30:], [0]])))
        want = [(s, s + 30, e - s) for s, e in zip(same[::2].tolist(), same[1::2].tolist()) if e - s >= 46 and e > x - 46]
        assert set(compact_windows.equal_runs(a, b, anchors, 46)) >= {w for w in want if w[0] <= x < w[0] + w[2]}
        one, two = a[:80] % np.uint64(60), b[:90] % np.uint64(60)
        assert compact_windows.jaccard(one, two) == (len(set(one.tolist()) & set(two.tolist())), len(set(one.tolist()) | set(two.tolist())))
    # only passages around the place are tabled
    assert sum(kept) < 0.5 * sum(sizes)
