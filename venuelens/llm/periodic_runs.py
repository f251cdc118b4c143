"""Periodic runs: stretches of consecutive words that repeat with one period, found by a suffix automaton.

The suffix automaton of a stretch of words has one state for every set of phrases that end at the same places; its suffix
links form a tree. When word ``i`` is appended, the path from the state of the prefix to the root takes ``i`` as the
last end of all its phrases. Before that, the path falls into segments of states that share an older last end ``j``: the
longest phrase of such a segment ended at ``j`` and ends again at ``i``. If its length is at least ``i - j``, a square of
period ``i - j`` ends at ``i``. The segments are preferred paths of a link-cut forest (splay trees), so that recolouring a
path costs amortised O(log n). Squares are extended to both sides to whole runs.

Words that cannot lie in a run of the wanted exponent (too rare, or too far from their next copy) are cut out first, for
many documents at once; the stretches between them go through the automaton.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import map_rows, narrow

MIN_LENGTH = 6
MIN_EXPONENT = 4
BATCH_WORDS = 100_000
#: Rounds of cutting words out before the automaton; more or fewer change the time only.
ROUNDS = 20
WORD = r"[^\x20\x09-\x0D]+"

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link and longest length of every state, state of every prefix); state 0 is none, state 1 the root."""
    link, longest, follow, prefix = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for w in word:
        new = len(link)
        link.append(1)
        longest.append(longest[last] + 1)
        follow.append({})
        p = last
        while p and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p:
            q = follow[p][w]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                follow.append(follow[q].copy())
                link[q] = link[new] = copy
                while p and follow[p].get(w) == q:
                    follow[p][w] = copy
                    p = link[p]
        prefix.append(new)
        last = new
    return link, longest, prefix


def squares(word: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares: at least the first square of every run, whatever its exponent (2 or more)."""
    link, longest, prefix = suffix_automaton(word)
    # up: parent in the splay tree, or, at its root, the state above the preferred path; left is nearer to the root state
    up, left, right, colour = link, [0] * len(link), [0] * len(link), [-1] * len(link)
    up[1] = 0

    def splay(x: int) -> None:
        """Make x the root of its splay tree; the colour of a path stands at its root."""
        while True:
            p = up[x]
            if left[p] != x and right[p] != x or not p:
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                around = p if (left[g] == p) == (left[p] == x) else x
                rotate(around)
                rotate(x)
            else:
                rotate(x)

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            colour[x] = colour[p]

    for i, state in enumerate(prefix):
        below, x = 0, state
        while x:
            splay(x)
            before = colour[x]
            if before >= 0 and i - before <= longest[x]:
                yield i, i - before
            cut = right[x]
            if cut:
                colour[cut] = before
            right[x] = below
            below, x = x, up[x]
        colour[below] = i


def runs_of(word: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``min_length`` words and ``min_exponent`` periods."""
    found, done, n = [], {}, len(word)
    for end, period in squares(word):
        if period * min_exponent > n or done.get(period, -1) >= end:
            continue
        start = end - 2 * period + 1
        while start and word[start - 1] == word[start - 1 + period]:
            start -= 1
        stop = end + 1
        while stop < n and word[stop] == word[stop - period]:
            stop += 1
        done[period] = stop - 1
        if stop - start >= max(min_length, min_exponent * period):
            found.append((start, stop - start, period))
    return found


def stretches(ids: np.ndarray, doc: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run; every run of the wanted kind lies inside one of them.

    A run of n words has every word of it ``min_exponent`` times, at distances of at most n / ``min_exponent``. Words
    of which a stretch does not have so many, or whose next copies are farther than that, end the stretch; what is left
    is looked at again until nothing changes, or ``ROUNDS`` times.
    """
    place, part, word = np.arange(len(ids)), doc.astype(np.int64), ids.astype(np.int64)
    for _ in range(ROUNDS):
        if not len(place):
            return []
        # place and part are sorted: part numbers stretches, place the words
        order = np.lexsort((word, part))
        p, w, at = part[order], word[order], place[order]
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
        heads = np.flatnonzero(fresh)
        count = np.repeat(np.diff(np.append(heads, len(p))), np.diff(np.append(heads, len(p))))
        size = np.bincount(part)[p]
        gap = np.full(len(p) + 1, np.iinfo(np.int64).max)
        gap[1:-1] = np.where(fresh[1:], gap[0], at[1:] - at[:-1])
        near = np.minimum(gap[:-1], gap[1:]) * min_exponent <= size
        good = np.empty(len(p), bool)
        good[order] = (count >= min_exponent) & near & (size >= min_length)
        if good.all():
            break
        place, part, word = place[good], part[good], word[good]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(new) - 1
    if not len(place):
        return []
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    last = np.append(first[1:], len(place)) - 1
    return list(zip(place[first].tolist(), (place[last] + 1).tolist()))


def find_runs(rows: Iterable[tuple], min_length: int, min_exponent: int) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for rows of (doc_id, text), in batches of about ``BATCH_WORDS`` words."""
    held, words, sizes = [], [], []

    def flush():
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, words, itertools.count()), np.int64, len(words))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
        offset = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        for start, end in stretches(ids, doc, min_length, min_exponent):
            at = int(doc[start])
            found[at] += [(start - offset[at] + s, n, p) for s, n, p in runs_of(ids[start:end].tolist(), min_length, min_exponent)]
        for at, doc_id in enumerate(held):
            own = words[offset[at]:offset[at + 1]]
            runs = sorted(found[at], key=lambda r: (r[0], r[2]))
            yield doc_id, len(own), [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(kept(own, runs)).decode()

    for doc_id, text in rows:
        own = (text or "").encode().split()
        held.append(doc_id)
        words += own
        sizes.append(len(own))
        if len(words) >= BATCH_WORDS or len(held) >= 4096:
            yield from flush()
            held, words, sizes = [], [], []
    if held:
        yield from flush()


def kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that lie in a run after its first period."""
    out, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        out += words[at:max(at, start)]
        at = max(at, end)
    return out + words[at:]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document row: its words, its periodic runs and its text with every run collapsed to one period.

    A run is a stretch of words with smallest period q and at least ``min_length`` and ``min_exponent`` * q words that no
    neighbouring word extends; runs are given by start (from 0) and period. ``collapsed`` joins the words that no run
    has after its first q by single spaces. A null or empty text has no words, no runs and the empty string; rows with
    equal or null ids are judged one by one; texts of any length are taken whole, by one task, in O(n log n);
    an empty table gives no rows; other columns are not read.
    """
    def run(rows):
        return find_runs(rows, min_length, min_exponent)

    return map_rows(narrow(docs, doc_id=doc_id, text=text), run, SCHEMA)


def repeated_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the documents, chosen by the CRC-32 of the id, ends in a repeated piece.

    With h that checksum, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, word i >= a becomes word
    a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), and words are joined by single spaces. Other rows,
    also those with a null id or without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    marked = (narrow(docs, doc_id=doc_id, text=text).withColumn("_g", F.when(h % 10 == 0, g))
              .withColumn("_words", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
              .withColumn("_n", F.when(F.size("_words") > 0, F.size("_words"))))
    a = F.col("_g") % F.col("_n")
    p = F.floor((F.col("_n") - a) / (3 + F.col("_g") % 8)) + 1
    shaped = marked.withColumn("_a", a.cast("int")).withColumn("_p", p.cast("int"))

    def word(i: Column) -> Column:
        source = F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
        return F.get("_words", source)

    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), word), " ")
    return shaped.select("doc_id", F.when(F.col("_n").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def run_digest(runs: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of the runs and of the collapsed text."""
    longest = F.element_at(F.array_sort("runs", lambda x, y: F.when(x.length != y.length, y.length - x.length)
                                        .when(x.start != y.start, x.start - y.start).otherwise(x.period - y.period).cast("int")), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = F.when(F.size("runs") > 0, longest)
    return (runs.withColumn("_top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), F.col("_top.length").alias("length"),
        F.col("_top.period").alias("period"), F.floor(1000 * F.col("_top.length") / F.col("_top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
