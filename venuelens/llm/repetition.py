"""Quality rules: repetition measured on suffix arrays.

Suffixes of many documents are sorted together by prefix doubling; the document number is part of the first rank, so
no repeat crosses documents. Longest common prefixes of neighbours come from the ranks of the doubling steps. A repeat
that starts one word after a repeat one word longer is no maximal one; the spans of the maximal ones are united.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import map_batches, map_rows, narrow

WINDOW = 8
MIN_WORDS = 20
MAX_COVERED_PERCENT = 30
MAX_LONGEST_PERCENT = 20
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BATCH_WORDS = 100_000

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "longest_repeat long, repeat_spans array<struct<start: long, end: long>>")


def longest_repeats(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For every position the length of the longest repeat that starts there (0 if below ``least``).

    ``words`` are integer ids, ``doc`` the non-decreasing document number of each position. Both copies of a repeat
    lie in one document and may overlap.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    ends = np.searchsorted(doc, doc, side="right")
    _, key = np.unique(words, return_inverse=True)
    key = doc.astype(np.int64) * (key.max() + 1) + key
    active = np.arange(n)
    rank = np.zeros(n, np.int64)
    levels: list[np.ndarray] = []
    step = 0
    while True:
        # ``key`` orders the active suffixes; each group of equal keys gets the place of its first member as rank
        order = np.argsort(key, kind="stable")
        key, moved = key[order], active[order]
        fresh = np.ones(len(moved), bool)
        fresh[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(moved)))
        if step == 0:
            place = starts
        else:
            old = rank[moved]
            head = np.ones(len(moved), bool)
            head[1:] = old[1:] != old[:-1]
            group_at = np.maximum.accumulate(np.where(head, np.arange(len(moved)), 0))
            place = (old + np.arange(len(moved)) - group_at)[starts]
        new = rank.copy()
        new[moved] = np.repeat(place, sizes)
        rank = new
        levels.append(rank.astype(np.int32))
        active = moved[np.repeat(sizes > 1, sizes)]
        if not len(active):
            break
        length = 1 << step
        step += 1
        ahead = active + length
        inside = ahead < ends[active]
        follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + follow
    suffixes = np.argsort(rank)
    # neighbours that share the largest power of two below ``least`` are worth measuring
    level = min(max(least, 1).bit_length() - 1, len(levels) - 1)
    if len(levels) <= max(least, 1).bit_length() - 1:
        return out
    left, right = suffixes[:-1], suffixes[1:]
    near = levels[level][left] == levels[level][right]
    left, right = left[near], right[near]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        ok = (a < ends[left]) & (b < ends[right])
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        shared[ok] += 1 << k
    keep = shared >= least
    np.maximum.at(out, left[keep], shared[keep])
    np.maximum.at(out, right[keep], shared[keep])
    return out


def maximal_spans(longest: np.ndarray) -> list[tuple[int, int]]:
    """United spans of the maximal repeats of one document, from the longest repeat at every position."""
    at = np.flatnonzero(longest)
    if not len(at):
        return []
    before = np.where(at > 0, longest[at - 1], 0)
    at = at[before != longest[at] + 1]
    end = np.maximum.accumulate(at + longest[at])
    cut = np.ones(len(at), bool)
    cut[1:] = at[1:] > end[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), end[last].tolist()))


def line_counts(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(rows: Iterable[tuple], window: int = WINDOW) -> Iterator[tuple]:
    """Measures of (doc_id, text) rows, sorted in batches of about ``BATCH_WORDS`` words."""
    held, words, sizes = [], [], []

    def flush():
        first: dict[bytes, int] = {}
        ids = np.fromiter(map(first.setdefault, words, itertools.count()), np.int64, len(words))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        longest = longest_repeats(ids, doc, window)
        at = 0
        for (doc_id, text, raw), size in zip(held, sizes):
            own = longest[at:at + size]
            at += size
            spans = maximal_spans(own)
            yield (doc_id, size, len(text) - len(raw) + len(raw.translate(None, SPACE)),
                   len(raw) - len(raw.translate(None, SYMBOLS)), line_counts(raw), sum(e - s for s, e in spans),
                   int(own.max()) if size else 0, [{"start": s, "end": e} for s, e in spans])

    for doc_id, text in rows:
        text = text or ""
        raw = text.encode()
        own = raw.split()
        held.append((doc_id, text, raw))
        words += own
        sizes.append(len(own))
        if len(words) >= BATCH_WORDS or len(held) >= 4096:
            yield from flush()
            held, words, sizes = [], [], []
    if held:
        yield from flush()


def passes(words: int, repeated: int, longest: int, min_words: int, max_covered: int, max_longest: int) -> bool:
    return words >= min_words and 100 * repeated <= max_covered * words and 100 * longest <= max_longest * words


def kept_documents(docs: DataFrame, text: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS,
                   max_covered_percent: int = MAX_COVERED_PERCENT, max_longest_percent: int = MAX_LONGEST_PERCENT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are; judged where they are read."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            values = ((i, v.as_py()) for i, v in enumerate(batch.column(at)))
            good = [passes(m[1], m[5], m[6], min_words, max_covered_percent, max_longest_percent) for m in measure(values, window)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_batches(docs, run, docs)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                  min_words: int = MIN_WORDS, max_covered_percent: int = MAX_COVERED_PERCENT,
                  max_longest_percent: int = MAX_LONGEST_PERCENT) -> DataFrame:
    """One row per document row: its measures, the spans of its repeats (in words) and the verdict.

    ``base_failed``: under ``min_words`` words, or repeats of at least ``window`` words cover more than
    ``max_covered_percent`` of them. ``kept`` also wants the longest repeat to have at most ``max_longest_percent`` of the
    words. A null or empty text has no words and fails; rows with equal or null ids are judged one by one; an
    empty table gives no rows; other columns are not read.
    """
    def run(rows):
        return measure(rows, window)

    measured = map_rows(narrow(docs, doc_id=doc_id, text=text), run, SCHEMA)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_covered_percent * F.col("n_words"))
    return (measured.withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (100 * F.col("longest_repeat") <= max_longest_percent * F.col("n_words"))))
