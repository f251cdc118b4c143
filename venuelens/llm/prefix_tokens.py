"""Token counts of every prefix of a text by dynamic programming.

A byte-fallback piece model merges the best-scored neighbours first. Whether the border between two neighbouring tokens
holds depends on these two alone, so the last token of a prefix is the one token that ends there and goes with the
last token of the prefix before it; the count is that prefix's count and one more. No prefix is encoded again.
No piece holds a space or a line end after another character, so segments that begin there are independent.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from venuelens.llm.common import Memo, map_rows, narrow

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHED_SEGMENTS = 400_000
CACHED_PAIRS = 400_000
CACHED_HEADS = 100_000
LONGEST_CACHED = 40
#: Segments that begin with so many equal characters share the counts of these.
HEAD = 5

SEGMENT = re.compile(r" +[^ \n]*|[^ \n]+|\n+")


def automaton(tokens: list[str]) -> tuple[list[dict[str, int]], list[int], list[tuple]]:
    """Of a state the next ones by character, the state of its longest proper suffix, and (size, number) of the tokens that end there.

    A state is a beginning of a token; the longest tokens come first, single characters are left out.
    """
    step: list[dict[str, int]] = [{}]
    own: list[tuple] = [()]
    for number, token in enumerate(tokens):
        state = 0
        for char in token:
            to = step[state].get(char)
            if to is None:
                to = step[state][char] = len(step)
                step.append({})
                own.append(())
            state = to
        if len(token) > 1:
            own[state] = ((len(token), number),)
    back, ending = [0] * len(step), list(own)
    todo = list(step[0].values())
    for state in todo:
        ending[state] = own[state] + ending[back[state]]
        for char, to in step[state].items():
            at = back[state]
            while at and char not in step[at]:
                at = back[at]
            back[to] = step[at].get(char, 0)
            todo.append(to)
    return step, back, ending


class PrefixCounter:
    """Exact counts for one model; caches are bounded and only save time.

    Tokens are numbers: 0 is none, then the pieces, then single characters that are no piece by their code points. An automaton
    over the pieces gives those that end at a place, so no other substring is looked at.
    """

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        normal = [i for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in normal}
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.score):
            raise ValueError("a piece crosses a segment border; this model needs whole texts as segments")
        self.tokens = ["", *self.score]
        self.single = {p: i for i, p in enumerate(self.tokens) if len(p) == 1}
        self.step, self.back, self.ending = automaton(self.tokens)
        #: What merging does at the left and at the right end of a token, by token; there are no more than pieces and single characters.
        self.edges: dict[int, tuple] = {}
        self.pairs = Memo(CACHED_PAIRS)
        self.heads = Memo(CACHED_HEADS)
        self.totals = Memo(CACHED_SEGMENTS)

    def merge(self, text: str) -> list[str]:
        """Plain pair merging of a short string: the definition that ``holds`` is held against."""
        return self.merging(text)[-1][1]

    def merging(self, text: str) -> list[tuple]:
        """(score, parts) of every merge of a short string in order; no score comes with the characters."""
        parts, score = list(text), self.score
        out = [(None, parts)]
        while len(parts) > 1:
            found = [(-score[p], i) for i, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in score]
            if not found:
                break
            least, i = min(found)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]
            out.append((-least, parts))
        return out

    def text_of(self, token: int) -> str:
        return self.tokens[token] if token < len(self.tokens) else chr(token - len(self.tokens))

    def edges_of(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """Scores of the merges that make a token, and its first and last part before each and at the end; None if it does not stay whole."""
        if token not in self.edges:
            steps = self.merging(self.text_of(token))
            whole = len(steps[-1][1]) == 1
            self.edges[token] = ([s for s, _ in steps[1:]], [p[0] for _, p in steps], [p[-1] for _, p in steps]) if whole else None
        return self.edges[token]

    def holds(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart and whole; with no ``left`` whether ``right`` stays whole.

        Both merge as they do alone, the best score of both first and the left one of equals, until a merge across the border is better.
        """
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.apart(left, right)
            self.pairs.put(key, known)
        return known

    def apart(self, left: int, right: int) -> bool:
        own = self.edges_of(right)
        if own is None or not left:
            return own is not None
        before = self.edges_of(left)
        if before is None:
            return False
        get, i, j = self.score.get, 0, 0
        while True:
            across = get(before[2][i] + own[1][j])
            one = before[0][i] if i < len(before[0]) else None
            two = own[0][j] if j < len(own[0]) else None
            if one is None and two is None:
                return across is None
            first = two is None or one is not None and one >= two
            if across is not None and (across > one if first else across >= two):
                return False
            if first:
                i += 1
            else:
                j += 1

    def prefixes(self, segment: str) -> list[int]:
        """Token counts of segment[:0], segment[:1], ..."""
        # segments that begin alike have the same counts and last tokens so far
        head = segment[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self.extended(head, [0], [0], 0)
            if len(head) == HEAD:
                self.heads.put(head, known)
        if len(segment) <= HEAD:
            return list(known[0])
        return self.extended(segment[HEAD:], list(known[0]), list(known[1]), known[2])[0]

    def extended(self, text: str, counts: list[int], last: list[int], state: int) -> tuple[list[int], list[int], int]:
        """``counts`` and ``last`` tokens of a prefix, and the automaton's state there, carried on over the characters of ``text``."""
        step, back, ending, single, pairs, holds = self.step, self.back, self.ending, self.single, self.pairs.new, self.holds
        for char in text:
            to = step[state].get(char)
            while to is None and state:
                state = back[state]
                to = step[state].get(char)
            state = to or 0
            for size, token in ending[state]:
                left = last[-size]
                known = pairs.get(left << 24 | token)
                if known or known is None and holds(left, token):
                    counts.append(counts[-size] + 1)
                    last.append(token)
                    break
            else:
                # of all tokens that end here the character itself is left
                token = single.get(char)
                counts.append(counts[-1] + (1 if token else len(char.encode())))
                last.append(token or len(self.tokens) + ord(char))
        return counts, last, state

    def total(self, segment: str) -> int:
        if segment[0] == "\n":
            return len(segment)
        known = self.totals.get(segment)
        if known is None:
            known = self.prefixes(segment)[-1]
            if len(segment) <= LONGEST_CACHED:
                self.totals.put(segment, known)
        return known

    def segments(self, text: str) -> list[str]:
        """The text with the model's leading space, cut at independent borders."""
        return SEGMENT.findall(" " + text.replace("▁", " ")) if text else []

    def border_counts(self, segments: list[str]) -> list[int]:
        """Counts of the prefixes that end at segment borders."""
        get, total = self.totals.new.get, self.total
        return list(itertools.accumulate([get(s) or total(s) for s in segments], initial=0))

    def all_prefixes(self, text: str) -> list[int]:
        """Counts of text[:0], text[:1], ...: what encoding each of them would give."""
        out, base = [], 0
        for s in self.segments(text):
            counts = self.prefixes(s)
            out += [base + c for c in counts[1:]]
            base += counts[-1]
        return [0, *out[1:]] if out else [0]

    def longest_prefix(self, segments: list[str], borders: list[int], limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens, from the stored counts.

        The first segment starts with the model's own space, which is no code point of the text; a prefix that ends
        behind this space is the empty one.
        """
        if borders[-1] <= limit:
            return max(sum(map(len, segments)) - 1, 0)
        k = bisect_right(borders, limit) - 1
        while k >= 0:
            if borders[k] <= limit:
                fits = [i for i, c in enumerate(self.prefixes(segments[k])) if borders[k] + c <= limit and (i or not k)]
                if fits:
                    return max(sum(map(len, segments[:k])) + fits[-1] - 1, 0)
            k -= 1
        return 0


@functools.lru_cache(maxsize=1)
def counter_of(model: str) -> PrefixCounter:
    """One counter per Python process: the tasks that it runs share its bounded caches."""
    return PrefixCounter(model)


def count_rows(rows: Iterable[tuple], counter: PrefixCounter, limit: int) -> Iterator[tuple]:
    for doc_id, text in rows:
        text = text or ""
        segments = counter.segments(text)
        borders = counter.border_counts(segments)
        yield doc_id, len(text.encode()), borders[-1], borders[-1] > limit, counter.longest_prefix(segments, borders, limit)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT,
                 model: str | None = None) -> DataFrame:
    """Per document row: bytes, tokens, whether they exceed ``limit``, and the longest prefix that does not (``fits_chars``).

    A null or empty text has no tokens. Rows with equal or null ids are counted one by one; an empty table gives no
    rows; other columns are not read. Very long words need time in proportion to their length.
    """
    path = model or public_tokenizers.path(MODEL)

    def run(rows, counter):
        return count_rows(rows, counter, limit)

    return map_rows(narrow(docs, doc_id=doc_id, text=text), run,
                    "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long",
                    lambda: counter_of(path))


def prefix_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per document row the exact token count of every prefix: ``counts[i]`` belongs to the first i code points."""
    path = model or public_tokenizers.path(MODEL)

    def run(rows, counter):
        return ((d, counter.all_prefixes(t or "")) for d, t in rows)

    return map_rows(narrow(docs, doc_id=doc_id, text=text), run, "doc_id long, counts array<int>",
                    lambda: counter_of(path))
