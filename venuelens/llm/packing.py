"""Harmonic packing of token sequences.

Every document is cut into pieces whose lengths are reciprocals of the capacity: floor(1024 / k) ids, k of which fill
a bin. A piece length is a class and a class fills its bins with k pieces each, so that a bin and an offset follow from
the number of the piece in its class. Workers number their pieces by themselves; only the counts per worker and class are
added up. The pieces of the last, incomplete bin of every class are fewer than the sum of all k, whatever the corpus,
and are packed together.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from venuelens.llm.common import map_rows, narrow, written

MODEL = "byte_bpe_50k.json"
CAPACITY = 1024
WIDEST = 32
CACHED_CHUNKS = 350_000
LONGEST_CACHED = 40

#: White space goes with what follows it; no pre-token of the model spans from other characters to white space.
CHUNK = re.compile(r"\s*\S+|\s+")
#: A chunk of letters, a pre-token; the marks behind it are another one.
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
MARKS = ".,;:!?"
#: Characters that Python counts as white space and the model's pattern does not.
OTHER_SPACE = re.compile("[\x1c-\x1f]")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, nth long, ids array<int>"


def byte_symbols() -> dict[int, str]:
    """The model's symbol of every byte: printable ones stand for themselves, the others come after 255 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Chunks(dict):
    """Ids of chunks as bytes. What is missing is encoded, so that known chunks cost no Python call; two generations bound the size."""

    def __init__(self, encode: Callable[[str], bytes], size: int):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
            if len(chunk) > LONGEST_CACHED:
                return ids
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of a text as little-endian 32-bit numbers; chunks are encoded once and kept in a bounded cache."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(model)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.symbols = byte_symbols()
        self.space = self.symbols[32]
        self.known = Chunks(self.chunk, CACHED_CHUNKS)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, CHUNK.findall(text)))

    def word(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk: marks behind a word, and a line's end before it, are pre-tokens of their own."""
        word = chunk.rstrip(MARKS)
        if word and word != chunk and PLAIN.fullmatch(word):
            return self.known[word] + self.known[chunk[len(word):]]
        if chunk.isascii():
            if chunk.isalpha():
                return self.word(chunk)
            if chunk[0] == " " and chunk[1:].isalpha():
                return self.word(self.space + chunk[1:])
        if PLAIN.fullmatch(chunk):
            return self.word(chunk.encode().decode("latin-1").translate(self.symbols))
        if chunk[0] == "\n" and chunk[1:2] != " " and PLAIN.fullmatch(word[1:]):
            return self.known["\n"] + self.known[chunk[1:]]
        return self.whole(chunk)


def piece_lengths(capacity: int = CAPACITY, widest: int = WIDEST) -> list[int]:
    """Class lengths, longest first: floor(capacity / k) for k up to ``widest``, and every shorter length."""
    wide = [capacity // k for k in range(1, widest + 1)]
    return wide + list(range(wide[-1] - 1, 0, -1))


def cut(length: int, lengths: list[int]) -> list[int]:
    """Piece lengths of a document: the longest class that fits, again and again."""
    out = [lengths[0]] * (length // lengths[0])
    left = length % lengths[0]
    for size in lengths[1:]:
        while left >= size:
            out.append(size)
            left -= size
    return out


def cut_rows(rows: Iterable[tuple], encoder: ChunkEncoder, capacity: int, end_id: int, with_ids: bool) -> Iterator[tuple]:
    from pyspark import TaskContext
    worker = TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    lengths = piece_lengths(capacity)
    nth = dict.fromkeys(lengths, 0)
    for doc_id, text in rows:
        ids = encoder.encode(text or "") + end
        at = 0
        for size in cut(len(ids) // 4, lengths):
            own = ids[4 * at:4 * (at + size)]
            yield (doc_id, at, size, zlib.crc32(own), len(ids) // 4, worker, nth[size],
                   np.frombuffer(own, "<u4").tolist() if with_ids else None)
            nth[size] += 1
            at += size


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0,
         model: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and the offset there; with its ids if ``with_ids``.

    A null or empty text is the end id alone. Documents with equal or null ids are packed one by one. An empty table
    gives no rows. Other columns are not read. Long documents are cut into full sequences first. The cut
    pieces are stored before they are numbered, so the result does not depend on tasks that run again.
    """
    path = model or public_tokenizers.path(MODEL)

    def run(rows, encoder):
        return cut_rows(rows, encoder, capacity, end_id, with_ids)

    pieces = written(map_rows(narrow(docs, doc_id=doc_id, text=text), run, PIECES, lambda: ChunkEncoder(path)), "pieces")
    return in_bins(pieces if with_ids else pieces.drop("ids"), capacity)


def in_bins(pieces: DataFrame, capacity: int) -> DataFrame:
    """Sequence and offset from the number of a piece among those of its length."""
    per_worker = pieces.groupBy("length", "worker").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("length").orderBy("worker").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("length")
    # one row per class and worker, joined by Spark's own choice of strategy
    offsets = per_worker.select("length", "worker", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                                F.sum("_n").over(whole).alias("_all"))
    per_bin = F.floor(F.lit(capacity) / F.col("length"))
    placed = (pieces.join(offsets, ["length", "worker"]).withColumn("_i", F.col("nth") + F.col("_before"))
              .withColumn("_k", per_bin).withColumn("_bin", F.floor(F.col("_i") / F.col("_k"))))
    full = (F.col("_bin") + 1) * F.col("_k") <= F.col("_all")
    # sequences are numbered class by class: a bin's number times the capacity, plus the length of its pieces
    number = F.col("_bin") * (capacity + 1) + F.col("length")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if "ids" in pieces.columns else [])]
    complete = placed.filter(full).select(*columns, number.cast("long").alias("sequence_id"),
                                          (F.col("_i") % F.col("_k") * F.col("length")).cast("long").alias("offset"))
    rest = placed.filter(~full).select(*columns, "_i")
    return complete.unionByName(pack_rest(rest, columns, capacity))


def pack_rest(rest: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """First-fit of the incomplete bins: less than ``capacity`` pieces per class, so one task holds them all.

    Their sequences are numbered from -1 downwards.
    """
    schema = rest.select(*columns).schema.add("sequence_id", "long").add("offset", "long")

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("_i", "ascending")])
        filled: list[int] = []
        where, offset = [], []
        for size in part["length"].to_pylist():
            b = next((i for i, n in enumerate(filled) if n + size <= capacity), len(filled))
            if b == len(filled):
                filled.append(0)
            where.append(-1 - b)
            offset.append(filled[b])
            filled[b] += size
        return part.select(columns).append_column("sequence_id", pa.array(where, pa.int64())) \
                   .append_column("offset", pa.array(offset, pa.int64()))

    return rest.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(run, schema)
