"""Phrase mining by joins of occurrence relations: which words stand together more often than their parts explain.

The occurrence relation of length 1 has a row for every word of every piece: where it stands and which word it is. It is
stored sorted by place. Phrases of length k + 1 come from a merge join of the relation of length k with itself at
adjacent places; they are counted over the corpus, and only the occurrences of frequent ones are stored as the relation of
length k + 1, before the next length is joined. So no phrase is counted that has a rare part.

A relation is stored in blocks of about ``BLOCK_WORDS`` words of one language, each sorted by place: ``steps`` are the
distances between neighbouring occurrences (the end of a piece counts as a word, so two pieces are never adjacent; any
distance above 1 only says "not adjacent" and is kept as at most 127), ``member`` their phrases as places in the block's own list
of phrases. Joins stay inside a block; only counts of a block's phrases are shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from venuelens.llm.common import ROWS_SENT, WIDE_ROWS, at_least, narrow, schema_of, written

MIN_COUNT = 10
TOP = 2000
COVER_PERCENT = 50
SCALE = 1_000_000
#: Words of a block, and of all open blocks of a task together. They bound memory and change no result.
BLOCK_WORDS = 1_500_000
OPEN_WORDS = 4_000_000

# one byte that UTF-8 never uses ends a piece
END = b"\xff"
PREPARE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
# a word's number: the first block that lists it (task, running number) and its place there
TASK_BITS, RUNNING_BITS, PLACE_BITS = 21, 16, 26

WORDS = "block long, lang string, steps array<tinyint>, member array<int>, words array<string>, counts array<long>"


def relation_schema(k: int) -> str:
    return ", ".join(["block long", "steps array<tinyint>", "member array<int>", *[f"i{j} array<long>" for j in range(1, k + 1)]])


def occurrences(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The relation of length 1 in blocks, stored, with the words of each block and their counts in it."""
    target = to_arrow_schema(schema_of(WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, running, whole = TaskContext.get().partitionId(), itertools.count(), 0
        known: dict[str, dict[bytes, int]] = {}
        parts: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def block(name: str) -> pa.RecordBatch:
            number = next(running)
            if task >> TASK_BITS or number >> RUNNING_BITS or len(known[name]) >> PLACE_BITS:
                raise ValueError("more tasks, blocks or words of a block than their numbers have bits")
            ids = np.concatenate(parts.pop(name))
            place = np.flatnonzero(ids >= 0)
            _, member, counts = np.unique(ids[place], return_inverse=True, return_counts=True)
            del sizes[name]
            # the words of a block stand in the order of their first place, as their numbers do
            words = [w.decode() for w in itertools.islice(known.pop(name), 1, None)]
            return record([task << RUNNING_BITS | number, name, steps_of(place), member.astype(np.int32), words, counts], target)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = value.encode().translate(PREPARE).replace(END, b" " + END + b" ").split()
                if not words:
                    continue
                first = known.setdefault(name, {END: -1})
                at = sizes.get(name, 0)
                own = np.fromiter(map(first.setdefault, words, itertools.count(at)), np.int32, len(words))
                parts.setdefault(name, []).extend((own, np.array([-1], np.int32)))
                sizes[name] = at + len(words) + 1
                whole += len(words) + 1
                if sizes[name] >= BLOCK_WORDS:
                    whole -= sizes[name]
                    yield block(name)
                if whole >= OPEN_WORDS:
                    yield from map(block, list(parts))
                    whole = 0
        yield from map(block, list(parts))

    named = narrow(docs, lang=lang, text=text).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return written(named.mapInArrow(run, WORDS), "occurrences-1", WIDE_ROWS)


def steps_of(place: np.ndarray) -> np.ndarray:
    return np.minimum(np.diff(place, prepend=-2), 127).astype(np.int8)


def record(values: list, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)


def values(table: pa.Table, name: str) -> np.ndarray:
    """A list column of a relation's only row, as an array."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def keep_words(left: pa.Table, right: pa.Table) -> dict[str, np.ndarray]:
    """The relation of length 1 without the words that are not frequent."""
    kept = np.full(len(left.column("counts").combine_chunks().flatten()), -1, np.int32)
    kept[right.column("g").to_numpy()] = np.arange(right.num_rows, dtype=np.int32)
    member, place = kept[values(left, "member")], np.cumsum(values(left, "steps"), dtype=np.int64)
    there = member >= 0
    return {"steps": steps_of(place[there]), "member": member[there], "i1": right.column("i1").to_numpy()}


def adjacent(relation: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, phrase there, phrase at the next place) of the merge join of a relation with itself, as one number per pair."""
    place, member = np.cumsum(values(relation, "steps"), dtype=np.int64), values(relation, "member")
    follows = np.flatnonzero(place[1:] == place[:-1] + 1)
    return place[follows], member[follows].astype(np.int64) * len(values(relation, "i1")) + member[follows + 1]


def longer(relation: pa.Table, k: int, pairs: np.ndarray) -> dict[str, np.ndarray]:
    """The words of the phrases of k + 1 words that pairs of phrases of k words make."""
    a, b = np.divmod(pairs, max(len(values(relation, "i1")), 1))
    return {f"i{j}": values(relation, f"i{j}")[a] for j in range(1, k + 1)} | {f"i{k + 1}": values(relation, f"i{k}")[b]}


def candidates(relation: DataFrame, k: int) -> DataFrame:
    """The phrases of k + 1 words of each block and how often it has them: (block, n, words)."""
    schema = ", ".join(["block long", "n long", *[f"i{j} long" for j in range(1, k + 2)]])
    target = to_arrow_schema(schema_of(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(at, 1)])
                pairs, n = np.unique(adjacent(row)[1], return_counts=True)
                made = longer(row, k, pairs) | {"n": n, "block": np.full(len(n), row.column("block")[0].as_py())}
                # batches of a bounded size
                for cut in range(0, len(n), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name][cut:cut + 65_536], f.type) for f in target], schema=target)

    return relation.mapInArrow(run, schema)


def positions(have: list[np.ndarray], want: list[np.ndarray]) -> np.ndarray:
    """Where each row of the columns ``want`` stands among the different rows of the columns ``have``."""
    code = np.zeros(len(have[0]) + len(want[0]), np.int64)
    for columns in zip(have, want):
        _, value = np.unique(np.concatenate(columns), return_inverse=True)
        _, code = np.unique(code * (value.max() + 1) + value, return_inverse=True)
    at = np.empty(code.max() + 1, np.int64)
    at[code[:len(have[0])]] = np.arange(len(have[0]))
    return at[code[len(have[0]):]]


def keep_phrases(left: pa.Table, right: pa.Table, k: int) -> dict[str, np.ndarray]:
    """The relation of length k + 1 from that of length k and the block's frequent phrases of k + 1 words."""
    place, pairs = adjacent(left)
    have, words = [values(left, f"i{j}") for j in range(1, k + 1)], [right.column(f"i{j}").to_numpy() for j in range(1, k + 2)]
    wanted = positions(have, words[:-1]) * len(have[0]) + positions(have, words[1:])
    wanted.sort()
    member = np.searchsorted(wanted, pairs)
    there = wanted[np.minimum(member, len(wanted) - 1)] == pairs
    return longer(left, k, wanted) | {"steps": steps_of(place[there]), "member": member[there].astype(np.int32)}


def semi_join(relation: DataFrame, frequent: DataFrame, k: int, settings: dict[str, str] | None = None) -> DataFrame:
    """Occurrences of frequent phrases of k words, stored: ``relation`` is of length k - 1, or the raw one for words."""
    target = to_arrow_schema(schema_of(relation_schema(k)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        made = keep_words(left, right) if k == 1 else keep_phrases(left, right, k - 1)
        made["block"] = left.column("block")[0].as_py()
        return pa.Table.from_batches([record([made[f.name] for f in target], target)])

    return written(relation.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(run, relation_schema(k)), f"occurrences-{k}",
                   WIDE_ROWS, settings)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, min_count: int = MIN_COUNT,
                 top: int = TOP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by how much they exceed their parts.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and into words at spaces and tabs. A phrase that stands
    ``a >= min_count`` times is cut after each of its words into parts of counts l and r; its score is the least of
    floor(1000000 a a / (l r)). Phrases inside a longer phrase that has at least ``cover_percent`` of their count go. Result: lang, rank, phrase,
    a, l, r, n (words of the language), score; ties by a, then by the bytes of the phrase.

    A null text has no words, a null language is ``und``; repeated rows count as often as they stand; texts of any length
    are taken whole; an empty table gives no rows; other columns are not read.
    """
    raw = occurrences(docs, text, lang)
    # two blocks a partition, of which Spark puts small ones together: what a task holds does not grow with the corpus; a block is sent alone
    many = at_least(docs.sparkSession, raw.count() // 2)
    alone = {**many, ROWS_SENT: "1"}
    listed = raw.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "block", "lang", F.col("pos").cast("long").alias("g"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    same = W.partitionBy("lang", "word")
    number = F.shiftleft("block", PLACE_BITS).bitwiseOR(F.col("g"))
    words = written(listed.withColumn("f", F.sum("n").over(same)).withColumn("i1", F.min(number).over(same))
                    .filter(F.col("f") >= min_count).select("block", "g", "i1", "f", "lang", "word"), "words", settings=many)
    # the words stand in ``words`` by now; of the counts only their number is wanted
    relation, mined = semi_join(raw.select("block", "steps", "member", "counts"), words.select("block", "g", "i1"), 1, many), None
    for k in range(2, longest + 1):
        phrase = [f"i{j}" for j in range(1, k + 1)]
        found = candidates(relation, k - 1)
        if k < longest:
            often = written(found.withColumn("a", F.sum("n").over(W.partitionBy(*phrase))).filter(F.col("a") >= min_count)
                            .select("block", "a", *phrase), "phrases", settings=alone)
            relation = semi_join(relation, often.drop("a"), k, many)
            counted = often.groupBy(*phrase).agg(F.max("a").alias("a"))
        else:
            counted = found.groupBy(*phrase).agg(F.sum("n").alias("a")).filter(F.col("a") >= min_count)
        part = counted.select(F.array(*phrase).alias("ids"), "a")
        mined = part if mined is None else mined.unionByName(part)
    mined = written(mined, "mined", settings=alone)
    heads = words.filter(F.col("i1") == number).select("i1", "lang", "word", "f")
    known = mined.unionByName(heads.select(F.array("i1").alias("ids"), F.col("f").alias("a")))
    scored = best_cuts(uncovered(mined, longest, cover_percent), known)
    sizes = raw.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked(named(scored, heads, longest), sizes, top)


def best_cuts(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase, the earliest of equal ones; 38 digits hold every product exactly.

    Both parts of every cut are frequent, as the phrase is, so their counts are found among the counted phrases.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda j: F.struct(
        j.alias("k"), F.slice("ids", 1, j).alias("first"), F.slice("ids", j + 1, F.size("ids") - j).alias("rest")))
    parts = (phrases.select("ids", "a", F.explode(cuts).alias("c")).select("ids", "a", "c.*")
             .join(known.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first")
             .join(known.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest"))
    a, left, right = (F.col(c).cast("decimal(15,0)") for c in "alr")
    score = F.call_function("div", a * a * F.lit(SCALE).cast("decimal(7,0)"), left * right).cast("long")
    return parts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))


def uncovered(mined: DataFrame, longest: int, cover_percent: int) -> DataFrame:
    """Phrases that no longer one covers: the greatest count of the longer phrases they stand in is looked up."""
    inner = [F.slice("ids", start, size) for size in range(2, longest) for start in range(1, longest - size + 2)]
    if not inner:
        return mined
    inside = (mined.filter(F.size("ids") > 2).select("a", F.size("ids").alias("words"), F.explode(F.array(*inner)).alias("ids"))
              .filter((F.size("ids") < F.col("words"))).groupBy("ids").agg(F.max("a").alias("longer")))
    return (mined.join(inside, "ids", "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a"))).drop("longer"))


def named(mined: DataFrame, heads: DataFrame, longest: int) -> DataFrame:
    """The phrases as text, with their language: the words are looked up by number, one place after the other."""
    names = heads.select(F.col("i1").alias("_id"), "lang", "word")
    out = mined.withColumn("phrase", F.lit(None).cast("string"))
    for at in range(longest):
        out = (out.withColumn("_id", F.get("ids", at)).join(names.drop("lang") if at else names, "_id", "left")
               .withColumn("phrase", F.concat_ws(" ", "phrase", "word")).drop("_id", "word"))
    return out


def ranked(phrases: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language; Spark keeps no more of a language in any task."""
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (phrases.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .join(sizes, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
