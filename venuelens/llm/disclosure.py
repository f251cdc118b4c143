"""Personal data: patterns of protected entities, and terms that give those entities away.

Base entities (mail and network addresses, card and phone numbers) are found by pattern. How much a term near an entity
tells about it is estimated from the corpus: with N documents, f(e) of them naming the entity, f(t) having the term and
f(t, e) having the term within a few terms of the entity, the entity holds log2(N / f(e)) bits, and the term gives
log2(N f(t, e) / (f(t) f(e))) of them away. Terms that give away at least half are generalised, terms that give away
at least three quarters are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import map_rows, narrow, written
from venuelens.operators.skew import spread_join

KINDS = ("email", "ip", "card", "phone")
NEAR_TERMS = 10
MIN_CONTEXTS = 3
GENERALISE_SHARE = 0.5
REMOVE_SHARE = 0.75

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAIL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# no attempt starts inside a run of digits or is tried again with fewer of them: both would fail as the first did, in quadratic time
MAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TERMS = re.compile(TERM)
LOWER = {c: c + 32 for c in range(65, 91)}

SCANNED = ("doc_id long, base array<struct<kind: string, start: long, end: long>>, "
           "near array<struct<entity: string, term: string, context: long, start: long, end: long>>, text string")


def mails(text: str) -> Iterator[tuple[int, int, str]]:
    """Mail addresses from left to right: each is looked for around its @, so that no part of the text is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(MAIL_CHARS))
        host = MAIL_HOST.match(text, at + 1) if start < at else None
        done = host.end() if host else at + 1
        if host:
            yield start, done, text[start:done].translate(LOWER)
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[::-2]))) % 10 == 0


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of all base entities, by start and then kind as listed."""
    found = [("email", *m) for m in mails(text)]
    if re.search("[0-9]", text):
        for m in ADDRESS.finditer(text):
            if all(map(octet, m[0].split("."))):
                found.append(("ip", *m.span(), m[0]))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span(), digits))
        for m in PHONE.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 9 <= len(digits) <= 15:
                found.append(("phone", *m.span(), digits))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def context_terms(text: str, found: list[tuple[str, int, int, str]], near: int) -> list[tuple[str, str, int, int, int]]:
    """(entity, term, context, start, end) of the ``near`` terms before and after each entity, terms inside entities left out.

    ``context`` is a number of those terms: equal surroundings have equal numbers.
    """
    covered = bytearray(len(text))
    for _, start, end, _ in found:
        covered[start:end] = b"\1" * (end - start)
    terms = [(m.start(), m.end(), m[0].translate(LOWER)) for m in TERMS.finditer(text) if not any(covered[m.start():m.end()])]
    out, first = [], 0
    for kind, start, end, value in found:
        while first < len(terms) and terms[first][0] < start:
            first += 1
        after = first
        while after < len(terms) and terms[after][0] < end:
            after += 1
        around = terms[max(first - near, 0):first] + terms[after:after + near]
        context = int.from_bytes(hashlib.blake2b("\n".join(t[2] for t in around).encode(), digest_size=8).digest(), "little", signed=True)
        out += [(f"{kind}:{value}", term, context, s, e) for s, e, term in around]
    return out


def scan(docs: DataFrame, doc_id: str, text: str, near: int, keep_text: bool) -> DataFrame:
    """Entities of every document and, where there are any, the terms around them; stored, with a name for every row."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc, value in rows:
            body = value or ""
            found = entities(body)
            terms = context_terms(body, found, near) if found else []
            yield (doc, [{"kind": k, "start": s, "end": e} for k, s, e, _ in found],
                   [{"entity": n, "term": t, "context": c, "start": s, "end": e} for n, t, c, s, e in terms],
                   value if keep_text else None)

    found = map_rows(narrow(docs, doc_id=doc_id, text=text), run, SCANNED)
    return written(found.withColumn("row", F.monotonically_increasing_id()), "entities")


def revealing_terms(scanned: DataFrame, docs: DataFrame, text: str, min_contexts: int, generalise: float, remove: float) -> DataFrame:
    """(entity, term, removed, share): terms that give away at least ``generalise`` of an entity's information.

    Documents are counted as rows. A pair counts only if it is seen in ``min_contexts`` different surroundings: copies
    of one passage are one observation. A pair, an entity and a term are counted once per document before the shuffle.
    """
    naming = scanned.filter(F.size("near") > 0)

    def each(of: Column, *keys: str) -> DataFrame:
        """Rows of each document for the different values of ``of``, counted over documents by ``keys``."""
        return naming.select(F.explode(F.array_distinct(of)).alias("n")).groupBy(*[f"n.{k}" for k in keys]).agg(F.count("*").alias("docs_of"))

    pairs = each(F.transform("near", lambda n: F.struct(n.entity.alias("entity"), n.term.alias("term"))), "entity", "term")
    surroundings = each(F.transform("near", lambda n: F.struct(n.entity.alias("entity"), n.term.alias("term"), n.context.alias("context"))),
                        "entity", "term", "context")
    often = surroundings.groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= min_contexts)
    named = each(F.transform("near", lambda n: F.struct(n.entity.alias("entity"))), "entity")
    having = (docs.select(F.explode(F.array_distinct(F.regexp_extract_all(lowered(text), F.lit(f"({TERM})"), F.lit(1)))).alias("term"))
              .groupBy("term").agg(F.count("*").cast("double").alias("t")))
    wanted = written(pairs.withColumnRenamed("docs_of", "te").join(often, ["entity", "term"])
                     .join(named.withColumnRenamed("docs_of", "e"), "entity"), "pairs")
    total = F.broadcast(scanned.agg(F.count("*").cast("double").alias("n")))  # one row
    told = F.log2(F.col("n") * F.col("te") / (F.col("t") * F.col("e")))
    held = F.log2(F.col("n") / F.col("e"))
    return (wanted.join(having, "term").join(total).withColumn("share", F.when(held > 0, told / held))
            .filter(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("removed"), "share"))


def lowered(text: str) -> Column:
    capitals = "".join(map(chr, LOWER))
    return F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), capitals, capitals.lower())


def disclosing_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: int = NEAR_TERMS,
                     min_contexts: int = MIN_CONTEXTS, generalise_share: float = GENERALISE_SHARE,
                     remove_share: float = REMOVE_SHARE, keep_text: bool = False) -> DataFrame:
    """One row per document row: ``base`` (kind, start, end) spans of entities and ``terms`` (start, end, removed) spans.

    Spans count code points, ends are exclusive. Terms are words of letters, digits and characters beyond ASCII, in
    lower case A-Z, within ``near`` terms of an entity of the same document and outside all entities; ``terms``
    has those that give an entity away. Estimates come from all documents. A null or empty text has no spans; rows with equal
    or null ids are judged one by one (and counted one by one); texts of any length are read whole; an empty table gives
    no rows; other columns are not read. ``keep_text`` adds the text.
    """
    scanned = scan(docs, doc_id, text, near, keep_text)
    told = written(revealing_terms(scanned, docs, text, min_contexts, generalise_share, remove_share), "revealing")
    places = scanned.filter(F.size("near") > 0).select("row", F.explode("near").alias("n")).select("row", "n.entity", "n.term", "n.start", "n.end")
    # the same entity may stand in a third of all documents, so its rows are spread
    hits = (spread_join(places, told.drop("share"), ["entity", "term"])
            .groupBy("row", "start", "end").agg(F.max("removed").alias("removed"))
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "removed"))).alias("terms")))
    none = F.array().cast("array<struct<start: bigint, end: bigint, removed: boolean>>")
    return (scanned.join(hits, "row", "left").withColumn("terms", F.coalesce("terms", none))
            .select("doc_id", "base", "terms", *(["text"] if keep_text else [])))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, text) of all document rows: entities replaced by their kind, revealing terms generalised or removed.

    A generalised term becomes ``[WORD]``, ``[NUMBER]`` or ``[CODE]`` (letters and digits), a removed one goes. Null texts stay null.
    """
    def run(rows):
        for doc, base, terms, value in rows:
            cuts = sorted([(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
                          + [(t["start"], t["end"], "" if t["removed"] else general(value[t["start"]:t["end"]])) for t in terms])
            out, at = [], 0
            for start, end, new in cuts:
                # entities of different kinds can overlap: the rest of a later one goes with the earlier
                out += [value[at:start], new] if start >= at else []
                at = max(at, end)
            yield doc, None if value is None else "".join(out) + value[at:]

    spans = disclosing_spans(docs, doc_id, text, keep_text=True, **settings)
    return map_rows(spans.select("doc_id", "base", "terms", "text"), run, "doc_id long, text string")


def general(term: str) -> str:
    digits = sum(c.isdigit() for c in term)
    return "[NUMBER]" if digits == len(term) else "[CODE]" if digits else "[WORD]"


def span_digest(spans: DataFrame) -> DataFrame:
    """Entities by kind, a digest of their spans, and all spans as text."""
    base = F.transform("base", lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, "term")) for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s.start.alias("start"), rank[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))),
                                  F.transform("terms", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("rank"), s.end.alias("end"), F.lit("term").alias("kind")))))
    kinds = F.transform("base", lambda s: s.kind)
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(every, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",").alias("spans"),
                        F.size("terms").cast("long").alias("n_terms"))
