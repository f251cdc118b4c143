"""Periodic runs, personal data and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_data import EDGES, LONG, frame, prose

from venuelens.llm import collocations, common, disclosure, periodic_runs


# ---- periodic runs ------------------------------------------------------------------------

def runs_by_hand(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        s = 0
        while s < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            n = e - s + q
            if e > s and n >= max(least, exponent * q) and not any(all(w[s + i] == w[s + i + d] for i in range(n - d)) for d in range(1, q)):
                out.append((s, n, q))
            s = max(e, s) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k = rng.choice([1, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
    if rng.random() < 0.6:
        p, at = rng.randint(1, 7), rng.randint(0, len(w))
        w[at:at] = [10 * (rng.random() < 0.02) + i % p for i in range(rng.randint(5, 40))]
    return w


def test_runs_of_small_alphabets_match_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        w = some_words(rng)
        for least, exponent in ((6, 4), (2, 2), (4, 3)):
            assert sorted(periodic_runs.runs_of(w, least, exponent), key=lambda r: (r[0], r[2])) == runs_by_hand(w, least, exponent)


def test_stretches_lose_no_run_and_join_no_documents():
    rng = random.Random(2)
    for _ in range(300):
        docs = [some_words(rng) for _ in range(3)]
        ids = np.array([x for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(3), [len(d) for d in docs])
        starts = np.cumsum([0] + [len(d) for d in docs])
        got = []
        for s, e in periodic_runs.stretches(ids, doc, 6, 4):
            assert doc[s] == doc[e - 1]
            got += [(s + a, n, q) for a, n, q in periodic_runs.runs_of(ids[s:e].tolist())]
        assert sorted(got) == sorted((int(o) + a, n, q) for o, d in zip(starts, docs) for a, n, q in runs_by_hand(d))


def test_long_regular_texts_stay_cheap():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    assert periodic_runs.runs_of(fib[-1][:20_000]) == []
    assert periodic_runs.runs_of([7] * 20_000) == [(0, 20_000, 1)]
    assert periodic_runs.runs_of(list(range(500)) * 40) == [(0, 20_000, 500)]


def digest_by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digest_on_edges_and_planted_tails(spark, edges, nothing):
    few = [(i, prose(i, 12) + " é 日本 " * (i % 9), "s") for i in range(120, 220)] + [(300, "a b c " * 9 + "x y " * 3 + "z " * 7, "s"), (-40, "q " * 11, "s")]
    rows = [r for r in EDGES if r[1] is not LONG] + few
    out = periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.repeated_tails(frame(spark, rows))))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted((digest_by_hand(i, t) for i, t, _ in rows), key=repr)
    whole = periodic_runs.periodic_runs(edges).collect()
    assert len(whole) == len(EDGES) and {r.n_words for r in whole if r.doc_id == 7} == {30_000}
    assert [r.collapsed for r in whole if r.doc_id == 11] == ["same"]
    assert periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.repeated_tails(nothing))).collect() == []


# ---- personal data ------------------------------------------------------------------------

def entities_by_hand(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(2 * x if x < 5 else 2 * x - 9 for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda f: (f[1], disclosure.KINDS.index(f[0])))


def test_entities_match_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        letters = rng.choice(["ab1.@", "a@.-é", "012.", "0123456789 -.", "+1 ().-0", "0 -+.@a"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert [f[:3] for f in disclosure.entities(text)] == entities_by_hand(text)
    texts = {"card": "4111 1111-1111 1111", "ip": "255.0.00.1", "phone": "+1 (456) 555-2186", "email": "A.b+c@x.y-z.co"}
    for kind, text in texts.items():
        assert kind in [f[0] for f in disclosure.entities(f"é {text} x")]


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "a@" * 90_000, "1." * 90_000, "+1" * 90_000, "9" * 5000 + ".1.1.1"])
def test_long_unlucky_texts_take_linear_time(text):
    assert all(f[2] <= len(text) for f in disclosure.entities(text))


def corpus():
    """Ann's mail stands beside 'zebra', which hardly anyone else uses; 'common' stands everywhere; copies of one text repeat 'quokka'."""
    docs = [(i, f"{prose(i, 30)} common zebra ann@mail.org common {prose(500 + i, 30)}", "s") for i in range(5)]
    docs += [(20 + i, f"{prose(700, 30)} quokka common 10.0.0.1 common {prose(701, 30)}", "s") for i in range(6)]
    docs += [(100 + i, f"common {prose(1000 + i, 40)} " + ("zebra" if i == 0 else ""), "s") for i in range(80)]
    return docs


def shares_by_hand(docs, near=10, least=3):
    words = lambda t: [(m.start(), m.end(), m[0].translate(disclosure.LOWER)) for m in re.finditer(disclosure.TERM, t or "")]
    together, contexts, named = Counter(), {}, Counter()
    having = Counter(t for _, text, _ in docs for t in {w[2] for w in words(text)})
    places = {}
    for row, (_, text, _) in enumerate(docs):
        found = disclosure.entities(text or "")
        inside = {i for f in found for i in range(f[1], f[2])}
        free = [w for w in words(text) if not inside & set(range(w[0], w[1]))]
        seen = set()
        for kind, s, e, value in found:
            around = [w for w in free if w[0] < s][-near:] + [w for w in free if w[0] >= e][:near]
            for w in around:
                key = (f"{kind}:{value}", w[2])
                seen.add(key)
                contexts.setdefault(key, set()).add(tuple(x[2] for x in around))
                places.setdefault(key, set()).add((row, w[0], w[1]))
        together.update(seen)
        named.update({k for k, _ in seen})
    n = len(docs)
    share = {k: np.log2(n * together[k] / (having[k[1]] * named[k[0]])) / np.log2(n / named[k[0]]) for k in together if len(contexts[k]) >= least}
    return share, places


def test_revealing_terms_match_brute_force(spark):
    docs = corpus()
    share, places = shares_by_hand(docs)
    want = {}
    for key, value in share.items():
        for row, s, e in places[key] if value >= 0.5 else ():
            want[row, s, e] = want.get((row, s, e), False) or value >= 0.75
    got = {}
    for r in disclosure.disclosing_spans(frame(spark, docs)).collect():
        row = [d[0] for d in docs].index(r.doc_id)
        got |= {(row, t.start, t.end): t.removed for t in r.terms}
    assert got == want and want
    terms = {docs[row][1][s:e] for row, s, e in want}
    # six copies of one text are one observation, a common word tells nothing
    assert "zebra" in terms and "quokka" not in terms and "common" not in terms
    clean = dict(disclosure.sanitised(frame(spark, docs)).collect())
    assert "[EMAIL]" in clean[0] and "ann@" not in clean[0] and "zebra" not in clean[0] and "[IP]" in clean[20] and "quokka" in clean[20]
    assert clean[100] == docs[11][1]


def test_personal_data_on_edges(spark, edges, nothing):
    rows = disclosure.span_digest(disclosure.disclosing_spans(edges)).collect()
    assert len(rows) == len(EDGES)
    assert all(r.spans == "" and r.n_email == 0 and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    text = "é a@b.cd 1.2.3.4 +1 (456) 555-2186 x 4111111111111111"
    r = disclosure.span_digest(disclosure.disclosing_spans(frame(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s")]))).collect()
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in entities_by_hand(text))
    assert [(x.n_email, x.n_ip, x.n_card, x.n_phone, x.spans, x.base_sha256) for x in r] == [(1, 1, 1, 1, line, hashlib.sha256(line.encode()).hexdigest())] * 3
    assert disclosure.disclosing_spans(nothing).collect() == [] and disclosure.sanitised(nothing).collect() == []
    assert sorted(map(tuple, disclosure.sanitised(edges).collect()), key=repr) == sorted(((i, t) for i, t, _ in EDGES), key=repr)


# ---- collocations -------------------------------------------------------------------------

def collocations_by_hand(docs, least, top, longest=3, cover=50):
    counts, sizes = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(disclosure.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest, block", [(2, 10 ** 6), (3, 10 ** 6), (4, 40), (3, 25)])
def test_collocations_match_brute_force(spark, monkeypatch, longest, block):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "OPEN_WORDS", 2 * block)
    rng = random.Random(longest)
    vocabulary = ["red", "Fox", "é", "the", "of", "日本", "x-y"]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randint(0, 30))]
        docs.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(words) + rng.choice(["", " the red fox", "!"])))
    docs += [("fr", None), ("fr", ""), (None, " ... "), ("en", "the red fox " * 30), ("en", "the red fox " * 30)]
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n long, rank string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, longest=longest, min_count=5, top=12).collect()))
    assert got == collocations_by_hand(docs, 5, 12, longest)


def test_collocations_on_edges(spark, edges, nothing):
    assert collocations.collocations(nothing).collect() == []
    got = sorted(map(tuple, collocations.collocations(edges, min_count=10).collect()))
    assert got == collocations_by_hand([("en", t) for _, t, _ in EDGES], 10, 2000)
    assert got and got[0][0] == "en"


def test_blocks_of_words_are_stored_shuffled_and_sent_few_at_once(spark, monkeypatch):
    import pyarrow.dataset as ds

    rows = spark.range(0, 40, 1, 1).selectExpr("id", "transform(sequence(0, 999), i -> xxhash64(id, i)) AS own")
    stored = common.written(rows, "wide", {**common.WIDE_ROWS, "parquet.block.size": 1 << 14})
    files = list(ds.dataset(stored.stored_at.removeprefix("file://")).get_fragments())
    assert sum(f.metadata.num_row_groups for f in files) >= 20 and sorted(stored.collect()) == sorted(rows.collect())
    seen = {}

    def kept(df, name, options=None, settings=None):
        seen.setdefault(name, []).append((df.sparkSession.conf.get(common.PARTITIONS), options, settings, df._jdf.queryExecution().optimizedPlan().toString()))
        return common.written(df, name, options, settings)

    monkeypatch.setattr(collocations, "written", kept)
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 20)
    before = {k: spark.conf.get(k, None) for k in (common.PARTITIONS, common.ROWS_SENT)}
    docs = spark.createDataFrame([("the red fox " * 3 + ".") for _ in range(300)], "string").toDF("text").selectExpr("text", "'en' AS lang")
    assert collocations.collocations(docs).count() > 0
    assert {k: spark.conf.get(k, None) for k in before} == before
    assert all(options for name in seen if name.startswith("occurrences") for _, options, _, _ in seen[name])
    blocks = 300 // 2
    assert int(seen["words"][0][2][common.PARTITIONS]) >= blocks // 2 and seen["mined"][0][2][common.ROWS_SENT] == "1"
    # the words of a block are not shuffled with its occurrences
    joined = seen["occurrences-1"][1][3]
    assert "FlatMapCoGroupsInArrow" in joined and "words" not in joined.split("Relation")[0].split("FlatMapCoGroupsInArrow")[1].split("Project")[0]


def test_scores_beyond_64_bits(spark):
    big = 10 ** 13
    known = spark.createDataFrame([([1], 3 * big), ([2], 2 * big + 1), ([1, 2], big)], "ids array<long>, a long")
    cut = collocations.best_cuts(known.filter("size(ids) = 2"), known).first().cut
    assert (cut.score, cut.l, cut.r) == (10 ** 6 * big * big // (3 * big * (2 * big + 1)), 3 * big, 2 * big + 1)
