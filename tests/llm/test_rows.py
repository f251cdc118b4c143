"""Operators that judge a document by itself: repetition, licenses, token counts, packing, quality scores."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_data import EDGES, LONG, frame, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from venuelens.llm import chat, crf, license_scan, packing, prefix_tokens, repetition


def repeats_by_hand(words, least):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= least else 0)
    return out


def test_longest_repeats_match_brute_force():
    rng = random.Random(5)
    for turn in range(120):
        docs = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(3)]
        if turn % 9 == 0:
            docs[1] = ["a"] * 30
        ids = np.array([ord(w) for d in docs for w in d], np.int64)
        doc = np.repeat(np.arange(3), [len(d) for d in docs])
        for least in (1, 2, 3, 5, 8):
            assert repetition.longest_repeats(ids, doc, least).tolist() == [n for d in docs for n in repeats_by_hand(d, least)]


def test_quality_rules_on_edges(edges, nothing):
    rows = repetition.quality_rules(edges).collect()
    assert len(rows) == len(EDGES)
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert (by_id[i].n_words, by_id[i].word_chars, by_id[i].base_failed, by_id[i].kept) == (0, 0, True, False)
    assert by_id[6].kept and by_id[6].n_words == 30_000
    same = by_id[11]
    assert (same.n_words, same.n_repeat_words, same.longest_repeat, same.kept) == (400, 400, 399, False)
    assert [tuple(s) for s in same.repeat_spans] == [(0, 400)]
    assert repetition.quality_rules(nothing).collect() == [] and repetition.kept_documents(nothing).collect() == []
    kept = repetition.kept_documents(edges)
    assert kept.columns == edges.columns
    assert kept.count() == sum(r.kept for r in rows)


def test_quality_counts_by_hand(spark):
    text = "a#b $ c\nsame line\n\nsame line\n éé \n" + "w " * 3
    r = repetition.quality_rules(frame(spark, [(1, text, "s")])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (11, 3 + 1 + 1 + 8 + 8 + 2 + 3, 2, 1)


def test_license_base_counts_and_templates(spark, edges, nothing):
    text = ("x Released under the MIT-License. Licensed UNDER the terms of the Apache License, version 2.0 CC-BY-NC 4.0 "
            "All rights\nreserved under the mit license")
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, n) for p, n in license_scan.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    r = license_scan.license_scan(frame(spark, [(1, text, "s")])).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places)[0], max(places)[0])
    assert r.base_labels == "apache-2,cc-by-nc,mit"
    assert set(r.labels.split(",")) == {"apache-2", "cc-by-nc", "mit", "apache-2.0-grant", "all-rights-reserved", "mit-grant"}
    rows = {x.doc_id: x for x in license_scan.license_scan(edges).collect()}
    assert (rows[1].n_words, rows[1].first_word, rows[1].labels, rows[1].score) == (0, None, "", 0.0)
    assert license_scan.license_scan(nothing).collect() == []


def test_license_automaton_accepts_exact_wording_only():
    a = license_scan.Automaton({"t": "alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> "
                                     "<<var;min=1;max=2>> delta"})
    for text, ends in {"alpha x delta": 3, "alpha beta x delta": 4, "alpha beta gamma x y delta": 6, "alpha gamma delta": 3,
                       "alpha delta": None, "alpha x y z delta": None, "alpha beta gamma x y z delta": None}.items():
        found = a.places(text.encode().split())
        assert (found[0][2] if found else None) == ends, text
    with pytest.raises(ValueError):
        license_scan.Automaton({"t": "<<var;min=0;max=1>> a"})


def test_full_license_text_is_found(spark):
    body = " ".join(license_scan.TEMPLATES["mit-text"].replace("<<var;min=1;max=12>>", "2020 some holder").split())
    body = re.sub(r"<<[^>]*>>", "", body)
    good, bad = f"x {body.upper()} y", body.replace("granted", "given")
    rows = license_scan.license_scan(frame(spark, [(1, good, "s"), (2, bad, "s")])).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "mit-text", 2: ""}


@pytest.mark.parametrize("label", sorted(license_scan.TEMPLATES))
def test_every_template_needs_its_wording_to_the_end(label):
    a = license_scan.Automaton(license_scan.TEMPLATES)
    markup = license_scan.TEMPLATES[label]
    filled = re.sub(r"<<var;min=(\d+);max=(\d+)>>", lambda m: " ".join(f"holder{i}" for i in range(int(m[2]))) if int(m[1]) < int(m[2]) else "3", markup)
    plain = re.sub(r"<<[^>]*>>", " ", filled).split()
    assert label in {n for n, _, _ in a.places([w.encode() for w in plain])}
    # a word of the mandatory wording changed or missing, the last one included
    bare = re.sub(r"<<beginOptional>>.*?(<<endOptional>>)+", " ", re.sub(r"<<var[^>]*>>", " ", markup), flags=re.S)
    mandatory = set(re.sub(r"<<[^>]*>>", " ", bare).split())
    for at in {len(plain) // 2, len(plain) - 1}:
        if plain[at] in mandatory:
            for changed in (plain[:at] + ["changed"] + plain[at + 1:], plain[:at] + plain[at + 1:]):
                assert label not in {n for n, _, _ in a.places([w.encode() for w in changed])} or label == "gpl-grant"


def test_every_prefix_count_equals_the_library():
    counter = prefix_tokens.PrefixCounter(public_tokenizers.path(prefix_tokens.MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(prefix_tokens.MODEL))
    for text in ["Hello  world\n\n a tést 日本 <s> </s> ▁x \U0001f600\U0001f600 <0x0A>\t ab", " ", "\n", "", "   a", "a   ", "123456 can't", prose(3, 60)]:
        counts = counter.all_prefixes(text)
        assert counts == [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
        segments = counter.segments(text)
        borders = counter.border_counts(segments)
        for limit in (0, 1, 2, 5, 11):
            assert counter.longest_prefix(segments, borders, limit) == max(i for i, c in enumerate(counts) if c <= limit)


def test_borders_of_tokens_replay_the_merges_of_either_token():
    counter = prefix_tokens.counter_of(public_tokenizers.path(prefix_tokens.MODEL))
    # the tasks of one Python process share it
    assert counter is prefix_tokens.counter_of(public_tokenizers.path(prefix_tokens.MODEL))
    rng = random.Random(5)
    numbers = [*range(1, len(counter.tokens)), *[len(counter.tokens) + ord(c) for c in "\t\x00\U0001f600☃"]]
    for left, right in [(rng.choice(numbers), rng.choice(numbers)) for _ in range(3000)]:
        one, two = counter.text_of(left), counter.text_of(right)
        assert counter.apart(left, right) == (counter.merge(one + two) == [one, two])
        assert counter.apart(0, right) == (counter.merge(two) == [two])
    # no merging per pair of neighbours, but one per token at most
    made = []
    plain = counter.merging
    counter.merging = lambda text: made.append(text) or plain(text)
    for word in prose(4, 2000).split():
        counter.prefixes(" " + word)
    assert len(made) == len(set(made)) and set(made) <= {counter.text_of(n) for n in counter.edges}
    del counter.merging


def test_token_counts_on_edges(edges, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(prefix_tokens.MODEL))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in prefix_tokens.token_counts(edges).collect())
    want = sorted((i or -1, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in EDGES)
    assert got == want
    assert prefix_tokens.token_counts(nothing).collect() == []
    table = {r.doc_id: r.counts for r in prefix_tokens.prefix_table(edges.filter("doc_id IN (1, 5)")).collect()}
    assert table[1] == [0] and table[5][-1] == len(sp.encode("one two three four"))


def test_packing_keeps_every_id_once(spark, edges, nothing):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    pieces = packing.pack(edges, with_ids=True).collect()
    bins: dict[int, list] = {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        bins.setdefault(p.sequence_id, []).append(p)
    for own in bins.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
    padded = sum(packing.CAPACITY - sum(p.length for p in own) for own in bins.values())
    assert padded <= 0.05 * packing.CAPACITY * len(bins)
    for doc in {p.doc_id for p in pieces if p.doc_id not in (None, 7)}:
        ids = [i for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start) for i in p.ids]
        text = next(t for i, t, _ in EDGES if i == doc) or ""
        assert ids == tok.encode(text, add_special_tokens=False).ids + [0]
    assert sum(p.length for p in pieces if p.doc_id == 7) == 2 * sum(p.length for p in pieces if p.doc_id == 6)
    assert packing.pack(nothing).collect() == []


def test_chunks_encode_like_the_library():
    e = packing.ChunkEncoder(public_tokenizers.path(packing.MODEL))
    for text in ["a  b", "\n  def", " x ", "a\x1cb", "<|endoftext|> x", "don't  'll ²③   x y  z", "  ", "\r\n\t a", "日本語 ё̈ é",
                 "it's, ok!! word...'s", LONG[:5000]]:
        assert e.encode(text) == e.whole(text)


def test_forward_backward_matches_enumeration():
    import itertools
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5, 2])
    score, move = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    marginal, expected, total = crf.forward_backward(score, sizes, move)
    at, moves, log = 0, np.zeros((2, 2)), 0.0
    for s in sizes[sizes > 0]:
        weights, good, own = 0.0, np.zeros(s), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(s)):
            w = np.exp(score[at:at + s] @ np.array(y) + sum(move[y[i - 1], y[i]] for i in range(1, s)))
            weights += w
            good += w * np.array(y)
            for i in range(1, s):
                own[y[i - 1], y[i]] += w
        assert np.allclose(good / weights, marginal[at:at + s])
        moves += own / weights
        log += np.log(weights)
        at += s
    assert np.allclose(moves, expected) and np.isclose(log, total)


def test_quality_scores_on_held_out_rows(spark, nothing):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = crf.quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert crf.quality_scores(nothing, labels).collect() == []


def test_quality_scores_without_labels(spark, edges):
    none = spark.createDataFrame([(1, None), (2, 5)], "doc_id long, quality int")
    rows = crf.quality_scores(edges, none).collect()
    assert len(rows) == len(EDGES) and {r.score for r in rows} == {0.5}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)


def test_turns_survive_the_round_trip():
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]", "\\", "<", "[", "s>", "INST]", " ", "\n", "x",
            "ROLE:", "]", "SYS>>", "/"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "system", "assistant", "tool", "", "a]b\\"]), "".join(rng.choices(bits, k=rng.randint(0, 7))))
                 for _ in range(rng.randint(1, 4))]
        formatted = "".join(chat.format_turn(*t) for t in turns)
        assert chat.parse(formatted) == turns
        for role, text in turns:
            assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.search(chat.escape(text))


def test_conversations_read_back(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", probe), (1, None, "system", None), (2, 1, "user", "q"), (2, 1, "user", "q"), (None, 1, None, ""),
            (3, 1, "assistant", probe), (3, 2, "assistant", "x" * 100_000)]
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r.conv_id: r for r in chat.format_conversations(c, with_text=True).collect()}
    assert got.keys() == {1, 2, 3, None}
    assert chat.parse(got[1].formatted) == [("system", ""), ("user", probe), ("assistant", "b")]
    assert got[1].turns_sha256 == hashlib.sha256(f"system\n\nuser\n{probe}\nassistant\nb\n".encode()).hexdigest()
    assert got[2].n_turns == 2 and got[None].n_turns == 1 and got[2].loss_chars == 0
    loss = probe + "x" * 100_000
    assert (got[3].loss_chars, got[3].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    r = got[3]
    assert "".join(chat.unescape(r.formatted[m.start:m.end]) for m in r.loss_mask) == loss and r.formatted_chars == len(r.formatted)
    assert chat.format_conversations(c.filter(F.lit(False))).collect() == []


def test_line_ends_and_marks_are_encoded_apart_from_words(monkeypatch):
    e = packing.ChunkEncoder(public_tokenizers.path(packing.MODEL))
    whole, asked = e.whole, []
    monkeypatch.setattr(e, "whole", lambda text: asked.append(text) or whole(text))
    e.encode("Was\nWas, the\nthe.\nÉté")
    assert "\nWas," not in asked and set(asked) <= {"\n", ",", "."}
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 8)
    small = packing.ChunkEncoder(public_tokenizers.path(packing.MODEL))
    rng = random.Random(7)
    parts = ["a", "Be", " word", "é", "ɏ", " ", "\n", "\n\n", "\t", "\r", ".", ",", "!?", "'s", "1", "ß", "ǅ", "日", "\x1c", "<s>", "_", "x" * 50]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert e.encode(text) == small.encode(text) == whole(text)
        assert len(small.known) <= 8 and len(small.known.old) <= 8
