"""The registered queries: each applies one operator to a whole table and keeps the columns of its contract."""

from __future__ import annotations

from venuelens.llm import (chat, collocations, compact_windows, crf, disclosure, hnsw, jaccard, license_scan, mixing, oracles, packing, periodic_runs,
                           prefix_tokens, repetition)
from venuelens.llm.common import table
from venuelens.llm.registry import ORACLES, QUERIES, query  # noqa: F401


@query("op1_license_scan")
def op1(spark, sf):
    return license_scan.license_scan(table(spark, sf, "documents")).drop("places")


@query("op3_mixing")
def op3(spark, sf):
    placed, pieces = mixing.mix(table(spark, sf, "documents"))
    return mixing.taken_words(placed, pieces).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "n_slots")


@query("op5_quality_rules")
def op5(spark, sf):
    return repetition.quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "longest_repeat")


@query("op7_line_quality")
def op7(spark, sf):
    return crf.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_chat_round_trip")
def op8(spark, sf):
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(turns.unionByName(extra)).drop("formatted", "loss_mask")


@query("op9_token_counts")
def op9(spark, sf):
    return prefix_tokens.token_counts(table(spark, sf, "documents"))


@query("op6_harmonic_packing")
def op6(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op4_jaccard_join")
def op4(spark, sf):
    return jaccard.similar_sets(table(spark, sf, "documents"))


@query("op2_embedding_near_dup")
def op2(spark, sf):
    return hnsw.near_vectors(table(spark, sf, "embeddings"))


@query("op10_repeated_passages")
def op10(spark, sf):
    return compact_windows.repeated_passages(table(spark, sf, "documents"))


@query("op13_periodic_runs", oracles.PERIODIC_RUNS)
def op13(spark, sf):
    return periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.repeated_tails(table(spark, sf, "documents"))))


@query("op11_personal_data")
def op11(spark, sf):
    return disclosure.span_digest(disclosure.disclosing_spans(table(spark, sf, "documents")))


@query("op12_collocations", oracles.COLLOCATIONS)
def op12(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))
