"""The numbered queries, each over its whole table, and those that SQL can express in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from delaylake.llm import (
    byte_dedup,
    chat_format,
    lexical_search,
    lm_score,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    secret_scan,
    token_alignment,
    token_count,
    top_k,
    url_filter,
)
from delaylake.llm.common import read
from delaylake.llm.oracle import ORACLE_SQL
from delaylake.workspace import written

#: The conversation that op5 adds, whose texts try to end a turn.
ADDED_CONVERSATION, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"
QUERY_EVERY = 50


def op1_near_dedup(spark, sf_dir):
    return near_dedup.find_near_duplicates(read(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(read(spark, sf_dir, "documents"), path, with_ids=False)


def op3_lm_score(spark, sf_dir):
    return lm_score.lm_scores(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )


def op5_chat_formatting(spark, sf_dir):
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(ADDED_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED_TEXT).alias("text"),
    )
    log = chat_format.log_of(given.unionByName(added))
    back = chat_format.read_back(written(chat_format.format_chats(log), "chats"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_top_k(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


def op8_quality_rules(spark, sf_dir):
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_counts(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_count.token_counts(read(spark, sf_dir, "documents"), path)


def op10_suffix_dedup(spark, sf_dir):
    found = byte_dedup.without_repeats(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_lexical_search(spark, sf_dir):
    documents, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return lexical_search.rank_documents(documents, items)


def op12_token_alignment(spark, sf_dir):
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(read(spark, sf_dir, "documents"), *paths)


def op13_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    labelled = url_filter.labelled_urls(pages, read(spark, sf_dir, "labels"))
    return url_filter.judge_urls(pages, labelled)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_lm_score": op3_lm_score,
    "op4_secret_scan": op4_secret_scan,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_mixing": op6_mixing,
    "op7_top_k": op7_top_k,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_url_filter": op13_url_filter,
}
