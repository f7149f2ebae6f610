"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers

from .common import table
from . import byte_bpe, exact_dedup, fingerprints, jaccard_join, mixing, phrases, secrets, simhash_join, substring_dedup, token_files, toxicity, vector_codes, warc


def op1_jaccard_join(spark, sf_dir):
    return jaccard_join.Similarity(3, 90, 100).join(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.dedup_passages(table(spark, sf_dir, "documents")))


def op9_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True, texts=False)


def op11_simhash_join(spark, sf_dir):
    return simhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql():
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op5_warc": warc.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_phrases": phrases.ORACLE}
