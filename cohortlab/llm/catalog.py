"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from cohortlab.llm import (
    embeddings, lm_scores, mixing, near_duplicates, phrases, pieces, prefix_tries, quality, secrets, substrings, suffixes, token_shards,
    toxicity,
)
from cohortlab.llm.common import table
from cohortlab.llm.oracles import SQL as ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {}


def query(run):
    """Register a query under its function's name."""
    QUERIES[run.__name__] = run
    return run


@query
def op1_mixing(spark, folder):
    return mixing.plan_mix(table(spark, folder, "documents"))


@query
def op4_quality_rules(spark, folder):
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_toxicity(spark, folder):
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_secrets(spark, folder):
    return secrets.report(table(spark, folder, "documents"))


@query
def op8_sentencepiece(spark, folder):
    return pieces.encode(table(spark, folder, "documents"))


@query
def op3_substring_dedup(spark, folder):
    return substrings.report(table(spark, folder, "documents"))


@query
def op2_minhash_near_dedup(spark, folder):
    return near_duplicates.report(table(spark, folder, "documents"), k=2)


@query
def op6_embedding_near_dedup(spark, folder):
    return embeddings.links(table(spark, folder, "embeddings"))


@query
def op9_lm_scores(spark, folder):
    return lm_scores.score(table(spark, folder, "documents"))


@query
def op10_suffix_dedup(spark, folder):
    return suffixes.report(table(spark, folder, "documents"))


@query
def op13_collocations(spark, folder):
    return phrases.mine(table(spark, folder, "documents"))


@query
def op12_token_shards(spark, folder):
    return token_shards.checksums(token_shards.write_shards(table(spark, folder, "documents")))


@query
def op11_prefix_trie(spark, folder):
    return prefix_tries.report(table(spark, folder, "conversations"))
