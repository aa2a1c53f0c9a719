"""Corpus preparation in stages; each works on all that the one before wrote.

All stages keep the columns of documents, whatever else the table holds, and give an empty table for an empty one. A missing id, text,
language or source is a value like any other and crashes no stage; repeated rows are documents of their own unless a stage says otherwise.
"""

from __future__ import annotations

from cohortlab.llm import mixing, near_duplicates, pieces, secrets, toxicity
from cohortlab.llm.common import table
from cohortlab.staging import stage


def drop_toxic(spark, docs, sf_dir):
    """Documents that score as toxic go.

    A missing or blank text is not toxic and stays; labels only teach. Equal texts have equal scores, so copies go or stay together.
    """
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the smallest id, a missing id being the largest.

    Texts without a word are no copies of each other and stay, all of them. Of rows equal in id and text one stays.
    """
    return near_duplicates.keep_one(docs)


def hide_secrets(spark, docs, sf_dir):
    """Every document stays; reported spans in texts are replaced by a mark. Other columns keep their values.

    A missing text stays missing, and a text without spans is unchanged, however long.
    """
    return secrets.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them, in the order of training.

    A missing source is a source of its own. A text without a word costs nothing and comes along where its neighbours do; of equal rows each
    takes the copies planned for it.
    """
    return mixing.mix_documents(docs)


def encode_texts(spark, docs, sf_dir):
    """All rows, with ids of their texts; a missing or empty text has none."""
    return pieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("secrets", hide_secrets), ("mixing", mix_sources),
          ("encoding", encode_texts)]
# Learned and hashed stages have no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
