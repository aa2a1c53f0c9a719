"""Collocations against a plain count over the same texts."""

import re
from collections import Counter

import pytest

from cohortlab.llm import phrases

SCHEMA = "doc_id long, text string, lang string, block string, k string, phrase string, f string, bucket string"


def plain(rows, least, top=2_000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cands.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i:i + size]] = max(longest[p[i:i + size]], a)
        found = []
        for p, a in cands.items():
            score, j = min((2_000_000 * a // (f[p[:j]] + f[p[j:]]), j) for j in range(1, len(p)))
            if 100 * longest[p] < 80 * a or p not in longest:
                found.append((-score, -a, " ".join(p).encode(), j, p))
        for rank, (score, a, text, j, p) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, text.decode(), -a, f[p[:j]], f[p[j:]], totals[lang], -score))
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows(texts):
    langs = ["en", None, "de", "und", ""]
    odd = [(None, "Red fox. red  fox\tRUNS, red fox runs far\nred\x0bfox", None), (1, "a a a a a a a a", "en"), (1, "a a a a a a a a", "en"),
           (2, "É É É é É É, É É", "de"), (3, ". , ; ! ?", "en"), (4, "x\x00y x\x00y x\x00y z x\x00y x\x00y", "en")]
    return odd + [(d, t, langs[i % 5] if i % 3 else "en") for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"bits": 9}, {"block_bytes": 20_000}])
def test_equals_a_plain_count(table, rows, options):
    """Also with so few bits that many phrases share a fingerprint, and with many blocks."""
    want = plain(rows, 3)
    assert len(want) > 100
    assert got(phrases.collocations(phrases.phrase_counts(table, min_count=3, **options))) == want


def test_only_the_first_of_a_language(table, rows):
    counts = phrases.phrase_counts(table, min_count=3)
    assert got(phrases.collocations(counts, top=4)) == plain(rows, 3, 4)


def test_long_texts_are_cut_between_pieces(spark):
    """One text of 2.4 MB with pieces, one without a single break."""
    rows = [(1, "some words here, and there. " * 85_000, "en"), (2, "no end of it " * 60_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert got(phrases.mine(df)) == plain(rows, 30)


def test_empty_tables(spark, nothing):
    assert phrases.mine(nothing).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "en"), (None, " \n", "en")], "doc_id long, text string, lang string")
    assert phrases.mine(blank).collect() == []


def test_products_beyond_64_bits(spark):
    big = 2**62
    counts = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 7)],
                                   "lang string, k int, phrase string, f long")
    assert got(phrases.collocations(counts)) == [("en", 1, "a b", big - 7, big, big, big, 2_000_000 * (big - 7) // (2 * big))]
