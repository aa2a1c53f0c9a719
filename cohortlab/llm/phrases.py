"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials over the hashes of words give the fingerprint of every phrase of one to four words. A block of documents names each
of its different fingerprints once, with its count; buckets of fingerprints add the counts up and point back to the blocks that hold
a frequent one. Only there are phrases written out, after their words are compared one by one with those of the first phrase of the
same fingerprint; counts are then added up by the phrase itself, so a collision of fingerprints can only cost work. Scores, the dropping
of parts of longer phrases and the ranking are joins and windows over frequent phrases.

Sizes: a block and a bucket hold what BLOCK_BYTES of text give, whatever the table's size; 5 bytes and the bucket's number stand for
a fingerprint. No list of phrases is gathered or broadcast. Texts of more than LONG_TEXT characters are cut at the ends of pieces, which
no phrase crosses, so a hot or endless text is spread over blocks.

Defined cases: NULL and empty texts hold no words; a missing language is `und`, together with documents marked so; repeated rows count
each; a language without a phrase that is frequent enough has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.llm.common import small_batches
from cohortlab.llm.textscan import BASE, CODES, Block, blocks, mix, powers
from cohortlab.staging import stage

BLOCK_BYTES = 8_000_000
LEAST_BLOCKS = 8
LONG_TEXT = 500_000
MIN_COUNT = 30
MAX_WORDS = 4
COVERED = 80
TOP = 2_000
SCALE = 2_000_000
NO_LANG = "und"

# Bytes that end a piece, and those that part words.
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_CUT
_INSIDE[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = rf"(?s).{{{LONG_TEXT},}}?[.,;:!?\x0A-\x0D]|.+"

_KEPT = 40
_MASK = np.uint64(2**_KEPT - 1)
_BITMAP = 22


class Pieces:
    """Words of a block of texts in order, lower-cased, with their pieces and languages."""

    def __init__(self, batch: pa.RecordBatch, bits: int):
        block = Block(batch.column("text"))
        low = _LOWER[block.bytes]
        inside = _INSIDE[low]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        self.piece = np.cumsum(_CUT[low], dtype=np.int32)[start]
        run = block.prefix(CODES[low])
        _, down = powers(len(run))
        hashes = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * BASE)
        names = batch.column("lang").dictionary_encode()
        self.langs = names.dictionary
        self.lang = names.indices.to_numpy(zero_copy_only=False)[np.searchsorted(block.begins, start, "right") - 1] if len(start) else np.zeros(0, np.int32)
        self.seeds = np.array([_text_hash(x) for x in self.langs.to_pylist()], np.uint64)
        up, self.down = powers(len(hashes) + 1)
        self.run = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.run[1:])
        self.drop = np.uint64(64 - bits)
        self.offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        self.letters = low[inside]

    def __len__(self) -> int:
        return len(self.piece)

    def words(self) -> pa.Array:
        return pa.Array.from_buffers(pa.string(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.letters)])

    def fingerprints(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every phrase of k words inside one piece."""
        n = max(0, len(self) - k + 1)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1: k - 1 + n])
        h = mix((self.run[at + k] - self.run[at]) * self.down[at] ^ self.seeds[self.lang[at]] ^ CODES[k]) if len(at) else np.zeros(0, np.uint64)
        return at, h >> self.drop << self.drop


def _text_hash(text: str) -> int:
    out = 0
    for byte in text.encode():
        out = (out * int(BASE) + byte + 1) % 2**64
    return out


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEPT // 8].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) * 8 // _KEPT, 8), np.uint8)
    raw[:, : _KEPT // 8] = np.frombuffer(data, np.uint8).reshape(-1, _KEPT // 8)
    return raw.view("<u8").ravel()


def _leads(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)


def _parts(table: pa.Table, bits: int):
    for batch in table.combine_chunks().to_batches():
        for part in blocks([batch]):
            yield Pieces(part, bits)


def _asks(n: int, max_words: int, bits: int):
    """A block's different fingerprints by bucket: those counted once, and those counted more often with their counts."""
    def ask(table: pa.Table) -> pa.Table:
        h = [p.fingerprints(k)[1] for p in _parts(table, bits) for k in range(1, max_words + 1)]
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        key = np.sort(_bucket(h, n) << np.uint64(_KEPT) | (h & _MASK))
        del h
        lead = np.flatnonzero(_leads(key))
        counts = np.diff(np.concatenate((lead, [len(key)])))
        key = key[lead]
        rows = {"bucket": [], "ones": [], "more": [], "counts": []}
        edges = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(_KEPT))
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if i < j:
                value, count = key[i:j] & _MASK, counts[i:j]
                once = count == 1
                for name, x in (("bucket", b), ("ones", _pack(value[once])), ("more", _pack(value[~once])),
                                ("counts", count[~once].astype("<u4").tobytes())):
                    rows[name].append(x)
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array([block] * len(rows["bucket"]), pa.int32()),
                         **{c: pa.array(rows[c], pa.binary()) for c in ("ones", "more", "counts")}})

    return ask


def _replies(min_count: int):
    """The frequent fingerprints of a bucket, to each block that holds some of them."""
    def reply(table: pa.Table) -> pa.Table:
        ones, more, counts = (table.column(c).to_pylist() for c in ("ones", "more", "counts"))
        values = [_unpack(x) for x in ones + more]
        times = [np.ones(len(x), np.int64) for x in values[: len(ones)]] + [np.frombuffer(c, "<u4").astype(np.int64) for c in counts]
        value, time = np.concatenate(values), np.concatenate(times)
        order = np.argsort(value)
        value, time = value[order], time[order]
        lead = np.flatnonzero(_leads(value))
        frequent = value[lead][np.add.reduceat(time, lead) >= min_count] if len(lead) else value
        hits = []
        for i in range(len(ones)):
            held = [x for x in (values[i], values[len(ones) + i]) if len(x)]
            found = [frequent[x[np.minimum(np.searchsorted(x, frequent), len(x) - 1)] == frequent] for x in held]
            hits.append(_pack(np.concatenate(found)) if found else b"")
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "hits": pa.array(hits, pa.binary())})

    return reply


def _tallies(n: int, max_words: int, bits: int):
    """A block's counts of frequent phrases by their text, and of all its words."""
    def held(replies: pa.Table) -> np.ndarray:
        keys = [np.uint64(b) << np.uint64(_KEPT) | _unpack(x)
                for b, x in zip(replies.column("bucket").to_pylist(), replies.column("hits").to_pylist())]
        return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)

    def tally(table: pa.Table, replies: pa.Table) -> pa.Table:
        frequent = held(replies)
        bitmap = np.zeros(2**_BITMAP, bool)
        bitmap[frequent & np.uint64(2**_BITMAP - 1)] = True
        out = []
        for p in _parts(table, bits):
            words = p.words()
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            total = np.bincount(p.lang, minlength=len(p.langs))
            out.append(pa.table({"lang": p.langs, "k": pa.array([0] * len(total), pa.int32()),
                                 "phrase": pa.array([""] * len(total), pa.string()), "f": pa.array(total, pa.int64())}))
            for k in range(1, max_words + 1):
                at, h = p.fingerprints(k)
                key = _bucket(h, n) << np.uint64(_KEPT) | (h & _MASK)
                some = np.flatnonzero(bitmap[key & np.uint64(2**_BITMAP - 1)])
                if not len(some) or not len(frequent):
                    continue
                place = np.minimum(np.searchsorted(frequent, key[some]), len(frequent) - 1)
                some = some[frequent[place] == key[some]]
                at, h = at[some], h[some]
                order = np.argsort(h)
                at, h = at[order], h[order]
                lead = _leads(h)
                first = at[lead][np.cumsum(lead) - 1] if len(at) else at
                columns = [p.lang, *[ids[j:] for j in range(k)]]
                if not all((c[at] == c[first]).all() for c in columns):
                    # Different phrases share a fingerprint: part them by their words.
                    order = np.lexsort([c[at] for c in columns] + [h])
                    at = at[order]
                    lead = np.any([_leads(c[at]) for c in columns], axis=0)
                place = np.flatnonzero(lead)
                first = at[place]
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(first + j)) for j in range(k)], " ")
                out.append(pa.table({"lang": p.langs.take(pa.array(p.lang[first])), "k": pa.array(np.full(len(first), k, np.int32)),
                                     "phrase": phrase, "f": pa.array(np.diff(np.concatenate((place, [len(at)]))), pa.int64())}))
        if not out:
            return pa.table({"lang": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "phrase": pa.array([], pa.string()),
                             "f": pa.array([], pa.int64())})
        summed = pa.concat_tables(out).group_by(["lang", "k", "phrase"]).aggregate([("f", "sum")])
        return summed.select(["lang", "k", "phrase", "f_sum"]).rename_columns(["lang", "k", "phrase", "f"])

    return tally


def phrase_counts(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", block_bytes: int = BLOCK_BYTES, bits: int = 64,
) -> DataFrame:
    """(lang, k, phrase, f): phrases of up to `max_words` words that occur `min_count` times or more in a language, with their exact
    counts. A row with k = 0 holds the number of all words of a language.

    `bits` of a fingerprint are used; fewer only make collisions, which cost work.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(LEAST_BLOCKS, -(-size // block_bytes))
    cut = F.when(F.length(text) > LONG_TEXT, F.regexp_extract_all(text, F.lit(_LONG), F.lit(0))).otherwise(F.array(text))
    rows = small_batches(docs).select(
        F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(id_col).alias("id"), F.posexplode(cut).alias("part", "text"),
    ).select(F.pmod(F.xxhash64("id", "part", "text"), F.lit(n)).cast("int").alias("block"), "lang", "text")
    asks = rows.groupBy("block").applyInArrow(_asks(n, max_words, bits), "bucket int, block int, ones binary, more binary, counts binary")
    replies = asks.groupBy("bucket").applyInArrow(_replies(min_count), "block int, bucket int, hits binary")
    tallies = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _tallies(n, max_words, bits), "lang string, k int, phrase string, f long")
    return tallies.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("k") == 0))


def collocations(
    counts: DataFrame, covered: int = COVERED, top: int = TOP, scale: int = SCALE,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language, from a table like that of `phrase_counts`.

    A phrase scores by its weakest cut: its count against the counts of the two parts. Phrases inside a longer one that has `covered`
    percent of their count are dropped.
    """
    wide = "decimal(38,0)"
    phrases = counts.where("k > 0").select("lang", "phrase", "k", "f")
    words = F.split("phrase", " ")
    cands = phrases.where("k > 1").withColumn("w", words)

    def span(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    # Each candidate once for each side of each of its cuts.
    j = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = cands.withColumn("j", j).select(
        "lang", "phrase", F.col("f").alias("a"), "j", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), span(1, F.col("j")).alias("part")),
            F.struct(F.lit(1).alias("side"), span(F.col("j") + 1, F.col("k") - F.col("j")).alias("part")))).alias("s"),
    ).select("lang", "phrase", "a", "j", "s.side", "s.part")
    sides = cuts.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = sides.groupBy("lang", "phrase", "a", "j").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"cast({scale} as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as {wide}) + r)")
    scored = both.withColumn("score", score.cast("bigint"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("b"))

    # What lies inside a longer candidate, with the largest count of such.
    size = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")
    inner = cands.where("k > 2").select("lang", "f", "w", "k", size).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))).select(
        "lang", "f", span(F.col("at"), F.col("size")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    hidden = F.coalesce(F.expr(f"cast(100 as {wide}) * longer >= cast({covered} as {wide}) * a"), F.lit(False))
    left = best.join(inner, ["lang", "phrase"], "left").where(~hidden)
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n",
        F.col("b.score").alias("score"))


def mine(docs: DataFrame, **options) -> DataFrame:
    """The best collocations of each language of `docs`; options are those of `phrase_counts`."""
    return collocations(stage(phrase_counts(docs, **options)))
