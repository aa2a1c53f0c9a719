"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton after folding.

Folding undoes disguise: case, homoglyphs of other scripts and digits or signs in place of letters. Accents tell words apart in many
languages, so texts are matched with and without them; what only matches without them counts as well. The lexicon is learned
from labelled rows as words and word beginnings with significant log-odds, on top of a short list of common insults; exception phrases
take back what a word inside them scored. Sums of weights, plain and per word, give the score by a logistic curve fitted on the
same rows.

Defined cases: NULL, empty and wordless texts get the curve's value for no hits; unlabelled rows and NULL labels teach nothing;
without labels of both classes a fixed curve and the common list are used; rows are scored one by one, repeated or not; an empty
table gives an empty result; other columns are ignored or, in `filter_documents`, kept.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlab.llm.common import crc_mod, small_batches
from cohortlab.llm.textscan import blocks
from cohortlab.staging import stage

# Bound of the labelled sample, lowest hashes of the id, and of the learned terms, strongest first.
SAMPLE_ROWS = 20_000
MAX_TERMS = 20_000
# Twice the log-likelihood gain that a term needs, and the share of its documents that must be toxic.
GAIN, PRECISION = 20.0, 0.6
PREFIXES = (4, 5, 6, 7, 8)
# Share of clean documents up to which a beginning stands for all its words.
PURE = 0.05
THRESHOLD = 0.7

# Common insults, with the weight they have until labels say otherwise.
COMMON = ("idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile bastard asshole bitch retard "
          "scumbag dumbass jerk filth vermin").split()
COMMON_WEIGHT = 3.0
# Phrases in which the word is harmless.
EXCEPTIONS = {"clown fish": "clown", "trash can": "trash", "trash bin": "trash", "trash collection": "trash",
              "circus clown": "clown", "sore loser": "loser", "stupid simple": "stupid"}
# Signs read as the letter they resemble.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_SIZE = 0x20000


@cache
def folding(accents: bool) -> np.ndarray:
    """Code point to folded code point: a letter, with its accent or without, or a space for what is none."""
    out = np.full(_SIZE, 32, np.uint32)
    for cp in range(_SIZE):
        c = chr(cp)
        if c in LOOKALIKES or unicodedata.category(c)[0] == "L" and not 0x2E80 <= cp < 0xF900:
            base = unicodedata.normalize("NFKD", c).lower()[:1] or c
            like = LOOKALIKES.get(c) or LOOKALIKES.get(base)
            out[cp] = ord(like if like else c.lower()[:1] if accents and unicodedata.decomposition(c)[:1] not in ("", "<") else base)
        elif unicodedata.category(c)[0] in "LN":
            out[cp] = cp
    return out


def fold(text: str, accents: bool = True) -> str:
    """Letters folded, all else a space. The length stays."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = folding(accents)[np.minimum(points, _SIZE - 1)]
    # An exclamation mark reads as a letter only before another.
    out[np.flatnonzero((points[:-1] == 33) & (out[1:] != 32))] = ord("i")
    return out.tobytes().decode("utf-32-le")


@dataclass
class Lexicon:
    """Terms with weights: ` word ` or ` beginning`; exceptions as (phrase, word). `curve` maps the two sums to a probability."""

    weights: dict[str, float]
    exceptions: dict[str, str]
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        values: dict[str, float] = dict(self.weights)
        for phrase, word in self.exceptions.items():
            if f" {word} " in self.weights:
                values[f" {phrase} "] = -self.weights[f" {word} "]
        for term, weight in values.items():
            machine.add_word(term, weight)
        if values:
            machine.make_automaton()
        return machine if values else None


def sums(texts: list[str], machine) -> tuple[np.ndarray, np.ndarray]:
    """Weighted hits and number of words of each text."""
    ends = np.cumsum([len(t) + 2 for t in texts])
    whole = "  ".join([*texts, ""])
    flat = fold(whole)
    hits, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if not texts:
        return hits, counts
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32) != 32
    begins = np.flatnonzero(points & ~np.concatenate(([False], points[:-1])))
    counts += np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(texts))
    if machine is not None:
        found = list(machine.iter(" " + flat))
        plain = fold(whole, accents=False)
        if plain != flat:
            # Past the accents only whole words count, and only where nothing matched with them.
            known = {e for e, _ in found}
            found += [(e, w) for e, w in machine.iter(" " + plain) if e not in known and plain[e - 1] == " "]
        if found:
            at = np.searchsorted(ends, np.fromiter((e - 2 for e, _ in found), np.int64, len(found)), side="right")
            hits += np.bincount(np.clip(at, 0, len(texts) - 1), np.fromiter((w for _, w in found), float, len(found)), len(texts))
    return np.maximum(hits, 0), counts


def features(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(hits)), np.log1p(hits), np.log1p(100 * hits / np.maximum(words, 20))], 1)


def _term_counts(batches):
    """(term, toxic, n): documents with each folded word or beginning, summed per block."""
    for batch in blocks(batches):
        frame = batch.to_pandas()
        for toxic, part in frame.groupby("toxic"):
            terms: dict[str, int] = {}
            for text in part.text:
                words = set(fold(text).split())
                seen = {f" {w} " for w in words if len(w) > 2}
                seen.update(f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k)
                for t in seen:
                    terms[t] = terms.get(t, 0) + 1
            yield pa.RecordBatch.from_pydict({
                "term": list(terms), "toxic": pa.array([int(toxic)] * len(terms), pa.int32()), "n": list(terms.values())})


def _sample_sums(machine_of):
    def run(batches):
        machine = machine_of.value.automaton()
        for batch in blocks(batches):
            hits, words = sums(batch.column("text").to_pylist(), machine)
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "hits": hits, "words": words})
    return run


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from at most `sample_rows` labelled rows of (doc_id, toxic)."""
    spark = docs.sparkSession
    lexicon = Lexicon({f" {w} ": COMMON_WEIGHT for w in COMMON}, dict(EXCEPTIONS))
    ids = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows).toPandas()
    if ids.toxic.nunique() < 2:
        return lexicon
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    sample = stage(small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                   .join(chosen, "doc_id").select("text", "toxic"))
    n = dict(sample.groupBy("toxic").count().collect())
    if len(n) < 2:
        return lexicon
    counts = sample.mapInArrow(_term_counts, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    prior = n[1] / (n[0] + n[1])

    def part(c: str, share: float):
        expected = (F.col("pos") + F.col("neg")) * share
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / expected)).otherwise(0.0)

    counts = counts.withColumn("gain", 2 * (part("pos", prior) + part("neg", 1 - prior))).where(
        (F.col("gain") >= GAIN) & (F.col("pos") >= PRECISION * (F.col("pos") + F.col("neg"))))
    found = counts.orderBy(F.desc("gain"), "term").limit(MAX_TERMS).collect()
    weigh = {r.term: float(np.log((r.pos + 0.5) / (n[1] + 1)) - np.log((r.neg + 0.5) / (n[0] + 1))) for r in found}
    # A beginning stands for its words only if it is as pure as they are; words it covers are left to it.
    pure = {r.term for r in found if r.term[-1] != " " and r.neg <= PURE * r.pos}
    pure = {t for t in pure if not any(t[:k] in pure for k in range(2, len(t)))}
    words = {t: w for t, w in weigh.items() if t[-1] == " " and not any(t[:k] in pure for k in range(2, len(t)))}
    lexicon.weights = {t: w for t, w in lexicon.weights.items() if not any(t[:k] in pure for k in range(2, len(t)))}
    lexicon.weights |= words | {t: weigh[t] for t in pure}
    shared = spark.sparkContext.broadcast(lexicon)
    taught = sample.mapInArrow(_sample_sums(shared), "toxic int, hits double, words long").toPandas()
    lexicon.curve = fit(features(taught.hits.to_numpy(), taught.words.to_numpy()), taught.toxic.to_numpy())
    return lexicon


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b += move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _scorer(shared, text_col: str | None):
    """`text_col`: the text is a field of `row`."""
    def run(batches):
        lexicon = shared.value
        machine = lexicon.automaton()
        for whole in batches:
            if text_col is not None:
                whole = whole.append_column("text", whole.column("row").field(text_col))
            for batch in blocks([whole]):
                hits, words = sums([t or "" for t in batch.column("text").to_pylist()], machine)
                z = features(hits, words) @ np.array(lexicon.curve)
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(hits), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                    names=[*names, "weight", "score"])
    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, weight, score) of every row; `carry` adds the whole row as a struct, `row`."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    cols = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row") if carry else F.col(text_col).alias("text"))
    schema = T.StructType([f for f in cols.schema.fields if f.name != "text"] + [
        T.StructField("weight", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return cols.mapInArrow(_scorer(shared, text_col if carry else None), schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out third."""
    return labels.where(crc_mod(F.col("doc_id"), 3) != 1)


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, weight) of every document, taught by labels outside the held-out third."""
    found = score(docs, learn(docs, training_labels(labels), sample_rows))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"), "weight")


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that score below the threshold, columns unchanged."""
    lexicon = learn(docs, training_labels(labels), sample_rows)
    return score(docs, lexicon, carry=True).where(F.col("score") < threshold).select("row.*")
