"""Toxicity: logistic regression on words and word beginnings, regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Buffer, chunks
from .common import id_bucket
from .crf_langid import letters

#: Labelled documents of each class that the classifier is fitted on, at most (whole texts).
FIT_TOXIC, FIT_CLEAN = 2000, 3000
#: Features kept: those whose presence differs most between the classes, by LEAST_Z standard errors and in MIN_DOCS documents at least.
FEATURES, MIN_DOCS, LEAST_Z = 2000, 5, 2.5
#: Lengths in bytes of the word beginnings that are features besides the word.
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the squared change of score under a swap of identity terms, and of the squared weights.
COUNTERFACTUAL, RIDGE = 1.0, 2e-4
#: Terms of one group can stand for each other in a sentence.
IDENTITY = {
    "en": [["men", "women"], ["man", "woman"], ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"], ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"], ["gay", "straight", "lesbian", "bisexual", "transgender"], ["black", "white", "asian", "latino"], ["african", "american", "european", "mexican", "chinese", "arab"], ["young", "old"], ["immigrants", "natives"]],
    "de": [["männer", "frauen"], ["mann", "frau"], ["christen", "muslime", "juden", "hindus"], ["ausländer", "deutsche"]],
    "fr": [["hommes", "femmes"], ["homme", "femme"], ["chrétiens", "musulmans", "juifs"], ["étrangers", "français"]],
    "es": [["hombres", "mujeres"], ["hombre", "mujer"], ["cristianos", "musulmanes", "judíos"], ["extranjeros", "españoles"]],
}
_GROUP = {t.encode(): [x.encode() for x in g if x != t] for groups in IDENTITY.values() for g in groups for t in g}
_TERM = re.compile(rb"(?<![^ ])(?:" + b"|".join(sorted(_GROUP, key=len, reverse=True)) + rb")(?![^ ])")


def swapped(text: bytes) -> bytes | None:
    """letters() text with each identity term replaced by another of its group, the same each time; None without terms."""
    out, n = _TERM.subn(lambda m: _GROUP[m[0]][zlib.crc32(m[0] + text[:64]) % len(_GROUP[m[0]])], text)
    return out if n else None


def features(texts: list[bytes]):
    """(owner, hash) of each word and of its beginnings, in any order, repeats included."""
    b = Buffer(texts)
    owner, hashes = [b.owner], [b.hash(b.start, b.end)]
    for n in PREFIXES:
        long = b.end - b.start > n
        owner.append(b.owner[long])
        hashes.append(b.hash(b.start[long], b.start[long] + n) ^ np.uint64(n))
    return owner, hashes


def _distinct(owner, value):
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


class Classifier:
    """Weights of the kept features; a text's score is the logistic of the sum over the features that it has."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes & np.uint64((1 << self.BITS) - 1), kind="stable")
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        low = (self.hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)
        self.begin = np.searchsorted(low, np.arange(1 << self.BITS)).astype(np.int32)  # first kept feature of each low part
        self.most = int(np.bincount(low, minlength=1).max()) if len(low) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the kept feature of each hash, -1 if none."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        at = self.begin[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)].astype(np.int64)
        for step in range(self.most):
            k = np.minimum(at + step, len(self.hashes) - 1)
            hit = self.hashes[k] == h
            out[hit] = k[hit]
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, z in chunks(texts, 1 << 19):
            owners, found = [], []
            for owner, h in zip(*features(texts[a:z]), strict=True):
                k = self.find(h)
                owners.append(owner[k >= 0]), found.append(k[k >= 0])
            owner, k = _distinct(np.concatenate(owners), np.concatenate(found))
            out[a:z] = np.bincount(owner, self.weights[k], z - a) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    @classmethod
    def fit(cls, rows: list[tuple[int, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 250, rate: float = 0.05) -> Classifier:
        """rows: (label, distinct feature hashes). pairs: feature hashes of a labelled text and of its swapped form.

        Minimises the logistic loss plus RIDGE * |w|^2 plus COUNTERFACTUAL * mean (score change under the swap)^2. Classes
        weigh alike in choosing features; the bias is set for the shares of the classes in the sample."""
        y = np.array([r[0] for r in rows], float)
        none = cls(np.zeros(0, np.uint64), np.zeros(0), min(-0.1, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))))  # knows of no sign, so condemns nothing
        if not len(y) or y.sum() in (0, len(y)):
            return none
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
        flat = np.concatenate([r[1] for r in rows])
        names = np.unique(flat)
        of = np.searchsorted(names, flat).astype(np.int32)
        del flat
        toxic = np.bincount(of, y[row], len(names))
        total = np.bincount(of, minlength=len(names)).astype(float)
        p, q = (toxic + 0.5) / (y.sum() + 1), (total - toxic + 0.5) / (len(y) - y.sum() + 1)
        spread = np.sqrt(p * (1 - p) / (y.sum() + 1) + q * (1 - q) / (len(y) - y.sum() + 1))
        z = np.where(total >= MIN_DOCS, np.abs(p - q) / spread, 0)
        keep = np.sort(np.argsort(-z, kind="stable")[: min(FEATURES, int((z > LEAST_Z).sum()))])
        if not len(keep):
            return none
        to = np.full(len(names), -1)
        to[keep] = np.arange(len(keep))
        mine = to[of] >= 0
        row, col, k = row[mine], to[of[mine]], len(keep)
        kept = names[keep]
        change_row, change_col, change = [], [], []
        for n, (a, b) in enumerate(pairs):
            for h, sign in ((np.setdiff1d(a, b), 1.0), (np.setdiff1d(b, a), -1.0)):
                at = np.searchsorted(kept, h)
                at = at[(at < k) & (kept[np.minimum(at, k - 1)] == h)]
                change_row += [n] * len(at)
                change_col += at.tolist()
                change += [sign] * len(at)
        change_row, change_col, change = np.array(change_row, int), np.array(change_col, int), np.array(change)
        w, bias = np.zeros(k), none.bias
        m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
        for r in range(1, rounds + 1):
            err = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + bias, -60, 60))) - y
            g = np.bincount(col, err[row], k) / len(y) + 2 * RIDGE * w
            if len(change):
                d = np.bincount(change_row, change * w[change_col], len(pairs))
                g += 2 * COUNTERFACTUAL * np.bincount(change_col, change * d[change_row], k) / len(pairs)
            gb = err.mean()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
            bias -= rate * (mb / (1 - 0.9**r)) / (np.sqrt(vb / (1 - 0.99**r)) + 1e-8)
        return cls(kept, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Classifier:
    """A classifier from labels.toxic of documents whose crc32(id) mod 5 is not 0."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.where(id_bucket(F.col("label_id"), folds) != 0)
    counts = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    share = [min(1.0, 1.1 * most / max(1, counts.get(k, 0)) + 20 / max(1, counts.get(k, 0))) for k, most in ((0, FIT_CLEAN), (1, FIT_TOXIC))]
    spread = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(1_000_000)) / 1_000_000
    y = y.where(spread < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    y = F.broadcast(y)  # at most 1.1 * (FIT_TOXIC + FIT_CLEAN) and some rows
    d = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string")).join(y, "label_id")

    def run(batches):
        for b in batches:
            texts = letters(b.column(1))
            other = [swapped(t) for t in texts]
            got = []
            for text in (texts, [t or b"" for t in other]):
                owner, h = features(text)
                owner, h = _distinct(np.concatenate(owner), np.concatenate(h))
                got.append(np.split(h, np.cumsum(np.bincount(owner, minlength=len(text)))[:-1]))
            swaps = [x.tobytes() if o is not None else None for x, o in zip(got[1], other, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array([x.tobytes() for x in got[0]], pa.binary()), pa.array(swaps, pa.binary())], names=["label_id", "toxic", "mine", "swapped"])

    got = d.select("label_id", "text", "toxic").mapInArrow(run, "label_id long, toxic int, mine binary, swapped binary").collect()  # the bounded sample
    got.sort(key=lambda r: (r["label_id"], bytes(r["mine"])))
    left = {0: FIT_CLEAN, 1: FIT_TOXIC}
    rows, pairs = [], []
    for k, r in enumerate(got):
        got[k] = None  # the driver holds each row once
        if left[r["toxic"]]:
            left[r["toxic"]] -= 1
            mine = np.frombuffer(r["mine"], np.uint64)
            rows.append((r["toxic"], mine))
            if r["swapped"] is not None:
                pairs.append((mine, np.frombuffer(r["swapped"], np.uint64)))
    return Classifier.fit(rows, pairs)


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted, in one pass over whole texts.

    Defined results: null, empty and blank texts get the score of the bias alone; without both labels in the sample every
    score is the share of toxic ones, 0.475 at most; repeated rows get equal scores; a null id is in fold 0; an empty table gives no rows; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and an index of fixed size

    def run(batches):
        for b in batches:
            score = held.value.score(letters(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long"), (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scorer(spark, model: Classifier):
    """A function of a text column: the score of each text."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        parts = [text[a : a + 1000] for a in range(0, len(text), 1000)]  # bounds the memory
        return pd.Series(np.concatenate([held.value.score(letters(pa.Array.from_pandas(p, type=pa.string()))) for p in parts] or [np.zeros(0)]))

    return score
