"""LM scoring: a hidden Markov language model trained by Baum-Welch counts aggregated across partitions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, materialize

STATES = 8
#: Size of the model: words with an emission of their own for each state; the others share one for each bucket of their last
#: two bytes, times their exact share of it.
VOCABULARY, BUCKETS = 50_000, 256
#: Rarer words in training text share the bucket's emission, so that buckets have something to go by for unseen words.
LEAST_COUNT = 5
#: Documents that the starting point is fitted on (whole texts); the Baum-Welch passes after that count all training text.
START_DOCS, START_ROUNDS, PASSES = 200, 25, 2
#: Weight in tokens of the overall distribution in each state's emissions.
SMOOTHING = 20.0
#: Padded tokens that are run through side by side.
LANES = 1 << 18
#: Steps for which emissions are looked up at once, and after how many the forward values are scaled.
BLOCK, SCALED = 32, 8
END = 0


class Vocab(dict):
    """Class of each word: 0 is the end token, then the vocabulary, then the buckets of all other words."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, k + 1) for k, w in enumerate(words))
        self.rare = len(words) + 1

    def __missing__(self, word: bytes) -> int:
        return self.rare + bucket(word)

    def __reduce__(self):
        return Vocab, ([w for w, _ in sorted(self.items(), key=lambda x: x[1])],)


def bucket(word: bytes) -> int:
    return (word[-1] * 31 + (word[-2] * 17 if len(word) > 1 else 7)) % BUCKETS


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def batches_of(ids: list[np.ndarray], pad: int):
    """Sequences by falling length in batches of about LANES places: (positions, lengths, ids[time, sequence]), ended by `pad`."""
    lengths = np.array([len(x) for x in ids])
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, LANES // int(lengths[order[at]]))
        pick = order[at : at + n]
        size = lengths[pick]
        out = np.full((len(pick), size[0]), pad, np.int32)
        out[np.arange(size[0]) < size[:, None]] = np.concatenate([ids[k] for k in pick])
        yield pick, size, np.ascontiguousarray(out.T)
        at += n


class Hmm:
    """start[s], step[s, s'], emit[class, s] (p of the class in state s)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def random(cls, classes: np.ndarray, states: int = STATES, seed: int = 11) -> Hmm:
        """A starting point around the class frequencies."""
        rng = np.random.default_rng(seed)
        emit = (classes / max(1, classes.sum()))[:, None] * rng.gamma(2.0, 0.5, (len(classes), states)) + 1e-12
        step = np.full((states, states), 0.3 / states) + np.eye(states) * 0.7
        return cls(np.full(states, 1 / states), step, emit / emit.sum(0))

    def _padded(self) -> np.ndarray:
        """Emissions with a last class that every state gives with 1: steps after the end change no sum."""
        return np.vstack([self.emit, np.ones(self.emit.shape[1])])

    def log10(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence of classes by the scaled forward recursion."""
        out, emit = np.zeros(len(ids)), self._padded()
        for pick, size, x in batches_of(ids, len(self.emit)):
            total, v = np.zeros(len(pick)), self.start
            for t0 in range(0, len(x), BLOCK):
                n = int(np.searchsorted(-size, -t0, side="left"))  # sequences longer than t0
                e = emit.take(x[t0 : t0 + BLOCK, :n], axis=0)
                v = v[:n] if t0 else v
                for k in range(len(e)):
                    v = (v @ self.step if t0 + k else v) * e[k]
                    if k % SCALED == SCALED - 1 or k + 1 == len(e):
                        c = v.sum(1)
                        v /= c[:, None]
                        total[:n] += np.log10(c)
            out[pick] = total
        return out

    def counts(self, ids: list[np.ndarray], into: Counts) -> None:
        """Add the expected counts of the sequences: one Baum-Welch pass over them."""
        states, emit = len(self.start), self._padded()
        back = np.ascontiguousarray(self.step.T)
        for pick, size, x in batches_of(ids, len(self.emit)):
            steps, width = x.shape
            active = np.searchsorted(-size, -(np.arange(steps) // BLOCK * BLOCK), side="left")  # by block
            alpha, scale = np.zeros((steps, width, states)), {}
            real = np.arange(steps)[:, None] < size[None]
            tmp = np.empty((width, states))
            for t0 in range(0, steps, BLOCK):
                n = active[t0]
                e = emit.take(x[t0 : t0 + BLOCK, :n], axis=0)
                for k in range(len(e)):
                    t, v = t0 + k, alpha[t0 + k, :n]
                    if t:
                        np.matmul(alpha[t - 1, :n], self.step, out=tmp[:n])
                        np.multiply(tmp[:n], e[k], out=v)
                    else:
                        np.multiply(self.start, e[k], out=v)
                    if k % SCALED == SCALED - 1 or k + 1 == len(e):
                        c = v.sum(1, keepdims=True)
                        v /= c
                        scale[t] = c
                        into.total += float(np.log(c).sum())
            beta = np.ones((width, states))
            for t0 in range((steps - 1) // BLOCK * BLOCK, -1, -BLOCK):  # alpha becomes the state probabilities on the way back
                n, last = active[t0], min(t0 + BLOCK, steps) - 1
                e = emit.take(x[t0 : last + 1, :n], axis=0)
                u = np.empty((last - t0 + 1, n, states))  # of each step: emission, and what follows
                for t in range(last, t0 - 1, -1):
                    np.multiply(e[t - t0], beta[:n], out=u[t - t0])
                    if t in scale:
                        u[t - t0] /= scale[t]
                    e[t - t0] = beta[:n]
                    np.matmul(u[t - t0], back, out=beta[:n])
                u *= real[t0 : last + 1, :n, None]
                first = 1 if t0 == 0 else 0
                into.step += alpha[t0 - 1 + first : last, :n].reshape(-1, states).T @ u[first:].reshape(-1, states)
                if t0 + BLOCK < steps:
                    alpha[last + 1, : active[last + 1]] *= after  # its forward values are no longer needed
                alpha[t0 + 1 : last + 1, :n] *= e[1:]
                after = e[0]
            alpha[0, : active[0]] *= after
            into.start += alpha[0].sum(0)
            flat, gamma = x[real], alpha[real]
            for s in range(states):
                into.emit[:, s] += np.bincount(flat, gamma[:, s], len(into.emit))
            into.tokens += np.bincount(flat, minlength=len(into.emit))

    def improved(self, c: Counts) -> Hmm:
        """The model of the expected counts, smoothed."""
        step = c.step * self.step
        overall = (c.tokens + 0.1) / (c.tokens.sum() + 0.1 * len(c.tokens))
        emit = c.emit + SMOOTHING * overall[:, None]
        return Hmm((c.start + 1) / (c.start + 1).sum(), (step + 1) / (step + 1).sum(1, keepdims=True), emit / emit.sum(0))


class Counts:
    """Expected start, step (still to be multiplied by the step probabilities) and emission counts; tokens of each class."""

    def __init__(self, classes: int, states: int = STATES):
        self.start, self.step, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        self.tokens, self.total = np.zeros(classes), 0.0


def vocabulary(train: DataFrame) -> list[bytes]:
    """The VOCABULARY words most counted in all training text, by exact counts; of equal counts the first in order."""

    def count(batches):
        seen: Counter = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > 200_000:  # the rest of the partition counts on; the sums meet by word
                    yield told()
                    seen.clear()
        yield told()

    top = train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    return [bytes(r["word"]) for r in top.collect()]


def _ids(texts: list, vocab: Vocab) -> tuple[list[list[bytes]], list[np.ndarray]]:
    words = [tokens(t) for t in texts]
    get = vocab.__getitem__
    return words, [np.fromiter([*map(get, w), END], np.int32, len(w) + 1) for w in words]


def train(docs: DataFrame) -> tuple[Vocab, Hmm, np.ndarray]:
    """docs (text) -> vocabulary, model, exact token count of each class over all of them."""
    spark = docs.sparkSession
    vocab = Vocab(vocabulary(docs))
    classes = vocab.rare + BUCKETS
    n = docs.count()
    spread = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(1_000_000)) / 1_000_000
    sample = docs.where(spread < min(1.0, (START_DOCS + 20) / max(1, n)) * 1.5).select("text")
    texts = [r["text"] for r in sample.orderBy(F.xxhash64("text", F.lit(2)), "text").limit(START_DOCS).collect()]  # the same however rows are dealt
    _, ids = _ids(texts, vocab)
    model = Hmm.random(np.bincount(np.concatenate(ids), minlength=classes) + 0.01 if ids else np.ones(classes))
    for _ in range(START_ROUNDS if ids else 0):
        c = Counts(classes)
        model.counts(ids, c)
        model = model.improved(c)
    counted = np.zeros(classes)
    for _ in range(PASSES):
        held = spark.sparkContext.broadcast((vocab, model))  # VOCABULARY words, and STATES numbers for each class

        def expect(batches, held=held):
            vocab, model = held.value
            c = Counts(classes)
            for b in batches:
                ids = [x for a in range(0, b.num_rows, 250) for x in _ids(b.column(0).slice(a, 250).to_pylist(), vocab)[1]]
                model.counts(ids, c)
            some = np.flatnonzero(c.tokens)
            rows = np.concatenate([np.column_stack([c.emit[some], c.tokens[some]]), np.column_stack([c.step, np.zeros(STATES)]), np.append(c.start, c.total)[None]])
            names = np.concatenate([some, -1 - np.arange(STATES + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in rows.T)], names=["c", *(f"x{k}" for k in range(STATES + 1))])

        x = [f"x{k}" for k in range(STATES + 1)]
        sums = docs.select("text").mapInArrow(expect, "c int, " + ", ".join(f"{k} double" for k in x)).groupBy("c").agg(*[F.sum(k).alias(k) for k in x]).toPandas()  # a row for each class
        at, values = sums["c"].to_numpy(), sums[x].to_numpy()
        c = Counts(classes)
        c.emit[at[at >= 0]], c.tokens[at[at >= 0]] = values[at >= 0, :STATES], values[at >= 0, STATES]
        for k, row in zip(at.tolist(), values, strict=True):
            if k < -STATES:
                c.start, c.total = row[:STATES], row[STATES]
            elif k < 0:
                c.step[-1 - k] = row[:STATES]
        model, counted = model.improved(c), c.tokens
    return vocab, model, counted


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id) mod `folds` is not 0. base_score: add-0.1 unigram model. score: log10 probability
    under the hidden Markov model, exact by the scaled forward recursion. In a state a vocabulary word has its own emission;
    any other word w has that of its bucket times (c+0.1)/(C+0.1*(V+1)), where c counts w, C the tokens and V the words of the bucket
    in training; an unseen word has c = 0, so each bucket keeps a share for words it has not seen.
    Counts of words outside the vocabulary are exact too: (document, word, count) rows are summed by word, partly before they
    are exchanged, and joined with the sums; their logarithms are summed by document.
    Defined results: null and empty texts are one end token; a null id is in fold 0, so held out; rows are scored singly, also
    if ids repeat; with nothing to learn from, base_score is 0; an empty table gives no rows; other columns are ignored."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (id_bucket(F.col("doc_id"), folds) == 0).alias("held_out"))
    vocab, model, counted = train(d.where("not held_out"))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((vocab, model, np.log10(counted + 0.1), counted > 0))
    rare = vocab.rare

    def run(batches):
        vocab, model, logs, known = held.value
        logs, known = logs.copy(), known.copy()
        logs[rare:], known[rare:] = 0.0, False  # words outside the vocabulary are counted by their rows
        for b in batches:
            row, texts, ho, docs_id = b.columns
            ids, rows = [], [[], [], [], []]  # of words outside: document, word, count, bucket
            for a in range(0, b.num_rows, 250):  # words of a few documents at a time
                for w, x in zip(*_ids(texts.slice(a, 250).to_pylist(), vocab), strict=True):
                    out = np.flatnonzero(x >= rare)
                    if len(out):
                        mine = [w[i] for i in out.tolist()]
                        got, of = Counter(mine), dict(zip(mine, (x[out] - rare).tolist(), strict=True))
                        rows[0].append((len(ids), len(got)))
                        rows[1] += got
                        rows[2] += got.values()
                        rows[3] += map(of.__getitem__, got)
                    ids.append(x)
            size = np.array([len(x) for x in ids])
            flat, begin = np.concatenate(ids), np.cumsum(size) - size
            owner = np.repeat(np.arange(len(ids)), size)
            outside = flat >= rare
            pair, times = np.unique(owner[outside] * BUCKETS + flat[outside] - rare, return_counts=True)
            ends = 2 * np.searchsorted(pair, np.arange(len(ids) + 1) * BUCKETS)
            hist = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.stack([pair % BUCKETS, times], 1).ravel(), pa.int32()))
            who = np.repeat([k for k, _ in rows[0]], [n for _, n in rows[0]]).astype(np.int64)
            n, m = len(ids), len(who)
            one = [row, pa.nulls(n, pa.binary()), pa.array(size, pa.int64()), ho, pa.nulls(n, pa.int32()), docs_id, pa.array(np.add.reduceat(known[flat].astype(np.int64), begin)), pa.array(np.add.reduceat(logs[flat], begin)), pa.array(model.log10(ids)), hist]
            two = [row.take(pa.array(who)), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64()), ho.take(pa.array(who)), pa.array(rows[3], pa.int32()), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32())))]
            for columns in (one, two):
                yield pa.RecordBatch.from_arrays(columns, names=["row", "word", "n", "held_out", "bucket", "doc_id", "known", "base", "hmm", "hist"])

    schema = "row long, word binary, n long, held_out boolean, bucket int, doc_id long, known long, base double, hmm double, hist array<int>"
    got = materialize(d.select(F.monotonically_increasing_id().alias("row"), "text", "held_out", "doc_id").mapInArrow(run, schema), "lm")
    w = got.where("word is not null").select("row", "word", "n", "held_out", "bucket")
    of = w.groupBy("word").agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n"))), F.lit(0)).alias("c"), F.min("bucket").alias("bucket"))
    of = materialize(of, "lm-words")  # written, so adaptive execution can split the rows of a frequent word
    w = w.select("row", "word", "n").join(of.select("word", "c").hint("merge"), "word")
    sums = w.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("also"))
    distinct = np.zeros(BUCKETS)
    for r in of.where("c > 0").groupBy("bucket").count().collect():  # a row for each bucket
        distinct[r["bucket"]] = r["count"]
    total = float(counted.sum())
    words = float((counted[:rare] > 0).sum() + distinct.sum())
    share = np.log10(counted[rare:] + 0.1 * (distinct + 1))
    logs = F.array(*[F.lit(float(x)) for x in share])
    # hist has pairs of bucket and count
    lost = F.aggregate(F.sequence(F.lit(1), F.size("hist"), F.lit(2)), F.lit(0.0), lambda a, i: a + F.element_at("hist", i + 1) * F.element_at(logs, F.element_at("hist", i) + 1))
    lost = F.when(F.size("hist") > 0, lost).otherwise(0.0)
    out = got.where("word is null").select("row", "doc_id", "held_out", "n", "known", "base", "hmm", "hist")
    out = out.join(sums, "row", "left")
    more, also = F.coalesce("more", F.lit(0.0)), F.coalesce("also", F.lit(0))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + also).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * float(np.log10(total + 0.1 * (words + 1)))).alias("base_score"), (F.col("hmm") + more - lost).alias("score"),
    )
