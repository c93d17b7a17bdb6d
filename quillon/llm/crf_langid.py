"""Language ID: a linear-chain conditional random field labels the words of code-switched text by forward-backward."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import Buffer, chunks
from .common import id_bucket

#: Labelled documents of each language that the model is fitted on, at most (whole texts; windows are drawn from them).
FIT_DOCS = 200
#: Training sequences for each language, words in each, and share of them that switch language midway.
SEQUENCES, LENGTH, SWITCHED = 250, 24, 0.4
#: Rows of the table of one n-gram length, and of the table of whole words.
GRAM_ROWS, WORD_ROWS = 1 << 16, 1 << 17
GRAMS = (2, 3, 4)
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(texts: pa.Array) -> list[bytes]:
    """Lower-cased UTF-8 with everything but letters as spaces (bytes above 127 count as letters); null as empty."""
    return [(t or "").encode().translate(_KEEP) for t in pc.utf8_lower(texts).to_pylist()]


class Words:
    """Features of the words of some texts. grams: for each byte position and n-gram length a row of that length's table;
    a space at either end of an n-gram marks a prefix or suffix. lexicon: a row for each whole word."""

    def __init__(self, texts: list[bytes]):
        b = Buffer([b"", *texts])
        self.owner, self.first = b.owner - 1, np.diff(b.owner, prepend=-1) != 0
        self.start = b.start
        raw, space = b.bytes.astype(np.uint32), np.append(b.space, np.ones(4, bool))
        raw[b.space] = 32
        raw = np.append(raw, np.full(4, 32, np.uint32))
        n, code = len(b.bytes), raw[: len(b.bytes)].copy()
        self.grams = []
        inner = np.zeros(n, bool)
        for k in range(2, max(GRAMS) + 1):
            code = code | raw[k - 1 : k - 1 + n] << np.uint32(8 * (k - 1))
            if k > 2:
                inner = inner | space[k - 2 : k - 2 + n]
            if k in GRAMS:
                bad = inner if k > 2 else space[:n] & space[1 : n + 1]
                row = ((code + np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32)
                row[bad] = GRAM_ROWS
                self.grams.append(row)
        self.lexicon = (b.hash(b.start, b.end) & np.uint64(WORD_ROWS - 1)).astype(np.int32)

    def scores(self, tables: list[np.ndarray], lexicon: np.ndarray) -> np.ndarray:
        """Sum of the features' weights for each word and label."""
        if not len(self.start):
            return np.zeros((0, lexicon.shape[1]), np.float32)
        rows = tables[0][self.grams[0]]
        for t, g in zip(tables[1:], self.grams[1:], strict=True):
            rows += t[g]
        return np.add.reduceat(rows, self.start - 1, axis=0) + lexicon[self.lexicon]


def posteriors(scores: np.ndarray, first: np.ndarray, start: np.ndarray, transitions: np.ndarray, block: int = 256) -> np.ndarray:
    """Label probabilities of each word by forward-backward; `first` marks words that begin a text.

    All texts are one chain that starts anew at `first`. Blocks of words are multiplied out side by side, carried from block
    to block, and then run through side by side, so a text of any length costs the same for each word."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    emit = np.exp((scores - scores.max(1, keepdims=True)).astype(np.float64))
    emit = np.maximum(emit, 1e-30)
    m, s = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    block = min(block, n)
    c = -(-n // block)
    pad = c * block - n
    emit = np.concatenate([emit, np.ones((pad, k))]).reshape(c, block, k)
    first = np.concatenate([first, np.ones(pad, bool)]).reshape(c, block)
    whole = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    for b in range(block):
        new = (whole.reshape(-1, k) @ m).reshape(c, k, k)
        at = first[:, b]
        if at.any():
            new[at] = whole[at].sum(2, keepdims=True) * s
        new *= emit[:, b, None, :]
        whole = new / new.sum((1, 2), keepdims=True)
    before, after = np.empty((c, k)), np.empty((c, k))
    v = np.full(k, 1 / k)
    for i in range(c):
        before[i] = v
        v = v @ whole[i]
        v = v / v.sum()
    v = np.ones(k)
    for i in range(c - 1, -1, -1):
        after[i] = v
        v = whole[i] @ v
        v = v / v.sum()
    out = np.empty((c, block, k))
    v = before
    for b in range(block):
        v = np.where(first[:, b, None], s, v @ m) * emit[:, b]
        v /= v.sum(1, keepdims=True)
        out[:, b] = v
    v = after
    for b in range(block - 1, -1, -1):
        out[:, b] *= v
        v = v * emit[:, b]
        v = np.where(first[:, b, None], (v @ s)[:, None], v @ m.T)
        v /= v.sum(1, keepdims=True)
    out = out.reshape(-1, k)[:n]
    return out / out.sum(1, keepdims=True)


class Crf:
    """Weights of a fitted model; labels are in order."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.tables = [np.zeros((GRAM_ROWS + 1, k), np.float32) for _ in GRAMS]
        self.lexicon = np.zeros((WORD_ROWS, k), np.float32)
        self.start, self.transitions = np.zeros(k), np.zeros((k, k))

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], rounds: int = 30, rate: float = 0.08, penalty: float = 1e-5, seed: int = 7) -> Crf:
        """samples: texts by label. Windows of words are drawn from them, some joined from two languages, and the
        likelihood of the labels is raised by Adam steps; feature and transition gradients are expected against seen counts."""
        model = cls(sorted(samples))
        k = len(model.labels)
        rng = np.random.default_rng(seed)
        pools = [[t.split() for t in samples[x]] for x in model.labels]
        pools = [[w for w in p if w] for p in pools]
        have = [i for i in range(k) if pools[i]]
        if len(have) < 2:
            return model

        def draw(i, size):
            words = pools[i][rng.integers(len(pools[i]))]
            at = rng.integers(max(1, len(words) - size + 1))
            got = words[at : at + size]
            while len(got) < size:
                got = got + draw(i, size - len(got))
            return got

        texts, goal = [], []
        for i in have:
            for _ in range(SEQUENCES):
                j, cut = (int(rng.choice(have)), int(rng.integers(4, LENGTH - 3))) if rng.random() < SWITCHED else (i, LENGTH)
                texts.append(b" ".join(draw(i, cut) + (draw(j, LENGTH - cut) if cut < LENGTH else [])))
                goal.append([i] * cut + [j] * (LENGTH - cut))
        goal = np.array(goal)
        w = Words(texts)
        n, size = goal.shape
        word_of = np.repeat(np.arange(n * size), np.diff(np.append(w.start - 1, len(w.grams[0]))))
        grams = [g[w.start[0] - 1 :] for g in w.grams]
        params = [*model.tables, model.lexicon, model.start, model.transitions]
        first_moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        hot = np.eye(k)[goal]
        for r in range(1, rounds + 1):
            scores = w.scores(model.tables, model.lexicon).astype(np.float64).reshape(n, size, k)
            gamma, xi = _expected(scores, model.start, model.transitions)
            g = (hot - gamma).reshape(-1, k) / n
            grads = []
            for rows in grams:
                grads.append(np.stack([np.bincount(rows, g[word_of, j], GRAM_ROWS + 1) for j in range(k)], 1))
                grads[-1][GRAM_ROWS] = 0
            grads.append(np.stack([np.bincount(w.lexicon, g[:, j], WORD_ROWS) for j in range(k)], 1))
            grads.append((hot[:, 0] - gamma[:, 0]).mean(0))
            seen = np.zeros((k, k))
            np.add.at(seen, (goal[:, :-1].ravel(), goal[:, 1:].ravel()), 1)
            grads.append((seen - xi) / n)
            for p, d, a, b in zip(params, grads, first_moment, second, strict=True):
                d = d - penalty * p
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p += (rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)).astype(p.dtype)
        return model

    def label(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the label with the largest mean word probability, and that mean; -1 without words."""
        k = len(self.labels)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for a, z in chunks(texts, 1 << 19):
            w = Words(texts[a:z])
            p = posteriors(w.scores(self.tables, self.lexicon), w.first, self.start, self.transitions)
            words = np.bincount(w.owner, minlength=z - a)
            mean = np.stack([np.bincount(w.owner, p[:, j], z - a) for j in range(k)], 1) / np.maximum(words, 1)[:, None]
            has = words > 0
            best[a:z][has], score[a:z][has] = mean[has].argmax(1), np.minimum(mean[has].max(1), 1.0)
        return best, score


def _expected(scores, start, transitions):
    """Of equally long sequences: label probabilities, and expected transition counts summed over all."""
    n, size, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    m, s = np.exp(transitions), np.exp(start)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, size))
    v = s * e[:, 0]
    for t in range(size):
        if t:
            v = (v @ m) * e[:, t]
        scale[:, t] = v.sum(1)
        v = v / scale[:, t, None]
        alpha[:, t] = v
    xi = np.zeros((k, k))
    for t in range(size - 2, -1, -1):
        u = e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        beta[:, t] = u @ m.T
        xi += m * (alpha[:, t].T @ u)
    return alpha * beta, xi


def fit_sample(docs: DataFrame, folds: int = 5) -> dict[str, list[bytes]]:
    """Texts by language of at most FIT_DOCS labelled documents each, spread by a hash, ids of remainder 0 left out."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket(F.col("doc_id"), folds) != 0))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return {}
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * FIT_DOCS / n + 20 / n)))])
    h = F.xxhash64("text", F.lit(1))
    d = d.where(F.pmod(h, F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    d = d.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy(h, "text")).alias("at")).where(F.col("at") <= FIT_DOCS)
    out: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in d.orderBy("lang", "at").toLocalIterator():  # the same however rows are dealt
        out[r["lang"]] += letters(pa.array([r["text"]], pa.string()))
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score.

    Fits on `lang` of documents whose crc32(id) mod 5 is not 0, unless a model is given; a prediction sees the text alone. Every
    word of the whole text is labelled; lang_pred has the largest mean probability, score is that mean.
    Defined results: `und` and 0 for null texts, texts without a letter, and where no language could be learned; with one
    learned language, that one and 1; ties go to the first by name; a null id is in fold 0; an empty table gives no rows;
    other columns are ignored."""
    if model is None:
        samples = fit_sample(docs)
        model = Crf.fit(samples) if samples else None
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size for each language

    def run(batches):
        crf = held.value
        for b in (whole.slice(a, 1000) for whole in batches for a in range(0, whole.num_rows, 1000)):  # bounds the memory
            texts = letters(b.column(2))
            best, score = crf.label(texts) if crf and len(crf.labels) else (np.full(len(texts), -1), np.zeros(len(texts)))
            known = b.column(3).to_numpy(zero_copy_only=False)
            lang = [crf.labels[x] if x >= 0 and ok else "und" for x, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.where(known & (best >= 0), score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long"), (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string"))
    d = d.withColumn("known", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def scorer(spark, samples: dict[str, list[bytes]]):
    """A function of a text column: the largest mean probability of a learned language; 0 without letters or languages."""
    held = spark.sparkContext.broadcast(Crf.fit(samples) if samples else None)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        crf, out = held.value, np.zeros(len(text))
        for a in range(0, len(text) if crf else 0, 1000):  # bounds the memory
            texts = pa.Array.from_pandas(text[a : a + 1000], type=pa.string())
            known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            best, value = crf.label(letters(texts))
            out[a : a + 1000] = np.where(known & (best >= 0), value, 0.0)
        return pd.Series(out)

    return score
