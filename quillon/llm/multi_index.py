"""Embedding near-dedup: inverted multi-index over vector halves, multi-sequence traversal, exact verification."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components
from .simhash import SALTS

THRESHOLD = 0.95
#: Distinct vectors that the codebooks are fitted on, at most; the index itself holds every vector.
FIT_ROWS = 20_000
#: Vectors for each cell of the grid that the codebook size aims at, and the largest codebook. Larger cells take fewer visits for
#: the same recall, and a visit costs an exchange of a vector, against a dot product for each vector of the cell.
PER_CELL, MAX_CODES = 64, 1024
#: Share of pairs at exactly the threshold that the traversal must reach; nearer pairs are reached more often.
TARGET_RECALL = 0.98
#: A cell with more vectors, or VISITORS times as many visits, is dealt in blocks; each two blocks of them are a task.
HOT, VISITORS = 4096, 4
#: Up to so many cells dealt in blocks are broadcast, beyond it joined; there are no more than the grid has.
CELLS = 1 << 18


def usable(values) -> np.ndarray | None:
    """The unit vector in double precision; None if null, empty, zero, or with null or non-finite components."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    n = np.linalg.norm(x)
    return x / n if np.isfinite(n) and n > 0 else None


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(at, x[:, j], k) / np.maximum(n, 1), c[:, j])
    return c


def _squared(x, c):
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _nearest(x, c):
    return np.concatenate([_squared(x[a : a + 8192], c).argmin(1) for a in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


class MultiIndex:
    """Two codebooks, one for each half; cell (i, j) has number i * k + j."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits
        self.half, self.k = first.shape[1], len(first)

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, seed: int = 42) -> MultiIndex:
        """x: a sample of unit vectors; rows: how many the index will hold."""
        rng = np.random.default_rng(seed)
        k = int(min(MAX_CODES, max(1, round((rows / PER_CELL) ** 0.5)), len(x)))
        half = max(1, x.shape[1] // 2)
        index = cls(_kmeans(x[:, :half], k, rng), _kmeans(x[:, half:] if x.shape[1] > half else x[:, :half], k, rng), 1)
        index.visits = index.calibrated(x, rng)
        return index

    def parts(self, x: np.ndarray):
        """Squared distances of both halves to their codebooks; other lengths are cut or padded, for placing only."""
        width = self.half + self.second.shape[1]
        if x.shape[1] != width:
            x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]
        return _squared(x[:, : self.half], self.first), _squared(x[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.parts(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def calibrated(self, x: np.ndarray, rng, tries: int = 2000) -> int:
        """Visits needed to reach TARGET_RECALL of pairs at cosine THRESHOLD, from either side."""
        x = x[rng.permutation(len(x))[:tries]]
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        length = np.linalg.norm(noise, axis=1)
        if not (length > 0).all():  # one dimension: no other direction
            return 1
        y = THRESHOLD * x + (1 - THRESHOLD**2) ** 0.5 * noise / length[:, None]
        at = [self._rank(u, self.cells(v)) for u, v in ((x, y), (y, x))]
        need = int(np.ceil(np.quantile(np.minimum(*at), TARGET_RECALL))) + 1
        return min(need, self.k * self.k)

    def _rank(self, x, cells):
        """Cells nearer than the given one, for each row."""
        out = np.empty(len(x), int)
        a, b = self.parts(x)
        for r in range(len(x)):
            goal = a[r, cells[r] // self.k] + b[r, cells[r] % self.k]
            out[r] = np.searchsorted(np.sort(b[r]), goal - a[r], side="left").sum()
        return out

    def visit(self, x: np.ndarray) -> np.ndarray:
        """Multi-sequence traversal: for each row the numbers of its `visits` nearest cells, nearest first."""
        a, b = self.parts(x)
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, ia, 1).tolist(), np.take_along_axis(b, ib, 1).tolist()
        k, want = self.k, self.visits
        out = np.empty((len(x), want), np.int64)
        for r, (ra, rb) in enumerate(zip(a, b, strict=True)):
            heap, ca, cb = [(ra[0] + rb[0], 0, 0)], ia[r], ib[r]
            for n in range(want):
                _, i, j = heapq.heappop(heap)
                out[r, n] = ca[i] * k + cb[j]
                if i + 1 < k and j == 0:  # each cell is pushed once: along the first row, and down each column
                    heapq.heappush(heap, (ra[i + 1] + rb[0], i + 1, 0))
                if j + 1 < k:
                    heapq.heappush(heap, (ra[i] + rb[j + 1], i, j + 1))
        return out


def _joined(hits: list[np.ndarray], own: np.ndarray, n: int):
    """A spanning forest of links: for visitor v (node own[v]) and its hits, the (a, b) that join two trees."""
    label, edges = np.arange(n), []
    for v in range(len(own)):
        if not len(hits[v]):
            continue
        nodes = np.append(hits[v], own[v])
        trees, first = np.unique(label[nodes], return_index=True)
        if len(trees) > 1:
            home = label[own[v]]
            edges += [(own[v], nodes[f]) for t, f in zip(trees, first, strict=True) if t != home]
            label[np.isin(label, trees)] = trees[0]
    return edges


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept.

    Pairs are found by the index and verified: cosine in double precision at least `threshold`, never less. n_links: other
    vectors linked directly, equal vectors among them. A pair is found if either visits the other's cell, and then counts for
    both. Equal vectors are one node with a multiplicity, so copies are never expanded into pairs; in a dense cell each task
    returns counts and a spanning forest, not pairs. Vectors of different lengths never link. Vectors of floats travel as floats.
    Defined results: vectors that are null, empty, zero, or with null or non-finite components link with nothing; a null
    vec_id keeps its row and names no component (null if none there has an id); repeated vec_ids are separate vectors; an
    empty table gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    number = np.float32 if single else np.float64
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>"))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda e: e != 0), F.lit(False))
    v = v.withColumn("embedding", F.when(good, F.col("embedding")))
    d = v.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    d = materialize(d.withColumn("node", F.monotonically_increasing_id()), "vectors")  # fixed by what is written
    rows = d.count()
    sample = [usable(r[0]) for r in d.orderBy(F.xxhash64("embedding")).select("embedding").limit(FIT_ROWS).collect()]
    sample = [s for s in sample if s is not None]
    size = max(set(map(len, sample)), key=list(map(len, sample)).count) if sample else 2
    x = np.array([s for s in sample if len(s) == size]) if sample else np.eye(2)
    held = spark.sparkContext.broadcast(MultiIndex.fit(x, rows))  # at most 2 * MAX_CODES half vectors

    def place(batches):
        index = held.value
        for b in batches:
            node, mult = b.column(0).to_numpy(), b.column(1).to_numpy()
            given = b.column(2).to_pylist()
            units = [usable(e) for e in given]
            for length in sorted({len(u) for u in units if u is not None}):
                at = np.array([k for k, u in enumerate(units) if u is not None and len(u) == length])
                for part in np.array_split(at, -(-len(at) // max(1, min(2048, (1 << 21) // index.visits)))):
                    unit = np.array([units[k] for k in part])
                    yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(mult[part]), pa.array(np.full(len(part), length, np.int32)), pa.array(index.cells(unit)), pa.array(list(index.visit(unit)), pa.list_(pa.int64())), pa.array([np.asarray(given[k], number).tobytes() for k in part], pa.binary())], names=["node", "mult", "length", "home", "visits", "vector"])

    p = materialize(d.select("node", "mult", "embedding").mapInArrow(place, "node long, mult long, length int, home long, visits array<long>, vector binary"), "placed")
    load = p.select("length", "home", F.explode("visits").alias("cell")).groupBy("length", "cell")  # a vector's home is its first visit
    load = load.agg(F.sum((F.col("cell") == F.col("home")).cast("long")).alias("members"), F.count("*").alias("visitors"))
    load = load.select("length", "cell", F.ceil(F.greatest(F.lit(1), "members") / HOT).cast("int").alias("of_members"), F.ceil(F.col("visitors") / (VISITORS * HOT)).cast("int").alias("of_visitors"))
    hot = materialize(load.where("of_members > 1 or of_visitors > 1"), "hot-cells")
    hot_ = hot.hint("broadcast" if hot.count() <= CELLS else "merge")

    def in_blocks(cells):
        """cells with of_members and of_visitors, the blocks of its cell's members and visitors, and `block`, the node's of the latter."""
        cells = cells.join(hot_, ["length", "cell"], "left")
        cells = cells.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("of_members", "of_visitors")})
        return cells.withColumn("block", F.pmod(F.xxhash64("node"), F.col("of_visitors")).cast("int"))

    # Members go to every block of visitors, visitors to every block of members. In a cell with one block of members these are
    # visitors themselves (role 0) in their own block of visitors; elsewhere they are only visited (1), and sent as visitors (2) too.
    members = in_blocks(p.withColumn("cell", F.col("home"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of_visitors") - 1)))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("of_members")).cast("int")
    role = F.when((F.col("of_members") == 1) & (F.col("with") == F.col("block")), 0).otherwise(1)
    members = members.select("length", "cell", (mine * F.col("of_visitors") + F.col("with")).alias("share"), role.alias("role"), "node", "mult", "home", "visits", "vector")
    visitors = in_blocks(p.withColumn("cell", F.explode("visits"))).where("cell <> home or of_members > 1")
    visitors = visitors.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of_members") - 1)))
    none = F.lit(None).cast("array<long>")
    visitors = visitors.select("length", "cell", (F.col("with") * F.col("of_visitors") + F.col("block")).alias("share"), F.lit(2).alias("role"), "node", "mult", "home", none.alias("visits"), "vector")
    both = members.unionByName(visitors).repartition("length", "cell", "share").sortWithinPartitions("length", "cell", "share", "role")

    def verify(groups):
        """groups: rows of one cell and share, members first."""
        counts, edges = [], []
        for role, node, mult, home, visits, vector in groups:
            m = int((role < 2).sum())
            who = np.flatnonzero(role != 1)
            if not m or not len(who) or len(role) == 1:
                continue
            vec = np.frombuffer(b"".join(vector), number).reshape(len(vector), -1).astype(np.float64)
            vec /= np.linalg.norm(vec, axis=1)[:, None]
            own, place_of = node[who], {n: k for k, n in enumerate(node[:m].tolist())}
            at = np.array([place_of.get(n, -1) for n in own.tolist()])  # a member that visits its own cell
            seen = [set(x) for x in visits[:m]]
            mine, theirs = np.zeros(len(own), np.int64), np.zeros(m, np.int64)
            hits = []
            for a in range(0, len(own), 512):
                part = who[a : a + 512]
                hit = vec[part] @ vec[:m].T >= threshold
                for r in np.flatnonzero(at[a : a + len(part)] >= 0):
                    hit[r, at[a + r]] = False
                mine[a : a + len(hit)] = hit @ mult[:m]
                # Members that don't visit a visitor's home count what has come from it; a visitor of this home comes to all.
                out = np.flatnonzero(hit.any(1) & (home[part] != home[0]))
                homes = home[part][out]
                for other in np.unique(homes):
                    unseen = np.array([int(other) not in x for x in seen])
                    rows = out[homes == other]
                    theirs += (mult[part[rows]] @ hit[rows]) * unseen
                hits += [np.flatnonzero(h) for h in hit]
            ids = np.where(at >= 0, at, m + np.arange(len(own)))
            names = np.concatenate([node[:m], own])
            edges += [(int(names[a]), int(names[b])) for a, b in _joined(hits, ids, m + len(own))]
            counts += [(int(n), int(c)) for n, c in zip(np.concatenate([own, node[:m]]).tolist(), np.concatenate([mine, theirs]).tolist(), strict=True) if c]
        return counts, edges

    def run(batches):
        def split(cols, final):
            key = np.stack([c.to_numpy() for c in cols[:3]]).astype(np.int64)
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            bounds = [0, *cut.tolist(), key.shape[1]]
            if not final:
                bounds.pop()
            node, mult, home = (c.to_numpy() for c in (cols[4], cols[5], cols[6]))
            role, visits, vector = cols[3].to_numpy(), cols[7], cols[8]
            groups = ((role[a:z], node[a:z], mult[a:z], home[a:z], visits.slice(a, z - a).to_pylist(), vector.slice(a, z - a).to_pylist()) for a, z in zip(bounds, bounds[1:], strict=False))
            return groups, bounds[-1]

        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None or not rest.num_rows else pa.concat_tables([rest, t])
            if rest.num_rows < 8192:
                continue
            groups, end = split([c.combine_chunks() for c in rest.columns], False)
            yield from told(*verify(groups))
            rest = rest.slice(end)
        if rest is not None and rest.num_rows:
            groups, _ = split([c.combine_chunks() for c in rest.columns], True)
            yield from told(*verify(groups))

    def told(counts, edges):
        if counts or edges:
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in counts] + [e[0] for e in edges], pa.int64()), pa.array([None] * len(counts) + [e[1] for e in edges], pa.int64()), pa.array([c[1] for c in counts] + [0] * len(edges), pa.int64())], names=["a", "b", "n"])

    found = materialize(both.mapInArrow(run, "a long, b long, n long"), "links")
    discard(hot, p)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("b is not null").select("a", "b"))
    e = d.join(links, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    e = e.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    lows = e.groupBy("component").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = e.join(lows, ["component", "salt"]).select(F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = v.where("embedding is not null").join(e, F.col("embedding") == F.col("e")).select("vec_id", "n_links", "component_id")
    alone = v.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
