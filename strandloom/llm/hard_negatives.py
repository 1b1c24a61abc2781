"""Hard negatives by one-dimensional distance keys.

Components are whole numbers floor(256 x). A vector v becomes (v, sqrt(M^2 - |v|^2)), M the greatest length, an anchor a becomes (a, 0): then the
nearer, the greater the inner product, as distance^2 = |a|^2 + M^2 - 2 a.v. Every row is stored under its nearest pivot and its distance to it, sorted by
(label, pivot, distance, id) and cut into blocks of ``BLOCK`` rows. A search is an annulus around an anchor: by the triangle inequality its
rows have, at each pivot, a key in one interval. The annulus grows outward; blocks that its intervals did not meet before
are read, a block and ``BATCH`` searches at a time as one matrix product, and the best rows so far are kept. A search is over when as many as
it needs are known to lie within the annulus, or nothing lies beyond it. So the result is exact; the pivots, taken from a bounded sample (``SAMPLE`` rows by hash
of the id), and the first radius, guessed from the same sample, change only how much is read.

First search: an anchor's nearest rows of its own label, its positives. Second, for each positive: rows of other labels whose score lies in a window below the positive's.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that repeat a vec_id one stays, the least label and then
vector. Vectors of different lengths count as if filled up with zeros; an empty vector is zero. Components beyond 2^24 count as 2^24, so
that scores of up to 2^15 components stay exact. Ties go to the smaller vec_id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scans import sorted_parts
from .common import arrow_ddl, cut

SCALE, TOP = 256, 1 << 24
EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 10, 30, 90
BLOCK, BATCH, SAMPLE, SAMPLE_NUMBERS, MOST_PIVOTS, ROWS_A_PIVOT = 512, 256, 4096, 1 << 19, 64, 2000
#: A first annulus is to hold so many times the rows needed, and each next one so many times those of the one before.
FIRST, GROWTH = 4.0, 8.0
#: Distances come from differences of squares, so they are good to the root of 2^-52: intervals are wider by this share of the greatest distance.
SLACK = 1e-6

_KEYED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("pivot", pa.int32()), ("distance", pa.float64())])
_BLOCKS = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("task", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])
_SPANS = pa.schema([("task", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("old_lo", pa.float64()), ("old_hi", pa.float64()), ("seen", pa.float64()), ("bound", pa.float64())])


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (array of int) of the rows that take part, once each."""
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x")).where(finite)
    v = F.transform("x", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c, F.lit(1e9)), F.lit(-1e9)) * SCALE), F.lit(TOP)), F.lit(-TOP)).cast("int"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", v.alias("v"))).alias("r")).select("vec_id", "r.label", "r.v")


def _square(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda s, c: s + c.cast("bigint") * c.cast("bigint"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Of lists, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _unpacked(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.int32).reshape(len(vectors), width).astype(float)


def _raised(m: np.ndarray, top: float) -> np.ndarray:
    """The further component that gives all rows the length sqrt(top)."""
    return np.column_stack((m, np.sqrt(np.maximum(top - (m * m).sum(1), 0))))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other, each then moved to the mean of the rows nearest to it, a few times."""
    chosen, nearest = [sample[0]], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(sample[int(nearest.argmax())])
        nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(1))
    pivots = np.array(chosen)
    for _ in range(5):
        own = _squares(sample, pivots).argmin(1)
        pivots = np.array([sample[own == i].mean(0) if (own == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _exact_products(block: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Integer inner products: as floating-point numbers while these hold them, else as integers."""
    bound = float(np.abs(block).max(initial=0)) * float(np.abs(asked).max(initial=0)) * block.shape[1]
    return (block @ asked.T).astype(np.int64) if bound < 2**52 else block.astype(np.int64) @ asked.astype(np.int64).T


class Index:
    """The rows by (label, pivot, distance), in blocks."""

    def __init__(self, vectors: DataFrame):
        """vectors: vec_id, label, v (array of int); a written table."""
        about = vectors.agg(F.count("*").alias("n"), F.max(_square("v")).alias("top"), F.max(F.size("v")).alias("width")).first()
        self.n, self.top, self.width = about.n, float(about.top or 0), max(about.width or 0, 1)
        if not self.n:
            return
        size = max(256, min(SAMPLE, SAMPLE_NUMBERS // self.width))
        some = vectors if self.n <= 4 * size else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(self.n)) < 4 * size)  # so that few rows are sorted
        taken = some.select("vec_id", "label", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).collect()
        self.sample = _raised(_matrix([r.v for r in taken], self.width), self.top)
        self.sampled = np.array([r.vec_id for r in taken]), np.array([r.label for r in taken])
        self.pivots = _pivots(self.sample, max(1, min(MOST_PIVOTS, self.n // ROWS_A_PIVOT)))
        self.reach = 2 * max(self.top, 1.0) ** 0.5  # no two points are further apart
        self.keyed = cut(self._keyed(vectors))
        self.blocks = cut(self._blocks())
        self.directory = cut(self.blocks.select("block", "label", "pivot", "near", "far"))

    def _keyed(self, vectors: DataFrame) -> DataFrame:
        top, width, pivots = self.top, self.width, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    m = _matrix(part.column(2).to_pylist(), width)
                    d = _squares(_raised(m, top), pivots)
                    own = d.argmin(1)
                    packed = pa.array([x.tobytes() for x in m.astype(np.int32)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, pa.array(own.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(own)), own]))], schema=_KEYED)

        return vectors.select("vec_id", "label", "v").mapInArrow(run, arrow_ddl(_KEYED))

    def _blocks(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def packed() -> pa.RecordBatch:
                ids, labels, vectors, own, distances = zip(*held, strict=True)
                row = (ids[0], labels[0], own[0], distances[0], distances[-1], np.array(ids, np.int64).tobytes(), b"".join(vectors))  # a block is known by its first row's id
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCKS.types, strict=True)], schema=_BLOCKS)

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (len(held) == BLOCK or (row[1], row[3]) != (held[0][1], held[0][3])):
                        yield packed()
                        held.clear()
                    held.append(row)
            if held:
                yield packed()

        return sorted_parts(self.keyed, ["label", "pivot", "distance", "vec_id"]).mapInArrow(run, arrow_ddl(_BLOCKS))

    def nearest(self, tasks: DataFrame, needed: int, same: bool) -> DataFrame:
        """task, rank, vec_id, score of each task's best rows. tasks: task, anchor, label, v, low, high: an anchor's id, label and packed vector, and the least and
        greatest score wanted (null: any); a written table.

        same: rows of the anchor's label, not itself; else rows of other labels. Every round works on the tasks that are not over yet.
        """
        best, done, old, share, n_tasks = None, None, None, FIRST * needed / self.n, tasks.count()
        while True:
            spans = cut(self._spans(tasks if done is None else tasks.join(done, "task", "left_anti"), needed, same, old, share))
            found = self._read(tasks, spans, needed, same)
            best = self._kept(found if best is None else best.select("task", "score", "vec_id").unionByName(found), needed)
            if share >= 1:
                return best
            reached = spans.groupBy("task").agg(F.max("seen").alias("seen")).join(tasks.select("task", "low"), "task")
            full = best.groupBy("task").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            known = (F.col("seen") <= F.coalesce("low", F.lit(float("-inf")))) | ((F.col("n") >= needed) & (F.col("least") >= F.col("seen")))  # rows of a score of ``seen`` and more have all been read
            over = reached.join(full, "task", "left").where(known).select("task")
            done = cut(over if done is None else over.unionByName(done))
            if done.count() == n_tasks:
                return best
            old, share = share, share * GROWTH

    def _spans(self, tasks: DataFrame, needed: int, same: bool, old: float | None, share: float) -> DataFrame:
        """task, pivot, the interval of keys now and in the round before, seen (rows of that score and more are all in then), bound (so many rows of the sample that are wanted have that score or more, so no row below it is)."""
        top, width, slack, reach = self.top, self.width, SLACK * self.reach, self.reach
        sent = tasks.sparkSession.sparkContext.broadcast((self.pivots, self.sample, *self.sampled))  # all of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, sample, ids, labels = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    task, anchor, label, v, low, high = (c.to_pylist() for c in batch.slice(at, 256).columns)
                    m = _unpacked(v, width)
                    length, a = (m * m).sum(1), np.column_stack((m, np.zeros(len(m))))
                    bound = np.array([_bound(own, (labels == lab) == same, ids != anc, l, h, needed) for own, lab, anc, l, h in zip(_exact_products(m, sample[:, :width]), label, anchor, low, high, strict=True)])
                    last = np.sqrt(np.maximum(length + top - 2 * np.maximum(bound, -4.0 * top), 0))  # no row wanted is further away
                    inner = np.sqrt(np.maximum(length + top - 2 * np.array([np.inf if h is None else float(h) for h in high]), 0))
                    sampled = np.sort(np.sqrt(_squares(a, sample)), axis=1)
                    d = np.sqrt(_squares(a, pivots))
                    outer = np.minimum(_radius(sampled, inner, share), reach)
                    spans = lambda r: (np.maximum(d - r[:, None], inner[:, None] - d) - slack, d + r[:, None] + slack)
                    lo, hi = spans(np.minimum(outer, last))
                    old_lo, old_hi = (np.full(d.shape, np.inf), np.full(d.shape, -np.inf)) if old is None else spans(np.minimum(np.minimum(_radius(sampled, inner, old), reach), last))
                    least = (length + top - outer * outer) / 2
                    seen = np.where(outer >= reach, -np.inf, np.where(outer >= last, bound, least + np.abs(least) * 1e-9 + 1e-3))
                    columns = np.repeat(task, len(pivots)), np.tile(np.arange(len(pivots), dtype=np.int32), len(a)), lo.ravel(), hi.ravel(), old_lo.ravel(), old_hi.ravel(), np.repeat(seen, len(pivots)), np.repeat(bound, len(pivots))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SPANS.types, strict=True)], schema=_SPANS)

        return tasks.select("task", "anchor", "label", "v", "low", "high").mapInArrow(run, arrow_ddl(_SPANS))

    def _read(self, tasks: DataFrame, spans: DataFrame, needed: int, same: bool) -> DataFrame:
        """The best rows of every block that a task's intervals meet now and did not meet before."""
        meets = lambda lo, hi: (F.col("far") >= F.col(lo)) & (F.col("near") <= F.col(hi))
        label = F.col("label") == F.col("own") if same else F.col("label") != F.col("own")
        own = spans.drop("seen").join(tasks.select("task", "anchor", F.col("label").alias("own"), "low", "high"), "task")
        met = own.join(self.directory, "pivot").where(label & meets("lo", "hi") & ~meets("old_lo", "old_hi"))
        least = F.when(F.col("bound") > float("-inf"), F.col("bound").cast("bigint"))
        pairs = cut(met.groupBy("block", "anchor").agg(F.collect_list(F.struct("task", F.greatest("low", least).alias("low"), "high")).alias("windows")))  # an anchor has few tasks
        sizes = pairs.groupBy("block").agg(F.ceil(F.count("*") / BATCH).alias("batches"))
        dealt = pairs.join(sizes, "block").withColumn("batch", F.pmod(F.xxhash64("anchor"), "batches"))
        vectors = tasks.groupBy("anchor").agg(F.first("v").alias("v"))
        asked = dealt.join(vectors, "anchor").groupBy("block", "batch").agg(F.collect_list(F.struct("anchor", "v", "windows")).alias("asked"))
        work = asked.join(self.blocks.select("block", "ids", "vectors"), "block").select("ids", "vectors", "asked")
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    ids, vectors, asked = (c.slice(at, 1).to_pylist()[0] for c in batch.columns)
                    ids = np.frombuffer(ids, np.int64)
                    scores = _exact_products(_unpacked([x["v"] for x in asked], width), np.frombuffer(vectors, np.int32).reshape(-1, width).astype(float))
                    out = [_best(ids, own, x["anchor"], w["low"], w["high"], w["task"], needed) for x, own in zip(asked, scores, strict=True) for w in x["windows"]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=_FOUND)

        return work.mapInArrow(run, arrow_ddl(_FOUND))

    def _kept(self, found: DataFrame, needed: int) -> DataFrame:
        order = Window.partitionBy("task").orderBy(F.desc("score"), "vec_id")
        return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= needed))


def _radius(sampled: np.ndarray, inner: np.ndarray, share: float) -> np.ndarray:
    """Outer radii of annuli from ``inner`` that hold about this share of the sample (its sorted distances are given)."""
    out, n = np.full(len(inner), np.inf), sampled.shape[1]
    at = (sampled < inner[:, None]).sum(1) + int(np.ceil(share * n))
    inside = np.flatnonzero(at < n) if share < 1 else []
    out[inside] = sampled[inside, at[inside]]
    return out


def _bound(scores: np.ndarray, labelled: np.ndarray, others: np.ndarray, low: int | None, high: int | None, needed: int) -> float:
    """The score of the last of so many wanted rows of the sample; -inf if it has fewer."""
    own = scores[labelled & others & (scores >= (-np.inf if low is None else low)) & (scores <= (np.inf if high is None else high))]
    if len(own) < needed:
        return -np.inf
    least = int(np.partition(own, len(own) - needed)[len(own) - needed])
    return float(least) if float(least) <= least else float(np.nextafter(float(least), -np.inf))


def _best(ids: np.ndarray, scores: np.ndarray, anchor: int, low: int | None, high: int | None, task: int, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The task, scores and ids of the best rows of a block within the window, the anchor itself left out."""
    fit = ids != anchor
    if low is not None:
        fit &= scores >= low
    if high is not None:
        fit &= scores <= high
    at = np.flatnonzero(fit)
    if len(at) > needed:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - needed)[len(own) - needed]]
        at = at[np.lexsort((ids[at], -scores[at]))[:needed]]
    return np.full(len(at), task), scores[at], ids[at]


def mine(embeddings: DataFrame, relabel: Column | None = None, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: rows whose vec_id is divisible by ``every``. Positives: the first so many rows of the anchor's label. Negatives of each: the first so many
    rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's. relabel: the label to use, of vec_id and label.
    """
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = whole_vectors(embeddings)
    vectors = cut(rows if relabel is None else rows.withColumn("label", relabel.cast("bigint")))
    index = Index(vectors)
    if not index.n:
        return embeddings.sparkSession.createDataFrame([], schema)
    none = F.lit(None).cast("bigint")
    anchors = cut(index.keyed.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("task"), F.col("vec_id").alias("anchor"), "label", "v", none.alias("low"), none.alias("high")))
    near = index.nearest(anchors, positives, same=True).select("task", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # low * p <= 100 * s <= high * p, which no s satisfies for a negative p
    window = F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"({high} * positive_score) div 100")
    wanted = anchors.drop("low", "high").join(near.where("positive_score >= 0"), "task").drop("task")
    tasks = cut(wanted.select(F.monotonically_increasing_id().alias("task"), "anchor", "label", "v", window[0].alias("low"), window[1].alias("high"), "positive_id", "positive_score"))
    far = index.nearest(tasks, negatives, same=False).select("task", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = far.join(tasks.select("task", F.col("anchor").alias("anchor_id"), "positive_id", "positive_score"), "task")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
