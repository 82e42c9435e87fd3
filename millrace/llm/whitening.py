"""Embedding whitening: the leading principal components by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import written

COMPONENTS = 32
#: Every entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries that leave this range once scaled are held at its ends, so that every one is exact in a double.
LIMIT = 1 << 52
#: Bytes of scaled entries in one block: the unit that tasks read and multiply.
BLOCK_BYTES = 4 << 20
#: Residual of an eigenvector at which it is certified, over the root of its eigenvalue times the largest: what rounding allows.
TOLERANCE = 2e-14
#: Certification is given up, with an error, after so many passes over the data.
MOST_PASSES = 400
#: A filter may widen the differences between columns by so much before they are made orthogonal again.
SPREAD = 1e9
#: Partial sums that reach the driver at once; more of them are summed by tasks first.
PARTIALS = 64
_LONG = (1 << 63) - 1


def _decoded(ids: pa.Array, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(len(ids), -1).astype(np.int64) if len(data) else np.zeros((len(ids), 0), np.int64)


def scaled_blocks(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(ids, data, width): the usable vectors as blocks of scaled whole numbers without OFFSET, written once.

    Rows whose vector is null, or holds a null, a NaN or an infinity, are left out; so are those whose length is not the
    most frequent one (the larger of equally frequent ones), and empty vectors.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = df.select(F.col(id_col).alias("_id"), vector.alias("_v")).where(
        "_v IS NOT NULL AND size(_v) > 0 AND forall(_v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    frequent = usable.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = frequent[0]["d"] if frequent else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK_BYTES // (8 * max(1, dims)))
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
            for at in range(0, len(x), rows):
                part = x[at : at + rows]
                width = next(w for w in (2, 4, 8) if w == 8 or np.abs(part).max() < 1 << (8 * w - 1))
                ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids), pa.array([part.astype(f"<i{width}").tobytes()], pa.binary()),
                     pa.array([width], pa.int32())], names=["ids", "data", "width"])

    schema = T.StructType([
        T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("data", T.BinaryType()), T.StructField("width", T.IntegerType())])
    return written(usable.where(F.size("_v") == dims).mapInArrow(pack, schema), "vectors")


def _summed(df: DataFrame, parts: int, shape: tuple[int, ...], part_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what ``part_of`` gives for one, a float array of ``shape``.

    Each of the ``parts`` tasks adds up its own blocks. Up to PARTIALS sums come to the driver as they are, in the order of the tasks; of
    more, each of PARTIALS groups is added up by a task first, in the same order.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for ids, data, width in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total += part_of(_decoded(ids.values, data, width))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for raw in table.sort_by("part")["total"].to_pylist():
            total += np.frombuffer(raw).reshape(shape)
        return pa.table({"part": pa.array([table["part"][0].as_py() % PARTIALS], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    sums = df.mapInArrow(partial, "part int, total binary")
    if parts > PARTIALS:
        sums = sums.groupBy(F.col("part") % PARTIALS).applyInArrow(merge, "part int, total binary")
    total = np.zeros(shape)
    for row in sorted(sums.collect(), key=lambda r: r.part):
        total += np.frombuffer(row.total).reshape(shape)
    return total


@dataclass
class Centred:
    """The vectors of the fit list: blocks in the shared folder and what one exact pass has counted."""

    blocks: DataFrame
    n: int
    sums: list[int]
    trace: float
    parts: int = 1
    passes: int = 0

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows of n * x - S, exact, over n; in doubles only where whole numbers of 64 bits do not suffice."""
        n, sums = self.n, self.sums
        fits = n * LIMIT + max(map(abs, sums), default=0) < _LONG
        exact = np.array(sums, np.int64 if max(map(abs, sums), default=0) < _LONG else float)

        def rows(x: np.ndarray) -> np.ndarray:
            if fits or (len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) < _LONG):
                return (x * n - exact) / n
            return x - np.array([s / n for s in sums])

        return rows

    def product(self, q: np.ndarray, locked: np.ndarray | None = None) -> np.ndarray:
        """The covariance times ``q``: one pass, in which each task forms its part of X'(XQ).

        Tasks take the columns of ``locked`` out of their rows first, so that a large component already found does not
        drown the others in its rounding.
        """
        centre = self.centre()

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            if locked is not None and locked.shape[1]:
                c = c - (c @ locked) @ locked.T
            return c.T @ (c @ q)

        self.passes += 1
        return _summed(self.blocks, self.parts, q.shape, part) / self.n


def counted(blocks: DataFrame) -> Centred:
    """Number, sums and centred squares of the vectors; sums are exact whole numbers."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, None, None
        for batch in batches:
            for ids, data, width in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = _decoded(ids.values, data, width)
                small = int(np.abs(x).max()) ** 2 * len(x) < _LONG
                y = x if small else x.astype(object)
                s, q = y.sum(axis=0), (y * y).sum(axis=0)
                n, sums, squares = n + len(x), s.astype(object) + (0 if sums is None else sums), q.astype(object) + (0 if squares is None else squares)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([[str(v) for v in sums]], pa.list_(pa.string())), pa.array([[str(v) for v in squares]], pa.list_(pa.string()))],
                names=["n", "sums", "squares"])

    each = blocks.mapInArrow(totals, "n long, sums array<string>, squares array<string>")
    placed = each.select("n", F.posexplode(F.arrays_zip("sums", "squares")).alias("i", "v"))
    rows = placed.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("v.sums").cast("decimal(38,0)")).alias("s"), F.sum(F.col("v.squares").cast("decimal(38,0)")).alias("q")).orderBy("i").collect()
    n = int(rows[0].n) if rows else 0
    # n * q - s * s is a whole number of Python, so nothing cancels.
    trace = sum((n * int(r.q) - int(r.s) ** 2) / n**2 for r in rows)
    parts = blocks.select(F.spark_partition_id().alias("p")).distinct().count()
    return Centred(blocks, n, [int(r.s) for r in rows], trace, parts)


@dataclass
class Lanczos:
    """One vector's Krylov space, built by the passes that the filter makes anyway; its ends bound the spectrum."""

    vectors: list[np.ndarray]
    known: float = 0.0
    alpha: list[float] = field(default_factory=list)
    beta: list[float] = field(default_factory=list)

    @property
    def at(self) -> np.ndarray:
        return self.vectors[-1]

    def advance(self, product: np.ndarray) -> None:
        if len(self.alpha) >= len(self.at) or (self.beta and self.beta[-1] == 0):
            return
        self.alpha.append(float(self.at @ product))
        basis = np.column_stack(self.vectors)
        rest = product - basis @ (basis.T @ product)
        rest -= basis @ (basis.T @ rest)
        norm = float(np.linalg.norm(rest))
        norm = 0.0 if norm <= 1e-12 * max(map(abs, self.alpha)) else norm
        self.beta.append(norm)
        if norm:
            self.vectors.append(rest / norm)

    def lowest(self) -> float:
        """An estimate from below of the least eigenvalue: the least Ritz value less its residual."""
        if not self.alpha:
            return self.known
        m = np.diag(self.alpha) + np.diag(self.beta[: len(self.alpha) - 1], 1) + np.diag(self.beta[: len(self.alpha) - 1], -1)
        values, vectors = np.linalg.eigh(m)
        return max(self.known, float(values[0] - abs(self.beta[-1] * vectors[-1, 0])))


def _orthonormal(y: np.ndarray, against: np.ndarray) -> np.ndarray:
    """QR of the columns, scaled first, orthogonal to ``against``; twice, so that orthogonality is that of doubles."""
    for _ in range(2):
        y = y - against @ (against.T @ y)
        norms = np.linalg.norm(y, axis=0)
        y, _ = np.linalg.qr(y / np.where(norms > 0, norms, 1))
    return y


@dataclass
class Whitening:
    """A fitted model: what every row is centred by, its components and their eigenvalues, largest first."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0
    residual: float = 0.0


def _growth(value: float, low: float, high: float) -> float:
    """How fast, per degree, the Chebyshev polynomial that stays within 1 on [low, high] grows at ``value``; as a logarithm."""
    at = (2 * value - high - low) / (high - low)
    return math.acosh(at) if at > 1 else 0.0


def leading(data: Centred, components: int = COMPONENTS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(vectors, values, residual): the leading eigenvectors of the covariance, largest first, certified.

    A block of the wanted number and half as many guards, at least 8, goes through the Chebyshev polynomial that is small
    on the unwanted spectrum, from a lower bound of it up to the least guard. Each degree is one distributed pass; one
    Lanczos vector rides along and sharpens the lower bound. Then QR, Rayleigh-Ritz with the product of the next pass,
    and residuals: leading columns below TOLERANCE are locked and taken out of every later product. The degree is as high
    as SPREAD allows. A component above the wanted ones that was missed would grow faster than they do, and
    the block begins at random, so when all wanted ones are certified none is missing. Components that are no more than
    rounding (d * 2**-52 of the largest) are left out; where the block would span the whole space, one pass is enough.
    """
    dims = len(data.sums)
    if not dims:
        return np.zeros((0, 0)), np.zeros(0), 0.0
    rng = np.random.default_rng(seed)
    wanted = min(components, dims)
    block = min(dims, wanted + max(8, wanted // 2))
    locked, found = np.zeros((dims, 0)), np.zeros(0)
    q = _orthonormal(rng.standard_normal((dims, block)), locked)
    lanczos = Lanczos([_orthonormal(rng.standard_normal((dims, 1)), locked)[:, 0]])
    worst, stuck, best = 0.0, 0, math.inf

    def times(y: np.ndarray) -> np.ndarray:
        both = data.product(np.column_stack([y, lanczos.at]), locked)
        lanczos.advance(both[:, -1])
        return both[:, :-1]

    while True:
        aq = times(q)
        values, turn = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        largest = max([float(values[0]), *found.tolist()])
        if largest <= 0:
            break
        residuals = np.linalg.norm(aq - q * values, axis=0) / np.sqrt(largest * np.maximum(values, dims * 2**-52 * largest))
        left = wanted - len(found)
        good = 0
        while good < left and residuals[good] <= TOLERANCE * math.sqrt(dims):
            good += 1
        now = float(residuals[good:left].max()) if good < left else 0.0
        # Rounding of the passes themselves can keep a residual just above the tolerance.
        stuck = stuck + 1 if now >= best / 2 and now <= 100 * TOLERANCE * math.sqrt(dims) else 0
        best = min(best, now)
        if stuck >= 2 or values[min(good, left - 1)] <= dims * 2**-52 * largest:
            good = left
        if good:
            worst = max(worst, float(residuals[:good].max()))
            locked, found = np.column_stack([locked, q[:, :good]]), np.concatenate([found, values[:good]])
            q, aq, values = q[:, good:], aq[:, good:], values[good:]
            stuck, best = 0, math.inf
            if len(found) < dims:
                lanczos = Lanczos([_orthonormal(rng.standard_normal((dims, 1)), locked)[:, 0]], lanczos.lowest())
        if len(found) >= wanted or not q.shape[1]:
            break
        if data.passes >= MOST_PASSES:
            raise RuntimeError(f"residual {now:.2g} after {data.passes} passes")
        high = float(values[-1])
        low = min(lanczos.lowest(), 0.999 * high)
        if high <= dims * 2**-52 * largest:
            # The guards are rounding already: nothing is left to damp, and a plain product does.
            q = _orthonormal(aq, locked)
            continue
        centre, half = (high + low) / 2, (high - low) / 2
        top, need = _growth(values[0], low, high), _growth(values[wanted - len(found) - 1], low, high)
        widest = int(math.log(SPREAD) / max(top - need, 1e-3))
        enough = int(math.ceil((math.log(max(now, TOLERANCE) / TOLERANCE) + 2) / max(need, 1e-3)))
        degree = max(1, min(widest, enough, 20))
        # The scaled three-term recurrence; the first product is the one that Rayleigh-Ritz has used.
        scale = half / (float(values[0]) - centre)
        first, y = scale, (aq - centre * q) * (scale / half)
        before, sigma = q, scale
        for _ in range(degree - 1):
            ay = times(y)
            following = 1 / (2 / first - sigma)
            before, y = y, (2 * following / half) * (ay - centre * y) - (sigma * following) * before
            sigma = following
        q = _orthonormal(y, locked)
    order = np.argsort(-found, kind="stable")
    keep = [i for i in order if found[i] > dims * 2**-52 * found.max()] if len(found) else []
    return locked[:, keep], found[keep], worst


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors in ``blocks``, and how far the covariance of the whitened vectors is from the identity."""
    data = counted(blocks)
    vectors, values, residual = leading(data, components)
    model = Whitening(data.n, data.sums, vectors, values, data.trace, 0.0, data.passes, residual)
    k = len(values)
    if k:
        centre, project = data.centre(), vectors / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = centre(x) @ project
            return np.vstack([w.T @ w, w.sum(axis=0)])

        total = _summed(blocks, data.parts, (k + 1, k), moments) / data.n
        model.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return model


def whitened(blocks: DataFrame, model: Whitening, id_type: T.DataType) -> DataFrame:
    """(vec_id, deviation, whitened): per vector the exact sum of (n * x - S)^2, null beyond a long, and its coordinates."""
    centre = Centred(blocks, model.n, model.sums, model.trace).centre()
    project = model.vectors / np.sqrt(model.values) if len(model.values) else np.zeros((len(model.sums), 0))
    n, sums = model.n, model.sums

    def deviations(x: np.ndarray) -> list[int | None]:
        high = n * int(np.abs(x).max()) + max(map(abs, sums))
        if high * high * x.shape[1] < _LONG:
            return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
        return [int(v) if v <= _LONG else None for v in exact]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, width in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = _decoded(ids.values, data, width)
                w = np.ascontiguousarray(centre(x) @ project)
                ends = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                    names=["vec_id", "deviation", "whitened"])

    schema = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return blocks.mapInArrow(rows, schema)


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(one row per usable vector: vec_id, deviation, whitened; the model).

    The fit list is all usable vectors. Rows are left out as ``scaled_blocks`` says; repeated rows and repeated or null ids count
    as often as they occur. Equal vectors, or fewer of them than components, give fewer components: those whose
    eigenvalue is only rounding are left out, and vectors that are all equal have none. An empty table gives no rows.
    Other columns are neither read nor returned. Vectors are written once as whole numbers, two bytes an entry where they
    fit; each pass reads them and returns one matrix of d times 49 doubles per task.
    """
    blocks = scaled_blocks(df, id_col, vector_col)
    model = fit(blocks, components)
    return whitened(blocks, model, df.schema[id_col].dataType), model


def whitened_embeddings(df: DataFrame) -> DataFrame:
    """A row per usable vector and component, with the model's own figures beside."""
    rows, model = whiten(df)
    share = [float(v) / model.trace for v in model.values]
    one = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s) for s in share]), F.col("_at") + 1) if share else F.lit(None).cast("double")
    return one.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
