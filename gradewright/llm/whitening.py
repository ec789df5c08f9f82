"""Whitening of embeddings from a covariance weighted by multiplicity.

Identical vectors are grouped first, so that each distinct vector is multiplied, whitened
and shuffled once, whatever the number of its rows. The covariance of the distinct
vectors, each weighted by one or by its count, is the sum of centred products formed in
the tasks (GEMM); a task hands on one d x d matrix, not rows. The driver solves one
d x d eigenproblem. Whitened vectors go back to the rows by a digest of the vector.

Vectors are put on an integer grid, x = floor(SCALE * c) + SHIFT, so that sums are exact
and "identical" is well defined.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, written

SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 52       # entries are kept within this many steps of zero
COMPONENTS = 16
RANK = 1e-13          # components with a smaller share of the variance are noise of the sums
STRIP = 8192          # vectors multiplied at a time
_WIDE = 1 << 62


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows whose vector is neither null nor empty and all finite."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return rows.filter((F.size("embedding") > 0) & finite)


def _named(column: str):
    """Digest of each vector on the grid, beside its id or (``column`` x) the vector itself."""
    def run(batches):
        for batch in batches:
            lists = batch["embedding"]
            x = np.floor(np.clip(lists.flatten().to_numpy() * SCALE, -LIMIT, LIMIT)).astype("<i8") + SHIFT
            start = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].tolist()
            cells = [x[a:b].tobytes() for a, b in zip(start[:-1], start[1:])]
            names = [hashlib.blake2b(c, digest_size=16).digest() for c in cells]
            other = pa.array(cells, pa.binary()) if column == "x" else batch["vec_id"]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), other], ["digest", column])
    return run


def _matrices(batches, column: str, dtype: str):
    """Strips of (matrix, weights, digests) from a column of packed vectors."""
    for batch in batches:
        for a in range(0, batch.num_rows, STRIP):
            part = batch.slice(a, STRIP)
            if part.num_rows:
                packed = b"".join(part[column].to_pylist())
                yield (np.frombuffer(packed, dtype).reshape(part.num_rows, -1),
                       part["weight"].to_numpy(zero_copy_only=False), part)


def _sums(batches):
    """Per task, one row a dimension: weighted sum of x (as text, it may need over 64 bits), greatest |x|."""
    total, n, reach = None, 0, 0
    for x, w, _ in _matrices(batches, "x", "<i8"):
        n += int(w.sum())
        reach = max(reach, int(np.abs(x).max(initial=0)))
        # High and low halves keep every product and sum within 64 bits.
        halves = [(part * w[:, None]).sum(axis=0).tolist() for part in (x >> 24, x & ((1 << 24) - 1))]
        own = [(a << 24) + b for a, b in zip(*halves)]
        total = own if total is None else [a + b for a, b in zip(total, own)]
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total)), pa.int64()), pa.array([n] * len(total), pa.int64()),
             pa.array([str(t) for t in total]), pa.array([reach] * len(total), pa.int64())],
            ["place", "n", "total", "reach"])


def _centred(x: np.ndarray, fit: "Fit") -> np.ndarray:
    """x - S / n, from the exact difference n * x - S where that fits into 64 bits."""
    if fit.n * fit.reach < _WIDE:
        return (x * fit.n - fit.sums) / fit.n
    return (x - fit.low) - fit.rest


@dataclass(frozen=True)
class Fit:
    """What whitening needs to know of the fit list; of the size of a d x d matrix."""

    n: int
    totals: tuple[int, ...]       # exact sum of each dimension
    reach: int                    # no |x - S / n| is greater
    covariance: np.ndarray | None = None
    values: np.ndarray | None = None   # eigenvalues by falling size
    axes: np.ndarray | None = None     # unit eigenvectors, one a column

    @property
    def sums(self) -> np.ndarray:
        return np.array(self.totals, np.int64)

    @property
    def low(self) -> np.ndarray:
        return np.array([t // self.n for t in self.totals], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(t % self.n) / self.n for t in self.totals])


def _products(fit):
    """Per task, one row a dimension: weighted products of the centred vectors."""
    def run(batches):
        total = None
        for x, w, _ in _matrices(batches, "x", "<i8"):
            centred = _centred(x, fit.value)
            part = centred.T @ (centred * w[:, None])
            total = part if total is None else total + part
        if total is not None:
            yield _matrix_rows(total)
    return run


def _matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total)), pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())],
        ["place", "products"])


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.stack([np.frombuffer(r) for r in rows["products"]]).sum(axis=0)
    return pd.DataFrame({"place": rows["place"].iloc[:1], "products": [total.tobytes()]})


def _collected(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' matrices: added row by row in the cluster, d rows to the driver."""
    rows = parts.groupBy("place").applyInPandas(_add_up, "place long, products binary").collect()
    return np.stack([np.frombuffer(r["products"]) for r in sorted(rows, key=lambda r: r["place"])])


def distinct_vectors(embeddings: DataFrame, weighting: str = "one") -> DataFrame:
    """(digest, x, weight): each distinct vector once, of the dimension most rows have.

    Copies are counted map-side, so that a vector a third of all rows hold is no hot key.
    """
    cells = usable(embeddings).mapInArrow(_named("x"), "digest binary, x binary")
    found = written(cells.groupBy("digest", "x").agg(F.count(F.lit(1)).alias("rows")), "distinct-vectors")
    widths = found.groupBy(F.octet_length("x").alias("width")).agg(F.sum("rows").alias("rows"))
    widest = widths.orderBy(F.desc("rows"), F.desc("width")).first()
    weight = F.lit(1).cast("long") if weighting == "one" else F.col("rows")
    return (found.filter(F.octet_length("x") == (widest["width"] if widest else 0))
            .select("digest", "x", weight.alias("weight")))


def fit_list(vectors: DataFrame) -> Fit | None:
    """Exact sums, centred covariance and its eigenvectors; None without vectors."""
    spark = vectors.sparkSession
    rows = (vectors.mapInArrow(_sums, "place long, n long, total string, reach long").groupBy("place")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                 F.max("reach").alias("reach")).orderBy("place").collect())
    if not rows:
        return None
    base = Fit(rows[0]["n"], tuple(int(r["total"]) for r in rows), 2 * rows[0]["reach"])
    v = _collected(vectors.mapInArrow(_products(spark.sparkContext.broadcast(base)),
                                      "place long, products binary")) / base.n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    lead = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    return Fit(base.n, base.totals, base.reach, v, values, axes * np.where(lead < 0, -1, 1))


def kept_components(fit: Fit, components: int) -> int:
    """Components asked for, less those without variance (they cannot be whitened)."""
    trace = float(np.trace(fit.covariance))
    return int((fit.values[:components] > RANK * trace).sum()) if trace > 0 else 0


def _whitened(fit, count: int):
    def run(batches):
        own = fit.value
        scale = own.axes[:, :count] / np.sqrt(own.values[:count])
        for x, w, part in _matrices(batches, "x", "<i8"):
            z = _centred(x, own) @ scale
            yield pa.RecordBatch.from_arrays(
                [part["digest"], pa.array(_deviations(x, own), pa.int64()), part["weight"],
                 pa.array([r.tobytes() for r in z], pa.binary())], ["digest", "deviation", "weight", "z"])
    return run


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Exact sum of (n * x - S)^2 of each vector; None where it needs over 64 bits."""
    width = x.shape[1]
    if fit.n * fit.reach < _WIDE:
        off = x * fit.n - fit.sums
        if float(np.abs(off).max(initial=0)) ** 2 * width < 2.0 ** 62:
            return (off * off).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        total = sum((fit.n * a - s) ** 2 for a, s in zip(row, fit.totals))
        out.append(total if total < 1 << 63 else None)
    return out


def _moments(batches):
    """Per task: weighted products of the whitened vectors, and a last row with their sums."""
    total = None
    for z, w, _ in _matrices(batches, "z", "<f8"):
        wide = np.c_[z, np.ones(len(z))]
        part = wide.T @ (wide * w[:, None])
        total = part if total is None else total + part
    if total is not None:
        yield _matrix_rows(total)


def _unpacked(count: int):
    def run(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch["z"].to_pylist()), "<f8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * count, pa.int32()),
                                             pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["deviation"], lists],
                                             ["vec_id", "deviation", "z"])
    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weighting: str = "one") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``weighting``: "one" counts each distinct vector once, "count" as often as it occurs.
    n is the total weight, deviation the exact sum of (n * x - S)^2 over the dimensions
    (null where it needs over 64 bits), whitened the centred x on the component's unit
    eigenvector over the root of its eigenvalue, explained the eigenvalue's share of the
    variance, identity_error the largest absolute entry of the covariance of all whitened
    vectors of the fit list minus the identity. An eigenvector's greatest entry is positive.

    Rows whose vector is null, empty, or holds a null, a NaN or an infinity are left out,
    as are rows of another dimension than most rows have (ties: the greater one). Entries
    are kept within LIMIT grid steps of zero. Components without variance are left out,
    so equal vectors only, or a single one, give no rows, as does an empty table. Repeated
    rows give repeated results, a null vec_id stays null, other columns are ignored.
    """
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                      "explained double, identity_error double")
    vectors = distinct_vectors(embeddings, weighting)
    fit = fit_list(vectors)
    count = kept_components(fit, components) if fit else 0
    if not count:
        return empty
    white = written(vectors.mapInArrow(_whitened(spark.sparkContext.broadcast(fit), count),
                                       "digest binary, deviation long, weight long, z binary"), "whitened")
    moments = _collected(white.mapInArrow(_moments, "place long, products binary")) / fit.n
    mean = moments[-1, :-1]
    error = float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(count)).max())
    rows = usable(embeddings).mapInArrow(_named("vec_id"), "digest binary, vec_id long")
    explained = [float(e) for e in fit.values[:count] / np.trace(fit.covariance)]
    joined = (join_by_key(rows, white.select("digest", "deviation", "z"), "digest")
              .select("vec_id", "deviation", "z").mapInArrow(_unpacked(count), "vec_id long, deviation long, z array<double>"))
    return (joined.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"),
                    "deviation", "whitened",
                    F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1).alias("explained"),
                    F.lit(error).alias("identity_error")))
