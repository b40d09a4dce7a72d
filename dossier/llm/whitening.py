"""Whitening of embeddings from exact sums of squares.

Entries become whole numbers, and every covariance follows from variances alone: that of a sum of two dimensions less
those of both is twice their covariance. Tasks add up the squares of centred values, of every dimension and of every sum
of two, as whole numbers without rounding; Spark adds up what the tasks send, one row a pair. Only those sums,
D * (D + 1) / 2 of them for D dimensions and however many rows, come to the driver, which finds the eigenvectors.
"""

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from .textops import widened

SCALE, SHIFT = 64, 1_000_000
MOST = 2**40  # a whole number is held within this distance of SHIFT; entries beyond 1.7e10 count as that
COMPONENTS = 32
ROWS = 4096  # rows that are worked on at once
_ZERO = 1e-13  # an eigenvalue below this share of the largest is none


@dataclass
class Whitening:
    """What is fitted: ``n`` vectors, exact sums of whole numbers by dimension, eigenvalues (falling) and unit eigenvectors in columns."""

    n: int
    sums: list
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self):
        return [float(v / self.trace) for v in self.values]


def fit(rows, vector="embedding", components=COMPONENTS):
    """The whitening of all usable vectors of ``rows``, None if there is none.

    A vector is usable if it is not null, not empty and holds neither null nor non-finite entries. All must have one length;
    if they do not, those of the most frequent length (of several the longest) are the usable ones. Repeated rows count as
    often as they come. Components without variance, which have no unit scale, are left out, so there may be fewer than asked for.
    """
    lengths = _finite(rows, vector).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d, n = lengths[0]
    vectors = _finite(rows, vector).filter(F.size("x") == d)

    def totals(batches):
        total = [0] * d
        for x in _whole_blocks(batches, d):
            total = [a + int(b) for a, b in zip(total, x.sum(0))]
        yield _records(i=range(d), value=total)

    sums = [0] * d
    for r in vectors.mapInArrow(totals, "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value")).collect():
        sums[r.i] = int(r.value)
    centre = [s // n for s in sums]

    def squares(batches):
        middle = np.array(centre, np.int64)
        first, second = np.triu_indices(d)
        total = [0] * len(first)
        for x in _whole_blocks(batches, d):
            total = list(map(int.__add__, total, _squares(x - middle)))
        yield _records(i=first, j=second, value=total)

    found = vectors.mapInArrow(squares, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    covariance = _assembled({(r.i, r.j): int(r.value) for r in found}, n, [s - n * c for s, c in zip(sums, centre)])
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    use = np.flatnonzero(values > max(values[0], 0.0) * _ZERO)[:components]
    directions = directions[:, use] * np.where(directions[np.abs(directions[:, use]).argmax(0), use] < 0, -1.0, 1.0)
    return Whitening(n, sums, covariance, values[use], directions, float(np.trace(covariance)))


def _squares(y):
    """Exact sums over rows of y_i ** 2 (i = j) and (y_i + y_j) ** 2 (i < j), row by row of the upper triangle."""
    d = y.shape[1]
    largest = int(np.abs(y).max(initial=0))
    step = max(1, min(len(y), 2**62 // max(1, 4 * largest**2)))
    whole = 4 * largest**2 < 2**62  # else one square does not fit 64 bits and is made of Python's numbers
    out = [0] * (d * (d + 1) // 2)
    for begin in range(0, len(y), step if whole else ROWS):
        part = np.ascontiguousarray(y[begin : begin + (step if whole else ROWS)].T)
        part = part if whole else part.astype(object)
        at = 0
        for i in range(d):
            own = part[i : i + 1]
            sums = np.concatenate([own, part[i + 1 :] + own])
            for j, value in enumerate((sums * sums).sum(1)):
                out[at + j] += int(value)
            at += d - i
    return out


def _assembled(squares, n, rest):
    """Covariances from sums of squares about the whole centres; ``rest``: what sums of dimensions keep beyond n centres.

    Variances times n ** 2 are whole numbers, so each covariance is rounded once, at the end.
    """
    d = len(rest)
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = float(Fraction(both - own[i] - own[j], 2 * n * n))
    return out


def whiten(rows, model, vector="embedding"):
    """Usable rows with ``whitened`` (ARRAY<DOUBLE>, one value a component) and ``deviation`` (LONG: the sum over
    dimensions of (n * x - S) ** 2, null where that is beyond a LONG).

    Other columns stay; of columns named like the new ones (in any letter case) the new ones count. Unusable vectors, and
    those of another length than the fitted ones, give no row. Without a model there are no rows.
    """
    rest, schema = widened(rows.schema, "whitened array<double>, deviation long")
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    d, n, sums = len(model.sums), model.n, model.sums
    scaled = model.vectors / np.sqrt(model.values)
    centre = [s // n for s in sums]
    remainder = np.array([(s - n * c) / n for s, c in zip(sums, centre)])

    def run(batches):
        import pyarrow as pa

        middle = np.array(centre, np.int64)
        left = [s - n * c for s, c in zip(sums, centre)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = _whole(part.column(0), d) - middle
                made = (y - remainder) @ scaled
                flat = pa.array(made.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * made.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, pa.array(_deviations(y, n, left), pa.int64())], schema.names)

    usable = _finite(rows, vector, rest).filter(F.size("x") == d)
    return usable.mapInArrow(run, schema)


def _deviations(y, n, left):
    """Exact sums of (n * y - left) ** 2 a row; None where a LONG cannot hold it."""
    largest = n * int(np.abs(y).max(initial=0)) + max(map(abs, left))
    if largest**2 * y.shape[1] < 2**63:
        return (((n * y - np.array(left, np.int64)) ** 2).sum(1)).tolist()
    found = ((n * y.astype(object) - np.array(left, object)) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in found]


def identity_error(whitened, model, column="whitened"):
    """The largest absolute entry of the covariance of whitened vectors less the identity.

    Each block of rows is centred at its own mean before multiplying; blocks are put together by their means. What is
    added up are numbers a pair of components, however many rows there are.
    """
    k = len(model.values)

    def moments(batches):
        first, second = np.triu_indices(k)
        for batch in batches:
            w = np.asarray(batch.column(0).flatten()).reshape(-1, k)
            if len(w):
                mean = w.mean(0)
                centred = w - mean
                inside = (centred.T @ centred)[first, second]
                yield _records(i=first, j=second, n=[len(w)] * len(first), inside=inside, a=len(w) * mean[first], b=len(w) * mean[second], ab=len(w) * mean[first] * mean[second])

    blocks = whitened.select(column).mapInArrow(moments, "i int, j int, n long, inside double, a double, b double, ab double")
    added = blocks.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "inside", "a", "b", "ab")))
    covariance = (F.col("inside") + F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.col("n")
    return added.agg(F.max(F.abs(covariance - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def _finite(rows, vector, rest=()):
    """The usable vectors as ``x`` (ARRAY<DOUBLE>), before the columns ``rest``."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.select(x.alias("x"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))).filter((F.size("x") > 0) & ~bad)


def _whole(column, d):
    """floor(64 * c) + 1000000 of every entry."""
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def _whole_blocks(batches, d):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _whole(batch.column(0).slice(at, ROWS), d)


def _records(**columns):
    import pyarrow as pa

    kinds = {"i": pa.int32(), "j": pa.int32(), "n": pa.int64(), "value": pa.decimal128(38, 0)}
    return pa.RecordBatch.from_pydict({k: pa.array(list(v), kinds.get(k, pa.float64())) for k, v in columns.items()})
