"""Whitening of embeddings: leading eigenvectors of the covariance by a block Jacobi-Davidson iteration.

The covariance is never formed. A product with a block of vectors is one pass over the fit list: every task centres its
rows before it multiplies, the partial products are added on Spark, and d x k numbers reach the driver. Each outer step
takes the Ritz pairs of a small subspace, locks the leading ones whose residual has reached double precision, and extends
the subspace by corrections: the projected equations (I - UU')(A - theta I)(I - UU') t = -r of all open pairs are solved
at once by inner MINRES, whose steps share passes.

Vectors become whole numbers x = floor(256 c); the fit list has each distinct x once, so counts and sums are exact.

Defined cases: rows whose vector is null, or holds a null or a number that is not finite, go; a vector that is shorter than
the longest has zeros in the missing places; repeated rows are returned each and fitted once; ties of eigenvalues give
some orthonormal basis of their space; a component whose eigenvalue is zero up to rounding (as many as one distinct vector
leaves) has whitened null and takes no part in identity_error; a deviation beyond a long is null; entries beyond 2**53 / 256
are refused by the cast to long; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .store import kept, narrow

COMPONENTS, INNER, WIDEST, OUTER = 4, 4, 24, 200
TOLERANCE = 2.0 ** -46
WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(rows, id_col="vec_id", vector_col="embedding"):
    """(vec_id, x) of the rows with finite vectors, x as whole numbers."""
    given = narrow(rows, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is larger than infinity here
    return given.where(F.col("v").isNotNull() & finite).select("vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"))


def matrix(column, d):
    """Rows of a batch's lists as a matrix of longs, filled with zeros to the width d."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _added(df, column, partial, shape, kind):
    """Sum over all batches of what `partial` gives for a batch (an array of the shape); only the sum reaches the driver."""
    size = int(np.prod(shape))

    def parts(batches):
        total = np.zeros(shape, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch.column(0))
        yield pa.record_batch({"at": np.arange(size, dtype=np.int32), "v": total.ravel()})

    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in df.select(column).mapInArrow(parts, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def column_sums(fit, d):
    return _added(fit, "x", lambda column: matrix(column, d).sum(axis=0), (d,), "long")


class Covariance:
    """Products with the fit list's covariance, each a pass over the list."""

    def __init__(self, fit, n, mean):
        self.fit, self.n, self.mean, self.passes = fit, n, mean, 0

    def times(self, block):
        mean, d = self.mean, len(self.mean)

        def partial(column):
            centred = matrix(column, d) - mean
            return centred.T @ (centred @ block)

        self.passes += 1
        return _added(self.fit, "x", partial, block.shape, "double") / self.n

    def trace(self):
        mean, d = self.mean, len(self.mean)
        return float(_added(self.fit, "x", lambda column: ((matrix(column, d) - mean) ** 2).sum(axis=0), (d,), "double").sum()) / self.n


def orthonormal(block, basis):
    """What the block adds to an orthonormal basis: projected twice, then by QR without the columns that vanish."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    return q - basis @ (basis.T @ q)


def corrections(times, shifts, residuals, around, steps=INNER):
    """Approximate solutions of the projected correction equations by MINRES, one recurrence a column, passes shared."""
    project = lambda m: m - around @ (around.T @ m)
    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = np.where(live, v / np.where(live, beta, 1), 0)
    before, eta = np.zeros_like(v), beta.copy()
    w, w_before, t = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c, c_before, s, s_before, off = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        product = project(times(v)) - shifts * v
        alpha = (v * product).sum(axis=0)
        following = project(product - alpha * v - off * before)
        size = np.linalg.norm(following, axis=0)
        delta = c * alpha - c_before * s * off
        rho1 = np.hypot(delta, size)
        rho2, rho3 = s * alpha + c_before * c * off, s_before * off
        ok = live & (rho1 > 0)
        safe = np.where(ok, rho1, 1)
        new = (v - rho3 * w_before - rho2 * w) / safe
        c_before, s_before, c, s = c, s, delta / safe, size / safe
        t = t + np.where(ok, c * eta * new, 0)
        eta, w_before, w = -s * eta, w, new
        live = ok & (size > 1e-14 * np.abs(shifts)) & (np.abs(eta) > 1e-4 * beta)
        if not live.any():
            break
        before, off, v = v, size, np.where(live, following / np.where(size > 0, size, 1), 0)
    return t


def leading_pairs(times, d, k=COMPONENTS, seed=12):
    """The k largest eigenvalues, falling, and their unit eigenvectors, of a symmetric operator known by its products."""
    k = min(k, d)
    widest = min(d, max(WIDEST, 3 * k))
    empty = np.zeros((d, 0))
    basis = orthonormal(np.random.default_rng(seed).normal(size=(d, min(d, 2 * k))), empty)
    product, locked, best, stale = times(basis), 0, np.inf, 0
    for _ in range(OUTER):
        values, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
        turn = turn[:, ::-1]
        theta, ritz, image = values[::-1][:k], basis @ turn[:, :k], product @ turn[:, :k]
        residual = image - ritz * theta
        sizes = np.linalg.norm(residual, axis=0)
        scale = max(abs(values).max(), np.finfo(float).tiny)
        small = sizes <= TOLERANCE * scale
        locked = k if small.all() else int(np.argmin(small))
        # Rounding of the passes bounds what can be reached: stop there, and only there.
        best, stale = (sizes.max(), 0) if sizes.max() < best / 2 else (best, stale + 1)
        if locked == k or (stale > 3 and sizes.max() <= 64 * TOLERANCE * scale):
            break
        if basis.shape[1] == d:
            break
        around = ritz
        step = corrections(times, theta[locked:], residual[:, locked:], around)
        if basis.shape[1] + k - locked > widest:
            keep = turn[:, :2 * k]
            basis, product = basis @ keep, product @ keep
        added = orthonormal(np.concatenate([step, residual[:, locked:]], axis=1)[:, :max(1, k - locked)], basis)
        if not added.shape[1]:
            added = orthonormal(np.random.default_rng(seed + basis.shape[1]).normal(size=(d, 1)), basis)
        basis, product = np.concatenate([basis, added], axis=1), np.concatenate([product, times(added)], axis=1)
    else:
        raise RuntimeError("the iteration did not converge")
    ritz, _ = np.linalg.qr(ritz)
    ritz *= np.where(ritz[np.abs(ritz).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return theta, ritz


def whitened(rows, components=COMPONENTS, id_col="vec_id", vector_col="embedding"):
    """Per remaining row and component: the whitened coordinate, exact deviation, explained share, and the error of the identity."""
    given = kept(whole_vectors(rows, id_col, vector_col), "vectors")
    kind = given.schema["vec_id"].dataType.simpleString()
    d = given.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    if not d:
        return given.sparkSession.createDataFrame([], f"vec_id {kind}, {WHITENED}")
    fit = kept(given.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))).alias("x")).distinct(), "fit_list")
    n, sums = fit.count(), column_sums(fit, d)
    covariance = Covariance(fit, n, sums / n)
    values, vectors = leading_pairs(covariance.times, d, components)
    trace = covariance.trace()
    real = values > 1e-11 * max(trace, np.finfo(float).tiny)
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0.0)
    mean, turn = covariance.mean, vectors * scale

    def squares(column):
        w = (matrix(column, d) - mean) @ turn
        return w.T @ w

    k = len(values)
    error = float(np.abs((_added(fit, "x", squares, (k, k), "double") / n - np.eye(k))[np.ix_(real, real)]).max()) if real.any() else None
    explained = [float(v / trace) if trace > 0 else None for v in values]

    def projected(batches):
        for batch in batches:
            x = matrix(batch.column("x"), d)
            w = (x - mean) @ turn
            far = max(abs(float(x.max(initial=0))), abs(float(x.min(initial=0)))) * n + float(np.abs(sums).max())
            if far ** 2 * d < 2 ** 62:
                deviation = ((x * n - sums) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
                deviation = [v if v < 2 ** 63 else None for v in exact]
            m = len(x)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, n, np.int64),
                "deviation": pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                "whitened": pa.array(w.ravel(), pa.float64(), mask=np.tile(~real, m)),
                "explained": pa.array(explained * m, pa.float64()), "identity_error": pa.array([error] * (m * k), pa.float64()),
            })

    return given.mapInArrow(projected, f"vec_id {kind}, {WHITENED}")
