"""Exact top-k by integer inner product over a pivot-distance index.

Each vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm, and
a query q gets 0; then |q'x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner
products are the nearest neighbours, and the triangle inequality holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.runtime import lean, ship
from wattline.llm.vectors import blocks, in_parts, keyed, ranked, sample, unpack, usable

PACK = "grp int, lo double, hi double, qids binary, qvecs binary, qbest binary, qdist binary"
FOUND = "query_id long, vec_id long, score long"
#: Distances are roots of differences: relative to the norms they are exact to about the root of a double's precision.
SLACK = 1e-7


def to_integers(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can leave their exact range, else in Python integers."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


@lean
def _query_packs(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, largest: float, reach: np.ndarray, every: int, k: int, most: int) -> Iterator[pa.RecordBatch]:
    """The queries standing in these blocks, with the k-th best score in their own block, sent to each pivot they may need."""
    ids, vecs, best = [], [], []

    def packed() -> pa.RecordBatch:
        q, tau, i = np.array(vecs), np.array(best), np.array(ids, np.int64)
        norm = (q * q).sum(axis=1)
        dist = np.sqrt(np.maximum(norm[:, None] + largest - 2 * (q @ pivots[:, :-1].T), 0))
        radius = np.sqrt(np.maximum(norm + largest - 2 * tau, 0))
        slack = SLACK * (1 + np.sqrt(norm + largest))
        low, high = dist - (radius + slack)[:, None], dist + (radius + slack)[:, None]
        out = []
        for p in range(len(pivots)):
            need = (low[:, p] <= reach[p, 1]) & (high[:, p] >= reach[p, 0])
            if need.any():
                out.append([p, low[need, p].min(), high[need, p].max(), i[need].tobytes(), q[need].tobytes(), tau[need].tobytes(), dist[need, p].tobytes()])
        kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["grp", "lo", "hi", "qids", "qvecs", "qbest", "qdist"])

    for batch in batches:
        for raw_ids, raw in zip(batch.column("ids").to_pylist(), batch.column("vecs").to_pylist()):
            i, x = unpack(raw_ids, raw)
            asks = np.flatnonzero(i % every == 0)
            if len(asks) == 0:
                continue
            scores = _dots(x[asks], x).astype(np.float64)
            scores[i[asks][:, None] == i[None, :]] = -np.inf
            unique = len(np.unique(i)) == len(i)
            tau = np.partition(scores, -k, axis=1)[:, -k] if unique and len(i) > k else np.full(len(asks), -np.inf)
            tau = np.where(np.abs(tau) >= 2**53, np.nextafter(tau, -np.inf), tau)  # rounded scores: never above the true one
            ids.extend(i[asks].tolist())
            vecs.extend(x[asks])
            best.extend(tau.tolist())
            if len(ids) >= most:
                yield packed()
                ids, vecs, best = [], [], []
    if ids:
        yield packed()


@lean
def _search(batches: Iterator[pa.RecordBatch], largest: float, k: int, step: int) -> Iterator[pa.RecordBatch]:
    """Queries of a pack against a block of one pivot: annuli outward from the queries' own distances until the bound ends it."""
    for batch in batches:
        out_q, out_v, out_s = [], [], []
        names = ("qids", "qvecs", "qbest", "qdist", "ids", "keys", "vecs")
        for qids, qvecs, qbest, qdist, ids, keys, vecs in zip(*(batch.column(c).to_pylist() for c in names)):
            qi, q = unpack(qids, qvecs)
            i, x = unpack(ids, vecs)
            d, r = np.frombuffer(qdist), np.frombuffer(keys)
            tau = np.frombuffer(qbest).copy()
            base = (q * q).sum(axis=1) + largest
            slack = SLACK * (1 + np.sqrt(base))
            annuli = [(a, min(a + step, len(i))) for a in range(0, len(i), step)]
            gap = np.stack([np.maximum(0, np.maximum(r[a] - d, d - r[b - 1])) for a, b in annuli], axis=1)
            top_s = [np.zeros(0)] * len(qi)
            top_v = [np.zeros(0, np.int64)] * len(qi)
            for c in np.argsort(gap.min(axis=0), kind="stable"):
                a, b = annuli[c]
                ask = np.flatnonzero(gap[:, c] <= np.sqrt(np.maximum(base - 2 * tau, 0)) + slack)
                if len(ask) == 0:
                    continue
                scores = _dots(q[ask], x[a:b])
                for row, s in zip(ask, scores):
                    ok = (s >= tau[row]) & (i[a:b] != qi[row])
                    if not ok.any():
                        continue
                    s, v = np.concatenate((top_s[row], s[ok])), np.concatenate((top_v[row], i[a:b][ok]))
                    order = np.lexsort((v, -s))
                    order = order[np.sort(np.unique(v[order], return_index=True)[1])][:k]  # an id once, by its best score
                    top_s[row], top_v[row] = s[order], v[order]
                    if len(order) == k:
                        last = float(s[order[-1]])
                        tau[row] = max(tau[row], last if abs(last) < 2**53 else np.nextafter(last, -np.inf))
            for row in range(len(qi)):
                out_q.extend([int(qi[row])] * len(top_v[row]))
                out_v.extend(top_v[row].tolist())
                out_s.extend(min(max(int(x), -(2**63)), 2**63 - 1) for x in top_s[row])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = 64, pack: int = 256, step: int = 128) -> DataFrame:
    """The ``k`` largest integer inner products of each query with all other rows: query_id, rank, vec_id, score.

    Components are floor(256 * x); queries are the rows whose vec_id ``every``
    divides. Vectors are keyed by (nearest of ``pivots`` sampled pivots, distance
    to it) and kept in sorted blocks. A query first scans its own block, which
    bounds its k-th best; packs of queries then go to the blocks of those pivots
    whose annuli the triangle inequality does not rule out, and scan them from
    the nearest annulus outward until the bound exceeds the k-th best. Nothing
    but the pivots and their radii is broadcast.

    Null, empty or non-finite vectors, null ids and vectors of an uncommon
    dimension take no part; exact repeats of a row count once, and an id with
    several vectors keeps its best score; fewer than ``k`` candidates give fewer
    rows; ties go to the smaller vec_id; a score beyond 64 bits becomes the
    nearest number that they hold; an empty table gives no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept, dim = usable(vectors, nonzero=False)
    n = kept.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = F.aggregate(F.transform("v", lambda x: F.floor(x * 256.0).cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    largest = float(kept.agg(F.max(square)).first()[0])
    chosen = to_integers(sample(kept, pivots, n))[: 2 * pivots]
    points = np.concatenate((chosen, np.sqrt(np.maximum(largest - (chosen * chosen).sum(axis=1, keepdims=True), 0))), axis=1)

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
        square = 2 * largest - 2 * (x @ points[:, :-1].T + own[:, None] * points[None, :, -1])
        group = square.argmin(axis=1)
        return group, np.sqrt(np.maximum(square[np.arange(len(x)), group], 0))

    index = blocks(keyed(kept, nearest, dim, to_integers), n)
    reach, rows = np.array([[np.inf, -np.inf]] * len(points)), {}
    for r in index.groupBy("grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum(F.length("ids")) / 8).alias("n")).collect():
        reach[r["grp"]], rows[r["grp"]] = (r["lo"], r["hi"]), int(r["n"])
    asked = index.mapInArrow(lambda it: _query_packs(it, points, largest, reach, every, k, pack), PACK)
    asked, index = in_parts(asked, index, rows)
    a, b = asked.alias("a"), index.alias("b")
    pairs = a.join(b.hint("shuffle_merge"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("a.hi") >= F.col("b.lo")))
    met = pairs.select("qids", "qvecs", "qbest", "qdist", "ids", "keys", "vecs")
    return ranked(met.mapInArrow(lambda it: _search(it, largest, k, step), FOUND), k)
