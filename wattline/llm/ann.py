"""Approximate nearest neighbours by inner product: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from wattline.llm.runtime import lean, ship
from wattline.llm.vectors import blocks, in_parts, keyed, matrix, ranked, sample, unpack, usable


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids from k-means++ seeds; fewer if there are fewer distinct points."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.sum() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        near = nearest(x, c)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells (i, j) by increasing ``first[i] + second[j]`` until they hold ``wanted`` rows.

    The heap holds the frontier of the pairs in the two sorted lists; a cell is
    pushed when both its predecessors have been popped.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, done, out, seen = [(x[0] + y[0], 0, 0)], set(), [], 0
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        done.add((i, j))
        n = sizes[a[i], b[j]]
        if n:
            out.append((int(a[i]), int(b[j])))
            seen += n
        if i + 1 < len(x) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


@lean
def _query_packs(batches: Iterator[pa.RecordBatch], dim: int, c1: np.ndarray, c2: np.ndarray, sizes: np.ndarray, wanted: int, kind: type, pack: int = 256) -> Iterator[pa.RecordBatch]:
    """For each first-half centroid, packs of the queries that visit its cells, and which of them."""
    half = dim // 2
    for batch in (b.slice(at, pack) for b in batches for at in range(0, b.num_rows, pack)):
        ids, q = np.asarray(batch.column("vec_id")), matrix(batch, dim)
        near1, near2 = -(q[:, :half] @ c1.T), -(q[:, half:] @ c2.T)
        visits: dict[int, dict[int, list[int]]] = {}
        for row in range(len(q)):
            for i, j in traverse(near1[row], near2[row], sizes, wanted):
                visits.setdefault(i, {}).setdefault(row, []).append(j)
        out = [[], [], [], []]
        for i, asked in visits.items():
            rows = np.array(sorted(asked))
            masks = np.zeros((len(rows), len(c2)), dtype=bool)
            for at, row in enumerate(rows.tolist()):
                masks[at, asked[row]] = True
            for column, value in zip(out, (i, ids[rows].astype(np.int64).tobytes(), q[rows].astype(kind).tobytes(), masks.tobytes())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]], names=["grp", "qids", "qvecs", "masks"])


@lean
def _rerank(batches: Iterator[pa.RecordBatch], k: int, kind: type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_q, out_v, out_s = [], [], []
        for qids, qvecs, masks, ids, keys, vecs in zip(*(batch.column(c).to_pylist() for c in ("qids", "qvecs", "masks", "ids", "keys", "vecs"))):
            (qi, q), (i, x) = unpack(qids, qvecs, kind), unpack(ids, vecs, kind)
            q, x = q.astype(np.float64), x.astype(np.float64)
            cell = np.frombuffer(keys).astype(np.int64)
            mask = np.frombuffer(masks, bool).reshape(len(qi), -1)
            asks = np.flatnonzero(mask[:, np.unique(cell)].any(axis=1))
            if len(asks) == 0:
                continue
            rough = q[asks] @ x.T
            rough[~mask[asks][:, cell] | (qi[asks][:, None] == i[None, :])] = -np.inf
            # An id with several vectors here: its best score counts, and only once.
            unique = len(np.unique(i)) == len(i)
            kth = np.partition(rough, -k, axis=1)[:, -k] if unique and len(i) > k else np.full(len(asks), -np.inf)
            for at, row in enumerate(asks):
                near = np.flatnonzero((rough[at] >= kth[at] - 1e-9 * (1 + abs(kth[at]))) & (rough[at] > -np.inf)) if np.isfinite(kth[at]) else np.flatnonzero(rough[at] > -np.inf)
                exact = (x[near] * q[row]).sum(axis=1)  # the same sum for the same vector, wherever it stands
                order = np.lexsort((i[near], -exact))
                if not unique:
                    order = order[np.sort(np.unique(i[near][order], return_index=True)[1])]
                order = order[:k]
                out_q.extend([int(qi[row])] * len(order))
                out_v.extend(i[near][order].tolist())
                out_s.extend(exact[order].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])


def search_multi_index(vectors: DataFrame, k: int = 20, every: int = 20, centroids: int = 64, share: float = 0.5, fit_rows: int = 8192) -> DataFrame:
    """About the ``k`` largest inner products of each query with all other rows: query_id, rank, vec_id, score.

    Both halves of the vectors are quantised by their own ``centroids``, fitted on
    about ``fit_rows`` sampled vectors; every row is indexed in its cell (i, j). A
    query walks the centroid pairs by summed distance (the negated inner products
    of the halves) with a heap until the visited cells hold the ``share`` of all
    rows and ``4 * k`` rows, and all rows of these cells are reranked by the
    exact inner product in double precision. Vectors without structure need the
    default share for a recall of 0.9; clustered ones do with far less. Queries
    are the rows whose vec_id ``every`` divides. Broadcast: the two codebooks and
    one count a cell.

    Null, empty, zero or non-finite vectors, null ids and vectors of an uncommon
    dimension take no part; exact repeats of a row count once, and an id with
    several vectors keeps its best score; fewer candidates give fewer rows; ties
    go to the smaller vec_id; an empty table gives no rows; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept, dim = usable(vectors, nonzero=True)
    n = kept.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    half = dim // 2
    wanted = max(4 * k, int(np.ceil(share * n)))
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64
    fitted = sample(kept, fit_rows, n)
    c1, c2 = kmeans(fitted[:, :half], centroids), kmeans(fitted[:, half:], centroids, seed=8)

    def cell(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, :half], c1), nearest(x[:, half:], c2).astype(np.float64)

    index = blocks(keyed(kept, cell, dim, kind=kind), n)
    sizes = np.zeros((len(c1), len(c2)), dtype=np.int64)
    cells = index.mapInArrow(lambda it: _sizes(it), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in cells.collect():
        sizes[r["i"], r["j"]] = r["n"]
    asked = kept.where(F.col("vec_id") % every == 0).mapInArrow(lambda it: _query_packs(it, dim, c1, c2, sizes, wanted, kind), "grp int, qids binary, qvecs binary, masks binary")
    asked, index = in_parts(asked, index, dict(enumerate(sizes.sum(axis=1).tolist())))
    met = asked.join(index.hint("shuffle_merge"), ["grp", "part"]).select("qids", "qvecs", "masks", "ids", "keys", "vecs")
    return ranked(met.mapInArrow(lambda it: _rerank(it, k, kind), "query_id long, vec_id long, score double"), k)


@lean
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i, j, n = [], [], []
        for group, keys in zip(batch.column("grp").to_pylist(), batch.column("keys").to_pylist()):
            cells, counts = np.unique(np.frombuffer(keys), return_counts=True)
            i += [group] * len(cells)
            j += cells.astype(int).tolist()
            n += counts.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int64())], names=["i", "j", "n"])
