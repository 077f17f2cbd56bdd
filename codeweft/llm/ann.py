"""Approximate nearest neighbours by largest inner product: an inverted file of coarse centroids with
product-quantised residuals, asymmetric distance tables, and exact reranking.

Fit: coarse centroids and residual codebooks are trained on a sample of `SAMPLE` vectors at most,
chosen by a hash of the id; every vector is then indexed. A query probes the cells that promise the
most: its inner product with the centroid plus what the cell's spread is likely to add. There, a
table of inner products between the query and every code word scores all vectors by lookups, and the
best `shortlist` are scored exactly in double precision. An exact check follows, so no nearest vector is
missed on any data: the k-th best score of the sample's vectors, or of those scored in the task, is one
that a result must reach. Cells whose centroid and greatest distance from it cannot give that much are left
out, all others are probed; vectors whose code and distance from it can, are scored exactly. The best k
leave the task. Small cells share a group of some `BLOCK` vectors; a group of more, or asked
by over `ASKED` queries, is dealt into blocks of either, every pair of which is one task: no cell is
capped. Without structure in the data (independent random directions) the bounds rule little out, and work
grows with the square of the table. For the index, vectors are divided by their greatest component and
queries by their length, so that no magnitude leaves single precision.

Nulls: a vector that is null, all zero, of another length than most, or has null or non-finite
components takes no part. Rows are told apart, not ids: each row of a repeated id is asked and is a
candidate for the others; a null id is a candidate too, last among equal scores. A query gets k results, or
all candidates if they are fewer.
An empty table, or one without queries, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.llm.common import cut

SAMPLE, BLOCK, ASKED, JUDGES = 20_000, 16_384, 512, 8192
CODES, PART = 256, 4
#: Share of a vector's length by which sums in single precision may be off.
SLACK = 1e-4


def kmeans(data: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(data))
    centres = data[rng.choice(len(data), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(data, centres)
        count = np.bincount(near, minlength=k)
        for d in range(data.shape[1]):
            total = np.bincount(near, data[:, d], minlength=k)
            centres[count > 0, d] = total[count > 0] / count[count > 0]
        lost = np.flatnonzero(count == 0)
        centres[lost] = data[rng.choice(len(data), len(lost))]
    return centres


def nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of least Euclidean distance."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(data[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(data), 4096)]) if len(data) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and one codebook for each run of PART dimensions of the residuals."""

    def __init__(self, centroids: np.ndarray, books: list[np.ndarray], spread: np.ndarray):
        self.centroids, self.books, self.spread = centroids, books, spread
        self.pad = -centroids.shape[1] % PART

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int = 7) -> Index:
        rng = np.random.default_rng(seed)
        index = cls(kmeans(sample, cells, 10, rng), [], np.zeros(0))
        cell = nearest(sample, index.centroids)
        rest = index.padded(sample - index.centroids[cell])
        count = np.maximum(1, np.bincount(cell, minlength=len(index.centroids)))
        radius = np.sqrt(np.bincount(cell, (rest * rest).sum(axis=1), minlength=len(count)) / count)
        index.spread = radius * np.sqrt(2 * np.log(np.maximum(count, 2)) / sample.shape[1])
        rest = rest[:8192]
        index.books = [kmeans(rest[:, i : i + PART], CODES, 8, rng) for i in range(0, rest.shape[1], PART)]
        return index

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)
        rest = self.padded(x - self.centroids[cell])
        return cell, np.stack([nearest(rest[:, i * PART : (i + 1) * PART], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int | None, sizes: np.ndarray, least: int, far: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """queries (of length 1) x cells: which are searched. All that may reach the floor; or, if `probes` says how many, these and on until they hold `least` vectors."""
        product = q @ self.centroids.T.astype(np.float64)
        if probes is None:
            length = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(axis=1))
            return (sizes > 0) & (product + far + 1e-9 * (length + far) >= floor[:, None])
        order = np.argsort(-(product + self.spread), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        chosen = np.zeros(product.shape, bool)
        np.put_along_axis(chosen, order, (np.arange(order.shape[1]) < probes) | (before < least), axis=1)
        return chosen

    def restored(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What the codes stand for."""
        rest = np.concatenate([b[code[:, i]] for i, b in enumerate(self.books)], axis=1)
        return self.centroids[cell] + rest[:, : self.centroids.shape[1]]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x codes: inner products with the code words."""
        q = self.padded(q)
        out = np.zeros((len(q), len(self.books), CODES), np.float32)
        for i, b in enumerate(self.books):
            out[:, i, : len(b)] = q[:, i * PART : (i + 1) * PART] @ b.T
        return out


def usable(frame: DataFrame, key: str, vector: str, asks: Column) -> tuple[DataFrame, int]:
    """(id, v, asks): vectors that take part, and their length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = frame.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where(F.col("v").isNotNull() & fine)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = top["n"] if top else 0
    return rows.where(F.size("v") == dim), dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if isinstance(column, pa.Array) else np.concatenate([matrix(c, dim) for c in column.chunks])


def search(
    frame: DataFrame, asks: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, probes: int | None = None, shortlist: int = 160, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): k rows, nearest first, for each row of the frame that `asks` holds for."""
    spark = frame.sparkSession
    rows, dim = usable(frame, key, vector, asks)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, scale = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not total:
        return empty
    share = min(1.0, sample / total)
    some = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(2 * sample).select("v").collect()
    if not some:
        some = rows.limit(sample).select("v").collect()
    drawn = np.array([r.v for r in some]) / scale
    cells = max(1, min(4096, 1 << math.ceil(math.log2(4 * math.sqrt(total))), len(some) // 16))
    fitted = Index.fit(drawn.astype(np.float32), cells)
    sent = spark.sparkContext.broadcast((fitted.centroids, fitted.books, fitted.spread))  # arrays only: some MB at most
    judging = spark.sparkContext.broadcast(drawn[:JUDGES])  # JUDGES vectors at most
    cells = len(fitted.centroids)

    def placed(batches):
        index = Index(*sent.value)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), dim) / scale
                cell, code = index.encode(x.astype(np.float32))
                far = np.sqrt(((x - index.centroids[cell]) ** 2).sum(axis=1))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), codes, batch.column("v"), batch.column("asks"), pa.array(far)], names=["cell", "id", "code", "v", "asks", "far"])

    # Numbers of rows are written with them, so they stay.
    indexed = cut(rows.mapInArrow(placed, "cell int, id long, code binary, v array<double>, asks boolean, far double").withColumn("row", F.monotonically_increasing_id()))
    # One row a cell, at most 4096. Small cells share a group; `blocks` says how many blocks a group has.
    held_by = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    sizes, distance = {r.cell: r.n for r in held_by}, {r.cell: r.far for r in held_by}
    far = np.array([distance.get(c, 0.0) for c in range(cells)])
    count = np.array([sizes.get(c, 0) for c in range(cells)], np.int64)
    group_of, held = np.zeros(cells, np.int64), [0]
    for c in range(cells):
        if held[-1] and held[-1] + sizes.get(c, 0) > BLOCK:
            held.append(0)
        group_of[c] = len(held) - 1
        held[-1] += sizes.get(c, 0)
    blocks = [max(1, -(-n // BLOCK)) for n in held]

    def reached(index: Index, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries of length 1, their lengths, what a result must reach at least, and the cells to search."""
        v = v / np.abs(v).max(axis=1, keepdims=True)
        unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        floor = np.full(len(unit), -np.inf)
        if probes is None and len(judging.value) > k:  # one of them may be the query itself
            for i in range(0, len(unit), 256):
                floor[i : i + 256] = np.partition(unit[i : i + 256] @ judging.value.T, -k - 1, axis=1)[:, -k - 1]
        floor -= 1e-9 * np.abs(floor)
        return unit, floor, index.probed(unit, probes, count, k + 1, far, floor)

    def routed(batches):
        index = Index(*sent.value)
        for batch in batches:
            if batch.num_rows:
                _, _, chosen = reached(index, matrix(batch.column("v"), dim))
                asked = np.stack([chosen[:, group_of == g].any(axis=1) for g in range(len(held))], axis=1)
                at, group = np.nonzero(asked)
                yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), *(batch.column(c).take(pa.array(at)) for c in ("row", "id", "v"))], names=["grp", "row", "id", "v"])

    asked = cut(indexed.where("asks").select("row", "id", "v").mapInArrow(routed, "grp int, row long, id long, v array<double>"))
    counts = {r.grp: r["count"] for r in asked.groupBy("grp").count().collect()}
    loads = [-(-counts.get(g, 0) // ASKED) for g in range(len(held))]

    def number(values, at):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)

    def dealt(side: DataFrame, own: list, other: list, names: tuple[str, str]) -> DataFrame:
        side = side.withColumn("theirs", number(other, F.col("grp"))).where("theirs > 0")
        side = side.withColumn(names[0], F.pmod(F.xxhash64("row"), F.greatest(number(own, F.col("grp")), F.lit(1))).cast("int"))
        return side.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))).drop("theirs")

    placed_rows = indexed.drop("asks", "far").withColumn("grp", number(group_of, F.col("cell")))
    data = dealt(placed_rows, blocks, loads, ("block", "load")).groupBy("grp", "block", "load")
    asks_ = dealt(asked, loads, blocks, ("load", "block")).groupBy("grp", "block", "load")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "row": [], "score": []}
        if left.num_rows and right.num_rows:
            index = Index(*sent.value)
            last = np.iinfo(np.int64).max
            ids, rows_ = left.column("id").fill_null(last).to_numpy(), left.column("row").to_numpy()
            order = np.lexsort([rows_, ids])
            rows_, x, cell = rows_[order], matrix(left.column("v"), dim)[order], left.column("cell").to_numpy()[order]
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(rows_), -1)[order]
            asking, q = right.column("row").to_numpy(), matrix(right.column("v"), dim)
            unit, floor, chosen = reached(index, q)
            small = unit.astype(np.float32)
            tables = index.tables(small)
            rough = np.full((len(asking), len(rows_)), -np.inf, np.float32)
            for c in np.unique(cell).tolist():
                who, own = np.flatnonzero(chosen[:, c]), np.flatnonzero(cell == c)
                total = np.repeat((small[who] @ index.centroids[c])[:, None], len(own), axis=1)
                for part in range(code.shape[1]):
                    total += tables[who, part][:, code[own, part]]
                rough[np.ix_(who, own)] = total
            rough[asking[:, None] == rows_] = -np.inf
            scaled, meant = x / scale, index.restored(cell, code)
            # How much more than by its code a vector can give to a query of length 1.
            more = np.sqrt(((scaled - meant) ** 2).sum(axis=1)) + SLACK * (np.sqrt((scaled * scaled).sum(axis=1)) + 2 * np.sqrt((meant * meant).sum(axis=1))) + 1e-30
            for begin in range(0, len(asking), 64):
                some = slice(begin, begin + 64)
                guess, asked_ = rough[some], unit[some]
                n = min(shortlist, len(rows_))
                best = np.argpartition(-guess, n - 1, axis=1)[:, :n]
                near = asked_ @ scaled.T
                near[guess == -np.inf] = -np.inf
                found_ = np.take_along_axis(near, best, axis=1)
                least = np.maximum(floor[some], np.partition(found_, -k, axis=1)[:, -k] if n >= k else -np.inf)
                least -= 1e-9 * np.abs(least)
                picks = (guess + more >= least[:, None]) & (near >= least[:, None] - 1e-12)
                for i, own in enumerate(picks, begin):
                    pick = np.flatnonzero(own & (rough[i] > -np.inf))
                    exact = (x[pick] * q[i]).sum(axis=1)
                    top = np.lexsort([pick, -exact])[:k]  # picks are in order of id
                    out["query"].append(np.full(len(top), i))
                    out["row"].append(order[pick][top])
                    out["score"].append(exact[top])
        query, row, score = (np.concatenate([np.zeros(0, kind), *out[c]]) for c, kind in (("query", np.int64), ("row", np.int64), ("score", np.float64)))
        names = [(right, "row", query, "query"), (right, "id", query, "query_id"), (left, "row", row, "row"), (left, "id", row, "vec_id")]
        return pa.table({name: side.column(c).take(pa.array(at)) for side, c, at, name in names} | {"score": pa.array(score)})

    found = data.cogroup(asks_).applyInArrow(score, "query long, query_id long, row long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
