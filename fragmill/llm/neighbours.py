"""Approximate nearest neighbours by collision-counting hashing.

Operator 2. Nearness is the inner product. Vectors are lifted to one norm (one more component), which turns the
largest inner product into the least distance. A hash is a single projection, on a line of a random rotation; a chunk
of rows keeps each projection's values as a sorted array. A query opens windows centred on its own projections; they
widen along the sorted arrays by a fixed growth (virtual rehashing, no tables are rebuilt) until enough rows collide,
that is, fall into at least THRESHOLD of the PROJECTIONS windows. These are verified by their exact inner product in
double precision. A sorted array is cut into CELLS runs of equal length and windows reach from cell to cell, so that a
row's place in it is one byte and a window is tested for a whole chunk at once.

Queries are a stated set. They meet all rows in blocks: rows and queries are dealt by hash, every block of queries
goes to every block of rows, and the blocks' nearest are merged per query. Blocks have a bounded size. Where queries
are a share of the rows, work grows with queries times rows, as that of exact search does: windows that keep a recall
of 0.9 on vectors without structure are about as wide as the arrays.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors
are compared only with those of their length. Rows that repeat an id and a length count once, by the least of their
vectors in the order of arrays. Components of any finite size are scaled by the largest before they are squared; a
score beyond the range of doubles is infinite, and one that is not a number comes last. Fewer rows than asked for give
all of them. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROJECTIONS, THRESHOLD = 64, 54
#: Candidates that are verified in a chunk: WANTED times the neighbours asked for or this share of the chunk, at least; windows narrow where there are LAVISH times as many.
WANTED, SHARE, LAVISH = 12, 0.015, 6.0
#: First half-width of a window in standard deviations of the projections, and its growth.
FIRST, GROWTH = 1.0, 1.05
#: Runs of a sorted array; a place among them is one byte.
CELLS = 256
#: Rows of a block at most, and at least where there are few; rows whose windows are tested at once; queries of a block.
ROW_BLOCK, LEAST_BLOCK, CHUNK, QUERY_BLOCK = 65_536, 8_192, 16_384, 8_192
#: Projections compared at once; a divisor of PROJECTIONS.
AT_ONCE = 8
SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, dims and the largest component's size of the rows that take part."""
    numbers = F.col("embedding").cast("array<double>")
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding")).where("vec_id is not null and embedding is not null")
    df = df.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return df.withColumns({"dims": F.size("embedding"), "top": F.array_max(F.transform("embedding", lambda x: F.abs(x)))}).where("top > 0")


def lines(dims: int) -> np.ndarray:
    """PROJECTIONS directions (dims x PROJECTIONS): the columns of as many random rotations as are needed."""
    rng = np.random.default_rng(dims)
    turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-PROJECTIONS // dims))]
    return np.concatenate(turns, axis=1)[:, :PROJECTIONS]


class _Chunk:
    """Rows with their places in the sorted array of each projection."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, lifted: np.ndarray, directions: np.ndarray) -> None:
        self.ids, self.data, n = ids, data, len(ids)
        projected = lifted @ directions
        order = np.argsort(projected, axis=0, kind="stable")
        # where each cell of the sorted arrays begins
        self.edges = np.take_along_axis(projected, order[np.minimum(-(-np.arange(CELLS) * n // CELLS), n - 1)], 0).T.copy()
        self.cells = np.empty((PROJECTIONS, n), np.uint8)
        np.put_along_axis(self.cells, order.T, (np.arange(n) * CELLS // n).astype(np.uint8)[None], 1)
        self.spread = projected.std(0) + 1e-300
        self.away, self.inside = np.empty((AT_ONCE, n), np.uint8), np.empty((AT_ONCE, n), bool)
        self.step = 0

    def windows(self, centre: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """First cell and number of further cells of one query's windows after ``step`` widenings."""
        reach = FIRST * GROWTH**step * self.spread
        first = np.maximum((self.edges <= (centre - reach)[:, None]).sum(1) - 1, 0)
        last = np.maximum((self.edges <= (centre + reach)[:, None]).sum(1) - 1, first)
        return first.astype(np.uint8), (last - first).astype(np.uint8)

    def collided(self, first: np.ndarray, further: np.ndarray) -> np.ndarray:
        """Rows that are in at least THRESHOLD of one query's windows."""
        collisions = np.zeros(len(self.ids), np.uint8)
        for p in range(0, PROJECTIONS, AT_ONCE):
            # unsigned, so that one comparison tells a window
            np.subtract(self.cells[p : p + AT_ONCE], first[p : p + AT_ONCE, None], out=self.away)
            np.less_equal(self.away, further[p : p + AT_ONCE, None], out=self.inside)
            collisions += np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)
        return np.flatnonzero(collisions >= THRESHOLD)

    def candidates(self, centred: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, rows that collide in the narrowest windows of the series with ``enough`` of them.

        Wider windows hold what narrower ones do, so the width is sought from the last query's.
        """

        def at(step: int, q: int) -> np.ndarray:
            return self.collided(*self.windows(centred[q], step))

        for q in range(len(centred)):
            found = at(self.step, q)
            while len(found) < enough:
                self.step += 1
                found = at(self.step, q)
            while len(found) > LAVISH * enough and self.step and len(less := at(self.step - 1, q)) >= enough:
                self.step, found = self.step - 1, less
            yield found


def _once(frame: pd.DataFrame) -> pd.DataFrame:
    """``frame`` with one row an id, by id: the one with the least vector."""
    frame = frame.sort_values("vec_id", kind="stable")
    if frame["vec_id"].is_unique:
        return frame
    key = frame["embedding"].map(tuple)
    return frame.assign(key=key).sort_values(["vec_id", "key"], kind="stable").drop_duplicates("vec_id").drop(columns="key")


def _search(count: int, top: float, most: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(queries):
            rows, queries = _once(rows), _once(queries)
            ids, data = rows["vec_id"].to_numpy(np.int64), np.stack(rows["embedding"].to_numpy()).astype(float)
            asked, points = queries["vec_id"].to_numpy(np.int64), np.stack(queries["embedding"].to_numpy()).astype(float)
            # in units of the largest component: squares neither overflow nor matter where they vanish
            scaled = data / top
            lifted = np.c_[scaled, np.sqrt(np.maximum(most - (scaled**2).sum(1), 0))]
            own = points / np.abs(points).max(1)[:, None]
            directions = lines(lifted.shape[1])
            centred = (own * (np.sqrt(most) / np.linalg.norm(own, axis=1))[:, None]) @ directions[:-1]
            for at in range(0, len(ids), CHUNK):
                chunk = _Chunk(ids[at : at + CHUNK], data[at : at + CHUNK], lifted[at : at + CHUNK], directions)
                enough = min(len(chunk.ids), max(WANTED * count, int(SHARE * len(chunk.ids))) + 1)
                for q, found in enumerate(chunk.candidates(centred, enough)):
                    found = found[chunk.ids[found] != asked[q]]
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = chunk.data[found] @ points[q]
                    best = np.lexsort((chunk.ids[found], -scores))[:count]
                    out.append((np.full(len(best), asked[q]), chunk.ids[found[best]], scores[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return search


def nearest(vectors: DataFrame, queries: DataFrame, count: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: ``count`` rows of ``vectors`` nearest to each row of ``queries``.

    A query never finds the row of its own id. Ties go to the smaller vec_id.
    """
    rows, asked = usable(vectors), usable(queries)
    n, top = rows.agg(F.count("*"), F.coalesce(F.max("top"), F.lit(1.0))).first()
    squares = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + (x / top) * (x / top))
    most = rows.agg(F.coalesce(F.max(squares), F.lit(1.0))).first()[0]
    n_queries = asked.count()
    row_blocks = max(1, -(-n // ROW_BLOCK), min(64, n // LEAST_BLOCK))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")
    theirs = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")
    keys = ["dims", "row_block", "query_block"]
    dealt_rows = rows.select("vec_id", "embedding", "dims", own.alias("row_block"), every(query_blocks).alias("query_block"))
    dealt_queries = asked.select("vec_id", "embedding", "dims", theirs.alias("query_block"), every(row_blocks).alias("row_block"))
    found = dealt_rows.groupBy(*keys).cogroup(dealt_queries.groupBy(*keys)).applyInPandas(_search(count, top, most), SCHEMA)
    number = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc(number), F.isnan("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def nearest_of_twentieths(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
