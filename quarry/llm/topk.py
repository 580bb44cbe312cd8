"""Exact top-k search (operator 2): columnar branch-and-bound over integer vectors.

Queries and candidates form a grid of bounded cells: candidates are dealt into groups of `group_rows`,
queries into groups of `query_rows` (fewer where vectors are long); a cell holds one group of each. Only queries x
candidate groups and candidates x query groups rows are moved, so both sides may grow. Inside a cell the candidates
lie in vertical layout, dimensions first, in blocks of `BLOCK`. Each query takes the blocks in the order of its own mass
in them. After each block a candidate's remaining mass is bounded by the sum over the blocks to come of |q block| *
|c block| (Cauchy-Schwarz block by block); the most promising candidates are scored in full, which raises the query's k-th best
score, and only candidates whose partial score and bound reach it are kept for the next block. Each cell gives its k best
for a query; a window over those (k x candidate groups rows a query) gives the answer.

Scores are exact: float64 products while every sum stays below 2^53. Beyond that float64 scores and the bound on their
rounding select the candidates, and Python integers score those, held within the range of a long.

Vectors that are null, or hold a null or a non-finite number, take no part; nor do those whose length is not the
query's (they are compared by groups of equal length). Rows with a null id are candidates without an id and take no part
either. Ties go to the smaller id. Repeated rows are rows of their own: a query's own row is every row with its id. Columns
of any other names do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Dimensions in a block of the vertical layout.
BLOCK = 8
LONG = 2**63


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim): 1024 * x of every usable vector; cells floor it, in double, which no number overflows."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")), x * SCALE))
    rows = df.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(~F.exists("v", lambda x: x.isNull())).select("vec_id", "v", F.size("v").alias("dim"))


def _floor(rows: pd.Series) -> np.ndarray:
    return np.floor(np.stack(rows.to_numpy()).astype(np.float64))


class Cell:
    """A group of candidates in vertical layout."""

    def __init__(self, cid: np.ndarray, c: np.ndarray) -> None:
        self.cid, self.rows = cid, c
        self.cuts = list(range(0, c.shape[1], BLOCK)) + [c.shape[1]]
        self.blocks = [np.ascontiguousarray(c[:, a:b].T) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.mass = np.stack([np.sqrt(np.einsum("ij,ij->j", x, x)) for x in self.blocks]) if self.blocks else np.zeros((0, len(cid)))
        #: Candidates left after each block, over all queries: what the bounds are worth.
        self.left = np.zeros(len(self.blocks) + 1, dtype=np.int64)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best, best first."""
        parts = [q[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        mass = np.array([np.sqrt(x @ x) for x in parts])
        order = np.argsort(-mass, kind="stable")
        alive = np.flatnonzero(self.cid != own)
        total = np.zeros(len(alive))
        rest = mass @ self.mass[:, alive]
        slack = 1e-9 * (1 + float(np.sqrt(q @ q)) * float(np.sqrt((self.mass**2).sum(axis=0)).max(initial=0)))
        kth = -np.inf
        self.left[0] += len(alive)
        for step, b in enumerate(order.tolist()):
            block = self.blocks[b] if len(alive) == len(self.cid) else self.blocks[b][:, alive]
            total += parts[b] @ block
            rest -= mass[b] * self.mass[b, alive]
            if len(alive) > k:
                # the sums so far lead to likely ones: their full scores are a bound on the k-th best
                lead = alive[np.argpartition(-total, k - 1)[:k]]
                kth = max(kth, float((self.rows[lead] @ q).min()))
                keep = total + rest + slack >= kth
                if not keep.all():
                    alive, total, rest = alive[keep], total[keep], rest[keep]
            self.left[step + 1] += len(alive)
        best = np.lexsort((self.cid[alive], -total))[:k]
        return self.cid[alive][best], total[best]

    def search_big(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """The same for numbers whose products leave the doubles' exact range."""
        peak_q, peak_c = (max(1.0, float(np.abs(x).max(initial=0))) for x in (q, self.rows))
        shrink_q, shrink_c = (2.0 ** max(0, int(np.ceil(np.log2(x))) - 480) for x in (peak_q, peak_c))
        a, c = q / shrink_q, self.rows / shrink_c  # powers of two: nothing is rounded but what is below the slack
        near = c @ a
        slack = (np.abs(c) @ np.abs(a)) * (2 * len(q) + 4) * 2.0**-52 + 1e-290
        top = float(LONG) / shrink_q / shrink_c
        low, high = np.minimum(near - slack, top), np.minimum(near + slack, top)
        others = np.flatnonzero(self.cid != own)
        if len(others) > k:
            kth = np.partition(low[others], len(others) - k)[len(others) - k]
            others = others[high[others] >= kth]
        mine = [int(x) for x in q]
        scores = [LONG - 1 if near[i] - slack[i] > top * 1.01 else max(-LONG, min(LONG - 1, sum(x * int(y) for x, y in zip(mine, self.rows[i], strict=True)))) for i in others.tolist()]
        found = sorted(zip((-x for x in scores), self.cid[others].tolist(), strict=True))[:k]
        return np.array([i for _, i in found], dtype=np.int64), [-x for x, _ in found]


def search_cell(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, told: list | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For each query its k best candidates (score down, id up) as flat arrays: query place, candidate id, score."""
    cell, dim = Cell(cid, c), max(q.shape[1], 1)
    peak = max(np.abs(c).max(initial=0), 1) * dim
    out_q, out_c, out_s = [], [], []
    for i, row in enumerate(q):
        big = peak * max(np.abs(row).max(initial=0), 1) >= 2**53 or peak**2 >= 2**53
        ids, scores = (cell.search_big if big else cell.search)(int(qid[i]), row, k)
        out_q.append(np.full(len(ids), i))
        out_c.append(ids)
        out_s += [int(x) for x in scores]
    if told is not None:
        told.append(cell.left)
    return np.concatenate([[], *out_q]).astype(int), np.concatenate([np.array([], dtype=np.int64), *out_c]), out_s


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, group_rows: int = 65_536, query_rows: int = 16_384, cell_values: int = 1 << 22) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of vectors but those of its own id.

    A group holds at most cell_values numbers, so its memory does not grow with the vectors' length.
    """
    n, wide = vectors.agg(F.count("*"), F.max("dim")).first()
    m = queries.count()
    group_rows, query_rows = (max(1, min(rows, cell_values // max(wide or 1, 1))) for rows in (group_rows, query_rows))
    # a small table is still dealt to as many tasks as there are shuffle partitions, in groups of some thousand
    spread_over = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096))
    groups, query_groups = max(-(-max(n, 1) // group_rows), spread_over), -(-max(m, 1) // query_rows)
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    # a row's number in its table deals out repeated rows like any other; any dealing gives the same answer
    number = F.xxhash64(F.monotonically_increasing_id())
    c = vectors.select("vec_id", "v", "dim", F.pmod(number, F.lit(groups)).cast("int").alias("g")).select("*", spread(query_groups).alias("h"))
    q = queries.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_groups)).cast("int").alias("h")).select("*", spread(groups).alias("g"))

    def cell(left: Iterator[pd.DataFrame] | pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "nth": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        at, ids, scores = search_cell(left["vec_id"].to_numpy(), _floor(left["v"]), right["vec_id"].to_numpy(), _floor(right["v"]), k)
        return pd.DataFrame({"query_id": left["vec_id"].to_numpy()[at], "nth": left["nth"].to_numpy()[at], "vec_id": ids, "score": np.array(scores, dtype=np.int64)})

    # repeated queries are told apart by their number among rows of equal id
    q = q.withColumn("nth", F.row_number().over(Window.partitionBy("g", "h", "dim", "vec_id").orderBy("v")).cast("long"))
    near = q.groupBy("g", "h", "dim").cogroup(c.groupBy("g", "h", "dim")).applyInPandas(cell, "query_id long, nth long, vec_id long, score long")
    order = Window.partitionBy("query_id", "nth").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
