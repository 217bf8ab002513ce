"""Exact top-k by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import file_store, written
from curbflow.session import scratch_path


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def scaled(vector: Column, factor: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def cell_edges(vectors: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """Per dimensionality, the first value of each of 2^bits cells of every component, and its end.

    Each task gives its extremes, Spark merges them, and two numbers a component reach the driver.
    """

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole):
                if dim:
                    m = _matrix(batch.column("v"), dim)
                    columns = [pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(m.min(0)), pa.array(m.max(0))]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "at", "low", "high"])

    found = (
        vectors.select("dim", "v").mapInArrow(extremes, "dim long, at long, low long, high long")
        .groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    )
    edges: dict[int, np.ndarray] = {}
    cells = 1 << bits
    for row in found:
        table = edges.setdefault(row["dim"], np.zeros((row["dim"], cells + 1), np.int64))
        span = row["high"] - row["low"] + 1
        table[row["at"]] = [row["low"] + span * c // cells for c in range(cells + 1)]
    return edges


def approximation_file(vectors: DataFrame, edges: dict[int, np.ndarray], block: int) -> DataFrame:
    """Rows of up to ``block`` vectors: their row numbers, ids and one cell number a component."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole):
                for at in range(0, batch.num_rows, block):
                    piece = batch.slice(at, block)
                    m = _matrix(piece.column("v"), dim)
                    codes = np.zeros(m.shape, np.uint8)
                    for d in range(dim):
                        codes[:, d] = np.searchsorted(edges[dim][d], m[:, d], "right") - 1
                    names = [piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("row", "id")]
                    packed = [pa.array([raw], pa.binary()) for raw in (*names, codes.tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([dim]), *packed], ["dim", "rows", "ids", "codes"])

    schema = "dim long, rows binary, ids binary, codes binary"
    return written(vectors.select("dim", "row", "id", "v").mapInArrow(pack, schema), "va-file")


def _query_blocks(path: str, size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The query table in the shared folder, ``size`` queries at a time."""
    store, root = file_store(path)
    for name in sorted(f.path for f in store.get_file_info(_selector(root)) if f.path.endswith(".parquet")):
        with store.open_input_file(name) as f:
            for whole in pq.ParquetFile(f).iter_batches(size):
                yield from _by_dim(whole)


def _selector(root: str):
    import pyarrow.fs as pafs

    return pafs.FileSelector(root)


def _rounds(edges: dict[int, np.ndarray], dim: int) -> bool:
    """Whether inner products of vectors within the cells can leave the exact range of doubles."""
    return dim in edges and sum(int(x) ** 2 for x in np.abs(edges[dim]).max(1)) >= 1 << 52


def _bounds(file: DataFrame, queries: str, edges: dict[int, np.ndarray], k: int, threshold: bool) -> DataFrame:
    """Scan the cells. Without thresholds: per query and block, the k-th best lower bound. With
    them: the candidates whose upper bound reaches the query's threshold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                rows, ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), dim)
                low, high = np.zeros(codes.shape), np.zeros(codes.shape)
                for d in range(dim):
                    low[:, d] = edges[dim][d][codes[:, d]]
                    high[:, d] = edges[dim][d][codes[:, d].astype(np.int64) + 1] - 1
                # Beyond 2^53 sums of doubles round: bounds are then widened by more than they can be off.
                widest = np.maximum(np.abs(low), np.abs(high)) if _rounds(edges, dim) else None
                for query_dim, block in _query_blocks(queries, 256):
                    if query_dim != dim:
                        continue
                    q = _matrix(block.column("v"), dim).astype(np.float64)
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    names = block.column("query").to_numpy(zero_copy_only=False)
                    slack = 0.0 if widest is None else (np.abs(q) @ widest.T) * (4 * dim * np.finfo(np.float64).eps)
                    own = block.column("id").to_numpy(zero_copy_only=False)[:, None] == ids[None, :]
                    if not threshold:
                        bound = up @ low.T + down @ high.T - slack
                        bound[own] = -np.inf
                        if len(ids) > k:
                            best = np.partition(bound, len(ids) - k, axis=1)[:, len(ids) - k]
                            good = np.isfinite(best)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(names[good]), pa.array(best[good])], ["query", "bound"]
                            )
                        continue
                    bound = up @ high.T + down @ low.T + slack
                    bound[own] = -np.inf
                    floor = block.column("threshold").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    r, c = np.nonzero((bound >= floor[:, None]) & ~own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[r]), pa.array(rows[c]), pa.array(bound[r, c])], ["query", "candidate", "bound"]
                    )

    schema = "query long, candidate long, bound double" if threshold else "query long, bound double"
    return file.mapInArrow(scan, schema)


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, bits: int = 6, block: int = 8192,
    key: str = "vec_id", vector: str = "v",
) -> DataFrame:
    """The ``k`` highest inner products of every query row with all other rows, exactly.

    ``vectors`` holds integer vectors. Each component is kept as one of 2^bits cells. A first scan
    of the cells gives every query a threshold below its k-th score (the best, over blocks, of the
    k-th lower bound); a second keeps the candidates whose upper bound reaches it. Exact vectors are
    then read in order of upper bound, in doubling waves, until no unread bound reaches the k-th
    exact score found. Queries are read by the tasks in blocks from the shared folder.

    Ties go to the smaller key. A query is not its own candidate, nor is another row with its key.
    Of equal vectors only the k + 1 smallest keys can be in any answer, so a very common vector is
    cut to those before the scan and nothing is lost. Null keys and vectors, and null components,
    take no part; vectors meet only those with as many components, and those of none score 0 among
    themselves. Nor do vectors with a component whose square times their length exceeds 2^62 (2^28
    at 64 components): no long holds their products. Equal rows count once; an id with several
    vectors is several candidates, and each asks on its own where it is a query. Gives query_id, rank, vec_id and score; an empty table gives none.
    """
    spark = vectors.sparkSession
    whole = written(
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v"), is_query.alias("_asks"))
        .filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
        .withColumn("dim", F.size("v").cast("long"))
        .filter(F.forall("v", lambda x: F.abs(x.cast("double")) <= F.sqrt(F.lit(float(1 << 62)) / F.col("dim"))))
        .dropDuplicates(["id", "v"]),
        "va-vectors",
    )
    same = Window.partitionBy("v").orderBy("id")
    base = written(
        whole.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).select("dim", "id", "v", F.monotonically_increasing_id().alias("row")), "va-exact"
    )
    asked = written(
        whole.filter("_asks").select("dim", "id", "v").withColumn("query", F.monotonically_increasing_id()), "va-queries"
    )
    edges = cell_edges(base, bits)
    file = approximation_file(base, edges, block)

    def stored(df: DataFrame) -> str:
        path = scratch_path(spark, "va-asked")
        df.write.parquet(path)
        return path

    lower = _bounds(file, stored(asked), edges, k, False).groupBy("query").agg(F.max("bound").alias("threshold"))
    with_floor = stored(asked.join(lower, "query", "left").select("dim", "id", "v", "query", "threshold"))
    # Candidates are rows and not ids: an id may have several vectors.
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "candidate")
    candidates = written(
        _bounds(file, with_floor, edges, k, True).withColumn("place", F.row_number().over(by_bound)), "va-candidates"
    )

    left = asked.select("query", F.col("v").alias("_qv"))
    right = base.select(F.col("row").alias("candidate"), F.col("id").alias("vec_id"), F.col("dim").alias("_dim"), F.col("v").alias("_cv"))

    def exact(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("_qv", "_cv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        return (
            pairs.join(right, "candidate").join(left, "query").filter(F.size("_qv") == F.col("_dim"))
            .select("query", "candidate", "vec_id", dot.alias("score"))
        )

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "candidate")
    done, first, size = None, 0, 2 * k
    while True:
        wave = candidates.filter((F.col("place") > first) & (F.col("place") <= first + size))
        if done is not None:
            kth = done.filter(F.col("rank") == k).select("query", F.col("score").alias("_kth"))
            wave = wave.join(kth, "query", "left").filter("_kth IS NULL OR bound >= _kth").drop("_kth")
        scored = written(exact(wave), "va-wave")
        if scored.isEmpty():
            break
        merged = scored if done is None else scored.unionByName(done.select("query", "candidate", "vec_id", "score"))
        done = written(merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "va-best")
        first, size = first + size, 2 * size
    if done is None:
        done = spark.createDataFrame([], "query long, candidate long, vec_id long, score long, rank int")
    return done.join(asked.select("query", F.col("id").alias("query_id")), "query").select(
        "query_id", "rank", "vec_id", "score"
    )
