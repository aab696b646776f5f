"""Vector search: exact neighbours by blocks, exact cosine, sign-bit search with rerank, centroids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine, 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


#: Vectors of a block, on either side, and the queries that one multiplication takes: 512 x 8192 products of 8 bytes.
BLOCK, SLICE = 8192, 512
#: Query vectors that travel to every task instead of being dealt into blocks; 8 bytes a component.
CARRIED = 4096
#: Vectors of a block of which only the k best of each query are kept, so that few are shuffled, and products of one multiplication.
WIDE, PRODUCTS = 65_536, 4_194_304


def matrix_of(t: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in t.column(name).chunks]).to_numpy(zero_copy_only=False)
    return flat.astype("float64").reshape(t.num_rows, -1)


def greatest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest values of each row that aren't -inf, greatest first, equal ones by column."""
    n = sims.shape[1]
    cut = np.partition(sims, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
    row, place = np.nonzero((sims >= cut) & (sims > -np.inf))
    order = np.lexsort((-sims[row, place], row))  # stable: equal ones by column
    row, place = row[order], place[order]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    good = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row))) < k
    return row[good], place[good]


def _cell(k: int):
    """The k best of each query of one block among the vectors of another, as a function of two Arrow tables."""
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("sim", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
        ids, x = right.column("vec_id").to_numpy()[order], matrix_of(right, "embedding")[order]
        names, y = left.column("q").to_numpy(), matrix_of(left, "qe")
        out: list[tuple[np.ndarray, ...]] = []
        step = max(1, PRODUCTS // len(x))
        for at in range(0, len(y), step):
            sims = np.round(y[at : at + step] @ x.T, 6)
            sims[(ids == names[at : at + step, None]) | ~np.isfinite(sims)] = -np.inf
            row, place = greatest(sims, k)
            out.append((names[at + row], ids[place], sims[row, place]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

    return best


def _sound(name: str) -> Column:
    return (F.size(name) > 0) & ~F.exists(name, lambda x: x.isNull())


def _meet(queries: DataFrame, vectors: DataFrame, cell, schema: str, more: tuple[str, ...] = (), wide: int = 0) -> DataFrame:
    """What ``cell`` makes of two tables, (q, qe, more) and (vec_id, embedding, label if there is one), over all queries and vectors.

    At most ``CARRIED`` queries are sent to the tasks that read the vectors, as one table (their number is counted first).
    More queries and vectors are dealt into blocks of some ``BLOCK`` rows (``wide`` vectors, if it is given) by hash, and every block of queries meets every
    block of vectors. Vectors meet those of their own length; null vectors and null components meet nothing.
    """
    labelled = ["label"] if "label" in vectors.columns else []
    q = queries.where(_sound("embedding")).select(F.col("vec_id").cast("long").alias("q"), F.col("embedding").alias("qe"), *more)
    v = vectors.where(_sound("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *labelled)
    few = q.limit(CARRIED + 1).toArrow()
    if few.num_rows <= CARRIED:
        return v.mapInArrow(_met(few, cell, wide or BLOCK), schema)
    rows, columns = (max(1, math.ceil(df.count() / n)) for df, n in ((queries, BLOCK), (vectors, wide or BLOCK)))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("_d", F.size("qe")).withColumn("_i", deal("q", rows)).withColumn("_j", every(columns))
    right = v.withColumn("_d", F.size("embedding")).withColumn("_j", deal("vec_id", columns)).withColumn("_i", every(rows))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return cell(a, b) if a.num_rows and b.num_rows else _empty(schema)

    return left.groupBy("_d", "_i", "_j").cogroup(right.groupBy("_d", "_i", "_j")).applyInArrow(both, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]).empty_table()


def _met(queries: pa.Table, cell, block: int):
    """``cell`` of the queries and the vectors of a partition, some thousand at a time."""
    lengths = pc.list_value_length(queries.column("qe"))

    def some(batches):
        own = pa.Table.from_batches(batches) if batches else None
        if own is None or not own.num_rows or not queries.num_rows:
            return
        size = pc.list_value_length(own.column("embedding"))
        for n in pc.unique(size).to_pylist():
            asked = queries.filter(pc.equal(lengths, n))
            if asked.num_rows:
                yield from cell(asked, own.filter(pc.equal(size, n))).to_batches()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield from some(held)
                held, rows = [], 0
        yield from some(held)

    return run


def ranked_neighbours(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """q, vec_id, sim, rn: the k other vectors of greatest dot product of each of a stated set of queries.

    Only the k best of each query and batch are shuffled. Products that aren't finite give no neighbour.
    """
    sim = _meet(queries, vectors, _cell(k), "q long, vec_id long, sim double", wide=WIDE)
    return sim.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")).cast("long")).where(F.col("rn") <= k)


def _packed(x: np.ndarray) -> np.ndarray:
    """The signs of each row as bits, eight to a byte."""
    return np.packbits(x > 0, axis=1)


def _coarse(over: int):
    """The ``over`` nearest by sign bits of each query among some vectors, with their exact products."""
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("far", pa.int64()), ("sim", pa.float64())])

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
        ids, x = right.column("vec_id").to_numpy()[order], matrix_of(right, "embedding")[order]
        names, y = left.column("q").to_numpy(), matrix_of(left, "qe")
        bits, asked, out = _packed(x), _packed(y), []
        for i, name in enumerate(names.tolist()):
            far = np.bitwise_count(bits ^ asked[i]).sum(1).astype(np.int64)
            far[ids == name] = 1 << 40
            top = np.argsort(far, kind="stable")[:over]  # stable: equal ones by id
            top = top[far[top] < 1 << 40]
            out.append((np.full(len(top), name), ids[top], far[top], np.round(x[top] @ y[i], 6)))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)

    return near


def quantised_search(queries: DataFrame, vectors: DataFrame, over: int, k: int) -> DataFrame:
    """q, vec_id, rn: the nearest ``over`` by packed sign bits, reranked by exact product to ``k``.

    Queries and vectors meet as in :func:`ranked_neighbours`; ``over`` candidates of each query and batch are shuffled.
    """
    near = _meet(queries, vectors, _coarse(over), "q long, vec_id long, far long, sim double")
    best = near.withColumn("c", F.row_number().over(Window.partitionBy("q").orderBy("far", "vec_id"))).where(F.col("c") <= over)
    fine = best.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")).cast("long"))
    return fine.where(F.col("rn") <= k).select("q", "vec_id", "rn")


def separation(queries: DataFrame, vectors: DataFrame, label: str) -> DataFrame:
    """within, across: mean product of each query with the other vectors of its label, and of other labels; one row.

    Sums of products are products of sums, so only the component sums of each label are shuffled, never a pair.
    """
    summed = lambda df, name: df.select(label, F.posexplode("embedding").alias("i", "x")).groupBy(label, "i").agg(F.sum(F.col("x").cast("double")).alias(name))
    both = summed(queries, "a").join(summed(vectors, "b"), [label, "i"], "full")
    own = both.groupBy("i").agg(F.sum(F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("same"), (F.sum("a") * F.sum("b")).alias("every"))
    product = own.agg(F.sum("same").alias("same"), F.sum("every").alias("every"))
    n = queries.groupBy(label).agg(F.count("*").alias("a"), F.sum(dot("embedding", "embedding")).alias("self")).join(vectors.groupBy(label).agg(F.count("*").alias("b")), label, "full")
    counts = n.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0))).alias("ab"), F.sum("self").alias("self"))
    one = product.crossJoin(counts)  # a row each
    within = (F.col("same") - F.col("self")) / F.nullif(F.col("ab") - F.col("a"), F.lit(0))
    return one.select(within.alias("within"), ((F.col("every") - F.col("same")) / F.nullif(F.col("a") * F.col("b") - F.col("ab"), F.lit(0))).alias("across"))


def first_hits(queries: DataFrame, vectors: DataFrame, label: str) -> DataFrame:
    """q, first: the rank from 1 of each query's first neighbour with its own label; null without one.

    Two passes, both with a few numbers for each query and batch: the best neighbour of the label, then how many of all come before.
    """
    named = lambda df: df.select("vec_id", "embedding", F.col(label).cast("long").alias("label"))
    q, v = named(queries), named(vectors)

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        sims, ids, names = _products(left, right)
        sims[left.column("label").to_numpy()[:, None] != right.column("label").to_numpy()[None, :]] = -np.inf
        best = sims.max(1)
        least = np.where(sims == best[:, None], ids[None, :], np.iinfo(np.int64).max).min(1)
        met = best > -np.inf
        return pa.table([names[met], best[met], least[met]], names=["q", "sim", "vec_id"])

    best = _meet(q, v, _sliced(own), "q long, sim double, vec_id long", ("label",)).groupBy("q").agg(F.max(F.struct("sim", (-F.col("vec_id")).alias("i"))).alias("b"))
    marked = q.join(best.select(F.col("q").alias("vec_id"), F.col("b.sim").alias("mark"), (-F.col("b.i")).alias("at")), "vec_id")

    def before(left: pa.Table, right: pa.Table) -> pa.Table:
        sims, ids, names = _products(left, right)
        mark, at = left.column("mark").to_numpy()[:, None], left.column("at").to_numpy()[:, None]
        return pa.table([names, ((sims > mark) | (sims == mark) & (ids[None, :] < at)).sum(1)], names=["q", "n"])

    ahead = _meet(marked, v, _sliced(before), "q long, n long", ("mark", "at")).groupBy("q").agg((F.sum("n") + 1).alias("first"))
    return queries.select(F.col("vec_id").alias("q")).join(ahead, "q", "left")


def _sliced(cell):
    """``cell`` of ``SLICE`` queries at a time, so that its products take no more memory when there are more queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([cell(left.slice(at, SLICE), right) for at in range(0, left.num_rows, SLICE)])

    return run


def _products(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rounded products, ids, names) of two tables; a query with itself, and what isn't finite, is minus infinity."""
    ids, names = right.column("vec_id").to_numpy(), left.column("q").to_numpy()
    sims = np.round(matrix_of(left, "qe") @ matrix_of(right, "embedding").T, 6)
    sims[(ids[None, :] == names[:, None]) | ~np.isfinite(sims)] = -np.inf
    return sims, ids, names


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """key, dim, value of the unit mean vector of each group."""
    mean = vectors.select(key, F.posexplode("embedding").alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))
    return mean.select(key, F.col("dim").cast("long").alias("dim"), F.round(F.col("m") / size, 5).alias("value"))
