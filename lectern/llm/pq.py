"""Operator 2: near-duplicate vectors by product quantisation.

Vectors with equal components collapse first. A coarse k-means gives inverted lists; the residuals are
cut into ``SUBSPACES`` parts, each coded by the nearest of ``CODES`` centroids. A partner q + d lies
nearer to centroid c than to q's own centroid o only if d(q,c)^2 - d(q,o)^2 <= 2 d.(c - o), at most
2 |d| |c - o|, so a query visits the lists within that and misses no pair at the threshold. Within a list, table lookups give the distance to each coded vector, and those
within T plus the vector's own coding error (which loses nothing) are compared by exact cosine in double
precision. The lists are as many as the root of the number of vectors. Codebooks are fitted on at most ``MOST``
vectors; all are indexed.

Neighbouring lists of few members form one group, and a vector goes once to each group with a list it
visits. Groups of many members or visitors are cut into blocks that meet in separate tasks. Only counts and a
spanning forest of the links leave a task.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors
of different lengths never link; rows without an id are dropped; rows that share an id are one vector
(the least of them in order of components); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise
from lectern.llm.components import components

SUBSPACES, CODES = 8, 256
#: Vectors that codebooks are fitted on: SAMPLE, or SHARE a list where these are more, MOST at the most.
SAMPLE, SHARE, MOST = 20_000, 4, 131_072
#: Members and visitors of a group of lists that meet in one task.
BLOCK = 4096
HEAD = "vec_id long, dims int, v binary"


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Plain Lloyd iterations from evenly spread rows; empty cells keep their centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Coarse centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.padded = -(-self.width // SUBSPACES) * SUBSPACES
        sample = self.pad(sample)
        self.coarse = kmeans(sample, lists)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        part = self.padded // SUBSPACES
        self.books = [kmeans(residual[:, i * part : (i + 1) * part], CODES) for i in range(SUBSPACES)]
        self.apart = np.sqrt(distances(self.coarse, self.coarse))

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance between each vector and its coded form."""
        residual, part = self.pad(x) - self.coarse[home], self.padded // SUBSPACES
        codes = np.stack([nearest(residual[:, i * part : (i + 1) * part], b) for i, b in enumerate(self.books)], 1)
        coded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((residual - coded) ** 2).sum(1))

    def tables(self, x: np.ndarray, home: int) -> list[np.ndarray]:
        """For each subspace, squared distances from each query's residual part to each code."""
        residual, part = self.pad(x) - self.coarse[home], self.padded // SUBSPACES
        return [distances(residual[:, i * part : (i + 1) * part], b) for i, b in enumerate(self.books)]

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Own list, and a mask of the lists to visit for vectors within ``reach``."""
        d = distances(self.pad(x), self.coarse)
        home = d.argmin(1)
        own = d[np.arange(len(d)), home]
        return home, d - own[:, None] <= 2 * reach * self.apart[home] + 1e-6


def _heads(batches):
    """The usable vectors in bytes: 32-bit floats where these hold them exactly, else 64-bit ones."""
    for batch in batches:
        ids, vectors, out = batch.column(0).to_pylist(), batch.column(1), []
        for i, x in zip(ids, vectors.to_pylist()):
            if x and None not in x:
                v = np.asarray(x, np.float64)
                if np.isfinite(v).all() and v.any():
                    with np.errstate(over="ignore"):
                        short = (v + 0.0).astype(np.float32)
                    out.append((i, len(x), (short if (short == v).all() and short.any() else v + 0.0).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], ["vec_id", "dims", "v"])


def unit(blobs: list[bytes], dims: list[int], width: int) -> np.ndarray:
    """Unit vectors, shorter ones with zeros behind."""
    out = np.zeros((len(blobs), width))
    for i, (b, d) in enumerate(zip(blobs, dims)):
        v = np.frombuffer(b, np.float32 if len(b) == 4 * d else np.float64).astype(np.float64)
        v = v / np.abs(v).max()  # no overflow in the norm
        out[i, : len(v)] = v / np.sqrt((v * v).sum())
    return out


def _index(q: Quantiser, reach: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = unit(part.column("v").to_pylist(), part.column("dims").to_pylist(), q.width)
                home, mask = q.probes(x, reach)
                codes, error = q.encode(x, home)
                mask &= np.arange(mask.shape[1])[None] >= home[:, None]  # each pair of lists meets once
                rows, lists = np.nonzero(mask)
                cuts = np.searchsorted(rows, np.arange(len(x) + 1))
                probes = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(lists, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dims"), part.column("n"), part.column("v"), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes], ["vec_id", "dims", "n", "v", "home", "codes", "error", "probes"])

    return run


def unite(label: np.ndarray, p: np.ndarray, r: np.ndarray) -> None:
    """Join the classes of p and r, pair by pair; a label is the least number of its class, before and after."""
    while True:
        a, b = label[p], label[r]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _search(q: Quantiser, threshold: float, reach: float):
    def run(key, table):
        member = table.filter(table.column("member"))
        visitor = table.filter(pc.invert(table.column("member")))
        none = pa.table({"vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        if not member.num_rows or not visitor.num_rows:
            return none
        mid, vid = member.column("vec_id").to_numpy(), visitor.column("vec_id").to_numpy()
        mx, vx = unit(member.column("v").to_pylist(), member.column("dims").to_pylist(), q.width), unit(visitor.column("v").to_pylist(), visitor.column("dims").to_pylist(), q.width)
        md, vd = member.column("dims").to_numpy(), visitor.column("dims").to_numpy()
        mhome, vhome = member.column("home").to_numpy(), visitor.column("home").to_numpy()
        probes = visitor.column("probes").combine_chunks()
        vlist, vrow = probes.flatten().to_numpy(), np.repeat(np.arange(len(vid)), pc.list_value_length(probes).to_numpy())
        codes = np.frombuffer(b"".join(member.column("codes").to_pylist()), np.uint8).reshape(len(mid), -1)
        bound = ((reach + member.column("error").to_numpy()) ** 2 + 1e-6).astype(np.float32)
        ids = np.unique(np.concatenate((vid, mid)))
        vat, mat = np.searchsorted(ids, vid), np.searchsorted(ids, mid)
        mn, vn = member.column("n").to_numpy(), visitor.column("n").to_numpy()
        n, label = np.zeros(len(ids)), np.arange(len(ids))
        for place in np.unique(mhome):
            own_members, visiting = np.flatnonzero(mhome == place), vrow[vlist == place]
            own_codes = codes[own_members]
            for at in range(0, len(visiting), 128):
                sub = visiting[at : at + 128]
                tables = [t.astype(np.float32) for t in q.tables(vx[sub], place)]
                d = tables[0][:, own_codes[:, 0]]
                for i in range(1, SUBSPACES):
                    d += tables[i][:, own_codes[:, i]]
                i, j = np.nonzero(d <= bound[own_members][None])
                i, j = sub[i], own_members[j]
                keep = (vd[i] == md[j]) & ((vhome[i] != place) | (vid[i] < mid[j]))  # within the own list, each pair once
                i, j = i[keep], j[keep]
                for k in range(0, len(i), 65536):
                    a, b = i[k : k + 65536], j[k : k + 65536]
                    hit = np.einsum("ij,ij->i", vx[a], mx[b]) >= threshold
                    a, b = a[hit], b[hit]
                    n += np.bincount(vat[a], mn[b], len(ids)) + np.bincount(mat[b], vn[a], len(ids))
                    unite(label, vat[a], mat[b])
        linked = np.flatnonzero(n)
        return pa.table({"vec_id": ids[linked], "n": n[linked].astype(np.int64), "least": ids[label[linked]]})

    return run


def _groups(members: dict[int, int], lists: int) -> list[int]:
    """The group of each list: neighbours in number with at most BLOCK members together, or one list."""
    out, held = [], 0
    for i in range(lists):
        held += members.get(i, 0)
        new = bool(out) and held > BLOCK
        out.append(out[-1] + new if out else 0)
        held = members.get(i, 0) if new else held
    return out


def _sample(classes: DataFrame, total: int) -> DataFrame:
    """The vectors to fit on, by hash of the id; few more reach the last sort."""
    most = min(MOST, max(SAMPLE, SHARE * int(total**0.5)))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    near = classes.where(place < int(min(1.0, (1.1 * most + 50) / total) * (1 << 30)) + 1)
    return near.orderBy(place, "vec_id").limit(most).select("v", "dims")


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per vector."""
    spark = vectors.sparkSession
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    usable = known.mapInArrow(_heads, HEAD).select("vec_id", "dims", "v", F.sha2("v", 256).alias("digest"))
    classed = materialise(usable.select("vec_id", "digest"), "classed")
    classes = materialise(usable.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("dims").alias("dims"), F.first("v").alias("v")), "classes")
    total, width = classes.agg(F.count("*"), F.max("dims")).first()
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    if total:
        fitted = _sample(classes, total).collect()
        q = Quantiser(unit([bytes(r["v"]) for r in fitted], [r["dims"] for r in fitted], width), max(1, min(MOST // SHARE, int(total**0.5))))
        index = materialise(classes.select("vec_id", "dims", "n", "v").mapInArrow(_index(q, reach), "vec_id long, dims int, n long, v binary, home int, codes binary, error double, probes array<int>"), "index")
        row = ("vec_id", "dims", "n", "v", "home", "codes", "error")
        counts = lambda df: {r["list"]: r["count"] for r in df.groupBy("list").count().collect()}  # noqa: E731  a row a list
        group = _groups(counts(index.select(F.col("home").alias("list"))), len(q.coarse))
        numbers = lambda ns: F.split(F.lit(",".join(map(str, ns))), ",").cast("array<int>")
        of = lambda c: F.element_at(numbers(group), c + 1)
        homes = index.select(of(F.col("home")).alias("list"), *row, F.lit(None).cast("array<int>").alias("probes"))
        calls = index.withColumn("list", F.explode(F.array_distinct(F.transform("probes", of)))).select("list", *row, F.filter("probes", lambda c: of(c) == F.col("list")).alias("probes"))
        members, visits = counts(homes), counts(calls)
        parts = lambda n: F.element_at(numbers(-(-n.get(i, 0) // BLOCK) or 1 for i in range(group[-1] + 1)), F.col("list") + 1)
        side = lambda df, own, is_member: df.withColumns({"mb": parts(members), "vb": parts(visits), "member": F.lit(is_member)}).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        held = side(homes, "mb", True).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select("list", F.col("own").alias("p"), F.col("at").alias("q"), "member", *row, "probes")
        come = side(calls, "vb", False).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select("list", F.col("at").alias("p"), F.col("own").alias("q"), "member", *row, "probes")
        found = materialise(held.unionByName(come).groupBy("list", "p", "q").applyInArrow(_search(q, threshold, reach), "vec_id long, n long, least long"), "found")
    else:
        found = spark.createDataFrame([], "vec_id long, n long, least long")
    discard(index) if total else None
    joined = components(found.select(F.col("vec_id").alias("u"), F.col("least").alias("v")))
    links = found.groupBy("vec_id").agg(F.sum("n").alias("links"))
    of_class = classes.select("digest", "vec_id", "n").join(links, "vec_id", "left").join(joined.select(F.col("u").alias("vec_id"), "v"), "vec_id", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("v", "vec_id").alias("component_id"))
    out = known.select("vec_id").join(classed.join(of_class, "digest"), "vec_id", "left")
    cid = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), (F.col("vec_id") == cid).alias("kept"))
