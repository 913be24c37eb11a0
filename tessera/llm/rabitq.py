"""Embedding near-dedup by randomised-rotation binary codes with correction factors.

Each unit vector o is turned by a random rotation P; its code is the signs of P o, read as the unit vector
s = sign(P o) / sqrt(d). The stored factor f = <P o, s> makes <P q, s> / f an unbiased estimate of <q, o> over
random rotations, with an error of at most e * sqrt((1 - f^2) / f^2 / (d - 1)) but for a chance that falls as
exp(-c e^2). Since s lies arccos(f) from P o, the triangle inequality also bounds <q, o> for certain:
arccos <P q, s> <= arccos <q, o> + arccos f. That bound decides here, as near 0.93 it dismisses more pairs than a
wide e would, and can't lose one.

What is compared are stored codes: the sign bits and f of one side, the rotated vector in a byte a component, with
its own error, of the other. Only vectors with a pair that the bound leaves open are fetched, for exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, find, union, written

THRESHOLD, SEED = 0.93, 20240
#: Vectors of a block; pairs of blocks of one label are compared in a task. Rows of a batch of products.
BLOCK, STEP = 16384, 512
#: Vectors that larger labels are clustered around, of all labels together and of one; those of least hash. They
#: only decide which blocks are compared: with any of them, or none, every link is found.
MOST_PIVOTS, LABEL_PIVOTS = 4096, 256
#: Rounding of products, many times over.
SLACK = 1e-6
CODES = "label string, d int, rid long, code binary, factor double, bytes binary, scale double, error double"


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their size."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, packed sign codes, factors f) of unit vectors."""
    turned = unit @ rotation(unit.shape[1]).T
    return turned, np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def in_bytes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8, scale, error): scale * int8 is the rotated vector but for a difference of length error."""
    scale = np.abs(turned).max(axis=1) / 127
    small = np.rint(turned / scale[:, None]).astype(np.int8)
    return small, scale, np.linalg.norm(turned - small * scale[:, None], axis=1)


def bound(factors: np.ndarray, d: int, width: float) -> np.ndarray:
    """How far estimates are off at most, but for a chance that falls with the square of the width."""
    return width * np.sqrt(np.maximum(0.0, 1 - factors**2) / factors**2 / max(1, d - 1))


def estimates(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Estimated inner products of the rotated queries with the vectors behind the codes."""
    d = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    return (turned @ signs.T) / (np.sqrt(d) * factors)


def least_products(factors: np.ndarray, threshold: float) -> np.ndarray:
    """<P q, s> of a pair at the threshold or above it is at least this, for certain."""
    return np.cos(np.minimum(np.pi, np.arccos(np.clip(factors, -1, 1)) + np.arccos(threshold))) - SLACK


def open_rows(small: np.ndarray, scale: np.ndarray, error: np.ndarray, codes: np.ndarray, least: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of either side have a pair that the bound leaves open; with ``same`` the sides are one, less the diagonal.

    Products of bytes and signs are whole numbers below 2^24, so float32 has them exactly."""
    d = small.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1).T.copy()
    left, right = np.zeros(len(small), bool), np.zeros(len(codes), bool)
    for i in range(0, len(small), STEP):
        part = slice(i, i + STEP)
        wide = np.float64 if d > 1 << 16 else np.float32
        found = (small[part].astype(wide) @ signs) * (scale[part, None] / np.sqrt(d)) + error[part, None] >= least[None, :]
        if same:
            rows = np.arange(found.shape[0])
            found[rows, rows + i] = False
        left[part] = found.any(axis=1)
        right |= found.any(axis=0)
    return left, right


def exact_links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows whose product is at the threshold or above it, in double precision; with ``same`` only i < j."""
    for i in range(0, len(a), STEP):
        x, y = np.nonzero(a[i : i + STEP] @ b.T >= threshold - SLACK)
        x = x + i
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 65536):
            u, v = x[k : k + 65536], y[k : k + 65536]
            keep = np.einsum("ij,ij->i", a[u], b[v]) >= threshold
            yield u[keep], v[keep]


def matrix(column: pa.ChunkedArray | pa.Array, d: int, kind: str) -> np.ndarray:
    """A binary or list column whose values have one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), d)


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two blocks of a group, in order of rid."""
    i, j, own = table.column("bi")[0].as_py(), table.column("bj")[0].as_py(), table.column("blk").to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def open_of_group(table: pa.Table) -> pa.Table:
    """The group's rows that have a pair the bound leaves open: (label, d, bi, bj, blk, rid)."""
    table = table.sort_by("rid")
    d = table.column("d")[0].as_py()
    a, b, same = sides(table)
    keep = np.zeros(table.num_rows, bool)
    if len(a) and len(b):
        small, codes = matrix(table.column("bytes"), d, "i1"), matrix(table.column("code"), d, "u1")
        least = least_products(table.column("factor").to_numpy(), THRESHOLD)
        scale, error = table.column("scale").to_numpy(), table.column("error").to_numpy()
        left, right = open_rows(small[a], scale[a], error[a], codes[b], least[b], same)
        keep[a] |= left
        keep[b] |= right
    return table.select(["label", "d", "bi", "bj", "blk", "rid"]).filter(pa.array(keep))


def merged(least: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each row's tree after the links (u, v); links within a tree cost no step each."""
    x, y = least[u], least[v]
    pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1)[x != y], axis=0)
    if not len(pairs):
        return least
    parent: dict[int, int] = {}
    for p, q in pairs.tolist():
        union(parent, p, q)
    new = np.arange(len(least))
    for p in list(parent):
        new[p] = find(parent, p)
    return new[least]


def links_of_group(table: pa.Table) -> pa.Table:
    """(rid, links, root) of one pair of blocks: how many other vectors each class is linked to here, and the least
    class of its links' tree, so fewer rows than classes."""
    table = table.sort_by("rid")
    rid, n = table.column("rid").to_numpy(), table.column("copies").to_numpy()
    unit = unit_rows(matrix(table.column("embedding"), table.column("d")[0].as_py(), "f8"))
    a, b, same = sides(table)
    count, least = np.zeros(len(rid), np.int64), np.arange(len(rid))
    for u, v in exact_links(unit[a], unit[b], same):
        u, v = a[u], b[v]
        count += np.bincount(u, n[v], len(rid)).astype(np.int64) + np.bincount(v, n[u], len(rid)).astype(np.int64)
        least = merged(least, u, v)
    at = np.flatnonzero(count)
    return pa.table({"rid": rid[at], "links": count[at], "root": rid[least[at]]})


def encoded(reps: DataFrame) -> DataFrame:
    """The stored codes of ``reps(label, d, rid, embedding)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                turned, codes, factors = encode(unit_rows(matrix(part.column("embedding"), d, "f8")))
                small, scale, error = in_bytes(turned)
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("d"), part.column("rid"), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(factors), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(scale), pa.array(error)], ["label", "d", "rid", "code", "factor", "bytes", "scale", "error"])

    return reps.select("label", "d", "rid", "embedding").mapInArrow(run, CODES)


def pivots(codes: DataFrame, sizes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """By label and length, for the largest labels of more than a block: rotated unit vectors to cluster around."""
    wanted, left = {}, MOST_PIVOTS
    for r in sizes.where(F.col("n") > BLOCK).orderBy(F.desc("n"), "label", "d").limit(MOST_PIVOTS // 2).collect():
        k = min(LABEL_PIVOTS, -(-r["n"] // BLOCK), left)
        if k >= 2:
            wanted[(r["label"], r["d"])], left = (k, max(1, r["n"] // (2 * k))), left - k
    if not wanted:
        return {}
    # about twice as many as are wanted, by their hash
    steps = codes.sparkSession.createDataFrame([(*key, step) for key, (_, step) in wanted.items()], "label string, d int, step long")
    some = codes.join(F.broadcast(steps), ["label", "d"]).withColumn("h", F.xxhash64("rid")).where(F.pmod("h", "step") == 0)
    rows: dict[tuple[str, int], list] = {}
    for r in some.select("label", "d", "h", "bytes").collect():
        rows.setdefault((r["label"], r["d"]), []).append((r["h"], bytes(r["bytes"])))
    chosen = {key: sorted(found)[: wanted[key][0]] for key, found in rows.items()}
    return {key: unit_rows(np.array([np.frombuffer(x, np.int8) for _, x in found], np.float64)) for key, found in chosen.items()}


def angles(batch: pa.RecordBatch, d: int, centres: np.ndarray) -> np.ndarray:
    """Angles of a batch's vectors, as their bytes have them, to the centres."""
    return np.arccos(np.clip(unit_rows(matrix(batch.column("bytes"), d, "i1").astype(np.float64)) @ centres.T, -1, 1))


def off_by(batch: pa.RecordBatch) -> np.ndarray:
    """The angle between a vector and its bytes at most."""
    return np.arcsin(np.minimum(1.0, batch.column("error").to_numpy()))


def by_label(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    labels, sizes = batch.column("label").to_pylist(), batch.column("d").to_pylist()
    for key in dict.fromkeys(zip(labels, sizes, strict=True)):
        yield key, batch.filter(pa.array([x == key for x in zip(labels, sizes, strict=True)]))


def dealt(codes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Codes with the pairs of blocks (bi, bj) of their label that they take part in, and their own block.

    Labels of more than a block are cut in blocks by a hash, those with pivots by their nearest pivot first: a vector
    goes to the blocks of a pivot only if it can be within the threshold's angle of the farthest vector there.
    """
    counted = codes.join(sizes, ["label", "d"])
    spread = F.xxhash64("rid")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    centres = pivots(codes, sizes)
    plain = counted
    if centres:
        named = codes.sparkSession.createDataFrame(list(centres), "label string, d int")
        plain = counted.join(F.broadcast(named), ["label", "d"], "left_anti")
    plain = plain.withColumn("blocks", n_blocks).withColumn("blk", F.pmod(spread, F.col("blocks")).cast("int"))
    plain = plain.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["label", "d", "rid", "code", "factor", "bytes", "scale", "error"]
    plain = plain.select(*names, F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk")
    if not centres:
        return plain

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, d), part in by_label(batch):
                angle = angles(part, d, centres[(label, d)])
                near, most = angle.argmin(axis=1), angle.min(axis=1) + off_by(part)
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("d"), pa.array(near.astype(np.int32)), pa.array(most)], ["label", "d", "near", "angle"])

    mine = codes.join(F.broadcast(named), ["label", "d"]).select(*names)
    found = mine.mapInArrow(nearest, "label string, d int, near int, angle double").groupBy("label", "d", "near").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    # by label: blocks of each pivot, the first of them, and how far its vectors lie from it at most
    plan = {key: (np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(len(c), np.int64)) for key, c in centres.items()}
    for r in found:
        count, radius, _ = plan[(r["label"], r["d"])]
        count[r["near"]], radius[r["near"]] = -(-r["n"] // BLOCK), r["radius"]
    for count, _, first in plan.values():
        first[1:] = np.cumsum(count)[:-1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, d), part in by_label(batch):
                count, radius, first = plan[(label, d)]
                angle = angles(part, d, centres[(label, d)])
                near, h = angle.argmin(axis=1), part.column("h").to_numpy()
                reach = angle <= radius[None, :] + np.arccos(THRESHOLD) + off_by(part)[:, None] + SLACK
                reach[np.arange(len(near)), near] = True
                own = first[near] + np.mod(h, count[near])
                row, pivot = np.nonzero(reach & (count > 0)[None, :])
                times = count[pivot]
                row, at = np.repeat(row, times), np.repeat(first[pivot], times)
                other = at + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                mine = own[row]
                for s in range(0, len(row), 8192):
                    some = part.select(names).take(pa.array(row[s : s + 8192]))
                    x, y = mine[s : s + 8192], other[s : s + 8192]
                    yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(z.astype(np.int32)) for z in (np.minimum(x, y), np.maximum(x, y), x))], [*names, "bi", "bj", "blk"])

    clustered = mine.withColumn("h", spread).mapInArrow(deal, f"{CODES}, bi int, bj int, blk int")
    return plain.unionByName(clustered)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null. Vectors that are null, zero, or hold null or
    non-finite components link with nothing; nor do vectors of different lengths. Equal vectors of a label are
    one class, compared once, and are linked to each other. Repeated rows count as vectors of their own, with
    one id. Classes of a label are dealt in blocks (``dealt``); every pair of classes is judged or ruled out by the
    triangle inequality, whatever the label's share of the rows. An empty table gives none.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(v.isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("embedding"), usable.alias("usable"))
    # a class is one row of a label: named by its least id and its vector's hash, as ids may repeat
    reps = rows.where("usable").groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    reps = written(reps.withColumn("d", F.size("embedding")).withColumn("rid", F.monotonically_increasing_id()), "classes")
    codes = written(encoded(reps), "codes")
    sizes = codes.groupBy("label", "d").agg(F.count("*").alias("n"))
    group = ["label", "d", "bi", "bj"]
    doubtful = dealt(codes, sizes).groupBy(*group).applyInArrow(open_of_group, "label string, d int, bi int, bj int, blk int, rid long")
    doubtful = written(doubtful, "doubtful")
    exact = doubtful.join(reps.select("rid", "copies", "embedding"), "rid")
    found = written(exact.groupBy(*group).applyInArrow(links_of_group, "rid long, links long, root long"), "links")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    classes = reps.join(counts, "rid", "left").join(of.withColumnRenamed("id", "of"), F.col("rid") == F.col("of"), "left")
    classes = classes.withColumn("c", F.coalesce("component", "rid"))
    # components are of classes; each is named by the least id of its classes' rows
    least = classes.groupBy("c").agg(F.min("id").alias("component_id"))
    classes = classes.join(least, "c").select(F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    on = (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))
    some = rows.where("usable").join(classes, on).select("id", "n", "component_id")
    none = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id"))
    every = some.union(none)
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
