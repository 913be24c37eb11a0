"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits in 8 segments. If two differ in at most 4 bits, then, with the segments laid in a
ring, some segment starts chains of every length l whose differences add up to at most l * 4 / 8. So the
start segment is equal, the first three segments differ in at most one bit, the first five in at most two:
of the four segments after the start, one of five pairs of segments is equal, too. Each fingerprint is
filed under 8 starts x 5 pairs, a key of 24 equal bits; the whole chain condition prunes the pairs of a key
before the full Hamming distance is taken.

``keep_one`` takes fingerprints of the texts' distinct words through the same ring: four in five pairs of texts of
likeness 0.8 and more in five-word shingles differ in at most 4 bits there (0.17 by shingles). What it links is checked
exactly. 4 bits can't tell the rest, so texts that share a rare shingle and are apart still are compared, without loss.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, find, new_folder, remove, sliced, union, written

SEGMENTS, BITS, MOST = 8, 8, 4
#: Pairs of ring distances after the start, of which one is free of differences.
PAIRS = ((2, 4), (2, 3), (1, 4), (1, 3), (1, 2))
#: Distinct fingerprints of a key that one task compares; larger keys are dealt as pairs of blocks.
BLOCK = 2048
#: Near copies to keep one of: likeness of at least 4 / 5. Common shingles that are listed to be put last.
LIKE, HOT_LISTED = (4, 5), 200_000
#: Ids that are broadcast at most, some tens of megabytes.
BROADCAST_IDS = 2_000_000
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = 4, chunk: int = 65536) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; no words: zero."""
    # bytes.split() cuts at these six bytes exactly, and no byte of a longer UTF-8 character is among them
    parts = (text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()
    if not parts:
        return 0
    line, of = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return of(line, 42)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), chunk):
        hashes = np.array([of(line[a:b], 42) for a, b in zip(starts[i : i + chunk], ends[i : i + chunk], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def word_fingerprint(parts: list[bytes]) -> int:
    """64-bit SimHash of the distinct words; no words: zero."""
    if not parts:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in set(parts)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) of every row, repeated ones too; null texts count as empty, ids that are null stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, fp long")


def ring_keys(fp: F.Column) -> F.Column:
    """The 40 keys of a fingerprint: number of the key, then the 24 bits of its three segments."""
    seg = [F.shiftrightunsigned(fp, BITS * i).bitwiseAND(F.lit(255)) for i in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        for k, (a, b) in enumerate(PAIRS):
            own = [seg[start], seg[(start + a) % SEGMENTS], seg[(start + b) % SEGMENTS]]
            keys.append(F.shiftleft(F.lit(start * len(PAIRS) + k).cast("long"), 24).bitwiseOR(F.shiftleft(own[0], 16)).bitwiseOR(F.shiftleft(own[1], 8)).bitwiseOR(own[2]))
    return F.array(*keys)


def chains() -> list[list[np.uint64]]:
    """By start and length less one: the mask of the chain's segments."""
    one = [((1 << BITS) - 1) << (BITS * i) for i in range(SEGMENTS)]
    return [[np.uint64(reduce(int.__or__, (one[(s + j) % SEGMENTS] for j in range(n)))) for n in range(1, SEGMENTS + 1)] for s in range(SEGMENTS)]


CHAINS = chains()


def linked(fps: np.ndarray, start: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left, right), those within the budgets of all chains from ``start``; the last is the whole ring."""
    x = fps[left] ^ fps[right]
    for n, mask in enumerate(CHAINS[start], 1):
        keep = np.bitwise_count(x & mask) <= n * MOST // SEGMENTS
        if not keep.all():
            x, left, right = x[keep], left[keep], right[keep]
    return left, right


def pairs_of(n: int, block: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of n rows, some rows at a time; with ``block`` only those of different blocks."""
    rows = np.arange(n)
    for i in range(0, n, 256):
        left, right = np.broadcast_arrays(rows[i : i + 256, None], rows[None, :])
        keep = left < right if block is None else block[left] < block[right]
        yield left[keep], right[keep]


def group_edges(batches: Iterator[pa.RecordBatch], own: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, bi, bj): of each group the edges of a spanning forest of its links, so fewer than rows.

    Edges go to each tree's least row; with ``own`` they are links themselves."""
    names = ("key", "bi", "bj", "blk", "fp", "rid")
    held: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, bi, bj, blk, fp, rid = cols
        fps = fp.view(np.uint64)
        change = np.flatnonzero((np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
        u, v = [], []
        for a, b in zip(np.concatenate(([0], change)), np.concatenate((change, [len(key)])), strict=True):
            if b - a < 2:
                continue
            parent: dict[int, int] = {}
            start = int(key[a] >> 24) // len(PAIRS)
            for left, right in pairs_of(b - a, None if bi[a] == bj[a] else blk[a:b]):
                left, right = linked(fps[a:b], start, left, right)
                for x, y in zip(rid[a:b][left].tolist(), rid[a:b][right].tolist(), strict=True):
                    if own and find(parent, x) != find(parent, y):
                        u.append(x)
                        v.append(y)
                    union(parent, x, y)
            for x in () if own else list(parent):
                if (root := find(parent, x)) != x:
                    u.append(x)
                    v.append(root)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [c[last:] for c in cols]
        if last:
            yield links([c[:last] for c in cols])
    if held is not None:
        yield links(held)


def in_blocks(df: DataFrame, size: F.Column, spread: F.Column) -> DataFrame:
    """Rows with (blk, bi, bj): groups of more than BLOCK rows are dealt as pairs of blocks, smaller ones as one."""
    n = F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")
    df = df.withColumn("n_blocks", n).withColumn("blk", F.pmod(spread, F.col("n_blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return df.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other", "n_blocks")


def dealt_keys(reps: DataFrame) -> DataFrame:
    """Rows of ``reps(fp, rid)`` for each of their keys that another row has, too: (key, bi, bj, blk, fp, rid), by group."""
    keys = reps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp", "rid")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # the plan takes the 40 rows of a fingerprint for one, and would broadcast them all by way of the driver
    dealt = in_blocks(keys.hint("merge").join(counts, "key"), F.col("n"), F.xxhash64("fp"))
    return dealt.select("key", "bi", "bj", "blk", "fp", "rid").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component) of every distinct fingerprint of ``fps(id, fp)``: the least id of what links reach."""
    reps = written(fps.groupBy("fp").agg(F.min("id").alias("rid")).where("rid is not null"), "reps")
    found = components(dealt_keys(reps).mapInArrow(group_edges, "u long, v long"))
    return reps.hint("merge").join(found, reps.rid == found.id, "left").select("fp", F.coalesce("component", "rid").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Per row of ``df``: id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like others. Rows with one fingerprint are one class,
    so copies are never compared. Rows without id keep null ids and don't name a component (null if none of
    their fingerprint's rows has an id). Repeated rows each get a row. An empty table gives none.
    """
    fps = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    of = classes(fps)
    return fps.join(of, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the text's word shingles, ascending; fewer words than that make one shingle, none make none."""
    return shingles_of(words_in(text), words)


def shingles_of(parts: list[bytes], words: int) -> np.ndarray:
    of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([of(b" ".join(parts), 42)] if parts else [], np.uint64)
    return np.unique(np.array([of(b" ".join(parts[i : i + words]), 42) for i in range(len(parts) - words + 1)], np.uint64))


def common_shingles(df: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the shingles that a sixteenth of the texts has at least three times, the commonest
    HOT_LISTED. They only order shingles: whatever they are, no pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    part = df.select(F.col(f"`{text_col}`").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0)
    top = part.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(HOT_LISTED).toArrow()
    hashes, counts = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(own: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest n - ceil(0.8 n) + 1 of a set's n shingles: sets of likeness 0.8 or more share one of them, as all
    are ordered alike."""
    if not len(own):
        return own
    often = np.zeros(len(own), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        often = np.where(hot[at] == own, counts[at], 0)
    need = -(-LIKE[0] * len(own) // LIKE[1])
    return own[np.lexsort((own, often))[: len(own) - need + 1]]


def may_be_like(n, pos, other_n, other_pos):
    """Whether sets of n shingles that have a key at ``pos`` of their order can have likeness 0.8 or more, if it is the first
    they share: all they share is from there on. Of likely pairs that holds at their first key, so none is lost. For columns and arrays."""
    num, den = LIKE
    # 4 / 5 of the union is 4 / 9 of both sizes
    enough, sizes = (n + other_n) * num, num + den
    return ((n - pos) * sizes >= enough) & ((other_n - other_pos) * sizes >= enough) & (n * den >= other_n * num) & (other_n * den >= n * num)


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, rid, n, pos) sorted by key and pos those that may be like another of their key by size and place, with
    the key's number of such rows and its first: the one with the fewest rarer shingles, which is like most others."""
    num, den = LIKE
    kept: list[np.ndarray] | None = None

    def starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        return start, np.diff(np.concatenate((start, [len(key)])))

    def several(cols: list[np.ndarray]) -> list[np.ndarray]:
        size = starts(cols[0])[1] if len(cols[0]) else np.zeros(0, np.int64)
        return [x[np.repeat(size > 1, size)] for x in cols]

    def placed(cols: list[np.ndarray]) -> list[np.ndarray]:
        """Without rows that are too far on even for the key's least set that is large enough for them."""
        key, _, n, pos = cols
        if not len(key):
            return cols
        start, size = starts(key)
        group = np.repeat(np.arange(len(start)), size) * (int(n.max()) + 1)
        sizes = np.sort(group + n)
        least = sizes[np.searchsorted(sizes, group - -num * n // den)] - group
        return [x[(n - pos) * (num + den) >= (n + least) * num] for x in cols]

    def groups(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, rid, n, pos = several(placed(several(cols)))
        start, size = starts(key) if len(key) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        head, rows = np.repeat(start, size), np.repeat(size, size)
        out = [key, rid, n, pos, rows, rid[head], n[head], pos[head]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["key", "rid", "n", "pos", "size", "first", "first_n", "first_pos"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        kept = [c[last:] for c in cols]
        if last:
            yield groups([c[:last] for c in cols])
    if kept is not None:
        yield groups(kept)


def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of each (key, bi, bj) whose sizes and places allow likeness 0.8, of different components, neither the key's
    first. Rows of the commonest component are met with the others only."""
    names = ("key", "bi", "bj", "blk", "rid", "n", "pos", "component", "first")
    kept: list[np.ndarray] | None = None

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, bi, bj, blk, rid, n, pos, component, first = cols
        change = np.flatnonzero((np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
        for a, b in zip(np.concatenate(([0], change)), np.concatenate((change, [len(key)])), strict=True):
            r, m, p, c, k = (x[a:b][rid[a:b] != first[a:b]] for x in (rid, n, pos, component, blk))
            if not len(r):
                continue
            which, count = np.unique(c, return_counts=True)
            most = c == which[np.argmax(count)]
            others, rows = np.flatnonzero(~most), np.arange(len(r))
            for i in range(0, len(others), 256):
                left, right = np.broadcast_arrays(others[i : i + 256, None], rows[None, :])
                keep = (c[left] != c[right]) & (most[right] | (left < right))
                if bi[a] != bj[a]:
                    keep &= k[left] != k[right]
                left, right = left[keep], right[keep]
                keep = may_be_like(m[left], p[left], m[right], p[right])
                if keep.any():
                    x, y = r[left[keep]], r[right[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        kept = [c[last:] for c in cols]
        if last:
            yield from pairs([c[:last] for c in cols])
    if kept is not None:
        yield from pairs(kept)


def collected(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def alike(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) of ids of ``texts(id, text)`` whose sets of shingles have Jaccard likeness 0.8 or more, exactly.

    First 16 bits of each hash are met: what they have in common, and what either set loses by them, bounds from above
    what the sets share. Whole hashes are made of texts of pairs that pass, and compared. What was written between is
    removed, a step's before the next one's is written.
    """
    spark, folder = pairs.sparkSession, new_folder(pairs.sparkSession, "alike")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def met(pairs: DataFrame, name: str, run, kind: str) -> DataFrame:
        """The pairs with both texts' sets as ``run`` makes them, (n, own) of each end."""
        # ids are written and counted: up to BROADCAST_IDS go to the texts, beyond that both are shuffled
        ids = kept(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), f"{name}-ids")
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        sets = kept(texts.join(few, "id", "left_semi").mapInArrow(run, f"id long, n long, own array<{kind}>"), name)
        for end in ("u", "v"):
            pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"), F.col("own").alias(f"{end}_own")), end)
        return pairs.withColumn("common", F.size(F.array_intersect("u_own", "v_own")))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            own = pa.array([np.unique((s & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)) for s in sets], pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), own], ["id", "n", "own"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            own = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), own], ["id", "n", "own"])

    num, den = LIKE
    pairs = kept(pairs.distinct(), "pairs")
    most = F.col("common") + F.least(F.col("u_n") - F.size("u_own"), F.col("v_n") - F.size("v_own"))
    enough = (F.col("u_n") + F.col("v_n")) * num
    close = kept(met(pairs, "low", low, "short").where(most * (num + den) >= enough).select("u", "v"), "close")
    for name in ("low", "low-ids", "pairs"):
        remove(spark, f"{folder}/{name}")
    collected(spark)
    out = written(met(close, "whole", whole, "long").where(F.col("common") * (num + den) >= enough).select("u", "v"), "alike")
    remove(spark, folder)
    return out


def simhash_links(reps: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs (u, v) of ids of ``reps(rid, fp)`` whose texts have likeness 0.8 or more, exactly: of fingerprints that differ in
    at most 4 bits a spanning forest of each key's links, and the first row of each fingerprint with the others."""
    firsts = written(reps.groupBy("fp").agg(F.min("rid").alias("rid")), "firsts")
    same = reps.hint("merge").join(firsts.withColumnRenamed("rid", "u"), "fp").where("rid <> u").select("u", F.col("rid").alias("v"))
    found = dealt_keys(firsts).mapInArrow(lambda batches: group_edges(batches, own=True), "u long, v long")
    return alike(same.union(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))), texts, words)


def apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) whose ends aren't in one component of ``part(id, component)``."""
    pairs = pairs.distinct()
    for end in ("u", "v"):
        pairs = pairs.hint("merge").join(part.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c")), end, "left")
    return pairs.where(F.coalesce("u_c", "u") != F.coalesce("v_c", "v")).select("u", "v")


def like_classes(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, component) of rows with an id: the least id of what pairs of likeness 0.8 or more reach.

    Texts with one set of shingles are one class. Of the others SimHash links what its bits tell, checked exactly; and every
    pair of that likeness shares a key of ``prefix``, the first of which is near enough to the start of both (may_be_like).
    Of what is in different components still, the row with each key nearest to its start is compared with the key's others;
    then all.
    """
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    hot, counts = common_shingles(texts, "text", words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            parts = [words_in(t) for t in batch.column(1).to_pylist()]
            fps = np.array([word_fingerprint(p) for p in parts], np.uint64).view(np.int64)
            sets = [shingles_of(p, words) for p in parts]
            digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            keys = [prefix(s, hot, counts).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "fp", "n", "keys"])

    spark, folder = df.sparkSession, new_folder(df.sparkSession, "shingles")
    own = texts.mapInArrow(run, "id long, digest binary, fp long, n long, keys array<long>")
    own.write.parquet(folder)
    own = spark.read.schema(own.schema).parquet(folder)
    # one set of shingles has one set of words, so one fingerprint
    of = written(own.groupBy("digest").agg(F.min("id").alias("rid"), F.min("fp").alias("fp")), "reps")
    # a class's keys are those of its representative; a repeated id's further rows with the set repeat them
    reps = own.join(of.select("digest", "rid"), "digest").where("id = rid").select(F.posexplode("keys").alias("pos", "key"), "rid", "n").select("key", "rid", "n", "pos")
    shared = reps.repartition("key").sortWithinPartitions("key", "pos", "rid").mapInArrow(shared_keys, "key long, rid long, n long, pos long, size long, first long, first_n long, first_pos long")
    shared = written(shared, "shared")
    # of the sets only each id's representative is needed from here on
    named = written(own.select("id", "digest").join(of.select("digest", "rid"), "digest").select("id", "rid"), "named")
    del reps, own
    remove(spark, folder)
    collected(spark)
    near = may_be_like(*(F.col(c) for c in ("n", "pos", "first_n", "first_pos")))
    linked = simhash_links(of.select("rid", "fp"), texts, words)
    collected(spark)
    firsts = shared.where((F.col("rid") != F.col("first")) & near).select(F.col("first").alias("u"), F.col("rid").alias("v"))
    known = linked.union(alike(apart(firsts, components(linked)), texts, words))
    collected(spark)
    part = components(known)
    rest = shared.join(part, shared.rid == part.id, "left").withColumn("component", F.coalesce("component", "rid")).drop("id")
    several = rest.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
    dealt = in_blocks(rest.join(several, "key", "left_semi"), F.col("size"), F.xxhash64("rid"))
    dealt = dealt.select("key", "bi", "bj", "blk", "rid", "n", "pos", "component", "first").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = components(known.union(alike(dealt.mapInArrow(open_pairs, "u long, v long"), texts, words)))
    del dealt, several, rest, part
    collected(spark)
    return named.join(found.withColumnRenamed("id", "of"), F.col("rid") == F.col("of"), "left").select("id", F.coalesce("component", "rid").alias("component"))


def keyed(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``df`` with a long that names each row's text: the id, or, where rows of one id have several texts, a hash of the text.

    Such hashes are above 2^62, so that the least of a group is an id if there is one.
    """
    h = f"h_{uuid.uuid4().hex}"
    ids = F.col(f"`{id_col}`").cast("long")
    hashed = df.select(ids.alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h")).where("id is not null")
    several = written(hashed.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select(F.col("id").alias(h)), "several")
    if several.isEmpty():
        return df.withColumn(key, ids)
    own = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), ids).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return df.join(several, ids == F.col(h), "left").withColumn(key, F.when(F.col(h).isNull(), ids).otherwise(own)).drop(h)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """Rows of ``df`` without all but one of each group of near copies: the row with the least id stays.

    Near copies are texts whose sets of word shingles have likeness 0.8 or more, found and compared exactly. Rows of
    one id with different texts are texts of their own. Of repeated rows one stays; rows with a null id stay.
    """
    mine, key = f"mine_{uuid.uuid4().hex}", f"key_{uuid.uuid4().hex}"
    every = keyed(df, id_col, text_col, key)
    ids = like_classes(every, key, text_col, words).where("id = component").select(F.col("id").alias(mine)).distinct()
    named = every.where(F.col(key).isNotNull()).dropDuplicates([key])
    kept = named.join(ids, F.col(key) == F.col(mine)).select(*[F.col(f"`{c}`") for c in df.columns])
    return kept.unionByName(df.where(F.col(f"`{id_col}`").isNull()))
