"""Token-id output: shards of documents' ids, compressed by a Re-Pair grammar.

A shard file holds, all little-endian:

    magic "TRP1", six uint32: documents, ids before compression, symbols after it, rules, terminals, rounds
    doc_id      int64 x documents, ascending
    ends        uint32 x documents: ids up to the end of the document
    symbol_ends uint32 x documents: symbols up to the end of the document
    rules       uint32 x 2 x rules: rule r stands for the pair (left, right); its symbol is terminals + r
    lengths     uint32 x rules: ids that a rule expands to
    symbols     uint32 x symbols
    crc32       uint32 of all before

No rule crosses the end of a document, so a document is read by expanding its own symbols alone; lengths let
a reader skip to an id within it.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import WordBpe
from tessera.llm.common import Cache, file_system, held, new_folder, sliced, write_file, written

MAGIC = b"TRP1"
#: Ids of a shard (a longer document makes a longer shard), pairs replaced a round, and how often a pair occurs
#: at least to get a rule.
SHARD_IDS, PAIRS_A_ROUND, LEAST_COUNT = 2_000_000, 4096, 8
CACHED_WORDS, CACHED_PIECES, MOST_READERS = 250_000, 250_000, 10_000
#: Ids of all rules that are expanded beside each other at most; of longer ones symbols are expanded step by step.
POOL_IDS = 16_000_000
#: The id under which rows without one are filed, first of all.
NO_ID = -(1 << 63)


class LibraryIds(WordBpe):
    """Ids by the tokenizers library, as little-endian uint32 in bytes, kept by piece and word.

    Texts of known characters are cut into pieces at once, and only pieces not met yet go to the library's model. Of
    other texts the stretches between spaces, which are independent, are encoded one by one, by the library alone where
    they hold other characters or special tokens.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.library.model
        self.own, self.words = Cache(CACHED_PIECES), Cache(CACHED_WORDS)
        self.own.make, self.words.make = self.piece_bytes, self.word_bytes

    def piece_bytes(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(self.as_letters(piece))]).tobytes()

    def word_bytes(self, word: str) -> bytes:
        pieces = self.own_pieces(word)
        if pieces is None:
            return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.own.__getitem__, pieces))

    def bytes_of(self, text: str) -> bytes:
        """Ids of a whole text."""
        pieces = self.own_pieces(text)
        if pieces is None:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.own.__getitem__, pieces))


def library(path: str) -> LibraryIds:
    return held(f"library {path}", lambda: LibraryIds(path))


def frequent_pairs(symbols: np.ndarray, places: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that begin at ``places``: (codes left << 32 | right of those to replace, their places ascending, the
    number of each place's pair, places of all pairs that occur ``least`` times or more in any order).

    Pairs are sorted together with their places in one word of 64 bits where that holds them, else by their order.
    """
    wide, far = np.uint64(int(symbols.max()).bit_length()), np.uint64(len(symbols).bit_length())
    low = (np.uint64(1) << wide) - np.uint64(1)
    code = symbols[places].astype(np.uint64) << wide | symbols[places + 1]
    if 2 * int(wide) + int(far) <= 64:
        line = np.sort(code << far | places.astype(np.uint64))
        code, where = line >> far, (line & ((np.uint64(1) << far) - np.uint64(1))).astype(np.int64)
    else:
        order = np.argsort(code, kind="stable")
        code, where = code[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(code)))
    frequent = counts >= least
    # ties at the limit are all taken, so that the choice depends on counts alone
    limit = least if frequent.sum() <= most else np.partition(counts[frequent], -most)[-most]
    chosen = counts >= limit
    at, number = where[np.repeat(chosen, counts)], np.repeat(np.arange(int(chosen.sum())), counts[chosen])
    order = np.sort(at.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
    at, number = (order >> np.uint64(32)).astype(np.int64), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pairs = code[first[chosen]]
    return (pairs >> wide) << np.uint64(32) | pairs & low, at, number, where[np.repeat(frequent, counts)]


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, symbol ends of documents, rules, lengths, rounds): frequent pairs become nonterminals, again and again
    until no pair within a document occurs LEAST_COUNT times.

    A round replaces a set of pairs at once: where their places overlap, the first in reading order wins. What is
    counted again are pairs that were frequent, and those with a new symbol; all others can't become so.
    """
    symbols, doc_ends = ids.astype(np.uint32), ends.astype(np.int64)
    rules: list[np.ndarray] = []
    base, length_of = terminals, np.ones(terminals, np.uint32)
    open_at = np.ones(len(symbols), bool)
    while len(symbols) > 1:
        open_at[-1] = False
        open_at[doc_ends[doc_ends > 0] - 1] = False
        pairs, at, number, still = frequent_pairs(symbols, np.flatnonzero(open_at), PAIRS_A_ROUND, LEAST_COUNT)
        if not len(pairs):
            break
        # of a run of places next to each other every other one is taken
        starts = np.concatenate(([True], np.diff(at) > 1))
        first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - first) % 2 == 0
        places, number = at[taken], number[taken]
        # pairs that overlaps left without a place get no rule yet
        used = np.bincount(number, minlength=len(pairs)) > 0
        pairs, number = pairs[used], (np.cumsum(used) - 1)[number]
        new = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rules.append(np.stack(new, axis=1))
        length_of = np.concatenate((length_of, length_of[new[0]] + length_of[new[1]]))
        symbols = symbols.copy()
        symbols[places] = base + number
        base += len(pairs)
        open_at = np.zeros(len(symbols), bool)
        open_at[still] = open_at[places] = True
        # a pair that begins before a new symbol is new, too
        left = np.ones(len(symbols), bool)
        left[places + 1] = False
        doc_ends = doc_ends - np.searchsorted(places + 1, doc_ends, side="left")
        symbols, open_at = symbols[left], open_at[left]
        fresh = np.flatnonzero(symbols >= base - len(pairs))
        open_at[np.maximum(fresh - 1, 0)] = True
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return symbols, doc_ends, made, length_of[terminals:], len(rules)


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for: every nonterminal is replaced by its pair until none is left."""
    while len(symbols) and (symbols >= terminals).any():
        inner = symbols >= terminals
        at = np.arange(len(symbols)) + np.concatenate(([0], np.cumsum(inner)[:-1]))
        out = np.empty(len(symbols) + int(inner.sum()), np.uint32)
        pairs = rules[symbols[inner] - terminals]
        out[at[~inner]] = symbols[~inner]
        out[at[inner]], out[at[inner] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols


def pool_of(rules: np.ndarray, lengths: np.ndarray, begins: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of all rules side by side; rules that need none of each other are copied together from those before."""
    pool, deepest, a = np.empty(int(lengths.sum()), np.uint32), rules.max(axis=1), 0
    while a < len(rules):
        later = deepest[a:] >= terminals + a
        b = a + int(np.argmax(later)) if later.any() else len(rules)
        to = begins[a:b]
        for symbols in rules[a:b].T.astype(np.int64):
            rule = np.maximum(symbols - terminals, 0)
            sizes = np.where(symbols < terminals, 1, lengths[rule])
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids = pool[np.repeat(begins[rule], sizes) + step]
            pool[np.repeat(to, sizes) + step] = np.where(np.repeat(symbols < terminals, sizes), np.repeat(symbols, sizes), ids)
            to = to + sizes
        a = b
    return pool


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """As ``expand``, for many symbols: every rule is expanded once, then copied to its places."""
    if not len(rules):
        return symbols
    if lengths.sum(dtype=np.int64) > POOL_IDS:
        return expand(symbols, rules, terminals)
    begins = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))[:-1]))
    pool = pool_of(rules, lengths.astype(np.int64), begins, terminals)
    rule = symbols.astype(np.int64) - terminals
    inner = rule >= 0
    sizes = np.ones(len(symbols), np.int64)
    sizes[inner] = lengths[rule[inner]]
    ends = np.cumsum(sizes)
    out = np.repeat(symbols, sizes)
    # where an id stands in the pool, less where it stands in the result
    shift = np.full(len(symbols), -1, np.int64)
    shift[inner] = begins[rule[inner]] - (ends - sizes)[inner]
    at = np.flatnonzero(out >= terminals)
    out[at] = pool[at + np.repeat(shift, sizes)[at]]
    return out


def shard_bytes(doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray, terminals: int) -> list[bytes]:
    symbols, symbol_ends, rules, lengths, rounds = compress(ids, ends, terminals)
    parts = [MAGIC + struct.pack("<6I", len(doc_ids), len(ids), len(symbols), len(rules), terminals, rounds)]
    parts += [x.astype(t).tobytes() for x, t in ((doc_ids, "<i8"), (ends, "<u4"), (symbol_ends, "<u4"), (rules, "<u4"), (lengths, "<u4"), (symbols, "<u4"))]
    crc = 0
    for p in parts:
        crc = zlib.crc32(p, crc)
    return [*parts, struct.pack("<I", crc)]


class Shard:
    """Random access to the documents of a shard file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole shard")
        n, self.n_ids, m, r, self.terminals, _ = struct.unpack("<6I", data[4:28])
        at = 28
        out = []
        for count, kind in ((n, "<i8"), (n, "<u4"), (n, "<u4"), (2 * r, "<u4"), (r, "<u4"), (m, "<u4")):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        self.doc_ids, self.ends, self.symbol_ends, rules, self.lengths, self.symbols = out
        self.rules = rules.reshape(-1, 2)

    def document(self, k: int) -> np.ndarray:
        """All ids of the k-th document."""
        return expand(self.symbols[int(self.symbol_ends[k - 1]) if k else 0 : int(self.symbol_ends[k])], self.rules, self.terminals)

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start:stop of the k-th document; only the symbols that cover them are expanded."""
        own = self.symbols[int(self.symbol_ends[k - 1]) if k else 0 : int(self.symbol_ends[k])]
        sizes = np.where(own >= self.terminals, self.lengths[np.maximum(own, self.terminals).astype(np.int64) - self.terminals] if len(self.lengths) else 1, 1)
        upto = np.cumsum(sizes)
        a, b = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, stop, "left")) + 1
        before = int(upto[a - 1]) if a else 0
        return expand(own[a:b], self.rules, self.terminals)[start - before : stop - before]


def write_shards(df: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, terminals: int = 1 << 17) -> DataFrame:
    """Encode whole texts, deal them in ranges of the id and write shard files; one row a file.

    Rows: part, shard (order of the files), path, n_docs, n_ids. Rows without an id come first, filed under
    NO_ID; null texts are empty; rows with equal ids stand side by side, ordered by a hash of their text, which also
    parts the ranges: many rows of one id, or without id, are dealt to several tasks.
    """
    ranged = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, ids_of = TaskContext.get().partitionId(), 0, library(path)
        doc_ids: list[int] = []
        made: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, size, doc_ids, made
            ends = np.cumsum([len(x) // 4 for x in made])
            name = write_file(f"{folder}/part-{part:06d}-{shard:06d}", ".trp", shard_bytes(np.array(doc_ids, np.int64), np.frombuffer(b"".join(made), "<u4"), ends, terminals))
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": name, "n_docs": len(doc_ids), "n_ids": int(ends[-1])}], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            shard, size, doc_ids, made = shard + 1, 0, [], []
            return row

        for batch in sliced(batches, 500):
            for doc_id, data in zip(batch.column(0).to_pylist(), map(ids_of.bytes_of, batch.column(1).to_pylist()), strict=True):
                made.append(data + end)
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                size += len(made[-1]) // 4
                if size >= SHARD_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    return ranged.mapInArrow(run, "part int, shard int, path string, n_docs long, n_ids long")


def with_starts(shards: DataFrame) -> DataFrame:
    """Shards with ``start``, the ids of all shards before: sums by part, then within a part."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition that wrote
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("p", F.coalesce(F.sum("n").over(before(Window.partitionBy(F.lit(1)).orderBy("part"))), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    return shards.withColumn("w", within).join(parts.select("part", "p"), "part").select(*shards.columns, (F.col("w") + F.col("p")).alias("start"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # about a task for each file, up to a bound; a count by number isn't merged again as small partitions would be
    spread = with_starts(shards).select("path", "start").repartitionByRange(max(1, min(MOST_READERS, shards.count())), F.col("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = file_system(name)
                with system.open_input_stream(at, compression=None) as f:
                    shard = Shard(f.read())
                # all symbols are expanded at once, then cut by the documents' ends
                every = expand_all(shard.symbols, shard.rules, shard.lengths, shard.terminals).astype("<u4", copy=False)
                ends = shard.ends.astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(every[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(starts + start), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts to shard files in the shared folder, then read each document back from them."""
    folder = new_folder(df.sparkSession, "ids")
    return read_shards(written(write_shards(df, path, folder, id_col, text_col), "shards"))
