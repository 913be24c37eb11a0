"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from tessera.llm.common import Cache, held, sliced

#: Entries of the two halves of a worker's word cache; it bounds memory, never the result.
CACHED_WORDS = 200_000
#: Printable ASCII, Latin, Greek and Cyrillic letters and signs, dashes and quotation marks: none is a combining mark.
ALPHABET = (range(0x21, 0x7F), range(0xA1, 0x250), range(0x370, 0x483), range(0x48A, 0x530), range(0x2010, 0x2028), range(0x2030, 0x205F))

#: White space that may stand between pieces of known characters.
SPACES = r" \t\n\r"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges in order of rank, leftmost first among equal ranks.

    ``ranks`` gives (rank, merged id) of a pair. Symbols form a doubly linked list; the queue holds
    (rank, position, left, right). An entry whose pair is no longer at its position is stale and skipped.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    ids = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        found = ranks.get((ids[i], ids[i + 1]))
        if found is not None:
            queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, made = heapq.heappop(queue)
        j = after[i] if ids[i] == left else -1
        if j < 0 or ids[j] != right:
            continue
        ids[i], ids[j] = made, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            found = ranks.get((made, ids[k]))
            if found is not None:
                heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
        h = before[i]
        if h >= 0:
            found = ranks.get((ids[h], made))
            if found is not None:
                heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
    return [x for x in ids if x >= 0]


class WordBpe:
    """A tokenizer file of kind "BPE with word ends": NFC, white space runs to one space, lower case, then
    pieces by pattern, bytes as letters, merges. Special tokens' strings in a text become their ids.

    Merging and decoding are this class's own. The library only normalises and cuts what has characters beyond ALPHABET."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in vocab.items()} | {i: s for s, i in special.items()}
        self.decimals = {i: str(i) for i in self.strings}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        (pattern,) = (x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.known, self.pattern = self.alphabet(pattern)
        self.of_known = re.compile(f"[{''.join(map(re.escape, sorted(self.known)))}{SPACES}]*")
        self.first = {c: vocab.get(c, -1) for c in letters}
        self.last = {c: vocab.get(c + self.end, -1) for c in letters}
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        # pieces as the letters of their bytes, and pieces of known characters as they are
        self.pieces, self.own = Cache(CACHED_WORDS), Cache(CACHED_WORDS)
        self.pieces.make, self.own.make = self.piece, lambda piece: self.piece(self.as_letters(piece))
        self.words = Cache(CACHED_WORDS)
        self.words.make = self.word

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, given as the letters of its bytes; the last byte carries the word end."""
        symbols = [*map(self.first.__getitem__, piece[:-1]), self.last[piece[-1]]]
        return tuple(merge([x for x in symbols if x >= 0], self.ranks))

    def alphabet(self, pattern: str) -> tuple[frozenset[str], re.Pattern]:
        """Characters whose class and lower case the library is asked for once, and the pattern with them as classes.

        Of ALPHABET, which has no characters that compose with others, those that the library keeps but for the lower
        case that Python has too. Python's own tables of classes aren't used: they are of another version of Unicode.
        """
        normal, pieces = self.library.normalizer.normalize_str, lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
        known = [c for c in map(chr, chain(*ALPHABET)) if len(c.lower()) == 1 and normal(c) == c.lower() and c != "Σ" and pieces(c)]
        low = sorted({c.lower() for c in known})
        inner = "".join(re.escape(c) for c in low if pieces(f"a{c}a") == 1)
        single = "".join(re.escape(c) for c in low if pieces(f"a{c}{c}a") == 4)
        return frozenset(known), re.compile(pattern.replace(r"[\p{L}]", f"[{inner}]").replace(r"[\p{N}]", f"[{single}]").replace(r"\p{L}", inner).replace(r"\p{N}", single), re.ASCII)

    def as_letters(self, piece: str) -> str:
        """The letters of a piece's bytes; printable ASCII stands for itself."""
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)

    def own_pieces(self, text: str) -> list[str] | None:
        """Normalised pieces of a text that has known characters and white space only and no special tokens, else None.

        Known characters don't compose and white space parts pieces, so the whole text is cut at once.
        """
        if self.of_known.fullmatch(text) is None or any(s in text for s in self.special):
            return None
        return self.pattern.findall(text.lower())

    def plain(self, text: str) -> Iterator[int]:
        """Ids of a stretch without special tokens, normalised and cut by the library."""
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return chain.from_iterable(self.pieces[p] for p, _ in cut)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a stretch of text without spaces and line feeds; such stretches are independent."""
        pieces = self.own_pieces(word)
        if pieces is not None:
            return tuple(chain.from_iterable(map(self.own.__getitem__, pieces)))
        out: list[int] = []
        for part in self.cut.split(word) if self.cut else [word]:
            out.extend([self.special[part]] if part in self.special else self.plain(part))
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; null is empty."""
        pieces = self.own_pieces(text or "")
        if pieces is not None:
            return list(chain.from_iterable(map(self.own.__getitem__, pieces)))
        return list(chain.from_iterable(map(self.words.__getitem__, text.replace("\n", " ").split(" "))))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings in order; without a decoder the library sets spaces between them."""
        return " ".join(map(self.strings.__getitem__, ids))


def tokenizer(path: str) -> WordBpe:
    return held(f"bpe {path}", lambda: WordBpe(path))


def with_tokens(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """All rows and columns of ``df`` with the text's ids (array<int>) and the decoded text beside them.

    Null texts count as empty: no ids, an empty decoded text. Columns named like the new ones are replaced.
    Repeated rows, further columns and empty tables pass through.
    """
    kept = [c for c in df.columns if c not in (ids_col, decoded_col)]
    rest = df.select(*[df[f"`{c}`"] for c in kept])
    schema = rest.select("*").schema.add(ids_col, ArrayType(IntegerType())).add(decoded_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in sliced(batches):
            ids = [bpe.encode(t) for t in batch.column(kept.index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], [*kept, ids_col, decoded_col])

    return rest.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, SHA-256 of the decimal ids joined by a space and of the decoded text.

    The ids are those of ``with_tokens``; they stay in the worker, only the digests leave it. Null texts count as
    empty; repeated rows each get a row, an empty table gives none, further columns don't matter.
    """
    schema = df.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        name = bpe.decimals.__getitem__
        for batch in sliced(batches):
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
