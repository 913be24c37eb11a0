"""Language identification by a linear-chain conditional random field over the words of a text.

Each word is an item of a chain, labelled with a language; affixes, character n-grams and a lexicon of the
sample's words are its features, transitions between labels are learned. Forward-backward gives every word
a distribution over languages, whose sum over the text names the text's language. Chains are the stretches of
CHAIN words of a text: each takes up where the one before ends with fresh transitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.llm.common import held, sliced

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
LETTER = regex.compile(r"\p{L}")
#: Feature weights are hashed to so many rows. Chains of at most so many words; longer words are cut.
ROWS, CHAIN, LONG_WORD = 1 << 15, 48, 48
#: The most labelled texts that the sample takes and the chains it takes of each, those of least hash, and training.
SAMPLE_TEXTS, SAMPLE_CHAINS, EPOCHS, RATE, DECAY = 800, 6, 6, 0.2, 1e-5
UNKNOWN = "und"
#: ``accepted`` looks at texts of at least so many words. The probability of each word's likeliest language,
#: without the chain, has to be on average so far on the way from chance to certainty.
JUDGED_WORDS, OWN_SHARE = 20, 0.3
CACHED_WORDS = 300_000


def spans_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of letters in order, in code points; longer ones are cut into pieces that overlap by two
    characters, so that no n-gram is lost."""
    spans = [m.span() for m in WORDS.finditer(text)]
    if all(b - a <= LONG_WORD for a, b in spans):
        return spans
    return [(i, min(b, i + LONG_WORD)) for a, b in spans for i in range(a, max(a + 1, b - 2), LONG_WORD - 2)]


def words_of(text: str) -> list[str]:
    """The words at ``spans_of``."""
    words = WORDS.findall(text)
    if all(len(w) <= LONG_WORD for w in words):
        return words
    return [text[a:b] for a, b in spans_of(text)]


def features(words: list[str], lexicon: frozenset[str] | set[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(indexes of words of one length, their rows of the weight table): the word if the lexicon has it, prefixes
    to 3 characters, suffixes to 4, n-grams of 2 and 3 with the word's ends; whatever the case."""
    lower = [w.lower() for w in words]
    order = sorted(range(len(words)), key=lambda i: len(lower[i]))
    start = 0
    for i in range(1, len(order) + 1):
        if i < len(order) and len(lower[order[i]]) == len(lower[order[start]]):
            continue
        at, start = order[start:i], i
        own = [lower[j] for j in at]
        n = len(own[0])
        chars = np.full((len(own), n + 2), 2, np.int64)
        chars[:, -1] = 3
        if n:
            chars[:, 1:-1] = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), n)

        def hashed(kind: int, *columns: np.ndarray) -> np.ndarray:
            h = np.full(columns[0].shape, kind, np.int64)
            for c in columns:
                h = (h * 1_000_003 + c) & 0xFFFFFFFFFFF
            return (h ^ (h >> 17)) % (ROWS - 1) + 1

        whole = hashed(1, *chars.T)
        rows = [np.where([w in lexicon for w in own], whole, ROWS - 1)]
        rows += [hashed(2, *chars[:, 1 : k + 1].T) for k in (1, 2, 3) if n >= k]
        rows += [hashed(3, *chars[:, n + 1 - k : n + 1].T) for k in (1, 2, 3, 4) if n >= k]
        grams = [hashed(4, *[chars[:, j : n + 3 - k + j] for j in range(k)]) for k in (2, 3) if n + 2 >= k]
        yield at, np.concatenate([np.stack(rows, axis=1), *grams], axis=1)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # ROWS x labels, float32; row 0 stays zero
    transitions: np.ndarray  # from x to
    lexicon: set[str]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals chains x words x labels, expected transition counts) of padded chains, longest first."""
    n, t, k = scores.shape
    if not n or not t:
        return np.zeros_like(scores), np.zeros((k, k))
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    active = [int((lengths > i).sum()) for i in range(t)]
    alpha, beta = np.zeros((t, n, k)), np.zeros((t, n, k))
    alpha[0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        m = active[i]
        x = (alpha[i - 1, :m] @ a) * e[:m, i]
        alpha[i, :m] = x / x.sum(axis=1, keepdims=True)
    beta[t - 1, : active[t - 1]] = 1.0
    for i in range(t - 2, -1, -1):
        m, after = active[i], active[i + 1]
        beta[i, :m] = 1.0
        x = (e[:after, i + 1] * beta[i + 1, :after]) @ a.T
        beta[i, :after] = x / x.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    total = marginal.sum(axis=2, keepdims=True)
    marginal = np.divide(marginal, total, out=np.zeros_like(marginal), where=total > 0)
    expected = np.zeros((k, k))
    for i in range(t - 1):
        m = active[i + 1]
        pair = alpha[i, :m, :, None] * a * (e[:m, i + 1] * beta[i + 1, :m])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal.transpose(1, 0, 2), expected


def chains_of(words: list[str]) -> list[list[str]]:
    return [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]


def train(samples: list[tuple[str, str]]) -> Model:
    """Learn from (text, language); every word of a text bears the text's language. Stochastic gradient ascent
    on the chains' log-likelihood with rates adapted to each weight."""
    labels = sorted({lang for _, lang in samples})
    picked: list[tuple[list[str], int]] = []
    for text, lang in samples:
        every = sorted(chains_of(words_of(text)), key=lambda c: crc32(" ".join(c).encode("utf-8", "surrogatepass")))
        picked += [(c, labels.index(lang)) for c in every[:SAMPLE_CHAINS]]
    counts: dict[str, int] = {}
    for words, _ in picked:
        for w in {x.lower() for x in words}:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, n in counts.items() if n >= 3}
    k = len(labels)
    weights, trans = np.zeros((ROWS, k)), np.zeros((k, k))
    squares, t_squares = np.full((ROWS, k), 1e-2), np.full((k, k), 1e-2)
    every_word = list({w for words, _ in picked for w in words})
    rows_of: dict[str, np.ndarray] = {}
    for at, rows in features(every_word, lexicon):
        rows_of.update((every_word[i], r) for i, r in zip(at, rows, strict=True))
    coded = [([rows_of[w] for w in words], y) for words, y in picked]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        mixed = order.permutation(len(coded))
        for start in range(0, len(mixed), 64):
            batch = sorted((coded[i] for i in mixed[start : start + 64]), key=lambda c: -len(c[0]))
            lengths = np.array([len(c[0]) for c in batch])
            t = int(lengths.max())
            flat = np.concatenate([f for c, _ in batch for f in c])
            sizes = np.array([len(f) for c, _ in batch for f in c])
            word = np.repeat(np.arange(len(sizes)), sizes)
            emit = np.zeros((len(sizes), k))
            np.add.at(emit, word, weights[flat])
            at = np.concatenate([np.arange(n) for n in lengths])
            chain = np.repeat(np.arange(len(batch)), lengths)
            scores = np.zeros((len(batch), t, k))
            scores[chain, at] = emit
            marginal, expected = forward_backward(scores, lengths, trans)
            gold = np.array([y for _, y in batch])
            error = -marginal[chain, at]
            error[np.arange(len(chain)), gold[chain]] += 1
            grad = np.zeros((ROWS, k))
            np.add.at(grad, flat, error[word])
            seen = np.unique(flat)
            g = grad[seen] - DECAY * weights[seen]
            squares[seen] += g * g
            weights[seen] += RATE * g / np.sqrt(squares[seen])
            t_grad = -expected
            np.add.at(t_grad, (gold, gold), lengths - 1)
            t_squares += t_grad * t_grad
            trans += RATE * t_grad / np.sqrt(t_squares)
    weights[0] = 0
    return Model(labels, weights.astype(np.float32), trans, lexicon)


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE_TEXTS) -> Model:
    """Train on a bounded sample of the labelled rows: the ``most`` of least hash of their ids, by language evenly.

    Every language has its share, at least one text, so more languages than ``most`` make a larger sample. The ids
    alone are ranked first; then the texts of the sample are fetched.
    """
    ids = labelled.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    n_langs = ids.agg(F.count_distinct("lang")).first()[0]
    if not n_langs:
        return Model([], np.zeros((ROWS, 1), np.float32), np.zeros((1, 1)), set())
    each = max(1, most // n_langs)
    ranked = ids.where("lang is not null").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
    chosen = ranked.where(F.col("k") <= each).collect()
    by_id = {r["id"]: r["lang"] for r in chosen}
    rows = labelled.where(F.col(id_col).isin(list(by_id))).select(id_col, text_col, lang_col).toPandas()
    rows = rows.sort_values([id_col, text_col]).drop_duplicates(id_col)
    return train([(t, lang) for t, lang in zip(rows[text_col], rows[lang_col], strict=True) if t and lang])


class Emissions:
    """Scores of words for each label, a row of a matrix for each word met, as long as the worker lives."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.scores = np.zeros((0, max(1, len(model.labels))), np.float32)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """Scores of all words of the texts in order. A full cache starts anew before the texts are met."""
        if len(self.number) > CACHED_WORDS:
            self.number, self.scores = {}, self.scores[:0]
        new = list({w for words in texts for w in words} - self.number.keys())
        if new:
            fresh = np.zeros((len(new), self.scores.shape[1]), np.float32)
            for at, rows in features(new, self.model.lexicon):
                for i in range(0, len(at), 4096):
                    fresh[at[i : i + 4096]] = self.model.weights[rows[i : i + 4096]].sum(axis=1)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, fresh))
        get = self.number.__getitem__
        return self.scores[np.fromiter((get(w) for words in texts for w in words), np.int64, sum(map(len, texts)))]


def emission_cache(model: Model) -> Emissions:
    return held(f"crf {crc32(model.weights.tobytes())}", lambda: Emissions(model))


def marginals(model: Model, found: list[list[str]], emissions: Emissions) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Forward-backward over the chains of texts' words, longest chains first: (text of each chain, number of its first
    word among all words, marginals chains x words x labels, zero behind a chain's end)."""
    lengths, owner = [], []
    for i, words in enumerate(found):
        for start in range(0, len(words), CHAIN):
            lengths.append(min(CHAIN, len(words) - start))
            owner.append(i)
    if not lengths or not model.labels:
        return
    sizes, own = np.array(lengths), np.array(owner)
    emit = emissions.of(found)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(-sizes, kind="stable")
    for s in range(0, len(order), 4096):
        part = order[s : s + 4096]
        n = sizes[part]
        steps = np.arange(int(n.max()))
        inside = steps[None, :] < n[:, None]
        at = np.where(inside, first[part][:, None] + steps[None, :], 0)
        yield own[part], first[part], forward_backward_marginals(emit[at], n, model.transitions)[0]


def decide(model: Model, texts: list[str | None], emissions: Emissions) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the mean probability of the language over the words."""
    total = np.zeros((len(texts), max(1, len(model.labels))))
    for own, _, marginal in marginals(model, [words_of(t) if t else [] for t in texts], emissions):
        np.add.at(total, own, marginal.sum(axis=1))
    names, scores = [], []
    for i, text in enumerate(texts):
        s = total[i].sum()
        if not text or s <= 0 or not LETTER.search(text):
            names.append(UNKNOWN)
            scores.append(0.0)
        else:
            best = int(np.argmax(total[i]))
            names.append(model.labels[best])
            scores.append(min(1.0, float(total[i, best] / s)))
    return names, scores


def label_words(model: Model, texts: list[str | None], emissions: Emissions) -> list[list[dict]]:
    """For each text its words' start and end in code points, likeliest language and that one's probability."""
    spans = [spans_of(t) if t and model.labels else [] for t in texts]
    n = sum(map(len, spans))
    best, share = np.zeros(n, np.int64), np.zeros(n)
    for _, first, marginal in marginals(model, [[t[a:b] for a, b in own] for t, own in zip(texts, spans, strict=True)], emissions):
        chain, step = np.nonzero(marginal.any(axis=2))
        at = first[chain] + step
        best[at], share[at] = marginal.argmax(axis=2)[chain, step], marginal.max(axis=2)[chain, step]
    each = iter(zip(best.tolist(), share.tolist(), strict=True))
    return [[{"start": a, "end": b, "lang": model.labels[k], "score": min(1.0, p)} for (a, b), (k, p) in zip(own, each)] if own else [] for own in spans]


def supported(model: Model, texts: list[str | None], emissions: Emissions) -> np.ndarray:
    """Whether words by themselves, without their chain, each tell a language well enough; short texts pass.

    Languages may differ from word to word, so texts of several languages pass, too."""
    found = [words_of(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    out = np.ones(len(texts), bool)
    judged = np.flatnonzero(sizes >= JUDGED_WORDS)
    if len(judged) and model.labels:
        own = emissions.of([found[i] for i in judged])
        own = np.exp(own - own.max(axis=1, keepdims=True))
        own /= own.sum(axis=1, keepdims=True)
        starts = np.concatenate(([0], np.cumsum(sizes[judged])[:-1]))
        mean = np.add.reduceat(own.max(axis=1), starts, dtype=np.float64) / sizes[judged]
        chance = 1 / len(model.labels)
        out[judged] = mean >= chance + OWN_SHARE * (1 - chance)
    return out


def forward_backward_marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, None]:
    """Marginals only; words are the leading axis inside, so that every step works on one stretch of memory."""
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    a = np.exp(transitions - transitions.max())
    active = [int((lengths > i).sum()) for i in range(t)]
    alpha = np.zeros((t, n, k))
    alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        m = active[i]
        x = (alpha[i - 1, :m] @ a) * e[i, :m]
        alpha[i, :m] = x / (x @ np.ones((k, 1)))
    beta = np.ones((n, k))
    out = np.zeros((t, n, k))
    for i in range(t - 1, -1, -1):
        m = active[i]
        if i < t - 1 and active[i + 1]:
            after = active[i + 1]
            x = (e[i + 1, :after] * beta[:after]) @ a.T
            beta[:after] = x / (x @ np.ones((k, 1)))
        x = alpha[i, :m] * beta[:m]
        out[i, :m] = x / (x @ np.ones((k, 1)))
    return out.transpose(1, 0, 2), None


def languages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score. Null texts and texts without a letter are ``und`` with score 0.

    Without anything learned every text is ``und``. Repeated rows each get a row; empty tables give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = emission_cache(model)
        for batch in sliced(batches, 500):
            names, scores = decide(model, batch.column(1).to_pylist(), emissions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    schema = df.select(id_col).schema.add("lang_pred", "string").add("score", "double")
    return df.select(id_col, text_col).mapInArrow(run, schema)


def with_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with lang_pred and score beside them; columns of those names are replaced."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    rest = df.select(*[df[f"`{c}`"] for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = emission_cache(model)
        for batch in sliced(batches, 500):
            names, scores = decide(model, batch.column(kept.index(text_col)).to_pylist(), emissions)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return rest.mapInArrow(run, rest.select("*").schema.add("lang_pred", "string").add("score", "double"))


def with_words(df: DataFrame, model: Model, text_col: str = "text", words_col: str = "words") -> DataFrame:
    """All rows and columns of ``df`` with the language of each word: an array of (start, end, lang, score).

    Code-switched texts show where they switch. Words longer than LONG_WORD have an entry for each of their pieces.
    Null texts, texts without a letter and all texts of a model that learned nothing have an empty array. Repeated rows
    each get a row, empty tables give none; a column named like the new one is replaced.
    """
    kept = [c for c in df.columns if c != words_col]
    rest = df.select(*[df[f"`{c}`"] for c in kept])
    word = StructType().add("start", "long").add("end", "long").add("lang", "string").add("score", "double")
    entry = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = emission_cache(model)
        for batch in sliced(batches, 100):
            found = label_words(model, batch.column(kept.index(text_col)).to_pylist(), emissions)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(entry))], [*kept, words_col])

    return rest.mapInArrow(run, rest.select("*").schema.add(words_col, ArrayType(word)))


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose text the model names a language for and ``supported`` lets pass.

    If nothing was learned, those whose text has a letter.
    """
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = emission_cache(model)
        for batch in sliced(batches, 500):
            texts = batch.column(place).to_pylist()
            if model.labels:
                keep = supported(model, texts, emissions) & [name != UNKNOWN for name in decide(model, texts, emissions)[0]]
            else:
                keep = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
