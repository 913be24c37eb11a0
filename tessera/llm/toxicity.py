"""Toxicity by a subsequence string kernel and a support vector machine on Nystrom landmarks.

The kernel compares two words by their common subsequences of 3 and 4 characters (word ends count as
characters) that span at most SPAN characters, each weighted LAMBDA^span and normalised, so a word with gaps
or inserted characters stays close to the word it was made from. Landmarks are words; the machine's features
of a word are its kernel values with them, whitened. As the decision is linear in those values, the sum over
landmarks is taken once: what is stored is one weight for each hashed subsequence, and a word's decision is a
sum over its own subsequences, exactly that of the landmarks.

Labels are those of texts, so words are learned in rounds: words that mark toxic texts of the sample are its
positive cases, words of clean texts its negative ones, and the machine of a round picks those of the next.
A text's score is a logistic function of how many of its words are hits, how strong, and how dense.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sliced

LAMBDA, SPAN, WIDTH = 0.7, 6, 1 << 16
#: Of a longer word each stretch of so many characters counts as a word.
LONG_WORD = 24
#: The sample: at most so many toxic and so many clean texts, those of least hash of their ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 700, 1400
#: Landmarks, negative words a round, rounds, and the machine's cost and epochs.
LANDMARKS, NEGATIVES, ROUNDS, COST, EPOCHS = 300, 4000, 3, 50.0, 40
CACHED_WORDS = 400_000
SIGNS = ".,;:!?\"'()[]{}|*#$%&_-~^`<>/\\"
#: The decision on a stretch of signs alone.
NO_WORD = -2.0
GAPS = [(n, (0, *inner, last)) for n in (3, 4) for last in range(n - 1, SPAN) for inner in combinations(range(1, last), n - 2)]
POWERS = LAMBDA ** np.arange(8.0)


def parts_of(raw: str) -> list[str]:
    """A stretch between white space in lower case without signs at its ends; a long one in overlapping parts."""
    w = raw.lower().strip(SIGNS)
    return [w] if len(w) <= LONG_WORD else [w[i : i + LONG_WORD] for i in range(0, len(w), LONG_WORD - 8)]


def single_runs(raws: list[str], single: np.ndarray) -> list[str]:
    """Words spelled out by three single characters or more, one after another."""
    at = np.flatnonzero(single)
    if len(at) < 3:
        return []
    cuts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return ["".join(raws[i] for i in c) for c in cuts if len(c) >= 3]


def entries(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed subsequences, weights) of words of one length, a row a word, sorted by hash, not added up."""
    size = len(words[0]) + 2
    chars = np.full((len(words), size), 2, np.int64)
    chars[:, -1] = 3
    if size > 2:
        chars[:, 1:-1] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size - 2)
    keys = []
    for n, places in GAPS:
        stop = size - places[-1]
        if stop <= 0:
            continue
        h = np.full((len(words), stop), n, np.int64)
        for p in places:
            h = (h * 1_000_003 + chars[:, p : p + stop]) & 0x7FFFFFFFFFFF
        keys.append(((h ^ (h >> 21)) % WIDTH) * 8 + places[-1] + 1)
    both = np.sort(np.concatenate(keys, axis=1), axis=1)
    return both >> 3, POWERS[both & 7]


def by_length(words: list[str], step: int = 4096) -> Iterator[list[int]]:
    """Indexes of words of one length, at most ``step`` at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or len(words[order[i]]) != len(words[order[start]]) or i - start == step:
            yield order[start:i]
            start = i


def lengths(hashed: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Length of each row's vector, in which equal subsequences add up."""
    first = np.ones(hashed.shape, bool)
    first[:, 1:] = hashed[:, 1:] != hashed[:, :-1]
    at = np.flatnonzero(first)
    sums = np.add.reduceat(weight.ravel(), at)
    return np.sqrt(np.bincount(at // hashed.shape[1], sums * sums, minlength=len(hashed)))


def dense(words: list[str]) -> np.ndarray:
    """Normalised vectors of words, one a row."""
    out = np.zeros((len(words), WIDTH), np.float32)
    for at in by_length(words):
        hashed, weight = entries([words[i] for i in at])
        np.add.at(out, (np.array(at)[:, None], hashed), weight / lengths(hashed, weight)[:, None])
    return out


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words with landmarks given as dense rows."""
    out, columns = np.zeros((len(words), len(landmarks))), np.ascontiguousarray(landmarks.T)
    for at in by_length(words, 256):
        hashed, weight = entries([words[i] for i in at])
        out[at] = np.einsum("ijk,ij->ik", columns[hashed], (weight / lengths(hashed, weight)[:, None]).astype(np.float32))
    return out


@dataclass
class Model:
    weights: np.ndarray  # WIDTH, float32: the machine's weight of each hashed subsequence
    bias: float
    logistic: np.ndarray  # of the text's features

    def decisions(self, words: list[str]) -> np.ndarray:
        """The machine's decision on each word; an empty word is none."""
        out = np.full(len(words), NO_WORD)
        for at in by_length(words):
            if not words[at[0]]:
                continue
            hashed, weight = entries([words[i] for i in at])
            out[at] = (self.weights[hashed] * weight).sum(axis=1) / lengths(hashed, weight) + self.bias
        return out

    def judged(self, raws: list[str]) -> np.ndarray:
        """The highest decision on the parts of each stretch; NaN for single characters."""
        parts = [parts_of(r) for r in raws]
        flat = self.decisions([p for ps in parts for p in ps])
        top = np.maximum.reduceat(flat, np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))) if raws else flat
        return np.where([len(p[0]) == 1 for p in parts], np.nan, top)

    def of_text(self, raws: list[str], got: np.ndarray) -> np.ndarray:
        """Decisions of a text's words, those spelled out included."""
        single = np.isnan(got)
        if not single.any():
            return got
        spelled = [p for r in single_runs(raws, single) for p in parts_of(r)]
        return np.concatenate((got[~single], self.decisions(spelled))) if spelled else got[~single]


def svm(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton's steps on the cases within the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.ones(x1.shape[1])
    ridge[-1] = 1e-3
    for _ in range(EPOCHS):
        inside = y * (x1 @ w) < 1
        c = COST * sample_weight[inside]
        a = (x1[inside] * c[:, None]).T @ x1[inside] + np.diag(ridge)
        new = np.linalg.solve(a, (x1[inside] * c[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def text_features(decisions: np.ndarray) -> np.ndarray:
    """Of the decisions of a text's words: hits, their strength, the strongest, their share, how long the text is."""
    if not len(decisions):
        return np.zeros(5)
    hits = decisions > 0
    n = float(hits.sum())
    return np.array([np.log1p(n), np.log1p(np.clip(decisions, 0, 2).sum()), float(np.clip(decisions.max(), -1, 2)), min(0.2, n / len(decisions)) * 10, float(n >= 2) + float(n >= 3)])


def logistic_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.eye(len(w)) * 0.5
        w = w + np.linalg.solve(h, x1.T @ (y - p) - 0.5 * w)
    return w


def train(samples: list[tuple[str, int]]) -> Model:
    """Learn from (text, toxic); repeated texts count as often as they occur, empty ones have no words. Without texts of
    both labels every text gets the same low score."""
    flat = Model(np.zeros(WIDTH, np.float32), -1.0, np.array([0, 0, 0, 0, 0, -5.0]))
    if len({y for _, y in samples}) < 2:
        return flat
    number: dict[str, int] = {}
    bags = [(np.array([number.setdefault(p, len(number)) for r in t.split() for p in parts_of(r) if len(p) > 1], np.int32), y) for t, y in samples]
    every = list(number)
    n_pos, n_neg = sum(y for _, y in bags), sum(1 - y for _, y in bags)
    pos_n, neg_n = (np.bincount(np.concatenate([np.unique(b) for b, y in bags if y == k]), minlength=len(every)) for k in (1, 0))
    pos, neg = ({every[i]: int(n[i]) for i in np.flatnonzero(n)} for n in (pos_n, neg_n))
    # words are first judged by how much more often they occur in toxic texts than in clean ones
    odds = {w: np.log((n + 0.05) / (n_pos + 0.1)) - np.log((neg.get(w, 0) + 0.5) / (n_neg + 1)) for w, n in pos.items() if n >= 3}
    seeds = sorted((w for w, s in odds.items() if s > 2.0), key=lambda w: (-odds[w] * pos[w], w))[: LANDMARKS * 3]
    if not seeds:
        seeds = sorted(pos, key=lambda w: (-(pos[w] / n_pos - neg.get(w, 0) / n_neg), w))[:20]
    clean = sorted(neg, key=lambda w: (-neg[w], w))
    rng = np.random.default_rng(11)
    cases = clean[:500] + [clean[i] for i in sorted(rng.permutation(len(clean))[:NEGATIVES])]
    model = flat
    for r in range(ROUNDS):
        marks = seeds[: LANDMARKS // 2] + [cases[i] for i in rng.permutation(len(cases))[: LANDMARKS // 2]]
        marks = list(dict.fromkeys(marks))
        land = dense(marks)
        inner = land.astype(np.float64) @ land.T.astype(np.float64)
        values, vectors = np.linalg.eigh(inner)
        keep = values > 1e-6 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        both = seeds + cases
        x = kernel(both, land) @ whiten
        y = np.array([1.0] * len(seeds) + [-1.0] * len(cases))
        # a word of many toxic texts weighs more than one that may be there by chance
        sure = np.array([min(1.0, pos.get(w, 0) / 10) ** 2 for w in seeds])
        balance = np.concatenate((sure * len(cases) / max(1.0, sure.sum()) / 2, np.ones(len(cases))))
        w, b = svm(x, y, balance)
        model = Model((land.T.astype(np.float64) @ (whiten @ w)).astype(np.float32), b, flat.logistic)
        found = model.decisions(every)
        if r == ROUNDS - 1:
            break
        # of the words that the machine takes for hits: those of clean texts are cases against, the rest for
        clean_side = neg_n / n_neg >= pos_n / n_pos
        against = [every[i] for i in np.argsort(-found, kind="stable")[:NEGATIVES] if found[i] > -0.2 and clean_side[i]]
        more = [every[i] for i in np.argsort(-found, kind="stable") if found[i] > 0.3 and neg_n[i] == 0][: LANDMARKS * 3]
        seeds = list(dict.fromkeys(seeds + more))
        taken = set(seeds)
        cases = [w for w in dict.fromkeys(cases + against) if w not in taken]
    labels = np.array([y for _, y in bags], float)
    # the decision from which a word is a hit is the one that tells the sample's texts apart best
    best = None
    for shift in np.arange(-0.8, 0.5, 0.1):
        feats = np.array([text_features(found[b] - shift) for b, _ in bags])
        w = logistic_fit(feats, labels)
        p = 1 / (1 + np.exp(-np.clip(np.hstack([feats, np.ones((len(feats), 1))]) @ w, -30, 30)))
        loss = -np.mean(np.log(np.clip(np.where(labels > 0, p, 1 - p), 1e-9, 1)))
        if best is None or loss < best[0]:
            best = loss, shift, w
    return Model(model.weights, model.bias - best[1], best[2])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a bounded sample of the labelled rows, those of least hash of their ids; labels other than 0 and 1 are left out.

    Ids are ranked first, over the labels alone; then the texts of the sample are fetched. Of rows with equal
    ids the least text counts, and an id labelled both ways counts as toxic.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).withColumn("h", F.xxhash64("id"))
    y = {r["id"]: int(r["y"]) for k, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in known.where(F.col("y") == k).orderBy("h", "id").limit(most).collect()}
    rows = docs.where(F.col(id_col).isin(list(y))).select(id_col, text_col).toPandas() if y else None
    if rows is None or not len(rows):
        return train([])
    rows = rows.sort_values([id_col, text_col]).drop_duplicates(id_col)
    return train([(t or "", y[i]) for i, t in zip(rows[id_col].tolist(), rows[text_col].tolist(), strict=True)])


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score in 0..1. Whole texts count; null and empty ones have no hits and get the score of that.

    Repeated rows each get a row; an empty table gives none; further columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in sliced(batches, 500):
            raws = [(t or "").split() for t in batch.column(1).to_pylist()]
            if len(known) > CACHED_WORDS:
                known = {}
            new = list({r for words in raws for r in words} - known.keys())
            known.update(zip(new, model.judged(new).tolist(), strict=True))
            feats = [text_features(model.of_text(words, np.fromiter(map(known.__getitem__, words), np.float64, len(words)))) for words in raws]
            x = np.hstack([np.array(feats), np.ones((len(feats), 1))])
            p = 1 / (1 + np.exp(-np.clip(x @ model.logistic, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, df.select(id_col).schema.add("score", "double"))
