"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

Two words are as similar as the character subsequences they share: all subsequences
of four characters within a span of SPAN, each weighted by DECAY for every character that it
spans. Inserted or dropped characters weaken only a few of them. Words are mapped to their
kernel values with landmark words (Nystrom), a squared-hinge SVM separates words
that make a text toxic from others, and a text is judged by its most toxic words.

Labels belong to texts, so training alternates: take the highest-scoring words of each
toxic text as positives, and words of clean texts as negatives, then fit again. As the
kernel is a product of explicit subsequence weights, the fitted machine is one weight for each
subsequence; executors get that array (a fixed 4 MB) and nothing else.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import lean, table

SPAN, DECAY = 7, 0.7
CODES = 1 << 20  # subsequences are hashed to so many codes
LANDMARKS, ROUNDS, PER_TEXT, TOP, LEAST = 256, 3, 4, 3, -3.0
#: Bounds of the training sample: labelled texts of each kind, distinct words of a text.
TOXIC_TEXTS, CLEAN_TEXTS, TEXT_WORDS = 800, 1600, 1000
THRESHOLD = 0.7
PIECE, CACHE_WORDS = 24, 200_000
EDGES = ".,;:!?\"'()[]{}<>*_~-|/\\…«»“”"
_GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def _classes() -> np.ndarray:
    """Character classes 1 to 63: letters without their accents, digits, word start and end, the rest."""
    out = np.zeros(0x250, np.uint8)
    for cp in range(0x250):
        base = unicodedata.normalize("NFKD", chr(cp))[:1].lower()
        if "a" <= base <= "z" and ord(chr(cp)) < 0x80:
            out[cp] = ord(base) - 96
        elif "0" <= base <= "9":
            out[cp] = ord(base) - 48 + 27
        else:
            out[cp] = 39 + cp % 25
    out[ord("^")], out[ord("$")] = 37, 38
    return out


_CLASS = _classes()


def pieces(word: str) -> list[str]:
    """A word without punctuation at its ends; long ones as overlapping pieces."""
    word = word.strip(EDGES)
    if len(word) <= PIECE:
        return [word] if len(word) > 1 else []
    return [word[a : a + PIECE] for a in range(0, len(word) - PIECE // 2, PIECE // 2)]


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words; single characters in a row also count joined, as a gapped word."""
    tokens = (text or "").lower().split()
    found = set(tokens)
    run: list[str] = []
    if sum(len(x) == 1 for x in tokens) >= 3:
        for token in [*tokens, "--"]:
            if len(token) == 1:
                run.append(token)
            else:
                if len(run) >= 3:
                    found.add("".join(run))
                run = []
    return found


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes of all words in a row, the word of each, and each word's kernel length."""
    text = "".join(f"^{w}$" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    cls = np.where(cp < 0x250, _CLASS[np.minimum(cp, 0x24F)], (39 + cp % 25).astype(np.uint8)).astype(np.int64)
    n = np.array([len(w) + 2 for w in words])
    spans = np.array([g[-1] for g in _GAPS])
    length = np.sqrt((np.maximum(n[:, None] - spans[None, :], 0) * DECAY ** (2 * spans + 2)[None, :]).sum(axis=1))
    return cls, np.repeat(np.arange(len(words)), n), np.maximum(length, 1e-9)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of the subsequences, in order of words; weights are over the kernel length."""
    cls, word, length = _places(words)
    found = []
    for a, b, c in _GAPS:
        n = max(len(word) - c, 0)
        inside = word[:n] == word[c : c + n]
        w = word[:n][inside]
        found.append((w, _codes(cls, a, b, c)[inside], DECAY ** (c + 1) / length[w]))
    word, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(word, kind="stable")
    return word[order], code[order], weight[order]


def _codes(cls: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    n = max(len(cls) - c, 0)
    code = (cls[:n] << 18) | (cls[a : a + n] << 12) | (cls[b : b + n] << 6) | cls[c : c + n]
    return (code * 0x9E3779B1 >> 7) & (CODES - 1)


def apply_weights(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The product of each word's subsequence weights with ``weights`` (one for each code)."""
    out = np.zeros(len(words))
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        cls, word, length = _places(part)
        total = np.zeros(len(word))
        for a, b, c in _GAPS:
            n = max(len(word) - c, 0)
            total[:n] += DECAY ** (c + 1) * weights[_codes(cls, a, b, c)] * (word[:n] == word[c : c + n])
        out[at : at + len(part)] = np.bincount(word, total, minlength=len(part)) / length
    return out


@dataclass
class Machine:
    weights: np.ndarray  # float32 for each code
    bias: float
    text: np.ndarray  # logistic weights of a text's features

    def margins(self, words: list[str]) -> np.ndarray:
        """The largest margin of each word's pieces; LEAST for words without any."""
        parts = [pieces(w) for w in words]
        flat = [p for ps in parts for p in ps]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        out = np.full(len(words), LEAST)
        np.maximum.at(out, owner, apply_weights(flat, self.weights) + self.bias)
        return out

    def score(self, margins: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(margins) @ self.text, -30, 30))))


def features(margins: list[float]) -> np.ndarray:
    """Of a text: its highest word margins, how many are high, its size, and 1."""
    top = [min(max(x, LEAST), 1.5) for x in heapq.nlargest(TOP, margins)]
    top += [LEAST] * (TOP - len(top))
    high = sum(x > -0.3 for x in margins)
    return np.array([*top, np.log1p(high), high / np.sqrt(len(margins) + 10), np.log(len(margins) + 10), 1.0])


def nystrom(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column of each code that landmarks use (else -1), their rows, and the map from kernel values to features."""
    word, code, weight = subsequences(landmarks)
    used = np.unique(code)
    column = np.full(CODES, -1, np.int32)
    column[used] = np.arange(len(used))
    rows = np.zeros((len(landmarks), len(used)), np.float32)
    np.add.at(rows, (word, column[code]), weight)
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    return column, rows, vectors[:, kept] / np.sqrt(values[kept])


def kernel(words: list[str], column: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), len(rows)), np.float64)
    columns = np.ascontiguousarray(rows.T)
    for at in range(0, len(words), 500):
        part = words[at : at + 500]
        word, code, weight = subsequences(part)
        use = column[code] >= 0
        word, code, weight = word[use], code[use], weight[use]
        if len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sums = np.add.reduceat(columns[column[code]] * weight[:, None].astype(np.float32), first, axis=0)
            out[at + word[first]] = sums
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps on the support vectors (the bias isn't penalised)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active][:, None]
        new = np.linalg.solve(penalty + xa.T @ x[active], xa.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def train(texts: list[tuple[int, list[str]]]) -> Machine | None:
    """The machine for (label, distinct words) of each text; None unless both labels occur twice.

    Features of texts for the logistic step come from machines fitted on the other half.
    """
    texts = [(label, ws) for label, ws in texts if any(pieces(w) for w in ws)]
    kinds = [[t for t in texts if t[0] == label] for label in (0, 1)]
    if min(map(len, kinds)) < 2:
        return None
    halves = [[*kinds[0][i::2], *kinds[1][i::2]] for i in (0, 1)]
    x, y = [], []
    for i in (0, 1):
        machine = fit_words(halves[i])
        for label, ws in halves[1 - i]:
            x.append(features(machine.margins(ws).tolist()))
            y.append(float(label))
    machine = fit_words(texts)
    machine.text = logistic(np.array(x), np.array(y))
    return machine


def fit_words(texts: list[tuple[int, list[str]]]) -> Machine:
    toxic, clean = ([sorted({p for w in ws for p in pieces(w)}) for label, ws in texts if label == k] for k in (1, 0))
    negatives = sorted({w for t in clean for w in t})
    known = set(negatives)
    bags = [sorted(set(t) - known) or t for t in toxic]

    def seen(groups: list[list[str]]) -> np.ndarray:
        share = np.zeros(CODES)
        for group in groups:
            share[np.unique(subsequences(group)[1])] += 1
        return share

    t, c = seen(toxic), seen(clean)
    weights = np.log((t + 0.5) / (len(toxic) + 1)) - np.log((c + 0.5) / (len(clean) + 1))
    weights[t + c < 3] = 0
    rng = np.random.default_rng(3)
    some = [negatives[i] for i in rng.permutation(len(negatives))[:8_000]]
    bias = 0.0
    for _ in range(ROUNDS):
        positives: dict[str, int] = {}
        scores = apply_weights([w for bag in bags for w in bag], weights)
        at = 0
        for bag in bags:
            for i in np.argsort(-scores[at : at + len(bag)], kind="stable")[:PER_TEXT]:
                positives[bag[i]] = positives.get(bag[i], 0) + 1
            at += len(bag)
        found = sorted(positives, key=lambda w: (-positives[w], w))
        hard = np.argsort(-apply_weights(negatives, weights), kind="stable")[:2_000]
        against = sorted({*some, *(negatives[i] for i in hard)})
        # landmarks: the most frequent positives, others spread over the rest, and clean words
        half = 3 * LANDMARKS // 4
        rest = found[half // 2 :]
        picked = found[: half // 2] + [rest[i] for i in rng.permutation(len(rest))[: half - half // 2]]
        picked += [against[i] for i in rng.permutation(len(against))[: LANDMARKS - len(picked)]]
        column, rows, to_features = nystrom(picked)
        x = kernel(found + against, column, rows) @ to_features
        y = np.array([1.0] * len(found) + [-1.0] * len(against))
        share = np.array([positives[w] for w in found], float)
        weight = np.concatenate([share / share.sum() * len(against) / 4, np.ones(len(against))])
        w, bias = svm(x, y, weight)
        weights = np.zeros(CODES)
        weights[column >= 0] = rows.T.astype(np.float64) @ (to_features @ w)
    return Machine(weights.astype(np.float32), bias, np.zeros(TOP + 4))


def logistic(x: np.ndarray, label: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (label - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
    return w


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, list[str]]]:
    """Words of a bounded sample of labelled texts outside the held-out third, in hash order."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(8))
    chosen = usable.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_TEXTS).unionByName(
        usable.where("toxic = 0").orderBy(order, "doc_id").limit(CLEAN_TEXTS)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most TOXIC_TEXTS + CLEAN_TEXTS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(words_of(t), key=lambda w: (hash_word(w), w))[:TEXT_WORDS] for t in batch.column("text").to_pylist()]
            words = [[w[:200] for w in ws] for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    rows = texts.mapInArrow(lean(run), texts.select("toxic").schema.add("words", ArrayType(StringType()))).collect()
    return sorted((int(r["toxic"]), list(r["words"])) for r in rows)


def hash_word(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "replace"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) and ``toxic_predicted`` (1 from THRESHOLD on).

    Null and empty texts have no words and score as a text without any toxic word; rows are scored
    one by one, so repeated rows score alike. Without labels of both kinds all
    scores are 0. Columns of ``docs`` stay; those of the two names are replaced.
    """
    machine = train(training_sample(docs, labels))
    kept = [c for c in docs.columns if c not in ("toxic_score", "toxic_predicted")]
    schema = docs.select(*kept).schema.add("toxic_score", "double").add("toxic_predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                scores = []
                for text in part.column("text").to_pylist():
                    words = words_of(text) if machine else set()
                    new = [w for w in words if w not in known]
                    if len(known) + len(new) > CACHE_WORDS:
                        known.clear()
                        new = list(words)
                    known.update(zip(new, machine.margins(new).tolist(), strict=True) if new else ())
                    scores.append(machine.score([known[w] for w in words]) if machine else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in kept),
                        pa.array(scores, pa.float64()),
                        pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    ],
                    names=schema.names,
                )

    return docs.select(*kept).mapInArrow(lean(run), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
