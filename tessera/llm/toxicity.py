"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

Kernel: the gap-weighted subsequence kernel of order P between a unit and a landmark (matches may have gaps; each
character spanned costs a factor DECAY). It is normalised in two ways, and the greater value counts:

* by both self-kernels, for units that have two fifths of the landmark's neighbouring pairs and all but one of its
  distinct characters (values under ``FLOOR`` count as zero);
* in the space of the landmark's alphabet, for units that begin and end as the landmark does and are at most twice as
  long, which leaves room for one character in every gap: there inserted characters cost the gaps that they make and nothing else. That cosine is scaled by the fourth root of the kernel's
  share of the landmark's own (values under ``GAPPED`` count as zero), so an insult stays near itself with a character in every
  gap, whatever pairs are left. By Cauchy-Schwarz the cosine is at most the share, in norm, of the landmark's
  subsequences that the unit can have; units that this bound keeps below GAPPED are not compared, which never changes
  a result.

A sentence is seen through its units: its words, words with inner marks taken out, and runs of three or more single
characters joined. Its similarity to a landmark is that of its nearest unit. The landmarks are words that
mark toxic documents of the training sample, unlike one another, and the clean words that come nearest to them. The
similarities are mapped by K^(-1/2) of the landmarks (Nystrom), and a linear machine with squared hinge loss is
trained on labelled sentences: all of clean documents against those of toxic documents that hold a marking word,
which also come with characters inserted. A document's decision is that of its worst sentence, made a probability by
logistic calibration on documents.

Training takes a sample of at most ``most`` labelled documents of each class, of at most ``most_chars`` characters
each, in the order of a hash of the id. Only ``labels.toxic`` and texts are read: no source, language or id is a
feature. Null text counts as empty; every text, empty ones too, gets a score. Labels that are null or repeated with
both values are not trained on. Without labelled rows of both classes every score is the share of toxic ones, or 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

P, DECAY, FLOOR, GAPPED, WIDTH, STEMS = 3, 0.85, 0.3, 0.75, 24, (4, 5, 6)
#: Units are compared in matrices of these widths.
_WIDTHS = (6, 8, 10, 12, 16, WIDTH)
_SENTENCE, _TOKEN, _SPACED = re.compile(r"[.!?]+\s+|\n+"), re.compile(r"[^\s,;:|()\"“”]+"), re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
_MARKS, _OUTER = re.compile(r"[\W_]+"), ".!?%*$&'#@-_"


def plain(text: str | None) -> str:
    """Lower case, with every run of spaced single characters followed by its joined form."""
    return _SPACED.sub(lambda m: f"{m[0]} {m[0].replace(' ', '')}", (text or "").lower())


def forms(token: str) -> list[str]:
    """A token without outer marks, and without inner ones if it has any."""
    word = token.strip(_OUTER)
    bare = _MARKS.sub("", word)
    return [word] if bare == word or not bare else [word, bare]


def tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text))


def codes(words: list[str], width: int = WIDTH) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def ssk(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Subsequence kernel between rows of s (n, L) and of z (n, Q) or (1, Q), code points, zero is padding."""
    n, q = len(s), z.shape[1]
    step = DECAY ** np.maximum(np.arange(q)[None, :] - np.arange(q)[:, None] + 2, 0) * (np.arange(q)[None, :] >= np.arange(q)[:, None])
    prime = [np.ones((n, q))] + [np.zeros((n, q)) for _ in range(P - 1)]  # K'_l(s[:i], z[:j]) for j = 0..q-1
    total = np.zeros(n)
    for i in range(s.shape[1]):
        match = (s[:, i, None] == z) & (z != 0)
        if not match.any():
            for level in range(1, P):
                prime[level] *= DECAY
            continue
        total += DECAY**2 * (match * prime[P - 1]).sum(axis=1)
        for level in range(P - 1, 0, -1):
            grown = (match * prime[level - 1]) @ step  # over z[: j + 1]
            prime[level] *= DECAY
            prime[level][:, 1:] += grown[:, :-1]
    return total


#: The self-kernel of a string of n characters is at least this: that of n different ones.
_LEAST_NORM = np.array([sum(DECAY ** (2 * (k - i + 1)) for i, _, k in combinations(range(n), P)) * (1 - 1e-9) for n in range(WIDTH + 1)])


class Bound:
    """What a unit must share with a landmark for a cosine of GAPPED in the landmark's alphabet."""

    def __init__(self, landmark: str):
        weights: dict[tuple[str, ...], float] = {}
        for i, j, k in combinations(range(len(landmark)), P):
            u = landmark[i], landmark[j], landmark[k]
            weights[u] = weights.get(u, 0.0) + DECAY ** (k - i + 1)
        self.letters = sorted(set(landmark))
        at = {x: n for n, x in enumerate(self.letters)}
        self.triples = [(at[x], at[y], at[z], np.float32(w * w)) for (x, y, z), w in weights.items()]
        self.least = np.float32(GAPPED**2 * sum(w * w for w in weights.values()) * (1 - 1e-5))

    def rows(self, c: np.ndarray) -> np.ndarray:
        """The units whose order of characters leaves enough of the landmark's subsequences possible: x stands before y
        somewhere only if the first x stands before the last y."""
        there = [c == np.uint32(ord(x)) for x in self.letters]
        head = [np.where(t.any(axis=1), t.argmax(axis=1), c.shape[1]) for t in there]
        tail = [np.where(t.any(axis=1), c.shape[1] - 1 - t[:, ::-1].argmax(axis=1), -1) for t in there]
        total = np.zeros(len(c), np.float32)
        for x, y, z, w in self.triples:
            total += ((head[x] < tail[y]) & (head[y] < tail[z]) & (head[x] < tail[z])) * w
        return np.flatnonzero(total >= self.least)


def masks(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit sets of the characters and of the neighbouring pairs of each row."""
    one, two = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
    bit = lambda x, there: np.where(there, np.uint64(1) << (x % np.uint32(61)).astype(np.uint64), np.uint64(0))
    for i in range(c.shape[1]):
        one |= bit(c[:, i], c[:, i] != 0)
        if i:
            two |= bit(c[:, i - 1] * np.uint32(37) + c[:, i], c[:, i] != 0)
    return one, two


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0
    unseen: float = 0.0

    def __post_init__(self):
        self.codes = [codes([z])[:, : max(len(z), 1)] for z in self.landmarks]
        self.bounds = [Bound(z) for z in self.landmarks]
        self.norms = [float(ssk(c, c)[0]) for c in self.codes]
        self.masks = masks(codes(self.landmarks)) if self.landmarks else (np.zeros(0, np.uint64),) * 2
        self.need = np.maximum(np.bitwise_count(self.masks[0]).astype(np.int64) - 1, 1), -(-2 * np.bitwise_count(self.masks[1]).astype(np.int64) // 5)

    def similarities(self, words: list[str]) -> np.ndarray:
        """(words, landmarks). Longer words are seen in windows of WIDTH that overlap by half."""
        parts, of = [], []
        for k, w in enumerate(words):
            for a in range(0, max(len(w) - WIDTH // 2, 1), WIDTH // 2):
                parts.append(w[a : a + WIDTH])
                of.append(k)
        of, sizes = np.array(of, np.int64), np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        width = np.searchsorted(_WIDTHS, sizes)
        for n, size in enumerate(_WIDTHS):
            mine = np.flatnonzero(width == n)
            if len(mine):
                self._compare(codes([parts[k] for k in mine.tolist()], size), sizes[mine], of[mine], out)
        return out

    def _compare(self, c: np.ndarray, sizes: np.ndarray, of: np.ndarray, out: np.ndarray) -> None:
        (one, two), own = masks(c), np.full(len(c), np.nan)
        ends: dict[tuple[int, int], list[int]] = {}
        for k, pair in enumerate(zip(c[:, 0].tolist(), c[np.arange(len(c)), np.maximum(sizes - 1, 0)].tolist())):
            ends.setdefault(pair, []).append(k)
        for j, z in enumerate(self.codes):
            if not self.norms[j]:
                continue
            rows = np.flatnonzero((np.bitwise_count(one & self.masks[0][j]) >= self.need[0][j]) & (np.bitwise_count(two & self.masks[1][j]) >= self.need[1][j]))
            found = ssk(c[rows], z)
            ok = found >= FLOOR * np.sqrt(_LEAST_NORM[sizes[rows]] * self.norms[j])
            rows, found = rows[ok], found[ok]
            new = rows[np.isnan(own[rows])]
            if len(new):
                own[new] = ssk(c[new], c[new])
            self._keep(out[:, j], of[rows], found / np.sqrt(np.maximum(own[rows], 1e-12) * self.norms[j]), FLOOR)
            rows = np.array(ends.get((int(z[0, 0]), int(z[0, -1])), ()), np.int64)
            rows = rows[sizes[rows] <= 2 * z.shape[1]]
            rows = rows[self.bounds[j].rows(c[rows])]
            if len(rows):
                found, inside = ssk(c[rows], z), np.where(np.isin(c[rows], z[0]), c[rows], np.uint32(0))
                cosine = found / np.sqrt(np.maximum(ssk(inside, inside), 1e-12) * self.norms[j])
                self._keep(out[:, j], of[rows], cosine * np.minimum(found / self.norms[j], 1) ** 0.25, GAPPED)

    @staticmethod
    def _keep(out: np.ndarray, of: np.ndarray, value: np.ndarray, floor: float) -> None:
        np.maximum.at(out, of, np.where(value < floor, 0, np.minimum(value, 1)).astype(np.float32))

    def of_tokens(self, found: list[str]) -> np.ndarray:
        """(tokens, landmarks): the best of each token's forms."""
        words, of = [], []
        for k, t in enumerate(found):
            for w in forms(t):
                words.append(w)
                of.append(k)
        out = np.zeros((len(found), len(self.landmarks)), np.float32)
        if words:
            np.maximum.at(out, np.array(of, np.int64), self.similarities(words))
        return out

    def probability(self, decision):
        return self.unseen + (1 - self.unseen) / (1 + np.exp(-np.clip(self.slope * np.asarray(decision) + self.shift, -40, 40)))

    def scorer(self):
        """text -> score. Similarities of units are kept between texts, up to a bound."""
        known: dict[str, int] = {}
        rows: list[np.ndarray] = []
        base = float(self.probability(self.bias))

        def learn(found):
            if len(known) > 1 << 20:
                known.clear()
                rows.clear()
            new = [t for t in set().union(*found) if t not in known]
            for i in range(0, len(new), 1 << 15):
                part = new[i : i + (1 << 15)]
                sims = self.of_tokens(part)
                known.update(dict.fromkeys(part, -1))
                for k in np.flatnonzero(sims.any(axis=1)).tolist():
                    known[part[k]] = len(rows)
                    rows.append(sims[k].copy())

        def score(found):
            worst = self.bias
            for sentence in found:
                hits = {k for t in sentence if (k := known[t]) >= 0}
                if hits:
                    worst = max(worst, self.bias + float(self.weights @ np.max([rows[k] for k in hits], axis=0)))
            return base if worst == self.bias else float(self.probability(worst))

        def scores(texts: list[str | None]) -> list[float]:
            if not self.landmarks:
                return [base] * len(texts)
            texts = [plain(t) for t in texts]
            out: list[float] = []
            begin = size = 0
            for i, t in enumerate(texts):  # a few million characters at a time
                size += len(t)
                if size > 4_000_000 or i == len(texts) - 1:
                    # a sentence's own units: what other texts have taught must not matter
                    found = [[tokens(s) for s in _SENTENCE.split(t)] for t in texts[begin : i + 1]]
                    learn([units for sentences in found for units in sentences])
                    out += map(score, found)
                    begin, size = i + 1, 0
            return out

        return scores


def train(texts: list[str], labels: list[int], marking: int = 40, clean: int = 12, rounds: int = 300, penalty: float = 1e-3) -> Model:
    """Fits the model on whole labelled documents."""
    texts = [plain(t) for t in texts]
    y = np.array(labels, np.int64)

    def constant():
        share = float(y.mean()) if len(y) else 0.0
        return Model([], shift=float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))

    if not len(y) or y.min() == y.max():
        return constant()
    found = [tokens(t) for t in texts]
    counts: list[dict[str, int]] = [{}, {}]
    for own, label in zip(found, labels):
        for u in {w for t in own for w in forms(t)}:
            counts[label][u] = counts[label].get(u, 0) + 1
    n = [max(1, int((y == k).sum())) for k in (0, 1)]

    def mark(one: int, zero: int) -> float:
        p1, p0 = one / n[1], zero / n[0]
        return (p1 - p0) / np.sqrt(p1 / n[1] + p0 / n[0] + 1 / (n[0] * n[1])) if p0 < 0.1 * p1 else 0.0

    # Rare words mark through the beginnings they share: inflected insults have few occurrences each.
    strong = {u for u, c in counts[1].items() if c >= 3 and mark(c, counts[0].get(u, 0)) > 3}
    begins = lambda words: {w[:k] for w in words for k in STEMS if len(w) >= k}
    stems: list[dict[str, int]] = [{}, {}]
    for label in (1, 0):
        for own, mine in zip(found, labels):
            if mine == label:
                words = {w for t in own for w in forms(t)}
                for g in begins(words - strong if label else words):
                    if label or g in stems[1]:
                        stems[label][g] = stems[label].get(g, 0) + 1
        if label:
            stems[1] = {g: c for g, c in stems[1].items() if c >= 4}
    stem_marks = {g: m for g, c in stems[1].items() if (m := mark(c, stems[0].get(g, 0))) > 4.5}

    def worth_of(u, c):
        own = mark(c, counts[0].get(u, 0))
        return max([own if c >= 3 else 0.0, *(stem_marks.get(g, 0.0) for g in begins([u]) if own)])

    worth = sorted((-m, len(u), u) for u, c in counts[1].items() if 3 <= len(u) <= WIDTH and (m := worth_of(u, c)) > 3)
    worth = [u for _, _, u in worth[: 16 * marking]]
    if not worth:
        return constant()
    between, marks = Model(worth).similarities(worth), []
    for k in range(len(worth)):
        if len(marks) < marking and not any(max(between[k, j], between[j, k]) > 0.65 for j in marks):
            marks.append(k)
    marks, signs_of = [worth[k] for k in marks], set(worth)
    words = sorted(set().union(*found))
    first = Model(marks)
    near = np.concatenate([first.of_tokens(words[i : i + (1 << 15)]).max(axis=1) for i in range(0, len(words), 1 << 15)])
    alike = sorted((-float(near[k]) * min(counts[0][w], 20), w) for k, t in enumerate(words) if near[k] and (w := forms(t)[0]) in counts[0] and w not in signs_of and 3 <= len(w) <= WIDTH)
    usual = list(dict.fromkeys(w for _, w in alike))[:clean]
    model = Model(marks + usual)

    sims = np.concatenate([model.of_tokens(words[i : i + (1 << 15)]) for i in range(0, len(words), 1 << 15)])
    at = {t: k for k, t in enumerate(words) if sims[k].any()}
    telling = {t for t in words if signs_of & set(forms(t))}
    rows, target, of = [], [], []
    for d, (t, label) in enumerate(zip(texts, labels)):
        for sentence in _SENTENCE.split(t):
            parts = tokens(sentence)
            own = [at[u] for u in parts if u in at]
            if own:
                rows.append(sims[own].max(axis=0))
                target.append(-1 if not label else 1 if telling & parts else 0)
                of.append(d)
    inserted = [u[:i] + m + u[i:] for u in marks for i in range(2, len(u) - 1) for m in "-xe"] + [u[:2] + u[1:] for u in marks] + ["x".join(u) for u in marks]
    rows += [*model.of_tokens(inserted), np.zeros(len(model.landmarks), np.float32)]
    target += [1] * len(inserted) + [-1]
    x, target = np.array(rows, np.float64), np.array(target)

    grams = model.similarities(model.landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((grams + grams.T) / 2)
    keep = value > 1e-3
    root = vector[:, keep] / np.sqrt(value[keep])  # K^(-1/2) on the directions that carry weight
    fit = target != 0
    features, signs = np.hstack((x[fit] @ root, np.ones((fit.sum(), 1)))), target[fit]
    balance = np.where(signs > 0, 0.5 / (signs > 0).sum(), 0.5 / (signs < 0).sum())
    w = np.zeros(features.shape[1])
    ridge = penalty * np.diag([1.0] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):  # Newton steps on the squared hinge
        active = signs * (features @ w) < 1
        a = features[active] * balance[active, None]
        new = np.linalg.solve(features[active].T @ a + ridge, a.T @ signs[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    model.weights, model.bias = root @ w[:-1], float(w[-1])

    decision = np.full(len(texts), model.bias)
    np.maximum.at(decision, np.array(of, np.int64), x[: len(of)] @ model.weights + model.bias)
    # Logistic calibration with smoothed targets, beside a share of toxic documents that no unit gives away: those
    # say nothing about how sure a high decision is. The share and the curve are fitted in turn (EM).
    a, b, unseen = 1.0, 0.0, 0.01
    mean = np.array([(y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)])
    goal = np.where(y == 1, mean[0], mean[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * decision + b, -30, 30)))
        hidden = np.where(y == 1, unseen / (unseen + (1 - unseen) * p), 0.0)
        unseen = float(np.clip(hidden.mean(), 1e-6, 0.3))
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(a * decision + b, -30, 30)))
            g = np.array([((1 - hidden) * (p - goal) * decision).sum(), ((1 - hidden) * (p - goal)).sum()])
            v = np.maximum((1 - hidden) * p * (1 - p), 1e-9)
            h = np.array([[(v * decision**2).sum() + 1e-6, (v * decision).sum()], [(v * decision).sum(), v.sum() + 1e-6]])
            move = np.linalg.solve(h, g)
            a, b = a - move[0], b - move[1]
            if np.abs(move).max() < 1e-8:
                break
    model.unseen = unseen
    model.slope, model.shift = (float(a), float(b)) if a > 0 else (4.0, 0.0)
    return model


def crc_mod(ident, divisor: int):
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % divisor


def sample(docs: DataFrame, labels: DataFrame, most: int = 3000, most_chars: int = 8000, held_out: int = 5) -> tuple[list[str], list[int]]:
    """The bounded training sample; documents with crc32(doc_id) mod ``held_out`` = 0 are never in it."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).where("toxic = __most").select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(crc_mod(F.col("doc_id"), held_out) != 0).where(F.char_length("text").between(1, most_chars))
    # Ids first: the sample is chosen without moving texts.
    ids = rows.select("doc_id").join(marks, F.col("doc_id") == F.col("__id")).select("__id", "__toxic").distinct()
    chosen = []
    for label in (0, 1):
        chosen += ids.where(F.col("__toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(most).collect()
    spark = docs.sparkSession
    if not chosen:
        return [], []
    few = spark.createDataFrame([(r[0], int(r[1])) for r in chosen], "__id long, __toxic int")
    got = rows.join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("__id", "__toxic", "text").dropDuplicates(["__id"]).orderBy("__id").collect()
    return [r["text"] for r in got], [r["__toxic"] for r in got]


def rated(model: Model, spark: SparkSession):
    """A column function: text to score."""
    sent = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = sent.value.scorer()
        for texts in batches:
            yield pd.Series(scores(texts.tolist()), dtype="float64")
        del scores
        give_back()

    rate.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}  # as types, not strings
    return F.pandas_udf(rate, "double")


def score(docs: DataFrame, model: Model, held_out: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rate = rated(model, docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), held_out) == 0).alias("held_out"), rate(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, decided row by row where they are."""
    model = train(*sample(docs, labels))
    return docs.where(rated(model, docs.sparkSession)(F.col("text").cast("string")) < 0.5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(*sample(docs, table(spark, sf_dir, "labels"))))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
