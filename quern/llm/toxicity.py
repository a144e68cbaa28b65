"""Toxicity: a subsequence string-kernel support vector machine.

The kernel of two words sums, over all sequences of three letters that both
have in order, a decay to the power of the letters they span; gaps and
inserted characters weaken a match but don't break it. Landmark words give
the Nyström map of the kernel, and a linear support vector machine is trained
on the mapped words of labelled sentences.

Labels are known for texts, not words, so the machine learns from witnesses:
words that far more toxic than clean texts have, themselves or by a beginning
(Chernoff's bound), against common, rare and hard words of clean texts; the hard
ones are mined in rounds. The kernel of two sentences is the sum over their
words, so a text's evidence is the sum of its words' clipped decisions. Evidence
against that of clean texts of like length, and the two largest decisions, are
calibrated on texts whose words were not learnt from (each half of the labelled
texts is judged by what the other half taught).

As the decision is linear in the kernel it folds into one weight for each
sequence of three letters, so a word costs a few look-ups, and every distinct
word of a task is scored once.

Words are lower-cased and bared of outer signs; a word with inner signs is
also read without them, and single letters in a row are also read as one word.
Whole mail addresses and links are no words; what else their token holds is read.

Defined cases: a null, empty or wordless text has the score of no evidence;
labels without a toxic mark or without a document teach nothing; without both
classes every score is the smoothed share of toxic texts; overlong words are
read in overlapping stretches; other columns of the inputs are ignored.

Learning takes at most ``TOXIC`` toxic and ``CLEAN`` clean labelled texts, those
of the least MD5 of their ids, and from their words at most the numbers that
stand with ``WITNESSES``; everything else covers all rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, map_batches, slices

FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
TOXIC, CLEAN = 2000, 4000
COPY = 0.8
SURE = 14.0  # nats by which a word tells, over some ten thousand words tried
#: Words that the machine learns from: telling ones (most texts first), common and
#: rare ones of clean texts, hard ones, and those among which these are sought.
WITNESSES, COMMON, RARE, HARD, MINED = 4000, 1500, 5000, 1500, 60_000
ROUNDS = 3
FLOOR, SOFT = 1e-4, 1e-4  # of the eigenvalues of the map, and of the machine's weights
DECAY = 0.7
SPAN = 7  # letters that a sequence may span
LONG, OVERLAP = 24, 8
LANDMARKS = 256
PENALTY = 2.0  # of the calibration, in texts
OWN_LETTERS, SHARED = 60, 14
REMEMBERED = 400_000
_PAIRS = np.array([(a, b) for b in range(2, SPAN) for a in range(1, b)])
_WEIGHT = (DECAY ** (_PAIRS[:, 1] + 1)).astype(np.float32)
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_ADDRESS = re.compile(
    r"(?:https?|s?ftps?|wss?|file|ssh|git)://[^\s<>\"'(){}|,;]+|(?<![\w.+%-])[\w.+%-]++@(?:[\w-]+\.)+[^\W\d_]{2,}"
)


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in all their readings."""
    tokens = (text or "").lower().split()
    out = set()
    for w in set(tokens):
        if not w.isalpha():
            if "@" in w or "://" in w:
                parts = _ADDRESS.sub(" ", w).split()
                if len(parts) > 1:
                    out.add(_INNER.sub("", "".join(parts)))
            else:
                parts = [w]
            for w in parts:
                w = _OUTER.sub("", w)
                if w and not w.isalpha():
                    out.add(_INNER.sub("", w))
                out.add(w)
        else:
            out.add(w)
    run: list[str] = []
    last = -2
    for k in [k for k, w in enumerate(tokens) if len(w) == 1]:
        if k != last + 1:
            if len(run) > 2:
                out.add("".join(run))
            run = []
        if tokens[k].isalpha():
            run.append(tokens[k])
        last = k
    if len(run) > 2:
        out.add("".join(run))
    out.discard("")
    return out


def stretches(word: str) -> list[str]:
    word = f"^{word}$"
    if len(word) <= LONG:
        return [word]
    return [word[a : a + LONG] for a in range(0, len(word) - OVERLAP, LONG - OVERLAP)]


class Letters:
    """Numbers of letters: the commonest have their own, the others share ``SHARED``
    by code point, so that words of any script stay apart; 0 is none."""

    def __init__(self, words: list[str]):
        times = Counter("".join(words))
        common = sorted(times, key=lambda c: (-times[c], c))[:OWN_LETTERS]
        self.size = 1 + OWN_LETTERS + SHARED
        self.lookup = (1 + OWN_LETTERS + np.arange(0x110000) % SHARED).astype(np.int8)
        self.lookup[0] = 0
        for k, c in enumerate(common):
            self.lookup[ord(c)] = k + 1

    def sequences(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (words x sequences, 0 for none) of words of about one length, and
        norms: what the kernel of a word with itself is without repeats in it."""
        n = max(map(len, words))
        raw = "".join([w.ljust(n, "\0") for w in words]).encode("utf-32-le")
        x = np.zeros((len(words), n + SPAN), np.int32)
        x[:, :n] = self.lookup[np.frombuffer(raw, "<u4")].reshape(len(words), n)
        first = x[:, :n, None]
        second, third = x[:, np.arange(n)[:, None] + _PAIRS[:, 0]], x[:, np.arange(n)[:, None] + _PAIRS[:, 1]]
        code = (first * self.size + second) * self.size + third
        code[third == 0] = 0
        code = code.reshape(len(words), -1)
        norm = np.sqrt((code > 0) @ np.tile(_WEIGHT * _WEIGHT, n))
        return code, norm.clip(1e-9)

    def by_length(self, words: list[str], most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, codes, norms) of groups of words of like length."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            end = at
            while end < len(order) and end - at < most and len(words[order[end]]) <= len(words[order[at]]) + 1:
                end += 1
            group = order[at:end]
            code, norm = self.sequences([words[k] for k in group])
            yield np.array(group), code, norm
            at = end


class Kernel:
    """Normalised kernel values of words against landmarks."""

    def __init__(self, letters: Letters, landmarks: list[str]):
        self.letters, self.landmarks = letters, landmarks
        rows: list[tuple[int, int, float]] = []
        for group, code, norm in letters.by_length(landmarks):
            weight = np.tile(_WEIGHT, code.shape[1] // len(_WEIGHT))
            for k, c, z in zip(group, code, norm):
                rows += [(int(x), int(k), float(w / z)) for x, w in zip(c, weight) if x]
        codes = sorted({x for x, _, _ in rows})
        self.row = np.zeros(letters.size**3, np.int32)
        self.row[codes] = np.arange(1, len(codes) + 1)
        self.table = np.zeros((len(codes) + 1, len(landmarks)), np.float32)
        for x, k, w in rows:
            self.table[self.row[x], k] += w

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for group, code, norm in self.letters.by_length(words, 64):
            weight = np.tile(_WEIGHT, code.shape[1] // len(_WEIGHT))
            out[group] = np.einsum("bsm,s->bm", self.table[self.row[code]], weight) / norm[:, None]
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Adam over all rows."""
    p = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ p[:-1] + p[-1])) * weight * -2 * y
        g = np.concatenate((x.T @ slack + penalty * p[:-1], [slack.sum()]))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return p[:-1], float(p[-1])


@dataclass(frozen=True)
class Model:
    """The decision of a word is bias + sum of weights of its sequences / norm; that
    of a text is made from the decisions of its words."""

    prior: float
    letters: Letters | None = None
    weight: np.ndarray | None = None
    bias: float = 0.0
    usual: float = 0.0  # evidence of a word of a clean text
    slope: tuple[float, ...] = ()  # of the text's features

    def decisions(self, words: list[str]) -> np.ndarray:
        pieces = [(k, s) for k, w in enumerate(words) for s in stretches(w)]
        out = np.full(len(words), -np.inf)
        texts = [s for _, s in pieces]
        owner = np.array([k for k, _ in pieces])
        for group, code, norm in self.letters.by_length(texts):
            weight = np.tile(_WEIGHT, code.shape[1] // len(_WEIGHT))
            np.maximum.at(out, owner[group], self.weight[code] @ weight / norm + self.bias)
        return out

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        if self.letters is None:
            return np.full(len(evidence), self.prior)
        odds = features(evidence, self.usual) @ np.array(self.slope)
        return 1 / (1 + np.exp(-odds.clip(-50, 50)))


def evidence_of(decisions: list[list[float]]) -> np.ndarray:
    """Per text: the evidence of its words (a decision of 1/2 or more counts one, of
    -1/2 or less nothing), their number, and the two largest decisions."""
    out = np.zeros((len(decisions), 4))
    out[:, 2:] = -1
    for row, found in zip(out, decisions):
        d = np.array(found)
        if len(d):
            top = np.partition(d, max(len(d) - 2, 0))[-2:]
            row[:2] = (d + 0.5).clip(0, 1).sum(), len(d)
            row[2] = top.max().clip(-1, 1)
            row[3] = top.min().clip(-1, 1) if len(d) > 1 else -1
    return out


def features(evidence: np.ndarray, usual: float) -> np.ndarray:
    """The evidence, against what a clean text of as many words has; and the worst words."""
    n, words, first, second = evidence.T
    return np.column_stack((np.log((n + 0.5) / (usual * words + 0.5)), first, second, np.ones(len(n))))


class Scorer:
    """Scores texts, remembering the words seen."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        if self.model.letters is None:
            return np.zeros((len(texts), 4))
        words = [words_of(t) for t in texts]
        seen = self.seen
        new = list({w for ws in words for w in ws if w not in seen})
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = list(set().union(*words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            seen.update(zip(part, self.model.decisions(part).tolist()))
        return evidence_of([[seen[w] for w in ws] for ws in words])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.model.probabilities(self.evidence(texts))


# ---------------------------------------------------------------- learning


def _inserted(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with a character put in at one place."""
    out = []
    for w in words:
        if len(w) > 3:
            k = int(rng.integers(1, len(w)))
            out.append(w[:k] + "xqzj"[int(rng.integers(4))] + w[k:])
    return out


def _starts(word: str) -> set[str]:
    """A word and its beginnings of four letters and more."""
    return {word[:n] for n in range(4, len(word))} | {word + "$"}


def _grams(word: str) -> set[str]:
    w = f"^{word}"
    return {w[i : i + 4] for i in range(len(w) - 3)}


def _varied(words: list[str], most: int) -> list[str]:
    """Words of which each has many beginnings, middles or ends that those before lack."""
    covered: set[str] = set()
    out: dict[str, None] = {}
    for share in (0.5, 0.2, -1):
        for w in words:
            g = _grams(w)
            if len(out) < most and w not in out and g and len(g - covered) > share * len(g):
                out[w] = None
                covered |= g
    return list(out)


def _tells(n: int, usual: float) -> bool:
    """Whether ``n`` texts are far more than the usual number, and not by chance (Chernoff's bound)."""
    return n > 4 * usual and n * np.log(n / usual) - n + usual > SURE


def _ordered(times: Counter) -> list[str]:
    return sorted(times, key=lambda w: (-times[w], w))


class Teacher:
    """Learns from the words of labelled texts."""

    def __init__(self, toxic: list[set[str]], clean: list[set[str]], seed: int = 3):
        self.toxic, self.clean, self.seed = toxic, clean, seed

    def witnesses(self) -> Counter:
        """Words of toxic texts that tell, themselves or by a beginning, with the number of their texts."""
        ratio = len(self.toxic) / len(self.clean)
        in_toxic, in_clean = Counter(), Counter()
        for ws in self.toxic:
            in_toxic.update(set().union(*map(_starts, ws)))
        likely = {g for g, n in in_toxic.items() if n > 2 and _tells(n, 0.5 * ratio)}
        heads = {g[:4] for g in likely}
        known = {w: _starts(w) & likely for w in set().union(*self.clean) if f"{w}$"[:4] in heads}
        marked = {w for w, starts in known.items() if starts}
        for ws in self.clean:
            in_clean.update(set().union(*[known[w] for w in ws & marked]))
        telling = {g for g in likely if _tells(in_toxic[g], (in_clean[g] + 0.5) * ratio)}
        out = Counter()
        for ws in self.toxic:
            out.update(w for w in ws if not telling.isdisjoint(_starts(w)))
        times = Counter(w for ws in self.clean for w in ws if w in out)
        return Counter({w: n for w, n in out.items() if n > 2 * ratio * times[w]})

    def words(self) -> tuple[Letters, np.ndarray, float] | None:
        """The machine on words: letters, weight of every sequence, bias; None without witnesses."""
        rng = np.random.default_rng(self.seed)
        seen = self.witnesses()
        if not seen:
            return None
        positive = _ordered(seen)[:WITNESSES]
        times = Counter(w for ws in self.clean for w in ws)
        common = [w for w in _ordered(times)[: COMMON + len(seen)] if w not in seen][:COMMON]
        others = sorted(set(times) - set(common) - set(seen))
        rng.shuffle(others)
        hard: list[str] = []
        for k in range(ROUNDS):
            negative = list(dict.fromkeys(hard + common + others[:RARE]))
            more = _inserted(positive, rng)
            letters = Letters([f"^{w}$" for w in positive + negative])
            pick = _varied(positive, LANDMARKS // 2) + _varied(hard, LANDMARKS // 4)
            pick += [negative[i] for i in rng.permutation(len(negative))[: LANDMARKS - len(pick)]]
            kernel = Kernel(letters, list(dict.fromkeys(s for w in pick for s in stretches(w))))
            gram = kernel(kernel.landmarks).astype(float)
            value, vector = np.linalg.eigh((gram + gram.T) / 2)
            root = vector / np.sqrt(value.clip(FLOOR))  # the Nyström map: kernel values @ root
            count = np.array([float(seen.get(w, 1)) for w in positive + more] + [np.log1p(times[w]) + 1 for w in negative])
            side = np.array([1.0] * (len(positive) + len(more)) + [-1.0] * len(negative))
            parts = [(s, k) for k, w in enumerate(positive + more + negative) for s in stretches(w)]
            owner = np.array([k for _, k in parts])
            y, weight = side[owner], np.where(side > 0, count**0.5, count)[owner]
            weight = weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
            x = kernel([s for s, _ in parts]).astype(float) @ root
            w, bias = _svm(x, y, weight, penalty=SOFT)
            table = np.zeros(letters.size**3, np.float32)
            table[kernel.row > 0] = (kernel.table @ (root @ w))[kernel.row[kernel.row > 0]]
            model = Model(0.5, letters, table, bias)
            if k < ROUNDS - 1:
                every = common + others[:MINED]
                got = dict(zip(every, model.decisions(every).tolist()))
                hard = sorted(got, key=lambda z: (-got[z], z))[:HARD]
        return letters, table, bias

    def evidence(self, learnt: tuple, texts: list[set[str]]) -> np.ndarray:
        model = Model(0.5, *learnt)
        every = sorted(set().union(*texts))
        got = dict(zip(every, model.decisions(every).tolist()))
        return evidence_of([[got[w] for w in ws] for ws in texts])


def train(toxic: list[set[str]], clean: list[set[str]], share: float) -> Model:
    """toxic, clean: the words of labelled texts; share: of toxic among all labelled.

    How words' decisions make a text's score is learnt on texts whose words were
    not learnt from: each half is judged by what the other half taught.
    """
    if min(len(toxic), len(clean)) < 2:
        return Model(share)
    apart = _unlike(toxic)
    learnt = Teacher(apart, clean).words()
    if learnt is None:
        return Model(share)
    found, y = [], []
    for k in (0, 1):
        half = Teacher(apart[k::2], clean[k::2]).words()
        if half is None:
            found, y = [], []
            break
        for label, texts in ((1.0, apart[1 - k :: 2]), (0.0, clean[1 - k :: 2])):
            found.append(Teacher.evidence(None, half, texts))
            y += [label] * len(texts)
    if not found:
        found = [Teacher.evidence(None, learnt, apart), Teacher.evidence(None, learnt, clean)]
        y = [1.0] * len(apart) + [0.0] * len(clean)
    evidence, y = np.concatenate(found), np.array(y)
    usual = (evidence[y == 0, 0].sum() + 1) / (evidence[y == 0, 1].sum() + 1000)
    weight = np.where(y > 0, share / (y > 0).sum(), (1 - share) / (y == 0).sum())
    return Model(share, *learnt, usual, _calibrate(features(evidence, usual), y, weight))


def _unlike(texts: list[set[str]]) -> list[set[str]]:
    """The texts without copies: of those with ``COPY`` of all their words in common, the first.

    Two texts with that share of words have one among the rarest few of each,
    so only texts that meet there are compared, and no copy is missed.
    """
    times = Counter(w for ws in texts for w in ws)
    met: dict[str, list[int]] = {}
    out: list[set[str]] = []
    for ws in texts:
        few = sorted(ws, key=lambda w: (times[w], w))[: len(ws) - math.ceil(COPY * len(ws) - 1e-9) + 1]
        near = {k for w in few for k in met.get(w, ())}
        if any(len(ws & out[k]) >= COPY * len(ws | out[k]) for k in near) or (not ws and ws in out):
            continue
        for w in few:
            met.setdefault(w, []).append(len(out))
        out.append(ws)
    return out


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small penalty, by Newton's method; no evidence counts against a text."""
    start = np.array([1.5, 1.0, 1.0, -3.0])
    p, penalty = start.copy(), PENALTY / len(y)
    for _ in range(60):
        q = 1 / (1 + np.exp(-(z @ p).clip(-30, 30)))
        g = z.T @ (weight * (q - y)) + penalty * (p - start)
        h = (z * (weight * q * (1 - q))[:, None]).T @ z + penalty * np.eye(len(p))
        p = p - np.linalg.solve(h, g).clip(-2, 2)
    return tuple(float(x) for x in p)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled texts of the learning folds."""
    marked = labels.where("toxic in (0, 1)").where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    marked = marked.select("doc_id", "toxic")
    n = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    picked = marked.where("toxic = 1").orderBy(*order).limit(TOXIC)
    picked = picked.unionByName(marked.where("toxic = 0").orderBy(*order).limit(CLEAN))
    # TOXIC + CLEAN ids at most
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch):
                yield {"toxic": part.column("toxic"), "words": [sorted(words_of(t)) for t in part.column("text").to_pylist()]}

    words: dict[int, list[set[str]]] = {0: [], 1: []}
    found = map_batches(texts.select(F.col("toxic").cast("int"), "text"), run, "toxic int, words array<string>")
    for row in sorted(found.toLocalIterator(), key=lambda r: (r.toxic, r.words)):
        words[row.toxic].append(set(row.words))
    return train(words[1], words[0], share)


def score(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    sent = spark.sparkContext.broadcast(model or fit(spark, docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                p = scorer(part.column("text").to_pylist())
                held = np.array(part.column("fold").to_pylist()) == HELD_OUT
                yield {
                    "doc_id": part.column("doc_id"), "held_out": held, "score": p,
                    "predicted": (p >= threshold).astype(np.int32),
                }

    rows = docs.select("doc_id", crc_fold(F.col("doc_id"), FOLDS).alias("fold"), "text")
    return map_batches(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
