"""Language-model scoring with a log-bilinear model trained by noise contrast.

Tokens are words and one end per text. A frequent word is a symbol of its own;
the others share symbols by their endings. The number of symbols grows with the
square root of the number of words, up to ``MOST_SYMBOLS``, the bound of what is
sent to the workers. A log-bilinear network over the two symbols before predicts
the next one, in two steps that keep its normalisation cheap and exact: first
one of about sqrt(S) groups of symbols of like endings, then the symbol in it.
A word within its symbol has its smoothed training share, so that

    P(word | before) = P(group | before) * P(symbol | group, before)
                       * (c + 1/2) / (C + (V + 1)/2)

with the symbol's token and type counts C and V, which sums to one over all
words and one unknown.

Word counts come from all training texts. The network is trained on every
context of these by noise-contrastive estimation in numpy: tasks go through the
contexts in minibatches, draw noise from the symbols' shares, start from
common parameters, and these are averaged over the tasks after each of
``ROUNDS`` rounds. Small corpora are gone through more than once; minibatches of
large ones are larger, so that a step is mostly products of whole matrices.

Scoring is batched matrix products over the tokens of many texts. It looks up the
``HEAD`` most frequent words in a table of that bounded size; the rest is joined
to the counts by word, one row per text and word. No word left for that join can
be very frequent.

Defined cases: a null or blank text is its end alone; without training texts
every symbol is equally likely and the base score is 0; rows that share an id
are scored each; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, crc_fold, map_batches, slices

FOLDS = 5
HELD_OUT = 1
HEAD = 1 << 17
LEAST_SYMBOLS, MOST_SYMBOLS = 96, 1 << 14
BEGIN, END = 0, 1
WIDTH, SHARED_NOISE, NOISE = 32, 64, 16
LEAST_BATCH, MOST_BATCH = 1 << 10, 1 << 14  # contexts of a step; beyond WANTED they grow with the corpus
LOTS, ROUNDS = 64, (0, 8, 24, 64)  # texts are dealt into lots; a round goes from one of these to the next
WANTED, PASSES = 1_000_000, 8  # contexts to train on at least, by several passes if need be, but not by more
PART = 8_000_000  # tokens for each partition of the join of rare words
FLUSH = 300_000
CODE = np.uint16  # of symbols
END_WORD = ""  # no word is empty


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# ---------------------------------------------------------------- counting


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c (in training texts) and c_all, over all texts and their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kept = {True: Counter(), False: Counter()}

        def flush() -> dict:
            words = [*(kept[True].keys() | kept[False].keys())]
            c = np.array([kept[True].get(w, 0) for w in words], np.int64)
            rest = np.array([kept[False].get(w, 0) for w in words], np.int64)
            for x in kept.values():
                x.clear()
            return {"word": words, "c": c, "c_all": c + rest}

        for batch in batches:
            for part in slices(batch):
                for fold, text in zip(part.column("fold").to_pylist(), part.column("text").to_pylist()):
                    to = kept[fold != HELD_OUT]
                    to.update(words_of(text))
                    to[b""] += 1
                if sum(map(len, kept.values())) > FLUSH:
                    yield flush()
        yield flush()

    parts = map_batches(rows, run, "word string, c bigint, c_all bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


@dataclass(frozen=True)
class Symbols:
    """The symbol of every word: its own, or that of its longest known ending."""

    own: dict[bytes, int]
    endings: dict[bytes, int]
    names: list[bytes]  # of the symbols
    shared: int  # symbols from here on are of many words
    other: int  # of words with any other ending

    def of(self, word: bytes) -> int:
        found = self.own.get(word)
        if found is None:
            found = self.endings.get(word[-3:])
            if found is None:
                found = self.endings.get(word[-2:], self.other)
        return found

    @property
    def size(self) -> int:
        return len(self.names)


def _by_group(counts: DataFrame, group: Callable[[bytes], str | None]) -> DataFrame:
    """Sums of c, and of types with c > 0, by ``group(word)``; bounded rows for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            tokens, types = Counter(), Counter()
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if word != END_WORD and (g := group(word.encode())) is not None:
                    tokens[g] += c
                    types[g] += c > 0
            yield {"g": [*tokens], "tokens": [*tokens.values()], "types": [types[g] for g in tokens]}

    parts = map_batches(counts.select("word", "c"), run, "g string, tokens bigint, types bigint")
    return parts.groupBy("g").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))


def choose_symbols(counts: DataFrame, head: list[tuple[str, int]], types: int) -> Symbols:
    size = min(MOST_SYMBOLS, max(LEAST_SYMBOLS, math.isqrt(types)))
    own_words = [w.encode() for w, _ in head if w != END_WORD][: size // 2]
    own = {w: k + 2 for k, w in enumerate(own_words)} | {b"": END}
    first = 2 + len(own_words)
    tally = None
    for n in (2, 3):
        part = _by_group(counts, lambda w, n=n: None if w in own or len(w) < n else w[-n:].hex())
        tally = part if tally is None else tally.unionByName(part)
    top = tally.orderBy(F.desc("tokens"), "g").limit(size - first - 1).select("g").collect()
    endings = [bytes.fromhex(r.g) for r in top]
    names = [b"<", b"", *own_words, *endings, b"\xff"]
    return Symbols(own, {e: first + k for k, e in enumerate(endings)}, names, first, len(names) - 1)


# ---------------------------------------------------------------- the network


class LogBilinear:
    """q(a, b) = A r_a + B r_b; groups score q . g + bias, symbols in a group q . r' + bias."""

    def __init__(self, names: list[bytes], share: np.ndarray, width: int = WIDTH, seed: int = 7):
        """names and training shares of the symbols; BEGIN is never predicted."""
        rng = np.random.default_rng(seed)
        k, groups = len(names), max(2, math.isqrt(len(names)))
        order = sorted(range(1, k), key=lambda s: names[s][::-1])  # like endings stand together
        self.group = np.zeros(k, np.int64)
        for g, part in enumerate(np.array_split(order, groups)):
            self.group[part] = g
        self.group[BEGIN] = groups
        self.order = np.array(sorted(range(k), key=lambda s: (self.group[s], s)))
        self.rank = np.argsort(self.order)  # symbols by group, BEGIN last
        self.start = np.searchsorted(self.group[self.order], np.arange(groups + 1))
        share = np.where(np.arange(k) == BEGIN, 0.0, share)
        self.share = share / share.sum()
        self.of_group = np.bincount(self.group, self.share, groups + 1)[:groups]
        self.inside = self.share / np.append(self.of_group, 1)[self.group]
        self.sum = np.cumsum(self.share[self.order])
        scale = 0.1 / math.sqrt(width)
        made = {
            "r": rng.normal(0, 0.3, (k, width)), "A": np.eye(width), "B": np.eye(width),
            "g": rng.normal(0, scale, (groups, width)), "g0": np.log(self.of_group),
            "w": rng.normal(0, scale, (k, width)), "w0": np.log(self.inside.clip(1e-30)),
        }
        self.p = {n: x.astype(np.float32) for n, x in made.items()}
        self.seen = {n: np.full_like(x, 0.1) for n, x in self.p.items()}  # AdaGrad's sums of squares

    def _draw(self, group: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        """``n`` symbols of each group by their shares."""
        high = self.sum[self.start[group + 1] - 1]
        low = np.where(self.start[group] > 0, self.sum[self.start[group] - 1], 0.0)
        at = np.searchsorted(self.sum, low[:, None] + rng.random((len(group), n)) * (high - low)[:, None], "right")
        at = np.clip(at, self.start[group][:, None], self.start[group + 1][:, None] - 1)
        return self.order[at]

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rng: np.random.Generator, rate: float = 0.1) -> None:
        """One step of noise-contrastive estimation on contexts (a, b) followed by w.

        The noise is drawn once for all contexts: groups, and symbols of each group for
        the contexts that its symbols follow. So all but the sums by symbol is products
        of whole matrices. Biases stand in a last column, against ones.
        """
        self.__dict__.pop("_contexts", None)
        p, n, k = self.p, len(w), len(self.share)
        kind = np.min_scalar_type(k)  # numpy sorts short integers in linear time
        rank = self.rank[w].astype(kind)
        order = np.argsort(rank, kind="stable")
        a, b, rank = a[order].astype(kind), b[order].astype(kind), rank[order]
        cuts = np.searchsorted(rank, self.start)
        q = np.ones((n, p["r"].shape[1] + 1), np.float32)
        q[:, :-1] = (p["r"] @ p["A"]).take(a, axis=0)
        q[:, :-1] += (p["r"] @ p["B"]).take(b, axis=0)
        # less the logs of the noise
        outer = _with_bias(p["g"], p["g0"] - np.log(SHARED_NOISE * self.of_group))
        inner = _with_bias(p["w"], p["w0"] - np.log(NOISE * self.inside.clip(1e-30)))[self.order]
        noise = rng.choice(len(self.of_group), SHARED_NOISE, p=self.of_group)
        force, d_outer = _against(q, outer, np.bincount(noise, minlength=len(outer)))
        d_inner = np.zeros_like(inner)
        noise = self.rank[self._draw(np.arange(len(outer)), NOISE, rng)]
        times = np.bincount(noise.ravel(), minlength=k)
        for g in np.flatnonzero(np.diff(cuts)):
            rows, members = slice(cuts[g], cuts[g + 1]), slice(self.start[g], self.start[g + 1])
            pull = _sigmoid(-(q[rows] @ outer[g]))
            push, d_inner[members] = _against(q[rows], inner[members], times[members])
            force[rows] += push
            force[rows] += pull[:, None] * outer[g]
            d_outer[g] += pull @ q[rows]
        found = inner.take(rank, axis=0)
        pull = _sigmoid(-np.einsum("nd,nd->n", q, found))[:, None]
        d_inner += _summed(rank, pull * q, k)
        found *= pull
        force += found
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        of_a = _summed(a[by_a], force.take(by_a, axis=0), k)[:, :-1]
        of_b = _summed(b[by_b], force.take(by_b, axis=0), k)[:, :-1]
        d_inner = d_inner[self.rank]
        for name, x in {
            "A": p["r"].T @ of_a, "B": p["r"].T @ of_b, "r": of_a @ p["A"].T + of_b @ p["B"].T,
            "g": d_outer[:, :-1], "g0": d_outer[:, -1], "w": d_inner[:, :-1], "w0": d_inner[:, -1],
        }.items():
            x = x / np.float32(n**0.5)
            self.seen[name] += x * x
            p[name] += np.float32(rate) * x / np.sqrt(self.seen[name])

    def log10(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, part: int = 4096) -> np.ndarray:
        """log10 P(w | a, b), normalised over all symbols but BEGIN.

        Tokens are taken by their groups, so every product is of whole matrices.
        """
        p, out = self.p, np.empty(len(w))
        ra, rb = self._contexts
        group = self.group[w].astype(np.uint16)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(self.start)))
        groups, bias = np.ascontiguousarray(p["g"].T), p["g0"]
        for g in np.flatnonzero(np.diff(cuts)):
            members = self.order[self.start[g] : self.start[g + 1]]
            inner, inner_bias = np.ascontiguousarray(p["w"][members].T), p["w0"][members]
            for at in range(cuts[g], cuts[g + 1], part):
                rows = order[at : min(at + part, cuts[g + 1])]
                q = ra[a[rows]] + rb[b[rows]]
                s = q @ groups + bias
                found = s[:, g].astype(np.float64) - _log_sum(s)
                s = q @ inner + inner_bias
                pick = self.rank[w[rows]] - self.start[g]
                found += s[np.arange(len(rows)), pick]
                out[rows] = found - _log_sum(s)
        return out / math.log(10)

    @cached_property
    def _contexts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["r"] @ self.p["A"], self.p["r"] @ self.p["B"]

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for part in (self.p, self.seen) for x in part.values())

    def unpack(self, raw: np.ndarray) -> None:
        self.__dict__.pop("_contexts", None)
        at = 0
        for part in (self.p, self.seen):
            for n, x in part.items():
                part[n] = raw[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


def _with_bias(x: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate((x, bias[:, None]), axis=1, dtype=np.float32)


def _against(q: np.ndarray, x: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forces of noise, rows of ``x`` drawn ``times`` each, on ``q`` and on ``x``."""
    drawn = np.flatnonzero(times)
    weight = -times[drawn, None].astype(np.float32)
    y = x[drawn]
    s = q @ -y.T
    np.clip(s, -30, 30, out=s)
    np.exp(s, out=s)
    s += 1
    np.reciprocal(s, out=s)
    found = np.zeros_like(x)
    found[drawn] = (s.T @ q) * weight
    return s @ (y * weight), found


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Logs of the rows' sums of exponentials; overwrites ``s``."""
    top = s.max()
    low = s.min()
    if top - low > 60:  # one shift for all rows would lose some
        top = s.max(axis=1)
        s = s - top[:, None]
    else:
        s -= top
    np.exp(s, out=s)
    return top + np.log((s @ np.ones(s.shape[1], s.dtype)).astype(np.float64))


def _summed(rows: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values of each of ``size`` rows, which come in order."""
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out = np.zeros((size, x.shape[1]), x.dtype)
    out[rows[first]] = np.add.reduceat(x, first, axis=0)
    return out


def contexts(raw: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two symbols before, and each symbol, of texts of these codes; where texts begin."""
    s = np.frombuffer(b"".join(raw), CODE).astype(np.int64)
    first = np.cumsum([0, *sizes[:-1]])
    b = np.concatenate(([BEGIN], s[:-1]))
    b[first] = BEGIN
    a = np.concatenate(([BEGIN], b[:-1]))
    a[first] = BEGIN
    return a, b, s, first


def fit(coded: DataFrame, names: list[bytes], share: np.ndarray, tokens: int) -> LogBilinear:
    """Train on every context of all training texts, ``passes`` times on each."""
    net = LogBilinear(names, share)
    if not tokens:
        return net
    passes = min(PASSES, max(1, -(-WANTED // tokens)))
    size = min(MOST_BATCH, max(LEAST_BATCH, LEAST_BATCH * tokens // WANTED))
    sc = coded.sparkSession.sparkContext
    for turn, (low, high) in enumerate(pairwise(ROUNDS)):
        sent = sc.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[dict]:
            net, rng = sent.value, np.random.default_rng((turn, TaskContext.get().partitionId()))
            steps, codes, sizes, held = 0, [], [], 0

            def learn() -> int:
                a, b, w, _ = contexts(codes, sizes)
                n = 0
                for _ in range(passes):
                    mixed = rng.permutation(len(w))
                    for at in range(0, len(mixed), size):
                        pick = mixed[at : at + size]
                        net.step(a[pick], b[pick], w[pick], rng)
                        n += 1
                return n

            for batch in batches:
                for part in slices(batch, 2 * FLUSH):
                    codes += part.column("codes").to_pylist()
                    sizes += (new := part.column("n_tokens").to_pylist())
                    held += sum(new)
                    if held > FLUSH:
                        steps += learn()
                        codes, sizes, held = [], [], 0
            if codes:
                steps += learn()
            if steps:
                yield {"task": [TaskContext.get().partitionId()], "n": [steps], "raw": [net.packed()]}

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            total, n = None, 0
            for batch in batches:
                for k, raw in zip(batch.column("n").to_pylist(), batch.column("raw").to_pylist()):
                    x = np.frombuffer(raw, np.float32).astype(np.float64) * k
                    total, n = x if total is None else total + x, n + k
            if n:
                yield {"task": [0], "n": [n], "raw": [(total / n).astype(np.float32).tobytes()]}

        kind = "task int, n bigint, raw binary"
        lots = coded.where((F.col("fold") != HELD_OUT) & F.col("lot").between(low, high - 1))
        parts = map_batches(lots.select("n_tokens", "codes"), run, kind)
        parts = map_batches(parts.repartition(16, "task"), merge, kind)
        found = parts.collect()  # 16 rows at most, each of the network's size
        if found:
            weight = np.array([r.n for r in found], float)
            mean = sum(np.frombuffer(r.raw, np.float32).astype(np.float64) * n for r, n in zip(found, weight / weight.sum()))
            net.unpack(mean)
        sent.unpersist()
    return net


# ---------------------------------------------------------------- scoring


@dataclass(frozen=True)
class Vocabulary:
    """All that comes from the counts, but those of words outside ``head``."""

    symbols: Symbols
    head: dict[bytes, int]  # word -> c in training texts
    log10_room: np.ndarray  # of C + (V + 1)/2 of each symbol of many words, else 0
    share: np.ndarray  # training tokens of each symbol, plus 1/2
    tokens: int
    types: int

    @property
    def base(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.types + 1))


@dataclass(frozen=True)
class Model(Vocabulary):
    """All that scoring needs but the counts of words outside ``head``."""

    net: LogBilinear


def vocabulary(counts: DataFrame, head_size: int = HEAD) -> Vocabulary:
    """counts: of word_counts."""
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    top = counts.orderBy(F.desc("c_all"), "word").limit(head_size).select("word", "c").toArrow()
    head = {w.encode(): c for w, c in zip(top.column("word").to_pylist(), top.column("c").to_pylist())}
    symbols = choose_symbols(counts, list(zip(top.column("word").to_pylist(), head.values())), types)
    room, share = np.zeros(symbols.size), np.full(symbols.size, 0.5)
    for w, k in symbols.own.items():
        share[k] += head.get(w, 0)
    room[symbols.shared :] = math.log10(0.5)
    own = symbols.own
    for g, c, v in _by_group(counts, lambda w: None if w in own else str(symbols.of(w))).collect():  # one row a symbol
        room[int(g)] = math.log10(c + 0.5 * (v + 1))
        share[int(g)] += c
    return Vocabulary(symbols, head, room, share, tokens, types)


class Coder:
    """Per text: its symbols, and sums over the words whose counts are in the vocabulary."""

    def __init__(self, known: Vocabulary):
        self.symbols, self.room = known.symbols, known.log10_room
        self.at = {w: k for k, w in enumerate(known.head)}
        c = np.array([*known.head.values(), 0], float)
        self.log_c = np.log10(c + 0.5)
        self.known = c > 0
        self.symbol = np.array([*map(known.symbols.of, known.head), 0], np.int64)
        self.log_c[-1] = 0  # of words outside the head

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, float, float, dict[bytes, int], bytes]]:
        """Per text: n_tokens, n_known, sum of log10(c + 1/2), the logs of the words'
        shares in their symbols, the words left with their numbers, and the codes."""
        if not texts:
            return []
        symbols, words, sizes = self.symbols, [], []
        for t in texts:
            w = words_of(t)
            words += w
            words.append(b"")
            sizes.append(len(w) + 1)
        at = np.array([*map(self.at.get, words, _MISSING)], np.int64)
        out = np.flatnonzero(at < 0)
        s = self.symbol[at]
        rest = [words[k] for k in out]
        s[out] = [*map(symbols.of, rest)]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        first = cuts[:-1]
        log_c = self.log_c[at]
        inner = np.where(s >= symbols.shared, log_c, 0) - self.room[s]
        owner = np.searchsorted(cuts, out, "right") - 1
        left: list[dict[bytes, int]] = [{} for _ in texts]
        for k, w in zip(owner.tolist(), rest):
            left[k][w] = left[k].get(w, 0) + 1
        sums = [np.add.reduceat(x, first).tolist() for x in (self.known[at].astype(np.int64), log_c, inner)]
        raw, wide = s.astype(CODE).tobytes(), np.dtype(CODE).itemsize
        codes = [raw[wide * x : wide * y] for x, y in pairwise(cuts.tolist())]
        return list(zip(sizes, *sums, left, codes))


class _Repeat:
    def __iter__(self):
        while True:
            yield -1


_MISSING = _Repeat()


def code(rows: DataFrame, known: Vocabulary, *others: str) -> DataFrame:
    """rows: fold and text, and ``others``. Per text: row, a number of its own, the
    others, fold, lot, and what ``Coder`` says."""
    sent = rows.sparkSession.sparkContext.broadcast(known)
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in others]
    rows = rows.select(*others, "fold", "text", F.pmod(F.xxhash64("text"), F.lit(LOTS)).alias("lot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder, task, n = Coder(sent.value), TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for part in slices(batch, 2 << 20):
                got = coder(part.column("text").to_pylist())
                yield {
                    **{name: part.column(name) for name in (*others, "fold", "lot")},
                    "row": range(task + n, task + n + len(got)),
                    "n_tokens": [x[0] for x in got], "n_known": [x[1] for x in got],
                    "log_c": [x[2] for x in got], "inner": [x[3] for x in got],
                    "words": [[*x[4]] for x in got], "times": [[*x[4].values()] for x in got],
                    "codes": [x[5] for x in got],
                }
                n += len(got)

    return map_batches(
        rows, run,
        ", ".join(["row bigint", *kinds, "fold bigint, lot bigint, n_tokens bigint, n_known bigint, log_c double"])
        + ", inner double, words array<string>, times array<int>, codes binary",
    )


def train(rows: DataFrame, counts: DataFrame, head_size: int = HEAD) -> Model:
    """rows: fold and text of all documents; counts: of word_counts."""
    known = vocabulary(counts, head_size)
    return Model(**vars(known), net=fit(code(rows, known), known.symbols.names, known.share, known.tokens))


def network_scores(net: LogBilinear, codes: list[bytes], sizes: list[int]) -> list[float]:
    """log10 of the symbols' probability, per text."""
    if not codes:
        return []
    *found, first = contexts(codes, sizes)
    return np.add.reduceat(net.log10(*found), first).tolist()


class Scorer:
    """Codes texts and scores them by the network."""

    def __init__(self, model: Model):
        self.net, self.coder = model.net, Coder(model)

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, float, float, dict[bytes, int]]]:
        """Per text: n_tokens, n_known, sum of log10(c + 1/2), the symbols' part of
        the score, and the words left with their numbers."""
        got = self.coder(texts)
        part = network_scores(self.net, [x[5] for x in got], [x[0] for x in got])
        return [(n, known, log_c, inner + x, left) for (n, known, log_c, inner, left, _), x in zip(got, part)]


def score(spark: SparkSession, docs: DataFrame, head_size: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    space = Workspace(spark, "lm")
    rows = docs.select("doc_id", crc_fold(F.col("doc_id"), FOLDS).alias("fold"), "text")
    counts = space.save(word_counts(rows.select("fold", "text")), "counts")
    model = vocabulary(counts, head_size)
    # written once: texts are cut into words once for training and scoring, and the
    # row numbers must not depend on a task's repeat
    coded = space.save(code(rows, model, "doc_id"), "coded")
    sent = spark.sparkContext.broadcast(fit(coded, model.symbols.names, model.share, model.tokens))
    kept = ["row", "doc_id", "fold", "n_tokens", "n_known", "log_c"]
    kinds = ", ".join(f"{n} {coded.schema[n].dataType.simpleString()}" for n in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, 2 * FLUSH):
                found = network_scores(sent.value, part.column("codes").to_pylist(), part.column("n_tokens").to_pylist())
                inner = part.column("inner").to_numpy(zero_copy_only=False)
                yield {**{n: part.column(n) for n in kept}, "part": inner + np.array(found)}

    scored = map_batches(coded.select(*kept, "inner", "codes"), run, f"{kinds}, part double")
    rest = coded.select("row", F.inline(F.arrays_zip("words", "times")).alias("word", "times"))
    known = counts.select("word", "c")
    parts = model.tokens // PART
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rest, known = rest.repartition(parts, "word"), known.repartition(parts, "word")
    rest = rest.join(known, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rest_log_c"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    log_c = F.coalesce("rest_log_c", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        (F.col("fold") == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") + log_c - F.col("n_tokens") * F.lit(model.base)).alias("base_score"),
        (F.col("part") + log_c).alias("score"),
    )
