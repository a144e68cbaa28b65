"""Personal data: patterns, and a character BiLSTM with CRF transitions.

Patterns find e-mail addresses, IP addresses, card and telephone numbers. A
bidirectional LSTM over characters with a linear-chain CRF on top, trained in
numpy from labelled spans, adds forms that the patterns miss (an address with
``(at)``, a number without its country code, other separators). Overlapping
windows are decoded and reconciled over the whole text: each character takes
its tag from the window in which it lies most centrally, and spans are read
off the text as one.

All of these hold a digit or an at-sign, so only windows with one are decoded;
the rest of the text is scanned for those signs alone. A span that the network
finds must be valid for its kind and clear of every span of the patterns.

Labelled spans for the training are made from templates, with hard negatives
(versions, dates, hexadecimal strings, plain numbers).

Defined cases: a null text counts as empty and has no spans; kinds may overlap
one another, spans of one kind don't; positions are code points, ends
exclusive; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
SIGNAL = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]")
#: Words around the invented spans, besides made-up ones.
_USUAL = (
    "the", "call", "mail", "me", "at", "or", "write", "to", "my", "number", "is", "card", "server", "phone", "contact", "please", "and", "for", "order",
    "page", "see", "section", "Telefon", "unter", "oder", "Rufnummer", "und", "appelez", "le", "courriel", "numéro", "de", "la", "el", "correo", "llame", "version",
    "on", "in", "year", "item", "total", "price", "room", "reply", "paid", "with", "address", "host", "fax", "Büro", "mobile", "from", "between",
)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Same matches as the pattern, in linear time: one try for each at-sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _fits(kind: int, text: str) -> bool:
    if kind == 1:
        parts = text.split(".")
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    digits = "".join(_DIGITS.findall(text))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def patterns(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind."""
    if not re.search(r"[0-9@]", text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _fits(kind, m.group())]
    return sorted(out)


# ---------------------------------------------------------------- the network

_SIGNS = "\0 \n@.-+_%()[]{}:/,#="
_SYMBOL = {c: k for k, c in enumerate(_SIGNS)}
_UPPER, _DIGIT, _WIDE, _OTHER = len(_SIGNS), len(_SIGNS) + 1, len(_SIGNS) + 2, len(_SIGNS) + 3
_LETTER = len(_SIGNS) + 4
SYMBOLS = _LETTER + 26
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return _LETTER + ord(c) - 97
    if "A" <= c <= "Z":
        return _UPPER
    if "0" <= c <= "9":
        return _DIGIT
    return _SYMBOL.get(c) or (_WIDE if c.isalpha() else _OTHER)


class _Codes(dict):
    def __missing__(self, c: str) -> int:
        found = self[c] = _symbol(c)
        return found


_CODES = _Codes()


def allowed() -> np.ndarray:
    """Penalties of transitions: the inside of a kind follows its begin or inside only."""
    out = np.zeros((TAGS, TAGS))
    for tag in range(2, TAGS, 2):
        out[:, tag] = -1e4
        out[tag - 1, tag] = out[tag, tag] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Both directions run as one stack: the second reads the window backward."""

    def __init__(self, width: int = 12, hidden: int = 20, seed: int = 5, dtype: type = np.float64):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "embed": rng.normal(0, 0.3, (SYMBOLS, width)),
            "cell": rng.normal(0, 1 / np.sqrt(width + hidden), (2, width + hidden, 4 * hidden)),
            "gate": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], hidden), (2, 1)),
            "emit": rng.normal(0, 0.3, (2 * hidden, TAGS)),
            "base": np.zeros(TAGS),
            "move": rng.normal(0, 0.1, (TAGS, TAGS)),
        }
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}
        self.dtype = dtype

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x: windows x places of symbols; emission scores and what backward needs."""
        n, t = x.shape
        e = self.p["embed"][np.stack((x, x[:, ::-1]))]  # 2, n, t, width
        h, c = np.zeros((2, n, self.h), self.dtype), np.zeros((2, n, self.h), self.dtype)
        kept, out = [], np.empty((2, t, n, self.h), self.dtype)
        for k in range(t):
            z = np.concatenate((e[:, :, k], h), axis=2)
            a = z @ self.p["cell"] + self.p["gate"][:, None]
            gates = _sigmoid(a[:, :, : 3 * self.h])
            i, f, o = gates[:, :, : self.h], gates[:, :, self.h : 2 * self.h], gates[:, :, 2 * self.h :]
            g = np.tanh(a[:, :, 3 * self.h :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, k] = h
            kept.append((z, i, f, o, g, before, tc))
        both = np.concatenate((out[0], out[1, ::-1]), axis=2)  # t, n, 2 hidden
        return both @ self.p["emit"] + self.p["base"], [x, kept, both]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss per window and its gradients; y has the tags."""
        n, t = x.shape
        scores, (_, kept, both) = self.forward(x)
        move = self.p["move"] + allowed().astype(self.dtype)
        a, b = np.empty((t, n, TAGS), self.dtype), np.zeros((t, n, TAGS), self.dtype)
        start = np.zeros(TAGS, self.dtype)
        start[2::2] = -1e4
        a[0] = scores[0] + start
        for k in range(1, t):
            a[k] = scores[k] + _lse(a[k - 1][:, :, None] + move, 1)
        for k in range(t - 2, -1, -1):
            b[k] = _lse(move + (scores[k + 1] + b[k + 1])[:, None, :], 2)
        z = _lse(a[-1], 1)
        gs = np.exp(a + b - z[:, None])
        rows, yt = np.arange(n), y.T
        gold = scores[np.arange(t)[:, None], rows, yt].sum() + move[yt[:-1], yt[1:]].sum()
        gs[np.arange(t)[:, None], rows, yt] -= 1
        gm = np.zeros((TAGS, TAGS), self.dtype)
        for k in range(t - 1):
            gm += np.exp(a[k][:, :, None] + move + (scores[k + 1] + b[k + 1] - z[:, None])[:, None, :]).sum(axis=0)
        np.add.at(gm, (yt[:-1], yt[1:]), -1)
        g = {"move": gm, "base": gs.sum(axis=(0, 1)), "emit": np.einsum("tnh,tnk->hk", both, gs)}
        gb = gs @ self.p["emit"].T
        gh = np.stack((gb[:, :, : self.h], gb[::-1, :, self.h :]))
        g["cell"], g["gate"] = np.zeros_like(self.p["cell"]), np.zeros_like(self.p["gate"])
        ge = np.empty((2, t, n, self.p["embed"].shape[1]), self.dtype)
        dh, dc = np.zeros((2, n, self.h), self.dtype), np.zeros((2, n, self.h), self.dtype)
        for k in range(t - 1, -1, -1):
            zin, i, f, o, gg, before, tc = kept[k]
            dh = dh + gh[:, k]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate(
                (dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)), axis=2
            )
            g["cell"] += zin.transpose(0, 2, 1) @ da
            g["gate"] += da.sum(axis=1)
            dz = da @ self.p["cell"].transpose(0, 2, 1)
            ge[:, k] = dz[:, :, : -self.h]
            dh, dc = dz[:, :, -self.h :], dc * f
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x.T, ge[0] + ge[1, ::-1])
        return float((z.sum() - gold) / n), {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 40, rate: float = 0.02, seed: int = 9) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, g = self.gradients(x[pick], y[pick])
            size = np.sqrt(sum((w * w).sum() for w in g.values()))
            for k, w in g.items():
                w = w * min(1.0, 5 / size)
                m[k] += 0.1 * (w - m[k])
                v[k] += 0.005 * (w * w - v[k])
                step = m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.995**t)) + 1e-8)
                self.p[k] -= (rate * (1 - t / (steps + 1)) * step).astype(self.dtype)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of every window (Viterbi)."""
        scores, _ = self.forward(x)
        t, n, _ = scores.shape
        move = self.p["move"] + allowed().astype(self.dtype)
        best, back = scores[0].copy(), np.empty((t, n, TAGS), np.int8)
        best[:, 2::2] -= 1e4
        for k in range(1, t):
            all_ = best[:, :, None] + move
            back[k] = all_.argmax(axis=1)
            best = all_.max(axis=1) + scores[k]
        out = np.empty((n, t), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = back[k][np.arange(n), out[:, k]]
        return out


def labelled(n: int = 6000, seed: int = 1) -> tuple[list[str], list[list[Span]]]:
    """Invented windows with their spans."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = lambda a=2, b=9: "".join(letters[int(i)] for i in rng.integers(0, 26, int(rng.integers(a, b))))

    def word(a: int = 2, b: int = 9) -> str:
        return pick(*_USUAL) if rng.random() < 0.5 else made(a, b)

    def number(k: int) -> str:
        body = pick("4", "5", "37", "6") + digits(k - 2)
        body = body[: k - 1]
        return body + next(c for c in "0123456789" if luhn(body + c))

    def span() -> tuple[int, str]:
        kind = int(rng.integers(4))
        if kind == 0:
            at, dot = pick(("@", "."), ("@", "."), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" {at} ", "."), (" (at) ", " (dot) "))
            user = word() + pick("", ".", "_", "-") + pick("", word(), digits(2))
            return 0, user.strip("._-") + at + made(3) + pick("", "", "-" + made(3), digits(1)) + dot + pick("com", "org", "net", "de", "fr", "co" + dot + "uk", "example" + dot + "com")
        if kind == 1:
            sep = pick(".", ".", " . ", "[.]")
            return 1, sep.join(str(int(x)) for x in rng.integers(0, 256, 4))
        if kind == 2:
            d = number(pick(15, 16, 16, 16))
            sep = pick("", " ", "-", ".", ".", "/", "/", " - ", "_", "\u00a0")
            return 2, sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        a, b, c = digits(3), digits(3), digits(4)
        two = digits(2)
        return 3, pick(
            f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{two} {a} {b}{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"00{two} {a} {b} {c}", f"{a}.{b}.{c}",
            f"0{two}/{b}{c}", f"0{two} / {b}{c}", f"0{a}/{b}{c}", f"0{a} {b}{c}", f"0{two}-{b}{c}", f"(0{two}) {b}{c}", f"0{two} {two} {digits(2)} {digits(2)} {digits(2)}",
            f"tel: {a} {b} {c}"[5:], f"+{two}/{a}/{b}{c}",
        )

    def other() -> str:
        return pick(
            f"version {digits(1)}.{digits(1)}", f"{digits(4)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"{digits(2)}:{digits(2)}",
            "".join("0123456789abcdef"[int(i)] for i in rng.integers(0, 16, 40)), digits(10), digits(16), digits(7), f"{digits(2)}.{digits(3)}",
            f"@{word()}", f"{word()} @ {word()}", f"({word()})", f"[{word()}]", f"{word()} at {word()} dot", f"{digits(3)},{digits(3)},{digits(3)}",
            f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"{digits(1)}/{digits(2)}/20{digits(2)}", f"{digits(5)}/{digits(2)}",
            f"ISBN 978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"No. {digits(8)}", f"{digits(2)}, {digits(2)}, {digits(2)}, {digits(2)}",
            f"#{digits(6)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"token = \"{digits(20)}\"", f"{digits(3)}-{digits(4)}",
        )

    texts, spans = [], []
    for _ in range(n):
        text, found = word() + pick(" ", ". ", "\n"), []
        while len(text) < WINDOW + 40:
            r = rng.random()
            if r < 0.18:
                kind, s = span()
                found.append((len(text), kind, len(text) + len(s)))
                text += s
            else:
                text += other() if r < 0.34 else word().title() if r < 0.4 else word()
            text += pick(" ", " ", " ", ". ", ", ", "\n", "### ", "!! ")
        cut = int(rng.integers(0, 40))
        texts.append(text[cut : cut + WINDOW])
        spans.append([(max(a - cut, 0), k, min(b - cut, WINDOW)) for a, k, b in found if b > cut and a < cut + WINDOW])
    return texts, spans


def coded(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), WINDOW), np.int64)
    for k, t in enumerate(texts):
        x[k, : len(t)] = [_CODES[c] for c in t]
    return x


def tagged(spans: list[list[Span]]) -> np.ndarray:
    y = np.zeros((len(spans), WINDOW), np.int64)
    for row, found in zip(y, spans):
        for a, kind, b in found:
            row[a:b] = 2 * kind + 2
            row[a] = 2 * kind + 1
    return y


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger; its training depends on nothing outside, so it is kept.

    Its own figures are in the README: recall by kind on hand-written and on fresh
    invented sentences, and false alarms.
    """
    texts, spans = labelled()
    return Tagger(dtype=np.float32).fit(coded(texts), tagged(spans))


# ---------------------------------------------------------------- whole texts


def _valid(kind: int, text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|[(\[{] ?at ?[)\]}]) ?[\w-]+( ?(\.|[(\[{] ?dot ?[)\]}]) ?[\w-]+)+", text))
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 15 <= len(digits) <= 16 and luhn(digits) and not re.search(r"[A-Za-z]", text)
    if "/" in text and text[0] not in "0+(":
        return False
    return 10 <= len(digits) <= 15 and bool(re.search(r"[(). +/-]", text)) and not re.search(r"[A-Za-z\n]", text)


def windows(text: str) -> list[int]:
    """Starts of the windows with a signal; neighbours overlap by half."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out: set[int] = set()
    for m in SIGNAL.finditer(text):
        k = m.start() // STRIDE
        out.update(x for x in (k - 1, k) if 0 <= x <= last)
    return [k * STRIDE for k in sorted(out)]


def reconcile(text: str, starts: list[int], tags: np.ndarray) -> list[Span]:
    """One tag for every character, from its most central window; then spans."""
    chosen: dict[int, tuple[float, int]] = {}
    middle = (WINDOW - 1) / 2
    for start, row in zip(starts, tags):
        for k in np.flatnonzero(row):
            if start + k < len(text):
                chosen.setdefault(start + int(k), (1e9, 0))
    for start, row in zip(starts, tags):
        for at in range(start, min(start + WINDOW, len(text))):
            if at in chosen and abs(at - start - middle) < chosen[at][0]:
                chosen[at] = (abs(at - start - middle), int(row[at - start]))
    out: list[list[int]] = []
    for at in sorted(chosen):
        tag = chosen[at][1]
        if not tag:
            continue
        kind, begins = (tag - 1) // 2, tag % 2 == 1
        if out and out[-1][2] == at and out[-1][1] == kind and not begins:
            out[-1][2] = at + 1
        else:
            out.append([at, kind, at + 1])
    return [(a, k, b) for a, k, b in out]


def find(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, spans added by the network) of whole texts."""
    got, todo = [], []
    for k, text in enumerate(texts):
        text = text or ""
        got.append(([*patterns(text)], []))
        todo += [(k, s) for s in windows(text)]
    tags = {}
    for at in range(0, len(todo), 512):
        part = todo[at : at + 512]
        rows = tagger.decode(coded([texts[k][s : s + WINDOW] for k, s in part]))
        for (k, s), row in zip(part, rows):
            if row.any():
                tags.setdefault(k, []).append((s, row))
            else:
                tags.setdefault(k, []).append((s, row))
    for k, found in tags.items():
        text, (base, added) = texts[k], got[k]
        for a, kind, b in reconcile(text, [s for s, _ in found], np.array([r for _, r in found])):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1] in " \n.,:;!?":
                b -= 1
            clear = all(b <= x or a >= y for x, _, y in base)
            if b > a and clear and _valid(kind, text[a:b]):
                added.append((a, kind, b))
    return got


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the patterns' number of each kind, base_sha256, spans (all)
    and n_added (those that the network added)."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tagger = sent.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for base, added in find(part.column("text").to_pylist(), tagger):
                    n = [sum(1 for _, k, _ in base if k == j) for j in range(len(KINDS))]
                    digest = sha256(_joined(base).encode()).hexdigest()
                    rows.append((*n, digest, _joined(base + added), len(added)))
                yield {"doc_id": part.column("doc_id")} | dict(zip(names, map(list, zip(*rows))))

    counts = ", ".join(f"{n} bigint" for n in names[: len(KINDS)])
    schema = f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added bigint"
    return map_batches(docs.select("doc_id", "text"), run, schema)


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """doc_id and text with every span replaced by its kind in ``mask``."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch):
                texts, out = part.column("text").to_pylist(), []
                for text, (base, added) in zip(texts, find(texts, sent.value)):
                    text, done, made = text or "", 0, []
                    for a, k, b in sorted(base + added):
                        if a >= done:
                            made += [text[done:a], mask.format(KINDS[k])]
                        done = max(done, b)
                    out.append("".join(made) + text[done:])
                yield {"doc_id": part.column("doc_id"), "text": out}

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, text string")
