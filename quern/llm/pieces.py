"""SentencePiece encoding and decoding by N-best segmentation.

Every way to write a text as pieces of a model's vocabulary is a path in a
lattice. A forward Viterbi pass gives each place the best score of reaching
it; these scores are exact heuristics for an A-star search that runs backward
from the end, so the N best paths come out in order and nothing is explored
in vain.

No piece runs on past the start of a word (a space mark that follows another
sign), nor from a letter to most signs, so the lattice falls apart there: such
units (and the parts of very long ones that no piece crosses) are searched
alone, those seen before are remembered, and the N best of a text are put
together from the N best of its units, without loss.

Scores are those of the model. A character without a piece of its own is
written as its UTF-8 bytes, at the score of the worst piece less ten.

The model's file is a parameter; it is read by the driver and sent to the
workers as bytes.

Defined cases: a null text encodes like an empty one, to no pieces; equal
scores go to the segmentation with the longer last piece, then the longer one
before; any string of Unicode characters decodes to itself; other columns of
the input are ignored.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Iterator, Sequence
from functools import cached_property
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held, map_batches, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SIGNS = ".,;:!?|%#$&*\"'()[]{}<>=+-/\\@^~`"
UNKNOWN = 10.0
REMEMBERED = 400_000
LONGEST = 512  # letters of the words that are remembered, and more than any piece has


_MARKS = [chr(k) for k in range(LONGEST)]


def _mark(place: int) -> str:
    return _MARKS[place] if place < LONGEST else chr(min(place, 0x10FFFF))


def packed(ids: Sequence[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}i", *ids)


class Pieces:
    """Encodes and decodes with the pieces and scores of one model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.score: dict[str, tuple[float, int]] = {}
        for i, name in enumerate(self.names):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                if not self._inner(name):
                    self.score[name] = (sp.get_score(i), i)
        usual = [s for s, _ in self.score.values() if s > -1e8]
        self.unknown = min(usual) - UNKNOWN
        # character -> [what may follow, (score, ids) of the piece so far or None], from both ends
        self.trie: dict = {}
        self.back: dict = {}
        for name, (s, i) in self.score.items():
            for node, letters in ((self.trie, name), (self.back, name[::-1])):
                for c in letters:
                    here = node.setdefault(c, [{}, None])
                    node = here[0]
                here[1] = (s, (i,))
        self.text = [b"" if i in self.of_byte else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        for i, b in self.of_byte.items():
            self.text[i] = bytes((b,))
        self.unit = re.compile(self._units())
        self.known: dict[str, tuple] = {}

    @cached_property
    def mark(self) -> tuple[float, float, int, bytes, bytes]:
        """What ``seen`` gives for a mark of the text itself: its bytes, in one way only."""
        sign = SPACE.encode()
        return self.unknown, float("inf"), len(sign), packed([self.byte[x] for x in sign]), sign

    @staticmethod
    def _inner(name: str) -> bool:
        return SPACE in name.lstrip(SPACE)

    def _units(self) -> str:
        """The pattern of what is searched alone.

        A unit also ends between a letter and a sign that follows no letter in
        any piece.
        """
        joined = {y for n in self.score for x, y in zip(n, n[1:]) if x.isalpha()}
        apart = re.escape("".join(c for c in SIGNS if c not in joined))
        after = f"{SPACE}*+[^\\W\\d_]++(?=[{apart}])|" if apart else ""
        return f"{after}{SPACE}++[^{SPACE}]*+|[^{SPACE}]++"

    # ------------------------------------------------------------ one unit

    def forward(self, word: str) -> list[float]:
        """The best score of reaching every place (Viterbi)."""
        n, trie, unknown = len(word), self.trie, self.unknown
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        a = 0
        for so_far in best:  # all ways to a are known when it is reached
            b, node, alone = a, trie, False
            for c in word[a : a + LONGEST]:
                here = node.get(c)
                if here is None:
                    break
                b += 1
                node, found = here
                if found is not None:
                    way = so_far + found[0]
                    if way > best[b]:
                        best[b] = way
                    if b - a == 1:
                        alone = True
            a += 1
            if not alone and a <= n and so_far + unknown > best[a]:
                best[a] = so_far + unknown
        return best

    def search(self, word: str, n: int, ids_of_last: bool = True) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a unit, best first: A-star from its end,
        with the forward scores as the exact cost of what is still to come.

        As they are exact, the first of the queue has the score of the next best
        whole path; without ``ids_of_last`` the last one is not walked further.
        Of equal scores, the longer last piece comes first, then the longer one
        before it, and so on for ``LONGEST`` pieces.
        """
        best, unknown = self.forward(word), self.unknown
        todo: list[tuple] = []  # loss, order, place, turn, score of what follows, pieces that follow
        turn = count()
        out: list[tuple[float, tuple[int, ...]]] = []
        order, b, tail, after = "", len(word), 0.0, ()
        while True:
            if b:
                a, node, alone, long = b, self.back, False, len(order) >= LONGEST
                while a:  # pieces that end at b
                    here = node.get(word[a - 1])
                    if here is None:
                        break
                    a -= 1
                    node, found = here
                    if found is not None:
                        more = found[0] + tail
                        heappush(todo, (-best[a] - more, order if long else order + _mark(a), a, next(turn), more, (found[1], after)))
                        if b - a == 1:
                            alone = True
                if not alone:
                    a, more = b - 1, unknown + tail
                    one = tuple(self.byte[x] for x in word[a].encode())
                    heappush(todo, (-best[a] - more, order if long else order + _mark(a), a, next(turn), more, (one, after)))
            else:
                ids: list[int] = []
                while after:
                    one, after = after
                    ids.extend(one)
                out.append((tail, tuple(ids)))
                if len(out) == n:
                    break
            if not todo:
                break
            if not ids_of_last and len(out) == n - 1:
                out.append((-todo[0][0], ()))
                break
            _, order, b, _, tail, after = heappop(todo)
        return out

    def seen(self, word: str) -> tuple[float, float, int, bytes, bytes]:
        """Score of a unit's best segmentation, what the second loses against it, and
        the best's number of pieces, packed ids, and decoded bytes."""
        found = self.known.get(word)
        if found is None:
            (best, ids), *rest = self.search(word, 2, ids_of_last=False)
            loses = best - rest[0][0] if rest else float("inf")
            text = self.text
            found = best, loses, len(ids), packed(ids), b"".join([text[i] for i in ids])
            if len(word) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def _apart(self, word: str) -> Iterator[str]:
        """A long unit in parts that no piece crosses, so that lattices stay small."""
        start = reach = 0
        for a in range(len(word)):
            if a == reach and a > start:
                yield word[start:a]
                start = a
            node, b = self.trie, a
            reach = max(reach, a + 1)
            while b < len(word) and (here := node.get(word[b])) is not None:
                b += 1
                node = here[0]
                if here[1] is not None:
                    reach = max(reach, b)
        yield word[start:]

    # ------------------------------------------------------------ texts

    def units(self, text: str) -> list[str | None]:
        """What is searched alone: a mark is put before the text and for every space
        of it. None stands for each mark that the text has itself."""
        if not text:
            return []
        if SPACE in text:
            first, *rest = text.split(SPACE)
            out: list[str | None] = self.unit.findall(SPACE + first.replace(" ", SPACE))
            for part in rest:
                out.append(None)
                out.extend(self.unit.findall(part.replace(" ", SPACE)))
        else:
            out = self.unit.findall(SPACE + text.replace(" ", SPACE))
        if len(text) > LONGEST and max(map(len, filter(None, out))) > LONGEST:
            out = [x for u in out for x in (self._apart(u) if u and len(u) > LONGEST else (u,))]
        return out

    def summary(self, text: str | None) -> tuple[float, float | None, int, bytes, bytes]:
        """Score of the best segmentation and of the second (None if there is
        none), number of pieces, packed ids, and the decoded bytes."""
        text = text or ""
        known = self.known.get
        units = self.units(text)
        parts = list(map(known, units))
        if None in parts:
            parts = [p or (self.mark if u is None else self.seen(u)) for p, u in zip(parts, units)]
        if not parts:
            return 0.0, None, 0, b"", b""
        best, loses, n, ids, back = zip(*parts)
        total, least = sum(best), min(loses)
        second = total - least if least < float("inf") else None
        return total, second, sum(n), b"".join(ids), b"".join(back)

    def encode(self, text: str | None) -> tuple[float, list[int]]:
        """Score and piece ids of the best segmentation.

        A mark that the text has itself is written as bytes.
        """
        (found,) = self.nbest_encode(text, 1)
        return found

    def nbest_encode(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a whole text with their scores."""
        parts = [
            [(self.unknown, tuple(self.byte[x] for x in SPACE.encode()))] if u is None else self.search(u, n)
            for u in self.units(text or "")
        ]
        total = sum(p[0][0] for p in parts)
        return [
            (total - lost, [x for k, p in enumerate(parts) for x in p[picked.get(k, 0)][1]])
            for lost, picked in self._choices(parts, n)
        ]

    @staticmethod
    def _choices(parts: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, dict[int, int]]]:
        """The ``n`` cheapest ways to pick one segmentation for each unit."""
        ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        gap = {k: p[0][0] - p[1][0] for k, p in enumerate(parts) if len(p) > 1}
        # the n best ways change none but the n - 1 units whose second choice loses least
        for k in sorted(gap, key=lambda k: (gap[k], k))[: n - 1]:
            grown = [
                (lost + parts[k][0][0] - parts[k][j][0], (*picked, (k, j)))
                for lost, picked in ways
                for j in range(1, len(parts[k]))
            ]
            ways = sorted(ways + grown)[:n]
        return [(lost, dict(picked)) for lost, picked in ways]

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; the space of the leading mark is taken off."""
        return b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")[1:]


HOLDS = "pieces"


def _made(model: bytes) -> Pieces:
    made = Pieces(model)
    gc.freeze()  # its tables stay; the collector needn't walk them again and again
    return made


def _worker(model: bytes) -> Pieces:
    """One for each Python worker, so that units stay remembered between tasks."""
    return held(HOLDS, model, lambda: _made(model))


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The bytes of the model's file, which lies on the driver or, with a scheme, in shared storage."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as file:
        return file.read()


def encode(spark: SparkSession, docs: DataFrame, path: str = MODEL, pack: bool = False) -> DataFrame:
    """Per row: doc_id, n_chars, n_pieces, best_score, second_score, ids (an array,
    or little-endian 32-bit integers if ``pack``) and decoded (the text they give)."""
    sent = spark.sparkContext.broadcast(read_model(spark, path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("n_chars", "n_pieces", "best_score", "second_score", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = _worker(sent.value)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                rows = []
                for text in part.column("text").to_pylist():
                    best, second, n, ids, back = pieces.summary(text)
                    rows.append((len(text or ""), n, best, second, ids, back[1:]))
                out = dict(zip(names, map(list, zip(*rows))))
                if not pack:
                    ends = np.concatenate(([0], np.cumsum(out["n_pieces"]))).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(out["ids"]), "<i4"))
                yield {"doc_id": part.column("doc_id")} | out

    return map_batches(
        docs.select("doc_id", "text"), run,
        f"doc_id {kind}, n_chars bigint, n_pieces bigint, best_score double, second_score double,"
        f" ids {'binary' if pack else 'array<int>'}, decoded string",
        HOLDS,
    )


def decode(spark: SparkSession, encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (an array); null ids give an empty text."""
    sent = spark.sparkContext.broadcast(read_model(spark, path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = _worker(sent.value)
        for batch in batches:
            for part in slices(batch):
                text = [pieces.decode(x or []) for x in part.column("ids").to_pylist()]
                yield {"doc_id": part.column("doc_id"), "text": text}

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string", HOLDS)
