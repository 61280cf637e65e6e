"""All keywords of all gates in one pass over a text: an automaton as a numpy table, stepped over the joined bytes of many texts.

Each gate is a group of lower-case words and has a bit; a text's mask has the bits of the groups of which it holds a word,
case ignored.  Masks are arrays of longs with PER_LONG bits each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .normalize import SEGMENT_BYTES, normalize_text

PER_LONG = 60
#: Bytes that a lane steps through, and bytes of texts that are stepped at a time (a longer text is stepped alone, whole).
LANE, JOINED = 512, 1 << 22
_END = 0xFF  # in no text, since UTF-8 has no such byte
#: The only characters beyond ASCII whose lower case holds ASCII letters.
_KELVIN, _DOTTED = "\u212a".encode(), "\u0130".encode()

Groups = tuple[tuple[str, ...], ...]


class Automaton:
    """States by byte classes; upper-case letters share the class of their lower case."""

    def __init__(self, groups: Groups):
        words = [(w.encode(), g) for g, group in enumerate(groups) for w in group if w == w.lower()]  # others match no lower-cased text
        if any(not w or not w.isascii() for w, _ in words):
            raise ValueError("keywords are words of ASCII characters")
        alphabet = sorted({b for w, _ in words for b in w})
        self.classes = np.zeros(256, np.uint8)
        for k, b in enumerate(alphabet, 1):
            self.classes[b] = k
            if 97 <= b <= 122:
                self.classes[b - 32] = k
        width, longs = len(alphabet) + 1, -(-len(groups) // PER_LONG)
        steps, bits = [[0] * width], [0]
        for w, g in words:
            at = 0
            for b in w:
                c = int(self.classes[b])
                if not steps[at][c]:
                    steps.append([0] * width)
                    bits.append(0)
                    steps[at][c] = len(steps) - 1
                at = steps[at][c]
            bits[at] |= 1 << g
        fall, queue = [0] * len(steps), [s for s in steps[0] if s]
        for at in queue:  # by depth: what a state falls back to is complete before
            bits[at] |= bits[fall[at]]
            for c in range(width):
                to = steps[at][c]
                if to:
                    fall[to] = steps[fall[at]][c]
                    queue.append(to)
                else:
                    steps[at][c] = steps[fall[at]][c]
        self.width, self.longs, self.overlap = width, max(longs, 1), max((len(w) for w, _ in words), default=1) - 1
        self.steps = (np.array(steps, np.int32) * width).ravel()  # states are told by where their row begins
        self.bits = np.array([[b >> PER_LONG * k & (1 << PER_LONG) - 1 for k in range(self.longs)] for b in bits], np.int64)
        self.tells = np.repeat(self.bits.any(axis=1), width)

    def masks(self, texts: Sequence[str | bytes | None]) -> np.ndarray:
        """A row of longs for each text; a text that is null has no bit."""
        out = np.zeros((len(texts), self.longs), np.int64)
        data, begin, size = [], 0, 0
        for k, text in enumerate(texts):
            one = _bytes(text)
            if data and size + len(one) > JOINED:
                self._step(data, out[begin:k])
                data, begin, size = [], k, 0
            data.append(one)
            size += len(one) + 1
        if data:
            self._step(data, out[begin:])
        return out

    def _step(self, data: list[bytes], out: np.ndarray) -> None:
        """Cuts the joined bytes into lanes, which overlap by the longest word, and steps all lanes side by side."""
        joined = np.frombuffer(b"\xff".join(data), np.uint8)
        n = len(joined)
        if not n:
            return
        ends = np.cumsum([len(d) + 1 for d in data])
        lane = min(LANE, n)
        lanes, back = -(-n // lane), self.overlap
        padded = np.full(back + lanes * lane, _END, np.uint8)
        padded[back : back + n] = joined
        side_by_side = np.lib.stride_tricks.as_strided(self.classes[padded], (lane + back, lanes), (1, lane))
        state, found = np.zeros(lanes, np.int32), []
        starts = np.arange(lanes, dtype=np.int64) * lane - back
        for k in range(lane + back):
            state = self.steps[state + side_by_side[k]]
            if k >= back:  # before, the lane to the left reports
                hit = np.flatnonzero(self.tells[state])
                if len(hit):
                    found.append(np.stack([starts[hit] + k, state[hit]]))
        if found:
            at, state = np.concatenate(found, axis=1)
            told = np.unique(np.searchsorted(ends, at, "right") * np.int64(len(self.bits)) + state // self.width)
            np.bitwise_or.at(out, told // len(self.bits), self.bits[told % len(self.bits)])


def _bytes(text: str | bytes | None) -> bytes:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    if not data.isascii() and (_KELVIN in data or _DOTTED in data):
        data = data.decode("utf-8", "replace").lower().encode("utf-8")
    return data


@lru_cache(maxsize=16)
def automaton(groups: Groups) -> Automaton:
    """Built once in each worker."""
    return Automaton(groups)


class Gates:
    """The bits of named groups: the pre-screen, the categories, and the literals that rules need."""

    def __init__(self, needs: Sequence[tuple[str, ...]] = ()):
        self.groups: Groups = (tuple(fixed.PRESCREEN), *(tuple(w) for w in fixed.CATEGORY_KEYWORDS.values()), *dict.fromkeys(needs))
        self.bit: dict = {"screened": 0} | {c: k for k, c in enumerate(fixed.CATEGORY_KEYWORDS, 1)}
        self.bit |= {words: k for k, words in enumerate(self.groups) if k >= len(self.bit)}

    def sql(self, mask: str, gate) -> str:
        """A test of a mask in SQL.  gate: "screened", a category, or a tuple of literals."""
        at = self.bit[gate]
        return f"getbit({mask}[{at // PER_LONG}], {at % PER_LONG}) = 1"

    def test(self, mask: Column, gate) -> Column:
        at = self.bit[gate]
        return F.getbit(F.get(mask, at // PER_LONG), F.lit(at % PER_LONG)) == 1

    def masks(self, text: Column, first_bytes: int | None = None) -> Column:
        """The mask of a whole text, or of its first bytes."""
        groups = self.groups

        @F.arrow_udf("array<bigint>")
        def keyword_masks(texts: pa.Array) -> pa.Array:
            return _lists([t and t[:first_bytes] for t in _raw(texts)], groups, texts)

        return keyword_masks(text)

    def segment(self, text: Column) -> Column:
        """(norm, raw_mask, norm_mask) of a segment: its normalised text and the masks of its first bytes before and after."""
        groups = self.groups

        @F.arrow_udf("norm string, raw_mask array<bigint>, norm_mask array<bigint>")
        def normalized_with_masks(texts: pa.Array) -> pa.Array:
            raw = _raw(texts)
            norm = [None if t is None else normalize_text(t.decode("utf-8", "replace")) for t in raw]
            names = ["norm", "raw_mask", "norm_mask"]
            return pa.StructArray.from_arrays([pa.array(norm, pa.string()), _lists([t and t[:SEGMENT_BYTES] for t in raw], groups, texts), _lists(norm, groups, texts)], names)

        return normalized_with_masks(text)


def _raw(texts: pa.Array) -> list[bytes | None]:
    """As bytes, since a text that was cut may end amid a character."""
    return texts.cast(pa.binary()).to_pylist()


def _lists(texts: list, groups: Groups, like: pa.Array) -> pa.Array:
    masks = automaton(groups).masks(texts)
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * masks.shape[1], mask=np.append(like.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(masks.ravel()))
