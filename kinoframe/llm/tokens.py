"""Exact library encodings with the units of a text encoded once and remembered.

A *unit* is a stretch of text after which the pre-tokenizer always cuts, so that the ids of a text are the ids of its
units one after another. Words repeat, so a bounded memo of units saves most of the library's work; texts whose white
space is not plain (runs of blanks, blanks beside line ends, other spaces at a unit's edge) go to the library whole.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

#: Units a worker remembers at most (some 100 bytes each), and the longest unit it remembers, in characters.
MEMO_UNITS, MEMO_CHARS = 500_000, 40


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's tokenizer, one a process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def bare(path: str):
    """The same without its normaliser."""
    from tokenizers import Tokenizer, normalizers

    tok = Tokenizer.from_file(path)
    tok.normalizer = normalizers.Sequence([])
    return tok


class Memo:
    """Values of units, each learned once while there is room."""

    def __init__(self, room: int = MEMO_UNITS):
        self.room, self.memo = room, {}

    def learn(self, missing: set[str]) -> dict:
        """Values of units; one that has none sends its texts the whole way."""
        raise NotImplementedError

    def values(self, units: list[list[str] | None]) -> list[list | None]:
        """The remembered value of every unit of every text; None for a text that must go whole."""
        memo, get = self.memo, self.memo.get
        found, holes, missing = [], [], set()
        for u in units:
            v = None if u is None else list(map(get, u))
            gaps = []
            if v is not None and None in v:
                at = -1
                try:
                    while True:
                        at = v.index(None, at + 1)
                        gaps.append(at)
                except ValueError:
                    missing.update([u[i] for i in gaps])
            found.append(v)
            holes.append(gaps)
        fresh = self.learn(missing)
        for k, (v, gaps) in enumerate(zip(found, holes)):
            for i in gaps:
                if (x := fresh.get(units[k][i])) is None:
                    found[k] = None
                    break
                v[i] = x
        # when it is full, what came first is what is common, so it stays, and new units serve their batch alone
        if len(memo) < self.room:
            memo.update((k, v) for k, v in fresh.items() if len(k) <= MEMO_CHARS)
        return found


class Units(Memo):
    """Base: how a text is cut, and how missing units are encoded together. ``width``: bytes an id."""

    def __init__(self, path: str, width: int = 4, memo_units: int = MEMO_UNITS):
        super().__init__(memo_units)
        self.tok, self.width = library(path), width
        self.marks = {m: self.packed(self.tok.encode(m, add_special_tokens=False).ids) for m in ",."}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def plain(self, unit: str) -> bool:
        """Whether nothing at the edges of the unit can join its neighbours."""
        raise NotImplementedError

    def call(self, joined: str):
        return self.tok.encode(joined, add_special_tokens=False)

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of units that are not in the memo: many joined in one call, dealt back by their offsets."""
        # a letter, then one full stop or comma at the end: the cut between them is certain, and the word alone is commoner
        # (a letter still in lower case: that of a dotted capital I ends in a mark, which joins the stop)
        marked = [u for u in missing if u[-1:] in ",." and u[-2:-1].lower().isalpha()]
        words = missing.difference(marked)
        words.update({u[:-1] for u in marked}.difference(self.memo))
        out = {}
        plain = list(filter(self.plain, words))
        for a in range(0, len(plain), 256):
            part = plain[a : a + 256]
            joined, begins = self.join(part)
            enc = self.call(joined)
            spans = enc.offsets
            cuts = np.searchsorted(np.array([x[0] for x in spans]), begins).tolist() + [len(spans)]
            self.deal(out, part, enc.ids, spans, cuts, begins)
        for u in marked:
            if (v := out.get(w := u[:-1]) or self.memo.get(w)) is not None:
                out[u] = self.add(v, u)
        return out

    def deal(self, out, part, ids, spans, cuts, begins) -> None:
        data, w = self.packed(ids), self.width
        for u, a, b in zip(part, cuts, cuts[1:]):
            out[u] = data[w * a : w * b]

    def add(self, value, unit: str):
        return value + self.marks[unit[-1]]


class Dropped(Units):
    """For vocabularies that drop white space: units are the stretches between blanks and line ends.

    ``low``: the vocabulary composes and lowers texts itself, so that units may be lowered first.
    """

    def __init__(self, path: str, width: int = 4, low: bool = True, memo_units: int = MEMO_UNITS):
        super().__init__(path, width, memo_units)
        self.low, self.bare = low, bare(path)

    def plain(self, unit: str) -> bool:
        return True

    def join(self, part: list[str]) -> tuple[str, np.ndarray]:
        sizes = np.array([len(u) + 1 for u in part])
        return " ".join(part), np.cumsum(sizes) - sizes

    def call(self, joined: str):
        # what the normaliser would leave as it is need not pass it
        done = self.low and joined == joined.lower() and is_normalized("NFC", joined)
        return (self.bare if done else self.tok).encode(joined, add_special_tokens=False)

    def lowered(self, text: str) -> str:
        """In lower case where the library, which composes first and lowers letter by letter, gives the same."""
        low = text.lower()
        return low if text.isascii() or ("Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)) else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned ids of each text."""
        values = self.values([(self.lowered(t) if self.low else t).replace("\n", " ").split(" ") for t in texts])
        return [b"".join(v) for v in values]


@lru_cache(maxsize=1)
def dropped(path: str, width: int = 4) -> Dropped:
    """One a process, so that tasks find what those before them learned."""
    return Dropped(path, width)


class Led(Units):
    """For byte-level vocabularies whose words carry the blank before them.

    Cuts lie before a single blank, or a single line end, that has no white space beside it. A unit is kept without its
    blank; one that begins a line keeps the line end.
    """

    def __init__(self, path: str, spans: bool = False, memo_units: int = MEMO_UNITS):
        super().__init__(path, 4, memo_units)
        self.spans = spans

    def plain(self, unit: str) -> bool:
        body = unit[1:] if unit[:1] == "\n" else unit
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def join(self, part: list[str]) -> tuple[str, np.ndarray]:
        led = [u if u[0] == "\n" else f" {u}" for u in part]
        sizes = np.array([len(u) for u in led])
        return "".join(led), np.cumsum(sizes) - sizes

    def deal(self, out, part, ids, spans, cuts, begins) -> None:
        if not self.spans:
            return super().deal(out, part, ids, spans, cuts, begins)
        counts = np.diff(cuts)
        data = (np.array(spans, np.int64).reshape(-1, 2) - np.repeat(begins, counts)[:, None]).astype("<i4").tobytes()
        for u, a, b in zip(part, cuts, cuts[1:]):
            out[u] = (b - a, data[8 * a : 8 * b])

    def add(self, value, unit: str):
        if not self.spans:
            return super().add(value, unit)
        end = len(unit) + (unit[0] != "\n")
        return value[0] + 1, value[1] + struct.pack("<ii", end - 1, end)

    def encode(self, texts: list[str]) -> list:
        """Ids of each text as little-endian unsigned 32-bit bytes; with ``spans``: an array of (begin, end) in characters."""
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        # the first unit has no blank before it: with one token sequence a text, the library takes it alone
        first = [c[0] for c in cut]
        whole = [i for i, f in enumerate(first) if not f or f[0].isspace() or f[-1].isspace()]
        for i in whole:
            cut[i] = None
        values = self.values([None if c is None else c[1:] for c in cut])
        heads = self.tok.encode_batch([f if cut[i] is not None and values[i] is not None else texts[i] for i, f in enumerate(first)], add_special_tokens=False)
        if not self.spans:
            own = [np.array(h.ids, "<u4").tobytes() for h in heads]
            return [h if v is None else h + b"".join(v) for h, v in zip(own, values)]
        out = []
        for i, (h, v) in enumerate(zip(heads, values)):
            head = np.array(h.offsets, np.int64).reshape(-1, 2)
            if v:
                begins = np.cumsum([len(first[i]), *[len(u) + (u[0] != "\n") for u in cut[i][1:-1]]])
                counts = [x[0] for x in v]
                rest = np.frombuffer(b"".join([x[1] for x in v]), "<i4").reshape(-1, 2) + np.repeat(begins, counts)[:, None]
                head = np.concatenate([head, rest])
            out.append(head)
        return out
