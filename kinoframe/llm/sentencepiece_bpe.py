"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A text's encoding is the one sequence of pieces in which every adjacent pair is compatible: merging the pair's
characters anew gives the pair back. The encoder walks the text with the longest piece that an Aho-Corasick automaton
finds at each position, falls back to the longest shorter prefix where a pair is not compatible, steps back where none
is left, and remembers failed positions in a bitfield, so that no position fails twice. Characters without a piece
become bytes. Pieces that merging never makes are left out of the automaton.

White space: each blank becomes U+2581 and one is put in front. No piece holds that mark after another character, nor a
line end, so stretches between them are encoded once and remembered by the process, from task to task. No piece holds a full stop
or comma after a letter either (a model that has such a piece is asked), so a stretch that ends in one is its word and the mark.

Defined results: a null or empty text has no ids; a very long text is encoded whole, stretch by stretch; repeated rows encode
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from kinoframe.llm.base import map_texts, only
from kinoframe.llm.tokens import MEMO_UNITS, Memo

MARK = "▁"
STRETCH = re.compile(f"{MARK}+[^{MARK}]*")
#: Remembered pairs.
PAIRS = 400_000


class Vocabulary:
    """Pieces of a model with merges, and what backtracking needs of them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.made = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.made), "") for p in self.made}
        #: Ids of marks that no piece holds after a letter.
        self.ends = {c: self.ids[c] for c in ".," if c in self.ids and not any(a.isalpha() and b == c for p in self.ids for a, b in zip(p, p[1:]))}
        self.automaton = ahocorasick.Automaton()
        for p in self.made:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The definition: merge the adjacent pair whose piece scores highest, the leftmost of equals, while any has one."""
        parts, score = list(text), self.scores.get
        gains = [score(a + b) for a, b in zip(parts, parts[1:])]
        while (best := max((g for g in gains if g is not None), default=None)) is not None:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i])
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1])
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of both anew gives both."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            known = self.merged(a + b) == [a, b]
            if len(self.pairs) < PAIRS:
                self.pairs[key] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose blanks are marks already."""
        n = len(text)
        longest = [0] * n
        for end, k in self.automaton.iter(text):  # ends rise, so the last match from a start is its longest
            longest[end - k + 1] = k
        out: list[str] = []
        at, failed, piece = 0, bytearray(n // 8 + 1), None
        pairs, shorter = self.pairs, self.shorter
        while at < n:
            if piece is None:
                piece = text[at : at + (longest[at] or 1)]
            last = out[-1] if out else None
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or (pairs.get((last, piece)) if (last, piece) in pairs else self.compatible(last, piece))):
                    break
                piece = shorter.get(piece, "")
            if piece:
                out.append(piece)
                at, piece = end, None
            else:  # nothing fits here: never come here again, and take a shorter piece before it
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(text):
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder(Memo):
    """Whole texts, stretch by stretch; a value is (ids, the ids in decimal with a comma after each)."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS // 2):
        super().__init__(memo_units)
        self.words = vocabulary(path)

    def learn(self, missing: set[str]) -> dict:
        out, ends = {}, self.words.ends
        marked = [u for u in missing if u[-1:] in ends and u[-2:-1].isalpha()]
        plain = missing.difference(marked)
        plain.update({u[:-1] for u in marked}.difference(self.memo))
        for u in plain:
            ids = self.words.encode(u if u[:1] in (MARK, "\n") else MARK + u)
            out[u] = (ids, "".join([f"{i}," for i in ids]))
        for u in marked:
            ids, text = out.get(u[:-1]) or self.memo[u[:-1]]
            out[u] = ([*ids, end := ends[u[-1]]], f"{text}{end},")
        return out

    def cut(self, text: str) -> list[str]:
        """Stretches of a text; one that begins with neither mark nor line end has a single mark before it."""
        if not text:
            return []
        if MARK not in text:
            units = text.replace("\n", " \n").split(" ")
            if "" not in units:
                return units
            if units[0] == "" and len(units) > 1 and units[1][:1] == "\n" and "" not in units[1:]:
                return [MARK, *units[1:]]
        return STRETCH.findall(MARK + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        return [(list(chain.from_iterable([x[0] for x in v])), "".join([x[1] for x in v])[:-1]) for v in self.values([self.cut(t) for t in texts])]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One a process, so that tasks find what those before them learned."""
    return Encoder(path, MEMO_UNITS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, for rows of (doc_id, text)."""

    def make():
        encoder = encoder_of(path)

        def work(ids, texts):
            found = [x[0] for x in encoder.encode([t or "" for t in texts])]
            return {"doc_id": ids, "ids": found, "decoded": encoder.words.library.decode(found, num_threads=1)}

        return work

    return map_texts(docs, make, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids and digests of the ids and of the decoded text, without moving the ids."""

    def make():
        encoder = encoder_of(path)

        def work(ids, texts):
            found = encoder.encode([t or "" for t in texts])
            decoded = encoder.words.library.decode([x[0] for x in found], num_threads=1)
            return {
                "doc_id": ids,
                "n_tokens": [len(x[0]) for x in found],
                "ids_sha256": [hashlib.sha256(x[1].encode()).hexdigest() for x in found],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
            }

        return work

    return map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document encoded and decoded."""
    import public_tokenizers

    return digests(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
