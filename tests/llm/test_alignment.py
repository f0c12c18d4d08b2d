"""Alignment against the libraries on whole texts and the definition on whole token lists."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kinoframe.llm import alignment, queries
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def gpt_bytes():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(rows, libraries):
    """Whole texts encoded at once, every pair of overlapping tokens found by comparing ranges."""
    a, b = libraries
    letters, out = gpt_bytes(), []
    for i, text in rows:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((i, [], [], [], []))
            continue
        ranges = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            ranges.append(own)
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = [([], []) for _ in cuts]
        for k, (ids, own) in enumerate(zip((ids_a, ids_b), ranges)):
            for x, (_, e) in zip(ids, own):
                groups[bisect_left(cuts, e)][k].append(x)
        links, low = [], 0
        for x, (s, e) in zip(ids_a, ranges[0]):
            while ranges[1][low][1] <= s:
                low += 1
            links += [(x, y) for y, (t, f) in zip(ids_b[low : low + e - s + 1], ranges[1][low : low + e - s + 1]) if s < f and t < e]
        out.append((i, ids_a, ids_b, groups, links))
    held = Counter(p for *_, links in out for p in set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [
        (i, len(ids_a), len(ids_b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if ids_a else "")
        for i, ids_a, ids_b, groups, links in out
    ]


def shown(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def test_query_equals_whole_texts(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert shown(got.collect()) == shown(plain(rows, libraries))


ODD = ["a▁b", "▁", " ", "  x", "x ", "\n", "\n\n", " \n a", "a\n b", "a \nb", "a\nb\n", "don't  stop", "tab\there", "　wide 　x", "é́ 日本語🎉 ok", "<s> </s> <|endoftext|> <0x0A>", "\x00 \x1c x\x1f y", "a\r\nb", "'s 're\n's", "١٢٣ 456", "x" * 300 + " " + "🎉" * 40]


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_odd_texts(spark, docs, libraries, block):
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (None, "no id here")]
    frame = spark.createDataFrame([(i, t, 5, "k", [1], 0) for i, t in texts], "doc_id long, text string, block int, stretch string, places array<int>, n_a int").repartition(3)
    assert shown(alignment.align(frame, A, B, block=block).collect()) == shown(plain(texts, libraries))


@pytest.mark.parametrize(("room", "pairs", "block"), [(0, 0, 40), (0, 1 << 16, 1 << 24), (5, 3, 40), (5, 3, 1 << 24), (1 << 17, 0, 200)])
def test_tables_at_hand_change_no_result(spark, docs, libraries, room, pairs, block):
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (7, "the the the"), (7, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert shown(alignment.align(frame, A, B, block=block, room=room, pairs=pairs).collect()) == shown(plain(texts, libraries))


def test_frequent_stretches_are_not_sent_to_blocks(spark):
    frame = spark.createDataFrame([(i, f"the cat and the word{i}") for i in range(40)], "doc_id long, text string")
    known = alignment.frequent(frame, room=4)
    assert known[0] == " the" and set(known[1:3]) == {" and", " cat"} and len(known) == 4
    rows = alignment.blocks(frame, 40, known)
    held = {r.stretch: (r.common, len(r.held)) for r in alignment.holders(rows, known).collect()}
    assert {k: held[k] for k in known} == {k: (i, 0) for i, k in enumerate(known)}
    assert all(held[f" word{i}"] == (None, 1) for i in range(40) if f" word{i}" not in known)


def test_stretches_give_the_text_back():
    for t in ODD:
        assert "".join(alignment.stretches(t)) == " " + t
    assert alignment.stretches("a bc\nd  e f") == [" a", " bc", "\nd  e", " f"] and alignment.stretches("") == []


def test_nothing(spark, nothing):
    assert alignment.align(nothing, A, B).collect() == []
