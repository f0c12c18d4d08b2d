"""The registered queries, with all their columns, against plain loops over the table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinoframe.llm import flac, queries, simhash
from tests.conftest import SF
from tests.llm.test_text_operators import brute_components, check_shards


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def found(spark, name, *columns):
    return [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()]


def encoded(path, table):
    tok = Tokenizer.from_file(public_tokenizers.path(path))
    return {i: e.ids for (i, _), e in zip(table, tok.encode_batch([t for _, t in table], add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, table):
    prints = [(i, simhash.fingerprint(t)) for i, t in table]
    low = brute_components(prints)
    assert sorted(found(spark, "op1_simhash", "doc_id", "fingerprint", "component_id")) == sorted((i, f"{f:016x}", low[i]) for i, f in prints)


def test_op2(spark, table):
    got = found(spark, "op2_sharding", "doc_id", "size", "text_crc32", "law", "grown_shard", "shard", "slot")
    assert sorted(r[:5] for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in table)
    check_shards([r[5:] for r in got], len(table), 8)


def test_op3(spark, table):
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t) for i, t in table}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in norm.items())
    assert sorted(found(spark, "op3_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == want


def test_op4(spark, table):
    got = found(spark, "op4_toxicity", "doc_id", "held_out", "score", "predicted")
    assert sorted(r[0] for r in got) == sorted(i for i, _ in table)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= s <= 1 and p == int(s >= 0.3) for i, h, s, p in got)


def test_op5(spark, table):
    want = []
    for i, t in table:
        p = flac.payload_of(t)
        media = flac.encode_streams([p])[0]
        want.append((i, len(t.encode()), len(p), sha(p), zlib.crc32(p[-32:]), len(media), sha(media), flac.feature(np.frombuffer(p, np.uint8))))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted(found(spark, "op5_flac", *names)) == sorted(want)


def test_op6(spark, table):
    want = []
    for i, ids in encoded("byte_bpe_50k.json", table).items():
        ids = [*ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = found(spark, "op6_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert sorted(r[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for members in bins.values():
        ends = np.cumsum([n for _, n in sorted(members)]).tolist()
        assert [a for a, _ in sorted(members)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_op7(spark, table):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in table:
        ids = sp.encode(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(found(spark, "op7_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(want)


def test_op8(spark, table):
    want, start = [], 0
    for i, ids in sorted(encoded("word_bpe_49k.json", table).items()):
        want.append((i, start, len(ids) + 1, crc([*ids, 1])))
        start += len(ids) + 1
    assert sorted(found(spark, "op8_token_files", "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_op9(spark, table):
    got = Counter()
    for i, n in found(spark, "op9_token_counts", "doc_id", "n_tokens"):
        got[i] += n
    assert got == Counter({i: len(ids) for i, ids in encoded("byte_bpe_50k.json", table).items()})
    lines = Counter(r[0] for r in found(spark, "op9_token_counts", "doc_id"))
    assert lines == Counter({i: max(1, len([x for x in re.findall(r"[^\n]*\n|[^\n]+", t)])) for i, t in table})


def test_op10(spark, table):
    got = found(spark, "op10_language", "doc_id", "held_out", "lang_pred", "score")
    assert sorted(r[0] for r in got) == sorted(i for i, _ in table)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and lang for i, h, lang, s in got)
