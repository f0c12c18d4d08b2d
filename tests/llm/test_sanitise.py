"""Base spans against the patterns themselves, disclosure against plain counting."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest

from kinoframe.llm import queries, sanitise
from tests.conftest import SF

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, match):
    n = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]


def patterns(text):
    return [(k, *m.span()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if good(kind, m[0])]


def test_base_spans_equal_the_patterns():
    pick = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", "+", "+1 (555) 123-4567", "4539 1488 0343 6467", "4539148803436467", "1.2.3.4", "256.1.1.1", "001.2.3.255", "x@y.z", "%", " ", "é", "٣", "12", "_", "(", "x@y", "@q.r", "9" * 20]
    for _ in range(20_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(12)))
        assert sanitise.base_spans(text) == patterns(text), text


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("1" * 400_000, "a" * 400_000, "1." * 200_000, "+1" * 200_000, "a@b" * 150_000, "@a.b" * 100_000, "1 " * 200_000):
        sanitise.base_spans(text)
    assert time.perf_counter() - began < 20


def plain(rows, least, alpha, window):
    """Spans of every row by counting over the whole corpus."""
    docs, words_of, entities_of, near_of = [], [], [], []
    for _, text in rows:
        text = text or ""
        spans = patterns(text)
        free = [m.span() for m in re.finditer(r"[^\W\d_]+", text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        near = set()
        for k, a, b in spans:
            e = (k, text[a:b].lower() if k == 0 else tuple(int(p) for p in text[a:b].split(".")) if k == 1 else re.sub("[^0-9]", "", text[a:b]))
            before = [f for f in free if f[0] < a][-window:]
            after = [f for f in free if f[0] >= b][:window]
            near |= {(e, f) for f in before + after} | {(e, None)}
        docs.append((text, spans))
        near_of.append(near)
        entities_of.append({e for e, _ in near})
        own = set(re.findall(r"[^\W\d_]+", text.lower()))
        words_of.append(own | {sanitise.class_of(w) for w in own} - {None})
    both, texts, with_term, with_entity = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(int)
    for (text, _), words, entities, near in zip(docs, words_of, entities_of, near_of):
        for w in words:
            with_term[w] += 1
        for e in entities:
            with_entity[e] += 1
        pairs = {(e, text[f[0] : f[1]].lower()) for e, f in near if f}
        for p in pairs | {(e, sanitise.class_of(w)) for e, w in pairs if len(w) > 3}:
            both[p] += 1
            texts[p].add(text)

    def disclosed(e, w):
        info = math.log(len(rows) / with_entity[e])
        return len(texts[e, w]) >= least and info > 0 and math.log(both[e, w] / with_term[w]) >= (1 / alpha - 1) * info

    out = []
    for (i, _), (text, spans), near in zip(rows, docs, near_of):
        terms = defaultdict(list)
        for e, f in near:
            if f and disclosed(e, w := text[f[0] : f[1]].lower()):
                c = sanitise.class_of(w)
                terms[f].append(None if c is None or disclosed(e, c) else c)
        out.append((i, spans, sorted((a, b, None if None in by else min(by)) for (a, b), by in terms.items())))
    return out


def rendered(spans, terms):
    base = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for k, a, b in spans)
    return hashlib.sha256(base.encode()).hexdigest(), ",".join(filter(None, [base, ",".join(f"term:{a}:{b}" for a, b, _ in terms)]))


def test_query_equals_plain_counting(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, *[sum(s[0] == k for s in spans) for k in range(4)], *rendered(spans, terms)) for i, spans, terms in plain(rows, sanitise.LEAST, sanitise.ALPHA, sanitise.WINDOW))
    assert sorted(tuple(r) for r in queries.QUERIES["op12_sanitise"](spark, SF).collect()) == want


@pytest.fixture(scope="module")
def tied(spark):
    pick = random.Random(9)
    filler = [f"{a}{b}" for a in ("mor", "tal", "vin", "pas") for b in ("en", "ist", "ander", "olk")]
    rows = []
    for i in range(120):
        words = [pick.choice(filler) for _ in range(25)]
        if i % 10 == 0:  # Quillon stands beside one address only; Morwenna's class is common
            words[5:5] = ["Quillon", "Morwenna", "q.m@example.org" if i % 20 else "Q.M@example.org"]
        if i % 15 == 0:
            words[2:2] = [f"10.0.0.{i}", "host"]
        rows.append((i, " ".join(words)))
    return rows + [(200, None), (201, ""), (None, "a b@c.d e"), (0, rows[0][1]), (0, rows[0][1])]


def test_disclosure_equals_plain_counting(spark, tied):
    docs = spark.createDataFrame([(i, t, "x", 1, [2]) for i, t in tied], "doc_id long, text string, spans string, terms int, pairs array<int>").repartition(3)
    want = plain(tied, 3, 1.1, 8)
    assert sum(len(t) for _, _, t in want) > 10
    got = sanitise.sanitise(docs).collect()
    shape = lambda i, spans, terms: (i is None, i or 0, tuple(spans), tuple((a, b, c or "") for a, b, c in terms))
    assert sorted(shape(r.doc_id, [tuple(s) for s in r.spans], [tuple(t) for t in r.terms or []]) for r in got) == sorted(shape(*w) for w in want)
    text = next(r.clean for r in got if r.doc_id == 10)
    assert "Quillon" not in text and "[EMAIL]" in text and "mor" in text and "Morwenna" not in text
    assert all(r.clean == (r.text or "") for r in got if not r.spans)


def test_replaced_spans_may_overlap():
    base = [{"kind": 2, "start": 3, "end": 22}, {"kind": 3, "start": 2, "end": 12}]
    assert sanitise.replaced("a +4539 1488 0343 6467 b", base, []) == "a [PHONE] b"


def test_nothing(spark, nothing):
    assert sanitise.sanitise(nothing).collect() == []


def test_texts_full_of_personal_data_are_handed_on_in_pieces(spark):
    """4 MB of mentions are hundreds of MB of context words."""
    text = " ".join(f"w{chr(97 + i % 26)}x vy{chr(97 + i % 7)} u{i}@x.org 1.2.{i % 256}.3" for i in range(3_000))
    docs = spark.createDataFrame([(i, f"{text} {i}") for i in range(8)], "doc_id long, text string").coalesce(1)
    made = []
    found = sanitise.found(type("Docs", (), {"mapInArrow": lambda self, run, schema: run})())
    for batch in found(iter(docs.toArrow().to_batches())):
        made.append(batch.nbytes)
        assert batch.num_rows == 1
    assert len(made) == 8 and max(made) < 20_000_000
    rows = sanitise.found(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(8)) and [len(r.terms) > 0 for r in rows] == [False] * 7 + [True]
    assert all(t.n == 8 for t in rows[-1].terms) and all(len(r.spans) == 6_000 for r in rows)
