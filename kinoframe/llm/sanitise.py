"""Information-theoretic sanitisation: personal data, and the words that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by their patterns. Each distinct value is a
protected entity. A word near an entity (among the ``WINDOW`` words on either side of a mention that are no base span
themselves) discloses it by as much as the corpus ties both together: their pointwise mutual information,
ln(N * both / (word * entity)), counted in documents. It equals the information of the entity, ln(N / entity), where the word
occurs nowhere but beside it. Words whose disclosure reaches that information divided by ``alpha`` are replaced in the
documents that hold the entity: by their class (``john`` by ``joh*``) if the class discloses less, else by nothing. Pairs
that fewer than ``least`` different texts have are no evidence.

A text is read once; what is kept of it are spans, context words and digests of entities, never the values. Counts are taken
within a batch before anything is shuffled, and everything found depends on a text alone, so copies share it.

Defined results: a null text is an empty one, which has no spans; null and repeated ids are rows as any; repeated texts count
as documents but are one text as evidence; an entity that every document holds is not protected by its words; very long
texts are read whole, in time that grows with their length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import only, slices, stored

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of a mention; different texts that make a pair evidence; the divisor of an entity's information.
WINDOW, LEAST, ALPHA = 8, 3, 1.1
#: Context words and pairs that a task hands on at once, if they are not of one text.
HELD = 1 << 16

# '@' and '+' begin no second match inside themselves, and runs of digits are entered at their start alone: linear time
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")

SPAN = "struct<kind: int, start: int, end: int>"
CONTEXT = "struct<term: string, entity: string, start: int, end: int>"
FOUND = f"doc_id long, text_key string, spans array<{SPAN}>, entities array<string>, contexts array<{CONTEXT}>, pairs array<struct<term: string, entity: string>>, terms array<struct<term: string, n: long>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The local part of an address reaches back from its '@' to the first other character or the last address."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, last := m.end()))
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> str:
    """A digest of a value as it is written most plainly."""
    plain = value.lower() if kind == 0 else ".".join(p.lstrip("0") for p in value.split(".")) if kind == 1 else digits(value)
    return hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=16).hexdigest()


def class_of(word: str) -> str | None:
    """What a word is generalised to: its first half, three letters at least; None for what has no more than those."""
    return f"{word[: max(3, len(word) // 2)]}*" if len(word) > 3 else None


def contexts(text: str, spans: list[tuple[int, int, int]], names: list[str], window: int) -> list[tuple[str, str, int, int]]:
    """(word, entity, start, end) of the free words around each mention."""
    taken = sorted((a, b) for _, a, b in spans)
    free, i, high = [], 0, 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            high = max(high, taken[i][1])
            i += 1
        if a >= high:
            free.append((a, b))
    begins = [a for a, _ in free]
    out = set()
    for (_, start, end), name in zip(spans, names):
        left, right = bisect_left(begins, start), bisect_left(begins, end)
        for a, b in free[max(0, left - window) : left] + free[right : right + window]:
            out.add((text[a:b].lower(), name, a, b))
    return sorted(out, key=lambda x: (x[2], x[1]))


def nested(rows: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as structs, a field at a time."""
    flat = [x for row in rows for x in row]
    fields = list(kind.value_type)
    values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], f.type) for i, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), values, type=kind)


def found(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What a row of (doc_id, text) holds: spans, entities, context words and pairs; ``terms`` of the last row of about 4 MB of text
    counts its documents that have a word, or one of its class. Rows are handed on by what was found in them, so that texts full of
    personal data take no more memory than others."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(FOUND)
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple], terms: list[tuple]) -> pa.RecordBatch:
        columns = [*map(list, zip(*rows)), [[] for _ in rows[1:]] + [terms]]
        return pa.RecordBatch.from_arrays([nested(c, f.type) if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, str | None] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                count: Counter[str] = Counter()
                held, most = [], 0
                for i in range(a, b):
                    text = texts[i].as_py() or ""
                    words = set(WORD.findall(text.lower()))
                    for w in words:
                        if w not in classes:
                            if len(classes) > 500_000:
                                classes.clear()
                            classes[w] = class_of(w)
                    count.update(words)
                    count.update({classes[w] for w in words} - {None})
                    spans = base_spans(text)
                    names = [entity(k, text[start:end]) for k, start, end in spans]
                    near = contexts(text, spans, names, window)
                    pairs = {(t, e) for t, e, _, _ in near}
                    pairs |= {(c, e) for t, e in pairs if (c := class_of(t))}
                    if held and most + len(near) + len(pairs) > HELD:
                        yield batch_of(held, [])
                        held, most = [], 0
                    held.append((ids[i].as_py(), hashlib.md5(text.encode()).hexdigest(), spans, sorted(set(names)), near, sorted(pairs)))
                    most += len(near) + len(pairs)
                yield batch_of(held, list(count.items()))

    return docs.mapInArrow(run, schema)


def disclosures(rows: DataFrame, least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """Of each pair of word (or class) and entity with evidence: the counts, ``pmi``, the entity's ``information``,
    ``disclosed``, and what the word ``becomes`` (null: nothing, or, of a word not disclosed, no change)."""
    total = float(rows.count())
    texts = rows.select("text_key", F.explode("pairs").alias("p")).groupBy("p.term", "p.entity", "text_key").agg(F.count(F.lit(1)).alias("n"))
    both = texts.groupBy("term", "entity").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least)
    terms = rows.select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("with_term"))
    entities = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"))
    known = both.join(terms, "term").join(entities, "entity")
    information = F.log(F.lit(total) / F.col("with_entity"))
    spared = F.log(F.col("both") / F.col("with_term"))  # the mutual information less that of the entity: never above 0
    known = known.withColumn("information", information).withColumn("pmi", spared + F.col("information"))
    known = known.withColumn("disclosed", (F.col("information") > 0) & (spared >= (1 / alpha - 1) * F.col("information")))
    half = F.greatest(F.lit(3), F.call_function("div", F.length("term"), F.lit(2)).cast("int"))
    group = F.when((F.length("term") > 3) & ~F.col("term").endswith("*"), F.concat(F.col("term").substr(F.lit(1), half), F.lit("*")))
    classes = known.where(F.col("term").endswith("*") & ~F.col("disclosed")).select(F.col("term").alias("becomes"), "entity")
    return known.withColumn("_class", group).join(classes.withColumn("_class", F.col("becomes")), ["_class", "entity"], "left").drop("_class")


def term_spans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """text_key and ``terms``, the words of a text that are replaced, in order; only texts that have one."""
    risky = known.where(F.col("disclosed") & ~F.col("term").endswith("*")).select("term", "entity", "becomes")
    near = rows.select("text_key", F.explode("contexts").alias("c")).select("text_key", "c.*").distinct()
    # a word near two entities is removed if either calls for it
    each = near.join(risky, ["term", "entity"]).groupBy("text_key", "start", "end").agg(F.when(F.bool_and(F.col("becomes").isNotNull()), F.min("becomes")).alias("becomes"))
    return each.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "becomes"))).alias("terms"))


def replaced(text: str, base: list[dict], terms: list[dict]) -> str:
    """A text with its spans replaced; of spans that overlap, the first names all."""
    marks = [(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base] + [(t["start"], t["end"], t["becomes"] or "") for t in terms]
    out, at = [], 0
    for start, end, by in sorted(marks):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def analysed(docs: DataFrame, least: int, alpha: float, window: int) -> tuple[DataFrame, DataFrame]:
    rows = stored(found(docs, window), "sanitise")
    return rows, term_spans(rows, disclosures(rows, least, alpha))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, alpha: float = ALPHA, window: int = WINDOW) -> DataFrame:
    """doc_id, text, ``clean`` (the text without what is personal), ``spans`` and ``terms`` of every row."""
    own = only(docs, id_col, text_col)
    rows, terms = analysed(own, least, alpha, window)
    each = rows.groupBy("text_key").agg(F.first("spans").alias("spans")).join(terms, "text_key", "left")
    texts = own.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")))).join(each, "text_key", "left")
    schema = f"doc_id long, text string, clean string, spans array<{SPAN}>, terms array<struct<start: int, end: int, becomes: string>>"

    def run(batches):
        for b in batches:
            text, spans, terms = (b.column(i).to_pylist() for i in (1, 2, 3))
            clean = [replaced(t or "", s or [], k or []) for t, s, k in zip(text, spans, terms)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clean, pa.string()), b.column(2), b.column(3)], names=["doc_id", "text", "clean", "spans", "terms"])

    return texts.select("doc_id", "text", "spans", "terms").mapInArrow(run, schema)


def listed(spans: str, kind: Callable[[Column], Column]) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(kind: int) -> Column:
    """Spans of a kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: counts, base spans and all spans of every document."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    rows, terms = analysed(docs, LEAST, ALPHA, WINDOW)
    kinds = F.array(*map(F.lit, KINDS))
    counts = [counted(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = listed("spans", lambda s: F.element_at(kinds, s["kind"] + 1))
    more = terms.select("text_key", listed("terms", lambda s: F.lit("term")).alias("more"))
    own = rows.select("doc_id", "text_key", *counts, base.alias("base"))
    every = F.array_join(F.filter(F.array("base", "more"), lambda s: s != ""), ",")
    return own.join(more, "text_key", "left").select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), every.alias("spans"))
