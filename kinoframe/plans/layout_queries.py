"""Queries over broken lines and side data."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinoframe.operators import lines, side_data
from kinoframe.plans.vectors import row_vectors
from kinoframe.sources.tables import CUES, PACKETS, cues, packets

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLE[name] = sql
        return run

    return add


# --- lines ---

WIDTH = 40


# a word after the other: its line, and how wide that is with it
@query(
    "wrapped_lines",
    f"""WITH RECURSIVE t AS MATERIALIZED (SELECT script_id, read_order, regexp_extract_all(text, ' |[^ ]+') AS w FROM ({CUES})), f AS (
        SELECT script_id, read_order, 0 AS i, 0 AS line, 0::BIGINT AS wide, 0 AS word FROM t WHERE len(w) > 0
        UNION ALL SELECT script_id, read_order, i + 1, line + turn::INT, CASE WHEN turn THEN length(x) WHEN x = ' ' AND wide = 0 THEN 0 ELSE wide + length(x) END, (x <> ' ')::INT FROM (
            SELECT f.script_id, f.read_order, f.i, f.line, f.wide, t.w[f.i + 1] AS x, f.wide > 0 AND t.w[f.i + 1] <> ' ' AND f.wide + length(t.w[f.i + 1]) > {WIDTH} AS turn
            FROM f JOIN t ON t.script_id = f.script_id AND t.read_order = f.read_order AND f.i < len(t.w)))
        SELECT script_id, read_order, line, CAST(sum(word) AS INTEGER) AS words FROM f WHERE word = 1 GROUP BY 1, 2, 3""",
)
def _(spark, d):
    split = cues(spark, d).select("script_id", "read_order", "text", lines.pieces(F.col("text")).alias("pieces"))
    kept = split.withColumn("kinds", F.transform("pieces", lambda p: p.kind))
    rows = lines.wrapped(kept, WIDTH, lines.GREEDY).select("script_id", "read_order", "kinds", F.posexplode("lines").alias("line", "numbers"))
    return rows.select("script_id", "read_order", "line", F.size(F.filter("numbers", lambda n: F.get("kinds", n) == "word")).alias("words"))


def shown(style: int, most: float):
    """The lines of a plain text as numbers of pieces, joined by commas within a line and by a slash between lines."""

    def run(rows):
        split = rows.select("seq", lines.pieces(F.decode("data", "UTF-8")).alias("pieces"))
        numbers = F.transform("lines", lambda line: F.array_join(line.cast("array<string>"), ","))
        return lines.wrapped(split, most, style).select("seq", F.array_join(numbers, "/").alias("v"))

    return run


def texts(*pairs: tuple[str, str]) -> list[tuple[str, str]]:
    return [(text.encode().hex(), result) for text, result in pairs]


row_vectors(query, "lines_greedy", "VARCHAR", texts(
    ("aaaa bbbb cccc dd", "0,1,2/4,5,6"), ("aaaa bbb cc", "0,1,2/4"), (" a", "1"), ("a ", "0"), (r"a\N\Nb", "0//1"), (r"a\N", "0/"), (r"\Na", "/0"), (r"a \Nb", "0,1/2"),
    ("aaaaaaaaaaaaaa b", "0/2"), ("a  bbbbbbbbbb", "0/3"), ("", ""), (r"aa\nb", "0"),
), shown(lines.GREEDY, 10))
row_vectors(query, "lines_unbroken", "VARCHAR", texts(("aaaa bbbb cccc", "0,1,2,3,4"), (r"aaaa bbbb\Ncccc", "0,1,2/3")), shown(lines.NEVER, 5))
# the wider line of two hands its last word down while that helps and the other one holds it
row_vectors(query, "lines_evened", "VARCHAR", texts(
    ("aaaa bbb c", "0/2,4"), ("aaaa bbbb cccc dd", "0,1,2/4,5,6"), ("aaaaaa b cc", "0/2,4"), (r"aa bb cc\Nd", "0,1,2/4,5"), ("aa bb cc dd", "0,1,2/4,6"), (r"aa\Nbb", "0/1"),
), shown(lines.SMART, 9))


# --- side data ---


@query(
    "side_data_entries",
    f"""SELECT seq, entry_no, type, octet_length(data) AS size, problem FROM (
        SELECT seq, unnest([0, 1, 2]) AS entry_no, unnest([seq % 5, 7, 9]) AS type, unnest([encode('ab'), CASE WHEN seq % 2 = 0 THEN ''::BLOB END, CASE WHEN seq % 3 = 0 THEN ''::BLOB END]) AS data, unnest([NULL, CASE WHEN seq % 2 = 1 THEN 'no payload' END, CASE WHEN seq % 3 > 0 THEN 'no payload' END]) AS problem FROM ({PACKETS}))""",
)
def _(spark, d):
    s = F.col("seq")
    entry = lambda kind, size, data: F.struct(kind.cast("long").alias("type"), size.cast("long").alias("size"), data.cast("binary").alias("data"))
    none = F.lit(None)
    given = F.array(entry(s % 5, F.lit(2), F.lit(b"ab")), entry(F.lit(7), s % 2, none), entry(F.lit(9), s % 3, none))
    return side_data.entries(packets(spark, d).select("seq", given.alias("side_data"))).select("seq", "entry_no", "type", F.octet_length("data").alias("size"), "problem")


row_vectors(query, "parameter_changes", "VARCHAR", [
    ("00000000", None), ("0400000044ac0000", None), ("0800000080020000e0010000", None), ("0c00000044ac000080020000e0010000", None), ("0400000080bb0000", "rate changed"), ("08000000000500d0", "wrong length"),
    ("0800000000050000d0020000", "dimensions changed"), ("0400000000000000", "rate out of range"), ("04000000ffffffff", "rate out of range"), ("0800000000000000e0010000", "dimensions out of range"),
    ("08000000ffffff7fffffff7f", "dimensions out of range"), ("01000000", "unknown flags"), ("00010000", "unknown flags"), ("000000", "cut off"), ("", "cut off"), ("0000000000", "wrong length"), ("04000000", "wrong length"),
], lambda rows: rows.select("seq", side_data.parameter_change(F.col("data"), F.lit(44_100), F.lit(640), F.lit(480)).alias("v")))
