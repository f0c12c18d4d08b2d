"""Queries over override tags, drawings, forced styles, subtitle packets and the processing of metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinoframe.functions import text
from kinoframe.operators import metadata, overrides, recipes, subtitles
from kinoframe.plans.media_queries import LANG, scripts, tagged
from kinoframe.plans.vectors import literal, vectors
from kinoframe.sources.tables import CUES, PACKETS, STREAMS, cues, packets, streams

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLE[name] = sql
        return run

    return add


def texts(name: str, pairs: list[tuple], operator) -> None:
    """Packet ``seq`` takes the pair of its number; ``operator`` makes a column ``v`` from rows (seq, x)."""
    n = len(pairs)

    @query(name, f"SELECT seq, ({literal([r for _, r in pairs])})[seq % {n} + 1] AS v FROM ({PACKETS})")
    def _(spark, d):
        given = F.array(*[F.lit(x) for x, _ in pairs])
        return operator(packets(spark, d).select("seq", F.element_at(given, (F.col("seq") % n + 1).cast("int")).alias("x"))).select("seq", "v")


def shown(rows):
    one = lambda t: F.concat(t["name"], F.lit("["), F.array_join(t.args, "|"), F.lit("]"))
    return overrides.tags(rows, "x").withColumn("v", F.array_join(F.transform("tags", one), " "))


texts("override_tags", [
    (r"\bord2", "bord[2]"), (r"\bord 2 ", "bord[ 2]"), (r"\bord(2)", "bord[2]"), (r"\bord2(3)", "bord[3|2]"), (r"\bord", "bord[]"), ("\\ \tbord2", "bord[2]"),
    (r"\fscx50", "fscx[50]"), (r"\fsc", "fsc[]"), (r"\fsp1.5", "fsp[1.5]"), (r"\fs+5", "fs[+5]"), (r"\frz45", "frz[45]"), (r"\fr45", "fr[45]"), (r"\4a&H80&", "4a[&H80&]"), (r"\kt150", "kt[150]"),
    (r"\pos(10,20)", "pos[10|20]"), (r"\pos( 10 , 20 )", "pos[10|20]"), (r"\pos(10,20", "pos[10|20]"), (r"\pos(10)", ""), (r"\pos(10,20,30)", ""), (r"\move(1,2,3,4)", "move[1|2|3|4]"), (r"\move(1,2,3)", ""),
    (r"\fade(255,32,224,0,500,2000,2200)", "fade[255|32|224|0|500|2000|2200]"), (r"\fad(100,200)", "fad[100|200]"), (r"\fad(1,2,3)", ""), (r"\clip(1,2,3,4)", "clip[1|2|3|4]"), (r"\iclip(m 0 0 l 1 1)", "iclip[m 0 0 l 1 1]"),
    (r"\t(0,100,\frz90\fs20)", r"t[0|100|\frz90\fs20]"), (r"\fnArial Black", "fn[Arial Black]"), (r"\rAlt", "r[Alt]"), (r"\b1\i1", "b[1] i[1]"), (r"junk\an8more\c&HFF&", "an[8more] c[&HFF&]"), (r"\zzz1", ""), ("", ""), ("\\", ""), (r"\(1)\b1", "b[1]"),
    (r"\bord(1,,2)", "bord[1|2]"),
], shown)

texts("drawings", [
    ("m 0 0 l 100 0 100 50 0 50", "M 0 0;L 6400 0;L 6400 3200;L 0 3200;Z/0,0,6400,3200"), ("m 0 0 l 10.5 0 l 10.5 10.25", "M 0 0;L 672 0;L 672 656;Z/0,0,672,656"),
    ("m 0 0 l 10 0 10 10 m 20 20 l 30 20", "M 0 0;L 640 0;L 640 640;Z;M 1280 1280;L 1920 1280;Z/0,0,1920,1280"), ("m 0 0 l 10 0 n 20 20 l 30 20", "M 0 0;L 640 0;L 1920 1280;Z/0,0,1920,1280"),
    ("m 0 0 b 10 0 20 10 30 10", "M 0 0;C 640 0 1280 640 1920 640;Z/0,0,1920,640"), ("m 0 0 b 10 0 20 10", "/0,0,0,0"), ("m 0 0 s 0 1 1 1 1 0", "M 10 53;C 21 64 43 64 53 53;Z/0,0,64,64"),
    ("", "/"), ("xyz !!", "/"), ("m 0 0", "/0,0,0,0"), ("m 0 0 你 l 10 10", "M 0 0;L 640 640;Z/0,0,640,640"), ("l 5 5", "M 0 0;L 320 320;Z/320,320,320,320"),
], lambda rows: overrides.drawings(rows, "x").withColumn("v", F.concat(F.array_join("commands", ";"), F.lit("/"), F.coalesce(F.array_join("box", ","), F.lit("")))))


@query("tag_blocks", f"SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY read_order) - 1 AS read_order, '\\b1' AS blocks FROM ({CUES})")
def _(spark, d):
    return subtitles.events(scripts(spark, d)).select("script_id", "read_order", F.array_join(overrides.blocks_of(F.col("text")), " ").alias("blocks"))


@query("forced_styles", f"SELECT DISTINCT s.script_id, v.* FROM ({CUES}) s, (VALUES ('Default', 'Arial', '40', '&HFF'), ('user', 'Mono', '40', '7'), ('user', 'Mono', '40', '7')) v(name, font, size, colour)")
def _(spark, d):
    found = overrides.forced_styles(subtitles.styles(scripts(spark, d)), ["FontSize=40", "USER.FontName=Mono", "primarycolour=&HFF", "user.PrimaryColour=7", "Nonsense=1", "no value", "Other.FontSize=9"])
    f = lambda k: F.col("fields")[k]
    return found.select("script_id", "name", f("fontname").alias("font"), f("fontsize").alias("size"), f("primarycolour").alias("colour")).distinct()


@query("forced_headers", f"SELECT DISTINCT script_id, '640' AS x, 'tv.709' AS matrix, 't' AS title FROM ({CUES})")
def _(spark, d):
    head = F.create_map(F.lit("playresx"), F.lit("320"), F.lit("title"), F.lit("t"))
    m = overrides.forced_header(head, ["PlayResX=640", "Title=u", "YCbCr Matrix=tv.709", "Default.PlayResX=1"])
    return cues(spark, d).select("script_id").distinct().select("script_id", m["playresx"].alias("x"), m["ycbcr matrix"].alias("matrix"), m["title"].alias("title"))


SHOWN = f"SELECT script_id, read_order AS seq, start_ms * 1000 AS pts_us, 40 AS show_ms, 40 + duration_ms AS hide_ms, CAST(read_order % 4 AS INTEGER) AS rects FROM ({CUES})"


def cue_rows(spark, d):
    return cues(spark, d).select("script_id", F.col("read_order").alias("seq"), (F.col("start_ms") * 1000).alias("pts_us"), F.lit(40).cast("long").alias("show_ms"), (F.col("duration_ms") + 40).alias("hide_ms"), (F.col("read_order") % 4).cast("int").alias("rects"))


@query("subtitle_packets", f"SELECT script_id, seq, CAST(part AS INTEGER) AS part, pts_us, (hide_ms - show_ms) * 1000 AS duration_us FROM (SELECT *, unnest(range(greatest(rects, 1))) AS part FROM ({SHOWN}) WHERE pts_us >= 1000000 AND pts_us < 4000000)")
def _(spark, d):
    return subtitles.packets_of(cue_rows(spark, d), "ass", 1_000_000, 3_000_000)


@query("broadcast_packets", f"SELECT script_id, seq, CAST(part AS INTEGER) AS part, pts_us + 1000 * CASE WHEN part = 0 THEN show_ms ELSE hide_ms END AS pts_us, (hide_ms - show_ms) * 1000 AS duration_us FROM ({SHOWN}), range(2) t(part)")
def _(spark, d):
    return subtitles.packets_of(cue_rows(spark, d), "dvb")


# --- metadata ---


def entries(spark, d):
    """The file's own entries and those of each stream, of every asset."""
    rows = tagged(spark, d)
    own = metadata.entries(rows, "metadata", "asset_id", "stream_index").select("asset_id", F.lit("s").alias("scope"), F.col("stream_index").cast("long").alias("place"), "key", "value")
    made = F.create_map(*[F.lit(x) for x in ("title", "film", "creation_time", "now", "duration", "9")])
    of_file = metadata.entries(rows.select("asset_id").distinct().withColumn("m", made), "m", "asset_id").select("asset_id", F.lit("g").alias("scope"), F.lit(None).cast("long").alias("place"), "key", "value")
    return of_file.unionByName(own)


ASSETS = f"(SELECT DISTINCT asset_id FROM ({STREAMS}))"


@query(
    "metadata_processed",
    f"""SELECT asset_id, 'g' AS scope, NULL::BIGINT AS place, 'title' AS key, 'mine' AS value FROM {ASSETS}
        UNION ALL SELECT asset_id, 's', stream_index, 'title', title FROM ({STREAMS}) UNION ALL SELECT asset_id, 's', stream_index, 'language', {LANG} FROM ({STREAMS}) WHERE kind <> 'audio'
        UNION ALL SELECT asset_id, 'p', 1, 'service', 'x' FROM {ASSETS}""",
)
def _(spark, d):
    user = [("g", "title", "mine"), ("s:a", "language", ""), ("p:1", "service", "x")]
    return metadata.processed(entries(spark, d), tagged(spark, d), user=user, recording=True, encoded=True)


@query(
    "metadata_mapped",
    f"""WITH f AS (SELECT asset_id, min(stream_index) AS first FROM ({STREAMS}) WHERE kind = 'video' GROUP BY 1), s AS (SELECT s.* FROM ({STREAMS}) s JOIN f ON s.asset_id = f.asset_id AND s.stream_index = f.first)
        SELECT asset_id, 'c' AS scope, 2::BIGINT AS place, 'title' AS key, title AS value FROM s UNION ALL SELECT asset_id, 'c', 2, 'language', {LANG} FROM s UNION ALL SELECT asset_id, 'c', 2, 'encoder', 'x' FROM s
        UNION ALL SELECT asset_id, 'g', NULL, 'title', 'film' FROM {ASSETS} UNION ALL SELECT asset_id, 'g', NULL, 'duration', '9' FROM {ASSETS}""",
)
def _(spark, d):
    return metadata.processed(entries(spark, d), tagged(spark, d), maps=[("s:v", "c:2")])


# a source's empty value is a value; one that a user gives deletes
@query(
    "metadata_emptied",
    f"""SELECT asset_id, 's' AS scope, stream_index AS place, 'title' AS key, CASE WHEN stream_index % 3 = 0 THEN '' ELSE title END AS value FROM ({STREAMS})
        UNION ALL SELECT asset_id, 's', stream_index, 'language', {LANG} FROM ({STREAMS}) WHERE kind <> 'video'
        UNION ALL SELECT asset_id, 'g', NULL, 'title', 'film' FROM {ASSETS} UNION ALL SELECT asset_id, 'g', NULL, 'duration', '9' FROM {ASSETS}""",
)
def _(spark, d):
    empty = (F.col("scope") == "s") & (F.col("key") == "title") & (F.col("place") % 3 == 0)
    rows = entries(spark, d)
    return metadata.processed(rows.withColumn("value", F.when(empty, "").otherwise(F.col("value"))), tagged(spark, d), user=[("s:v", "language", "")], encoded=True)


@query("metadata_without_copy", f"SELECT asset_id, 'g' AS scope, NULL::BIGINT AS place, 'a' AS key, 'b' AS value FROM {ASSETS}")
def _(spark, d):
    return metadata.processed(entries(spark, d), tagged(spark, d), user=[("", "a", "b")], auto=False)


@query("codec_order", f"SELECT kind, title AS name, CASE kind WHEN 'video' THEN 0 WHEN 'audio' THEN 1 ELSE 3 END AS \"order\", row_number() OVER (PARTITION BY kind ORDER BY title) AS place FROM (SELECT DISTINCT kind, title FROM ({STREAMS}))")
def _(spark, d):
    return metadata.sorted_codecs(streams(spark, d).select("kind", F.col("title").alias("name")).distinct())


@query("first_data_streams", f"SELECT asset_id, min(stream_index) AS stream_index FROM ({STREAMS}) WHERE kind = 'subtitle' AND stream_index % 3 = 1 GROUP BY 1")
def _(spark, d):
    rows = streams(spark, d).withColumn("kind", F.when(F.col("kind") == "subtitle", "data").otherwise(F.col("kind"))).withColumn("codec", F.when(F.col("stream_index") % 3 == 1, "timed_id3").otherwise("klv"))
    return metadata.first_data(rows, "timed_id3")


@query("merged_options", f"SELECT stream_index, CASE WHEN stream_index % 2 = 0 THEN 'b=2000;g=12' ELSE 'b=9;crf=' || (stream_index % 5) || ';g=12' END AS options FROM ({STREAMS})")
def _(spark, d):
    k = F.col("stream_index")
    by_kind = F.create_map(F.lit("b"), F.lit("2000"), F.lit("g"), F.lit("12"))
    none = F.create_map().cast("map<string,string>")
    by_map = F.when(k % 2 == 0, none).otherwise(F.create_map(F.lit("b"), F.lit("9"), F.lit("crf"), (k % 5).cast("string")))
    return streams(spark, d).select("stream_index", metadata.as_text(metadata.merged_options(by_kind, by_map)).alias("options"))


@query("chapter_entries", f"SELECT stream_index, seq, 'title' AS key, 'chapter ' || seq AS value FROM ({PACKETS}) WHERE is_key")
def _(spark, d):
    chapters = packets(spark, d).where("is_key").withColumn("metadata", F.create_map(F.lit("title"), F.concat(F.lit("chapter "), "seq")))
    return metadata.entries(chapters, "metadata", "stream_index", "seq")


@query("unchanged", f"SELECT stream_index, seq, pts_us FROM ({PACKETS})")
def _(spark, d):
    return recipes.chained(packets(spark, d), lambda rows: rows.select("*")).select("stream_index", "seq", "pts_us")


