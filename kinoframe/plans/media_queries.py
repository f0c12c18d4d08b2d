"""Queries over metadata, stream selection, text grammars, subtitles and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinoframe.functions import pixels, text
from kinoframe.operators import metadata, subtitles
from kinoframe.plans.scan_queries import DAY
from kinoframe.sources.tables import CUES, PACKETS, STREAMS, cues, packets, streams, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


# --- metadata ---


def tagged(spark, d):
    """Streams with a metadata map."""
    m = F.create_map(F.lit("title"), "title", F.lit("language"), F.when(F.col("stream_index") % 2 == 0, "eng").otherwise("fra"), F.lit("encoder"), F.lit("x"))
    return streams(spark, d).withColumn("metadata", m)


LANG = "CASE WHEN stream_index % 2 = 0 THEN 'eng' ELSE 'fra' END"


@query("metadata_set", f"SELECT stream_index, 'artist=me;language=deu;title=' || title AS tags FROM ({STREAMS})")
def _(spark, d):
    m = metadata.set_keys(F.col("metadata"), {"language": "deu", "encoder": "", "artist": "me"})
    return tagged(spark, d).select("stream_index", metadata.as_text(m).alias("tags"))


@query("metadata_copy", f"SELECT stream_index, 'album=a;encoder=x;language=' || {LANG} || ';title=' || title AS tags FROM ({STREAMS})")
def _(spark, d):
    m = metadata.copied(F.col("metadata"), F.create_map(F.lit("title"), F.lit("other"), F.lit("album"), F.lit("a")))
    return tagged(spark, d).select("stream_index", metadata.as_text(m).alias("tags"))


@query("metadata_default_copy", f"SELECT stream_index, 'language=' || {LANG} || ';title=' || title AS tags FROM ({STREAMS})")
def _(spark, d):
    return tagged(spark, d).select("stream_index", metadata.as_text(metadata.without_keys(F.col("metadata"), ["encoder", "creation_time", "duration"])).alias("tags"))


@query("metadata_entries", f"SELECT stream_index, 'title' AS key, title AS value FROM ({STREAMS}) UNION ALL SELECT stream_index, 'language', {LANG} FROM ({STREAMS}) UNION ALL SELECT stream_index, 'encoder', 'x' FROM ({STREAMS})")
def _(spark, d):
    return metadata.entries(tagged(spark, d), "metadata", "stream_index")


@query("metadata_channel", f"SELECT stream_index, CAST(stream_index % 8 AS INTEGER) AS channel FROM ({STREAMS}) WHERE stream_index % 3 = 0")
def _(spark, d):
    key = F.when(F.col("stream_index") % 3 == 0, F.concat(F.lit("silence_start."), F.col("stream_index") % 8)).otherwise("silence_start")
    return streams(spark, d).select("stream_index", metadata.channel_of(key).alias("channel")).where("channel is not null")


@query(
    "chapters_clipped",
    f"""SELECT stream_index, seq, greatest(0, pts_us - {1704067200000000 + 5 * DAY}) AS start_us, least({10 * DAY}, pts_us + {DAY} - {1704067200000000 + 5 * DAY}) AS end_us FROM ({PACKETS})
        WHERE is_key AND pts_us + {DAY} > {1704067200000000 + 5 * DAY} AND pts_us < {1704067200000000 + 15 * DAY}""",
)
def _(spark, d):
    chapters = packets(spark, d).where("is_key").select("stream_index", "seq", F.col("pts_us").alias("start_us"), (F.col("pts_us") + DAY).alias("end_us"))
    return metadata.clipped_chapters(chapters, 1704067200000000 + 5 * DAY, 10 * DAY)


def specified(spec: str, where: str, index: int | None = None) -> None:
    n = f" WHERE n = {index + 1}" if index is not None else ""
    sql = f"SELECT asset_id, stream_index FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY stream_index) AS n FROM ({STREAMS}) WHERE {where}){n}"

    @query(f"specifier_{spec.replace(':', '_')}", sql)
    def _(spark, d):
        return metadata.Specifier(spec).select(tagged(spark, d)).select("asset_id", "stream_index")


specified("v", "kind = 'video'")
specified("V", "kind = 'video' AND NOT attached_pic")
specified("a:1", "kind = 'audio'", 1)
specified("s:u:0", "kind = 'subtitle' AND has_packets", 0)
specified("m:language:fra", "stream_index % 2 = 1")
specified("v:m:title:SMALL", "kind = 'video' AND title = 'SMALL'")
specified("3", "true", 3)


@query(
    "stream_maps",
    f"""SELECT asset_id, stream_index, 0 AS map FROM ({STREAMS}) WHERE kind = 'video' AND NOT (stream_index % 2 = 1)
        UNION ALL SELECT asset_id, stream_index, 2 FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY stream_index) AS n FROM ({STREAMS}) WHERE kind = 'audio') WHERE n = 1""",
)
def _(spark, d):
    return metadata.mapped(tagged(spark, d), ["v", "-m:language:fra", "a:0", "d?"]).select("asset_id", "stream_index", "map")


BEST = """SELECT asset_id, arg_max(stream_index, (score, -stream_index)) AS stream_index, max(score) AS score FROM (
        SELECT *, CAST({score} AS BIGINT) AS score FROM ({streams}) WHERE kind = '{kind}') GROUP BY 1"""
PLUS = "CASE WHEN has_packets THEN 100000000 ELSE 0 END + CASE WHEN is_default THEN 5000000 ELSE 0 END"


@query("best_video_stream", BEST.format(score=f"CASE WHEN attached_pic THEN 1 ELSE width * height + {PLUS} END", streams=STREAMS, kind="video"))
def _(spark, d):
    return metadata.best_streams(streams(spark, d), "video").select("asset_id", "stream_index", "score")


@query("best_audio_stream", BEST.format(score=PLUS, streams=STREAMS, kind="audio"))
def _(spark, d):
    return metadata.best_streams(streams(spark, d), "audio").select("asset_id", "stream_index", "score")


@query("first_streams", f"SELECT asset_id, kind, min(stream_index) AS stream_index FROM ({STREAMS}) GROUP BY 1, 2")
def _(spark, d):
    return metadata.first_streams(streams(spark, d))


# --- text ---


@query("gop_frames", f"SELECT stream_index, greatest(1, (width * 1000 * 4000000::BIGINT + 1001 * 1000000 - 1) // (1001 * 1000000)) AS frames FROM ({STREAMS})")
def _(spark, d):
    return streams(spark, d).select("stream_index", text.gop_frames(F.col("width") * 1000, F.lit(1001), 4_000_000).alias("frames"))


@query("variant_bandwidth", f"SELECT stream_index, ((width * 3000 + 128000) * 11) // 10 AS bandwidth FROM ({STREAMS})")
def _(spark, d):
    return streams(spark, d).select("stream_index", text.bandwidth(F.col("width") * 3000, F.lit(128_000)).alias("bandwidth"))


VARIANT = "((width * 3000 + 128000) * 11) // 10"


@query(
    "master_playlist",
    f"""SELECT asset_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || ({VARIANT}) || ',RESOLUTION=' || width || 'x' || height || chr(10) || 'v' || stream_index || '.m3u8' || chr(10), ''
        ORDER BY {VARIANT}, 'v' || stream_index || '.m3u8') AS playlist FROM ({STREAMS}) WHERE kind = 'video' GROUP BY 1""",
)
def _(spark, d):
    rows = streams(spark, d).where("kind = 'video'").select("asset_id", text.bandwidth(F.col("width") * 3000, F.lit(128_000)).alias("bandwidth"), "width", "height", F.concat(F.lit("v"), F.col("stream_index"), F.lit(".m3u8")).alias("uri"))
    return text.master_playlist(rows)


OPTIONS = ["small", "large", "medium", "promo", "standard", "economy"]


@query(
    "nearest_option",
    f"""WITH o(place, option) AS (VALUES {", ".join(f"({i}, '{o}')" for i, o in enumerate(OPTIONS))}), w AS (SELECT DISTINCT lower(substr(p_type, 2)) AS word FROM part),
        m AS (SELECT word, place, option, levenshtein(word, option) AS distance FROM w, o WHERE levenshtein(word, option) <= 2)
        SELECT word, arg_min(option, (distance, place)) AS option, CAST(min(distance) AS INTEGER) AS distance FROM m GROUP BY 1""",
)
def _(spark, d):
    words = table(spark, d, "part").select(F.lower(F.substring("p_type", 2, 100)).alias("word")).distinct()
    return text.nearest(words, spark.createDataFrame(list(enumerate(OPTIONS)), "place int, option string"))


SAID = "SELECT conv_id, turn, length(text) % 1000 AS n FROM conversations WHERE text IS NOT NULL"


def said(spark, d):
    """Turns, and how far a line of as many milliseconds as characters is."""
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", (F.length("text") % 1_000).alias("n"))


@query(
    "fade_alpha",
    f"""SELECT conv_id, turn, CAST(CASE WHEN n < 100 THEN 255 WHEN n < 400 THEN trunc(255.0::DOUBLE * (1 - (n - 100) / 300.0::DOUBLE) + 32.0::DOUBLE * ((n - 100) / 300.0::DOUBLE)) WHEN n < 700 THEN 32
        WHEN n < 900 THEN trunc(32.0::DOUBLE * (1 - (n - 700) / 200.0::DOUBLE) + 224.0::DOUBLE * ((n - 700) / 200.0::DOUBLE)) ELSE 224 END AS INTEGER) AS alpha FROM (SELECT conv_id, turn, n::DOUBLE AS n FROM ({SAID}))""",
)
def _(spark, d):
    return said(spark, d).select("conv_id", "turn", text.fade(F.col("n"), (255, 32, 224), (100, 400, 700, 900)).alias("alpha"))


@query("move_anchor", f"SELECT conv_id, turn, 10.0::DOUBLE + k * 90.0::DOUBLE AS x, 200.0::DOUBLE + k * -150.0::DOUBLE AS y FROM (SELECT *, CASE WHEN n <= 0 THEN 0.0::DOUBLE WHEN n >= 800 THEN 1.0::DOUBLE ELSE n::DOUBLE / 800 END AS k FROM ({SAID}))")
def _(spark, d):
    x, y = text.moved(F.col("n"), F.lit(800), (10, 200), (100, 50))
    return said(spark, d).select("conv_id", "turn", x.alias("x"), y.alias("y"))


@query(
    "karaoke",
    f"""WITH s AS (SELECT script_id, read_order, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS k, unnest(w) AS word FROM (SELECT script_id, read_order, string_split(text, ' ') AS w FROM ({CUES})))
        SELECT script_id, read_order, k, begin_ms, begin_ms <= 500 AS sung FROM (SELECT *, coalesce(CAST(sum(length(word) * 40) OVER (PARTITION BY script_id, read_order ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begin_ms FROM s)""",
)
def _(spark, d):
    words = cues(spark, d).select("script_id", "read_order", F.posexplode(F.split("text", " ")).alias("k", "word"))
    return text.karaoke(words.withColumn("ms", F.length("word") * 40), 500).select("script_id", "read_order", "k", "begin_ms", "sung")


# --- subtitles ---


def scripts(spark, d):
    """A script a conversation: style and event sections built from its turns."""
    head = "[Script Info]\nTitle: t\n\n[V4+ Styles]\nFormat: Name, Fontname, PrimaryColour\nStyle: Default,Arial,&H00FFFFFF\nStyle: user,Sans,&H000000FF\nStyle: user,Serif,&H0000FF00\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    c = cues(spark, d)
    code = lambda ms: F.concat(F.lit("0:00:"), F.call_function("div", ms, F.lit(1000)), F.lit("."), F.lpad((F.call_function("div", ms, F.lit(10)) % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("Dialogue: "), F.col("layer"), F.lit(","), code(F.col("start_ms")), F.lit(","), code(F.col("start_ms") + F.col("duration_ms")), F.lit(","), F.col("style"), F.lit(",,0,0,0,,{\\b1}"), F.translate("text", "\n\r", "  "))
    lines = c.select("script_id", "read_order", line.alias("line")).groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("read_order", "line"))).alias("l"))
    return lines.select("script_id", F.concat(F.lit(head), F.array_join("l.line", "\n")).alias("script"))


@query("script_events", f"SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY read_order) - 1 AS read_order, CAST(layer AS INTEGER) AS layer, start_ms, duration_ms, style, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM ({CUES})")
def _(spark, d):
    return subtitles.events(scripts(spark, d)).select("script_id", "read_order", "layer", "start_ms", "duration_ms", "style", subtitles.plain_text(F.col("text")).alias("text"))


FORMATS = [
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    "Format: start,  END , Marked,Layer, Effect, Style, Actor, Text, Name",
    "Format: Style, Layer, Layer, Duration, Start, Text",
]


def reordered(spark, d):
    """A script a conversation, whose columns stand in an order of their own or, in a quarter of them, in the usual one."""
    c, k = cues(spark, d), F.col("script_id") % 4
    code = lambda ms: F.concat(F.lit("0:00:"), F.call_function("div", ms, F.lit(1000)), F.lit("."), F.lpad((F.call_function("div", ms, F.lit(10)) % 100).cast("string"), 2, "0"))
    start, end, layer, text = code(F.col("start_ms")), code(F.col("start_ms") + F.col("duration_ms")), F.col("layer").cast("string"), F.translate("text", "\n\r", "  ")
    usual = F.concat_ws(",", layer, start, end, "style", F.lit("n"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("e"), text)
    line = F.when(k == 1, F.concat_ws(",", start, end, F.lit("x"), layer, F.lit(" e "), "style", F.lit("n"), text)).when(k == 2, F.concat_ws(",", "style", F.lit("9"), layer, end, start, text)).otherwise(usual)
    lines = c.select("script_id", "read_order", F.concat(F.lit("Dialogue: "), line).alias("line")).groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("read_order", "line"))).alias("l"))
    head = F.element_at(F.array(*map(F.lit, [*FORMATS, "Comment: none"])), (k + 1).cast("int"))
    return lines.select("script_id", F.concat(F.lit("[V4+ Styles]\n[other]\n [EVENTS]\n"), head, F.lit("\n"), F.array_join("l.line", "\n"), F.lit("\nDialogue: 1,2")).alias("script"))


@query(
    "script_formats",
    f"""SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY read_order) - 1 AS read_order, CAST(layer AS INTEGER) AS layer, start_ms, duration_ms, style,
        CASE WHEN script_id % 4 <> 2 THEN 'n' END AS name, CASE WHEN script_id % 4 <> 2 THEN 'e' END AS effect, CASE WHEN script_id % 4 IN (0, 3) THEN 2 ELSE 0 END AS margin_r,
        rtrim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ' || chr(9)) AS text FROM ({CUES})""",
)
def _(spark, d):
    return subtitles.events(reordered(spark, d)).select("script_id", "read_order", "layer", "start_ms", "duration_ms", "style", "name", "effect", "margin_r", "text")


# what a conversation's first turn says, attached in characters of six bits and lines of 80
@query("script_fonts", "SELECT conv_id AS script_id, 1::BIGINT AS place, 'said ' || conv_id || '.ttf' AS filename, md5(text) AS data FROM conversations WHERE turn = 0 AND text <> ''")
def _(spark, d):
    rows = table(spark, d, "conversations").where("turn = 0 and text <> ''").select("conv_id", F.hex(F.col("text").cast("binary")).alias("h"))
    six = lambda v, k: F.chr(F.shiftright(v, 6 * (3 - k)).bitwiseAND(F.lit(63)) + 33)

    def coded(group):
        v = F.conv(F.rpad(group, 6, "0"), 16, 10).cast("long")
        return F.substring(F.concat(*[six(v, k) for k in range(4)]), F.lit(1), F.call_function("div", F.length(group), F.lit(2)).cast("int") + 1)

    text = F.array_join(F.transform(F.regexp_extract_all("h", F.lit("[0-9A-F]{1,6}"), 0), coded), "")
    lines = F.array_join(F.regexp_extract_all(text, F.lit(".{1,80}"), 0), "\n")
    script = F.concat(F.lit("[Fonts]\nlost\nfontname: said "), F.col("conv_id").cast("string"), F.lit(".ttf\n"), lines, F.lit("\nfontname: broken\n!!!!!\n[Events]\n"))
    found = subtitles.fonts(rows.select(F.col("conv_id").alias("script_id"), script.alias("script")))
    return found.select("script_id", F.col("place").cast("long").alias("place"), "filename", F.md5("data").alias("data"))


@query("script_styles", f"SELECT DISTINCT s.script_id, v.* FROM ({CUES}) s, (VALUES ('Default', 'Arial', 255, 255, 255), ('user', 'Sans', 255, 0, 0), ('user', 'Serif', 0, 255, 0)) v(name, font, r, g, b)")
def _(spark, d):
    return subtitles.styles(scripts(spark, d)).select("script_id", "name", F.col("fields")["fontname"].alias("font"), "colour.r", "colour.g", "colour.b")


@query("styled_events", f"SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY read_order) - 1 AS read_order, CASE WHEN style = 'user' AND read_order % 4 < 2 THEN 0 ELSE 255 END AS r, 255 AS g FROM ({CUES})")
def _(spark, d):
    """Names as they are, behind asterisks, in other case (which is an unknown name) and the default's in any case."""
    s = scripts(spark, d)
    k = F.col("read_order") % 4
    name = F.when(k == 0, F.col("style")).when(k == 1, F.concat(F.lit("**"), "style")).when(k == 2, F.initcap("style")).otherwise("DEFAULT")
    return subtitles.styled(subtitles.events(s).withColumn("style", name), subtitles.styles(s)).select("script_id", "read_order", "colour.r", "colour.g")


@query(
    "visible_events",
    f"""SELECT script_id, t_ms, read_order, row_number() OVER (PARTITION BY script_id, t_ms ORDER BY layer, read_order) AS z FROM (
        SELECT c.*, t.t_ms FROM ({CUES}) c JOIN (SELECT script_id, unnest(generate_series(0, greatest(0, max(start_ms + duration_ms)), 700)) AS t_ms FROM ({CUES}) GROUP BY 1) t USING (script_id))
        WHERE t_ms >= start_ms AND t_ms < start_ms + duration_ms""",
)
def _(spark, d):
    c = cues(spark, d)
    ends = c.groupBy("script_id").agg(F.greatest(F.lit(0), F.max(F.col("start_ms") + F.col("duration_ms"))).cast("long").alias("end_ms"))
    frames = ends.select("script_id", F.explode(F.sequence(F.lit(0).cast("long"), "end_ms", F.lit(700).cast("long"))).alias("t_ms"))
    return subtitles.visible(frames, c).select("script_id", "t_ms", "read_order", "z")


@query("first_by_read_order", f"SELECT script_id, read_order, min(seq) AS seq FROM (SELECT stream_index AS script_id, seq % 20 AS read_order, seq FROM ({PACKETS})) GROUP BY 1, 2")
def _(spark, d):
    rows = packets(spark, d).select(F.col("stream_index").alias("script_id"), (F.col("seq") % 20).alias("read_order"), "seq")
    return subtitles.first_by_order(rows)


@query("srt_cues", f"SELECT stream_index AS script_id, k AS read_order, k * 1000 AS start_ms, 500 + k AS duration_ms, 'line ' || k AS text FROM (SELECT DISTINCT stream_index FROM ({PACKETS})), range(5) t(k)")
def _(spark, d):
    cue = "\n\n".join(f"{k + 1}\n00:00:0{k},000 --> 00:00:0{k},{500 + k}\nline {k}" for k in range(5))
    return subtitles.srt_cues(packets(spark, d).select(F.col("stream_index").alias("script_id")).distinct().withColumn("script", F.lit(cue)))


# --- pixels ---

# four bytes of what is said are a pixel: what is there, what is drawn, its mask and its opacity
PIXELS = """SELECT (conv_id * 64 + turn) * 65536 + i AS seq, CAST(('0x' || substr(h, 8 * i + 1, 2)) AS BIGINT) AS dst, CAST(('0x' || substr(h, 8 * i + 3, 2)) AS BIGINT) AS src,
        CAST(('0x' || substr(h, 8 * i + 5, 2)) AS BIGINT) AS mask, CAST(('0x' || substr(h, 8 * i + 7, 2)) AS BIGINT) AS opacity
        FROM (SELECT *, unnest(range(length(h) // 8)) AS i FROM (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations))"""


def grid(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 64 + F.col("turn")).alias("talk"), F.posexplode(F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("[0-9A-F]{8}"), 0)).alias("i", "p"))
    return rows.select((F.col("talk") * 65_536 + F.col("i")).alias("seq"), *[F.conv(F.substring("p", k, 2), 16, 10).cast("long").alias(c) for k, c in ((1, "dst"), (3, "src"), (5, "mask"), (7, "opacity"))])


@query("blend", f"SELECT seq, ((16843009 - mask * ((opacity * 66311 + 3) >> 8)) * dst + mask * ((opacity * 66311 + 3) >> 8) * src) >> 24 AS v FROM ({PIXELS})")
def _(spark, d):
    return grid(spark, d).select("seq", pixels.blended(F.col("dst"), F.col("src"), F.col("mask"), F.col("opacity")).alias("v"))


@query("pooled_chroma", f"SELECT seq // 4 AS cell, CAST(sum(mask) AS BIGINT) >> 2 AS mask FROM ({PIXELS}) GROUP BY 1")
def _(spark, d):
    return grid(spark, d).groupBy(F.call_function("div", F.col("seq"), F.lit(4)).alias("cell")).agg(pixels.pooled_mask(F.sum("mask"), 1, 1).alias("mask"))


@query(
    "rgb_to_yuv",
    f"""SELECT seq, CAST(floor(y * (219 / 255.0::DOUBLE) + 16 + 0.5) AS INTEGER) AS y, CAST(floor((src - y) / (2 * (1 - 0.0722::DOUBLE)) * (224 / 255.0::DOUBLE) + 128 + 0.5) AS INTEGER) AS cb,
        CAST(floor((dst - y) / (2 * (1 - 0.2126::DOUBLE)) * (224 / 255.0::DOUBLE) + 128 + 0.5) AS INTEGER) AS cr FROM (SELECT *, dst * 0.2126::DOUBLE + mask * (1 - 0.2126::DOUBLE - 0.0722::DOUBLE) + src * 0.0722::DOUBLE AS y FROM ({PIXELS}))""",
)
def _(spark, d):
    y, cb, cr = pixels.yuv(F.col("dst"), F.col("mask"), F.col("src"))
    return grid(spark, d).select("seq", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


@query("combined_alpha", f"SELECT seq, dst - (dst * src + 127) // 255 + src AS alpha FROM ({PIXELS})")
def _(spark, d):
    return grid(spark, d).select("seq", pixels.combined_alpha(F.col("dst"), F.col("src")).alias("alpha"))


@query("interval_overlap", f"SELECT seq, greatest(0, least(dst + 40, src + 60) - greatest(dst, src)) AS n FROM ({PIXELS})")
def _(spark, d):
    return grid(spark, d).select("seq", pixels.overlap(F.col("dst"), F.col("dst") + 40, F.col("src"), F.col("src") + 60).alias("n"))


@query("adjust_pixels", f"SELECT seq, round(pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((dst / 255.0::DOUBLE) * pow(2.0::DOUBLE, 0.5) + 0.1::DOUBLE - 0.5) * 1.2::DOUBLE + 0.5)), 1 / 2.2::DOUBLE), 9) AS v FROM ({PIXELS})")
def _(spark, d):
    return grid(spark, d).select("seq", F.round(pixels.adjusted(F.col("dst") / 255.0, exposure=0.5, brightness=0.1, contrast=1.2, gamma=2.2), 9).alias("v"))
