"""Dedup, sharding, near-duplicates, language and toxicity on edge cases, against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinoframe.llm import exact_dedup, language, sharding, simhash, toxicity
from kinoframe.llm.base import only
from tests.llm.conftest import TEXTS


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- sharding ---


def check_shards(found, want, k):
    by = defaultdict(list)
    for shard, slot in found:
        by[shard].append(slot)
    counts = [len(by[s]) for s in range(k)]
    assert sum(counts) == want and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 20_000])
def test_shards_are_even_and_whole(docs, bucket_bytes):
    out = sharding.shuffle_shards(docs, 4, bucket_bytes=bucket_bytes)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.collect()
    check_shards([(r.shard, r.slot) for r in got], len(TEXTS), 4)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(TEXTS)


def test_shards_shuffle_repeats_itself_and_follows_the_seed(spark):
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b, c = (rows(sharding.shuffle_shards(many, 8, seed=s).orderBy("shard", "slot").select("doc_id")) for s in (1, 1, 2))
    assert a == b != c and a != sorted(a)


def test_shards_of_nothing_and_of_null_ids(nothing, odd_id, tmp_path):
    assert sharding.shuffle_shards(nothing, 3).count() == 0
    check_shards([(r.shard, r.slot) for r in sharding.shuffle_shards(odd_id, 2).collect()], 3, 2)
    sharding.write_shards(odd_id, str(tmp_path / "s"), n_shards=2)
    assert odd_id.sparkSession.read.parquet(str(tmp_path / "s")).count() == 3


def test_shards_order_comes_from_the_seed_alone(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), (F.col("id") % 50).cast("int")).alias("text"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, files in ((2, 1), (7, 5), (211, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(sorted(rows(sharding.shuffle_shards(many.repartition(files), 8, bucket_bytes=20_000).select("shard", "slot", "doc_id"))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_shards_split_an_id_that_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 100)
    data = [(i, "t") for i in range(600)] + [(7, "t")] * 300 + [(8, f"t {i}") for i in range(300)] + [(None, "x")] * 200
    many = spark.createDataFrame(data, "doc_id long, text string")
    out = sharding.shuffle_shards(many, 4, bucket_bytes=2_000)
    got = out.collect()
    check_shards([(r.shard, r.slot) for r in got], len(data), 4)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(data)
    # no bucket holds a hot id whole: its rows lie all over the shards
    assert all(sum(r.doc_id == i and r.shard == s for r in got) > 20 for i in (7, 8, None) for s in range(4))
    assert sorted(rows(out), key=str) == sorted(rows(sharding.shuffle_shards(many.repartition(5), 4, bucket_bytes=2_000)), key=str)


# --- exact dedup ---


def brute_groups(texts):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    return Counter((i, min(groups[norm(t)]), len(groups[norm(t)])) for i, t in texts)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.lit("same"), lambda t: F.octet_length(t) % 3])
def test_groups_even_where_digests_collide(docs, digest):
    got = exact_dedup.groups(docs, digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == brute_groups(TEXTS)
    assert sum(r.kept for r in got) == len({k for _, k, _ in brute_groups(TEXTS)})


def test_state_lives_through_many_batches(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id") % 7).alias("text")).repartition(6).write.parquet(path)
    got = exact_dedup.groups(spark.read.parquet(path), per_trigger={"maxFilesPerTrigger": 1}).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(i, i % 7) for i in range(60)} and sum(r.kept for r in got) == 7


def test_deduplicate_keeps_columns_and_first_rows(docs, nothing, odd_id):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _ in brute_groups(TEXTS)})
    assert exact_dedup.deduplicate(nothing).count() == 0
    assert exact_dedup.deduplicate(odd_id.union(odd_id)).count() == 3


def test_rows_that_share_a_place_in_a_file_are_rows_of_their_own(spark, tmp_path):
    lists = [(10, ["a b", "a b", "c d"]), (20, ["c d", "e f"])]
    spark.createDataFrame(lists, "doc_id long, texts array<string>").coalesce(1).write.parquet(f"{tmp_path}/lists")
    scan = spark.read.parquet(f"{tmp_path}/lists")
    exploded = scan.select("doc_id", F.explode("texts").alias("text"))
    twice = exploded.join(spark.range(2).withColumnRenamed("id", "k"))
    for made in (exploded, exploded.unionByName(exploded), twice):
        plain = [(r.doc_id, r.text) for r in made.collect()]
        got = exact_dedup.groups(made).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == brute_groups(plain)
        assert sum(r.kept for r in got) == 3 and len({(r._file, r._row) for r in got}) == len(plain)
        assert sorted(r.text for r in exact_dedup.deduplicate(made).collect()) == ["a b", "c d", "e f"]
        assert len(simhash.deduplicate(made).collect()) == 3


# --- near-duplicates ---


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    """Smallest id reachable over links of at most ``distance`` bits."""
    low = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, f in prints:
            for j, g in prints:
                if (f ^ g).bit_count() <= distance and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprints_match_the_definition():
    for _, t in TEXTS[:10]:
        short = t and t[:3000]
        assert simhash.fingerprint(short) == brute_fingerprint(short)


def test_fingerprint_of_more_shingles_than_a_step():
    pick = np.random.default_rng(4)
    text = " ".join(f"w{x}" for x in pick.integers(0, 900, 70_000))
    assert len(text.split()) - 3 > 1 << 16 and simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_match_brute_force(docs, nothing, odd_id):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(only(docs, "doc_id", "text")).collect()}
    prints = [(i, simhash.fingerprint(t)) for i, t in TEXTS]
    assert got == brute_components(prints)
    assert simhash.near_duplicates(only(nothing, "doc_id", "text")).count() == 0
    assert simhash.near_duplicates(only(odd_id, "doc_id", "text")).count() == 3


@pytest.mark.parametrize("spread", [1, 2, 5])
def test_links_of_clusters_and_chains(spark, spread):
    """Dense clusters, chains of neighbours that reach far, and noise."""
    rng = np.random.default_rng(spread)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in fps[:6]:
        for _ in range(40):
            f = base
            for b in rng.integers(0, 64, spread):
                f ^= 1 << int(b)
            fps.append(f)
    f = fps[10]
    for k in range(30):
        f ^= 0b1111 << int(rng.integers(0, 60))
        fps.append(f)
    fps = sorted(set(fps))
    nodes = [(i, f) for i, f in enumerate(fps)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in nodes]
    df = spark.createDataFrame(signed, "node long, fp long")
    want = brute_components(nodes)
    for hot in (simhash.HOT, 8):  # the dense clusters are dealt again, down to the last level
        stars = {r.node: r.component for r in simhash.components(simhash.links(df, hot=hot)).collect()}
        assert {i: stars.get(i, i) for i, _ in nodes} == want


def test_masks_of_dealt_buckets_miss_no_pair():
    """Whatever four bits differ, one mask of every level is free of them; the last leaves as many free as a task holds."""
    rng = np.random.default_rng(3)
    masks = [0]
    for _ in range(3):
        masks = [m for mask in masks for m in simhash.tables_in(mask, 4, 6)]
        for _ in range(50):
            differ = sum({1 << int(b) for b in rng.choice(64, 4, replace=False)})
            assert any(not m & differ for m in masks)
    assert len(masks) == 3375 and max(64 - m.bit_count() for m in masks) == 20 and 1 << 20 == simhash.HOT


def test_gray_rank_orders_neighbours():
    codes = np.array([i ^ (i >> 1) for i in range(1 << 10)], np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(1 << 10)).all()


# --- language ---


@pytest.fixture(scope="module")
def tongues(spark):
    words = {"en": "the and with from this that have been which their".split(), "de": "der und nicht eine auch sich werden durch über schön".split()}
    rng = np.random.default_rng(0)
    data = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(["en", "de"] * 100)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_language_learns_and_backs_off(spark, tongues, docs, nothing):
    model = language.train(tongues)
    assert model.langs and set(model.langs) == {"en", "de"}
    new = spark.createDataFrame([(1, "The AND, with!"), (2, "unter schönheit"), (3, None), (4, ""), (5, "12 34 ²"), (6, "日本語"), (7, "und " * 20_000), (8, "x" * 30_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(new, model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["en", "de", "und", "und", "und", model.langs[0], "de"]
    assert got[8][0] in model.langs and all(0 <= s <= 1 for _, s in got.values())
    assert language.predict(only(nothing, "doc_id", "text"), model).count() == 0
    assert {r.lang_pred for r in language.predict(only(docs, "doc_id", "text"), language.train(nothing)).collect()} == {"und"}


def test_language_with_few_rows_is_learned_from_a_sample(spark, tongues):
    few = spark.createDataFrame([(i, "kissa koira talo", "fi") for i in range(1000, 1006)] + [(i, "12 34", "none") for i in range(2000, 2009)], tongues.schema)
    model = language.train(tongues.unionByName(few), sample_docs=6)
    assert set(model.langs) == {"en", "de", "fi"}
    assert [x for x, _ in model.predictor()(["koira talo", "the which", "nicht werden"])] == ["fi", "en", "de"]


def test_language_with_few_rows_does_not_take_rare_words(spark):
    counts = spark.createDataFrame([("en", "the", 100_000), ("en", "rare", 2), ("fi", "talo", 5), ("fi", "the", 1)], "lang string, item string, n long")
    found = language.frequencies(counts, ["en", "fi", "none"], "words", 2)
    assert found["rare"][0] > found["rare"][1] == found["rare"][2]
    assert found["talo"][1] > found["talo"][0] == found["talo"][2]


def test_language_of_texts_without_words_is_not_learned(spark):
    model = language.train(spark.createDataFrame([(i, "12 34", "none") for i in range(20)], "doc_id long, text string, lang string"))
    assert model.langs == [] and model.predictor()(["a word"]) == [("und", 0.0)]


def test_language_scores_by_the_definition(spark, tongues):
    """Counts and scores by plain loops over the sample, which is all that is not held out."""
    train = [(r.lang, r.text) for r in tongues.where(~language.held_out()).collect()]
    langs = sorted({x for x, _ in train}, key=lambda x: (-sum(y == x for y, _ in train), x))
    grams = lambda w, n: [g for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) != " "]

    def table(items, least):
        counts = {x: Counter(i for lang, t in train if lang == x for i in items(t)) for x in langs}
        known = {i for c in counts.values() for i, n in c.items() if n >= least}
        out = {}
        for i in known:
            size = len(i) if least == 1 else 0
            own = {x: sum(n for j, n in counts[x].items() if j in known and (least > 1 or len(j) == size)) for x in langs}
            most = max(own.values())
            out[i] = [np.log((counts[x][i] / own[x] * most + 0.5) / (most + 0.5 * len(known))) for x in langs]
        return out

    words = table(lambda t: t.split(), 2)
    parts = table(lambda t: [g for w in t.split() for n in range(1, 6) for g in grams(w, n)], 1)

    def word(w):
        if w in words:
            return np.array(words[w])
        for n in (5, 4, 3, 2, 1):
            if found := [parts[g] for g in grams(w, n) if g in parts]:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    texts = ["the und", "unter which", "durchaus nichts", "withal theirs schön", "日本 x", "q"]
    got = language.train(tongues).predictor()(texts)
    for t, (lang, score) in zip(texts, got):
        x = sum(word(w) for w in t.split())
        assert lang == langs[int(np.argmax(x))]
        assert score == pytest.approx(1 / np.exp(x - x.max()).sum())


def test_language_held_out_accuracy(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.query(spark, SF).join(docs, "doc_id").where("held_out")
    n, good = got.count(), got.where("lang_pred = lang").count()
    assert n > 20 and good >= 0.95 * n


# --- toxicity ---


def test_toxicity_scores_every_text(spark, docs, nothing):
    base = " ".join(["plain ordinary words about nothing much in particular today"] * 4)
    data = [(i, f"{base} {i} " + ("what a worthless loser idiot you are scum " if i % 5 == 0 else "")) for i in range(200)]
    train = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in data] + [(0, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(train, labels)
    got = {r.doc_id: r for r in toxicity.score(train, model).collect()}
    assert all(r.predicted == (i % 5 == 0) for i, r in got.items())
    edge = toxicity.score(only(docs, "doc_id", "text"), model).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r.score <= 1 for r in edge)
    scores = {r.doc_id: r.score for r in edge}
    assert scores[9] > scores[1] and scores[1] == scores[5] and scores[2] == scores[3] == scores[4]
    assert toxicity.score(only(nothing, "doc_id", "text"), model).count() == 0
    assert {r.score for r in toxicity.score(train, toxicity.train(train, labels.where("toxic = 0"))).collect()} == {0.0}


def test_toxicity_is_the_compression_distance(spark):
    """Windows, distances, features and the score by the definition, and labels of the held-out part unused."""
    import zstandard

    data = [(i, f"plain ordinary words number {i} " + ("you worthless loser " if i % 3 == 0 else "") * 2) for i in range(120)]
    texts = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in data], "doc_id long, toxic int")
    model = toxicity.train(texts, labels)
    swapped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(texts, swapped)
    assert (model.toxic, model.ordinary, model.weights) == (other.toxic, other.ordinary, other.weights)
    press = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(c, dict_type=1), write_checksum=False, write_content_size=False, write_dict_id=False) for c in (model.toxic, model.ordinary)]
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    for i, t in data:
        body = " ".join(t.lower().split()).encode()
        d = []
        for at in range(0, max(1, len(body) - 64 + 48), 48):
            sizes = [len(p.compress(body[at : at + 64])) for p in press]
            d.append(sizes[1] - sizes[0])
        top, hits = sorted(d)[-2:], sum(x >= 2 for x in d)
        x = [1, top[-1], top[0], sum(d) / len(d), hits / len(d), hits / len(d) ** 0.5, np.log(len(d))]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))))


def test_toxicity_takes_null_ids_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "no id"), (1, "bad loser"), (1, "bad loser"), (1, "bad scum"), (2, "good words")] * 20, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, "t"), (1, 1, "t"), (1, 0, "t"), (2, 0, "t")], "doc_id long, toxic int, text string")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 100 and len({r.score for r in out if r.doc_id is None}) == 1


def test_toxicity_threshold_is_the_same_on_a_thinned_sample(spark):
    # of texts of two windows one in five is toxic, which is less than the threshold however few ordinary ones are sampled
    shape = {"describe": lambda d: (1.0, float(len(d) > 1))}
    data = [(i, "plain ordinary words " * (5 if i % 5 == 0 else 1) + str(i)) for i in range(2000)]
    texts = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 25 == 0)) for i, _ in data], "doc_id long, toxic int")
    for most in ({}, {"ordinary_docs": 350}, {"toxic_docs": 30}):
        short, long = toxicity.train(texts, labels, **most, **shape).scorer()([data[1][1], data[0][1]])
        assert short < 0.02 and 0.12 < long < 0.28, most


def test_columns_with_the_names_that_operators_use(spark):
    names = ["_key", "_metadata", "_dedup_file", "_dedup_row", "_file", "_row", "n", "run", "at", "record", "bucket"]
    rows = [(i, f"text {i % 3} of a few words here", *[f"{c}{i}" for c in names]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(2)
    dealt = sharding.shuffle_shards(docs, 2)
    assert sorted(tuple(r)[:-2] for r in dealt.collect()) == rows and dealt.columns[:-2] == docs.columns
    for kept in (exact_dedup.deduplicate(docs), simhash.deduplicate(docs, shingle=2)):
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[:3]
