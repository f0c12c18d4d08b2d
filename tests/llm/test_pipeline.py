"""The pipeline against a plain version that applies the operators' decisions one after the other."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinoframe.llm import base, language, packing, simhash, toxicity
from kinoframe.llm.base import only
from tests.conftest import SF
from tests.llm.test_text_operators import brute_components


def test_stages_and_result(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    frame = lambda: spark.createDataFrame([tuple(r) for r in kept.values()], docs.schema)

    model = language.train(docs.select("doc_id", "text", "lang"))
    for r in language.predict(only(frame(), "doc_id", "text"), model).collect():
        if r.lang_pred == "und" or r.score <= language.CONFIDENT:
            del kept[r.doc_id]
    texts = only(frame(), "doc_id", "text")
    tox = toxicity.train(texts, spark.read.parquet(f"{SF}/labels.parquet"))
    for r in toxicity.score(texts, tox).collect():
        if r.predicted:
            del kept[r.doc_id]
    seen = {}
    for i in sorted(kept):
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i].text or ""), i)
    kept = {i: kept[i] for i in seen.values()}
    low = brute_components([(i, simhash.fingerprint(r.text)) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if low[i] == i}

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = sorted(tuple(r) for r in packing.pieces(only(frame(), "doc_id", "text"), path).collect())
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == want
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_filters_keep_the_columns(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and 0.5 * docs.count() < out.count() <= docs.count()


def test_rows_with_one_id_or_none_are_judged_each(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    words = " ".join(f"word{chr(97 + i % 26) * (1 + i // 26)}" for i in range(400))
    near = words.replace("wordk ", "other ", 1)
    far = " ".join(f"thing{chr(97 + i % 26) * (1 + i // 26)}" for i in range(400))
    assert 0 < (simhash.fingerprint(words) ^ simhash.fingerprint(near)).bit_count() <= 4 < (simhash.fingerprint(words) ^ simhash.fingerprint(far)).bit_count()

    def left(stage, data):
        out = stage(spark, spark.createDataFrame(data, "doc_id long, text string, lang string"), str(tmp_path))
        return sorted((r.doc_id or 0, r.text or "") for r in out.collect())

    tongue = [(1, far, "en"), (1, None, "en"), (None, None, "en"), (None, words, "en"), *[(i, words, "en") for i in range(10, 20)]]
    assert left(corpus_pipeline.keep_known_languages, tongue) == sorted((i or 0, t) for i, t, _ in tongue if t)
    # two texts under one id; a near copy without an id; a pair without ids
    assert left(corpus_pipeline.drop_near_copies, [(1, words, "en"), (1, far, "en"), (None, near, "en")]) == sorted([(1, words), (1, far)])
    assert left(corpus_pipeline.drop_near_copies, [(5, far, "en"), (5, words, "en"), (4, near, "en")]) == sorted([(5, far), (4, near)])
    assert len(left(corpus_pipeline.drop_near_copies, [(None, words, "en"), (None, near, "en"), (None, far, "en")])) == 2
    assert left(corpus_pipeline.drop_copies, [(1, words, "en"), (1, far, "en"), (None, far, "en")]) == sorted([(1, words), (1, far)])


def test_toxic_rows_with_one_id_or_none_are_judged_each(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *a: toxicity.Model(b"loser idiot scum", b"ordinary words", [-9.0, 1.0, 0, 0, 0, 0, 0]))
    monkeypatch.setattr(spark.__class__, "read", property(lambda self: type("R", (), {"parquet": lambda *a: None})()))
    data = [(i, t) for i in (1, None) for t in ("loser idiot scum", "ordinary words")]
    out = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "ordinary words"), (1, "ordinary words")]


def test_chains_of_copies_go_through_rows_without_id(spark):
    base = 0x123456789ABCDEF
    prints = [(1, base), (None, base ^ 0xF), (2, base ^ 0xFF)]
    got = simhash.kept_of(spark.createDataFrame(prints, "doc_id long, fp long"), F.col("doc_id"), 4, 6).collect()
    assert {r.kept for r in got} == {1} and len(got) == 3


ODD = "doc_id long, text string, lang string, source string, n_chars long, score int, fp long, _keep boolean, _file string, digest string, length int, _metadata string, _dedup_file string, _dedup_row int, _key int"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_nothing_and_on_odd_rows(spark, tmp_path, stage):
    """Empty tables; nulls in every column, repeats, a very long text, and names that the operators use."""
    spark.createDataFrame([(None, 1), (1, None), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], ODD)
    assert stage(spark, empty, str(tmp_path)).count() == 0
    rest = ("s", 1, 2, 3, True, "f", "d", 4, "m", "f", 5, 6)
    long = "some quite ordinary words of a very long text " * 20_000
    rows = [(1, "some ordinary words", "en", *rest)] * 3 + [(None, long, None, *rest), (2, "", "en", *rest), (3, None, None, *[None] * 12), (None, None, None, *[None] * 12)]
    out = stage(spark, spark.createDataFrame(rows, ODD), str(tmp_path))
    got = out.collect()
    name = stage.__name__
    if name == "pack":
        assert sum(r.length for r in got if r.doc_id is None) > 100_000 and len({(r.doc_id, r.piece) for r in got}) >= 3
        return
    assert out.columns == [c.split()[0] for c in ODD.split(", ")]
    want = {"keep_known_languages": {"some ordinary words": 3, long: 1}, "drop_toxic": {"some ordinary words": 3, long: 1, "": 1, None: 2}, "drop_copies": {"some ordinary words": 1, long: 1, "": 1}, "drop_near_copies": {"some ordinary words": 1, long: 1, "": 1}}[name]
    texts = [r.text for r in got]
    assert {t: texts.count(t) for t in texts} == want
    if name == "keep_known_languages":
        assert {r.lang for r in got} == {"en"}


def test_language_that_cannot_be_told_goes(spark, tmp_path):
    data = [(i, "the and with from", "en") for i in range(40)] + [(i, "der und nicht eine", "de") for i in range(50, 90)] + [(100, "日本", None), (101, "the", None)]
    out = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(data, "doc_id long, text string, lang string"), "").collect()
    kept = {r.doc_id: r.lang for r in out}
    # no language is likelier than the other for 100, whatever its rank
    assert len(kept) == 81 and kept[101] == "en"


def test_scratch_goes_with_its_stage(spark):
    before = set(base._scratch)
    with base.only_result(spark) as keep:
        base.stored(spark.range(3).toDF("x"), "a")
        out = base.stored(spark.range(4).toDF("x"), "b", keep)
    assert set(base._scratch) - before == set(keep) and out.count() == 4
    base.drop_scratch(spark, *keep)
    assert set(base._scratch) == before


def test_a_machines_own_folder_is_refused_on_a_cluster():
    class Session:
        def __init__(self, master, own, warehouse):
            unset = type("C", (), {"get": lambda self, key, other=None: {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": own}.get(key) or other})
            self.conf = unset()
            self.sparkContext = type("S", (), {"master": master, "getConf": lambda self: unset()})()

    assert base.shared_dir(Session("yarn", "hdfs:/c", "file:/w")) == "hdfs:/c"
    assert base.shared_dir(Session("local[4]", None, "file:/w/")) == "file:/w/_shared"
    assert base.shared_dir(Session("yarn", None, "hdfs:/w")) == "hdfs:/w/_shared"
    with pytest.raises(ValueError):
        base.shared_dir(Session("yarn", None, "file:/w"))
