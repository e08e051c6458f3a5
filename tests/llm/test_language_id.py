"""Language identification: held-out accuracy, the two steps, margins against plain counting, odd rows."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, score string"
DATA = os.environ.get("LEADLOOM_TEST_DATA", "/root/testdata/sf0.001")
PARTS = {
    "en": "the and ing tion with that ough sh er ly of to", "de": "und der sch keit ung ein ich ver ge tz ist die", "nl": "het een van ij oor aan niet sch cht zijn aar ook",
    "fr": "les eau oux que ment dans elle tion ai est une", "es": "los que ción mente ñ ado ar el por ez rr ll", "it": "gli che zione mente della ino ato sono per cchi ggi",
    "fi": "ää yö ssa nen tta kk ui en on ja lla ksi", "qq": "xq zz wv qk jx vv kq zx",
}


def text_of(lang, r, n):
    parts = PARTS[lang].split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_languages_and_odd_rows(spark):
    r = random.Random(1)
    rows = [(i, text_of(lang, r, r.randint(3, 60)), lang, "clash") for i, lang in enumerate(sorted(PARTS) * 60)]
    truth = {i: lang for i, _, lang, _ in rows}
    rows += [(5000, None, "en", ""), (5001, "", "en", ""), (5002, "123 !? 4.5\n", "fr", ""), (5003, text_of("de", r, 40), None, ""), (None, text_of("es", r, 40), "es", ""), (0, rows[0][1], rows[0][2], "repeated")]
    rows += [(5004, text_of("fi", r, 20) + " word" * 0 + " ää yö" * 200_000, None, "very long")]
    got = li.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
    by = {g["doc_id"]: g for g in got}
    assert all(g["held_out"] == (g["doc_id"] is not None and held(g["doc_id"])) for g in got)
    asked = [i for i in truth if held(i)]
    assert len(asked) > 80 and np.mean([by[i]["lang_pred"] == truth[i] for i in asked]) >= 0.97
    for i in (5000, 5001, 5002):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[5003]["lang_pred"] == "de" and by[None]["lang_pred"] == "es" and by[5004]["lang_pred"] == "fi"
    assert len({(g["lang_pred"], g["score"]) for g in got if g["doc_id"] == 0}) == 1


def test_only_what_is_not_held_out_teaches(spark):
    r = random.Random(2)
    ids = [i for i in range(4000) if held(i)][:40]
    free = [i for i in range(4000) if not held(i)][:40]
    rows = [(i, text_of("en", r, 30), "en", "") for i in free] + [(i, text_of("fr", r, 30), "fr", "") for i in ids]
    assert {g["lang_pred"] for g in li.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {"en"}
    # other labels, ids and columns of held-out rows change no prediction
    more = [(i, t, lang if not held(i) else "zz", "other") for i, t, lang, _ in rows]
    assert {tuple(g) for g in li.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {tuple(g) for g in li.identify(spark.createDataFrame(more, SCHEMA)).collect()}


def test_empty_tables(spark):
    assert li.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    got = li.identify(spark.createDataFrame([(1, "some words", None, "")], SCHEMA)).collect()
    assert [(g["lang_pred"], g["score"]) for g in got] == [("und", 0.0)]


def test_family_comes_first():
    assert li.family_of("de") == li.family_of("en-GB") == li.family_of("nl") != li.family_of("fr") == li.family_of("pt_BR") and li.family_of("qq") == "qq"
    r, s = random.Random(3), li.Settings()
    langs = np.array(sorted(PARTS) * 30, object)
    x = li.features(pa.array([" " + text_of(lang, r, 30) + " " for lang in langs]), s)
    model = li.fit(x, langs, {lang: li.family_of(lang) for lang in PARTS}, s)
    assert set(model.families.names) == {"germanic", "romance", "uralic", "qq"} and model.within["germanic"].names == ["de", "en", "nl"]
    assert model.families.weights.shape[1] == 6 and model.within["romance"].weights.shape[1] == 3 and model.within["qq"].weights.shape[1] == 0


def test_margins_equal_features_times_weights():
    r, s = random.Random(4), li.Settings(bits=8)
    texts = ["", " a ", " ab ", *(" " + text_of(lang, r, 20) + " " for lang in PARTS), "é"]
    w, b = np.random.default_rng(0).normal(size=(256, 3)), np.array([0.5, -1.0, 2.0])
    column = pa.array(["xx", *texts]).slice(1)
    assert np.allclose(li.margins(column, w, b, s), li.features(column, s) @ w + b, atol=1e-4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_accuracy_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = li.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert len(got) > 30 and np.mean([g["lang"] == g["lang_pred"] for g in got]) >= 0.95


def test_a_text_scores_the_same_wherever_it_lies():
    r = random.Random(9)
    s = li.Settings()
    weights = np.random.default_rng(9).normal(size=(1 << s.bits, 3))
    texts = [text_of(lang, r, r.randint(0, 60)) for lang in sorted(PARTS) * 40] + ["", "a", "ab"]
    alone = np.concatenate([li.margins(pa.array([t]), weights, np.ones(3), s) for t in texts])
    assert (li.margins(pa.array(texts), weights, np.ones(3), s) == alone).all()
