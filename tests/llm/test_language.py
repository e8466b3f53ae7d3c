import math
import random
import zlib

import numpy as np
import pytest

from orderlens.llm import language
from orderlens.llm.queries import PIECES, QUERIES


def test_query_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op7_language_id"](spark, sf_dir).collect()
    wanted = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(wanted)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.held_out and wanted[r.doc_id].text:
            total += 1
            right += r.lang_pred == wanted[r.doc_id].lang
    assert total > 200 and right >= 0.97 * total


def all_segmentations(word, number):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in number or i == 1:
            for rest in all_segmentations(word[i:], number):
                yield [word[:i], *rest]


def test_forward_sums_all_segmentations():
    pieces = language.vocabulary(PIECES)
    weights = np.random.default_rng(1).random((pieces.size, 3)) + 0.01
    words = ["▁the", "▁schule", "▁日x", "▁niños", "▁a"]
    logs = pieces.forward(words, weights)
    for word, found in zip(words, logs):
        total = sum(
            np.prod([weights[pieces.number.get(p, pieces.size - 1)] for p in way], axis=0)
            for way in all_segmentations(word, pieces.number)
        )
        assert found == pytest.approx(np.log(total))


def test_long_words_agree_with_short_ones():
    pieces = language.vocabulary(PIECES)
    weights = np.random.default_rng(2).random((pieces.size, 2)) / 1000
    for word in ("▁internationalization", "▁abc"):
        assert pieces._scaled(word, weights) == pytest.approx(pieces.forward([word], weights)[0])
    assert np.isfinite(pieces.forward(["▁" + "ab" * 5000], weights)).all()


def test_expected_uses_add_up():
    """The expected lengths of all pieces are those of the words."""
    pieces = language.vocabulary(PIECES)
    weights = np.full(pieces.size, 1 / pieces.size)
    uses = pieces.expected(["▁hello", "▁du"], np.array([2.0, 3.0]), weights)
    sizes = np.array([len(t) for t in sorted(pieces.number, key=pieces.number.get)] + [1])
    assert (uses * sizes).sum() == pytest.approx(2 * 6 + 3 * 3)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    return language.fit(docs, PIECES)


def test_odd_rows(spark, odd, nothing, model):
    langs, weights = model
    rows = {r.id: r for r in language.predict(odd, PIECES, langs, weights).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 9))
    assert rows[1].lang_pred in langs and 0 < rows[1].score <= 1
    assert language.predict(nothing, PIECES, langs, weights).collect() == []
    kept = language.drop_unidentified(odd, PIECES, langs, weights)
    assert kept.schema == odd.schema
    assert not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()}
    assert language.drop_unidentified(nothing, PIECES, langs, weights).collect() == []


def test_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "hello", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(rows, PIECES).collect()} == {("und", 0.0)}


def test_prediction_is_from_text_alone(spark, model):
    langs, weights = model
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.id: (r.lang_pred, r.score) for r in language.predict(docs, PIECES, langs, weights).collect()}
    other = docs.selectExpr("doc_id + 1000 as doc_id", "text")
    b = {r.id - 1000: (r.lang_pred, r.score) for r in language.predict(other, PIECES, langs, weights).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert all(math.isclose(a[k][1], b[k][1]) for k in a)


def test_long_runs_are_fitted():
    """By logarithms as by sums; the lengths of the expected pieces add up in a long run too."""
    pieces = language.vocabulary(PIECES)
    weights = np.random.default_rng(3).random(pieces.size) / 1000
    long = np.zeros(pieces.size)
    pieces._expected_long("▁internationalization", 2.0, np.log(weights), long)
    assert long == pytest.approx(pieces.expected(["▁internationalization"], np.array([2.0]), weights))
    sizes = np.array([len(t) for t in sorted(pieces.number, key=pieces.number.get)] + [1])
    for word in ("▁" + "sentence" * 40, "▁" + "日本語の文章" * 20):
        assert (pieces.expected([word], np.array([1.0]), weights) * sizes).sum() == pytest.approx(len(word))


def test_script_without_blanks(spark):
    """Sentences are runs of more than thirty letters; a few letters are in both languages."""
    rng = random.Random(3)
    a, b = "東京都中央区日本橋地下鉄", "北京市海淀区中关村大街上"
    rows = [(2 * i + k, "".join(rng.choices(part, k=60)), lang) for i in range(40) for k, (part, lang) in enumerate([(a, "ja"), (b, "zh")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs, PIECES).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows if found[i].held_out)


def test_number_signs_are_no_letters(spark, model):
    langs, weights = model
    assert language.runs("½ x²y ①Ⅷ ab_c1d") == ["▁x", "▁y", "▁ab", "▁c", "▁d"]
    docs = spark.createDataFrame([(1, "½ ² ① Ⅷ"), (2, "½ the")], "doc_id long, text string")
    rows = {r.id: (r.lang_pred, r.score > 0) for r in language.predict(docs, PIECES, langs, weights).collect()}
    assert rows[1] == ("und", False) and rows[2][0] in langs


def test_predictions_by_dictionaries(spark, model):
    """Every document of the small table, with sums over dictionaries."""
    langs, weights = model
    number = language.vocabulary(PIECES).number
    known = {}

    def logs(run):
        if run not in known:
            sums = [np.ones(len(langs))]
            for end in range(1, len(run) + 1):
                ways = [(s, number.get(run[s:end], len(number) if end - s == 1 else None)) for s in range(end)]
                sums.append(sum(sums[s] * weights[n] for s, n in ways if n is not None))
            known[run] = np.log(sums[-1])
        return known[run]

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in language.predict(docs, PIECES, langs, weights).collect():
        words = "".join(c if c.isalpha() else " " for c in texts[r.id].lower()).split()
        total = sum((logs("▁" + w) for w in words), np.zeros(len(langs)))
        share = np.exp(total - total.max())
        assert (r.lang_pred, r.score) == (
            (langs[total.argmax()], pytest.approx(1 / share.sum())) if words else ("und", 0.0)
        )
