import math
import zlib
from collections import Counter, defaultdict

import pytest

from orderlens.llm import ppm
from orderlens.llm.queries import QUERIES

END = 256


def tokens(text):
    return (text or "").encode().lower().split()


def plain_base(texts, learned):
    counts = Counter(w for k in learned for w in [*tokens(texts[k]), None])
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for key, text in texts.items():
        words = [*tokens(text), None]
        score = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        out[key] = (len(words), sum(counts[w] > 0 for w in words), total, score)
    return out


class PlainModel:
    """The same model with dictionaries, symbol by symbol."""

    def __init__(self, texts):
        top = Counter()
        for text in texts:
            for context, symbol in self.steps(text):
                top[context, symbol] += 1
        self.levels = [None] * (ppm.ORDER + 1)
        counts = top
        for order in range(ppm.ORDER, -1, -1):
            level = defaultdict(dict)
            for (context, symbol), n in counts.items():
                level[context][symbol] = 2 * n - 1
            self.levels[order] = level
            counts = Counter((context[1:], symbol) for context, symbol in counts)

    @staticmethod
    def steps(text):
        symbols = [END] * ppm.ORDER + list(b" ".join(tokens(text))) + [END]
        for i in range(ppm.ORDER, len(symbols)):
            yield tuple(symbols[i - ppm.ORDER : i]), symbols[i]

    def log10(self, context, symbol):
        excluded, out = set(), 0.0
        for order in range(ppm.ORDER, -1, -1):
            here = self.levels[order].get(context[len(context) - order :] if order else ())
            if here is None:
                continue
            left = {s: n for s, n in here.items() if s not in excluded}
            if left:
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    return out + math.log10(left[symbol] / whole)
                out += math.log10(len(left) / whole)
                excluded |= set(left)
        return out - math.log10(max(ppm.SYMBOLS - len(excluded), 1))

    def score(self, text):
        return sum(self.log10(c, s) for c, s in self.steps(text))


def check(rows, texts, parts=7, part=2):
    out = {k: zlib.crc32(("" if k is None else str(k)).encode()) % parts == part for k in texts}
    learned = [k for k in texts if not out[k]]
    base, model = plain_base(texts, learned), PlainModel([texts[k] for k in learned])
    for r in rows:
        n, known, total, score = base[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    for r in rows[:60]:
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-5)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_lm_scoring"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    assert held and any(r.n_known < r.n_tokens for r in held)


def test_small_blocks_give_the_same(spark, sf_dir, monkeypatch):
    usual = sorted(map(tuple, QUERIES["op10_lm_scoring"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = sorted(map(tuple, QUERIES["op10_lm_scoring"](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for a, b in zip(usual, again, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_odd_rows(spark, odd, nothing):
    texts = {r.doc_id: r.text for r in odd.filter("doc_id is null or doc_id != 6").collect()}
    rows = ppm.score_texts(odd.filter("doc_id is null or doc_id != 6")).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    assert next(r for r in rows if r.doc_id == 3).n_tokens == 1
    assert ppm.score_texts(odd).count() == odd.count()
    assert ppm.score_texts(nothing).collect() == []


def test_nothing_to_learn_from(spark):
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = ppm.score_texts(spark.createDataFrame([(key, "ab")], "doc_id long, text string")).collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0
    assert rows[0].score == pytest.approx(-3 * math.log10(257), rel=1e-6)


def test_long_words_are_told_apart():
    words = [b"a" * 63, b"a" * 64, b"a" * 65, b"a" * 200, b"a" * 199 + b"b", b"b"]
    hashes = ppm.word_hashes(b" ".join(words))
    assert len(set(hashes.tolist())) == len(words)
    assert (ppm.word_hashes(words[3]) == hashes[3]).all() and (ppm.word_hashes(words[0]) == hashes[0]).all()
