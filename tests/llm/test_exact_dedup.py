import hashlib
import re

import compare
import numpy as np
import pytest

from orderlens.llm import exact_dedup
from orderlens.llm.oracles import ORACLES
from orderlens.llm.queries import QUERIES


def test_query(spark, sf_dir):
    found = QUERIES["op1_exact_dedup"](spark, sf_dir)
    assert compare.difference(found, compare.connect(sf_dir), ORACLES["op1_exact_dedup"]) is None


def test_odd_rows(odd):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (1, 2) or r.doc_id is None:
            assert (r.keep_id, r.group_size, r.kept) == (1, 3, r.doc_id == 1)
        if r.doc_id in (3, 4):
            assert (r.keep_id, r.group_size) == (3, 2)
    assert sorted(r.kept for r in rows if r.doc_id == 6) == [False, True]
    of_one = next(r for r in rows if r.doc_id == 1)
    assert of_one.text_sha256 == hashlib.sha256(b"alpha beta gamma").hexdigest()


def test_kept_documents(odd):
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows]
    assert len(set(texts)) == len(texts) == 9
    assert {1, 3, 6} <= {r.doc_id for r in rows} and not {2, 4, None} & {r.doc_id for r in rows}


def test_empty_table(nothing):
    assert exact_dedup.exact_duplicates(nothing).collect() == []
    assert exact_dedup.drop_exact_duplicates(nothing).collect() == []


def test_filter_never_misses_a_repeat(spark):
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000).tolist()
    hashes = spark.createDataFrame([(v,) for v in values + values[:400]], "hash long").repartition(5)
    test = exact_dedup.may_repeat(hashes)
    found = {r.hash for r in hashes.filter(test("hash")).collect()}
    assert set(values[:400]) <= found
    assert len(found) < 700


def test_a_full_filter_changes_nothing(spark, sf_dir, monkeypatch):
    query = QUERIES["op1_exact_dedup"]
    usual = sorted(map(tuple, query(spark, sf_dir).collect()))
    monkeypatch.setattr(exact_dedup, "MOST_BITS", exact_dedup.SLICE_BITS)
    monkeypatch.setattr(exact_dedup, "bit_count", lambda rows: exact_dedup.SLICE_BITS)
    assert sorted(map(tuple, query(spark, sf_dir).collect())) == usual


@pytest.mark.parametrize("rows", [0, 1, 65_536, 10**12])
def test_bit_count(rows):
    bits = exact_dedup.bit_count(rows)
    assert bits & (bits - 1) == 0 and exact_dedup.SLICE_BITS <= bits <= exact_dedup.MOST_BITS
