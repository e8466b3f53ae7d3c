import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orderlens.llm import packing
from orderlens.llm.queries import BYTE_BPE, BYTE_RANKS, QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_packing"](spark, sf_dir).collect()
    reach = dict.fromkeys(texts, 0)
    ids = {k: np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for k, t in texts.items()}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == reach[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        reach[r.doc_id] += r.length
    assert reach == {k: len(v) for k, v in ids.items()}
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_odd_rows(odd, library):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for ranks in (None, BYTE_RANKS):
        rows = packing.pack(odd.filter("doc_id is null or doc_id != 6"), BYTE_BPE, ranks).collect()
        for key, text in texts.items():
            if key != 6:
                own = sorted((r.start, r.ids) for r in rows if r.doc_id == key)
                got = np.frombuffer(b"".join(i for _, i in own), "<u4").tolist()
                assert got == library.encode(text, add_special_tokens=False).ids + [0]


def test_repeated_rows_and_empty_table(odd, nothing):
    rows = packing.pack(odd.filter("doc_id = 6"), BYTE_BPE, BYTE_RANKS).collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens
    assert packing.pack(nothing, BYTE_BPE).collect() == []


def test_words_alone_give_the_ids_of_the_text(library):
    tool = packing.WordEncoder(BYTE_BPE, BYTE_RANKS)
    for text in ("  two  blanks", "a \n b\n\nc ", "x  ", "  y", "\tz \t q", " \xa0 a", "it's  don't", "ab\x1c cd \x85 ef", "日 本 語", " "):
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2049, 5000])
def test_binary_lengths(n):
    sizes = packing.binary_lengths(n)
    assert sum(sizes) == n and sizes == sorted(sizes, reverse=True)
    assert all(s & (s - 1) == 0 and s <= 1024 for s in sizes)
    assert len(sizes) == n // 1024 + (n % 1024).bit_count()
