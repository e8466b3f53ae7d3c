import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from orderlens.llm import bpe
from orderlens.llm.queries import BYTE_BPE, QUERIES, WORD_BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe_round_trip"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(odd, library):
    rows = bpe.encode_and_decode(odd, WORD_BPE).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_empty_table(nothing):
    assert bpe.encode_and_decode(nothing, WORD_BPE).collect() == []


def test_unusual_characters(library):
    tool = bpe.codec(WORD_BPE)
    for text in ("ΟΔΟΣ ΑΣ. İstanbul", "é é ﬁ ½ ２", "a\x00b\x1cc\x85d\xa0e", "don't I'LL you'Re", " x　y", "<|startoftext|>"):
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_are_streamed_right(library):
    """Words far longer than the window, against whole encodings."""
    draw, tool = random.Random(3), bpe.codec(WORD_BPE)
    for n in (127, 128, 129, 1400, 1500, 6000):
        for letters in ("ab", "abcdeinthr", "theinga", "s"):
            word = "".join(draw.choice(letters) for _ in range(n))
            assert np.frombuffer(tool.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_lookahead_holds_for_small_merge_lists():
    """Tokens before the lookahead never depend on what follows, for every short word."""
    draw = random.Random(5)
    for _ in range(30):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 8:
            pair = (draw.choice(tokens), draw.choice(tokens))
            if pair not in merges and len("".join(pair)) < 7:
                merges.append(pair)
                if "".join(pair) not in tokens:
                    tokens.append("".join(pair))
        numbers = {t: i for i, t in enumerate(tokens)}
        table = bpe.Merges(numbers, merges, "")
        for _ in range(60):
            word = [draw.randrange(3) for _ in range(80 + 2 * table.lookahead)]
            whole = table.merged(list(word))
            assert list(table.stream(iter(word))) == whole or not proper(merges)


def proper(merges):
    """Whether every part of a merge is a letter or made by an earlier merge only."""
    made = {"a", "b", "c"}
    for a, b in merges:
        if a not in made or b not in made:
            return False
        if a + b in made:
            return False
        made.add(a + b)
    return True


def test_decoding_state_machine():
    """Text comes once its bytes are whole, and equals the library's decoding."""
    tool, library = bpe.codec(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    ids = library.encode("naïve 日本 😀 <|endoftext|> end").ids
    machine = bpe.Decoder(tool)
    parts = [machine.feed(i) for i in ids]
    assert "" in parts
    assert "".join(parts) + machine.flush() == library.decode(ids, skip_special_tokens=False)
    cut = ids[:3]
    assert tool.decode(np.array(cut, "<u4").tobytes()) == library.decode(cut, skip_special_tokens=False)
