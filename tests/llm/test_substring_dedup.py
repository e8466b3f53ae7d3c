import random

import numpy as np

from orderlens.llm import substring_dedup
from orderlens.llm.queries import QUERIES


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9))) for _ in range(n))


def test_rolling_hash_is_that_of_the_last_bytes():
    data = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    hashes, h = substring_dedup.rolling(data), 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(substring_dedup._GEAR[b])) % (1 << 32)
        assert hashes[i] == h


def test_boundaries_are_the_largest_near():
    draw = random.Random(2)
    data = np.frombuffer(words(draw, 400).encode(), np.uint8)
    hashes, reach = substring_dedup.rolling(data).astype(np.int64), substring_dedup.REACH
    plain = [
        i + 1
        for i in range(len(data) - 1)
        if all(hashes[i] > x for x in [0, *hashes[max(0, i - reach) : i]]) and all(hashes[i] >= x for x in hashes[i + 1 : i + 1 + reach])
    ]
    assert substring_dedup.boundaries(data).tolist() == [*plain, len(data)]


def test_insertions_move_only_what_is_beside_them():
    draw = random.Random(3)
    text = words(draw, 600).encode()
    cut = lambda t: {bytes(x) for x in np.split(np.frombuffer(t, np.uint8), substring_dedup.boundaries(np.frombuffer(t, np.uint8)))}
    before, after = cut(text), cut(text[:1000] + b"inserted" + text[1000:])
    assert len(before - after) <= 4


def planted(spark):
    """Passages of 51 words and more in several documents, and documents without any."""
    draw = random.Random(7)
    passages = [words(draw, n) for n in (51, 51, 55, 60, 90, 200)]
    docs, holders = {}, {}
    for key in range(120):
        text = words(draw, draw.randrange(60, 200))
        if key % 3 == 0:
            i = (key // 3) % len(passages)
            at = draw.randrange(len(text))
            text = text[:at] + " " + passages[i] + " " + text[at:]
            holders[key] = passages[i]
        docs[key] = text
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), docs, holders


def test_planted_passages_are_found_and_clean_documents_left(spark):
    frame, docs, holders = planted(spark)
    rows = substring_dedup.repeated_passages(frame).collect()
    assert {r.doc_id for r in rows} == set(holders)
    for r in rows:
        assert docs[r.doc_id][r.start : r.end] in holders[r.doc_id]
        first = min(k for k, p in holders.items() if p == holders[r.doc_id])
        assert r.first_doc == first and r.removed == (r.doc_id != first)


def plain_passages(docs, least):
    """Runs of chunks that at least two documents have, with dictionaries."""
    cut, seen = {}, {}
    for key, text in docs.items():
        raw = text.encode()
        ends = substring_dedup.boundaries(np.frombuffer(raw, np.uint8)).tolist()
        cut[key] = [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends)]
        for *_, piece in cut[key]:
            seen.setdefault(piece, set()).add(key)
    out = set()
    for key, pieces in cut.items():
        raw = docs[key].encode()
        for removed in (False, True):
            run = []
            for a, b, piece in [*pieces, (0, 0, b"")]:
                if piece and len(seen[piece]) > 1 and (min(seen[piece]) != key) == removed:
                    run.append((a, b))
                elif run:
                    a, b = run[0][0], run[-1][1]
                    begun = sum(1 for i in range(a, b) if not raw[i : i + 1].isspace() and (i == 0 or raw[i - 1 : i].isspace()))
                    if begun >= least:
                        out.add((key, len(raw[:a].decode()), len(raw[:b].decode()), begun, removed))
                    run = []
    return out


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_substring_dedup"](spark, sf_dir).collect()
    assert {(r.doc_id, r.start, r.end, r.words, r.removed) for r in rows} == plain_passages(docs, substring_dedup.LEAST_WORDS)


def test_odd_rows(odd, nothing):
    rows = substring_dedup.repeated_passages(odd, 1).collect()
    assert {r.doc_id for r in rows} <= {1, 2, 5, 4, None} | {8, 9, 10, 11, 7, 6, 3}
    assert not {3, 4, 10} & {r.doc_id for r in rows}
    assert substring_dedup.repeated_passages(nothing).collect() == []
