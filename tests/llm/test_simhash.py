import itertools

import numpy as np
import xxhash

from orderlens.llm import simhash
from orderlens.llm.queries import QUERIES


def plain_fingerprint(text, words=3):
    found = text.encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    """Smallest id reachable, from all pairs."""
    ids = sorted(marks, key=lambda i: (i is None, i))
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (marks[a] ^ marks[b]).bit_count() <= radius:
            x, y = sorted((top(a), top(b)), key=lambda i: (i is None, i))
            root[y] = x
    return {i: top(i) for i in ids}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {k: plain_fingerprint(t) for k, t in texts.items()}
    wanted = plain_components(marks, 3)
    rows = QUERIES["op8_simhash_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{m:016x}" for k, m in marks.items()}
    assert {r.doc_id: r.component_id for r in rows} == wanted
    assert len(set(wanted.values())) < len(wanted)


def test_masks_cover_every_pair_within_the_radius():
    draw = np.random.default_rng(2)
    for radius in (1, 3, 5):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            flipped = sum(1 << int(b) for b in draw.choice(64, draw.integers(0, radius + 1), replace=False))
            assert any(not mask & flipped for mask in masks)


def marks_of(spark, values):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    return spark.createDataFrame(signed, "mark long")


def joined(spark, values):
    found = simhash.components(simhash.links(marks_of(spark, values)))
    return {r.node % (1 << 64): r.root % (1 << 64) for r in found.collect()}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Many fingerprints around one centre and chains of them, with buckets kept tiny."""
    draw, centre = np.random.default_rng(4), 0x0123456789ABCDEF
    values = {centre}
    for _ in range(300):
        values.add(centre ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 4), replace=False)))
    link = centre
    for b in range(0, 60, 3):
        link ^= 7 << b
        values.add(link)
    values |= {int(x) for x in draw.integers(0, 1 << 63, 300)}
    values = sorted(values)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    wanted = plain_components({signed[v]: v for v in values}, 3)
    wanted = {k % (1 << 64): v % (1 << 64) for k, v in wanted.items()}
    for most in (simhash.BUCKET, 8):
        monkeypatch.setattr(simhash, "BUCKET", most)
        found = joined(spark, values)
        assert {v: found.get(v, v) for v in values} == wanted


def test_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    assert all(r.mark % (1 << 64) == plain_fingerprint(texts[r.doc_id]) for r in rows)
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == of[2] == of[None] == 1 and of[3] == of[4] == of[5] == 3
    assert simhash.near_duplicates(nothing).collect() == []


def test_one_document_of_each_group_stays(odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 3} <= set(ids) and not {2, 4, 5} & set(ids)


def test_hot_fingerprints(spark):
    """A third of all rows in one group."""
    docs = spark.range(3000).selectExpr(
        "id as doc_id",
        "case when id % 3 = 0 then 'the same words here again' else concat_ws(' ', sha(cast(id as string)), md5(cast(id as string)), id) end as text",
    )
    rows = simhash.near_duplicates(docs)
    assert rows.filter("doc_id % 3 = 0").select("component_id").distinct().collect()[0][0] == 0
    assert rows.count() == 3000
