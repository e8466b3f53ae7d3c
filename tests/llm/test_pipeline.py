import re

import corpus_pipeline
import numpy as np
from test_secret_scan import base, weak
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from orderlens.llm import secret_scan
from orderlens.llm.queries import BYTE_BPE


def masked(text):
    out, at = "", 0
    spans = (set(base(text).split(",")) | weak(text)) - {""}
    for a, b in sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans):
        if b > at:
            out += text[at : max(a, at)] + ("" if a < at else secret_scan.MASK)
            at = b
    return out + text[at:]


def test_stages_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts = {k: t for k, t in sorted(texts.items()) if t and any(c.isalpha() for c in t)}
    first = {}
    for key, text in texts.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), key)
    texts = {k: texts[k] for k in first.values()}
    groups = plain_components({k: plain_fingerprint(t) for k, t in texts.items()}, 3)
    texts = {k: masked(t) for k, t in texts.items() if groups[k] == k}
    found = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.ids))
    library = Tokenizer.from_file(BYTE_BPE)
    got = {k: np.frombuffer(b"".join(i for _, i in sorted(p)), "<u4").tolist() for k, p in found.items()}
    assert got == {k: library.encode(t, add_special_tokens=False).ids + [0] for k, t in texts.items()}
