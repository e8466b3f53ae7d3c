import hashlib
import math
import random
import re

import xxhash

from orderlens.llm import line_dedup
from orderlens.llm.queries import QUERIES


def parts(tokens):
    """The stretches of tokens that two forms of a leaf must have one of in common."""
    n = len(tokens) - math.ceil(line_dedup.SIMILAR * len(tokens)) + 1
    rest = max(len(tokens) - line_dedup.LEADING, 0)
    cut = [line_dedup.LEADING + i * rest // n for i in range(n + 1)]
    return [(i, tuple(tokens[cut[i] : cut[i + 1]])) for i in range(n)]


def order(counts):
    """Frequent forms first, equally frequent ones by hash."""

    def key(form):
        hashed = xxhash.xxh64(form.encode(), seed=42).intdigest()
        return -counts[form], hashed - (1 << 64 if hashed >> 63 else 0)

    return key


def templates(counts):
    """The template of each form of one leaf."""
    key, out, left = order(counts), {}, set(counts)
    while left:
        met = {}
        for form in left:
            for part in parts(form.split(" ")):
                met.setdefault(part, []).append(form)
        first = {part: min(forms, key=key) for part, forms in met.items()}
        heads = {f for f in left if all(first[p] == f for p in parts(f.split(" ")))}
        for form in left:
            own = form.split(" ")
            near = [
                h
                for h in heads
                if sum(a == b for a, b in zip(own, h.split(" "))) >= line_dedup.SIMILAR * len(own)
            ]
            if near:
                out[form] = form if form in heads else min(near, key=key)
        left -= set(out)
    return out


def plain(docs, least=line_dedup.LEAST_DOCS):
    """The same rule with dictionaries: (n_lines, n_dropped, text) by document."""
    forms, counts = {}, {}
    for key, text in docs.items():
        for i, line in enumerate(text.split("\n")):
            words = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
            form = re.sub(r"[^ ]*[0-9][^ ]*", line_dedup.VARIABLE, words)
            if form:
                bare = set(form.split(" ")) == {line_dedup.VARIABLE}
                forms[key, i] = form = words if bare else form
                tokens = form.split(" ")
                leaf = (form,) if bare else (len(tokens), tuple(tokens[: line_dedup.LEADING]))
                inner = counts.setdefault(leaf, {})
                inner[form] = inner.get(form, 0) + 1
    template = {form: head for inner in counts.values() for form, head in templates(inner).items()}
    holders = {}
    for (key, _), form in forms.items():
        holders.setdefault(template[form], set()).add(key)
    out = {}
    for key, text in docs.items():
        lines = text.split("\n")
        kept = [
            line
            for i, line in enumerate(lines)
            if (key, i) not in forms
            or len(holders[template[forms[key, i]]]) < least
            or min(holders[template[forms[key, i]]]) == key
        ]
        out[key] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted = plain(docs)
    rows = QUERIES["op3_line_dedup"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.n_dropped for r in rows)
    for r in rows:
        n, dropped, text = wanted[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.text_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


def test_variable_fields(spark):
    lines = [
        "Page 1 of 20 printed on 2024-01-01 by the archive service",
        "Page 2 of 31 printed on 2023-05-06 by the archive service",
        "Page 77 of 99 printed  on 1999-12-31 by the archive service",
        "Signed in as alice from the office network at noon today",
        "Signed in as alice from the branch network at noon today",
        "Signed in as alice from the office network at dawn today",
    ]
    texts = {i: f"own text {'abc'[i % 3] * (i + 1)}\n{line}\n\nend {'xyz'[i % 3] * (i + 2)}" for i, line in enumerate(lines)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert rows == plain(texts)
    assert [rows[i][1] for i in range(6)] == [0, 1, 1, 0, 1, 1]


def test_odd_rows(odd, nothing):
    rows = line_dedup.drop_recurring_lines(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    same = {2, None}  # as the first document's line, in other white space
    assert all(r.text == ("" if r.doc_id in same else texts[r.doc_id]) for r in rows)
    assert all(r.n_dropped == (r.doc_id in same) or r.doc_id is None for r in rows)
    assert next(r.n_lines for r in rows if r.doc_id == 5) == 2
    assert line_dedup.drop_recurring_lines(nothing).collect() == []


def test_hot_lines(spark):
    """One line in a third of all documents, and many repeats in one document."""
    docs = spark.range(900).selectExpr(
        "id as doc_id",
        "concat('first ', translate(sha(cast(id as string)), '0123456789', 'ghijklmnop'), if(id % 3 = 0, '\nthe very same line', ''), if(id = 3, repeat('\nthe very same line', 500), '')) as text",
    )
    rows = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert rows[0] == (2, 0) and rows[3] == (502, 501) and rows[6] == (2, 1)
    assert sum(d for _, d in rows.values()) == 298 + 501


def test_two_families_in_a_leaf(spark):
    """A fixed line is the more frequent one; the family beside it has names without digits."""
    name = lambda i: "reader" + "".join("abcdefghij"[int(c)] for c in str(i))
    texts = {i: f"own {name(i)}\nPosted in the category sports by our own staff today" for i in range(100)}
    texts |= {i: f"own {name(i)}\nPosted in the category archive section of reader {name(i)} here" for i in range(100, 150)}
    texts |= {i: f"own {name(i)}\nPosted in the category places near {name(i)} and its harbour" for i in range(150, 170)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_recurring_lines(docs).collect()}
    for i, text in texts.items():
        assert rows[i] == ((0, text) if i in (0, 100, 150) else (1, f"own {name(i)}"))


def test_generated_families(spark):
    """Lines of several templates that share their leaves, by the rule in plain Python."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    families = []
    for _ in range(6):
        start = [word() for _ in range(line_dedup.LEADING)]
        families += [start + [word() for _ in range(size)] for size in (1, 6, 6, 6, 16, 16, 30)]
    texts = {}
    for i in range(150):
        lines = [" ".join(word() for _ in range(7))]
        for _ in range(8):
            line = list(rng.choice(families))
            for _ in range(rng.randrange(5)):
                at = rng.randrange(line_dedup.LEADING, len(line))
                line[at] = rng.choice([word(), str(rng.randrange(100)), "abba"])
            lines.append(" ".join(line))
        texts[i] = "\n".join(lines)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert rows == plain(texts)
    assert 300 < sum(n for _, n, _ in rows.values()) < 1200


def test_numbers_alone_count_by_their_text(spark):
    texts = {i: str(1900 + i) for i in range(5)} | {5: "12 340", 6: "12  340 ", 7: "12 341"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert rows == {i: int(i == 6) for i in texts}


def test_two_documents_are_enough(spark):
    docs = spark.createDataFrame([(1, "own\nshared by two"), (2, "other\nshared by two")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert rows == {1: "own\nshared by two", 2: "other"}
