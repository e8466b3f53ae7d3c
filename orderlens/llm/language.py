"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum over all of its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. Expectation maximisation over a bounded sample of
labelled documents fits the probabilities.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from orderlens.llm.common import prepare, saved, with_id

UNKNOWN = "und"
# The bound of the sample: labelled documents of each language, on average, and passes.
SAMPLE_DOCS = 1500
PASSES = 3
# Probability of a character that no piece covers, and weight of the mean of all languages.
FLOOR = 1e-9
SMOOTHING = 0.02
# Longer runs of letters are summed with scaling or by logarithms, one by one.
_LONG = 30
_CACHED = 500_000
_CHARS = 4_000_000

# Letters and number signs; the latter are taken out after.
_RUN = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_VOCABULARIES: dict[str, "Pieces"] = {}
_SCORERS: dict[tuple, "Scorer"] = {}


class Pieces:
    """The vocabulary's pieces by number; the number after the last is any other character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = sorted(
            {
                model.id_to_piece(i).lower()
                for i in range(model.get_piece_size())
                if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
            }
        )
        self.number = {text: i for i, text in enumerate(texts)}
        self.size = len(texts) + 1
        self.longest = max(map(len, texts))
        # A tree over the pieces' characters: the sorted edges (node, character), the node each
        # leads to, and the piece that ends at a node.
        nodes, edges = {"": 0}, {}
        for text in texts:
            for end in range(1, len(text) + 1):
                if text[:end] not in nodes:
                    nodes[text[:end]] = len(nodes)
                    edges[nodes[text[: end - 1]] << 21 | ord(text[end - 1])] = nodes[text[:end]]
        self.edges = np.array(sorted(edges), np.int64)
        self.leads = np.array([edges[e] for e in sorted(edges)], np.int64)
        self.ends = np.full(len(nodes), -1, np.int64)
        for text, number in self.number.items():
            self.ends[nodes[text]] = number

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, numbers) over words of one length, by start.

        From each start all words walk down the tree together, as long as a piece may follow.
        """
        size, other = len(words[0]), self.size - 1
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = letters.reshape(len(words), size).T.astype(np.int64)
        for start in range(size):
            rows, nodes = np.arange(len(words)), np.zeros(len(words), np.int64)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                wanted = nodes << 21 | letters[end - 1, rows]
                at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
                there = self.edges[at] == wanted
                found = np.where(there, self.ends[self.leads[at]], -1)
                if end == start + 1:
                    yield start, end, rows, np.where(found < 0, other, found)
                elif (found >= 0).any():
                    yield start, end, rows[found >= 0], found[found >= 0]
                rows, nodes = rows[there], self.leads[at][there]
                if not len(rows):
                    break

    def into(self, word: str, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts and numbers of the pieces of a word that end here."""
        get, other = self.number.get, self.size - 1
        found = [(s, get(word[s:end], other if end - s == 1 else -1)) for s in range(max(0, end - self.longest), end)]
        starts, numbers = zip(*[(s, n) for s, n in found if n >= 0])
        return np.array(starts), np.array(numbers)

    def forward(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities, a column for each language."""
        out = np.zeros((len(words), weights.shape[1]))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            group = [words[i] for i in at]
            if length > _LONG:
                out[at] = [self._scaled(w, weights) for w in group]
                continue
            alpha = np.zeros((length + 1, len(group), weights.shape[1]))
            alpha[0] = 1
            for start, end, rows, found in self.arcs(group):
                alpha[end, rows] += alpha[start, rows] * weights[found]
            out[at] = np.log(alpha[length])
        return out

    def _scaled(self, word: str, weights: np.ndarray) -> np.ndarray:
        get, other = self.number.get, self.size - 1
        alpha, log = [np.ones(weights.shape[1])], np.zeros(weights.shape[1])
        for end in range(1, len(word) + 1):
            now = np.zeros(weights.shape[1])
            for back in range(1, len(alpha) + 1):
                found = get(word[end - back : end], other if back == 1 else -1)
                if found >= 0:
                    now += alpha[-back] * weights[found]
            alpha = [*alpha[-self.longest + 1 :], now]
            scale = np.max(alpha, axis=0)
            alpha = [a / scale for a in alpha]
            log += np.log(scale)
        return log + np.log(alpha[-1])

    def expected(self, words: list[str], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, over all segmentations of the words."""
        uses = np.zeros(self.size)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > _LONG):
            self._expected_long(words[i], counts[i], np.log(weights), uses)
        for length in np.unique(lengths[lengths <= _LONG]):
            at = np.flatnonzero(lengths == length)
            group = [words[i] for i in at]
            arcs = list(self.arcs(group))
            alpha, beta = np.zeros((2, length + 1, len(group)))
            alpha[0] = beta[length] = 1
            for start, end, rows, found in arcs:
                alpha[end, rows] += alpha[start, rows] * weights[found]
            # Backwards all arcs out of a position come before those into it.
            for start, end, rows, found in reversed(arcs):
                beta[start, rows] += beta[end, rows] * weights[found]
            share = counts[at] / alpha[length]
            for start, end, rows, found in arcs:
                np.add.at(uses, found, alpha[start, rows] * weights[found] * beta[end, rows] * share[rows])
        return uses

    def _expected_long(self, word: str, count: float, logs: np.ndarray, uses: np.ndarray) -> None:
        """Adds one word's expected uses, by logarithms; memory is two numbers a letter."""
        alpha, beta = np.full((2, len(word) + 1), -np.inf)
        alpha[0] = beta[-1] = 0
        for end in range(1, len(word) + 1):
            starts, found = self.into(word, end)
            alpha[end] = np.logaddexp.reduce(alpha[starts] + logs[found])
        for end in range(len(word), 0, -1):
            starts, found = self.into(word, end)
            after = logs[found] + beta[end]
            beta[starts] = np.logaddexp(beta[starts], after)
            np.add.at(uses, found, count * np.exp(alpha[starts] + after - alpha[-1]))


def vocabulary(path: str) -> Pieces:
    """One for each worker and file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Pieces(path)
    return _VOCABULARIES[path]


def runs(text: str) -> list[str]:
    """A text's runs of letters, in lower case, each as the start of a word."""
    out = []
    for run in _RUN.findall(text.lower()):
        if run.isalpha():
            out.append(_MARK + run)
        else:
            out += [_MARK + r for r in "".join(c if c.isalpha() else " " for c in run).split()]
    return out


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the id's CRC-32 leaves this remainder; a null id is as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for run, n in Counter(runs(text or "")).items():
                counts[lang, run] += n
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([k[0] for k in counts], pa.string()),
                "word": pa.array([k[1] for k in counts], pa.string()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )


def _uses(path: str, langs: list[str], weights: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = vocabulary(path)
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                uses = pieces.expected(
                    part["word"].tolist(), part["n"].to_numpy(float), weights[:, langs.index(lang)]
                )
                at = np.flatnonzero(uses)
                yield pd.DataFrame({"lang": lang, "piece": at, "uses": uses[at]})

    return run


def fit(labelled: DataFrame, model: str, sample_docs: int = SAMPLE_DOCS, passes: int = PASSES) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from (doc_id, lang, text).

    Rows without a language are left out. Of a language with more than `sample_docs`
    documents a part of them is taken by a hash of the id, so many on average. What reaches
    the driver is a number for each piece and language.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.filter("lang is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(totals)
    pieces = vocabulary(model)
    weights = np.full((pieces.size, max(len(langs), 1)), 1 / pieces.size)
    if not langs:
        return langs, weights
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    taken = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    words = saved(
        taken.select("lang", "text")
        .mapInArrow(_words, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n")),
        "words",
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    spread = words.repartition(max(spark.sparkContext.defaultParallelism, 2))
    for _ in range(passes):
        uses = spread.mapInPandas(_uses(model, langs, weights), "lang string, piece long, uses double")
        found = np.zeros_like(weights)
        for r in uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect():
            found[r["piece"], langs.index(r["lang"])] = r["uses"]
        found /= np.maximum(found.sum(axis=0), 1e-300)
        weights = (1 - SMOOTHING) * found + SMOOTHING * (found.mean(axis=1, keepdims=True) + 1 / pieces.size) / 2
        weights[-1] = FLOOR
    prepare(spark)
    return langs, np.maximum(weights, FLOOR)


class Scorer:
    """Languages of texts, with the scores of the runs that a worker has met so far."""

    def __init__(self, path: str, langs: list[str], weights: np.ndarray):
        self.pieces, self.langs, self.weights = vocabulary(path), langs, weights
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        parts = [runs(t) for t in texts]
        new = {r for part in parts for r in part if r not in self.known}
        if len(self.known) + len(new) > _CACHED:
            self._clear()
            new = {r for part in parts for r in part}
        if new:
            order = list(new)
            self.known.update(zip(order, range(len(self.scores), len(self.scores) + len(order))))
            self.scores = np.concatenate([self.scores, self.pieces.forward(order, self.weights)])
        best, sure = [], []
        for part in parts:
            if not part:
                best.append(UNKNOWN)
                sure.append(0.0)
                continue
            at = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            total = self.scores[at].sum(axis=0)
            top = int(np.argmax(total))
            best.append(self.langs[top])
            sure.append(1 / float(np.exp(total - total[top]).sum()))
        return best, sure


def scorer(path: str, langs: list[str], weights: np.ndarray) -> Scorer:
    """The worker's one for this model, which the worker's next task finds as it was left."""
    key = path, tuple(langs), hashlib.sha256(weights.tobytes()).digest()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(path, langs, weights)
    return _SCORERS[key]


def _gathered(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.Table, list[str]]]:
    """Batches together up to some millions of characters, so that new words come in numbers."""
    held, texts, size = [], [], 0
    for batch in batches:
        held.append(batch)
        new = [t or "" for t in batch.column(text_at).to_pylist()]
        texts += new
        size += sum(map(len, new))
        if size > _CHARS:
            yield pa.Table.from_batches(held), texts
            held, texts, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held), texts


def _predictions(path: str, langs: list[str], shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(path, langs, shared.value)
        for table, texts in _gathered(batches, 1):
            best, sure = score(texts)
            columns = [table.column(0).cast(schema.field(0).type), pa.array(best), pa.array(sure, pa.float64())]
            yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    return run


def _kept(path: str, langs: list[str], shared, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(path, langs, shared.value)
        for table, texts in _gathered(batches, text_at):
            best, sure = score(texts)
            stays = [lang != UNKNOWN and s >= least for lang, s in zip(best, sure)]
            yield from table.filter(pa.array(stays, pa.bool_())).to_batches()

    return run


def predict(docs: DataFrame, model: str, langs: list[str], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every document, from its text alone.

    `score` is the language's share of the likelihood under all languages. A text that is
    null or has no letter, and every text where no language was learned, is `und` with 0.
    The weights are broadcast: pieces by languages, whatever the number of documents.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = with_id(texts, StructField("lang_pred", StringType()), StructField("score", DoubleType()), name="id")
    if not langs:
        return texts.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return texts.mapInArrow(_predictions(model, langs, shared, to_arrow_schema(schema)), schema)


def identify(docs: DataFrame, model: str, parts: int = 3, part: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of (doc_id, text, lang), learned from rows not held out."""
    rows = docs.select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), parts, part)
    langs, weights = fit(rows.filter(~out), model, **options)
    return predict(rows, model, langs, weights).select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), parts, part).alias("held_out"), "lang_pred", "score"
    )


def drop_unidentified(
    docs: DataFrame, model: str, langs: list[str], weights: np.ndarray, least: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The documents, all columns, whose text has a language with at least this score.

    Texts that are null, empty or without letters go. No shuffle.
    """
    prepare(docs.sparkSession)
    if not langs:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_kept(model, langs, shared, docs.columns.index(text_col), least), docs.schema)
