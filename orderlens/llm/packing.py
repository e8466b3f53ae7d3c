"""Packing by binary lengths: a document's tokens are cut into pieces of powers of two.

Whole pieces of the greatest length come first, then the remainder by its binary digits. A
piece is a sequence: its length is a power of two, so it needs no padding, and no sequence
holds tokens of two documents. Pieces of one length form a bucket, from which batches of
equal length can be drawn.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField

from orderlens.llm.common import documents, prepare, with_id

LONGEST = 1024
END_ID = 0
# Encoded words that a Python worker keeps.
CACHED = 800_000
# Letters below this one have had their classes since the first versions of Unicode.
LATIN_END = "\u0250"

# A blank before something that no reading of white space includes: byte-level splitting
# starts a new word there whatever stands before, so both sides can be encoded alone.
_CUT = re.compile(r" (?=\S)")
_ENCODERS: dict[tuple[str, str | None], "WordEncoder"] = {}


class WordEncoder:
    """Ids as the tokenizers library gives them, word by word and remembered.

    With `ranks`, a tiktoken file of the same vocabulary, texts are taken word by word, and
    words of well-known letters go to that library, which splits them by the same pattern and
    starts faster. Without it, and for texts with special tokens, whole texts are encoded.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(t): int(n) for t, n in map(bytes.split, file)}
            self.quick = tiktoken.Encoding(
                "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            ).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, text: str) -> bytes:
        return array("I", self.quick(text)).tobytes() if max(text) < LATIN_END else self._slow(text)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.quick or any(s in text for s in self.special):
            return self._slow(text)
        first, *words = text.split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            new = {w for w, ids in zip(words, found) if ids is None}
            if "" in new or any(w[0].isspace() for w in new):
                first, *words = _CUT.split(text)
                new = {w for w in words if w not in self.known}
            if len(self.known) + len(new) > CACHED:
                self.known.clear()
                new = set(words)
            self.known.update((w, self._word(" " + w)) for w in new)
            found = list(map(self.known.__getitem__, words))
        return b"".join([self._word(first) if first else b"", *found])


def encoder(path: str, ranks: str | None = None) -> WordEncoder:
    """One for each worker and file."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = WordEncoder(path, ranks)
    return _ENCODERS[path, ranks]


def binary_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, largest first, that add up to `tokens`; `longest` is one itself."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [
        1 << bit for bit in range(longest.bit_length() - 2, -1, -1) if rest >> bit & 1
    ]


def _pieces(path: str, ranks: str | None, longest: int, end_id: int, schema: pa.Schema):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks).encode
        for batch in batches:
            row, start, length, ids, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text) + end
                at, n = 0, len(data) // 4
                for size in binary_lengths(n, longest):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    ids.append(data[at * 4 : (at + size) * 4])
                    total.append(n)
                    at += size
            owner = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    owner.cast(schema.field(0).type),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(total, pa.int64()),
                ],
                schema=schema,
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    longest: int = LONGEST,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    `ids` are little-endian unsigned 32-bit numbers and `bucket` is the length's logarithm;
    write with partitionBy("bucket") to get files of equal lengths. Null and empty texts are
    the end token alone. Repeated rows are packed each. No shuffle: a row's pieces depend on
    that row only, and a worker holds a batch of rows and a bounded cache.
    """
    if longest & (longest - 1):
        raise ValueError("the greatest length must be a power of two")
    prepare(docs.sparkSession)
    texts = documents(docs, id_col, text_col)
    schema = with_id(
        texts,
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids", BinaryType()),
        StructField("doc_tokens", LongType()),
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    pieces = texts.mapInArrow(_pieces(tokenizer, ranks, longest, end_id, to_arrow_schema(schema)), schema)
    return pieces.withColumns(
        {
            "bucket": F.log2("length").cast(IntegerType()),
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )
