"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

Merges run in order of rank. How far a change at the right end of a word can reach to the
left is bounded by a number that depends on the merge list alone, its sufficient lookahead.
A token that ends at least so far from the right edge of what has been read can no longer
change, so it is emitted; the window then moves on, and memory stays the same however long a
word is. Decoding reads ids one by one and gives text as soon as its bytes are complete.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField

from orderlens.llm.common import documents, prepare, with_id

# Words, and stretches between white space, that a worker keeps in each of two generations.
CACHED = 400_000
# Symbols beyond which a word is encoded window by window.
WINDOWED = 128
# Letters below this one have had their classes since the first versions of Unicode.
LATIN_END = "\u0250"
_CODECS: dict[str, "Codec"] = {}


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def lookahead(merges: list[tuple[str, str]], sizes: dict[str, int]) -> int:
    """Symbols at the right edge that may still change; all tokens before them are final.

    Take two words that share a prefix and apply the merges rank by rank. The last token that
    both agree on is lost only if a merge joins it, as left part a, to what follows it in one
    of them. What follows begins with the left part of the merge that lost the token before,
    or has grown from it. So losses form a chain of merges of rising rank in which each right
    part starts with the left part of the last loss; the longest chain, counted in symbols of
    the left parts, bounds them all.
    """
    made: dict[str, list[str]] = {}
    for a, b in merges:
        made.setdefault(a + b, []).append(a)
    spines: dict[str, frozenset[str]] = {}

    def spine(token: str) -> frozenset[str]:
        """The token and all that can be its first part."""
        if token not in spines:
            spines[token] = frozenset((token,)).union(*(spine(a) for a in made.get(token, ())))
        return spines[token]

    longest: dict[str, int] = {}
    for a, b in merges:
        chain = sizes[a] + max(longest.get(s, 0) for s in spine(b))
        if chain > longest.get(a, 0):
            longest[a] = chain
    return max(longest.values(), default=0)


class Merges:
    """A merge list by token numbers."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocabulary, self.suffix, self.pairs = vocabulary, suffix, merges
        self.ranks = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocabulary[a + b] for a, b in merges]
        self._lookahead: int | None = None
        self._sizes: dict[int, int] = {}

    def size(self, token: int) -> int:
        return self._sizes[token]

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            bare = lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t)
            self._sizes = {number: bare(token) for token, number in self.vocabulary.items()}
            sizes = {token: self._sizes[number] for token, number in self.vocabulary.items()}
            self._lookahead = lookahead(self.pairs, sizes)
        return self._lookahead

    def merged(self, tokens: list[int]) -> list[int]:
        """All merges applied in place, lowest rank first and from the left."""
        get, made = self.ranks.get, self.made
        none = len(made)
        ranks = [get(pair, none) for pair in zip(tokens, tokens[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            tokens[i] = made[best]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((tokens[i - 1], tokens[i]), none)
            if i < len(ranks):
                ranks[i] = get((tokens[i], tokens[i + 1]), none)
        return tokens

    def stream(self, symbols: Iterator[int]) -> Iterator[int]:
        """Tokens of one word, each given as soon as it is stable; holds a bounded window."""
        reach = self.lookahead
        window, width, ended = [], 2 * reach + WINDOWED, False
        while not ended or window:
            while len(window) < width and not ended:
                symbol = next(symbols, None)
                if symbol is None:
                    ended = True
                else:
                    window.append(symbol)
            tokens, used, final = self.merged(list(window)), 0, len(window) - reach
            for token in tokens:
                if not ended and used + self.size(token) > final:
                    break
                used += self.size(token)
                yield token
            window = [] if ended else window[used:]

    def word(self, symbols: str) -> list[int]:
        """The tokens of a word, given as byte symbols; a symbol without a number is left out."""
        if not symbols:
            return []
        get, last = self.vocabulary.get, symbols[-1] + self.suffix
        numbers = [get(s) for s in symbols[:-1]]
        numbers.append(get(last))
        numbers = [n for n in numbers if n is not None]
        return self.merged(numbers) if len(numbers) <= WINDOWED else list(self.stream(iter(numbers)))


class Remembered:
    """A bounded dictionary: when the younger half is full it becomes the older one."""

    def __init__(self, most: int = CACHED):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Decoder:
    """Ids to text, one at a time. `feed` gives what has become sure, `flush` the rest."""

    def __init__(self, codec: "Codec"):
        self.codec, self.first = codec, True
        self.pending = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, number: int) -> str:
        token = self.codec.tokens[number]
        if not self.codec.byte_level_text:
            # Without a decoder of its own a vocabulary's tokens are put down with blanks.
            token, self.first = (token if self.first else " " + token), False
            return token
        if number in self.codec.special_ids:
            return self.pending.decode(token.encode())
        return self.pending.decode(self.codec.token_bytes(token))

    def flush(self) -> str:
        return self.pending.decode(b"", final=True)


class Codec:
    """Encoding and decoding with a tokenizer file of the byte-pair kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], merges, self.suffix)
        self.symbols = byte_symbols()
        self.from_symbol = {s: b for b, s in enumerate(self.symbols)}
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special, self.special_ids = special, set(special.values())
        self.tokens = {n: t for t, n in (model["vocab"] | special).items()}
        self.byte_level_text = whole["decoder"] is not None
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.lowers = "Lowercase" in json.dumps(whole["normalizer"])
        # The file's own normaliser and pattern, for letters whose class no Unicode version
        # changes; all others go through the library.
        self.plain_words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.to_symbols = {b: s for b, s in enumerate(self.symbols)}
        self.known, self.stretches = Remembered(), Remembered()

    def _words(self, text: str) -> list[str]:
        """The words of a stretch without special tokens, in byte symbols."""
        if self.lowers and text.isprintable() and max(text) < LATIN_END:
            words = self.plain_words.findall(unicodedata.normalize("NFC", text).lower())
            if text.isascii():
                return words
            return [w.encode().decode("latin-1").translate(self.to_symbols) for w in words]
        normal = self.library.normalizer
        plain = normal.normalize_str(text) if normal else text
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _ids(self, text: str) -> list[int]:
        out = []
        for word in self._words(text):
            ids = self.known.get(word)
            if ids is None:
                ids = self.merges.word(word)
                if len(word) <= WINDOWED:
                    self.known.put(word, ids)
            out += ids
        return out

    def _stretch(self, data: bytes) -> bytes:
        text, ids = data.decode("utf-8", "replace"), []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part:
                ids += [self.special[part]] if part in self.special else self._ids(part)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids.

        The text is taken in stretches between white space, which belongs to no token of a
        vocabulary that drops it, and each stretch is encoded once for as long as it is known.
        """
        words = text.encode("utf-8", "replace").split()
        found = list(map(self.stretches.young.get, words))
        if None in found:
            for i, data in enumerate(found):
                if data is None:
                    word = words[i]
                    data = self.stretches.get(word)
                    if data is None:
                        data = self._stretch(word)
                        if len(word) <= WINDOWED:
                            self.stretches.put(word, data)
                    found[i] = data
        return b"".join(found)

    def token_bytes(self, token: str) -> bytes:
        return bytes(self.from_symbol[c] for c in token) if all(c in self.from_symbol for c in token) else token.encode()

    def decode(self, data: bytes) -> str:
        ids = np.frombuffer(data, "<u4").tolist()
        if not self.byte_level_text:
            return " ".join(map(self.tokens.__getitem__, ids))
        machine = Decoder(self)
        return "".join(map(machine.feed, ids)) + machine.flush()


def codec(path: str) -> Codec:
    """One for each worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoded(path: str, schema: pa.Schema, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            ids = [tool.encode(text) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(schema.field(0).type), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array(list(map(tool.decode, ids)), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (their text) of every document.

    Ids are those of the tokenizers library for the file, without special tokens added; those
    that stand in a text are read as such. The file must drop white space (its words are what
    stands between). Null and empty texts have no ids. No shuffle; a worker holds one batch
    and bounded caches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    texts = documents(docs, id_col, text_col)
    schema = with_id(texts, StructField("ids", BinaryType()), StructField("decoded", StringType()))
    return texts.mapInArrow(_encoded(tokenizer, to_arrow_schema(schema), True), schema)
