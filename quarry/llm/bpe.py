"""Byte-pair encoding of whole texts by a dynamic program over prefixes, and decoding.

The tokenizer splits a text into words and merges symbol pairs inside each word by rank.
Here a word's tokens come from a program over its prefixes instead: an automaton over the
vocabulary gives, at each position, every token that ends there, longest first; of these
exactly one can be the last token of the prefix, the one that does not merge across its
border with the last token of the prefix before it. That test walks down the two tokens'
splits. The last token of each prefix is stored and the ids are read off backwards.

Each distinct word is encoded once per worker (the table of words has a fixed size and is
emptied when full). The vocabulary is broadcast (about 1.7 MB, the tokenizer file itself).

Defined results: a null text counts as empty; an empty text has no ids and decodes to an
empty text. The special tokens' own strings inside a text become their ids. Rows stand
alone, so repeated rows give repeated results, and extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_slices

#: distinct words kept per worker, about 300 bytes each
WORDS_KEPT = 500_000
PAIRS_KEPT = 1_000_000
#: bytes of text encoded at a time; new words of a slice are sorted and share their prefixes
SLICE = 4 << 20
#: letters come first, as most words are letters; no other part begins with a letter, digit or apostrophe
_WORD = regex.compile(r"[\p{L}]+|[\p{N}]|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+")
#: the same for lower-cased ASCII, where it is faster
_ASCII_WORD = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9]+", re.ASCII)
_FAR = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _near_word() -> re.Pattern:
    """:data:`_WORD` for texts of code points below 65536, with its classes as plain character
    sets, which ``re`` looks up faster."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, digit, space = ("".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in _ranges(regex.findall(c, every))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"[{letter}]+|[{digit}]|'(?:s|t|re|ve|m|ll|d)|[^{space}{letter}{digit}]+")


def _ranges(letters: list[str]) -> list[str]:
    """Characters in order, cut into runs without gaps."""
    starts = [i for i, c in enumerate(letters) if not i or ord(c) != ord(letters[i - 1]) + 1]
    return ["".join(letters[a:b]) for a, b in zip(starts, [*starts[1:], len(letters)], strict=True)]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Encodes one word at a time. Symbols: a byte, or 256 + byte for a word's last one.

    Tokens are numbered by merge order: symbols first, then the result of each merge."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab, merges, end = model["model"]["vocab"], model["model"]["merges"], model["model"]["end_of_word_suffix"]
        letters = byte_letters()
        names = [letters[b] for b in range(256)] + [letters[b] + end for b in range(256)]
        number = {name: i for i, name in enumerate(names)}
        text: list[tuple[int, ...]] = [(i,) for i in range(512)]
        self.split: list[tuple[int, int]] = [(i, i) for i in range(512)]
        self.merged: dict[int, int] = {}
        for pair in merges:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = number[left], number[right]
            new = number.setdefault(left + right, len(text))
            if new == len(text):
                text.append(text[a] + text[b])
                self.split.append((a, b))
                names.append(left + right)
            self.merged[a << 20 | b] = new
        self.names = names
        self.ids = [vocab[name] for name in names]
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.size = [len(t) for t in text]
        self._build(text)
        self._fits: dict[int, bool] = {}

    def _build(self, text: list[tuple[int, ...]]) -> None:
        """Trie, links to the longest proper suffix, and the longest token ending at each state."""
        self.step: dict[int, int] = {}
        token, depth_of = [-1], [[0]]
        for number, symbols in enumerate(text):
            state = 0
            for depth, s in enumerate(symbols, 1):
                at = state << 10 | s
                state = self.step.get(at, 0)
                if not state:
                    state = self.step[at] = len(token)
                    token.append(-1)
                    if depth == len(depth_of):
                        depth_of.append([])
                    depth_of[depth].append(at)
            token[state] = number
        self.link = [0] * len(token)
        self.longest = token[:]
        self.shorter = [-1] * len(text)
        for level in depth_of[1:]:
            for at in level:
                parent, s, state = at >> 10, at & 1023, self.step[at]
                if parent:
                    back = self.link[parent]
                    while back and (back << 10 | s) not in self.step:
                        back = self.link[back]
                    self.link[state] = self.step.get(back << 10 | s, 0)
                below = self.longest[self.link[state]]
                if token[state] >= 0:
                    self.shorter[token[state]] = below
                else:
                    self.longest[state] = below

    def _stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b next to each other stay two tokens.

        Undo merges, the latest first, on the two sides of the border: if a pair that meets
        at the border would have merged before the merge just undone, they don't stay."""
        bound = 1 << 30
        while True:
            joined = self.merged.get(a << 20 | b)
            if joined is not None and joined < bound:
                return False
            if a > b:
                bound, inner = a, self.split[a][1]
                if inner != a:
                    a = inner
                    continue
                bound = b + 1
                if self.split[b][0] == b:
                    return True
                b = self.split[b][0]
            else:
                bound, inner = b + 1, self.split[b][0]
                if inner != b:
                    b = inner
                    continue
                bound = a
                if self.split[a][1] == a:
                    return True
                a = self.split[a][1]

    def words(self, words: list[bytes]) -> Iterator[list[int]]:
        """Token numbers of each word. Words with a common beginning share its prefixes'
        answers, so sorted words are fastest."""
        step, link, longest, shorter, size, fits = self.step, self.link, self.longest, self.shorter, self.size, self._fits
        states, last, done = [0], [0], b""
        for data in words:
            n = len(data)
            shared, most = 0, min(n - 1, len(done))
            while shared < most and data[shared] == done[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            done = data[: n - 1]
            state = states[shared]
            for i in range(shared + 1, n + 1):
                s = data[i - 1] if i < n else data[i - 1] + 256
                at = state << 10 | s
                while state and at not in step:
                    state = link[state]
                    at = state << 10 | s
                state = step.get(at, 0)
                t = longest[state]
                before = i - size[t]
                while before:
                    pair = last[before] << 20 | t
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= PAIRS_KEPT:
                            fits.clear()
                        ok = fits[pair] = self._stays(last[before], t)
                    if ok:
                        break
                    t = shorter[t]
                    before = i - size[t]
                states.append(state)
                last.append(t)
            out, at = [], n
            while at:
                t = last[at]
                out.append(t)
                at -= size[t]
            out.reverse()
            yield out

    def encoded(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Little-endian ids and written form of each word; sorted words are fastest."""
        packed, names = self.packed, self.names
        return [(b"".join([packed[t] for t in tokens]), " ".join([names[t] for t in tokens])) for tokens in self.words([w.encode() for w in words])]


class Cutter:
    """Cuts a text into lower-cased words and special tokens."""

    def __init__(self, spec: str):
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in json.loads(spec)["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def words(self, text: str) -> list[str]:
        if self._special and "<|" in text:
            out: list[str] = []
            for piece in self._special.split(text):
                out += [piece] if piece in self.specials else self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        # lower-casing letter by letter: no special form for a sigma that ends a word
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return _WORD.findall(text) if _FAR.search(text) else _near_word().findall(text)


class WordTable:
    """Encoded forms of the words met so far: little-endian ids, and the decoded text."""

    def __init__(self, cutter: Cutter, encoded: Callable[[list[str]], list[tuple[bytes, str]]], kept: int = WORDS_KEPT):
        self.cutter, self.encoded, self.kept = cutter, encoded, kept
        self.ids: dict[str, bytes] = {}
        self.written: dict[str, str] = {}

    def _add(self, words: set[str], decoded: bool) -> None:
        for name in words & self.cutter.specials.keys():
            self.ids[name], self.written[name] = self.cutter.specials[name].to_bytes(4, "little"), name
            words.discard(name)
        order = sorted(words)
        found = self.encoded(order)
        self.ids.update(zip(order, [i for i, _ in found], strict=True))
        if decoded:
            self.written.update(zip(order, [w for _, w in found], strict=True))

    def encode(self, texts: list[str], decoded: bool = True) -> tuple[list[bytes], list[str]]:
        """Ids and decoded form of each text."""
        cut = [self.cutter.words(t) for t in texts]
        missing = set().union(*cut).difference(self.ids)
        if len(self.ids) + len(missing) > self.kept:
            self.ids.clear()
            self.written.clear()
            missing = set().union(*cut)
        self._add(missing, decoded)
        get, form = self.ids.__getitem__, self.written.__getitem__
        return [b"".join(map(get, words)) for words in cut], [" ".join(map(form, words)) for words in cut] if decoded else []


_TABLES: dict[int, WordTable] = {}


def word_table(spec: str) -> WordTable:
    """One table per worker process and vocabulary."""
    key = hash(spec)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = WordTable(Cutter(spec), PrefixEncoder(spec).encoded)
    return _TABLES[key]


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """One row per row: doc_id, ids (binary, little-endian unsigned 32-bit), decoded (text,
    null if ``decoded`` is false). The tokenizer file is read on the driver only."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(spec.value)
        for batch in batches:
            for start, stop in text_slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                ids, written = words.encode([t or "" for t in part.column(1).to_pylist()], decoded)
                texts = pa.array(written, pa.string()) if decoded else pa.nulls(len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), texts], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def decode_ids(spec: str, ids: bytes) -> str:
    """Text of little-endian ids: the tokens' written forms with spaces between."""
    model = json.loads(spec)
    names = {i: t for t, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
    return " ".join(names[i] for i in np.frombuffer(ids, "<u4").tolist())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
