"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The unique encoding of a piece of text ends, at every prefix, in one token.  A
suffix automaton over the vocabulary finds the tokens that end at each byte,
longest first.  The first one that is compatible with the last token of the
prefix before it is the last token of the longer prefix; back-pointers then give
the ids.  Two tokens are compatible if merging their joined bytes gives just
these two again, which a walk down their merges decides.

Pieces are what the tokenizer's own pattern cuts a text into; their ids are kept
in a bounded table per task, as the same pieces come again and again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrec.llm.common import arrow_map, named, texts

# Fixed value: how byte-level tokenizers of this family cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces remembered per worker, in two generations: when the newer one is full it becomes
# the older one, and what is not asked for again in the meantime goes with the next turn.
REMEMBERED = 400_000
PAIRS = 200_000  # pairs of tokens whose compatibility is remembered
NEVER = 1 << 60


def printable_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class SuffixAutomaton:
    """All substrings of a set of words; states that are whole words carry their id."""

    def __init__(self, words: dict[bytes, int]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = {}
        for word, number in words.items():
            at = 0
            for byte in word:
                at = self._extend(at, byte)
            ends[number] = word
        self.word = [-1] * len(self.step)
        for number, word in ends.items():
            at = 0
            for byte in word:
                at = self.step[at][byte]
            self.word[at] = number
        # The nearest shorter suffix that is a whole word.
        self.shorter = [-1] * len(self.step)
        for at in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            up = self.link[at]
            self.shorter[at] = up if self.word[up] >= 0 else self.shorter[up]

    def _extend(self, last: int, byte: int) -> int:
        step, link, length = self.step, self.link, self.length
        there = step[last].get(byte)
        if there is not None and length[there] == length[last] + 1:
            return there
        if there is not None:
            return self._split(last, byte, there)
        new = self._state({}, length[last] + 1)
        at = last
        while at != -1 and byte not in step[at]:
            step[at][byte] = new
            at = link[at]
        if at == -1:
            link[new] = 0
        else:
            there = step[at][byte]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, byte, there)
        return new

    def _state(self, step: dict[int, int], length: int) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, byte: int, there: int) -> int:
        new = self._state(dict(self.step[there]), self.length[at] + 1)
        self.link[new] = self.link[there]
        self.link[there] = new
        while at != -1 and self.step[at].get(byte) == there:
            self.step[at][byte] = new
            at = self.link[at]
        return new


class Encoder(dict):
    """Ids of pieces, as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        if before["add_prefix_space"] or not before["use_regex"] or model.get("ignore_merges"):
            raise ValueError(f"{path} cuts text in a way that is not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has special tokens with conditions")
        byte_of = printable_bytes()
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        vocabulary = {s: n for s, n in model["vocab"].items() if s not in self.special}
        self.rank, self.halves, self.merge = {}, {}, {}
        for at, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocabulary[left + right]
            if whole in self.rank:
                raise ValueError("a token with two merges has no unique last token")
            self.rank[whole], self.halves[whole] = at, (vocabulary[left], vocabulary[right])
            self.merge[vocabulary[left], vocabulary[right]] = at
        known = {to_bytes(s): n for s, n in vocabulary.items()}
        reached = {b: n for b, n in known.items() if n in self.rank or len(b) == 1}
        self.automaton = SuffixAutomaton(reached)
        self.sizes = {n: len(b) for b, n in reached.items()}
        self.pattern = regex.compile(PIECES)
        self.cut = None
        if self.special:
            longest = sorted(self.special, key=len, reverse=True)
            self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")")
        self.generation, self.older, self.pairs = remembered // 2, {}, {}
        self.library = tokenizers.Tokenizer.from_file(path).pre_tokenizer
        self.same_class: dict[str, bool] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.generation:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            numbers = self.piece_ids(piece.encode())
            ids = pack(f"<{len(numbers)}I", *numbers)
        if len(piece) < 256:
            self[piece] = ids
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged in order of rank, end as these two."""
        rank, halves, merge = self.rank, self.halves, self.merge
        below = NEVER
        while True:
            if merge.get((left, right), NEVER) < below:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left one was formed last: undo it
                below, left = a, halves[left][1]
            else:  # of two equal ones the right one was
                below, right = b + 1, halves[right][0]

    def piece_ids(self, piece: bytes) -> list[int]:
        auto, sizes, pairs = self.automaton, self.sizes, self.pairs
        step, link, length, word, shorter = (
            auto.step, auto.link, auto.length, auto.word, auto.shorter,
        )
        last = [-1] * (len(piece) + 1)
        state, size = 0, 0
        for end, byte in enumerate(piece, 1):
            while byte not in step[state]:
                state = link[state]
                size = length[state]
            state, size = step[state][byte], size + 1
            at = state if word[state] >= 0 and length[state] <= size else shorter[state]
            while True:
                token = word[at]
                start = end - sizes[token]
                if not start:
                    last[end] = token
                    break
                pair = last[start] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(last[start], token)
                if fits:
                    last[end] = token
                    break
                at = shorter[at]
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= sizes[last[end]]
        return ids[::-1]

    def _agrees(self, char: str) -> bool:
        """Whether the pattern here and the library see this character alike."""
        known = self.same_class.get(char)
        if known is None:
            probe = f"a{char}1{char}!{char} {char}"
            cut = [probe[a:b] for _, (a, b) in self.library.pre_tokenize_str(probe)]
            known = self.same_class[char] = cut == self.pattern.findall(probe)
        return known

    def pieces(self, text: str) -> Iterator[str]:
        raw = text.encode()
        plain = not raw or np.frombuffer(raw, np.uint8).max() < 0xD5  # all below U+0540
        if plain or all(map(self._agrees, set(text))):
            if len(text) < 1 << 20:
                return self.pattern.findall(text)
            return (m[0] for m in self.pattern.finditer(text))
        return (text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text))

    def encode(self, text: str) -> bytes:
        find = self.__getitem__
        if not self.cut or not self.cut.search(text):
            return b"".join(map(find, self.pieces(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.extend(map(find, self.pieces(part)))
        return b"".join(out)


class Decoder:
    """Texts of packed ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = printable_bytes()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {
            n: bytes(byte_of[c] for c in s)
            for s, n in spec["model"]["vocab"].items()
            if s not in special
        } | {n: s.encode() for s, n in special.items()}

    def decode(self, ids: bytes) -> str:
        known = self.bytes_of
        # As the library does, an id that it does not know adds nothing.
        parts = (known.get(n, b"") for n in np.frombuffer(ids, "<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once per worker process."""
    return Encoder(path)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(
    df: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """(doc_id, token_ids): ids of every whole text as the tokenizer file defines them.

    With ``decoded`` a column ``text`` has what the ids decode to, as ``decode`` gives it,
    without sending them to a second worker.

    ``token_ids`` is binary: little-endian unsigned 32-bit integers.  A null or empty
    text has no ids (empty binary).  Repeated rows and null keys give a row each; an
    empty table gives an empty one.  A text of any length is encoded piece by piece.
    """

    def rows(docs):
        own, back = encoder(tokenizer), decoder(tokenizer)
        for d in docs:
            ids = own.encode(d["text"])
            out = {"doc_id": d["doc_id"], "token_ids": ids}
            yield out | {"text": back.decode(ids)} if decoded else out

    given = texts(df, doc_id, text)
    kind = given.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, token_ids binary" + ", text string" * decoded
    return arrow_map(given, rows, schema, 256)


def decode(
    df: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "token_ids"
) -> DataFrame:
    """(doc_id, token_ids, text): the text of every id sequence made by ``encode``.

    Null ids count as none.  Bytes that are no UTF-8 become replacement characters, and
    unknown ids are left out, as the tokenizers library does.
    """

    def rows(docs):
        own = decoder(tokenizer)
        for d in docs:
            yield d | {"text": own.decode(d["token_ids"])}

    given = df.select(
        named(doc_id).alias("doc_id"), F.coalesce(named(ids), F.lit(b"")).alias("token_ids")
    )
    kind = given.schema[0].dataType.simpleString()
    return arrow_map(given, rows, f"doc_id {kind}, token_ids binary, text string", 256)
