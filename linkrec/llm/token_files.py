"""Token ids in files of fixed-width bit-packed blocks.

A file holds the documents of one key range in ascending order:

    blocks   each block's ids, ``bits`` bits each, least significant bit first,
             padded to a whole byte
    index    offset of every block (u64), end of every document in ids (u64),
             key of every document (i64)
    footer   magic, bits per id, ids per block, number of ids, documents and blocks

As every id takes the same bits, any id can be read alone: the block offset leads
to its block, the place in the block to its bits.  Packing and unpacking are
numpy operations over whole blocks.
"""

from __future__ import annotations

import json
import string
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex
import tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from linkrec.llm.common import arrow_map, texts
from linkrec.storage import fresh_path, stored

MAGIC = b"LRTOKEN1"
FOOTER = struct.Struct("<8sIIQQQ")
BLOCK = 4096
REMEMBERED = 1_300_000  # entries of about 120 bytes


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte; from U+00AE on, itself."""
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {}
    for character in map(chr, range(0x540)):
        written = cut.pre_tokenize_str(character)[0][0]
        letters |= dict(zip(character.encode(), written, strict=True))
    return letters


BYTES = _byte_letters()


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, least significant bit first."""
    rows = -(-len(ids) // 8)
    padded = np.zeros(rows * 8, np.uint64)
    padded[: len(ids)] = ids
    eights = padded.reshape(rows, 8)
    out = np.zeros((rows, bits), np.uint8)  # eight ids fill ``bits`` bytes
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = eights[:, j] << np.uint64(shift)
        for k in range(byte, (j * bits + bits + 7) // 8):
            out[:, k] |= ((value >> np.uint64(8 * (k - byte))) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(raw: bytes | np.ndarray, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a packed block."""
    data = np.frombuffer(raw, np.uint8)
    place = (np.arange(start, start + count, dtype=np.int64)) * bits
    byte, shift = place >> 3, (place & 7).astype(np.uint64)
    value = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        part = data[np.minimum(byte + k, len(data) - 1)].astype(np.uint64)
        value |= part << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Writes one file block by block; holds a block and the document index."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.rest = np.zeros(0, np.uint32)
        self.offsets, self.ends, self.keys = [], [], []
        self.n_ids, self.at = 0, 0

    def add(self, key: int, ids: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.keys.append(key)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        for start in range(0, whole, BLOCK):
            self._block(self.rest[start : start + BLOCK])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.stream.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(np.array(self.ends, "<u8").tobytes())
        self.stream.write(np.array(self.keys, "<i8").tobytes())
        self.stream.write(
            FOOTER.pack(MAGIC, self.bits, BLOCK, self.n_ids, len(self.keys), len(self.offsets))
        )
        self.stream.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, self.n_ids, n_docs, n_blocks = FOOTER.unpack(
            source.read_at(FOOTER.size, size - FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = 8 * (n_blocks + 2 * n_docs)
        raw = source.read_at(index, size - FOOTER.size - index)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks)
        self.ends = np.frombuffer(raw, "<u8", n_docs, 8 * n_blocks)
        self.keys = np.frombuffer(raw, "<i8", n_docs, 8 * (n_blocks + n_docs))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only their blocks are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        stop = min((last + 1) * self.block, self.n_ids) - last * self.block
        begin = int(self.offsets[first])
        raw = self.source.read_at(
            int(self.offsets[last]) - begin + -(-stop * self.bits // 8), begin
        )
        # All blocks but the last are full and a whole number of bytes, so they read as one.
        return unpack(raw, self.bits, start - first * self.block, end - start)

    def document(self, at: int) -> np.ndarray:
        return self.ids(int(self.ends[at - 1]) if at else 0, int(self.ends[at]))


class LibraryEncoder(dict):
    """Ids of a text by the tokenizers library, remembering those of its parts.

    The tokenizer must drop white space and never join tokens across it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        self.library = tokenizers.Tokenizer.from_file(path)
        self.pattern = self._known_pattern(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.remembered, self.plain = remembered, False
        # For words that are cut and in lower case already, only the merges of the same file.
        if self.pattern is not None:
            self.of_words = tokenizers.Tokenizer.from_file(path).model
            self.of_words._resize_cache(0)  # words come here once
            alphabet = string.ascii_lowercase * 2
            self.whole_letters = self.pattern.findall(alphabet) == [alphabet]
        for probe in ("a b", "the quick, b'́x", "e ́", "1 2"):
            whole = self._ids(probe)
            if whole != [n for part in probe.split(" ") for n in self._ids(part)]:
                raise ValueError(f"{path} joins tokens across spaces")

    @staticmethod
    def _known_pattern(path: str) -> regex.Pattern | None:
        """The pattern of tokenizers that normalise to NFC and lower case, then cut by it."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != [
            "Split",
            "ByteLevel",
        ]:
            return None
        if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["use_regex"]:
            return None
        if any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
            return None
        return regex.compile(cuts[0]["pattern"]["Regex"])

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def __missing__(self, chunk: bytes) -> bytes:
        """Ids of what stands between spaces: of its words, or of the whole."""
        text = chunk.decode()
        if self.plain:
            text = text.lower()
            one = self.whole_letters and text.isascii() and text.isalpha()
            words = [text] if one else self.pattern.findall(text)
            ids = b"".join(map(self._word, words))
        else:
            ids = np.array(self._ids(text), "<u4").tobytes()
        self._remember(chunk, ids)
        return ids

    def _remember(self, chunk: bytes, ids: bytes) -> None:
        if len(self) >= self.remembered:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids

    def _is_plain(self, raw: bytes, text: str) -> bool:
        """Whether this pattern and the library are sure to see every character alike."""
        return (
            self.pattern is not None
            and (not raw or np.frombuffer(raw, np.uint8).max() < 0xD5)  # all below U+0540
            and "<|" not in text
            and "\u03a3" not in text  # its lower case depends on its place
            and unicodedata.is_normalized("NFC", text)
        )

    def _word(self, word: str) -> bytes:
        """Ids of a word of the pattern, which as a chunk of its own has the same ones."""
        raw = word.encode()
        ids = self.get(raw)
        if ids is None:
            letters = word
            if not (word.isascii() and word.isprintable()):
                letters = raw.decode("latin-1").translate(BYTES)
            found = [token.id for token in self.of_words.tokenize(letters)]
            ids = struct.pack(f"<{len(found)}I", *found)
            self._remember(raw, ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        raw = text.encode()
        self.plain = self._is_plain(raw, text)
        # bytes.split() cuts at ASCII white space, which no token holds or crosses.
        return np.frombuffer(b"".join(map(self.__getitem__, raw.split())), "<u4")


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def bits_for(tokenizer: str) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    size = tokenizers.Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    return max(1, (size - 1).bit_length())


def write_tokens(
    df: DataFrame,
    tokenizer: str,
    end_id: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Encode every whole text and write token files in ascending key order.

    Returns the manifest, one row per file: ``file``, ``start`` (ids in all files before
    it), ``n_ids``, ``n_docs``, ``first_doc``.  Keys are integers; rows with a null key
    come first, under the smallest long.  Null and empty texts have only the end id, if
    one is given.  Repeated rows are written each; an empty table makes no file.

    Each attempt of a task writes a file of its own name, and the manifest names only
    those of attempts that Spark committed, so a lost executor leaves at most a file that
    nothing refers to.  The folder must be one that every executor can reach by its URI.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    where = folder if "://" in folder or folder.startswith("/") else f"/{folder}"
    bits = bits_for(tokenizer)
    if end_id is not None and end_id >> bits:
        raise ValueError("the end id is outside the vocabulary")
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def rows(docs: Iterator[dict]) -> Iterator[dict]:
        writer = None
        for d in docs:
            if writer is None:
                own, part = library_encoder(tokenizer), TaskContext.get().partitionId()
                file = f"{where}/tokens-{part:06d}-{uuid.uuid4().hex}.bin"
                system, path = fs.FileSystem.from_uri(file)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                writer, first = Writer(system.open_output_stream(path), bits), d["doc_id"]
            writer.add(d["doc_id"], np.concatenate([own.encode(d["text"]), tail]))
        if writer is not None:
            writer.close()
            yield {
                "part": part,
                "file": file,
                "n_ids": writer.n_ids,
                "n_docs": len(writer.keys),
                "first_doc": first,
            }

    smallest = F.lit(-(1 << 63))
    given = texts(df, doc_id, text).select(
        F.coalesce(F.col("doc_id").cast("long"), smallest).alias("doc_id"), "text"
    )
    # The hash lets rows of one key be spread; it also fixes their order.
    order = ["doc_id", F.xxhash64("text")]
    ranged = given.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part int, file string, n_ids long, n_docs long, first_doc long"
    files = stored(arrow_map(ranged, rows, schema, 256), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.select(
        "file",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"),
        "n_ids",
        "n_docs",
        "first_doc",
    )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, token_ids) of every document in the files of a manifest.

    ``start`` counts all ids before the document, ``token_ids`` is binary: little-endian
    unsigned 32-bit integers.  Files are read block range by block range, several
    documents at a time.
    """

    def rows(files: Iterator[dict]) -> Iterator[dict]:
        for f in files:
            system, path = fs.FileSystem.from_uri(f["file"])
            with system.open_input_file(path) as source:
                reader, at = Reader(source), 0
                while at < len(reader.keys):
                    begin = int(reader.ends[at - 1]) if at else 0
                    stop = int(np.searchsorted(reader.ends, begin + 1_000_000, "right"))
                    stop = min(max(stop, at + 1), len(reader.keys))
                    ids = reader.ids(begin, int(reader.ends[stop - 1]))
                    for k in range(at, stop):
                        a = int(reader.ends[k - 1]) if k else 0
                        own = ids[a - begin : int(reader.ends[k]) - begin]
                        yield {
                            "doc_id": int(reader.keys[k]),
                            "start": f["start"] + a,
                            "token_ids": own.astype("<u4").tobytes(),
                        }
                    at = stop

    spread = manifest.repartition(max(1, manifest.count()), "file")
    schema = "doc_id long, start long, token_ids binary"
    return arrow_map(spread.select("file", "start"), rows, schema, 256)


def open_file(spark: SparkSession, file: str) -> Reader:
    """Random access to one token file from the driver or a task."""
    system, path = fs.FileSystem.from_uri(file)
    return Reader(system.open_input_file(path))
