"""Byte-level BPE by ranks next to the library, and edge cases of the matrices."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from linkrec.llm import catalog, rank_bpe

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, token_ids string, decoded int"


@pytest.fixture(scope="module")
def own():
    return rank_bpe.Ranks(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=own.rank, special_tokens={}
    )


def cases():
    rng = random.Random(3)
    out = ["", " ", "x" * 3_000, "ab" * 700, " " * 999 + "x", "it's 'Tis'll", "\n\t\n" * 300]
    out += ["日本語" * 200, "é́" * 300, "<|endoftext|>", "\x00\x1c\x85 ﻿", "😀" * 90]
    for _ in range(150):
        letters = rng.choice(["ab", "abc ", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éàü日本 "])
        out.append("".join(rng.choice(letters) for _ in range(rng.choice([5, 30, 300, 900]))))
    return out


def test_equals_the_library(own, library):
    given = cases()
    sizes, ids = own.encode(given)
    assert sizes.tolist() == [len(library.encode_ordinary(t)) for t in given]
    assert ids.tolist() == [i for t in given for i in library.encode_ordinary(t)]
    n, raw = own.decode(sizes, ids)
    assert raw.tobytes() == "".join(given).encode()
    assert n.tolist() == [len(t.encode()) for t in given]


@pytest.mark.parametrize("long, matrix", [(2, 1 << 22), (40, 64), (10_000, 1 << 22)])
def test_paths_agree(own, library, monkeypatch, long, matrix):
    """Alone from two bytes on, in tiny matrices, and all together: the ids are the same."""
    monkeypatch.setattr(rank_bpe, "LONG", long)
    monkeypatch.setattr(rank_bpe, "MATRIX", matrix)
    fresh = rank_bpe.Ranks(PATH, PATTERN)
    given = cases()[:80]
    assert fresh.encode(given)[1].tolist() == [i for t in given for i in library.encode_ordinary(t)]


def test_odd_ranks(tmp_path, monkeypatch):
    """A merge may make a pair of a smaller rank, and tokens need not be reached by merges."""
    tokens = [bytes([b]) for b in range(256)]
    tokens += [b"abc", b"bca", b"cab", b"bc", b"ab", b"ca", b"aa", b"aab", b"abab", b"zzz"]
    path = tmp_path / "odd.ranks"
    lines = (f"{base64.b64encode(t).decode()} {n}\n" for n, t in enumerate(tokens))
    path.write_text("".join(lines))
    of = tiktoken.Encoding(
        "odd",
        pat_str=PATTERN,
        mergeable_ranks={t: n for n, t in enumerate(tokens)},
        special_tokens={},
    )
    rng = random.Random(9)
    given = ["".join(rng.choice("abcz") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for long in (2, 10_000):
        monkeypatch.setattr(rank_bpe, "LONG", long)
        own = rank_bpe.Ranks(str(path), PATTERN)
        assert own.encode(given)[1].tolist() == [i for t in given for i in of.encode_ordinary(t)]


def test_a_full_table_forgets_and_stays_right(library):
    own = rank_bpe.Ranks(PATH, PATTERN, remembered=50)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)]
    for _ in range(30):
        text = " ".join(rng.choices(words, k=rng.choice([5, 40, 200])))
        assert own.encode([text])[1].tolist() == library.encode_ordinary(text)
    assert len(own.known) <= 400


def test_a_text_longer_than_a_group(own, library, monkeypatch):
    monkeypatch.setattr(rank_bpe, "TEXT", 100)
    monkeypatch.setattr(rank_bpe, "PIECES", 7)
    text = "a long text, word by word; " * 50
    assert list(rank_bpe.together(["a", text, "b", "c"])) == [["a"], [text], ["b", "c"]]
    assert own.encode([text])[1].tolist() == library.encode_ordinary(text)


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for key, text in docs:
        ids = library.encode_ordinary(text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        told = digest(" ".join(map(str, ids)).encode()), digest(library.decode_bytes(ids))
        want.add((key, len(ids), *told))
    assert {tuple(r) for r in catalog.op12_rank_bpe(spark, SMALL).collect()} == want


def test_odd_rows(spark, library):
    rows = [(1, "some text", "x", 1), (1, "some text", "x", 1), (None, "no key", None, None)]
    rows += [(2, None, "x", None), (3, "", "x", 1), (4, "x" * 2_000_000, "x", 1)]
    rows += [(5, "word " * 300_000, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = rank_bpe.encode(df, PATH, PATTERN, decoded=True)
    back = {r.doc_id: bytes(r.decoded).decode() for r in out.collect()}
    assert back == {k: t or "" for k, t, *_ in rows}
    lists = out.collect()
    assert len(lists) == len(rows) and out.columns == ["doc_id", "token_ids", "decoded"]
    for r in lists:
        if r.doc_id != 4:
            assert r.token_ids == library.encode_ordinary(back[r.doc_id])
    assert rank_bpe.encode(df.limit(0), PATH, PATTERN).collect() == []


def test_decode_by_itself(spark, library):
    ids = library.encode_ordinary("Grüße, 世界")
    rows = [(1, ids), (2, None), (3, []), (4, [ids[0], None, -5, 60_000]), (5, ids[-1:])]
    df = spark.createDataFrame(rows, "doc_id long, token_ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in rank_bpe.decode(df, PATH, PATTERN).collect()}
    one = library.decode_bytes
    assert got == {1: "Grüße, 世界".encode(), 2: b"", 3: b"", 4: one(ids[:1]), 5: one(ids[-1:])}
