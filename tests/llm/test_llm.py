"""Each text operator against a brute-force version, and its edge cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
import zstandard
from pyspark.sql import functions as F

from linkrec.llm import (
    bpe,
    catalog,
    class_lm,
    common,
    exact_dedup,
    jaccard,
    langid,
    licenses,
    mixing,
    pfp,
    token_files,
    topk,
)

SMALL = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 40
ROWS = [
    (1, LONG, "en", "a", 0),
    (2, LONG, "en", "a", 0),
    (2, LONG, "en", "a", 0),  # a repeated row
    (3, LONG.replace("kappa", "KAPPA", 1) + "!", None, "b", 1),
    (4, None, "en", None, 2),
    (5, "", "fr", "b", None),
    (6, "  \n\t", "fr", "b", None),
    (7, "one two", "fr", "c", None),
    (8, "One  two", "fr", "c", None),
    (9, "%%% 123 <|endoftext|> é́ 日本 All Rights, reserved", None, "c", None),
    (None, "no key here but a text of some words", "en", "c", None),
    (10, "x" * 3_000, "en", "c", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    # A clashing extra column (bucket) has to do no harm.
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_bpe_equals_the_library_and_decodes(given, docs, empty):
    library = tokenizers.Tokenizer.from_file(BYTE)
    for df in (given, docs):
        want = collections.Counter()
        for key, text in texts_of(df):
            ids = library.encode(text, add_special_tokens=False).ids
            raw = np.array(ids, "<u4").tobytes()
            want[key, raw, library.decode(ids, skip_special_tokens=False)] += 1
        got = bpe.decode(bpe.encode(df, BYTE), BYTE).collect()
        assert collections.Counter((r.doc_id, bytes(r.token_ids), r.text) for r in got) == want
    assert bpe.encode(empty, BYTE).count() == 0


def test_token_files_round_trip(spark, given, docs, empty):
    library = tokenizers.Tokenizer.from_file(WORD)
    for df in (given, docs):
        files = token_files.write_tokens(df, WORD, end_id=2)
        got = token_files.read_tokens(files).collect()
        want = collections.Counter(
            (key if key is not None else -(1 << 63), tuple(library.encode(t, add_special_tokens=False).ids + [2]))
            for key, t in texts_of(df)
        )
        ids = {r.start: (r.doc_id, tuple(np.frombuffer(r.token_ids, "<u4").tolist())) for r in got}
        assert collections.Counter(ids.values()) == want
        at, last = 0, -(1 << 63)
        for start in sorted(ids):
            assert start == at and ids[start][0] >= last
            at, last = at + len(ids[start][1]), ids[start][0]
    one = files.first()
    reader = token_files.open_file(spark, one.file)
    assert reader.document(0).tolist() == list(ids[one.start][1])
    assert token_files.read_tokens(token_files.write_tokens(empty, WORD)).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 32])
def test_packing_is_exact(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5_003, dtype=np.uint64)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(raw, bits, 0, len(ids)) == ids).all()
    assert (token_files.unpack(raw, bits, 4_001, 77) == ids[4_001:4_078]).all()


def exact_reference(pairs):
    groups = collections.defaultdict(list)
    for key, text in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((key, text))
    out = collections.Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for key, _ in members:
            out[key, best, len(members), sha] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"huge": 100}, {"primes": ((7, 3), (5, 2))}])
def test_exact_groups(given, docs, empty, how):
    for df in (given, docs):
        got = exact_dedup.exact_groups(df, **how).collect()
        have = collections.Counter(
            (r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got
        )
        assert have == exact_reference(texts_of(df))
        kept = collections.Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_groups(empty, **how).count() == 0


def test_fingerprints_of_parts_compose():
    own = exact_dedup.powers(exact_dedup.PRIMES)
    raw = np.random.default_rng(1).bytes(200_000)
    whole = own.whole(raw)
    for cut in (0, 1, 65_536, 131_072, 199_999):
        assert own.joined(own.whole(raw[:cut]), own.whole(raw[cut:]), len(raw) - cut) == whole


def test_class_model(given, docs, empty):
    held = common.held_out(F.col("doc_id"), 5, 1)
    for df in (given, docs):
        tokens = [(k, t.encode().lower().split() + [None]) for k, t in texts_of(df)]
        teach = [w for k, w in tokens if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
        count = collections.Counter(x for w in teach for x in w)
        n, v = sum(count.values()), len(count)
        base = lambda w: sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        got = class_lm.score_texts(df, held, classes=8, rounds=1).collect()
        have = collections.Counter(
            (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got
        )
        assert have == collections.Counter(
            (k, len(w), sum(count[x] > 0 for x in w), n, round(base(w), 6)) for k, w in tokens
        )
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert class_lm.score_texts(empty, held).count() == 0


@pytest.mark.parametrize("rounds", [0, 3])
def test_class_model_equals_brute_force(given, monkeypatch, rounds):
    """Scores by word classes read from the blocks, with all counts made anew in Python."""
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 3_000)
    n_classes, weight = 8, 0.8
    held = common.held_out(F.col("doc_id"), 5, 1)
    corpus = given.select("doc_id", "text", held.alias("held_out"))
    blocks = class_lm.corpus_blocks(
        corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out"), n_classes
    )
    buckets = 3
    now, _, gained = class_lm.fit_classes(blocks, n_classes, rounds, buckets, least_gain=0.0)
    assert gained == sorted(gained) and len(gained) > rounds // 2
    of_hash = {}
    for r in now.collect():
        view = class_lm.BlockView(r.asDict(recursive=True))
        of_hash |= zip(view.words.tolist(), view.classes(r["told"]).tolist())
    hashes = class_lm.Words(n_classes)
    own = lambda w: of_hash[hashes[w] if w else hashes.end]

    docs = [(r.doc_id, r.held_out, (r.text or "").encode().lower().split() + [b""])
            for r in corpus.collect()]
    count = collections.Counter(w for _, out, d in docs if not out for w in d)
    steps = collections.Counter(
        (own(a), own(b)) for _, out, d in docs if not out for a, b in zip([b"", *d], d)
    )
    after = collections.Counter()
    before = collections.Counter()
    for (a, b), k in steps.items():
        before[a] += k
        after[b] += k
    n = sum(count.values())
    told = sum(k / n * math.log(k * n / before[a] / after[b]) for (a, b), k in steps.items())
    assert gained[-1] == pytest.approx(told)
    want = {}
    for key, _, d in docs:
        total, last = 0.0, 0
        for w in d:
            p = (1 - weight) * (count[w] + 0.5) / (n + 0.5 * (len(count) + 1))
            if count[w]:
                c = own(w)
                follow = (steps[last, c] + 0.5) / (before[last] + 0.5 * n_classes)
                p += weight * follow * count[w] / after[c]
                last = c
            total += math.log10(p)
        want[key] = total
    got = class_lm.score_texts(
        given, held, classes=n_classes, rounds=rounds, weight=weight, least_gain=0.0
    )
    for r in got.collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)


def test_rounds_that_lose_are_taken_back(given, monkeypatch):
    blocks = class_lm.corpus_blocks(
        given.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held_out")),
        8,
    )
    _, matrix, gained = class_lm.fit_classes(blocks, 8, rounds=0)
    apart = np.eye(8) * matrix.sum() / 8
    assert class_lm.mutual_information(apart) == pytest.approx(math.log(8))
    assert class_lm.mutual_information(np.zeros((8, 8))) == 0
    told = iter([matrix, np.ones((8, 8))])  # after a round no class tells anything
    monkeypatch.setattr(class_lm, "transitions", lambda *_: next(told))
    now, kept, after = class_lm.fit_classes(blocks, 8, rounds=5)
    assert kept is matrix and after == gained
    assert all(r["told"] is None for r in now.select("told").collect())


def test_class_model_beats_the_unigram_on_held_out_texts(spark):
    # 1,000 documents; of the 200 of the smallest table most held-out words are unseen.
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = class_lm.score_texts(more, common.held_out(F.col("doc_id"), 5, 1)).where("held_out")
    total = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.s > 0.97 * total.b


def test_long_documents_go_on_in_the_next_block(given, monkeypatch):
    held = F.lit(False)
    want = {r.doc_id: r for r in class_lm.score_texts(given, held, rounds=0).collect()}
    monkeypatch.setattr(class_lm, "BLOCK_TOKENS", 100)
    for r in class_lm.score_texts(given, held, rounds=0).collect():
        assert r.n_tokens == want[r.doc_id].n_tokens
        assert r.score == pytest.approx(want[r.doc_id].score)


def test_counts_go_beyond_32_bits(spark):
    words = np.array([5 << 8, 9 << 60], np.uint64)
    most = np.array([(1 << 32) - 1, 7], "<u4").tobytes()
    block = lambda b: (b, class_lm.packed.to_bytes(words), most)
    table = spark.createDataFrame(
        [block(b) for b in range(3)], "block long, words binary, counts binary"
    )
    told = class_lm.word_counts(table, buckets=2).where("block is not null").collect()
    for b in range(3):
        mine = [r.asDict() for r in told if r.block == b]
        assert class_lm._counts(mine).tolist() == [3 * ((1 << 32) - 1), 21]
    for top in (0, 255, 256, 65_535, 65_536, (1 << 32) - 1, 1 << 32):
        counts = np.array([0, top, 1])
        again = class_lm._counts([{"bucket": 0, "data": class_lm.packed_counts(counts)}])
        assert again.tolist() == counts.tolist()


def test_top_k(spark):
    x = [[0.5, -1.0], [0.5, -1.0], [3e5, 1.0], None, [None, 1.0], [float("nan"), 0.0], [2.0]]
    table = spark.createDataFrame(
        [(i, v, "extra") for i, v in enumerate(x)] + [(None, [1.0, 1.0], "no key")],
        "vec_id long, embedding array<float>, score string",
    )
    rng = np.random.default_rng(5)
    more = [(100 + i, rng.normal(size=40).tolist(), "") for i in range(300)]
    more += [(900 + i, more[0][1], "") for i in range(30)]  # ties
    more += [(100, more[7][1], ""), (100, more[0][1], "")]  # a query's key again
    more += [(950, [3e3] + [1.5] * 39, ""), (951, [2.2e6] + [0.1] * 39, "")]
    more += [(952, [-2.2e6] + [0.1] * 39, "")]  # beyond longs against 951, yet not its best
    both = topk.whole_vectors(table.union(spark.createDataFrame(more, table.schema)))
    vectors = [(r.row_no, r.vec_id, r.v) for r in both.collect()]
    assert set(range(7)) - {k for _, k, _ in vectors} == {3, 4, 5}
    queries = both.where("vec_id % 50 = 0 OR vec_id = 951")
    got = topk.exact_top_k(both, queries, 5, cell_bytes=20_000)
    want = []
    for no, q, x in vectors:
        if q % 50 == 0 or q == 951:
            each = sorted(
                (-sum(a * b for a, b in zip(x, v)), k)
                for other, k, v in vectors
                if other != no and len(v) == len(x)
            )[:5]
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(each)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert sum(k in (951, 952) for _, _, k, _ in want) >= 5
    assert topk.exact_top_k(both.limit(0), both, 5).count() == 0


def test_top_k_refuses_scores_that_are_no_longs(spark):
    schema = "vec_id long, embedding array<double>"
    made = lambda *x: topk.whole_vectors(
        spark.createDataFrame([(i, [c]) for i, c in enumerate(x)], schema)
    )
    high, low = made(4e6, 4e6), made(4e6, -4e6, 1.0)
    with pytest.raises(Exception, match="is no long"):
        topk.exact_top_k(high, high, 1).collect()
    first = low.where("vec_id = 0")
    best = topk.exact_top_k(low, first, 1).collect()
    assert [tuple(r) for r in best] == [(0, 1, 2, 4_000_000 * 1024 * 1024)]
    with pytest.raises(Exception, match="is no long"):
        topk.exact_top_k(low, first, 2).collect()
    with pytest.raises(Exception, match="is no long"):
        made(1e18).count()



def repeats_reference(pairs, length=50):
    first = {}
    last = float("inf")
    for key, text in pairs:
        raw, key = text.encode(), last if key is None else key
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, last), key)
    out = collections.Counter()
    for key, text in pairs:
        raw = text.encode()
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (last if key is None else key):
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key, len(raw), int(gone.sum()), spans, kept] += 1
    return out


def test_repeats(given, docs, empty):
    for df in (given, docs):
        got = pfp.drop_repeats(df).collect()
        have = collections.Counter(
            (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got
        )
        assert have == repeats_reference(texts_of(df))
    assert pfp.drop_repeats(empty).count() == 0


def test_repeats_in_pieces_and_many_buckets(given):
    got = pfp.drop_repeats(given, bucket_bytes=20_000, bucket_passages=2_000).collect()
    have = collections.Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got
    )
    assert have == repeats_reference(texts_of(given))


def test_repeats_in_a_text_of_several_blocks(spark):
    rng = np.random.default_rng(5)
    some = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    long = some(pfp.BLOCK_BYTES + 90_000)
    at = pfp.BLOCK_BYTES
    pairs = [
        (5, long),
        (-4, "x" + long[at - 70 : at + 80] + "y"),  # over the border of two blocks
        (7, some(200) + long[at - 20 : at + 29] + "z" + long[at - 60 : at - 10]),  # 49 and 50
        (None, long[9_000:9_060] + some(100)),
        (9, long[: at + 10] + "é" + long[at + 50_000 : at + 50_300]),
    ]
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    got = pfp.drop_repeats(table, bucket_passages=20_000).collect()
    have = collections.Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got
    )
    assert have == repeats_reference(pairs)


def test_answers_of_a_bucket_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    bodies = [bytes(rng.integers(97, 99, 70).astype(np.uint8)) for _ in range(30)]
    bodies += [bodies[i % 5] for i in range(30)]
    asks = [
        pfp._ask(
            0, *(np.array([x]) for x in (i, i % 7, 10 * i, 21)), b"asked", b"", b
        )
        for i, b in enumerate(bodies)
    ]
    table = pa.Table.from_pylist(asks)
    whole = pfp._passage_answers(50, 2)(table).to_pylist()
    monkeypatch.setattr(pfp, "SORTED", 100)
    monkeypatch.setattr(pfp, "WINDOWS", 64)
    assert pfp._passage_answers(50, 2)(table).to_pylist() == whole
    # Neighbouring passages are one run.
    merged = pfp._merged(pfp.RUN)(pfp._passage_answers(50, 2)(table)).to_pylist()
    runs = {r["k"]: np.frombuffer(r["parts"][0], "<u4").reshape(-1, 2).tolist() for r in merged}
    assert runs[41] == [[10 * 41, 21]]


def test_window_hashes_agree_with_the_windows():
    raw = np.frombuffer(b"abcabcabcabd" * 20, np.uint8)
    at = np.arange(len(raw) - 50)
    told = collections.defaultdict(set)
    for a, h in zip(at.tolist(), pfp.window_hashes(raw, at, 50).tolist(), strict=True):
        told[raw[a : a + 50].tobytes()].add(tuple(h))
    assert all(len(h) == 1 for h in told.values()) and len(told) == 12


def test_a_notice_in_all_documents_fills_no_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some = lambda: "".join(map(chr, rng.integers(97, 123, 60)))
    notice = "ALL RIGHTS RESERVED BY THE OWNERS (2020)"
    pairs = [(i, some() + notice + some()) for i in range(400)]
    pairs += [(1_000 + i, some() + pairs[i][1][50:110]) for i in range(40)]
    table = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    asked, arrow_map = [], pfp.arrow_map

    def noted(df, rows, schema, batch):
        out = arrow_map(df, rows, schema, batch)
        if schema == pfp.ASK:
            asked.append(out)
        return out

    monkeypatch.setattr(pfp, "arrow_map", noted)
    got = pfp.drop_repeats(table, bucket_passages=400).collect()
    have = collections.Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got
    )
    assert have == repeats_reference(pairs) and sum(r.n_removed > 0 for r in got) == 40
    passages = collections.Counter()
    for r in asked[-1].where("length(h1) > 0").collect():
        passages[r.bucket] += int(np.frombuffer(r.n, "<u4").sum())
    assert sum(passages.values()) > 4_000 and max(passages.values()) < 1_000


def test_language(given, docs, empty):
    held = common.held_out(F.col("doc_id"), 4, 2)
    learned = langid.fit_dictionaries(given.where(~held))
    found = {r.doc_id: r for r in langid.identify(given, learned).collect()}
    truth = [(r.doc_id, r.lang) for r in given.where(held).collect()]
    assert sum(found[k].lang_pred == lang for k, lang in truth) >= 0.9 * len(truth)
    got = collections.defaultdict(list)
    for r in langid.identify(docs, learned).collect():
        got[r.doc_id].append(r)
    assert all(got[k][0].lang_pred == "und" and got[k][0].rejected for k in (4, 5, 6))
    assert len(got[2]) == 2 and all(0 <= r.score <= 1 for v in got.values() for r in v)
    assert langid.drop_rejected(docs, learned).columns == docs.columns
    assert langid.fit_dictionaries(empty) == {}
    assert langid.identify(docs, {}).where("lang_pred = 'und'").count() == len(ROWS)


def test_dictionaries_come_from_anywhere_in_the_texts(spark):
    number = "12 345 " * 300
    german = [f"{number} der Hund Nummer {chr(97 + i)} schläft" for i in range(20)]
    made = [(t, "de") for t in german] + [("", "fr"), ("12 %", "fr"), (None, "fr"), ("no", None)]
    made += [(german[0], "de")] * 50  # copies teach once
    made += [("word " * 40_000 + "tail", "en")]
    table = spark.createDataFrame(made, "text string, lang string")
    learned = langid.fit_dictionaries(table)
    assert sorted(learned) == ["de", "en"]
    letters = sorted(b" ".join(langid.letters(t).split()) for t in german)
    assert len(learned["de"]) == sum(map(len, letters)) + len(letters) - 1
    assert all(t in learned["de"] for t in letters)
    assert 60_000 < len(learned["en"]) <= 65_536
    small = langid.fit_dictionaries(table, docs_per_language=8, dictionary_bytes=400)
    assert len(small["de"]) <= 400 and small["de"].count(b"hund") == 8  # all that are drawn teach
    assert list(langid.fit_dictionaries(table, max_languages=1)) == ["de"]
    tie = langid.Classifier({"b": b"same words here", "a": b"same words here"})
    assert tie.classify("same words here") == ("a", 0.0)


def test_answers_are_those_of_plain_compression(given):
    held = common.held_out(F.col("doc_id"), 4, 2)
    learned = langid.fit_dictionaries(given.where(~held))

    def size(raw, own):
        how = zstandard.ZstdCompressionParameters.from_level(
            langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        kind = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kind.precompute_compress(compression_params=how)
        one = zstandard.ZstdCompressor(dict_data=kind, compression_params=how)
        step = langid.CHUNK
        return sum(len(one.compress(raw[a : a + step])) for a in range(0, len(raw), step))

    want = {}
    for k, t in texts_of(given):
        if any(c.isalpha() for c in t):
            low = re.sub(rb"[^a-z\x80-\xff]+", b" ", t.lower().encode()).strip()
            want[k] = min((size(low, raw), name) for name, raw in learned.items())[1]
        else:
            want[k] = "und"
    assert {r.doc_id: r.lang_pred for r in langid.identify(given, learned).collect()} == want


def jaccard_reference(pairs, n=5):
    sets = []
    for _, text in pairs:
        w = text.encode().lower().split()
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        sets.append(grams or ({tuple(w)} if w else set()))
    label = list(range(len(pairs)))
    for _ in pairs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if all(
            label[i] == label[j]
            for i, a in enumerate(sets)
            for j, b in enumerate(sets[:i])
            if a and 100 * len(a & b) >= 75 * len(a | b)
        ):
            break
    out = collections.Counter()
    for i, (key, _) in enumerate(pairs):
        keys = [k for (k, _), own in zip(pairs, label) if own == label[i] and k is not None]
        out[key, len(sets[i]), min(keys, default=None)] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"region_hashes": 200, "bucket_bytes": 5_000}])
def test_similar_groups(given, docs, empty, how):
    for df in (given, docs):
        got = jaccard.similar_groups(df, **how).collect()
        have = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)
        assert have == jaccard_reference(texts_of(df))
    assert jaccard.similar_groups(empty, **how).count() == 0


def test_mixing_keeps_to_the_weights(given, docs, empty):
    weights = {"src0": 5, "src1": 3, "src2": 1}
    got = mixing.mix(given, weights, block=2, rows_per_task=4).collect()
    assert len(got) == given.count()
    assert all(r.slot is None and not r.in_mix for r in got if r.source not in weights)
    for s in weights:
        assert sorted(r.place for r in got if r.source == s) == list(
            range(sum(r.source == s for r in got))
        )
    slots = {r.slot: r.source for r in got if r.in_mix}
    done = collections.Counter()
    for t in range(max(slots) + 1):
        done[slots[t]] += 1
        assert all(abs(done[s] - (t + 1) * w / 9) < 1 for s, w in weights.items())
    assert mixing.mix(docs).count() == len(ROWS)
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs, max_sources=2)
    with pytest.raises(ValueError, match="slots"):
        mixing.mix(docs, {"a": 1_000_000})


def test_pfair_windows():
    for weights in ({"a": 1}, {"a": 7, "b": 2, "c": 2}, {"a": 1, "b": 1, "c": 998}):
        period = sum(weights.values())
        for s, slots in mixing.pfair_period(weights).items():
            for j, slot in enumerate(slots, 1):
                assert (j - 1) * period // weights[s] <= slot < -(-j * period // weights[s])


def test_licenses(given, docs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    base = {tuple(p.split()): label for p, label in licenses.BASE.items()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for df in (given, docs):
        got = collections.Counter(
            (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
            for r in licenses.scan_licenses(df).collect()
        )
        want = collections.Counter()
        for key, text in texts_of(df):
            w = word.findall(text.translate(lower))
            at = [
                (i, label)
                for p, label in base.items()
                for i in range(len(w))
                if tuple(w[i : i + len(p)]) == p
            ]
            places = [i for i, _ in at]
            labels = ",".join(sorted({label for _, label in at}))
            first, last = min(places, default=None), max(places, default=None)
            want[key, len(w), len(at), first, last, labels] += 1
        assert got == want
    assert licenses.scan_licenses(empty).count() == 0


def plain_scan(text):
    """Labels, score, expressions' names and malformed lines, by looking everywhere."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
    labels, covered = set(), set()
    for i in range(len(w)):
        best = ()
        for table, is_base in ((licenses.BASE, True), (licenses.NOTICES, False)):
            for phrase, label in table.items():
                p = tuple(phrase.split())
                if tuple(w[i : i + len(p)]) != p:
                    continue
                after = w[i + len(p)] if i + len(p) < len(w) else ""
                if is_base:
                    labels.add(label)
                    covered |= set(range(i, i + len(p)))
                elif not (p[-1][-1].isdigit() and re.fullmatch(r"\d{1,2}", after)):
                    best = max(best, (len(p), label))
        if best:
            labels.add(best[1])
            covered |= set(range(i, i + best[0]))
    good, bad = [], []
    tag = r"(?<![A-Za-z0-9\x80-\U0010ffff])spdx-license-identifier(?=[ \t]*:[ \t]*([^\r\n]*))"
    for m in re.finditer(tag, text, re.I | re.A):
        postfix = licenses.to_postfix(m[1])
        fits = postfix and licenses.is_known(postfix)
        (good if fits else bad).append(m[1])
        if fits:
            labels |= {t for t in postfix if t not in ("AND", "OR", "WITH")}
    return ",".join(sorted(labels)), 1.0 if good else len(covered) / (len(covered) + 4), bad


LICENSED = [
    "SPDX-License-Identifier: the and that",
    "SPDX-License-Identifier: see the file",
    "// SPDX-License-Identifier: MIT/X11\nmore",
    "// SPDX-license-identifier :\tGPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT\nMIT AND",
    "SPDX-License-Identifier: MIT. SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: LicenseRef-own OR mit\r\nSPDX-License-Identifier: (MIT",
    "SPDX license identifier: MIT",
    "xSPDX-License-Identifier: MIT",
    "SPDX-License-Identifier:",
    "SPDX-License-Identifier: mit WITH isc\nSPDX-License-Identifier: llvm-exception",
    "Under the Mozilla Public License, version 1.1, or the Apache License 2.0, January 2004",
    "Mozilla Public License version 1.7; GNU General Public License v2; MPL",
    "GNU Lesser General Public License, all rights reserved, CC BY, cc by",
    "Mozilla Public License version 2 2004",
    "\u00e9 " * 400_000 + "\nSPDX-License-Identifier: zlib\n" + "mit license " * 100_000,
]


def test_license_labels_and_scores(spark, given, docs):
    rows = list(enumerate(LICENSED))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (given, docs, planted):
        want = collections.Counter()
        for key, text in texts_of(df):
            if len(text) < 100_000:
                labels, score, bad = plain_scan(text)
                want[key, labels, round(score, 9), tuple(bad)] += 1
        got = collections.Counter(
            (r.doc_id, r.labels, round(r.score, 9), tuple(r.malformed))
            for r in licenses.scan_licenses(df).where("n_words < 50000").collect()
        )
        assert got == want
    by_id = {r.doc_id: r for r in licenses.scan_licenses(planted).collect()}
    assert [by_id[i].labels for i in (0, 1, 2)] == ["", "", ""]
    assert by_id[2].malformed == ["MIT/X11"] and by_id[2].permitted is False
    assert by_id[3].labels == "classpath-exception-2.0,gpl-2.0-or-later,mit" and by_id[3].permitted
    assert by_id[4].expressions == ["mit", "isc"]  # each tag is read from its own place
    assert by_id[5].labels == "licenseref-own,mit" and by_id[5].malformed == ["(MIT"]
    assert by_id[10].labels == "apache-2.0,mpl-1.1" and by_id[13].labels == "mpl-2.0"
    assert by_id[11].labels == "gpl,gpl-2.0,mpl"
    assert by_id[14].labels == "mit,zlib" and by_id[14].n_words == 600_004
    assert len(licenses.NOTICES) > 200 and licenses.ALLOWED <= licenses.KNOWN


def test_license_query(spark):
    got = {r.doc_id: r for r in catalog.QUERIES["op10_licenses"](spark, SMALL).collect()}
    want = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got.keys() == {r.doc_id for r in want}
    for r in want:
        labels, score, _ = plain_scan(r.text or "")
        assert (got[r.doc_id].labels, got[r.doc_id].score) == (labels, pytest.approx(score))


@pytest.mark.parametrize(
    ("line", "postfix", "fine"),
    [
        ("MIT", ["mit"], True),
        ("GPL-2.0 OR MIT AND ISC", ["gpl-2.0", "mit", "isc", "AND", "OR"], True),
        ("(GPL-2.0 OR MIT) AND GPL-3.0", ["gpl-2.0", "mit", "OR", "gpl-3.0", "AND"], False),
        ("GPL-2.0 WITH x-exception and mit", ["gpl-2.0", "x-exception", "WITH", "mit", "AND"], False),
        ("Apache-2.0 */ more text", ["apache-2.0"], True),
        ("MIT AND", None, None),
        ("(MIT", None, None),
        ("", None, None),
    ],
)
def test_expressions(line, postfix, fine):
    assert licenses.to_postfix(line) == postfix
    if postfix:
        assert licenses.evaluate(postfix, licenses.ALLOWED) is fine


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for table in ("benchmark", "documents", "embeddings"):
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = db.sql(catalog.ORACLES[name])
    order = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SMALL).select(*order)
    rows = want.select(*order).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
