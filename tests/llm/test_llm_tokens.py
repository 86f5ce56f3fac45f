"""Token operators against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from patronvoice.llm import wavelet
from patronvoice.llm.common import shared_folder
from patronvoice.llm.counts import PairRanks, TokenCounter, count_merged, count_tokens
from patronvoice.llm.packing import harmonic_pieces, pack_documents
from patronvoice.llm.tokens import TextEncoder, byte_tokenizer, word_tokenizer
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, size int, row string, n_tokens string"
ODD = [
    "", " ", "\n", "a<|endoftext|>b", " <|endoftext|> ", "<|startoftext|>", "<|ENDOFTEXT|>", "é  ́e a b c\x1cd\x85e", "don't I'LL 's  't", "日本語 テスト１２３",
    "a\n \nb", "a \nb", "a   b ", "a" * 300, "ab" * 3000, "İstanbul ΣΑΣ ΑΣ. ẞ ﬃ", "x,.;!? ,, ... y.", "a\x0bb\x0cc\x1db c",
]


def odd_texts(n=4000, seed=5):
    rng = random.Random(seed)
    letters = list("ab'sS.,!1²ⅷ \n\t 　é́İΣ<|endoftext|>日ß  aa")
    return ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(n)]


def test_encoder_equals_library():
    texts = odd_texts()
    encoder = TextEncoder(word_tokenizer(), cache_words=500)
    want = Tokenizer.from_file(word_tokenizer()).encode_batch(texts, add_special_tokens=False)
    assert encoder.by_part
    assert encoder.encode([*texts, None]) == [*(np.array(e.ids, "<u4").tobytes() for e in want), b""]


def test_counter_equals_library():
    texts = odd_texts()
    want = Tokenizer.from_file(byte_tokenizer()).encode_batch(texts, add_special_tokens=False)
    assert TokenCounter(byte_tokenizer(), cache_words=500).count(texts) == [len(e.ids) for e in want]


def test_merging_takes_left_of_overlaps():
    ranks = PairRanks([(0, 0, 1), (1, 0, 2), (1, 1, 3)])
    assert count_merged(np.zeros(5, int), np.array([5]), ranks).tolist() == [2]  # aa aa a -> aaaa a
    assert count_merged(np.array([0, 0, 0, 7]), np.array([3, 0, 1]), ranks).tolist() == [1, 0, 1]


def test_count_tokens_rows(spark):
    rows = [(1, "a b", 1, "r", "n"), (1, "a b", 1, "r", "n"), (None, None, None, None, None), (3, "", 1, "", "")]
    got = count_tokens(spark.createDataFrame(rows, SCHEMA), byte_tokenizer(), limit=1).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(None, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True), (3, 0, 0, False)]
    assert count_tokens(spark.createDataFrame([], SCHEMA), byte_tokenizer()).count() == 0


def held(lengths, pieces, capacity):
    total = np.zeros(len(lengths), int)
    np.add.at(total, pieces[:, 0], pieces[:, 2])
    assert (total == lengths).all() and (pieces[:, 2] > 0).all()
    for key, at in ((0, 1), (3, 4)):  # gapless within documents and within bins
        p = pieces[np.lexsort((pieces[:, at], pieces[:, key]))]
        same = p[1:, key] == p[:-1, key]
        assert (p[1:, at] == np.where(same, p[:-1, at] + p[:-1, 2], 0)).all()
        assert not len(p) or p[0, at] == 0
    fill = np.bincount(pieces[:, 3], pieces[:, 2]).astype(int)
    assert all(f == capacity or f & (f - 1) == 0 for f in fill if f)
    return fill


def test_harmonic_pieces():
    rng = random.Random(1)
    for _ in range(400):
        capacity = rng.choice([1, 2, 8, 64, 4096])
        lengths = np.array([rng.choice([0, 1, capacity, capacity + 1, rng.randint(1, 5 * capacity)]) for _ in range(rng.randint(1, 40))])
        held(lengths, harmonic_pieces(lengths, capacity), capacity)
    # a bin of class k has k whole documents of that class, then a filling
    lengths = np.array([2000] * 40 + [10] * 300)
    pieces = harmonic_pieces(lengths, 4096)
    own = pieces[(pieces[:, 0] < 40) & (pieces[:, 2] == 2000)]
    assert (np.bincount(own[:, 3])[np.unique(own[:, 3])] == 2).all() and len(own) >= 30


def test_pack_documents(spark):
    texts = [(i, t) for i, t in enumerate(odd_texts(300))] + [(None, "null id"), (7, None), (7, "again " * 9000)]
    rows = [(i, t, 1, "r", "n") for i, t in texts]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), word_tokenizer(), chunk_tokens=5000).toPandas()
    encoder = TextEncoder(word_tokenizer())
    want = sorted(e + b"\2\0\0\0" for e in encoder.encode([t for _, t in texts]))
    assert (got.ids.map(zlib.crc32) == got.ids_crc32).all() and (got.ids.map(len) == 4 * got.length).all()
    unique = got[got.doc_id.notna() & (got.doc_id != 7)].sort_values(["doc_id", "start"])
    joined = unique.groupby("doc_id").ids.agg(b"".join)
    assert all(joined[i] == encoder.encode([t])[0] + b"\2\0\0\0" for i, t in texts if i is not None and i != 7)
    assert got.length.sum() == sum(map(len, want)) // 4
    fill = got.groupby("sequence_id").length.sum()
    assert all(f == 4096 or f & (f - 1) == 0 for f in fill)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert pack_documents(spark.createDataFrame([], SCHEMA), word_tokenizer()).count() == 0


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5, 1), (1000, 3), (70_000, 2), (150_000, 900), (66_000, 49_000)])
def test_wavelet_file(n, kinds):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, kinds, n).astype(np.uint32)
    file = wavelet.WaveletFile(wavelet.build(np.arange(2), np.zeros(2), tokens))
    assert (file.decode() == tokens).all() and file.count(10**6) == 0
    for i in rng.integers(0, max(n, 1), 20 if n else 0):
        token = int(tokens[i])
        where = np.flatnonzero(tokens == token)
        k = int(rng.integers(0, len(where)))
        assert file.access(int(i)) == token and file.select(token, k) == where[k]
        assert file.count(token) == len(where) and file.count(token, 3, int(i)) == (where[where >= 3] < i).sum()
    if 0 < n <= 1000:
        assert file.positions(int(tokens[0])) == np.flatnonzero(tokens == tokens[0]).tolist()


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000])
def test_token_files(spark, shard_bytes):
    texts = [(i * 3, t) for i, t in enumerate(odd_texts(200))] + [(None, "null id"), (4, None)] + [(5, f"copy {i % 7}") for i in range(300)]
    df = spark.createDataFrame([(i, t, 1, "r", "n") for i, t in texts], SCHEMA).repartition(3)
    folder = shared_folder(spark)
    wavelet.write_token_files(df, folder, word_tokenizer(), shard_bytes=shard_bytes)
    got = wavelet.read_token_files(spark, folder).orderBy("start").collect()
    encode = TextEncoder(word_tokenizer()).encode
    want = sorted(((-1 if i is None else i), encode([t])[0] + b"\2\0\0\0") for i, t in texts)
    found = [(-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got]
    assert [f[0] for f in found] == [w[0] for w in want] and sorted(found) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]


def test_token_files_of_nothing(spark):
    folder = shared_folder(spark)
    wavelet.write_token_files(spark.createDataFrame([], SCHEMA), folder, word_tokenizer())
    assert wavelet.read_token_files(spark, folder).count() == 0
