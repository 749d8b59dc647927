"""Piece codec (2) and token files (5)."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make_docs
from weekpanel.llm import rans, spm_scan
from weekpanel.llm.base import SpanTable, hash_words

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PIECES, BPE = public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return spm_scan.pieces(PIECES)


def brute(model, text):
    """The plain sequential scan over the whole normalised text."""
    whole = spm_scan.normal(text)
    if not whole:
        return []
    return model.ids_between(whole, model.forward(whole)[1], len(whole), 0)[0]


def chunked(model, text, size):
    parts = spm_scan.chunks(text, model.longest, size)
    entries = [p[0] for p in spm_scan.prefixes([model.transfer(t, c) for t, c in parts])]
    found = [model.backtrace(t, c, e) for (t, c), e in zip(parts, entries)]
    exits = spm_scan.follow([f[0] for f in found])
    return np.frombuffer(b"".join(f[1] + f[2][t] for f, t in zip(found, exits)), model.kind).tolist()


TEXTS = ["a", " ", "  a  b", "a\n\nb ", "\n x", "a" * 200, "thethingandtheinternationalization" * 9, "   " * 30 + "x", "é日▁ 本語"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("size", [7, 16, 40, 1000])
def test_chunks_give_the_sequential_path(model, text, size):
    assert chunked(model, text, size) == brute(model, text) == model.encode([text])[0].tolist()


def test_random_texts(model, prose):
    rng = random.Random(3)
    for k in range(30):
        text = prose(80, k) if k % 2 else "".join(rng.choice("abeinthe ▁\n日é.") for _ in range(200))
        assert chunked(model, text, 33) == brute(model, text)
        assert model.decode(brute(model, text)) == text.replace("▁", " ")


def test_products_are_associative():
    rng = np.random.default_rng(1)
    m = [np.where(rng.random((4, 4)) < 0.3, -np.inf, rng.integers(-9, 0, (4, 4)).astype(float)) for _ in range(5)]
    left = m[0]
    for x in m[1:4]:
        left = spm_scan.times(left, x)
    assert np.array_equal(spm_scan.prefixes(m)[4], left)
    assert np.array_equal(spm_scan.times(m[0], spm_scan.times(m[1], m[2])), spm_scan.times(spm_scan.times(m[0], m[1]), m[2]))


def test_the_library_decodes_and_no_segmentation_scores_higher(model, prose):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    worth = lambda ids: sum(library.get_score(i) for i in ids)
    for k in range(10):
        text = prose(50, k)
        ids = model.encode([text])[0].tolist()
        assert library.decode(ids) == text
        own = worth([i for i in ids if not library.is_byte(i)])
        assert own >= worth([i for i in library.encode(text) if not library.is_byte(i)])


def test_documents(spark, odd_texts, model):
    docs = make_docs(spark, list(enumerate(odd_texts)) + [(6, odd_texts[6])])
    rows = spm_scan.encode(docs, PIECES, chunk=5000).collect()
    assert len(rows) == len(odd_texts) + 1 and all(r.round_trip for r in rows)
    for r in rows:
        text = odd_texts[r.doc_id] or ""
        assert list(r.ids) == brute(model, text) and r.n_tokens == len(r.ids) and r.n_chars == len(text)
    assert {r.doc_id for r in rows if r.n_chunks > 1} == {8, 9}
    assert spm_scan.encode(docs.limit(0), PIECES).count() == 0


def test_span_table_grows_and_starts_anew():
    words = [f"w{k}".encode() for k in range(5000)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    table = SpanTable(np.dtype("<u2"), lambda new: [np.frombuffer(w, np.uint8).astype("<u2") for w in new], most=3000)
    for part in (slice(0, 2000), slice(1500, 3500), slice(0, 5000)):
        starts = (ends - [len(w) for w in words])[part]
        ids, sizes = table.ids(buf, starts, ends[part])
        assert bytes(ids.astype(np.uint8)) == b"".join(words[part]) and sizes.tolist() == [len(w) for w in words[part]]
    assert len(np.unique(hash_words(buf, ends - [len(w) for w in words], ends))) == 5000


def test_token_files(spark, odd_texts, tmp_path):
    library = tokenizers.Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    texts = odd_texts + ["<|endoftext|> a", "a  b", " lead", "tail ", "\ttab"]
    ids = [3 * i - 7 for i in range(len(texts))] + [5000, 5000]
    texts = texts + ["twice", "twice"]
    order = list(range(len(ids)))
    random.Random(1).shuffle(order)
    folder = rans.write_tokens(make_docs(spark, [(ids[k], texts[k]) for k in order]), BPE, folder=str(tmp_path / "tokens"))
    rows = sorted(rans.read_tokens(spark, folder).collect(), key=lambda r: (r.doc_id, r.start))
    start = 0
    for r, i, text in zip(rows, ids, texts, strict=True):
        tokens = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)


def check_files(spark, rows, folder, deal=rans.DEAL_TOKENS, **more):
    """Token files of rows whose equal ids hold equal texts, against the library."""
    library = tokenizers.Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    path = rans.write_tokens(make_docs(spark, rows), BPE, folder=str(folder), **more)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.read_tokens(spark, path, deal).collect())
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        tokens = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((start, i, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert got == want
    return path


@pytest.mark.parametrize("kind", ["null ids", "one id", "hashed ids", "dense ids", "third of one id", "nulls and one id"])
@pytest.mark.parametrize("most_bounds", [3, 4096])
def test_token_files_of_any_ids(spark, tmp_path, kind, most_bounds):
    rng = random.Random(4)
    ids = {"null ids": lambda i: None, "one id": lambda i: 77, "hashed ids": lambda i: rng.randrange(-(2**63), 2**63), "dense ids": lambda i: i,
           "third of one id": lambda i: 5 if i % 3 == 0 else i + 10, "nulls and one id": lambda i: None if i % 40 == 0 else 5 if i % 3 else i + 5}[kind]
    rows = [(k, "same text" if k in (None, 77, 5) else f"text {i} of some words") for i in range(400) for k in [ids(i)]]
    rng.shuffle(rows)
    path = check_files(spark, rows, tmp_path / "t", part_rows=20, most_bounds=most_bounds)
    sizes = [len(r.ids) for r in spark.read.parquet(f"{path}/blocks").collect()]
    assert len(sizes) >= 6 and max(sizes) <= 90


def test_blocks_are_decoded_from_their_checkpoints(spark, tmp_path, prose):
    """Small blocks in one task, giant ones segment by segment in many; a checkpoint that is lost is noticed."""
    rows = [(i, prose(30, i)) for i in range(20)] + [(50, prose(60_000, 3)), (51, None), (52, prose(40, 9))]
    for deal in (0, 10_000, rans.DEAL_TOKENS):
        path = check_files(spark, rows, tmp_path / f"d{deal}", deal)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.selectExpr("max(size(marks))").first()[0] >= 1
    blocks.withColumn("marks", F.transform("marks", lambda m: F.lit(b"\0" * 8 * rans.LANES))).write.parquet(str(tmp_path / "lost" / "blocks"))
    spark.read.parquet(f"{path}/table").write.parquet(str(tmp_path / "lost" / "table"))
    with pytest.raises(Exception, match="checksum|out of bounds|broadcast"):
        rans.read_tokens(spark, str(tmp_path / "lost")).collect()


def test_checksums_of_pieces_join():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    for cut in (0, 1, 7, 4096, 4999, 5000):
        assert rans.join_crc(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]), 5000 - cut) == zlib.crc32(data)


def test_token_files_of_nothing(spark, tmp_path):
    folder = rans.write_tokens(make_docs(spark, []), BPE, folder=str(tmp_path / "none"))
    assert rans.read_tokens(spark, folder).count() == 0


def test_blocks_decode_from_every_checkpoint():
    rng = np.random.default_rng(2)
    tokens = np.minimum(rng.geometric(0.01, 200_000), 50_000)
    values, counts = np.unique(tokens, return_counts=True)
    model = rans.Model.of(values.tolist(), counts.tolist())
    assert model.freq.sum() == 1 << rans.BITS and (model.freq[values] > 0).all()
    for lanes in (7, 500):
        states, words, places, marks = rans.encode_block(tokens, model, lanes)
        assert np.array_equal(rans.decode_block(len(tokens), states, words, model, lanes), tokens)
        for k in range(0, len(marks), max(1, len(marks) // 3)):
            step = (k + 1) * rans.STRIDE
            assert np.array_equal(rans.decode_block(len(tokens), marks[k], words, model, lanes, step, places[k]), tokens[step * lanes :])
    entropy = -(counts / len(tokens) * np.log2(counts / len(tokens))).sum()
    assert len(words) * 8 / len(tokens) < entropy * 1.01 + 0.1


def test_a_damaged_block_is_noticed(spark, tmp_path):
    folder = rans.write_tokens(make_docs(spark, [(1, "some words to damage " * 50)]), BPE, folder=str(tmp_path / "a"))
    broken = spark.read.parquet(f"{folder}/blocks").selectExpr("part", "block", "ids", "lens", "lanes", "states", "words", "at", "marks", "crc + 1 as crc")
    broken.write.parquet(str(tmp_path / "b" / "blocks"))
    spark.read.parquet(f"{folder}/table").write.parquet(str(tmp_path / "b" / "table"))
    with pytest.raises(Exception, match="checksum"):
        rans.read_tokens(spark, str(tmp_path / "b")).collect()
