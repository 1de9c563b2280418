"""Token encoding, packing and the bit-packed files against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from papertrail.llm import bitpack, packing
from papertrail.llm.encode import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("start", T.StringType()), T.StructField("length", T.LongType())])
PARTS = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "<|endoftext|>", "'s", "'LL", "12", ".",
         "!!", "İ", "Σ", "ΟΔΟΣ", "ß", "漢", "😀", "​", "the ", "\r\n", "ﬁ"]


def mixed(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def rows():
    texts = [None, "", " ", *mixed(60), "word " * 6000, "same text", "same text", "x" * 5000]
    return [(i if i % 9 else (None if i == 9 else i), t, "clash", 7) for i, t in enumerate(texts)]


def encoded(path, text, end):
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("path,blanks", [(WORD, False), (BYTE, True)])
def test_plain_texts_are_cut_by_bytes(path, blanks):
    rng = random.Random(9)
    parts = ["a", "Z", "é", "À", "ß", "Þ", "ÿ", "the", " ", " ", " ", "1", "29", ".", ",", "!!", "-", "\n", "_", "×", "÷", "ª", "'", "  ", "Œ"]
    texts = ["".join(rng.choice(parts[:19 if k % 3 else 25]) for _ in range(rng.randint(1, 30))) for k in range(6000)]
    texts += ["word " * 300_000, "Line one.\nLine 2, end!\nÉté ÉTÉ été"]
    own = PieceEncoder(path, blanks, limit=2000)
    plain = own._cut_plain([t.encode() for t in texts[:3000]])
    assert sum(i is not None for i in plain) > 800
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in expected]


@pytest.mark.parametrize("path,blanks", [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_units_that_share_a_hash_keep_their_ids(path, blanks, size):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2^64 for every odd base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"x {word}", f"x {other}", f"x {word} y {other} z", "plain words", f"{other} {other}"]
    expected = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    own = PieceEncoder(path, blanks)
    assert own.encode(texts) == expected and own.encode(texts[::-1]) == expected[::-1]
    assert [PieceEncoder(path, blanks).encode([t])[0] for t in texts] == expected


@pytest.mark.parametrize("path,blanks", [(WORD, False), (BYTE, True)])
def test_pieces_give_the_ids_of_the_whole_text(path, blanks):
    texts, own = mixed(4000), PieceEncoder(path, blanks, limit=500)
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    got = [i for at in range(0, len(texts), 100) for i in own.encode(texts[at:at + 100])]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in expected]
    assert all(max(len(g.young), len(g.old)) <= 3000 for g in (own.known, own.first, own.units))


def test_packed_pieces_cover_every_id_once(spark):
    data = rows()
    out = packing.pack_documents(spark.createDataFrame(data, DOCS), WORD).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    wanted = sorted((encoded(WORD, t, 1).tobytes() for _, t, _, _ in data), key=len)
    assert sum(r.length for r in out) == sum(len(w) // 4 for w in wanted)
    checks = sorted((zlib.crc32(w[4 * s:4 * s + 8192]), s) for w in wanted for s in range(0, len(w) // 4, 2048))
    assert sorted((r.ids_crc32, r.start) for r in out) == checks


def test_best_fit_takes_the_tightest_window():
    rng, windows, room = random.Random(5), packing.OpenWindows(100), []
    for length in sorted((rng.randint(1, 100) for _ in range(400)), reverse=True):
        fits = [r for r in room if r >= length]
        window, offset = windows.place(length)
        if window == len(room):
            assert not fits
            room.append(100)
        else:
            assert room[window] == min(fits)
        assert offset == 100 - room[window]
        room[window] -= length


def test_packing_leaves_little_room(spark):
    rng = random.Random(1)
    data = [(i, 0, rng.randint(1, 2048), i, 0) for i in range(3000)]
    out = packing.best_fit_decreasing(spark.createDataFrame(data, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    total, windows = sum(d[2] for d in data), out.select("sequence_id").distinct().count()
    assert total / (windows * 2048) > .98


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(empty, WORD).count() == 0
    assert bitpack.round_trip(empty, BYTE, 50257).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype("<u4")
    data = bitpack.pack(ids, bits)
    assert len(data) == (1003 * bits + 7) // 8 and (bitpack.unpack(data, bits, 1003) == ids).all()


def test_files_read_back_as_written(spark, monkeypatch):
    data = rows()
    out = sorted(bitpack.round_trip(spark.createDataFrame(data, DOCS), BYTE, 50257).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out if r.doc_id is not None] == sorted(d[0] for d in data if d[0] is not None)
    texts, at = {d[0]: d[1] for d in data}, 0
    for r in out:
        ids = encoded(BYTE, texts[r.doc_id], 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(bitpack, "BLOCK", 64)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50257, n).astype("<u4") for n in (3, 0, 500, 64, 1, 130)]
    with open(tmp_path / "f.bits", "wb") as stream:
        writer = bitpack.PackedWriter(stream, 16)
        for k, ids in enumerate(docs):
            writer.add(None if k == 0 else k, ids)
        writer.close()
    file = bitpack.PackedFile(str(tmp_path / "f.bits"))
    assert [int(o) for o in file.offsets[:2]] == [8, 8 + 128]
    for k in (5, 2, 0, 1, 3, 4):
        assert (file.document(k) == docs[k]).all()
    back = list(file.documents())
    assert [d for d, _ in back] == [None, 1, 2, 3, 4, 5] and all((a == b).all() for (_, a), b in zip(back, docs))
