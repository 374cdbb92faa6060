"""Operators 7, 8 and 10 against the libraries, on odd texts and random ones."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm.llm_edges import EDGES
from tessera.llm import rans
from tessera.llm.piece_codec import PieceCodec, digests, encode_decode
from tessera.llm.token_counts import WordCounter, token_counts
from tessera.llm.token_output import StretchTokenizer, read_token_ids, token_output, write_token_ids

BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def odd_texts(n=1500):
    r = random.Random(4)
    letters = "   ▁\n\ta bctheinġ Éßéçñ 你好😀\x00\x1c　０１23'sS..-&|<>ΣΑİKĳ"
    return ["", " ", "  ", "<|endoftext|>x <|startoftext|>y", "don't THAT'S", "a" * 50, *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n))]


def test_counts_are_the_library_s():
    own, library = WordCounter(WORD), Tokenizer.from_file(WORD)
    for t in odd_texts():
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_pieces_are_the_library_s():
    own, library = PieceCodec(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    r = random.Random(5)
    for t in odd_texts():
        ids = [*library.encode(t), 2]
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids), repr(t)
    for _ in range(500):
        ids = [r.randrange(300) if r.random() < 0.7 else r.randrange(32000) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_stretches_are_whole_texts():
    own = StretchTokenizer(BYTE)
    for texts in (odd_texts(), odd_texts()[::-1]):
        assert own.encode(texts) == own.whole(texts)


def test_token_counts(docs):
    got = token_counts(docs(EDGES), WORD).collect()
    library = Tokenizer.from_file(WORD)
    want = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for k, t in EDGES]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts(docs([]), WORD).count() == 0


def test_piece_digests(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for k, t in EDGES:
        ids = [*library.encode(t or ""), 2]
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, digests(docs(EDGES), PIECE).collect()))) == sorted(map(str, want))
    row = next(r for r in encode_decode(docs(EDGES), PIECE).collect() if r.doc_id == 6)
    assert row.decoded == EDGES[6][1] and row.ids[-1] == 2
    assert digests(docs([]), PIECE).count() == 0


def test_workers_let_go_of_a_codec(spark, docs):
    """What a codec holds must not stay in the workers that other jobs then use."""
    rows = docs([(i, f"text {i}") for i in range(32)]).repartition(8)

    def held(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            pass
        n = sum(isinstance(x, PieceCodec) for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    for made in (digests, encode_decode):
        assert made(rows, PIECE).count() == 32
        assert {r.n for r in rows.mapInArrow(held, "n long").collect()} == {0}


def test_token_files(spark, docs, tmp_path):
    library = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, token_output(docs(EDGES), BYTE, 2).collect()), key=lambda r: r[1])
    want, start = [], 0
    for k, t in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_output(docs([]), BYTE, 2).count() == 0
    write_token_ids(docs(EDGES), BYTE, str(tmp_path / "f"), 2)
    ids = {r.key: r.ids for r in read_token_ids(spark, str(tmp_path / "f"), 50257).collect()}
    assert ids[1] == [2] and ids[6][-2] == 50256


def test_token_files_of_other_and_repeated_keys(spark):
    from decimal import Decimal

    library = Tokenizer.from_file(BYTE)
    texts = [f"text {i % 7} of a key" for i in range(3000)]
    keys = [Decimal(5) if i % 3 else Decimal(i) / 4 for i in range(3000)]  # one key holds two thirds of all rows
    got = token_output(spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id decimal(10,2), text string").repartition(3), BYTE, 2).collect()
    rows = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted(k.quantize(Decimal("0.01")) for k in keys)
    assert [r[1] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1].tolist()]
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    own = {t: crc(t) for t in set(texts)}
    assert sorted(r[3] for r in rows) == sorted(own[t] for t in texts)


@pytest.mark.parametrize("n", [0, 1, 127, 5000, 300_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.uint16)
    tables = rans.Tables(rans.normalised(np.bincount(ids, minlength=50257)))
    assert int(tables.freq.sum()) == 1 << rans.PRECISION
    blob = rans.encode_block(ids, np.array([n]), 7, tables)
    head, back = rans.decode_block(blob, tables)
    assert head["first"] == 7 and (back == ids).all()
    if n > 10_000:
        last = len(head["spans"]) - 1
        assert (rans.decode_span(head, last, tables) == ids[head["spans"][last][0] * head["lanes"] :]).all()
        with pytest.raises(ValueError):
            rans.decode_block(blob[:-9] + bytes([blob[-9] ^ 1]) + blob[-8:], tables)
