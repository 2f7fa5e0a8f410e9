import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codeassay.llm import pfor, token_files

DDL = "doc_id long, text string, part string"


def brute(rows):
    """Whole texts by the library, in order of id; ids by doc as (start, n_tokens, crc32)."""
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


ODD = [
    "", None, "  a ", "İstanbul ΣΑΣ ẞ ß Ǆ", "é a ́b", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "don't we'll I'VE 's", "\x1c\x1d a\x85b c d", "日本語 テキスト", "a\tb\r\nc\x0b\x0cd", "x\u0000y", "word " * 30_000,
]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 2**32])
def test_round_trip_of_blocks(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    ids[::17] = top - 1
    image = pfor.encode(ids, [n])
    assert (pfor.decode(image) == ids).all() and pfor.lengths_of(image).tolist() == [n]
    assert (pfor.decode(image, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_small_ids_pack_well():
    ids = np.random.default_rng(0).integers(1000, 1016, 100_000)
    assert len(pfor.encode(ids, [len(ids)])) < 0.7 * len(ids)
    assert len(pfor.encode(np.full(25_600, 7), [25_600])) < 2000


def test_files_hold_what_whole_texts_encode_to(spark):
    rows = [(None if i == 3 else i * 7 % 12, t, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, DDL)
    segments = token_files.write_segments(docs, token_files.default_tokenizer(), segment_ids=5)
    assert segments.count() > 1
    found = token_files.read_segments(segments).collect()
    assert sorted(map(tuple, found), key=repr) == brute([r[:2] for r in rows])


def test_more_words_than_are_remembered(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    encoder = token_files.WordEncoder(token_files.default_tokenizer())
    for _ in range(2):
        ids, n = encoder.encode([b"one two three four five", b"six one", b""])
        whole = [*encoder.tokenizer.encode("one two three four five").ids, 1]
        assert ids[: n[0]].tolist() == [x for x in whole if x < 49_406]
        assert n.tolist()[2] == 1 and len(encoder.numbers) <= 3


def test_repeated_rows_and_an_empty_table(spark):
    tokenizer = token_files.default_tokenizer()
    docs = spark.createDataFrame([(5, "a b", "x")] * 3 + [(5, "c", "y")], DDL)
    found = token_files.read_segments(token_files.write_segments(docs, tokenizer)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [5] * 4 and found[-1].start + found[-1].n_tokens == 3 * 3 + 2
    empty = token_files.write_segments(docs.limit(0), tokenizer)
    assert token_files.read_segments(empty).count() == 0
