import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from foliogrid.llm import tokens as K

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[0, 1], [0, 0, 0], [0, 5, 5, 9, 1000], list(np.cumsum(np.random.default_rng(1).integers(0, 900, 1000))), [0, 2**40], list(range(300))])
def test_elias_fano_round_trip(values):
    values = np.array(values)
    code = K.EliasFano(len(values), *K.EliasFano.encode(values))
    assert (code.all() == values).all() and [code.select(i) for i in range(len(values))] == list(values)
    if len(values) > 900:
        size = len(code.low) + len(code.high) + 4 * len(code.hints)
        assert size < 0.3 * 8 * len(values)
    with pytest.raises(IndexError):
        code.select(len(values))
    for a in range(0, len(values), 1 + len(values) // 9):
        for b in (a, a + 1, (a + len(values)) // 2, len(values)):
            assert (code.span(a, b) == values[a:b]).all()


def test_one_document_is_read_without_decoding_all_bounds(spark, tmp_path, monkeypatch):
    values = np.cumsum(np.random.default_rng(3).integers(0, 900, 100_000))
    code = K.EliasFano(len(values), *K.EliasFano.encode(values))
    asked = []
    unpack = np.unpackbits
    monkeypatch.setattr(K.np, "unpackbits", lambda x, **o: asked.append(len(x)) or unpack(x, **o))
    assert code.select(70_001) == values[70_001] and (code.span(70_001, 70_003) == values[70_001:70_003]).all()
    assert sum(asked) < 100 < len(code.high)
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('some words ', cast(id as int)) as text")
    K.write_tokens(docs, f"{tmp_path}/one", WORD, segment=20_000)
    monkeypatch.setattr(K.EliasFano, "all", None)
    (row,) = K.find_tokens(spark, f"{tmp_path}/one", [321]).collect()
    assert row.n_tokens == len(row.ids) == 643 and row.start == sum(2 * i + 1 for i in range(321))


def expected(rows, path, end=1):
    t, at, out = Tokenizer.from_file(path), 0, []
    place = lambda r: ((h := xxhash.xxh64_intdigest((r[1] or "").encode(), 42)) - (h >> 63 << 64), r[1] or "")
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *place(r))):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("path,by_word", [(WORD, True), (BYTE, False)])
def test_files_equal_the_library(spark, odd, tmp_path, path, by_word):
    rng = random.Random(2)
    chars = "abcAB'sé  ́ ſßİ<|endoftext|>漢😀1 2\n\t.,!\x1c\x85Σς"
    more = [(100 + i, "".join(rng.choice(chars) for _ in range(rng.randrange(80)))) for i in range(200)]
    more += [(400, "a <|startoftext|> b<|startoftext|>c <|endoftext|>"), (401, "don't I'll WE'VE ab'sx x'-y a,b;c--'d 'twas rock'n'roll..."), (402, "Don't!! (a)b[c] é, É. e\u0301, a'\u0301 İx ΑΣ ß,x x\u0301y")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = expected([tuple(r) for r in docs.collect()], path)
    where = f"{tmp_path}/t"
    K.write_tokens(docs, where, path, by_word=by_word, segment=3000)
    got = [tuple(r) for r in K.token_digest(spark, where).orderBy("start").collect()]
    # rows of one id stand in order of their texts' hashes
    assert got == want
    back = {(r.doc_id, r.start): r.ids for r in K.read_tokens(spark, where).collect()}
    assert [(d, s, len(back[d, s]), zlib.crc32(np.array(back[d, s], "<u4").tobytes())) for d, s, _, _ in want] == want
    assert spark.read.parquet(where).count() > 3
    some = [x for x in want if x[0] in (2, 10, 150, 401)]
    found = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in K.find_tokens(spark, where, [2, 10, 150, 401, 9999]).collect()), key=lambda r: r[1])
    assert found == some and len(some) == 5


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 50)
    coder, t = K.Encoder(WORD), Tokenizer.from_file(WORD)
    for step in range(6):
        texts = [" ".join(f"word{step * 20 + i} and" for i in range(40)), "", "and"]
        raw = [x.encode() for x in texts]
        ids, bounds = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
        assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
        assert len(coder.place) <= 82 and len(coder.counts) == len(coder.place) == len(coder.keys) and (np.diff(coder.keys.astype(object)) > 0).all()


def test_empty_table(spark, empty, tmp_path):
    K.write_tokens(empty, f"{tmp_path}/e", WORD)
    assert K.token_digest(spark, f"{tmp_path}/e").count() == 0
