"""Operator 1 against the tokenizers library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epiframe.llm import tokens

ODD = [None, "", " ", "\n\n a  b\t\tc \n", "x" * 5000, "a\x1c b\x1dc", "don't  we'll I'd é ß", "日本語 テキスト 12345 !!??", "<|endoftext|> a", "a <|endoftext|> b  <|endoftext|>\n<|endoftext|>c.<|endoftext|>d, e<|endoftext|>", "\t<|endoftext|>  b <|endo", "<|endoftext|><|endoftext|>", "é ́ x", "tab\tend ", "\u0085x\u0085 \u0085"]


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 2**bits, 1000).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    assert (tokens.unpack(data, 1000, bits) == ids).all()
    assert (tokens.unpack(data, 10, bits, 333) == ids[333:343]).all()


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (3, "again"), (None, "no id"), (3, "again")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, start int")
    got = [tuple(r[:4]) for r in tokens.tokenize(df).orderBy("start").collect()]
    assert got == brute(rows)


def test_empty_table(spark):
    assert tokens.tokenize(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r[:4]) for r in tokens.tokenize(docs).orderBy("start").collect()]
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_random_access(spark, tmp_path, sf, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 100)
    w = tokens.ShardWriter(f"file://{tmp_path}/a.tok", 17)
    ids = np.arange(950, dtype=np.uint32) * 100
    lengths = np.array([0, 3, 500, 447])
    w.add(np.arange(4), np.zeros(4, bool), ids, lengths)
    w.close()
    s = tokens.Shard(f"file://{tmp_path}/a.tok")
    assert [len(s.document(k)) for k in range(4)] == lengths.tolist()
    assert (s.document(2) == ids[3:503]).all() and (s.ids(95, 205) == ids[95:205]).all()


def test_used_pieces_outlive_a_full_table(monkeypatch):
    """Pieces that come again are kept and not encoded anew; those of one use go, and the table stays bounded."""
    monkeypatch.setattr(tokens, "CACHE", 40)
    e, fresh = tokens.Encoder(tokens.default_tokenizer(), 0), tokens.Encoder(tokens.default_tokenizer(), 0)
    texts = ["often again, often again!\n" + " ".join(f"rare{chr(97 + k)}{chr(97 + n)}" for n in range(20)) for k in range(12)]
    for k, text in enumerate(texts):
        if len(e.index) > 40:
            learned = []
            monkeypatch.setattr(e, "learn", lambda keys, f=e.learn: (learned.extend(keys), f(keys)))
            ids, lengths = e([text])
            assert not {"again,", "often"} & set(learned) and len(e.index) <= 20 + 2 * 26
            monkeypatch.undo()
            monkeypatch.setattr(tokens, "CACHE", 40)
        else:
            ids, lengths = e([text])
        want = [*fresh.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert ids.tolist() == want and lengths.tolist() == [len(want)]
        assert np.array_equal(e.gather(np.array([e.index[""]]))[0], [0])
