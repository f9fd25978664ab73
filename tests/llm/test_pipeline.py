"""The pipeline's stages, each against what its operator or brute force says of its own input."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from test_mixing import rake
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline as P
from epiframe.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def windows_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(10, len(w))
    return w, [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if w else []


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        if k < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS and {r.doc_id for r in kept[-1]} <= {r.doc_id for r in kept[-2]}
    # base failures are gone
    assert all(len(words(r.text)) >= 20 for r in kept[1])
    # the document of the smallest id stays of each group of linked fingerprints
    groups = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in kept[1]])
    assert sorted(r.doc_id for r in kept[2]) == sorted({low for _, low in groups})
    # exactly the documents with a benchmark window are gone
    items = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in windows_of(r.text)[1]}
    sizes = {len(w) for w in items}
    def hit(text):
        w = windows_of(text)[0]
        return any(tuple(w[k : k + n]) in items for n in sizes for k in range(len(w) - n + 1))
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2] if not hit(r.text)}
    # exactly the documents whose hash is below their cell's share stay, by raking in numpy
    rows = {r.doc_id: r for r in mixing.with_topic(spark.createDataFrame(kept[3], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    cells = {}
    for r in rows.values():
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    share = {k: w / cells[k] if cells[k] else 1 for k, w in rake(cells)[0].items()}
    drawn = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) / 2**32
    assert {r.doc_id for r in kept[4]} == {d for d, r in rows.items() if drawn(d) < share[r.source, r.lang, r.topic]}
    # run() is these stages one after the other
    assert sorted(map(tuple, P.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in kept[5])
    # all that mixing kept is encoded
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, got = 0, {r.doc_id: r for r in kept[5]}
    for r in sorted(kept[4], key=lambda r: r.doc_id):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 0]
        x = got.pop(r.doc_id)
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_odd_tables(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string"
    rows = [(1, None, None, None, None, "x", None), (1, None, None, None, None, "x", None), (None, "", "en", "a", 0, None, None), (2, "a b " * 3000, "en", "a", 12000, None, None)]
    for n, table in enumerate((rows, [])):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, sf)
            out.write.parquet(str(tmp_path / f"{n}-{k}"))
            assert spark.read.parquet(str(tmp_path / f"{n}-{k}")).count() <= len(table)
