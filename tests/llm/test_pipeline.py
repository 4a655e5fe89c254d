"""The whole pipeline on a small corpus of which is known what stays."""

import os
import random

import pytest

import corpus_pipeline
from brisa.llm import bpe, secrets


@pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCAB), reason="no vocabulary here")
def test_run(spark, tmp_path):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = make(30)
    token = "ghp_" + (body := "abcdefghijABCDEFGHIJ0123456789") + secrets.crc32_base62(body)
    bad = " ".join(["zzqqxx wwkkyy vvjjhh"] * 12)
    clean = {k: make(80) for k in range(60)}
    edited = clean[3].split()
    edited[40] = "edited"
    rows = list(clean.items()) + [(100 + k, bad + " " + make(5)) for k in range(20)]
    rows += [(200, clean[0]), (201, clean[0]), (202, " ".join(edited)), (203, make(40) + " " + item + " " + make(40)), (204, make(60) + f" {token} end"), (205, ""), (206, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 0, 0) for k in range(60)] + [(100 + k, 0, 1) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = dict(clean) | {204: rows[-3][1].replace(token, secrets.MASK), 205: ""}
    tok = bpe.load()
    got = {}
    windows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("window_id").collect()
    for w in windows:
        for b in w.boundaries:
            got.setdefault(b.doc_id, []).extend(w.tokens[b.start : b.start + b.length])
    assert all(ids[-1] == tok.eos for ids in got.values())
    assert {k: tok.decode(ids[:-1]) for k, ids in got.items()} == want
    assert [w.window_id for w in windows] == list(range(len(windows)))


def test_scratch_folders_are_removed(spark):
    from brisa.session import Scratch, _fs, collecting

    with collecting():
        a = Scratch(spark)
        a.put(spark.range(3), "t")
    fs, path = _fs(spark, a.root)
    assert not fs.exists(path)
