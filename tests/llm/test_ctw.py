"""The context tree's kernels: what they give and what they take."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gaugeloom.llm import ctw
from gaugeloom.llm import textkernel as K


def test_grams_take_one_pass():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(100_000)).encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text) // 2, len(text)])
    tracemalloc.start()
    ctw.grams(buf, off)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # the grams themselves are 8 bytes a byte of text; arrays of positions for each byte would come on top of them
    assert peak < 16 * len(text)


def test_stream_of_odd_texts():
    rng = random.Random(5)
    for _ in range(300):
        parts = ["a", "B", "Z", " ", "\n", "\t", "\x0b", "\xa0", "é", "xyz" * 30]
        texts = ["".join(rng.choices(parts, k=rng.randrange(rng.choice([1, 4, 30])))) for _ in range(rng.randrange(1, 6))]
        buf, off = K.utf8(pa.array(texts))
        out, first = ctw.stream(buf, off)
        words = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes(K.LOWER))) for t in texts]
        spelled = [b" ".join(w) + b"\n" for w in words]
        assert [out[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)] == spelled
        want = [int.from_bytes((b"\n" * ctw.DEPTH + s)[i : i + ctw.DEPTH + 1]) for s in spelled for i in range(len(s))]
        assert ctw.codes(out, first).tolist() == want
        keys, at = ctw.tokens(out, first)
        assert np.diff(at).tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        assert len(set(zip(keys.tolist(), flat, strict=True))) == len(set(flat)) == len(set(keys.tolist()))


def test_counts_fold(monkeypatch):
    monkeypatch.setattr(ctw, "HELD", 50)
    rng, counts, distinct = np.random.default_rng(1), ctw._Counts(), ctw._Distinct()
    runs = [rng.integers(-40, 400, n) for n in (0, 1, 300, 30, 300, 7)]
    for k, keys in enumerate(runs):
        counts.add(keys.copy(), k % 2)
        distinct.add(keys.copy())
    got = counts.take(1).to_pydict()
    every = np.concatenate(runs)
    weight = np.repeat(np.arange(len(runs)) % 2, [len(r) for r in runs])
    assert dict(zip(got["key"], got["n"], strict=True)) == {k: int(weight[every == k].sum()) for k in every.tolist()}
    assert distinct.fold().tolist() == sorted(set(every.tolist()))


def test_more_documents_than_a_run_numbers(spark):
    n = (1 << ctw.DOC_BITS) + 100
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").otherwise("x").alias("text"))
    got = ctw.score(docs).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.count("*"), F.countDistinct("score"), F.min("n_tokens"), F.max("n_tokens")).orderBy("odd").collect()
    assert [tuple(r) for r in got] == [(0, n // 2, 1, 1, 1), (1, n // 2, 1, 2, 2)]
