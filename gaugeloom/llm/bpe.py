"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each task cuts its texts into words by the tokenizer's pattern, gives every new
distinct word's bytes to DuckDB as token-position rows, and lets one recursive
query join them with the merge table and contract each word's leftmost
minimum-rank pair until none is left.  Decoding joins ids with the vocabulary and
concatenates the pieces in their kept order.  No text is shuffled.

The vocabulary is read on the driver from a rank file and sent to the tasks; its
size is fixed by the tokenizer, not by the data.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import small_batches

#: Iterations of one recursive query; words that need more go into another one.
DEPTH = 48
#: Distinct words that a task remembers between batches.
REMEMBERED = 400_000

#: A word without a pair to merge is marked as done by one more iteration.
#: Neighbours are taken in the rows' kept order: single-threaded DuckDB keeps the
#: order of rows, and its joins probe with the state (both set in Codec).
ENCODE = f"""
WITH RECURSIVE state AS (
  SELECT w, pos, tok, 0 AS it, false AS done FROM base
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT s.*, m.rank AS merged, m.rank::BIGINT * 4294967296 + s.pos AS key
     FROM (SELECT w, pos, tok, it, CASE WHEN lead(w) OVER () = w THEN lead(tok) OVER () END AS nxt
           FROM state WHERE it < {DEPTH} AND NOT done) s
     LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt),
   lowest AS (SELECT w, min(key) AS best FROM pairs GROUP BY w)
   SELECT w, pos, CASE WHEN hit THEN merged ELSE tok END, it + 1, done
   FROM (SELECT *, coalesce(lag(hit) OVER (), false) AS gone
         FROM (SELECT p.*, coalesce(p.key = b.best, false) AS hit, b.best IS NULL AS done FROM pairs p JOIN lowest b ON b.w = p.w))
   WHERE NOT gone))
SELECT w, pos, tok, done FROM state WHERE done OR it = {DEPTH} ORDER BY w, pos
"""

DECODE = """
SELECT p.doc, string_agg(v.piece, '') AS text
FROM positions p JOIN vocabulary v ON v.tok = p.tok GROUP BY p.doc ORDER BY p.doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every way to join two tokens into a token: (l, r, rank)."""
    l, r, m = [], [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                l.append(a)
                r.append(b)
                m.append(rank)
    return pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "rank": pa.array(m, pa.int32())})


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    out = np.zeros(0x110000, np.uint8)
    for plane in range(0, 0x110000, 0x800):  # 0xD800 to 0xDFFF, the surrogates, are one such block
        if plane == 0xD800:
            continue
        text = "".join(map(chr, range(plane, plane + 0x800)))
        for k, name in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\p{White_Space}")):
            for m in regex.finditer(f"{name}+", text):
                out[plane + m.start() : plane + m.end()] = k
    return out


def split_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pattern's matches, and each document's first match.

    The pattern is that of the byte-level rank files:
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces(?!\\S)|spaces
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    lead = (buf & 0xC0) != 0x80
    byte_at = np.flatnonzero(lead)
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    first = np.searchsorted(byte_at, off)
    new = np.zeros(n + 4, bool)
    new[first] = True
    c = np.zeros(n + 4, np.uint8)
    c[:n] = _classes()[cp]
    ch = np.zeros(n + 4, np.uint32)
    ch[:n] = cp
    start = new.copy()
    start[1:n] |= c[1:n] != c[: n - 1]
    # the last of several spaces before a word stands alone, or joins it if it is U+0020
    last = np.flatnonzero((c[:n] == 3) & (c[1 : n + 1] != 3) & ~new[1 : n + 1])
    start[last] = True
    start[last[ch[last] == 0x20] + 1] = False
    # contractions
    i = np.flatnonzero(ch[:n] == 0x27)
    inside = ~new[i]
    before = np.maximum(i - 1, 0)
    i = i[~(inside & ((c[before] == 0) | (ch[before] == 0x20)))]
    one, two = ch[i + 1], ch[i + 2]
    has1, has2 = ~new[i + 1], ~new[i + 1] & ~new[i + 2]
    single = has1 & np.isin(one, [ord(x) for x in "stmd"])
    double = has2 & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
    for which, length in ((single, 1), (double, 2)):
        at = i[which]
        start[at] = True
        for k in range(1, length + 1):
            start[at + k] = False
        start[at + length + 1] = True
    starts = np.flatnonzero(start[:n])
    return byte_at[starts], np.searchsorted(starts, first)


def _same(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, like: np.ndarray) -> bool:
    """Whether every span, and together they are the text, has the bytes of the span ``like`` it."""
    size = stops - starts
    if (size[like] != size).any():
        return False
    return bool((buf[np.arange(len(buf)) + np.repeat(starts[like] - starts, size)] == buf).all())


class Codec:
    """A task's encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "preserve_insertion_order": True})
        self.con.execute("SET disabled_optimizers = 'join_order,build_side_probe_side'")
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.register(
            "given",
            pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]}),
        )
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.ranks = ranks
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, count and all tokens of words, by the recursive query."""
        n = len(words)
        direct = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        begin, count = np.cumsum(direct >= 0) - 1, (direct >= 0).astype(np.int64)
        flat = [direct[direct >= 0].astype(np.int32)]
        size = len(flat[0])
        todo = np.flatnonzero(direct < 0)
        if len(todo):
            w = np.repeat(todo, [len(words[i]) for i in todo])
            tok = self.byte_rank[np.frombuffer(b"".join(words[i] for i in todo), np.uint8)]
            while len(w):
                pos = np.arange(len(w)) - np.searchsorted(w, w, side="left")
                self.con.register("base", pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int32), "tok": tok}))
                out = self.con.sql(ENCODE).to_arrow_table()
                w, tok, done = (out.column(c).to_numpy() for c in ("w", "tok", "done"))
                ended = w[done]
                if len(ended):
                    ids, lo, num = np.unique(ended, return_index=True, return_counts=True)
                    begin[ids], count[ids] = size + lo, num
                    flat.append(tok[done])
                    size += len(ended)
                w, tok = w[~done].astype(np.int64), tok[~done]
        return begin, count[:n], np.concatenate(flat)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts and each document's first position in them."""
        starts, first = split_words(buf, off)
        stops = np.append(starts[1:], len(buf))
        codes, distinct = pd.factorize(K.span_hashes(buf, starts, stops))
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        data = buf.tobytes()
        if not _same(buf, starts, stops, where[codes]):
            codes, spelled = pd.factorize(np.array([data[a:b] for a, b in zip(starts, stops, strict=True)], object))
            spelled = list(spelled)
        else:
            spelled = [data[starts[i] : stops[i]] for i in where]
        if len(self.known) + len(spelled) > REMEMBERED:
            self.forget()
        fresh = [w for w in spelled if w not in self.known]
        if fresh:
            begin, count, flat = self.contract(fresh)
            for w in fresh:
                self.known[w] = len(self.known)
            self.begin = np.append(self.begin, len(self.flat) + begin)
            self.count = np.append(self.count, count)
            self.flat = np.append(self.flat, flat)
        slot = np.fromiter((self.known[w] for w in spelled), np.int64, len(spelled))[codes]
        count = self.count[slot]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.begin[slot] - (ends - count), count)]
        return ids, np.concatenate([[0], ends])[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each document, by an aggregation of rows in their kept order."""
        n = len(bounds) - 1
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        self.con.register("positions", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "tok": ids}))
        got = self.con.sql(DECODE).to_arrow_table()
        out = [b""] * n
        for i, text in zip(got.column("doc").to_pylist(), got.column("text").to_pylist(), strict=True):
            out[i] = text.encode("latin-1")
        return out


def codec(ranks, merges) -> Codec:
    """A task's codec for a vocabulary; idle workers keep none."""
    return Codec(ranks, pa.ipc.open_stream(merges).read_all())


def _shipped(spark, path: str):
    ranks = load_ranks(path)
    sink = pa.BufferOutputStream()
    merges = merge_table(ranks)
    with pa.ipc.new_stream(sink, merges.schema) as w:
        w.write_table(merges)
    return spark.sparkContext.broadcast((ranks, sink.getvalue().to_pybytes()))


RUN_BYTES = 1 << 18


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", digests: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>), or the digests of ids and of the decoded bytes.

    With ``digests`` the columns are n_tokens, ids_sha256 (decimal ids joined by
    commas) and decoded_sha256 (bytes decoded from the ids again).  A null text
    is empty and has no ids.  All other columns pass through; a column of an
    added name is replaced.  Empty tables stay empty.  A decoded text that
    differs from the text raises, as no word may be taken for another.
    """
    small_batches(docs.sparkSession)
    sent = _shipped(docs.sparkSession, path)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else [ids_col]
    kept = [c for c in docs.columns if c not in added]
    at = docs.columns.index(text_col)
    passed = [docs.columns.index(c) for c in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f", `{ids_col}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*sent.value)
        for batch in batches:
            buf, off = K.utf8(batch.column(at))
            for i, j, part, o in K.runs(buf, off, RUN_BYTES):
                ids, bounds = c.encode(part, o)
                same = [batch.column(k).slice(i, j - i) for k in passed]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                if not digests:
                    yield pa.RecordBatch.from_arrays([*same, lists], names=[*kept, ids_col])
                    continue
                decoded = c.decode(ids, bounds)
                if b"".join(decoded) != part.tobytes():
                    raise ValueError("decoded texts differ from the texts")
                spelled = pc.binary_join(
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()).cast(pa.string())), ","
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *same,
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in spelled], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    ],
                    names=[*kept, *added],
                )
        c.con.close()
        del c
        K.release()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of ids (array<int>) stands for.

    Null ids give null.  An id outside the vocabulary raises.
    """
    sent = _shipped(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c != bytes_col]
    at = encoded.columns.index(ids_col)
    passed = [encoded.columns.index(c) for c in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*[f"`{c}`" for c in kept]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*sent.value)
        top = max(c.ranks.values())
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                lists = [x or [] for x in batch.column(at).to_pylist()]
                ids = np.array([t for x in lists for t in x], np.int32)
                if len(ids) and (ids.min() < 0 or ids.max() > top):
                    raise ValueError("an id is not in the vocabulary")
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                out = c.decode(ids, bounds)
                null = batch.column(at).is_null().to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in passed), pa.array([None if z else x for x, z in zip(out, null, strict=True)], pa.binary())],
                    names=[*kept, bytes_col],
                )
        c.con.close()

    return encoded.mapInArrow(run, f"{schema}, `{bytes_col}` binary")
