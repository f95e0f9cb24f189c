"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions (the node is the prefix of its bits so
far).  For each node and each context of the last 0..DEPTH bytes the training
corpus gives counts (n0, n1) and a Krichevsky-Trofimov estimate; the weighted
probability of a context mixes its own estimate and the product of its children,
half and half.  A prediction follows the path from the empty context down and
mixes the estimates of all depths with the resulting posterior weights.

All counts and weights are computed by aggregations over the whole training
corpus.  The nodes deeper than ``SHARED`` are worked out in shards of grams that
have their latest ``SHARED`` bytes in common, the others by joins from each depth
to the next.  No node is left out: every distinct gram of the corpus gets its
score in a table.  A block of texts asks for the words and grams that it has, as
one packed list for each shard, and is answered by a list of values in the same
order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import remainder, small_batches, stored

DEPTH = 5
#: A task hands over its counts when it holds more than so many, folded.
HELD = 1_000_000
#: Bytes of text whose grams are counted at once; equal grams fold.
RUN = 4 << 20
#: Characters of text that one block of the scoring join holds, about.
BLOCK_CHARS = 12_000_000
#: Depth down to which nodes are rows of a table; deeper ones stay in their shard.
SHARED = 3
#: Distinct grams of a shard, about.
SHARD_GRAMS = 40_000
#: Blocks that ask one copy of a shard.
ASKED_AT_ONCE = 512
END_BYTE = 10
END_KEY = -1
U64 = np.uint64
#: A gram has 8 * (DEPTH + 1) = 48 bits; the others number the documents of a run.
DOC_BITS = 64 - 8 * (DEPTH + 1)
_SPACED = np.where(K.SPACE, 0x20, K.LOWER).astype(np.uint8)


def stream(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts' token stream, and each document's first.

    The stream has the words, A-Z as a-z, one space between words and one end
    byte.  No word has an end byte.
    """
    # a space follows each text, then each word keeps the one that ends it
    ends = off[1:] + np.arange(len(off) - 1)
    text = np.insert(_SPACED[buf], off[1:], 0x20)
    kept = text != 0x20
    kept[1:] |= kept[:-1].copy()
    sizes = np.add.reduceat(kept, np.append(0, ends[:-1] + 1), dtype=np.int64) if len(ends) else ends
    kept[ends[sizes == 0]] = True
    first = np.concatenate([[0], np.cumsum(np.maximum(sizes, 1))])
    out = text[kept]
    out[first[1:] - 1] = END_BYTE
    return out, first


def tokens(out: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (int64) of a stream and the first token of each document."""
    stops = np.flatnonzero((out == 0x20) | (out == END_BYTE))
    starts = np.append(0, stops + 1)[:-1]
    word = starts < stops
    starts, stops = starts[word], stops[word]
    keys = K.span_hashes(out, starts, stops).view(np.int64)
    keys[keys == END_KEY] = 0
    return keys, np.searchsorted(starts, first)


def codes(out: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(DEPTH+1)-grams of a stream.

    A gram is the context (latest byte lowest) times 256 plus the byte; before
    the first byte stand end bytes.
    """
    padded = np.concatenate([np.full(7, END_BYTE, np.uint8), out])
    code = np.ndarray(len(out), np.dtype(">u8"), padded, strides=(1,)).astype(U64)
    code &= U64((1 << 8 * (DEPTH + 1)) - 1)
    # the first bytes of a document have end bytes instead of what stands before it
    at = first[:-1, None] + np.arange(DEPTH)
    own = at < first[1:, None]
    own_bits = np.broadcast_to(U64(8) * np.arange(1, DEPTH + 1, dtype=U64), at.shape)[own]
    at, low = at[own], (U64(1) << own_bits) - U64(1)
    code[at] = code[at] & low | U64(int.from_bytes(bytes([END_BYTE] * (DEPTH + 1)))) & ~low
    return code


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts' token stream, and each document's first."""
    out, first = stream(buf, off)
    return codes(out, first), first


def _runs(buf: np.ndarray, off: np.ndarray, size: int = K.RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs as of ``K.runs``, whose documents have numbers of DOC_BITS bits."""
    for a in range(0, len(off) - 1, 1 << DOC_BITS):
        some = off[a : a + (1 << DOC_BITS) + 1]
        for i, j, part, o in K.runs(buf[some[0] : some[-1]], some - some[0], size):
            yield a + i, a + j, part, o


def _starts(keys: np.ndarray) -> np.ndarray:
    """The first place of each key in sorted keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


class _Counts:
    """Keys and how often they were added; equal keys of different runs fold once what is held has doubled."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.folded = 0

    def add(self, keys: np.ndarray, times: int = 1) -> None:
        keys.sort()
        at = _starts(keys)
        self.parts.append((keys[at], times * np.diff(np.append(at, len(keys)))))
        self.held += len(at)
        if self.held > max(2 * self.folded, HELD):
            self.fold()

    def fold(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = _starts(keys)
        self.parts = [(keys[at], np.add.reduceat(n[order], at))]
        self.held = self.folded = len(at)

    def take(self, kind: int) -> pa.RecordBatch:
        self.fold()
        keys, n = self.parts[0]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])


class _Distinct:
    """Sorted distinct keys of what was added; equal keys of different runs fold once what is held has doubled."""

    def __init__(self) -> None:
        self.parts, self.held, self.folded = [], 0, 0

    def add(self, keys: np.ndarray) -> None:
        keys.sort()
        self.parts.append(keys[_starts(keys)])
        self.held += len(self.parts[-1])
        if self.held > max(2 * self.folded, HELD):
            self.fold()

    def fold(self) -> np.ndarray:
        if len(self.parts) > 1:
            keys = np.sort(np.concatenate(self.parts))
            self.parts = [keys[_starts(keys)]]
        self.held = self.folded = len(self.parts[0]) if self.parts else 0
        return self.parts[0] if self.parts else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, text) -> (kind, key, n): 0 words and ends, 1 grams.

    Held-out texts only name their grams, 0 times.
    """
    held = (_Counts(), _Counts())
    for batch in batches:
        for out in (False, True):
            buf, off = K.utf8(batch.column(1).filter(pc.equal(batch.column(0), out)))
            for _, _, part, o in K.runs(buf, off, RUN):
                spelled = stream(part, o)
                if not out:
                    words, _ = tokens(*spelled)
                    held[0].add(np.concatenate([words, np.full(len(o) - 1, END_KEY, np.int64)]))
                held[1].add(codes(*spelled).view(np.int64), 0 if out else 1)
                for kind, c in enumerate(held):
                    if c.folded > HELD:
                        yield c.take(kind)
    for kind, c in enumerate(held):
        if c.parts:
            yield c.take(kind)


def _log_gamma(x, log):
    """ln Gamma for x >= 1/2: Stirling's series at x + 6."""
    y = x + 6.0
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _estimate(n0, n1, log=F.log, when=lambda seen, x: F.when(seen, x).otherwise(0.0)):
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones; Columns or arrays."""
    known = _log_gamma(n0 + 0.5, log) + _log_gamma(n1 + 0.5, log) - _log_gamma(n0 + n1 + 1.0, log) - math.log(math.pi)
    return when(n0 + n1 > 0, known)


def _shorter(at: np.ndarray, depth: int) -> np.ndarray:
    """Context and node in one number, with the context's latest ``depth`` bytes only."""
    return at & ((1 << (8 * depth + 8)) - 1)


def _shard(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Grams and counts -> each gram's node for its 8 bits, and the nodes by depth.

    A depth, the deepest first, has (at, n0, n1, lw, stop, up): ``up`` is the
    place of each node's shorter context in the next one.
    """
    sym = key & 255
    at = np.concatenate([key & ~255 | 1 << k | sym >> (8 - k) for k in range(8)])
    times = np.tile(n.astype(np.float64), 8)
    ones = np.concatenate([sym >> (7 - k) & 1 for k in range(8)]) * times
    at, leaf = np.unique(at, return_inverse=True)
    n0, n1 = np.bincount(leaf, times - ones), np.bincount(leaf, ones)
    seen_only = lambda seen, x: np.where(seen, x, 0.0)
    lw, stop, levels = _estimate(n0, n1, np.log, seen_only), np.ones(len(at)), []
    for d in range(DEPTH - 1, SHARED - 1, -1):
        shorter, up = np.unique(_shorter(at, d), return_inverse=True)
        levels.append((at, n0, n1, lw, stop, up))
        at, n0, n1, below = shorter, np.bincount(up, n0), np.bincount(up, n1), np.bincount(up, lw)
        own = _estimate(n0, n1, np.log, seen_only)
        lw = np.logaddexp(own, below) - math.log(2)
        stop = np.exp(own - lw - math.log(2))
    levels.append((at, n0, n1, lw, stop, None))
    return leaf, levels


def _shared_nodes(t: pa.Table) -> pa.Table:
    at, n0, n1, lw, stop, _ = _shard(t.column("key").to_numpy(), t.column("n").to_numpy())[1][-1]
    return pa.table({"ctx": pa.array(at >> 8), "node": pa.array((at & 255).astype(np.int32)), "n0": pa.array(n0), "n1": pa.array(n1), "lw": pa.array(lw), "stop": pa.array(stop)})


def context_tree(sharded: DataFrame) -> list[DataFrame]:
    """Gram counts (shard, key, n) -> for each depth up to SHARED its nodes (ctx, node, n0, n1, stop).

    ``stop`` is the posterior weight of the node's own estimate against its
    children's.  Each depth is one aggregation of the depth below.  Grams that
    count 0 times give nodes of no weight.
    """
    level = sharded.groupBy("shard").applyInArrow(_shared_nodes, "ctx long, node int, n0 double, n1 double, lw double, stop double")
    levels = []
    for d in range(SHARED, -1, -1):
        level = stored(level, f"ctw-{d}")
        levels.append(level.select("ctx", "node", "n0", "n1", "stop"))
        if d:
            up = (
                level.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1)).alias("ctx"), "node")
                .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("below"))
                .withColumn("own", _estimate(F.col("n0"), F.col("n1")))
            )
            top = F.greatest("own", "below")
            up = up.withColumn("lw", top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("below") - top)) - math.log(2))
            level = up.withColumn("stop", F.exp(F.col("own") - F.col("lw") - math.log(2))).select("ctx", "node", "n0", "n1", "lw", "stop")
    return levels[::-1]


def predictions(levels: list[DataFrame]) -> DataFrame:
    """The tree -> (ctx, node, one, left, last) of the nodes at depth SHARED.

    ``one`` gathers the estimates of the path down to a node, ``left`` is the
    weight that its deeper contexts have, and ``last`` the last estimate of a
    context that training saw.
    """
    path = None
    for d, level in enumerate(levels):
        own = F.when(F.col("n0") + F.col("n1") > 0, (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1))
        here = level.select("ctx", "node", own.alias("own"), F.least("stop", F.lit(1.0)).alias("stop"))
        if path is None:
            here = here.withColumns({"one": F.lit(0.0), "left": F.lit(1.0), "last": F.lit(0.5)})
        else:
            path = path.withColumnRenamed("ctx", "shorter")
            here = here.withColumn("shorter", F.col("ctx").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))).join(path, ["shorter", "node"])
        seen = F.col("own").isNotNull()
        path = here.select(
            "ctx",
            "node",
            F.when(seen, F.col("one") + F.col("left") * F.col("stop") * F.col("own")).otherwise(F.col("one")).alias("one"),
            F.when(seen, F.col("left") * (1 - F.col("stop"))).otherwise(F.col("left")).alias("left"),
            F.coalesce("own", "last").alias("last"),
        )
    return path


def _gram_scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's grams (shard, key, n) and paths -> (shard, key, value): log10 probability of the byte."""
    key = left.column("key").to_numpy()
    leaf, levels = _shard(key, left.column("n").to_numpy())
    at = right.column("at").to_numpy()
    order = np.argsort(at)
    place = order[np.searchsorted(at, levels[-1][0], sorter=order)]
    one, rest, last = (right.column(c).to_numpy()[place] for c in ("one", "left", "last"))
    for _, n0, n1, _, stop, up in levels[-2::-1]:
        one, rest, last = one[up], rest[up], last[up]
        seen, own, stop = n0 + n1 > 0, (n1 + 0.5) / (n0 + n1 + 1), np.minimum(stop, 1.0)
        one, rest, last = np.where(seen, one + rest * stop * own, one), np.where(seen, rest * (1 - stop), rest), np.where(seen, own, last)
    p = (one + rest * last)[leaf].reshape(8, -1)
    sym, value = key & 255, np.zeros(len(key))
    for k in range(8):
        value += np.log10(np.where(sym >> (7 - k) & 1, p[k], 1 - p[k]))
    return pa.table({"shard": left.column("shard"), "key": pa.array(key), "value": pa.array(value)})


_SPREAD, _LOW = 2654435761, (1 << 32) - 1


def _gram_shard(key, shards: int, column: bool = False):
    """The shard of a gram by its latest SHARED context bytes; of a Column or an array alike."""
    if column:
        ctx = F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
        return F.shiftright((ctx * F.lit(_SPREAD)).bitwiseAND(F.lit(_LOW)) * F.lit(shards), 32)
    return ((key >> 8 & (1 << 8 * SHARED) - 1) * _SPREAD & _LOW) * shards >> 32


def _word_shard(key, shards: int, column: bool = False):
    """Shards of words are numbered downwards from -1."""
    if column:
        return -1 - F.shiftright(F.shiftright(key, 33).bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(shards), 31)
    return -1 - ((key >> 33 & (1 << 31) - 1) * shards >> 31)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte plane by byte plane."""
    planes = np.diff(keys, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel().cumsum()


def _asked(buf: np.ndarray, off: np.ndarray, shards: int, word_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards and keys of the distinct words and grams of a block, in order of shard and key."""
    found = (_Distinct(), _Distinct())
    found[0].add(np.array([END_KEY], np.int64))
    for _, _, part, o in K.runs(buf, off):
        spelled = stream(part, o)
        found[0].add(tokens(*spelled)[0])
        found[1].add(codes(*spelled).view(np.int64))
    word_keys, gram_keys = (f.fold() for f in found)
    keys = np.concatenate([word_keys, gram_keys])
    shard = np.concatenate([_word_shard(word_keys, word_shards), _gram_shard(gram_keys, shards)])
    # each kind's keys are in order already; 16-bit numbers are sorted by radix
    shard_no = shard + word_shards
    order = np.argsort(shard_no.astype(np.uint16) if shards + word_shards <= 1 << 16 else shard_no, kind="stable")
    return shard[order], keys[order]


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """Requests (shard, block, keys) and a shard's terms (key, value) -> (block, shard, keys, data); unknown keys are 0."""
    order = np.argsort(right.column("key").to_numpy())
    key = np.append(right.column("key").to_numpy()[order], np.iinfo(np.int64).max)
    value = np.append(right.column("value").to_numpy()[order], 0.0)
    data = []
    for asked in left.column("keys"):
        keys = _unpack(asked.as_py())
        at = np.searchsorted(key, keys)
        data.append(np.where(key[at] == keys, value[at], 0.0).tobytes())
    return pa.table({"block": left.column("block"), "shard": left.column("shard"), "keys": left.column("keys"), "data": pa.array(data, pa.binary())})


def gram_scores(counts: DataFrame, shards: int) -> DataFrame:
    """Gram counts (key, n) -> (shard, key, value): log10 probability of each gram's byte after its context."""
    sharded = counts.select(_gram_shard(F.col("key"), shards, True).alias("shard"), "key", "n")
    paths = predictions(context_tree(sharded)).select(
        _gram_shard(F.shiftleft("ctx", 8), shards, True).alias("shard"), F.shiftleft("ctx", 8).bitwiseOR(F.col("node").cast("long")).alias("at"), "one", "left", "last"
    )
    return sharded.groupBy("shard").cogroup(paths.groupBy("shard")).applyInArrow(_gram_scores, "shard long, key long, value double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """One row per document with its code length and a unigram baseline.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and
    bits_per_byte of the token stream.  Documents whose crc32(id) modulo
    ``folds`` is not ``fold`` are learned from (those without id too); all are
    scored over their whole text.  A null or empty text has one token, its end.
    Rows that repeat an id are documents of their own; rows equal in id and text
    are scored once and returned as often as they stand, so however many they are
    no block grows with them.  Nothing learned: the byte probabilities are 1/256
    and the base score 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn(
        "held_out", F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False))
    )
    counted = stored(
        d.select("held_out", "text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")),
        "ctw-counts",
    )
    words = counted.where("kind = 0").select("key", F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_grams = counted.where("kind = 1").count()
    shards, word_shards = (max(1, -(-n // SHARD_GRAMS)) for n in (n_grams, distinct))
    scored = gram_scores(counted.where("kind = 1").select("key", "n"), shards)
    # words with their counts, grams with their scores
    terms = words.select(_word_shard(F.col("key"), word_shards, True).alias("shard"), "key", F.col("c").cast("double").alias("value")).unionByName(scored)
    terms = stored(terms, "ctw-terms")
    floor = math.log10(total + 0.5 * (distinct + 1))
    row = F.xxhash64("doc_id", "text")
    alike = d.groupBy(row.alias("row")).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars"))
    chars, most = alike.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = max(1, -(-chars // BLOCK_CHARS))
    # only a table with repeated rows is shuffled once more, to fold them
    folded = d.groupBy("doc_id", "held_out", "text").agg(F.count("*").alias("times")) if most > 1 else d.withColumn("times", F.lit(1).cast("long"))
    dealt = folded.withColumn("block", F.pmod(row, F.lit(blocks)).cast("int"))

    parts = max(1, -(-blocks // ASKED_AT_ONCE))

    def vocabulary(t: pa.Table) -> pa.Table:
        shard, keys = _asked(*K.utf8(t.column("text")), shards, word_shards)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        packed = [_pack(k) for k in np.split(keys, cuts)]
        block = t.column("block")[0].as_py()
        return pa.table(
            {
                "shard": pa.array(shard[np.append(0, cuts)]),
                "part": pa.array(np.full(len(packed), block % parts, np.int32)),
                "block": pa.array(np.full(len(packed), block, np.int32)),
                "keys": pa.array(packed, pa.binary()),
            }
        )

    requests = dealt.groupBy("block").applyInArrow(vocabulary, "shard long, part int, block int, keys binary")
    copies = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    known = requests.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_answer, "block int, shard long, keys binary, data binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, off = K.utf8(left.column("text"))
        # the answers name their keys, so the block's vocabulary is not gathered again
        asked = [_unpack(k.as_py()) for k in right.column("keys")]
        key = np.concatenate(asked)
        value = np.concatenate([np.frombuffer(x.as_buffer()) for x in right.column("data")])
        is_gram = np.repeat(right.column("shard").to_numpy() >= 0, [len(k) for k in asked])
        index, count = pd.Index(key[~is_gram]), np.append(value[~is_gram], 0)
        order = np.argsort(key[is_gram])
        gram_at, gram_value = key[is_gram][order], value[is_gram][order]
        n_tok, n_known, base, score, size = [], [], [], [], []
        end = count[index.get_indexer([END_KEY])[0]]
        for i, j, part, o in _runs(buf, off):
            spelled = stream(part, o)
            keys, first = tokens(*spelled)
            c = count[index.get_indexer(keys)]
            doc = np.repeat(np.arange(j - i), np.diff(first))
            n_tok.append(np.diff(first) + 1)
            n_known.append(np.bincount(doc, c > 0, j - i).astype(np.int64) + int(end > 0))
            base.append(np.bincount(doc, np.log10(c + 0.5), j - i) + math.log10(end + 0.5) - n_tok[-1] * floor)
            size.append(np.diff(spelled[1]))
            # grams with their documents in the lowest bits: sorted, equal grams stand together and are looked up once
            pairs = codes(*spelled) << U64(DOC_BITS) | np.repeat(np.arange(j - i, dtype=U64), size[-1])
            pairs.sort()
            gram = (pairs >> U64(DOC_BITS)).view(np.int64)
            place = _starts(gram)
            value_of = gram_value[np.searchsorted(gram_at, gram[place])]
            each = np.repeat(value_of, np.diff(np.append(place, len(gram))))
            score.append(np.bincount((pairs & U64((1 << DOC_BITS) - 1)).view(np.int64), each, j - i))
        n_tok, n_known, base, score, size = (np.concatenate(x) if x else np.zeros(0) for x in (n_tok, n_known, base, score, size))
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": left.column("held_out"),
                "times": left.column("times"),
                "n_tokens": pa.array(n_tok.astype(np.int64)),
                "n_known": pa.array(n_known.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n_tok), total, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score / math.log10(2) / np.maximum(size, 1)),
            }
        )

    id_type = d.schema["doc_id"].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        run,
        f"doc_id {id_type}, held_out boolean, times long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )
    if most > 1:
        out = out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.drop("times")
