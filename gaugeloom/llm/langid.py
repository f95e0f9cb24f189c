"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled
text.  A text is parsed greedily against each automaton into longest matches;
the language that needs the fewest phrases, normalised by the size of its
sample, wins.  Only bytes of the text are inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import remainder, small_batches

#: Bound of the training sample: so many passages a language, so many characters each.
SAMPLE_ROWS, SAMPLE_CHARS = 160, 600
#: Texts are parsed in segments of so many symbols side by side; phrases run on over their borders.
SEGMENT = 256
#: Segments stepped together, and rounds of that before the rest is walked one by one.
LANES, ROUNDS = 1 << 12, 4
#: Bytes of text whose segments are parsed side by side.
RUN = 1 << 20

#: a-z (A-Z folded), and every byte of a multi-byte character; all else is a gap.
_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = np.arange(1, 27)
_FOLD[65:91] = np.arange(1, 27)
_FOLD[128:256] = np.arange(27, 155)
_SYMBOLS = 155


def fold(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text, runs of gaps as one symbol 0; and which bytes stay."""
    sym = _FOLD[buf]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    return sym, keep


class Transitions(NamedTuple):
    """(state, symbol) -> state, 0 if none; state 1 is the root.

    Most states have one transition only: those are kept as a symbol and a
    target, and only the others take a dense row.
    """

    width: int
    row: np.ndarray
    dense: np.ndarray
    symbol: np.ndarray
    target: np.ndarray

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        to = self.dense[self.row[state] + c]
        return to + self.target[state] * (self.symbol[state] == c)

    def advance(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after symbols (-1: one that no sample has), and the phrases that end there."""
        to = self.step(state, np.maximum(c, 0))
        to[c < 0] = 0
        done = np.zeros(len(c), np.uint8)
        miss = np.flatnonzero(to == 0)
        if len(miss):
            # the phrase ends before this symbol, which begins the next one
            done[miss] = state[miss] != 1
            anew = self.step(np.ones(len(miss), np.int64), np.maximum(c[miss], 0))
            anew[c[miss] < 0] = 0
            done[miss] += anew == 0  # a symbol the language never has is a phrase
            to[miss] = np.where(anew == 0, 1, anew)
        return to, done

    def walk(self, state: int, c: int) -> tuple[int, int]:
        """``advance`` of a single state."""
        to = anew = 0
        if c >= 0:
            to = int(self.dense[self.row[state] + c]) or (int(self.target[state]) if self.symbol[state] == c else 0)
            anew = int(self.dense[self.row[1] + c])
        return (to, 0) if to else (anew or 1, (state != 1) + (not anew))


def automaton(text: np.ndarray, symbols: int) -> Transitions:
    """The suffix automaton of a text."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    row, target = np.zeros(len(nxt), np.int32), np.zeros(len(nxt), np.int32)
    symbol = np.full(len(nxt), -1, np.int16)
    many = [s for s, d in enumerate(nxt) if len(d) > 1 or s == 1]
    # row 0 is that of the states without a row
    dense = np.zeros((len(many) + 1, symbols), np.int32)
    for k, s in enumerate(many, 1):
        row[s] = k * symbols
        for c, t in nxt[s].items():
            dense[k, c] = t
    for s, d in enumerate(nxt):
        if len(d) == 1 and s != 1:
            ((symbol[s], target[s]),) = d.items()
    return Transitions(symbols, row, dense.reshape(-1), symbol, target)


class Model:
    """Automata with a shared alphabet; symbols that no sample has are dropped."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = []
        used = np.zeros(_SYMBOLS, bool)
        used[0] = True
        for lang in self.langs:
            sym, keep = fold(np.frombuffer("\n".join(samples[lang]).encode(), np.uint8))
            texts.append(sym[keep])
            used[texts[-1]] = True
        self.column = np.full(_SYMBOLS, -1, np.int32)
        self.column[used] = np.arange(used.sum())
        # only the columns in use: the full alphabet would take three times the memory
        self.tables = [automaton(self.column[t], int(used.sum())) for t in texts]
        sizes = [max(2, len(t)) for t in texts]
        self.weight = np.log2(sizes)

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and score of each text of a run."""
        sym, keep = fold(buf)
        at = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[off]
        column = self.column[sym[keep]].astype(np.int16)
        sizes = np.diff(at)
        bits = np.stack([phrases(table, column, sizes) for table in self.tables], 1) * self.weight
        best = bits.argmin(1)
        # posterior of a source that spends these bits, per phrase of the winner
        least = bits.min(1, keepdims=True)
        odds = np.exp2(-(bits - least) / np.maximum(least, 1e-9) * 16)
        return best, 1 / odds.sum(1)


def phrases(table: Transitions, column: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of each text; the texts of these sizes stand one after another in ``column``.

    Segments are first parsed side by side as if a phrase began with each.  Then
    every segment whose predecessor ends within a phrase is parsed again from
    there, up to the symbol at which it meets its earlier parse; what it changes at
    its end goes to its successor in the next round.  Segments that do not settle
    (long repetitions) are walked in order, so the work is linear in any case.
    """
    pieces = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.cumsum(sizes) - sizes
    begin = start[doc] + part * SEGMENT
    end = np.minimum(begin + SEGMENT, (start + sizes)[doc])
    after = np.zeros(len(column), np.int32)  # the state after each symbol
    ended = np.zeros(len(column), np.uint8)  # the phrases that end at each symbol

    def parse(lanes: np.ndarray, state: np.ndarray, again: bool) -> None:
        order = np.argsort(begin[lanes] - end[lanes], kind="stable")
        pos, last, state = begin[lanes][order], end[lanes][order], state[order]
        while len(pos):
            state, done = table.advance(state, column[pos])
            met = after[pos] == state if again else False
            after[pos], ended[pos] = state, done
            pos = pos + 1
            go = pos < last if not again else (pos < last) & ~met
            if not go.all():
                pos, last, state = pos[go], last[go], state[go]

    used = np.ones(len(doc), np.int64)
    for i in range(0, len(doc), LANES):
        lanes = np.arange(i, min(i + LANES, len(doc)))
        parse(lanes, used[lanes], False)
    follow = np.flatnonzero(part)
    for _ in range(ROUNDS):
        want = after[begin[follow] - 1]
        changed = used[follow] != want
        lanes = follow[changed]
        used[lanes] = want[changed]
        for i in range(0, len(lanes), LANES):
            few = lanes[i : i + LANES]
            parse(few, used[few], True)
    if (used[follow] != after[begin[follow] - 1]).any():
        for lane in follow.tolist():
            state = int(after[begin[lane] - 1])
            if state == used[lane]:
                continue
            for pos in range(int(begin[lane]), int(end[lane])):
                state, done = table.walk(state, int(column[pos]))
                met = after[pos] == state
                after[pos], ended[pos] = state, done
                if met:
                    break
    out = np.zeros(len(sizes), np.int64)
    if len(doc):
        np.add.at(out, doc, np.add.reduceat(ended, begin, dtype=np.int64))
        filled = np.flatnonzero(sizes)
        out[filled] += after[(start + sizes)[filled] - 1] != 1  # the phrase that the text's end ends
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Fits the automata on training rows: crc32(id) mod 5 is not 0, label not null.

    The texts are cut into passages of ``SAMPLE_CHARS`` characters, and about
    ``SAMPLE_ROWS`` passages a language are taken out of all, by a hash of the id
    and the place; the number of languages is that of the labels.  None if there
    is no such row.
    """
    train = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang")
    ).where((F.coalesce(remainder(F.col("id"), 5), F.lit(1)) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    passages = F.ceil(F.length("text") / SAMPLE_CHARS)
    # one count a language; the model has an automaton for each of them anyway
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.sum(passages).alias("n")).collect()}
    if not sizes:
        return None
    n = F.element_at(F.create_map(*[F.lit(x) for item in sizes.items() for x in item]), F.col("lang"))

    def drawn(i: Column) -> Column:
        share = F.xxhash64("id", i, F.lit(7)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
        return share * n < SAMPLE_ROWS

    # the passages of small samples are all taken; repeated ones count once
    places = F.filter(F.sequence(F.lit(0).cast("bigint"), passages - 1), drawn)
    picked = (
        train.select("lang", "text", F.explode(places).alias("i"))
        .select("lang", F.substring("text", (F.col("i") * SAMPLE_CHARS + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
        .distinct()
        .orderBy("lang", "text")
    )
    samples: dict[str, list[str]] = {}
    for row in picked.collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model(samples)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the predicted language and a score from 0 to 1 to every row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  The whole text is parsed.  Ties go to the first language in order.
    Other columns pass through; columns of the added names are replaced.
    """
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]
    if model is None:
        return docs.select(*[f"`{c}`" for c in kept], F.lit("und").alias(lang_col), F.lit(0.0).alias(score_col))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passed = [docs.columns.index(c) for c in kept]
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            column = batch.column(at)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            buf, off = K.utf8(column)
            for i, j, part, o in K.runs(buf, off, RUN):
                best, score = m.score(part, o)
                ok = letters[i:j]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(i, j - i) for k in passed),
                        pa.array(names[np.where(ok, best, len(m.langs))], pa.string()),
                        pa.array(np.where(ok, score, 0.0), pa.float64()),
                    ],
                    names=[*kept, lang_col, score_col],
                )
        K.release()

    return docs.mapInArrow(run, f"{schema}, `{lang_col}` string, `{score_col}` double")
