"""Long repeated passages found by recompression.

A text is a sequence of token names. A round names runs of one symbol, then
pairs of a left and a right symbol; the two sides of the alphabet are fixed by
one bit of the symbol's name, and a name is a hash of what it stands for. So
every task gives equal token sequences equal symbols without any exchange,
except at most ``MARGIN`` tokens from either end of the equal part, where a
run or a pair may reach beyond it.

Spark then works through three levels of names:

1. *Anchors*: the symbol boundaries whose following tokens have the smallest
   name in their neighbourhood. Two equal windows hold an equal anchor (see
   ``_anchors``). Their names are counted over all rows; what holds no anchor
   that is met twice is done with.
2. *Spans*: the windows between two anchors of a text form a unit, and the words
   that they cover together are its span. A span met twice proves all windows
   of its units at once.
3. *Windows*: only where a span is met once, mostly at the ends of repeated
   passages, are single windows named and counted, against all windows.

Between the levels only names are shuffled, and filters of bounded size are
broadcast (``bloom``). What a filter lets through by chance is counted on the
next level like all else, so the results are exact at any filter size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.session import discard, reuse

from .bloom import Filter
from .common import as_bytes, mix64, text_runs

WINDOW = 35
# Longest symbol, in tokens, that each round may make.
ROUNDS = (2, 4)
# Tokens at an end of an equal part that the rounds may name differently: a run
# (up to the round's longest symbol) and a pair's one half per round.
MARGIN = sum(2 * longest - 1 for longest in ROUNDS)

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
# Bytes that are part of words; masks of a number's first 0 to 8 bytes in memory.
_IN_WORD = np.array([chr(b) not in " \t\n\v\f\r" for b in range(256)])
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def _anchor_sizes(window: int) -> tuple[int, int]:
    """(reach, anchor): of an equal window the positions MARGIN .. MARGIN +
    reach - 1 are boundaries alike in both places, and the anchor's tokens
    stay in the window."""
    reach = window - 2 * MARGIN + 1
    anchor = min(8, MARGIN)
    if reach < ROUNDS[-1]:
        raise ValueError(f"windows need {2 * MARGIN + ROUNDS[-1] - 1} words at least")
    return reach, anchor


class TokenNames:
    """Names of the words of texts: 64-bit hashes of their bytes, taken eight bytes
    of all words at a time."""

    # Longer words are hashed one by one.
    LONGEST = 256

    def bounds(self, data: bytes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of words of each text; first byte and end of each word in
        ``data``)."""
        inside = _IN_WORD[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, stop = edge[0::2], edge[1::2]
        begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
        return np.diff(np.searchsorted(start, begin)), start, stop

    @staticmethod
    def data(texts: list[bytes]) -> bytes:
        """The texts between spaces; eight bytes may be read from any byte of them."""
        return b"".join([b" ", *(x for t in texts for x in (t, b" ")), b" " * 8])

    def names(self, data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of the words data[start:stop], for arrays of both."""
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        size = stop - start
        name = size.astype(_U) * _U(_BASES[0])
        todo, at = np.flatnonzero(size <= self.LONGEST), 0
        while len(todo):
            part = eight[start[todo] + at] & _FIRST_BYTES[np.minimum(size[todo] - at, 8)]
            name[todo] = mix64(name[todo] ^ part)
            at += 8
            todo = todo[size[todo] > at]
        for i in np.flatnonzero(size > self.LONGEST).tolist():
            name[i] = xxhash.xxh64_intdigest(data[start[i]:stop[i]])
        return name


@cache
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(base))]), dtype=_U)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(pow(base, -1, 1 << 64)))]), dtype=_U)
    return up, down


class Passages:
    """Names of all passages of a token sequence, by prefix sums."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.sums = tokens, {}

    def names(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        """The k-th 64-bit name of tokens[start:stop], for arrays of both."""
        up, down = _powers(1 << max(16, len(self.tokens).bit_length()), _BASES[k])
        if k not in self.sums:
            self.sums[k] = np.concatenate([[_U(0)], np.cumsum(self.tokens * up[:len(self.tokens)], dtype=_U)])
        total = (self.sums[k][stop] - self.sums[k][start]) * down[start]
        return mix64(total + _U(k + 1) * (stop - start).astype(_U))


def _recompress(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Boundary flags: which tokens start a symbol after all rounds. ``doc``
    numbers the text of each token; symbols never reach over texts."""
    start, size = np.arange(len(names)), np.ones(len(names), np.int64)
    for number, longest in enumerate(ROUNDS, 1):
        if not len(names):
            break
        # Runs: equal neighbours become one symbol if it is short enough. Longer
        # runs stay spelled out, so that what lies inside them stays aligned.
        first = np.concatenate([[True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(first)
        count = np.diff(np.concatenate([at, [len(names)]]))
        fits = count * size[at] <= longest
        keep = first | ~np.repeat(fits, count)
        run = np.ones(len(names), np.int64)
        run[at] = np.where(fits, count, 1)
        names = np.where(run > 1, mix64(names + run.astype(_U) * _U(_BASES[0])), names)[keep]
        size = (size * run)[keep]
        start, doc = start[keep], doc[keep]
        # Pairs: a left symbol and the right symbol after it.
        right = (mix64(names + _U(number)) & _U(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1]) & (size[1:] + size[:-1] <= longest)
        head = np.concatenate([pair, [False]])
        second = np.concatenate([[False], pair])
        joined = names.copy()
        joined[head] = mix64(names[head] * _U(_BASES[1]) + mix64(names[second]))
        size = np.where(head, size + np.roll(size, -1), size)[~second]
        names, start, doc = joined[~second], start[~second], doc[~second]
    return start


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum or maximum of values[i:i + width] for every i (shorter at the end)."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.concatenate([least(out[:-step], out[step:]), out[-step:]])
        have += step
    return out


def _anchors(tokens: np.ndarray, doc: np.ndarray, text_end: np.ndarray, passages: Passages,
             window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, name) of the anchors: boundaries whose name is the smallest
    among the boundaries of some ``reach`` consecutive positions.

    Two equal windows have the same boundaries at the ``reach`` positions after
    the first MARGIN ones, one at least as no symbol is longer than the reach,
    and the same names there; so the smallest is an anchor in both."""
    reach, anchor = _anchor_sizes(window)
    at = _recompress(tokens, doc)
    at = at[at + anchor <= text_end[at]]
    name = np.minimum(passages.names(at, at + anchor), _TOP - _U(1))
    # Texts lie a reach apart, so what is chosen depends on a text's own words only.
    place = at + reach * (doc[at] + 1)
    rank = np.full(len(tokens) + reach * (int(doc[-1]) + 2 if len(doc) else 1), _TOP)
    rank[place] = name
    low = _sliding(rank, reach, np.minimum)
    best = _sliding(np.where(low == _TOP, _U(0), low), reach, np.maximum)
    chosen = best[place - reach + 1] == name
    return at[chosen], name[chosen]


class Run:
    """The tokens of several texts, end to end."""

    def __init__(self, texts: list[bytes], tokens: TokenNames, window: int):
        data = tokens.data(texts)
        self.n_words, start, stop = tokens.bounds(data, texts)
        used = self.n_words >= window
        word = np.repeat(used, self.n_words)
        self.tokens = tokens.names(data, start[word], stop[word])
        size = np.where(used, self.n_words, 0)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.doc = np.repeat(np.arange(len(texts)), size)
        self.passages = Passages(self.tokens)
        self.at, self.name = _anchors(self.tokens, self.doc, self.end[self.doc], self.passages, window)


    def units(self, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) starts of the windows that hold a shared anchor, cut at
        all anchors and at the ends of texts, so that copies are cut alike."""
        _, anchor = _anchor_sizes(window)
        at = self.at[shared]
        d = self.doc[at]
        lo, hi = np.maximum(at + anchor - window, self.begin[d]), np.minimum(at, self.end[d] - window)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        wanted = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(wanted, lo, 1)
        np.add.at(wanted, hi + 1, -1)
        wanted = np.cumsum(wanted)[:-1] > 0
        cut = np.zeros(len(self.tokens), bool)
        cut[self.at] = True
        cut[self.begin[self.n_words >= window]] = True
        edge = wanted & (cut | ~np.concatenate([[False], wanted[:-1]]))
        stop = wanted & np.concatenate([edge[1:] | ~wanted[1:], [True]])
        return np.flatnonzero(edge), np.flatnonzero(stop)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] of them) for all i in a row."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _signed(names: np.ndarray) -> pa.Array:
    return pa.array(names.view(np.int64))


def _anchor_names(window: int):
    def run(batches: Iterator[pa.RecordBatch]):
        tokens = TokenNames()
        for _, texts in text_runs(batches):
            names, n = np.unique(Run(texts, tokens, window).name, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(names), pa.array(n > 1)], ["h1", "again"])
    return run


def _span_names(window: int, anchors: Filter):
    """Names of the units' spans (the words that all windows of a unit cover
    together), once per run of texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        tokens = TokenNames()
        for _, texts in text_runs(batches):
            r = Run(texts, tokens, window)
            first, last = r.units(anchors.hits(r.name), window)
            h1, one, n = np.unique(r.passages.names(first, last + window), return_index=True, return_counts=True)
            h2 = r.passages.names(first[one], last[one] + window, 1)
            yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(n > 1)], ["h1", "h2", "again"])
    return run


def _window_names(window: int, anchors: Filter, unproven: Filter):
    """Names of the single windows of units whose span is met once."""
    def run(batches: Iterator[pa.RecordBatch]):
        tokens = TokenNames()
        for _, texts in text_runs(batches):
            r = Run(texts, tokens, window)
            first, last = r.units(anchors.hits(r.name), window)
            open_ = unproven.hits(r.passages.names(first, last + window))
            start = _spread(first[open_], (last - first + 1)[open_])
            yield pa.RecordBatch.from_arrays([_signed(np.unique(r.passages.names(start, start + window)))], ["h1"])
    return run


FOUND = "row long, start int, size int, h1 long, h2 long, known boolean"


def _findings(window: int, anchors: Filter, unproven: Filter, singles: Filter):
    """Intervals of windows proven by their span, or by an equal window in the
    same run of texts (``known``); and the names of the windows that a single
    one may equal: of unproven windows with their place, of proven ones without
    it, once per run of texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        tokens = TokenNames()
        for part, texts in text_runs(batches):
            r = Run(texts, tokens, window)
            first, last = r.units(anchors.hits(r.name), window)
            if not len(first):
                continue
            open_ = unproven.hits(r.passages.names(first, last + window))
            size = last - first + 1
            start = _spread(first, size)
            proven = np.repeat(~open_, size)
            h1 = r.passages.names(start, start + window)
            ask = singles.hits(h1)
            start, proven, h1 = start[ask], proven[ask], h1[ask]
            h2 = r.passages.names(start, start + window, 1)
            _, one, back, n = np.unique(h1, return_index=True, return_inverse=True, return_counts=True)
            known = n[back] > 1
            lead = np.zeros(len(start), bool)
            lead[one] = True
            at = np.concatenate([first[~open_], start[known & ~proven], start[lead | ~known]])
            many = len(at) - int((lead | ~known).sum())
            d = r.doc[at]
            sent = lead | ~known
            # A proven window's place is known already: its name alone goes out, as proof.
            proof = np.concatenate([np.zeros(many, bool), proven[sent]])
            row = pa.array(part.column(0).to_numpy(zero_copy_only=False)[d], mask=proof)
            length = np.concatenate([size[~open_], np.ones(len(at) - int((~open_).sum()), np.int64)])
            none = np.arange(len(at)) < many
            pad = np.zeros(many, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array((at - r.begin[d]).astype(np.int32), mask=proof), pa.array(length.astype(np.int32), mask=proof),
                 pa.array(np.concatenate([pad, h1[sent]]).view(np.int64), mask=none),
                 pa.array(np.concatenate([pad, h2[sent]]).view(np.int64), mask=none),
                 pa.array(np.concatenate([np.ones(many, bool), (known | proven)[sent]]))],
                ["row", "start", "size", "h1", "h2", "known"])
    return run


def _counted(names: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of a table of names, and whether they are met again."""
    return reuse(names.groupBy(*keys).agg((F.max("again") | (F.count("*") > 1)).alias("again")))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, start, size): starts of windows, ``size`` in a row, whose words
    also start elsewhere in ``docs`` (columns ``row`` long, ``text`` binary)."""
    names = _counted(docs.select("text").mapInArrow(_anchor_names(window), "h1 long, again boolean"), "h1")
    anchors = Filter.of(names.where("again").select("h1"))
    spans = _counted(docs.select("text").mapInArrow(_span_names(window, anchors), "h1 long, h2 long, again boolean"),
                     "h1", "h2")
    unproven = Filter.of(spans.where("not again").select("h1"))
    single = reuse(docs.select("text").mapInArrow(_window_names(window, anchors, unproven), "h1 long").distinct())
    singles = Filter.of(single)
    discard(names, spans, single)  # the filters hold what the last pass needs
    found = reuse(docs.select("row", "text").mapInArrow(_findings(window, anchors, unproven, singles), FOUND))
    asked = found.where("h1 is not null")
    met = (asked.groupBy("h1", "h2").agg((F.max("known") | (F.count("*") > 1)).alias("again"))
           .where("again").select("h1", "h2"))
    return (found.where("h1 is null").select("row", "start", "size")
            .unionByName(asked.where("row is not null").join(met, ["h1", "h2"], "left_semi").select("row", "start", "size")))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_runs(batches):
            n_words, removed, kept = [], [], []
            found = part.column(2)
            for i, text in enumerate(texts):
                words = text.split()
                n = len(words)
                stay = words
                if found[i].is_valid:
                    start, size = (x.to_numpy().astype(np.int64) for x in found[i].values.flatten())
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + size + window - 1, -1)
                    stay = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                n_words.append(n)
                removed.append(n - len(stay))
                kept.append(b" ".join(stay).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64())],
                ["id", "kept_text", "n_words", "n_removed"])
    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, kept_text, n_words, n_removed), one row per input row.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D, unchanged. Every
    word covered by a window of ``window`` words whose word sequence also starts
    anywhere else in ``df``, the same text included, is removed; all windows
    are judged on the input. ``kept_text`` joins the other words by one space.

    Null and empty texts and texts of fewer words have no window and lose
    nothing. Repeated rows are each other's repeats; rows with equal id and text
    get equal results, ids may be null. Texts of any length are read whole;
    extra columns are ignored; an empty table gives no rows. Names are 128
    bits wide where they decide.
    """
    docs = df.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("id", "text"))
    hits = (repeated_windows(docs, window).groupBy("row")
            .agg(F.collect_set(F.struct("start", "size")).alias("hits")))
    id_type = docs.schema["id"].dataType.simpleString()
    return (docs.join(hits, "row", "left").select("id", "text", "hits")
            .mapInArrow(_cut(window), f"id {id_type}, kept_text string, n_words long, n_removed long")
            .withColumnRenamed("id", id_col))
