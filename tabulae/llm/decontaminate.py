"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, as_bytes, text_runs

# Terms of the benchmark that the latent space may have (a bound of what is
# broadcast: terms * RANK floats), its dimensions, and oversampling of the SVD.
MAX_TERMS, RANK, OVERSAMPLE, POWER = 1 << 17, 96, 16, 2
# Items that RANK is for, more of them get the more dimensions, and numbers of a
# space with more than RANK dimensions at most.
RANK_ITEMS, MAX_SPACE = 200, 1 << 25
# Words of a block; passages are runs of blocks, one block apart.
BLOCK = 8
# A candidate's cosine, then the checks' shares.
MIN_COSINE, MIN_COMMON, MIN_ANSWER = 0.45, 0.6, 0.5
# Answer words (times items) looked at together.
MAX_USES = 1 << 17
SEED = 13

# Lower-cases A-Z and turns all but digits, letters and bytes over 127 into spaces.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words without punctuation."""
    return text.translate(_FOLD).split()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def document_counts(docs: DataFrame, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many texts (column ``text``) each of the given terms is found,
    and the number of texts; one partial count per task."""
    given = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]):
        count, n = np.zeros(len(given.value), np.int64), 0
        known = given.value.keys()
        for _, texts in text_runs(batches):
            n += len(texts)
            for t in texts:
                found = known & set(words_of(t))
                np.add.at(count, [given.value[x] for x in found], 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], n))], ["term", "n"])

    rows = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(len(terms), np.int64)
    total = 0
    for r in rows:  # one row per term
        if r["term"] < 0:
            total = r["n"]
        else:
            count[r["term"]] = r["n"]
    return count, total


def _sum_blocks(df: DataFrame, run, width: int, n_terms: int) -> np.ndarray:
    """Sum over tasks of (term, row of ``width`` numbers) as one matrix."""
    rows = df.mapInArrow(run, "term long, x array<double>")
    added = rows.select("term", F.posexplode("x").alias("k", "x")).groupBy("term", "k").agg(F.sum("x").alias("x"))
    out = np.zeros((n_terms, width))
    for batch in added.toArrow().to_batches():
        out[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    return out


def latent_space(passages: DataFrame, terms: dict[bytes, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(terms, rank) right singular vectors of the passages' TF-IDF matrix A
    (rows: column ``text``, scaled to length 1) by randomised SVD: Spark sums
    A'(A X) over the rows for a thin random X, orthonormalised in between."""
    width = min(len(terms), rank + OVERSAMPLE)
    x = np.random.default_rng(SEED).standard_normal((len(terms), width))

    for _ in range(1 + POWER):
        x, _ = np.linalg.qr(x)
        held = passages.sparkSession.sparkContext.broadcast((terms, idf, x))

        def run(batches: Iterator[pa.RecordBatch], held=held):
            terms, idf, x = held.value
            out: dict[int, np.ndarray] = {}
            for _, texts in text_runs(batches):
                for t in texts:
                    at, n = np.unique([terms[w] for w in words_of(t) if w in terms], return_counts=True)
                    at = at.astype(np.int64)
                    row = n * idf[at]
                    if not len(at) or not (norm := np.linalg.norm(row)):
                        continue
                    row = row / norm
                    y = row @ x[at]
                    for k, r in zip(at.tolist(), row, strict=True):
                        out[k] = out.get(k, 0) + r * y
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()),
                                              pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], ["term", "x"])

        x = _sum_blocks(passages, run, width, len(terms))
    u, _, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, :rank]


def space_rank(items: int, terms: int) -> int:
    """Dimensions for a benchmark: with the square root of its items, from
    ``RANK`` up, within ``MAX_SPACE`` numbers."""
    return max(RANK, min(round(RANK * (items / RANK_ITEMS) ** 0.5), MAX_SPACE // terms))


class Index:
    """The benchmark's items in the latent space, with what the checks need."""

    def __init__(self, ids: list[int], words: list[list[bytes]], terms: dict[bytes, int], idf: np.ndarray, space: np.ndarray):
        self.ids, self.words, self.terms = ids, words, terms
        self.space = (idf[:, None] * space).astype(np.float32)
        vectors = np.array([self.space[[terms[w] for w in ws]].sum(axis=0) for ws in words])
        self.items = (vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1))[:, None]).astype(np.float32)
        self.blocks = np.array([max(1, round(len(w) / BLOCK)) for w in words])
        # The answer of an item: its rarest words, a quarter of the distinct ones.
        self.answers = [set(sorted(set(ws), key=lambda w: (-idf[terms[w]], w))[:max(1, len(set(ws)) // 4)]) for ws in words]
        self.n_answers = np.array([len(a) for a in self.answers])
        # Items by answer word: those of term t are users[uses[t]:uses[t + 1]].
        pairs = np.array(sorted((terms[w], k) for k, a in enumerate(self.answers) for w in a), np.int64)
        self.users, self.uses = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))

    def _candidates(self, begin: np.ndarray, block: np.ndarray, term: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(first block of a passage, item) where the passage's surroundings can hold
        ``MIN_ANSWER`` of the item's answer words, in order of the blocks.

        The last check asks for those words anyway, so nothing is lost. Counted are
        the items' answer words block by block (a word once a block), for slices of
        the blocks, so that memory stays bounded however often a word is used."""
        seen = np.unique(np.stack([block, term]), axis=1)
        many = self.uses[seen[1] + 1] - self.uses[seen[1]]
        seen, many = seen[:, many > 0], many[many > 0]
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // MAX_USES)) + 1
        reach = int(self.blocks.max()) + 1
        for lo, hi in zip(*(np.concatenate(x) for x in (([0], seen[0][cuts]), (seen[0][cuts], [n]))), strict=True):
            near = slice(*np.searchsorted(seen[0], (lo - 1, hi + reach + 1)))
            at, count = np.repeat(seen[0][near], many[near]), many[near]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = self.users[np.repeat(self.uses[seen[1][near]], count) + inside]
            # A passage's surroundings: one block before it, one after.
            width = self.blocks[item] + 3
            inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            start = np.repeat(at - self.blocks[item] - 1, width) + inside
            item, at = np.repeat(item, width), np.repeat(at, width)
            start = np.where((start >= lo) & (start < hi), start, -1)
            text_of = np.searchsorted(begin, start, "right")
            good = (start >= 0) & (text_of == np.searchsorted(begin, at, "right"))
            pair, count = np.unique(start[good] * len(self.ids) + item[good], return_counts=True)
            pair = pair[count >= MIN_ANSWER * self.n_answers[pair % len(self.ids)]]
            yield from zip((pair // len(self.ids)).tolist(), (pair % len(self.ids)).tolist(), strict=True)

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, float, float]]:
        """(text, item, common share, answer share) of the verified matches, the
        best passage of each text and item."""
        words = [words_of(t) for t in texts]
        n_blocks = np.array([-(-len(w) // BLOCK) for w in words], np.int64)
        begin = np.cumsum(n_blocks) - n_blocks
        size_of = np.array([len(w) for w in words], np.int64)
        term = np.fromiter(map(self.terms.get, chain.from_iterable(words), repeat(-1)), np.int64, size_of.sum())
        place = np.arange(len(term)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
        block = place // BLOCK + np.repeat(begin, size_of)
        block, term = block[term >= 0], term[term >= 0]
        if not len(block):
            return
        found: dict[tuple[int, int], tuple[float, float]] = {}
        passages: dict[int, tuple[np.ndarray, float]] = {}  # of one start, by size
        last, d = -1, 0
        for s, k in self._candidates(begin, block, term, int(n_blocks.sum())):
            if s != last:
                last, passages = s, {}
                d = int(np.searchsorted(begin, s, "right")) - 1  # the last text that begins there; empty ones have no blocks
            size = int(self.blocks[k])
            if size not in passages:  # a block more than the item: it starts anywhere
                i, j = np.searchsorted(block, (s, min(s + size + 1, begin[d] + n_blocks[d])))
                x = self.space[term[i:j]].sum(axis=0)
                passages[size] = x, float(np.linalg.norm(x))
            x, norm = passages[size]
            if not norm or x @ self.items[k] < MIN_COSINE * norm:
                continue
            at = (s - int(begin[d])) * BLOCK
            part = words[d][max(0, at - BLOCK):at + (size + 2) * BLOCK]
            held = set(part)
            answer = len(self.answers[k] & held) / len(self.answers[k])
            # No common subsequence is longer than the item's words found there.
            if answer < MIN_ANSWER or sum(map(held.__contains__, self.words[k])) < MIN_COMMON * len(self.words[k]):
                continue
            common = common_subsequence(self.words[k], part) / len(self.words[k])
            if common >= MIN_COMMON and found.get((d, k), (0, 0)) < (common, answer):
                found[d, k] = common, answer
        for (d, k), (common, answer) in found.items():
            yield d, k, common, answer


def build_index(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", rank: int | None = None) -> Index | None:
    """Index of the benchmark; None when it has no words. Inverse document
    frequencies are counted over all of ``docs``. The benchmark is the stated
    query set: its items must have at most ``MAX_TERMS`` distinct words."""
    items = [(r[0], words_of(bytes(r[1]))) for r in benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col), as_bytes(F.col(item_text_col))).distinct().orderBy(item_col).limit(MAX_TERMS + 1).collect()]
    items = [(i, w) for i, w in items if w]
    terms = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    if not terms:
        return None
    if len(terms) > MAX_TERMS or len(items) > MAX_TERMS:
        raise ValueError(f"the benchmark has more than {MAX_TERMS} distinct words or items; split it")
    count, n = document_counts(docs.select(as_bytes(F.col(text_col)).alias("text")), terms)
    idf = np.log((n + 1) / (count + 1)) + 1e-3
    if rank is None:
        rank = space_rank(len(items), len(terms))
    space = latent_space(benchmark.select(as_bytes(F.col(item_text_col)).alias("text")), terms, idf, rank)
    return Index([i for i, _ in items], [w for _, w in items], terms, idf, space)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", rank: int | None = None, keep: bool = False) -> DataFrame:
    """(id_col, contaminated, n_items, items, common, answer), one row per row
    of ``docs``; with ``keep`` its other columns too.

    The latent space is that of the benchmark's TF-IDF passages, idf counted
    over all documents. A document's passages, of each item length and one
    block of words apart, are folded in where they can hold ``MIN_ANSWER`` of an
    item's answer words; those at cosine ``MIN_COSINE`` or more
    are candidates. A candidate is a leak when its longest common subsequence with the item's words covers ``MIN_COMMON`` of them, and ``MIN_ANSWER`` of
    the item's answer words (its rarest) are found in it; so changed, missing
    and added words don't hide it. ``items`` lists the leaked items, sorted;
    ``common`` and ``answer`` are the best shares found, 0 without a leak.

    Null, empty and wordless texts and items match nothing. Whole texts are
    read. Repeated rows and null ids pass through; extra columns are ignored
    (with ``keep``, those with the new names are replaced); an empty table gives no rows, an empty benchmark no leaks.
    """
    index = build_index(docs, benchmark, text_col, item_col, item_text_col, rank)
    held = docs.sparkSession.sparkContext.broadcast(index)  # MAX_SPACE numbers at most

    def make():
        def of(texts: list[bytes]) -> list[pa.Array]:
            items: list[list[int]] = [[] for _ in texts]
            best = np.zeros((len(texts), 2))
            for d, k, common, answer in held.value.matches(texts) if held.value else ():
                items[d].append(held.value.ids[k])
                best[d] = np.maximum(best[d], (common, answer))
            return [pa.array([bool(x) for x in items]), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(best[:, 0].copy()), pa.array(best[:, 1].copy())]
        return of

    new = [("contaminated", T.BooleanType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.LongType())),
           ("common", T.DoubleType()), ("answer", T.DoubleType())]
    out = annotate(docs if keep else docs.select(id_col, text_col), text_col, new, make)
    return out if keep else out.select(id_col, *[n for n, _ in new])
