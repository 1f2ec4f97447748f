"""Token ids of documents as compressed binary files, and back.

A file is a run of sections, each closed by a line feed. All numbers are
little-endian; a varint has 7 bits a byte, the lowest first.

    section   "TIDS", u32 length of what follows up to the line feed, u32 CRC-32
              of head and table, u32 length of the head, u32 of the table
    head      varints: version 1, part (rising with doc_id), number in the part,
              ids of the part before it, ids, block length, 1 if its first
              document goes on from the section before, documents; then for
              each document (0 or 1 + zigzag doc_id, ids here); then the number of
              different ids, their steps, and their frequencies for order 0
    blocks    a table (u32 bytes, u32 CRC-32 of the ids as u32) for each block of
              ``block length`` ids, then their bytes, as ``range_coder`` gives them

A block needs only its section's head to be decoded. Sections of a part follow
each other in one file.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulae.session import ensure_checkpoint_dir

from . import range_coder
from .common import RUN_BYTES

MAGIC, VERSION = b"TIDS", 1
# Words, and parts of words, whose ids a Python worker keeps.
MAX_WORDS = 1 << 19
# Small letters that are written one way only, and ASCII marks without the
# apostrophe, which starts parts of words such as 's.
LETTERS, MARKS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{LETTERS}]+")
_MARKED = re.compile(f"^([{LETTERS}]+)([{MARKS}]+)$", re.MULTILINE)
_HIGH = re.compile("[^\x00-\xff]")
# Plain words that the tokenizer gets in one text.
TOGETHER = 200


def _numbers(keys: Iterator[str] = iter(())) -> defaultdict[str, int]:
    """Number of each string, ``keys`` first; one not seen before gets the next."""
    known = {key: i for i, key in enumerate(keys)}
    return defaultdict(itertools.count(len(known)).__next__, known)


class _Ids:
    """Ids of numbered strings, one after the other."""

    def __init__(self):
        self.numbers = _numbers()
        self.flat, self.size, self.start, self.uses = (np.zeros(0, np.int64) for _ in range(4))

    def new(self) -> list[str]:
        last_first = list(itertools.islice(reversed(self.numbers), len(self.numbers) - len(self.size)))
        return last_first[::-1]

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
        self.uses = np.append(self.uses, np.zeros(len(size), np.int64))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings ``at``, one after the other; number of ids of each)."""
        size = self.size[at]
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[at] - first, size) + np.arange(int(size.sum()))], size

    def forget(self, most: int) -> None:
        """Of more than ``most`` strings, keep those used more than once, or the
        half that was used most."""
        if len(self.size) <= most:
            return
        stay = self.uses > 1
        if stay.sum() > most // 2:
            stay = self.uses > np.sort(self.uses)[-(most // 2)]
        keys, at = itertools.compress(self.numbers, stay.tolist()), np.flatnonzero(stay)
        (flat, size), kept = self.of(at), _Ids()
        kept.numbers = _numbers(keys)
        kept.add(flat, size)
        self.__dict__ = kept.__dict__


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space between words and
    ignores case, as ``splits_at_spaces`` tells: each different word is encoded
    once and remembered, up to ``MAX_WORDS``. Words that differ in ASCII capitals,
    or in a comma or full stop after a last ASCII letter, share what is
    encoded; words that may hold a special token are encoded as they are.

    Where ``_plain`` finds that the tokenizer takes words of ``LETTERS`` as they
    are, words share what stands before any ``MARKS`` at their end, and words of
    such letters go to the tokenizer's model many at a time, without the
    steps that would leave them unchanged."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.last = _plain(path), None
        if self.plain:
            # A plain word ends at its only token with the suffix.
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(1 + max(vocabulary.values()), bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.words, self.pieces = _Ids(), _Ids()

    @staticmethod
    def _split(word: str) -> list[str]:
        if "<|" in word:
            return [word]
        word = word.lower() if word.isascii() else word.encode().lower().decode()
        if word[-1:] in (",", ".") and "a" <= word[-2:-1] <= "z":
            return [word[:-1], word[-1]]
        return [word]

    def _parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(parts of all words one after the other, number of parts of each);
        a word holds neither a space nor a line feed."""
        text = "\n".join(words)
        if not self.plain or "<|" in text:
            parts = [self._split(w) for w in words]
            return list(itertools.chain.from_iterable(parts)), np.fromiter(map(len, parts), np.int64, len(parts))
        # Capitals of the first 256 characters have one small letter each.
        text = text.lower() if text.isascii() or not _HIGH.search(text) else text.encode().lower().decode()
        text = _MARKED.sub(r"\1 \2", text)
        n = [1 + w.count(" ") for w in text.split("\n")]
        return text.replace("\n", " ").split(" "), np.array(n, np.int64)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, number of ids of each)."""
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, words)), bool, len(words))
        if self.plain is None or not plain.any():
            return self._whole(words)
        some = list(itertools.compress(words, plain.tolist()))
        texts = [" ".join(some[i:i + TOGETHER]) for i in range(0, len(some), TOGETHER)]
        found = [x.ids for x in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        size = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        if len(size) != len(some) or size.sum() != len(flat):
            return self._whole(words)
        if plain.all():
            return flat, size
        rest, n = self._whole(list(itertools.compress(words, (~plain).tolist())))
        both = _Ids()
        both.add(np.append(flat, rest), np.append(size, n))
        return both.of(np.argsort(np.argsort(~plain, kind="stable")))

    def _learn(self) -> None:
        """Encode the words numbered since the last call."""
        parts, n = self._parts(self.words.new())
        at = np.fromiter(map(self.pieces.numbers.__getitem__, parts), np.int64, len(parts))
        if new := self.pieces.new():
            self.pieces.add(*self._encode(new))
        self.pieces.uses += np.bincount(at, minlength=len(self.pieces.uses))
        flat, size = self.pieces.of(at)
        self.words.add(flat, np.add.reduceat(size, np.cumsum(n) - n))

    def encode(self, texts: Sequence[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each closed by ``end_id``;
        number of ids of each)."""
        for known in (self.words, self.pieces):
            known.forget(MAX_WORDS)
        words = pc.split_pattern(pa.array([x.replace("\n", " ") for x in texts], pa.large_string()), " ")
        until, found = words.offsets.to_numpy()[1:], words.values.dictionary_encode()
        names, place = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        at = np.fromiter(map(self.words.numbers.__getitem__, names), np.int64, len(names))
        if len(self.words.numbers) > len(self.words.size):
            self._learn()
        self.words.uses[at] += np.bincount(place, minlength=len(at))
        ids, size = self.words.of(at[place])
        ends = np.concatenate([[0], np.cumsum(size)])[until]
        return np.insert(ids, ends, end_id).astype(np.int32), np.diff(ends, prepend=0) + 1


def _plain(path: str):
    """The tokenizer without the steps before its model, for words of ``LETTERS``
    with a space between them; None if those steps may change or cut such words,
    or join them with ``MARKS``, so that they have to go through all steps."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers
    t = Tokenizer.from_file(path)
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(x: str, by: Tokenizer = t) -> list[int]:
        return by.encode(x, add_special_tokens=False).ids

    letters, marks = (re.findall(f"[{x}]", "".join(map(chr, range(256)))) for x in (LETTERS, MARKS))
    words = [*letters, "".join(letters), "".join(letters[::-1]), *(a + b for a in letters for b in letters)]
    if not getattr(t.model, "end_of_word_suffix", None) or t.model.dropout or t.normalizer is None or t.pre_tokenizer is None:
        return None
    if any(_PLAIN.search(x.content) and not set("<|") <= set(x.content) for x in t.get_added_tokens_decoder().values()):
        return None
    for x in words:
        if (t.normalizer.normalize_str(x) != x
                or [p for p, _ in t.pre_tokenizer.pre_tokenize_str(x)] != [p for p, _ in as_bytes.pre_tokenize_str(x)]):
            return None
    if any(ids(f"{x}{y}") != ids(f"{x}{y}".lower()) for x in map(chr, range(0xC0, 0x100)) for y in ("", "a", "É")):
        return None
    tails = [*marks, *(a + b for a in marks for b in marks if a + b != "<|"), "".join(marks)]
    if any(ids(x + tail) != ids(x) + ids(tail) for x in ("x", "zé") for tail in tails):
        return None
    plain = Tokenizer.from_file(path)
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), as_bytes])
    return plain if ids(" ".join(words), plain) == ids(" ".join(words)) else None


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One a Python worker: its tasks share the tokenizer and the words."""
    return WordEncoder(path)


def splits_at_spaces(path: str) -> bool:
    """True for tokenizers that ``WordEncoder`` may use: texts of two words give
    the words' ids, in any case."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)

    def ids(x: str) -> list[int]:
        return t.encode(x, add_special_tokens=False).ids

    pairs = (("one", "Two"), ("it's", "'s"), ("á", "\u0301b"), ("x1", "2"), ("#", "##"), ("", "end"), ("ΑΣ", "Ω"))
    return (all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for gap in (" ", "\n", " \n ") for a, b in pairs)
            and all(ids(x) == ids(x[:-1]) + ids(x[-1]) for x in ("one.", "x's,", "'re,", "a.b.", "é,a,"))
            and all(ids(x) == ids(x.encode().lower().decode()) for x in ("One", "E\u0301A", "IT'S", "KÉΣ", "Iİ")))


def _varint(out: bytearray, value: int) -> None:
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def varint(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7


def write_section(part: int, number: int, before: int, goes_on: bool, docs: Sequence[tuple[int | None, int]],
                  ids: np.ndarray) -> bytes:
    """A section (without its line feed); ``docs`` are (doc_id, ids here)."""
    found, at, counts = _alphabet(ids)
    own = range_coder.prior(counts)
    length = range_coder.block_length(len(ids))
    blocks = range_coder.encode(at, own, length)
    head = bytearray()
    for x in (VERSION, part, number, before, len(ids), length, int(goes_on), len(docs)):
        _varint(head, x)
    for doc, n in docs:
        _varint(head, 0 if doc is None else 1 + (doc << 1 if doc >= 0 else ~(doc << 1)))
        _varint(head, n)
    _varint(head, len(found))
    for step in np.diff(found, prepend=0).tolist():
        _varint(head, step)
    for x in own.tolist():
        _varint(head, x)
    raw = ids.astype("<u4")
    table = b"".join(struct.pack("<II", len(b), zlib.crc32(raw[k * length:(k + 1) * length])) for k, b in enumerate(blocks))
    check = zlib.crc32(table, zlib.crc32(head))
    body = b"".join([struct.pack("<III", check, len(head), len(table)), bytes(head), table, *blocks])
    return MAGIC + struct.pack("<I", len(body)) + body


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different ids, the place of each id among them, their counts)."""
    if ids.max(initial=0) >= 1 << 24:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    found = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[found] = np.arange(len(found))
    return found, place[ids], counts[found]


class Section:
    """A section's head; ``ids()`` decodes its blocks."""

    def __init__(self, data: bytes, at: int):
        if data[at:at + 4] != MAGIC:
            raise ValueError(f"no section of token ids at byte {at}")
        length, check, n_head, n_table = struct.unpack_from("<IIII", data, at + 4)
        self.end, table = at + 8 + length, at + 20 + n_head
        self.begin = table + n_table
        if self.begin > self.end or self.end > len(data) or zlib.crc32(data[at + 20:self.begin]) != check:
            raise ValueError(f"damaged head of a section of token ids at byte {at}")
        head = _Reader(data, at + 20)
        version, self.part, self.number, self.before, self.n, self.length, goes_on, n_docs = (head.varint() for _ in range(8))
        if version != VERSION:
            raise ValueError(f"token ids of version {version}")
        self.goes_on = bool(goes_on)
        self.docs = []
        for _ in range(n_docs):
            doc, n = head.varint(), head.varint()
            self.docs.append((None if not doc else (doc - 1 >> 1) ^ -(doc - 1 & 1), n))
        n_found = head.varint()
        self.found = np.cumsum([head.varint() for _ in range(n_found)]) if n_found else np.zeros(0, np.int64)
        self.own = np.array([head.varint() for _ in range(n_found)], np.int64)
        self.blocks = n_table // 8
        self.table = np.frombuffer(data, "<u4", 2 * self.blocks, table).reshape(-1, 2).astype(np.int64)
        self.data = data

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last`` (excluded; None: all)."""
        last = self.blocks if last is None else last
        at = self.begin + np.concatenate([[0], np.cumsum(self.table[:, 0])])
        blocks = [self.data[at[k]:at[k + 1]] for k in range(first, last)]
        if not blocks:
            return np.zeros(0, "<u4")
        ids = self.found.astype("<u4").take(range_coder.decode(blocks, self.own, self.length)).reshape(-1)
        ids = ids[:self.n - first * self.length]
        for k in range(first, last):
            part = ids[(k - first) * self.length:(k - first + 1) * self.length]
            if zlib.crc32(part) != self.table[k, 1]:
                raise ValueError(f"block {k} of section {self.number} of part {self.part} is damaged")
        return ids


def sections(data: bytes) -> Iterator[Section]:
    at = 0
    while at < len(data):
        section = Section(data, at)
        yield section
        at = section.end + 1


def _pieces(text: str) -> Iterator[str]:
    """Runs of a text of about ``RUN_BYTES`` characters, cut at spaces."""
    at = 0
    while len(text) - at > RUN_BYTES and (cut := text.find(" ", at + RUN_BYTES)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _encode_run(encoder: WordEncoder, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text); a text longer than a run in pieces."""
    if len(texts) > 1 or len(texts[0]) <= RUN_BYTES:
        return encoder.encode(texts, end_id)
    pieces = [encoder.encode([x], end_id)[0] for x in _pieces(texts[0])]
    ids = np.concatenate([*[x[:-1] for x in pieces[:-1]], pieces[-1]])
    return ids, np.array([len(ids)])


def write_token_files(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 2) -> None:
    """Write the texts' ids to files in the folder ``path``, in ascending order
    of ``id_col`` (a long; nulls first; rows with the same id by their text's
    hash), each text closed by ``end_id``.

    ``tokenizer`` is a file of the tokenizers library that every task can open
    (no special tokens are added). Rows are ranged over as many parts as the
    input has partitions, by id, hash and place in the input, so that rows that
    share an id or a text still spread; a part is one file, written by Spark's
    own writer, hence whole or not at all. Texts are tokenized after that
    shuffle, in runs of bounded size; a section holds ``MAX_SECTION`` ids at most
    and a document may go on in the next.

    Null and empty texts have the end id only. Extra columns are ignored; an
    empty table gives files without sections.
    """
    if not splits_at_spaces(tokenizer):
        raise ValueError(f"{tokenizer} does not encode word by word")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"),
                     F.monotonically_increasing_id().alias("place"), text.alias("text"))
    parts = max(1, df.rdd.getNumPartitions())
    order = [F.col("id").asc_nulls_first(), "h", "place"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        queue: deque[list] = deque()  # [doc_id, ids not yet written]
        held, size, number, before, goes_on = [], 0, 0, 0, False

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            """Sections of the ids held, as long as there are ``least``."""
            nonlocal held, size, number, before, goes_on
            ids, at = np.concatenate([np.zeros(0, np.int32), *held]), 0
            while size >= least:
                take = left = min(size, range_coder.MAX_SECTION)
                docs, continued = [], goes_on
                while left:
                    doc, n = queue[0]
                    docs.append((doc, min(n, left)))
                    goes_on = n > left
                    if goes_on:
                        queue[0][1] = n - left
                    else:
                        queue.popleft()
                    left -= docs[-1][1]
                section = write_section(part, number, before, continued, docs, ids[at:at + take])
                yield pa.RecordBatch.from_arrays([pa.array([section], pa.binary())], ["section"])
                number, before, at, size = number + 1, before + take, at + take, size - take
            held = [ids[at:]]

        for batch in batches:
            for doc_ids, texts in _text_runs(batch):
                ids, ns = _encode_run(encoder, texts, end_id)
                queue.extend(map(list, zip(doc_ids.to_pylist(), ns.tolist(), strict=True)))
                held.append(ids)
                size += len(ids)
                if size >= range_coder.MAX_SECTION:
                    yield from cut(range_coder.MAX_SECTION)
        yield from cut(1)

    written = dealt.mapInArrow(run, "section binary")
    written.select(F.col("section").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _text_runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Runs of rows of about ``RUN_BYTES`` characters: (ids, texts)."""
    start, size, texts = 0, 0, []
    for i, value in enumerate(batch.column(1)):
        text = value.as_py()
        if texts and size + len(text) > RUN_BYTES:
            yield batch.column(0).slice(start, len(texts)), texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.column(0).slice(start, len(texts)), texts


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the files in ``path``: ids of
    all documents before it, its own number of ids, their CRC-32 and the ids
    themselves (both as little-endian unsigned 32-bit integers; left out unless
    ``with_ids``). A damaged head or block is an error.

    A part's place follows from the ids that the parts before it hold: one
    small row a file, added up in one window.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def totals(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [(s.part, s.n) for data in batch.column(0) for s in sections(data.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                                             ["part", "n"])

    def documents(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for data in batch.column(0):
                yield from _documents(data.as_py(), with_ids)

    schema = "part long, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    per_part = files.mapInArrow(totals, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    until = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = per_part.select("part", (until - F.col("n")).alias("offset"))
    docs = files.mapInArrow(documents, schema).join(places, "part")
    return docs.withColumn("start", F.col("start") + F.col("offset")).drop("part", "offset")


def _documents(data: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of one file, a batch per section."""
    held: list = []  # [doc_id, start, ids, CRC-32, pieces] of a document that may go on
    for section in sections(data):
        ids, at, out = section.ids(), 0, []
        for k, (doc, n) in enumerate(section.docs):
            piece = ids[at:at + n]
            if k == 0 and section.goes_on:
                held[2:4] = held[2] + n, zlib.crc32(piece, held[3])
            else:
                if held:
                    out.append(held)
                held = [doc, section.before + at, n, zlib.crc32(piece), []]
            if with_ids:
                held[4].append(piece.tobytes())
            at += n
        if out:
            yield _batch(section.part, out, with_ids)
    if held:
        yield _batch(section.part, [held], with_ids)


def _batch(part: int, docs: list, with_ids: bool) -> pa.RecordBatch:
    doc, start, n, crc, pieces = zip(*docs, strict=True)
    columns = [pa.array([part] * len(doc), pa.int64()), *[pa.array(x, pa.int64()) for x in (doc, start, n, crc)]]
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns, names = [*columns, pa.array([b"".join(x) for x in pieces], pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names)


def roundtrip(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """``write_token_files`` to the shared folder, then ``read_token_files``
    without the ids."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/token_files/{uuid.uuid4().hex}"
    write_token_files(df, path, tokenizer, end_id=end_id)
    return read_token_files(spark, path, with_ids=False)
