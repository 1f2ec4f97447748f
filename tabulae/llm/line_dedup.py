"""Line dedup with a once-seen and a twice-seen Bloom filter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulae.session import reuse

from .bloom import Filter, filter_bits, twice_seen
from .common import as_bytes, text_runs

MIN_CHARS = 40
MIN_DOCS = 5

_CONTINUATION = re.compile(rb"[\x80-\xbf]+")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of \\x20 and \\x09-\\x0D with A-Z lower-cased; None
    when it has fewer than ``min_chars`` code points."""
    key = line.strip()
    if len(key) < min_chars or not key.isascii() and len(_CONTINUATION.sub(b"", key)) < min_chars:
        return None
    return key.lower()


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def _check(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 1)


def _doc_keys(text: bytes, min_chars: int) -> dict[int, bytes]:
    """The text's distinct line keys by their 64-bit hash."""
    keys = (line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars)
    return {_hash(k): k for k in keys if k is not None}


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id_col, kept_text, n_lines, n_dropped), one row per input row.

    A text is split at \\n. Lines whose key (see ``line_key``) is found in at
    least ``min_docs`` documents go from all of them but the one with the
    largest id, which keeps all its own; the rest stay, joined by \\n.

    Every task fills a once-seen and a twice-seen Bloom filter with the hashes
    of its lines; the merged twice-seen filter is broadcast (32 MB at most).
    Only hashes that pass it are shuffled, with a second hash beside them, and
    counted exactly; so false positives cost rows, never results.

    Null and empty texts are one empty line, which is too short to go. Rows
    with the same id count as one document and are all treated alike; rows
    with a null id keep all their lines and don't count. Texts of any length
    are read whole; extra columns are ignored; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    known = docs.where("id is not null")
    n_chars = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(n_chars // (4 * min_chars))

    def hashes(batches: Iterator[pa.RecordBatch]):
        for _, texts in text_runs(batches):
            found = [h for t in texts for h in _doc_keys(t, min_chars)]
            if found:
                yield np.array(found, np.uint64)

    seen = Filter(df.sparkSession, twice_seen(known, hashes, bits), bits)

    def suspects(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_runs(batches):
            row, h1, h2 = [], [], []
            for i, t in enumerate(texts):
                keys = _doc_keys(t, min_chars)
                hit = seen.hits(np.fromiter(keys, np.uint64, len(keys)))
                for (h, k), maybe in zip(keys.items(), hit, strict=True):
                    if maybe:
                        row.append(i)
                        h1.append(h)
                        h2.append(_check(k))
            if row:
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(np.array(h1, np.uint64).view(np.int64)),
                     pa.array(np.array(h2, np.uint64).view(np.int64))], ["id", "h1", "h2"])

    # Both are written: the texts are hashed once, and a join with a written
    # aggregate is one whose hot lines adaptive execution splits.
    pairs = reuse(known.mapInArrow(suspects, f"id {id_type}, h1 long, h2 long").distinct())
    common = reuse(pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
                   .where(F.col("n") >= min_docs).drop("n"))
    drops = (pairs.join(common, ["h1", "h2"]).where("id != keeper")
             .groupBy("id").agg(F.collect_set("h1").alias("drop")))

    def cut(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_runs(batches):
            drop = part.column(2)
            kept, lines, dropped = [], [], []
            for i, t in enumerate(texts):
                parts = t.split(b"\n")
                gone = drop[i].as_py()
                stay = parts
                if gone:
                    gone = {h & (1 << 64) - 1 for h in gone}
                    stay = [x for x in parts if (k := line_key(x, min_chars)) is None or _hash(k) not in gone]
                kept.append(b"\n".join(stay).decode())
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                ["id", "kept_text", "n_lines", "n_dropped"])

    joined = docs.join(drops, "id", "left").select("id", "text", "drop")
    return (joined.mapInArrow(cut, f"id {id_type}, kept_text string, n_lines long, n_dropped long")
            .withColumnRenamed("id", id_col))
