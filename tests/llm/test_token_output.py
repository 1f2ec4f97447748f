"""Range coder and token files: exact round trips, damage, odd rows."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tabulae.llm import range_coder as rc
from tabulae.llm import token_output as to

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["one", "two", "uniform", "skewed", "repeats", "wide"])
def test_blocks_come_back(kind):
    rng = np.random.default_rng(5)
    x = {"one": np.zeros(700, np.int64), "two": rng.integers(0, 2, 1500), "uniform": rng.integers(0, 3000, 5000),
         "skewed": np.minimum(rng.geometric(0.02, 6000) - 1, 900), "repeats": np.tile(rng.integers(0, 500, 90), 80),
         "wide": rng.integers(0, 70000, 9000)}[kind]
    found, at, counts = to._alphabet(x)
    own = rc.prior(counts)
    for length in (512, 1000):
        blocks = rc.encode(at, own, length)
        back = rc.decode(blocks, own, length)
        assert (back.reshape(-1)[:len(x)] == at).all() and not back.reshape(-1)[len(x):].any()
        # Each block is decoded from itself alone.
        for k in (0, len(blocks) - 1):
            assert (rc.decode([blocks[k]], own, length)[0] == back[k]).all()
    if kind == "repeats":  # contexts are learned: far below the 9 bits of an id
        assert sum(map(len, blocks)) * 8 < 3 * len(x)
    if kind == "uniform":
        assert sum(map(len, blocks)) * 8 < 12.5 * len(x)


def test_improbable_symbols_in_every_place():
    """The least frequencies that the models can give still code right."""
    rng = random.Random(1)
    own = np.array([1 << 14] + [1] * 60000)
    x = np.array([0] * 3000 + [rng.randrange(60001) for _ in range(200)] + [0, 7] * 900 + [60000] * 50)
    assert (rc.decode(rc.encode(x, own, 6000), own, 6000)[0, :len(x)] == x).all()


def test_sections_and_damage():
    rng = random.Random(2)
    ids = np.array([rng.choice([2, 5, 9, 40000, 3]) for _ in range(1700)], np.int32)
    docs = [(None, 100), (-5, 600), (2**62, 999), (7, 1)]
    data = to.write_section(3, 1, 50, True, docs, ids)
    s = to.Section(data, 0)
    assert (s.part, s.number, s.before, s.n, s.goes_on, s.docs) == (3, 1, 50, 1700, True, docs)
    assert (s.ids() == ids).all() and (s.ids(1, 2) == ids[512:1024]).all() and s.end == len(data)
    for at in (20, s.table.size * 2, len(data) - 30):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            to.Section(bytes(bad), 0).ids()
    with pytest.raises(ValueError, match="no section"):
        to.Section(b"x" + data, 0)


def test_words_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(to, "MAX_WORDS", 8)
    rng = random.Random(6)
    encoder, t = to.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(30):
        texts = [" ".join(rng.choice(["One", "one,", "ONE.", "two", "x\ty", f"w{rng.randrange(60)}.", ""]) for _ in range(rng.randrange(20)))
                 for _ in range(rng.randrange(1, 4))]
        ids, n = encoder.encode(texts, 2)
        want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
        assert len(encoder.words.numbers) < 80


def test_plain_words_go_to_the_model_together():
    """Same ids as the whole tokenizer's; only other words go through all its steps."""
    rng = random.Random(7)
    encoder, t = to.WordEncoder(PATH), Tokenizer.from_file(PATH)
    whole, steps = [], encoder._whole
    encoder._whole = lambda words: whole.extend(words) or steps(words)
    letters = "abcxyzßéüÿñÉÀßø"
    plain = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) + rng.choice(["", "", ",", ".", "$$$", ")", "...", "!?"])
             for _ in range(3000)]
    odd = ["İx", "ΑΣ", "x'S", "e\u0301a", "u\u0308", "it's.", "<|endoftext|>", "x<|", "|>é", "a<", "\u0958x", "12a", "x_y", "µm", "ª", "x×y", "K", "Å"]
    for texts in ([" ".join(plain)], plain[:500], [" ".join([*plain[:50], *odd])], odd, ["\n".join([*odd, *plain[:20]]), "", " ", "\n"]):
        ids, n = encoder.encode(texts, 2)
        want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    assert len(encoder.pieces.numbers) > 2000 and len(whole) < 100


def test_blocks_longer_than_their_place_and_bad_ends():
    """Digits beyond the place set aside, carries, and blocks cut short."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 60000, 4000), np.zeros(4000, np.int64)])
    own = rc.prior(np.bincount(x, minlength=60001))
    blocks = rc.encode(x, own, 2000)
    back = rc.decode(blocks, own, 2000)
    assert (back.reshape(-1) == x).all()
    short = [blocks[0][:-600], *blocks[1:]]
    try:
        other = rc.decode(short, own, 2000)
    except (ValueError, IndexError):
        return
    assert (other[1:] == back[1:]).all() and (other[0] != back[0]).any()


def expected(rows):
    t = Tokenizer.from_file(PATH)
    out = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in rows]
    return [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes()), np.array(i, "<u4").tobytes()) for d, i in out]


def test_files_hold_the_tokenizer_s_ids(spark, tmpdir_path, monkeypatch):
    rng = random.Random(4)
    letters = "abcXYZ019 \n\t\r\x0b\x0c  ́éßΣς'#$.,!?<|>汉字😀‍"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))) for i in range(60, 0, -1)]
    rows += [(61, None), (62, ""), (63, "<|endoftext|> it's we'LL <|startoftext|>x"), (64, "word " * 60000), (65, "x" * 5000),
             (-9, "Negative, A.B., x.,y.. it'S. <|ENDOFTEXT|>, É, KΣ. Σ,"), (10**17, "large"), (None, "no id"), (7, rows[0][1]), (7, rows[0][1])]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, ids string, start int").repartition(4)
    monkeypatch.setattr(to, "RUN_BYTES", 1 << 14)  # the long text comes in pieces
    to.write_token_files(df, f"{tmpdir_path}/out", PATH)
    got = sorted(to.read_token_files(spark, f"{tmpdir_path}/out").collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got), key=key) == sorted(expected(rows), key=key)
    files = spark.read.format("binaryFile").load(f"{tmpdir_path}/out").agg(F.sum("length")).first()[0]
    assert files < 4 * sum(r["n_tokens"] for r in got)


def test_documents_over_sections(spark, tmpdir_path):
    """Sections cut anywhere, also in the middle of documents."""
    rng = np.random.default_rng(3)
    sizes = [1, 4, 30, 1, 7, 900, 1, 2]
    ids = rng.integers(0, 50, sum(sizes)).astype(np.int32)
    for step in (7, 31, 500):
        left, data, at, number, goes = [[k, n] for k, n in enumerate(sizes)], b"", 0, 0, False
        while at < len(ids):
            take = room = min(step, len(ids) - at)
            docs, first = [], goes
            while room:
                k, n = left[0]
                docs.append((k, min(n, room)))
                room -= docs[-1][1]
                goes = n > docs[-1][1]
                left[0][1] -= docs[-1][1]
                if not goes:
                    left.pop(0)
            data += to.write_section(0, number, at, first, docs, ids[at:at + take]) + b"\n"
            at, number = at + take, number + 1
        got = [x for b in to._documents(data, True) for x in b.to_pylist()]
        ends = np.cumsum(sizes)
        assert [(x["doc_id"], x["start"], x["n_tokens"]) for x in got] == [(k, ends[k] - n, n) for k, n in enumerate(sizes)]
        assert b"".join(x["ids"] for x in got) == ids.astype("<u4").tobytes()
        assert [x["ids_crc32"] for x in got] == [zlib.crc32(x["ids"]) for x in got]


def test_empty_table_and_other_tokenizers(spark, tmpdir_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    to.write_token_files(df, f"{tmpdir_path}/none", PATH)
    assert to.read_token_files(spark, f"{tmpdir_path}/none").count() == 0
    with pytest.raises(ValueError, match="word by word"):
        to.write_token_files(df, f"{tmpdir_path}/other", public_tokenizers.path("byte_bpe_50k.json"))
