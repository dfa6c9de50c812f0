import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from assayer.llm.packing import Encoder, Piece, fill, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a \n\n b\n", "\t\tx\r\n", "don't we'll", "é ü   z", "12 3,4", "\x1c \x85x", "x" * 300, "日本 語。 ", "<|endoftext|>a", " lead", "trail  "]


def test_ids_are_those_of_whole_texts():
    t = Tokenizer.from_file(PATH)
    assert [x[:-1].tolist() for x in Encoder(PATH)(ODD)] == [t.encode(x, add_special_tokens=False).ids for x in ODD]


def test_long_runs_of_white_space():
    t, encode = Tokenizer.from_file(PATH), Encoder(PATH)
    for x in (" " * 2_000_000, "a" + "\n" * 1_500_000 + "b", "x" + "\t\u3000" * 600_000, "a" * 9_000 + " " * 9_999 + "b"):
        assert encode([x])[0][:-1].tolist() == t.encode(x, add_special_tokens=False).ids


def test_round_trip(spark):
    t, rng = Tokenizer.from_file(PATH), np.random.default_rng(1)
    rows = [(i, x) for i, x in enumerate([*ODD, None, "word " * 7000])] + [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], rng.integers(1, 600)))) for i in range(60)]
    got = pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(2), PATH, with_ids=True).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert sum((r.ids for r in mine), []) == ids and all(r.doc_tokens == len(ids) for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in mine)
    full = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist()
        n = sum(r.length for r in s)
        assert n <= 2048
        full += n == 2048
    assert full >= len(seqs) - 2


def test_neighbours_share_a_sequence():
    rng = np.random.default_rng(2)
    pieces = [Piece(i, np.append(rng.integers(100 * (i % 4), 100 * (i % 4) + 60, 256), 1).astype(np.uint32)) for i in range(64)]
    done, left = fill(pieces, 1028)
    same = [len({p.id % 4 for p, _ in s}) == 1 for s in done]
    assert len(done) == 16 and not left and np.mean(same) > 0.9


def test_no_rows(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
