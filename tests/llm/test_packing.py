"""Best-fit packing against placing documents one by one, and against the library's ids."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kgloom.llm import best_fit_packing as packing
from kgloom.llm.batch_bpe import BatchEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def one_by_one(lengths, size):
    """Rooms of the sequences after best-fit decreasing, the plain way."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        rooms_left = (rooms.pop(k) if k < len(rooms) else size) - n
        bisect.insort(rooms, rooms_left)
    return rooms


@pytest.mark.parametrize("size", [1, 2, 7, 16, 100, 2048])
def test_moves_equal_one_by_one(size):
    for seed in range(30):
        rng = random.Random(seed * 1000 + size)
        low = rng.randint(1, size)
        lengths = [min(size, rng.randint(low, size) if rng.random() < 0.4 else rng.randint(1, max(1, size // 3))) for _ in range(rng.randint(0, 400))]
        moves = packing.best_fit_moves(Counter(lengths), size)
        used: dict = {}
        for length, first, items, each, sequence, at in moves:
            for k in range(items):
                used.setdefault(sequence + k // each, []).append((at + k % each * length, length))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sorted(size - sum(n for _, n in s) for s in used.values()) == one_by_one(lengths, size)
        placed = Counter()
        for length, first, items, *_ in moves:
            assert placed[length] == first
            placed[length] += items
        assert placed == Counter(lengths)


def check(rows, docs, size, end=0):
    """Every piece lies where it should, and the number of sequences is that of best-fit decreasing."""
    lib = Tokenizer.from_file(BPE)
    want, lengths = Counter(), []
    for doc, text in docs:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, end]
        head = len(ids) % size or size
        cuts = [0, *range(head, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
            lengths.append(b - a)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held: dict = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= size
    assert len(held) == len(one_by_one(lengths, size))


def test_query_by_brute_force(spark):
    df = packing.op11_best_fit_packing(spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
                               "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(df.collect(), docs, 2048)


ODD = [(1, None), (2, ""), (None, "null id"), (None, "null id"), (3, "same"), (3, "other"), (4, "  two  spaces \n\n x"), (5, "w" * 50_000),
       (6, " ".join(f"w{k}" for k in range(9_000))), (7, "a<|endoftext|>b"), *((k, "one text many times") for k in range(10, 300))]


@pytest.mark.parametrize("size", [1, 16, 2048])
def test_odd_rows(spark, size):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for c in ("length", "part", "nth", "first", "at", "n", "before"):     # clashing names do no harm
        docs = docs.selectExpr("*", f"'x' as {c}")
    check(packing.pack_documents(docs, BPE, size).collect(), ODD, size)
    assert packing.pack_documents(docs.where("false"), BPE, size).count() == 0


def test_moves_joined_by_shuffle_and_sequences(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    pieces = packing.token_pieces(docs, BPE, 64, keep_ids=True)
    packed = packing.pack(pieces, 64, broadcast_moves=0)
    check(packed.collect(), ODD, 64)
    by_piece = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 256
        mine = sorted(k for k in by_piece if k[0] == r.sequence_id)
        assert bytes(r.ids) == b"".join(bytes(by_piece[k].ids) for k in mine)


def test_batch_encoder_equals_library():
    lib, mine, rng = Tokenizer.from_file(BPE), BatchEncoder(BPE, 0), random.Random(1)
    signs = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", " the", ".", ",", "%%", "<|endoftext|>", " ", "　", "漢", "Ġ", "\x1c", "\x85", ""]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for step in (1, 11, 2000):
        for k in range(0, 2000 if step < 2000 else 6000, step):
            ids, n = mine.encode(pa.array(texts[k:k + step]))
            want = [[*lib.encode(t, add_special_tokens=False).ids, 0] for t in texts[k:k + step]]
            assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
