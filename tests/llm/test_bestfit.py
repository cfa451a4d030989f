"""Best-fit packing and the bounds that certify it."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from modelwake.llm import bestfit
from modelwake.llm.tokens import Encoder

from .conftest import hard_rows, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def optimum(sizes, capacity):
    """Least number of bins, by trying every placement."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_bounds_hold_for_every_small_case():
    pick = random.Random(1)
    tight = 0
    for _ in range(400):
        capacity = pick.choice([10, 12, 17, 30])
        sizes = [pick.randrange(1, capacity + 1) for _ in range(pick.randrange(1, 9))]
        least = optimum(sizes, capacity)
        bound = bestfit.lower_bound(np.asarray(sizes), capacity)
        ordered = np.sort(np.asarray(sizes))[::-1]
        bins, offsets, fill = bestfit.best_fit(ordered, capacity)
        assert -(-sum(sizes) // capacity) <= bound <= least <= len(fill)
        assert max(fill) <= capacity and sum(fill) == sum(sizes)
        for b in range(len(fill)):
            own = sorted((o, s) for o, s, k in zip(offsets, ordered, bins, strict=True) if k == b)
            assert all(o == sum(s for _, s in own[:i]) for i, (o, _) in enumerate(own))
        tight += bound == least
    assert tight > 360
    # Sizes above a third and above a half need more than their sum.
    assert bestfit.lower_bound(np.asarray([400] * 9)) == 5 and bestfit.lower_bound(np.asarray([600] * 7 + [10])) == 7


def test_best_fit_takes_the_tightest_bin():
    pick = random.Random(4)
    sizes = sorted((pick.randrange(1, 64) for _ in range(500)), reverse=True)
    bins, _, fill = bestfit.best_fit(np.asarray(sizes), 64)
    rooms = []
    for size, own in zip(sizes, bins, strict=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            assert rooms[own] == min(fits)
            rooms[own] -= size
        else:
            assert own == len(rooms)
            rooms.append(64 - size)
    assert [64 - r for r in rooms] == fill.tolist()


def held(pieces, texts, capacity, end_id):
    """All ids once, in place, cut only where the document is longer than a sequence."""
    encode = Tokenizer.from_file(TOKENIZER).encode
    want = Counter()
    for doc_id, text in texts:
        ids = [*encode(text or "", add_special_tokens=False).ids, end_id]
        at, size, piece = 0, (len(ids) - 1) % capacity + 1, 0
        while at < len(ids):
            data = np.asarray(ids[at : at + size], "<u4").tobytes()
            want[doc_id, piece, at, size, zlib.crc32(data)] += 1
            at, size, piece = at + size, capacity, piece + 1
    rows = pieces.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_packing(spark, hard, empty):
    texts = [(r[0], r[1]) for r in hard_rows()]
    held(bestfit.best_fit_pieces(hard, TOKENIZER), texts, 1024, 2)
    held(bestfit.best_fit_pieces(hard.repartition(3), TOKENIZER, capacity=7, per_partition=50), texts, 7, 2)
    with_ids = bestfit.best_fit_pieces(hard, TOKENIZER, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)
    assert bestfit.best_fit_pieces(empty, TOKENIZER).count() == 0
    assert bestfit.certificate(bestfit.best_fit_pieces(empty, TOKENIZER)) == (0, 0)


def test_partitions_exchange_their_gaps(spark):
    pick = random.Random(6)
    texts = [(i, " ".join(words(i, pick.choice([20, 60, 90, 130, 200]), 50))) for i in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    pieces = bestfit.best_fit_pieces(docs, TOKENIZER, per_partition=60)
    used = held(pieces, texts, 1024, 2)
    assert any(s >= 1 << 56 for s in used), "no piece was dealt again"
    bins, bound = bestfit.certificate(pieces)
    assert bins == len(used)
    assert bound <= bins <= bound * 1.02


def test_encoder_equals_the_tokenizer():
    odd = ["", " ", " a", "a  b", "a\n\nB c", "\n" * 500 + "x", "a 　b", "a \x85b", "é 's 't", "'s", "a\n\n c", "<|endoftext|> b", "a\x1c b", "b" * 3000]
    pick = random.Random(3)
    marks = [" ", "a", "B", "1", ".", "'", "s", "\n", "\t", "é", "日", " ", " ", "😀", "-", "\x1f", "\r", " "]
    odd += ["".join(pick.choice(marks) for _ in range(pick.randrange(40))) for _ in range(3000)]
    own = Encoder(TOKENIZER)
    assert own.fast is not None
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(odd, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(odd)] == want
    own.fast = None
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(odd[:100])] == want[:100]
