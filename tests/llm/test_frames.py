"""Seekable frames and fill-in-the-middle outputs."""

import hashlib
import random

import pytest
import zstandard

from modelwake.llm import frames

from .conftest import CLASHING, hard_rows


def expected(doc_id, text):
    """Form, prefix and middle lengths, output, from whole strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def held(df, texts):
    """Rows of an operator against whole strings; ``texts`` by row order of equal ids."""
    got = sorted((repr(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in df.collect())
    want = []
    for doc_id, text in texts:
        form, a, m, out = expected(doc_id, text)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text or "")]
        want.append((repr(doc_id), len(text or ""), form, a, m, *sha))
    key = [(w[0], w[1], w[2], w[3] or 0, w[4] or 0, *w[5:]) for w in want]
    assert [(g[0], g[1], g[2], g[3] or 0, g[4] or 0, *g[5:]) for g in sorted(got, key=str)] == [k for k in sorted(key, key=str)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, frames.FRAME])
def test_outputs_equal_whole_strings(spark, size):
    pick = random.Random(size)
    alphabet = "ab<>PSM é😀日\n\x00"
    texts = ["", None, "<", "<P", "<P>", "x<S>y", "<M", "<S<", "P>", "😀", "é" * 50]
    texts += ["".join(pick.choice(alphabet) for _ in range(pick.randrange(60))) for _ in range(250)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved = frames.fill_in_middle(docs, frame=size)
    held(frames.output_digests(moved), rows)
    forms = {r.doc_id: (r.form, r.output) for r in frames.output_texts(moved).collect()}
    assert all(forms[i] == (expected(i, t)[0], expected(i, t)[3]) for i, t in rows)
    assert {f for f, _ in forms.values()} == {"plain", "psm", "spm"}


def test_hard_rows(hard, empty):
    rows = [(r[0], r[1]) for r in hard_rows()]
    held(frames.output_digests(frames.fill_in_middle(hard, frame=1000)), rows)
    assert set(CLASHING) <= set(hard.columns)
    assert frames.output_digests(frames.fill_in_middle(empty)).count() == 0


def test_only_cut_frames_are_opened(monkeypatch):
    text = "".join(chr(0x4E00 + i % 5000) for i in range(100_000))
    stored = frames.Frames.of(text, 1000)
    assert stored.units[-1] == 100_000 and len(stored.ends) == 100
    assert zstandard.ZstdDecompressor().stream_reader(stored.data, read_across_frames=True).read().decode() == text
    opened = []
    whole = frames.Frames.unpacked
    monkeypatch.setattr(frames.Frames, "unpacked", lambda self, i: opened.append(i) or whole(self, i))
    moved = frames.rearranged(stored, "psm", 12_345, 67_000)
    assert sorted(opened) == [12, 12]
    monkeypatch.undo()
    output = f"<P>{text[:12_345]}<S>{text[67_000:]}<M>{text[12_345:67_000]}"
    assert frames.digests(moved, "psm") == tuple(hashlib.sha256(t.encode()).hexdigest() for t in (output, text))
