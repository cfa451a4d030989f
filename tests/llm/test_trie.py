"""The prefix trie of conversations against whole sequences in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from modelwake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv_id].append(((turn is not None, turn or 0), role, digest, text))
    whole = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(whole.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        cost = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += cost
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(path), parent, len(convs), children[path], leaves[path], saved[path], digest))
    return sorted(out, key=str)


def held(df, rows):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns[:8] == columns
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == expected(rows)


def conversations(seed, n, spread, most):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(pick.randrange(1, most)):
            rows.append((c * pick.choice([1, 1, 3]), turn, pick.choice(["user", "assistant"]), f"w {'x ' * pick.randrange(spread)}"))
    return rows


@pytest.mark.parametrize(("block", "span", "split"), [(4, 4096, 5_000_000), (3, 7, 5_000_000), (1, 2, 5_000_000), (4, 16, 2)])
def test_nodes_equal_whole_sequences(spark, block, span, split):
    rows = conversations(block, 150, 2, 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    held(trie.prefix_trie(df, block=block, span=span, split_above=split), rows)


def test_one_long_conversation_and_copies(spark):
    rows = [(40, t, "user", f"turn {t}") for t in range(300)]
    rows += [(45, t, "user", f"turn {t}" if t != 250 else "other") for t in range(300)]
    rows += [(c, t, "user", f"turn {t}") for c in range(60, 90) for t in range(5)]
    held(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), span=8), rows)


def test_hard_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (1, 2, "user", "é😀   x"), (None, 0, "user", "lost"), (None, None, None, None),
        (20, 0, "a", "b c"), (20, 0, "a", "a c"), (20, 1, "ab", "c"), (21, 5, "a", "bc"), (22, 1, None, "x " * 50_000), (-3, 0, "a", "b"), (-20, 0, "a", "b"),
        (-23, 7, "q", "r"), (3, 0, "user", "only"), (5, 0, "user", "only"), (5, 1, "user", "two"), (2**62, 0, "user", "\t\n"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("depth", "node", "n_convs", "words", "key", "h", "pos", "digest", "head", "parent", "up"):
        df = df.selectExpr("*", f"'extra' AS {name}")
    held(trie.prefix_trie(df), rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.where("conv_id IS NULL")).count() == 0


def test_conversations_without_turns(spark):
    # Numbers whose start of three turns replaces all of their own, without a first conversation.
    short = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1]
    rows = [(c, 0, "user", "gone") for c in short]
    df = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    held(df, rows)
    assert df.count() == 1
