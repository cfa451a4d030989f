"""Exact, near, line and passage deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwake.llm import exact, lines, minhash, suffixes
from modelwake.llm.common import Stages, components
from modelwake.session import scratch_path
from tests.llm.conftest import hard_rows, words


def shingles(text, width):
    found = [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not found:
        return set()
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))}


def brute_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs_of, width, percent):
    base = words(5, 150)
    texts = [" ".join(words(i, 80)) for i in range(15)] + [" ".join(base)] * 3
    for i in range(40):  # versions of one text, some near each other only
        version = list(base)
        for k in range(i % 9):
            version[(i * 17 + k * 31) % 150] = f"v{i}.{k}"
        texts.append(" ".join(version).upper() if i % 2 else " ".join(version))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(texts), width, percent).collect()}
    assert got == brute_components(list(enumerate(texts)), width, percent)


def test_near_duplicates_hard_rows(hard, empty):
    rows = minhash.near_duplicates(hard, 3, 85).collect()
    assert len(rows) == len(hard_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (4, 5, 6))
    assert by_id[11].component_id == 7 and not by_id[11].kept and by_id[7].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = minhash.without_near_duplicates(hard, 3, 85)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert minhash.near_duplicates(empty).count() == 0 and minhash.without_near_duplicates(empty).count() == 0


def test_small_tables_are_not_written_by_every_shuffle_partition(spark, monkeypatch):
    """Where nothing merges small partitions, the tables of every round follow their counted rows."""
    from modelwake.llm import mixing

    files, keep = [], Stages.keep

    def counted(self, df):
        stored = keep(self, df)
        files.append(len(stored.inputFiles()))
        return stored

    monkeypatch.setattr(Stages, "keep", counted)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    pick = random.Random(8)
    edges = [(pick.randrange(400), pick.randrange(400)) for _ in range(250)]
    cells = [(s, g, t, pick.randrange(200, 3000)) for s in "abcdefghij" for g in ("en", "de", None) for t in ("t0", "t1", "t2")]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Stages(spark)).collect()}
        assert len(files) > 3 and max(files) == 1
        files.clear()
        frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
        mixing.raked(frame.coalesce(1), {"source": None, "lang": {"en": 0.6}, "topic": None}, 0.5, Stages(spark))
        assert len(files) > 9 and max(files) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    root = {i: i for edge in edges for i in edge}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: root[i] for i in linked}


def test_named_shares_start_no_python(spark):
    """A table made from Python rows would start Python workers of its own in every executor."""
    from modelwake.llm import mixing

    cells = spark.sql("SELECT 's' AS source, lang, 't' AS topic, 100L AS tokens FROM VALUES ('en'), ('de'), (NULL) AS v(lang)")
    create, made = type(spark).createDataFrame, []
    try:
        type(spark).createDataFrame = lambda self, *a, **b: made.append(a) or create(self, *a, **b)
        goals = mixing.margin_goals(cells, 3, "lang", {"en": 0.5, "xx": 0.1}, 150.0, Stages(spark)).collect()
    finally:
        type(spark).createDataFrame = create
    assert not made
    assert {r["_key"]: round(r["_want"], 6) for r in goals} == {"=en": 83.333333, "=de": 33.333333, "": 33.333333}


def test_stored_stages_leave_no_shuffle_files(spark):
    """In shuffle files of the session: a stored table must not leave its own until the driver collects garbage."""
    import time
    from pathlib import Path

    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())

    def files():
        return {p.name for d in folders for p in Path(d).rglob("shuffle_*.data")}

    before = files()
    frame = spark.range(10_000).groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("n"))
    stored = Stages(spark).keep(frame)
    end = time.time() + 30
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert stored.agg(F.sum("n")).first()[0] == frame.agg(F.sum("n")).first()[0] == 49_995_000


def test_min_max_signature_is_unbiased():
    pick = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        union = pick.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = union[:850], union[150:]
        errors.append((minhash.signature(a) == minhash.signature(b)).mean() - 0.7)
    assert abs(np.mean(errors)) < 0.02


def test_exact_duplicates(spark, hard, empty):
    index = exact.DigestIndex(spark, scratch_path(spark, "index"), 4)
    rows = exact.exact_duplicates(hard, index, "one").collect()
    texts = [(r[0], r[1] or "") for r in hard_rows()]
    largest = {t: max((i for i, x in texts if x == t and i is not None), default=None) for _, t in texts}
    size = Counter(t for _, t in texts)
    expected = Counter((i, largest[t], size[t], i == largest[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert Counter(map(tuple, rows)) == expected
    # The same load again, another load of known and new texts, the index opened anew, an empty load.
    assert Counter(map(tuple, exact.exact_duplicates(hard, index, "one").collect())) == expected
    more = spark.createDataFrame([(100, "one"), (101, "fresh"), (102, "fresh")], "doc_id long, text string")
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(more, index, "two").collect()}
    assert again == {100: (11, 1, False), 101: (102, 2, False), 102: (102, 2, True)}
    n = index.rows().count()
    assert exact.exact_duplicates(empty, index, "three").count() == 0 and index.rows().count() == n == len(size) + 1


def test_digest_index_keeps_its_buckets(spark, docs_of):
    docs = docs_of([f"text {i % 50}" for i in range(60)])
    path = scratch_path(spark, "index")
    first = exact.DigestIndex(spark, path, 4)
    assert exact.exact_duplicates(docs, first, "one").where("kept").count() == 50
    first.close()
    # As another session would open it, with other shuffle partitions.
    again = exact.DigestIndex(spark, path)
    assert again.buckets == 4 != int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert exact.exact_duplicates(docs, again, "two").where("kept").count() == 0
    assert exact.exact_duplicates(docs, again, "one").where("kept").count() == 50
    assert again.rows().count() == 50
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, path, 8)
    plain = scratch_path(spark, "plain")
    docs.write.parquet(plain)
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, plain)


def test_two_loads_give_the_rows_of_one(spark, hard, empty):
    one = exact.exact_duplicates(hard, exact.DigestIndex(spark, scratch_path(spark, "index"), 4), "one")
    two = exact.duplicates_by_halves(hard, exact.DigestIndex(spark, scratch_path(spark, "index"), 4))
    assert Counter(map(tuple, two.collect())) == Counter(map(tuple, one.collect()))
    assert exact.duplicates_by_halves(empty, exact.DigestIndex(spark, scratch_path(spark, "index"), 4)).count() == 0


def test_line_dedup(docs_of, hard, empty):
    shared = "All rights reserved here"
    texts = [f"{' '.join(words(i, 30, 10**6))}\n{shared}\n\nown line {i}" for i in range(12)]
    copied = "copied text with longerwords inside\nsecond copied line"
    texts += [copied] * 8 + [f"local notice\n{i} {' '.join(words(i, 9, 10**6))}" for i in range(100, 108)]
    sources = [f"s{i % 6}" for i in range(20)] + ["one site"] * 8
    got = {r.doc_id: r for r in lines.line_dedup(docs_of(texts, sources=sources)).collect()}
    for i, text in enumerate(texts):
        assert got[i].text == (text.replace(shared + "\n", "") if i < 12 else text)
        assert got[i].n_removed == (1 if i < 12 else 0) and got[i].n_lines == text.count("\n") + 1
    rows = lines.line_dedup(hard).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in hard_rows())
    assert lines.without_boilerplate(hard).columns == hard.columns
    assert lines.line_dedup(empty).count() == 0


def test_near_threshold_lines_are_counted_exactly(docs_of):
    texts, sources = [], []
    for line, spread in (("on four sites", 4), ("on five sites", 5), ("on six sites", 6)):
        for i in range(12):
            texts.append(f"{line}\n{' '.join(words(hash((spread, i)) % 10**6, 12, 10**7))} tail")
            sources.append(f"s{i % spread}")
    spread = lines.line_spread(docs_of(texts, sources=sources)).collect()
    assert sorted((r.n_docs, r.n_sites, r.boilerplate) for r in spread) == [(12, 5, True), (12, 6, True)]


def test_boilerplate_with_a_common_long_word_is_removed(docs_of):
    # Every hash of the long words may be the smallest: all texts share the same few of them.
    shared = "Considerably longwordnotice everywhere"
    texts = [f"{shared}\nown {i} {' '.join(words(i, 9, 10**6))}" for i in range(40)]
    texts += ["copied wholesale paragraph\nwith another line"] * 30
    got = lines.line_dedup(docs_of(texts, sources=[f"s{i % 10}" for i in range(70)])).collect()
    assert sorted((r.n_removed, "copied" in r.text) for r in got) == [(0, True)] * 30 + [(1, False)] * 40
    spread = lines.line_spread(docs_of(texts, sources=[f"s{i % 10}" for i in range(70)])).collect()
    assert sorted((r.n_docs, r.n_sites, r.n_carriers, r.boilerplate) for r in spread) == [(30, 10, 1, False), (30, 10, 1, False), (40, 10, 40, True)]


def test_repeated_passages(docs_of, hard, empty):
    passage = " ".join(words(77, 60, 10**6))
    exactly = " ".join(words(78, 50, 10**6))
    short = " ".join(words(79, 49, 10**6))
    texts = []
    for i in range(30):
        inner = {0: passage, 1: exactly, 2: short}[i % 3]
        texts.append(f"{' '.join(words(1000 + i, 70, 10**6))} {inner}\n{' '.join(words(2000 + i, i * 5, 10**6))}")
    texts += [texts[4]] * 2 + ["a " * 500, "b " * 49]
    seen = defaultdict(int)
    split = [t.lower().split() for t in texts]
    for ws in split:
        for k in range(len(ws) - 49):
            seen[tuple(ws[k : k + 50])] += 1
    expected = {}
    for i, ws in enumerate(split):
        marked = set()
        for k in range(len(ws) - 49):
            if seen[tuple(ws[k : k + 50])] > 1:
                marked.update(range(k, k + 50))
        if marked:
            expected[i] = marked
    got = defaultdict(set)
    firsts = defaultdict(list)
    for r in suffixes.repeated_passages(docs_of(texts)).collect():
        spans = [m.span() for m in re.finditer(r"\S+", texts[r.doc_id])]
        got[r.doc_id].update(k for k, (a, b) in enumerate(spans) if a >= r.start and b <= r.end)
        firsts[r.first].append(r.doc_id)
    assert dict(got) == expected
    assert 0 in firsts[True] and 3 in firsts[False]
    rows = suffixes.repeated_passages(hard).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and suffixes.repeated_passages(empty).count() == 0


def test_sorted_neighbours_equal_all_pairs(spark, docs_of):
    """Every matched suffix with the most words it shares with any other, also over the borders of ranges."""
    hot = " ".join(words(70, 90, 10**6))
    texts = [f"{' '.join(words(100 + i, 3 * i, 10**6))} {hot} {' '.join(words(300 + i % 4, 60, 10**6))}" for i in range(40)]
    texts += [" ".join(words(900 + i, 200, 10**6)) for i in range(20)]
    stages = Stages(spark)
    docs = docs_of(texts).selectExpr("doc_id", "xxhash64(text) AS h", "text")
    found = stages.keep(docs.union(docs).mapInArrow(suffixes._suffixes, "suffix binary, doc_id long, h long, place int"))
    keys = {(r.doc_id, r.place): bytes(r.suffix) for r in found.collect()}
    ranked = sorted((key, place) for place, key in keys.items())

    def shared(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))

    expected = {}
    for key, place in ranked:
        most = max(shared(key, other) for other, at in ranked if at != place)
        if most >= suffixes.PREFIX:
            expected[place] = most
    assert len(expected) > 100
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffixes.matched_suffixes(found, stages).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {(r.doc_id, r.place): r.common for r in got} == expected and len(got) == len(expected)


def test_very_many_repeats_in_one_text(docs_of):
    """A text of 400,000 words in which 2,000 passages recur, each apart from the next."""
    parts = [" ".join(words(k, 60, 10**6)) for k in range(2000)]
    long = " ".join(f"{p} {' '.join(words(50_000 + k, 140, 10**6))}" for k, p in enumerate(parts))
    rows = suffixes.repeated_passages(docs_of([long, " ".join(f"{p} gap{k}" for k, p in enumerate(parts))])).collect()
    assert len([r for r in rows if r.doc_id == 0]) == 2000 and all(r.first == (r.doc_id == 0) for r in rows)


def test_line_dedup_equals_brute_force(spark):
    """Random texts over shared lines, with blanks, repeats, copies and nulls, against counting by hand."""
    pick = random.Random(5)
    shared = [f"shared line number {k}" for k in range(60)]
    rows = []
    for i in range(400):
        own = [f"own {i} {k}" for k in range(pick.randrange(3))]
        some = [f"{' ' * pick.randrange(3)}{shared[min(int(pick.expovariate(0.12)), 59)]}{' ' * pick.randrange(2)}" for _ in range(pick.randrange(6))]
        text = own + some + [""] * pick.randrange(2)
        pick.shuffle(text)
        site = None if i % 31 == 0 else f"s{min(int(pick.expovariate(0.3)), 15)}"
        rows.append((i, None if i % 97 == 0 else "\n".join(text), "en", site, 0))
    rows += [(1000 + i, rows[7 + i % 3][1], "en", f"s{i % 12}", 0) for i in range(40)]
    rows += [rows[5], rows[5]]

    sites, carriers = defaultdict(set), defaultdict(set)
    for _, text, _, site, _ in rows:
        kept = {line.strip(" ") for line in (text or "").split("\n")} - {""}
        for line in kept:
            sites[line].add(site)
            carriers[line].add(frozenset(kept))
    gone = {line for line in sites if len(sites[line]) >= 5 and len(carriers[line]) >= 5}
    assert 5 < len(gone) < len([s for s in sites if s.startswith("shared")])
    assert any(len(sites[line]) >= 5 and line not in gone for line in sites)

    def cleaned(text):
        return None if text is None else "\n".join(line for line in text.split("\n") if line.strip(" ") not in gone)

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.line_dedup(docs).collect())
    expected = Counter()
    for i, text, *_ in rows:
        n = 0 if text is None else text.count("\n") + 1
        expected[i, cleaned(text), n, sum(line.strip(" ") in gone for line in (text or "").split("\n"))] += 1
    assert got == expected
