"""Quality, mixing, packing, personal data, URLs, fingerprints and the pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from modelwake.llm import mixing, packing, pii, quality, simhash, urls
from modelwake.llm.common import ARROW_BYTES, Stages
from tests.llm.conftest import hard_rows, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def brute_kneser_ney(texts):
    """Probability of the last of three symbols, straight from the definition."""
    border = "\0"
    grams = Counter()
    for t in texts:
        s = border * 2 + t + border
        grams.update(s[i : i + 3] for i in range(len(s) - 2))
    alphabet = quality.SYMBOLS

    def discounts(counts):
        n = [0] + [sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y is not None else k / 2
            out.append(min(max(d, 0.05), k - 0.05))
        return out

    two, one = Counter(), Counter()
    for g in grams:
        two[g[1:]] += 1
    for g in two:
        one[g[1:]] += 1

    def level(counts, gram, below):
        d = discounts(counts)
        same = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return below
        left = sum(d[min(c, 3) - 1] for c in same.values())
        c = counts.get(gram, 0)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total + left / total * below

    def p(gram):
        return level(grams, gram, level(two, gram[1:], level(one, gram[2:], 1 / alphabet)))

    return p


def test_kneser_ney_equals_definition(spark):
    texts = ["the cat sat on the mat", "the hat that the cat had", "a rat"]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    model = quality.train(df, Stages(spark))
    logs = model.log_probabilities("lang:en")
    code = {c: i + 2 for i, c in enumerate(map(chr, model.alphabet))} | {"\0": quality.BORDER}
    p = brute_kneser_ney(texts)
    for gram in ("the", "cat", "at ", "\0\0t", "th\0", "xyz", "hat", "tac", " ra", "t\0t"):
        a, b, c = (code.get(x, quality.OTHER) for x in gram)
        got = math.exp(logs[(a * quality.SYMBOLS + b) * quality.SYMBOLS + c])
        assert got == pytest.approx(p(gram), rel=1e-4), gram
    assert np.exp(logs.reshape(-1, quality.SYMBOLS)).sum(axis=1) == pytest.approx(1.0, abs=1e-3)


def test_quality_rejects_junk_and_keeps_clean(spark, hard, empty):
    pick = random.Random(3)
    syllables = ["ta", "re", "no", "li", "sa", "me", "du"]

    def clean(n):
        return " ".join("".join(pick.choice(syllables) for _ in range(pick.randrange(1, 4))) for _ in range(n)) + "."

    texts = [clean(pick.randrange(1, 200)) for _ in range(150)] + ["$#%& ".join(clean(30).split()).upper() for _ in range(20)]
    rows = [(i, t, None if i % 10 == 0 else "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, hard.schema.simpleString()[7:-1].split(",kept")[0].replace(":", " "))
    labels = spark.createDataFrame([(i, 1, None) for i in range(120)] + [(160, 0, 0), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged_quality(docs, labels).collect()}
    assert sum(got[i].kept for i in range(150)) >= 148 and not any(got[i].kept for i in range(150, 170))
    assert got[0].model == "*" and got[1].model == "lang:en"
    kept = quality.passing_quality(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    some = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    judged = quality.judged_quality(hard, some).collect()
    assert len(judged) == len(hard_rows()) and all((r.perplexity is None) == (not r.kept and r.n_chars == 0) for r in judged if r.n_chars == 0)
    assert quality.passing_quality(hard, some).columns == hard.columns
    assert quality.judged_quality(empty, some).count() == 0 and quality.passing_quality(empty, some).count() == 0
    with pytest.raises(ValueError, match="trusted"):
        quality.judged_quality(docs, labels.where("quality = 7"))


def test_every_character_and_language_has_a_place_in_the_model(spark):
    script = [chr(0x4E00 + i) for i in range(300)]
    rows = [("zh", "".join(script[i : i + 60])) for i in range(0, 240, 5)] + [(f"l{i}", "abc abd") for i in range(70)]
    model = quality.train(spark.createDataFrame(rows, "lang string, text string"), Stages(spark))
    assert model.models.count() == 72 and model.size >= 290

    def price(text):
        grams, _ = quality._grams([text])
        df = spark.createDataFrame([("lang:zh", int(g)) for g in grams], "model string, gram long")
        return sum(r.price for r in model.prices(df).collect())

    assert price("".join(script[200:203])) < price("".join(script[202:199:-1])) - 3


def test_one_odd_trusted_row_and_repeated_words_do_not_pass(spark):
    pick = random.Random(6)

    def clean():
        return " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 7))) for _ in range(100))

    junk = ["".join(pick.choice("stuvwxyz") for _ in range(450)) for _ in range(3)]
    texts = [clean() for _ in range(80)] + junk + [" ".join([w] * 90) for w in clean().split() if len(w) > 3][:5]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(81)], "doc_id long, quality int")  # 80 is junk
    kept = {r.doc_id for r in quality.passing_quality(docs, labels).collect()}
    assert len(kept & set(range(80))) >= 78 and not kept & set(range(81, 88))


def test_null_and_unknown_languages_keep_clean_documents(spark):
    pick = random.Random(5)

    def clean(letters):
        return " ".join("".join(pick.choice(letters) for _ in range(pick.randrange(2, 7))) for _ in range(pick.randrange(40, 120)))

    rows = [(i, ("en", "de", None, "xx")[i % 4], clean(("abcdef", "ghijkl", "abcdef", "mnopqr")[i % 4])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200) if i % 4 < 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged_quality(docs, labels).collect()}
    assert all(got[i].kept for i in range(200) if i % 4 > 1), [got[i] for i in range(200) if i % 4 > 1 and not got[i].kept]
    assert {got[i].model for i in range(200) if i % 4 > 1} == {"*"} and got[3].limit is None and got[3].perplexity > got[2].limit
    assert {r.doc_id for r in quality.passing_quality(docs, labels).collect()} == {i for i in got if got[i].kept}


def test_trigrams_of_a_large_batch_are_held_a_slice_at_a_time():
    texts = [" ".join(words(i, 600)) for i in range(1500)]
    ids = pa.array(range(len(texts)), pa.int64())
    steps = {quality._distinct: {"h0": ids, "h1": ids, "m": ids}, quality._counted: {"model": pa.array(["lang:en"] * len(texts))}}
    for step, columns in steps.items():
        batch = pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts)})
        tracemalloc.start()
        total = sum(int(np.asarray(part.column("n")).sum()) for part in step(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == sum(len(t) + 1 for t in texts) and peak < 25e6


def test_stored_tables_reach_python_in_batches_of_a_few_megabytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    stages, before = Stages(spark), spark.conf.get(ARROW_BYTES)
    texts = spark.range(8000, numPartitions=1).selectExpr("repeat(cast(id % 10 AS string), 3000) AS text")
    stored = stages.keep(texts.mapInArrow(sizes, "n long, bytes long")).collect()
    assert sum(r.n for r in stored) == 8000 and max(r.bytes for r in stored) < 7e6
    assert spark.conf.get(ARROW_BYTES) == before
    try:
        spark.conf.set(ARROW_BYTES, "1m")
        assert max(r.bytes for r in stages.keep(texts.mapInArrow(sizes, "n long, bytes long")).collect()) < 1.2e6
        assert spark.conf.get(ARROW_BYTES) == "1m"
    finally:
        spark.conf.unset(ARROW_BYTES)


def test_mixing_meets_targets(spark, hard, empty):
    pick = random.Random(4)
    rows = []
    for i in range(3000):
        source = "big" if pick.random() < 0.5 else f"s{pick.randrange(4)}"
        rows.append((i, " ".join(f"longword{pick.randrange(999)}" for _ in range(pick.randrange(5, 60))), pick.choice(["en", "en", "de"]), source, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = {"source": {"big": 0.2}, "lang": {"en": 0.5, "de": 0.5}, "topic": None}
    got = mixing.mixed_sources(docs, targets, 0.3).collect()
    assert len(got) == 3000 and all(0 <= r.probability <= 1 for r in got)
    for margin, goal in (("source", {"big": 0.2, "s1": 0.2}), ("lang", {"en": 0.5, "de": 0.5}), ("topic", {"t0": 0.125})):
        expected, drawn, total = Counter(), Counter(), sum(r.tokens * r.probability for r in got)
        for r in got:
            expected[r[margin]] += r.tokens * r.probability / total
            drawn[r[margin]] += r.tokens * r.kept / total
        for k, share in goal.items():
            assert expected[k] == pytest.approx(share, abs=0.003) and drawn[k] == pytest.approx(share, abs=0.05)
    assert total == pytest.approx(0.3 * sum(r.tokens for r in got), rel=0.01)
    assert {r.tokens for r in got} == {len(r[1].split()) for r in rows}
    kept = {r.doc_id for r in mixing.mixed_documents(docs, targets, 0.3).collect()}
    assert kept == {r.doc_id for r in got if r.kept}
    judged = mixing.mixed_sources(hard).collect()
    assert len(judged) == len(hard_rows())
    twice = [r.kept for r in judged if r.doc_id == 3]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert mixing.mixed_documents(hard).columns == hard.columns
    assert mixing.mixed_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def whole_raking(cells, goals, rounds=400):
    """Weights by scaling every category exactly, by bisection, until nothing moves."""
    x = {c: 0.5 * n for c, n in cells.items()}
    for _ in range(rounds):
        for place, goal in enumerate(goals):
            for key, want in goal.items():
                own = [c for c in cells if c[place] == key]
                low, high = 0.0, 1e9
                for _ in range(100):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(min(cells[c], x[c] * mid) for c in own) < want else (low, mid)
                for c in own:
                    x[c] = min(x[c] * high, 1e9)
    return {c: min(n, x[c]) for c, n in cells.items()}


def test_raking_equals_exact_scaling(spark):
    pick = random.Random(12)
    cells = {(s, g, t): pick.randrange(200, 3000) for s in "abc" for g in ("en", None) for t in ("t0", "t1")}
    cells["d", "en", "t0"], cells["d", None, "t1"], cells["e", "en", "t0"] = 90, 60, 0
    total = sum(cells.values())
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    weights, gaps = mixing.raked(df, {"source": None, "lang": {"en": 0.7}, "topic": None}, 0.4, Stages(spark))
    got = {(r.source, r.lang, r.topic): r.weight for r in weights.collect()}
    size = 0.4 * total
    # Source d holds 150 tokens of its fourth of the mix; a, b and c share the rest.
    goals = [{"d": 150, **{s: (size - 150) / 3 for s in "abc"}}, {"en": 0.7 * size, None: 0.3 * size}, {"t0": size / 2, "t1": size / 2}]
    want = whole_raking({c: n for c, n in cells.items() if n}, goals)
    assert got["e", "en", "t0"] == 0 and all(got[c] == pytest.approx(w, rel=0.03, abs=5) for c, w in want.items())
    table = {(r.margin, r.category): r for r in gaps.collect()}
    assert all(r.got == pytest.approx(r.want, rel=0.002) for r in table.values()) and table["source", "d"].want == 150
    assert table["source", "e"].got == 0 and len(table) == 9


def test_contradicting_margins_report_their_gaps(spark):
    cells = [("a", "en", "t0", 1000), ("b", "de", "t0", 1000), ("b", "en", "t1", 10)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": {"t0": 1.0}}
    weights, gaps = mixing.raked(df, targets, 0.5, Stages(spark))
    assert all(0 <= r.weight <= r.tokens for r in weights.collect())
    off = {(r.margin, r.category): abs(r.got - r.want) for r in gaps.collect()}
    assert max(off.values()) > 100


def test_languages_without_a_target_stay_in_the_mix(spark):
    langs = ["en", "en", "de", "fr", "es", None, "it"]
    rows = [(i, " ".join(f"longword{(i * 31 + k) % 997}" for k in range(20)), langs[i % 7], f"s{i % 3}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed_sources(docs).collect()
    total = sum(r.tokens * r.probability for r in got)
    share = {k: sum(r.tokens * r.probability for r in got if r.lang == k) / total for k in set(langs)}
    assert share[None] == pytest.approx(1 / 7, abs=0.01) and share["it"] == pytest.approx(1 / 7, abs=0.01)
    assert all(r.probability > 0 for r in got) and total == pytest.approx(0.5 * sum(r.tokens for r in got), rel=0.002)
    # A topic that holds less than its share is taken whole, and the others make up for it.
    topics, holds = Counter(), Counter()
    for r in got:
        topics[r.topic] += r.tokens * r.probability
        holds[r.topic] += r.tokens
    scarce = {t for t, n in holds.items() if n < total / 8}
    assert scarce and all(topics[t] == pytest.approx(holds[t], rel=0.002) for t in scarce)
    drawn = Counter(r.lang for r in mixing.mixed_documents(docs).collect())
    assert drawn[None] > 50 and drawn["it"] > 50


def test_packing(spark, hard, empty):
    odd = ["", " a", "a  b", "x \n y", "<|endoftext|> b", "\tq w\x1c z", "don't I'll", "a\u00a0b c", "日本 語", "b" * 3000, "1 2 3.4 $$ %% ", "x.\nY z!"]
    encode = Tokenizer.from_file(TOKENIZER).encode
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(TOKENIZER).encode(odd)] == [encode(t, add_special_tokens=False).ids for t in odd]
    ids = {}
    for r in hard_rows():
        ids.setdefault(r[0], []).append(encode(r[1] or "", add_special_tokens=False).ids + [1])
    pieces = packing.packed_pieces(hard.repartition(3), TOKENIZER, with_ids=True)
    rows = pieces.collect()
    by_sequence = defaultdict(list)
    for r in rows:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert any(len(x) == r.doc_tokens and x[r.start : r.start + r.length] == own for x in ids[r.doc_id])
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or number == len(by_sequence) - 1
    sequences = packing.sequences(pieces).collect()
    assert sum(len(r.ids) for r in sequences) == 4 * sum(r.length for r in rows)
    assert packing.packed_pieces(empty, TOKENIZER).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {
            "email": True, "ip": kind == "ip" and all(int(x) < 256 for x in value.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
        }[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def test_personal_data_equals_regular_expressions(spark, hard, empty):
    texts = [
        "a@b.c%d@e.f x@y q@w-z.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.1.1.0256", "4111 1111 1111 1111, 4111-1111-1111-1111 12 34 5500000000000004",
        "+1 (555) 123-4567 +1+2 +123456789012345678 é😀 +44 20 7946 0958.", "😀 mail a.b+c@d-e.f.g.. z@q.w", "x" * 3000 + "@", "9" * 3000, "a@" + "b." * 20000 + "c",
        "+" + "1" * 20000, "4111 1111  1111 1111 4111111111111111 4111111111111111", "", None, "p@q.r" * 50,
    ]
    pick = random.Random(8)
    texts += ["".join(pick.choice("0123456789 .-+@ab(") for _ in range(300)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        spans = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r.doc_id][:300]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert set(spans) <= set(r.spans.split(",")) or not spans
    assert pii.personal_data(hard).count() == len(hard_rows()) and pii.personal_data(empty).count() == 0


def test_contexts_reveal_unseen_identifiers(spark):
    texts = [f"{' '.join(words(i, 5))} call +1 555 {2000000 + i} now {' '.join(words(i + 99, 5))}" for i in range(30)]
    texts += ["please call 555-9999-1 now or later", "the number 555-9999-2 is no phone", "call me 12345678 times"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert got[30] == "phone:12:22" and got[31] == "" and got[32] == ""


def shapes(value):
    n, plain = sum(c in "0123456789" for c in value), not re.search("[A-Za-z]", value)
    found = {
        "email": "@" in value, "ip": len(re.findall("[.:]", value)) >= 3 and n >= 4,
        "card": plain and 12 <= n <= 19, "phone": plain and 6 <= n <= 15,
    }
    return [k for k in pii.KINDS if found[k]]


def brute_bootstrapping(texts):
    """Added spans by text, straight from the definition."""
    seeds, tokens = [], []
    for t in set(texts):

        def context(start, end):
            left, right = (t[:start].split() or [""])[-1].lower(), (t[end:].split() or [""])[0].lower()
            return [p for p in (f"L {left}", f"R {right}", f"B {left} {right}") if p.split()[1:]]

        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(t))]
        seeds += [(t, k, a, b, context(a, b)) for k, a, b in spans]
        for m in re.finditer(r"\S+", t):
            digits = sum(c in "0123456789" for c in m.group())
            free = all(b <= m.start() or m.end() <= a for _, a, b in spans)
            if free and ("@" in m.group() or digits >= 4):
                tokens.append((t, shapes(m.group()), m.start(), m.end(), context(m.start(), m.end())))
    accepted = {}
    while True:
        own, labelled, weight = Counter(), Counter(), Counter()
        for _, k, _, _, c in seeds:
            for p in c:
                own[p, k] += 1
                labelled[p] += 1
                weight[p, k] += 1
        for t, kinds, a, b, c in tokens:
            for p in c:
                labelled[p] += not kinds
                for k in kinds:
                    weight[p, k] += accepted.get((t, k, a, b), 0)
        confident = {(p, k): w / (w + labelled[p] - own[p, k] + 1) for (p, k), w in weight.items() if w}
        new = {}
        for t, kinds, a, b, c in tokens:
            for k in kinds:
                doubt = 1.0
                for p in c:
                    if confident.get((p, k), 0) >= 0.9:
                        doubt *= 1 - min(confident[p, k], 0.999)
                if 1 - doubt >= 0.9:
                    new[t, k, a, b] = 1 - doubt
        if len(new) == len(accepted):
            break
        accepted = new
    best = {}
    for (t, k, a, b), w in new.items():
        best[t, a, b] = min(best.get((t, a, b), (1, 9)), (-w, pii.KINDS.index(k)))
    return {(t, f"{pii.KINDS[i]}:{a}:{b}") for (t, a, b), (_, i) in best.items()}


def test_bootstrapping_equals_brute_force(spark):
    pick = random.Random(5)
    before, after = ["call", "mail", "host", "pay", "code"], ["now", "soon", "x" * 100, "then"]

    def item():
        # Words lean to a kind, with exceptions, so that patterns of every confidence occur.
        word = pick.choice(before)
        kind = word if pick.random() < 0.97 else pick.choice(before)
        seed = {
            "call": f"+1555{pick.randrange(10**6, 10**7)}", "mail": f"u{pick.randrange(99)}@a.org", "host": f"10.0.{pick.randrange(200)}.{pick.randrange(300)}",
            "pay": f"{pick.randrange(10**12, 10**14)}", "code": f"K{pick.randrange(10**4, 10**6)}",
        }[kind]
        loose = {"call": f"555-{pick.randrange(10**4, 10**9)}", "mail": "me@home", "host": f"::{pick.randrange(10**4)}:1", "pay": "1234567890123", "code": f"Z{pick.randrange(10**4, 10**5)}"}
        return f"{word} {seed if pick.random() < 0.6 else loose[word]} {pick.choice(after)}"

    texts = [" ".join(item() for _ in range(pick.randrange(1, 6))) for _ in range(160)]
    # A word that only accepted tokens support, and whole words beyond 80 characters.
    texts += [f"ring 555-77{i:04} {'y' * 90}a" for i in range(30)] + [f"please call +1555{i + 3000000} {'y' * 90}{'ab'[i % 2]}" for i in range(24)]
    texts += [f"call 555-88{i:04} lastly" for i in range(40)] + ["only 555-991234 lastly", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(texts[r.doc_id], s) for r in pii.personal_data(docs).collect() for s in r.spans.split(",") if s}
    expected = brute_bootstrapping(texts)
    assert got - {(t, s) for t in texts for s in base_spans(t)} == expected
    assert ("only 555-991234 lastly", "phone:5:15") in expected and not any(t.startswith("ring") and t.endswith("b") for t, _ in expected)
    assert {s.split(":")[0] for _, s in expected} >= {"phone", "email"}


def test_thirty_seeds_reveal_many(spark):
    texts = [f"call +1 555 {2000000 + i} now" for i in range(30)] + [f"call 555-9999-{i} later" for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.personal_data(docs).orderBy("doc_id").collect()][30:] == ["phone:5:15"] * 6


def test_a_text_of_very_many_numbers(spark):
    numbers = 200_000
    text = " ".join(f"+1555{1000000 + i}" if i % 2 else f"n{i}" for i in range(numbers))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.personal_data(docs).first()
    spans = row.spans.split(",")
    assert row.n_phone == numbers // 2 == len(spans)
    assert all(text[int(a) : int(b)].startswith("+1555") for _, a, b in (x.split(":") for x in spans[:: 5000]))


def test_urls(spark, empty):
    pages = [
        (1, "https://Blog.NET/x?y#z", None), (2, "http://a.example.net/en/25#top", "<a href='http://good.org/q'>"), (3, "http://a.example.net/de/1", ""),
        (4, "http://www.example.com/de/4", ""), (5, "http://example.com/en/", ""), (6, "ftp://org/fr/", ""), (7, "http://xorg/fr/", ""), (8, None, "x"),
        (9, "no scheme", "<a href=//evil.net>"), (10, "http://net", ""), (11, "a://b://c/d", ""), (12, "http://bad.com/1", '<A HREF="HTTPS://EVIL.net/p">'),
        (12, "http://bad.com/1", '<A HREF="HTTPS://EVIL.net/p">'), (None, "http://good.org/fr/x", None), (13, "http://evil.net/", "<a href='/own'>"),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged_urls(df).collect())
    assert got == Counter({
        (1, "blog.net", "/x", "net/", "block"): 1, (2, "a.example.net", "/en/25", "example.net/en/", "allow"): 1,
        (3, "a.example.net", "/de/1", "net/", "block"): 1, (4, "www.example.com", "/de/4", "example.com/de/", "block"): 1,
        (5, "example.com", "/en/", None, "allow"): 1, (6, "org", "/fr/", "org/fr/", "allow"): 1, (7, "xorg", "/fr/", None, "allow"): 1,
        (8, "", "", None, "allow"): 1, (9, "", "", None, "allow"): 1, (10, "net", "", None, "allow"): 1, (11, "b:", "//c/d", None, "allow"): 1,
        (12, "bad.com", "/1", None, "block"): 2, (None, "good.org", "/fr/x", "org/fr/", "allow"): 1, (13, "evil.net", "/", "net/", "block"): 1,
    })
    assert urls.judged_urls(df.limit(0)).count() == 0


def test_propagation_equals_power_iteration(spark):
    pick = random.Random(2)
    links = {(f"h{pick.randrange(12)}", f"h{pick.randrange(12)}"): pick.randrange(1, 4) for _ in range(40)}
    links = {k: v for k, v in links.items() if k[0] != k[1]}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, links long")
    seeds = {"trust": ["h0", "h3"], "distrust": ["h5"]}
    df = spark.createDataFrame([(h, k) for k, v in seeds.items() for h in v], "host string, kind string")
    got = {r.host: r for r in urls.propagated(edges, df, Stages(spark)).collect()}
    for kind, start in seeds.items():
        flow = {((a, b) if kind == "trust" else (b, a)): n for (a, b), n in links.items()}
        out = Counter()
        for (a, _), n in flow.items():
            out[a] += n
        seed = {h: 1 / len(start) for h in start}
        rank = dict(seed)
        for _ in range(200):
            new = Counter()
            for (a, b), n in flow.items():
                new[b] += urls.DAMPING * rank.get(a, 0) * n / out[a]
            left = 1 - sum(new.values())
            for h, s in seed.items():
                new[h] += left * s
            rank = new
        for h, value in rank.items():
            assert got[h][kind] == pytest.approx(value, abs=1e-4)


def test_fingerprints(spark, docs_of, hard, empty):
    texts = [" ".join(words(i, 90)) for i in range(30)] + [" ".join(words(3, 90))] * 2
    near = words(4, 400)
    texts += [" ".join([*near[:i], f"edit{i}", *near[i:]]) for i in range(0, 400, 40)]
    docs = docs_of(texts)
    rows = {r.doc_id: r for r in simhash.edited_fingerprints(docs).collect()}
    print_of = {i: int(r.fingerprint, 16) for i, r in rows.items()}
    root = {p: p for p in set(print_of.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= simhash.RADIUS:
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for i, p in print_of.items():
        least[find(p)] = min(least[find(p)], i)
    for i, text in enumerate(texts):
        below = texts[i - 1] if i else texts[-1]
        k = len(text) // 3
        edited = text[: len(text) - k] + below[:k]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        differ = (print_of[i] ^ print_of[(i - 1) % len(texts)]).bit_count()
        assert r.near_next == pytest.approx(max(0, math.cos(differ * math.pi / 64)) if differ else 1)
        assert r.class_id == least[find(print_of[i])]
    assert rows[3].fingerprint == rows[30].fingerprint == rows[31].fingerprint
    assert len({rows[i].class_id for i in range(32, 42)}) < 10
    assert sum(r.near_edited > r.near_next for i, r in rows.items() if i < 30) >= 28
    judged = simhash.edited_fingerprints(hard).collect()
    assert Counter(r.doc_id for r in judged) == Counter(r[0] for r in hard_rows())
    assert simhash.edited_fingerprints(empty).count() == 0
    alone = simhash.edited_fingerprints(docs_of(["abc def"])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and alone.near_next == 1.0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    import __spark_entry__ as entry

    def prose(seed, n):
        return "\n".join(" ".join(words(seed * 50 + k, 12, 900)) + "." for k in range(n))

    texts = [f"Shared notice of all sites.\n{prose(i, 6)}" for i in range(60)]
    texts += [texts[7], texts[8].replace("w1", "w2", 1), "%%$$##@@!! " * 40]
    rows = [(i, t, "en", f"s{i % 8}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [len(corpus_pipeline.STAGES), entry.queries()["pipeline"]] == [5, corpus_pipeline.run]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != "packing":
            assert now.columns == before.columns
    ids = {name: {r.doc_id for r in df.collect()} for name, df in seen.items()}
    assert ids["quality_classifier"] >= set(range(50)) and 62 not in ids["quality_classifier"]
    assert ids["line_dedup"] == ids["quality_classifier"]
    assert not any("Shared notice" in r.text or len(r.text) != r.n_chars for r in seen["line_dedup"].collect())
    assert ids["quality_classifier"] - ids["minhash_near_dedup"] == {60, 61} & ids["quality_classifier"]
    assert ids["source_mixing"] < ids["minhash_near_dedup"] and ids["packing"] == ids["source_mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()
