"""Quality classifier: perplexity under a modified Kneser-Ney character model of trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, few, small, text_slices

#: A trigram is three code points of 21 bits in one long; EDGE, past the last one, is the border of a text.
BITS = 21
EDGE = 0x110000
#: Bytes of text whose trigrams a Python step holds at a time, at some 40 bytes each.
GRAM_SLICE = 250_000
#: The lowest order is uniform over the trusted characters, at least so many symbols.
SYMBOLS = 120
#: Places of the border and of characters without a place in the dense view of a small model.
BORDER, OTHER = 0, 1
#: Rows of the table of trigram prices up to which it meets the documents by broadcast; beyond, both sides shuffle.
PRICE_ROWS = 1_000_000
#: A document is rejected so many robust standard deviations from the median of the trusted documents.
DEVIATIONS = 5.0
#: Standard errors of its own cross-entropy by which a document must exceed the limit.
CAUTION = 2.0
#: Trusted documents of a model and length class from which its limit of repetition is estimated.
LEAST = 20

POOLED = "*"


def model_name() -> Column:
    """Name of the model of a language; the pooled one cannot clash with it."""
    return F.concat(F.lit("lang:"), F.col("lang"))


def _last(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * n) - 1))


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of the texts one after the other, and the end of every text in them.

    A text of n characters has n + 1 trigrams: two borders stand before it and one behind.
    """
    sizes = np.asarray([len(t) if t else 0 for t in texts], dtype=np.int64)
    joined = "".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass")
    # Two borders, the text and one border; the last two places of a text start no trigram of its own.
    stops = np.cumsum(sizes + 3)
    inside = np.ones(int(sizes.sum()) + 3 * len(texts), dtype=bool)
    for place in (stops - sizes - 3, stops - sizes - 2, stops - 1):
        inside[place] = False
    line = np.full(len(inside), EDGE, dtype=np.int64)
    line[inside] = np.frombuffer(joined, dtype=np.uint32)
    grams = line[:-2] << 2 * BITS
    grams |= line[1:-1] << BITS
    grams |= line[2:]
    inside[:] = True
    for place in (stops - 2, stops - 1):
        inside[place] = False
    return grams[inside[:-2]], np.cumsum(sizes + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, size=GRAM_SLICE):
            models = np.asarray(rows.column("model").to_pylist(), dtype=object)
            grams, ends = _grams(rows.column("text").to_pylist())
            sizes = np.diff(ends, prepend=0)
            for name in pd.unique(models):
                found, n = np.unique(grams[np.repeat(models == name, sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["model", "gram", "n"]
                )


_DISTINCT = ("h0", "h1", "m", "gram", "n")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different trigrams of every text with their counts."""
    for batch in batches:
        for rows in text_slices(batch, size=GRAM_SLICE):
            grams, ends = _grams(rows.column("text").to_pylist())
            parts = [np.unique(g, return_counts=True) for g in np.split(grams, ends[:-1])]
            repeats = [len(found) for found, _ in parts]
            keys = [np.repeat(rows.column(k).to_numpy(zero_copy_only=False), repeats) for k in _DISTINCT[:3]]
            columns = [*keys, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_DISTINCT))


def _discounted(counts: DataFrame, rows: int, order: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Per n-gram its discounted share of its context, and per context the weight left for the lower order.

    ``counts``: model, gram, n, of at most ``rows`` rows. Counts of counts give the three discounts of each model;
    sums by context meet the n-grams in an equi-join over hash shards.
    """
    parts = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    of = counts.groupBy("model").agg(*parts)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        # Where a count of counts is missing, absolute discounting by k / 2 takes its place.
        full = F.lit(k) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.least(F.greatest(F.coalesce(full, F.lit(k / 2)), F.lit(0.05)), F.lit(float(k) - 0.05)).alias(f"d{k}")

    of = stages.keep(few(of.select("model", *[discount(k) for k in (1, 2, 3)]), rows))
    context = F.shiftright("gram", BITS) if order > 1 else F.lit(0).cast("long")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rich = counts.join(small(of, of.count()), "model").select("model", "gram", context.alias("context"), "n", d.alias("d"))
    sums = rich.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    share = rich.join(sums, ["model", "context"]).select("model", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
    weight = sums.select("model", F.col("context").alias("gram"), (F.col("left") / F.col("total")).alias("value"))
    return share, weight


class LanguageModel:
    """Interpolated modified Kneser-Ney trigram models over characters, one per language and a pooled one.

    ``tables`` is a stored table (model, kind, gram, value) of discounted shares and back-off
    weights of every order; it grows with the trusted text and is met by equi-joins.
    """

    def __init__(self, tables: DataFrame):
        self.tables = tables
        self.models = tables.where("kind = 'weight1'").select("model")
        self.rows = tables.count()
        seen = tables.where((F.col("kind") == "share1") & (F.col("model") == POOLED) & (F.col("gram") != EDGE))
        self.size = max(SYMBOLS, seen.count() + 2)

    def _kind(self, kind: str, key: str) -> DataFrame:
        part = self.tables.where(F.col("kind") == kind).select("model", F.col("gram").alias(key), F.col("value").alias(kind))
        return small(part, self.rows, read=True)

    def prices(self, grams: DataFrame) -> DataFrame:
        """-log P(c | a, b) of every row of ``grams`` (model, gram), seen or not."""
        gram = F.col("gram")
        keys = {
            "share3": gram, "weight3": F.shiftright(gram, BITS), "share2": _last(gram, 2),
            "weight2": F.shiftright(_last(gram, 2), BITS), "share1": _last(gram, 1),
        }
        priced = grams.select("model", "gram", *[k.alias(f"_{kind}") for kind, k in keys.items()])
        for kind in keys:
            priced = priced.join(self._kind(kind, f"_{kind}"), ["model", f"_{kind}"], "left")
        lowest = self.tables.where("kind = 'weight1'").select("model", F.col("value").alias("weight1"))
        priced = priced.join(small(lowest, lowest.count()), "model")
        p = F.coalesce("share1", F.lit(0.0)) + F.col("weight1") / self.size
        for order in (2, 3):
            p = F.coalesce(f"share{order}", F.lit(0.0)) + F.coalesce(f"weight{order}", F.lit(1.0)) * p
        return priced.select("model", "gram", (-F.log(p)).alias("price"))

    @property
    def alphabet(self) -> list[int]:
        """The characters of a small model, for its dense view: at most SYMBOLS - 2, the smallest ones."""
        seen = self.tables.where((F.col("kind") == "share1") & (F.col("model") == POOLED) & (F.col("gram") != EDGE))
        return [r["gram"] for r in seen.orderBy("gram").limit(SYMBOLS - 2).collect()]

    def log_probabilities(self, name: str) -> np.ndarray:
        """log P(c | a, b) for every trigram of a model of few characters as one array, to look at it."""
        a = SYMBOLS
        place = {EDGE: BORDER} | {c: i + 2 for i, c in enumerate(self.alphabet)}
        if self.size > a:
            raise ValueError(f"the dense view holds {a} symbols, the model has {self.size}")
        flat = {kind: np.full(a**n, empty) for kind, n, empty in [
            ("share1", 1, 0.0), ("weight1", 0, 1.0), ("share2", 2, 0.0), ("weight2", 1, 1.0), ("share3", 3, 0.0), ("weight3", 2, 1.0)
        ]}
        for r in self.tables.where(F.col("model") == name).collect():
            at = 0
            for i in reversed(range(int(math.log(len(flat[r["kind"]]), a) + 0.5))):
                at = at * a + place[(r["gram"] >> BITS * i) & ((1 << BITS) - 1)]
            flat[r["kind"]][at] = r["value"]
        p = flat["share1"] + flat["weight1"] / a
        p = flat["share2"].reshape(a, a) + flat["weight2"][:, None] * p[None, :]
        p = flat["share3"].reshape(a, a, a) + flat["weight3"].reshape(a, a, 1) * p[None, :, :]
        return np.log(p).ravel().astype(np.float32)


def train(trusted: DataFrame, stages: Stages) -> LanguageModel:
    """Fit the models on all of ``trusted`` (lang, text): every character and every language counts."""
    named = trusted.where("text <> ''").select(F.coalesce(model_name(), F.lit(POOLED)).alias("model"), "text")
    counted = stages.keep(named.mapInArrow(_counted, "model string, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n")))
    pooled = counted.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("model"), "gram", "n")
    # Every trigram counted gives itself and a pooled one at most.
    counts = stages.keep(few(counted.where(F.col("model") != POOLED).unionByName(pooled), 2 * counted.count()))
    rows = counts.count()

    def lower(df: DataFrame, order: int) -> DataFrame:
        """Continuation counts: in how many different characters' company the shorter n-gram ends a longer one."""
        return df.groupBy("model", _last(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n"))

    two = lower(counts, 2)
    tables = None
    for order, table in ((3, counts), (2, two), (1, lower(two, 1))):
        for kind, part in zip(("share", "weight"), _discounted(table, rows, order, stages), strict=True):
            part = few(part.select("model", F.lit(f"{kind}{order}").alias("kind"), "gram", "value"), rows)
            tables = part if tables is None else tables.unionByName(part)
    model = LanguageModel(stages.keep(tables))
    stages.drop(counted, counts)
    return model


class QualityClassifier:
    """A fitted model, the scores of all texts and the limits of every model name."""

    def __init__(self, docs: DataFrame, labels: DataFrame, deviations: float = DEVIATIONS):
        """Fit on the rows of ``docs`` that ``labels`` (doc_id, quality) calls good."""
        self.stages = Stages(docs.sparkSession)
        good = labels.where("quality = 1").select("doc_id").distinct()
        trusted = docs.select("doc_id", "lang", "text").join(small(good, good.count()), "doc_id", "left_semi")
        self.model = train(trusted, self.stages)
        if not self.model.rows:
            raise ValueError("no trusted text to fit the quality model on")
        names = self.stages.keep(self.model.models.select(F.col("model").alias("_own")))
        self.names = small(names, names.count())
        # The pooled model has its limit from all trusted documents as it scores them itself.
        own = self._keyed(trusted.where("text <> ''"))
        examples = own.where(F.col("model") != POOLED).unionByName(self._keyed(trusted.where("text <> ''"), pooled=True))
        keys = ["h0", "h1", "m", "text"]
        texts = self._keyed(docs.where("text <> ''").select("lang", "text")).select(*keys)
        self.scored = self.stages.keep(self._scores(texts.unionByName(examples.where(F.col("model") == POOLED).select(*keys))))
        judged = self.stages.keep(self._with_scores(examples).select("model", "length", "entropy", "repetition"))
        self.limits = self.stages.keep(self._limits(judged, "entropy", ["model"], deviations).select("model", F.col("most").alias("limit")))
        repeats = self._limits(judged, "repetition", ["model", "length"], deviations).where(F.col("n") >= LEAST)
        self.repeats = self.stages.keep(repeats.select("model", "length", F.col("most").alias("most_repetition")))

    def _limits(self, judged: DataFrame, value: str, by: list[str], deviations: float) -> DataFrame:
        """``by``, n and most: the median of ``value`` and so many deviations above it, by the median absolute deviation.

        Half of the trusted documents would have to be odd to move it far.
        """

        def median(x: Column) -> Column:
            return F.percentile_approx(x, F.lit(0.5), F.lit(10_000))

        middle = judged.groupBy(*by).agg(median(F.col(value)).alias("middle"), F.count("*").alias("n"))
        rows = judged.count()
        middle = self.stages.keep(few(middle, rows))
        away = judged.join(small(middle, middle.count()), by).groupBy(*by, "middle", "n").agg(median(F.abs(F.col(value) - F.col("middle"))).alias("away"))
        return few(away.withColumn("most", F.col("middle") + deviations * 1.4826 * F.col("away")), rows)

    def _keyed(self, docs: DataFrame, pooled: bool = False) -> DataFrame:
        """``docs`` with a digest of the text (h0, h1), the name of its model and a number of that (m)."""
        named = docs.join(self.names, model_name() == F.col("_own"), "left")
        named = named.withColumn("model", F.lit(POOLED) if pooled else F.coalesce("_own", F.lit(POOLED)))
        return named.drop("_own").withColumns({
            "h0": F.xxhash64("text", F.lit(0)), "h1": F.xxhash64(F.lit(1), "text"), "m": F.xxhash64("model"),
        })

    def _scores(self, texts: DataFrame) -> DataFrame:
        """h0, h1, m, entropy, spread (the variance of a price) and repetition of every different text.

        Repetition is the mean logarithm of the count of a trigram in its own text: log of the
        number of trigrams less the text's entropy under itself, high if few words recur.
        """
        distinct = texts.select("h0", "h1", "m", "text").mapInArrow(_distinct, ", ".join(f"{c} long" for c in _DISTINCT))
        names = self.names.select(F.col("_own").alias("model"), F.xxhash64("_own").alias("m"))
        used = distinct.select("m", "gram").distinct().join(names, "m").select("model", "gram")
        prices = self.stages.keep(self.model.prices(used).select(F.xxhash64("model").alias("m"), "gram", "price"))
        rows = prices.count()
        priced = distinct.join(F.broadcast(prices) if rows <= PRICE_ROWS else prices, ["m", "gram"])
        # Copies of a text add equal parts to all three sums.
        n, price = F.col("n"), F.col("price")
        sums = priced.groupBy("h0", "h1", "m").agg(
            F.sum("n").alias("n"), F.sum(n * price).alias("one"), F.sum(n * price * price).alias("two"), F.sum(n * F.log(n)).alias("own")
        )
        mean = F.col("one") / n
        return sums.select(
            "h0", "h1", "m", mean.alias("entropy"), F.greatest(F.col("two") / n - mean * mean, F.lit(0.0)).alias("spread"),
            (F.col("own") / n).alias("repetition"),
        )

    def _with_scores(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` without text but with n_chars, length (its class), entropy and its standard error, repetition."""
        rows = keyed.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).drop("text")
        rows = rows.withColumn("length", F.floor(F.log2(F.col("n_chars") + 1)))
        return rows.join(self.scored, ["h0", "h1", "m"], "left").withColumn("error", F.sqrt(F.col("spread") / (F.col("n_chars") + 1)))

    def _limited(self, docs: DataFrame) -> DataFrame:
        """The scores of ``docs`` with the limit of the model and kept."""
        rows = self._with_scores(self._keyed(docs)).join(small(self.limits, self.limits.count()), "model", "left")
        rows = rows.join(small(self.repeats, self.repeats.count()), ["model", "length"], "left")
        # Nothing is known of a language without trusted text: it has no limit.
        unknown = F.col("lang").isNotNull() & (F.col("model") == POOLED)
        rows = rows.withColumn("limit", F.when(~unknown, F.col("limit")))
        plain = F.col("repetition") <= F.coalesce("most_repetition", F.lit(float("inf")))
        below = (F.col("entropy") - CAUTION * F.col("error") <= F.col("limit")) & plain
        return rows.withColumn("kept", (F.col("n_chars") > 0) & (unknown | F.coalesce(below, F.lit(False))))

    def judged(self, docs: DataFrame) -> DataFrame:
        rows = self._limited(docs.select("doc_id", "lang", "text"))
        return rows.select("doc_id", "lang", "model", "n_chars", F.exp("entropy").alias("perplexity"), F.exp("limit").alias("limit"), "kept")

    def passing(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are kept; texts meet the rejected digests only."""
        own = F.struct(*docs.columns).alias("row")
        keyed = self._keyed(docs.select("lang", "text", own)).where("text <> ''")
        rejected = self.stages.keep(self._rejected(docs))
        known = F.col("row.lang").isNull() | (F.col("model") != POOLED)
        marked = keyed.select("row", "h0", "h1", F.when(known, F.col("m")).alias("m"))
        kept = marked.join(small(rejected, rejected.count()), ["h0", "h1", "m"], "left_anti")
        return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])

    def _rejected(self, docs: DataFrame) -> DataFrame:
        rows = self._limited(docs.where("text <> ''").select("lang", "text"))
        return few(rows.where("NOT kept").select("h0", "h1", "m").distinct(), self.scored.count())


def judged_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Perplexity and verdict of every document.

    One row per row of ``docs``: doc_id, lang, model, n_chars, perplexity (per character),
    limit and kept. The model is trained on all documents with quality 1; a document goes
    if its log perplexity is more than five robust deviations above the median of the
    trusted ones of its language, even when its own sampling error is allowed for, so that
    short clean texts stay. It also goes at the other side, if it repeats itself by as much
    more than trusted documents of its language and length class do (powers of two).

    A null language is judged by the pooled model, by the limit of all trusted documents
    under it. A language without trusted text gets its perplexity from it too, but has a null
    limit and its documents stay. A null or empty text has no perplexity and is rejected. Repeated rows are judged alike; rows
    without doc_id are judged but never train. Labels of other documents, repeated labels
    and null labels are ignored. An empty ``docs`` gives no rows. Without any trusted text
    the classifier raises ValueError. Other columns are ignored.
    """
    if docs.isEmpty():
        return docs.selectExpr("doc_id", "lang", "'' AS model", "0L AS n_chars", "0D AS perplexity", "0D AS limit", "true AS kept")
    return QualityClassifier(docs, labels).judged(docs)


def passing_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged_quality`` keeps, with all their columns."""
    return docs if docs.isEmpty() else QualityClassifier(docs, labels).passing(docs)
