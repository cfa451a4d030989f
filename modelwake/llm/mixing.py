"""Mixing sources: rake token weights to target margins, then sample documents by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, few, small
from modelwake.operators.ordered import running_totals

#: Hash topics: the number of topics that long words vote for.
TOPICS = 8
#: Rounds of raking at most, and the share by which a category may miss its goal.
ROUNDS, TOLERANCE = 40, 1e-3
#: Rounds after which the largest gap must be under this share of what it was.
STALLED, SLOWEST = 4, 0.9
#: Times its tokens that a cell may want, which keeps numbers finite; it gets them once at most.
FULL = 1e6
#: Shares named to sum to 1 leave less than this.
ROUNDING = 1e-9
#: Tokens of the mix as a share of all tokens.
BUDGET = 0.5

MARGINS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    """Words of a text, the token measure of the mix."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def with_topic(df: DataFrame, text: Column, keep: list[str], topics: int = TOPICS) -> DataFrame:
    """``keep`` and topic: the topic most long words vote for, each for that of its hash; ties go to the lowest.

    A stand-in where documents carry no topic of their own: it is a fixed function of the
    text, so copies share it and it needs no training. Votes are one string of digits per
    text, made once and counted by the length without a digit.
    """
    digits = "0123456789"[:topics]
    long_words = F.filter(F.split(text, r"\s"), lambda w: F.char_length(w) >= 7)
    votes = F.array_join(F.transform(long_words, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(topics)).cast("string")), "")
    voted = df.select(*keep, votes.alias("_votes"))
    fewer = {f"_without{d}": F.length(F.translate("_votes", d, "")) for d in digits}
    counted = voted.select(*keep, *[c.alias(n) for n, c in fewer.items()])
    least = F.least(*fewer)
    topic = F.coalesce(*[F.when(F.col(f"_without{d}") == least, F.lit(f"t{d}")) for d in digits])
    return counted.select(*keep, topic.alias("topic"))


def _key(margin: str) -> Column:
    """A category as a key that is never null, so that plain joins and windows share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), F.col(margin).cast("string")), F.lit(""))


def _keyed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with what ``table`` has for their ``_key``; sorted and merged, so no broadcast piles up on the driver."""
    return rows.join(table.hint("merge"), "_key", "left")


def margin_goals(cells: DataFrame, cell_rows: int, margin: str, named: Mapping[str, float] | None, size: float, stages: Stages) -> DataFrame:
    """_key and _want: the tokens that every category of ``margin`` gives to a mix of ``size`` tokens.

    Categories without a named share divide what is left over equally; if nothing is left
    over, each keeps its own share of the tokens and the named ones are scaled to the rest.
    No category is asked for more than it holds: what it lacks is shared out among the others
    in proportion to their shares. The common factor is found by Newton steps, one small sum
    each; a step that does not end the search fills up at least one more category.
    """
    # Cases instead of a table from Python rows, for which every executor would start more Python workers.
    cases = [F.when(F.col("_key") == f"={k}", F.lit(float(v))) for k, v in (named or {}).items()]
    held = cells.groupBy(_key(margin).alias("_key")).agg(F.sum("tokens").cast("double").alias("have")).where("have > 0")
    joined = stages.keep(few(held.withColumn("share", F.coalesce(*cases, F.lit(None).cast("double"))), cell_rows))
    total, named_sum, open_n, open_have = joined.agg(
        F.sum("have"), F.coalesce(F.sum("share"), F.lit(0.0)), F.count_if(F.col("share").isNull()), F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("have"))), F.lit(0.0))
    ).first()
    left = max(0.0, 1.0 - sum((named or {}).values()))
    if open_n and left < ROUNDING:
        part = open_have / total
        share = F.coalesce(F.col("share") / (named_sum or 1.0) * (1.0 - part), F.col("have") / total)
    else:
        share = F.coalesce(F.col("share"), F.lit(left / open_n if open_n else 0.0))
    shares = stages.keep(joined.select("_key", "have", share.alias("share")))
    whole = shares.agg(F.sum("share")).first()[0]
    factor = size / whole if whole else 0.0
    while True:
        want = F.least("have", F.col("share") * factor)
        got, free = shares.agg(F.sum(want), F.sum(F.when(F.col("share") * factor < F.col("have"), F.col("share")).otherwise(0.0))).first()
        if not free or size - got <= ROUNDING * size:
            break
        factor += (size - got) / free
    goals = stages.keep(shares.select("_key", F.least("have", F.col("share") * factor).alias("_want")))
    stages.drop(joined, shares)
    return goals


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | None], budget: float, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Iterative proportional fitting of cell weights under the limit of what a cell holds.

    ``cells``: the margins and tokens. Returns them with weight, the tokens to take, at most
    tokens; and margin, category, want and got, which tell how far every category is off. A
    margin's target is a mapping of category to share, or None for equal shares
    (``margin_goals``).

    A step adapts one margin: the weights before the limit are scaled by one factor per
    category, the one with which the limited weights meet the goal. It is found exactly: in
    the order in which cells fill up, running sums tell what the category gives when a cell
    is just full, and the factor lies before the first cell that reaches the goal. Cells that
    are held at all they have leave the rest to others. A step is one pass over stored cells,
    one window per category (cut into ranges for a hot one) and one equi-join, so plans
    stay alike from the first round to the last.

    Rounds end when no category was off by more than TOLERANCE. Margins may contradict each
    other: rounds also end when STALLED of them left more than SLOWEST of the largest gap, or
    after ROUNDS in all, and the second table says which categories are off.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    size = budget * total
    if not total:
        none = cells.sparkSession.createDataFrame([], "margin string, category string, want double, got double")
        return cells.withColumn("weight", F.lit(0.0)), none
    cell_rows = cells.count()
    goals = {m: margin_goals(cells, cell_rows, m, targets.get(m), size, stages) for m in MARGINS}
    # _x: the weight before the limit.
    now = stages.keep(cells.withColumn("_x", F.col("tokens") * F.lit(float(budget))))
    tokens = F.col("tokens").cast("double")
    limited = F.least(tokens, F.col("_x"))

    def factors(margin: str) -> DataFrame:
        """_key, _factor and _off, by which the category missed its goal before."""
        others = [m for m in MARGINS if m != margin]
        # Cells that fill up together keep an order of their own; the sums are the same after any of them.
        order = F.struct((tokens / F.col("_x")).alias("fill"), *others)
        cells_in_order = now.where("_x > 0").select(_key(margin).alias("_key"), order.alias("_order"), tokens.alias("t"), F.col("_x").alias("x"))
        run = _keyed(running_totals(cells_in_order, ["_key"], "_order", ["t", "x"], cell_rows), goals[margin])
        fill, full, free = F.col("_order.fill"), F.col("cum_t"), F.col("tot_x") - F.col("cum_x")
        reached = full + fill * free >= F.col("_want")
        before = (F.col("_want") - (full - F.col("t"))) / (free + F.col("x"))
        found = run.groupBy("_key").agg(
            F.coalesce(F.min_by(before, F.when(reached, F.col("_order"))), F.max(fill)).alias("_factor"),
            F.first("_want").alias("_want"),
            F.sum(F.least("t", "x")).alias("_got"),
        )
        off = F.coalesce(F.try_divide(F.abs(F.col("_got") - F.col("_want")), F.col("_want")), F.lit(0.0))
        return found.select("_key", F.coalesce("_factor", F.lit(0.0)).alias("_factor"), off.alias("_off"))

    worst: list[float] = []
    while len(worst) < ROUNDS:
        scales = []
        for margin in MARGINS:
            scale = stages.keep(few(factors(margin), cell_rows))
            scales.append(scale)
            moved = _keyed(now.withColumn("_key", _key(margin)), scale.drop("_off")).withColumn("_x", F.col("_x") * F.col("_factor"))
            # Categories without tokens have no goal and no factor.
            moved = moved.select(*cells.columns, F.least(F.coalesce("_x", F.lit(0.0)), tokens * FULL).alias("_x"))
            after = stages.keep(few(moved, cell_rows))
            stages.drop(now)
            now = after
        off = reduce(DataFrame.unionByName, [scale.select("_off") for scale in scales])
        worst.append(off.agg(F.max("_off")).first()[0] or 0.0)
        stages.drop(*scales)
        if worst[-1] < TOLERANCE or len(worst) > STALLED and worst[-1] > SLOWEST * worst[-1 - STALLED]:
            break
    gaps = []
    for margin in MARGINS:
        summed = now.groupBy(_key(margin).alias("_key")).agg(F.first(margin).cast("string").alias("category"), F.sum(limited).alias("got"))
        gaps.append(_keyed(summed, goals[margin]).select(F.lit(margin).alias("margin"), "category", F.coalesce("_want", F.lit(0.0)).alias("want"), "got"))
    return now.select(*cells.columns, limited.alias("weight")), reduce(DataFrame.unionByName, gaps)


#: Shares of languages and sources of the mix as it is produced here: sources and topics alike.
TARGETS: dict[str, dict[str, float] | None] = {
    "source": None,
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": None,
}


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", "source", "lang", text.alias("text"), token_count(text).alias("tokens"))
    return with_topic(counted, F.col("text"), ["doc_id", "source", "lang", "tokens"])


def _chance(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the document alone, so that retries and copies of a row agree."""
    return F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _calibrated(measured: DataFrame, targets, budget: float, stages: Stages) -> tuple[DataFrame, int]:
    # ``measured`` is stored.
    cells = stages.keep(few(measured.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), measured.count()))
    weights, _ = raked(cells, targets, budget, stages)
    chances = stages.keep(
        weights.select(
            *[F.col(m).alias(f"_{m}") for m in MARGINS],
            F.coalesce(F.try_divide("weight", F.col("tokens").cast("double")), F.lit(0.0)).alias("probability"),
        )
    )
    return chances, chances.count()


def _cell(df: DataFrame, chances: DataFrame, rows: int) -> DataFrame:
    return df.join(small(chances, rows), F.expr(" AND ".join(f"{m} <=> _{m}" for m in MARGINS)))


def mixed_sources(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | None] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The probability with which every document enters the mix, and whether it does.

    One row per row of ``docs``: doc_id, source, lang, topic, tokens, probability, kept.
    Probabilities are the same for all documents of a cell (source, language, topic) and
    make the expected tokens of every source, language and topic meet its target where the
    documents suffice; what a cell lacks is taken from others. A document is drawn by a
    hash of its doc_id, so results repeat and equal rows share their fate.

    Null sources and languages are categories of their own. A document without words has
    probability that of its cell and no tokens; cells without any token get probability 0.
    A null doc_id is drawn like an id. An empty table gives no rows. Other columns are
    ignored.
    """
    stages = Stages(docs.sparkSession)
    measured = stages.keep(_measured(docs))
    chances, rows = _calibrated(measured, targets, budget, stages)
    drawn = _cell(measured, chances, rows)
    return drawn.select(
        "doc_id", "source", "lang", "topic", "tokens", "probability", (_chance(F.col("doc_id")) < F.col("probability")).alias("kept")
    )


def mix_gaps(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | None] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """margin, category, want and got in tokens: how far the mix is off, one row per category."""
    stages = Stages(docs.sparkSession)
    cells = stages.keep(_measured(docs).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    return raked(cells, targets, budget, stages)[1]


def mixed_documents(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | None] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; cells decide, so texts are not shuffled for it."""
    stages = Stages(docs.sparkSession)
    measured = stages.keep(_measured(docs))
    chances, rows = _calibrated(measured, targets, budget, stages)
    stages.drop(measured)
    rows_only = docs.select(F.struct(*docs.columns).alias("row"), "source", "lang")
    keyed = with_topic(rows_only, F.coalesce("row.text", F.lit("")), ["row", "source", "lang"])
    drawn = _cell(keyed, chances, rows).where(_chance(F.col("row.doc_id")) < F.col("probability"))
    return drawn.select(*[F.col("row")[c].alias(c) for c in docs.columns])
