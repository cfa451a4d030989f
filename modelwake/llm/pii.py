"""Personal data: base patterns, and identifiers that contexts of base matches reveal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, text_or_empty

#: Kinds in the order of the result, with their patterns. Possessive quantifiers and the
#: look-behinds change no match: a match can only begin inside a run of its own characters
#: where the match before has ended (\G). They keep long runs linear and off the stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Tokens that may be identifiers: at least one digit, or an @.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*"

#: Confidence from which a pattern counts as evidence, and from which an instance is accepted.
PATTERN_CONFIDENCE, ACCEPT = 0.9, 0.9
#: Matches that one inner loop places; code points of a block in which spans are compared.
BLOCK, BLOCK_POINTS = 128, 512

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_MARK = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def term(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.get(doubled, d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(value)
    return F.length(_digits(value)).between(8, 15)


def _shaped(kind: str, value: Column) -> Column:
    """May a token that matched no base pattern be an identifier of this kind?"""
    n, plain = F.length(_digits(value)), ~value.rlike("[A-Za-z]")
    if kind == "email":
        return value.contains("@")
    if kind == "ip":
        return (F.regexp_count(value, F.lit("[.:]")) >= 3) & (n >= 4)
    return plain & n.between(*((12, 19) if kind == "card" else (6, 15)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spaced(text: Column) -> Column:
    """Every white space of the pattern \\s as a space."""
    return F.translate(text, "\t\n\x0b\f\r", "     ")


def _placed(block: Column, start: Column, valid) -> Column:
    """The valid matches of a few parts, the first of which begins at ``start``."""
    return F.aggregate(
        block,
        F.struct(start.alias("at"), F.array().cast(_MARK).alias("marks")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(
                x["value"].isNotNull() & valid(x["value"]),
                F.concat(
                    a["marks"],
                    F.array(
                        F.struct(
                            (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"),
                            x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"),
                        )
                    ).cast(_MARK),
                ),
            ).otherwise(a["marks"]).alias("marks"),
        ),
        lambda a: a["marks"],
    )


def _marks(text: Column, pattern: str, valid) -> Column:
    """Valid matches of ``pattern`` with code point positions and the words beside them.

    Matches are placed in blocks, whose starts are added up first: an array that grows by
    one match at a time would be copied for every match of a long text.
    """

    def parts(pieces: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.arrays_zip(found.alias("f"), pieces.alias("p"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("q"))
        return F.transform(
            zipped,
            lambda z: F.struct(
                F.char_length(z["p"]).alias("gap"),
                F.coalesce(F.char_length(z["f"]), F.lit(0)).alias("size"),
                z["f"].alias("value"),
                F.lower(F.substring_index(F.rtrim(_spaced(z["p"])), " ", -1)).alias("left"),
                F.lower(F.substring_index(F.ltrim(_spaced(F.coalesce(z["q"], F.lit("")))), " ", 1)).alias("right"),
            ),
        )

    def blocks(of: Column) -> Column:
        last = F.floor((F.size(of) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(of, i * BLOCK + 1, F.lit(BLOCK)))

    def starts(of: Column) -> Column:
        lengths = F.transform(of, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        grown = F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
        )
        return grown["starts"]

    def marked(of: Column) -> Column:
        return F.flatten(F.zip_with(of, starts(of), lambda b, at: _placed(b, at, valid)))

    placed = _let(_let(_let(F.split(text, pattern, -1), parts), blocks), marked)
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(_MARK))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text, the base matches of every kind and all candidate tokens."""
    texts = docs.select("doc_id", text_or_empty().alias("_text"))
    tokens = _marks(F.col("_text"), CANDIDATE, lambda v: v.contains("@") | (F.length(_digits(v)) >= 4))
    return texts.select(
        "doc_id", F.xxhash64("_text", F.lit(0)).alias("h0"), F.xxhash64(F.lit(1), "_text").alias("h1"),
        *[_base(k) for k in KINDS], tokens.alias("tokens"),
    )


def _base(kind: str) -> Column:
    def valid(value: Column) -> Column:
        return _valid(kind, value)

    return _marks(F.col("_text"), PATTERNS[kind], valid).alias(kind)


def discovered(scan: DataFrame, stages: Stages) -> DataFrame:
    """h0, h1 and found: spans (kind, start, end) that bootstrapping adds to the base matches.

    Instances are base matches (seeds of their kind, weight 1) and other tokens shaped like
    a kind (weight 0). Patterns are the words before, after, and on both sides. What speaks
    against a pattern and a kind are seeds of other kinds and tokens shaped like none; a
    token that may be an identifier speaks neither way until it is accepted. The confidence
    is the weight of the instances of the kind over that weight, what speaks against it, and
    one more, so that only patterns with nine pure seeds reach 0.9; a token's weight is the
    noisy-or of its confident patterns. Accepted tokens support patterns in the next round.
    Confidence can only grow, so accepted tokens stay, and the rounds end with the first one
    that accepts nothing new. All sums run over (pattern, kind) edges with map-side
    aggregation, and only confident patterns are joined back, so a word that stands beside
    a third of all identifiers is no hot key.
    """
    texts = scan.dropDuplicates(["h0", "h1"])
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(True).alias("seed"), F.col(k).alias("marks")) for k in KINDS]
    seeds = texts.select("h0", "h1", F.explode(F.array(*kinds)).alias("k")).select("h0", "h1", "k.kind", "k.seed", F.explode("k.marks").alias("m"))
    seeds, tokens = stages.keep(seeds), stages.keep(texts.select("h0", "h1", F.explode("tokens").alias("m")))
    shaped = F.filter(F.array(*[F.when(_shaped(k, F.col("m.value")), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    free = without_overlaps(tokens, seeds)
    others = free.select("h0", "h1", F.explode_outer(shaped).alias("kind"), F.lit(False).alias("seed"), "m")
    instances = stages.keep(
        seeds.unionByName(others).select(
            "h0", "h1", F.coalesce("kind", F.lit("none")).alias("kind"), "seed", "m.start", "m.end",
            F.array(
                F.concat(F.lit("L "), "m.left"), F.concat(F.lit("R "), "m.right"), F.concat(F.lit("B "), "m.left", F.lit(" "), "m.right")
            ).alias("patterns"),
            F.when(F.col("seed"), 1.0).otherwise(0.0).alias("weight"),
        )
    )
    # A pattern with no word says nothing.
    bare = F.array(F.lit("L "), F.lit("R "), F.lit("B  "))
    edges = stages.keep(instances.select("h0", "h1", "kind", "seed", "start", "end", F.explode(F.array_except("patterns", bare)).alias("pattern")))
    labelled = stages.keep(edges.where("seed OR kind = 'none'").groupBy("pattern").agg(F.count("*").alias("n")))
    key = ["h0", "h1", "kind", "start", "end"]
    sown = instances.where("seed").select(*key, "weight")
    weights, known = sown, 0
    while True:
        support = edges.join(weights, key).groupBy("pattern", "kind").agg(F.sum("weight").alias("w"), F.count_if("seed").alias("own"))
        # Patterns that only accepted tokens have are not among the labelled ones.
        against = F.coalesce("n", F.lit(0)) - F.col("own")
        confident = support.join(labelled, "pattern", "left").select("pattern", "kind", (F.col("w") / (F.col("w") + against + 1)).alias("c"))
        evidence = edges.where("NOT seed").join(confident.where(F.col("c") >= PATTERN_CONFIDENCE), ["pattern", "kind"])
        scored = evidence.groupBy(*key).agg((1 - F.exp(F.sum(F.log(F.lit(1) - F.least("c", F.lit(0.999)))))).alias("weight"))
        accepted = stages.keep(scored.where(F.col("weight") >= ACCEPT))
        weights, before, known = sown.unionByName(accepted), known, accepted.count()
        if known == before:
            break
    # One token, one kind: the best supported, then the first listed.
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = accepted.groupBy("h0", "h1", "start", "end").agg(F.min_by("kind", F.struct(-F.col("weight"), order)).alias("kind"))
    return one.groupBy("h0", "h1").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))


def without_overlaps(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """The tokens that share no code point with a seed. Spans meet in short blocks of their text."""
    first, last = F.floor(F.col("m.start") / BLOCK_POINTS), F.floor((F.col("m.end") - 1) / BLOCK_POINTS)
    blocks = F.explode(F.sequence(first, last)).alias("block")
    mine = tokens.select("h0", "h1", F.col("m.start").alias("start"), F.col("m.end").alias("end"), blocks)
    theirs = seeds.select("h0", "h1", F.col("m.start").alias("_start"), F.col("m.end").alias("_end"), blocks)
    touched = mine.join(theirs, ["h0", "h1", "block"]).where((F.col("_start") < F.col("end")) & (F.col("start") < F.col("_end")))
    taken = touched.select("h0", "h1", "start", "end").distinct()
    keyed = tokens.withColumns({"start": F.col("m.start"), "end": F.col("m.end")})
    return keyed.join(taken, ["h0", "h1", "start", "end"], "left_anti").select("h0", "h1", "m")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text.

    One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and
    spans (kind:start:end in code points, by kind and start, comma-joined). The counts and
    the digest are those of the base matches; spans also has what bootstrapping found.

    A null or empty text has no spans: zero counts, the digest of the empty string and an
    empty list. Equal texts have equal spans and count once as evidence. Null and repeated
    doc_ids do no harm, as texts are known by their digest. An empty table gives no rows.
    Other columns are ignored.
    """
    stages = Stages(docs.sparkSession)
    scan = stages.keep(scanned(docs))
    found = discovered(scan, stages)

    def spans(kind: str, extra: bool) -> Column:
        base = F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        if not extra:
            return base
        added = F.filter(F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: s["kind"] == kind)
        return F.array_sort(F.concat(base, added))

    return scan.join(found, ["h0", "h1"], "left").select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.concat(*[spans(k, False) for k in KINDS])).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(*[spans(k, True) for k in KINDS])).alias("spans"),
    )
