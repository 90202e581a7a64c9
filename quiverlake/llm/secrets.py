"""Secrets in texts: three patterns, and character Markov models that tell random strings from ordinary identifiers.

Everything here is DataFrame expressions. A pattern's matches and the text between them are two arrays (``split`` and
``regexp_extract_all``), so spans are sums of their lengths, in code points. Tokens that could be a key are scored by the
log-likelihood ratio of two first-order models, whose transition table is a literal of fixed size in the plan. The models
are trained on three fifths of a labelled sample, the ratio from which a token is a secret is chosen on another fifth, and
the last fifth says how good that is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: The last character of each of its words, and what comes after: texts without this have no assignment.
ASSIGN_HINT = r"""[dDtTnNyY]["']?\x20*[:=]"""
#: The contract's patterns with their least lengths inside: a run is matched whole or not at all.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Runs that the models score. Access keys and hex runs lie in such runs, so texts without one have neither.
CANDIDATE, CANDIDATE_LEAST = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", 16
#: What serves as a word of an ordinary identifier: not too long, and no part of a longer token, which could be a key.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,20}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")
MASK = "[SECRET]"
#: The log-likelihood ratio, in nats, that makes a token a secret where no sample says better; the share of ordinary sample
#: strings of which the fitted one lets through no more.
MARGIN, MOST_FALSE = 12.0, 0.0005
#: Texts whose words serve as ordinary identifiers, words of each, and generated strings of each sort.
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_STRINGS = 100, 2_000, 1_000
#: Ordinary identifiers that every training has.
PLAIN = (
    "configuration_file", "getElementById", "user_profile_settings", "max_connections_per_host", "application/json",
    "text/javascript", "createTemporaryView", "README", "content-type", "documentation", "internationalization",
    "src/main/resources", "error_message_handler", "default-timeout-seconds", "HTTP_STATUS_OK", "MAX_BUFFER_SIZE",
)
_BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def _pieces(text: Column, pattern: str, *groups: int) -> Column:
    """gaps: the text between matches, one more than they are; g0, g1, ...: the given groups of each match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    return F.struct(F.split(text, pattern, -1).alias("gaps"), *found)


def _starts(pieces: Column) -> Column:
    """Where each match starts. Sums of lengths, in blocks, so that a text with very many matches stays cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    lengths = F.zip_with(F.slice(pieces["gaps"], F.lit(1), F.size(pieces["g0"])), pieces["g0"], lambda a, b: (F.length(a) + F.length(b)).cast("long"))

    def from_lengths(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))

        def from_blocks(sums: Column) -> Column:
            def start(gap: Column, i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                return total(F.slice(sums, F.lit(1), block)) + total(F.slice(n, block * _BLOCK + 1, i - block * _BLOCK)) + F.length(gap)

            return F.transform(F.slice(pieces["gaps"], F.lit(1), F.size(n)), start)

        return _let(blocks, from_blocks)

    return _let(lengths, from_lengths)


_SPANS = "array<struct<start:bigint,rank:int,end:bigint,mask:bigint>>"


def _spans(text: Column, pattern: str, rank: int, groups: tuple[int, ...] = (0,), keep: Callable[[Column, Column], Column] | None = None, hint: Column | None = None) -> Column:
    """start, rank and end of the pattern's matches, and where what has to be masked begins (the last group's, if there are
    several); ``keep`` gets the pieces and a match's number, and texts that fail ``hint`` have no match."""

    def of(pieces: Column) -> Column:
        def spans(starts: Column) -> Column:
            made = F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(pieces["g0"][i])).alias("end"), i.alias("i")))
            if keep is not None:
                made = F.filter(made, lambda x: keep(pieces, x["i"]))
            mask = (lambda x: x["start"]) if len(groups) == 1 else (lambda x: x["end"] - F.length(pieces[f"g{groups[-1]}"][x["i"]]))
            return F.transform(made, lambda x: F.struct(x["start"], x["rank"], x["end"], mask(x).cast("bigint").alias("mask")))

        return _let(_starts(pieces), spans)

    may = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    return F.when(may, _let(_pieces(text, pattern, *groups), of).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


# --- models ---------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class MarkovRatio:
    """Log-likelihood ratios of transitions, random over ordinary: row 0 for the first character, then one row for each
    character of ``ALPHABET``; in each row one number for each character. A token is a secret from ``margin`` on."""

    ratios: tuple[float, ...]
    margin: float = MARGIN

    def of(self, token: Column) -> Column:
        """The log-likelihood ratio of a token whose characters are all in ``ALPHABET``."""
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratios)), ",").cast("array<double>")
        codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))))
        ratio = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c)), F.lit(0.0), lambda s, i: s + F.element_at(table, F.when(i > 1, F.element_at(c, F.greatest(i - 1, F.lit(1)))).otherwise(0) * len(ALPHABET) + F.element_at(c, i)))
        return _let(codes, ratio)


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """sample and label: generated random strings (1), and ordinary identifiers (0).

    The identifiers are words of up to ``SAMPLE_DOCS`` texts, the one with the smallest hash of each of so many classes of
    hashes (so copies of a text count once), alone and joined in the usual ways, with numbers and a short list; of each text
    the ``SAMPLE_WORDS`` different words with the smallest hashes. A bounded sample, whatever the size of the corpus: the
    hashes are reduced where texts are read, and only the chosen texts' words are shuffled. Null texts are not chosen; without any
    text the generated strings and the list remain.
    """
    spark = docs.sparkSession
    n = spark.range(SAMPLE_STRINGS, numPartitions=1).select(F.concat(F.lit("quiverlake"), F.col("id").cast("string")).alias("s"), "id")
    raw = F.sha2("s", 256)
    mixed = F.base64(F.unhex(raw))
    random = n.select(F.explode(F.array(F.substring(raw, 1, 40), F.substring(mixed, 1, 40), F.upper(F.substring(F.regexp_replace(mixed, "[+/=]", ""), 1, 20)), F.substring(F.translate(mixed, "+/=", "-_"), 3, 32), F.substring(F.regexp_replace(mixed, "[+/=]", ""), 1, 24), F.lower(F.substring(F.regexp_replace(mixed, "[^A-Za-z]", ""), 1, 32)))).alias("sample"))
    numbers = n.select(F.explode(F.array(F.substring(F.regexp_replace(F.conv(F.substring(raw, 1, 15), 16, 10), "^", "90"), 1, 16), F.date_format(F.timestamp_seconds(F.col("id") * 777_777), "yyyy-MM-dd_HH-mm-ss"))).alias("sample"))
    texts = docs.select(F.col(f"`{text}`").alias("text")).filter("text is not null").withColumn("h", F.xxhash64("text"))
    least = [r.h for r in texts.groupBy(F.pmod("h", F.lit(SAMPLE_DOCS)).alias("c")).agg(F.min("h").alias("h")).collect()]  # SAMPLE_DOCS numbers at most
    word = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    some = F.transform(F.slice(F.array_sort(F.transform(word, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("w")))), 1, SAMPLE_WORDS), lambda x: x["w"])
    words = texts.filter(F.col("h").isin(least)).select("h", some.alias("w")).groupBy("h").agg(F.first("w").alias("w")).filter("size(w) > 0")
    w, title = (lambda i: F.element_at("w", F.pmod(i, F.size("w")) + 1)), F.initcap
    each = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array(
        w(i), F.concat_ws("_", F.lower(w(i)), F.lower(w(i + 1)), F.lower(w(i + 2))), F.concat(F.lower(w(i)), title(w(i + 1)), title(w(i + 2))),
        F.concat_ws("-", w(i), w(i + 1)), F.concat_ws("/", w(i), w(i + 1), w(i + 2)), F.upper(F.concat_ws("_", w(i), w(i + 1))), F.concat(w(i), F.pmod(i, F.lit(100)).cast("string")),
    ))
    ordinary = words.select(F.explode(F.flatten(each)).alias("sample")).union(numbers).union(spark.createDataFrame([(x,) for x in PLAIN], "sample string"))
    return random.select("sample", F.lit(1).alias("label")).union(ordinary.select("sample", F.lit(0).alias("label")))


def train(labelled: DataFrame, smoothing: float = 0.5) -> MarkovRatio:
    """From (sample, label): transitions are counted by Spark, and at most two numbers for each pair of characters of the
    alphabet come to the driver. Characters outside the alphabet begin a new string; null and empty samples count for
    nothing; a class without samples is uniform."""
    n = len(ALPHABET)
    codes = F.transform(F.sequence(F.lit(1), F.length("sample")), lambda i: F.instr(F.lit(ALPHABET), F.substring(F.col("sample"), i, F.lit(1))))
    pairs = F.expr("transform(codes, (c, i) -> struct(if(i = 0, 0, codes[greatest(i - 1, 0)]) as prev, c as next))")
    rows = labelled.filter(F.length("sample") > 0).select("label", codes.alias("codes")).select("label", F.explode(pairs).alias("p"))
    counts = {(r.label, r.prev, r.next): r.n for r in rows.filter("p.next > 0").groupBy("label", "p.prev", "p.next").agg(F.count("*").alias("n")).collect()}
    out = []
    for prev in range(n + 1):
        total = [sum(counts.get((k, prev, c), 0) for c in range(1, n + 1)) for k in (0, 1)]
        for c in range(1, n + 1):
            p = [(counts.get((k, prev, c), 0) + smoothing) / (total[k] + smoothing * n) for k in (0, 1)]
            out.append(math.log(p[1] / p[0]))
    return MarkovRatio(tuple(out))


def _part(sample: str = "sample") -> Column:
    """The fifth that a string is in: 0 to 2 train the models, 3 chooses the margin, 4 is left for figures."""
    return F.pmod(F.xxhash64(sample), F.lit(5))


def learn(labelled: DataFrame, smoothing: float = 0.5, most_false: float = MOST_FALSE) -> MarkovRatio:
    """The models, and their margin, from (sample, label).

    Of the strings long enough to be scored in the fourth fifth, ``most_false`` of the ordinary ones may reach the margin;
    where all but one in a hundred of the random ones are above that, the margin is half way. Without strings of either
    class there the margin is ``MARGIN``. Repeated strings count as often as they occur, nulls for nothing.
    """
    model = train(labelled.filter(_part() < 3), smoothing)
    known = labelled.filter((_part() == 3) & F.col("sample").rlike(f"^[{ALPHABET[:-1]}-]{{{CANDIDATE_LEAST},}}$")).withColumn("ratio", model.of(F.col("sample")))
    at = known.agg(F.percentile(F.when(F.col("label") == 0, F.col("ratio")), F.lit(1 - most_false)).alias("ordinary"), F.percentile(F.when(F.col("label") == 1, F.col("ratio")), F.lit(0.01)).alias("random")).first()
    if at.ordinary is None or at.random is None:
        return model
    return MarkovRatio(model.ratios, round((at.ordinary + at.random) / 2 if at.random > at.ordinary else math.nextafter(at.ordinary, math.inf), 4))


def rates(labelled: DataFrame, model: MarkovRatio) -> DataFrame:
    """Of the last fifth, by length (of 16, 20, 24, 32 and 40 characters or more) and label: strings, and how many of them the
    model calls random."""
    known = labelled.filter((_part() == 4) & F.col("sample").rlike(f"^[{ALPHABET[:-1]}-]{{{CANDIDATE_LEAST},}}$"))
    length = F.element_at(F.filter(F.array(*map(F.lit, (16, 20, 24, 32, 40))), lambda x: x <= F.length("sample")), -1)
    return known.groupBy(length.alias("length"), "label").agg(F.count("*").alias("strings"), F.count_if(model.of(F.col("sample")) >= model.margin).alias("called_random"))


# --- detection ------------------------------------------------------------------------------------------------------
def _found(text: Column, model: MarkovRatio) -> tuple[Column, Column]:
    """The spans of the patterns and those of the models."""
    long = text.rlike(CANDIDATE)
    base = F.concat(
        _spans(text, ASSIGN, 0, (0, 2), lambda p, i: F.length(p["g2"][i]) >= ASSIGN_LEAST, text.rlike(ASSIGN_HINT)),
        _spans(text, ACCESS, 1, hint=long), _spans(text, HEX, 2, hint=long),
    )
    return F.sort_array(base), _spans(text, CANDIDATE, 3, (0,), lambda p, i: model.of(p["g0"][i]) >= model.margin)


def with_spans(df: DataFrame, model: MarkovRatio, text: str = "text") -> DataFrame:
    """Adds base_spans and spans, arrays of (start, rank, end, mask) in order of start and rank (the place of its kind in
    ``KINDS``); spans are code points, ends exclusive, and mask is where the secret itself begins.

    base_spans are those of the three patterns; spans also has all tokens that the models call random, whether a pattern
    finds them too or not, so spans of different kinds may overlap. A null or empty text has none, an empty table gives
    no row. Columns with these names are replaced, all others stay; rows may repeat, each with its own spans.
    """
    base, drawn = _found(F.coalesce(F.col(f"`{text}`"), F.lit("")), model)
    df = df.withColumn("base_spans", base).withColumn("spans", drawn)
    return df.withColumn("spans", F.when(F.size("spans") == 0, F.col("base_spans")).otherwise(F.sort_array(F.concat("base_spans", "spans"))))


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


_CHUNK = 4_096


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in chunks, without a walk from the text's beginning."""
    first = F.floor(a / _CHUNK).cast("int")
    some = F.array_join(F.slice(chunks, first + 1, F.floor(b / _CHUNK).cast("int") - first + 1), "")
    return F.substring(some, (a - first * _CHUNK + 1).cast("int"), (b - a).cast("int"))


def masked(text: Column, model: MarkovRatio) -> Column:
    """The text with the secrets of its spans, those that ``with_spans`` gives, replaced by ``MASK``: the values of assignments, access
    keys, hex runs and random tokens. Secrets that overlap become one mask, secrets that only touch one each. Texts
    without secrets, empty texts and nulls stay as they are. Masking goes by position, so it takes time in proportion to the
    text, and equal texts are masked alike."""

    def rebuilt(spans: Column) -> Column:
        ends, blocks = F.transform(spans, lambda x: x["end"]), F.floor((F.size(spans) - 1) / _BLOCK).cast("int")
        tops = F.transform(F.sequence(F.lit(0), blocks), lambda b: F.array_max(F.slice(ends, b * _BLOCK + 1, F.lit(_BLOCK))))

        def from_tops(top: Column) -> Column:
            def upto(i: Column) -> Column:  # the largest end of the spans before number i
                block = F.floor(i / _BLOCK).cast("int")
                return F.greatest(F.lit(0).cast("long"), F.array_max(F.slice(top, F.lit(1), block)), F.array_max(F.slice(ends, block * _BLOCK + 1, i - block * _BLOCK)))

            def from_chunks(chunks: Column) -> Column:
                def part(x: Column, i: Column) -> Column:
                    return _let(upto(i), lambda before: F.when(x["mask"] >= before, F.concat(_cut(chunks, before, x["mask"]), F.lit(MASK))).otherwise(F.lit("")))

                last = F.array_max(top)
                return F.concat(F.array_join(F.transform(spans, part), ""), _cut(chunks, last, F.length(text).cast("long")))

            return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), from_chunks)

        return _let(tops, from_tops)

    base, drawn = _found(text, model)
    found = F.array_sort(F.concat(base, drawn), lambda x, y: F.when(x["mask"] < y["mask"], -1).when(x["mask"] > y["mask"], 1).otherwise(F.lit(0)))
    return F.when(text.isNull(), text).otherwise(_let(found, lambda spans: F.when(F.size(spans) == 0, text).otherwise(rebuilt(spans))))


def mask_secrets(df: DataFrame, model: MarkovRatio, text: str = "text") -> DataFrame:
    """``df`` with its secrets masked in ``text``; all rows and other columns stay, whatever their names, repeated rows each by
    itself; an empty table stays empty."""
    return df.withColumn(text, masked(F.col(f"`{text}`"), model))
