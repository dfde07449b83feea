"""Personal data by patterns, and more of it by bootstrapped contextual extraction.

Base patterns give seeds. The words before a seed are a lexical pattern; a
graph joins patterns to the identifiers (instances) that stand after them.
Instances and patterns are scored in turn from the seeds. Patterns that are
held by several seeds, that hardly any other kind of string follows, and that
in the whole corpus are hardly ever without an identifier, discover further
identifiers that no base pattern finds. Those are seeds of the next scoring,
until nothing new comes. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.sources.shared import spread

from .common import BROADCAST_ROWS, ROW, SPACE, checkpoint, table

KINDS = ["email", "ip", "card", "phone", "learned"]

# Possessive and anchored forms of the base patterns: the same matches, in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Strings that may be identifiers: six digits or more with up to four letters before, or a name at a host.
NUMBER = r"(?<![0-9A-Za-z+.])\+?[A-Za-z]{0,4}[0-9](?:[\x20().\x2F-]{0,2}[0-9]){5,}+"
HANDLE = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9.-]++"

#: Least number of different seeds that a pattern must have.
SEEDS = 3
#: Rounds of scoring, and the least score of a pattern that discovers.
ROUNDS, CONFIDENCE = 3, 0.8
#: Least share of a pattern's appearances in the corpus that an identifier follows.
SPECIFIC = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether digits pass Luhn's check."""
    turned = F.reverse(x)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _card(x: Column) -> Column:
    return F.length(_digits(x)).between(14, 19) & _luhn(_digits(x))


def _ip(x: Column) -> Column:
    return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")


def _phone(x: Column) -> Column:
    return F.length(_digits(x)).between(10, 15)


def _words_before(piece: Column) -> Column:
    """The two words that end a text, followed by white space, in lower case with one space between; empty if there aren't two.

    The text is read from its end, so the work is in proportion to its length
    and a word may be as long as it likes.
    """
    last = F.regexp_extract(F.reverse(piece), r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)", 1)
    return F.lower(F.regexp_replace(F.reverse(last), SPACE, " "))


_SPAN = "array<struct<start:int,end:int,value:string,before:string>>"


def _matches(text: Column, pattern: str, mark: str, valid: Callable[[Column], Column] | None, context: bool = False) -> Column:
    """The matches of a pattern (leftmost, non-overlapping) that are valid, with their places in code points.

    The text between matches comes from a split at the same pattern; lengths
    add up to places. ``mark`` is a string that every match has.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["value"])
        before = _words_before(x["piece"]) if context else F.lit(None).cast("string")
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"))
        more = F.array_append(acc["spans"], span)
        spans = F.when(valid(x["value"]), more).otherwise(acc["spans"]) if valid else more
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), spans.cast(_SPAN).alias("spans")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    found = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    has = text.contains(mark) & text.rlike(pattern) if mark else text.rlike(pattern)
    return F.when(has, found).otherwise(F.array().cast(_SPAN))


def spans(docs: DataFrame) -> DataFrame:
    """Row number, doc_id, base spans (start, kind, end) and possible identifiers of each row of ``docs``."""
    text = F.col("__text")
    row = F.monotonically_increasing_id().alias(ROW)  # kept with the spans
    rows = spread(docs.select(row, "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text")))
    found = rows.select(
        ROW,
        "doc_id",
        _matches(text, EMAIL, "@", None).alias("k0"),
        _matches(text, IP, ".", _ip).alias("k1"),
        _matches(text, CARD, "", _card).alias("k2"),
        _matches(text, PHONE, "+", _phone).alias("k3"),
        _matches(text, NUMBER, "", None, context=True).alias("number"),
        _matches(text, HANDLE, "@", None, context=True).alias("handle"),
    )
    def of_kind(i: int) -> Column:
        return F.transform(f"k{i}", lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    base = F.concat(*map(of_kind, range(4)))
    return found.select(ROW, "doc_id", F.array_sort(base).alias("base"), "number", "handle")


def _occurrences(found: DataFrame) -> DataFrame:
    """One row for each possible identifier: its pattern (kind and the two words before) and whether it is a seed."""
    each = [
        found.select(ROW, "base", F.lit(kind).alias("kind"), F.explode(kind).alias("x")) for kind in ("number", "handle")
    ]
    return (
        each[0]
        .unionByName(each[1])
        .select(
            ROW,
            "kind",
            F.col("x.start").alias("start"),
            F.col("x.end").alias("end"),
            F.xxhash64(F.when(F.col("kind") == "number", _digits(F.col("x.value"))).otherwise(F.lower("x.value"))).alias("value"),
            F.col("x.before").alias("words"),
            F.exists("base", lambda b: (b["start"] < F.col("x.end")) & (F.col("x.start") < b["end"])).alias("seed"),
        )
        .where("words <> ''")
    )


def _seen(docs: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """How often the words of each pattern stand in the corpus, identifiers after them or not."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), SPACE, -1), lambda w: w != "")
    first, second = F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1)
    pairs = docs.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.arrays_zip(first.alias("a"), second.alias("b"))).alias("p"))
    every = pairs.select(F.xxhash64("p.a", "p.b").alias("pair"))
    two = F.split("words", " ")
    wanted = patterns.select("words").distinct().withColumn("pair", F.xxhash64(two[0], two[1]))
    count = F.count(F.lit(1)).alias("n_seen")
    if n > BROADCAST_ROWS:  # the join shuffles: frequent pairs are counted before it
        return every.groupBy("pair").agg(count).join(wanted, "pair").select("words", "n_seen")
    return every.join(F.broadcast(wanted), "pair").groupBy("words").agg(count)


def _bootstrap(graph: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns (kind, words) that enough seeds hold, and those of them that are trusted, when nothing new comes.

    ``graph`` has kind, words and value, ``seeds`` kind and value. What a
    trusted pattern holds counts as a seed for all patterns from then on, so
    a pattern once trusted stays so. Each turn adds a seed or is the last one.
    """
    pattern = ["kind", "words"]
    while True:
        marked = graph.join(seeds.withColumn("seed", F.lit(1.0)), ["kind", "value"], "left").withColumn("seed", F.coalesce("seed", F.lit(0.0)))
        marked = checkpoint(marked)
        held = marked.groupBy(*pattern).agg(F.sum("seed").alias("seeds")).where(F.col("seeds") >= SEEDS).select(*pattern)
        held = checkpoint(held)
        if held.isEmpty():
            return held, held
        part = checkpoint(marked.join(held, pattern, "left_semi"))
        scores = part.groupBy("kind", "value").agg(F.max("seed").alias("score"), F.max("seed").alias("seed"))
        for _ in range(ROUNDS):
            patterns = part.drop("seed").join(scores, ["kind", "value"]).groupBy(*pattern).agg(F.avg("score").alias("trust"))
            instances = part.drop("seed").join(patterns, pattern).groupBy("kind", "value").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("by_pattern")
            )
            scores = checkpoint(
                scores.join(instances, ["kind", "value"]).select(
                    "kind", "value", F.greatest("seed", "by_pattern").alias("score"), "seed"
                )
            )
        patterns = part.drop("seed").join(scores, ["kind", "value"]).groupBy(*pattern).agg(F.avg("score").alias("trust"))
        trusted = checkpoint(patterns.where(F.col("trust") >= CONFIDENCE).select(*pattern))
        new = checkpoint(part.where("seed = 0").join(trusted, pattern, "left_semi").select("kind", "value").distinct())
        if new.isEmpty():
            return held, trusted
        seeds = checkpoint(seeds.unionByName(new))


def learn(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """Identifiers (row number, start, end) that trusted patterns discover; None if no pattern does."""
    occurrences = checkpoint(_occurrences(found))
    pattern = ["kind", "words"]
    edges = occurrences.groupBy(*pattern, "value").agg(
        F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("seed")).alias("n_free")
    )
    edges = checkpoint(edges)
    seeds = checkpoint(edges.where("seed").select("kind", "value").distinct())
    # patterns with fewer values never have the seeds, and where all is base spans, there is nothing to discover or to seed
    able = edges.groupBy(*pattern).agg(
        F.count(F.lit(1)).alias("values"), F.sum("n").alias("n_followed"), F.sum("n_free").alias("free")
    )
    able = checkpoint(able.where((F.col("values") >= SEEDS) & (F.col("free") > 0)).select(*pattern, "n_followed"))
    graph = checkpoint(edges.select(*pattern, "value").join(able, pattern, "left_semi"))
    if graph.isEmpty():
        return None
    seeds = checkpoint(seeds.join(graph, ["kind", "value"], "left_semi"))
    if graph.count() <= BROADCAST_ROWS:  # rounds over a small graph needn't shuffle
        graph, seeds = checkpoint(graph.coalesce(1)), checkpoint(seeds.coalesce(1))
    # more patterns only raise scores, so what isn't held here, never is: its words needn't be counted
    held, trusted = _bootstrap(graph, seeds)
    if trusted.isEmpty():
        return None
    held = checkpoint(able.join(held, pattern))
    n = held.count()
    seen = checkpoint(_seen(docs, held, n))
    known = checkpoint(held.join(seen, "words").where(F.col("n_followed") >= SPECIFIC * F.col("n_seen")).select(*pattern))
    if known.isEmpty():
        return None
    specific = graph.join(F.broadcast(known) if n <= BROADCAST_ROWS else known, pattern, "left_semi")
    _, trusted = _bootstrap(checkpoint(specific), seeds)
    new = occurrences.where(~F.col("seed")).join(trusted, pattern, "left_semi").select(ROW, "start", "end").distinct()
    return checkpoint(new)


def find(docs: DataFrame) -> DataFrame:
    """Personal data of each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned.

    Spans are kind:start:end in code points, by start and kind. A null text
    counts as empty and has no spans. A text of any length is read whole, with
    words of any length as contexts. Base spans hang on the row alone;
    repeated rows have equal results, and each counts as an appearance of its
    contexts. Patterns that tie are trusted alike. An empty table gives no rows; further
    columns are ignored.
    """
    found = checkpoint(spans(docs))
    new = learn(docs, found)
    rows = found.select(ROW, "doc_id", "base")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if new is None:
        rows = rows.withColumn("more", none)
    else:
        one = F.struct(F.col("start").alias("start"), F.lit(4).alias("kind"), F.col("end").alias("end"))
        per_doc = new.groupBy(ROW).agg(F.collect_list(one).alias("more"))  # of one document each
        rows = rows.join(per_doc, ROW, "left").withColumn("more", F.coalesce("more", none))

    def told(x: Column) -> Column:
        kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = map(count, range(4))
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        told(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_learned"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(table(spark, sf_dir, "documents"))
