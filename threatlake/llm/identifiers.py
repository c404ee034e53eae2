"""Personal data: patterns of four kinds, and identifiers that only their context gives away, found by bootstrapping.

Valid matches of the patterns are seeds. Their neighbouring words induce lexical patterns; the graph of patterns and instances is scored
to and fro, and instances that sure patterns point to are identifiers as well. All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake.llm.storage import cut_lineage, kept

#: Kinds in the order of the result, digits of a card and of a phone number.
KINDS, CARD_DIGITS, PHONE_DIGITS = ("email", "ip", "card", "phone"), (13, 19), (9, 15)
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns in a form without recursion or rescans: possessive repeats where what follows cannot begin inside, and starts in
#: the middle of a run only where a match has just ended. Same matches as the plain forms (tests compare them).
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit or an at sign, and words of digits that follow them after one space: where unseen identifiers may be.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9(][0-9().-]*+(?!\S))*+"
#: Characters on each side in which the words of a context are looked for, rounds of scoring, and characters of an unseen identifier.
REACH, ROUNDS, LONGEST = 64, 4, 128
#: A pattern counts from this share of seeds (one made-up instance against it), an instance is found from this score; least different seeds.
PATTERN_LEAST, FOUND_LEAST, SUPPORT = 0.75, 0.9, 3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digit text passes the checksum of card numbers."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: F.ascii(d) - 48)
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern is one of its kind: address parts up to 255, numbers of digits, checksum."""
    number = digits(match)
    part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    card = F.when(F.length(number).between(*CARD_DIGITS), luhn(number)).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, match.rlike(rf"^{part}(\.{part}){{3}}$")).when(kind == 2, card).otherwise(
        F.length(number).between(*PHONE_DIGITS))


def _occurrences(kind: int, found: str, gaps: str) -> Column:
    """Array of (kind, i, gap, match, left, right) from a column of matches and one of the text between them: each match, the length of the
    text since the last one, and the text on both sides."""
    m, g = F.col(found), F.col(gaps)
    return F.transform(m, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(g, i)).cast("long").alias("gap"), x.alias("match"),
        F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(g, i)), F.lit(REACH)).alias("left"),
        F.left(F.concat(F.get(g, i + 1), F.coalesce(F.get(m, i + 1), F.lit(""))), F.lit(REACH)).alias("right")))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((row, doc_id) of every row, (row, kind, match, start, stop, left, right) of every match): kinds 0 to 3, and 4 for candidates.

    The texts are read once; what is found is stored, so rows keep their numbers. Offsets are code points, running sums over the
    matches of one text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    patterns = [*PATTERNS.values(), CANDIDATE]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), whole.alias("text"))
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)])
    # matches and gaps are columns of their own, so the text is searched once a pattern and not once a match
    rows = rows.select("*", *[F.when(F.size(f"m{k}") > 0, F.split("text", p, -1)).alias(f"g{k}") for k, p in enumerate(patterns)])
    found = F.concat(*[_occurrences(k, f"m{k}", f"g{k}") for k in range(len(patterns))])
    stored = kept(rows.select("row", "doc_id", found.alias("found")), "identifiers")
    flat = stored.select("row", F.explode("found").alias("f")).select("row", "f.*").repartition("row")
    before = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    length = F.length("match").cast("long")
    start = F.coalesce(F.sum(F.col("gap") + length).over(before), F.lit(0)) + F.col("gap")
    return stored.select("row", "doc_id"), flat.select("row", "kind", "match", start.alias("start"), (start + length).alias("stop"), "left", "right")


def _trimmed(found: DataFrame) -> DataFrame:
    """Candidates without the signs around them; what then holds fewer than 4 characters or more than ``LONGEST`` is none."""
    loose = F.col("kind") == len(KINDS)
    lead = F.length(F.regexp_extract("match", r"^[^A-Za-z0-9+(]*+", 0))
    core = F.regexp_replace(F.regexp_replace("match", r"^[^A-Za-z0-9+(]++", ""), r"(?<![^A-Za-z0-9)])[^A-Za-z0-9)]++$", "")
    out = found.withColumns({"lead": F.when(loose, lead).otherwise(0), "core": F.when(loose, core).otherwise(F.col("match"))})
    out = out.withColumns({"start": F.col("start") + F.col("lead"), "match": F.col("core")}).withColumn("stop", F.col("start") + F.length("match"))
    return out.where(~loose | (F.length("match").between(4, LONGEST))).drop("lead", "core")


def _free(found: DataFrame) -> DataFrame:
    """Adds ``clear``: a candidate that no valid base match overlaps. Two ordered passes over the matches of each text."""
    seed = (F.col("kind") < len(KINDS)) & F.col("valid")
    order = ["start", "stop", "kind"]
    last = F.max(F.when(seed, F.col("stop"))).over(W.partitionBy("row").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    # the same running frame from the end: a frame that reaches to the end is worked out anew for each row
    following = F.min(F.when(seed, F.col("start"))).over(W.partitionBy("row").orderBy(*map(F.desc, order)).rowsBetween(W.unboundedPreceding, -1))
    apart = (last.isNull() | (last <= F.col("start"))) & (following.isNull() | (following >= F.col("stop")))
    return found.withColumn("clear", apart & (F.col("kind") == len(KINDS)))


def contexts(left: Column, right: Column) -> Column:
    """Lexical patterns around a place as side and lower-cased words: one and two words on the left, one on the right."""
    before = F.split(F.trim(F.regexp_replace(F.lower(left), r"\s+", " ")), " ")
    one, two = F.get(before, F.size(before) - 1), F.get(before, F.size(before) - 2)
    after = F.get(F.split(F.trim(F.regexp_replace(F.lower(right), r"\s+", " ")), " "), F.lit(0))
    patterns = F.array(
        F.struct(F.lit("l").alias("side"), F.concat(F.lit("1 "), one).alias("words")),
        F.struct(F.lit("l").alias("side"), F.concat(F.lit("2 "), two, F.lit(" "), one).alias("words")),
        F.struct(F.lit("r").alias("side"), F.concat(F.lit("1 "), after).alias("words")))
    return F.filter(patterns, lambda p: p["words"].isNotNull() & (F.length(p["words"]) > 2))


def _refused(match: Column, kind: int) -> Column:
    """Text that looks like ``kind`` and failed its check is none of that kind, whatever its context says."""
    number = F.length(digits(match))
    return {0: F.lit(False), 1: match.rlike(r"[0-9]+(\.[0-9]+){3}"), 2: match.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & number.between(*CARD_DIGITS),
            3: match.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]$")}[kind]


def _scored(graph: DataFrame, rounds: int) -> DataFrame:
    """(instance, kind) of the unseen identifiers, from ``graph`` (side, words, instance, seed: kind or null), distinct edges.

    A pattern's sureness of a kind is the share of its instances that are of that kind, one more counted against it; unsure ones and ones
    with few seeds count nothing. An instance is as sure as the best pattern of each side makes it, both sides independent. Found instances
    support patterns in the next round. Both steps are aggregates with partial sums, so a frequent word costs no more than a rare one.
    """
    scores = [F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(f"s{k}") for k in range(len(KINDS))]
    known = graph.select("side", "words", "instance", "seed", *scores)
    found = None
    for _ in range(rounds):
        sums = [F.sum(f"s{k}").alias(f"t{k}") for k in range(len(KINDS))]
        sure = known.groupBy("side", "words").agg(F.count("*").alias("n"), *sums)
        weights = [F.when((F.col(f"t{k}") >= SUPPORT) & (F.col(f"t{k}") >= PATTERN_LEAST * (F.col("n") + 1)), F.col(f"t{k}") / (F.col("n") + 1)).otherwise(0.0).alias(f"c{k}")
                   for k in range(len(KINDS))]
        sure = sure.select("side", "words", *weights).where(reduce(lambda a, b: a | b, [F.col(f"c{k}") > 0 for k in range(len(KINDS))]))
        reached = graph.where("seed IS NULL").select("side", "words", "instance").join(cut_lineage(sure), ["side", "words"])
        best = [F.max(F.when(F.col("side") == side, F.col(f"c{k}")).otherwise(0.0)).alias(f"{side}{k}") for side in "lr" for k in range(len(KINDS))]
        total = reached.groupBy("instance").agg(*best)
        total = total.select("instance", *[F.when(~_refused(F.col("instance"), k), 1 - (1 - F.col(f"l{k}")) * (1 - F.col(f"r{k}"))).otherwise(0.0).alias(f"f{k}")
                                           for k in range(len(KINDS))])
        top = F.greatest(*[F.col(f"f{k}") for k in range(len(KINDS))])
        kind = reduce(lambda rest, k: F.when(F.col(f"f{k}") == top, k).otherwise(rest), reversed(range(len(KINDS))), F.lit(None).cast("int"))
        found = cut_lineage(total.select("instance", kind.alias("kind"), top.alias("score")).where(F.col("score") >= FOUND_LEAST))
        renewed = graph.join(found, "instance", "left")
        known = renewed.select("side", "words", "instance", "seed", *[
            F.when(F.col("seed") == k, 1.0).when(F.col("seed").isNull() & (F.col("kind") == k), F.col("score")).otherwise(0.0).alias(f"s{k}") for k in range(len(KINDS))])
    return found.select("instance", "kind")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((row, doc_id) of every row, (row, kind, start, stop, match, base) of every identifier).

    ``base`` tells valid matches of the patterns from those that only their context gives away. Offsets are code points, end exclusive.
    Null texts count as empty; rows with null or repeated ids are rows of their own; texts are read whole, of any length; other columns are not
    looked at. An empty table gives empty ones. Instances are compared in lower case; equal ones share one decision.
    """
    rows, found = occurrences(docs, doc_id, text)
    checked = _trimmed(found).withColumn("valid", valid(F.col("kind"), F.col("match")))
    checked = cut_lineage(_free(checked).where((F.col("valid") & (F.col("kind") < len(KINDS))) | F.col("clear")))
    seed = F.when(F.col("kind") < len(KINDS), F.col("kind"))
    instance = F.lower("match")
    edges = checked.select(instance.alias("instance"), seed.alias("seed"), F.explode(contexts(F.col("left"), F.col("right"))).alias("p"))
    graph = cut_lineage(edges.groupBy("p.side", "p.words", "instance").agg(F.min("seed").alias("seed")).select("side", "words", "instance", "seed"))
    more = _scored(graph, rounds)
    base = checked.where(F.col("kind") < len(KINDS)).select("row", "kind", "start", "stop", "match", F.lit(True).alias("base"))
    unseen = checked.where("clear").select("row", "start", "stop", "match", instance.alias("instance")).join(more, "instance")
    return rows, base.unionByName(unseen.select("row", "kind", "start", "stop", "match", F.lit(False).alias("base")))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_found) per row: numbers and spans of valid base matches, and all spans.

    Spans are ``kind:start:end``, by kind as listed, then start, comma-joined; a row without any has empty text. Further rules: see ``spans``.
    """
    rows, found = spans(docs, doc_id, text, rounds)
    named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    place = F.struct("kind", "start", "stop", F.concat_ws(":", named, "start", "stop").alias("said"))
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]

    def joined(places):
        return F.concat_ws(",", F.transform(F.array_sort(places), lambda p: p["said"]))

    each = found.groupBy("row").agg(*counts, joined(F.collect_list(F.when(F.col("base"), place))).alias("base_spans"), joined(F.collect_list(place)).alias("spans"),
                                    F.count_if(~F.col("base")).alias("n_found"))
    full = rows.join(each, "row", "left")
    numbers = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return full.select("doc_id", *numbers, F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"),
                       F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))
