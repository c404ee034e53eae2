"""URL filter: allow and block rules, and a character language-model ratio where no rule speaks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlake.llm.storage import cut_lineage, kept

#: The rules of the registered query, rule -> verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Characters of the longest gram of the Markov models, and weight of the shorter context.
LONGEST, SMOOTH = 4, 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; null or without ``://``: both empty."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; null if none. A rule fits its host and all subdomains if the path starts with its path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def _marked(url: Column) -> Column:
    """Lower-cased url with a mark at both ends."""
    return F.concat(F.lit("\x02"), F.translate(url, _UPPER, _LOWER), F.lit("\x03"))


def _windows(rows: DataFrame, longest: int) -> DataFrame:
    """Column ``w`` for every character but the first mark of column ``u``: the character and up to ``longest`` - 1 before it."""
    i = F.col("i")
    return rows.withColumn("i", F.explode(F.sequence(F.lit(2), F.length("u")))).withColumn(
        "w", F.col("u").substr(F.greatest(i - (longest - 1), F.lit(1)), F.least(i, F.lit(longest)))).drop("i", "u")


def _keys(longest: int) -> list[Column]:
    """Keys of what a window counts for: the gram of every order, then the context of every order but the lowest, whose context is empty.

    Near the start a gram cannot reach back as far as its order says; it then counts once for each order.
    """
    grams = [F.right("w", F.lit(k + 1)) for k in range(longest)]
    return [F.concat(F.lit(f"g{k}"), g) for k, g in enumerate(grams)] + [
        F.concat(F.lit(f"c{k}"), F.substring(g, 1, F.length(g) - 1)) for k, g in enumerate(grams) if k]


def count_table(urls: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, allow, block): how often accepted and rejected urls have each gram of up to ``longest`` characters and each context.

    ``urls`` has url and verdict. Every gram and context has a row of its own, so the table grows with the different ones. Characters are
    counted by their longest window before the shuffle; the orders are sums over the different windows. The row of the empty key has the totals.
    """
    rows = urls.select(_marked(F.col("url")).alias("u"), (F.col("verdict") == "allow").cast("long").alias("good"))
    seen = _windows(rows, longest).groupBy("w").agg(F.sum("good").alias("allow"), F.sum(1 - F.col("good")).alias("block"))
    return seen.select("allow", "block", F.explode(F.array(F.lit(""), *_keys(longest))).alias("key")).groupBy("key").agg(
        F.sum("allow").cast("double").alias("allow"), F.sum("block").cast("double").alias("block"))


def window_ratios(windows: DataFrame, table: DataFrame, longest: int = LONGEST, smooth: float = SMOOTH) -> DataFrame:
    """(w, ratio) of the different windows in column ``w``: ln P_allow - ln P_block of their last character after the others.

    Each order's estimate leans on the next shorter one's; counts meet the windows' keys in one equi-join.
    """
    asked = windows.select("w").distinct().select("w", F.posexplode(F.array(*_keys(longest))).alias("slot", "key"))
    at = lambda name, slot: F.coalesce(F.max(F.when(F.col("slot") == slot, F.col(name))), F.lit(0.0))
    sides = ("allow", "block")
    found = asked.join(table, "key", "left").groupBy("w").agg(*(at(v, slot).alias(f"{v}{slot}") for v in sides for slot in range(2 * longest - 1)))
    logs = []
    for v in sides:
        total = table.where(F.col("key") == "").agg(F.coalesce(F.max(v), F.lit(0.0)).alias(v)).scalar()
        p = F.lit(1 / 256)
        for k in range(longest):
            p = (F.col(f"{v}{k}") + smooth * p) / ((F.col(f"{v}{longest + k - 1}") if k else total) + smooth)
        logs.append(F.ln(p))
    return found.select("w", (logs[0] - logs[1]).alias("ratio"))


def log_ratios(urls: DataFrame, table: DataFrame, longest: int = LONGEST, smooth: float = SMOOTH) -> DataFrame:
    """(url, ratio) of the different urls in column ``url`` (not null): the mean over characters of ln P_allow - ln P_block.

    The ratios of the different windows are stored, so Spark knows their size: a small table goes to the urls and no
    character is shuffled, a larger one meets them in a shuffle join. An empty url has ratio 0.
    """
    place = _windows(urls.select("url").distinct().withColumn("u", _marked(F.col("url"))), longest)
    mean = place.join(kept(window_ratios(place, table, longest, smooth), "windows"), "w").groupBy("url").agg(F.avg("ratio").alias("ratio"))
    return mean.select("url", F.when(F.length("url") > 0, F.col("ratio")).otherwise(0.0).alias("ratio"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: dict[str, str] | None = None, longest: int = LONGEST,
          folds: int = 5) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio, threshold) per row.

    Urls that a rule decides are the accepted and rejected examples. Four in five (by the url's hash) are counted; the
    fifth calibrates the threshold, where both classes lie equally many standard deviations away. Urls without a rule
    are allowed if their ratio reaches it. Without examples of both kinds the threshold is 0, which an empty url
    reaches. Null and empty urls have empty host and path and no rule. Repeated rows are judged alike; the models count them
    as often as they occur. ``ratio`` is null where a rule decides.
    """
    rules = rules or RULES
    host, path = host_and_path(F.col("__url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("__url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("decided", verdict_of(F.col("rule"), rules))
    known = rows.where(F.col("decided").isNotNull()).select(F.col("__url").alias("url"), F.col("decided").alias("verdict"))
    fold = F.pmod(F.hash("url"), F.lit(folds))
    table = kept(count_table(known.where(fold != 0), longest), "grams")
    tests = known.where(fold == 0)
    spread = tests.join(log_ratios(tests, table, longest), "url").groupBy("verdict").agg(
        F.avg("ratio").alias("mid"), (F.coalesce(F.stddev("ratio"), F.lit(0.0)) + 1e-6).alias("width"))
    part = lambda name, kind: F.max(F.when(F.col("verdict") == kind, F.col(name)))
    a, b, x, y = part("mid", "allow"), part("mid", "block"), part("width", "allow"), part("width", "block")
    threshold = cut_lineage(spread.agg(F.coalesce((a * y + b * x) / (x + y), F.lit(0.0)).alias("threshold")))
    rows = rows.withColumn("__key", F.coalesce("__url", F.lit("")))
    ratios = log_ratios(rows.where(F.col("decided").isNull()).select(F.col("__key").alias("url")), table, longest).withColumnRenamed("url", "__key")
    judged = rows.join(ratios, "__key", "left").withColumn("threshold", threshold.scalar())
    by_model = F.when(F.col("ratio") >= F.col("threshold"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"),
                         F.when(F.col("decided").isNull(), F.col("ratio")).alias("ratio"), "threshold")
