"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threatlake.llm.storage import cut_lineage

#: Weights of the sources in order, share of all sizes that the mix holds, and passes over a source at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Hexadecimal digits of the hash that cut a source into parts; slots of a unit of virtual time, and of each slot again.
PART_DIGITS, SLOTS = 3, 4096


def word_count(text: str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(missing, name, source_size, target) of the sources in (missing, name, source_size).

    All targets together hold ``share`` of all sizes, by weight; none is above ``passes`` times its source. Raising the
    common level until that many words are placed is what resharing the excess again and again ends in. One row per
    source passes through a window; documents never do.
    """
    order = W.orderBy("missing", "name")
    by_room = W.orderBy("room", "missing", "name").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    x = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double"))
    x = x.withColumn("cap", (F.col("source_size") * passes).cast("double")).withColumn("room", F.col("cap") / F.col("weight"))
    x = x.select("*", F.coalesce(F.sum("cap").over(by_room), F.lit(0.0)).alias("full"), F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)).alias("gone"),
                 (F.sum("source_size").over(everything) * share).alias("budget"), F.sum("weight").over(everything).alias("heavy"))
    x = x.withColumn("level", (F.col("budget") - F.col("full")) / (F.col("heavy") - F.col("gone")))
    first = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "missing", "name", "level"))).over(everything)
    x = x.withColumn("level", first["level"])
    return x.select("missing", "name", "place", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def _keys(doc_id: str, text: str, source: str) -> list[Column]:
    """doc_id, source, size and hash of a row; the hash is of id and text, so rows of one id, or without one, lie apart."""
    spelled = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.md5(spelled.cast("binary")).alias("hash")]


def _decisions(rows: DataFrame, weights: tuple, share: float, passes: int) -> DataFrame:
    """(doc_id, source, size, hash, source_size, target, copies) once per different row of ``_keys``.

    Equal rows are counted before the first shuffle, so a much repeated row is one entry of the queue."""
    same = rows.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    same = cut_lineage(same.withColumn("missing", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).withColumn(
        "part", F.substring("hash", 1, PART_DIGITS)).withColumn("words", F.col("size") * F.col("n")))
    parts = same.groupBy("missing", "name", "part").agg(F.sum("words").alias("part_size"))
    goals = cut_lineage(targets(parts.groupBy("missing", "name").agg(F.sum("part_size").alias("source_size")), weights, share, passes))
    ahead = W.partitionBy("missing", "name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))).join(goals, ["missing", "name"]).select(
        "missing", "name", "part", "ahead", "place", "source_size", "target")
    queue = W.partitionBy("missing", "name", "part").orderBy("hash", "doc_id", "size")
    placed = same.join(parts, ["missing", "name", "part"]).withColumn("run", F.col("ahead") + F.sum("words").over(queue))
    finish = [F.when(F.col("target") > 0, (F.col("run") + F.col("source_size") * k) / F.col("target")).otherwise(0.0) for k in range(passes)]
    placed = cut_lineage(placed.withColumn("finish", F.array(*finish)).select(
        "doc_id", "source", "size", "words", "source_size", "target", "place", "hash", "finish"))

    budget = goals.agg(F.sum("target").alias("budget")).scalar()
    entry = F.struct(F.col("time"), F.col("place"), F.col("hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size"))
    entries = placed.where("words > 0").withColumn("time", F.explode("finish"))
    upto = W.orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends, before = [], F.lit(0)
    for level in (1, 2):  # the slot in which the budget ends, then the part of it in which it ends
        slot = F.floor(F.col("time") * SLOTS**level).alias("slot")
        here = entries if not ends else entries.where(F.floor(F.col("time") * SLOTS) == ends[0])
        filled = here.groupBy(slot).agg(F.sum("words").alias("n")).withColumn("upto", F.sum("n").over(upto) + before)
        last = cut_lineage(filled.where(F.col("upto") > budget).agg(
            F.min_by(F.struct("slot", (F.col("upto") - F.col("n")).alias("before")), "slot").alias("at"), F.lit(0).alias("one")))
        ends.append(last.select(F.coalesce("at.slot", F.lit(2**62))).scalar())
        before = last.select(F.coalesce("at.before", F.lit(0))).scalar()
    fits = W.partitionBy("slot").orderBy("entry")
    ending = entries.select(entry.alias("entry"), "words", F.floor(F.col("time") * SLOTS**2).alias("slot")).where(F.col("slot") == ends[1])
    end = cut_lineage(ending.withColumn("run", F.sum("words").over(fits) + before).where(F.col("run") <= budget).agg(F.max("entry").alias("entry")))
    limit = end.scalar()
    chosen = F.lit(0)
    for k in range(passes):
        time = F.col("finish")[k]
        mine = F.struct(time.alias("time"), F.col("place"), F.col("hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size"))
        slot = F.floor(time * SLOTS**2)
        taken = (slot < ends[1]) | ((slot == ends[1]) & F.coalesce(mine <= limit, F.lit(False)))
        chosen = chosen + taken.cast("int")
    copies = F.when(F.col("size") > 0, chosen).otherwise(0).alias("copies")
    return placed.select("doc_id", "source", "size", "hash", "source_size", "target", copies)


def _decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source, size, hash) and the source_size, target and copies of their decision."""
    d = decisions.select("hash", "size", F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "source_size", "target", "copies")
    alike = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
    return rows.alias("r").join(d.alias("d"), (F.col("r.hash") == F.col("d.hash")) & (F.col("r.size") == F.col("d.size")) & alike).select(
        "r.*", "source_size", "target", "copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs``.

    Documents of a source queue in the order of a hash of id and text; a document's virtual finish time in a pass is the
    running number of its source's words over the source's target. All entries of all passes are ordered by finish
    time (ties: source, hash, id, size) and taken until the budget is full; ``copies`` says how many entries of the
    document are in the mix, ``taken`` is that times its size. Empty texts have size 0 and take nothing. A null
    source is a source, the last one. Rows equal in id, source and text are counted first and share one place and one
    decision; rows with a null or repeated id and other texts have places of their own. No source lies in one task:
    queues are cut by hash digits, and only the slot of a slot of time in which the budget ends is sorted.
    """
    rows = cut_lineage(docs.select(*_keys(doc_id, text, source)))
    return _decided(rows, _decisions(rows, weights, share, passes)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
               share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as the mix takes it; columns of any name are kept."""
    plan = _decisions(docs.select(*_keys(doc_id, text, source)), weights, share, passes).where("copies > 0")
    held = docs.select(F.struct(*docs.columns).alias("row"), *_keys(doc_id, text, source))
    return _decided(held, plan).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same rows as ``mix`` for another engine.
SQL = """
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS hash, row_number() OVER () AS nr FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, list_extract([3.0::DOUBLE, 1.0, 2.0], ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT) AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sources),
levels AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS room,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER ahead, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level
  FROM weighed WINDOW ahead AS (ORDER BY 2.0 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, place, source_size, least(cap, weight * (SELECT level FROM levels WHERE level <= room ORDER BY room, source IS NULL, source LIMIT 1))::DOUBLE AS target FROM levels),
queued AS (
  SELECT r.nr, r.doc_id, r.source, r.size, r.hash, g.place, g.source_size, g.target,
         sum(r.size) OVER (PARTITION BY g.place ORDER BY r.hash, r.doc_id, r.size) AS run
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source),
entries AS (
  SELECT *, CASE WHEN target > 0 THEN (run + k * source_size)::DOUBLE / target ELSE 0 END AS finish FROM queued, (VALUES (0), (1)) AS passes(k)),
ordered AS (SELECT *, sum(size) OVER (ORDER BY finish, place, hash, coalesce(doc_id::VARCHAR, ''), size) AS filled FROM entries)
SELECT doc_id, size, source_size, any_value(target) AS target,
       (sum(CASE WHEN filled <= (SELECT sum(target) FROM goals) THEN size ELSE 0 END))::BIGINT AS taken
FROM ordered GROUP BY nr, doc_id, size, source_size
"""
