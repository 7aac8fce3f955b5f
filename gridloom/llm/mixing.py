"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Of all rates w between 0 and a cap, the one of least relative entropy to 1 that gives each
source its target of tokens is w = min(cap, exp(lambda x)), where x is a document's size over its
source's mean size and lambda solves the convex dual of the source's constraint. Newton steps
inside a shrinking bracket find lambda for all sources at once; each step is one aggregation
over the sizes' histogram, as documents of one source and size have one rate. Rates become
whole copies by systematic rounding along each source's sizes, and by a hash order inside
cells that are split until they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import beside, compact, dropped, ranged, running, stored, table

#: Most copies of a document; Newton steps at most; documents in a cell before it is split; steps of a rate.
CAP, STEPS, CELL, UNIT = 3, 100, 1024, 1_000_000


def source_targets(sizes: DataFrame, share: float = 1.0, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Targets of sources: rows (source, source_size, source_docs, target) from rows (source, size, k).

    Sources by code point (null last) weigh 1, 2, 3, repeating, and share ``share`` of all tokens;
    no target is above ``cap`` times its source's size, the excess is shared anew by weight until
    none is above. That fixed point is one threshold on size per weight, found by running sums.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"), F.sum("k").alias("source_docs"))
    s = running(ranged(s, ["source"], "mix-sources"), ["source"], {"i": F.lit(1).cast("long")}).drop("range_")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    # sources in the order in which they reach their caps: the level if all before are full
    s = running(ranged(s, ["ratio", "i"], "mix-sources"), ["ratio", "i"], {"full": F.col("most"), "weighed": F.col("weight")})
    s = stored(s.drop("range_"), "mix-sources", parts=4)
    total, weighed = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share), F.sum("weight")).first()
    level = (F.lit(total) - F.col("full") + F.col("most")) / (F.lit(weighed) - F.col("weighed") + F.col("weight"))
    # the first whose cap is above its level stays open, and all after it
    opened = s.where(F.col("ratio") >= level).agg(F.min(F.struct("ratio", "i", level.alias("level")))["level"]).first()[0]
    target = F.least("most", F.col("weight") * F.lit(float("inf") if opened is None else opened))
    return s.select("source", "source_size", "source_docs", target.alias("target"))


def balanced(cells: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """``cells`` (source, size, k) with source_size, target and rate, by Newton steps on each source's dual.

    Sizes of 0 get rate 1. Where a target is the cap times the source's size, all rates are the cap.
    """
    x = F.col("size") * F.col("source_docs") / F.col("source_size")  # size over the source's mean
    c = cells.join(targets, cells.source.eqNullSafe(targets.source)).select(cells.source, "size", "k", "source_size", "source_docs", "target")
    c = compact(c.where("size > 0").withColumn("x", x), "mix-cells")
    goal = F.col("target") * F.col("source_docs") / F.col("source_size")
    # at -60 rates vanish; above, x >= 1 in some cell, and ln(cap) / least x fills every cell
    state = stored(c.groupBy("source").agg(F.first(goal).alias("goal"), (F.log(F.lit(float(cap))) / F.min("x")).alias("hi"), F.sum(F.col("k") * F.col("x")).alias("mass"))
                   .select("source", "goal", F.lit(0.0).alias("lam"), (-F.lit(60.0) * F.greatest(F.lit(1.0), F.col("hi"))).alias("lo"), F.greatest("hi", F.lit(0.0)).alias("hi"), F.lit(False).alias("done")), "mix-state", parts=4)
    for _ in range(steps):
        s = state.alias("s")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0))))
        slope = F.when(F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0))) < cap, F.col("k") * F.col("x") * F.col("x") * rate).otherwise(0.0)
        step = c.alias("c").join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("source")).agg(
            F.first("goal").alias("goal"), F.first("lam").alias("lam"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
            F.sum(F.col("k") * F.col("x") * rate).alias("got"), F.sum(slope).alias("slope"),
        )
        over = F.col("got") > F.col("goal")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = step.withColumn("l", lo).withColumn("h", hi).withColumn("newton", F.col("lam") - (F.col("got") - F.col("goal")) / F.when(F.col("slope") > 0, F.col("slope")))
        inside = (F.col("newton") > F.col("l")) & (F.col("newton") < F.col("h"))
        done = (F.abs(F.col("got") - F.col("goal")) <= F.col("goal") * 1e-9) | (F.col("h") - F.col("l") <= F.lit(1e-13) * F.greatest(F.lit(1.0), F.abs("l")))
        step = step.select("source", "goal", F.when(done, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("l") + F.col("h")) / 2).alias("lam"), F.col("l").alias("lo"), F.col("h").alias("hi"), done.alias("done"))
        after = stored(step, "mix-state", parts=4)
        dropped(c.sparkSession, state)
        state = after
        if state.where("not done").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("the dual did not converge")
    lam = state.select(F.col("source").alias("s"), "lam")
    rate = F.when(F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12)), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0)))))
    positive = c.join(lam, c.source.eqNullSafe(F.col("s"))).select("source", "size", "source_size", "target", rate.alias("rate"))
    zero = cells.where("size = 0").join(targets.withColumnRenamed("source", "s"), cells.source.eqNullSafe(F.col("s"))).select("source", "size", "source_size", "target", F.lit(1.0).alias("rate")).distinct()
    return positive.unionByName(zero)


def rounded(parts: DataFrame, cap: int = CAP) -> DataFrame:
    """Whole copies for parts (source, size, part, k, rate): rows (s, z, p, whole, more).

    Every document of a part gets ``whole`` copies and ``more`` of them one extra. Along each
    source's sizes running sums are rounded, so the error is below half a long document; what is
    missing then moves into the rates of the shorter half, and what that leaves into the shortest
    tenth, which are rounded anew. Rates are whole numbers of 1/UNIT, so that sums don't depend on any order.
    """
    zero, line = F.lit(0).cast("long"), ["size", "part"]
    p = ranged(parts.withColumn("want", F.round(F.col("k") * F.col("rate") * F.col("size") * 1000).cast("long")), ["source", *line], "mix-ranged")
    p = running(p, line, {"seen": F.col("k")}, ["source"])
    docs = stored(parts.groupBy("source").agg(F.sum("k").alias("docs")), "mix-totals", parts=4)
    p = beside(p, docs, ["source"]).withColumn("rank", F.col("seen") / F.col("docs")).withColumn("whole", zero).withColumn("more", zero)
    p = p.select("source", "size", "part", "k", "rate", "want", "rank", "whole", "more", "range_")
    for share in (1.0, 0.5, 0.1):
        p = compact(p, "mix-rounds")
        inside = F.col("rank") <= share
        have = (F.col("k") * F.col("whole") + F.col("more")) * F.col("size") * 1000
        missing = F.sum(F.col("want") - have) if share < 1 else F.max(zero)
        room = F.sum(F.when(inside, F.col("k") * F.col("size")).otherwise(zero))
        q = beside(p, stored(p.groupBy("source").agg(missing.alias("missing"), room.alias("room")), "mix-totals", parts=4), ["source"])
        shift = F.when(inside & (F.col("room") > 0), F.col("missing") / F.when(F.col("room") > 0, F.col("room")) / 1000).otherwise(0.0)
        units = F.round(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("rate") + shift)) * UNIT).cast("long")
        q = q.withColumn("units", units).withColumn("rate", F.col("units") / UNIT).withColumn("rest", F.when(inside, F.col("k") * F.expr(f"units % {UNIT}")).otherwise(zero))
        q = running(q, line, {"run": F.col("rest")}, ["source"])
        more = F.expr(f"(run + {UNIT // 2}) div {UNIT} - (run - rest + {UNIT // 2}) div {UNIT}")
        p = q.withColumn("whole", F.when(inside, F.expr(f"units div {UNIT}")).otherwise(F.col("whole"))).withColumn("more", F.when(inside, more).otherwise(F.col("more")))
        p = p.select("source", "size", "part", "k", "rate", "want", "rank", "whole", "more", "range_")
    return p.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "whole", "more")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, by: str | None = None) -> DataFrame:
    """Rows (``key``, size, source_size, target, copies, taken), one for each row of ``docs``.

    size is the number of words ``[^\\x20\\x09-\\x0D]+``; null texts have 0. A null source is a source of
    its own. Documents of size 0 are taken once. Copies are at most ``cap``; rows of one key are
    rounded like any others, by a hash of ``by`` (the key, unless given) and text, and identical rows by an arbitrary but
    equal number. Reruns agree. Other columns are not carried; an empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    order = F.xxhash64(F.col(by or key), F.col(text))
    sized_docs = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), words.alias("size"), order.alias("h")), "mix-sizes")
    cells = compact(sized_docs.groupBy("source", "size").agg(F.count("*").alias("k")), "mix-histogram")
    targets = stored(source_targets(cells, share, weights, cap), "mix-targets", parts=4)
    rates = compact(balanced(cells, targets, cap), "mix-rates")

    # cells are split by the hash until one has about CELL documents
    cut = cells.join(rates.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), cells.source.eqNullSafe(F.col("s")) & (cells["size"] == F.col("z")))
    cut = compact(cut.select("source", "size", "source_size", "target", "rate", F.ceil(F.col("k") / CELL).alias("parts")), "mix-cut")
    d = sized_docs.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")))
    part = F.pmod(F.col("d.h"), F.col("parts"))
    d = compact(d.select("d.doc_id", "d.source", "d.size", "d.h", "source_size", "target", "rate", part.alias("part")), "mix-docs")
    small = d.groupBy("source", "size", "part").agg(F.count("*").alias("k"), F.first("rate").alias("rate"))
    small = compact(rounded(small, cap), "mix-parts")
    d = d.join(small, d.source.eqNullSafe(F.col("s")) & (d["size"] == F.col("z")) & (d.part == F.col("p")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    d = d.withColumn("copies", F.col("whole") + F.when(rank <= F.col("more"), 1).otherwise(0).cast("long"))
    return d.select(F.col("doc_id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
