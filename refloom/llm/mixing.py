"""Mixing sources to target weights by entropy balancing. Built-in functions only.

Of all rates that give each source its target number of words, with no document above three copies, the ones nearest to
"every document once" (in relative entropy) are r = min(3, exp(x * size / c)): one dual variable x per source. x solves a
convex problem; a distributed Newton iteration, kept inside a bracket, finds it for all sources at once. A rate depends
on source and size alone, so the iteration runs over cells (source, size, number of documents), aggregated once from the
documents, and its cost follows the number of different sizes. Rates become whole copies by systematic rounding along
the sizes of a source, which misses the target by no more than about one long document; moves of single cells then close
most of that gap. Which documents of a cell get the extra copy follows from a hash, found by counting hash ranges, and among equal
rows from their place, so that a cell with a third of all rows is not sorted in one task. Reruns give the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.common import n_words_of, text_of
from refloom.session import materialize

#: No document is taken more often than this.
MOST_COPIES = 3
#: Newton steps at most, and the relative miss of a target at which a source is done.
STEPS, CLOSE = 60, 1e-9
#: Moves of cells after rounding.
MOVES = 6
#: Sizes below a size that copies may move to.
SWAPS = 8


def source_key(source: Column) -> Column:
    """Text that sorts like the source by code points, with null last and apart from every text."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def row_columns(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> dict[str, Column]:
    """What the mix knows of a row: key of its source, size in words, and a hash that orders equal sizes."""
    return {
        "_skey": source_key(docs[source_col]),
        "_n": n_words_of(text_of(docs[text_col])),
        "_h": F.xxhash64(docs[id_col], docs[text_col]),
    }


def default_targets(sources: DataFrame) -> DataFrame:
    """Adds `target`: sources in order weigh 1, 2, 3, repeating, and share all words, none above MOST_COPIES times its own.

    What a full source cannot take is shared by weight among the others until none is above: sources fill in the order
    of limit / weight, and the common level is the one at which the first stays below its limit. The windows run
    over one row per source.
    """
    order = Window.orderBy("_skey")
    fill = Window.orderBy("_fill", "_skey")
    out = sources.withColumn("_w", (F.row_number().over(order) - 1) % 3 + 1)
    out = out.withColumn("_limit", MOST_COPIES * F.col("source_size")).withColumn("_fill", F.col("_limit") / F.col("_w"))
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("_limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_level", (total - before) / weights)
    level = F.max(F.when(F.col("_fill") > F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    out = out.withColumn("_common", level)
    full = (F.col("_fill") <= F.col("_level")) | F.col("_common").isNull()
    target = F.when(full, F.col("_limit").cast("double")).otherwise(F.col("_w") * F.col("_common"))
    return out.withColumn("target", target).drop("_w", "_limit", "_fill", "_level", "_common")


def _rate(x: str, n: str, scale: str) -> Column:
    return F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(F.col(x) * F.col(n) / F.col(scale), F.lit(2.0))))


def solve(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the dual variable x and its scale c to the sources; x is null where all documents or none are taken whole.

    cells: (_skey, _n, _k), sizes above 0. sources: (_skey, source_size, target).
    """
    shape = cells.groupBy("_skey").agg(
        F.min("_n").alias("_least"),
        F.max("_n").alias("_most"),
        (F.sum(F.col("_n") * F.col("_n") * F.col("_k")) / F.sum(F.col("_n") * F.col("_k"))).alias("_c"),
    )
    ratio = F.log(F.col("target") / F.col("source_size"))
    free = (F.col("target") > 0) & (F.col("target") < MOST_COPIES * F.col("source_size") * (1 - 1e-12))
    state = sources.join(shape, "_skey").where(free).withColumn("_r", ratio)
    near, wide = F.col("_r") * F.col("_c") / F.col("_most"), F.col("_r") * F.col("_c") / F.col("_least")
    top = F.log(F.lit(float(MOST_COPIES))) * F.col("_c") / F.col("_least")
    state = state.select(
        "_skey",
        "target",
        "_c",
        F.when(F.col("_r") < 0, wide).otherwise(near).alias("_lo"),
        F.when(F.col("_r") < 0, near).otherwise(top).alias("_hi"),
        F.col("_r").alias("_x"),
    )
    state = materialize(state.withColumn("_x", F.greatest("_lo", F.least("_hi", "_x"))).withColumn("_miss", F.lit(1.0)), "mix")
    for _ in range(STEPS):
        rate = _rate("_x", "_n", "_c")
        words = F.col("_n") * F.col("_k")
        both = cells.join(state, "_skey").groupBy("_skey").agg(
            (F.sum(words * rate) - F.first("target")).alias("_f"),
            F.sum(F.when(rate < MOST_COPIES, words * F.col("_n") / F.col("_c") * rate).otherwise(0.0)).alias("_d"),
        )
        step = state.join(both, "_skey")
        lo = F.when(F.col("_f") < 0, F.col("_x")).otherwise(F.col("_lo"))
        hi = F.when(F.col("_f") >= 0, F.col("_x")).otherwise(F.col("_hi"))
        step = step.withColumn("_lo", lo).withColumn("_hi", hi)
        newton = F.col("_x") - F.col("_f") / F.col("_d")
        # Both ends have one sign; their geometric mean halves the bracket on a scale of factors.
        middle = F.signum(F.col("_lo") + F.col("_hi")) * F.sqrt(F.abs(F.col("_lo") * F.col("_hi")))
        inside = (F.col("_d") > 0) & (newton > F.col("_lo")) & (newton < F.col("_hi"))
        miss = F.abs(F.col("_f")) / F.col("target")
        step = step.withColumn("_miss", miss).withColumn(
            "_x", F.when(miss < CLOSE, F.col("_x")).when(inside, newton).otherwise(middle)
        )
        state = materialize(step.select("_skey", "target", "_c", "_lo", "_hi", "_x", "_miss"), "mix")
        worst = state.agg(F.max("_miss")).first()[0]
        if worst is None or worst < CLOSE:
            break
    return sources.join(state.select("_skey", F.round("_x", 9).alias("_x"), "_c"), "_skey", "left")


def _best_move(near: DataFrame) -> DataFrame:
    """(_skey, _n, _move): per source the change of copies that brings it nearest to its target, if any does.

    Either copies of one cell are added (or taken away), or copies move between a cell and one of the `SWAPS` cells before
    it in the order of sizes, which changes the words by the difference of the two sizes.
    """
    up = F.col("_gap") > 0
    room = F.when(up, MOST_COPIES * F.col("_k") - F.col("_copies")).otherwise(F.col("_copies"))
    back = F.when(up, F.col("_copies")).otherwise(MOST_COPIES * F.col("_k") - F.col("_copies"))
    near = near.withColumn("_room", room).withColumn("_back", back)
    before = Window.partitionBy("_skey").orderBy("_n").rowsBetween(-SWAPS, -1)
    others = F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_back").alias("room"))).over(before)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("room"))
    near = near.withColumn("_others", others).withColumn("_o", F.explode(F.concat(F.array(none), "_others")))
    step = F.col("_n") - F.col("_o.n")
    most = F.least("_room", F.coalesce("_o.room", F.col("_room")))
    near = near.withColumn("_m", F.least(most, F.greatest(F.lit(1).cast("long"), F.floor(F.abs("_gap") / step + 0.5))))
    near = near.withColumn("_left", F.abs(F.abs("_gap") - F.col("_m") * step))
    near = near.where((F.col("_m") > 0) & (F.col("_left") < F.abs("_gap")))
    move = F.col("_m") * F.signum("_gap").cast("long")
    best = near.groupBy("_skey").agg(
        F.min(F.struct("_left", "_m", F.col("_n").alias("n"), F.col("_o.n").alias("other"), move.alias("move"))).alias("b")
    )
    both = F.array(
        F.struct(F.col("b.n").alias("_n"), F.col("b.move").alias("_move")),
        F.struct(F.col("b.other").alias("_n"), (-F.col("b.move")).alias("_move")),
    )
    return best.select("_skey", F.inline(both))


def cell_copies(cells: DataFrame, solved: DataFrame) -> DataFrame:
    """(_skey, _n, _k, _copies): whole copies of all documents of a cell together, between 0 and MOST_COPIES * _k."""
    full = F.when(F.col("target") > 0, F.lit(float(MOST_COPIES))).otherwise(F.lit(0.0))
    rated = cells.join(solved, "_skey").withColumn(
        "_rate", F.when(F.col("_x").isNull(), full).otherwise(_rate("_x", "_n", "_c"))
    )
    along = Window.partitionBy("_skey").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("_k") * F.col("_rate")).over(along)
    rated = rated.withColumn("_upto", F.floor(F.round(upto, 6) + 0.5))
    prior = F.lag("_upto", 1, 0).over(Window.partitionBy("_skey").orderBy("_n"))
    rated = rated.withColumn("_copies", F.greatest(F.lit(0), F.least(F.col("_upto") - prior, MOST_COPIES * F.col("_k"))))
    out = materialize(rated.select("_skey", "_n", "_k", "target", "_copies"), "mix-cells")
    for _ in range(MOVES):
        gap = out.groupBy("_skey").agg((F.first("target") - F.sum(F.col("_n") * F.col("_copies"))).alias("_gap"))
        near = out.join(gap, "_skey")
        best = _best_move(near)
        moved = out.join(best, ["_skey", "_n"], "left")
        moved = moved.withColumn("_copies", F.col("_copies") + F.coalesce("_move", F.lit(0))).drop("_move")
        out = materialize(moved, "mix-cells")
    return out.drop("target")


def _cut(rows: DataFrame, cuts: DataFrame, by: Column) -> DataFrame:
    """Per cell the value of `by` that holds the `_left`-th row, `_at`, and how many rows with it are to be taken.

    rows: (_skey, _n, ...), cuts: (_skey, _n, _left). Rows are counted per cell and value, which combines before the shuffle.
    """
    counts = rows.withColumn("_at", by).groupBy("_skey", "_n", "_at").agg(F.count("*").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy("_skey", "_n").orderBy("_at"))
    counts = counts.join(cuts, ["_skey", "_n"]).withColumn("_upto", upto)
    left = F.col("_left") - F.col("_upto") + F.col("_in")
    here = (left > 0) & (F.col("_upto") >= F.col("_left"))
    return counts.where(here).select("_skey", "_n", "_at", left.alias("_left"))


def last_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """(_skey, _n, _last, _last_row): the `_left`-th row of each cell in the order of hash and row number.

    rows: (_skey, _n, _h, _row); extra: (_skey, _n, _left). Found by counting ever smaller ranges: leading bits of the hash, more
    bits, the hash itself, and for rows with equal hashes (equal in id and text) the written part and the row in it. After
    the first step only the rows of the range that holds the place are kept, and no step sorts more than the rows or counts
    of one range, however many rows are equal.
    """
    inside, cuts = rows, extra
    for by in (F.shiftright("_h", 56), F.shiftright("_h", 40), F.col("_h"), F.shiftright("_row", 33)):
        cuts = materialize(_cut(inside, cuts, by), "mix-cut")
        inside = inside.join(cuts.select("_skey", "_n", "_at"), ["_skey", "_n"]).where(by == F.col("_at")).drop("_at")
        inside = materialize(inside, "mix-inside")
        cuts = cuts.select("_skey", "_n", "_left")
    last = _cut(inside, cuts, F.col("_row")).select("_skey", "_n", F.col("_at").alias("_row"))
    return inside.join(last, ["_skey", "_n", "_row"]).select("_skey", "_n", F.col("_h").alias("_last"), F.col("_row").alias("_last_row"))


def decisions(rows: DataFrame, sources_to_targets=default_targets) -> DataFrame:
    """(_skey, _n, source_size, target, _base, _last, _last_row): a row of the cell has _base copies, and one more up to the
    last one (see `last_extra`).

    rows: (_skey, _n, _h, _row), written. Documents without words have no cell; they take nothing.
    """
    cells = materialize(rows.groupBy("_skey", "_n").agg(F.count("*").alias("_k")), "mix-cells")
    sources = cells.groupBy("_skey").agg(F.sum(F.col("_n") * F.col("_k")).alias("source_size"))
    sources = materialize(sources_to_targets(sources), "mix-sources")
    some = cells.where("_n > 0")
    copies = cell_copies(some, solve(some, sources))
    copies = copies.withColumn("_base", F.floor(F.col("_copies") / F.col("_k"))).withColumn(
        "_extra", F.col("_copies") - F.col("_base") * F.col("_k")
    )
    extra = copies.where("_extra > 0").select("_skey", "_n", F.col("_extra").alias("_left"))
    last = last_extra(rows.where("_n > 0").select("_skey", "_n", "_h", "_row"), materialize(extra, "mix-extra"))
    out = cells.select("_skey", "_n").join(sources, "_skey").join(copies.select("_skey", "_n", "_base"), ["_skey", "_n"], "left")
    out = out.join(last, ["_skey", "_n"], "left")
    return materialize(out.withColumn("_base", F.coalesce("_base", F.lit(0))), "mix-decisions")


def copies_of_row() -> Column:
    more = (F.col("_h") < F.col("_last")) | ((F.col("_h") == F.col("_last")) & (F.col("_row") <= F.col("_last_row")))
    return (F.col("_base") + F.when(more, 1).otherwise(0)).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", sources_to_targets=default_targets
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) per row of docs.

    size counts words (null and empty texts: 0, taken 0 times); the null source is a source of its own. Rows that agree in id
    and text differ by one copy at most and meet the target together; which of them has the extra copy follows from their place.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), *[c.alias(k) for k, c in row_columns(docs, id_col, source_col, text_col).items()])
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    named = rows.join(decisions(rows.select("_skey", "_n", "_h", "_row"), sources_to_targets), ["_skey", "_n"])
    copies = F.when(F.col("_n") > 0, copies_of_row()).otherwise(0).cast("long")
    return named.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("size"),
        F.col("source_size"),
        F.col("target"),
        copies.alias("copies"),
        (copies * F.col("_n")).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of docs and nothing else.

    They are written once with what the mix knows of them, so that a row has one number in the decision and in the result.
    """
    keys = row_columns(docs, id_col, source_col, text_col)
    full = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), *[c.alias(k) for k, c in keys.items()])
    full = materialize(full.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    chosen = decisions(full.select("_skey", "_n", "_h", "_row")).select("_skey", "_n", "_base", "_last", "_last_row")
    full = full.join(chosen, ["_skey", "_n"]).where("_n > 0").withColumn("_copies", copies_of_row()).where("_copies > 0")
    return full.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")
