"""Points in boxes, from a quadtree of totals.

Cells are squares of ``2 ** -level`` degrees, so that cell borders are exact doubles. Each box takes the level at which it is
at most ``side`` cells wide, whatever its size. Its inside is covered by whole cells of that level and the coarser ones above it,
as large as fit, which are answered from totals; only the cells on its border meet single points. A box thus takes a number of cells
that depends on ``side`` alone, and a full cell in its middle costs one row. Points are keyed for the levels in use only.

Boxes are closed and end at ±90 and ±180 degrees; points beyond these, or without a place, are in no box.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ALL_LEVELS = range(-9, 25)
SIDE = 32
CELL = ("_at", "_i", "_j")  # level and place of a cell
BORDER = -1
FINEST_SMALL = 14  # some seven metres
WHOLE_FROM = 4  # side from which whole cells are looked for


def with_levels(boxes: DataFrame, side: Column | int = SIDE, ladder: range = ALL_LEVELS) -> DataFrame:
    """Add ``_level``, the finest one of ``ladder`` at which the box is at most ``side`` cells wide, and ``_depth``, the coarser
    levels that it may use."""
    clipped = {
        "_south": F.greatest("south", F.lit(-90.0)), "_north": F.least("north", F.lit(90.0)),
        "_west": F.greatest("west", F.lit(-180.0)), "_east": F.least("east", F.lit(180.0)),
        "_side": F.lit(side).cast("double") if isinstance(side, int) else side.cast("double"),
    }
    wide = "greatest(_north - _south, _east - _west)"
    finest = ladder[-1]
    fitting = f"CASE WHEN {wide} > _side * {2.0**-finest!r}D THEN floor(log2(_side / {wide})) ELSE {finest} END"
    on_ladder = f"floor(({fitting} - {ladder[0]}) / {ladder.step}) * {ladder.step} + {ladder[0]}"
    return boxes.withColumns(clipped).filter("_south <= _north AND _west <= _east").withColumns({
        "_level": F.expr(f"cast(greatest({on_ladder}, {ladder[0]}) AS int)"),
        "_depth": F.expr("greatest(cast(floor(log2(_side)) AS int) - 1, 0)"),
    })


def cells(boxes: DataFrame, side: Column | int = SIDE, ladder: range = ALL_LEVELS) -> DataFrame:
    """One row for each cell of each box: ``_step`` is BORDER for a cell on the border (of the box's own level), else the
    number of levels by which a whole cell is coarser; ``_at``, ``_i``, ``_j`` name the cell."""

    def runs(step: str, *ends: tuple[str, str]) -> str:
        return ", ".join(f"named_struct('step', {step}, 'i', i, 'low', {low}, 'high', {high})" for low, high in ends)

    # the cells wholly inside, for each number of levels above the box's own: rows i to k, columns j to l
    inner = """transform(sequence(0, _depth), s -> named_struct('i', ceil(_s / shiftleft(1, s)), 'k', floor(_n / shiftleft(1, s)) - 1,
        'j', ceil(_w / shiftleft(1, s)), 'l', floor(_e / shiftleft(1, s)) - 1))"""
    own, above = "_in[s]", "_in[s + 1]"
    in_above = f"s < _depth AND {above}.j <= {above}.l AND shiftright(i, 1) BETWEEN {above}.i AND {above}.k"
    each = f"""CASE WHEN {in_above} THEN array({runs("s", (f"{own}.j", f"2 * {above}.j - 1"), (f"2 * {above}.l + 2", f"{own}.l"))})
               ELSE array({runs("s", (f"{own}.j", f"{own}.l"))}) END"""
    rows = f"CASE WHEN {own}.i <= {own}.k THEN sequence({own}.i, {own}.k) ELSE cast(array() AS array<bigint>) END"
    whole = f"flatten(transform(sequence(0, _depth), s -> flatten(transform({rows}, i -> {each}))))"
    edge = f"""CASE WHEN i BETWEEN _in[0].i AND _in[0].k AND _in[0].j <= _in[0].l
               THEN array({runs(str(BORDER), ("floor(_w)", "_in[0].j - 1"), ("_in[0].l + 1", "floor(_e)"))})
               ELSE array({runs(str(BORDER), ("floor(_w)", "floor(_e)"))}) END"""
    touched = "sequence(floor(_s), floor(_n))"
    few = f"transform({touched}, i -> {runs(str(BORDER), ('floor(_w)', 'floor(_e)'))})"  # small boxes are all border
    many = f"concat({whole}, flatten(transform({touched}, i -> {edge})))"
    scaled = {f"_{c[1]}": F.expr(f"{c} * pow(2.0D, _level)") for c in ("_south", "_north", "_west", "_east")}
    found = (
        with_levels(boxes, side, ladder)
        .withColumns(scaled)
        .withColumn("_in", F.expr(f"CASE WHEN _side >= {WHOLE_FROM} THEN {inner} END"))
        .select(*boxes.columns, "_level", F.expr(f"inline(CASE WHEN _side >= {WHOLE_FROM} THEN {many} ELSE {few} END)"))
    )
    return found.filter("low <= high").select(
        *boxes.columns, F.col("step").alias("_step"), F.expr("_level - greatest(step, 0)").alias("_at"), F.col("i").alias("_i"),
        F.explode(F.expr("sequence(low, high)")).alias("_j"),
    )


def _levels(boxes: DataFrame, side: Column | int, ladder: range = ALL_LEVELS) -> Column:
    """The levels in use, as one row: ``own`` of border cells, ``whole`` of whole ones."""
    levels = with_levels(boxes, side, ladder).select("_level", "_depth").distinct()
    whole = "array_distinct(flatten(collect_list(sequence(_level - _depth, _level))))"
    return levels.agg(F.struct(F.collect_set("_level").alias("own"), F.expr(whole).alias("whole"))).scalar()


def _on_levels(points: DataFrame, latitude: str, longitude: str, levels: Column) -> DataFrame:
    """One row for each point and level, with its cell there."""
    known = points.filter(F.col(latitude).between(-90.0, 90.0) & F.col(longitude).between(-180.0, 180.0))
    return known.select("*", F.explode(levels).alias("_at")).select(
        "*", F.expr(f"floor({latitude} * pow(2.0D, _at))").alias("_i"), F.expr(f"floor({longitude} * pow(2.0D, _at))").alias("_j")
    )


def _inside(latitude: str, longitude: str) -> Column:
    return F.col(latitude).between(F.col("south"), F.col("north")) & F.col(longitude).between(F.col("west"), F.col("east"))


def _met(asked: DataFrame, whole: DataFrame, single: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Whole cells with what ``whole`` holds for them, border cells with the points of ``single`` inside the box."""
    held = whole.withColumn("_border", F.lit(False)).unionByName(single.withColumn("_border", F.lit(True)))
    met = asked.withColumn("_border", F.col("_step") == BORDER).join(held, ["_border", *CELL])
    return met.filter(~F.col("_border") | _inside(latitude, longitude)).drop("_border", "_step", *CELL)


def sums(
    boxes: DataFrame, points: DataFrame, latitude: str, longitude: str, names: Sequence[str], by: Sequence[str] = (), side: Column | int = SIDE,
    ladder: range = ALL_LEVELS,
) -> DataFrame:
    """Rows of partial sums of ``names`` over the points in each box, one for each of its cells and border points; ``by``
    splits them further. Points at one place should be summed already. The levels in use are read from the boxes.
    """
    levels = _levels(boxes, side, ladder)
    own, above = levels["own"], levels["whole"]
    place = [F.lit(None).cast("double").alias(c) for c in (latitude, longitude)]
    totals = _on_levels(points, latitude, longitude, above).groupBy(*CELL, *by).agg(*[F.sum(name).alias(name) for name in names])
    single = _on_levels(points, latitude, longitude, own).select(*totals.columns, latitude, longitude)
    return _met(cells(boxes, side, ladder), totals.select("*", *place), single, latitude, longitude).drop(latitude, longitude)


def small_sums(
    boxes: DataFrame, points: DataFrame, latitude: str, longitude: str, names: Sequence[str], by: Sequence[str] = (), finest: int = FINEST_SMALL,
) -> DataFrame:
    """As ``sums``, for many boxes with few points in each: a row for each point in a box.

    A box takes the finest level whose cells are wider than itself and is sent once, to the cell of its south-western corner; it
    lies in that cell and the next ones north and east, so points are sent to their cell and the next ones south and west. All
    points of a box thus meet it in one task, where they are added up before they are shuffled. Levels in use are read from the boxes.
    The inputs are merged, never broadcast: sizes behind generators are taken for far smaller than they are.
    """
    # a little wider than the box, so that rounding does not make it reach a third cell
    wide = "(greatest(north - south, east - west) * 1.000001D)"
    level = F.expr(f"cast(CASE WHEN {wide} > {2.0**-finest!r}D THEN floor(-log2({wide})) ELSE {finest} END AS int)")
    asked = boxes.withColumn("_at", level)
    levels = asked.select("_at").distinct().agg(F.collect_set("_at")).scalar()
    asked = asked.select(
        "*", F.expr("floor(south * pow(2.0D, _at))").alias("_i"), F.expr("floor(west * pow(2.0D, _at))").alias("_j")
    )
    near = _on_levels(points, latitude, longitude, levels).select(*by, *names, latitude, longitude, "_at", "_i", F.explode(F.expr("array(_j, _j - 1)")).alias("_j"))
    near = near.withColumn("_i", F.explode(F.expr("array(_i, _i - 1)")))
    return asked.join(near.hint("merge"), [*CELL]).filter(_inside(latitude, longitude)).drop(*CELL, latitude, longitude)


def newest(
    boxes: DataFrame, points: DataFrame, latitude: str, longitude: str, order: Sequence[Column], rows: int, side: Column | int = 8
) -> DataFrame:
    """Points in each box, at least its first ``rows`` by ``order``: those first in a whole cell, and on the border those first
    at one place."""

    def first(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= rows).drop("_rank")

    per_place = first(points, latitude, longitude)
    levels = _levels(boxes, side)
    whole = first(_on_levels(per_place, latitude, longitude, levels["whole"]), *CELL)
    single = _on_levels(per_place, latitude, longitude, levels["own"])
    return _met(cells(boxes, side), whole, single, latitude, longitude)
