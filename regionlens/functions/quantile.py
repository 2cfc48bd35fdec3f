"""Exact quantiles and modes without one buffer per wanted rank and without a shuffle of values.

One aggregate takes a mergeable KLL sketch of each column, which brackets every wanted rank.  The next scan counts
the rows between the brackets and the values inside them, by column and bracket: equal values meet in the
map-side partial aggregate, so a value held by a third of the rows costs one row per task.  A bracket that is still
wide is sketched again before its values are read, and a rank that a bracket missed is looked for in the gap where the
counts show it to be.  Modes count values in the same scan.  Only single numbers come back to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH = 4000  # size of a sketch: ranks are off by about 0.0007
SLACK = 0.0015  # share of the rows on either side of a rank that its bracket takes in
STEPS = 1000  # quantiles of a wide bracket from which the next one is cut
FEW = 50_000  # rows inside all brackets that are read as they are


def number(df: DataFrame, column: str) -> Column:
    """A column as DOUBLE; NaN counts as missing."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def _sketched(value: Column, levels: Sequence[float], sketch: int) -> Column:
    at = F.array(*[F.lit(min(1.0, max(0.0, p))) for p in levels])
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value, sketch), at))


def bracket_aggregates(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sketch: int = SKETCH, slack: float = SLACK) -> list[Column]:
    """Two aggregates a column: its number of values, and two bounds around each rank.  For :func:`settle`."""
    levels = [x for p in probs for x in (p - slack, p + slack)]
    return [
        a
        for i, c in enumerate(columns)
        for a in (F.count(number(df, c)).alias(f"_n{i}"), _sketched(number(df, c), levels, sketch).alias(f"_q{i}"))
    ]


Span = tuple[float, float]


def _place(value: Column, cuts: Column) -> Column:
    """Odd: the value is a cut, the ``place // 2``-th; even: it lies between the cuts before and behind."""
    return F.aggregate(cuts, F.lit(0), lambda place, c: place + (value >= c).cast("int") + (value > c).cast("int"))


def _constant(rows: Iterable[Sequence]) -> Column:
    """An array of arrays."""
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])


def _between(cuts: Sequence[float], place: int) -> Span:
    k = place // 2
    return (cuts[k - 1] if k else -math.inf, cuts[k] if k < len(cuts) else math.inf)


def settle(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    first: Mapping,
    texts: Sequence[str] = (),
    sketch: int = SKETCH,
    slack: float = SLACK,
    few: int = FEW,
) -> tuple[dict[str, list[float | None]], dict[str, str]]:
    """Exact quantiles of ``columns`` from the row of :func:`bracket_aggregates`, and the modes of ``texts``.

    ``None`` stands for a column without values; a text column without values has no mode.  Every scan that counts shows
    between which two cuts each rank lies, so a rank that the sketch missed is looked for there.  Cuts are values
    of the column, so each round leaves fewer values between them and the rounds end.
    """
    columns, probs = list(columns), list(probs)
    size = {c: first[f"_n{i}"] for i, c in enumerate(columns)}
    wanted: set[tuple[str, int]] = set()
    cuts: dict[str, set[float]] = {}
    spans: dict[str, list[Span]] = {}
    for i, c in enumerate(columns):
        for j, p in enumerate(probs if size[c] else ()):
            low, high = first[f"_q{i}"][2 * j : 2 * j + 2]
            cuts.setdefault(c, set()).update((low, high))
            spans.setdefault(c, []).append((low, high))
            wanted |= {(c, math.floor(p * (size[c] - 1))), (c, math.ceil(p * (size[c] - 1)))}
    if sum(size[c] * len(own) for c, own in spans.items()) * 2 * slack > few:
        spans = {}
    found: dict[tuple[str, int], float] = {}
    most: dict[str, str] = {}
    while wanted or texts:
        order = {c: sorted(v) for c, v in cuts.items()}
        cells, got = _count(df, order, spans, texts)
        most, texts = most | got, ()
        left: dict[tuple[str, int], tuple[Span, int, int]] = {}
        for c, own in order.items():
            below = 0
            for place in range(2 * len(own) + 1):
                rows, values = cells.get((c, place), (0, None))
                for k in wanted:
                    if k[0] == c and below <= k[1] < below + rows:
                        if place % 2:
                            found[k] = own[place // 2]
                        elif values is not None:
                            found[k] = _at(values, k[1] - below)
                        else:
                            left[k] = (_between(own, place), below, rows)
                below += rows
        wanted = set(left)
        cuts, spans = {}, {}
        open_ = {(k[0], cell): rows for k, (cell, _, rows) in left.items()}
        whole = sum(open_.values()) <= few
        grids = {} if whole or not open_ else _grids(df, list(open_), sketch)
        for k, (cell, below, rows) in left.items():
            narrow = cell
            if not whole:
                grid, at, off = grids[k[0], cell], (k[1] - below) / max(rows - 1, 1) * STEPS, slack * STEPS
                narrow = (grid[max(0, math.floor(at - off))], grid[min(STEPS, math.ceil(at + off))])
            cuts.setdefault(k[0], set()).update(x for x in (*cell, *narrow) if not math.isinf(x))
            spans.setdefault(k[0], []).append(narrow)
            if not cuts[k[0]]:  # all values of the column, none of them known
                cuts[k[0]].add(0.0)
        if not whole and sum(open_[k[0], cell] for k, (cell, _, _) in left.items()) * 2 * (slack + 1 / STEPS) > few:
            spans = {}

    def one(c: str, p: float) -> float | None:
        if not size[c]:
            return None
        rank = p * (size[c] - 1)
        low, high = found[c, math.floor(rank)], found[c, math.ceil(rank)]
        return low if low == high else low + (high - low) * (rank - math.floor(rank))

    return {c: [one(c, p) for p in probs] for c in columns}, most


def _at(values: Mapping[float, int], rank: int) -> float:
    for v in sorted(values):
        if rank < values[v]:
            return v
        rank -= values[v]
    raise AssertionError("a counted rank has a value")


def _count(
    df: DataFrame, cuts: Mapping[str, list[float]], spans: Mapping[str, list[Span]], texts: Sequence[str]
) -> tuple[dict[tuple[str, int], tuple[int, dict[float, int] | None]], dict[str, str]]:
    """One scan: the rows at and between the cuts of each column, the values inside its spans, and the modes of the texts."""
    names, rows, read = [*cuts, *texts], [], set()
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    inside = []
    for i, (c, own) in enumerate(cuts.items()):
        places = {p for p in range(0, 2 * len(own) + 1, 2) if any(a <= _between(own, p)[0] and _between(own, p)[1] <= b for a, b in spans.get(c, ()))}
        read |= {(c, p) for p in places}
        inside.append([p in places for p in range(2 * len(own) + 1)])
        rows.append(F.struct(F.lit(i).alias("i"), number(df, c).alias("v"), blank.alias("text")))
    for i, c in enumerate(texts, len(cuts)):
        rows.append(F.struct(F.lit(i).alias("i"), none.alias("v"), F.col(f"`{c}`").cast("string").alias("text")))
    long = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("v IS NOT NULL OR text IS NOT NULL")
    if cuts:
        # Cuts are looked up by the number of the column: comparisons written out for all columns make a method too long to be compiled.
        place = F.when(F.col("v").isNotNull(), _place(F.col("v"), F.get(_constant(cuts.values()), F.col("i"))))
        long = long.withColumn("place", F.coalesce(place, F.lit(0)))
        long = long.withColumn("v", F.when(F.get(F.get(_constant(inside), F.col("i")), F.col("place")), F.col("v")))
    else:
        long = long.withColumn("place", F.lit(0))
    counted = long.groupBy("i", "place", "v", "text").agg(F.count(F.lit(1)).alias("n"))
    # Of a text column only the most frequent value comes back, the smallest on ties.
    best = F.min(F.when(F.col("text").isNotNull(), F.struct((-F.col("n")).alias("less"), F.col("text").alias("text"))))
    values = F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n")))
    cells, most = {}, {}
    for r in counted.groupBy("i", "place").agg(F.sum("n").alias("n"), values.alias("values"), best.alias("best")).collect():
        c = names[r["i"]]
        if r["i"] >= len(cuts):
            most[c] = r["best"]["text"]
        else:
            cells[c, r["place"]] = (r["n"], {x["v"]: x["n"] for x in r["values"]} if (c, r["place"]) in read else None)
    return cells, most


def _grids(df: DataFrame, cells: Sequence[tuple[str, Span]], sketch: int) -> dict[tuple[str, Span], list[float]]:
    """Quantiles of the values strictly between two bounds, from one sketch a cell."""
    levels = [k / STEPS for k in range(STEPS + 1)]
    inside = [F.when((number(df, c) > F.lit(a)) & (number(df, c) < F.lit(b)), number(df, c)) for c, (a, b) in cells]
    row = df.agg(*[_sketched(v, levels, sketch).alias(str(i)) for i, v in enumerate(inside)]).first()
    return {cell: row[i] for i, cell in enumerate(cells)}


def modes(df: DataFrame, texts: Sequence[str]) -> dict[str, str]:
    """The most frequent text of each column, the smallest on ties; columns without values are left out."""
    return settle(df, [], [], {}, texts)[1] if texts else {}


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int | None = None
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of numeric columns; ``accuracy`` switches to the sketch of ``percentile_approx``."""
    columns = list(columns)
    if accuracy:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(
            *[F.percentile_approx(F.col(c).cast("double"), levels, accuracy).alias(c) for c in columns]
        ).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}
    if not columns:
        return {}
    return settle(df, columns, probs, df.agg(*bracket_aggregates(df, columns, probs)).first().asDict())[0]
