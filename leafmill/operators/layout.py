"""Structures on pages: contents entries, tables over pages, cells between ruled lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .windows import running_sum

#: A contents line ends in leaders and a page number, or begins with a section number.
DOTTED = "^(.*?)[ .…]{2,}(\\d{1,4})$"
NUMBERED = "^(\\d+(?:\\.\\d+)*)[.)]?\\s+(\\S.*)$"


def contents_entries(lines: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """Entries of a contents page: a line that begins with a number opens one, others continue it; title and page number."""
    rows = running_sum(lines, [key], place, F.when(F.col(text).rlike(NUMBERED), 1).otherwise(0), "entry_no").where("entry_no > 0")
    joined = T.compact(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), " "))
    out = rows.groupBy(key, "entry_no").agg(joined.alias("entry"))
    page = F.regexp_extract("entry", DOTTED, 2)
    return out.withColumn("page", F.when(page != "", page.cast("int"))).withColumn("title", F.when(page != "", F.trim(F.regexp_extract("entry", DOTTED, 1))).otherwise(F.col("entry"))).drop("entry")


def table_runs(tables: DataFrame, key: str, page: str, columns: str, width: str, slack: float = 2.0) -> DataFrame:
    """Tables on consecutive pages with as many columns and the same width are one: run_no within the key."""
    w = Window.partitionBy(key).orderBy(page)
    same = (F.col(page) - F.lag(page).over(w) <= 1) & (F.col(columns) == F.lag(columns).over(w)) & (F.abs(F.col(width) - F.lag(width).over(w)) <= slack)
    rows = tables.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _cells(page: pd.DataFrame) -> pd.DataFrame:
    """Cells of the grid of a page's strokes: corners with a line on each of the four sides. slack joins near coordinates."""
    slack = 1.5
    keys = [c for c in page.columns if c not in ("x0", "x1", "top", "bottom")]

    def merged(values: list[float]) -> list[float]:
        out: list[float] = []
        for v in sorted(values):
            if not out or v - out[-1] > slack:
                out.append(v)
        return out

    flat = page[(page.bottom - page.top).abs() <= slack]
    upright = page[(page.x1 - page.x0).abs() <= slack]
    ys, xs = merged(flat.top.tolist()), merged(upright.x0.tolist())
    near = lambda a, b: abs(a - b) <= slack
    across = lambda y, a, b: any(near(t, y) and x0 <= a + slack and x1 >= b - slack for t, x0, x1 in zip(flat.top, flat.x0, flat.x1))
    down = lambda x, a, b: any(near(x0, x) and t <= a + slack and e >= b - slack for x0, t, e in zip(upright.x0, upright.top, upright.bottom))
    rows, taken = [], set()
    for i in range(len(ys) - 1):
        for j in range(len(xs) - 1):
            if (i, j) in taken or not (down(xs[j], ys[i], ys[i + 1]) and across(ys[i], xs[j], xs[j + 1])):
                continue
            c = next((c for c in range(j + 1, len(xs)) if down(xs[c], ys[i], ys[i + 1])), None)
            if c is None:
                continue
            r = next((r for r in range(i + 1, len(ys)) if across(ys[r], xs[j], xs[c])), None)
            if r is None or not all(down(xs[j], ys[k], ys[k + 1]) and down(xs[c], ys[k], ys[k + 1]) for k in range(i, r)):
                continue
            taken |= {(a, b) for a in range(i, r) for b in range(j, c)}
            rows.append((*page[keys].iloc[0].tolist(), i + 1, j + 1, r - i, c - j))
    return pd.DataFrame(rows, columns=[*keys, "row", "col", "rowspan", "colspan"])


def ruled_cells(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """strokes(keys, x0, x1, top, bottom) -> cells with spans. A page is one group, bounded by its strokes; pages without a grid give
    nothing."""
    schema = ", ".join(f"`{k}` {strokes.schema[k].dataType.simpleString()}" for k in keys) + ", row int, col int, rowspan int, colspan int"
    return strokes.select(*keys, "x0", "x1", "top", "bottom").dropna().groupBy(*keys).applyInPandas(_cells, schema)
