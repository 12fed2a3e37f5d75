"""Running a recipe: the changed table, and what each step did."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.identity import ROW_ID, ROW_ORDER, content_fingerprint, user_columns
from ..functions.names import col, free
from ..functions.predicates import predicate
from ..operators import prepare
from ..storage import materialize


def _touched(before: DataFrame, operation: str, p: dict) -> list[Column]:
    """For each changed column, whether a cell of it changes."""
    if operation == "fill_missing" or operation == "drop_missing_rows":
        return [col(c).isNull() for c in p["columns"]]
    if operation == "cast_column":
        return [col(p["column"]).isNotNull() & prepare.lenient_cast(before, p["column"], p["target"]).isNull()]
    if operation == "replace_values":
        return [reduce(Column.__or__, (col(p["column"]).isNull() if old is None else F.coalesce(col(p["column"]) == F.lit(old), F.lit(False)) for old, _ in p["mapping"]))]
    if operation == "replace_non_finite":
        return [F.coalesce(F.abs(col(c)) == float("inf"), F.lit(False)) for c in p["columns"]]
    return []


class _Stretch:
    """Steps that need no other rows. They mark rows instead of removing them, and what they do is counted together.

    Each step has three kinds of marks, columns of the table meanwhile: rows that it removes, cells that it changes, and rows to show as samples.
    """

    def __init__(self, df: DataFrame):
        self.df, self.marks = df, {}
        self.stays = self._mark("stays", F.lit(True))

    def _mark(self, name: str, value: Column) -> str:
        name = free([*self.df.columns, *self.marks.values()], f"__{name}")
        self.df = self.df.withColumn(name, value)
        return name

    def mark(self, step: int, kind: str, value: Column) -> None:
        """A condition for rows that are still there."""
        key = (step, kind, sum(k[:2] == (step, kind) for k in self.marks))
        self.marks[key] = self._mark(f"{step}_{kind}_{key[2]}", F.col(self.stays) & F.coalesce(value, F.lit(False)))

    def keep(self, step: int, condition: Column) -> None:
        self.mark(step, "removed", ~F.coalesce(condition, F.lit(False)))
        self.df = self.df.withColumn(self.stays, F.col(self.stays) & F.coalesce(condition, F.lit(False)))

    def rest(self, written: DataFrame) -> DataFrame:
        return written.where(F.col(self.stays)).drop(self.stays, *self.marks.values())

    def settle(self, samples: int, ordered: bool = False) -> tuple[DataFrame, dict, dict]:
        """Written once: the table after all steps, the sums of the marks ('rows': of all rows at the beginning), and the ids of each step's samples in order."""
        df = self.df.repartitionByRange(ROW_ORDER).sortWithinPartitions(ROW_ORDER) if ordered else self.df
        written = materialize(df)
        names = list(self.marks.values())
        sums = [F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0)).alias(f"s{i}") for i, n in enumerate(names)]
        for step in {k[0] for k in self.marks}:
            cells = [n for k, n in self.marks.items() if k[:2] == (step, "cells")]
            if cells:
                sums.append(F.coalesce(F.sum(reduce(Column.__or__, (F.col(n) for n in cells)).cast("long")), F.lit(0)).alias(f"any{step}"))
        got = written.agg(F.count(F.lit(1)).alias("rows"), *sums).first().asDict()
        shown: dict[tuple, list[str]] = {}
        wanted = {k: n for k, n in self.marks.items() if k[1] == "shown" and samples and got[f"s{names.index(n)}"]}
        if wanted:
            each = F.filter(F.array(*(F.when(F.col(n), F.lit(i)) for i, n in enumerate(wanted.values()))), lambda x: x.isNotNull())
            rows = written.select(F.col(ROW_ID).alias("id"), F.col(ROW_ORDER).alias("at"), F.explode(each).alias("mark"))
            place = F.row_number().over(Window.partitionBy("mark").orderBy("at"))
            for r in rows.withColumn("place", place).where(F.col("place") <= samples).orderBy("mark", "place").collect():
                shown.setdefault(list(wanted)[r["mark"]], []).append(r["id"])
        return self.rest(written), got | {k: got[f"s{i}"] for i, k in enumerate(self.marks)}, shown


def run_recipe(df: DataFrame, steps: list[tuple[str, dict]]) -> tuple[DataFrame, DataFrame]:
    """The result, and per step: step, operation, affected_rows, affected_cells, rows_after, columns_after, learned (JSON), warnings."""
    return recipe_preview(df, steps, samples=0)[:2]


def recipe_preview(df: DataFrame, steps: list[tuple[str, dict]], samples: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As run_recipe (the result is written in row order), and a sample of changed rows: step, operation, _row_id; in step order, samples in all.

    Steps that change or remove rows one by one run together: their table is written once, and one aggregate counts for all of them, before a step learns values
    of it or needs it whole (duplicates, appended rows), and at the end. So a table isn't worked out again for each step.
    """
    if not steps:
        raise Refused("empty_recipe")
    told: list[dict] = []
    ids: list[tuple[int, list[str]]] = []
    open_steps: list[int] = []

    def settle(stretch: _Stretch, ordered: bool = False) -> DataFrame:
        written, got, shown = stretch.settle(samples, ordered)
        n = got["rows"]
        for i in open_steps:
            one = told[i]
            removed = got.get((i, "removed", 0), 0)
            cells = sum(v for k, v in got.items() if isinstance(k, tuple) and k[:2] == (i, "cells"))
            if one["strict"] and cells:
                raise Refused("cast_failure", steps[i][1]["column"])
            one |= {"rows": removed if (i, "removed", 0) in got else got.get(f"any{i}", 0), "cells": cells}
            if one["shape"]:
                one |= {"rows": n, "cells": n * one["dropped"]}
            if one["added"]:
                one["rows"] = got[i, "shown", 0]
            n -= removed
            one["left"] = n
            ids.append((i, [r for k in sorted(k for k in shown if k[0] == i) for r in shown[k]]))
        open_steps.clear()
        return written

    stretch = _Stretch(df)
    for i, (operation, p) in enumerate(steps):
        if operation not in prepare.STEPS:
            raise Refused("unknown_operation", operation)
        learned: dict = {}
        learns = operation == "fill_missing" and p.get("strategy") != "constant"
        if open_steps and (learns or operation in ("remove_duplicates", "append_rows")):
            stretch = _Stretch(settle(stretch))
        plain = stretch.df.drop(stretch.stays, *stretch.marks.values())
        one = {"learned": learned, "shape": False, "dropped": 0, "added": False, "strict": False}
        told.append(one)
        open_steps.append(i)
        if operation == "filter_rows":
            prepare.filter_rows(plain, **p)  # refuses what can't be compared
            says = predicate(p["column"], p["operator"], p.get("value"))
            stretch.mark(i, "shown", ~says)
            stretch.keep(i, says)
        elif operation == "drop_missing_rows":
            prepare.drop_missing_rows(plain, **p)
            gone = reduce(Column.__or__, _touched(plain, operation, p))
            stretch.mark(i, "shown", gone)
            stretch.keep(i, ~gone)
        elif operation in ("drop_columns", "rename_column"):
            after = prepare.STEPS[operation](plain, **p)
            stretch.mark(i, "shown", F.lit(True))
            stretch.df = stretch.df.drop(*p["columns"]) if operation == "drop_columns" else stretch.df.withColumnRenamed(p["column"], after.columns[plain.columns.index(p["column"])])
            one |= {"shape": True, "dropped": len(p["columns"]) if operation == "drop_columns" else 0}
        elif operation == "remove_duplicates":
            least = free(stretch.df.columns, "__first")
            kept = prepare.remove_duplicates(plain, **p).select(F.col(ROW_ORDER).alias(least))
            joined = stretch.df.join(kept, F.col(ROW_ORDER) == F.col(least), "left")
            first = free(joined.columns, "__is_first")
            stretch.df = joined.withColumn(first, F.col(least).isNotNull())
            stretch.mark(i, "shown", ~F.col(first))
            stretch.keep(i, F.col(first))
            stretch.df = stretch.df.drop(least, first)
        elif operation == "append_rows":
            last = plain.agg(F.max(ROW_ORDER)).first()[0]
            stretch = _Stretch(prepare.append_rows(plain, **p))
            stretch.mark(i, "shown", F.col(ROW_ORDER) >= (0 if last is None else last + 1))
            one["added"] = True
        else:
            if operation == "fill_missing":
                learned = one["learned"] = prepare.fill_values(plain, **p)
                after = lambda x: prepare.fill_with(x, learned)  # noqa: B023, E731
            elif operation == "cast_column":
                one["strict"] = p.get("failure_policy", "strict") == "strict"
                prepare.cast_column(plain, p["column"], p["target"], "invalid_to_null")
                after = lambda x: prepare.cast_column(x, p["column"], p["target"], "invalid_to_null")  # noqa: B023, E731
            else:
                prepare.STEPS[operation](plain, **p)
                after = lambda x: prepare.STEPS[operation](x, **p)  # noqa: B023, E731
            marks = _touched(plain, operation, p)
            for m in marks:
                stretch.mark(i, "cells", m)
            for m in marks if operation == "fill_missing" else [reduce(Column.__or__, marks)] if marks else [F.lit(True)]:
                stretch.mark(i, "shown", m)
            stretch.df = after(stretch.df)
        one["columns"] = len(user_columns(stretch.df.drop(stretch.stays, *stretch.marks.values())))
    done = settle(stretch, ordered=True)
    report = [(i, o, t["rows"], t["cells"], t["left"], t["columns"], json.dumps(t["learned"], default=str), ["fill_value_not_defined" for v in t["learned"].values() if v is None]) for i, ((o, _), t) in enumerate(zip(steps, told, strict=True))]
    sampled: list[tuple] = []
    for i, found in sorted(ids):
        sampled += [(i, steps[i][0], r) for r in list(dict.fromkeys(found))[: samples - len(sampled)]]
    spark = done.sparkSession
    rows = spark.createDataFrame(report, "step int, operation string, affected_rows long, affected_cells long, rows_after long, columns_after int, learned string, warnings array<string>")
    return done, rows, spark.createDataFrame(sampled, f"step int, operation string, {ROW_ID} string")


def preview_summary(before: DataFrame, after: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """One row: rows and user columns before and after, and a fingerprint that is equal for equal content made by equal steps."""
    old = content_fingerprint(before).first()[0]
    shapes = [F.lit(n).cast("long").alias(f"{what}_{when}") for when, df in (("before", before), ("after", after)) for what, n in (("rows", df.count()), ("columns", len(user_columns(df))))]
    return content_fingerprint(after).select(*shapes, F.sha2(F.concat_ws("|", F.lit(old), F.lit(json.dumps(steps, sort_keys=True, default=str)), "fingerprint"), 256).alias("fingerprint"))
