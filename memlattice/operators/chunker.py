"""Cutting of texts into blocks of lines, near blank lines. Two rules.

A text's cuts depend on one another, but each needs only the nearest blank lines: the fold's state is the
list of block ends, and its steps are blocks, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions.let import let
from memlattice.schema import BLANK_WINDOW, CHUNK_LINES


def _lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def blocks(docs: DataFrame, rule: str, id_col: str = "doc_id", text: str = "text", target: int = CHUNK_LINES, window: int = BLANK_WINDOW, drop_blank: bool = True) -> DataFrame:
    """(id_col, start_line, end_line, text). Rule nearest: the blank line nearest to the target end, the earlier of two,
    within `window` either way, and the last block is whatever fits the target; rule forward: the first blank line from the
    target end on, up to `window` further. Blocks of blanks only are dropped. Lines count from 1."""
    if rule not in ("nearest", "forward"):
        raise ValueError(rule)
    # A block spans at least (target - window) lines, or one, whichever is more.
    shortest = max(1, target - window) if rule == "nearest" else target

    def ends(total: Column, blank: Column) -> Column:
        """Block ends. A step looks at the blank lines after the last end, of which few lie within its reach: at most one a line."""
        reach = target + window

        def step(state: Column, _: Column) -> Column:
            found, at = state["found"], state["at"]
            start = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0)) + 1
            want = F.least(start + target - 1, total)
            return let(F.slice(blank, at, F.lit(reach)), lambda near: let(_end(start, want, total, near), lambda end: F.when(start > total, state).otherwise(
                F.struct(F.concat(found, F.array(end)).alias("found"), (at + F.size(F.filter(near, lambda b: b <= end))).alias("at")))))

        steps = F.when(total > 0, F.sequence(F.lit(1), F.ceil(total / shortest).cast("int"))).otherwise(F.array().cast("array<int>"))
        begin = F.struct(F.array().cast("array<int>").alias("found"), F.lit(1).alias("at"))
        return F.aggregate(steps, begin, step, lambda state: state["found"])

    def _end(start: Column, want: Column, total: Column, near: Column) -> Column:
        if rule == "nearest":
            ok = F.filter(near, lambda b: b.between(F.greatest(start, want - window), F.least(total, want + window)))
            best = F.array_min(F.transform(ok, lambda b: F.struct(F.abs(b - want).alias("d"), b.alias("b"))))["b"]
        else:
            best = F.array_min(F.filter(near, lambda b: b.between(want, F.least(total, want + window))))
        return F.when(want == total, total).otherwise(F.coalesce(best, want))

    # Lines without a non-blank character, then the fold, then the texts of the blocks; each computed once (see let).
    is_blank = lambda x: ~x.rlike(r"\S")
    blanks = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(is_blank(x), i + 1)), lambda i: i.isNotNull())

    def texts(lines: Column, found: Column) -> Column:
        first = lambda i: F.coalesce(F.get(found, i - 1), F.lit(0)) + 1
        return F.transform(found, lambda e, i: F.struct(first(i).cast("bigint").alias("start_line"), e.cast("bigint").alias("end_line"), F.array_join(F.slice(lines, first(i), e - first(i) + 1), "\n").alias("text")))

    cut = let(_lines(F.col(text)), lambda lines: let(let(blanks(lines), lambda blank: ends(F.size(lines), blank)), lambda found: texts(lines, found)))
    out = docs.select(id_col, F.explode(cut).alias("x")).select(id_col, "x.start_line", "x.end_line", "x.text")
    return out.where(F.col("text").rlike(r"\S")) if drop_blank else out
