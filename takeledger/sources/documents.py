"""Documents held whole: their lines in order, what lines inherit, and documents that can't be read.

A document is one row, so its lines leave it side by side and in order. What a line inherits from
the lines above it is folded right there, in the task that has the document: nothing is shuffled
or sorted. Shapes of lines are expressions of the plan; a fold only carries what they found.

A fold, or a reader, that fails on a document gives one row of it with the column `error` in place
of its lines, and goes on with the next document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

KEYS = ["production_id", "shoot_day", "doc_id", "filename"]
#: The column that tells the documents of a task apart, whatever their keys.
DOCUMENT = "document"


def lines_of(docs: DataFrame, near: int = 0, **of_document: Column) -> DataFrame:
    """(KEYS, document, ..., place, line): all lines, with what the whole document says.

    near: with `above` and `ahead`, the line before, and the first of as many lines after a line
    that isn't blank ('' where all are).
    """
    told = [c.alias(k) for k, c in of_document.items()]
    lines = F.split(F.coalesce("content", F.lit("")), r"\r?\n")
    keyed = docs.select(*KEYS, F.monotonically_increasing_id().alias(DOCUMENT), *told, lines.alias("lines"))
    if not near:
        return keyed.select(*[c for c in keyed.columns if c != "lines"], F.posexplode("lines").alias("place", "line"))
    nth = lambda i, k: F.nullif(F.trim(F.get("lines", i + k)), F.lit(""))
    seen = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.get("lines", i - 1).alias("above"), F.coalesce(*[nth(i, k + 1) for k in range(near)], F.lit("")).alias("ahead")))
    return keyed.select(*[c for c in keyed.columns if c != "lines"], F.posexplode(seen).alias("place", "x")).select("*", "x.*").drop("x")


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once: as the output of a generator no filter on them is
    pushed below, where their expressions would be written out for each mention."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


class Lines:
    """Lines of whole documents, for a fold: columns by name, and what the lines so far say.

    Parts of a document are runs of lines, told apart by counts; only `any` takes other columns.
    """

    def __init__(self, frame: pd.DataFrame):
        self.frame = frame

    def __getitem__(self, name: str) -> pd.Series:
        return self.frame[name]

    def __setitem__(self, name: str, values: pd.Series) -> None:
        self.frame[name] = values

    def _begins(self, within: tuple[str, ...]) -> np.ndarray:
        """Where the part of each line begins."""
        new = np.arange(len(self.frame)) == 0
        for c in (DOCUMENT, *within):
            v = self.frame[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def latest(self, flags: pd.Series, *within: str) -> pd.Series:
        """The number of the last line up to each that has the flag; -1 where none has."""
        at = np.maximum.accumulate(np.where(flags.fillna(False).to_numpy(bool), np.arange(len(self.frame)), -1))
        return pd.Series(np.where(at >= self._begins(within), at, -1), index=self.frame.index)

    def at(self, values: pd.Series, lines: pd.Series) -> pd.Series:
        """What the lines of these numbers say; at -1 None, or False of flags."""
        at, nothing = lines.to_numpy(), False if values.dtype == bool else None
        out = values.to_numpy(bool if values.dtype == bool else object)[at]
        out[at < 0] = nothing
        return pd.Series(out, index=self.frame.index)

    def last(self, values: pd.Series, *within: str) -> pd.Series:
        """The last value stated up to each line, of its document or of a part of it."""
        return self.at(values, self.latest(values.notna(), *within))

    def first(self, values: pd.Series, *within: str) -> pd.Series:
        """The first value stated up to each line."""
        return self.last(values.where(self.count(values.notna(), *within) == 1), *within)

    def count(self, flags: pd.Series, *within: str) -> pd.Series:
        """How many lines up to each have the flag."""
        flags, begins = flags.fillna(False).to_numpy(bool), self._begins(within)
        counted = np.cumsum(flags)
        return pd.Series(counted - (counted - flags)[begins], index=self.frame.index)

    def any(self, flags: pd.Series, *within: str) -> pd.Series:
        """Whether any line with the same values of these columns has the flag, above or below."""
        flags = flags.fillna(False).to_numpy(bool)
        if flags.any():
            same = self.frame.groupby([DOCUMENT, *within], sort=False, dropna=False).ngroup().to_numpy()
            flags = np.bincount(same[flags], minlength=same.max() + 1)[same] > 0
        return pd.Series(flags, index=self.frame.index)

    def final(self, values: pd.Series, *within: str) -> pd.Series:
        """The last value that the whole part states."""
        begins = self._begins(within)
        ends = np.append(begins[1:] != begins[:-1], True)[::-1]
        ends = len(ends) - 1 - np.maximum.accumulate(np.where(ends, np.arange(len(ends)), 0))[::-1]
        return pd.Series(self.last(values, *within).to_numpy()[ends], index=self.frame.index, dtype=object)

    def joined(self, values: pd.Series, *within: str) -> pd.Series:
        """All values of the part in order, with blanks between."""
        begins, parts = self._begins(within), {}
        for i in np.flatnonzero(values.notna()):
            parts.setdefault(begins[i], []).append(values.iat[i])
        whole = {i: " ".join(part) for i, part in parts.items()}
        return pd.Series([whole.get(i, "") for i in begins], index=self.frame.index, dtype=object)

    def said(self, values: pd.Series, wanted: pd.Series, *within: str) -> pd.Series:
        """The values up to each wanted line, with blanks between; '' at other lines."""
        out, part, begun = np.full(len(values), "", dtype=object), [], -1
        begins, stated, asked, values = self._begins(within), values.notna().to_numpy(), wanted.to_numpy(bool), values.to_numpy(object)
        for i in np.flatnonzero(stated | asked):
            if begins[i] != begun:
                part, begun = [], begins[i]
            if stated[i]:
                part.append(values[i])
            if asked[i]:
                out[i] = " ".join(part)
        return pd.Series(out, index=self.frame.index, dtype=object)


class Passing(Lines):
    """Lines of one batch after another: what the last line of a batch has goes on in the next.

    The fold asks each batch the same in the same order, and only what looks up from a line; parts
    are runs of lines, told apart by counts.
    """

    any = final = joined = said = None

    def __init__(self, frame: pd.DataFrame, held: list[tuple[tuple, object]]):
        super().__init__(frame)
        self.before, self.held = list(held), held
        held.clear()

    def _hold(self, out: pd.Series, within: tuple[str, ...], go_on: Callable[[pd.Series, object], pd.Series]) -> pd.Series:
        columns = [self.frame[c] for c in (DOCUMENT, *within)]
        if self.before:
            key, value = self.before[len(self.held)]
            same = reduce(and_, [c == k for c, k in zip(columns, key)])
            if same.any() and not pd.isna(value):
                out = out.where(~same, go_on(out, value))
        self.held.append((tuple(c.iloc[-1] for c in columns), out.iloc[-1]))
        return out

    def last(self, values: pd.Series, *within: str) -> pd.Series:
        return self._hold(super().last(values, *within), within, lambda out, value: out.where(out.notna(), value))

    def first(self, values: pd.Series, *within: str) -> pd.Series:
        return self.last(values.astype(object).where(self.count(values.notna(), *within) == 1), *within)

    def count(self, flags: pd.Series, *within: str) -> pd.Series:
        return self._hold(super().count(flags, *within), within, lambda out, value: out + value)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole documents: the last document of a batch waits for what follows it."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        newest = b[DOCUMENT].iloc[-1]
        if held and (b[DOCUMENT] == held[-1][DOCUMENT].iloc[-1]).all():
            held.append(b)
            continue
        ready = [*held, b[b[DOCUMENT] != newest]]
        held = [b[b[DOCUMENT] == newest]]
        if sum(map(len, ready)):
            yield pd.concat(ready, ignore_index=True)
    if held:
        yield pd.concat(held, ignore_index=True)


def message(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def folded(rows: DataFrame, adds: str, fold: Callable[[Lines], None], passing: bool = False, left: Sequence[str] = ()) -> DataFrame:
    """rows, lines of lines_of or some of them in order, after `fold` has set or added columns.

    left: columns that only the fold reads, which don't leave it.

    adds: the new columns, as a schema. `error` is one of them: a document on which the fold fails
    has one row, without a line, that says why.

    passing: the fold only counts and carries down, which no text can fail. Lines then leave with
    their batch, however long the document is; else a task holds all lines of a document.
    """
    has_error = "error" in rows.columns
    more = StructType.fromDDL(adds).fields if adds else []
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in left], *more, *([] if has_error else [StructField("error", StringType())])])
    names = [f.name for f in schema.fields]
    bools = [f.name for f in schema.fields if f.dataType.simpleString() == "boolean"]

    def done(frame: pd.DataFrame, held: list | None = None) -> pd.DataFrame:
        t = Lines(frame.copy()) if held is None else Passing(frame.copy(), held)
        if not has_error:
            t["error"] = None
        fold(t)
        for c in bools:
            if t[c].dtype != bool:
                t[c] = t[c].astype(object).where(t[c].notna(), None)
        return t.frame[names]

    def lost(frame: pd.DataFrame, error: Exception) -> pd.DataFrame:
        kept = frame.head(1)[[*KEYS, DOCUMENT]].reindex(columns=names).astype(object)
        kept["error"] = message(error)
        return kept.where(kept.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole(batches):
            failed = frame[frame["error"].notna()] if has_error else frame.head(0)
            sound = frame[frame["error"].isna()].reset_index(drop=True) if len(failed) else frame
            if len(failed):
                yield failed.reindex(columns=names)
            if not len(sound):
                continue
            try:
                yield done(sound)
            except Exception:  # some document is at fault: each on its own
                for _, one in sound.groupby(DOCUMENT, sort=False):
                    try:
                        yield done(one.reset_index(drop=True))
                    except Exception as error:
                        yield lost(one, error)

    def pass_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[tuple, object]] = []
        for frame in batches:
            if len(frame):
                yield done(frame, held)

    return rows.mapInPandas(pass_on if passing else run, schema)


def kept(condition: Column) -> Column:
    """Rows that meet a condition, and those of documents that failed."""
    return condition | F.col("error").isNotNull()
