"""State along the rows of long groups: within blocks by windows, across them by one row for each block.

A window over a whole document puts it into one task. Here rows carry a block number that
rises along the order; a window runs inside (group, block), and what comes before a block
is found from the blocks' summaries, which combine before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled

#: Rows in a block.
BLOCK = 4096


def block_of(order: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(order) / size).cast("long")


def carried(rows: DataFrame, group: list[str], order: list[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, inclusive: bool = True, backward: bool = False) -> DataFrame:
    """rows(..., block) with more columns: the last non-null value, and the sum, of what comes up to each row.

    Without ``inclusive`` the row itself doesn't count; ``backward`` goes from the end. rows is read
    twice, the second time for the columns that the values need."""
    last, sums = last or {}, sums or {}
    turn = (lambda c: F.desc(c)) if backward else (lambda c: F.asc(c))
    pick = F.min if backward else F.max
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*group, "block").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, end)
    ends = rows.groupBy(*group, "block").agg(*[pick(F.when(c.isNotNull(), F.struct(*order, c.alias("value")))).alias(k) for k, c in last.items()], *[F.sum(c).alias(k) for k, c in sums.items()])
    before = Window.partitionBy(*group).orderBy(turn("block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*group, "block", *[F.last(F.col(k)["value"], True).over(before).alias(f"_{k}") for k in last], *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    found = rows.join(ends, [*group, "block"])
    found = found.withColumns({k: F.coalesce(F.last(c, True).over(inside), F.col(f"_{k}")) for k, c in last.items()} | {k: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{k}") for k, c in sums.items()})
    return found.drop(*[f"_{k}" for k in [*last, *sums]])


# Reachable rows


def _exits(seq: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where a walk from each row of a block leaves it (-1: it ends); steps go forward only."""
    place = np.searchsorted(seq, after)
    inside = (place < len(seq)) & (seq[np.minimum(place, len(seq) - 1)] == after)
    out = after.copy()
    for i in range(len(seq) - 1, -1, -1):
        if inside[i]:
            out[i] = out[place[i]]
    return out


def reachable(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc, seq) of the rows on the walks of steps(doc, block, seq, after) from starts(doc, seq); a null after ends a walk.

    Each block says where its entries lead to, the first row of a later block that a walk from
    there comes to. Entries are joined to their entries' entries, which doubles a
    jump every round; then blocks mark what their reached entries pass."""
    steps = settled(steps.select("doc", "block", "seq", F.coalesce("after", F.lit(-1)).cast("long").alias("after")))
    where = steps.select("doc", F.col("seq").alias("after"), F.col("block").alias("to"))
    crossing = steps.where("after >= 0").join(where, ["doc", "after"]).where("to <> block").select("doc", F.col("after").alias("seq")).distinct()
    entries = settled(crossing.unionByName(starts.select("doc", "seq")).distinct())
    flagged = steps.join(entries.withColumn("entry", F.lit(True)), ["doc", "seq"], "left")
    kind = steps.schema["doc"].dataType.simpleString()

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = pdf.assign(exit=_exits(pdf["seq"].to_numpy(), pdf["after"].to_numpy()))
        return out.loc[pdf["entry"].notna() & (out["exit"] >= 0), ["doc", "seq", "exit"]]

    jumps = settled(flagged.groupBy("doc", "block").applyInPandas(leave, f"doc {kind}, seq long, exit long"))
    reached = settled(starts.select("doc", F.col("seq").cast("long").alias("seq")))
    while not jumps.isEmpty():
        reached = settled(reached.unionByName(reached.join(jumps, ["doc", "seq"]).select("doc", F.col("exit").alias("seq"))).distinct())
        onward = jumps.select("doc", F.col("seq").alias("exit"), F.col("exit").alias("further"))
        jumps = settled(jumps.join(onward, ["doc", "exit"]).select("doc", "seq", F.col("further").alias("exit")))

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seq, after, on = pdf["seq"].to_numpy(), pdf["after"].to_numpy(), pdf["entry"].notna().to_numpy().copy()
        place = np.searchsorted(seq, after)
        for i in range(len(seq)):
            if on[i] and place[i] < len(seq) and seq[place[i]] == after[i]:
                on[place[i]] = True
        return pdf.loc[on, ["doc", "seq"]]

    marked = steps.join(reached.withColumn("entry", F.lit(True)), ["doc", "seq"], "left")
    return marked.groupBy("doc", "block").applyInPandas(walked, f"doc {kind}, seq long")


# Chapters: a running maximum that falls back

#: Numbers over this fall under the running maximum before a new chapter begins.
FALL = 5
Event = tuple[float, float]


class Chapters:
    """What a run of events does to (chapter, highest verse so far).

    A verse x that is more than ``fall`` under the highest begins the next chapter and is
    its highest. A chapter number n over the chapter sets it, and the highest to 0; a book sets chapter 1.
    Events are (0, x), (1, n) and (2, 0).

    The effect of many events is a step function of few steps. By the highest verse that comes in,
    the first fall is at one of the events' falling minima, or at none; each of these ways has
    the chapter numbers that take effect on it if the chapter that comes in is under a limit
    (rising along the way) and set a state of their own, and else adds its falls to the
    chapter. ``ways`` are (highest that comes in at most, limits, states, falls, highest that
    goes out or None if that is the larger one of what comes in and ``top``, top)."""

    def __init__(self, ways: list[tuple]):
        self.ways = ways

    @classmethod
    def of(cls, events: list[Event], fall: int = FALL) -> Chapters:
        ends: dict[int, tuple] = {}

        def after(i: int) -> tuple:
            """The state at the end if event i, a chapter number or a book, takes effect."""
            if i not in ends:
                kind, n = events[i]
                ends[i] = fold(events[i + 1 :], (n, 0) if kind == 1 else (1, 0), fall)[-1]
            return ends[i]

        def way(at: int, limits: list, states: list, falls: int, most: float | None) -> tuple:
            """The rest of a way on which the highest verse is known."""
            limits, states = list(limits), list(states)
            for i in range(at, len(events)):
                kind, x = events[i]
                if kind == 0:
                    if x < most - fall:
                        falls, most = falls + 1, x
                    else:
                        most = max(most, x)
                else:
                    limit = np.inf if kind == 2 else x - falls
                    if not limits or limit > limits[-1]:
                        limits.append(limit)
                        states.append(after(i))
                    if kind == 2:
                        break
            return limits, states, falls, most, -np.inf

        found, limits, states = [], [], []
        top, low = -np.inf, np.inf
        for i, (kind, x) in enumerate(events):
            if kind == 0:
                if x < top - fall:
                    found.append((np.inf, *way(i + 1, limits, states, 1, x)))
                    break
                if x < low:
                    # Whatever is above x + fall and has not fallen yet falls here.
                    low = x
                    found.append((x + fall, way(i + 1, limits, states, 1, x)))
                top = max(top, x)
            else:
                limit = np.inf if kind == 2 else x
                if not limits or limit > limits[-1]:
                    limits.append(limit)
                    states.append(after(i))
                if kind == 2:
                    found.append((np.inf, limits, states, 0, 0, -np.inf))
                    break
        else:
            found.append((np.inf, limits, states, 0, None, top))
        # The last one holds up to the lowest minimum, and so on upward.
        out, over = [], found.pop()
        for bound, more in reversed(found):
            out.append((bound, *over[1:]))
            over = (np.inf, *more)
        return cls([*out, over])

    def __call__(self, state: tuple[float, float]) -> tuple[float, float]:
        chapter, most = state
        _, limits, states, falls, out, top = next(w for w in self.ways if most <= w[0])
        for limit, found in zip(limits, states, strict=True):
            if chapter < limit:
                return found
        return chapter + falls, max(most, top) if out is None else out

    def then(self, other: Chapters) -> Chapters:
        """First this, then the other."""
        ways: list[tuple] = []
        for bound, limits, states, falls, out, top in self.ways:
            states = [other(s) for s in states]
            for b2, l2, s2, f2, o2, t2 in other.ways:
                if out is not None:
                    if out > b2:
                        continue
                    most, hi, going, above = out, bound, max(out, t2) if o2 is None else o2, -np.inf
                else:
                    if top > b2:
                        continue
                    hi, going, above = min(bound, b2), o2, max(top, t2) if o2 is None else -np.inf
                    if ways and hi <= ways[-1][0]:
                        continue
                more = [(limit - falls, s) for limit, s in zip(l2, s2, strict=True) if not limits or limit - falls > limits[-1]]
                way = (hi, [*limits, *[m[0] for m in more]], [*states, *[m[1] for m in more]], falls + f2, going, above)
                if ways and ways[-1][1:] == way[1:]:
                    ways.pop()
                ways.append(way)
                if out is not None or b2 >= bound:
                    break
        return Chapters(ways)

    def pack(self) -> list[float]:
        """Numbers that ``unpack`` reads; what is open is NaN."""
        out: list[float] = []
        for bound, limits, states, falls, going, top in self.ways:
            out += [bound, len(limits), *limits, *[x for s in states for x in s], falls, np.nan if going is None else going, top]
        return [float(x) for x in out]

    @classmethod
    def unpack(cls, numbers: list[float]) -> Chapters:
        ways, at = [], 0
        while at < len(numbers):
            bound, n = numbers[at], int(numbers[at + 1])
            limits = list(numbers[at + 2 : at + 2 + n])
            flat = numbers[at + 2 + n : at + 2 + 3 * n]
            falls, going, top = numbers[at + 2 + 3 * n : at + 5 + 3 * n]
            ways.append((bound, limits, list(zip(flat[::2], flat[1::2], strict=True)), falls, None if np.isnan(going) else going, top))
            at += 5 + 3 * n
        return cls(ways)


def fold(events: list[Event], state: tuple[float, float] = (1, 0), fall: int = FALL) -> list[tuple[float, float]]:
    """The state before all events and after each."""
    chapter, most = state
    out = [(chapter, most)]
    for kind, x in events:
        if kind == 0:
            chapter, most = (chapter + 1, x) if x < most - fall else (chapter, max(most, x))
        elif kind == 2:
            chapter, most = 1, 0
        elif x > chapter:
            chapter, most = x, 0
        out.append((chapter, most))
    return out


#: Blocks that one task composes.
FAN = 1024


def swept(blocks: DataFrame, group: str, fan: int = FAN, start: tuple[float, float] = (1, 0)) -> DataFrame:
    """(group, block, chapter, most, chapter_after): the state that comes to each block of blocks(group, block long, ways) and the chapter that leaves it.

    Where a group has more than ``fan`` blocks, spans of them are composed first, in as many levels as it takes."""
    kind = blocks.schema[group].dataType.simpleString()
    spans = blocks.select(group, "block", "ways", F.floor((F.row_number().over(Window.partitionBy(group).orderBy("block")) - 1) / fan).cast("long").alias("span"))
    spans = settled(spans)
    many = spans.agg(F.max("span")).first()[0] or 0

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        whole = reduce(Chapters.then, map(Chapters.unpack, pdf["ways"]))
        return pd.DataFrame({group: pdf[group].iloc[:1], "block": pdf["span"].iloc[:1], "ways": [whole.pack()]})

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, out = (pdf["chapter"].iloc[0], pdf["most"].iloc[0]), []
        for ways in pdf["ways"]:
            before, state = state, Chapters.unpack(ways)(state)
            out.append((*before, state[0]))
        return pdf[[group, "block"]].assign(**dict(zip(("chapter", "most", "chapter_after"), zip(*out, strict=True), strict=True)))

    if many:
        upper = spans.groupBy(group, "span").applyInPandas(composed, f"{group} {kind}, block long, ways array<double>")
        coming = swept(upper, group, fan, start).select(group, F.col("block").alias("span"), "chapter", "most")
        spans = spans.join(coming, [group, "span"])
    else:
        spans = spans.withColumns({"chapter": F.lit(float(start[0])), "most": F.lit(float(start[1]))})
    return spans.groupBy(group, "span").applyInPandas(states, f"{group} {kind}, block long, chapter double, most double, chapter_after double")


def _leads(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where another value of the keys begins; null ones are alike."""
    change = np.zeros(max(0, len(pdf) - 1), bool)
    for k in keys:
        v, none = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        change |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
    return np.concatenate(([0], np.flatnonzero(change) + 1)) if len(pdf) else np.zeros(0, int)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """(rows, ends) of sorted batches: many groups at once, each whole; group g is rows ends[g] to ends[g + 1]."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        held = pdf if held is None or not len(held) else pd.concat([held, pdf])
        leads = _leads(held, keys)
        if len(leads) > 1:
            yield held.iloc[: leads[-1]], leads.tolist()
            held = held.iloc[leads[-1] :]
    if held is not None and len(held):
        yield held, [0, len(held)]


def chapter_runs(batches: Iterator[pd.DataFrame], group: str, number: str, size: int, fall: int = FALL) -> Iterator[pd.DataFrame]:
    """Of sorted batches (group, number, part): (group, block, ways, n, chapters) of runs of one group.

    A group that begins and ends between others is folded; the first and the last one may go on in other
    tasks, and they and longer ones than ``size`` give step functions, by blocks."""
    key, numbers, n, cut, inner, block = None, [], 0, False, False, 0
    rows: list[tuple] = []
    part = 0

    def close(more: bool) -> None:
        nonlocal numbers, n, block
        if inner and not cut and not more:
            chapter, most = 1, 0
            for x in numbers:
                if x < most - fall:
                    chapter, most = chapter + 1, x
                elif x > most:
                    most = x
            rows.append((key, None, None, n, chapter))
        elif n:
            rows.append((key, (part << 32) + block, Chapters.of([(0, x) for x in numbers], fall).pack(), n, None))
            block += 1
        numbers, n = [], 0

    def told() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[group, "block", "ways", "n", "chapters"])
        rows.clear()
        return out.astype({"block": "Int64", "chapters": "Int64"})

    began = False
    for pdf in batches:
        if not len(pdf):
            continue
        part = int(pdf["part"].iloc[0])
        keys, x, leads = pdf[group].tolist(), pdf[number], _leads(pdf, [group]).tolist()
        there, x = x.notna().to_numpy(), x.to_numpy()
        for lo, hi in zip(leads, [*leads[1:], len(pdf)], strict=True):
            same = began and (keys[lo] == key or (pd.isna(keys[lo]) and pd.isna(key)))
            if not same:
                if began:
                    close(False)
                key, cut, inner, began = keys[lo], False, began, True
            while hi - lo > size - n:
                to = lo + size - n
                numbers += x[lo:to][there[lo:to]].tolist()
                n, lo = size, to
                close(True)
                cut = True
            numbers += x[lo:hi][there[lo:hi]].tolist()
            n += hi - lo
        yield told()
    if began:
        close(True)
        yield told()
