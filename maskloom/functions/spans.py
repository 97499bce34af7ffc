"""Spans as arrays of structs inside a row: found, merged, resolved and spliced without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
#: Two noncharacters of Unicode that mark where a match opens and closes. In a text they read as U+FFFD.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unmarked(text: Column) -> Column:
    """The text without the two marks."""
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(text)


def spans_in(text: Column, pattern: str | Column) -> Column:
    """``regex_spans`` of a text that is not null and has no marks."""

    empty = F.array().cast(f"array<{SPAN}>")

    def folded(parts: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            value = F.get(parts, 2 * i + 1)
            start = acc["at"] + F.char_length(F.get(parts, 2 * i))
            found = F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"))
            return F.struct(found["end"].alias("at"), F.array_append(acc["out"], found).alias("out"))

        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), first, step, lambda acc: acc["out"])

    def placed(marked: Column) -> Column:
        parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)  # gap, match, gap, match, ..., gap
        return F.when(F.contains(marked, F.lit(OPEN)), let(parts, folded)).otherwise(empty)

    return let(F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(f"{OPEN}$0{CLOSE}")), placed)


def regex_spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> of all matches, half-open code-point offsets.

    The pattern is run once: it marks its matches, and where there are any the text is split at the
    marks, so that offsets are running sums of lengths. It must not match the empty string. Null text
    gives null.
    """
    return F.when(text.isNotNull(), let(unmarked(text), lambda t: spans_in(t, pattern)))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intersection."""
    return (a_start < b_end) & (b_start < a_end)


def within(inner: Column, ranges: Column) -> Column:
    """True if the span ``inner`` lies inside one of ``ranges`` (both with start and end)."""
    return F.exists(ranges, lambda r: (r["start"] <= inner["start"]) & (inner["end"] <= r["end"]))


def resolved(spans: Column) -> Column:
    """Greedy resolution of array<struct<tier, rank (-score), size (-length), start, end, ...>>.

    Spans are taken in the array's sort order, so the struct's leading fields are the priority. A
    span that overlaps none taken so far is taken. One that fully contains taken spans widens the
    first of them to its own extent and absorbs the others; any other overlap is dropped. What comes
    out is disjoint but where a widened span meets a third one; those are widened in turn until none
    overlap. Sorted by start.
    """
    item = lambda t, s, e: t.withField("start", s).withField("end", e)

    def take(acc: Column, x: Column) -> Column:
        hit = F.filter(acc, lambda t: overlaps(t["start"], t["end"], x["start"], x["end"]))
        inside = F.filter(hit, lambda t: (x["start"] <= t["start"]) & (t["end"] <= x["end"]))
        apart = F.filter(acc, lambda t: ~overlaps(t["start"], t["end"], x["start"], x["end"]))
        low = F.least(x["start"], F.array_min(F.transform(hit, lambda t: t["start"])))
        high = F.greatest(x["end"], F.array_max(F.transform(hit, lambda t: t["end"])))
        first = F.array_min(inside)
        return (
            F.when(F.size(hit) == 0, F.array_append(acc, x))
            .when(F.size(inside) > 0, F.array_append(apart, item(first, low, high)))
            .otherwise(acc)
        )

    taken = let(F.array_sort(spans), lambda all_: F.aggregate(all_, F.slice(all_, 1, 0), take))
    return F.array_sort(taken, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def merged(ranges: Column) -> Column:
    """Union of overlapping array<struct<start, end, ...>>: disjoint ranges by start.

    Other fields are those of the longest member, the earliest of equals. Ranges that only touch
    stay apart.
    """
    wide = F.transform(ranges, lambda r: r.withField("span", F.struct((r["end"] - r["start"]).alias("length"), (-r["start"]).alias("first"))))

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["end"], x["end"])
        both = F.when(x["span"] > last["span"], x).otherwise(last).withField("start", last["start"]).withField("end", end)
        return F.when((F.size(acc) > 0) & (F.get(F.reverse(acc), F.lit(0))["end"] > x["start"]), F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), both)).otherwise(F.array_append(acc, x))

    by_start = F.array_sort(wide, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.lit(0)))
    out = F.aggregate(by_start, F.filter(wide, lambda r: F.lit(False)), lambda acc, x: F.when(F.size(acc) == 0, F.array_append(acc, x)).otherwise(join(acc, x)))
    return F.transform(out, lambda r: r.dropFields("span"))


def disjoint(spans: Column) -> Column:
    """Greedy left-to-right choice: by start, longer first, drop what overlaps a chosen span."""
    order = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1))
        .otherwise(0),
    )
    return F.aggregate(
        order,
        F.filter(spans, lambda s: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda t: overlaps(t["start"], t["end"], x["start"], x["end"])), acc).otherwise(F.array_append(acc, x)),
    )


def spliced(text: Column, edits: Column) -> Column:
    """``text`` with disjoint array<struct<start, end, token>> (by start) replaced, in a single pass."""
    out = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts")),
        lambda acc, e: F.struct(
            e["end"].alias("pos"),
            F.concat(acc["parts"], F.array(F.substr(text, acc["pos"] + 1, e["start"] - acc["pos"]), e["token"])).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["pos"] + 1, F.char_length(text))),
    )
    return out


def covered(ranges: Column) -> Column:
    """Characters in the union of array<struct<start, end>>."""
    return F.aggregate(merged(ranges), F.lit(0), lambda n, r: n + r["end"] - r["start"])
