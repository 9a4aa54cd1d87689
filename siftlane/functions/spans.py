"""Spans of pattern matches as native column expressions: no Python per row.

A span is struct<entity, s, e, ord, text>: half-open character offsets, and the place of its recognizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags that make Java's regular expressions treat case and classes as Unicode does.
FLAGS = "(?iuU)"
SPAN = "struct<entity:string,s:int,e:int,ord:int,text:string>"
_NONE = f"array<{SPAN}>"


def as_column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def matches(text: Column | str, pattern: str) -> Column:
    """All matches in order, as strings. The pattern must not match the empty string."""
    return F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(0))


def find_all(text: Column | str, pattern: str, entity: str, order: int = 0, needs: Column | None = None) -> Column:
    """Spans of all matches: gaps from split, matches from extract, offsets from a running length. needs: what a text with
    matches always passes."""
    text = as_column(text)
    # both arrays are the folded value, never named inside the fold, where they would be computed anew at each step
    zipped = F.arrays_zip(F.split(text, pattern).alias("g"), matches(text, pattern).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, z: Column) -> Column:
        s = acc["at"] + F.length(z["g"])
        e = s + F.length(z["m"])
        span = F.struct(F.lit(entity).alias("entity"), s.alias("s"), e.alias("e"), F.lit(order).alias("ord"), z["m"].alias("text"))
        return F.when(z["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    none = F.array().cast(_NONE)
    some = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(some, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def deoverlap(spans: Column) -> Column:
    """Spans without those inside another: longer first, then the earlier recognizer, then the earlier place.
    Partial overlaps stay. Linear after one sort: by start, longest first, a span stays when it ends after all before."""
    order = F.array_sort(
        spans,
        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["e"] != b["e"], b["e"] - a["e"]).otherwise(a["ord"] - b["ord"]),
    )
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(_NONE).alias("out"))
    return F.aggregate(
        order,
        start,
        lambda acc, x: F.when(x["e"] > acc["end"], F.struct(x["e"].alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def merge_overlaps(spans: Column) -> Column:
    """Instead of partial overlaps one span over their union, with the entity of the longer part."""
    order = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.when(x["e"] - x["s"] > last["e"] - last["s"], x["entity"]).otherwise(last["entity"])
        joined = F.struct(
            longer.alias("entity"), last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["ord"].alias("ord"),
            F.concat(last["text"], F.substr(x["text"], F.greatest(F.lit(1), last["e"] - x["s"] + 1))).alias("text"),
        )
        return F.when(last.isNotNull() & (x["s"] < last["e"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(order, F.array().cast(_NONE), step)


#: Four bytes a character, so that a slice is found without counting characters from the start. The decoder takes a first mark away.
_WIDE, _MARK = "UTF-32", bytes.fromhex("0000feff")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once and not at each step of the folds inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def splice(text: Column | str, kept: Column, replacement) -> Column:
    """text with each span replaced, last first so that offsets stay true. Each copies the whole text: for short ones, such as
    the texts inside a page, where Spark cannot hand replace's folds to a parser's UDF."""
    back = F.array_sort(kept, lambda a, b: F.when(a["s"] != b["s"], b["s"] - a["s"]).otherwise(a["ord"] - b["ord"]))
    return F.aggregate(back, as_column(text), lambda buf, x: F.overlay(buf, replacement(x), x["s"] + 1, x["e"] - x["s"]))


def replace(text: Column | str, kept: Column, replacement) -> Column:
    """text with each span replaced; replacement: span -> Column. Linear, but for spans that overlap in part: they are spliced
    into the whole text, last first so that offsets stay true."""
    text = as_column(text)

    def joined(z: Column) -> Column:
        def end(i: Column) -> Column:
            return F.coalesce(F.get(z["k"], i)["e"], F.lit(0))

        def between(a: Column, b: Column) -> Column:
            return F.decode(F.concat(F.lit(_MARK), F.substr(z["b"], a * 4 + 1, (b - a) * 4)), _WIDE)

        parts = F.flatten(F.transform(z["k"], lambda x, i: F.array(between(end(i - 1), x["s"]), replacement(x))))
        last = between(end(F.size(z["k"]) - 1), (F.length(z["b"]) / 4).cast("int"))
        return F.array_join(F.concat(parts, F.array(last)), "")

    def either(z: Column) -> Column:
        overlap = F.exists(F.transform(z["k"], lambda x, i: F.coalesce(F.get(z["k"], i - 1)["e"] > x["s"], F.lit(False))), lambda o: o)
        return F.when(overlap, splice(text, z["k"], replacement)).otherwise(joined(z))

    spans = F.array_sort(kept, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["ord"] - a["ord"]))
    held = F.struct(F.encode(text, _WIDE).alias("b"), spans.alias("k"))
    return F.when(F.size(kept) == 0, text).when(text.isNotNull() & kept.isNotNull(), _once(held, either))


def not_blank(text: Column | str) -> Column:
    return as_column(text).rlike(r"(?U)\S")
