"""Spans to reading-order rows, rows to labelled segments, pages to facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright import constants as K
from tallywright.functions import text as T

SPAN = ["x0", "yc", "span_no", "y0", "x1", "y1", "h", "text", "font", "size"]
STYLE = ("font", "size")  # not needed to build rows
STEP = 0.55  # share of a span's height by which it may lie off its row


def clean_spans(spans: DataFrame, max_pages: int | None = None) -> DataFrame:
    """The positioned-text scan: trimmed, blanks dropped, sizes to two places. With a page limit, spans past it are marked `past_limit`."""
    s = spans.where(F.trim("text") != "").withColumn("text", F.trim("text")).withColumn("size", F.bround("size", 2))
    return s if max_pages is None else s.withColumn("past_limit", F.col("page") > max_pages)


def build_rows(spans: DataFrame, inside: Sequence[str] = SPAN) -> DataFrame:
    """Rows of spans sharing a baseline.

    Spans of a page are taken by their middle's height, then from the left. A row starts where a span lies more than 0.55 of its height
    from the row's first span, so where a row ends depends on all before it: pages are sorted inside one partition and read as a
    stream, which holds no more than the row it is in and one Arrow batch. A gap of that size to the span just before is a certain start;
    only between those, and only where a span is too far from the first one, is the page walked span by span. Output order within a
    page is the struct ``at``; ``spans`` of a row go from left to right and hold the columns in ``inside``; without any there are no ``spans``.
    """
    kept = [c for c in SPAN if c in inside or c not in STYLE]
    dealt = spans.select("doc_id", "page", *[c for c in kept if c not in ("yc", "h")]).repartition("doc_id", "page")  # worked out after the shuffle, not carried by it
    dealt = dealt.withColumn("yc", (F.col("y0") + F.col("y1")) / 2).withColumn("h", F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)))
    dealt = dealt.sortWithinPartitions("doc_id", "page", "yc", "x0", "span_no").select("doc_id", "page", *kept)
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    span, names = ", ".join(f"{c}:{types[c]}" for c in inside), list(inside)
    out = (f"doc_id {types['doc_id']}, page {types['page']}, at struct<y:double,x:double,n:{types['span_no']}>, text string, x0 double, y0 double, x1 double, y1 double"
           + (f", spans array<struct<{span}>>" if names else ""))
    step = STEP

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def changes(column):
            before, after = column.slice(0, len(column) - 1), column.slice(1)
            other = pc.xor(pc.is_null(before), pc.is_null(after))
            return pc.or_(other, pc.fill_null(pc.not_equal(before, after), False)).to_numpy(zero_copy_only=False)

        def starts_of(t):
            """Where rows begin; the first span of the table begins one."""
            yc, high = t.column("yc").to_numpy(), step * t.column("h").to_numpy()
            start = np.ones(len(yc), bool)
            start[1:] = changes(t.column("doc_id").combine_chunks()) | changes(t.column("page").combine_chunks()) | (np.diff(yc) > high[1:])
            at = np.flatnonzero(start)
            off = np.abs(yc - np.repeat(yc[at], np.diff(np.r_[at, len(yc)]))) > high
            for i in np.unique(np.searchsorted(at, np.flatnonzero(off), "right") - 1).tolist():
                end = int(at[i + 1]) if i + 1 < len(at) else len(yc)
                anchor = yc[at[i]]
                for j, (y, h) in enumerate(zip(yc[at[i]:end].tolist(), high[at[i]:end].tolist(), strict=True), int(at[i])):
                    if abs(y - anchor) > h:
                        start[j], anchor = True, y
            return np.flatnonzero(start)

        def rows_of(t, at):
            n = t.num_rows
            row = np.repeat(np.arange(len(at)), np.diff(np.r_[at, n]))
            order = np.lexsort((t.column("span_no").to_numpy(), t.column("yc").to_numpy(), t.column("x0").to_numpy(), row))
            heads, flat = t.take(pa.array(at)).combine_chunks(), t.take(pa.array(order)).combine_chunks()
            column = lambda table, c: table.column(c).chunk(0)
            ends = pa.array(np.r_[at, n], pa.int32())
            number = lambda c: column(flat, c).to_numpy(zero_copy_only=False)
            first = pa.StructArray.from_arrays([column(heads, c) for c in ("yc", "x0", "span_no")], ["y", "x", "n"])
            text = pc.binary_join(pa.ListArray.from_arrays(ends, pc.fill_null(column(flat, "text"), "")), " ")
            held = [pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([column(flat, c) for c in names], names))] if names else []
            return pa.RecordBatch.from_arrays(
                [column(heads, "doc_id"), column(heads, "page"), first, text, pa.array(number("x0")[at]), pa.array(np.minimum.reduceat(number("y0"), at)),
                 pa.array(np.maximum.reduceat(number("x1"), at)), pa.array(np.maximum.reduceat(number("y1"), at)), *held],
                ["doc_id", "page", "at", "text", "x0", "y0", "x1", "y1", *["spans"] * len(held)])

        open_row = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if open_row is None else pa.concat_tables([open_row, t]).combine_chunks()
            at = starts_of(t)
            if at[-1]:
                yield rows_of(t.slice(0, int(at[-1])), at[:-1])
            open_row = t.slice(int(at[-1]))
        if open_row is not None:
            yield rows_of(open_row, np.array([0]))

    return dealt.mapInArrow(run, out)


def document_text(rows: DataFrame) -> DataFrame:
    """Row texts joined by newlines; the text of a document is one value, so its rows meet here."""
    parts = F.array_sort(F.collect_list(F.struct("page", "at", "text")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


#: What an amount keeps of its span, as far as the rows' spans carry it.
PLACE = {"x0": "double", "y0": "double", "x1": "double", "y1": "double", "font": "string", "size": "double"}


def place_of(rows: DataFrame) -> dict[str, str]:
    names = rows.schema["spans"].dataType.elementType.names
    return {c: t for c, t in PLACE.items() if c in names}


def none_of(kind: str) -> Column:
    return F.expr(f"cast(array() AS array<{kind}>)")


def val_type(place: dict[str, str]) -> str:
    return f"struct<{','.join(f'{c}:{t}' for c, t in {'value': 'decimal(18,2)', **place}.items())}>"


HAS_AMOUNT = r"\.\p{Nd}{2}"
#: A span that is one amount and nothing else: the amount is the span without its sign, and nothing stands before it.
ALONE = r"\A\$?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}\z"


def amounts_of(span: Column, strings: Column, place: dict[str, str]) -> Column:
    """The amounts in a span, each with what it keeps of it (box, font and size)."""
    return F.transform(strings, lambda m: F.struct(T.to_money(m).alias("value"), *[span[c].alias(c) for c in place]))


def with_amounts(rows: DataFrame) -> DataFrame:
    """Add ``vals``: all amounts of a row, from left to right."""
    place = place_of(rows)
    found = F.flatten(F.transform("spans", lambda s: amounts_of(s, T.money_strings(s["text"]), place)))
    return rows.withColumn("vals", F.when(F.col("text").rlike(HAS_AMOUNT), found).otherwise(none_of(val_type(place))))


def with_segments(rows: DataFrame) -> DataFrame:
    """Add ``segs``: a row split where a lettered label follows numbers; each with its label and amounts. Null for rows without amounts.

    Lambdas are interpreted, so each pattern is tried once a span and its result kept, in steps.
    """
    place = place_of(rows)
    val, text = val_type(place), lambda x: x["s"]["text"]
    tried = F.transform("spans", lambda s: F.struct(s.alias("s"), s["text"].rlike(ALONE).alias("alone")))
    read = F.transform(tried, lambda x: F.struct(
        x["s"].alias("s"), F.when(x["alone"], F.array(F.ltrim(text(x), F.lit("$")))).otherwise(T.money_strings(text(x))).alias("ms"),
        (~x["alone"] & text(x).rlike("[A-Za-z]{2}")).alias("letters"), F.when(x["alone"], "").otherwise(T.text_before_money(text(x))).alias("lead")))
    facts = F.transform(read, lambda x: F.struct(
        text(x).alias("text"), x["letters"].alias("letters"), x["lead"].alias("lead"), (T.strip(x["lead"], " $:-") != "").alias("led"),
        (F.size(x["ms"]) > 0).alias("money"), ((F.size(x["ms"]) > 0) & ~x["letters"]).alias("number"), amounts_of(x["s"], x["ms"], place).alias("vals")))
    zero = F.struct(none_of(f"struct<label:string,vals:array<{val}>>").alias("done"), none_of("string").alias("label"), none_of(val).alias("vals"), F.lit(False).alias("seen"))
    close = lambda a: F.struct(T.strip(F.lower(F.array_join(a["label"], " ")), " :").alias("label"), a["vals"].alias("vals"))

    def step(acc, x):
        cut = ~x["number"] & acc["seen"] & x["letters"]
        label = F.when(cut, none_of("string")).otherwise(acc["label"])
        vals = F.when(cut, none_of(val)).otherwise(acc["vals"])
        none_yet = cut | (F.size(acc["vals"]) == 0)
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(close(acc)))).otherwise(acc["done"]).alias("done"),
            F.when(x["money"] & x["led"] & none_yet, F.concat(label, F.array(x["lead"])))
            .when(~x["money"] & none_yet, F.concat(label, F.array(x["text"]))).otherwise(label).alias("label"),
            F.when(x["money"], F.concat(vals, x["vals"])).otherwise(vals).alias("vals"), (x["number"] | (acc["seen"] & ~cut)).alias("seen"))

    segs = F.aggregate("facts", zero, step, lambda a: F.concat(a["done"], F.array(close(a))))
    some = F.col("text").rlike(HAS_AMOUNT)
    return rows.withColumn("facts", F.when(some, facts)).withColumn("segs", segs).drop("facts")


def with_name(rows: DataFrame, name: str, cond: Column, pattern: str) -> DataFrame:
    """Add the value behind a label such as ``Employee:`` and, as ``<name>_box``, where it stands, on rows that meet ``cond``."""
    tried = rows.withColumn("_tries", F.when(cond, name_tries(F.col("spans"), pattern)))
    good = lambda t: F.length(F.regexp_replace(t["name"], "[^A-Za-z]", "")) >= 3
    tried = tried.withColumn("_hit", F.get(F.filter("_tries", lambda t: t["abort"] | good(t)), F.lit(0)))
    found = ~F.col("_hit.abort")
    return tried.withColumn(name, F.when(found, F.col("_hit.name"))).withColumn(f"{name}_box", F.when(found, F.col("_hit.box"))).drop("_tries", "_hit")


def name_tries(spans: Column, pattern: str) -> Column:
    """What follows each place of a row where the label stands: the words gathered and the box around them, or abort."""
    anchored = "(?iU)^" + pattern
    get = lambda i: F.element_at(spans, i)
    # patterns are tried once a span and their results kept: lambdas are interpreted, and what they name twice they work out twice
    rest = F.transform(F.sequence(F.lit(1), F.size(spans)), lambda i: F.struct(i.alias("i"), F.when(get(i)["text"].rlike(anchored), F.regexp_replace(get(i)["text"], anchored, "")).alias("rest")))
    labelled = F.filter(rest, lambda x: x["rest"].isNotNull() & ~F.trim(x["rest"]).rlike(r"(?iU)^(id|no|number|#)\b"))
    places = F.transform(labelled, lambda x: F.struct(x["i"].alias("i"), T.strip(x["rest"], " :-").alias("own")))
    marked = lambda s: F.struct(*[s[c].alias(c) for c in ("x0", "y0", "x1", "y1", "text")], s["text"].rlike(r"(?U):$|\d{2}/\d{2}").alias("ends"),
                                s["text"].rlike(r"(?iU)^(id|no\.?|number|#|name)\b:?$").alias("marker"), s["text"].rlike("(?i)^name").alias("named"))

    def walk(p):
        i, own = p["i"], p["own"]
        none = F.lit(None).cast("double")
        zero = F.struct(F.when(own != "", F.array(own)).otherwise(none_of("string")).alias("parts"),
                        F.lit(0).alias("stop"), get(i)["x1"].alias("x1"), (get(i)["y1"] - get(i)["y0"]).alias("h"),
                        F.struct(*[F.when(own != "", get(i)[c]).otherwise(none).alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"))

        def step(acc, n):
            some = F.size(acc["parts"]) > 0
            edge = lambda c: (F.least if c[1] == "0" else F.greatest)(acc["box"][c], n[c])
            far = some & (n["x0"] - acc["x1"] > 2.2 * F.greatest(acc["h"], F.lit(4.0)))
            ends = far | n["ends"]
            marker = ~some & n["marker"]
            on = (acc["stop"] == 0) & ~ends
            take = on & ~marker
            keep = take | (on & marker & n["named"])
            return F.struct(
                F.when(take, F.concat(acc["parts"], F.array(T.strip(n["text"], " :")))).otherwise(acc["parts"]).alias("parts"),
                F.when(acc["stop"] != 0, acc["stop"]).when(ends, 1).when(marker & ~n["named"], 2)
                .when(take & (F.size(acc["parts"]) >= 3), 1).otherwise(0).alias("stop"),
                F.when(keep, n["x1"]).otherwise(acc["x1"]).alias("x1"), F.when(keep, n["y1"] - n["y0"]).otherwise(acc["h"]).alias("h"),
                F.struct(*[F.when(take, edge(c)).otherwise(acc["box"][c]).alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"))

        after = F.transform(F.slice(spans, i + 1, F.greatest(F.size(spans), F.lit(1))), marked)
        return F.aggregate(after, zero, step, lambda a: F.struct(
            (a["stop"] == 2).alias("abort"), a["box"].alias("box"), F.trim(F.array_join(F.filter(a["parts"], lambda p: p != ""), " ")).alias("name")))

    return F.transform(places, walk)


# --- page and image facts --------------------------------------------------

def page_cover(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of each page under raster images."""
    wide, high = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    s = images.groupBy("doc_id", "page").agg(F.sum(wide * high).alias("_area"))
    return pages.join(s, ["doc_id", "page"], "left").withColumn(
        "image_cover", F.coalesce("_area", F.lit(0.0)) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))).drop("_area")


def text_object_counts(traces: DataFrame) -> DataFrame:
    """Hidden (render type 3 or fully transparent) and visible text objects per page."""
    hidden = (F.col("render_type") == 3) | (F.coalesce("opacity", F.lit(1.0)) == 0)
    return traces.groupBy("doc_id", "page").agg(F.count_if(hidden).alias("invisible_text_spans"), F.count_if(~hidden).alias("visible_text_spans"))


def whiteout_patches(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Small, white, unstroked rectangles."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    d = drawings.where((F.col("fill_min") > 0.97) & ~F.col("stroked") & (area > 20))
    page_area = F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    return d.join(pages.select("doc_id", "page", page_area.alias("_pa")), ["doc_id", "page"]).where(area < 0.03 * F.col("_pa")).drop("_pa")


def page_classes(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """OCR pages (under 40 characters, over 30 % image) and overlay pages (over 60 % image with live text)."""
    chars = spans.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n_spans"))
    d = pages.drop("chars", "n_spans").join(chars, ["doc_id", "page"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    ocr = (F.col("chars") < 40) & (F.col("image_cover") > 0.3)
    overlay = ~ocr & (F.col("image_cover") > 0.6) & (F.col("visible_text_spans") > 0)
    return d.withColumn("ocr", ocr).withColumn("has_overlay", overlay | (ocr & (F.coalesce("n_spans", F.lit(0)) > 0)))


def large_jpegs(images: DataFrame) -> DataFrame:
    return images.where(F.lower("ext").isin("jpeg", "jpg") & (F.col("width_px") * F.col("height_px") > 250_000))


def unreadable_documents(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents of unknown type, and documents with fewer than 15 spans: why is 'kind' or 'words'."""
    n = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"))
    d = documents.join(n, "doc_id", "left").withColumn("n_spans", F.coalesce("n_spans", F.lit(0)))
    why = F.when(F.col("kind").isNull(), "kind").when(F.col("n_spans") < K.MIN_WORDS, "words")
    return d.select("doc_id", "n_spans", why.alias("why")).where(F.col("why").isNotNull())
