"""Reports of scans: rows for a reader, and the same as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(quality: Column, present: Column) -> Column:
    """The class of a result: present, absent or unusable."""
    return F.when((quality != "usable") | present.isNull() | quality.isNull(), "unusable").when(present, "present").otherwise("absent")


def verdict_label(quality: Column, present: Column, source: Column) -> Column:
    kind = verdict(quality, present)
    return F.when(kind == "unusable", F.concat(F.lit("unusable ("), source, F.lit(")"))).otherwise(kind)


def confidence_class(value: Column) -> Column:
    return F.when(value.isin("high", "medium", "low"), value).otherwise("low")


def interval_text(status: Column, there: Column, start: Column, end: Column, mid: Column, confidence: Column) -> Column:
    dash = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-"))
    return F.when(there, F.concat(F.lit("interval=["), dash(start), F.lit(", "), dash(end), F.lit("]  mid="), dash(mid), F.lit("  confidence="), dash(confidence))).otherwise(F.concat(F.lit("status="), status, F.lit(" (no interval row available)")))


def anchor_report(states: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row a state, with its interval where there is one."""
    own = intervals.select("anchor_id", F.lit(True).alias("_there"), "interval_start", "interval_end", "mid_estimate", "confidence", F.col("notes").alias("_notes"))
    rows = states.join(own, "anchor_id", "left")
    there = F.coalesce("_there", F.lit(False))
    return rows.select(
        "anchor_id", "status", confidence_class(F.col("confidence")).alias("confidence_class"), interval_text(F.col("status"), there, *(F.col(c) for c in ("interval_start", "interval_end", "mid_estimate", "confidence"))).alias("summary"),
        F.when(there, F.col("_notes")).otherwise(F.coalesce("notes", F.lit(""))).alias("notes"), "rounds",
    )


def chip_report(states: DataFrame) -> DataFrame:
    """One row a result, in its round's order of dates."""
    rounds = states.select("anchor_id", F.explode("rounds").alias("r"))
    chips = rounds.select("anchor_id", "r.round_id", "r.round_type", F.posexplode(F.sort_array(F.transform("r.results", lambda x, i: F.struct(x["capture_date"].alias("d"), i.alias("i"), x.alias("x"))))).alias("position", "c"))
    x = F.col("c.x")
    return chips.select("anchor_id", "round_id", "round_type", "position", F.col("c.d").alias("capture_date"), verdict(x["quality_flag"], x["pv_present"]).alias("verdict"), verdict_label(x["quality_flag"], x["pv_present"], x["decision_source"]).alias("label"), x["actual_zoom"].alias("zoom"), F.left(F.coalesce(x["evidence"], F.lit("")), F.lit(200)).alias("evidence"))


def escaped(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def html_sections(states: DataFrame, intervals: DataFrame) -> DataFrame:
    """``anchor_id`` and ``html``, a section of a page; no images."""
    text = lambda c: escaped(F.coalesce(c.cast("string"), F.lit("-")))

    def chip(x: Column) -> Column:
        kind = verdict(x["quality_flag"], x["pv_present"])
        return F.concat(F.lit("<li class='"), kind, F.lit("'>"), text(x["capture_date"]), F.lit(" "), text(verdict_label(x["quality_flag"], x["pv_present"], x["decision_source"])), F.lit("</li>"))

    def block(r: Column) -> Column:
        chips = F.array_join(F.transform(F.sort_array(F.transform(r["results"], lambda x, i: F.struct(x["capture_date"].alias("d"), i.alias("i"), x.alias("x")))), lambda c: chip(c["x"])), "")
        return F.concat(F.lit("<h3>R"), r["round_id"].cast("string"), F.lit(" "), text(r["round_type"]), F.lit("</h3><ul>"), chips, F.lit("</ul>"))

    rows = anchor_report(states, intervals)
    page = F.concat(F.lit("<section><h2>"), text(F.col("anchor_id")), F.lit(" "), text(F.col("status")), F.lit("</h2><p>"), text(F.col("summary")), F.lit("</p><p>"), text(F.col("notes")), F.lit("</p>"), F.array_join(F.transform("rounds", block), ""), F.lit("</section>"))
    return rows.select("anchor_id", page.alias("html"))
