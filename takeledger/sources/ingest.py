"""Documents to the ledger: parsing by kind, events, date claims, refusals, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeledger.functions import normalize as n
from takeledger.sources import reports
from takeledger.sources.documents import KEYS
from takeledger.sources.paperwork import classified, has_clip_elements, has_table, parse_camera_csv, parse_daily_report, parse_media_xml, parse_sound_log

#: Kinds of documents, what they speak of, and the department and axis that classified() gives the
#: kind; of kinds with several layouts, which documents each
#: parser takes: the first whose condition holds.
PARSERS = {
    "camera_csv": (((parse_camera_csv, has_table), (reports.parse_camera_log, None)), "take", "camera", "belief"),
    "sound_ale": (((parse_sound_log, None),), "take", "sound", "belief"),
    "script_timecode": (((reports.parse_script_log, None),), "take", "script", "belief"),
    "script_lined": (((reports.parse_editor_log, None),), "take", "script", "belief"),
    "offload": (((parse_media_xml, has_clip_elements), (reports.parse_offload_text, None)), "media", "dit", "existence"),
    "dpr": (((parse_daily_report, None),), "day", "office", "intent"),
}


#: What a statement speaks of where its document could not be read.
FAILED = "error"


def parsed(docs: DataFrame) -> DataFrame:
    """What parsers make of all documents: events, and for a document that one failed on a row whose
    entity_type is FAILED and whose payload is the error.

    A statement that names another day than its document's is filed under its own day. Events of
    one document share nothing but it, so ids are of its content and place.
    """
    kinds, out = classified(docs), None
    for kind, (parsers, entity, department, axis) in PARSERS.items():
        others = F.col("doc_type") == kind
        for parse, takes in parsers:
            mine, others = (others & takes(), others & ~takes()) if takes else (others, None)
            rows = parse(kinds.filter(mine))
            fields = [c for c in rows.columns if c not in (*KEYS, "error")]
            day = F.coalesce("stated_day", "shoot_day") if "stated_day" in fields else F.col("shoot_day")
            said, what = F.to_json(F.struct(*fields)), F.lit(entity)
            if "error" in rows.columns:
                said, what = F.coalesce("error", said), F.when(F.col("error").isNotNull(), FAILED).otherwise(what)
            events = rows.select(*[day.alias(k) if k == "shoot_day" else k for k in KEYS], F.lit(kind).alias("doc_type"), what.alias("entity_type"), said.alias("payload_json"), F.lit(department).alias("department"), F.lit(axis).alias("axis"))
            out = events if out is None else out.unionByName(events)
    return out.withColumn("event_id", F.sha2(F.concat_ws("|", "doc_id", "payload_json"), 256))


def parsed_events(docs: DataFrame) -> DataFrame:
    """Events of all documents that a parser reads; one statement a row, payload as JSON."""
    return parsed(docs).filter(F.col("entity_type") != FAILED)


def take_events(docs: DataFrame) -> DataFrame:
    """The events of documents that log takes."""
    return parsed_events(docs).filter("entity_type = 'take'").drop("axis")


def late_takes(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Events that are filed under another day than their document came in for."""
    filed = docs.select("doc_id", F.col("shoot_day").alias("envelope_day")).distinct()
    return events.join(filed, "doc_id").filter("shoot_day <> envelope_day")


def date_claims(docs: DataFrame) -> DataFrame:
    """What each document says of its day's date, also those that no parser reads."""
    claim = n.shoot_date(F.col("content"), F.col("filename"))
    return docs.select(*KEYS, claim.alias("c")).filter("c is not null").select(*KEYS, "c.date", "c.source", F.col("c.shoot_day").alias("stated_shoot_day"))


def rejected(docs: DataFrame, statements: DataFrame) -> DataFrame:
    """Documents that gave no event, with the kind of error and the reason.

    statements: what parsed() gives (of parsed_events no failure is known). A document without a
    production or a day is INVALID, whatever it holds; one that its parser failed on is a
    SYSTEM_ERROR with what was raised, even if other rows of it were read; the rest, which parsers
    read and found nothing in, are PARSER_FAILURE.
    """
    of = statements.groupBy("doc_id").agg(F.min(F.when(F.col("entity_type") == FAILED, F.col("payload_json"))).alias("raised"))
    kinds = classified(docs).join(of.withColumn("parsed", F.lit(True)), "doc_id", "left").filter("parsed is null or raised is not null")
    bare = F.coalesce(F.trim("production_id"), F.lit("")) == ""
    bare = bare | (F.coalesce(F.trim("shoot_day"), F.lit("")) == "")
    error = F.when(bare, "INVALID").when(F.col("raised").isNotNull(), "SYSTEM_ERROR").otherwise("PARSER_FAILURE")
    empty = F.trim(F.coalesce("content", F.lit(""))) == ""
    reason = F.when(bare, "no production or day").when(F.col("raised").isNotNull(), F.col("raised")).when(empty, "empty document").otherwise("no valid rows")
    return kinds.select(*KEYS, "doc_type", error.alias("error_type"), reason.alias("reason"))


def write_spine(events: DataFrame, path: str) -> None:
    """Appended, by production and day, so that a day is one folder."""
    events.write.mode("append").partitionBy("production_id", "shoot_day").parquet(path)
