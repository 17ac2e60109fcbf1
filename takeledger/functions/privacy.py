"""Contact details in paperwork: found and redacted narrowly, so that rolls and dates survive."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An address, a number that the text labels as a phone, an international number.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LABELLED = r"(?i)\b(tel|tlf|phone|mobile|m[oó]vil|movil|cel|celular|whatsapp)\b\s*[:.]?\s*[+()\d][\d\s().-]{6,}"
INTERNATIONAL = r"\+\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?){2,}\d{2,4}"
EMAIL_MARK, PHONE_MARK = "[email removed]", "[phone removed]"


def is_contact(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike(EMAIL) | t.rlike(LABELLED) | t.rlike(INTERNATIONAL)


def redacted(text: Column) -> Column:
    t = F.regexp_replace(text, EMAIL, EMAIL_MARK)
    t = F.regexp_replace(t, LABELLED, "$1: " + PHONE_MARK.replace("[", "\\[").replace("]", "\\]"))
    return F.regexp_replace(t, INTERNATIONAL, PHONE_MARK)


def servable(documents: DataFrame, serve_all: bool = False) -> DataFrame:
    """Synthetic and demonstration documents; all of them where serving is enabled."""
    name, production = F.lower(F.coalesce("filename", F.lit(""))), F.upper(F.coalesce("production_id", F.lit("")))
    shown = F.coalesce(F.col("synthetic"), F.lit(False)) | name.contains("synthetic") | name.contains("demo") | production.contains("DEMO")
    return documents if serve_all else documents.filter(shown)
