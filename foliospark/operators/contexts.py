"""Chunks as contexts of prompts: which ones, how many, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.strings import cleaned

#: Leading chunks, and characters, that a prompt of each kind reads.
CLASSIFY, CLASSIFY_CHARS, EXTRACTION, SUMMARY = 5, 2000, 10, 15
PREVIEW = 150


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks that a search may return: no parents, and with an embedding."""
    return chunks.filter((F.col("chunk_level") != "parent") & F.col("embedding").isNotNull())


def extraction_chunks(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Parents and flat chunks of each document, or all of its chunks where it has neither."""
    fits = F.col("chunk_level").isin("parent", "flat")
    some = F.max(fits).over(Window.partitionBy(document))
    return chunks.withColumn("__some", some).filter(fits | ~F.col("__some")).drop("__some")


def leading(chunks: DataFrame, n: int, document: str = "document_id", order: str = "chunk_num") -> DataFrame:
    """The first n chunks of each document."""
    return chunks.withColumn("__nth", F.row_number().over(Window.partitionBy(document).orderBy(order))).filter(F.col("__nth") <= n).drop("__nth")


def joined_context(chunks: DataFrame, n: int = CLASSIFY, chars: int = CLASSIFY_CHARS, document: str = "document_id", order: str = "chunk_num") -> DataFrame:
    """document and the text of its first n chunks, one after the other, cut to so many characters."""
    parts = leading(chunks, n, document, order).groupBy(document).agg(F.sort_array(F.collect_list(F.struct(order, "content"))).alias("x"))
    return parts.select(document, F.substring(F.array_join(F.col("x.content"), "\n\n"), 1, chars).alias("context"))


def source(kind: Column) -> list[Column]:
    """How a chunk is shown as a source: a preview, and by its kind the picture, its caption and its place."""
    kind = F.coalesce(kind, F.lit("text"))
    figure = kind == "figure"
    return [
        F.substring(F.coalesce("content", F.lit("")), 1, PREVIEW).alias("preview"), kind.alias("chunk_type"), F.when(figure | kind.isin("description", "table"), F.col("image_ref")).alias("image_ref"),
        F.when(figure, F.coalesce("caption", F.lit(""))).alias("caption"), F.when(figure, F.col("bbox")).alias("bbox"),
    ]


def table_chunk(title: Column, text: Column) -> Column:
    """A table as a chunk of text; null without any."""
    named = F.concat(F.lit("[Table: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled")), F.lit("]\n"), text)
    return F.when(F.trim(text) != "", cleaned(named))


def description_chunk(page: Column, text: Column) -> Column:
    """A picture's description as a chunk of text; null without any."""
    return F.when(cleaned(text) != "", F.concat(F.lit("[Visual Description — Page "), page.cast("string"), F.lit("]: "), cleaned(text)))


def flat_metadata(page: Column, file: Column, kind: Column, image: Column) -> Column:
    """What goes with a chunk that has no parent."""
    return F.struct(page.cast("string").alias("page"), file.alias("file"), kind.alias("chunk_type"), image.alias("image_ref"), F.lit("flat").alias("chunk_level"), F.lit(None).cast("string").alias("parent_chunk_id"))


def normalised(doc_type: Column, confidence: Column, threshold: float) -> list[Column]:
    """A model's answer as a classification: the type in lower case, and whether a person should look."""
    return [F.lower(F.trim(doc_type)).alias("doc_type"), confidence.cast("double").alias("confidence"), (confidence < threshold).alias("requires_human_review"), F.lit("stage2").alias("stage_used")]


def overridden(classification: Column, doc_type: Column, template: Column) -> Column:
    """A classification struct set by hand: certain, flagged, and out of review; its other fields stay."""
    new = classification.withField("doc_type", doc_type).withField("schema_template", F.coalesce(template, doc_type)).withField("confidence", F.lit(1.0))
    return new.withField("manually_overridden", F.lit(True)).withField("requires_human_review", F.lit(False))


#: Fields that corrections are shown for, the latest of each that are looked at, and all that are shown.
CORRECTED_FIELDS, CORRECTIONS, SHOWN = 5, 3, 5


def correction_examples(corrections: DataFrame, fields: list[str]) -> DataFrame:
    """doc_type, place, field, original, corrected: what reviewers changed, for prompts of each type of document.

    Of the first CORRECTED_FIELDS fields the latest CORRECTIONS rows with the action `correct` count, by created_at, ties to the
    smaller id. Of these, rows whose two values differ and aren't empty or null are shown, field by field, SHOWN in all.
    corrections(id, doc_type, field, original, corrected, action, created_at). Ranks are cut in the tasks before anything
    moves, so a type or a field with most of the rows sends few of them."""
    order = F.create_map(*(x for i, f in reversed(list(enumerate(fields[:CORRECTED_FIELDS]))) for x in (F.lit(f), F.lit(i))))
    known = corrections.filter(F.col("field").isin(fields[:CORRECTED_FIELDS]) & (F.col("action") == "correct"))
    latest = Window.partitionBy("doc_type", "field").orderBy(F.desc_nulls_last("created_at"), "id")
    some = known.withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") <= CORRECTIONS)
    told = some.filter((F.col("original") != "") & (F.col("corrected") != "") & (F.col("original") != F.col("corrected")))
    shown = Window.partitionBy("doc_type").orderBy(F.try_element_at(order, F.col("field")), "_nth")
    return told.withColumn("place", F.row_number().over(shown)).filter(F.col("place") <= SHOWN).select("doc_type", "place", "field", "original", "corrected")
