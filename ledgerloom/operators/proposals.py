"""Schemas proposed by an outside provider, one call per document, with a time limit.

A provider gets a document's columns and first rows and answers with a schema as JSON. A call that
takes too long, fails, or answers with something else leaves the document to the rules; an
accepted answer keeps its own quality, notes and unmapped columns.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from .headers import filled_index
from .profiling import distinct_columns, sample_cells

#: Seconds that a provider has for a document.
TIME_LIMIT = 10.0
TIMED_OUT = "LLM schema inference timeout"

# The JSON of a proposed schema, and the keys of its slots.
SLOT_KEYS = {
    "assetNameColumn": "asset_name", "valueColumn": "value", "currencyColumn": "currency",
    "jurisdictionColumn": "jurisdiction", "latitudeColumn": "latitude",
    "longitudeColumn": "longitude", "assetTypeColumn": "asset_type",
}
SLOT_ENTRY = "struct<column string, confidence double>"
PROPOSAL_JSON = (
    "columns array<struct<name string, detectedType string, semanticRole string, confidence double, "
    "reasoning string>>, fieldMapping struct<"
    + ", ".join(f"{key} {SLOT_ENTRY}" for key in SLOT_KEYS)
    + ">, unmappedColumns array<struct<name string, reason string>>, schemaQuality struct<"
    "completeness double, ambiguityScore double, deterministicCoverage double, needsReview boolean>, "
    "inferenceNotes array<string>"
)

Provider = Callable[[list[str], list[dict]], dict | str]


def requests(sample: DataFrame) -> DataFrame:
    """``document_id, columns, rows``: what a provider is asked about each document.

    The columns of all sampled rows in first-seen order, and as JSON the rows from the first one
    with data on; both are bounded by the sample.
    """
    columns = distinct_columns(sample_cells(sample)).groupBy("document_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("column_pos", "column"))), lambda c: c["column"]
        ).alias("columns"))
    start = F.min(filled_index())
    listed = sample.withColumn("_row", F.to_json("data", {"ignoreNullFields": "false"})).groupBy(
        "document_id").agg(
        F.array_sort(F.collect_list(F.struct("sample_pos", "_row"))).alias("_rows"),
        F.coalesce(start, F.lit(0)).alias("_start"))
    used = F.filter("_rows", lambda r: r["sample_pos"] > F.col("_start"))
    rows = listed.select("document_id", F.transform(used, lambda r: r["_row"]).alias("rows"))
    return columns.join(rows, "document_id")


def _answer(provider: Provider, columns: list[str], rows: list[dict], limit: float) -> tuple:
    """The answer as JSON text, or why there is none. A late call is left behind."""
    got: dict = {}

    def call() -> None:
        try:
            made = provider(columns, rows)
            got["text"] = made if isinstance(made, str) else json.dumps(made)
        except Exception as error:
            got["error"] = f"{type(error).__name__}: {error}"

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(limit)
    if not got:
        return None, TIMED_OUT
    return got.get("text"), got.get("error")


def ask_for_schemas(
    sample: DataFrame, provider: Provider, time_limit: float = TIME_LIMIT
) -> DataFrame:
    """``document_id, proposal, error``: a provider's answer for each document of ``head_sample``.

    ``proposal`` is null and ``error`` says why where the call was late or failed, or the answer
    is no schema (no JSON, or without columns, mapping or quality). Write the result before it is
    used more than once: every evaluation asks again.
    """

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            answers = [
                _answer(provider, columns, [json.loads(r) for r in rows], time_limit)
                for columns, rows in zip(batch["columns"].to_pylist(), batch["rows"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["document_id"], *(pa.array(x, pa.string()) for x in zip(*answers))]
                if answers else [batch["document_id"], pa.array([], pa.string()), pa.array([], pa.string())],
                names=["document_id", "text", "failure"])

    kind = sample.schema["document_id"].dataType.simpleString()
    asked = requests(sample).select("document_id", "columns", "rows").mapInArrow(
        ask, f"document_id {kind}, text string, failure string")
    parsed = F.from_json("text", PROPOSAL_JSON)
    known = asked.withColumn("_parsed", parsed)
    whole = (
        F.col("_parsed.columns").isNotNull() & F.col("_parsed.fieldMapping").isNotNull()
        & F.col("_parsed.schemaQuality").isNotNull()
    )
    return known.select(
        "document_id", F.when(whole, F.col("_parsed")).alias("proposal"),
        F.when(~F.coalesce(whole, F.lit(False)), F.coalesce("failure", F.lit("not a schema"))).alias("error"),
    )


def accepted(proposals: DataFrame) -> DataFrame:
    return proposals.filter(F.col("proposal").isNotNull())


def proposed_columns(proposals: DataFrame) -> DataFrame:
    """The columns of accepted proposals in the form that ``merge_with_profile`` takes.

    A column that has no slot has a null ``slot``; one with two slots is there twice.
    """
    columns = accepted(proposals).select(
        "document_id", "proposal.fieldMapping", F.posexplode("proposal.columns").alias("_pos", "_column"))
    slots = F.filter(
        F.array(*[
            F.struct(
                F.lit(slot).alias("slot"), F.col("fieldMapping")[key]["column"].alias("column"),
                F.col("fieldMapping")[key]["confidence"].alias("confidence"))
            for key, slot in SLOT_KEYS.items()
        ]),
        lambda s: s["column"] == F.col("_column.name"))
    return columns.select(
        "document_id", F.col("_column.name").alias("column"), (F.col("_pos") + 1).alias("column_pos"),
        F.col("_column.semanticRole").alias("role"), F.col("_column.detectedType").alias("detected_type"),
        F.col("_column.confidence").alias("confidence"), F.col("_column.reasoning").alias("reasoning"),
        F.explode_outer(slots).alias("_slot"),
    ).select(
        "*", F.col("_slot.slot").alias("slot"), F.col("_slot.confidence").alias("slot_confidence")
    ).drop("_slot")


def proposed_mapping(proposals: DataFrame) -> DataFrame:
    """``document_id``, the proposed column of every slot, and the proposal's quality and notes."""
    quality, mapping = F.col("proposal.schemaQuality"), F.col("proposal.fieldMapping")
    slots = [F.nullif(mapping[key]["column"], F.lit("")).alias(slot) for key, slot in SLOT_KEYS.items()]
    ordered = F.struct(*slots)
    return accepted(proposals).select(
        "document_id",
        F.struct(*[ordered[slot].alias(slot) for slot in vocab.SLOTS]).alias("proposed_slots"),
        quality["completeness"].alias("completeness"),
        quality["ambiguityScore"].alias("ambiguity_score"),
        quality["deterministicCoverage"].alias("deterministic_coverage"),
        quality["needsReview"].alias("needs_review"),
        F.coalesce(F.col("proposal.inferenceNotes"), F.array().cast("array<string>")).alias("inference_notes"),
        F.col("proposal.unmappedColumns").alias("proposed_unmapped"),
    )


