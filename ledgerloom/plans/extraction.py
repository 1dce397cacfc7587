"""The main flow: raw rows to schemas, routed rows, records, flags and review items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import normalized_row, parsed_values
from ..functions.vocab import AMBIGUOUS_BATCH
from ..operators.enrichment import (
    NOT_CONFIGURED,
    answers_for,
    ask_provider,
    direct_answers,
    enriched_records,
    provider_answers,
    rule_answers,
)
from ..operators.profiling import (
    attach_schema,
    head_sample,
    infer_schema,
    schema_roles,
    with_empty_documents,
)
from ..operators.proposals import (
    TIME_LIMIT,
    Provider,
    ask_for_schemas,
    proposed_columns,
    proposed_mapping,
)
from ..operators.routing import needs_enrichment, route_rows
from ..operators.scoring import review_items, score_answers, validate_answers, validation_flags
from ..operators.spread import join_measured
from ..session import write_through


def normalize_rows(raw_rows: DataFrame) -> DataFrame:
    """Add ``data``: parsed values under canonical names in stored form. ``raw`` is kept."""
    return raw_rows.withColumn("data", normalized_row(parsed_values(F.col("raw"))))


def document_schemas(raw_rows: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """First pass: schema per document, written out so the second pass knows how large it is.

    Rows are sampled before they are normalised, so this pass only ranks the rows' keys.
    """
    sample = normalize_rows(head_sample(raw_rows))
    return write_through(infer_schema(sample, proposed), "schemas")


def proposed_schemas(
    raw_rows: DataFrame, documents: DataFrame, provider: Provider, time_limit: float = TIME_LIMIT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schemas, column roles and failed proposals, asking ``provider`` once for each document.

    A document whose proposal is late, fails or is no schema takes the rules; one without rows
    gets the empty schema. Answers are written before they are used.
    """
    sample = write_through(normalize_rows(head_sample(raw_rows)), "sample")
    answers = write_through(ask_for_schemas(sample, provider, time_limit), "proposals")
    columns, mapping = proposed_columns(answers), proposed_mapping(answers)
    schema = with_empty_documents(infer_schema(sample, columns, mapping), documents)
    failed = answers.filter(F.col("error").isNotNull()).select("document_id", "error")
    return write_through(schema, "schemas"), schema_roles(sample, columns), failed


def documents_with_schemas(
    documents: DataFrame, raw_rows: DataFrame, provider: Provider | None = None,
    time_limit: float = TIME_LIMIT,
) -> DataFrame:
    """Documents with the whole schema that was inferred for them, by a provider or the rules."""
    if provider is not None:
        schema, roles, _ = proposed_schemas(raw_rows, documents, provider, time_limit)
    else:
        sample = write_through(normalize_rows(head_sample(raw_rows)), "sample")
        schema, roles = with_empty_documents(infer_schema(sample), documents), schema_roles(sample)
    return attach_schema(documents, schema, roles)


def route_documents(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """Second pass: every row with its document's slots, route, reasons and first confidence.

    Routing looks at the filled slots; ``inferred_slots`` keeps those that keywords decided.
    """
    slots = schemas.select(
        "document_id", F.col("filled").alias("slots"), F.col("slots").alias("inferred_slots")
    )
    joined = join_measured(rows, slots, ["document_id"])
    return route_rows(joined)


def settled_and_ambiguous(raw_rows: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """Flagship: both passes over raw rows, giving routed rows.

    Documents with a proposed schema take it, merged with their profile; the others take the rules.
    """
    return route_documents(normalize_rows(raw_rows), document_schemas(raw_rows, proposed))


@dataclass
class Enrichment:
    """Outputs of the enrichment stage; ``errors`` has ``document_id, row_index, error``."""

    records: DataFrame
    flags: DataFrame
    reviews: DataFrame
    errors: DataFrame


def _judged(ambiguous: DataFrame) -> DataFrame:
    """Enrichment judges rows by the slots that keywords decided; ``filled`` keeps the others."""
    return ambiguous.withColumns({"filled": F.col("slots"), "slots": F.col("inferred_slots")})


def _outputs(scored: DataFrame, errors: DataFrame, job_id: Column | None = None) -> Enrichment:
    return Enrichment(
        enriched_records(scored, job_id), validation_flags(scored), review_items(scored), errors
    )


def scored_answers(ambiguous: DataFrame, answer=rule_answers) -> DataFrame:
    """Answers with checks and scores."""
    return score_answers(validate_answers(answers_for(_judged(ambiguous), answer)))


def enrich(ambiguous: DataFrame, answer=rule_answers, job_id: Column | None = None) -> Enrichment:
    """Answer, check and score ambiguous rows.

    Without a provider nothing is enriched and each document reports one error. The scored rows are
    written once because three tables are made from them. ``job_id`` is the job they came from, by
    the columns of the row.
    """
    if answer is None:
        errors = ambiguous.groupBy("document_id").agg(
            F.lit(None).cast("bigint").alias("row_index"), F.lit(NOT_CONFIGURED).alias("error")
        )
        return _outputs(scored_answers(ambiguous.limit(0)), errors, job_id)
    scored = write_through(scored_answers(ambiguous, answer), "scored")
    none = "document_id string, row_index bigint, error string"
    return _outputs(scored, ambiguous.sparkSession.createDataFrame([], none), job_id)


def enrich_by_provider(
    ambiguous: DataFrame, provider, batch_size: int = AMBIGUOUS_BATCH,
    job_id: Column | None = None,
) -> Enrichment:
    """As ``enrich``, asking an outside provider for the rows that need it.

    Replies are written before they are used: a provider is asked once per batch, whatever is
    recomputed later. Failed batches and missing replies become error rows.
    """
    rows = _judged(ambiguous)
    asked = rows.filter(needs_enrichment())
    replies = write_through(ask_provider(asked, provider, batch_size), "replies")
    answers = direct_answers(rows.filter(~needs_enrichment())).unionByName(
        provider_answers(asked, replies)
    )
    scored = write_through(score_answers(validate_answers(answers)), "scored")
    errors = replies.filter(F.col("error").isNotNull())
    return _outputs(scored, errors.select("document_id", "row_index", "error"), job_id)
