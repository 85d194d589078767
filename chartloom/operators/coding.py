"""Allergy lookup per patient and matching of allergy texts with code definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from chartloom.operators.similarity import topk_similar
from chartloom.session import scratch_folder
from chartloom.sinks.tables import lookup_folder, overwrite_folder

ALLERGY_TEXT = "AL1_3"
#: Ranked definitions that may go to all tasks.
MOST_BROADCAST = 65_536


def store_allergies(allergies: DataFrame, path: str) -> DataFrame:
    """The allergy table laid out for lookups of single patients."""
    return lookup_folder(allergies, path, "patient_id")


def allergies_of(allergies: DataFrame, patient_id: str) -> DataFrame:
    """Allergy rows of one patient."""
    return allergies.filter(F.col("patient_id") == patient_id).select("AL1_1", "AL1_2", ALLERGY_TEXT)


def allergies_of_patients(allergies: DataFrame, patients: DataFrame) -> DataFrame:
    """Allergy rows of all patients in a table with ``patient_id``."""
    return allergies.join(patients.select("patient_id"), "patient_id", "left_semi")


def allergies_by_patient(allergies: DataFrame) -> DataFrame:
    """Sorted distinct allergy texts per patient; sets are merged before and after the shuffle."""
    return (
        allergies.filter(F.col(ALLERGY_TEXT).isNotNull())
        .groupBy("patient_id")
        .agg(F.sort_array(F.collect_set(ALLERGY_TEXT)).alias("allergies"))
    )


def distinct_allergies(allergies: DataFrame) -> DataFrame:
    return allergies.select(ALLERGY_TEXT).filter(F.col(ALLERGY_TEXT).isNotNull()).distinct()


def code_descriptions(
    descriptions: DataFrame, index: DataFrame, embed: Callable[..., DataFrame], k: int = 5
) -> DataFrame:
    """The ``k`` nearest definition chunks of each distinct description: text, chunk, score, rank."""
    queries = embed(descriptions, ALLERGY_TEXT)
    return topk_similar(
        queries, index, k, query_id=ALLERGY_TEXT, corpus_id="chunk_id"
    )


def code_allergies(
    allergies: DataFrame, index: DataFrame, embed: Callable[..., DataFrame], k: int = 5
) -> DataFrame:
    """Ranked definition chunks for every allergy of every patient.

    Each description is embedded and matched once, however many patients have it. The rows of the patients never
    pass the driver: stored, they take so few bytes that Spark would broadcast many millions of them.
    """
    found = code_descriptions(distinct_allergies(allergies), index, embed, k)
    matches = overwrite_folder(found, scratch_folder(found.sparkSession, "matches"))
    matches = F.broadcast(matches) if matches.count() <= MOST_BROADCAST else matches.hint("merge")
    rows = allergies.select("patient_id", ALLERGY_TEXT).distinct()
    return rows.join(matches, ALLERGY_TEXT).select(
        "patient_id", ALLERGY_TEXT, "rank", "chunk_id", "score"
    )
