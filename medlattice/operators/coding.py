"""Coding of verbatim terms against dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import term
from .tables import numbered

#: The dictionaries of the trial.
REACTIONS = {
    "Headache": "Nervous system disorders", "Nausea": "Gastrointestinal disorders", "Vomiting": "Gastrointestinal disorders", "Diarrhoea": "Gastrointestinal disorders",
    "Abdominal pain": "Gastrointestinal disorders", "Fatigue": "General disorders and administration site conditions", "Pyrexia": "General disorders and administration site conditions",
    "Dizziness": "Nervous system disorders", "Rash": "Skin and subcutaneous tissue disorders", "Pruritus": "Skin and subcutaneous tissue disorders",
    "Upper respiratory tract infection": "Infections and infestations", "Nasopharyngitis": "Infections and infestations", "Cough": "Respiratory, thoracic and mediastinal disorders",
    "Back pain": "Musculoskeletal and connective tissue disorders", "Arthralgia": "Musculoskeletal and connective tissue disorders", "Insomnia": "Psychiatric disorders", "Hypertension": "Vascular disorders",
}
REACTION_SYNONYMS = {"head ache": "Headache", "feeling sick to stomach": "Nausea", "tired all the time": "Fatigue", "sore throat and runny nose": "Nasopharyngitis"}
REACTION_AMBIGUOUS = {"bp high": "Hypertension | Blood pressure increased"}
DRUGS = {"Paracetamol": "N02BE01", "Ibuprofen": "M01AE01", "Amoxicillin": "J01CA04", "Omeprazole": "A02BC01", "Atorvastatin": "C10AA05", "Metformin": "A10BA02", "Salbutamol": "R03AC02"}
ACTIONS = {"uncoded": "Query site for clarification", "ambiguous": "Medical monitor to select term"}
DICTIONARIES = ("MedDRA", "WHODrug")
DRUG_SYNONYMS = {"tylenol": "Paracetamol", "advil": "Ibuprofen"}


def dictionary(spark, entries: dict[str, str], own: bool = False) -> DataFrame:
    """(term, preferred) lookup rows: of a dictionary's own terms, or of synonyms for them."""
    df = spark.createDataFrame([(k, k if own else v) for k, v in entries.items()], "key string, preferred string")
    return df.select(term(F.col("key")).alias("term"), "preferred")


def code_terms(df: DataFrame, verbatim: str, preferred: DataFrame, synonyms: DataFrame, ambiguous: DataFrame | None) -> DataFrame:
    """Adds term, status (auto, synonym, ambiguous, uncoded; the first that applies) and coded. Lookup tables (term, preferred) are
    unique by term."""
    out = df.withColumn("term", term(F.col(verbatim)))
    for name, side in (("_auto", preferred), ("_synonym", synonyms), ("_ambiguous", ambiguous)):
        out = out.join(side.select("term", F.col("preferred").alias(name)), "term", "left") if side is not None else out.withColumn(name, F.lit(None).cast("string"))
    status = F.when(F.col("_auto").isNotNull(), "auto").when(F.col("_synonym").isNotNull(), "synonym").when(F.col("_ambiguous").isNotNull(), "ambiguous").otherwise("uncoded")
    return out.withColumn("status", status).withColumn("coded", F.coalesce("_auto", "_synonym", "_ambiguous", F.lit(""))).drop("_auto", "_synonym", "_ambiguous")


def worklist(coded: DataFrame, verbatim: str, order: str) -> DataFrame:
    """Unresolved verbatims of each dictionary by the records they block, first seen first among equals; coded has the dictionary's name."""
    action = F.when(F.col("status") == "ambiguous", ACTIONS["ambiguous"]).otherwise(ACTIONS["uncoded"])
    out = coded.where("status in ('ambiguous', 'uncoded')").groupBy("dictionary", verbatim, "status").agg(F.count("*").alias("records_blocked"), F.min(order).alias("_first"))
    placed = numbered(out, [F.desc("records_blocked"), F.col("_first"), F.col("dictionary"), F.col(verbatim)], "place")
    return placed.withColumn("place", F.col("place").cast("int")).withColumn("suggested_action", action).drop("_first")
