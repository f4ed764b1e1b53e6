"""Activity labels: keys, vocabularies and their normalisation as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical labels and their spelling variants.
MAIN_LABELS = ("completion", "drilling", "formation_evaluation", "interruption", "moving", "plug_abandon", "workover")
SUB_LABELS = (
    "anchor", "bop_activities", "bop_wellhead_equipment", "casing", "cement_plug", "circulating_conditioning",
    "circulation_samples", "completion_string", "core", "cut", "drill", "drill_stem_test", "equipment_recovery", "fish",
    "hole_open", "log", "lost_circulation", "maintain", "mechanical_plug", "mill", "other", "perforate", "position",
    "pressure_detection", "ream", "repair", "rft_fit", "rig_up_down", "sidetrack", "skid", "squeeze", "survey",
    "test_scsssv", "transit", "trip", "wait", "waiting_on_weather", "well_control", "wireline",
)
MAIN_ALIASES = {
    "formationevaluation": "formation_evaluation", "plug abandon": "plug_abandon", "plug and abandon": "plug_abandon",
    "plugabandon": "plug_abandon",
}
SUB_ALIASES = {
    "bop activities": "bop_activities", "bopactivities": "bop_activities", "bop wellhead equipment": "bop_wellhead_equipment",
    "bop wellheadequipment": "bop_wellhead_equipment", "cement plug": "cement_plug", "cementplug": "cement_plug",
    "circulating conditioning": "circulating_conditioning", "circulatingconditioning": "circulating_conditioning",
    "circulation samples": "circulation_samples", "completion string": "completion_string",
    "drill stem test": "drill_stem_test", "drill stemtest": "drill_stem_test", "drillstem test": "drill_stem_test",
    "equipment recovery": "equipment_recovery", "hole open": "hole_open", "lost circulation": "lost_circulation",
    "lostcirculation": "lost_circulation", "mechanical plug": "mechanical_plug", "mechanicalplug": "mechanical_plug",
    "pressure detection": "pressure_detection", "pressuredetection": "pressure_detection", "rft fit": "rft_fit",
    "rig up down": "rig_up_down", "rigup down": "rig_up_down", "surv ey": "survey", "test scsssv": "test_scsssv",
    "testscsssv": "test_scsssv", "waiting on weather": "waiting_on_weather", "waiting onweather": "waiting_on_weather",
    "waitingon weather": "waiting_on_weather", "well control": "well_control", "wellcontrol": "well_control",
    "wire line": "wireline",
}


def label_key(label: Column) -> Column:
    """A label's comparison key: line ends dropped, lower case, runs of other characters one space; null if nothing is left."""
    flat = F.regexp_replace(F.lower(F.regexp_replace(label, "\n", "")), "[^a-z0-9]+", " ")
    return F.nullif(F.trim(flat), F.lit(""))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalize_label(label: Column, labels: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """(label, method, confidence, matched): canonical 1.0, alias 0.99, else unknown 0.0."""
    key = label_key(label)
    canonical = F.try_element_at(_lookup({x.replace("_", " "): x for x in labels}), key)
    alias = F.try_element_at(_lookup(aliases), key)
    return F.struct(
        F.coalesce(canonical, alias, F.lit("unknown")).alias("label"),
        F.when(canonical.isNotNull(), "canonical").when(alias.isNotNull(), "alias").otherwise("unknown").alias("method"),
        F.when(canonical.isNotNull(), 1.0).when(alias.isNotNull(), 0.99).otherwise(0.0).alias("confidence"),
        F.when(F.coalesce(canonical, alias).isNotNull(), key).alias("matched"),
    )


def normalize_main(label: Column) -> Column:
    """Normalised main activity."""
    return normalize_label(label, MAIN_LABELS, MAIN_ALIASES)


def normalize_sub(label: Column) -> Column:
    """Normalised sub-activity."""
    return normalize_label(label, SUB_LABELS, SUB_ALIASES)
