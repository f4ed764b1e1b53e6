"""Checks of a verbal answer against the facts that it was given, and answers in the asker's language."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspar.functions.text import cited_files, numbers

# Phrases that assert, that map, and that claim all.
ASSERTS = ("occurred", "baş verib", "confirmed")
MAPS = ("are the same", "corresponds to", "eynidir", "uyğundur")
CLAIMS_ALL = ("all failures occurred during", "bütün nasazlıqlar")
MAPPING_ROUTES = ("hybrid_mapping", "structured_mapping")
# Answers in Azerbaijani by route, what stands for a missing fact, and sentences that follow if their fact is known.
TEMPLATES_AZ = {
    "hybrid_summary": "{wellbore} üçün {period_end} tarixli DDR-də {operation_count} əməliyyat sətri çıxarılıb; {fail_operation_count} əməliyyat sətri nasaz vəziyyət kimi işarələnib.",
    "structured_report_lookup": "{wellbore} üçün {n_rows} mənbə-dəstəkli hesabat xülasəsi tapıldı. Ən son hesabatın tarixi {report_date}-dir.",
    "plot_analytics": "{plot_identifiers} daxilində {series_identifier} üçün {point_count} saxlanmış nöqtə əsasında Theil-Sen meyli {slope} naməlum təzyiq vahidi/gün, Spearman rho isə {spearman_rho} kimi hesablanıb. Təzyiq vahidi məlum deyil.",
}
MISSING_AZ = {
    "hybrid_summary": {"wellbore": "Naməlum quyu", "period_end": "tarixi məlum olmayan dövr", "operation_count": "0", "fail_operation_count": "0"},
    "structured_report_lookup": {"wellbore": "naməlum quyu", "report_date": "tarixi məlum olmayan"},
    "plot_analytics": {"plot_identifiers": "seçilmiş qrafik", "series_identifier": "seçilmiş sıra", "point_count": "0", "slope": "None", "spearman_rho": "None"},
}
FOLLOWING_AZ = {
    "hybrid_summary": {"summary_activities": " Mənbə fəaliyyət xülasəsi: {summary_activities}", "summary_planned": " Planlaşdırılan fəaliyyət: {summary_planned}"},
    "structured_report_lookup": {"completed_activities": " Tamamlanan fəaliyyətlər: {completed_activities}", "planned_activities": " Planlaşdırılan fəaliyyətlər: {planned_activities}"},
}
BELOW_MIN_AZ = "MIN əyrisindən aşağı təsnif edilmiş {n_rows} ölçülmüş profil nöqtəsi tapıldı."
NO_MAPPING_AZ = "Mövcud metadata bu uyğunluğu təsdiqləmir. Eyni rəqəmli indekslər təzyiq profilinin, təzyiq-zaman faylının, göstərilən sıranın və ya DDR quyusunun eyni obyekt olduğunu sübut etmir."
FAILURES_AZ = "{0} doldurulmuş avadanlıq nasazlığı qeydi, bölməni ehtiva edən {2} hesabatdan {1}-də aşkarlandı. {3} qeyd üçün əməliyyat vaxt uyğunluğu təsdiqləndi; {4} qeyddə uyğunluq qeyri-müəyyəndir, {5} qeyd uyğunlaşdırılmayıb və {6} qeyddə etibarlı Operations intervalı yoxdur. Cədvəldə tarixlər, mənbə səhifələri və uyğunluq statusları göstərilir."
FAILURES_SHORT_AZ = "Avadanlıq nasazlığı qeydləri mənbə və vaxt uyğunluğu ilə cədvəldə göstərilir."
UNKNOWN_AZ = "Mövcud emal edilmiş məlumat bu faktı müəyyən etmir."
FAILURE_ROUTES = ("structured_failure_activity", "structured_equipment_failures")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def rejection(answer: Column, route: Column, *, n_rows: Column, n_evidence: Column, unresolved: Column, unit_unknown: Column, files: Column, facts: Column) -> Column:
    """The first rule that an answer breaks, else null.

    ``files`` are the names that may be cited, ``facts`` the text of everything that was given,
    ``unresolved`` the number of matches that aren't exact or overlapping.
    """
    low = F.lower(answer)
    return (
        F.when((n_evidence == 0) & _any(low, ASSERTS), "fact_without_evidence")
        .when(route.isin(*MAPPING_ROUTES) & (n_rows == 0) & _any(low, MAPS), "mapping_unresolved")
        .when(unit_unknown & low.rlike(r"\b(psi|kpa|mpa|bar)\b"), "pressure_unit_unknown")
        .when(route.isin(*FAILURE_ROUTES) & (unresolved > 0) & _any(low, CLAIMS_ALL), "matches_unresolved")
        .when(F.size(F.array_except(cited_files(answer), files)) > 0, "foreign_citation")
        .when(F.size(F.array_except(numbers(answer), numbers(facts))) > 0, "unsupported_number")
    )


def verify(rows: DataFrame) -> DataFrame:
    """Adds rejection and the text to show: the answer, or the deterministic one if it was rejected."""
    why = rejection(
        F.col("answer"), F.col("route"), n_rows=F.col("n_rows"), n_evidence=F.col("n_evidence"), unresolved=F.col("unresolved"),
        unit_unknown=F.col("unit_unknown"), files=F.col("files"), facts=F.col("facts"),
    )
    return rows.withColumn("rejection", why).withColumn("shown", F.when(F.col("rejection").isNull(), F.col("answer")).otherwise(F.col("deterministic")))


def summary_sentence(language: Column, wellbore: Column, period: Column, operations: Column, failed: Column) -> Column:
    """The daily summary's sentence in English or Azerbaijani."""
    en = F.format_string("%s, %s: %d operations, %d in a failed state.", F.coalesce(wellbore, F.lit("Unknown well")), F.coalesce(period, F.lit("unknown period")), operations, failed)
    az = F.format_string("%s, %s: %d əməliyyat, %d nasaz vəziyyət.", F.coalesce(wellbore, F.lit("Naməlum quyu")), F.coalesce(period, F.lit("tarix naməlum")), operations, failed)
    return F.when(language == "az", az).otherwise(en)


def _filled(template: str, value: Callable[[str], Column]) -> Column:
    """A template whose {names} are replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(value(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def localized(answer: Column, route: Column, language: Column, facts: Column, n_rows: Column) -> Column:
    """The deterministic answer in the asker's language: English as it is, Azerbaijani by the route's template.

    ``facts`` is a map of the first row's values as text, ``n_rows`` the number of rows; null, empty
    and missing facts are replaced or left out.
    """
    fact = lambda name: F.when(F.try_element_at(facts, F.lit(name)) != "", F.try_element_at(facts, F.lit(name)))
    known = F.coalesce(n_rows, F.lit(0)) > 0
    number = F.coalesce(n_rows, F.lit(0)).cast("string")
    out = F.when(F.coalesce(language != "az", F.lit(True)), answer)
    for name, template in TEMPLATES_AZ.items():
        value = lambda x, missing=MISSING_AZ[name]: number if x == "n_rows" else F.coalesce(fact(x), F.lit(missing[x]))
        more = [F.coalesce(_filled(text, fact), F.lit("")) for text in FOLLOWING_AZ.get(name, {}).values()]
        out = out.when((route == name) & known, F.concat(_filled(template, value), *more))
    found = F.regexp_extract_all(answer, F.lit(r"\d+"), F.lit(0))
    return (
        out.when(route == "plot_sql", _filled(BELOW_MIN_AZ, lambda _: number))
        .when((route == "hybrid_mapping") & ~known, F.lit(NO_MAPPING_AZ))
        .when((route == "structured_failure_activity") & (F.size(found) >= 7), _filled(FAILURES_AZ, lambda x: F.get(found, int(x))))
        .when(route == "structured_failure_activity", F.lit(FAILURES_SHORT_AZ))
        .when(F.contains(F.lower(answer), F.lit("unavailable")) | F.contains(F.lower(answer), F.lit("no ")), F.lit(UNKNOWN_AZ))
        .otherwise(answer)
    )


def answer_confidence(top_score: Column) -> Column:
    """Confidence of a retrieved answer."""
    return F.least(F.lit(0.95), 0.55 + top_score)
