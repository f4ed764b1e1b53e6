"""Schemas of the stored tables, as DDL; evolution adds columns at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BBOX = "struct<x0:double,top:double,x1:double,bottom:double>"
_PLACE = f"page_number int, table_index int, row_index int, table_bbox {_BBOX}"

SCHEMAS: dict[str, str] = {
    "source_documents": "document_id long, sha256 string, file_name string, asset_kind string, byte_size long, page_count int, processing_status string, warning_count int, metadata map<string,string>, created_at timestamp_ntz",
    "processing_jobs": "job_id long, document_id long, job_type string, status string, duration_seconds double, error_code string, at timestamp_ntz",
    "pages": "document_id long, page_number int, width double, height double, native_char_count int, ocr_char_count int, raw_text string, extraction_method string, confidence double",
    "reports": "report_id long, document_id long, wellbore string, period_start timestamp_ntz, period_end timestamp_ntz, filename_date date, spud_date timestamp_ntz, report_number int, status_raw string, summary_activities string, summary_planned string, filename_identity_match boolean, filename_date_match boolean, excluded_from_default_trends boolean, data_quality_status string",
    "report_sections": "section_id long, report_id long, document_id long, section_type string, heading_raw string, page_number int, text string, row_count int",
    "operations": "operation_id long, report_id long, document_id long, page_number int, row_index int, start_raw string, end_raw string, op_start timestamp_ntz, op_end timestamp_ntz, hours double, depth double, main_raw string, sub_raw string, main_activity string, sub_activity string, state string, remark string, temporal_status string, op_confidence double",
    "extracted_values": "value_id long, report_id long, document_id long, page_number int, section_type string, field_name string, raw_value string, normalized_text string, normalized_number double, unit string, missing_reason string, value_origin string",
    "section_table_rows": f"row_id long, document_id long, section_type string, {_PLACE}, header_cells array<string>, raw_cells array<string>, normalized_cells array<struct<raw_value:string,value:double,missing_reason:string>>",
    "equipment_failures": f"failure_id long, report_id long, document_id long, {_PLACE}, start timestamp_ntz, end timestamp_ntz, depth double, equipment string, system_class string, downtime_minutes double, remark string, temporal_status string",
    "failure_operation_matches": "failure_id long, operation_id long, status string, confidence double, rule string, minutes double",
    "plots": "plot_id long, document_id long, plot_type string, plot_identifier string, x_unit string, y_unit string, unit_status string, calibration map<string,double>",
    "plot_points": "point_id long, plot_id long, point_index int, series_identifier string, pixel_x double, pixel_y double, x_value double, y_value double, observed_date date, band_classification string, reference_values map<string,double>, anomaly_candidate boolean",
    "identity_mappings": "mapping_id long, source_namespace string, source_identifier string, target_namespace string, target_identifier string, mapping_status string, evidence string, confidence double",
    "anomalies": "anomaly_id long, candidate_key string, source_record_type string, source_record_id long, document_id long, category string, rule_or_model string, score double, severity string, confidence double, detector_type string, model_version string, explanation string, validation_status string, domain_validated boolean",
    "anomaly_reviews": "review_id long, anomaly_id long, decision string, reviewer string, note string, created_at timestamp_ntz",
    "model_runs": "model_type string, version string, fingerprint string, parameters map<string,string>, metrics map<string,double>, is_active boolean",
    "query_audit": "route string, question_hash string, generated_sql string, row_count long, duration_seconds double, at timestamp_ntz",
    "retrieval_chunks": "chunk_key string, source_type string, document_id long, report_id long, wellbore string, period_end timestamp_ntz, page_number int, section_type string, searchable_text string, content_hash string, updated_at timestamp_ntz",
    "stored_assets": "document_id long, storage_key string, sha256 string, byte_size long, storage_status string, content_bytes binary",
    "seed_versions": "version string, source_sha256 string, applied_at timestamp_ntz",
}

#: Table: the columns that name a row.
KEYS: dict[str, list[str]] = {
    "source_documents": ["sha256"], "pages": ["document_id", "page_number"], "reports": ["document_id"],
    "section_table_rows": ["document_id", "page_number", "table_index", "row_index"],
    "equipment_failures": ["report_id", "page_number", "table_index", "row_index"], "failure_operation_matches": ["failure_id", "operation_id"],
    "plots": ["document_id"], "anomalies": ["candidate_key"], "model_runs": ["model_type", "version"], "retrieval_chunks": ["chunk_key"],
    "stored_assets": ["document_id"], "seed_versions": ["version"],
    "identity_mappings": ["source_namespace", "source_identifier", "target_namespace", "target_identifier"],
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in order: missing ones null, others dropped."""
    base = empty(df.sparkSession, table)
    return base.unionByName(df.select(*[c for c in df.columns if c in base.columns]), allowMissingColumns=True)


def repeated_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that more than one row has; empty for a right table."""
    return df.groupBy(*KEYS[table]).count().where("count > 1")
