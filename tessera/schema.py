"""Schemas of the logical tables; nothing is inferred."""

from pyspark.sql.types import StructType

_ddl = StructType.fromDDL

DISCOVERED = "dataset string, path string, dataset_version string, original_split string, source_type string, normalized_label string, raw_label string"
CLASS_MAPPING = "dataset string, raw_label string, target string"
PROVENANCE = "item_id string, source_dataset string, dataset_version string, original_split string, source_type string, original_class string, original_filename string, original_path string, mapped_class string, review_status boolean, duplicate_status string, quality_status string, final_filename string, final_width int, final_height int"
FOLD_PLAN = "fold_id int, split_role string, item_id string, mapped_class string, source_dataset string, source_type string, file_path string"
FEATURES = "item_id string, glcm array<float>, lbp array<float>, hog array<float>, color_lab array<float>"
PREDICTIONS = "arm string, fold int, item_id string, y_true string, y_pred string, raw_probs array<double>, cal_probs array<double>"
FREEZE = "rel_path string, sha256 string"

#: Classification outcomes and roles.
EXCLUDE, AMBIGUOUS, UNKNOWN = "EXCLUDE_NOT_TARGET", "AMBIGUOUS_MERGED", "UNKNOWN"
ROLES = ("train", "val", "holdout_val", "holdout_test", "excluded_augmented")


def struct(ddl: str) -> StructType:
    return _ddl(ddl)
