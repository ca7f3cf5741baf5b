"""Where results go: tables laid out by entity, audits as text, and a description of the dataset."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import build_name

#: The columns of a trial audit, in order.
TRIAL_AUDIT = ("trial_id", "anchor_event_index", "anchor_event_code", "anchor_onset_s", "anchor_duration_s", "label", "keep", "exclusion_reason", "condition_resolution_reason", "condition_inputs")
STANDARD = "1.11.1"


def write_result(df: DataFrame, path: str, schema_name: str, by: tuple[str, ...] = (), version: str = "1.0", mode: str = "overwrite") -> None:
    """Parquet with the schema's name and version in every row (a run-length of one value), partitioned by entities."""
    out = df.withColumns({"schema_name": F.lit(schema_name), "schema_version": F.lit(version)}).write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_text(df: DataFrame, path: str, columns: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Tab-separated text with a header; maps and structs as JSON, missing values empty; quotes within values are doubled."""
    types = dict(df.dtypes)
    cells = [F.to_json(c).alias(c) if types[c].startswith(("map", "struct", "array")) else F.col(c).cast("string").alias(c) for c in (columns or df.columns) if c in types]
    df.select(*cells).write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def result_path(root: str, entities: Column, datatype: str, suffix: str, extension: str) -> Column:
    """root/sub-X/[ses-Y/]datatype/name; without a subject the folder is that of subject ``unknown``."""
    sub, ses = F.coalesce(F.try_element_at(entities, F.lit("sub")), F.lit("unknown")), F.try_element_at(entities, F.lit("ses"))
    folder = F.concat_ws("/", F.lit(root), F.concat(F.lit("sub-"), sub), F.concat(F.lit("ses-"), ses), F.lit(datatype))
    return F.concat_ws("/", folder, build_name(entities, F.lit(suffix), F.lit(extension)))


def dataset_description(name: str, pipeline: str, version: str, parameters: dict) -> str:
    """JSON text that says what made a dataset, with all parameters."""
    body = {"Name": name, "BIDSVersion": STANDARD, "DatasetType": "derivative", "GeneratedBy": [{"Name": pipeline, "Version": version, "Parameters": parameters}]}
    return json.dumps(body, indent=2, sort_keys=True)
