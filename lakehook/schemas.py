"""Catalog table schemas of the lake.

Metadata tables are small relative to the data they describe, but every
operator treats them as DataFrames so that nothing depends on them fitting on
the driver.
"""

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("username", T.StringType()),
])

DATASETS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("dataset_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("resource_name", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("lifecycle_id", T.LongType()),
])

FILES = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("dataset_id", T.LongType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("creation_date", T.TimestampNTZType()),
    T.StructField("last_modified", T.TimestampNTZType()),
    T.StructField("size", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("file_extension", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("storage_class", T.StringType()),
])

TRANSFORMS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("transform_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("in_service", T.StringType()),
    T.StructField("in_dataset_id", T.LongType()),
    T.StructField("in_action", T.StringType()),
    T.StructField("in_object", T.StringType()),
    T.StructField("out_service", T.StringType()),
    T.StructField("out_dataset_id", T.LongType()),
    T.StructField("out_action", T.StringType()),
    T.StructField("out_object", T.StringType()),
    T.StructField("src_file", T.StringType()),
    T.StructField("timeout", T.DecimalType(4, 0)),
    T.StructField("enabled", T.BooleanType()),
])

EVENT_LOG = T.StructType([
    T.StructField("log_id", T.LongType()),
    T.StructField("created_timestamp", T.TimestampNTZType()),
    T.StructField("description", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("service", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("dataset_id", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("host_details", T.StringType()),
    T.StructField("object", T.StringType()),
    T.StructField("object_details", T.StringType()),
    T.StructField("is_transform_output", T.BooleanType()),
    T.StructField("processed", T.BooleanType()),
])

LIFECYCLE_RULES = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("dataset_id", T.LongType()),
    T.StructField("lifecycle_id", T.LongType()),
    T.StructField("rule_enabled", T.BooleanType()),
])

LIFECYCLE_TRANSITIONS = T.StructType([
    T.StructField("lifecycle_id", T.LongType()),
    T.StructField("days_till_transition", T.IntegerType()),
    T.StructField("transition_to", T.StringType()),
])

# JSON carried in the event log's detail columns.
HOST_DETAILS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("resource_name", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

OBJECT_DETAILS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("creation_date", T.StringType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("file_extension", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

# Fixed values of the lake's data model.
SERVICE_DATASETS = "datasets"
OBJECT_FILE = "file"
ACTIONS = ("POST", "PUT", "DELETE")
TRIGGER_ACTIONS = ("PUT", "POST")
DISPATCH_ACTION = "POST"
MISSING_ID = 999999999
DEFAULT_TIMEOUT = 200
MAX_TIMEOUT = 1500
