"""Sources: request bodies, systems, JSON lines and load-test data, all with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BODY = "payload string, payload_id string, mask_kinds array<string>"
SYSTEMS = "id string, enabled boolean, api_key string, mask_kinds array<string>, detokenization_allowed boolean"
ENTITIES = "id string, entities array<struct<type:string,start:int,end:int,text:string>>"


def parsed_body(body: Column, most_bytes: int = 1 << 20) -> Column:
    """``struct<payload, payload_id, mask_kinds, status, reason>`` of a JSON request.

    Unknown keys are ignored; what follows the object, a missing payload or an empty id is refused with 400, too long a body with
    413.  No list of kinds and null are alike, an empty list is not.
    """
    whole = F.regexp_replace(body, r"^\s+|\s+\z", "")
    parsed = F.from_json(whole, BODY)
    object_only = whole.rlike(r"(?s)^\{.*\}\z") & F.try_parse_json(whole).isNotNull()
    reason = (
        F.when(F.octet_length(body) > most_bytes, "too_large")
        .when(~F.coalesce(object_only, F.lit(False)), "invalid_json")
        .when(parsed["payload"].isNull(), "no_payload")
        .when(F.coalesce(parsed["payload_id"], F.lit("")) == "", "no_payload_id")
    )
    status = F.when(reason == "too_large", 413).when(reason.isNotNull(), 400).otherwise(200)
    return F.struct(parsed["payload"].alias("payload"), parsed["payload_id"].alias("payload_id"), parsed["mask_kinds"].alias("mask_kinds"), status.alias("status"), reason.alias("reason"))


def requests(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    return bodies.withColumn("_r", parsed_body(F.col(body_col))).select(*[c for c in bodies.columns if c != body_col], "_r.*")


def systems(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of consumers."""
    return spark.read.schema(SYSTEMS).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, text string").json(path)


def entity_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITIES).json(path)


def load_rows(manifest: DataFrame, corpus: DataFrame, sent: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows of a load test: manifest, corpus and requests agree by ``row_ix``, and only rows of a known profile are taken."""
    rows = manifest.join(corpus, "row_ix").join(sent, "row_ix").filter(F.col("request_payload") == F.col("corpus_payload"))
    return rows.join(profiles.select("profile").distinct(), "profile", "left_semi")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
