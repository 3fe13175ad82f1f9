"""Explicit schemas of the library: posts, evidence, sources, runs."""

from pyspark.sql import types as T

_s, _i, _b = T.StringType(), T.IntegerType(), T.BooleanType()

POST = T.StructType(
    [T.StructField(n, _s) for n in ("platform", "title", "url", "text", "company", "business", "date", "confidence", "keyword", "collected_at", "source_type", "collection_depth")]
    + [T.StructField(n, _i) for n in ("expected_image_count", "downloaded_image_count", "ocr_page_count")]
    + [T.StructField("is_complete", _b)]
)
REQUIRED = ("platform", "title", "url", "text")
DEFAULTS = {
    "company": "待识别", "business": "待识别", "date": "", "confidence": "B", "keyword": "", "source_type": "direct", "collection_depth": "text",
    "expected_image_count": 0, "downloaded_image_count": 0, "ocr_page_count": 0, "is_complete": True,
}

RUN = T.StructType(
    [T.StructField("version", _i)]
    + [T.StructField(n, _s) for n in ("run_id", "fingerprint", "status", "started_at", "updated_at", "finished_at")]
    + [T.StructField("spec", T.MapType(_s, _s)), T.StructField("completed_items", T.ArrayType(_s)), T.StructField("failures", T.MapType(_s, _s))]
)
SCHEMA_VERSION = "1"
