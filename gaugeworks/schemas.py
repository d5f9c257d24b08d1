"""Fixed schemas: responses, scored rows, public rows, annotations. Types are given, never inferred, as columns may be all null."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in spec.split())])


#: Column names and their order.
SCORED = _struct(
    "cache_key:s question_id:s scene_id:s category:s n_options:i model_label:s model_string:s served_by:s quantization:s thinking_effort:s "
    "max_tokens:i temperature:d reasoning_format:s include_sampling_params:b max_tokens_field:s harness_version:s git_sha:s cohort_id:s "
    "usd_per_1m_input:d usd_per_1m_output:d price_quoted_on:s condition:s seed:i prompt_key:s prompt_hash:s corruption:s corruption_severity:i "
    "status:s error_reason:s gold_letter:s predicted_letter:s extraction_method:s ambiguous_candidates:a valid:b correct:b prompt_tokens:l "
    "completion_tokens:l reasoning_tokens:l reasoning_tokens_reported:b served_model:s served_provider:s reasoning_chars:i thinking_chars:i "
    "response_chars:i latency_ms:d"
)
PUBLIC = _struct(
    "schema:s schema_version:i question_id:s category:s n_options:i model_label:s model_string:s served_by:s served_model:s served_provider:s "
    "quantization:s condition:s status:s gold_letter:s predicted_letter:s correct:b valid:b extraction_method:s prompt_tokens:l "
    "completion_tokens:l reasoning_tokens:l reasoning_tokens_reported:b latency_ms:d usd_per_1m_input:d usd_per_1m_output:d input_cost_usd:d "
    "output_cost_usd:d total_cost_usd:d price_quoted_on:s seed:i prompt_key:s prompt_hash:s temperature:d max_tokens:i thinking_effort:s "
    "reasoning_format:s include_sampling_params:b max_tokens_field:s corruption:s corruption_severity:i cohort_id:s git_sha:s harness_version:s"
)
USAGE = _struct("prompt_tokens:l completion_tokens:l total_tokens:l reasoning_tokens:l cached_prompt_tokens:l reasoning_tokens_reported:b")
DECODE = _struct("temperature:d top_p:d max_tokens:i thinking_effort:s")
IMAGE = _struct("camera:s path:s source_sha256:s")
RESPONSE = (
    T.StructType([T.StructField("schema", T.IntegerType()), *_struct("cache_key:s status:s ts:d ts_iso:s question_id:s scene_id:s frame_id:s category:s n_options:i letters:a gold_letter:s model_label:s model_string:s served_by:s quantization:s usd_per_1m_input:d usd_per_1m_output:d price_quoted_on:s condition:s seed:i prompt_key:s prompt_hash:s corruption:s corruption_severity:i").fields])
    .add("decode", DECODE)
    .add("image_manifest", T.ArrayType(IMAGE))
)
for _f in _struct("prompt_system:s prompt_user:s harness_version:s git_sha:s cohort_id:s response_text:s reasoning_text:s served_model:s served_provider:s response_raw:s").fields:
    RESPONSE = RESPONSE.add(_f)
RESPONSE = RESPONSE.add("usage", USAGE)
for _f in _struct("latency_ms:d http_status:i attempts:i error_reason:s error_message:s").fields:
    RESPONSE = RESPONSE.add(_f)

_ITEM = T.StructType([T.StructField("Q", T.StringType()), T.StructField("A", T.StringType())])
ANNOTATIONS = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("scene_description", T.StringType()),
        T.StructField("key_frames", T.MapType(T.StringType(), T.StructType([
            T.StructField("QA", T.MapType(T.StringType(), T.ArrayType(_ITEM))),
            T.StructField("image_paths", T.MapType(T.StringType(), T.StringType())),
        ]))),
    ]),
)
QUESTION = _struct("question_id:s scene_id:s frame_id:s category:s stem:s letters:a option_texts:a gold_letter:s").add("image_paths", T.MapType(T.StringType(), T.StringType()))
