"""Explicit schemas, enumerations and defaults of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The enumerations.
CATEGORIES = ["CONTENT", "BACKCHANNEL", "ACK_DECISION"]
UNCERTAIN_REASONS = ["AB_MISMATCH", "LOW_CONFIDENCE", "SPEAKER_AMBIGUOUS", "OVERLAP", "NONE"]
EDIT_TYPES = ["NORMALIZE", "VTT_SUPPLEMENT", "UNRESOLVED", "NONE"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]

CUE = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("cue_index", T.IntegerType()),
    T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()),
])

UTTERANCE = (
    "id string, speaker string, text string, category string, uncertain boolean, uncertain_reason string, uncertain_span_ids array<string>, "
    "source string, source_ids array<string>, vtt_supplemented boolean, edit_type string, edit_note string"
)
LLM_OUTPUT = f"utterances array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in UTTERANCE.split(','))}>>"
UTTERANCE_FIELDS = [f.split()[0] for f in UTTERANCE.split(",")]

# What a missing field of an utterance becomes.
UTTERANCE_DEFAULTS = {"id": "", "speaker": "UNKNOWN", "text": "", "category": "CONTENT", "uncertain": False, "uncertain_reason": "NONE", "source": "PRIMARY", "vtt_supplemented": False, "edit_type": "NONE", "edit_note": ""}
