"""The relations that operators take and give, as DDL."""

from __future__ import annotations

IMAGES = ("image_id BIGINT, role STRING, path STRING, filename STRING, utm_east DOUBLE, utm_north DOUBLE, heading DOUBLE")
DESCRIPTIONS = ("image_path STRING, description STRING")
DESCRIPTORS = ("image_id BIGINT, path STRING, metadata STRUCT<path: STRING, filename: STRING, size: STRUCT<w: INT, h: INT>, mode: STRING>, embedding ARRAY<FLOAT>, model STRING")
POSITIVES = ("query_id BIGINT, db_id BIGINT")
PREDICTIONS = ("query_id BIGINT, rank INT, db_id BIGINT, distance DOUBLE")
METRICS = ("meter STRING, step BIGINT, value DOUBLE, n BIGINT")
#: One line of a batch prediction file.
PREDICTION_LINE = ("request STRUCT<contents: ARRAY<STRUCT<role: STRING, parts: ARRAY<STRUCT<file_data: STRUCT<file_uri: STRING, mime_type: STRING>, text: STRING>>>>>, "
    "response STRUCT<candidates: ARRAY<STRUCT<content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>>")
#: Annotation files, by set.
ANNOTATIONS = {
    "caption_train": "image STRING, caption STRING, image_id STRING",
    "retrieval_eval": "image STRING, caption ARRAY<STRING>",
    "caption_eval": "image STRING, caption ARRAY<STRING>",
    "nocaps": "image STRING, img_id INT",
    "nlvr": "images ARRAY<STRING>, sentence STRING, label STRING",
    "vqa": "dataset STRING, image STRING, question STRING, question_id BIGINT, answer STRING",
    "pretrain": "image STRING, caption STRING",
    "video": "clip_name STRING, caption STRING",
}
