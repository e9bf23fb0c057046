"""The queries of the training-data operators, for the driver's contract, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, media, mixing, quality, secret_scans, simhash, substrings, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_quality_classifier": lambda s, d: quality.op1_quality(table(s, d, "documents"), table(s, d, "labels")),
    "op2_secrets": lambda s, d: secret_scans.op2_secrets(table(s, d, "documents")),
    "op3_toxicity": lambda s, d: toxicity.op3_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op4_decontamination": lambda s, d: decontaminate.op4_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op5_substring_dedup": lambda s, d: substrings.op5_substring_dedup(table(s, d, "documents")),
    "op6_licenses": lambda s, d: licenses.op6_licenses(table(s, d, "documents"), licenses.licence_files(table(s, d, "supplier"))),
    "op7_warc": lambda s, d: warc.captures(table(s, d, "pages")),
    "op8_simhash": lambda s, d: simhash.op8_simhash(table(s, d, "documents")),
    "op10_media": lambda s, d: media.op10_media(table(s, d, "embeddings")),
    "op9_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op6_licenses": licenses.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE.format(docs="documents"),
}
