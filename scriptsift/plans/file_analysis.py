"""Analysis of local script files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import ranked
from ..operators.reflow import best_content, reflow_minified
from ..operators.scan import scan_patterns
from ..sources.readers import read_js_files


def analyze_texts(texts: DataFrame, keys=("asset_url",), content="content", reflow=True, **options) -> DataFrame:
    """Unique findings, minified texts being reflowed first."""
    text = F.col(content)
    if reflow:
        text = best_content(F.lit(None).cast("string"), reflow_minified(text), text)
    return scan_patterns(texts.select(*keys, text.alias("__best")), keys, "__best", **options)


def analyze_files(spark: SparkSession, path: str, reflow: bool = True, **options) -> DataFrame:
    findings = analyze_texts(read_js_files(spark, path), reflow=reflow, **options)
    return ranked(findings, ("asset_url", "p_ord", "m_ord"))
