"""Counts of characters and words by script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.text import WHITE, without_code


def script_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, cjk_chars, other_words, total: Han characters, and words of all other scripts, of
    Markdown texts without their code. Null texts give null counts."""
    plain = without_code(F.col(text))
    others = F.regexp_replace(F.regexp_replace(plain, r"[\x{4e00}-\x{9fff}]", " "), rf"[^\p{{L}}\p{{M}}\p{{N}}_\t-\r\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]", " ")
    words = F.size(F.filter(F.split(others, f"{WHITE}+"), lambda w: w != "")).cast("bigint")
    counted = texts.select(key, (F.length(plain) - F.length(F.regexp_replace(plain, r"[\x{4e00}-\x{9fff}]", ""))).cast("bigint").alias("cjk_chars"), F.when(F.col(text).isNotNull(), words).alias("other_words"))
    return counted.withColumn("total", F.col("cjk_chars") + F.col("other_words"))
