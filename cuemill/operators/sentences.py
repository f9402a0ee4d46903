"""Sentences, paragraphs of a fixed number of sentences, and timestamped sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuemill.functions.text import CJK_MARKS, bare_sentences, collapse_repeats, sentences_of, strip, with_full_stop
from cuemill.functions.times import cue_end, cue_start


#: Cue indexes of a file whose sentences are numbered together.
BLOCK = 4096


def paragraphs_array(text: Column, n: int, cjk: Column | None = None, *, blank: bool = True) -> Column:
    """Paragraphs of ``n`` sentences each (at least one) as an array; sentences are joined as they are.

    CJK mode is chosen by the text's punctuation unless given; blank sentences are left out unless
    ``blank``. Stays within one row: no shuffle.
    """
    size = max(n, 1)

    def grouped(sentences: Column) -> Column:
        count = F.ceil(F.size(sentences) / size).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: F.array_join(F.slice(sentences, i * size + 1, F.lit(size)), ""))

    # The sentences are bound to a lambda's variable, so that they are found once, not for every paragraph.
    return F.element_at(F.transform(F.array(sentences_of(text, text.rlike(CJK_MARKS) if cjk is None else cjk, blank=blank)), grouped), 1)


def segment(texts: DataFrame, n: int = 20, source: str = "source", text: str = "text", *, collapse: bool = False) -> DataFrame:
    """source, para_index, paragraph of every text; null and empty texts have none. With ``collapse``
    phrases said several times are said once and blank sentences are left out."""
    body = collapse_repeats(F.col(text)) if collapse else F.col(text)
    exploded = texts.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), body.alias("_t")).select("source", F.posexplode(paragraphs_array(F.col("_t"), n, blank=not collapse)).alias("para_index", "paragraph"))
    return exploded.withColumn("para_index", F.col("para_index").cast("bigint"))


def timed_chunks(cues: DataFrame, n: int = 20, *, block: int = BLOCK) -> DataFrame:
    """source, chunk_index, start, end, content: ``n`` sentences each, across cues.

    Sentences lose their ends and are joined by full stops; a chunk lasts from its first sentence's
    cue's start to its last one's end. Cues without content or times give no sentences. Sentences are
    numbered within blocks of ``block`` cue indexes, behind the sizes of the blocks before, so that a
    file with a third of all cues is spread over tasks.
    """
    timed = cues.where((strip(F.col("content")) != "") & (strip(F.col("timestamps")) != ""))
    sentences = timed.select("source", "cue_index", "timestamps", F.posexplode(bare_sentences(F.col("content"))).alias("pos", "sentence"))
    placed = sentences.withColumn("blk", F.floor(F.col("cue_index") / block).cast("bigint"))
    here = Window.partitionBy("source", "blk").orderBy("cue_index", "pos")
    before = Window.partitionBy("source").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = timed.groupBy("source", F.floor(F.col("cue_index") / block).cast("bigint").alias("blk")).agg(F.sum(F.size(bare_sentences(F.col("content")))).alias("size"))
    offsets = sizes.select("source", "blk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("inner_no", F.row_number().over(here)).join(offsets, ["source", "blk"]).withColumn("rn", F.col("offset") + F.col("inner_no")).withColumn("chunk_index", F.floor((F.col("rn") - 1) / max(n, 1)).cast("bigint"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sentence"))), lambda x: x["sentence"]), "。")
    return numbered.groupBy("source", "chunk_index").agg(F.min_by(cue_start(F.col("timestamps")), "rn").alias("start"), F.max_by(cue_end(F.col("timestamps")), "rn").alias("end"), with_full_stop(joined).alias("content"))


def sections_text(chunks: DataFrame) -> DataFrame:
    """source, text: timestamped sections as Markdown, headers and contents apart by blank lines."""
    section = F.concat(F.lit("### **"), F.col("start"), F.lit(" - "), F.col("end"), F.lit("**\n\n"), F.col("content"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", section.alias("section")))), lambda x: x["section"])
    return chunks.groupBy("source").agg(F.array_join(pieces, "\n\n").alias("text"))


def paragraphs(texts: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """source, para_index, paragraph: the pieces between blank lines that aren't blank."""
    pieces = F.filter(F.split(F.col(text), "\n\n", -1), lambda x: strip(x) != "")
    exploded = texts.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.posexplode(pieces).alias("para_index", "paragraph"))
    return exploded.withColumn("para_index", F.col("para_index").cast("bigint"))


def section_parts(paras: DataFrame) -> DataFrame:
    """Adds is_header, header and body to paragraphs: a paragraph that starts like a timestamped
    header has its first line for header and the rest for body."""
    header = F.col("paragraph").startswith("### **")
    return paras.withColumns({"is_header": header, "header": F.when(header, F.substring_index("paragraph", "\n", 1)), "body": F.when(header, strip(F.regexp_replace("paragraph", r"^[^\n]*", ""))).otherwise(F.col("paragraph"))})
