"""The queries of this package, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.broken_pairs import broken_pairs, pairs_of
from cuemill.llm.encoding import encode_texts
from cuemill.llm.languages import foreign_parts, item_parts, label_cases, main_languages, train_on
from cuemill.llm.packing import pack_documents
from cuemill.llm.repeated_cues import repeated_runs
from cuemill.llm.sentences import Gaps, learn_gaps, sentence_units
from cuemill.llm.speaker_turns import captions_of, speaker_turns
from cuemill.llm.splitting import longest_unbroken_over, split_texts
from cuemill.llm.text_quality import quality_statistics, text_types
from cuemill.session import checkpoint, table


def size_limit(spark: SparkSession, folder: str, item_type: str) -> tuple[int, int]:
    """max_size and overlap of a row of ``size_limits``."""
    row = table(spark, folder, "size_limits").where(F.col("item_type") == item_type).select("max_size", "overlap").first()
    return int(row[0]), int(row[1] or 0)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of two or more cues that say the same."""
    return repeated_runs(table(spark, folder, "cues"), smallest=2).select("file_id", "first_cue", "last_cue")


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run, single cues included, as one cue with its count and duration."""
    return repeated_runs(table(spark, folder, "cues"))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each part of all documents, files and transcripts."""
    documents = table(spark, folder, "documents")
    return checkpoint(item_parts(documents, table(spark, folder, "cues"), table(spark, folder, "transcripts"), train_on(documents)))


def _without_junk(cases: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Cases without those of documents that nobody would read as language."""
    types = text_types(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    junk = types.where("text_class = 'junk'").select(F.lit("document").alias("item_type"), F.col("doc_id").alias("item_id"))
    return cases.join(junk, ["item_type", "item_id"], "left_anti")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Missing or wrong language labels (part_no -1) and parts in a foreign language."""
    parts = _parts(spark, folder)
    mains = main_languages(parts)
    labels = (
        table(spark, folder, "documents").select(F.lit("document").alias("item_type"), F.col("doc_id").alias("item_id"), F.col("lang").alias("label"))
        .unionByName(table(spark, folder, "files").select(F.lit("file").alias("item_type"), F.col("file_id").alias("item_id"), F.col("detected_language").alias("label")))
        .unionByName(table(spark, folder, "transcripts").select(F.lit("transcript").alias("item_type"), F.col("transcript_id").alias("item_id"), F.col("detected_language").alias("label")))
        .groupBy("item_type", "item_id")
        .agg(F.min("label").alias("label"))
    )
    wrong = label_cases(mains, labels).select("item_type", "item_id", F.lit(-1).cast("bigint").alias("part_no"), F.col("main").alias("lang"))
    cases = wrong.unionByName(foreign_parts(parts, mains).select("item_type", "item_id", "part_no", "lang"))
    return _without_junk(cases, spark, folder)


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The main language of every document, file and transcript with words (part_no -1; null if none of
    its parts is like any of the languages) and the language of each of their foreign parts, with
    confidence; documents that are junk are left out."""
    parts = _parts(spark, folder)
    mains = main_languages(parts)
    main = mains.select("item_type", "item_id", F.lit(-1).cast("bigint").alias("part_no"), F.col("main").alias("lang"), F.col("confidence").cast("double").alias("confidence"))
    foreign = foreign_parts(parts, mains).withColumn("confidence", F.col("confidence").cast("double"))
    return _without_junk(main.unionByName(foreign), spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective translations and rewritings with their defect."""
    pairs = pairs_of(table(spark, folder, "translations"), table(spark, folder, "para_rewrites"))
    return broken_pairs(pairs, table(spark, folder, "common_words"))


#: Rows of ids up to which the sample is sent to all executors; beyond it, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def _all_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.lit("document").alias("item_type"), F.col("doc_id").alias("item_id"), "text")
    return documents.unionByName(table(spark, folder, "cues").select(F.lit("cue").alias("item_type"), F.col("cue_id").alias("item_id"), F.col("content").alias("text")))


def _gaps(texts: DataFrame, spark: SparkSession, folder: str) -> Gaps:
    """What is learned about Thai from all texts; the few common words are words however rare."""
    given = [r.word for r in table(spark, folder, "common_words").where("lang = 'th' and word is not null").select("word").distinct().limit(100_001).collect()]
    if len(given) > 100_000:
        raise ValueError("common_words is meant to be a short list")
    return learn_gaps(texts, given=given)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of the documents and cues of the sample."""
    texts = _all_texts(spark, folder)
    sample = table(spark, folder, "sentence_sample").select("item_type", "item_id").distinct()
    wanted = F.broadcast(sample) if sample.count() <= BROADCAST_IDS else sample
    chosen = texts.join(wanted, ["item_type", "item_id"], "left_semi").groupBy("item_type", "item_id").agg(F.min("text").alias("text"))
    return sentence_units(chosen, _gaps(texts, spark, folder), ["item_type", "item_id"]).select("item_type", "item_id", "first_char", "last_char")


def p4_units(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of all documents and cues; a cue delivered twice counts once."""
    texts = _all_texts(spark, folder)
    once = texts.where("item_type = 'document'").unionByName(texts.where("item_type = 'cue' and text is not null").groupBy("item_type", "item_id").agg(F.min("text").alias("text")))
    return sentence_units(once, _gaps(texts, spark, folder), ["item_type", "item_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker turns of files (by cue_index) and transcripts (by array position)."""
    return p5_turns(spark, folder).select("item_type", "item_id", "first_no", "last_no", "speaker")


def p5_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker turns with the number of their captions."""
    captions = captions_of(table(spark, folder, "cues"), table(spark, folder, "transcripts"))
    return speaker_turns(captions, table(spark, folder, "speakers"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pieces of every oversized caption."""
    max_size, overlap = size_limit(spark, folder, "cue")
    cues = table(spark, folder, "cues").select("cue_id", "content")
    return split_texts(cues, "content", max_size=max_size, overlap=overlap).dropDuplicates(["cue_id", "piece_no"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized captions and whether one of their cuts is forced.

    The pieces say where a cut has no boundary; as a piece's own text is shorter than the limit by
    the overlap, a check on the whole caption follows for unbroken stretches between the two sizes.
    """
    max_size, overlap = size_limit(spark, folder, "cue")
    cues = table(spark, folder, "cues").where(F.length("content") > max_size).select("cue_id", "content")
    marked = cues.withColumn("unbroken", longest_unbroken_over(F.col("content"), max_size))
    pieces = split_texts(marked, "content", max_size=max_size, overlap=overlap)
    forced = F.max(F.col("forced") & F.col("unbroken"))
    return pieces.groupBy("cue_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document; null and empty texts have none."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of the given capacity."""
    capacity, _ = size_limit(spark, folder, "container")
    return pack_documents(table(spark, folder, "documents"), "doc_id", "text", capacity=capacity)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return p9_types(spark, folder).where("text_class <> 'prose'").select("doc_id", "text_class")


def p9_types(spark: SparkSession, folder: str) -> DataFrame:
    """The posterior text type of every document that isn't blank."""
    return text_types(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Text quality statistics of every document that isn't blank."""
    return quality_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_runs": p1_runs,
    "p2_found": p2_found,
    "p2_languages": p2_languages,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_units": p4_units,
    "p5_found": p5_found,
    "p5_turns": p5_turns,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p8_packing": p8_packing,
    "p9_found": p9_found,
    "p9_types": p9_types,
    "p9_statistics": p9_statistics,
}

_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE: dict[str, str] = {
    "p6_found": f"""SELECT cue_id, CASE WHEN list_max(list_transform(string_split_regex(content, '[{_WHITE}\\p{{P}}]'), lambda x: length(x))) > m THEN 'forced' ELSE 'natural' END AS cut
FROM (SELECT DISTINCT cue_id, content, (SELECT max(max_size) FROM size_limits WHERE item_type = 'cue') AS m FROM cues) WHERE length(content) > m""",
}
