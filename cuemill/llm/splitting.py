"""Cutting oversized texts into overlapping pieces at natural boundaries, in SQL expressions only.

Method: one regular expression with bounded quantifiers, its alternatives ordered by boundary
strength, consumes the text piece by piece; array functions look back for the overlap. No shuffle:
a piece depends on its own row only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces_pattern(size: int) -> str:
    """The pattern that matches pieces of at most ``size`` characters, the best boundary first.

    A paragraph, sentence or clause boundary must lie in the second half of the piece, so that pieces
    don't get small; white space or a punctuation mark may lie anywhere; failing all, any character,
    though not between a letter and its combining marks unless there is no other place. Sizes below 16
    know only white space, punctuation and characters, as half a piece holds no sentence.
    """
    half = max(1, size // 2)

    def upto(least: int, ending: str, longest: int) -> str:
        return rf"(?s:.{{{max(0, least - longest)},{max(0, size - longest)}}}){ending}"

    alternatives = [
        rf"(?s:.{{1,{size}}})\z",
        upto(half, r"\n\n", 2),
        upto(half, r"(?:[.!?…؟।۔][\"'”’»」』）)\]]{0,3}\s{1,2}|[。！？][”’」』）]{0,5})", 6),
        upto(half, r"[,;:，；：、،؛]\s{0,2}", 3),
        upto(1, r"\s", 1),
        upto(1, r"\p{P}", 1),
        rf"(?s:.{{1,{size}}})(?!\p{{M}})",
        rf"(?s:.{{1,{size}}})",
    ]
    return "(?U)" + "|".join(alternatives[:1] * (size >= 1) + (alternatives[1:4] if size >= 16 else []) + alternatives[4:])


def _natural(text: Column) -> Column:
    return text.rlike(r"(?U)(?s)(?:\s|\p{P})$")


def split_texts(texts: DataFrame, text: str, *, max_size: int, overlap: int = 0) -> DataFrame:
    """Pieces of each text longer than ``max_size``: piece_no, start_char, piece, forced.

    All columns but ``text`` are kept. Pieces have at most ``max_size`` characters (code points), the
    overlap included; each begins with the last ``overlap`` characters of what came before it, and
    without their overlaps the pieces join to the text. ``forced`` tells that the piece ends where
    neither white space nor punctuation is. Null, empty and short texts give no pieces. An input
    column called piece_no, start_char, piece or forced is replaced.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than max_size")
    size = max_size - overlap
    names = [c for c in texts.columns if c not in (text, "piece_no", "start_char", "piece", "forced", "_pieces")]
    whole = F.col(text)

    def pieces(cores: Column) -> Column:
        lengths = F.transform(cores, F.length)
        ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda sums, n: F.array_append(sums, n + F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))))

        def with_ends(known: Column) -> Column:
            def piece(core: Column, i: Column) -> Column:
                end = F.get(known, i)
                begin = F.greatest(end - F.length(core) - F.lit(overlap), F.lit(0))
                return F.struct(
                    (i + 1).cast("bigint").alias("piece_no"),
                    (begin + 1).cast("bigint").alias("start_char"),
                    whole.substr(begin + 1, end - begin).alias("piece"),
                    ((i < F.size(cores) - 1) & ~_natural(core)).alias("forced"),
                )

            return F.transform(cores, piece)

        return F.element_at(F.transform(F.array(ends), with_ends), 1)

    # Cores and ends are bound to lambda variables, so that they are found once, not for every piece.
    cores = F.regexp_extract_all(whole, F.lit(pieces_pattern(size)), F.lit(0))
    found = F.element_at(F.transform(F.array(cores), pieces), 1)
    return texts.where(F.length(text) > max_size).select(*names, found.alias("_pieces")).select(*names, F.inline("_pieces"))


def longest_unbroken_over(text: Column, size: int) -> Column:
    """Whether a text has more than ``size`` characters in a row without white space or punctuation."""
    return text.rlike(rf"(?U)[^\s\p{{P}}]{{{size + 1}}}")
