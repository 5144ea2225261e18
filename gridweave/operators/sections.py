"""Target lengths of sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Story positions and places in the book that make a chapter important.
IMPORTANT_POSITIONS = "Climax|Midpoint|Resolution"
IMPORTANT_SHARES = (0.25, 0.5, 0.75)


def important_chapter(chapter: Column, chapters: Column, position: Column) -> Column:
    """First, last, or next to a quarter, half or three quarters, or by story position."""
    out = F.coalesce(position.rlike(IMPORTANT_POSITIONS), F.lit(False)) | (chapter == 1) | (chapter == chapters)
    for share in IMPORTANT_SHARES:
        at = F.floor(chapters * share)
        out = out | (chapter == at) | (chapter == at + 1)
    return out


def target_words(words_per_chapter: Column, sections: Column, section: Column, important: Column) -> Column:
    """Words per section: even share, x1.2 if important, x1.1 for the first and x0.9 for the
    last section, rounded down at each step."""
    even = F.floor(words_per_chapter / F.greatest(sections, F.lit(1)))
    weighted = F.when(important, F.floor(even * 1.2)).otherwise(even)
    return F.when(section == 1, F.floor(weighted * 1.1)).when(section == sections, F.floor(weighted * 0.9)).otherwise(weighted)
