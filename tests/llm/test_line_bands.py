from __future__ import annotations

from trolley.llm import line_dedup


def test_bands_miss_next_to_no_pair_at_the_threshold():
    similarity = line_dedup.NUM / line_dedup.DEN
    assert (1 - similarity**line_dedup.ROWS) ** line_dedup.BANDS <= 1e-5
