"""Thresholds that the signatures do not cover are refused."""

import pytest

from lattica.llm.near_dedup import near_dedup


def test_low_threshold_is_refused(spark, odd):
    with pytest.raises(ValueError):
        near_dedup(spark, odd, percent=79)
