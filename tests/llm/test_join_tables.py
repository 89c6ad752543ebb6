"""What the n-gram join leaves on disk and moves."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from fieldlab.llm import common, ngram_join


def test_zones_do_not_outlive_the_keys(spark):
    words = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(i, words if i % 3 else f"{words} {i}") for i in range(30)], "doc_id long, text string")
    folder = Path(common.shared_dir(spark))
    before = set(folder.glob("join-*")) if folder.exists() else set()
    found = ngram_join.similarity_components(docs, 3, 90)
    left = {path: {c for f in path.glob("*.parquet") for c in pq.read_schema(f).names} for path in set(folder.glob("join-*")) - before}
    assert left and not any("zone" in names for names in left.values())
    assert sum("bitmap" in names for names in left.values()) == 1
    assert {r["component_id"] for r in found.collect()} == {0}


def test_a_table_goes_after_an_error_too(spark):
    folder = Path(common.shared_dir(spark))
    with pytest.raises(ValueError), common.for_a_while(spark.range(3), "short") as table:
        assert table.count() == 3
        raise ValueError
    assert not list(folder.glob("short-*"))


@pytest.mark.parametrize("percent", [50, 77, 78, 80, 90, 97, 100])
def test_bitmaps_keep_whatever_links(percent):
    """Sets of a similarity just high enough pass, whatever their sizes."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), 255, 256, 257, 600, 1000, 1219, 2438, 5000]:
        own = rng.integers(0, 1 << 63, 2 * n + 1, np.uint64)
        other = own[: n * 100 // percent]  # a superset: size and difference at their limit
        own = own[:n]
        if 100 * n >= percent * len(other):
            got = ngram_join._close(np.array([n]), [ngram_join.parity_bitmap(own, percent)], np.array([len(other)]), [ngram_join.parity_bitmap(other, percent)], percent)
            assert len(got) == 1, (n, len(other))
    assert len(ngram_join.parity_bitmap(rng.integers(0, 1 << 63, 1000, np.uint64), 90)) * 8 == 512
