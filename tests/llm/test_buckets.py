"""Names of sources that differ only at the end fall into different buckets."""

from __future__ import annotations

import pyarrow as pa

from sievelake.llm import quality


def test_whole_names_count():
    for prefix in ("https://www.", "commoncrawl-", "x" * 100):
        names = [f"{prefix}{i}" for i in range(300)]
        got = quality._bucket(pa.array([*names, None, names[0]]), quality.SOURCE_BUCKETS).tolist()
        assert got[300] == 0 and got[301] == got[0]
        assert set(got[:300]) == set(range(1, quality.SOURCE_BUCKETS))
