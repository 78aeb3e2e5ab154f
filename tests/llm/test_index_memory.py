"""The stored index of decontamination is written and read a few slices at a time, however many a file has."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq

from quillstream.llm import decontamination as dec
from quillstream.llm.common import keyed


def test_row_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(dec, "SLICE_BYTES", 20)
    docs = [(i, f"alpha beta gamma {i} delta epsilon") for i in range(150)]
    index = dec.build_index(keyed(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)))
    files = [pq.ParquetFile(f) for f in Path(index.cut_path.removeprefix("file://")).glob("*.parquet")]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == index.count() > 100 and max(groups) <= dec.GROUP_ROWS
    found = dec._judged(index, dec.blocks_of(spark.createDataFrame([(1, "gamma 77 delta")], "item_id long, text string"), "item_id", "text", 13))
    assert [(r.id, r.n_hit) for r in found.where("contaminated").collect()] == [("77", 3)]
