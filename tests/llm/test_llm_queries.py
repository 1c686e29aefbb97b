import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from helpers import DATA, oracle, same  # noqa: E402

from radiolake.llm import language  # noqa: E402
from radiolake.llm.queries import QUERIES, SQL  # noqa: E402

COLUMNS = {
    "p1_found": {"image_id", "field_name", "record_id"},
    "p3_found": {"table_name", "record_id", "message_pos"},
    "p4_found": {"trajectory_id", "question_pos", "defect"},
    "p6_found": {"image_id", "group_id"},
    "p7_found": {"image_id_a", "image_id_b"},
    "p8_ids": {"doc_id", "ids"},
    "p10_found": {"doc_id", "defect", "lang"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(language, "STEPS", (15, 15))  # training time, not accuracy, is cut here
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = df.collect()
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
        keys = [tuple(r[c] for c in df.columns if c != "ids") for r in rows]
        assert len(keys) == len(set(keys))
    if name in SQL:
        same(rows, df.columns, oracle("sf0.001").execute(SQL[name]))
