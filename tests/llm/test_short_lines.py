import hashlib

import corpus_pipeline as p
from quillsieve.llm import queries

DOCS = [(1, "Read more\n\nMenu\n \nRead more"), (2, "Menu\nRead more!\n\n \na longer line, seen once only"), (3, "Read more\nMenus"), (4, "Menu")]
KEPT = {1: "Read more\n\nMenu\n ", 2: "Read more!\n\n \na longer line, seen once only", 3: "Menus", 4: ""}


def test_stage_drops_short_lines_seen_before(spark, make, tmp_path):
    rows = p.line_stage(spark, make(DOCS), str(tmp_path)).select("doc_id", "text").collect()
    assert {r[0]: r[1] for r in rows} == {d: t for d, t in KEPT.items() if t}


def test_query_drops_short_lines_seen_before(spark, make, tmp_path):
    make(DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_line_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in rows} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in KEPT.items()}
