import random
import subprocess
import sys

import corpus_pipeline
from corpus_pipeline import STAGES, run

from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_simhash_dedup import brute as near_brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for i in range(90):
        lines = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(r.randint(1, 5))]
        text = "\n".join(lines)
        rows.append((i, text.replace(" ", " | ") if i % 4 == 0 else text))
    rows += [(200, rows[1][1]), (201, rows[2][1] + " more"), (202, None), (203, "")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_in_turn(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        seen[name] = (before, docs.collect())
    for name, _ in STAGES[:-1]:
        assert set(seen[name][1][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    before, after = seen["quality classifier"]
    assert sum(r.doc_id % 4 == 0 and r.doc_id < 90 for r in after) < 4 and sum(r.doc_id % 4 != 0 and r.doc_id < 90 for r in after) > 63
    before, after = seen["line dedup"]
    gone = line_brute(list(before.items()))
    for r in after:
        text = before[r.doc_id]
        assert r.text == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[r.doc_id][1]))
    before, after = seen["SimHash near-dedup"]
    assert sorted(r.doc_id for r in after) == sorted({c for c, _ in near_brute(list(before.items())).values()})
    before, after = seen["suffix-array dedup"]
    assert sorted(before) == sorted(r.doc_id for r in after)
    before, after = seen["best-fit packing"]
    assert {r.doc_id for r in after} == set(before)


def test_run_gives_the_last_stages_rows(spark, tmp_path):
    tables(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(run(spark, str(tmp_path)).columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]


def test_workers_load_no_pandas():
    modules = "bpe, exact_dedup, line_dedup, lm_scoring, packing, quality, simhash_dedup, suffix_dedup, words"
    code = f"import sys, pyspark.worker; from heddle.llm import {modules}; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
