"""The pipeline end to end on a small corpus: what each stage must have done."""

import random

import corpus_pipeline
from quillon.llm.substring_dedup import repeats

SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def prose(rng, n):
    return ". ".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(8)) for _ in range(n)) + "."


def test_pipeline(spark, tmp_path):
    rng = random.Random(17)
    a, b, shared, c, d = prose(rng, 20), prose(rng, 20), prose(rng, 9), prose(rng, 15), prose(rng, 15)
    rows = [(1, a), (2, a), (3, a + " more words here."), (4, b), (5, "too short"), (6, None), (7, c + "\n" + shared), (8, d + "\n" + shared)]
    rows += [(9, prose(rng, 12) + f' token = "{SECRET}" end.'), (None, a), (4, prose(rng, 14)), (10, "| | | |\n" * 30)]
    table = spark.createDataFrame([(i, t, "en", "src/a", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, score string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == table.columns
        seen[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert {i for i, _ in seen["quality"]} == {1, 2, 3, 4, 7, 8, 9, None}  # short, empty and navigation go
    kept = seen["near_duplicates"]
    assert sorted(i for i, _ in kept) == [1, 4, 4, 7, 8, 9] and dict(kept)[1] == a  # a different text of one id stays
    texts = dict(seen["repeats"])
    assert shared.split()[5] in texts[7].split() and shared.split()[5] not in texts[8].split() and d.split()[3] in texts[8].split()
    assert all(SECRET not in t for _, t in seen["secrets"]) and "<SECRET>" in dict(seen["secrets"])[9]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == [1, 4, 7, 8, 9] and sum(r.start == 0 for r in packed) == 6
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
