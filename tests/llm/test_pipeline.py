from collections import Counter

import corpus_pipeline
from payproof.llm._common import materialize

from .data import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_end_to_end(spark, tmp_path):
    block = "\n".join(prose(900 + j, 8, 9000) for j in range(12))
    item = prose(70007, 40, 9000)
    rows = [(i, prose(i, 120, 9000) + "\nend " + str(i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, block + "\nfirst own line", "en", "s0"), (101, "second own line\nof two\n" + block, "en", "s1")]
    rows += [(200, rows[0][1], "en", "s0"), (201, rows[1][1].replace("end 1", "end one"), "en", "s0"), (202, prose(5000, 60, 9000) + " " + item + " more", "en", "s2")]
    rows += [(300, None, None, None), (301, "", "en", "s0"), (302, "123 456", "en", "s1"), (303, "123 456", "en", "s1")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(70008, 30, 9000)), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, str(tmp_path)))
        if name != "mixture":
            assert out.columns == docs.columns
        kept[name], docs = {r["doc_id"] for r in out.collect()}, out
    assert set(range(60)) < kept["language"] and not {300, 301, 302, 303} & kept["language"]
    assert kept["line_dedup"] == kept["language"]
    assert kept["language"] - kept["near_dedup"] == {201}
    assert kept["near_dedup"] - kept["decontamination"] == {202}
    final = {r["doc_id"]: r for r in docs.collect()}
    assert set(final) == kept["decontamination"]
    assert final[200]["text"] == "" and final[200]["copies"] == 0  # a copy has lost all its lines
    assert final[5]["text"] == rows[5][1] and final[101]["text"].startswith("second own line") and len(final[101]["text"]) < len(block)
    taken = Counter()
    for r in final.values():
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for r in final.values():
        assert abs(taken[r["source"]] - r["target"]) <= 2 * 130
    again = {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {i: r["copies"] for i, r in final.items()}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
