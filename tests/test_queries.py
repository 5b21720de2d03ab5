import __spark_entry__
import pytest

from quillion import queries

SMALL = [n for n in queries.queries() if n not in ("threshold_grid", "word_cutoff_grid", "conjunction_grid", "clusters", "cluster_members", "all_findings", "suppressed_clusters", "marked_clusters")]


@pytest.fixture
def tables(spark, tmp_path):
    sentence = "every reader of this file should know that it says the same thing as the one beside it"
    docs = [(i, f"{sentence} {i // 2}\nand then a second line = {i // 3}.", "en", f"s{i % 2}", 90) for i in range(12)] + [(12, "", "en", "s0", 0)]
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int"),
        "conversations": spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string"),
    }
    for name, df in frames.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_every_query_can_be_planned_and_has_its_columns(spark, tables):
    for name in SMALL:
        assert __spark_entry__.queries()[name](spark, tables).columns, name


def test_difflib_agreement(spark, tables):
    row = __spark_entry__.queries()["difflib_agreement"](spark, tables).first()
    assert row["both"] > 0 and row["jaccard_only"] == 0


def test_sql_is_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_precision_normalises_texts_once(spark, tables):
    found = __spark_entry__.queries()["precision_by_unit"](spark, tables)
    assert found.columns == ["unit", "proposed", "true"] and found.count() == 0
    assert "documents.parquet" not in found._jdf.queryExecution().toString()


def test_restatement_reads_small_batches(spark, tables):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert __spark_entry__.queries()["restatement_rate"](spark, tables).first()["comment_blocks"] == 13
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
