import pytest

queries = pytest.importorskip("clauseloom.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ("tcr_check", "prepare_da_pairs", "term_recall", "b1_neardup_consistency", "raw_manifest", "termbase", "documents")
IDS = ("sample_id", "doc_id", "document_id", "experiment_group")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Some rows twice, the same without any value but their ids, and columns of clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        rows = spark.read.parquet(f"{SF}/{name}.parquet").limit(30)
        nulls = rows.limit(12).select(*[F.col(c) if c in IDS or (name == "raw_manifest" and c in ("format", "role")) else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        if name == "documents":
            nulls = nulls.withColumn("doc_id", F.col("doc_id") + 10_000)
        elif name != "raw_manifest":
            nulls = nulls.withColumn("sample_id", F.concat("sample_id", F.lit("x"))) if "sample_id" in nulls.columns else nulls
        both = rows.union(rows.limit(5)).union(nulls)
        for clash in ("text", "lang", "state", "body", "rep", "member", "size", "word", "path", "label"):
            if clash not in both.columns:
                both = both.withColumn(clash, F.lit("x"))
        both.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == (1 if name == "p9_fill" else 0)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nulls_repeats_and_clashing_names(spark, odd, name):
    rows = queries.queries()[name](spark, odd)
    found = [tuple(map(str, r)) for r in rows.collect()]
    if name.endswith("_found"):
        assert len(found) == len(set(found))
