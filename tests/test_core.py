import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from clauseloom import catalog
from clauseloom.functions import sections as S
from clauseloom.functions import text as T
from clauseloom.operators import cascade, joins, stats, terms
from clauseloom.sources import files
from clauseloom.streaming import monitor

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "section, key",
    [("А.5.4", "num:A.5.4"), ("5.4", "num:5.4"), ("Article 3", "art:3"), ("第3条", "art:3"), ("Статья 70", "art:70"), ("ข้อ 12", "art:12"), ("المادة 9", "art:9"), ("§ 22a", "art:22a"), ("", None), (None, None), ("x y", "raw:x y"),
     ("ข้อ ๑๒", "art:12"), ("第十二条", "art:12"), ("第L541-9条", "art:L541-9"), ("Article L541-9", "art:L541-9"), ("٤/١", "num:4.1"), ("第三章", "chap:3"), ("第2款", "para:2"), ("第一百条", "raw:第一百条"), ("№ 5", "raw:№ 5")],
)
def test_equal_clauses_have_equal_keys(spark, section, key):
    assert one(spark, S.section_key(F.col("s")), s=section) == key


def test_clean_text(spark):
    assert one(spark, T.clean(F.col("s")), s="a\xa0b (cid:12)____ 中 文 字\tc") == "a b 中文字 c"
    assert one(spark, T.clean(F.col("s")), s=None) is None
    assert one(spark, T.clean(F.col("s")), s="") == ""


def termbase(spark, rows):
    return terms.usable(spark.createDataFrame(rows, "term_id string, source_lang string, target_lang string, source_term string, target_term string, priority string, alias string, status string"))


def test_longest_occurrence_wins(spark):
    texts = spark.createDataFrame([("a", "en", "He shall not go; he shall stay. marshall"), ("b", "en", None), ("c", "de", "shall"), ("d", "en", "A Rechargeable Storage System (x) and a dummy"), ("e", "ru", "охлаждающей ХЛ")], "sample_id string, source_lang string, source_text string")
    base = termbase(spark, [
        ("1", "en", "zh", "shall", "应", "high", None, "active"), ("2", "en", "zh", "shall not", "不得", "high", None, None), ("3", "en", "zh", "", "x", "low", None, "active"), ("4", "en", "zh", "go", "去", "low", None, "inactive"),
        ("5", "en", "zh", "RESS", "储能", "high", "Rechargeable Storage System", "active"), ("6", "en", "zh", "storage", "存储", "low", None, "active"), ("7", "en", "zh", "manikin", "人体", "low", "dummy", "active"),
        ("8", "en", "zh", "dummy", "假人", "low", "", "active"), ("9", "en", "zh", "(x)", "叉", "low", None, "active"), ("10", "ru", "zh", "климат", "气候", "low", "ХЛ", "active"),
    ])
    found = terms.longest(terms.occurrences(texts, base))
    rows = {(r.sample_id, r.term_id, r["first"]) for r in found.collect()}
    assert rows == {("a", "2", 3), ("a", "1", 20), ("d", "5", 2), ("d", "9", 30), ("d", "8", 40), ("e", "10", 12)}
    assert {(r.term_id, r.matched_by) for r in terms.matched(found).where("sample_id = 'd'").collect()} == {("5", "alias"), ("9", "source_term"), ("8", "source_term")}


def test_requested_terms_go_first(spark):
    pair = "source_term string, target_term string"
    asked, ours = spark.createDataFrame([("Valve", "活门"), ("valve", "x"), ("hose", "软管")], pair), spark.createDataFrame([("valve", "阀"), ("hose", "软管"), ("pump", "泵")], pair)
    rows = {(r.target_term, r.origin, r.conflict) for r in terms.with_requested(asked, ours).collect()}
    assert rows in ({("活门", "request", True), ("软管", "request", False), ("泵", "local", False)}, {("x", "request", True), ("软管", "request", False), ("泵", "local", False)})


def test_quantiles_and_neighbours(spark):
    import numpy as np
    import random

    random.seed(7)
    values = {k: [random.choice([random.random(), 0.5, 3.0]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 19), ("d", 4000))}
    table = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("a", None)], "k string, v double")
    got = {r.k: (r.p10, r.p50, r.p99) for r in stats.quantiles(table, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    assert {k: [pytest.approx(float(np.quantile(x, p))) for p in (0.1, 0.5, 0.99)] for k, x in values.items()} == {k: list(v) for k, v in got.items()}
    rows = spark.createDataFrame([("d", o, random.choice([None, None, "x", "y"])) for o in random.sample(range(9000), 200)] + [("e", 5, None)], "doc string, o int, v string")
    listed = sorted([tuple(r) for r in rows.collect()], key=lambda r: r[:2])
    ahead = {(r.doc, r.o): r.next for r in stats.following(rows, "doc", ["o"], F.col("o").cast("string")).collect()}
    held = {(r.doc, r.o): r.carried for r in stats.carried(rows, "doc", ["o"], F.col("v")).collect()}
    last = {}
    for i, (doc, o, v) in enumerate(listed):
        last[doc] = v or last.get(doc)
        assert held[doc, o] == last[doc]
        assert ahead[doc, o] == (str(listed[i + 1][1]) if i + 1 < len(listed) and listed[i + 1][0] == doc else None)


def test_watermarks(spark):
    strong = ["Download from the I.R.I.S. application", "I . R . I . S", "* IRIS *", "powered by Applus", "由 IDIADA 支持", "For reference purposes only. 12", "Download from the app powered by x"]
    weak = ["Part I: general", "Annex 9I", "powered by an electric motor", "仅供参考", None]
    assert [one(spark, cascade.watermark(F.col("s")).cast("string"), s=x) for x in strong + weak] == ["true"] * len(strong) + ["false"] * len(weak)


def test_unique_key_join_ignores_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r"), (None, "n")], "k int, b string")
    assert [tuple(r) for r in joins.unique_key(a, b, ["k"]).collect()] == [(1, "x", "p")]


def test_failure_kinds(spark):
    kind = terms.failure_kind(F.col("h"), F.col("t"))
    assert [one(spark, kind, h=h, t="阀门") for h in (None, " ", "阀", "门")] == ["missing_translation", "missing_translation", "partial", "missing"]


def test_empty_tables(spark, tmp_path):
    for name in ("tcr_check", "prepare_da_pairs", "term_recall", "b1_neardup_consistency", "raw_manifest", "termbase", "documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("tcr_group_summary", "tcr_rows", "best_candidates", "exclusion_ledger", "sensitivity_tiers", "stratified_sample", "term_occurrences", "document_gate", "repeated_line_templates"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() == 0


def test_character_error_rate_counts_characters(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rows = {(r.sample_id, r.experiment_group): r.distance for r in catalog.queries()["character_error_rate"](spark, SF).collect()}
    flat = lambda t: "".join((t or "").split())
    texts = {(r.sample_id, r.experiment_group): (flat(r.hypothesis), flat(r.ref_text)) for r in catalog.answers(spark, SF).collect()}
    assert set(rows) == {k for k, (_, r) in texts.items() if r}
    assert all(rows[k] == distance(*texts[k]) for k in sorted(rows)[::7])


def test_sources_and_sinks(spark, tmp_path):
    lines = ['{"sample_id": "a", "text": "x"}', "", "{bad", '{"sample_id": "a", "text": "y"}', '{"sample_id": "", "text": "y"}', '{"sample_id": "b", "text": " "}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    found = files.checked_lines(spark, str(tmp_path / "in.jsonl"), "sample_id string, text string", ["sample_id"], "text")
    assert sorted(str(r.reason) for r in found.collect()) == sorted(["None", "empty_line", "invalid_json", "duplicate_sample_id", "missing_required_fields", "empty_text_field"])
    (tmp_path / "t.csv").write_text("﻿a,b\n1,\n")
    assert [r.asDict() for r in files.read_table(spark, str(tmp_path / "t.csv")).collect()] == [{"a": "1", "b": None}]
    files.write_jsonl(spark.range(2), str(tmp_path / "out.jsonl"))
    assert files.read_table(spark, str(tmp_path / "out.jsonl"), "id long").count() == 2
    with pytest.raises(ValueError):
        files.read_table(spark, "x.pdf")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    live = monitor.stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = live.writeStream.outputMode("complete").format("memory").queryName("probes").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("probes").collect())) == sorted(map(tuple, monitor.summary(events).collect()))


def test_prefilter_is_idempotent(spark):
    kept = cascade.prefiltered(catalog.clauses(spark, SF)).where("reason = 'ok'")
    again = kept.withColumn("source_text", F.col("s")).withColumn("ref_text", F.col("r")).drop("s", "r", "reason")
    assert cascade.prefiltered(again).where("reason <> 'ok'").count() == 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
    assert json.dumps(__spark_entry__.entry(spark).columns)


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for name in ("tcr_check", "prepare_da_pairs", "term_recall", "b1_neardup_consistency", "raw_manifest", "termbase", "documents", "events"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, db, name):
    ours = catalog.queries()[name](spark, SF)
    theirs = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    flat = lambda rows: sorted(repr([float(f"{v:.5g}") if isinstance(v, float) else v for v in r]) for r in rows)
    assert flat([r[c] for c in names] for r in ours.collect()) == flat(theirs.fetchall())
