import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from clauseloom import service
from clauseloom.functions import prompts, sections, split
from clauseloom.functions import text as T
from clauseloom.operators import alignment, models, pages, retrieval, retry, terms
from clauseloom.sources import files


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", column.alias("x")).orderBy("i")
    return [r.x for r in rows.collect()]


def test_sentences(spark):
    latin = {
        "5.4.1. The vehicle shall comply.": 1, "The test complies with paragraph 5.1. The manufacturer shall notify.": 2, "Values are 0.5 m and 1.25 m in total.": 1, "See Annex 5A. The result is valid.": 2,
        "Download from the I.R.I.S. application powered by it.": 1, "Refer to No. 94 for details.": 1, "Requirements: (a) fire; (b) explosion; (c) venting.": 1, "First sentence. Second sentence. Third one.": 3, "": 0,
    }
    assert [len(x) for x in values(spark, split.sentences_auto(F.col("s")), list(latin))] == list(latin.values())
    chinese = {"5.4.1. 车辆应符合要求。": 1, "本试验符合第 5.1 款。制造商应通知。": 2, "要求包括：(a) 起火；(b) 爆炸；(c) 通风。": 1, "第一句。第二句。第三句。": 3, "他说“可以。”然后离开了。": 2}
    assert [len(x) for x in values(spark, split.sentences_chinese(F.col("s")), list(chinese))] == list(chinese.values())
    assert values(spark, F.size(split.sentences_chinese(F.col("s"), True)), ["一；二；三。"]) == [3]
    units = values(spark, split.labelled_units(F.col("s")), ["ข้อ ดังนี้ (๑) ก (๒) ข (ก) ค", "x (a) y", "nothing", None])
    assert [[u.label for u in x] for x in units] == [["_head", "1", "2", "a"], ["_head", "a"], ["_head"], []]
    pieces = values(spark, split.long_text(F.col("s"), 12), ["One two. Three. Four five six seven eight nine"])[0]
    assert all(len(p) <= 12 for p in pieces) and "".join(pieces).replace(" ", "") == "Onetwo.Three.Fourfivesixseveneightnine"


def test_numerals_and_scopes(spark):
    assert values(spark, sections.numeral(F.col("s")), ["IV", "xii", "MCMXC", "๑๒", "十二", "二十", "九", "一百", "7", "", None, "ab"]) == [4, 12, 1990, 12, 12, 20, 9, None, 7, None, None, None]
    rows = [("Annex 8 - Determination of x", "en", 5, "", "X8"), ("as in Annex 8", "en", 5, "", None), ("Annex 8", "en", 5, "lower text ends.", None), ("Annex 9A", "en", 1, "", "X9A"), ("附录八", "zh", 9, "标题", "X8"), ("Anlage VIII", "de", 0, "", "X8"), ("Annex 99 - x", "en", 0, "", None), ("Annex 8 - x 100", "en", 0, "", None)]
    got = spark.createDataFrame(rows, "line string, lang string, i int, n string, x string").select("x", sections.scope_heading(F.col("line"), F.col("lang"), F.col("i"), F.col("n")).alias("y")).collect()
    assert [r.y for r in got] == [r.x for r in got]


def test_routes(spark):
    rows = [("a", "Name: x", "paragraph", None, 0, 0, False), ("b", "The valve is closed by the operator of the machine today", "paragraph", None, 2, 0, False), ("c", "The test of the valve is done by the operator", "paragraph", None, 1, 0, False), ("d", "Short text", "paragraph", None, 0, 0, False), ("e", "x" * 130, "paragraph", None, 0, 0, False), ("f", "x", "table", "1", 0, 0, True), ("g", None, None, None, 0, 0, False)]
    table = spark.createDataFrame(rows, "id string, t string, kind string, section string, high int, required int, retry boolean").withColumn("c", prompts.counts(F.col("t")))
    table = table.withColumn("f", prompts.features(F.col("c"), F.length(F.coalesce("t", F.lit(""))), F.col("kind"), F.col("section"), F.col("high")))
    got = {r.id: r.m for r in table.select("id", prompts.route(F.col("c"), F.col("f"), F.col("high"), F.col("required"), F.col("retry")).mode.alias("m")).collect()}
    assert got == {"a": "structure", "b": "strict_term", "c": "strict_term", "d": "lightweight", "e": "natural_legal", "f": "retry_repair", "g": "lightweight"}
    filled = table.limit(1).select(prompts.prompt(F.lit("lightweight"), {"source": F.lit("A"), "target": F.lit("B"), "required": F.lit("- {text}"), "text": F.lit("T")}, {"lightweight": "{source}>{target}:{required}|{text}", "natural_legal": "{text}"}).alias("p")).first().p
    assert filled == "A>B:- {text}|T"


def test_alignment_by_length_is_cheapest():
    def cost(a, b, path):
        scale = sum(b) / sum(a)
        i = j = 0
        total = 0.0
        for di, dj in path:
            x, y = sum(a[i : i + di]), sum(b[j : j + dj]) / scale
            total += abs(x - y) / math.sqrt(alignment.VARIANCE * ((x + y) / 2)) - math.log(alignment.MOVES[di, dj])
            i, j = i + di, j + dj
        return total

    def paths(n, m):
        if (n, m) == (0, 0):
            yield []
        for di, dj in alignment.MOVES:
            if di <= n and dj <= m:
                for rest in paths(n - di, m - dj):
                    yield [(di, dj), *rest]

    random.seed(9)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        a, b = [random.randint(5, 60) for _ in range(n)], [random.randint(5, 60) for _ in range(m)]
        found = [(len(x), len(y)) for x, y in alignment.by_length(a, b)]
        assert cost(a, b, found) == pytest.approx(min(cost(a, b, p) for p in paths(n, m)))
    assert alignment.three_way(["aaaa", "bbbb"], ["xx", "yy"], ["k", "l"]) == [(0, 1, 0, 1, 0, 1), (1, 2, 1, 2, 1, 2)]


def test_greedy_order_against_a_loop():
    random.seed(11)
    for _ in range(200):
        na, nb = random.randint(1, 30), random.randint(1, 30)
        s = [{"place": i, "n": random.randint(1, 50), "ok": random.random() < 0.9} for i in sorted(random.sample(range(na), random.randint(1, na)))]
        r = [{"place": i, "n": random.randint(1, 50), "ok": random.random() < 0.9} for i in sorted(random.sample(range(nb), random.randint(1, nb)))]
        free, expected = list(range(len(r))), []
        for i, x in enumerate(s):
            at = round(x["place"] * (nb - 1) / max(na - 1, 1))
            j = min(free, key=lambda k: (abs(r[k]["place"] - at), k), default=None)
            if j is None or abs(r[j]["place"] - at) > max(2, int(0.04 * nb)) or not (x["ok"] and r[j]["ok"] and 0.08 <= r[j]["n"] / max(x["n"], 1) <= 6.5):
                continue
            expected.append((i, j))
            free.remove(j)
        assert alignment.walk(s, r, na, nb) == expected


def test_clauses_align(spark):
    shape = "doc string, ord int, scope string, section_no string, text string, kind string"
    long = lambda n: f"{n} The valve shall be replaced by the manufacturer"
    zh = lambda n: f"{n} 制造商应当更换该阀门以及软管"
    a = spark.createDataFrame([("d", 1, "", "1.1", long("1.1"), "paragraph"), ("d", 2, "", "1.2", long("1.2"), "paragraph"), ("d", 3, "", "1.2", long("1.2"), "paragraph"), ("d", 4, "", None, long(""), "paragraph")], shape)
    b = spark.createDataFrame([("d", 1, "", "1.1", zh("1.1"), "paragraph"), ("d", 2, "", "1.2", zh("1.2"), "paragraph"), ("d", 3, "", None, zh(""), "paragraph"), ("d", 4, "", None, zh(""), "paragraph")], shape)
    rows = {(r.source_ord, r.ref_ord, r.method, r.use_for_da) for r in alignment.aligned(a, b).collect()}
    assert rows == {(1, 1, "exact_section_scoped", True), (2, 2, "scoped_ambiguous", False), (3, 3, "order_based", True), (4, 4, "order_based", True)}


def test_retries(spark):
    first = spark.createDataFrame([("a", 50.0, "fail"), ("b", 0.0, "fail"), ("c", 100.0, "pass")], "sample_id string, tcr double, status string")
    again = spark.createDataFrame([("a", 100.0, "pass"), ("b", 0.0, "fail")], "sample_id string, tcr double, status string")
    rows = retry.recheck(first, again)
    assert {(r.sample_id, r.gain, r.recovered, r.still_fail) for r in rows.collect()} == {("a", 50.0, True, False), ("b", 0.0, False, True)}
    assert retry.recheck_summary(first, rows).first().final_passed == 2
    for bad in (again.union(again), spark.createDataFrame([("z", 1.0, "pass")], again.schema)):
        with pytest.raises(Exception, match="repeated key|no first answer"):
            retry.recheck(first, bad).collect()
    history = spark.createDataFrame([("a", "success"), ("b", "failed"), ("b", "failed"), ("c", "failed")], "sample_id string, status string")
    assert {r.sample_id for r in retry.remaining(first.select("sample_id"), history, ["sample_id"], 2).collect()} == {"c"}


def test_models(spark):
    def call(items):
        if any(t == "bad" for (t,) in items):
            raise ValueError("no")
        return [t.upper() for (t,) in items]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, t string")
    got = {r.id: (r.result, r.status) for r in models.applied(rows, ["id"], ["t"], call).collect()}
    assert got == {1: ("A", "success"), 2: (None, "failed"), 3: ("C", "success")}
    cut_off = models.generated(rows, ["id"], "t", lambda ps: [(p, "length" if p == "bad" else "stop") for p in ps])
    assert {r.id: r.status for r in cut_off.collect()} == {1: "success", 2: "failed", 3: "success"}
    calls = []
    with pytest.raises(ValueError):
        models.with_retries(lambda: calls.append(1) or (_ for _ in ()).throw(ValueError()), 3)()
    assert len(calls) == 3
    told = {r.id: (r.lang, r.reason) for r in models.languages(spark.createDataFrame([(1, "Статья"), (2, "hello"), (3, "12")], "id int, t string"), ["id"], "t", lambda x: ["EN"] * len(x)).collect()}
    assert told == {1: ("ru", "script"), 2: ("en", "model"), 3: (None, "no_letters")}
    assert values(spark, models.response_text(F.col("s")), ['{"choices": [{"message": {"content": " x "}}]}', '{"output": {"text": "y"}}', "broken"]) == ["x", "y", None]


def test_service(spark):
    base = spark.createDataFrame([("1", "en", "zh", "valve", "阀门", "high", None, "active", "car")], "term_id string, source_lang string, target_lang string, source_term string, target_term string, priority string, alias string, status string, domain string")
    asked = spark.createDataFrame([("r1", "The valve.", "EN"), ("r2", " ", "EN"), ("r3", "x", "XX"), ("r4", "hello", None)], "request_id string, text string, language_type string")
    got = {r.request_id: r.response for r in service.translated(asked, base, lambda ps: [("软管", "stop") for _ in ps]).collect()}
    assert {k: (v.code, v.msg) for k, v in got.items()} == {"r1": (200, "ok"), "r2": (400, "empty_text"), "r3": (400, "unknown_language"), "r4": (422, "unresolved_language")}
    assert got["r1"].data.missing_terms == ["阀门"]
    assert [r.target_term for r in service.listing(base, "en", "zh", 5).collect()] == ["阀门"]
    assert service.health({"a": lambda: True, "b": lambda: 1 / 0}, True)["components"] == {"a": True, "b": False}
    probe = spark.createDataFrame([(1, True, "m", "<think>x"), (2, None, "other", "x")], "ts int, ok boolean, model string, answer string")
    assert {r.ts: r.failed for r in service.self_check(probe, {"model": "m"}).collect()} == {1: ["thinking"], 2: ["availability", "model"]}


def test_pages(spark):
    words = spark.createDataFrame([(1, 10.0, 5.0, "one"), (1, 11.0, 9.0, "two"), (1, 30.0, 1.0, "كلمة"), (1, 30.0, 5.0, "High"), (1, 30.0, 7.0, "Vo"), (1, 30.0, 9.0, "أولى")], "page int, top double, x0 double, text string")
    assert [r.line for r in pages.rtl_lines(words).orderBy("top").collect()] == ["one two", "أولى High Vo كلمة"]
    text = ["Header 1\nAnnex 1 - Tests\n1.1 The valve shall\nbe replaced by the maker.\nPage 1", "Header 2\n1.2 The hose shall be replaced by the maker.\nPage 2", "Header 3\n§ 5 Another clause of the text is here.\n1. An item of it\nPage 3"]
    table = spark.createDataFrame([("d", "en", i + 1, t) for i, t in enumerate(text)], "doc string, lang string, page int, text string")
    rows = pages.segments(pages.scoped_lines(pages.kept_lines(pages.lines_of(table)))).orderBy("ord").collect()
    assert [(r.section_no, r.scope) for r in rows] == [("1.1", "X1"), ("1.2", "X1"), ("§ 5", "")] or [(r.section_no, r.scope) for r in rows][-3:] == [("1.1", "X1"), ("1.2", "X1"), ("§ 5", "")]
    assert "Header" not in " ".join(r.text for r in rows) and rows[-1].text.endswith("1. An item of it")


def test_best_matches_against_a_loop(spark):
    random.seed(13)
    vocabulary = ["valve", "hose", "pump", "seal", "door", "roof", "axle", "test", "shall", "close"]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(3, 9))) for _ in range(25)]
    table = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "id int, t string, g int")
    got = {r.id: r.best for r in retrieval.best_matches(table, table.where("id < 5"), "id", "t", "g", 0.0).collect()}
    ratio = lambda i, j: retrieval.fuzzy(texts[i].split(), texts[j].split())
    for i in range(5):
        assert got[i] == pytest.approx(max(ratio(i, j) for j in range(25) if j != i))


def test_candidates_move_no_pairs(spark, monkeypatch):
    random.seed(5)
    texts = [" ".join(random.choices(["valve", "hose", "pump", "seal", "door", "roof"], k=random.randint(0, 6))) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    weighted = retrieval.weights(table, "id", F.col("t"))
    rows = {}
    for r in weighted.collect():
        rows.setdefault(r.id, {})[r.token] = r.w
    cosine = {(a, b): sum(w * rows[b].get(t, 0) for t, w in rows[a].items()) for a in rows for b in rows if a < 7 and a != b}
    monkeypatch.setattr(retrieval, "ROWS", 5)
    monkeypatch.setattr(retrieval, "PRODUCTS", 20)
    found = retrieval.candidates(table.where("id < 7"), weighted, "id", 0.31)
    assert {(r.a, r.b): r.cosine for r in found.collect()} == pytest.approx({k: c for k, c in cosine.items() if c >= 0.31})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (token" not in plan.rpartition("FlatMapCoGroupsInArrow")[0] and "FlatMapCoGroupsInArrow" in plan


def test_clean_asks_ranges_not_single_characters(spark):
    blocks = [chr(c) for lo, hi in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFF)) for c in range(lo, hi + 1)]
    texts = ["a" + c + "b" for c in blocks] + ["plain  text", "", None, "ﷲ الله"]
    want = ["a" + T.unicodedata.normalize("NFKC", c).replace("\u0640", "") + "b" for c in blocks]
    got = values(spark, T.clean(F.col("s")), texts)
    assert got[-4:-1] == ["plain text", "", None]
    assert [g for g in got[: len(blocks)]] == [" ".join(w.split()) for w in want]
    plan = spark.createDataFrame([("a",)], "s string").select(T.clean(F.col("s")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert f"[{''.join(T.LIGATURES)}]" not in plan


def test_grams_are_counted_without_moving_them(spark, monkeypatch):
    texts = ["阀门应关闭abc-1阀门", "软管 abc-1 x", "", "关闭阀门的软管长度超过十个汉字", "阀门a/b", "关", "泵阀门关闭"]
    refs = spark.createDataFrame([(f"s{i}", texts[i % 7] + "测试" * (i % 3)) for i in range(60)], "sample_id string, ref_text string")
    rows = [(t, target, f"s{i}", 1 + i % 2, 30) for t, target, step in (("a", "软管", 0), ("b", "泵", 1)) for i in range(step, 60, 2)]
    asked = spark.createDataFrame(rows, "term_id string, target_term string, sample_id string, times long, m long").join(refs, "sample_id")
    grams = refs.select("sample_id", F.explode(T.gram_counts(F.col("ref_text"), 2, 10)).alias("gram")).groupBy("sample_id", "gram").agg(F.count("*").alias("k"))
    assert {(r.sample_id, r.gram): r.k for r in grams.collect()} == {(r.sample_id, g): k for r in refs.collect() for g, k in retrieval.grams_of(r.ref_text).items()}
    want = asked.join(grams, "sample_id").groupBy("term_id", "gram").agg(F.first("target_term").alias("t"), F.count("*").alias("n"), F.count_if(F.col("k") == F.col("times")).alias("fit")).where("n / 30 >= 0.3 or gram = t")
    monkeypatch.setattr(retrieval, "CHUNK", 7)
    got = retrieval.gram_counts(asked)
    assert {(r.term_id, r.gram, r["count"], r.fit) for r in got.collect()} == {(r.term_id, r.gram, r.n, r.fit) for r in want.where("n / 30 >= 0.3 or gram = t").collect()}
    df = grams.groupBy("gram").agg(F.count("*").alias("df")).join(want.select("gram").distinct(), "gram")
    monkeypatch.setattr(retrieval, "TEXTS", 9)
    assert sorted(map(tuple, retrieval.gram_documents(refs, want.select("gram").distinct()).collect())) == sorted(map(tuple, df.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "mt_de.jsonl").write_text('{"a": "1"}\n')
    (tmp_path / "x.jsonl").write_text('{"a": "2"}\n{"a": ""}\n')
    found = files.expanded([str(tmp_path), str(tmp_path / "*.jsonl")])
    assert len(found) == 2
    assert {(r.a, r.file, r.lang) for r in files.read_many(spark, found, "a string").collect()} == {("1", "mt_de.jsonl", "de"), ("2", "x.jsonl", None), ("", "x.jsonl", None)}
    assert files.read_optional(spark, str(tmp_path / "none"), "a string").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_first(spark, [str(tmp_path / "none")], "a string")
    with pytest.raises(ValueError):
        files.guarded(str(tmp_path / "first" / "x"), [str(tmp_path / "first")])
    files.append_jsonl(spark.createDataFrame([("k",)], "a string"), str(tmp_path / "out"))
    files.append_jsonl(spark.createDataFrame([("",)], "a string"), str(tmp_path / "out"))
    assert files.written_counts(spark, str(tmp_path / "out"), "a").agg(F.sum("rows"), F.sum("without_key")).first() == (2, 1)
    before = files.manifest(spark, str(tmp_path)).where("file like '%.jsonl'").collect()
    changed = spark.createDataFrame([(r.file, "0" if r.file == "x.jsonl" else r.sha256) for r in before], "file string, sha256 string")
    assert {(r.file, r.change) for r in files.manifest_changes(spark.createDataFrame(before), changed).collect()} == {("x.jsonl", "changed")}
    assert files.settings({"n": 1, "flag": True}, "NO_SUCH") == {"n": 1, "flag": True}
    assert files.summary_table(spark.range(1), "t") == "# t\n\n| id |\n|-|\n| 0 |\n"


def test_scalars(spark):
    assert values(spark, T.truthy(F.col("s")), ["Yes", "0", "x", None]) == [True, False, None, None]
    assert values(spark, T.confidence(F.col("s")), ["high", "0.7", "?", None]) == [1.0, 0.7, None, None]
    assert values(spark, T.nfkc(F.col("s")), ["Ａ１ ", "ﬁn", "é", None, "x"]) == ["A1", "fin", "é", None, "x"]
    assert values(spark, T.redacted(F.col("s")), ["see http://10.0.0.1/x Bearer abc.def", "plain"]) == ["see <address> ***", "plain"]
    assert values(spark, T.json_list(F.col("s")), ['["a"]', "x", None]) == [["a"], [], []]
    assert values(spark, T.generation_clean(F.col("s")), [" a \n\n\n\n b ", None]) == ["a\n\nb", None]
    assert values(spark, T.language_of_file(F.col("s")), ["x/mt_fr.json", "de.jsonl", "a_zh.pdf", "q"]) == ["fr", "de", "zh", None]
    assert values(spark, T.stage(F.col("s")), ["First", "retry_tcr", "x"]) == ["first_pass", "retry", None]
    rows = spark.createDataFrame([("s", "t", ["T", "a", "A", "t"])], "x string, y string, z array<string>")
    assert rows.select(terms.own_aliases(F.col("x"), F.col("y"), F.col("z")).alias("a")).first().a == ["T", "a", "s"]
