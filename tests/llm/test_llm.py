import random
import unicodedata

import numpy as np
import pytest

encode = pytest.importorskip("clauseloom.llm.encode")
from pyspark.sql import functions as F  # noqa: E402

from clauseloom.llm import align, chars, defects, neardup, pack, scans, sentences, spans, truncation  # noqa: E402


def texts(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"id {kind}, text string")


def test_encoding_equals_the_public_tokenizer(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(f"{encode.TOKENIZERS}/{encode.VOCABULARY}"), special_tokens={})
    cases = [None, "", " ", "The valve.  Don't\n\n x", "阀门 12.5 °C", "<|endoftext|>", "a\0b\U0001f600", "ก้า" * 50, "x" * 5000]
    rows = encode.encode(texts(spark, list(enumerate(cases)), "int"), "id", "text").collect()
    assert {r.id: r.ids for r in rows} == {i: own.encode_ordinary(t or "") for i, t in enumerate(cases)}
    back = encode.encode(texts(spark, list(enumerate(cases)), "int"), "id", "text").select("id", encode.decode_column(F.col("ids")).alias("t")).collect()
    assert {r.id: r.t for r in back} == {i: t or "" for i, t in enumerate(cases)}


def test_packing_is_whole_and_tight(spark):
    random.seed(1)
    sizes = [0, 0, 2048, 2049, 9000, *[random.randint(1, 900) for _ in range(400)], *[700] * 200]
    out = pack.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size int"), salted=50).collect()
    by_doc, by_container = {}, {}
    for r in out:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.piece_size
        by_container[r.container_id] = by_container.get(r.container_id, 0) + r.piece_size
        assert r.pieces == 1 or sizes[r.doc_id] > 2048
    assert by_doc == dict(enumerate(sizes)) and max(by_container.values()) <= 2048
    assert sum(sizes) / (2048 * len(by_container)) > 0.97
    assert pack.pack(spark.createDataFrame([], "doc_id long, size int")).count() == 0


def test_tiers_change_the_plan():
    random.seed(5)
    sizes = {s: random.randint(1, 9) for s in random.sample(range(1, 2048), 300)}
    plans = {t: pack.plan(dict(sizes), 2048, t) for t in (1, 2, 4)}
    assert str(plans[4]) != str(plans[1])
    for tiers, lines in plans.items():
        packed = {}
        for pattern, times in lines:
            assert sum(s * n for s, n in pattern) <= 2048
            for s, n in pattern:
                packed[s] = packed.get(s, 0) + n * times
        assert packed == sizes, tiers
        least = -(-sum(s * n for s, n in sizes.items()) // 2048)
        assert sum(times for _, times in lines) <= 1.08 * least
    assert [pack.tier_of(s, 2048, 4) for s in (2048, 1025, 1024, 513, 512, 256, 1)] == [0, 0, 1, 1, 2, 3, 3]


def test_shared_spans_against_brute_force(spark):
    random.seed(2)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passages = [word(40), word(41), word(90)]
    docs = [word(60) + passages[0] + word(10), passages[0], word(30) + passages[1], passages[1][1:] + word(5), passages[2] + word(50), word(9) + passages[2], None, "", "ab" * 60, "ab" * 30, word(20), docs_copy := word(80), docs_copy]
    least = 40
    found = {tuple(r) for r in spans.shared_pairs(texts(spark, list(enumerate(docs)), "long"), "id", "text", least).collect()}
    grams = [{d[i : i + least] for i in range(len(d) - least + 1)} if d else set() for d in docs]
    assert found == {(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if grams[a] & grams[b]}
    amounts = {r.id: r.shared_chars for r in spans.shared_amounts(texts(spark, list(enumerate(docs)), "long"), "id", "text", least).collect()}
    assert amounts[1] == 40 and amounts[6] == amounts[7] == 0 and amounts[11] == 80 and amounts[3] == 40


def test_shared_amounts_of_hot_passages(spark, monkeypatch):
    random.seed(8)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage, least = word(70), 40
    docs = [word(random.randint(0, 30)) + passage[random.choice([0, 0, 5, 31]) : random.choice([70, 70, 66, 45])] + word(random.randint(0, 30)) for _ in range(14)] + [word(60), passage, passage]
    table = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    expected = {}
    for i, d in enumerate(docs):
        grams = [{e[j : j + least] for j in range(len(e) - least + 1)} for k, e in enumerate(docs) if k != i]
        held = {p for j in range(len(d) - least + 1) if any(d[j : j + least] in g for g in grams) for p in range(j, j + least)}
        expected[i] = len(held)
    for hot in (64, 2):
        monkeypatch.setattr(spans, "HOT", hot)
        assert {r.id: r.shared_chars for r in spans.shared_amounts(table, "id", "text", least).collect()} == expected, hot


def test_near_duplicates_against_brute_force(spark):
    random.seed(3)
    base = ["".join(random.choice("abcde fgh") for _ in range(n)) for n in (30, 60, 61, 200)]
    rows = [b for t in base for b in (t, t, t.upper() + " ", t[:-2] + "zz", t[: len(t) // 2] + "q" + t[len(t) // 2 :], t[::-1])] + [None, "", "abc", "abcde", "abcde "]
    found = {tuple(r) for r in neardup.pairs(texts(spark, [(f"{i:03}", t) for i, t in enumerate(rows)]), "id", "text").collect()}
    sets = [{neardup.normal(t)[i : i + 5] for i in range(len(neardup.normal(t)) - 4)} if t else set() for t in rows]
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.7
    assert found == {(f"{i:03}", f"{j:03}") for i in range(len(rows)) for j in range(i + 1, len(rows)) if near(sets[i], sets[j])}
    assert neardup.pairs(texts(spark, []), "id", "text").count() == 0


def test_narrow_sketches_lose_no_pair(monkeypatch):
    rng, t, level = np.random.default_rng(4), 0.7, 15
    assert all(neardup.planes_of(x, t) <= 2.2 * (t - 1e-6) ** -(x + 1) for x in range(12, 40))
    monkeypatch.setattr(neardup, "BLOCK", 16)
    sets = [rng.integers(0, 1 << 63, int(rng.integers(211, 300))).astype(np.uint64) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, k // 2).astype(np.uint64)])) for s in sets for k in range(0, 60, 6)]
    sizes, rows = np.array([len(s) for s in sets]), np.array([neardup.sketch(s, neardup.planes_of(level, t)) for s in sets])
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    near = {(i, j) for i, j in zip(*np.nonzero(common >= t * (sizes[:, None] + sizes - common))) if i < j}
    for same in (False, True):
        found = {(min(i, j), max(i, j)) for i, j in zip(*neardup.near(rows, sizes, rows, sizes, t, same))}
        assert near <= found and len(found) < 1.2 * len(near) + len(sets)


def test_texts_meet_only_cells_that_may_hold_similar_ones(spark):
    random.seed(6)
    words = ["".join(random.choice(part) for _ in range(6)) for part in ("abcdef", "uvwxyz") for _ in range(40)]
    bodies = [" ".join(random.choice(words[:40] if i % 2 else words[40:]) for _ in range(random.randint(20, 40))) for i in range(400)]
    bodies += [t[:50] + "-" * k + t[50 + k :] for k in (3, 11) for t in bodies[:60]]
    rows = [(f"{i:03}", t) for i, t in enumerate(bodies)]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in bodies]
    expected = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    links, _ = neardup.near_duplicates(texts(spark, rows), "id", "text", tile=128)
    assert {(r.rep_a, r.rep_b) for r in links.collect()} == expected and len(expected) >= 60
    reps = texts(spark, rows).withColumnRenamed("id", "rep").cache()
    sent = [neardup.laid(neardup.sketched(reps, 0.7, 5, known), 0.7, 128)[0] for known in (neardup.kinds([]), neardup.kinds([neardup.shingles(t) for t in bodies]))]
    of = F.col("rep").cast("int") % 2
    mixed = [s.groupBy("x", "y").agg(F.sum(of).alias("odd"), F.sum(1 - of).alias("even")).agg(F.sum(F.col("odd") * F.col("even"))).head()[0] for s in sent]
    assert mixed[1] < mixed[0] / 10


def test_consistent_form(spark):
    cases = {"Ａrtiсle １": "Article 1", "a​b\xa0c": "ab c", "été": "été", "ﬁn": "fin", "⽤于": "用于", "РСN361": "PCN361", "соcтав": "состав", "m² 25 °C № 3，。": "m² 25 °C № 3，。", "ก้ำ": "ก้ำ", "kРа": "kPa", unicodedata.normalize("NFD", "한글 가값"): "한글 가값"}
    rows = texts(spark, list(cases.items())).select(F.col("id").alias("text"))
    got = {r.text: r.text_form for r in chars.consistent(rows, "text").collect()}
    assert got == cases
    sections = chars.consistent(texts(spark, [("1", "В.9．1"), ("2", None), ("3", "Статья 7")]), "text", section=True).collect()
    assert {r.id: r.text_form for r in sections} == {"1": "B.9.1", "2": None, "3": "Статья 7"}
    assert all(unicodedata.normalize("NFC", v) == v for v in got.values())


@pytest.mark.parametrize(
    "lang, text, starts",
    [
        ("en", "3.1. See para. 4.2, e.g. the hose. The label reads “Keep up. Fragile.” It is approx. 3.5 mm long.", [0, 35, 71]),
        ("en", "The label “Hot. Caution.” shall be kept.Next one", [0, 40]),
        ("de", "Das gilt, z. B. nach Abs. 3. Es heißt „Nicht öffnen! Spannung.“ Der Rest.", [0, 29, 64]),
        ("ru", "Каждые 7 мес. орган проверяет, т. е. см. рис. 5. Надпись «Верх. Хрупкое.» наносят на шланг.", [0, 49]),
        ("zh", "标注“保持直立。易碎。”字样。写明“小心。”对于阀门，见图1。（本句为补充。）完", [0, 15, 22, 31, 39]),
        ("th", "ระยะห่างมีค่าประมาณ 5 mm โดยรวม หากโครงมีค่ามากกว่า 3 N ต้องเปลี่ยนวาล์ว", [0, 32]),
        ("ar", "كتب ما يلي «لا تفتح! يوجد جهد.» يفحص المرشح 3.5 مرة. تقدم الجهة", [0, 32, 53]),
        ("en", "  ", []),
        ("en", "See https://a.bc/d.e.html now. Next \ue0ff one.", [0, 31]),
        ("en", "The label reads “Hot. Very hot. And a long text goes on. And on. And on. And on. And on. And never ends", [0]),
    ],
)
def test_sentence_starts(spark, lang, text, starts):
    row = spark.createDataFrame([(lang, text)], "lang string, t string")
    got = sentences.units(row, "t", F.col("lang"), F.lit(False)).collect()
    assert sorted(r.sent_start for r in got) == starts
    assert all(text[r.sent_start :].startswith(r.sentence) for r in got)


@pytest.mark.parametrize(
    "text, awaited",
    [
        ("写明“保持直立。", ["”"]), ("写明“保持直立。”", []), ("lautet „Nicht öffnen!", ["“"]), ("lautet „Nicht öffnen!“ Ende", []),
        ('He wrote "keep it upright and', ['"']), ('He wrote "keep" it', []), ("See <b>in bold and", ["</b>"]), ("See <b>in</b> bold<br> and", []),
        ("(a [b) c", []), ("(a [b", [")", "]"]), ("a) b)", []), ("```json\n{}", ["```"]), ("``` x ```", []), (None, None), ("", []),
    ],
)
def test_structure_automaton(spark, text, awaited):
    row = spark.createDataFrame([(text,)], "t string").select(truncation.open_marks(F.col("t")).alias("x")).first()
    assert (row.x or None) == (awaited or None)


def test_clean_texts_take_the_short_way(spark):
    """What passes for clean has no invisible or white character, and either way gives the same text."""
    import re

    clean, care = re.compile(f"[{chars.CLEAN}]"), re.compile(f"[{chars.INVISIBLE}{chars.WHITE}]")
    assert not [c for c in map(chr, range(0x10FFFF)) if clean.match(c) and care.match(c)]
    cases = ["", " ", "a", "a b", " a", "a ", "a  b", "a\n", "a\nb", "a \u3000b", "a\xa0b", "a\xad b", "阀门，（1）", "阀\u200b门", "\u2028a", "a\x1cb", "\U0001f600 a", "x " * 9000, "وفق ما ورد", "ก้า ข"]
    once = lambda t: re.sub(f"[{chars.WHITE}]+", " ", re.sub(f"[{chars.INVISIBLE}]+", "", t)).strip(" ")
    got = texts(spark, [(str(i), t) for i, t in enumerate(cases)] + [("none", None)]).select("id", truncation.tidy(F.col("text")).alias("t"), defects._plain(F.col("text")).alias("p")).collect()
    assert {r.id: r.t for r in got} == {str(i): once(t) for i, t in enumerate(cases)} | {"none": None}
    plain = {r.id: r.p for r in got}
    assert (plain["7"], plain["11"], plain["13"], plain["none"]) == ("a ", "a b", "阀门", None)


def cut_rows(spark, rows):
    table = spark.createDataFrame(rows, "sample_id string, doc string, lang string, text string, kind string")
    seen = truncation.states(table).withColumn("fingerprint", F.xxhash64("text")).drop("text", "kind", "tidied")
    return {r.sample_id: r.route for r in truncation.cut_off(seen, table.select("lang", "text", "kind"), ["sample_id"], ["doc"], ["doc"]).collect()}


def test_truncated_texts(spark):
    full = [(f"f{i}", "d", "zh", f"阀门{i}的偏差不得超过{i}毫米，但以第{i}条为准。", "paragraph") for i in range(30)]
    odd = [("cut", "zh", "阀门7的偏差不得", "paragraph"), ("title", "zh", "阀门的要", "title"), ("null", "zh", None, "paragraph"), ("quote", "zh", "写明“小心。", "paragraph"), ("lead", "zh", "检查下列各项：", "paragraph"), ("blank", "zh", " ", None)]
    odd += [("tag", "en", "See the <a href='x'>note.", "paragraph"), ("multi", "en", "The valve is clo�", "paragraph"), ("escape", "en", "The valve is \\u00", "paragraph"), ("short", "en", "The value is approx.", "paragraph")]
    full += [(f"e{i}", "d", "en", f"The valve number {i} is closed.", "paragraph") for i in range(10)]
    assert cut_rows(spark, full + [(k, "d", *x) for k, *x in odd]) == {"cut": "baseline", "quote": "structure", "tag": "structure", "multi": "structure", "escape": "structure", "short": "baseline"}
    assert cut_rows(spark, []) == {}


def test_sources_that_leave_stops_out(spark):
    full = [(f"f{i}", "d", "zh", f"阀门{i}的偏差不得超过{i}毫米，但以第{i}条为准。", "paragraph") for i in range(30)]
    bare = [(f"b{i}", "bare", "zh", f"阀门{7 ** i}的偏差不得超过{i}毫米，但以第{i}条为准", "paragraph") for i in range(8)]
    limit = [(f"l{i}", "limit", "zh", f"阀门的偏差不得超过{i}毫米，但以第{i}条为", "paragraph") for i in range(5)] + [("ended", "limit", "zh", "阀门。", "paragraph")]
    found = cut_rows(spark, full + bare + limit + [("x", "bare", "zh", "阀门9的偏差不得", "paragraph")])
    assert found == {"x": "suffix"} | {f"l{i}": "limit" for i in range(5)}


def test_defects(spark):
    known = [f"The valve number {i} shall not exceed {i} mm when measured on the hose." for i in range(20)] + [f"阀门{i}在软管上测量时不得超过{i}毫米。" for i in range(20)] + ["Ventil wird bei der Messung an dem Schlauch nicht überschritten und ist dicht."]
    rows = [(f"s{i}", "g", "en", "paragraph", known[i], known[20 + i]) for i in range(20)]
    written = [("en", k) for k in known[:20]] + [("zh", k) for k in known[20:40]] + [("de", known[-1])]
    rows += [("empty", "g", "en", "paragraph", known[0], "译文："), ("null", "g", "en", "paragraph", known[0], None), ("none", "g", "en", "paragraph", known[0], "N/A"), ("copy", "g", "en", "paragraph", known[1], f"“{known[1].upper()}”"), ("german", "g", "en", "paragraph", known[2], known[-1]), ("table", "g", "en", "table", "AB-12 / C3", "AB-12 / C3")]
    rows += [(f"no{i}", "g", "en", "paragraph", known[i], "I apologise, but this is outside of what I can process.") for i in range(3)]
    answers = spark.createDataFrame(rows, "sample_id string, experiment_group string, source_lang string, segment_type string, source_text string, hypothesis string").withColumn("document_id", F.lit("d")).withColumn("ref_text", F.lit(None).cast("string"))
    found, _ = defects.found(answers, spark.createDataFrame(written, "lang string, text string"))
    assert {r.sample_id: r.defect for r in found.collect()} == {"empty": "empty", "null": "empty", "none": "empty", "copy": "copy", "german": "wrong_language", "no0": "refusal", "no1": "refusal", "no2": "refusal"}


def test_refusals_among_varied_openings(spark, monkeypatch):
    monkeypatch.setattr(defects, "BAND", 8)
    refusal, varied = "zu dieser anfrage gibt es nichts", "zu dieser anfrage gibt es gar nichts"
    odd = [(f"r{i}", "g", f"source {i}", refusal) for i in range(2)] + [("v", "g", "source v", varied)]
    # each band of the refusal is led by a part that shares only its least trigram
    odd += [(f"d{c}{i}", "g", f"other {c}{i}", c + t[i : i + 3] + c) for c in "abcdefghijkl" for t in (refusal, varied) for i in range(len(t) - 2)]
    table = spark.createDataFrame(odd, "sample_id string, experiment_group string, source_text string, opening string")
    assert {"r0", "r1", "v"} <= {r.sample_id for r in defects.templates(table, 4, 1).collect()}


def test_runs_that_occur_nowhere(spark, monkeypatch):
    monkeypatch.setattr(defects, "WANTED_BITS", 8)  # a full map loses nothing, the join is exact
    random.seed(4)
    known = ["".join(random.choice("abcdefghij klmnop") for _ in range(2000)) for _ in range(4)]
    table = spark.createDataFrame([("en", k) for k in known] + [("de", "zwei neue ventile " * 20), (None, "x"), ("zh", "阀门")], "lang string, text string")
    rows = spark.createDataFrame([("a", " ".join(known[1].split()), "latin"), ("b", "nothing of this sentence is known to that text", "latin"), ("c", "zwei neue ventile", "latin"), ("d", "", None)], "id string, plain string, spoken string")
    got = {r.id: (r.alien, r.spoken) for r in defects.alien_share(rows, ["id"], table).collect()}
    assert got["a"][0] == 0 and got["b"][0] > 0.8 and got["c"] == (0.0, "de") and got["d"] == (0.0, None)


SCAN = "sample_id string, document_id string, source_lang string, segment_type string, source_text string, ref_text string"


def test_scan_noise(spark):
    clean = [(f"c{i}", "pdf", "en", "paragraph", f"The manufacturer shall replace the conditioned valve housing number {i}.", f"制造商应更换阀门的外壳{i}。") for i in range(8)]
    scan = [("x", "scan", "en", "paragraph", "The manu-\nfacturer shall\n- 12 -\nreplace the c0nditi0ned\nvalve.", None)]
    # three words show what is misread
    scan += [(f"o{w}", "scan", "en", "paragraph", f"The {w}\nvalve.", None) for w in ("h0using", "c0nditioned", "conditi0ned")]
    scan += [(f"h{i}", "scan", "en", "paragraph", f"The manufacturer shall\nREGULATION AB-12{i} – REVISION {i}\nreplace the valve.", None) for i in range(3)]
    found = scans.noise(scans.fields(spark.createDataFrame(scan, SCAN)), scans.fields(spark.createDataFrame(clean, SCAN)))
    expected = {("x", "hyphenation"), ("x", "page_number"), ("x", "misread"), *((f"h{i}", "running_header") for i in range(3))}
    assert {(r.sample_id, r.noise) for r in found.collect()} == expected
    assert scans.noise(scans.fields(spark.createDataFrame([], SCAN)), scans.fields(spark.createDataFrame([], SCAN))).count() == 0


def test_words_with_many_misread_characters(spark):
    words = "Anforderungen Signalisolierung Modus Leitung Regelung Messung Prüfung Gelenk Ladung Motor Bolzen Rohre Kolben Filter Signale Zeile Seite Linie".split()
    clean = [(f"c{i}", "pdf", "de", "paragraph", " ".join(words) + f" {i}.", None) for i in range(4)]
    confused = [("l", "i"), ("1", "l"), ("0", "o"), ("c", "e"), ("ri", "n"), ("9", "g")]
    single = [(f"{wrong}{w}", "scan", "de", "paragraph", f"Die {w.lower().replace(right, wrong, 1)}\nist", None) for wrong, right in confused for w in [w for w in words if right in w.lower()][:4]]
    scan = [("three", "scan", "de", "paragraph", "Die\nSlgna1lsolierung", None), ("five", "scan", "de", "paragraph", "Die\nAnf0rdcruri9cn", None), ("none", "scan", "de", "paragraph", "Die\nAnforderung", None)]
    found = scans.noise(scans.fields(spark.createDataFrame(scan + single, SCAN)), scans.fields(spark.createDataFrame(clean, SCAN)))
    assert {("three", "misread"), ("five", "misread")} <= {(r.sample_id, r.noise) for r in found.collect()} and "none" not in {r.sample_id for r in found.collect()}
    rules = scans.by_first(scans.rules_of([*confused, ("i", "l"), ("c", "o")]))
    assert scans.confusions("anf0rdcruri9cn", "anforderungen", rules) == 5 and scans.confusions("c1ause", "clause", rules) == 1
    assert scans.confusions("modus", "rnodus", rules) is None
    # any number of confusions leaves the key as it is
    pairs = spark.createDataFrame([("anf0rdcruri9cn", "anforderungen"), ("slgna1lsolierung", "signalisolierung")], "a string, b string")
    assert all(r.x == r.y for r in pairs.select(scans.confusion_key(F.col("a"), confused).alias("x"), scans.confusion_key(F.col("b"), confused).alias("y")).collect())


def test_scans_are_repaired_whole(spark):
    shape = "sample_id string, document_id string, source_lang string, segment_type string, source_text string, ref_text string"
    zh = ["制造商应更换阀门的外壳", "检查人员用阀门控制压力", "软管与阀门相连接处理", "车辆的阀门须清洁干净"]
    th = "ต้องเปลี่ยนวาล์วทุกปี"
    clean = [(f"c{i}", "pdf", "en", "paragraph", f"The manu-facturer uses a well-known valve {i}.", zh[i % 4]) for i in range(16)]
    clean += [(f"t{i}", "pdf", "th", "paragraph", th, None) for i in range(4)]
    scan = [(f"z{i}", "scan", "th", "paragraph", th, z.replace("阀门", "阅门")) for i, z in enumerate(zh)]
    scan += [("hyphen", "scan", "en", "paragraph", "A well-\nknown val-\nve.", None), ("page", "scan", "en", "paragraph", "- 12 -", None)]
    out = {(r.field, r.sample_id): r.text for r in scans.repaired(scans.fields(spark.createDataFrame(scan, shape)), scans.fields(spark.createDataFrame(clean, shape))).collect()}
    assert {k[1]: v for k, v in out.items() if k[0] == "ref_text"} == {f"z{i}": z for i, z in enumerate(zh)}
    assert out["source_text", "hyphen"] == "A well-known valve." and out["source_text", "page"] == ""
    assert all(out["source_text", f"z{i}"] == th for i in range(4))
    assert scans._placed("见 AB-1 阅门，\n阅门", [{"before": ord("0"), "char": ord("阅"), "after": ord("门"), "right": ord("阀")}], 1) == "见 AB-1 阀门，\n阅门"


def test_alignment(spark):
    parts, zh = ["roof", "door", "axle", "fuel", "seat", "brake"], ["车顶", "车门", "车轴", "燃料", "座椅", "制动"]
    rows = []
    for i in range(36):
        a, b = i % 6, (i // 6 + i) % 6
        rows.append((f"s{i:02}", "d", "en", "paragraph", i, f"The {parts[a]} valve weighs {100 + i} kg. The {parts[b]} hose measures {500 + i} mm.", f"{zh[b]}软管长度为{500 + i} mm。{zh[a]}阀门重量为{100 + i} kg。" if i else None))
    clauses = spark.createDataFrame(rows, "sample_id string, document_id string, source_lang string, segment_type string, order_source int, source_text string, ref_text string")
    found = {tuple(r) for r in align.aligned(clauses).collect()}
    expected = set()
    for sid, _, _, _, _, s, r in rows[1:]:
        expected |= {(sid, 0, sid, r.index("。") + 1), (sid, s.index(". ") + 2, sid, 0)}
    assert found == expected


def test_translation_tables_of_small_chunks(spark, monkeypatch):
    """What a round moves doesn't hold the pairs of tokens, and chunks of any size give the table of plain EM."""
    random.seed(9)
    pairs = list({(" ".join(sorted(random.sample("abcdefghij", random.randint(1, 5)))), " ".join(sorted(random.sample("阀门软管制动车轴", random.randint(1, 5))))) for _ in range(150)})
    floor, table = 0.08, {}
    for i in range(3):
        counts, totals = {}, {}
        for es, fs in ((e.split(), f.split()) for e, f in pairs):
            for f in fs:
                share = sum(table.get((e, f), 0) for e in es)
                for e in es:
                    c = 1 / len(es) if not i else table.get((e, f), 0) / share if share else 0
                    counts[e, f] = counts.get((e, f), 0) + c
                    totals[e] = totals.get(e, 0) + c
        table = {k: c / totals[k[0]] for k, c in counts.items() if c and c >= floor * totals[k[0]]}
    number = lambda x, salt="": int(align.hashes([x], salt)[0])
    rows = spark.createDataFrame([("en", *p) for p in pairs + pairs[:9]], "language string, es string, fs string")
    for size in (10, 1000):
        monkeypatch.setattr(align, "CHUNK", size)
        chunks = align.training_chunks(rows, {"en": 160}).persist()
        assert chunks.count() == (16 if size == 10 else 1)
        got = {(r.e, r.f): r.t for r in align.translation_tables(chunks, 3, floor).collect()}
        assert got == pytest.approx({(number(e, "en"), number(f)): t for (e, f), t in table.items()})


def test_blocks_are_small_and_neighbours_meet(spark, monkeypatch):
    parts, zh = ["roof", "door", "axle", "fuel", "seat", "brake"], ["车顶", "车门", "车轴", "燃料", "座椅", "制动"]
    # every reference is filed under the neighbour three places on
    text = lambda i: f"The {parts[i % 6]} valve weighs {100 + i} kg."
    rows = [(f"s{i:03}", "d", "en", "paragraph", i, text(i), f"{zh[(i - 3) % 6]}阀门重量为{97 + i} kg。" if i >= 3 else None) for i in range(150)]
    clauses = spark.createDataFrame(rows, "sample_id string, document_id string, source_lang string, segment_type string, order_source int, source_text string, ref_text string")
    blocks = align.packed(clauses).collect()
    assert sorted((r.home, r.n) for r in blocks) == [(0, 125), (1, 128), (2, 44)]
    assert sum(len(r.blob) for r in blocks) < 8 * sum(len(w) for r in blocks for w in align._opened(r.blob)[5])
    for size in (64, 1 << 14):
        monkeypatch.setattr(align, "CHUNK", size)
        assert {tuple(r) for r in align.aligned(clauses).collect()} == {(f"s{i:03}", 0, f"s{i + 3:03}", 0) for i in range(147)}, size


def test_links_across_a_whole_document(spark, monkeypatch):
    """References filed far from their clauses are found in documents of one block and of several, also where they join what is linked already."""
    parts, zh = ["roof", "door", "axle", "fuel", "seat", "brake"], ["车顶", "车门", "车轴", "燃料", "座椅", "制动"]
    text = lambda i: f"The {parts[i % 6]} valve weighs {100 + i} kg."
    ref = lambda i: f"{zh[i % 6]}阀门重量为{100 + i} kg。"
    rows, expected = [], set()
    for doc, n, moved in (("d", 150, {5: 120, 131: 60}), ("e", 40, {3: 33})):
        refs = {i: ref(i) for i in range(n) if i not in moved and i not in moved.values()}
        refs |= {there: ref(here) for here, there in moved.items()}
        # the reference of the last clause but one joins its own sentence with that of the first but seven
        refs[n - 2] = ref(n - 2)[:-1] + "，" + ref(7)
        del refs[7]
        rows += [(f"{doc}{i:03}", doc, "en", "paragraph", i, None if i in moved.values() else text(i), refs.get(i)) for i in range(n)]
        far = moved | {7: n - 2}
        expected |= {(f"{doc}{i:03}", 0, f"{doc}{far.get(i, i):03}", 0) for i in range(n) if i not in moved.values()}
    clauses = spark.createDataFrame(rows, "sample_id string, document_id string, source_lang string, segment_type string, order_source int, source_text string, ref_text string")
    for span in (1, 32):
        monkeypatch.setattr(align, "SPAN", span)
        assert {tuple(r) for r in align.aligned(clauses).collect()} == expected, span


def test_wanted_runs_are_sent_as_bits(spark, monkeypatch):
    """The driver holds a bit and not a byte for each value that a run may have."""
    sent = []
    counted = defects.counted
    monkeypatch.setattr(defects, "counted", lambda texts, wanted: sent.append(wanted.nbytes) or counted(texts, wanted))
    rows = spark.createDataFrame([("a", "the valve is closed", "latin")], "id string, plain string, spoken string")
    table = spark.createDataFrame([("en", "the valve is closed")], "lang string, text string")
    assert [r.alien for r in defects.alien_share(rows, ["id"], table).collect()] == [0]
    assert sent == [(1 << defects.WANTED_BITS) // 8]


def test_plans_stay_small(spark, monkeypatch):
    # after every stage the driver describes the whole plan again
    from clauseloom.llm import queries

    sizes = []

    def measured(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return df

    for module in (truncation, defects):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: cut(measured(df)))
    measured(queries.p4_found(spark, "/root/testdata/sf0.001"))
    assert len(sizes) > 10 and max(sizes) <= 60
