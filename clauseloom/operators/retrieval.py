"""Similar texts and what terms stand beside: best matches, groups of near-duplicates, associations with references."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.session import cut

# How alike candidates and duplicates are, how many candidates are compared, and the limits of associations.
CANDIDATES, COSINE, DUPLICATE, THRESHOLDS = 60, 0.30, 0.95, (0.95, 0.85, 0.75, 0.65, 0.50)
LEAST_GRAM, MOST_GRAM, RECALL, PRECISION, COUNTFIT, INSTANCES, MARGIN = 2, 10, 0.30, 0.50, 0.40, 3, 0.15
#: Latin terms, and the most rows of a term that are counted at once, of references that a task takes.
LATIN, CHUNK, TEXTS = r"[A-Za-z][A-Za-z0-9./-]*[A-Za-z0-9]", 8192, 65_536
#: The most texts of which a task holds the weights, and of pairs of texts of which it holds the sums.
ROWS, PRODUCTS = 16_384, 1 << 22
GRAMMATICAL = "的地得而则若及以其该本由从至于见应需可将被把等这那了是在和与或对按使之"


def fuzzy(a: list[str], b: list[str]) -> float:
    """Twice the matching tokens by the number of all tokens, matches found longest first."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """fuzzy() of two arrays of tokens."""

    @F.pandas_udf("double")
    def run(x, y):
        import pandas as pd

        return pd.Series([fuzzy(list(p), list(q)) for p, q in zip(x, y)])

    return run(a, b)


def weights(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, token, w: unit rows of tf-idf weights of words and pairs of words, idf smoothed."""
    words = texts.select(id_col, T.word_list(text).alias("t"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("t", i - 1), F.get("t", i)))
    grams = F.concat("t", F.when(F.size("t") > 1, pairs).otherwise(F.array().cast("array<string>")))
    counts = words.select(id_col, F.explode(grams).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))
    n = words.groupBy().agg(F.count("*").alias("all"))
    idf = counts.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", (F.log((1 + F.col("all")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, id_col).select(id_col, "token", (F.col("w") / F.col("norm")).alias("w"))


def candidates(queries: DataFrame, weighted: DataFrame, id_col: str, least: float = COSINE) -> DataFrame:
    """a, b, cosine of the query rows (a) with all others (b) of at least that cosine.

    The rows are dealt to parts, and every part gets the query rows' weights; so neither pairs nor their tokens are moved.
    """
    kind, n = dict(weighted.dtypes)[id_col], weighted.select(id_col).distinct().count()
    parts = max(weighted.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))

    def products(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = asked.column("a").unique()
        rows = rows.sort_by([(id_col, "ascending"), ("token", "ascending")])
        asked = asked.sort_by([("term", "ascending")])
        known = asked.column("term").unique()
        at = pc.index_in(rows.column("token"), known)
        rows, at = rows.filter(pc.is_valid(at)), at.drop_null().to_numpy()
        q, x = pc.index_in(asked.column("a"), names).to_numpy(), asked.column("x").to_numpy()
        size = np.bincount(pc.index_in(asked.column("term"), known).to_numpy(), minlength=len(known))
        first, own = np.cumsum(size) - size, rows.column(id_col).unique()
        b, y = pc.index_in(rows.column(id_col), own).to_numpy(), rows.column("w").to_numpy()
        left, right, cosines, step = [], [], [], max(1, PRODUCTS // max(1, len(names)))
        for low in range(0, len(own), step):
            r = slice(*np.searchsorted(b, (low, low + step)))
            k = size[at[r]]
            met = np.repeat(first[at[r]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            sums = np.bincount(np.repeat(b[r] - low, k) * len(names) + q[met], np.repeat(y[r], k) * x[met])
            found = np.flatnonzero((sums >= least) & (sums > 0))
            left, right, cosines = [*left, found % len(names)], [*right, found // len(names) + low], [*cosines, sums[found]]
        get = lambda of, i: of.take(pa.array(np.concatenate([np.array([], np.int64), *i]).astype(np.int64)))
        return pa.table({"a": get(names, left), "b": get(own, right), "cosine": np.concatenate([np.array([], np.float64), *cosines])})

    dealt = weighted.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(parts)))
    mine = weighted.join(queries.select(id_col), id_col, "left_semi").select(F.col(id_col).alias("a"), F.col("token").alias("term"), F.col("w").alias("x"))
    sent = mine.withColumn("of_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.groupBy("part").cogroup(sent.groupBy("of_part")).applyInArrow(products, f"a {kind}, b {kind}, cosine double").where("a <> b")


def best_matches(texts: DataFrame, queries: DataFrame, id_col: str, text: str, group: str, least: float = COSINE) -> DataFrame:
    """id, best, best_other, best_same: the greatest fuzzy ratio of each query with any other text, with one of another group, and with one of its own, among the CANDIDATES of greatest cosine (``least`` at least); 0 without one."""
    weighted = cut(weights(texts, id_col, F.col(text)))
    found = candidates(queries, weighted, id_col, least)
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))).where(F.col("rank") <= CANDIDATES)
    words = texts.select(id_col, T.word_list(F.col(text)).alias("t"), F.col(group).alias("g"))
    side = lambda s: words.select(F.col(id_col).alias(s), F.col("t").alias(f"t_{s}"), F.col("g").alias(f"g_{s}"))
    scored = top.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("score", fuzzy_ratio(F.col("t_a"), F.col("t_b")))
    best = scored.groupBy("a").agg(F.max("score").alias("best"), F.max(F.when(F.col("g_a") != F.col("g_b"), F.col("score"))).alias("best_other"), F.max(F.when(F.col("g_a") == F.col("g_b"), F.col("score"))).alias("best_same"))
    none = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return queries.select(id_col).distinct().join(best.withColumnRenamed("a", id_col), id_col, "left").select(id_col, none("best"), none("best_other"), none("best_same"))


def threshold_hits(best: DataFrame, column: str = "best") -> DataFrame:
    """threshold, hits: how many best matches lie above each threshold."""
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(column) > t).cast("int").alias("hit")) for t in THRESHOLDS])
    return best.select(F.explode(each).alias("x")).groupBy("x.threshold").agg(F.sum("x.hit").alias("hits"))


def group_statistics(groups: DataFrame, rows: DataFrame, id_col: str, group: str) -> DataFrame:
    """group, n, mean, range, deviation, answers, sources, refs, lift of the groups of two or more rows (id, score, source, ref, answer).

    lift: how much the mean would rise if every row had its group's best score."""
    joined = groups.join(rows, id_col)
    per = joined.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("range"), F.stddev_pop("score").alias("deviation"),
        F.count_distinct("answer").alias("answers"), F.count_distinct("source").alias("sources"), F.count_distinct("ref").alias("refs"), (F.max("score") - F.avg("score")).alias("lift"),
    )
    return per.where("n > 1")


def ceiling(groups: DataFrame, scores: DataFrame, id_col: str, group: str) -> DataFrame:
    """n, base, ceiling: the mean score, and the mean if every row had the best score of its group (its own outside of groups)."""
    best = groups.join(scores, id_col).groupBy(group).agg(F.max("score").alias("top"))
    with_best = scores.join(groups, id_col, "left").join(best, group, "left")
    return with_best.agg(F.count("score").alias("n"), F.avg("score").alias("base"), F.avg(F.when(F.col("score").isNotNull(), F.coalesce("top", "score"))).alias("ceiling"))


def term_like(gram: Column) -> Column:
    ascii_ = gram.rlike(r"^[\x00-\x7f]+$")
    return F.when(ascii_, F.length(gram) >= 2).otherwise(F.length(gram).between(2, 10) & ~gram.rlike(f"[{GRAMMATICAL}]"))


def trimmed(gram: Column) -> Column:
    """Without grammatical characters at its ends."""
    return F.regexp_replace(gram, f"^[{GRAMMATICAL}]+|[{GRAMMATICAL}]+$", "")


def grams_of(text: str) -> Counter:
    """How often a text has each of T.gram_counts()."""
    runs = re.findall(f"{T.CJK}+", text)
    found = Counter(r[i : i + n] for r in runs for n in range(LEAST_GRAM, MOST_GRAM + 1) for i in range(len(r) - n + 1))
    found.update(re.findall(LATIN, text))
    return found


def gram_counts(rows: DataFrame) -> DataFrame:
    """term_id, target_term, gram, m, count, fit of the grams that reach RECALL beside a term, and of its target: in how many of the term's m rows (term_id, target_term, sample_id, times, m, ref_text) they stand, and in how many as often as the term.

    A term's rows are counted in chunks.  What reaches RECALL in all of them reaches it in a chunk at least, so the first pass
    keeps what does so in some chunk; the second counts that in all chunks.  The grams themselves are never moved.
    """
    kind = dict(rows.dtypes)["term_id"]
    chunked = cut(rows.withColumn("chunk", F.pmod(F.xxhash64("sample_id"), F.ceil(F.col("m") / CHUNK))))

    def often(group: pa.Table) -> pa.Table:
        target, total = group.column("target_term")[0].as_py(), Counter()
        for text in group.column("ref_text").to_pylist():
            total.update(grams_of(text).keys())
        kept = [g for g, n in total.items() if n >= RECALL * len(group) - 1e-6 or g == target]
        return pa.table({"term_id": pa.array(group.column("term_id").to_pylist()[:1] * len(kept), group.schema.field("term_id").type), "gram": pa.array(kept, pa.string())})

    def exact(group: pa.Table, wanted: pa.Table) -> pa.Table:
        count, fit = dict.fromkeys(wanted.column("gram").to_pylist(), 0), Counter()
        for text, times in zip(group.column("ref_text").to_pylist(), group.column("times").to_pylist()):
            found = grams_of(text)
            for g in count.keys() & found.keys():
                count[g] += 1
                fit[g] += found[g] == times
        same = {c: pa.array(group.column(c).to_pylist()[:1] * len(count), group.schema.field(c).type) for c in ("term_id", "target_term", "m")}
        return pa.table(same | {"gram": pa.array(list(count), pa.string()), "count": pa.array(list(count.values()), pa.int64()), "fit": pa.array([fit[g] for g in count], pa.int64())})

    kept = chunked.groupBy("term_id", "target_term", "chunk").applyInArrow(often, f"term_id {kind}, gram string").distinct()
    wanted = kept.join(chunked.select("term_id", "chunk").distinct(), "term_id").select(F.col("term_id").alias("of_term"), F.col("chunk").alias("of_chunk"), "gram")
    counts = chunked.groupBy("term_id", "chunk").cogroup(wanted.groupBy("of_term", "of_chunk")).applyInArrow(exact, f"term_id {kind}, target_term string, m long, gram string, count long, fit long")
    summed = counts.groupBy("term_id", "target_term", "gram", "m").agg(F.sum("count").alias("count"), F.sum("fit").alias("fit"))
    return summed.where((F.col("count") / F.col("m") >= RECALL) | (F.col("gram") == F.col("target_term")))


def gram_documents(refs: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, df: in how many references (sample_id, ref_text) each of the grams stands.  Both meet in as many parts as there are cores, or more if a part would have over TEXTS references."""
    n = refs.count()
    parts = max(refs.sparkSession.sparkContext.defaultParallelism, -(-n // TEXTS))

    def counted(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        known, total = set(wanted.column("gram").to_pylist()), Counter()
        lengths: dict[str, set[int]] = {}
        for g in known:
            lengths.setdefault(g[:LEAST_GRAM], set()).add(len(g))
        for text in texts.column("ref_text").to_pylist():
            found = {r[i : i + k] for r in re.findall(f"{T.CJK}+", text) for i in range(len(r) - LEAST_GRAM + 1) for k in lengths.get(r[i : i + LEAST_GRAM], ()) if i + k <= len(r)}
            total.update(known & (found | set(re.findall(LATIN, text))))
        return pa.table({"gram": pa.array(list(total), pa.string()), "df": pa.array(list(total.values()), pa.int64())})

    placed = refs.select("ref_text", F.pmod(F.xxhash64("sample_id"), F.lit(parts)).alias("part"))
    sent = grams.withColumn("of_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return placed.groupBy("part").cogroup(sent.groupBy("of_part")).applyInArrow(counted, "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def associations(instances: DataFrame, refs: DataFrame) -> DataFrame:
    """term_id, gram, count, recall, precision, countfit, score, is_target of the forms that references have where a term stands in the source.

    instances: term_id, target_term, sample_id, times (how often the source has the term); refs: sample_id, ref_text, once each.
    Equal references of a term count once.  Grams are kept if often enough and mostly beside the term, without grammatical
    characters at the ends, and unless another kept gram of the term holds them and is no rarer.
    """
    summed = instances.join(refs.select("sample_id", "ref_text", F.md5("ref_text").alias("sum")), "sample_id").groupBy("term_id", "target_term", "sum")
    once = cut(summed.agg(F.min_by(F.struct("sample_id", "times", "ref_text"), F.struct("sample_id", "times")).alias("x")).select("term_id", "target_term", "x.*"))
    size = once.groupBy("term_id").agg(F.count("*").alias("m")).where(F.col("m") >= INSTANCES)
    per = cut(gram_counts(once.join(size, "term_id")))
    per = per.join(gram_documents(refs, per.select("gram").distinct()), "gram")
    rated = per.withColumn("recall", F.col("count") / F.col("m")).withColumn("precision", F.col("count") / F.col("df")).withColumn("countfit", F.col("fit") / F.col("m"))
    rated = cut(rated.withColumn("score", F.col("recall") * F.col("precision") * (0.5 + 0.5 * F.col("countfit"))))
    raw = rated.where((F.col("recall") >= RECALL) & (F.col("precision") >= PRECISION)).select("term_id", trimmed(F.col("gram")).alias("gram")).distinct().where(term_like(F.col("gram")))
    kept = rated.join(raw, ["term_id", "gram"], "left_semi").where((F.col("recall") >= RECALL) & (F.col("countfit") >= COUNTFIT))
    # of a term's few grams each that is part of another one, no rarer, is a fragment
    whole = kept.select("term_id", F.col("gram").alias("longer"), F.col("recall").alias("r"))
    fragments = kept.join(whole, "term_id").where((F.col("longer") != F.col("gram")) & F.contains("longer", "gram") & (F.col("recall") <= F.col("r") + 1e-9)).select("term_id", "gram").distinct()
    best = kept.join(fragments, ["term_id", "gram"], "left_anti")
    own = rated.where(F.col("gram") == F.col("target_term")).join(best.select("term_id", "gram"), ["term_id", "gram"], "left_anti")
    flag = lambda df, value: df.select("term_id", "target_term", "gram", "count", "recall", "precision", "countfit", "score", F.lit(value).alias("is_target"))
    return flag(best, False).union(flag(own, True))


def association_classes(found: DataFrame, instances: DataFrame, refs: DataFrame) -> DataFrame:
    """term_id, instances, target_recall, rival, rival_recall, kind: few (too few instances), agrees, conflicts or unverified, by the references alone."""
    once = instances.join(refs, "sample_id").groupBy("term_id", "target_term", F.md5("ref_text").alias("sum")).agg(F.max(F.contains("ref_text", "target_term").cast("int")).alias("has"), F.count("*").alias("k"))
    sizes = once.groupBy("term_id", "target_term").agg(F.sum("k").alias("instances"), F.avg("has").alias("target_recall"))
    others = found.where(~F.col("is_target") & ~F.contains("target_term", "gram") & ~F.contains("gram", "target_term"))
    rival = others.groupBy("term_id").agg(F.max_by(F.struct(F.col("gram").alias("rival"), F.col("recall").alias("rival_recall")), F.struct("score", "gram")).alias("x")).select("term_id", "x.*")
    joined = sizes.join(rival, "term_id", "left")
    beaten = F.coalesce(F.col("rival_recall") > F.col("target_recall") + MARGIN, F.lit(False))
    kind = F.when(F.col("instances") < INSTANCES, "few").when(beaten, "conflicts").when(F.col("target_recall") >= RECALL, "agrees").otherwise("unverified")
    return joined.select("term_id", "instances", "target_recall", "rival", "rival_recall", kind.alias("kind"))


def form_counts(instances: DataFrame, refs: DataFrame, document: DataFrame) -> DataFrame:
    """term_id, document_id, instances, with_target: in how many references beside a term its target stands, a document."""
    rows = instances.join(refs, "sample_id").join(document, "sample_id")
    return rows.groupBy("term_id", "document_id").agg(F.count("*").alias("instances"), F.count_if(F.contains("ref_text", "target_term")).alias("with_target"))


def verified_forms(forms: DataFrame, pairs: DataFrame, support: int = 2, precision: float = 0.8) -> DataFrame:
    """source_form, target_form, support, source_only, precision, accepted, evidence (the first sample) of forms that are said to translate each other.

    forms: source_form, target_form, head (the source form's first word); pairs: sample_id, source_text, ref_text."""
    words = pairs.select("sample_id", F.lower("source_text").alias("t"), "ref_text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("source_text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("head"))
    met = words.join(forms, "head").where(F.contains("t", F.lower("source_form")))
    both = F.contains("ref_text", "target_form")
    counts = met.groupBy("source_form", "target_form").agg(F.count_if(both).alias("support"), F.count_if(~both).alias("source_only"), F.min(F.when(both, F.col("sample_id"))).alias("evidence"))
    share = F.col("support") / (F.col("support") + F.col("source_only"))
    return counts.withColumn("precision", share).withColumn("accepted", (F.col("support") >= support) & (share >= precision))
