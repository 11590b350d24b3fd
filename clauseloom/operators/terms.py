"""Dictionary joins between texts and a termbase, term consistency and why it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as T

WORD = r"[\p{L}\p{N}_]"
EDGE, PART = "\ue0fd", "\x1f"
#: A source term of at most so many characters kept in an answer is an abbreviation taken over.
ABBREVIATION = 20


def _flat(name: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.lit(default))


def usable(termbase: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """Terms with both sides and one of the statuses (no status counts as active), once each; codes and levels in one spelling."""
    columns = [
        "term_id", T.language(F.col("source_lang")).alias("source_lang"), T.language(F.col("target_lang")).alias("target_lang"), _flat("priority").alias("priority"), _flat("status", "active").alias("status"),
        F.trim("source_term").alias("source_term"), F.trim("target_term").alias("target_term"), T.split_aliases(F.col("alias")).alias("aliases"),
    ]
    kept = termbase.select(*columns).where(F.col("status").isin(*statuses))
    return kept.where("coalesce(source_term, '') <> '' and coalesce(target_term, '') <> ''").distinct()


def spellings(terms: DataFrame) -> DataFrame:
    """term columns with w (a term or one of its aliases in lower case), matched_by, head (its first word, empty if it has none) and bounded."""
    listed = F.concat(F.array(F.struct(F.col("source_term").alias("matched_text"), F.lit(0).alias("is_alias"))), F.transform("aliases", lambda a: F.struct(a.alias("matched_text"), F.lit(1).alias("is_alias"))))
    rows = terms.withColumn("x", F.explode(listed)).select("*", "x.*").drop("x").withColumn("w", F.lower("matched_text"))
    bounded = F.left("w", F.lit(1)).rlike(r"[\p{L}\p{N}]") & F.right("w", F.lit(1)).rlike(r"[\p{L}\p{N}]")
    return rows.withColumn("bounded", bounded).withColumn("head", F.when(bounded, F.regexp_extract("w", f"{WORD}+", 0)).otherwise(F.lit("")))


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """sample_id, term_id, priority, order, is_alias, matched_text, first, last of every occurrence of a term or alias of the text's language.

    A term that begins and ends with a letter or figure occurs as whole words only.  Repeats that overlap themselves count
    once, as in a left-to-right scan.  Texts meet terms by a term's first word; which side is small enough to be sent
    around is left to the optimizer, which knows the sizes.
    """
    lower = texts.select("sample_id", "source_lang", F.lower("source_text").alias("t"))
    words = F.array_append(F.array_distinct(F.regexp_extract_all("t", F.lit(f"{WORD}+"), F.lit(0))), F.lit(""))
    met = lower.withColumn("head", F.explode(words)).join(spellings(terms), ["source_lang", "head"]).where(F.contains("t", "w"))
    spots = met.withColumn("p", F.split(F.replace("t", "w", F.lit(EDGE)), EDGE)).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    before = F.aggregate(F.slice("p", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    first = before + (F.col("i") - 1) * F.length("w")
    order = F.struct((-F.length("source_term")).alias("n"), F.col("term_id"))
    placed = spots.select("sample_id", "term_id", "priority", order.alias("order"), "is_alias", "matched_text", "bounded", "t", first.alias("first"), (first + F.length("w")).alias("last"))
    outside = r"^$|[^\p{L}\p{N}_]"
    left = F.when(F.col("first") == 0, True).otherwise(F.substring("t", F.col("first"), F.lit(1)).rlike(outside))
    right = F.substring("t", F.col("last") + 1, F.lit(1)).rlike(outside)
    return placed.where(~F.col("bounded") | (left & right)).drop("t", "bounded")


def longest(found: DataFrame) -> DataFrame:
    """Occurrences that no longer one contains; partly overlapping ones stay; of those at one place a term goes before an alias, then the longer term.

    What a rejected occurrence contains is contained in the one that rejects it, so this is the outcome of taking the longest first.
    """
    by_text = Window.partitionBy("sample_id")
    earlier = F.max("last").over(by_text.orderBy("first").rangeBetween(Window.unboundedPreceding, -1))
    same = F.max("last").over(Window.partitionBy("sample_id", "first"))
    kept = found.withColumn("e", earlier).withColumn("s", same).where((F.col("e").isNull() | (F.col("e") < F.col("last"))) & (F.col("s") == F.col("last"))).drop("e", "s")
    rank = F.row_number().over(Window.partitionBy("sample_id", "first", "last").orderBy("is_alias", "order"))
    return kept.withColumn("rank", rank).where("rank = 1").drop("rank")


def matched(found: DataFrame) -> DataFrame:
    """sample_id, term_id, priority, matched_text, matched_by: each term once, as its longest and then first occurrence matched it."""
    first = F.min_by(F.struct("matched_text", "is_alias", "priority"), F.struct(F.col("first") - F.col("last"), "is_alias", "first"))
    rows = found.groupBy("sample_id", "term_id").agg(first.alias("m"))
    return rows.select("sample_id", "term_id", "m.priority", "m.matched_text", F.when(F.col("m.is_alias") == 1, "alias").otherwise("source_term").alias("matched_by"))


def contains(hay: Column, hay_tight: Column, term: Column) -> Column:
    """Whether a term stands in a text, both in compatibility form: with letters or figures of ASCII in any case and with or without
    its spaces, else as it is.  hay, hay_tight: the text with white space as single spaces, and without any."""
    folded, tight = F.lower(F.regexp_replace(term, f"[{T.SPACES}]+", " ")), F.lower(F.regexp_replace(term, f"[{T.SPACES}]+", ""))
    loose = F.contains(F.lower(hay), folded) | F.contains(F.lower(hay_tight), tight)
    return (term != "") & F.when(term.rlike("[A-Za-z0-9]"), loose).otherwise(F.contains(hay, term))


def prepared(answers: DataFrame) -> DataFrame:
    """answers with h and tight, the answer in compatibility form without and with its white space taken out, and targets, the distinct required terms in that form."""
    joined = T.nfkc(F.array_join(F.coalesce("required_target_terms", F.array().cast("array<string>")), PART))
    targets = F.array_distinct(F.filter(F.transform(F.split(joined, PART), lambda x: F.trim(x)), lambda x: x != ""))
    rows = answers.withColumn("_h", T.nfkc(F.coalesce("hypothesis", F.lit("")))).withColumn("targets", targets)
    return rows.withColumn("h", F.regexp_replace("_h", f"[{T.SPACES}]+", " ")).withColumn("tight", F.regexp_replace("_h", f"[{T.SPACES}]+", "")).drop("_h")


def checked(answers: DataFrame) -> DataFrame:
    """sample_id, experiment_group, required, correct, missing (the targets left out), tcr, status of each answer against its required target terms."""
    rows = prepared(answers).withColumn("missing", F.filter("targets", lambda t: ~contains(F.col("h"), F.col("tight"), t)))
    n, wrong = F.size("targets"), F.size("missing")
    return rows.select(
        "sample_id", "experiment_group", n.alias("required"), (n - wrong).alias("correct"), F.array_join("missing", "|").alias("missing"),
        F.when(n > 0, F.round((n - wrong) * 100.0 / n, 4)).alias("tcr"),
        F.when(n <= 0, "no_terms").when(wrong == 0, "pass").otherwise("fail").alias("status"),
    )


def failure_kind(answer: Column, target: Column) -> Column:
    """missing_translation, partial (the target's first character occurs) or missing."""
    blank = F.coalesce(F.trim(answer), F.lit("")) == ""
    return F.when(blank, "missing_translation").when(F.contains(answer, F.substring(target, 1, 1)), "partial").otherwise("missing")


def own_aliases(source: Column, target: Column, aliases: Column) -> Column:
    """The aliases without the target and without repeats, and the source term itself where it is short enough to be an abbreviation."""
    kept = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a != target)
    # the first of equal spellings stays
    once = F.filter(kept, lambda a, i: F.array_position(F.transform(kept, lambda x: F.lower(x)), F.lower(a)) == i + 1)
    short = (source != "") & (source != target) & (F.length(source) <= ABBREVIATION) & ~F.exists(once, lambda a: F.lower(a) == F.lower(source))
    return F.when(short, F.array_append(once, source)).otherwise(once)


def partly(h: Column, tight: Column, target: Column) -> Column:
    """Whether a part of the target is there: a third of its Chinese characters in a row, two at least, or one of its words."""
    han = F.regexp_replace(target, "[^一-鿿]+", "")
    n = F.greatest(F.lit(2), F.floor(F.length(han) / 3).cast("int"))
    # a longer run that occurs holds one of this length
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(han) - n + 1, F.lit(1))), lambda i: F.substring(han, i, n))
    words = F.filter(F.split(target, r"[\s\-/()（）,，;；:：]+"), lambda w: F.length(w) >= 2)
    return ((F.length(han) >= 4) & F.exists(runs, lambda r: F.contains(h, r))) | F.exists(words, lambda w: contains(h, tight, w))


def failure_kinds(answers: DataFrame, terms: DataFrame) -> DataFrame:
    """sample_id, experiment_group, term_id, given, kind: why each failed term fails, as delivered and by rule: alias_only (an alias or the
    source's abbreviation instead of the target), partial, wrong_translation (the source term is kept) or missing."""
    by_id = terms.groupBy("term_id").agg(F.min_by("aliases", F.struct("source_lang", "source_term")).alias("aliases"))
    failed = prepared(answers.where(F.size("failed_terms") > 0)).select("sample_id", "experiment_group", "h", "tight", F.explode("failed_terms").alias("f"))
    rows = failed.select("sample_id", "experiment_group", "h", "tight", "f.*").join(by_id, "term_id", "left")
    source, target = F.coalesce(F.trim("source_term"), F.lit("")), F.coalesce(F.trim("required_target_term"), F.lit(""))
    instead = F.exists(own_aliases(source, target, F.col("aliases")), lambda a: contains(F.col("h"), F.col("tight"), a))
    kind = (
        F.when(instead, "alias_only")
        .when(partly(F.col("h"), F.col("tight"), target), "partial")
        .when(contains(F.col("h"), F.col("tight"), source), "wrong_translation")
        .otherwise("missing")
    )
    return rows.select("sample_id", "experiment_group", "term_id", F.col("error_type").alias("given"), kind.alias("kind"))


def tiers(rows: DataFrame) -> DataFrame:
    """sample_id with the numbers of hard, review and soft matched terms, and the distinct targets of the hard ones."""
    status = lambda x: F.lower(F.coalesce(F.nullif(x.status, F.lit("")), F.lit("active")))
    priority = lambda x: F.lower(F.coalesce(x.priority, F.lit("")))
    hard = F.filter("matched_terms", lambda x: (priority(x) == "high") & (status(x) == "active"))
    review = F.filter("matched_terms", lambda x: (status(x) == "review") | ((status(x) == "active") & (priority(x) == "medium")))
    soft = F.filter("matched_terms", lambda x: (priority(x) == "low") & (status(x) == "active"))
    targets = F.array_join(F.array_distinct(F.filter(F.transform(hard, lambda x: F.trim(x.target_term)), lambda t: t != "")), "|")
    return rows.select("sample_id", F.size(hard).alias("hard"), F.size(review).alias("review"), F.size(soft).alias("soft"), targets.alias("targets")).distinct()


def required(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """sample_id, experiment_group, origin, terms: the hard terms an answer must hold, distinct targets in order of their spelling.

    Listed targets that the termbase knows as hard and whose term or alias stands in the source go first (listed), else the hard
    terms that the source holds (recalled), else none.
    """
    hard = terms.where("priority = 'high' and status = 'active'")
    wanted = rows.select("sample_id", "experiment_group", "source_lang", F.lower("source_text").alias("t"), F.explode("required_target_terms").alias("target"))
    known = spellings(hard).select("source_lang", F.lower("target_term").alias("key"), "w")
    there = wanted.withColumn("key", F.lower(F.trim("target"))).join(known, ["source_lang", "key"]).where(F.contains("t", "w"))
    listed = there.groupBy("sample_id", "experiment_group").agg(F.array_sort(F.collect_set("target")).alias("listed"))
    texts = rows.select("sample_id", "source_lang", "source_text").dropDuplicates(["sample_id"]).where("source_text is not null")
    held = occurrences(texts, hard).select("sample_id", "term_id").distinct().join(hard.select("term_id", "target_term").distinct(), "term_id")
    recalled = held.groupBy("sample_id").agg(F.array_sort(F.collect_set("target_term")).alias("recalled"))
    joined = rows.select("sample_id", "experiment_group").join(listed, ["sample_id", "experiment_group"], "left").join(recalled, "sample_id", "left")
    origin = F.when(F.col("listed").isNotNull(), "listed").when(F.col("recalled").isNotNull(), "recalled").otherwise("none")
    return joined.select("sample_id", "experiment_group", origin.alias("origin"), F.array_join(F.coalesce("listed", "recalled", F.array().cast("array<string>")), "|").alias("terms"))


def with_requested(requested: DataFrame, local: DataFrame) -> DataFrame:
    """source_term, target_term, origin, conflict: a request's own terms, and the local ones whose source it doesn't name; conflict tells a requested target that differs from the local one."""
    flat = lambda df: df.select(F.trim("source_term").alias("source_term"), F.trim("target_term").alias("target_term"), F.lower(F.trim("source_term")).alias("key")).where("source_term <> '' and target_term <> ''")
    asked, ours = flat(requested).dropDuplicates(["key"]), flat(local)
    named = ours.groupBy("key").agg(F.collect_set("target_term").alias("known"))
    first = asked.join(named, "key", "left").select("source_term", "target_term", F.lit("request").alias("origin"), F.coalesce(~F.array_contains("known", F.col("target_term")), F.lit(False)).alias("conflict"))
    return first.union(ours.join(asked, "key", "left_anti").select("source_term", "target_term", F.lit("local"), F.lit(False)))


def rewritten(terms: DataFrame, retargets: DataFrame, aliases: DataFrame) -> DataFrame:
    """terms with new targets (term_id, target_term) and added aliases (term_id, alias); a term_id that isn't there is an error when the rows are made."""
    gone = retargets.select("term_id").union(aliases.select("term_id")).join(terms.select("term_id"), "term_id", "left_anti")
    checked_ids = gone.select(F.raise_error(F.concat(F.lit("no such term: "), F.col("term_id"))).cast("string").alias("term_id")).withColumn("x", F.lit(1)).where("term_id is null").select("term_id")
    added = aliases.groupBy("term_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ";").alias("more"))
    out = terms.join(retargets.select("term_id", F.col("target_term").alias("retarget")), "term_id", "left").join(added, "term_id", "left").join(checked_ids, "term_id", "left_anti")
    more = F.concat_ws(";", F.nullif("alias", F.lit("")), "more")
    return out.withColumn("target_term", F.coalesce("retarget", "target_term")).withColumn("alias", F.nullif(more, F.lit(""))).drop("retarget", "more")


def tolerant_impact(texts: DataFrame, terms: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """source_lang, exact, tolerant: (text, term) pairs found as they are, and found when the last word of a one-word term may take another ending.

    Both sides are reduced to a stem and joined by it.
    """
    words = texts.select("sample_id", "source_lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("source_text"), F.lit(f"{WORD}+"), F.lit(0)))).alias("word"))
    single = terms.select("term_id", "source_lang", F.lower("source_term").alias("w")).where(~F.col("w").rlike(r"[^\p{L}\p{N}_]")).distinct()
    a = words.withColumn("stem", T.stem(F.col("word"), suffixes))
    b = single.withColumn("stem", T.stem(F.col("w"), suffixes))
    pairs = a.join(b, ["source_lang", "stem"]).groupBy("source_lang", "sample_id", "term_id").agg(F.max((F.col("word") == F.col("w")).cast("int")).alias("exact"))
    return pairs.groupBy("source_lang").agg(F.sum("exact").alias("exact"), F.count("*").alias("tolerant"))
