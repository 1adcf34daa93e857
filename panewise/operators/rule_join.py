"""Rules as a table: the join of texts with any number of patterns.

The detectors' own catalogues are expressions, one branch for each rule. A catalogue of thousands
of rules, or one that a user keeps in a table, is joined instead. A rule is a row of ``rule``,
``pattern``, ``groups`` (their number), ``hints`` (lower-case fragments of which a match holds one
at least) and ``needs`` (of which it holds all).

Rules and texts meet on q-grams. Of each fragment the index holds one q-gram, the one that the
fewest texts hold; a rule with needs is entered by its needs alone, as they must all be there. The
distinct q-grams of a text are joined with the index by equality, so a pattern runs only on the
texts that hold the q-grams of its fragments, and no plan compares every text with every rule.
Rules without a fragment of Q characters are entered under the empty gram, which every text has.
The number of rules is rows, not plan: the plan is the same for ten rules and for ten thousand.

A text's candidates come back to it as one array, bounded by the catalogue, and its patterns run
inside one projection. So a text is moved once, whatever the number of its rules. Texts without a
candidate are not moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqlexpr import F as X
from ..functions.text import CLOSE, FIELD, OPEN, clean_marks, matches
from ..rules.vulns import Rule
from ..session import work_folder, written

#: Characters of a gram, and of the parts that a text's grams are taken from.
Q, PART = 4, 4096
#: Rows of an index that may be broadcast; larger ones are joined by a shuffle.
FEW_GRAMS = 1 << 17

RULES = "rule string, pattern string, groups int, hints array<string>, needs array<string>"


def rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A catalogue of the package as a table of rules."""
    rows = [(r.id, "(?dU)" + r.pattern, r.groups, list(r.hints), list(r.needs)) for r in rules]
    return spark.createDataFrame(rows, RULES)


def grams_of(text: Column) -> Column:
    """The distinct q-grams of a short text, found in one pass by a look-ahead of Q characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{" + str(Q) + "}))"), F.lit(1)))


def gram_shape(known: DataFrame) -> DataFrame:
    """One row, ``shape``: a pattern of the texts that hold a known gram's characters place by place.
    Most grams of prose do not fit it and are never cut out."""
    def one_of(place: int) -> Column:
        chars = F.array_sort(F.collect_set(F.substring("gram", place, 1)))
        codes = F.transform(chars, lambda c: F.concat(F.lit("\\x{"), F.hex(F.ascii(c)), F.lit("}")))
        return F.concat(F.lit("["), F.array_join(codes, ""), F.lit("]"))

    whole = F.concat(F.lit("(?=("), *[one_of(place) for place in range(1, Q + 1)], F.lit("))"))
    grams = known.where(F.length("gram") == Q)
    return grams.agg(F.when(F.count("*") > 0, whole).otherwise(F.lit("(?!)()")).alias("shape"))


def gram_rows(texts: DataFrame, keys: Sequence[str], text: Column, known: DataFrame) -> DataFrame:
    """(*keys, gram): the q-grams of each text that may be known, some of them repeated, and the empty
    one. Rows come from parts of the text, so no array is as long as a text."""
    overlap = "(?s)(?=(.{1," + str(PART + Q - 1) + "})).{1," + str(PART) + "}"
    parts = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(overlap), F.lit(1)))
    rows = texts.select(*keys, F.explode(parts).alias("part")).crossJoin(F.broadcast(gram_shape(known)))
    grams = F.array_distinct(F.regexp_extract_all("part", F.col("shape"), F.lit(1)))
    return rows.select(*keys, F.explode(F.when(F.col("part") == "", F.array(F.lit(""))).otherwise(grams)).alias("gram"))


def _fragments(rules: DataFrame) -> DataFrame:
    """(rule, part, every, gram): the q-grams of each fragment that a rule is entered by. ``every``
    is the number of a rule's fragments that must be there: all its needs, or one of its hints."""
    needs = F.filter("needs", lambda x: F.length(x) >= Q)
    long = F.forall("hints", lambda x: F.length(x) >= Q) & (F.size("hints") > 0)
    parts = F.when(F.size(needs) > 0, needs).when(long, F.col("hints")).otherwise(F.array(F.lit("")))
    every = F.when(F.size(needs) > 0, F.size(F.array_distinct(needs))).otherwise(1)
    rows = rules.select("rule", every.alias("every"), F.explode(F.array_distinct(parts)).alias("part"))
    return rows.select("rule", "every", "part", F.explode(F.when(F.col("part") == "", F.array(F.lit(""))).otherwise(grams_of(F.col("part")))).alias("gram"))


def _small(index: DataFrame) -> DataFrame:
    return F.broadcast(index) if index.count() <= FEW_GRAMS else index


def candidates(texts: DataFrame, rules: DataFrame, keys: Sequence[str], text: str = "code") -> DataFrame:
    """(*keys, rules): for each text that may match any, an array of (rule, pattern, groups). No
    rule that matches is missing; hints and needs hold in each of them."""
    spark = texts.sparkSession
    fragments = written(_fragments(rules), work_folder(spark, "rule-fragments"))
    known = fragments.select("gram").distinct()
    present = gram_rows(texts, keys, F.lower(F.col(text)), known).join(_small(known), "gram", "left_semi").distinct()
    present = written(present, work_folder(spark, "rule-grams"))

    counts = present.groupBy("gram").count()
    rarest = F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram"))
    index = fragments.join(counts, "gram", "left").groupBy("rule", "every", "part").agg(rarest.alias("gram"))
    index = written(index, work_folder(spark, "rule-index"))
    pairs = present.join(_small(index), "gram").groupBy(*keys, "rule", "every").agg(F.count("*").alias("parts"))
    pairs = pairs.where(F.col("parts") >= F.col("every")).select(*keys, "rule")
    one = F.struct("rule", "pattern", "groups", "hints", "needs")
    return pairs.join(rules, "rule").groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("rules"))


def rule_hits(texts: DataFrame, rules: DataFrame, keys: Sequence[str], text: str = "code") -> DataFrame:
    """One row of each match of each rule: *keys, rule, start, stop, text and groups.

    Matches of one rule do not overlap; start and stop are characters from 0. Rules that hold no
    fragment run on all texts. Null texts and rules without a pattern give no rows, equal rules
    are one, and an empty table of either kind gives no rows.
    """
    rules = rules.where("rule is not null and pattern is not null").dropDuplicates(["rule"]).select(
        "rule", "pattern", F.coalesce("groups", F.lit(0)).alias("groups"),
        *(F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("hints", "needs")),
    )
    texts = texts.where(F.col(text).isNotNull()).select(*keys, clean_marks(X.col(text)).alias("code"))
    found = candidates(texts, rules, keys).withColumnRenamed("rules", "wanted")
    rows = texts.join(found, list(keys)).withColumn("lowered", F.lower("code"))

    def may(rule: Column) -> Column:
        hinted = F.exists(rule["hints"], lambda h: F.col("lowered").contains(h)) | (F.size(rule["hints"]) == 0)
        return hinted & F.forall(rule["needs"], lambda n: F.col("lowered").contains(n))

    def marked(rule: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.greatest(rule["groups"], F.lit(1)))
        more = F.array_join(F.transform(numbers, lambda g: F.concat(F.lit(FIELD + "$"), g.cast("string"))), "")
        emit = F.concat(F.lit(OPEN + "$0"), F.when(rule["groups"] > 0, more).otherwise(""), F.lit(CLOSE))
        return F.struct(rule["rule"].alias("rule"), F.regexp_replace(F.col("code"), rule["pattern"], emit).alias("marked"))

    # one row for each rule with a match, then one for each match
    wanted = F.filter(F.transform(F.filter("wanted", may), marked), lambda r: r["marked"].contains(OPEN))
    rows = rows.select(*keys, F.explode(wanted).alias("r")).select(*keys, "r.rule", "r.marked")
    hits = matches(
        X.col("marked"),
        lambda f: X.length(f[0]),
        lambda start, f: X.struct(
            start.alias("start"), (start + X.length(f[0])).alias("stop"), f[0].alias("text"),
            X.slice(f, X.lit(2), X.greatest(X.size(f) - 1, X.lit(0))).alias("groups"),
        ),
    )
    return rows.select(*keys, "rule", F.inline(hits))
