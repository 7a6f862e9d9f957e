"""Mining rule candidates from what is still unexplained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalise
from ledgerloom.operators.rules import Rule
from ledgerloom.session import checkpointed, held

#: Categories that a candidate's detail names.
DETAIL = 4

#: Words of payment rails, banks and company names that identify no merchant.
NOISE = (
    "upi imps neft rtgs debit credit payment paymen paid pay paying from for you are the and ref txn trf transfer pos xxxxx xxxx inr acct account bank banking net mob "
    "ltd limited pvt private india indian services service serv solutions technologies enterprises retail com atm branch request "
    "ybl utib yesb sbin ibl kkbk hdfc hdfcbank axl axis axisbank okpayaxis oksbi okaxis okhdfcbank okicici ptybl ptmupi yblupi cnrb punb barb ioba idib ubin icic icicibank sbi"
).split()


def is_noise(word: Column) -> Column:
    """Stop words and the shapes of handles and bank codes."""
    rail = word.startswith("@") | word.rlike("^([^@]{0,2}|[0-9]+)@") | word.rlike("^[a-z]{4}0")
    return word.isin(NOISE) | rail


def words(narration: Column) -> Column:
    return F.filter(F.split(normalise(narration), " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))


def tokens(narration: Column) -> Column:
    """Distinct single words that mean something, and neighbouring pairs of which one does."""
    all_ = words(narration)
    single = F.filter(all_, lambda w: ~is_noise(w))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_) - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(all_, i).alias("a"), F.try_element_at(all_, i + 1).alias("b")))
    good = F.filter(pairs, lambda p: p["b"].isNotNull() & ~(is_noise(p["a"]) & is_noise(p["b"])))
    return F.array_distinct(F.concat(single, F.transform(good, lambda p: F.concat_ws(" ", p["a"], p["b"]))))


def merchant_hint(narration: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(words(narration), lambda w: ~is_noise(w))), " ")


def support(unexplained: DataFrame, min_hits: int = 3) -> DataFrame:
    """``token, support`` over unexplained rows; tokens below ``min_hits`` are no candidates."""
    if not 2 <= min_hits <= 100:
        raise ValueError("min_hits must be 2 to 100")
    rows = unexplained.select("id", F.explode(tokens(F.col("narration"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("support"), F.count_distinct("id").alias("rows")).where(F.col("support") >= min_hits).select("token", "support")


def _lengths(wanted: DataFrame, column: str) -> Column:
    """The distinct word lengths of a column, as a literal array; a few dozen, whatever the ledger's size."""
    found = sorted(r.n for r in wanted.select(F.length(column).alias("n")).distinct().collect())
    return F.array(*map(F.lit, found)).cast("array<int>")


def occurrences(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``token, id`` for each row (``id, normal``) whose text contains the token, inside longer words too.

    A token is a word or two words with a blank between. Distinct words of the
    ledger meet tokens on equal pieces of the lengths that tokens have (of a pair:
    the end of one word and the start of the next), so all joins are on equality
    and the ledger is only joined with words that hold a token.
    """
    parts = F.split("normal", " ")
    single = wanted.where(~F.col("token").contains(" ")).select("token")
    double = wanted.where(F.col("token").contains(" ")).select("token", F.split_part("token", F.lit(" "), F.lit(1)).alias("a"), F.split_part("token", F.lit(" "), F.lit(2)).alias("b"))
    words_of = rows.select("id", F.explode(F.array_distinct(parts)).alias("word"))
    vocabulary = checkpointed(words_of.select("word").distinct())
    word, size = F.col("word"), F.length("word")
    fitting = lambda lengths: F.filter(lengths, lambda k: k <= size)

    inside = F.flatten(F.transform(fitting(_lengths(single, "token")), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substr(word, i, k))))
    holders = vocabulary.select("word", F.explode(F.array_distinct(inside)).alias("token")).join(single, "token")
    ends = vocabulary.select(word.alias("x"), F.explode(F.transform(fitting(_lengths(double, "a")), lambda k: F.substr(word, size - k + 1, k))).alias("a"))
    starts = vocabulary.select(word.alias("y"), F.explode(F.transform(fitting(_lengths(double, "b")), lambda k: F.substr(word, F.lit(1), k))).alias("b"))
    ends, starts = ends.join(double.select("a").distinct(), "a"), starts.join(double.select("b").distinct(), "b")

    next_to = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.element_at(parts, i).alias("x"), F.element_at(parts, i + 1).alias("y")))
    neighbours = rows.where(F.size(parts) > 1).select("id", F.explode(F.array_distinct(next_to)).alias("p")).select("id", "p.x", "p.y")
    joined = neighbours.select("x", "y").distinct().join(ends, "x").join(starts, "y").join(double, ["a", "b"]).select("x", "y", "token")
    return words_of.join(holders, "word").select("token", "id").unionByName(neighbours.join(joined, ["x", "y"]).select("token", "id")).distinct()


def _measured(ledger: DataFrame, allocations: DataFrame, rules: Sequence[Rule], min_hits: int, max_breadth: float) -> DataFrame:
    """What ``candidates`` returns, and two hash sums of each candidate's unexplained rows."""
    if not 2 <= min_hits <= 100:
        raise ValueError("min_hits must be 2 to 100")
    sums = allocations.groupBy(F.col("transaction_id").alias("id")).agg(F.sum("amount_paise").alias("explained"), F.collect_set("category_id").alias("used"))
    open_ = (F.col("amount_paise") != F.coalesce("explained", F.lit(0))).alias("open")
    caught = [rule.column().alias(f"rule_{i}") for i, rule in enumerate(rules)]
    used = F.coalesce("used", F.array().cast("array<bigint>")).alias("used")
    rows = held(ledger.join(sums, "id", "left").select("id", open_, used, normalise(F.col("narration")).alias("normal"), *caught))
    is_open, whole = F.col("open"), lambda test: F.count(F.when(test, 1))
    # Rows with one normal narration contain the same tokens: tokens meet each narration once, and sums are carried along.
    classes = rows.groupBy("normal").agg(
        F.count(F.when(is_open, F.col("id"))).alias("hits"), F.count("*").alias("ledger_hits"), whole(F.size("used") > 0).alias("explained_hits"), whole(is_open).alias("support"),
        F.sum(F.when(is_open, F.xxhash64("id").cast("decimal(38,0)"))).alias("x"), F.sum(F.when(is_open, F.hash("id").cast("decimal(38,0)"))).alias("y"),
        *(whole(is_open & F.col(f"rule_{i}")).alias(f"rule_{i}") for i in range(len(rules))),
    )
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    total = classes.agg(F.coalesce(F.sum("ledger_hits"), F.lit(0))).first()[0]
    wanted = classes.where("support > 0").select(F.explode(tokens(F.col("normal"))).alias("token"), "support")
    wanted = checkpointed(wanted.groupBy("token").agg(F.sum("support").alias("support")).where(F.col("support") >= min_hits))
    met = checkpointed(occurrences(classes, wanted))

    sums = ("hits", "ledger_hits", "explained_hits", "x", "y", *(f"rule_{i}" for i in range(len(rules))))
    base = met.join(classes.select("id", *sums), "id").groupBy("token").agg(*(F.sum(c).alias(c) for c in sums))
    base = base.withColumn("breadth", F.round(F.col("ledger_hits") / F.lit(max(total, 1)), 3)).where((F.col("hits") >= min_hits) & (F.col("ledger_hits") <= F.lit(max_breadth) * F.lit(total)))
    first_rule = F.coalesce(F.lit(None).cast("string"), *(F.when(F.col(f"rule_{i}") == F.col("hits"), F.lit(rule.name)) for i, rule in enumerate(rules)))

    used_by = rows.select("normal", F.explode("used").alias("category_id")).groupBy("normal", "category_id").agg(F.count("*").alias("count")).join(classes.select("normal", "id"), "normal")
    by_category = met.join(used_by, "id").groupBy("token", "category_id").agg(F.sum("count").alias("count"))
    by_category = by_category.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "category_id")))
    top = F.array_sort(F.collect_list(F.when(F.col("place") <= DETAIL, F.struct("place", "category_id", "count"))))
    spread = by_category.groupBy("token").agg(F.count("*").alias("spread"), F.transform(top, lambda d: F.struct(d["category_id"].alias("category_id"), d["count"].alias("count"))).alias("spread_detail"))
    found = base.withColumn("collides_with", first_rule).join(spread, "token", "left")
    return found.select("token", "hits", "ledger_hits", "breadth", "explained_hits", F.coalesce("spread", F.lit(0)).alias("spread"), "spread_detail", "collides_with", F.size(F.split("token", " ")).alias("words"), "x", "y")


def candidates(ledger: DataFrame, allocations: DataFrame, rules: Sequence[Rule] = (), min_hits: int = 3, max_breadth: float = 1.0) -> DataFrame:
    """Each candidate with all that a rule "narration contains it" would claim in the whole ledger.

    ``hits``: unexplained rows; ``ledger_hits`` and ``breadth``: all rows and their share; ``explained_hits``: rows with
    a category; ``spread``, ``spread_detail``: how many categories those have, and the four commonest with their counts;
    ``collides_with``: the first of ``rules`` that matches every unexplained hit.
    """
    return _measured(ledger, allocations, rules, min_hits, max_breadth).drop("x", "y")


def report(ledger: DataFrame, allocations: DataFrame, rules: Sequence[Rule] = (), min_hits: int = 3, max_breadth: float = 1.0, limit: int = 40) -> DataFrame:
    """The candidates to show; of those with the same unexplained rows only the one with the fewest words, then by name."""
    found = _measured(ledger, allocations, rules, min_hits, max_breadth)
    shown = [c for c in found.columns if c not in ("x", "y")]
    best = found.groupBy("hits", "x", "y").agg(F.min_by(F.struct(*shown), F.struct("words", "token")).alias("best"))
    return ranked(best.select("best.*"), limit)


def ranked(found: DataFrame, limit: int = 40) -> DataFrame:
    """The candidates to show: least spread, most hits, then by name."""
    return found.orderBy("spread", F.desc("hits"), "token").limit(limit)


def same_rows(tokened: DataFrame) -> DataFrame:
    """Of candidates that claim the same rows (``token, id``), the one with the fewest words.

    Row sets are compared by size and two hash sums, so no set is collected.
    """
    marks = tokened.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.sum(F.hash("id").cast("decimal(38,0)")).alias("y"))
    size = F.size(F.split("token", " "))
    return marks.groupBy("n", "x", "y").agg(F.min_by("token", F.struct(size.alias("w"), "token")).alias("token")).select("token", F.col("n").alias("hits"))


def covered(shown: DataFrame, ledger: DataFrame, allocations: DataFrame) -> DataFrame:
    """One row: unexplained rows, rows of the ledger, and how many unexplained ones some shown candidate (``token``) claims."""
    sums = allocations.groupBy(F.col("transaction_id").alias("id")).agg(F.sum("amount_paise").alias("explained"))
    rows = ledger.join(sums, "id", "left").select((F.col("amount_paise") != F.coalesce("explained", F.lit(0))).alias("open"), normalise(F.col("narration")).alias("normal"))
    classes = rows.groupBy("normal").agg(F.count(F.when(F.col("open"), 1)).alias("unexplained"), F.count("*").alias("ledger"))
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    claimed = occurrences(classes.where("unexplained > 0"), checkpointed(shown.select("token").distinct())).select("id").distinct()
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = classes.agg(sum_of("unexplained").alias("unexplained"), sum_of("ledger").alias("ledger"))
    return totals.join(classes.join(claimed, "id", "left_semi").agg(sum_of("unexplained").alias("covered")), F.lit(True))
