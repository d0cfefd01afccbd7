"""Line deduplication by an exact set-similarity join. Built-in functions only.

A line is the set of its words. Words are ordered by rarity over the whole corpus, and two lines can
reach the wanted Jaccard similarity only if they share a word among the rarest few of each (the
prefix). Lines meet on prefix words; length, position and a parity sketch rule most pairs out before the
sets themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.llm.texts import pieces_of, words_of
from notecode.session import materialised

RARITY = 1 << 21  # counters of word frequency, a byte each; words share them by hash, which costs only selectivity
LONELY = 5  # frequency class of a word that occurs once in the whole corpus
HOT = 128  # a prefix word in more lines than this is met in rounds
_PART = 4096  # counters put together at once


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, line, content)``, one row for every line."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("all"))
    # there is always a first line; the outer form spares a filter that would split every text once more
    return rows.select("doc", F.posexplode_outer("all").alias("line", "content"))


def _grade(n: Column) -> Column:
    """The frequency class of a count. A count of 1 has ``LONELY``, every larger one a higher class."""
    return F.least(F.floor(F.log2(n + 1) * 4) + 1, F.lit(126)).cast("byte")


def _rarity(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: an array with a byte for every counter, its frequency class (quarters of a power of two, 1 to 126)."""
    words = docs.select(F.explode_outer(pieces_of(F.col(text_col))).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(RARITY - 1)).alias("id")).agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(RARITY).join(counts, "id", "left").select("id", _grade(F.coalesce("n", F.lit(0))).alias("grade"))
    in_order = lambda rows, name: F.transform(F.sort_array(F.collect_list(rows)), lambda x: x[name])
    parts = every.groupBy(F.floor(F.col("id") / _PART).alias("id")).agg(in_order(F.struct("id", "grade"), "grade").alias("grades"))
    return parts.agg(F.flatten(in_order(F.struct("id", "grades"), "grades")).alias("grades"))


def _ranked(words: Column, grades: Column) -> Column:
    """Distinct words as sorted numbers, rarest first: frequency class in the top byte, then 56 bits of hash."""

    def rank(h: Column) -> Column:
        grade = F.get(grades, h.bitwiseAND(F.lit(RARITY - 1)).cast("int")).cast("long")
        return F.shiftleft(grade, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.array_distinct(F.transform(words, lambda word: F.xxhash64(word)))
    return F.sort_array(F.array_distinct(F.transform(hashes, rank)))


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """The smallest overlap with which sets of n and m words have the similarity."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90) -> DataFrame:
    """``(doc, line)`` of every line for which an earlier one has a Jaccard similarity of ``percent`` %.

    Lines are numbered from 0 within their document and earlier by (document, number). All lines are
    judged against all earlier ones of the input, whether those stay or not. Lines without words are
    never similar to anything.

    Lines with equal sets form a class, of which all but the first are similar to an earlier line; from
    there on a class is one row. A prefix word that more than ``HOT`` classes share first meets only the
    first of them. A group of n near copies is settled by that in n comparisons; what is not settled
    then meets all earlier classes of that word.
    """
    spark = docs.sparkSession
    grades = materialised(_rarity(docs, text_col), "rarity")
    lines = _lines(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    # the optimiser puts the one value of the subquery into the expression: it is in no row
    lines = lines.select("doc", "line", "content", grades.scalar().alias("grades"))
    ranked = lines.select("doc", "line", _ranked(words_of(F.col("content")), F.col("grades")).alias("ranks"))
    n = F.size("ranks")
    length = n - F.ceil(n * F.lit(percent) / 100 - F.lit(1e-9)).cast("int") + 1
    # a word that occurs once meets nothing; such words are the rarest, so they are the first ones
    social = F.filter(F.slice("ranks", F.lit(1), length), lambda x: F.shiftrightunsigned(x, 56) > LONELY)
    one = F.lit(1).cast("long")
    parity = F.aggregate("ranks", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))
    described = ranked.select(
        "doc",
        "line",
        n.alias("n"),
        F.xxhash64("ranks").alias("set_a"),
        F.xxhash64(F.lit(1), F.col("ranks")).alias("set_b"),
        parity.alias("parity"),
        social.alias("prefix"),
        length.alias("length"),
    )
    described = described.withColumn("skipped", F.col("length") - F.size("prefix")).drop("length")
    # written once: the classes and, at the end, their copies come from it; blank lines are left out of both
    described = materialised(described, "described").filter("n > 0")
    first = F.min(F.struct("doc", "line", "n", "parity", "skipped", "prefix")).alias("first")
    classes = materialised(described.groupBy("set_a", "set_b").agg(first, F.count("*").alias("copies")), "classes")

    keys = classes.select("first.doc", "first.line", "first.n", "first.parity", "first.skipped", F.posexplode("first.prefix").alias("at", "word"))
    keys = keys.withColumn("at", F.col("at") + F.col("skipped")).drop("skipped").repartition("word")
    entry = F.struct("doc", "line", "n", "at", "parity")
    met = keys.groupBy("word").agg(F.count("*").alias("c"), F.min(entry).alias("lead")).filter("c > 1")
    x, y = F.col("x"), F.col("y")
    need = _least_shared(x["n"], y["n"], percent)
    room = F.lit(1) + F.least(x["n"] - x["at"], y["n"] - y["at"]) - 1
    fits = (
        ((x["doc"] < y["doc"]) | ((x["doc"] == y["doc"]) & (x["line"] < y["line"])))
        & (x["n"] * 100 >= y["n"] * percent)
        & (y["n"] * 100 >= x["n"] * percent)
        & (room >= need)
        & (F.bit_count(x["parity"].bitwiseXOR(y["parity"])) <= x["n"] + y["n"] - need * 2)
    )
    members = keys.select("word", entry.alias("y"))
    cold, hot = met.filter(F.col("c") <= HOT).select("word"), met.filter(F.col("c") > HOT)
    some = members.join(cold, "word", "left_semi")
    pairs = some.select("word", F.col("y").alias("x")).join(some, "word").filter(fits).select("x", "y", F.lit(None).cast("long").alias("word"))
    led = members.join(hot.select("word", F.col("lead").alias("x")), "word").filter(fits).select("x", "y", F.lit(None).cast("long").alias("word"))
    open_ = members.join(hot.select("word"), "word", "left_semi").select(F.lit(None).cast(members.schema["y"].dataType).alias("x"), "y", "word")
    met = materialised(pairs.union(led).union(open_), "met")

    def verified(pairs: DataFrame) -> DataFrame:
        """The later lines of the pairs ``(x, y)`` whose word sets are similar indeed."""
        pairs = materialised(pairs.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("doc", "line")]).distinct(), "pairs")
        wanted = pairs.select(F.col("x_doc").alias("doc"), F.col("x_line").alias("line")).union(pairs.select("y_doc", "y_line")).distinct()
        numbers = wanted.groupBy("doc").agg(F.collect_set("line").alias("numbers"))
        held = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(numbers, "doc")
        # the wanted lines of a text are cut out beside it: whole texts move once, other lines not at all
        numbered = F.transform(F.split("text", "\n"), lambda content, k: F.struct(k.alias("line"), content.alias("content")))
        chosen = F.filter(numbered, lambda x: F.array_contains("numbers", x["line"]))
        sets = held.select("doc", F.explode(chosen).alias("one")).select("doc", "one.line", "one.content").dropDuplicates(["doc", "line"])
        sets = sets.select("doc", "line", F.array_distinct(words_of(F.col("content"))).alias("words"))
        sets = materialised(sets, "sets")
        a = sets.select(F.col("doc").alias("x_doc"), F.col("line").alias("x_line"), F.col("words").alias("x_words"))
        b = sets.select(F.col("doc").alias("y_doc"), F.col("line").alias("y_line"), F.col("words").alias("y_words"))
        both = pairs.join(a, ["x_doc", "x_line"]).join(b, ["y_doc", "y_line"])
        shared = F.size(F.array_intersect("x_words", "y_words"))
        union = F.size("x_words") + F.size("y_words") - shared
        return both.filter(shared * 100 >= union * percent).select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line")).distinct()

    settled = materialised(verified(met.filter("x IS NOT NULL")), "settled")
    rest = met.filter("x IS NULL").select("word", "y")
    left = rest.join(settled, [F.col("y.doc") == F.col("doc"), F.col("y.line") == F.col("line")], "left_anti")
    late = left.join(rest.select("word", F.col("y").alias("x")), "word").filter(fits).select("x", "y")
    late = materialised(late, "late")
    similar = settled if late.isEmpty() else settled.union(verified(late)).distinct()
    copies = described.select("doc", "line", "set_a", "set_b").join(
        classes.filter("copies > 1").select("set_a", "set_b", "first.doc", "first.line").withColumnsRenamed({"doc": "d", "line": "l"}), ["set_a", "set_b"]
    )
    copies = copies.filter("doc <> d OR line <> l").select("doc", "line")
    return materialised(copies.union(similar).distinct(), "similar")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90) -> DataFrame:
    """``(doc_id, n_lines, removed)`` for each input row: its lines and the numbers of those to remove.

    A line goes if an earlier line has a Jaccard similarity of ``percent`` % (see ``similar_lines``); an
    empty or null text has one line, without words, and keeps it. Rows with a null id keep all lines
    and make no other line go. Rows repeated with their id are one document: they lose the same lines,
    but none to each other. Other columns are ignored; an empty table gives no rows.
    """
    gone = similar_lines(docs, id_col, text_col, percent).groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long").alias("n_lines"))
    rows = rows.join(gone, F.col("doc_id").cast("long") == F.col("doc"), "left")
    return rows.select("doc_id", "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """A text without the lines of these numbers; null stays null."""
    kept = F.filter(F.split(text, "\n"), lambda line, k: ~F.array_contains(removed, k))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))
