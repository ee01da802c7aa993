"""Matching of recognised texts against a catalog: the call-number cascade and its older and simpler relatives.

``catalog`` is a table (call, title, ord), ``ord`` its order. Texts are matched once however often they occur, in
stages of equi-joins; a similarity is only ever computed for pairs that a join has produced. Results have one row
for each distinct text: (read, call, score, stage); call and score are independent, a null call may have a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import SUBSTRING_WEIGHT, blend, matching_ratio, title_blend
from ..llm.core import stash

PAIR = f"([0-9]{{3}}(?:[.][0-9]+)?)([{text.SYLLABLES}][0-9]{{1,3}}[{text.SYLLABLES}{text.CONSONANTS}0Oo]?)"
AUTHOR = f"[{text.SYLLABLES}][0-9]{{2,3}}[{text.SYLLABLES}{text.CONSONANTS}]?"
CLASS = "[0-9]{3}(?:[.][0-9]+)?"
KEPT_OUT = f"[^0-9A-Za-z{text.SYLLABLES}{text.CONSONANTS}{text.VOWELS}.]"
CLASS_ALIKE, AUTHOR_ENOUGH, AUTHOR_MARGIN = 0.7, 0.75, 0.05


def prepared(catalog: DataFrame) -> DataFrame:
    """(call, cls, author, title, ord): calls without copy suffixes that have a class and an author."""
    call = text.without_copy("call")
    parts = F.split(call, "-")
    rows = catalog.where(F.size(parts) >= 2)
    return rows.select(call.alias("call"), text.class_of(F.get(parts, 0)).alias("cls"), text.mark_text(F.trim(F.get(parts, 1))).alias("author"), "title", "ord")


def _picked(hit: Column, n: Column | None = None) -> list[Column]:
    """Aggregates over candidate rows (call, volume), each for ``n`` books: how many hits, and what their volume or their common call number picks."""
    n = F.lit(1).cast("long") if n is None else n
    own = F.regexp_extract(F.element_at(F.split("call", "-"), -1), "^[vV]?[.]?([0-9]+)$", 1)
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    same = hit & (F.col("volume") != "") & (own != "") & (bare(own) == bare(F.col("volume"))) & (F.length(own) >= F.length("volume"))
    count = lambda rows: F.sum(F.when(rows, n).otherwise(F.lit(0).cast("long")))
    call = F.when(hit, F.col("call"))
    chosen = F.when(count(same) == 1, F.min(F.when(same, F.col("call")))).when(F.min(call) == F.max(call), F.min(call))
    return [count(hit).alias("hits"), chosen.alias("picked")]


def match_call(reads: DataFrame, catalog: DataFrame, strict_class: bool = True, surgery: bool = True) -> DataFrame:
    """The cascade: class and author exactly, a misread first character, a similar author; without a known class the author alone.

    ``strict_class``: a match by the author alone needs a class number in the text that resembles the book's, if a class
    with an author was read. ``surgery`` off is the older form: volume tokens stay and first characters aren't rescued.
    Null texts match nothing (score 0.0). What a class, a mark and a volume mean is the same for all texts that have them, so
    it is found once for each; books of one call number are one row with their count.
    """
    items = prepared(catalog)
    books = items.groupBy("cls", "author", "call").agg(F.count("*").alias("n"))
    classes = items.select("cls").distinct()
    distinct = reads.select("read").distinct()
    raw = F.coalesce("read", F.lit(""))
    plain = text.mark_text(F.regexp_replace(raw, text.VOLUME, " ") if surgery else raw)
    base = distinct.select("read", plain.alias("t"), F.regexp_extract(raw, text.VOLUME, 1).alias("volume"))
    pairs = F.arrays_zip(F.regexp_extract_all("t", F.lit(PAIR), F.lit(1)).alias("cls"), F.regexp_extract_all("t", F.lit(PAIR), F.lit(2)).alias("mark"))
    at = base.select("read", "t", "volume", F.posexplode_outer(pairs).alias("at", "p")).select("read", "t", "volume", "at", "p.cls", "p.mark")
    at = at.join(classes.select("cls", F.lit(True).alias("known")), "cls", "left")
    seen = at.groupBy("read", "t", "volume").agg(F.min(F.when(F.col("known"), F.struct("at", "cls", "mark"))).alias("m"), F.coalesce(F.max(F.col("at").isNotNull()), F.lit(False)).alias("saw"))
    first = seen.where("m is not null").select("read", "m.cls", "m.mark", "volume")
    rest = seen.where("m is null").select("read", "t", "volume", "saw")

    # The class is known: books with the mark or what it means, or with the mark but for its first character.
    tail = lambda c: F.expr(f"substr({c}, 2)")
    head = lambda c: F.substring(c, 1, 1)
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    with_tails = lambda keys, c: F.concat(keys, F.array(key("tail", tail(c)))) if surgery else keys
    probes = first.select("cls", "mark", "volume").distinct().withColumn("key", F.explode(with_tails(F.transform(text.variants(F.col("mark")), lambda v: key("whole", v)), "mark")))
    keyed = books.withColumn("key", F.explode(with_tails(F.array(key("whole", F.col("author"))), "author")))
    flat = lambda t: t.select(*(c for c in t.columns if c != "key"), "key.kind", "key.value")
    rows = flat(probes).join(flat(keyed), ["cls", "kind", "value"]).where((F.col("kind") == "whole") | (head("author") != head("mark")))
    exact, rescue = F.col("kind") == "whole", F.col("kind") == "tail"
    one = F.min(F.when(rescue, F.col("author"))) == F.max(F.when(rescue, F.col("author")))
    hits, picked = _picked(exact, F.col("n"))
    found = rows.groupBy("cls", "mark", "volume").agg(hits, picked, F.when(one, _picked(rescue, F.col("n"))[1]).alias("rescued"))
    known = first.join(found, ["cls", "mark", "volume"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))

    # None of these: the authors of the class that begin alike.
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    fits = ~((F.length(digits(F.col("mark"))) == F.length(digits(F.col("author")))) & (digits(F.col("mark")) != digits(F.col("author"))))
    open_ = known.where("hits = 0 and rescued is null").select("cls", "mark").distinct().withColumn("head", head("mark"))
    authors = items.groupBy("cls", "author").agg(F.count_distinct(F.struct("ord", "call")).alias("n"), F.max(F.struct("ord", "call")).alias("book")).withColumn("head", head("author"))
    alike = open_.join(authors, ["cls", "head"]).where(fits)
    meant = F.explode(text.variants(F.col("mark"))).alias("v")
    unique = alike.select("mark", "author").distinct().select("mark", "author", meant).withColumn("s", matching_ratio("v", "author"))
    scores = unique.groupBy("mark", "author").agg(F.max("s").alias("s"))
    levels = alike.join(scores, ["mark", "author"]).groupBy("cls", "mark", "s").agg(F.sum("n").alias("n"), F.max("book").alias("book"))
    best = levels.groupBy("cls", "mark").agg(F.max(F.struct("s", "n", "book")).alias("b"), F.sort_array(F.collect_list("s"), asc=False).alias("all"))
    best = best.select("cls", "mark", F.col("b.s").alias("top"), F.when(F.col("b.n") > 1, F.col("b.s")).otherwise(F.get("all", F.lit(1))).alias("next"), F.col("b.book.call").alias("best"))
    sure = (F.col("top") >= AUTHOR_ENOUGH) & (F.col("next").isNull() | (F.col("top") - F.col("next") >= AUTHOR_MARGIN))
    decided = known.join(best, ["cls", "mark"], "left").select(
        "read",
        F.when(F.col("hits") > 0, F.col("picked")).when(F.col("rescued").isNotNull(), F.col("rescued")).when(sure, F.col("best")).alias("call"),
        F.when(F.col("hits") > 0, 1.0).when(F.col("rescued").isNotNull(), 0.95).otherwise(F.coalesce("top", F.lit(0.0))).alias("score"),
        F.when(F.col("hits") > 0, "exact").when(F.col("rescued").isNotNull(), "first character").otherwise("similar").alias("stage"),
    )

    # No known class: every author-like token over the whole catalog; the last accepted one wins.
    words = rest.select("read", "volume", F.posexplode(F.regexp_extract_all("t", F.lit(f"({AUTHOR})"), F.lit(1))).alias("at", "mark")).where(F.length("mark") >= 4)
    asked = words.select("mark", "volume").distinct().select("mark", "volume", F.explode(text.variants(F.col("mark"))).alias("author"))
    accepted = asked.join(books, "author").groupBy("mark", "volume").agg(*_picked(F.lit(True), F.col("n"))).where("picked is not null")
    last = words.join(accepted, ["mark", "volume"]).groupBy("read").agg(F.max_by("picked", "at").alias("call"))
    if strict_class:
        numbers = rest.where("saw").select("read", F.explode(F.regexp_extract_all(F.coalesce("read", F.lit("")), F.lit(f"({CLASS})"), F.lit(1))).alias("number"))
        near = numbers.join(last, "read").join(books.select("call", F.col("cls").alias("own")), "call").select("read", "number", "own")
        alike = near.select("number", "own").distinct().withColumn("s", matching_ratio("number", "own")).where(F.col("s") >= CLASS_ALIKE)
        good = near.join(alike, ["number", "own"]).select("read").distinct().withColumn("good", F.lit(True))
        last = last.join(rest.select("read", "saw"), "read").join(good, "read", "left").where(~F.col("saw") | F.col("good")).select("read", "call")
    alone = rest.select("read").join(last, "read", "left").select("read", "call", F.when(F.col("call").isNotNull(), 0.9).otherwise(0.0).alias("score"), F.lit("author").alias("stage"))
    return decided.unionByName(alone)


def _best_two(scores: DataFrame) -> DataFrame:
    """(read, call, top, next) of (read, call, ord, s): the best row, the first of equal ones, and the second score."""
    ranked = scores.groupBy("read").agg(F.sort_array(F.collect_list("s"), asc=False).alias("all"), F.max_by("call", F.struct("s", -F.col("ord"))).alias("call"))
    return ranked.select("read", "call", F.get("all", F.lit(0)).alias("top"), F.coalesce(F.get("all", F.lit(1)), F.lit(0.0)).alias("next"))


def grams(value: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters; a shorter text is one run."""
    return F.when(F.length(value) <= n, F.array(value)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value) - n + 1), lambda i: F.substring(value, i, F.lit(n)))))


def contained(a: DataFrame, b: DataFrame, n: int = 7) -> DataFrame:
    """(x, y) of texts x of ``a`` and y of ``b``, not empty, one of which contains the other.

    The shorter text's first run of ``n`` characters is among the longer one's runs, which is what is joined; a text shorter than
    that is among the runs of its own length. Runs of a class number would be shared by all books of the class.
    """

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        probes = short.select(F.col("v").alias("s"), F.substring("v", 1, n).alias("gram")).where(f"length(s) >= {n}")
        found = probes.join(long.where(f"length(v) >= {n}").select(F.col("v").alias("l"), F.explode(grams(F.col("v"), n)).alias("gram")), "gram").where(F.contains("l", "s")).select("s", "l")
        tiny = short.where(f"length(v) < {n}").select(F.col("v").alias("s"), F.length("v").alias("k"))
        lengths = F.broadcast(tiny.select("k").distinct())  # less than n rows
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("l") - F.col("k") + 1), lambda i: F.substring(F.col("l"), i, F.col("k"))))
        pieces = long.select(F.col("v").alias("l"), F.explode(F.sequence(F.lit(1), F.least(F.length("v"), F.lit(n - 1)))).alias("k")).join(lengths, "k").select("l", F.explode(runs).alias("s"))
        return found.union(tiny.select("s").join(pieces, "s").select("s", "l"))

    a, b = (t.toDF("v").where("v <> ''").distinct() for t in (a, b))
    return inside(a, b).select(F.col("s").alias("x"), F.col("l").alias("y")).union(inside(b, a).select(F.col("l").alias("x"), F.col("s").alias("y"))).distinct()


def match_containment(reads: DataFrame, catalog: DataFrame) -> DataFrame:
    """(read, call, candidates): texts whose normal form contains a catalog row's or lies in it; the call only if the row is unique."""
    left = reads.select("read").distinct().withColumn("x", text.norm("read")).where("x <> ''")
    right = catalog.select("call", "ord", text.norm("call").alias("y"))
    pairs = contained(left.select("x"), right.select("y"))
    found = left.join(pairs, "x").join(right, "y").groupBy("read").agg(F.count("*").alias("candidates"), F.min("call").alias("call"))
    return found.select("read", F.when(F.col("candidates") == 1, F.col("call")).alias("call"), "candidates")


def match_catalog(reads: DataFrame, catalog: DataFrame) -> DataFrame:
    """The second version: containment, then the class alone if unique (0.9), then the author within the class, then the whole text.

    Within a class and over the whole catalog a text is first held against what shares its longer runs (``_nearest``), and its result is that of all pairs.
    """
    left = stash(reads.select("read").distinct().withColumns({"x": text.norm("read"), "p": text.loose_call("read")}).where("x <> ''"), "reads")
    right = stash(catalog.select("call", "ord", text.norm("call").alias("y"), text.loose_call("call").alias("q")), "catalog")
    found = stash(match_containment(left, catalog), "contained")
    one = found.select("read", "call", F.when(F.col("candidates") == 1, 1.0).otherwise(0.5).alias("score"), F.lit("containment").alias("stage"))
    rest = stash(left.join(found, "read", "left_anti").select("read", "x", "p.cls", "p.author"), "rest")
    # What an author means in a class, or a text in the whole catalog, is the same for all readings, so it is found once for each.
    classes = right.groupBy("q.cls").agg(F.count("*").alias("rows"), F.min("call").alias("only"))
    by_class = rest.join(classes, "cls")
    books = right.select(F.col("q.cls").alias("cls"), F.col("q.author").alias("b"), "call", "ord")
    best = _nearest(by_class.where("rows > 1 and author <> ''").select("cls", F.col("author").alias("a")), books, ["cls"], (4, 3, 2, 0), 0.5, 2.0, 0.15)
    two = by_class.join(best.withColumnRenamed("a", "author"), ["cls", "author"], "left").select(
        "read",
        F.when(F.col("rows") == 1, F.col("only")).otherwise(F.col("call")).alias("call"),
        F.when(F.col("rows") == 1, 0.9).when(F.col("author") == "", 0.5).when(F.col("call").isNotNull(), F.round(0.6 + 0.3 * F.col("top"), 2)).otherwise(F.col("top")).alias("score"),
        F.lit("class").alias("stage"),
    )
    left_over = rest.join(classes, "cls", "left_anti").select("read", "x")
    best = _nearest(left_over.select(F.col("x").alias("a")), right.select(F.col("y").alias("b"), "call", "ord"), [], (6, 5, 4, 3, 2, 1), 0.60, 0.95, 0.08)
    three = left_over.join(best.withColumnRenamed("a", "x"), "x", "left").select("read", "call", F.coalesce("top", F.lit(0.0)).alias("score"), F.lit("whole").alias("stage"))
    return one.union(two).union(three)


def _most(a: Column, b: Column, k: int) -> Column:
    """What a blend of texts of ``a`` and ``b`` characters without a common run of ``k`` reaches at most.

    Their common run is shorter, and between two blocks that match at least one character does not.
    """
    least, both = F.least(a, b), a + b
    matched = F.least(least, F.floor((both + 1) * (k - 1) / (2 * k - 1)))
    return SUBSTRING_WEIGHT * F.least(F.lit(1.0), (k - 1) / least) + (1 - SUBSTRING_WEIGHT) * 2 * matched / both + 1e-9


def _nearest(asked: DataFrame, books: DataFrame, keys: list[str], runs: tuple[int, ...], enough: float, sure: float, margin: float) -> DataFrame:
    """(keys, a, top, call) for the texts ``a``: the best blend with the books (keys, b, call, ord) of their keys, and the first such book if ``gate`` accepts it.

    Books that share a run of the first length of ``runs`` are scored first. Where what the others could reach may change the result, those that share
    a run of the next length are, in the end all of the keys (0) or all that share a character (1), so it is that of all pairs.
    """
    asked = stash(asked.distinct(), "asked")
    first = books.groupBy(*keys, "b").agg(F.count("*").alias("n"), F.min_by("call", "ord").alias("call"), F.min("ord").alias("ord"))
    first = stash(first, "books")
    lengths = first.where("b <> ''").select(F.length("b").alias("bl")).distinct()
    done = None
    for k in runs:
        of = lambda t, c: t.select(*keys, c, F.explode(grams(F.col(c), k)).alias("gram")).where(F.length(c) >= k)  # noqa: B023, E731
        pairs = asked.join(first.select(*keys, "b"), keys) if k == 0 else of(asked, "a").join(of(first, "b"), [*keys, "gram"]).select(*keys, "a", "b").distinct()
        scored = pairs.withColumn("s", F.when(F.col("b") == "", 0.0).otherwise(blend("a", F.when(F.col("b") != "", F.col("b"))))).join(first, [*keys, "b"])
        levels = scored.groupBy(*keys, "a", "s").agg(F.sum("n").alias("n"), F.max(F.struct((-F.col("ord")).alias("o"), "call")).alias("book"))
        two = levels.groupBy(*keys, "a").agg(F.max(F.struct("s", "n", "book")).alias("b"), F.sort_array(F.collect_list("s"), asc=False).alias("all"))
        next_ = F.when(F.col("b.n") > 1, F.col("b.s")).otherwise(F.coalesce(F.get("all", F.lit(1)), F.lit(0.0)))
        two = two.select(*keys, "a", F.col("b.s").alias("top"), next_.alias("next"), "b.book.call")
        if k > 1:
            most = asked.select(F.length("a").alias("al")).distinct().join(lengths).groupBy("al").agg(F.max(_most(F.col("al"), F.col("bl"), k)).alias("most"))
            two = two.withColumn("al", F.length("a")).join(F.broadcast(most), "al")
            plain = (F.col("top") < enough) | (F.col("top") >= sure) | (F.col("top") - F.col("next") < margin) | (F.col("top") - F.greatest("next", "most") >= margin + 1e-9)
            two = two.where((F.col("top") > F.col("most")) & plain)
        two = two.select(*keys, "a", "top", F.when(gate(F.col("top"), F.col("next"), enough, sure, margin), F.col("call")).alias("call"))
        two = stash(two, "nearest")
        done = two if done is None else done.union(two)
        asked = stash(asked.join(two.select(*keys, "a"), [*keys, "a"], "left_anti"), "asked")
        if asked.isEmpty():
            break
    return done


def gate(top: Column, second: Column, enough: float, sure: float, margin: float) -> Column:
    """Whether a best score is accepted: enough, and either sure or a margin above the second."""
    return (top >= enough) & ((top >= sure) | (top - F.coalesce(second, F.lit(0.0)) >= margin))


def fuzzy_pairs(a: DataFrame, b: DataFrame, score: Callable[[str, str], Column]) -> DataFrame:
    """(a, b, s) of the distinct texts that share a run of two characters, or of one where either has fewer than six."""
    a, b = a.toDF("a").where("a <> ''").distinct(), b.toDF("b").where("b <> ''").distinct()

    def keyed(t: DataFrame, c: str) -> DataFrame:
        v = F.col(c)
        return t.select(v, F.explode(F.array_distinct(F.concat(F.transform(grams(v, 2), lambda g: F.concat(F.lit("2"), g)), F.transform(grams(v, 1), lambda g: F.concat(F.lit("1"), g))))).alias("gram"), (F.length(v) < 6).alias(f"{c}_short"))

    short = F.col("a_short") | F.col("b_short")
    pairs = keyed(a, "a").join(keyed(b, "b"), "gram").where(F.col("gram").startswith("2") | short).select("a", "b").distinct()
    return pairs.withColumn("s", score("a", "b"))


def match_title(reads: DataFrame, catalog: DataFrame, enough: float = 0.55, sure: float = 0.90, margin: float = 0.10, least: int = 2, floor: bool = False, main_title: bool = False) -> DataFrame:
    """(read, call, score): titles by the blended similarity; ``floor`` counts a shorter title as four characters, ``margin`` 0 takes the first best.

    Texts of fewer than ``least`` characters match nothing.
    """
    left = reads.select("read").distinct().withColumn("x", text.norm_title("read"))
    title = F.get(F.split("title", " : "), 0) if main_title else F.col("title")
    right = catalog.select("call", "ord", text.norm_title(title).alias("y")).where("y <> ''")
    usable = left.where(F.length("x") >= least)
    scores = fuzzy_pairs(usable.select(F.col("x").alias("a")), right.select(F.col("y").alias("b")), title_blend if floor else blend).withColumnsRenamed({"a": "x", "b": "y"})
    best = _best_two(usable.join(scores, "x").join(right, "y").select("read", "call", "ord", "s"))
    accepted = best.select("read", F.when(gate(F.col("top"), F.col("next"), enough, sure, margin), F.col("call")).alias("call"), F.col("top").alias("score"))
    return left.select("read").join(accepted, "read", "left").select("read", "call", F.coalesce("score", F.lit(0.0)).alias("score"))


def match_label(reads: DataFrame, catalog: DataFrame) -> DataFrame:
    """(read, call, candidates) by the label's beginning: the only equal row, else the only row of which one is the other's prefix."""
    left = reads.select("read").distinct().withColumn("x", text.norm("read")).where("x <> ''")
    right = catalog.select("call", text.norm("call").alias("y")).where("y <> ''")
    pairs = left.select("x").distinct().join(right.select("y").distinct(), F.substring("x", 1, 1) == F.substring("y", 1, 1)).where(F.startswith("x", "y") | F.startswith("y", "x"))
    found = left.join(pairs, "x").join(right, "y").groupBy("read").agg(F.count_if(F.col("x") == F.col("y")).alias("equal"), F.min(F.when(F.col("x") == F.col("y"), F.col("call"))).alias("same"), F.count("*").alias("candidates"), F.min("call").alias("only"))
    return found.select("read", F.when(F.col("equal") == 1, F.col("same")).when(F.col("candidates") == 1, F.col("only")).alias("call"), F.when(F.col("equal") == 1, 1).otherwise(F.col("candidates")).cast("long").alias("candidates"))


def match_labels_and_titles(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (id, label, title): (id, call, how) by the label, an ambiguous or unknown one by the title."""
    by_label = match_label(rows.select(F.col("label").alias("read")), catalog).withColumnsRenamed({"read": "label", "call": "l_call"})
    by_title = match_title(rows.select(F.col("title").alias("read")), catalog, enough=0.5, sure=2.0, margin=0.0).select(F.col("read").alias("title"), F.col("call").alias("t_call"))
    both = rows.join(by_label, "label", "left").join(by_title, "title", "left")
    how = F.when(F.col("l_call").isNotNull(), "label").when(F.col("candidates") > 1, "title_disambiguated").when(F.col("t_call").isNotNull(), "title").otherwise("none")
    return both.select("id", F.coalesce("l_call", "t_call").alias("call"), how.alias("how"))


def match_tokens(reads: DataFrame, catalog: DataFrame, share: float = 0.6) -> DataFrame:
    """(read, call): a series shelf. One token must resemble a prefix that the share of rows have; of the others' numbers the last real volume counts."""
    books = catalog.select("call", "ord", text.tokens("call").alias("toks"))
    total = books.agg(F.count("*").alias("total"))
    prefixes = books.select(F.explode(F.slice("toks", F.lit(1), F.greatest(F.size("toks") - 1, F.lit(0)))).alias("p")).groupBy("p").agg(F.count("*").alias("n")).join(total).where(F.col("n") >= share * F.col("total")).select("p")  # at most 1 / share rows for each place
    left = reads.select("read").distinct()
    toks = left.select("read", F.posexplode(text.tokens("read")).alias("at", "tok"))
    near = toks.select("tok").distinct().join(F.broadcast(prefixes)).withColumn("s", matching_ratio("tok", "p")).where((F.col("s") > 0.7) | F.contains("tok", "p")).select("tok").distinct()
    series = toks.join(near, "tok", "left_semi").select("read").distinct()
    rest = toks.join(series, "read", "left_semi").join(near, "tok", "left_anti")
    numbers = rest.select("read", "at", F.posexplode(F.regexp_extract_all("tok", F.lit("([0-9]{1,3})"), F.lit(1))).alias("k", "number"))
    volumes = books.groupBy(F.element_at("toks", -1).alias("number")).agg(F.min_by("call", "ord").alias("hit"))
    last = numbers.join(volumes, "number").groupBy("read").agg(F.max_by("hit", F.struct("at", "k")).alias("call"))
    return left.join(last, "read", "left").select("read", "call")


def match_series(reads: DataFrame, catalog: DataFrame, prefix: str, noise: tuple[str, ...] = ()) -> DataFrame:
    """(read, call): each number of one to three digits that is no noise, put behind a fixed prefix; the first that the catalog has."""
    left = reads.select("read").distinct()
    numbers = left.select("read", F.posexplode(F.regexp_extract_all("read", F.lit("([0-9]{1,3})"), F.lit(1))).alias("at", "number")).where(~F.col("number").isin(*noise) if noise else F.lit(True))
    hits = numbers.withColumn("call", F.concat(F.lit(prefix), "number")).join(catalog.select("call").distinct(), "call", "left_semi")
    return left.join(hits.groupBy("read").agg(F.min_by("call", "at").alias("call")), "read", "left")


def match_baseline(reads: DataFrame, catalog: DataFrame, enough: float = 0.62, bonus: float = 0.15) -> DataFrame:
    """(read, call, score): the most similar author, in the class if it was read and is known, which adds the bonus, else in the whole catalog."""
    items = prepared(catalog).select("call", "cls", "ord", text.mark_text_without_jamo("author").alias("author"))
    left = reads.select("read").distinct().withColumn("t", text.mark_text_without_jamo("read")).withColumn("cls", F.regexp_extract("t", CLASS, 0))
    marks = F.array_distinct(F.regexp_extract_all("t", F.lit(f"([{text.SYLLABLES}][0-9]{{1,3}}[{text.SYLLABLES}]?)"), F.lit(1)))
    left = left.select("read", "cls", F.explode(marks).alias("mark"))
    left = left.join(items.select("cls", F.lit(True).alias("known")).distinct(), "cls", "left")
    # What a mark means in a class, or in the whole catalog, is the same for all texts, so it is found once for each. Of books with
    # one author the first can win; an equal author has a ratio of 1.0, which no other has.
    first = [F.min_by("call", "ord").alias("call"), F.min("ord").alias("ord")]
    in_class, authors = items.groupBy("cls", "author").agg(*first), items.groupBy("author").agg(*first)
    asked = left.where("known").select("cls", "mark").distinct()
    equal = asked.join(in_class.withColumnRenamed("author", "mark"), ["cls", "mark"]).select("cls", "mark", "call", "ord", F.lit(1.0).alias("s"))
    inside = asked.join(in_class.select("cls", F.col("author").alias("mark")), ["cls", "mark"], "left_anti").join(in_class, "cls").select("cls", "mark", "author", "call", "ord")
    # A ratio of 0.62 needs a common character; authors are short, so that is the join.
    letters = lambda t, c: t.select(c, F.explode(F.array_distinct(_letters(F.col(c)))).alias("letter"))
    shared = letters(left.where("known is null").select("mark").distinct(), "mark").join(letters(authors.select("author"), "author"), "letter").select("mark", "author").distinct()
    scores = inside.select("mark", "author").union(shared).distinct().withColumn("s", matching_ratio("mark", "author"))

    def best(rows: DataFrame, by: list[str], extra: float) -> DataFrame:
        s = F.when(F.col("s") > 0, F.col("s") + extra).otherwise(0.0)
        return rows.groupBy(by).agg(F.max(F.struct(s.alias("s"), (-F.col("ord")).alias("o"), "call")).alias("b"))

    by_class = best(equal.union(inside.join(scores, ["mark", "author"]).select("cls", "mark", "call", "ord", "s")), ["cls", "mark"], bonus)
    by_mark = best(scores.join(shared, ["mark", "author"], "left_semi").join(authors, "author"), ["mark"], 0.0)
    found = left.where("known").join(by_class, ["cls", "mark"]).select("read", "b").union(left.where("known is null").join(by_mark, "mark").select("read", "b"))
    best_of = found.groupBy("read").agg(F.max("b").alias("b")).select("read", F.col("b.s").alias("score"), "b.call")
    return reads.select("read").distinct().join(best_of, "read", "left").select("read", F.when(F.col("score") >= enough, F.col("call")).alias("call"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _letters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _may_reach(a: str, b: str, least: float) -> Column:
    """Whether the matching ratio of two texts can be ``least``: what matches are characters that both have."""
    x, y = F.col(a), F.col(b)
    common = F.least(F.length(x) - F.length(F.call_function("translate", x, y, F.lit(""))), F.length(y) - F.length(F.call_function("translate", y, x, F.lit(""))))
    return 2 * common >= (least - 1e-9) * (F.length(x) + F.length(y))


def retro_call(reads: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, cls, author, score) for rows (id, reads array): an exactly read class with one similar author, none as similar in a class it is a prefix of or that is its prefix."""
    authors = prepared(catalog).select("cls", "author").distinct()
    lines = reads.select("id", F.posexplode("reads").alias("at", "line"))
    classes = lines.join(authors.select("cls").distinct(), F.col("line") == F.col("cls")).select("id", F.col("at").alias("c_at"), "cls")
    asked = classes.join(lines, "id").where("at <> c_at").select("id", "cls", "line")
    # What a line means in a class is the same for all rows, so it is found once for each pair of them. A second author counts
    # if it is within 0.1 of one of 0.75 or more.
    meant = asked.select("cls", "line").distinct()
    scored = meant.join(authors, "cls").where(_may_reach("line", "author", 0.65))
    scored = scored.join(scored.select("line", "author").distinct().withColumn("s", matching_ratio("line", "author")), ["line", "author"])
    best = scored.groupBy("cls", "line").agg(F.sort_array(F.collect_list("s"), asc=False).alias("all"), F.max_by("author", F.struct("s", "author")).alias("author"))
    best = best.where((F.get("all", F.lit(0)) >= 0.75) & (F.coalesce(F.get("all", F.lit(1)), F.lit(-1.0)) <= F.get("all", F.lit(0)) - 0.1)).withColumn("score", 1 + F.get("all", F.lit(0))).drop("all")
    # Classes in a prefix relation: each class is dealt under its prefixes of three characters or more.
    prefixes = authors.select(F.col("cls").alias("other"), F.col("author").alias("o_author"), F.explode(F.sequence(F.lit(3), F.length("cls"))).alias("k")).where("k < length(other)").select(F.substring("other", F.lit(1), F.col("k")).alias("cls"), "o_author")
    longer = best.join(prefixes, "cls").select("cls", "line", "o_author")
    own = best.select("cls", "line", F.explode(F.sequence(F.lit(3), F.length("cls"))).alias("k")).where("k < length(cls)").select("cls", "line", F.substring("cls", F.lit(1), F.col("k")).alias("p"))
    shorter = own.join(authors.select(F.col("cls").alias("p"), F.col("author").alias("o_author")), "p").select("cls", "line", "o_author")
    rivals = longer.union(shorter).where(_may_reach("line", "o_author", 0.7))
    alike = rivals.select("line", "o_author").distinct().withColumn("s", matching_ratio("line", "o_author")).where("s >= 0.7")
    blocked = rivals.join(alike, ["line", "o_author"]).select("cls", "line").distinct()
    free = best.join(blocked, ["cls", "line"], "left_anti")
    return asked.join(free, ["cls", "line"]).groupBy("id").agg(F.max(F.struct("score", "cls", "author")).alias("b")).select("id", "b.cls", "b.author", "b.score")


def suggest_calls(reads: DataFrame, catalog: DataFrame, top: int = 5) -> DataFrame:
    """(id, call, score, place) for rows (id, reads array): close classes (three for each line, at least 0.55) with authors of at least 0.45, by the sum."""
    authors = prepared(catalog).select("cls", "author").distinct()
    lines = reads.select("id", F.posexplode("reads").alias("at", "line"))
    # A ratio of 0.55 needs a common character, but no run of two.
    letters = lambda t, c: t.select(c, F.explode(F.array_distinct(_letters(F.col(c)))).alias("letter")).distinct()
    close = letters(lines, "line").join(letters(authors, "cls"), "letter").select("line", "cls").distinct().where(_may_reach("line", "cls", 0.55))
    close = close.withColumn("base", matching_ratio("line", "cls")).where("base >= 0.55")
    close = close.withColumn("rn", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("base"), F.desc("cls")))).where("rn <= 3").drop("rn")
    first = lines.join(close, "line").select("id", F.col("at").alias("c_at"), "cls", "base")
    asked = first.join(lines, "id").where("at <> c_at").select("id", "cls", "base", "line")
    # A line's authors in a class are the same for all rows. A call that is among a row's best is among the best of the line and
    # class that give it its score, as those before it there are before it in the row too.
    pairs = asked.select("cls", "line").distinct().join(authors, "cls").where(_may_reach("line", "author", 0.45))
    scores = pairs.select("line", "author").distinct().withColumn("s", matching_ratio("line", "author")).where("s >= 0.45")
    near = pairs.join(scores, ["line", "author"]).withColumn("rn", F.row_number().over(Window.partitionBy("cls", "line").orderBy(F.desc("s"), "author"))).where(F.col("rn") <= top)
    best = asked.join(near, ["cls", "line"]).groupBy("id", F.concat_ws("-", "cls", "author").alias("call")).agg(F.round(F.max(F.col("base") + F.col("s")), 6).alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "call"))).where(F.col("place") <= top)


# --- a matcher is chosen by name -------------------------------------------------------------

MATCHERS: dict[str, Callable[..., DataFrame]] = {
    "cascade": match_call,
    "cascade without surgery": lambda reads, catalog: match_call(reads, catalog, surgery=False),
    "containment": match_catalog,
    "baseline": match_baseline,
    "tokens": match_tokens,
    "title": match_title,
}


def register(name: str, matcher: Callable[..., DataFrame]) -> None:
    """Adds a matcher; one of that name is replaced."""
    MATCHERS[name] = matcher


def register_functions(spark: SparkSession) -> None:
    """Makes the table function ``read_pairs(text)`` known to SQL: (place, cls, author) for each class with an author in a text."""

    class ReadPairs:
        def eval(self, read: str):
            kept = re.sub(KEPT_OUT, "", unicodedata.normalize("NFC", re.sub("[vV][.]?[0-9]+", " ", read or "")))
            for place, found in enumerate(re.finditer(PAIR, kept)):
                yield place, found[1], found[2]

    spark.udtf.register("read_pairs", F.udtf(ReadPairs, returnType="place: int, cls: string, author: string"))
