"""The state match (see ``functions.text.state_matches``) between all texts of a group, as a join by signatures.

A text matches a longer one through all its tokens or as a part of its characters. Either way it has terms that the longer
one must have too, and one of them, the group's rarest, finds the candidates:

* tokens: each is a word of the longer text;
* characters, three words or more: all but the outer two are whole words of the longer text;
* characters, two words: together 17 characters at least, so one has PART of them and is the end or the start of a word;
* characters, one word: its first WHOLE characters are in a word that is as long.

A text with a term that no longer text has matches nothing and drops out before any pair is met; a FEW long ones
are asked first, and only where all of them are held the others. Candidates are tested on
the texts themselves, so the result is that of comparing all pairs. Items have a key of the group and ``normalized``, the
normal form of the state; equal texts of a group count once, null texts and rows
without a group match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuo.functions import text as T
from continuo.plans.scratch import cut

#: Characters from which on a text matches as a part of another (a fixed value), and what half of it leaves for a word.
WHOLE, PART = 18, 9
#: Terms that a text asks first, the longest of so many; rows of a side that is broadcast at most.
FEW, FIRST, BROADCAST = 8, 64, 200_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _hashed(tag: str, words: Column) -> Column:
    """A term is a 64-bit hash of group, tag and word: equal hashes of others only add candidates, which the texts then refute."""
    return F.transform(words, lambda w: F.xxhash64(F.col("g"), F.lit(tag), w))


def held_terms(text: Column, words: Column, tokens: Column) -> Column:
    """Every term by which a shorter text could find this one, from its distinct words."""
    parts = F.filter(words, lambda w: F.length(w) >= PART)
    ends, starts = F.transform(parts, lambda w: F.right(w, F.lit(PART))), F.transform(parts, lambda w: F.left(w, F.lit(PART)))
    wholes = F.filter(parts, lambda w: F.length(w) >= WHOLE)
    pieces = F.transform(wholes, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (WHOLE - 1)), lambda i: F.substring(w, i, F.lit(WHOLE))))
    alone = F.when(F.size(tokens) == 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    once = F.array_distinct
    return F.concat(_hashed("w", words), _hashed("<", once(ends)), _hashed(">", once(starts)), _hashed("~", once(F.flatten(pieces))), _hashed("=", alone))


def asked_terms(text: Column, words: Column, tokens: Column, most: int | None = None) -> Column:
    """(way, terms): by tokens (or as a whole, where there are none) and by characters, each with terms a longer text must have.

    most: of the first so many terms the FEW longest ones, instead of all.
    """
    n = F.size(words)

    def told(tag: str, found: Column) -> Column:
        if most is None:
            return _hashed(tag, F.array_distinct(found))
        sized = F.transform(found, lambda w: F.struct(F.length(w).alias("n"), F.xxhash64(F.col("g"), F.lit(tag), w).alias("term")))
        return F.slice(F.sort_array(F.array_distinct(sized), asc=False), 1, FEW)["term"]

    by_tokens = F.when(F.size(tokens) > 0, F.struct(F.lit("tokens").alias("way"), told("w", tokens if most is None else F.slice(tokens, 1, most)).alias("terms")))
    by_tokens = by_tokens.otherwise(F.struct(F.lit("equal").alias("way"), _hashed("=", F.array(text)).alias("terms")))
    first, second = F.get(words, 0), F.get(words, 1)
    between = F.greatest(n - 2, F.lit(0))
    inner = F.when(n > 2, told("w", F.slice(words, F.lit(2), between if most is None else F.least(between, F.lit(most)))))
    inner = inner.when(n == 1, _hashed("~", F.array(F.left(first, F.lit(WHOLE)))))
    inner = inner.when(F.length(first) >= F.length(second), _hashed("<", F.array(F.right(first, F.lit(PART)))))
    inner = inner.otherwise(_hashed(">", F.array(F.left(second, F.lit(PART)))))
    by_characters = F.when(F.length(text) >= WHOLE, F.struct(F.lit("characters").alias("way"), inner.alias("terms")))
    return F.filter(F.array(by_tokens, by_characters), lambda x: x.isNotNull())


def _split(found: DataFrame) -> DataFrame:
    return found.withColumns({"words": _words(F.col("text")), "tokens": T.state_tokens(F.col("text"))})


def _id(group: Column, text: Column) -> Column:
    """The md5 of group and text, null where one is."""
    group = group.cast("string")
    return F.unhex(F.md5(F.concat(F.length(group).cast("string"), F.lit(":"), group, text)))


def texts(items: DataFrame, key: str) -> DataFrame:
    """h, g, text, n_tokens, n_chars, held, few: each text of a group once, its id, how many tokens and characters it has, its
    terms for shorter texts and the first that it asks longer ones. Terms lie in the row and become rows only to be met."""
    found = items.where("normalized is not null and " + key + " is not null").select(F.col(key).alias("g"), F.col("normalized").alias("text")).distinct()
    found = _split(found).withColumn("distinct", F.array_distinct("words"))
    text, words, tokens, once = (F.col(c) for c in ("text", "words", "tokens", "distinct"))
    sizes = [F.size("tokens").alias("n_tokens"), F.length("text").alias("n_chars")]
    return found.select(_id(F.col("g"), text).alias("h"), "g", "text", *sizes, held_terms(text, once, tokens).alias("held"), asked_terms(text, words, tokens, FIRST).alias("few"))


def _bounded(df: DataFrame) -> tuple[DataFrame, bool]:
    """df as a table, and whether it is small enough to be broadcast: counted, since the planner only guesses."""
    table = cut(df)
    return table, table.limit(BROADCAST + 1).count() <= BROADCAST


def _met(met: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(met) if small else met.hint("merge")


def _rarest(asked: DataFrame, long: DataFrame) -> DataFrame:
    """short, way, term of what is asked (short, way, terms) and held in full: the term that fewest texts hold.

    Merge join: terms are many more than the planner guesses from the tables they come from, and it would broadcast them.
    """
    often = long.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    rows = asked.select("short", "way", F.size("terms").alias("most"), F.explode("terms").alias("term"))
    rows = rows.join(often.hint("merge"), "term").groupBy("short", "way", "most").agg(F.count("*").alias("met"), F.min(F.struct("n", "term")).alias("x"))
    return rows.where("met = most").select("short", "way", "x.term")


def _within(short: DataFrame, long: DataFrame) -> DataFrame:
    """short, long: ids of texts of the one side and of those of the other that they lie within; a pair may come twice.

    Rows a term or candidate carry no text, so a long text costs what its words cost.
    """
    few = short.select(F.col("h").alias("short"), F.explode("few").alias("x")).select("short", "x.way", "x.terms")
    left, small = _bounded(_rarest(few, long).select(F.col("short").alias("h"), "way"))
    asked = short.select("h", "g", "text").join(_met(left, small), "h")
    asked = _split(asked).select("h", "g", "way", F.explode(asked_terms(F.col("text"), F.col("words"), F.col("tokens"))).alias("x")).where("way = x.way")
    a = _rarest(asked.select(F.col("h").alias("short"), "way", "x.terms"), long)
    sizes = short.select(F.col("h").alias("short"), F.col("n_tokens").alias("a_tokens"), F.col("n_chars").alias("a_chars"))
    a, small = _bounded(a.join(sizes, "short"))
    held = long.select(F.col("h").alias("long"), "n_tokens", "n_chars", F.explode("held").alias("term"))
    fits = F.when(F.col("way") == "tokens", F.col("a_tokens") <= F.col("n_tokens")).otherwise(F.col("a_chars") <= F.col("n_chars"))
    both, small = _bounded(held.join(_met(a, small), "term").where(fits).select("short", "way", "long"))
    tested = both
    for side, table in (("short", short), ("long", long)):
        named = table.select(F.col("h").alias(side), F.col("g").alias(f"{side}_g"), F.col("text").alias(f"{side}_text"))
        if small:  # only texts of candidates are dealt out
            named = named.join(F.broadcast(both.select(side).distinct()), side, "left_semi")
        tested = tested.join(named.hint("merge"), side)
    tokens, spaced = T.state_tokens(F.col("short_text")), F.concat(F.lit(" "), "long_text", F.lit(" "))
    inside = F.when(F.size(tokens) <= FEW, F.forall(tokens, lambda w: F.contains(spaced, F.concat(F.lit(" "), w, F.lit(" ")))))  # short ones meet most
    inside = inside.otherwise(F.size(F.array_except(tokens, T.state_tokens(F.col("long_text")))) == 0)
    true = F.when(F.col("way") == "tokens", inside).when(F.col("way") == "equal", F.col("short_text") == F.col("long_text"))
    true = (F.col("short_g") == F.col("long_g")) & true.otherwise(F.contains("long_text", "short_text"))
    return tested.where(true).select("short", "long")


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """left, right: the ids of all pairs of two sides' ``texts`` that match, each pair once."""
    pairs = _within(a, b).select(F.col("short").alias("left"), F.col("long").alias("right"))
    return cut(pairs.unionByName(_within(b, a).select(F.col("long").alias("left"), F.col("short").alias("right"))).distinct())


def _matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return _pairs(cut(texts(left, key)), cut(texts(right, key)))


def matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left, right: all pairs of different texts of a group, and equal ones, that match; each pair once."""
    a, b = cut(texts(left, key)), cut(texts(right, key))
    named = _pairs(a, b).join(a.select(F.col("h").alias("left"), F.col("g").alias(key), F.col("text").alias("left_text")), "left")
    named = named.join(b.select(F.col("h").alias("right"), F.col("text").alias("right_text")), "right")
    return named.select(key, F.col("left_text").alias("left"), F.col("right_text").alias("right"))


def _without(rows: DataFrame, met: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("__h", _id(F.col(key), F.col("normalized"))).join(met.distinct().toDF("__h"), "__h", "left_anti").drop("__h")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left side whose text matches none of the right side in their group."""
    return _without(left, _matched(left, right, key).select("left"), key)


def first_matches(left: DataFrame, right: DataFrame, key: str, order: list[str], kept: list[str]) -> DataFrame:
    """Rows of the left side that match, with ``match``: ``kept`` of the first such row of the right side by ``order``."""
    own = _id(F.col(key), F.col("normalized"))
    firsts = right.groupBy(own.alias("right")).agg(F.min(F.struct(*order, *[c for c in kept if c not in order])).alias("match"))
    met = _matched(left, right, key).join(firsts, "right").groupBy("left").agg(F.min("match").alias("match"))
    match = F.struct(*[F.col(f"match.{c}").alias(c) for c in kept])
    met = met.select(F.col("left").alias("__h"), match.alias("match"))
    return left.withColumn("__h", own).join(met, "__h").drop("__h")


def changed(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows of each side that match none of the other's, with ``change``: added or removed. Both have the same columns."""
    met = _matched(current, previous, key)  # one join serves both ways
    added = _without(current, met.select("left"), key).withColumn("change", F.lit("added"))
    return added.unionByName(_without(previous, met.select("right"), key).withColumn("change", F.lit("removed")))
