"""Full-text search: the query language, an inverted index with positions, and BM25 over either index or texts.

Query language: words, "quoted phrases", either with a final * for prefixes, + between parts of a phrase, ^ before a
phrase that must begin its column, NEAR(phrases, n), AND, OR, NOT, parentheses, and column filters (``title : x``,
``{title summary} : (x y)``, ``- detail : x``). Phrases one after another must all occur, which binds closest, then
NOT, AND and OR. What is no query of this language is searched as a substring by the caller.

A NEAR group occurs where all its phrases stand in one column with n words at most (10 by default) between the end of
each and the beginning of the last. Only such occurrences of its phrases count for the rank, while the rarity of a phrase
is that of all its occurrences. A phrase counts for a row's rank only if all parts of the query that it belongs to meet
the row: in ``a b OR c`` an ``a`` without ``b`` counts nothing.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuo.functions import folding as fd

COLUMNS = ("title", "summary", "detail")
K1, B = 1.2, 0.75
_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([^\W]+|[\x1a]+)|([():{}*+,^-]))', re.U)
#: Words between the phrases of a NEAR group that names no number.
NEAR_WORDS = 10
#: Up to so many words a place's neighbours are listed and met by hashing, so a long text costs what its places cost.
LISTED = 64


class Phrase(NamedTuple):
    words: tuple[str, ...]
    prefix: bool
    columns: tuple[str, ...]
    first: bool = False
    #: The number of its NEAR group and the group's distance.
    group: int | None = None
    distance: int = 0


def search_words(text: Column) -> Column:
    return F.regexp_extract_all(fd.plain(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# -- the query language


class _Parser:
    """Recursive descent; ``phrases`` collects every phrase."""

    def __init__(self, query: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        query = query.strip()
        while at < len(query):
            found = _TOKEN.match(query, at)
            if not found:
                raise ValueError(query)
            text, word, mark = found.groups()
            self.tokens.append(("text", text.replace('""', '"')) if text is not None else ("word", word) if word else ("mark", mark))
            at = found.end()
        self.at, self.phrases, self.groups = 0, [], 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, token: tuple[str, str]) -> bool:
        if self.peek() == token:
            self.at += 1
            return True
        return False

    def expect(self, token: tuple[str, str]) -> None:
        if not self.take(token):
            raise ValueError(token)

    def operator(self, name: str) -> bool:
        return self.take(("word", name))

    def either(self, columns):
        left = self.both(columns)
        while self.operator("OR"):
            left = _join("or", left, self.both(columns))
        return left

    def both(self, columns):
        left = self.without(columns)
        while self.operator("AND"):
            left = _join("and", left, self.without(columns))
        return left

    def without(self, columns):
        left = self.part(columns)
        while self.operator("NOT"):
            right = self.part(columns)
            left = ("not", left, right) if left and right else left
        return left

    def part(self, columns):
        """A group in parentheses, or phrases one after another, all of which must occur."""
        own = self.limited(columns)
        if self.take(("mark", "(")):
            inner = self.either(own)
            self.expect(("mark", ")"))
            return inner
        left = self.nearby(own)
        while self.peek()[0] == "text" or self.peek() in (("mark", "{"), ("mark", "-"), ("mark", "^")) or self.peek()[0] == "word" and self.peek()[1] not in ("AND", "OR", "NOT"):
            left = _join("and", left, self.nearby(self.limited(columns)))
        return left

    def nearby(self, columns):
        """A phrase, one that begins its column, or a NEAR group."""
        if self.take(("mark", "^")):
            return self.phrase(columns, first=True)
        if self.peek() != ("word", "NEAR") or self.peek(1) != ("mark", "("):
            return self.phrase(columns)
        self.at += 2
        start = len(self.phrases)
        self.phrase(columns)
        while self.peek() not in (("mark", ","), ("mark", ")")):
            self.phrase(columns)
        distance = NEAR_WORDS
        if self.take(("mark", ",")):
            kind, text = self.peek()
            if kind != "word" or not re.fullmatch("[0-9]+", text):
                raise ValueError(text)
            self.at, distance = self.at + 1, int(text)
        self.expect(("mark", ")"))
        own = range(start, len(self.phrases))
        if len(own) > 1:
            self.groups += 1
            self.phrases[start:] = [p._replace(group=self.groups, distance=distance) for p in self.phrases[start:]]
        return reduce(lambda a, b: ("and", a, b), [("phrase", k) for k in own]) if own else None

    def limited(self, columns):
        wanted = self.filter()
        return columns if wanted is None else [c for c in columns if c in wanted]

    def filter(self):
        """The columns of a filter that stands here, else None."""
        start, unwanted = self.at, self.take(("mark", "-"))
        names = []
        if self.take(("mark", "{")):
            while self.peek()[0] in ("word", "text"):
                names.append(self.peek()[1].lower())
                self.at += 1
            self.expect(("mark", "}"))
            self.expect(("mark", ":"))
        elif self.peek()[0] in ("word", "text") and self.peek(1) == ("mark", ":"):
            names.append(self.peek()[1].lower())
            self.at += 2
        elif unwanted:
            raise ValueError("-")
        else:
            self.at = start
            return None
        if not names or any(n not in COLUMNS for n in names):
            raise ValueError(names)
        return [c for c in COLUMNS if (c in names) != unwanted]

    def phrase(self, columns, first: bool = False):
        words, prefix = [], False
        while True:
            kind, text = self.peek()
            if kind not in ("text", "word") or kind == "word" and text in ("AND", "OR", "NOT"):
                raise ValueError(text)
            self.at += 1
            words += re.findall(r"[^\W_]+", fd.plain_query(text))
            prefix = self.take(("mark", "*"))
            if not self.take(("mark", "+")):
                break
        if not words or not columns:
            return None
        self.phrases.append(Phrase(tuple(words), prefix, tuple(columns), first))
        return ("phrase", len(self.phrases) - 1)


def _join(kind, left, right):
    return (kind, left, right) if left and right else left or right


def parse(query: str):
    """(tree, phrases) of a query; the tree is None if its phrases hold no word. None if it isn't of the language."""
    try:
        parser = _Parser(query)
        tree = parser.either(list(COLUMNS))
        if parser.peek()[0] != "end":
            return None
    except ValueError:
        return None
    return tree, parser.phrases


def matches(tree) -> Column:
    """Whether a row with the phrase counts f0, f1, ... meets the tree."""
    kind, *parts = tree
    if kind == "phrase":
        return F.col(f"f{parts[0]}") > 0
    left, right = map(matches, parts)
    return left & right if kind == "and" else left | right if kind == "or" else left & ~right


def counted_phrases(tree, within: tuple = ()) -> list[tuple[int, list]]:
    """The phrases that count for the rank, all but those that must not occur, and the parts that must meet the row."""
    kind, *parts = tree
    if kind == "phrase":
        return [(parts[0], list(within))]
    within = within if kind == "or" else (*within, tree)
    return counted_phrases(parts[0], within) + (counted_phrases(parts[1], within) if kind != "not" else [])


# -- places of phrases in rows


def _near(places: list[Column], phrases: list[Phrase]) -> list[Column]:
    """Of the phrases' places in one column those that take part in a group. Places: where phrases begin, ascending."""
    reach = [len(p.words) + p.distance for p in phrases]

    def around(x: Column, low: int, high: int) -> Column:
        return F.flatten(F.transform(x, lambda q: F.sequence(q + low, q + high)))

    def in_reach(x: Column, ends: Column, r: int) -> Column:
        """The ends that a place of x lies before, at most r words."""
        return F.array_intersect(ends, around(x, 0, r)) if r <= LISTED else F.filter(ends, lambda last: F.exists(x, lambda q: (q <= last) & (q >= last - r)))

    def taking_part(x: Column, ends: Column, r: int) -> Column:
        return F.array_intersect(x, around(ends, -r, 0)) if r <= LISTED else F.filter(x, lambda q: F.exists(ends, lambda last: (q <= last) & (last <= q + r)))

    every = reduce(lambda ends, xr: in_reach(xr[0], ends, xr[1]), zip(places, reach, strict=True), F.array_distinct(F.concat(*places)))
    held = F.array(every)  # a lambda's variable is worked out once, an expression for each element that a lambda meets
    of = lambda x, r: lambda ends: taking_part(x, ends, r)
    return [F.transform(held, of(x, r))[0] for x, r in zip(places, reach, strict=True)]


def _counted(phrases: list[Phrase], places: dict[tuple[int, str], Column]) -> list[Column]:
    """f0, f1, ...: how often phrases occur, in NEAR groups only together; a0, a1, ... of those in groups: alone."""
    near = dict(places)
    for group in sorted({p.group for p in phrases if p.group}):
        own = [k for k, p in enumerate(phrases) if p.group == group]
        for c in phrases[own[0]].columns:
            near |= zip([(k, c) for k in own], _near([places[k, c] for k in own], [phrases[k] for k in own]), strict=True)
    total = lambda found, k, p: reduce(lambda a, b: a + b, [F.size(found[k, c]) for c in p.columns])
    out = [total(near, k, p).alias(f"f{k}") for k, p in enumerate(phrases)]
    return out + [total(places, k, p).alias(f"a{k}") for k, p in enumerate(phrases) if p.group]


def _in_words(words: Column, phrase: Phrase) -> Column:
    """Where the phrase begins in an array of words."""
    *lead, last = phrase.words

    def starts(at: Column) -> Column:
        here = lambda k: F.get(words, at + k)
        end = here(len(lead)).startswith(last) if phrase.prefix else here(len(lead)) == last
        return reduce(lambda a, b: a & b, [here(k) == w for k, w in enumerate(lead)] + [end])

    most = F.lit(1) if phrase.first else F.size(words)
    at = F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0)))  # beyond the last word there is none
    return F.filter(at, lambda x: F.coalesce(starts(x), F.lit(False)))


def counts_in_texts(observations: DataFrame, phrases) -> DataFrame:
    """id, dl, f0, f1, ...: read from the texts, one pass, nothing shuffled."""
    words = observations.select("id", *[search_words(F.col(c)).alias(c) for c in COLUMNS])
    total = reduce(lambda a, b: a + b, [F.size(c) for c in COLUMNS])
    places = {(k, c): _in_words(F.col(c), p).alias(f"p{k}_{c}") for k, p in enumerate(phrases) for c in p.columns}
    found = words.select("id", total.alias("dl"), *places.values())
    return found.select("id", "dl", *_counted(phrases, {key: F.col(f"p{key[0]}_{key[1]}") for key in places}))


def lengths(observations: DataFrame) -> DataFrame:
    """(id, dl): how many words a text has."""
    return observations.select("id", reduce(lambda a, b: a + b, [F.size(search_words(F.col(c))) for c in COLUMNS]).alias("dl"))


def posting_rows(observations: DataFrame, *keep: str) -> DataFrame:
    """The inverted index: a row a term and observation with the term's positions in each column."""
    words = observations.select("id", "project_key", *keep, *[search_words(F.col(c)).alias(c) for c in COLUMNS])
    words = words.withColumn("dl", reduce(lambda a, b: a + b, [F.size(c) for c in COLUMNS]))
    tagged = lambda c, k: F.transform(c, lambda w, i: F.struct(w.alias("term"), F.lit(k).alias("k"), i.alias("pos")))
    each = words.select("id", "project_key", *keep, "dl", F.explode(F.concat(*[tagged(c, k) for k, c in enumerate(COLUMNS)])).alias("x"))
    places = [F.sort_array(F.collect_list(F.when(F.col("x.k") == k, F.col("x.pos")))).alias(c) for k, c in enumerate(COLUMNS)]
    return each.groupBy("id", "project_key", *keep, "dl", F.col("x.term").alias("term")).agg(*places)


def counts_in_postings(postings: DataFrame, phrases) -> DataFrame:
    """The same counts out of the index: only the rows of asked terms are read and gathered, by observation."""
    asked = sorted({(w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)})
    fits = {a: F.col("term").startswith(a[0]) if a[1] else F.col("term") == a[0] for a in asked}
    rows = postings.where(reduce(lambda a, b: a | b, fits.values()))
    place = {(a, c): f"t{k}_{c}" for k, a in enumerate(asked) for c in COLUMNS}
    found = rows.groupBy("id").agg(F.max("dl").alias("dl"), *[F.sort_array(F.flatten(F.collect_list(F.when(fits[a], F.col(c))))).alias(name) for (a, c), name in place.items()])

    def begins(p: Phrase, column: str) -> Column:
        lists = [F.col(place[(w, p.prefix and k == len(p.words) - 1), column]) for k, w in enumerate(p.words)]
        at = reduce(lambda found, ky: F.array_intersect(found, F.transform(ky[1], lambda x: x - ky[0])), list(enumerate(lists))[1:], lists[0])
        return F.filter(at, lambda x: x == 0) if p.first else at

    places = {(k, c): begins(p, c).alias(f"p{k}_{c}") for k, p in enumerate(phrases) for c in p.columns}
    found = found.select("id", "dl", *places.values())
    return found.select("id", "dl", *_counted(phrases, {key: F.col(f"p{key[0]}_{key[1]}") for key in places}))


def ranked(counted: DataFrame, tree, stats: DataFrame | None = None) -> DataFrame:
    """(id, rank) of the rows that meet the tree; negative, smaller is better.

    counted: one row a text, or those with any asked term beside ``stats`` (n, avg_dl) of all texts.
    """
    phrases = counted_phrases(tree)
    alone = lambda k: F.col(f"a{k}" if f"a{k}" in counted.columns else f"f{k}")
    some = [F.sum((alone(k) > 0).cast("long")).alias(f"n{k}") for k, _ in phrases]
    if stats is None:
        stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"), *some)
    else:
        stats = stats.join(F.broadcast(counted.agg(*some)))  # one row each
    hit = counted.where(matches(tree)).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k, parts in phrases:
        met = reduce(lambda a, b: a & b, map(matches, parts), F.lit(True))
        f, n = F.when(met, F.col(f"f{k}")).otherwise(0), F.col(f"n{k}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return hit.select("id", score.alias("rank"))
