"""The state match as a join: equal to comparing all pairs, on edge cases and on a large hot group."""

import random

from pyspark.sql import functions as F

from continuo.functions.text import STATE_STOPWORDS
from continuo.operators import fuzzy


def brute(a, b):
    """The rule for two normal forms, plainly."""
    x, y = [set(t.split(" ")) - {"", *STATE_STOPWORDS} for t in (a, b)]
    return a == b or (len(a) >= 18 and a in b) or (len(b) >= 18 and b in a) or bool(x and y and (x <= y or y <= x))


EDGES = [
    "", "the", "a", "the a", "docs", "docs missing", "missing docs", "the docs still missing", "write the docs for release", "docs for release", "rite the docs for relea",
    "abcdefghijklmnopqrstuvwxyz", "cdefghijklmnopqrstuv", "cdefghijklmnopqrs", "xabcdefghijklmnopqrstuvwxyz more", "prefix superlongword another", "fix superlongword ano",
    "longword another", "superlongword another", "superlongword an", "word another superlongword", "longerlongword anothe", "the is are still yet", "is are still yet the",
    "the is are still yet the is", "ünïcode wörter überall", "nïcode wörter überal", "docs docs docs", "x y z x y z x y z x", "y z x y z x y z x y", "x y z",
]


def rows(spark, texts, start=0, key="k"):
    return spark.createDataFrame([(key, start + n, t) for n, t in enumerate(texts)], "k string, id long, normalized string")


def test_all_pairs_of_edge_cases(spark):
    left = rows(spark, EDGES).unionByName(rows(spark, ["docs", None], 100, "other"))
    got = {(r.k, r.left, r.right) for r in fuzzy.matches(left, rows(spark, [*EDGES, None, "docs"], 200), "k").collect()}
    assert got == {("k", a, b) for a in EDGES for b in EDGES if brute(a, b)}
    none = rows(spark, EDGES).where("false")
    assert fuzzy.matches(left, none, "k").count() == fuzzy.matches(none, left, "k").count() == 0
    assert fuzzy.unmatched(left, none, "k").count() == left.count()  # a null text matches nothing
    assert sorted(r.id for r in fuzzy.unmatched(left, rows(spark, ["docs"], 0, "other"), "k").where("k = 'other'").collect()) == [101]


def test_a_hot_group_of_ten_thousand_items(spark):
    dice = random.Random(7)
    words = [f"{c}{n}" for n in range(60) for c in ("fix", "docs", "pipeline", "x")] + ["still", "the", "extraordinarily"]
    some = lambda: " ".join(dice.choice(words) for _ in range(dice.choice((2, 3, 5, 8))))
    left = [some() for _ in range(5000)]
    right = [some() for _ in range(3500)] + [t[dice.randrange(3) : len(t) - dice.randrange(3)].strip() for t in left[:1000]] + left[:500]
    ordered = {}
    for n, t in enumerate(right):
        ordered.setdefault(t, n)
    split = [(n, t, frozenset(t.split(" ")) - {"", *STATE_STOPWORDS}) for t, n in ordered.items()]

    def first(a):
        x = frozenset(a.split(" ")) - {"", *STATE_STOPWORDS}
        hits = [n for n, b, y in split if a == b or (len(a) >= 18 and a in b) or (len(b) >= 18 and b in a) or (x and y and (x <= y or y <= x))]
        return min(hits, default=None)

    want = {n: first(t) for n, t in enumerate(left)}
    a, b = rows(spark, left), rows(spark, right)
    found = {r.id: r.match.id for r in fuzzy.first_matches(a, b, "k", ["id"], ["id"]).collect()}
    assert found == {n: m for n, m in want.items() if m is not None} and 1000 < len(found) < 5000
    assert {r.id for r in fuzzy.unmatched(a, b, "k").collect()} == set(want) - set(found)
    both = fuzzy.changed(a, b, "k").groupBy("change").agg(F.count("*").alias("n")).collect()
    assert {r.change for r in both} == {"added", "removed"} and dict(both)["added"] == 5000 - len(found)


def test_one_join_of_long_texts_serves_both_changes(spark, monkeypatch):
    dice = random.Random(3)
    some = lambda n: [f"{dice.choice('abc')}{dice.randrange(400)}{'x' * dice.randrange(12)}" for _ in range(n)]
    long = [some(dice.choice((70, 150, 300))) for _ in range(60)]
    left = [" ".join(t) for t in long] + ["the", "still yet"]
    right = [" ".join(t[1:-1]) + w for t, w in zip(long[:20], ("", " other") * 10, strict=True)] + [" ".join(reversed(t)) for t in long[20:30]] + [" ".join(t)[1:-1] for t in long[30:40]] + [t[5] for t in long[40:45]] + ["the"]
    made, cut = [], fuzzy.cut
    monkeypatch.setattr(fuzzy, "cut", lambda df: made.append(df.columns) or cut(df))
    found = {(r.id, r.change) for r in fuzzy.changed(rows(spark, left), rows(spark, right, 1000), "k").collect()}
    want = {(n, "added") for n, a in enumerate(left) if not any(brute(a, b) for b in right)}
    assert found == want | {(1000 + n, "removed") for n, b in enumerate(right) if not any(brute(a, b) for a in left)} and len(found) > 20
    assert sum("text" in c for c in made) == 2 and not any("term" in c and "way" not in c for c in made)  # no table of all texts' terms
    monkeypatch.setattr(fuzzy, "BROADCAST", -1)  # as with many
    assert found == {(r.id, r.change) for r in fuzzy.changed(rows(spark, left), rows(spark, right, 1000), "k").collect()}
