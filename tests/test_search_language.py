"""The search language beside SQLite's own full-text search: hits and ranks, from texts and from the index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from continuo.operators import retrieval, search
from continuo.sources.store import word_counts

WORDS = ["alpha", "beta", "gamma", "delta", "alphabet", "ein", "zwei"]
QUERIES = [
    "NEAR(alpha beta, 2)", 'NEAR("alpha beta" gamma)', "^alpha", "title : ^alpha", "NEAR(alpha beta)", "NEAR(alpha beta, 0)", "NEAR(alpha beta gamma, 1)", 'NEAR("alpha beta" "gamma delta", 3)',
    "NEAR(alph* beta, 1)", "NEAR(alpha)", "summary : NEAR(alpha beta, 2)", "{title detail} : NEAR(beta gamma, 1)", "- title : NEAR(beta gamma, 1)", "NEAR(alpha alpha, 3)", "NEAR(alpha beta, 2) OR delta",
    "NEAR(alpha beta, 2) NOT delta", "NEAR(alpha beta, 2) NEAR(gamma delta, 2)", "NEAR(alpha beta, 2) AND ^gamma", '^"alpha beta"', "^alph*", "^alpha ^beta", "alpha ^beta", "^alpha + beta", "alpha beta OR gamma", "alpha OR beta gamma",
    "(alpha beta) OR (gamma delta)", "alpha NOT beta OR gamma", "alpha AND (beta OR gamma delta)", "(alpha NOT (beta gamma)) OR delta", 'NEAR("--" alpha beta, 1)', "alpha beta gamma OR NEAR(ein zwei, 1)", "title : (alpha OR ^beta)",
]
WRONG = ["NEAR()", "NEAR(alpha beta", "NEAR(alpha beta,)", "NEAR(alpha beta, x)", "NEAR(^alpha beta)", "^", "alpha ^", '"NEAR"(alpha beta)', "near(alpha beta)", "NEAR(alpha AND beta)", "^(alpha)"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    some = lambda: " ".join(r.choices(WORDS, weights=[5, 5, 3, 3, 1, 2, 2], k=r.randint(0, 9)))
    return [(k, some(), some(), some()) for k in range(150)]


@pytest.fixture(scope="module")
def fts(texts):
    made = sqlite3.connect(":memory:")
    made.execute("CREATE VIRTUAL TABLE t USING fts5(title, summary, detail)")
    made.executemany("INSERT INTO t(rowid, title, summary, detail) VALUES (?, ?, ?, ?)", texts)
    return made


def test_hits_and_ranks_equal_those_of_fts5(spark, texts, fts):
    rows = spark.createDataFrame([(*t, "p", "b") for t in texts], "id long, title string, summary string, detail string, project_key string, batch string").cache()
    postings = search.posting_rows(rows).cache()
    sums = word_counts(rows).agg(F.sum("rows").alias("n"), (F.sum("words") / F.sum("rows")).alias("avg_dl"))
    for query in QUERIES:
        want = dict(fts.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,)))
        tree, phrases = search.parse(query)
        by_text = {r.id: r.rank for r in retrieval.bm25(rows, query).collect()}
        by_index = {r.id: r.rank for r in search.ranked(search.counts_in_postings(postings, phrases), tree, sums).collect()}
        for got in (by_text, by_index):
            assert got.keys() == want.keys(), query
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want), query
    rows.unpersist()
    postings.unpersist()


def test_what_is_no_query_of_the_language(fts):
    for query in WRONG:
        with pytest.raises(sqlite3.OperationalError):
            fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,)).fetchall()
        assert search.parse(query) is None, query


def test_near_groups_cost_what_their_places_cost(spark):
    """A text that repeats the words of a group hundreds of times is counted at once, in any reach."""
    import time

    rows = spark.createDataFrame([(1, "p", "", "", "und der x " * 400), (2, "p", "", "", "und x x x x der " * 400)], "id long, project_key string, title string, summary string, detail string")
    began = time.time()
    for query, wanted in (("NEAR(und der, 2)", {1: (400, 400), 2: (399, 399)}), ("NEAR(und der, 0)", {1: (400, 400), 2: (399, 399)}), ("NEAR(und der, 90)", {1: (400, 400), 2: (400, 400)})):
        phrases = search.parse(query)[1]
        for found in (search.counts_in_texts(rows, phrases), search.counts_in_postings(search.posting_rows(rows), phrases)):
            assert {r.id: (r.f0, r.f1) for r in found.collect()} == wanted, query
    assert time.time() - began < 60
