import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from continuo.llm import byte_tokens, impact_search, merkle, queries, slack_packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, grp string, term string, number int"
TEXTS = [None, "", " \n ", "one Word", "ONE word", "x" * 70_000, "Übung macht den MEISTER, it's <|endoftext|> 42. a\x1cb", "w " * 9_000]


def docs(spark, rows):
    """(doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, g, None if d == 4 else "s", None if t is None else len(t), 1, "g", "t", 5) for d, t, g in rows], DOCS)


def edge_rows():
    rows = [(k, t, g) for k, (t, g) in enumerate(itertools.product(TEXTS, [None, "", "en"]))]
    return rows + rows[:5] * 3 + [(None, "no number", "en"), (None, None, None), (3, "other", "en")]


# -- the manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    doc_id, _, lang = row
    values = [doc_id, None if doc_id == 4 else "s", lang, None if row[1] is None else len(row[1]), text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The root, and for every node its siblings by level as (those before, those behind)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 8 * 8
            path.append((nodes[run : at[k]], nodes[at[k] + 1 : run + 8]))
            at[k] //= 8
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row, row[1]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = climb([trees[g][0] for g in order])
    out = []
    for g, upper in zip(order, above, strict=True):
        for (_, _, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            text = re.sub("[A-Z]", lambda m: m[0].lower(), row[1]) if hit else row[1]
            now = plain_leaf(row, text)
            for left, right in path + upper:
                now = sha(*left, now, *right)
            out.append((row[0], leaf, trees[g][0], root, sha(*[x for left, right in path + upper for x in left + right]), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("depth", "top"), [(4, 8_192), (1, 2)])
def test_manifest_against_brute_force(spark, depth, top):
    rows = edge_rows() + [(100 + k, f"Text {k}", "de") for k in range(150)] + [(1000 + k, "a", f"l{k}") for k in range(30)]
    got = merkle.manifest(docs(spark, rows), merkle.tampered_text(), depth=depth, top=top).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(docs(spark, [])).count() == 0
    (only,) = merkle.manifest(docs(spark, [(1, "a", None)])).collect()
    assert only["root"] == only["subroot"] == only["leaf"] == only["folded_root"] and only["proof_sha256"] == sha()


# -- byte-level ids and packing by minimum bin slack


def test_units_equal_whole_texts():
    tokenizer, r = byte_tokens.UnitTokenizer(queries.byte_tokenizer_path()), random.Random(1)
    parts = ["a", "bc", "'s", " ", " ", "\n", "\t", "\r", "é", "1", ".", ",", "\x1c", "\x85", "<|endoftext|>", "　", "!?", "日", "Ab"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert tokenizer.ids(text) == tokenizer._encode(text), repr(text)


def test_fullest_combination_against_all_subsets():
    r = random.Random(2)
    for _ in range(300):
        room, lengths = r.randint(0, 60), [r.randint(1, 40) for _ in range(r.randint(0, 9))]
        got = slack_packing.fullest(Counter(lengths), room)
        best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room)
        assert sum(got) == best and not Counter(got) - Counter(lengths)


def test_plan_places_every_number_once_and_stays_small():
    r = random.Random(3)
    counts = {x: r.randint(1, 10**12) for x in range(1, 1025)}
    rows = slack_packing.plan(counts)
    assert len(rows) < 20_000
    counts = {x: r.randint(1, 40) for x in range(1, 1025)}
    rows, filled = slack_packing.plan(counts), Counter()
    for (length, first, sequence, each, _), behind in zip(rows, [*rows[1:], (0,)], strict=True):
        for number in range(first, behind[1] if behind[0] == length else counts[length]):
            filled[sequence + (number - first) // each] += length
    total = sum(x * n for x, n in counts.items())
    least = max(total / 1024, sum(n for x, n in counts.items() if x > 512))  # no two of those fit
    assert sum(filled.values()) == total and max(filled.values()) <= 1024 and len(filled) <= least * 1.01 + 1


def check_packed(rows, texts, size=1024):
    """rows of (doc_id, piece, start, length, crc, sequence, offset) hold all ids of texts, cut as agreed."""
    tokenizer = byte_tokens.load(queries.byte_tokenizer_path()).tokenizer
    wanted, fill = Counter(), defaultdict(list)
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = sorted({0, *range(len(ids) % size or min(size, len(ids)), len(ids), size)})
        for piece, (a, b) in enumerate(itertools.pairwise([*cuts, len(ids)])):
            wanted[doc_id, piece, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == wanted
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    return len(fill)


def test_slack_packing_is_exact_and_tight(spark, sf):
    rows = queries.op12_slack_packing(spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sequences = check_packed(rows, texts)
    assert sequences <= math.ceil(sum(r["length"] for r in rows) / 1024) * 1.02


@pytest.mark.parametrize("size", [1024, 7])
def test_slack_packing_edges(spark, size):
    rows = edge_rows() + [(1, "copy of a text", "en")] * 40
    got = slack_packing.pack(docs(spark, rows).repartition(5), queries.byte_tokenizer_path(), 2, size).collect()
    check_packed(got, [r[:2] for r in rows], size)
    assert slack_packing.pack(docs(spark, []), queries.byte_tokenizer_path()).count() == 0


# -- ranked search


def plain_search(rows, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(d, Counter(w), len(w)) for d, t, *_ in rows if (w := cut(t))]
    n, total = len(found), sum(x[2] for x in found)
    df, terms = Counter(t for _, c, _ in found for t in c), defaultdict(set)
    for item, text in items:
        terms[item] |= set(cut(text))
    out = []
    for item, own in terms.items():
        scored = []
        for d, c, length in found:
            m = 10 + 90 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank + 1, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("segment", "step", "passed"), [(4096, 1024, 200_000), (30, 1, 60)])
def test_ranked_search_against_brute_force(spark, monkeypatch, segment, step, passed):
    monkeypatch.setattr(impact_search, "PASS_TERMS", passed)
    monkeypatch.setattr(impact_search, "FIRST_STEP", step)
    r, words = random.Random(5), [f"w{k}" for k in range(60)] + ["Ünder", "日本", "ONE", "word"]
    some = [(200 + k, " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(64)], k=r.randint(1, 90))), "en") for k in range(300)]
    rows = edge_rows() + some + [(900 + k, "w5 w6 w5 same text", "en") for k in range(40)]
    items = [(k, " ".join(r.choices(words, k=12))) for k in range(12)] + [(50, None), (51, "--"), (52, "unheard"), (53, "w5 w6"), (53, "W5 w9"), (54, "w1 " * 500), (None, "one")]
    table = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, segment string")
    got = impact_search.search(docs(spark, rows).repartition(3), table, 10, segment)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, items)


def test_ranked_search_of_nothing(spark):
    table = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert impact_search.search(docs(spark, []), table).count() == 0
    assert impact_search.search(docs(spark, [(1, "one", "en")]), table.where("item_id = 2")).count() == 0


def test_bound_stops_before_all_postings(monkeypatch):
    """A segment with one rare and one common term: the rare term's documents are proven without the common list."""
    import pyarrow as pa

    rows = [("rare", 1_000, [3]), ("rare", 900, [9]), ("common", 5, list(range(500))), ("common", 4, list(range(500, 3_000)))]
    table = pa.table({"term": [r[0] for r in rows], "impact": pa.array([r[1] for r in rows], pa.int64()), "slots": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})
    seen, add = [], impact_search._ranges
    monkeypatch.setattr(impact_search, "_ranges", lambda b, s: seen.append(int(s.sum())) or add(b, s))
    monkeypatch.setattr(impact_search, "FIRST_STEP", 1)
    assert impact_search.Segment(table).best({0: ["rare", "common"]}, 2) == [(0, 3, 1_005), (0, 9, 905)]
    assert sum(seen[:-1]) == 2


def test_frequency_beyond_the_vocabulary_limit_indexes_all_terms(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "PASS_TERMS", 1)
    rows = [(1, "a b c", "en"), (2, "c d", "en")]
    index = impact_search.ImpactIndex(docs(spark, rows), spark.createDataFrame([("a",), ("b",)], "term string"))
    assert index.weights.count() == 4 and index.groups.where(F.col("term") == "d").count() == 1
