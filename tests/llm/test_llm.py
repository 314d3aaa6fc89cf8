import base64
import gc
import hashlib
import json
import math
import random
import threading
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from continuo.llm import ann, chat_format, common, language_id, minhash, packing, queries, sharding, substring_dedup, token_output, tokens, url_filter
from continuo.llm.decontaminate import PositionalIndex

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, __extra string"
EDGE = [(5, None), (4, ""), (3, " \n "), (3, " \n "), (2, "one word"), (2, "one word"), (None, "one word"), (7, "x" * 70_000), (8, "Übung macht den MEISTER, it's <|endoftext|> 42.\u2003a\x1cb"), (9, "w " * 30_000)]


def docs(spark, pairs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "e") for d, t in pairs], DOCS)


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted([tuple(None if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, sf).toPandas()) == plain(con.sql(queries.ORACLES[name]).df())


def collected(spark):
    for _ in range(5):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
        spark.range(3).count()  # Spark keeps the last plan for a while
        common.sweep(spark)


def test_temporary_tables_live_as_long_as_their_results(spark, sf):
    collected(spark)
    before = len(common._tables)
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    first = sharding.shard(docs_, 3)
    second = corpus_pipeline.language_stage(spark, docs_, sf)
    collected(spark)
    assert first.count() == second.count() == docs_.count()
    kept = first.where("shard = 0")
    del first, second
    collected(spark)
    assert kept.count() > 0
    del kept
    collected(spark)
    assert len(common._tables) <= before


def test_two_runs_in_one_driver(spark, sf):
    found = {}

    def run(k):
        found[k] = queries.op5_decontamination(spark, sf).where("contaminated").count()

    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found[0] == found[1] > 0


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        getConf = property(lambda self: lambda: self)

    for master, fine in (("spark://host:7077", False), ("local-cluster[2,1,900]", False), ("yarn", False), ("local[2]", True)):
        fake = type("Session", (), {"sparkContext": Conf({"spark.master": master}), "conf": Conf()})
        if fine:
            assert common.shared_dir(fake).startswith("file://")
        else:
            with pytest.raises(RuntimeError):
                common.shared_dir(fake)


def test_tokenizer_parts_equal_whole_texts():
    t = tokens.load(queries.tokenizer_path())
    assert t.by_parts
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["don't", " ", "\n", "ÀÉ", "straße", "e\u0301", ".", ",,", "x1y", "日本", "<|endoftext|>", "\x1c", "\u00a0", "Word"]) for _ in range(30))
        assert np.frombuffer(t.ids(text), t.dtype).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(text, end):
    t = tokens.load(queries.tokenizer_path())
    return np.array([*t.tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_packing_is_exact_and_tight(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: ids_of(r.text, 2) for r in table.collect()}
    rows = packing.pack(table, queries.tokenizer_path()).collect()
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in whole.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all


@pytest.mark.parametrize("pairs", [EDGE, []])
@pytest.mark.parametrize("pending", [300, 4_000_000])
def test_packing_edges(spark, monkeypatch, pairs, pending):
    monkeypatch.setattr(packing, "PENDING", pending)  # 300: packed again and again while documents come
    pairs = [*pairs, *[(100 + k, "some words " * (k * k)) for k in range(len(pairs) * 3)], *[(2**60 + 1, "x")] * len(pairs)]
    rows = packing.pack(docs(spark, pairs).coalesce(1), queries.tokenizer_path()).collect()
    whole = Counter((d, len(ids_of(t, 2))) for d, t in pairs)
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == whole
    assert sum(r.length for r in rows) == sum(n * k for (_, n), k in whole.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0
    for d, n in whole:
        assert sum(r.length for r in rows if (r.doc_id, r.doc_tokens) == (d, n)) == n * whole[d, n]


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
@pytest.mark.parametrize("pairs", [EDGE, []])
def test_sharding_laws(spark, monkeypatch, law, pairs):
    monkeypatch.setattr(sharding, "COPY_BLOCK", 4)
    pairs = [*pairs, *pairs[:1] * 11, *pairs[5:6] * 9]  # rows that are repeated often
    rows = sharding.shard(docs(spark, pairs), 3, law).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, crc(t)) for d, t in pairs)
    if law == "bytes":
        assert all(len({r.shard for r in rows if (r.size, r.text_crc32) == (x.size, x.text_crc32)}) == 1 for x in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert law != "key" or r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows" and pairs:
        assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(3)) <= 1


def test_sharding_balances_and_keeps_groups(spark, sf):
    rows = queries.op1_sharding(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in text.items()}
    sizes, shards = Counter(), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        shards[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    group = Counter()
    for t in text.values():
        group[t] += len(t.encode()) + 8
    assert max(sizes.values()) <= max(1.02 * sum(sizes.values()) / 24, max(group.values()))


def test_best_fit_takes_the_tightest_bin():
    assert sharding.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    r = random.Random(3)
    sizes = sorted((r.randrange(1, 900) for _ in range(3000)), reverse=True)
    bins = sharding.best_fit(sizes, 1000)
    load = Counter()
    for s, b in zip(sizes, bins, strict=True):
        load[b] += s
    assert max(load.values()) <= 1000 and len(load) <= 1.05 * sum(sizes) / 1000 + 1


def test_language_held_out_accuracy_and_edges(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("lang"))
    rows = language_id.identify(table.select("doc_id", "text", hidden.alias("declared"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("suffix")))
    truth = {r.doc_id: r.lang for r in table.collect()}
    held = [(r.language, truth[r.doc_id]) for r in rows.collect() if r.doc_id % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    more = table.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(-1, None, None, None), (-2, "12 %%", "xx", "s"), (None, "", "en", "")], "doc_id long, text string, lang string, source string"))
    judged = {r.doc_id: r.kept for r in language_id.identify(queries.language_rows(more)).collect()}
    assert not judged[-1] and not judged[-2] and sum(judged.values()) == 1000
    assert language_id.identify(queries.language_rows(docs(spark, []))).count() == 0


def brute_languages(rows):
    """The fusion by dictionaries, row by row; only the fitted tables are the operator's."""
    model = language_id.fit(rows)
    names, n = model.languages, len(model.languages)
    read = []
    for r in rows.collect():
        data = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        grams = language_id.trigrams(data) if len(data) > 2 else np.zeros(0, int)
        scores = [float(sum(np.float64(table[g]) for g in grams)) for table in model.table]
        letters = sum(1 for b in data if b >= 128 or chr(b).isalpha())
        size = max(len(grams), 1)
        known = letters >= language_id.LETTER_SHARE * (len(grams) + 2) and any(s / size >= f - language_id.SHORT / math.sqrt(size) for s, f in zip(scores, model.floors, strict=True))
        scale = min(1.0, language_id.EFFECTIVE / size)
        read.append((r, letters, known, [s * scale for s in scores]))
    sure = [(r, s.index(max(s))) for r, letters, known, s in read if letters >= language_id.LETTERS and known]
    overall = Counter(k for _, k in sure)
    top = [(overall[k] + 1) / (len(sure) + n) for k in range(n)]

    def share(key, value, parent):
        counts = Counter(k for r, k in sure if r[key] == value)
        return [(counts[k] + language_id.STRENGTH * parent[k]) / (sum(counts.values()) + language_id.STRENGTH) for k in range(n)]

    out = {}
    seen = {c: {r[c] for r, _ in sure} - {None} for c in ("host", "suffix", "declared")}
    for r, letters, known, scores in read:
        by_suffix = share("suffix", r.suffix, top) if r.suffix in seen["suffix"] else None
        fused = [s + math.log(t) for s, t in zip(scores, top, strict=True)]
        above = share("host", r.host, by_suffix or top) if r.host in seen["host"] else by_suffix
        told = share("declared", r.declared, top) if r.declared in seen["declared"] else None
        for e in (above, told):
            fused = [f + math.log(x / t) for f, x, t in zip(fused, e or top, top, strict=True)]
        most = max(fused)
        posterior = 1 / sum(math.exp(f - most) for f in fused)
        enough = letters >= language_id.LETTERS
        name = (names[fused.index(most)] if known else "unknown") if enough else None
        out[r.doc_id] = (name, posterior, enough and known and posterior >= language_id.CONFIDENT)
    return out


def same_languages(got, truth):
    assert {r.doc_id for r in got} == set(truth)
    for r in got:
        name, posterior, kept = truth[r.doc_id]
        assert (r.language, r.kept) == (name, kept) and abs(r.posterior - posterior) < 1e-6, (r, truth[r.doc_id])


def test_language_fusion_against_brute_force(spark, sf):
    d = F.col("doc_id")
    declared = F.when(d % 5 == 0, F.lit(None)).when(d % 7 == 0, F.translate("lang", "ed", "fr")).when(d % 11 == 0, "fr").otherwise(F.col("lang"))
    place = {"host": F.when(d % 3 > 0, F.concat("source", F.lit(".org"))), "suffix": F.when(d % 3 > 0, F.lit("org")).when(d % 4 == 0, F.col("lang"))}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.select("doc_id", "text", declared.alias("declared"), *[x.alias(c) for c, x in place.items()])
    more = [(-1, None, None, "src1.org", "org"), (-2, "12 %%", "xx", "new.org", "org"), (-3, "", "en", None, None), (-4, "der", "de", None, "zz"), (-5, "zq", "fr", "src2.org", "org")]
    rows = common.materialize(rows.unionByName(spark.createDataFrame(more, rows.schema)), "language-test")
    got = language_id.identify(rows).collect()
    same_languages(got, brute_languages(rows))
    # long texts decide against wrong declarations
    truth = {r.doc_id: r.lang for r in table.where("length(text) > 600").collect()}
    told = [r.language == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id % 5 and r.doc_id % 7 and r.declared != truth[r.doc_id]]
    assert len(told) > 3 and all(told)


def test_language_of_pages_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = common.materialize(queries.page_rows(pages), "page-test")
    assert rows.where("text like '%<%' or text like '%script%'").count() < pages.count() / 10
    same_languages(queries.language_id_pages(spark, sf).withColumnRenamed("page_id", "doc_id").collect(), brute_languages(rows))


def test_language_rejects_what_no_modelled_language_explains(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {
        "random": lambda: "".join(r.choices(letters, k=600)),
        "words": lambda: " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(100)),
        "base64": lambda: base64.b64encode(r.randbytes(450)).decode(),
        "cyrillic": lambda: " ".join(r.choices("привет мир это русский текст который когда можно сказать человек".split(), k=80)),
        "chinese": lambda: "".join(r.choices("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年", k=200)),
        "tags": lambda: '<div class="a"><span></span></div>' * r.randint(10, 30),
        "digits": lambda: " ".join(str(r.randint(0, 10**6)) for _ in range(90)) + " abc",
        "italian": lambda: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita " * r.randint(1, 4),
    }
    junk = [(-1 - k, make(), None if k % 10 else "en", "src0") for k, make in enumerate(m for m in kinds.values() for _ in range(10))]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    judged = language_id.identify(queries.language_rows(table.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string")))).collect()
    assert [(x.doc_id, x.language) for x in judged if x.doc_id < 0 and (x.language, x.kept) != ("unknown", False)] == []
    assert sum(x.kept for x in judged if x.doc_id >= 0) == table.count()  # every clean document stays
    assert language_id._typical(["one text"]) == (["one text"], -np.inf)
    english = [r.text for r in table.where("lang = 'en' and length(text) > 200").limit(60).collect()]
    odd = [kinds[k]() for k in ("random", "tags", "cyrillic", "digits")]
    assert sorted(language_id._typical([*english, *odd])[0]) == sorted(english)  # declared junk teaches nothing


def test_languages_of_long_or_short_texts_only_are_modelled(spark, sf):
    """French texts longer than any window teach, and so do short ones of a language without others."""
    table = spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('fr', 'en') and length(text) > 40").select("doc_id", "text", "lang")
    longer = F.expr(f"repeat(concat(text, ' '), cast(ceil({language_id.SAMPLE_CHARS + 1} / length(text)) as int))")
    rows = table.select("doc_id", F.when(F.col("lang") == "fr", longer).otherwise(F.col("text")).alias("text"), F.col("lang").alias("declared"))
    junk = [(90_000 + k, t, "fr") for k, t in enumerate(["12 %% 34", "=" * 9_000, None])]
    short = [(91_000 + k, f"zyx qqv{k % 7}", "zz") for k in range(30)]
    rows = rows.unionByName(spark.createDataFrame(junk + short, "doc_id long, text string, declared string"))
    none = {c: F.lit(None).cast("string") for c in ("host", "suffix")}
    got = language_id.identify(rows.withColumns(none)).collect()
    french = [r for r in got if r.declared == "fr" and r.doc_id < 90_000]
    assert len(french) > 10 and all(r.kept and r.language == "fr" for r in french)
    assert not any(r.kept for r in got if 90_000 <= r.doc_id < 91_000)
    assert all(r.kept and r.language == "zz" for r in got if r.doc_id >= 91_000)


def test_letters_alone_decide_without_declared_languages(spark):
    texts = ["plain words", "日本語", None, "", "  ", "12 %%", "ab", "a1234567890b1234567890c1234567890"]
    rows = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], "doc_id long, text string, declared string, host string, suffix string")
    got = {r.doc_id: (r.kept, r.language) for r in language_id.identify(rows).collect()}
    assert got == {k: (k < 2, None) for k in range(len(texts))}


def test_language_sample_has_every_language_and_names_the_rest_unknown(spark, monkeypatch):
    r = random.Random(5)
    sounds = {x: ["".join(r.choices("bcdfghklmnprstvwz", k=1)) + "".join(r.choices("aeiouy", k=2)) for _ in range(9)] for x in ("aa", "bb", "cc", "dd")}
    make = lambda x, k: f"{x}{k} " + " ".join("".join(r.choices(sounds[x], k=3)) for _ in range(60))
    texts = {x: [make(x, k) for k in range(10 if x == "bb" else 40)] for x in sounds}
    copies = {"aa": 30, "bb": 120, "cc": 30, "dd": 1}  # bb: 10 texts, 1,200 rows, which the old share could leave out wholly
    rows = [(x, t) for x in sounds for t in texts[x] for _ in range(copies[x])]
    frame = spark.createDataFrame([(k, t, x, "s") for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    monkeypatch.setattr(language_id, "SAMPLE", 12)
    seen = {}
    monkeypatch.setattr(language_id, "TrigramModel", lambda labelled, make=language_id.TrigramModel: seen.update(labelled) or make(labelled))
    got = defaultdict(set)
    for x in language_id.identify(queries.language_rows(frame)).collect():
        got[x.declared].add((x.language, x.kept))
    assert {k: (len(v), len(set(v))) for k, v in seen.items()} == {"aa": (12, 12), "bb": (10, 10), "cc": (12, 12)}
    assert got == {"aa": {("aa", True)}, "bb": {("bb", True)}, "cc": {("cc", True)}, "dd": {("unknown", False)}}


def brute_cut(pairs, window):
    words = [(d, (t or "").split()) for d, t in pairs]
    first = {}
    for d, w in words:
        for k in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = {p for k in range(len(w) - window + 1) if d is not None and first[tuple(w[k : k + window])] < d for p in range(k, k + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(7)
    pool = [[f"w{r.randrange(40)}" for _ in range(r.randrange(8, 60))] for _ in range(12)]
    pairs = [(r.randrange(60), " ".join(sum((r.choice(pool)[: r.randrange(1, 60)] for _ in range(4)), []))) for _ in range(90)]
    pairs += [(d, t) for d, t in EDGE if d != 8] + [(100, None), (None, pairs[0][1])]
    cut = substring_dedup.remove_repeats(docs(spark, pairs), window=12, gram=4)
    assert set(DOCS.replace(" long", "").replace(" string", "").split(", ")) < set(cut.columns)
    got = sorted([(x["doc_id"], x["__n_words"], x["__n_removed"], x["__kept_sha256"]) for x in cut.collect()], key=repr)
    assert got == brute_cut(pairs, 12)
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_decontamination_edges_and_proximity(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "a b c d e f g h i j k l"), (3, None), (4, "..."), (2, "a b c d e f g h i j k l"), (5, "lone")], "item_id long, text string")
    pairs = [*EDGE, (20, "x ALPHA-beta y"), (21, "b c d e f g h i j k"), (22, "a b c d e f g h i X j k l"), (23, "beta z alpha"), (24, "lone lone")]
    index = PositionalIndex(docs(spark, pairs), items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in index.hits().collect()}
    assert len(index.hits().collect()) == len(pairs)
    assert got[20] == (4, 2, 1, True) and got[21] == (10, 10, 1, True) and got[22][1:] == (0, 0, False) and got[23][1:] == (0, 0, False) and got[24] == (2, 2, 1, True) and got[5] == (0, 0, 0, False)
    items_ = {r.item_id: r.text for r in items.collect()}
    words = lambda t: [x for x in "".join(c.lower() if c.isascii() else c for c in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t or "")).split(" ") if x]
    texts = [(d, words(t)) for d, t in pairs]
    often = Counter(x for _, w in texts for x in w)
    for slop in (0, 2, 30):
        want = set()
        for i, t in items_.items():
            own = set(words(t))
            rare = min(own, key=lambda x: (often[x], x.encode()), default=None)
            reach = len(words(t)) + slop
            for d, w in texts:
                for at in (p for p, x in enumerate(w) if x == rare):
                    if own <= set(w[max(0, at - reach) : at + reach + 1]):
                        want.add((d, i, at))
        assert {tuple(r) for r in index.proximity(slop).collect()} == want
    assert PositionalIndex(docs(spark, []), items).hits().count() == 0
    assert PositionalIndex(docs(spark, pairs), items.limit(0)).hits().where("contaminated").count() == 0


def shuffled_rows(spark):
    store, none = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_proximity_meets_common_words_near_rare_ones_only(spark):
    """A word of many items is not dealt out once for each of them wherever it stands."""
    docs = [(k, " ".join(f"the w{k}x{j}" if j % 50 else f"a{k} the the b{k}" for j in range(500))) for k in range(60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(k, f"a{k} the b{k}") for k in range(60)], "item_id long, text string")
    index = PositionalIndex(docs, items)
    before = shuffled_rows(spark)
    got = index.proximity(2).groupBy("doc_id", "item_id").count().collect()
    assert sorted(map(tuple, got)) == [(k, k, 10) for k in range(60)]
    assert shuffled_rows(spark) - before < 30_000  # 31,000 times the word, 60 items


def brute_near(vectors, queries_, k):
    out = {}
    for q, v in queries_:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in vectors if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


def recall_of(rows, got, k=10):
    """The mean recall; ids, ranks and scores of what was found must be exact."""
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    place, found = {i: p for p, i in enumerate(ids)}, defaultdict(list)
    for r in got:
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    shares = []
    for q, list_ in found.items():
        list_.sort()
        d = np.sqrt(((vectors - vectors[place[q]]) ** 2).sum(axis=1))
        d[place[q]] = np.inf
        assert [x[0] for x in list_] == list(range(1, k + 1))
        assert np.allclose([x[2] for x in list_], d[[place[x[1]] for x in list_]], rtol=1e-12)
        assert [x[1] for x in list_] == [x[1] for x in sorted(list_, key=lambda x: (x[2], x[1]))]
        shares.append(len({x[1] for x in list_} & set(ids[np.lexsort((ids, d))[:k]].tolist())) / k)
    return np.mean(shares)


def test_neighbours_recall(spark):
    rows = [(r.vec_id, [float(np.float32(x)) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 100 = 0 or vec_id % 7 = 0")
    got = ann.search(table, asked).collect()
    assert len(got) == 10 * asked.count() and recall_of(rows, got) >= 0.9
    big = [(r.vec_id, [float(np.float32(x)) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert recall_of(big, queries.op6_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()) >= 0.9


def test_neighbours_in_clusters_and_parts(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 20))
    vectors = centres[r.integers(0, 30, 1500)] + 0.05 * r.normal(size=(1500, 20))
    vectors[:400] = centres[0] + 1e-9 * r.normal(size=(400, 20))  # a hot cell of vectors that are almost one
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (60, 4000):
        assert recall_of(rows, ann.search(table, table.where("vec_id % 20 = 0"), block=block).collect()) >= 0.95


def test_functions_of_a_table_follow_the_number_of_vectors():
    assert ann.functions_of(500, 64) == [64, 4] and ann.functions_of(50_000, 64) == [64, 16]
    assert ann.functions_of(10**9, 64)[:2] == [64, 64] and ann.functions_of(10**6, 1) == [2] * 8 + [2]
    for n, d in ((500, 64), (50_000, 64), (10**7, 100), (10**9, 64)):
        cells = math.prod(2 * a for a in ann.functions_of(n, d))
        assert n / cells <= 2 * ann.CELL_ROWS


def test_neighbours_edges(spark):
    few = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, []), (None, [1.0, 0.0, 0.0]), (8, [1.0, 2.0]), (100, [1.0, 0.1, 0.0])]
    table = spark.createDataFrame([(*x, "e", 1.0) for x in few], "vec_id long, embedding array<float>, rank string, score double")
    found = lambda t, q, k=10: [(r.query_id, r.rank, r.vec_id) for r in ann.search(t, q, k).orderBy("query_id", "rank").collect()]
    assert found(table, table.where("vec_id % 100 = 0")) == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert found(table.limit(0), table.limit(0)) == [] and found(table.limit(0), table) == []
    # many copies of one row, of one vector and of one id
    more = [(5, [1.0, 0.0])] * 30 + [(k, [1.0, 0.0]) for k in (6, 7, 8)] + [(9, [0.0, 1.0])] * 3 + [(9, [0.5, 1.0]), (10, [1e30, 1e30]), (11, [1e-30, 0.0])]
    table = spark.createDataFrame(more, "vec_id long, embedding array<double>")
    assert found(table, table.where("vec_id = 5").limit(1), 3) == [(5, 1, 6), (5, 2, 7), (5, 3, 8)]
    assert found(table, table.where("vec_id = 6"), 4) == [(6, k, 5) for k in (1, 2, 3, 4)]
    assert found(table, table.where("vec_id = 10"), 2) == [(10, 1, 5), (10, 2, 5)]  # equally far from all
    assert len(found(table, table.where("vec_id = 9"), 2)) == 4  # two vectors of one id are two queries


def test_chat_layouts_and_round_trip(spark):
    plain_ = [("user", "a"), ("assistant", "b")]
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":3}': ("messages", plain_),
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"prompt":"a"}': ("messages", plain_),
        '{"system":"s","messages":[{"role":"user","content":"a","name":1},7,{"role":"assistant","content":null}]}': ("messages", [("system", "s"), ("user", "a"), ("assistant", "")]),
        '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image","url":"x"}]},{"role":"assistant","content":"b"}]}': ("message_parts", [("user", "a\n"), ("assistant", "b")]),
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': ("conversations", plain_),
        '{"instruction":"a","input":"","output":"b"}': ("instruction", plain_),
        '{"instruction":"a","output":12.5}': ("instruction", [("user", "a"), ("assistant", "12.5")]), '{"instruction":"a","output":{"x":1}}': None,
        '{"prompt":"a","response":"b"}': ("prompt_response", plain_),
        '{"prompt":"a","completion":"b","system":" "}': ("prompt_completion", plain_),
        '{"question":"q","answer":"b","context":"c"}': ("question", [("user", "c\nq"), ("assistant", "b")]),
        '{"prompt":"a\\ud800","response":"b"}': ("prompt_response", [("user", "a\ufffd"), ("assistant", "b")]),
        "[1]": None, "{": None, None: None, '{"other":1}': None, '{"messages":[]}': None, "[" * 5000: None, '{"prompt":"only"}': None,
    }
    rows = spark.createDataFrame([(2**60 + k if r else None, r, "x") for k, r in enumerate(records)], "conv_id long, record string, turn string")
    got = defaultdict(list)
    for r in chat_format.records_to_turns(rows).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    for k, (r, want) in enumerate(records.items()):
        name, turns = want or (None, [(None, None)])
        assert got[2**60 + k if r else None] == [(name, *t) for t in turns], r
    assert chat_format.select_layout(["conv_id", "role", "text", "turn", "prompt", "response"]) == "turn_rows"
    prints = [p for layout in chat_format.LAYOUTS.values() for p in chat_format.prints_of(layout)]
    assert len(prints) == len(set(prints))  # every fingerprint selects one layout
    assert chat_format.schema_paths(spark.createDataFrame([], "a array<struct<b:int,c:array<string>>>, d string").schema) == {"a[]", "a[].b", "a[].c[]", "d"}
    nasty = ["\\### Assistant: </turn> ok", "<|turn|>a<|text|>", "<\\|end|>\\", "<", "|<|", "", None, "é😀<|end|>"]
    turns = spark.createDataFrame([(1, k, "assistant" if k % 2 else "us<|text|>er", t, "x", "y") for k, t in enumerate(nasty)] + [(None, None, None, None, "x", "y")], "conv_id long, turn long, role string, text string, prompt string, piece string")
    with pytest.raises(ValueError):
        chat_format.format_turns(turns.drop("role"))
    pieces = chat_format.format_turns(turns)  # further columns with names that layouts know or the operator makes
    back = [chat_format.parse_piece(r.piece) for r in pieces.where("conv_id = 1").orderBy("turn").collect()]
    assert back == [("assistant" if k % 2 else "us<|text|>er", t or "") for k, t in enumerate(nasty)]
    out = {r.conv_id: r for r in chat_format.digest(pieces).collect()}
    assert out[1].n_turns == 8 and out[1].loss_sha256 == hashlib.sha256("".join((t or "") for t in nasty[1::2]).encode()).hexdigest() and out[None].n_turns == 1
    assert chat_format.digest(pieces.limit(0)).count() == 0


def brute_components(pairs):
    sets, parent = {}, {}
    for d, t in pairs:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        if d is not None:
            sets[d], parent[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset(), d

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_classes_get_numbers_of_their_own(spark):
    rows = spark.createDataFrame([(h, g) for h in range(40) for g in range(3)], "h1 long, h2 long")
    numbers = [r["class"] for r in minhash.numbered(rows, F.col("h1") % 7).collect()]
    assert len(set(numbers)) == 120 and {*range(7)} < set(numbers)


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{r.randrange(9999)}" for _ in range(150)]
    pairs = []
    for k in range(250):
        words = list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(150)] = f"X{r.randrange(99999)}"
        pairs.append((3 * k + 1, " ".join(words)))
    pairs += [(5000 + k, " ".join(f"w{r.randrange(9999)}" for _ in range(60))) for k in range(40)]
    pairs += [(9000, None), (9001, ""), (9002, "A b C"), (9003, "a B c"), (1, pairs[0][1]), (9004, pairs[5][1]), (9005, "w " * 20_000)]
    got = minhash.near_duplicates(docs(spark, [*pairs, (None, pairs[0][1])])).collect()
    truth = brute_components(pairs)
    assert len(got) == len(pairs) + 1
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id) == truth[x.doc_id] and x.kept == (x.doc_id == x.component_id)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_token_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BUCKET_KEYS", 3)
    store = token_output.write_tokens(docs(spark, EDGE), queries.tokenizer_path())
    keys = spark.createDataFrame([(d if d is not None else token_output.NULL_KEY,) for d in {d for d, _ in EDGE}] + [(12345,)], "key long")
    got = sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.read(store.lookup(keys)).collect()], key=repr)
    at, want = 0, []
    for d, t in sorted(EDGE, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = ids_of(t, 1)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want, key=repr)
    empty = token_output.write_tokens(docs(spark, []), queries.tokenizer_path())
    assert empty.read(empty.lookup(keys)).count() == 0


def test_token_store_with_a_key_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BUCKET_KEYS", 40)
    monkeypatch.setattr(token_output, "SHARD_BYTES", 300)
    monkeypatch.setattr(token_output, "COPY_BLOCK", 7)
    r = random.Random(2)
    texts = [" ".join(r.choices("some few words of one key".split(), k=5)) for _ in range(150)]
    pairs = [(k, f"word {k}") for k in range(60)] + [(30, t) for t in texts] + [(31, "same")] * 90 + [(None, "none")] * 20
    store = token_output.write_tokens(docs(spark, pairs).repartition(5), queries.tokenizer_path())
    sizes = [n for *_, n in store.shards]
    assert len(store.shards) > 8 and sizes == sorted(sizes)
    rows = store.read(store.lookup(spark.createDataFrame([(token_output.NULL_KEY,), *((k,) for k in range(60))], "key long"))).collect()
    want = Counter((d, len(ids_of(t, 1)), zlib.crc32(ids_of(t, 1).tobytes())) for d, t in pairs)
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in rows) == want
    rows.sort(key=lambda x: x.start)
    assert [x.start for x in rows] == [0, *np.cumsum([x.n_tokens for x in rows])[:-1].tolist()]  # gapless
    order = [x.doc_id if x.doc_id is not None else -1 for x in rows]
    assert order == sorted(order)


def test_perfect_hash_is_minimal():
    hashes = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    table = token_output.PerfectHash.build(hashes)
    assert sorted(table.slots(hashes).tolist()) == list(range(20_000))


def test_url_edges(spark):
    urls = [None, "", "nothing", "http://Ex.COM", "a://b://c/d?e#f", "http://www.example.net/de/8x", "http://example.com/en/71", "http://xexample.com/en/7", "http://h.bad/x", "x://é.com/?"]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)] + [(50 + k, "http://h.bad/y", "h", "v") for k in range(30)], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([(50 + k, 1) for k in range(30)] + [(50, 0), (3, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, got[0][3])
    assert got[3][:2] == ("ex.com", "") and got[4][:2] == ("b:", "//c/d") and got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("example.com/en/7", "allow") and got[7][2:] == ("com/en/", "block") and got[8][3] == "block"
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_url_suffixes_and_domains(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "h0.com.sg": ("com.sg", "h0.com.sg"), "x.com": ("com", "x.com"), "com": ("com", "com"), "": ("", ""),
        "me:pw@www.x.org:8080": ("org", "x.org"), "10.0.0.7:80": ("", "10.0.0.7"), "a.b.github.io": ("github.io", "b.github.io"), "github.io": ("github.io", "github.io"), "u.a.b.c.d": ("a.b.c.d", "u.a.b.c.d"),
    }
    known = ("github.io", "a.b.c.d")
    rows = spark.createDataFrame([(h,) for h in want], "h string").select("h", url_filter.suffix_of(F.col("h"), known), url_filter.domain_of(F.col("h"), known)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want


def brute_reputation(hosts):
    """host: (n, bad, domain, suffix) to host: (mean, lower, blocked)."""
    def level(children, parent_of, means):
        prior = {c: means[parent_of[c]] for c in children}
        spread = {c: p * (1 - p) for c, p in prior.items()}
        over = sum(n * (b / n - prior[c]) ** 2 - spread[c] for c, (n, b) in children.items() if n)
        room = sum((n - 1) * spread[c] for c, (n, _) in children.items() if n)
        k = 1 / min(max(over / room if room else 0.5, 0.01), 0.5) - 1
        return {c: (b + k * prior[c]) / (n + k) for c, (n, b) in children.items()}, k

    def summed(place):
        out = defaultdict(lambda: [0, 0])
        for n, b, *rest in hosts.values():
            out[rest[place]][0] += n
            out[rest[place]][1] += b
        return out

    total = [sum(x[k] for x in hosts.values()) for k in (0, 1)]
    top = (total[1] + 0.5) / (total[0] + 1)
    suffixes, _ = level(summed(1), {x[3]: "all" for x in hosts.values()}, {"all": top})
    domains, _ = level(summed(0), {x[2]: x[3] for x in hosts.values()}, suffixes)
    means, k = level({h: x[:2] for h, x in hosts.items()}, {h: x[2] for h, x in hosts.items()}, domains)
    lower = {h: m - url_filter.Z * math.sqrt(m * (1 - m) / (hosts[h][0] + k + 1)) for h, m in means.items()}
    return {h: (means[h], lower[h], lower[h] > min(url_filter.MAX_BAD, url_filter.RATIO * top)) for h in hosts}


def test_url_reputation_against_brute_force(spark):
    r, rows, labels, hosts = random.Random(4), [], [], {}
    for d in range(12):
        suffix = ("com", "org", "co.uk")[d % 3]
        rate = (0.02, 0.05, 0.6)[(d // 2) % 3]
        for h in range(4):
            host = f"h{h}.d{d}.{suffix}"
            n = r.choice((0, 1, 8, 40))
            bad = sum(r.random() < rate for _ in range(n))
            hosts[host] = (n, bad, f"d{d}.{suffix}", suffix)
            for k in range(max(n, 1)):
                labels += [(len(rows), int(k < bad))] if k < n else []
                rows.append((len(rows), f"http://{host}/{k}"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {x.host: x for x in url_filter.judge(pages, spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()}
    want = brute_reputation(hosts)
    for h, (mean, lower, blocked) in want.items():
        assert (got[h].n, got[h].bad) == hosts[h][:2] and abs(got[h].mean - mean) < 1e-9 and abs(got[h].lower - lower) < 1e-9
        assert got[h].verdict == ("block" if blocked else "allow")
    assert {x[2] for x in want.values()} == {True, False}
    # a host without labels of a bad domain is blocked with it, one of a good domain is not
    assert any(want[h][2] for h in hosts if not hosts[h][0]) and any(not want[h][2] for h in hosts if not hosts[h][0])


def test_url_outcomes_are_those_of_the_document_in_the_path(spark, tmp_path):
    urls = ["http://h.a/en/7817?x=1", "http://h.a/en/7.html#t", "http://h.a/8/", "http://h.a/en/x9", "http://h.a/1/index", "http://h.a/en/" + "9" * 30, None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.document_of(F.col("url"))).collect()
    assert [r[0] for r in got] == [7817, 7, 8, None, None, None, None]
    # pages 0 to 29 of h.bad name documents 1000 to 1029, all toxic; the labels of documents 0 to 29 are those of other pages
    rows = [(k, f"http://h.bad/xx/{1000 + k}") for k in range(30)] + [(30 + k, f"http://h.good/xx/{k}") for k in range(30)]
    spark.createDataFrame(rows + [(90, "http://h.good/none")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1000 + k, 1) for k in range(30)] + [(k, 0) for k in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    verdicts = {r.page_id: r.verdict for r in queries.op10_url_filter(spark, str(tmp_path)).collect()}
    assert all(verdicts[k] == "block" for k in range(30)) and all(verdicts[k] == "allow" for k in [*range(30, 60), 90])


def test_pipeline_rejects_rows_without_doc_id(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    more = docs(spark, [(None, None), (None, "12 %%"), (9004, "12 %%"), (9005, None), (None, table.first().text)]).select(*corpus_pipeline.COLUMNS)
    left = corpus_pipeline.language_stage(spark, table.unionByName(more), sf).collect()
    assert len(left) == table.count() + 1 and [r.text for r in left if r.doc_id is None] == [table.first().text]


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_words long, __text_key string, __spans string, __n_words int, doc string, kept string, class string, gone_id long"


def test_pipeline_stages_on_edges(spark, sf):
    english = [t.text for t in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and length(text) between 300 and 2000").limit(3).collect()]
    pairs = [*EDGE, *[(100 + k, t) for k, t in enumerate(english)], (None, english[0]), (100, english[0]), (300, english[1].upper())]
    rows = spark.createDataFrame([(d, t, "en", None if d == 5 else "s", len(t) if t else None, k, "k", "s", k, "d", "yes", "c", 1) for k, (d, t) in enumerate(pairs)], ODD)
    words = {name: stage for name, stage in corpus_pipeline.STAGES}
    kept = lambda name, frame: sorted(((r.doc_id, r.n_words) for r in words[name](spark, frame, sf).collect()), key=repr)
    every = sorted(((d, k) for k, (d, t) in enumerate(pairs)), key=repr)
    # near copies: rows of one doc_id stay together, rows without id or words stay
    near = brute_components([p for p in pairs if p[0] is not None])
    assert kept("near_dedup", rows) == sorted(((d, k) for d, k in every if d is None or near[d][1] == d), key=repr)
    gone = {d for d, k in every} - {d for d, k in kept("language_id", rows)}
    assert {4, 5, 3} <= gone and not {100, 101, 102, None} & gone
    assert len(kept("substring_dedup", rows)) == len(pairs)  # copies that a smaller doc_id does not hold, or in part
    assert kept("decontamination", rows) == every
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, rows, sf), stage(spark, rows.limit(0), sf)
        assert empty.count() == 0
        if name != "packing":
            assert out.schema.names == rows.schema.names == empty.schema.names
            same = {(r.n_words, r["__n_words"], r.kept, r.gone_id) for r in out.collect()}
            assert same <= {(k, k, "yes", 1) for k in range(len(pairs))}  # further columns come through as they were


def test_pipeline_stages(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    clean = " ".join(f"unique{k}" for k in range(80))
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    more = docs(spark, [(9001, clean), (9002, clean), (9003, f"start {passage} end")]).select(*table.columns)
    rows = table.unionByName(more)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf)
        if name != "packing":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/decontamination").collect()}
    assert 9001 in kept and 9002 not in kept and 9003 not in kept
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == kept


def test_a_tokenizer_remembers_as_many_parts_as_it_is_told():
    path, words = queries.tokenizer_path(), "one two three four five six, seven. One"
    whole = tokens.load(path).ids(words)
    few = tokens.load(path, 3)
    few.forget()
    assert few.ids(words) == whole and len(few.parts) == 3
    few.forget()
    assert tokens.load(path).ids(words) == whole and len(tokens.load(path).parts) > 7


def test_chat_formatting_bounds_its_batches(spark):
    from continuo.llm import chat_format, common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for run in (lambda: chat_format.records_to_turns(spark.createDataFrame([(1, "{}")], "conv_id long, record string")), lambda: chat_format.digest(spark.createDataFrame([(1, 0, "", 0, 0)], "conv_id long, turn long, piece string, loss_start long, loss_length long"))):
        spark.conf.set(name, "64m")
        run()
        assert int(spark.conf.get(name)) == common.BATCH_BYTES
