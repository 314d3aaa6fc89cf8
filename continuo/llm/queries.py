"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from continuo.llm import (
    ann,
    chat_format,
    impact_search,
    language_id,
    merkle,
    minhash,
    packing,
    sharding,
    slack_packing,
    substring_dedup,
    token_output,
    url_filter,
)
from continuo.llm.common import table
from continuo.llm.decontaminate import PositionalIndex

#: What conversation -7 says, twice.
SAID = "\\### Assistant: </turn> ok"
#: Words that may stand between those of an item beside its own number.
SLOP = 2


def tokenizer_path() -> str:
    """The vocabulary file; CONTINUO_TOKENIZER overrides the installed public one."""
    import public_tokenizers

    return os.environ.get("CONTINUO_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24, "bytes")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def language_rows(docs: DataFrame) -> DataFrame:
    """documents: lang is the declaration, source the host; they have no address."""
    string = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string").alias("suffix")
    return docs.select("doc_id", "text", string("lang").alias("declared"), string("source").alias("host"), none)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(language_rows(table(spark, sf_dir, "documents"))).drop("text_key")


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows to identify: the text between tags, the html lang attribute, host and address suffix."""
    host = url_filter.host_of(F.col("url"))
    markup = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1))
    given = lambda x, name: F.when(x != "", x).alias(name)
    suffix = given(url_filter.suffix_of(host), "suffix")
    return pages.select(F.col("page_id").alias("doc_id"), markup.alias("text"), given(declared, "declared"), given(host, "host"), suffix)


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion over web pages."""
    found = language_id.identify(page_rows(table(spark, sf_dir, "pages")))
    return found.select(F.col("doc_id").alias("page_id"), "declared", "language", "posterior", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = {"__n_words": "n_words", "__n_removed": "n_removed", "__kept_sha256": "kept_sha256"}
    return cut.select("doc_id", *[F.col(c).alias(name) for c, name in named.items()])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PositionalIndex(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).hits().drop("doc")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all words of a benchmark item near each other, in any order, and how often."""
    index = PositionalIndex(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return index.proximity(SLOP).groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are a table of turns; conversation -7 comes as a record of messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    record = json.dumps({"messages": [{"role": r, "content": SAID} for r in ("user", "assistant")]})
    records = spark.createDataFrame([(-7, record)], "conv_id long, record string")
    more = chat_format.records_to_turns(records).select("conv_id", "turn", "role", "text")
    return chat_format.digest(chat_format.format_turns(rows.unionByName(more)))


def document_records(docs: DataFrame) -> DataFrame:
    """Documents as answers in records of seven layouts, by doc_id, and of one that no layout knows."""
    text, source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "source", "lang"))
    pair = lambda role, content, ask, answer: F.array(*[F.struct(F.lit(r).alias(role), t.alias(content)) for r, t in zip((ask, answer), (source, text), strict=True)])
    parts = lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))
    said = lambda r, t: F.struct(F.lit(r).alias("role"), parts(t).alias("content"))
    layouts = [
        F.struct(pair("role", "content", "user", "assistant").alias("messages"), lang.alias("prompt")),
        F.struct(pair("from", "value", "human", "gpt").alias("conversations"), F.lit(1).alias("version")),
        F.struct(source.alias("instruction"), lang.alias("input"), text.alias("output")),
        F.struct(source.alias("prompt"), text.alias("response")),
        F.struct(lang.alias("system"), source.alias("prompt"), text.alias("completion")),
        F.struct(lang.alias("context"), source.alias("question"), text.alias("answer")),
        F.struct(F.array(said("user", source), said("assistant", text)).alias("messages")),
        F.struct(text.alias("body")),
    ]
    record = F.coalesce(*[F.when(F.pmod("doc_id", F.lit(len(layouts))) == k, F.to_json(x)) for k, x in enumerate(layouts)])
    return docs.select(F.col("doc_id").alias("conv_id"), record.alias("record"))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterogeneous records in one template; records of no known layout are left out."""
    turns = chat_format.records_to_turns(document_records(table(spark, sf_dir, "documents"))).where("turn is not null")
    return chat_format.digest(chat_format.format_turns(turns.select("conv_id", "turn", "role", "text")))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_output.write_tokens(docs, tokenizer_path(), end_id=1)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(token_output.NULL_KEY)).alias("key")
    return store.read(store.lookup(docs.select(key).distinct()))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of documents; a page's address names its document."""
    outcomes = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("bad"))
    document = url_filter.document_of(F.col("url")).alias("doc_id")
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", document), outcomes, key="doc_id")
    rounded = {c: F.round(c, 6) for c in ("mean", "lower")}
    return judged.withColumns(rounded).withColumnsRenamed({"n": "host_labels", "bad": "host_bad", "mean": "host_mean", "lower": "host_lower"})


def byte_tokenizer_path() -> str:
    """The byte-level vocabulary file; CONTINUO_BYTE_TOKENIZER overrides the installed public one."""
    import public_tokenizers

    return os.environ.get("CONTINUO_BYTE_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_text())


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(table(spark, sf_dir, "documents"), byte_tokenizer_path(), end_id=2)


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_packing,
        op3_language_id,
        language_id_pages,
        op4_substring_dedup,
        op5_decontamination,
        benchmark_proximity,
        op6_nearest_neighbours,
        op7_chat_format,
        chat_layouts,
        op8_minhash_dedup,
        op9_token_output,
        op10_url_filter,
        op11_merkle_manifest,
        op12_slack_packing,
        op13_impact_search,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DIGEST = """SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, er, et)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
_ESCAPED = r"e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM r)"
_PAIRED = "|".join(url_filter.SECOND_LEVEL)
_SHRUNK = "1 / least(greatest(coalesce(sum(n * (bad / n - prior) ** 2 - prior * (1 - prior)) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0.5), 0.01), 0.5) - 1 AS k"

#: The checksum of a decimal number's digits: a table-free CRC-32, bit by bit.
_CRC32 = """xor(list_reduce(range(1, length({0}) + 1), lambda c, i: list_reduce(range(1, 9),
    lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, ascii(({0})[i])::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT)"""
_LEAF = """sha256(concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen({0}) || ':' || {0}, '-')))"""


def _tree(name: str, start: str, levels: int) -> str:
    """CTEs of a tree's levels: {name}0 from ``start`` (g, pos, h), then runs of 8 while a group has several nodes."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"""{name}r{k} AS (SELECT g, pos // 8 AS run, list(h ORDER BY pos) AS hs, any_value(c) AS c
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{k}) GROUP BY ALL),
{name}{k + 1} AS (SELECT g, run AS pos, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})""")
    return ",\n".join(out)


def _climb(name: str, before: str, levels: int) -> str:
    """CTEs that follow each row's place ``spot`` through the runs: the siblings join ``path``, ``fold`` is hashed on."""
    out = []
    for k in range(levels):
        kept = before if k == 0 else f"{name}c{k - 1}"
        out.append(f"""{name}c{k} AS (SELECT x.* EXCLUDE (spot, path, fold), spot // 8 AS spot,
    path || array_to_string(hs[:spot % 8] || hs[spot % 8 + 2:], '') AS path,
    CASE WHEN c = 1 THEN fold ELSE sha256(array_to_string(hs[:spot % 8] || [fold] || hs[spot % 8 + 2:], '')) END AS fold
    FROM {kept} x JOIN {name}r{k} r ON r.g = x.g AND r.run = x.spot // 8)""")
    return ",\n".join(out)


ORACLES = {
    "op11_merkle_manifest": f"""
WITH d AS (SELECT *, coalesce('=' || lang, '') AS grp, {_LEAF.format("text")} AS leaf FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS spot,
    CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_LOWER.format("text")} ELSE text END AS now FROM d),
{_tree("a", "SELECT grp AS g, spot AS pos, leaf AS h FROM p", 8)},
{_tree("b", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h FROM a8 WHERE pos = 0", 3)},
x AS (SELECT doc_id, leaf, grp, grp AS g, spot, '' AS path, {_LEAF.format("now")} AS fold FROM p),
{_climb("a", "x", 8)},
s AS (SELECT g AS grp, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS spot FROM a8),
y AS (SELECT doc_id, leaf, s.subroot, 0 AS g, s.spot, path, fold FROM ac7 JOIN s USING (grp)),
{_climb("b", "y", 3)}
SELECT doc_id, leaf, subroot, h AS root, sha256(path) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM bc2, b3""",
    "op13_impact_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}')) AS term FROM benchmark)),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10""",
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
cut AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(win.s, win.s + 50)) AS p FROM win JOIN first USING (h) WHERE first.f < win.doc_id)),
kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN cut ON cut.doc_id = u.doc_id AND cut.p = u.p GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.t, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "benchmark_proximity": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, len(w) + {SLOP} AS reach, unnest(w) AS term FROM b),
f AS (SELECT term, count(*) AS f FROM p GROUP BY term),
r AS (SELECT item_id, reach, count(*) AS n_terms, arg_min(term, (coalesce(f, 1000000000), term)) AS rare FROM t LEFT JOIN f USING (term) GROUP BY 1, 2),
a AS (SELECT r.*, p.doc_id, p.pos FROM r JOIN p ON p.term = r.rare),
m AS (SELECT a.item_id, a.doc_id, a.pos FROM a JOIN t ON t.item_id = a.item_id
      JOIN p ON p.doc_id = a.doc_id AND p.term = t.term AND p.pos BETWEEN a.pos - a.reach AND a.pos + a.reach
      GROUP BY a.item_id, a.doc_id, a.pos, a.n_terms HAVING count(DISTINCT p.term) = a.n_terms)
SELECT doc_id, item_id, count(*) AS n, min(pos)::BIGINT AS first_pos FROM m GROUP BY 1, 2""",
    "op7_chat_format": rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
{_ESCAPED} {_DIGEST}""",
    "chat_layouts": rf"""
WITH d AS (SELECT doc_id AS conv_id, doc_id % 8 AS k, coalesce(text, '') AS t, coalesce(source, '') AS s, coalesce(lang, '') AS l FROM documents WHERE doc_id % 8 <> 7),
r AS (SELECT conv_id, 0 AS turn, 'system' AS role, l AS text FROM d WHERE k = 4 AND trim(l) <> ''
      UNION ALL SELECT conv_id, 1, 'user', CASE k WHEN 2 THEN concat_ws(chr(10), nullif(s, ''), nullif(l, '')) WHEN 5 THEN concat_ws(chr(10), nullif(l, ''), nullif(s, '')) ELSE s END FROM d
      UNION ALL SELECT conv_id, 2, 'assistant', t FROM d),
{_ESCAPED} {_DIGEST}""",
    "op8_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(a, z) AS (SELECT x, y FROM both_ways UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.z = both_ways.x),
root AS (SELECT a, least(a, min(z)) AS r FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root.r, d.doc_id) AS component_id, coalesce(root.r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN root ON root.a = d.doc_id""",
    "op10_url_filter": rf"""
WITH h AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT *, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html?)?/?$', 1) AS BIGINT) AS doc_id FROM h),
l AS (SELECT doc_id, max(toxic) AS bad FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
g AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM o LEFT JOIN l USING (doc_id) GROUP BY host),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM g),
q AS (SELECT *, string_split(bare, '.') AS q, regexp_matches(bare, '^[0-9.]*$') AS digits FROM c),
f AS (SELECT host, n, bad, CASE WHEN regexp_matches(array_to_string(q[-2:], '.'), '^(?:{_PAIRED})\.[a-z][a-z]$') THEN 2 ELSE 1 END AS labels, q, digits, bare FROM q),
v AS (SELECT host, n, bad, CASE WHEN digits THEN bare ELSE array_to_string(q[-labels - 1:], '.') END AS domain, CASE WHEN digits THEN '' ELSE array_to_string(q[-labels:], '.') END AS suffix FROM f),
t AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS top FROM v),
sc AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(top) AS prior FROM v, t GROUP BY suffix),
sk AS (SELECT {_SHRUNK} FROM sc WHERE n > 0),
sm AS (SELECT suffix, (bad + k * prior) / (n + k) AS mean FROM sc, sk),
dc AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM v GROUP BY ALL),
dp AS (SELECT dc.*, sm.mean AS prior FROM dc JOIN sm USING (suffix)),
dk AS (SELECT {_SHRUNK} FROM dp WHERE n > 0),
dm AS (SELECT domain, (bad + k * prior) / (n + k) AS mean FROM dp, dk),
hp AS (SELECT v.*, dm.mean AS prior FROM v JOIN dm USING (domain)),
hk AS (SELECT {_SHRUNK} FROM hp WHERE n > 0),
hm AS (SELECT host, n, bad, n + k AS size, (bad + k * prior) / (n + k) AS mean FROM hp, hk),
hl AS (SELECT *, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (size + 1)) AS lower FROM hm),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, h.host, h.path, fits.rule, coalesce(fits.v, CASE WHEN lower > least({url_filter.MAX_BAD}, {url_filter.RATIO} * top) THEN 'block' ELSE 'allow' END) AS verdict,
       hl.n AS host_labels, hl.bad AS host_bad, round(hl.mean, 6) AS host_mean, round(lower, 6) AS host_lower
FROM h LEFT JOIN fits USING (page_id) LEFT JOIN hl ON hl.host = h.host, t""",
}
