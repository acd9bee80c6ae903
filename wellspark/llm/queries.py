"""The operators as registered queries over the given tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wellspark.llm.conversations import audit
from wellspark.llm.embeddings import near_vectors
from wellspark.llm.language import identify
from wellspark.llm.lexical import ranked
from wellspark.llm.mixing import mix
from wellspark.llm.packing import packed_documents
from wellspark.llm.pii import personal_data
from wellspark.llm.quality import score_documents
from wellspark.llm.secrets import secrets
from wellspark.llm.sharding import assign
from wellspark.llm.simhash import simhash_groups
from wellspark.llm.substring import without_repeats
from wellspark.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_simhash_groups")
def op2(spark, sf_dir):
    """Fingerprint and group of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op3_topk_search", OP3_SQL)
def op3(spark, sf_dir):
    """The ten best rows for every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id, vec_id AS top FROM embeddings UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(top) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""


@query("op10_near_vectors", OP10_SQL)
def op10(spark, sf_dir):
    """Links and component of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS full_at FROM w),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)) AS target FROM l),
c AS (SELECT d.*, t.source_size, CAST(t.target AS DOUBLE) AS target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT uid, size, h, doc_id, source, e, CAST(reached + e * source_size AS DOUBLE) / target AS finish FROM c, (SELECT unnest([0, 1]) AS e) WHERE size > 0),
o AS (SELECT uid, size, coalesce(sum(size) OVER (ORDER BY finish, coalesce('=' || source, ''), h, doc_id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
k AS (SELECT uid, sum(greatest(0, least(size, (SELECT CAST(floor(1.5 * sum(size)) AS BIGINT) FROM d) - before))) AS taken FROM o GROUP BY uid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN k USING (uid)
"""


@query("op4_mix_sources", OP4_SQL)
def op4(spark, sf_dir):
    """Words the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    """Place of every document's pieces in sequences of 2,048 tokens."""
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_language")
def op7(spark, sf_dir):
    """Language of every document."""
    return identify(table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9(spark, sf_dir):
    """Quality of every document."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_personal_data")
def op1(spark, sf_dir):
    """Personal data in every document."""
    return personal_data(table(spark, sf_dir, "documents"))


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KIND = "SELECT doc_id, {k} AS kind, unnest(range(len(f))) AS i, unnest(f) AS match, unnest(g[:len(f)]) AS gap FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS g FROM d)"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_KIND.format(k=k, p=p) for k, p in enumerate((_ASSIGN, "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", "[A-Za-z0-9+/_=-]{16,}")))}),
e AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
x AS (SELECT *, stop - length(match) AS start, kind IN (1, 2) OR kind = 0 AND length(regexp_extract(match, '{_ASSIGN}', 2)) >= 8 AS base FROM e),
s AS (SELECT replace(match, '.', '') AS word, max(secret) AS secret FROM (
        SELECT CASE WHEN kind = 0 THEN regexp_extract(match, '{_ASSIGN}', 2) ELSE match END AS match, 1 AS secret FROM x WHERE base
        UNION ALL SELECT match, 0 FROM x WHERE kind = 3 AND regexp_matches(match, '^([A-Z]?[a-z]+([/_=+-]?[A-Z]?[a-z]+)*[/_=+-]*[0-9]{{0,4}}|[A-Z]+([/_=+-][A-Z]+)*[/_=+-]*[0-9]{{0,4}}|[0-9]+)$')) GROUP BY match HAVING length(replace(match, '.', '')) >= 8),
c AS (SELECT secret, substr('^' || word, i, 1) AS a, substr(word, i, 1) AS b, count(*) AS n FROM (SELECT secret, word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM s) GROUP BY ALL),
letters AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-', '')) AS b),
befores AS (SELECT b AS a FROM letters UNION ALL SELECT '^'),
logs AS (SELECT k.secret, a, b, ln((coalesce((SELECT n FROM c WHERE c.secret = k.secret AND c.a = befores.a AND c.b = letters.b), 0)
            + 20 * ((coalesce((SELECT sum(n) FROM c WHERE c.secret = k.secret AND c.b = letters.b), 0) + 0.5) / (coalesce((SELECT sum(n) FROM c WHERE c.secret = k.secret), 0) + 0.5 * 67)))
            / (coalesce((SELECT sum(n) FROM c WHERE c.secret = k.secret AND c.a = befores.a), 0) + 20)) AS l
         FROM (VALUES (0), (1)) k(secret) CROSS JOIN befores CROSS JOIN letters),
ratio AS (SELECT p.a, p.b, CAST(round(1000 * (p.l - q.l)) AS BIGINT) AS v FROM logs p JOIN logs q ON p.a = q.a AND p.b = q.b AND p.secret = 1 AND q.secret = 0),
t AS (SELECT doc_id, start, stop, match, CAST(unnest(range(1, length(match) + 1)) AS INTEGER) AS i FROM x WHERE kind = 3),
r AS (SELECT doc_id, start, stop FROM t JOIN ratio ON ratio.a = substr('^' || match, i, 1) AND ratio.b = substr(match, i, 1) GROUP BY doc_id, start, stop
      HAVING sum(v) >= greatest(10000, 400 * (stop - start))),
w AS (SELECT doc_id, kind, start, stop, true AS base FROM x WHERE base UNION ALL
      SELECT doc_id, 3, start, stop, false FROM r WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.base AND b.doc_id = r.doc_id AND b.start < r.stop AND b.stop > r.start)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans,
             string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (base) AS own FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


@query("op5_secrets", OP5_SQL)
def op5(spark, sf_dir):
    """Secrets in every document."""
    return secrets(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, a, unnest(range(1, len(a) - 18)) AS s FROM w WHERE len(a) >= 20),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(a[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM s),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM k WHERE n > 1),
p AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS p FROM w),
g AS (SELECT p.doc_id, count(*) - count(r.p) AS n_kept, count(r.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE r.p IS NULL), '') AS kept
      FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""


@query("op8_repeated_passages", OP8_SQL)
def op8(spark, sf_dir):
    """Every document without passages that stand earlier."""
    return without_repeats(table(spark, sf_dir, "documents"))


#: CRC-32 of bytes in a list: the table from its rule, then one step a byte.
_CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS steps FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)"
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bytes}), lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1])), 4294967295)"
_BYTES = "list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST(16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1 AS BIGINT))"
OP12_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS body FROM documents),
b AS (SELECT uid, doc_id, CAST(octet_length(body) + 1 AS BIGINT) AS size, CAST({_CRC.format(bytes=_BYTES.format(text="body"), table="steps")} AS BIGINT) AS crc,
             md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM d, crc),
j AS (SELECT uid, CAST(('0x' || m[1:16]) AS UBIGINT)::HUGEINT AS k, 0::BIGINT AS place, 0::BIGINT AS next FROM b
      UNION ALL
      SELECT uid, k2, next, CAST(floor((next + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE)) AS BIGINT)
      FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE next < 16)),
p AS (SELECT uid, place, next FROM j WHERE next >= 16)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, CAST(place AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY place ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(crc AS VARCHAR))), doc_id NULLS FIRST, size, crc) - 1 AS slot,
       CAST(CASE WHEN next = 16 THEN 16 ELSE place END AS INTEGER) AS grown_shard
FROM b JOIN p USING (uid)
"""


@query("op12_shards", OP12_SQL)
def op12(spark, sf_dir):
    """Shard and slot of every document."""
    return assign(table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS a FROM documents),
n AS (SELECT uid, doc_id, CAST(len(a) AS BIGINT) AS n FROM d WHERE len(a) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
m AS (SELECT uid, doc_id, 50 + (50 * n * docs) // words AS m FROM n, s),
p AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(a) AS term FROM d) GROUP BY uid, term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
r AS (SELECT item_id, m.uid, m.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m ON m.uid = p.uid GROUP BY item_id, m.uid, m.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark, sf_dir):
    """The fifty best documents for every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op13_sql() -> str:
    """Shortest paths from the last turn to the first; each state holds its least (cost, audit, turns)."""
    added = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}
    kept = {1: "CASE initial WHEN 's' THEN v[2] WHEN 'u' THEN v[3] END", 2: "CASE initial WHEN 'u' THEN v[3] END", 3: "CASE initial WHEN 'a' THEN v[4] END", 4: "CASE initial WHEN 'u' THEN v[3] END"}
    made = "{{'c': {c}, 'a': {a}, 't': {t}}}".format
    nothing = made(c="1000000000::BIGINT", a="''", t="[]::VARCHAR[]")

    def direct(s: int) -> str:
        to, role = added[s]
        stays = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
        delete = made(c=f"v[{s}].c + 2", a=f"'D' || v[{s}].a", t=f"v[{s}].t")
        rerole = made(c=f"v[{to}].c + 1 + {stays}", a=f"'R' || v[{to}].a", t=f"list_concat(['{role}:' || text], v[{to}].t)")
        keep = made(c=f"({kept[s]}).c + {stays}", a=f"'K' || ({kept[s]}).a", t=f"list_concat([role || ':' || text], ({kept[s]}).t)")
        return f"list_sort([{delete}, CASE WHEN fault IN (1, 2) THEN {nothing} ELSE {rerole} END, CASE WHEN fault IN (1, 2) OR ({kept[s]}) IS NULL THEN {nothing} ELSE {keep} END])[1]"

    def inserted(s: int, before: str) -> str:
        to, role = added[s]
        return f"list_sort([d[{s}], " + made(c=f"{before}[{to}].c + 5", a=f"'I' || {before}[{to}].a", t=f"list_concat(['{role}:'], {before}[{to}].t)") + "])[1]"

    lists = {"d": ", ".join(direct(s) for s in range(1, 5)), "x": ", ".join(inserted(s, "d") for s in range(1, 5)), "y": ", ".join(inserted(s, "x") for s in range(1, 5))}
    end = ", ".join(made(c=f"{c}::BIGINT", a=f"'{a}'", t=f"{t}::VARCHAR[]") for c, a, t in ((0, "", "[]"), (10, "II", "['user:', 'assistant:']"), (5, "I", "['assistant:']"), (0, "", "[]")))
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = _CRC.format(bytes=_BYTES.format(text=f"encode({key})"), table="steps")
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS what FROM conversations, crc),
g AS (SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS k, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
             CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM w, (SELECT unnest([1, 2]) AS copy) WHERE what <> 0 AND (copy = 1 OR what = 3)),
o AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i,
             right(regexp_replace(text, '{space}+$', ''), 1) AS last FROM g),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lead(initial) OVER (PARTITION BY k ORDER BY i) AS later FROM o),
s AS (SELECT k, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (later IS NOT NULL AND initial || later NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k),
p AS (SELECT k, n + 1 AS i, [{end}] AS v FROM s
      UNION ALL
      SELECT k, i, [{lists["y"]}] FROM (SELECT *, [{lists["x"]}] AS x FROM (SELECT p.k, f.i, [{lists["d"]}] AS d FROM p JOIN f ON f.k = p.k AND f.i = p.i - 1)))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v[1].c, 0) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.k = coalesce('=' || CAST(conv_id AS VARCHAR), '') LEFT JOIN p ON p.k = s.k AND p.i = 1
"""


@query("op13_conversation_repair", _op13_sql())
def op13(spark, sf_dir):
    """Faults and cheapest repair of every damaged conversation."""
    return audit(table(spark, sf_dir, "conversations"))
