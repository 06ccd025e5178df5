"""The queries of this subpackage and, where SQL can say it, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.llm import bpe, decontam, idfiles, jaccard, licenses, manifest, mil, periodic, pii, repeats, rules, sharding, suffixes
from demandry.llm.common import let, lower_ascii, table, words
from demandry.session import fresh_path, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 40


def rank_file() -> str:
    """The rank file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), rank_file())


QUERIES["op1_byte_bpe"] = op1_byte_bpe


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES["op8_rendezvous_shards"] = op8_rendezvous_shards
ORACLE["op8_rendezvous_shards"] = f"""
WITH crc_table AS (  -- of the CRC-32 with the reflected polynomial EDB88320
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
bytes AS (
    SELECT doc_id, coalesce(text, '') AS text,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
sums AS (
    SELECT doc_id, octet_length(encode(text)) + 16 AS size,
        xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc
    FROM bytes, crc_table),
costs AS (
    SELECT doc_id, size, crc, s,
        -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 13))::BIGINT::DOUBLE + 1) / {2**52 + 1}.0::DOUBLE) AS cost
    FROM sums, range({SHARDS + 1}) r(s)),
placed AS (
    SELECT doc_id, size, crc, arg_min(s, cost) FILTER (s < {SHARDS}) AS shard, arg_min(s, cost) AS grown
    FROM costs GROUP BY doc_id, size, crc)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1 AS slot, grown::INTEGER AS grown_shard
FROM placed"""


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(rules.measure(table(spark, sf_dir, "documents")), "counts")
    cutoffs = materialize(rules.certify(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return rules.judge(measured, cutoffs).select(
        "doc_id", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words", "base_failed", "kept"
    )


QUERIES["op6_risk_controlled_rules"] = op6_risk_controlled_rules


def _rules_sql() -> str:
    share = rules.ALPHA / len(rules.RULES)
    hit = lambda r, cut: f"(coalesce({r.whole} > 0 AND 100 * {r.part} >= {cut} * {r.whole}, false))"
    grid = " UNION ALL ".join(
        f"SELECT lang, '{name}' AS rule, {i} AS strict, {cut} AS cutoff, count(*) AS n, count(*) FILTER ({hit(r, cut)}) AS k FROM held GROUP BY lang"
        for name, r in rules.RULES.items()
        for i, cut in enumerate(r.cutoffs)
    )
    rejected = " OR ".join(
        hit(r, f"(SELECT arg_max(cutoff, strict) FROM certified t WHERE t.lang IS NOT DISTINCT FROM c.lang AND rule = '{name}')")
        for name, r in rules.RULES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM split, unnest(range(1, greatest(len(w) - 6, 1))) r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, sum(step) AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice) GROUP BY doc_id),
c AS MATERIALIZED (
    SELECT s.doc_id, lang, md5(text) AS digest, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper
    FROM split s LEFT JOIN covered v ON v.doc_id = s.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
held AS (  -- each key once, and each text of a language once
    SELECT DISTINCT ON (lang, digest) * FROM (
        SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY digest, lang) = 1)),
grid AS ({grid}),
certified AS MATERIALIZED (SELECT * FROM grid WHERE
    CASE WHEN k > n * {share} THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) END
    <= {rules.DELTA} / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM held) * {len(rules.RULES)}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {rejected}) AS kept FROM b c"""


ORACLE["op6_risk_controlled_rules"] = _rules_sql()


# The registered query's key; a user passes a secret one.
PSEUDONYM_KEY = b"key of the registered query"


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY, spans="spans").select(
        "doc_id", F.size("spans").cast("long").alias("n_found"), F.concat_ws(",", F.array_sort(F.array_distinct("spans.kind"))).alias("kinds"), "text"
    )


QUERIES["op7_pseudonyms"] = op7_pseudonyms


def op9_winnowed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


QUERIES["op9_winnowed_decontamination"] = op9_winnowed_decontamination

_ITEM_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
ORACLE["op9_winnowed_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
    FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
per_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
per_doc AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
    FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN per_word p ON p.doc_id = d.doc_id LEFT JOIN per_doc q ON q.doc_id = d.doc_id"""


def op3_countmin_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


QUERIES["op3_countmin_repeats"] = op3_countmin_repeats
ORACLE["op3_countmin_repeats"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 18, 1))) r(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
per_doc AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN per_doc p ON p.doc_id = d.doc_id"""


def op10_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


QUERIES["op10_column_suffixes"] = op10_column_suffixes

PREDICTED_FROM = 0.7


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil.fit(docs, table(spark, sf_dir, "labels"))
    return mil.score(docs, model).select(
        "doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted")
    )


QUERIES["op4_attention_quality"] = op4_attention_quality


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path: here each lies in the directory of its source and language."""
    docs = table(spark, sf_dir, "documents")
    placed = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return licenses.scan(placed)


QUERIES["op2_license_scan"] = op2_license_scan


def _licenses_sql() -> str:
    model = licenses.Model()
    weights = ", ".join(f"({i}, '{name}', '{w}', {x!r}::DOUBLE)" for i, (name, v) in enumerate(model.vectors) for w, x in v.items())
    idf = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in model.idf.items())
    words = lambda t: f"regexp_extract_all(lower({t}), '[a-z0-9]+')"
    best = lambda rel, by: f"""(
    SELECT {by}, min(struct_pack(minus := minus, license := license)) AS best FROM (
        SELECT {by}, t, license, -round(sum(x * weight) / any_value(norm), 9) AS minus FROM (
            SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {by})) AS norm FROM (
                SELECT {by}, w, count(*) * coalesce(any_value(idf), {model.unseen!r}) AS x FROM (SELECT {by}, unnest({words('txt')}) AS w FROM {rel})
                LEFT JOIN idf USING (w) GROUP BY {by}, w)) JOIN weights USING (w) GROUP BY {by}, t, license)
    GROUP BY {by})"""  # noqa: E731
    return f"""
WITH weights(t, license, w, weight) AS (VALUES {weights}),
idf(w, idf) AS (VALUES {idf}),
files AS (SELECT doc_id, source || '/' || lang AS dir, source, source || '/' || lang || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS txt FROM documents),
lines AS (SELECT doc_id, i, l[i] AS txt FROM (SELECT doc_id, string_split(txt, chr(10)) AS l FROM files), unnest(range(1, len(l) + 1)) r(i)),
by_line AS MATERIALIZED {best('lines', 'doc_id, i')},
own AS (SELECT doc_id, min(best) AS own FROM by_line WHERE -best.minus >= {model.cosine} GROUP BY doc_id),
whole AS MATERIALIZED {best('(SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM own))', 'doc_id')},
f AS (SELECT files.*, own, coalesce(-best.minus >= {model.cosine}, false) AS is_file FROM files LEFT JOIN own USING (doc_id) LEFT JOIN whole USING (doc_id)),
given AS (SELECT dir, min(struct_pack(m := own.minus, license := own.license, path := path)) AS g FROM f WHERE is_file GROUP BY dir)
SELECT doc_id, path, coalesce(own.license, g.license) AS license, round(-own.minus, 6) AS score,
    CASE WHEN is_file THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN g IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN own IS NULL THEN g.path END AS license_from
FROM f LEFT JOIN given USING (dir)"""


ORACLE["op2_license_scan"] = _licenses_sql()


def op5_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


QUERIES["op5_heavy_light_jaccard"] = op5_heavy_light_jaccard
ORACLE["op5_heavy_light_jaccard"] = """
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) r(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b WHERE 100 * k >= 90 * (u.n + v.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id
FROM d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id"""


def tokenizer_file() -> str:
    """The tokenizer file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "ids")
    index = idfiles.write(table(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=0)
    return idfiles.checksums(index, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES["op11_id_files"] = op11_id_files


def _with_period(key: Column, text: Column) -> Column:
    """The contract's texts: in every tenth one, by the checksum of its key, the words from a on repeat with period p."""
    h = F.crc32(key.cast("string"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = F.when(n > 0, g % n).otherwise(0).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(
            F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, s["a"] + (i - s["a"]) % s["p"]))), " "))

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic.runs(docs.select("doc_id", _with_period(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("(1000 * top.length) div (-top.p)").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES["op12_periodic_runs"] = op12_periodic_runs


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fields(lower_ascii(F.col("text"))))
    leaves = docs.select("doc_id", "lang", fields(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    proved = manifest.proofs(leaves, "doc_id", "lang", "leaf", carry=["tampered"])
    folded = proved.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES["op13_merkle_manifest"] = op13_merkle_manifest


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    fields = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    # Whether a document is tampered with depends on the CRC-32 of its key.
    crc = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
        lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"""
    climb = lambda name, first: f"""
{name} AS (
    {first}
    UNION ALL
    SELECT level + 1, lang, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY level, lang, i // 8)"""  # noqa: E731
    path = lambda of, nodes: f"""(
    SELECT d.id, s.level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < d.i >> (3 * s.level)), '') AS l,
        coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > d.i >> (3 * s.level)), '') AS r
    FROM {of} d JOIN {nodes} s ON s.lang = d.lang AND s.n > 1 AND s.i >> 3 = d.i >> (3 * s.level + 3) GROUP BY d.id, s.level)"""  # noqa: E731
    return f"""
WITH RECURSIVE crc_table AS (  -- of the CRC-32 with the reflected polynomial EDB88320
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
l AS (
    SELECT doc_id, coalesce('+' || lang, '') AS lang, {fields('text')} AS leaf, coalesce(CASE WHEN {crc} % 3 = 0
        THEN {fields("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END, {fields('text')}) AS now
    FROM documents, crc_table),
d AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY lang) AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
{climb('nodes', "SELECT 0 AS level, lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d")},
sub AS MATERIALIZED (SELECT '' AS lang, lang AS id, h, row_number() OVER (ORDER BY lang) - 1 AS i FROM nodes WHERE n = 1),
{climb('tops', "SELECT 0 AS level, lang, i, h, count(*) OVER () AS n FROM sub")},
top_path AS MATERIALIZED {path('sub', 'tops')},
steps AS (
    SELECT id, level, l, r FROM {path('d', 'nodes')}
    UNION ALL SELECT d.id, 1000 + level, l, r FROM top_path p JOIN d ON d.lang = p.id),
paths AS (SELECT id, list(l || '.' || r ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS siblings FROM steps GROUP BY id),
root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT d.*, siblings, list_reduce([now] || coalesce(path, []), lambda a, s: sha256(split_part(s, '.', 1) || a || split_part(s, '.', 2))) AS folded_root
    FROM d LEFT JOIN paths USING (id)) d, sub, root WHERE sub.id = d.lang"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()
