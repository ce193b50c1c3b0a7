"""The queries of this subpackage, one per operator, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, exact_dedup, licenses, minhash, mixing, packing, quality, sharding, simhash, spelling, toxicity, warc
from .common import checkpointed, fresh_dir, held_out, lower_ascii, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "hits")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(lower_ascii(F.col("text")), 256).alias("text_sha256")
    return exact_dedup.verdicts(docs, carry=[digest]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    files = checkpointed(warc.write(warc.plan(pages), folder))
    records = warc.read(files.repartition(max(1, files.count())), folder).where("last")
    number = lambda c: warc.id_of(F.col(c)).cast(pages.schema["page_id"].dataType)
    return records.select(
        number("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mixing.realise(docs, mixing.planned(docs, repeat=4.0))
    named = {"__source": "source", "__tokens": "n_tokens", "__pass": "pass", "__block": "block", "__block_order": "block_order", "__place": "place"}
    return taken.select("doc_id", *[F.col(c).alias(name) for c, name in named.items()])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: A conversation whose texts hold what looks like control strings.
HARD = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], rows.schema)
    out = chat.format_conversations(rows.unionByName(hard))
    turns = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("segments"))
    return out.select(
        "conv_id", F.size(chat.read_back(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.fingerprints_beside_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", minhash.hexed(F.col("signature")).alias("fingerprint"), minhash.hexed(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents")
    found = quality.scores(docs, quality.learn(docs, labels))
    return found.select("doc_id", "site", "path", held_out(F.col("doc_id")).alias("held_out"), "evidence", "site_mean", "path_mean", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def _licenses_sql() -> str:
    def words(x) -> str:
        return "[" + ", ".join(f"'{w}'" for w in x) + "]::VARCHAR[]"

    templates = ", ".join(f"('{t.label}', {licenses.scale(t)}, {words(sorted(set(licenses.words_of(t.text))))}, {licenses.needed(t)}, {words(t.must)}, {words(t.unless)})" for t in licenses.TEMPLATES)
    phrases = ", ".join(f"({words(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    return f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT * FROM (VALUES {templates}) t(label, scale, words, need, must, unless)),
        p AS (SELECT * FROM (VALUES {phrases}) p(phrase, label)),
        h AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase)) - 1 AS place FROM d, p),
        base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
        b AS (SELECT doc_id, scale, list_distinct(w[start + 1:start + 2 * scale]) AS tokens FROM (SELECT doc_id, w, scale, unnest(range(0, len(w), scale)) AS start FROM d, (SELECT DISTINCT scale FROM t))),
        m AS (
            SELECT doc_id, label, len(list_intersect(tokens, words)) AS shared, len(words) AS size FROM b JOIN t ON t.scale = b.scale AND len(list_intersect(tokens, words)) >= need
            WHERE list_has_all(tokens, must) AND NOT list_has_any(tokens, unless)),
        l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM h) GROUP BY doc_id),
        s AS (SELECT doc_id, max(shared / size) AS most FROM m GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
            CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(most, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
    """


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_exact_dedup, op3_warc, op4_mixing, op5_sharding, op6_chat, op7_fingerprints, op8_simhash, op9_quality, op10_packing,
        op11_collocations, op12_licenses, op13_spelling,
    )
}

ORACLES = {
    "op2_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
            CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
    """,
    "op4_mixing": """
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS source, greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT)) AS n_tokens,
                CAST('0x' || substr(md5('7:' || doc_id), 1, 15) AS BIGINT) AS place
            FROM documents),
        s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS documents, sum(sum(n_tokens)) OVER () AS total FROM d GROUP BY source),
        g AS (
            SELECT k, max(p / tokens) / min(p / tokens) AS passes
            FROM (SELECT k, tokens, pow(tokens / total, k / 1024.0) AS p FROM s, range(0, 1025) r(k)) GROUP BY k),
        a AS (SELECT min(k) / 1024.0 AS alpha FROM g WHERE passes <= 4.0 + 1e-9),
        p AS (SELECT source, tokens, documents, pow(tokens / total, (SELECT alpha FROM a)) AS p FROM s),
        w AS (SELECT *, p / sum(p) OVER () AS weight, sum(p) OVER () * max(tokens / p) OVER () AS all_tokens FROM p),
        b AS (
            SELECT source, tokens, greatest(1, documents // 256) AS blocks, CAST(floor(weight * all_tokens + 1e-6) AS BIGINT) AS budget FROM w),
        r AS (
            SELECT d.doc_id, d.source, d.n_tokens, d.place, d.place % blocks AS block, budget // tokens AS passes, budget % tokens AS rest
            FROM d JOIN b USING (source)),
        o AS (SELECT *, CAST('0x' || substr(md5('1:' || (passes + 1) || ':' || source || ':' || block), 1, 15) AS BIGINT) AS last_order FROM r),
        c AS (
            SELECT *, passes + CASE WHEN sum(n_tokens) OVER (PARTITION BY source ORDER BY last_order, block, place ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies
            FROM o)
        SELECT doc_id, source, n_tokens, pass, block, CAST('0x' || substr(md5('1:' || pass || ':' || source || ':' || block), 1, 15) AS BIGINT) AS block_order, place
        FROM (SELECT *, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS pass FROM c)
    """,
    "op6_chat": """
        WITH r AS (
            SELECT *, CASE WHEN conv_id IS NULL THEN 'n' || row_number() OVER () ELSE 'c' || conv_id END AS conv FROM (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')),
        e AS (
            SELECT *, length(role) + length(text)
                + length(role || text) - length(replace(role || text, '\\', '')) + length(role || text) - length(replace(role || text, '<', ''))
                + length(role || text) - length(replace(role || text, '>', '')) + 15 AS chars,
                coalesce(lag(role) OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text), 'start') || '>' || role AS move
            FROM r)
        SELECT any_value(conv_id) AS conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars,
            bool_and(move IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
        FROM e GROUP BY conv
    """,
    "op11_collocations": """
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM d),
        w AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w FROM p),
        o AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) ks(k)),
        f AS (SELECT lang, k, w[i:i + k - 1] AS words, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 30),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        longer AS (
            SELECT lang, words, max(a) AS most FROM (SELECT lang, words[:-2] AS words, a FROM f WHERE k > 2 UNION ALL SELECT lang, words[2:], a FROM f WHERE k > 2
                UNION ALL SELECT lang, words[:-3], a FROM f WHERE k = 4 UNION ALL SELECT lang, words[3:], a FROM f WHERE k = 4) GROUP BY ALL),
        c AS (SELECT f.*, unnest(range(1, k)) AS cut FROM f LEFT JOIN longer m ON m.lang = f.lang AND m.words = f.words WHERE k > 1 AND coalesce(100 * most < 80 * a, true)),
        s AS (
            SELECT c.*, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * c.a // (l.a + r.a) AS BIGINT) AS score
            FROM c JOIN f l ON l.lang = c.lang AND l.words = c.words[1:cut] JOIN f r ON r.lang = c.lang AND r.words = c.words[cut + 1:]),
        b AS (SELECT *, array_to_string(words, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM b JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "op12_licenses": _licenses_sql(),
}
