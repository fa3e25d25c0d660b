"""The registered queries of this package: thin uses of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import align, bpe, chat, collocations, decontaminate, mixing, pii, ppm, quality, simhash, suffixes, tokens, urls
from strataspark.llm.common import sha256_hex, stored
from strataspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# The weights of the sources in order of their names, repeating.
MIX_WEIGHTS = (5.0, 2.0, 1.0)
# How each weight leans in time: the first fades, the last grows; the integrals stay the weights.
MIX_TILTS = (0.5, 0.0, -0.5)


@_query(
    "op1_mix_sources",
    r"""WITH sized AS (
          SELECT row_number() OVER () AS k, doc_id, source,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS ord
          FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
        ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS c FROM sources),
        weighted AS (SELECT *, CASE c WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                            CASE c WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS tilt FROM ranked),
        levels AS (
          SELECT *, 3 * s / w AS lvl,
                 CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER b, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate,
                 row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS k
          FROM weighted
          WINDOW b AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        rate AS (SELECT arg_min(rate, k) FILTER (WHERE rate <= lvl) AS r FROM levels),
        targets AS (SELECT source, s, w, tilt, least(CAST(3 * s AS DOUBLE), r * w) AS target FROM levels, rate),
        placed AS (
          SELECT sized.*, s, target, w, w * (1 + tilt) AS w0, w * (1 - tilt) - w * (1 + tilt) AS slope,
                 CAST(sum(size) OVER (PARTITION BY sized.source ORDER BY ord, doc_id, size, sized.k ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
          FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
        SELECT doc_id, size, s AS source_size, target,
               CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start))
                  + greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - s))
                  + greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - 2 * s)) AS BIGINT) AS taken,
               CASE WHEN size > 0 AND start < floor(target)
                    THEN round(2 * need / (w0 + sqrt(w0 * w0 + 2 * slope * need)), 6) END AS first_position
        FROM (SELECT *, (start + least(size, floor(target) - start) / 2) / target * w AS need FROM placed)""",
)
def _(spark, sf):
    docs = mixing.sized(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")).drop("text")
    # Repeated rows are documents of their own: each row has a number, drawn once.
    sizes = stored(docs.withColumn("row", F.monotonically_increasing_id()), "sizes")
    mixed = mixing.assign(sizes, mixing.ranked_knots(MIX_WEIGHTS, MIX_TILTS))
    order = stored(mixing.in_training_order(mixed, keep=["source_size", "target"], unplaced=True), "training_order")
    taken = mixing.per_document(order, "row", ["doc_id", "size", "source_size", "target"])
    return taken.select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 6).alias("first_position"))


@_query("op2_simhash")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    prints = simhash.fingerprints(docs).select("row", "doc_id", "fingerprint")
    found = simhash.components_of(prints)
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


@_query("op3_find_pii")
def _(spark, sf):
    found = pii.find(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        pii.digest(F.col("base")).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


@_query("op5_token_counts")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counted = tokens.count_tokens(docs, scratch_path(spark, "token_counts"), "word_bpe_49k.json")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@_query(
    "op7_decontaminate",
    r"""WITH d AS (
          SELECT row_number() OVER () AS k, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        b AS (
          SELECT item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        wide AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
        wins AS (
          SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
          FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM wide)),
        lengths AS (SELECT DISTINCT m FROM wins),
        dwins AS (
          SELECT k, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
          FROM (SELECT k, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lengths WHERE len(w) >= m)),
        found AS (SELECT k, i, m, item_id FROM dwins JOIN wins USING (m, win)),
        hit AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(generate_series(i, i + m - 1)) AS p FROM found) GROUP BY k),
        items AS (
          SELECT k, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)""",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = decontaminate.hits(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op8_lm_score")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = ppm.held_out(F.col("doc_id"))
    scores = ppm.score(docs, docs.filter(~held))
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op9_suffix_dedup")
def _(spark, sf):
    return suffixes.summary(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


# The rules that the url query judges by.
URL_RULES = (
    urls.UrlRule("com", "/", "allow"),
    urls.UrlRule("example.com", "/en/", "block"),
    urls.UrlRule("www.example.com", "/en/", "allow"),
    urls.UrlRule("net", "/es/", "block"),
    urls.UrlRule("net", "/fr/", "block"),
)


@_query(
    "op4_url_filter",
    r"""WITH parts AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
          FROM pages),
        rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
          ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        numbered AS (SELECT *, row_number() OVER () AS k FROM parts),
        fits AS (
          SELECT k, rule_host || rule_path AS rule, verdict,
                 row_number() OVER (PARTITION BY k ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
          FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM numbered LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (k)""",
)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# Fixed value: what both turns of the added conversation say.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@_query("op6_chat_format")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digests(chat.sequences(rows.unionByName(added)))


@_query(
    "op10_quality_rules",
    r"""WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
        tokens AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
        placed AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM tokens),
        windows AS (
          SELECT k, i, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c FROM placed
          WINDOW w AS (PARTITION BY k ORDER BY i)),
        counted AS (SELECT k, i, count(*) OVER (PARTITION BY k, word, b, c) AS n FROM windows WHERE c IS NOT NULL),
        covered AS (
          SELECT k, count(DISTINCT i + d) AS n FROM counted, (VALUES (0), (1), (2)) offs(d) WHERE n >= 2 GROUP BY k),
        lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs),
        line_counts AS (
          SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
        measured AS (
          SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                 CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
                 CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
          FROM docs JOIN tokens USING (k) LEFT JOIN covered USING (k) LEFT JOIN line_counts USING (k)),
        judged AS (
          SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1, 5 * n_symbols > n_words AS r2,
                 100 * n_dup_lines > 60 * n_lines AS r3, word_chars > 25 * n_words AS r4, word_chars < 2 * n_words AS r5
          FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r0 OR r1) AS base_failed,
               NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
               CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT AS BIGINT) AS failed
        FROM judged""",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    book = quality.ledger(docs)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejected(quality.BASE).alias("base_failed"),
        (~quality.rejected(quality.PRODUCTION)).alias("kept"),
        "failed",
    )


@_query(
    "op11_collocations",
    r"""WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[.,;:!?
-
]')) AS piece
          FROM documents),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
        placed AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded WHERE len(w) > 0),
        grams AS (
          SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS n
          FROM placed, (VALUES (1), (2), (3), (4)) lengths(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
        often AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE n >= 30),
        cuts AS (
          SELECT lang, k, phrase, n AS a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS part,
                 array_to_string(list_slice(w, cut + 1, k), ' ') AS rest
          FROM often, (VALUES (1), (2), (3)) c(cut) WHERE cut < k),
        scored AS (
          SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n) AS score
          FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.part JOIN often y ON y.lang = c.lang AND y.phrase = c.rest),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored),
        inner_parts AS (
          SELECT o.lang, o.n, array_to_string(list_slice(o.w, i, i + m - 1), ' ') AS phrase
          FROM often o, (VALUES (1), (2), (3)) starts(i), (VALUES (2), (3)) widths(m) WHERE m < o.k AND i + m - 1 <= o.k),
        longer AS (SELECT lang, phrase, max(n) AS most FROM inner_parts GROUP BY lang, phrase),
        kept AS (
          SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
          WHERE place = 1 AND NOT coalesce(100::HUGEINT * g.most >= 80::HUGEINT * s.a, false)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
               totals.n AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    return collocations.top(*collocations.mined(docs))


@_query("op12_align_tokens")
def _(spark, sf):
    return align.summary(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


@_query("op13_bpe_codec")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join("ids", " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )
