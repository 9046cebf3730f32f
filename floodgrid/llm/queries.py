"""Registered queries of the subpackage, one for each operator, and their SQL where it exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgrid.llm import conversation_repair, decontaminate, hyperminhash, jaccard_join, lexical_rank, license_scan, mixing, quality_gam, quality_rules, secret_scan, token_cache, warc_revisit, wavelet
from floodgrid.runtime import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Lower-cases A-Z only.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""
    WITH d AS (SELECT doc_id, {_SQL_ALNUM} AS w FROM documents),
    i AS (SELECT item_id, {_SQL_ALNUM} AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)
    ),
    ks AS (SELECT DISTINCT k FROM win),
    dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
    hits AS (
        SELECT x.doc_id, x.p, x.k, win.item_id
        FROM (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM dw) x JOIN win ON x.g = win.g AND x.k = win.k
    ),
    pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
    its AS (
        SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1
    )
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
        coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
    """
)
def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf, "benchmark"), keep_text=False)
    h = F.col("hits")
    return found.select(
        "row.doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        h["n_items"].alias("n_items"),
        decontaminate.items_digest(h["items"]).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


END_OF_DOCUMENT = 2


@query()
def op2_wavelet_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    wavelet.write_shards(docs, out, public_tokenizers.path("word_bpe_49k.json"), END_OF_DOCUMENT)
    return wavelet.read_documents(spark, out)


@query()
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_cache.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache, keep=["doc_id"])
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf, "documents"), keep=["doc_id"])


@query()
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf, "documents"), keep=["doc_id"])


_SQL_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    f"""
    WITH d AS (
        SELECT doc_id, source, len({_SQL_SPACE_WORDS})::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
    ),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
    ),
    o AS (
        SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
            coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_size,
            coalesce(sum(w) OVER (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_w
        FROM s
    ),
    c AS (SELECT *, (total - 3 * below_size)::DOUBLE * w / (ws - below_w) > 3.0::DOUBLE * source_size AS capped FROM o),
    t AS (
        SELECT source, source_size,
            CASE WHEN capped THEN 3.0::DOUBLE * source_size
            ELSE (total - 3 * sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ())::DOUBLE * w / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE
            END AS target
        FROM c
    ),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS full_takes FROM t),
    q AS (SELECT *, CASE WHEN full_takes < 3 AND source_size > 0 THEN target - full_takes * source_size ELSE 0 END AS budget FROM p),
    g AS (
        SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
        FROM d WHERE size > 0 GROUP BY source, h
    ),
    e AS (
        SELECT q.source, min(h) AS h, arg_min(words, h) AS words, arg_min(budget - upto + words, h) AS rest
        FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source WHERE upto > budget GROUP BY q.source
    )
    SELECT d.doc_id, d.size, q.source_size, q.target,
        (d.size * (full_takes + CASE WHEN e.h IS NULL THEN (budget > 0)::INT WHEN d.h < e.h + (2 * rest > words)::INT THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source
    """
)
def op7_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


@query()
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text"), keep=["doc_id"])
    return judged.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("probability", 4).alias("probability"),
    )


@query()
def op9_quality_gam(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality_gam.classify(docs, table(spark, sf, "labels"), keep=["doc_id"])
    return scored.select(
        "row.doc_id",
        quality_gam.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


# Each page is captured four times, a day apart and a minute after the page before: a response, a
# revisit, a second response with a new tag (every third page) or a revisit that has only a date,
# and a last revisit. Every seventh page's first capture is a revisit, so nothing is earlier.
def warc_records(pages: DataFrame) -> DataFrame:
    """Capture records derived from whole pages."""
    shots = pages.selectExpr("page_id", "url", "md5(html) AS digest", "octet_length(html) AS size", "explode(sequence(0, 3)) AS j")
    full = ((F.col("j") == 0) & (F.col("page_id") % 7 != 0)) | ((F.col("j") == 2) & (F.col("page_id") % 3 == 0))
    second = (F.col("j") >= 2) & (F.col("page_id") % 3 == 0)
    tag = F.concat(F.lit('"'), F.col("digest"), F.when(second, "-2").otherwise(""), F.lit('"'))
    tag = F.when(~full & (F.col("page_id") % 5 == 0), F.concat(F.lit("W/"), tag)).when(~full & (F.col("page_id") % 11 == 0), "stale").otherwise(tag)
    dated = (F.col("j") == 2) & ~full
    pairs = F.array(
        F.struct(F.lit("Content-Length").alias("name"), F.when(full, F.col("size")).otherwise(0).cast("string").alias("value")),
        F.struct(F.lit("Date").alias("name"), (F.col("page_id") * 60 + F.col("j") * 86400).cast("string").alias("value")),
        F.struct(F.lit("ETag").alias("name"), F.when(~dated, tag).alias("value")),
        F.struct(F.lit("Last-Modified").alias("name"), F.when(F.col("page_id") % 2 == 0, (F.col("page_id") % 100).cast("string")).alias("value")),
        F.struct(F.lit("X-Cache").alias("name"), F.when(~full, F.lit("revalidated")).alias("value")),
    )
    return shots.select(
        (F.col("page_id") * 4 + F.col("j")).alias("record_id"),
        "url",
        (F.col("page_id") * 60 + F.col("j") * 86400).alias("date"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(full, 200).otherwise(304).alias("status"),
        F.filter(pairs, lambda h: h["value"].isNotNull()).alias("headers"),
    )


_SQL_CANONICAL = r"""
    CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]')
    THEN regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '')
        || CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
           ELSE regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') END
        || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&'), ''), '')
    ELSE trim(regexp_replace(url, '#.*$', '')) END
"""


@query(
    f"""
    WITH shots AS (
        SELECT page_id, j, {_SQL_CANONICAL} AS canonical_url, page_id * 4 + j AS record_id, page_id * 60 + j * 86400 AS date,
            (j = 0 AND page_id % 7 <> 0) OR (j = 2 AND page_id % 3 = 0) AS whole, strlen(html) AS size,
            '"' || md5(html) || CASE WHEN j >= 2 AND page_id % 3 = 0 THEN '-2' ELSE '' END || '"' AS tag,
            CASE WHEN page_id % 2 = 0 THEN (page_id % 100)::VARCHAR END AS modified
        FROM (SELECT page_id, url, html, unnest(range(4)) AS j FROM pages)
    ),
    r AS (SELECT * FROM shots WHERE whole),
    v AS (
        SELECT *, CASE WHEN j = 2 THEN NULL WHEN page_id % 5 = 0 THEN 'W/' || tag WHEN page_id % 11 = 0 THEN 'stale' ELSE tag END AS own,
        FROM shots WHERE NOT whole
    ),
    m AS (
        SELECT v.*, r.record_id AS response_id, r.tag AS old_tag, r.modified AS old_modified, r.size AS old_size,
            CASE WHEN r.record_id IS NULL THEN 'no_response'
                WHEN own IS NOT NULL THEN CASE WHEN regexp_replace(own, '^W/', '') = r.tag THEN 'resolved' ELSE 'changed' END
                WHEN v.modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN v.modified = r.modified THEN 'resolved' ELSE 'changed' END
                ELSE 'unvalidated' END AS outcome
        FROM v LEFT JOIN LATERAL (
            SELECT * FROM r WHERE r.canonical_url = v.canonical_url AND r.date < v.date ORDER BY r.date DESC, r.record_id DESC LIMIT 1
        ) r ON TRUE
    )
    SELECT record_id, canonical_url, date, outcome, response_id,
        CASE WHEN outcome = 'resolved' THEN concat_ws('; ', 'Content-Length: ' || old_size,
            CASE WHEN own IS NULL THEN 'ETag: ' || old_tag END, CASE WHEN modified IS NULL THEN 'Last-Modified: ' || old_modified END)
        ELSE 'Content-Length: 0' END
        || concat('; Date: ', date) || coalesce('; ETag: ' || own, '') || coalesce('; Last-Modified: ' || modified, '') || '; X-Cache: revalidated' AS headers
    FROM m
    """
)
def op3_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    resolved = warc_revisit.resolve_revisits(warc_records(table(spark, sf, "pages")))
    text = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "; ")
    return resolved.withColumn("headers", text)


@query()
def op8_jaccard_classes(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.link_classes(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    f"""
    WITH d AS (SELECT doc_id, {_SQL_ALNUM} AS w FROM documents),
    st AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
    i AS (SELECT DISTINCT item_id, unnest({_SQL_ALNUM}) AS term FROM benchmark),
    tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
    wt AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
        FROM tf, st WHERE term IN (SELECT term FROM i) GROUP BY term, docs
    ),
    s AS (
        SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
        FROM i JOIN wt USING (term) JOIN tf USING (term), st GROUP BY ALL
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """
)
def op11_lexical_ranking(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lexical_rank.rank_documents(docs, table(spark, sf, "benchmark"))


@query()
def op13_hyperminhash_classes(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.near_classes(table(spark, sf, "documents").select("doc_id", "text"))


# CRC-32 of a text of ASCII characters: every byte is mixed in and shifted out bit by bit.
_SQL_CRC = """xor(list_reduce(
    flatten(list_transform(range(1, length(k) + 1), lambda i: list_concat([ascii(k[i])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    4294967295::BIGINT), 4294967295::BIGINT)"""


# Per state of the pattern the least (cost, audit), with the repaired lines riding along.
def _sql_repair() -> str:
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"

    def move(state: str, cost: str, edit: str, line: str | None, when: str = "true") -> str:
        lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
        return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {lines}}} ELSE {never} END"

    def read(targets: dict[str, list[str]]) -> str:
        return ", ".join(f"list_min([{', '.join(ways)}]) AS {target}" for target, ways in targets.items())

    stays = "NOT blank AND NOT dup"
    more = "3 * truncated::INT"
    kept, user, assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    gone = {x: [move(x, "4", "D", None)] for x in ("st", "sy", "pr", "op")}
    row = {
        "st": gone["st"],
        "sy": [*gone["sy"], move("st", more, "K", kept, f"{stays} AND role[1] = 's'")],
        "pr": [*gone["pr"], move("op", more, "K", kept, f"{stays} AND role[1] = 'a'"), move("op", f"3 + {more}", "R", assistant, stays)],
        "op": [*gone["op"]]
        + [move(x, more, "K", kept, f"{stays} AND role[1] = 'u'") for x in ("st", "sy", "pr")]
        + [move(x, f"3 + {more}", "R", user, stays) for x in ("st", "sy", "pr")],
    }
    new_user, new_assistant = "'user:'", "'assistant:'"
    opened = ["op", *[move(x, "3", "I", new_user) for x in ("st", "sy", "pr")]]
    # Two rounds hold every useful row of insertions: none is worth more than a pair.
    insert = {"st": ["st"], "sy": ["sy"], "pr": ["pr", move("op", "3", "I", new_assistant)], "op": opened}
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} AS k FROM conversations),
    f AS (SELECT *, {_SQL_CRC} % 20 AS fault FROM k),
    d AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
        FROM f WHERE fault <> 0
    ),
    o AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
            NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut
        FROM d
    ),
    g AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM o),
    r AS (SELECT *, cut AND NOT blank AND NOT dup AS truncated, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM g),
    s AS (
        SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END::BIGINT AS gaps, count(*) AS n,
            count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (dup)::BIGINT AS duplicate, count(*) FILTER (truncated)::BIGINT AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
        FROM r GROUP BY 1
    ),
    p AS (
        SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS st, {never} AS sy, {never} AS pr, {never} AS op FROM s
        UNION ALL
        SELECT conv_id, i, st, sy, pr, op FROM (
            SELECT conv_id, i, {read(insert)} FROM (
                SELECT conv_id, i, {read(insert)} FROM (
                    SELECT conv_id, r_i AS i, {read(row)} FROM (
                        SELECT conv_id, r.i AS r_i, role, text, blank, dup, truncated, {read(insert)}
                        FROM (SELECT conv_id, i, {read(insert)} FROM p) q JOIN r USING (conv_id) WHERE r.i = q.i + 1
                    )
                )
            )
        )
    ),
    e AS (SELECT p.conv_id, list_min([st, pr]) AS best FROM p JOIN s ON p.conv_id = s.conv_id AND p.i = s.n)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
        coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN e USING (conv_id)
    """


@query(_sql_repair())
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    return conversation_repair.repair(conversation_repair.damage(conversations), ids=conversations)
