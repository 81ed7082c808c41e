"""The registered queries of the corpus operators, with the SQL that some of them are checked against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import (
    fingerprints,
    html_region,
    lines,
    mixing,
    packing,
    phrases,
    prefix_trie,
    quality,
    secret_scan,
    simhash,
    token_files,
    toxicity,
    tree_packing,
)
from storyloom.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Where the vocabulary files of the public tokenizers are; None asks the package that installs them.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS is not None:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", "fingerprint", "component_id")


@query(
    "op9_mixing",
    r"""
    WITH sized AS (
        SELECT doc_id, source,
               len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS w
        FROM sized GROUP BY source
    ), reached AS (
        SELECT *, 3.0::DOUBLE * source_size AS cap,
               row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, encode(source)) AS place,
               (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER earlier, 0))
               / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
        FROM sources
        WINDOW earlier AS (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, encode(source)
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), filled AS (
        SELECT source, source_size,
               least(cap, coalesce(w * (SELECT arg_min(level, place) FROM reached WHERE level * w <= cap), cap)) AS target
        FROM reached
    ), planned AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM filled
    ), drawn AS (
        SELECT *, target - whole * source_size AS missing,
               ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
        FROM sized JOIN planned USING (source)
    ), counted AS (
        SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= missing AND missing > 0)::INT AS more
        FROM drawn
    ), gaps AS (
        SELECT source, max(missing) - sum(size * more) AS gap FROM counted GROUP BY source
    ), fillers AS (
        SELECT arg_min(doc_id, (abs(size - gap), draw, doc_id)) AS doc_id, 1 AS fill
        FROM counted JOIN gaps USING (source)
        WHERE more = 0 AND size > 0 AND gap > 0 AND abs(size - gap) < gap
        GROUP BY source
    )
    SELECT doc_id, size, source_size, target, (size * (whole + more + coalesce(fill, 0)))::BIGINT AS taken
    FROM counted LEFT JOIN fillers USING (doc_id)
    """,
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mixing.sized(table(spark, sf_dir, "documents")), "mixing")
    return mixing.mix(rows).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query(
    "op3_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, line, place,
               translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place
              FROM (SELECT doc_id, string_split(coalesce("text", ''), E'\n') AS l FROM documents))
    ), shared AS (
        SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    )
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(shared.key)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, E'\n' ORDER BY place) FILTER (shared.key IS NULL), '')) AS kept_sha256
    FROM lines LEFT JOIN shared USING (key)
    GROUP BY doc_id
    """,
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select("doc_id", *quality.ADDED)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    path = tokenizer_path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, path, end_id=2, vocabulary=49_408)
    return token_files.read_documents(spark, folder, vocabulary=49_408)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.packed_documents(table(spark, sf_dir, "documents"), path, capacity=2048, end_id=0)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_region.extract(pages, html_region.fit(pages))
    text = F.col("main_text").alias("text")
    return found.select("page_id", "url", text, F.length("main_text").cast("long").alias("n_chars"))


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = ["n_assign", "n_access", "n_hex"]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op4_document_fingerprints")
def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_beside_next(table(spark, sf_dir, "documents"))


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    pieces = tree_packing.packed_documents(table(spark, sf_dir, "documents"), path, vocabulary=50_257, capacity=1024, end_id=0)
    return tree_packing.ids_crc32(pieces, width=2).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op12_phrases",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
            translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
        FROM documents
    ), spans AS (
        SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
    ), counts AS (
        SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 30
    ), sizes AS (
        SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
    ), candidates AS (
        SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
    ), insides AS (
        SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT *, unnest(generate_series(1, k - j + 1)) AS i
              FROM candidates JOIN (SELECT unnest([2, 3]) AS j) ON j < k)
        GROUP BY ALL
    ), cuts AS (
        SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest
        FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM candidates LEFT JOIN insides USING (lang, phrase)
              WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
    ), scored AS (
        SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f))::BIGINT AS score,
               row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY 2000000 * a::HUGEINT // (x.f + y.f), c) AS place
        FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = first
        JOIN counts y ON y.lang = cuts.lang AND y.phrase = rest
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE place = 1
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
    """,
)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=30, contained_percent=80, top=2000)


@query(
    "op11_prefix_trie",
    r"""
    WITH turns AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
               {'role': coalesce(role, ''), 'text': coalesce("text", '')} AS said
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
                   list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                            lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM turns)
    ), paths AS (
        SELECT c.conv_id, coalesce(list(t.said ORDER BY t.conv_id <> c.base OR t.pos >= h, t.pos) FILTER (t.said IS NOT NULL), []) AS p
        FROM convs c LEFT JOIN turns t ON t.conv_id = c.base AND t.pos < h OR t.conv_id = c.conv_id AND t.pos >= h
        GROUP BY c.conv_id
    ), steps AS (
        SELECT conv_id, len(p) AS full_depth, d, p[1:d] AS q FROM (SELECT *, unnest(generate_series(0, len(p))) AS d FROM paths)
    ), nodes AS (
        SELECT q, d, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (full_depth = d), '')) AS ends_sha256
        FROM steps GROUP BY q, d
    ), linked AS (
        SELECT n.*, u.conv_id AS parent_conv_id, count(k.q) AS n_children,
               CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.q[n.d]['text']) END AS saved
        FROM nodes n LEFT JOIN nodes u ON n.d = u.d + 1 AND n.q[1:n.d - 1] = u.q
        LEFT JOIN nodes k ON k.d = n.d + 1 AND k.q[1:n.d] = n.q
        GROUP BY ALL
    ), above AS (
        SELECT q[1:e] AS q, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(generate_series(0, d)) AS e FROM linked) GROUP BY ALL
    )
    SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM linked JOIN above USING (q, d)
    """,
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), every=5, most=9)
