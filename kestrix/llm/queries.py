"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from .common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("op2_chat_format")
def op2(spark, sf_dir):
    from .chat import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_chats(turns))


@query("op3_html_extraction")
def op3(spark, sf_dir):
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op4_quality_rules")
def op4(spark, sf_dir):
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op5_url_filter",
    r"""
    WITH a AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), b AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a
    ), c AS (
        SELECT *, CASE
            WHEN ('.' || host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN ('.' || host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN ('.' || host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN ('.' || host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN ('.' || host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM b
    )
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN list_has_any(string_split(replace(host, '-', '.'), '.'), ['casino', 'casinos', 'phish', 'phishing', 'pills', 'porn', 'spam', 'viagra', 'warez', 'xxx']) THEN 'block'
        ELSE 'allow' END AS verdict FROM c
    """,
)
def op5(spark, sf_dir):
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


@query("op6_suffix_array_dedup")
def op6(spark, sf_dir):
    from .suffix import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


@query("op7_embedding_dedup")
def op7(spark, sf_dir):
    from .embedding import link_embeddings

    return link_embeddings(table(spark, sf_dir, "embeddings"))


@query("op8_simhash_dedup")
def op8(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_source_mixing")
def op9(spark, sf_dir):
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "epoch", "block", "n_tokens", "position")


@query("op10_language_id")
def op10(spark, sf_dir):
    from .language import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))
