"""Queries over the given tables, one per operator, and the SQL that some must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ordermill.llm import decontaminate, fill_in_middle, html_text, jaccard, licenses, multiset, ngram_lm, packing
from ordermill.llm import quality, token_counts, toxicity, url_filter, whitening
from ordermill.llm.labelled import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scores(documents: DataFrame, score, threshold: float) -> DataFrame:
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return _scores(documents, toxicity.score(model, F.col("text")), 0.5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return documents.select("doc_id", licenses.license_scan()("text").alias("found")).select("doc_id", "found.*")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), width=4, percent=85)


OP3_SQL = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    sets AS (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS shingle
        FROM words
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id
    ),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * common >= 85 * (x.n + y.n - common)
    ),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
    )
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
    JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical form of every URL that a feed hands out (utm_ parameters)."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fed = pages.where(F.col("url").rlike(r"[?&]utm_[a-z]+="))
    listed = fed.select(url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("canonical"))
    return url_filter.judge(pages, listed)


OP4_SQL = r"""
    WITH parts AS (
        SELECT page_id, url,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ),
    whole AS (
        SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') END AS canonical
        FROM parts
    ),
    ruled AS (
        SELECT *, CASE
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
        FROM whole
    )
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
        WHEN rule IS NOT NULL THEN 'block'
        WHEN canonical IN (SELECT canonical FROM whole WHERE canonical IS NOT NULL AND regexp_matches(url, '[?&]utm_[a-z]+=')) THEN 'block'
        ELSE 'allow' END AS verdict
    FROM ruled
"""


def op5_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprints(_table(spark, sf_dir, "documents"))


def _lanes_sql(text: str) -> str:
    """The 128 lanes of a text as a list: the sums of what its paragraphs add to each."""
    touched = ", ".join(
        f"CAST('0x' || substr(h, {16 * i + 1}, 2) AS INTEGER) % 128 * 65536 + CAST('0x' || substr(h, {16 * i + 3}, 4) AS INTEGER)"
        for i in range(4)
    )
    listed = f"flatten(list_transform(CASE WHEN {text} = '' THEN [] ELSE string_split({text}, chr(10)) END, lambda p: list_transform([sha256(p)], lambda h: [{touched}])[1]))"
    return f"list_transform([{listed}], lambda c: list_transform(range(128), lambda l: CAST(coalesce(list_sum(list_transform(list_filter(c, lambda x: x // 65536 = l), lambda x: x % 65536)), 0) AS BIGINT) % 65536))[1]"


def _likeness_sql(a: str, b: str) -> str:
    used = f"len(list_filter(range(1, 129), lambda i: {a}[i] <> 0 OR {b}[i] <> 0))"
    return f"CASE WHEN {used} = 0 THEN 1.0 ELSE CAST(len(list_filter(range(1, 129), lambda i: {a}[i] = {b}[i] AND {a}[i] <> 0)) AS DOUBLE) / {used} END"


OP5_SQL = f"""
    WITH ordered AS (
        SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
            coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id,
            coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS after
        FROM documents
    ),
    edited AS (
        SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(after, 1, n_chars // 3) AS changed FROM ordered
    ),
    lanes AS (
        SELECT doc_id, n_chars, next_id, sha256(changed) AS edited_sha256, {_lanes_sql('text')} AS own, {_lanes_sql('changed')} AS other,
            {_lanes_sql('after')} AS following
        FROM edited
    )
    SELECT doc_id, n_chars, next_id, edited_sha256,
        array_to_string(list_transform(own, lambda x: lower(lpad(hex(x), 4, '0'))), '') AS fingerprint,
        array_to_string(list_transform(other, lambda x: lower(lpad(hex(x), 4, '0'))), '') AS edited_fingerprint,
        {_likeness_sql('own', 'other')} AS near_edited, {_likeness_sql('own', 'following')} AS near_next
    FROM lanes
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, _table(spark, sf_dir, "labels"))
    return _scores(documents, quality.score(model, F.col("text")), 0.3)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    # A null id counts as ''.
    outside = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    model = ngram_lm.fit(documents.where(~outside))
    scored = ngram_lm.score(model, documents)
    return scored.select(
        "doc_id", outside.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", "perplexity",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
    WITH given AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    cut AS (
        SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
            CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
        FROM given
    ),
    formed AS (
        SELECT *, CAST(len(units) AS BIGINT) AS n, CASE
            WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM cut
    ),
    parts AS (
        SELECT *, coalesce(array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], ''), '') AS pre,
            coalesce(array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') AS mid,
            coalesce(array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], ''), '') AS suf
        FROM formed
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    q.__name__: q
    for q in (
        op1_toxicity, op2_license_scan, op3_ngram_jaccard, op4_url_filter, op5_multiset_fingerprint, op6_best_fit_packing,
        op7_quality, op8_html_text, op9_token_counts, op10_decontaminate, op11_whitening,
        op12_kneser_ney, op13_fill_in_middle, pipeline,
    )
}
SQL = {"op3_ngram_jaccard": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_multiset_fingerprint": OP5_SQL, "op13_fill_in_middle": OP13_SQL}
