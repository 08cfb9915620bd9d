"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import read

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.line_dedup import line_dedup

    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.token_count import token_counts

    return token_counts(read(spark, sf_dir, "documents"), _tokenizer(WORD_BPE))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.substring_dedup import substring_dedup

    return substring_dedup(read(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.decontamination import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.simhash import simhash_dedup

    return simhash_dedup(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.token_blocks import token_blocks

    return token_blocks(read(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.divergence import source_divergence

    return source_divergence(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.fill_in_middle import fill_in_middle

    return fill_in_middle(read(spark, sf_dir, "documents"), with_text=False)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodeworks.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = (
    op1_toxicity, op2_quality, op3_line_dedup, op4_token_counts, op5_substring_dedup, op6_decontamination, op7_exact_dedup, op8_simhash_dedup, op9_packing, op10_token_blocks,
    op11_source_divergence, op12_fill_in_middle, op13_jaccard_join,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), p AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l
), s AS (
  SELECT doc_id, i, rtrim(line, ' ') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM p WHERE rtrim(line, ' ') <> ''
), w AS (
  SELECT a.doc_id, a.n, [a.i, b.i, c.i] AS covers, [a.x, b.x, c.x] AS x FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN s c ON a.doc_id = c.doc_id AND c.n = a.n + 2
  UNION ALL SELECT doc_id, n, [i], [x] FROM s WHERE length(x) >= 240
), r AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, n) AS k FROM w
), g AS (
  SELECT DISTINCT doc_id, unnest(covers) AS i FROM r WHERE k > 1
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS text FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id
)
SELECT l.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(d.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM l LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY 1) c ON c.doc_id = l.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) d ON d.doc_id = l.doc_id LEFT JOIN kept ON kept.doc_id = l.doc_id
"""

def _sql_marked(column: str) -> str:
    from lodeworks.llm.decontamination import NAME_STEPS, NUMBER_STEPS

    for pattern, replacement in [*NAME_STEPS, *NUMBER_STEPS]:
        replacement = replacement.replace("$", "\\")
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return f"lower({column})"


def op6_sql() -> str:
    from lodeworks.llm.decontamination import JOINER, LEAST, NUMBER, SHARE, SHORTEST, TOKEN, WINDOW

    typed = f"[{NUMBER}-{JOINER}]"
    template = lambda table, key: f"SELECT {key}, words, list_transform(words, lambda w: CASE WHEN regexp_matches(w, '^{typed}') THEN w[1] ELSE w END) AS t FROM (SELECT DISTINCT {key}, regexp_extract_all({_sql_marked("coalesce(text, '')")}, '[{TOKEN}]+') AS words FROM {table})"
    plain = lambda table, key: f"SELECT {key}, t AS words, t FROM (SELECT DISTINCT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {table})"

    def search(of, name: str, least: int) -> str:
        """Tables of one search; their last, <name>_ok, has the diagonals that hold."""
        x = name
        return f"""
{x}_d AS ({of("documents", "doc_id")}), {x}_b AS (
  SELECT *, least(len(t), {WINDOW}) AS n FROM ({of("benchmark", "item_id")}) WHERE len(t) >= {least}
), {x}_bw AS (
  SELECT item_id, n, p, list_slice(t, p + 1, p + n) AS t, list_slice(words, p + 1, p + n) AS words FROM (SELECT *, unnest(range(len(t) - n + 1)) AS p FROM {x}_b)
), {x}_bs AS (
  SELECT * FROM {x}_bw WHERE len(list_filter(words, lambda w: regexp_matches(w, '^{typed}'))) * 2 < n
), {x}_bn AS (
  SELECT item_id, n_all, item_windows FROM (SELECT item_id, count(DISTINCT p) AS n_all FROM {x}_bw GROUP BY 1) JOIN (SELECT item_id, count(DISTINCT p) AS item_windows FROM {x}_bs GROUP BY 1) USING (item_id)
), {x}_dw AS (
  SELECT doc_id, n, p, list_slice(t, p + 1, p + n) AS t, list_slice(words, p + 1, p + n) AS words
  FROM (SELECT d.*, l.n, unnest(range(len(t) - l.n + 1)) AS p FROM {x}_d d, (SELECT DISTINCT n FROM {x}_b) l WHERE len(t) >= l.n)
), {x}_m AS (
  SELECT dw.doc_id, bs.item_id, dw.p - bs.p AS diagonal, bs.p, bs.words AS bw, dw.words AS dw FROM {x}_dw dw JOIN {x}_bs bs ON dw.n = bs.n AND dw.t = bs.t
), {x}_g AS (
  SELECT doc_id, item_id, diagonal, count(DISTINCT p) AS matched_windows FROM {x}_m GROUP BY ALL
), {x}_v AS (
  SELECT DISTINCT doc_id, item_id, diagonal, x, y FROM (SELECT doc_id, item_id, diagonal, unnest(bw) AS x, unnest(dw) AS y FROM {x}_m) WHERE regexp_matches(x, '^{typed}')
), {x}_c AS (
  SELECT doc_id, item_id, diagonal, count(*) = count(DISTINCT x) AS one_way, count(*) = count(DISTINCT y) AS other_way, bool_and(x = y) AS same FROM {x}_v GROUP BY ALL
), {x}_ok AS (
  SELECT g.doc_id, g.item_id, g.matched_windows, bn.item_windows, CASE WHEN coalesce(c.other_way, true) THEN 2 ELSE 1 END AS kind, coalesce(c.same, true) AS same_values
  FROM {x}_g g JOIN {x}_bn bn USING (item_id) LEFT JOIN {x}_c c ON c.doc_id = g.doc_id AND c.item_id = g.item_id AND c.diagonal = g.diagonal
  WHERE coalesce(c.one_way, true) AND g.matched_windows >= greatest(1, ceil(bn.item_windows * {SHARE}), ceil(bn.n_all * {SHARE} / 2))
)"""

    return f"""
WITH {search(template, "template", LEAST)}, {search(plain, "plain", SHORTEST)}, every AS (
  SELECT * FROM template_ok UNION ALL SELECT * REPLACE (CASE WHEN matched_windows = item_windows THEN 3 ELSE 0 END AS kind) FROM plain_ok
)
SELECT doc_id, item_id, matched_windows, item_windows, same_values FROM every
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY kind DESC, matched_windows DESC, same_values DESC, item_windows DESC) = 1
"""


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents
), r AS (
  SELECT doc_id, x, first_value(doc_id) OVER (PARTITION BY x ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM r
"""


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents
), t AS (
  SELECT lang, source, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10
), l AS (
  SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY 1
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), x AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own FROM x
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (own + 2 * v) AS p, 1 + 1000000000::HUGEINT * (total + 2) // (whole + 2 * v) AS q FROM s JOIN l USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term QUALIFY rank <= 10)
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), t AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2, ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (
  SELECT *, array_to_string(tokens[1 : a], '') AS prefix, array_to_string(tokens[a + 1 : b], '') AS middle, array_to_string(tokens[b + 1 : n], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op6_decontamination": op6_sql(), "op7_exact_dedup": OP7_SQL, "op11_source_divergence": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
