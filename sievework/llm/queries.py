"""Queries of the problems on training text."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import functions as F

from sievework.llm import bpe, group_split, langid, leakage, lookalikes, mixing, record_dups, shared_spans, split_overlap
from sievework.session import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file: in TOKENIZER_DIR where that is set, else in the installed package or its folder."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.environ.get("TOKENIZER_DIR") or (os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers")
    return os.path.join(folder, name)


def _leaked(spark, d):
    items = table(spark, d, "items").where("split = 'eval' AND group_id IS NULL")
    return leakage.leaked(table(spark, d, "documents"), items, ["state", "question"])


def p1_found(spark, d):
    return _leaked(spark, d).select("doc_id", "item_id").distinct()


def p1_items(spark, d):
    return _leaked(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))


def p2_languages(spark, d):
    return langid.detect_languages(table(spark, d, "examples"), "row_id").withColumnRenamed("id", "row_id")


def p2_found(spark, d):
    rows = p2_languages(spark, d).where((F.col("n_langs") > 1) | ~F.col("fits"))
    return rows.select("row_id", "field_name", "lang")


def p2_segments(spark, d):
    """Each segment of the states that hold several languages."""
    rows = langid.segment_languages(table(spark, d, "examples"), "row_id")
    return rows.select(F.col("id").alias("row_id"), "text", "segment", "lang", F.round("confidence", 4).alias("confidence"), F.md5("content").alias("digest"))


def p3_found(spark, d):
    pairs = record_dups.layout_duplicates(table(spark, d, "examples"), "row_id")
    return pairs.select(F.col("rep").alias("row_id_a"), F.col("id").alias("row_id_b"))


def p3_records(spark, d):
    return record_dups.record_counts(table(spark, d, "examples"), "row_id").select(F.col("rep").alias("row_id"), "copies")


FIELDS = {"state": "state_lang", "choices": "choice_lang"}


def p4_repaired(spark, d):
    return lookalikes.repair_lookalikes(table(spark, d, "examples"), "row_id", FIELDS).withColumnRenamed("id", "row_id")


def p4_found(spark, d):
    """Fields that the repair changes, and those with a mixed-script word for which the corpus has no other spelling."""
    return p4_repaired(spark, d).where("changed OR size(unsolved) > 0").select("row_id", "field_name")


def _assigned(spark, d):
    return group_split.split_groups(table(spark, d, "examples"), table(spark, d, "split_targets"))


def p5_found(spark, d):
    return _assigned(spark, d).where("divided").select("group_id")


def p5_assign(spark, d):
    return _assigned(spark, d).select("group_id", "n_rows", "new_split")


def p5_shares(spark, d):
    return group_split.split_shares(_assigned(spark, d), table(spark, d, "split_targets"))


def p6_found(spark, d):
    pairs = split_overlap.overlap_pairs(*split_overlap.split_overlap(table(spark, d, "examples"), "row_id"))
    return pairs.select(F.least("id_e", "id_t").alias("row_id_a"), F.greatest("id_e", "id_t").alias("row_id_b"))


def p6_report(spark, d):
    rows = table(spark, d, "examples")
    return split_overlap.overlap_report(rows, *split_overlap.split_overlap(rows, "row_id"), "row_id")


def p7_ids(spark, d):
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"), tokenizer_path())


def _mix(spark, d, total="available"):
    """As many tokens as the targets' sources have: the small ones are short then, and what they lack is redistributed."""
    sizes = mixing.token_sizes(table(spark, d, "documents"), tokenizer_path())
    return mixing.mix_sources(sizes, table(spark, d, "mix_targets"), total)


def p8_mix(spark, d):
    return _mix(spark, d)[0]


def p8_shares(spark, d):
    return _mix(spark, d)[1]


def p8_balanced_shares(spark, d):
    """The largest mix in which every source with documents meets its share."""
    return _mix(spark, d, None)[1]


def p9_found(spark, d):
    pairs = shared_spans.sharing_pairs(*shared_spans.shared_spans(table(spark, d, "documents")))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_shared(spark, d):
    docs = table(spark, d, "documents")
    return shared_spans.shared_share(docs, *shared_spans.shared_spans(docs)).withColumnRenamed("id", "doc_id")


def p9_passages(spark, d):
    pairs, _ = shared_spans.shared_spans(table(spark, d, "documents"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"), F.explode("passages").alias("p")).select("doc_id_a", "doc_id_b", "p.*")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_items, p2_found, p2_languages, p2_segments, p3_found, p3_records, p4_found, p4_repaired, p5_found, p5_assign, p5_shares, p6_found, p6_report, p7_ids, p8_mix, p8_shares, p8_balanced_shares,
        p9_found, p9_shared, p9_passages,
    )
}
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_LEAKED = f"""
WITH fields AS (
  SELECT id, {_WORDS.format("state")} AS w FROM items WHERE split = 'eval' AND group_id IS NULL AND state IS NOT NULL
  UNION ALL SELECT id, {_WORDS.format("question")} FROM items WHERE split = 'eval' AND group_id IS NULL AND question IS NOT NULL),
docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
a AS (SELECT DISTINCT id, hash(w[i:i+15]) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 14)) AS i FROM fields)),
b AS (SELECT DISTINCT doc_id, hash(w[i:i+15]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 14)) AS i FROM docs)),
hits AS (SELECT DISTINCT doc_id, id AS item_id FROM a JOIN b USING (g))
"""
_FOLD = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_RECORDS = rf"""
WITH base AS (
  SELECT row_id, state, question, choices, CASE WHEN ltrim(state) LIKE '{{%' AND json_valid(state) THEN state END AS js
  FROM examples WHERE state IS NOT NULL AND regexp_matches(state, '[^\s\p{{Z}}]')),
members AS (
  SELECT row_id, list_sort(list({_FOLD.format("k")} || ':' ||
    CASE WHEN json_type(v) = 'VARCHAR' THEN {_FOLD.format("v ->> '$'")} ELSE {_FOLD.format("v::VARCHAR")} END))::VARCHAR AS m
  FROM (SELECT row_id, unnest(json_keys(js)) AS k, json_extract(js, '$.' || '"' || unnest(json_keys(js)) || '"') AS v FROM base WHERE js IS NOT NULL)
  GROUP BY row_id),
keyed AS (
  SELECT b.row_id, coalesce('j' || m, 't' || {_FOLD.format("state")}) AS s, {_FOLD.format("question")} AS q,
    list_sort(list_transform(choices, lambda x: {_FOLD.format("x")}))::VARCHAR AS c
  FROM base b LEFT JOIN members USING (row_id)),
records AS (SELECT *, min(row_id) OVER (PARTITION BY s, q, c) AS rep FROM keyed)
"""
_SPLIT = r"CASE regexp_replace(lower(split), '^\s+|\s+$', '', 'g') WHEN 'dev' THEN 'val' WHEN 'validation' THEN 'val' ELSE regexp_replace(lower(split), '^\s+|\s+$', '', 'g') END"
_OVERLAP = rf"""
WITH rows AS (
  SELECT row_id, source, {_SPLIT} AS sp, coalesce({_FOLD.format("question")}, '') AS q,
    list_distinct(list_filter(regexp_split_to_array(lower(state), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w
  FROM examples WHERE state IS NOT NULL AND regexp_matches(state, '[^\s\p{{Z}}]') AND split IS NOT NULL),
pairs AS (
  SELECT e.row_id AS id_e, t.row_id AS id_t FROM rows e JOIN rows t ON e.q = t.q AND e.sp IN ('val', 'test') AND t.sp = 'train'
    AND len(e.w) >= 0.8 * len(t.w) AND len(t.w) >= 0.8 * len(e.w)
  WHERE len(e.w) > 0 AND len(list_intersect(e.w, t.w)) * 1.0 / (len(e.w) + len(t.w) - len(list_intersect(e.w, t.w))) >= 0.8 - 1e-12)
"""

_PASSAGES = (
    _OVERLAP
    + r"""
, seq AS (SELECT row_id, list_filter(regexp_split_to_array(lower(state), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM examples WHERE state IS NOT NULL),
places AS (SELECT id_e, id_t, e.w AS we, ' ' || array_to_string(t.w, ' ') || ' ' AS text_t, least(5, len(e.w)) AS k, unnest(range(1, len(e.w) - least(5, len(e.w)) + 2)) AS i FROM pairs JOIN seq e ON id_e = e.row_id JOIN seq t ON id_t = t.row_id),
covered AS (SELECT id_e, count(DISTINCT p) AS n FROM (SELECT id_e, unnest(range(i, i + k)) AS p FROM places WHERE contains(text_t, ' ' || array_to_string(we[i:i + k - 1], ' ') || ' ')) GROUP BY id_e),
counts AS (SELECT id_e, count(*) AS n FROM pairs GROUP BY id_e),
shares AS (SELECT c.id_e, c.n, coalesce(v.n, 0) / len(w) AS share FROM counts c LEFT JOIN covered v USING (id_e) JOIN seq ON c.id_e = row_id),
evals AS (SELECT row_id, source, """
    + _SPLIT
    + " AS split FROM examples)\n"
)
SQL = {
    "p1_found": _LEAKED + "SELECT doc_id, item_id FROM hits",
    "p1_items": _LEAKED + "SELECT item_id, count(*) AS n_documents FROM hits GROUP BY item_id",
    "p9_found": """WITH w AS (SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE text IS NOT NULL))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p3_found": _RECORDS + "SELECT rep AS row_id_a, row_id AS row_id_b FROM records WHERE row_id <> rep",
    "p3_records": _RECORDS + "SELECT rep AS row_id, count(*) AS copies FROM records GROUP BY rep",
    "p5_found": rf"""SELECT g AS group_id FROM (SELECT regexp_replace(lower(group_id), '^\s+|\s+$', '', 'g') AS g, {_SPLIT} AS sp FROM examples
        WHERE group_id IS NOT NULL AND split IS NOT NULL) WHERE sp IN ('train', 'val', 'test') GROUP BY g HAVING count(DISTINCT sp) > 1""",
    "p6_found": _OVERLAP + "SELECT least(id_e, id_t) AS row_id_a, greatest(id_e, id_t) AS row_id_b FROM pairs",
    "p6_report": _PASSAGES
    + "SELECT split, source, count(*) AS n_rows, count(n) AS n_overlapping, coalesce(sum(n), 0)::BIGINT AS n_pairs, round(avg(share), 6) AS mean_coverage FROM evals LEFT JOIN shares ON row_id = id_e WHERE split IN ('val', 'test') GROUP BY ALL",
    "p9_shared": """WITH w AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE text IS NOT NULL)),
        s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
        c AS (SELECT doc_id, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) AS n FROM w JOIN s USING (h)),
        t AS (SELECT doc_id, sum(n)::BIGINT AS n FROM c GROUP BY doc_id)
        SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, round(CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) END, 6) AS share FROM documents LEFT JOIN t USING (doc_id)""",
}
