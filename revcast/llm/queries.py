"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    ann,
    ball_tree,
    bpe_automaton,
    chat,
    collocations,
    decontaminate,
    kneser_ney,
    licenses,
    near_dup,
    order_minhash,
    secrets,
    token_store,
    toxicity,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


@query("op1_license_templates", licenses.oracle_sql())
def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


@query("op2_learned_partitions")
def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_report(table(spark, sf_dir, "embeddings"))


@query("op3_lsh_forest", """
WITH RECURSIVE w AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
g AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n,
         array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS key
  FROM w),
sh AS (SELECT DISTINCT doc_id, key FROM g WHERE pos + 4 <= n OR (n < 5 AND pos = 1)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (key) WHERE x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, either.b FROM reach JOIN either ON either.a = reach.b),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN root USING (doc_id)
""")
def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_report(table(spark, sf_dir, "documents"))


@query("op4_huffman_ids")
def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_file_report(table(spark, sf_dir, "documents"))


@query("op5_decontaminate", """
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents)
  UNION ALL
  SELECT 'b', item_id, generate_subscripts(ws, 1), unnest(ws)
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark)),
g AS (
  SELECT side, id, pos, count(*) OVER (PARTITION BY side, id) AS n,
         list(word) OVER (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead
  FROM w),
windows AS (
  SELECT DISTINCT id AS item_id, least(n, 13) AS len, array_to_string(ahead, ' ') AS key
  FROM g WHERE side = 'b' AND (pos + 12 <= n OR (n < 13 AND pos = 1))),
lens AS (SELECT DISTINCT len FROM windows),
hits AS (
  SELECT g.id AS doc_id, g.pos, x.len, x.item_id
  FROM g CROSS JOIN lens JOIN windows x ON x.len = lens.len AND x.key = array_to_string(ahead[1:lens.len], ' ')
  WHERE side = 'd' AND pos + lens.len - 1 <= n),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + len)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id),
n AS (SELECT id AS doc_id, count(*) AS n_words FROM w WHERE side = 'd' GROUP BY id)
SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= coalesce(n.n_words, 0) AS contaminated
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_kneser_ney")
def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_model_report(table(spark, sf_dir, "documents"))


@query("op7_bpe_automaton")
def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.token_digests(table(spark, sf_dir, "documents"))


@query("op8_chat_round_trip", chat.ORACLE)
def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(chat.with_conflict_case(spark, table(spark, sf_dir, "conversations")))


@query("op9_secret_forest")
def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op10_toxicity_ftrl")
def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_order_minhash")
def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_report(table(spark, sf_dir, "documents"))


@query("op12_quotient_collocations", collocations.ORACLE)
def op12_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocation_report(table(spark, sf_dir, "documents"))


@query("op13_ball_tree_search", ball_tree.ORACLE)
def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
