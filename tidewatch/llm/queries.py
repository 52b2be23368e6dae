"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, gif, html_text, neardup, neighbours, packing, pii, quality, repair, spelling, token_files, topk
from .common import table

TOKENIZER = "byte_bpe_50k.json"
TOKEN_FILE_END, PACKING_END = 2, 1
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_FILE_END)


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.divisible_queries(table(spark, sf_dir, "embeddings"), 20, 20)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_report(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control conversation -1; rows of the table that
    have this number themselves are turns of the same conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.chat_digests(turns.unionByName(control))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), PACKING_END, window=2048)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least=5, times=3, every=97)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.approximate_neighbours(table(spark, sf_dir, "embeddings"), by=20, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bpe, op3_main_text, op4_token_files, op5_gif, op6_topk, op7_near_dup, op8_pii, op9_chat, op10_packing, op11_spelling, op12_repair, op13_neighbours)}


OP6_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

OP7_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
flat AS (SELECT doc_id, unnest(s) AS v FROM shingled),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS at FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.at)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(r.at) AS component_id, min(r.at) = s.doc_id AS kept
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

OP9_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    length('<|im_start|>') + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n>')) + 1
      + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length('<|im_end|>') + 1 AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END AS legal
  FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, bool_and(legal) AS valid
FROM judged GROUP BY conv_id
"""


#: crc32 by its byte table; ``crc(bytes)`` is made by :func:`_crc`.
CRC_TABLE = "table_ AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"


def _crc(numbers: str) -> str:
    return f"xor(list_reduce({numbers}, lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))")} AS h FROM each, table_),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cuts AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.k = b.word UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.k = b.word),
ranked AS (SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS r FROM near JOIN words w ON w.word = other),
told AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form, CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND r = 1),
walk AS (SELECT word, word AS root, form AS next FROM told UNION ALL SELECT walk.word, told.word, told.form FROM walk JOIN told ON told.word = walk.next)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN walk ON walk.word = told.word AND walk.next IS NULL
"""


def _least(*ways: str) -> str:
    return "list_min([" + ", ".join(ways) + "])"


def _way(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """A state's (cost, audit, lines) after one more edit."""
    lines = f"{state}.o" if line is None else f"CASE WHEN {state}.o = '' THEN {line} ELSE {state}.o || chr(10) || {line} END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {lines}}}"


#: The states after a row, and then after insertions; x0 to x3: nothing yet, after system, user, assistant.
_KEEP = lambda s, kind: _way(s, f"CASE WHEN kind = {kind} THEN must + cut ELSE 1000000 END", "K", "role || ':' || text")
_NAME = lambda s, role: _way(s, "must + cut + 3", "R", f"'{role}:' || text")
_DROP = lambda s: _way(s, "4", "D")
_STEP = (
    f"{_DROP('x0')} AS y0, {_least(_DROP('x1'), _KEEP('x0', 1))} AS y1, "
    f"{_least(_DROP('x2'), *[_KEEP(s, 2) for s in ('x0', 'x1', 'x3')], *[_NAME(s, 'user') for s in ('x0', 'x1', 'x3')])} AS y2, {_least(_DROP('x3'), _KEEP('x2', 3), _NAME('x2', 'assistant'))} AS y3"
)
_OPEN = _least("y2", *[_way(s, "3", "I", "'user:'") for s in ("y0", "y1", "y3")])
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)")} % 20 AS h FROM conversations, table_),
harmed AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, h FROM named WHERE h <> 0),
twice AS (SELECT * FROM harmed UNION ALL SELECT * FROM harmed WHERE h = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM twice),
looked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS copy, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM placed),
judged AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind FROM looked),
rows_ AS (SELECT conv_id, k, role, text, kind, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1),
started AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': '', 'o': ''}} AS y0, {{'c': 1000000, 'a': '', 'o': ''}} AS y1 FROM conversations),
walk AS (
  SELECT conv_id, k, y0 AS x0, y1 AS x1, {_way("y0", "3", "I", "'user:'")} AS x2, {_way(f"({_way('y0', '3', 'I', chr(39) + 'user:' + chr(39))})", "3", "I", "'assistant:'")} AS x3 FROM started
  UNION ALL
  SELECT conv_id, k, y0, y1, z2, {_least("y3", _way("z2", "3", "I", "'assistant:'"))} FROM (
    SELECT *, {_OPEN} AS z2 FROM (SELECT w.conv_id, r.k, {_STEP} FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1))
), ended AS (SELECT conv_id, arg_max({_least("x0", "x3")}, k) AS best FROM walk GROUP BY 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL expresses; the others have tests against
    brute force, round trips or held-out rows."""
    return {"op6_topk": OP6_SQL, "op7_near_dup": OP7_SQL, "op9_chat": OP9_SQL, "op11_spelling": OP11_SQL, "op12_repair": OP12_SQL}
