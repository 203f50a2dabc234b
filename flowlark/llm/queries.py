"""The queries of this subpackage, each over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm.bpe import bpe_round_trip
from flowlark.llm.chat import format_conversations
from flowlark.llm.common import table
from flowlark.llm.decontaminate import contaminated_pairs
from flowlark.llm.dedup import duplicate_groups
from flowlark.llm.licenses import CUES, NAMED, PARTING, TEMPLATES, license_scan
from flowlark.llm.negatives import hard_negatives
from flowlark.llm.ngram_join import ngram_jaccard_join
from flowlark.llm.quality_classifier import quality_scores
from flowlark.llm.repair import damaged, repair_conversations, with_untouched
from flowlark.llm.rules import quality_report
from flowlark.llm.token_counts import token_counts
from flowlark.llm.toxicity import toxicity_scores
from flowlark.llm.warc import warc_round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), least=1000)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, num=1, den=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rows=12_000)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rows=20_000, threshold=0.3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def quoting(conversations: DataFrame) -> DataFrame:
    """``conversations`` in which each odd turn quotes the turn before it, marks and all, as mail does."""
    before = conversations.where("text IS NOT NULL").groupBy(F.col("conv_id").alias("_conv"), (F.col("turn") + 1).alias("_turn")).agg(F.min("text").alias("_before"))
    quoted = F.concat(F.lit("> "), F.replace(F.col("_before"), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    joined = conversations.join(before, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return joined.select("conv_id", "turn", "role", F.when(F.col("_before").isNotNull() & (F.col("turn") % 2 == 1), quoted).otherwise(F.col("text")).alias("text"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(quoting(table(spark, sf_dir, "conversations")))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one document in five stands where a directory keeps its licence, so that directories have some to hand down
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("LICENSE-")).otherwise(F.lit("")), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/d"), F.expr("CAST(doc_id DIV 1000 AS STRING)"), F.lit("/"), name)
    return license_scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return with_untouched(repair_conversations(damaged(conversations)), conversations)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op6_byte_level_bpe": op6_byte_level_bpe,
    "op10_token_counts": op10_token_counts,
    "op7_warc": op7_warc,
    "op9_decontamination": op9_decontamination,
    "op2_toxicity": op2_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op5_chat_formatting": op5_chat_formatting,
    "op8_license_scans": op8_license_scans,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)),
n AS (SELECT w.doc_id, CAST(count(sh.g) AS BIGINT) AS n FROM w LEFT JOIN sh ON w.doc_id = sh.doc_id GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * o >= 90 * (a.n + b.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS s, doc_id AS t FROM n UNION SELECT r.s, e.y FROM reach r JOIN edges e ON r.t = e.x),
sets AS (SELECT doc_id, string_agg(g, '|' ORDER BY g) AS k FROM sh GROUP BY 1),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM sets)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.class_id, n.doc_id) AS class_id, r.component_id
FROM n JOIN (SELECT s, min(t) AS component_id FROM reach GROUP BY 1) r ON n.doc_id = r.s LEFT JOIN classes c ON n.doc_id = c.doc_id
"""

#: Lines, passages (runs of lines of one level), links to first messages, and paths by recursion.
OP5_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, 'unknown') AS role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (SELECT r, conv_id, turn, i, ls[i] AS line, regexp_extract(ls[i], '^(?:[ \t]*>)+') AS mark FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
v AS (SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, regexp_replace(line, '^(?:[ \t]*>)+ ?', '') AS txt FROM l),
g AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY i) AS prev FROM v)),
p AS (SELECT r, conv_id, turn, level, run, string_agg(txt, chr(10) ORDER BY i) AS txt FROM g GROUP BY 1, 2, 3, 4, 5),
bodies AS (SELECT r, regexp_replace(string_agg(txt, chr(10) ORDER BY run), '^\n+|\n+\z', '', 'g') AS body FROM p WHERE level = 0 GROUP BY 1),
b AS (SELECT m.r, m.conv_id, m.turn, m.role, coalesce(bodies.body, '') AS body FROM m LEFT JOIN bodies ON m.r = bodies.r),
q AS (SELECT r, conv_id, turn, level, txt FROM p WHERE level > 0 AND length(trim(txt)) > 0),
qk AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(u), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS k FROM (SELECT conv_id, turn, level, txt AS u FROM q UNION ALL SELECT conv_id, turn, level, unnest(string_split(txt, chr(10))) FROM q) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ok AS (SELECT conv_id, trim(regexp_replace(lower(u), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS k, min(turn) AS original FROM (SELECT conv_id, turn, body AS u FROM b UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM b) WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
links AS (SELECT qk.conv_id, qk.turn, level, max(original) AS original FROM qk JOIN ok ON qk.conv_id = ok.conv_id AND qk.k = ok.k WHERE qk.k <> '' AND original < qk.turn GROUP BY 1, 2, 3),
parents AS (SELECT conv_id, turn, arg_min(original, level) AS parent, CAST(count(*) AS BIGINT) AS n FROM links GROUP BY 1, 2),
roots AS (SELECT DISTINCT b.conv_id, b.turn FROM b LEFT JOIN parents ON b.conv_id = parents.conv_id AND b.turn = parents.turn WHERE parents.turn IS NULL AND b.conv_id IS NOT NULL AND b.turn IS NOT NULL),
paths AS (SELECT conv_id, turn, [turn] AS path, turn AS root, CAST(0 AS BIGINT) AS depth FROM roots UNION ALL SELECT c.conv_id, c.turn, list_append(a.path, c.turn), a.root, a.depth + 1 FROM paths a JOIN parents c ON c.conv_id = a.conv_id AND c.parent = a.turn),
placed AS (SELECT conv_id, turn, root, depth, CAST(row_number() OVER (PARTITION BY conv_id, root ORDER BY path) - 1 AS BIGINT) AS position FROM paths)
SELECT b.conv_id, b.turn, b.role, parents.parent AS parent_turn, coalesce(placed.root, b.turn) AS root_turn, coalesce(placed.depth, 0) AS depth, coalesce(placed.position, 0) AS position,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_quotes, coalesce(parents.n, 0) AS n_linked_levels, b.body, '<|' || b.role || '|>' || chr(10) || b.body || chr(10) || '<|end|>' AS formatted
FROM b LEFT JOIN parents ON b.conv_id = parents.conv_id AND b.turn = parents.turn LEFT JOIN placed ON b.conv_id = placed.conv_id AND b.turn = placed.turn
LEFT JOIN (SELECT r, count(*) AS n FROM q GROUP BY 1) c ON b.r = c.r
"""

#: The same over conversations in which odd turns quote the turn before.
OP5_QUOTING_SQL = OP5_SQL.replace("WITH RECURSIVE m AS", """WITH RECURSIVE before AS (SELECT conv_id, turn + 1 AS turn, min(text) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2),
quoting AS (SELECT c.conv_id, c.turn, role, CASE WHEN t IS NOT NULL AND c.turn % 2 = 1 THEN '> ' || replace(t, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(text, '') ELSE text END AS text FROM conversations c LEFT JOIN before b ON c.conv_id = b.conv_id AND c.turn = b.turn),
m AS""").replace("FROM conversations)", "FROM quoting)", 1)

_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
OP8_SQL = rf"""
WITH tpl(template, license, body) AS (VALUES {_TEMPLATE_ROWS}),
tw AS (SELECT template, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+(?:\.[0-9]+)*')) AS word FROM tpl),
df AS (SELECT word, count(DISTINCT template) AS df FROM tw GROUP BY 1),
ttf AS (SELECT template, license, tw.word, count(*) * (ln(({len(TEMPLATES)} + 1.0) / (1.0 + any_value(df.df))) + 1.0) AS w FROM tw JOIN df ON tw.word = df.word GROUP BY 1, 2, 3),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM ttf GROUP BY 1),
files AS (SELECT doc_id, coalesce(source, '') || '/d' || CAST(doc_id // 1000 AS VARCHAR) || '/' || CASE WHEN doc_id % 5 = 0 THEN 'LICENSE-' ELSE '' END || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents),
cue AS (SELECT * FROM files WHERE regexp_matches(text, '{CUES}')),
units AS (SELECT doc_id, i AS unit, ls[i + 1] AS body FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM cue)) WHERE regexp_matches(ls[i + 1], '{CUES}')
          UNION ALL SELECT doc_id, -2 - i, ps[i + 1] FROM (SELECT doc_id, ps, unnest(range(len(ps))) AS i FROM (SELECT doc_id, string_split_regex(text, '{PARTING}') AS ps FROM cue)) WHERE regexp_matches(ps[i + 1], '{CUES}') AND contains(ps[i + 1], chr(10))
          UNION ALL SELECT doc_id, -1, text FROM cue),
tf AS (SELECT doc_id, unit, word, count(*) AS tf FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(body), '[a-z0-9]+(?:\.[0-9]+)*')) AS word FROM units) GROUP BY 1, 2, 3),
wt AS (SELECT doc_id, unit, tf.word, tf * (ln(({len(TEMPLATES)} + 1.0) / (1.0 + coalesce(df.df, 0))) + 1.0) AS w FROM tf LEFT JOIN df ON tf.word = df.word),
un AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1, 2),
dot AS (SELECT wt.doc_id, wt.unit, ttf.template, ttf.license, sum(wt.w * ttf.w / tn.norm) AS dot FROM wt JOIN ttf ON wt.word = ttf.word JOIN tn ON ttf.template = tn.template GROUP BY 1, 2, 3, 4),
sc AS (SELECT dot.doc_id, dot.unit, license, round(dot / norm, 9) AS score FROM dot JOIN un ON dot.doc_id = un.doc_id AND dot.unit = un.unit WHERE round(dot / norm, 9) >= 0.75),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS k, max(CASE WHEN unit = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS whole FROM sc),
own AS (SELECT files.doc_id, files.path, regexp_replace(files.path, '/?[^/]*$', '') AS dir, r.license AS own_license, r.score AS own_score, r.license IS NOT NULL AND (coalesce(r.whole = 1, FALSE) OR regexp_matches(files.path, '{NAMED}')) AS is_license_file FROM files LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON files.doc_id = r.doc_id),
keeps AS (SELECT dir, arg_min(own_license, (1 - own_score, path)) AS handed FROM own WHERE is_license_file GROUP BY 1),
near AS (SELECT own.doc_id, arg_max(keeps.handed, length(keeps.dir)) AS handed, arg_max(keeps.dir, length(keeps.dir)) AS inherited_from FROM own JOIN keeps ON own.dir = keeps.dir OR keeps.dir = '' OR starts_with(own.dir, keeps.dir || '/') WHERE own_license IS NULL GROUP BY 1)
SELECT own.doc_id, path, own_license, round(own_score, 6) AS own_score, is_license_file, coalesce(own_license, handed) AS license, inherited_from FROM own LEFT JOIN near ON own.doc_id = near.doc_id
"""

#: The archives must give back what the table holds. DuckDB reads UTF-8 text as the bytes that are hashed.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS ls FROM d),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i AS p FROM twice UNION ALL SELECT doc_id, i + 1 FROM twice UNION ALL SELECT doc_id, i + 2 FROM twice) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM s
"""

#: CRC-32 bit by bit; least paths by recursion over the rows of all conversations at once; the audit read back letter by letter.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations),
lots AS (SELECT *, xor(list_reduce(list_transform(key, lambda ch: CAST(ord(ch) AS BIGINT)), lambda crc, byte: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS lot FROM keyed),
m AS (SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM lots, (VALUES (0), (1)) t(again) WHERE lot <> 0 AND (again = 0 OR lot = 3)),
o AS (SELECT *, row_number() OVER w AS i, rtrim(text, E' \t\n\x0B\x0C\r') AS bare, lead(role) OVER w AS following FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (SELECT *, left(role, 1) AS cls, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM o),
ins(a, b, price, label) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
keep(a, cls, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
arcs AS (SELECT i.a, f.fault, x.cls, CASE x.edit WHEN 'D' THEN i.b WHEN 'K' THEN k.b ELSE CASE i.b WHEN 2 THEN 3 ELSE 2 END END AS b, i.price + CASE x.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 't' AND x.edit <> 'D' THEN 3 ELSE 0 END AS price, i.label || x.edit AS label
         FROM ins i, (VALUES ('b'), ('d'), ('t'), ('-')) f(fault), (SELECT * FROM (VALUES ('s'), ('u'), ('a'), ('x')) c(cls), (VALUES ('D'), ('K'), ('R')) e(edit)) x LEFT JOIN keep k ON k.a = i.b AND k.cls = x.cls
         WHERE x.edit = 'D' OR (f.fault NOT IN ('b', 'd') AND (x.edit = 'R' OR k.b IS NOT NULL))),
convs AS (SELECT DISTINCT conv_id FROM conversations),
least AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'c': CAST(0 AS BIGINT), 'l': ''} AS w FROM convs
          UNION ALL SELECT l.conv_id, l.i + 1, arcs.b, min({'c': l.w.c + arcs.price, 'l': l.w.l || arcs.label}) FROM least l JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1
          JOIN arcs ON arcs.a = l.state AND arcs.fault = r.fault AND arcs.cls = CASE WHEN r.cls IN ('s', 'u', 'a') THEN r.cls ELSE 'x' END GROUP BY 1, 2, 3),
counts AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                  count(*) FILTER (following IS NOT NULL AND cls || left(following, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
best AS (SELECT l.conv_id, min({'c': l.w.c + ins.price, 'l': l.w.l || ins.label}) AS w FROM least l LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM l.conv_id JOIN ins ON ins.a = l.state AND ins.b IN (0, 3) WHERE l.i = coalesce(n.n, 0) GROUP BY 1),
letters AS (SELECT conv_id, j, w.l[j] AS edit FROM (SELECT conv_id, w, unnest(range(1, length(w.l) + 1)) AS j FROM best)),
steps AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER w AS e FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
given AS (SELECT s.*, r.role, CASE WHEN edit = 'I' THEN '' ELSE r.text END AS text, max(CASE WHEN e = 1 AND edit = 'K' AND r.cls = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led FROM steps s LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i AND edit <> 'I' WHERE edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t FROM given GROUP BY 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.w.c AS cost, b.w.l AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM convs c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, k = 1 AS kept, text_sha256 FROM r
"""

#: Sums of products of integers below 2^53, exact as doubles.
OP13_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same AND anchor_id <> other_id) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op5_chat_formatting": OP5_QUOTING_SQL, "op8_license_scans": OP8_SQL, "op3_quality_rules": OP3_SQL, "op7_warc": OP7_SQL, "op11_conversation_repair": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
