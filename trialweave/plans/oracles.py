"""SQL twins of the registered queries for DuckDB, over the same parquet tables.

Each is a plain statement of the result: views shared by several queries are common table
expressions, prepended where a query names them.
"""

from __future__ import annotations

import re

from trialweave.operators.annotations import ENTITY_TYPES, RELATION_TYPES
from trialweave.plans.bridge import MENTION, RELATIONS, TYPES

NL = "chr(10)"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _hash(expr: str) -> str:
    return f"CAST(concat('0x', substr(md5({expr}), 1, 8)) AS BIGINT)"


WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{M}\p{N}_"
PIECE = rf"\[/?E[12]\]|[{WORD}]+|[{WS}]+|[^{WORD}{WS}]"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


VIEWS: dict[str, str] = {
    # registry
    "doc_lines": f"""
        SELECT doc_id, unnest(range(0, len(ls))) AS i, len(ls) AS n, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM documents)""",
    "marked_lines": f"""
        SELECT doc_id, i,
          CASE WHEN i = 0 THEN 'Inclusion Criteria:' || {NL} WHEN i = n // 2 THEN ' EXCLUSION  criteria' || {NL} ELSE '' END
          || ['* ', '- ', '1. ', ''][length(line) % 4 + 1] || line AS block
        FROM doc_lines""",
    "blocks": f"""
        SELECT doc_id, 'D' || doc_id AS StudyNCTid, string_agg(block, {NL} ORDER BY i) AS cell
        FROM marked_lines GROUP BY doc_id""",
    "block_lines": f"""
        SELECT doc_id, StudyNCTid, line_no, {_strip('raw')} AS line FROM (
          SELECT doc_id, StudyNCTid, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS raw
          FROM (SELECT doc_id, StudyNCTid, string_split(cell, {NL}) AS ls FROM blocks))""",
    "headed": rf"""
        SELECT *, CASE WHEN regexp_matches(line, '(?i)^inclusion[{WS}]+criteria') THEN 'inclusion'
                       WHEN regexp_matches(line, '(?i)^exclusion[{WS}]+criteria') THEN 'exclusion' END AS head
        FROM block_lines WHERE line <> ''""",
    "tagged": """
        SELECT doc_id, StudyNCTid, line_no, line, CAST(head IS NOT NULL AS INT) AS is_header,
          last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS criteria_type
        FROM headed""",
    "bullets": rf"""
        SELECT doc_id AS study_row, StudyNCTid, line_no, criteria_type, text FROM (
          SELECT *, {_strip(f"regexp_extract(line, '(?s)^[*-][{WS}]+(.*)$', 1)")} AS text FROM tagged
          WHERE criteria_type IS NOT NULL AND is_header = 0) WHERE text <> ''""",
    "items": """
        SELECT study_row, row_number() OVER (PARTITION BY study_row ORDER BY line_no) - 1 AS item_no,
          StudyNCTid AS studyNCTid, criteria_type, text
        FROM bullets""",
    "sentences": "SELECT row_number() OVER (ORDER BY study_row, item_no) - 1 AS sentence_id, * FROM items",
    # corpus
    "docs": f"""
        SELECT 'D' || doc_id || CASE WHEN lang = 'en' THEN '_inc' WHEN lang IN ('fr', 'de') THEN '_exc' ELSE '' END AS file,
          lang, regexp_replace(text, '([.!?]) ', '\\1' || {NL}, 'g') AS text
        FROM documents""",
    "all_lines": f"""
        SELECT file, lang, line_no, text, CAST(coalesce(sum(length(text) + 1)
          OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
        FROM (SELECT file, lang, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS text
              FROM (SELECT file, lang, string_split(text, {NL}) AS ls FROM docs))""",
    "words": """
        SELECT file, lang, line_no, j, w, lag(w) OVER l AS prev, lead(w) OVER l AS next,
          CAST(off + coalesce(sum(length(w) + 1) OVER (PARTITION BY file, line_no ORDER BY j
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT file, lang, line_no, off, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w
              FROM (SELECT file, lang, line_no, off, string_split(text, ' ') AS ws FROM all_lines))
        WINDOW l AS (PARTITION BY file, line_no ORDER BY j)""",
    "found": f"""
        SELECT file, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no, j) AS ord, surface, start, next,
          start + length(w) + 1 AS next_start, {_hash("lower(surface) || '|' || lang")} % {len(TYPES)} AS code,
          length(surface) = 2 AND next IS NOT NULL AS second
        FROM (SELECT *, regexp_extract(w, '{MENTION}', 1) AS surface FROM words WHERE j = 1 OR prev <> w)
        WHERE surface <> ''""",
    "chained": """
        SELECT *, lead(code, 1) OVER f AS code1, lead(code, 2) OVER f AS code2
        FROM found WINDOW f AS (PARTITION BY file ORDER BY ord)""",
    "mention_rows": f"""
        SELECT file, line_no, ord, 'T' || ord AS id, {_list(TYPES)}[code + 1] AS type, start,
          start + length(surface) AS end1, second, next_start, next_start + length(next) AS next_end,
          rtrim(surface || CASE WHEN second THEN ' ' || next ELSE '' END) AS text
        FROM found""",
    "ann": f"""
        SELECT file, row_number() OVER (PARTITION BY file ORDER BY ord, kind) - 1 AS ann_line, ord, kind, line FROM (
          SELECT file, ord, 0 AS kind, id || chr(9) || type || ' ' || start || ' ' || end1
            || CASE WHEN second THEN ';' || next_start || ' ' || next_end ELSE '' END || chr(9) || text AS line
          FROM mention_rows
          UNION ALL
          SELECT file, ord, 1, 'R' || ord || chr(9) || {_list(RELATIONS)}[(code + code1) % {len(RELATIONS)} + 1]
            || ' Arg1:T' || ord || ' Arg2:T' || (ord + 1) FROM chained WHERE code < code1
          UNION ALL
          SELECT file, ord, 2, '*' || chr(9) || CASE WHEN code = 0 THEN 'NOT' ELSE 'OR' END
            || ' T' || ord || ' T' || (ord + 1) || ' T' || (ord + 2) FROM chained WHERE code = code2
          UNION ALL
          SELECT file, ord, 3, 'R' || ord || chr(9) || 'NO_RELATION Arg1:T' || ord || ' Arg2:T' || (ord + 1)
          FROM chained WHERE code < code1 AND code = 1)""",
    "frags": """
        SELECT m.file, a.ann_line, 0 AS frag_no, id, type, start, end1 AS "end", text
        FROM mention_rows m JOIN ann a ON a.file = m.file AND a.ord = m.ord AND a.kind = 0
        UNION ALL
        SELECT m.file, a.ann_line, 1, id, type, next_start, next_end, text
        FROM mention_rows m JOIN ann a ON a.file = m.file AND a.ord = m.ord AND a.kind = 0 WHERE second""",
    "envelope": """
        SELECT file, arg_max(ann_line, frag_no) AS ann_line, id, any_value(type) AS type, min(least(start, "end")) AS start,
          max(greatest(start, "end")) AS "end", any_value(text) AS text
        FROM frags GROUP BY file, id""",
    "binary_rel": f"""
        SELECT file, ann_line, 0 AS perm_no, regexp_extract(line, '\\t([^ ]+) ', 1) AS rel_type,
          regexp_extract(line, 'Arg1:(T[0-9]+)', 1) AS arg1, regexp_extract(line, 'Arg2:(T[0-9]+)', 1) AS arg2
        FROM ann WHERE kind IN (1, 3)""",
    "nary_rel": """
        SELECT file, ann_line, i * 2 + CASE WHEN j > i THEN j - 1 ELSE j END AS perm_no, args[1] AS rel_type,
          args[i + 2] AS arg1, args[j + 2] AS arg2
        FROM (SELECT file, ann_line, string_split(substr(line, 3), ' ') AS args FROM ann WHERE kind = 2),
          unnest(range(0, 3)) a(i), unnest(range(0, 3)) b(j) WHERE i <> j""",
    "rels": "SELECT * FROM binary_rel UNION ALL SELECT * FROM nary_rel",
    "in_lines": """
        SELECT m.file, l.line_no, m.ann_line, m.id, m.type, m.start - l.off AS start, m."end" - l.off AS "end", m.text, l.text AS line_text
        FROM envelope m ASOF JOIN all_lines l ON l.file = m.file AND m.start >= l.off
        WHERE m."end" <= l.off + length(l.text)""",
    "frag_in_lines": f"""
        SELECT m.file, l.line_no, m.ann_line, m.frag_no, m.id, m.type, m.start - l.off AS start, m."end" - l.off AS "end", m.text
        FROM frags m ASOF JOIN all_lines l ON l.file = m.file AND m.start >= l.off
        WHERE m."end" <= l.off + length(l.text) AND m.type IN {_in(ENTITY_TYPES)}""",
    # Texts without an annotation file are skipped.
    "kept_lines": "SELECT * FROM all_lines WHERE file IN (SELECT file FROM found)",
    "text_lines": f"SELECT * FROM kept_lines WHERE {_strip('text')} <> ''",
    # pairs
    "cand": """
        SELECT a.file, a.line_no, a.id AS e1_id, a.type AS e1_type, a.start AS e1_start, a."end" AS e1_end,
          b.id AS e2_id, b.type AS e2_type, b.start AS e2_start, b."end" AS e2_end, a.line_text
        FROM in_lines a JOIN in_lines b ON a.file = b.file AND a.line_no = b.line_no AND a.id <> b.id""",
    "gold": f"""
        SELECT file, arg1, arg2, rel_type FROM rels WHERE rel_type IN {_in([*RELATION_TYPES, "NO_RELATION"])}
        QUALIFY row_number() OVER (PARTITION BY file, arg1, arg2 ORDER BY ann_line DESC, perm_no DESC) = 1""",
    "labelled": """
        SELECT c.*, coalesce(g.rel_type, 'NO_RELATION') AS label
        FROM cand c LEFT JOIN gold g ON g.file = c.file AND g.arg1 = c.e1_id AND g.arg2 = c.e2_id""",
    "re_map": """
        SELECT CAST(0 AS INT) AS id, 'NO_RELATION' AS label UNION ALL
        SELECT CAST(row_number() OVER (ORDER BY label) AS INT), label
        FROM (SELECT DISTINCT label FROM labelled WHERE label <> 'NO_RELATION')""",
    "split_rows": """
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(file || '|' || e1_id || '|' || e2_id || '|42'), file, e1_id, e2_id) AS rn,
          count(*) OVER (PARTITION BY label) AS n_label FROM labelled""",
    "splits": """
        SELECT *, CASE WHEN rn <= q1 THEN 'test' WHEN rn <= q1 + (2 * (n_label - q1) + 9) // 18 THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, (n_label + 5) // 10 AS q1 FROM split_rows)""",
    "u_pairs": f"""
        SELECT *, {_hash("file || '|' || e1_id || '|' || e2_id || '|42'")} / 4294967296.0::DOUBLE AS u FROM labelled""",
    "scores": f"""
        SELECT l.file, l.e1_id, l.e2_id, l.label, m.id, m.label AS name,
          {_hash("l.file || '|' || l.e1_id || '|' || l.e2_id || '|' || m.id")} / 4294967296.0::DOUBLE
            + CASE WHEN m.label = l.label THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS score
        FROM labelled l CROSS JOIN re_map m""",
    "decided": """
        SELECT file, e1_id, e2_id, label AS truth, id AS label_id, name AS pred, score FROM scores
        QUALIFY row_number() OVER (PARTITION BY file, e1_id, e2_id ORDER BY score DESC, id) = 1""",
    # tokens
    "pieces": f"""
        SELECT file, line_no, k, token, CAST(coalesce(sum(length(token)) OVER (PARTITION BY file, line_no ORDER BY k
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
        FROM (SELECT file, line_no, unnest(range(0, len(ps))) AS k, unnest(ps) AS token
              FROM (SELECT file, line_no, regexp_extract_all(text, '{PIECE}') AS ps FROM text_lines))""",
    "toks": f"""
        SELECT file, line_no, row_number() OVER (PARTITION BY file, line_no ORDER BY k) AS pos, token, s, s + length(token) AS e
        FROM pieces WHERE NOT regexp_matches(token, '^[{WS}]')""",
    "ents": """
        SELECT *, row_number() OVER (PARTITION BY file, line_no ORDER BY start, ann_line, frag_no) AS eo FROM frag_in_lines""",
    "hits": """
        SELECT t.file, t.line_no, t.pos, x.eo, x.type, t.s < x.start AS straddles,
          row_number() OVER (PARTITION BY t.file, t.line_no, x.eo ORDER BY t.pos) AS nth
        FROM toks t JOIN ents x ON x.file = t.file AND x.line_no = t.line_no
          AND ((t.s >= x.start AND t.e <= x."end") OR (t.s < x.start AND t.e > x.start))""",
    "tok_tags": """
        SELECT t.file, t.line_no, t.pos, t.token, t.s, t.e, coalesce(h.tag, 'O') AS tag FROM toks t LEFT JOIN (
          SELECT file, line_no, pos, arg_max(CASE WHEN straddles OR nth = 1 THEN 'B-' ELSE 'I-' END || type, eo) AS tag
          FROM hits GROUP BY file, line_no, pos) h USING (file, line_no, pos)""",
    "specials": """
        SELECT file, line_no, 0 AS pos, '[CLS]' AS token FROM text_lines UNION ALL
        SELECT file, line_no, coalesce(n, 0) + 1, '[SEP]' FROM text_lines LEFT JOIN
          (SELECT file, line_no, count(*) AS n FROM toks GROUP BY file, line_no) USING (file, line_no)""",
    "seq": """
        SELECT file, line_no, pos, token, s, e, tag FROM tok_tags UNION ALL
        SELECT file, line_no, pos, token, 0, 0, 'O' FROM specials""",
    "noisy": f"""
        SELECT *, CASE WHEN token IN ('[CLS]', '[SEP]') THEN tag WHEN h = 0 THEN 'O' WHEN h = 1 THEN 'I-Drug' ELSE tag END AS pred_tag
        FROM (SELECT *, {_hash("lower(token)")} % 6 AS h FROM seq)""",
    "ner_map": """
        SELECT CAST(0 AS INT) AS id, 'O' AS label UNION ALL
        SELECT CAST(2 * r - 1 AS INT), 'B-' || type FROM (SELECT type, row_number() OVER (ORDER BY type) AS r FROM
          (SELECT DISTINCT type FROM frag_in_lines)) UNION ALL
        SELECT CAST(2 * r AS INT), 'I-' || type FROM (SELECT type, row_number() OVER (ORDER BY type) AS r FROM
          (SELECT DISTINCT type FROM frag_in_lines))""",
    "row_labels": """
        SELECT DISTINCT p.file, p.line_no, m.id AS label_id FROM seq p JOIN ner_map m ON m.label = p.tag WHERE m.id > 0""",
    "rarity": "SELECT label_id, count(*) AS n FROM row_labels GROUP BY label_id",
    "strata": """
        SELECT l.file, l.line_no, coalesce(s.stratum, 0) AS stratum FROM text_lines l LEFT JOIN (
          SELECT r.file, r.line_no, arg_min(r.label_id, q.n * 1000 + r.label_id) AS stratum
          FROM row_labels r JOIN rarity q USING (label_id) GROUP BY r.file, r.line_no) s USING (file, line_no)""",
    "line_splits": """
        SELECT file, line_no, stratum, CASE WHEN rn <= q1 THEN 'test' WHEN rn <= q1 + (2 * (n - q1) + 9) // 18 THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, (n + 5) // 10 AS q1 FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS n,
          row_number() OVER (PARTITION BY stratum ORDER BY md5(file || '|' || line_no || '|42'), file, line_no) AS rn FROM strata))""",
}


def _chunks(table: str, tag: str) -> str:
    """Lenient BIO chunks of a tag column: one row per chunk with its first tag."""
    return f"""
        SELECT file, line_no, chunk, min(pos) AS first, max(pos) AS last, regexp_replace(arg_min(tag, pos), '^[BI]-', '') AS type,
          arg_min(tag, pos) AS first_tag, min(s) AS s, max(e) AS e, avg(score) AS score
        FROM (SELECT *, sum(opens) OVER (PARTITION BY file, line_no ORDER BY pos) AS chunk FROM (
          SELECT file, line_no, pos, s, e, {tag} AS tag, {_hash("lower(token)")} / 4294967296.0::DOUBLE AS score,
            CASE WHEN {tag} LIKE 'I-%' AND coalesce(lag({tag}) OVER (PARTITION BY file, line_no ORDER BY pos), 'O') <> 'O'
              AND substr(lag({tag}) OVER (PARTITION BY file, line_no ORDER BY pos), 3) = substr({tag}, 3) THEN 0 ELSE 1 END AS opens
          FROM {table}) ) WHERE tag <> 'O' GROUP BY file, line_no, chunk"""


VIEWS["pred_chunks"] = _chunks("noisy", "pred_tag")
VIEWS["true_chunks"] = _chunks("noisy", "tag")
VIEWS["gold_chunks"] = _chunks("seq", "tag")


def _scores(counts: str) -> str:
    """Per-label measures from (truth, pred, n)."""
    return f"""
        SELECT label, sum(tp) AS tp, sum(t) AS support,
          coalesce(sum(tp)::DOUBLE / nullif(sum(p), 0), 0) AS precision, coalesce(sum(tp)::DOUBLE / nullif(sum(t), 0), 0) AS recall,
          coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(t) + sum(p), 0), 0) AS f1
        FROM (SELECT truth AS label, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS t, 0 AS p FROM {counts}
              UNION ALL SELECT pred, 0, 0, n FROM {counts}) GROUP BY label"""


VIEWS["pair_counts"] = "SELECT truth, pred, count(*) AS n FROM decided GROUP BY truth, pred"
VIEWS["pair_scores"] = _scores("pair_counts")
VIEWS["quality_counts"] = """
        SELECT quality AS truth, CAST(n_chars > 500 AS INT) AS pred, count(*) AS n
        FROM labels JOIN documents USING (doc_id) GROUP BY ALL"""
VIEWS["quality_scores"] = _scores("quality_counts")
VIEWS["tok_counts"] = """
        SELECT regexp_replace(tag, '^[BI]-', '') AS truth, regexp_replace(pred_tag, '^[BI]-', '') AS pred, count(*) AS n
        FROM noisy GROUP BY ALL"""
VIEWS["tok_scores"] = _scores("tok_counts")
VIEWS["inference"] = "SELECT row_number() OVER (ORDER BY file, line_no) - 1 AS sentence_id, * FROM text_lines"
VIEWS["inference_ents"] = """
        SELECT s.sentence_id, s.file, s.text AS sentence, x.eo, x.id, x.type, x.start, x."end", x.text AS word
        FROM inference s JOIN ents x USING (file, line_no)"""
# Inference pairs: markers go in from right to left, the later list item further left at a tie.
VIEWS["inference_pairs"] = """
        SELECT a.sentence_id, a.eo - 1 AS i, b.eo - 1 AS j, a.word AS arg1, a.type AS arg1_type, b.word AS arg2, b.type AS arg2_type,
          a.start AS s1, a."end" AS e1, b.start AS s2, b."end" AS e2, a.sentence AS text
        FROM inference_ents a JOIN inference_ents b ON a.sentence_id = b.sentence_id AND a.eo <> b.eo
        WHERE NOT greatest(a.start, b.start) < least(a."end", b."end")"""


def _marked(text: str, s1: str, e1: str, s2: str, e2: str) -> str:
    """Text with markers as an ordered join of the stretches between the four positions."""
    points = (
        f"list_sort([{{'p': {s1}, 'r': 3, 'm': '[E1]'}}, {{'p': {e1}, 'r': 2, 'm': '[/E1]'}},"
        f" {{'p': {s2}, 'r': 1, 'm': '[E2]'}}, {{'p': {e2}, 'r': 0, 'm': '[/E2]'}}])"
    )
    return (
        f"(SELECT substr({text}, 1, q[1].p) || q[1].m || substr({text}, q[1].p + 1, q[2].p - q[1].p) || q[2].m"
        f" || substr({text}, q[2].p + 1, q[3].p - q[2].p) || q[3].m || substr({text}, q[3].p + 1, q[4].p - q[3].p) || q[4].m"
        f" || substr({text}, q[4].p + 1) FROM (SELECT {points} AS q))"
    )


VIEWS["inference_scored"] = f"""
        SELECT *, abs(strpos(marked, '[E2]') - strpos(marked, '[E1]')) / 40.0::DOUBLE AS l0,
          CASE WHEN strpos(marked, '[E1]') < strpos(marked, '[E2]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l1, 0.5::DOUBLE AS l2
        FROM (SELECT *, {_marked('text', 's1', 'e1', 's2', 'e2')} AS marked FROM inference_pairs)"""
VIEWS["inference_rels"] = """
        SELECT sentence_id, i, j, arg1, arg1_type, arg2, arg2_type, CASE WHEN l1 >= l2 THEN 'AND' ELSE 'Has_value' END AS relation,
          round(1.0::DOUBLE / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))), 4) AS confidence_score, marked
        FROM inference_scored WHERE NOT (l0 >= l1 AND l0 >= l2)"""
VIEWS["tagged_sentences"] = """
        SELECT sentence_id, studyNCTid AS nct_id, criteria_type, text, regexp_extract_all(text, '[A-Z][a-z]+|[0-9]+') AS words FROM sentences"""
VIEWS["lexicon"] = """
        SELECT surface, type FROM (SELECT lower(text) AS surface, type, count(*) AS n FROM in_lines GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY surface ORDER BY n DESC, type) = 1"""
VIEWS["lexicon_tokens"] = f"""
        SELECT surface, type, len(list_filter(regexp_extract_all(surface, '{PIECE}'), lambda p: NOT regexp_matches(p, '^[{WS}]'))) AS n_tokens FROM lexicon"""
VIEWS["sent_pieces"] = f"""
        SELECT sentence_id, text, k, token, CAST(coalesce(sum(length(token)) OVER (PARTITION BY sentence_id ORDER BY k
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
        FROM (SELECT sentence_id, text, unnest(range(0, len(ps))) AS k, unnest(ps) AS token
              FROM (SELECT sentence_id, text, regexp_extract_all(text, '{PIECE}') AS ps FROM sentences))"""
VIEWS["sent_toks"] = f"""
        SELECT sentence_id, text, row_number() OVER (PARTITION BY sentence_id ORDER BY k) AS pos, s, s + length(token) AS e
        FROM sent_pieces WHERE NOT regexp_matches(token, '^[{WS}]')"""
VIEWS["lexicon_hits"] = """
        SELECT a.sentence_id, a.s AS start, b.e AS "end", substr(a.text, a.s + 1, b.e - a.s) AS word, x.type
        FROM (SELECT DISTINCT n_tokens FROM lexicon_tokens WHERE n_tokens > 0) g
        JOIN sent_toks a ON TRUE JOIN sent_toks b ON b.sentence_id = a.sentence_id AND b.pos = a.pos + g.n_tokens - 1
        JOIN lexicon_tokens x ON x.surface = lower(substr(a.text, a.s + 1, b.e - a.s)) AND x.n_tokens > 0"""
# Greedy choice as a fold over the hits of a sentence: first hit at or behind the last end.
VIEWS["lexicon_ordered"] = """
        SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY start, "end" DESC) AS r FROM lexicon_hits"""
VIEWS["lexicon_folded"] = """
        SELECT sentence_id, list_reduce(list({'s': start, 'e': "end", 'k': [r]} ORDER BY r),
          lambda acc, x: CASE WHEN x.s >= acc.e THEN {'s': x.s, 'e': x.e, 'k': acc.k || x.k} ELSE acc END).k AS kept
        FROM lexicon_ordered GROUP BY sentence_id"""

VIEWS["tag_ents"] = """
        SELECT sentence_id, entity_group, word, start, "end", row_number() OVER (PARTITION BY sentence_id ORDER BY start) AS eo FROM (
          SELECT sentence_id, CASE WHEN regexp_matches(p, '^[0-9]') THEN 'Value' ELSE 'Condition' END AS entity_group, p AS word, s AS start, s + length(p) AS "end"
          FROM (SELECT sentence_id, p, CAST(coalesce(sum(length(p)) OVER (PARTITION BY sentence_id ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
            FROM (SELECT sentence_id, unnest(range(0, len(ps))) AS k, unnest(ps) AS p
                  FROM (SELECT sentence_id, regexp_extract_all(text, '(?s)[A-Z][a-z]+|[0-9]+|.') AS ps FROM sentences)))
          WHERE regexp_matches(p, '^([A-Z][a-z]+|[0-9]+)$'))"""
# Matches of one pattern are disjoint. Inserted from right to left, [E2] stands behind [E1] by the
# length of the text between them and the markers in between.
VIEWS["full_pairs"] = f"""
        SELECT sentence_id, abs(strpos(marked, '[E2]') - strpos(marked, '[E1]')) / 40.0::DOUBLE AS l0,
          CASE WHEN strpos(marked, '[E1]') < strpos(marked, '[E2]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l1, 0.5::DOUBLE AS l2
        FROM (SELECT a.sentence_id, {_marked('s.text', 'a.start', 'a."end"', 'b.start', 'b."end"')} AS marked
          FROM tag_ents a JOIN tag_ents b ON a.sentence_id = b.sentence_id AND a.eo <> b.eo JOIN sentences s ON s.sentence_id = a.sentence_id)"""


def _count_model(name: str, key: str, alphas: str = "1.0") -> None:
    """Naive Bayes views over {name}_rows (key, label, w, split) and {name}_feats (key, feature)."""
    VIEWS[f"{name}_counts"] = f"""
        SELECT feature, label, sum(w) AS n FROM {name}_feats JOIN {name}_rows USING ({key}) WHERE split = 'train' GROUP BY feature, label"""
    VIEWS[f"{name}_totals"] = f"""
        SELECT label, n, ln(n / sum(n) OVER ()) AS prior, total, (SELECT count(DISTINCT feature) FROM {name}_counts) AS v
        FROM (SELECT label, sum(w) AS n FROM {name}_rows WHERE split = 'train' GROUP BY label)
        JOIN (SELECT label, sum(n) AS total FROM {name}_counts GROUP BY label) USING (label)"""
    VIEWS[f"{name}_gains"] = f"""
        SELECT {key}, c.label, a.alpha, sum(ln(1 + c.n / a.alpha)) AS gain FROM {name}_feats JOIN {name}_rows r USING ({key})
        JOIN {name}_counts c USING (feature) CROSS JOIN {name}_alphas a WHERE r.split <> 'train' GROUP BY ALL"""
    VIEWS[f"{name}_sizes"] = f"SELECT {key}, count(*) AS m FROM {name}_feats GROUP BY ALL"
    VIEWS[f"{name}_preds"] = f"""
        SELECT {key}, split, alpha, truth, pred FROM (
          SELECT {key}, r.split, r.label AS truth, t.label AS pred, a.alpha,
            round(t.prior + coalesce(z.m, 0) * ln(a.alpha / (t.total + a.alpha * t.v)) + coalesce(g.gain, 0), 6) AS score
          FROM {name}_rows r CROSS JOIN {name}_totals t CROSS JOIN {name}_alphas a LEFT JOIN {name}_sizes z USING ({key})
          LEFT JOIN (SELECT {key}, label AS label_g, alpha AS alpha_g, gain FROM {name}_gains) g
            ON {" AND ".join(f"g.{k} = r.{k}" for k in key.split(", "))} AND g.label_g = t.label AND g.alpha_g = a.alpha
          WHERE r.split <> 'train')
        QUALIFY row_number() OVER (PARTITION BY {key}, alpha ORDER BY score DESC, pred) = 1"""
    VIEWS[f"{name}_alphas"] = f"SELECT unnest([{alphas}])::DOUBLE AS alpha"


ALPHAS = "0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0"
VIEWS["near_seq"] = """
        SELECT *, lower(token) AS w, lower(coalesce(lag(token) OVER l, '')) AS p, lower(coalesce(lead(token) OVER l, '')) AS n,
          regexp_replace(regexp_replace(regexp_replace(token, '\\p{Lu}', 'X', 'g'), '\\p{Ll}', 'x', 'g'), '[0-9]', 'd', 'g') AS shape
        FROM seq WINDOW l AS (PARTITION BY file, line_no ORDER BY pos)"""
VIEWS["pair_train"] = """
        SELECT s.*, u.u FROM splits s JOIN (SELECT file, e1_id, e2_id, u FROM u_pairs) u USING (file, e1_id, e2_id)
        WHERE s.label <> 'NO_RELATION' OR split <> 'train' OR u < 0.2"""
VIEWS["pair_weights"] = """
        SELECT label, w / avg(w) OVER () AS w FROM (
          SELECT label, sqrt(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE) AS w
          FROM (SELECT label, count(*) AS n FROM pair_train WHERE split = 'train' GROUP BY label))"""
for _name, _alphas in (("tagger", "1.0"), ("taggers", ALPHAS)):
    VIEWS[f"{_name}_rows"] = "SELECT file, line_no, pos, tag AS label, 1.0::DOUBLE AS w, split FROM seq JOIN line_splits USING (file, line_no) WHERE pos > 0"
    VIEWS[f"{_name}_feats"] = """
        SELECT file, line_no, pos, unnest(['w=' || w, 'p=' || p, 'n=' || n, 's=' || substr(shape, 1, 8), 'a=' || substr(w, 1, 3), 'z=' || right(w, 3)]) AS feature
        FROM near_seq WHERE pos > 0"""
    _count_model(_name, "file, line_no, pos", _alphas)
for _name, _alphas in (("rel", "1.0"), ("rels_all", ALPHAS)):
    VIEWS[f"{_name}_rows"] = """
        SELECT file, e1_id, e2_id, p.label, coalesce(x.w, 1.0::DOUBLE) AS w, split FROM pair_train p LEFT JOIN pair_weights x ON x.label = p.label"""
    VIEWS[f"{_name}_feats"] = f"""
        SELECT file, e1_id, e2_id, ws[i] || ' ' || ws[i + 1] AS feature FROM (
          SELECT file, e1_id, e2_id, ws, unnest(range(1, len(ws))) AS i FROM (
            SELECT file, e1_id, e2_id, regexp_extract_all(lower({_marked('line_text', 'e1_start', 'e1_end', 'e2_start', 'e2_end')}),
              '\\[/?e[12]\\]|[\\p{{L}}\\p{{N}}]+') AS ws FROM pair_train))"""
    _count_model(_name, "file, e1_id, e2_id", _alphas)
VIEWS["tagger_seq"] = """
        SELECT s.file, s.line_no, s.pos, s.token, s.s, s.e, s.tag, coalesce(p.pred, 'O') AS pred_tag FROM seq s JOIN line_splits USING (file, line_no)
        LEFT JOIN tagger_preds p USING (file, line_no, pos) WHERE line_splits.split = 'test'"""
VIEWS["tagger_true_chunks"] = _chunks("tagger_seq", "tag")
VIEWS["tagger_pred_chunks"] = _chunks("tagger_seq", "pred_tag")
VIEWS["tagger_tok_counts"] = """
        SELECT regexp_replace(tag, '^[BI]-', '') AS truth, regexp_replace(pred_tag, '^[BI]-', '') AS pred, count(*) AS n
        FROM tagger_seq GROUP BY ALL"""
VIEWS["tagger_tok_scores"] = _scores("tagger_tok_counts")
VIEWS["rel_test_counts"] = "SELECT truth, pred, count(*) AS n FROM rel_preds WHERE split = 'test' GROUP BY truth, pred"
VIEWS["rel_test_scores"] = _scores("rel_test_counts")


# Iterative stratification: labels take turns, each deals its rows by what the splits still need of it.
VIEWS["turns"] = "SELECT label_id, n, row_number() OVER (ORDER BY n, label_id) AS k FROM rarity"
VIEWS["row_sets"] = """
        SELECT l.file, l.line_no, coalesce(s.ks, []) AS ks FROM text_lines l LEFT JOIN (
          SELECT file, line_no, list(k ORDER BY k) AS ks FROM row_labels JOIN turns USING (label_id) GROUP BY file, line_no) s USING (file, line_no)"""
VIEWS["label_sets"] = """
        SELECT ks, n, turn, sum(n) OVER (PARTITION BY turn) AS size, sum(n) OVER (PARTITION BY turn ORDER BY ks) - n AS first
        FROM (SELECT ks, count(*) AS n, coalesce(ks[1], 0) AS turn FROM row_sets GROUP BY ks)"""
VIEWS["dealing"] = """
        SELECT * FROM (
          WITH RECURSIVE turn_list AS (
            SELECT k, n AS total, row_number() OVER (ORDER BY k = 0, k) AS step FROM (
              SELECT k, n FROM turns WHERE k IN (SELECT turn FROM label_sets) UNION ALL SELECT 0, max(size) FROM label_sets WHERE turn = 0 HAVING count(*) > 0)),
          wants AS (
            SELECT step, k, total, (total + 5) // 10 AS w1, (2 * (total - (total + 5) // 10) + 9) // 18 AS w2,
              (SELECT max(size) FROM label_sets WHERE turn = k) AS size FROM turn_list),
          rec AS (
            SELECT 0::BIGINT AS step, 0::BIGINT AS k, 0::HUGEINT AS n_test, 0::HUGEINT AS n_held, 0::HUGEINT AS size,
              []::STRUCT(k BIGINT, a HUGEINT, b HUGEINT, c HUGEINT)[] AS given
            UNION ALL
            SELECT q.step, q.k, q.n_test, q.n_test + q.n_val, q.size, list_concat(q.given, (
                SELECT list({'k': kk, 'a': a, 'b': b, 'c': c}) FROM (
                  SELECT kk, sum(t) AS a, sum(h - t) AS b, sum(n - h) AS c FROM (
                    SELECT unnest(ks) AS kk, n, h2 - h1 AS h,
                      h2 * q.n_test // greatest(q.n_test + q.n_val, 1) - h1 * q.n_test // greatest(q.n_test + q.n_val, 1) AS t
                    FROM (SELECT ks, n, (first + n) * (q.n_test + q.n_val) // q.size AS h2, first * (q.n_test + q.n_val) // q.size AS h1
                          FROM label_sets WHERE turn = q.k))
                  GROUP BY kk)))
            FROM (
              SELECT *, CASE WHEN d2 + d3 > 0 THEN (2 * (size - n_test) * d2 + d2 + d3) // (2 * (d2 + d3)) ELSE 0 END AS n_val FROM (
                SELECT *, CASE WHEN d1 + d2 + d3 > 0 THEN (2 * size * d1 + d1 + d2 + d3) // (2 * (d1 + d2 + d3)) ELSE 0 END AS n_test FROM (
                  SELECT w.step, w.k, w.size, r.given,
                    greatest(w1 - coalesce(list_sum([x.a for x in r.given if x.k = w.k]), 0), 0)::HUGEINT AS d1,
                    greatest(w2 - coalesce(list_sum([x.b for x in r.given if x.k = w.k]), 0), 0)::HUGEINT AS d2,
                    greatest(total - w1 - w2 - coalesce(list_sum([x.c for x in r.given if x.k = w.k]), 0), 0)::HUGEINT AS d3
                  FROM rec r JOIN wants w ON w.step = r.step + 1))) q)
          SELECT k, n_test, n_held, size FROM rec WHERE step > 0)"""
VIEWS["balanced"] = """
        SELECT file, line_no, CASE WHEN rn <= t THEN 'test' WHEN rn <= h THEN 'validation' ELSE 'train' END AS split FROM (
          SELECT r.file, r.line_no, row_number() OVER (PARTITION BY r.ks ORDER BY md5(r.file || '|' || r.line_no || '|42'), r.file, r.line_no) AS rn,
            h2 - h1 AS h, h2 * n_test // greatest(n_held, 1) - h1 * n_test // greatest(n_held, 1) AS t
          FROM row_sets r JOIN (
            SELECT s.ks, d.n_test, d.n_held, (first + n) * d.n_held // d.size AS h2, first * d.n_held // d.size AS h1
            FROM label_sets s JOIN dealing d ON d.k = s.turn) q ON q.ks = r.ks)"""


# Subwords by a vocabulary of the benchmark's words, longest match first.
VIEWS["sub_pieces"] = f"""
        SELECT DISTINCT CASE WHEN i > 0 THEN '##' ELSE '' END || substr(w, i + 1, n) AS piece
        FROM (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '{PIECE}')) AS w FROM benchmark) WHERE NOT regexp_matches(w, '^[{WS}]')),
          unnest(range(0, length(w))) a(i), unnest(range(1, 5)) b(n)
        WHERE i + n <= length(w) AND (i = 0 OR n < 4)"""
VIEWS["sub_vocab"] = """
        SELECT piece, 7 + row_number() OVER (ORDER BY piece) AS id FROM sub_pieces"""
VIEWS["sub_cut"] = """
        SELECT * FROM (
          WITH RECURSIVE rec AS (
            SELECT token, CASE WHEN length(lower(token)) = length(token) THEN lower(token) ELSE token END AS form, 0::BIGINT AS done,
              []::BIGINT[] AS ids, []::BIGINT[] AS ends FROM (SELECT DISTINCT token FROM toks) WHERE length(token) <= 100
            UNION ALL
            SELECT token, form, done + n, list_append(ids, id), list_append(ends, done + n) FROM (
              SELECT r.*, v.id, t.n, row_number() OVER (PARTITION BY token ORDER BY t.n DESC) AS rn
              FROM rec r CROSS JOIN (SELECT unnest(range(1, 5)) AS n) t
              JOIN sub_vocab v ON v.piece = CASE WHEN r.done > 0 THEN '##' ELSE '' END || substr(r.form, r.done + 1, t.n)
              WHERE r.done + t.n <= length(r.form)) WHERE rn = 1)
          SELECT token, ids, ends FROM rec WHERE done = length(form))"""
VIEWS["sub_seq"] = """
        SELECT file, line_no, pos, s, unnest(coalesce(ids, [1::BIGINT])) AS id, unnest(coalesce(list_prepend(0, ends[:-2]), [0::BIGINT])) AS b,
          unnest(coalesce(ends, [length(token)::BIGINT])) AS e
        FROM toks LEFT JOIN sub_cut USING (token) WHERE token NOT IN ('[E1]', '[/E1]', '[E2]', '[/E2]')
        UNION ALL SELECT file, line_no, pos, s, CASE token WHEN '[E1]' THEN 4 WHEN '[/E1]' THEN 5 WHEN '[E2]' THEN 6 ELSE 7 END, 0, length(token)
        FROM toks WHERE token IN ('[E1]', '[/E1]', '[E2]', '[/E2]')
        UNION ALL SELECT file, line_no, pos, 0, CASE token WHEN '[CLS]' THEN 2 ELSE 3 END, 0, 0 FROM specials"""
# Viterbi as a fold over the line: an element holds five scores, then five steps back per token so far.
_LINK = lambda i, k: (3 * i + 5 * k) % 7
_BEFORE = {k: [1, 3] if k == 3 else [2, 4] if k == 4 else range(5) for k in range(5)}
_BEST = ", ".join("greatest(" + ", ".join(f"(a[{i + 1}] + {_LINK(i, k)}) * 8 + {7 - i}" for i in _BEFORE[k]) + ")" for k in range(5))
VIEWS["viterbi_em"] = f"""
        SELECT file, line_no, list([{", ".join(f"{_hash(f"lower(token) || '|{k}'")} % 20 + CASE WHEN tag = '{t}' THEN 12 ELSE 0 END" for k, t in
          enumerate(("O", "B-Condition", "B-Drug", "I-Condition", "I-Drug")))}]::BIGINT[] ORDER BY pos) AS em
        FROM tok_tags GROUP BY file, line_no"""
VIEWS["viterbi_done"] = f"""
        SELECT file, line_no, len(em) AS n, list_reduce(list_prepend([em[1][1], em[1][2] + 2, em[1][3] + 1, -1000000, -1000000], em[2:]), lambda a, e:
          list_concat(list_transform([[{_BEST}]], lambda b: list_concat([{", ".join(f"b[{k}] // 8 + e[{k}]" for k in range(1, 6))}], a[6:],
            [{", ".join(f"7 - b[{k}] % 8" for k in range(1, 6))}]))[1], [])) AS a
        FROM viterbi_em"""


# The trained models over the registry's sentences.
VIEWS["inf_toks"] = f"""
        SELECT sentence_id, row_number() OVER (PARTITION BY sentence_id ORDER BY k) AS pos, token, s, s + length(token) AS e FROM (
          SELECT sentence_id, k, token, CAST(coalesce(sum(length(token)) OVER (PARTITION BY sentence_id ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
          FROM (SELECT sentence_id, unnest(range(0, len(ps))) AS k, unnest(ps) AS token
                FROM (SELECT sentence_id, regexp_extract_all(text, '{PIECE}') AS ps FROM sentences)))
        WHERE NOT regexp_matches(token, '^[{WS}]')"""
VIEWS["inf_near"] = """
        SELECT *, lower(token) AS w, lower(coalesce(lag(token) OVER l, '[CLS]')) AS p, lower(coalesce(lead(token) OVER l, '[SEP]')) AS n,
          regexp_replace(regexp_replace(regexp_replace(token, '\\p{Lu}', 'X', 'g'), '\\p{Ll}', 'x', 'g'), '[0-9]', 'd', 'g') AS shape
        FROM inf_toks WINDOW l AS (PARTITION BY sentence_id ORDER BY pos)"""
VIEWS["inf_feats"] = """
        SELECT sentence_id, pos, unnest(['w=' || w, 'p=' || p, 'n=' || n, 's=' || substr(shape, 1, 8), 'a=' || substr(w, 1, 3), 'z=' || right(w, 3)]) AS feature
        FROM inf_near"""


def _applied(model: str, feats: str, rows: str, key: str) -> str:
    """Predictions of a count model for other rows than its own."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
    return f"""
        SELECT {", ".join(f"r.{k}" for k in key.split(", "))}, t.label AS pred
        FROM {rows} r CROSS JOIN {model}_totals t
        LEFT JOIN (SELECT {key}, count(*) AS m FROM {feats} GROUP BY ALL) z ON {on("z", "r")}
        LEFT JOIN (SELECT {key}, label, sum(ln(1 + n)) AS gain FROM {feats} JOIN {model}_counts USING (feature) GROUP BY ALL) g
          ON {on("g", "r")} AND g.label = t.label
        QUALIFY row_number() OVER (PARTITION BY {", ".join(f"r.{k}" for k in key.split(", "))}
          ORDER BY round(t.prior + coalesce(z.m, 0) * ln(1.0::DOUBLE / (t.total + t.v)) + coalesce(g.gain, 0), 6) DESC, t.label) = 1"""


VIEWS["inf_tags"] = _applied("tagger", "inf_feats", "inf_toks", "sentence_id, pos")
VIEWS["inf_seq"] = """
        SELECT sentence_id AS file, 0 AS line_no, pos, s, e, token, pred AS tag FROM inf_toks JOIN inf_tags USING (sentence_id, pos)"""
VIEWS["inf_chunks"] = _chunks("inf_seq", "tag")
VIEWS["inf_ents"] = """
        SELECT c.file AS sentence_id, row_number() OVER (PARTITION BY c.file ORDER BY first) AS eo, type, c.s AS start, c.e AS "end",
          substr(t.text, c.s + 1, c.e - c.s) AS word, t.text
        FROM inf_chunks c JOIN sentences t ON t.sentence_id = c.file"""
VIEWS["inf_pairs"] = f"""
        SELECT a.sentence_id, a.eo AS i, b.eo AS j, a.word AS arg1, b.word AS arg2, {_marked('a.text', 'a.start', 'a."end"', 'b.start', 'b."end"')} AS marked
        FROM inf_ents a JOIN inf_ents b ON a.sentence_id = b.sentence_id AND a.eo <> b.eo
        WHERE NOT greatest(a.start, b.start) < least(a."end", b."end")"""
VIEWS["inf_grams"] = """
        SELECT sentence_id, i, j, ws[k] || ' ' || ws[k + 1] AS feature FROM (
          SELECT sentence_id, i, j, ws, unnest(range(1, len(ws))) AS k FROM (
            SELECT sentence_id, i, j, regexp_extract_all(lower(marked), '\\[/?e[12]\\]|[\\p{L}\\p{N}]+') AS ws FROM inf_pairs))"""
VIEWS["inf_rels"] = f"""
        SELECT p.*, q.pred FROM inf_pairs p JOIN ({_applied("rel", "inf_grams", "inf_pairs", "sentence_id, i, j")}) q USING (sentence_id, i, j)
        WHERE q.pred <> 'NO_RELATION'"""


def _span_metrics(seq: str, true_chunks: str, pred_chunks: str) -> str:
    return f"""
        SELECT coalesce(type, 'overall') AS label, CASE WHEN type IS NULL THEN (SELECT round(avg(CAST(tag = pred_tag AS INT)), 6) FROM {seq}) END AS accuracy,
          round(coalesce(sum(tp)::DOUBLE / nullif(sum(p), 0), 0), 6) AS precision, round(coalesce(sum(tp)::DOUBLE / nullif(sum(t), 0), 0), 6) AS recall,
          round(coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(t) + sum(p), 0), 0), 6) AS f1, sum(t) AS support
        FROM (SELECT type, CAST(a.file IS NOT NULL AS INT) AS t, CAST(b.file IS NOT NULL AS INT) AS p,
                CAST(a.file IS NOT NULL AND b.file IS NOT NULL AS INT) AS tp
              FROM (SELECT *, file || '|' || line_no || '|' || first || '|' || last AS k FROM {true_chunks}) a
              FULL JOIN (SELECT *, file || '|' || line_no || '|' || first || '|' || last AS k FROM {pred_chunks}) b USING (k, type))
        GROUP BY GROUPING SETS ((), (type))"""


def _token_metrics(scores: str) -> str:
    return f"""
        SELECT 'overall' AS label, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
          round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM {scores}
        UNION ALL SELECT label, NULL, round(precision, 6), round(recall, 6), round(f1, 6) FROM {scores} WHERE support > 0"""


def _overall(scores: str) -> str:
    return f"""
        SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1,
          round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall FROM {scores}"""


def _report(scores: str) -> str:
    return f"""
        SELECT m.id, m.label AS name, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall,
          round(coalesce(f1, 0), 6) AS f1, coalesce(support, 0) AS support FROM re_map m LEFT JOIN {scores} USING (label)
        UNION ALL SELECT NULL, 'accuracy', a, a, a, n FROM (SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS a, sum(support) AS n FROM {scores})
        UNION ALL SELECT NULL, 'macro avg', round(avg(coalesce(precision, 0)), 6), round(avg(coalesce(recall, 0)), 6), round(avg(coalesce(f1, 0)), 6), sum(support)
          FROM re_map LEFT JOIN {scores} USING (label)
        UNION ALL SELECT NULL, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
          round(sum(f1 * support) / sum(support), 6), sum(support) FROM {scores}"""


def _matrix(counts: str) -> str:
    return f"""
        SELECT t.id AS truth_id, t.label AS truth, p.id AS pred_id, p.label AS pred, coalesce(c.n, 0) AS n,
          round(coalesce(c.n / nullif(sum(c.n) OVER (PARTITION BY t.id), 0)::DOUBLE, 0), 6) AS share
        FROM re_map t CROSS JOIN re_map p LEFT JOIN {counts} c ON c.truth = t.label AND c.pred = p.label"""


def _trials(preds: str) -> str:
    """Weighted F1 of each smoothing value on the validation split."""
    return f"""
        WITH v AS (SELECT alpha, truth, pred, count(*) AS n FROM {preds} WHERE split = 'validation' GROUP BY ALL),
        l AS (SELECT alpha, label, sum(tp) AS tp, sum(t) AS t, sum(p) AS p FROM (
            SELECT alpha, truth AS label, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS t, 0 AS p FROM v
            UNION ALL SELECT alpha, pred, 0, 0, n FROM v) GROUP BY ALL)
        SELECT CAST(row_number() OVER (ORDER BY alpha) - 1 AS INT) AS trial, 'alpha=' || alpha AS params,
          round(sum(coalesce(2.0::DOUBLE * tp / nullif(t + p, 0), 0) * t) / sum(t), 6) AS f1 FROM l GROUP BY alpha"""


def _with(sql: str) -> str:
    """Prepend the views that `sql` uses, in definition order."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        for name in re.findall(r"[a-z_0-9]+", queue.pop()):
            if name in VIEWS and name not in needed:
                needed.add(name)
                queue.append(VIEWS[name])
    # A view may stand on one that is defined later in the dictionary.
    done: list[str] = []

    def add(name: str) -> None:
        for used in re.findall(r"[a-z_0-9]+", VIEWS[name]):
            if used in needed and used != name and used not in done:
                add(used)
        if name not in done:
            done.append(name)

    for name in VIEWS:
        if name in needed:
            add(name)
    if not done:
        return sql
    text = sql + " ".join(VIEWS[n] for n in done)
    # What several steps read is computed once.
    shared = {n for n in done if n in ALWAYS or len(re.findall(rf"\b{n}\b", text)) > 1}
    head = "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in shared else ''}({VIEWS[n]})" for n in done)
    # A statement with views of its own continues the list.
    return head + (",\n" + sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else "\n" + sql)


#: Kept as tables in any case: joins over ranges and of a line with itself are made once.
ALWAYS = {"in_lines", "cand", "label_sets", "dealing", "turns"}

_SQL: dict[str, str] = {
    "criteria_counts": "SELECT studyNCTid, criteria_type, count(*) AS n_items, sum(length(text)) AS n_chars FROM items GROUP BY ALL",
    "read_studies": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS study_row, StudyNCTid, cell AS EligibilityCriteria FROM blocks",
    "read_studies_split": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS study_row, StudyNCTid, cell AS EligibilityCriteria FROM blocks",
    "split_lines": "SELECT doc_id AS study_row, StudyNCTid, line_no, line FROM block_lines WHERE line <> ''",
    "tag_sections": "SELECT doc_id AS study_row, StudyNCTid, line_no, line, is_header, criteria_type FROM tagged",
    "extract_bullets": "SELECT study_row, StudyNCTid, line_no, criteria_type, text FROM bullets",
    "explode_criteria": "SELECT study_row, item_no, studyNCTid, criteria_type, text FROM items",
    "with_sentence_id": "SELECT sentence_id, study_row, item_no FROM sentences",
    "with_default_columns": """
        SELECT 'unknown' AS studyNCTid, 'unknown' AS criteria_type, conv_id, sum(length(text)) AS n_chars
        FROM conversations GROUP BY conv_id""",
    "normalize_text": """
        SELECT d.doc_id, d.n_chars, coalesce(CAST(l.quality AS VARCHAR), '') AS text FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "head_sentences": "SELECT sentence_id, studyNCTid, criteria_type, text FROM sentences ORDER BY sentence_id LIMIT 100",
    "read_corpus": f"SELECT file, text || {NL} AS text FROM docs",
    "read_annotations": "SELECT file, ann_line, line FROM ann",
    "pair_documents": """
        SELECT d.file, length(d.text) AS n_chars, a.n AS n_ann_chars FROM docs d JOIN (
          SELECT file, sum(length(raw) + 1) - 1 AS n FROM (
            SELECT a.file, a.line || CASE WHEN kind IN (1, 3) THEN chr(9) WHEN kind = 0 AND m.second AND m.next = '' THEN ' ' ELSE '' END AS raw
            FROM ann a JOIN found m ON m.file = a.file AND m.ord = a.ord) GROUP BY file) a ON a.file = d.file""",
    "unpaired_documents": "SELECT file, text FROM docs WHERE file NOT IN (SELECT file FROM found)",
    "criteria_type_of": """
        SELECT file, CASE WHEN file LIKE '%_exc%' THEN 'exclusion' WHEN file LIKE '%_inc%' THEN 'inclusion' ELSE 'unknown' END AS criteria_type
        FROM docs""",
    "parse_mentions_fragments": "SELECT * FROM frags",
    "filter_entity_types": f"SELECT file, type, count(*) AS n FROM frags WHERE type IN {_in(ENTITY_TYPES)} GROUP BY ALL",
    "parse_mentions_envelope": "SELECT * FROM envelope",
    "parse_relations": "SELECT * FROM binary_rel",
    "expand_nary_relations": "SELECT * FROM nary_rel",
    "all_relations": "SELECT file, rel_type, count(*) AS n FROM rels GROUP BY ALL",
    "filter_relation_types": f"SELECT rel_type, count(*) AS n FROM rels WHERE rel_type IN {_in(RELATION_TYPES)} GROUP BY ALL",
    "rejected_relations": f"SELECT rel_type, count(*) AS n FROM rels WHERE rel_type NOT IN {_in([*RELATION_TYPES, "NO_RELATION"])} GROUP BY ALL",
    "distinct_types": "SELECT DISTINCT rel_type FROM rels",
    "line_offsets": "SELECT file, line_no, text, off FROM kept_lines",
    "non_blank_lines": "SELECT file, count(*) AS n_lines, sum(off) AS sum_off FROM text_lines GROUP BY file",
    "assign_to_lines": 'SELECT file, line_no, ann_line, id, type, start, "end", text FROM in_lines',
    "realign_offsets": 'SELECT file, line_no, id, frag_no, start, "end" FROM frag_in_lines',
    "nest_entities": """
        SELECT file, line_no, coalesce(string_agg(id || ',' || type || ',' || start || ',' || "end", ';' ORDER BY eo), '') AS entities
        FROM text_lines LEFT JOIN (SELECT file, line_no, id, type, start, "end", eo FROM ents) USING (file, line_no) GROUP BY file, line_no""",
    "candidate_pairs": "SELECT * EXCLUDE (line_text) FROM cand",
    "nested_pairs": """
        SELECT a.sentence_id, a.type AS t1, b.type AS t2, count(*) AS n
        FROM inference_ents a JOIN inference_ents b ON a.sentence_id = b.sentence_id AND a.eo <> b.eo GROUP BY ALL""",
    "drop_overlaps": """
        SELECT file, line_no, e1_id, e2_id FROM cand WHERE NOT greatest(e1_start, e2_start) < least(e1_end, e2_end)""",
    "label_pairs": "SELECT file, line_no, e1_id, e2_id, label FROM labelled",
    "inject_markers_train": f"""
        SELECT file, e1_id, e2_id, md5(m) AS marked_md5, length(m) AS n_chars
        FROM (SELECT *, {_marked('line_text', 'e1_start', 'e1_end', 'e2_start', 'e2_end')} AS m FROM cand)""",
    "inject_markers_infer": f"""
        SELECT file, e1_id, e2_id, md5(m) AS marked_md5, length(m) AS n_chars
        FROM (SELECT *, {_marked('line_text', 'e1_start', 'e1_end', 'e2_start', 'e2_end')} AS m FROM cand
              WHERE NOT greatest(e1_start, e2_start) < least(e1_end, e2_end))""",
    "encode_labels": "SELECT file, label, id AS label_id, count(*) AS n FROM labelled JOIN re_map USING (label) GROUP BY ALL",
    "decode_labels": """
        SELECT d.file, CAST(d.label_id + 1 AS INT) AS label_id, coalesce(m.label, 'ID_' || (d.label_id + 1)) AS label, count(*) AS n
        FROM decided d LEFT JOIN re_map m ON m.id = d.label_id + 1 GROUP BY ALL""",
    "re_label_map": "SELECT id, label FROM re_map",
    "ner_label_map": "SELECT id, label FROM ner_map",
    "drop_rare_labels": "SELECT label, count(*) AS n FROM labelled GROUP BY label HAVING count(*) >= 100",
    "accepted_seen": f"SELECT DISTINCT rel_type FROM rels WHERE rel_type IN {_in(RELATION_TYPES)}",
    "pair_statistics": f"""
        SELECT count(*) AS total_pairs, count(*) FILTER (label <> 'NO_RELATION') AS positives,
          count(*) FILTER (label = 'NO_RELATION' AND u <= 0.25) AS negatives_kept,
          count(*) FILTER (label = 'NO_RELATION' AND u > 0.25) AS negatives_dropped,
          (SELECT count(*) FROM rels WHERE rel_type NOT IN {_in([*RELATION_TYPES, "NO_RELATION"])}) AS rejected,
          (SELECT string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) FROM rels WHERE rel_type NOT IN {_in([*RELATION_TYPES, "NO_RELATION"])}) AS rejected_types,
          round(count(*) FILTER (label = 'NO_RELATION' AND u <= 0.25)::DOUBLE / count(*) FILTER (label <> 'NO_RELATION'), 6) AS neg_pos_ratio
        FROM u_pairs""",
    "label_distribution": """
        SELECT split, id AS label_id, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS percent
        FROM splits JOIN re_map USING (label) GROUP BY split, id""",
    "re_statistics": """
        SELECT split, label, n, round(n * 100.0::DOUBLE / positives, 6) AS percent, pairs, positives, pairs - positives AS negatives,
          round((pairs - positives)::DOUBLE / positives, 6) AS neg_per_pos
        FROM (SELECT split, label, count(*) AS n FROM splits WHERE label <> 'NO_RELATION' GROUP BY ALL)
        JOIN (SELECT split, count(*) AS pairs, count(*) FILTER (label <> 'NO_RELATION') AS positives FROM splits GROUP BY split) USING (split)""",
    "class_weights": """
        SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM (
          SELECT label, n, sqrt(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE) AS w
          FROM (SELECT label, count(*) AS n FROM splits WHERE split = 'train' GROUP BY label))""",
    "stratified_split": "SELECT file, e1_id, e2_id, label, split FROM splits",
    "stratified_split_events": """
        SELECT event_id, event_type, CASE WHEN rn <= q1 THEN 'test' WHEN rn <= q1 + (2 * (n - q1) + 9) // 18 THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, (n + 5) // 10 AS q1 FROM (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
          row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|7'), CAST(event_id AS VARCHAR)) AS rn FROM events))""",
    "multilabel_split": "SELECT file, line_no, stratum, split FROM line_splits",
    "iterative_split": "SELECT file, line_no, split FROM balanced",
    "label_balance": """
        SELECT label_id, count(*) AS total, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation,
          count(*) FILTER (split = 'test') AS n_test FROM row_labels JOIN balanced USING (file, line_no) GROUP BY label_id""",
    "downsample_global": "SELECT file, e1_id, e2_id, label FROM u_pairs WHERE label <> 'NO_RELATION' OR u <= 0.3",
    "downsample_train": """
        SELECT file, e1_id, e2_id, s.label, split FROM splits s JOIN (SELECT file, e1_id, e2_id, u FROM u_pairs) USING (file, e1_id, e2_id)
        WHERE s.label <> 'NO_RELATION' OR split <> 'train' OR u < 0.2""",
    "tokenize_offsets": """
        SELECT file, line_no, string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(s || ':' || e, ' ' ORDER BY pos) AS offsets,
          count(*) AS n_real
        FROM seq GROUP BY file, line_no""",
    "build_vocab": """
        SELECT token, row_number() OVER (ORDER BY n DESC, token) + 7 AS id FROM (
          SELECT token, count(*) AS n FROM toks WHERE token NOT IN ('[E1]', '[/E1]', '[E2]', '[/E2]') GROUP BY token)
        UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[E1]', 4), ('[/E1]', 5), ('[E2]', 6), ('[/E2]', 7)) t(token, id)""",
    "encode_tokens": """
        SELECT file, line_no, string_agg(CASE WHEN s.token = '[CLS]' THEN 2 WHEN s.token = '[SEP]' THEN 3 ELSE coalesce(v.id, 1) END, ' ' ORDER BY pos) AS input_ids
        FROM seq s LEFT JOIN (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 7 AS id FROM (
          SELECT token, count(*) AS n FROM toks JOIN line_splits USING (file, line_no) WHERE split = 'train' GROUP BY token)) v USING (token) GROUP BY file, line_no""",
    "align_bio": "SELECT file, line_no, string_agg(tag, ' ' ORDER BY pos) AS tags FROM seq GROUP BY file, line_no",
    "bio_spans_strict": """
        SELECT file, line_no, row_number() OVER (PARTITION BY file, line_no ORDER BY first) - 1 AS span_no, type, first AS start, last AS "end"
        FROM pred_chunks WHERE first_tag LIKE 'B-%'""",
    "bio_spans_lenient": """
        SELECT file, line_no, row_number() OVER (PARTITION BY file, line_no ORDER BY first) - 1 AS span_no, type, first AS start, last AS "end"
        FROM pred_chunks""",
    "group_tokens": """
        SELECT c.file, c.line_no, c.type AS entity_group, substr(l.text, c.s + 1, c.e - c.s) AS word, c.s AS start, c.e AS "end",
          round(c.score, 6) AS confidence_score
        FROM pred_chunks c JOIN text_lines l USING (file, line_no)""",
    "base_label_counts": "SELECT regexp_replace(pred_tag, '^[BI]-', '') AS base, count(*) AS n FROM noisy GROUP BY ALL",
    "drop_ignored_positions": """
        SELECT file, tag AS truth, pred_tag AS pred, count(*) AS n FROM noisy WHERE token NOT IN ('[CLS]', '[SEP]') GROUP BY ALL""",
    "argmax_decode": "SELECT file, e1_id, e2_id, label_id, pred FROM decided",
    "softmax_scores": """
        SELECT file, e1_id, e2_id, round(1.0 / sum(exp(score - top)), 4) AS confidence
        FROM (SELECT *, max(score) OVER (PARTITION BY file, e1_id, e2_id) AS top FROM scores) GROUP BY file, e1_id, e2_id""",
    "label_presence": "SELECT file, line_no, label_id FROM row_labels",
    "presence_vector": """
        SELECT l.file, l.line_no, string_agg(CASE WHEN r.label_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY m.id) AS presence
        FROM text_lines l JOIN ner_map m ON m.id > 0
        LEFT JOIN row_labels r ON r.file = l.file AND r.line_no = l.line_no AND r.label_id = m.id GROUP BY l.file, l.line_no""",
    "ner_statistics": """
        SELECT split, type, count(*) AS spans, round(avg(last - first + 1), 6) AS mean_tokens, CAST(NULL AS BIGINT) AS sentences
        FROM gold_chunks JOIN line_splits USING (file, line_no) WHERE first_tag LIKE 'B-%' GROUP BY split, type
        UNION ALL
        SELECT split, NULL, count(first), NULL, count(DISTINCT file || '|' || line_no)
        FROM line_splits LEFT JOIN (SELECT * FROM gold_chunks WHERE first_tag LIKE 'B-%') USING (file, line_no) GROUP BY split""",
    "bio_label_counts": """
        SELECT split, id AS label_id, count(*) AS n FROM seq JOIN ner_map ON label = tag JOIN line_splits USING (file, line_no)
        WHERE id > 0 GROUP BY ALL""",
    "weighted_metrics": _overall("pair_scores"),
    "weighted_metrics_quality": _overall("quality_scores"),
    "classification_report": _report("pair_scores"),
    "confusion_matrix": _matrix("pair_counts"),
    "token_metrics": _token_metrics("tok_scores"),
    "span_metrics": _span_metrics("noisy", "true_chunks", "pred_chunks"),
    "tag_entities": """
        SELECT sentence_id, entity_group, word, start, "end", round(1.0::DOUBLE / length(word), 6) AS confidence_score FROM tag_ents""",
    "lexicon": "SELECT surface, type, n_tokens FROM lexicon_tokens WHERE n_tokens > 0",
    "lexicon_tagger": """
        SELECT o.sentence_id, o.type AS entity_group, o.word, o.start, o."end"
        FROM lexicon_ordered o JOIN lexicon_folded f ON f.sentence_id = o.sentence_id AND list_contains(f.kept, o.r)""",
    "score_relations": "SELECT * EXCLUDE (marked), md5(marked) AS marked_context FROM inference_rels",
    "nest_relations": """
        SELECT sentence_id, coalesce(r.n, 0) AS n, md5(coalesce(r.joined, '')) AS relations_md5 FROM inference LEFT JOIN (
          SELECT sentence_id, count(*) AS n, string_agg(arg1 || '|' || relation || '|' || arg2, ';' ORDER BY i, j) AS joined
          FROM inference_rels GROUP BY sentence_id) r USING (sentence_id)""",
    "extraction_entities": "SELECT sentence_id, nct_id, criteria_type, len(words) AS n_entities FROM tagged_sentences",
    "extraction_full": """
        SELECT t.sentence_id, nct_id, criteria_type, len(words) AS n_entities, coalesce(r.n, 0) AS n_relations FROM tagged_sentences t
        LEFT JOIN (SELECT sentence_id, count(*) AS n FROM full_pairs WHERE NOT (l0 >= l1 AND l0 >= l2) GROUP BY sentence_id) r USING (sentence_id)""",
    "subword_tokens": """
        SELECT file, line_no, count(*) AS n, md5(string_agg(id::VARCHAR, ' ' ORDER BY pos, b)) AS ids_md5,
          md5(string_agg((s + b) || ':' || (s + e), ' ' ORDER BY pos, b)) AS offsets_md5 FROM sub_seq GROUP BY file, line_no""",
    "viterbi_tags": """
        SELECT file, line_no, n, md5(array_to_string(list_reduce(list_prepend(
          [7 - greatest(a[1] * 8 + 7, a[2] * 8 + 6, a[3] * 8 + 5, a[4] * 8 + 4, a[5] * 8 + 3) % 8],
          [a[5 * t + 1 : 5 * t + 5] for t in range(n - 1, 0, -1)]), lambda p, b: list_prepend(b[p[1] + 1], p)), ' ')) AS path_md5 FROM viterbi_done""",
    "extraction_trained": """
        SELECT s.sentence_id, studyNCTid AS nct_id, criteria_type, coalesce(e.n, 0) AS n_entities, md5(coalesce(e.shown, '')) AS entities_md5,
          coalesce(r.n, 0) AS n_relations, md5(coalesce(r.shown, '')) AS relations_md5
        FROM sentences s LEFT JOIN (
          SELECT sentence_id, count(*) AS n, string_agg(type || ':' || start || ':' || "end", ';' ORDER BY eo) AS shown FROM inf_ents GROUP BY sentence_id) e
          ON e.sentence_id = s.sentence_id LEFT JOIN (
          SELECT sentence_id, count(*) AS n, string_agg(arg1 || '|' || pred || '|' || arg2, ';' ORDER BY i, j) AS shown FROM inf_rels GROUP BY sentence_id) r
          ON r.sentence_id = s.sentence_id""",
    "train_tagger": """
        SELECT regexp_replace(tag, '^[BI]-', '') AS truth, regexp_replace(coalesce(pred, 'O'), '^[BI]-', '') AS pred, count(*) AS n
        FROM seq JOIN line_splits l USING (file, line_no) LEFT JOIN tagger_preds USING (file, line_no, pos) WHERE l.split = 'validation' GROUP BY ALL""",
    "evaluate_tagger": f"""
        SELECT 'span' AS level, * EXCLUDE (support) FROM ({_span_metrics("tagger_seq", "tagger_true_chunks", "tagger_pred_chunks")})
        UNION ALL BY NAME SELECT 'token' AS level, * FROM ({_token_metrics("tagger_tok_scores")})""",
    "tune_tagger": _trials("taggers_preds"),
    "train_relation_model": "SELECT truth AS label, pred, count(*) AS n FROM rel_preds WHERE split = 'validation' GROUP BY ALL",
    "evaluate_relations": _report("rel_test_scores"),
    "evaluate_relations_overall": _overall("rel_test_scores"),
    "evaluate_relations_matrix": _matrix("rel_test_counts"),
    "tune": _trials("rels_all_preds"),
    "extraction_relations": """
        SELECT sentence_id, regexp_extract(file, '^D[0-9]+') AS nct_id,
          CASE WHEN file LIKE '%_exc%' THEN 'exclusion' WHEN file LIKE '%_inc%' THEN 'inclusion' ELSE 'unknown' END AS criteria_type,
          coalesce(e.n, 0) AS n_entities, coalesce(r.n, 0) AS n_relations
        FROM inference LEFT JOIN (SELECT sentence_id, count(*) AS n FROM inference_ents GROUP BY sentence_id) e USING (sentence_id)
        LEFT JOIN (SELECT sentence_id, count(*) AS n FROM inference_rels GROUP BY sentence_id) r USING (sentence_id)""",
    "write_jsonl": """
        SELECT sentence_id, text, coalesce(n, 0) AS n FROM inference LEFT JOIN
          (SELECT sentence_id, count(*) AS n FROM inference_ents GROUP BY sentence_id) USING (sentence_id)""",
    "read_sentences": """
        SELECT sentence_id, regexp_extract(file, '^D[0-9]+') AS studyNCTid, type AS entity_group, word, start, "end", 1.0::DOUBLE AS confidence_score
        FROM inference_ents""",
    "write_csv": """
        SELECT sentence_id, regexp_extract(file, '^D[0-9]+') AS studyNCTid,
          CASE WHEN file LIKE '%_exc%' THEN 'exclusion' WHEN file LIKE '%_inc%' THEN 'inclusion' ELSE 'unknown' END AS criteria_type,
          text, coalesce(shown, '') AS entities
        FROM inference LEFT JOIN (SELECT sentence_id, string_agg(concat_ws(',', type, word, start, "end"), ';' ORDER BY eo) AS shown
          FROM inference_ents GROUP BY sentence_id) USING (sentence_id)""",
    "write_splits": "SELECT split, label AS labels, count(*) AS n FROM splits GROUP BY ALL",
    "read_split": "SELECT file, e1_id, e2_id, label AS labels FROM splits WHERE split = 'test'",
    "label_map_file": "SELECT id, label FROM re_map",
}

ORACLES: dict[str, str] = {name: _with(sql) for name, sql in _SQL.items()}
