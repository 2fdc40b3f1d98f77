"""DuckDB SQL of the training-data queries that SQL can state, written apart
from the Spark code."""

from __future__ import annotations

SPACES = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}')"


_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_lower('text')}, '{_SEP}'),
                                      lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({_lower('text')}, '{_SEP}'),
                                  lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS win
        FROM (SELECT item_id, w, least(len(w), 10) AS l,
                     unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
              FROM b WHERE len(w) > 0)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
ahead AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p
                 ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM word),
place AS (SELECT a.doc_id, a.p, l.l, array_to_string(a.ws[1:l.l], ' ') AS win
       FROM ahead a JOIN (SELECT DISTINCT l FROM win) l ON len(a.ws) >= l.l),
occ AS (SELECT place.doc_id, place.p, place.l, win.item_id FROM place JOIN win ON place.win = win.win AND place.l = win.l),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit,
       coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) \
    + "|" + _either_case("api") + "_?" + _either_case("key")
_BREAK = r"(?:\s|\\[rn]){1,4}"
#: header, then all up to END, or else the whole lines of base64 (the last one before \\n or
#: the text's end: there is no lookahead here for a last line before \\r or a written \\n)
_PEM = (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?s:.*?)-----END [A-Z ]{0,30}PRIVATE KEY-----"
        rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info): ?[^\n\\]{{0,200}}){{0,4}}(?:{_BREAK}[A-Za-z0-9+/=]{{16,}})+"
        rf"(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}})?(?m:$))?")
#: kind, place among kinds, pattern, group of the least length, least length
_RULES = (
    ("assign", 0, f"(?:{_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    ("hex", 2, "[0-9a-f]+", 0, 24),
    ("pem", 3, _PEM, 0, 1),
    ("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
)


def _found(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    # places of matches: lengths of the text between them and of the matches before
    return f"""
SELECT doc_id, '{kind}' AS kind, {order} AS o, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e
FROM (SELECT doc_id, own, size, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS e
      FROM (SELECT doc_id, i, length(gaps[i]) AS gap, length(hits[i]) AS size, length(own[i]) AS own
            FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
                  FROM (SELECT doc_id, regexp_extract_all(x, '{pattern}') AS hits,
                               regexp_extract_all(x, '{pattern}', {group}) AS own,
                               string_split_regex(x, '{pattern}') AS gaps FROM t))))
WHERE own >= {least}"""


SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
f AS ({' UNION ALL '.join(_found(*r) for r in _RULES)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
             count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
      FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""

# fixed values: very common words per language
_COMMON = {
    "en": "the of and to in is that for was with on are this be",
    "de": "der die und in den von zu das mit sich des auf ist im",
    "fr": "de la le et les des en un du une que est pour qui",
    "es": "de la que el en y a los se del las un por con",
}
_LISTED = ", ".join(f"('{lang}', '{w}')" for lang, ws in _COMMON.items() for w in ws.split())

QUALITY = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, lang, list_filter(string_split_regex(x, '{SPACES}'), lambda v: v <> '') AS w FROM t),
word AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
tri AS (SELECT doc_id, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g
        FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c
                                 FROM tri WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
            SELECT doc_id, unnest(range(p, p + 3)) AS q FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
size AS (SELECT doc_id, length(x) AS n,
                length(regexp_replace(x, '{SPACES}', '', 'g')) AS word_chars,
                length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbol,
                length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS upper,
                length(x) - length(regexp_replace(x, '[0-9]', '', 'g')) AS digit,
                length(x) - length(regexp_replace(x, '[^\x00-\x7F]', '', 'g')) AS wide,
                length(x) - length(regexp_replace(x, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS punct
         FROM t),
hist AS (
    SELECT doc_id, 'c' AS h, class, n FROM (
        SELECT doc_id, unnest(['lower', 'upper', 'digit', 'space', 'symbol', 'punct', 'wide']) AS class,
               unnest([word_chars - upper - digit - punct - wide, upper, digit,
                       n - word_chars, symbol, punct - symbol, wide]) AS n FROM size)
    UNION ALL
    SELECT doc_id, 'w', coalesce(l.word, ' other'), count(*) FROM word
    LEFT JOIN (VALUES {_LISTED}) l(lang, word) ON word.lang = l.lang AND word.word = l.word
    WHERE word.lang IN ('en', 'de', 'fr', 'es') GROUP BY ALL),
own AS (SELECT hist.*, w.lang, sum(n) OVER (PARTITION BY doc_id, h) AS total,
               CASE h WHEN 'c' THEN total >= 200 ELSE len(w.w) >= 100 END AS enough
        FROM hist JOIN w USING (doc_id) WHERE w.lang IN ('en', 'de', 'fr', 'es')),
ref AS (SELECT lang, h, class, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang, h) AS total
        FROM own GROUP BY lang, h, class),
both_of AS (SELECT d.doc_id, d.h, coalesce(own.n, 0) / d.total AS p, ref.n / ref.total AS q
            FROM (SELECT DISTINCT doc_id, lang, h, total FROM own WHERE enough AND total > 0) d
            JOIN ref ON ref.lang = d.lang AND ref.h = d.h
            LEFT JOIN own ON own.doc_id = d.doc_id AND own.h = d.h AND own.class = ref.class),
js AS (SELECT doc_id, h, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
              + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
       FROM both_of GROUP BY doc_id, h),
far AS (SELECT DISTINCT doc_id FROM js WHERE d > CASE h WHEN 'c' THEN MAX_CHAR ELSE MAX_WORD END)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, size.word_chars, size.symbol AS n_symbols,
       coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
       len(w.w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w.w) AS base_failed,
       NOT (len(w.w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w.w)) AND far.doc_id IS NULL AS kept
FROM w JOIN size USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
LEFT JOIN far USING (doc_id)
""".replace("MAX_CHAR", "0.36").replace("MAX_WORD", "0.27")

_ESCAPE = "replace(replace(replace({}, '\\', '\\\\'), '###', '\\#\\#\\#'), '</turn>', '\\<\\/turn>')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'),
                            (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
e AS (SELECT *, '### ' || replace(replace({_ESCAPE.format('r')}, ':', '\\:'), chr(10), '\\' || chr(10))
             || ': ' || {_ESCAPE.format('x')} || '</turn>' || chr(10) AS piece FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), ''))
           AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'),
                                      lambda v: v <> '') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
ahead AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p
                 ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS ws FROM word),
twice AS (SELECT doc_id, p FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(ws, ' ')) AS c
    FROM ahead WHERE len(ws) = 35) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM twice),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.p) AS text
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p
         WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, len(w.w) - coalesce(kept.n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

_BLANK, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
FIM = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || doc_id) AS s,
                  regexp_extract_all(coalesce(text, ''), '{_BLANK}*{_INK}+|{_BLANK}+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
             CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50
                    THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
part AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
                array_to_string(u[b + 1:], '') AS z FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
              ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM part
"""

SQL = {"op2_quality": QUALITY, "op4_chat": CHAT, "op5_substring": SUBSTRING,
       "op8_decontamination": DECONTAMINATION,
       "op9_secrets": SECRETS, "op12_fim": FIM}
