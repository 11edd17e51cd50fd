"""SQL twins (DuckDB) of the queries that SQL can express. Patterns and word lists are written out."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents),
h AS (SELECT *, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)) AS h FROM d),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM h GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM per),
weighed AS (SELECT *, (sid - 1) % 3 + 1 AS weight, (sum(source_size) OVER ())::BIGINT AS total,
              (sum(n_docs) OVER ())::BIGINT AS all_docs FROM ranked),
lev AS (SELECT *, source_size * (6 // weight) AS full_at FROM weighed),
lev2 AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent,
           (sum(weight) OVER (ORDER BY full_at, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS shares FROM lev),
lev3 AS (SELECT *, 3 * source_size * shares <= (total - spent) * weight AS capped FROM lev2),
free AS (SELECT spent AS f_spent, shares AS f_shares FROM lev3 WHERE NOT capped ORDER BY full_at, sid LIMIT 1),
src AS (SELECT source, sid, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
          ELSE (total - f_spent)::DOUBLE * weight / f_shares END AS target,
          greatest(1, ceil(source_size / greatest(20000, ceil(total / 1000000)))::BIGINT,
                      ceil(n_docs / greatest(20000, ceil(all_docs / 1000000)))::BIGINT) AS n_blocks
        FROM lev3 LEFT JOIN free ON true),
src2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM src),
src3 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) - passes * source_size ELSE 0 END AS rest FROM src2),
dealt AS (SELECT h.*, s.* EXCLUDE (source), ('0x' || substr(h, 1, 15))::BIGINT % n_blocks AS block
          FROM h JOIN src3 s ON h.source IS NOT DISTINCT FROM s.source),
blocks AS (SELECT sid, block, any_value(rest) AS rest, any_value(passes) AS passes, sum(size)::BIGINT AS words FROM dealt GROUP BY sid, block),
ordered AS (SELECT *, (sum(words) OVER (PARTITION BY sid ORDER BY md5('7|' || passes || '|' || sid || '|' || block), block
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto FROM blocks),
part AS (SELECT sid, block, CASE WHEN upto > rest THEN rest - (upto - words) END AS partly FROM ordered WHERE upto - words < rest),
inside AS (SELECT d.sid, h, any_value(partly) AS partly, sum(size)::BIGINT AS words FROM dealt d JOIN part p
           ON d.sid = p.sid AND d.block = p.block AND p.partly IS NOT NULL GROUP BY d.sid, h),
upto AS (SELECT *, (sum(words) OVER (PARTITION BY sid ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS u FROM inside),
cuts AS (SELECT sid, max(h) AS cut_h FROM upto WHERE 2 * u - words <= 2 * partly GROUP BY sid)
SELECT doc_id, size, source_size, target,
  size * (passes + CASE WHEN p.block IS NULL THEN 0 WHEN p.partly IS NULL THEN 1 WHEN h <= coalesce(cut_h, '') THEN 1 ELSE 0 END)::BIGINT AS taken
FROM dealt d LEFT JOIN part p ON d.sid = p.sid AND d.block = p.block LEFT JOIN cuts c ON c.sid = d.sid
"""

_CONTROLS = ["<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>",
             "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "[SYS]", "[/SYS]"]


def _literal(s: str) -> str:
    return "".join("\\" + c if c in r"|[]\/<>." else c for c in s)


_CONTROL = "|".join(_literal(c[0]) + r"\\*" + _literal(c[1:]) for c in _CONTROLS)

OP2 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) > 5),
win2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_repeat_words FROM (SELECT doc_id, i + unnest(range(0, 5)) AS pos FROM win2 WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
l2 AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_WORD}')) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again FROM l),
l3 AS (SELECT *, again OR regexp_matches(line, '(?i)^[ \t]*(home|menu|next|previous|back|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|read more|share|skip to content|back to top)[ \t\r.!:]*$')
    OR len(regexp_extract_all(line, '[|»›•]')) >= 2
    OR regexp_matches(line, '(?i)lorem ipsum|enable javascript|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|licensed under|subscribe to our|powered by|copyright [0-9©(]')
    OR (n < 30 AND NOT regexp_matches(line, '[.!?:;…"''”’»)][ \t\r]*$'))
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 > length(line) AS fails FROM l2 WHERE n > 0),
ln AS (SELECT doc_id, count(*) FILTER (again)::BIGINT AS n_dup_lines, count(*)::BIGINT AS n_lines, count(*) FILTER (fails)::BIGINT AS n_failed_lines,
         coalesce(sum(n) FILTER (fails), 0)::BIGINT AS lost_words FROM l3 GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in words]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_words, 0) AS lost_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost_words <= n_words AS kept FROM b
"""

#: kind, pattern, checked group, its least length; in the order of the kinds.
_SECRETS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._%+!*-]{3,}@", 0, 1),
]


def _found(n: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {n} AS n, '{kind}' AS kind, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(m) AS chars, length(b) AS checked, {least} AS least
      FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(b) AS b, unnest(p[1:len(m)]) AS p FROM
        (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS b, string_split_regex(text, '{p}') AS p FROM documents)
        WHERE len(m) > 0)"""


OP10 = f"""
WITH f AS ({" UNION ALL ".join(_found(n, *x) for n, x in enumerate(_SECRETS))}),
s AS (SELECT doc_id, n, kind, stop - chars AS start, kind || ':' || CAST(stop - chars AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM f WHERE checked >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
   coalesce(string_agg(span, ',' ORDER BY start, n) FILTER (n < 3), '') AS base, string_agg(span, ',' ORDER BY start, n) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""


#: Notices, written out.
_NOTICES = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Released under the MIT License"), ("MIT", "Licensed under the MIT License"), ("MIT", "SPDX License Identifier MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("Apache-2.0", "SPDX License Identifier Apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"), ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX License Identifier GPL 3.0 only"), ("GPL-2.0", "SPDX License Identifier GPL 2.0 only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"), ("LGPL-3.0", "SPDX License Identifier LGPL 3.0 only"),
    ("BSD-3-Clause", "SPDX License Identifier BSD 3 Clause"), ("BSD-2-Clause", "SPDX License Identifier BSD 2 Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY NC 4.0"), ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC0-1.0", "This work is released into the public domain under the CC0 1.0 license"),
]


def _op6() -> str:
    """The whole texts are those of the operator; notices and the canonical form are written anew."""
    from cohortlab.llm.license_scan import KNOWN

    def canonical(x: str) -> str:
        head = "(?i)^[ \\t/*#;-]*"
        line = (f"(regexp_matches(z, '{head}copyright[ \\t]*(\\(c\\)|©)') OR regexp_matches(z, '{head}(copyright|\\(c\\)|©)[ \\t]*(19|20)[0-9][0-9]')) "
                f"AND NOT regexp_matches(z, '{head}copyright[ \\t]*(\\(c\\)|©)[ \\t]*([<\\[]|year)') AND NOT regexp_matches(z, '(?i)free software')")
        x = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda z: NOT ({line})), chr(10))"
        x = f"replace(regexp_replace({x}, '(?i)all\\s+rights\\s+reserved\\.?', '', 'g'), '&', ' and ')"
        x = f"' ' || regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g') || ' '"
        for a, b in (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
                     ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("favour", "favor"),
                     ("organisation", "organization"), ("per cent", "percent"), ("https", "http")):
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"md5(trim({x}))"

    def values(pairs):
        return ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in pairs)

    def known(pairs):
        return f"""(SELECT {canonical("text")} AS digest, min(license) AS license FROM (VALUES {values(pairs)}) AS v(license, text) GROUP BY 1)"""

    return f"""
WITH k AS {known(KNOWN)}, k2 AS {known(_NOTICES)},
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, {canonical("line")} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '(?i)licen[cs]e|public domain|permission|redistribution|source code form')),
n AS (SELECT doc_id, count(*)::BIGINT AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k2 USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, {canonical("text")} AS digest FROM d)
SELECT w.doc_id, w.digest, k.license, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN n USING (doc_id)
"""


OP6 = _op6()

#: The table of crc32 from its polynomial.
_CRC_TABLE = ("crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), "
              "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)")


def _crc32(data: str) -> str:
    """Unsigned crc32 of a list of bytes; ``crc.t`` is the table."""
    return f"xor(list_reduce([4294967295] || {data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"



def _bytes(x: str) -> str:
    """The UTF-8 bytes of a text of code points below 256."""
    return (f"flatten(list_transform(regexp_extract_all({x}, '.'), lambda z: CASE WHEN unicode(z) < 128 THEN [unicode(z)::BIGINT] "
            f"WHEN unicode(z) < 192 THEN [194::BIGINT, unicode(z)] ELSE [195::BIGINT, unicode(z) - 64] END))")


OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL HAVING length(run) >= 7),
hashed AS (SELECT run, k, {_crc32(_bytes("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM counted, crc),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
swap AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
indel AS (SELECT DISTINCT c.word AS longer, c.n AS longer_n, w.word AS shorter, w.n AS shorter_n FROM cut c JOIN w ON c.rest = w.word),
pairs AS (SELECT * FROM swap UNION ALL SELECT longer, shorter, shorter_n FROM indel UNION ALL SELECT shorter, longer, longer_n FROM indel),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
named AS (SELECT p.word, min(near) AS near, any_value(n_near) AS n_near, any_value(top) AS top FROM pairs p JOIN best b ON p.word = b.word AND p.n = b.top GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * w.n THEN near END AS form, CASE WHEN top >= 10 * w.n THEN top END::BIGINT AS form_n
  FROM w LEFT JOIN named USING (word)),
walk AS (SELECT word, form AS goal, 1 AS steps FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN forms f ON walk.goal = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(r.goal, f.word) AS root, n, n_near, form_n
FROM forms f LEFT JOIN (SELECT word, arg_max(goal, steps) AS goal FROM walk GROUP BY word) r USING (word)
"""

OP13 = rf"""
WITH {_CRC_TABLE},
texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
hashed AS (SELECT doc_id, ws, len(ws) AS n, {_crc32(_bytes("coalesce(CAST(doc_id AS VARCHAR), '')"))} AS h FROM texts, crc),
looped AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed),
looped2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM looped),
places AS (SELECT doc_id, ws, a, p, unnest(range(0, n)) AS i FROM looped2),
w AS (SELECT doc_id, i, ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM places),
sizes AS (SELECT doc_id, n FROM hashed),
equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i JOIN sizes s ON s.doc_id = x.doc_id
  WHERE 4 * (y.i - x.i) <= s.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
long AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM long GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
  arg_min({{'s': start, 'l': length, 'q': period}}, {{'a': -length, 'b': start, 'c': period}}) AS top FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.q::BIGINT AS period,
  (1000 * top.l // top.q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: The given pages mark up their article, so SQL can cut it out; the operator is not told where it is.
OP11 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, unnest(list_concat([''], string_split_regex(body, '</?(?:p|h1)>'))) AS block, generate_subscripts(list_concat([''], string_split_regex(body, '</?(?:p|h1)>')), 1) AS i FROM a),
c AS (SELECT page_id, url, i, regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, url, i, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS t FROM c),
e AS (SELECT page_id, url, i, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM d)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text,
  length(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), ''))::BIGINT AS n_chars
FROM e GROUP BY page_id, url
"""
