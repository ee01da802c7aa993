"""The queries of this subpackage, by name, and the SQL that some of them equal."""

from .bpe import op1_bpe_roundtrip
from .chat import CONTROL, op9_chat_format
from .jaccard import op3_ngram_jaccard
from .langid import op4_language_id
from .lines import op8_line_dedup
from .packing import op5_packing
from .quality import DEPLETED, LEAST_DOCS, LINE_DOCS, LINE_SHARE, op10_quality_rules
from .repeats import op2_suffix_array_dedup, op7_substring_dedup
from .tiff import op6_tiff_media

QUERIES = {f.__name__: f for f in (op1_bpe_roundtrip, op2_suffix_array_dedup, op3_ngram_jaccard, op4_language_id, op5_packing, op6_tiff_media, op7_substring_dedup, op8_line_dedup, op9_chat_format, op10_quality_rules)}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets as rows; pairs that share a shingle are counted; components by following links until nothing is new.
_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id) x),
r AS (SELECT s.* FROM s JOIN k ON k.doc_id = s.doc_id AND k.rep = s.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT rep AS a, rep AS b FROM k UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
m AS (SELECT a, min(b) AS component FROM c GROUP BY a),
o AS (SELECT k.doc_id, m.component FROM k JOIN m ON m.a = k.rep)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(o.component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id"""

_OP7 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35) y),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS times FROM x) y WHERE times > 1),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, 35)) AS j) t),
f AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) y ANTI JOIN g USING (doc_id, p)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id"""

_CONTROL = "|".join("".join(c if c.isalnum() or c in "<>_/" else f"[{c}]" if c not in "[]" else f"\\{c}" for c in s) for s in CONTROL)


def _escaped(text: str) -> str:
    """The length of an escaped text: one more for each backslash and each control string."""
    return f"length({text}) + length({text}) - length(replace({text}, chr(92), '')) + len(regexp_extract_all({text}, '{_CONTROL}'))"


_OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum({len(CONTROL[0]) + len(CONTROL[1]) + 2} + {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")})::bigint AS formatted_chars FROM c GROUP BY conv_id"""

_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
l AS (SELECT doc_id, host, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
f AS (SELECT doc_id, host, len(regexp_extract_all(line, '{_WORD}')) AS words, regexp_replace(array_to_string(regexp_extract_all({_LOWER.format("line")}, '{_WORD}'), ' '), '[0-9]', '0', 'g') AS k FROM l),
h AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
often AS (SELECT f.host, f.k FROM f JOIN h ON h.host = f.host GROUP BY f.host, f.k, h.docs HAVING count(DISTINCT f.doc_id) > least({LINE_DOCS}, greatest({LEAST_DOCS - 1}, {LINE_SHARE} * h.docs))),
lost AS (SELECT f.doc_id, sum(f.words) AS n FROM f JOIN often USING (host, k) GROUP BY f.doc_id),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 2], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3) x),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS times FROM g) x, (SELECT unnest([0, 1, 2]) AS j) t WHERE times > 1 GROUP BY doc_id),
s AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::bigint AS n_removed_words
      FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= {DEPLETED} * n_words AS kept FROM s"""

#: Over documents with ids of their own, as the test tables have them.
SQL: dict[str, str] = {"op3_ngram_jaccard": _OP3, "op7_substring_dedup": _OP7, "op9_chat_format": _OP9, "op10_quality_rules": _OP10}
