"""SQL of the numbered queries that SQL can state, each over its whole table."""

from .chat_format import END, MIDDLE, START
from .collocations import LONGEST, SUPPORT, TOP
from .decontaminate import WINDOW
from .jaccard_join import SHINGLE
from .substring_dedup import LENGTH

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRINGS = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h FROM w, unnest(range(1, len(w) - {LENGTH - 2})) AS r(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1), hit AS (SELECT doc_id, i FROM win JOIN rep USING (h)),
pos AS (SELECT doc_id, j, w[j] AS word FROM w, unnest(range(1, len(w) + 1)) AS r(j)),
cov AS (SELECT pos.doc_id, j, word, max(i) OVER (PARTITION BY pos.doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM pos LEFT JOIN hit ON pos.doc_id = hit.doc_id AND j = i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE j - last < {LENGTH}) AS n, string_agg(word, ' ' ORDER BY j) FILTER (WHERE last IS NULL OR j - last >= {LENGTH}) AS t FROM cov GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

_MARKED = r"replace(replace(replace({0}, '\', '\\'), '#', '\#'), '</turn>', '\</turn>')"
_FIXED = len(START) + len(MIDDLE) + len(END)
CHATS = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum({_FIXED} + length(replace({_MARKED.format("role")}, ':', '\:')) + length({_MARKED.format("text")})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


# No masks: every placement of an item on a document that has enough equal words in place.
LEAKS = rf"""WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS item FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
iw AS (SELECT item_id, len(item) AS n, item[j] AS word, j FROM i, unnest(range(1, len(item) + 1)) AS r(j)),
dw AS (SELECT doc_id, w[p] AS word, p FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
hits AS (SELECT doc_id, item_id, p - j AS first_word FROM dw JOIN iw USING (word) GROUP BY doc_id, item_id, n, p - j HAVING count(*) * 100 >= 80 * least({WINDOW}, n)),
f AS (SELECT doc_id, item_id, item, first_word, list_transform(range(1, len(item) + 1), lambda j: CASE WHEN first_word + j >= 1 AND w[first_word + j] = item[j] THEN 1 ELSE 0 END) AS agree FROM hits JOIN d USING (doc_id) JOIN i USING (item_id)),
g AS (SELECT *, list_max(list_transform(range(1, len(item) - least({WINDOW}, len(item)) + 2), lambda s: list_sum(agree[s:s + least({WINDOW}, len(item)) - 1]))) AS best, list_sum(agree) AS n FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, best DESC, first_word) AS r FROM g WHERE best * 100 >= 80 * least({WINDOW}, len(item)))
SELECT doc_id, item_id, CAST(len(item) AS BIGINT) AS item_words, CAST(n AS BIGINT) AS matched_words, CAST(best AS BIGINT) AS best_run, CAST(first_word AS BIGINT) AS first_word FROM k WHERE r = 1"""

NEAR_COPIES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + {SHINGLE - 1}], ' ')) AS g FROM w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS r(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = w.doc_id), w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""

_SPLIT = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
COLLOCATIONS = rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest({_SPLIT}) AS piece FROM documents)),
size AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, w[i:i + m - 1] AS ph FROM p, unnest(range(1, len(w) + 1)) AS r(i), unnest(range(1, {LONGEST + 1})) AS s(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY lang, ph HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, ph, f AS a, k FROM f, unnest(range(1, len(ph))) AS r(k) WHERE len(ph) > 1),
s AS (SELECT c.lang, c.ph, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM c JOIN size USING (lang)
  JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:len(c.ph)]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS first FROM s),
longer AS (SELECT lang, ph[i:i + m - 1] AS ph, max(f) AS most FROM f, unnest(range(1, len(ph) + 1)) AS r(i), unnest(range(2, len(ph))) AS t(m) WHERE i + m - 1 <= len(ph) GROUP BY ALL),
k AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b LEFT JOIN longer ON b.lang = longer.lang AND b.ph = longer.ph WHERE first = 1 AND coalesce(most, 0) < a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k) WHERE rank <= {TOP}"""


ORACLE_SQL = {"op2_substring_dedup": SUBSTRINGS, "op3_chat_format": CHATS, "op4_decontaminate": LEAKS, "op9_jaccard_join": NEAR_COPIES, "op13_collocations": COLLOCATIONS}
