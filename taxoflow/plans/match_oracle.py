"""SQL for DuckDB that means the same as the queries of ``match_queries``."""

from __future__ import annotations

from taxoflow.functions import text as T
from taxoflow.plans.match_queries import BUCKET_CLASSES, BUCKETS, DEFAULTS, REFINING, SUFFIXES
from taxoflow.plans.table_queries import _ANCESTORS, _TREE


def _punct(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[-_();/:%,]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _key(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _singular(c: str) -> str:
    """The plural rules as a CASE."""
    when = [f"WHEN regexp_matches({c}, '(?i)\\b(?:{'|'.join(T.UNCOUNTABLE)})$') THEN {c}"]
    when += [f"WHEN regexp_matches({c}, '(?i){p}$') THEN regexp_replace({c}, '(?i){p}$', '{s}')" for p, s in T.IRREGULAR]
    when += [f"WHEN regexp_matches({c}, '(?i){p}') THEN regexp_replace({c}, '(?i){p}', '{n.replace('$1', chr(92) + '1')}')" for p, n in T.SINGULAR]
    return f"CASE {' '.join(when)} ELSE {c} END"


def _values(rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


_LABELS = f"""
lr AS (SELECT replace(lower(term_id), ':', '_') AS term_id, lower(label) AS label, {_punct('label')} AS std, term_id AS pos FROM terms WHERE label IS NOT NULL),
labels AS (SELECT std, {_key('std')} AS key, arg_max(term_id, pos) AS term_id, arg_max(label, pos) AS label, min(pos) AS pos FROM lr GROUP BY std),
perms AS (SELECT key, arg_max(term_id, pos) AS term_id FROM labels WHERE len(string_split(std, ' ')) < 7 AND NOT contains(term_id, 'ncbitaxon') GROUP BY key),
typed AS (SELECT DISTINCT value, {_punct('value')} AS std FROM (SELECT sample AS value FROM match_results UNION ALL SELECT unnest(matched_components) FROM match_results) WHERE value IS NOT NULL),
lx AS (SELECT kind, lower(trim(lex_key)) AS key, coalesce(lower(trim(lex_value)), '') AS val, pos FROM lexicon),
lw AS (SELECT kind, key, arg_max(val, pos) AS val FROM lx GROUP BY ALL),
syn AS (SELECT {_punct('key')} AS syn, {_punct('val')} AS std FROM lw WHERE kind = 'synonym'),
plain AS (
  SELECT std AS text, term_id, 'A Direct Match' AS status, 0 AS rank FROM labels),
synm AS (
  SELECT syn AS text, coalesce(l.term_id, p.term_id) AS term_id,
    'Synonym Usage; ' || CASE WHEN l.term_id IS NOT NULL THEN 'A Direct Match' ELSE 'Permutation of Tokens in Resource Term' END AS status
  FROM syn s LEFT JOIN labels l ON l.std = s.std LEFT JOIN perms p ON p.key = {_key('s.std')} WHERE coalesce(l.term_id, p.term_id) IS NOT NULL)"""

_SFX = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SUFFIXES))


def _cascade(source: str, column: str) -> str:
    """Best match of a phrase with a suffix: direct before permuted within the first suffix, then by synonym."""
    return f"""
      SELECT value, arg_min(term_id, r) AS term_id, arg_min(status, r) AS status FROM (
        WITH x AS (SELECT * FROM (VALUES {_SFX}) t(i, s)),
        y AS (SELECT v.value, x.i, '' AS via, 0 AS base, v.{column} || ' ' || x.s AS f FROM {source} v CROSS JOIN x
          UNION ALL SELECT v.value, x.i, 'Synonym Usage; ', 1000, syn.std || ' ' || x.s FROM {source} v JOIN syn ON syn.syn = v.{column} CROSS JOIN x),
        z AS (SELECT *, {_key('f')} AS k FROM y)
        SELECT z.value, l.term_id, z.via || 'Suffix Addition; A Direct Match' AS status, z.base + 2 * z.i AS r FROM z JOIN labels l ON l.std = z.f
        UNION ALL SELECT z.value, p.term_id, z.via || 'Suffix Addition; Permutation of Tokens in Resource Term', z.base + 2 * z.i + 1 FROM z JOIN perms p ON p.key = z.k) GROUP BY value"""


def _plainly(source: str, column: str) -> str:
    return f"""
      SELECT value, coalesce(l.term_id, p.term_id, s.term_id) AS term_id,
        CASE WHEN l.term_id IS NOT NULL THEN 'A Direct Match' WHEN p.term_id IS NOT NULL THEN 'Permutation of Tokens in Resource Term' ELSE s.status END AS status
      FROM {source} v LEFT JOIN labels l ON l.std = v.{column} LEFT JOIN perms p ON p.key = {_key('v.' + column)} LEFT JOIN synm s ON s.text = v.{column}
      WHERE coalesce(l.term_id, p.term_id, s.term_id) IS NOT NULL"""


_WORDS_OF = "string_split(trim(regexp_replace(regexp_replace(regexp_replace({c}, '([!?\\[\\]{{}}<>\"])', ' \\1 ', 'g'), '([^.\\s])\\.$', '\\1 .'), '\\s+', ' ', 'g')), ' ')"
_SAMPLE_WORDS = _WORDS_OF.format(c="regexp_replace(trim(regexp_replace(lower(sample), '\\s+', ' ', 'g')), '''s( |$)', ' ''s\\1', 'g')")
_PHRASE_HITS = f"""
w AS (SELECT DISTINCT sample_no, {_singular('x')} AS word FROM (SELECT sample_no, unnest({_SAMPLE_WORDS}) AS x FROM texts)),
ph AS (SELECT * FROM {_values(DEFAULTS)} t(phrase, label, pos)),
pw AS (SELECT DISTINCT phrase, label, pos, {_singular('x')} AS word FROM (SELECT *, unnest(string_split(phrase, ' ')) AS x FROM ph)),
n AS (SELECT phrase, count(*) AS n FROM pw GROUP BY phrase),
hc AS (SELECT sample_no, phrase, label, pos, count(*) AS m FROM w JOIN pw USING (word) GROUP BY ALL),
hit AS (SELECT hc.* FROM hc JOIN n USING (phrase) WHERE m = n.n),
b AS (SELECT sample_no, arg_max(phrase, pos) AS phrase, arg_max(label, pos) AS label FROM hit GROUP BY sample_no)"""


def _grams(n: int) -> str:
    return f"""WITH t AS (SELECT sample_no, string_split({_punct('sample')}, ' ') AS t FROM texts),
p AS (SELECT sample_no, t, unnest(generate_series(1, len(t) - {n - 1})) AS pos FROM t)
SELECT sample_no, pos, array_to_string(t[pos:pos + {n - 1}], ' ') AS gram FROM p"""


_RUN_OR_ALL = f"""WITH t AS (SELECT sample_no, string_split({_punct('sample')}, ' ') AS t FROM texts),
i AS (SELECT sample_no, t, unnest(generate_series(1, len(t))) AS i FROM t)
SELECT a.sample_no, a.i || ',' || b.i || ',' || c.i AS positions, a.t[a.i] || ' ' || a.t[b.i] || ' ' || a.t[c.i] AS gram
FROM i a JOIN i b ON a.sample_no = b.sample_no AND a.i < b.i JOIN i c ON c.sample_no = a.sample_no AND b.i < c.i
WHERE len(a.t) < {T.COMBINATION_TOKENS} OR (b.i = a.i + 1 AND c.i = b.i + 1)"""

_COMPONENTS = "SELECT result_id, list_transform(list_filter(matched_components, lambda x: x IS NOT NULL AND contains(x, ':')), lambda x: lower(x)) AS c FROM match_results"

_PATH_ROWS = f"""{_TREE},
c AS (SELECT DISTINCT a AS node FROM reach WHERE a = b),
p AS (
  SELECT DISTINCT node, node AS path, [node] AS steps, node AS last FROM l
  UNION ALL
  SELECT p.node, p.path || '/' || e.parent, list_append(p.steps, e.parent), e.parent FROM p JOIN e ON p.last = e.node WHERE p.last NOT IN (SELECT node FROM c)),
whole AS (SELECT * FROM p WHERE last IN (SELECT node FROM c) OR last NOT IN (SELECT node FROM e))"""

ORACLE = {
    "punctuation_treatment": f"SELECT sample_no, {_punct('sample')} AS treated FROM texts",
    "token_preprocess": """WITH t AS (SELECT sample_no, string_split(lower(sample), ' ') AS t FROM texts)
SELECT sample_no, (i - 1)::INT AS pos, regexp_replace(regexp_replace(replace(t[i], '''s', ''), '['', ]+$', ''), '[. ]+$', '') AS token
FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM t)""",
    "token_filter": f"""WITH {_LABELS}, t AS (SELECT unnest(string_split(lower(value), ' ')) AS token FROM typed)
SELECT token, count(*) AS n, regexp_matches(token, '{T.NUMBER}') AS is_number, regexp_matches(token, '{T.DATE}') AS is_date FROM t GROUP BY ALL""",
    "singular_tokens": f"""WITH {_LABELS}, t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(value), '[^a-z]+')) AS token FROM typed)
SELECT token, {_singular('token')} AS singular FROM t WHERE token <> ''""",
    "dedupe_tokens": """WITH t AS (SELECT sample_no, string_split(lower(sample), ' ') AS t FROM texts),
i AS (SELECT sample_no, t[i] AS w, i FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM t)),
f AS (SELECT sample_no, w, min(i) AS i FROM i GROUP BY ALL)
SELECT sample_no, trim(string_agg(w, ' ' ORDER BY i)) AS deduped FROM f GROUP BY sample_no""",
    "ngrams_2": _grams(2),
    "ngrams_5": _grams(5),
    "gram_combinations": _RUN_OR_ALL,
    "direct_label_match": f"WITH {_LABELS} SELECT value, term_id, label FROM typed JOIN labels USING (std)",
    "permutation_match": f"WITH {_LABELS} SELECT value, p.term_id FROM typed t JOIN perms p ON p.key = {_key('t.std')}",
    "synonym_match": f"WITH {_LABELS} SELECT value, term_id, status FROM typed JOIN synm ON typed.std = synm.text",
    "suffix_match": f"WITH {_LABELS}, stems AS (SELECT value, regexp_replace(std, ' [^ ]+$', '') AS stem FROM typed) {_cascade('stems', 'stem')}",
    "lexicon_last_wins": """WITH r AS (SELECT kind || ':' || lower(trim(lex_key)) AS key, coalesce(lower(trim(lex_value)), '') AS val, pos FROM lexicon)
SELECT key, arg_max(val, pos) AS val, min(pos) AS pos FROM r GROUP BY key""",
    "lookup_merge": "SELECT kind, lower(trim(lex_key)) AS key, arg_max(coalesce(lower(trim(lex_value)), ''), pos) AS val FROM lexicon GROUP BY 1, 2",
    "retained_components": f"""WITH r AS ({_COMPONENTS}),
x AS (SELECT result_id, c[i] AS x, i FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM r)),
s AS (SELECT result_id, trim(substr(x, 1, strpos(x, ':') - 1), ' \t\n\r') AS label, arg_max(trim(substr(x, strpos(x, ':') + 1), ' \t\n\r'), i) AS id FROM x GROUP BY 1, 2),
k AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.result_id = a.result_id AND o.label <> a.label
  AND len(list_filter(string_split(a.label, ' '), lambda p: NOT contains(o.label, p))) = 0)),
g AS (SELECT result_id, array_to_string(list_sort(list_distinct(list(label || ':' || id))), '; ') AS retained FROM k GROUP BY 1)
SELECT result_id, CASE WHEN r.c IS NULL THEN NULL ELSE coalesce(g.retained, '') END AS retained FROM r LEFT JOIN g USING (result_id)""",
    "standard_components": f"""WITH r AS ({_COMPONENTS}), x AS (SELECT result_id, c[i] AS x, (i - 1)::INT AS pos FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM r))
SELECT result_id, pos, split_part(x, ':', 1) || ':' || upper(split_part(x, ':', 2)) AS component FROM x""",
    "final_buckets": f"""WITH RECURSIVE {_PATH_ROWS}, bk AS (SELECT * FROM {_values(BUCKETS)} t(term_id, label, pos)),
s AS (SELECT node, path, unnest(generate_series(1, len(steps))) AS level, steps FROM whole)
SELECT node, path, min(level)::INT AS level, arg_min(bk.label, level) AS bucket_label FROM s JOIN bk ON bk.term_id = steps[level] GROUP BY node, path""",
    "default_classification": f"WITH {_PHRASE_HITS} SELECT sample_no, phrase, label FROM b",
    "decoded_labels": f"WITH {_PHRASE_HITS} SELECT sample_no, array_to_string(list_sort(string_split(label, ';')), '|') AS labels FROM b",
    "label_priority": f"""WITH t AS (SELECT term_id, list_sort(list_distinct(string_split({_punct('label')}, ' '))) AS a FROM terms),
p AS (SELECT *, list_sort(list_filter(a, lambda x: x IN ('swab', 'frozen')))[1] AS p FROM t)
SELECT term_id, array_to_string(CASE WHEN p IS NULL THEN a ELSE list_concat([p], list_filter(a, lambda x: x <> p)) END, '|') AS ordered FROM p""",
    "label_reorder": f"""WITH t AS (SELECT term_id, string_split({_punct('label')}, ' ') AS w FROM terms),
x AS (SELECT term_id, w[i] AS w, i FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM t)),
y AS (SELECT term_id, w, min(i) AS i FROM x GROUP BY ALL)
SELECT term_id, string_agg(w, '|' ORDER BY CASE w WHEN 'swab' THEN -4 WHEN 'juice' THEN -3 WHEN 'frozen' THEN -2 WHEN 'smoked' THEN -1 ELSE i END) AS ordered FROM y GROUP BY term_id""",
    "label_rules": f"""WITH t AS (SELECT term_id, {_punct('label')} AS t, list_distinct(string_split({_punct('label')}, ' ')) AS a FROM terms),
r1 AS (SELECT term_id, t, CASE WHEN list_contains(a, 'swab') THEN list_append(list_filter(a, lambda x: x <> 'swab'), 'environmental') ELSE a END AS a FROM t),
r2 AS (SELECT term_id, t, CASE WHEN list_has_any(a, ['salmon', 'trout']) THEN list_append(a, 'fish') ELSE a END AS a FROM r1),
r3 AS (SELECT term_id, t, CASE WHEN list_contains(a, 'fish') AND contains(t, 'smoked') THEN list_filter(a, lambda x: x <> 'salmon') ELSE a END AS a FROM r2),
r4 AS (SELECT term_id, CASE WHEN len(a) >= 4 THEN list_append(a, 'multi-ingredient') ELSE a END AS a FROM r3)
SELECT term_id, array_to_string(list_sort(a), '|') AS labels FROM r4""",
    "compact_ids": """WITH x AS (SELECT term_id, split_part(term_id, '_', 1) || ':' || split_part(term_id, '_', 2) AS c, length(label) % 4 AS k FROM terms)
SELECT term_id, CASE WHEN k = 3 THEN 'urn:x:' || term_id WHEN k IS NULL THEN 'urn:x:' || term_id ELSE c END AS curie, lower(replace(CASE WHEN k = 3 OR k IS NULL THEN 'urn:x:' || term_id ELSE c END, ':', '_')) AS lookup_id FROM x""",
    "confidence_score": """WITH x AS (SELECT result_id, matched_components AS m, lower(coalesce(sample, '')) AS t, coalesce(list_filter(matched_components, lambda c: c IS NOT NULL), []) AS c FROM match_results),
y AS (SELECT *, CASE WHEN contains(t, '#') THEN 5 ELSE 0 END + CASE WHEN t LIKE '%s' THEN 3 ELSE 0 END + CASE WHEN contains(t, ' ') THEN 6 ELSE 0 END + CASE WHEN contains(t, 'lot') THEN 3 ELSE 0 END AS penalty,
  list_filter(string_split(t, ' '), lambda w: w <> '' AND len(list_filter(c, lambda k: contains(lower(k), w))) = 0) AS u FROM x),
z AS (SELECT result_id, CASE WHEN m IS NULL THEN 0 WHEN len(c) = 0 THEN 100 - penalty ELSE 90 - penalty - 6 * len(u) - 10 * len(list_filter(u, lambda w: w LIKE '%s')) END AS score FROM y)
SELECT result_id, CASE WHEN score > 89 THEN 'Highest' WHEN score > 79 THEN 'High' WHEN score > 69 THEN 'Moderately High' WHEN score > 59 THEN 'Medium' ELSE 'Low' END || ' (' || score || '%)' AS confidence FROM z""",
    "json_props": "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events",
}

_NEAREST = f"""{_PATH_ROWS}, bk AS (SELECT * FROM {_values(BUCKETS)} t(term_id, label, pos)), bc AS (SELECT * FROM {_values(BUCKET_CLASSES)} t(term_id, label)),
s AS (SELECT node, path, unnest(generate_series(1, len(steps))) AS level, steps FROM whole),
nb AS (SELECT node, path, arg_min(bk.term_id, level) AS term_id, arg_min(bk.label, level) AS label FROM s JOIN bk ON bk.term_id = steps[level] GROUP BY node, path)"""
ORACLE["bucket_labels"] = f"""WITH RECURSIVE {_NEAREST}, x AS (SELECT DISTINCT node, unnest(string_split(bc.label, ';')) AS c FROM nb JOIN bc USING (term_id))
SELECT node, string_agg(c, '|' ORDER BY c) AS classes FROM x GROUP BY node"""


def _refining(rows: str, key: str) -> str:
    """First refining phrase of each row of ``rows(key, t)``."""
    words = _WORDS_OF.format(c="t")
    return f"""rf AS (SELECT * FROM {_values(REFINING)} t(phrase, label, pos)),
rh AS (SELECT {key}, phrase, label, pos FROM {rows}, rf WHERE len(list_filter(string_split(phrase, ' '), lambda p: NOT list_contains({words}, p))) = 0 OR regexp_matches(t, '\\b' || phrase || '\\b')),
rb AS (SELECT {key}, arg_min(phrase, pos) AS phrase, arg_min(label, pos) AS label FROM rh GROUP BY {key})"""


ORACLE["refining_classification"] = f"""WITH st AS (SELECT sample_no, {_punct('sample')} AS t FROM texts), {_refining('st', 'sample_no')}
SELECT sample_no, phrase, label FROM rb"""
ORACLE["classified_nodes"] = f"""WITH RECURSIVE {_NEAREST},
st AS (SELECT row_no, replace(lower(trim(id)), ':', '_') AS node, {_punct('label')} AS t FROM ontology_specs WHERE label IS NOT NULL AND trim(id) <> ''),
{_refining('st', 'row_no')},
hb AS (SELECT node, term_id, label, min(path) AS path FROM nb GROUP BY ALL),
hs AS (SELECT node, list('{{''' || term_id || ''': ''' || label || '''}}' ORDER BY path) AS shown FROM hb GROUP BY node),
hl AS (SELECT node, list_sort(list_distinct(list(c))) AS labels FROM (SELECT node, unnest(string_split(bc.label, ';')) AS c FROM hb JOIN bc USING (term_id)) GROUP BY node),
w AS (SELECT DISTINCT row_no, {_singular('x')} AS word FROM (SELECT row_no, unnest({_WORDS_OF.format(c='t')}) AS x FROM st)),
ph AS (SELECT * FROM {_values(DEFAULTS)} t(phrase, label, pos)),
pw AS (SELECT DISTINCT phrase, label, pos, {_singular('x')} AS word FROM (SELECT *, unnest(string_split(phrase, ' ')) AS x FROM ph)),
pn AS (SELECT phrase, count(*) AS n FROM pw GROUP BY phrase),
hc AS (SELECT row_no, phrase, label, pos, count(*) AS m FROM w JOIN pw USING (word) GROUP BY ALL),
db AS (SELECT row_no, arg_max(hc.label, pos) AS label FROM hc JOIN pn USING (phrase) WHERE m = pn.n GROUP BY row_no),
l0 AS (SELECT st.row_no, st.t, coalesce(hl.labels, []) AS a, db.label AS dl, rb.label AS rl, coalesce(hs.shown, []) AS shown FROM st LEFT JOIN hl USING (node) LEFT JOIN hs USING (node) LEFT JOIN db USING (row_no) LEFT JOIN rb USING (row_no)),
l1 AS (SELECT *, (len(a) = 0 OR a = ['food']) AND dl IS NOT NULL AS bare FROM l0),
l2 AS (SELECT *, list_distinct(list_concat(a, CASE WHEN bare THEN [dl] ELSE [] END, CASE WHEN rl IS NOT NULL THEN [rl] ELSE [] END)) AS b FROM l1),
r1 AS (SELECT *, CASE WHEN list_has_all(b, ['food', 'plants']) THEN list_filter(b, lambda x: x <> 'food') ELSE b END AS b1 FROM l2),
r2 AS (SELECT *, CASE WHEN list_has_any(b1, ['poultry', 'fish']) AND NOT list_contains(b1, 'plants') THEN list_append(b1, 'meat') ELSE b1 END AS b2 FROM r1),
r3 AS (SELECT *, CASE WHEN len(b2) >= 3 AND list_contains({_WORDS_OF.format(c='t')}, 'roe') THEN list_filter(b2, lambda x: x IN ('eggs of fish', 'food')) ELSE b2 END AS b3 FROM r2),
pr AS (SELECT *, list_sort(list_filter(b3, lambda x: x IN ('swab', 'frozen')))[1] AS first FROM r3)
SELECT row_no, array_to_string(CASE WHEN first IS NULL THEN list_sort(b3) ELSE list_concat([first], list_sort(list_filter(b3, lambda x: x <> first))) END, '|') AS classes,
  '[' || array_to_string(list_concat(shown, CASE WHEN bare THEN ['''Default classification'''] ELSE [] END), ', ') || ']' AS third_buckets FROM pr"""
ORACLE["ancestor_filter"] = f"""WITH RECURSIVE {_ANCESTORS},
g AS (SELECT DISTINCT lower(ontology) || '/' || strftime(released_at, '%Y-%m-%d') || '/' || regexp_extract(lower(label), '(\\S+)\\s*$', 1) AS grp, lower(label) AS term, replace(lower(trim(id)), ':', '_') AS node
  FROM ontology_specs WHERE label IS NOT NULL AND trim(id) <> ''),
gone AS (SELECT DISTINCT g.grp, m.ancestor FROM g JOIN m USING (node) WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.node = m.ancestor AND b.ancestor = m.node))
SELECT g.grp, g.node, g.term FROM g WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.grp = g.grp AND gone.ancestor = g.node)"""


def _shown(x: str) -> str:
    """A text as Python shows it."""
    return f"""CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || replace({x}, '\\', '\\\\') || '"' ELSE '''' || replace(replace({x}, '\\', '\\\\'), '''', '\\''') || '''' END"""


_TYPED_WORDS = _WORDS_OF.format(c="regexp_replace(std, '''s( |$)', ' ''s\\1', 'g')")
# The cleaning fold, one token a step.
_CLEAN = f"""{_LABELS},
abbr AS (SELECT key, val FROM lw WHERE kind = 'abbreviation' AND key <> ''), frn AS (SELECT key, val FROM lw WHERE kind = 'non_english' AND key <> ''), stops AS (SELECT key FROM lw WHERE kind = 'stopword' AND key <> ''),
tk AS (SELECT value, list_filter({_TYPED_WORDS}, lambda x: x <> '' AND NOT regexp_matches(x, '{T.NUMBER}') AND NOT regexp_matches(x, '{T.DATE}')) AS t FROM typed),
t0 AS (SELECT value, i, regexp_replace(regexp_replace(replace(t[i], '''s', ''), '['', ]+$', ''), '[. ]+$', '') AS token FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM tk)),
t1 AS (SELECT *, CASE WHEN regexp_matches(token, '(?:us|ia|ta)$') THEN token ELSE {_singular('token')} END AS l1 FROM t0),
t2 AS (SELECT t1.*, coalesce(a.val, l1) AS l2, a.val AS av FROM t1 LEFT JOIN abbr a ON a.key = l1),
steps AS (SELECT value, i, token, coalesce(f.val, l2) AS lemma, list_concat(CASE WHEN token <> l1 THEN ['Inflection (Plural) Treatment: ' || token] ELSE [] END,
    CASE WHEN av IS NOT NULL THEN ['Abbreviation-Acronym Treatment: ' || av] ELSE [] END, CASE WHEN f.val IS NOT NULL THEN ['Non English Language Words Treatment: ' || f.val] ELSE [] END) AS log FROM t2 LEFT JOIN frn f ON f.key = l2),
fold AS (
  SELECT value, 0::BIGINT AS i, '' AS clean, []::VARCHAR[] AS micro FROM typed
  UNION ALL
  SELECT value, i, coalesce(f.val, c1) AS clean, list_concat(micro, log, CASE WHEN av IS NOT NULL THEN ['Abbreviation-Acronym Treatment: ' || av] ELSE [] END, CASE WHEN f.val IS NOT NULL THEN ['Non English Language Words Treatment: ' || f.val] ELSE [] END) AS micro
  FROM (SELECT y.*, coalesce(a.val, x) AS c1, a.val AS av
    FROM (SELECT fold.value, steps.i, fold.micro, steps.log, regexp_replace(CASE WHEN stops.key IS NOT NULL THEN clean WHEN clean = '' THEN lemma ELSE clean || ' ' || lemma END, ' +', ' ', 'g') AS x
      FROM fold JOIN steps ON steps.value = fold.value AND steps.i = fold.i + 1 LEFT JOIN stops ON stops.key = steps.lemma) y LEFT JOIN abbr a ON a.key = y.x) z LEFT JOIN frn f ON f.key = z.c1),
done AS (SELECT value, arg_max(clean, i) AS clean, arg_max(micro, i) AS micro FROM fold GROUP BY value),
cw AS (SELECT value, w, min(i) AS i FROM (SELECT value, w[i] AS w, i FROM (SELECT value, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT value, string_split(clean, ' ') AS w FROM done))) GROUP BY value, w),
cleaned AS (SELECT value, trim(string_agg(w, ' ' ORDER BY i)) AS cleaned FROM cw GROUP BY value),
changes AS (SELECT value, token, min(i) AS i, arg_max(lemma, i) AS lemma FROM steps WHERE token <> lemma GROUP BY value, token),
shown AS (SELECT value, '{{' || string_agg({_shown('token')} || ': ' || {_shown('lemma')}, ', ' ORDER BY i) || '}}' AS shown FROM changes GROUP BY value)"""
ORACLE["clean_fold"] = f"""WITH RECURSIVE {_CLEAN}
SELECT done.value AS sample_desc, cleaned, array_to_string(micro, '; ') AS treatments, coalesce(shown, '{{}}') AS transformations FROM done JOIN cleaned USING (value) LEFT JOIN shown USING (value)"""

ORACLE["full_term_cascade"] = f"""WITH RECURSIVE {_CLEAN}, v AS (SELECT value, std AS sample, cleaned FROM typed JOIN cleaned USING (value)), _FULL_
SELECT value, stage, term_id, status FROM full_match"""
_FULL = f"""m1 AS ({_plainly('v', 'sample')}), m2 AS ({_plainly('v', 'cleaned')}), m3 AS ({_cascade('v', 'sample')}), m4 AS ({_cascade('v', 'cleaned')}),
u AS (SELECT 1 AS stage, * FROM m1 UNION ALL SELECT 2, * FROM m2 UNION ALL SELECT 3, * FROM m3 UNION ALL SELECT 4, * FROM m4),
full_match AS (SELECT value, min(stage) AS stage, arg_min(term_id, stage) AS term_id, arg_min(status, stage) AS status FROM u GROUP BY value)"""
ORACLE["full_term_cascade"] = ORACLE["full_term_cascade"].replace("_FULL_", _FULL)
# All that a gram can match, by its sorted tokens and, for what is matched in one order only, its text.
_MATCHES = f"""
sx AS (SELECT * FROM (VALUES {_SFX}) t(sp, s)),
pl AS (SELECT key, arg_max(term_id, pos) AS term_id, arg_max(label, pos) AS label FROM labels WHERE len(string_split(std, ' ')) < 7 AND NOT contains(term_id, 'ncbitaxon') GROUP BY key),
ex AS (SELECT std AS text, false AS sfx, -1 AS sp, label, term_id FROM labels
  UNION ALL SELECT substr(std, 1, length(std) - length(s) - 1), true, sp, label, term_id FROM labels, sx WHERE ends_with(std, ' ' || s)),
pk AS (SELECT string_split(key, ' ') AS k, label, term_id FROM pl),
pe AS (SELECT array_to_string(k, ' ') AS key, false AS sfx, -1 AS sp, label, term_id FROM pk
  UNION ALL SELECT array_to_string(list_concat(k[1:list_position(k, s) - 1], k[list_position(k, s) + 1:]), ' '), true, sp, label, term_id FROM pk, sx WHERE list_contains(k, s) AND len(k) > 1),
sm AS (SELECT syn, sfx, sp, perm, label, term_id, row_number() OVER (PARTITION BY syn, sfx ORDER BY sp, perm, label, term_id) AS n FROM (
  SELECT syn, sfx, sp, false AS perm, label, term_id FROM syn JOIN ex ON ex.text = syn.std UNION ALL SELECT syn, sfx, sp, true, label, term_id FROM syn JOIN pe ON pe.key = {_key('syn.std')})),
mt AS (SELECT {_key('text')} AS key, text, sfx, false AS via, sp, false AS perm, label, term_id FROM ex
  UNION ALL SELECT key, NULL, sfx, false, sp, true, label, term_id FROM pe
  UNION ALL SELECT {_key('syn')}, syn, sfx, true, sp, perm, label, term_id FROM sm WHERE n = 1),
vocab AS (SELECT DISTINCT unnest(string_split(key, ' ')) AS w FROM mt)"""
_COVER = f"""
rest AS (SELECT DISTINCT cleaned FROM v WHERE value NOT IN (SELECT value FROM full_match) AND cleaned <> ''),
rt AS (SELECT cleaned, t[i] AS w, i AS pos, len(t) AS size FROM (SELECT cleaned, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT cleaned, string_split(cleaned, ' ') AS t FROM rest))),
kt AS (SELECT * FROM rt WHERE w IN (SELECT w FROM vocab)),
gram AS (SELECT cleaned, size, [pos] AS p, [w] AS g FROM kt
  UNION ALL SELECT gram.cleaned, gram.size, list_append(p, kt.pos), list_append(g, kt.w) FROM gram JOIN kt ON kt.cleaned = gram.cleaned AND kt.pos > p[-1] AND len(p) < 5 AND (gram.size < {T.COMBINATION_TOKENS} OR kt.pos = p[-1] + 1)),
hit AS (SELECT cleaned, p, g, label, term_id, list_concat(CASE WHEN via THEN ['Synonym Usage'] ELSE [] END, CASE WHEN sfx THEN ['Suffix Addition'] ELSE [] END, [CASE WHEN perm THEN 'Permutation of Tokens in Resource Term' ELSE 'A Direct Match' END]) AS status,
    row_number() OVER (PARTITION BY cleaned, p ORDER BY CASE WHEN text IS NULL THEN generate_series(1, len(g)) ELSE list_transform(string_split(text, ' '), lambda w: list_position(g, w)::BIGINT) END, sfx, via, sp, perm) AS n
  FROM gram JOIN mt ON mt.key = array_to_string(list_sort(g), ' ')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY cleaned ORDER BY -len(p), p) AS i FROM hit WHERE n = 1),
cover AS (SELECT cleaned, 0::BIGINT AS i, []::VARCHAR[] AS seen, []::STRUCT(label VARCHAR, id VARCHAR, status VARCHAR[])[] AS found FROM rest
  UNION ALL SELECT cover.cleaned, o.i, list_distinct(list_concat(seen, g)), CASE WHEN list_has_all(seen, g) THEN found ELSE list_append(found, {{'label': label, 'id': term_id, 'status': status}}) END
  FROM cover JOIN ordered o ON o.cleaned = cover.cleaned AND o.i = cover.i + 1),
parts AS (SELECT cleaned, arg_max(found, i) AS found FROM cover GROUP BY cleaned),
pc AS (SELECT cleaned, f.label AS label, f.id AS id, i FROM (SELECT cleaned, found[i] AS f, i FROM (SELECT cleaned, found, unnest(generate_series(1, len(found))) AS i FROM parts))),
lb AS (SELECT cleaned, label, arg_max(id, i) AS id FROM pc GROUP BY cleaned, label),
kl AS (SELECT * FROM lb a WHERE NOT EXISTS (SELECT 1 FROM lb o WHERE o.cleaned = a.cleaned AND o.label <> a.label AND len(list_filter(string_split(a.label, ' '), lambda x: NOT contains(o.label, x))) = 0)),
raw AS (SELECT cleaned, list_sort(list(label || ':' || id)) AS raw FROM kl GROUP BY cleaned),
notes AS (SELECT cleaned, list('{{' || label || ': [' || array_to_string(list_transform(status, lambda s: '''' || s || ''''), ', ') || ']}}' ORDER BY i) AS notes
  FROM (SELECT cleaned, f.label AS label, f.id AS id, arg_min(f.status, i) AS status, min(i) AS i FROM (SELECT cleaned, found[i] AS f, i FROM (SELECT cleaned, found, unnest(generate_series(1, len(found))) AS i FROM parts)) GROUP BY cleaned, f.label, f.id) x JOIN raw USING (cleaned)
  WHERE list_contains(raw.raw, label || ':' || id) GROUP BY cleaned),
fl AS (SELECT m.*, l.label FROM full_match m JOIN labels l ON l.term_id = m.term_id)"""
ORACLE["component_match"] = f"""WITH RECURSIVE {_CLEAN}, v AS (SELECT value, std AS sample, cleaned FROM typed JOIN cleaned USING (value)), {_FULL}, {_MATCHES}, {_COVER},
j AS (SELECT v.value, v.cleaned, fl.term_id IS NOT NULL AS is_full, CASE WHEN fl.term_id IS NOT NULL THEN [fl.label || ':' || fl.term_id] ELSE coalesce(raw.raw, []) END AS raw,
    CASE WHEN fl.term_id IS NOT NULL THEN list_concat(CASE WHEN fl.stage IN (2, 4) THEN ['Used Cleaned Sample'] ELSE [] END, done.micro, string_split(fl.status, '; ')) ELSE list_concat(done.micro, coalesce(notes.notes, [])) END AS micro
  FROM v JOIN done USING (value) LEFT JOIN fl USING (value) LEFT JOIN raw ON raw.cleaned = v.cleaned LEFT JOIN notes ON notes.cleaned = v.cleaned)
SELECT value AS sample_desc, cleaned, array_to_string(list_transform(raw, lambda c: split_part(c, ':', 1) || ':' || upper(split_part(c, ':', 2))), '; ') AS matched,
  CASE WHEN is_full THEN 'Full Term Match' WHEN len(raw) > 0 THEN 'Component Match' ELSE 'No Match' END AS macro,
  '[' || array_to_string(list_transform(micro, lambda x: {_shown('x')}), ', ') || ']' AS micro FROM j"""


# Each sample with the text of all its columns.
_TEXTS = "texts AS (SELECT sample_no, concat_ws(' ', sample, sample_2, sample_3) AS sample FROM samples WHERE trim(concat_ws(' ', sample, sample_2, sample_3)) <> '')"
for _name, _sql in ORACLE.items():
    if "FROM texts" in _sql:
        ORACLE[_name] = f"WITH {_TEXTS}, {_sql.removeprefix('WITH ')}" if _sql.startswith("WITH ") else f"WITH {_TEXTS} {_sql}"
