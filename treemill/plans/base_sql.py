"""The treebank view of ``documents`` in DuckDB's SQL, for the oracles; see ``sources.adapter``."""

BASE = r"""
WITH RECURSIVE lists AS (SELECT doc_id, string_split_regex(text, '[ \t\n\r]+') AS l FROM documents),
words AS (SELECT doc_id AS doc, unnest(l) AS word, generate_subscripts(l, 1) AS k FROM lists),
parts AS (
  SELECT doc, k, 0 AS part, regexp_replace(word, '[,;:.?!"]+$', '') AS form FROM words WHERE word <> ''
  UNION ALL SELECT doc, k, 1, regexp_extract(word, '([,;:.?!"]+)$', 1) FROM words WHERE word <> ''
),
cut AS (
  SELECT *, coalesce(sum(CASE WHEN part = 1 AND regexp_matches(form, '[.?!]') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc ORDER BY k, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM parts WHERE form <> ''
),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc, s ORDER BY k, part) - 1 AS i FROM cut),
numbered AS MATERIALIZED (SELECT *, sum(CASE WHEN i % 40 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY s, k, part) - 1 AS n FROM counted),
tok AS MATERIALIZED (
  SELECT CAST(doc * 100000000 + n AS BIGINT) AS sent_id, CAST(i % 40 AS INTEGER) AS idx, form, lower(form) AS lemma,
    CASE WHEN regexp_matches(form, '^[,;:.?!"]+$') THEN 'PUN'
         WHEN regexp_matches(form, '[0-9]') THEN 'NUM'
         WHEN length(form) <= 2 THEN 'DET' WHEN length(form) = 3 THEN 'PRP'
         WHEN lower(form) LIKE '%ly' THEN 'ADV'
         WHEN regexp_matches(lower(form), '(ing|ed|er|en)$') THEN 'VER'
         WHEN regexp_matches(form, '^[A-Z]') THEN 'NAM'
         WHEN length(form) >= 8 THEN 'NOM' WHEN length(form) >= 6 THEN 'ADJ' WHEN length(form) = 5 THEN 'VER'
         ELSE 'NOM' END AS pos
  FROM numbered
),
near AS (
  SELECT sent_id, idx, pos,
    min(CASE WHEN pos IN ('NOM', 'NAM') THEN idx END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_noun,
    min(CASE WHEN pos IN ('NOM', 'NAM') THEN idx END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS near_noun,
    min(CASE WHEN pos = 'VER' THEN idx END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_verb,
    max(CASE WHEN pos = 'VER' THEN idx END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_verb,
    max(idx) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS last_word
  FROM tok WINDOW w AS (PARTITION BY sent_id ORDER BY idx)
),
headed AS (
  SELECT *, CASE WHEN pos = 'PUN' THEN last_word WHEN pos = 'DET' THEN next_noun WHEN pos IN ('PRP', 'ADJ', 'NUM') THEN next_noun
      WHEN pos = 'ADV' THEN next_verb WHEN pos IN ('NOM', 'NAM') THEN coalesce(next_verb, last_verb) ELSE last_verb END AS gold_head,
    CASE WHEN pos = 'PUN' THEN last_word WHEN pos = 'DET' THEN near_noun WHEN pos IN ('PRP', 'ADJ', 'NUM') THEN next_noun
      WHEN pos = 'ADV' THEN next_verb WHEN pos IN ('NOM', 'NAM') THEN coalesce(last_verb, next_verb) ELSE last_verb END AS sys_head
  FROM near
),
arcs AS MATERIALIZED (
  SELECT kind, sent_id, gov, head, CASE WHEN pos = 'PUN' THEN 'PONC' WHEN pos = 'DET' THEN 'DET' WHEN pos IN ('PRP', 'ADJ', 'NUM') THEN 'MOD'
      WHEN pos = 'ADV' THEN 'ADV' WHEN pos = 'VER' THEN 'COORD' WHEN head > gov THEN 'SUJ' ELSE 'OBJ' END AS label
  FROM (SELECT 'gold' AS kind, sent_id, idx AS gov, gold_head AS head, pos FROM headed UNION ALL SELECT 'sys', sent_id, idx, sys_head, pos FROM headed)
  WHERE head IS NOT NULL
),
gold AS MATERIALIZED (SELECT sent_id, gov, head, label FROM arcs WHERE kind = 'gold'),
sys AS MATERIALIZED (SELECT sent_id, gov, head, label FROM arcs WHERE kind = 'sys'),
lnk AS MATERIALIZED (
  SELECT t.sent_id, t.idx, t.form, t.lemma, t.pos, coalesce(g.head, -1) AS head, coalesce(g.label, 'ROOT') AS label, h.form AS head_form, h.lemma AS head_lemma, h.pos AS head_pos
  FROM tok t LEFT JOIN gold g ON g.sent_id = t.sent_id AND g.gov = t.idx LEFT JOIN tok h ON h.sent_id = t.sent_id AND h.idx = g.head
),
islands AS (SELECT sent_id, pos, idx, idx - row_number() OVER (PARTITION BY sent_id, pos ORDER BY idx) AS island FROM tok),
grp AS MATERIALIZED (SELECT sent_id, pos AS name, min(idx) AS first_idx, max(idx) AS last_idx FROM islands GROUP BY sent_id, pos, island),
up AS (
  SELECT sent_id, gov AS idx, head AS anc FROM gold
  UNION SELECT u.sent_id, u.idx, g.head FROM up u JOIN gold g ON g.sent_id = u.sent_id AND g.gov = u.anc
),
knot AS (
  SELECT sent_id, gov, head FROM gold UNION ALL SELECT r.sent_id, r.idx, min(g.gov) FROM lnk r JOIN gold g ON g.sent_id = r.sent_id AND g.head = r.idx WHERE r.head < 0 GROUP BY r.sent_id, r.idx
),
knotted AS (
  SELECT sent_id, gov AS idx, head AS anc FROM knot
  UNION SELECT u.sent_id, u.idx, k.head FROM knotted u JOIN knot k ON k.sent_id = u.sent_id AND k.gov = u.anc
)
"""


def sql(rest: str) -> str:
    return BASE + rest
