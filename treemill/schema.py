"""Spark types of the corpus tables; every table is keyed by (level, sent_id)."""

TOKENS = "level int, sent_id long, idx int, form string, lemma string, pos string, sense string, src_begin long, src_end long, extra map<string,string>"
DEPS = "level int, sent_id long, layer string, dep_ord int, gov int, head int, label string, score float, gov_group int, head_group int, constrained boolean"
GROUPS = "level int, sent_id long, grp_ord int, name string, first_idx int, last_idx int"
SENTENCES = "level int, sent_id long, text string, comment string, conf float, source string"
