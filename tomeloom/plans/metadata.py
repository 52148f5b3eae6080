"""Queries over titles, years, tags and model replies, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeloom.functions import text as T
from tomeloom.operators import metadata as M
from tomeloom.operators import replies as R
from tomeloom.operators.mining import ALL_LISTS
from tomeloom.plans.corpus import table
from tomeloom.plans.library import _fold_sql
from tomeloom.plans.terms import _list


def book_titles(spark, sf_dir):
    """FN17: parts as books, whose file titles are partly names of files and of tools."""
    part = table(spark, sf_dir, "part")
    own = F.when(F.col("p_size") < 10, "p").when(F.col("p_size") < 20, F.concat("p_name", F.lit(".pdf"))).when(F.col("p_size") < 30, F.concat(F.lit("Microsoft Word - "), "p_name")).when(F.col("p_size") < 40, F.concat("p_name", F.lit("  \t of "), "p_type"))
    books = part.select(F.col("p_partkey").alias("book_key"), own.alias("title"), F.concat(F.lit("/lib/"), "p_brand", F.lit("/"), "p_name", F.lit(".v2.pdf")).alias("path"))
    li = table(spark, sf_dir, "lineitem")
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string"))
    paragraphs = li.select(F.col("l_partkey").alias("book_key"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("idx"), text.alias("text"), F.when(F.col("l_returnflag") == "R", "other").otherwise("prose").alias("kind"), F.col("l_quantity").alias("fh"))
    return M.titles(books, paragraphs)


def publication_years(spark, sf_dir):
    """FN18: years out of copyright lines, descriptions and dates of making."""
    part = table(spark, sf_dir, "part")
    front = F.when(F.col("p_size") < 20, F.concat(F.lit("Text\nCopyright "), "p_brand", F.lit(", "), (F.col("p_size") * 40 + 1300).cast("string")))
    title = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" "), (F.col("p_size") * 5 + 1850).cast("string")))
    created = F.concat(F.lit("D:"), (F.col("p_partkey") % 700 + 1450).cast("string"), F.lit("0101"))
    year = M.publication_year(front, F.col("p_type"), title, F.col("p_type"), F.lit(None).cast("string"), created, 2026)
    return part.select("p_partkey", year.alias("year"))


def _keywords():
    return F.concat(F.lit("Keywords: "), "p_name", F.lit("; "), F.initcap("p_name"), F.lit("s,Publisher: "), "p_type", F.lit("; "), "p_type", F.lit(" Press\n"), "p_brand", F.lit("; Society of "), "p_brand", F.lit("; the and of; doi 10.1000/1, see http://a.b/c; one two three four five six;"), "p_type")


def subject_tags(spark, sf_dir):
    """FN19, WIN10: subject terms of keyword lists."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(M.tags(_keywords())).alias("place", "tag"))
    return part


def reply_gates(spark, sf_dir):
    """FN25: turns as replies: whether they would be refused, and the gloss or translation they give."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    term = F.lit("x")
    tr = R.clean_translation(F.col("text"), term)
    return c.select(
        "conv_id", "turn", R.reply_rejected(F.col("text"), 1, 100, "en", needs_sep=False).alias("rejected"), R.clean_gloss(F.col("text"), term, "en").alias("gloss"),
        tr.alias("tr"), (R.plausible(tr, term) & ~R.junky(tr, term, F.lit("a word x of it"))).alias("passes"), R.keep_as_is(F.col("text")).alias("kept"),
    ).distinct()


def _replies(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("topic", "Term", "person", "place", "gadget")]), (F.pmod("p_size", F.lit(5)) + 1).cast("int"))
    line = F.concat(F.lit("- "), F.upper("p_name"), F.lit("s :: "), kind, F.lit(" :: It is a "), "p_type", F.lit(" thing. And more."))
    verdicts = F.concat(F.lit("1) "), "p_name", F.lit(" :: "), F.when(F.col("p_size") < 20, "Yes, so it is").when(F.col("p_size") < 40, "no").otherwise("nothing"))
    order = F.struct("p_partkey", line.alias("l"), verdicts.alias("v"))
    rows = part.groupBy(F.col("p_brand").alias("book_key"), F.col("p_type").alias("batch")).agg(F.array_sort(F.collect_list(order)).alias("r"))
    return part.select(F.col("p_brand").alias("book_key"), F.col("p_name").alias("term")).distinct(), rows


def typed_replies(spark, sf_dir):
    """FN26, FN23, JN05: kinds and glosses out of reply lines (rows only: which line is first is a
    matter of how replies are dealt, settled by the line's number)."""
    asked, rows = _replies(spark, sf_dir)
    one = rows.groupBy("book_key").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", "r"))), lambda b: F.transform(b["r"], lambda x: x["l"]))), "\n").alias("reply"))
    return R.parse_typed(asked, one, "en")


def reply_verdicts(spark, sf_dir):
    """FN26: verdicts out of reply lines; the first line with one counts."""
    asked, rows = _replies(spark, sf_dir)
    one = rows.groupBy("book_key").agg(F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("r"))), lambda x: x["v"]), "\n").alias("reply"))
    return R.parse_verdicts(asked, one)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_WS = T.WS


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, {_lit(_WS + '+')}, ' ', 'g'))"


def _junk(c: str, patterns) -> str:
    return " OR ".join(f"regexp_matches({c}, {_lit(p)})" for p in patterns)


_FUNC = _list(ALL_LISTS.func)
ORACLE = {
    "book_titles": rf"""WITH b AS (SELECT p_partkey AS book_key, p_name, p_brand, {_flat("CASE WHEN p_size < 10 THEN 'p' WHEN p_size < 20 THEN p_name || '.pdf' WHEN p_size < 30 THEN 'Microsoft Word - ' || p_name WHEN p_size < 40 THEN p_name || '  ' || chr(9) || ' of ' || p_type END")} AS s FROM part),
h AS (SELECT l_partkey AS book_key, arg_max(concat_ws(' ', l_returnflag, l_linestatus, l_orderkey), (l_quantity, -l_orderkey)) AS head FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R' GROUP BY ALL)
SELECT book_key, coalesce(CASE WHEN length(s) BETWEEN 3 AND 200 AND regexp_matches(s, '\p{{L}}') AND NOT ({_junk('s', (M.TITLE_FILE, M.TITLE_JUNK, M.TITLE_CLASS))}) THEN s END, left(head, 200), p_name || '.v2') AS title
FROM b LEFT JOIN h USING (book_key)""",
    "publication_years": rf"""WITH p AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN 'Text' || chr(10) || 'Copyright ' || p_brand || ', ' || (p_size * 40 + 1300) ELSE '' END || chr(10) || p_type AS t,
  CASE WHEN p_size % 3 = 0 THEN p_name || ' ' || (p_size * 5 + 1850) ELSE '' END || ' ' || p_type AS bib, 'D:' || (p_partkey % 700 + 1450) || '0101' AS made FROM part),
y AS (SELECT p_partkey, TRY_CAST(regexp_extract(t, {_lit(M.COPYRIGHT_YEAR)}, 1) AS INT) AS a, TRY_CAST(regexp_extract(bib, {_lit(M.YEAR)}) AS INT) AS b, TRY_CAST(regexp_extract(made, {_lit(M.MADE_YEAR)}, 1) AS INT) AS c FROM p)
SELECT p_partkey, coalesce(CASE WHEN a <= 2026 THEN a END, CASE WHEN b <= 2026 THEN b END, CASE WHEN c <= 2026 THEN c END) AS year FROM y""",
    "subject_tags": rf"""WITH k AS (SELECT p_partkey, 'Keywords: ' || p_name || '; ' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') || 's,Publisher: ' || p_type || '; ' || p_type || ' Press' || chr(10) || p_brand || '; Society of ' || p_brand || '; the and of; doi 10.1000/1, see http://a.b/c; one two three four five six;' || p_type AS raw FROM part),
e AS (SELECT p_partkey, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM (SELECT p_partkey, regexp_split_to_array(raw, {_lit(M.TAG_SPLIT)}) AS a FROM k)),
s AS (SELECT p_partkey, i, trim(regexp_replace(regexp_replace({_flat('piece')}, '^[-•* ]+', ''), {_lit(M.TAG_LABEL)}, '')) AS s FROM e),
g AS (SELECT p_partkey, i, s, trim(regexp_replace(replace(lower(s), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm, length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) AS letters FROM s
  WHERE length(s) BETWEEN 2 AND 40 AND len(string_split(s, ' ')) <= 5 AND NOT ({_junk('s', M.TAG_JUNK)})),
o AS (SELECT * FROM g WHERE letters > 0 AND letters >= 0.6 * length(replace(s, ' ', ''))
  AND len(list_filter(string_split(s, ' '), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]', '', 'g') NOT IN ({_FUNC}))) > 0),
t AS (SELECT *, string_split(norm, ' ') AS toks FROM o),
l AS (SELECT *, toks[len(toks)] AS w FROM t),
c AS (SELECT *, array_to_string(list_append(toks[1:len(toks) - 1], {_fold_sql('w')}), ' ') AS key FROM l),
f AS (SELECT p_partkey, min(i) AS i, arg_min(s, i) AS tag FROM c GROUP BY p_partkey, key)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INT) AS place, tag FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY i) <= 12""",
    "reply_gates": rf"""WITH c AS (SELECT conv_id, turn, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS r, {_flat("string_split(text, chr(10))[1]")} AS g0,
  {_flat("string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1]")} AS t0 FROM conversations WHERE text IS NOT NULL),
d AS (SELECT *, coalesce(nullif(trim(regexp_extract(g0, {_lit(R.QUOTED)}, 1)), ''), g0) AS g1, coalesce(nullif(trim(regexp_extract(t0, {_lit(R.QUOTED)}, 1)), ''), t0) AS t1 FROM c),
e AS (SELECT *, trim(regexp_replace(g1, '^[-–—:•* ]+', '')) AS g2, trim(regexp_replace(trim(regexp_replace(t1, '。$', '')), '\.$', '')) AS tr FROM d),
f AS (SELECT *, CASE WHEN regexp_matches(g2, {_lit(R.SENTENCE_END)}) THEN length(regexp_extract(g2, '^((?s:.)*?)(?:[.!?](?:\s|$))', 1)) + 1 ELSE 0 END AS stop FROM e),
h AS (SELECT *, trim(CASE WHEN stop > 21 THEN left(g2, stop) ELSE g2 END) AS g FROM f),
n AS (SELECT *, length(regexp_replace(g, '{R.CJK}', '', 'g')) AS gl, length(regexp_replace(r, '{R.CJK}', '', 'g')) AS rl FROM h)
SELECT DISTINCT conv_id, turn, r = '' OR length(r) > 500 OR (length(r) - rl) * 20 > length(r) OR NOT regexp_matches(r, '[A-Za-z]') AS rejected,
  CASE WHEN g <> '' AND length(g) <= 160 AND (length(g) - gl) * 20 <= length(g) AND regexp_matches(g, '[A-Za-z]') AND NOT contains(g, '::') AND trim(regexp_replace(lower(g), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) <> 'x' THEN g END AS gloss,
  tr, tr <> '' AND len(list_filter(regexp_split_to_array(tr, '\s+'), lambda w: w <> '')) <= 4 AND length(tr) <= 60 AND NOT contains(tr, '?') AND regexp_matches(tr, '[A-Za-zА-Яа-яЁё0-9]')
    AND NOT (length(tr) > 5 AND contains('a word x of it', lower(tr))) AS passes,
  regexp_matches(text, '^[A-Z0-9][A-Z0-9.+/&-]*$') AND regexp_matches(text, '[A-Z]') AS kept FROM n""",
    "reply_verdicts": """WITH t AS (SELECT DISTINCT p_brand AS book_key, p_name AS term FROM part)
SELECT book_key, term, size < 20 AS verdict FROM t JOIN (SELECT p_brand, p_name, arg_min(p_size, p_partkey) AS size FROM part WHERE p_size < 40 GROUP BY ALL) ON book_key = p_brand AND term = p_name""",
}
