"""Text, dates, JSON, hashes, samples, grids and file round trips over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, inventory, text
from ..functions import patterns as P
from ..functions.patterns import GAP_DAYS
from ..operators import contracts, sampling
from ..sources import records
from .base import Registry, scratch, table
from .relational import events

query = Registry()


#: Sentences in SQL without look-behind: a mark is put where a sentence ends.
SENTENCES = "list_filter(str_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f\\v]'))"
#: Lines in SQL: cut at every line break, without the empty one after the last.
LINES = "list_filter(regexp_split_to_array(regexp_replace({x}, '(\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}])\\z', ''), '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda z: true)"


@query(f"SELECT conv_id, turn, CAST(len({SENTENCES}) AS BIGINT) AS n, {SENTENCES}[1] AS first FROM conversations")
def t02_sentences(spark, d):
    parts = text.sentences(F.col("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.size(parts).cast("bigint").alias("n"), F.try_element_at(parts, F.lit(1)).alias("first"),
    )


@query("""WITH s AS (SELECT conv_id, turn, """ + SENTENCES + """ AS p FROM conversations),
  i AS (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM s)
  SELECT conv_id, turn, count(*) FILTER (contains(array_to_string(p[i:i + 2], ' '),
  'the') OR contains(array_to_string(list_filter(p[greatest(i - 2, 1):i - 1], lambda x: contains(x, 'on')), ' '),
  'the')) AS near FROM i GROUP BY 1, 2""")
def w04_look_around(spark, d):
    parts = text.sentences(F.col("text"))

    def near(s, i):
        begin = F.greatest(i - 2, F.lit(0))
        before = F.when(
            i > 0,
            F.array_join(F.filter(F.slice(parts, begin + 1, i - begin), lambda x: F.contains(x, F.lit("on"))), " "),
        ).otherwise("")
        return F.contains(F.array_join(F.slice(parts, i + 1, 3), " "), F.lit("the")) | F.contains(before, F.lit("the"))

    hits = F.size(F.filter(F.transform(parts, near), lambda x: x)).cast("bigint")
    return table(spark, d, "conversations").where(F.size(parts) > 0).select("conv_id", "turn", hits.alias("near"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z])[Tt][Hh][Ee]([^A-Za-z]|$)') AS found FROM documents")
def t03_token_match(spark, d):
    return table(spark, d, "documents").select("doc_id", text.has_token(F.col("text"), F.lit("the")).alias("found"))


@query(f"""SELECT doc_id, array_to_string(list_filter({LINES.format(x='text')}, lambda x: regexp_matches(x,
  '(^|[^A-Za-z])[Tt][Hh][Ee]([^A-Za-z]|$)')), ' ') AS kept FROM documents""")
def t04_token_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_lines(F.col("text"), F.lit("the")).alias("kept"))


@query("SELECT doc_id, strip_accents(replace(replace(text, '’', ''''), '‘', '''')) AS folded FROM documents")
def t01_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", text.norm(F.col("text")).alias("folded"))


#: The fixed inventory, and marks that occur in the tables' invented languages.
SCREEN = [inventory.Named(*x) for x in P.TEMPORARY_FACTS] + [
    inventory.Named("REFERENCE", "that_article", r"\b(?:that|this) (?:the|an?)\b", True),
    inventory.Named("REFERENCE", "of_the", r"\b(?:of|from) the [a-z]+ing\b", True),
    inventory.Named("PAST", "was_place", r"\bwas (?:in|on|at|of|with)\b", False),
    inventory.Named("PAST", "sentence_was", r"(?:^|[.] )Was\b", False),
    inventory.Named("GERMAN", "article_und", r"\b(?:und|zu) (?:der|die|das|den)\b", True),
    inventory.Named("FRENCH", "clitic", r"\b(?:que|qui) (?:le|la|les)\b", True),
    inventory.Named("SPANISH", "de_la", r"\bde (?:la|los|el)\b", True),
    inventory.Named("END", "last_words", r"[.] (?:In|On|At|The) [a-z]+[.]$", False),
]


def _screen_sql() -> str:
    """One row for each turn and pattern that it matches."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(
        f"({quoted(x.category)}, {quoted(x.name)}, {quoted(('(?i)' if x.ignore_case else '') + x.pattern)})" for x in SCREEN
    )
    return f"""WITH p(category, name, pattern) AS (VALUES {table}),
  t AS (SELECT DISTINCT conv_id, turn, replace(strip_accents(text), 'ß', 's') AS text FROM conversations WHERE role = 'user' AND length(text) <= 2000)
  SELECT conv_id, turn, category, name, regexp_extract(text, pattern) AS match FROM t JOIN p ON regexp_matches(text, pattern)"""


@query(_screen_sql())
def t13_f14_pattern_screen(spark, d):
    """Every pattern of the inventory that a user's folded turn matches, with its first match; repeated turns count once."""
    turns = table(spark, d, "conversations").where((F.col("role") == "user") & (F.length("text") <= 2000))
    folded = turns.select("conv_id", "turn", text.norm(F.col("text")).alias("text")).distinct()
    found = folded.withColumn("hits", inventory.hits(F.col("text"), SCREEN))
    return found.select("conv_id", "turn", F.inline("hits"))


@query(f"""WITH h AS ({_screen_sql()}) SELECT category, count(DISTINCT (conv_id, turn)) AS turns, count(*) AS hits FROM h GROUP BY 1""")
def t13_category_counts(spark, d):
    found = t13_f14_pattern_screen(spark, d).groupBy("category", "conv_id", "turn").agg(F.count("*").alias("hits"))
    return found.groupBy("category").agg(F.count("*").alias("turns"), F.sum("hits").alias("hits"))


@query("""SELECT doc_id, substr(text, greatest(position('the' IN text) - 200, 1),
  position('the' IN text) + 300 - greatest(position('the' IN text) - 200, 1)) AS excerpt FROM documents
  WHERE contains(text, 'the')""")
def t14_excerpt(spark, d):
    found = table(spark, d, "documents").where(F.contains("text", F.lit("the")))
    return found.select("doc_id", text.excerpt(F.col("text"), F.locate("the", "text")).alias("excerpt"))


@query("""WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(lower(text),
  '[a-z'']+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'of'))) AS words FROM conversations)
  SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.words, b.words)) AS BIGINT) AS overlap FROM w a
  JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def t15_word_overlap(spark, d):
    words = table(spark, d, "conversations").select(
        "conv_id", "turn", text.content_words(F.col("text"), ["the", "and", "of"]).alias("words"),
    )
    following = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("following"))
    return words.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size(F.array_intersect("words", "following")).cast("bigint").alias("overlap"),
    )


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html,
  '<html lang="([a-z]+)"', 1) AS lang, CAST((length(html) - length(replace(html, '<p>',
  ''))) // 3 AS INTEGER) AS paragraphs FROM pages""")
def t22_markup(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        text.occurrences(F.col("html"), F.lit("<p>")).alias("paragraphs"),
    )


@query("""SELECT conv_id, turn, array_to_string(list_filter(""" + SENTENCES + """, lambda x: NOT regexp_matches(x,
  '(^|[^A-Za-z])[Oo][Nn]([^A-Za-z]|$)')), ' ') AS kept FROM conversations""")
def t17_dropped_units(spark, d):
    kept = F.filter(text.sentences(F.col("text")), lambda s: ~text.has_token(s, F.lit("on")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("kept"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'is the') THEN substr(text, 1,
  position('is the' IN lower(text)) - 1) || 'was the' || substr(text, position('is the' IN lower(text)) + 6)
  WHEN contains(lower(text), 'of the') THEN substr(text, 1, position('of the' IN lower(text)) - 1) || 'by the' ||
  substr(text, position('of the' IN lower(text)) + 6) END AS edited FROM documents""")
def t18_first_edit(spark, d):
    edits = [("is the", "was the"), ("of the", "by the")]
    return table(spark, d, "documents").select("doc_id", text.first_edit(F.col("text"), edits).alias("edited"))


#: By language: phrases of the invented texts, and what stands for them.
EDITS = {
    "en": [("is the", "was the"), ("of the", "by the"), ("and", "or")], "de": [("und die", "oder die"), ("und", "oder")],
    "fr": [("que le", "qui le"), ("dans", "chez"), ("et", "ou")], "es": [("de la", "en la"), ("que", "como")],
}


def _edit_sql(to: str) -> str:
    """The first rule of a text's language that fits; back only where a word begins."""
    cases = []
    for lang, pairs in EDITS.items():
        for flat_from, flat_to in pairs:
            found, put = (flat_from, flat_to) if to == "FLAT" else (flat_to, flat_from)
            before = "()" if to == "FLAT" else "(^|[^A-Za-z0-9_À-ÿ])"
            pattern = f"'(?i){before}{found}'"
            cases.append(f"WHEN lang = '{lang}' AND regexp_matches(text, {pattern}) THEN regexp_replace(text, {pattern}, '\\1{put}')")
    return f"CASE {' '.join(cases)} END"


@query(f"SELECT doc_id, {_edit_sql('FLAT')} AS flat, {_edit_sql('PROG')} AS prog FROM documents")
def t18_verb_edits(spark, d):
    """A language's table of phrases in both directions, each text's first rule that fits."""
    edit = lambda to: text.verb_edit(F.col("text"), F.col("lang"), to, EDITS)
    return table(spark, d, "documents").select("doc_id", edit("FLAT").alias("flat"), edit("PROG").alias("prog"))


@query("""SELECT doc_id, 'Doc ' || doc_id || ' in ' || lang || ' from ' || CASE
  WHEN left(source, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END || ' ' || source AS filled FROM documents""")
def t20_t28_template(spark, d):
    filled = text.fill(
        F.lit("Doc {i} in {l} from {a} {s}"),
        {
            "i": F.col("doc_id").cast("string"), "l": F.col("lang"), "a": text.article(F.col("source")),
            "s": F.col("source"),
        },
    )
    return table(spark, d, "documents").select("doc_id", filled.alias("filled"))


@query("""SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number,
  url LIKE 'https:%' AS secure, regexp_matches(url, '^https?://[a-z.-]+/[a-z]{2}/[0-9]+$') AS canonical FROM pages""")
def t23_parsed_urls(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).try_cast("bigint").alias("number"),
        F.startswith("url", F.lit("https:")).alias("secure"),
        F.rlike("url", F.lit(r"^https?://[a-z.-]+/[a-z]{2}/[0-9]+\z")).alias("canonical"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) - 60 AS session, CASE
  WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '2024-01-01') <= 42 THEN 'near'
  WHEN datediff('day', CAST(o_orderdate AS DATE), DATE '2024-01-01') <= 245 THEN 'stale' ELSE 'stale_long' END AS gap
  FROM orders""")
def k01_session_and_gap(spark, d):
    day, days = F.to_date("o_orderdate"), F.datediff(F.lit("2024-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(
        "o_orderkey", dates.session_date(day, 60).alias("session"),
        F.when(days <= 42, "near").when(days <= 245, "stale").otherwise("stale_long").alias("gap"),
    )


BOUND = """CASE WHEN month({m}) = 12 THEN CAST({m} + INTERVAL 2 MONTH AS DATE)
  WHEN month({m}) = 1 THEN CAST({m} + INTERVAL 1 MONTH AS DATE) ELSE CAST({m} AS DATE) END"""


@query(f"""WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_trunc('month',
  o_orderdate) + INTERVAL 3 MONTH AS m FROM orders), b AS (SELECT o_orderkey, day, {BOUND.format(m='m')} AS bound
  FROM m)
  SELECT o_orderkey, bound, CASE WHEN year(bound) = year(day) THEN monthname(bound)
  ELSE monthname(bound) || ' ' || year(bound) END AS label, CAST(date_trunc('month',
  day) - INTERVAL 1 MONTH AS DATE) AS previous FROM b""")
def k02_k03_k04_bound_month(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.bound_month(day).alias("bound"), dates.bound_label(day).alias("label"),
        dates.previous_month(day).alias("previous"),
    )


@query(f"""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS bound
  FROM orders), t AS (SELECT bound, k, CAST(bound - to_months(CAST(k AS INTEGER)) + INTERVAL 8 DAY AS DATE) AS day
  FROM m, (SELECT unnest(range(3, 7)) AS k)),
  s AS (SELECT bound, k, day, date_trunc('month', day) + INTERVAL 3 MONTH AS m FROM t)
  SELECT m.bound, f.day AS session FROM m LEFT JOIN (SELECT bound, arg_min(day, k) AS day FROM s
  WHERE {BOUND.format(m='m')} = bound GROUP BY 1) f ON m.bound = f.bound""")
def k05_expired_session(spark, d):
    bounds = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("bound")).distinct()
    return bounds.select("bound", dates.expired_session(F.col("bound")).alias("session"))


@query("""SELECT event_id, left(CAST(ts AS VARCHAR), 10) = '2024-01-01' AS same_day,
  'seen ' || CAST(CAST(ts AS DATE) + 30 AS VARCHAR) AS redated FROM events""")
def k08_redated(spark, d):
    seen = events(spark, d)
    note, later = F.concat(F.lit("seen "), F.col("day").cast("string")), F.date_add("day", 30).cast("string")
    same_day = F.left(F.col("ts").cast("string"), F.lit(10)) == "2024-01-01"
    return seen.select(
        "event_id", same_day.alias("same_day"), F.replace(note, F.col("day").cast("string"), later).alias("redated"),
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE
  WHEN NOT json_valid(props) THEN 'malformed' WHEN json_type(props) <> 'OBJECT' THEN 'not_object'
  WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing'
  WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 50 THEN 'EXECUTE' ELSE 'VERIFY' END AS score FROM events""")
def n01_parsed_arguments(spark, d):
    value = F.try_parse_json("props")
    k = F.try_variant_get(value, "$.k", "bigint")
    score = F.when(value.isNull(), "malformed").when(
        ~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "not_object",
    ).when(k.isNull(), "missing").when(k < 50, "EXECUTE").otherwise("VERIFY")
    return events(spark, d).select("event_id", k.alias("k"), score.alias("score"))


@query("""SELECT conv_id, arg_min(text, turn) AS opening, string_agg(DISTINCT role, ','
  ORDER BY role) AS roles, bool_or(role = 'system') AND bool_or(role = 'assistant') AS both_present FROM conversations
  GROUP BY 1""")
def n04_n05_conversation_shape(spark, d):
    roles = F.array_sort(F.collect_set("role"))  # a vocabulary of three
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"), roles.alias("r")).select("conv_id", "opening", F.array_join("r", ",").alias("roles"), (F.array_contains("r", "system") & F.array_contains("r", "assistant")).alias("both_present"))


@query("""SELECT event_id, CAST(ceil(length(props) / 3) AS BIGINT) + 64 AS tokens,
  round((length(props) * 0.3 + value * 1.2) / 1000000, 12) AS cost FROM events""")
def m03_m04_token_estimate(spark, d):
    return events(spark, d).select(
        "event_id", (F.ceil(F.length("props") / 3) + 64).cast("bigint").alias("tokens"),
        F.round((F.length("props") * 0.3 + F.col("value") * 1.2) / 1000000, 12).alias("cost"),
    )


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":'
  || n_regionkey || '}') AS digest FROM nation""")
def h02_s09_row_digest(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return nation.select("n_nationkey", F.sha2(records.canonical_json(nation), 256).alias("digest"))


@query("""SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source
  ORDER BY sha256(concat_ws('|', 'sample', doc_id)), doc_id) AS r FROM documents) WHERE r <= 3""")
def r01_stratified_sample(spark, d):
    return sampling.per_stratum(
        table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 3, "sample", "doc_id",
    )


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
  ORDER BY sha256(concat_ws('|', 'robin', doc_id)), doc_id) AS r FROM documents) ORDER BY r, lang LIMIT 50""")
def r02_round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 50, "robin", "doc_id")


@query("""SELECT r_name AS frame, g.gap, CAST(g.days AS BIGINT) AS days, n_name AS witness,
  n_nationkey % 5 = 4 AS held_out, CAST(CAST(max_day AS DATE) - CAST(g.days AS INTEGER) AS DATE) AS gap_date
  FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('fresh', 2), ('near', 42), ('boundary', 60),
  ('stale', 245), ('stale_long', 425)) g(gap, days), (SELECT max(o_orderdate) AS max_day FROM orders)""")
def g01_gap_grid(spark, d):
    gaps = F.array(
        *[F.struct(F.lit(k).alias("gap"), F.lit(v).cast("bigint").alias("days")) for k, v in GAP_DAYS.items()]
    )
    last = table(spark, d, "orders").agg(F.to_date(F.max("o_orderdate")).alias("day")).scalar()
    witnesses = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grid = witnesses.select("r_name", "n_name", "n_nationkey", F.inline(gaps))
    return grid.select(
        F.col("r_name").alias("frame"), "gap", "days", F.col("n_name").alias("witness"),
        (F.col("n_nationkey") % 5 == 4).alias("held_out"),
        F.date_sub(last, F.col("days").cast("int")).alias("gap_date"),
    )


@query("""SELECT 'required' AS "check", CAST(doc_id AS VARCHAR) AS key, 'source' AS detail FROM documents
  WHERE source IS NULL OR trim(source) = '' UNION ALL
  SELECT 'banned', CAST(doc_id AS VARCHAR), regexp_extract(text, '(http[s]?://|@mail[0-9]|token = )', 1)
  FROM documents WHERE regexp_matches(text, '(http[s]?://|@mail[0-9]|token = )')""")
def v01_v11_required_and_banned(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return contracts.all_of(
        contracts.required(docs, "doc_id", ["source"]),
        contracts.banned(docs, "doc_id", "text", "http[s]?://|@mail[0-9]|token = "),
    )


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'")
def s01_s08_jsonl_round_trip(spark, d):
    path = scratch(spark)
    records.write_jsonl(
        events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "event_type", "value"), path,
    )
    return records.read_jsonl(
        spark, path, "event_id bigint, user_id bigint, event_type string, value double", strict=True,
    )


@query(
    "SELECT o_orderkey AS \"order/key\", CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS \"order/state/final\", o_totalprice AS \"price\" FROM orders"
)
def s14_flat_metrics(spark, d):
    nested = table(spark, d, "orders").select(
        F.struct(
            F.col("o_orderkey").alias("key"),
            F.struct(
                (F.col("o_orderstatus") == "F").alias("final"), F.col("o_orderpriority").alias("name"),
            ).alias("state"),
        ).alias("order"),
        F.col("o_totalprice").alias("price"),
    )
    return records.flat_metrics(nested)


