"""All queries over the driver tables, each with the SQL that gives the same rows.

Driver tables stand in for corpus data: documents for raw texts, adjacent turns of
conversations for the two sides of a parallel corpus, embeddings for vector tables.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import collapse, superscript_digits, word_count, words
from ..operators import adapters, align, cleaning, encoding, metrics, parsing, profile, prompt, quality, vector
from ..shared import settled, shared_folder
from ..sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: SQL of the words of a text, and of adjacent user and assistant turns.
W = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
PAIRS = """pairs AS (SELECT conv_id, turn, a, b FROM (
  SELECT conv_id, turn, role, text AS a, lead(role) OVER w AS next_role, lead(text) OVER w AS b
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""


def _w(column: str) -> str:
    return W.format(column)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.follow(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "user", "assistant", "text")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("value"))


# Profiles and counts


@query(f"SELECT doc_id, length(text)::BIGINT AS chars, len({_w('text')})::BIGINT AS words, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, len(regexp_extract_all(text, '<!-- Page '))::BIGINT AS pages FROM documents")
def profile_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *profile.document_profile(F.col("text")))


@query(f"SELECT sum(length(text))::BIGINT AS chars, sum(len({_w('text')}))::BIGINT AS words, count(*) AS docs, sum(len({_w('text')}))::DOUBLE / count(*) AS mean_words FROM documents")
def profile_totals(spark, sf_dir):
    n = word_count(F.col("text")).cast("long")
    return read(spark, sf_dir, "documents").agg(F.sum(F.length("text").cast("long")).alias("chars"), F.sum(n).alias("words"), F.count("*").alias("docs"), (F.sum(n).cast("double") / F.count("*")).alias("mean_words"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def group_count(spark, sf_dir):
    return profile.counts(read(spark, sf_dir, "documents"), "lang")


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INTEGER AS place FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    got = profile.counts(read(spark, sf_dir, "events"), "event_type")
    return align.number(got, [F.desc("n"), "event_type"]).select("event_type", "n", (F.col("idx") + 1).cast("int").alias("place"))


@query("SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents")
def distinct_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def distinct_by_group(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query(
    f"""WITH v AS (SELECT len({_w('text')})::DOUBLE AS v FROM documents), e AS (SELECT min(v) AS a, max(v) AS z FROM v),
  b AS (SELECT CASE WHEN a = z THEN 0 ELSE least(floor((v - a) / ((z - a) / 40)), 39) END::INTEGER AS bin, a, z FROM v, e)
SELECT bin, a + bin * ((z - a) / 40) AS low, count(*) AS n FROM b GROUP BY 1, 2"""
)
def histogram_lengths(spark, sf_dir):
    return profile.histogram(read(spark, sf_dir, "documents").select(word_count(F.col("text")).alias("n")), "n")


@query("""SELECT n_name, canon, n, percent, low FROM (
  SELECT CASE WHEN grouping(n_name) = 1 THEN 'TOTAL' ELSE n_name END AS n_name, sum(canon)::BIGINT AS canon, sum(n)::BIGINT AS n,
    sum(n) * 100.0::DOUBLE / sum(canon) AS percent, coalesce(sum(n) * 100.0::DOUBLE / sum(canon) < 90, false) AS low
  FROM (SELECT n_name, 60::BIGINT AS canon, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name)
  GROUP BY ROLLUP(n_name))""")
def coverage_report(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    named = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return profile.coverage(nation.select("n_name", F.lit(60).alias("canon_n")), named, "n_name", "canon_n")


# De-duplication, joins, numbering, splits


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    return align.keep_first(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["text"], ["doc_id"]).select("doc_id", "lang")


@query(
    f"""WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents),
  j AS (SELECT doc_id, len({_w('text')})::INTEGER AS n_words, quality FROM d JOIN labels USING (doc_id) WHERE r = 1)
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS idx, doc_id, n_words, quality FROM j WHERE n_words >= 5"""
)
def align_inner(spark, sf_dir):
    docs = align.keep_first(read(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])
    joined = docs.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", word_count(F.col("text")).alias("n_words"), "quality")
    return align.number(joined.where("n_words >= 5"), ["doc_id"]).select("idx", "doc_id", "n_words", "quality")


@query(f"WITH {PAIRS} SELECT conv_id, turn, a, b FROM pairs")
def align_turns_lead(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", "a", "b")


SPLIT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+([A-ZÁÉÍÓÚ¡¿])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


@query("SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s)))::INTEGER AS seq FROM (SELECT doc_id, " + SPLIT.format("text") + " AS s FROM documents)")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(parsing.sentences(F.col("text"))).alias("seq", "sentence"))


@query(
    f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, {SPLIT.format('a')} AS x, {SPLIT.format('b')} AS y FROM pairs),
  z AS (SELECT conv_id, turn, unnest(range(least(len(x), len(y)))) AS seq, x, y FROM s),
  p AS (SELECT conv_id, turn, seq::INTEGER AS seq, x[seq + 1] AS a, y[seq + 1] AS b FROM z)
SELECT conv_id, turn, seq, a, b FROM p WHERE len({_w('a')}) >= 5 AND len({_w('b')}) >= 5 AND greatest(length(a), length(b))::DOUBLE / least(length(a), length(b)) <= 5"""
)
def align_positional(spark, sf_dir):
    zipped = pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(align.zip_arrays(parsing.sentences(F.col("a")), parsing.sentences(F.col("b")))).alias("seq", "p"))
    rows = zipped.select("conv_id", "turn", "seq", "p.a", "p.b")
    return rows.where(quality.chars_in_ratio(F.col("a"), F.col("b")))


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lookup_join(spark, sf_dir):
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


PART_ALIASES = {"ring": "ring", "red widget": "red widget", "widget": "widget", "bolt": "bolt", "ECONOMY": "economy"}


@query(
    "WITH a(alias, canonical, place) AS (VALUES "
    + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(PART_ALIASES.items()))
    + ") SELECT p_partkey, p_type, arg_min(canonical, place) AS canonical FROM part JOIN a ON contains(p_type || p_name, alias) GROUP BY ALL"
)
def alias_contains_join(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat("p_type", "p_name").alias("both"))
    return align.first_alias(parts, "both", T.lookup(spark, PART_ALIASES, "alias", "canonical")).drop("both")


@query("SELECT count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS returned FROM orders")
def membership(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("r", F.lit(1))
    rows = read(spark, sf_dir, "orders").join(returned, "o_orderkey", "left")
    return rows.agg(F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("high"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("r") == 1).alias("returned"))


@query("""SELECT (row_number() OVER (ORDER BY kind, key) - 1)::BIGINT AS idx, kind, key, name, segment FROM (
  SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
  UNION ALL BY NAME SELECT 'supplier' AS kind, s_suppkey AS key, s_name AS name FROM supplier)""")
def union_by_name(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return align.union_numbered(customer, supplier, ["kind", "key"]).select("idx", "kind", "key", "name", "segment")


@query(f"SELECT doc_id, len(list_intersect({_w('lower(text)')}, [{', '.join(repr(s) for s in T.CHECK_STOPS)}]))::INTEGER AS shared, len(list_distinct({_w('lower(text)')}))::INTEGER AS distinct_words FROM documents")
def array_set_ops(spark, sf_dir):
    w = words(F.lower("text"))
    return read(spark, sf_dir, "documents").select("doc_id", align.shared_words(w, F.array(*[F.lit(s) for s in T.CHECK_STOPS])).alias("shared"), F.size(F.array_distinct(w)).alias("distinct_words"))


SPLITS = """s AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
  t AS (SELECT doc_id, source, CASE WHEN r < n * 80 // 100 THEN 'train' WHEN r < n * 80 // 100 + n * 10 // 100 THEN 'val' ELSE 'test' END AS split FROM s)"""


@query(f"WITH {SPLITS} SELECT doc_id, split FROM t")
def split_80_10_10(spark, sf_dir):
    return align.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"WITH {SPLITS}, f AS (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY 1) SELECT source, first_doc, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM t JOIN f USING (source) GROUP BY ALL")
def split_by_key_pivot(spark, sf_dir):
    docs = align.split(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    order = docs.groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    return profile.contingency(docs.where("source is not null"), "source", "split", ["train", "val", "test"]).join(order, "source")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def sample_n(spark, sf_dir):
    return align.sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query(f"""WITH {PAIRS}, l AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM pairs),
  r AS (SELECT conv_id AS other_conv, turn AS other_turn, length(b)::INTEGER AS n, row_number() OVER (ORDER BY length(b), conv_id, turn) - 1 AS idx FROM pairs)
SELECT idx::BIGINT AS idx, conv_id, turn, other_conv, other_turn, n FROM l JOIN r USING (idx)""")
def attach_by_place(spark, sf_dir):
    both = pairs(spark, sf_dir)
    answers = both.select(F.col("conv_id").alias("other_conv"), F.col("turn").alias("other_turn"), F.length("b").alias("n"))
    return align.attach(both.select("conv_id", "turn"), answers, ["conv_id", "turn"], ["n", "other_conv", "other_turn"])


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS place, doc_id, text, lang FROM documents")
def one_ordered_file(spark, sf_dir):
    """Written as one file of JSON Lines, then read again with each line's place in it."""
    path = f"{shared_folder(spark)}/one-{uuid.uuid4().hex}.jsonl"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    writers.json_lines(docs, path, ["doc_id"], one_file=True)
    return readers.numbered_json_lines(spark, path, "doc_id long, text string, lang string")


@query()
def encode_pairs(spark, sf_dir):
    """128 ids of each side of a pair by a public tokenizer's file."""
    return encoding.encode_examples(pairs(spark, sf_dir), "a", "b", pad=50256, end=50256).drop("a", "b")


# Quality


VALID = "({0} IS NOT NULL AND len({1}) >= 5 AND len(list_filter({1}, lambda t: regexp_full_match(regexp_replace(t, '[.,]', '', 'g'), '[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]+'))) <= len({1}) * 0.5)"
OK_A, OK_B = VALID.format("a", _w("a")), VALID.format("b", _w("b"))
OK_R = f"(len({_w('a')}) > 0 AND len({_w('b')}) > 0 AND greatest(len({_w('a')}), len({_w('b')}))::DOUBLE / least(len({_w('a')}), len({_w('b')})) <= 5)"


@query(f"WITH {PAIRS} SELECT conv_id, turn, 'conversations' AS fuente FROM pairs WHERE {OK_A} AND {OK_B} AND {OK_R}")
def quality_filter(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    good = pairs(spark, sf_dir).where(quality.valid_text(a) & quality.valid_text(b) & quality.words_in_ratio(a, b))
    return good.select("conv_id", "turn", F.lit("conversations").alias("fuente"))


@query(f"WITH {PAIRS} SELECT count(*) AS n, count(*) FILTER (NOT {OK_A}) AS bad_a, count(*) FILTER (NOT {OK_B}) AS bad_b, count(*) FILTER (NOT {OK_R}) AS bad_ratio, count(*) FILTER ({OK_A} AND {OK_B} AND {OK_R}) AS kept FROM pairs")
def discard_reasons(spark, sf_dir):
    return quality.discard_reasons(pairs(spark, sf_dir), "a", "b")


TOKENS = "list_filter(list_transform(" + _w("lower(text)") + ", lambda x: trim(x, '" + T.SCORE_MARKS + "')), lambda x: x <> '')"


@query(
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE (len(list_filter(t, lambda x: regexp_matches(x, '({'|'.join(T.SCORE_SUFFIXES)})$'))) - len(list_filter(t, lambda x: x IN ({', '.join(repr(s) for s in T.SCORE_STOPS)}))))::DOUBLE / len(t) END AS score FROM t)
SELECT doc_id, score, CASE WHEN score > 0.02 THEN 'inga' WHEN score < -0.05 THEN 'es' ELSE 'mixed' END AS lang FROM s"""
)
def lang_score(spark, sf_dir):
    scored = read(spark, sf_dir, "documents").select("doc_id", quality.language_score(F.col("text")).alias("score"))
    return scored.withColumn("lang", quality.language(F.col("score")))


@query(f"SELECT doc_id, coalesce(len(list_filter({_w('lower(text)')}, lambda x: regexp_matches(x, '({'|'.join(T.CHECK_SUFFIXES)})$')))::DOUBLE / nullif(len({_w('lower(text)')}), 0) >= 0.10, false) AS target, len(list_intersect({_w('lower(text)')}, [{', '.join(repr(s) for s in T.CHECK_STOPS)}])) >= 2 AS source_side FROM documents")
def looks_like_lang(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", quality.looks_target(F.col("text")).alias("target"), quality.looks_source(F.col("text")).alias("source_side"))


# Parsing


CHUNK = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '<!--.*?-->', '', 'gs'), '!\\[.*?\\]\\(.*?\\)', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"WITH c AS (SELECT doc_id, {CHUNK} AS c FROM documents), u AS (SELECT doc_id, unnest(c) AS text, unnest(range(len(c)))::INTEGER AS chunk_id FROM c) SELECT doc_id, chunk_id, text FROM u WHERE len({_w('text')}) >= 30")
def chunk_documents(spark, sf_dir):
    return parsing.chunks(raw(spark, sf_dir), separator="\n").select(F.col("doc").alias("doc_id"), "chunk_id", "text")


LINES = "SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INTEGER AS seq FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
KIND = """CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^<!--\\s*Page\\s+\\d+\\s*-->\\s*$') THEN 'page'
  WHEN regexp_matches(line, '^\\s*\\d+\\s*$') AND length(trim(line)) <= 4 THEN 'number' WHEN contains(line, 'Wycliffe') AND contains(line, '©') THEN 'copyright'
  WHEN regexp_matches(line, '^#{2,}\\s+') THEN 'title' WHEN regexp_matches(line, '^([0-9]?\\s?[A-ZÁÉÍÓÚ ]+?)\\s+([0-9]+)(?:,\\s*([0-9]+))?\\s*$') THEN 'header'
  WHEN ltrim(line)[1] = '#' AND ltrim(line)[1:2] <> '##' THEN 'heading' ELSE 'content' END"""


@query(f"WITH l AS ({LINES}), s AS (SELECT doc_id, seq, rtrim(line, chr(32) || chr(9) || chr(13)) AS line FROM l) SELECT doc_id, seq, {KIND} AS kind, length(line)::INTEGER AS n FROM s")
def line_classify(spark, sf_dir):
    stream = parsing.line_stream(raw(spark, sf_dir))
    return stream.select(F.col("doc").alias("doc_id"), "seq", parsing.classify(F.col("line")).alias("kind"), F.length("line").alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\\[.*?\\]\\(.*?\\)', '', 'g'), '<!--.*?-->', '', 'gs'), '#{1,6}\\s+.*', '', 'g'), '^\\s*\\d+\\s*$', '', 'gm'), '\\s+', ' ', 'g')) AS text FROM pages")
def markup_clean(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", cleaning.clean_markdown(F.col("html")).alias("text"))


MARKED = "concat_ws(' ', '⁴-⁵Kam', CAST(l_linenumber AS STRING), 'Paita', CAST(l_partkey AS STRING), 'Xa y', CAST(l_suppkey % 300 AS STRING), 'Sug.')"


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, '⁴-⁵Kam ' || l_linenumber || ' Paita ' || l_partkey || ' Xa y ' || (l_suppkey % 300) || ' Sug.' AS line FROM lineitem),
  m AS (SELECT l_orderkey, l_linenumber, string_split(regexp_replace(line, '([⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:-[⁰¹²³⁴⁵⁶⁷⁸⁹]+)?)|\\b(200|1[0-9]{2}|0?[1-9][0-9]|0{0,2}[1-9])\\s+([A-ZÁÉÍÓÚÑ])', chr(1) || '\\1\\2' || chr(2) || '\\3', 'g'), chr(1)) AS parts FROM l)
SELECT l_orderkey, l_linenumber, pos, translate(string_split(part, chr(2))[1], '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS mark, trim(string_split(part, chr(2))[2]) AS text
FROM (SELECT l_orderkey, l_linenumber, unnest(parts) AS part, unnest(range(len(parts)))::INTEGER AS pos FROM m) WHERE contains(part, chr(2))"""
)
def marker_extract(spark, sf_dir):
    marked = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(parsing.verse_marks(F.expr(MARKED))).alias("pos", "part")).where(F.contains("part", F.lit("\u0002")))
    half = F.split("part", "\u0002", 2)
    return marked.select("l_orderkey", "l_linenumber", "pos", superscript_digits(F.element_at(half, 1)).alias("mark"), F.trim(F.element_at(half, 2)).alias("text"))


@query("""WITH r AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run
  FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations))
SELECT conv_id, run::BIGINT AS run, min(role) AS role, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS turns FROM r GROUP BY conv_id, run""")
def verse_assembly(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("new", (F.col("role") != F.lag("role", 1, "").over(order)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ")
    return rows.groupBy("conv_id", "run").agg(F.min("role").alias("role"), texts.alias("text"), F.count("*").alias("turns"))


@query("SELECT l_orderkey, l_linenumber, unnest(generate_series(l_linenumber, l_linenumber + l_suppkey % 3))::INTEGER AS verse, l_suppkey % 3 > 0 AS combined FROM lineitem")
def range_expand(spark, sf_dir):
    last = (F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("int")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.sequence("l_linenumber", last)).alias("verse"), (F.col("l_suppkey") % 3 > 0).alias("combined"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, floor(value)::BIGINT AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  f AS (SELECT user_id, k, 1 AS chapter, greatest(0, x) AS most FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.k, f.chapter + (e.x < f.most - 5)::INTEGER, CASE WHEN e.x < f.most - 5 THEN e.x ELSE greatest(f.most, e.x) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, max(chapter)::INTEGER AS chapters, count(*) AS events FROM f GROUP BY user_id""")
def chapter_fold(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("x"))
    return parsing.chapters_of(rows, "user_id", "event_id", "x")


# Long documents: lines rendered from a table, most of them in one document, and what the parsers make of them.

#: Eight lines for each row of documents, with numbers that choose what they are rendered as.
LINE_COLUMNS = ["doc_id * 8 + j AS seq", "(coalesce(n_chars, 0) * 13 + j * 29 + doc_id) % 2000 + 1 AS p", "(coalesce(n_chars, 0) * 7 + doc_id * 11 + j) % 100 AS q", "j"]
LINE_TABLE = f"(SELECT {', '.join(LINE_COLUMNS)} FROM documents, range(8) r(j))"
DICE = "(p * 7 + q * 3 + j)"
P = "CAST(p AS STRING)"
NT_LINE = f"""CASE {DICE} % 24 WHEN 0 THEN 'SAN MARCOS ' || CAST(1 + p % 16 AS STRING) WHEN 1 THEN '# SAN JUAN' WHEN 2 THEN '# SAN PEDRO' WHEN 3 THEN '1 SAN JUAN ' || CAST(1 + p % 5 AS STRING)
  WHEN 4 THEN '# HECHOS' WHEN 5 THEN 'NADA 3' WHEN 6 THEN '' WHEN 7 THEN '## Titulo' WHEN 8 THEN '⁴-⁵Kam ' || {P} || ' sug' WHEN 9 THEN '⁴-⁵Kam ' || {P} || ' sug' WHEN 10 THEN 'cola 12 Paita nuka'
  ELSE CASE WHEN {DICE} % 24 < 16 THEN '⁷Kam ' || {P} || ' sug' ELSE 'solo ' || {P} || ' texto' END END AS line"""
NT_DOC = "CASE WHEN q % 3 = 0 THEN q % 5 ELSE 9 END AS doc"


def rendered(spark: SparkSession, sf_dir: str, doc: str, line: str) -> DataFrame:
    # Settled, as an expression as long as this one would be written out wherever a parser reads the line.
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    return settled(rows.selectExpr(*LINE_COLUMNS).selectExpr(doc, "seq", line))


@query(f"""WITH RECURSIVE l AS (SELECT {NT_DOC}, seq, {DICE} % 24 AS k, p FROM {LINE_TABLE}),
  a AS (SELECT doc, k, seq, row_number() OVER (PARTITION BY doc, k ORDER BY seq) AS i FROM l WHERE k IN (1, 2)),
  x AS (SELECT doc, min(seq) AS first_seq FROM l WHERE k = 3 GROUP BY doc),
  r(doc, k, i, seq, used, way) AS (SELECT DISTINCT doc, k, 0::BIGINT, 0::BIGINT, []::VARCHAR[], '' FROM a
    UNION ALL SELECT doc, k, i, seq, list_append(used, way), way FROM (SELECT *, list_filter(CASE k WHEN 1 THEN ['Juan', '1 Juan', '2 Juan', '3 Juan'] ELSE ['1 Pedro', '2 Pedro'] END, lambda v: NOT list_contains(used, v))[1] AS way
      FROM (SELECT a.doc, a.k, a.i, a.seq, CASE WHEN x.first_seq < a.seq THEN list_append(r.used, '1 Juan') ELSE r.used END AS used FROM r JOIN a ON a.doc = r.doc AND a.k = r.k AND a.i = r.i + 1 AND r.way IS NOT NULL LEFT JOIN x ON x.doc = a.doc))),
  h AS (SELECT doc, seq, k IN (0, 3) AS header, CASE k WHEN 0 THEN 'Marcos' WHEN 3 THEN '1 Juan' ELSE 'Hechos' END AS book, CASE k WHEN 0 THEN 1 + p % 16 WHEN 3 THEN 1 + p % 5 END AS number FROM l WHERE k IN (0, 3, 4)
    UNION ALL SELECT doc, seq, false, way, NULL FROM r WHERE i > 0 AND way IS NOT NULL),
  b AS (SELECT *, CASE WHEN header THEN number WHEN was IS DISTINCT FROM book THEN 1 END AS num FROM (SELECT *, lag(book) OVER (PARTITION BY doc ORDER BY seq) AS was FROM h)),
  c AS (SELECT doc, seq, book, was, last_value(num IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq) AS chapter, last_value(num IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM b),
  q AS (SELECT doc, seq, 0 AS pos, NULL::VARCHAR AS mark, '' AS text, book, chapter, was IS DISTINCT FROM book OR old IS DISTINCT FROM chapter AS reset FROM c
    UNION ALL SELECT doc, seq, 0, NULL::VARCHAR, CASE k WHEN 5 THEN 'NADA 3' WHEN 10 THEN 'cola' ELSE 'solo ' || p || ' texto' END, NULL, NULL, false FROM l WHERE k IN (5, 10) OR k >= 16
    UNION ALL SELECT doc, seq, 1, CASE WHEN k < 10 THEN '4-5' WHEN k = 10 THEN '12' ELSE '7' END, CASE k WHEN 10 THEN 'Paita nuka' ELSE 'Kam ' || p || ' sug' END, NULL, NULL, false FROM l WHERE k BETWEEN 8 AND 15),
  w AS (SELECT doc, seq, pos, mark, text, last_value(book IGNORE NULLS) OVER o AS book, last_value(chapter IGNORE NULLS) OVER o AS chapter, sum((mark IS NOT NULL OR reset)::INTEGER) OVER o AS run FROM q WINDOW o AS (PARTITION BY doc ORDER BY seq, pos)),
  v AS (SELECT doc, min(seq) AS seq, min(book) AS libro, min(chapter) AS capitulo, max(mark) AS mark, string_agg(text, ' ' ORDER BY seq, pos) FILTER (text <> '') AS texto_inga FROM w WHERE book IS NOT NULL GROUP BY doc, run)
SELECT doc, seq, libro, capitulo::INTEGER AS capitulo, unnest(CASE mark WHEN '4-5' THEN [4, 5] ELSE [mark::INTEGER] END) AS versiculo, texto_inga, mark = '4-5' AS verso_combinado FROM v WHERE mark IS NOT NULL AND texto_inga <> ''""")
def nt_verses(spark, sf_dir):
    return parsing.parse_verse_lines(rendered(spark, sf_dir, NT_DOC, NT_LINE)).drop("pos")


OT_LINE = f"""CASE WHEN {DICE} % 30 = 0 THEN ' SALMOS' WHEN {DICE} % 30 = 1 THEN ' JOSUE' WHEN {DICE} % 30 < 4 THEN CAST(1 + p % 30 AS STRING) WHEN {DICE} % 30 = 4 THEN 'Wycliffe aviso' WHEN {DICE} % 30 = 5 THEN ''
  WHEN {DICE} % 30 < 21 THEN CAST(1 + p % 25 AS STRING) || ' Uno dos ' || {P} WHEN {DICE} % 30 < 23 THEN '9 Corto' ELSE 'sigue texto ' || {P} END AS line"""
#: Documents short enough for recursion in SQL.
SHORT_DOC = "q % 40 AS doc"


@query(f"""WITH RECURSIVE a AS (SELECT {SHORT_DOC}, seq, {DICE} % 30 AS k, p FROM {LINE_TABLE}),
  l AS (SELECT a.* FROM a JOIN (SELECT doc, min(seq) AS begins FROM a WHERE k < 2 GROUP BY doc) USING (doc) WHERE seq >= begins),
  t AS (SELECT doc, seq, CASE k WHEN 0 THEN 'Salmos' WHEN 1 THEN 'Josue' END AS book, CASE WHEN k < 2 THEN 2 WHEN k < 4 THEN 1 WHEN k BETWEEN 6 AND 22 THEN 0 END AS kind, CASE WHEN k IN (2, 3) THEN 1 + p % 30 WHEN k BETWEEN 6 AND 20 THEN 1 + p % 25 WHEN k > 20 THEN 9 END AS n,
    CASE WHEN k BETWEEN 6 AND 20 THEN 'Uno dos ' || p WHEN k IN (21, 22) THEN 'Corto' WHEN k > 22 THEN 'sigue texto ' || p END AS text FROM l WHERE k NOT IN (4, 5)),
  e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i FROM t WHERE kind IS NOT NULL),
  f AS (SELECT doc, i, seq, 1::BIGINT AS chapter, 0::BIGINT AS most, true AS closes FROM e WHERE i = 1
    UNION ALL SELECT e.doc, e.i, e.seq, CASE e.kind WHEN 2 THEN 1 WHEN 1 THEN greatest(e.n, f.chapter) ELSE f.chapter + (e.n < f.most - 5)::BIGINT END,
      CASE e.kind WHEN 2 THEN 0 WHEN 1 THEN CASE WHEN e.n > f.chapter THEN 0 ELSE f.most END ELSE CASE WHEN e.n < f.most - 5 THEN e.n ELSE greatest(f.most, e.n) END END, e.kind <> 1 OR e.n > f.chapter FROM f JOIN e ON e.doc = f.doc AND e.i = f.i + 1),
  g AS (SELECT t.*, f.chapter, coalesce(f.closes, false) AS closes, last_value(t.book IGNORE NULLS) OVER o AS libro, sum(coalesce(f.closes, false)::INTEGER) OVER o AS run FROM t LEFT JOIN f ON f.doc = t.doc AND f.seq = t.seq WINDOW o AS (PARTITION BY t.doc ORDER BY t.seq)),
  v AS (SELECT doc, min(seq) AS first_seq, arg_min(kind, seq) AS kind, min(libro) AS libro, arg_min(chapter, seq) AS capitulo, arg_min(n, seq) AS versiculo, string_agg(text, ' ' ORDER BY seq) AS texto_inga FROM g GROUP BY doc, run)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY first_seq) - 1)::INTEGER AS seq, libro, capitulo::INTEGER AS capitulo, versiculo::INTEGER AS versiculo, texto_inga FROM v WHERE kind = 0 AND len({_w('texto_inga')}) >= 3""")
def ot_verses(spark, sf_dir):
    return parsing.parse_old_testament_lines(rendered(spark, sf_dir, SHORT_DOC, OT_LINE))


BILINGUAL_LINE = f"""CASE WHEN {DICE} % 20 = 0 THEN '# SUG SUIUCHII (1) / Artículo ' || CAST(1 + p % 99 AS STRING) WHEN {DICE} % 20 < 5 THEN CAST(1 + p % 9 AS STRING) || '. uno ' || {P}
  WHEN {DICE} % 20 < 8 THEN '' WHEN {DICE} % 20 = 8 THEN '// aside' WHEN {DICE} % 20 < 11 THEN 'corta dos' ELSE 'una linea ' || {P} END AS line"""


@query(f"""WITH RECURSIVE l AS (SELECT {SHORT_DOC}, seq, {DICE} % 20 AS k, p, {BILINGUAL_LINE} FROM {LINE_TABLE}),
  t AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i, seq, p, line, CASE WHEN k = 0 THEN 'article' WHEN k < 5 THEN 'item' WHEN k < 8 THEN 'blank' WHEN k = 8 THEN 'aside' ELSE 'plain' END AS kind, len({_w('line')}) AS n FROM l),
  u AS (SELECT *, min(CASE WHEN kind <> 'blank' THEN i END) OVER o AS f, min(CASE WHEN kind IN ('blank', 'aside', 'item') THEN i END) OVER o AS stop, min(CASE WHEN kind IN ('blank', 'aside', 'item', 'article') THEN i END) OVER o AS halt,
    sum(n) OVER (PARTITION BY doc ORDER BY i) AS words, sum(n) OVER (PARTITION BY doc) AS total FROM t WINDOW o AS (PARTITION BY doc ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  m AS (SELECT a.doc, a.i, a.seq, a.kind, a.p, a.line, a.f, CASE a.kind WHEN 'item' THEN b.stop ELSE b.halt END AS ends, a.total, b.kind AS fk, a.n, b.words - b.n AS before FROM u a LEFT JOIN u b ON b.doc = a.doc AND b.i = a.f),
  s AS (SELECT m.*, CASE m.kind WHEN 'item' THEN coalesce(fk <> 'aside', false) WHEN 'plain' THEN coalesce(fk NOT IN ('aside', 'item', 'article'), false) AND m.n >= 3 AND coalesce(e.words - e.n, m.total) - before >= 3 ELSE false END AS takes FROM m LEFT JOIN u e ON e.doc = m.doc AND e.i = m.ends),
  g AS (SELECT *, CASE WHEN takes THEN ends WHEN kind = 'item' THEN f ELSE i + 1 END AS after FROM s),
  r(doc, i) AS (SELECT doc, min(i) FROM g WHERE kind = 'article' GROUP BY doc UNION ALL SELECT g.doc, g.after FROM r JOIN g USING (doc, i) WHERE g.after IS NOT NULL),
  v AS (SELECT g.*, last_value(CASE WHEN kind = 'article' THEN 1 + p % 99 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS articulo FROM g JOIN r USING (doc, i)),
  w AS (SELECT v.doc, v.i, string_agg(t.line, ' ' ORDER BY t.i) AS texto_inga FROM v JOIN t ON t.doc = v.doc AND t.i >= v.f AND (v.ends IS NULL OR t.i < v.ends) WHERE v.takes GROUP BY v.doc, v.i)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY i) - 1)::INTEGER AS seq, articulo::INTEGER AS articulo, CASE kind WHEN 'item' THEN 1 + p % 9 ELSE 0 END::INTEGER AS sub_idx, CASE kind WHEN 'item' THEN 'uno ' || p ELSE line END AS texto_es, texto_inga FROM v JOIN w USING (doc, i)""")
def bilingual_blocks(spark, sf_dir):
    return parsing.parse_bilingual_lines(rendered(spark, sf_dir, SHORT_DOC, BILINGUAL_LINE))


REPORT_LINE = f"""CASE {DICE} % 20 WHEN 0 THEN '# Uno ' || {P} WHEN 1 THEN '**Tabla ' || {P} || '**' WHEN 2 THEN '**Figura ' || {P} || '**' WHEN 3 THEN '*Titulo ' || {P} || '*' WHEN 4 THEN ' *Titulo ' || {P} || '* '
  WHEN 5 THEN '![a](f/' || {P} || '.png)' WHEN 6 THEN '*Nota.* fuente ' || {P} WHEN 11 THEN '|---|---|' WHEN 12 THEN '- cosa ' || {P} WHEN 13 THEN '' WHEN 14 THEN '  ' WHEN 15 THEN '**Tabla ' || {P} || '**' WHEN 16 THEN '### Tres ' || {P} || ' '
  ELSE CASE WHEN {DICE} % 20 < 11 THEN '| a ' || {P} || ' | b |' ELSE 'texto ' || {P} END END AS line"""


@query(f"""WITH RECURSIVE l AS (SELECT {SHORT_DOC}, seq, {DICE} % 20 AS k, p FROM {LINE_TABLE}),
  a AS (SELECT *, CASE WHEN k IN (0, 16) THEN 'heading' WHEN k IN (1, 2, 15) THEN 'caption' WHEN k = 5 THEN 'figure' WHEN k = 6 THEN 'note' WHEN k BETWEEN 7 AND 11 THEN 'table' WHEN k = 12 THEN 'list' WHEN k IN (13, 14) THEN 'blank' ELSE 'paragraph' END AS kind,
    row_number() OVER (PARTITION BY doc ORDER BY seq) AS place FROM l),
  e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i FROM a WHERE kind <> 'blank'),
  f AS (SELECT doc, i, kind AS role FROM e WHERE i = 1 UNION ALL
    SELECT e.doc, e.i, CASE WHEN f.role = 'caption' AND e.k IN (1, 2, 3, 4, 15) THEN 'title' ELSE e.kind END FROM f JOIN e ON e.doc = f.doc AND e.i = f.i + 1),
  r AS (SELECT e.*, f.role, CASE k WHEN 2 THEN 'Figura' ELSE 'Tabla' END AS name FROM e JOIN f USING (doc, i)),
  c AS (SELECT c.doc, c.seq, c.p::BIGINT AS number, c.name AS text, CASE WHEN t.k IN (3, 4) THEN 'Titulo ' || t.p WHEN t.k IS NOT NULL THEN '*' || t.name || ' ' || t.p || '*' END AS title, c.i + CASE WHEN t.k IS NULL THEN 1 ELSE 2 END AS i
    FROM r c LEFT JOIN r t ON t.doc = c.doc AND t.i = c.i + 1 AND t.role = 'title' WHERE c.role = 'caption'),
  g AS (SELECT doc, min(seq) AS seq, min(i) AS i, list(CASE k WHEN 11 THEN '---/---' ELSE 'a ' || p || '/b' END ORDER BY seq) AS rows
    FROM (SELECT *, place - row_number() OVER (PARTITION BY doc ORDER BY seq) AS island FROM r WHERE kind = 'table') GROUP BY doc, island HAVING count(*) > 1)
SELECT doc, seq, role AS kind, CASE k WHEN 0 THEN 1 WHEN 16 THEN 3 END::INTEGER AS level, NULL::BIGINT AS number, CASE WHEN k = 0 THEN 'Uno ' WHEN k = 16 THEN 'Tres ' WHEN k = 6 THEN 'fuente ' WHEN k = 12 THEN 'cosa ' WHEN k = 3 THEN '*Titulo ' WHEN k = 4 THEN ' *Titulo ' ELSE 'texto ' END || p || CASE WHEN k IN (3, 4) THEN '*' ELSE '' END AS text, NULL AS title, NULL AS header, NULL AS cells
FROM r WHERE role IN ('heading', 'note', 'list', 'paragraph')
UNION ALL SELECT r.doc, r.seq, 'figure', NULL, c.number, 'f/' || r.p || '.png', c.title, NULL, NULL FROM r LEFT JOIN c ON c.doc = r.doc AND c.i = r.i AND c.text = 'Figura' WHERE r.role = 'figure'
UNION ALL SELECT g.doc, g.seq, 'table', NULL, c.number, NULL, c.title, rows[1], coalesce(array_to_string(rows[3:], '#'), '') FROM g LEFT JOIN c ON c.doc = g.doc AND c.i = g.i AND c.text = 'Tabla'
UNION ALL SELECT doc, seq, 'caption', NULL, number, text, title, NULL, NULL FROM c""")
def report_blocks(spark, sf_dir):
    found = parsing.report_blocks(rendered(spark, sf_dir, SHORT_DOC, REPORT_LINE))
    cells = F.array_join(F.transform("cells", lambda r: F.array_join(r, "/")), "#")
    return found.select("doc", "seq", "kind", "level", "number", "text", "title", F.array_join("header", "/").alias("header"), cells.alias("cells"))


@query("""WITH a AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS a, min(turn) FILTER (role = 'assistant') AS z FROM conversations GROUP BY 1)
SELECT conv_id, turn, role FROM conversations JOIN a USING (conv_id) WHERE turn >= coalesce(a, 0) AND (z IS NULL OR turn < z)""")
def section_slice(spark, sf_dir):
    stream = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), F.col("role").alias("line"))
    return parsing.slice_lines(stream, "user", "assistant").select(F.col("doc").alias("conv_id"), F.col("seq").alias("turn"), F.col("line").alias("role"))


@query(f"""WITH {PAIRS} SELECT conv_id, turn, 'quy_Latn' AS src_lang, 'spa_Latn' AS tgt_lang, a AS src_text, b AS tgt_text FROM pairs
UNION ALL SELECT conv_id, turn, 'spa_Latn', 'quy_Latn', b, a FROM pairs""")
def bidirectional_explode(spark, sf_dir):
    return align.both_directions(pairs(spark, sf_dir), "a", "b", ("quy_Latn", "spa_Latn"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k, coalesce(json_extract_string(props, '$.missing'), '?') AS missing FROM events")
def json_props(spark, sf_dir):
    got = F.from_json("props", "k bigint, missing string")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(got["k"], F.lit(-1)).alias("k"), F.coalesce(got["missing"], F.lit("?")).alias("missing"))


@query("""WITH old AS (SELECT quality AS k, count(*) AS v FROM labels GROUP BY 1), new AS (SELECT toxic + 1 AS k, count(*) * 10 AS v FROM labels GROUP BY 1)
SELECT coalesce(new.k, old.k)::INTEGER AS k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new ON old.k = new.k""")
def map_upsert(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    old = labels.groupBy(F.col("quality").alias("k")).agg(F.count("*").alias("v"))
    new = labels.groupBy((F.col("toxic") + 1).alias("k")).agg((F.count("*") * 10).alias("w"))
    return old.join(new, "k", "full").select("k", F.coalesce("w", "v").alias("v"))


# Retrieval, prompts


DISTANCE = "round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))), 6)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"SELECT e.vec_id AS id, {DISTANCE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {DISTANCE.replace('round(', '(').replace(', 6)', ')')}, e.vec_id LIMIT 8")
def knn_l2(spark, sf_dir):
    one = read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    return vector.search_one(_index(spark, sf_dir).drop("label"), one, 8).select("id", F.round("distance", 6).alias("distance"))


KNN = f"""n AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {DISTANCE} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE.replace('round(', '(').replace(', 6)', ')')}, e.vec_id) AS r
  FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q)"""


@query(f"WITH {KNN} SELECT query_id, r::INTEGER AS rank, id, distance FROM n WHERE r <= 5")
def knn_batch(spark, sf_dir):
    got = vector.search(_index(spark, sf_dir).drop("label"), _asked(spark, sf_dir), 5)
    return got.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {KNN.replace('PARTITION BY q.vec_id ORDER', 'PARTITION BY q.vec_id, e.label % 3 ORDER')}
SELECT query_id, string_agg(id, ',' ORDER BY r) FILTER (label % 3 = 0) AS zero, string_agg(id, ',' ORDER BY r) FILTER (label % 3 = 1) AS one, string_agg(id, ',' ORDER BY r) FILTER (label % 3 = 2) AS two, count(*) AS total
FROM n WHERE r <= 3 GROUP BY query_id""")
def knn_multi_index(spark, sf_dir):
    # Every label is in one of three indexes.
    index = _index(spark, sf_dir)
    parts = {name: index.where(F.col("label") % 3 == k).select("id", "vector") for k, name in enumerate(("zero", "one", "two"))}
    got = vector.retrieve(parts, _asked(spark, sf_dir), 3)
    ids = lambda c: F.array_join(F.transform(c, lambda r: F.get_json_object(r, "$.id")), ",").alias(c)
    return got.select("query_id", ids("zero"), ids("one"), ids("two"), "total")


@query(f"""WITH {PAIRS}, l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM pairs),
  x AS (SELECT conv_id, string_agg('- INGA: ' || a || chr(10) || '  ESPANOL: ' || b, chr(10) ORDER BY turn) FILTER (k <= 5) AS ex FROM l GROUP BY 1)
SELECT conv_id, '{T.PROMPT_EXAMPLES.strip()}' || chr(10) || ex || chr(10) || chr(10) || '{T.PROMPT_HEADS['inga2es']}:' || chr(10) || chr(10) || conv_id AS prompt FROM x""")
def prompt_build(spark, sf_dir):
    # Five of each conversation are kept before any are collected.
    first = pairs(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("k <= 5")
    found = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("a").alias("texto_inga"), F.col("b").alias("texto_es")))).alias("examples"))
    return found.select("conv_id", prompt.prompt(F.col("conv_id").cast("string"), "inga2es", examples=F.col("examples")).alias("prompt"))


# Metrics


def _gram_sql(kind: str, n: int) -> str:
    joined = f"list_transform(range(1, greatest(0, len({{0}}) - {n - 1}) + 1), lambda i: array_to_string({{0}}[i:i + {n - 1}], '{' ' if kind == 'w' else ''}'))"
    return f"""g{kind}{n} AS (SELECT conv_id, turn, side, g, count(*) AS c FROM (
    SELECT conv_id, turn, 'r' AS side, unnest({joined.format(kind + 'r')}) AS g FROM t UNION ALL SELECT conv_id, turn, 'h', unnest({joined.format(kind + 'h')}) FROM t) GROUP BY ALL),
  s{kind}{n} AS (SELECT coalesce(sum(least(rc, hc)), 0)::BIGINT AS m, coalesce(sum(hc), 0)::BIGINT AS h, coalesce(sum(rc), 0)::BIGINT AS r
    FROM (SELECT conv_id, turn, g, coalesce(sum(c) FILTER (side = 'r'), 0) AS rc, coalesce(sum(c) FILTER (side = 'h'), 0) AS hc FROM g{kind}{n} GROUP BY conv_id, turn, g))"""


GRAMS = f"WITH {PAIRS}, t AS (SELECT conv_id, turn, {_w('a')} AS wr, {_w('b')} AS wh, string_split(regexp_replace(a, '\\s+', '', 'g'), '') AS cr, string_split(regexp_replace(b, '\\s+', '', 'g'), '') AS ch FROM pairs)"


@query(GRAMS + ", " + ", ".join(_gram_sql("w", n) for n in (1, 2, 3, 4)) + " SELECT " + ", ".join(f"sw{n}.m AS m{n}, sw{n}.h AS h{n}, sw{n}.r AS r{n}" for n in (1, 2, 3, 4)) + " FROM sw1, sw2, sw3, sw4")
def bleu_statistics(spark, sf_dir):
    return metrics.ngram_statistics(pairs(spark, sf_dir), "a", "b", 4).drop("hyp_len", "ref_len")


@query(
    GRAMS + ", " + ", ".join(_gram_sql("w", n) for n in (1, 2, 3, 4))
    + """, p AS (SELECT unnest([1, 2, 3, 4]) AS n, unnest([sw1.m, sw2.m, sw3.m, sw4.m]) AS m, unnest([sw1.h, sw2.h, sw3.h, sw4.h]) AS h, sw1.h AS hl, sw1.r AS rl FROM sw1, sw2, sw3, sw4),
  z AS (SELECT *, power(2, count(*) FILTER (m = 0 AND h > 0) OVER (ORDER BY n)) AS smooth FROM p)
SELECT round(CASE WHEN max(m) = 0 THEN 0 ELSE (CASE WHEN max(hl) < max(rl) THEN exp(1 - max(rl)::DOUBLE / max(hl)) ELSE 1 END)
  * exp(sum(CASE WHEN h = 0 THEN 0 WHEN m = 0 THEN ln(100.0::DOUBLE / (smooth * h)) ELSE ln(m * 100.0::DOUBLE / h) END) / count(*) FILTER (h > 0)) END, 4) AS bleu FROM z"""
)
def bleu_corpus(spark, sf_dir):
    return metrics.bleu(pairs(spark, sf_dir), "a", "b", split="words").select(F.round("bleu", 4).alias("bleu"))


_CHRF = [f"CASE WHEN s{k}{n}.h > 0 AND s{k}{n}.r > 0 THEN coalesce(5 * (s{k}{n}.m::DOUBLE / s{k}{n}.h) * (s{k}{n}.m::DOUBLE / s{k}{n}.r) / nullif(4 * (s{k}{n}.m::DOUBLE / s{k}{n}.h) + s{k}{n}.m::DOUBLE / s{k}{n}.r, 0), 0) ELSE 0 END" for k, n in [("c", n) for n in range(1, 7)]]


@query(GRAMS + ", " + ", ".join(_gram_sql("c", n) for n in range(1, 7)) + " SELECT round(100 * (" + " + ".join(_CHRF) + ") / (" + " + ".join(f"(sc{n}.h > 0 AND sc{n}.r > 0)::INTEGER" for n in range(1, 7)) + "), 4) AS chrf FROM " + ", ".join(f"sc{n}" for n in range(1, 7)))
def chrf_corpus(spark, sf_dir):
    return metrics.chrf(pairs(spark, sf_dir), "a", "b", word_order=0).select(F.round("chrf", 4).alias("chrf"))


def _13a_sql(column: str) -> str:
    """Tokens as the mteval-13a tokenizer makes them."""
    x = column
    for pattern, by in (("<skipped>", ""), ("-\\n", ""), ("\\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    x = f"' ' || {x} || ' '"
    for pattern, by in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return _w(x)


def _apart_sql(column: str) -> str:
    """Words with the mark at their end (or else start) set apart."""
    mark = r"[!-/:-@\[-`{-~]"
    one = f"CASE WHEN length(t) = 1 THEN t WHEN regexp_matches(t, '{mark}$') THEN t[:-2] || ' ' || t[-1] WHEN regexp_matches(t, '^{mark}') THEN t[1] || ' ' || t[2:] ELSE t END"
    return _w(f"array_to_string(list_transform({_w(column)}, lambda t: {one}), ' ')")


def _sides_sql(words_of: Callable[[str], str]) -> str:
    return f"WITH {PAIRS}, t AS (SELECT conv_id, turn, {words_of('a')} AS wr, {words_of('b')} AS wh, string_split(regexp_replace(a, '\\s+', '', 'g'), '') AS cr, string_split(regexp_replace(b, '\\s+', '', 'g'), '') AS ch FROM pairs)"


def _f_sql(x: str) -> str:
    p, r = f"(s{x}.m::DOUBLE / s{x}.h)", f"(s{x}.m::DOUBLE / s{x}.r)"
    return f"CASE WHEN s{x}.h > 0 AND s{x}.r > 0 THEN coalesce(5 * {p} * {r} / nullif(4 * {p} + {r}, 0), 0) ELSE 0 END"


_BLEU_13A = ORACLE["bleu_corpus"].replace(GRAMS, _sides_sql(_13a_sql))
_ORDERS = [f"c{n}" for n in range(1, 7)] + ["w1", "w2"]
_CHRF_PP = (
    _sides_sql(_apart_sql) + ", " + ", ".join(_gram_sql(x[0], int(x[1])) for x in _ORDERS)
    + " SELECT round(100 * (" + " + ".join(map(_f_sql, _ORDERS)) + ") / (" + " + ".join(f"(s{x}.h > 0 AND s{x}.r > 0)::INTEGER" for x in _ORDERS) + "), 4) AS chrf FROM " + ", ".join(f"s{x}" for x in _ORDERS)
)


@query(_BLEU_13A)
def bleu_13a_corpus(spark, sf_dir):
    return metrics.bleu(pairs(spark, sf_dir), "a", "b").select(F.round("bleu", 4).alias("bleu"))


@query(_CHRF_PP)
def chrf_pp_corpus(spark, sf_dir):
    return metrics.chrf(pairs(spark, sf_dir), "a", "b").select(F.round("chrf", 4).alias("chrf"))


def token_vectors(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """A vector of embeddings for each word of both sides, by the word's hash."""
    index = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    tokens = found.select(F.explode(F.array_union(words(F.col("a")), words(F.col("b")))).alias("token")).distinct()
    # Vectors are numbered from 0.
    hashed = F.pmod(F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(index.count()))
    return tokens.withColumn("at", hashed).join(index, "at").select("token", "vector")


def _match_sql(idf: bool) -> str:
    weight = "ln(((SELECT count(*) FROM pairs) + 1)::DOUBLE / (coalesce(df, 0) + 1))" if idf else "1.0::DOUBLE"
    return f"""mt AS (SELECT conv_id, turn, side, w, count(*) AS n FROM (SELECT conv_id, turn, 'r' AS side, unnest({_w('a')}) AS w FROM pairs UNION ALL SELECT conv_id, turn, 'h', unnest({_w('b')}) FROM pairs) GROUP BY ALL),
  md AS (SELECT w, count(*) AS df FROM mt WHERE side = 'r' GROUP BY w),
  mv AS (SELECT conv_id, turn, side, w, n, {weight} AS weight, embedding::DOUBLE[] AS v FROM mt LEFT JOIN md USING (w) JOIN embeddings ON vec_id = ('0x' || md5(w)[1:8])::BIGINT % (SELECT count(*) FROM embeddings)),
  mb AS (SELECT x.conv_id, x.turn, x.side, x.n, x.weight, max(list_cosine_similarity(x.v, y.v)) AS best FROM mv x JOIN mv y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.side <> y.side GROUP BY x.conv_id, x.turn, x.side, x.w, x.n, x.weight),
  ms AS (SELECT conv_id, turn, side, sum(n * weight * best) / sum(n * weight) AS s FROM mb GROUP BY ALL),
  mf AS (SELECT pairs.conv_id, pairs.turn, coalesce(2 * p.s * r.s / nullif(p.s + r.s, 0), 0) AS f1 FROM pairs LEFT JOIN ms p ON p.conv_id = pairs.conv_id AND p.turn = pairs.turn AND p.side = 'h' LEFT JOIN ms r ON r.conv_id = pairs.conv_id AND r.turn = pairs.turn AND r.side = 'r')"""


@query(f"WITH {PAIRS}, {_match_sql(True)} SELECT count(*) AS pairs, round(avg(f1), 4) AS f1, round(min(f1), 4) AS least, round(max(f1), 4) AS most FROM mf")
def match_score_idf(spark, sf_dir):
    found = pairs(spark, sf_dir)
    scores = metrics.match_scores(found, "a", "b", token_vectors(spark, sf_dir, found), idf=True)
    return scores.agg(F.count("*").alias("pairs"), *[F.round(f("f1"), 4).alias(name) for f, name in ((F.avg, "f1"), (F.min, "least"), (F.max, "most"))])


@query(f"WITH {PAIRS}, {_match_sql(False)} SELECT bleu, chrf, bertscore FROM ({_BLEU_13A}), ({_CHRF_PP}), (SELECT round(avg(f1), 4) AS bertscore FROM mf)")
def all_metrics(spark, sf_dir):
    found = pairs(spark, sf_dir)
    return metrics.all_metrics(found, "a", "b", metrics.match_scores(found, "a", "b", token_vectors(spark, sf_dir, found)))


def _hashed(prompts: list[str], direction: str) -> list[str]:
    """A stand-in for a model: its answer is the prompt's hash."""
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


_ASKED = f"'{T.PROMPT_HEADS['inga2es']}:' || chr(10) || chr(10) || a"
_REFINED = f"{_ASKED} || chr(10) || chr(10) || '{T.PROMPT_DRAFT[0].strip()}' || chr(10) || md5({_ASKED}) || chr(10) || chr(10) || '{T.PROMPT_DRAFT[1]}'"


@query(f"WITH {PAIRS} SELECT conv_id, turn, md5({_ASKED}) AS draft, md5({_REFINED}) AS refined FROM pairs")
def draft_and_refine(spark, sf_dir):
    store = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    asked = pairs(spark, sf_dir).select("conv_id", "turn", prompt.prompt(F.col("a"), "inga2es").alias("ask"))
    drafts = adapters.answered(asked, "ask", "inga2es", _hashed, store, "draft")
    return adapters.refine(drafts, "ask", "draft", "inga2es", _hashed, store).select("conv_id", "turn", "draft", "refined")


PASSAGE = "array_to_string({0}[1:3], ' ')".format(_w("text"))


@query(f"""WITH a AS (SELECT {PASSAGE} AS alias, item_id FROM benchmark WHERE len({_w('text')}) >= 3)
SELECT doc_id, min(item_id) AS canonical FROM documents JOIN a ON contains(text, alias) GROUP BY doc_id""")
def passage_alias(spark, sf_dir):
    """The first benchmark item whose first three words a document holds."""
    first = F.slice(words(F.col("text")), 1, 3)
    aliases = read(spark, sf_dir, "benchmark").where(F.size(first) == 3).select(F.array_join(first, " ").alias("alias"), F.col("item_id").alias("canonical"), F.col("item_id").alias("place"))
    return align.first_alias(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", aliases).drop("text")


@query(f"""WITH {PAIRS} SELECT k AS index_name, text, turn::INTEGER AS versiculo FROM (SELECT 'ejemplos' AS k, a AS text, turn FROM pairs UNION ALL SELECT 'ejemplos_es', b, turn FROM pairs
UNION ALL SELECT 'lexico', trim(coalesce(a, '') || ' (user): ' || coalesce(b, '')), NULL FROM pairs)""")
def index_records(spark, sf_dir):
    found = pairs(spark, sf_dir)
    lexicon = found.select(F.col("a").alias("lema"), F.lit("user").alias("cat"), F.col("b").alias("glosa"))
    grammar = found.select(F.col("a").alias("text"), F.lit("x").alias("fuente"), F.col("turn").alias("chunk_id"))
    examples = found.select(F.col("a").alias("texto_inga"), F.col("b").alias("texto_es"), F.lit("x").alias("libro"), F.col("conv_id").alias("capitulo"), F.col("turn").alias("versiculo"))
    got = vector.index_records(lexicon, grammar, examples)
    rows = [got[k].select(F.lit(k).alias("index_name"), "text", got[k]["versiculo"] if k != "lexico" else F.lit(None).cast("int").alias("versiculo")) for k in ("ejemplos", "ejemplos_es", "lexico")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH {PAIRS} SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS idx, 'Constitucion' AS libro, conv_id AS capitulo, turn AS versiculo, a AS texto_inga, b AS texto_es, 'AP' AS dialecto, 'conversations' AS fuente FROM pairs""")
def finished_pairs(spark, sf_dir):
    found = pairs(spark, sf_dir).select(F.col("conv_id").alias("articulo"), F.col("turn").alias("sub_idx"), F.col("a").alias("texto_inga"), F.col("b").alias("texto_es"))
    return align.finished(found, "Constitucion", "AP", "conversations", ["articulo", "sub_idx"])


@query(f"""WITH {PAIRS}, l AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END AS config, CASE WHEN turn % 2 = 0 THEN 'inga2es' ELSE 'es2inga' END AS direction, len({_w('a')})::DOUBLE AS bleu, length(b)::DOUBLE AS chrf FROM pairs),
  c(config) AS (VALUES ('A'), ('B'), ('C'))
SELECT config, coalesce(max(bleu) FILTER (direction = 'inga2es'), 0) AS bleu_inga2es, coalesce(max(bleu) FILTER (direction = 'es2inga'), 0) AS bleu_es2inga,
  coalesce(max(chrf) FILTER (direction = 'inga2es'), 0) AS chrf_inga2es, coalesce(max(chrf) FILTER (direction = 'es2inga'), 0) AS chrf_es2inga FROM c LEFT JOIN l USING (config) GROUP BY config""")
def metrics_grid(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B").alias("config"), F.when(F.col("turn") % 2 == 0, "inga2es").otherwise("es2inga").alias("direction"), F.explode(F.create_map(F.lit("bleu"), word_count(F.col("a")).cast("double"), F.lit("chrf"), F.length("b").cast("double"))).alias("metric", "value"))
    return metrics.metrics_grid(rows, ["A", "B", "C"], ["bleu", "chrf"], ["inga2es", "es2inga"])


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def whitespace_collapse(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", collapse(F.col("text")).alias("text"))
