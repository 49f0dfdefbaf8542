"""Queries over papers that Spark makes of the given tables: each order is a resolution whose clauses are its line items,
each document a package, each part a style. The SQL says what must be found from how the papers are made."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import clauses as C
from quirelake.functions import numerals as N
from quirelake.functions import text as T
from quirelake.functions import treaty as Y
from quirelake.operators import audits as A
from quirelake.operators import evaluation as E
from quirelake.operators import folds as D
from quirelake.operators import layout as L
from quirelake.operators import names as M
from quirelake.operators import planning as P
from quirelake.operators import recognition as R
from quirelake.operators import sequences as S
from quirelake.operators import snapshots as X
from quirelake.operators.scratch import short_methods
from quirelake.plans.registry import query
from quirelake.plans.suites import LINES, NUMBERED, lines, numbered_rows, spread, table, tasks
from quirelake.sources import packages as K
from quirelake.sources.reference_tables import build_gazetteer

VOCABULARY = {"en": {"preambulatory": ["Recalling", "Noting"], "operative": ["Requests", "Decides", "Urges"]}, "zh": {"preambulatory": ["回顾"], "operative": ["决定"]}}

#: The papers in SQL: the clauses of each order, and all its paragraphs.
ITEMS = """i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, l_partkey FROM lineitem),
 c AS (SELECT doc_id, r, (r + 2) % 3 AS level, p_name, CASE (r + 2) % 3 WHEN 0 THEN ((r + 2) // 3) || '. ' WHEN 1 THEN '(a) ' ELSE '(ii) ' END AS marker, CASE (r + 2) % 3 WHEN 0 THEN 'Requests ' ELSE 'work on ' END || p_name AS body FROM i JOIN part ON l_partkey = p_partkey)"""
PAPERS = f"""{ITEMS}, o AS (SELECT o_orderkey AS doc_id, o_orderkey % 9 + 1 AS number, c_mktsegment || ' Council' AS committee, 'Plan ' || o_orderpriority AS topic, 'Republic of ' || n_name AS sponsor, 'Noting order ' || o_custkey AS preamble FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def papers(spark, sf_dir) -> DataFrame:
    """doc_id, para_idx, text: title, committee, topic, sponsors over two lines, subject, preamble and the clauses."""
    orders, customers, nations = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    o = orders.join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).join(M.bounded(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    head = F.array(
        F.concat(F.lit("Draft Resolution "), (F.col("o_orderkey") % 9 + 1).cast("string")), F.concat(F.lit("Committee: "), "c_mktsegment", F.lit(" Council")), F.concat(F.lit("Topic: Plan "), "o_orderpriority"),
        F.concat(F.lit("Sponsors: Republic of "), "n_name"), F.lit("Kingdom of Y, Republic of Z"), F.lit("The General Assembly,"), F.concat(F.lit("Noting order "), F.col("o_custkey").cast("string")),
    )
    top = o.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(head).alias("para_idx", "text"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    level = (F.col("r") + 2) % 3
    marker = F.when(level == 0, F.concat(F.floor((F.col("r") + 2) / 3).cast("string"), F.lit(". Requests "))).when(level == 1, "(a) work on ").otherwise("(ii) work on ")
    return top.union(items.select(F.col("l_orderkey").alias("doc_id"), (F.col("r") + 6).alias("para_idx"), F.concat(marker, "p_name").alias("text")))


def paper_rows(spark, sf_dir) -> int:
    return 7 * table(spark, sf_dir, "orders").count() + table(spark, sf_dir, "lineitem").count()


def headed(spark, sf_dir) -> DataFrame:
    short_methods(spark)
    # texts are judged behind the shuffle, so that only they travel
    return R.header(spread(papers(spark, sf_dir), paper_rows(spark, sf_dir), "doc_id"), "draft-resolution", VOCABULARY)


def classified(spark, sf_dir) -> DataFrame:
    return R.clauses(headed(spark, sf_dir), "draft-resolution", VOCABULARY)


@query(f"""WITH {PAPERS} SELECT doc_id, 'Draft Resolution ' || number AS title, committee, topic, sponsor || '|Kingdom of Y|Republic of Z' AS sponsors, 'en' AS language FROM o""")
def recognised_fields(spark, sf_dir):
    m = R.models(headed(spark, sf_dir))
    return m.select("doc_id", "title", "committee", "topic", F.array_join("sponsors", "|").alias("sponsors"), "language")


@query(f"""WITH {PAPERS} SELECT doc_id, 5 AS para_idx, 'heading' AS kind, 0 AS level, 1.0::DOUBLE AS confidence, 'The General Assembly,' AS text FROM o UNION ALL SELECT doc_id, 6, 'preambulatory', 0, CASE WHEN doc_id IN (SELECT doc_id FROM c) THEN 0.98 ELSE 0.94 END, preamble FROM o UNION ALL SELECT doc_id, r + 6, 'operative', level, 0.98, body FROM c""")
def classify_paragraphs(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "kind", F.col("level").cast("long").alias("level"), "confidence", "text")


@query(f"""WITH {PAPERS} SELECT o.doc_id, coalesce(max(level), 0) + 1 AS levels FROM o LEFT JOIN c ON o.doc_id = c.doc_id GROUP BY 1""")
def max_level(spark, sf_dir):
    m = R.max_level(classified(spark, sf_dir))
    return m.select("doc_id", F.col("levels").cast("long").alias("levels"))


@query(f"""WITH {PAPERS}, r AS (SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS para_idx, unnest(['title', 'committee', 'topic', 'sponsors', 'header', 'subject', 'preamble']) AS role, 0 AS level, false AS operative FROM o UNION ALL SELECT doc_id, r + 6, 'item', level, true FROM c) SELECT * FROM r""")
def assign_roles(spark, sf_dir):
    out = R.document_roles(headed(spark, sf_dir), "draft-resolution", VOCABULARY)
    return out.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "role", F.col("level").cast("long").alias("level"), "operative")


def paper_roles(spark, sf_dir) -> DataFrame:
    """Roles as the papers are made, without recognition."""
    p = papers(spark, sf_dir)
    names = F.array(*map(F.lit, ("title", "committee", "topic", "sponsors", "header", "subject", "preamble")))
    item = F.col("para_idx") > 6
    return p.select(
        "doc_id", "para_idx", F.when(item, "item").otherwise(F.get(names, F.col("para_idx"))).alias("role"), F.when(item, (F.col("para_idx") - 4) % 3).otherwise(0).cast("int").alias("level"), item.alias("operative"), "text", F.lit("en").alias("language")
    )


@query(f"""WITH {PAPERS}, e AS (SELECT doc_id, r, marker || body AS before, CASE WHEN lead(level) OVER w IS NULL THEN '.' WHEN lead(level) OVER w > level THEN ':' ELSE ';' END AS mark FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY r))
 SELECT doc_id, 1 AS para_idx, 'label-drop' AS kind, 'Committee: ' || committee AS before, committee AS after FROM o UNION ALL SELECT doc_id, 2, 'label-drop', 'Topic: ' || topic, topic FROM o UNION ALL SELECT doc_id, 6, 'ending', preamble, preamble || ',' FROM o UNION ALL SELECT doc_id, r + 6, 'ending', before, before || mark FROM e""")
def plan_edits(spark, sf_dir):
    return P.plan_edits(paper_roles(spark, sf_dir), "draft-resolution").select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "kind", "before", "after")


@query(f"""WITH {PAPERS}, e AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) SELECT o.doc_id, 3 + coalesce(n, 0) AS edits, 0::BIGINT AS again FROM o LEFT JOIN e ON o.doc_id = e.doc_id""")
def idempotence(spark, sf_dir):
    """Edits of a first plan, and those that a second would still make."""
    short_methods(spark)
    made = F.size(F.filter("edits", lambda e: e.reason.isNull())).cast("long")
    # both plans in one pass: a paragraph keeps its edits, so nothing is written between them or joined back
    first = P.planned_rows(spread(paper_roles(spark, sf_dir), paper_rows(spark, sf_dir), "doc_id"), "draft-resolution")
    again = P.planned_rows(P.applied_rows(first.withColumn("_made", made)).drop("edits"), "draft-resolution")
    return again.groupBy("doc_id").agg(F.sum("_made").alias("edits"), F.sum(made).alias("again"))


@query(f"""WITH {ITEMS} SELECT doc_id, r AS idx, level AS planned_level, '' AS reason FROM c""")
def plan_hierarchy(spark, sf_dir):
    p = papers(spark, sf_dir).where("para_idx > 6")
    m = N.marker_of(F.col("text"))
    p = p.withColumn("family", m["family"])
    items = p.select("doc_id", (F.col("para_idx") - 6).alias("idx"), "text", "family", F.lit(0).alias("level"), F.lit(None).cast("string").alias("list_key"), (F.col("family") == "decimal").alias("top"), F.lit(False).alias("reset"))
    out = D.plan_hierarchy(items, "en")
    return out.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("planned_level").cast("long").alias("planned_level"), "reason")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' and ' || r_name || '|' || c_mktsegment ELSE n_name || '|' || r_name || '|' || c_mktsegment END AS parties FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def treaty_parties(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(M.bounded(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    pair = F.concat("n_name", F.lit(" and "), "r_name")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).join(M.bounded(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    titles = o.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(F.concat(F.lit("Agreement between "), pair, F.lit(" and "), "c_mktsegment", F.lit(" on Trade")), F.lit("The parties agree."))).alias("para_idx", "text"))
    known = M.name_index(nations.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id"), pair.alias("display")), ["display"])
    return R.split_parties(R.treaty_heads(R.titles(spread(titles, 2 * table(spark, sf_dir, "orders").count(), "doc_id"))), known).select("doc_id", F.array_join("parties", "|").alias("parties"))


@query("""SELECT c_mktsegment, string_agg(d, ', ' ORDER BY lower(d), pos) AS names, count(*) FILTER (WHERE d <> name) AS changed, any_value(total) - count(*) AS removed FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM (SELECT c_mktsegment, c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, n_name AS d, row_number() OVER (PARTITION BY c_mktsegment, n_nationkey ORDER BY c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WINDOW w AS (PARTITION BY c_mktsegment)) WHERE k = 1 GROUP BY 1""")
def plan_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    index = M.name_index(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("display")), ["display"])
    c = table(spark, sf_dir, "customer").join(M.bounded(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    values = c.select("c_mktsegment", F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    out = M.plan_names(values, index, ["c_mktsegment"], "pos", M.sort_key(F.col("display"), "en"))
    return out.withColumn("names", F.array_join("names", ", "))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, n_name, s_suppkey % 4 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT s_nationkey, s_suppkey, CASE WHEN k = 0 THEN 'Near ' || n_name WHEN k = 1 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN k = 0 THEN 'unknown' WHEN s_nationkey % 6 = 1 THEN 'historical' WHEN s_nationkey % 6 = 2 THEN 'ambiguous' WHEN s_nationkey % 6 = 3 THEN 'entity' ELSE 'resolved' END AS status FROM s) SELECT s_nationkey, name, status, min(s_suppkey) AS pos FROM r WHERE status <> 'resolved' GROUP BY ALL""")
def name_warnings(spark, sf_dir):
    """Nations of suppliers: some under review, some of two records, some entities, and some that no record has."""
    nation, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    kind = F.when(k % 6 == 3, "observer-state").otherwise("member-state")
    twice = F.when(k % 6 == 2, F.array(k, k + 1000)).otherwise(F.array(k))
    index = M.name_index(nation.select(F.explode(twice).alias("id"), F.col("n_name").alias("display"), kind.alias("kind")), ["display"])
    review = nation.where(k % 6 == 1).select(M.name_key(F.col("n_name")).alias("key"), F.lit("historical").alias("listed"))
    s = table(spark, sf_dir, "supplier").join(M.bounded(nation), F.col("s_nationkey") == k)
    q = F.col("s_suppkey") % 4
    names = s.select("s_nationkey", F.col("s_suppkey").alias("pos"), F.when(q == 0, F.concat(F.lit("Near "), "n_name")).when(q == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    return M.name_warnings(M.resolve_names(names, index, review=review), ["s_nationkey"], "pos").select("s_nationkey", "name", "status", "pos")


@query("""WITH n AS (SELECT n_nationkey, n_name, r_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_name AS formal_en, CASE WHEN k % 3 = 0 THEN NULL ELSE n_nationkey::VARCHAR END AS id FROM n""")
def build_gazetteer_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("k", F.row_number().over(Window.orderBy("n_nationkey")))
    names = n.select(F.concat(F.lit("The "), "n_name").alias("formal_en"), F.when(F.col("k") % 3 == 1, F.concat(F.lit(" the "), F.lower("n_name"))).alias("short_en"), F.when(F.col("k") % 3 == 2, F.concat(F.lit("中"), F.col("n_nationkey").cast("string"))).alias("short_zh"))
    geography = n.where("k % 3 <> 0").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("k") % 3 == 1, F.col("n_name")).otherwise(F.lit("-")).alias("name_en"), F.concat(F.lit("中"), F.col("n_nationkey").cast("string")).alias("name_zh"))
    return build_gazetteer(names, geography).select("formal_en", "id")


@query(f"""WITH {PAPERS}, f AS (SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_returnflag = 'R') AS e, count(*) AS k FROM lineitem GROUP BY 1)
 SELECT o.doc_id, CASE WHEN k IS NULL THEN 'not_run' WHEN e > 0 THEN 'failed' ELSE 'checked' END AS status, CASE WHEN o.doc_id % 2 = 0 THEN 'sponsor' ELSE '' END AS missing, coalesce(n, 0) AS clauses, coalesce(k, 0) AS findings FROM o LEFT JOIN f ON o.doc_id = f.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) m ON o.doc_id = m.doc_id""")
def diagnostic_documents(spark, sf_dir):
    """Orders as documents, their items as clauses and as findings."""
    papers_ = papers(spark, sf_dir)
    models = papers_.groupBy("doc_id").agg(F.lit("draft").alias("doc_type"), F.count("*").alias("paragraphs"), F.max(F.when(F.col("para_idx") == 1, F.col("text"))).alias("committee"), F.max(F.when((F.col("para_idx") == 3) & (F.col("doc_id") % 2 == 1), F.col("text"))).alias("sponsor"))
    clauses = papers_.where("para_idx > 6").select("doc_id", "para_idx", F.lit("operative").alias("kind"), F.lit(0).alias("level"), F.lit(0.98).alias("confidence"), "text")
    findings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("code"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("status"), F.col("l_returnflag").alias("detail"))
    required = spark.createDataFrame([("draft", "committee"), ("draft", "sponsor")], "doc_type string, field string")
    out = E.diagnostic_documents(models, clauses, findings, required)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.select("doc_id", "status", F.array_join("missing", ",").alias("missing"), size("clauses").alias("clauses"), size("findings").alias("findings"))


@query("""SELECT o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN 'OK' ELSE 'FAILED' END AS status, CASE o_orderkey % 4 WHEN 1 THEN 'invalid-package' WHEN 2 THEN 'protected' WHEN 3 THEN 'format' END AS error, count(*) AS n, any_value(f) AS failures FROM (SELECT *, count(*) FILTER (WHERE o_orderkey % 4 <> 0) OVER (PARTITION BY o_orderpriority) AS f FROM orders) GROUP BY 1, 2, 3""")
def error_ledger(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    error = F.when(k == 1, "invalid-package").when(k == 2, "protected").when(k == 3, "format")
    return E.error_ledger(table(spark, sf_dir, "orders").withColumn("error", error), "o_orderpriority", "error")


# --- functions over the given names


@query("""SELECT c_custkey, c_custkey % 40 + 1 AS n, CASE WHEN c_custkey % 3 = 0 THEN false ELSE true END AS valid FROM customer""")
def marker_changes(spark, sf_dir):
    n = (F.col("c_custkey") % 40 + 1).cast("int")
    before = F.concat(N.marker_text("en", 0, n), F.lit(" "), "c_name", F.lit("；"))
    other = F.when(F.col("c_custkey") % 3 == 0, n + 1).otherwise(n)
    after = F.concat(N.marker_text("zh", 1, other), F.lit(" "), "c_name", F.lit("。"))
    return table(spark, sf_dir, "customer").select("c_custkey", n.cast("long").alias("n"), N.valid_marker_change(before, after).alias("valid"))


@query(f"""WITH {LINES} SELECT doc_id, para_idx, regexp_replace(regexp_replace(text, '[ \\t\\n]+$', ''), '[，,；;。.:：、]+$', '') AS bare, CASE WHEN regexp_matches(regexp_replace(regexp_replace(text, '[ \\t\\n]+$', ''), '[，,；;。.:：、]+$', ''), '[^\\s\\x0B\\x1C-\\x1F\\x{{0085}}\\p{{Z}}]') THEN regexp_replace(regexp_replace(text, '[ \\t\\n]+$', ''), '[，,；;。.:：、]+$', '') || '；' ELSE text END AS ended FROM lines""")
def line_endings(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "para_idx", T.without_ending(F.col("text")).alias("bare"), T.set_ending(F.col("text"), "；").alias("ended"))


@query("""SELECT c_custkey, 'WP S' || (c_custkey % 4) || ' ' || c_name || '-x v1.docx' AS file FROM customer""")
def output_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = T.output_name("working-paper", F.lit("en"), F.concat(F.lit("the "), "c_name", F.lit("/x")), F.concat(F.lit("S"), (k % 4).cast("string")), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("file"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name END AS country, CASE WHEN s_suppkey % 2 = 0 THEN 'Draft Resolution' END AS title_word, CASE WHEN s_suppkey % 2 = 0 THEN ' ' || (s_suppkey % 7) END AS title_rest, s_name || '|' || s_suppkey AS names, lower(s_name) AS party, 'Treaty between ' || s_name || ' and B on X' AS title FROM supplier""")
def field_functions(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.col("s_name")
    label = F.when(k % 3 == 0, "Country: ").when(k % 3 == 1, "").otherwise("Topic: ")
    title = T.title_parts(F.concat(F.when(k % 2 == 0, "Draft Resolution ").otherwise("A Draft Resolution "), (k % 7).cast("string")), "draft-resolution")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", C.country_field_value(F.concat(label, name)).alias("country"), title["word"].alias("title_word"), title["rest"].alias("title_rest"), F.array_join(T.split_names(F.concat(name, F.lit(" ，, "), k.cast("string"))), "|").alias("names"),
        Y.party_key(Y.label_party(F.concat(F.lit("Representative of the "), name), "en")).alias("party"), Y.treaty_title("Treaty", F.array(name, F.lit("B")), F.lit("X"), "en").alias("title"),
    )


@query("""WITH v AS (SELECT p_partkey, p_partkey % 7 AS k, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 50 || '. ' WHEN 1 THEN '(a) ' ELSE '' END AS marker FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'Calls upon' WHEN 1 THEN 'CALLS UPON' WHEN 2 THEN 'Calls' WHEN 4 THEN 'Requests' WHEN 5 THEN 'calls' END AS phrase, CASE WHEN k NOT IN (3, 6) THEN length(marker) END AS start, CASE k WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 4 THEN 8 WHEN 5 THEN 5 END AS length FROM v""")
def verb_spans(spark, sf_dir):
    """The opening phrase behind a marker, the longest that ends with a word, in the text's own letters."""
    k = F.col("p_partkey")
    opening = F.get(F.array(*map(F.lit, ("Calls upon", "CALLS UPON", "Calls uponly", "Callsign", "Requests", "calls, upon", "Further calls"))), (k % 7).cast("int"))
    marker = F.when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit(". "))).when(k % 3 == 1, "(a) ").otherwise("")
    found = C.longest_phrase(F.concat(marker, opening, F.lit(" "), "p_name"), ["Calls", "Calls upon", "Requests"])
    return table(spark, sf_dir, "part").select("p_partkey", found["phrase"].alias("phrase"), found["start"].cast("long").alias("start"), found["length"].cast("long").alias("length"))


# --- audits


@query(f"""WITH {LINES} SELECT doc_id, para_idx AS block FROM lines WHERE text <> '' AND (doc_id + para_idx) % 5 = 0""")
def marks_audit(spark, sf_dir):
    """Marked texts of which every fifth loses its last character."""
    p = lines(spark, sf_dir).select("doc_id", F.col("para_idx").alias("block"), F.lit(0).alias("idx"), "text", F.lit(True).alias("hidden"))
    cut = (F.col("doc_id") + F.col("block")) % 5 == 0
    after = p.withColumn("text", F.when(cut, F.substr("text", F.lit(1), F.length("text") - 1)).otherwise(F.concat(F.lit("+"), "text")))
    return L.marks_audit(p, after, "hidden")


@query(f"""WITH {LINES} SELECT doc_id, para_idx, 0 AS start FROM lines WHERE length(text) > 3 AND para_idx % 2 = 1""")
def verb_coverage(spark, sf_dir):
    """Lines set in two runs of which the second is styled in even lines only."""
    p = lines(spark, sf_dir).where(F.length("text") > 3)
    spans = p.select("doc_id", "para_idx", F.lit(0).alias("start"), F.length("text").alias("length"))
    runs = p.select("doc_id", "para_idx", F.explode(F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("len"), F.lit(True).alias("b")), F.struct(F.lit(3).alias("start"), (F.length("text") - 3).alias("len"), (F.col("para_idx") % 2 == 0).alias("b")))).alias("x"))
    return L.verb_coverage(spans, runs.select("doc_id", "para_idx", "x.*"), F.col("b"))


@query("""WITH s AS (SELECT * FROM (VALUES ('A', 'O', 20, 300), ('N', 'O', 30, 300), ('R', 'F', 10, 320)) t(role, jc, indent, pitch)), j AS (SELECT l_orderkey AS doc_id, l_linenumber AS para_idx, l_linestatus <> jc AS a, abs(l_quantity - indent) > 10 AS b, abs(l_tax * 1000 + 280 - pitch) > 10 AS c FROM lineitem JOIN s ON l_returnflag = role) SELECT doc_id, para_idx, 'alignment' AS code FROM j WHERE a UNION ALL SELECT doc_id, para_idx, 'indent' FROM j WHERE b UNION ALL SELECT doc_id, para_idx, 'pitch' FROM j WHERE c""")
def geometry_audit(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("para_idx"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("jc"), F.col("l_quantity").alias("indent"), (F.col("l_tax") * 1000 + 280).alias("pitch"))
    spec = spark.createDataFrame([("A", "O", 20, 300), ("N", "O", 30, 300), ("R", "F", 10, 320)], "role string, jc string, indent int, pitch int")
    return L.geometry_audit(p, spec)


@query("""SELECT o_orderkey AS request, CASE o_orderkey % 6 WHEN 0 THEN 'evil_field' WHEN 1 THEN 'language' WHEN 2 THEN 'sponsors' WHEN 3 THEN 'topic' END AS field, CASE o_orderkey % 6 WHEN 0 THEN 'unknown-field' WHEN 1 THEN 'bad-language' WHEN 2 THEN 'list-too-long' WHEN 3 THEN 'invalid-text' END AS error FROM orders WHERE o_orderkey % 6 < 4""")
def override_errors(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    field = F.when(k == 0, "evilField").when(k == 1, "language").when(k == 2, "sponsors").otherwise("topic")
    values = F.when(k == 2, F.transform(F.sequence(F.lit(1), F.lit(301)), lambda i: i.cast("string"))).when(k == 3, F.array(F.concat("o_orderpriority", F.lit("\x01")))).otherwise(F.array("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), field.alias("field"), values.alias("values"))
    return L.validate_overrides(rows, ["sponsors", "signatories"], ["committee", "topic"])


@query(f"""WITH {LINES} SELECT doc_id, para_idx, unnest([0, 1]) AS occurrence, unnest(['（一）', '（子）']) AS marker FROM lines""")
def embedded_markers(spark, sf_dir):
    p = lines(spark, sf_dir).withColumn("text", F.concat(F.lit("决定：（一）"), F.translate("text", "：:；;", ""), F.lit("；（子）x")))
    return L.embedded_markers(p)


@query("""WITH s AS (SELECT p_partkey // 10 AS doc_id, p_partkey AS style, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size FROM part) SELECT doc_id, style::VARCHAR AS style, last_value(size IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY style ROWS UNBOUNDED PRECEDING) AS size FROM s""")
def style_properties(spark, sf_dir):
    """Each part a style that is based on the part before it."""
    k = F.col("p_partkey")
    styles = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("doc_id"), k.cast("string").alias("style"), F.when(k % 10 != 0, (k - 1).cast("string")).alias("based_on"), F.when(k % 3 == 0, F.col("p_size")).alias("size"))
    return L.resolve_styles(styles, ["size"])


@query("""WITH l AS (SELECT page_id::VARCHAR AS doc_id, i::VARCHAR AS id, t AS target, (page_id + i) % 7 AS k FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages), LATERAL (SELECT unnest(a) AS t, generate_subscripts(a, 1) AS i)) SELECT doc_id, 'page' AS part, id, CASE WHEN k = 0 THEN 'removed' ELSE 'changed' END AS kind FROM l WHERE k < 2""")
def relationship_changes(spark, sf_dir):
    """The links of each page as relationships, of which some change and some take another id."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    r = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("i", "target"))
    k = (F.col("page_id") + F.col("i") + 1) % 7
    before = r.select(F.col("page_id").cast("string").alias("doc_id"), F.lit("page").alias("part"), (F.col("i") + 1).cast("string").alias("id"), F.lit("link").alias("type"), "target", F.lit("Internal").alias("mode"), k.alias("k"))
    after = before.withColumns({"id": F.when(F.col("k") == 0, F.concat(F.lit("new"), "id")).otherwise(F.col("id")), "target": F.when(F.col("k") == 1, F.concat("target", F.lit("#"))).otherwise(F.col("target"))})
    return K.relationship_diff(before, after)


@query("""WITH v AS (SELECT o_orderpriority AS variant, round(avg(o_totalprice), 2) AS mean_excess FROM orders GROUP BY 1) SELECT variant, mean_excess, row_number() OVER (ORDER BY mean_excess DESC, variant) AS rank FROM v""")
def worst_variants(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("variant")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_excess"))
    return P.worst_variants(v).select("variant", "mean_excess", F.col("rank").cast("long").alias("rank"))


@query("""SELECT doc_id AS "case", NOT (doc_id % 4 = 0) AS preserved, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS passed FROM documents WHERE text IS NOT NULL""")
def stress_verdict(spark, sf_dir):
    k, text = F.col("doc_id"), F.col("text")
    sign = lambda t: F.sha2(T.visible_signature(t).cast("binary"), 256)
    after = F.when(k % 4 == 0, F.concat(text, F.lit("!"))).otherwise(F.concat(F.lit(" "), F.upper(text), F.lit("\n")))
    same = F.when(k % 4 == 0, sign(after)).otherwise(sign(F.concat(F.lit(" "), text)))
    cases = table(spark, sf_dir, "documents").where("text is not null").select(k.alias("case"), F.when(k % 3 == 0, 1).otherwise(0).alias("errors"), sign(text).alias("signature_before"), same.alias("signature_after"), F.when(k % 5 == 0, 2).otherwise(0).alias("noise"))
    return P.stress_verdict(cases).select("case", "preserved", "passed")


@query("""WITH n AS (SELECT l_orderkey, l_partkey AS name_id, l_quantity AS at FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT l_orderkey, l_suppkey AS label_id, l_quantity AS at FROM lineitem WHERE l_returnflag = 'R'), j AS (SELECT DISTINCT n.l_orderkey, name_id, n.at AS name_at, label_id, abs(n.at - b.at) AS distance FROM n JOIN b USING (l_orderkey))
 SELECT l_orderkey, name_id, label_id, distance FROM j QUALIFY row_number() OVER (PARTITION BY l_orderkey, name_id ORDER BY distance, label_id) = 1""")
def nearest_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    names = li.where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_partkey").alias("name_id"), F.col("l_quantity").alias("name_at"))
    labels = li.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_suppkey").alias("label_id"), F.col("l_quantity").alias("label_at"))
    return M.nearest_candidates(names, labels, ["l_orderkey"]).select("l_orderkey", "name_id", "label_id", "distance")


@query("""WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation), r AS (SELECT r_regionkey, r_regionkey % 3 AS kind FROM region) SELECT n_regionkey::BIGINT AS doc_id, k AS pos, n_name || '代表' AS label, CASE WHEN kind = 0 THEN lower(n_name) END AS name, false AS ambiguous FROM n JOIN r ON n_regionkey = r_regionkey WHERE kind < 2 UNION ALL SELECT r_regionkey, 0, NULL, NULL, true FROM r WHERE kind = 2""")
def signature_blocks(spark, sf_dir):
    """The nations of a region as representatives: all named, none named, or named before any label."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    kind = F.col("doc_id") % 3
    at = F.transform("x", lambda _, i: i.cast("double"))
    line = lambda idx, is_label, tokens: F.struct(idx.alias("idx"), F.lit(is_label).alias("is_label"), tokens.alias("tokens"), at.alias("centres"))
    labels = line(F.lit(1), True, F.transform("x", lambda a: F.concat(a.n_name, F.lit("代表"))))
    names = line(F.when(kind == 2, 0).otherwise(2), False, F.transform("x", lambda a: F.lower(a.n_name)))
    rows = n.select("doc_id", F.explode(F.when(kind == 1, F.array(labels)).otherwise(F.array(labels, names))).alias("l")).select("doc_id", "l.*")
    return D.read_signature_block(rows).select("doc_id", F.col("pos").cast("long").alias("pos"), "label", "name", "ambiguous")


@query(f"""WITH {LINES}, f AS (SELECT doc_id, para_idx, 'blank' AS code, NULL::VARCHAR AS status FROM lines WHERE NOT regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x{{0085}}\\p{{Z}}]') UNION ALL SELECT doc_id, NULL, 'few-characters', 'warning' FROM documents WHERE n_chars < 100) SELECT code, status, count(*) AS n, count(para_idx) AS placed FROM f GROUP BY ALL""")
def union_findings(spark, sf_dir):
    blank = lines(spark, sf_dir).where(~F.col("text").rlike(r"(?U)\S")).select("doc_id", "para_idx", F.lit("blank").alias("code"))
    short = table(spark, sf_dir, "documents").where("n_chars < 100").select("doc_id", F.lit("few-characters").alias("code"), F.lit("warning").alias("status"))
    return A.union_findings(blank, short).groupBy("code", "status").agg(F.count("*").alias("n"), F.count("para_idx").alias("placed"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey, l_linenumber AS r, l_partkey, l_suppkey, l_quantity, l_returnflag, o_orderkey % 11 = 0 AS ba, o_orderkey % 13 = 0 AS bb FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) ON o_orderkey = l_orderkey), f AS (SELECT * FROM a WHERE NOT ba AND NOT bb)
 SELECT DISTINCT k, NULL::INT AS r, 'blocked' AS kind, ba::VARCHAR AS in_a, bb::VARCHAR AS in_b FROM a WHERE ba <> bb UNION ALL SELECT k, r, 'missing', NULL, NULL FROM f WHERE l_partkey % 7 = 0 UNION ALL SELECT k, r + 1000, 'extra', NULL, NULL FROM f WHERE l_partkey % 7 = 0 UNION ALL SELECT k, r, 'flag', l_returnflag, l_returnflag || '!' FROM f WHERE l_partkey % 7 <> 0 AND l_suppkey % 5 = 0 UNION ALL SELECT k, r, 'size', NULL, l_suppkey::VARCHAR FROM f WHERE l_partkey % 7 <> 0 AND l_suppkey % 3 = 0""")
def compare_runs(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    n = lineitem.count()
    # minima of texts are taken from sorted rows: the same sort serves the join with orders
    li = spread(lineitem, n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")])
    o = table(spark, sf_dir, "orders").join(li.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    k, s = F.col("o_orderkey"), F.col("l_suppkey")
    a = o.select(k.alias("k"), F.col("l_linenumber").alias("r"), F.col("l_returnflag").alias("flag"), F.when(s % 3 != 0, s).alias("size"), (k % 11 == 0).alias("blocked"))
    b = o.select(k.alias("k"), F.when(F.col("l_partkey") % 7 == 0, F.col("l_linenumber") + 1000).otherwise(F.col("l_linenumber")).alias("r"), F.when(s % 5 == 0, F.concat("l_returnflag", F.lit("!"))).otherwise(F.col("l_returnflag")).alias("flag"), s.alias("size"), (k % 13 == 0).alias("blocked"))
    return X.compare_runs(a, b, "k", "r", ["flag", "size"], parts=tasks(spark, n))


@query(f"""WITH {NUMBERED}, l AS (SELECT *, level % 3 AS lv FROM n), c AS (SELECT a.l_orderkey, a.idx, a.list_key, a.lv, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM l q WHERE q.l_orderkey = a.l_orderkey AND q.list_key = a.list_key AND q.lv < a.lv AND q.idx > b.idx AND q.idx < a.idx)) AS number FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.list_key = b.list_key AND a.lv = b.lv AND b.idx <= a.idx GROUP BY ALL),
 w AS (SELECT *, coalesce(last_value(CASE WHEN lv = 0 THEN number END IGNORE NULLS) OVER u, 1) AS n0, coalesce(last_value(CASE WHEN lv = 1 THEN number END IGNORE NULLS) OVER u, 1) AS n1, coalesce(last_value(CASE WHEN lv = 2 THEN number END IGNORE NULLS) OVER u, 1) AS n2 FROM c WINDOW u AS (PARTITION BY l_orderkey, list_key ORDER BY idx ROWS UNBOUNDED PRECEDING))
 SELECT l_orderkey, idx, CASE lv WHEN 0 THEN n0 || '.' WHEN 1 THEN n0 || '.' || chr(96 + n1::INT) ELSE n0 || '.' || chr(96 + n1::INT) || '(0' || n2 || ')' END AS label FROM w""")
def list_texts(spark, sf_dir):
    """Numbers of several levels in one label: 2., 2.a, 2.a(03)."""
    rows = numbered_rows(spark, sf_dir).withColumn("level", F.col("level") % 3)
    labelled = S.list_labels(rows, ["l_orderkey"], "idx", "list_key", "level")
    labelled = labelled.withColumns({"lvl_text": F.get(F.array(F.lit("%1."), F.lit("%1.%2"), F.lit("%1.%2(%3)")), F.col("level")), "formats": F.array(F.lit("decimal"), F.lit("lowerLetter"), F.lit("decimalZero"))})
    out = S.list_texts(labelled, ["l_orderkey"], "idx", "list_key", "level", "lvl_text", "formats")
    return out.select("l_orderkey", F.col("idx").cast("long").alias("idx"), "label")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, min(para_idx) AS first FROM lines WHERE para_idx % 5 = 3 GROUP BY 1) SELECT lines.doc_id, para_idx, coalesce(para_idx >= first, false) AS in_references FROM lines LEFT JOIN s ON lines.doc_id = s.doc_id""")
def reference_section(spark, sf_dir):
    p = lines(spark, sf_dir).withColumn("text", F.when(F.col("para_idx") % 5 == 3, F.concat(F.lit(" [1] "), "text")).otherwise(F.concat(F.lit("x"), "text")))
    return S.reference_section(p).select("doc_id", "para_idx", "in_references")


@query("""WITH n AS (SELECT conv_id, max(turn) AS last, count(*) AS k FROM conversations GROUP BY 1) SELECT conv_id AS doc_id, turn AS start FROM conversations JOIN n USING (conv_id) WHERE turn = greatest(last - 2, 0) AND k > 0""")
def signature_starts(spark, sf_dir):
    """The last three turns of a conversation as the lines of a closing block."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_idx"), F.lit("line").alias("text"), F.max("turn").over(Window.partitionBy("conv_id")).alias("last"))
    return S.signature_start(c, F.col("para_idx") > F.col("last") - 3)


@query(f"""WITH {ITEMS} SELECT doc_id, r + 6 AS para_idx FROM c WHERE level = 1 AND EXISTS (SELECT 1 FROM c d WHERE d.doc_id = c.doc_id AND d.r = c.r + 1)""")
def dropped_items(spark, sf_dir):
    """Second-level clauses without their marker between a line that ends in a colon and a numbered one."""
    p = papers(spark, sf_dir).where("para_idx > 6")
    level = (F.col("para_idx") - 4) % 3
    p = p.withColumn("text", F.when(level == 0, F.concat("text", F.lit(":"))).when(level == 1, F.regexp_replace("text", r"^\(a\) ", "")).otherwise(F.col("text")))
    return S.suspect_dropped_items(p, ["doc_id"], "para_idx", T.has_marker(F.col("text"))).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"))


@query("""SELECT o_orderkey AS doc_id, 5 AS second, 3 AS candidate, 0.94::DOUBLE AS confidence FROM orders WHERE o_orderkey % 2 = 0""")
def missing_first_section(spark, sf_dir):
    long = "这一段正文很长，超过了二十五个字，因此它前面的短行可以是一个小标题。"
    first = F.when(F.col("o_orderkey") % 2 == 0, "背景").otherwise("（一）背景")
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(F.lit("立场文件"), F.lit("委员会：大会"), F.lit(long), first, F.lit(long), F.lit("（二）建议"), F.lit(long))).alias("para_idx", "text"))
    return L.missing_first_section(p)


@query("""SELECT c_custkey AS doc_id, c_mktsegment AS phrase FROM customer WHERE c_custkey % 3 <> 0""")
def required_phrases(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    spans = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("in "), "c_mktsegment", F.lit(" of")).alias("text"), (F.col("c_custkey") % 3 == 0).alias("italic"))
    return L.required_phrases(spans, c.select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("phrase")))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem), s AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT doc_id, page, 'too-large' AS code FROM s WHERE q > 45 UNION ALL SELECT doc_id, page, 'page-differs' FROM p WHERE doc_id % 5 = 0 UNION ALL SELECT DISTINCT doc_id, 99, 'page-count' FROM p WHERE doc_id % 6 = 0""")
def visual_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit("text").alias("text"), F.col("l_quantity").alias("size"))
    pages = li.select("doc_id", "page").distinct()
    scores = pages.withColumn("score", F.lit(0.5))
    reference = pages.withColumn("score", F.when(F.col("doc_id") % 5 == 0, 0.9).otherwise(0.5)).union(pages.where("doc_id % 6 = 0").select("doc_id", F.lit(99), F.lit(0.5)).distinct())
    return P.visual_audit(li, scores, reference, 45.0, 0.2)


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 1 THEN 'sponsors' ELSE 'country' END AS field, CASE o_orderkey % 3 WHEN 1 THEN 2 ELSE 3 END::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 > 0""")
def repeated_fields(spark, sf_dir):
    """Papers as they are, with a second line of sponsors, and with three countries."""
    p, k, i = papers(spark, sf_dir), F.col("doc_id") % 3, F.col("para_idx")
    again = p.withColumn("text", F.when((k == 1) & (i == 4), F.concat(F.lit("Sponsors: "), "text")).when((k == 2) & i.isin(2, 3, 4), F.concat(F.lit("Country: "), "text")).otherwise(F.col("text")))
    return R.repeated_header_fields(R.header(again, "draft-resolution", VOCABULARY))


@query("""WITH RECURSIVE v AS (SELECT unnest(['a', 'b', 'c', 'd', 'h', 'i', 'ii', 'iv', 'v', 'vi', 'x']) AS t, unnest([NULL, NULL, 100, 500, NULL, 1, 2, 4, 5, 6, 10]) AS n), r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx, CASE WHEN l_suppkey % 6 > 0 THEN ['a', 'b', 'c', 'd', 'h', 'i', 'ii', 'iv', 'v', 'vi', 'x'][(l_partkey % 11 + 1)::INT] END AS t FROM lineitem),
 w AS (SELECT l_orderkey, idx, t, NULL::VARCHAR AS before FROM r WHERE idx = 1 UNION ALL SELECT r.l_orderkey, r.idx, r.t, coalesce(w.t, w.before) FROM w JOIN r ON r.l_orderkey = w.l_orderkey AND r.idx = w.idx + 1)
 SELECT w.l_orderkey AS doc_id, idx, CASE WHEN v.n IS NULL THEN false WHEN length(w.t) > 1 THEN true WHEN w.t = 'i' THEN before IS NULL OR before <> 'h' ELSE coalesce(b.n + 1 = v.n, false) END AS is_roman FROM w LEFT JOIN v ON v.t = w.t LEFT JOIN v b ON b.t = w.before""")
def roman_items(spark, sf_dir):
    """Tokens of orders' items, as the parts say; some items have none."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    tokens = F.array(*map(F.lit, ("a", "b", "c", "d", "h", "i", "ii", "iv", "v", "vi", "x")))
    token = F.when(F.col("l_suppkey") % 6 > 0, F.concat(F.lit("("), F.get(tokens, (F.col("l_partkey") % 11).cast("int")), F.lit(") text"))).otherwise("text")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("idx"), token.alias("text"))
    return S.roman_items(rows, ["doc_id"], "idx").select("doc_id", "idx", "is_roman")


@query("""SELECT c_custkey AS doc_id, 0 AS para_idx, CASE c_custkey % 3 WHEN 1 THEN 'emphasis' ELSE 'font-size' END AS code FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, NULL, 'page' FROM customer WHERE c_custkey % 5 = 0""")
def layout_audit(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    p = c.select(k.alias("doc_id"), F.lit(0).alias("para_idx"), F.lit("sponsors").alias("role"), F.concat(F.lit("Sponsors: "), "c_name").alias("text"))
    run = lambda start, text, bold, size: F.struct(F.lit(start).alias("start"), F.length(text).alias("len"), text.alias("text"), size.alias("sz"), bold.alias("b"), bold.alias("i"), F.lit(None).cast("boolean").alias("u"))
    size = F.when(k % 3 == 2, 11.0).otherwise(12.0)
    runs = c.select(k.alias("doc_id"), F.lit(0).alias("para_idx"), F.explode(F.array(run(0, F.lit("Sponsors: "), F.lit(None).cast("boolean"), F.lit(12.0)), run(10, F.col("c_name"), k % 3 != 1, size))).alias("r")).select("doc_id", "para_idx", "r.*")
    turned = k % 5 == 0
    sections = c.select(k.alias("doc_id"), F.when(turned, 16838).otherwise(11906).alias("width"), F.when(turned, 11906).otherwise(16838).alias("height"), *[F.lit(1440).alias(x) for x in ("left", "right", "top", "bottom")])
    rule = spark.createDataFrame([("sponsors", "label", True, True, None)], "role string, start string, b boolean, i boolean, u boolean")
    return P.layout_audit(p, runs, sections, 12.0, rule)


# --- packages


def _package(lines_of: list[str], broken: bool) -> bytes:
    """A minimal package with one paragraph a line; a broken one has a part outside its folder."""
    name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines_of)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{name}"><w:body>{body}</w:body></w:document>')
        if broken:
            z.writestr("../word/x.XML", '<!DOCTYPE x SYSTEM "y"><x/>'.encode("utf-16"))
    return out.getvalue()


def packages(spark, sf_dir) -> DataFrame:
    """Each document as a package."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [_package(x.as_py().replace("\r\n", "\n").replace("\r", "\n").split("\n"), i.as_py() % 10 == 0) for i, x in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(content, pa.binary())], ["doc_id", "content"])

    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & T.valid_xml_text(F.col("text")))
    return docs.select("doc_id", "text").mapInArrow(made, "doc_id string, content binary")


@query(f"""WITH {LINES} SELECT doc_id::VARCHAR AS doc_id, para_idx, text, 'flow' AS region FROM lines""")
def package_paragraphs(spark, sf_dir):
    return K.read_paragraphs(packages(spark, sf_dir)).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "text", "region")


@query(f"""WITH {LINES} SELECT doc_id::VARCHAR AS doc_id, para_idx, 0 AS start, length(text) AS len FROM lines""")
def package_runs(spark, sf_dir):
    return K.read_runs(packages(spark, sf_dir)).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("len"))


@query("""SELECT doc_id::VARCHAR AS doc_id, unnest(['unsafe-path', 'dtd']) AS rule, '../word/x.XML' AS name FROM documents WHERE text IS NOT NULL AND doc_id % 10 = 0""")
def package_audit(spark, sf_dir):
    return K.package_audit(K.package_entries(packages(spark, sf_dir)))


@query("""SELECT doc_id::VARCHAR AS doc_id, doc_id % 8 NOT IN (1, 2, 3, 5, 6) AS safe FROM documents WHERE doc_id IS NOT NULL""")
def safe_packages(spark, sf_dir):
    """Documents as packages with macros, embedded objects, pictures from outside, links, and plain ones."""
    k = F.col("doc_id") % 8
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    extra = F.when(k == 1, "word/vbaProject.bin").when(k == 2, "word/embeddings/x.bin").when(k == 3, "word/activeX/activeX1.xml").otherwise("word/media/a.png")
    entries = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array(F.lit("word/document.xml"), extra)).alias("name"))
    target = F.when(k == 4, "https://example.org/a").when(k == 5, "https://example.org/a.png").when(k == 6, "//host/share").otherwise("media/a.png")
    links = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("p").alias("part"), F.lit("r1").alias("id"), F.when(k == 4, "x/hyperlink").otherwise("x/image").alias("type"), target.alias("target"), F.when(k.isin(4, 5), "External").otherwise("Internal").alias("mode"))
    return K.safe_to_render(entries, links)


def mixed_packages(spark, sf_dir) -> DataFrame:
    """Documents as packages of which some are broken: a part that is no XML, no package at all, a part cut off, a
    declared document type, no main part. Texts that no package can hold become malformed parts as they are."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                good = _package((x or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"), False)
                broken = {0: _document(f"<d><p>{escape(x or '')}</d>"), 1: b"no package", 2: good[: len(good) // 2], 3: _document("<!DOCTYPE x><x/>"), 4: _document(None)}.get(i % 10 if i % 30 < 10 else 9)
                content.append(good if broken is None else broken)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(content, pa.binary())], ["doc_id", "content"])

    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return docs.select("doc_id", "text").mapInArrow(made, "doc_id string, content binary")


def _document(text: str | None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        if text is not None:
            z.writestr("word/document.xml", text)
    return out.getvalue()


#: Kinds of broken packages in SQL; control characters make a part malformed too.
PROBLEM = """CASE WHEN doc_id % 30 < 5 THEN ['malformed-xml', 'unreadable', 'unreadable', 'dtd', 'missing-part'][(doc_id % 30 + 1)::INT] WHEN regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]') THEN 'malformed-xml' END"""


@query(f"""SELECT doc_id::VARCHAR AS doc_id, {PROBLEM} AS problem FROM documents WHERE doc_id IS NOT NULL""")
def package_problems(spark, sf_dir):
    """Each package with the problem it failed by, alone."""
    return K.package_problems(mixed_packages(spark, sf_dir))


@query(f"""WITH d AS (SELECT doc_id, text, {PROBLEM} AS problem FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id::VARCHAR AS doc_id, i - 1 AS para_idx, l[i] AS text FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM d WHERE problem IS NULL), generate_series(1, len(l)) AS g(i)""")
def package_survivors(spark, sf_dir):
    """All paragraphs of the packages between the broken ones."""
    return K.read_paragraphs(mixed_packages(spark, sf_dir)).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "text")


@query(f"""WITH d AS (SELECT doc_id::VARCHAR AS doc_id, {PROBLEM} AS problem FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, problem AS rule FROM d WHERE problem IS NOT NULL""")
def broken_package_rules(spark, sf_dir):
    """What the audit says of the same packages."""
    return K.package_audit(K.package_entries(mixed_packages(spark, sf_dir))).select("doc_id", "rule")


def numbered_packages(spark, sf_dir) -> DataFrame:
    """Suppliers as packages with a list of two levels, whose instances override a level or a start, or nothing."""
    name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    level = lambda i, start, fmt, text: f'<w:lvl w:ilvl="{i}"><w:start w:val="{start}"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/></w:lvl>'

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for k in batch.column(0).to_pylist():
                own = {1: level(0, 3, "upperRoman", "%1)"), 2: ""}.get(k % 4, None)
                start = f'<w:startOverride w:val="{k % 9 + 1}"/>' if k % 4 in (1, 2) and k % 3 else ""
                override = f'<w:lvlOverride w:ilvl="0">{start}{own}</w:lvlOverride>' if own is not None else ""
                levels = level(0, k % 5 + 1, "decimal", "%1.") + level(1, 1, "lowerLetter", "(%2)")
                body = f'<w:numbering xmlns:w="{name}"><w:abstractNum w:abstractNumId="7">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/>{override}</w:num></w:numbering>'
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    z.writestr("[Content_Types].xml", "<Types/>")
                    z.writestr("word/numbering.xml", body)
                content.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(content, pa.binary())], ["doc_id", "content"])

    return table(spark, sf_dir, "supplier").select("s_suppkey").mapInArrow(made, "doc_id string, content binary")


@query("""SELECT s_suppkey::VARCHAR AS doc_id, '1' AS num_id, 0 AS ilvl, CASE WHEN s_suppkey % 4 = 1 THEN 'upperRoman' ELSE 'decimal' END AS fmt, CASE WHEN s_suppkey % 4 = 1 THEN '%1)' ELSE '%1.' END AS lvl_text, CASE WHEN s_suppkey % 4 IN (1, 2) AND s_suppkey % 3 <> 0 THEN s_suppkey % 9 + 1 WHEN s_suppkey % 4 = 1 THEN 3 ELSE s_suppkey % 5 + 1 END::INT AS start FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, '1', 1, 'lowerLetter', '(%2)', 1 FROM supplier""")
def list_levels(spark, sf_dir):
    """The levels that instances have: their own, else the abstract list's, and their start override over both."""
    return K.read_list_levels(numbered_packages(spark, sf_dir)).select("doc_id", "num_id", "ilvl", "fmt", "lvl_text", "start")


@query("""WITH a AS (SELECT s_suppkey AS doc_id, unnest([0, 1]) AS ilvl FROM supplier) SELECT doc_id, '1' AS num_id, ilvl, CASE (doc_id + ilvl) % 6 WHEN 1 THEN 'removed' WHEN 2 THEN 'start' WHEN 3 THEN 'format' WHEN 4 THEN 'text' END AS code FROM a WHERE (doc_id + ilvl) % 6 BETWEEN 1 AND 4 UNION ALL SELECT s_suppkey, '1', 2, 'created' FROM supplier WHERE s_suppkey % 7 = 0""")
def level_audit(spark, sf_dir):
    """List levels of which each second has a rule; some keep to it, some lose a level, a start, their format or text."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("1").alias("num_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ilvl"))
    k = (F.col("doc_id") + F.col("ilvl")) % 6
    before = a.select("*", F.lit("decimal").alias("fmt"), F.lit("%1.").alias("lvl_text"), F.lit(1).alias("start"))
    rules = a.where(k % 2 == 0).select("*", F.lit("lowerLetter").alias("fmt"), F.lit("(%1)").alias("lvl_text"))
    after = a.where(k != 1).select("*", F.when((k % 2 == 0) & (k != 3), "lowerLetter").when(k == 3, "upperRoman").otherwise("decimal").alias("fmt"), F.when(k == 4, "[%1]").when(k % 2 == 0, "(%1)").otherwise("%1.").alias("lvl_text"), F.when(k == 2, 4).otherwise(1).alias("start"))
    created = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("doc_id"), F.lit("1").alias("num_id"), F.lit(2).alias("ilvl"), F.lit("decimal").alias("fmt"), F.lit("%3").alias("lvl_text"), F.lit(1).alias("start"))
    return K.level_audit(before, after.unionByName(created), rules)


@query("""WITH l AS (SELECT page_id::VARCHAR AS doc_id, i::VARCHAR AS id, (page_id + i) % 7 AS k FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages), LATERAL (SELECT generate_subscripts(a, 1) AS i)) SELECT doc_id, 'page' AS part, id, CASE k WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' WHEN 3 THEN 'repeated' END AS kind FROM l WHERE k = 0 OR k = 1 OR k = 3""")
def relationship_audit(spark, sf_dir):
    """The links of each page: some gone, some changed, some changed by a rule, some given twice."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    r = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("i", "target"))
    k = (F.col("page_id") + F.col("i") + 1) % 7
    before = r.select(F.col("page_id").cast("string").alias("doc_id"), F.lit("page").alias("part"), (F.col("i") + 1).cast("string").alias("id"), F.lit("link").alias("type"), "target", F.lit("Internal").alias("mode"), k.alias("k"))
    after = before.where("k <> 0").withColumn("target", F.when(F.col("k").isin(1, 2), F.concat("target", F.lit("#"))).otherwise(F.col("target")))
    return K.relationship_audit(before, after.union(after.where("k = 3")), before.where("k = 2"))


# --- comparisons without an SQL form: alignments; tested on small tables


def _changed(p: DataFrame) -> DataFrame:
    """Lines of which some are changed and some new ones follow."""
    k = (F.col("doc_id") * 31 + F.col("idx") * 17) % 11
    some = p.withColumn("text", F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    twice = some.select("doc_id", F.posexplode(F.when(k == 2, F.array("text", F.concat("text", F.lit("?")))).otherwise(F.array("text"))).alias("_n", "text"), "idx")
    return twice.select("doc_id", (F.col("idx") * 2 + F.col("_n")).alias("idx"), "text")


@query()
def aligned_lines(spark, sf_dir):
    p = lines(spark, sf_dir).select("doc_id", F.col("para_idx").alias("idx"), "text")
    return D.align_paragraphs(p, _changed(p))


@query()
def line_diff(spark, sf_dir):
    p = lines(spark, sf_dir).select("doc_id", F.col("para_idx").alias("idx"), "text")
    return D.token_diff(p, _changed(p))


@query()
def effective_compare(spark, sf_dir):
    p = lines(spark, sf_dir).select("doc_id", F.col("para_idx").alias("idx"), "text", F.lit("literal").alias("marker"), (F.col("para_idx") * 20).alias("left"))
    after = _changed(p.select("doc_id", "idx", "text")).withColumns({"marker": F.lit("literal"), "left": F.col("idx") * 10})
    return P.effective_compare(after, p)


@query(f"""WITH {LINES} SELECT doc_id, para_idx, CASE WHEN ('0x' || substr(md5('perturb:7:' || doc_id || ':' || para_idx), 1, 8))::BIGINT % 10 = 0 THEN '[' || text || ']' ELSE text END AS text FROM lines""")
def perturbed_lines(spark, sf_dir):
    return E.perturb(lines(spark, sf_dir), 10, 7, F.concat(F.lit("["), "text", F.lit("]")), ["doc_id", "para_idx"])
