"""Queries of deterministic damage, created and removed lines, and what audits and plans make of them. Papers are made of
the given tables; the SQL states the rules row by row (walks, positions of single characters), not the windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import clauses as C
from quirelake.functions import text as T
from quirelake.operators import damage as D
from quirelake.operators import layout as L
from quirelake.operators import lines as Z
from quirelake.operators import names as M
from quirelake.operators import planning as P
from quirelake.operators import recognition as R
from quirelake.operators import snapshots as X
from quirelake.plans.papers import VOCABULARY
from quirelake.plans.registry import query
from quirelake.plans.suites import LINES, lines, spread, table
from quirelake.sources.reference_tables import build_gazetteer

SEED = 11

#: Clauses of each order in SQL: chapters, deep sub-clauses of which some introduce others, and plain lines.
CLAUSES = """i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx, l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag FROM lineitem),
 p AS (SELECT doc_id, idx, l_suppkey, l_quantity, l_returnflag, CASE (l_partkey + idx) % 6 WHEN 0 THEN '第一条 决定' WHEN 1 THEN '（子）' WHEN 2 THEN '（丑）' WHEN 3 THEN '（甲）' WHEN 4 THEN '（一）' ELSE '另' END || p_name || CASE WHEN l_linestatus = 'O' OR (l_partkey + idx) % 6 IN (0, 5) THEN '：' ELSE '；' END AS text FROM i JOIN part ON l_partkey = p_partkey)"""
#: The hash that draws choices, in SQL.
DRAW = "('0x' || substr(md5('{0}:" + str(SEED) + ":' || {1}), 1, 8))::BIGINT"


def clauses(spark, sf_dir) -> DataFrame:
    """doc_id, idx, text, num_id, left, first."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lineitem = table(spark, sf_dir, "lineitem")
    n = lineitem.count()
    items = spread(lineitem, n, "l_orderkey").withColumn("idx", (F.row_number().over(w) - 1).cast("long")).join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    kind = (F.col("l_partkey") + F.col("idx")) % 6
    head = F.get(F.array(*map(F.lit, ("第一条 决定", "（子）", "（丑）", "（甲）", "（一）", "另"))), kind.cast("int"))
    tail = F.when((F.col("l_linestatus") == "O") | kind.isin(0, 5), "：").otherwise("；")
    p = items.select(F.col("l_orderkey").alias("doc_id"), "idx", F.concat(head, "p_name", tail).alias("text"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("num_id"), F.col("l_quantity").cast("long").alias("left"), (-F.col("l_suppkey") % 60).cast("long").alias("first"))
    return spread(p, n, "doc_id")


@query(f"""WITH RECURSIVE {CLAUSES}, f AS (SELECT doc_id, idx, text, regexp_matches(text, '^（[子丑甲]）') AND right(lag(text) OVER (PARTITION BY doc_id ORDER BY idx), 1) = '：' AS fits FROM p),
 w AS (SELECT doc_id, idx, coalesce(fits, false) AS goes, coalesce(fits, false)::INT AS n FROM f WHERE idx = 0 UNION ALL SELECT f.doc_id, f.idx, coalesce(f.fits, false) AND NOT w.goes AND w.n < 3, w.n + (coalesce(f.fits, false) AND NOT w.goes AND w.n < 3)::INT FROM w JOIN f ON f.doc_id = w.doc_id AND f.idx = w.idx + 1)
 SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.idx) - 1 AS idx, f.text || coalesce((SELECT g.text FROM f g JOIN w v ON v.doc_id = g.doc_id AND v.idx = g.idx WHERE v.goes AND g.doc_id = a.doc_id AND g.idx = a.idx + 1), '') AS text FROM w a JOIN f ON f.doc_id = a.doc_id AND f.idx = a.idx WHERE NOT a.goes""")
def damage_merged(spark, sf_dir):
    return D.merge_subclauses(clauses(spark, sf_dir), SEED).select("doc_id", "idx", "text")


@query(f"""WITH RECURSIVE {CLAUSES}, q AS (SELECT doc_id, idx, text, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS num_id, l_quantity::BIGINT AS "left", -(l_suppkey % 60) AS "first" FROM p),
 f AS (SELECT a.*, a.num_id IS NOT NULL AND right(b.text, 1) = '：' AND c.num_id = a.num_id AND NOT EXISTS (SELECT 1 FROM q d WHERE d.doc_id = a.doc_id AND d.idx < a.idx AND d.num_id = a.num_id) AS fits FROM q a LEFT JOIN q b ON b.doc_id = a.doc_id AND b.idx = a.idx - 1 LEFT JOIN q c ON c.doc_id = a.doc_id AND c.idx = a.idx + 1),
 g AS (SELECT *, coalesce(fits, false) AND (SELECT count(*) FROM f e WHERE e.doc_id = f.doc_id AND e.idx <= f.idx AND e.fits) <= 2 AS goes FROM f)
 SELECT doc_id, idx, CASE WHEN goes THEN NULL ELSE num_id END AS num_id, CASE WHEN goes THEN greatest("left" + "first", 0) ELSE "left" END AS "left", CASE WHEN goes THEN 0 ELSE "first" END AS "first" FROM g""")
def damage_list_numbers(spark, sf_dir):
    return D.drop_list_number(clauses(spark, sf_dir), SEED).select("doc_id", "idx", "num_id", "left", "first")


HEADS = ("委员会：", "议题 : ", " 国家/席位：", "代表：", "题目：")


@query(f"""WITH h AS (SELECT o_orderkey AS doc_id, i - 1 AS idx, ['委员会：', '议题 : ', ' 国家/席位：', '代表：', '题目：'][((o_custkey + i - 1) % 5 + 1)::INT] AS label, o_orderpriority AS value FROM orders, generate_series(1, 10) g(i))
 SELECT doc_id, idx, CASE WHEN idx < 8 AND label <> '题目：' AND {DRAW.format("strip_labels", "doc_id || ':' || idx")} % 3 = 0 THEN value ELSE label || value END AS text FROM h""")
def damage_labels(spark, sf_dir):
    """Ten lines of each order with a label; of the first eight one in three loses it, where it is a header label."""
    o = table(spark, sf_dir, "orders")
    label = lambda i: F.get(F.array(*map(F.lit, HEADS)), ((F.col("o_custkey") + i) % 5).cast("int"))
    p = o.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(label(i), F.col("o_orderpriority")))).alias("idx", "text"))
    return D.strip_labels(p.withColumn("idx", F.col("idx").cast("long")), SEED, 3)


@query(f"""WITH {CLAUSES}, s AS (SELECT doc_id, idx, CASE WHEN idx % 3 = 0 AND l_suppkey % 2 = 0 THEN '（一）' WHEN idx % 3 = 2 AND l_suppkey % 3 = 0 THEN ' （二）' ELSE '' END || text AS text FROM p),
 b AS (SELECT doc_id, min(idx) AS second FROM s WHERE regexp_matches(text, '^\\s*（二）') GROUP BY 1), a AS (SELECT s.doc_id, max(idx) AS first FROM s JOIN b ON s.doc_id = b.doc_id WHERE idx < second AND regexp_matches(text, '^\\s*（一）') GROUP BY 1)
 SELECT s.doc_id, idx, CASE WHEN idx = first THEN regexp_replace(text, '^\\s*（一）', '') ELSE text END AS text FROM s LEFT JOIN a ON s.doc_id = a.doc_id""")
def damage_sections(spark, sf_dir):
    p = clauses(spark, sf_dir).withColumn("_s", -F.col("first"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    supplier = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_suppkey", (F.row_number().over(w) - 1).cast("long").alias("idx"))
    k = F.col("idx") % 3
    head = F.when((k == 0) & (F.col("l_suppkey") % 2 == 0), "（一）").when((k == 2) & (F.col("l_suppkey") % 3 == 0), " （二）").otherwise("")
    made = p.join(supplier.hint("merge"), ["doc_id", "idx"]).select("doc_id", "idx", F.concat(head, "text").alias("text"))
    return D.drop_first_section(made, SEED)


@query(f"""WITH RECURSIVE c AS (SELECT p_partkey AS doc_id, 0 AS run, p_name AS text, length(p_name) AS size FROM part UNION ALL SELECT p_partkey, 1, p_brand || '', length(p_brand) FROM part UNION ALL SELECT p_partkey, 2, left(p_type, 2), length(left(p_type, 2)) FROM part),
 w AS (SELECT doc_id, run, size, 0 AS i, 0 AS pos, CASE WHEN size < 3 THEN size ELSE least({DRAW.format("fragment", "doc_id || ':0:' || run || ':0'")} % 4 + 1, size) END::INT AS n FROM c UNION ALL SELECT doc_id, run, size, i + 1, pos + n, least({DRAW.format("fragment", "doc_id || ':0:' || run || ':' || (i + 1)")} % 4 + 1, size - pos - n)::INT FROM w WHERE pos + n < size)
 SELECT w.doc_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.run, i) - 1 AS run_idx, pos + CASE w.run WHEN 0 THEN 0 ELSE 100 * w.run END AS start, n AS len, substr(text, pos + 1, n) AS text FROM w JOIN c ON c.doc_id = w.doc_id AND c.run = w.run""")
def damage_fragments(spark, sf_dir):
    run = lambda i, text: F.struct(F.lit(i).alias("run_idx"), F.lit(100 * i).alias("start"), F.length(text).alias("len"), text.alias("text"))
    runs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("para_idx"), F.explode(F.array(run(0, F.col("p_name")), run(1, F.col("p_brand")), run(2, F.substring("p_type", 1, 2)))).alias("r")).select("doc_id", "para_idx", "r.*")
    out = D.fragment(runs, SEED)
    return out.select("doc_id", F.col("run_idx").cast("long").alias("run_idx"), "start", "len", "text")


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, min(l_quantity)::BIGINT AS "left" FROM lineitem GROUP BY 1, 2)
 SELECT doc_id, idx, CASE WHEN {DRAW.format("extreme_indent.left", "doc_id || ':' || idx")} % 4 = 0 THEN [3000, 4400, 6000, -800][({DRAW.format("extreme_indent.left.value", "doc_id || ':' || idx")} % 4 + 1)::INT] ELSE "left" END AS "left", CASE WHEN {DRAW.format("extreme_indent.first", "doc_id || ':' || idx")} % 4 = 0 THEN [-1800, 2200, 0][({DRAW.format("extreme_indent.first.value", "doc_id || ':' || idx")} % 3 + 1)::INT] END AS "first" FROM r""")
def damage_indents(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx")).agg(F.min("l_quantity").cast("long").alias("left"), F.lit(None).cast("long").alias("first"))
    operation, choices, share = D.LAYOUT[1]
    return D.scatter(p, operation, choices, ["doc_id", "idx"], SEED, share)


@query(f"""WITH h AS (SELECT o_orderkey AS doc_id, o_custkey, bool_or((o_custkey + i) % 5 <> 4 AND {DRAW.format("strip_labels", "o_orderkey || ':' || i")} % 3 = 0) AS stripped FROM orders, generate_series(0, 7) g(i) GROUP BY 1, 2) SELECT doc_id AS "case", NOT stripped AS preserved, NOT stripped AND o_custkey % 4 <> 0 AS passed FROM h""")
def damage_verdict(spark, sf_dir):
    """Whether the lines of damage_labels still say the same, blanks aside; every fourth has a fault besides."""
    o = table(spark, sf_dir, "orders")
    label = lambda i: F.get(F.array(*map(F.lit, HEADS)), ((F.col("o_custkey") + i) % 5).cast("int"))
    p = o.select(F.col("o_orderkey").alias("doc_id"), "o_custkey", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(label(i), F.col("o_orderpriority")))).alias("idx", "text"))
    said = lambda df, name: df.groupBy("doc_id").agg(F.first("o_custkey").alias("k"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: T.visible_signature(x.text)), "").cast("binary"), 256).alias(name))
    before = said(p, "signature_before")
    after = said(D.strip_labels(p.withColumn("text", F.concat(F.lit(" "), "text")), SEED, 3), "signature_after").drop("k")
    cases = before.join(after.hint("merge"), "doc_id").select(F.col("doc_id").alias("case"), (F.col("k") % 4 == 0).cast("int").alias("errors"), "signature_before", "signature_after", F.lit(0).alias("noise"))
    return P.stress_verdict(cases).select("case", "preserved", "passed")


# --- lines created and removed

RULES = Z.BlankRules(after=("title_block", "header", "sponsors", "reference"), before_operative=True, between_prose=True)
#: Lines of documents with roles by place and every third line blank, in SQL.
BLANKED = f"""{LINES}, z AS (SELECT doc_id, para_idx AS idx, CASE WHEN (doc_id + para_idx) % 3 = 0 OR (doc_id * 7 + para_idx) % 5 = 0 THEN ' ' ELSE text END AS text, CASE WHEN para_idx < 7 THEN ['title', 'committee', 'topic', 'sponsors', 'sponsors', 'header', 'preamble'][(para_idx + 1)::INT] WHEN para_idx % 5 = 4 THEN 'reference' WHEN para_idx % 7 IN (1, 2, 3) THEN 'item' ELSE 'prose' END AS role, para_idx > 8 AS operative FROM lines),
 v AS (SELECT *, regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x{{0085}}\\p{{Z}}]') AS live FROM z),
 l AS (SELECT *, lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS next_live, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS prev_live, lead(role) OVER (PARTITION BY doc_id, role IN ('preamble', 'item', 'prose', 'reference') ORDER BY idx) AS next_role FROM v WHERE live),
 d AS (SELECT doc_id, idx FROM l WHERE role = 'sponsors' UNION SELECT doc_id, max(idx) FROM l WHERE role IN ('title', 'committee', 'topic') GROUP BY 1 UNION SELECT doc_id, max(idx) FROM l WHERE role IN ('title', 'committee', 'topic', 'sponsors', 'header') GROUP BY 1 UNION SELECT doc_id, max(idx) FROM l WHERE role = 'reference' GROUP BY 1
  UNION SELECT doc_id, prev_live FROM l WHERE prev_live IS NOT NULL AND (doc_id, idx) IN (SELECT doc_id, min(idx) FROM l WHERE operative AND role IN ('item', 'prose') GROUP BY 1) UNION SELECT doc_id, idx FROM l WHERE role IN ('preamble', 'item', 'prose', 'reference') AND next_role IS NOT NULL AND NOT (role = next_role AND role IN ('item', 'reference'))),
 b AS (SELECT v.doc_id, v.idx, coalesce((SELECT max(l.idx) FROM l WHERE l.doc_id = v.doc_id AND l.idx < v.idx), -1) AS island FROM v WHERE NOT live),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY idx) AS place, (doc_id, island) IN (SELECT doc_id, idx FROM d) AS wanted FROM b)"""


def blanked(spark, sf_dir) -> DataFrame:
    k = F.col("para_idx")
    role = F.when(k < 7, F.get(F.array(*map(F.lit, ("title", "committee", "topic", "sponsors", "sponsors", "header", "preamble"))), k.cast("int"))).when(k % 5 == 4, "reference").when((k % 7).isin(1, 2, 3), "item").otherwise("prose")
    none = ((F.col("doc_id") + k) % 3 == 0) | ((F.col("doc_id") * 7 + k) % 5 == 0)
    return lines(spark, sf_dir).select("doc_id", k.alias("idx"), F.when(none, " ").otherwise(F.col("text")).alias("text"), role.alias("role"), (k > 8).alias("operative"))


@query(f"""WITH {BLANKED} SELECT doc_id, idx AS at_idx, 1 AS nth, 'blank' AS kind FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = d.doc_id AND k.island = d.idx) UNION ALL SELECT doc_id, idx, 0, 'empty-line' FROM k WHERE place > wanted::INT""")
def blank_line_plan(spark, sf_dir):
    return Z.plan_blank_lines(blanked(spark, sf_dir), RULES).select("doc_id", "at_idx", "nth", "kind")


@query(f"""WITH {BLANKED} SELECT doc_id, idx, 'missing-blank' AS code FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = d.doc_id AND k.island = d.idx) UNION ALL SELECT doc_id, idx, CASE WHEN wanted THEN 'doubled-blank' ELSE 'misplaced-blank' END FROM k WHERE place > wanted::INT""")
def blank_line_audit(spark, sf_dir):
    return Z.blank_audit(blanked(spark, sf_dir), RULES)


@query(f"""WITH {BLANKED}, a AS (SELECT doc_id, idx, 0 AS n, text, role FROM v WHERE live UNION ALL SELECT doc_id, idx, 1, NULL, NULL FROM d) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, n) - 1 AS idx, coalesce(text, '') AS text FROM a""")
def blank_lines_applied(spark, sf_dir):
    """Papers as they stand when the plan is applied: texts in order with exactly the blank lines wanted."""
    p = blanked(spark, sf_dir)
    out = Z.apply_lines(p, Z.plan_blank_lines(p, RULES))
    return out.select("doc_id", "idx", F.when(Z.blank(F.col("text")), "").otherwise(F.col("text")).alias("text"))


@query("""WITH n AS (SELECT c_nationkey AS doc_id, c_custkey // 50 AS line, list(c_name ORDER BY c_custkey) AS names FROM customer GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS idx FROM n),
 f AS (SELECT doc_id, idx, 0 AS nth, CASE WHEN idx % 2 = 0 THEN 'Sponsors:' ELSE names[1] END AS text FROM i UNION ALL SELECT doc_id, idx, g AS nth, names[CASE WHEN idx % 2 = 0 THEN g ELSE g + 1 END] FROM i, generate_series(1, 60) t(g) WHERE g <= len(names) - CASE WHEN idx % 2 = 0 THEN 0 ELSE 1 END) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, nth) - 1 AS idx, text FROM f""")
def signing_lines(spark, sf_dir):
    """Customers as sponsors, fifty numbers a line, every second line behind a label: each name gets its line."""
    line = F.floor(F.col("c_custkey") / 50)
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id"), line.alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x.c_name).alias("names"))
    p = n.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).cast("long") - 1)
    p = p.select("doc_id", "idx", F.array_join("names", ", ").alias("text"), F.lit("sponsors").alias("role"), F.when(F.col("idx") % 2 == 0, "Sponsors:").alias("label"), "names")
    return Z.apply_lines(p, Z.plan_signing_lines(p)).select("doc_id", "idx", "text")


# --- coverage


@query(f"""WITH {LINES}, s AS (SELECT doc_id, para_idx, para_idx % 3 AS start, least(length(text) - para_idx % 3, 40) AS n, length(text) AS size FROM lines WHERE length(text) > para_idx % 3),
 r AS (SELECT doc_id, para_idx, unnest([0, size // 3, size // 4, size // 2 + 1 + para_idx % 2]) AS a, unnest([size // 3, size // 3, size // 8, size]) AS n, unnest([true, true, true, (doc_id + para_idx) % 4 <> 0]) AS b FROM s),
 c AS (SELECT s.doc_id, s.para_idx, s.start, s.n, (SELECT count(DISTINCT x) FROM r, generate_series(r.a, r.a + r.n - 1) g(x) WHERE r.doc_id = s.doc_id AND r.para_idx = s.para_idx AND r.b AND r.n > 0 AND x >= s.start AND x < s.start + s.n) AS covered FROM s)
 SELECT doc_id, para_idx, start FROM c WHERE covered < n""")
def verb_coverage_union(spark, sf_dir):
    """Spans under runs that touch, overlap and lie in one another; gaps of one character every second line."""
    k, size = F.col("para_idx"), F.length("text")
    p = lines(spark, sf_dir).where(F.length("text") > k % 3)
    spans = p.select("doc_id", "para_idx", (k % 3).alias("start"), F.least(size - k % 3, F.lit(40)).alias("length"))
    run = lambda a, n, b: F.struct(F.floor(a).cast("long").alias("start"), F.floor(n).cast("long").alias("len"), b.alias("b"))
    yes = F.lit(True)
    runs = p.select("doc_id", "para_idx", F.explode(F.array(run(F.lit(0), size / 3, yes), run(size / 3, size / 3, yes), run(size / 4, size / 8, yes), run(F.floor(size / 2) + 1 + k % 2, size, (F.col("doc_id") + k) % 4 != 0))).alias("r")).select("doc_id", "para_idx", "r.*")
    return L.verb_coverage(spans, runs, F.col("b"))


# --- chains and blocks


@query("""WITH RECURSIVE s AS (SELECT p_partkey // 100 AS doc_id, p_partkey AS style, CASE WHEN p_partkey % 100 = 0 THEN CASE WHEN p_partkey % 300 = 0 THEN p_partkey + 7 END ELSE p_partkey - 1 END AS based_on, CASE WHEN p_size % 7 = 0 THEN p_size END AS size, CASE WHEN p_size % 11 = 0 THEN p_brand END AS font FROM part),
 w AS (SELECT doc_id, style, based_on, size, font, 0 AS depth FROM s UNION ALL SELECT w.doc_id, w.style, s.based_on, coalesce(w.size, s.size), coalesce(w.font, s.font), depth + 1 FROM w JOIN s ON s.doc_id = w.doc_id AND s.style = w.based_on WHERE depth < 120) SELECT doc_id, style, size, font FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, style ORDER BY depth DESC) = 1""")
def style_chains(spark, sf_dir):
    """Chains of a hundred styles; in every third document the first style is based on the eighth, a cycle."""
    k, size = F.col("p_partkey"), F.col("p_size")
    base = F.when(k % 100 != 0, k - 1).when(k % 300 == 0, k + 7)
    styles = table(spark, sf_dir, "part").select(F.floor(k / 100).alias("doc_id"), k.alias("style"), base.alias("based_on"), F.when(size % 7 == 0, size).alias("size"), F.when(size % 11 == 0, F.col("p_brand")).alias("font"))
    return L.resolve_styles(styles, ["size", "font"])


@query("""WITH RECURSIVE s AS (SELECT p_partkey // 100 AS doc_id, p_partkey AS style, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - 1 END AS based_on, CASE WHEN p_size % 5 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 10 IN (0, 7) THEN CASE WHEN p_size % 9 = 0 THEN '0' ELSE (p_size % 4)::VARCHAR END END AS num_id, CASE WHEN p_partkey % 10 IN (0, 7) AND p_size % 2 = 0 THEN 1 END AS ilvl FROM part),
 w AS (SELECT *, 0 AS depth FROM s UNION ALL SELECT w.doc_id, w.style, s.based_on, coalesce(w.size, s.size), coalesce(w.num_id, s.num_id), coalesce(w.ilvl, s.ilvl), depth + 1 FROM w JOIN s ON s.doc_id = w.doc_id AND s.style = w.based_on), r AS (SELECT * FROM w WHERE based_on IS NULL),
 d AS (SELECT n AS doc_id, CASE WHEN n % 2 = 0 THEN 99 END AS size FROM generate_series(0, 100000) g(n)),
 l AS (SELECT n AS doc_id, num, lv, CASE WHEN (n + num + lv) % 3 <> 0 THEN 1000 + n % 50 + 10 * num + lv END AS size FROM generate_series(0, 100000) a(n), generate_series(1, 3) b(num), generate_series(0, 1) c(lv)),
 p AS (SELECT l_orderkey, l_linenumber, l_partkey // 100 AS doc_id, CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey END AS own_style, CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey ELSE l_partkey // 100 * 100 + 3 END AS style, CASE WHEN l_quantity > 45 THEN l_quantity::INT END AS own, CASE l_returnflag WHEN 'A' THEN (l_suppkey % 4)::VARCHAR END AS own_num FROM lineitem),
 j AS (SELECT p.*, r.size AS s_size, coalesce(own_num, r.num_id) AS num, CASE WHEN own_num IS NOT NULL THEN 0 ELSE coalesce(r.ilvl, 0) END AS lv FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.style = p.style)
 SELECT j.doc_id, own_style AS style, coalesce(own, l.size, CASE WHEN own_style IS NOT NULL THEN s_size END, d.size) AS size, count(*) AS n FROM j LEFT JOIN l ON l.doc_id = j.doc_id AND l.num::VARCHAR = j.num AND l.lv = j.lv LEFT JOIN d ON d.doc_id = j.doc_id GROUP BY ALL""")
def effective_sizes(spark, sf_dir):
    """Lines of orders as paragraphs: own size, list level (their own list, or that of their style), style, default.
    Those without a style have a default style, which passes on its list but no size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    styles = table(spark, sf_dir, "part").select(
        F.floor(k / 100).alias("doc_id"), k.alias("style"), F.when(k % 10 != 0, k - 1).alias("based_on"), F.when(size % 5 == 0, size).alias("size"),
        F.when((k % 10).isin(0, 7), F.when(size % 9 == 0, "0").otherwise((size % 4).cast("string"))).alias("num_id"), F.when((k % 10).isin(0, 7) & (size % 2 == 0), 1).alias("ilvl"),
    )
    li, s = table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    p = li.select(F.floor(F.col("l_partkey") / 100).alias("doc_id"), F.when(s % 5 != 0, F.col("l_partkey")).alias("style"), F.when(F.col("l_quantity") > 45, F.col("l_quantity").cast("int")).alias("size"), F.when(F.col("l_returnflag") == "A", (s % 4).cast("string")).alias("num_id"), F.lit(None).cast("int").alias("ilvl"))
    docs = styles.select("doc_id").distinct()
    one = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("num")).select("doc_id", "num", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("ilvl"))
    levels = one.select("doc_id", F.col("num").cast("string").alias("num_id"), "ilvl", F.when((F.col("doc_id") + F.col("num") + F.col("ilvl")) % 3 != 0, 1000 + F.col("doc_id") % 50 + 10 * F.col("num") + F.col("ilvl")).cast("int").alias("size"))
    out = L.effective_properties(p, L.resolve_styles(styles, ["size", "num_id", "ilvl"]), ["size"], levels, docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 99).alias("size")), docs.select("doc_id", (F.col("doc_id") * 100 + 3).alias("style")), [])
    return out.groupBy("doc_id", "style", "size").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE n AS (SELECT l_orderkey, l_partkey AS id, floor(l_extendedprice) AS at, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice), l_partkey) AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey, l_suppkey AS id, floor(l_extendedprice * 0.9) AS at, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice * 0.9), l_suppkey) - 1 AS c FROM lineitem WHERE l_returnflag <> 'R'),
 z AS (SELECT l_orderkey, count(*) AS k FROM n GROUP BY 1 HAVING count(*) <= (SELECT count(*) FROM b WHERE b.l_orderkey = n.l_orderkey)),
 w AS (SELECT l_orderkey, 0 AS k, -1::BIGINT AS c, 0.0::DOUBLE AS cost, []::BIGINT[] AS picks FROM z UNION ALL SELECT w.l_orderkey, w.k + 1, b.c, w.cost + abs(n.at - b.at), list_append(w.picks, b.c) FROM w JOIN n ON n.l_orderkey = w.l_orderkey AND n.k = w.k + 1 JOIN b ON b.l_orderkey = w.l_orderkey AND b.c > w.c),
 m AS (SELECT w.* FROM w JOIN z ON z.l_orderkey = w.l_orderkey AND z.k = w.k QUALIFY row_number() OVER (PARTITION BY w.l_orderkey ORDER BY cost, picks) = 1)
 SELECT m.l_orderkey, n.id AS name_id, b.id AS label_id, abs(n.at - b.at)::DOUBLE AS distance FROM m JOIN n ON n.l_orderkey = m.l_orderkey JOIN b ON b.l_orderkey = m.l_orderkey AND b.c = m.picks[n.k]""")
def labels_in_order(spark, sf_dir):
    """Names under labels with the least sum of distances that keeps their order."""
    li = table(spark, sf_dir, "lineitem")
    names = li.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("name_id"), F.floor("l_extendedprice").alias("name_at"))
    labels = li.where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_suppkey").alias("label_id"), F.floor(F.col("l_extendedprice") * 0.9).alias("label_at"))
    return M.ordered_candidates(names, labels, ["l_orderkey"])


# --- all document types

TYPES = ("position-paper", "working-paper", "draft-directive", "draft-resolution", "friendly-amendment", "unfriendly-amendment", "diplomatic-agreement", "joint-statement")
TITLES = ("Position Paper", "Working Paper", "Draft Directive", "Draft Resolution", "Friendly Amendment", "Unfriendly Amendment", "Agreement", "Joint Statement")
KINDS = """t AS (SELECT c_custkey AS doc_id, c_name, c_custkey % 3 = 0 AS subject, c_custkey % 4 = 0 AS verb, c_custkey % 5 = 0 AS numbered, (c_custkey // 60) % 8 AS type FROM customer),
 l AS (SELECT doc_id, type, subject, numbered, 3 AS para_idx, 'pre' AS says FROM t UNION ALL SELECT doc_id, type, subject, numbered, 4, CASE WHEN subject THEN 'head' ELSE 'none' END FROM t UNION ALL SELECT doc_id, type, subject, numbered, 5, CASE WHEN verb THEN 'op' ELSE 'none' END FROM t UNION ALL SELECT doc_id, type, subject, numbered, 6, CASE WHEN numbered THEN 'op' ELSE 'none' END FROM t),
 k AS (SELECT doc_id, type, para_idx, CASE WHEN says = 'head' THEN 'heading' WHEN type = 3 AND numbered THEN CASE WHEN para_idx < 6 THEN 'preambulatory' ELSE 'operative' END WHEN says = 'pre' THEN 'preambulatory' WHEN says = 'op' THEN 'operative' WHEN type IN (2, 4, 5) THEN 'operative' WHEN type = 3 AND subject AND para_idx > 4 THEN 'unknown' ELSE 'body' END AS kind,
  CASE WHEN says = 'head' THEN 1.0 WHEN type = 3 AND numbered THEN 0.98 WHEN says IN ('pre', 'op') THEN 0.94 WHEN type IN (1, 2, 4, 5) THEN 0.72 WHEN type = 3 AND subject AND para_idx > 4 THEN 0.35 ELSE 0.8 END::DOUBLE AS confidence FROM l)"""


@query(f"""WITH {KINDS} SELECT ['{"', '".join(TYPES)}'][(type + 1)::INT] AS doc_type, doc_id, para_idx, kind, confidence FROM k""")
def classify_types(spark, sf_dir):
    """Customers as papers of all eight types, with and without subject lines, verbs and numbers."""
    c, k, name = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_name")
    type_ = F.floor(k / 60) % 8
    out = None
    for number, (document_type, title) in enumerate(zip(TYPES, TITLES, strict=True)):
        head = [F.lit(title), F.concat(F.lit("Committee: "), "c_mktsegment", F.lit(" Council")), F.concat(F.lit("Topic: Plan "), F.col("c_nationkey").cast("string"))]
        plain = F.lit("some words about it which nobody has to read.")
        body = [
            F.concat(F.lit("Noting that customer "), name, F.lit(" asks for more help.")), F.when(k % 3 == 0, "The General Assembly,").otherwise(plain),
            F.when(k % 4 == 0, F.concat(F.lit("Requests that customer "), name, F.lit(" gets what it wants."))).otherwise(plain), F.when(k % 5 == 0, F.concat(F.lit("1. Urges customer "), name, F.lit(" to wait."))).otherwise(plain),
        ]
        p = c.where(type_ == number).select(k.alias("doc_id"), F.posexplode(F.array(*head, *body)).alias("para_idx", "text"))
        rows = R.clauses(R.header(p, document_type, VOCABULARY), document_type, VOCABULARY).where("para_idx > 2").select(F.lit(document_type).alias("doc_type"), "doc_id", "para_idx", "kind", "confidence")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- lists of names, list markers, gazetteers


@query("""WITH b AS (SELECT c_custkey // 12 AS doc_id, c_custkey AS pos, CASE WHEN c_custkey % 2 = 0 THEN upper(n_name) ELSE n_name || ' ' END AS name, n_name AS d, n_nationkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS n FROM b), e AS (SELECT doc_id, list(d ORDER BY lower(d), pos) AS w FROM k WHERE n = 1 GROUP BY 1)
 SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'missing-name' WHEN 2 THEN 'doubled-name' WHEN 3 THEN 're-ordered' WHEN 4 THEN 'added-name' END AS code, replace(CASE doc_id % 5 WHEN 1 THEN w[1] WHEN 2 THEN w[-1] WHEN 3 THEN w[2] WHEN 4 THEN 'Atlantis' END, ' ', '') AS name FROM e WHERE doc_id % 5 IN (1, 2, 4) OR doc_id % 5 = 3 AND len(w) > 1""")
def name_list_audit(spark, sf_dir):
    """Lists of a dozen customers' nations: as planned, without the first, with the last twice, turned round, with a stranger."""
    nation = table(spark, sf_dir, "nation")
    index = M.name_index(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("display")), ["display"])
    doc = F.floor(F.col("c_custkey") / 12)
    c = table(spark, sf_dir, "customer").join(M.bounded(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    before = c.select(doc.alias("doc_id"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 2 == 0, F.upper("n_name")).otherwise(F.concat("n_name", F.lit(" "))).alias("name"))
    right = c.groupBy(doc.alias("doc_id"), "n_name").agg(F.min("c_custkey").alias("p")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("n_name").alias("k"), "p", "n_name"))), lambda x: x.n_name).alias("w"))
    k, size = F.col("doc_id") % 5, F.size("w")
    made = F.when(k == 1, F.slice("w", F.lit(2), size)).when(k == 2, F.concat("w", F.slice("w", -1, 1))).when(k == 3, F.concat(F.slice("w", F.lit(2), size), F.slice("w", 1, 1))).when(k == 4, F.concat("w", F.array(F.lit("Atlantis")))).otherwise(F.col("w"))
    after = right.select("doc_id", F.posexplode_outer(made).alias("pos", "name")).where("name is not null")
    return M.name_list_audit(before, after, index, ["doc_id"], "pos", M.sort_key(F.col("display"), "en"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS ilvl, min(l_suppkey)::VARCHAR AS num_id, min(l_quantity) AS q, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2) SELECT doc_id, num_id, ilvl, 'marker-size' AS code FROM l WHERE q < 30 UNION ALL SELECT doc_id, num_id, ilvl, 'marker-font' FROM l WHERE k % 4 <> 0 AND k % 3 = 0 UNION ALL SELECT doc_id, num_id, ilvl, 'marker-emphasis' FROM l WHERE k % 4 <> 0 AND k % 5 = 0""")
def marker_audit(spark, sf_dir):
    q, k = F.min("l_quantity").alias("q"), F.min("l_partkey").alias("k")
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ilvl")).agg(F.min("l_suppkey").cast("string").alias("num_id"), q, k)  # noqa: E741
    k = F.col("k")
    levels = l.select("doc_id", "num_id", "ilvl", F.when(k % 4 == 0, "bullet").when(k % 4 == 1, "decimal").alias("fmt"), F.when(F.col("q") >= 30, 12.0).when(F.col("q") >= 15, 8.0).alias("sz"), F.when(k % 3 != 0, "Serif").when(k % 2 == 0, "Sans").alias("font"), F.when(k % 5 == 0, True).alias("b"), F.lit(None).cast("boolean").alias("i"), F.lit(False).alias("u"))
    return L.marker_audit(levels, 12.0, "Serif")


@query("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS para_idx, min(l_returnflag) AS f, min(l_quantity) AS q, min(l_partkey) AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), p AS (SELECT *, CASE f WHEN 'A' THEN 'preamble' WHEN 'N' THEN 'item' ELSE 'sponsors' END AS role FROM i WHERE k % 9 <> 0)
 SELECT doc_id, para_idx, 'page-break' AS code FROM p WHERE k % 7 = 0 UNION ALL SELECT doc_id, para_idx, 'pitch' FROM p WHERE k % 5 = 0 OR CASE WHEN role = 'preamble' THEN k % 2 = 0 ELSE k % 2 = 1 END UNION ALL SELECT doc_id, para_idx, 'indent-limit' FROM p WHERE q > 40 UNION ALL SELECT DISTINCT doc_id, NULL::INT, 'table-in-signature' FROM p WHERE role = 'sponsors' AND doc_id % 3 = 0""")
def paragraph_audit(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("para_idx")).agg(F.min("l_returnflag").alias("f"), F.min("l_quantity").alias("q"), F.min("l_partkey").alias("k"))
    k = F.col("k")
    role = F.when(k % 9 == 0, "part").when(F.col("f") == "A", "preamble").when(F.col("f") == "N", "item").otherwise("sponsors")
    p = i.select("doc_id", "para_idx", role.alias("role"), F.when(k % 7 == 0, True).alias("page_break_before"), F.when(k % 5 != 0, F.when(k % 2 == 1, 18.0).otherwise(15.5)).alias("line"), F.when(F.col("q") > 45, -F.col("q") * 3).otherwise(F.col("q") * 3).alias("left"))
    return L.paragraph_audit(p, {"preamble": 18.0, "": 15.5}, 120.0, i.where("doc_id % 3 = 0"))


@query("""WITH m AS (SELECT o_orderkey AS doc_id, o_custkey % 4 AS k, ['（一）', '（二）', '（三）'] AS all_, o_orderkey % 3 + 1 AS n FROM orders), b AS (SELECT doc_id, k, CASE WHEN k = 3 THEN array_slice(all_, 2, 3) ELSE array_slice(all_, 1, n::INT) END AS b FROM m) SELECT doc_id, array_to_string(b, '') AS before, CASE k WHEN 1 THEN array_to_string(array_slice(b, 2, 3), '') ELSE array_to_string(list_reverse(b), '') END AS after FROM b WHERE k = 1 OR k = 2 AND len(b) > 1""")
def section_marker_audit(spark, sf_dir):
    """Sections as they were, without the first, turned round, and with the first restored."""
    k, n = F.col("o_custkey") % 4, (F.col("o_orderkey") % 3 + 1).cast("int")
    all_ = F.array(*map(F.lit, ("（一）", "（二）", "（三）")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), k.alias("k"), F.when(k == 3, F.slice(all_, 2, 2)).otherwise(F.slice(all_, F.lit(1), n)).alias("b"))
    k = F.col("k")
    after = F.when(k == 1, F.slice("b", 2, 3)).when(k == 2, F.reverse("b")).when(k == 3, F.concat(F.array(F.lit("（一）")), "b")).otherwise(F.col("b"))
    rows = lambda c: o.select("doc_id", F.posexplode_outer(c).alias("para_idx", "m")).where("m is not null").select("doc_id", "para_idx", F.concat(F.lit(" "), "m", F.lit("背景")).alias("text"))
    return L.section_marker_audit(rows(F.col("b")), rows(after))


@query("""WITH n AS (SELECT n_nationkey, n_name, CASE n_nationkey WHEN 3 THEN 'Holy See' WHEN 5 THEN 'Cook Islands (the)' WHEN 8 THEN 'Niue' WHEN 11 THEN 'State of Palestine' ELSE n_name END AS short FROM nation) SELECT n_name AS formal_en, CASE n_nationkey WHEN 3 THEN '336' WHEN 5 THEN '184' WHEN 8 THEN '570' WHEN 11 THEN '275' ELSE (1000 + n_nationkey)::VARCHAR END AS id, CASE n_nationkey WHEN 3 THEN 'observer-state' WHEN 11 THEN 'observer-state' WHEN 5 THEN 'specialized-agency-member' WHEN 8 THEN 'specialized-agency-member' ELSE 'member-state' END AS kind, DATE '2024-05-01' AS checked_on FROM n""")
def gazetteer_kinds(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    short = F.when(k == 3, "Holy See").when(k == 5, "Cook Islands (the)").when(k == 8, "Niue").when(k == 11, "State of Palestine").otherwise(F.col("n_name"))
    names = n.select(F.concat(F.lit("the "), "n_name").alias("formal_en"), short.alias("short_en"), F.lit(None).cast("string").alias("short_zh"))
    geography = n.select((1000 + k).cast("string").alias("id"), F.col("n_name").alias("name_en"), F.lit(None).cast("string").alias("name_zh"))
    return build_gazetteer(names, geography, checked_on="2024-05-01", strict=True).select("formal_en", "id", "kind", "checked_on")


# --- verbs and structure


@query("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS para_idx, min(l_returnflag) AS f, min(l_partkey) AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
 SELECT doc_id, para_idx, CASE WHEN f = 'A' THEN 'no-preambulatory-verb' ELSE 'no-operative-verb' END AS code FROM i WHERE k % 4 <> 0 AND (f = 'A' OR f = 'N' AND s % 3 = 0 AND k % 5 <> 0)""")
def verb_warnings(spark, sf_dir):
    """Clauses of which every fourth opens with its verb; sub-clauses, introductions that end in a colon and headings are free."""
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("para_idx")).agg(F.min("l_returnflag").alias("f"), F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"))
    k = F.col("k")
    kind = F.when(F.col("f") == "A", "preambulatory").when(F.col("f") == "N", "operative").otherwise("heading")
    verb = F.when(F.col("f") == "A", "Noting").otherwise("Requests")
    text = F.concat(F.when(k % 4 == 0, verb).when(k % 4 == 1, F.concat(verb, F.lit("x"))).otherwise("Others"), F.lit(" part "), k.cast("string"), F.when(k % 5 == 0, " ： ").otherwise("."))
    clauses = i.select("doc_id", "para_idx", kind.alias("kind"), (F.col("s") % 3).cast("int").alias("level"), text.alias("text"))
    found = C.longest_phrase(F.col("text"), ["Noting", "Requests"])
    return P.verb_warnings(clauses, found)


@query("""WITH d AS (SELECT l_orderkey AS doc_id, l_returnflag AS tag, count(*) AS n, count(*) FILTER (WHERE l_partkey % 4 <> 0) + count(*) FILTER (WHERE l_suppkey % 5 = 0) AS now FROM lineitem GROUP BY 1, 2) SELECT doc_id, tag, n - now AS lost FROM d WHERE n > now""")
def structure_losses(spark, sf_dir):
    """Tags of orders' items of which every fourth is gone and every fifth stands twice."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("tag"), "l_partkey", "l_suppkey")
    count = lambda df: df.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    after = li.where("l_partkey % 4 <> 0").union(li.where("l_suppkey % 5 = 0"))
    return X.structure_losses(count(li), count(after), "doc_id")


# --- committees and lists of states that go on


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS m, c_custkey % 6 AS k, c_custkey % 3 AS j FROM customer) SELECT c_custkey, k IN (0, 1, 3) AS committee, j = 0 AS subject FROM c""")
def committee_lines(spark, sf_dir):
    """Lines that address the committee itself, with an article or without, and organ lines in general."""
    c, m, k, j = table(spark, sf_dir, "customer"), F.col("c_mktsegment"), F.col("c_custkey") % 6, F.col("c_custkey") % 3
    line = F.when(k == 0, F.concat(F.lit("The "), m, F.lit(" Council,"))).when(k == 1, F.concat(m, F.lit(" Council， "))).when(k == 2, F.concat(m, F.lit(" Council"))).when(k == 3, F.concat(F.lit("the "), F.lower(m), F.lit(" council,"))).when(k == 4, F.concat(m, F.lit(" Board,"))).otherwise(",")
    organ = F.when(j == 0, "The Security Council,").when(j == 1, "Recalling the Council,").otherwise("Some people came,")
    return c.select("c_custkey", C.is_committee_subject(line, F.concat(F.lit("The "), m, F.lit(" Council"))).alias("committee"), C.is_subject_line(organ, ["Recalling"]).alias("subject"))
