"""Queries of small pieces: fonts, rendered papers, signatures of paragraphs, lists over several lines, names set in rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import folds as D
from quirelake.operators import layout as L
from quirelake.operators import names as M
from quirelake.plans.registry import query
from quirelake.plans.suites import table

FONTS = ("宋体", "SIMSUN", "黑体", "楷体_GB2312", "Arial", "Times", "微软雅黑")


@query("""WITH p AS (SELECT p_partkey, ['SimSun', 'SimSun', 'SimHei', 'KaiTi', 'Arial', 'Times', 'Microsoft YaHei'] AS c, ['a', '水', 'É', '、', '１', '0', '𠀀', 'ア'][(p_partkey % 8 + 1)::INT] AS ch FROM part) SELECT p_partkey, c[(p_partkey % 7 + 1)::INT] AS font, CASE WHEN ch IN ('水', '、', '１', 'ア') THEN c[(p_partkey // 7 % 7 + 1)::INT] ELSE c[(p_partkey % 7 + 1)::INT] END AS set_in FROM p""")
def fonts(spark, sf_dir):
    """Font names by their usual ones, and the slot a character is set in."""
    k = F.col("p_partkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    latin, asian = pick(FONTS, k % 7), pick(FONTS, F.floor(k / 7) % 7)
    char = pick(("a", "水", "É", "、", "１", "0", "𠀀", "ア"), k % 8)
    return table(spark, sf_dir, "part").select("p_partkey", T.canon_font(latin).alias("font"), T.char_font(char, latin, asian).alias("set_in"))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, ['Working Paper', 'Committee: ' || o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN 'Topic: ' || o_orderstatus END, CASE WHEN o_orderkey % 4 > 0 THEN 'Sponsors: ' || o_clerk END, 'first', 'second ' || o_orderkey, ''] AS l FROM (SELECT *, o_custkey::VARCHAR AS o_clerk FROM orders)), f AS (SELECT doc_id, list_filter(l, lambda x: x IS NOT NULL) AS l FROM o) SELECT doc_id, i - 1 AS para_idx, l[i] AS text FROM f, generate_series(1, 7) g(i) WHERE i <= len(l)""")
def rendered_papers(spark, sf_dir):
    """Orders as working papers; fields that are blank have no line."""
    k = F.col("o_orderkey")
    fields = {"committee": F.col("o_orderpriority"), "topic": F.when(k % 3 > 0, F.col("o_orderstatus")).otherwise(" "), "sponsors": F.when(k % 4 > 0, F.col("o_custkey").cast("string"))}
    body = F.concat(F.lit("first\r\nsecond "), k.cast("string"), F.lit("\r"))
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.posexplode(T.render_paragraphs("working-paper", "en", "Working Paper", body, fields)).alias("para_idx", "text"))
    return rows.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "text")


@query("""SELECT c_custkey AS doc_id, c_custkey % 6 IN (1, 5) OR c_custkey % 6 = 0 AND c_custkey % 5 = 0 AS blank, c_custkey % 6 <> 3 AND c_custkey % 6 <> 4 AS plain, c_custkey % 6 IN (3, 4) AS complex, c_custkey % 7 IN (1, 2) AS marked FROM customer""")
def paragraph_signatures(spark, sf_dir):
    """Text, tabs, plain breaks, page breaks, drawings and nothing; and runs with hidden or struck text or hidden nothing."""
    k = F.col("c_custkey")
    none, page, wrap = F.create_map().cast("map<string,string>"), F.create_map(F.lit("type"), F.lit("page")), F.create_map(F.lit("type"), F.lit("textWrapping"))
    token = lambda kind, tag, attrs, value: F.struct(F.lit(kind).alias("kind"), F.lit(tag).cast("string").alias("tag"), attrs.alias("attrs"), value.cast("string").alias("value"))
    text = token("t", None, none, F.when(k % 5 == 0, " 　").otherwise(F.col("c_name")))
    pair = lambda tag, attrs: (token("s", tag, attrs, F.lit(None)), token("e", tag, none, F.lit(None)))
    kinds = [F.array(text), F.array(*pair("tab", none), *pair("br", none)), F.array(text, *pair("br", wrap)), F.array(text, *pair("br", page)), F.array(*pair("drawing", none)), F.array(text).cast("array<struct<kind:string,tag:string,attrs:map<string,string>,value:string>>")]
    tokens = F.when(k % 6 == 5, F.slice(kinds[0], 1, 0))
    for i in range(5):
        tokens = F.when(k % 6 == i, kinds[i]).otherwise(tokens)
    run = lambda said, hidden, struck: F.struct(said.alias("text"), F.lit(hidden).cast("boolean").alias("hidden"), F.lit(struck).cast("boolean").alias("struck"))
    runs = F.when(k % 7 == 1, F.array(run(F.lit(""), None, None), run(F.col("c_name"), True, None))).when(k % 7 == 2, F.array(run(F.col("c_name"), None, True))).when(k % 7 == 3, F.array(run(F.lit(""), True, True))).otherwise(F.array(run(F.col("c_name"), None, False)))
    c = table(spark, sf_dir, "customer").select(k.alias("doc_id"), tokens.alias("x"), runs.alias("r"))
    return c.select("doc_id", T.is_blank_content(F.col("x")).alias("blank"), T.is_plain_field(F.col("x")).alias("plain"), T.has_complex_content(F.col("x")).alias("complex"), T.carries_marks(F.col("r")).alias("marked"))


@query("""WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS para_idx, l_suppkey % 5 = 0 AS label, l_partkey % 4 = 0 AS stop FROM lineitem), a AS (SELECT x.doc_id, x.para_idx, max(y.para_idx) AS label_idx FROM p x JOIN p y ON y.doc_id = x.doc_id AND y.para_idx <= x.para_idx AND y.label WHERE NOT x.label GROUP BY 1, 2) SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = a.doc_id AND p.para_idx > a.label_idx AND p.para_idx <= a.para_idx AND stop AND NOT label)""")
def list_field_lines(spark, sf_dir):
    """Items behind a labelled one up to the first that stops the list."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("para_idx"), (F.col("l_suppkey") % 5 == 0).alias("label"), (F.col("l_partkey") % 4 == 0).alias("stop"))
    return L.list_field_lines(p, F.col("label"), F.col("stop")).select("doc_id", "para_idx", "label_idx")


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_quantity AS w FROM lineitem), r AS (SELECT doc_id, i, w, 0 AS line, w AS used FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.i, w.w, CASE WHEN used + 2 + w.w <= 60 THEN line ELSE line + 1 END, CASE WHEN used + 2 + w.w <= 60 THEN used + 2 + w.w ELSE w.w END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1) SELECT doc_id, i - 1 AS pos, line FROM r""")
def packed_names(spark, sf_dir):
    """Quantities as widths of names that are set one after the other into lines of 60."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w))
    lists = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "l_quantity"))), lambda x: x.l_quantity).alias("w"))
    return lists.select("doc_id", F.posexplode(D.pack_names(F.col("w"), 60.0, 2.0)).alias("pos", "line"))


@query("""WITH w AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, l_quantity AS w, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
 s AS (SELECT doc_id, n, k, i, w, CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END AS r FROM w, generate_series(1, 50) g(k) WHERE k BETWEEN ceil(n / 3.0) AND n),
 f AS (SELECT doc_id, n, k, r, sum(w) + (count(*) - 1) * 2 <= 80 AS fits FROM s GROUP BY ALL), b AS (SELECT doc_id, any_value(n) AS n, coalesce(min(k) FILTER (WHERE ok), any_value(n)) AS k FROM (SELECT doc_id, n, k, bool_and(fits) AS ok FROM f GROUP BY ALL) GROUP BY 1)
 SELECT doc_id, r AS pos, (n // k + CASE WHEN r < n % k THEN 1 ELSE 0 END)::INT AS size FROM b, generate_series(0, 50) g(r) WHERE r < k""")
def signature_rows(spark, sf_dir):
    """Rows of at most three names, as even as possible, each within 80."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w))
    lists = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("i", "l_quantity"))).getField("l_quantity").alias("w"))
    sizes = lists.select("doc_id", F.posexplode_outer(D.signature_rows(F.col("w"), 80.0, 2.0)).alias("pos", "size")).where("pos is not null")
    return sizes.select("doc_id", F.col("pos").cast("long").alias("pos"), "size")


READINGS = {"中": "zhong", "大": "da", "国": "guo", "韩": "han", "日": "ri"}


@query("""WITH s AS (SELECT s_suppkey, ['大韩', '中国', '日本', '大中', '国'][(s_suppkey % 5 + 1)::INT] AS a, s_suppkey // 5 % 3 AS t FROM supplier) SELECT s_suppkey, CASE a WHEN '大韩' THEN 'da han' WHEN '中国' THEN 'zhong guo' WHEN '日本' THEN 'ri 本' WHEN '大中' THEN 'da zhong' ELSE 'guo' END || CASE t WHEN 0 THEN '' WHEN 1 THEN ' tai guo' ELSE ' x' END AS reading FROM s""")
def name_readings(spark, sf_dir):
    """Readings of names, a listed phrase before its characters, and characters without a reading as they are."""
    k = F.col("s_suppkey")
    name = F.concat(F.get(F.array(*map(F.lit, ("大韩", "中国", "日本", "大中", "国"))), (k % 5).cast("int")), F.get(F.array(*map(F.lit, ("", "大国", "X"))), (F.floor(k / 5) % 3).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(M.sort_key(name, "zh", {"大国": "tai guo", "大韩": "da han"}, READINGS), " ").alias("reading"))
