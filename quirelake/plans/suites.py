"""Queries over the given tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import numerals as N
from quirelake.functions import text as T
from quirelake.operators import audits as A
from quirelake.operators import evaluation as E
from quirelake.operators import layout as L
from quirelake.operators import names as M
from quirelake.operators import sequences as S
from quirelake.operators import snapshots as P
from quirelake.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So many rows are sorted by a task.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int | None:
    """How many partitions so many rows need, so that what a task sorts doesn't grow with the table; None for a small one."""
    return max(ceil(rows / TASK_ROWS), spark.sparkContext.defaultParallelism) if rows > TASK_ROWS else None


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in as many partitions as its rows need. rows: about how many it has."""
    n = tasks(df.sparkSession, rows)
    return df.repartition(n, *keys) if n else df


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paragraphs(table(spark, sf_dir, "documents"))


#: Lines of documents in SQL.
LINES = r"""lines AS (SELECT doc_id, i - 1 AS para_idx, l[i] AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL), generate_series(1, len(l)) AS g(i))"""
#: Blanks, labelled lines and canonical fragments in SQL, written from the rules of the format.
WS = r"[\s\x0B\x1C-\x1F\x{0085}\p{Z}]"
LABELLED = r"'(?i)^(委员会|Committee|议题|会议议题|Topic|Agenda|国家/席位|代表国家|代表国|国家|席位|Country|Represented country|Delegation country|代表|Delegate|起草国|提案国|主笔国|Sponsors?|附议国|联署国|Signatory|Signatories)\s*[:：]'"
UNMARKED = (
    r"CASE WHEN regexp_matches(text, '(?i)^WS*[a-z][.)）][^\x00-\x7f]') THEN regexp_replace(text, '(?i)^WS*[a-z][.)）]', '') "
    r"ELSE regexp_replace(text, '(?i)^WS*(第[一二三四五六七八九十百]+条|[0-9]+[.、．)]|[0-9]+WS{2,}|[a-z][.)）]WS|[（(][a-z]+[）)]|[（(][0-9]{1,2}[）)]|[（(][一二三四五六七八九十子丑寅卯辰巳午未申酉戌亥甲乙丙丁戊己庚辛壬癸]+[）)])WS*', '') END"
).replace("WS", WS)
FRAGMENT = rf"replace(lower(regexp_replace({UNMARKED}, '[^\p{{L}}\p{{N}}]', '', 'g')), 'ß', 'ss')"


@query(f"WITH {LINES} SELECT doc_id, para_idx, text FROM lines")
def text_paragraphs(spark, sf_dir):
    return lines(spark, sf_dir)


@query(r"""SELECT doc_id, CASE WHEN length(text) - length(regexp_replace(text, '[\x{3400}-\x{9FFF}]', '', 'g')) >= greatest(2, (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) // 4) THEN 'zh' ELSE 'en' END AS language FROM documents""")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text FROM lines) SELECT doc_id, count(*) FILTER (WHERE text <> '' AND NOT regexp_matches(text, {LABELLED}) AND (regexp_matches(text, '[。！？!?]$') OR (text LIKE '%.' AND len(string_split_regex(text, '{WS}+')) >= 6)
 OR regexp_matches(text, '(?i)^(第[一二三四五六七八九十百千零〇]+条|[一二三四五六七八九十]+[、.]|[（(][一二三四五六七八九十子丑寅卯辰巳午未申酉戌亥甲乙丙丁戊己庚辛壬癸]{{1,3}}[）)]|\d+(\.\d+)*[.、．)）]|[a-z][.)）]{WS}|[ivx]+\.{WS}|[（(][a-z]{{1,4}}[）)]|part{WS}+[ivx\d]+)'))) AS body_lines, count(*) AS n_lines FROM t GROUP BY doc_id""")
def body_lines(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(T.starts_body(F.col("text"))).alias("body_lines"), F.count("*").alias("n_lines"))


@query(rf"""WITH {LINES} SELECT doc_id, sha256(string_agg({FRAGMENT}, '' ORDER BY para_idx)) AS fingerprint, count(*) AS n_lines FROM lines WHERE NOT regexp_matches(text, {LABELLED}) GROUP BY doc_id""")
def document_fingerprint(spark, sf_dir):
    return A.document_fingerprint(table(spark, sf_dir, "documents"))


@query(rf"""WITH {LINES}, f AS (SELECT doc_id, sha256(string_agg({FRAGMENT}, '' ORDER BY para_idx)) AS fingerprint, count(*) AS n_lines FROM lines WHERE NOT regexp_matches(text, {LABELLED}) GROUP BY doc_id) SELECT fingerprint, min(doc_id) AS first_doc, count(*) AS n, sum(n_lines)::BIGINT AS n_lines FROM f GROUP BY fingerprint HAVING count(*) > 1""")
def canonical_copies(spark, sf_dir):
    return A.duplicate_groups(A.document_fingerprint(table(spark, sf_dir, "documents")))


@query(r"""SELECT doc_id, sha256(replace(lower(regexp_replace(translate(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '　') WHEN 2 THEN replace(text, ' ', chr(8195) || chr(133)) ELSE replace(text, ' ', chr(28) || '（：') END, '（）：', '():'), '[\s\x0B\x1C-\x1F\x{0085}\p{Z}]', '', 'g')), 'ß', 'ss')) AS signature FROM documents WHERE text IS NOT NULL""")
def visible_signature(spark, sf_dir):
    """Texts as they are, and with ideographic, wide, next-line and control blanks."""
    k, text = F.col("doc_id") % 4, F.col("text")
    other = F.when(k == 0, text).when(k == 1, F.replace(text, F.lit(" "), F.lit("\u3000"))).when(k == 2, F.replace(text, F.lit(" "), F.lit("\u2003\x85"))).otherwise(F.replace(text, F.lit(" "), F.lit("\x1c（：")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(T.visible_signature(other).cast("binary"), 256).alias("signature"))


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, para_idx, length(text) AS n, length(text) - length(regexp_replace(text, '[\x{{2E80}}-\x{{10FFFF}}]', '', 'g')) AS cjk, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS up, length(text) - length(regexp_replace(text, '[ ,.;:''’()-]', '', 'g')) AS light, length(text) - length(replace(text, chr(9), '')) AS tabs FROM lines) SELECT doc_id, para_idx, round(cjk * 1.0 + up * 0.7 + light * 0.3 + tabs * 2.0 + (n - cjk - up - light - tabs) * 0.5, 1)::DOUBLE AS width FROM c""")
def line_widths(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "para_idx", T.width_em(F.col("text")).cast("double").alias("width"))


@query(rf"""WITH {LINES} SELECT doc_id, para_idx, rule FROM (SELECT doc_id, para_idx, 'personal-email-review' AS rule, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', 1)) AS d FROM lines) WHERE lower(d) NOT IN ('example.com', 'example.org', 'example.net', 'example.invalid', 'users.noreply.github.com')
UNION ALL SELECT doc_id, para_idx, 'aws-access-key' FROM lines WHERE regexp_matches(text, '\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b') UNION ALL SELECT doc_id, para_idx, 'github-token' FROM lines WHERE regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{{20,}}|github_pat_[A-Za-z0-9_]{{30,}}') UNION ALL SELECT doc_id, para_idx, 'api-key' FROM lines WHERE regexp_matches(text, '\bsk-(?:proj-)?[A-Za-z0-9_-]{{24,}}')
UNION ALL SELECT doc_id, para_idx, 'private-key' FROM lines WHERE regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----') UNION ALL SELECT doc_id, para_idx, 'jwt' FROM lines WHERE regexp_matches(text, '\beyJ[A-Za-z0-9_-]{{12,}}\.[A-Za-z0-9_-]{{12,}}\.[A-Za-z0-9_-]{{12,}}') UNION ALL SELECT doc_id, para_idx, 'credential-url' FROM lines WHERE regexp_matches(text, '(?i)(?:https?|postgres(?:ql)?|mysql|redis)://[^\s/:]+:[^\s/@]+@')
UNION ALL SELECT doc_id, para_idx, 'personal-path' FROM lines WHERE regexp_matches(text, '/(?:Users|home)/[A-Za-z0-9._-]+/|[A-Za-z]:[\\/]Users[\\/][A-Za-z0-9._-]+[\\/]')
UNION ALL SELECT doc_id, para_idx, 'literal-credential-review' FROM (SELECT doc_id, para_idx, unnest(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|client[_-]?secret)\b\s*[=:]\s*["'']([^"''\n]{{8,}})["'']', 1)) AS v FROM lines) WHERE NOT regexp_matches(v, '(?i)example|placeholder|change.?me|your[_ -]|dummy|test|process\.env|os\.environ|\$\{{|/path/to')""")
def secret_scan(spark, sf_dir):
    return A.secret_scan(table(spark, sf_dir, "documents"), ["doc_id"])


@query(rf"""SELECT doc_id, NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]') AS valid, substr(regexp_replace(regexp_replace(text, '[\\/:*?"<>|\x00-\x1f\x7f]', '-', 'g'), '^{WS}+|{WS}+$', '', 'g'), 1, 180) AS file_name FROM documents WHERE text IS NOT NULL""")
def xml_text_and_filenames(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", T.valid_xml_text(F.col("text")).alias("valid"), T.safe_filename(F.col("text")).alias("file_name"))


def numbered_rows(spark, sf_dir) -> DataFrame:
    """The rows of each order as list items of several levels and families, some unnumbered, some opening a section."""
    lineitem = table(spark, sf_dir, "lineitem")
    li = spread(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_tax", "l_discount"), lineitem.count(), "l_orderkey").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_tax", "l_discount")
    part = F.col("l_partkey")
    return li.select(
        "l_orderkey", F.row_number().over(w).alias("idx"), (part % 12).cast("int").alias("level"), F.when(part % 7 != 0, F.col("l_returnflag")).alias("family"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("value"),
        (F.col("l_tax") > 0.07).alias("reset"), F.when(F.col("l_discount") > 0.05, "opens:").otherwise("plain").alias("text"), F.col("l_returnflag").alias("list_key"),
    )


NUMBERED = """n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_tax, l_discount) AS idx, l_partkey % 12 AS level, CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END AS family, l_suppkey % 3 + 1 AS value, l_tax > 0.07 AS reset,
 CASE WHEN l_discount > 0.05 THEN 'opens:' ELSE 'plain' END AS text, l_returnflag AS list_key FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_tax, l_discount FROM lineitem))"""


@query(f"""WITH {NUMBERED}, s AS (SELECT *, sum(reset::INT) OVER (PARTITION BY l_orderkey ORDER BY idx) AS section, lag(family) OVER (PARTITION BY l_orderkey ORDER BY idx) AS f0, lag(text) OVER (PARTITION BY l_orderkey ORDER BY idx) AS t0, lag(level) OVER (PARTITION BY l_orderkey ORDER BY idx) AS l0 FROM n),
 p AS (SELECT a.l_orderkey, a.idx, max(b.idx) AS at FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.section = b.section AND a.level = b.level AND a.family = b.family AND b.idx < a.idx
  WHERE NOT EXISTS (SELECT 1 FROM s q WHERE q.l_orderkey = a.l_orderkey AND q.family IS NOT NULL AND q.level < a.level AND q.idx > b.idx AND q.idx < a.idx) GROUP BY 1, 2)
 SELECT a.l_orderkey, a.idx, b.value AS previous FROM s a JOIN p USING (l_orderkey, idx) JOIN s b ON b.l_orderkey = a.l_orderkey AND b.idx = p.at WHERE a.value <> b.value + 1 AND NOT (a.value = 1 AND ((a.f0 IS NULL AND a.t0 LIKE '%:') OR coalesce(a.l0 < a.level, false)))""")
def numbering_gaps(spark, sf_dir):
    return S.sequence_issues(numbered_rows(spark, sf_dir), ["l_orderkey"], "idx").select("l_orderkey", F.col("idx").cast("long").alias("idx"), F.col("previous").cast("long").alias("previous"))


@query(r"""WITH b AS (SELECT conv_id, turn, text, CASE WHEN turn = 0 THEN 'subject' WHEN turn = 1 THEN 'preamble' WHEN role = 'user' THEN 'item' ELSE 'prose' END AS role, (conv_id + turn) % 3 AS level, conv_id % 2 = 0 AS zh, turn % 5 = 4 AS uncertain FROM conversations),
 c AS (SELECT conv_id, turn, lead(level) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM b WHERE role IN ('item', 'prose'))
 SELECT b.conv_id, b.turn, CASE WHEN role IN ('subject', 'preamble') THEN CASE WHEN zh THEN '，' ELSE ',' END WHEN uncertain THEN NULL WHEN nxt IS NULL THEN CASE WHEN zh THEN '。' ELSE '.' END WHEN nxt > level THEN CASE WHEN zh THEN '：' ELSE ':' END ELSE CASE WHEN zh THEN '；' ELSE ';' END END AS ending FROM b LEFT JOIN c ON b.conv_id = c.conv_id AND b.turn = c.turn""")
def clause_endings(spark, sf_dir):
    turn = F.col("turn")
    role = F.when(turn == 0, "subject").when(turn == 1, "preamble").when(F.col("role") == "user", "item").otherwise("prose")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", role.alias("role"), ((F.col("conv_id") + turn) % 3).alias("level"), F.lit(True).alias("operative"), (turn % 5 == 4).alias("uncertain"))
    return S.plan_endings(c, ["conv_id"], "turn", F.when(F.col("conv_id") % 2 == 0, "zh").otherwise("en")).select("conv_id", "turn", "ending")


@query(r"""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_wins(spark, sf_dir):
    return S.latest_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(r"""WITH s AS (SELECT user_id, event_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT user_id, event_id, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth FROM s""")
def quote_depth(spark, sf_dir):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return S.quote_depth(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], step).select("user_id", "event_id", "depth")


@query(f"""WITH {NUMBERED} SELECT a.l_orderkey, a.idx, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM n q WHERE q.l_orderkey = a.l_orderkey AND q.list_key = a.list_key AND q.level < a.level AND q.idx > b.idx AND q.idx < a.idx)) AS number
 FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.list_key = b.list_key AND a.level = b.level AND b.idx <= a.idx GROUP BY 1, 2""")
def list_labels(spark, sf_dir):
    return S.list_labels(numbered_rows(spark, sf_dir), ["l_orderkey"], "idx", "list_key", "level").select("l_orderkey", F.col("idx").cast("long").alias("idx"), F.col("number").cast("long").alias("number"))


@query(r"""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_token FROM conversations""")
def previous_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("token", F.when(F.col("role") == "user", F.col("turn")))
    return S.roman_context(c, ["conv_id"], "turn", "token").select("conv_id", "turn", "previous_token")


@query(r"""SELECT s_suppkey, CASE WHEN r_name IS NULL THEN 'unknown' ELSE 'resolved' END AS status, n_nationkey AS id, n_name AS display FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lower(n_name) WHEN s_suppkey % 3 = 1 THEN '  ' || n_name ELSE n_name || '?' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s LEFT JOIN (SELECT n_nationkey, n_name, lower(n_name) AS r_name FROM nation) ON r_name = lower(trim(name))""")
def resolve_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    k = F.col("s_suppkey") % 3
    names = s.select("s_suppkey", F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit("  "), "n_name")).otherwise(F.concat("n_name", F.lit("?"))).alias("name"))
    index = M.name_index(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("display")), ["display"])
    return M.resolve_names(names, index).select("s_suppkey", "status", "id", "display")


@query(r"""SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) = 1""")
def dedupe_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("id", F.col("c_nationkey"))
    return M.dedupe_names(c, ["c_mktsegment"], "c_custkey").select("c_mktsegment", "c_custkey")


@query(r"""SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY lower(n_name), n_nationkey) AS names FROM nation GROUP BY n_regionkey""")
def sort_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("k", F.lower("n_name"))
    return M.sort_names(n, ["n_regionkey"], "k", "n_nationkey", "n_name")


def _after(p: DataFrame) -> DataFrame:
    """The lines after made-up edits: some under another key, some longer, some doubled."""
    k = (F.col("doc_id") * 31 + F.col("para_idx") * 17) % 11
    edited = p.select("doc_id", F.when(k == 0, F.col("para_idx") + 200000).otherwise(F.col("para_idx")).alias("para_idx"), F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return edited.union(p.where(k == 2).select("doc_id", (F.col("para_idx") + 100000).alias("para_idx"), "text"))


_AFTER = "k AS (SELECT *, (doc_id * 31 + para_idx * 17) % 11 AS k FROM lines), af AS (SELECT doc_id, CASE WHEN k = 0 THEN para_idx + 200000 ELSE para_idx END AS para_idx, CASE WHEN k = 1 THEN text || '!' ELSE text END AS text FROM k UNION ALL SELECT doc_id, para_idx + 100000, text FROM k WHERE k = 2)"


@query(f"""WITH {LINES}, {_AFTER} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'created' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS kind FROM lines b FULL JOIN af a ON a.doc_id = b.doc_id AND a.para_idx = b.para_idx) GROUP BY kind""")
def snapshot_diff(spark, sf_dir):
    p = lines(spark, sf_dir)
    return P.snapshot_kinds(p, _after(p), ["doc_id", "para_idx"], "text").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, {_AFTER}, c AS (SELECT text, sum(n) AS n FROM (SELECT text, 1 AS n FROM lines UNION ALL SELECT text, -1 FROM af) GROUP BY text HAVING sum(n) <> 0) SELECT text, greatest(n, 0)::BIGINT AS n_missing, greatest(-n, 0)::BIGINT AS n_added FROM c""")
def multiset_diff(spark, sf_dir):
    p = lines(spark, sf_dir)
    return P.multiset_diff(p, _after(p), ["text"])


@query(r"""SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(q) OVER (PARTITION BY l_orderkey ORDER BY p) AS last FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS p, (min(l_partkey) % 10) * 100 + l_linenumber AS q FROM lineitem GROUP BY l_orderkey, l_linenumber)) WHERE q < last""")
def order_preserved(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    li = li.select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 10) * 100 + F.col("l_linenumber")).alias("pos2"))
    before = li.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("pos"))
    return P.order_broken(before, li.withColumnRenamed("pos2", "pos"), "l_orderkey", "l_linenumber", "pos")


@query(r"""WITH m AS (SELECT lower(o_orderpriority || '-' || (o_custkey % 100)) AS output, count(*) AS inputs FROM orders GROUP BY 1), i AS (SELECT DISTINCT lower(o_orderpriority || '-' || o_orderkey) AS output FROM orders) SELECT output, inputs, i.output IS NOT NULL AS is_input FROM m LEFT JOIN i USING (output) WHERE inputs > 1 OR i.output IS NOT NULL""")
def output_collisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = lambda tail: F.concat("o_orderpriority", F.lit("-"), tail.cast("string"))
    return P.output_collisions(o.select(name(F.col("o_custkey") % 100).alias("output")), o.select(name(F.col("o_orderkey")).alias("path")))


@query(r"""WITH a AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS h FROM documents), b AS (SELECT CASE WHEN doc_id % 8 = 0 THEN 'new/' ELSE 'doc/' END || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' ELSE 'changed' END AS finding FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def manifest_verify(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = lambda folder: F.concat(folder, k.cast("string"))
    a = P.file_manifest(d, path(F.lit("doc/")), F.col("text").cast("binary"))
    b = P.file_manifest(d, path(F.when(k % 8 == 0, "new/").otherwise("doc/")), F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"))
    return P.manifest_verify(a, b)


@query(r"""SELECT 'quality' AS field, count(*) AS paired, count(*) FILTER (WHERE l.quality = d.q) AS equal, ((SELECT count(*) FROM documents) - count(*)) AS unpaired FROM labels l JOIN (SELECT doc_id, CASE WHEN regexp_matches(text, '###|!!') THEN 0 ELSE 1 END AS q FROM documents) d USING (doc_id)""")
def parity(spark, sf_dir):
    rule = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").rlike("###|!!"), 0).otherwise(1).alias("quality"))
    return P.parity(table(spark, sf_dir, "labels"), rule, ["doc_id"], ["quality"])


@query(r"""SELECT page_id, tag, n FROM (SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]'))::BIGINT AS n FROM pages, (VALUES ('p'), ('li'), ('a'), ('b'), ('h1'), ('table')) t(tag)) WHERE n > 0""")
def structure_counts(spark, sf_dir):
    return P.structure_counts(table(spark, sf_dir, "pages"), "page_id", F.col("html"), ["p", "li", "a", "b", "h1", "table"])


@query(r"""WITH l AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '[?#].*$', '') AS target FROM pages), k AS (SELECT DISTINCT '/' || split_part(regexp_replace(url, '^https?://', ''), '/', 2) AS path FROM pages) SELECT target, count(*) AS links FROM l WHERE target LIKE '/%' AND target NOT IN (SELECT path FROM k) GROUP BY target""")
def dangling_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    known = pages.select(F.concat(F.lit("/"), F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(2))).alias("path"))
    return A.dangling_targets(A.link_targets(pages), known)


@query(r"""SELECT path, CASE k WHEN 0 THEN 'generated' WHEN 1 THEN 'suffix' WHEN 2 THEN 'env' WHEN 3 THEN 'fixture' WHEN 6 THEN 'hosting' END AS finding FROM (SELECT page_id % 8 AS k, CASE page_id % 8 WHEN 3 THEN 'qa' WHEN 6 THEN '.openai' ELSE 'site' END || regexp_replace(url, '^https?://[^/]*', '') || CASE page_id % 8 WHEN 0 THEN '/dist/x.js' WHEN 1 THEN '/key.pem' WHEN 2 THEN '/.env.local' WHEN 4 THEN '/.env.example' WHEN 5 THEN '/.log' ELSE '/key.PEM' END AS path FROM pages) WHERE k NOT IN (4, 5, 7)""")
def path_audit(spark, sf_dir):
    k = F.col("page_id") % 8
    top = F.when(k == 3, "qa").when(k == 6, ".openai").otherwise("site")
    name = F.when(k == 0, "/dist/x.js").when(k == 1, "/key.pem").when(k == 2, "/.env.local").when(k == 4, "/.env.example").when(k == 5, "/.log").otherwise("/key.PEM")
    return A.path_audit(table(spark, sf_dir, "pages").select(F.concat(top, F.regexp_replace("url", "^https?://[^/]*", ""), name).alias("path")))


@query(r"""WITH v AS (SELECT DISTINCT unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2), left(p_name, 3)]) AS v FROM part) SELECT p_partkey, max_by(v, length(v)) AS phrase FROM part JOIN v ON starts_with(p_name, v) AND (p_name = v OR NOT regexp_matches(substr(p_name, length(v) + 1, 1), '[\p{L}\p{N}_]')) WHERE v <> '' GROUP BY p_partkey""")
def prefix_join(spark, sf_dir):
    """First words, first two words and first three letters of names as phrases; letters end no word."""
    part = table(spark, sf_dir, "part")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    vocabulary = part.select(F.explode(F.array(word(1), F.concat(word(1), F.lit(" "), word(2)), F.substring("p_name", 1, 3))).alias("v")).distinct()
    return A.prefix_join(part, vocabulary, "p_name", "v", ["p_partkey"])


@query(r"""SELECT 'd' || doc_id || CASE doc_id % 5 WHEN 4 THEN '.docx' ELSE '.bin' END AS path FROM documents WHERE doc_id % 5 IN (1, 2) UNION ALL SELECT 'd' || doc_id || '.docx!word/media/a.png' FROM documents WHERE doc_id % 5 = 4""")
def binaries_to_review(spark, sf_dir):
    """Texts as files: some with bytes that are no UTF-8, some cut inside a character, some as packages with a picture."""
    k = F.col("doc_id") % 5
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(k == 4, ".docx").otherwise(".bin"))
    content = F.when(k == 1, F.concat(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.unhex(F.lit("FF00")))).when(k == 2, F.concat(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.unhex(F.lit("E4B8")))).otherwise(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    entries = docs.where(k == 4).select(name.alias("doc_id"), F.explode(F.array(F.lit("word/document.xml"), F.lit("word/media/a.png"), F.lit("word/media/"), F.lit("_rels/.rels"))).alias("name"), F.lit(None).cast("string").alias("problem"))
    return A.binaries_to_review(docs.select(name.alias("path"), content.alias("content")), entries)


@query(r"""SELECT o_orderstatus, round(avg(e), 2) AS mean_excess, round(max(e), 2) AS max_excess, count(*) FILTER (WHERE blocked) AS blocked FROM (SELECT o_orderstatus, s - base + CASE WHEN blocked THEN 100 ELSE 0 END AS e, blocked FROM (SELECT o_custkey, o_orderstatus, round((o_orderkey % 7) * 50.0 + (o_orderkey % 5) * 2.0 + (o_orderkey % 3) * 0.2, 1)::DOUBLE AS s, o_orderkey % 13 = 0 AS blocked FROM orders WHERE o_orderstatus <> 'F') JOIN (SELECT o_custkey, max(round((o_orderkey % 7) * 50.0 + (o_orderkey % 5) * 2.0 + (o_orderkey % 3) * 0.2, 1)::DOUBLE) AS base FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) USING (o_custkey)) GROUP BY o_orderstatus""")
def excess_error(spark, sf_dir):
    k = F.col("o_orderkey")
    scores = E.weighted_score(table(spark, sf_dir, "orders").withColumns({"content": k % 7, "ws": k % 5, "char": k % 3}), {"content": 50.0, "ws": 2.0, "char": 0.2})
    return E.excess_error(scores, "o_custkey", "o_orderstatus", "F", k % 13 == 0)


@query(r"""SELECT event_type, n, examples FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) JOIN (SELECT event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS examples FROM (SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 6) GROUP BY 1) USING (event_type)""")
def diff_rollup(spark, sf_dir):
    return E.diff_rollup(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", [F.col("event_id")], 6, "event_id")


@query(r"""SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS d, count(*) AS n, min(l_orderkey) AS example FROM lineitem GROUP BY 1, 2, 3""")
def value_pair_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("d", F.date_format("l_shipdate", "yyyy-MM"))
    return E.value_pair_counts(li, "l_returnflag", "l_linestatus", "d", "l_orderkey")


@query(r"""SELECT o_orderpriority, CASE WHEN o_totalprice > 150000 THEN 'OK' ELSE 'FAILED' END AS status, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)""")
def batch_ledger(spark, sf_dir):
    return E.batch_ledger(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_totalprice") > 150000)


@query(r"""SELECT o_orderkey, CASE WHEN e IS NULL THEN 'not_run' WHEN e > 0 THEN 'failed' ELSE 'checked' END AS status, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25) AS e, count(*) FILTER (WHERE l_returnflag = 'A') AS w FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def diagnostic_report(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), "error").when(F.col("l_returnflag") == "A", "warning").otherwise("pass").alias("status"))
    return E.diagnostic_report(table(spark, sf_dir, "orders"), f, "o_orderkey")


@query(r"""SELECT user_id, string_agg(event_type, ';' ORDER BY i, event_type) AS notes FROM (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2) GROUP BY user_id""")
def edit_summary(spark, sf_dir):
    return E.edit_summary(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


#: Ordinals in SQL, for values up to 50.
_MARKER = """CASE WHEN p_partkey % 8 = 0 THEN n || '.' WHEN p_partkey % 8 = 1 AND n <= 26 THEN '(' || chr(96 + n) || ')' WHEN p_partkey % 8 = 2 THEN '(' || roman || ')' WHEN p_partkey % 8 = 3 THEN roman || '.'
 WHEN p_partkey % 8 = 4 THEN '第' || zh || '条' WHEN p_partkey % 8 = 5 THEN '（' || zh || '）' WHEN p_partkey % 8 = 6 THEN '（' || CASE WHEN n <= 12 THEN z[n] ELSE z[(n - 13) // 12 + 1] || z[(n - 13) % 12 + 1] END || '）' WHEN p_partkey % 8 = 7 THEN '（' || CASE WHEN n <= 10 THEN g[n] ELSE g[(n - 11) // 10 + 1] || g[(n - 11) % 10 + 1] END || '）' END"""


@query(f"""WITH b AS (SELECT p_partkey, p_size, p_size AS n, string_split('子丑寅卯辰巳午未申酉戌亥', '') AS z, string_split('甲乙丙丁戊己庚辛壬癸', '') AS g, (['', 'x', 'xx', 'xxx', 'xl', 'l'])[n // 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[n % 10 + 1] AS roman,
 CASE WHEN n >= 20 THEN (['二', '三', '四', '五'])[n // 10 - 1] ELSE '' END || CASE WHEN n >= 10 THEN '十' ELSE '' END || (['', '一', '二', '三', '四', '五', '六', '七', '八', '九'])[n % 10 + 1] AS zh FROM part), m AS (SELECT *, {_MARKER} AS marker, p_partkey % 8 AS k FROM b)
 SELECT p_partkey, p_size, marker, CASE WHEN marker IS NULL THEN NULL WHEN k = 0 THEN 'decimal' WHEN k = 1 OR k IN (2, 3) AND length(roman) = 1 THEN 'letter' WHEN k = 2 THEN 'roman' WHEN k = 3 THEN 'roman-dot' WHEN k = 4 THEN 'article' WHEN k = 5 THEN 'chinese' WHEN k = 6 THEN 'zodiac' ELSE 'stem' END AS family,
 CASE WHEN marker IS NULL THEN NULL WHEN k IN (2, 3) AND length(roman) = 1 THEN ascii(roman) - 96 ELSE n END::INT AS value FROM m""")
def markers(spark, sf_dir):
    k, size = F.col("p_partkey") % 8, F.col("p_size")
    marker = F.lit(None).cast("string")
    for i, language in enumerate(("en", "zh")):
        for level in range(4):
            marker = F.when(k == 4 * i + level, N.marker_text(language, level, size)).otherwise(marker)
    df = table(spark, sf_dir, "part").withColumn("marker", marker)
    m = N.marker_of(F.concat("marker", F.lit(" "), "p_name"))
    return df.select("p_partkey", "p_size", "marker", m["family"].alias("family"), m["value"].alias("value"))


@query(r"""SELECT c_nationkey % 5 * 100 + c_custkey % 60 AS doc, bool_and(c_acctbal > 0 OR c_custkey % 7 > 1) AS uniform, count(*) FILTER (WHERE c_acctbal > 0 OR c_custkey % 7 > 1) AS marked, count(*) AS runs FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1""")
def uniform_damage(spark, sf_dir):
    """Customers as runs; every seventh is blank and without the mark."""
    k = F.col("c_custkey") % 7
    runs = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5 * 100 + F.col("c_custkey") % 60).alias("doc"), F.when(k == 0, "\u3000 ").otherwise(F.col("c_name")).alias("text"), ((F.col("c_acctbal") > 0) | (k > 1)).alias("_mark"), k.alias("k"))
    return A.uniform_damage(runs, "doc", F.col("_mark") & (F.col("k") != 0))


@query(rf"""WITH {LINES}, r AS (SELECT doc_id, para_idx, text, doc_id % 6 = 0 OR para_idx % 4 = 1 AS h, doc_id % 10 = 0 OR (doc_id + para_idx) % 5 = 2 AS s FROM lines WHERE regexp_matches(text, '[^\s\x0B\x1C-\x1F\x{{0085}}\p{{Z}}]')), w AS (SELECT *, bool_and(h) OVER (PARTITION BY doc_id) AS ah, bool_and(s) OVER (PARTITION BY doc_id) AS as_ FROM r)
 SELECT doc_id, para_idx, CASE WHEN h AND NOT ah AND s AND NOT as_ THEN 'hidden-and-struck' WHEN h AND NOT ah THEN 'hidden' ELSE 'struck' END AS note FROM w WHERE h AND NOT ah OR s AND NOT as_""")
def mark_notes(spark, sf_dir):
    p, k = lines(spark, sf_dir), F.col("para_idx")
    return A.mark_notes(p, ["doc_id", "para_idx"], "doc_id", (F.col("doc_id") % 6 == 0) | (k % 4 == 1), (F.col("doc_id") % 10 == 0) | ((F.col("doc_id") + k) % 5 == 2))


@query(r"""SELECT l_orderkey, sum((l_discount > 0.05)::INT + (l_tax > 0.04)::INT + (l_quantity > 40)::INT)::BIGINT AS noise FROM lineitem GROUP BY 1""")
def noise_count(spark, sf_dir):
    return A.noise_count(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_quantity") > 40])


@query(r"""SELECT c_custkey AS doc_id, field FROM (SELECT c_custkey, c_mktsegment AS doc_type, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR END AS nation FROM customer) c, (VALUES ('BUILDING', 'name'), ('BUILDING', 'nation'), ('MACHINERY', 'nation')) r(t, field) WHERE doc_type = t AND (CASE WHEN field = 'name' THEN name ELSE nation END IS NULL OR CASE WHEN field = 'name' THEN name ELSE nation END = '')""")
def missing_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    models = c.select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("doc_type"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).alias("nation"))
    required = spark.createDataFrame([("BUILDING", "name"), ("BUILDING", "nation"), ("MACHINERY", "nation")], "doc_type string, field string")
    return M.missing_fields(models, required, ["name", "nation"])


@query(r"""WITH p AS (SELECT n_regionkey, n_nationkey::BIGINT AS party_pos, n_name AS party, lower(n_name) AS k, row_number() OVER (PARTITION BY n_regionkey, lower(n_name) ORDER BY n_nationkey) AS n FROM nation),
 l AS (SELECT n_regionkey, s_suppkey AS entry_pos, CASE s_suppkey % 4 WHEN 0 THEN 'Representative of the ' || n_name WHEN 1 THEN n_name || ' Representative' WHEN 2 THEN 'On behalf of ' || n_name ELSE 'Representative of ' || s_name END AS label, CASE WHEN s_suppkey % 4 = 3 THEN lower(s_name) ELSE lower(n_name) END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 e AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey, k ORDER BY entry_pos) AS n FROM l) SELECT coalesce(p.n_regionkey, e.n_regionkey) AS n_regionkey, party, label, party_pos, entry_pos FROM p FULL JOIN e ON p.n_regionkey = e.n_regionkey AND p.k = e.k AND p.n = e.n""")
def match_parties(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    p = nation.select("n_regionkey", F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").join(M.bounded(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    label = F.when(k == 0, F.concat(F.lit("Representative of the "), "n_name")).when(k == 1, F.concat("n_name", F.lit(" Representative"))).when(k == 2, F.concat(F.lit("On behalf of "), "n_name")).otherwise(F.concat(F.lit("Representative of "), "s_name"))
    e = s.select("n_regionkey", F.col("s_suppkey").alias("pos"), label.alias("name"))
    return M.match_parties(p, e, ["n_regionkey"], "name", "pos").select("n_regionkey", "party", "label", "party_pos", "entry_pos")


@query(r"""SELECT conv_id, turn, CASE WHEN has = 0 THEN 'numbered' WHEN has = n THEN 'kept' ELSE 'mixed' END AS status, CASE WHEN has = 0 THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS planned FROM (SELECT conv_id, turn, count(CASE WHEN conv_id % 3 = 0 OR conv_id % 3 = 1 AND turn % 2 = 0 THEN turn END) OVER (PARTITION BY conv_id) AS has, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def statement_numbers(spark, sf_dir):
    k = F.col("conv_id") % 3
    c = table(spark, sf_dir, "conversations").withColumn("number", F.when((k == 0) | ((k == 1) & (F.col("turn") % 2 == 0)), F.col("turn")))
    return S.statement_numbers(c, ["conv_id"], "turn", "number").select("conv_id", "turn", "status", F.col("planned").cast("long").alias("planned"))


def _labelled(spark, sf_dir) -> DataFrame:
    """Lines of which some got a header label."""
    k = F.col("doc_id") % 4
    return lines(spark, sf_dir).withColumn("text", F.when((F.col("para_idx") < 2) & (k == 1), F.concat(F.lit("Topic: "), "text")).when((F.col("para_idx") == 0) & (k == 2), F.concat(F.lit("Committee： "), "text")).otherwise(F.col("text")))


@query(rf"""WITH {LINES} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'topic' ELSE 'committee' END AS field, count(*) AS lines, regexp_replace(arg_max(text, para_idx), '^{WS}+|{WS}+$', '', 'g') AS value FROM lines WHERE (doc_id % 4 = 1 AND para_idx < 2) OR (doc_id % 4 = 2 AND para_idx = 0) GROUP BY 1, 2""")
def header_fields(spark, sf_dir):
    return S.header_fields(_labelled(spark, sf_dir))


@query(f"""WITH {LINES}, k AS (SELECT *, (doc_id * 31 + para_idx * 17) % 11 AS k FROM lines) SELECT doc_id, para_idx::VARCHAR AS para_key, CASE WHEN k = 0 THEN 'unauthorised-removed' WHEN doc_id % 2 = 0 THEN 'wrong-blank-ending' ELSE 'unauthorised-changed' END AS code FROM k WHERE k < 2 UNION ALL SELECT doc_id, (para_idx + 100000)::VARCHAR, 'unauthorised-created' FROM k WHERE k = 2 UNION ALL SELECT doc_id, (para_idx + 200000)::VARCHAR, 'unauthorised-created' FROM k WHERE k = 0""")
def integrity_audit(spark, sf_dir):
    p = lines(spark, sf_dir)
    keyed = lambda df: df.select("doc_id", F.col("para_idx").cast("string").alias("para_key"), "text")
    edits = p.where("(doc_id * 31 + para_idx * 17) % 11 = 1 and doc_id % 2 = 0").select("doc_id", F.col("para_idx").cast("string").alias("para_key"), F.explode(F.array(F.lit("ending"), F.lit("blank"))).alias("kind"), F.lit(None).cast("string").alias("expected"))
    return L.integrity_audit(keyed(p), keyed(_after(p)), edits)


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, para_idx, CASE WHEN para_idx = 0 THEN 'A Position Paper' ELSE regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') END AS text FROM lines), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n FROM t WHERE para_idx > 0 AND regexp_matches(text, '\S')) WHERE n <= 4),
 w AS (SELECT *, bool_and(NOT regexp_matches(text, {LABELLED}) AND NOT (regexp_matches(text, '[。！？!?]$') OR (text LIKE '%.' AND len(string_split_regex(text, '{WS}+')) >= 6) OR regexp_matches(text, '(?i)^(\d+(\.\d+)*[.、．)）]|[a-z][.)）]{WS}|[ivx]+\.{WS}|[（(][a-z]{{1,4}}[）)]|part{WS}+[ivx\d]+)'))) OVER (PARTITION BY doc_id) AS open, bool_and(length(text) <= 80 AND NOT regexp_matches(text, '[。；;！？!?]')) OVER (PARTITION BY doc_id) AS fine, count(*) OVER (PARTITION BY doc_id) AS c FROM r)
 SELECT doc_id, para_idx, (['committee', 'topic', 'country', 'delegate'])[n] AS field, text, CASE WHEN fine THEN 0.97 ELSE 0.58 END::DOUBLE AS confidence FROM w WHERE open AND c = 4""")
def header_candidates(spark, sf_dir):
    return L.stripped_header(lines(spark, sf_dir).withColumn("text", F.when(F.col("para_idx") == 0, "A Position Paper").otherwise(F.col("text"))))


@query("""SELECT l_orderkey AS doc_id, l_returnflag AS list_key, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'several-levels' WHEN l_returnflag = 'R' AND l_orderkey % 5 = 0 THEN 'used-outside' WHEN bool_or(l_quantity > 49) THEN 'unsafe-definition' WHEN max(l_quantity * 3) > 99 THEN 'out-of-range' END AS reason FROM lineitem GROUP BY 1, 2""")
def list_plans(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("list_key"), F.col("l_linestatus").alias("level"), (F.col("l_quantity") > 49).alias("unsafe"), (F.col("l_quantity") * 3).alias("value"))
    return L.plan_native_lists(li, li.where("list_key = 'R' and doc_id % 5 = 0"))


@query("""SELECT user_id AS doc_id, string_agg(event_type, ';' ORDER BY i, event_type) AS warnings FROM (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2) GROUP BY user_id""")
def distinct_warnings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("warning"))
    return L.distinct_warnings(e).withColumn("warnings", F.array_join("warnings", ";"))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(text, '\\S')) AS blank_a FROM lines GROUP BY 1), {_AFTER}, c AS (SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(text, '\\S')) AS blank_b FROM af GROUP BY 1) SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, blank_a, blank_b FROM b FULL JOIN c ON b.doc_id = c.doc_id""")
def blank_balance(spark, sf_dir):
    p = lines(spark, sf_dir)
    return L.blank_balance(p, _after(p))
