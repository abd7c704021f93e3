"""The registered queries of the main engine, and SQL that gives the same rows from the tables' columns."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .functions import text as tx
from .functions.language import detect_language
from .operators import fields as fd
from .operators import lines as ln
from .operators import rules, tables
from .operators.timeline import timeline
from .plans.analyze import Providers, analyze, to_json
from .render import CLAIMS, CONTOURS
from .sources import uploads as up
from .storage import materialize

QUERIES, SQL = {}, {}
#: The year that bounds dates in the registered queries.
AS_OF = 2026


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), F.col("text").alias("raw_text"))


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Indexed lines and document texts of the rendered claims."""
    pages = render.pages(spark, sf_dir).repartition("doc_id")  # dealt once, as pages; all that follows is keyed by doc_id
    lines = ln.index_lines(ln.clean_lines(ln.split_pages(pages), normalise=False))
    return lines, ln.document_texts(lines)


# ---- text --------------------------------------------------------------------------------------------------------------


def _clean_sql(col: str) -> str:
    """clean_line for an engine without back-references: runs of each ASCII punctuation mark in turn."""
    t = f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '</?[a-zA-Z][^>]{{0,30}}>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    tidy = "t"
    for c in string.punctuation.replace("_", ""):
        q = "''" if c == "'" else c
        tidy = f"regexp_replace({tidy}, '[{chr(92)}{q}]{{3,}}', '{chr(92) * 2 if c == chr(92) else q}{chr(92) * 2 if c == chr(92) else q}', 'g')"
    tidy = f"regexp_replace(regexp_replace(regexp_replace({tidy}, '\\s+([,.:;!?)])', '\\1', 'g'), '([(])\\s+', '\\1', 'g'), ' {{2,}}', ' ', 'g')"
    letters = "length(regexp_replace(t, '[^\\p{L}]', '', 'g'))"
    return t, tidy, f"NOT (length(t) = 0 OR (length(t) <= 2 AND {letters} < length(t)) OR (length(t) > 4 AND {letters} / CAST(length(t) AS DOUBLE) < 0.25))"


_T, _TIDY, _KEPT = _clean_sql("raw")


@query(f"""
WITH l AS (SELECT doc_id, CAST(UNNEST(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, UNNEST(string_split(text, chr(10))) AS raw FROM documents),
     s AS (SELECT doc_id, line_no, {_T} AS t FROM l)
SELECT doc_id, line_no, {_TIDY} AS text FROM s WHERE {_KEPT}
""")
def clean_lines(spark, sf_dir):
    pages = _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("raw_text"))
    return ln.clean_lines(ln.split_pages(pages)).select("doc_id", "line_no", "text")


@query("SELECT doc_id, CAST(UNNEST(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, UNNEST(string_split(text, chr(10))) AS text FROM documents")
def split_lines(spark, sf_dir):
    pages = _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("raw_text"))
    return ln.split_pages(pages).select("doc_id", "line_no", F.col("raw_text").alias("text"))


_INDEX = """
WITH l AS (SELECT conv_id AS doc_id, turn AS page_no, UNNEST(range(len(string_split(text, chr(10))))) AS line_no, UNNEST(string_split(text, chr(10))) AS text FROM conversations),
     n AS (SELECT *, row_number() OVER w - 1 AS seq, CASE WHEN lag(page_no) OVER w <> page_no THEN 1 ELSE 0 END AS turned FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, line_no)),
     i AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(turned) OVER (PARTITION BY doc_id ORDER BY seq) AS char_start FROM n)
"""


def _indexed_talks(spark, sf_dir):
    return ln.index_lines(ln.split_pages(_talks(spark, sf_dir)).withColumnRenamed("raw_text", "text"))


@query(_INDEX + "SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(text) AS INTEGER) AS char_end FROM i")
def line_offsets(spark, sf_dir):
    return _indexed_talks(spark, sf_dir).select("doc_id", "seq", "char_start", "char_end")


@query(_INDEX + "SELECT doc_id, md5(string_agg(CASE WHEN turned = 1 THEN chr(10) ELSE '' END || text, chr(10) ORDER BY seq)) AS text_md5 FROM i GROUP BY doc_id")
def document_text(spark, sf_dir):
    return ln.document_texts(_indexed_talks(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@query(_INDEX + "SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, string_agg(text, chr(10) ORDER BY seq) AS text FROM i GROUP BY doc_id, page_no")
def page_text(spark, sf_dir):
    return ln.page_texts(_indexed_talks(spark, sf_dir))


@query(_INDEX + ", m AS (SELECT doc_id, CAST(floor(max(char_start + length(text)) / 2) AS BIGINT) AS middle FROM i GROUP BY doc_id) SELECT m.doc_id, CAST(arg_max(i.page_no, i.char_start) AS INTEGER) AS page FROM m JOIN i ON i.doc_id = m.doc_id AND i.char_start <= m.middle GROUP BY m.doc_id")
def line_lookup(spark, sf_dir):
    docs = ln.document_texts(_indexed_talks(spark, sf_dir))
    return docs.select("doc_id", ln.source_of(F.col("lines"), F.col("lines.char_start"), F.lit(0), F.length("text"))["page"].alias("page"))


_ALPHA, _ALNUM, _SEEN = (f"length(regexp_replace(text, '{p}', '', 'g'))" for p in (r"[^\p{L}]", r"[^\p{L}\p{N}]", r"\s"))


@query(f"SELECT doc_id, coalesce(length(text) >= 25 AND NOT contains(text, '(cid:') AND {_ALPHA} >= 20 AND {_ALNUM} / CAST(nullif({_SEEN}, 0) AS DOUBLE) >= 0.55, false) AS reliable FROM documents")
def reliability(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.reliable(F.col("text")).alias("reliable"))


@query()
def clean_texts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query()
def chunks_by_paragraph(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunk_paragraphs(F.col("text"))).alias("nth", "chunk"))


@query()
def chunks_by_chars(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunk_chars(F.col("text"))).alias("nth", "chunk"))


@query()
def languages(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "lang", detect_language(F.col("text")).alias("detected"))


_STUB = "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '12' ELSE 'translated text of the document that is long enough' END", "CASE WHEN doc_id % 3 = 0 THEN 'second' END"
_LANG = "CASE WHEN doc_id % 7 = 0 THEN 'gu' WHEN doc_id % 7 = 1 THEN 'auto' ELSE lang END"


@query(f"""
WITH d AS (SELECT doc_id, text, {_LANG} AS l, {_STUB[0]} AS a, {_STUB[1]} AS b FROM documents),
     e AS (SELECT *, NOT (coalesce(a, '') = '' OR length(a) < least(10, length(text) // 10) OR (length(a) > 20 AND length(regexp_replace(a, '[^A-Za-z]', '', 'g')) / CAST(length(a) AS DOUBLE) < 0.4)) AS ok FROM d)
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'noop' WHEN l = 'en' THEN 'passthrough' WHEN l = 'gu' AND b IS NOT NULL THEN 'mymemory' WHEN l = 'gu' AND ok THEN 'opus-mt-fallback'
       WHEN l = 'gu' THEN 'passthrough-failed' WHEN ok THEN 'opus-mt' WHEN b IS NOT NULL THEN 'mymemory-fallback' WHEN coalesce(a, '') <> '' THEN 'opus-mt-low-quality' ELSE 'passthrough-failed' END AS engine
FROM e
""")
def translation_route(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_LANG).alias("l"), F.expr(_STUB[0]).alias("a"), F.expr(_STUB[1]).alias("b"))
    return docs.select("doc_id", tx.translation(F.col("text"), F.col("l"), F.col("a"), F.col("b"))[1].alias("engine"))


_DATES = "CASE doc_id % 6 WHEN 0 THEN '3/4/2021' WHEN 1 THEN '31-02-2021' WHEN 2 THEN '12-Apr-2020' WHEN 3 THEN '2 March 2019' WHEN 4 THEN '2022-1-9' ELSE '01/02/21' END"


@query(f"SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN '2021-04-03' WHEN 2 THEN '2020-04-12' WHEN 3 THEN '2019-03-02' WHEN 4 THEN '2022-01-09' END AS DATE) AS parsed FROM documents")
def parsed_dates(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.parse_date(F.expr(_DATES)).alias("parsed"))


# ---- sources ------------------------------------------------------------------------------------------------------------


def _uploads(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    path = F.concat(F.lit("in/my file "), F.col("doc_id"), F.when(F.col("doc_id") % 5 == 0, ".exe").when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".png"))
    mime = F.when(F.col("doc_id") % 5 == 0, "application/octet-stream").when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("image/png")
    content = F.when(F.col("doc_id") % 9 == 0, F.lit(b"")).otherwise(F.encode(F.concat(F.when(F.col("doc_id") % 2 == 0, "%PDF-1.7 ").otherwise(""), "text"), "utf-8"))
    lang = F.when(F.col("doc_id") % 13 == 0, "no good!").when(F.col("doc_id") % 3 == 0, " EN ")
    return d.select("doc_id", path.alias("path"), mime.alias("mime"), lang.alias("lang_arg"), content.alias("content")).withColumn("length", F.octet_length("content"))


_FILES = """
WITH u AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE CASE WHEN doc_id % 2 = 0 THEN '%PDF-1.7 ' ELSE '' END || text END AS content FROM documents)
"""


@query(_FILES + """
SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 500 WHEN length(content) = 0 THEN 400 WHEN doc_id % 13 = 0 THEN 400 END AS INTEGER) AS status, starts_with(content, '%PDF-') AS pdf,
       'my_file_' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 5 = 0 THEN '.exe' WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.png' END AS name,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'en' ELSE 'auto' END AS lang, sha256(content) AS sha256
FROM u
""")
def upload_checks(spark, sf_dir):
    return up.check_uploads(_uploads(spark, sf_dir)).select("doc_id", "status", "pdf", "name", "lang", "sha256")


@query("WITH d AS (SELECT doc_id, sha256(text) AS sha256 FROM documents) SELECT d.doc_id, d.sha256, g.first, g.copies FROM d JOIN (SELECT sha256, min(doc_id) AS first, count(*) AS copies FROM d GROUP BY sha256) g USING (sha256)")
def equal_contents(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return up.first_of_equal(rows, ["sha256"], "doc_id").select("doc_id", "sha256", "first", "copies")


# ---- fields -------------------------------------------------------------------------------------------------------------

_UHID = "'UH' || lpad(CAST(ck AS STRING), 6, '0')"
_VALUES = f"""
SELECT doc_id, 'patient_name' AS key, name AS value, CAST(1.0 AS DOUBLE) AS confidence FROM c WHERE doc_id % 11 <> 0
UNION ALL SELECT doc_id, 'uhid', {_UHID}, CAST(1.0 AS DOUBLE) FROM c WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 0
UNION ALL SELECT doc_id, 'admission_date', adm_text, CAST(1.0 AS DOUBLE) FROM c
UNION ALL SELECT doc_id, 'discharge_date', dis_text, CAST(1.0 AS DOUBLE) FROM c
UNION ALL SELECT doc_id, 'diagnosis', illness, CAST(1.0 AS DOUBLE) FROM c
UNION ALL SELECT doc_id, 'total_amount', amount, CAST(1.0 AS DOUBLE) FROM c
UNION ALL SELECT doc_id, 'age', CAST(20 + doc_id % 60 AS STRING), CAST(1.0 AS DOUBLE) FROM c
UNION ALL SELECT doc_id, 'pmjay_procedure_codes', 'M-07-' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), CAST(0.7 AS DOUBLE) FROM c
"""
_LABELLED = f"""
SELECT doc_id, 'referring_doctor' AS key, 'Self Xab' AS value, CAST(0.85 AS DOUBLE) AS confidence FROM c WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, 'ward', 'General', CAST(0.85 AS DOUBLE) FROM c WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'uhid', {_UHID}, CAST(0.75 AS DOUBLE) FROM c WHERE doc_id % 7 <> 0 AND doc_id % 13 = 0
UNION ALL SELECT doc_id, 'sample_id', 'S-' || CAST(doc_id AS STRING), CAST(0.85 AS DOUBLE) FROM c
"""


@query(f"WITH c AS ({CLAIMS}) {_VALUES}")
def typed_fields(spark, sf_dir):
    return fd.merge_sides(fd.pattern_fields(_claims(spark, sf_dir)[1])).select("doc_id", "key", "value", "confidence")


@query(f"""WITH c AS ({CLAIMS}), s AS (SELECT doc_id, key, CASE WHEN key = 'total_amount' THEN 'Rs. ' || value WHEN key = 'age' THEN value || ' years' ELSE value END AS value FROM ({_VALUES}) v WHERE key <> 'pmjay_procedure_codes')
SELECT doc_id, key, value, CAST(0.85 AS DOUBLE) AS confidence FROM s UNION ALL SELECT * FROM ({_LABELLED}) l""")
def label_pairs(spark, sf_dir):
    return fd.pairs(_claims(spark, sf_dir)[0]).select("doc_id", "key", "value", "confidence")


@query(f"WITH c AS ({CLAIMS}) SELECT * FROM ({_VALUES}) v UNION ALL SELECT * FROM ({_LABELLED}) l")
def merged_fields(spark, sf_dir):
    lines, docs = _claims(spark, sf_dir)
    return fd.merge_pairs(fd.merge_sides(fd.pattern_fields(docs)), fd.pairs(lines)).select("doc_id", "key", "value", "confidence")


_HITS = "SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'uhid' ELSE 'icd_codes' END AS key, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE lower(l_returnflag) || l_linestatus END AS value, CAST(l_suppkey % 3 AS DOUBLE) / 4 AS confidence FROM lineitem"


@query(f"""
WITH h AS ({_HITS}), g AS (
  SELECT doc_id, key, lower(value) AS v, count(*) AS n, min(seq) AS first, arg_max(value, confidence * 1000 - seq) AS value, max(confidence) AS c FROM h GROUP BY ALL
), m AS (SELECT *, round(CASE WHEN n > 1 THEN least(1.0, c + 0.1) ELSE c END, 6) AS confidence FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY confidence DESC, length(value) DESC, first) AS nth FROM m)
SELECT doc_id, key, value, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE key = 'icd_codes' OR nth = 1
""")
def agreeing_fields(spark, sf_dir):
    _read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    none = F.lit(None).cast("struct<page:int,bbox:array<double>>")
    hits = spark.sql(_HITS).select("*", none.alias("source"), F.lit("x").alias("extractor"))
    return fd.merge_sides(hits.select(*fd._KEEP)).select("doc_id", "key", "value", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'patient_name' WHEN c_custkey % 3 = 1 THEN 'dr' ELSE 'custom_label' END AS key FROM customer")
def label_keys(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'Name of  Patient :' WHEN c_custkey % 3 = 1 THEN 'Dr.' ELSE 'Custom Label -' END").alias("label"))
    norm = tx.normal_label(F.col("label"))
    dim = fd.label_dim(spark).withColumnRenamed("label", "norm")
    return rows.withColumn("norm", norm).join(F.broadcast(dim), "norm", "left").select("c_custkey", F.coalesce("known", tx.snake(F.col("norm"))).alias("key"))


# ---- events and verdict -------------------------------------------------------------------------------------------------

_EVENTS = f"""
SELECT doc_id, {render.iso("adm")} AS date, 'admission' AS event FROM c
UNION ALL SELECT doc_id, {render.iso("dis")}, 'discharge' FROM c
"""


@query(f"WITH c AS ({CLAIMS}), e AS ({_EVENTS}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY date, event) AS INTEGER) AS nth, date, event, CAST(1 AS INTEGER) AS page FROM e")
def events(spark, sf_dir):
    return timeline(_claims(spark, sf_dir)[1], AS_OF).select("doc_id", "nth", "date", "event", F.col("source.page").alias("page"))


_FACTS = f"""
f AS (SELECT doc_id, doc_id % 11 = 0 AS no_name, doc_id % 7 = 0 AS no_id, dis < adm AS odd, doc_id % 3 = 0 AS stamp, doc_id % 3 = 0 AND doc_id % 2 = 1 AS sign, adm_text, dis_text, {render.iso("adm")} AS a, {render.iso("dis")} AS d FROM c)
"""
_FLAGS = """
SELECT doc_id, 0 AS o, 'missing_field' AS type, 'high' AS priority, 'Missing required field: patient_name' AS message FROM f WHERE no_name
UNION ALL SELECT doc_id, 1, 'missing_field', 'high', 'Missing required field: uhid' FROM f WHERE no_id
UNION ALL SELECT doc_id, 2, 'date_inconsistency', 'high', 'Chronology violation: discharge (' || dis_text || ') before admission (' || adm_text || ')' FROM f WHERE odd
UNION ALL SELECT doc_id, 3, 'date_inconsistency', 'high', 'Timeline inconsistency: earliest discharge (' || d || ') before earliest admission (' || a || ')' FROM f WHERE odd
UNION ALL SELECT doc_id, 4, 'missing_stamp', 'medium', 'No hospital stamp detected' FROM f WHERE NOT stamp
UNION ALL SELECT doc_id, 5, 'missing_signature', 'medium', 'No signature detected' FROM f WHERE NOT sign
"""
_VERDICT = "CASE WHEN no_name OR no_id OR odd THEN 'FAIL' WHEN NOT stamp OR NOT sign THEN 'CONDITIONAL' ELSE 'PASS' END"


def _decided(spark, sf_dir):
    lines, docs = _claims(spark, sf_dir)
    found = fd.merge_pairs(fd.merge_sides(fd.pattern_fields(docs)), fd.pairs(lines))
    seen = tables.visual_elements(render.table(spark, sf_dir, CONTOURS))
    return rules.decide(rules.facts(docs, found, timeline(docs, AS_OF), seen))


@query(f"""WITH c AS ({CLAIMS}), {_FACTS}, g AS ({_FLAGS})
SELECT f.doc_id, {_VERDICT} AS verdict, CASE WHEN {_VERDICT} = 'PASS' THEN 'All checks passed' WHEN {_VERDICT} = 'FAIL' THEN (SELECT string_agg(message, '; ' ORDER BY o) FROM (SELECT * FROM g WHERE g.doc_id = f.doc_id AND o < 3 ORDER BY o LIMIT 2))
       ELSE (SELECT string_agg(message, '; ' ORDER BY o) FROM (SELECT * FROM g WHERE g.doc_id = f.doc_id ORDER BY o LIMIT 2)) END AS reason FROM f""")
def decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("doc_id", "verdict", "reason")


@query(f"WITH c AS ({CLAIMS}), {_FACTS} SELECT {_VERDICT} AS verdict, count(*) AS n FROM f GROUP BY 1")
def verdict_counts(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"WITH c AS ({CLAIMS}), {_FACTS}, g AS ({_FLAGS}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS flag_no, type, priority, message FROM g")
def flags(spark, sf_dir):
    return rules.flag_items(_decided(spark, sf_dir))


@query(f"""WITH c AS ({CLAIMS}), {_FACTS}, r AS (
SELECT 'required_field_patient_name' AS rule_id, CASE WHEN no_name THEN 'fail' ELSE 'pass' END AS status FROM f UNION ALL SELECT 'required_field_uhid', CASE WHEN no_id THEN 'fail' ELSE 'pass' END FROM f
UNION ALL SELECT 'required_field_admission_date', 'pass' FROM f UNION ALL SELECT 'required_field_discharge_date', 'pass' FROM f UNION ALL SELECT 'required_field_diagnosis', 'pass' FROM f
UNION ALL SELECT 'chronology_check', CASE WHEN odd THEN 'fail' ELSE 'pass' END FROM f UNION ALL SELECT 'timeline_consistency', CASE WHEN odd THEN 'conditional' ELSE 'pass' END FROM f
UNION ALL SELECT 'hospital_stamp', CASE WHEN stamp THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'doctor_signature', CASE WHEN sign THEN 'pass' ELSE 'fail' END FROM f)
SELECT rule_id, status, count(*) AS n FROM r GROUP BY ALL""")
def rule_checks(spark, sf_dir):
    return rules.rule_checks(_decided(spark, sf_dir)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query()
def responses(spark, sf_dir):
    return to_json(analyze(render.pages(spark, sf_dir), Providers(AS_OF), contours=render.table(spark, sf_dir, CONTOURS), keep=materialize)["responses"])


# ---- tables and visuals -------------------------------------------------------------------------------------------------

_BOXES = "SELECT l_orderkey AS doc_id, 1 AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS seq, CAST(15 + 300 * (l_linenumber % 2) + CAST(l_quantity AS INT) % 20 AS DOUBLE) AS x0, CAST(40 * ((l_linenumber + 1 - (l_linenumber + 1) % 2) / 2) + CAST(l_quantity AS INT) % 7 AS DOUBLE) AS y0, l_returnflag AS text FROM lineitem"


@query(f"""
WITH b AS ({_BOXES}), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, round_even(x0 / 10, 0) * 10 AS x FROM b),
e AS (SELECT doc_id, x, sum(new) OVER (PARTITION BY doc_id ORDER BY x) AS cl FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) <= 40 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, x FROM k WHERE n >= 4))),
g AS (SELECT doc_id, cl - 1 AS col, min(x) AS least, count(*) OVER (PARTITION BY doc_id) AS cols FROM e GROUP BY doc_id, cl),
p AS (SELECT k.doc_id, k.seq, k.text, k.x0, k.y0, g.cols, arg_min(g.col, CASE WHEN k.x0 BETWEEN g.least - 20 AND g.least + 200 THEN g.col ELSE 1000 + abs(k.x0 - (g.least + 90)) END) AS col FROM k JOIN g ON k.doc_id = g.doc_id WHERE g.cols >= 2 GROUP BY ALL),
q AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY y0, seq) AS line FROM (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY y0, seq)) <= 12 THEN 0 ELSE 1 END AS new FROM p)),
w AS (SELECT *, min(col) OVER (PARTITION BY doc_id, line) <> max(col) OVER (PARTITION BY doc_id, line) AS wide FROM q),
t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS r FROM w WHERE wide),
z AS (SELECT *, max(r) OVER (PARTITION BY doc_id) + 1 AS rows FROM t)
SELECT doc_id, seq, CAST(r AS INTEGER) AS row, CAST(col AS INTEGER) AS col, text, CAST(rows AS INTEGER) AS rows, CAST(cols AS INTEGER) AS cols FROM z WHERE rows >= 2
""")
def ocr_tables(spark, sf_dir):
    _read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    lines = spark.sql(_BOXES).select("doc_id", "page_no", F.col("seq").cast("long").alias("seq"), F.array("x0", "y0", F.col("x0") + 50, F.col("y0") + 10).alias("bbox"), "text")
    return tables.ocr_tables(lines).select("doc_id", "seq", "row", F.col("col").cast("int").alias("col"), "text", "rows", "cols")


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(2 AS INTEGER) AS rows, CAST(2 AS INTEGER) AS cols, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS title, CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END AS INTEGER) AS n_cells FROM part WHERE p_partkey % 3 <> 0""")
def digital_tables(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    full = F.array(F.array(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 1, "x").otherwise(" ")), F.array(F.lit(" a "), F.col("p_type")))
    grid = F.when(F.col("p_partkey") % 3 == 0, F.array(F.array(F.lit(" "), F.lit(None).cast("string")))).otherwise(full)
    grids = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("table_no"), grid.alias("grid"))
    return tables.digital_tables(grids).select("doc_id", "rows", "cols", "title", F.size("cells").alias("n_cells"))


_SHAPES = "SELECT p_partkey AS doc_id, 1 AS page, CASE WHEN p_partkey % 2 = 0 THEN 'stamp' ELSE 'signature' END AS kind, CAST(1 AS INT) AS x, CAST(CASE WHEN p_partkey % 4 = 1 THEN 500 ELSE 630 + p_partkey % 50 END AS INT) AS y, CAST(p_size * 5 AS INT) AS w, CAST(p_size + p_partkey % 30 AS INT) AS h, CAST(p_size * 20 AS DOUBLE) AS area, CAST(p_size * 9 AS DOUBLE) AS perimeter, CAST(700 AS INT) AS page_w, CAST(900 AS INT) AS page_h FROM part"


@query(f"""
WITH s AS ({_SHAPES}), c AS (SELECT *, CAST(w AS DOUBLE) / h AS aspect, area / (w * h) AS density, area / (page_w * page_h) AS share, perimeter * perimeter / (area + 1) AS rough FROM s WHERE w > 0 AND h > 0)
SELECT doc_id, kind AS type, round(CASE kind WHEN 'stamp' THEN least(0.9, density + 0.5) ELSE least(0.8, rough / 200 + 0.3) END, 9) AS confidence FROM c
WHERE (kind = 'stamp' AND share BETWEEN 0.0005 AND 0.05 AND aspect BETWEEN 0.3 AND 3.5 AND density >= 0.15)
   OR (kind = 'signature' AND y >= floor(page_h * 0.7) AND w >= 60 AND h >= 15 AND w <= page_w * 0.8 AND h <= page_h * 0.08 AND aspect BETWEEN 1.5 AND 12 AND area >= 50 AND rough >= 25)
""")
def visual_elements(spark, sf_dir):
    _read(spark, sf_dir, "part").createOrReplaceTempView("part")
    return tables.visual_elements(spark.sql(_SHAPES)).select("doc_id", "type", F.round("confidence", 9).alias("confidence"))
