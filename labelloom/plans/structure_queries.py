"""Queries for the structure of pages and for what a run says about its jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.operators import compare, document_graph, matching, sequences, structure, summaries
from labelloom.plans.catalogue import _FIRST_ITEMS, _MATCHED, Query, _key, _status
from labelloom.plans.engine_queries import _IMPORTANT, _PARTS, _graph_parts, _items, _one
from labelloom.session import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ONE = """one AS (SELECT job_id, page, span_id, min(text) AS text, min(source) AS source, min(confidence) AS confidence, min(bbox_pdf.x) AS x, min(bbox_pdf.y) AS y, min(bbox_pdf.width) AS w, min(bbox_pdf.height) AS h,
  min(bbox_pdf.page_height) AS ph FROM text_spans WHERE span_id IS NOT NULL AND job_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2, 3)"""
_BY = ["job_id", "page"]


def _boxes(spark, d):
    return _one(spark, d).withColumnRenamed("ph", "page_h")


_IS_TITLE = "regexp_matches(text, '^[^:：]{2,10}[:：]')"
_WINDOWS = f"""WITH {_ONE}, t AS (SELECT *, floor(y / 30) AS band, x + w / 2 AS mid FROM one WHERE y IS NOT NULL AND ph > 0 AND {_IS_TITLE}),
  b AS (SELECT job_id, page, band, lead(min(y)) OVER (PARTITION BY job_id, page ORDER BY band) AS nxt FROM t GROUP BY 1, 2, 3),
  wi AS (SELECT job_id, page, span_id, ph, coalesce((lag(mid) OVER v + mid) / 2, 0) AS x1, (lead(mid) OVER v + mid) / 2 AS x2, y - 6 AS y1, least(ph, y + 135, coalesce(nxt - 6, ph)) AS y2 FROM t JOIN b USING (job_id, page, band)
    WINDOW v AS (PARTITION BY job_id, page, band ORDER BY x, span_id))"""


def _windows(spark, d):
    titles = _boxes(spark, d).where(F.col("text").rlike("^[^:：]{2,10}[:：]"))
    return structure.title_windows(titles, _BY)


@query(_WINDOWS + " SELECT span_id, round(x1, 4) AS x1, round(x2, 4) AS x2, round(y1, 4) AS y1, round(y2, 4) AS y2 FROM wi")
def title_windows(spark, d):
    return _windows(spark, d).select("span_id", *[F.round(c, 4).alias(c) for c in ("x1", "x2", "y1", "y2")])


@query(_WINDOWS + " SELECT wi.span_id, count(*) AS n_inside FROM wi JOIN one s ON s.job_id = wi.job_id AND s.page = wi.page AND s.ph > 0 AND s.y >= y1 AND s.y < y2 AND s.x >= x1 AND (x2 IS NULL OR s.x < x2) GROUP BY 1")
def window_spans(spark, d):
    """Spans in the window of each title."""
    boxes = _boxes(spark, d).select(*_BY, F.col("span_id").alias("box_id"), F.col("x").alias("bx"), F.col("y").alias("by_"), "page_h")
    return structure.inside(_windows(spark, d), boxes, _BY).groupBy("span_id").agg(F.count(F.lit(1)).alias("n_inside"))


@query(f"""WITH {_ONE}, p AS (SELECT *, CAST(floor(x / 40) AS INT) AS column_no FROM one WHERE y IS NOT NULL),
  g AS (SELECT *, CASE WHEN y - lag(y + h) OVER v > greatest(24, h * 2.5) THEN 1 ELSE 0 END AS nw FROM p WINDOW v AS (PARTITION BY job_id, page, column_no ORDER BY y, x, span_id)),
  r AS (SELECT job_id, page, column_no, 1 + sum(nw) OVER (PARTITION BY job_id, page, column_no ORDER BY y, x, span_id) AS run_no FROM g)
  SELECT job_id, page, column_no, CAST(run_no AS INT) AS run_no, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""")
def column_runs(spark, d):
    return structure.column_runs(_boxes(spark, d), _BY).groupBy(*_BY, "column_no", "run_no").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ONE}, l AS (SELECT job_id, page, span_id, x, y + h / 2 AS mid, ph FROM one WHERE y IS NOT NULL AND ph > 0 AND regexp_matches(text, '[:：]')), v AS (SELECT job_id, page, span_id AS value_id, x AS vx, y + h / 2 AS vmid FROM one WHERE y IS NOT NULL AND ph > 0 AND regexp_matches(text, '[0-9]'))
  SELECT job_id, page, span_id AS label_id, arg_min(value_id, struct_pack(a := vx, b := value_id)) AS value_id FROM l JOIN v USING (job_id, page) WHERE abs(mid - vmid) <= ph * 0.014 AND vx > x GROUP BY 1, 2, 3""")
def row_values(spark, d):
    """The nearest span with a figure to the right of each label."""
    s = _boxes(spark, d).withColumn("mid", F.col("y") + F.col("h") / 2)
    labels = s.where(F.col("text").rlike("[:：]")).select(*_BY, F.col("span_id").alias("label_id"), "x", "mid", "page_h")
    values = s.where(F.col("text").rlike("[0-9]")).select(*_BY, F.col("span_id").alias("value_id"), F.col("x").alias("vx"), F.col("mid").alias("vmid"), F.col("page_h").alias("vh"))
    return structure.row_values(labels, values, _BY)


@query(f"""WITH {_ONE}, last AS (SELECT job_id, page, arg_max(span_id, struct_pack(a := y, b := span_id)) AS last_span, max(y + h) AS bottom, max(ph) AS ph FROM one WHERE y IS NOT NULL GROUP BY 1, 2),
  top AS (SELECT job_id, page - 1 AS page, count(*) AS n_next FROM one WHERE y < ph * 0.25 GROUP BY 1, 2)
  SELECT job_id, page, last_span, n_next FROM last JOIN top USING (job_id, page) WHERE bottom >= ph - 120""")
def continued_pages(spark, d):
    """Pages filled to their end, with the number of spans that lead the next page."""
    s = _boxes(spark, d).where(F.col("y").isNotNull())
    last = s.groupBy(*_BY).agg(F.max_by("span_id", F.struct("y", "span_id")).alias("last_span"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.max("page_h").alias("ph"))
    top = s.where(F.col("y") < F.col("page_h") * 0.25).groupBy("job_id", (F.col("page") - 1).alias("page")).agg(F.count(F.lit(1)).alias("n_next"))
    return last.join(top, _BY).where(F.col("bottom") >= F.col("ph") - 120).select(*_BY, "last_span", "n_next")


_CUT = ["净含量", "配料", "保质期", "贮存条件", "产地", "Net Wt", "Storage"]


@query(rf"""SELECT evidence_id, trim(regexp_replace(t, '(?s)^(.+?)(?:{"|".join(sorted(_CUT, key=len, reverse=True))})\s*[:：].*$', '\1'), ' ') AS value FROM (SELECT evidence_id, min(source_text) AS t FROM evidence_items WHERE evidence_id IS NOT NULL GROUP BY 1) WHERE t IS NOT NULL""")
def cut_values(spark, d):
    """Evidence texts cut where a foreign label begins."""
    e = table(spark, d, "evidence_items").where(F.col("evidence_id").isNotNull()).groupBy("evidence_id").agg(F.min("source_text").alias("t")).where(F.col("t").isNotNull())
    return e.select("evidence_id", structure.cut_at_label(F.col("t"), _CUT).alias("value"))


_WEIGHT = "CASE WHEN {0} IS NULL THEN 100 ELSE 0 END + CASE WHEN regexp_matches({0}, '[一-鿿] +[一-鿿]') THEN 10 ELSE 0 END + CASE WHEN regexp_matches({0}, '[，,、：:(（-]\\s*$') THEN 1 ELSE 0 END"


@query("SELECT alignment_id, b AS before, a AS after, a < b AS taken FROM (SELECT DISTINCT alignment_id, " + _WEIGHT.format("ocr_text") + " AS b, " + _WEIGHT.format("pdf_text") + " AS a FROM source_alignments)")
def accepted_repairs(spark, d):
    """Whether the document's own reading of a line has fewer findings than the scan, weighted 100, 10 and 1."""
    weight = lambda c: F.when(c.isNull(), 100).otherwise(0) + F.when(F.coalesce(c.rlike("[一-鿿] +[一-鿿]"), F.lit(False)), 10).otherwise(0) + F.when(F.coalesce(c.rlike(r"[，,、：:(（-]\s*$"), F.lit(False)), 1).otherwise(0)
    a = table(spark, d, "source_alignments").select("alignment_id", weight(F.col("ocr_text")).alias("before"), weight(F.col("pdf_text")).alias("after")).distinct()
    return a.withColumn("taken", structure.improved(F.col("before"), F.col("after")))


# -- what a run says


@query(f"WITH {_FIRST_ITEMS} SELECT id, substr(semantic_key, 8) AS name FROM first_items WHERE starts_with(semantic_key, 'custom.')")
def custom_fields(spark, d):
    return _items(spark, d).where(F.col("semantic_key").startswith("custom.")).select("id", F.expr("substr(semantic_key, 8)").alias("name"))


@query(f"""WITH {_FIRST_ITEMS}, p AS (SELECT DISTINCT evidence_id, unnest(source_node_ids) AS s FROM evidence_items), i AS (SELECT DISTINCT id, s, e FROM (SELECT id, unnest(source_ids) AS s, evidence_refs FROM first_items) x, unnest(x.evidence_refs) AS u(e))
  SELECT DISTINCT id, s AS span_id FROM i WHERE s IS NOT NULL AND e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p JOIN i j ON j.id = i.id AND j.s = i.s AND p.evidence_id = j.e AND p.s = i.s)""")
def unproposed_sources(spark, d):
    """Sources of an item that none of its evidence names."""
    i = _items(spark, d).select("id", F.explode("source_ids").alias("span_id"), "evidence_refs").where(F.col("span_id").isNotNull())
    cited = i.select("id", "span_id", F.explode("evidence_refs").alias("evidence_id")).where(F.col("evidence_id").isNotNull()).distinct()
    p = table(spark, d, "evidence_items").select("evidence_id", F.explode("source_node_ids").alias("span_id")).distinct()
    return cited.select("id", "span_id").distinct().join(cited.join(p, ["evidence_id", "span_id"]).select("id", "span_id").distinct(), ["id", "span_id"], "left_anti")


@query(f"""WITH {_ONE}, e AS (SELECT DISTINCT job_id, evidence_id, unnest(source_node_ids) AS span_id FROM evidence_items) SELECT one.job_id, one.page, count(DISTINCT evidence_id) AS n_evidence, count(DISTINCT one.span_id) AS n_spans
  FROM one JOIN e ON e.job_id = one.job_id AND e.span_id = one.span_id GROUP BY 1, 2""")
def page_context(spark, d):
    """What of the evidence concerns each page."""
    e = table(spark, d, "evidence_items").select("job_id", "evidence_id", F.explode("source_node_ids").alias("span_id")).distinct()
    return _one(spark, d).join(e, ["job_id", "span_id"]).groupBy(*_BY).agg(F.count_distinct("evidence_id").alias("n_evidence"), F.count_distinct("span_id").alias("n_spans"))


@query("""WITH r AS (SELECT DISTINCT job_id, region_id, unnest(source_ocr_line_ids) AS line FROM compare_candidates WHERE region_id IS NOT NULL AND job_id IS NOT NULL), n AS (SELECT job_id, count(DISTINCT evidence_id) AS n0 FROM evidence_items GROUP BY 1)
  SELECT r.job_id, region_id, line, coalesce(n0, 0) + row_number() OVER (PARTITION BY r.job_id ORDER BY region_id, line) AS evidence_no FROM r LEFT JOIN n ON n.job_id = r.job_id WHERE line IS NOT NULL""")
def region_evidence(spark, d):
    """One evidence for each region and line, numbered after the evidence that a job has already."""
    c = table(spark, d, "compare_candidates").where(F.col("region_id").isNotNull() & F.col("job_id").isNotNull())
    r = c.select("job_id", "region_id", F.explode("source_ocr_line_ids").alias("line")).where(F.col("line").isNotNull()).distinct()
    n = table(spark, d, "evidence_items").groupBy("job_id").agg(F.count_distinct("evidence_id").alias("n0"))
    numbered = sequences.with_ordinal(r, ["job_id"], ["region_id", "line"], "n")
    return numbered.join(n, "job_id", "left").select("job_id", "region_id", "line", (F.coalesce("n0", F.lit(0)) + F.col("n")).alias("evidence_no"))


@query("""SELECT target_id, count(DISTINCT region_id) AS n_regions FROM compare_candidates WHERE target_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT region_id) > 1""")
def boundary_violations(spark, d):
    """Targets whose candidates stand in more than one region."""
    c = table(spark, d, "compare_candidates").where(F.col("target_id").isNotNull())
    return c.groupBy("target_id").agg(F.count_distinct("region_id").alias("n_regions")).where(F.col("n_regions") > 1)


@query(_MATCHED + f""", k AS (SELECT target_id, max(score) AS score FROM compare_candidates WHERE target_id IS NOT NULL GROUP BY 1)
  SELECT r.target_id, CASE greatest(CASE status WHEN 'critical_missing' THEN 3 WHEN 'critical_mismatch' THEN 2 ELSE 0 END, CASE WHEN score < 0.3 THEN 3 WHEN score < 0.6 THEN 2 WHEN score < 0.9 THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity
  FROM result r LEFT JOIN k USING (target_id)""")
def joined_severity(spark, d):
    """The worse of what the comparison and the best candidate's score say."""
    k = table(spark, d, "compare_candidates").where(F.col("target_id").isNotNull()).groupBy("target_id").agg(F.max("score").alias("score"))
    a = F.when(F.col("status") == "critical_missing", 3).when(F.col("status") == "critical_mismatch", 2).otherwise(0)
    b = F.when(F.col("score") < 0.3, 3).when(F.col("score") < 0.6, 2).when(F.col("score") < 0.9, 1).otherwise(0)
    worst = F.greatest(a, b)
    return _status(spark, d).join(k, "target_id", "left").select("target_id", F.when(worst == 3, "high").when(worst == 2, "medium").when(worst == 1, "low").otherwise("info").alias("severity"))


@query(f"""WITH {_FIRST_ITEMS}, s AS (SELECT job_id, group_id, count(DISTINCT x) AS n_spans FROM (SELECT job_id, group_id, unnest(source_ids) AS x FROM first_items) GROUP BY 1, 2), e AS (SELECT job_id, group_id, count(DISTINCT x) AS n_evidence FROM (SELECT job_id, group_id, unnest(evidence_refs) AS x FROM first_items) GROUP BY 1, 2)
  SELECT f.job_id, f.group_id, n_fields, n_tables, coalesce(n_spans, 0) AS n_spans, coalesce(n_evidence, 0) AS n_evidence FROM (SELECT job_id, group_id, count(*) AS n_fields, count(DISTINCT table_id) AS n_tables FROM first_items WHERE job_id IS NOT NULL AND group_id IS NOT NULL GROUP BY 1, 2) f LEFT JOIN s USING (job_id, group_id) LEFT JOIN e USING (job_id, group_id)""")
def section_summary(spark, d):
    """Fields, tables, spans and evidence of every section."""
    i = _items(spark, d).where(F.col("job_id").isNotNull() & F.col("group_id").isNotNull())
    by = ["job_id", "group_id"]
    parts = i.groupBy(*by).agg(F.count(F.lit(1)).alias("n_fields"), F.count_distinct("table_id").alias("n_tables"))
    for ids, name in (("source_ids", "n_spans"), ("evidence_refs", "n_evidence")):
        n = i.select(*by, F.explode(ids).alias("x")).groupBy(*by).agg(F.count_distinct("x").alias(name))
        parts = parts.join(n, by, "left")
    return parts.fillna(0, ["n_spans", "n_evidence"])


@query(_MATCHED + """SELECT job_id, count(DISTINCT target_id || '|' || reason) AS n_high FROM result WHERE status = 'critical_missing' GROUP BY 1""")
def high_findings(spark, d):
    s = _status(spark, d).where(F.col("status") == "critical_missing")
    return s.groupBy("job_id").agg(F.count_distinct(F.concat_ws("|", "target_id", "reason")).alias("n_high"))


@query(f"""WITH {_FIRST_ITEMS}, c AS (SELECT target_id, count(DISTINCT candidate_id) AS n FROM compare_candidates GROUP BY 1)
  SELECT id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 THEN 'single' WHEN n <= 3 THEN 'few' ELSE 'many' END AS level FROM first_items LEFT JOIN c ON target_id = id""")
def candidate_levels(spark, d):
    c = table(spark, d, "compare_candidates").groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("candidate_id").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _items(spark, d).select("id").join(c, "id", "left").select("id", n.alias("n"), F.when(n == 0, "none").when(n == 1, "single").when(n <= 3, "few").otherwise("many").alias("level"))


_OBVIOUS = {"product.name": "产品名称", "product.net_content": "净含量", "product.shelf_life": "保质期"}


@query(f"WITH {_FIRST_ITEMS}, seen AS (" + " UNION ".join(f"SELECT job_id, '{k}' AS semantic_key FROM text_spans WHERE job_id IS NOT NULL AND contains(text, '{t}')" for k, t in _OBVIOUS.items())
       + """) SELECT job_id, semantic_key, 'missing_obvious' AS issue FROM seen s WHERE NOT EXISTS (SELECT 1 FROM first_items i WHERE i.job_id = s.job_id AND i.semantic_key = s.semantic_key)
  UNION ALL SELECT job_id, semantic_key, 'repeated' FROM first_items WHERE job_id IS NOT NULL AND semantic_key IS NOT NULL AND NOT starts_with(semantic_key, 'custom.') AND table_id IS NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def schema_issues(spark, d):
    """Fields that a job's texts show and its items lack, and fields that occur more than once."""
    i = _items(spark, d).where(F.col("job_id").isNotNull() & F.col("semantic_key").isNotNull())
    shown = F.array_compact(F.array(*[F.when(F.contains(F.col("text"), F.lit(t)), F.lit(k)) for k, t in _OBVIOUS.items()]))
    seen = table(spark, d, "text_spans").where(F.col("job_id").isNotNull()).select("job_id", F.explode(shown).alias("semantic_key")).distinct()
    missing = seen.join(i.select("job_id", "semantic_key").distinct(), ["job_id", "semantic_key"], "left_anti").withColumn("issue", F.lit("missing_obvious"))
    one = i.where(~F.col("semantic_key").startswith("custom.") & F.col("table_id").isNull())
    return missing.unionByName(one.groupBy("job_id", "semantic_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("job_id", "semantic_key", F.lit("repeated").alias("issue")))


@query(f"""WITH {_ONE}, al AS (SELECT DISTINCT ocr_line_id AS l, unnest(pdf_span_ids) AS span_id FROM source_alignments), rg AS (SELECT DISTINCT unnest(source_ocr_line_ids) AS l, region_id FROM compare_candidates WHERE region_id IS NOT NULL),
  r AS (SELECT span_id, max(region_id) AS region FROM al JOIN rg USING (l) GROUP BY 1)
  SELECT one.span_id, CASE WHEN region IS NOT NULL THEN region WHEN regexp_matches(text, '(kJ|NRV|能量|蛋白质|脂肪|Energy|Protein)') THEN 'nutrition_row' WHEN regexp_matches(text, '{"|".join(_IMPORTANT)}') THEN 'anchor' ELSE 'other' END AS role FROM one LEFT JOIN r USING (span_id)""")
def span_roles(spark, d):
    """The last region of a span, else whether it is a nutrition row, else an anchor."""
    al = table(spark, d, "source_alignments").select(F.col("ocr_line_id").alias("l"), F.explode("pdf_span_ids").alias("span_id")).distinct()
    rg = table(spark, d, "compare_candidates").where(F.col("region_id").isNotNull()).select(F.explode("source_ocr_line_ids").alias("l"), "region_id").distinct()
    r = al.join(rg, "l").groupBy("span_id").agg(F.max("region_id").alias("region"))
    kind = summaries.first_class(F.col("text"), {"nutrition_row": "(kJ|NRV|能量|蛋白质|脂肪|Energy|Protein)", "anchor": "|".join(_IMPORTANT)}, "other")
    return _one(spark, d).join(r, "span_id", "left").select("span_id", F.coalesce("region", kind).alias("role"))


@query(_MATCHED + """SELECT status, count(*) AS n, count(DISTINCT job_id) AS n_jobs, CAST(grouping(status) AS INT) AS is_total FROM result GROUP BY ROLLUP (status)""")
def report_totals(spark, d):
    s = _status(spark, d)
    return s.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("n_jobs"), F.grouping("status").cast("int").alias("is_total"))


@query("""SELECT job_id, count(*) AS n_contents, string_agg(content_no, ',' ORDER BY content_no) AS contents FROM (SELECT DISTINCT job_id, content_no FROM content_items WHERE trim(content_no) <> '') GROUP BY 1""")
def content_lists(spark, d):
    c = table(spark, d, "content_items").where(F.trim("content_no") != "").select("job_id", "content_no").distinct()
    return c.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_contents"), F.array_join(F.array_sort(F.collect_list("content_no")), ",").alias("contents"))


@query("""SELECT job_id, CASE WHEN bool_or(source = 'xlsx_cell') AND bool_or(source <> 'xlsx_cell') THEN 'mixed' WHEN bool_or(source = 'xlsx_cell') THEN 'workbook' WHEN bool_or(source = 'ocr') AND bool_or(source IN ('pdf_text', 'pdf_char_atom')) THEN 'fusion' WHEN bool_or(source = 'ocr') THEN 'scan' ELSE 'text' END AS mode FROM text_spans GROUP BY 1""")
def source_modes(spark, d):
    has = lambda c: F.bool_or(c)
    s = F.col("source")
    mode = F.when(has(s == "xlsx_cell") & has(s != "xlsx_cell"), "mixed").when(has(s == "xlsx_cell"), "workbook").when(has(s == "ocr") & has(s.isin("pdf_text", "pdf_char_atom")), "fusion").when(has(s == "ocr"), "scan").otherwise("text")
    return table(spark, d, "text_spans").groupBy("job_id").agg(mode.alias("mode"))


_GOLD = ["能量", "蛋白质", "脂肪", "碳水化合物", "钠"]


@query(f"""WITH {_FIRST_ITEMS}, r AS (SELECT job_id, table_id, g, bool_or(contains(row_key, g)) AS hit FROM first_items, (SELECT unnest({_GOLD}) AS g) WHERE table_id IS NOT NULL GROUP BY 1, 2, 3)
  SELECT job_id, table_id, count(*) FILTER (hit) AS n_hit, round(count(*) FILTER (hit) / count(*), 4) AS recall FROM r GROUP BY 1, 2""")
def gold_recall(spark, d):
    """Rows that every table must have, found by containment."""
    i = _items(spark, d).where(F.col("table_id").isNotNull())
    hits = [F.coalesce(F.bool_or(F.contains(F.col("row_key"), F.lit(g))), F.lit(False)).cast("long") for g in _GOLD]
    n = sum(hits[1:], hits[0])
    return i.groupBy("job_id", "table_id").agg(n.alias("n_hit")).withColumn("recall", F.round(F.col("n_hit") / F.lit(len(_GOLD)), 4))


@query(f"""WITH {_ONE} SELECT span_id, regexp_matches(text, '(营养成分|Nutrition)') AS is_title, regexp_matches(text, '(项目|每100|NRV|per 100)') AS is_header, regexp_matches(text, '(能量|蛋白质|脂肪|钠|Energy|Protein|Fat|Sodium)') AND regexp_matches(text, '[0-9]') AS is_row FROM one WHERE text IS NOT NULL""")
def nutrition_lines(spark, d):
    t = F.col("text")
    return _one(spark, d).where(t.isNotNull()).select("span_id", t.rlike("(营养成分|Nutrition)").alias("is_title"), t.rlike("(项目|每100|NRV|per 100)").alias("is_header"), (t.rlike("(能量|蛋白质|脂肪|钠|Energy|Protein|Fat|Sodium)") & t.rlike("[0-9]")).alias("is_row"))


@query(f"""WITH {_FIRST_ITEMS} SELECT job_id, table_id, string_agg(row_key || '=' || v, ';' ORDER BY row_key) AS row_values FROM (SELECT job_id, table_id, row_key, min(text) AS v FROM first_items WHERE table_id IS NOT NULL AND row_key IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def table_maps(spark, d):
    """Every table as a map from row to value."""
    i = _items(spark, d).where(F.col("table_id").isNotNull() & F.col("row_key").isNotNull() & F.col("text").isNotNull())
    one = i.groupBy("job_id", "table_id", "row_key").agg(F.min("text").alias("v"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("row_key", "v"))))
    return one.groupBy("job_id", "table_id").agg(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("row_values"))


@query(f"""WITH {_FIRST_ITEMS}, e AS (SELECT job_id, count(DISTINCT evidence_id) AS n_evidence FROM evidence_items GROUP BY 1), s AS (SELECT job_id, count(DISTINCT span_id) AS n_spans, min(page) AS first_page, max(page) AS last_page, count(DISTINCT page) AS n_pages FROM text_spans GROUP BY 1)
  SELECT i.job_id, n_items > 0 AND coalesce(n_evidence, 0) > 0 AS has_evidence, coalesce(n_spans, 0) >= coalesce(n_evidence, 0) AS spans_cover, coalesce(first_page = 1, false) AS starts_at_one, coalesce(last_page = n_pages, false) AS pages_complete, n_items = n_ids AS ids_unique
  FROM (SELECT job_id, count(*) AS n_items, count(DISTINCT id) AS n_ids FROM first_items WHERE job_id IS NOT NULL GROUP BY 1) i LEFT JOIN e USING (job_id) LEFT JOIN s USING (job_id)""")
def invariants(spark, d):
    """What must hold of every job from end to end."""
    i = _items(spark, d).where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("id").alias("n_ids"))
    e = table(spark, d, "evidence_items").groupBy("job_id").agg(F.count_distinct("evidence_id").alias("n_evidence"))
    s = table(spark, d, "text_spans").groupBy("job_id").agg(F.count_distinct("span_id").alias("n_spans"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count_distinct("page").alias("n_pages"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return i.join(e, "job_id", "left").join(s, "job_id", "left").select(
        "job_id", ((F.col("n_items") > 0) & (zero("n_evidence") > 0)).alias("has_evidence"), (zero("n_spans") >= zero("n_evidence")).alias("spans_cover"),
        F.coalesce(F.col("first_page") == 1, F.lit(False)).alias("starts_at_one"), F.coalesce(F.col("last_page") == F.col("n_pages"), F.lit(False)).alias("pages_complete"), (F.col("n_items") == F.col("n_ids")).alias("ids_unique"),
    )


@query(rf"""WITH {_FIRST_ITEMS} SELECT id, code FROM (SELECT id, unnest([CASE WHEN coalesce(len(source_ids), 0) = 0 AND coalesce(len(evidence_refs), 0) = 0 THEN 'ungrounded' END, CASE WHEN table_id IS NULL AND coalesce(len(source_ids), 0) = 0 THEN 'no_source' END,
  CASE WHEN length(text) > 20 AND regexp_matches(text, '.(净含量|配料|保质期|产地)[:：]') THEN 'foreign_label' END]) AS code FROM first_items) WHERE code IS NOT NULL""")
def semantic_findings(spark, d):
    """Items without grounds, and long texts that hold a foreign label."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    codes = {"ungrounded": none("source_ids") & none("evidence_refs"), "no_source": F.col("table_id").isNull() & none("source_ids"), "foreign_label": (F.length("text") > 20) & F.col("text").rlike(".(净含量|配料|保质期|产地)[:：]")}
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in codes.items()]))
    return _items(spark, d).select("id", F.explode(found).alias("code"))


@query(f"""WITH {_ONE} SELECT CASE WHEN source = 'ocr' THEN 'scan:' ELSE 'text:' END || span_id AS line_id, job_id, page FROM one WHERE source IN ('ocr', 'pdf_text', 'pdf_char_atom')""")
def selected_lines(spark, d):
    """Lines of both channels under ids of their own."""
    s = _one(spark, d).where(F.col("source").isin("ocr", "pdf_text", "pdf_char_atom"))
    return s.select(F.concat(F.when(F.col("source") == "ocr", "scan:").otherwise("text:"), "span_id").alias("line_id"), "job_id", "page")


@query(f"""WITH {_ONE} SELECT job_id, page, count(*) AS n_spans, CASE WHEN bool_or(regexp_matches(text, '(营养|Nutrition|kJ)')) THEN 'nutrition' WHEN bool_or(regexp_matches(text, '(配料|Ingredients)')) THEN 'ingredients' ELSE 'general' END AS focus FROM one GROUP BY 1, 2""")
def page_cases(spark, d):
    """A case for every page with what it is about."""
    has = lambda p: F.coalesce(F.bool_or(F.col("text").rlike(p)), F.lit(False))
    return _one(spark, d).groupBy(*_BY).agg(F.count(F.lit(1)).alias("n_spans"), F.when(has("(营养|Nutrition|kJ)"), "nutrition").when(has("(配料|Ingredients)"), "ingredients").otherwise("general").alias("focus"))


_TYPE = "CASE WHEN regexp_matches(text, '(kJ|NRV|营养成分|Energy)') THEN 'table' WHEN regexp_matches(text, '^[^:：]{2,16}[:：]') THEN 'content' WHEN length(trim(text)) <= 2 THEN 'marker' ELSE 'rest' END"


@query(f"""WITH {_ONE}, t AS (SELECT job_id, page, span_id, y, x, coalesce({_TYPE}, 'rest') AS kind FROM one), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, kind ORDER BY page, y, x, span_id) - 1 AS k FROM t)
  SELECT job_id, kind, CAST(k // 160 + 1 AS INT) AS block_no, count(*) AS n_spans FROM n GROUP BY 1, 2, 3""")
def typed_blocks(spark, d):
    """Spans of a job in blocks of one kind, 160 at most."""
    t = F.col("text")
    kind = summaries.first_class(t, {"table": "(kJ|NRV|营养成分|Energy)", "content": "^[^:：]{2,16}[:：]"}, "")
    kind = F.when(kind != "", kind).when(F.length(F.trim(t)) <= 2, "marker").otherwise("rest")
    s = sequences.with_ordinal(_one(spark, d).withColumn("kind", kind), ["job_id", "kind"], ["page", "y", "x", "span_id"], "k")
    return s.groupBy("job_id", "kind", (F.floor((F.col("k") - 1) / 160) + 1).cast("int").alias("block_no")).agg(F.count(F.lit(1)).alias("n_spans"))


@query(rf"""WITH {_ONE}, c AS (SELECT job_id, page, sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]+'))) AS n FROM one GROUP BY 1, 2) SELECT job_id, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_numbers, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY 1""")
def chunk_reduce(spark, d):
    """Figures counted chunk by chunk and put together for the job."""
    chunk = _one(spark, d).groupBy(*_BY).agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9]+"))).alias("n"))
    return chunk.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_numbers"), F.max("n").alias("most"))


@query(f"""WITH {_FIRST_ITEMS} SELECT id, CASE WHEN starts_with(semantic_key, 'producer.') OR starts_with(semantic_key, 'importer.') OR starts_with(semantic_key, 'entrusting_party.') THEN 'enterprise' WHEN starts_with(group_id, 'content_') THEN 'content' WHEN table_id IS NOT NULL THEN 'nutrition' ELSE 'main' END AS route,
  coalesce(semantic_key LIKE '%.ingredients', false) OR coalesce(length({_key('text')}) > 40, false) AS long_text FROM first_items""")
def item_routes(spark, d):
    """Where an item is looked for, and whether its text is long."""
    k = F.col("semantic_key")
    route = F.when(k.startswith("producer.") | k.startswith("importer.") | k.startswith("entrusting_party."), "enterprise").when(F.col("group_id").startswith("content_"), "content").when(F.col("table_id").isNotNull(), "nutrition").otherwise("main")
    is_long = F.coalesce(k.endswith(compare.LONG_SUFFIX), F.lit(False)) | F.coalesce(F.length(tx.compare_key(F.col("text"))) > compare.LONG_LETTERS, F.lit(False))
    return _items(spark, d).select("id", route.alias("route"), is_long.alias("long_text"))


@query(_MATCHED + """SELECT job_id, CASE status WHEN 'pass' THEN 'in_order' WHEN 'manual_review' THEN 'to_check' ELSE 'wrong' END AS bucket, count(*) AS n FROM result GROUP BY 1, 2""")
def result_buckets(spark, d):
    s = _status(spark, d)
    bucket = F.when(F.col("status") == "pass", "in_order").when(F.col("status") == "manual_review", "to_check").otherwise("wrong")
    return s.groupBy("job_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FIRST_ITEMS}, v AS (SELECT evidence_id, min(job_id) AS job_id, min({_key('source_text')}) AS k FROM evidence_items WHERE evidence_id IS NOT NULL GROUP BY 1), c AS (SELECT evidence_id, min(id) AS item_id FROM (SELECT unnest(evidence_refs) AS evidence_id, id FROM first_items) WHERE evidence_id IS NOT NULL GROUP BY 1),
  t AS (SELECT job_id, {_key('text')} AS k, min(id) AS item_id FROM first_items GROUP BY 1, 2)
  SELECT v.evidence_id, coalesce(c.item_id, t.item_id) AS item_id, CASE WHEN c.item_id IS NOT NULL THEN 'id' WHEN t.item_id IS NOT NULL THEN 'keys' ELSE 'none' END AS how FROM v LEFT JOIN c USING (evidence_id) LEFT JOIN t ON t.job_id = v.job_id AND t.k = v.k""")
def evidence_links(spark, d):
    """The item that cites an evidence, else one of its job with the same text."""
    i = _items(spark, d)
    v = table(spark, d, "evidence_items").where(F.col("evidence_id").isNotNull()).withColumn("k", tx.compare_key(F.col("source_text"))).groupBy("evidence_id").agg(F.min("job_id").alias("job_id"), F.min("k").alias("k"))
    cited = i.select(F.explode("evidence_refs").alias("evidence_id"), F.col("id").alias("item_id")).where(F.col("evidence_id").isNotNull())
    same = i.select("job_id", tx.compare_key(F.col("text")).alias("k"), F.col("id").alias("item_id"))
    return matching.joined_with_fallback(v, cited, same, "evidence_id", ["job_id", "k"], "item_id")


@query(f"""WITH {_FIRST_ITEMS}, u AS (SELECT job_id, content_row_id, row_number() OVER (PARTITION BY job_id ORDER BY content_row_id) AS n FROM (SELECT DISTINCT job_id, content_row_id FROM content_items WHERE trim(coalesce(nutrition_table_no, '')) = '')),
  f AS (SELECT job_id, table_id, row_number() OVER (PARTITION BY job_id ORDER BY table_id) AS n FROM (SELECT DISTINCT job_id, table_id FROM first_items WHERE table_id IS NOT NULL))
  SELECT u.job_id, content_row_id, table_id FROM u LEFT JOIN f ON f.job_id = u.job_id AND f.n = u.n""")
def assigned_tables(spark, d):
    """Contents that name no table take the tables of their job in order."""
    c = table(spark, d, "content_items").where(F.trim(F.coalesce("nutrition_table_no", F.lit(""))) == "").select("job_id", "content_row_id").distinct()
    t = _items(spark, d).where(F.col("table_id").isNotNull()).select("job_id", "table_id").distinct()
    return matching.assigned_in_order(c, t, ["job_id"], "content_row_id", "table_id")


@query(_PARTS + """, n AS (SELECT job_id, count(*) AS n_nodes, count(DISTINCT kind) AS n_node_kinds FROM nd GROUP BY 1), e AS (SELECT job_id, count(*) AS n_edges, count(DISTINCT kind) AS n_edge_kinds FROM ed GROUP BY 1)
  SELECT job_id, n_nodes, n_node_kinds, n_edges, n_edge_kinds FROM n JOIN e USING (job_id)""")
def graph_bundle(spark, d):
    """The graph of every job in figures."""
    parts = _graph_parts(spark, d)
    n = document_graph.nodes(*parts).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("kind").alias("n_node_kinds"))
    e = document_graph.edges(*parts).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("kind").alias("n_edge_kinds"))
    return n.join(e, "job_id")
