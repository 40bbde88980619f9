"""Queries for matching, the two channels, the document graph and the summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.functions import geometry as geo
from labelloom.functions import text as tx
from labelloom.operators import channels, compare, document_graph, matching, sequences, summaries
from labelloom.plans.catalogue import _CANDS, _FIRST_ITEMS, _MATCHED, Query, _key, _status
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


def _items(spark, d) -> DataFrame:
    """The first delivery of every item."""
    return sequences.keep_best(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])


def _cands(spark, d) -> DataFrame:
    c = table(spark, d, "compare_candidates").where(F.col("candidate_id").isNotNull())
    return c.groupBy("candidate_id", "target_id").agg(F.min("text").alias("text"), F.min("score").alias("score"), F.min("candidate_type").alias("candidate_type"), F.min(F.coalesce(F.size("source_ocr_line_ids"), F.lit(-1))).alias("n_lines"))


_PAIRS = f"""WITH {_FIRST_ITEMS}, cands AS (SELECT candidate_id, target_id, min(text) AS text, min(score) AS score, min(candidate_type) AS candidate_type,
  min(coalesce(len(source_ocr_line_ids), -1)) AS n_lines FROM compare_candidates WHERE candidate_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT i.id AS target_id, i.job_id, i.semantic_key, i.text AS expected, c.candidate_id, c.text AS observed, c.score, c.candidate_type, c.n_lines FROM first_items i JOIN cands c ON c.target_id = i.id)
"""


def _pairs(spark, d) -> DataFrame:
    """Every item with each of its candidates."""
    i = _items(spark, d).select(F.col("id").alias("target_id"), "job_id", "semantic_key", F.col("text").alias("expected"))
    return i.join(_cands(spark, d).withColumnRenamed("text", "observed"), "target_id")


# -- matching


def _narrow(c: str) -> str:
    return f"translate({c}, '{tx.WIDE.replace(chr(39), chr(39) * 2)}', '{tx.NARROW.replace(chr(39), chr(39) * 2)}')"


def _value(c: str) -> str:
    return rf"trim(CASE WHEN trim(regexp_extract({c}, '^([^:：\n]{{2,16}})[:：]', 1), ' ') <> '' OR regexp_extract({c}, '^([^:：\n]{{2,16}})[:：]', 1) <> '' THEN regexp_replace({c}, '^[^:：\n]{{2,16}}[:：]', '') ELSE {c} END, ' ')"


@query(rf"""WITH {_FIRST_ITEMS} SELECT id, CASE WHEN semantic_key LIKE 'barcode.%' THEN regexp_replace({_narrow('text')}, '[^0-9]', '', 'g')
  ELSE regexp_replace({_key(_value('text'))}, '[,.;]+$', '') END AS target_key FROM first_items WHERE text IS NOT NULL""")
def target_keys(spark, d):
    i = _items(spark, d).where(F.col("text").isNotNull())
    is_code = F.coalesce(F.col("semantic_key").startswith("barcode."), F.lit(False))
    return i.select("id", matching.target_key(F.col("text"), is_code).alias("target_key"))


@query(rf"""SELECT span_id, count(DISTINCT v) AS n_forms, min(sep) AS separator_free, min(val) AS value_key, min(cmp) AS compact FROM (SELECT span_id, text AS v, regexp_replace({_key('text')}, '[,.;:()\[\]{{}}|/]+', '', 'g') AS sep, {_key(_value('text'))} AS val,
  regexp_replace(text, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}\x{{FEFF}}]+', '', 'g') AS cmp FROM text_spans WHERE span_id IS NOT NULL AND text IS NOT NULL) GROUP BY 1""".replace("\\\\", "\\"))
def text_forms(spark, d):
    """The forms in which a text is compared, each for its purpose."""
    s = table(spark, d, "text_spans").where(F.col("span_id").isNotNull() & F.col("text").isNotNull())
    t = F.col("text")
    one = s.select("span_id", t.alias("v"), tx.separator_free_key(t).alias("sep"), tx.value_key(t).alias("val"), tx.compact(t).alias("cmp"))
    return one.groupBy("span_id").agg(F.count_distinct("v").alias("n_forms"), F.min("sep").alias("separator_free"), F.min("val").alias("value_key"), F.min("cmp").alias("compact"))


def _steps(c: str) -> dict[str, str]:
    out = {"none": c}
    c = rf"regexp_replace({c}, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}\x{{FEFF}}]+', '', 'g')"
    out["white_space"] = c
    c = _narrow(c)
    out["width"] = c
    c = f"translate({c}, '{tx.MARKS_FROM}', '{tx.MARKS_TO}')"
    out["marks"] = c
    c = f"lower({c})"
    out["case"] = c
    out["separators"] = f"regexp_replace({c}, '[,.;:]+', '', 'g')"
    return out


_NEEDED = "CASE " + " ".join(f"WHEN {a} = {b} THEN '{n}'" for (n, a), (_, b) in zip(_steps("expected").items(), _steps("observed").items())) + " END"


@query(_PAIRS + f"SELECT target_id, candidate_id, {_NEEDED} AS needed FROM p")
def normalisation_flags(spark, d):
    return _pairs(spark, d).select("target_id", "candidate_id", matching.normalisation_needed(F.col("expected"), F.col("observed")).alias("needed"))


_LABEL = r"CASE WHEN regexp_extract(%(c)s, '^([^:：\n]{2,16})[:：]', 1) <> '' THEN trim(regexp_extract(%(c)s, '^([^:：\n]{2,16})[:：]', 1), ' ') END"


@query(_PAIRS + f"""SELECT target_id, candidate_id, want IS NULL OR coalesce({_key('want')} = {_key('have')}, false) AS same_label
  FROM (SELECT *, {_LABEL % {'c': 'expected'}} AS want, {_LABEL % {'c': 'observed'}} AS have FROM p)""")
def label_rule(spark, d):
    return _pairs(spark, d).select("target_id", "candidate_id", matching.same_label(F.col("expected"), F.col("observed")).alias("same_label"))


@query(_PAIRS + f"""SELECT target_id, candidate_id, coalesce(score >= CASE WHEN length(e) > 40 OR coalesce(semantic_key LIKE '%.ingredients', false) THEN 0.55 ELSE 0.72 END
  AND NOT (contains(o, e) AND length(o) > greatest(length(e) * 2, length(e) + 8)), false) AS viable FROM (SELECT *, {_key('expected')} AS e, {_key('observed')} AS o FROM p)""")
def viable_candidates(spark, d):
    p = _pairs(spark, d).withColumn("e", tx.compare_key(F.col("expected"))).withColumn("o", tx.compare_key(F.col("observed")))
    is_long = F.coalesce(F.length("e") > compare.LONG_LETTERS, F.lit(False)) | F.coalesce(F.col("semantic_key").endswith(compare.LONG_SUFFIX), F.lit(False))
    return p.select("target_id", "candidate_id", matching.viable(F.col("e"), F.col("o"), F.col("score"), is_long).alias("viable"))


@query(_PAIRS + f"""SELECT target_id, CAST(rank AS INT) AS rank, candidate_id FROM (SELECT target_id, candidate_id, row_number() OVER (PARTITION BY target_id
  ORDER BY coalesce({_key('observed')} = {_key('expected')}, false) DESC, score DESC NULLS LAST, n_lines, candidate_id) AS rank FROM p) WHERE rank <= 5""")
def exact_first_top5(spark, d):
    exact = tx.compare_key(F.col("observed")) == tx.compare_key(F.col("expected"))
    return matching.exact_first(_pairs(spark, d), ["target_id"], exact, "score", "n_lines", "candidate_id")


_ALIASES = f"""names AS (SELECT {_key('name')} AS k, min(catalog_id) AS catalog_id FROM (SELECT catalog_id, display_name AS name FROM label_catalog UNION ALL SELECT catalog_id, name_en FROM label_catalog
  UNION ALL SELECT catalog_id, unnest(aliases) FROM label_catalog) WHERE name IS NOT NULL GROUP BY 1 HAVING {_key('name')} <> '')"""


@query(f"""WITH {_FIRST_ITEMS}, {_ALIASES}, l AS (SELECT DISTINCT row_id, job_id, label_item, CAST(NULL AS VARCHAR) AS group_id FROM main_labels)
  SELECT DISTINCT i.id, l.row_id, n.catalog_id FROM first_items i JOIN names n ON n.k = {_key('i.label')} JOIN l ON l.job_id = i.job_id JOIN names m ON m.k = {_key('l.label_item')} AND m.catalog_id = n.catalog_id""")
def alias_matches(spark, d):
    """Expected items and typed rows of one job whose labels mean the same entry."""
    i = _items(spark, d).select("id", "job_id", "label", "group_id")
    rows = table(spark, d, "main_labels").select("row_id", "job_id", F.col("label_item").alias("label"), F.lit(None).cast("string").alias("group_id")).distinct()
    out = matching.joined_by_alias(i, rows, ["job_id"], "label", table(spark, d, "label_catalog"), "group_id")
    return out.select("id", F.col("other_row_id").alias("row_id"), "catalog_id").distinct()


@query(rf"""WITH {_FIRST_ITEMS}, t AS (SELECT DISTINCT job_id, replace(table_id, 'nutrition_', '') AS t FROM first_items WHERE table_id IS NOT NULL),
  r AS (SELECT DISTINCT content_row_id, job_id, trim(ref) AS ref FROM (SELECT content_row_id, job_id, unnest(regexp_split_to_array(nutrition_table_no, '[,，、;；/\s]+')) AS ref FROM content_items WHERE nutrition_table_no IS NOT NULL) WHERE trim(ref) <> ''),
  o AS (SELECT job_id, min(t) AS only FROM t GROUP BY 1 HAVING min(t) = max(t))
  SELECT r.content_row_id, r.ref, coalesce(t.t, o.only) AS table_id, CASE WHEN t.t IS NOT NULL THEN 'name' WHEN o.only IS NOT NULL THEN 'only_table' ELSE 'none' END AS how
  FROM r LEFT JOIN t ON t.job_id = r.job_id AND t.t = r.ref LEFT JOIN o ON o.job_id = r.job_id""")
def table_links(spark, d):
    """Tables that content items name, or the only table of their job."""
    t = _items(spark, d).where(F.col("table_id").isNotNull()).select("job_id", F.replace(F.col("table_id"), F.lit("nutrition_"), F.lit("")).alias("table_id")).distinct()
    c = table(spark, d, "content_items").where(F.col("nutrition_table_no").isNotNull())
    refs = c.select("content_row_id", "job_id", F.explode(F.split("nutrition_table_no", r"[,，、;；/\s]+")).alias("ref")).where(F.trim("ref") != "").withColumn("ref", F.trim("ref")).distinct()
    return matching.linked_tables(refs, t, ["job_id"], "ref", "table_id").drop("job_id")


@query(f"""WITH {_FIRST_ITEMS}, n AS (SELECT DISTINCT content_row_id, job_id, content_name AS name FROM content_items WHERE trim(content_name) <> '')
  SELECT n.content_row_id, n.name, min(i.id) AS first_item FROM n JOIN first_items i ON i.job_id = n.job_id AND contains(i.text, n.name) GROUP BY 1, 2""")
def name_in_text(spark, d):
    """The first item of the job whose text holds a content's name."""
    n = table(spark, d, "content_items").where(F.trim("content_name") != "").select("content_row_id", "job_id", F.col("content_name").alias("name")).distinct()
    i = _items(spark, d).select("job_id", "text", F.col("id").alias("first_item"))
    return matching.first_containing(n, i, ["job_id"], "name", "text", ["first_item"]).drop("job_id")


_STATE = f"""CASE WHEN {_key('expected')} = {_key('observed')} THEN 'pass' WHEN contains({_key('observed')}, {_key('expected')}) OR contains({_key('expected')}, {_key('observed')}) THEN 'critical_mismatch' ELSE 'critical_missing' END"""


@query(_PAIRS + f""", s AS (SELECT target_id, candidate_type = 'field_prefix' AS structured, {_STATE} AS st FROM p),
  o AS (SELECT target_id, min(CASE WHEN structured THEN r END) AS s, min(CASE WHEN NOT structured THEN r END) AS l FROM (SELECT *, CASE st WHEN 'pass' THEN 0 WHEN 'critical_mismatch' THEN 1 ELSE 2 END AS r FROM s) GROUP BY 1),
  u AS (SELECT *, coalesce(s = 0 OR (coalesce(l, 2) <> 0 AND coalesce(s, 2) < 2), false) AS use_s FROM o)
  SELECT target_id, ['pass', 'critical_mismatch', 'critical_missing'][CASE WHEN use_s THEN s ELSE coalesce(l, s) END + 1] AS status,
    CASE WHEN use_s OR l IS NULL THEN 'structured' ELSE 'lines' END AS source, CASE WHEN s = 0 AND l > 0 THEN 'channels_differ' END AS flag FROM u""")
def channel_arbitration(spark, d):
    """One answer per target from the structured candidates and those of lines."""
    p = _pairs(spark, d).withColumn("e", tx.compare_key(F.col("expected"))).withColumn("o", tx.compare_key(F.col("observed")))
    state = F.when(F.col("e") == F.col("o"), "pass").when(F.contains("o", "e") | F.contains("e", "o"), "critical_mismatch").otherwise("critical_missing")
    return matching.arbitrated(p.select("target_id", "candidate_type", state.alias("status")), "target_id", "candidate_type", "status", "field_prefix")


@query(_MATCHED + """SELECT target_id, CASE WHEN status = 'pass' THEN 'equal' WHEN status = 'manual_review' THEN reason WHEN status = 'critical_mismatch' THEN 'check_print_or_recognition' ELSE 'check_whether_printed' END AS hint FROM result""")
def difference_hints(spark, d):
    s = _status(spark, d)
    hint = matching.difference_hint(F.col("status"), F.col("reason"), F.lit("none"))
    return s.select("target_id", F.when(hint == "identical", "equal").otherwise(hint).alias("hint"))


@query(f"""WITH {_FIRST_ITEMS}, v AS (SELECT DISTINCT job_id, semantic_key, {_key('text')} AS v FROM first_items WHERE text IS NOT NULL AND job_id IS NOT NULL AND semantic_key IS NOT NULL),
  h AS (SELECT DISTINCT a.job_id, a.semantic_key, a.v FROM v a JOIN v b USING (job_id, semantic_key) WHERE a.v <> b.v AND length(a.v) >= 8 AND contains(b.v, a.v))
  SELECT * FROM (SELECT job_id, semantic_key, count(*) AS n_values, count(*) FILTER (h.v IS NULL) AS n_clusters FROM v LEFT JOIN h USING (job_id, semantic_key, v) GROUP BY 1, 2) WHERE n_clusters > 1""")
def conflict_clusters(spark, d):
    """Keys of a job whose values differ by more than one holding the other."""
    v = _items(spark, d).where(F.col("job_id").isNotNull() & F.col("semantic_key").isNotNull()).select("job_id", "semantic_key", tx.compare_key(F.col("text")).alias("v"))
    return matching.conflict_clusters(v, ["job_id", "semantic_key"], "v")


# -- the two channels

_ONE = """one AS (SELECT job_id, page, span_id, min(text) AS text, min(source) AS source, min(confidence) AS confidence, min(bbox_pdf.x) AS x, min(bbox_pdf.y) AS y, min(bbox_pdf.width) AS w, min(bbox_pdf.height) AS h,
  min(bbox_pdf.page_height) AS ph FROM text_spans WHERE span_id IS NOT NULL AND job_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2, 3)"""


def _one(spark, d) -> DataFrame:
    s = table(spark, d, "text_spans").where(F.col("span_id").isNotNull() & F.col("job_id").isNotNull() & F.col("page").isNotNull())
    box = {"x": "x", "y": "y", "w": "width", "h": "height", "ph": "page_height"}
    return s.groupBy("job_id", "page", "span_id").agg(
        F.min("text").alias("text"), F.min("source").alias("source"), F.min("confidence").alias("confidence"), *[F.min(f"bbox_pdf.{f}").alias(n) for n, f in box.items()]
    )


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """(lines, spans): what the scan reads and what the document's own text holds, with boxes."""
    s = _one(spark, d).withColumn("key", tx.compare_key(F.col("text")))
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"), F.col("ph").alias("page_height"))
    boxed = s.where(F.col("x").isNotNull())
    lines = boxed.where(F.col("source") == "ocr").select("job_id", "page", F.col("span_id").alias("line_id"), F.col("key").alias("line_key"), box.alias("line_box"))
    spans = boxed.where(F.col("source") != "ocr").select("job_id", "page", "span_id", F.col("key").alias("span_key"), box.alias("span_box"))
    return lines, spans


_SIDES = f"""WITH {_ONE}, k AS (SELECT *, {_key('text')} AS k FROM one WHERE x IS NOT NULL), l AS (SELECT * FROM k WHERE source = 'ocr' AND k <> ''), s AS (SELECT * FROM k WHERE source <> 'ocr'),
  on_line AS (SELECT l.job_id, l.page, l.span_id AS line_id, l.k AS lk, s.span_id, s.k AS sk, s.x AS sx, l.x AS lx, l.x + l.w AS le, least(l.x + l.w, s.x + s.w) - greatest(l.x, s.x) AS wide FROM l JOIN s ON l.job_id = s.job_id AND l.page = s.page
    AND s.k <> '' AND l.ph > 0 AND s.ph > 0 AND least(l.y + l.h, s.y + s.h) - greatest(l.y, s.y) >= least(l.h, s.h) * 0.45 AND least(l.x + l.w, s.x + s.w) - greatest(l.x, s.x) > 0)
"""


def _alike(a: str, b: str) -> str:
    return f"((contains({a}, {b}) OR contains({b}, {a})) AND least(length({a}), length({b})) / greatest(length({a}), length({b}), 1) >= 0.6 AND length({a}) > 0 AND length({b}) > 0)"


@query(_SIDES + f""", one_ AS (SELECT job_id, page, line_id, 1 AS tier, arg_min(span_id, struct_pack(a := -wide, b := span_id)) AS span_ids FROM on_line WHERE lk = sk GROUP BY 1, 2, 3),
  once AS (SELECT job_id, page, k, min(span_id) AS span_ids FROM s GROUP BY 1, 2, 3 HAVING count(*) = 1),
  two AS (SELECT l.job_id, l.page, l.span_id AS line_id, 2 AS tier, once.span_ids FROM l JOIN once USING (job_id, page, k)),
  three AS (SELECT job_id, page, line_id, 3 AS tier, ids AS span_ids FROM (SELECT job_id, page, line_id, lk, string_agg(sk, '' ORDER BY sx, span_id) AS t, string_agg(span_id, '+' ORDER BY sx, span_id) AS ids FROM on_line GROUP BY 1, 2, 3, 4) WHERE {_alike('lk', 't')}),
  four AS (SELECT job_id, page, line_id, 4 AS tier, arg_min(span_id, struct_pack(a := sx, b := span_id)) AS span_ids FROM on_line WHERE {_alike('lk', 'sk')} GROUP BY 1, 2, 3),
  u AS (SELECT * FROM one_ UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four)
  SELECT job_id, page, line_id, tier, span_ids FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page, line_id ORDER BY tier, span_ids) AS rn FROM u) WHERE rn = 1""")
def matched_lines(spark, d):
    """Scanned lines with the document's own spans that read the same, in four tiers (without the sequence ratio, which SQL lacks)."""
    return channels.matched_lines(*_sides(spark, d), ["job_id", "page"], with_ratio=False)


@query()
def matched_lines_by_ratio(spark, d):
    """As ``matched_lines`` with the sequence ratio where nothing else decides."""
    return channels.matched_lines(*_sides(spark, d), ["job_id", "page"])


_SUPER = _SIDES + """, runs AS (SELECT job_id, page, span_id, sk, list(struct_pack(x := lx, id := line_id, t := lk, e := le) ORDER BY lx, line_id) AS s FROM on_line GROUP BY 1, 2, 3, 4),
  super AS (SELECT job_id, page, span_id FROM runs WHERE len(s) > 1 AND len(list_filter(range(1, len(s)), lambda i: len(list_filter(range(i + 1, len(s) + 1),
    lambda j: array_to_string(list_transform(s[i:j], lambda q: q.t), '') = sk AND len(list_filter(range(i + 1, j + 1), lambda m: s[m].x - s[m - 1].e < 4)) = 0)) > 0)) > 0)
"""


@query(_SUPER + "SELECT * FROM super")
def superseded_spans(spark, d):
    lines, spans = _sides(spark, d)
    return channels.superseded_spans(spans, lines, ["job_id", "page"])


_IMPORTANT = ["净含量", "配料", "保质期", "生产日期", "产地", "许可证"]


@query(f"""WITH {_ONE}, own AS (SELECT * FROM one WHERE source <> 'ocr'),
  al AS (SELECT DISTINCT ocr_line_id, pdf_span_ids, {_key('pdf_text')} AS p, {_key('ocr_text')} AS o FROM source_alignments WHERE ocr_line_id IS NOT NULL),
  used AS (SELECT DISTINCT unnest(pdf_span_ids) AS span_id FROM al),
  u AS (SELECT 'missing_in_scan' AS issue, text AS t, span_id AS target_id FROM own WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM used WHERE used.span_id = own.span_id)
    UNION ALL SELECT 'missing_in_text', o, ocr_line_id FROM al WHERE coalesce(p, '') = '' AND o <> '' UNION ALL SELECT 'text_conflict', p, ocr_line_id FROM al WHERE p <> '' AND o <> '' AND p <> o
    UNION ALL SELECT 'low_confidence', text, span_id FROM own WHERE confidence < 0.8)
  SELECT DISTINCT issue, CASE WHEN coalesce(regexp_matches(t, '{"|".join(_IMPORTANT)}'), false) THEN 'medium' ELSE 'low' END AS severity, target_id FROM u""")
def source_issues(spark, d):
    """What the readings of a document miss or dispute, in four kinds."""
    own = _one(spark, d).where(F.col("source") != "ocr")
    al = table(spark, d, "source_alignments").where(F.col("ocr_line_id").isNotNull()).select(
        "ocr_line_id", "pdf_span_ids", tx.compare_key(F.col("pdf_text")).alias("pdf_key"), tx.compare_key(F.col("ocr_text")).alias("ocr_key")
    ).distinct()
    return channels.source_issues(own, al, _IMPORTANT)


@query(_SUPER + """, un AS (SELECT l.job_id, l.span_id FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.job_id = l.job_id AND s.page = l.page AND s.k = l.k)),
  can AS (SELECT job_id, page, span_id FROM s WHERE NOT EXISTS (SELECT 1 FROM super x WHERE x.job_id = s.job_id AND x.page = s.page AND x.span_id = s.span_id) UNION ALL SELECT job_id, NULL, span_id FROM un),
  c AS (SELECT job_id, 1 AS a, 0 AS b, 0 AS u, 0 AS k FROM s UNION ALL SELECT job_id, 0, 1, 0, 0 FROM super UNION ALL SELECT job_id, 0, 0, 1, 0 FROM un UNION ALL SELECT job_id, 0, 0, 0, 1 FROM can)
  SELECT job_id, CAST(sum(a) AS BIGINT) AS n_pdf, CAST(sum(b) AS BIGINT) AS n_superseded, CAST(sum(u) AS BIGINT) AS n_unmatched, CAST(sum(k) AS BIGINT) AS n_canonical, sum(k) = sum(a) - sum(b) + sum(u) AS balanced FROM c GROUP BY 1""")
def fusion_account(spark, d):
    lines, spans = _sides(spark, d)
    by = ["job_id", "page"]
    gone = channels.superseded_spans(spans, lines, by)
    own = spans.select(*by, F.col("span_key").alias("line_key")).distinct()
    unmatched = lines.where(F.col("line_key") != "").join(own, [*by, "line_key"], "left_anti").select("job_id", F.col("line_id").alias("span_id"))
    canonical = spans.join(gone, [*by, "span_id"], "left_anti").select("job_id").unionAll(unmatched.select("job_id"))
    return channels.fusion_account(spans, gone, unmatched, canonical, ["job_id"])


# -- the document graph


def _graph_parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = _one(spark, d).select("job_id", "page", "span_id", "x", "y", F.col("h").alias("height"), "text")
    i = _items(spark, d)
    c = table(spark, d, "compare_candidates").where(F.col("region_id").isNotNull() & F.col("job_id").isNotNull())
    of_line = table(spark, d, "source_alignments").select("ocr_line_id", F.explode_outer("pdf_span_ids").alias("span_id")).distinct()
    regions = (
        c.select("job_id", "region_id", F.explode_outer("source_ocr_line_ids").alias("ocr_line_id")).distinct()
        .join(of_line, "ocr_line_id", "left").select("job_id", "region_id", "span_id").distinct()
    )
    cells = i.where(F.col("table_id").isNotNull() & F.col("job_id").isNotNull()).select("job_id", "table_id", "row_key", F.col("id").alias("cell_id"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("span_ids"))
    return s, regions, cells


_PARTS = f"""WITH {_FIRST_ITEMS}, {_ONE}, al AS (SELECT DISTINCT ocr_line_id, u AS span_id FROM source_alignments LEFT JOIN LATERAL (SELECT unnest(pdf_span_ids) AS u) ON true),
  rg AS (SELECT DISTINCT c.job_id, c.region_id, al.span_id FROM (SELECT DISTINCT job_id, region_id, l AS ocr_line_id FROM compare_candidates LEFT JOIN LATERAL (SELECT unnest(source_ocr_line_ids) AS l) ON true WHERE region_id IS NOT NULL AND job_id IS NOT NULL) c LEFT JOIN al USING (ocr_line_id)),
  ce AS (SELECT job_id, table_id, row_key, id AS cell_id, source_ids FROM first_items WHERE table_id IS NOT NULL AND job_id IS NOT NULL),
  nd AS (SELECT 'page|' || job_id || '|' || page AS node_id, 'page' AS kind, job_id FROM one UNION SELECT span_id, 'text_span', job_id FROM one UNION SELECT 'region|' || job_id || '|' || region_id, 'region', job_id FROM rg
    UNION SELECT 'table|' || job_id || '|' || table_id, 'table', job_id FROM ce UNION SELECT 'row|' || job_id || '|' || table_id || '|' || row_key, 'table_row', job_id FROM ce WHERE row_key IS NOT NULL UNION SELECT cell_id, 'table_cell', job_id FROM ce),
  pl AS (SELECT *, y + h / 2 AS mid FROM one WHERE y IS NOT NULL),
  pr AS (SELECT job_id, span_id AS source, lead(span_id) OVER w AS target, mid, h, lead(mid) OVER w AS mid2, lead(h) OVER w AS h2 FROM pl WINDOW w AS (PARTITION BY job_id, page ORDER BY y, x, span_id)),
  ed AS (SELECT 'page|' || job_id || '|' || page AS source, span_id AS target, 'has_span' AS kind, job_id FROM one UNION SELECT source, target, 'reading_order', job_id FROM pr WHERE target IS NOT NULL
    UNION SELECT source, target, CASE WHEN abs(mid - mid2) <= greatest(h, h2) * 0.6 THEN 'same_row' ELSE 'above' END, job_id FROM pr WHERE target IS NOT NULL
    UNION SELECT source, target, 'same_column', job_id FROM (SELECT job_id, span_id AS source, lead(span_id) OVER (PARTITION BY job_id, page, floor(x / 40) ORDER BY y, x, span_id) AS target FROM pl) WHERE target IS NOT NULL
    UNION SELECT span_id, 'region|' || job_id || '|' || region_id, 'in_region', job_id FROM rg WHERE span_id IS NOT NULL UNION SELECT 'job|' || job_id, 'table|' || job_id || '|' || table_id, 'has_table', job_id FROM ce
    UNION SELECT 'table|' || job_id || '|' || table_id, 'row|' || job_id || '|' || table_id || '|' || row_key, 'has_row', job_id FROM ce WHERE row_key IS NOT NULL
    UNION SELECT 'row|' || job_id || '|' || table_id || '|' || row_key, cell_id, 'has_cell', job_id FROM ce WHERE row_key IS NOT NULL UNION SELECT cell_id, 'table|' || job_id || '|' || table_id, 'cell_of_table', job_id FROM ce
    UNION SELECT cell_id, s, 'cell_source', job_id FROM (SELECT cell_id, job_id, unnest(source_ids) AS s FROM ce) WHERE s IS NOT NULL)
"""


@query(_PARTS + "SELECT node_id, kind, job_id FROM nd")
def document_nodes(spark, d):
    return document_graph.nodes(*_graph_parts(spark, d))


@query(_PARTS + "SELECT source, target, kind, job_id FROM ed")
def document_edges(spark, d):
    return document_graph.edges(*_graph_parts(spark, d))


@query(_PARTS + """SELECT DISTINCT source, target, kind, 'unknown_node' AS fault FROM ed WHERE source NOT LIKE 'job|%' AND (source NOT IN (SELECT node_id FROM nd) OR target NOT IN (SELECT node_id FROM nd))
  UNION SELECT source, target, kind, 'loop' FROM ed WHERE source = target""")
def edge_faults(spark, d):
    parts = _graph_parts(spark, d)
    return document_graph.edge_faults(document_graph.nodes(*parts), document_graph.edges(*parts))


@query(_PARTS + """, keep AS (SELECT target AS node_id FROM ed WHERE kind = 'cell_source' UNION SELECT cell_id FROM ce)
  SELECT source, target, kind, job_id FROM ed WHERE source IN (SELECT node_id FROM keep) AND target IN (SELECT node_id FROM keep)""")
def table_edges(spark, d):
    """Edges between spans and cells of tables, both ends among them."""
    parts = _graph_parts(spark, d)
    e = document_graph.edges(*parts)
    keep = parts[2].select(F.explode(F.concat("span_ids", F.array("cell_id"))).alias("node_id")).where(F.col("node_id").isNotNull())
    return document_graph.edges_among(e, keep)


@query(f"""WITH {_FIRST_ITEMS}, {_ONE}, t AS (SELECT s AS span_id, count(DISTINCT id) AS n FROM (SELECT id, unnest(source_ids) AS s FROM first_items) WHERE s IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT unnest(source_node_ids) AS span_id FROM evidence_items)
  SELECT one.span_id, CASE WHEN source = 'xlsx_cell' THEN 'structural' WHEN trim(coalesce(text, '')) = '' THEN 'ignored' WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'extracted'
    WHEN e.span_id IS NOT NULL OR regexp_matches(text, '{"|".join(_IMPORTANT)}') THEN 'unknown' ELSE 'ignored' END AS state FROM one LEFT JOIN t USING (span_id) LEFT JOIN e USING (span_id)""")
def span_states(spark, d):
    targets = _items(spark, d).select(F.explode("source_ids").alias("span_id"), F.col("id").alias("target")).where(F.col("span_id").isNotNull())
    listed = table(spark, d, "evidence_items").select(F.explode("source_node_ids").alias("span_id"))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return document_graph.span_states(_one(spark, d), targets, listed, F.col("source") == "xlsx_cell", blank, F.col("text").rlike("|".join(_IMPORTANT)))


# -- summaries


@query(f"""WITH {_ONE} SELECT job_id, count(*) AS n, round(count(*) FILTER (x IS NOT NULL) / count(*), 4) AS box_rate, round(count(*) FILTER (trim(coalesce(text, '')) = '') / count(*), 4) AS blank_rate,
  round(count(*) FILTER (source = 'ocr') / count(*), 4) AS scan_rate, round(count(*) FILTER (source = 'xlsx_cell') / count(*), 4) AS cell_rate, round(count(*) FILTER (confidence < 0.8) / count(*), 4) AS low_rate,
  round(count(*) FILTER (regexp_matches(text, '[:：]')) / count(*), 4) AS labelled_rate, round(count(*) FILTER (length(text) > 40) / count(*), 4) AS long_rate, floor(sum(CAST(round(confidence * 1e6) AS BIGINT)) / count(confidence) / 100.0 + 0.5) / 10000.0 AS mean_confidence,
  floor(sum(CAST(round(length(text) * 1e6) AS BIGINT)) / count(length(text)) / 100.0 + 0.5) / 10000.0 AS mean_length FROM one GROUP BY 1""")
def span_measures(spark, d):
    t = F.col("text")
    return summaries.measures(
        _one(spark, d), ["job_id"],
        {"box_rate": F.col("x").isNotNull(), "blank_rate": F.trim(F.coalesce(t, F.lit(""))) == "", "scan_rate": F.col("source") == "ocr", "cell_rate": F.col("source") == "xlsx_cell",
         "low_rate": F.col("confidence") < 0.8, "labelled_rate": t.rlike("[:：]"), "long_rate": F.length(t) > 40},
        {"mean_confidence": F.col("confidence"), "mean_length": F.length(t)},
    )


@query(f"""WITH {_FIRST_ITEMS} SELECT job_id, count(*) AS n, round(count(*) FILTER (comparison_required) / count(*), 4) AS compared_rate, round(count(*) FILTER (review_required) / count(*), 4) AS review_rate,
  round(count(*) FILTER (semantic_key IS NULL) / count(*), 4) AS no_key_rate, round(count(*) FILTER (starts_with(semantic_key, 'custom.')) / count(*), 4) AS custom_rate, round(count(*) FILTER (table_id IS NOT NULL) / count(*), 4) AS table_rate,
  round(count(*) FILTER (len(evidence_refs) > 0) / count(*), 4) AS evidence_rate, round(count(*) FILTER (len(source_ids) > 0) / count(*), 4) AS source_rate, floor(sum(CAST(round(len(source_ids) * 1e6) AS BIGINT)) / count(len(source_ids)) / 100.0 + 0.5) / 10000.0 AS mean_sources, floor(sum(CAST(round(length(text) * 1e6) AS BIGINT)) / count(length(text)) / 100.0 + 0.5) / 10000.0 AS mean_length FROM first_items GROUP BY 1""")
def item_measures(spark, d):
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return summaries.measures(
        _items(spark, d), ["job_id"],
        {"compared_rate": F.col("comparison_required"), "review_rate": F.col("review_required"), "no_key_rate": F.col("semantic_key").isNull(), "custom_rate": F.col("semantic_key").startswith("custom."),
         "table_rate": F.col("table_id").isNotNull(), "evidence_rate": size("evidence_refs") > 0, "source_rate": size("source_ids") > 0},
        {"mean_sources": size("source_ids"), "mean_length": F.length("text")},
    )


@query("""SELECT job_id, count(*) AS n, round(count(*) FILTER (bbox_status = 'available') / count(*), 4) AS box_rate, round(count(*) FILTER (deleted_at IS NOT NULL) / count(*), 4) AS deleted_rate,
  round(count(*) FILTER (trim(coalesce(source_text, '')) = '') / count(*), 4) AS blank_rate, round(count(*) FILTER (len(extraction_methods) > 1) / count(*), 4) AS several_methods_rate, floor(sum(CAST(round(len(source_node_ids) * 1e6) AS BIGINT)) / count(len(source_node_ids)) / 100.0 + 0.5) / 10000.0 AS mean_nodes FROM evidence_items GROUP BY 1""")
def evidence_measures(spark, d):
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return summaries.measures(
        table(spark, d, "evidence_items"), ["job_id"],
        {"box_rate": F.col("bbox_status") == "available", "deleted_rate": F.col("deleted_at").isNotNull(), "blank_rate": F.trim(F.coalesce("source_text", F.lit(""))) == "", "several_methods_rate": size("extraction_methods") > 1},
        {"mean_nodes": size("source_node_ids")},
    )


_HAS_EVIDENCE = "e AS (SELECT evidence_id, bool_or(deleted_at IS NOT NULL) AS deleted FROM evidence_items WHERE evidence_id IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_FIRST_ITEMS}, {_HAS_EVIDENCE}, r AS (SELECT id, count(e.evidence_id) AS n_ok, count(*) FILTER (e.deleted) AS n_deleted FROM (SELECT id, unnest(evidence_refs) AS ref FROM first_items) x LEFT JOIN e ON e.evidence_id = x.ref GROUP BY 1)
  SELECT id, reasons = '' AS admitted, reasons FROM (SELECT id, array_to_string(list_filter([CASE WHEN NOT comparison_required THEN 'not_compared' END, CASE WHEN review_required THEN 'for_review' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no_text' END,
    CASE WHEN coalesce(n_ok, 0) = 0 THEN 'no_evidence' END, CASE WHEN n_deleted > 0 THEN 'deleted_evidence' END], lambda v: v IS NOT NULL), ',') AS reasons FROM first_items LEFT JOIN r USING (id))""")
def item_blocks(spark, d):
    """What keeps an item from being taken over as it is."""
    i = _items(spark, d)
    e = table(spark, d, "evidence_items").where(F.col("evidence_id").isNotNull()).groupBy(F.col("evidence_id").alias("ref")).agg(F.bool_or(F.col("deleted_at").isNotNull()).alias("deleted"))
    named = i.select("id", F.explode("evidence_refs").alias("ref")).join(e, "ref", "left")
    r = named.groupBy("id").agg(F.count("deleted").alias("n_ok"), F.count_if("deleted").alias("n_deleted"))
    return summaries.block_reasons(i.join(r, "id", "left"), "id", {
        "not_compared": ~F.col("comparison_required"), "for_review": F.col("review_required"), "no_text": F.trim(F.coalesce("text", F.lit(""))) == "",
        "no_evidence": F.coalesce("n_ok", F.lit(0)) == 0, "deleted_evidence": F.col("n_deleted") > 0,
    })


_REQUIREMENT = {"colour": "颜色|colou?r|cmyk", "layout": "版面|排版|字高|layout|panel", "barcode": "条码|barcode", "translation": "翻译|译为|英文|translat", "deadline": "日期|截止|before|deadline", "print": "印刷|打样|print"}


@query("SELECT DISTINCT row_id, CASE " + " ".join(f"WHEN coalesce(regexp_matches(lower(remark), '{p}'), false) THEN '{n}'" for n, p in _REQUIREMENT.items()) + " ELSE 'other' END AS requirement FROM main_labels WHERE trim(remark) <> ''")
def requirement_classes(spark, d):
    """Remarks by the first class of demand that they match."""
    rows = table(spark, d, "main_labels").where(F.trim("remark") != "")
    return rows.select("row_id", summaries.first_class(F.lower("remark"), _REQUIREMENT, "other").alias("requirement")).distinct()


@query(f"""WITH {_ONE} SELECT span_id, coalesce(lower(trim(text)) IN ('页', '次', 'page', 'no', 'null') OR (length(trim(text)) <= 2 AND NOT regexp_matches(trim(text), '[一-鿿]{{2}}|[0-9]{{2}}')), true) AS noise,
  coalesce(length(trim(text)) <= 2 AND x < 40, false) AS side_marker FROM one""")
def noise_spans(spark, d):
    """Spans that say nothing by themselves, and short ones at the left margin."""
    t = F.col("text")
    marker = F.coalesce((F.length(F.trim(t)) <= 2) & (F.col("x") < 40), F.lit(False))
    return _one(spark, d).select("span_id", summaries.is_noise(t, ["页", "次", "page", "no", "null"]).alias("noise"), marker.alias("side_marker"))


@query("""SELECT evidence_id, arg_min(source_text, struct_pack(a := ingested_at, b := source_text)) FILTER (source_text IS NOT NULL) AS source_text, arg_min(page, struct_pack(a := ingested_at, b := page)) FILTER (page IS NOT NULL) AS page,
  min(bbox_status) AS bbox_status FROM evidence_items WHERE evidence_id IS NOT NULL GROUP BY 1""")
def merged_evidence(spark, d):
    """Deliveries of one evidence merged, the first value of each column."""
    e = table(spark, d, "evidence_items").where(F.col("evidence_id").isNotNull())
    parts = [summaries.merged_objects(e, ["evidence_id"], ["ingested_at", c], [c]) for c in ("source_text", "page")]
    return parts[0].join(parts[1], "evidence_id").join(e.groupBy("evidence_id").agg(F.min("bbox_status").alias("bbox_status")), "evidence_id")


@query(f"""WITH {_ONE} SELECT job_id, page, array_to_string(s, '+') AS providers, CASE WHEN len(s) > 1 THEN 'fusion' WHEN len(s) = 1 THEN s[1] ELSE 'unknown' END AS mode, confidence
  FROM (SELECT job_id, page, list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)) AS s, floor(sum(CAST(round(coalesce(confidence, 0) * 1e6) AS BIGINT)) / count(coalesce(confidence, 0)) / 100.0 + 0.5) / 10000.0 AS confidence FROM one GROUP BY 1, 2)""")
def page_providers(spark, d):
    return summaries.provider_set(_one(spark, d), ["job_id", "page"], "source", "confidence")


@query("""SELECT job_id, page, ratio, coalesce(abs(ratio - 0.7071) <= 0.7071 * 0.08, false) AS agrees FROM (SELECT job_id, page, round(max(bbox_pdf.page_width) / max(bbox_pdf.page_height), 4) AS ratio FROM text_spans GROUP BY 1, 2)""")
def page_shapes(spark, d):
    """Pages against the shape of an A4 sheet."""
    s = table(spark, d, "text_spans").select("job_id", "page", F.col("bbox_pdf.page_width").alias("w"), F.col("bbox_pdf.page_height").alias("h"))
    return summaries.page_shapes(s, ["job_id", "page"], "w", "h", F.lit(0.7071))


@query(f"""WITH {_FIRST_ITEMS}, o AS (SELECT job_id, table_id, CASE WHEN starts_with(semantic_key, 'producer.') OR starts_with(semantic_key, 'importer.') THEN 'enterprise' WHEN starts_with(group_id, 'content_') THEN 'content' WHEN length(text) > 40 THEN 'long_text' ELSE 'main' END AS kind, count(*) AS n FROM first_items GROUP BY 1, 2, 3),
  t AS (SELECT job_id, count(DISTINCT table_id) AS nt FROM o GROUP BY 1)
  SELECT job_id, chunk, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o.job_id, CASE WHEN table_id IS NOT NULL AND nt > 1 THEN 'table:' || table_id WHEN table_id IS NOT NULL THEN 'table' ELSE kind END AS chunk, n FROM o JOIN t USING (job_id)) GROUP BY 1, 2""")
def item_chunks(spark, d):
    """Items routed to chunks, tables by themselves if there are several."""
    k = F.col("semantic_key")
    kind = F.when(k.startswith("producer.") | k.startswith("importer."), "enterprise").when(F.col("group_id").startswith("content_"), "content").when(F.length("text") > 40, "long_text").otherwise("main")
    return summaries.chunk_types(_items(spark, d), kind, "table_id", ["job_id"])


@query(f"""WITH {_FIRST_ITEMS}, dc AS (SELECT target_id AS id, CASE WHEN score >= 0.9 THEN 'accepted' WHEN score < 0.3 THEN 'rejected' ELSE 'unresolved' END AS st FROM compare_candidates WHERE target_id IS NOT NULL),
  w AS (SELECT id, max(CASE st WHEN 'accepted' THEN 0 WHEN 'rejected' THEN 2 ELSE 1 END) AS r FROM dc GROUP BY 1)
  SELECT i.id, CASE r WHEN 0 THEN 'accepted' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'rejected' ELSE 'unknown' END AS state FROM first_items i LEFT JOIN w USING (id)""")
def folded_decisions(spark, d):
    """Items by the worst decision on their candidates."""
    c = table(spark, d, "compare_candidates").where(F.col("target_id").isNotNull())
    st = F.when(F.col("score") >= 0.9, "accepted").when(F.col("score") < 0.3, "rejected").otherwise("unresolved")
    return summaries.folded_decisions(c.select(F.col("target_id").alias("id"), st.alias("st")), [], "id", "st", _items(spark, d))


@query(_MATCHED + """SELECT DISTINCT target_id, CASE reason WHEN 'best_candidate_differs' THEN 'print_differs' WHEN 'no_reliable_candidate_found' THEN 'not_found' END AS risk, CASE WHEN status = 'critical_missing' THEN 'high' ELSE 'medium' END AS level FROM result WHERE status LIKE 'critical%'""")
def routed_risks(spark, d):
    """Failed comparisons as risks by their kind."""
    s = _status(spark, d)
    checks = s.select("target_id", F.col("reason").alias("check_type"), F.when(F.col("status").startswith("critical"), "failed").otherwise("passed").alias("result"), F.when(F.col("status") == "critical_missing", "high").otherwise("medium").alias("level"))
    return summaries.routed_risks(checks, {"best_candidate_differs": "print_differs", "no_reliable_candidate_found": "not_found"}, "target_id")


@query(f"""WITH {_CANDS}, c AS (SELECT candidate_id, target_id, min(score) AS score, min(candidate_type) AS ty FROM compare_candidates WHERE candidate_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2),
  a AS (SELECT *, row_number() OVER (PARTITION BY target_id, ty ORDER BY score DESC NULLS LAST, candidate_id) AS ra FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC NULLS LAST, candidate_id) AS rb FROM a WHERE ra = 1)
  SELECT candidate_id, 'removed_by_source' AS stage FROM a WHERE ra > 1 UNION ALL SELECT candidate_id, CASE WHEN rb = 1 THEN 'kept' ELSE 'removed_by_standard' END FROM b""")
def two_stage_best(spark, d):
    """The best candidate of each source of a target, and of these the best of the target."""
    c = _cands(spark, d).where(F.col("target_id").isNotNull())
    return summaries.kept_in_two_stages(c, ["target_id", "candidate_type"], ["target_id"], [F.desc_nulls_last("score"), F.col("candidate_id")], "candidate_id")


@query(f"""WITH {_FIRST_ITEMS} SELECT job_id, table_id, count(*) AS n_cells, count(*) FILTER (trim(coalesce(text, '')) <> '') AS n_filled, round(count(*) FILTER (trim(coalesce(text, '')) <> '') / count(*), 4) AS fill_rate,
  bool_or(row_key = '能量') AS has_energy, bool_or(row_key = '蛋白质') AS has_protein FROM first_items WHERE table_id IS NOT NULL GROUP BY 1, 2""")
def table_fill(spark, d):
    """Filled cells of every table and whether the rows that it must have are there."""
    i = _items(spark, d).where(F.col("table_id").isNotNull())
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    return i.groupBy("job_id", "table_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(filled).alias("n_filled"), summaries.rate(filled).alias("fill_rate"),
        F.bool_or(F.col("row_key") == "能量").alias("has_energy"), F.bool_or(F.col("row_key") == "蛋白质").alias("has_protein"),
    )


@query(f"""WITH {_FIRST_ITEMS} SELECT job_id, array_to_string(list_filter([CASE WHEN bool_or(table_id IS NOT NULL) THEN 'table' END, CASE WHEN bool_or(starts_with(semantic_key, 'producer.')) THEN 'enterprise' END, CASE WHEN bool_or(starts_with(group_id, 'content_')) THEN 'several_contents' END,
  CASE WHEN bool_or(starts_with(semantic_key, 'barcode.')) THEN 'barcode' END], lambda v: v IS NOT NULL), ',') AS tags FROM first_items GROUP BY 1""")
def document_tags(spark, d):
    i = _items(spark, d)
    tags = {"table": F.col("table_id").isNotNull(), "enterprise": F.col("semantic_key").startswith("producer."), "several_contents": F.col("group_id").startswith("content_"), "barcode": F.col("semantic_key").startswith("barcode.")}
    return i.groupBy("job_id").agg(F.array_join(F.array_compact(F.array(*[F.when(F.bool_or(c), F.lit(n)) for n, c in tags.items()])), ",").alias("tags"))


@query("""WITH w AS (SELECT job_id, page, line_no, min(ocr_text) AS t FROM source_alignments GROUP BY 1, 2, 3), x AS (SELECT job_id, page, line_no, t AS t0, lead(t, 1) OVER v AS t1, lead(t, 2) OVER v AS t2, lead(t, 3) OVER v AS t3 FROM w WINDOW v AS (PARTITION BY job_id, page ORDER BY line_no)),
  f AS (SELECT job_id, page, line_no, 2 AS n, t0 || t1 AS t FROM x WHERE t1 IS NOT NULL UNION ALL SELECT job_id, page, line_no, 3, t0 || t1 || t2 FROM x WHERE t2 IS NOT NULL UNION ALL SELECT job_id, page, line_no, 4, t0 || t1 || t2 || t3 FROM x WHERE t3 IS NOT NULL)
  SELECT job_id, page, line_no AS "first", n AS n_lines, n_digits FROM (SELECT *, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, row_number() OVER (PARTITION BY job_id, page ORDER BY length(regexp_replace(t, '[^0-9]', '', 'g')) DESC, line_no, n) AS rn FROM f WHERE t IS NOT NULL) WHERE rn = 1""")
def best_frame(spark, d):
    """The run of two to four lines of a page with most digits."""
    lines = table(spark, d, "source_alignments").groupBy("job_id", "page", "line_no").agg(F.min("ocr_text").alias("text"))
    frames = sequences.sliding_frames(lines, ["job_id", "page"], "line_no", "text").where(F.col("text").isNotNull())
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    best = frames.withColumn("n_digits", digits).groupBy("job_id", "page").agg(F.min_by(F.struct("first", "n_lines", "n_digits"), F.struct(-F.col("n_digits"), "first", "n_lines")).alias("b"))
    return best.select("job_id", "page", "b.*")


@query("""SELECT span_id, round(coalesce(x + w / 2, 0), 3) AS cx, round(coalesce(y + h / 2, 0), 3) AS cy, coalesce(x >= pw * 0.05 AND x + w <= pw * 0.95 AND y >= ph * 0.05 AND y + h <= ph * 0.95, false) AS inside FROM (
  SELECT span_id, min(bbox_pdf.x) AS x, min(bbox_pdf.y) AS y, min(bbox_pdf.width) AS w, min(bbox_pdf.height) AS h, min(bbox_pdf.page_width) AS pw, min(bbox_pdf.page_height) AS ph FROM text_spans WHERE span_id IS NOT NULL GROUP BY 1)""")
def box_centres(spark, d):
    """Centres of boxes (0 for a missing one) and whether a box lies within the page's margins."""
    b = {"x": "x", "y": "y", "w": "width", "h": "height", "pw": "page_width", "ph": "page_height"}
    s = table(spark, d, "text_spans").where(F.col("span_id").isNotNull()).groupBy("span_id").agg(*[F.min(f"bbox_pdf.{f}").alias(n) for n, f in b.items()])
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    page = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("pw").alias("width"), F.col("ph").alias("height"))
    cx, cy = geo.centre(box)
    return s.select("span_id", F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"), geo.within(box, page, 0.05).alias("inside"))


@query(r"""SELECT DISTINCT row_id, CASE WHEN regexp_matches(filled_text, '^\s*[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?\s*$') THEN 'date' WHEN regexp_matches(filled_text, '^\s*[0-9]+(\.[0-9]+)?\s*$') THEN 'number'
  WHEN regexp_matches(filled_text, '^\s*[0-9]+(\.[0-9]+)?\s*%\s*$') THEN 'percent' WHEN regexp_matches(filled_text, '^\s*[0-9]+(\.[0-9]+)?\s*[A-Za-zμ克毫升千]+\s*$') THEN 'quantity' ELSE 'text' END AS kind FROM main_labels WHERE trim(filled_text) <> ''""")
def value_kinds(spark, d):
    rows = table(spark, d, "main_labels").where(F.trim("filled_text") != "")
    return rows.select("row_id", val_kind(F.col("filled_text")).alias("kind")).distinct()


def val_kind(c):
    kinds = {"date": r"^\s*[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?\s*$", "number": r"^\s*[0-9]+(\.[0-9]+)?\s*$", "percent": r"^\s*[0-9]+(\.[0-9]+)?\s*%\s*$", "quantity": r"^\s*[0-9]+(\.[0-9]+)?\s*[A-Za-zμ克毫升千]+\s*$"}
    return summaries.first_class(c, kinds, "text")


@query(f"""WITH {_FIRST_ITEMS} SELECT job_id, table_id, n, CAST(row_number() OVER (PARTITION BY job_id ORDER BY regexp_replace(table_id, '[0-9]+', '', 'g'), TRY_CAST(nullif(regexp_extract(table_id, '([0-9]+)', 1), '') AS BIGINT) NULLS FIRST, table_id) AS INT) AS table_no
  FROM (SELECT job_id, table_id, count(*) AS n FROM first_items WHERE table_id IS NOT NULL GROUP BY 1, 2)""")
def tables_in_order(spark, d):
    """Tables of a job in the natural order of their ids."""
    t = _items(spark, d).where(F.col("table_id").isNotNull()).groupBy("job_id", "table_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("job_id").orderBy(*summaries.natural_order(F.col("table_id")))
    return t.withColumn("table_no", F.row_number().over(w))
