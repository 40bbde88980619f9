"""Queries for the engine's own operators and their SQL. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.functions import geometry as geo
from labelloom.functions import text as tx
from labelloom.functions import values as val
from labelloom.operators import compare, fusion, graph, grounding, layout, metrics, quality, sequences, sets, vectors
from labelloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
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


#: The comparable form in SQL; the same marks as ``functions.text.compare_key``.
def _key(c: str) -> str:
    t = f"translate({c}, '{tx.WIDE.replace(chr(39), chr(39) * 2)}', '{tx.NARROW.replace(chr(39), chr(39) * 2)}')"
    t = f"translate({t}, '{tx.MARKS_FROM}', '{tx.MARKS_TO}')"
    t = f"replace(replace({t}, '≤', '<='), '≥', '>=')"
    t = rf"regexp_replace({t}, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}\x{{FEFF}}]+', '', 'g')"
    t = rf"regexp_replace({t}, '-{{2,}}', '-', 'g')"
    t = rf"regexp_replace({t}, '([0-9])\.0([^0-9]|$)', '\1\2', 'g')"
    return f"lower({t})"


_FIRST_ITEMS = """
first_items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, text) AS rn
                FROM standard_items WHERE id IS NOT NULL) WHERE rn = 1)"""
_CANDS = """
cands AS (SELECT candidate_id, target_id, min(text) AS text, min(score) AS score,
                 min(coalesce(len(source_ocr_line_ids), -1)) AS n_lines
          FROM compare_candidates WHERE candidate_id IS NOT NULL GROUP BY 1, 2)"""


# -- sources and lines


@query(r"""SELECT doc_id, CAST(i AS INT) AS ord, line FROM (
  SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line,
         generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
  WHERE trim(line, ' ') <> ''""")
def line_scan(spark, d):
    return sequences.exploded_lines(table(spark, d, "documents"), ["doc_id"], "text")


@query(f"""SELECT span_id, 'sha256:' || sha256({_key('text')}) AS text_hash FROM text_spans WHERE text IS NOT NULL""")
def norm_hash(spark, d):
    spans = table(spark, d, "text_spans").where(F.col("text").isNotNull())
    return spans.select("span_id", val.text_hash(tx.compare_key(F.col("text"))).alias("text_hash"))


@query(r"""SELECT span_id,
  CASE WHEN regexp_extract(text, '^([^:：\n]{2,16})[:：]', 1) <> '' THEN trim(regexp_extract(text, '^([^:：\n]{2,16})[:：]', 1), ' ') END AS label,
  CASE WHEN regexp_extract(text, '^([^:：\n]{2,16})[:：]', 1) <> '' THEN trim(regexp_replace(text, '^[^:：\n]{2,16}[:：]', ''), ' ') ELSE trim(text, ' ') END AS value
  FROM text_spans WHERE text IS NOT NULL""")
def label_split(spark, d):
    spans = table(spark, d, "text_spans").where(F.col("text").isNotNull())
    return spans.select("span_id", tx.label_part(F.col("text")).alias("label"), tx.value_part(F.col("text")).alias("value"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[。！？!?]|\.(\s|$)')) AS BIGINT) AS n_ends,
  CAST(len(regexp_extract_all(text, '[一-鿿]{2,18}|[A-Za-z0-9]{2,18}')) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL""")
def sentence_counts(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select(
        "doc_id",
        F.regexp_count("text", F.lit(r"[。！？!?]|\.(\s|$)")).cast("long").alias("n_ends"),
        F.size(F.regexp_extract_all("text", F.lit(r"([一-鿿]{2,18}|[A-Za-z0-9]{2,18})"), F.lit(1))).cast("long").alias("n_tokens"),
    )


@query(r"""SELECT row_id, label_item, filled_text FROM (SELECT DISTINCT row_id, label_item, filled_text FROM main_labels)
  WHERE lower(trim(coalesce(filled_text, ''))) NOT IN ('', '不适用', 'n/a', 'na', 'none', '无')""")
def print_values(spark, d):
    rows = table(spark, d, "main_labels").where(tx.is_print_value(F.col("filled_text")))
    return rows.select("row_id", "label_item", "filled_text").distinct()


_ENT = ["enterprise_name", "address_raw", "origin_raw", "license_no", "contact_raw", "postal_code", "website"]


@query("SELECT DISTINCT record_id, field, value FROM (" + " UNION ALL ".join(f"SELECT record_id, '{c}' AS field, {c} AS value FROM enterprises" for c in _ENT)
       + ") WHERE lower(trim(coalesce(value, ''))) NOT IN ('', '不适用', 'n/a', 'na', 'none', '无')")
def enterprise_fields(spark, d):
    long = table(spark, d, "enterprises").unpivot(["record_id"], _ENT, "field", "value")
    return long.where(tx.is_print_value(F.col("value"))).distinct()


@query("""SELECT DISTINCT record_id, CASE WHEN enterprise_role LIKE '%受委托%' OR enterprise_role LIKE '%被委托%' OR enterprise_role LIKE '%生产%' THEN 'producer'
  WHEN enterprise_role LIKE '%委托%' THEN 'entrusting_party' WHEN enterprise_role LIKE '%进口%' OR enterprise_role LIKE '%经销%' OR enterprise_role LIKE '%代理%' THEN 'importer'
  ELSE 'enterprise' END AS entity_type FROM enterprises""")
def enterprise_types(spark, d):
    r = F.col("enterprise_role")
    kind = (
        F.when(r.contains("受委托") | r.contains("被委托") | r.contains("生产"), "producer")
        .when(r.contains("委托"), "entrusting_party")
        .when(r.contains("进口") | r.contains("经销") | r.contains("代理"), "importer")
        .otherwise("enterprise")
    )
    return table(spark, d, "enterprises").select("record_id", kind.alias("entity_type")).distinct()


_CONTENT = ["content_name", "net_content", "product_category", "nutrition_table_no"]


@query("SELECT DISTINCT content_row_id, field, value FROM (" + " UNION ALL ".join(f"SELECT content_row_id, '{c}' AS field, {c} AS value FROM content_items" for c in _CONTENT)
       + ") WHERE lower(trim(coalesce(value, ''))) NOT IN ('', '不适用', 'n/a', 'na', 'none', '无')")
def content_fields(spark, d):
    long = table(spark, d, "content_items").unpivot(["content_row_id"], _CONTENT, "field", "value")
    return long.where(tx.is_print_value(F.col("value"))).distinct()


@query(r"""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


# -- expected against observed

_MATCHED = f"""WITH {_FIRST_ITEMS}, {_CANDS},
targets AS (SELECT id AS target_id, job_id, semantic_key, comparison_required, review_required, {_key('text')} AS expected
            FROM first_items WHERE trim(text) <> ''),
hits AS (SELECT t.target_id, min(c.candidate_id) AS candidate_id FROM targets t JOIN cands c USING (target_id)
         WHERE {_key('c.text')} = t.expected GROUP BY 1),
near AS (SELECT DISTINCT t.target_id FROM targets t JOIN cands c USING (target_id)
         WHERE contains({_key('c.text')}, t.expected) OR contains(t.expected, {_key('c.text')})),
result AS (SELECT t.target_id, t.job_id, t.semantic_key,
  CASE WHEN NOT comparison_required OR review_required THEN 'manual_review' WHEN h.target_id IS NOT NULL THEN 'pass'
       WHEN n.target_id IS NOT NULL THEN 'critical_mismatch' ELSE 'critical_missing' END AS status,
  CASE WHEN NOT comparison_required THEN 'comparison_not_required' WHEN review_required THEN 'review_required' WHEN h.target_id IS NOT NULL THEN 'matched'
       WHEN n.target_id IS NOT NULL THEN 'best_candidate_differs' ELSE 'no_reliable_candidate_found' END AS reason
  FROM targets t LEFT JOIN hits h USING (target_id) LEFT JOIN near n USING (target_id))
"""


def _status(spark, d) -> DataFrame:
    targets = compare.standard_targets(table(spark, d, "standard_items"))
    cands = compare.candidate_texts(table(spark, d, "compare_candidates")).select("target_id", "observed")
    fit = targets.select("target_id", "expected").join(cands, "target_id")
    best = fit.groupBy("target_id").agg(
        F.bool_or(F.col("expected") == F.col("observed")).alias("exact"),
        F.bool_or(F.contains("observed", "expected") | F.contains("expected", "observed")).alias("near"),
    )
    return targets.join(best, "target_id", "left").select(
        "target_id", "job_id", "semantic_key", *compare.status_columns(F.coalesce("exact", F.lit(False)), F.coalesce("near", F.lit(False)))
    )


@query(_MATCHED + "SELECT * FROM result")
def consistency_status(spark, d):
    return _status(spark, d)


@query(_MATCHED + """SELECT job_id, n_pass, n_review, n_critical,
  CASE WHEN n_critical > 0 THEN 'fail' WHEN n_review > 0 THEN 'manual_review' ELSE 'pass' END AS overall FROM (
  SELECT job_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'manual_review') AS n_review,
         count(*) FILTER (status LIKE 'critical%') AS n_critical FROM result GROUP BY 1)""")
def consistency_report(spark, d):
    return compare.overall_status(_status(spark, d), ["job_id"])


@query()
def consistency_scored(spark, d):
    """As ``consistency_status``, with the sequence similarity of the best candidate (no such function in SQL)."""
    return compare.match_status(compare.standard_targets(table(spark, d, "standard_items")), table(spark, d, "compare_candidates"))


@query(f"""WITH {_CANDS} SELECT target_id, rank, candidate_id FROM (SELECT target_id, candidate_id,
  CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC NULLS LAST, n_lines, candidate_id) AS INT) AS rank
  FROM cands WHERE target_id IS NOT NULL) WHERE rank <= 5""")
def top5_candidates(spark, d):
    return compare.best_by_score(table(spark, d, "compare_candidates"))


@query("""WITH RECURSIVE one AS (SELECT job_id, target_id, candidate_id, max(score) AS score FROM compare_candidates WHERE target_id IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2, 3),
  o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, target_id, candidate_id) AS rn FROM one),
  r AS (SELECT job_id, rn, target_id, candidate_id, score, true AS ok, [target_id] AS tl, [candidate_id] AS tr FROM o WHERE rn = 1
    UNION ALL SELECT o.job_id, o.rn, o.target_id, o.candidate_id, o.score, NOT list_contains(tl, o.target_id) AND NOT list_contains(tr, o.candidate_id),
      CASE WHEN list_contains(tl, o.target_id) OR list_contains(tr, o.candidate_id) THEN tl ELSE list_append(tl, o.target_id) END, CASE WHEN list_contains(tl, o.target_id) OR list_contains(tr, o.candidate_id) THEN tr ELSE list_append(tr, o.candidate_id) END
    FROM r JOIN o ON o.job_id IS NOT DISTINCT FROM r.job_id AND o.rn = r.rn + 1)
  SELECT job_id, target_id, candidate_id, score FROM r WHERE ok""")
def greedy_match(spark, d):
    """One-to-one pairs of targets and candidates within a job, best score first."""
    c = table(spark, d, "compare_candidates").where(F.col("target_id").isNotNull() & F.col("score").isNotNull())
    one = c.groupBy("job_id", "target_id", "candidate_id").agg(F.max("score").alias("score"))
    return compare.greedy_pairs(one, ["job_id"], "target_id", "candidate_id", "score")


@query(f"""WITH {_FIRST_ITEMS} SELECT id, concat_ws('|', coalesce(semantic_key, ''), coalesce(label, ''), coalesce(group_id, ''), coalesce(table_id, ''),
  coalesce(row_key, ''), coalesce(text, '')) AS comparison_key FROM first_items WHERE comparison_required""")
def comparison_index(spark, d):
    return compare.comparison_index(table(spark, d, "standard_items"))


@query("""SELECT DISTINCT alignment_id, ocr_line_id FROM source_alignments a WHERE ocr_line_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT unnest(source_ocr_line_ids) AS l FROM compare_candidates) c WHERE c.l = a.ocr_line_id)""")
def extra_text(spark, d):
    lines = table(spark, d, "source_alignments").where(F.col("ocr_line_id").isNotNull()).select("alignment_id", "ocr_line_id").distinct()
    return compare.unmatched_lines(lines, "ocr_line_id", table(spark, d, "compare_candidates"))


@query(rf"""WITH {_FIRST_ITEMS}, t AS (SELECT id, text, list_filter(regexp_split_to_array(text, '[,;:.。；，、()（）\s]+'), lambda x: length(x) >= 2) AS toks FROM first_items WHERE text IS NOT NULL),
{_CANDS} SELECT t.id AS target_id, c.candidate_id,
  CAST(coalesce(list_sum(list_transform(list_filter(toks, lambda x: contains(c.text, x)), lambda x: length(x))), 0) AS BIGINT) AS covered,
  CAST(coalesce(list_sum(list_transform(toks, lambda x: length(x))), 0) AS BIGINT) AS total
  FROM t JOIN cands c ON c.target_id = t.id""")
def token_coverage(spark, d):
    items = sequences.keep_best(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])
    toks = items.where(F.col("text").isNotNull()).select(F.col("id").alias("target_id"), tx.long_tokens(F.col("text")).alias("toks"))
    cands = compare.candidate_texts(table(spark, d, "compare_candidates")).select("target_id", "candidate_id", "text")
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return toks.join(cands, "target_id").select(
        "target_id", "candidate_id", size(F.filter("toks", lambda x: F.contains(F.col("text"), x))).alias("covered"), size(F.col("toks")).alias("total")
    )


# -- ordered lists


@query("""SELECT job_id, page, source, target, 'reading_order' AS edge_type FROM (SELECT job_id, page, span_id AS source,
  lead(span_id) OVER (PARTITION BY job_id, page ORDER BY ord, span_id) AS target FROM (SELECT DISTINCT job_id, page, ord, span_id FROM text_spans)) WHERE target IS NOT NULL""")
def reading_order_edges(spark, d):
    s = table(spark, d, "text_spans").select("job_id", "page", "ord", "span_id").distinct()
    return sequences.adjacent_edges(s, ["job_id", "page"], ["ord", "span_id"], "span_id")


_SPANS = "SELECT job_id, page, ord, span_id, min(text) AS text FROM text_spans GROUP BY 1, 2, 3, 4"


def _one_spans(spark, d):
    return table(spark, d, "text_spans").groupBy("job_id", "page", "ord", "span_id").agg(F.min("text").alias("text"))


@query(rf"""SELECT span_id, last_value(l IGNORE NULLS) OVER (PARTITION BY job_id, page ORDER BY ord, span_id ROWS UNBOUNDED PRECEDING) AS label
  FROM (SELECT *, CASE WHEN regexp_extract(text, '^([^:：\n]{{2,16}})[:：]', 1) <> '' THEN trim(regexp_extract(text, '^([^:：\n]{{2,16}})[:：]', 1), ' ') END AS l FROM ({_SPANS}))""")
def carried_label(spark, d):
    return sequences.carried(_one_spans(spark, d), ["job_id", "page"], ["ord", "span_id"], tx.label_part(F.col("text")), "label").select("span_id", "label")


@query(f"""SELECT span_id, last_value(m IGNORE NULLS) OVER (PARTITION BY job_id, page ORDER BY ord, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marker
  FROM (SELECT *, CASE WHEN starts_with(text, '产品名称') OR starts_with(text, 'Product') THEN span_id END AS m FROM ({_SPANS}))""")
def asof_marker(spark, d):
    marker = F.col("text").startswith("产品名称") | F.col("text").startswith("Product")
    return sequences.asof_marker(_one_spans(spark, d), ["job_id", "page"], ["ord", "span_id"], marker, "span_id").select("span_id", "marker")


@query("""WITH s AS (SELECT user_id, ts AS starts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ends, event_id AS panel FROM events WHERE event_type = 'signup')
  SELECT e.event_id, s.panel FROM events e JOIN s ON e.user_id = s.user_id AND e.ts > s.starts AND (s.ends IS NULL OR e.ts < s.ends)""")
def interval_assign(spark, d):
    """Events strictly between two consecutive panels: the panel is carried forward instead of a range join."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    is_panel = F.col("event_type") == "signup"
    bounds = e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("user_id", "t")
    found = bounds.withColumn(
        "panel", F.max(F.when(is_panel, F.struct("t", "event_id"))).over(w)
    ).withColumn("at_panel", F.max(is_panel.cast("int")).over(here))
    return found.where((F.col("at_panel") == 0) & F.col("panel").isNotNull()).select("event_id", F.col("panel.event_id").alias("panel"))


@query("""SELECT user_id, session_no, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""")
def gap_sessions(spark, d):
    s = sequences.sessions(table(spark, d, "events"), ["user_id"], "ts", "event_id", 6 * 3600)
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT user_id, min(ts) AS starts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""")
def session_window_ext(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("starts"), "n")


@query("""WITH l AS (SELECT job_id, page, line_no, min(ocr_text) AS t FROM source_alignments GROUP BY 1, 2, 3),
  x AS (SELECT job_id, page, line_no, t AS t0, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3 FROM l WINDOW w AS (PARTITION BY job_id, page ORDER BY line_no))
  SELECT job_id, page, line_no AS "first", 2 AS n_lines, t0 || t1 AS text FROM x WHERE t1 IS NOT NULL
  UNION ALL SELECT job_id, page, line_no, 3, t0 || t1 || t2 FROM x WHERE t2 IS NOT NULL
  UNION ALL SELECT job_id, page, line_no, 4, t0 || t1 || t2 || t3 FROM x WHERE t3 IS NOT NULL""")
def sliding_windows(spark, d):
    lines = table(spark, d, "source_alignments").groupBy("job_id", "page", "line_no").agg(F.min("ocr_text").alias("text"))
    return sequences.sliding_frames(lines, ["job_id", "page"], "line_no", "text")


@query(f"""WITH {_FIRST_ITEMS} SELECT id, CAST(row_number() OVER (PARTITION BY job_id, semantic_key ORDER BY created_at, id) AS INT) AS instance_index,
  format('item_{{:04d}}', row_number() OVER (PARTITION BY job_id ORDER BY created_at, id)) AS stable_id FROM first_items""")
def instance_index(spark, d):
    items = sequences.keep_best(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])
    numbered = sequences.with_ordinal(sequences.with_ordinal(items, ["job_id", "semantic_key"], ["created_at", "id"]), ["job_id"], ["created_at", "id"], "n")
    return numbered.select("id", "instance_index", val.stable_id("item", F.col("n")).alias("stable_id"))


@query("""SELECT job_id, page, line_no + 1 AS missing_from, nxt - 1 AS missing_to FROM (SELECT job_id, page, line_no, lead(line_no) OVER (PARTITION BY job_id, page ORDER BY line_no) AS nxt
  FROM (SELECT DISTINCT job_id, page, line_no FROM source_alignments WHERE line_no IS NOT NULL)) WHERE nxt > line_no + 1""")
def seq_gaps(spark, d):
    """Line numbers that a page leaves out, as ranges."""
    return sequences.missing_numbers(table(spark, d, "source_alignments"), ["job_id", "page"], "line_no")


@query(f"""WITH RECURSIVE o AS (SELECT job_id, page, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY job_id, page ORDER BY ord, span_id) AS rn FROM ({_SPANS})),
  r AS (SELECT job_id, page, rn, n, 1 AS chunk_no, 1 AS items, n AS held FROM o WHERE rn = 1
    UNION ALL SELECT o.job_id, o.page, o.rn, o.n, CASE WHEN items >= 160 OR held + o.n > 12000 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN items >= 160 OR held + o.n > 12000 THEN 1 ELSE items + 1 END,
      CASE WHEN items >= 160 OR held + o.n > 12000 THEN o.n ELSE held + o.n END FROM r JOIN o ON o.job_id IS NOT DISTINCT FROM r.job_id AND o.page IS NOT DISTINCT FROM r.page AND o.rn = r.rn + 1)
  SELECT job_id, page, chunk_no, count(*) AS n_spans, CAST(sum(n) AS BIGINT) AS n_chars FROM r GROUP BY 1, 2, 3""")
def packed_blocks(spark, d):
    """Consecutive spans of a page packed into blocks of at most 160 spans and 12 000 characters."""
    s = _one_spans(spark, d).withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    chunks = sequences.packed_chunks(s.select("job_id", "page", "ord", "span_id", "size"), ["job_id", "page"], "ord", "size", 160, 12_000)
    return chunks.groupBy("job_id", "page", "chunk_no").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("size").alias("n_chars"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT job_id, page, span_id, bbox_pdf.y AS top FROM text_spans WHERE bbox_pdf IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY top, span_id) AS rn FROM s),
  r AS (SELECT job_id, page, span_id, rn, 1 AS no, top AS total, 1 AS n FROM o WHERE rn = 1
    UNION ALL SELECT o.job_id, o.page, o.span_id, o.rn, CASE WHEN abs(o.top - total / n) <= 1.25 THEN no ELSE no + 1 END, CASE WHEN abs(o.top - total / n) <= 1.25 THEN total + o.top ELSE o.top END, CASE WHEN abs(o.top - total / n) <= 1.25 THEN n + 1 ELSE 1 END
    FROM r JOIN o ON o.job_id IS NOT DISTINCT FROM r.job_id AND o.page IS NOT DISTINCT FROM r.page AND o.rn = r.rn + 1)
  SELECT span_id, no AS visual_line FROM r""")
def baseline_clusters(spark, d):
    """Spans of a page gathered to visual lines by the running mean of their tops."""
    s = table(spark, d, "text_spans").where(F.col("bbox_pdf").isNotNull()).select("job_id", "page", "span_id", F.col("bbox_pdf.y").alias("top")).distinct()
    return sequences.mean_clusters(s, ["job_id", "page"], "top", "span_id", 1.25, "visual_line").select("span_id", "visual_line")


# -- aggregates, sets, diffs


@query(f"""WITH {_FIRST_ITEMS} SELECT job_id, group_id, count(*) AS n_items, count(DISTINCT semantic_key) AS n_keys, bool_or(review_required) AS review_required,
  min(id) AS first_id, CASE WHEN bool_or(review_required) THEN 'uncertain' ELSE 'confirmed' END AS status FROM first_items GROUP BY 1, 2""")
def entity_groups(spark, d):
    items = sequences.keep_best(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])
    return items.groupBy("job_id", "group_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_distinct("semantic_key").alias("n_keys"),
        F.bool_or("review_required").alias("review_required"),
        F.min("id").alias("first_id"),
        F.when(F.bool_or("review_required"), "uncertain").otherwise("confirmed").alias("status"),
    )


@query("""SELECT text_hash, n, first_doc FROM (SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n > 1""")
def exact_dups(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > 1)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY ingested_at, doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1""")
def dedupe_keep_best(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", "ingested_at", F.sha2("text", 256).alias("h"))
    best = docs.groupBy("h").agg(F.min_by(F.struct("doc_id", "source"), F.struct("ingested_at", "doc_id")).alias("b"))  # combined map-side
    return best.select("b.doc_id", "b.source")


@query("""SELECT id, n FROM (SELECT id, count(*) AS n FROM standard_items GROUP BY 1) WHERE n > 1 AND id IS NOT NULL""")
def duplicate_ids(spark, d):
    return sets.duplicates(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"])


@query("""SELECT job_id, semantic_key, group_id, n_values FROM (SELECT job_id, semantic_key, group_id, count(DISTINCT text) AS n_values FROM standard_items
  WHERE semantic_key NOT LIKE 'custom.%' GROUP BY 1, 2, 3) WHERE n_values > 1""")
def conflict_values(spark, d):
    items = table(spark, d, "standard_items").where(~F.col("semantic_key").startswith("custom."))
    return metrics.conflicting_values(items, ["job_id", "semantic_key", "group_id"], F.col("text"))


_REQUIRED = ["product.name", "product.ingredients", "product.net_content", "producer.name", "product.shelf_life"]


@query("WITH j AS (SELECT DISTINCT job_id FROM standard_items), r AS (SELECT unnest([" + ", ".join(f"'{r}'" for r in _REQUIRED) + """]) AS semantic_key)
  SELECT j.job_id, r.semantic_key FROM j, r WHERE NOT EXISTS (SELECT 1 FROM standard_items s WHERE s.job_id = j.job_id AND s.semantic_key = r.semantic_key)""")
def missing_required(spark, d):
    return metrics.missing_required(table(spark, d, "standard_items").where(F.col("job_id").isNotNull()), "job_id", "semantic_key", _REQUIRED)


@query("""WITH l AS (SELECT event_type, count(*) AS expected FROM events WHERE user_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type, count(*) AS actual FROM events WHERE user_id % 2 = 1 GROUP BY 1)
  SELECT coalesce(l.event_type, r.event_type) AS event_type, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, least(coalesce(expected, 0), coalesce(actual, 0)) AS matched,
  greatest(coalesce(expected, 0) - coalesce(actual, 0), 0) AS missing, greatest(coalesce(actual, 0) - coalesce(expected, 0), 0) AS unexpected FROM l FULL JOIN r ON l.event_type = r.event_type""")
def multiset_overlap(spark, d):
    """The two halves of the users as expected and actual; together they are all events."""
    e = table(spark, d, "events").select("event_type", "user_id")
    return sets.multiset_overlap(e.where(F.col("user_id") % 2 == 0), e.where(F.col("user_id") % 2 == 1), ["event_type"])


@query("""SELECT coalesce(b.job_id, a.job_id) AS job_id, coalesce(b.semantic_key, a.semantic_key) AS semantic_key,
  CASE WHEN a.job_id IS NULL THEN 'remove' WHEN b.job_id IS NULL THEN 'add' ELSE 'adjust' END AS action
  FROM (SELECT job_id, semantic_key, min(text) AS t FROM standard_items WHERE NOT review_required GROUP BY 1, 2) b
  FULL JOIN (SELECT job_id, semantic_key, max(text) AS t FROM standard_items WHERE comparison_required GROUP BY 1, 2) a ON a.job_id = b.job_id AND a.semantic_key = b.semantic_key
  WHERE a.job_id IS NULL OR b.job_id IS NULL OR a.t IS DISTINCT FROM b.t""")
def plan_diff(spark, d):
    s = table(spark, d, "standard_items")
    before = s.where(~F.col("review_required")).groupBy("job_id", "semantic_key").agg(F.min("text").alias("t"))
    after = s.where("comparison_required").groupBy("job_id", "semantic_key").agg(F.max("text").alias("t"))
    return sets.plan_diff(before, after, ["job_id", "semantic_key"], "t")


@query("""WITH e AS (SELECT DISTINCT job_id, alignment_id FROM source_alignments WHERE text_relation = 'equivalent'), a AS (SELECT DISTINCT job_id, alignment_id FROM source_alignments WHERE text_similarity >= 0.95),
  j AS (SELECT coalesce(e.job_id, a.job_id) AS job_id, e.alignment_id AS x, a.alignment_id AS y FROM e FULL JOIN a ON e.job_id = a.job_id AND e.alignment_id = a.alignment_id)
  SELECT job_id, count(x) AS n_expected, count(y) AS n_actual, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_hit FROM j GROUP BY 1""")
def recall_counts(spark, d):
    a = table(spark, d, "source_alignments")
    m = metrics.recall_precision(a.where(F.col("text_relation") == "equivalent"), a.where(F.col("text_similarity") >= 0.95), ["job_id"], ["alignment_id"])
    return m.select("job_id", "n_expected", "n_actual", "n_hit")


@query("""SELECT coalesce(event_type, '*') AS event_type, coalesce(props_k, -1) AS props_k, CAST(count(*) AS BIGINT) AS n, CAST(grouping(event_type) * 2 + grouping(props_k) AS BIGINT) AS level FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS props_k FROM events) GROUP BY ROLLUP(event_type, props_k)""")
def type_counts_rollup(spark, d):
    e = table(spark, d, "events").select("event_type", (F.get_json_object("props", "$.k").cast("long") % 5).alias("props_k"))
    out = e.rollup("event_type", "props_k").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return out.na.fill("*", ["event_type"]).na.fill(-1, ["props_k"])


@query()
def approx_users(spark, d):
    """An approximate aggregate next to the exact one."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count_distinct("user_id").alias("exact"))


@query("""WITH t AS (SELECT DISTINCT job_id, semantic_key || '=' || text AS t FROM standard_items WHERE semantic_key IS NOT NULL AND text IS NOT NULL),
  b AS (SELECT job_id, substr(sha256(t), 1, 3) AS bucket, sha256(string_agg(t, chr(10) ORDER BY t)) AS h FROM t GROUP BY 1, 2)
  SELECT job_id, sha256(string_agg(bucket || h, chr(10) ORDER BY bucket)) AS state_hash FROM b GROUP BY 1""")
def state_hash(spark, d):
    """A hash of each job's values, whatever their order; built by buckets, so that no job is gathered in one piece."""
    s = table(spark, d, "standard_items").where(F.col("semantic_key").isNotNull() & F.col("text").isNotNull())
    one = s.select("job_id", F.concat_ws("=", "semantic_key", "text").alias("t")).distinct()
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    buckets = one.groupBy("job_id", F.substring(F.sha2("t", 256), 1, 3).alias("bucket")).agg(joined(F.col("t")).alias("h"))
    return buckets.groupBy("job_id").agg(joined(F.concat("bucket", "h")).alias("state_hash"))  # 4096 buckets at most


# -- scalar functions on columns


@query(r"""SELECT p_partkey, CASE WHEN 0 = 1 THEN '' WHEN length(code) NOT IN (8, 12, 13, 14) THEN 'bad_length'
  WHEN (10 - list_sum(list_transform(range(1, length(code)), lambda i: CAST(code[length(code) - i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 <> CAST(right(code, 1) AS INT) THEN 'bad_check_digit' ELSE 'passed' END AS status
  FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '690' || p_partkey ELSE lpad(CAST(p_partkey * 7919 AS VARCHAR), 12, '0') || CAST(p_size % 10 AS VARCHAR) END AS code FROM part)""")
def gtin_check(spark, d):
    """Retail codes derived from the part keys, some too short."""
    p = table(spark, d, "part")
    code = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("690"), F.col("p_partkey").cast("string"))).otherwise(
        F.concat(F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0"), (F.col("p_size") % 10).cast("string"))
    )
    return p.select("p_partkey", val.gtin_status(code).alias("status"))


@query(f"""WITH {_FIRST_ITEMS} SELECT id, CASE semantic_key
  WHEN 'producer.license_number' THEN CASE WHEN regexp_matches(text, 'SC\\d{{9,14}}') THEN 'passed' ELSE 'failed' END
  WHEN 'product.net_content' THEN CASE WHEN regexp_matches(text, '\\d+(\\.\\d+)?\\s*(克|千克|毫升|升|g|kg|ml|L)') THEN 'passed' ELSE 'failed' END
  WHEN 'product.shelf_life' THEN CASE WHEN regexp_matches(text, '\\d+\\s*(天|日|个月|月|年)|见包装') THEN 'passed' ELSE 'failed' END
  WHEN 'product.standard_code' THEN CASE WHEN regexp_matches(text, '(GB|GB/T|Q|QB|SB|T)\\s*/') THEN 'passed' ELSE 'failed' END ELSE 'skipped' END AS result FROM first_items WHERE text IS NOT NULL""")
def field_formats(spark, d):
    items = sequences.keep_best(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])
    return items.where(F.col("text").isNotNull()).select("id", val.format_result(F.col("semantic_key"), F.col("text")).alias("result"))


@query(r"""SELECT span_id, round(least(greatest(b.x / b.page_width, 0), 1), 6) AS x1, round(least(greatest(b.y / b.page_height, 0), 1), 6) AS y1,
  round(least(greatest((b.x + b.width) / b.page_width, 0), 1), 6) AS x2, round(least(greatest((b.y + b.height) / b.page_height, 0), 1), 6) AS y2
  FROM (SELECT DISTINCT span_id, bbox_pdf AS b FROM text_spans WHERE bbox_pdf IS NOT NULL AND bbox_pdf.page_width > 0 AND bbox_pdf.page_height > 0)""")
def unit_boxes(spark, d):
    s = table(spark, d, "text_spans").where(F.col("bbox_pdf").isNotNull()).select("span_id", geo.unit_box(F.col("bbox_pdf")).alias("u")).distinct()
    return s.where(F.col("u").isNotNull()).select("span_id", "u.*")


@query("""SELECT job_id, page, min(bbox_pdf.x) AS x1, min(bbox_pdf.y) AS y1, max(bbox_pdf.x + bbox_pdf.width) AS x2, max(bbox_pdf.y + bbox_pdf.height) AS y2 FROM text_spans WHERE bbox_pdf IS NOT NULL GROUP BY 1, 2""")
def page_hulls(spark, d):
    return table(spark, d, "text_spans").where(F.col("bbox_pdf").isNotNull()).groupBy("job_id", "page").agg(*geo.hull("bbox_pdf"))


@query("""WITH s AS (SELECT DISTINCT job_id, page, span_id, source, bbox_pdf.x AS x, bbox_pdf.y AS y, bbox_pdf.width AS w, bbox_pdf.height AS h FROM text_spans WHERE bbox_pdf IS NOT NULL),
  o AS (SELECT l.job_id, l.page, l.span_id AS line_id, p.span_id, round(greatest(least(l.x + l.w, p.x + p.w) - greatest(l.x, p.x), 0) * greatest(least(l.y + l.h, p.y + p.h) - greatest(l.y, p.y), 0)
    / least(greatest(l.w * l.h, 1), greatest(p.w * p.h, 1)), 4) AS r FROM s l JOIN s p ON l.job_id = p.job_id AND l.page = p.page AND l.source = 'ocr' AND p.source <> 'ocr' WHERE l.w >= 0 AND l.h >= 0 AND p.w >= 0 AND p.h >= 0)
  SELECT job_id, page, line_id, span_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page, line_id ORDER BY r DESC, span_id DESC) AS rn FROM o WHERE r >= 0.2) WHERE rn = 1""")
def box_overlaps(spark, d):
    """For every box the other box of its page that it overlaps most, by a grid join."""
    s = table(spark, d, "text_spans").where(F.col("bbox_pdf").isNotNull()).select("job_id", "page", "span_id", "source", F.col("bbox_pdf").alias("bbox")).distinct()
    lines = s.where(F.col("source") == "ocr").select("job_id", "page", F.col("span_id").alias("line_id"), F.col("bbox").alias("box"))
    spans = s.where(F.col("source") != "ocr").select("job_id", "page", "span_id", "bbox")
    return fusion.best_overlap(lines, spans, ["job_id", "page"]).drop("overlap")


@query("""SELECT source, count(*) AS n_spans, count(*) FILTER (bbox_pdf IS NOT NULL) AS n_with_box, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_blank,
  count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS n_control, count(*) FILTER (regexp_matches(text, '[一-鿿] +[一-鿿]')) AS n_spaced, count(*) FILTER (confidence < 0.8) AS n_low
  FROM text_spans GROUP BY 1""".replace("\\\\", "\\"))
def source_profile(spark, d):
    return fusion.source_profile(table(spark, d, "text_spans"))


@query()
def source_relations(spark, d):
    """How the two readings of each line relate, with sequence similarity."""
    return fusion.relation(table(spark, d, "source_alignments"))


@query("""SELECT DISTINCT span_id AS id, source FROM text_spans UNION ALL
  SELECT DISTINCT ocr_line_id, 'ocr' FROM source_alignments a WHERE ocr_line_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_alignments b WHERE b.ocr_line_id = a.ocr_line_id AND len(b.pdf_span_ids) > 0)""")
def canonical_spans(spark, d):
    al = table(spark, d, "source_alignments")
    return fusion.canonical_spans(table(spark, d, "text_spans"), al.where(F.col("ocr_line_id").isNotNull()).select("ocr_line_id"), al)


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'),
  '(?i)(api[_-]?key|secret|token|password)\s*[=:]\s*\S+', '\1=<redacted>', 'g'), '(/home/|/Users/|/root/)[^\s"'']*', '<path>', 'g')) AS redacted_hash FROM documents WHERE text IS NOT NULL""")
def redact(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.sha2(tx.redacted(F.col("text")), 256).alias("redacted_hash"))


_SCOPE = {"label": ["净含量", "配料", "保质期", "贮存条件", "产地", "Net Wt", "Storage", "Product"], "process": ["承印", "复核", "打样", "识别引擎", "扫描", "模板", "Version", "desk"]}


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'unknown' WHEN " + " OR ".join(f"contains(text, '{k}')" for k in _SCOPE["label"])
       + " THEN 'in_scope' WHEN " + " OR ".join(f"contains(text, '{k}')" for k in _SCOPE["process"]) + " THEN 'out_of_scope' ELSE 'unknown' END AS scope FROM documents")
def scope_classify(spark, d):
    has = lambda kind: F.array_contains(F.array(*[F.contains(F.col("text"), F.lit(k)) for k in _SCOPE[kind]]), True)
    scope = F.when(F.col("text").isNull() | (F.trim("text") == ""), "unknown").when(has("label"), "in_scope").when(has("process"), "out_of_scope").otherwise("unknown")
    return table(spark, d, "documents").select("doc_id", scope.alias("scope"))


@query(r"""SELECT row_id, CASE WHEN len(regexp_extract_all(filled_text, '[(（\[【]')) <> len(regexp_extract_all(filled_text, '[)）\]】]')) THEN 'unbalanced_brackets'
  WHEN regexp_matches(filled_text, '[，,、：:(（-]\s*$') THEN 'truncated' END AS issue FROM (SELECT DISTINCT row_id, filled_text FROM main_labels WHERE filled_text IS NOT NULL)""")
def value_issues(spark, d):
    return table(spark, d, "main_labels").where(F.col("filled_text").isNotNull()).select("row_id", "filled_text").distinct().select("row_id", tx.issue_of_value(F.col("filled_text")).alias("issue"))


@query(r"""SELECT DISTINCT content_row_id, trim(ref) AS ref FROM (SELECT content_row_id, unnest(regexp_split_to_array(nutrition_table_no, '[,，、;；/\s]+')) AS ref FROM content_items WHERE nutrition_table_no IS NOT NULL) WHERE trim(ref) <> ''""")
def table_refs(spark, d):
    c = table(spark, d, "content_items").where(F.col("nutrition_table_no").isNotNull())
    return c.select("content_row_id", F.explode(F.split("nutrition_table_no", r"[,，、;；/\s]+")).alias("ref")).where(F.trim("ref") != "").select("content_row_id", F.trim("ref").alias("ref")).distinct()


@query("""SELECT query_id, match_id FROM (SELECT q.vec_id AS query_id, v.vec_id AS match_id, row_number() OVER (PARTITION BY q.vec_id
  ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rn
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rn = 1""")
def vec_top1(spark, d):
    """The stated query set (ids divisible by 100) against all vectors."""
    e = table(spark, d, "embeddings")
    return vectors.top1(e, "vec_id", "embedding", e.where(F.col("vec_id") % 100 == 0))


# -- checks, graph, star joins


@query("""SELECT 'lineitem_order' AS reference, count(*) AS n_orphans FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
  UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
  UNION ALL SELECT 'orders_customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")
def ref_integrity(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")

    def orphans(name, child, key, parent, pkey):
        return child.join(parent.select(F.col(pkey).alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("reference"), "n_orphans")

    return (
        orphans("lineitem_order", li, "l_orderkey", o, "o_orderkey")
        .unionAll(orphans("lineitem_part", li, "l_partkey", table(spark, d, "part"), "p_partkey"))
        .unionAll(orphans("orders_customer", o, "o_custkey", table(spark, d, "customer"), "c_custkey"))
    )


_CONTRACT_TABLES = ["evidence_items", "standard_items", "text_spans", "source_alignments", "compare_candidates"]


def _contract(spark, d):
    return {t: table(spark, d, t) for t in _CONTRACT_TABLES}


_BLANK = "({0} IS NULL OR trim({0}) = '')"


def _row_sql(check: str, table: str, key: str, level: str, codes: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT '{check}' AS \"check\", '{table}' AS target_type, {key} AS target_id, '{code}' AS code, '{level}' AS level FROM {table} WHERE {wrong}" for code, wrong in codes.items())


def _ref_sql(check: str, table: str, key: str, ref: str, known: list[str]) -> str:
    among = " AND ".join(f"NOT EXISTS (SELECT 1 FROM {k.split('.')[0]} k WHERE k.{k.split('.')[1]} = x.ref)" for k in known)
    return f"SELECT DISTINCT '{check}', '{table}', {key}, 'unknown_reference', 'high' FROM (SELECT {key}, {ref} AS ref FROM {table}) x WHERE ref IS NOT NULL AND {among}"


def _unique_sql(check: str, table: str, key: str, by: str) -> str:
    return f"SELECT '{check}', '{table}', {key}, 'duplicate', 'high' FROM (SELECT DISTINCT {key}, {by} FROM {table} WHERE {key} IS NOT NULL) GROUP BY {key} HAVING count(*) > 1"


_SOURCES = ["text_spans.span_id", "source_alignments.ocr_line_id"]
_CONTRACT_SQL = "f AS (" + " UNION ALL ".join([
    _row_sql("evidence_contract", "evidence_items", "evidence_id", "high", {"no_text": _BLANK.format("source_text"), "bad_page": "(page IS NULL OR page < 1)", "no_method": "coalesce(len(extraction_methods), 0) = 0", "bad_bbox_status": "bbox_status NOT IN ('available', 'missing')"}),
    _row_sql("standard_item_contract", "standard_items", "id", "medium", {"no_key": _BLANK.format("semantic_key"), "no_label": _BLANK.format("label"), "no_text": _BLANK.format("text"), "no_flag": "(comparison_required IS NULL OR review_required IS NULL)"}),
    _row_sql("span_contract", "text_spans", "span_id", "low", {"no_text": _BLANK.format("text"), "bad_page": "(page IS NULL OR page < 1)", "bad_confidence": "NOT (confidence BETWEEN 0 AND 1)", "bad_source": "source NOT IN ('pdf_text', 'pdf_char_atom', 'ocr', 'xlsx_cell')"}),
    _row_sql("span_bbox_contract", "text_spans", "span_id", "medium", {"empty_box": "(bbox_pdf.width <= 0 OR bbox_pdf.height <= 0)", "negative_box": "(bbox_pdf.x < 0 OR bbox_pdf.y < 0)", "beyond_page": "bbox_pdf.x + bbox_pdf.width > bbox_pdf.page_width"}),
    _row_sql("alignment_contract", "source_alignments", "alignment_id", "high", {"no_line": _BLANK.format("ocr_line_id"), "bad_similarity": "NOT (text_similarity BETWEEN 0 AND 1)"}),
    _row_sql("candidate_contract", "compare_candidates", "candidate_id", "high", {"no_text": _BLANK.format("text"), "bad_score": "NOT (score BETWEEN 0 AND 1)", "bad_box": "(bbox_normalized.x1 > bbox_normalized.x2 OR bbox_normalized.y1 > bbox_normalized.y2)"}),
    _ref_sql("evidence_source_refs", "evidence_items", "evidence_id", "unnest(source_node_ids)", _SOURCES),
    _ref_sql("standard_item_refs", "standard_items", "id", "unnest(evidence_refs)", ["evidence_items.evidence_id"]),
    _ref_sql("standard_item_source_refs", "standard_items", "id", "unnest(source_ids)", _SOURCES),
    _ref_sql("alignment_span_refs", "source_alignments", "alignment_id", "unnest(pdf_span_ids)", ["text_spans.span_id"]),
    _ref_sql("candidate_target_refs", "compare_candidates", "candidate_id", "target_id", ["standard_items.id"]),
    _ref_sql("candidate_line_refs", "compare_candidates", "candidate_id", "unnest(source_ocr_line_ids)", ["source_alignments.ocr_line_id"]),
    _unique_sql("evidence_unique_ids", "evidence_items", "evidence_id", "source_text, page"),
    _unique_sql("standard_item_unique_ids", "standard_items", "id", "semantic_key, text"),
    _unique_sql("span_unique_ids", "text_spans", "span_id", "text, job_id"),
    """SELECT 'standard_item_text_from_evidence', 'standard_items', id, 'text_not_in_evidence', 'medium' FROM (SELECT id, regexp_replace(text, '[\\s\\x0b]+', '', 'g') AS t, unnest(evidence_refs) AS ref FROM standard_items WHERE trim(text) <> '') n
      LEFT JOIN evidence_items e ON e.evidence_id = n.ref GROUP BY id HAVING NOT bool_or(coalesce(contains(regexp_replace(source_text, '[\\s\\x0b]+', '', 'g'), t), false))""",
    """SELECT DISTINCT 'compared_items_have_candidates', 'standard_items', id, 'no_route', 'medium' FROM standard_items i WHERE comparison_required AND NOT EXISTS (SELECT 1 FROM compare_candidates c WHERE c.target_id = i.id)""",
    "SELECT 'items_present', 'standard_items', 'standard_items', 'aggregate', 'high' FROM standard_items HAVING count(*) = 0",
]) + ")"
_CHECKS = ["evidence_contract", "evidence_unique_ids", "evidence_source_refs", "standard_item_contract", "standard_item_unique_ids", "standard_item_refs", "standard_item_source_refs", "standard_item_text_from_evidence", "span_contract",
           "span_bbox_contract", "span_unique_ids", "alignment_contract", "alignment_span_refs", "candidate_target_refs", "candidate_line_refs", "candidate_contract", "compared_items_have_candidates", "items_present"]


@query(f"""WITH {_CONTRACT_SQL} SELECT n AS "check", CASE WHEN count(f.code) = 0 THEN 'passed' ELSE 'failed' END AS result, count(f.code) AS n_failures
  FROM (SELECT unnest({_CHECKS}) AS n) LEFT JOIN f ON f."check" = n GROUP BY 1""")
def contract_report(spark, d):
    """Every check of the contract, passed or failed."""
    return quality.contract_report(quality.project_contract(), _contract(spark, d))


@query("""WITH f AS (SELECT DISTINCT id, refs.ref FROM (SELECT id, unnest(evidence_refs) AS ref FROM standard_items) refs WHERE ref IS NOT NULL)
  SELECT DISTINCT id AS target_id FROM f WHERE NOT EXISTS (SELECT 1 FROM evidence_items e WHERE e.evidence_id = f.ref) AND id IS NOT NULL""")
def contract_item_refs(spark, d):
    rule = next(r for r in quality.project_contract() if r.check == "standard_item_refs")
    return rule.failures(_contract(spark, d)).select("target_id").where(F.col("target_id").isNotNull()).distinct()


@query("""SELECT DISTINCT evidence_id AS target_id, c AS code FROM (SELECT evidence_id, unnest([CASE WHEN source_text IS NULL OR trim(source_text) = '' THEN 'no_text' END,
  CASE WHEN page IS NULL OR page < 1 THEN 'bad_page' END, CASE WHEN coalesce(len(extraction_methods), 0) = 0 THEN 'no_method' END,
  CASE WHEN bbox_status NOT IN ('available', 'missing') THEN 'bad_bbox_status' END]) AS c FROM evidence_items) WHERE c IS NOT NULL""")
def contract_evidence(spark, d):
    rule = next(r for r in quality.project_contract() if r.check == "evidence_contract")
    return rule.failures(_contract(spark, d))


@query(f"""WITH {_CONTRACT_SQL}, r AS (SELECT target_type, target_id, max(CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS k FROM f GROUP BY 1, 2)
  SELECT target_type, CASE k WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n_risks, count(*) FILTER (k = 3 AND target_id IS NOT NULL) AS n_tasks FROM r GROUP BY 1, 2""")
def risk_routing(spark, d):
    """Failed checks to risks, high risks to review tasks, counted."""
    risks = quality.risks_of(quality.failures_of(quality.project_contract(), _contract(spark, d)))
    tasks = quality.review_tasks_of(risks).withColumn("task", F.lit(1))
    both = risks.join(tasks, ["target_type", "target_id"], "left")
    return both.groupBy("target_type", "risk_level").agg(F.count(F.lit(1)).alias("n_risks"), F.count("task").alias("n_tasks"))


@query(f"""WITH {_FIRST_ITEMS} SELECT job_id, bool_and(coalesce(len(evidence_refs), 0) > 0) AS evidence_bound, bool_and(NOT review_required) AS reviewed, bool_and(trim(coalesce(text, '')) <> '') AS has_text,
  bool_and(coalesce(len(evidence_refs), 0) > 0) AND bool_and(NOT review_required) AND bool_and(trim(coalesce(text, '')) <> '') AS passed FROM first_items GROUP BY 1""")
def quality_gates(spark, d):
    items = sequences.keep_best(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])
    return quality.gate(items, ["job_id"], {
        "evidence_bound": F.coalesce(F.size("evidence_refs"), F.lit(0)) > 0,
        "reviewed": ~F.col("review_required"),
        "has_text": F.trim(F.coalesce("text", F.lit(""))) != "",
    })


@query("""WITH s AS (SELECT DISTINCT span_id, job_id, page, ord FROM text_spans WHERE span_id IS NOT NULL)
  SELECT edge_type, count(*) AS n_edges, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM (
  SELECT DISTINCT * FROM (
  SELECT concat_ws('#', job_id, CAST(page AS VARCHAR)) AS source, span_id AS target, 'contains' AS edge_type FROM s
  UNION ALL SELECT span_id, lead(span_id) OVER (PARTITION BY job_id, page ORDER BY ord, span_id), 'reading_order' FROM s
  UNION ALL SELECT unnest(source_node_ids), evidence_id, 'supports' FROM evidence_items
  UNION ALL SELECT id, unnest(evidence_refs), 'cites' FROM standard_items) WHERE source IS NOT NULL AND target IS NOT NULL) GROUP BY 1""")
def graph_edges(spark, d):
    _, edges = graph.nodes_and_edges(table(spark, d, "text_spans"), table(spark, d, "evidence_items"), table(spark, d, "standard_items"))
    return graph.degree_counts(edges)


@query("""WITH s AS (SELECT DISTINCT span_id, job_id, page, ord FROM text_spans WHERE span_id IS NOT NULL),
  e AS (SELECT DISTINCT * FROM (
  SELECT concat_ws('#', job_id, CAST(page AS VARCHAR)) AS source, span_id AS target, 'contains' AS edge_type FROM s
  UNION ALL SELECT span_id, lead(span_id) OVER (PARTITION BY job_id, page ORDER BY ord, span_id), 'reading_order' FROM s
  UNION ALL SELECT unnest(source_node_ids), evidence_id, 'supports' FROM evidence_items
  UNION ALL SELECT id, unnest(evidence_refs), 'cites' FROM standard_items) WHERE source IS NOT NULL AND target IS NOT NULL),
  n AS (SELECT concat_ws('#', job_id, CAST(page AS VARCHAR)) AS i FROM s UNION SELECT span_id FROM s UNION SELECT evidence_id FROM evidence_items WHERE evidence_id IS NOT NULL UNION SELECT id FROM standard_items WHERE id IS NOT NULL)
  SELECT source, target, edge_type FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE i = source) OR NOT EXISTS (SELECT 1 FROM n WHERE i = target)""")
def graph_unresolved(spark, d):
    nodes, edges = graph.nodes_and_edges(table(spark, d, "text_spans"), table(spark, d, "evidence_items"), table(spark, d, "standard_items"))
    return graph.unresolved_edges(nodes, edges)


@query("""WITH e AS (SELECT DISTINCT unnest(source_node_ids) AS source, evidence_id AS target FROM evidence_items)
  SELECT source, target, CAST(rn AS INT) AS edge_no FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS rn FROM e WHERE source IS NOT NULL AND target IS NOT NULL) WHERE rn <= 8""")
def graph_neighbours(spark, d):
    ev = table(spark, d, "evidence_items").select(F.explode("source_node_ids").alias("source"), F.col("evidence_id").alias("target"), F.lit("supports").alias("edge_type"))
    return graph.neighbours(ev.where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()).select("source", "target", "edge_no")


@query("""WITH m AS (SELECT unnest(source_node_ids) AS span_id, 'evidence' AS t, evidence_id AS i FROM evidence_items UNION ALL SELECT unnest(source_ids), 'item', id FROM standard_items),
  c AS (SELECT span_id, count(*) AS n, count(DISTINCT t) AS k FROM (SELECT DISTINCT * FROM m) GROUP BY 1)
  SELECT s.span_id, coalesce(n, 0) AS n_mappings, CASE WHEN k > 1 THEN 'conflict' WHEN k = 1 THEN 'extracted' ELSE 'unknown' END AS status FROM (SELECT DISTINCT span_id FROM text_spans) s LEFT JOIN c USING (span_id)""")
def coverage_map(spark, d):
    m = (
        table(spark, d, "evidence_items").select(F.explode("source_node_ids").alias("span_id"), F.lit("evidence").alias("target_type"), F.col("evidence_id").alias("target_id"))
        .unionAll(table(spark, d, "standard_items").select(F.explode("source_ids"), F.lit("item"), F.col("id")))
        .distinct()
    )
    return graph.coverage(table(spark, d, "text_spans"), m)


@query("""SELECT r_name, n_name, o_orderpriority, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, CAST(sum(l_linenumber) AS BIGINT) AS sum_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def star_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")  # small dimensions: the planner broadcasts by their size
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return j.groupBy("r_name", "n_name", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("o_orderkey").alias("n_orders"), F.sum("l_linenumber").alias("sum_lines")
    )


# -- proposals, scores, discovery, multisets


@query(rf"""WITH {_FIRST_ITEMS}, ev AS (SELECT evidence_id, min(source_text) AS t FROM evidence_items WHERE evidence_id IS NOT NULL GROUP BY 1),
  named AS (SELECT id, text, unnest(evidence_refs) AS sid, generate_subscripts(evidence_refs, 1) AS n FROM first_items),
  met AS (SELECT f.id, f.text, count(m.sid) AS n_named, count(*) FILTER (m.sid IS NOT NULL AND e.t IS NULL) AS n_unknown, string_agg(e.t, '' ORDER BY m.n) AS whole
    FROM first_items f LEFT JOIN named m ON m.id = f.id LEFT JOIN ev e ON e.evidence_id = m.sid GROUP BY 1, 2)
  SELECT id AS item_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_text' WHEN n_named = 0 THEN 'no_source' WHEN n_unknown > 0 THEN 'unknown_source'
    WHEN NOT contains(lower(regexp_replace(coalesce(whole, ''), '[\s\p{{P}}\p{{S}}]+', '', 'g')), lower(regexp_replace(text, '[\s\p{{P}}\p{{S}}]+', '', 'g'))) THEN 'not_in_source' ELSE 'kept' END AS result FROM met""")
def grounded_items(spark, d):
    items = sequences.keep_best(table(spark, d, "standard_items").where(F.col("id").isNotNull()), ["id"], [F.col("ingested_at"), F.col("text")])
    sources = table(spark, d, "evidence_items").where(F.col("evidence_id").isNotNull()).groupBy(F.col("evidence_id").alias("source_id")).agg(F.min("source_text").alias("text"))
    kept, rejected = grounding.grounded(items.select(F.col("id").alias("item_id"), "text", F.col("evidence_refs").alias("source_ids")), sources)
    return kept.select("item_id", F.lit("kept").alias("result")).unionAll(rejected.select("item_id", "reason"))


@query("""WITH i AS (SELECT DISTINCT job_id, id, unnest(source_ids) AS x FROM standard_items), v AS (SELECT DISTINCT job_id, evidence_id, unnest(source_node_ids) AS x FROM evidence_items),
  ni AS (SELECT job_id, id, count(DISTINCT x) AS n FROM i GROUP BY 1, 2), nv AS (SELECT job_id, evidence_id, count(DISTINCT x) AS n FROM v GROUP BY 1, 2)
  SELECT job_id, id, evidence_id, n_common FROM (SELECT i.job_id, i.id, v.evidence_id, count(*) AS n_common FROM i JOIN v ON i.job_id = v.job_id AND i.x = v.x GROUP BY 1, 2, 3)
  JOIN ni USING (job_id, id) JOIN nv USING (job_id, evidence_id) WHERE n_common >= least(ni.n, nv.n) * 0.5""")
def overlapping_sources(spark, d):
    """Items and evidence of a job that share half of the smaller set of sources."""
    one = lambda t, key, ids: table(spark, d, t).select("job_id", key, F.explode(ids).alias("x")).where(F.col("x").isNotNull()).groupBy("job_id", key).agg(F.collect_set("x").alias(ids))
    return grounding.overlapping_sets(one("standard_items", "id", "source_ids"), one("evidence_items", "evidence_id", "source_node_ids"), ["job_id"], "id", "source_ids", "evidence_id", "source_node_ids", 0.5)


@query("""SELECT job_id, CAST(sum(CASE WHEN text_similarity < 0.8 THEN 100 WHEN text_similarity < 0.95 THEN 10 WHEN text_relation <> 'equivalent' THEN 1 ELSE 0 END) AS BIGINT) AS score
  FROM (SELECT DISTINCT job_id, alignment_id, text_similarity, text_relation FROM source_alignments) GROUP BY 1""")
def finding_scores(spark, d):
    a = table(spark, d, "source_alignments").select("job_id", "alignment_id", "text_similarity", "text_relation").distinct()
    level = F.when(F.col("text_similarity") < 0.8, "high").when(F.col("text_similarity") < 0.95, "medium").when(F.col("text_relation") != "equivalent", "low").otherwise("info")
    return metrics.weighted_findings(a.withColumn("level", level), ["job_id"], "level")


_PATTERNS = {"product.name": "产品名称|Product", "product.net_content": "净含量|Net Wt", "product.shelf_life": "保质期", "product.storage_condition": "贮存条件|Storage", "product.origin": "产地|Origin"}


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT job_id, ord, span_id, '{k}' AS semantic_key FROM text_spans WHERE regexp_matches(text, '{p}')" for k, p in _PATTERNS.items())
       + ") SELECT job_id, semantic_key, span_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY job_id, semantic_key ORDER BY ord, span_id) AS rn FROM h) WHERE rn = 1")
def schema_discovery(spark, d):
    """The first span of each job that shows a field: the fields that the document has."""
    return layout.first_matches(table(spark, d, "text_spans"), ["job_id"], "ord", "text", _PATTERNS)


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '(?m)^[\s\x0b]*#{1,6}[\s\x0b]+', '', 'g'), '\*\*|__|`', '', 'g'), '\\geq?\b', '≥', 'g'), '\\leq?\b', '≤', 'g'), '\%', '%'), '[\s\x0b]+', ' ', 'g'), ' ')) AS clean_hash
  FROM documents WHERE text IS NOT NULL""")
def markup_strip(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.sha2(tx.without_markup(F.col("text")), 256).alias("clean_hash"))


@query("""SELECT label, count(*) AS n FROM (SELECT label_item AS label FROM main_labels WHERE label_item IS NOT NULL INTERSECT ALL SELECT label FROM standard_items WHERE label IS NOT NULL) GROUP BY 1""")
def label_intersect_all(spark, d):
    a = table(spark, d, "main_labels").where(F.col("label_item").isNotNull()).select(F.col("label_item").alias("label"))
    b = table(spark, d, "standard_items").where(F.col("label").isNotNull()).select("label")
    return a.intersectAll(b).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS starts, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("starts"), "event_type", "n", "n_users")


@query(r"""SELECT DISTINCT file_name, lower(regexp_replace(regexp_replace(file_name, '[^0-9A-Za-z一-鿿]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM text_spans WHERE file_name IS NOT NULL""")
def file_slugs(spark, d):
    return table(spark, d, "text_spans").where(F.col("file_name").isNotNull()).select("file_name", tx.slug(F.col("file_name")).alias("slug")).distinct()


_SEGMENT_LABELS = ["产品名称", "净含量", "保质期", "贮存条件", "产地", "配料", "规格", "商标", "警示语", "食用方法", "营养成分", "质量等级", "Product", "Net Wt.", "Storage", "Origin", "Energy"]
_ANY_LABEL = "|".join(x.replace(".", "[.]") for x in sorted(_SEGMENT_LABELS, key=len, reverse=True))


@query(f"""WITH ev AS (SELECT evidence_id, min(source_text) AS text FROM evidence_items WHERE evidence_id IS NOT NULL GROUP BY 1),
  p AS (SELECT evidence_id, list_filter(string_split(regexp_replace(text, '({_ANY_LABEL})\\s*[:：]', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda x: contains(x, chr(2))) AS ps FROM ev)
  SELECT evidence_id, CAST(n AS INT) AS segment_no, split_part(x, chr(2), 1) AS label, trim(split_part(x, chr(2), 2), ' ') AS value FROM (SELECT evidence_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS n FROM p)""")
def label_segments(spark, d):
    """Lines of evidence cut at every known label."""
    ev = table(spark, d, "evidence_items").where(F.col("evidence_id").isNotNull()).groupBy("evidence_id").agg(F.min("source_text").alias("text"))
    return layout.label_segments(ev, ["evidence_id"], "text", _SEGMENT_LABELS)


@query("""WITH RECURSIVE s AS (SELECT DISTINCT job_id, page, span_id, bbox_pdf.x AS x, bbox_pdf.y AS y FROM text_spans WHERE bbox_pdf IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY job_id, page ORDER BY y, x, span_id) AS rn FROM s),
  r AS (SELECT job_id, page, span_id, rn, 1 AS row_no, y AS top FROM o WHERE rn = 1
    UNION ALL SELECT o.job_id, o.page, o.span_id, o.rn, CASE WHEN abs(o.y - top) <= 6 THEN row_no ELSE row_no + 1 END, CASE WHEN abs(o.y - top) <= 6 THEN top ELSE o.y END
    FROM r JOIN o ON o.job_id IS NOT DISTINCT FROM r.job_id AND o.page IS NOT DISTINCT FROM r.page AND o.rn = r.rn + 1)
  SELECT span_id, row_no FROM r""")
def visual_rows(spark, d):
    """Spans of a page gathered to rows by the first span of each."""
    s = table(spark, d, "text_spans").where(F.col("bbox_pdf").isNotNull()).select("job_id", "page", "span_id", F.col("bbox_pdf.x").alias("x"), F.col("bbox_pdf.y").alias("y")).distinct()
    return layout.rows_by_first(s, ["job_id", "page"], 6.0).select("span_id", "row_no")
