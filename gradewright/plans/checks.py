"""Queries: dataset halves, validation rules, samples, packets and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.banding import band_of
from ..operators import agree, review, sample, validate
from ..session import shared_dir
from ..sources import fingerprint, jsonl, merge
from .quality import band_sql, gold, split_list
from .registry import Tables, query
from .views import padded

# ---- halves, merges, fingerprints ------------------------------------------------------


@query("s2_unmatched_ids", """
    SELECT CAST(d.doc_id AS STRING) AS key, 'unlabelled' AS rule, CAST(NULL AS STRING) AS detail
    FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT CAST(l.doc_id AS STRING), 'orphaned label', NULL
    FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""")
def _(t):
    return merge.unmatched(t.base("documents"), t.base("labels"), "doc_id")


@query("s2_reconciled_records", """
    SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return merge.reconcile(t.base("documents").select("doc_id", "lang", "n_chars"),
                           t.base("labels"), "doc_id")


@query("s3_open_queue_scan", r"""
    SELECT record_id, CASE WHEN k % 17 = 0 THEN 'accept' ELSE 'edit' END AS decision,
           'new ' || chr(34) || record_id || chr(34) AS reviewer_text, CAST(k AS BIGINT) AS x,
           user_id AS deep, 'say ' || chr(34) || 'hi' || chr(34) AS t FROM queue""")
def _(t):
    lines = jsonl.read_queue(t.view("queue_lines").select("value"))
    text = F.concat(F.lit('new "'), "record_id", F.lit('"'))
    raw = jsonl.merge_into_raw(F.col("raw"), {
        "decision": F.coalesce("decision", F.lit("edit")), "reviewer_text": text})
    v = F.parse_json(raw)

    def at(path: str, kind: str):
        return F.variant_get(v, path, kind)
    return lines.select(
        at("$.record_id", "string").alias("record_id"), at("$.decision", "string").alias("decision"),
        at("$.reviewer_text", "string").alias("reviewer_text"), at("$.x", "bigint").alias("x"),
        at("$.deep.a[0]", "bigint").alias("deep"), at("$.t", "string").alias("t"))


@query("s7_isolated_inputs", """
    SELECT record_id, n_chars, lang FROM gold""")
def _(t):
    return jsonl.split_halves(gold(t), ["n_chars", "lang"],
                              ["expected_type", "expected_priority", "tags"])[0]


@query("s7_isolated_answers", """
    SELECT record_id, expected_type, expected_priority, rtrim(tag_list, ',') AS tags FROM gold""")
def _(t):
    halves = jsonl.split_halves(gold(t), ["n_chars", "lang"],
                                ["expected_type", "expected_priority", "tags"])
    return halves[1].withColumn("tags", F.array_join("tags", ","))


_REGENERATED = """regenerated AS (
  SELECT p_partkey, 'new ' || p_name AS p_name, p_size + 1 AS p_size FROM part WHERE p_size % 7 = 0
  UNION ALL SELECT p_partkey + 1000000000, 'added', p_size FROM part WHERE p_size % 13 = 0)"""


@query("s8_keyed_merge", f"""WITH {_REGENERATED}
    SELECT p_partkey, p_name, p_size FROM part
    WHERE p_partkey NOT IN (SELECT p_partkey FROM regenerated)
    UNION ALL SELECT * FROM regenerated""")
def _(t):
    fresh = t.sql(f"WITH {_REGENERATED} SELECT * FROM regenerated")
    return merge.merge_by_key(t.base("part").select("p_partkey", "p_name", "p_size"), fresh,
                              ["p_partkey"])


_REWRITTEN = """rewritten AS (
  SELECT p_partkey, 'new ' || p_name AS p_name, p_size + 1 AS p_size, 1 AS turn FROM part WHERE p_size % 7 = 0
  UNION ALL SELECT p_partkey, 'newer ' || p_name, p_size + 2, 2 FROM part WHERE p_size % 14 = 0)"""


@query("s8_last_writer_wins", f"""WITH {_REWRITTEN}
    SELECT p_partkey, p_name, p_size FROM part
    WHERE p_partkey NOT IN (SELECT p_partkey FROM rewritten)
    UNION ALL SELECT p_partkey, p_name, p_size FROM (SELECT *, row_number() OVER
      (PARTITION BY p_partkey ORDER BY turn DESC) AS nth FROM rewritten) WHERE nth = 1""")
def _(t):
    fresh = t.sql(f"WITH {_REWRITTEN} SELECT * FROM rewritten")
    return merge.merge_by_key(t.base("part").select("p_partkey", "p_name", "p_size"), fresh,
                              ["p_partkey"], ["turn"])


@query("s8_provenance_upsert", """
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'gen-b' ELSE 'gen-a' END AS generator_model
    FROM part""")
def _(t):
    existing = t.base("part").select("p_partkey", F.lit("gen-a").alias("generator_model"))
    again = t.base("part").filter(F.col("p_size") % 7 == 0)
    return merge.upsert_provenance(existing, again.select("p_partkey"), "gen-b", ["p_partkey"])


_PRINT = """SELECT l_linenumber, l_returnflag, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS STRING)
      || '-' || CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS STRING) AS f
  FROM (SELECT *, sha256(concat_ws(chr(31), CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING),
      CAST(l_suppkey AS STRING))) AS h FROM {t}) GROUP BY 1, 2"""
_ALTERED = """(SELECT l_linenumber, l_returnflag, l_orderkey, l_suppkey,
    CASE WHEN l_linenumber = 3 AND l_orderkey % 50 = 0 THEN l_partkey + 1 ELSE l_partkey END AS l_partkey
  FROM lineitem WHERE NOT (l_linenumber = 7 AND l_returnflag = 'A')
  UNION ALL SELECT 8, l_returnflag, l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1)"""


def _prints(frame):
    return fingerprint.table_fingerprints(
        frame, ["l_linenumber", "l_returnflag"], ["l_orderkey", "l_partkey", "l_suppkey"])


@query("s10_table_fingerprints", f"""
    SELECT l_linenumber, l_returnflag, n, f AS fingerprint
    FROM ({_PRINT.replace('{t}', 'lineitem')})""")
def _(t):
    return _prints(t.base("lineitem"))


@query("s10_drift", f"""
    WITH a AS ({_PRINT.replace('{t}', 'lineitem')}), b AS ({_PRINT.replace('{t}', _ALTERED)})
    SELECT coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber,
           coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag,
           CASE WHEN b.f IS NULL THEN 'added' WHEN a.f IS NULL THEN 'removed'
                WHEN a.f = b.f THEN 'unchanged' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.l_linenumber = b.l_linenumber AND a.l_returnflag = b.l_returnflag""")
def _(t):
    manifest = t.sql(f"SELECT * FROM {_ALTERED} x")
    return fingerprint.drift(_prints(t.base("lineitem")), _prints(manifest),
                             ["l_linenumber", "l_returnflag"])


@query("s14_label_template", """
    SELECT g.record_id, m.metric, CAST(NULL AS INT) AS human FROM gold g
    CROSS JOIN (VALUES ('commitment groundedness'), ('tone match'), ('summary quality'),
                       ('domain correctness')) m(metric)""")
def _(t):
    return agree.label_template(t.view("gold"), tuple(fixed.RUBRIC)[:4])


# ---- record rules, quotas, duplicates -----------------------------------------------------
_RULES_CTE = """r AS (
  SELECT g.record_id, tag_list, acceptable, expected_type, expected_priority, label_note,
         CASE WHEN g.doc_id % 11 = 0 THEN ' ' ELSE g.lang END AS subject, d.text AS body,
         g.doc_id % 40 = 3 AS bait
  FROM gold g JOIN documents d ON d.doc_id = g.doc_id)"""


@query("f2_record_rules", f"""WITH {_RULES_CTE},
    v AS (
      SELECT record_id, 'malformed id' AS rule FROM r WHERE NOT regexp_matches(record_id, '^D[0-9]{{8}}[0-4]$')
      UNION ALL SELECT record_id, 'blank subject' FROM r WHERE trim(subject) = ''
      UNION ALL SELECT record_id, 'blank body' FROM r WHERE trim(body, ' ') = ''
      UNION ALL SELECT record_id, 'body too long' FROM r WHERE length(trim(body, ' ')) > 20000
      UNION ALL SELECT record_id, 'mixed topic lists no alternatives' FROM r
        WHERE contains(tag_list, 'MIXED_TOPIC') AND acceptable = ''
      UNION ALL SELECT record_id, 'ambiguity without note' FROM r WHERE acceptable <> '' AND label_note IS NULL
      UNION ALL SELECT record_id, 'mixed topic without note' FROM r
        WHERE contains(tag_list, 'MIXED_TOPIC') AND label_note IS NULL
      UNION ALL SELECT record_id, 'angry and urgent without reason' FROM r
        WHERE contains(tag_list, 'ANGRY') AND expected_priority = 'URGENT' AND label_note IS NULL
      UNION ALL SELECT record_id, 'refusal names no bait' FROM r WHERE contains(tag_list, 'REFUSAL') AND NOT bait)
    SELECT record_id AS key, rule, CAST(NULL AS STRING) AS detail FROM v""")
def _(t):
    rows = gold(t).join(t.base("documents").select("doc_id", F.col("text").alias("body")), "doc_id")
    rows = rows.withColumns({
        "subject": F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("lang")),
        "must_not_assert": F.when(F.col("doc_id") % 40 == 3, F.array(F.lit("x"))).otherwise(
            F.array().cast("array<string>"))})
    return validate.record_violations(rows, "record_id", r"^D\d{8}[0-4]$")


_QUOTA_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS key, 'quota' AS rule, 'expected " + (
        f"exactly {ex}" if ex is not None else f"at least {mi}")
    + f", found ' || count(*) FILTER (WHERE {c if c != 'tags' else 'tag_list'} "
    + (f"= '{v}'" if c != "tags" else f"LIKE '%{v}%'") + ") AS detail FROM gold HAVING count(*) FILTER (WHERE "
    + (f"{c} = '{v}'" if c != "tags" else f"tag_list LIKE '%{v}%'")
    + (f") <> {ex}" if ex is not None else f") < {mi}")
    for n, c, v, mi, ex in fixed.QUOTAS)


@query("f3_quota_check", f"""{_QUOTA_SQL}
    UNION ALL SELECT 'record count', 'quota', 'expected 40-50, found ' || count(*) FROM gold
    HAVING count(*) NOT BETWEEN 40 AND 50""")
def _(t):
    quotas = [(n, validate.gold_quota_predicate(c, v), mi, ex) for n, c, v, mi, ex in fixed.QUOTAS]
    return validate.quota_violations(gold(t), quotas, fixed.ROW_COUNT_BOUNDS)


@query("d2_custom_quotas", """
    SELECT 'urgent orders' AS key, 'quota' AS rule,
           'expected at least 999999999, found ' || count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS detail
    FROM orders
    UNION ALL SELECT 'dear orders', 'quota', 'expected exactly 0, found ' || count(*)
      FILTER (WHERE o_totalprice > 400000) FROM orders""")
def _(t):
    return validate.quota_violations(t.base("orders"), [
        ("urgent orders", "o_orderpriority = '1-URGENT'", 999_999_999, None),
        ("dear orders", F.col("o_totalprice") > 400_000, None, 0),
        ("some orders", "true", 1, None)])


@query("d3_instrument_profiles", """
    SELECT profile, r.metric, count(*) AS ratings, count(*) FILTER (WHERE human >= 9) AS top
    FROM ratings r JOIN (VALUES ('recorded', 'commitment groundedness'), ('recorded', 'tone match'),
        ('recorded', 'summary quality'), ('shadow', 'commitment groundedness'), ('shadow', 'tone match'),
        ('shadow', 'summary quality'), ('shadow', 'actionability')) p(profile, metric)
      ON p.metric = r.metric GROUP BY 1, 2""")
def _(t):
    profiles = F.filter(F.array(*[
        F.when(F.col("metric").isin(*m), F.lit(p)) for p, m in fixed.JUDGED.items()]),
        lambda x: x.isNotNull())
    return t.view("ratings").select(
        F.explode(profiles).alias("profile"), "metric",
        band_of(F.col("human"), F.col("metric")).alias("band")).groupBy("profile", "metric").agg(
        F.count(F.lit(1)).alias("ratings"), F.count_if(F.col("band") == 3).alias("top"))


@query("f5_duplicate_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return jsonl.duplicate_keys(t.base("lineitem"), ["l_orderkey", "l_linenumber"])


@query("f5_duplicate_payloads", """
    SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return validate.duplicate_payloads(t.base("documents"), "text")


@query("f6_variant_rules", """
    WITH b AS (SELECT *, split_part(variant_id, '-', 3) AS suffix, split_part(variant_id, '-', 2) AS num,
                 split_part(record_id, '-', 2) AS rec FROM band_variants),
    v AS (SELECT variant_id, 'suffix does not match' AS rule FROM b WHERE suffix <> chr(65 + expected_band)
      UNION ALL SELECT variant_id, 'id number does not match record' FROM b WHERE num <> rec
      UNION ALL SELECT variant_id, 'score range does not match band' FROM b
        WHERE score_low <> CASE expected_band WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 9 END
      UNION ALL SELECT variant_id, 'fault count does not fit band' FROM b
        WHERE CASE expected_band WHEN 3 THEN fault_count <> 0 WHEN 0 THEN fault_count < 2
                   ELSE fault_count <> 1 END)
    SELECT variant_id AS key, rule, CAST(NULL AS STRING) AS detail FROM v""")
def _(t):
    return validate.variant_violations(t.view("band_variants"))


@query("f6_balanced_sets", """
    WITH rec AS (SELECT set_name, record_id, count(*) AS n, count(DISTINCT expected_band) AS bands,
                   count(*) FILTER (WHERE expected_band = 0) AS b0, count(*) FILTER (WHERE expected_band = 1) AS b1,
                   count(*) FILTER (WHERE expected_band = 2) AS b2, count(*) FILTER (WHERE expected_band = 3) AS b3
                 FROM band_variants GROUP BY 1, 2),
    s AS (SELECT set_name, sum(n) AS n, count(*) AS records, count(*) FILTER (WHERE bands <> 4) AS part,
                 sum(b0) AS b0, sum(b1) AS b1, sum(b2) AS b2, sum(b3) AS b3 FROM rec GROUP BY 1),
    v AS (SELECT set_name, 'variant count' AS rule FROM s WHERE n <> 24
      UNION ALL SELECT set_name, 'record count' FROM s WHERE records <> 6
      UNION ALL SELECT set_name, 'bands uneven' FROM s WHERE b0 <> 6 OR b1 <> 6 OR b2 <> 6 OR b3 <> 6
      UNION ALL SELECT set_name, 'record misses a band' FROM s WHERE part > 0
      UNION ALL SELECT DISTINCT set_name, 'variant ids not unique' FROM
        (SELECT set_name FROM band_variants GROUP BY set_name, variant_id HAVING count(*) > 1)
      UNION ALL SELECT DISTINCT set_name, 'draft replies not unique' FROM
        (SELECT set_name FROM band_variants GROUP BY set_name, draft_reply HAVING count(*) > 1))
    SELECT set_name AS key, rule, CAST(NULL AS STRING) AS detail FROM v""")
def _(t):
    return validate.balanced_set_violations(t.view("band_variants"), ["set_name"])


@query("f7_boundary_sets", """
    WITH p AS (SELECT set_name, pair_id, count(*) AS n, min(target_score) AS lo, max(target_score) AS hi,
                 count(DISTINCT record_id) AS recs FROM variants GROUP BY 1, 2),
    q AS (SELECT *, n = 2 AND (lo, hi) IN ((2, 3), (5, 6), (8, 9)) AS ok FROM p),
    t AS (SELECT set_name, count(*) AS n, bool_or(false) AS x FROM variants GROUP BY 1),
    tc AS (SELECT set_name, count(*) FILTER (WHERE target_score = 2) AS t2, count(*) FILTER (WHERE target_score = 3) AS t3,
             count(*) FILTER (WHERE target_score = 5) AS t5, count(*) FILTER (WHERE target_score = 6) AS t6,
             count(*) FILTER (WHERE target_score = 8) AS t8, count(*) FILTER (WHERE target_score = 9) AS t9,
             count(*) AS n FROM variants GROUP BY 1),
    pc AS (SELECT set_name, count(*) AS pairs, count(*) FILTER (WHERE ok AND lo = 2) AS b2,
             count(*) FILTER (WHERE ok AND lo = 5) AS b5, count(*) FILTER (WHERE ok AND lo = 8) AS b8
           FROM q GROUP BY 1),
    v AS (SELECT set_name || '/' || pair_id AS key, 'not one complete boundary pair' AS rule FROM q WHERE NOT ok
      UNION ALL SELECT set_name || '/' || pair_id, 'pair spans records' FROM q WHERE recs <> 1
      UNION ALL SELECT set_name, 'variant count' FROM tc WHERE n <> 18
      UNION ALL SELECT set_name, 'pair count' FROM pc WHERE pairs <> 9
      UNION ALL SELECT set_name, 'targets uneven' FROM tc
        WHERE t2 <> 3 OR t3 <> 3 OR t5 <> 3 OR t6 <> 3 OR t8 <> 3 OR t9 <> 3
      UNION ALL SELECT set_name, 'boundaries uneven' FROM pc WHERE b2 <> 3 OR b5 <> 3 OR b8 <> 3)
    SELECT key, rule, CAST(NULL AS STRING) AS detail FROM v""")
def _(t):
    return validate.boundary_set_violations(t.view("variants"), ["set_name"])


@query("u3_shared_records", """
    SELECT DISTINCT record_id FROM variants WHERE o_custkey % 2 = 0 AND record_id IN
      (SELECT record_id FROM variants WHERE o_custkey % 2 = 1)""")
def _(t):
    rows = t.view("variants")
    return validate.shared_records(rows.filter(F.col("o_custkey") % 2 == 0),
                                   rows.filter(F.col("o_custkey") % 2 == 1))


# ---- file drift ----------------------------------------------------------------------------
_BLOCK = "'b' || CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS STRING)"
_DELIVERED = f"""delivered AS (
    SELECT {_BLOCK} AS block, c_custkey, CAST(c_custkey AS STRING) || ';' || c_name || ';' || c_mktsegment AS value
    FROM customer)"""
_REDELIVERED = f"""redelivered AS (
    SELECT block, c_custkey, CASE WHEN c_custkey % 300 = 7 THEN value || '!' ELSE value END AS value
    FROM delivered WHERE c_custkey % 500 >= 100 OR c_custkey < 100
    UNION ALL SELECT 'x' || block, c_custkey, value FROM delivered WHERE c_custkey % 1000 < 100)"""
_FILE = """SELECT block, sha256(string_agg(value, chr(10) ORDER BY c_custkey) || chr(10)) AS h FROM {t} GROUP BY 1"""


def text_files(t: Tables, name: str, ctes: str):
    """One text file per block of the named rows, written by Spark."""
    path = shared_dir(t.spark, name)
    (t.sql(f"WITH {ctes} SELECT block, c_custkey, value FROM {name}").repartition("block")
     .sortWithinPartitions("block", "c_custkey").drop("c_custkey")
     .write.partitionBy("block").text(path))
    return path


@query("s10_file_fingerprints", f"""WITH {_DELIVERED}, h AS ({_FILE.replace('{t}', 'delivered')})
    SELECT 'block=' || block AS name, CAST(1 AS BIGINT) AS n, CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS STRING)
      || '-' || CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS STRING) AS fingerprint FROM h""")
def _(t):
    return fingerprint.folder_fingerprints(t.spark, text_files(t, "delivered", _DELIVERED), "*.txt")


@query("s10_file_drift", f"""WITH {_DELIVERED}, {_REDELIVERED},
    a AS ({_FILE.replace('{t}', 'delivered')}), b AS ({_FILE.replace('{t}', 'redelivered')})
    SELECT 'block=' || coalesce(a.block, b.block) AS name,
           CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed'
                WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.block = b.block""")
def _(t):
    now = text_files(t, "delivered", _DELIVERED)
    then = text_files(t, "redelivered", f"{_DELIVERED}, {_REDELIVERED}")
    return fingerprint.drift(fingerprint.folder_fingerprints(t.spark, now, "*.txt"),
                             fingerprint.folder_fingerprints(t.spark, then, "*.txt"), ["name"])


# ---- labels, blind reviews, subsets, plans -------------------------------------------------
_LABELLED = """labelled AS (
  SELECT record_id, CASE WHEN human = 7 THEN 'charm' ELSE metric END AS metric,
         CASE WHEN human = 10 THEN 11 WHEN human = 0 THEN NULL ELSE human END AS human
  FROM ratings)"""


@query("f10_label_violations", f"""WITH {_LABELLED},
    v AS (SELECT record_id || '|' || metric AS key, 'unknown metric' AS rule, CAST(NULL AS STRING) AS detail
          FROM labelled WHERE metric = 'charm'
      UNION ALL SELECT record_id || '|' || metric, 'not an integer 0-10', NULL FROM labelled
        WHERE human NOT BETWEEN 0 AND 10
      UNION ALL SELECT record_id || '|' || metric, 'duplicate label', CAST(count(*) AS STRING)
        FROM labelled GROUP BY record_id, metric HAVING count(*) > 1)
    SELECT * FROM v""")
def _(t):
    return validate.label_violations(t.sql(f"WITH {_LABELLED} SELECT * FROM labelled"))


@query("f10_json_labels", """
    WITH j AS (SELECT json_extract_string(value, '$.record_id') || '|' || json_extract_string(value, '$.metric') AS key,
                      json_type(value, '$.human') AS kind, json_extract_string(value, '$.human') AS h FROM label_lines)
    SELECT key, 'not an integer 0-10' AS rule, CAST(NULL AS STRING) AS detail FROM j
    WHERE kind IS NULL OR kind <> 'NULL' AND (kind NOT IN ('UBIGINT', 'BIGINT') OR TRY_CAST(h AS BIGINT) NOT BETWEEN 0 AND 10)
    UNION ALL SELECT key, 'duplicate label', CAST(count(*) AS STRING) FROM j GROUP BY key HAVING count(*) > 1""")
def _(t):
    return validate.label_violations(validate.label_lines(t.view("label_lines")), kind="kind")


@query("f10_label_progress", f"""WITH {_LABELLED}
    SELECT metric, count(*) AS total, count(human) AS completed, count(*) - count(human) AS missing
    FROM labelled GROUP BY 1""")
def _(t):
    return validate.label_progress(t.sql(f"WITH {_LABELLED} SELECT * FROM labelled"), ["metric"])


@query("f10_missing_labels", f"""WITH {_LABELLED}
    SELECT record_id, metric FROM labelled WHERE human IS NULL""")
def _(t):
    return validate.missing_labels(t.sql(f"WITH {_LABELLED} SELECT * FROM labelled"))


_BLIND = f"""blind AS (
  SELECT CASE WHEN o_custkey % 71 = 0 THEN blind_id || 'x' ELSE blind_id END AS blind_id,
         CAST(noise % 12 AS INT) AS score,
         CASE WHEN noise % 31 = 0 THEN 9 ELSE {band_sql('CAST(noise % 12 AS INT)', "'actionability'")} END AS band,
         CASE WHEN noise % 41 = 0 THEN ' ' ELSE 'because' END AS reason
  FROM variants
  UNION ALL SELECT blind_id, 1, 0, 'again' FROM variants WHERE o_custkey % 83 = 0)"""


@query("f11_blind_violations", f"""WITH {_BLIND},
    c AS (SELECT blind_id, count(*) AS n FROM blind GROUP BY 1),
    j AS (SELECT coalesce(c.blind_id, k.blind_id) AS id, c.n, k.blind_id AS k
          FROM c FULL JOIN variants k ON c.blind_id = k.blind_id),
    v AS (SELECT id, 'unexpected id' AS rule FROM j WHERE k IS NULL
      UNION ALL SELECT id, 'missing id' FROM j WHERE n IS NULL
      UNION ALL SELECT id, 'duplicate id' FROM j WHERE n > 1
      UNION ALL SELECT blind_id, 'score not in 0-10' FROM blind WHERE score NOT BETWEEN 0 AND 10
      UNION ALL SELECT blind_id, 'band disagrees with score' FROM blind
        WHERE NOT coalesce(band = {band_sql('score', "'actionability'")}, false)
      UNION ALL SELECT blind_id, 'empty reason' FROM blind WHERE trim(reason) = '')
    SELECT id AS key, rule, CAST(NULL AS STRING) AS detail FROM v""")
def _(t):
    return validate.blind_violations(t.sql(f"WITH {_BLIND} SELECT * FROM blind"),
                                     t.view("variants"), "actionability")


@query("f11_preference_violations", """
    WITH p AS (SELECT CASE WHEN c_custkey % 19 = 0 THEN c_name || '?' ELSE c_name END AS record_id,
                 CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'tie' WHEN 2 THEN 'both' ELSE 'baseline' END AS preferred,
                 CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'r' END AS reason FROM customer),
    c AS (SELECT record_id, count(*) AS n FROM p GROUP BY 1),
    j AS (SELECT coalesce(c.record_id, k.c_name) AS id, c.n, k.c_name AS k
          FROM c FULL JOIN customer k ON c.record_id = k.c_name)
    SELECT id AS key, 'unexpected id' AS rule, CAST(NULL AS STRING) AS detail FROM j WHERE k IS NULL
    UNION ALL SELECT id, 'missing id', NULL FROM j WHERE n IS NULL
    UNION ALL SELECT record_id, 'unknown preference', NULL FROM p WHERE preferred = 'both'
    UNION ALL SELECT record_id, 'preference without reason', NULL FROM p
      WHERE preferred IS NOT NULL AND reason = ''""")
def _(t):
    key, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    rows = t.base("customer").select(
        F.when(key % 19 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name")).alias("record_id"),
        F.when(n == 1, "tie").when(n == 2, "both").when(n > 2, "baseline").alias("preferred"),
        F.when(key % 6 == 0, "").otherwise("r").alias("reason"))
    return validate.preference_violations(
        rows, t.base("customer").select(F.col("c_name").alias("record_id")))


@query("f13_verbatim_subset", """
    WITH s AS (SELECT d.doc_id, CASE WHEN d.doc_id % 23 = 0 THEN d.doc_id + 500000000 ELSE d.doc_id END AS id,
                 CASE WHEN d.doc_id % 9 = 0 THEN d.text || '.' ELSE d.text END AS text
               FROM documents d)
    SELECT CAST(id AS STRING) AS key, rule, CAST(NULL AS STRING) AS detail FROM (
      SELECT id, 'not in source' AS rule FROM s WHERE id <> doc_id
      UNION ALL SELECT id, 'not verbatim' FROM s WHERE id = doc_id AND doc_id % 9 = 0
      UNION ALL SELECT id, 'out of order' FROM s WHERE doc_id % 31 = 0
      UNION ALL SELECT id, 'no label' FROM s WHERE id NOT IN (SELECT doc_id FROM labels))""")
def _(t):
    key = F.col("doc_id")
    source = t.base("documents").select(key.alias("id"), "text", "lang")
    subset = t.base("documents").select(
        F.when(key % 23 == 0, key + 500_000_000).otherwise(key).alias("id"),
        F.when(key % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"),
        "lang", key.alias("ord"),
        F.when(key % 31 == 0, key + 1).otherwise(key).alias("declared"))
    return validate.subset_violations(
        subset, source, t.base("labels").select(F.col("doc_id").alias("id")), ["text", "lang"])


def plan(t: Tables):
    return t.view("plan_slots").withColumn("tags", split_list("tag_list"))


@query("f16_plan_conformance", """
    WITH x AS (SELECT min(slot) AS lo, max(slot) AS hi, count(*) AS n, count(DISTINCT slot) AS d FROM plan_slots),
    v AS (SELECT 'plan' AS key, 'slots not contiguous' AS rule, CAST(NULL AS STRING) AS detail FROM x
            WHERE lo <> 1 OR hi - lo + 1 <> d
      UNION ALL SELECT 'plan', 'slots not unique', NULL FROM x WHERE d <> n
      UNION ALL SELECT CAST(slot AS STRING), 'hard case without brief', NULL FROM plan_slots
        WHERE tag_list <> '' AND trim(note) = ''
      UNION ALL SELECT CAST(slot AS STRING), 'OTHER without brief', NULL FROM plan_slots
        WHERE case_type = 'OTHER' AND trim(note) = ''
      UNION ALL SELECT CAST(slot AS STRING), 'refusal typed OTHER', NULL FROM plan_slots
        WHERE case_type = 'OTHER' AND contains(tag_list, 'REFUSAL')
      UNION ALL SELECT CAST(slot AS STRING), 'urgent address change', NULL FROM plan_slots
        WHERE case_type = 'ADDRESS_CHANGE' AND priority = 'URGENT'
      UNION ALL SELECT note, 'brief repeated', CAST(count(*) AS STRING) FROM plan_slots
        WHERE case_type = 'OTHER' AND trim(note) <> '' GROUP BY note HAVING count(*) > 1)
    SELECT * FROM v""")
def _(t):
    return validate.plan_violations(plan(t))


@query("f16_plan_drift", """
    SELECT slot_id AS key, rule, CAST(NULL AS STRING) AS detail FROM (
      SELECT slot_id, 'type drifted' AS rule FROM plan_slots WHERE p_size % 11 = 0 AND case_type <> 'CLAIM'
      UNION ALL SELECT slot_id, 'priority drifted' FROM plan_slots WHERE p_size % 12 = 0 AND priority <> 'LOW'
      UNION ALL SELECT slot_id, 'tags drifted' FROM plan_slots WHERE p_size % 14 = 0
      UNION ALL SELECT slot_id, 'acceptable types drifted' FROM plan_slots WHERE p_size % 15 = 0)""")
def _(t):
    size = F.col("p_size")
    planned = plan(t).withColumn("acceptable_types", F.array(F.col("case_type"), F.lit("OTHER")))
    delivered = planned.select(
        "slot_id", F.when(size % 11 == 0, "CLAIM").otherwise(F.col("case_type")).alias("expected_type"),
        F.when(size % 12 == 0, "LOW").otherwise(F.col("priority")).alias("expected_priority"),
        F.when(size % 14 == 0, F.array_append("tags", F.lit("NOISY"))).otherwise(
            F.reverse("tags")).alias("tags"),
        F.when(size % 15 == 0, F.reverse("acceptable_types")).otherwise(
            F.col("acceptable_types")).alias("acceptable_types"))
    return validate.plan_drift(planned.drop("acceptable_types").withColumn(
        "acceptable_types", F.array(F.col("case_type"), F.lit("OTHER"))), delivered, "slot_id")


@query("f17_family_conflicts", """
    WITH r AS (SELECT CASE r_regionkey WHEN 0 THEN 'generator' WHEN 1 THEN 'relabeller' WHEN 2 THEN 'rater'
                 ELSE 'generator' END AS role,
                 CASE r_regionkey WHEN 0 THEN 'swift-9' WHEN 1 THEN 'deep-1' WHEN 2 THEN 'deep-9' ELSE 'other-1' END AS model
               FROM region),
    m AS (SELECT DISTINCT model FROM traces)
    SELECT role AS key, 'shares a family' AS rule, model AS detail FROM r
    WHERE role = 'generator' AND split_part(model, '-', 1) IN (SELECT split_part(model, '-', 1) FROM m)
    UNION ALL SELECT role, 'is a model under test', model FROM r
    WHERE role <> 'generator' AND model IN (SELECT model FROM m)""")
def _(t):
    k = F.col("r_regionkey")
    roles = t.base("region").select(
        F.when(k == 1, "relabeller").when(k == 2, "rater").otherwise("generator").alias("role"),
        F.when(k == 0, "swift-9").when(k == 1, "deep-1").when(k == 2, "deep-9")
        .otherwise("other-1").alias("model"))
    return validate.family_conflicts(roles, t.view("traces"))


# ---- samples, packets, review -----------------------------------------------------------------
@query("o1_first_records", """
    SELECT record_id, case_type, combination FROM outputs ORDER BY record_id, combination LIMIT 25""")
def _(t):
    return sample.first_records(t.view("outputs").select("record_id", "case_type", "combination"),
                                25, ("record_id", "combination"))


@query("w4_stratified_sample", """
    WITH r AS (SELECT record_id, expected_type, row_number() OVER
                 (PARTITION BY expected_type ORDER BY record_id) AS rn
               FROM gold WHERE NOT contains(tag_list, 'REFUSAL,'))
    SELECT record_id, expected_type FROM (SELECT * FROM r ORDER BY rn, expected_type LIMIT 15)""")
def _(t):
    return sample.stratified_sample(gold(t), 15).select("record_id", "expected_type")


_PACKET = f"""packet AS (
  SELECT *, 'BR-' || {padded('nth')} AS bid FROM (
    SELECT *, row_number() OVER (ORDER BY sha256('seed-7:' || CAST(o_orderkey AS STRING))) AS nth FROM variants))"""


def packet(t: Tables):
    rows = t.view("variants").drop("blind_id")
    return sample.blind_packet(rows, "o_orderkey", ["record_id", "o_orderpriority"],
                               ["target_score"], "seed-7", "BR")


@query("w8_blind_packet", f"""WITH {_PACKET}
    SELECT bid AS blind_id, record_id, o_orderpriority FROM packet""")
def _(t):
    return packet(t)[0]


@query("w8_blind_key", f"""WITH {_PACKET}
    SELECT bid AS blind_id, o_orderkey, target_score FROM packet""")
def _(t):
    return packet(t)[1]


@query("w8_blind_header", """
    SELECT count(*) AS n, 'seed-7' AS seed, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS STRING) || '-'
      || CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS STRING) AS fingerprint
    FROM (SELECT sha256(concat_ws(chr(31), CAST(o_orderkey AS STRING), record_id, o_orderpriority,
      CAST(target_score AS STRING))) AS h FROM variants)""")
def _(t):
    return packet(t)[2]


@query("w3_review_worklist", """
    SELECT record_id, row_number() OVER (ORDER BY record_id) AS position, count(*) OVER () AS total,
           round(floor(confidence * 1000) / 1000, 3) AS shown_confidence
    FROM queue WHERE decision IS NULL""")
def _(t):
    return review.worklist(t.view("queue")).select(
        "record_id", "position", "total", F.round("shown_confidence", 3).alias("shown_confidence"))


DECIDED_CTE = """valid AS (
  SELECT d.* FROM decisions d JOIN queue q ON q.record_id = d.record_id AND q.decision IS NULL
  WHERE d.decision IN ('accept', 'discard')
     OR d.decision = 'edit' AND d.reviewer_text IS NOT NULL AND trim(d.reviewer_text) <> trim(q.draft_reply)),
firsts AS (SELECT record_id, decision, CASE WHEN decision = 'edit' THEN reviewer_text END AS reviewer_text
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, event_id) AS rn FROM valid)
  WHERE rn = 1),
state AS (SELECT q.record_id, q.decision IS NULL AS was_open, coalesce(q.decision, f.decision) AS decision,
                 coalesce(q.reviewer_text, f.reviewer_text) AS reviewer_text
          FROM queue q LEFT JOIN firsts f ON f.record_id = q.record_id)"""


def decided(t: Tables):
    queue = t.view("queue")
    first = review.first_decisions(t.view("decisions"), queue, ("ts", "event_id"))
    return queue, review.apply_decisions(queue, first)


@query("t2_queue_state", f"""WITH {DECIDED_CTE} SELECT record_id, decision, reviewer_text FROM state""")
def _(t):
    return decided(t)[1].select("record_id", "decision", "reviewer_text")


@query("a27_review_counts", f"""WITH {DECIDED_CTE}
    SELECT coalesce(decision, 'pending') AS outcome, count(*) AS n FROM state WHERE was_open GROUP BY 1
    UNION ALL
    SELECT 'skipped', count(DISTINCT d.record_id) FROM decisions d JOIN state s ON s.record_id = d.record_id
    WHERE d.decision = 'skip' AND s.was_open AND s.decision IS NULL""")
def _(t):
    return review.review_counts(t.view("queue"), t.view("decisions"), ("ts", "event_id"))


