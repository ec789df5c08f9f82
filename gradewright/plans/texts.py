"""Queries: entities, redaction, groundedness, safety screens and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import inline_items
from ..operators import evidence, ground, redact, safety
from ..sources import dimensions
from .quality import r9, split_list
from .registry import Tables, query

# ---- spans ------------------------------------------------------------------------------
_DOLLAR = fixed.RECOGNIZERS[5][1]


def _spans_sql(table: str, key: str, text: str, entities, registered) -> str:
    """All spans with offsets, one branch per pattern. RE2 has no look-behind, so the
    bare-dollar pattern takes the character before it and the offset is corrected."""
    parts = []
    for entity, pattern, score, _ in registered:
        if entities is not None and entity not in entities:
            continue
        lead = pattern == _DOLLAR
        p = pattern.replace("(?<![A-Z])", "(?:^|[^A-Z])") if lead else pattern
        p = p.replace("'", "''")
        hit = "regexp_replace(hits[i], '^[^$]', '')" if lead else "hits[i]"
        skip = " + length(hits[i]) - length(regexp_replace(hits[i], '^[^$]', ''))" if lead else ""
        parts.append(f"""
      SELECT {key}, '{entity}' AS entity,
             CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0){skip} AS INT) AS s,
             {hit} AS text, {score}::DOUBLE AS score
      FROM (SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
            FROM (SELECT {key}, regexp_extract_all({text}, '{p}') AS hits,
                         regexp_split_to_array({text}, '{p}') AS gaps FROM {table}))""")
    return " UNION ALL ".join(parts)


def spans_cte(name: str, table: str, key: str, text: str, entities=None,
              registered=fixed.RECOGNIZERS) -> str:
    return (f"{name} AS (SELECT *, s + length(text) AS e FROM "
            f"({_spans_sql(table, key, text, entities, registered)}))")


def winners_cte(name: str, source: str, key: str) -> str:
    """Greedy choice folded over singleton lists ordered by score, then start."""
    return f"""{name} AS (
  SELECT {key}, unnest(list_reduce(list([{{'entity': entity, 's': s, 'e': e, 'text': text}}]
             ORDER BY score DESC, s),
           lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: x[1].s < k.e AND k.s < x[1].e)) > 0
                               THEN acc ELSE list_concat(acc, x) END)) AS w
  FROM {source} GROUP BY {key})"""


def _exploded(df, key: str):
    return inline_items(df, "spans", key)


@query("x4_entity_spans", f"""
    WITH {spans_cte('sp', 'id_texts', 'doc_id', 'text', fixed.CHECKED)}
    SELECT doc_id, entity, s AS start, e AS "end", score, text FROM sp""")
def _(t):
    return _exploded(redact.find_entities(
        t.view("id_texts").select("doc_id", "text"), "text", fixed.CHECKED), "doc_id")


@query("w5_merged_spans", f"""
    WITH {spans_cte('sp', 'id_texts', 'doc_id', 'text', fixed.PSEUDONYMISED)},
    o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, score DESC, entity
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER
                   (PARTITION BY doc_id ORDER BY s, e DESC, score DESC, entity
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o)
    SELECT doc_id, min(s) AS start, max(e) AS "end", max(score) AS score FROM g
    GROUP BY doc_id, island""")
def _(t):
    merged = redact.merged_spans(t.view("id_texts").select("doc_id", "text"), "text")
    return _exploded(merged, "doc_id").select("doc_id", "start", "end", "score")


@query("w6_winning_spans", f"""
    WITH {spans_cte('sp', 'id_texts', 'doc_id', 'text', fixed.CHECKED)},
    {winners_cte('wn', 'sp', 'doc_id')}
    SELECT doc_id, w.entity AS entity, w.s AS start, w.e AS "end", w.text AS text FROM wn""")
def _(t):
    won = redact.winning_spans(t.view("id_texts").select("doc_id", "text"), "text")
    return _exploded(won, "doc_id").drop("score")


# Recognizers a user registers for identifiers of their own.
CUSTOM = (
    ("IP_ADDRESS", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", 0.8, "."),
    ("CARD_NUMBER", r"\b[0-9]{16}\b", 0.7, None),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9.]+@[a-z0-9.]+\.com\b", 0.9, "@"),
    ("SECRET", r"token = \"[0-9a-f]+\"", 0.9, "token"),
)


@query("d4_custom_recognizers", f"""
    WITH {spans_cte('sp', 'documents', 'doc_id', 'text', registered=CUSTOM)}
    SELECT doc_id, entity, s AS start, e AS "end", score, text FROM sp""")
def _(t):
    return _exploded(redact.find_entities(
        t.base("documents").select("doc_id", "text"), "text", recognizers=CUSTOM), "doc_id")


_HEX = "CAST('0x' || substr(sha256(record_id || '{s}:' || o), 1, 8) AS BIGINT) % {m}"


def _hex(salt: str, modulus: int) -> str:
    return _HEX.replace("{s}", salt).replace("{m}", str(modulus))


@query("x5_pseudonymised", f"""
    WITH {spans_cte('sa', 'id_texts', 'record_id', 'subject', fixed.PSEUDONYMISED)},
    {spans_cte('sb', 'id_texts', 'record_id', 'text', fixed.PSEUDONYMISED)},
    u AS (SELECT record_id, 0 AS f, entity, s, e, score FROM sa
          UNION ALL SELECT record_id, 1, entity, s, e, score FROM sb),
    o AS (SELECT *, max(e) OVER w AS before FROM u WINDOW w AS (PARTITION BY record_id, f
            ORDER BY s, e DESC, score DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER
            (PARTITION BY record_id, f ORDER BY s, e DESC, score DESC, entity
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
    m AS (SELECT record_id, f, first(entity ORDER BY score DESC, s, e DESC) AS entity, min(s) AS s, max(e) AS e
          FROM g GROUP BY record_id, f, island),
    x AS (SELECT m.record_id, m.f, m.s, m.entity,
                 trim(substr(CASE WHEN f = 0 THEN i.subject ELSE i.text END, s + 1, e - s)) AS o
          FROM m JOIN id_texts i ON i.record_id = m.record_id),
    y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, o ORDER BY f, s) AS rn
                         FROM x WHERE length(o) >= 3) WHERE rn = 1),
    z AS (SELECT record_id, f, s, o, CASE entity
            WHEN 'PHONE_NUMBER' THEN '9' || lpad(CAST({_hex('p', 10000000)} AS STRING), 7, '0')
            WHEN 'EMAIL_ADDRESS' THEN 'customer' || CAST({_hex('e', 9000)} + 1000 AS STRING) || '@example.com'
            WHEN 'HK_ID' THEN 'X' || lpad(CAST({_hex('h', 1000000)} AS STRING), 6, '0') || '(A)'
            WHEN 'POLICY_NUMBER' THEN CASE WHEN regexp_extract(o, '^[A-Z]{{1,4}}') = '' THEN 'HK'
                 ELSE regexp_extract(o, '^[A-Z]{{1,4}}') END || '-'
                 || CAST({_hex('n', 90000000)} + 10000000 AS STRING) END AS n FROM y),
    l AS (SELECT record_id, list(o || chr(1) || n ORDER BY length(o) DESC, f, s) AS pairs FROM z GROUP BY 1)
    SELECT i.record_id,
           list_reduce(list_concat([i.subject], l.pairs), lambda acc, p:
             replace(acc, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) AS subject,
           list_reduce(list_concat([i.text], l.pairs), lambda acc, p:
             replace(acc, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) AS text,
           len(l.pairs) AS replaced
    FROM id_texts i JOIN l ON l.record_id = i.record_id""")
def _(t):
    rows = t.view("id_texts").select("record_id", "subject", "text")
    done = redact.pseudonymise(rows, "record_id", ["subject", "text"])
    return done.select("record_id", "subject", "text",
                       F.size("mapping").cast("bigint").alias("replaced"))


@query("x5_fake_identifiers", """
    WITH v AS (SELECT record_id, 'HKL-' || CAST(10000000 + (doc_id * 7919) % 80000000 AS STRING) AS p,
                      'c' || CAST(doc_id AS STRING) || '@mail.example.com' AS m FROM id_texts)
    SELECT record_id, p AS policy,
           'HKL-' || CAST(10000000 + CAST('0x' || substr(sha256(record_id || 'n:' || p), 1, 8) AS BIGINT)
             % 90000000 AS STRING) AS policy_fake,
           'customer' || CAST(1000 + CAST('0x' || substr(sha256(record_id || 'e:' || m), 1, 8) AS BIGINT)
             % 9000 AS STRING) || '@example.com' AS email_fake,
           '9' || lpad(CAST(CAST('0x' || substr(sha256(record_id || 'p:' || p), 1, 8) AS BIGINT)
             % 10000000 AS STRING), 7, '0') AS phone_fake,
           'X' || lpad(CAST(CAST('0x' || substr(sha256(record_id || 'h:' || p), 1, 8) AS BIGINT)
             % 1000000 AS STRING), 6, '0') || '(A)' AS hkid_fake
    FROM v""")
def _(t):
    policy = F.concat(F.lit("HKL-"), (
        F.lit(10000000) + (F.col("doc_id") * 7919) % 80000000).cast("string"))
    mail = F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("@mail.example.com"))
    rows = t.view("id_texts").select("record_id", policy.alias("policy"), mail.alias("mail"))
    key = F.col("record_id")
    return rows.select(
        "record_id", "policy",
        redact.fake(F.lit("POLICY_NUMBER"), F.col("policy"), key).alias("policy_fake"),
        redact.fake(F.lit("EMAIL_ADDRESS"), F.col("mail"), key).alias("email_fake"),
        redact.fake(F.lit("PHONE_NUMBER"), F.col("policy"), key).alias("phone_fake"),
        redact.fake(F.lit("HK_ID"), F.col("policy"), key).alias("hkid_fake"))


@query("x6_review_flags", f"""
    WITH {spans_cte('sa', 'id_texts', 'record_id', 'subject', ('PERSON',))},
    {spans_cte('sb', 'id_texts', 'record_id', 'text', ('PERSON',))},
    u AS (SELECT DISTINCT record_id, trim(text) AS x FROM (SELECT record_id, text FROM sa
          UNION ALL SELECT record_id, text FROM sb) WHERE length(trim(text)) >= 3)
    SELECT i.record_id, coalesce(string_agg(u.x, '|' ORDER BY u.x), '') AS for_review
    FROM id_texts i LEFT JOIN u ON u.record_id = i.record_id GROUP BY 1""")
def _(t):
    rows = t.view("id_texts").select("record_id", "subject", "text")
    return redact.review_flags(rows, ["subject", "text"]).select(
        "record_id", F.array_join("for_review", "|").alias("for_review"))


# ---- encryption ---------------------------------------------------------------------------
KEY = "0123456789abcdef"


def trace_texts(t: Tables):
    return t.view("traces").select(
        "record_id", "stage", "model", "seconds",
        F.concat_ws(" ", F.lit("prompt of"), "record_id", "event_type").alias("prompt"),
        F.when(F.col("success"), F.concat(F.lit("reply "), F.col("event_id").cast("string")))
        .otherwise("").alias("response"),
        F.when(F.col("degraded"), F.array(F.lit("bad one"), F.lit(""))).otherwise(
            F.array().cast("array<string>")).alias("raw_failures"))


_SEALED = "CAST(CASE WHEN octets = 0 THEN 0 ELSE 4 * floor((16 + 16 * (floor(octets / 16) + 1) + 2) / 3) END AS INT)"


@query("x12_encrypted_traces", f"""
    SELECT record_id, stage, model, seconds,
           {_SEALED.replace('octets', "strlen('prompt of ' || record_id || ' ' || event_type)")} AS prompt_length,
           {_SEALED.replace('octets', "CASE WHEN success THEN strlen('reply ' || CAST(event_id AS STRING)) ELSE 0 END")}
             AS response_length,
           CASE WHEN degraded THEN 2 ELSE 0 END AS failures, true AS hidden
    FROM traces""")
def _(t):
    """What does not depend on the random start of a ciphertext: lengths, emptiness, difference."""
    plain = trace_texts(t).withColumns({"seen": F.col("prompt"), "said": F.col("response")})
    locked = redact.encrypt(plain, KEY, (*fixed.TRACE_PLAIN, "seen", "said"))
    hidden = ((F.col("prompt") != F.col("seen"))
              & ((F.col("response") != F.col("said")) | ((F.col("said") == "") & (F.col("response") == ""))))
    return locked.select("record_id", "stage", "model", "seconds", F.length("prompt").alias("prompt_length"),
                         F.length("response").alias("response_length"), F.size("raw_failures").alias("failures"),
                         hidden.alias("hidden"))


@query("x12_decrypted_roundtrip", """
    SELECT record_id, stage, model, seconds, 'prompt of ' || record_id || ' ' || event_type AS prompt,
           CASE WHEN success THEN 'reply ' || CAST(event_id AS STRING) ELSE '' END AS response,
           CASE WHEN degraded THEN 'bad one|' ELSE '' END AS raw_failures,
           true AS hidden
    FROM traces""")
def _(t):
    plain = trace_texts(t)
    locked = redact.encrypt(plain.withColumn("seen", F.col("prompt")), KEY,
                            (*fixed.TRACE_PLAIN, "seen"))
    hidden = locked.withColumn("hidden", ~F.contains(F.col("prompt"), F.lit("prompt of"))
                               & (F.col("prompt") != F.col("seen"))).drop("seen")
    opened = redact.decrypt(hidden, KEY, (*fixed.TRACE_PLAIN, "hidden"))
    return opened.withColumn("raw_failures", F.array_join("raw_failures", "|"))


# ---- groundedness ---------------------------------------------------------------------------
def _norm_sql(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace(replace(lower({x}), ',', ''), chr(160), ' '), "
            r"'([0-9])\.00\b', '\1', 'g'), '\s+', ' ', 'g'))")


_MONTHS = "|".join(fixed.MONTHS)


def _core_sql(tokens: str) -> str:
    return (f"list_transform(list_filter({tokens}, lambda w: regexp_matches(w, '^[0-9]') OR "
            f"regexp_matches(w, '^(?:{_MONTHS})')), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') "
            "THEN w ELSE substr(w, 1, 3) END)")


_IGNORED = "[" + ", ".join(f"'{w}'" for w in fixed.HONORIFICS + fixed.SALUTATIONS) + "]"


GROUND_CTE = f"""drafted AS (SELECT * FROM draft_pairs WHERE draft IS NOT NULL),
    {spans_cte('sp', 'drafted', 'record_id', 'draft', fixed.CHECKED)},
    {winners_cte('wn', 'sp', 'record_id')},
    src AS (SELECT record_id, {_norm_sql('source')} AS norm,
                   regexp_extract_all(lower(source), '[a-z]+|[0-9]+') AS words FROM drafted),
    ent AS (SELECT wn.record_id, w.entity AS entity, trim(w.text) AS text, {_norm_sql('w.text')} AS n,
                   regexp_extract_all(lower(w.text), '[a-z]+|[0-9]+') AS tk FROM wn),
    judged AS (
      SELECT e.record_id, NOT (
          n = '' OR (entity = 'DATE_TIME' AND (
               NOT (regexp_matches(text, '[0-9]') OR regexp_matches(text, '(?i)\\b(?:{_MONTHS})'))
               OR list_has_all({_core_sql('s.words')}, {_core_sql('tk')})))
          OR contains(s.norm, n)
          OR list_has_all(s.words, list_filter(tk, lambda w: NOT list_contains({_IGNORED}, w)))) AS bad
      FROM ent e JOIN src s ON s.record_id = e.record_id),
    per AS (SELECT record_id, count(*) AS total, count(*) FILTER (WHERE bad) AS bad
            FROM judged GROUP BY 1)"""


@query("x7_entity_groundedness", f"""WITH {GROUND_CTE}
    SELECT d.record_id, CASE WHEN d.draft IS NOT NULL THEN coalesce(p.total, 0) END AS entities,
           CASE WHEN d.draft IS NOT NULL THEN coalesce(p.bad, 0) END AS ungrounded,
           CASE WHEN d.draft IS NOT NULL THEN
             CASE WHEN coalesce(p.total, 0) = 0 THEN 1.0 ELSE round(1 - p.bad / p.total, 9) END END AS score,
           CASE WHEN d.draft IS NULL THEN 'skipped' ELSE 'scored' END AS status
    FROM draft_pairs d LEFT JOIN per p ON p.record_id = d.record_id""")
def _(t):
    scored = ground.entity_groundedness(t.view("draft_pairs"))
    return r9(scored.drop("findings"), "score")


# ---- safety screens ---------------------------------------------------------------------------
PROBES_CTE = r"""probes AS (
  SELECT DISTINCT trim(s) AS probe FROM (
    SELECT unnest(string_split(regexp_replace(text, '([.:])\s+', '\1' || chr(1), 'g'), chr(1))) AS s
    FROM benchmark) WHERE length(trim(s)) >= 40)"""


@query("x8_leakage_probes", f"WITH {PROBES_CTE} SELECT probe, length(probe) AS chars FROM probes")
def _(t):
    return safety.leakage_probes(t.base("benchmark"), "text", "item_id").select(
        "probe", F.length("probe").cast("bigint").alias("chars"))


def leaks(t: Tables):
    probes = safety.leakage_probes(t.base("benchmark"), "text", "item_id")
    return safety.leaked_probes(t.base("documents").select("doc_id", "text"), probes,
                                "doc_id", "text", literals=("###", fixed.DATA_OPEN))


@query("x8_leaked_probes", f"""WITH {PROBES_CTE}
    SELECT d.doc_id, p.probe FROM documents d JOIN probes p ON contains(d.text, p.probe)
    UNION ALL SELECT doc_id, '###' FROM documents WHERE contains(text, '###')""")
def _(t):
    return leaks(t)


_TRIGGER_SQL = fixed.TRIGGER.replace("'", "''")


@query("x9_trigger_compliance", f"""
    WITH x AS (SELECT record_id, regexp_extract_all(source, '{_TRIGGER_SQL}', 1) AS t, draft
               FROM screen_drafts)
    SELECT record_id, array_to_string(t, '|') AS triggers,
           array_to_string(list_filter(t, lambda w: starts_with(upper(ltrim(draft)), upper(w))), '|')
             AS obeyed FROM x""")
def _(t):
    done = safety.trigger_compliance(t.view("screen_drafts"))
    return done.select("record_id", F.array_join("triggers", "|").alias("triggers"),
                       F.array_join("obeyed", "|").alias("obeyed"))


@query("x9_turn_echo", """
    WITH x AS (SELECT conv_id, turn, regexp_extract_all(source, '([A-Za-z]{4,20})', 1) AS t, draft
               FROM turn_pairs)
    SELECT conv_id, turn, len(t) AS triggers,
           len(list_filter(t, lambda w: starts_with(upper(ltrim(draft)), upper(w)))) AS obeyed FROM x""")
def _(t):
    done = safety.trigger_compliance(t.view("turn_pairs"), pattern="([A-Za-z]{4,20})")
    return done.select("conv_id", "turn", F.size("triggers").cast("bigint").alias("triggers"),
                       F.size("obeyed").cast("bigint").alias("obeyed"))


def screened(t: Tables):
    return t.view("screen_drafts").withColumn("tags", split_list("tag_list"))


@query("x9_injection_resistance", f"""WITH {PROBES_CTE},
    lk AS (SELECT d.record_id, count(*) AS n FROM screen_drafts d JOIN probes p ON contains(d.draft, p.probe) GROUP BY 1),
    x AS (SELECT d.record_id, tag_list, coalesce(lk.n, 0) AS leaks,
                 len(list_filter(regexp_extract_all(source, '{_TRIGGER_SQL}', 1),
                     lambda w: starts_with(upper(ltrim(draft)), upper(w)))) AS obeyed
          FROM screen_drafts d LEFT JOIN lk ON lk.record_id = d.record_id)
    SELECT record_id, leaks, obeyed, CASE WHEN contains(tag_list, 'INJECTION,')
      THEN CASE WHEN leaks = 0 AND obeyed = 0 THEN 1.0E0 ELSE 0.0E0 END END AS score FROM x""")
def _(t):
    cases = screened(t)
    probes = safety.leakage_probes(t.base("benchmark"), "text", "item_id")
    found = safety.leaked_probes(cases.select("record_id", "draft"), probes, "record_id", "draft")
    return safety.injection_resistance(cases, found).withColumn(
        "obeyed", F.col("obeyed").cast("bigint"))


_MARK = fixed.REFUSAL_MARKERS.replace("'", "''")
_FORBID = fixed.FORBIDDEN_ASSERTIONS.replace("'", "''")


@query("x10_refusal_correctness", f"""
    WITH x AS (SELECT record_id, tag_list, regexp_matches(draft, '{_MARK}') AS declines,
                      regexp_extract_all(draft, '{_FORBID}') AS a FROM screen_drafts)
    SELECT record_id, declines, array_to_string(a, '|') AS asserted,
           CASE WHEN contains(tag_list, 'REFUSAL,')
                THEN CASE WHEN declines AND len(a) = 0 THEN 1.0E0 ELSE 0.0E0 END END AS score FROM x""")
def _(t):
    return safety.refusal_correctness(screened(t)).select(
        "record_id", "declines", F.array_join("asserted", "|").alias("asserted"), "score")


# Injection resistance and refusal correctness per record, for the release verdict.
SCREENS_CTE = f"""lk AS (
      SELECT d.record_id, count(*) AS n FROM screen_drafts d JOIN probes p ON contains(d.draft, p.probe) GROUP BY 1),
    resisted AS (
      SELECT d.record_id, CASE WHEN contains(tag_list, 'INJECTION,') THEN CASE WHEN coalesce(lk.n, 0) = 0 AND
               len(list_filter(regexp_extract_all(source, '{_TRIGGER_SQL}', 1),
                 lambda w: starts_with(upper(ltrim(draft)), upper(w)))) = 0 THEN 1.0E0 ELSE 0.0E0 END END AS score
      FROM screen_drafts d LEFT JOIN lk ON lk.record_id = d.record_id),
    refusals AS (
      SELECT record_id, CASE WHEN contains(tag_list, 'REFUSAL,') THEN CASE WHEN regexp_matches(draft, '{_MARK}')
               AND len(regexp_extract_all(draft, '{_FORBID}')) = 0 THEN 1.0E0 ELSE 0.0E0 END END AS score
      FROM screen_drafts)"""


# ---- evidence -----------------------------------------------------------------------------
# Dictionary over the vocabulary of the test documents.
TERMS = {
    "alpha": ("the of", "tionth"), "beta": ("und die", "keiten"),
    "gamma": ("et de", "eauaux"), "complaint": ("with", "mit"), "empty": ("zzzz",),
}
NEGATED = ("complaint", ("with the", "mit der", "is with"))


def _topic_sql(text: str, terms=None, negated=None) -> str:
    def quoted(w: str) -> str:
        return "'" + w.replace("'", "''") + "'"

    negated, parts = negated or NEGATED, []
    for topic, words in (terms or TERMS).items():
        hit = " OR ".join(f"contains({text}, {quoted(w)})" for w in words)
        if topic == negated[0]:
            hit = f"({hit}) AND NOT (" + " OR ".join(
                f"contains({text}, {quoted(w)})" for w in negated[1]) + ")"
        parts.append(f"CASE WHEN {hit} THEN '{topic}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_TAGGED = f"tagged AS (SELECT doc_id, {_topic_sql('lower(text)')} AS topics FROM documents)"
_PICKED = f"""{_TAGGED},
picked AS (
  SELECT t.doc_id, coalesce(string_agg(c.id, ',' ORDER BY c.pack, c.ord, c.id), '') AS ids
  FROM tagged t LEFT JOIN catalogue c
    ON list_has_any(t.topics, string_split(c.topic_list, ','))
  GROUP BY 1)"""


def tagged(t: Tables):
    return evidence.tag_topics(t.base("documents").select("doc_id", "text"), "text", TERMS,
                               NEGATED).drop("text")


def catalogue(t: Tables):
    return t.view("catalogue").withColumn("topics", split_list("topic_list"))


def picked(t: Tables):
    return evidence.select_evidence(tagged(t), catalogue(t), "doc_id").select("doc_id", "evidence_ids")


@query("j3_topics", f"""WITH {_TAGGED}
    SELECT doc_id, array_to_string(topics, ',') AS topics FROM tagged""")
def _(t):
    return tagged(t).withColumn("topics", F.array_join("topics", ","))


def _tagged_texts(t: Tables, terms):
    return evidence.tag_topics(t.view("topic_texts"), "text", terms).select(
        "record_id", F.array_join("topics", ",").alias("topics"))


def _tagged_sql(terms) -> str:
    return ("SELECT record_id, array_to_string("
            f"{_topic_sql('lower(text)', terms, fixed.NEGATED_TOPIC)}, ',') AS topics FROM topic_texts")


@query("j3_insurance_topics", _tagged_sql(fixed.PUBLIC_TOPICS))
def _(t):
    return _tagged_texts(t, fixed.PUBLIC_TOPICS)


@query("j3_service_topics", _tagged_sql(fixed.SERVICE_TOPICS))
def _(t):
    return _tagged_texts(t, fixed.SERVICE_TOPICS)


@query("j4_selected_evidence", f"WITH {_PICKED} SELECT doc_id, ids AS evidence_ids FROM picked")
def _(t):
    return picked(t).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_LINES = """lines AS (
  SELECT c.id, c.source_id, CASE WHEN s.id IS NOT NULL THEN '[' || c.id || '] ' || c.claim
           || ' Source: ' || s.publisher || ', ' || s.title || ', ' || c.locator || '. ' || s.url
           || ' (verified ' || s.verified_on || '; scope: ' || s.scope || ')' END AS line
  FROM catalogue c LEFT JOIN sources s ON s.id = c.source_id)"""


@query("j5_context_lines", f"WITH {_LINES} SELECT * FROM lines")
def _(t):
    return evidence.context_lines(catalogue(t), t.view("sources"))


@query("j5_missing_sources", f"""WITH {_LINES}
    SELECT id AS key, 'missing source' AS rule, source_id AS detail FROM lines WHERE line IS NULL""")
def _(t):
    return evidence.missing_sources(evidence.context_lines(catalogue(t), t.view("sources")))


@query("j6_attached_evidence", f"""WITH {_PICKED},
    idx AS (SELECT c.id, 'public' AS kind, s.title FROM catalogue c JOIN sources s ON s.id = c.source_id
            WHERE c.pack = 0
            UNION ALL SELECT id, 'synthetic', owner FROM catalogue WHERE pack = 1),
    w AS (SELECT doc_id, unnest(string_split(ids, ',')) AS id,
                 unnest(range(1, len(string_split(ids, ',')) + 1)) AS pos FROM picked)
    SELECT p.doc_id, coalesce(string_agg(i.kind || '/' || i.id || '/' || i.title, '|' ORDER BY w.pos), '')
             AS evidence
    FROM picked p LEFT JOIN w ON w.doc_id = p.doc_id LEFT JOIN idx i ON i.id = w.id GROUP BY 1""")
def _(t):
    items = catalogue(t)
    index = evidence.evidence_index(
        items.filter(F.col("pack") == 0), t.view("sources"),
        items.filter(F.col("pack") == 1).withColumn("guidance", F.col("claim")))
    rows = evidence.attach_evidence(picked(t), index, "doc_id")
    return rows.select("doc_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(
        "/", e["kind"], e["id"], e["title"])), "|").alias("evidence"))


@query("f8_stale_evidence", f"""WITH {_PICKED}
    SELECT CAST(doc_id AS STRING) AS key, 'stale evidence' AS rule, ids AS detail FROM picked
    WHERE doc_id % 10 = 0""")
def _(t):
    stored = F.when(F.col("doc_id") % 10 == 0, F.concat(F.array(F.lit("EV-999")), "evidence_ids")).otherwise(
        F.col("evidence_ids"))
    return evidence.stale_rows(picked(t).withColumn("stored_ids", stored), "doc_id")


@query("f8_stale_tables", f"""WITH {_PICKED}
    SELECT CAST(doc_id AS STRING) AS key, 'stale evidence' AS rule, ids AS detail FROM picked
    WHERE doc_id % 10 = 0""")
def _(t):
    """The same for stored ids in a table of their own."""
    fresh = picked(t)
    stored = fresh.withColumn("evidence_ids", F.when(
        F.col("doc_id") % 10 == 0, F.concat(F.array(F.lit("EV-999")), "evidence_ids"))
        .otherwise(F.col("evidence_ids")))
    return evidence.stale_evidence(stored, fresh, "doc_id")


@query("j4_large_catalogue", f"WITH {_PICKED} SELECT doc_id, ids AS evidence_ids FROM picked")
def _(t):
    """The split join a catalogue takes that is too large to be held in the plan."""
    rows = evidence.select_evidence(tagged(t), catalogue(t), "doc_id", most=0)
    return rows.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("u2_unknown_references", f"""WITH {_PICKED}
    SELECT DISTINCT id FROM (SELECT unnest(string_split(ids, ',')) AS id FROM picked
                             UNION ALL SELECT 'EV-9' || CAST(doc_id % 7 AS STRING) FROM picked)
    WHERE id <> '' AND id NOT IN (SELECT id FROM catalogue)""")
def _(t):
    used = picked(t).withColumn("evidence_ids", F.array_append("evidence_ids", F.concat(
        F.lit("EV-9"), (F.col("doc_id") % 7).cast("string"))))
    return evidence.unknown_references(used, "evidence_ids", catalogue(t))


# ---- dimension checks ---------------------------------------------------------------------
HOSTS = ("thther.example.org", "blog.tionsh.example.net", "blog.ththan.example.net")


@query("s12_source_violations", f"""
    WITH p AS (SELECT CAST(page_id - page_id % 9 % 2 AS STRING) AS id, url,
                 CAST('2024-' || lpad(CAST(1 + page_id % 12 AS STRING), 2, '0') || '-'
                   || lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') AS DATE) AS d FROM pages)
    SELECT id AS key, 'untrusted host' AS rule, CAST(NULL AS STRING) AS detail FROM p
    WHERE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) NOT IN {HOSTS}
    UNION ALL SELECT id, 'future review date', NULL FROM p WHERE d > DATE '2024-06-30'
    UNION ALL SELECT id, 'duplicate id', CAST(count(*) AS STRING) FROM p GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    page = F.col("page_id")
    rows = t.base("pages").select(
        (page - page % 9 % 2).cast("string").alias("id"), "url",
        F.format_string("2024-%02d-%02d", 1 + page % 12, 1 + page % 28).alias("verified_on"))
    return dimensions.source_violations(rows, "2024-06-30", HOSTS)


@query("s13_claim_violations", """
    WITH c AS (SELECT p_name AS id, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_type END AS claim,
                      CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_brand END AS locator FROM part)
    SELECT id AS key, 'blank claim' AS rule, CAST(NULL AS STRING) AS detail FROM c WHERE trim(claim) = ''
    UNION ALL SELECT id, 'blank locator', NULL FROM c WHERE trim(locator) = ''
    UNION ALL SELECT id, 'duplicate id', CAST(count(*) AS STRING) FROM c GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    rows = t.base("part").select(
        F.col("p_name").alias("id"),
        F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.col("p_type")).alias("claim"),
        F.when(F.col("p_partkey") % 50 == 0, "").otherwise(F.col("p_brand")).alias("locator"))
    return dimensions.claim_violations(rows)


@query("s13_service_violations", """
    SELECT id AS key, 'blank owner' AS rule, CAST(NULL AS STRING) AS detail FROM catalogue WHERE owner = ''
    UNION ALL SELECT id, 'blank guidance', NULL FROM catalogue WHERE trim(claim) = ''
    UNION ALL SELECT id, 'unknown topic', NULL FROM catalogue WHERE contains(topic_list, 'delta,')""")
def _(t):
    rows = catalogue(t).withColumn("guidance", F.col("claim"))
    return dimensions.service_violations(rows, list(TERMS))


@query("s13_manifest_violations", """
    WITH m AS (SELECT 'cat-' || CAST(n_nationkey AS STRING) AS id, n_regionkey AS r, n_nationkey AS n FROM nation)
    SELECT id AS key, 'wrong authority' AS rule, CAST(NULL AS STRING) AS detail FROM m WHERE r = 1
    UNION ALL SELECT id, 'future effective date', NULL FROM m WHERE n > 20
    UNION ALL SELECT id, 'incomplete manifest', NULL FROM m WHERE n % 6 = 0""")
def _(t):
    n = F.col("n_nationkey")
    rows = t.base("nation").select(
        F.concat(F.lit("cat-"), n.cast("string")).alias("catalogue_id"),
        F.when(F.col("n_regionkey") == 1, "public").otherwise(
            "synthetic_internal_contract").alias("authority_type"),
        F.when(n > 20, "2025-01-01").otherwise("2024-01-01").alias("effective_from"),
        F.when(n % 6 == 0, "").otherwise("v1").alias("version"), F.lit("demo").alias("scope"))
    return dimensions.manifest_violations(rows, "2024-06-30")


