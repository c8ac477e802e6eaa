"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from . import sqlfn as Q
from .fixture import MAIL_TEXTS_SQL, TAB_LINES_SQL, with_ctes
from .. import schema as S

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------------------
# Reusable CTEs
# ---------------------------------------------------------------------------

_S = Q.py_strip("value")


def parsed_lines_cte(name: str, src: str) -> str:
    s = Q.py_strip("value")
    return f"""
{name} AS (
  SELECT line_no, label, message,
         coalesce(strpos(s, chr(9)) > 0 AND label IN ('ham', 'spam') AND message <> '', false) AS accepted
  FROM (
    SELECT line_no, s,
           CASE WHEN strpos(s, chr(9)) > 0 THEN lower({Q.py_strip('substring(s, 1, strpos(s, chr(9)) - 1)')})
                ELSE lower({Q.py_strip('s')}) END AS label,
           CASE WHEN strpos(s, chr(9)) > 0 THEN {Q.py_strip('substring(s, strpos(s, chr(9)) + 1)')} END AS message
    FROM (SELECT line_no, {s} AS s FROM {src})
  )
)"""


def sms_canon_select(parsed: str) -> str:
    return f"""
  SELECT {Q.stable_id(Q.q(S.SOURCE_SMS), 'line_no', 'message')} AS message_id,
         message AS raw_text,
         {Q.clean_sms('message')} AS clean_text,
         'sms' AS channel, 'en' AS language,
         'unknown' AS sender_id, 'unknown' AS receiver_id, 'unknown' AS sender_role,
         CAST(NULL AS VARCHAR) AS timestamp,
         CASE WHEN label = 'spam' THEN 'smishing' ELSE 'benign' END AS attack_label,
         CASE WHEN label = 'spam' THEN {Q.tactic_sms('message')} ELSE 'none' END AS manipulation_tactic,
         CASE WHEN label = 'spam' THEN 'exploit' ELSE 'benign' END AS intent_stage,
         '{S.SOURCE_SMS}' AS source_dataset, 'high' AS confidence_label
  FROM {parsed} WHERE accepted"""


def mail_canon_select(where: str, raw: str | None = None) -> str:
    raw = raw or Q.stdlib_body_text("coalesce(body, '')")
    frm = "CASE WHEN sender LIKE '%@%' THEN sender ELSE '\"' || sender || '\"' END"
    return f"""
  SELECT message_id, raw_text,
         CASE WHEN coalesce(raw_text, '') <> '' THEN {Q.clean_mail_text('raw_text')} END AS clean_text,
         'email' AS channel, 'en' AS language,
         {Q.normalize_address('from_addr')} AS sender_id,
         {Q.normalize_address('to_addr')} AS receiver_id,
         'unknown' AS sender_role,
         {Q.ts_text(Q.parse_timestamp_utc('date_raw'))} AS timestamp,
         'benign' AS attack_label, 'none' AS manipulation_tactic, 'benign' AS intent_stage,
         '{S.SOURCE_MAIL}' AS source_dataset, 'high' AS confidence_label
  FROM (
    SELECT '<' || CAST(id AS VARCHAR) || '.fix@' || source || '>' AS message_id,
           {raw} AS raw_text, {frm} AS from_addr, coalesce(receiver, '') AS to_addr, date_raw
    FROM msg WHERE {where}
  )"""


def phish_canon_select(where: str, key: tuple = ("id",)) -> str:
    return f"""
  SELECT {Q.stable_id(Q.q(S.SOURCE_PHISHING), *key, 'raw')} AS message_id,
         raw AS raw_text,
         coalesce({Q.clean_mail_body('raw')}, '[empty]') AS clean_text,
         'email' AS channel, 'en' AS language,
         {Q.anonymize_address('sender')} AS sender_id,
         {Q.anonymize_address('receiver')} AS receiver_id,
         'unknown' AS sender_role,
         {Q.ts_text(Q.parse_timestamp_utc('date_raw'))} AS timestamp,
         'phishing' AS attack_label,
         {Q.tactic_mail("coalesce(subject, 'nan') || ' ' || raw")} AS manipulation_tactic,
         'exploit' AS intent_stage,
         '{S.SOURCE_PHISHING}' AS source_dataset, 'high' AS confidence_label
  FROM (SELECT *, CASE WHEN {Q.is_blank('body')} THEN '' ELSE body END AS raw,
               row_number() OVER (PARTITION BY sender, receiver, date_raw, subject, body) - 1 AS copy_no
        FROM msg WHERE label = 1 AND {where})"""


SMS_SRC_CTE = """
sms_src AS (
  SELECT id AS line_no,
         CASE WHEN attack_label IN ('smishing', 'phishing') THEN 'spam' ELSE 'ham' END
         || chr(9) || regexp_replace(coalesce(body, ''), '[\\r\\n\\t]', ' ', 'g') AS value
  FROM msg WHERE channel = 'sms'
)"""

CORPUS_CTES = (
    SMS_SRC_CTE,
    parsed_lines_cte("sms_parsed", "sms_src"),
    "sms_canon AS (" + sms_canon_select("sms_parsed") + ")",
    "mail_canon AS (" + mail_canon_select("channel = 'email' AND coalesce(attack_label, 'benign') = 'benign'") + ")",
    "phish_canon AS (" + phish_canon_select("channel = 'email'") + ")",
    "corpus AS (SELECT * FROM sms_canon UNION ALL SELECT * FROM mail_canon UNION ALL SELECT * FROM phish_canon)",
)


def corpus_sql(body: str, *extra: str) -> str:
    return with_ctes(*CORPUS_CTES, *extra, body=body)


# ---------------------------------------------------------------------------
# Sources and canonical tables
# ---------------------------------------------------------------------------

ORACLE["labeled_lines"] = with_ctes(TAB_LINES_SQL, parsed_lines_cte("parsed", "tab_lines"),
                                    body=sms_canon_select("parsed"))

ORACLE["line_counts"] = with_ctes(TAB_LINES_SQL, parsed_lines_cte("parsed", "tab_lines"), body="""
SELECT CAST(count_if(accepted) AS BIGINT) AS lines_parsed,
       CAST(count_if(NOT accepted) AS BIGINT) AS lines_skipped
FROM parsed""")


def _extract(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(m, {Q.q(pattern)}) THEN regexp_extract(m, {Q.q(pattern)}, 1) END"


_HDR = {
    "message_id": rf"Message-ID:{Q.WS}*<([^>]+)>",
    "from": rf"From:{Q.WS}*(.*)",
    "to": rf"To:{Q.WS}*(.*)",
    "date": rf"Date:{Q.WS}*(.*)",
    "subject": rf"Subject:{Q.WS}*(.*)",
}

ORACLE["mail_headers"] = with_ctes(MAIL_TEXTS_SQL, body=f"""
SELECT file AS file_path, {', '.join(f'{_extract(p)} AS "{k}"' for k, p in _HDR.items())}
FROM (SELECT file, coalesce(message, 'nan') AS m FROM mail_texts)""")

ORACLE["mail_canonical"] = with_ctes(body=mail_canon_select("true"))

ORACLE["mail_mime"] = with_ctes(body=mail_canon_select("true", "coalesce(body, '')"))

ORACLE["phishing_canonical"] = with_ctes(body=phish_canon_select("true"))

ORACLE["master_corpus"] = corpus_sql("SELECT * FROM corpus")

ORACLE["corpus_validation"] = corpus_sql("""
SELECT source_name, field, CAST(null_count AS BIGINT) AS null_count FROM (
  SELECT 'sms' AS source_name, * FROM (SELECT count_if(clean_text IS NULL) AS clean_text, count_if(attack_label IS NULL) AS attack_label, count_if(channel IS NULL) AS channel FROM sms_canon)
  UNION ALL
  SELECT 'mail', * FROM (SELECT count_if(clean_text IS NULL), count_if(attack_label IS NULL), count_if(channel IS NULL) FROM mail_canon)
  UNION ALL
  SELECT 'phishing', * FROM (SELECT count_if(clean_text IS NULL), count_if(attack_label IS NULL), count_if(channel IS NULL) FROM phish_canon)
) UNPIVOT (null_count FOR field IN (clean_text, attack_label, channel))""")

ORACLE["label_distribution"] = corpus_sql("""
SELECT dimension, value, count, round(count * 100.0 / total, 6) AS percent FROM (
  SELECT dimension, value, CAST(count(*) AS BIGINT) AS count, sum(count(*)) OVER (PARTITION BY dimension) AS total
  FROM (
    SELECT 'attack_label' AS dimension, attack_label AS value FROM corpus
    UNION ALL SELECT 'channel', channel FROM corpus
    UNION ALL SELECT 'manipulation_tactic', manipulation_tactic FROM corpus
    UNION ALL SELECT 'source_dataset', source_dataset FROM corpus
  ) GROUP BY dimension, value
) WHERE value IS NOT NULL""")

ORACLE["channel_crosstab"] = corpus_sql("""
SELECT channel, CAST(benign AS BIGINT) AS benign, CAST(phishing AS BIGINT) AS phishing,
       CAST(smishing AS BIGINT) AS smishing, CAST(benign + phishing + smishing AS BIGINT) AS "All"
FROM (
  SELECT channel, count_if(attack_label = 'benign') AS benign, count_if(attack_label = 'phishing') AS phishing,
         count_if(attack_label = 'smishing') AS smishing
  FROM corpus WHERE channel IS NOT NULL AND attack_label IS NOT NULL GROUP BY channel
  UNION ALL
  SELECT 'All', count_if(attack_label = 'benign'), count_if(attack_label = 'phishing'), count_if(attack_label = 'smishing')
  FROM corpus WHERE channel IS NOT NULL AND attack_label IS NOT NULL
)""")

ORACLE["health_report"] = corpus_sql("""
SELECT source_dataset, count(*) AS total_rows, count(raw_text) AS non_null_raw, count(clean_text) AS non_null_clean,
       CAST(count_if(timestamp IS NULL) AS BIGINT) AS missing_timestamp,
       CAST(count_if(attack_label = 'benign') AS BIGINT) AS benign_rows,
       CAST(count_if(attack_label IN ('smishing', 'phishing')) AS BIGINT) AS malicious_rows,
       round(count(clean_text) * 100.0 / count(*), 6) AS non_null_clean_pct,
       round(count_if(timestamp IS NULL) * 100.0 / count(*), 6) AS missing_timestamp_pct,
       round(count_if(attack_label = 'benign') * 100.0 / count(*), 6) AS benign_pct
FROM corpus GROUP BY source_dataset""")

# ---------------------------------------------------------------------------
# Hard-negative mining
# ---------------------------------------------------------------------------

FLAGS_CTE = f"""
flags AS (
  SELECT *, (has_url OR has_phone OR has_authority OR has_urgency) AS any_suspicious,
         CAST(has_url AS INTEGER) + CAST(has_phone AS INTEGER) + CAST(has_authority AS INTEGER)
           + CAST(has_urgency AS INTEGER) AS pattern_count,
         concat_ws(', ', CASE WHEN has_url THEN 'URL' END, CASE WHEN has_phone THEN 'Phone' END,
                   CASE WHEN has_authority THEN 'Authority' END, CASE WHEN has_urgency THEN 'Urgency' END) AS patterns
  FROM (
    SELECT *, {Q.has_url('clean_text')} AS has_url, {Q.has_phone('clean_text')} AS has_phone,
           {Q.has_authority('clean_text')} AS has_authority, {Q.has_urgency('clean_text')} AS has_urgency
    FROM corpus WHERE clean_text IS NOT NULL AND attack_label = 'benign'
  )
)"""

ORACLE["risk_flags"] = corpus_sql("""
SELECT message_id, channel, has_url, has_phone, has_authority, has_urgency, any_suspicious, pattern_count, patterns
FROM flags""", FLAGS_CTE)


def _cnt(name: str, cond: str) -> str:
    return (f"CAST(count_if({cond}) AS BIGINT) AS {name}_count, "
            f"round(count_if({cond}) * 100.0 / count(*), 6) AS {name}_pct")


ORACLE["risk_report"] = corpus_sql(f"""
SELECT count(*) AS total_benign, {_cnt('url', 'has_url')}, {_cnt('phone', 'has_phone')},
       {_cnt('authority', 'has_authority')}, {_cnt('urgency', 'has_urgency')},
       {_cnt('any_suspicious', 'any_suspicious')}, {_cnt('multi_pattern', 'pattern_count >= 2')}
FROM flags""", FLAGS_CTE)

ORACLE["risk_samples"] = corpus_sql(f"""
SELECT * FROM (
  SELECT category, message_id, channel, patterns, text_preview,
         row_number() OVER (PARTITION BY category ORDER BY md5('{S.RANDOM_STATE}|' || message_id), message_id) AS sample_rank
  FROM (
    SELECT 'URL' AS category, * FROM flags WHERE has_url
    UNION ALL SELECT 'Phone', * FROM flags WHERE has_phone
    UNION ALL SELECT 'Authority', * FROM flags WHERE has_authority
    UNION ALL SELECT 'Urgency', * FROM flags WHERE has_urgency
    UNION ALL SELECT 'Multiple', * FROM flags WHERE pattern_count >= 2
  ) x, LATERAL (SELECT {Q.preview('clean_text', 300, ellipsis=False, flatten=True)} AS text_preview)
) WHERE sample_rank <= {S.SAMPLES_PER_CATEGORY}""", FLAGS_CTE)

# ---------------------------------------------------------------------------
# Samples, split, features, model
# ---------------------------------------------------------------------------

ORACLE["sample_exact"] = with_ctes(MAIL_TEXTS_SQL, body=f"""
SELECT file, message FROM mail_texts
ORDER BY md5('{S.RANDOM_STATE}|' || file), file LIMIT 500""")

LABELLED_CTE = """
labelled AS (
  SELECT message_id AS id, clean_text, channel,
         CAST(coalesce(attack_label IN ('smishing', 'phishing'), false) AS INTEGER) AS y
  FROM corpus WHERE clean_text IS NOT NULL
)"""

SPLIT_CTES = (
    LABELLED_CTE,
    "cls AS (SELECT y, count(*) AS n_c FROM labelled GROUP BY y)",
    f"tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST({S.TEST_SIZE} AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_test FROM cls)",
    "base AS (SELECT y, (n_test * n_c) // n AS b, (n_test * n_c) % n AS rem, n_test FROM cls, tot)",
    """alloc AS (SELECT y, b + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= n_test - sum(b) OVER ()
                  THEN 1 ELSE 0 END AS k FROM base)""",
    f"""split AS (
  SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY l.y ORDER BY md5('{S.RANDOM_STATE}|' || l.id), l.id) <= a.k
                   THEN 'test' ELSE 'train' END AS fold
  FROM labelled l JOIN alloc a ON l.y = a.y
)""",
)


def toks_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def grams_sql(toks: str) -> str:
    """Unigrams + bigrams of a token-list column (a column, not an
    expression: the lambda would re-evaluate an expression per element)."""
    return (f"list_concat({toks}, CASE WHEN len({toks}) >= 2 THEN list_transform(range(1, len({toks})), "
            f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]) ELSE []::VARCHAR[] END)")


MODEL_CTES = SPLIT_CTES + (
    f"""tf AS (SELECT id, y, fold, term, count(*) AS tf
              FROM (SELECT id, y, fold, unnest({grams_sql('toks')}) AS term
                    FROM (SELECT id, y, fold, {toks_sql('clean_text')} AS toks FROM split)) GROUP BY ALL)""",
    "ntrain AS (SELECT count(*) AS n FROM split WHERE fold = 'train')",
    """stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf,
                       CAST(count_if(y = 1) AS BIGINT) AS df_pos, CAST(count_if(y = 0) AS BIGINT) AS df_neg
                FROM tf WHERE fold = 'train' GROUP BY term)""",
    f"""vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, total_tf, df_pos, df_neg,
         ln(CAST(1 + n AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + 1.0 AS idf,
         ln(CAST(df_pos + 1 AS DOUBLE) / CAST(df_neg + 1 AS DOUBLE)) AS coef
  FROM (SELECT s.*, n FROM stats s, ntrain
        WHERE df >= {S.MIN_DF} AND df <= CAST({S.MAX_DF} AS DOUBLE) * n
        ORDER BY total_tf DESC, term LIMIT {S.VOCAB_SIZE_V2})
)""",
    """test_scores AS (
  SELECT id, sum(raw_w * coef) AS dot, sum(raw_w * raw_w) AS norm2
  FROM (SELECT tf.id, (1 + ln(tf.tf)) * v.idf AS raw_w, v.coef FROM tf JOIN vocab v USING (term) WHERE tf.fold = 'test')
  GROUP BY id
)""",
    """preds AS (
  SELECT s.id, s.y, s.channel, s.clean_text, d.decision, round(1.0 / (1.0 + exp(-d.decision)), 12) AS prob,
         CAST(d.decision > 0 AS INTEGER) AS pred
  FROM split s LEFT JOIN test_scores t USING (id),
       LATERAL (SELECT coalesce(t.dot / sqrt(t.norm2), 0.0) + 0.0 AS decision) d
  WHERE s.fold = 'test'
)""",
)


def model_sql(body: str, *extra: str) -> str:
    return corpus_sql(body, *MODEL_CTES, *extra)


ORACLE["stratified_split"] = corpus_sql("SELECT id, y, fold FROM split", *SPLIT_CTES)

ORACLE["class_weights"] = corpus_sql("""
SELECT fold, y, count, round(tot / (k * count), 9) AS weight FROM (
  SELECT fold, y, count(*) AS count, sum(count(*)) OVER (PARTITION BY fold) AS tot,
         count(*) OVER (PARTITION BY fold) AS k
  FROM split GROUP BY fold, y)""", *SPLIT_CTES)

ORACLE["first_sample"] = corpus_sql("""
SELECT attack_label, message_id, source_dataset, substring(clean_text, 1, 100) AS clean_preview FROM (
  SELECT *, row_number() OVER (PARTITION BY attack_label ORDER BY message_id) AS rn FROM corpus) WHERE rn = 1""")

ORACLE["ngram_counts"] = corpus_sql(rf"""
SELECT id, CAST(len(toks) AS INTEGER) AS n_unigrams, CAST(greatest(len(toks) - 1, 0) AS INTEGER) AS n_bigrams,
       CAST(len(list_distinct({grams_sql('toks')})) AS INTEGER) AS n_distinct_terms
FROM (SELECT *, regexp_extract_all(lower(clean_text), '[\p{{L}}\p{{N}}_]{{2,}}') AS toks FROM labelled)""",
                                    LABELLED_CTE)

ORACLE["vocab"] = model_sql("""
SELECT term, idx, df, total_tf, df_pos, df_neg, round(idf, 9) AS idf, round(coef, 9) AS coef FROM vocab""")

ORACLE["tfidf_weights"] = model_sql("""
SELECT id, term, round(raw_w / sqrt(sum(raw_w * raw_w) OVER (PARTITION BY id)), 9) AS weight
FROM (SELECT tf.id, tf.term, (1 + ln(tf.tf)) * v.idf AS raw_w FROM tf JOIN vocab v USING (term) WHERE tf.fold = 'train')""")

ORACLE["linear_scores"] = model_sql("SELECT id, y, round(decision, 9) AS decision, round(prob, 9) AS prob, pred FROM preds")

_PRF = """
round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0), 9) AS precision,
round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0), 9) AS recall,
round(coalesce(2.0 * (tp / nullif(CAST(tp + fp AS DOUBLE), 0)) * (tp / nullif(CAST(tp + fn AS DOUBLE), 0))
      / nullif(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) + coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0), 0), 0.0), 9) AS f1"""

CM_CTE = """
cm AS (SELECT CAST(count_if(y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND pred = 1) AS BIGINT) AS fp,
              CAST(count_if(y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count_if(y = 1 AND pred = 1) AS BIGINT) AS tp
       FROM preds)"""

ORACLE["confusion"] = model_sql(f"SELECT tn, fp, fn, tp, {_PRF} FROM cm", CM_CTE)


def _prf_raw(tp: str, fp: str, fn: str) -> str:
    p = f"coalesce({tp} / nullif(CAST({tp} + {fp} AS DOUBLE), 0), 0.0)"
    r = f"coalesce({tp} / nullif(CAST({tp} + {fn} AS DOUBLE), 0), 0.0)"
    f = f"coalesce(2.0 * {p} * {r} / nullif({p} + {r}, 0), 0.0)"
    return f"{p} AS precision, {r} AS recall, {f} AS f1"


ORACLE["class_report"] = model_sql(f"""
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
  SELECT * FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, coalesce((tn + tp) / nullif(CAST(tn + fp + fn + tp AS DOUBLE), 0), 0.0),
                   tn + fp + fn + tp FROM cm
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', coalesce(sum(precision * support) / nullif(CAST(sum(support) AS DOUBLE), 0), 0.0),
                   coalesce(sum(recall * support) / nullif(CAST(sum(support) AS DOUBLE), 0), 0.0),
                   coalesce(sum(f1 * support) / nullif(CAST(sum(support) AS DOUBLE), 0), 0.0),
                   CAST(sum(support) AS BIGINT) FROM per)""",
    CM_CTE,
    f"""per AS (
  SELECT 'Benign' AS label, {_prf_raw('tn', 'fn', 'fp')}, tn + fp AS support FROM cm
  UNION ALL SELECT 'Malicious', {_prf_raw('tp', 'fp', 'fn')}, tp + fn FROM cm)""")

ORACLE["roc_auc"] = model_sql("""
SELECT round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)), 9) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT prob AS s, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM preds GROUP BY prob))""")

SWEEP_CTE = f"""
sweep AS (
  SELECT step, round(threshold, 9) AS threshold, {_PRF}, fn, fp, tp, tn FROM (
    SELECT step, threshold,
           CAST(count_if(prob >= threshold AND y = 1) AS BIGINT) AS tp,
           CAST(count_if(prob >= threshold AND y = 0) AS BIGINT) AS fp,
           CAST(count_if(prob < threshold AND y = 1) AS BIGINT) AS fn,
           CAST(count_if(prob < threshold AND y = 0) AS BIGINT) AS tn
    FROM (SELECT CAST(range AS INTEGER) AS step, range * CAST(0.01 AS DOUBLE) AS threshold FROM range(0, 101)) t,
         preds
    GROUP BY step, threshold)
)"""

ORACLE["threshold_sweep"] = model_sql("SELECT * FROM sweep", SWEEP_CTE)

ORACLE["best_thresholds"] = model_sql("""
SELECT * FROM (SELECT 'recall_at_least_99' AS criterion, * FROM sweep WHERE recall >= 0.99 ORDER BY precision DESC, step LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'min_false_negatives', * FROM sweep ORDER BY fn, step LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'max_f1', * FROM sweep ORDER BY f1 DESC, step LIMIT 1)
UNION ALL SELECT 'default_050', * FROM sweep WHERE step = 50""", SWEEP_CTE)

ORACLE["threshold_table"] = model_sql(
    f"SELECT * FROM sweep WHERE step IN ({', '.join(str(x) for x in S.THRESHOLD_TABLE_STEPS)})", SWEEP_CTE)

TOP_CTE = """
top AS (
  SELECT * FROM (SELECT 'positive' AS side, term, round(coef, 9) AS coef,
                        CAST(row_number() OVER (ORDER BY coef DESC, term) AS INTEGER) AS rank FROM vocab) WHERE rank <= 20
  UNION ALL
  SELECT * FROM (SELECT 'negative' AS side, term, round(coef, 9) AS coef,
                        CAST(row_number() OVER (ORDER BY coef ASC, term) AS INTEGER) AS rank FROM vocab) WHERE rank <= 20
)"""

ORACLE["top_terms"] = model_sql("SELECT side, term, coef, rank FROM top", TOP_CTE)

ORACLE["ngram_breakdown"] = model_sql("""
SELECT side, CASE WHEN contains(term, ' ') THEN 'bigram' ELSE 'unigram' END AS kind, count(*) AS count
FROM top GROUP BY ALL""", TOP_CTE)

ORACLE["error_samples"] = model_sql(f"""
SELECT kind, id, channel, text_preview, CAST(total AS BIGINT) AS total, CAST(rank AS INTEGER) AS rank FROM (
  SELECT kind, id, channel, {Q.preview('clean_text', 200)} AS text_preview,
         count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY id) AS rank
  FROM (SELECT *, CASE WHEN y = 1 AND pred = 0 THEN 'false_negative'
                       WHEN y = 0 AND pred = 1 THEN 'false_positive' END AS kind FROM preds)
  WHERE kind IS NOT NULL) WHERE rank <= 5""")

# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------

_MODES = ", ".join(Q.q(m) for m in S.MODE_THRESHOLDS)
_THR = " ".join(f"WHEN {Q.q(m)} THEN CAST({v} AS DOUBLE)" for m, v in S.MODE_THRESHOLDS.items())

SCORE_CTES = (
    """req AS (
  SELECT id, body AS text,
         CASE WHEN id % 10 = 0 THEN upper(channel) WHEN id % 23 = 0 THEN 'fax' ELSE channel END AS channel,
         CASE WHEN id % 29 = 0 THEN 'bogus' WHEN id % 31 = 0 THEN NULL WHEN id % 4 = 0 THEN 'balanced'
              WHEN id % 4 = 1 THEN 'high_recall' WHEN id % 4 = 2 THEN 'LOW_FP' ELSE '' END AS mode
  FROM msg)""",
    f"req_pre AS (SELECT *, {Q.preprocess('text', cut=False)} AS pre FROM req)",
    f"""req_tf AS (SELECT id, term, count(*) AS tf
                 FROM (SELECT id, unnest({grams_sql('toks')}) AS term
                       FROM (SELECT id, {toks_sql('pre')} AS toks FROM req_pre WHERE pre <> '')) GROUP BY ALL)""",
    """req_dot AS (
  SELECT id, sum(raw_w * coef) AS dot, sum(raw_w * raw_w) AS norm2
  FROM (SELECT r.id, (1 + ln(r.tf)) * v.idf AS raw_w, v.coef FROM req_tf r JOIN vocab v USING (term)) GROUP BY id)""",
    f"""req_first AS (
  SELECT r.*, CASE WHEN pre = '' THEN 0.0 ELSE 1.0 / (1.0 + exp(-(coalesce(d.dot / sqrt(d.norm2), 0.0) + 0.0))) END AS first,
         CASE WHEN mode IS NULL OR mode = '' THEN 'balanced' WHEN lower(mode) IN ({_MODES}) THEN lower(mode) END AS m,
         CASE WHEN coalesce(mode, '') <> '' AND lower(mode) NOT IN ({_MODES})
              THEN 'Invalid mode: ' || mode || '. Use: balanced, high_recall, low_fp' END AS error,
         CASE WHEN lower(channel) IN ('email', 'sms', 'unknown') THEN lower(channel) ELSE 'unknown' END AS ch,
         false AS was_truncated
  FROM req_pre r LEFT JOIN req_dot d USING (id))""",
)


def _tier(x: str) -> str:
    whens = " ".join(f"WHEN {x} < {b} THEN {Q.q(n)}" for b, n in S.RISK_TIERS)
    return f"CASE {whens} ELSE {Q.q(S.RISK_TIER_TOP)} END"


def _score_out(score: str, second: str) -> str:
    thr = f"coalesce(CASE m {_THR} END, CAST({S.MODE_THRESHOLDS[S.DEFAULT_MODE]} AS DOUBLE))"
    return f"""
  SELECT id,
         CASE WHEN error IS NULL THEN round({score}, 4) END AS probability,
         CASE WHEN error IS NULL THEN {_tier(score)} ELSE 'Error' END AS risk_tier,
         CASE WHEN error IS NULL THEN {score} >= {thr} END AS is_malicious,
         CASE WHEN error IS NULL THEN round(first, 4) END AS tfidf_score,
         CASE WHEN error IS NULL THEN round({second}, 4) END AS roberta_score,
         CASE WHEN error IS NULL THEN ch END AS channel,
         CASE WHEN error IS NULL THEN m END AS mode,
         CASE WHEN error IS NULL THEN {thr} END AS threshold,
         error, was_truncated"""


ORACLE["scored_messages"] = model_sql(_score_out("first", "0.0") + " FROM req_first", *SCORE_CTES)

_KW = S.AUTHORITY_KEYWORDS + S.URGENCY_KEYWORDS
_HITS = " + ".join(f"CASE WHEN contains(lower(pre), {Q.q(w)}) THEN 1 ELSE 0 END" for w in _KW)

ORACLE["second_model"] = model_sql(
    _score_out("(0.6 * second + 0.4 * first)", "second") + ", true AS roberta_enabled FROM req_second",
    *SCORE_CTES,
    f"""req_second AS (SELECT *, CASE WHEN pre = '' THEN 0.0 ELSE 1.0 / (1.0 + exp(-(({_HITS}) - 1.5))) END AS second
                       FROM req_first)""")

ORACLE["component_scores"] = model_sql("""
SELECT id, round(0.5 * second + 0.5 * first, 4) AS probability, round(first, 4) AS first, round(second, 4) AS second,
       round(0.6 * second + 0.4 * first, 4) AS ensemble
FROM req_second WHERE error IS NULL""", *SCORE_CTES, f"""req_second AS (
  SELECT *, CASE WHEN pre = '' THEN 0.0 ELSE 1.0 / (1.0 + exp(-(({_HITS}) - 1.5))) END AS second FROM req_first)""")
ORACLE["weight_checks"] = with_ctes(body="""
SELECT id, CAST(id % 21 AS DOUBLE) / 20 AS first, round(1 - CAST(id % 21 AS DOUBLE) / 20 + (id % 5 - 2) * CAST(0.0006 AS DOUBLE), 9) AS second,
       id % 5 IN (1, 2, 3) AS valid FROM msg""")

ORACLE["audit_log"] = model_sql(f"""
SELECT probability, risk_tier, is_malicious, mode, channel, text_length FROM (
  {_score_out('first', '0.0')}, CAST(coalesce(length(text), 0) AS INTEGER) AS text_length FROM req_first)
WHERE error IS NULL""", *SCORE_CTES)

# ---------------------------------------------------------------------------
# Validation, sanitising, labels, sentinels, file round trips
# ---------------------------------------------------------------------------

_TXT_RULES = [
    ("text IS NULL", "text: field required"),
    ("length(text) < 1", "text: at least 1 character"),
    (f"length(text) > {S.MAX_REQUEST_CHARS}", f"text: at most {S.MAX_REQUEST_CHARS} characters"),
    (f"length(text) BETWEEN 1 AND {S.MAX_REQUEST_CHARS} AND {Q.is_blank('text')}",
     "text: cannot be empty or whitespace only"),
    ("lower(coalesce(channel, 'unknown')) NOT IN ('email', 'sms', 'unknown')",
     "channel: must be one of email, sms, unknown"),
    (f"lower(coalesce(mode, 'balanced')) NOT IN ({_MODES})", "mode: must be one of balanced, high_recall, low_fp"),
]
_VIOL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {Q.q(m)} END" for c, m in _TXT_RULES) + "], lambda x: x IS NOT NULL)"

ORACLE["request_validation"] = with_ctes(SCORE_CTES[0], body=f"""
SELECT id, len(v) = 0 AS accepted, array_to_string(v, '; ') AS violations,
       lower(coalesce(channel, 'unknown')) AS channel_norm, lower(coalesce(mode, 'balanced')) AS mode_norm
FROM (SELECT *, {_VIOL} AS v FROM req)""")

ORACLE["sanitized_text"] = with_ctes(body=f"""
SELECT id, {Q.sanitize('body')} AS sanitized, {Q.preprocess('body')} AS preprocessed,
       length(replace(coalesce(body, ''), chr(0), '')) > {S.MAX_CHAR_LENGTH} AS was_truncated
FROM msg""")

_NA = ", ".join(Q.q(v) for v in S.NA_SENTINELS)
ORACLE["null_sentinels"] = with_ctes(body="SELECT id, " + ", ".join(
    f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END AS {c}" for c in ("body", "subject", "sender", "date_raw", "attack_label"))
    + " FROM msg")

ORACLE["label_columns"] = corpus_sql("""
SELECT message_id, attack_label,
       CAST(coalesce(attack_label = 'smishing', false) AS INTEGER) AS y_smishing,
       CAST(coalesce(attack_label IN ('smishing', 'phishing'), false) AS INTEGER) AS y_malicious
FROM corpus""")

ORACLE["file_roundtrip"] = ORACLE["master_corpus"]
ORACLE["corpus_parquet"] = ORACLE["master_corpus"]

ORACLE["mail_csv_headers"] = with_ctes(MAIL_TEXTS_SQL, body=f"""
SELECT file AS file_path, {', '.join(f'{_extract(p)} AS "{k}"' for k, p in _HDR.items())}
FROM (SELECT file, coalesce(message, 'nan') AS m FROM mail_texts
      UNION ALL SELECT 'file', 'message')""")

ORACLE["stored_predictions"] = model_sql(f"""
SELECT tn, fp, fn, tp, {_PRF}, a.roc_auc FROM cm,
  (SELECT round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)), 9) AS roc_auc
   FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
         FROM (SELECT prob AS s, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM preds GROUP BY prob))) a""",
    CM_CTE)

# ---------------------------------------------------------------------------
# Streams: same results as the batch plans (accepted requests only)
# ---------------------------------------------------------------------------

_ACCEPTED = " AND ".join(f"NOT coalesce({c}, false)" for c, _ in _TXT_RULES)
ORACLE["stream_scores"] = model_sql(_score_out("first", "0.0") + f" FROM req_first WHERE {_ACCEPTED}", *SCORE_CTES)
ORACLE["stream_canonical"] = ORACLE["labeled_lines"]

_KW_HITS_CLEAN = " + ".join(f"CASE WHEN contains(lower(pc), {Q.q(w)}) THEN 1 ELSE 0 END" for w in _KW)


def _metrics_sql(name: str, src: str) -> str:
    return f"""
SELECT '{name}' AS model, {_PRF}, a.roc_auc FROM
  (SELECT CAST(count_if(y = 0 AND pred = 1) AS BIGINT) AS fp, CAST(count_if(y = 1 AND pred = 0) AS BIGINT) AS fn,
          CAST(count_if(y = 1 AND pred = 1) AS BIGINT) AS tp FROM {src}) c,
  (SELECT round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)), 9) AS roc_auc
   FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
         FROM (SELECT prob AS s, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM {src} GROUP BY prob))) a"""


ORACLE["compare_models"] = model_sql(
    _metrics_sql("tfidf", "preds") + " UNION ALL " + _metrics_sql("keyword", "kw"),
    f"""kw AS (SELECT id, y, prob, CAST(prob > 0.5 AS INTEGER) AS pred FROM (
          SELECT id, y, round(CASE WHEN pc = '' THEN 0.0 ELSE 1.0 / (1.0 + exp(-(({_KW_HITS_CLEAN}) - 1.5))) END, 12) AS prob
          FROM (SELECT *, {Q.preprocess('clean_text', cut=False)} AS pc FROM preds)))""")

# ---------------------------------------------------------------------------
# Loading and batch requests
# ---------------------------------------------------------------------------

ORACLE["load_sources"] = """
SELECT 'documents' AS dataset, count(*) AS rows FROM documents
UNION ALL SELECT 'labels', count(*) FROM labels"""

_ITEM_ERROR = "CASE " + " ".join(f"WHEN {c} THEN {Q.q(m)}" for c, m in _TXT_RULES[:4]) + " END"
_BATCH_CTES = (
    SCORE_CTES[0],
    """b_req AS (
  SELECT id, text, channel, id // 20 AS batch_id,
         CASE WHEN (id // 20) % 7 = 6 THEN 'bogus' WHEN (id // 20) % 3 = 0 THEN 'balanced'
              WHEN (id // 20) % 3 = 1 THEN 'high_recall' ELSE 'LOW_FP' END AS mode
  FROM req)""",
) + tuple(c.replace("FROM req)", "FROM b_req)", 1) for c in SCORE_CTES[1:])

ORACLE["batch_predictions"] = model_sql(f"""
SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY id) - 1 AS INTEGER) AS index, id,
       CASE WHEN bad IS NULL THEN probability END AS probability, CASE WHEN bad IS NULL THEN risk_tier ELSE 'Error' END AS risk_tier,
       CASE WHEN bad IS NULL THEN is_malicious END AS is_malicious, coalesce(bad, error) AS error
FROM ({_score_out('first', '0.0')}, batch_id, {_ITEM_ERROR} AS bad FROM req_first)""", *_BATCH_CTES)


# ---------------------------------------------------------------------------
# Raw files, faulty sources, explanations, the first model generation
# ---------------------------------------------------------------------------

ORACLE["sms_files"] = with_ctes(
    TAB_LINES_SQL,
    """keyed AS (SELECT md5(value) || '-' || CAST(row_number() OVER (PARTITION BY value) - 1 AS VARCHAR) AS line_no, value
                 FROM tab_lines)""",
    parsed_lines_cte("parsed", "keyed"), body=sms_canon_select("parsed"))
ORACLE["mail_csv"] = ORACLE["mail_canonical"]
ORACLE["mail_csv_splits"] = ORACLE["mail_canonical"]
_PHISH_FILE = phish_canon_select("true", ("sender", "receiver", "date_raw", "subject", "body", "copy_no"))
ORACLE["phishing_csv"] = with_ctes(body=_PHISH_FILE)
ORACLE["stream_sms_files"] = f"SELECT * EXCLUDE (message_id), 1 AS ids FROM ({ORACLE['labeled_lines']})"
ORACLE["stream_phishing_files"] = f"SELECT * EXCLUDE (message_id), 1 AS ids FROM ({ORACLE['phishing_canonical']})"
ORACLE["stream_rejects"] = with_ctes(SCORE_CTES[0], body=f"""
SELECT id, array_to_string(v, '; ') AS violations FROM (SELECT *, {_VIOL} AS v FROM req) WHERE len(v) > 0""")

_PLACES = list(enumerate(S.CANONICAL_COLUMNS, 1))
_FAULTS = [("sms", "column language is absent"), ("sms", "column extra is unknown"), ("phishing", None)] + [
    ("mail", f"column {c} is at position {len(_PLACES) + 1 - i} instead of {i}") for i, c in _PLACES if 2 * i != len(_PLACES) + 1]
ORACLE["schema_violations"] = corpus_sql(
    "SELECT source_dataset, rows, violation FROM faults JOIN held USING (source_dataset)",
    "faults(source_dataset, violation) AS (VALUES " + ", ".join(
        f"({Q.q(a)}, {'NULL' if b is None else Q.q(b)})" for a, b in _FAULTS) + ")",
    """held AS (SELECT 'sms' AS source_dataset, count(*) AS rows FROM sms_canon
                UNION ALL SELECT 'mail', count(*) FROM mail_canon UNION ALL SELECT 'phishing', count(*) FROM phish_canon)""")

ORACLE["explained_messages"] = model_sql(f"""
SELECT s.id, probability, risk_tier, mode, channel, is_malicious, false AS roberta_enabled,
       CASE WHEN error IS NULL THEN coalesce(why, '') END AS explanations, error IS NULL AS has_time
FROM ({_score_out("first", "0.0")} FROM req_first) s LEFT JOIN (
  SELECT id, string_agg(term, '; ' ORDER BY rn) AS why
  FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY value DESC, term) AS rn
        FROM (SELECT r.id, r.term, round((1 + ln(r.tf)) * v.idf * v.coef, 9) AS value, v.coef FROM req_tf r JOIN vocab v USING (term))
        WHERE coef > 0)
  WHERE rn <= 5 GROUP BY id) w ON s.id = w.id""", *SCORE_CTES)

ORACLE["model_roundtrip"] = ORACLE["vocab"]
ORACLE["logistic_optimum"] = model_sql("""
SELECT (SELECT count(*) FROM split WHERE fold = 'train') AS n_train, (SELECT count(*) FROM split WHERE fold = 'test') AS n_test,
       (SELECT count(*) FROM vocab) AS terms, true AS at_optimum""")
ORACLE["smishing_eval"] = (
    ORACLE["stored_predictions"]
    .replace("attack_label IN ('smishing', 'phishing'), false) AS INTEGER) AS y", "attack_label = 'smishing', false) AS INTEGER) AS y")
    .replace("FROM corpus WHERE clean_text IS NOT NULL",
             f"FROM corpus WHERE clean_text IS NOT NULL AND source_dataset IN ('{S.SOURCE_SMS}', '{S.SOURCE_MAIL}')")
    .replace(f"LIMIT {S.VOCAB_SIZE_V2}", f"LIMIT {S.VOCAB_SIZE_V1}"))


def _step_ctes(steps: int, rate: float) -> tuple[str, ...]:
    """Gradient steps of the balanced, L2-penalised mean loss from zero."""
    out = [
        """fx AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x
                  FROM (SELECT t.id, v.idx, (1 + ln(t.tf)) * v.idf AS w FROM tf t JOIN vocab v USING (term) WHERE t.fold = 'train'))""",
        """fr AS (SELECT s.id, s.y, n.n / (k.k * c.n_c) AS c, n.n FROM split s,
                  (SELECT CAST(count(*) AS DOUBLE) AS n FROM split WHERE fold = 'train') n,
                  (SELECT CAST(count(DISTINCT y) AS DOUBLE) AS k FROM split WHERE fold = 'train') k,
                  LATERAL (SELECT count(*) AS n_c FROM split o WHERE o.fold = 'train' AND o.y = s.y) c
                  WHERE s.fold = 'train')""",
        "w0 AS (SELECT idx, CAST(0 AS DOUBLE) AS w FROM vocab)", "b0 AS (SELECT CAST(0 AS DOUBLE) AS b)"]
    for t in range(steps):
        out += [
            f"z{t} AS (SELECT fx.id, sum(fx.x * w.w) AS z FROM fx JOIN w{t} w USING (idx) GROUP BY fx.id)",
            f"""r{t} AS (SELECT fr.id, fr.n, fr.c * (1 / (1 + exp(-(coalesce(z.z, 0) + b.b))) - fr.y) AS r
                         FROM b{t} b, fr LEFT JOIN z{t} z ON z.id = fr.id)""",
            f"g{t} AS (SELECT fx.idx, sum(fx.x * r.r) AS g FROM fx JOIN r{t} r USING (id) GROUP BY fx.idx)",
            f"""w{t + 1} AS (SELECT w.idx, w.w - {rate} * (coalesce(g.g, 0) + w.w) / n.n AS w
                             FROM (SELECT max(n) AS n FROM fr) n, w{t} w LEFT JOIN g{t} g ON g.idx = w.idx)""",
            f"b{t + 1} AS (SELECT b.b - {rate} * s.g AS b FROM b{t} b, (SELECT sum(r) / max(n) AS g FROM r{t}) s)"]
    return tuple(out)


# FIXED VALUES: steps and rate of the query.
_STEPS = _step_ctes(4, 2.0)
ORACLE["logistic_steps"] = model_sql("""
SELECT v.term, v.idx, round(w.w, 9) AS coef FROM vocab v JOIN w4 w USING (idx)
UNION ALL SELECT NULL, NULL, round(b, 9) FROM b4""", *_STEPS)
ORACLE["logistic_steps_eval"] = with_ctes(*CORPUS_CTES, *MODEL_CTES[:-2], *_STEPS, """test_scores AS (
  SELECT id, sum(raw_w * coef) AS dot, sum(raw_w * raw_w) AS norm2
  FROM (SELECT tf.id, (1 + ln(tf.tf)) * v.idf AS raw_w, w.w AS coef
        FROM tf JOIN vocab v USING (term) JOIN w4 w USING (idx) WHERE tf.fold = 'test')
  GROUP BY id)""", MODEL_CTES[-1].replace("0.0) + 0.0 AS decision", "0.0) + (SELECT b FROM b4) AS decision").replace(
    "exp(-d.decision)), 12)", "exp(-d.decision)), 9)"), CM_CTE, body=ORACLE["stored_predictions"][ORACLE["stored_predictions"].rindex("\nSELECT tn, fp"):])
