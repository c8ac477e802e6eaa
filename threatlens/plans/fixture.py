"""The enriched message view ``msg`` built from the driver tables.

``documents`` text triggers almost no risk rule, so every query derives a
message table from ``documents`` (left join ``labels``) by fixed rules on
``doc_id``: a channel, an attack-like lead sentence, hostile bodies (null,
blank, a pandas NA word, CR/TAB noise), subjects, senders and date forms.
The same rules are written twice: as DataFrame code here and as SQL for
the DuckDB oracles (``MSG_SQL``). The work grows with ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: fixture texts.
LEADS = [
    "URGENT: verify your account at http://secure-bank.example/x now. ",
    "Congratulations! You have won a prize, claim it on www.win.example. ",
    "Call +1 555-012-3456 before the deadline. ",
    "Warning: unauthorized login blocked. ",
    "PayPal security team: confirm billing. ",
]
SUBJECTS = ["Final notice", "Lunch", None, "Re: report", "Re: report"]
DATES = [
    "Mon, 14 May 2001 16:39:00 -0700 (PDT)",
    "14 May 2001 09:00:00 +0000",
    "2005-01-01 10:00:00+00:00",
    "not a date",
]
NOISY_LF = " \r\n\t\n\n"
RECEIVER = "Desk@Example.org"
X_FROM = "Archive Robot"


def _pick(key, values):
    """CASE key WHEN 0 THEN values[0] ... (None = null)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(key == i, lit) if expr is None else expr.when(key == i, lit)
    return expr


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan whose fullest partition holds more than twice a core's share
    to all cores; another scan stays as it is. Splits are cut by bytes, but rows come by whole
    row groups, so most splits of a file with few row groups are empty."""
    n, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= n:
        held = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))   # no column is read
        total, most = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if most * n <= 2 * total:
            return df
    return df.repartition(max(n, splits))


def message_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    d = docs.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    lead = F.coalesce(_pick(i % 11, LEADS), F.lit(""))
    body = (
        F.when(i % 97 == 0, F.lit(None).cast("string"))
        .when(i % 89 == 0, F.lit("   "))
        .when(i % 83 == 0, F.lit("None"))
        .when(i % 7 == 0, F.concat(lead, F.regexp_replace("text", "\n", NOISY_LF)))
        .otherwise(F.concat(lead, F.col("text")))
    )
    channel = F.when(i % 3 == 0, F.lit("sms")).otherwise(F.lit("email"))
    sender = F.when(i % 13 == 0, F.lit("no address")).otherwise(
        F.concat(F.lit("User"), i.cast("string"), F.lit("@"), F.col("source"), F.lit(".Example.com")))
    attack = (F.when(F.col("toxic").isNull(), F.lit(None).cast("string"))
              .when(F.col("toxic") == 0, F.lit("benign"))
              .when(channel == "sms", F.lit("smishing"))
              .otherwise(F.lit("phishing")))
    return d.select(
        i.alias("id"),
        F.col("source"),
        channel.alias("channel"),
        body.alias("body"),
        _pick(i % 5, SUBJECTS).alias("subject"),
        sender.alias("sender"),
        F.when(i % 17 == 0, F.lit(None).cast("string")).otherwise(F.lit(RECEIVER)).alias("receiver"),
        _pick(i % 4, DATES).alias("date_raw"),
        attack.alias("attack_label"),
        F.col("toxic").cast("int").alias("label"),
    )


def tab_lines(msg: DataFrame) -> DataFrame:
    """``ham|spam`` TAB body (CR, LF, TAB -> space): the SMS file form."""
    lab = F.when(F.col("attack_label").isin("smishing", "phishing"), F.lit("spam")).otherwise(F.lit("ham"))
    flat = F.regexp_replace(F.coalesce(F.col("body"), F.lit("")), "[\r\n\t]", " ")
    return msg.select(F.col("id").alias("line_no"), F.concat(lab, F.lit("\t"), flat).alias("value"))


def mail_texts(msg: DataFrame) -> DataFrame:
    """RFC-822 style mail text per message: the raw mail CSV form."""
    i = F.col("id")
    text = F.concat(
        F.lit("Message-ID: <"), i.cast("string"), F.lit(".fix@"), F.col("source"), F.lit(">\n"),
        F.lit("Date: "), F.col("date_raw"), F.lit("\n"),
        F.when(i % 19 == 0, F.lit(f"X-From: {X_FROM}\n")).otherwise(F.lit("")),
        F.lit("From: "), F.col("sender"), F.lit("\n"),
        F.lit("To: "), F.coalesce(F.col("receiver"), F.lit("")), F.lit("\n"),
        F.lit("Subject: "), F.coalesce(F.col("subject"), F.lit("")), F.lit("\n"),
        F.lit("\n"),
        F.coalesce(F.col("body"), F.lit("")),
    )
    return msg.select(
        F.concat(F.lit("maildir/"), F.col("source"), F.lit("/"), i.cast("string"), F.lit(".")).alias("file"),
        text.alias("message"),
    )


def mime_texts(msg: DataFrame) -> DataFrame:
    """The messages as encoded mail, in five forms by id: base64, quoted-printable, nested parts,
    alternatives with folded headers, and a text after an image."""
    i, data = F.col("id"), F.coalesce(F.col("body"), F.lit("")).cast("binary")
    coded = F.regexp_replace(F.base64(data), "(.{76})", "$1\n")
    quoted = F.replace(F.regexp_replace(F.regexp_replace(F.hex(data), "(.{48})", "$1\n"), "([0-9A-F]{2})", "=$1"), F.lit("\n"), F.lit("=\n"))
    head = lambda kind, coding: f"Content-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {coding}\n\n"
    html = head("text/html", "quoted-printable") + "<b>=C3=A9</b>\n"
    base, quot = F.concat(F.lit(head("text/plain", "base64")), coded, F.lit("\n")), F.concat(F.lit(head("text/plain", "quoted-printable")), quoted)

    def parts(kind, boundary, *some):
        out = [F.lit(f'Content-Type: multipart/{kind};\n boundary="{boundary}"\n\nno mail reader\n')]
        for x in some:
            out += [F.lit(f"--{boundary}\n"), F.lit(x) if isinstance(x, str) else x, F.lit("\n")]
        return F.concat(*out, F.lit(f"--{boundary}--\n"))

    image = "Content-Type: image/gif\nContent-Transfer-Encoding: base64\n\nR0lGODlh\n"
    content = (F.when(i % 5 == 0, base).when(i % 5 == 1, quot)
               .when(i % 5 == 2, parts("mixed", "outer part", parts("alternative", "inner", html, base), "\nsigned\n"))
               .when(i % 5 == 3, parts("alternative", "alt--", quot, html)).otherwise(parts("mixed", "b", image, base, "\nsigned\n")))
    fold = F.when(i % 5 == 3, F.lit("\n ")).otherwise(F.lit(" "))
    return msg.select(F.concat(
        F.lit("Message-ID: <"), i.cast("string"), F.lit(".fix@"), F.col("source"), F.lit(">\nDate:"), fold, F.col("date_raw"),
        F.lit("\nFrom: "), F.col("sender"), F.lit("\nTo:"), fold, F.coalesce(F.col("receiver"), F.lit("")),
        F.lit("\nMIME-Version: 1.0\n"), content).alias("message"))


# ---------------------------------------------------------------------------
# SQL twin (DuckDB dialect) used by the oracles.
# ---------------------------------------------------------------------------

def _sql_str(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _sql_pick(key, values):
    whens = " ".join(f"WHEN {key} = {k} THEN {_sql_str(v)}" for k, v in enumerate(values))
    return f"CASE {whens} ELSE NULL END"


MSG_SQL = f"""
msg AS (
  SELECT
    d.doc_id AS id,
    d.source AS source,
    CASE WHEN d.doc_id % 3 = 0 THEN 'sms' ELSE 'email' END AS channel,
    CASE
      WHEN d.doc_id % 97 = 0 THEN NULL
      WHEN d.doc_id % 89 = 0 THEN '   '
      WHEN d.doc_id % 83 = 0 THEN 'None'
      WHEN d.doc_id % 7 = 0 THEN coalesce({_sql_pick('d.doc_id % 11', LEADS)}, '')
           || replace(d.text, chr(10), ' ' || chr(13) || chr(10) || chr(9) || chr(10) || chr(10))
      ELSE coalesce({_sql_pick('d.doc_id % 11', LEADS)}, '') || d.text
    END AS body,
    {_sql_pick('d.doc_id % 5', SUBJECTS)} AS subject,
    CASE WHEN d.doc_id % 13 = 0 THEN 'no address'
         ELSE 'User' || CAST(d.doc_id AS VARCHAR) || '@' || d.source || '.Example.com' END AS sender,
    CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE {_sql_str(RECEIVER)} END AS receiver,
    {_sql_pick('d.doc_id % 4', DATES)} AS date_raw,
    CASE WHEN l.toxic IS NULL THEN NULL
         WHEN l.toxic = 0 THEN 'benign'
         WHEN d.doc_id % 3 = 0 THEN 'smishing'
         ELSE 'phishing' END AS attack_label,
    CAST(l.toxic AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

TAB_LINES_SQL = """
tab_lines AS (
  SELECT id AS line_no,
         CASE WHEN attack_label IN ('smishing', 'phishing') THEN 'spam' ELSE 'ham' END
         || chr(9) || regexp_replace(coalesce(body, ''), '[\\r\\n\\t]', ' ', 'g') AS value
  FROM msg
)"""

MAIL_TEXTS_SQL = f"""
mail_texts AS (
  SELECT 'maildir/' || source || '/' || CAST(id AS VARCHAR) || '.' AS file,
         'Message-ID: <' || CAST(id AS VARCHAR) || '.fix@' || source || '>' || chr(10)
         || 'Date: ' || date_raw || chr(10)
         || CASE WHEN id % 19 = 0 THEN 'X-From: {X_FROM}' || chr(10) ELSE '' END
         || 'From: ' || sender || chr(10)
         || 'To: ' || coalesce(receiver, '') || chr(10)
         || 'Subject: ' || coalesce(subject, '') || chr(10)
         || chr(10)
         || coalesce(body, '') AS message
  FROM msg
)"""


def with_ctes(*ctes: str, body: str) -> str:
    """``WITH cte1, cte2 ... body`` (msg always first)."""
    return "WITH " + ",\n".join((MSG_SQL,) + ctes) + "\n" + body
