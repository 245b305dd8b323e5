"""Readers of log lines, bodies and labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logloom.functions import parse
from logloom.functions.text import WS
from logloom.ship import ship


def not_blank(line: Column) -> Column:
    return line.rlike(rf"[^{WS}]")


def body_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds line_index (over lines that aren't blank) and line; line ends are LF, one CR before it goes."""
    each = bodies.select("*", F.posexplode(F.filter(F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")), not_blank)).alias("line_index", "line"))
    return each.withColumn("line_index", F.col("line_index").cast("long")).drop(body)


def parse_lines(lines: DataFrame, form: str = "text", strict: bool = False, line: str = "line") -> DataFrame:
    """Replaces line by message, level, timestamp. ndjson lines that are rejected go, or fail if strict."""
    if form == "text":
        out = lines.withColumn("_p", parse.parse_line(F.col(line)))
    else:
        ship(lines.sparkSession)
        out = lines.withColumn("_p", parse.parse_json_line(F.col(line)))
        if strict:
            bad = F.raise_error(F.lit("invalid ndjson log line"))
            out = out.withColumn("_p", F.when(F.col("_p.message").isNotNull(), F.col("_p")).otherwise(bad.cast(parse.SCHEMA_STRUCT)))
        else:
            out = out.where("_p.message is not null")
    return out.select(*(c for c in lines.columns if c != line), "_p.message", "_p.level", "_p.timestamp")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(line_index, line) of text files; blank lines go. The index rises with the splits of the files and
    the lines in them and has gaps."""
    rows = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r\z", "").alias("line"), F.monotonically_increasing_id().alias("place"))
    return rows.where(not_blank(F.col("line"))).select(F.col("place").alias("line_index"), "line")


def read_structured_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(line_index, content, template) of a labelled CSV with columns Content and EventTemplate; rows
    without both go, ragged ones stay, empty fields are empty strings."""
    how = dict(header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=True)
    names = spark.read.csv(path, **how).columns
    schema = StructType([StructField(n, StringType()) for n in [*names, "_bad"]])
    raw = spark.read.csv(path, schema=schema, columnNameOfCorruptRecord="_bad", enforceSchema=True, **how)
    # the reader gives null for an empty field and for one that a short row lacks
    short = F.col("_bad").isNotNull() & F.col(f"`{names[-1]}`").isNull()

    def field(name: str) -> Column:
        there = ~short | F.coalesce(*(F.col(f"`{n}`") for n in names[names.index(name) :])).isNotNull()
        return F.when(there, F.coalesce(F.col(f"`{name}`"), F.lit("")))

    rows = raw.select(F.monotonically_increasing_id().alias("line_index"), field("Content").alias("content"), field("EventTemplate").alias("template")).where("content is not null and template is not null")
    return rows if most is None else rows.orderBy("line_index").limit(most)


def read_labelled_jsonl(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(line_index, content, template): the quoted lines of each prompt with the row's template. A row
    that is malformed fails the read."""
    ship(spark)
    raw = spark.read.schema("_oracle_template string, messages array<struct<content:string>>").json(path, mode="FAILFAST")
    checked = raw.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce("_oracle_template", F.raise_error(F.lit("row without a template")).cast("string")).alias("template"),
        F.coalesce(F.get("messages", F.lit(0))["content"], F.raise_error(F.lit("row without a prompt")).cast("string")).alias("prompt"),
    )
    each = checked.select("row", "template", F.posexplode(parse.parse_quoted_list("prompt")).alias("pos", "content"))
    rows = each.select((F.col("row") * F.lit(1 << 20) + F.col("pos")).alias("line_index"), "content", "template")
    return rows if most is None else rows.orderBy("line_index").limit(most)


#: The lines of the generator and what their fields cycle through.
SYNTHETIC_LINES = (
    "Dec 10 07:07:38 LabSZ sshd[24206]: input_userauth_request: invalid user {user} [preauth]",
    "Dec 10 09:12:32 LabSZ sshd[24490]: Failed password for invalid user {user} from 0.0.0.0 port {port} ssh2",
    "Dec 10 06:55:46 LabSZ sshd[24200]: reverse mapping checking getaddrinfo for {host} failed - POSSIBLE BREAK-IN ATTEMPT!",
    "Dec 10 10:30:01 LabSZ CRON[25455]: pam_unix(cron:session): session opened for user {user} by (uid=0)",
    "Dec 10 10:30:01 LabSZ CRON[25455]: pam_unix(cron:session): session closed for user {user}",
    "Dec 10 11:03:44 LabSZ sshd[25500]: Accepted publickey for {user} from 192.168.1.{ip} port {port} ssh2",
    "Dec 10 11:03:44 LabSZ sshd[25500]: pam_unix(sshd:session): session opened for user {user} by (uid=0)",
    "Dec 10 12:00:00 LabSZ kernel: [UFW BLOCK] IN=eth0 OUT= MAC=00:00:00:00:00:00 SRC=10.0.0.{ip} DST=192.168.1.1 PROTO=TCP SPT={port} DPT=22",
)
SYNTHETIC_USERS = ("root", "admin", "test", "ftpuser", "postgres", "www-data", "pi", "ubuntu")
SYNTHETIC_HOSTS = ("scanner1.example.com", "attacker.evil.org", "probe.test.net")


def synthetic_lines(spark: SparkSession, n: int) -> DataFrame:
    """(line_index, message): n generated lines."""
    i = F.col("id")
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(i, F.lit(len(options))) + 1).cast("int"))
    message = pick(SYNTHETIC_LINES)
    for name, value in (("user", pick(SYNTHETIC_USERS)), ("port", (10_000 + i % 55_000).cast("string")), ("ip", (1 + i % 254).cast("string")), ("host", pick(SYNTHETIC_HOSTS))):
        message = F.replace(message, F.lit(f"{{{name}}}"), value)
    return spark.range(n).select(i.alias("line_index"), message.alias("message"))
