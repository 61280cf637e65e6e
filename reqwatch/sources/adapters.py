"""Views of the test tables in the engine's own shapes.

Each view is plain column arithmetic, so the same view can be said in SQL (see plans.views).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
#: Labels of the event types, and levels; low for the rest.
LABELS = {"signup": "SQL Injection UNION", "error": "XSS Script Tag", "click": "Directory Traversal", "view": "Command Downloader", "purchase": "RCE Shell Function"}
LEVELS = {"error": "high", "purchase": "medium"}
AGENTS = ("Mozilla/5.0 (X11; Linux) Gecko/20100101 Firefox/120.0", "sqlmap/1.7", "curl/8.1", "Mozilla/5.0 (KHTML, like Gecko) HeadlessChrome/120.0", "Mozilla/5.0 (compatible; GPTBot/1.0) like Gecko", "python-requests/2.31", "", "Nikto/2.5 masscan", "-", "Mozilla/5.0 HeadlessChrome/120.0")
PATHS = ("/wp-admin", "/wp-content/x.php", "/.env", "/.GIT/config", "/old/page.aspx", "/actuator/health", "/shop/item", "/backup/2024", "/api/v1/users/7", "/vendor/phpunit/x")
PROVIDERS = ("Amazon.com Inc", "Microsoft Azure", "Local Telecom", "Hetzner Online", "DigitalOcean LLC", "City Cable", "OVH SAS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """df, dealt over all cores if its files give fewer tasks than that; larger tables stay as they are read.

    files: of a stream, the table that it reads.
    """
    cores, read = df.sparkSession.sparkContext.defaultParallelism, df if files is None else files
    return df.repartition(cores) if read.rdd.getNumPartitions() < cores else df


def pick(values: tuple[str, ...], number) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def threat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log rows without geo columns."""
    return _as_logs(table(spark, sf_dir, "events"))


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream, their time a timestamp, as watermarks want it."""
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")  # a glob may be one file or a folder
    return _as_logs(stream.withColumn("ts", F.col("ts").cast("timestamp")))


def _as_logs(e: DataFrame) -> DataFrame:
    user = F.col("user_id")
    label, level = F.lit(None), F.lit("low")
    for k, v in LABELS.items():
        label = F.when(F.col("event_type") == k, v).otherwise(label)
    for k, v in LEVELS.items():
        level = F.when(F.col("event_type") == k, v).otherwise(level)
    score = (20 + F.col("event_id") % 6 * 15).cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.format_string("10.0.%d.%d", F.floor(user / 256), user % 256).alias("ip_address"), F.concat(F.lit("https://shop.example.com/"), "event_type", F.lit("/"), (user % 20).cast("string")).alias("url"),
        pick(AGENTS, F.col("event_id")).alias("user_agent"), F.concat(F.lit("[middleware] "), label).alias("type"), F.col("props").alias("payload"), level.alias("threat_level"), score.alias("confidence_score"),
        F.when(score >= 76, "very_high").when(score >= 51, "high").when(score >= 26, "medium").otherwise("low").alias("confidence_label"), (F.col("event_id") % 50 == 0).alias("is_false_positive"), F.lit("logged").alias("action_taken"),
        user.alias("user_id"), F.col("ts").alias("created_at"),
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: a path, an agent and an address, no query and no body."""
    return _as_requests(table(spark, sf_dir, "events"))


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream."""
    files = table(spark, sf_dir, "events")
    stream = spread(spark.readStream.schema(files.schema).parquet(f"{sf_dir}/events.parque[t]"), files)
    return _as_requests(stream.withColumn("ts", F.col("ts").cast("timestamp")))


def _as_requests(e: DataFrame, *more: str) -> DataFrame:
    user, n = F.col("user_id"), F.col("event_id")
    path = F.when(n % 10 == 3, pick(PATHS, F.floor(n / 10))).otherwise(F.concat(F.lit("/"), "event_type", F.lit("/"), (user % 20).cast("string")))
    return e.select(
        n.alias("request_id"), F.col("ts"), F.format_string("10.0.%d.%d", F.floor(user / 256), user % 256).alias("ip_address"), F.lit("GET").alias("method"), path.alias("path"), F.lit("").alias("query_string"),
        F.lit("").alias("content_type"), F.lit(0).cast("long").alias("content_length"), F.lit("").alias("body"), F.lit(None).cast("map<string,array<string>>").alias("headers"), pick(AGENTS, n).alias("user_agent"), user.alias("user_id"),
        F.concat(F.lit("https://shop.example.com"), path).alias("url"), *more,
    )


def full_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests with a query, headers, and a body in JSON, as a form or in parts, one of which is a file."""
    e = table(spark, sf_dir, "events")
    kind, user, id_ = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id")
    part = lambda name, value: F.concat(F.lit(f'--cut\r\nContent-Disposition: form-data; name="{name}"\r\n\r\n'), value, F.lit("\r\n"))
    bodies = [
        ("application/json", F.concat(F.lit('{"user": {"id": '), user, F.lit(', "pin": "12"}, "props": '), "props", F.lit("}"))),
        ("application/x-www-form-urlencoded", F.concat(F.lit("note=a+"), kind, F.lit("%21&k[of]="), user)),
        ("multipart/form-data; boundary=cut", F.concat(part("note", kind), part('up"; filename="x.php', F.lit("<?php system(1) ?>")), F.lit("--cut--\r\n"))),
    ]
    third = lambda k: F.when(id_ % 3 == 0, bodies[0][k]).when(id_ % 3 == 1, bodies[1][k]).otherwise(bodies[2][k])
    query = F.concat(F.lit("kind="), kind, F.lit("&tags[]="), user, F.lit("&tags[]=%41+b&token="), id_.cast("string"))
    headers = F.create_map(F.lit("x-kind"), F.array(kind, user, F.lit("more")), F.lit("Cookie"), F.array(F.lit("c=1")))
    out = _as_requests(e.select("event_id", "ts", "user_id", "event_type", query.alias("_query"), headers.alias("_headers"), third(1).alias("_body"), third(0).alias("_type")), "_query", "_headers", "_body", "_type")
    renamed = {"query_string": F.col("_query"), "headers": F.col("_headers"), "body": F.col("_body"), "content_type": F.col("_type"), "content_length": F.octet_length("_body").cast("long"), "method": F.lit("POST")}
    return out.withColumns(renamed).drop("_query", "_headers", "_body", "_type")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ip_address, country_code, country_name, city, isp, org): made-up places of the events' addresses; every seventh has none."""
    user = F.col("user_id")
    ips = table(spark, sf_dir, "events").select("user_id").distinct().where(user % 7 != 0)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    out = ips.join(F.broadcast(nation), user % 25 == F.col("n_nationkey"))  # 25 nations
    return out.select(
        F.format_string("10.0.%d.%d", F.floor(user / 256), user % 256).alias("ip_address"), F.substring(F.upper("n_name"), 1, 2).alias("country_code"), F.col("n_name").alias("country_name"),
        F.concat(F.lit("City "), (user % 9).cast("string")).alias("city"), pick(PROVIDERS, user).alias("isp"), F.lit("").alias("org"),
    )


def exclusion_rules(spark: SparkSession) -> DataFrame:
    """A few literal rules: anywhere, by path, inactive, and a label that is only part of another."""
    rows = [(1, "XSS Script Tag", None, True, 10), (2, "Directory Traversal", "click/1*", True, 20), (3, "Command Downloader", "view/*", False, None), (4, "SQL", None, True, 99_999_999), (5, "RCE Shell Function", "purchase/?", True, None)]
    return spark.createDataFrame(rows, "id long, pattern_label string, path_pattern string, is_active boolean, created_from_threat_id long")


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as requests: path and query from the url, the html as a form body."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/"))
    return p.select(
        n.alias("request_id"), F.timestamp_seconds(1704067200 + n).alias("ts"), F.format_string("203.0.113.%d", n % 250).alias("ip_address"), F.lit("POST").alias("method"), F.when(n % 10 == 3, pick(PATHS, F.floor(n / 10))).otherwise(path).alias("path"),
        F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")).alias("query_string"), F.lit("application/x-www-form-urlencoded").alias("content_type"), F.octet_length("html").cast("long").alias("content_length"),
        F.concat(F.lit("html="), F.col("html")).alias("body"), F.create_map(F.lit("x-page"), F.array(n.cast("string"))).alias("headers"), pick(AGENTS, n).alias("user_agent"), F.lit(None).cast("long").alias("user_id"), F.col("url"),
    )
