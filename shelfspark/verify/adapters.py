"""The driver tables seen as archive tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..operators.sizing import shuffled, spread_scan

NOW = "2024-02-01 00:00:00"
TYPE_BY_REST = ("rule", "decision", "feature", "guide", "map", "pitfall")
SCOPE_BY_REST = ("repo", "global", "dev")
SEVERITY_BY_REST = ("must", "must-not", "should", "should-not")
COMMAND_BY_EVENT = {"view": "search", "click": "get", "purchase": "cite", "signup": "remember", "error": "check"}


#: Tables with costly rows (long texts, many pieces) and their key.
SPREAD = {"documents": "doc_id", "pages": "page_id", "part": "p_partkey"}


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Tables:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC times

    def raw(self, name: str) -> DataFrame:
        """A driver table; zone-less times become timestamps."""
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        times = [f.name for f in table.schema if f.dataType.simpleString() == "timestamp_ntz"]
        if name in SPREAD:
            table = spread_scan(table, SPREAD[name])
        return table.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else table

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @cached_property
    def records(self) -> DataFrame:
        doc = F.col("doc_id")
        n = (1 + doc % 25).cast("string")
        base = self.documents.join(self.raw("labels"), "doc_id", "left").select(
            F.concat(F.lit("rec_"), doc.cast("string")).alias("id"),
            F.when(doc % 3 == 0, "").otherwise(F.col("source")).alias("checkout"),
            F.concat(F.lit("doc-"), (doc % 60).cast("string")).alias("slug"),
            _pick(doc % 6, TYPE_BY_REST).alias("type"),
            _pick(F.floor(doc / 7) % 3, SCOPE_BY_REST).alias("scope"),
            F.substr("text", F.lit(1), F.lit(80)).alias("title"),
            F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "superseded")
            .otherwise("accepted").alias("status"),
            F.when(doc % 6 == 0, _pick(F.floor(doc / 6) % 4, SEVERITY_BY_REST)).alias("severity"),
            F.col("text").alias("body"),
            F.concat(F.lit("records/"), doc.cast("string"), F.lit(".md")).alias("source_path"),
            F.array("lang", "source").alias("tags"),
            F.when(doc % 20 == 3, F.array(F.lit("missing/**")))
            .when(doc % 4 == 0, F.array().cast("array<string>"))
            .when(doc % 4 == 1, F.array(F.concat(F.lit("Brand#"), n, F.lit("/**"))))
            .when(doc % 4 == 2, F.array(F.concat(F.lit("*"), (doc % 10).cast("string"))))
            .otherwise(F.array(F.concat(F.lit("Brand#"), n, F.lit("/?")))).alias("applies_to"),
            F.array().cast("array<string>").alias("supersedes"),
            F.lit(None).cast("string").alias("superseded_by"),
            F.lit(None).cast("string").alias("provenance_commit"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(doc % 10000).cast("int"))).alias("created_at"),
        )
        return R.with_content_hash(base).withColumn("updated_at", F.col("created_at"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.concat(F.lit("rec_"), F.col("vec_id").cast("string")).alias("record_id"),
            F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"),
            F.lit(64).alias("dim"), "embedding",
        )

    @cached_property
    def queries(self) -> DataFrame:
        emb = self.raw("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), "text").join(emb, "query_id", "left")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.raw("part").select(
            F.lit("main").alias("checkout"),
            F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("file_path"),
            F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"),
            F.col("p_size").alias("line"), F.concat_ws(" ", "p_type", "p_name").alias("doc"),
            (F.col("p_partkey") % 2 == 0).alias("exported"),
        )

    @cached_property
    def brand_symbols(self) -> DataFrame:
        """The same symbols, with every brand one file of many symbols."""
        return self.symbols.withColumn("file_path", F.substring_index("file_path", "/", 1))

    @cached_property
    def files(self) -> DataFrame:
        return self.raw("part").select(
            F.lit("main").alias("checkout"),
            F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
            F.sha2(F.col("p_name"), 256).alias("content_hash"), F.lower("p_type").alias("package_name"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.raw("pages").select(
            "page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"), "html"
        )

    @cached_property
    def edges(self) -> DataFrame:
        return self.pages.select(
            F.lit("web").alias("checkout"), F.col("path").alias("from_file"),
            F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("to_path"),
            F.lit("import").alias("edge_type"),
        )

    @cached_property
    def commits(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderstatus").alias("checkout"), F.col("o_orderkey").cast("string").alias("hash"),
            F.col("o_orderpriority").alias("subject"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("body"),
            F.col("o_custkey").cast("string").alias("author"), F.col("o_orderdate").alias("authored_at"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Changed paths of every commit: the parts of an order."""
        parts = self.raw("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
        )
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("at"))
        return (
            # orders last: what is dealt by change already is made distinct where it lies
            self.raw("lineitem").select("l_orderkey", "l_partkey").join(shuffled(parts), "l_partkey").join(shuffled(orders), "l_orderkey")
            .select(F.lit("").alias("checkout"), F.col("l_orderkey").alias("change_id"), "at", "path").distinct()
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Completed calls: seq is the position in the log."""
        command = F.create_map(*[F.lit(x) for kv in COMMAND_BY_EVENT.items() for x in kv])
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("checkout"), F.col("event_id").alias("seq"),
            command[F.col("event_type")].alias("name"), F.col("ts").alias("at"),
            F.unix_micros("ts").alias("at_us"),
            F.concat(F.lit("rec_"), F.get_json_object("props", "$.k")).alias("hit_id"), F.lit(True).alias("has_out"),
        )

    @cached_property
    def in_out(self) -> DataFrame:
        """Id-less log lines: a view, signup or purchase opens, a click or error closes."""
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("checkout"), F.col("event_id").alias("line_no"),
            F.lit("").alias("id"), F.lit("search").alias("name"),
            F.when(F.col("event_type").isin("click", "error"), "out").otherwise("in").alias("dir"), F.col("ts"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """Edges from customers: every kind, some to records that do not exist."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            _pick(key % 3, ("pin", "record", "repo")).alias("kind"),
            F.when(key % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("from_checkout"),
            F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("rec_"), key.cast("string"))).alias("from_id"),
            F.col("c_mktsegment").alias("to_root"),
            F.when(key % 3 == 2, "").otherwise(F.concat(F.lit("rec_"), (key * 2).cast("string"))).alias("to_id"),
        )


def _case(expr: str, values) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# The same views for the oracle.  Each entry: name -> (needed views, body).
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_records": ((), f"""
        SELECT *, sha256(type || scope || title || status || coalesce(severity, '') || body
            || array_to_string(tags, '') || array_to_string(applies_to, '')) AS content_hash
        FROM (SELECT 'rec_' || d.doc_id AS id, d.doc_id AS doc_id,
            CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END AS checkout,
            'doc-' || (d.doc_id % 60) AS slug,
            {_case('d.doc_id % 6', TYPE_BY_REST)} AS type,
            {_case('(d.doc_id // 7) % 3', SCOPE_BY_REST)} AS scope,
            substr(d.text, 1, 80) AS title,
            CASE WHEN l.toxic = 1 THEN 'deprecated' WHEN l.quality = 0 THEN 'superseded' ELSE 'accepted' END AS status,
            CASE WHEN d.doc_id % 6 = 0 THEN {_case('(d.doc_id // 6) % 4', SEVERITY_BY_REST)} END AS severity,
            d.text AS body, 'records/' || d.doc_id || '.md' AS source_path, [d.lang, d.source] AS tags,
            CASE WHEN d.doc_id % 20 = 3 THEN ['missing/**'] WHEN d.doc_id % 4 = 0 THEN []::VARCHAR[]
                WHEN d.doc_id % 4 = 1 THEN ['Brand#' || (1 + d.doc_id % 25) || '/**']
                WHEN d.doc_id % 4 = 2 THEN ['*' || (d.doc_id % 10)]
                ELSE ['Brand#' || (1 + d.doc_id % 25) || '/?'] END AS applies_to,
            TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id % 10000 AS INTEGER)) AS created_at
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""),
    "v_current": (("v_records",), "SELECT * FROM v_records WHERE status NOT IN ('superseded', 'deprecated')"),
    "v_vectors": ((), "SELECT 'rec_' || vec_id AS record_id, 'm' || (label % 2) AS model, 64 AS dim, "
                      "embedding::DOUBLE[] AS embedding FROM embeddings"),
    "v_queries": ((), "SELECT b.item_id AS query_id, b.text, e.embedding::DOUBLE[] AS embedding "
                      "FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"),
    "v_symbols": ((), "SELECT 'main' AS checkout, p_brand || '/' || p_partkey AS file_path, p_brand AS brand, "
                      "p_partkey AS seq, p_name AS name, p_type AS kind, p_size AS line, "
                      "p_type || ' ' || p_name AS doc, p_partkey % 2 = 0 AS exported, lower(p_type) AS package_name FROM part"),
    "v_pages": ((), r"SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path, html FROM pages"),
    "v_edges": (("v_pages",), "SELECT path AS from_file, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS to_path, "
                              "'import' AS edge_type FROM v_pages"),
    "v_commits": ((), "SELECT o_orderstatus AS checkout, CAST(o_orderkey AS VARCHAR) AS hash, o_orderpriority AS subject, "
                      "o_orderstatus || ' ' || o_orderpriority AS body, o_orderdate AS authored_at FROM orders"),
    "v_changes": ((), "SELECT DISTINCT l.l_orderkey AS change_id, o.o_orderdate AS changed_at, p.p_brand || '/' || p.p_partkey AS path "
                      "FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey"),
    "v_calls": ((), "SELECT CAST(user_id AS VARCHAR) AS checkout, event_id AS seq, CASE event_type "
                    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMAND_BY_EVENT.items())
                    + " END AS name, ts AS called_at, epoch_us(ts) AS at_us, 'rec_' || json_extract_string(props, '$.k') AS hit_id FROM events"),
    "v_in_out": ((), "SELECT CAST(user_id AS VARCHAR) AS checkout, event_id AS line_no, "
                     "CASE WHEN event_type IN ('click', 'error') THEN 'out' ELSE 'in' END AS dir, ts FROM events"),
    "v_links": ((), "SELECT CASE c_custkey % 3 WHEN 0 THEN 'pin' WHEN 1 THEN 'record' ELSE 'repo' END AS kind, "
                    "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS from_checkout, "
                    "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'rec_' || c_custkey END AS from_id, c_mktsegment AS to_root, "
                    "CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'rec_' || (c_custkey * 2) END AS to_id FROM customer"),
}

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.C.STOPWORDS) + "]"
WORD_SQL = r"'[\p{L}\p{N}]+'"


def fold_sql(expr: str) -> str:
    return f"translate(lower({expr}), '{X.FOLD_FROM}', '{X.FOLD_TO}')"


def ascii_sql(expr: str) -> str:
    return f"translate({expr}, '{X.UPPER}', '{X.LOWER}')"


def contains_sql(text: str, term: str) -> str:
    return f"contains({ascii_sql(text)}, {ascii_sql(term)})"


def glob_sql(path: str, pattern: str) -> str:
    """Glob match for patterns made of literals, ``*``, ``?`` and one trailing ``/**``."""
    def regex(p: str) -> str:
        return f"'^' || replace(replace(replace({p}, '**', '*'), '*', '[^/]*'), '?', '[^/]') || '$'"

    prefix = f"split_part({pattern}, '/**', 1)"
    base = f"regexp_extract({path}, '([^/]*)$', 1)"
    return (
        f"(regexp_matches({path}, {regex(pattern)}) OR regexp_matches({base}, {regex(pattern)}) OR "
        f"({pattern} LIKE '%/**' AND ({path} = {prefix} OR starts_with({path}, {prefix} || '/'))))"
    )


def with_views(names: str, body: str) -> str:
    """``WITH`` clause of the named views and whatever they need, then ``body``.

    ``body`` may start with further ``name AS (...)`` definitions, separated
    from the final SELECT by a line holding ``--``.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in SQL_VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered]
    if "\n--\n" in body:
        extra, body = body.split("\n--\n")
        parts.append(extra.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + body.strip() if parts else body.strip()
