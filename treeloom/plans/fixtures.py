"""Views derived from the given tables, for the registered queries.

Each grows with its source table. ``treeloom.plans.oracle`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stem() -> F.Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/mod_"), F.col("doc_id").cast("string"))


# Extension by document number.
EXTENSIONS = [".js", ".ts", ".jsx", ".py", ".css", ".html"]


def _ext() -> F.Column:
    return F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 6 + 1).cast("int"))


def inventory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File facts only; document text is not read."""
    return table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("repo"),
        "doc_id",
        F.concat(_stem(), _ext()).alias("relative_path"),
        F.col("n_chars").cast("long").alias("size"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias(
            "last_modified"
        ),
    )


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with content: imports that form chains and rings, classes, routes, rules; each holds its document's
    whole text, as a comment at the end or, in pages, as the content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    total = docs.agg(F.count("*")).scalar()
    stems = docs.select(F.col("doc_id").alias("target"), _stem().alias("target_stem"))
    ring = stems.select(F.col("target").alias("t2"), F.col("target_stem").alias("s2"))
    chain = stems.select(F.col("target").alias("t1"), F.col("target_stem").alias("s1"))
    first = F.col("doc_id") - F.col("doc_id") % 60
    # Targets are looked up per number and without the text, so that the text is shuffled once only.
    targets = (
        docs.select("doc_id")
        .distinct()
        .withColumns(
            {
                # Chains run into earlier blocks, so only rings are cycles; the first block imports itself instead.
                "t1": F.when(first == 0, F.col("doc_id")).otherwise((F.col("doc_id") * 7 + 3) % first),
                # Rings of ten, in blocks of sixty documents.
                "t2": (first + (F.col("doc_id") % 60 + 6) % 60) % total,
            }
        )
        .join(chain, "t1", "left")
        .join(ring, "t2", "left")
        .select("doc_id", "s1", "s2")
    )
    base = docs.withColumns({"ext": _ext(), "stem": _stem(), "id": F.col("doc_id").cast("string")})
    joined = base.join(targets, "doc_id", "left")

    def mod(n: int) -> F.Column:
        return (F.col("doc_id") % n).cast("string")

    def lines(*parts) -> F.Column:
        return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])

    script = lines(
        "import { a } from '../../", F.col("s1"), "'\nconst z = require('../../", F.col("s2"), "')\n",
        "import react from 'react'\nlet state", mod(5), " = 0\n",
        "export function f", F.col("id"), "(x) { if (x) { return fetch('/api/", mod(9), "') } }\n",
        "async function load", mod(7), "({a}, b) { // load ", F.col("lang"), "\n  try { await z(a) } finally { b() } }\n",
        "function go", F.col("id"), "(q) { /* walk ", F.col("source"), " */\n  const el = document.querySelector('#n", mod(3),
        "')\n  q.map(p => { return p }) }\n",
        "const h", F.col("id"), " = (e) => e + 1\nel.addEventListener('click', go", F.col("id"), ")\n",
        "/*\n", F.col("text"), "\n*/\n",
    )
    python = lines(
        "import os\nfrom pkg.m", mod(11), " import g\nclass C", F.col("id"), "(Base):\n    \"\"\"Doc ", F.col("lang"), " ",
        F.col("id"), "\"\"\"\n    def run(self):\n        # step ", mod(4), "\n        for i in self.items: pass\n",
        "        self.n = 1\n        return self.n\n@app.route('/r/", mod(20), "', methods=['POST'])\n",
        "def handler():\n    return jsonify({})\n",
        F.when(F.col("doc_id") % 4 == 3, F.lit("def broken(:\n")).otherwise(F.lit("")),
        "# ", F.replace("text", F.lit("\n"), F.lit("\n# ")), "\n",
    )
    style = lines(
        ".card-", mod(13), " { display: flex; padding: ", mod(4), ".5rem; color: #a", mod(10), "b; }\n",
        ".card-", mod(13), " { background-color: rgb(", mod(9), ", 0, 1); font-family: Font", mod(3), ", serif; }\n",
        ".x", F.col("id"), " { left: 10rem; }\n@media (max-width: 600px) { }",
        "\n/*\n", F.col("text"), "\n*/\n",
    )
    content = (
        F.when(F.col("ext").isin(".js", ".ts", ".jsx"), script)
        .when(F.col("ext") == ".py", python)
        .when(F.col("ext") == ".css", style)
        .otherwise(F.col("text"))
    )
    return joined.select(
        F.lit("corpus").alias("repo"),
        "doc_id",
        F.concat("stem", "ext").alias("relative_path"),
        F.col("ext").alias("extension"),
        content.alias("content"),
    )


def sized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with byte size and modification time."""
    return src_files(spark, sf_dir).withColumns(
        {
            "size": F.octet_length("content").cast("long"),
            "last_modified": F.lit("2024-01-01 00:00:00").cast("timestamp")
            + F.make_dt_interval(mins=F.col("doc_id").cast("int")),
        }
    )


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file with its whole text."""
    return table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("repo"),
        "doc_id",
        F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias(
            "last_modified"
        ),
    )


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of good quality: leaves some import targets out."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return inventory_files(spark, sf_dir).join(good, "doc_id", "left_semi").select("repo", "relative_path")


def raw_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfiltered paths with folders and files that a scan skips, and some oversized files."""
    d = F.col("doc_id")
    num = d.cast("string")
    pair = F.floor(d / 8).cast("string")
    folder = (
        F.when((d % 8).isin(5, 6), F.lit("shared/"))
        .when(d % 9 == 0, F.lit(".git/")).when(d % 9 == 1, F.lit("node_modules/"))
        .when(d % 9 == 2, F.lit("Build/")).when(d % 9 == 3, F.lit("build/"))
        .when(d % 9 == 4, F.lit("")).otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/")))
    )
    base = (
        F.when(d % 8 == 0, F.concat(F.lit(".env"), num))
        .when(d % 8 == 1, F.concat(F.lit("package-lock"), num, F.lit(".json")))
        .when(d % 8 == 2, F.concat(F.lit("Lock"), num, F.lit(".YAML")))
        .when(d % 8 == 3, F.concat(F.lit("yarn"), num, F.lit(".lock")))
        .when(d % 8 == 4, F.concat(F.lit("m"), num, F.lit("/Makefile")))
        .when(d % 8 == 5, F.concat(F.lit("a-b"), pair, F.lit(".py")))
        .when(d % 8 == 6, F.concat(F.lit("a_b"), pair, F.lit(".py")))
        .otherwise(F.concat(F.lit("x."), num, F.lit(".tar.GZ")))
    )
    return table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("repo"),
        "doc_id",
        F.concat(folder, base).alias("relative_path"),
        (F.col("n_chars") * 1000).cast("long").alias("size"),
    )


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call log: five models, failures where the event is an error."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model_name"),
        (F.col("event_type") != "error").alias("success"),
        # Exact sums do not depend on the order of addition.
        F.col("value").cast("decimal(18,4)").alias("response_time"),
        F.get_json_object("props", "$.k").cast("int").alias("complexity"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def call_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call log as a stream."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select(
        "event_id",
        F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model_name"),
        (F.col("event_type") != "error").alias("success"),
        # Exact sums do not depend on the order of addition.
        F.col("value").cast("decimal(18,4)").alias("response_time"),
        F.get_json_object("props", "$.k").cast("int").alias("complexity"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def diagram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diagram per source with one line per document, right and wrong ones."""
    d = F.col("doc_id")
    num = d.cast("string")
    small = (d % 40).cast("string")
    kind = (d * 7 + F.floor(d / 20)) % 12
    shapes = [
        F.concat(F.lit("subgraph S_"), num),
        F.concat(F.lit("  n"), small, F.lit("["), "lang", F.lit("]")),
        F.concat(F.lit("n"), num, F.lit("(r) --> n"), (d + 1).cast("string")),
        F.lit("end"),
        F.concat(F.lit("n"), small, F.lit(" --> x."), num, F.lit(" label")),
        F.concat(F.lit("classDef c"), num, F.lit(" fill:#f9f,stroke:#12,bare,stroke-width:x2,")),
        F.lit("classDef a fill:red classDef b"),
        F.concat(F.lit("n"), num, F.lit("-->n1")),
        F.concat(F.lit("%% note "), num),
        F.concat(F.lit("n"), small, F.lit("_"), (d % 3).cast("string"), F.lit("{open[}")),
        F.concat(F.lit("subgraph bad name"), num),
        F.concat(F.lit("pie --> graph "), num),
    ]
    line = F.element_at(F.array(*shapes), (kind + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("diagram_id"), d.alias("line_no"), line.alias("line")
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to selection prompts: plain JSON, fenced JSON, text, JSON followed by text; all hold the turn's whole text."""
    c = F.col("conv_id")
    whole = F.coalesce("text", F.lit(""))
    quoted = F.regexp_extract(F.to_json(F.struct(whole.alias("t"))), r'(?s)\A\{"t":(.*)\}\z', 1)
    num = c.cast("string")
    fence = "```"
    shapes = [
        F.concat(F.lit('{"files":[{"file_id":"src0_en_mod_'), num, F.lit('_js","reason":"r","confidence":0.'), (c % 10).cast("string"),
                 F.lit('},{"file_id":"nope"}],"reasoning":'), quoted, F.lit(',"confidence":0.8}')),
        F.concat(F.lit(f"{fence}json\n"), F.lit('{"files":[],"reasoning":'), quoted, F.lit(',"confidence":0.5}'), F.lit(f"\n{fence}\n")),
        whole,
        F.concat(F.lit('{"files":[],"reasoning":"z","confidence":0.4} '), whole, F.lit(".")),
        F.concat(F.lit('{"confidence":0.25,"more":'), quoted, F.lit("}")),
    ]
    return table(spark, sf_dir, "conversations").select(
        (c * 100 + F.col("turn")).alias("reply_id"), F.element_at(F.array(*shapes), (c % 5 + 1).cast("int")).alias("reply")
    )


def bundle_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle per source; every tenth file asked for does not exist."""
    gone = F.concat(F.lit("gone/"), F.col("doc_id").cast("string"))
    files = inventory_files(spark, sf_dir)
    return files.select(
        F.substring_index("relative_path", "/", 1).alias("bundle_id"),
        (F.col("doc_id") + 1).alias("position"),
        "repo",
        F.when(F.col("doc_id") % 10 == 9, gone).otherwise(F.col("relative_path")).alias("relative_path"),
    )


def markdown_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles as received from outside: two fenced files and a section without a fence."""
    num = F.col("doc_id").cast("string")
    fence = "```"
    body = F.concat(
        F.lit("# Title\n## a/"), num, F.lit(f".js\n\n{fence}JavaScript\nlet x = "), num, F.lit(f"\n{fence}\n---\n## notes\nno code\n## b "),
        num, F.lit(f".md \n**Size:** 1\n{fence}md\n"), "text", F.lit(f"\n{fence}\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


def encoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document bytes in several encodings."""
    k = F.col("doc_id") % 4
    utf8 = F.encode("text", "UTF-8")
    mark = F.lit(bytearray(b"\xef\xbb\xbf"))
    content = (
        F.when(k == 0, utf8).when(k == 1, F.concat(mark, utf8))
        .when(k == 2, F.encode("text", "UTF-16")).otherwise(F.concat(utf8, F.lit(bytearray(b"\xe9 "))))
    )
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def routing(spark: SparkSession) -> DataFrame:
    """Routing table: candidates per task in order; an empty subtask is the general rule."""
    rows = [
        ("documentation", "architecture", ["model_3", "model_0", "model_1"]),
        ("documentation", "readme", ["model_4", "", "model_2"]),
        ("documentation", "", ["model_0", "model_1"]),
        ("analysis", "dependency", ["model_9", "model_8"]),
        ("analysis", "", ["model_2"]),
    ]
    flat = [(t, s, i, m) for t, s, models in rows for i, m in enumerate(models)]
    return spark.createDataFrame(flat, "task string, subtask string, rank int, model string")
