"""Registered queries by name. Each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import paths, text
from treeloom.operators import (
    archive,
    bundle,
    callstats,
    diagrams,
    graph,
    imports,
    inventory,
    matching,
    quality,
    reach,
    replies,
    search,
    search_index,
    structure,
)
from treeloom.plans import fixtures as fx
from treeloom.plans import report
from treeloom.session import stage, stage_root
from treeloom.sources import bundle_files, encoding, tables, tree
from treeloom.streaming import callstream, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


# Inventory ---------------------------------------------------------------------------------------


@query
def extension_stats(spark, sf_dir):
    return inventory.extension_stats(fx.inventory_files(spark, sf_dir))


@query
def top_extensions(spark, sf_dir):
    return inventory.top_extensions(fx.inventory_files(spark, sf_dir), 4)


@query
def directory_rollup(spark, sf_dir):
    return inventory.directory_rollup(fx.inventory_files(spark, sf_dir)).select("directory", "file_count", "total_size")


@query
def corpus_totals(spark, sf_dir):
    return inventory.corpus_totals(fx.raw_paths(spark, sf_dir)).select("total_files", "total_dirs")


@query
def id_collisions(spark, sf_dir):
    return inventory.id_collisions(fx.raw_paths(spark, sf_dir)).drop("repo")


@query
def latest_per_id(spark, sf_dir):
    return inventory.latest_per_id(fx.raw_paths(spark, sf_dir)).drop("repo")


@query
def admissible_files(spark, sf_dir):
    return inventory.admissible(fx.raw_paths(spark, sf_dir)).select("relative_path", "size")


@query
def path_columns(spark, sf_dir):
    return inventory.with_path_columns(fx.raw_paths(spark, sf_dir)).select(
        "relative_path", "file_id", "name", "parent", "extension", "language"
    )


@query
def browser_ids(spark, sf_dir):
    return fx.raw_paths(spark, sf_dir).select(
        "relative_path", paths.browser_file_id(F.col("relative_path")).alias("file_id")
    )


@query
def flat_listing(spark, sf_dir):
    return inventory.flat_listing(fx.inventory_files(spark, sf_dir)).drop("repo")


@query
def flatten_nested(spark, sf_dir):
    """One two-level record per document: a folder that holds a folder that holds the file."""
    flat = inventory.flat_listing(fx.inventory_files(spark, sf_dir))
    item = F.struct("file_id", "relative_path", "extension", "size")
    none = F.filter(F.array(item), lambda x: F.lit(False))
    leaf = F.struct(F.array(item).alias("files"))
    trees = flat.select("repo", F.struct(none.alias("files"), F.array(leaf).alias("children")).alias("tree"))
    return inventory.flatten_nested(trees).drop("repo")


@query
def selection_totals(spark, sf_dir):
    return inventory.selection_totals(fx.inventory_files(spark, sf_dir), fx.selection(spark, sf_dir)).drop("repo")


@query
def selected_per_extension(spark, sf_dir):
    return inventory.selected_per_extension(
        fx.inventory_files(spark, sf_dir), fx.selection(spark, sf_dir)
    ).drop("repo")


@query
def selected_per_directory(spark, sf_dir):
    return inventory.selected_per_directory(
        fx.inventory_files(spark, sf_dir), fx.selection(spark, sf_dir), [".js", ".py", ".html"]
    ).drop("repo")


@query
def directory_states(spark, sf_dir):
    return inventory.directory_states(fx.inventory_files(spark, sf_dir), fx.selection(spark, sf_dir)).drop("repo")


@query
def extension_filter(spark, sf_dir):
    return inventory.extension_filter(fx.inventory_files(spark, sf_dir), [".css", ".html"]).select(
        "relative_path", "size"
    )


@query
def tree_keys(spark, sf_dir):
    return fx.raw_paths(spark, sf_dir).select("relative_path", paths.sort_key(F.col("relative_path")).alias("sort_key"))


@query
def preview(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("repo"), F.col("doc_id").alias("relative_path"), F.col("text").alias("content"),
        F.octet_length("text").alias("size"),
    )
    return inventory.preview(docs).select(F.col("relative_path").alias("doc_id"), "preview")


@query
def expanded_directories(spark, sf_dir):
    files = fx.inventory_files(spark, sf_dir)
    return inventory.expanded_directories(files.filter(F.contains("relative_path", F.lit("mod_1")))).drop("repo")


@query
def selection_edits(spark, sf_dir):
    files = fx.inventory_files(spark, sf_dir)
    grown = inventory.combine_selection(fx.selection(spark, sf_dir), inventory.subtree(files, "src3"), "add")
    return inventory.remove_from_selection(grown, inventory.subtree(files, "src3/en")).drop("repo")


@query
def selection_replace(spark, sf_dir):
    files = fx.inventory_files(spark, sf_dir)
    return inventory.combine_selection(fx.selection(spark, sf_dir), inventory.subtree(files, "src3"), "replace").drop("repo")


@query
def snapshot_roundtrip(spark, sf_dir):
    """The inventory written under an analysis id twice, beside another one, and read back."""
    files = fx.inventory_files(spark, sf_dir)
    path = f"{stage_root(spark)}/snapshots/{uuid.uuid4().hex}"
    for name, rows in (("other", files.limit(1)), ("one", files.limit(1)), ("one", files)):
        tables.write_snapshot({"files": rows}, path, name)
    return tables.read_snapshot(spark, path, "files", "one").select("doc_id", "relative_path", "size")


@query
def report_roundtrip(spark, sf_dir):
    """Edges and missing files of the saved dependency report of the selection."""
    path = f"{stage_root(spark)}/reports/{uuid.uuid4().hex}"
    report.save_report(report.dependency_report(fx.src_files(spark, sf_dir), fx.selection(spark, sf_dir)), path, "one")
    kinds = {"edge": ("edges", "src", "dst"), "missing": ("missing", "required_by", "suggested_file")}
    parts = [
        tables.read_snapshot(spark, path, table, "one").select(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"))
        for kind, (table, a, b) in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def language_codes(spark, sf_dir):
    return (
        fx.table(spark, sf_dir, "documents")
        .groupBy("lang", text.is_language_code(F.col("lang")).alias("valid"))
        .agg(F.count("*").alias("n_docs"))
    )


@query
def validate_ids(spark, sf_dir):
    """Requests of one unknown id and one known id named twice."""
    files = fx.inventory_files(spark, sf_dir)
    items = fx.table(spark, sf_dir, "benchmark").select("item_id")
    known = items.join(files, items.item_id == files.doc_id).select(
        "item_id", paths.file_id(F.col("relative_path")).alias("known")
    )
    unknown = F.concat(F.lit("nope_"), F.col("item_id").cast("string"))
    requests = known.select(
        F.lit("corpus").alias("repo"), F.col("item_id").alias("request_id"),
        F.posexplode(F.array(unknown, "known", "known")).alias("at", "file_id"),
    ).select("repo", "request_id", (F.col("at") + 1).cast("long").alias("position"), "file_id")
    return inventory.validate_ids(requests, files).drop("repo")


@query
def human_sizes(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.col("n_chars") * F.pow(F.lit(32), F.col("doc_id") % 7).cast("long")).alias("s"),
        F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") * F.lit(1099511627776)).alias("b"),
    )
    return docs.select(
        "doc_id", text.human_size(F.col("s")).alias("shown"), text.browser_size(F.col("b")).alias("shown_in_browser")
    )


# Names and search --------------------------------------------------------------------------------


def _names(spark, sf_dir):
    num = F.col("item_id").cast("string")
    return fx.table(spark, sf_dir, "benchmark").select(
        F.explode(
            F.array(
                F.concat(F.lit("MOD_"), num),
                F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/en")),
                F.concat(F.lit("nope_"), num),
                F.lit("js"),
                F.concat(F.lit("d_"), (F.col("item_id") % 9).cast("string"), F.lit(".p")),
            )
        ).alias("name")
    )


@query
def bulk_select(spark, sf_dir):
    return matching.bulk_select(fx.inventory_files(spark, sf_dir), _names(spark, sf_dir)).drop("repo")


@query
def bulk_not_found(spark, sf_dir):
    names = _names(spark, sf_dir)
    return matching.not_found(names, matching.bulk_select(fx.inventory_files(spark, sf_dir), names))


@query
def priority_select(spark, sf_dir):
    return matching.priority_select(fx.inventory_files(spark, sf_dir), _names(spark, sf_dir)).drop("repo")


@query
def name_list_parse(spark, sf_dir):
    return matching.parse_name_lists(fx.table(spark, sf_dir, "benchmark"), "text").select("item_id", "name")


@query
def search_topk(spark, sf_dir):
    index = search_index.build_temporary(fx.inventory_files(spark, sf_dir))
    return search_index.search(index, "Mod_1.ts js").drop("repo")


@query
def search_many(spark, sf_dir):
    num = F.col("item_id").cast("string")
    asked = fx.table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.posexplode(
            F.array(
                F.concat(F.lit("mod_"), num, F.lit(".js")),
                F.concat(F.lit("Src"), (F.col("item_id") % 20).cast("string"), F.lit("/en")),
                F.concat(F.lit("ts fr mod_"), (F.col("item_id") * 3).cast("string")),
                F.lit("/"),
            )
        ).alias("k", "query"),
    ).select((F.col("item_id") * 4 + F.col("k")).alias("query_id"), "query")
    index = search_index.build_temporary(fx.inventory_files(spark, sf_dir))
    return search_index.search_many(index, asked).select(
        "query_id", F.col("position").cast("long").alias("position"), "relative_path", "match_score"
    )


@query
def inverted_index(spark, sf_dir):
    return search.postings(fx.inventory_files(spark, sf_dir)).drop("repo")


@query
def term_counts(spark, sf_dir):
    return search.term_counts(fx.inventory_files(spark, sf_dir))


@query
def missing_suggestions(spark, sf_dir):
    files = fx.inventory_files(spark, sf_dir)
    num = F.col("doc_id").cast("string")
    lost = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("mod_"), num, F.lit(".ts")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("mod_"), num, F.lit(".html")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("d_"), num, F.lit(".")))
        .otherwise(F.concat(F.lit("old_mod_"), num, F.lit(".py")))
    )
    missing = (
        files.select("repo", F.concat(F.lit("lost/"), lost).alias("missing_path"))
        .union(files.select("repo", "relative_path"))
        .union(files.select("repo", F.lit("q/zzz.rs")))
    )
    return matching.suggest_missing(missing, files).drop("repo")


@query
def highlight(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.highlight(F.col("text"), "la").alias("marked"))


@query
def escape_html(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


# Import graph ------------------------------------------------------------------------------------


def _resolved(spark, sf_dir):
    """Resolved imports, staged: content is read once however often they are used."""
    files = fx.src_files(spark, sf_dir)
    return stage(imports.resolve(imports.imports(files), fx.inventory_files(spark, sf_dir).select(*inventory.KEY)))


def _all_edges(spark, sf_dir):
    return graph.edges(_resolved(spark, sf_dir), fx.inventory_files(spark, sf_dir))


def _graph(spark, sf_dir):
    """Nodes and edges over all files."""
    edge_rows = _all_edges(spark, sf_dir)
    return graph.nodes(fx.inventory_files(spark, sf_dir), edge_rows), edge_rows


@query
def file_imports(spark, sf_dir):
    return imports.imports(fx.src_files(spark, sf_dir)).drop("repo")


@query
def file_exports(spark, sf_dir):
    return imports.exports(fx.src_files(spark, sf_dir)).drop("repo")


@query
def import_edges(spark, sf_dir):
    return _all_edges(spark, sf_dir).drop("repo")


@query
def selected_edges(spark, sf_dir):
    return graph.edges(_resolved(spark, sf_dir), fx.selection(spark, sf_dir)).drop("repo")


@query
def missing_deps(spark, sf_dir):
    return graph.missing(_resolved(spark, sf_dir), fx.selection(spark, sf_dir)).drop("repo")


@query
def graph_degrees(spark, sf_dir):
    return _graph(spark, sf_dir)[0].drop("repo")


@query
def graph_metrics(spark, sf_dir):
    return graph.metrics(_graph(spark, sf_dir)[0]).drop("repo")


@query
def completeness(spark, sf_dir):
    chosen = fx.selection(spark, sf_dir)
    return graph.completeness(chosen, graph.missing(_resolved(spark, sf_dir), chosen)).drop("repo")


@query
def graph_roles(spark, sf_dir):
    return graph.role_filter(*_graph(spark, sf_dir), "leaf")[0].select("relative_path")


@query
def graph_role_edges(spark, sf_dir):
    """Edges among files that others need; the entry filter itself never leaves an edge."""
    node_rows, edge_rows = _graph(spark, sf_dir)
    needed = node_rows.withColumn("is_leaf", ~F.col("is_entry_point"))
    return graph.role_filter(needed, edge_rows, "leaf")[1].drop("repo")


@query
def graph_search(spark, sf_dir):
    return graph.search_nodes(_graph(spark, sf_dir)[0], "FR/mod_1").select("relative_path", "label")


@query
def graph_neighbourhood(spark, sf_dir):
    focus = fx.selection(spark, sf_dir).select("repo", F.col("relative_path").alias("node"))
    return graph.neighbourhood(_all_edges(spark, sf_dir), focus).drop("repo")


@query
def neighbour_labels(spark, sf_dir):
    node_rows, edge_rows = _graph(spark, sf_dir)
    out = graph.neighbour_labels(edge_rows, node_rows)
    return out.select("node", "side", F.array_join("labels", ",").alias("labels"), "n_more")


@query
def graph_export(spark, sf_dir):
    return graph.graph_export(*_graph(spark, sf_dir))[1].drop("repo")


@query
def graph_export_nodes(spark, sf_dir):
    return graph.graph_export(*_graph(spark, sf_dir))[0].drop("repo")


@query
def dependency_report(spark, sf_dir):
    """Nodes of the full report on the selection, with what each lacks."""
    parts = report.dependency_report(fx.src_files(spark, sf_dir), fx.selection(spark, sf_dir))
    lacking = parts["missing"].groupBy("repo", F.col("required_by").alias("relative_path")).agg(F.count("*").alias("n_missing"))
    return parts["nodes"].join(lacking, inventory.KEY, "left").select(
        "relative_path", "n_dependencies", "n_dependents", F.coalesce("n_missing", F.lit(0).cast("long")).alias("n_missing")
    )


@query
def reachability(spark, sf_dir):
    seed = fx.inventory_files(spark, sf_dir).filter("doc_id = 0").select("repo", F.col("relative_path").alias("node"))
    return reach.reach_both(_all_edges(spark, sf_dir), seed).drop("repo")


@query
def dependency_closure(spark, sf_dir):
    return reach.dependency_closure(_all_edges(spark, sf_dir), fx.selection(spark, sf_dir)).drop("repo")


@query
def import_cycles(spark, sf_dir):
    found, _ = reach.cycles(_all_edges(spark, sf_dir))
    return found.select(F.array_join("cycle", " ").alias("cycle"))


@query
def cycle_paths(spark, sf_dir):
    node_rows, edge_rows = _graph(spark, sf_dir)
    found, _ = reach.cycles(edge_rows)
    return reach.cycle_positions(found, node_rows).select("first", "position", "member", "label")


@query
def hierarchy(spark, sf_dir):
    """Paths among the selected files."""
    chosen = fx.selection(spark, sf_dir)
    edge_rows = graph.edges(_resolved(spark, sf_dir), chosen)
    rows, _ = reach.hierarchy(graph.nodes(chosen, edge_rows), edge_rows)
    return rows.select(F.array_join("path", " ").alias("path"), "node", "depth", "repeated")


# Structure ---------------------------------------------------------------------------------------


@query
def js_functions(spark, sf_dir):
    out = structure.js_functions(fx.src_files(spark, sf_dir)).drop("repo")
    return out.withColumns({c: F.array_join(c, ",") for c in ("api_calls", "dom_interactions")})


@query
def js_event_handlers(spark, sf_dir):
    return structure.js_event_handlers(fx.src_files(spark, sf_dir)).drop("repo")


@query
def js_globals(spark, sf_dir):
    return structure.js_globals(fx.src_files(spark, sf_dir)).drop("repo")


@query
def css_components(spark, sf_dir):
    return structure.css_components(fx.src_files(spark, sf_dir)).drop("repo")


@query
def css_tokens(spark, sf_dir):
    return structure.css_tokens(fx.src_files(spark, sf_dir)).select(
        "relative_path", F.array_join("colors", " ").alias("colors"), "spacing", "typography"
    )


@query
def css_media(spark, sf_dir):
    return structure.css_media(fx.src_files(spark, sf_dir)).drop("repo")


@query
def py_classes(spark, sf_dir):
    return structure.py_classes(fx.src_files(spark, sf_dir)).select(
        "relative_path", "class_name", F.array_join("attributes", ",").alias("attributes")
    )


@query
def py_methods(spark, sf_dir):
    return structure.py_methods(fx.src_files(spark, sf_dir)).drop("repo")


@query
def py_routes(spark, sf_dir):
    return structure.py_routes(fx.src_files(spark, sf_dir)).drop("repo")


@query
def py_imports(spark, sf_dir):
    return structure.py_imports(fx.src_files(spark, sf_dir)).drop("repo")


@query
def html_tags(spark, sf_dir):
    return structure.html_tags(fx.table(spark, sf_dir, "pages"), ["page_id"], "html")


@query
def html_links(spark, sf_dir):
    """Pages with one external script and one style sheet put in front."""
    head = F.concat(
        F.lit("<script async src='/s"), F.col("page_id").cast("string"), F.lit('.js\'></script><link rel="x" href="'),
        "url", F.lit('">'),
    )
    pages = fx.table(spark, sf_dir, "pages").withColumn("html", F.concat(head, "html"))
    return structure.html_links(pages, ["page_id"], "html")


@query
def generic_summary(spark, sf_dir):
    return structure.generic(fx.src_files(spark, sf_dir)).drop("repo")


@query
def structure_complexity(spark, sf_dir):
    return structure.complexity(fx.src_files(spark, sf_dir)).drop("repo")


@query
def structure_summaries(spark, sf_dir):
    out = structure.summaries(fx.src_files(spark, sf_dir))
    field = {"type": "string", "total_lines": "int", "complexity_score": "int", "size": "int"}
    return out.select(
        "relative_path", "language", "n_chars",
        *[F.get_json_object("summary", f"$.{k}").cast(t).alias(k) for k, t in field.items()],
    )


# Bundles and archives ----------------------------------------------------------------------------


@query
def bundle_sections(spark, sf_dir):
    return bundle.sections(fx.bundle_requests(spark, sf_dir), fx.sized_files(spark, sf_dir)).drop("repo")


@query
def bundle_contents(spark, sf_dir):
    return bundle.contents(fx.bundle_requests(spark, sf_dir), fx.inventory_files(spark, sf_dir))


@query
def bundle_manifest(spark, sf_dir):
    asked = fx.bundle_requests(spark, sf_dir)
    rows = bundle.parts(asked, fx.sized_files(spark, sf_dir), "2024-01-01 00:00:00")
    return bundle.manifest(rows, asked, "20240101_000000")


def _bundle_per_source(spark, sf_dir):
    files = fx.text_files(spark, sf_dir)
    asked = files.select(
        F.substring_index("relative_path", "/", 1).alias("bundle_id"), F.col("doc_id").alias("position"), "repo", "relative_path"
    )
    return asked, files


@query
def bundle_semantic(spark, sf_dir):
    """Every document's summary, in one bundle per source."""
    rows = bundle.generate(*_bundle_per_source(spark, sf_dir), "2024-01-01 00:00:00", "semantic")
    return rows.select("bundle_id", "position", "text")


@query
def bundle_hybrid(spark, sf_dir):
    """The fields of every record of the hybrid bundles."""
    rows = bundle.generate(*_bundle_per_source(spark, sf_dir), "2024-01-01 00:00:00", "hybrid")
    fields = F.from_json("text", "structure string, hash string, filename string, original_content string")
    return rows.select("bundle_id", "position", fields.alias("f")).select("bundle_id", "position", "f.*")


@query
def bundle_manifest_semantic(spark, sf_dir):
    asked, files = _bundle_per_source(spark, sf_dir)
    rows = bundle.generate(asked, files, "2024-01-01 00:00:00", "semantic")
    return bundle.manifest(rows, asked, "20240101_000000", "semantic")


def _bundle_per_block(spark, sf_dir):
    """Every document asked for, in bundles of a source's documents by thousands of ids."""
    files = fx.text_files(spark, sf_dir)
    block = F.concat(F.substring_index("relative_path", "/", 1), F.lit("_"), F.floor(F.col("doc_id") / 1000).cast("string"))
    asked = files.select(block.alias("bundle_id"), F.col("doc_id").alias("position"), "repo", "relative_path")
    return asked, files, f"{stage_root(spark)}/bundles/{uuid.uuid4().hex}"


@query
def bundle_files_markdown(spark, sf_dir):
    """Size and digest of the plain bundles as written to files."""
    asked, files, folder = _bundle_per_block(spark, sf_dir)
    bundle.write(asked, files, folder, "2024-01-01 00:00:00")
    return bundle.read_markdown(spark, folder).select("bundle_id", F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))


@query
def bundle_files_json(spark, sf_dir):
    """The records of the hybrid bundles as written to files, each one JSON array."""
    asked, files, folder = _bundle_per_block(spark, sf_dir)
    bundle.write(asked, files, folder, "2024-01-01 00:00:00", "hybrid")
    return bundle.read_json(spark, folder, "structure string, hash string, filename string, original_content string")


@query
def bundle_manifest_hybrid(spark, sf_dir):
    """Manifest of the hybrid bundles; their sizes are those of the files as written."""
    asked, files = _bundle_per_source(spark, sf_dir)
    rows = bundle.generate(asked, files, "2024-01-01 00:00:00", "hybrid")
    return bundle.manifest(rows, asked, "20240101_000000", "hybrid").drop("size")


@query
def semantic_metadata(spark, sf_dir):
    """Every document as a text file, in one bundle per source."""
    asked, files = _bundle_per_source(spark, sf_dir)
    rows = bundle.parts(asked, files, "2024-01-01 00:00:00", "semantic")
    return bundle.semantic_metadata(asked, files, rows)


@query
def bundle_parse(spark, sf_dir):
    return bundle.parse(fx.markdown_bundles(spark, sf_dir))


@query
def bundle_one_file(spark, sf_dir):
    parsed = bundle.parse(fx.markdown_bundles(spark, sf_dir))
    wanted = F.concat(F.lit("b "), F.col("doc_id").cast("string"), F.lit(".md"))
    return bundle.one_file(parsed, wanted).select("doc_id", "code")


@query
def bundle_invalid(spark, sf_dir):
    headed = F.concat(F.lit("\n## a\n"), "text")
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, headed).otherwise(F.col("text")).alias("text")
    )
    return bundle.invalid(docs)


@query
def content_hash_dedup(spark, sf_dir):
    return archive.originals(fx.table(spark, sf_dir, "documents")).select("hash", "filename", "prefix", "content")


@query
def content_store_add(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    store = archive.originals(docs.filter("lang = 'en'"))
    return archive.originals(docs, store=store).select("hash", F.length("content").alias("n_chars"))


@query
def archive_roundtrip(spark, sf_dir):
    records = archive.lossless(fx.table(spark, sf_dir, "documents"), ["doc_id"])
    restored = archive.restore_lossless(records, ["doc_id"])
    return restored.select("doc_id", "content", F.substring(F.sha2("content", 256), 1, 16).alias("hash"))


def _hybrid_records(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").withColumn("structure", F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')))
    return archive.hybrid(docs, ["doc_id", "lang"])


@query
def hybrid_records(spark, sf_dir):
    return _hybrid_records(spark, sf_dir).select(
        "doc_id", "hash", "filename", "original_size", "compressed_size", "compression_ratio", "compression_type"
    )


@query
def archive_restore(spark, sf_dir):
    """Lossless, hybrid (stored, inline or lost) and summary records."""
    docs = fx.table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    columns = ["doc_id", "sha256", "compression_type", "data", "original_content"]
    packed = archive.lossless(docs.filter(d % 4 == 0), ["doc_id"]).withColumn("original_content", F.lit(None).cast("string"))
    mixed = (
        _hybrid_records(spark, sf_dir).filter(d % 4 > 0)
        .withColumn("data", F.lit(None).cast("string"))
        .withColumn("original_content", F.when(d % 8 < 4, F.col("original_content")))
        .withColumn("compression_type", F.when(d % 4 == 3, "semantic_lossy").otherwise(F.col("compression_type")))
    )
    store = archive.originals(docs.filter("lang = 'en'"))
    return archive.restore(packed.select(columns).unionByName(mixed.select(columns)), store, ["doc_id"])


@query
def size_reduction(spark, sf_dir):
    return archive.reduction(_hybrid_records(spark, sf_dir), ["lang"])


@query
def retention(spark, sf_dir):
    files = fx.inventory_files(spark, sf_dir)
    return archive.retention(files, F.lit("2024-01-01 08:00:00").cast("timestamp")).select("relative_path", "expired")


@query
def retention_kept(spark, sf_dir):
    files = fx.inventory_files(spark, sf_dir)
    return archive.kept(files, F.lit("2024-01-01 08:00:00").cast("timestamp")).select("relative_path", "size")


@query
def store_retention(spark, sf_dir):
    """The store of all documents' texts after a sweep that keeps those some document young enough still names."""
    docs = fx.table(spark, sf_dir, "documents")
    store = tables.Generations(spark, f"{stage_root(spark)}/stores/{uuid.uuid4().hex}")
    store.replace(archive.originals(docs))
    files = fx.text_files(spark, sf_dir).withColumn("sha256", F.sha2("content", 256))
    left = archive.kept(files, F.lit("2024-01-01 03:00:00").cast("timestamp"))
    archive.sweep_store(store, left)
    return store.read().select("hash", "filename", F.length("content").alias("n_chars"))


def _written_tree(spark, sf_dir):
    """Every document written as a file with its whole text; the folder it is the tree of."""
    folder = f"{stage_root(spark)}/trees/{uuid.uuid4().hex}/corpus"
    rows = fx.inventory_files(spark, sf_dir).join(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    placed = rows.select(F.col("relative_path").alias("filename"), F.lit(0).cast("long").alias("position"), data.alias("data"))
    spark.dataSource.register(bundle_files.PlacedFiles)
    placed.write.format("placed_files").option("path", folder).mode("append").save()
    return folder


@query
def source_tree(spark, sf_dir):
    """Files of a tree on disk, one per document, with their decoded content."""
    rows = tree.read_tree(spark, [_written_tree(spark, sf_dir)], content=True)
    return tree.decoded(tree.files(rows)).select("repo", "relative_path", "name", "size", F.sha2("content", 256).alias("sha256"))


@query
def source_tree_filtered(spark, sf_dir):
    """Scripts and style sheets of over 500 bytes of the tree on disk; other files are not opened."""
    rows = tree.files(tree.read_tree(spark, [_written_tree(spark, sf_dir)], content=True, pushdown=True))
    return rows.filter(~F.col("name").endswith(".py")).filter(F.col("size") > 500).filter(~F.col("name").endswith(".html")).select(
        "relative_path", "size", F.octet_length("content").cast("long").alias("n_bytes")
    )


@query
def source_tree_folders(spark, sf_dir):
    """Folders of the tree on disk."""
    rows = tree.read_tree(spark, [_written_tree(spark, sf_dir)])
    return tree.directories(rows).select("directory", "name")


@query
def encoding_audit(spark, sf_dir):
    return encoding.audit(fx.encoded_files(spark, sf_dir)).select("encoding", "n_files")


@query
def decoded_content(spark, sf_dir):
    return fx.encoded_files(spark, sf_dir).select("doc_id", encoding.decode(F.col("content")).alias("content"))


# Checks ------------------------------------------------------------------------------------------


@query
def bracket_balance(spark, sf_dir):
    return quality.bracket_balance(fx.table(spark, sf_dir, "pages"), "html").select("page_id", "valid", "message")


@query
def style_balance(spark, sf_dir):
    """Style sheets and prose with a comment and every third time an open brace added."""
    files = fx.src_files(spark, sf_dir)
    odd = F.when(F.col("doc_id") % 3 == 0, "{").otherwise("")
    css = files.withColumn("content", F.concat("content", F.lit("/* { \n } { */"), odd))
    return quality.style_balance(css, "content").select("relative_path", "valid", "message")


@query
def python_syntax(spark, sf_dir):
    return quality.python_syntax(fx.src_files(spark, sf_dir)).select("relative_path", "valid")


@query
def required_paths(spark, sf_dir):
    files = fx.inventory_files(spark, sf_dir)
    required = fx.bundle_requests(spark, sf_dir).select("repo", "relative_path", F.lit("asked for").alias("description"))
    return quality.required_paths(required, files).select("relative_path", "found")


def _rules(spark, sf_dir):
    asked = fx.bundle_requests(spark, sf_dir).select("repo", "relative_path", "position")
    mark = F.concat(F.lit("/api/"), (F.col("position") % 5).cast("string"))
    return asked.select("repo", "relative_path", F.explode(F.array(F.lit("import"), F.lit("la"), mark)).alias("element"))


@query
def absent_elements(spark, sf_dir):
    return quality.absent_elements(_rules(spark, sf_dir), fx.src_files(spark, sf_dir)).drop("repo")


@query
def element_status(spark, sf_dir):
    return quality.element_status(_rules(spark, sf_dir), fx.src_files(spark, sf_dir)).drop("repo")


@query
def diagram_blocks(spark, sf_dir):
    """Two diagrams with prose between them in every document."""
    fence = "```"
    md = F.concat(
        F.lit(f"{fence}mermaid\ngraph TD\n  a"), F.col("doc_id").cast("string"), F.lit(f" --> b\n{fence}\n"), "text",
        F.lit(f"\n{fence}mermaid\n\npie {fence}"),
    )
    docs = fx.table(spark, sf_dir, "documents").withColumn("md", md)
    return diagrams.blocks(docs, ["doc_id"], "md")


@query
def diagram_to_lines(spark, sf_dir):
    return diagrams.to_lines(fx.table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query
def diagram_strict_lint(spark, sf_dir):
    return diagrams.strict_lint(fx.diagram_lines(spark, sf_dir))


@query
def diagram_detailed_lint(spark, sf_dir):
    return diagrams.detailed_lint(fx.diagram_lines(spark, sf_dir))


@query
def diagram_duplicate_nodes(spark, sf_dir):
    return diagrams.duplicate_nodes(fx.diagram_lines(spark, sf_dir))


@query
def diagram_unmatched_ends(spark, sf_dir):
    return diagrams.unmatched_ends(fx.diagram_lines(spark, sf_dir))


@query
def diagram_unclosed_blocks(spark, sf_dir):
    return diagrams.unclosed_blocks(fx.diagram_lines(spark, sf_dir))


@query
def diagram_undefined_ends(spark, sf_dir):
    return diagrams.undefined_ends(fx.diagram_lines(spark, sf_dir))


@query
def diagram_statistics(spark, sf_dir):
    """Every document read as a diagram."""
    return diagrams.statistics(fx.table(spark, sf_dir, "documents"), ["doc_id"], "text")


# Call statistics ---------------------------------------------------------------------------------


@query
def model_stats(spark, sf_dir):
    out = callstats.model_statistics(fx.model_calls(spark, sf_dir))
    return out.withColumns(
        {
            "last_success": F.unix_micros("last_success"),
        }
    )


@query
def degraded_models(spark, sf_dir):
    stats = callstats.model_statistics(fx.model_calls(spark, sf_dir))
    return callstats.degraded(stats, max_failure_rate=0.2, slow_seconds=20.2).select("model_name", "degraded")


@query
def recent_scores(spark, sf_dir):
    out = callstats.recent_scores(fx.model_calls(spark, sf_dir))
    return out.select("model_name", F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"))


@query
def running_mean(spark, sf_dir):
    return callstats.running_mean(fx.model_calls(spark, sf_dir)).select(
        "event_id", "model_name", "success_count", "avg_response_time"
    )


@query
def best_models(spark, sf_dir):
    return callstats.best_models(fx.routing(spark), callstats.model_statistics(fx.model_calls(spark, sf_dir)))


@query
def model_routing(spark, sf_dir):
    """Every event asks for a model."""
    e = F.col("event_id")
    requests = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.element_at(F.array(F.lit("documentation"), F.lit("analysis"), F.lit("other")), (e % 3 + 1).cast("int")).alias("task"),
        F.element_at(
            F.array(F.lit("architecture"), F.lit("readme"), F.lit("dependency"), F.lit("strange")), (e % 4 + 1).cast("int")
        ).alias("subtask"),
    )
    stats = callstats.model_statistics(fx.model_calls(spark, sf_dir))
    return callstats.route(requests, fx.routing(spark), stats, "model_default").select("event_id", "model")


@query
def stream_model_stats(spark, sf_dir):
    """All windows, the ones still open included: the last update of each."""
    emitted = run.run_available(callstream.windowed_statistics(fx.call_stream(spark, sf_dir)), "update")
    out = run.latest_rows(emitted, ["window_start", "model_name"])
    return out.select(
        F.unix_micros("window_start").alias("window_start"), "model_name", "success_count", "failure_count",
        "avg_response_time",
    )


@query
def stream_recent_scores(spark, sf_dir):
    emitted = run.run_available(callstream.recent_scores(fx.call_stream(spark, sf_dir)), "update")
    latest = run.latest_per_key(emitted, "model_name", "scores")
    return latest.select("model_name", F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"))


# Replies and prompts -----------------------------------------------------------------------------


@query
def reply_parse(spark, sf_dir):
    return replies.parse_replies(fx.replies(spark, sf_dir)).select(
        "reply_id", F.size("files").alias("n_files"), "reasoning", "confidence"
    )


@query
def reply_validate(spark, sf_dir):
    """Files named by replies that the inventory knows."""
    named = replies.reply_files(replies.parse_replies(fx.replies(spark, sf_dir)), ["reply_id"])
    asked = named.select(F.lit("corpus").alias("repo"), F.col("reply_id").alias("request_id"), "position", "file_id")
    return inventory.validate_ids(asked, fx.inventory_files(spark, sf_dir)).drop("repo")


@query
def reply_confidence_bands(spark, sf_dir):
    named = replies.reply_files(replies.parse_replies(fx.replies(spark, sf_dir)), ["reply_id"])
    return named.select("reply_id", "position", replies.confidence_band(F.col("confidence")).alias("band"))


@query
def prompt_chunks(spark, sf_dir):
    """File facts read back from the prompt chunks: every file once."""
    chunks = replies.file_fact_chunks(fx.inventory_files(spark, sf_dir), per_chunk=5)
    facts = F.from_json("files_json", "array<struct<id string, relative_path string, extension string, size long>>")
    return chunks.select("folder", F.explode(facts).alias("f")).select("folder", "f.*")


def _packs(spark, sf_dir):
    return replies.packed_facts(fx.inventory_files(spark, sf_dir), budget=2000)


@query
def prompt_packs(spark, sf_dir):
    """File facts in chunks of at most 2,000 characters."""
    return _packs(spark, sf_dir).drop("repo")


@query
def prompts(spark, sf_dir):
    """The opening of every user turn's prompts, and how many chunks follow."""
    asked = fx.table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.lit("corpus").alias("repo"), F.col("text").alias("query")
    )
    return replies.prompts(asked, _packs(spark, sf_dir)).select("query_id", "opening", "n_chunks", "n_files")
